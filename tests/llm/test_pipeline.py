"""The stages of the pipeline on small tables."""

import random

import pytest

import corpus_pipeline
from millrace.llm import jaccard, lines
from millrace.llm.common import tokenizer_path
from tests.llm.test_operators import SCHEMA, corpus, docs, labelled, plain_lines, sentence  # noqa: F401


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(3)


def prose(rng, n_lines=5):
    return "\n".join(sentence(rng, 25) for _ in range(n_lines))


def first_lines(rows, min_docs):
    """Texts of (doc_id, text) rows without the later places of common lines; the rows differ."""
    gone = plain_lines([t for _, t in rows], min_docs)
    seen, out = set(), {}
    for at in sorted(range(len(rows)), key=lambda k: rows[k][0]):
        left = gone[at][2].split("\n") if gone[at][2] or gone[at][0] > gone[at][1] else []
        kept = []
        for x in (rows[at][1] or "").split("\n"):
            key = x.strip().lower()
            if left and x == left[0]:
                kept.append(left.pop(0))
            elif key not in seen:
                seen.add(key)
                kept.append(x)
        out[rows[at][0]] = "\n".join(kept)
    return out


@pytest.fixture(scope="module")
def copies():
    """Twelve copies of one text, twelve near copies of another, and clean texts."""
    rng = random.Random(12)
    one, two = prose(rng), prose(rng)
    rows = [(i, one) for i in range(12)]
    rows += [(20 + i, two + "\n" + sentence(rng, 4)) for i in range(12)]
    return rows + [(40 + i, prose(rng)) for i in range(6)]


def test_a_group_of_copies_keeps_one_full_text(spark, copies):
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_common_lines(spark, table(spark, copies), "").collect()}
    assert got[0] == copies[0][1] and all(got[i] == "" for i in range(1, 12))
    assert got == first_lines(copies, 10)
    kept = corpus_pipeline.one_of_each_group(spark, table(spark, got.items()), "").collect()
    assert copies[0][1] in [r.text for r in kept]


def test_first_places_against_plain_python(docs, corpus):  # noqa: F811
    rows = lines.drop_repeated_lines(docs, 10, keep_lines="first").collect()
    assert {r.doc_id: r.text for r in rows} == first_lines(list(enumerate(corpus)), 10)
    assert sum(r.n_dropped for r in rows) == sum(n for _, n, _ in plain_lines(corpus, 10)) - 1


def test_repeated_and_null_ids_keep_one_of_each_group(spark):
    rng = random.Random(5)
    a, b, c = (sentence(rng, 80) for _ in range(3))
    rows = [(1, a), (1, a + " more"), (1, b), (2, a), (None, c), (None, c + " more"), (None, c), (1, a), (3, ""), (4, None), (5, b)]
    kept = corpus_pipeline.one_of_each_group(spark, table(spark, rows), "").collect()
    assert sorted((r.text or "")[:20] for r in kept) == sorted(t[:20] for t in (a, b, c, ""))
    assert {r.doc_id for r in kept} == {1, None, 3}


def test_good_documents_are_kept_whole(spark, tmp_path):
    rows = labelled(spark)
    rows.select("doc_id", "quality").write.parquet(f"{tmp_path}/labels.parquet")
    texts = {r.doc_id: r.text for r in rows.collect()}
    kept = {r.doc_id: r.text for r in corpus_pipeline.keep_good(spark, table(spark, texts.items()), str(tmp_path)).collect()}
    assert all(texts[i] == t for i, t in kept.items())
    assert len(set(kept) & set(range(150))) > 142 and len(set(kept) - set(range(150))) < 8


def test_run_against_plain_python(spark, tmp_path, copies):
    from tokenizers import Tokenizer

    rows = [*copies, (100, None), (101, ""), (102, copies[-1][1] + " end"), (103, "write to ann@mail.example.org"), (104, "write\nwrite\nwrite on\nwrite one<|endoftext|>two")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    pieces = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    left = first_lines(rows, 10)
    ids = sorted(left)
    kept = [i for i, (group, _) in zip(ids, jaccard.brute_force([left[i] for i in ids])) if ids[group] == i]
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = {i: library.encode(left[i].replace("ann@mail.example.org", "[EMAIL]"), add_special_tokens=False).ids + [0] for i in kept}
    assert {i: sum((list(p.ids) for p in sorted(ps, key=lambda p: p.start)), []) for i, ps in pieces.items()} == want
    assert left[0] == copies[0][1] and {0, 40, 45, 104} <= set(want)
