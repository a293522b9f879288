"""The training-data operators against brute force, and on awkward tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import imatch, jaccard, lines, packing, phrases, pieces, privacy, quality, sharding, vectors
from millrace.llm.common import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def near_copy(rng, text):
    words = text.split()
    words[rng.randrange(len(words))] = "changed"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, a shared passage, common lines and personal data."""
    rng = random.Random(3)
    base = [sentence(rng, rng.randint(3, 120)) for _ in range(40)]
    passage = sentence(rng, 50)
    texts = list(base)
    texts += [base[0]] * 4 + [near_copy(rng, base[i]) for i in (1, 1, 1, 2, 3, 4)]
    texts += [sentence(rng, 20) + " " + passage + " " + sentence(rng, 20) for _ in range(6)]
    texts += [sentence(rng, 10) + "\n  Common LINE \n" + sentence(rng, 10) for _ in range(12)]
    texts += [sentence(rng, 5) + f"\nwrite to bob@mail.example.org or 10.0.0.{i} secretword now\n" + "tail" for i in range(8)]
    texts += ["Er " * 90, "", " \t\n ", "é日 😀 ﬁ", "x" * 30000]
    return texts


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(corpus)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def awkward(spark):
    """Null ids and texts, repeated rows, and columns that operators use themselves."""
    rows = [(None, "a b c d e f", 1), (1, None, 2), (1, None, 2), (2, "", 3), (3, "a b c d e f", 4), (3, "a b c d e f", 4), (4, "mail x@y.zz\nmail", None)]
    return spark.createDataFrame([(*r, "q", 0, 0, "z", 7, 0.1, "b", [1]) for r in rows], "doc_id long, text string, n_chars long, key string, shard int, slot int, part string, n_lines int, quality_score double, sanitised string, ids array<int>")


def collected(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


# --- quality ---------------------------------------------------------------------

def labelled(spark):
    rng = random.Random(1)
    good = [sentence(rng, 150) for _ in range(150)]
    bad = [sentence(rng, 100).replace(" ", "%%% ") if i % 2 else sentence(rng, 80).upper() + "!!" for i in range(150)]
    rows = [(i, t, int(i < 150)) for i, t in enumerate(good + bad)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_quality_is_learned_from_labels(spark):
    rows = labelled(spark)
    model = quality.fit(rows.drop("quality"), rows.select("doc_id", "quality"))
    scored = quality.score_documents(rows, model).withColumn("out", quality.held_out(F.col("doc_id"))).collect()
    held = [r for r in scored if r.out]
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in scored)
    assert np.mean([(r.quality_score >= 0.5) == (r.quality == 1) for r in held]) > 0.95


def test_quality_gradients():
    """A small step against each analytic gradient lowers the loss: training fits separable bags."""
    rng = np.random.default_rng(0)
    bags = [rng.random((rng.integers(1, 4), quality.WIDTH)) + (0.3 * (i % 2)) for i in range(60)]
    y = np.array([i % 2 for i in range(60)], np.float32)
    model = quality.fit_attention(bags, y, epochs=30)
    p = np.array([model.score(b, np.array([0]))[0] for b in bags])
    assert ((p >= 0.5) == (y == 1)).mean() > 0.95


def test_quality_on_awkward_tables(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(awkward, none) is None
    assert {r.quality_score for r in quality.score_documents(awkward, None).collect()} == {0.5}
    odd = spark.createDataFrame([(3, None), (4, 1), (2, 5), (None, 1)], "doc_id long, quality int")
    scored = quality.score_documents(awkward, quality.fit(awkward, odd)).collect()
    assert len(scored) == 7 and all(0 <= r.quality_score <= 1 for r in scored)
    assert quality.score_documents(awkward.limit(0), None).count() == 0


# --- neighbours ------------------------------------------------------------------

def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    hot = rng.standard_normal(16)
    rows = [(i, (hot + 0.01 * rng.standard_normal(16) if i % 3 == 0 else rng.standard_normal(16)).tolist()) for i in range(600)]
    rows += [(600 + i, rows[0][1]) for i in range(20)] + [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [1.0, None] * 8), (704, [1.0]), (None, [1.0] * 16), (705, [-0.0] * 15 + [2.0])]
    df = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string")
    want = vectors.brute_force([i for i, v in rows if i is not None and i != 704], [v for i, v in rows if i is not None and i != 704], 10)
    out = vectors.nearest(df, 10, k=5, probe_share=1.0, block_rows=50, query_rows=7)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in out.collect()}
    assert len(got) == len(want)
    near = sum(got[q, k][0] == v for q, k, v, _ in want) / len(want)
    assert near > 0.97 and all(abs(got[q, k][1] - s) < 1e-3 for q, k, v, s in want if got[q, k][0] == v)
    assert [got[600, k][0] for k in range(1, 6)] == [0, 601, 602, 603, 604]  # equal vectors: smaller ids first


def test_neighbours_of_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert vectors.nearest(spark.createDataFrame([], schema), 10).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], schema)
    assert collected(vectors.nearest(few, 10), "query_id", "rank", "vec_id") == [(0, 1, 1), (0, 2, 2)]


def test_code_estimates_keep_their_bound():
    rng = np.random.default_rng(5)
    x, turn = vectors.unit(rng.standard_normal((500, 32))), vectors.rotation(32)
    c = np.zeros((1, 32))
    bits, scalars = vectors.encode(x, c, turn, np.zeros(500, int))
    guess, error = vectors.estimate(bits, scalars, x[:40], c[0], turn)
    assert (np.abs(guess - x[:40] @ x.T) <= error + 1e-9).mean() > 0.9


# --- packing ---------------------------------------------------------------------

def test_packing_covers_every_id_once(spark, docs, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    out = packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), capacity=64, outputs=("ids", "ids_crc32")).collect()
    windows = {}
    for r in out:
        windows.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
    for rows in windows.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == list(np.cumsum([0] + [r.length for r in rows])[:-1]) and sum(r.length for r in rows) <= 64
    assert sum(sum(r.length for r in rows) < 64 for rows in windows.values()) <= docs.rdd.getNumPartitions()
    for i, text in enumerate(corpus):
        parts = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
        assert sum((list(r.ids) for r in parts), []) == tokenizer.encode(text, add_special_tokens=False).ids + [0]


def test_packing_chooses_the_level_of_least_squares():
    rng = random.Random(4)
    packer = packing.WindowPacker(32)
    for k in range(300):
        size = rng.randint(1, 31)
        counts = packer.counts.copy()
        level = packer._level_for(size)

        def squares(h):
            c = counts.copy()
            if h:
                c[h] -= 1
            if h + size < 32:
                c[h + size] += 1
            return int((c[1:] ** 2).sum())

        allowed = [h for h in range(0, 33 - size) if h == 0 or counts[h]]
        assert squares(level) == min(map(squares, allowed)) and level in allowed
        list(packer.place(k, 0, size))


def test_packing_on_awkward_tables(awkward):
    out = packing.pack_documents(awkward, tokenizer_path("byte_bpe_50k.json"), outputs=("ids_crc32",))
    assert sorted((r.doc_tokens for r in out.where("start = 0").collect())) == sorted([7, 1, 1, 1, 7, 7, 8]) or out.where("start = 0").count() == 7
    assert packing.pack_documents(awkward.limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0


# --- sharding --------------------------------------------------------------------

def test_shards_are_exact_and_gapless(docs, corpus):
    rows = sharding.shuffle_into_shards(docs, 7, seed=1, block_rows=3).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(corpus)))
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(7)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = sharding.shuffle_into_shards(docs, 7, seed=1, block_rows=3)
    assert collected(again, "doc_id", "shard", "slot") == sorted(((r.doc_id, r.shard, r.slot) for r in rows), key=str)


def test_hypergeometric_law():
    rng = np.random.default_rng(1)
    draws = np.array([sharding.hypergeometric(rng, 12, 20, 9) for _ in range(6000)])
    want = np.random.default_rng(2).hypergeometric(12, 20, 9, 6000)
    assert np.abs(np.bincount(draws, minlength=10) - np.bincount(want, minlength=10)).max() < 250
    big = sharding.hypergeometric(rng, 3 * 10**10, 5 * 10**10, 10**9)
    assert abs(big - 10**9 * 3 / 8) < 10**6
    sizes, columns = np.array([5, 0, 9, 3]), np.array([6, 6, 5])
    matrix = np.array([sharding.matrix_row(sizes, columns, p, 4) for p in range(4)])
    assert (matrix.sum(1) == sizes).all() and (matrix.sum(0) == columns).all()


def test_sharding_on_awkward_tables(awkward):
    out = sharding.shuffle_into_shards(awkward, 3, stable=False)
    assert out.count() == 7 and set(awkward.columns) == set(out.columns)
    assert sharding.shuffle_into_shards(awkward.limit(0), 3, stable=False).count() == 0


# --- repeated phrases ------------------------------------------------------------

@pytest.mark.parametrize("window,per_shard,per_task", [(35, 2000, 4000), (12, 3, 2)])
def test_phrases_against_brute_force(docs, corpus, window, per_shard, per_task):
    rows = phrases.remove_repeated(docs, window, per_shard, per_task).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in rows}
    assert got == dict(enumerate(phrases.brute_force(corpus, window))) and any(r.n_removed for r in rows)


def test_phrases_on_awkward_tables(awkward):
    rows = phrases.remove_repeated(awkward, 8).collect()
    assert sorted(r.n_words for r in rows) == [0, 0, 0, 3, 6, 6, 6] and not any(r.n_removed for r in rows)
    assert phrases.remove_repeated(awkward.limit(0)).count() == 0


# --- fingerprints ----------------------------------------------------------------

def test_fingerprints(docs, corpus):
    rows = {r.doc_id: r for r in imatch.fingerprint_pairs(docs, low=0.01, high=0.3, rows_per_part=10).collect()}
    assert sorted(rows) == list(range(len(corpus)))
    for i, text in enumerate(corpus):
        changed = imatch.edited(text, corpus[(i + 1) % len(corpus)])
        assert rows[i].n_chars == len(text) and rows[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
    marks = {}
    for i, text in enumerate(corpus):
        assert marks.setdefault(text, rows[i].fingerprint) == rows[i].fingerprint
    long = [r for r in rows.values() if 200 < r.n_chars < 2000]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long])


def test_fingerprints_on_awkward_tables(awkward):
    rows = imatch.fingerprint_pairs(awkward, rows_per_part=2).collect()
    assert len(rows) == 7 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert imatch.fingerprint_pairs(awkward.limit(0)).count() == 0


# --- lines -----------------------------------------------------------------------

def plain_lines(texts, min_docs):
    split = [(t or "").split("\n") for t in texts]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    met = {}
    for parts in split:
        for k in {key(x) for x in parts}:
            met[k] = met.get(k, 0) + 1
    kept = [[x for x in parts if not key(x) or met[key(x)] < min_docs] for parts in split]
    return [(len(p), len(p) - len(k), "\n".join(k)) for p, k in zip(split, kept)]


@pytest.mark.parametrize("bits", [1 << 27, 1 << 20])
def test_lines_against_brute_force(docs, corpus, bits):
    rows = lines.drop_repeated_lines(docs, 10, bits).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in rows} == dict(enumerate(plain_lines(corpus, 10)))
    assert sum(r.n_dropped for r in rows) >= 12


def test_lines_on_awkward_tables(awkward):
    out = lines.drop_repeated_lines(awkward, 3)
    want = plain_lines([r.text for r in awkward.collect()], 3)
    assert collected(out, "n_lines", "n_dropped", "text") == sorted(want, key=str)
    assert lines.drop_repeated_lines(awkward.limit(0), 2).count() == 0


# --- personal data ---------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    def ok(kind, value):
        digits = re.sub("[^0-9]", "", value)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]

    return [(k, m.start(), m.end()) for k in BASE for m in re.finditer(BASE[k], text or "") if ok(k, m[0])]


def test_base_entities_are_those_of_the_plain_patterns(spark):
    rng = random.Random(9)
    parts = ["a", "b.c", "@", "x@y.zz", ".", "1", "25", "256", "4111111111111111", "4111 1111-1111 1111", "+", "+1", " ", "-", "(", ")", "\n", "é", "😀", "_", "7", "192.168.0.1", "+49 (30) 555-1234", "0000"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    texts += ["9" * 20000, "a" * 20000 + "@", "1." * 3000, "+1" + "0 " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in privacy.sanitise(df).collect():
        got = [] if r.entities is None else [(s.kind, s.start, s.end) for k in privacy.KINDS for s in r.entities[k]]
        assert got == base_spans(texts[r.doc_id]), texts[r.doc_id]


def test_revealing_terms_are_hidden(docs, corpus):
    rows = {r.doc_id: r for r in privacy.sanitise(docs).collect()}
    first = next(i for i, t in enumerate(corpus) if "secretword" in t)
    out = rows[first].sanitised
    assert "secretword" not in out and "[EMAIL]" in out and "[IP]" in out
    plain = [i for i, t in enumerate(corpus) if not base_spans(t)]
    assert all(rows[i].sanitised == corpus[i] for i in plain)


def test_privacy_on_awkward_tables(awkward):
    out = privacy.sanitise(awkward).collect()
    assert sorted(r.sanitised for r in out) == sorted(["a b c d e f"] * 3 + [""] * 3 + ["mail [EMAIL]\nmail"])
    assert privacy.sanitise(awkward.limit(0)).count() == 0


# --- similarity join -------------------------------------------------------------

@pytest.mark.parametrize("small,block", [(128, 2_000_000), (2, 300)])
def test_join_against_brute_force(docs, corpus, small, block):
    rows = {r.doc_id: r for r in jaccard.similarity_groups(docs, small=small, block_shingles=block, max_depth=3).collect()}
    want = jaccard.brute_force(corpus)
    assert {i: (r.group_id, r.links) for i, r in rows.items()} == dict(enumerate(want))
    assert len({r.class_id for r in rows.values()}) == len({" ".join(t.lower().split()) for t in corpus})


def test_join_of_dense_groups_and_sizes_apart(spark):
    """A group of near copies that no split separates, a passage shared by texts of many sizes, repeated rows."""
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1:]) for i in range(1, 41)]
    texts += [" ".join(base[:20] + [f"y{k}_{i}" for i in range(30 * k)]) for k in range(1, 11)]
    texts += [texts[0], texts[0], texts[45]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    twice = docs.unionByName(docs.where("doc_id < 3"))
    want = dict(enumerate(jaccard.brute_force(texts)))
    for small, block in [(128, 2_000_000), (4, 400)]:
        rows = jaccard.similarity_groups(twice, small=small, block_shingles=block).collect()
        assert len(rows) == len(texts) + 3 and {(r.doc_id, r.group_id, r.links) for r in rows} == {(i, *w) for i, w in want.items()}


def test_join_on_awkward_tables(awkward):
    rows = jaccard.similarity_groups(awkward).collect()
    assert len(rows) == 7 and {r.group_id for r in rows} == {1, 3, 4}
    assert jaccard.similarity_groups(awkward.limit(0)).count() == 0


# --- pieces ----------------------------------------------------------------------

def test_pieces_are_those_of_the_library(docs, corpus):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for r in pieces.encode_documents(docs, tokenizer_path("piece_bpe_32k.model")).collect():
        assert list(r.ids) == sp.encode(corpus[r.doc_id]) and r.decoded == sp.decode(list(r.ids)) and r.n_tokens == len(r.ids)


def test_merge_rounds_on_random_strings():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    codec, rng = pieces.codec(tokenizer_path("piece_bpe_32k.model")), random.Random(6)
    alphabet = ["a", "aa", "b", " ", "  ", "the", "in", "er", "\n", "▁", "é", "日", "😀", "\x00", "<s>", "<0x41>", "1", "!"]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        ids = codec.encode([text])[0]
        assert ids.tolist() == sp.encode(text) and codec.decode(ids) == sp.decode(ids.tolist())


def test_pieces_on_awkward_tables(awkward):
    out = pieces.encode_documents(awkward, tokenizer_path("piece_bpe_32k.model"))
    assert sum(r.n_tokens == 0 and r.decoded == "" for r in out.collect()) == 3
    assert pieces.encode_documents(awkward.limit(0), tokenizer_path("piece_bpe_32k.model")).count() == 0
