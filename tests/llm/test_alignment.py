"""op12: alignment in units against whole texts encoded by the libraries."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from millrace.llm import alignment, queries
from millrace.llm.common import tokenizer_path

BYTE, PIECE = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text, token by token."""
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    rows = []
    for text in texts:
        ia = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        ra = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia]
        rb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(ra) != raw or b"".join(rb) != raw:
            rows.append(([], [], [], []))
            continue
        ends = []
        for parts in (ra, rb):
            at, e = 0, []
            for p in parts:
                at += len(p)
                e.append(at)
            ends.append(e)
        links, j = [], 0
        for i, e in enumerate(ends[0]):
            s = e - len(ra[i])
            links += [(ia[i], ib[k]) for k in range(len(ib)) if ends[1][k] > s and ends[1][k] - len(rb[k]) < e]
        groups, pa, pb = [], 0, 0
        for x in sorted(set(ends[0]) & set(ends[1])):
            na, nb = ends[0].index(x) + 1, ends[1].index(x) + 1
            groups.append(",".join(map(str, ia[pa:na])) + "|" + ",".join(map(str, ib[pb:nb])))
            pa, pb = na, nb
        rows.append((ia, ib, links, groups))
    count = Counter(p for _, _, links, _ in rows for p in set(links))
    most = Counter()
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    return [(len(ia), len(ib), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), ";".join(groups)) for ia, ib, links, groups in rows]


def texts(seed=1, n=120):
    rnd = random.Random(seed)
    bits = ["the", "The", "word", "ording", "Été", "naïve", "日本語", "🙂🙃", "don't", "it's.", "x1", "3.14", ",", "...", "?!", "s.", "a,b;c", "<0x41>", "<|endoftext|>", "<s>", " ", "\x1c", "é", "​", "$$$", "&&&", "'s", "\0", "\u0085", "İ"]
    gaps = [" ", " ", " ", " ", "", "\n", "\n", "  ", "\t", " \n", "\n\n", "\n ", "   ", "\r\n", ".\n", ". "]
    out = []
    for _ in range(n):
        text = "".join(rnd.choice(bits) + rnd.choice(gaps) for _ in range(rnd.randint(0, 25)))
        out.append(rnd.choice(["", "", " ", "\n", "  ", "\t"]) + text)
    return out + [None, "", " ", "  ", "\n", "has ▁ in it", "plain words here", "plain words here", out[3]]


def check(rows, want):
    got = {r["doc_id"]: r for r in rows}
    for i, w in enumerate(want):
        r = got[i]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) == w[:6], i
        assert r["groups_sha256"] == (hashlib.sha256(w[6].encode()).hexdigest() if w[0] else ""), i


@pytest.mark.parametrize("options", [{}, {"max_pairs": 0}, {"table_units": 1, "groups": True}])
def test_against_whole_texts(spark, options):
    own = texts()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(own)], "doc_id long, text string").repartition(3)
    rows = alignment.align_documents(docs, BYTE, PIECE, **options).collect()
    want = plain(own)
    assert sum(w[0] > 0 for w in want) > 100
    check(rows, want)
    if options.get("groups"):
        assert {r["doc_id"]: r["groups"] for r in rows} == {i: w[6] for i, w in enumerate(want)}


def test_units_join_to_the_text():
    tool = alignment.Aligner(BYTE, PIECE)
    for text in texts(7, 300):
        if text:
            assert "".join(map(tool.unit, tool.keys(text))) == " " + text


def test_documents_of_the_test_data(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()
    own = [r["text"][:1500] if r["text"] else None for r in rows]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(own)], "doc_id long, text string")
    check(alignment.align_documents(docs, BYTE, PIECE).collect(), plain(own))


def test_long_text_in_parts(spark, monkeypatch):
    own = "".join(texts(9, 60)[:60]).replace("▁", "")
    tool = alignment.Aligner(BYTE, PIECE)
    whole = tool.measure([own])[0]
    monkeypatch.setattr(alignment, "PART", 100)
    (sums, pairs, weights), digest = tool.long_text(own)
    assert sums.tolist() == whole[0].tolist() and pairs.tolist() == whole[2].tolist() and weights.tolist() == whole[3].tolist()
    assert digest == hashlib.sha256(";".join(whole[1]).encode()).hexdigest()


def test_registered_query_with_other_columns(spark, tmp_path):
    own = texts(4, 40)
    spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(own)], "doc_id long, text string, n_a int, pairs string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_token_alignment(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    check(out.collect(), plain(own))
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_documents(docs, BYTE, PIECE).count() == 0
