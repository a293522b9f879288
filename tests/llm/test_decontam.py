"""op13: suffix arrays against plain search."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontam, queries

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, items, window=10):
    """(n_words, n_hit, items) of each text by looking at every place."""
    out = []
    wanted = [(str(i), WORDS.findall(lower(t))) for i, t in items]
    for text in docs:
        words = WORDS.findall(lower(text))
        hit, found = set(), set()
        for name, own in wanted:
            size = min(window, len(own))
            for s in range(len(own) - size + 1 if own else 0):
                for p in range(len(words) - size + 1):
                    if words[p:p + size] == own[s:s + size]:
                        hit |= set(range(p, p + size))
                        found.add(name)
        out.append((len(words), len(hit), sorted(found)))
    return out


def random_case(seed, n_docs=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["Été", "naïve", "x1"]
    sentence = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    items = [(i, sentence(rnd.choice([3, 8, 10, 11, 25]))) for i in range(8)] + [(8, None), (9, "..."), (7, sentence(12))]
    items.append((20, items[3][1]))  # the same text under two ids
    docs = []
    for _ in range(n_docs):
        text = sentence(rnd.randint(0, 60))
        if rnd.random() < 0.5:
            own = rnd.choice(items)[1] or ""
            text += ". " + own.upper().replace(" ", ",\n") + " " + sentence(rnd.randint(0, 9))
        docs.append(text)
    return docs + [None, "", " - ", docs[0], docs[0]], items


@pytest.mark.parametrize("options", [{}, {"shard_words": 37, "slice_bytes": 300}, {"block_bytes": 200}])
def test_screen_against_plain_search(spark, options):
    docs, items = random_case(3)
    d = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["row"]["doc_id"]: r for r in decontam.screen(d, b, **options).collect()}
    for i, (n_words, n_hit, found) in enumerate(plain(docs, items)):
        r = got[i]
        assert (r["n_words"], sum(r["hit"][1::2]) - sum(r["hit"][::2]), r["items"]) == (n_words, n_hit, found), docs[i]


def test_longest_matches_and_places(spark):
    passage = [f"p{i}" for i in range(30)]
    item = " ".join(["lead"] + passage + ["tail"])
    doc = " ".join(["a", "b"] + passage[5:27] + ["c"] + passage[:9] + ["d"] + passage[:10])
    rows = decontam.screen(spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([("q", item)], "item_id string, text string"), shard_words=16).first()
    assert sorted(tuple(m) for m in rows["matches"]) == [("q", 1, 35, 10), ("q", 6, 2, 22)]
    assert rows["hit"] == [2, 24, 35, 45]


def test_array_is_sorted_and_whole():
    words = np.random.default_rng(1).integers(0, 4, 500).astype(np.int32)
    array = decontam.suffix_array(words, 450, 10, 3)
    assert sorted(array.tolist()) == np.flatnonzero(words[:450]).tolist()
    padded = np.r_[words, np.zeros(10, np.int32)].tolist()

    def cut(p):  # what lies behind a stop need not be in order
        own = padded[p:p + 10]
        return own[:own.index(0)] if 0 in own else own

    full = [cut(p) for p in array.tolist()]
    assert all(a <= b for a, b in zip(full, full[1:]))


def test_removal_keeps_all_columns_and_clean_rows(spark):
    text = " ".join(f"k{i}" for i in range(12))
    docs = spark.createDataFrame([(None, text, 1, "x"), (2, "clean", 2, "y"), (2, None, 3, None)], "doc_id long, text string, hit int, items string")
    left = decontam.remove_contaminated(docs, spark.createDataFrame([(None, text)], "item_id string, text string"))
    assert left.columns == docs.columns
    assert sorted(r["hit"] for r in left.collect()) == [2, 3]
    assert decontam.remove_contaminated(docs, spark.createDataFrame([], "item_id string, text string")).count() == 3
    assert decontam.screen(docs.limit(0), docs.select(F.col("items").alias("item_id"), "text")).count() == 0


def test_registered_query(spark, tmp_path):
    docs, items = random_case(5)
    spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(f"b{i}", t) for i, t in items], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_suffix_array_leaks(spark, str(tmp_path)).collect()}
    for i, (n_words, n_hit, found) in enumerate(plain(docs, [(f"b{j}", t) for j, t in items])):
        assert got[i] == (n_words, n_hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), n_hit > 0)
