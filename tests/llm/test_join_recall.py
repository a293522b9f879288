"""Recall of the join at the threshold where all that pairs share lies in split buckets."""

import random

from millrace.llm import jaccard


def test_runs_follow_the_depth():
    assert [jaccard.runs_for(0.9999, k) for k in range(3)] == [10, 15, 20]
    for k in range(7):
        met = 1.0
        for _ in range(k + 1):
            met = 1 - 2.718281828459045**-met
        assert (1 - met) ** jaccard.runs_for(0.9999, k) <= 1.001e-4


def test_pairs_that_share_only_frequent_words_are_found(spark):
    rng = random.Random(21)
    pool, texts = [f"p{i}" for i in range(128)], []
    for k in range(600):
        shared = rng.sample(pool, 32)
        texts += [" ".join(shared), " ".join(shared + [f"u{k}x{i}" for i in range(8)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in jaccard.similarity_groups(docs, words=1, small=4).collect()}
    lost = sum(rows[i].links == 0 for i in range(0, 1200, 2))
    assert lost <= 1 and all(rows[i].links == rows[i + 1].links for i in range(0, 1200, 2))


def test_turns_are_split_in_the_same_passes(spark, monkeypatch):
    """Buckets split several times ask for more runs; their passes are shared, and all links are still found."""
    rng = random.Random(4)
    pool, texts = [f"p{i}" for i in range(40)], []
    for k in range(80):
        shared = rng.sample(pool, 16)
        texts += [" ".join(shared), " ".join(shared + [f"u{k}x{i}" for i in range(4)])]
    labels, one, counted = [], jaccard.keep, jaccard.keep_counted
    monkeypatch.setattr(jaccard, "keep", lambda df, label: labels.append(label) or one(df, label))
    monkeypatch.setattr(jaccard, "keep_counted", lambda df, label: labels.append(label) or counted(df, label))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in jaccard.similarity_groups(docs, words=1, small=4, max_depth=3).collect()}
    assert {i: (r.group_id, r.links) for i, r in rows.items()} == dict(enumerate(jaccard.brute_force(texts, words=1)))
    splitting = [x for x in labels if x.startswith(("top", "more", "again", "deep", "children", "shared"))]
    assert len(splitting) <= 1 + 2 * 9, splitting  # three levels of turn 0, then turns 2 and 3 with three levels each
