"""Repeated passages found and removed with sharded Aho-Corasick automata.

A window is ``window`` consecutive words. Every window has an anchor, the smallest hash
of its ``GRAM``-word groups, so equal windows have equal anchors; consecutive windows
with one anchor form a run. Only runs whose anchor occurs again can hold a repeated
window. Equal runs are one variant, counted; the windows of all variants are counted by
128-bit hashes, which confirms the recurring passages: a variant with two occurrences
entirely, any other variant where its windows are met elsewhere. The passages of the
latter are compiled into Aho-Corasick automata, sharded by passage, and their variants
are streamed through them to locate every occurrence; each document gets the spans of
its runs and loses the covered words.

Hot passages: anchors, variants and windows are counted with partial aggregation, joins
meet one row per key on one side, and a shard with many texts to search is dealt to
several tasks that each compile its automaton.

Words are maximal stretches without ASCII white space. Windows are judged on the input,
and each row is a document of its own also with a repeated doc_id. Null and empty texts
have no words. Texts are read whole. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import id_and_text, keep, keep_counted, map_arrow, take_runs

GRAM = 8
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
SLICE = 2 << 20


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""

    def __init__(self, base: np.uint64):
        self.base, self.back = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.multiply.accumulate(np.r_[np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]) for b in (self.base, self.back))

    def hashes(self, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the word hashes in each [start, end)."""
        self.upto(len(h) + 1)
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.up[:len(h)], out=total[1:])
        x = (total[end] - total[start]) * self.down[start]
        return x ^ (x >> np.uint64(32))


class WordHashes:
    """Words of texts and their 64-bit hashes."""

    def __init__(self, limit: int = 600_000):
        self.limit, self.known = limit, {}
        self.p1, self.p2, self.p3 = _Powers(M1), _Powers(M2), _Powers(M3)

    def of(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        got = list(map(known.get, words))
        if None in got:
            for i, h in enumerate(got):
                if h is None:
                    w = words[i]
                    h = known.get(w)
                    if h is None:
                        h = known[w] = xxhash.xxh3_64_intdigest(w)
                    got[i] = h
        return np.array(got, np.uint64)


def _slices(batch: pa.RecordBatch, column: str):
    """Parts of the batch with a few megabytes of text each, at least one row."""
    sizes = np.diff(np.frombuffer(batch.column(column).buffers()[1], np.int32, batch.num_rows + 1, batch.column(column).offset * 4)).astype(np.int64)
    cut = np.cumsum(sizes) // SLICE
    edges = np.r_[np.flatnonzero(np.r_[True, cut[1:] != cut[:-1]]), batch.num_rows]
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        yield batch.slice(a, b - a)


def _runs_of(h: np.ndarray, sizes: np.ndarray, window: int, hashes: WordHashes):
    """(document, start, windows, anchor occurrences, anchor, body) of every run in flat word hashes."""
    n, span = len(h), window - GRAM + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if n < window:
        return None
    gram = h[:n - GRAM + 1].copy()
    for j in range(1, GRAM):
        gram *= M1
        gram += h[j:n - GRAM + 1 + j]
    gram ^= gram >> np.uint64(31)
    gram *= M2
    gram ^= gram >> np.uint64(29)
    least, width = gram, 1
    while width * 2 <= span:
        least, width = np.minimum(least[:len(least) - width], least[width:]), width * 2
    if width < span:
        shift = span - width
        least = np.minimum(least[:len(least) - shift], least[shift:])
    windows = np.maximum(sizes - window + 1, 0)
    if not windows.sum():
        return None
    at = take_runs(np.arange(n), starts, windows)
    doc = np.repeat(np.arange(len(sizes)), windows)
    key = least[at]
    new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(at)])
    begin, anchor = at[first], key[first]
    reach = count + span - 1
    met = (take_runs(gram, begin, reach) == np.repeat(anchor, reach)).astype(np.int64)
    times = np.add.reduceat(met, np.cumsum(reach) - reach)
    body = hashes.p3.hashes(h, begin, begin + count + window - 1) + count.astype(np.uint64) * M1
    return doc[first], begin - starts[doc[first]], count, times, anchor, body


def _runs(rows: DataFrame, window: int) -> DataFrame:
    def make():
        hashes = WordHashes()

        def step(batch):
            for part in _slices(batch, "text"):
                words = [hashes.of(t.as_buffer().to_pybytes().split()) for t in part.column("text")]
                found = _runs_of(np.concatenate(words), np.array([len(w) for w in words], np.int64), window, hashes)
                if found is None:
                    continue
                doc, start, count, times, anchor, body = found
                own = pa.array(doc, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(own), part.column("text_hash").take(own), pa.array(start, pa.int32()), pa.array(count, pa.int32()), pa.array(np.minimum(times, 2), pa.int32()), pa.array(anchor.view(np.int64)), pa.array(body.view(np.int64))],
                    names=["doc_id", "text_hash", "start", "windows", "times", "anchor", "body"])

        return step

    return map_arrow(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash bigint, start int, windows int, times int, anchor bigint, body bigint")


def _variant_texts(rows: DataFrame, variants: DataFrame, window: int) -> DataFrame:
    """(anchor, body, copies, windows, words): the words of one occurrence of every variant."""
    per_doc = variants.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("anchor", "body", "copies", "windows", "start")).alias("runs"))
    per_doc = per_doc.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    joined = rows.join(per_doc.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))).select("text", "runs")

    def make():
        def step(batch):
            for part in _slices(batch, "text"):
                out = []
                for text, runs in zip(part.column("text"), part.column("runs").to_pylist()):
                    words = text.as_buffer().to_pybytes().split()
                    out += [(r["anchor"], r["body"], r["copies"], r["windows"], b" ".join(words[r["start"]:r["start"] + r["windows"] + window - 1]).decode()) for r in runs]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["anchor", "body", "copies", "windows", "words"])

        return step

    return map_arrow(joined, make, "anchor bigint, body bigint, copies bigint, windows int, words string").dropDuplicates(["anchor", "body"])


def _window_hashes(texts: list[bytes], window: int, hashes: WordHashes):
    """(text number, offset, first hash, second hash) of all windows."""
    words = [hashes.of(t.split(b" ")) for t in texts]
    h, sizes = np.concatenate(words), np.array([len(w) for w in words], np.int64)
    windows = np.maximum(sizes - window + 1, 0)
    starts = np.cumsum(sizes) - sizes
    at = take_runs(np.arange(len(h)), starts, windows)
    text = np.repeat(np.arange(len(texts)), windows)
    return text, at - starts[text], hashes.p1.hashes(h, at, at + window), hashes.p2.hashes(h, at, at + window)


def _confirmed_offsets(texts: DataFrame, window: int) -> DataFrame:
    """(anchor, body, offsets): confirmed windows of the variants that occur once."""

    def counts():
        hashes = WordHashes()

        def step(batch):
            for part in _slices(batch, "words"):
                text, _, w1, w2 = _window_hashes([t.as_buffer().to_pybytes() for t in part.column("words")], window, hashes)
                copies = part.column("copies").to_numpy()[text]
                order = np.lexsort((w2, w1))
                w1, w2, copies = w1[order], w2[order], copies[order]
                first = np.flatnonzero(np.r_[True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])
                yield pa.RecordBatch.from_arrays([pa.array(w1[first].view(np.int64)), pa.array(w2[first].view(np.int64)), pa.array(np.add.reduceat(copies, first))], names=["w1", "w2", "copies"])

        return step

    def places():
        hashes = WordHashes()

        def step(batch):
            for part in _slices(batch, "words"):
                text, offset, w1, w2 = _window_hashes([t.as_buffer().to_pybytes() for t in part.column("words")], window, hashes)
                own = pa.array(text, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), part.column("anchor").take(own), part.column("body").take(own), pa.array(offset, pa.int32())], names=["w1", "w2", "anchor", "body", "offset"])

        return step

    bytes_ = texts.withColumn("words", F.encode("words", "UTF-8"))
    met = map_arrow(bytes_.select("copies", "words"), counts, "w1 bigint, w2 bigint, copies bigint").groupBy("w1", "w2").agg(F.sum("copies").alias("copies")).where("copies > 1").select("w1", "w2")
    met = keep(met, "repeated-windows")
    single = map_arrow(bytes_.where("copies = 1").select("anchor", "body", "words"), places, "w1 bigint, w2 bigint, anchor bigint, body bigint, offset int")
    found = single.join(met, ["w1", "w2"]).select("anchor", "body", "offset")
    return found.groupBy("anchor", "body").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))


def _passages(texts: DataFrame, offsets: DataFrame, window: int) -> DataFrame:
    """(anchor, body, words, passage): every maximal confirmed passage of the variants that occur once."""

    def make():
        def step(batch):
            out: list[tuple] = []
            for anchor, body, text, at in zip(*(batch.column(c).to_pylist() for c in ("anchor", "body", "words", "offsets"))):
                words, at = text.split(" "), np.array(at)
                for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                    out.append((anchor, body, text, " ".join(words[part[0]:part[-1] + window])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["anchor", "body", "words", "passage"])

        return step

    joined = texts.where("copies = 1").select("anchor", "body", "words").join(offsets, ["anchor", "body"])
    return map_arrow(joined, make, "anchor bigint, body bigint, words string, passage string")


def _locate(passages: DataFrame, n_passages: int, per_shard: int, per_task: int) -> DataFrame:
    """(anchor, body, spans): word spans where a shard's automaton meets a passage."""
    shards = max(1, -(-n_passages // per_shard))
    placed = passages.withColumn("shard", F.pmod(F.xxhash64("passage"), F.lit(shards)).cast("int"))
    size = placed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / per_task).cast("int").alias("tasks"))
    texts = placed.select("shard", "anchor", "body", "words").distinct().join(size, "shard")
    texts = texts.select(F.col("shard").alias("of_shard"), F.pmod("body", "tasks").cast("int").alias("of_task"), "anchor", "body", F.col("words").alias("text"))
    patterns = placed.select("shard", "passage").distinct().join(size, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "passage")

    def search(patterns, texts):
        import ahocorasick
        import pandas as pd

        if not len(patterns) or not len(texts):
            return pd.DataFrame({"anchor": [], "body": [], "spans": []}, dtype=object)
        automaton = ahocorasick.Automaton()
        for passage in patterns["passage"]:
            automaton.add_word(f" {passage} ", passage.count(" ") + 1)
        automaton.make_automaton()
        spans = []
        for text in texts["text"]:
            found = []
            for end, size in automaton.iter(f" {text} "):
                last = text.count(" ", 0, max(end - 1, 0)) + 1
                found.append([last - size, last])
            spans.append(found)
        return pd.DataFrame({"anchor": texts["anchor"], "body": texts["body"], "spans": spans})

    grouped = patterns.groupBy("shard", "task").cogroup(texts.groupBy("of_shard", "of_task"))
    return grouped.applyInPandas(search, "anchor bigint, body bigint, spans array<array<int>>")


def repeated_spans(docs: DataFrame, window: int = 35, per_shard: int = 2000, per_task: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, spans): word spans [start, end) of each text that are covered by repeated windows."""
    rows = _hashed(docs, id_col, text_col)
    runs = keep(_runs(rows, window), "runs")
    again = runs.groupBy("anchor").agg(F.sum("times").alias("times")).where("times > 1").select("anchor")
    again = keep(again, "repeated-anchors")  # a plain table on this side lets AQE split a hot anchor on the other
    candidates = keep(runs.join(again, "anchor").drop("times"), "candidate-runs")
    variants = candidates.groupBy("anchor", "body").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "text_hash", "start", "windows")).alias("one")).select("anchor", "body", "copies", "one.*")
    texts = keep(_variant_texts(rows, variants, window), "variant-texts")
    passages, n = keep_counted(_passages(texts, _confirmed_offsets(texts, window), window), "passages")
    located = _locate(passages, n, per_shard, per_task).groupBy("anchor", "body").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    whole = texts.where("copies > 1").select("anchor", "body", F.array(F.array(F.lit(0), F.col("windows") + F.lit(window - 1))).alias("spans"))
    spans = keep(whole.unionByName(located), "variant-spans")
    moved = candidates.join(spans, ["anchor", "body"]).select("doc_id", "text_hash", F.transform("spans", lambda s: F.transform(s, lambda x: x + F.col("start"))).alias("spans"))
    return moved.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), F.encode("text", "UTF-8").alias("text"))


def remove_repeated(docs: DataFrame, window: int = 35, per_shard: int = 2000, per_task: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of every document."""
    rows = _hashed(docs, id_col, text_col)
    spans = keep(repeated_spans(docs, window, per_shard, per_task, id_col, text_col), "document-spans").withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    joined = rows.join(spans.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left").select("doc_id", "text", "spans")

    def make():
        def step(batch):
            for part in _slices(batch, "text"):
                sizes, removed, kept = [], [], []
                for text, found in zip(part.column("text"), part.column("spans").to_pylist()):
                    words = text.as_buffer().to_pybytes().split()
                    sizes.append(len(words))
                    if found:
                        edge = np.zeros(len(words) + 1, np.int32)
                        a, b = np.array(found).T
                        np.add.at(edge, a, 1)
                        np.add.at(edge, b, -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                    removed.append(sizes[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

        return step

    return map_arrow(joined, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept string")


def brute_force(texts: list[str | None], window: int = 35) -> list[tuple[int, int, str]]:
    """(words, words removed, digest of the rest) of each text, for tests."""
    words = [(t or "").encode().split() for t in texts]
    seen: dict[tuple, int] = {}
    for w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        left = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return out
