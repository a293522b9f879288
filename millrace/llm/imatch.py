"""I-Match fingerprints over several randomised lexicons.

The lexicon holds the terms whose document frequency, as a share of all documents,
lies in a band (equivalently an inverse-document-frequency band). A document keeps its
distinct lexicon terms. ``per_level`` salts each give a term three random ranks of 21 bits
(fewer of more bits beyond 21 levels), and each rank a nest of lexicon subsets: level L
keeps the terms whose rank begins with more than L zero bits, half as many as level L - 1;
the levels take the three nests in turn. Every subset hashes the kept terms that it holds:
the sum of their mixed hashes, which does not depend on an order, cut to 16 bits. The
fingerprint is the row of these ``levels * per_level`` hashes, as base64 text. A document
without any lexicon term uses all its distinct terms instead; a document without terms
has an empty row.

The likeness of two fingerprints is the share of equal hashes among the subsets that
hold a term of either, over the levels at which subsets hold about one term at most of
both (at denser levels one changed term changes every hash). Equal texts always have
equal fingerprints; equal fingerprints have likeness 1.

There are so many levels that the sparsest subsets hold about one term of the lexicon, and
so of the longest document, at most; 16 at least.

The lexicon holds at most (mean distinct terms per document) / ``low`` terms whatever
the number of documents, which bounds the broadcast. Null texts are empty texts.
Documents follow one another by doc_id of any type that Spark can sort, null ids first;
rows of one id by a hash of their texts, and equal rows in any order. Other columns are
ignored.

The documents are dealt by ranges of this order. Each task closes all pairs within its
range; the last document of a range meets the first one of the next range in a join on
the range's number, so the driver holds nothing per document.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import id_and_text, keep, map_arrow

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GROUP = 400  # texts fingerprinted together


def terms_of(text: str) -> set[bytes]:
    return set(text.lower().encode().split())


def _hashes(terms: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))


class TermHashes:
    """Hashes of terms, remembered; emptied when full."""

    def __init__(self, limit: int = 600_000):
        self.limit, self.known = limit, {}

    def of(self, terms: set[bytes]) -> np.ndarray:
        import xxhash

        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        out = list(map(known.get, terms))
        if None in out:
            for i, t in enumerate(terms):
                if out[i] is None:
                    out[i] = known[t] = xxhash.xxh3_64_intdigest(t)
        return np.array(out, np.uint64)


def lexicon(docs: DataFrame, total: int, low: float, high: float) -> np.ndarray:
    """Sorted hashes of the terms found in a share between ``low`` and ``high`` of the ``total`` documents."""

    def make():
        counts: dict[int, int] = {}
        hashes = TermHashes()

        def flushed():
            yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(counts, np.uint64, len(counts)).view(np.int64)), pa.array(np.fromiter(counts.values(), np.int64, len(counts)))], names=["term", "docs"])
            counts.clear()

        def step(batch):
            for at in range(0, batch.num_rows, 200):
                found = [hashes.of(terms_of(t)) for t in batch.column("text").slice(at, 200).to_pylist()]
                values, n = np.unique(np.concatenate(found), return_counts=True)
                for v, c in zip(values.tolist(), n.tolist()):
                    counts[v] = counts.get(v, 0) + c
                if len(counts) > 500_000:
                    yield from flushed()

        def close():
            if counts:
                yield from flushed()

        step.close = close
        return step

    parts = map_arrow(docs.select("text"), make, "term bigint, docs bigint")
    found = parts.groupBy("term").agg(F.sum("docs").alias("docs")).where((F.col("docs") >= low * total) & (F.col("docs") <= high * total))
    terms = keep(found.select("term"), "lexicon").toArrow()["term"].to_numpy()  # at most mean terms per document / low
    return np.sort(terms.view(np.uint64))


def levels_for(terms: int) -> int:
    """Levels after which a subset holds at most about one of ``terms`` lexicon terms."""
    return max(16, (max(terms, 1) - 1).bit_length())


@dataclass
class Fingerprinter:
    """Hash rows of texts for one lexicon."""

    lexicon: np.ndarray
    levels: int | None = None
    per_level: int = 12
    seed: int = 11
    at_once: int = 2_000_000  # terms that are ranked together

    def __post_init__(self):
        self.levels = self.levels or levels_for(len(self.lexicon))
        self.salts = np.random.default_rng(self.seed).integers(0, 2**63, (self.per_level, 2), dtype=np.uint64) | np.uint64(1)
        self.hashes = TermHashes()

    def _kept(self, text: str) -> np.ndarray:
        every = self.hashes.of(terms_of(text))
        if not len(every) or not len(self.lexicon):
            return every
        at = np.minimum(np.searchsorted(self.lexicon, every), len(self.lexicon) - 1)
        kept = every[self.lexicon[at] == every]
        return kept if len(kept) else every

    def rows(self, texts: list[str]) -> np.ndarray:
        """(text, level, rank) 16-bit hashes; 0 where the subset holds no term."""
        kept = [self._kept(t) for t in texts]
        terms = np.concatenate([np.empty(0, np.uint64), *kept])
        owner = np.repeat(np.arange(len(texts)), [len(k) for k in kept])
        width = self.levels + 1
        out = np.zeros((len(texts), self.levels, self.per_level), np.uint16)
        bits = max(21, self.levels)  # of a rank
        nests = 64 // bits
        for j, (salt, other) in enumerate(self.salts):
            sums, counts = np.zeros((nests, len(texts) * width)), np.zeros((nests, len(texts) * width), np.int64)
            for at in range(0, len(terms), self.at_once):
                rank = terms[at:at + self.at_once] * salt
                rank = (rank ^ (rank >> np.uint64(29))) * M1
                rank = (rank ^ (rank >> np.uint64(32))) * M2
                rank ^= rank >> np.uint64(30)
                value = ((rank * other) >> np.uint64(32)).astype(np.float64)  # sums of 32-bit values are exact in a double
                base = owner[at:at + self.at_once] * width
                for nest in range(nests):
                    own = rank >> np.uint64(bits * nest) & np.uint64((1 << bits) - 1)
                    # leading zeros of the rank: how many levels hold the term
                    key = base + np.minimum(bits - np.frexp(own.astype(np.float64))[1], self.levels)
                    sums[nest] += np.bincount(key, weights=value, minlength=sums.shape[1])
                    counts[nest] += np.bincount(key, minlength=sums.shape[1])
            # level L holds the terms with more than L leading zeros in the rank of its nest
            within = np.cumsum(sums.reshape(nests, -1, width)[:, :, :0:-1], axis=2)[:, :, ::-1]
            some = np.cumsum(counts.reshape(nests, -1, width)[:, :, :0:-1], axis=2)[:, :, ::-1] > 0
            level = np.arange(self.levels)
            within, some = within[level % nests, :, level].T, some[level % nests, :, level].T
            mixed = (within.astype(np.uint64) + np.uint64(1)) * M2
            mixed = ((mixed ^ (mixed >> np.uint64(31))) * M1) >> np.uint64(48)
            out[:, :, j] = np.where(some, np.maximum(mixed, np.uint64(1)), np.uint64(0))
        return out

    def row(self, text: str) -> bytes:
        return self.rows([text])[0].tobytes()

    def likenesses(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Likeness of each row of ``one`` to the row of ``other`` beside it."""
        either = (one > 0) | (other > 0)
        filled = np.maximum((one > 0).mean(axis=2), (other > 0).mean(axis=2))
        sparse = filled <= 0.65
        sparse[:, -1] = True
        used = either & sparse[:, :, None]
        n = used.sum(axis=(1, 2))
        same = ((one == other) & used).sum(axis=(1, 2))
        return np.where((one == other).all(axis=(1, 2)), 1.0, np.divide(same, n, out=np.zeros(len(n)), where=n > 0))

    def likeness(self, one: bytes, other: bytes) -> float:
        a, b = (np.frombuffer(x, np.uint16).reshape(1, self.levels, self.per_level) for x in (one, other))
        return float(self.likenesses(a, b)[0])


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the start of ``following``."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _pairs(maker: Fingerprinter, ids: pa.Array, texts: list[str], following: list[str], rows: np.ndarray, following_rows: np.ndarray) -> list[pa.Array]:
    """The columns NAMES for documents and the documents after them."""
    changed = [edited(t, f) for t, f in zip(texts, following)]
    changed_rows = maker.rows(changed)
    text = lambda a: [base64.b64encode(x.tobytes()).decode() for x in a]
    return [
        ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
        pa.array(text(rows), pa.string()), pa.array(text(changed_rows), pa.string()),
        pa.array(maker.likenesses(rows, changed_rows)), pa.array(maker.likenesses(rows, following_rows))]


def fingerprint_pairs(docs: DataFrame, low: float = 0.0002, high: float = 0.05, levels: int | None = None, per_level: int = 12, rows_per_part: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next. A range holds about ``rows_per_part`` documents.
    """
    rows = id_and_text(docs, id_col, text_col)
    total = rows.count()
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(rows, total, low, high))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    made = f"doc_id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    # the row number only parts equal rows, so that no range has to hold all of them
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.monotonically_increasing_id().asc()]
    dealt = rows.repartitionByRange(max(1, -(-total // rows_per_part)), *order).sortWithinPartitions(*order)
    names = [*NAMES, "part", "edge", "text"]

    def make():
        maker = Fingerprinter(shared.value, levels, per_level)
        part = TaskContext.get().partitionId()
        last: list = [None]  # (id array, text, row) of the last document

        def out(columns, edge=None, text=None):
            n = len(columns[0])
            return pa.RecordBatch.from_arrays([*columns, pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.string()), pa.array([text] * n, pa.string())], names=names)

        def edge_row(ids, text, kind):
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            return out([ids, *none], kind, text)

        def step(batch):
            for at in range(0, batch.num_rows, GROUP):
                some = batch.slice(at, GROUP)
                ids, texts = some.column("doc_id"), some.column("text").to_pylist()
                found = maker.rows(texts)
                if last[0] is None:
                    yield edge_row(ids[:1], texts[0], "first")
                else:
                    ids, texts, found = pa.concat_arrays([last[0][0], ids]), [last[0][1], *texts], np.concatenate([last[0][2], found])
                if len(texts) > 1:
                    yield out(_pairs(maker, ids[:-1], texts[:-1], texts[1:], found[:-1], found[1:]))
                last[0] = ids[-1:], texts[-1], found[-1:]

        def close():
            if last[0] is not None:
                yield edge_row(last[0][0], last[0][1], "last")

        step.close = close
        return step

    inner = keep(map_arrow(dealt, make, f"{made}, part int, edge string, text string"), "fingerprints")
    first = inner.where("edge = 'first'").select("part", "text")  # one row per range
    after = Window.orderBy("part")
    following = first.select("part", F.lead("part").over(after).alias("next"), F.min("part").over(Window.partitionBy()).alias("least")).select("part", F.coalesce("next", "least").alias("next"))
    pairs = inner.where("edge = 'last'").select("doc_id", "part", F.col("text")).join(following, "part").join(first.select(F.col("part").alias("next"), F.col("text").alias("following")), "next")

    def close_ranges():
        maker = Fingerprinter(shared.value, levels, per_level)

        def step(batch):
            texts, following = batch.column("text").to_pylist(), batch.column("following").to_pylist()
            yield pa.RecordBatch.from_arrays(_pairs(maker, batch.column("doc_id"), texts, following, maker.rows(texts), maker.rows(following)), names=NAMES)

        return step

    closed = map_arrow(pairs.select("doc_id", "text", "following"), close_ranges, made)
    return inner.where("edge IS NULL").select(*NAMES).unionByName(closed)
