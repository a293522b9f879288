"""Quality classifier: gated attention over encoded passages.

A text is cut into passages of ``PASSAGE`` bytes; each passage is described by hashed
byte counts, hashed byte pairs and the share of distinct byte triples, and encoded by
one hidden layer. Gated attention (tanh times sigmoid) weighs the passages, and the
document score is a logistic function of the weighted mean passage. Only document
labels are used: encoder, attention and output layer are learned together.

Fitting reads at most ``max_docs`` labelled documents (those with the smallest hashed
id) and at most ``max_passages`` evenly spaced passages of each; both are parameters.
Scoring reads every passage of every document. Null and empty texts are one empty
passage. Labels that are null or not 0/1 are ignored. Without any label every score
is 0.5. Repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import id_and_text, map_arrow

PASSAGE = 512
CLASSES, PAIRS, TRIPLES = 112, 256, 1024
WIDTH = CLASSES + PAIRS + 2


def _byte_classes() -> np.ndarray:
    """Printable ASCII bytes keep a class each, other bytes share sixteen."""
    table = 96 + (np.arange(256) >> 4)
    table[32:127] = np.arange(95)
    table[10] = 95
    return table


_CLASS = _byte_classes()


def passage_features(data: bytes, at_most: int | None = None) -> np.ndarray:
    """Feature rows of the passages of one text (one row for the empty text)."""
    n = max(1, -(-len(data) // PASSAGE))
    if at_most and n > at_most:
        picked = np.linspace(0, n - 1, at_most).astype(int)
        parts = [passage_features(data[p * PASSAGE:(p + 1) * PASSAGE]) for p in picked]
        return np.concatenate(parts)
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    return _features(raw, np.arange(len(raw)) // PASSAGE, n)


def _features(raw: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
    x = np.zeros((n, WIDTH), np.float32)
    size = np.maximum(np.bincount(passage, minlength=n), 1).astype(np.float32)
    if len(raw):
        x[:, :CLASSES] = np.bincount(passage * CLASSES + _CLASS[raw], minlength=n * CLASSES).reshape(n, CLASSES)
        if len(raw) > 1:
            pair = ((raw[:-1] * 256 + raw[1:]) * 40503 >> 7) & (PAIRS - 1)
            x[:, CLASSES:CLASSES + PAIRS] = np.bincount(passage[:-1] * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS)
        x[:, :-2] = np.sqrt(x[:, :-2] / size[:, None])
        if len(raw) > 2:
            triple = ((raw[:-2] * 65536 + raw[1:-1] * 256 + raw[2:]) * 2654435761 >> 11) & (TRIPLES - 1)
            seen = np.bincount(passage[:-2] * TRIPLES + triple, minlength=n * TRIPLES).reshape(n, TRIPLES)
            x[:, -2] = (seen > 0).sum(1) / size
        x[:, -1] = np.log1p(size) / 8
    return x


def batch_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(feature rows of all passages, first row of each text)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    first = np.cumsum(counts) - counts
    raw = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    within = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return _features(raw, np.repeat(first, sizes) + within // PASSAGE, int(counts.sum())), first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    """Weights of encoder, gated attention and output layer."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.w, len(x)
        runs = np.diff(np.r_[first, n])
        h = np.maximum(x @ w["enc"] + w["enc_b"], 0)
        t, g = np.tanh(h @ w["tanh"]), _sigmoid(h @ w["gate"])
        s = (t * g) @ w["att"]
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, first), runs))
        a = e / np.repeat(np.add.reduceat(e, first), runs)
        z = np.add.reduceat(a[:, None] * h, first)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["out"] + w["out_b"])}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.scale, first)["p"].astype(np.float64)


def fit_attention(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 32, gate: int = 16, epochs: int = 25, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> AttentionModel:
    """Train on the driver with Adam; deterministic for given bags."""
    rng = np.random.default_rng(seed)
    everything = np.concatenate(bags).astype(np.float32)
    mean, scale = everything.mean(0), everything.std(0) + 0.02
    everything = (everything - mean) / scale
    sizes = np.array([len(b) for b in bags])
    start = np.cumsum(sizes) - sizes
    init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    rate_of_ones = np.clip(labels.mean(), 0.01, 0.99)
    w = {"enc": init(WIDTH, hidden), "enc_b": np.zeros(hidden, np.float32), "tanh": init(hidden, gate), "gate": init(hidden, gate),
         "att": init(gate), "out": init(hidden), "out_b": np.array(np.log(rate_of_ones / (1 - rate_of_ones)), np.float32)}
    model = AttentionModel(mean, scale, w)
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            docs = order[at:at + batch]
            first = np.cumsum(sizes[docs]) - sizes[docs]
            rows = np.repeat(start[docs] - first, sizes[docs]) + np.arange(sizes[docs].sum())
            x, y, runs = everything[rows], labels[docs], sizes[docs]
            f = model.forward(x, first)
            h, t, g, a = f["h"], f["t"], f["g"], f["a"]
            d_logit = ((f["p"] - y) / len(docs)).astype(np.float32)
            d_z = np.repeat(d_logit[:, None] * w["out"], runs, axis=0)
            d_a = (h * d_z).sum(1)
            d_s = a * (d_a - np.repeat(np.add.reduceat(a * d_a, first), runs))
            d_t = d_s[:, None] * w["att"] * g * (1 - t * t)
            d_g = d_s[:, None] * w["att"] * t * g * (1 - g)
            d_h = (a[:, None] * d_z + d_t @ w["tanh"].T + d_g @ w["gate"].T) * (h > 0)
            grad = {"out": f["z"].T @ d_logit, "out_b": d_logit.sum(), "att": (t * g).T @ d_s, "tanh": h.T @ d_t, "gate": h.T @ d_g, "enc": x.T @ d_h, "enc_b": d_h.sum(0)}
            step += 1
            now = rate * (1 - 0.9 * epoch / epochs)
            for k in w:
                d = grad[k] + decay * w[k]
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                w[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(doc_id, modulus: int = 3, part: int = 1):
    """Column: the row belongs to the part that is never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus == part


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_docs: int = 3000, max_passages: int = 32, id_col: str = "doc_id", text_col: str = "text") -> AttentionModel | None:
    """Model learned from the labelled documents outside the held-out part; None without labels."""
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))).dropDuplicates(["doc_id"])
    ids = docs.select(F.col(id_col).alias("doc_id"))
    chosen = marked.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # at most max_docs rows

    def make():
        def step(batch):
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                bags = [passage_features(t.encode(), max_passages).astype(np.float16) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.string()), part.column("label"), pa.array([b.tobytes() for b in bags], pa.binary())], names=["doc_id", "label", "bag"])

        return step

    got = sorted(map_arrow(rows.select("doc_id", "text", "label"), make, "doc_id string, label int, bag binary").collect(), key=lambda r: (r["doc_id"], bytes(r["bag"])))
    if not got:
        return None
    bags = [np.frombuffer(r["bag"], np.float16).reshape(-1, WIDTH) for r in got]
    return fit_attention(bags, np.array([r["label"] for r in got], np.float32))


def score_documents(docs: DataFrame, model: AttentionModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``quality_score`` (0 to 1, higher: label 1 likelier)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        if model is None:
            return pd.Series(np.full(len(texts), 0.5))
        out = []
        group, held = [], 0
        for t in texts:
            group.append(t.encode())
            held += len(group[-1])
            if held > 1 << 20:
                out.append(model.score(*batch_features(group)))
                group, held = [], 0
        if group:
            out.append(model.score(*batch_features(group)))
        return pd.Series(np.concatenate(out) if out else np.empty(0))

    return docs.withColumn("quality_score", scored(text))


def crc_part(doc_id: int) -> int:
    """The remainder that decides the held-out part, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 3
