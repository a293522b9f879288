"""Shared helpers: tables, Arrow mapping, scratch tables that go away, word tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import materialize_counted


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) under fixed names; a null text is the empty text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: str) -> DataFrame:
    """``make`` builds one step function per task; the step maps each batch to batches.

    The step may have a ``close`` attribute, called after the last batch.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)
        close = getattr(step, "close", None)
        if close:
            yield from close()

    return df.mapInArrow(run, schema)


def keep(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder; its shuffle files are removed at once."""
    return keep_counted(df, label)[0]


def keep_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """:func:`keep` and the number of rows."""
    return materialize_counted(df, label, codec="snappy")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTable:
    """Ids of the words met so far, as flat arrays; words new in a batch are encoded together.

    The table is emptied when it holds ``limit`` words, so a worker's memory stays bounded.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 600_000):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 20, np.int32), 0
        self.starts, self.lens = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int64)

    @staticmethod
    def _room(a: np.ndarray, used: int, more: int) -> np.ndarray:
        if used + more <= len(a):
            return a
        out = np.empty(max(2 * len(a), used + more), a.dtype)
        out[:used] = a[:used]
        return out

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 50_000):
            part = new[at:at + 50_000]
            flat, lens = self.encode(part)
            n = len(self.codes)
            self.flat = self._room(self.flat, self.used, len(flat))
            self.starts, self.lens = self._room(self.starts, n, len(part)), self._room(self.lens, n, len(part))
            self.flat[self.used:self.used + len(flat)] = flat
            self.lens[n:n + len(part)] = lens
            self.starts[n:n + len(part)] = self.used + np.cumsum(lens) - lens
            self.used += len(flat)
            self.codes.update(zip(part, range(n, n + len(part))))

    def ids(self, split: list[list[str]]) -> list[np.ndarray]:
        """Ids of each list of words, one array per list."""
        if len(self.codes) >= self.limit:
            self._clear()
        get = self.codes.get
        coded = [list(map(get, words)) for words in split]
        gaps = [(words, codes, [i for i, c in enumerate(codes) if c is None]) for words, codes in zip(split, coded) if None in codes]
        self._learn(list({words[i] for words, _, at in gaps for i in at}))
        for words, codes, at in gaps:
            for i in at:
                codes[i] = get(words[i])
        out = []
        for codes in coded:
            at = np.array(codes, np.int64)
            out.append(take_runs(self.flat, self.starts[at], self.lens[at]))
        return out


def take_runs(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The runs ``flat[start:start+len]`` one after another."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lens), lens)]



def byte_slices(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about ``size`` bytes of the text column each, at least one row."""
    texts = batch.column(column)
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32, batch.num_rows + 1, texts.offset * 4)).astype(np.int64)
    cut = np.cumsum(sizes) // size
    edges = np.r_[np.flatnonzero(np.r_[True, cut[1:] != cut[:-1]]), batch.num_rows]
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        yield batch.slice(a, b - a)


def word_lists(raw: bytes, size: int = 8 << 20) -> Iterator[list[bytes]]:
    """The words of ``raw``, cut at ASCII white space, in lists of about ``size`` bytes."""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + size) if at + size < len(raw) else -1
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end
