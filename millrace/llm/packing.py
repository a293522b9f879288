"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each input partition is packed as a stream of its own: a document is its token ids
and one end id; full windows are cut off first, and the rest is placed into the
partially filled window whose level makes the sum of squared counts of partial
windows smallest (ties: the fullest level; a new window counts as level 0). A level
array holds the counts. When the stream ends, or when more than ``max_open`` windows
are partial, the partial windows are dissolved from the emptiest on and cut to fill
the fullest, so at most one window per partition keeps padding.

No shuffle takes place: a window never holds documents of two partitions. A retried
task reads the same rows in the same order and so repeats its result. Null and empty
texts are one end id. Repeated rows are packed each for itself. An empty table gives
no pieces. Of other columns only the id is kept.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from millrace.llm.common import WordTable, id_and_text, map_arrow

SPAN = 1 << 33
EDGE_SPACE = re.compile(r"(?<=\S) (?=\S)")
TWO_SPACES = re.compile(r"\s\s")
INNER_SPACE = re.compile(r"\s(?<!^ )|^ (?!\S)")


class WindowPacker:
    """Places pieces of at most ``capacity`` ids; yields (window, key, start, length, offset)."""

    def __init__(self, capacity: int, max_open: int = 4096):
        self.capacity, self.max_open = capacity, max_open
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[tuple[int, list]]] = defaultdict(list)
        self.n_open, self.next = 0, 0

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def _level_for(self, size: int) -> int:
        """Level whose use makes the sum of squared counts smallest; 0 is a new window."""
        c, n = self.capacity, self.counts
        if size == c:
            return 0
        top = c - size
        grown = 2 * n[size:c] + 1
        change = np.empty(top + 1, np.int64)
        change[0] = grown[0]
        change[1:top] = 2 - 2 * n[1:top] + 2 * n[size + 1:c] if top > 1 else 0
        change[top] = 1 - 2 * n[top]
        change[1:][n[1:top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def place(self, key, start: int, length: int) -> Iterator[tuple]:
        """Place one document; yields the pieces of the windows this fills."""
        c = self.capacity
        whole = length - length % c
        for at in range(0, whole, c):
            yield self._new(), key, start + at, c, 0
        size = length - whole
        if not size:
            return
        level = self._level_for(size)
        if level:
            window, pieces = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        else:
            window, pieces = self._new(), []
        pieces.append((key, start + whole, size))
        yield from self._put(window, pieces, level + size)
        if self.n_open > self.max_open:
            yield from self.drain(last=False)

    def _put(self, window: int, pieces: list, level: int) -> Iterator[tuple]:
        if level == self.capacity:
            yield from self._closed(window, pieces)
        else:
            self.open[level].append((window, pieces))
            self.counts[level] += 1
            self.n_open += 1

    @staticmethod
    def _closed(window: int, pieces: list) -> Iterator[tuple]:
        offset = 0
        for key, start, length in pieces:
            yield window, key, start, length, offset
            offset += length

    def drain(self, last: bool = True) -> Iterator[tuple]:
        """Cut the emptiest partial windows to fill the fullest; one partial window is left."""
        left = [(level, w, p) for level in sorted(self.open, reverse=True) for w, p in self.open[level]]
        self.open.clear()
        self.counts[:] = 0
        self.n_open = 0
        lo, hi = 0, len(left) - 1
        while lo < hi:
            level, window, pieces = left[lo]
            gap = self.capacity - level
            while gap and hi > lo:
                donor = left[hi][2]
                key, start, length = donor.pop()
                cut = min(gap, length)
                pieces.append((key, start + length - cut, cut))
                if cut < length:
                    donor.append((key, start, length - cut))
                gap -= cut
                if not donor:
                    hi -= 1
            if gap:
                left[lo] = (self.capacity - gap, window, pieces)
                break
            yield from self._closed(window, pieces)
            lo += 1
        if lo <= hi:
            _, window, pieces = left[lo]
            if last:
                yield from self._closed(window, pieces)
            else:
                yield from self._put(window, pieces, sum(p[2] for p in pieces))


#: Fixed value: the public pre-tokenizer pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Ids of a byte-level BPE vocabulary file; each word between single spaces is encoded once per worker.

    The pre-tokenizer always starts a new token at a single space between two other
    characters, so cutting there changes no id. Unknown words are merged by tiktoken
    with the file's vocabulary, which gives the ids of the tokenizers library at a quarter
    of its cost per new word. The file's added tokens are cut out of the text first and
    give their ids; the parts between are texts of their own.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        vocabulary, added = content["model"]["vocab"], content.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] and content.get("normalizer") for t in added):
            raise ValueError(f"{path}: added tokens match more than their own text")
        self.added = {t["content"]: np.array([t["id"]], np.int32) for t in added}
        longest_first = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.cut_added = re.compile(f"({'|'.join(longest_first)})") if self.added else None
        letters = _byte_letters()
        ranks = {bytes(map(letters.__getitem__, token)): i for token, i in vocabulary.items() if all(c in letters for c in token)}
        special = [i for token, i in vocabulary.items() if token.startswith("<|")]
        ranks = {t: i for t, i in ranks.items() if i not in special}
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.line = ranks[b"\n"]
        self.words = WordTable(self._encode)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words without white space are encoded in one go, parted by line ends; others one by one."""
        texts = [w[1:] if w[0] == " " else " " + w for w in words]
        simple = [i for i, t in enumerate(texts) if not INNER_SPACE.search(t)]
        ids = np.array(self.encoding.encode_ordinary("\n".join([texts[i] for i in simple]) + "\n"), np.int32)
        sizes = np.zeros(len(texts), np.int64)
        sizes[simple] = np.diff(np.r_[-1, np.flatnonzero(ids == self.line)])[:len(simple)] - 1
        if len(simple) == len(texts):
            return ids[ids != self.line], sizes
        odd = {i: self.encoding.encode_ordinary(texts[i]) for i in set(range(len(texts))).difference(simple)}
        for i, x in odd.items():
            sizes[i] = len(x)
        owner = np.repeat(np.arange(len(texts)), sizes)
        out = np.empty(len(owner), np.int32)
        plain = np.zeros(len(texts), bool)
        plain[simple] = True
        out[plain[owner]] = ids[ids != self.line]
        out[~plain[owner]] = list(chain.from_iterable(odd[i] for i in sorted(odd)))
        return out, sizes

    @staticmethod
    def _cut(text: str) -> list[str]:
        """Parts of the text: those that follow a space bare, all others behind one space."""
        if not text:
            return []
        if not TWO_SPACES.search(text) and text[0] != " " and text[-1] != " ":
            words = text.split(" ")
            words[0] = " " + words[0]
            return words
        edges = [0, *(m.start() for m in EDGE_SPACE.finditer(text)), len(text)]
        return [" " + text[a:b] for a, b in zip(edges, edges[1:]) if a < b]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.cut_added:
            return self.words.ids([self._cut(t) for t in texts])
        split = [self.cut_added.split(t) for t in texts]  # every second part is an added token
        plain = iter(self.words.ids([self._cut(t) for parts in split for t in parts[::2]]))
        return [next(plain) if len(parts) == 1 else np.concatenate([self.added[t] if i % 2 else next(plain) for i, t in enumerate(parts)]) for parts in split]


_models: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    if path not in _models:
        _models[path] = ByteBpe(path)
    return _models[path]


COLUMNS = {"ids": "array<int>", "ids_crc32": "bigint"}


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids",), max_open: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and ``outputs``.

    ``outputs``: ids (the token ids), ids_crc32 (of them as little-endian 32-bit words).
    Sequence ids are unique: partition number times 2**33 plus the window's number there.
    """
    df = id_and_text(docs, id_col, text_col)
    id_type = df.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", *outputs, "doc_tokens", "sequence_id", "offset"]

    def make():
        base = TaskContext.get().partitionId() * SPAN
        model, packer = byte_bpe(tokenizer_file), WindowPacker(capacity, max_open)
        seen: dict[int, list] = {}  # row: [doc_id, ids, ids not yet given out]
        count = [0]

        def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
            cols: dict[str, list] = {n: [] for n in names}
            for window, key, start, length, offset in pieces:
                row = seen[key]
                ids = row[1][start:start + length]
                row[2] -= length
                if not row[2]:
                    del seen[key]
                for name, value in (("doc_id", row[0]), ("start", start), ("length", length), ("doc_tokens", len(row[1])), ("sequence_id", base + window), ("offset", offset)):
                    cols[name].append(value)
                if "ids" in cols:
                    cols["ids"].append(ids)
                if "ids_crc32" in cols:
                    cols["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
            types = {"doc_id": id_arrow[0], "ids": pa.list_(pa.int32())}
            return pa.RecordBatch.from_arrays([pa.array(cols[n], types.get(n, pa.int64())) for n in names], names=names)

        id_arrow = [pa.int64()]

        def step(batch):
            id_arrow[0] = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                pieces = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), model.encode(part.column("text").to_pylist())):
                    key = count[0]
                    count[0] += 1
                    seen[key] = [doc_id, np.append(ids, np.int32(end_id)), len(ids) + 1]
                    pieces.extend(packer.place(key, 0, len(ids) + 1))
                yield batch_of(pieces)

        def close():
            yield batch_of(list(packer.drain()))

        step.close = close
        return step

    types = {"doc_id": id_type, **COLUMNS}
    return map_arrow(df, make, ", ".join(f"{n} {types.get(n, 'bigint')}" for n in names))
