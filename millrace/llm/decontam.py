"""Benchmark passages in training documents, found with suffix arrays.

Documents are the training side: every task lays the words of its documents one after
another and builds suffix arrays over shards of at most ``shard_words`` suffixes. The
words of the benchmark items are numbered; a word that no item holds is a stop that no
match can cross, and suffixes that begin with a stop are left out. An array is sorted by
as many words as a window has: the first sort takes all words that fit into 63 bits, and
prefix doubling orders the ties. Every item suffix that begins a window is binary
searched in every shard. The range found lists all its places, and windows that follow
each other in both texts chain into the longest verbatim matches.

A window is ``window`` consecutive words of an item; an item of fewer words, but not
none, is one window. Words are maximal runs of ASCII letters and digits and of all
characters beyond ASCII, with A-Z lower-cased. Null texts have no words. A null item_id
counts as the empty string, rows of one item_id are one item with several texts. Each
document row is judged for itself, also with a repeated or null id. No word is dropped:
long texts are tokenised in pieces and their suffixes lie in several shards that overlap
by a window.

Items are sent to the tasks in blocks of about ``block_bytes`` of text: the number of
blocks follows from the size of the benchmark, and with several blocks the documents
pass once per block. No row is shuffled.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import byte_slices, keep, map_arrow, take_runs, word_lists

MARK = b"\x01"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MATCH = "array<struct<item_id:string,item_start:int,doc_start:int,length:int>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class ItemWindows:
    """The distinct windows of a block of items, as rows of word numbers, and their places."""

    def __init__(self, item_ids: list[str | None], texts: list[str | None], window: int):
        names = ["" if i is None else str(i) for i in item_ids]
        self.items = sorted(set(names))
        number = {name: i for i, name in enumerate(self.items)}
        self.codes: dict[bytes, int] = {}
        windows: dict[tuple, int] = {}
        places = []
        for name, text in zip(names, texts):
            coded = [self.codes.setdefault(w, len(self.codes) + 1) for w in words_of(text)]
            for start in range(max(1, len(coded) - window + 1) if coded else 0):
                of = windows.setdefault(tuple(coded[start:start + window]), len(windows))
                places.append((of, number[name], start))
        self.width = window
        self.lens = np.array([len(w) for w in windows], np.int64)
        self.words = np.zeros((len(windows), window), np.int32)
        for row, w in enumerate(windows):
            self.words[row, :len(w)] = w
        at = np.array(sorted(set(places)), np.int64).reshape(-1, 3)
        self.place_item, self.place_start = at[:, 1], at[:, 2]
        self.place_from = np.searchsorted(at[:, 0], np.arange(len(windows) + 1))


def suffix_array(words: np.ndarray, n: int, depth: int, largest: int) -> np.ndarray:
    """Starts below ``n`` of the suffixes that begin with an item word, sorted by their first ``depth`` words."""
    bits = max(1, int(largest).bit_length())
    at_once = max(1, 63 // bits)
    padded = np.concatenate([words, np.zeros(at_once, words.dtype)]).astype(np.int64)
    key = np.zeros(len(words), np.int64)
    for j in range(at_once):
        key <<= bits
        key |= padded[j:j + len(words)]
    every = np.flatnonzero(words)  # suffixes beyond n only rank the ties
    order = np.argsort(key[every])
    array, key = every[order], key[every[order]]
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.empty(0, bool)
    rank = np.zeros(len(words) + 1, np.int64)  # place of the first equal suffix, from 1; 0 at stops
    rank[array] = np.repeat(np.flatnonzero(new), np.diff(np.r_[np.flatnonzero(new), len(key)])) + 1
    done = at_once
    while done < depth:
        tied = np.flatnonzero(~new | np.r_[~new[1:], False])
        if not len(tied):
            break
        own = array[tied]
        pair = rank[own] << 32 | rank[np.minimum(own + done, len(words))]
        order = np.argsort(pair)
        own, pair = own[order], pair[order]
        array[tied] = own
        fresh = np.r_[True, pair[1:] != pair[:-1]]
        new[tied] = fresh
        first = np.flatnonzero(fresh)
        rank[own] = np.repeat(tied[first], np.diff(np.r_[first, len(own)])) + 1
        done *= 2
    return array[array < n]


def _bound(words: np.ndarray, array: np.ndarray, windows: np.ndarray, lens: np.ndarray, after: bool) -> np.ndarray:
    """Number of suffixes that are smaller than each window or, if ``after``, begin with it as well."""
    low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(array), np.int64)
    span = np.arange(windows.shape[1])
    within = span[None, :] < lens[:, None]
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        suffix = words[array[middle][:, None] + span]
        differ = (suffix != windows[open_]) & within[open_]
        where = differ.argmax(axis=1)
        row = np.arange(len(open_))
        less = differ[row, where] & (suffix[row, where] < windows[open_][row, where])
        go = less | (~differ.any(axis=1) if after else False)
        low[open_[go]] = middle[go] + 1
        high[open_[~go]] = middle[~go]


def search(words: np.ndarray, items: ItemWindows, shard_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of every occurrence of an item window in the word numbers (0 is a stop)."""
    found_window, found_start = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a in range(0, len(words) if len(items.lens) else 0, shard_words):
        n = min(shard_words, len(words) - a)
        shard = np.zeros(n + 2 * items.width, np.int32)
        seen = words[a:a + n + items.width]
        shard[:len(seen)] = seen
        array = suffix_array(shard[:n + items.width], n, items.width, len(items.codes))
        first = _bound(shard, array, items.words, items.lens, False)
        last = _bound(shard, array, items.words, items.lens, True)
        found_window.append(np.repeat(np.arange(len(first)), last - first))
        found_start.append(take_runs(array, first, last - first) + a)
    return np.concatenate(found_window), np.concatenate(found_start)


def _coded(raw: bytes, codes: dict[bytes, int]) -> np.ndarray:
    parts = [np.fromiter(map(codes.get, words, repeat(0)), np.int32, len(words)) for words in word_lists(raw)]
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


def _ranges(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    step = np.diff(np.r_[False, covered, False].astype(np.int8))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _merged(old: list[int], new: list[int]) -> list[int]:
    """Union of two lists start, end, start, end ... of word ranges."""
    out: list[int] = []
    for a, b in sorted(zip(old[::2] + new[::2], old[1::2] + new[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _per_document(owner: np.ndarray, n: int, values: list) -> list[list]:
    """Values of each of ``n`` documents; ``owner`` is sorted."""
    edge = np.searchsorted(owner, np.arange(n + 1)).tolist()
    return [values[a:b] for a, b in zip(edge, edge[1:])]


def _matches(items: ItemWindows, window: np.ndarray, at: np.ndarray, doc: np.ndarray, first: np.ndarray, n: int) -> list[list[dict]]:
    """The longest verbatim matches of each document."""
    times = np.diff(items.place_from)[window]
    place = take_runs(np.arange(len(items.place_item)), items.place_from[window], times)
    item, start = items.place_item[place], items.place_start[place]
    at, doc, size = (np.repeat(x, times) for x in (at, doc, items.lens[window]))
    order = np.lexsort((at, at - start, item, doc))
    item, start, at, doc, size = (x[order] for x in (item, start, at, doc, size))
    chained = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (at[1:] == at[:-1] + 1) & (start[1:] == start[:-1] + 1)
    begin = np.flatnonzero(np.r_[True, ~chained]) if len(at) else np.empty(0, np.int64)
    length = np.diff(np.r_[begin, len(at)]) - 1 + size[begin]
    rows = [{"item_id": items.items[i], "item_start": s, "doc_start": p, "length": x} for i, s, p, x in zip(item[begin].tolist(), start[begin].tolist(), (at[begin] - first[doc[begin]]).tolist(), length.tolist())]
    return _per_document(doc[begin], n, rows)


def _pass(rows: DataFrame, items: ItemWindows, shard_words: int, slice_bytes: int, matches: bool, last: bool) -> DataFrame:
    """``rows`` (row, text, n_words, hit, items, matches) after a search for one block of items."""
    shared = rows.sparkSession.sparkContext.broadcast(items)
    columns = [c for c in rows.columns if not (last and c == "text")]
    plain = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns]

    def make():
        items = shared.value
        codes = items.codes | {MARK: -1}

        def step(batch):
            for part in byte_slices(batch, "text", slice_bytes):
                texts = [t.as_buffer().to_pybytes().translate(_TABLE) for t in part.column("text")]
                words = _coded((b" " + MARK + b" ").join([*texts, b""]), codes)
                mark = np.flatnonzero(words < 0)
                words[mark] = 0
                first = np.r_[0, mark[:-1] + 1]
                window, at = search(words, items, shard_words)
                doc = np.searchsorted(mark, at)
                edge = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + items.lens[window], minlength=len(words) + 1)
                begin, end = _ranges(np.cumsum(edge[:-1]) > 0)
                of = np.searchsorted(mark, begin)
                hit = _per_document(of, len(mark), np.c_[begin - first[of], end - first[of]].tolist())
                pair = np.unique(doc * len(items.lens) + window)
                pair_doc, pair_window = np.divmod(pair, max(len(items.lens), 1))
                times = np.diff(items.place_from)[pair_window]
                held = np.unique(np.repeat(pair_doc, times) * len(items.items) + take_runs(items.place_item, items.place_from[pair_window], times))
                held_doc, held_item = np.divmod(held, max(len(items.items), 1))
                held_items = _per_document(held_doc, len(mark), [items.items[i] for i in held_item.tolist()])
                made = {"n_words": pa.array(mark - first, pa.int64())}
                new = {"hit": [[x for pair in h for x in pair] for h in hit], "items": held_items}
                new["matches"] = _matches(items, window, at, doc, first, len(mark)) if matches else [[]] * len(mark)
                for name, values in new.items():
                    kind = part.schema.field(name).type
                    before = part.column(name).to_pylist()
                    joined = [_merged(b, v) if name == "hit" else sorted({*b, *v}) if name == "items" else b + v for b, v in zip(before, values)]
                    made[name] = pa.array(joined, kind)
                yield pa.RecordBatch.from_arrays([made.get(c, part.column(c)) for c in columns], names=columns)

        return step

    return map_arrow(rows, make, ", ".join(plain))


def screen(docs: DataFrame, benchmark: DataFrame, window: int = 10, matches: bool = True, shard_words: int = 1 << 21, block_bytes: int = 16 << 20, slice_bytes: int = 8 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: ``row`` (its columns as a struct), n_words, hit, items, matches.

    hit: word ranges start, end, start, end ... inside occurrences of item windows; items:
    sorted ids of the items with such windows; matches: the longest verbatim matches of
    at least a window with their places in item and document (empty if not asked for).
    """
    tests = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    none = lambda kind: F.array().cast(kind)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.lit(0).cast("bigint").alias("n_words"), none("array<int>").alias("hit"), none("array<string>").alias("items"), none(MATCH).alias("matches"))
    for block in range(blocks):
        own = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toPandas()  # about block_bytes of text
        items = ItemWindows(own["item_id"].tolist(), own["text"].tolist(), window)
        rows = _pass(rows, items, shard_words, slice_bytes, matches, block == blocks - 1)
        if block < blocks - 1:
            rows = keep(rows, "screened")
    return rows


def hit_words(hit: Column) -> Column:
    """Number of words in the ranges of ``hit``."""
    signed = F.transform(hit, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(signed, F.lit(0).cast("bigint"), lambda n, x: n + x)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, **options) -> DataFrame:
    """The documents, all columns, that hold no window of a benchmark item."""
    return screen(docs, benchmark, window, matches=False, **options).where(F.size("hit") == 0).select("row.*")
