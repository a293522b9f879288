"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

All words of a batch lie in one flat symbol array. Each round looks up the rank of
every neighbouring pair, takes the minimum per word, merges that word's pairs of this
rank from the left, and compacts the arrays; words without a mergeable pair leave.
Several merges of a word may go in one round only while none of them creates a pair
that would have been merged before the next one, so the result is that of merging
one pair at a time. The sentencepiece library only supplies the vocabulary.

Null and empty texts have no ids and decode to the empty text. Characters outside
the vocabulary become their UTF-8 bytes. Repeated rows are encoded each for itself;
other columns of the input are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import WordTable, id_and_text, map_arrow, take_runs

SPACE = "▁"
NO_RANK = np.int32(2**31 - 1)
SEGMENT = re.compile(" *[^ ]+| +")
codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceCodec:
    """Encoder and decoder for one BPE model with byte fallback and a dummy prefix."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = self.n = sp.get_piece_size()
        piece = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        if any(SPACE in p.lstrip(SPACE) for p, ok in zip(piece, plain) if ok):
            raise ValueError("pieces that hold a space after other characters are not supported")
        ids = {p: i for i, (p, ok) in enumerate(zip(piece, plain)) if ok}
        self.byte_ids = [i for i in range(n) if sp.is_byte(i)]
        self.unk = sp.unk_id()
        self.symbol = np.arange(0x110000, dtype=np.int32) + n
        for p, i in ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        by_score = sorted({sp.get_score(i) for i in ids.values()}, reverse=True)
        place = {s: r for r, s in enumerate(by_score)}
        self.width = n + 0x110000
        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                left, right = self._symbol(ids, p[:k]), self._symbol(ids, p[k:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = i
        keys = np.array(sorted(pairs), np.int64)
        merged = np.array([pairs[k] for k in keys.tolist()], np.int32)
        self._build(keys, merged, np.array([place[sp.get_score(i)] for i in merged.tolist()], np.int32))
        raw = []
        for i, p in enumerate(piece):
            raw.append(b"" if sp.is_control(i) else bytes([self.byte_ids.index(i)]) if sp.is_byte(i) else " ⁇ ".encode() if sp.is_unknown(i) else p.replace(SPACE, " ").encode())
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_lens = np.array([len(r) for r in raw], np.int64)
        self.raw_starts = np.cumsum(self.raw_lens) - self.raw_lens
        self.words = WordTable(self.encode_words)

    def _symbol(self, ids: dict[str, int], part: str) -> int | None:
        return int(self.symbol[ord(part)]) if len(part) == 1 else ids.get(part)

    def _build(self, keys: np.ndarray, merged: np.ndarray, ranks: np.ndarray) -> None:
        """Hash table with linear probing: as many probes as the longest chain needs."""
        self.bits = max(4, int(len(keys) * 8).bit_length())
        size = 1 << self.bits
        self.keys, self.merged, self.ranks = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.full(size, NO_RANK, np.int32)
        self.probes, left = 0, np.arange(len(keys))
        home = self._home(keys)
        while len(left):
            at = (home[left] + self.probes) & (size - 1)
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[left[free]]
            own = self.keys[at] == keys[left]
            self.merged[at[own]], self.ranks[at[own]] = merged[left[own]], ranks[left[own]]
            left, self.probes = left[~own], self.probes + 1

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of symbol pairs."""
        key = left.astype(np.int64) * self.width + right
        at = self._home(key)
        found = self.keys[at]
        rank, into = np.where(found == key, self.ranks[at], NO_RANK), self.merged[at]
        open_ = np.flatnonzero((found != key) & (found >= 0))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            at = (self._home(key[open_]) + probe) & ((1 << self.bits) - 1)
            found = self.keys[at]
            own = found == key[open_]
            rank[open_[own]], into[open_[own]] = self.ranks[at[own]], self.merged[at[own]]
            open_ = open_[~own & (found >= 0)]
        return rank, into

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words (spaces as in the text), one after another, and the number of each."""
        text = "".join(words).replace(" ", SPACE)
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.symbol[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        word = np.repeat(np.arange(len(words)), size)
        done_sym, done_word = [], []
        rank = np.full(len(sym), NO_RANK, np.int32)
        into = np.zeros(len(sym), np.int32)
        self._rerank(sym, word, rank, into, np.arange(len(sym) - 1))
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, first)
            runs = np.diff(np.r_[first, len(sym)])
            over = np.repeat(best == NO_RANK, runs)
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                left = ~over
                sym, word, rank, into = sym[left], word[left], rank[left], into[left]
                runs, best = runs[best != NO_RANK], best[best != NO_RANK]
                if not len(sym):
                    break
            take = self._merges(sym, word, rank, into, np.repeat(best, runs))
            sym[take] = into[take]
            stay = np.ones(len(sym), bool)
            stay[take + 1] = False
            at = (np.cumsum(stay) - 1)[take]
            sym, word, rank, into = sym[stay], word[stay], rank[stay], into[stay]
            changed = np.zeros(len(sym) + 1, bool)
            changed[at] = changed[at - 1] = True
            self._rerank(sym, word, rank, into, np.flatnonzero(changed[:-1]))
        if not done_sym:
            return np.empty(0, np.int32), size
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return self._bytes_for_unknown(sym[order], word[order], len(words))

    def _rerank(self, sym, word, rank, into, at) -> None:
        """Look the pairs (at, at + 1) up anew."""
        rank[at] = NO_RANK
        at = at[at + 1 < len(sym)]
        at = at[word[at] == word[at + 1]]
        rank[at], into[at] = self._lookup(sym[at], sym[at + 1])

    def _merges(self, sym, word, rank, into, best) -> np.ndarray:
        """Left ends of the pairs merged in this round."""
        hit = np.flatnonzero(rank == best)
        fresh = np.r_[True, np.diff(hit) != 1]
        lead = np.flatnonzero(fresh)
        turn = np.arange(len(hit)) - np.repeat(lead, np.diff(np.r_[lead, len(hit)]))
        hit = hit[turn % 2 == 0]
        same = word[hit][1:] == word[hit][:-1]
        if not same.any():
            return hit
        several = np.r_[False, same] | np.r_[same, False]
        alone, hit = hit[~several], hit[several]
        own, r = into[hit], best[hit]
        n, beyond = len(sym), np.minimum(hit + 2, len(sym) - 1)
        right, _ = self._lookup(own, sym[beyond])
        right[(hit + 2 >= n) | (word[beyond] != word[hit])] = NO_RANK
        before = np.maximum(hit - 1, 0)
        neighbour = sym[before]
        touching = np.r_[False, hit[1:] == hit[:-1] + 2]
        neighbour[touching] = own[np.flatnonzero(touching) - 1]
        left, _ = self._lookup(neighbour, own)
        left[(hit == 0) | (word[before] != word[hit])] = NO_RANK
        sooner = (right <= r) | (left <= r)
        if sooner.any():
            earlier = np.cumsum(sooner) - sooner
            start = np.flatnonzero(np.r_[True, word[hit][1:] != word[hit][:-1]])
            base = np.repeat(earlier[start], np.diff(np.r_[start, len(hit)]))
            hit = hit[earlier == base]
        return np.sort(np.concatenate([alone, hit]))

    def _bytes_for_unknown(self, sym, word, n_words) -> tuple[np.ndarray, np.ndarray]:
        odd = np.flatnonzero(sym >= self.n)
        if len(odd):
            points = sym[odd] - self.n
            bytes_of = {p: [self.byte_ids[b] for b in chr(p).encode()] if self.byte_ids else [self.unk] for p in set(points.tolist())}
            size = np.ones(len(sym), np.int64)
            size[odd] = [len(bytes_of[p]) for p in points.tolist()]
            out = np.repeat(sym, size)
            start = (np.cumsum(size) - size)[odd]
            for s, p in zip(start.tolist(), points.tolist()):
                out[s:s + len(bytes_of[p])] = bytes_of[p]
            sym, word = out, np.repeat(word, size)
        return sym.astype(np.int32), np.bincount(word, minlength=n_words)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.words.ids([self._segments(t) for t in texts])

    @staticmethod
    def _segments(text: str) -> list[str]:
        """Words with the spaces before them; no piece crosses their edges."""
        if not text:
            return []
        return SEGMENT.findall(" " + text.replace(SPACE, " "))

    def decode(self, ids: np.ndarray) -> str:
        parts = []
        for at in range(0, len(ids), 1 << 18):
            some = ids[at:at + (1 << 18)]
            parts.append(take_runs(self.raw, self.raw_starts[some], self.raw_lens[some]).tobytes())
        raw = b"".join(parts)
        if raw[:1] == b" " and ids[0] != self.unk:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return raw.decode(errors="each_byte")


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """One codec per worker and model."""
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


OUTPUTS = {"n_tokens": "bigint", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """doc_id and the named ``outputs`` of every document: ids, the text decoded from them, their digests."""
    df = id_and_text(docs, id_col, text_col)
    id_type = df.schema["doc_id"].dataType.simpleString()

    def make():
        model = codec(model_file)

        def step(batch):
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids = model.encode(part.column("text").to_pylist())
                made = [part.column("doc_id")]
                decoded = [model.decode(x) for x in ids] if any(o.startswith("decoded") for o in outputs) else None
                for name in outputs:
                    if name == "n_tokens":
                        made.append(pa.array([len(x) for x in ids], pa.int64()))
                    elif name == "ids":
                        made.append(pa.array(ids, pa.list_(pa.int32())))
                    elif name == "decoded":
                        made.append(pa.array(decoded, pa.string()))
                    elif name == "ids_sha256":
                        made.append(pa.array([hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in ids], pa.string()))
                    else:
                        made.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()))
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", *outputs])

        return step

    return map_arrow(df, make, f"doc_id {id_type}, " + ", ".join(f"{o} {OUTPUTS[o]}" for o in outputs))
