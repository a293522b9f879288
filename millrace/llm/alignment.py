"""Alignment of the tokens of two tokenizers over the same bytes.

Tokenizer A (tokenizers, byte-level BPE) encodes a space and the text, tokenizer B
(sentencepiece, BPE) the text, to which it adds that space. Token spans come from the
character offsets of tokenizers and the spans of sentencepiece's proto. They are coarse
cuts: a run of tokens that share a character (a character split over several byte-level
tokens, or spelled with byte-fallback tokens) has one span; inside it the ends follow
from the decoded bytes of its tokens. All decoded bytes are compared with the text.

Where tokens of A and B both end, a group ends. A link is a pair of an A token and a B
token whose byte ranges overlap. The count of an id pair is the number of documents of
the corpus that hold it linked.

Texts are cut into units at places that neither tokenizer can cross, and a unit is
encoded and aligned once while it stays in the worker's table (``table_units``): before
a space that follows another character than a space and stands before no white space,
between a letter and a mark that never share a piece, and around a single line end. New
units are encoded together, parted by line ends; units with other white space one by one.

Null and empty texts, and texts whose decoded bytes differ from the space and the text
for either tokenizer (for example those that hold U+2581), have no tokens: zeros and an
empty group string. Every row is a document of its own. Other columns are ignored. A
long text is aligned in parts cut between units, so memory is bounded by its distinct
id pairs.

Counts of id pairs are looked up in the tasks while there are at most ``max_pairs``
(13 bytes each); beyond that the pairs of the documents are joined with the counts by a
shuffle.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import byte_slices, id_and_text, keep, keep_counted, map_arrow, take_runs

SPACE = "▁"
MARKS = ".,;:!?"
PART = 2 << 20  # characters of a long text that are aligned at once


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, lengths) of byte strings."""
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes


def refined_ends(first: np.ndarray, last: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Byte ends of tokens with coarse byte spans [first, last) and ``size`` decoded bytes.

    Tokens that share a character, or have an empty span before it, form a run whose ends
    follow from the sizes; any other token is a run of its own.
    """
    if not len(first):
        return first
    reach = np.maximum.accumulate(np.r_[0, last[:-1]])
    after_empty = np.r_[False, last[:-1] <= first[:-1]]
    new = (first >= reach) & ~after_empty
    new[0] = True
    lead = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    total = np.cumsum(size)
    return first[lead][run] + total - (total - size)[lead][run]


class Aligner:
    """Units of texts with the ids, groups and links of two tokenizers."""

    def __init__(self, byte_file: str, piece_file: str, limit: int = 700_000):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        letters = byte_letters()
        n_a, self.n_b = self.a.get_vocab_size(with_added_tokens=True), self.b.get_piece_size()
        entry = [self.a.id_to_token(i) or "" for i in range(n_a)]
        raw_a = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in entry]
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        raw_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.raw = [_flat(raw_a), _flat(raw_b)]
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in plain):
            raise ValueError("pieces that hold a space after other characters, or a line end, are not supported")
        joined = {p[i:i + 2] for p in plain for i in range(len(p) - 1)}
        letters = "".join(chr(c) for c in range(0x250) if chr(c).isalpha() and not any(chr(c) + mark in joined for mark in MARKS))
        self.mark = re.compile(rf"[{re.escape(MARKS)}](?<=[{letters}].)")
        self.line = re.compile(r"\n(?<=\S\n)(?=\S)")
        self.odd = re.compile(r" (?=\s|$)|^ |\0")
        # decimal ids with what follows them: the next id, the other side, the next group, the next unit
        self.words = [f"{i}{end}" for n, ends in ((n_a, ",|"), (self.n_b, ",;\n")) for end in ends for i in range(n)]
        self.n_a, self.limit = n_a, limit
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.groups: list[str] = []
        self.used, self.pairs = 0, np.empty(1 << 20, np.int64 if self.n_a * self.n_b >= 1 << 31 else np.int32)
        self.table = np.zeros((1 << 16, 7), np.int64)  # A tokens, B tokens, groups, links, start and number of pairs, intact

    def keys(self, text: str) -> list[str]:
        """``text`` after a space, cut where no token of either tokenizer can cross: a key per unit (see :meth:`unit`)."""
        if not self.odd.search(text):
            return self.line.sub(" \0\n \0", self.mark.sub(" \0\\g<0>", text)).split(" ")
        s = " " + text
        cuts = [0, *[m.start() for m in re.finditer(r"(?<=[^ ]) (?=\S)", s)], len(s)]
        units = [s[a + 1:b] for a, b in zip(cuts, cuts[1:])]
        return ["\0\0" + u if u[:1] == "\0" else u for u in units]

    @staticmethod
    def unit(key: str) -> str:
        """The characters of a unit: behind a space, or, if its key begins with \\0, as they are (\\0\\0: behind a space)."""
        return " " + key if key[:1] != "\0" else " " + key[2:] if key[1:2] == "\0" else key[1:]

    def _tokens_a(self, text: str):
        found = self.a.encode(text, add_special_tokens=False)
        return np.array(found.ids, np.int64), np.array(found.offsets, np.int64).reshape(-1, 2)

    def _tokens_b(self, text: str):
        found = self.b.encode(text, return_type="proto").pieces
        return np.array([p.id for p in found], np.int64), np.array([(p.begin, p.end) for p in found], np.int64).reshape(-1, 2)

    def _encode(self, units: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For A and B: (unit number, id, byte end in the units laid one after another) of every token."""
        sizes = np.array([len(u.encode()) for u in units], np.int64)
        start = np.cumsum(sizes) - sizes
        single = [i for i, u in enumerate(units) if not u or re.search(r"\s", u[1:]) or u[0] != " " and u[0].isspace() or u == " "]
        alone = set(single)
        together = [i for i in range(len(units)) if i not in alone]
        parts: list[list[tuple]] = [[], []]
        if together:
            text = "".join("\n" + units[i] for i in together)
            raw = np.frombuffer(text.encode(), np.uint8)
            at_byte = np.r_[np.flatnonzero((raw & 0xC0) != 0x80), len(raw)]  # byte of each character
            begin = np.cumsum(sizes[together] + 1) - sizes[together]  # behind each line end
            shift = start[together] - begin
            for side, (ids, span) in enumerate((self._tokens_a(text), self._tokens_b(text))):
                first, last = (at_byte[span[:, 0]], at_byte[span[:, 1]]) if side == 0 else (span[:, 0], span[:, 1])
                if side == 1:  # the space that B adds stands before the text
                    ids, first, last = ids[1:], first[1:], last[1:]
                ends = refined_ends(first, last, self.raw[side][2][ids])
                of = np.searchsorted(begin, ends, side="left") - 1
                own = (of >= 0) & (ends <= begin[of] + sizes[together][of])  # not the line ends between units
                parts[side].append((np.array(together)[of[own]], ids[own], ends[own] + shift[of[own]]))
        for i in single:
            unit = units[i]
            at_byte = np.cumsum([0, *[len(c.encode()) for c in unit]])
            ids, span = self._tokens_a(unit)
            parts[0].append((np.full(len(ids), i), ids, refined_ends(at_byte[span[:, 0]], at_byte[span[:, 1]], self.raw[0][2][ids]) + start[i]))
            if unit[:1] == " ":  # B adds it
                ids, span = self._tokens_b(unit[1:])
                span = np.where(span > 0, span + 1, 0)
            else:  # behind a line end, so that B's added space is apart
                ids, span = self._tokens_b("\n" + unit)
                ids, span = ids[2:], span[2:] - 1
            parts[1].append((np.full(len(ids), i), ids, refined_ends(span[:, 0], span[:, 1], self.raw[1][2][ids]) + start[i]))
        out = []
        for side in parts:
            unit, ids, ends = (np.concatenate([p[k] for p in side]) for k in range(3))
            order = np.lexsort((ends, unit))
            out.append((unit[order], ids[order], ends[order]))
        return out

    def _intact(self, units: list[str], side: int, unit: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Units whose decoded token bytes are their own bytes, token by token."""
        raw, starts, sizes = self.raw[side]
        own = np.frombuffer("".join(units).encode(), np.uint8)
        made = take_runs(raw, starts[ids], sizes[ids])
        count = np.array([len(u.encode()) for u in units], np.int64)
        got = np.bincount(unit, weights=sizes[ids], minlength=len(units)).astype(np.int64)
        good = got == count
        good[unit[ends - np.cumsum(sizes[ids]) != _before(count, got, unit)]] = False
        if good.all():
            wrong = np.flatnonzero(made != own)
            good[np.searchsorted(np.cumsum(count), wrong, side="right")] = False
            return good
        at = np.cumsum(got) - got
        edge = np.cumsum(count) - count
        for i in np.flatnonzero(good).tolist():
            good[i] = bool((made[at[i]:at[i] + got[i]] == own[edge[i]:edge[i] + count[i]]).all())
        return good

    def _learn(self, keys: list[str]) -> None:
        for a in range(0, len(keys), 250):
            self._learn_some(keys[a:a + 250])

    def _learn_some(self, keys: list[str]) -> None:
        units = list(map(self.unit, keys))
        (ua, ia, ea), (ub, ib, eb) = self._encode(units)
        n = len(units)
        intact = self._intact(units, 0, ua, ia, ea) & self._intact(units, 1, ub, ib, eb)
        if not intact.all():
            left_a, left_b = intact[ua], intact[ub]
            ua, ia, ea, ub, ib, eb = ua[left_a], ia[left_a], ea[left_a], ub[left_b], ib[left_b], eb[left_b]
        # units lie one after another, so ends grow over all of them
        sa, sb = ea - self.raw[0][2][ia], eb - self.raw[1][2][ib]
        first, last = np.searchsorted(eb, sa, side="right"), np.searchsorted(sb, ea, side="left")
        times = last - first
        link_a, link_b = np.repeat(np.arange(len(ia)), times), take_runs(np.arange(len(ib)), first, times)
        pairs = ia[link_a] * self.n_b + ib[link_b]
        met = np.searchsorted(eb, ea)
        both = ea[eb[np.minimum(met, len(eb) - 1)] == ea] if len(eb) else ea[:0]
        group_a, group_b = np.searchsorted(both, ea), np.searchsorted(both, eb)
        new_unit = np.r_[ub[1:] != ub[:-1], True] if len(ub) else np.empty(0, bool)
        end_a = np.r_[group_a[1:] != group_a[:-1], True] if len(ia) else np.empty(0, bool)
        end_b = np.r_[group_b[1:] != group_b[:-1], True] if len(ib) else np.empty(0, bool)
        word = np.r_[ia + self.n_a * end_a, 2 * self.n_a + ib + self.n_b * np.where(new_unit, 2, end_b)]
        side = np.r_[np.zeros(len(ia), np.int8), np.ones(len(ib), np.int8)]
        order = np.lexsort((np.r_[ea, eb], side, np.r_[group_a, group_b]))
        text = "".join(map(self.words.__getitem__, word[order].tolist()))
        strings = iter(text.split("\n"))
        groups = [next(strings) if ok else "" for ok in (np.bincount(ub, minlength=n) > 0).tolist()]
        code = len(self.groups)
        if code + n > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(n, len(self.table)), 7), np.int64)])
        if self.used + len(pairs) > len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.zeros(max(len(pairs), len(self.pairs)), self.pairs.dtype)])
        links = np.bincount(ua[link_a], minlength=n)
        group_unit = ub[np.searchsorted(eb, both)] if len(both) else np.empty(0, np.int64)
        self.pairs[self.used:self.used + len(pairs)] = pairs
        self.table[code:code + n] = np.c_[np.bincount(ua, minlength=n), np.bincount(ub, minlength=n), np.bincount(group_unit, minlength=n), links, self.used + np.cumsum(links) - links, links, intact]
        self.used += len(pairs)
        self.groups += groups
        self.codes.update(zip(keys, range(code, code + n)))

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Unit numbers of the texts, one after another, and how many each has; they hold until the next call."""
        if len(self.codes) > self.limit:
            self._clear()
        split = [self.keys(t) for t in texts]
        keys = list(chain.from_iterable(split))
        codes = np.fromiter(map(self.codes.get, keys, repeat(-1)), np.int64, len(keys))
        gaps = np.flatnonzero(codes < 0).tolist()
        if gaps:
            missing = [keys[i] for i in gaps]
            self._learn(list(dict.fromkeys(missing)))
            codes[gaps] = np.fromiter(map(self.codes.get, missing), np.int64, len(missing))
        return codes, np.array([len(k) for k in split], np.int64)

    def measure(self, texts: list[str]) -> list[tuple[np.ndarray, list[str], np.ndarray, np.ndarray] | None]:
        """(A tokens, B tokens, groups and links; group strings; distinct pairs; their links) of each text, None without tokens."""
        flat, sizes = self.coded(texts)
        owner = np.repeat(np.arange(len(texts)), sizes)
        key, times = np.unique(owner << 32 | flat, return_counts=True)
        of, unit = key >> 32, key & 0xFFFFFFFF
        rows = self.table[unit]
        pair = take_runs(self.pairs, rows[:, 4], rows[:, 5]).astype(np.int64)
        weight, of_pair = np.repeat(times, rows[:, 5]), np.repeat(of, rows[:, 5])
        width = self.n_a * self.n_b
        key = of_pair * width + pair
        order = np.argsort(key)
        key, weight = key[order], weight[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        weight = np.add.reduceat(weight, first) if len(first) else weight
        of_pair, pair = np.divmod(key[first], width)
        edge = np.searchsorted(of_pair, np.arange(len(texts) + 1))
        sums = [np.bincount(of, weights=rows[:, k] * times, minlength=len(texts)).astype(np.int64) for k in range(4)]
        broken = np.bincount(of, weights=rows[:, 6] == 0, minlength=len(texts)) > 0
        out, at = [], np.cumsum(sizes) - sizes
        groups = list(map(self.groups.__getitem__, flat.tolist()))
        for i, (a, n) in enumerate(zip(at.tolist(), sizes.tolist())):
            if not texts[i] or broken[i]:
                out.append(None)
            else:
                out.append((np.array([s[i] for s in sums]), groups[a:a + n], pair[edge[i]:edge[i + 1]], weight[edge[i]:edge[i + 1]]))
        return out

    def long_text(self, text: str):
        """:meth:`measure` of one long text in parts; its group strings hashed (or None, '')."""
        digest, sums, pairs, weights, at = hashlib.sha256(), np.zeros(4, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), 0
        while at < len(text):
            # behind the first part a text goes on with the space of its next unit
            cut = re.compile(r"(?<=[^\s]) (?=\S)").search(text, at + PART) if at + PART < len(text) else None
            end = cut.start() if cut else len(text)
            found = self.measure([text[at:end]])[0]
            if found is None:
                return None, ""
            digest.update((b";" if at else b"") + ";".join(found[1]).encode())
            sums += found[0]
            pairs, where = np.unique(np.r_[pairs, found[2]], return_inverse=True)
            weights = np.bincount(where, weights=np.r_[weights, found[3]]).astype(np.int64)
            at = end + 1 if cut else end
        return (sums, pairs, weights), digest.hexdigest()


def _before(count: np.ndarray, got: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """For each token the bytes of the units before its own less the token bytes before its unit."""
    return (np.cumsum(count) - count - (np.cumsum(got) - got))[unit]


_aligners: dict[tuple, Aligner] = {}


def aligner(byte_file: str, piece_file: str, limit: int) -> Aligner:
    """One aligner per worker and pair of files."""
    if (byte_file, piece_file, limit) not in _aligners:
        _aligners[byte_file, piece_file, limit] = Aligner(byte_file, piece_file, limit)
    return _aligners[byte_file, piece_file, limit]


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _aligned(rows: DataFrame, byte_file: str, piece_file: str, limit: int, small: bool, groups: bool) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each document, and its groups if asked for."""
    kind = pa.int32() if small else pa.int64()
    names = ["doc_id", *COUNTS, "groups_sha256", "pairs", "times", *(["groups"] if groups else [])]

    def make():
        tool = aligner(byte_file, piece_file, limit)

        def step(batch):
            for part in byte_slices(batch, "text", PART):
                texts = part.column("text").to_pylist()
                if len(texts) == 1 and len(texts[0]) > PART and not groups:
                    found, digest = tool.long_text(texts[0])
                    found, digests, strings = [found], [digest], None
                else:
                    full = tool.measure(texts)
                    strings = [";".join(f[1]) if f else "" for f in full]
                    digests = [hashlib.sha256(s.encode()).hexdigest() if f else "" for s, f in zip(strings, full)]
                    found = [(f[0], f[2], f[3]) if f else None for f in full]
                sums = np.array([f[0] if f else np.zeros(4, np.int64) for f in found]).reshape(-1, 4)
                edge = pa.array(np.r_[0, np.cumsum([len(f[1]) if f else 0 for f in found])], pa.int32())
                lists = [pa.ListArray.from_arrays(edge, pa.array(np.concatenate([np.empty(0, np.int64), *[f[k] for f in found if f]]).astype(np.int64), pa.int64()).cast(t)) for k, t in ((1, kind), (2, pa.int32()))]
                made = [part.column("doc_id"), *[pa.array(sums[:, k]) for k in range(4)], pa.array(digests, pa.string()), *lists]
                yield pa.RecordBatch.from_arrays([*made, *([pa.array(strings, pa.string())] if groups else [])], names=names)

        return step

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, make, f"doc_id {id_type}, " + ", ".join(f"{c} bigint" for c in COUNTS) + f", groups_sha256 string, pairs array<{'int' if small else 'bigint'}>, times array<int>" + ", groups string" * groups)


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """(pair, docs, best): documents that hold each id pair linked, and whether no pair of its A id has more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    counts = keep(counts, "pair-counts")
    a = F.call_function("div", F.col("pair"), F.lit(n_b))
    most = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text", max_pairs: int = 4_000_000, table_units: int = 700_000, groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    n_best: links whose pair count is the highest of their A id; count_sum: sum of the pair
    counts over the links. ``groups`` adds the group strings themselves.
    """
    import sentencepiece
    from tokenizers import Tokenizer

    n_b = sentencepiece.SentencePieceProcessor(model_file=piece_file).get_piece_size()
    small = Tokenizer.from_file(byte_file).get_vocab_size(with_added_tokens=True) * n_b < 1 << 31
    rows = id_and_text(docs, id_col, text_col)
    aligned = _aligned(rows, byte_file, piece_file, table_units, small, groups).withColumn("row", F.monotonically_increasing_id())
    aligned = keep(aligned, "aligned")
    counts, n = keep_counted(pair_counts(aligned, n_b), "pair-best")
    out = ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256", *(["groups"] if groups else [])]
    if n > max_pairs:
        each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").cast("bigint").alias("times"))
        sums = each.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
        return aligned.join(sums, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("n_best", "count_sum")}).select(*out)
    table = counts.toArrow().sort_by("pair")  # max_pairs at most
    shared = docs.sparkSession.sparkContext.broadcast((table["pair"].to_numpy(), table["docs"].to_numpy(), table["best"].to_numpy()))

    def make():
        pair, docs_of, best = shared.value

        def step(batch):
            edge = batch.column("pairs").offsets.to_numpy()
            at = np.searchsorted(pair, batch.column("pairs").flatten().to_numpy())
            times = batch.column("times").flatten().to_numpy().astype(np.int64)
            edge = edge - edge[0]
            sums = {}
            for name, values in (("n_best", np.where(best[at], times, 0) if len(at) else times), ("count_sum", times * docs_of[at] if len(at) else times)):
                total = np.r_[0, np.cumsum(values)]
                sums[name] = pa.array(total[edge[1:]] - total[edge[:-1]], pa.int64())
            yield pa.RecordBatch.from_arrays([sums[c] if c in sums else batch.column(c) for c in out], names=out)

        return step

    kinds = dict(aligned.dtypes) | {"n_best": "bigint", "count_sum": "bigint"}
    return map_arrow(aligned.select(*[c for c in out if c in aligned.columns], "pairs", "times"), make, ", ".join(f"{c} {kinds[c]}" for c in out))
