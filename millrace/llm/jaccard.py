"""Chosen-path set similarity join on word shingles.

A document is the set of hashes of its ``words``-word shingles. Documents with equal
sets are one class. In each of several runs every class samples shingles: shingle x of
set S is taken when a hash of (run, path, x) is below 1 / (threshold * |S|), so similar
sets agree on one token or more on average, and classes that took one shingle meet in
its bucket. A class stays in a bucket only if another one there has a size that allows
the threshold. A bucket of at most ``small`` classes is compared by brute force; a larger
one is split again on the next sampled shared token, down to ``max_depth``. A child that
still holds more than half of its parent consists of sets too near to be separated by
splitting: like what is large at the last depth, it is compared as a whole. A bucket is
one task while its sets hold ``block_shingles`` shingles at most; beyond that it is
compared in pairs of blocks of that size, so a class is sent once per block of its bucket. Two sets at the threshold share a bucket of one
run with a chance s(0) of at least 1 - 1/e, and still share one after k splits with a chance
s(k) = 1 - exp(-s(k - 1)). The number of runs follows from ``recall`` and s(0). Classes in
buckets that were split k times are sampled in more runs, up to the number that s(k) asks
for, so a pair that meets in split buckets only is found as surely as any other. Runs that
the same number of splits asks for are one turn. Buckets of different turns do not depend on
each other, so one pass splits what is large in any turn and samples the next turn, once
all classes of that turn are known.

Buckets with the same members are compared once. Every pair is compared in one bucket
only, the smallest that holds both. Candidate pairs never become rows: a bucket task
returns a number of links per class and a spanning forest of its links, and groups are
the connected components of these forests. Classes are told apart by 64-bit shingle
hashes; pairs are compared on their upper 32 bits, which halves what is shuffled. Two of the
32-bit hashes of a pair are equal by chance with about (|A| + |B|)**2 / 2**33, which can
move a pair that lies one shingle off the threshold to the other side.

A text of fewer words is one shingle; null, empty and blank texts have the empty set
and form one class. Words are lower-cased and cut at white space. Repeated rows are in
one class. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import id_and_text, keep, keep_counted, map_arrow, take_runs
from millrace.session import discard

P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * P2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingle hashes of texts."""

    def __init__(self, words: int, limit: int = 600_000):
        self.words, self.limit, self.known = words, limit, {}

    def _word_hashes(self, parts: list[str]) -> list[int]:
        import xxhash

        known = self.known
        got = list(map(known.get, parts))
        if None in got:
            for i, h in enumerate(got):
                if h is None:
                    got[i] = known[parts[i]] = xxhash.xxh3_64_intdigest(parts[i])
        return got

    def sets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of each text, one text after another, and how many each has."""
        if len(self.known) > self.limit:
            self.known.clear()
        h = [np.array(self._word_hashes(t.lower().split()), np.uint64) for t in texts]
        words = np.array([len(x) for x in h], np.int64)
        h = np.concatenate([np.empty(0, np.uint64), *h])
        width = np.minimum(words, self.words)
        count = np.where(words > 0, words - width + 1, 0)
        at = take_runs(np.arange(len(h)), np.cumsum(words) - words, count)
        owner = np.repeat(np.arange(len(texts)), count)
        out = np.where(words < self.words, words, 0)[owner].astype(np.uint64)
        for j in range(self.words):
            in_ = np.flatnonzero(width[owner] > j) if (width[words > 0] <= j).any() else slice(None)
            out[in_] = mixed(out[in_] * P1 + h[at[in_] + j])
        key = owner.astype(np.uint64) << np.uint64(48) | out >> np.uint64(16)
        order = np.argsort(key)
        key, sorted_ = key[order], out[order]
        same = key[1:] == key[:-1]
        if (same & (sorted_[1:] != sorted_[:-1])).any():  # hashes alike in their upper bits
            order = np.lexsort((out, owner))
            sorted_ = out[order]
            same = (sorted_[1:] == sorted_[:-1]) & (owner[order][1:] == owner[order][:-1])
        new = np.r_[True, ~same][:len(sorted_)]
        return sorted_[new], np.bincount(owner[order][new], minlength=len(texts))


def taken(shingles: np.ndarray, path: int, rate: float) -> np.ndarray:
    """Path numbers of the children that a set goes to below ``path``."""
    h = mixed(shingles * P1 ^ np.uint64(path))
    limit = rate / max(len(shingles), 1)
    hit = h if limit >= 1 else h[h < np.uint64(int(limit * 2.0**64))]
    return mixed(hit + np.uint64(path * int(P2) % 2**64))


def taken_by_each(flat: np.ndarray, sizes: np.ndarray, paths: list[int], rate: float) -> tuple[np.ndarray, np.ndarray]:
    """:func:`taken` for several sets laid one after another: (children, children of each set)."""
    limit = np.repeat(np.minimum(rate / np.maximum(sizes, 1) * 2.0**64, 2.0**64 - 2048).astype(np.uint64), sizes)
    all_ = np.repeat(rate >= sizes, sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    children, owners = [], []
    for path in paths:
        h = mixed(flat * P1 ^ np.uint64(path))
        hit = (h < limit) | all_
        children.append(mixed(h[hit] + np.uint64(path * int(P2) % 2**64)))
        owners.append(owner[hit])
    children, owners = np.concatenate(children), np.concatenate(owners)
    return children[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(sizes))


def class_names(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """128 bits that name each set; the empty set has the name of no bits."""
    halves = np.zeros((len(sizes), 2), ">u8")
    some = np.flatnonzero(sizes)
    for k in (1, 2):
        if len(some):
            halves[some, k - 1] = np.bitwise_xor.reduceat(mixed(flat + np.uint64(k)), (np.cumsum(sizes) - sizes)[some])
    raw = halves.tobytes()
    return [raw[i:i + 16] for i in range(0, len(raw), 16)]


def runs_for(recall: float, splits: int = 0) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``, in buckets that are split ``splits`` times."""
    met = 1.0
    for _ in range(splits + 1):
        met = 1 - math.exp(-met)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - met) - 1e-9))


def _sets(rows: DataFrame, words: int, runs: int, rate: float, seed: int) -> DataFrame:
    """(doc_id, class, size, buckets): the class of each text and its first-level buckets."""

    def make():
        shingler = Shingler(words)
        paths = [int(x) for x in np.random.default_rng(seed).integers(1, 2**63, runs)]

        def step(batch):
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                flat, sizes = shingler.sets(part.column("text").to_pylist())
                children, count = taken_by_each(flat, sizes, paths, rate)
                buckets = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.array(children.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(class_names(flat, sizes), pa.binary()), pa.array(sizes, pa.int32()), buckets], names=["doc_id", "class", "size", "buckets"])

        return step

    return map_arrow(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, class binary, size int, buckets array<bigint>")


def _shingles_of(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(class, large, shingles) of the classes whose chosen document is in ``wanted`` (doc_id, class, large), as 32-bit hashes.

    Rows of one doc_id meet in one task, which returns each class once. If AQE splits the
    task, a class can come once from each part; users of the table drop these repeats.
    """
    joined = rows.join(wanted.withColumnRenamed("doc_id", "__id").hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id"))).select("class", "large", "text")

    def make():
        shingler, seen = Shingler(words), set()

        def step(batch):
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                wanted = {}
                for text, name, large in zip(*(part.column(c).to_pylist() for c in ("text", "class", "large"))):
                    if name not in seen:
                        wanted.setdefault((name, text), large)
                flat, sizes = shingler.sets([text for _, text in wanted])
                ends = np.cumsum(sizes)
                names, flags, sets = [], [], []
                for ((name, _), large), own, a, b in zip(wanted.items(), class_names(flat, sizes), (ends - sizes).tolist(), ends.tolist()):
                    if own == name and name not in seen:
                        seen.add(name)
                        names.append(name)
                        flags.append(large)
                        sets.append(np.unique((flat[a:b] >> np.uint64(32)).astype(np.uint32)).view(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(flags, pa.bool_()), pa.array(sets, pa.list_(pa.int32()))], names=["class", "large", "shingles"])

        return step

    return map_arrow(joined, make, "class binary, large boolean, shingles array<int>")


def _shared(placed: DataFrame, label: str) -> DataFrame:
    """The rows (bucket, class, band, ...) that share their bucket with a class of their own or a neighbouring band, with ``n``, the classes of the bucket.

    Bands are so wide that two classes at the threshold lie at most one band apart.
    """
    bands = placed.groupBy("bucket", "band").agg(F.count(F.lit(1)).alias("n"))
    bands = bands.groupBy("bucket").agg(F.sum("n").alias("n"), F.collect_list(F.struct("band", "n")).alias("bands")).where("n > 1")
    near = F.aggregate(F.filter("bands", lambda b: F.abs(b["band"] - F.col("band")) <= 1), F.lit(0).cast("bigint"), lambda sum_, b: sum_ + b["n"])
    return keep(placed.join(bands.hint("shuffle_hash"), "bucket").where(near > 1).drop("bands"), label)


def _children(rows: DataFrame, sets: DataFrame, rate: float) -> DataFrame:
    """Children (bucket, class, band, parent, turn, depth) of the rows (path, class, band, n, turn, depth); ``parent`` is the parent's n.

    A class that is twice in ``sets`` has its children twice: more is compared, nothing lost.
    """
    todo = rows.groupBy("class").agg(F.first("band").alias("band"), F.collect_list(F.struct("path", "n", "turn", "depth")).alias("todo"))
    joined = todo.join(sets, "class").select("class", "band", "todo", "shingles")

    def make():
        def step(batch):
            todo = batch.column("todo").flatten()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("todo").offsets.to_numpy()))
            sets, children, last = batch.column("shingles"), [], -1
            for i, path in zip(owner.tolist(), todo.field("path").to_pylist()):
                if i != last:
                    last, own_set = i, sets[i].values.to_numpy().view(np.uint32).astype(np.uint64)
                children.append(taken(own_set, path % 2**64, rate))
            of = np.repeat(np.arange(len(children)), [len(x) for x in children])
            own = pa.array(owner[of])
            bucket = np.concatenate([np.empty(0, np.uint64), *children]).view(np.int64)
            parent, turn = todo.field("n").take(pa.array(of)), todo.field("turn").take(pa.array(of))
            depth = pa.array(todo.field("depth").to_numpy()[of] + np.int32(1))
            yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column("class").take(own), batch.column("band").take(own), parent, turn, depth], names=["bucket", "class", "band", "parent", "turn", "depth"])

        return step

    return map_arrow(joined, make, "bucket bigint, class binary, band int, parent bigint, turn int, depth int")


def _split_down(top: DataFrame, sets: DataFrame, rate: float, small: int, max_depth: int, paths: list[list[int]]) -> tuple[DataFrame, list[DataFrame]]:
    """Buckets to compare (bucket, class, band), and the tables they are read from.

    ``top``: first-level buckets (bucket, class, band, n, parent, turn, depth) of turn 0. ``paths``: the
    runs of turn 1, 2, ...; turn k is for the classes in buckets that were split k times in earlier turns.
    """
    done = (F.col("n") <= small) | F.coalesce(2 * F.col("n") > F.col("parent"), F.lit(False)) | (F.col("depth") >= max_depth)
    tables, turn, met = [top], 0, set()
    while True:
        large = tables[-1].where(~done)
        now = {(r.turn, r.depth) for r in large.agg(F.collect_set(F.struct("turn", "depth")).alias("at")).head().at}
        met |= now
        rows = [large.select("class", "band", F.col("bucket").alias("path"), "n", "turn", "depth")] if now else []
        if turn < len(paths) and any(depth == turn for _, depth in met) and all(depth >= turn for _, depth in now):
            split = reduce(DataFrame.unionByName, [t.where(~done & (F.col("depth") == turn)).select("class", "band") for t in tables]).distinct()
            runs = F.explode(F.array(*[F.lit(p) for p in paths[turn]]).cast("array<bigint>"))
            turn += 1
            rows.append(split.select("class", "band", runs.alias("path"), F.lit(None).cast("bigint").alias("n"), F.lit(turn).alias("turn"), F.lit(-1).alias("depth")))
        if not rows:
            break
        children = keep(_children(reduce(DataFrame.unionByName, rows), sets, rate), f"children-{len(tables)}")
        tables.append(_shared(children, f"shared-{len(tables)}"))
        discard(children)
    return reduce(DataFrame.unionByName, [t.where(done).select("bucket", "class", "band") for t in tables]), tables


def _compare(blocks: DataFrame, threshold: float) -> DataFrame:
    """(class, links, root): links of each class found in the bucket blocks, and its forest parent.

    ``blocks``: (bucket, pair_of_blocks, side, class, shingles, others); the pairs between side 0 and
    side 1, or within side 0 where there is no side 1. ``others``: the buckets of the class.
    """

    def compare(table):
        first = {}
        for i, name in enumerate(table.column("class").to_pylist()):
            first.setdefault(name, i)
        side = table.column("side").to_numpy()
        take = np.fromiter(first.values(), np.int64)
        table = table.take(take[np.argsort(side[take], kind="stable")]).combine_chunks()
        bucket = table.column("bucket")[0].as_py()
        n, two = table.num_rows, int(np.count_nonzero(table.column("side").to_numpy()))
        rows = n - two if two else n  # compared with what comes after them, or with side 1
        rank = table.column("shingles").combine_chunks().value_lengths().to_numpy().astype(np.int64)
        flat = table.column("shingles").combine_chunks().flatten().to_numpy()
        owner = np.repeat(np.arange(n), rank)
        order = np.argsort(flat, kind="stable")
        posting, sorted_ = owner[order], flat[order]
        new = np.r_[True, sorted_[1:] != sorted_[:-1]][:len(flat)]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(flat)])
        code = np.empty(len(flat), np.int64)
        code[order] = np.cumsum(new) - 1
        # what an eighth of the sets hold is counted by a matrix product, the rest along the postings
        often = sizes >= max(2, n / 8)
        held, column = often[code], np.cumsum(often) - 1
        holds = np.zeros((n, int(np.count_nonzero(often))), np.float32)
        holds[owner[held], column[code[held]]] = 1
        shared = ~held & (sizes[code] > 1) & (owner < rows)
        owner, code = owner[shared], code[shared]
        steps = np.cumsum(np.bincount(owner, weights=sizes[code], minlength=rows)) // 500_000
        at = np.arange(rows) // max(1, 500_000 // n)
        edges = np.r_[0, np.flatnonzero((np.diff(steps) != 0) | (np.diff(at) != 0)) + 1, rows].tolist()
        links, root = np.zeros(n, np.int64), np.arange(n)
        earlier = members = None
        for a, b in zip(edges, edges[1:]):
            common = (holds[a:b] @ holds.T).astype(np.int64)
            mine = slice(*np.searchsorted(owner, [a, b]))
            if mine.start < mine.stop:
                of = np.repeat((owner[mine] - a) * n, sizes[code[mine]])
                common += np.bincount(of + take_runs(posting, starts[code[mine]], sizes[code[mine]]), minlength=(b - a) * n).reshape(b - a, n)
            good = common >= threshold * (rank[a:b, None] + rank - common) - 1e-9
            good &= np.arange(n) >= rows if two else np.arange(n) > np.arange(a, b)[:, None]
            for i in np.flatnonzero(good.any(axis=1)).tolist():
                if earlier is None:
                    earlier = [{x for x in o if x < bucket} for o in table.column("others").to_pylist()]
                    members = {}
                    for j, e in enumerate(earlier):
                        for x in e:
                            members.setdefault(x, []).append(j)
                    members = {x: np.array(m) for x, m in members.items() if len(m) > 1}
                for x in earlier[a + i]:  # pairs that an earlier bucket holds are compared there
                    if x in members:
                        good[i, members[x]] = False
                found = np.flatnonzero(good[i])
                links[a + i] += len(found)
                links[found] += 1
                while len(found := found[root[found] != root[a + i]]):
                    low, high = sorted((int(root[a + i]), int(root[found[0]])))
                    root[root == high] = low
        names, linked = table.column("class"), np.flatnonzero(links)
        return pa.table({"class": names.take(pa.array(linked)), "links": links[linked], "root": names.take(pa.array(root[linked]))})

    return blocks.groupBy("bucket", "pair_of_blocks").applyInArrow(compare, "class binary, links bigint, root binary")


def _components(edges: DataFrame) -> DataFrame:
    """(class, root): the smallest class of each connected component of (class, root) edges."""
    edges = edges.where(F.col("class") != F.col("root")).select(F.greatest("class", "root").alias("u"), F.least("class", "root").alias("v")).distinct()
    edges, n = keep_counted(edges, "forest")
    while True:
        # large star, then small star: every node moves its neighbours towards its smallest one
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = keep(large.where(F.col("u") != F.col("v")).distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        small = small.where(F.col("u") != F.col("v")).distinct()
        new, count = keep_counted(small, "small-star")
        same = count == n and not new.exceptAll(edges).head(1)
        edges, n = new, count
        if same:
            return edges.select(F.col("u").alias("class"), F.col("v").alias("root"))


def similarity_groups(docs: DataFrame, words: int = 5, threshold: float = 0.8, recall: float = 0.9999, small: int = 128, max_depth: int = 6, block_shingles: int = 2_000_000, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, group_id, links.

    class_id names documents with equal shingle sets, group_id is the smallest doc_id of
    the documents linked directly or through others, links is the number of other
    classes at least ``threshold`` similar.
    """
    rows = id_and_text(docs, id_col, text_col)
    rate = 1 / threshold
    sets = keep(_sets(rows, words, runs_for(recall), rate, seed), "shingle-classes")
    classes = sets.groupBy("class").agg(F.min(F.struct("doc_id", "size", "buckets")).alias("one")).select("class", "one.*")
    step = max(1 / threshold, 1.000001) ** 1.0001  # sizes of a band lie within this factor
    band = F.floor(F.log(F.col("size")) / math.log(step)).cast("int")
    placed = keep(classes.select("class", "doc_id", band.alias("band"), F.explode(F.array_distinct("buckets")).alias("bucket"), F.lit(None).cast("bigint").alias("parent"), F.lit(0).alias("turn"), F.lit(0).alias("depth")), "buckets")
    shared = _shared(placed, "top")
    discard(placed)
    wanted = shared.groupBy("doc_id", "class").agg(F.max(F.col("n") > small).alias("large"))
    shingles = keep(_shingles_of(rows, wanted, words), "shingles")
    extra = [int(x) for x in np.random.default_rng([seed, 1]).integers(1, 2**63, runs_for(recall, max_depth))]
    paths = [extra[runs_for(recall, k - 1):runs_for(recall, k)] for k in range(1, max_depth + 1)]
    members, tables = _split_down(shared, shingles.where("large").select("class", "shingles"), rate, small, max_depth, paths)
    same = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), "class")).alias("xor"), F.sum(F.pow(F.lit(step), F.col("band") + 1)).alias("shingles"))
    once = same.groupBy("n", "sum", "xor").agg(F.min("bucket").alias("bucket"), F.min("shingles").alias("shingles"))
    once = once.select("bucket", F.ceil(F.col("shingles") / block_shingles).cast("int").alias("blocks"))
    members = keep(members.join(once.hint("shuffle_hash"), "bucket").select("bucket", "class", "blocks"), "distinct-members")
    discard(*tables)
    others = members.groupBy("class").agg(F.collect_list("bucket").alias("others"))
    # a bucket of several blocks is compared block pair by block pair
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    pairs = members.select("bucket", "class", "blocks", own.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    pairs = pairs.select("bucket", "class", (low * F.col("blocks") + high).cast("bigint").alias("pair_of_blocks"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"))
    sets_of = shingles.dropDuplicates(["class"]).select("class", "shingles").join(others.hint("shuffle_hash"), "class")
    found = keep(_compare(pairs.join(sets_of.hint("shuffle_hash"), "class"), threshold), "links")
    discard(members, shingles)
    degree = found.groupBy("class").agg(F.sum("links").alias("links"))
    component = _components(found.select("class", "root"))
    named = sets.select("doc_id", "class").join(degree, "class", "left").join(component, "class", "left").select("doc_id", F.lower(F.hex("class")).alias("class_id"), F.coalesce("root", "class").alias("root"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("group_id"))
    return named.join(smallest, "root").select("doc_id", "class_id", "group_id", "links")


def brute_force(texts: list[str | None], words: int = 5, threshold: float = 0.8) -> list[tuple[int, int]]:
    """(smallest member of the group, number of other sets linked) of each text, for tests."""
    split = [(t or "").lower().split() for t in texts]
    sets = [frozenset(tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset() for w in split]
    distinct = list(dict.fromkeys(sets))
    near = {s: [] for s in distinct}
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            n = len(a & b)
            if n and n >= threshold * (len(a) + len(b) - n) - 1e-9:
                near[a].append(b)
                near[b].append(a)
    first, group = {}, {}
    for i, s in enumerate(sets):
        first.setdefault(s, i)
    for s in distinct:
        if s not in group:
            reach, todo = {s}, [s]
            while todo:
                for b in near[todo.pop()]:
                    if b not in reach:
                        reach.add(b)
                        todo.append(b)
            least = min(first[x] for x in reach)
            group.update(dict.fromkeys(reach, least))
    return [(group[s], len(near[s])) for s in sets]
