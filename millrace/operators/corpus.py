"""Jobs over a table of texts: duplicate blocks, patterns, coverage, findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.common import small_side, spread
from millrace.session import materialize, materialize_counted

# Fixed value: a token is a run of letters, digits or underscores.
TOKEN = r"[\p{L}\p{N}_]+"
# Tool severities and rule categories of the static checkers.
SEVERITY = {
    ("checkstyle", "error"): "major", ("checkstyle", "warning"): "minor", ("checkstyle", "info"): "info",
    ("pmd", "1"): "critical", ("pmd", "2"): "major", ("pmd", "3"): "minor", ("pmd", "4"): "info", ("pmd", "5"): "info",
}
EXCEPTION_RULES = ("EmptyCatchBlock", "CloseResource")


_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

# Texts whose blocks are hashed at once in a task.
TEXTS_AT_ONCE = 500


def _run_hashes(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` values of ``h`` from each place ``at`` on."""
    out = np.zeros(len(at), np.uint64)
    for j in range(n):
        out = out * _P1 + h[at + j]
        out = (out ^ (out >> np.uint64(30))) * _P2
        out ^= out >> np.uint64(31)
    return out


def _places(sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in all tokens, position in the text) of each ``n``-token block of texts of ``sizes`` tokens."""
    count = np.maximum(sizes - n + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), count)
    position = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return owner, position + (np.cumsum(sizes) - sizes)[owner], position


def _anchors(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The anchor of the block at each place: the least hash of its runs of half its tokens.

    Equal blocks have equal anchors, and neighbouring blocks mostly share theirs.
    """
    k = (n + 1) // 2
    grams = _run_hashes(h, np.arange(max(len(h) - k + 1, 0)), k)
    best = grams[at]
    for j in range(1, n - k + 1):
        best = np.minimum(best, grams[at + j])
    return best


def _token_hashes(docs: DataFrame, n: int, **seeds: int | None) -> DataFrame:
    """``docs`` of ``n`` tokens or more, with an array of token hashes per seed in place of the text."""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))
    hashed = lambda seed: F.transform("__t", lambda t: F.xxhash64(t) if seed is None else F.xxhash64(F.lit(seed), t))
    rest = [c for c in docs.columns if c != "text"]
    return docs.withColumn("__t", tokens).filter(F.size("__t") >= n).select(*rest, *[hashed(seed).alias(c) for c, seed in seeds.items()])


def _parts(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            yield batch.slice(at, TEXTS_AT_ONCE)


def _hashes(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def block_places(docs: DataFrame, n: int, beside: bool = False) -> DataFrame:
    """(h1, h2, doc_id, position, first) of every ``n``-token block whose anchor occurs in more than one document.

    These hold all places of each block found in more than one document, and few others: a
    text without repeats leaves only its anchors, about one per ``n / 4`` tokens, to be
    counted. ``first``: whether it is the block's first place in the text. ``beside`` adds hashes
    of the tokens before and after the block.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))

    def anchors(batches):
        for part in _parts(batches):
            owner, at, _ = _places(part.column("t").value_lengths().to_numpy(zero_copy_only=False), n)
            best = _anchors(_hashes(part.column("t")), at, n)
            order = np.lexsort((best, owner))
            pick = order[np.r_[True, (np.diff(owner[order]) != 0) | (best[order][1:] != best[order][:-1])][:len(order)]]
            of = pa.array(owner[pick])
            yield pa.RecordBatch.from_arrays(
                [part.column("row").take(of), part.column("doc_id").take(of), pa.array(best[pick].view(np.int64))], names=["row", "doc_id", "anchor"])

    met = materialize(_token_hashes(spread(texts), n, t=None).mapInArrow(anchors, f"row bigint, doc_id {id_type}, anchor bigint"), "anchors")
    repeated = met.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo <> hi").select("anchor")
    wanted = materialize(met.join(repeated, "anchor").groupBy("row").agg(F.collect_set("anchor").alias("anchors")), "shared-anchors")

    def places(batches):
        for part in _parts(batches):
            sizes = part.column("t").value_lengths().to_numpy(zero_copy_only=False)
            owner, at, position = _places(sizes, n)
            h = _hashes(part.column("t"))
            best = _anchors(h, at, n)
            ends = np.cumsum(np.bincount(owner, minlength=part.num_rows))
            sets = part.column("anchors")
            held = [np.isin(best[a:b], sets[i].values.to_numpy(zero_copy_only=False).view(np.uint64)) for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends))]
            pick = np.flatnonzero(np.concatenate([np.empty(0, bool), *held]))
            owner, at, position = owner[pick], at[pick], position[pick]
            out = [pa.array(_run_hashes(x, at, n).view(np.int64)) for x in (h, _hashes(part.column("u")))]
            keys = [x.to_numpy() for x in out[::-1]] + [owner]
            order, new = np.lexsort(keys), np.ones(len(pick), bool)
            new[order[1:]] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
            out += [part.column("doc_id").take(pa.array(owner)), pa.array(position.astype(np.int32)), pa.array(new)]
            if beside:
                h = np.r_[h, np.uint64(0)].view(np.int64)
                out += [pa.array(h[at - 1], mask=position == 0), pa.array(h[at + n], mask=position == sizes[owner] - n)]
            yield pa.RecordBatch.from_arrays(out, names=["h1", "h2", "doc_id", "position", "first", "before", "after"][:len(out)])

    held = _token_hashes(texts.join(wanted.hint("shuffle_hash"), "row").drop("row"), n, t=None, u=7)
    schema = f"h1 bigint, h2 bigint, doc_id {id_type}, position int, first boolean" + (", before bigint, after bigint" if beside else "")
    return materialize(held.mapInArrow(places, schema), "places")


def duplicate_blocks(docs: DataFrame, n: int = 20) -> DataFrame:
    """Every position of an ``n``-token block that occurs in more than one document.

    ``docs``: doc_id, text; whole texts are used. Blocks are compared by two
    independent 64-bit hashes of the token run, so neither block text nor document
    pairs are shuffled, and only blocks with a repeated anchor are (:func:`block_places`).
    A block found in very many documents is one aggregate row per task, and its
    positions are spread over tasks by the join's skew handling.
    """
    places = block_places(docs, n)
    return places.join(_shared_blocks(docs, places), ["h1", "h2"]).select(
        "h1", "h2", "doc_id", "position", F.lit(n).alias("tokens"), "doc_count", "occurrences")


def _shared_blocks(docs: DataFrame, places: DataFrame, **sides: str) -> DataFrame:
    """(h1, h2, doc_count, occurrences) of the blocks found in more than one document.

    ``sides``: per new column, the column of ``places`` that must hold one value, and no null, at all places of the
    block. It is false too for a block that comes twice at one place of a document.
    """
    docs_of = lambda where: F.count_if(F.col("first") & where)
    per, only = [], {}
    for name, c in sides.items():
        per += [F.count(c).alias(f"{name}_n"), F.min(c).alias(f"{name}_lo"), F.max(c).alias(f"{name}_hi")]
        only[name] = (F.col(f"{name}_n") == F.col("occurrences")) & (F.col(f"{name}_lo") == F.col(f"{name}_hi"))
    blocks = places.groupBy("h1", "h2").agg(
        docs_of(F.lit(True)).alias("doc_count"), docs_of(F.col("doc_id").isNotNull()).alias("named"), F.count(F.lit(1)).alias("occurrences"), *per)
    again, n = materialize_counted(docs.groupBy(F.col("doc_id").alias("again")).count().filter("count > 1").select("again"), "repeated-ids")
    if n:  # texts of one doc_id count once
        of = places.join(small_side(again), F.col("doc_id").eqNullSafe(F.col("again")), "left_semi")
        at = of.groupBy("h1", "h2", "doc_id", "position").agg(F.count_if("first").alias("f"), F.count(F.lit(1)).alias("n"))
        in_doc = at.groupBy("h1", "h2", "doc_id").agg((F.sum("f") - 1).alias("f"), F.max("n").alias("n"))
        more = in_doc.groupBy("h1", "h2").agg(
            F.sum("f").alias("less"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("f")).otherwise(0)).alias("less_named"), F.max("n").alias("most"))
        blocks = blocks.join(more, ["h1", "h2"], "left").withColumns({
            "doc_count": F.col("doc_count") - F.coalesce("less", F.lit(0)), "named": F.col("named") - F.coalesce("less_named", F.lit(0))})
        only = {name: c & (F.coalesce("most", F.lit(1)) == 1) for name, c in only.items()}
    return blocks.filter("named > 1").select("h1", "h2", "doc_count", "occurrences", *[c.alias(name) for name, c in only.items()])


def duplicate_spans(docs: DataFrame, n: int = 20) -> DataFrame:
    """Maximal duplicate blocks: the longest token runs whose ``n``-token blocks all occur at the same places.

    Neighbouring blocks of :func:`duplicate_blocks` are joined where each one is met next
    to the other only, so all copies of a span have the same length and the same
    sources. A block is met after one other only if the same token stands before it
    wherever it is; that is decided in the aggregate that counts the blocks, and no
    pairs of blocks or documents are formed. Per span of a document: start, tokens, sources
    (documents), occurrences and its first place (first_doc, first_position).
    """
    places = block_places(docs, n, beside=True)
    blocks = _shared_blocks(docs, places, one_before="before", one_after="after").withColumnRenamed("doc_count", "sources")
    within = Window.partitionBy("doc_id").orderBy("position")
    hits = places.select("h1", "h2", "doc_id", "position").join(blocks, ["h1", "h2"])
    joined = F.col("one_before") & (F.lag("position").over(within) == F.col("position") - 1) & F.lag("one_after").over(within)
    marked = hits.withColumn("joined", joined).withColumn("no", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(within))
    spans = materialize(marked.groupBy("doc_id", "no").agg(
        F.min("position").alias("start"), (F.count(F.lit(1)) + n - 1).alias("tokens"), F.min_by(F.struct("h1", "h2"), "position").alias("block"),
        F.min("sources").alias("sources"), F.min("occurrences").alias("occurrences")).drop("no"), "spans")
    first = spans.groupBy("block").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    return spans.join(first, "block").select(
        "doc_id", "start", "tokens", "sources", "occurrences", F.col("first.doc_id").alias("first_doc"), F.col("first.start").alias("first_position"))


def apply_dup_rules(groups: DataFrame, rules: DataFrame, index: DataFrame) -> DataFrame:
    """Decide per duplicate group whether to extract it.

    ``groups``: group_id, package, file. ``rules``: action (exclude/force),
    class_name, reason. ``index``: package, file. Two or more packages suggest
    extraction, exclude and force override; a force rule no group matches adds
    the indexed files of that class as a group of its own.
    """
    name = F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1)
    per = groups.groupBy("group_id").agg(F.count_distinct("package").alias("packages"), F.count(F.lit(1)).alias("sources"))
    hits = groups.withColumn("class_name", name).join(rules, "class_name").groupBy("group_id").agg(
        F.max(F.when(F.col("action") == "force", 1)).alias("__force"),
        F.min(F.when(F.col("action") == "exclude", F.col("reason"))).alias("__exclude"))
    forced, excluded = F.col("__force").isNotNull(), F.col("__exclude").isNotNull()
    judged = per.join(hits, "group_id", "left").select(
        F.col("group_id").cast("string").alias("group_id"), "packages", "sources",
        F.when(forced, True).when(excluded, False).otherwise(F.col("packages") >= 2).alias("suggested"),
        forced.alias("forced"),
        F.when(forced, None).when(excluded, F.concat(F.lit("user-excluded: "), "__exclude")).when(F.col("packages") < 2, "single-package").alias("skip_reason"))
    used = groups.select(name.alias("class_name")).distinct()
    extra = rules.filter("action = 'force'").join(used, "class_name", "left_anti").select("class_name").distinct()
    added = index.withColumn("class_name", name).join(extra, "class_name").groupBy("class_name").agg(
        F.count_distinct("package").alias("packages"), F.count(F.lit(1)).alias("sources")).select(
        F.concat(F.lit("force-"), "class_name").alias("group_id"), "packages", "sources", F.lit(True).alias("suggested"),
        F.lit(True).alias("forced"), F.lit(None).cast("string").alias("skip_reason"))
    return judged.unionByName(added)


_WORD_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def line_pattern(pattern: str) -> Column:
    """The pattern with ``^`` at lines, case ignored, and ASCII word boundaries.

    Java's ``\\b`` counts accented letters as word characters; the patterns here
    mean ASCII identifiers.
    """
    return F.lit("(?im)" + pattern.replace(r"\b", _WORD_EDGE))


def pattern_counts(docs: DataFrame, patterns: Mapping[str, str], text: str = "text") -> DataFrame:
    """One count column per named pattern, with ``^`` anchored at lines, case ignored."""
    return docs.withColumns({name: F.regexp_count(F.col(text), line_pattern(p)) for name, p in patterns.items()}).drop(text)


def cosine_similarity(a: Column, b: Column) -> Column:
    """dot / (|a||b|) of two numeric arrays, 0 when a norm is 0."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def coverage(expected: DataFrame, actual: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(summary with whole-percent score, missing keys)."""
    want, have = expected.select(key).distinct(), actual.select(key).distinct()
    flagged = want.join(have.withColumn("__hit", F.lit(1)), key, "left")
    summary = flagged.agg(F.count(F.lit(1)).alias("total"), F.count("__hit").alias("covered")).withColumn(
        "score", F.when(F.col("total") > 0, F.floor(F.col("covered") * 100.0 / F.col("total") + 0.5)).otherwise(0).cast("long"))
    return summary, want.join(have, key, "left_anti")


def normalize_findings(findings: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """Findings of several tools on one scale: severity, category, short rule name.

    ``findings``: file, line, rule, level, message, tool. ``owners``: file,
    package; files without owner belong to UNKNOWN.
    """
    pairs = [F.lit(x) for (tool, level), s in SEVERITY.items() for x in (f"{tool}|{level}", s)]
    severity = F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat("tool", F.lit("|"), "level")), F.lit("info"))
    style = F.col("tool") == "checkstyle"
    short = F.when(style, F.regexp_replace(F.substring_index("rule", ".", -1), "Check$", "")).otherwise(F.col("rule"))
    category = (
        F.when(style & F.col("rule").contains(".naming."), "naming-convention")
        .when(~style & F.col("rule").isin(*EXCEPTION_RULES), "collection-exception").otherwise("code-format"))
    out = findings.select("file", "line", short.alias("rule"), severity.alias("severity"), category.alias("category"), "tool", "message")
    if owners is None:
        return out.withColumn("package", F.lit("UNKNOWN"))
    return out.join(owners.select("file", "package"), "file", "left").withColumn("package", F.coalesce("package", F.lit("UNKNOWN")))


def line_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Files and lines of a corpus."""
    return docs.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.size(F.split(text, "\n"))), F.lit(0)).alias("lines"))


def line_ratio(a: DataFrame, b: DataFrame, text: str = "text") -> DataFrame:
    """Line counts of two corpora and their ratio b/a (two decimals, 0 if a is empty)."""
    left = line_stats(a, text).select(F.col("lines").alias("a_lines"), F.col("files").alias("a_files"), F.lit(1).alias("__one"))
    right = line_stats(b, text).select(F.col("lines").alias("b_lines"), F.col("files").alias("b_files"), F.lit(1).alias("__one"))
    ratio = F.floor(F.col("b_lines").cast("double") / F.col("a_lines") * 100 + 0.5) / 100
    return left.join(right, "__one").drop("__one").withColumn("ratio", F.when(F.col("a_lines") > 0, ratio).otherwise(0.0))


def select_by_signals(docs: DataFrame, signals: Mapping[str, str], key: Sequence[str] = ("doc_id",), text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents with at least one signal and which, how many were skipped)."""
    flags = F.array_compact(F.array(*[F.when(F.regexp(F.col(text), line_pattern(p)), F.lit(n)) for n, p in signals.items()]))
    marked = docs.select(*key, flags.alias("signals"))
    return marked.filter(F.size("signals") > 0), marked.agg(F.count_if(F.size("signals") == 0).alias("skipped"))
