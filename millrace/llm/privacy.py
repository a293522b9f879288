"""Information-theoretic sanitisation of personal data, in DataFrame expressions only.

Base entities are found by pattern: e-mail addresses, IP addresses (parts at most 255),
card numbers (16 to 19 digits passing Luhn) and phone numbers (8 to 15 digits), leftmost
and non-overlapping per kind; matches that fail their test are dropped. Offsets are code
points. The patterns use possessive repeats and start guards that change no match but
keep the matching linear on long runs.

Terms can reveal an entity too. The context is the line. Over all lines of all documents,
with p as shares of lines, the disclosure of entity e by term t is
PMI(e, t) / IC(e) = ln(p(e, t) / (p(e) p(t))) / -ln p(e) = 1 + ln p(e | t) / -ln p(e): 1 if
t occurs in lines of e only, 0 if independent. Every entity and every term of its lines is
judged, from one line on. p(e | t) is smoothed by ``smoothing`` further lines of t that hold
e as often as any line does, so a term of one line counts for less than one of many. In a
line with e (``scope="document"``: in all lines of a document with e, whether they hold e or
not), terms at or above ``remove`` are removed, those at or above ``generalise``
replaced by a general label; terms within a base entity stay with it. Kinds of entities
are not judged, as the labels in the text name them.

Null and empty texts have no entities. Repeated rows are counted each and get equal
results. Other columns are carried along; columns called entities or sanitised are
replaced. A text of n matches takes about n log n steps: offsets are running sums over arrays,
and terms are taken once per line. Line, term and pair counts combine map-side; revealing terms meet their places
by term first and then by line or document and entity, so that no place pairs all its entities with all its terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import keep
from millrace.operators.common import small_side

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": "[0-9][.][0-9]", "card": "[0-9](?:[ -]?[0-9]){3}", "phone": "[+][0-9]"}  # cheap necessary conditions
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "gone": ""}
TERM = r"\p{L}{3,}"
CHUNK = 512  # code points
_FAR = 2**31 - 1


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(value, "[.]"), lambda p: F.when(F.length(short(p)) <= 3, short(p).cast("int") <= 255).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    if kind == "card":
        digits = F.filter(F.split(F.reverse(F.regexp_replace(value, "[ -]", "")), ""), lambda d: d != "")
        weighed = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
        return F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10 == 0
    return F.lit(True)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: a lambda variable is bound, a column is copied to each place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, combine) -> Column:
    """Running ``combine`` (sum, greatest, least) of an array of ints, in about log2(size) passes over it."""
    step = lambda a, n: F.transform(a, lambda x, i: F.when(i < n, x).otherwise(combine(x, F.get(a, i - n))))
    return _let(values, lambda v: F.aggregate(F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda n: n < F.size(v)), v, step))


def _valid_spans(kind: str, matches: Column, gaps: Column) -> Column:
    """(kind, start, end, value) of the valid matches; ``gaps`` are the texts around them."""

    def spans(m):
        ends = _running(F.zip_with(m, F.slice(gaps, F.lit(1), F.size(m)), lambda x, g: F.length(g) + F.length(x)), lambda x, y: x + y)
        return F.zip_with(m, ends, lambda x, end: F.struct(F.lit(kind).alias("kind"), (end - F.length(x)).alias("start"), end.alias("end"), x.alias("value")))

    return F.filter(_let(matches, spans), lambda s: _valid(kind, s["value"]))


def _with_matches(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Adds the valid matches of each kind in ``text`` as arrays of (kind, start, end, value)."""
    none = F.array().cast("array<string>")
    found = {}
    for k in KINDS:
        there = F.col(text).rlike(HINTS[k])
        found[f"__m_{k}"] = F.when(there, F.regexp_extract_all(F.col(text), F.lit(PATTERNS[k]), F.lit(0))).otherwise(none)
    df = df.withColumns(found)
    df = df.withColumns({f"__g_{k}": F.when(F.size(f"__m_{k}") > 0, F.split(F.col(text), PATTERNS[k], -1)).otherwise(none) for k in KINDS})
    out = {f"{prefix}{k}": _valid_spans(k, F.col(f"__m_{k}"), F.col(f"__g_{k}")) for k in KINDS}
    return df.withColumns(out).drop(*found, *(f"__g_{k}" for k in KINDS))


def _revealing_terms(entity_lines: DataFrame, texts: DataFrame, smoothing: float, generalise: float, remove: float) -> DataFrame:
    """(entity_kind, entity, term, removed): terms at or above the thresholds, over all lines of ``texts``."""
    all_lines = texts.select(F.explode(F.split("text", "\n", -1)).alias("line"))
    n_lines = all_lines.agg(F.count(F.lit(1)).alias("n_lines"))
    per_entity = _by_entity(entity_lines).groupBy("entity_kind", "entity").agg(F.count(F.lit(1)).alias("with_entity"))
    terms = F.array_distinct(F.regexp_extract_all(F.regexp_replace("line", PATTERNS["email"], " "), F.lit(TERM), F.lit(0)))
    one = _by_entity(entity_lines.select("found", F.explode(terms).alias("term")), "term")
    pairs = one.groupBy("entity_kind", "entity", "term").agg(F.count(F.lit(1)).alias("with_both"))
    pairs = keep(pairs, "entity-terms")
    in_line = F.array_distinct(F.regexp_extract_all("line", F.lit(TERM), F.lit(0)))
    with_term = all_lines.select(F.explode(in_line).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("with_term"))
    scored = pairs.join(per_entity, ["entity_kind", "entity"]).join(with_term, "term").crossJoin(F.broadcast(n_lines))  # one row
    share = F.col("with_entity") / F.col("n_lines")
    given_term = (F.col("with_both") + smoothing * share) / (F.col("with_term") + smoothing)
    disclosed = F.when(share < 1, 1 - F.log(given_term) / F.log(share)).otherwise(F.lit(0.0))
    return scored.withColumn("disclosure", disclosed).where(F.col("disclosure") >= generalise - 1e-12).select("entity_kind", "entity", "term", (F.col("disclosure") >= remove - 1e-12).alias("removed"))


def _by_entity(lines: DataFrame, *columns: str) -> DataFrame:
    """(*columns, entity_kind, entity): one row per line and entity in it."""
    values = lambda k: F.array_distinct(F.transform(F.filter("found", lambda s: s["kind"] == k), lambda s: s["value"]))
    entities = F.concat(*[F.transform(values(k), lambda v, k=k: F.struct(F.lit(k).alias("kind"), v.alias("value"))) for k in KINDS])
    return lines.select(*columns, F.explode(entities).alias("e")).select(*columns, F.col("e.kind").alias("entity_kind"), F.col("e.value").alias("entity"))


def _term_spans(lines: DataFrame, entity_lines: DataFrame, revealing: DataFrame, place: list[str]) -> DataFrame:
    """(doc_id, text_hash, terms): spans in ``lines`` of the terms that reveal an entity of the same ``place`` (line or document)."""
    any_entity = small_side(revealing.select("term").distinct())
    words = lines.withColumns({"words": F.regexp_extract_all("line", F.lit(TERM), F.lit(0)), "gaps": F.split("line", TERM, -1)})
    words = words.select("doc_id", "text_hash", "line_no", "line_start", F.explode(_valid_spans("term", F.col("words"), F.col("gaps"))).alias("w"))
    words = words.select("doc_id", "text_hash", "line_no", F.col("w.value").alias("term"), *[(F.col("line_start") + F.col(f"w.{c}")).cast("int").alias(c) for c in ("start", "end")])
    words = keep(words.join(any_entity, "term", "left_semi"), "line-terms")
    # from the term to its entities, so that a place of E entities and T terms makes no E x T pairs
    met = words.select(*place, "term").distinct().join(revealing, "term")
    hits = met.join(_by_entity(entity_lines, *place), [*place, "entity_kind", "entity"], "left_semi").groupBy(*place, "term").agg(F.max("removed").alias("removed"))
    spans = words.join(hits, [*place, "term"]).select("doc_id", "text_hash", F.struct(
        F.when(F.col("removed"), "gone").otherwise("term").alias("kind"), "start", "end", F.col("term").alias("value")).alias("s"))
    return spans.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("s")).alias("terms"))


def _clear_of(terms: Column, base: Column) -> Column:
    """The ``terms`` that overlap no span of ``base``."""
    mark = lambda spans, is_term: F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(is_term).alias("is_term"), s["end"].alias("end"), s.alias("span")))

    def judged(ordered):
        end_before = _running(F.transform(ordered, lambda s: F.when(s["is_term"], 0).otherwise(s["end"])), F.greatest)
        start_after = F.reverse(_running(F.reverse(F.transform(ordered, lambda s: F.when(s["is_term"], _FAR).otherwise(s["start"]))), F.least))
        around = F.zip_with(end_before, start_after, lambda e, n: F.struct(e.alias("end_before"), n.alias("start_after")))
        return F.zip_with(ordered, around, lambda s, w: F.struct(
            s["span"].alias("span"), (s["is_term"] & (w["end_before"] <= s["start"]) & (w["start_after"] >= s["end"])).alias("clear")))

    both = _let(F.array_sort(F.concat(mark(base, False), mark(terms, True))), judged)
    return F.transform(F.filter(both, lambda s: s["clear"]), lambda s: s["span"])


def _sanitised(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its label; overlapping spans are one, under the first label.

    The kept stretches are cut from chunks of the text, so a cut does not count its code points from the start.
    """
    label = lambda kind: F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in LABELS.items()])
    last = F.struct(F.length(text).alias("start"), F.lit(_FAR).alias("end"), F.lit("gone").alias("kind"))  # ends the last stretch
    ordered = F.concat(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), F.array(last))

    def pieces(spans_in_order):
        done = _running(F.concat(F.array(F.lit(0)), F.transform(spans_in_order, lambda s: s["end"])), F.greatest)
        return F.filter(F.zip_with(spans_in_order, F.slice(done, F.lit(1), F.size(spans_in_order)), lambda s, at: F.struct(
            at.alias("at"), s["start"].alias("upto"), s["kind"].alias("kind"))), lambda p: p["upto"] >= p["at"])

    chunks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))
    first = lambda p: F.floor(p["at"] / CHUNK).cast("int")

    def stretch(all_chunks, p):
        covered = F.slice(all_chunks, first(p) + 1, F.ceil(p["upto"] / CHUNK).cast("int") - first(p))
        return F.array_join(F.transform(covered, lambda c, i: F.substring(
            c, F.greatest(p["at"] - (first(p) + i) * CHUNK, F.lit(0)) + 1,
            F.least(p["upto"] - (first(p) + i) * CHUNK, F.lit(CHUNK)) - F.greatest(p["at"] - (first(p) + i) * CHUNK, F.lit(0)))), "")

    return _let(chunks, lambda all_chunks: F.array_join(F.transform(_let(ordered, pieces), lambda p: F.concat(
        F.when(p["upto"] > p["at"], stretch(all_chunks, p)).otherwise(F.lit("")), label(p["kind"]))), ""))


def sanitise(docs: DataFrame, smoothing: float = 1.0, generalise: float = 0.8, remove: float = 0.95, id_col: str = "doc_id", text_col: str = "text", scope: str = "line") -> DataFrame:
    """``docs`` with entities (arrays email, ip, card, phone and terms of (kind, start, end, value)) and sanitised (the text).

    ``scope`` says where a term that reveals e is hidden: in each "line" with e, or in every line of a "document" with e.
    """
    if scope not in ("line", "document"):
        raise ValueError("scope must be line or document")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    full = docs.drop("entities", "sanitised")
    place = F.struct(F.col(id_col).alias("id"))  # null ids are equal to each other in here
    rows = full.select(place.alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    any_hint = F.col("text").rlike("|".join(HINTS.values()))
    found = _with_matches(rows.where(any_hint), "text").where(F.greatest(*[F.size(k) for k in KINDS]) > 0)
    found = keep(found, "entity-documents")
    before = Window.partitionBy("doc_id", "text_hash", "copy").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    split = lambda texts: texts.withColumn("copy", F.monotonically_increasing_id()).select("doc_id", "text_hash", "copy", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn(
        "line_start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))).drop("copy")
    once = ["doc_id", "text_hash"]
    lines = _with_matches(split(found).where(F.col("line").rlike("|".join(HINTS.values()))), "line", "l_")
    lines = lines.select("doc_id", "text_hash", "line_no", "line", "line_start", F.concat(*[f"l_{k}" for k in KINDS]).alias("found")).where(F.size("found") > 0)
    lines = keep(lines, "lines-with-entities")
    revealing = keep(_revealing_terms(lines, rows, smoothing, generalise, remove), "revealing-terms")
    if scope == "line":
        terms = _term_spans(lines.dropDuplicates([*once, "line_no"]), lines, revealing, [*once, "line_no"])
    else:
        terms = _term_spans(split(found.dropDuplicates(once)), lines, revealing, once)
    terms = keep(terms, "term-spans")
    spans = found.dropDuplicates(once).join(terms, once, "left")
    base = F.concat(*[F.col(k) for k in KINDS])
    clear = _clear_of(F.coalesce("terms", F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")), base)
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.struct(*KINDS, clear.alias("terms")).alias("__found"))
    joined = full.withColumn("__text", text).join(spans.hint("shuffle_hash"), (place == F.col("__id")) & (F.xxhash64("__text") == F.col("__hash")), "left")
    every = F.concat(*[F.col(f"__found.{k}") for k in (*KINDS, "terms")])
    return joined.select(*full.columns, F.col("__found").alias("entities"), F.when(F.col("__found").isNull(), F.col("__text")).otherwise(_sanitised(F.col("__text"), every)).alias("sanitised"))


def span_list(*arrays: Column) -> Column:
    """kind:start:end of all spans of the arrays, comma-joined."""
    return F.coalesce(F.array_join(F.transform(F.concat(*arrays), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit(""))
