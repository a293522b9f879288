"""Graph and text jobs over the test tables."""

from pyspark.sql import functions as F

from millrace.operators import corpus, graph
from millrace.plans.catalog import query

_DOTTED = graph.DOTTED_NAME.replace("{", "{{").replace("}", "}}")


@query("extract_references", "src_doc:l target:s",
       f"""WITH k AS (SELECT DISTINCT upper(regexp_extract(url, '^https?://([^/]+)', 1)) AS name FROM pages),
           x AS (SELECT page_id, url || ' ' || html AS text FROM pages)
           SELECT DISTINCT page_id AS src_doc, target FROM (SELECT page_id, upper(unnest(regexp_extract_all(text, '{_DOTTED}'))) AS target FROM x) WHERE target IN (SELECT name FROM k)""")
def _(b):
    known = b.pages.select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("name"))
    docs = b.pages.select(F.col("page_id").alias("doc_id"), F.concat("url", F.lit(" "), "html").alias("text"))
    return graph.extract_references(docs, known)


_REACH = "reach AS (SELECT node FROM {nodes} WHERE w = 8 UNION SELECT e.dst FROM reach r JOIN {edges} e ON e.src = r.node)"
_GE = """ge AS (SELECT DISTINCT a.grp AS src, b.grp AS dst FROM {edges} e JOIN {nodes} a ON a.node = e.src JOIN {nodes} b ON b.node = e.dst WHERE a.grp <> b.grp
   UNION SELECT DISTINCT grp, grp + 1 FROM {nodes} WHERE w = 9)"""


def entries(b):
    return b.nodes.filter("w = 8").select("node")


def group_edges(b):
    rolled = graph.rollup_edges(b.edges, b.nodes).toDF("src", "dst")
    return rolled.unionByName(b.nodes.filter("w = 9").select(F.col("grp").alias("src"), (F.col("grp") + 1).alias("dst"))).distinct()


@query("reachable", "node:l", f"WITH {_REACH} SELECT node FROM reach")
def _(b):
    return graph.reachable(b.edges, entries(b))


@query("group_closure", "grp:l reference_only:b",
       f"""WITH {_REACH}, {_GE}, called AS (SELECT DISTINCT n.grp FROM reach r JOIN {{nodes}} n ON n.node = r.node),
           g AS (SELECT grp FROM called UNION SELECT ge.dst FROM g JOIN ge ON ge.src = g.grp)
           SELECT grp, grp NOT IN (SELECT grp FROM called) AS reference_only FROM g""")
def _(b):
    return graph.group_closure(b.edges, group_edges(b), entries(b), b.nodes)


@query("rollup_edges", "src_group:l dst_group:l",
       """SELECT DISTINCT a.grp AS src_group, b.grp AS dst_group FROM {edges} e JOIN (SELECT node, w % 7 AS grp FROM {nodes}) a ON a.node = e.src
            JOIN (SELECT node, w % 7 AS grp FROM {nodes}) b ON b.node = e.dst WHERE a.grp <> b.grp""")
def _(b):
    return graph.rollup_edges(b.edges, b.nodes.select("node", (F.col("w") % 7).alias("grp")))


_SCC = """pairs AS (SELECT src, dst FROM {edges} UNION SELECT p.src, e.dst FROM pairs p JOIN {edges} e ON e.src = p.dst),
  scc AS (SELECT n.node, LEAST(n.node, COALESCE(MIN(p.dst), n.node)) AS component FROM {nodes} n
            LEFT JOIN (SELECT p.src, p.dst FROM pairs p JOIN pairs q ON q.src = p.dst AND q.dst = p.src) p ON p.src = n.node GROUP BY n.node)"""


@query("strongly_connected", "node:l component:l", f"WITH {_SCC} SELECT * FROM scc")
def _(b):
    return graph.strongly_connected(b.nodes, b.edges)


@query("topo_levels", "node:l component:l level:l",
       f"""WITH {_SCC}, dag AS (SELECT DISTINCT a.component AS a, b.component AS b FROM {{edges}} e JOIN scc a ON a.node = e.src JOIN scc b ON b.node = e.dst WHERE a.component <> b.component),
           walk AS (SELECT component AS c, 0 AS level FROM (SELECT DISTINCT component FROM scc) UNION SELECT d.a, w.level + 1 FROM walk w JOIN dag d ON d.b = w.c)
           SELECT s.node, s.component, MAX(w.level) AS level FROM scc s JOIN walk w ON w.c = s.component GROUP BY 1, 2""")
def _(b):
    return graph.topo_levels(b.nodes, b.edges)


@query("disambiguate_names", "p_partkey:l ref_name:s",
       """SELECT p_partkey, CASE WHEN COUNT(*) OVER (PARTITION BY p_brand, p_name) > 1
              THEN p_name || '__' || ROW_NUMBER() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) ELSE p_name END AS ref_name FROM part""")
def named(b):
    return graph.disambiguate_names(b.part, ["p_brand"], "p_name", "p_partkey")


_IDX = """idx AS (SELECT p_partkey, 'S' || (ascii(right(p_brand, 1)) % 3) || '.' || replace(p_brand, '#', '_') AS grp, replace(p_name, ' ', '_') AS name,
      replace(CASE WHEN COUNT(*) OVER (PARTITION BY p_brand, p_name) > 1 THEN p_name || '__' || ROW_NUMBER() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) ELSE p_name END, ' ', '_') AS ref_name FROM part)"""


@query("resolve_references", "caller_group:s caller_ref:s line:l target_group:s target_ref:s",
       f"""WITH {_IDX},
           refs AS (SELECT upper(c.grp) AS cg, upper(c.ref_name) AS cr, c.p_partkey % 5 AS line, split_part(upper(c.grp), '.', 1) AS cs, upper(t.grp) AS tg, upper(t.name) AS tn, c.p_partkey % 4 AS form
                      FROM idx c JOIN idx t ON t.p_partkey = CASE WHEN c.p_partkey % 8 = 0 THEN c.p_partkey ELSE (c.p_partkey * 7 + 3) % (SELECT MAX(p_partkey) + 1 FROM part) END),
           tgt AS (SELECT cg, cr, line, CASE WHEN form = 0 THEN cg WHEN form = 1 THEN cs || '.' || split_part(tg, '.', 2) ELSE tg END AS g, tn FROM refs WHERE NOT (form = 0 AND tn = 'RED_GEAR'))
           SELECT DISTINCT cg AS caller_group, cr AS caller_ref, line, g AS target_group, upper(i.ref_name) AS target_ref
             FROM tgt JOIN idx i ON upper(i.grp) = g AND upper(i.name) = tn WHERE NOT (g = cg AND upper(i.ref_name) = cr)""")
def _(b):
    snake = lambda c: F.regexp_replace(c, " ", "_")
    schema = F.concat(F.lit("S"), (F.ascii(F.substring("p_brand", -1, 1)) % 3).cast("string"), F.lit("."), F.regexp_replace("p_brand", "#", "_"))
    idx = named(b).select("p_partkey", schema.alias("grp"), snake("p_name").alias("name"), snake("ref_name").alias("ref_name"))
    n = b.part.agg(F.max("p_partkey") + 1).scalar()
    target = F.when(F.col("p_partkey") % 8 == 0, F.col("p_partkey")).otherwise((F.col("p_partkey") * 7 + 3) % n)
    callers = idx.select(F.col("p_partkey").alias("k"), F.col("grp").alias("caller_group"), F.col("ref_name").alias("caller_ref"), target.alias("p_partkey"))
    both = callers.join(idx.select("p_partkey", "grp", "name"), "p_partkey")
    ref = (F.when(F.col("k") % 4 == 0, F.col("name"))
           .when(F.col("k") % 4 == 1, F.concat(F.lit('"'), F.lower(F.substring_index("grp", ".", -1)), F.lit('".'), "name"))
           .otherwise(F.concat("grp", F.lit("."), "name")))
    return graph.resolve_references(both.select("caller_group", "caller_ref", (F.col("k") % 5).alias("line"), ref.alias("ref")), idx, ["RED_GEAR"])


@query("mixed_closure", "node:l via:s",
       f"""WITH {_REACH}, re AS (SELECT p_partkey AS src, (p_partkey * 3 + 1) % (SELECT MAX(p_partkey) + 1 FROM part) AS dst FROM part)
           SELECT node, 'call' AS via FROM reach UNION ALL
           SELECT DISTINCT re.dst, 'reference' FROM reach r JOIN re ON re.src = r.node WHERE re.dst NOT IN (SELECT node FROM reach)""")
def _(b):
    n = b.part.agg(F.max("p_partkey") + 1).scalar()
    refs = b.part.select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 3 + 1) % n).alias("dst"))
    return graph.mixed_closure(b.edges, refs, entries(b))


_TOK = r"regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')".replace("{{", "{").replace("}}", "}")


@query("duplicate_blocks", "doc_id:l position:l tokens:l doc_count:l occurrences:l",
       f"""WITH t AS (SELECT doc_id, {_TOK} AS t FROM documents),
           b AS (SELECT doc_id, i AS position, array_to_string(t[i + 1:i + 20], ' ') AS blk FROM (SELECT doc_id, t, unnest(range(len(t) - 19)) AS i FROM t WHERE len(t) >= 20)),
           s AS (SELECT blk, COUNT(DISTINCT doc_id) AS doc_count, COUNT(*) AS occurrences FROM b GROUP BY blk HAVING COUNT(DISTINCT doc_id) > 1)
           SELECT b.doc_id, b.position, 20 AS tokens, s.doc_count, s.occurrences FROM b JOIN s ON s.blk = b.blk""")
def _(b):
    return corpus.duplicate_blocks(b.documents, 20)


@query("duplicate_spans", "doc_id:l start:l tokens:l sources:l occurrences:l first_doc:l first_position:l",
       f"""WITH t AS (SELECT doc_id, {_TOK} AS t FROM documents),
           b AS (SELECT doc_id, i AS position, array_to_string(t[i + 1:i + 20], ' ') AS blk FROM (SELECT doc_id, t, unnest(range(len(t) - 19)) AS i FROM t WHERE len(t) >= 20)),
           s AS (SELECT blk, COUNT(DISTINCT doc_id) AS sources, COUNT(*) AS occurrences FROM b GROUP BY blk HAVING COUNT(DISTINCT doc_id) > 1),
           h AS (SELECT b.doc_id, b.position, b.blk, s.sources, s.occurrences FROM b JOIN s ON s.blk = b.blk),
           n AS (SELECT h.blk, p.blk AS prev, x.blk AS nxt FROM h LEFT JOIN h p ON p.doc_id = h.doc_id AND p.position = h.position - 1
                   LEFT JOIN h x ON x.doc_id = h.doc_id AND x.position = h.position + 1),
           c AS (SELECT blk, CASE WHEN COUNT(prev) = COUNT(*) AND MIN(prev) = MAX(prev) THEN MIN(prev) END AS prev,
                        CASE WHEN COUNT(nxt) = COUNT(*) AND MIN(nxt) = MAX(nxt) THEN MIN(nxt) END AS nxt FROM n GROUP BY blk),
           i AS (SELECT c.blk FROM c JOIN c p ON p.blk = c.prev AND p.nxt = c.blk),
           z AS (SELECT h.*, SUM(CASE WHEN i.blk IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY h.doc_id ORDER BY h.position) AS no FROM h LEFT JOIN i ON i.blk = h.blk),
           sp AS (SELECT doc_id, MIN(position) AS start, COUNT(*) + 19 AS tokens, ARG_MIN(blk, position) AS blk, MIN(sources) AS sources, MIN(occurrences) AS occurrences FROM z GROUP BY doc_id, no)
           SELECT doc_id, start, tokens, sources, occurrences, FIRST_VALUE(doc_id) OVER w AS first_doc, FIRST_VALUE(start) OVER w AS first_position
             FROM sp WINDOW w AS (PARTITION BY blk ORDER BY doc_id, start)""")
def _(b):
    return corpus.duplicate_spans(b.documents, 20)


@query("apply_dup_rules", "group_id:s packages:l sources:l suggested:b forced:b skip_reason:s",
       """WITH g AS (SELECT MIN(doc_id) OVER (PARTITION BY text) AS group_id, source AS package, 'D' || doc_id AS cls FROM documents),
          idx AS (SELECT source AS package, 'D' || doc_id AS cls FROM documents UNION ALL SELECT 'pages', 'P' || page_id FROM pages),
          r AS (SELECT CASE WHEN toxic = 1 THEN 'exclude' ELSE 'force' END AS action, 'D' || doc_id AS cls, 'label ' || doc_id AS reason FROM labels WHERE toxic = 1 OR quality = 0
               UNION ALL SELECT 'force', 'P' || doc_id, 'page ' || doc_id FROM labels WHERE quality = 0),
          p AS (SELECT group_id, COUNT(DISTINCT package) AS packages, COUNT(*) AS sources FROM g GROUP BY 1),
          h AS (SELECT group_id, MAX(CASE WHEN action = 'force' THEN 1 END) AS f, MIN(CASE WHEN action = 'exclude' THEN reason END) AS x FROM g JOIN r ON r.cls = g.cls GROUP BY 1)
          SELECT CAST(p.group_id AS VARCHAR) AS group_id, packages, sources, CASE WHEN f IS NOT NULL THEN TRUE WHEN x IS NOT NULL THEN FALSE ELSE packages >= 2 END AS suggested,
                 f IS NOT NULL AS forced, CASE WHEN f IS NOT NULL THEN NULL WHEN x IS NOT NULL THEN 'user-excluded: ' || x WHEN packages < 2 THEN 'single-package' END AS skip_reason
            FROM p LEFT JOIN h ON h.group_id = p.group_id
          UNION ALL SELECT 'force-' || cls, COUNT(DISTINCT package), COUNT(*), TRUE, TRUE, NULL FROM idx WHERE cls IN (SELECT cls FROM r WHERE action = 'force') AND cls NOT IN (SELECT cls FROM g) GROUP BY cls""")
def _(b):
    file = F.concat(F.lit("src/"), "lang", F.lit("/D"), F.col("doc_id").cast("string"), F.lit(".java"))
    docs = b.documents.select("doc_id", "text", F.col("source").alias("package"), file.alias("file"), "lang")
    ids = docs.groupBy("text").agg(F.min("doc_id").alias("group_id"))
    groups = docs.join(ids, "text").select("group_id", "package", "file")
    rules = b.labels.filter("toxic = 1 OR quality = 0").select(
        F.when(F.col("toxic") == 1, "exclude").otherwise("force").alias("action"), F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("class_name"),
        F.concat(F.lit("label "), F.col("doc_id").cast("string")).alias("reason"))
    page = F.concat(F.lit("P"), F.col("doc_id").cast("string"))
    rules = rules.unionByName(b.labels.filter("quality = 0").select(
        F.lit("force").alias("action"), page.alias("class_name"), F.concat(F.lit("page "), F.col("doc_id").cast("string")).alias("reason")))
    pages = b.pages.select(F.lit("pages").alias("package"), F.concat(F.lit("web/P"), F.col("page_id").cast("string"), F.lit(".html")).alias("file"))
    return corpus.apply_dup_rules(groups, rules, docs.select("package", "file").unionByName(pages))


# Statement and control-flow patterns, anchored at line starts.
STATEMENTS = {
    "selects": r"^\s*SELECT\b", "inserts": r"^\s*INSERT\s+INTO\b", "updates": r"^\s*UPDATE\b", "deletes": r"^\s*DELETE\b",
    "merges": r"^\s*MERGE\b", "ifs": r"^\s*IF\b", "loops": r"^\s*(FOR|WHILE|LOOP)\b", "returns": r"^\s*RETURN\b", "todos": r"TODO",
}
WORDS = {"the_lines": r"^\s*the\b", "and_words": r"\band\b", "digits": r"[0-9]+"}
_PATTERNS = {**STATEMENTS, **WORDS}


@query("pattern_counts", "doc_id:l " + " ".join(f"{n}:l" for n in _PATTERNS),
       "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '(?im){p}')) AS {n}" for n, p in _PATTERNS.items()) + " FROM documents")
def _(b):
    return corpus.pattern_counts(b.documents.select("doc_id", "text"), _PATTERNS)


@query("cosine_similarity", "vec_id:l similarity:d",
       """SELECT a.vec_id, ROUND(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
            FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(b):
    e = b.embeddings
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(other, "vec_id").select("vec_id", F.round(corpus.cosine_similarity(F.col("embedding"), F.col("next")), 6).alias("similarity"))


_COV = """want AS (SELECT DISTINCT c_custkey AS k FROM customer), have AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')"""


@query("coverage", "total:l covered:l score:l",
       f"""WITH {_COV} SELECT COUNT(*) AS total, COUNT(h.k) AS covered, FLOOR(COUNT(h.k) * 100.0::DOUBLE / COUNT(*) + 0.5) AS score FROM want LEFT JOIN have h ON h.k = want.k""")
def _(b):
    have = b.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    return corpus.coverage(b.customer.select(F.col("c_custkey").alias("k")), have, "k")[0]


@query("coverage_missing", "k:l", f"WITH {_COV} SELECT k FROM want WHERE k NOT IN (SELECT k FROM have)")
def _(b):
    have = b.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    return corpus.coverage(b.customer.select(F.col("c_custkey").alias("k")), have, "k")[1]


@query("normalize_findings", "line:l file:s rule:s severity:s category:s tool:s package:s",
       """WITH f AS (SELECT event_id AS line, 'f' || user_id AS file, CASE WHEN event_id % 2 = 0 THEN 'checkstyle' ELSE 'pmd' END AS tool, event_type AS t, user_id % 6 AS lv FROM events)
          SELECT line, f.file, CASE tool WHEN 'checkstyle' THEN CASE t WHEN 'click' THEN 'MethodName' ELSE 'LineLength' END
                   ELSE CASE t WHEN 'click' THEN 'EmptyCatchBlock' WHEN 'view' THEN 'CloseResource' ELSE 'UnusedLocalVariable' END END AS rule,
                 CASE tool WHEN 'checkstyle' THEN CASE lv WHEN 0 THEN 'major' WHEN 1 THEN 'minor' ELSE 'info' END
                   ELSE CASE lv WHEN 1 THEN 'critical' WHEN 2 THEN 'major' WHEN 3 THEN 'minor' ELSE 'info' END END AS severity,
                 CASE WHEN tool = 'checkstyle' AND t = 'click' THEN 'naming-convention' WHEN tool = 'pmd' AND t IN ('click', 'view') THEN 'collection-exception' ELSE 'code-format' END AS category,
                 tool, COALESCE(s_name, 'UNKNOWN') AS package FROM f LEFT JOIN supplier ON 'f' || s_suppkey = f.file""")
def _(b):
    style = F.col("event_id") % 2 == 0
    rule = (F.when(style & (F.col("event_type") == "click"), "com.tool.checks.naming.MethodNameCheck").when(style, "com.tool.checks.sizes.LineLengthCheck")
            .when(F.col("event_type") == "click", "EmptyCatchBlock").when(F.col("event_type") == "view", "CloseResource").otherwise("UnusedLocalVariable"))
    lv = F.col("user_id") % 6
    level = F.when(style, F.when(lv == 0, "error").when(lv == 1, "warning").otherwise("info")).otherwise(lv.cast("string"))
    rows = b.events.select(
        F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"), F.col("event_id").alias("line"), rule.alias("rule"), level.alias("level"),
        F.lit("m").alias("message"), F.when(style, "checkstyle").otherwise("pmd").alias("tool"))
    owners = b.supplier.select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("file"), F.col("s_name").alias("package"))
    return corpus.normalize_findings(rows, owners)


@query("line_stats", "a_files:l a_lines:l b_files:l b_lines:l ratio:d",
       r"""WITH a AS (SELECT COUNT(*) AS f, SUM(len(string_split(text, chr(10)))) AS l FROM documents), b AS (SELECT COUNT(*) AS f, SUM(len(string_split(text, chr(10)))) AS l FROM benchmark)
          SELECT a.f AS a_files, a.l AS a_lines, b.f AS b_files, b.l AS b_lines, FLOOR(CAST(b.l AS DOUBLE) / a.l * 100 + 0.5) / 100 AS ratio FROM a, b""")
def _(b):
    return corpus.line_ratio(b.documents, b.benchmark)


_SIG = {"digits": "[0-9][0-9][0-9]", "email": "[a-z]+@[a-z]+", "license": r"\blicense\b", "exclaim": "!!"}
_SIGSQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?im){p}') THEN '{n}' END" for n, p in _SIG.items()) + "], lambda x: x IS NOT NULL)"


@query("select_by_signals", "doc_id:l signals:s", f"SELECT doc_id, array_to_string(s, ',') AS signals FROM (SELECT doc_id, {_SIGSQL} AS s FROM documents) WHERE len(s) > 0")
def _(b):
    return corpus.select_by_signals(b.documents, _SIG)[0].withColumn("signals", F.array_join("signals", ","))


@query("select_by_signals_skipped", "skipped:l", f"SELECT COUNT(*) AS skipped FROM (SELECT {_SIGSQL} AS s FROM documents) WHERE len(s) = 0")
def _(b):
    return corpus.select_by_signals(b.documents, _SIG)[1]
