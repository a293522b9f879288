"""Graph operators over an edge table (src, dst). All are loops of joins, one
round per hop or layer; the driver only sees whether a round changed anything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.common import union_all
from millrace.operators.ordered import row_numbers
from millrace.session import materialize, materialize_counted

# Hops taken in one job between two writes of the frontier.
HOPS_PER_JOB = 3

# Fixed value: a dotted name of two or more identifier parts.
DOTTED_NAME = r"[A-Za-z_][A-Za-z0-9_$#]*(?:\.[A-Za-z_][A-Za-z0-9_$#]*)+"


def extract_references(corpus: DataFrame, known: DataFrame) -> DataFrame:
    """(src_doc, target) for every dotted name in the text that is a known name.

    ``corpus``: doc_id, text. ``known``: name. Comparison ignores case. Names are
    made distinct per document before the shuffle.
    """
    names = F.array_distinct(F.transform(
        F.regexp_extract_all("text", F.lit(DOTTED_NAME), F.lit(0)), lambda x: F.upper(x)))
    found = corpus.select(F.col("doc_id").alias("src_doc"), F.explode(names).alias("target"))
    return found.join(known.select(F.upper("name").alias("target")).distinct(), "target", "left_semi").select("src_doc", "target")


def reachable(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Nodes reachable from ``entries`` (node), entries included; cycles are fine."""
    links = materialize(edges.select("src", "dst").distinct(), "links")
    front, count = materialize_counted(entries.select("node").distinct(), "reach")
    seen = [front]
    while count:
        hop, hops = front, []
        for _ in range(HOPS_PER_JOB):
            hop = hop.join(links, hop["node"] == links["src"]).select(F.col("dst").alias("node")).distinct()
            hops.append(hop)
        # Later hops start from all of the hop before; nodes seen earlier drop out here.
        fresh = union_all(hops).distinct().join(union_all(seen), "node", "left_anti")
        front, count = materialize_counted(fresh, "reach")
        seen.append(front)
    return union_all(seen)


def group_closure(edges: DataFrame, group_edges: DataFrame, entries: DataFrame, node_group: DataFrame) -> DataFrame:
    """Groups in scope, flagged as reached by calls or by reference only."""
    reached = reachable(edges, entries).join(node_group, "node").select(F.col("grp").alias("node")).distinct()
    reached = materialize(reached, "groups")
    every = reachable(group_edges, reached)
    return every.join(reached.withColumn("hit", F.lit(True)), "node", "left").select(
        F.col("node").alias("grp"), F.coalesce(~F.col("hit"), F.lit(True)).alias("reference_only"))


def rollup_edges(edges: DataFrame, node_group: DataFrame) -> DataFrame:
    """Distinct group edges without self loops."""
    src = node_group.select(F.col("node").alias("src"), F.col("grp").alias("src_group"))
    dst = node_group.select(F.col("node").alias("dst"), F.col("grp").alias("dst_group"))
    return edges.join(src, "src").join(dst, "dst").filter("src_group <> dst_group").select("src_group", "dst_group").distinct()


def _inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes``."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(
        nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def strongly_connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Component per node, named by its smallest member; a self loop is a singleton.

    Nodes without incoming or outgoing edges are peeled off first. On the rest,
    every node takes the smallest id that reaches it; the nodes of one colour
    that also reach the colour's own node form a component.
    """
    rest, left = materialize_counted(nodes.select("node").distinct(), "nodes")
    links = materialize(_inside(edges.filter("src <> dst").select("src", "dst").distinct(), rest), "links")
    done = []
    while True:
        while True:
            core = rest
            for _ in range(HOPS_PER_JOB):
                alive = _inside(links, core)
                core = core.join(alive.select(F.col("src").alias("node")), "node", "left_semi").join(
                    alive.select(F.col("dst").alias("node")), "node", "left_semi")
            core, kept = materialize_counted(core, "core")
            peeled, rest_before = left - kept, rest
            rest, left = core, kept
            if not peeled:
                break
            done.append(rest_before.join(core, "node", "left_anti").select("node", F.col("node").alias("component")))
            links = materialize(_inside(links, core), "links")
            # Peeling only saves work, so it stops once it peels little.
            if peeled < left / 10 or not left:
                break
        if not left:
            break
        colour = rest.withColumn("colour", F.col("node"))
        moved = 1
        while moved:
            colour = colour.select("node", "colour", F.col("colour").alias("was"))
            for _ in range(HOPS_PER_JOB):
                pulled = links.join(colour, links["src"] == colour["node"]).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("seen"))
                colour = colour.join(pulled, "node", "left").select("node", F.least("colour", F.coalesce("seen", "colour")).alias("colour"), "was")
            colour, moved = materialize_counted(colour, "colour", F.col("colour") < F.col("was"))
        same = materialize(
            links.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c1")), "src")
            .join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst")
            .filter("c1 = c2").select("src", "dst", F.col("c1").alias("colour")), "same")
        front = colour.filter("node = colour").select("node", "colour")
        found, count = [front], 1
        while count:
            hop, hops = front, []
            for _ in range(HOPS_PER_JOB):
                hop = hop.select(F.col("node").alias("dst")).join(same, "dst").select(F.col("src").alias("node"), "colour").distinct()
                hops.append(hop)
            fresh = union_all(hops).distinct().join(union_all(found).select("node"), "node", "left_anti")
            front, count = materialize_counted(fresh, "back")
            found.append(front)
        group = union_all(found).select("node", F.col("colour").alias("component"))
        done.append(group)
        rest, left = materialize_counted(rest.join(group, "node", "left_anti"), "nodes")
        # The members of a component share a colour: other links cannot matter.
        links = materialize(_inside(same, rest), "links")
    return union_all(done) if done else rest.withColumn("component", F.col("node"))


def topo_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest distance to a leaf; the members of one component share a level.

    A component whose level rose passes it on to the components pointing at it,
    until no level rises: each round works on the changed part only.
    """
    comp = materialize(strongly_connected(nodes, edges), "comp")
    src = comp.select(F.col("node").alias("src"), F.col("component").alias("a"))
    dst = comp.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    links = materialize(edges.join(src, "src").join(dst, "dst").filter("a <> b").select("a", "b").distinct(), "dag")
    risen = comp.select("component").distinct().withColumn("level", F.lit(0))
    rounds, count = [risen], 1
    while count:
        hop, hops = risen, []
        for _ in range(HOPS_PER_JOB):
            hop = links.join(hop, links["b"] == hop["component"]).groupBy(F.col("a").alias("component")).agg(
                (F.max("level") + 1).alias("level"))
            hops.append(hop)
        best = union_all(hops).groupBy("component").agg(F.max("level").alias("level"))
        # A chain of k links into a component gives level k at least, and every
        # hop here is one link longer, so a value seen before is never too high.
        known = union_all(rounds).groupBy("component").agg(F.max("level").alias("had"))
        better = best.join(known, "component").filter("level > had").select("component", "level")
        risen, count = materialize_counted(better, "levels")
        rounds.append(risen)
    top = union_all(rounds).groupBy("component").agg(F.max("level").alias("level"))
    return comp.join(top, "component").select("node", "component", "level")


def disambiguate_names(df: DataFrame, group: Sequence[str], name: str, order: str, out: str = "ref_name") -> DataFrame:
    """Names repeated in a group get ``__1..n`` in ``order``; unique ones stay."""
    key = [*group, name]
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    numbered = row_numbers(df, key, [F.col(order)], "__i").join(counts, key)
    label = F.when(F.col("__n") > 1, F.concat(F.col(name), F.lit("__"), F.col("__i").cast("string"))).otherwise(F.col(name))
    return numbered.withColumn(out, label).drop("__n", "__i")


def resolve_references(refs: DataFrame, index: DataFrame, builtins: Sequence[str] = ()) -> DataFrame:
    """Edges from textual references to known members.

    ``refs``: caller_group (``SCHEMA.PKG`` or ``PKG``), caller_ref, line, ref.
    ``index``: grp, name, ref_name (one row per overload). One part means the
    caller's group, two parts take the caller's schema, three are exact. Unknown
    targets and built-ins drop out; a member does not call itself, but a call by
    name reaches the other overloads.

    References and members are made distinct before they meet, so the pairs, which
    grow with callers x overloads of a name, are not shuffled. Only members that bear
    one ``ref_name`` under several names can give a pair twice.
    """
    parts = F.split(F.upper(F.regexp_replace("ref", '"', "")), r"\.")
    caller = F.upper("caller_group")
    schema = F.when(F.instr(caller, ".") > 0, F.concat(F.substring_index(caller, ".", 1), F.lit("."))).otherwise("")
    n = F.size("p")
    grp = (F.when(n == 1, caller).when(n == 2, F.concat(schema, F.col("p")[0]))
           .when(n == 3, F.concat(F.col("p")[0], F.lit("."), F.col("p")[1])))
    named = refs.withColumn("p", parts).select(
        caller.alias("caller_group"), F.upper("caller_ref").alias("caller_ref"), "line", n.alias("n"), grp.alias("grp"),
        F.element_at("p", -1).alias("name"))
    if builtins:
        named = named.filter(~((F.col("n") == 1) & F.col("name").isin([x.upper() for x in builtins])))
    known = index.select(F.upper("grp").alias("grp"), F.upper("name").alias("name"), F.upper("ref_name").alias("target_ref")).distinct()
    shared = known.groupBy("grp", "target_ref").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("grp", "target_ref")
    shared, count = materialize_counted(shared, "shared-refs")
    named = named.select("caller_group", "caller_ref", "line", "grp", "name").distinct()

    def edges(members: DataFrame) -> DataFrame:
        hit = named.join(members, ["grp", "name"]).filter(
            ~((F.col("grp") == F.col("caller_group")) & (F.col("target_ref") == F.col("caller_ref"))))
        return hit.select("caller_group", "caller_ref", "line", F.col("grp").alias("target_group"), "target_ref")

    if not count:
        return edges(known)
    on = [known["grp"].eqNullSafe(shared["grp"]), known["target_ref"].eqNullSafe(shared["target_ref"])]
    return edges(known.join(shared, on, "left_anti")).unionByName(edges(known.join(shared, on, "left_semi")).distinct())


def mixed_closure(call_edges: DataFrame, ref_edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Call edges followed to the end, reference edges for one hop only.

    A node reached both ways counts as called, so its own calls are followed.
    """
    called = materialize(reachable(call_edges, entries), "called")
    hop = called.join(ref_edges, called["node"] == ref_edges["src"]).select(F.col("dst").alias("node")).distinct()
    return called.withColumn("via", F.lit("call")).unionByName(
        hop.join(called, "node", "left_anti").withColumn("via", F.lit("reference")))
