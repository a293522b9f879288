"""Graph and text operators on literal inputs."""


import random

from millrace.operators import corpus, graph, quality


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_components_and_levels(spark):
    e = edges(spark, ("A", "B"), ("B", "A"), ("B", "C"), ("C", "C"), ("D", "A"), ("C", "E"))
    got = {r.node: (r.component, r.level) for r in graph.topo_levels(nodes(spark, "ABCDE"), e).collect()}
    assert got == {"A": ("A", 2), "B": ("A", 2), "C": ("C", 1), "D": ("D", 3), "E": ("E", 0)}


def test_long_cycle_and_chain(spark):
    ring = [(f"n{i:02d}", f"n{(i + 1) % 12:02d}") for i in range(12)]
    chain = [(f"c{i}", f"c{i + 1}") for i in range(9)]
    names = {x for p in ring + chain for x in p}
    e = edges(spark, *ring, *chain, ("n03", "c0"))
    comp = {r.node: (r.component, r.level) for r in graph.topo_levels(nodes(spark, sorted(names)), e).collect()}
    assert {v for k, v in comp.items() if k.startswith("n")} == {("n00", 10)}
    assert all(comp[f"c{i}"] == (f"c{i}", 9 - i) for i in range(10))
    levels = {k: v[1] for k, v in comp.items()}
    assert all(levels[a] > levels[b] for a, b in chain)


def test_closure_and_reference_only_groups(spark):
    e = edges(spark, ("P.a", "Q.b"), ("Q.b", "P.a"), ("R.c", "P.a"))
    owner = spark.createDataFrame([("P.a", "P"), ("Q.b", "Q"), ("R.c", "R")], "node string, grp string")
    entry = nodes(spark, ["P.a"])
    assert {r.node for r in graph.reachable(e, entry).collect()} == {"P.a", "Q.b"}
    groups = graph.group_closure(e, edges(spark, ("Q", "CONST")), entry, owner)
    assert {(r.grp, r.reference_only) for r in groups.collect()} == {("P", False), ("Q", False), ("CONST", True)}


def test_mixed_closure_follows_references_one_hop(spark):
    """A reference of a reached routine is taken in, but nothing behind it."""
    calls = edges(spark, *[(f"step{i}", f"step{i + 1}") for i in range(4)], ("aside", "step0"))
    refs = edges(spark, *[(f"step{i}", f"table{i}") for i in range(5)], *[(f"table{i}", f"column{i}") for i in range(5)], ("step2", "step4"))
    got = {r.node: r.via for r in graph.mixed_closure(calls, refs, nodes(spark, ["step1"])).collect()}
    assert got == {**{f"step{i}": "call" for i in range(1, 5)}, **{f"table{i}": "reference" for i in range(1, 5)}}


def test_reference_resolution(spark):
    """Every routine of five groups refers to the next one in several spellings; some refer to nothing."""
    names = [(f"SHOP.G{g}", f"R{r}") for g in range(5) for r in range(3)]
    index = spark.createDataFrame([(g, r, r) for g, r in names], "grp string, name string, ref_name string")
    rows, want = [], set()
    for n, (g, r) in enumerate(names):
        to_group, to_name = names[(n + 1) % len(names)]
        short = to_group.split(".")[1]
        spellings = [f"{short}.{to_name}", f"{short.lower()}.{to_name.lower()}", f'"{short}".{to_name}', f"{to_group}.{to_name}"]
        rows += [(g, r, 10 * n + i, s) for i, s in enumerate(spellings)] + [(g, r, 10 * n + 8, r), (g, r, 10 * n + 9, "nvl")]
        want |= {(10 * n + i, to_group, to_name) for i in range(4)}
    refs = spark.createDataFrame(rows, "caller_group string, caller_ref string, line int, ref string")
    got = {(r.line, r.target_group, r.target_ref) for r in graph.resolve_references(refs, index, ["NVL"]).collect()}
    assert got == want


def test_reference_pairs_are_not_shuffled(spark):
    """Pairs are distinct where they are made; a ref_name under two names still comes out once."""
    refs = spark.createDataFrame([("S.G", "C", 1, "A"), ("S.G", "C", 1, "a"), ("S.G", "C", 1, "B")], "caller_group string, caller_ref string, line int, ref string")
    index = spark.createDataFrame([("S.G", "A", "A__1"), ("S.G", "A", "A__2"), ("S.G", "A", "A__2"), ("S.G", "B", "B")], "grp string, name string, ref_name string")
    out = graph.resolve_references(refs, index)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[:plan.index("Join")]
    assert sorted(r.target_ref for r in out.collect()) == ["A__1", "A__2", "B"]
    twice = index.union(spark.createDataFrame([("S.G", "B", "A__1")], index.schema))
    assert sorted(r.target_ref for r in graph.resolve_references(refs, twice).collect()) == ["A__1", "A__2", "B"]


def test_duplicate_blocks_against_brute_force(spark):
    base = [f"w{i}" for i in range(30)]
    texts = {1: base, 2: ["x"] + base[5:20] + ["y"], 3: base[10:15], 4: ["z"] * 8}
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id int, text string")
    got = {(r.doc_id, r.position, r.doc_count) for r in corpus.duplicate_blocks(docs, 4).collect()}
    where = {}
    for k, words in texts.items():
        for i in range(len(words) - 3):
            where.setdefault(tuple(words[i:i + 4]), set()).add((k, i))
    want = {(k, i, len({d for d, _ in hits})) for hits in where.values() if len({d for d, _ in hits}) > 1 for k, i in hits}
    assert got == want


def test_ascii_word_edges(spark):
    docs = spark.createDataFrame([(1, "élicense"), (2, "license_x"), (3, "a\nlicense")], "doc_id int, text string")
    picked, _ = corpus.select_by_signals(docs, {"license": r"\blicense\b"})
    assert {r.doc_id for r in picked.collect()} == {1, 3}


def test_coverage_rates(spark):
    rows = spark.createDataFrame([("p", "LINE", 2, 3), ("p", "BRANCH", 1, 1)], "package string, type string, missed long, covered long")
    out = quality.coverage_summary(rows)["total"].first()
    assert (round(out.line_rate, 6), out.branch_rate, out.passed) == (0.6, 0.5, False)


def test_abc_thresholds_and_layers(spark):
    rows = spark.createDataFrame([(None, 90.0, None, None), (100.0, 100.0, 100.0, 100.0)], "l1 double, l2 double, l3 double, l4 double")
    assert {(r.total, r.grade) for r in quality.overall_score(rows).collect()} == {(90.0, "A"), (100.0, "A+")}


def test_maximal_duplicate_spans_match_brute_force(spark):
    rng, n = random.Random(3), 4
    words = [f"w{i}" for i in range(400)]
    shared = [[rng.choice(words) for _ in range(k)] for k in (4, 9, 15, 30)]
    texts = []
    for i in range(40):
        parts = [[rng.choice(words) for _ in range(rng.randrange(8))] for _ in range(3)]
        parts[1:1] = [p[rng.randrange(3):] for p in rng.sample(shared, 2)]
        texts.append(" ".join(w for p in parts for w in p))
    texts += ["", "w1 w2", " ".join(["same"] * 12), " ".join(["same"] * 7), texts[0]]
    places = {}
    for d, t in enumerate(texts):
        t = t.split()
        for i in range(len(t) - n + 1):
            places.setdefault(tuple(t[i:i + n]), set()).add((d, i))
    blocks = {p: b for b, ps in places.items() if len({d for d, _ in ps}) > 1 for p in ps}
    follows = lambda p, q: p in blocks and q in blocks and {(d, i + 1) for d, i in places[blocks[p]]} == places[blocks[q]]
    want = set()
    for d, i in blocks:
        if follows((d, i - 1), (d, i)):
            continue
        end = i
        while follows((d, end), (d, end + 1)):
            end += 1
        here = places[blocks[d, i]]
        want.add((d, i, end - i + n, len({x for x, _ in here}), len(here), *min(here)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r) for r in corpus.duplicate_spans(docs, n).collect()]
    assert len(got) == len(set(got)) and set(got) == want and any(r[2] > 20 for r in want)
    assert corpus.duplicate_spans(docs.limit(0), n).count() == 0


def test_only_blocks_with_a_repeated_anchor_are_kept(spark):
    rng, n = random.Random(5), 20
    shared = [f"s{i}" for i in range(60)]
    texts = [[f"w{rng.randrange(10**9)}" for _ in range(600)] for _ in range(12)]
    texts[3][100:160] = texts[7][400:460] = shared
    rows = [(d, " ".join(t)) for d, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (3, rows[3][1])], "doc_id long, text string")
    kept = {(r.doc_id, r.position) for r in corpus.block_places(docs, n).collect()}
    hits = {(3, 100 + i) for i in range(41)} | {(7, 400 + i) for i in range(41)}
    assert hits <= kept and len(kept) < 2 * len(hits)
    assert {(r.doc_id, r.position, r.doc_count, r.occurrences) for r in corpus.duplicate_blocks(docs, n).collect()} == {(d, p, 2, 3) for d, p in hits}
