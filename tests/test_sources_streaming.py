"""Readers, writers, ordered folds and streams."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from millrace.operators import inventory, quality, telemetry
from millrace.operators.corpus import normalize_findings
from millrace.plans.bridge import Bridge
from millrace.plans.queries_inventory import movements
from millrace.sources import files
from millrace.streaming import ledger as streams



def xml_reports(rows):
    """Reports in the four layouts from (file, line, number) rows of a given table."""
    blocks = "".join(f'<duplication lines="{4 + n % 9}" tokens="{40 + n % 50}"><file line="{line}" path="{f}"/><file line="{line + 3}" path="copy/{f}"/></duplication>' for f, line, n in rows)
    style = "".join(f'<file name="{f}"><error line="{line}" severity="{("error", "warning", "info")[n % 3]}" message="n{n}" source="own.checks.{("naming.TypeNameCheck", "sizes.MethodLengthCheck")[n % 2]}"/></file>' for f, line, n in rows)
    rules = "".join(f'<file name="{f}"><violation beginline="{line}" endline="{line}" rule="{("UnusedFormalParameter", "NullAssignment")[n % 2]}" ruleset="own" priority="{1 + n % 5}">n{n}</violation></file>' for f, line, n in rows)
    cover = "".join(f'<package name="{f.rsplit("/", 1)[0]}"><class name="c{n}" sourcefilename="{f.rsplit("/", 1)[1]}"><counter type="LINE" missed="{n % 7}" covered="{n % 11}"/></class></package>' for f, line, n in rows)
    return f"<pmd-cpd>{blocks}</pmd-cpd>", f'<checkstyle version="1">{style}</checkstyle>', f'<pmd version="1">{rules}</pmd>', f'<report name="own">{cover}</report>'


def put(tmp_path, name, text):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_xml_reports(spark, sf, tmp_path):
    """The parts table written as XML reports and read back."""
    parts = spark.read.parquet(f"{sf}/part.parquet").orderBy("p_partkey").limit(40).collect()
    rows = [(f"{r.p_brand.replace('#', '')}/P{r.p_partkey}.src", r.p_size + 1, r.p_partkey) for r in parts]
    dup, style, rules, cover = xml_reports(rows)
    got = files.read_duplication_report(spark, put(tmp_path, "blocks.xml", dup)).collect()
    assert sorted((r.file, r.start_line, r.lines, r.tokens) for r in got) == sorted(x for f, line, n in rows for x in ((f, line, 4 + n % 9, 40 + n % 50), ("copy/" + f, line + 3, 4 + n % 9, 40 + n % 50)))
    assert len({r.group_id for r in got}) == len(rows)  # groups without a code fragment stay apart
    found = files.read_style_report(spark, put(tmp_path, "style.xml", style)).unionByName(files.read_rule_report(spark, put(tmp_path, "rules.xml", rules)))
    normal = normalize_findings(found).collect()
    want = [("checkstyle", f, line, ("TypeName", "MethodLength")[n % 2]) for f, line, n in rows] + [("pmd", f, line, ("UnusedFormalParameter", "NullAssignment")[n % 2]) for f, line, n in rows]
    assert sorted((r.tool, r.file, r.line, r.rule) for r in normal) == sorted(want)
    assert {r.severity for r in normal} <= {"critical", "major", "minor", "info", "blocker"} and len({r.severity for r in normal}) > 1
    cov = files.read_coverage_report(spark, put(tmp_path, "cover.xml", cover)).collect()
    assert sorted((r.package, r.source, r.missed, r.covered) for r in cov) == sorted((f.rsplit("/", 1)[0], f.rsplit("/", 1)[1], n % 7, n % 11) for f, _, n in rows)


def test_text_and_json(spark, tmp_path):
    put(tmp_path, "src/a/x.sql", "select 1\nfrom t")
    put(tmp_path, "src/b/y.pkb", "body")
    put(tmp_path, "src/b/z.txt", "no")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_text_corpus(spark, str(tmp_path / "src")).collect()}
    assert got == {"x.sql": "select 1\nfrom t", "y.pkb": "body"}
    path = put(tmp_path, "m.json", '{"phase": "fix",\n "issues": ["a"]}')
    row = files.read_json_artifacts(spark, path, "phase string, todos array<string>, issues array<string>", {"todos": ["issues"]}).first()
    assert row.asDict() == {"phase": "fix", "todos": ["a"]}


def test_ledger_archive(spark, sf, tmp_path):
    txns = Bridge(spark, sf).ledger
    n = inventory.write_archive(txns, "1999-07-01", str(tmp_path / "arch"), str(tmp_path / "ledger"))
    assert n == txns.filter("txn_date < DATE '1999-07-01'").count()
    rest = spark.read.parquet(str(tmp_path / "ledger"))
    assert rest.count() + n == txns.count()
    assert (tmp_path / "arch" / "t_inv_txn_arch_199907").exists()
    files.write_ledger(txns, str(tmp_path / "quarters"))
    plan = spark.read.parquet(str(tmp_path / "quarters")).filter("txn_quarter = '2000Q1'")
    assert plan.count() == txns.filter("quarter(txn_date) = 1 AND year(txn_date) = 2000").count()


def test_archiving_rewrites_the_cut_month_only(spark, sf, tmp_path):
    txns = Bridge(spark, sf).ledger.withColumn("txn_date", F.when(F.col("quantity") < 49, F.col("txn_date")))  # some rows have no date
    ledger, archive = tmp_path / "ledger", tmp_path / "archive"
    files.write_ledger(txns, str(ledger), grain="month")
    listed = lambda root: {(f.parent.name, f.name, f.stat().st_mtime_ns) for f in root.rglob("*.parquet")}
    before = listed(ledger)
    target = inventory.archive_ledger(spark, str(ledger), "1999-07-15", str(archive))
    after, moved = listed(ledger), listed(archive)
    assert {p for p, _, _ in after - before} == {"txn_month=199907"}
    assert moved - {m for m in moved if m[0] == "txn_month=199907"} <= before  # whole months: the same files
    kept, gone = spark.read.parquet(str(ledger)), spark.read.parquet(target)
    assert gone.filter("txn_date >= '1999-07-15' OR txn_date IS NULL").count() == 0 and kept.filter("txn_date < '1999-07-15'").count() == 0
    same = [c for c in txns.columns if c != "txn_month"]
    assert kept.select(same).unionByName(gone.select(same)).exceptAll(txns).count() == 0 and kept.count() + gone.count() == txns.count()
    inventory.archive_ledger(spark, str(ledger), "1999-07-15", str(archive))  # again: nothing left to move
    assert listed(ledger) == after and listed(archive) == moved
    n = gone.count()
    late = gone.filter("txn_month = 199907").limit(3)  # one comes again, two are new
    late = late.select(*[F.concat("txn_id", F.lit("-late")).alias(c) if c == "txn_id" else c for c in same]).limit(2).unionByName(late.select(same).limit(1))
    files.write_ledger(late, str(ledger), grain="month")
    inventory.archive_ledger(spark, str(ledger), "1999-07-15", str(archive))
    assert spark.read.parquet(target).count() == n + 2 and spark.read.parquet(str(ledger)).filter("txn_date < '1999-07-15'").count() == 0


def sequential_average(rows, start):
    """Plain reference loop over one key's movements."""
    qty, avg, exists = start
    out = []
    for delta, in_qty, cost in rows:
        if not exists:
            avg, exists = (cost if cost is not None else Decimal(0)), True
        elif cost is not None and qty + in_qty > 0:
            avg = ((qty * avg + in_qty * cost) / (qty + in_qty)).quantize(Decimal("0.000001"), ROUND_HALF_UP)
        qty += delta
        out.append((qty, avg))
    return out


@pytest.mark.parametrize("limit", ["2000000", "40"])
def test_moving_average_of_a_hot_key(spark, limit):
    """One key holds most rows; cut into ranges, the fold must not change."""
    rng = random.Random(5)
    rows = []
    for seq in range(600):
        item = 1 if rng.random() < 0.8 else rng.randint(2, 6)
        inbound = rng.random() < 0.6
        qty = Decimal(rng.randint(1, 50))
        rows.append((seq, item, 1, qty if inbound else -qty, qty if inbound else Decimal(0), Decimal(rng.randint(1, 99999)) / 1000 if inbound else None))
    moves = spark.createDataFrame(rows, "seq long, item_id long, warehouse_id int, delta_qty decimal(18,4), in_qty decimal(18,4), in_cost decimal(20,6)")
    bal = spark.createDataFrame([(1, 1, Decimal(10), Decimal(0), Decimal("3.5"), None, 4)],
                                "item_id long, warehouse_id int, qty_on_hand decimal(18,4), qty_allocated decimal(18,4), avg_cost decimal(20,6), last_txn_date date, version int")
    spark.conf.set("spark.millrace.hotGroupRows", limit)
    try:
        after, trail = inventory.apply_movements(bal, moves, ["seq"], "2026-01-01")
        got = {r.seq: (r.qty_after, r.avg_cost_after) for r in trail.collect()}
        final = {r.item_id: (r.qty_on_hand, r.avg_cost, r.version) for r in after.collect()}
    finally:
        spark.conf.unset("spark.millrace.hotGroupRows")
    for item in range(1, 7):
        mine = [r for r in rows if r[1] == item]
        start = (Decimal(10), Decimal("3.5"), True) if item == 1 else (Decimal(0), Decimal(0), False)
        want = sequential_average([r[3:] for r in mine], start)
        assert [got[r[0]] for r in mine] == want
        assert final[item] == (*want[-1], (4 if item == 1 else -1) + len(mine))


def test_stream_equals_batch_over_several_batches(spark, sf, tmp_path):
    b = Bridge(spark, sf)
    moves = movements(b)
    cuts = [("1900-01-01", "1997-06-01"), ("1997-06-01", "1999-01-01"), ("1999-01-01", "2100-01-01")]
    folder = tmp_path / "moves.parquet"
    for i, (lo, hi) in enumerate(cuts):
        moves.filter((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
    folder.mkdir()
    for i in range(3):
        src = next((tmp_path / f"part{i}").glob("*.parquet"))
        (folder / f"{i}.parquet").write_bytes(src.read_bytes())
    stream = spark.readStream.schema(moves.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(folder))
    emitted = streams.run_to_table(streams.stream_moving_average(stream), "update")
    assert emitted.select("batch").distinct().count() >= 3
    got = {(r.item_id, r.warehouse_id): (r.qty_on_hand, r.avg_cost, r.moves) for r in streams.latest(emitted, ["item_id", "warehouse_id"]).collect()}
    empty = b.balances.filter("false")
    batch, _ = inventory.apply_movements(empty, moves, ["seq"], "2026-01-01")
    assert got == {(r.item_id, r.warehouse_id): (r.qty_on_hand, r.avg_cost, r.version + 1) for r in batch.collect()}


def test_keyed_average_orders_rows_and_returns_late_ones(spark, tmp_path):
    """Rows in disorder within the delay are folded in order over several micro-batches; rows behind the watermark come out."""
    rng = random.Random(11)
    day = lambda n: f"2024-{1 + n // 28:02d}-{1 + n % 28:02d}"
    rows = []
    for n in range(240):
        inbound, qty = rng.random() < 0.6, Decimal(rng.randint(1, 50))
        rows.append((day(n // 2), rng.randint(1, 3), 1, n, qty if inbound else -qty, qty if inbound else Decimal(0), Decimal(rng.randint(1, 99999)) / 1000 if inbound else None))
    cut = [rows[:80], rows[80:160], rows[160:]]
    moved = [cut[0].pop(i) for i in (70, 10)]  # the first is within the delay of ten days, the second far behind
    cut[1] += [moved[0]]
    cut[2] += [moved[1]]
    folder = tmp_path / "moves"
    schema = "ts string, item_id long, warehouse_id int, seq long, delta_qty decimal(18,4), in_qty decimal(18,4), in_cost decimal(20,6)"
    for part in cut:
        rng.shuffle(part)
        spark.createDataFrame(part, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(spark.read.parquet(str(folder)).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    emitted = streams.run_to_table(streams.stream_moving_average_late(stream, "10 days"), "update", keyed=True)
    late = emitted.filter("late_seq IS NOT NULL").collect()
    assert [(r.late_seq, r.late_qty) for r in late] == [(moved[1][3], moved[1][4])]
    got = {r.item_id: (r.qty_on_hand, r.avg_cost, r.moves) for r in streams.latest(emitted.filter("late_seq IS NULL"), ["item_id", "warehouse_id"]).collect()}
    for item in range(1, 4):
        mine = sorted((r for r in rows if r[1] == item and r[3] != moved[1][3]), key=lambda r: (r[0], r[3]))
        want = sequential_average([r[4:] for r in mine], (Decimal(0), Decimal(0), False))
        assert got[item] == (*want[-1], len(mine))


def test_keyed_average_of_many_keys_in_few_buckets(spark, tmp_path):
    """Keys share buckets, state and timers: each has the result of its own fold, also a null key; only keys of the batch come out."""
    rng = random.Random(12)
    rows = []
    for n in range(300):
        inbound, qty = rng.random() < 0.6, Decimal(rng.randint(1, 50))
        item = rng.choice([None, *range(40)]) if n < 200 else rng.randint(0, 3)
        rows.append((f"2024-{1 + n // 100:02d}-{1 + n % 28:02d}", item, 1, n, qty if inbound else -qty, qty if inbound else Decimal(0), Decimal(rng.randint(1, 99999)) / 1000 if inbound else None))
    folder = tmp_path / "moves"
    schema = "ts string, item_id long, warehouse_id int, seq long, delta_qty decimal(18,4), in_qty decimal(18,4), in_cost decimal(20,6)"
    for n in (0, 100, 200):
        part = sorted(rows[n:n + 100], key=lambda r: rng.random())
        spark.createDataFrame(part, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(spark.read.parquet(str(folder)).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    emitted = streams.run_to_table(streams.stream_moving_average_late(stream, "10 days", buckets=2), "update", keyed=True)
    assert not emitted.filter("late_seq IS NOT NULL").count()
    last = emitted.agg(F.max("batch")).first()[0]
    assert {r.item_id for r in emitted.filter(F.col("batch") == 2).collect()} == {r[1] for r in rows[200:]} and last >= 2
    got = {r.item_id: (r.qty_on_hand, r.avg_cost, r.moves) for r in streams.latest(emitted, ["item_id", "warehouse_id"]).drop("late_seq", "late_qty").collect()}
    assert set(got) == {r[1] for r in rows}
    for item in got:
        mine = sorted((r for r in rows if r[1] == item), key=lambda r: (r[0], r[3]))
        assert got[item] == (*sequential_average([r[4:] for r in mine], (Decimal(0), Decimal(0), False))[-1], len(mine))


def test_late_events_are_dropped(spark, tmp_path):
    rows = [[("2024-01-01 10:05:00", "p")], [("2024-01-01 15:00:00", "p")], [("2024-01-01 15:02:00", "p")], [("2024-01-01 10:06:00", "p"), ("2024-01-01 15:01:00", "p")]]
    folder = tmp_path / "ev"
    folder.mkdir()
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "ts string, phase string").select(
            F.to_timestamp("ts").alias("ts"), "phase", F.lit(1.0).alias("cost"), F.lit(1).alias("run")).coalesce(1).write.parquet(str(tmp_path / f"e{i}"))
        (folder / f"{i}.parquet").write_bytes(next((tmp_path / f"e{i}").glob("*.parquet")).read_bytes())
    schema = spark.read.parquet(str(folder)).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = streams.latest(streams.run_to_table(streams.stream_phase_metrics(stream), "update"), ["window_start", "phase"])
    assert {(str(r.window_start), r.calls) for r in out.collect()} == {("2024-01-01 10:00:00", 1), ("2024-01-01 15:00:00", 3)}


def test_a_repeated_batch_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = lambda *keys: spark.createDataFrame([(k,) for k in keys], "biz_key string")
    for batch, keys in ((1, "abc"), (2, "cd"), (1, "abc"), ("x y/z", "e"), (2, "cd")):
        files.append_batch(rows(*keys), path, batch)
    got = sorted((r.batch_id, r.biz_key) for r in spark.read.schema("biz_key string, batch_id string").parquet(path).collect())
    assert got == [("1", "a"), ("1", "b"), ("1", "c"), ("2", "c"), ("2", "d"), ("x y/z", "e")]


COVER = """<report name="own">
<package name="shop/bikes"><class name="shop/bikes/Frame" sourcefilename="Frame.java"><counter type="LINE" missed="1" covered="3"/><counter type="BRANCH" missed="0" covered="2"/></class>
<sourcefile name="Frame.java"><line nr="7" mi="4" ci="0" mb="0" cb="0"/><line nr="8" mi="0" ci="2" mb="0" cb="2"/><line nr="9" mi="0" ci="1" mb="1" cb="1"/></sourcefile></package>
<package name="shop/bare"><class name="shop/bare/Marker" sourcefilename="Marker.java"/></package></report>"""


def test_coverage_of_lines_owners_and_missing_input(spark, tmp_path):
    rows = files.read_coverage_rows(spark, put(tmp_path, "cover.xml", COVER))
    assert sorted((r.level, r.source, r.nr or 0, r.type or "") for r in rows.collect()) == [
        ("counter", "Frame.java", 0, "BRANCH"), ("counter", "Frame.java", 0, "LINE"), ("line", "Frame.java", 7, ""), ("line", "Frame.java", 8, ""), ("line", "Frame.java", 9, "")]
    wanted = spark.createDataFrame([("app/src/main/java/shop/bikes/Frame.java", "FRAME"), ("src/main/java/shop/bikes/Bell.java", "BELL")], "path string, owner string")
    counters, lines = rows.filter("level = 'counter'"), rows.filter("level = 'line'")
    out = quality.coverage_summary(counters, lines, files=wanted)
    assert sorted((r.nr, r.mi, r.mb) for r in out["gaps"].collect()) == [(7, 4, 0), (9, 0, 1)]
    assert out["total"].select("line_rate", "branch_rate", "executed", "passed").collect() == [(0.75, 1.0, True, False)]
    assert {r.owner: (r.executed, r.line_rate, r.passed) for r in out["owners"].collect()} == {"FRAME": (True, 0.75, False), "BELL": (False, None, None)}
    assert [r.owner for r in out["skipped"].collect()] == ["BELL"]
    none = quality.coverage_summary(counters.filter("false"))["total"].collect()
    assert [(r.executed, r.line_rate, r.passed) for r in none] == [(False, None, None)]


def test_business_of_runs(spark):
    objects = spark.createDataFrame([("a", "package", "P"), ("a", "package", "P"), ("a", "table", "P"), ("b", "note", "x")], "run string, kind string, name string")
    reviews = spark.createDataFrame([("a", "P", 1, 40, False, 5), ("a", "P", 2, 90, True, 1), ("a", "Q", 1, 60, False, None), ("c", "P", 1, None, None, 2)],
                                    "run string, package string, seq int, score int, passed boolean, todos int")
    builds = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("d", 1, False)], "run string, seq int, success boolean")
    phases = spark.createDataFrame([("a", "fix"), ("a", "fix"), ("a", "review")], "run string, phase string")
    got = {r.run: r for r in telemetry.run_business(objects, reviews, builds, phases).collect()}
    assert set(got) == {"a", "c", "d"}
    a, c, d = got["a"], got["c"], got["d"]
    assert (a.package_count, a.table_count, a.todos_remaining, a.fix_cycles, a.build_success, a.review_average_score, a.review_passed_rate) == (1, 1, 1, 2, True, 75.0, 0.5)
    assert (c.review_average_score, c.review_passed_rate, c.todos_remaining, c.build_success) == (None, 0.0, 2, None)
    assert (d.build_success, d.review_average_score, d.fix_cycles) == (False, None, 0)


def test_sessions_of_calls_come_out_once_when_they_are_over(spark, tmp_path):
    """Several micro-batches: a session is returned when later events have passed it, the last one after the closing event."""
    day = "2024-05-01 "
    parts = [[(1, "10:00:00", "10:01:00"), (2, "10:20:00", "10:22:00")], [(3, "10:45:00", "10:46:00"), (4, "15:00:00", "15:00:30")], [(5, "15:10:00", "15:11:00")], [(-1, "23:59:00", None)]]
    started, ended = tmp_path / "s", tmp_path / "e"
    for part in parts:
        rows = [(i, "r", "t", "error" if i == 2 else "completed", day + s, day + e if e else None) for i, s, e in part]
        df = spark.createDataFrame(rows, "call_id long, run string, tool string, state string, s string, e string")
        df.select("call_id", "run", "tool", F.to_timestamp("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(started))
        df.select(F.when(F.col("call_id") < 0, -2).otherwise(F.col("call_id")).alias("call_id"), "state", F.to_timestamp(F.coalesce("e", "s")).alias("ts")).coalesce(1).write.mode("append").parquet(str(ended))
    stream = lambda p: spark.readStream.schema(spark.read.parquet(str(p)).schema).option("maxFilesPerTrigger", 1).parquet(str(p))
    out = streams.run_to_table(streams.stream_session_calls(stream(started), stream(ended), "30 minutes", "10 minutes"), "append")
    got = sorted((str(r.window_start)[11:], str(r.window_end)[11:], r.calls, r.errors, r.duration_ms, r.batch) for r in out.collect())
    assert [g[:5] for g in got] == [("10:00:00", "11:15:00", 3, 1, 240000), ("15:00:00", "15:40:00", 2, 0, 90000)]
    assert got[0][5] < got[1][5]
