"""Tables that grow by increments, files that are skipped, catch-up, kept histories, checked writes, and runs of models."""

import datetime as dt
import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import history as H
from ridgeline.operators.bitmaps import distinct_counts, id_bitmaps, united
from ridgeline.operators.catchup import catch_up, missing, notes
from ridgeline.operators.clustering import cluster, read_ranges
from ridgeline.operators.deltas import merge_delta
from ridgeline.operators.incremental import load_hour
from ridgeline.operators.snapshots import snapshot
from ridgeline.operators.store import ChecksFailed, Store
from ridgeline.streaming.cdc import file_stream, state_stream

DAY = dt.timedelta(days=1)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/w")


def files_of(store, name):
    """Path and size of every data file of the newest version."""
    out = {}
    for folder in store.current(name)["folders"]:
        path, fs = store._fs(f"{store.root}/{name}/data/{folder}")
        found = fs.listFiles(path, True)
        while found.hasNext():
            x = found.next()
            if x.getPath().getName().endswith(".parquet"):
                out[str(x.getPath())] = x.getLen()
    return out


@pytest.mark.parametrize("rule, version", [("last", None), ("first", None), ("newer", "v"), ("not older", "v")])
def test_increments_are_ranked_by_the_rule(spark, store, rule, version):
    rng, state = random.Random(rule), {}
    for turn in range(6):
        batch = {k: (None if rng.random() < 0.2 else rng.randrange(5), f"{turn}") for k in rng.sample([*range(12), None], 6)}
        merge_delta(store, "t", spark.createDataFrame([(k, *x) for k, x in batch.items()], "k long, v long, x string"), ["k"], rule, version, buckets=3, most=3)
        for k, (v, x) in batch.items():
            old = state.get(k)
            newer = old and v is not None and old[0] is not None and (v > old[0] or rule == "not older" and v == old[0])
            if old is None or rule == "last" or rule in ("newer", "not older") and newer:
                state[k] = (v, x)
        assert {r["k"]: (r["v"], r["x"]) for r in store.read("t").collect()} == state
    assert store.read("t").columns == ["k", "v", "x"]
    assert max(Counter(x.split("/")[1] for x in store.current("t")["folders"]).values()) <= 4


def test_a_merge_writes_what_the_increment_holds(spark, store):
    base = spark.range(60_000).selectExpr("id", "cast(hash(id) as string) AS x")
    merge_delta(store, "t", base, ["id"], buckets=8, most=3)
    whole = files_of(store, "t")
    merge_delta(store, "t", spark.range(59_990, 60_010).selectExpr("id", "'new' AS x"), ["id"])
    after = files_of(store, "t")
    fresh = {p: n for p, n in after.items() if p not in whole}
    assert set(whole) <= set(after) and sum(fresh.values()) < sum(whole.values()) / 10
    assert store.read("t").filter("x = 'new'").count() == 20 and store.read("t").count() == 60_010
    # one key, again and again: its bucket alone is compacted, the other seven stay where they were
    for k in range(4):
        merge_delta(store, "t", spark.sql(f"SELECT 5L AS id, 'v{k}' AS x"), ["id"])
    touched = {p.split("__bucket=")[1][0] for p in set(files_of(store, "t")) ^ set(after)}
    assert len(touched) == 1 and store.read("t").filter("id = 5").first()["x"] == "v3"


def test_an_ingest_reads_its_source_once(spark, store):
    """A row that moves while an ingest runs is there once: the rows are drawn anew whenever they are read."""
    from ridgeline.functions.schema import TableConfig, parse_schema
    from ridgeline.plans.ingest import bronze, ingest

    config = TableConfig("t", ("id",), parse_schema("id:L! x:S updated_at:T!"), unit="hour")
    source = spark.range(200).select(F.col("id"), (F.rand() * 100).cast("decimal(38,9)").alias("x"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(rand() * 48 as int))").alias("updated_at"))
    for k in range(3):
        ingest(store, config, source, None, dt.datetime(2024, 1, 3) + k * DAY)
    assert bronze(store, config).count() == 200 == bronze(store, config).select("id").distinct().count()
    assert store.current("t")["partition"] == ["__bucket", "_part"] and dict(store.read("t").dtypes)["_part"] == "timestamp_ntz"


def test_ranges_open_few_files(spark, store, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cluster(store, "lines", lines, ["l_shipdate", "l_partkey", "l_returnflag"], 64)
    whole = len(files_of(store, "lines"))
    ranges = {"l_shipdate": (dt.datetime(1997, 1, 1), dt.datetime(1997, 3, 1)), "l_partkey": (20, 40), "l_returnflag": (None, "N")}
    got = read_ranges(store, "lines", ranges)
    want = lines.filter("l_shipdate between '1997-01-01' and '1997-03-01' and l_partkey between 20 and 40 and l_returnflag <= 'N'")
    assert whole > 40 and len(got.inputFiles()) < whole / 8 and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert read_ranges(store, "lines", {"l_partkey": (10**9, None)}).count() == 0


def test_clustering_takes_nulls_ties_and_nothing(spark, store):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) AS a", "if(id % 5 = 0, null, concat('ü', id % 9)) AS b", "id")
    cluster(store, "t", rows, ["a", "b"], 8)
    assert max(r["count"] for r in store.read("t").groupBy(F.input_file_name()).count().collect()) < 1000
    assert read_ranges(store, "t", {"a": (7, 7), "b": ("ü3", None)}).count() == rows.filter("a = 7 and b >= 'ü3'").count()
    cluster(store, "none", rows.limit(0), ["a"], 4)
    assert read_ranges(store, "none", {"a": (0, None)}).count() == 0
    with pytest.raises(ValueError):
        cluster(store, "t", rows, [], 4)


def test_catch_up_fills_gaps_two_at_a_time(spark, store):
    first, last, running, most, seen = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 12), set(), [0], Counter()
    hour, lock = dt.timedelta(hours=1), threading.Lock()

    def load(at):
        with lock:
            running.add(at)
            most[0] = max(most[0], len(running))
            seen[at] += 1
        try:
            if at.hour == 5 or at.hour == 7 and seen[at] == 1:
                raise OSError("no")
            load_hour(store, "t", spark.range(3).select("id", F.lit(at).cast("timestamp_ntz").alias("hour")), "hour")
        finally:
            with lock:
                running.discard(at)

    go = lambda: catch_up(store, "t", first, last, hour, lambda at: at.hour != 3, load, last)
    became = go()
    assert Counter(became.values()) == {"loaded": 10, "skipped": 1, "failed": 1} and most[0] == 2
    assert (became[first + 3 * hour], became[first + 5 * hour]) == ("skipped", "failed") and seen[first + 7 * hour] == 2 == seen[first + 5 * hour]
    assert [(r["begin"], r["end"], r["steps"]) for r in missing(store, "t", first, last, hour).collect()] == [(first + 5 * hour, first + 6 * hour, 1)]
    assert set(go()) == {first + 5 * hour} and store.read("t").groupBy("hour").count().filter("count = 3").count() == 10
    assert notes(store, "t").filter("status = 'failed'").first()["error"] == "OSError: no"


def test_versions_of_runs_side_by_side_are_all_there(spark, store):
    store.replace("t", spark.range(1), None)
    threads = [threading.Thread(target=store.change, args=("t", [], lambda old, k=k: spark.range(k, k + 1))) for k in range(1, 7)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r["id"] for r in store.read("t").collect()) == list(range(7))


def test_closed_rows_of_a_history_are_never_written_again(spark, store):
    def state(run):
        rows = [(k, f"{run}" if k % (run + 2) == 0 else "same", dt.date(2024, 1, 1) + run * DAY if k % (run + 2) == 0 else dt.date(2024, 1, 1)) for k in range(40) if k % 7 != run]
        return spark.createDataFrame(rows, "k long, v string, updated_at date")

    kept, want = set(), None
    for run in range(4):
        source, now = state(run), F.lit(dt.date(2024, 2, 1) + run * DAY)
        got = snapshot(store, "h", source, "k", "updated_at", now)
        nothing = source.filter("1 = 0").select("*", F.lit("").alias("scd_id"), F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
        want = spark.createDataFrame(H.scd2_apply(nothing if want is None else want, source, "k", "updated_at", now).collect(), nothing.schema)
        assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(map(tuple, want.collect()))
        closed = {p for p in files_of(store, "h") if "__part=closed" in p}
        assert kept <= closed
        kept = closed
    again = Counter(map(tuple, got.collect()))
    assert Counter(map(tuple, snapshot(store, "h", state(3), "k", "updated_at", now).collect())) == again and kept


def test_a_failing_check_leaves_the_table_as_it_was(spark, store):
    checks = {"not_negative": F.col("id") < 0, "even": F.col("id") % 2 != 0}
    rows = spark.range(10).selectExpr("id * 2 AS id", "id div 5 AS part")
    store.replace("t", rows, "part", checks=checks)
    before = store.current("t")
    for bad in (lambda df: store.replace("t", df, "part", checks=checks), lambda df: store.change("t", [], lambda old: df, checks=checks), lambda df: store.overwrite_partitions("t", df, checks=checks)):
        with pytest.raises(ChecksFailed) as e:
            bad(rows.selectExpr("id + 1 AS id", "part"))
        assert e.value.failures == {"even": 10} and store.current("t") == before
    assert store.read("t").count() == 10
    assert store.change("t", [], lambda old: rows.selectExpr("id + 100 AS id", "part"), checks=checks) and store.read("t").count() == 20


def test_columns_keep_their_identity(spark, store):
    from pyspark.sql import types as T

    from ridgeline.operators.identity import Columns

    table = Columns(store, "t")
    table.create(spark.sql("SELECT 1 AS a, cast(1.5 AS decimal(5,2)) AS d, 'x' AS s, date'2024-01-02' AS day"))
    files = set(files_of(store, "t"))
    table.widen("a", T.LongType())
    table.widen("d", T.DecimalType(20, 4))
    table.widen("day", T.TimestampNTZType())
    table.rename("s", "text")
    assert table.sync(spark.sql("SELECT 1 AS a, 'y' AS text, 2.0D AS extra").schema) == ["added:extra"]
    table.append(spark.sql("SELECT 5000000000L AS a, 'y' AS text, 2.0D AS extra, 7.25BD AS d"))
    assert set(files_of(store, "t")) > files
    assert sorted(map(str, table.read().select("a", "d", "text", "extra", "day").collect())) == [
        "Row(a=1, d=Decimal('1.5000'), text='x', extra=None, day=datetime.datetime(2024, 1, 2, 0, 0))", "Row(a=5000000000, d=Decimal('7.2500'), text='y', extra=2.0, day=None)"]
    table.drop("text")
    table.add("text", T.StringType())
    assert {r["text"] for r in table.read().collect()} == {None} and table.sync(spark.sql("SELECT 1 AS a").schema, follow=True) == ["dropped:d", "dropped:day", "dropped:extra", "dropped:text"]
    assert sorted(r["a"] for r in table.read().collect()) == [1, 5000000000] and table.read().columns == ["a"]
    for bad in (lambda: table.widen("a", T.IntegerType()), lambda: table.rename("zz", "y"), lambda: table.add("a", T.LongType()), lambda: table.append(spark.sql("SELECT 'no' AS a")), lambda: table.drop("zz")):
        with pytest.raises(ValueError):
            bad()


def test_bitmaps_count_exactly(spark):
    rng = random.Random(1)
    rows = [(dt.date(2024, 1, 1) + rng.randrange(20) * DAY, None if rng.random() < 0.05 else rng.randrange(100_000) if rng.random() < 0.5 else rng.randrange(50), rng.choice("ab")) for _ in range(3000)]
    df = spark.createDataFrame(rows, "day date, id long, kind string")
    maps = id_bitmaps(df, {"day": F.col("day")}, "id", {"n": F.lit(True), "a": F.col("kind") == "a"})
    days = {r["day"]: (r["n"], r["a"]) for r in distinct_counts(maps, ["day"], ["n", "a"]).collect()}
    assert days == {d: tuple(len({i for e, i, k in rows if e == d and i is not None and k in kinds}) for kinds in ("ab", "a")) for d in {r[0] for r in rows}}
    week = F.date_trunc("week", "day").cast("date")
    weeks = distinct_counts(united(maps, {"week": week}, ["n"]), ["week"], ["n"])
    want = df.groupBy(week.alias("week")).agg(F.count_distinct("id").alias("n"))
    assert Counter(map(tuple, weeks.collect())) == Counter(map(tuple, want.collect()))
    assert "Expand" not in maps._jdf.queryExecution().executedPlan().toString()


def test_a_stream_with_state_goes_on_from_its_checkpoint(spark, tmp_path, store):
    rng, folder = random.Random(4), str(tmp_path / "in")
    events = [(rng.randrange(30), n, rng.choice("cud"), 1000 + rng.randrange(50), n) for n in range(400)]
    schema = "k long, n long, __op string, __source_ts_ms long, __lsn long"
    for part in range(4):
        spark.createDataFrame(events[part::4], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = file_stream(spark, f"{folder}/*.parquet", spark.createDataFrame([], schema).schema)
        if part == 2:  # the third start breaks off in the middle of a batch

            def broken(*a, **k):
                raise OSError("lost")

            from ridgeline.streaming import cdc

            whole, cdc.merge_delta = cdc.merge_delta, broken
            try:
                with pytest.raises(Exception, match="lost"):
                    state_stream(stream, store, "s", "k", offsets=str(tmp_path / "offsets"))
            finally:
                cdc.merge_delta = whole
            continue
        got = state_stream(stream, store, "s", "k", offsets=str(tmp_path / "offsets"))
    want = H.current_state(spark.createDataFrame(events, schema), "k")
    assert Counter((r["k"], r["n"]) for r in got.collect()) == Counter((r["k"], r["n"]) for r in want.collect())


def test_models_run_in_the_order_of_their_needs(spark, sf_dir, store):
    from ridgeline.plans import marts
    from ridgeline.plans.runner import graph, run_models, selected
    from ridgeline.plans.stand_in import StandIn

    sources, now = StandIn(spark, sf_dir, store), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    needs = graph(spark, sources)
    assert needs["fct_refunds"] == {"stg_payment_refund", "fct_payments", "fct_rides"} and selected(needs, ["fct_refunds+"]) == {"fct_refunds", "agg_daily_refunds"}
    with pytest.raises(ValueError):
        selected(needs, ["+no_such_model"])
    run = run_models(spark, sources, store, ["+agg_daily_refunds"], now=now, whole=True)
    assert not run.errors and set(run.status.values()) == {"built"} and store.read("agg_daily_refunds").count() > 0
    plan = marts.Session(spark, sources, now, store).ref("fct_refunds")._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() <= 15
    before = {name: store.current(name)["version"] for name in ("fct_rides", "fct_refunds", "agg_daily_refunds")}
    # a model that fails keeps its table, and what needs it is skipped
    whole = marts.MODELS["fct_payments"]
    marts.MODELS["fct_payments"] = lambda s: whole(s).withColumn("payment_status", F.lit("ODD"))
    try:
        run = run_models(spark, sources, store, ["fct_payments+"], now=now, whole=True)
    finally:
        marts.MODELS["fct_payments"] = whole
    assert run.status["fct_payments"] == "failed" and "accepted_payment_status" in run.errors["fct_payments"]
    assert {run.status[x] for x in ("fct_refunds", "agg_daily_refunds", "agg_daily_payment_method")} == {"skipped"}
    assert {name: store.current(name)["version"] for name in before} == before
    kept = Counter(r["ride_sk"] for r in store.read("fct_rides").collect())
    assert run_models(spark, sources, store, ["fct_rides"], now=now, whole=True).status["fct_rides"] == "built" and Counter(r["ride_sk"] for r in store.read("fct_rides").collect()) == kept
