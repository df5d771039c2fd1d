"""Core operators: properties, edge cases, and the catalogue against DuckDB on the smallest tables."""

import datetime as dt
import os
import random
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridgeline.functions.expressions import format_local, local, today
from ridgeline.functions.schema import TABLES, USER_ROLE, TableConfig, parse_schema
from ridgeline.operators import history as H
from ridgeline.operators import quality as Q
from ridgeline.operators.evolve import align, sync_all, sync_report
from ridgeline.operators.incremental import lookback_from_max, overwrite_partitions, run_model
from ridgeline.operators.store import Staged, Store, merge_labels, normalise_label, run_statements, table_labels
from ridgeline.plans import catalog
from ridgeline.sources import connectors as C
from ridgeline.streaming.cdc import SINKS, hour_folders, parse_strict, split_bad, upsert_changes, upserted


def _value(v):
    if v is None or v != v:
        return None
    if isinstance(v, dt.datetime):
        return str(v.date()) if v.time() == dt.time() else str(v.replace(tzinfo=None))
    if isinstance(v, (bool, str, dt.date, bytes)):
        return str(v)
    return v if isinstance(v, int) else float(f"{float(v):.9g}")  # only what isn't whole by its type is rounded


def _same(spark_rows, names, cursor):
    own = sorted(range(len(names)), key=lambda i: names[i])
    theirs = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(theirs)
    other = sorted(range(len(theirs)), key=lambda i: theirs[i])
    a = Counter(tuple(_value(r[i]) for i in own) for r in spark_rows)
    b = Counter(tuple(_value(r[i]) for i in other) for r in cursor.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_catalogue_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "clicks"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = catalog.queries()[name](spark, sf_dir)
    _same(df.collect(), df.columns, con.execute(catalog.oracle_sql()[name]))


def _rows(spark, rows, schema="k long, v long, x string"):
    return spark.createDataFrame(rows, schema)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9)), max_size=12), st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9)), max_size=12), st.booleans())
def test_merge_keeps_the_newest_and_is_idempotent(spark, old, new, strict):
    target = {k: v for k, v in sorted(old)}
    t = _rows(spark, [(k, v, "t") for k, v in target.items()])
    s = _rows(spark, [(k, v, "s") for k, v in new])
    once = H.merge_upsert(t, s, ["k"], "v", strict)
    want = {}
    for k in {*target, *(k for k, _ in new)}:
        top = max((v for kk, v in new if kk == k), default=None)
        take = top is not None and (k not in target or (top > target[k] if strict else top >= target[k]))
        want[k] = (top, "s") if take else (target[k], "t")
    assert {r["k"]: (r["v"], r["x"]) for r in once.collect()} == want
    assert Counter(H.merge_upsert(once, s, ["k"], "v", strict).collect()) == Counter(once.collect())


def test_replay_doesnt_depend_on_order_and_ranks_before_dropping(spark):
    events = [(1, "u", "10", 1), (1, "d", "20", 2), (2, "d", "10", 3), (2, "c", "11", 4), (3, "u", "5", 5), (3, "u", "5", 6), (4, None, "7", 7), (5, "u", "bad", 8), (5, "u", "1", 9), (1, "u", "10", 1)]
    want = {(2, "c", 4), (3, "u", 6), (4, None, 7), (5, "u", 9)}
    for seed in range(3):
        random.Random(seed).shuffle(events)
        df = spark.createDataFrame(events, "id long, __op string, __source_ts_ms string, __lsn long")
        assert {(r["id"], r["__op"], r["__lsn"]) for r in H.current_state(df, "id").collect()} == want


def test_scd2_history_is_disjoint_and_has_one_open_row(spark):
    day = lambda d: dt.date(2024, 1, d)
    state = spark.createDataFrame([], "k long, v string, updated_at date, scd_id string, valid_from date, valid_to date")
    for now, rows in ((10, [(1, "a", day(1)), (2, "a", day(2))]), (12, [(1, "b", day(11)), (2, "a", day(2)), (3, "c", day(12))]), (14, [(1, "b", day(11))])):
        source = spark.createDataFrame(rows, "k long, v string, updated_at date")
        state = spark.createDataFrame(H.scd2_apply(state, source, "k", "updated_at", F.lit(day(now))).collect(), state.select("k", "v", "updated_at", "scd_id", "valid_from", "valid_to").schema)
    got = sorted((r["k"], r["v"], r["valid_from"], r["valid_to"]) for r in state.collect() if r["valid_to"])
    assert got == [(1, "a", day(1), day(11)), (2, "a", day(2), day(14)), (3, "c", day(12), day(14))]
    assert [(r["k"], r["v"]) for r in state.collect() if not r["valid_to"]] == [(1, "b")]


def test_as_of_join_is_half_open(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    dim = spark.createDataFrame([(1, t(1), t(5), "a"), (1, t(5), None, "b")], "k long, valid_from timestamp_ntz, valid_to timestamp_ntz, sk string")
    facts = spark.createDataFrame([(1, t(0)), (1, t(1)), (1, t(5)), (1, t(9)), (None, t(3))], "k long, at timestamp_ntz")
    got = {(r["k"], r["at"].hour): r["sk"] for r in H.as_of_join(facts, dim, "k", F.col("at"), ["sk"]).collect()}
    assert got == {(1, 0): None, (1, 1): "a", (1, 5): "b", (1, 9): "b", (None, 3): None}


@pytest.mark.parametrize("unit", ["hour", "day", "month"])
def test_as_of_join_sweeps_hot_keys_and_odd_rows(spark, unit):
    rng, start = random.Random(unit), dt.datetime(2024, 1, 1)
    at = lambda: start + dt.timedelta(minutes=30 * rng.randrange(3000))
    versions = []
    for key in range(6):
        times = sorted(at() for _ in range(rng.randrange(1, 40)))
        for k, begin in enumerate(times):  # gaps, empty intervals where times are equal, an open end
            end = times[k + 1] if k + 1 < len(times) else None
            versions.append((key, begin, min(end, begin + dt.timedelta(days=3)) if end and rng.random() < 0.3 else end, len(versions)))
    facts = [(n, None if n % 29 == 0 else 1 if n % 3 == 0 else rng.randrange(8), None if n % 31 == 0 else at()) for n in range(900)]
    facts += facts[:20] + [(1000 + v, key, begin) for key, begin, _, v in versions]
    dim = spark.createDataFrame(versions + [(None, start, None, -1), (2, None, None, -2)], "k long, valid_from timestamp_ntz, valid_to timestamp_ntz, v long")
    df = spark.createDataFrame([(*f, "x") for f in facts], "n long, k long, at timestamp_ntz, _v string").repartition(3)
    got = H.as_of_join(df, dim, "k", F.col("at"), ["v"], unit)
    want = Counter((n, k, t, next((v for key, a, b, v in versions if key == k and t is not None and a <= t and (b is None or t < b)), None)) for n, k, t in facts)
    assert got.columns == ["n", "k", "at", "_v", "v"] and Counter((r["n"], r["k"], r["at"], r["v"]) for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" in plan


def test_as_of_join_groups_stay_small(spark):
    """A third of all facts has one key: no group of the sweep holds more than a day of it."""
    facts = spark.range(30_000).selectExpr("id", "if(id % 3 = 0, 0, id) AS k", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id % 100000 as int)) AS at")
    dim = spark.range(300).selectExpr("0L AS k", "timestamp_ntz'2023-12-01 00:00:00' + make_dt_interval(0, cast(id as int) * 9) AS valid_from", "timestamp_ntz'2023-12-01 00:00:00' + make_dt_interval(0, cast(id as int) * 9 + 9) AS valid_to", "id AS v")
    got = H.as_of_join(facts, dim, "k", F.col("at"), ["v"], "day")
    assert got.filter("k = 0 and v is not null").count() == 10_000 and got.count() == 30_000
    assert got.filter("k = 0").groupBy(F.to_date("at")).count().agg(F.max("count")).first()[0] < 700


def test_store_swaps_versions_and_strategies(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/w")
    first = spark.createDataFrame([(1, "2024-01-01", 1), (2, "2024-01-02", 1)], "k long, day string, v long")
    assert run_model(store, "m", first, "merge", ["k"]).count() == 2
    more = spark.createDataFrame([(2, "2024-01-02", 5), (3, "2024-01-03", 5)], "k long, day string, v long")
    assert {(r["k"], r["v"]) for r in run_model(store, "m", more, "merge", ["k"]).collect()} == {(1, 1), (2, 5), (3, 5)}
    again = spark.createDataFrame([(9, "2024-01-02", 7, "new")], "k long, day string, v long, extra string")
    got = run_model(store, "m", again, "insert_overwrite", partition="day")
    assert {(r["k"], r["v"], r["extra"]) for r in got.collect()} == {(1, 1, None), (9, 7, "new"), (3, 5, None)}
    with pytest.raises(ValueError):
        store.read_partitions("m", "day", None)
    for unbound in (F.col("k") > 1, F.col("day").isNotNull(), (F.col("k") > 1) & F.col("day").isNotNull(), F.col("extra") == "day"):
        with pytest.raises(ValueError):
            store.read_partitions("m", "day", unbound)
    assert store.read_partitions("m", "day", F.col("day") > "2024-01-01").count() == 2
    with pytest.raises(ValueError):
        store.read("absent")


def test_store_survives_a_crash_at_any_point(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/w")
    run_model(store, "m", spark.range(5).withColumn("day", F.lit("a")), "merge", ["id"], "day")
    more = spark.range(4, 6).withColumn("day", F.lit("b"))

    def broken(*args):
        raise OSError("crash")

    with monkeypatch.context() as m:  # the rows are written, their list isn't
        m.setattr(Store, "_commit", broken)
        with pytest.raises(OSError):
            run_model(store, "m", more, "merge", ["id"])
    assert store.exists("m") and store.read("m").count() == 5
    with monkeypatch.context() as m:  # the list is there, old versions are left
        m.setattr(Store, "_clean", broken)
        with pytest.raises(OSError):
            run_model(store, "m", more, "merge", ["id"])
    for _ in range(2):
        assert {(r["id"], r["day"]) for r in run_model(store, "m", more, "merge", ["id"]).collect()} == {*((k, "a") for k in range(4)), (4, "b"), (5, "b")}
    with monkeypatch.context() as m:
        m.setattr(Store, "_write", broken)
        with pytest.raises(OSError):
            run_model(store, "fresh", more, "merge", ["id"])
    assert not store.exists("fresh") and run_model(store, "fresh", more, "merge", ["id"]).count() == 2


def test_increments_leave_other_partitions_where_they_are(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/w")
    run_model(store, "m", spark.range(100).selectExpr("id", "id div 10 AS part", "0 AS v"), "merge", ["id"], "part")
    before = set(store.current("m")["folders"])
    run_model(store, "m", spark.sql("SELECT 7L AS id, 0L AS part, 1 AS v UNION ALL SELECT 200L, 3L, 2"), "merge", ["id"])
    after = set(store.current("m")["folders"])
    assert before - after == {"__folder=00000001/part=0"} and after - before == {"__folder=00000002/part=0", "__folder=00000002/part=3"}
    run_model(store, "m", spark.sql("SELECT 1L AS id, 3L AS part, 9 AS v"), "insert_overwrite")
    assert store.read("m").filter("part = 3").count() == 1 and store.read("m").count() == 91
    run_model(store, "m", spark.sql("SELECT 500L AS id, 4L AS part, 9 AS v"), "append")
    assert store.next_id("m", "id") == 501 and store.read("m").count() == 92
    store.truncate("m")
    assert store.next_id("m", "id") == 1 and store.read("m").count() == 0
    store.create("empty", spark.range(0).schema)
    assert store.read("empty").count() == 0 and store.next_id("empty", "id") == 1


def test_loads_refuse_what_they_were_not_told(spark, tmp_path):
    store, rows = Store(spark, f"file://{tmp_path}/w"), spark.range(2)
    for bad in (dict(create=False), dict(write="append", create=False)):
        with pytest.raises(ValueError):
            store.load("t", rows, **bad)
    store.load("t", rows)
    for bad in (dict(rows=rows.withColumn("x", F.lit(1))), dict(rows=rows, write="empty"), dict(rows=rows, write="twice")):
        with pytest.raises(ValueError):
            store.load("t", **bad)
    store.truncate("t")
    store.load("t", rows, "empty")
    store.load("t", rows.withColumn("x", F.lit(1)), "append", new_columns=True)
    assert sorted((r["id"], r["x"] or 0) for r in store.read("t").collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_staged_tables_go_whatever_happens(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/w")
    with pytest.raises(ZeroDivisionError):
        with Staged(store, "tmp", spark.range(3)) as table:
            assert table.count() == 3
            1 / 0
    assert not any((tmp_path / "w").iterdir())


def test_statements_run_in_a_session_of_their_own(spark):
    rows = run_statements(spark, ["CREATE TEMPORARY VIEW even AS SELECT * FROM numbers WHERE id % 2 = 0", "SELECT count(*) AS n FROM even"], {"numbers": spark.range(10)})
    assert rows.first()["n"] == 5 and not spark.catalog.tableExists("even") and not spark.catalog.tableExists("numbers")


def test_core_works_without_the_training_operators(tmp_path):
    root = Path(__file__).resolve().parents[1]
    for name in ("ridgeline", "__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    shutil.rmtree(tmp_path / "ridgeline" / "llm", ignore_errors=True)
    say = "import __spark_entry__ as e; q = e.queries(); assert 'a_city_service' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    assert int(subprocess.run([sys.executable, "-c", say], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()[-1]) > 80


def test_overwriting_partitions_leaves_others(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    overwrite_partitions(spark, spark.createDataFrame([(1, "a"), (2, "b")], "v long, h string"), path, ["h"])
    for _ in range(2):
        overwrite_partitions(spark, spark.createDataFrame([(3, "b")], "v long, h string"), path, ["h"])
    assert {(r["v"], r["h"]) for r in spark.read.parquet(path).collect()} == {(1, "a"), (3, "b")}


def test_schema_sync(spark):
    a, b = spark.range(1).withColumn("x", F.lit(1)), spark.range(1).withColumn("y", F.lit("s"))
    assert sync_report(a.schema, b.schema) == "added:y" and sync_report(a.schema, a.schema) == "no_changes" and sync_report(None, a.schema) == "final_table_created_or_pending"
    left, right = align(a, b)
    assert left.columns == right.columns == ["id", "x", "y"] and sync_all(a, b).columns == ["id", "y"]


def test_checks(spark):
    df = _rows(spark, [(1, 5, "a"), (1, None, "z"), (None, 50, None)])
    assert Q.not_null(df, "v").count() == 1 and Q.unique(df, "k").count() == 1 and Q.accepted_values(df, "x", ["a"]).count() == 1
    assert Q.between(df, "v", 5, 10).count() == 1 and Q.between(df, "v", 5, strictly=True).count() == 1
    assert Q.relationships(df, "k", _rows(spark, [(2, 0, "")]), "k").count() == 2 and Q.unique_combination(df, ["k", "x"]).count() == 0


def test_configs_and_pure_functions():
    assert len(TABLES) == 17 and USER_ROLE.keys == ("user_id", "role_id") and sum(t.append_only for t in TABLES.values()) == 3
    schema = parse_schema("a:L! b:S")
    for bad in ({"keys": ()}, {"columns": ("zz",)}, {"keys": ("zz",)}):
        with pytest.raises(ValueError):
            TableConfig("t", **({"keys": ("a",), "schema": schema} | bad))
    with pytest.raises(ValueError):
        TableConfig("t", ("_ingested_at",), parse_schema("_ingested_at:T"))
    assert normalise_label("My_Table X!") == "my-table-x" and normalise_label("__A--b..") == "a-b" and normalise_label("!!") == "unknown" and len(normalise_label("a" * 99)) == 63
    assert table_labels("ride_fare", "ride_ops_pg", {"team": "Data Eng"}, {"team": "x"}) == {"table": "ride-fare", "source-system": "ride-ops-pg", "team": "x"}
    assert merge_labels({"a": "1"}, {"a": "2"}, {"b": "3"}) == {"a": "2", "b": "3"}
    hour = dt.datetime(2024, 1, 1, 3)
    assert C.cdc_path("cdc.public.ride", hour) == "raw/cdc/cdc.public.ride/year=2024/month=01/day=01/hour=03" and C.partition_suffix(hour) == "2023123120"
    with pytest.raises(ValueError):
        C.resolve_window(None, hour, hour)
    assert C.resolve_window({"window_start": "2024-01-01", "window_end": "2024-01-02"}, hour, hour)[1].day == 2
    assert C.jdbc_options("u", "t", "id", (1, 9), 4)["numPartitions"] == "4" and C.kafka_options("h:1", ["a", "b"])["subscribe"] == "a,b"


def test_extract_casts_and_keeps_the_latest(spark):
    naive = dt.datetime(2024, 1, 1, 7)
    rows = [(1, 5, "a", naive), (1, 5, "b", naive + dt.timedelta(hours=1)), (2, 5, "c", naive + dt.timedelta(days=9))]
    raw = spark.createDataFrame(rows, "refund_id int, ride_id int, x string, updated_at timestamp_ntz")
    config = TableConfig("t", ("refund_id",), parse_schema("refund_id:L! ride_id:L x:S updated_at:T!"), source_zone="Asia/Jakarta")
    got = C.extract(raw, config, (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)), naive).collect()
    assert [(r["refund_id"], r["x"], r["updated_at"].hour, r["_source_system"]) for r in got] == [(1, "b", 1, "ride_ops_pg")]
    assert C.extract(raw, config, None, naive).count() == 2
    assert lookback_from_max(raw.withColumn("d", F.to_date("updated_at")), "d", raw.limit(0).withColumn("d", F.to_date("updated_at")), "d").count() == 3


def test_streams_equal_their_batch_twins(spark, sf_dir):
    q = catalog.queries()
    batch = q["st_cdc_current"](spark, sf_dir)
    assert Counter(batch.collect()) == Counter(q["d_cdc_current"](spark, sf_dir).select(*batch.columns).collect())


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    change = lambda *rows: spark.createDataFrame(rows, "k long, v string, __op string, __source_ts_ms long, __lsn long")
    first = change((1, "a", "c", 10, 1), (2, "b", "c", 10, 2), (2, "c", "u", 10, 3), (3, "d", "c", 11, 4))
    second = change((1, None, "d", 20, 5), (3, "e", "u", 5, 6))
    late = change((1, "z", "u", 15, 7), (4, "n", "c", 1, 8)).withColumn("extra", F.lit("x"))
    seen = []
    for batch in (first, first, second, second, late, first, late):
        upsert_changes(store, "t", batch, "k", most=2)
        seen.append({(r["k"], r["v"]) for r in upserted(store, "t").collect()})
    assert seen == [{(1, "a"), (2, "c"), (3, "d")}] * 2 + [{(2, "c"), (3, "d")}] * 2 + [{(2, "c"), (3, "d"), (4, "n")}] * 3
    assert {r["k"]: r["extra"] for r in upserted(store, "t").collect()} == {2: None, 3: None, 4: "x"}


def test_strict_streams_fail_and_others_set_bad_records_aside(spark):
    schema = parse_schema("a:L b:S")
    text = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": ',), (None,), ("[]",), ('{"a": "no"}',)], "value string")
    good, bad = split_bad(text, schema, F.lit(dt.datetime(2024, 1, 1)))
    assert [tuple(r) for r in good.collect()] == [(1, "x")]
    assert sorted(r["headers"]["error"] for r in bad.collect()) == ["no value", *["not a record of the schema"] * 3] and bad.first()["headers"]["schema"] == schema.simpleString()
    assert parse_strict(text.limit(1), schema).count() == 1
    with pytest.raises(Exception, match="MALFORMED"):
        parse_strict(text.filter("value like '%no%' or value like '%: '"), schema).collect()


def test_sinks_begin_files_with_triggers_and_after_records(spark, tmp_path):
    from ridgeline.streaming.cdc import SinkSettings, file_stream, start_sink

    files = lambda folder: sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*.parquet"))
    source, out = tmp_path / "in", tmp_path / "out"
    spark.range(2500).coalesce(1).write.parquet(str(source))
    stream = lambda: file_stream(spark, f"{source}/*.parquet", spark.range(0).schema)
    start_sink(stream(), f"{out}/a", str(tmp_path / "oa"), SinkSettings(1000, "1 hour"), live=False).awaitTermination()
    assert len(files(out / "a")) == 3
    query = start_sink(stream(), f"{out}/b", str(tmp_path / "ob"), SinkSettings(9000, "1 second"))
    try:
        query.processAllAvailable()
        spark.range(10).coalesce(1).write.mode("append").parquet(str(source))
        query.processAllAvailable()
        assert query._jsq.id() is not None and len(files(out / "b")) == 2 and {x.split("/")[0] for x in files(out / "b")} == {"batch=0", "batch=1"}
    finally:
        query.stop()


def test_clock_folders_follow_the_zone(spark, tmp_path):
    hour = hour_folders("Asia/Jakarta", F.lit(dt.datetime(2024, 12, 31, 17, 59)).cast("timestamp_ntz"))
    row = spark.range(1).select(*[c.alias(k) for k, c in hour.items()]).first()
    assert tuple(row) == ("2025", "01", "01", "00") and SINKS["gcs"].most_records > SINKS["minio"].most_records
    new_york = spark.range(1).select(format_local(F.lit(dt.datetime(2024, 7, 1, 3)).cast("timestamp_ntz"), "yyyy-MM-dd HH", "America/New_York").alias("x"), today("Asia/Tokyo", F.lit(dt.datetime(2024, 7, 1, 16)).cast("timestamp_ntz")).alias("d")).first()
    assert new_york["x"] == "2024-06-30 23" and new_york["d"] == dt.date(2024, 7, 2)


def test_generated_demand_follows_its_rules(spark):
    from ridgeline.sources import datagen

    made = datagen.tables(spark, 20_000, days=181)
    rides = made["ride"].withColumn("at", local(F.col("requested_at"))).select("*", F.to_date("at").alias("d"), F.hour("at").alias("h")).cache()
    assert rides.count() == 20_000 and rides.agg(F.count_distinct("d")).first()[0] == 181
    share = lambda what: rides.agg(F.avg(F.expr(what).cast("double"))).first()[0]
    assert share("h between 7 and 9 or h between 17 and 20") > 0.5 and share("month(d) = 6") > 1.15 * share("month(d) = 1")
    assert 0.6 < share("city_code = 'JKT'") < 0.72 and share("service_type = 'BIKE'") > 0.5
    assert 0.65 < share("ride_status = 'COMPLETED'") < 0.86 and 0.02 < share("ride_status = 'PAYMENT_FAILED'") < 0.08
    bikes = {r["w"]: r["x"] for r in rides.groupBy(F.expr("weekday(d) >= 5").alias("w")).agg(F.avg(F.expr("service_type = 'BIKE'").cast("double")).alias("x")).collect()}
    assert bikes[False] > bikes[True] + 0.05
    used = made["promo_usage"].join(made["promotion"].filter("promotion_status = 'ACTIVE'"), "promotion_id").groupBy("promo_code").count().collect()
    names = {r["promo_code"] for r in used}
    assert {c[0] for c in datagen.CAMPAIGNS} <= names
    assert made["promo_usage"].join(made["promotion"].filter("promotion_status = 'ACTIVE'"), "promotion_id").filter("discount_amount_applied > max_discount_amount").count() == 0


def test_live_rides_follow_the_clock(spark, tmp_path):
    from ridgeline.sources import datagen

    rides = datagen.live(spark.range(3000).withColumnRenamed("id", "value"))
    got = rides.agg(F.count("*"), F.count_distinct("requested_at"), F.min("requested_at"), F.max("requested_at"), F.count_distinct("ride_id")).first()
    assert tuple(got) == (3000, 300, dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 1, 4, 59), 3000)
    assert {r["outcome"] for r in rides.select("outcome").distinct().collect()} <= set(datagen.OUTCOMES)
    stream = datagen.live_rides(spark)
    assert stream.isStreaming and stream.dtypes == rides.dtypes
    store = Store(spark, f"file://{tmp_path}/w")
    store.replace("ride", rides)
    assert [r["ride_id"] for r in datagen.reserved_ids(spark, store, "ride", "ride_id", 3).collect()] == [3001, 3002, 3003]


def test_readers_say_what_is_absent(spark):
    for read in (lambda: C.read_jdbc(spark, "jdbc:postgresql://h/db", TABLES["ride"], (1, 9), 4), lambda: C.read_topics(spark, "h:1", ["t"], "{}")):
        with pytest.raises(ValueError, match="add"):
            read()


def test_ingest_syncs_the_schema_and_is_idempotent(spark, tmp_path):
    from ridgeline.plans.ingest import LINEAGE, bronze, ingest

    store, now = Store(spark, f"file://{tmp_path}/b"), dt.datetime(2024, 5, 1)
    day = lambda d: dt.datetime(2024, 1, d)
    config = TableConfig("t", ("id",), parse_schema("id:L! x:S updated_at:T!"), unit="day")
    wider = TableConfig("t", ("id",), parse_schema("id:L! x:S updated_at:T! y:S"), unit="day")
    old = spark.createDataFrame([(1, "a", day(1)), (2, "a", day(2)), (3, "a", day(9))], "id long, x string, updated_at timestamp_ntz")
    new = spark.createDataFrame([(1, "b", day(3), "n"), (2, "old", day(1), "n"), (4, "b", day(4), None)], "id long, x string, updated_at timestamp_ntz, y string")
    assert ingest(store, config, old, (day(1), day(5)), now).schema == "final_table_created_or_pending"
    for report in ("added:y", "no_changes"):
        load = ingest(store, wider, new, None, now, {"Team": "x y"})
        assert load.schema == report and load.labels == {"team": "x-y", "table": "t", "source-system": "ride-ops-pg"}
        assert {(r["id"], r["x"], r["y"]) for r in bronze(store, config).collect()} == {(1, "b", "n"), (2, "a", None), (4, "b", None)}
    assert store.current("t")["partition"] == ["__bucket", "_part"] and store.read(LINEAGE).count() == 3
    assert ingest(store, config, old, (day(8), day(10)), now).schema == "no_changes" and bronze(store, config).count() == 4


def test_probe_and_formats(spark, sf_dir, tmp_path):
    assert C.probe(spark, sf_dir) == "ready" and C.probe(spark, str(tmp_path / "none")) == "skipped"
    assert C.has_format(spark, "parquet") and not C.has_format(spark, "no-such-format")


def test_models_hold_their_checks(spark, sf_dir):
    from ridgeline.plans.marts import build

    rides, payments, city = (build(spark, sf_dir, n).cache() for n in ("fct_rides", "fct_payments", "agg_daily_city_service"))
    for df, col in ((rides, "ride_sk"), (payments, "payment_transaction_sk"), (payments, "idempotency_key")):
        assert Q.unique(df, col).count() == 0 and Q.not_null(df, col).count() == 0
    for dim in ("rider", "driver", "vehicle"):
        assert Q.relationships(rides, f"{dim}_sk", build(spark, sf_dir, f"dim_{dim}"), f"{dim}_sk").count() == 0
    assert Q.between(rides, "total_fare", 0).count() == 0 and Q.between(city, "completion_rate", 0, 1).count() == 0
    assert Q.unique_combination(city, ["metric_date", "city_code", "service_type"]).count() == 0
    assert rides.count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    shares = {r["ride_status"]: r["n"] for r in rides.groupBy("ride_status").agg((F.count("*") / rides.count()).alias("n")).collect()}
    assert shares["COMPLETED"] > 0.7 and 0 < shares["PAYMENT_FAILED"] < 0.1


def test_models_build_by_increments(spark, sf_dir, tmp_path):
    from ridgeline.plans.marts import MATERIALISED, Session, materialise
    from ridgeline.plans.stand_in import StandIn

    class Until(StandIn):
        """The operational tables as they were on a day."""

        def __init__(self, spark, sf_dir, last):
            super().__init__(spark, sf_dir)
            self.last = last

        def __getitem__(self, name):
            df = super().__getitem__(name)
            return df.filter(F.col("updated_at") < F.lit(self.last)) if name in ("ride", "ride_fare", "payment_transaction", "payment_refund", "promo_usage", "review", "support_ticket") else df

    store, now = Store(spark, f"file://{tmp_path}/marts"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    ends = (dt.date(1995, 3, 1), dt.date(1995, 3, 3), dt.date(1995, 3, 3))
    for name in ("fct_rides", "agg_daily_city_service"):
        for last in ends:  # the second of equal days changes nothing
            sources = Until(spark, sf_dir, dt.datetime.combine(last, dt.time()))
            got = materialise(spark, sources, store, name, last, now)
        want = Session(spark, sources, now).ref(name)
        if name == "fct_rides":
            assert got.count() == want.count() > 20 and len(store.current(name)["folders"]) > 20
            assert got.select("ride_sk").exceptAll(want.select("ride_sk")).count() == 0
        key = MATERIALISED[name][1]
        assert not key or Q.unique(got, key).count() == 0
    days = store.read("agg_daily_city_service").groupBy("metric_date").agg(F.sum("requested_rides").alias("n"))
    facts = store.read("fct_rides").groupBy(F.col("requested_date").alias("metric_date")).agg(F.count("*").alias("n"))
    assert Counter(days.collect()) == Counter(facts.select("metric_date", "n").collect())


def test_generated_models_hold_their_checks(spark):
    from ridgeline.plans.marts import build_generated

    rides = build_generated(spark, 400, "fct_rides")
    assert rides.count() == 400 and Q.unique(rides, "ride_sk").count() == 0


def test_promo_usage_has_every_brand(spark, sf_dir):
    brands = duckdb.connect().execute(f"select count(distinct p_brand) from '{sf_dir}/lineitem.parquet' join '{sf_dir}/part.parquet' on l_partkey = p_partkey").fetchone()[0]
    assert catalog.queries()["v_promo_usage"](spark, sf_dir).count() == brands == 25
