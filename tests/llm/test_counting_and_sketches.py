"""Importance resampling, HyperMinHash and dominance counting against brute force and SQL."""

import datetime as dt
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, alike, brute_components, local_rows, near_copies, odd_docs, sorted_rows

from ridgeline.llm import dominance, importance, minhash_dedup, ngram_join
from ridgeline.llm.bytewords import mix


@pytest.fixture(scope="module")
def docs(spark):
    return odd_docs(spark).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# 11


def brute_draw(rows, target, longest, buckets, least=20, share=10):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        found = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode())
        return len(found), [zlib.crc32(b" ".join(found[k : k + n])) % buckets for n in range(1, longest + 1) for k in range(len(found) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in rows:
        n, found = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in found)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * share // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("longest, buckets, share, tiny", [(1, 10_000, 10, False), (3, 50, 60, True)])
def test_draw_equals_brute_force(spark, docs, monkeypatch, longest, buckets, share, tiny):
    if tiny:  # tries are emptied again and again, and candidates lie in many ranges
        monkeypatch.setattr(importance, "NODE_BYTES", 1 << 13)
        monkeypatch.setattr(importance, "ranked", lambda *a, f=importance.ranked: f(*a, most=7))
    target = ["Karst lost mist zur", None, "", "one two, three-four five", "karst " * 30]
    aims = spark.createDataFrame([(t, 1) for t in target], "text string, id long")
    got = importance.resample(docs, aims, longest=longest, buckets=buckets, num=share).collect()
    assert sorted_rows(map(tuple, got)) == sorted_rows(brute_draw(local_rows(docs), target, longest, buckets, share=share))


def test_draw_of_nothing(spark, docs, nothing):
    assert importance.resample(nothing, docs).count() == 0
    got = importance.resample(docs, nothing).collect()
    assert sorted_rows(map(tuple, got)) == sorted_rows(brute_draw(local_rows(docs), [], 1, 10_000))
    short = importance.resample(docs.filter("text is null or text = ''"), docs).collect()
    assert all((r["n_features"], r["weight"], r["rank"]) == (0, 0, None) for r in short) and short


def test_trie_carries_states_on():
    trie = importance.Trie(3, 1 << 32)
    trie.walk([b"a", b"b", b"a", b"b", b"c"])
    a = trie.top[b"a"]
    assert a[0] == 2 and a[2][b"b"][0] == 2 and a[2][b"b"][1] == zlib.crc32(b"a b") and a[2][b"b"][2][b"c"][1] == zlib.crc32(b"a b c")
    totals = np.zeros(7, np.int64)
    trie.buckets = 7
    trie.drain(totals)
    assert totals.sum() == 5 + 4 + 3 and not trie.top


# 12


def test_registers_are_the_least_values_of_their_buckets():
    rng = np.random.default_rng(5)
    for n in (1, 2, 30, 256, 257, 300, 4000):
        shingles = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        got = minhash_dedup.registers(shingles)
        values = mix(shingles[None, :] ^ minhash_dedup._SALTS)
        for place in range(0, minhash_dedup.REGISTERS, 37):
            own = values[place // minhash_dedup.BUCKETS]
            least = int(min(int(v) ^ ((place % minhash_dedup.BUCKETS) << 59) for v in own))
            digits = f"{least:064b}"
            zeros = min(len(digits) - len(digits.lstrip("0")), 53)
            mantissa = int(digits[zeros + 1 : zeros + 11].ljust(10, "0"), 2) if zeros < 53 else 0
            assert int(got[place]) == zeros << 10 | mantissa
        assert n < 2000 or (got >> 10).min() >= minhash_dedup.BITS  # no bucket is empty then
    assert sorted(minhash_dedup.BANDS.ravel()) == list(range(minhash_dedup.REGISTERS))


@pytest.mark.parametrize("a, b, common", [(5, 4, 4), (20, 18, 17), (400, 300, 250), (3000, 3000, 0)])
def test_estimates_are_right_on_average(a, b, common):
    rng = np.random.default_rng(a)
    equal, fewest = [], 64
    for _ in range(120):
        pool = rng.integers(0, 1 << 64, a + b - common, dtype=np.uint64)
        x, y = minhash_dedup.registers(pool[:a]), minhash_dedup.registers(pool[a - common :])
        equal.append((x == y).mean())
        fewest = min(fewest, (minhash_dedup.band_tokens(x[None]) == minhash_dedup.band_tokens(y[None])).sum())
    found = minhash_dedup.estimate(np.array(equal), np.array([a]), np.array([b]))
    true = common / (a + b - common)
    assert abs(found.mean() - true) < 0.02 and (true < 0.8 or fewest >= minhash_dedup.ASKED)
    lowest = minhash_dedup.Sketched(4, 80, 100).lowest(np.array([min(a, b)]))[0]
    assert true < 0.8 or found.min() > lowest


def test_registers_of_other_sets_collide_as_computed():
    rng = np.random.default_rng(11)
    same = total = 0
    for _ in range(400):
        x, y = (minhash_dedup.registers(rng.integers(0, 1 << 64, 3000, dtype=np.uint64)) for _ in range(2))
        same, total = same + (x == y).sum(), total + len(x)
    want = minhash_dedup.collisions(np.array([3000]), np.array([3000]))[0]
    assert 0.5 * want < same / total < 2 * want


@pytest.mark.parametrize("width, num, block", [(4, 80, 1 << 18), (5, 80, 300)])
def test_near_copies_equal_brute_force(spark, docs, monkeypatch, width, num, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = [(1000 + k, t) for k, t in enumerate(near_copies(width) + alike(width))] + local_rows(docs)
    df = spark.createDataFrame([(d, t, "c", b"r") for d, t in rows], "doc_id long, text string, component_id string, registers binary").repartition(3)
    got = minhash_dedup.dedup(df, width=width, num=num).collect()
    want = [(d, n, c, d == c) for d, n, c in brute_components(rows, width, num, 100)]
    assert sorted_rows(map(tuple, got)) == sorted_rows(want)


def test_near_copies_of_nothing(nothing, spark):
    assert minhash_dedup.dedup(nothing).count() == 0
    alone = spark.createDataFrame([(3, None), (2, ""), (1, " ")], "doc_id long, text string")
    assert sorted_rows(map(tuple, minhash_dedup.dedup(alone).collect())) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


# 13


def brute_above(rows, step=1):
    made = []
    for sale, at, total in rows:
        slot = None if at is None else int((at - dt.datetime(1970, 1, 1)).total_seconds() // 60)
        level = None if total is None or not math.isfinite(total) else math.floor(math.floor(100 * total + 0.5) / step)
        made.append((sale, slot, level, 1 + zlib.crc32(b"" if sale is None else str(sale).encode()) % 5))
    whole = [r for r in made if r[1] is not None and r[2] is not None]
    out = []
    for sale, slot, level, _ in made:
        above = [r for r in whole if slot is not None and level is not None and r[1] < slot and r[2] > level]
        out.append((sale, slot, level, *((len(above), sum(r[3] for r in above)) if slot is not None and level is not None else (None, None))))
    return out


def sales_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        at = dt.datetime(2024, 3, 10) + dt.timedelta(seconds=rng.randrange(40_000)) if k % 3 else dt.datetime(2024, 3, 10, 2, 30)
        total = rng.choice((rng.randrange(3000) / 100, 19.995, -4.25, 10.0))
        rows.append((None if k % 41 == 40 else k - 5, None if k % 17 == 5 else at, None if k % 13 == 4 else float("nan") if k == 50 else float("inf") if k == 51 else total))
    return rows + rows[:4] + [(n, dt.datetime(1969, 12, 31, 23, 59, 30), 5.0)]


@pytest.mark.parametrize("most, tile, step", [(1 << 17, 256, 1), (1, 2, 1), (37, 5, 25)])
def test_dominance_equals_brute_force(spark, monkeypatch, most, tile, step):
    monkeypatch.setattr(dominance, "TILE", tile)
    rows = sales_rows(260, most)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "sale_id long, sold_at timestamp_ntz, total double, slot int, n int, id int").repartition(4)
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # 02:30 of that day isn't on its clocks
        got = sorted_rows(map(tuple, dominance.dominance(df, most=most, step=step).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == sorted_rows(brute_above(rows, step))
    instants = df.withColumn("sold_at", F.col("sold_at").cast("timestamp"))
    assert sorted_rows(map(tuple, dominance.dominance(instants, most=most, step=step).collect())) == got


def test_dominance_of_nothing_and_of_one_slot_or_level(spark):
    schema = "sale_id long, sold_at timestamp_ntz, total double"
    assert dominance.dominance(spark.createDataFrame([], schema)).count() == 0
    at = dt.datetime(2024, 1, 1)
    for rows in ([(k, at, float(k)) for k in range(90)], [(k, at + dt.timedelta(minutes=k), 1.0) for k in range(90)], [(1, None, None), (2, at, None)]):
        got = dominance.dominance(spark.createDataFrame(rows, schema), most=8).collect()
        assert len(got) == len(rows) and {r["n_sales"] for r in got} == ({0} if len(rows) > 2 else {None})


def test_dominance_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view sales as select * from '{sf_dir}/sales.parquet'")
    want = con.execute(dominance.ORACLE).fetchall()
    assert sorted_rows(map(tuple, dominance.dominance(spark.read.parquet(f"{sf_dir}/sales.parquet"), most=90).collect())) == sorted_rows(want)
