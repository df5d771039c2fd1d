"""The fact of rides asked as a query: what it stores, and that every way of looking keys up finds the same."""

import pytest
from pyspark.sql import functions as F

from ridgeline.plans import marts
from ridgeline.plans.stand_in import BUILT, StandIn

NOW = f"TIMESTAMP_NTZ '{BUILT}'"


@pytest.fixture(scope="module")
def whole(spark, sf_dir):
    """Rows by the sweep, over whole dimensions that aren't stored."""
    rides = marts.Session(spark, StandIn(spark, sf_dir), F.expr(NOW)).ref("fct_rides")
    return sorted(map(str, rides.select(*[F.col(f.name).cast("double") if f.dataType.simpleString().startswith("decimal") else F.col(f.name) for f in rides.schema]).collect()))


@pytest.mark.parametrize("small, carried", [(400_000, 4), (0, 4), (0, 0)])
def test_rides_store_of_dimensions_what_lookups_read(spark, sf_dir, whole, monkeypatch, small, carried):
    """Broadcast, carried with payments and promotions, or found by narrow rows: no dimension or snapshot is stored whole."""
    monkeypatch.setattr(marts, "_KEPT", {})
    monkeypatch.setattr(marts, "SMALL", small)
    monkeypatch.setattr(marts, "CARRIED", carried)
    made = marts.build(spark, sf_dir, "fct_rides")
    assert sorted(map(str, made.collect())) == whole and len(whole) > 1000
    _, store = marts.kept(spark, sf_dir)
    dims = ("rider", "driver", "vehicle", "payment_method", "promotion")
    assert not [x for x in dims if store.exists(f"dim_{x}")] and not [x for x in marts._SNAPSHOTS if store.exists(f"snap_{x}")]
    assert all(store.read(f"keys_{x}").columns == [f"{x}_id", "valid_from", "valid_to", f"{x}_sk"] for x in dims)


@pytest.mark.parametrize("carried", [4, 0])
def test_rides_twice_and_without_keys_find_their_versions(spark, sf_dir, monkeypatch, carried):
    """Two rides of one id with other riders and times, payments without a method, and rides without a rider, by large dimensions and by the sweep."""
    rows = StandIn(spark, sf_dir)
    ride, paid = rows["ride"], rows["payment_transaction"]
    other = ride.filter("ride_id % 3 = 0").withColumns({"rider_id": F.col("rider_id") + 1, "requested_at": F.expr("requested_at + INTERVAL '400' DAY")})
    rides = ride.withColumn("rider_id", F.when(F.col("ride_id") % 5 > 0, F.col("rider_id"))).unionByName(other)
    methods = paid.withColumn("payment_method_id", F.when(F.col("ride_id") % 4 > 0, F.col("payment_method_id")))

    class Odd(StandIn):
        def __getitem__(self, name):
            return {"ride": rides, "payment_transaction": methods}.get(name) or rows[name]

    odd = Odd(spark, sf_dir)
    swept = marts.Session(spark, odd, F.expr(NOW)).ref("fct_rides")
    monkeypatch.setattr(marts, "SMALL", 0)
    monkeypatch.setattr(marts, "CARRIED", carried)
    monkeypatch.setattr(marts, "_KEPT", {})
    _, store = marts.kept(spark, sf_dir)
    found = marts.Session(spark, odd, F.expr(NOW), store, lean=True).ref("fct_rides")
    assert sorted(map(str, found.collect())) == sorted(map(str, swept.collect())) and found.filter("rider_sk is null").count() > 0
