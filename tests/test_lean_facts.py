"""What a query computes of the facts that it reads: the same rows, without lookups and columns that it doesn't read."""

import pytest
from pyspark.sql import functions as F

from ridgeline.plans import marts
from ridgeline.plans.stand_in import BUILT, StandIn

NOW = f"TIMESTAMP_NTZ '{BUILT}'"


@pytest.mark.parametrize("name", ["fct_support_tickets", "agg_daily_payment_method", "agg_daily_refunds", "fct_payments"])
def test_queries_store_no_facts_and_give_the_rows_of_whole_ones(spark, sf_dir, name, monkeypatch):
    monkeypatch.setattr(marts, "_KEPT", {})
    made = marts.build(spark, sf_dir, name)
    _, store = marts.kept(spark, sf_dir)
    assert not [x for x in marts.MODELS if x.startswith(("fct_", "agg_")) and store.exists(x)]
    whole = marts.Session(spark, StandIn(spark, sf_dir), F.expr(NOW)).ref(name).select(*[F.col(f.name).cast(f.dataType) for f in made.schema])
    assert sorted(map(str, made.collect())) == sorted(map(str, whole.collect())) and made.count() > 0


def test_aggregates_look_up_what_they_read(spark, sf_dir):
    reads = {}
    for name in ("agg_daily_refunds", "agg_daily_payment_method", "agg_daily_city_service", "agg_driver_performance_daily"):
        s = marts.Session(spark, StandIn(spark, sf_dir), F.expr(NOW), lean=True)
        s.ref(name)
        reads[name] = {x for x, _ in s.lineage if x.startswith("dim_")}
    assert reads == {"agg_daily_refunds": set(), "agg_daily_payment_method": {"dim_payment_method"}, "agg_daily_city_service": set(), "agg_driver_performance_daily": {"dim_driver"}}


def test_a_ride_with_two_promotions_is_two_rows_in_any_part(spark, sf_dir):
    rows = StandIn(spark, sf_dir)
    twice = rows["promo_usage"].filter("ride_id % 4 = 1")
    sources = {name: rows[name] for name in ("ride", "ride_fare", "payment_transaction", "support_ticket", "review")} | {"promo_usage": twice.unionByName(twice)}
    s = marts.Session(spark, sources, F.expr(NOW), lean=True)
    n, used = sources["ride"].count(), twice.count()
    assert used and s.part("fct_rides", ["ride_id"]).count() == s.part("fct_rides", ["ride_id", "total_fare", "rating_score"]).count() == n + used
