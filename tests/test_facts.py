"""Facts at size: what is stored, and how keys of dimensions are looked up."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import history as H
from ridgeline.plans import marts


def _at(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


@pytest.mark.parametrize("small", [True, False])
def test_piles_find_what_the_sweep_finds(spark, small):
    """Ends, ties, gaps, absent keys and times, and facts twice."""
    versions = [(1, 0, 5, "a"), (1, 5, 5, "none"), (1, 5, 9, "b"), (1, 12, None, "c"), (2, 3, 4, "d"), (None, 0, None, "x"), (3, None, None, "y"), (4, 2, None, "e")]
    dim = spark.createDataFrame([(k, _at(a), _at(b), v) for k, a, b, v in versions], "k long, valid_from timestamp_ntz, valid_to timestamp_ntz, v string")
    facts = [(k, h) for k in (1, 2, 3, 4, 5, None) for h in (*range(-1, 15), None)] + [(1, 5), (1, 5)]
    df = spark.createDataFrame([(n, k, _at(h)) for n, (k, h) in enumerate(facts)] + [(0, 1, _at(-1))], "n long, k long, at timestamp_ntz")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(H.as_of_piles(df, dim, "k", F.col("at"), ["v"], small)) == key(H.as_of_join(df, dim, "k", F.col("at"), ["v"]))
    assert H.version_counts(dim, "k") == (3, 4)


def test_facts_store_no_step_between(spark, sf_dir, monkeypatch):
    """Large dimensions are found by narrow rows with the same result, and nothing between the rides and their facts is written."""
    made = {}
    for bound in (0, 400_000):
        monkeypatch.setattr(marts, "SMALL", bound)
        made[bound] = sorted(map(str, marts.build(spark, sf_dir, "fct_rides").drop(marts.LOADED).collect()))
    _, store = marts.kept(spark, sf_dir)
    assert made[0] == made[400_000] and len(made[0]) > 1000
    assert not [x for x in ("src_asked", "src_priced", "int_ride_lifecycle", "int_ride_financials", "int_customer_feedback") if store.exists(x)]
