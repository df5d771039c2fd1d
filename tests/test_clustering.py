"""Places of values among quantiles."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.operators import clustering


def test_places_are_found_by_bisection(spark):
    bounds = [3, 5, 5, 9, 14]
    rows = spark.createDataFrame([(k,) for k in (*range(-1, 17), None)], "v long")
    place = clustering._place(F.col("v"), sorted(set(bounds)), T.LongType(), lambda n: n)
    got = rows.select("v", place.alias("p")).collect()
    assert all(r["p"] == sum(b <= r["v"] for b in set(bounds)) if r["v"] is not None else r["p"] == 0 for r in got)
    assert "lambda" not in rows.select(place)._jdf.queryExecution().optimizedPlan().toString()
