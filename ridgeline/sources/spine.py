"""Date spine and dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def date_dimension(spark: SparkSession, start: str = "2024-01-01", end: str = "2050-12-31") -> DataFrame:
    """One row for each day from start up to, but not including, end."""
    days = spark.sql(f"SELECT explode(sequence(date'{start}', date_sub(date'{end}', 1), interval 1 day)) AS d")
    big = lambda x, name: f"cast({x} as bigint) AS {name}"
    return days.selectExpr(
        "d AS date_day", big("year(d)", "year_number"), big("quarter(d)", "quarter_of_year"), big("month(d)", "month_of_year"), big("weekofyear(d)", "iso_week_of_year"), big("dayofweek(d)", "day_of_week"),
        big("day(d)", "day_of_month"), big("dayofyear(d)", "day_of_year"), "trunc(d, 'month') AS month_start_date", "last_day(d) AS month_end_date", "trunc(d, 'quarter') AS quarter_start_date", "trunc(d, 'year') AS year_start_date",
    )
