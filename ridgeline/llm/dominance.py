"""Dominance counting: for every row, how many rows come earlier and lie strictly higher.

Rows are collapsed to their distinct (slot, level) cells with the sums that they stand for. The cells are dealt twice by
ranges: by level to bands, and by slot to strips. Where the two cross lies a tile. A cell's count is made of four parts:

* within its band, tiles of TILE cells in the order of their slots: a tile's dense two-dimensional cumulative sums, and a
  carry row that holds, for every level of the band, the sums of all tiles before;
* within its strip, from the bands above: the same sums, whose carry column holds one entry for each band;
* from all strips before and all bands above: cumulative sums over the totals of the tiles, along the bands and then
  along the strips.

Ranges of slots are ranges of (slot, level), ranges of levels those of (level, slot), both ascending. So a slot or a level
that holds a third of all cells is cut like any other, and cells of one slot (or level) never count for each other: of two
with one slot the one in the earlier strip has the lower level, and of two with one level the one in the upper band has the
later slot. Nothing that grows with the input goes through one task, to the driver or into a broadcast: a task holds a
strip or a band, and there are at most as many tiles as cells.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ridgeline.llm.shared import Workspace

#: Cells of a strip or band, about; cells of a tile in numpy; rows of an Arrow batch that a task gives.
CELLS, TILE, BATCH = 1 << 17, 256, 1 << 16


def sums_above(y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each cell in the order given: the sums of the weights (n rows, some columns) of the cells before it with a larger y."""
    levels, rank = np.unique(y, return_inverse=True)
    width = weights.shape[1]
    held = np.zeros((len(levels), width), np.int64)  # by level, of the tiles before
    carry = np.zeros((len(levels) + 1, width), np.int64)  # the same, summed from the highest level down
    out = np.empty_like(weights)
    for first in range(0, len(y), TILE):
        part = slice(first, first + TILE)
        own, at = np.unique(rank[part], return_inverse=True)
        rows = np.arange(len(at))
        tile = np.zeros((len(at) + 1, len(own) + 1, width), np.int64)
        tile[rows + 1, at] = weights[part]
        tile = tile.cumsum(0)[:, ::-1].cumsum(1)[:, ::-1]
        out[part] = tile[rows, at + 1] + carry[own[at] + 1]
        held[own] += tile[-1, :-1] - tile[-1, 1:]
        if first + TILE < len(y):
            carry[:-1] = held[::-1].cumsum(0)[::-1]
    return out


def _swept(cells: DataFrame, by: str, add: bool) -> DataFrame:
    """The cells of each partition with what `sums_above` gives in the order of (slot, level), by the column `by`; `add`: on top of n_above and w_above."""
    schema = T.StructType([*[f for f in cells.schema if f.name not in ("n_above", "w_above")], T.StructField("n_above", T.LongType()), T.StructField("w_above", T.LongType())])

    def run(batches):
        table = pa.Table.from_batches(list(batches))
        if not len(table):
            return
        get = {name: table.column(name).to_numpy() for name in table.column_names}
        order = np.lexsort((get["level"], get["slot"]))
        get = {name: values[order] for name, values in get.items()}
        found = sums_above(get[by], np.stack([get["n"], get["w"]], 1))
        for k, name in enumerate(("n_above", "w_above")):
            get[name] = found[:, k] + (get[name] if add else 0)
        for first in range(0, len(order), BATCH):
            cut = slice(first, first + BATCH)
            yield pa.RecordBatch.from_arrays([pa.array(get[f.name][cut]) for f in schema], names=schema.names)

    return cells.mapInArrow(run, schema)


def _corners(tiles: DataFrame, strips: int, bands: int) -> DataFrame:
    """strip, band, n_corner, w_corner for every tile: the sums of the tiles in strips before and bands above."""
    grid = tiles.sparkSession.range(strips).select(F.col("id").cast("int").alias("strip"), F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    full = grid.join(tiles, ["strip", "band"], "left").fillna(0, ["n", "w"])
    before = Window.partitionBy("band").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)
    upper = Window.partitionBy("strip").orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    for name, window in (("before", before), ("corner", upper)):
        full = full.select("strip", "band", *[F.coalesce(F.sum(c if name == "before" else f"{c}_before").over(window), F.lit(0)).alias(f"{c}_{name}") for c in "nw"], *["n", "w"] * (name == "before"))
    return full


def count_above(cells: DataFrame, work: Workspace, most: int = CELLS) -> DataFrame:
    """slot, level, n_above, w_above of distinct cells (slot, level, n, w: longs without nulls), for the cells of smaller slot and larger level.

    There are as many strips and bands as hold about `most` cells each, but never more tiles than cells. The result reads tables in `work`.
    """
    cells = work.put("cells", cells.select("slot", "level", "n", "w"))
    held = cells.count()
    sides = max(1, min(-(-held // most), math.isqrt(held)))
    banded = cells.repartitionByRange(sides, "level", "slot").withColumn("band", F.spark_partition_id())
    banded = work.put("banded", _swept(banded, "level", add=False))
    work.drop("cells")
    stripped = banded.repartitionByRange(sides, "slot", "level").withColumn("strip", F.spark_partition_id())
    stripped = work.put("stripped", _swept(stripped, "band", add=True))
    work.drop("banded")
    tiles = work.put("tiles", stripped.groupBy("strip", "band").agg(F.sum("n").alias("n"), F.sum("w").alias("w")))
    last = tiles.agg(F.max("strip"), F.max("band")).first()
    corners = work.put("corners", _corners(tiles, (last[0] or 0) + 1, (last[1] or 0) + 1))
    total = lambda c: (F.col(f"{c}_above") + F.col(f"{c}_corner")).alias(f"{c}_above")
    return stripped.join(corners, ["strip", "band"]).select("slot", "level", total("n"), total("w"))


def minute_of(df: DataFrame, time_col: str, seconds: int = 60) -> Column:
    """floor(whole seconds since 1970 / seconds) of a time, taken as UTC whatever the session's zone is."""
    at = df[time_col]
    if df.schema[time_col].dataType == T.TimestampNTZType():
        # parts of a time without a zone don't depend on the session's
        whole = F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    else:
        whole = F.unix_seconds(at)
    return F.floor(whole / seconds).cast("long")


def stands_for(sale_id: Column) -> Column:
    """1 + (crc32 of the id as decimal digits) mod 5; a null id counts as the empty text."""
    return 1 + F.crc32(F.coalesce(sale_id.cast("string"), F.lit("")).cast("binary")) % 5


def dominance(sales: DataFrame, id_col: str = "sale_id", time_col: str = "sold_at", value_col: str = "total", seconds: int = 60, step: int = 1, most: int = CELLS, work: Workspace | None = None) -> DataFrame:
    """id_col, slot, level, n_sales, n_rows, one row for each input row.

    slot: whole seconds since 1970 (UTC) by `seconds`; level: floor(floor(100 * value + 0.5) / step), in doubles. n_sales: rows with a
    smaller slot and a strictly larger level; n_rows: the sum of what those stand for (`stands_for` of the id). A row whose
    time or value is null (or whose value is no finite number) has a null slot or level, counts for nobody and has null
    counts. Repeated rows count each; rows of one cell don't count for each other. An empty table gives none. Other columns
    don't matter, whatever their names.
    """
    work = work or Workspace(sales.sparkSession, "dominance")
    value = F.floor(F.floor(100 * sales[value_col].cast("double") + 0.5) / step).cast("long")
    finite = F.abs(sales[value_col].cast("double")) < float("inf")  # false for NaN, too, which is larger than any number
    rows = sales.select(sales[id_col].alias("id"), minute_of(sales, time_col, seconds).alias("slot"), F.when(finite, value).alias("level"))
    whole = rows.filter("slot is not null and level is not null")
    cells = whole.groupBy("slot", "level").agg(F.count(F.lit(1)).alias("n"), F.sum(stands_for(F.col("id"))).alias("w"))
    counts = count_above(cells, work, most).select(F.col("slot").alias("_slot"), F.col("level").alias("_level"), "n_above", "w_above")
    # rows without a cell match nothing; their hash replaces the null, or all of them would meet in one task
    place = F.coalesce("slot", F.xxhash64("id"))
    joined = rows.withColumn("_place", place).join(counts, (F.col("_place") == F.col("_slot")) & (F.col("level") == F.col("_level")), "left")
    there = F.col("slot").isNotNull()
    return joined.select(F.col("id").alias(id_col), "slot", "level", *[F.when(there, F.col(a)).alias(b) for a, b in (("n_above", "n_sales"), ("w_above", "n_rows"))])


#: crc32 by its table, made of the polynomial, over the digits of an id.
ORACLE = """
WITH bits AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
s AS (SELECT sale_id, CAST(floor(floor(epoch(sold_at)) / 60) AS BIGINT) AS slot, CAST(floor(floor(100 * total + 0.5) / 1) AS BIGINT) AS level,
  1 + xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) + 1 AS INTEGER)])), 4294967295) % 5 AS w FROM sales, bits),
c AS (SELECT slot, level, count(*) AS n, CAST(sum(w) AS BIGINT) AS w FROM s WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY 1, 2),
a AS (SELECT c.slot, c.level, CAST(coalesce(sum(d.n), 0) AS BIGINT) AS n_sales, CAST(coalesce(sum(d.w), 0) AS BIGINT) AS n_rows
  FROM c LEFT JOIN c d ON d.slot < c.slot AND d.level > c.level GROUP BY 1, 2)
SELECT sale_id, s.slot, s.level, n_sales, n_rows FROM s LEFT JOIN a ON s.slot = a.slot AND s.level = a.level
"""
