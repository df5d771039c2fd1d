"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.llm.shared import Workspace

#: Fixed value: the fractional part of the golden ratio.
GOLDEN = (math.sqrt(5) - 1) / 2
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block; points of a cell, by which slots find their source; slots of a stretch that are ranked together.
BLOCK, CELL, STRETCH = 256, 64, 4096
#: Sources of a range: their sums run along ranges.
RANGE = 50_000
#: What is added to a running sum of targets before it is cut to an integer. It is near no simple fraction, so that sums
#: that differ in their last bits are cut alike.
ROUNDING = 0.5618


def running(df: DataFrame, order: list, sums: dict[str, Column], work: Workspace) -> DataFrame:
    """The rows with, for each name, the sum over all rows before in the given order, which tells all rows apart.

    Rows are dealt by ranges of the order; a range's sums go on from those of the ranges before, one row a range.
    """
    df = work.put(f"rows-{uuid.uuid4().hex}", df)
    parts = max(1, -(-df.count() // RANGE))
    dealt = work.put(f"ranges-{uuid.uuid4().hex}", df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before = lambda e, w: F.coalesce(F.sum(e).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = dealt.groupBy("_part").agg(*[F.sum(e).alias(name) for name, e in sums.items()])
    bases = bases.select("_part", *[before(name, Window.orderBy("_part")).alias(f"_{name}") for name in sums])
    inside = Window.partitionBy("_part").orderBy(*order)
    return dealt.join(F.broadcast(bases), "_part").select(*df.columns, *[(F.col(f"_{name}") + before(e, inside)).alias(name) for name, e in sums.items()])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, work: Workspace | None = None) -> DataFrame:
    """no, src, of (words), weight, target, low, high: what each source gives to the mix, in words.

    sizes: src (null last), words. The targets are the levels of water poured into vessels that are `weight` wide and
    hold `most` times their source: sources fill up in the order of capacity by weight, and the level of the rest
    follows from running sums. no is the source's place by name. low and high are the running sums of the targets by it, as
    integers, so high - low is the target to less than one. One row a source; no task holds more than a range of them.
    """
    work = work or Workspace(sizes.sparkSession, "targets")
    by_name = [F.col("src").asc_nulls_last()]
    named = running(sizes.select("src", F.col("words").alias("of")), by_name, {"no": F.lit(1)}, work)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    ranked = named.withColumn("weight", weight).withColumn("cap", most * F.col("of")).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    poured = work.put("poured", running(ranked, [F.col("ratio"), *by_name], {"caps": F.col("cap"), "weights": F.col("weight")}, work))
    every = poured.agg(F.coalesce(F.sum("of"), F.lit(0)).alias("of"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    level = (F.lit(share) * every["of"] - F.col("caps")) / (every["weight"] - F.col("weights"))
    final = poured.withColumn("level", level).filter("ratio >= level").agg(F.max(F.struct(-F.col("ratio"), F.col("level").alias("level"))).alias("f")).first()["f"]
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float("inf") if final is None else final["level"]))
    summed = running(poured.withColumn("target", target).select("no", "src", "of", "weight", "target"), [F.col("no")], {"upto": F.col("target")}, work)
    whole = lambda x: F.floor(x + ROUNDING)
    low = F.when(F.col("no") == 0, F.lit(0).cast("bigint")).otherwise(whole(F.col("upto")))
    return work.put("targets", summed.select("no", "src", "of", "weight", "target", low.alias("low"), whole(F.col("upto") + F.col("target")).alias("high")))


def even_shares(parts: DataFrame, targets: DataFrame, most: int = 2) -> DataFrame:
    """src, of, target, low, high: each source's target in even shares of its parts, none above `most` times its words, the excess reshared.

    parts: src (struct of source and part), words. Levels of water as in `source_targets`, in each source by itself; a source has few parts.
    """
    rows = parts.alias("p").join(targets.alias("t"), F.expr("p.src.source <=> t.src")).select("p.src", F.col("p.words").alias("of"), F.expr("t.high - t.low").alias("whole"))
    inside = Window.partitionBy("src.source")
    filled = inside.orderBy("of", "src.part")
    before = F.coalesce(F.sum("of").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"place": F.row_number().over(filled), "before": most * before, "n": F.count(F.lit(1)).over(inside), "cap": most * F.col("of")})
    rows = rows.withColumn("level", (F.col("whole") - F.col("before")) / (F.col("n") - F.col("place") + 1))
    final = F.min(F.when(F.col("cap") >= F.col("level"), F.struct("place", "level"))).over(inside)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(final, F.col("cap").cast("double")))
    return rows.select("src", "of", target.alias("target")).select("*", F.lit(0).cast("bigint").alias("low"), F.floor(F.col("target") + ROUNDING).alias("high"))


def step(points: int) -> int:
    """The step of the schedule: the integer next to the golden part of `points` that has no common divisor with it."""
    near = max(1, round(points * GOLDEN))
    return next(x for d in range(points + 1) for x in (near + d, near - d) if x > 0 and math.gcd(x, points) == 1)


def slots_of(targets: DataFrame, work: Workspace, block: int = BLOCK, most: int = 2) -> DataFrame:
    """no, of, words, blocks, slots, first: how many slots of the schedule a source has, and its first point.

    words: the whole words that it gives, which take its blocks once or more: all of them `words div of` times, and then the
    first ones, the last of which is cut to the words that are left. So slots make up the words exactly.
    """
    words = F.least(F.col("high") - F.col("low"), most * F.col("of"))
    turns = targets.filter("of > 0").select("no", "of", words.alias("words"), F.expr(f"cast(ceil(of / {block}) as bigint)").alias("blocks"))
    counted = turns.withColumn("slots", F.expr(f"words div of * blocks + cast(ceil(words % of / {block}) as bigint)"))
    return work.put("turns", running(counted, [F.col("no")], {"first": F.col("slots")}, work))


def schedule(turns: DataFrame, work: Workspace) -> DataFrame:
    """slot, no, rank: the source of each slot of the mix, and how many slots before it are the same source's.

    Slot i has the point i * step modulo the number of points, so every point comes once, and the points of any stretch of
    slots lie as evenly as multiples of the golden ratio do. A slot's source is the one whose points hold it, found by
    cells of CELL points, so a cell has few sources. Ranks are counted in stretches of slots, which go on from
    the stretches before: no source, however large, is ranked in one task.
    """
    points = turns.agg(F.coalesce(F.max(F.col("first") + F.col("slots")), F.lit(0))).first()[0]
    slots = turns.sparkSession.range(points).select(F.col("id").alias("slot"), F.expr(f"cast(cast(id as decimal(19,0)) * {step(max(points, 1))} % {max(points, 1)} as bigint)").alias("point"))
    parts = turns.filter("slots > 0").select("no", "first", (F.col("first") + F.col("slots")).alias("last"))
    parts = parts.withColumn("cell", F.explode(F.expr(f"sequence(first div {CELL}, (last - 1) div {CELL})")))
    drawn = slots.withColumn("cell", F.expr(f"point div {CELL}")).join(parts, "cell").filter("point >= first and point < last")
    drawn = work.put("drawn", drawn.select("slot", "no", F.expr(f"slot div {STRETCH}").alias("stretch")))
    held = drawn.groupBy("no", "stretch").agg(F.count(F.lit(1)).alias("n"))
    base = held.select("no", "stretch", F.coalesce(F.sum("n").over(Window.partitionBy("no").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("no", "stretch").orderBy("slot")) - 1
    return drawn.withColumn("own", own).join(base, ["no", "stretch"]).select("slot", "no", (F.col("base") + F.col("own")).alias("rank"))


def ordered(docs: DataFrame, work: Workspace, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float, most: int, part_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """id, src, m (md5 of the id), size, at: the words before a row in its source's shuffled order (m, size); and the sources' targets.

    The order is summed in 4096 buckets of the hash, and buckets by a small table of sums, so a source with a third of all
    rows is spread over many tasks. Texts are read once; ids and sizes are kept in the shared folder. With part_col, src is a struct of
    source and part, each in an order of its own, and a source's target is shared evenly among its parts.
    """
    own = docs[source_col] if part_col is None else F.struct(docs[source_col].alias("source"), docs[part_col].alias("part"))
    rows = docs.select(
        docs[id_col].alias("id"), own.alias("src"), F.md5(F.coalesce(docs[id_col].cast("string"), F.lit(""))).alias("m"),
        F.regexp_count(F.coalesce(docs[text_col], F.lit("")), F.lit(WORD)).cast("bigint").alias("size"),
    ).withColumn("bucket", F.substring("m", 1, 3))
    rows = work.put("sizes", rows)
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    words = sums.groupBy("src").agg(F.sum("words").alias("words"))
    if part_col is None:
        targets = source_targets(words, weights, share, most, work)
    else:
        parts = work.put("parts", words)
        whole = source_targets(parts.groupBy(F.col("src.source").alias("src")).agg(F.sum("words").alias("words")), weights, share, most, work)
        targets = work.put("shares", even_shares(parts, whole, most))
    starts = sums.withColumn("base", F.coalesce(F.sum("words").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    based = rows.alias("r").join(starts.alias("s"), F.expr("r.src <=> s.src and r.bucket = s.bucket")).select("r.*", "s.base")
    within = F.sum("size").over(Window.partitionBy("src", "bucket").orderBy("m", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return based.withColumn("at", F.col("base") + within - F.col("size")), targets


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, part_col: str | None = None) -> DataFrame:
    """id, src, m, size, of, target, taken: what `mix` takes, by where a row stands in its source's order alone: slots give each word `words div of` times, and the first `words % of` once more."""
    at, targets = ordered(docs, Workspace(docs.sparkSession, "mix"), id_col, text_col, source_col, weights, share, most, part_col)
    dealt = targets.withColumn("slots", F.least(F.col("high") - F.col("low"), most * F.col("of")))
    taken = F.expr("if(size = 0, 0L, size * (slots div of) + greatest(0L, least(at + size, slots % of) - at))")
    return at.alias("t").join(dealt.alias("g"), F.expr("t.src <=> g.src")).select("t.id", "t.src", "t.m", "t.size", "g.of", "g.target", taken.cast("bigint").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block: int = BLOCK) -> DataFrame:
    """id_col, size, source_size, target, taken: the words that a mix of sources takes from each document.

    Each source's documents stand in an order shuffled by md5 of their ids, cut into blocks of `block` words. The slots of the
    `schedule` are ranked in each source, and rank r takes block r modulo the source's blocks, up to `most` times; the last
    slot takes the words that its source's target leaves. A document's taken words are those of it in blocks that slots
    take. So every source meets its target to less than a word, at any size and beside any other.

    A null text has size 0 and gives nothing; a null source is one of its own, and last. Repeated rows are placed each.
    An empty table gives no rows. A row meets one slot for each block that it lies in and each time that is taken, so
    joins grow with the words, not with a source.
    """
    work = Workspace(docs.sparkSession, "mix")
    at, targets = ordered(docs, work, id_col, text_col, source_col, weights, share, most)
    turns = slots_of(targets, work, block, most)
    slots = schedule(turns, work).join(turns, "no")
    left = f"words - words div of * of - rank % blocks * {block}"
    slots = slots.select("no", F.expr("rank % blocks").alias("block"), F.expr(f"if(rank div blocks < words div of, {block}L, least({block}L, {left}))").alias("take"))
    rows = work.put("placed", at.alias("t").join(targets.alias("g"), F.expr("t.src <=> g.src")).select("t.id", "t.m", "t.size", "t.at", "g.no", "g.of", "g.target"))
    pieces = rows.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")))
    met = pieces.join(slots, ["no", "block"], "left")
    words = F.expr(f"greatest(0L, least(at + size, block * {block} + coalesce(take, 0L)) - greatest(at, block * {block}))")
    keys = ("id", "m", "size", "at", "no", "of", "target")
    taken = met.groupBy(*keys).agg(F.sum(words).cast("bigint").alias("taken"))
    out = taken.unionByName(rows.filter("size = 0").withColumn("taken", F.lit(0).cast("bigint")).select(*keys, "taken"))
    return out.select(F.col("id").alias(id_col), "size", F.col("of").alias("source_size"), "target", "taken")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", small: int = 500_000, part_col: str | None = None) -> DataFrame:
    """The docs, each as often as the mix takes it: its taken words by its size, rounded, so 0, 1 or 2 times.

    In a source, the documents up to a place in its order are taken once more than the rest. So a row a source tells how
    often each of its documents is taken: texts are read again and stay where they are, as the sources are broadcast if
    they are up to `small` (else they are joined by a shuffle). Rows of equal id and size are taken alike. Clashing
    columns of the docs are kept. part_col: a column (such as the language) whose values share a source's target evenly, as far as
    two copies of each document allow.
    """
    work = Workspace(docs.sparkSession, "copies")
    often = placed(docs, id_col, text_col, source_col, part_col=part_col).filter("size > 0").select("src", "m", "size", F.expr("cast(round(taken / size) as int)").alias("n"))
    most = often.groupBy("src").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.struct("n", "m", "size")).alias("edge"))
    cuts = work.put("cuts", most.select("src", "low", "high", F.struct("edge.m", "edge.size").alias("edge")))
    cuts = F.broadcast(cuts) if cuts.count() <= small else cuts
    own = F.struct(F.md5(F.coalesce(F.col(f"d.{id_col}").cast("string"), F.lit(""))).alias("m"), F.regexp_count(F.coalesce(F.col(f"d.{text_col}"), F.lit("")), F.lit(WORD)).cast("bigint").alias("size"))
    times = F.when(own["size"] == 0, 0).when(own <= F.col("x.edge"), F.col("x.high")).otherwise(F.col("x.low"))
    match = f"d.`{source_col}` <=> x.src" if part_col is None else f"d.`{source_col}` <=> x.src.source and d.`{part_col}` <=> x.src.part"
    taken = docs.alias("d").join(cuts.alias("x"), F.expr(match)).select("d.*", times.alias("_times")).filter("_times > 0")
    return taken.withColumn("_n", F.explode(F.expr("sequence(1, _times)"))).select(*docs.columns)


ORACLE = r"""
WITH r AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS m,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
t AS (SELECT CAST(sum(size) AS BIGINT) AS total FROM r),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS words FROM r GROUP BY source),
s1 AS (SELECT source, words, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
s2 AS (SELECT *, 2 * words AS cap, CAST(2 * words AS DOUBLE) / weight AS ratio FROM s1),
s3 AS (SELECT *, (CAST(1.5 AS DOUBLE) * (SELECT total FROM t) - coalesce(CAST(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
  / CAST(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM s2),
s4 AS (SELECT *, least(CAST(cap AS DOUBLE), weight * (SELECT arg_min(level, ratio) FROM s3 WHERE ratio >= level)) AS target FROM s3),
s5 AS (SELECT *, CAST(floor(sum(target) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) + CAST('0.5618' AS DOUBLE)) AS BIGINT) AS high FROM s4),
g AS (SELECT *, least(high - coalesce(lag(high) OVER (ORDER BY source NULLS LAST), 0), 2 * words) AS slots FROM s5),
o AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY m, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS at FROM r)
SELECT o.doc_id, o.size, g.words AS source_size, g.target,
  CASE WHEN o.size = 0 THEN 0 ELSE o.size * (g.slots // g.words) + greatest(0, least(o.at + o.size, g.slots % g.words) - o.at) END AS taken
FROM o JOIN g ON o.source IS NOT DISTINCT FROM g.source
"""
