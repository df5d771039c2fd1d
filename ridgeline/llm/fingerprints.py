"""Document fingerprints: a Merkle tree over content-defined leaves, paragraphs and sections, from SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.llm.quality_rules import _let

#: Paragraphs of a section; code points of a word that stays whole; marks of a fingerprint, about.
SECTION, WORD, MARKS = 8, 32, 512
#: A leaf's code is its hash with the length in the lowest 16 bits; a mark's, 24 bits of hash and 8 of length.
_LENGTH = "65535L"


def _stretches(units: str, roll: int, reach: int, tag: str) -> str:
    """SQL for an array of texts cut into arrays of neighbours, by what they hold and not by where they stand.

    A unit's hash is that of the last `roll` units. A stretch ends where the hash is not above those of `reach` units to
    both sides, so an edit moves only the ends near it. Equal units in a row are stretches of their own.
    """
    u, h, e, i = (f"{k}{tag}" for k in "uhei")
    rolled = f"transform({u}, (x, {i}) -> xxhash64(x{''.join(f', get({u}, {i} - {k})' for k in range(1, roll))}))"
    around = ", ".join(f"get({h}, {i} {sign} {k})" for k in range(1, reach + 1) for sign in "-+")
    ends = f"filter(sequence(0, size({u}) - 1), {i} -> {i} = size({u}) - 1 or get({h}, {i}) <= least({around}))"
    cut = f"transform({e}, (x, {i}) -> slice({u}, coalesce(get({e}, {i} - 1), -1) + 2, x - coalesce(get({e}, {i} - 1), -1)))"
    return _let(u, units, _let(h, rolled, _let(e, ends, cut)))


def _leaves(text: str) -> str:
    """SQL for the leaves' codes, by paragraph."""
    short = _stretches("split(y, '')", 4, 4, "c")
    units = f"flatten(transform(regexp_extract_all(p, '\\\\S+\\\\s*|\\\\s+', 0), y -> if(length(y) <= {WORD}, array(y), transform({short}, z -> array_join(z, '')))))"
    code = f"(xxhash64(l) & ~{_LENGTH}) | least({_LENGTH}, aggregate(l, 0L, (n, z) -> n + length(z)))"
    return f"transform(filter(split({text}, '(?<=\\\\n)'), p -> p != ''), p -> transform({_stretches(units, 1, 1, 'w')}, l -> {code}))"


def _marks(leaves: str) -> str:
    """SQL for all marks: a leaf's hash with the number of equal ones before it, so that repeats of a leaf are told apart."""
    starts = "filter(sequence(0, size(s) - 1), i -> i = 0 or get(s, i) != get(s, i - 1))"
    mark = f"(shiftrightunsigned(xxhash64(get(s, a), cast(j as bigint)), 40) * 256) | least(255L, get(s, a) & {_LENGTH})"
    each = _let("b", starts, f"flatten(transform(b, (a, k) -> transform(sequence(0, coalesce(get(b, k + 1), size(s)) - 1 - a), j -> {mark})))")
    return _let("s", f"sort_array({leaves})", f"if(size(s) = 0, cast(array() as array<bigint>), {each})")


def _at_level(marks: str, level: str) -> str:
    return f"filter({marks}, _m -> (shiftrightunsigned(_m, 8) & (shiftleft(1L, {level}) - 1)) = 0)"


def with_tree(df: DataFrame, text_col: str, tree_col: str) -> DataFrame:
    """The rows with the Merkle tree of a text: leaves, paragraphs (hashes of their leaves), sections (of SECTION paragraphs), root.

    A paragraph is a line with its line feed. Its units are words with the white space after them; of a longer one than
    WORD, stretches of code points. A leaf ends after a unit whose hash is not above its neighbours'. Null text has the
    tree of the empty text, which has no leaves. Equal texts have equal roots.

    The marks are what likeness is told by. Of n leaves at level k, those whose hash ends in k zero bits are marks, with
    the least k for which about MARKS remain; a text of up to MARKS leaves has level 0 and all.
    """
    nested = df.withColumn("_p", F.expr(_leaves(f"coalesce(`{text_col}`, '')")))
    hashed = nested.withColumn("_h", F.expr("transform(_p, x -> xxhash64(x))")).withColumn("_l", F.flatten("_p")).drop("_p")
    grouped = hashed.withColumn("_s", F.expr(f"if(size(_h) = 0, cast(array() as array<bigint>), transform(sequence(0, (size(_h) - 1) div {SECTION}), s -> xxhash64(slice(_h, cast(s as int) * {SECTION} + 1, {SECTION}))))"))
    levelled = grouped.withColumn("_k", F.expr(f"greatest(0, cast(ceil(log2(size(_l) / {MARKS}D)) as int))"))
    root = "sha2(concat_ws(',', transform(_s, x -> cast(x as string))), 256)"
    tree = f"struct({root} as root, _s as sections, _h as paragraphs, _l as leaves, _k as level, array_distinct({_at_level(_marks('_l'), '_k')}) as marks)"
    return levelled.withColumn(tree_col, F.expr(tree)).drop("_h", "_l", "_s", "_k")


def fingerprint(tree: str) -> Column:
    """The root, the level and the marks (24 bits of hash and 8 of length each, in hexadecimal)."""
    code = "lpad(lower(hex(x)), 8, '0')"
    return F.expr(f"concat({tree}.root, ':', {tree}.level, ':', array_join(transform({tree}.marks, x -> {code}), ''))")


def likeness(a: str, b: str) -> Column:
    """Code points of the marks that two texts share, by those of the larger; 1 for equal roots. The two fingerprints determine it.

    Marks of the finer level are thinned to the coarser one first. Where neither has one there, the likeness is 0.
    Leaves count wherever they stand: a branch that moved is still the same.
    """
    total = "aggregate({0}, 0L, (n, x) -> n + (x & 255L))"
    share = f"{total.format('array_intersect(_l, _r)')} / greatest({total.format('_l')}, {total.format('_r')}, 1L)"
    level = f"greatest({a}.level, {b}.level)"
    return F.expr(f"if({a}.root = {b}.root, 1.0D, {_let('_l', _at_level(f'{a}.marks', level), _let('_r', _at_level(f'{b}.marks', level), share))})")


def first_difference(a: str, b: str) -> Column:
    """section, paragraph (from 0) and code point at which two trees first differ, found from the top down; null if they don't."""
    at = "array_position(zip_with({0}, {1}, (x, y) -> not (x <=> y)), true)"
    section, paragraph, leaf = (at.format(f"{a}.{k}", f"{b}.{k}") for k in ("sections", "paragraphs", "leaves"))
    start = f"aggregate(slice({a}.leaves, 1, cast({leaf} - 1 as int)), 0L, (s, x) -> s + (x & {_LENGTH}))"
    return F.expr(f"if({a}.root = {b}.root, null, struct({section} - 1 as section, {paragraph} - 1 as paragraph, {start} as start))")


def _bucketed(docs: DataFrame, id_col: str, per_bucket: int, most: int = 4096) -> tuple[DataFrame, int]:
    """The docs with `bucket`: runs of neighbouring ids, about per_bucket each; and their number.

    Quantiles of the ids, one for each per_bucket rows but at most `most`, bound ranges of like counts. A range is cut into
    steps of equal width, so a far id stretches only the steps of its own range, and ids that crowd together in one step
    are at most those of a range.
    """
    n = docs.count()
    parts = max(1, min(most, -(-n // per_bucket)))
    asked = "array(" + ",".join(repr(k / parts) for k in range(parts + 1)) + ")"
    bounds = sorted(set(docs.agg(F.expr(f"percentile_approx(`{id_col}`, {asked}, 20000)").alias("q")).first()["q"] or [0]))
    widths = [max(1, -(-(high - low) * parts * per_bucket // max(1, n))) for low, high in zip(bounds, [*bounds[1:], bounds[-1] + 1])]
    array = lambda xs: "array(" + ",".join(f"{x}L" for x in xs) + ")"
    halves = ", ".join(str(1 << k) for k in reversed(range(len(bounds).bit_length())))
    near = f"greatest(1, aggregate(array({halves}), 0, (at, step) -> if(get({array(bounds)}, at + step - 1) <= coalesce(`{id_col}`, {bounds[0]}L), at + step, at)))"
    ranged = docs.withColumn("_r", F.expr(near))
    step = f"(greatest(coalesce(`{id_col}`, {bounds[0]}L), element_at({array(bounds)}, _r)) - element_at({array(bounds)}, _r)) div element_at({array(widths)}, _r)"
    return ranged.withColumn("bucket", F.expr(f"shiftleft(cast(_r as bigint), 40) + {step}")).drop("_r"), n


def _previous(firsts: DataFrame) -> DataFrame:
    """bucket -> the bucket before it (before the first: the last), by blocks of 4096 steps, then over the table of blocks."""
    blocks = firsts.groupBy(F.shiftright("bucket", 12).alias("block")).agg(F.max("bucket").alias("last"))
    one = Window.partitionBy(F.lit(0)).orderBy("block")
    everything = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.withColumn("before", F.coalesce(F.lag("last").over(one), F.last("last").over(everything)))
    own = Window.partitionBy("block").orderBy("bucket")
    inner = firsts.withColumn("block", F.shiftright("bucket", 12)).withColumn("prev", F.lag("bucket").over(own))
    return inner.join(blocks.select("block", "before"), "block").withColumn("prev", F.coalesce("prev", "before")).drop("block", "before")


def with_next(docs: DataFrame, id_col: str, text_col: str, per_bucket: int = 1024, small: int = 2_000_000) -> DataFrame:
    """id_col, text, tree, next_text, next_tree: each document with the one after it by id, and the last with the first.

    Documents move once, into buckets of neighbouring ids; the first of a bucket is also sent to the bucket before it.
    There is one such first for about per_bucket documents: up to `small` of them are broadcast, more are joined by a
    shuffle. Null ids come first; documents of equal ids are in the order of their texts' hashes.
    """
    picked, n = _bucketed(docs.select(F.col(id_col), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")), id_col, per_bucket)
    firsts = picked.groupBy("bucket").agg(F.min(F.struct(F.col(id_col).alias("id"), "h")).alias("first"))
    marks = _previous(firsts).select(F.col("first.id").alias("_id"), F.col("first.h").alias("_h"), "prev")
    if n <= small * per_bucket:
        marks = F.broadcast(marks)
    both = picked.alias("d").join(marks.alias("m"), F.expr(f"d.h = m._h and d.`{id_col}` <=> m._id"), "left")
    sent = both.select(id_col, "text", "h", F.explode(F.expr("if(prev is null, array(struct(bucket as bucket, 0 as guest)), array(struct(bucket as bucket, 0 as guest), struct(prev as bucket, 1 as guest)))")).alias("to"))
    dealt = with_tree(sent.select(id_col, "text", "h", "to.bucket", "to.guest").repartition("bucket"), "text", "tree")
    order = Window.partitionBy("bucket").orderBy("guest", F.col(id_col).asc_nulls_first(), "h")
    led = dealt.withColumn("next", F.lead(F.struct("text", "tree")).over(order)).filter("guest = 0")
    return led.select(id_col, "text", "tree", F.col("next.text").alias("next_text"), F.col("next.tree").alias("next_tree"))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document. Ids must be of an integral type. Null texts count as empty; an empty text's fingerprint has no leaves and
    is like that of an empty text alone. A table of one document is its own next; an empty table gives no rows.
    Columns: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and edit (the
    section, paragraph and code point where the trees first differ).
    """
    pairs = with_next(docs, id_col, text_col)
    own, after = "coalesce(text, '')", "coalesce(next_text, '')"
    cut = pairs.withColumn("n", F.expr(f"length({own})"))
    edited = cut.withColumn("edited", F.expr(f"concat(substring({own}, 1, n - n div 4), substring({after}, 1, n div 4))")).drop("text", "next_text")
    trees = with_tree(edited, "edited", "edited_tree")
    return trees.select(
        id_col,
        F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint("tree").alias("fingerprint"),
        fingerprint("edited_tree").alias("edited_fingerprint"),
        likeness("tree", "edited_tree").alias("near_edited"),
        likeness("tree", "next_tree").alias("near_next"),
        first_difference("tree", "edited_tree").alias("edit"),
    )
