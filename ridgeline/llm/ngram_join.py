"""N-gram Jaccard join by a token-group matrix: groups of similar documents, their token unions, and bounds on overlap.

Documents with equal shingle sets are one class, told by a 64-bit key. The matrix has two kinds of tokens:

* A set of LEAST or more shingles gives bundles: the shingles are cut by hash range into parts, and a part's content is
  one token. If two sets link, they differ in at most k shingles, and each difference spoils one part; so of the first
  k + R parts that one of them fills, at least R are parts of the other with the same content. Sizes are cut into
  classes with one number of parts each, and a set that may link into the next class gives its bundles there as well.
* A smaller set gives its n shingles; a set that links has at least n - k of them.

A token that one document alone has can't be common. So a document with fewer than R tokens that others have, too, is
alone: this bounds its overlap with the union of everything, and drops documents that merely share a passage. Of the
others' shared tokens all but R - r of the most frequent are kept, the rarest first; two that link still have r in common.

Documents whose most frequent kept token is the same are one group, whether or not they link: a cluster of documents that
are alike but below the threshold is a few groups, not one for each document. Each group's token union is stored, and a
document opens the groups whose union holds at least r of its tokens and whose sizes fit; of two groups the one with the
rarer token asks, so the members of a large group, which most others meet, ask few. Inside an opened group whole sets are compared.

Before, a first round tries each document against two documents that are the least of a token of its. What links there
gets one label, and documents of one label needn't be compared any more: of a group's commonest label, no two members
meet. The first round only saves work; the second one tries every pair of different labels that the bounds admit.

Chance decides only collisions of 64-bit hashes, and whether a set of LEAST shingles fills fewer than k + R of its parts
(under one in 10**8 sets of the least size, and far less above).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.llm.bytewords import mix, span_hashes, words
from ridgeline.llm.components import connect
from ridgeline.llm.shared import CHUNK, Workspace, chunks, column, text_buffers

#: Least size of a set that gives bundles, ratio of the size classes, and parts for each difference allowed.
LEAST, RATIO, PARTS = 60, 1.5, 2.0
#: R as a hundredth of k, and its least value; r at most.
SHARE, AT_LEAST, COMMON = 35, 2, 4
#: Where a token is from: the class of the size, the next one, or a small set.
OWN, NEXT, SMALL = 0, 1, 2
#: Shingles of the members, and of the visitors, that meet in one task (8 bytes each); one larger set stands alone.
BLOCK = 1 << 18
#: Logarithm of the least and most bits of a bit map; 2**28 bits are 32 MB.
MAP_BITS = (16, 28)
_STEPS = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD)]


class Sets:
    """Shingle sets of texts, and the tokens of a set, for one width and threshold num / den."""

    def __init__(self, width: int, num: int, den: int):
        self.width, self.num, self.den = width, num, den

    def allowed(self, n: int) -> int:
        """How many shingles may differ between a set of n and one that it links with."""
        return n * (self.den - self.num) // self.num

    def small_below(self) -> int:
        return -(-LEAST * self.den // self.num) + 1

    def of_rows(self, data: np.ndarray, offsets: np.ndarray):
        """The sorted distinct shingle hashes of each row; a row of fewer words than the width has one, a row without words none."""
        starts, ends, rows = words(data, offsets)
        hashes = span_hashes(data, starts, ends, folded=True)
        begin = np.searchsorted(rows, np.arange(len(offsets) - 1))
        stop = np.append(begin[1:], len(rows))
        whole = len(hashes) - self.width + 1
        rolled = np.zeros(max(0, whole), np.uint64)
        for k in range(self.width):
            rolled = mix(rolled * _STEPS[k % 5] + hashes[k : k + whole]) if whole > 0 else rolled
        for low, high in zip(begin, stop):
            if high - low >= self.width:
                yield np.unique(rolled[low : high - self.width + 1])
            elif high > low:
                one = np.zeros(1, np.uint64)
                for k in range(low, high):
                    one = mix(one * _STEPS[1] + hashes[k : k + 1])
                yield mix(one ^ np.uint64(int(high - low)))
            else:
                yield np.empty(0, np.uint64)

    @staticmethod
    def key(shingles: np.ndarray) -> np.uint64:
        total = np.add.reduce(mix(shingles ^ _STEPS[3]))
        return mix(np.array([total], np.uint64) ^ (np.array([len(shingles)], np.uint64) * _STEPS[0]))[0]

    def asked(self, n: int) -> int:
        """R for a set of n."""
        return max(AT_LEAST, self.allowed(n) * SHARE // 100)

    def bundles(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of a set in the class of its size, and in the next where it may link into that."""
        none = np.empty(0, np.uint64)
        n, found = len(shingles), [none, none]
        if n < LEAST:
            return none, none
        need, own = self.allowed(n) + self.asked(n), int(math.log(n / LEAST) / math.log(RATIO))
        for size_class in (own, own + 1):
            low, high = LEAST * RATIO**size_class, LEAST * RATIO ** (size_class + 1)
            if size_class > own and n * self.den < self.num * (low - 1):
                break
            parts = math.ceil(PARTS * (high * (self.den - self.num) / self.num + 1))
            part = (shingles >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            upto = first[need] if len(first) > need else n
            content = np.add.reduceat(mix(shingles[:upto] ^ _STEPS[2]), first[:need])
            found[size_class - own] = mix(content ^ mix(part[first[:need]] + np.uint64(size_class << 32)))
        return found[0], found[1]

    def links(self, a: int, b: np.ndarray, common: np.ndarray) -> np.ndarray:
        return common * (self.den + self.num) >= self.num * (a + b)


    def meet(self, table: pa.Table) -> pa.Table:
        """u, v: labels of the members and visitors of one task that link; enough pairs to connect all that do."""
        role, key, label = (table.column(c).to_numpy() for c in ("role", "key", "label"))
        lists = table.column("shingles").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat, ends = lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
        members, visitors = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        size = np.diff(ends)
        u, v = [], []
        if len(members) and len(visitors):
            everything = np.concatenate([flat[ends[k] : ends[k + 1]] for k in members])
            owner = np.repeat(np.arange(len(members)), size[members])
            order = np.argsort(everything, kind="stable")
            everything, owner = everything[order], owner[order]
            # what the links so far connect has one root
            roots, root = np.unique(label, return_inverse=True)
            for k in visitors:
                if (root[members] == root[k]).all():
                    continue
                mine = flat[ends[k] : ends[k + 1]]
                low = np.searchsorted(everything, mine, side="left")
                count = np.searchsorted(everything, mine, side="right") - low
                hits = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
                common = np.bincount(owner[hits], minlength=len(members))
                for other in np.unique(root[members[self.links(int(size[k]), size[members], common)]]):
                    if other != root[k]:
                        u.append(roots[root[k]])
                        v.append(roots[other])
                        root[root == other] = root[k]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(np.uint64).view(np.int64)))


def _rows_of(texts: DataFrame, sets: Sets, each, schema: str) -> DataFrame:
    """What `each(ids, shingle sets, the task's memory)` makes of the rows (id, text), in bounded pieces."""

    def run(batches):
        memory: set = set()
        for batch in batches:
            data, offsets = text_buffers(column(batch, "text"))
            ids = batch.column(0)
            for low, high in chunks(offsets, CHUNK):
                part, ends = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                yield from each(ids.slice(low, high - low), list(sets.of_rows(part, ends)), memory)

    return texts.mapInArrow(run, schema)


def _signatures(texts: DataFrame, sets: Sets, kind: str) -> DataFrame:
    """id, n, key of every row, and the tokens of the first row of a class in each task: bundles, or shingles of small sets."""
    small = sets.small_below()
    none = np.empty(0, np.uint64)

    def each(ids, found, memory):
        keys = np.array([sets.key(s) if len(s) else 0 for s in found], np.uint64)
        tokens: tuple[list, list, list] = [], [], []
        for s, key in zip(found, keys.tolist()):
            new = len(s) > 0 and key not in memory
            memory.add(key)
            own, after = sets.bundles(s) if new else (none, none)
            for column_, value in zip(tokens, (own, after, s if new and len(s) < small else none)):
                column_.append(value)
        yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in found], pa.int64()), pa.array(keys.view(np.int64)), *map(_longs, tokens)], names=["id", "n", "key", "own", "after", "singles"])

    return _rows_of(texts, sets, each, f"id {kind}, n long, key long, own array<long>, after array<long>, singles array<long>")


def _tokens(classes: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """token, key, made (4 n + origin) of the classes' tokens; with a bit map only those whose bit is set."""

    def run(batches):
        for batch in batches:
            key, n = column(batch, "key").to_numpy(), column(batch, "n").to_numpy()
            for name, origin in (("own", OWN), ("after", NEXT), ("singles", SMALL)):
                lists = column(batch, name)
                token = lists.flatten().to_numpy().view(np.uint64) ^ np.uint64(origin == SMALL)
                of = np.repeat(np.arange(len(key)), np.diff(lists.offsets.to_numpy()))
                if bits is not None:
                    there = _there(bits, token)
                    token, of = token[there], of[there]
                for at in range(0, len(token), 1 << 17):
                    cut = slice(at, at + (1 << 17))
                    yield pa.RecordBatch.from_arrays([pa.array(token[cut].view(np.int64)), pa.array(key[of[cut]]), pa.array(4 * n[of[cut]] + origin)], names=["token", "key", "made"])

    return classes.select("key", "n", "own", "after", "singles").mapInArrow(run, "token long, key long, made long")


def _shared_tokens(classes: DataFrame, work: Workspace) -> DataFrame:
    """token, key, made, df: the tokens of more than one class, with the number of rows that gave them.

    Tokens are counted by map-side sums, so one that most rows hold is no burden. The few that are shared then pick their
    classes; a bit map of them keeps nearly all others from being sent.
    """
    counted = _tokens(classes).groupBy("token").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count(F.lit(1)).alias("df")).filter("a < b").select("token", "df")
    counted = work.put("counted", counted)
    return _tokens(classes, _bit_map(counted, "token")).join(counted, "token").dropDuplicates(["token", "key"])


def _chosen(shared: DataFrame, sets: Sets) -> DataFrame:
    """token, key, n, common (r): the shared tokens that are kept, the rarest first; none of documents that share too few."""
    num, gap = sets.num, sets.den - sets.num
    asked = f"greatest({AT_LEAST}, ((n * {num} div {sets.den}) * {gap} div {num}) * {SHARE} div 100)"
    rows = shared.withColumns({"n": F.expr("made div 4"), "origin": F.expr("made % 4")}).withColumn("low", F.expr(f"if(origin = {SMALL}, n - n * {gap} div {num}, {asked})"))
    per = Window.partitionBy("key", "origin")
    ranked = rows.withColumn("h", F.count(F.lit(1)).over(per)).filter("h >= low").withColumn("rank", F.row_number().over(per.orderBy("df", "token")))
    return ranked.withColumn("common", F.expr(f"least({COMMON}, low)")).filter("rank <= h - low + common").select("token", "key", "n", "common")


def _bit_map(table: DataFrame, name: str) -> np.ndarray:
    """A bit map of the hashes in a stored table, of 8 to 16 bits a row between the bounds of MAP_BITS; a set bit may be of another hash."""
    low, high = MAP_BITS
    size = min(max((8 * table.count()).bit_length(), low), high)
    bits = table.select(F.expr(f"{name} & {(1 << (size - 6)) - 1}L").alias("w"), F.expr(f"cast(shiftright({name}, {size - 6}) & 63 as int)").alias("b"))
    found = bits.groupBy("w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), np.uint64)
    out[found.column("w").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _there(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the hashes' bits are set."""
    wide = np.uint64(len(bits).bit_length() - 1)
    return (bits[hashes & np.uint64(len(bits) - 1)] >> ((hashes >> wide) & np.uint64(63)) & np.uint64(1)).astype(bool)


def _sets_of(texts: DataFrame, sets: Sets, bits: np.ndarray) -> DataFrame:
    """key, shingles of the classes whose bit is set; one row for each class."""

    def each(ids, found, memory):
        keys = np.array([sets.key(s) if len(s) else 0 for s in found], np.uint64)
        chosen = []
        for k in np.flatnonzero(_there(bits, keys)).tolist():
            if len(found[k]) and int(keys[k]) not in memory:
                memory.add(int(keys[k]))
                chosen.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(keys[chosen].view(np.int64)), _longs([found[k] for k in chosen])], names=["key", "shingles"])

    return _rows_of(texts, sets, each, "key long, shingles array<long>").dropDuplicates(["key"])


def _opened(asked: DataFrame, contents: DataFrame, sets: Sets) -> DataFrame:
    """u, v: labels of members and visitors that link; enough pairs to connect all that do.

    asked: g, kind (a group has up to two lists), key, n, label, role (0 member, 1 visitor), distinct. A list with more
    than BLOCK shingles of members or visitors is dealt to several tasks, each with a part of either.
    """
    size = asked.groupBy("g", "kind").agg(*[F.expr(f"cast(ceil(sum(if(role = {role}, n, 0)) / {BLOCK}) as int)").alias(name) for role, name in ((0, "ms"), (1, "vs"))]).filter("ms > 0 and vs > 0")
    own = asked.join(size, ["g", "kind"]).withColumn("slot", F.expr("cast(pmod(xxhash64(key), if(role = 0, ms, vs)) as int)"))
    placed = own.withColumn("other", F.explode(F.expr("sequence(0, if(role = 0, vs, ms) - 1)"))).select(
        "g", "kind", "key", "label", "role", F.expr("if(role = 0, slot, other)").alias("m"), F.expr("if(role = 0, other, slot)").alias("v")
    )
    filled = placed.join(contents, "key")

    return filled.groupBy("g", "kind", "m", "v").applyInArrow(lambda table: sets.meet(table), "u long, v long")


def _first_round(chosen: DataFrame, contents: DataFrame, sets: Sets, work: Workspace) -> DataFrame:
    """node, label of the classes that link with one of two others: the least of a token, and the one with most tokens in common.

    A lead of some tokens may not lead all that two documents share, so half of r will do to try.
    """
    leads = chosen.groupBy("token").agg(F.min("key").alias("g"))
    met = chosen.join(leads, "token").filter("key <> g").groupBy("g", "key").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("overlap"), F.min("common").alias("r")).filter("2 * overlap >= r")
    two = met.groupBy("key").agg(F.first("n").alias("n"), F.expr("array_distinct(array(min(g), max_by(g, struct(overlap, g))))").alias("gs"))
    pairs = work.put("first", two.select(F.explode("gs").alias("g"), "key", "n"))
    sizes = chosen.groupBy(F.col("key").alias("g")).agg(F.first("n").alias("n"))
    lead = pairs.select("g").distinct().join(sizes, "g").select("g", F.col("g").alias("key"), "n", F.lit(0).alias("role"))
    asked = pairs.withColumn("role", F.lit(1)).unionByName(lead).withColumn("kind", F.lit(0)).withColumn("label", F.col("key"))
    grown = connect(_opened(asked, contents, sets), work, "grown")
    work.drop("first")
    return grown


def _second_round(chosen: DataFrame, grown: DataFrame, contents: DataFrame, sets: Sets, work: Workspace) -> DataFrame:
    """u, v: labels that link, by groups, their token unions, and the groups that these bounds open."""
    num, den = sets.num, sets.den
    held = chosen.groupBy("token").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    counted = chosen.join(held, "token")
    group = counted.groupBy("key").agg(F.max(F.struct("held", "token")).alias("g")).select("key", F.col("g.token").alias("own"), F.col("g.held").alias("rank"))
    label = F.coalesce("label", "key").alias("label")
    grouped = group.join(grown, group["key"] == grown["node"], "left").select("key", "own", "rank", label)
    grouped = work.put("grouped", counted.join(grouped, "key").select("token", "key", "n", "common", "own", "rank", "label"))
    members = work.put("members", grouped.groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "own", "label")]))
    # the commonest label of each group, and whether it is the only one
    top = members.groupBy("own", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("own").agg(F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("labels"))
    top = work.put("top", top.select(F.col("own").alias("g"), F.col("top.label").alias("top"), "labels"))

    several = grouped.groupBy("token").agg(F.min("own").alias("a"), F.max("own").alias("b")).filter("a < b").select("token")
    live = grouped.join(several, "token")
    matrix = live.groupBy("token", F.col("own").alias("g")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("common").alias("theirs"), F.first("rank").alias("above"))
    # a group whose holders of a token all have the visitor's label may hold others as well: it counts unless it has one label
    matrix = matrix.join(top, "g").withColumn("only", F.expr("if(labels = 1, top, null)")).select("token", "g", "least", "most", "theirs", "above", "only", "top")
    fits = F.expr(f"(rank < above or rank = above and own < g) and n * {den} >= least * {num} and most * {den} >= n * {num} and (only is null or only <> label)")
    met = live.join(matrix, "token").filter(fits).groupBy("g", "key").agg(*[F.first(c).alias(c) for c in ("n", "label", "top")], F.count(F.lit(1)).alias("overlap"), F.min(F.least("common", "theirs")).alias("r"))
    visits = work.put("visits", met.filter("overlap >= r").select("g", "key", "n", "label", F.expr("if(label = top, 1, 0)").alias("kind")))

    inside = members.withColumnRenamed("own", "g").join(top, "g").select("g", "key", "n", "label", "top", "labels")
    bounds = visits.groupBy("g", "kind").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    # list 0: all members, for visitors of another label than the commonest (members themselves, too); list 1: members of other labels, for the rest
    called = inside.join(bounds, "g").filter(f"n * {den} >= least * {num} and most * {den} >= n * {num} and (kind = 0 or label <> top)").select("g", "kind", "key", "n", "label", F.lit(0).alias("role"))
    own = inside.filter("labels > 1")
    own = own.select("g", F.lit(0).alias("kind"), "key", "n", "label", F.lit(0).alias("role")).unionByName(own.filter("label <> top").select("g", F.lit(0).alias("kind"), "key", "n", "label", F.lit(1).alias("role")))
    asked = called.unionByName(visits.select("g", "kind", "key", "n", "label", F.lit(1).alias("role"))).unionByName(own).distinct()
    late = work.put("late", _opened(work.put("asked", asked), contents, sets))
    for name in ("grouped", "members", "top", "visits", "asked"):
        work.drop(name)
    return late


def labelled(rows: DataFrame, grown: DataFrame, merged: DataFrame, id_col: str) -> DataFrame:
    """id_col, n_shingles, component_id of the rows (id, n, key), from the labels of two rounds."""
    top = merged.select(F.col("node").alias("label"), F.col("label").alias("top"))
    alone = merged.join(grown, merged["node"] == grown["node"], "left_anti").select("node", F.col("label").alias("final"))
    final = grown.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("final")).unionByName(alone)
    # rows without words have no key; a hash of the id in its place keeps them from meeting in one task
    place = F.when(F.col("n") > 0, F.col("key")).otherwise(F.xxhash64("id"))
    keyed = rows.select("id", "n", place.alias("key"))
    labelled = keyed.join(final, keyed["key"] == final["node"], "left").select("id", "n", F.coalesce("final", "key").alias("c"))
    least = labelled.filter("n > 0").groupBy("c").agg(F.min("id").alias("component_id"))
    out = labelled.join(least, "c", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, work: Workspace | None = None) -> DataFrame:
    """id_col, n_shingles, component_id, one row for each input row.

    A document's set: the distinct shingles of `width` words (A-Z lower-cased); the whole sequence if it has fewer words;
    empty, and linked with nothing, if it has none or the text is null. Two documents link when den * intersection >=
    num * union. component_id is the smallest id reachable by links, the own id included. Whole texts count, no list of
    partners or candidates is cut, and copies are joined once for their class. Repeated rows are rows of one class.
    The result reads tables in `work`, which may be dropped once it is written.
    """
    work, sets = work or Workspace(docs.sparkSession, "ngrams"), Sets(width, num, den)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    rows = work.put("rows", _signatures(texts, sets, kind))
    chosen = work.put("chosen", _chosen(_shared_tokens(rows.filter("n > 0"), work), sets))
    work.drop("counted")
    asked = work.put("keys", chosen.select("key").distinct())
    contents = work.put("contents", _sets_of(texts, sets, _bit_map(asked, "key")))
    work.drop("keys")

    grown = _first_round(chosen, contents, sets, work)
    merged = connect(_second_round(chosen, grown, contents, sets, work), work, "merged")
    for name in ("chosen", "contents", "late"):  # nothing reads them again
        work.drop(name)

    return labelled(rows, grown, merged, id_col)
