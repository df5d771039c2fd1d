"""Near-duplicates by HyperMinHash sketches, with links confirmed on full sets.

A set's sketch: under each of TABLES hash functions its shingles are dealt to 2**BITS buckets by their first bits, and a bucket
keeps its least value as the number of leading zeros (6 bits) and the MANTISSA bits behind the first one. An empty bucket
takes the value of the nearest bucket that isn't: all of that is the least of `value xor (bucket << 59)`, an order in which
each member of a union of sets is first with the same chance. So each register of two sets is equal with the chance of
their Jaccard similarity J, for sets of any size, besides the rare registers of different shingles that look alike.

Four registers of four functions are a band of 64 bits, the compressed registers themselves. Of the 64 bands two sets
of J = 0.8 share 26 on average, and fewer than ASKED with a chance under 1 in 10**6 (simulated for sets of 5 to
100 shingles, where it is highest). Bands of one document alone are dropped; documents that share some meet as in
`ngram_join`: a first round by leaders, a second by groups. Inside an opened group sketches are compared first: the
share of equal registers, corrected for chance collisions, estimates J, and only pairs whose estimate isn't far below the
threshold are compared by their full sets. No list of partners or candidates is cut.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.llm import ngram_join
from ridgeline.llm.bytewords import mix
from ridgeline.llm.components import connect
from ridgeline.llm.shared import Workspace, column

#: Hash functions, bits of a bucket's number, bits behind the leading one.
TABLES, BITS, MANTISSA = 8, 5, 10
BUCKETS = 1 << BITS
#: Registers of a sketch, and of a band (one of each function of a half).
REGISTERS, ROWS = TABLES * BUCKETS, 4
#: Bands that linked sets share at least, and how many of them are still common when the commonest are left out.
ASKED, COMMON = 4, 2
#: Standard deviations (of a register's share in the estimate) that a pair may lie below the threshold and still be compared.
DOUBT = 6.0
_MASKS = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BITS)
_SALTS = mix(np.arange(1, TABLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
#: The registers of each band: of either half of the functions, in four different orders of the buckets.
BANDS = np.array([[(half * ROWS + k) * BUCKETS + (q * (1, 5, 11, 13)[k] + 7 * k) % BUCKETS for k in range(ROWS)] for half in range(TABLES // ROWS) for q in range(BUCKETS)])


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a set of 64-bit hashes (not empty): REGISTERS numbers of 16 bits."""
    values = mix(shingles[None, :] ^ _SALTS)
    if len(shingles) <= 8 * BUCKETS:
        least = (values[:, None, :] ^ _MASKS[None, :, None]).min(2)
    else:
        values.sort(axis=1)
        least = np.empty((TABLES, BUCKETS), np.uint64)
        for own, out in zip(values, least):
            first = np.searchsorted(own, _MASKS)
            out[:] = own[np.minimum(first, len(own) - 1)] ^ _MASKS
            for q in np.flatnonzero(out >> np.uint64(64 - BITS)):  # an empty bucket
                out[q] = (own ^ _MASKS[q]).min()
    return compressed(least.ravel())


def compressed(least: np.ndarray) -> np.ndarray:
    """Leading zeros (at most 53) and the MANTISSA bits behind the leading one, as 16 bits."""
    exact = least >> np.uint64(11)  # so that floats hold it exactly
    length = np.frexp(exact.astype(np.float64))[1].astype(np.int64)
    below = np.maximum(length - 1, 0)
    mantissa = np.where(below >= MANTISSA, exact >> np.maximum(below - MANTISSA, 0).astype(np.uint64), exact << np.maximum(MANTISSA - below, 0).astype(np.uint64))
    return ((53 - length).astype(np.uint64) << np.uint64(MANTISSA) | mantissa & np.uint64((1 << MANTISSA) - 1)).astype(np.uint16)


def band_tokens(sketches: np.ndarray) -> np.ndarray:
    """The tokens of the bands of some sketches: a 64-bit number for each band, told apart by band."""
    content = np.zeros((len(sketches), len(BANDS)), np.uint64)
    for k in range(ROWS):
        content = content << np.uint64(16) | sketches[:, BANDS[:, k]].astype(np.uint64)
    return mix(mix(content) ^ np.arange(1, len(BANDS) + 1, dtype=np.uint64))


def collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The chance that a register of two disjoint sets of these sizes is equal: cells are 1 / (2 ln 2 * 2**MANTISSA) of a value wide, on average."""
    return a * b / (a + b) ** 2 / (2 * math.log(2) * (1 << MANTISSA))


def estimate(equal: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, without those equal by chance."""
    chance = collisions(a, b)
    return (equal - chance) / (1 - chance)


class Sketched(ngram_join.Sets):
    """Shingle sets whose pairs are compared by sketch before they are compared in full."""

    def lowest(self, n: np.ndarray) -> np.ndarray:
        """Estimates from here on are checked in full, for a pair whose smaller set has n shingles: small sets have few independent registers."""
        p = self.num / self.den
        return p - DOUBT * np.sqrt(p * (1 - p) * (1 / REGISTERS + 1 / (16 * np.maximum(n, 1))))

    def meet(self, table: pa.Table) -> pa.Table:
        role, key, label = (table.column(c).to_numpy() for c in ("role", "key", "label"))
        members, visitors = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        u, v = [], []
        if len(members) and len(visitors):
            lists = table.column("shingles").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            flat, ends = lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
            size = np.diff(ends)
            sketch = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(len(key), REGISTERS)
            roots, root = np.unique(label, return_inverse=True)
            for k in visitors:
                others = members[root[members] != root[k]]
                equal = (sketch[others] == sketch[k]).mean(1)
                likely = others[estimate(equal, size[others], size[k]) >= self.lowest(np.minimum(size[others], size[k]))]
                mine = flat[ends[k] : ends[k + 1]]
                for m in likely:
                    if root[m] == root[k]:
                        continue
                    theirs = flat[ends[m] : ends[m + 1]]
                    at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
                    if self.links(int(size[k]), int(size[m]), int((theirs[at] == mine).sum())):
                        u.append(roots[root[k]])
                        v.append(roots[root[m]])
                        root[root == root[m]] = root[k]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _sketches(texts: DataFrame, sets: Sketched, kind: str) -> DataFrame:
    """id, n, key of every row, and the registers of the first row of a class in each task."""

    def each(ids, found, memory):
        keys = np.array([sets.key(s) if len(s) else 0 for s in found], np.uint64)
        made: list = []
        for s, key in zip(found, keys.tolist()):
            made.append(registers(s).tobytes() if len(s) and key not in memory else None)
            memory.add(key)
        yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in found], pa.int64()), pa.array(keys.view(np.int64)), pa.array(made, pa.binary())], names=["id", "n", "key", "registers"])

    return ngram_join._rows_of(texts, sets, each, f"id {kind}, n long, key long, registers binary")


def _bands(classes: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """token, key, n of the classes' bands; with a bit map only those whose bit is set."""

    def run(batches):
        for batch in batches:
            held, key, n = column(batch, "registers"), column(batch, "key").to_numpy(), column(batch, "n").to_numpy()
            for low in range(0, len(key), 2048):
                part = slice(low, low + 2048)
                sketches = np.frombuffer(b"".join(held[part].to_pylist()), np.uint16).reshape(-1, REGISTERS)
                token = band_tokens(sketches).ravel()
                of = low + np.repeat(np.arange(len(sketches)), len(BANDS))
                if bits is not None:
                    there = ngram_join._there(bits, token)
                    token, of = token[there], of[there]
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(key[of]), pa.array(n[of])], names=["token", "key", "n"])

    return classes.select("key", "n", "registers").mapInArrow(run, "token long, key long, n long")


def _chosen(classes: DataFrame, work: Workspace) -> DataFrame:
    """token, key, n, common: the bands that classes share, without the commonest, of classes that share enough.

    Bands are counted by map-side sums; a bit map of those that several classes have keeps the others from being sent again.
    """
    counted = _bands(classes).groupBy("token").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count(F.lit(1)).alias("df")).filter("a < b").select("token", "df")
    counted = work.put("counted", counted)
    shared = _bands(classes, ngram_join._bit_map(counted, "token")).join(counted, "token").dropDuplicates(["token", "key"])
    per = Window.partitionBy("key")
    held = shared.withColumn("h", F.count(F.lit(1)).over(per)).filter(F.col("h") >= ASKED)
    kept = held.withColumn("rank", F.row_number().over(per.orderBy("df", "token"))).filter(F.col("rank") <= F.col("h") - ASKED + COMMON)
    return kept.select("token", "key", "n", F.lit(COMMON).alias("common"))


def _contents(texts: DataFrame, sets: Sketched, bits: np.ndarray) -> DataFrame:
    """key, shingles, registers of the classes whose bit is set; one row for each class."""

    def each(ids, found, memory):
        keys = np.array([sets.key(s) if len(s) else 0 for s in found], np.uint64)
        chosen = []
        for k in np.flatnonzero(ngram_join._there(bits, keys)).tolist():
            if len(found[k]) and int(keys[k]) not in memory:
                memory.add(int(keys[k]))
                chosen.append(k)
        made = pa.array([registers(found[k]).tobytes() for k in chosen], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(keys[chosen].view(np.int64)), ngram_join._longs([found[k] for k in chosen]), made], names=["key", "shingles", "registers"])

    return ngram_join._rows_of(texts, sets, each, "key long, shingles array<long>, registers binary").dropDuplicates(["key"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, work: Workspace | None = None) -> DataFrame:
    """id_col, n_shingles, component_id, kept, one row for each input row.

    A document's set: the distinct shingles of `width` words (A-Z lower-cased); the whole sequence if it has fewer words;
    empty, and linked with nothing, if it has none or the text is null. Two documents link when den * intersection >=
    num * union, which full sets decide. component_id is the smallest id reachable by links, the own id included; kept says
    whether it is the own. Whole texts count, however long; copies are one class, and repeated rows are rows of it. An empty
    table gives none; other columns are never read. The result reads tables in `work`.
    """
    work, sets = work or Workspace(docs.sparkSession, "hyperminhash"), Sketched(width, num, den)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    rows = work.put("rows", _sketches(texts, sets, kind))
    chosen = work.put("chosen", _chosen(rows.filter("registers is not null"), work))
    work.drop("counted")
    asked = work.put("keys", chosen.select("key").distinct())
    contents = work.put("contents", _contents(texts, sets, ngram_join._bit_map(asked, "key")))
    work.drop("keys")
    grown = ngram_join._first_round(chosen, contents, sets, work)
    merged = connect(ngram_join._second_round(chosen, grown, contents, sets, work), work, "merged")
    for name in ("chosen", "contents", "late"):  # nothing reads them again
        work.drop(name)
    found = ngram_join.labelled(rows, grown, merged, id_col)
    return found.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
