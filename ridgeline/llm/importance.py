"""Importance resampling towards a target: documents are drawn by how much their word runs look like a target's.

Every task keeps a trie of the runs of words that it has met. A node is reached by the words of its run and holds how often it
was met and the CRC state of the run's bytes, which its children carry on; so a word is hashed once for each node, not for each
occurrence. A task gives its counts summed by bucket (CRC modulo `buckets`), Spark adds the tasks' totals up, and the gains
that follow from them are one number for each bucket, whatever the input. Documents are then scored by walking tries whose
nodes have their bucket's gain attached. A trie that has grown to NODE_BYTES is emptied, its counts being passed on first.

The draw is exact: candidates are dealt by ranges of (score, id), which ties don't clump, and a candidate's rank is its
place in its range after the sizes of the ranges before. Ranges beyond the draw are never sorted.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.llm.shared import CHUNK, Workspace, chunks, column, text_buffers

#: Bytes that a trie may hold, about; what a node takes beside its word; rows of a range of candidates.
NODE_BYTES, NODE, RANGE = 1 << 26, 250, 1 << 16
#: A-Z as a-z; every ASCII byte that is no letter or digit as a space.
_FOLD = bytes(32 if b < 128 and not chr(b).isalnum() else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text in UTF-8 whose A-Z are lower-cased."""
    return raw.translate(_FOLD).split()


class Trie:
    """Runs of 1 to `longest` words. A node: [times met, CRC state, children, gain]."""

    def __init__(self, longest: int, buckets: int, gains: list[int] | None = None):
        self.longest, self.buckets, self.gains = longest, buckets, gains
        self.top: dict[bytes, list] = {}
        self.bytes = 0

    def walk(self, words: list[bytes]) -> int:
        """Meets every run of the words; the sum of the gains on the way."""
        total, longest, top = 0, self.longest, self.top
        for first in range(len(words)):
            children, state, glue = top, 0, b""
            for word in words[first : first + longest]:
                node = children.get(word)
                if node is None:
                    node = children[word] = self._node(zlib.crc32(glue + word, state))
                    self.bytes += NODE + len(word)
                node[0] += 1
                total += node[3]
                children, state, glue = node[2], node[1], b" "
        return total

    def _node(self, state: int) -> list:
        return [0, state, {}, self.gains[state % self.buckets] if self.gains else 0]

    def drain(self, totals: np.ndarray) -> None:
        """Adds the counts to their buckets' totals and empties the trie."""
        level = [self.top]
        while level:
            nodes = [node for children in level for node in children.values()]
            np.add.at(totals, np.array([node[1] for node in nodes], np.int64) % self.buckets, np.array([node[0] for node in nodes], np.int64))
            level = [node[2] for node in nodes if node[2]]
        self.top, self.bytes = {}, 0


def _texts(batches):
    """Runs of (row of the batch, UTF-8 bytes), and the batch."""
    for batch in batches:
        data, offsets = text_buffers(column(batch, "text"))
        for low, high in chunks(offsets, CHUNK):
            raw = data[offsets[low] : offsets[high]].tobytes()
            ends = (offsets[low : high + 1] - offsets[low]).tolist()
            yield batch, low, high, [raw[a:b] for a, b in zip(ends, ends[1:])]


def bucket_totals(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many runs of all texts fall into each bucket: one row a bucket and task is shuffled, one a bucket comes to the driver."""

    def run(batches):
        trie, totals = Trie(longest, buckets), np.zeros(buckets, np.int64)
        for _, _, _, rows in _texts(batches):
            for raw in rows:
                trie.walk(words_of(raw))
            if trie.bytes > NODE_BYTES:
                trie.drain(totals)
        trie.drain(totals)
        there = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(totals[there])], names=["bucket", "n"])

    summed = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 * ln of the target's smoothed share over the source's) for each bucket."""
    s_all, t_all = float(source.sum() + len(source)), float(target.sum() + len(target))
    return [math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())]


def weigh(texts: DataFrame, kind: str, gains: list[int], longest: int) -> DataFrame:
    """id, n_words, n_features, weight of the rows (id, text)."""
    buckets = len(gains)

    def run(batches):
        trie = Trie(longest, buckets, gains)
        for batch, low, high, rows in _texts(batches):
            held, weight = np.zeros(high - low, np.int64), np.zeros(high - low, np.int64)
            for k, raw in enumerate(rows):
                words = words_of(raw)
                held[k], weight[k] = len(words), trie.walk(words)
            if trie.bytes > NODE_BYTES:
                trie.top, trie.bytes = {}, 0
            features = sum(np.maximum(held - k, 0) for k in range(longest))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(held), pa.array(features), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    return texts.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: str) -> Column:
    """floor(-1000 * ln(-ln((h + 0.5) / 2**32))), h: the first 8 hex digits of sha256(`seed:doc_id`); a null id counts as the empty text."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("long") + 0.5) / 4294967296
    return F.floor(-1000 * F.ln(-F.ln(share))).cast("long")


def ranked(rows: DataFrame, score: str, tie: str, num: int, den: int, work: Workspace, most: int = RANGE) -> DataFrame:
    """The rows with `rank`: 1, 2, 3... for the floor(num * rows / den) of highest score (ties to the smaller `tie`), null for the others."""
    rows = work.put("candidates", rows)
    parts = max(1, -(-rows.count() // most))
    dealt = work.put("ranges", rows.repartitionByRange(parts, F.col(score).desc(), tie).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r["_part"], r["n"]) for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each range
    drawn, before, starts = sum(n for _, n in sizes) * num // den, 0, []
    for part, n in sizes:
        if before < drawn:
            starts.append((part, before))
        before += n
    columns = [c for c in dealt.columns if c != "_part"]
    first = dealt.sparkSession.createDataFrame(starts, "_part int, _before long")
    inside = dealt.join(F.broadcast(first), "_part")  # at most a row for each range
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(F.col(score).desc(), tie))
    inside = inside.withColumn("rank", place.cast("long")).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    last = starts[-1][0] if starts else -1
    rest = dealt.filter(F.col("_part") > last).withColumn("rank", F.lit(None).cast("long"))
    return inside.select(*columns, "rank").unionByName(rest.select(*columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = 1, buckets: int = 10_000, least: int = 20, num: int = 10, den: int = 100, seed: str = "2024", work: Workspace | None = None) -> DataFrame:
    """id_col, n_features, weight, score, rank, one row for each input row.

    Features: the runs of 1 to `longest` consecutive words of the whole text (A-Z lower-cased; null: none), joined by one space, repeats
    counted. A bucket's gain is floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) for its s of all S features of
    the documents and its t of all T of the target's texts. weight: the sum of the gains of a document's features (none: 0). score: weight and
    `gumbel` noise of the id. Of the N documents with at least `least` words the floor(num * N / den) with the highest score are drawn
    (ties to the smaller id, a null id first) and have ranks from 1; the rank of others is null. Repeated rows are ranked
    one after the other. Empty tables, texts without words and words of any length are allowed; other columns are never read.
    """
    work = work or Workspace(docs.sparkSession, "importance")
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    source = bucket_totals(texts.select("text"), longest, buckets)
    aims = bucket_totals(target.select(target[target_text].alias("text")), longest, buckets)
    kind = docs.schema[id_col].dataType.simpleString()
    scored = work.put("scored", weigh(texts, kind, gains_of(source, aims), longest).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)))
    able = F.col("n_words") >= least
    drawn = ranked(scored.filter(able).drop("n_words"), "score", "id", num, den, work)
    short = scored.filter(~able).drop("n_words").withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(short).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
