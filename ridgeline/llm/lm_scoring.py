"""LM scoring by prediction by partial matching over bytes, pretrained on a corpus of any size.

The trie of byte contexts is never in one place. Its leaves are the distinct (context, next byte) stretches of the
training rows; they are counted by map-side sums and dealt by the last two bytes of the context. All suffixes of a
context that are at least two bytes long end alike, so one task holds the whole branch of the trie above its contexts;
the orders 0 and 1 (at most 257 * 257 counts) are the same for all and go to every task.

Texts are scored in blocks: a block asks once for each distinct stretch that it holds, and sums the log probabilities
that come back over its texts. Those of the stretches that most blocks ask for, a bounded number, go to every task, so
only the rarer ones are sent to the blocks that asked.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ridgeline.llm.bytewords import mix, span_hashes, words
from ridgeline.llm.shared import CHUNK, Workspace, chunks, column, text_buffers

#: What a symbol seen gives up to the escape, of its count.
DISCOUNT = 0.3
#: Bytes of text whose keys are held at once, by a task that asks and by one that scores; their arrays take some hundred times that.
PIECE = CHUNK // 4
#: Most stretches whose values go to every task (17 bytes each).
COMMON = 1 << 19
#: The bit of a key that marks a token, not a stretch; stretches have 8 * (order + 1) bits.
TOKEN_BIT = np.uint64(1 << 63)
#: The byte that ends a text, and stands before it; it occurs in no UTF-8 text.
END = 255
SYMBOLS = 257
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def token_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' token sequences as bytes: words with A-Z lower-cased, each followed by one space, then the end byte."""
    starts, ends, rows = words(data, offsets)
    lengths = ends - starts
    n = len(offsets) - 1
    per_row = np.bincount(rows, weights=lengths + 1, minlength=n).astype(np.int64) + 1
    stops = np.concatenate([[0], np.cumsum(per_row)])
    out = np.full(stops[-1], 32, np.uint8)
    out[stops[1:] - 1] = END
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    keep = np.cumsum(inside[:-1]) > 0
    begin = np.cumsum(lengths + 1) - (lengths + 1) + rows
    out[np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())] = _FOLD[data[keep]]
    return out, stops


def grams(stream: np.ndarray, stops: np.ndarray, order: int) -> np.ndarray:
    """For each byte, the `order` bytes before it (end bytes before the row's start) and itself, packed in 64 bits."""
    out = np.zeros(len(stream), np.uint64)
    place = np.arange(len(stream)) - np.repeat(stops[:-1], np.diff(stops))
    for back in range(order, -1, -1):
        out <<= np.uint64(8)
        part = np.full(len(stream), END, np.uint8)
        part[back:] = stream[: len(stream) - back]
        part[place < back] = END
        out |= part
    return out


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class _Level:
    """One order of a trie branch: contexts with their symbols, counts and sums."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = _sums(keys, counts)
        context = self.keys >> np.uint64(8)
        self.first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.empty(0, np.int64)
        self.contexts = context[self.first]
        self.total = np.add.reduceat(self.counts, self.first) if len(self.first) else self.counts
        self.kinds = np.diff(np.append(self.first, len(context)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Counts of (context, symbol) keys; 0 where there are none."""
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0)

    def node(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Total count and number of symbols of each context; 0, 0 for one never seen."""
        if not len(self.contexts):
            return np.zeros(len(contexts)), np.zeros(len(contexts))
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        seen = self.contexts[at] == contexts
        return np.where(seen, self.total[at], 0), np.where(seen, self.kinds[at], 0)


def _masked(keys: np.ndarray, symbols: int) -> np.ndarray:
    """The last `symbols` bytes of packed stretches."""
    return keys & np.uint64((1 << 8 * symbols) - 1)


class Branch:
    """Counts of all orders for the contexts of one branch, and probabilities by partial matching with exclusion.

    A context with total N of d symbols gives a symbol seen c times (c - x) / N, where x is the discount, and escapes with
    x * d / N to the context without its first byte. There, the symbols that the longer context holds are excluded from the counts. Below order
    0, every symbol not seen at all is equally likely. A context that training never saw passes on at no cost.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low_keys: list[np.ndarray], low_counts: list[np.ndarray], order: int, discount: float = DISCOUNT):
        self.order, self.discount = order, discount
        self.levels = [_Level(k, c) for k, c in zip(low_keys, low_counts)]
        self.levels += [_Level(_masked(keys, k + 1), counts) for k in range(len(self.levels), order + 1)]
        self.shared = [None] * (order + 1)
        for k in range(order):
            # what each context of order k + 1 excludes at order k: its symbols' counts there
            upper, lower = self.levels[k + 1], self.levels[k]
            taken = lower.find(_masked(upper.keys, k + 1))
            self.shared[k] = np.add.reduceat(taken, upper.first) if len(upper.first) else taken

    def log10(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        open_ = np.ones(len(keys), bool)
        excluded = np.zeros(len(keys))  # counts at this order of the symbols that the longer context holds
        dropped = np.zeros(len(keys))  # how many those are
        for k in range(self.order, -1, -1):
            level, own = self.levels[k], _masked(keys, k + 1)
            total, kinds = level.node(own >> np.uint64(8))
            count = level.find(own)
            left, fresh = total - excluded, kinds - dropped
            use = open_ & (fresh > 0)
            hit = use & (count > 0)
            out[hit] += np.log10((count[hit] - self.discount) / left[hit])
            miss = use & (count == 0)
            out[miss] += np.log10(self.discount * fresh[miss] / left[miss])
            open_ &= ~hit
            if k:
                upper = level
                at = np.minimum(np.searchsorted(upper.contexts, own >> np.uint64(8)), max(0, len(upper.contexts) - 1))
                seen = kinds > 0
                excluded = np.where(seen, self.shared[k - 1][at] if len(upper.contexts) else 0, 0)
                dropped = np.where(seen, kinds, 0)
        zero = self.levels[0].kinds.sum() if len(self.levels[0].kinds) else 0
        out[open_] -= math.log10(max(1, SYMBOLS - zero))
        return out


class Lookup:
    """Values of 64-bit keys, found by a table over the leading bits of their mixed hashes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = mix(keys)
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]
        wide = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - wide)
        self.first = np.searchsorted(self.hashes >> self.shift, np.arange(1 << wide, dtype=np.uint64)).astype(np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys that are all there."""
        hashes = mix(keys)
        at = self.first[hashes >> self.shift]
        wrong = np.flatnonzero(self.hashes[at] != hashes)
        while len(wrong):
            at[wrong] += 1
            wrong = wrong[self.hashes[at[wrong]] != hashes[wrong]]
        return self.values[at]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _keys(part: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretch keys of all positions and where each row's begin, and token keys with their rows."""
    stream, stops = token_bytes(part, ends)
    starts, stop, owner = words(part, ends)
    n = len(ends) - 1
    tokens = np.concatenate([span_hashes(part, starts, stop, folded=True), np.full(n, END_HASH, np.uint64)]) | TOKEN_BIT
    return grams(stream, stops, order), stops, tokens, np.concatenate([owner, np.arange(n)])


def _asked(rows: DataFrame, order: int, block_bytes: int) -> DataFrame:
    """Of each block of rows: its texts, packed (blob), and its distinct keys with their counts in training rows (key, n).

    A block is what a task reads one after another, up to `block_bytes` of text; it is named by the task's partition.
    """

    def texts(batch, low, high, block):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch.slice(low, high - low))
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "key", "n", "blob"])

    def merged(parts):
        keys, n = _sums(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        return [(keys, n)]

    def asks(parts, block):
        for keys, n in merged(parts) if parts else []:
            for at in range(0, len(keys), 1 << 17):
                m = len(keys[at : at + (1 << 17)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), pa.array(keys[at : at + m].view(np.int64)), pa.array(n[at : at + m]), pa.nulls(m, pa.binary())], names=["block", "key", "n", "blob"])

    def run(batches):
        block, size, parts = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            data, offsets = text_buffers(column(batch, "text"))
            learn = column(batch, "train").to_numpy(zero_copy_only=False)
            for low, high in chunks(offsets, PIECE):
                if size and size + offsets[high] - offsets[low] > block_bytes:
                    yield from asks(parts, block)
                    block, size, parts = block + 1, 0, []
                size += int(offsets[high] - offsets[low])
                yield texts(batch, low, high, block)
                part, ends = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                stretches, stops, tokens, owner = _keys(part, ends, order)
                own = learn[low:high]
                for keys, used in ((stretches, np.repeat(own, np.diff(stops))), (tokens, own[owner])):
                    parts.append(_distinct(keys[used]))
                    other = _distinct(keys[~used])[0]
                    parts.append((other, np.zeros(len(other), np.int64)))
                if len(parts) >= 128:
                    parts = merged(parts)
        yield from asks(parts, block)
        parts = []
        pa.default_memory_pool().release_unused()  # workers stay from stage to stage

    return rows.mapInArrow(run, "block long, key long, n long, blob binary")


def _most_asked(values: DataFrame, most: int) -> DataFrame:
    """Of the keys that several blocks ask for, those that most do: at most `most`, all that are asked for about as often or none."""
    grade = F.expr("cast(floor(8 * log2(c)) as int)")
    counted = values.filter("c > 1").groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("m")).collect()
    left, least = most, 1 << 30
    for grade_, m in sorted(((r["grade"], r["m"]) for r in counted), reverse=True):
        if m > left:
            break
        left, least = left - m, grade_
    return values.filter((F.col("c") > 1) & (grade >= least))


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 5, block_bytes: int = 16 << 20, discount: float = DISCOUNT, shards: int | None = None) -> DataFrame:
    """Per row: id_col, train, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words with A-Z lower-cased and one end. base_score is the unigram score with additive smoothing 0.1;
    score is the log10 probability that partial matching of order `order` (up to 6), pretrained on the rows where `train`
    holds, gives to the same token sequence: its words, each with one space after it, and the end. Null texts are empty:
    one end token. Without training rows every byte is one of 257 equally likely ones. Repeated rows are learned and
    scored each.

    Texts are read once, and kept packed by blocks in the shared folder. What is shuffled is one row for each distinct
    stretch (or token) of a block, its answer unless the stretch is among the COMMON ones, and the packed texts. No
    task holds more than a block with its answers and the common ones, or a branch of the trie; a branch has the distinct
    stretches whose context ends in the same two bytes, however many texts there are.
    """
    if not 2 <= order <= 6:
        raise ValueError(f"order {order} is not in 2..6")
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    work = Workspace(spark, "lm")
    read = work.put("asked", _asked(rows, order, block_bytes))
    asked, packed = read.filter("blob is null").select("block", "key", "n"), read.filter("blob is not null").select(F.col("block").alias("of"), "blob")
    counts = work.put("counts", asked.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")))
    low = counts.filter("key >= 0 and n > 0").groupBy(F.expr("key & 65535").alias("key")).agg(F.sum("n").alias("n")).toArrow()
    low_key, low_n = low.column("key").to_numpy().view(np.uint64), low.column("n").to_numpy().astype(np.float64)
    totals = counts.filter("key < 0 and n > 0").agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    vocabulary, tokens = int(totals["v"]), int(totals["n"])
    unknown = math.log10(0.1 / (tokens + 0.1 * (vocabulary + 1)))
    shards = shards or max(64, spark.sparkContext.defaultParallelism * 4)

    def answer(table: pa.Table) -> pa.Table:
        key, n = table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy().astype(np.float64)
        value = np.log10((n + 0.1) / (tokens + 0.1 * (vocabulary + 1)))
        one = np.flatnonzero(key < TOKEN_BIT)
        if len(one):
            learned = one[n[one] > 0]
            branch = Branch(key[learned], n[learned], [_masked(low_key, 1), low_key], [low_n, low_n], order, discount)
            for at in range(0, len(one), 1 << 18):
                value[one[at : at + (1 << 18)]] = branch.log10(key[one[at : at + (1 << 18)]])
        return pa.table({"key": table.column("key"), "value": pa.array(value), "c": table.column("c")})

    dealt = counts.withColumn("shard", F.expr(f"if(key < 0, {shards} + pmod(key, {shards}), pmod(xxhash64(shiftright(key, 8) & 65535), {shards}))"))
    values = work.put("values", dealt.groupBy("shard").applyInArrow(answer, "key long, value double, c long"))
    work.drop("counts")
    common = work.put("common", _most_asked(values, COMMON).select("key", "value"))
    held = common.toArrow()
    common_key, common_value = held.column("key").to_numpy().view(np.uint64), held.column("value").to_numpy()
    rare = asked.select("block", "key").join(F.broadcast(common.select("key")), "key", "left_anti")
    answers = rare.join(values.select("key", "value"), "key").select("block", "key", "value")

    def total(texts: pa.Table, given: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        lookup = Lookup(np.concatenate([common_key, given.column("key").to_numpy().view(np.uint64)]), np.concatenate([common_value, given.column("value").to_numpy()]))
        outs = []
        for blob in texts.column("blob"):
            for batch in pa.ipc.open_stream(blob.as_buffer()).read_all().combine_chunks().to_batches():
                data, ends = text_buffers(column(batch, "text"))
                n = len(ends) - 1
                stretches, stops, keys, owner = _keys(data, ends, order)
                full, base = np.add.reduceat(lookup(stretches), stops[:-1]), lookup(keys)
                outs.append(
                    pa.table(
                        {
                            "id": batch.column(0), "train": column(batch, "train"), "n_tokens": pa.array(np.bincount(owner, minlength=n)), "n_known": pa.array(np.bincount(owner[base > unknown + 0.5], minlength=n)),
                            "train_tokens": pa.array(np.full(n, tokens)), "base_score": pa.array(np.bincount(owner, weights=base, minlength=n)), "score": pa.array(full),
                        }
                    )
                )
        return pa.concat_tables(outs) if outs else none

    kind = docs.schema[id_col].dataType
    schema = f"id {kind.simpleString()}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    none = pa.table({"id": pa.array([], to_arrow_type(kind)), "train": pa.array([], pa.bool_()), **{c: pa.array([], pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")}, **{c: pa.array([], pa.float64()) for c in ("base_score", "score")}})
    scored = packed.groupBy("of").cogroup(answers.groupBy("block")).applyInArrow(total, schema)
    return scored.withColumnRenamed("id", id_col)


#: The hash that stands for the end token.
END_HASH = np.uint64(0x5EED0FE4D)
