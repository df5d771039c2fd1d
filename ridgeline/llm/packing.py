"""Packing: bounded-space online best fit of documents into fixed windows, with leftovers merged at the end."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.bytewords import segments, span_hashes
from ridgeline.llm.shared import CHUNK, Workspace, chunks, column, text_buffers

#: Partitions whose leftovers meet in one task of the second pass; it bounds that task to MERGE * open windows.
MERGE = 32
_encoders: dict[str, SegmentEncoder] = {}


class SegmentEncoder:
    """Ids of texts from the ids of their segments, each distinct segment being encoded once.

    A segment begins at a space before a visible character; the pre-tokenizer attaches such a space to what follows, so
    the ids of a text are those of its segments in turn. Distinct segments are encoded together, one after another in
    one string, and told apart again by the tokens that begin with the space. The memory of segments is bounded:
    it starts anew beyond `keep` segments.
    """

    def __init__(self, path: str, keep: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keep = keep
        size = self.tokenizer.get_vocab_size()
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self._clear()

    def _clear(self):
        self.keys, self.first = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.count, self.ids = np.empty(0, np.int64), np.empty(0, np.uint32)

    def _encode_alone(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Those of one space and then no other white space are encoded in runs."""
        out: list = [None] * len(texts)
        plain = [k for k, t in enumerate(texts) if t[:1] == " " and len(t.split()) == 1 and t.strip() == t[1:]]
        for at in range(0, len(plain), 256):
            run = plain[at : at + 256]
            ids = self._encode_alone(["".join(texts[k] for k in run)])[0]
            begins = np.flatnonzero(self.spaced[ids])
            if len(begins) == len(run) and begins[0] == 0:
                for k, part in zip(run, np.split(ids, begins[1:]), strict=True):
                    out[k] = part
        rest = [k for k, x in enumerate(out) if x is None]
        for k, ids in zip(rest, self._encode_alone([texts[k] for k in rest]), strict=True):
            out[k] = ids
        return out

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        if len(self.keys) + len(keys) > self.keep:
            self._clear()
        encoded = self._encode(texts)
        count = np.array([len(x) for x in encoded], np.int64)
        first = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, *encoded])
        merged = np.concatenate([self.keys, keys])
        order = np.argsort(merged, kind="stable")
        self.keys = merged[order]
        self.first = np.concatenate([self.first, first])[order]
        self.count = np.concatenate([self.count, count])[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and n+1 offsets into them."""
        starts, ends, rows = segments(data, offsets)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        keys, at, inverse = np.unique(span_hashes(data, starts, ends, folded=False), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        if not known.all():
            if len(self.keys) + int((~known).sum()) > self.keep:
                self._clear()
                known[:] = False
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            self._learn(keys[new], [raw[starts[k] : ends[k]].decode("utf-8", "replace") for k in at[new]])
        place = np.searchsorted(self.keys, keys)[inverse]
        count = self.count[place]
        stop = np.cumsum(count)
        source = np.repeat(self.first[place] - (stop - count), count) + np.arange(stop[-1])
        per_row = np.bincount(rows, weights=count, minlength=len(offsets) - 1).astype(np.int64)
        return self.ids[source], np.concatenate([[0], np.cumsum(per_row)])


def _encoder(path: str) -> SegmentEncoder:
    if path not in _encoders:
        _encoders[path] = SegmentEncoder(path)
    return _encoders[path]


class _Packer:
    """Best fit into at most `most` open windows; a window leaves when it is full, or as the fullest when none fits."""

    def __init__(self, window: int, most: int, min_cut: int, first_id: int):
        self.window, self.most, self.min_cut, self.next_id = window, most, min_cut, first_id
        self.open: list[list] = []  # [free, pieces]
        self.done: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset, None))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.window:
            self._emit([(doc, start, ids[start : start + self.window], total)])
            start += self.window
        while start < total:
            size = total - start
            fits = [w for w in self.open if w[0] >= size]
            if fits:
                best = min(fits, key=lambda w: w[0])
            elif len(self.open) < self.most:
                self.open.append(best := [self.window, []])
            else:
                best = min(self.open, key=lambda w: w[0])
                if best[0] < self.min_cut:
                    self.open.remove(best)
                    self._emit(best[1])
                    continue
            part = ids[start : start + min(size, best[0])]
            best[1].append((doc, start, part, total))
            best[0] -= len(part)
            start += len(part)
            if best[0] == 0:
                self.open.remove(best)
                self._emit(best[1])


def _merge(pieces: list[tuple], window: int, first_id: int) -> list[tuple]:
    """Leftover pieces cut into full windows; the remainder into sequences of power-of-two lengths, which need no padding."""
    total, sizes = sum(len(p[2]) for p in pieces), []
    sizes += [window] * (total // window)
    rest = total % window
    sizes += [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
    out, queue, sequence = [], list(reversed(pieces)), first_id
    for size in sizes:
        offset = 0
        while offset < size:
            doc, start, ids, doc_tokens = queue.pop()
            part = ids[: size - offset]
            if len(part) < len(ids):
                queue.append((doc, start + len(part), ids[len(part) :], doc_tokens))
            out.append((doc, start, len(part), zlib.crc32(part.tobytes()), doc_tokens, sequence, offset))
            offset += len(part)
        sequence += 1
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = 1024, end_id: int = 0, open_windows: int = 32, min_cut: int = 16) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most `window` tokens.

    A document is its ids and then `end_id`. Whole windows go out at once; the remainder goes to the open window that it
    fills best. If none fits, a new window opens while fewer than `open_windows` are open; else the fullest goes out: it
    is first filled by cutting the piece where at least `min_cut` tokens are free, so under `min_cut` are ever padded.
    The windows still open at a partition's end are kept with their ids, and those of MERGE neighbouring partitions are
    merged into full windows and one remainder of power-of-two sequences.

    Returns id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null and empty texts are the end id
    alone. Repeated rows are packed each. An empty table gives no rows. The documents are never shuffled; the first
    pass is written to the shared folder, as both its finished and its open windows are read.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def table(rows: list[tuple], id_type: pa.DataType, extra: list) -> pa.RecordBatch:
        kinds = [id_type, *[pa.int64()] * 6, *extra]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[*names, *["ids", "part"][: len(extra)]])

    def first(batches):
        part = TaskContext.get().partitionId()
        packer, encoder, id_type = _Packer(window, open_windows, min_cut, part << 32), _encoder(path), None
        end = np.array([end_id], np.uint32)
        for batch in batches:
            id_type = batch.column(0).type
            ids, (data, offsets) = batch.column(0).to_pylist(), text_buffers(column(batch, "_text"))
            for low, high in chunks(offsets, CHUNK):
                base = offsets[low]
                tokens, stops = encoder.encode(data[base : offsets[high]], offsets[low : high + 1] - base)
                for k in range(high - low):
                    packer.add(ids[low + k], np.concatenate([tokens[stops[k] : stops[k + 1]], end]))
                yield table([(*r, None) for r in packer.done], id_type, [pa.binary(), pa.int32()])
                packer.done = []
        if packer.done or packer.open:
            left = [(doc, start, len(x), 0, total, -1, -1, x.tobytes(), part) for w in packer.open for doc, start, x, total in w[1]]
            yield table([(*r, None) for r in packer.done] + left, id_type, [pa.binary(), pa.int32()])

    def second(key, left):
        group = key[0].as_py()
        rows = sorted(left.to_pylist(), key=lambda r: (r["part"], r["n"]))
        pieces = [(r[id_col], r["start"], np.frombuffer(r["ids"], np.uint32), r["doc_tokens"]) for r in rows]
        kinds = [id_type_of, *[pa.int64()] * 6]
        merged = _merge(pieces, window, (1 << 31 | group) << 31)
        return pa.Table.from_arrays([pa.array([r[k] for r in merged], t) for k, t in enumerate(kinds)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type_of = to_arrow_type(docs.schema[id_col].dataType)
    work = Workspace(docs.sparkSession, "packing")
    picked = docs.select(docs[id_col], docs[text_col].alias("_text"))
    placed = work.put("first", picked.mapInArrow(first, schema + ", ids binary, part int"))
    done = placed.filter(F.col("part").isNull()).select(*names)
    left = placed.filter(F.col("part").isNotNull()).withColumn("n", F.monotonically_increasing_id())
    left = left.select(*[c for c in names if c not in ("ids_crc32", "sequence_id", "offset")], "ids", "part", "n", F.expr(f"part div {MERGE}").cast("int").alias("g"))
    merged = left.groupBy("g").applyInArrow(second, schema)
    return done.unionByName(merged)
