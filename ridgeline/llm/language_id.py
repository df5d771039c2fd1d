"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ridgeline.llm.shared import CHUNK, chunks, text_buffers

UNKNOWN = "und"
#: A-Z count as a-z.
FOLD = np.arange(256)
FOLD[65:91] += 32
SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))


@dataclass
class ByteGru:
    """Weights of both directions (index 0 reads forwards, 1 backwards) and of the label layer.

    Gates are clipped to 0..1 and the candidate to -1..1: piecewise linear units need no exponentials, and training
    sees the same units as prediction.
    """

    labels: list[str]
    inputs: np.ndarray  # 2, 3H, 256: what a byte adds to the reset gate, update gate and candidate
    recurrent: np.ndarray  # 2, 3H, H
    output: np.ndarray  # L, 2H
    bias: np.ndarray  # L

    def parameters(self) -> list[np.ndarray]:
        return [self.inputs, self.recurrent, self.output, self.bias]

    @classmethod
    def fresh(cls, labels: list[str], hidden: int, rng: np.random.Generator) -> ByteGru:
        inputs = rng.normal(0, 0.3, (2, 3 * hidden, 256))
        inputs[:, : 2 * hidden] += 0.5
        recurrent = rng.normal(0, 0.5 / np.sqrt(hidden), (2, 3 * hidden, hidden))
        output = rng.normal(0, 0.3, (len(labels), 2 * hidden))
        return cls(labels, *(x.astype(np.float32) for x in (inputs, recurrent, output, np.zeros(len(labels)))))

    def states(self, codes: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States of (T, B) byte codes as T, 2H, B; at a position, the forward half has read up to it, the backward half from the end."""
        steps, width = codes.shape
        hidden = self.recurrent.shape[2]
        out = np.empty((steps, 2 * hidden, width), np.float32)
        state = np.zeros((2, hidden, width), np.float32)
        added = np.empty((2, 3 * hidden, width), np.float32)
        carried = np.empty_like(added)
        for t in range(steps):
            np.take(self.inputs[0], codes[t], axis=1, out=added[0], mode="clip")
            np.take(self.inputs[1], codes[steps - 1 - t], axis=1, out=added[1], mode="clip")
            np.matmul(self.recurrent, state, out=carried)
            gates = carried[:, : 2 * hidden] + added[:, : 2 * hidden]
            raw_gates = gates.copy() if trace is not None else None
            np.maximum(gates, 0, out=gates)
            np.minimum(gates, 1, out=gates)
            new = gates[:, :hidden] * carried[:, 2 * hidden :]
            new += added[:, 2 * hidden :]
            raw_new = new.copy() if trace is not None else None
            np.maximum(new, -1, out=new)
            np.minimum(new, 1, out=new)
            if trace is not None:
                trace.append((state.copy(), gates, raw_gates, new.copy(), raw_new, carried[:, 2 * hidden :].copy()))
            state -= new
            state *= gates[:, hidden:]
            state += new
            out[t, :hidden], out[steps - 1 - t, hidden:] = state[0], state[1]
        return out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """T, L, B."""
        p = np.matmul(self.output, states)
        p += self.bias[:, None]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def gradients(self, codes: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Backpropagation through time of the weighted mean cross-entropy over all positions; target: B, weight: T, B."""
        trace: list = []
        states = self.states(codes, trace)
        p = self.probabilities(states)
        steps, width = codes.shape
        hidden = self.recurrent.shape[2]
        scale = weight / max(weight.sum(), 1)
        loss = float(-(np.log(np.maximum(p[:, target, np.arange(width)], 1e-9)) * scale).sum())
        p[:, target, np.arange(width)] -= 1
        p *= scale[:, None, :]
        d_output = np.einsum("tlb,thb->lh", p, states, optimize=True)
        d_states = np.matmul(self.output.T, p)
        d_recurrent = np.zeros_like(self.recurrent)
        d_inputs = np.zeros_like(self.inputs)
        back = np.zeros((2, hidden, width), np.float32)
        one_hot = np.eye(256, dtype=np.float32)
        for t in reversed(range(steps)):
            state, gates, raw_gates, new, raw_new, carried = trace[t]
            back = back + np.stack([d_states[t, :hidden], d_states[steps - 1 - t, hidden:]])
            reset, update = gates[:, :hidden], gates[:, hidden:]
            d_new = back * (1 - update) * (np.abs(raw_new) < 1)
            d_gates = np.concatenate([d_new * carried, back * (state - new)], axis=1) * ((raw_gates > 0) & (raw_gates < 1))
            d_carried = np.concatenate([d_gates, d_new * reset], axis=1)
            d_added = np.concatenate([d_gates, d_new], axis=1)
            d_recurrent += np.matmul(d_carried, state.transpose(0, 2, 1))
            d_inputs[0] += d_added[0] @ one_hot[codes[t]]
            d_inputs[1] += d_added[1] @ one_hot[codes[steps - 1 - t]]
            back = back * update + np.matmul(self.recurrent.transpose(0, 2, 1), d_carried)
        return [d_inputs, d_recurrent, d_output.astype(np.float32), p.sum(axis=(0, 2))], loss


def train(samples: list[tuple[str, str]], hidden: int = 6, window: int = 48, width: int = 96, steps: int = 400, rate: float = 0.02, seed: int = 7) -> ByteGru | None:
    """A network fitted to (text, label) samples by Adam; None without samples. Equal samples give equal weights."""
    samples = sorted((s for s in samples if s[0]), key=lambda s: (s[1], s[0]))
    labels = sorted({label for _, label in samples})
    if not labels:
        return None
    steps = max(steps, 25 * len(labels) // 4)  # 600 stretches a label at least
    rng = np.random.default_rng(seed)
    net = ByteGru.fresh(labels, hidden, rng)
    by_label = [[FOLD[np.frombuffer(t.encode(), np.uint8)] for t, label in samples if label == x] for x in labels]
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    for step in range(1, steps + 1):
        target = rng.integers(0, len(labels), width)
        codes, weight = np.full((window, width), 32), np.zeros((window, width), np.float32)
        for b, label in enumerate(target):
            text = by_label[label][rng.integers(len(by_label[label]))]
            at = rng.integers(0, max(1, len(text) - window + 1))
            part = text[at : at + window]
            codes[: len(part), b], weight[: len(part), b] = part, 1
        grads, _ = net.gradients(codes, target, weight)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * min(1.0, 4 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(net.parameters(), grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def training_samples(docs: DataFrame, text_col: str, label_col: str, use: Column, id_col: str, per_label: int, chars: int, buckets: int = 64) -> list[tuple[str, str]]:
    """At most `per_label` stretches of `chars` characters for each label, from anywhere in the texts of rows that `use` admits.

    The rows with the lowest hashed ids are taken, so the sample is the same on every run. They are found in two levels, first
    in `buckets` of a label, then in the label, and only ranked rows leave a task of the first level: so however many tasks
    there are, at most buckets * per_label rows of a label meet in one. Every label is sampled.
    """
    key = F.xxhash64(docs[id_col], docs[text_col])
    length = F.length(docs[text_col])
    start = F.pmod(F.shiftright(key, 8), F.greatest(F.lit(1), length - chars + 1)).cast("int") + 1
    picked = docs.filter(use & docs[label_col].isNotNull() & (length > 0)).select(
        F.substring(docs[text_col], start, F.lit(chars)).alias("t"), docs[label_col].cast("string").alias("label"), key.alias("k")
    )
    first = Window.partitionBy("label", F.pmod("k", F.lit(buckets))).orderBy("k", "t")
    ranked = picked.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= per_label).drop("r")
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("k", "t"))).filter(F.col("r") <= per_label)
    rows = ranked.select("t", "label").orderBy("label", "t").collect()
    return [(r["t"], r["label"]) for r in rows]


def _has_letter(raw: bytes) -> bool:
    return any(65 <= (b & 0xDF) <= 90 for b in raw) if raw.isascii() else any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def pooled(net: ByteGru, data: np.ndarray, offsets: np.ndarray, window: int = 64, width: int = 1024, spans: bool = False):
    """Mean probabilities of each row's positions (rows, L), and each row's most likely label by position if asked for."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    parts = -(-lengths // window)
    owner = np.repeat(np.arange(n), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = offsets[owner] + nth * window
    size = np.minimum(window, offsets[owner + 1] - begin)
    total = np.zeros((n, len(net.labels)))
    marks = np.empty(len(data), np.min_scalar_type(len(net.labels))) if spans else None
    folded = FOLD[data]
    for at in range(0, len(owner), width):
        low, count = begin[at : at + width], size[at : at + width]
        index = np.minimum(low[None, :] + np.arange(window)[:, None], len(data) - 1)
        inside = np.arange(window)[:, None] < count[None, :]
        codes = folded[index]
        if count.min() < window:
            codes[~inside] = 32
        p = net.probabilities(net.states(codes))
        if spans:
            marks[index[inside]] = p.argmax(axis=1)[inside]
        if count.min() < window:
            p *= inside[:, None, :]
        np.add.at(total, owner[at : at + width], p.sum(axis=0).T)
    return total / np.maximum(lengths, 1)[:, None], marks


def predict(docs: DataFrame, net: ByteGru | None, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score", spans_col: str | None = None) -> DataFrame:
    """The docs with their predicted language and its pooled probability, by the text alone.

    Every byte of the whole text is labelled, in windows; the probabilities are averaged over the document. A null text,
    one without a letter, and every text where no model could be trained get `und` with score 0. spans_col adds the
    runs of equally labelled bytes. Columns that have the new names are replaced. No shuffle.
    """
    new = [T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())] + ([T.StructField(spans_col, SPAN_TYPE)] if spans_col else [])
    kept = [c for c in docs.columns if c not in {f.name for f in new}]
    read = kept if text_col in kept else [*kept, text_col]
    source, at = docs.select(*[docs[c] for c in read]), read.index(text_col)
    schema = T.StructType([*[f for f in docs.schema if f.name in kept], *new])

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(at))
            langs, scores, runs = [], [], []
            for low, high in chunks(offsets, CHUNK):
                base = offsets[low]
                part, ends = data[base : offsets[high]], offsets[low : high + 1] - base
                mean, marks = pooled(net, part, ends, spans=spans_col is not None) if net and len(part) else (None, None)
                for k in range(high - low):
                    raw = part[ends[k] : ends[k + 1]]
                    if mean is None or not len(raw) or not _has_letter_fast(raw):
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        runs.append([])
                        continue
                    best = int(mean[k].argmax())
                    langs.append(net.labels[best])
                    scores.append(min(1.0, float(mean[k][best])))
                    if spans_col:
                        own = marks[ends[k] : ends[k + 1]]
                        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
                        runs.append([{"start": a, "end": b, "lang": net.labels[own[a]]} for a, b in zip(cuts, cuts[1:])])
            added = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            if spans_col:
                added.append(pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
            columns = [batch.column(k) for k in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, *added], names=[*kept, *(f.name for f in new)])

    return source.mapInArrow(run, schema)


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _has_letter_fast(raw: np.ndarray) -> bool:
    return bool(_LETTER[raw[:64]].any() or _LETTER[raw].any()) or _has_letter(raw.tobytes())


def fit(docs: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = 400, chars: int = 400) -> ByteGru | None:
    """A network from a bounded sample (`per_label` stretches of `chars` characters a label) of the rows that `use` admits."""
    return train(training_samples(docs, text_col, label_col, use, id_col, per_label, chars))


def fold_of(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % folds


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", folds: int = 4, held_out: int = 2) -> DataFrame:
    """The docs with held_out, lang_pred and score; learned from the rows that aren't held out."""
    net = fit(docs, fold_of(docs[id_col], folds) != held_out, id_col, text_col, label_col)
    return predict(docs.withColumn("held_out", fold_of(docs[id_col], folds) == held_out), net, text_col)
