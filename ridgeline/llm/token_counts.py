"""Token counts: lengths of encodings, made in batches balanced by bytes."""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from ridgeline.llm.shared import column

#: A single space between two characters that are neither spaces nor the piece mark.
_SAFE = re.compile("(?<=[^ ▁]) (?=[^ ▁])")
_models: dict[str, tuple] = {}


def _model(path: str):
    """The processor, and whether texts may be split at single spaces: no piece may hold a mark after another character."""
    if path not in _models:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
        safe = not any("▁" in p.lstrip("▁") for p in pieces)
        _models[path] = processor, safe
    return _models[path]


def split_safely(text: str, limit: int) -> list[str]:
    """Pieces of about `limit` characters whose encodings, put together, are the encoding of the text.

    The text is cut only at single spaces; the space goes, as the encoder puts one before each piece.
    """
    pieces, start = [], 0
    while len(text) - start > limit:
        cut = _SAFE.search(text, start + limit)
        if cut is None:
            break
        pieces.append(text[start : cut.start()])
        start = cut.end()
    pieces.append(text[start:])
    return pieces


def _balanced(pieces: list[str], limit: int):
    """Runs of pieces of at most `limit` characters together; a longer piece stands alone."""
    run, size = [], 0
    for k, piece in enumerate(pieces):
        if run and size + len(piece) > limit:
            yield run
            run, size = [], 0
        run.append(k)
        size += len(piece)
    if run:
        yield run


def lengths(texts: list[str | None], path: str, piece_chars: int = 8192, batch_chars: int = 1 << 19) -> np.ndarray:
    processor, safe = _model(path)
    pieces, owner = [], []
    for row, text in enumerate(texts):
        parts = split_safely(text, piece_chars) if safe and text else [text or ""]
        pieces += parts
        owner += [row] * len(parts)
    out = np.zeros(len(texts), np.int64)
    rows = np.asarray(owner, np.int64)
    for run in _balanced(pieces, batch_chars):
        counted = [len(ids) for ids in processor.encode([pieces[k] for k in run], num_threads=1)]
        np.add.at(out, rows[run], counted)
    return out


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = 4096) -> DataFrame:
    """Tokens of every whole text under a sentencepiece model.

    Returns id_col, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit), one row for each input row, with no
    shuffle. Null and empty texts have 0 bytes and 0 tokens; a text of any length is counted whole, in pieces that are
    cut only where the encoding can't reach across. Other columns are never read. Repeated rows are counted each.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), column(batch, "_text")
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            n = lengths(texts.to_pylist(), path)
            yield pa.RecordBatch.from_arrays([ids, n_bytes, pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(docs[id_col], docs[text_col].alias("_text"))
    return picked.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
