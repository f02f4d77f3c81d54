"""Token counts of whole texts: Arrow batches in, lengths out, no token ids leave Python."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, fresh, prepare, text_bytes, with_fields

#: Text that is encoded at once, in bytes; batches are filled up to it whatever their rows.
BATCH_BYTES = 1 << 18
#: Longer texts are split into pieces of about so many characters.
PIECE_CHARS = 1 << 14
#: Texts above it are over the limit of a context.
LIMIT = 4096


def default_model() -> str:
    """Where the default tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=4)
def sentencepiece_model(path: str):
    """The model, loaded once a worker, and whether its texts may be split at blanks.

    A split before a blank is safe if no piece has the blank's mark behind another character,
    if the mark is put before a text, and if blanks are kept as they are. All is read off the
    model itself; one that differs is encoded without splits.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    safe = not any("▁" in p[1:] and p.strip("▁") for p in pieces)
    probe = "a  b" * 2 + " c\nd "
    safe = safe and model.encode(probe, out_type=str) == [x for part in ("a", " b" + "a", " b", "c\nd ") for x in model.encode(part, out_type=str)]
    return model, safe


def safe_pieces(text: str, size: int) -> list[str]:
    """The text cut at blanks between two characters that are not blank; each such blank goes,
    as the encoder puts one before a piece. No cut where there is no such blank."""
    out, at = [], 0
    blank = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
    while len(text) - at > size and (m := blank.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]


def count_tokens(texts: list[str | None], path: str, batch_bytes: int = BATCH_BYTES, piece_chars: int = PIECE_CHARS) -> list[int]:
    """Tokens of each text; null counts as empty."""
    model, safe = sentencepiece_model(path)
    counts = [0] * len(texts)
    batch: list[str] = []
    owner: list[int] = []
    held = 0  # bytes, by which batches are balanced

    def flush() -> None:
        for i, ids in zip(owner, model.encode(batch, num_threads=1), strict=True):
            counts[i] += len(ids)
        batch.clear()
        owner.clear()

    for i, text in enumerate(texts):
        for piece in safe_pieces(text, piece_chars) if text and safe else [text or ""]:
            batch.append(piece)
            owner.append(i)
            held += len(piece.encode())
            if held >= batch_bytes:
                flush()
                held = 0
    if batch:
        flush()
    return counts


def with_token_counts(docs: DataFrame, model: str | None = None, name: str = "n_tokens") -> tuple[DataFrame, str]:
    """docs and a column of token counts, and that column's name (fresh if docs has it)."""
    prepare(docs.sparkSession)
    path = model or default_model()
    at = docs.columns.index("text")
    (name,) = fresh(docs, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield attach(batch, {name: pa.array(count_tokens(batch.column(at).to_pylist(), path), pa.int64())})

    return docs.mapInArrow(run, with_fields(docs.schema, (name, T.LongType()))), name


def token_counts(docs: DataFrame, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows each have a row; a null
    doc_id stays null; an empty table gives no rows; other columns are not read.
    """
    rows, name = with_token_counts(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", text_bytes("text").alias("n_bytes"), F.col(name).alias("n_tokens"), (F.col(name) > limit).alias("over_limit"))
