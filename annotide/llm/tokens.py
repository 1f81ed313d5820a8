"""Token counts of whole texts with a sentencepiece model.

Arrow batches are cut into parts of about equal bytes, each part is encoded in
one call, and only lengths return.  Long texts are cut where no piece can
cross: at a single space between two ASCII letters or digits.  No piece of
the model holds a space mark after another character, and the encoder puts
such a mark before every text, so the cut drops the space and the counts add.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from annotide.llm.common import append_columns

#: Bytes encoded in one call, and characters after which a long text is cut.
CALL_BYTES, LONG_CHARS = 1 << 20, 1 << 14
_SAFE = re.compile(r"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")
_models: dict[str, object] = {}


def model_at(path: str):
    """The model of a file, loaded once a process."""
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def pieces(text: str, limit: int = LONG_CHARS) -> list[str]:
    """Parts whose counts add up to the text's; each ends at the first safe cut past ``limit`` characters."""
    out, start = [], 0
    while len(text) - start > limit:
        cut = _SAFE.search(text, start + limit)
        if not cut:
            break
        out.append(text[start : cut.start()])
        start = cut.end()
    out.append(text[start:])
    return out


def count_tokens(model, texts: Sequence[str], limit: int = LONG_CHARS) -> list[int]:
    parts = [pieces(t, limit) for t in texts]
    sizes = iter([len(x) for x in model.encode([p for own in parts for p in own], num_threads=1)])
    return [sum(next(sizes) for _ in own) for own in parts]


def with_token_counts(documents: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``documents`` with n_bytes (UTF-8) and n_tokens of each whole text; null counts as empty.

    ``path`` names the model file, which every executor must have.  Columns
    named n_bytes or n_tokens are replaced.
    """

    def kernel(texts: list[str]) -> list[pa.Array]:
        sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
        return [pa.array(sizes, pa.int64()), pa.array(count_tokens(model_at(path), texts), pa.int64())]

    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return append_columns(documents, text, added, kernel, CALL_BYTES)
