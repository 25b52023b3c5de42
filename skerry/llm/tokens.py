"""Token counts by a public tokenizer, read from a folder that is a parameter."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.session import spread

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

_LOADED: dict = {}


def encoder(folder: str = TOKENIZER_DIR, name: str = VOCABULARY):
    """The byte-level BPE of ``name``, loaded once per process."""
    if (folder, name) not in _LOADED:
        import tiktoken

        spec = importlib.util.spec_from_file_location("public_tokenizers_at", os.path.join(folder, "__init__.py"))
        mod = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(mod)
        with open(os.path.join(folder, name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[folder, name] = tiktoken.Encoding("own", pat_str=mod.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[folder, name]


def _count(batches: Iterator[pa.RecordBatch], folder: str, name: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(folder, name)
    for b in batches:
        n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int32())], [*b.schema.names[:-1], "tokens"])


def with_tokens(df: DataFrame, keep: list[str], text_col: str, folder: str = TOKENIZER_DIR, name: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``tokens``, the token count of the whole text; a null or empty text has 0."""
    src = spread(df.select(*keep, F.col(text_col).alias("__text")))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(lambda it: _count(it, folder, name), f"{ddl}, tokens int")
