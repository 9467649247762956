"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .bpe import PATTERN, load_ranks

#: Folder of the tokenizers' files on every machine.
TOKENIZERS = os.environ.get("MESHWRIGHT_TOKENIZERS", "/opt/tokenizers")


def ranks_path(tokenizer: str, folder: str = TOKENIZERS) -> str:
    return f"{folder}/{tokenizer}.tiktoken"


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str = PATTERN) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def with_sizes(documents: DataFrame, path: str) -> DataFrame:
    """``documents`` with its ``text`` replaced by ``n_tokens`` (0 for null and empty texts)."""
    others = [c for c in documents.columns if c != "text"]
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(sizes, pa.int64())], [*others, "n_tokens"])

    return documents.select(*others, "text").mapInArrow(run, f"{schema}, n_tokens long")
