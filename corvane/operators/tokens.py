"""Token counts in Arrow batches; the tokenizer is built once a task."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Counter = Callable[[str], int]


def words() -> Counter:
    """Runs without white space: needs no vocabulary."""
    pattern = re.compile(r"[^\x20\x09-\x0D]+")
    return lambda text: sum(1 for _ in pattern.finditer(text))


@lru_cache(maxsize=2)
def _tokenizer(spec: str):
    """A worker's tokenizer of a specification, built once."""
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


def tokenizer_file(path: str) -> Callable[[], Counter]:
    """A counter from a tokenizers file, without added special tokens. The driver reads the file, whose size its format bounds,
    and sends it with the tasks."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()

    def make() -> Counter:
        t = _tokenizer(spec)
        return lambda text: len(t.encode(text, add_special_tokens=False).ids)

    return make


def tiktoken_ranks(path: str, pattern: str, special: dict[str, int] | None = None) -> Callable[[], Counter]:
    """A counter from a file of ranks; special tokens' strings count as one token each."""

    def make() -> Counter:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special or {})
        return lambda text: len(e.encode(text, allowed_special="all"))

    return make


def count(files: DataFrame, counter: Callable[[], Counter]) -> DataFrame:
    """path and tokens; a text that can't be tokenized fails the query, a null text has none."""

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = counter()
        for texts in batches:
            yield texts.map(lambda t: one(t) if isinstance(t, str) else 0)

    return files.select("path", tokens("content").alias("tokens"))


def total(counts: DataFrame) -> DataFrame:
    return counts.agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("files"))
