"""Token counts of whole texts by a public tokenizer, and ranks within groups of any size."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOKENIZER = os.environ.get("PALIMPSEST_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how the vocabulary of ranks cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The rank tokenizer's pattern matcher recurses over white space; texts with more in a row go to the other library.
LONG_SPACE = 5000
ROWS_PER_BUCKET = 1_000_000
_LOADED: dict = {}


def _vocabulary(path: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def _counter(path: str):
    """Function from texts to numbers of tokens.  A file of ranks (.tiktoken) has the same vocabulary as .json beside it."""
    if path not in _LOADED:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            quick, slow = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}), []
            spaced = re.compile(rf"\s{{{LONG_SPACE}}}")

            def count(texts: list[str]) -> list[int]:
                out = []
                for t in texts:
                    if len(t) >= LONG_SPACE and spaced.search(t):
                        slow[:] = slow or [_vocabulary(path.removesuffix(".tiktoken") + ".json")]
                        out.append(len(slow[0].encode(t, add_special_tokens=False)))
                    else:
                        out.append(len(quick.encode_ordinary(t)))
                return out
        else:
            tokenizer = _vocabulary(path)

            def count(texts: list[str]) -> list[int]:
                # A few texts at a time: encodings of long texts are large.
                return [len(e) for at in range(0, len(texts), 64) for e in tokenizer.encode_batch_fast(texts[at : at + 64], add_special_tokens=False)]

        _LOADED[path] = count
    return _LOADED[path]


def token_counts(docs: DataFrame, key: str, text: str, keep: list[str] | None = None, path: str = TOKENIZER) -> DataFrame:
    """key, the ``keep`` columns and tokens.  Null texts have no tokens; special tokens' strings are ordinary text."""
    keep = keep or []
    chosen = docs.select(F.col(key).alias("key"), *keep, F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "__text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = _counter(path)
        for pdf in batches:
            yield pdf.drop(columns="__text").assign(tokens=tokens(pdf["__text"].fillna("").tolist()))

    return chosen.mapInPandas(count, f"{fields}, tokens bigint")


def with_rank(df: DataFrame, groups: list[str], key: Column, out: str = "rank", largest: int | None = None, per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Number the rows of each group from 0, in two levels: within hashed buckets, then by the buckets' offsets.

    The number of buckets follows the ``largest`` group (counted if not given), so
    no task sorts more than about ``per_bucket`` rows of a group, however large.
    Rows are numbered by bucket, then key; repeated keys get numbers of their own.
    """
    if largest is None:
        largest = df.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-largest // per_bucket))
    local = lambda part: (F.row_number().over(W.partitionBy(*part).orderBy(key)) - 1).cast("long")
    if buckets == 1:
        return df.withColumn(out, local(groups))
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    sizes = df.groupBy(*groups, "__bucket").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*groups).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*groups, "__bucket", before.alias("__offset"))
    return df.withColumn("__local", local([*groups, "__bucket"])).join(offsets, [*groups, "__bucket"]).withColumn(out, F.col("__local") + F.col("__offset")).drop("__bucket", "__local", "__offset")
