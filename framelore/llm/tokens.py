"""Token counts of texts with a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where the vocabulary lies; every function takes another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how texts are cut before byte pairs are joined, for vocabularies of ranks.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"
_LOADED: dict[str, Callable[[list[str]], list[int]]] = {}


def token_counter(path: str = VOCABULARY) -> Callable[[list[str]], list[int]]:
    """Token counts of texts by a vocabulary file (.tiktoken ranks, .json, .model), loaded once per worker process.

    The strings of special tokens in a text are ordinary text.
    """
    if path not in _LOADED:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            coder = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _LOADED[path] = lambda texts: [len(coder.encode_ordinary(t)) for t in texts]
        elif path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            loaded = Tokenizer.from_file(path)
            loaded.encode_special_tokens = True
            loaded.no_truncation()
            _LOADED[path] = lambda texts: [len(x.ids) for x in loaded.encode_batch(texts, add_special_tokens=False)]
    return _LOADED[path]


def with_tokens(docs: DataFrame, path: str = VOCABULARY, key: str = "text_id", text: str = "text") -> DataFrame:
    """(``key``, tokens) for each row of ``docs``; a null text has 0 tokens.  Whole texts are counted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.iloc[at : at + 256]
                yield pd.DataFrame({key: some[key], "tokens": count(some[text].fillna("").tolist())})

    return docs.select(key, text).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, tokens bigint")


def distinct_texts(docs: DataFrame, preference: Column | None = None) -> DataFrame:
    """One row per different non-empty text: text_id (digest), the doc_id, source and lang of the row that stands for it, and how many rows hold it.

    Of the rows that hold a text the one with the smallest ``preference``, then
    the smallest doc_id stands for it.  Copies are joined by an aggregate on
    the digest with map-side combine, so a text that fills a third of all rows
    is one row per task.
    """
    rank = preference if preference is not None else F.lit(0)
    return (
        docs.where("text is not null and length(text) > 0")
        .groupBy(F.sha2("text", 256).alias("text_id"))
        .agg(
            F.min(F.struct(rank.alias("rank"), F.coalesce("doc_id", F.lit(2**63 - 1)).alias("order"), F.col("doc_id"), F.col("source"), F.col("lang"))).alias("first"),
            F.any_value("text").alias("text"),
            F.count("*").alias("copies"),
        )
        .select("text_id", F.col("first.doc_id").alias("doc_id"), F.col("first.source").alias("source"), F.col("first.lang").alias("lang"), "text", "copies")
    )
