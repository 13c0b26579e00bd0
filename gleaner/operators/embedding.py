"""Embedding of texts by an endpoint, in batches, behind a cache by content.

A client is a factory called once per worker partition: factory() gives embed(texts) -> vectors. Equal texts are embedded
once; a cached (text_hash, model) is not embedded at all. New vectors are paid for, so they are written (checkpoint)
before they are read, and given to save for the state's table."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.chunking import bag_vector
from gleaner.plans.generate import backoff_delays, http_post, retry
from gleaner.session import cut

Embed = Callable[[list[str]], list[list[float]]]


def http_embed(base_url: str | None, model: str, api_key: str | None = None, timeout: float = 120.0) -> Callable[[], Embed]:
    """Factory of a client of the common embeddings interface. Url and key may come from EMBEDDING_BASE_URL and
    EMBEDDING_API_KEY, never from the settings of the language model, whose key another host must not see."""
    url, key = base_url or os.environ.get("EMBEDDING_BASE_URL"), api_key or os.environ.get("EMBEDDING_API_KEY")
    if not url:
        raise RuntimeError("no embedding endpoint: set embedding.base_url or EMBEDDING_BASE_URL")

    def factory() -> Embed:
        def embed(texts: list[str]) -> list[list[float]]:
            data = http_post(f"{url.rstrip('/')}/embeddings", {"model": model, "input": texts}, key, timeout)["data"]
            return [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]

        return embed

    return factory


def double_embed() -> Embed:
    """A deterministic stand-in."""
    return lambda texts: [bag_vector(t) for t in texts]


def embed_texts(texts: DataFrame, factory: Callable[[], Embed] = double_embed, batch: int = 32) -> DataFrame:
    """texts (h, text) to (h, vec): batch texts a call, each call tried three times."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = factory()
        for pdf in frames:
            vecs: list[list[float]] = []
            for i in range(0, len(pdf), batch):
                part = pdf["text"].iloc[i : i + batch].tolist()
                vecs += retry(lambda part=part: embed(part), backoff_delays(3, 2.0, 30.0))
            yield pd.DataFrame({"h": pdf["h"], "vec": vecs})

    return texts.select("h", "text").mapInPandas(run, "h string, vec array<double>")


def embedder(factory: Callable[[], Embed] = double_embed, model: str = "stand-in", batch: int = 32, cache: DataFrame | None = None, save: Callable[[DataFrame], None] | None = None) -> Callable[[DataFrame], DataFrame]:
    """A function of texts (h: SHA-256, text) to (h, vec) that looks into cache (text_hash, model, vec) first. save gets the
    new rows (text_hash, model, vec)."""

    def vectors(texts: DataFrame) -> DataFrame:
        if cache is None:
            known, missing = None, texts
        else:
            rows = cache.filter((F.col("model") == model) & F.col("vec").isNotNull()).groupBy(F.col("text_hash").alias("h")).agg(F.first("vec").alias("vec"))
            known = texts.select("h").distinct().join(rows, "h")
            missing = texts.join(rows.select("h"), "h", "left_anti")
        new = cut(embed_texts(missing.dropDuplicates(["h"]), factory, batch))
        if save is not None:
            save(new.select(F.col("h").alias("text_hash"), F.lit(model).alias("model"), "vec"))
        return new if known is None else known.unionByName(new)

    return vectors


def from_config(settings: dict, cache: DataFrame | None = None, save: Callable[[DataFrame], None] | None = None, factory: Callable[[], Embed] | None = None) -> Callable[[DataFrame], DataFrame]:
    """The embedder of a configuration's embedding section."""
    return embedder(factory or http_embed(settings["base_url"], settings["model"], settings["api_key"]), settings["model"], settings["batch_size"], cache, save)


__all__ = ["double_embed", "embed_texts", "embedder", "from_config", "http_embed"]
