"""Vectors of texts by a provider, kept by what they are vectors of: a text is embedded once for each model.

A vector's key is the digest of its text, so copies share it, a changed text has a new one, and a
second run over the same texts embeds nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.vectors import SEEDS
from ..session import written
from .layout import exists, join_unique

class Provider(Protocol):
    """Embeds texts. It is sent to tasks, so it has to be picklable; a client is made where it is first used."""

    name: str
    dims: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """One row of ``dims`` numbers for each text."""
        ...


class HashProvider:
    """Vectors without a model: numbers from SHA-256 of the text, of length 1, the same as ``hash_embedding`` has."""

    name, dims = "sha256", SEEDS * 8

    def embed(self, texts: list[str]) -> np.ndarray:
        digests = (hashlib.sha256(t.encode()).digest() for t in texts)
        seeds = [s.to_bytes(4, "big") for s in range(SEEDS)]
        raw = np.frombuffer(b"".join(hashlib.sha256(d + s).digest() for d in digests for s in seeds), dtype=">i4").reshape(len(texts), self.dims).astype(np.float64)
        norms = np.sqrt((raw * raw).sum(axis=1))
        return raw / np.where(norms == 0, 1, norms)[:, None]


#: Providers by name; a deployment adds its own.
PROVIDERS: dict[str, Callable[[], Provider]] = {HashProvider.name: HashProvider}


def provider_of(config: EngineConfig = DEFAULT) -> Provider:
    """The provider that is set."""
    if config.embedding_provider not in PROVIDERS:
        raise ValueError(f"no provider {config.embedding_provider}; there are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[config.embedding_provider]()


def content_key(text: Column) -> Column:
    """The key of a text's vector; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class VectorTable:
    """Vectors of one provider under a path: (key, vector)."""

    def __init__(self, spark: SparkSession, path: str, provider: Provider | None = None, config: EngineConfig = DEFAULT) -> None:
        self.spark, self.config, self.provider = spark, config, provider or provider_of(config)
        self.path = f"{path.rstrip('/')}/{self.provider.name}"

    def stored(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], "key string, vector array<double>")
        return self.spark.read.schema("key string, vector array<double>").parquet(self.path)

    def unknown(self, texts: DataFrame, text: str) -> DataFrame:
        """(key, text) of texts that have no vector yet, each once."""
        keyed = texts.select(content_key(F.col(text)).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
        return keyed.join(self.stored().select("key"), "key", "left_anti").groupBy("key").agg(F.first("text").alias("text"))

    def fill(self, texts: DataFrame, text: str) -> int:
        """Embed what is unknown of texts and keep it; how many that were."""
        new = written(self.unknown(texts, text).mapInPandas(_embedded(self.provider, self.config), "key string, vector array<double>"), "embedded")
        n = new.count()
        if n:
            new.write.mode("append").parquet(self.path)
        return n

    def vectors(self, rows: DataFrame, id_col: str, text: str) -> DataFrame:
        """(id, vector) of all rows whose texts have a vector; copies of one text, however many, don't meet in one task."""
        keyed = written(rows.select(F.col(id_col).alias("id"), content_key(F.col(text)).alias("key")), "keyed")
        return join_unique(keyed, self.stored(), "key").select("id", "vector")


def of_rows(rows: DataFrame, id_col: str, text: str, provider: Provider | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """(id, vector) of rows whose texts are all different: each is embedded where it is, as a table of texts would save nothing."""
    texts = rows.select(F.col(id_col).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    return texts.mapInPandas(_embedded(provider or provider_of(config), config), f"key {dict(texts.dtypes)['key']}, vector array<double>").withColumnRenamed("key", "id")


def _embedded(provider: Provider, config: EngineConfig):
    """Texts through a provider in batches, bounded by their number and bytes; one text at least."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sizes = rows["text"].map(lambda t: len(t.encode())).to_numpy()
            at = 0
            while at < len(rows):
                upto = np.cumsum(sizes[at : at + config.embedding_batch_texts])
                end = at + max(1, int(np.searchsorted(upto, config.embedding_batch_bytes, side="right")))
                part = rows.iloc[at:end]
                found = np.asarray(provider.embed(part["text"].tolist()), dtype=np.float64)
                if found.shape != (len(part), provider.dims):
                    raise ValueError(f"{provider.name} gave {found.shape} for {len(part)} texts of {provider.dims} dimensions")
                yield pd.DataFrame({"key": part["key"].to_numpy(), "vector": list(found)})
                at = end

    return run
