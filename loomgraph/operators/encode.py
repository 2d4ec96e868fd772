"""Vectors of texts: a protocol for model-backed encoders, and the hashing encoder where there is no model."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import text  # noqa: F401  (defines hash_encoding)
from loomgraph.plans.engine import plan

#: Buckets of the hashing encoder (``word_buckets``).
BUCKETS = 64


class Encoder(Protocol):
    """Vectors of texts, one row each; one that needs a model loads it on its first call in a worker."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


def encoded(nodes: DataFrame, encoder: Encoder | None = None, batch: int = 64) -> DataFrame:
    """(node, x) of ``nodes`` (node, text): unit vectors, zeros where there is nothing to encode; a null text is empty.

    Without an ``encoder`` words are hashed into buckets, which stays inside Spark. Whole texts are encoded.
    """
    texts = nodes.select("node", F.coalesce("text", F.lit("")).alias("text"))
    if encoder is None:
        sparse = plan(nodes.sparkSession, "hash_encoding", texts=texts)
        found = sparse.groupBy(F.col("node").alias("__node")).agg(F.map_from_entries(F.collect_list(F.struct("pos", "val"))).alias("m"))
        x = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0e0)))
        return texts.join(found, F.col("node") == F.col("__node"), "left").select("node", x.alias("x"))

    def vectors(batches):
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                some = pdf.iloc[i : i + batch]
                x = np.asarray(encoder(some["text"].tolist()), float).reshape(len(some), -1)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"node": some["node"].to_numpy(), "x": list(x)})

    return texts.mapInPandas(vectors, "node long, x array<double>")
