"""Embeddings (term, embedding array<float>): lookup, cosine pairs, centroids, nearest terms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from ..functions.scoring import cosine


def checked(embeddings: DataFrame, dim: int = 128) -> DataFrame:
    """Rows whose vectors have the dimension; others raise when read."""
    ok = F.size("embedding") == dim
    return embeddings.withColumn("embedding", F.when(ok, F.col("embedding")).otherwise(F.raise_error(F.lit(f"embedding must have {dim} components")).cast(embeddings.schema["embedding"].dataType)))


def write(embeddings: DataFrame, path: str, dim: int = 128) -> None:
    """The sink: vectors of another dimension make the write fail; the last write of a term is the caller's to choose."""
    checked(embeddings, dim).write.mode("overwrite").parquet(path)


def encoded(vector: Column) -> Column:
    """binary: the little-endian float32 form of a vector."""
    return _encode(vector)


def decoded(raw: Column) -> Column:
    """array<float> of encoded()."""
    return _decode(raw)


@F.pandas_udf(BinaryType())
def _encode(v: pd.Series) -> pd.Series:
    return v.map(lambda x: np.asarray(x, "<f4").tobytes(), na_action="ignore")


@F.pandas_udf(ArrayType(FloatType()))
def _decode(v: pd.Series) -> pd.Series:
    return v.map(lambda x: np.frombuffer(x, "<f4"), na_action="ignore")


def pair_cosine(pairs: DataFrame, embeddings: DataFrame, key: str = "term") -> DataFrame:
    """a, b, cosine; 0 where either vector is unknown."""
    left = embeddings.select(F.col(key).alias("a"), F.col("embedding").alias("ea"))
    right = embeddings.select(F.col(key).alias("b"), F.col("embedding").alias("eb"))
    return pairs.join(left, "a", "left").join(right, "b", "left").select("a", "b", F.coalesce(cosine(F.col("ea"), F.col("eb")), F.lit(0.0)).alias("cosine"))


def centroids(groups: DataFrame, embeddings: DataFrame, key: str = "term") -> DataFrame:
    """group_id, embedding: element-wise mean of the known vectors of each group; groups (group_id, term)."""
    x = groups.join(embeddings.select(key, F.posexplode("embedding").alias("i", "x")), key)
    means = x.groupBy("group_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("group_id", F.col("v.x").alias("embedding"))


def to_centroid(terms: DataFrame, center: DataFrame) -> DataFrame:
    """Every row of terms (key, embedding) with its cosine to the single row of center."""
    c = F.broadcast(center.select(F.col("embedding").alias("_c")))  # one row
    return terms.join(c).withColumn("cosine", cosine(F.col("embedding").cast("array<double>"), F.col("_c"))).drop("_c")
