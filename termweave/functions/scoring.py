"""Scoring formulas as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def idf(n: Column, df: Column) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5)); 0 without occurrences."""
    return F.when(df > 0, F.log(1 + (n - df + 0.5) / (df + 0.5))).otherwise(0.0)


def tf_norm(tf: Column, doc_len: Column, avg_len: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """Saturated term frequency with length normalisation."""
    avg = F.when(avg_len > 0, avg_len).otherwise(1.0)
    below = tf + k1 * (1 - b + b * F.greatest(doc_len, F.lit(1)) / avg)
    return F.when(below > 0, tf * (k1 + 1) / below).otherwise(0.0)


def bm25(tf: Column, doc_len: Column, avg_len: Column, n: Column, df: Column, boost: Column | float = 1.0, k1: float = 1.2, b: float = 0.75) -> Column:
    """Score of one term; a boost counts only if positive."""
    factor = boost if isinstance(boost, Column) else F.lit(float(boost))
    return idf(n, df) * tf_norm(tf, doc_len, avg_len, k1, b) * F.when(factor > 0, factor).otherwise(1.0)


def coordination(matched: Column, total: int, weight: float = 2.0) -> Column:
    """(matched / total) ** weight; 1 for a single term."""
    return F.lit(1.0) if total <= 1 else F.pow(matched / F.lit(float(total)), F.lit(weight))


def ordering_boost(first_positions: Column, factor: float = 0.5) -> Column:
    """1 + factor * mean closeness of consecutive first positions that ascend."""
    p, n = first_positions, F.size(first_positions)
    gaps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.get(p, i) - F.get(p, i - 1))
    close = F.aggregate(gaps, F.lit(0.0), lambda s, d: s + F.when(d > 0, 1.0 / d).otherwise(0.0))
    return F.when(n > 1, 1 + factor * close / (n - 1)).otherwise(1.0)


def rrf(rank: Column, weight: float = 1.0, k: int = 60) -> Column:
    """weight / (k + rank); 0 where the list has no such row."""
    return F.coalesce(F.lit(weight) / (k + rank), F.lit(0.0))


def clamp(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def decay(distance: Column, kind: str = "log") -> Column:
    """Weight of a pair by distance (0 counts as 1): log, linear or quadratic."""
    d = F.greatest(distance, F.lit(1)).cast("double")
    return {"log": 1.0 / F.log2(1.0 + d), "linear": 1.0 / d, "quadratic": 1.0 / (d * d)}[kind]


def decay_values(window: int, kind: str = "log") -> list[float]:
    """decay() of the distances 1 to window."""
    return [{"log": 1.0 / math.log2(1.0 + d), "linear": 1.0 / d, "quadratic": 1.0 / (d * d)}[kind] for d in range(1, window + 1)]


def npmi_weight(count: Column, df_a: Column, df_b: Column, n: Column, mean: Column) -> Column:
    """Normalised pointwise mutual information times (1 + mean decay), within 0 and 1."""
    p = count / n
    value = F.log(p / ((df_a / n) * (df_b / n))) / -F.log(p) * (1 + mean)
    return F.when((count > 0) & (df_a > 0) & (df_b > 0) & (n > 0) & (count != n), clamp(value)).otherwise(0.0)


def llr(count: Column, df_a: Column, df_b: Column, n: Column) -> Column:
    """Log-likelihood ratio of the 2 x 2 table; negative cells count as 0."""
    zero = F.lit(0.0)
    k11, k12, k21 = count.cast("double"), F.greatest(df_a - count, F.lit(0)).cast("double"), F.greatest(df_b - count, F.lit(0)).cast("double")
    k22 = F.greatest(n - df_a - df_b + count, F.lit(0)).cast("double")
    rows, cols, total = [k11 + k12, k21 + k22], [k11 + k21, k12 + k22], k11 + k12 + k21 + k22
    term = lambda k, r, c: F.when((k > 0) & (r > 0) & (c > 0), k * F.log(k * total / (r * c))).otherwise(zero)
    return 2 * (term(k11, rows[0], cols[0]) + term(k12, rows[0], cols[1]) + term(k21, rows[1], cols[0]) + term(k22, rows[1], cols[1]))


def with_llr(rows: DataFrame, count: Column, df_a: Column, df_b: Column, n: Column, name: str = "llr") -> DataFrame:
    """rows with llr() as a column, in steps: as one expression it repeats its cells too often to be compiled."""
    cells = {"_k11": count.cast("double"), "_k12": F.greatest(df_a - count, F.lit(0)).cast("double"), "_k21": F.greatest(df_b - count, F.lit(0)).cast("double"), "_k22": F.greatest(n - df_a - df_b + count, F.lit(0)).cast("double")}
    x = rows.withColumns(cells)
    x = x.withColumns({"_r1": F.col("_k11") + F.col("_k12"), "_r2": F.col("_k21") + F.col("_k22"), "_c1": F.col("_k11") + F.col("_k21"), "_c2": F.col("_k12") + F.col("_k22")})
    x = x.withColumn("_all", F.col("_r1") + F.col("_r2"))

    def part(k: str) -> Column:
        k, r, c = F.col(f"_k{k}"), F.col(f"_r{k[0]}"), F.col(f"_c{k[1]}")
        return F.when((k > 0) & (r > 0) & (c > 0), k * F.log(k * F.col("_all") / (r * c))).otherwise(0.0)

    return x.withColumn(name, 2 * (part("11") + part("12") + part("21") + part("22"))).drop(*cells, "_r1", "_r2", "_c1", "_c2", "_all")


def llr_weight(count: Column, df_a: Column, df_b: Column, n: Column, mean: Column, ratio: Column | None = None) -> Column:
    """Log-likelihood by bits, times (1 + mean decay); ratio is the llr() of the row, if it is there."""
    value = (llr(count, df_a, df_b, n) if ratio is None else ratio) / (2 * n * F.log(F.lit(2.0))) * (1 + mean)
    return F.when((count > 0) & (n > 0), clamp(value)).otherwise(0.0)


def dice_weight(count: Column, df_a: Column, df_b: Column, mean: Column) -> Column:
    return F.when((count > 0) & (df_a + df_b > 0), clamp(2.0 * count / (df_a + df_b) * (1 + mean))).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in doubles; 0 if a norm is 0 or lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)
