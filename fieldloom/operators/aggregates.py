"""Coverage, spread, fits, histograms and scores as combining aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_by(rows: DataFrame, key: str) -> DataFrame:
    """Rows by key; null is "unknown"."""
    return rows.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias(key)).agg(F.count("*").alias("n"))


def coverage(rows: DataFrame, key: list[str], weight: Column, flag: Column) -> DataFrame:
    """Share of the weight for which the flag holds, 3 decimals; 0 without weight."""
    whole = F.sum(weight)
    return rows.groupBy(*key).agg(F.when(whole == 0, 0.0).otherwise(F.floor(F.sum(F.when(flag, weight).otherwise(0)) / whole * 1000 + 0.5) / 1000).alias("coverage"))


def height_statistics(rows: DataFrame, key: list[str], value: str, least: int = 4) -> DataFrame:
    """65th percentile and 10-90 spread with a confidence from sample count and spread; null with fewer than `least` samples."""
    seen = rows.groupBy(*key).agg(F.count(value).alias("n"), F.percentile(value, F.array(F.lit(0.1), F.lit(0.65), F.lit(0.9))).alias("p"))
    enough = F.col("n") >= least
    height, spread = F.floor(F.col("p")[1] * 10 + 0.5) / 10, F.floor((F.col("p")[2] - F.col("p")[0]) * 10 + 0.5) / 10
    seen = seen.withColumns({"height": F.when(enough, height), "spread": F.when(enough, spread)})
    trust = 0.7 + 0.2 * F.least(F.lit(1.0), F.log2(F.col("n") + 1) / 7) + 0.1 * F.greatest(F.lit(0.0), 1 - F.col("spread") / F.greatest(F.lit(6.0), F.col("height")))
    return seen.withColumn("confidence", F.least(F.lit(0.99), F.floor(trust * 1000 + 0.5) / 1000)).drop("p")


def plane(rows: DataFrame, key: list[str], x: str, y: str, z: str) -> DataFrame:
    """Least-squares plane z = a x + b y + c per key from sums about the means; null slopes where points are in line."""
    m = rows.groupBy(*key).agg(*(F.avg(c).alias(f"m_{n}") for n, c in (("x", x), ("y", y), ("z", z))), F.count("*").alias("n"))
    d = rows.join(m, key).select(*key, "n", "m_x", "m_y", "m_z", (F.col(x) - F.col("m_x")).alias("dx"), (F.col(y) - F.col("m_y")).alias("dy"), (F.col(z) - F.col("m_z")).alias("dz"))
    s = d.groupBy(*key, "n", "m_x", "m_y", "m_z").agg(*(F.sum(F.col(f"d{p}") * F.col(f"d{q}")).alias(f"s_{p}{q}") for p, q in ("xx", "xy", "yy", "xz", "yz", "zz")))
    det = F.col("s_xx") * F.col("s_yy") - F.col("s_xy") * F.col("s_xy")
    flat = det <= 1e-9 * F.col("s_xx") * F.col("s_yy")
    s = s.withColumns({
        "a": F.when(~flat, (F.col("s_xz") * F.col("s_yy") - F.col("s_yz") * F.col("s_xy")) / det),
        "b": F.when(~flat, (F.col("s_yz") * F.col("s_xx") - F.col("s_xz") * F.col("s_xy")) / det),
    })
    explained = F.col("a") * F.col("s_xz") + F.col("b") * F.col("s_yz")
    return s.select(*key, "n", "a", "b", (F.col("m_z") - F.col("a") * F.col("m_x") - F.col("b") * F.col("m_y")).alias("c"), F.when(F.col("s_zz") > 0, explained / F.col("s_zz")).alias("r2"))


def binned(rows: DataFrame, key: list[str], value: str, width: float) -> DataFrame:
    """Bins of equal width about their centres with count and median."""
    return rows.groupBy(*key, F.floor(F.col(value) / width + 0.5).alias("bin")).agg(F.count("*").alias("n"), F.percentile(value, F.lit(0.5)).alias("median"))


def dominant(rows: DataFrame, key: list[str], value: str, rank: Column) -> DataFrame:
    """The most frequent value; of equally frequent ones that of the highest rank, then the least."""
    counted = rows.groupBy(*key, F.col(value).alias("value")).agg(F.count("*").alias("n"), F.max(rank).alias("r"))
    return counted.groupBy(*key).agg(F.max(F.struct("n", "r", F.col("value"))).alias("m")).select(*key, F.col("m.value").alias("dominant"), F.col("m.n").alias("n"))


def freshness(age_days: Column) -> Column:
    """Score of an age: unknown, up to half a year, two years, five years, older."""
    return F.when(age_days.isNull(), 0.25).when(age_days <= 180, 1.0).when(age_days <= 730, 0.75).when(age_days <= 1825, 0.5).otherwise(0.2)


#: Weights of the six components, and grades by least score.
WEIGHTS = {"boundary": 0.18, "planimetry": 0.24, "rides": 0.22, "structures": 0.16, "terrain": 0.14, "freshness": 0.06}
GRADES = (("A", 0.9), ("B", 0.8), ("C", 0.65), ("D", 0.5))


def graded(components: dict[str, Column], critical: Column) -> tuple[Column, Column]:
    """Weighted score (3 decimals) and grade; a critical gap holds the grade at B at best."""
    score = F.floor(sum((F.lit(w) * components[k] for k, w in WEIGHTS.items()), F.lit(0.0)) * 1000 + 0.5) / 1000
    grade = F.lit("E")
    for name, least in reversed(GRADES):
        grade = F.when(score >= least, name).otherwise(grade)
    return score, F.when(critical & (grade == "A"), "B").otherwise(grade)
