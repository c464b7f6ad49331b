"""Reports over decisions and their truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(expected, predicted).agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, group: str, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """Rows, right ones and their share for each group, and for all under ``*``."""
    right = F.coalesce(F.col(expected) == F.col(predicted), F.lit(False))
    out = df.rollup(group).agg(F.count("*").alias("total"), F.count_if(right).alias("ok"), F.grouping(group).alias("__all"))
    return out.select(F.when(F.col("__all") == 1, "*").otherwise(F.col(group)).alias(group), "total", "ok", (F.col("ok") / F.col("total")).alias("accuracy"))


def class_report(df: DataFrame, group: str, each: float = 0.6, overall: float = 0.8, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """``accuracy`` with the gate that holds for the row, and whether it is passed."""
    out = accuracy(df, group, expected, predicted).withColumn("gate", F.when(F.col(group) == "*", overall).otherwise(each))
    return out.withColumn("passed", F.col("accuracy") >= F.col("gate"))


def failure_samples(df: DataFrame, group: str, key: str, n: int = 12, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """The first n failing rows of each group."""
    wrong = df.where(~F.coalesce(F.col(expected) == F.col(predicted), F.lit(False)))
    return wrong.withColumn("at", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("at") <= n).withColumn("at", F.col("at").cast("long"))


def case_times(log: DataFrame, by: str, order=("ts",)) -> DataFrame:
    """A log of finished cases with seconds: how long after the case before it of the same run each one finished; null for the first."""
    before = F.lag(F.unix_micros("ts")).over(Window.partitionBy(by).orderBy(*order))
    return log.withColumn("seconds", (F.unix_micros("ts") - before) / 1e6)


def case_summary(results: DataFrame, category: str = "category", slow: float = 0.05) -> DataFrame:
    """Passed, failed and slow cases by category, and in all under ``*``."""
    out = results.rollup(category).agg(
        F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"), F.count_if(F.col("seconds") > slow).alias("n_slow"), F.grouping(category).alias("__all")
    )
    return out.select(F.when(F.col("__all") == 1, "*").otherwise(F.col(category)).alias(category), "n_passed", "n_failed", "n_slow")


def probability_drift(a: DataFrame, b: DataFrame, tolerance: float = 0.01, key: str = "id", col: str = "probs") -> DataFrame:
    """One row: the largest difference of two models' probabilities on the same inputs, the worst input, and whether it is tolerable."""
    both = a.select(key, F.col(col).alias("x")).join(b.select(key, F.col(col).alias("y")), key)
    gap = F.array_max(F.zip_with("x", "y", lambda x, y: F.abs(x - y)))
    out = both.select(key, gap.alias("gap")).agg(F.max("gap").alias("drift"), F.min_by(key, F.struct(-F.col("gap"), F.col(key))).alias("worst"), F.count("*").alias("n"))
    return out.withColumn("passed", F.col("drift") <= tolerance)
