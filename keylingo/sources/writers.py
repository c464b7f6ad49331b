"""Sinks: corpora, models, samples, rules and privacy-safe logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def append_by_language(df: DataFrame, root: str) -> None:
    df.write.mode("append").partitionBy("lang").parquet(root)


def write_unigrams(df: DataFrame, path: str) -> None:
    """Words and counts, most frequent first, tab-separated, in a folder of each language."""
    df.select("lang", "word", "cnt").orderBy("lang", F.desc("cnt"), "word").write.option("sep", "\t").option("quote", "").partitionBy("lang").csv(path)


def write_trigram_model(trigrams: DataFrame, header: DataFrame, path: str) -> None:
    trigrams.write.partitionBy("lang").parquet(f"{path}/trigrams")
    header.write.parquet(f"{path}/header")


def trigram_json(trigrams: DataFrame, header: DataFrame) -> DataFrame:
    """(lang, model): each language's model as one JSON object of its header and a map of gram to log probability.

    Log probabilities have two places, as the models do. A language's trigrams are
    one row of it: its letters bound them.
    """
    counts = F.struct(F.col("n_gram").alias("n"), "smoothing_k", "total_count", "unique_trigrams")
    maps = trigrams.groupBy("lang").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("gram", F.round("logprob", 2).alias("logprob"))))).alias("trigrams"))
    both = header.select("lang", counts.alias("h")).join(maps, "lang", "left")
    whole = F.to_json(F.struct("lang", F.col("h.*"), F.coalesce("trigrams", F.create_map().cast("map<string,double>")).alias("trigrams")))
    return both.select("lang", whole.alias("model"))


def write_trigram_json(trigrams: DataFrame, header: DataFrame, path: str) -> None:
    """A folder of each language with its model as JSON, which ``read_trigram_json`` reads."""
    trigram_json(trigrams, header).write.partitionBy("lang").text(path)


def write_samples(df: DataFrame, path: str) -> None:
    df.select("text", "label").write.option("header", True).option("escape", '"').csv(path)


def write_rules(df: DataFrame, path: str) -> None:
    """Rules as ``read_rules`` gives them, as lines of JSON that it reads again."""
    df.select(
        "token", F.col("match_mode").alias("matchMode"), F.struct(F.col("scope").alias("type"), "app").alias("scope"),
        F.struct(F.col("action").alias("type"), F.col("lang").alias("language"), F.col("hyp").alias("hypothesis")).alias("action"), "source", "evidence",
        F.col("created").alias("createdAt"), F.col("updated").alias("updatedAt"), F.col("converted").alias("convertedText"),
    ).write.json(path)


def _shape(text: Column) -> Column:
    """The counts of a text's kinds of characters, which don't tell it."""
    return F.to_json(F.struct(*(n.cast("long").alias(name) for name, n in T.script_counts(text).items())))


def correction_log(corrections: DataFrame) -> DataFrame:
    """Corrections (ts, original, final, attempted, selected, app) with shapes in place of the texts."""
    return corrections.select("ts", _shape(F.col("original")).alias("original"), _shape(F.col("final")).alias("final"), "attempted", "selected", "app")


def write_correction_log(corrections: DataFrame, path: str) -> None:
    """Appends the log of corrections as lines of JSON; ``retain_latest`` of what is read back keeps its newest lines."""
    correction_log(corrections).write.mode("append").json(path)


def decision_log(decisions: DataFrame) -> DataFrame:
    """Decisions with the shape of their token in place of the token."""
    return decisions.select(_shape(F.col("token")).alias("shape"), "path", "lang", "confidence")


def write_decision_log(decisions: DataFrame, path: str) -> None:
    decision_log(decisions).write.mode("append").json(path)
