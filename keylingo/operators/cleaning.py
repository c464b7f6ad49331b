"""Cleaning and tokenising of text tables: each takes and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def phrases(df: DataFrame, col: str = "text", min_len: int | None = None, max_len: int | None = None) -> DataFrame:
    """One row per non-blank line: the other columns, line_no from 1, and the stripped line as ``col``; lengths strictly inside the window."""
    lines = df.select(*[c for c in df.columns if c != col], F.posexplode(F.split(F.col(col), "\n")).alias("line_no", col))
    lines = lines.withColumn("line_no", (F.col("line_no") + 1).cast("long")).withColumn(col, T.strip(F.col(col))).where(F.length(col) > 0)
    if min_len is not None:
        lines = lines.where(F.length(col) > min_len)
    return lines if max_len is None else lines.where(F.length(col) < max_len)


def articles_to_phrases(df: DataFrame, col: str = "text", min_article: int = 100, min_phrase: int = 10) -> DataFrame:
    """Pieces between ``". "`` of articles over a length, themselves over a length, stripped."""
    pieces = df.where(F.length(col) > min_article)
    pieces = pieces.select(*[c for c in df.columns if c != col], F.posexplode(F.split(F.col(col), r"\. ")).alias("piece_no", col))
    return pieces.where(F.length(col) > min_phrase).withColumn(col, T.strip(F.col(col))).withColumn("piece_no", (F.col("piece_no") + 1).cast("long"))


def clean_messages(df: DataFrame, col: str = "text", min_len: int = 2) -> DataFrame:
    """Messages with white space collapsed, longer than ``min_len``."""
    return df.withColumn(col, T.collapse(T.strip(F.col(col)))).where(F.length(col) > min_len)


def exploded(df: DataFrame, pieces, name: str) -> DataFrame:
    """A row per element of an array expression, with its place from 1."""
    return df.select("*", F.posexplode(pieces).alias("pos", name)).withColumn("pos", (F.col("pos") + 1).cast("long"))


def explode_words(df: DataFrame, lang: str, col: str = "text", min_len: int = 2) -> DataFrame:
    return exploded(df, T.words(F.col(col), lang, min_len), "word")


def explode_letter_words(df: DataFrame, col: str = "text") -> DataFrame:
    return exploded(df, T.letter_words(F.col(col)), "word")


def explode_segments(df: DataFrame, col: str = "text") -> DataFrame:
    return exploded(df, T.segments(F.col(col)), "segment")


def explode_runs(df: DataFrame, col: str = "text") -> DataFrame:
    return exploded(df, T.runs(F.col(col)), "run")


def explode_trigrams(df: DataFrame, col: str = "text") -> DataFrame:
    return df.select("*", F.explode(T.trigrams(F.col(col))).alias("gram"))


def audit_garbage(df: DataFrame, label: str, col: str = "text") -> DataFrame:
    """Rows and rows with control characters or the not sign, for each label."""
    return df.groupBy(label).agg(F.count("*").alias("n"), F.count_if(T.has_garbage(F.col(col))).alias("garbage"))


def search_history(df: DataFrame, wanted: str, col: str = "text", newest=("conv_id", "turn")) -> DataFrame:
    """Rows whose text holds the wanted one in any case, newest first."""
    return df.where(F.contains(F.lower(col), F.lit(wanted.lower()))).orderBy(*(F.desc(c) for c in newest))


def cap_per_language(df: DataFrame, n: int, lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """At most n rows of each language, by key."""
    from pyspark.sql import Window

    return df.withColumn("__at", F.row_number().over(Window.partitionBy(lang).orderBy(key))).where(F.col("__at") <= n).drop("__at")


def merge_corpus(main: DataFrame, addition: DataFrame) -> DataFrame:
    """``main`` and the rows of ``addition`` that it doesn't hold: running it twice changes nothing.

    Rows are the same by source, line number and text; the text's digest is the join key.
    """
    keyed = addition.withColumn("__key", F.md5(F.col("text").cast("binary")))
    held = main.select("source", "line_no", F.md5(F.col("text").cast("binary")).alias("__key"))
    return main.unionByName(keyed.join(held, ["source", "line_no", "__key"], "left_anti").select(*main.columns))
