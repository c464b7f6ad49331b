"""What the registered queries share: tables, and inputs that Spark derives from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import layouts as L


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where its scan has fewer tasks than that; a large table's scan has more and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a text; a null text is no text to any of the operators."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").where("text is not null"))


def held_out() -> Column:
    """One document in four, by the digest of its id; DuckDB computes the same."""
    return F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1).isin("0", "4", "8", "c")


def typed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, layout, text): documents as their keys give them on three layouts in turn."""
    docs = documents(spark, sf_dir)
    layout = F.element_at(F.array(F.lit("us"), F.lit("ru"), F.lit("he")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    typed = F.when(F.pmod("doc_id", F.lit(3)) == 1, L.convert(F.lower("text"), "us", "ru")).when(F.pmod("doc_id", F.lit(3)) == 2, L.convert(F.lower("text"), "us", "he")).otherwise(F.col("text"))
    return docs.select("doc_id", "lang", layout.alias("layout"), typed.alias("text"))


def sql_pair(src: str, dst: str) -> tuple[str, str]:
    """``L.pair`` quoted for SQL."""
    return tuple(x.replace("'", "''") for x in L.pair(src, dst))


def sql_translate(expr: str, src: str, dst: str) -> str:
    a, b = sql_pair(src, dst)
    return f"translate({expr}, '{a}', '{b}')"


#: SQL of ``documents`` and ``typed_documents``.
DOCS = "docs AS (SELECT doc_id, text, lang, source FROM documents WHERE text IS NOT NULL)"
TYPED = f"""{DOCS}, typed AS (
  SELECT doc_id, lang, CASE doc_id % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'ru' ELSE 'he' END AS layout,
         CASE doc_id % 3 WHEN 1 THEN {sql_translate('lower(text)', 'us', 'ru')} WHEN 2 THEN {sql_translate('lower(text)', 'us', 'he')} ELSE text END AS text
  FROM docs)"""
HELD = "substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) IN ('0', '4', '8', 'c')"
