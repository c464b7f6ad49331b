"""Readers of corpora, key tables, word lists, models, cases and rules. Every reader has an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks as S
from ..operators import cleaning as C
from .chats import read_messages

CHAT = "array<variant>"
HEADER = "lang string, n_gram bigint, smoothing_k double, total_count bigint, unique_trigrams bigint, floor double, p05 double, p50 double, p95 double, least double, most double"


def read_phrases(spark: SparkSession, path: str, lang: str, min_len: int | None = None, max_len: int | None = None) -> DataFrame:
    """(lang, text): stripped non-blank lines of text files, packed ones too; lengths strictly inside the window."""
    lines = spark.read.text(path).select(F.lit(lang).alias("lang"), T.strip(F.col("value")).alias("text")).where(F.length("text") > 0)
    if min_len is not None:
        lines = lines.where(F.length("text") > min_len)
    return lines if max_len is None else lines.where(F.length("text") < max_len)


def read_bitext(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """(lang, text): the sides of parallel files; the language is the file's last suffix, undecodable lines are skipped."""
    lines = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"\.([a-z]{2})$", 1).alias("lang"), T.strip(F.col("value")).alias("text"))
    lines = lines.where((F.col("lang") != "") & (F.length("text") > 0) & ~F.contains("text", F.lit("�")))
    if cap is None:
        return lines
    return S.numbered(lines, ("lang",), (F.asc("text"),), "__at").where(F.col("__at") <= cap).drop("__at")


def read_wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """(title, text): pages of name space 0 of an XML dump, with their revision's markup."""
    schema = "title string, ns bigint, revision struct<text:struct<_VALUE:string,_bytes:bigint>>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return pages.where("ns = 0").select("title", F.col("revision.text._VALUE").alias("text"))


def read_chat_export(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """(text variant): one row per message of exports with ``messages`` at the root or under ``chats.list``; large files are read in many tasks."""
    return read_messages(spark, path, parts).select(F.variant_get("message", "$.text", "variant").alias("text"))


def flatten_message_text(df: DataFrame, col: str = "text") -> DataFrame:
    """Message texts as strings: a string as it is, a list of strings and ``{text}`` objects joined."""
    parts = F.try_variant_get(col, "$", CHAT)
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(~F.startswith(F.to_json(p), F.lit("{")), F.try_variant_get(p, "$", "string")), F.lit(""))), "")
    plain = F.when(~F.startswith(F.to_json(F.col(col)), F.lit("[")), F.try_variant_get(col, "$", "string"))
    return df.withColumn(col, F.coalesce(joined, plain)).where(F.col(col).isNotNull())


def read_article_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("text string").json(path).where("text is not null")


def read_keymap(spark: SparkSession, path: str, escape_layouts: tuple[str, ...] = ("ru", "he")) -> DataFrame:
    """(layout_id, key, modifier, ch) from nested key -> layout -> {n, s, a, sa}; one-character outputs, no Latin letters on the Alt levels of ru and he layouts."""
    nested = spark.read.option("multiLine", True).schema("map map<string,map<string,struct<n:string,s:string,a:string,sa:string>>>").json(path)
    keys = nested.select(F.explode("map").alias("key", "by_layout")).select("key", F.explode("by_layout").alias("layout_id", "o"))
    levels = keys.select("layout_id", "key", F.expr("stack(4, 'n', o.n, 's', o.s, 'a', o.a, 'sa', o.sa) as (modifier, ch)")).where(F.length("ch") == 1)
    guarded = F.col("modifier").isin("a", "sa") & F.substring("layout_id", 1, 2).isin(*escape_layouts) & F.col("ch").rlike("[A-Za-z]")
    return levels.where(~guarded)


def read_language_data(spark: SparkSession, path: str) -> DataFrame:
    """(kind, lang, word, value) from a JSON file of language data, in lower case and once each.

    ``builtin`` and ``whitelist`` have words by language. ``preposition`` has
    one-letter tokens as word and what they stand for as value; ``conversion``
    pairs of languages as lang and value, all six pairs if the file names none;
    the kinds of punctuation have characters as word.
    """
    marks = ("opening", "closing", "wordBoundary", "sentenceEnding")
    lists = "map<string,array<string>>"
    schema = f"builtin {lists}, whitelist {lists}, prepositions map<string,string>, conversions array<struct<from:string,to:string>>, punctuation {lists}"
    data = spark.read.option("multiLine", True).schema(schema).json(path)
    none = F.lit(None).cast("string")
    words = data.select(F.expr("stack(2, 'builtin', builtin, 'whitelist', whitelist) as (kind, by_lang)")).select("kind", F.explode("by_lang").alias("lang", "words"))
    words = words.select("kind", "lang", F.explode("words").alias("word")).select("kind", "lang", F.lower("word").alias("word"), none.alias("value"))
    prepositions = data.select(F.explode("prepositions").alias("word", "value")).select(F.lit("preposition").alias("kind"), none.alias("lang"), F.lower("word").alias("word"), F.lower("value").alias("value"))
    every = F.array(*(F.struct(F.lit(a).alias("from"), F.lit(b).alias("to")) for a in ("en", "ru", "he") for b in ("en", "ru", "he") if a != b))
    pairs = data.select(F.explode(F.when(F.size("conversions") > 0, F.col("conversions")).otherwise(every)).alias("p"))
    pairs = pairs.select(F.lit("conversion").alias("kind"), F.col("p.from").alias("lang"), none.alias("word"), F.col("p.to").alias("value"))
    chars = data.select(F.explode("punctuation").alias("kind", "chars")).where(F.col("kind").isin(*marks)).select("kind", none.alias("lang"), F.explode("chars").alias("word"), none.alias("value"))
    return words.unionByName(prepositions).unionByName(pairs).unionByName(chars).distinct()


def read_unigrams(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """(lang, word, cnt, rank) from tab-separated words and counts; malformed lines are skipped and the most frequent of repeated words stays."""
    rows = spark.read.option("sep", "\t").option("mode", "DROPMALFORMED").option("quote", "").schema("word string, cnt bigint").csv(path)
    rows = rows.where("word is not null and cnt is not null").select(F.lit(lang).alias("lang"), F.lower("word").alias("word"), "cnt")
    rows = rows.groupBy("lang", "word").agg(F.max("cnt").alias("cnt"))
    return S.numbered(rows, ("lang",), (F.desc("cnt"), F.asc("word")), "rank").select("lang", "word", "cnt", "rank")


def read_trigram_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(trigrams, header) as ``write_trigram_model`` writes them; models of another size and keys of another length are refused."""
    header = spark.read.schema(HEADER).parquet(f"{path}/header").where("n_gram = 3")
    trigrams = spark.read.schema("gram string, cnt bigint, logprob double, lang string").parquet(f"{path}/trigrams").where(F.length("gram") == 3)
    return trigrams.join(header.select("lang"), "lang", "left_semi").select("lang", "gram", "cnt", "logprob"), header


def read_trigram_json(spark: SparkSession, path: str) -> DataFrame:
    """(lang, gram, logprob) from JSON with a header and a map, ``trigrams`` or ``logprobs``; other sizes and keys of another length are refused."""
    model = spark.read.option("multiLine", True).option("recursiveFileLookup", True).schema("lang string, n int, trigrams map<string,double>, logprobs map<string,double>").json(path)
    return model.where("n = 3").select("lang", F.explode(F.coalesce("trigrams", "logprobs")).alias("gram", "logprob")).where(F.length("gram") == 3)


def read_file_times(spark: SparkSession, path: str, lang: str | None = None) -> DataFrame:
    """(lang, path, changed): when each file of a corpus or model was changed last.

    The language is that of a folder lang=..., or the one that is given. Only the
    files' entries are read, not what is in them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("modificationTime").alias("changed"))
    found = F.nullif(F.regexp_extract("path", "/lang=([^/]+)/", 1), F.lit(""))
    return files.select((found if lang is None else F.lit(lang)).alias("lang"), "path", "changed")


def read_samples(spark: SparkSession, path: str, labels) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema("text string, label string").csv(path).where(F.col("label").isin(*labels))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(category, description, input, expected, desc, words, expected_final, alt_presses, expected_sequence, max_time_ms, active_layouts) from {category: {description, cases}}."""
    case = (
        "struct<input:string,expected:string,desc:string,words:array<string>,expected_final:string,alt_presses:int,expected_sequence:array<string>,max_time_ms:int,"
        "settings:struct<activeLayouts:map<string,string>>>"
    )
    data = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,struct<description:string,cases:array<{case}>>>").alias("m"))
    each = data.select(F.explode("m").alias("category", "c")).select("category", "c.description", F.explode("c.cases").alias("x")).select("category", "description", "x.*")
    return each.withColumn("active_layouts", F.col("settings.activeLayouts")).drop("settings")


RULE = (
    "token string, matchMode string, scope struct<type:string,app:string>, action struct<type:string,language:string,hypothesis:string>, source string, "
    "evidence struct<rejects:bigint,applies:bigint,overrides:bigint,timestamps:array<timestamp>>, createdAt timestamp, updatedAt timestamp, convertedText string"
)


def read_rules(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Dictionary rules of a JSON array, or of ``lines`` as ``write_rules`` writes them: token, match_mode, scope, app, action, lang, hyp, source, evidence, created, updated, converted.

    Unknown scopes are global and unknown actions keepAsIs; the match mode is
    by lower case unless it is exact, and tokens are lowered and trimmed for it.
    """
    rules = spark.read.option("multiLine", not lines).schema(RULE).json(path)
    per_app = (F.col("scope.type") == "perApp") & F.col("scope.app").isNotNull()
    action = F.when(F.col("action.type").isin("preferHypothesis", "preferLanguage", "none"), F.col("action.type")).otherwise("keepAsIs")
    exact = F.coalesce(F.col("matchMode") == "exact", F.lit(False))
    return rules.select(
        F.when(exact, F.trim("token")).otherwise(F.lower(F.trim("token"))).alias("token"), F.when(exact, "exact").otherwise("caseInsensitive").alias("match_mode"),
        F.when(per_app, "perApp").otherwise("global").alias("scope"), F.when(per_app, F.col("scope.app")).alias("app"), action.alias("action"),
        F.col("action.language").alias("lang"), F.col("action.hypothesis").alias("hyp"), "source", "evidence", F.col("createdAt").alias("created"), F.col("updatedAt").alias("updated"), F.col("convertedText").alias("converted"),
    )


def wiki_phrases(spark: SparkSession, path: str) -> DataFrame:
    """Phrases of a dump's articles, cleaned of markup."""
    return C.articles_to_phrases(read_wiki_dump(spark, path).select("title", T.strip_wiki_markup(F.col("text")).alias("text")))
