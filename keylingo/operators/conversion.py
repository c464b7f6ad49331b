"""Conversion between layouts as jobs over text tables: variants, decoding by lexicon, what a layout can type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import layouts as L
from ..sources.scratch import kept


def convert_by_row(df: DataFrame, charmap: DataFrame, col: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text): conversion where the map of characters is a table with the rows' own (src, dst).

    ``df`` has src and dst; ``charmap`` has src, dst, src_ch and dst_ch, each
    src_ch of a pair once. A pair's map is a row of a written table, whose size
    the optimizer knows: texts stay where they are, although few pairs have all
    of them. Characters that become one character are translated in one pass;
    where some become several, each one is looked up.
    """
    found = F.filter("pairs", lambda p: (F.length(p["key"]) == 1) & p["value"].isNotNull())
    pairs = charmap.groupBy("src", "dst").agg(F.map_from_entries(F.collect_list(F.struct("src_ch", "dst_ch"))).alias("map")).withColumn("pairs", F.map_entries("map"))
    pairs = pairs.select("src", "dst", "map", F.transform(found, lambda p: F.struct(p["key"].alias("src_ch"), p["value"].alias("dst_ch"))).alias("pairs"))
    single = F.forall("pairs", lambda p: (F.length(p["dst_ch"]) == 1) & (p["dst_ch"] != "\0"))  # to the null character means to nothing in ``translate``
    sides = [F.array_join(F.col("pairs")[c], "").alias(f"{c}s") for c in ("src_ch", "dst_ch")]
    joined = df.join(kept(pairs.select("src", "dst", "map", single.alias("single"), *sides), "charmaps"), ["src", "dst"], "left")
    each = F.transform(F.split(F.col(col), ""), lambda c: F.coalesce(F.element_at("map", c), c))
    made = F.when(F.col("single"), F.call_function("translate", F.col(col), F.col("src_chs"), F.col("dst_chs"))).when(F.col("map").isNotNull(), F.array_join(each, "")).otherwise(F.col(col))
    return joined.select(key, made.alias(col))


def convert_variants(df: DataFrame, sources, targets, col: str = "text") -> DataFrame:
    """Every reading of a text from source layouts to target layouts: the row, src, dst, result, priority.

    Readings equal to the text are dropped, and of equal results of a text the
    first stays. The first of each list is the active layout.
    """
    options = [F.struct(F.lit(s).alias("src"), F.lit(t).alias("dst"), F.lit(n).alias("priority"), L.convert(F.col(col), s, t).alias("result")) for n, (s, t) in enumerate((s, t) for s in sources for t in targets)]
    every = df.select("*", F.explode(F.array(*options)).alias("o")).select("*", "o.*").drop("o").where(F.col("result") != F.col(col))
    first = Window.partitionBy(*df.columns, "result").orderBy("priority")
    return every.withColumn("__at", F.row_number().over(first)).where("__at = 1").drop("__at")


def convert_source_variants(df: DataFrame, sources, target: str, col: str = "text") -> DataFrame:
    """Readings from every source layout to one target; unchanged ones dropped, equal ones kept."""
    options = [F.struct(F.lit(s).alias("src"), L.convert(F.col(col), s, target).alias("result")) for s in sources]
    return df.select("*", F.explode(F.array(*options)).alias("o")).select("*", "o.*").drop("o").where(F.col("result") != F.col(col))


def decode_by_lexicon(typed: DataFrame, words: DataFrame, src: str, dst: str, col: str = "token") -> DataFrame:
    """(token, word, decoded): the best word whose keys give the token, else the plain conversion.

    The lexicon (word, freq_score) is typed forwards once and joined by typed
    form, so ambiguous layouts need no search. Words rank by frequency, then by name.
    """
    forms = words.select(L.convert(F.col("word"), dst, src).alias("form"), "word", "freq_score")
    best = forms.groupBy("form").agg(F.max_by("word", F.struct("freq_score", F.col("word"))).alias("word"))
    out = typed.join(best, F.lower(F.col(col)) == F.col("form"), "left").drop("form")
    return out.withColumn("decoded", F.coalesce("word", L.convert(F.col(col), src, dst)))


def typable_layouts(df: DataFrame, layouts=tuple(x[0] for x in L.LAYOUTS), col: str = "text") -> DataFrame:
    """``df`` with the layouts that produce all of the text's ASCII and letter characters, and the first of them.

    Characters that are neither are tolerated; a text in ASCII alone means ``us``.
    """
    needed = F.regexp_replace(F.col(col), r"[^\x21-\x7E\p{L}]", "")
    able = [F.when(F.translate(needed, "".join(sorted(set("".join(L.KEYS[x])))), "") == "", F.lit(x)) for x in layouts]
    found = F.array_compact(F.array(*able))
    plain = ~F.col(col).rlike(r"[^\x00-\x7F]")
    return df.withColumn("layouts", F.array_join(found, ",")).withColumn("first", F.when(plain, "us").otherwise(F.get(found, F.lit(0))))


def recovery_rate(words: DataFrame, pairs, col: str = "word") -> DataFrame:
    """(combo, total, ok): words that come back when typed on another layout and converted again."""
    each = [words.select(F.lit(f"{a}->{b}").alias("combo"), (L.convert(L.convert(F.col(col), a, b), b, a) == F.col(col)).alias("ok")) for a, b in pairs]
    return reduce(DataFrame.unionByName, each).groupBy("combo").agg(F.count("*").alias("total"), F.count_if("ok").alias("ok"))


def preferred_layouts(installed: DataFrame, layouts: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, lang, layouts): per language all installed layouts that are known, each once, by prior from the highest, ties by name."""
    known = installed.select(key, "layout_id").distinct().join(layouts, "layout_id")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("prior")).alias("less"), "layout_id")))  # the known layouts bound it
    return known.groupBy(key, "lang").agg(F.transform(ordered, lambda x: x["layout_id"]).alias("layouts"))


def preferred_layout(installed: DataFrame, layouts: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, lang, layout_id): per language the installed layout with the highest prior, ties by name."""
    return installed.join(layouts, "layout_id").groupBy(key, "lang").agg(F.max_by("layout_id", F.struct("prior", F.col("layout_id"))).alias("layout_id"))
