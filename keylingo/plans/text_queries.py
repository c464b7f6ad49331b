"""Queries of the cleaning and tokenising operators, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BOUNDARY, EXTENSIONS, LEADING, LETTERS, SCRIPTS
from ..functions import text as T
from ..operators import cleaning as C
from .common import DOCS, TYPED, documents, table, typed_documents

LANGS = ("en", "fr", "de", "es")


def _digest(df: DataFrame, key: str, pieces) -> DataFrame:
    """(key, n, digest) of an array of pieces per row."""
    return df.select(key, F.size(pieces).cast("long").alias("n"), F.md5(F.array_join(pieces, "|").cast("binary")).alias("digest"))


def s1_read_phrases(spark, d):
    return C.phrases(documents(spark, d).select("doc_id", "text"), min_len=3, max_len=200)


def p1_strip_wiki_markup(spark, d):
    clean = T.strip_wiki_markup(F.col("html"))
    return table(spark, d, "pages").where("html is not null").select("page_id", F.length(clean).cast("long").alias("n_chars"), F.md5(clean.cast("binary")).alias("digest"))


def p2_articles_to_phrases(spark, d):
    return C.articles_to_phrases(documents(spark, d).select("doc_id", "text"))


def p3_clean_messages(spark, d):
    return C.clean_messages(table(spark, d, "conversations").select("conv_id", "turn", "text"))


def p5_normalize_letters(spark, d):
    text = T.normalize_by_language(F.col("text"), F.col("lang"), LANGS)
    return documents(spark, d).select("doc_id", F.length(text).cast("long").alias("n_chars"), F.md5(text.cast("binary")).alias("digest"))


def p6_explode_words(spark, d):
    docs = documents(spark, d)
    each = [C.explode_words(docs.where(F.col("lang") == x).select("lang", "doc_id", "text"), x) for x in LANGS]
    return reduce(DataFrame.unionByName, each).groupBy("lang", "word").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.sum("pos").alias("places"))


def p7_explode_letter_words(spark, d):
    words = C.explode_letter_words(typed_documents(spark, d).select("doc_id", "layout", "text"))
    return words.groupBy("layout", "word").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))


def p8_explode_segments(spark, d):
    return _digest(documents(spark, d), "doc_id", T.segments(F.col("text")))


def p9_explode_runs(spark, d):
    return _digest(documents(spark, d), "doc_id", T.runs(F.col("text")))


def p10_split_token_edges(spark, d):
    tokens = documents(spark, d).select(F.explode(F.filter(T.segments(F.col("text")), lambda s: F.length(T.strip(s)) > 0)).alias("raw")).distinct()
    return tokens.select("raw", T.token_edges(F.col("raw")).alias("e")).select("raw", "e.leading", "e.token", "e.trailing")


def p11_script_profile(spark, d):
    return typed_documents(spark, d).select("doc_id", *(n.cast("long").alias(name) for name, n in T.script_counts(F.col("text")).items()))


def p12_dominant_script(spark, d):
    return typed_documents(spark, d).select("doc_id", T.dominant_script(F.col("text")).alias("script"))


def p13_charset_match(spark, d):
    return typed_documents(spark, d).select("doc_id", *(T.charset_match(F.col("text"), x).alias(x) for x in ("en", "ru", "he")))


def p14_majority_language(spark, d):
    return typed_documents(spark, d).select("doc_id", T.majority_language(F.col("text")).alias("language"))


def p15_flag_mixed_script(spark, d):
    return typed_documents(spark, d).select("doc_id", T.mixed_script(F.col("text")).alias("keep_as"))


def p16_flag_technical(spark, d):
    tokens = documents(spark, d).select(F.explode(F.split("text", f"{T.SPACE}+")).alias("token"))
    urls = table(spark, d, "pages").select(F.explode(F.split(F.regexp_replace("url", "^[a-z]+:/", ""), "(?=/)")).alias("token"))
    tokens = tokens.unionByName(urls).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))
    return tokens.withColumn("kind", T.technical_kind(F.col("token"))).where("kind is not null")


def p17_flag_word_script(spark, d):
    words = C.explode_letter_words(typed_documents(spark, d).select("text")).select("word").distinct()
    return words.select("word", *(T.word_in_script(F.col("word"), x).alias(x) for x in ("en", "ru", "he")))


def p18_drop_control_chars(spark, d):
    clean = T.drop_control(F.col("html"))
    return table(spark, d, "pages").where("html is not null").select("page_id", F.length(clean).cast("long").alias("n_chars"), F.md5(clean.cast("binary")).alias("digest"))


def p19_audit_garbage(spark, d):
    return C.audit_garbage(typed_documents(spark, d), "layout")


def p20_explode_trigrams(spark, d):
    text = T.normalize_by_language(F.col("text"), F.col("lang"), LANGS)
    return C.explode_trigrams(documents(spark, d).select("lang", text.alias("text"))).groupBy("lang", "gram").agg(F.count("*").alias("n"))


def p22_search_history(spark, d):
    return C.search_history(table(spark, d, "conversations").select("conv_id", "turn", "text"), "the")


def w7_cap_per_language(spark, d):
    return C.cap_per_language(documents(spark, d).select("doc_id", "lang"), 50)


def w8_union_sources(spark, d):
    docs = documents(spark, d).select(F.lit("articles").alias("corpus"), "text")
    chat = C.clean_messages(table(spark, d, "conversations").select(F.lit("chat").alias("corpus"), "text"))
    return C.phrases(docs.unionByName(chat)).groupBy("corpus", "text").agg(F.count("*").alias("n"))


def s16_merge_corpus(spark, d):
    """The documents' lines, and the conversations' and the documents' once more: only what is new is added, however often."""
    main = C.phrases(documents(spark, d).select("source", "text"))
    chat = C.phrases(table(spark, d, "conversations").select(F.col("role").alias("source"), "text"))
    more = chat.unionByName(main).select("source", "line_no", "text").distinct()
    merged = C.merge_corpus(C.merge_corpus(main.select("source", "line_no", "text"), more), more)
    return merged.groupBy("source", "line_no").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


QUERIES = {f.__name__: f for f in (
    s1_read_phrases, p1_strip_wiki_markup, p2_articles_to_phrases, p3_clean_messages, p5_normalize_letters, p6_explode_words, p7_explode_letter_words,
    p8_explode_segments, p9_explode_runs, p10_split_token_edges, p11_script_profile, p12_dominant_script, p13_charset_match, p14_majority_language,
    p15_flag_mixed_script, p16_flag_technical, p17_flag_word_script, p18_drop_control_chars, p19_audit_garbage, p20_explode_trigrams, p22_search_history,
    w7_cap_per_language, w8_union_sources, s16_merge_corpus)}

S = r"[ \t\n\x0B\f\r]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '{S}+', ' ', 'g')"


def normal(x: str) -> str:
    cases = " ".join(f"WHEN '{one}' THEN regexp_replace(lower({x}), '[^{LETTERS[one]}]', '', 'g')" for one in LANGS)
    return f"CASE lang {cases} END"


def grams(x: str) -> str:
    return f"unnest(list_transform(range(1, length({x}) - 1), lambda i: substr({x}, i, 3)))"


def count_of(chars: str) -> str:
    return f"(length(text) - length(regexp_replace(text, '[{chars}]', '', 'g')))"


LINES = f"lines AS (SELECT * EXCLUDE (raw), {strip('raw')} AS line FROM (SELECT * EXCLUDE (text), unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM docs))"
PROFILE = f"""{TYPED}, counts AS (
  SELECT *, {count_of(SCRIPTS['en'])} AS latin, {count_of(SCRIPTS['ru'])} AS cyrillic, {count_of(SCRIPTS['he'])} AS hebrew,
         {count_of('0-9')} AS digits, {count_of(S[1:-1])} AS spaces, length(text) AS total FROM typed)"""
ENDS = T._class(BOUNDARY + ",;").replace('"', '"')
_P10 = f"regexp_extract(raw, '^[{T._class(LEADING)}]*')"

MARKUP = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)\{\{.*?\}\}', '', 'g'), '\[\[(?:[^|\]]*\|)?([^\]]+)\]\]', '\1', 'g'), '={2,}.*?={2,}', '', 'g'), '<[^>]+>', '', 'g')"

SQL = {
    "s1_read_phrases": f"WITH {DOCS}, {LINES} SELECT doc_id, line_no, line AS text FROM lines WHERE length(line) > 3 AND length(line) < 200",
    "p1_strip_wiki_markup": f"""WITH c AS (SELECT page_id, {strip(collapse(MARKUP))} AS t FROM pages WHERE html IS NOT NULL)
        SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM c""",
    "p2_articles_to_phrases": f"""WITH {DOCS}, p AS (SELECT doc_id, unnest(string_split(text, '. ')) AS piece, unnest(range(1, len(string_split(text, '. ')) + 1)) AS piece_no FROM docs WHERE length(text) > 100)
        SELECT doc_id, piece_no, {strip('piece')} AS text FROM p WHERE length(piece) > 10""",
    "p3_clean_messages": f"WITH c AS (SELECT conv_id, turn, {collapse(strip('text'))} AS text FROM conversations) SELECT * FROM c WHERE length(text) > 2",
    "p5_normalize_letters": f"WITH {DOCS}, n AS (SELECT doc_id, {normal('text')} AS t FROM docs) SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM n",
    "p6_explode_words": f"""WITH {DOCS}, a AS (SELECT lang, doc_id, regexp_extract_all(lower(text), CASE lang {' '.join(f"WHEN '{x}' THEN '[{LETTERS[x]}]{{2,}}'" for x in LANGS)} END) AS w FROM docs),
        e AS (SELECT lang, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM a) SELECT lang, word, count(*) AS n, count(DISTINCT doc_id) AS docs, CAST(sum(pos) AS BIGINT) AS places FROM e GROUP BY lang, word""",
    "p7_explode_letter_words": rf"""WITH {TYPED}, a AS (SELECT layout, regexp_extract_all(lower(text), '\p{{L}}+') AS w FROM typed),
        e AS (SELECT layout, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM a) SELECT layout, word, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places FROM e GROUP BY layout, word""",
    "p8_explode_segments": rf"WITH {DOCS}, a AS (SELECT doc_id, regexp_extract_all(text, '{S}+|[^ \t\n\x0B\f\r]+') AS w FROM docs) SELECT doc_id, len(w) AS n, md5(array_to_string(w, '|')) AS digest FROM a",
    "p9_explode_runs": rf"WITH {DOCS}, a AS (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+') AS w FROM docs) SELECT doc_id, len(w) AS n, md5(array_to_string(w, '|')) AS digest FROM a",
    "p10_split_token_edges": rf"""WITH {DOCS}, r AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS raw FROM docs),
        l AS (SELECT raw, {_P10} AS "leading", substr(raw, length({_P10}) + 1) AS rest FROM r),
        t AS (SELECT *, regexp_extract(rest, '(?s)^(.*(?:\p{{L}}[.,]|[^{ENDS}]))[{ENDS}]*$', 1) AS token FROM l)
        SELECT raw, "leading", token, substr(rest, length(token) + 1) AS "trailing" FROM t""",
    "p11_script_profile": f"WITH {PROFILE} SELECT doc_id, latin, cyrillic, hebrew, digits, spaces, total - latin - cyrillic - hebrew - digits - spaces AS other, total FROM counts",
    "p12_dominant_script": f"""WITH {PROFILE} SELECT doc_id, CASE WHEN latin + cyrillic + hebrew = 0 THEN NULL WHEN latin >= (latin + cyrillic + hebrew) * 0.85 THEN 'en'
        WHEN cyrillic >= (latin + cyrillic + hebrew) * 0.85 THEN 'ru' WHEN hebrew >= (latin + cyrillic + hebrew) * 0.85 THEN 'he' END AS script FROM counts""",
    "p13_charset_match": f"WITH {PROFILE} SELECT doc_id, total > 0 AND latin > total * 0.7 AS en, total > 0 AND cyrillic > total * 0.7 AS ru, total > 0 AND hebrew > total * 0.7 AS he FROM counts",
    "p14_majority_language": f"""WITH {TYPED}, low AS (SELECT doc_id, lower(text) AS text FROM typed), n AS (SELECT doc_id, {count_of(LETTERS['ru'])} AS ru, {count_of(LETTERS['he'])} AS he, {count_of(LETTERS['en'])} AS en FROM low)
        SELECT doc_id, CASE WHEN ru > en AND ru > he THEN 'ru' WHEN he > en AND he > ru THEN 'he' WHEN en > ru AND en > he THEN 'en' END AS language FROM n""",
    "p15_flag_mixed_script": f"""WITH {PROFILE} SELECT doc_id, CASE WHEN CAST(latin > 0 AS INT) + CAST(cyrillic > 0 AS INT) + CAST(hebrew > 0 AS INT) >= 2 THEN
        CASE WHEN cyrillic = greatest(latin, cyrillic, hebrew) THEN 'ru' WHEN hebrew = greatest(latin, cyrillic, hebrew) THEN 'he' ELSE 'en' END END AS keep_as FROM counts""",
    "p16_flag_technical": rf"""WITH {DOCS}, t AS (SELECT unnest(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS token FROM docs UNION ALL
          SELECT unnest(regexp_extract_all(regexp_replace(url, '^[a-z]+:/', ''), '/[^/]*|^[^/]+')) FROM pages), g AS (SELECT token, count(*) AS n FROM t WHERE token <> '' GROUP BY token),
        k AS (SELECT *, CASE WHEN starts_with(token, '/') THEN 'path' WHEN regexp_matches(token, '^\p{{L}}:[\\/]') THEN 'windows_path'
          WHEN regexp_matches(lower(token), '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') THEN 'uuid'
          WHEN regexp_matches(token, '^[vV]?[0-9]+(\.[0-9]+){{1,3}}$') THEN 'version'
          WHEN regexp_matches(token, '^[0-9:+/%.,-]+$') AND regexp_matches(token, '[0-9]') AND regexp_matches(token, '[^0-9]') THEN 'number'
          WHEN lower(regexp_extract(token, '^[^/\\]+\.([\p{{L}}\p{{N}}]{{1,8}})$', 1)) IN ({', '.join(f"'{x}'" for x in EXTENSIONS)}) AND regexp_matches(regexp_extract(token, '^(.+)\.[^.]*$', 1), '\p{{L}}') THEN 'file' END AS kind FROM g)
        SELECT * FROM k WHERE kind IS NOT NULL""",
    "p17_flag_word_script": rf"""WITH {TYPED}, w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS word FROM typed)
        SELECT word, regexp_matches(word, '^[{SCRIPTS['en']}]+$') AS en, regexp_matches(word, '^[{SCRIPTS['ru']}]+$') AS ru, regexp_matches(word, '^[{SCRIPTS['he']}]+$') AS he FROM w""",
    "p18_drop_control_chars": r"WITH c AS (SELECT page_id, regexp_replace(html, '[^\p{L}\p{N}\p{P}\p{S} \n\r\t]', '', 'g') AS t FROM pages WHERE html IS NOT NULL) SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM c",
    "p19_audit_garbage": rf"WITH {TYPED} SELECT layout, count(*) AS n, count(*) FILTER (regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F¬]')) AS garbage FROM typed GROUP BY layout",
    "p20_explode_trigrams": f"WITH {DOCS}, n AS (SELECT lang, {normal('text')} AS t FROM docs), g AS (SELECT lang, {grams('t')} AS gram FROM n WHERE length(t) >= 3) SELECT lang, gram, count(*) AS n FROM g GROUP BY lang, gram",
    "p22_search_history": "SELECT conv_id, turn, text FROM conversations WHERE contains(lower(text), 'the') ORDER BY conv_id DESC, turn DESC",
    "w7_cap_per_language": f"WITH {DOCS} SELECT doc_id, lang FROM docs QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 50",
    "w8_union_sources": f"""WITH docs AS (SELECT 'articles' AS corpus, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'chat', t FROM (SELECT {collapse(strip('text'))} AS t FROM conversations) WHERE length(t) > 2), {LINES}
        SELECT corpus, line AS text, count(*) AS n FROM lines WHERE length(line) > 0 GROUP BY corpus, line""",
    "s16_merge_corpus": f"""WITH docs AS (SELECT 0 AS own, source, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 1, role, text FROM conversations WHERE text IS NOT NULL), {LINES},
        m AS (SELECT source, line_no, line FROM lines WHERE own = 0 AND length(line) > 0 UNION ALL SELECT * FROM (SELECT DISTINCT source, line_no, line FROM lines WHERE own = 1 AND length(line) > 0) ANTI JOIN (SELECT * FROM lines WHERE own = 0) USING (source, line_no, line))
        SELECT source, line_no, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM m GROUP BY source, line_no""",
}
