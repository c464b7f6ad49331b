"""Queries on what the given small tables don't hold: many words, texts under few maps, long texts of few words."""

import random
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from keylingo import plans
from keylingo.functions import layouts as L
from keylingo.operators import context as K
from keylingo.operators import conversion as V
from keylingo.operators import lexical as X
from keylingo.operators import models as M
from keylingo.operators import lexical as X
from keylingo.plans import decide_queries, model_queries


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_convert_by_row_keeps_texts_where_they_are(spark):
    maps = spark.createDataFrame([("us", "x", "a", "1"), ("us", "x", "b", None), ("us", "y", "a", "ab"), ("us", "z", "a", "\0"), ("us", "z", "b", "𝄞")], "src string, dst string, src_ch string, dst_ch string")
    docs = [(1, "us", "x", "abc"), (2, "us", "y", "abca"), (3, "us", "z", "ab𝄞"), (4, "us", "none", "abc"), (5, "us", "x", None), (6, "us", "x", "")]
    made = V.convert_by_row(spark.createDataFrame(docs, "doc_id long, src string, dst string, text string"), maps)
    assert dict(made.collect()) == {1: "1bc", 2: "abbcab", 3: "\0𝄞𝄞", 4: "abc", 5: None, 6: ""}
    assert "Exchange hashpartitioning" not in plan_of(made)


def spelled(n):
    """A word of five letters for each number."""
    out = ""
    for _ in range(5):
        n, rest = divmod(n, 26)
        out += chr(97 + rest)
    return out


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """Documents of 200,300 words, each at least five times: more than the most frequent that a ranked list holds."""
    folder = tmp_path_factory.mktemp("many")
    con = duckdb.connect()
    con.create_function("spelled", spelled, ["BIGINT"], "VARCHAR")
    con.execute("CREATE TABLE words AS SELECT string_agg(spelled(i), ' ' ORDER BY i) AS text FROM range(200300) r(i)")
    con.execute(f"COPY (SELECT id AS doc_id, text, 'en' AS lang, 'a' AS source, 1::BIGINT AS n_chars FROM words, range(1, 13) v(id)) TO '{folder}/documents.parquet'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["d14_choose_variant", "j5_decode_by_lexicon", "j7_word_confidence"])
def test_lexicon_has_all_words(spark, many, name):
    folder, con = many
    df = plans.queries()[name](spark, folder)
    cursor = con.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(map(str, df.select(columns).collect())) == sorted(str(spark_row(r, columns)) for r in cursor.fetchall())


def spark_row(values, columns):
    from pyspark.sql import Row

    return Row(**dict(zip(columns, values, strict=True)))


@pytest.mark.parametrize("query", ["d3_best_correction", "d4_accept_correction"])
def test_models_have_all_words(spark, many, query):
    """Both queries score by these models."""
    pieces = decide_queries.models(spark, many[0]).pieces.where("kind = 'w'")
    assert pieces.where(F.col("en.freq").isNotNull() & (F.col("en.listed") == 1)).count() == 200_300
    assert model_queries.lexicon_of(model_queries.all_words(spark, many[0])).where("kind = 'whitelist'").count() == 200


@pytest.fixture(scope="module")
def rare(tmp_path_factory):
    """Short training documents of 200,300 words that occur once, and a frequent one."""
    folder = tmp_path_factory.mktemp("rare")
    con = duckdb.connect()
    con.create_function("spelled", spelled, ["BIGINT"], "VARCHAR")
    con.execute("CREATE TABLE ids AS SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM range(5000) r(id) WHERE substr(md5(CAST(id AS VARCHAR)), 1, 1) NOT IN ('0', '4', '8', 'c')")
    con.execute("CREATE TABLE words AS SELECT i // 100 AS n, 'often ' || string_agg(spelled(i), ' ' ORDER BY i) AS text FROM range(200300) r(i) GROUP BY ALL")
    con.execute(f"COPY (SELECT id AS doc_id, text, 'en' AS lang, 'a' AS source, 1::BIGINT AS n_chars FROM words JOIN ids USING (n)) TO '{folder}/documents.parquet'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["d3_best_correction", "d4_accept_correction"])
def test_rare_words_score_as_in_sql(spark, rare, name):
    """Tokens and readings of the last words by rank, which a lexicon of 200,000 words doesn't hold, and of the first."""
    folder, con = rare
    some = "^(zz|aa|яя|фф|זז|שש)"
    df = plans.queries()[name](spark, folder).where(F.col("token").rlike(some))
    cursor = con.execute(f"SELECT * FROM ({plans.oracle_sql()[name]}) WHERE regexp_matches(token, '{some}')")
    columns = [c[0] for c in cursor.description]
    got = sorted(map(str, df.select(columns).collect()))
    assert len(got) > 1000
    assert got == sorted(str(spark_row(r, columns)) for r in cursor.fetchall())


def test_words_are_summed_in_place_or_joined(spark, monkeypatch):
    """Words of the head and of the tail, unknown ones, keys that repeat, texts without words."""
    docs = spark.createDataFrame([(1, "the the cat xx"), (1, "the"), (2, "rare the"), (3, "..."), (4, None), (5, "xx")], "doc_id long, text string")
    words = spark.createDataFrame([("en", "the", 1.0), ("en", "cat", 0.5), ("de", "the", 0.25), ("de", "rare", 0.125)], "lang string, word string, freq_score double")
    lexicon = words.select("lang", F.lit("builtin").alias("kind"), "word").unionByName(words.where("word = 'cat'").select("lang", F.lit("own").alias("kind"), "word"))
    want = {(1, "en"): 0.7, (1, "de"): 0.15, (2, "en"): 0.5, (2, "de"): 0.1875, (5, "en"): 0.0, (5, "de"): 0.0}
    sure = {(1, "en"): 0.8, (1, "de"): 0.6, (2, "en"): 0.5, (2, "de"): 1.0, (5, "en"): 0.0, (5, "de"): 0.0}
    for head in (0, 1, 100):
        monkeypatch.setattr(X, "HEAD", head)
        assert {(r[0], r[1]): r[2] for r in X.frequency_score(docs, words, langs=("en", "de")).collect()} == want
        assert {(r[0], r[1]): r[2] for r in X.word_confidence(docs, lexicon, langs=("en", "de")).collect()} == sure
    assert "Exchange hashpartitioning(word" not in plan_of(X.frequency_score(docs, words, langs=("en", "de")))


def test_typable_layouts_go_over_a_text_once(spark):
    texts = spark.createDataFrame([("q",), ("щ",), ("q щ",), ("é",), ("—",), (None,)], "text string")
    made = V.typable_layouts(texts)
    assert {r["text"]: r["first"] for r in made.collect()} == {"q": "us", "щ": "ru", "q щ": None, "é": None, "—": "us", None: None}
    assert "split(" not in plan_of(made)


def test_two_models_from_one_pass(spark):
    docs = spark.createDataFrame([(1, "abcabd", "en"), (2, "ab", "en"), (3, "", "fr"), (4, "xyzabc äöü", "de"), (5, "abcabc", "en")], "doc_id long, text string, lang string")
    counted = M.count_trigrams_of(docs, F.col("doc_id") < 5)
    assert sorted(map(tuple, counted.select("lang", "gram", "cnt").collect())) == sorted(map(tuple, M.count_trigrams(docs).collect()))
    part = counted.where("part > 0").select("lang", "gram", F.col("part").alias("cnt"))
    assert sorted(map(tuple, part.collect())) == sorted(map(tuple, M.count_trigrams(docs.where("doc_id < 5")).collect()))
    x, y = M.smoothed(part), M.train_trigrams(docs, k=2.0)
    both = X.trigram_scores(docs, {"x": (x, M.trigram_header(x)), "y": (y, M.trigram_header(y))})
    for name, model in (("x", x), ("y", y)):
        one = X.trigram_score(docs, model, M.trigram_header(model))
        assert sorted(map(tuple, both.select("doc_id", "lang", "grams", name).collect())) == sorted(map(tuple, one.collect()))


@pytest.mark.parametrize("share", [0, 0.02, 1])
@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_segments_get_their_usual_reading_or_another(spark, share, broadcast):
    rng = random.Random(5)
    pieces = ["руддщ", "црфе", "12", "a.b", "ща", " ", "  ", "\n", "é", "ёжx", "х[", "\x0b", " й", "𝄞й"]
    texts = ["", None, " ", "руддщ", "12", " руддщ", "12 12", "руддщ ", *("".join(rng.choices(pieces, k=rng.randint(1, 25))) for _ in range(200))]
    parts = [re.findall(r"[ \t\n\x0b\f\r]+|[^ \t\n\x0b\f\r]+", text or "") for text in texts]
    typed, choices = str.maketrans(*L.pair("ru", "us")), {}
    for part in sorted({p for each in parts for p in each}):
        usual = part.translate(typed) if part.translate(typed) != part else None
        choices[part] = rng.choice([None, "", "new x", part, usual]) if rng.random() < share else usual
    docs, table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(choices.items()), "token string, chosen string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = {r["doc_id"]: (r["changed"], r["text"]) for r in K.correct_segments(docs, table, usual=("ru", "us")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = {}
    for n, each in enumerate(parts):
        changed = sum(choices[p] is not None for p in each)
        if each:
            want[n] = (changed, "".join(p if choices[p] is None else choices[p] for p in each) if changed and len(each) > 1 else None)
    assert got == want


def test_corrected_texts_stay_where_they_are(spark, tmp_path):
    """Texts that repeat few words take less disk than they are long: their distinct words travel, not the texts or their places."""
    rng, words = random.Random(3), [spelled(n * 977) for n in range(300)]
    texts = [" ".join(rng.choices([*words, "Why?", "a/b,", "12", "é"], k=5_000)) for _ in range(48)]
    rows = [(n, text, "en", "a", len(text)) for n, text in enumerate(texts)]
    folder = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(8).write.parquet(folder)
    roots = [*spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString(), spark.conf.get("spark.checkpoint.dir")]
    files = lambda: {p: p.stat().st_size for root in roots for p in Path(root).rglob("*") if p.name.startswith("shuffle_") and p.suffix == ".data" or p.suffix == ".parquet"}
    earlier = files()
    got = plans.queries()["d16_correct_segments"](spark, str(tmp_path)).collect()
    written = sum(size for p, size in files().items() if p not in earlier)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/*.parquet'")
    cursor = con.execute(plans.oracle_sql()["d16_correct_segments"])
    assert sorted(map(tuple, got)) == sorted(cursor.fetchall()) and len(got) == len(texts)
    assert written < sum(map(len, texts))
