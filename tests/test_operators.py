"""Goldens and invariants of operators whose inputs the given tables don't hold."""

import bz2
import json
import os
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keylingo.functions import layouts as L
from keylingo.functions import text as T
from keylingo.operators import conversion as V
from keylingo.operators import decide as D
from keylingo.operators import feedback as B
from keylingo.operators import models as M
from keylingo.operators import samples as P
from keylingo.sources import readers as R
from keylingo.sources import writers as W


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("v")).first()["v"]


def test_conversion_goldens_and_round_trip(spark):
    assert one(spark, "ghbdtn", lambda t: L.convert(t, "us", "ru")) == "привет"
    assert one(spark, "GHBDTN", lambda t: L.convert(t, "us", "ru")) == "ПРИВЕТ"
    assert one(spark, "руддщ", lambda t: L.convert(t, "ru", "us")) == "hello"
    assert one(spark, "1!?(a)", lambda t: L.convert(t, "us", "ru")) == "1!?(ф)"
    assert one(spark, "akuo", lambda t: L.convert(t, "us", "he")) == "שלום"
    words = spark.createDataFrame([("the",), ("it's",), ("end.",)], "word string")
    assert V.recovery_rate(words, (("us", "ru"),)).first().asDict() == {"combo": "us->ru", "total": 3, "ok": 3}


def test_composed_map_equals_pair(spark):
    for dst in ("ru", "he", "ru_phonetic"):
        made = {r["src_ch"]: r["dst_ch"] for r in L.compose_charmap(L.keymap(spark), "us", dst).collect()}
        for a, b in zip(*L.pair("us", dst), strict=True):
            assert made[a] == b


def test_ambiguous_layouts(spark):
    assert {r["layout_id"] for r in M.ambiguous_layouts(L.keymap(spark)).collect()} == {"he_qwerty"}


def test_token_edges(spark):
    cases = {"(word.": ("(", "word.", ""), "word.)": ("", "word.", ")"), "word..": ("", "word.", "."), "«да»,": ("«", "да", "»,"), "...": ("", "", "..."), "": ("", "", "")}
    for raw, want in cases.items():
        assert tuple(one(spark, raw, T.token_edges)) == want, raw


def test_scripts_and_technical_tokens(spark):
    assert one(spark, "привет", T.dominant_script) == "ru"
    assert one(spark, "123", T.dominant_script) is None
    assert one(spark, "abвг", T.mixed_script) == "ru"
    kinds = {"/usr/bin": "path", "C:\\x": "windows_path", "v1.2.3": "version", "15:00": "number", "a.json": "file", "12345": None, "epyf.n": None, "123e4567-e89b-12d3-a456-426614174000": "uuid"}
    for token, kind in kinds.items():
        assert one(spark, token, T.technical_kind) == kind, token


def test_segments_and_runs_are_lossless(spark):
    text = " a, b\tc—d\n"
    for f in (T.segments, T.runs):
        assert "".join(one(spark, text, f)) == text


def test_cascade_on_russian_and_english_words(spark):
    words = [("en", w, c) for w, c in (("hello", 50), ("world", 40), ("the", 90))] + [("ru", w, c) for w, c in (("привет", 50), ("мир", 40), ("это", 90))]
    phrases = spark.createDataFrame([(lang, " ".join([w] * c)) for lang, w, c in words], "lang string, text string")
    unigrams = M.train_unigrams(phrases, langs=("en", "ru"))
    grams = M.train_trigrams(phrases, langs=("en", "ru"))
    lexicon = unigrams.select("lang", F.lit("builtin").alias("kind"), "word")
    models = D.Models.of(lexicon, M.unigram_scores(unigrams), grams, M.trigram_header(grams))
    tokens = spark.createDataFrame([("ghbdtn",), ("руддщ",), ("hello",), ("привет",), ("v1.2",), ("rule",)], "token string")
    rules = spark.createDataFrame([("rule", "keepAsIs", "ru_from_en")], "token string, action string, hyp string")
    got = {r["token"]: (r["path"], r["output"]) for r in D.apply_decision(D.route(tokens, models, rules)).collect()}
    assert got["ghbdtn"] == ("scored", "привет")
    assert got["руддщ"] == ("scored", "hello")
    assert got["hello"][1] == "hello" and got["привет"] == ("russian", "привет")
    assert got["v1.2"] == ("technical", "v1.2") and got["rule"] == ("rule_keep", "rule")


FIXTURES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")
LANGS = ("en", "ru", "he")


@pytest.fixture(scope="module")
def phrases(spark):
    return reduce(DataFrame.unionByName, [R.read_phrases(spark, f"{FIXTURES}/phrases_{x}.txt", x) for x in LANGS])


@pytest.fixture(scope="module")
def models(spark, phrases, tmp_path_factory):
    unigrams, grams = M.train_unigrams(phrases, langs=LANGS), M.train_trigrams(phrases, langs=LANGS)
    listed = spark.createDataFrame([("en", "whitelist", "lol"), ("en", "whitelist", "of"), ("ru", "whitelist", "ок")], "lang string, kind string, word string")
    lexicon = unigrams.where("length(word) >= 3").select("lang", F.lit("builtin").alias("kind"), "word").unionByName(listed)
    return D.Models.of(lexicon, M.unigram_scores(unigrams), grams, M.trigram_header(grams)).kept(str(tmp_path_factory.mktemp("models") / "m"))


def test_cascade_on_three_languages(spark, models):
    """What a reader of the three languages expects, and the stage that gives it."""
    want = {
        "ghbdtn": ("scored", "привет"), "Ghbdtn": ("scored", "Привет"), "hf,jnf": ("scored", "работа"), "rfr": ("scored", "как"), "uekzkb": ("scored", "гуляли"), "руддщ": ("scored", "hello"),
        "цщкдв": ("scored", "world"), "akuo": ("scored", "שלום"), "vnurv": ("scored", "המורה"), "יקךךם": ("scored", "hello"), "r": ("heuristic", "к"), "j": ("heuristic", "о"),
        "привет": ("russian", "привет"), "книга": ("russian", "книга"), "שלום": ("standard", "שלום"), "hello": ("standard", "hello"), "дом": ("standard", "дом"), "к": ("fallback", "к"), "12": ("fallback", "12"),
        "abмир": ("mixed", "abмир"), "v1.2": ("technical", "v1.2"), "a.json": ("technical", "a.json"), "lol": ("whitelist", "lol"), "of": ("rule_keep", "of"), "vs": ("rule_prefer", "мы"), "qwzxv": ("model", "qwzxv"),
    }
    tokens = spark.createDataFrame([(t,) for t in (*want, None, "hello")], "token string")
    rules = spark.createDataFrame([("of", "keepAsIs", None), ("vs", "preferHypothesis", "ru_from_en"), ("lol", "none", None), ("12", "preferHypothesis", "en_from_ru"), (None, "keepAsIs", None)], "token string, action string, hyp string")
    predicted = spark.createDataFrame([("qwzxv", "en", 0.99), ("дом", "en_from_he", 0.9), ("к", "en_from_he", 0.9)], "token string, predicted string, confidence double")
    routed = D.apply_decision(D.route(tokens, models, rules, predictions=predicted)).collect()
    assert {r["token"]: (r["path"], r["output"]) for r in routed} == want and len(routed) == len(want)
    by_hand = {r["token"]: r["path"] for r in D.route(tokens, models, rules, predictions=predicted, automatic=False).collect()}
    assert by_hand["of"] == "whitelist" and by_hand["a.json"] == "standard" and by_hand["книга"] == "standard" and by_hand["vs"] == "rule_prefer"
    assert [r["token"] for r in D.override_events(tokens, rules).collect()] == ["of"]
    assert D.route(tokens.limit(0), models, rules).count() == 0


def row(token, script, cands, **own):
    """A scored token as ``scored_tokens`` gives it, from the few scores that matter."""
    none = {"builtin": 0.0, "word": 0.0, "freq": 0.0, "tri": -5.0, "norm": 0.0, "white": False, "nl": 0.3, "quality": 0.0}
    base = {"place": 3, "letters": len(token), "src_builtin": 0.0, "src_word": 0.0, "src_freq": 0.0, "src_norm": 0.0, "q": 0.0, **none}
    return (token, script, {x: none | own.get(x, {}) for x in LANGS}, [base | c for c in cands])


SCORED = (
    "token string, script string, own struct<{}>, cands array<struct<place:int,hyp:string,source:string,target:string,text:string,letters:bigint,builtin:double,word:double,freq:double,tri:double,"
    "norm:double,white:boolean,nl:double,src_builtin:double,src_word:double,src_freq:double,src_norm:double,quality:double,q:double>>"
).format(",".join(f"{x}:struct<builtin:double,word:double,freq:double,tri:double,norm:double,white:boolean,nl:double,quality:double>" for x in LANGS))


def test_hebrew_collisions_and_model_answers(spark):
    he = {"hyp": "en_from_he", "source": "he", "target": "en"}
    rows = [
        row("םלא", "he", [he | {"text": "lol", "white": True}]),  # whitelisted, weak Hebrew
        row("שלא", "he", [he | {"text": "aka", "white": True, "src_builtin": 1.0}]),  # whitelisted, but a strong Hebrew word
        row("םםםםםמ", "he", [he | {"text": "ooooon", "word": 0.95, "freq": 0.5, "src_word": 0.95, "src_freq": 0.2}]),  # ends in a non-final form
        row("םםםםםם", "he", [he | {"text": "oooooo", "word": 0.95, "freq": 0.5, "src_word": 0.95, "src_freq": 0.2}]),
        row("abc", "en", [{"hyp": "ru_from_en", "source": "en", "target": "ru", "text": "фис", "white": True}]),
    ]
    scored = spark.createDataFrame(rows, SCORED)
    assert {(r["text"], r["rule"], r["confidence"]) for r in D.resolve_hebrew_collision(scored).collect()} == {("lol", "whitelist", 0.85), ("ooooon", "frequency", 0.82)}
    assert {(r["text"], r["rule"], r["confidence"]) for r in D.resolve_hebrew_collision(scored, automatic=False).collect()} == {("lol", "whitelist", 0.95), ("aka", "whitelist", 0.95), ("ooooon", "frequency", 0.90)}
    ru, en = {"hyp": "ru_from_en", "source": "en", "target": "ru", "place": 3}, {"hyp": "he_from_en", "source": "en", "target": "he", "place": 4}
    good = {"word": 0.9, "freq": 0.9, "letters": 5}
    rows = [row("aaaaa", "en", [ru | good | {"text": "r1", "quality": 1.0}, en | good | {"text": "h1", "quality": 1.11}]), row("bbbbb", "en", [ru | good | {"text": "r2", "quality": 1.0}, en | good | {"text": "h2", "quality": 1.13}])]
    rows += [row("ccccc", "en", [ru | {"text": "r3", "quality": 9.0}]), row("ddddd", "ru", [{"hyp": "en_from_ru", "source": "ru", "target": "en", "text": "x", **good}]), row("eeeee", "en", [])]
    predicted = spark.createDataFrame([("aaaaa", "ru_from_en", 0.5), ("bbbbb", "ru_from_en", 0.95), ("ccccc", "ru_from_en", 0.9), ("ddddd", "ru_from_en", 0.9), ("eeeee", "en", 0.75)], "token string, predicted string, confidence double")
    got = {r["token"]: (r["text"], r["confidence"]) for r in D.model_correction(spark.createDataFrame(rows, SCORED), predicted).collect()}
    assert got == {"aaaaa": ("r1", 0.9), "bbbbb": ("h2", 0.95), "eeeee": ("eeeee", 0.75)}


def test_language_before_a_token_and_prepositions(spark, models):
    tokens = spark.createDataFrame([("zq", None), ("zq", "ru"), ("q", "ru"), ("q", None)], "token string, last_lang string")
    none = spark.createDataFrame([], "token string, action string, hyp string")
    got = {(r["token"], r["last_lang"]): r for r in D.route(tokens, models, none).collect()}
    assert len(got) == 4 and got["q", "ru"]["lang"] == "ru" and got["q", "ru"]["hyp"] == "en" and got["q", None]["lang"] == "en"
    scored = D.scored_tokens(tokens.select("token"), models).withColumn("before", F.lit("en"))
    plain, after = (D.ensemble_language(scored.where("token = 'zq'"), c).first()["confidence"] for c in (None, "before"))
    assert after > plain
    pairs = spark.createDataFrame([("f", "а"), ("r", "к")], "token string, word string")
    assert {(r["token"], r["word"]) for r in D.preposition_map(spark.createDataFrame([("f",), ("R",), ("x",), (None,)], "token string"), pairs).collect()} == {("f", "а"), ("R", "К")}


def test_samples_of_all_nine_classes(spark, phrases):
    words = P.sample_words(M.train_unigrams(phrases, langs=LANGS), 1000).cache()
    made = P.make_samples(words, 4000)
    counts = {r["label"]: r["count"] for r in made.groupBy("label").count().collect()}
    assert set(counts) == set(P.CLASSES) and sum(counts.values()) == 4000 and 1800 < sum(counts[x] for x in LANGS) < 2200
    scripts = made.where("label in ('ru', 'en_from_ru')").agg(F.count_if(F.col("text").rlike("[a-zא-ת]"))).first()[0]
    assert scripts == 0
    focus = {r["label"] for r in P.make_samples(words, 500, focus="he").select("label").distinct().collect()}
    assert focus == {"he", "he_from_en", "en_from_he", "he_from_ru", "ru_from_he"}
    assert P.make_samples(words.limit(0), 5).count() == 0
    coded = P.split_samples(P.encode_samples(made))
    model = P.train_classifier(coded.where("part = 'train'"), 1 << 12, 15)
    seen = P.predict_classes(model, coded.where("part = 'validation'").select("id", "text", "label"))
    assert seen.agg(F.avg((F.col("predicted") == F.col("label")).cast("double"))).first()[0] > 0.8
    best = P.select_best(coded.where("part = 'train'"), coded.where("part = 'validation'"), ((1e3, 1), (1e-3, 10))).collect()
    assert [r["best"] for r in sorted(best, key=lambda r: r["iterations"])] == [False, True]
    changed = P.augment_samples(made, p=1.0).join(made.select("id", F.col("text").alias("before")), "id").where("length(before) >= 2")
    assert changed.agg(F.avg((F.col("text") != F.col("before")).cast("double"))).first()[0] > 0.8


def test_wiki_chat_and_keymap_readers(spark, tmp_path):
    page = "<page><title>{}</title><ns>{}</ns><revision><text bytes='9'>{}</text></revision></page>"
    body = "{{box}} [[a|The label]] == Head == <b>bold</b> " + "Long enough sentence here. " * 6
    xml = "<mediawiki>" + page.format("A", 0, body.replace("<", "&lt;")) + page.format("B", 1, "talk") + "</mediawiki>"
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(xml.encode()))
    rows = R.wiki_phrases(spark, str(tmp_path / "d.xml.bz2")).collect()
    assert rows and {r["title"] for r in rows} == {"A"} and "{{" not in rows[0]["text"] and "The label" in rows[0]["text"]

    (tmp_path / "a.json").write_text(json.dumps({"messages": [{"text": "plain"}, {"text": ["a ", {"type": "bold", "text": "b"}, " c"]}]}))
    (tmp_path / "b.json").write_text(json.dumps({"chats": {"list": [{"messages": [{"text": "nested"}]}, {}]}}))
    got = R.flatten_message_text(R.read_chat_export(spark, str(tmp_path / "*.json")))
    assert {r["text"] for r in got.collect()} == {"plain", "a b c", "nested"}

    keys = {"map": {"k1": {"us": {"n": "q", "s": "Q"}, "ru": {"n": "й", "s": "Й", "a": "q", "sa": "ab"}}}}
    (tmp_path / "keys.json").mkdir()
    (tmp_path / "keys.json" / "k.json").write_text(json.dumps(keys))
    rows = {(r["layout_id"], r["modifier"], r["ch"]) for r in R.read_keymap(spark, str(tmp_path / "keys.json")).collect()}
    assert rows == {("us", "n", "q"), ("us", "s", "Q"), ("ru", "n", "й"), ("ru", "s", "Й")}


def test_text_readers_and_sinks(spark, tmp_path):
    (tmp_path / "x.en").write_text("Hello there\n\n  two \n")
    (tmp_path / "x.ru").write_text("привет\n")
    rows = {(r["lang"], r["text"]) for r in R.read_bitext(spark, f"{tmp_path}/x.*").collect()}
    assert rows == {("en", "Hello there"), ("en", "two"), ("ru", "привет")}
    assert R.read_phrases(spark, str(tmp_path / "x.en"), "en", min_len=3).count() == 1
    (tmp_path / "art.jsonl").write_text('{"text": "one"}\n{"other": 1}\n')
    assert R.read_article_jsonl(spark, str(tmp_path / "art.jsonl")).count() == 1

    words = spark.createDataFrame([("en", "b", 2), ("en", "a", 5)], "lang string, word string, cnt long")
    W.write_unigrams(words, f"{tmp_path}/uni")
    back = R.read_unigrams(spark, f"{tmp_path}/uni/lang=en", "en").orderBy("rank").collect()
    assert [(r["word"], r["cnt"], r["rank"]) for r in back] == [("a", 5, 1), ("b", 2, 2)]

    samples = spark.createDataFrame([('a "q", b', "en"), ("x", "nope")], "text string, label string")
    W.write_samples(samples, f"{tmp_path}/samples")
    assert [r["text"] for r in R.read_samples(spark, f"{tmp_path}/samples", ["en"]).collect()] == ['a "q", b']

    known = {"rejects": 2, "applies": 0, "overrides": 1, "timestamps": ["2026-01-02T03:04:05Z"]}
    (tmp_path / "rules.json").write_text(json.dumps([
        {"token": " Foo ", "scope": {"type": "odd"}, "action": {"type": "strange"}},
        {"token": "b", "action": {"type": "preferHypothesis", "hypothesis": "ru_from_en"}, "evidence": known, "convertedText": "и"},
        {"token": "Exact", "matchMode": "exact", "scope": {"type": "perApp", "app": "mail"}, "action": {"type": "preferLanguage", "language": "ru"}},
    ]))
    read = R.read_rules(spark, str(tmp_path / "rules.json"))
    rules = {r["token"]: (r["scope"], r["app"], r["match_mode"], r["action"], r["lang"], r["hyp"], r["converted"]) for r in read.collect()}
    assert rules == {
        "foo": ("global", None, "caseInsensitive", "keepAsIs", None, None, None), "b": ("global", None, "caseInsensitive", "preferHypothesis", None, "ru_from_en", "и"),
        "Exact": ("perApp", "mail", "exact", "preferLanguage", "ru", None, None),
    }
    W.write_rules(read, f"{tmp_path}/rules-again")
    assert {str(r) for r in R.read_rules(spark, f"{tmp_path}/rules-again", lines=True).collect()} == {str(r) for r in read.collect()}

    (tmp_path / "cases.json").write_text(json.dumps({"cat": {"description": "d", "cases": [{"input": "i", "expected": "e"}, {"words": ["a", "b"], "expected_final": "f"}]}}))
    assert R.read_cases(spark, str(tmp_path / "cases.json")).where("category = 'cat'").count() == 2
    (tmp_path / "more.json").write_text(json.dumps({"cat": {"cases": [{"input": "i", "alt_presses": 2, "expected_sequence": ["a"], "max_time_ms": 9, "settings": {"activeLayouts": {"en": "us"}}}]}}))
    case = R.read_cases(spark, str(tmp_path / "more.json")).first()
    assert (case["alt_presses"], case["expected_sequence"], case["max_time_ms"], case["active_layouts"]) == (2, ["a"], 9, {"en": "us"})
    (tmp_path / "model.json").write_text(json.dumps({"lang": "en", "n": 3, "logprobs": {"abc": -1.0, "ab": -2.0}}))
    assert [r["gram"] for r in R.read_trigram_json(spark, str(tmp_path / "model.json")).collect()] == ["abc"]
    (tmp_path / "data.json").write_text(json.dumps({"builtin": {"en": ["Hi", "hi"]}, "whitelist": {"ru": ["Да"]}, "prepositions": {"F": "а"}, "punctuation": {"opening": ["("], "odd": ["x"]}}))
    data = {tuple(r) for r in R.read_language_data(spark, str(tmp_path / "data.json")).where("kind <> 'conversion'").collect()}
    assert data == {("builtin", "en", "hi", None), ("whitelist", "ru", "да", None), ("preposition", None, "f", "а"), ("opening", None, "(", None)}
    assert R.read_language_data(spark, str(tmp_path / "data.json")).where("kind = 'conversion'").count() == 6
    (tmp_path / "pairs.json").write_text(json.dumps({"conversions": [{"from": "en", "to": "ru"}]}))
    assert [(r["lang"], r["value"]) for r in R.read_language_data(spark, str(tmp_path / "pairs.json")).collect()] == [("en", "ru")]
    log = spark.createDataFrame([("s3cret", "тайна", True, "ru", "mail")], "original string, final string, attempted boolean, selected string, app string").withColumn("ts", F.current_timestamp())
    W.write_correction_log(log, f"{tmp_path}/log")
    line = spark.read.text(f"{tmp_path}/log").first()["value"]
    assert "s3cret" not in line and "тайна" not in line and "cyrillic" in line


def test_log_holds_no_text(spark):
    log = W.decision_log(spark.createDataFrame([("secret7", "scored", "en", 0.9)], "token string, path string, lang string, confidence double")).first()
    assert "secret7" not in str(log) and '"latin":6' in log["shape"]


def test_scoring_stays_in_catalyst(spark):
    from keylingo.plans import model_queries

    plan = model_queries.j9_trigram_score(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_long_histories_are_not_gathered_in_rows(spark):
    n = 40000
    keys = spark.range(n).selectExpr("1 as user_id", "timestamp_seconds(id) as ts", "id as seq", "id as event_id", "if(id % 4 = 3, ' ', 'a') as ch", "id % 4 = 1 as is_backspace", "if(id < 2, 'reject', 'apply') as event", "'h' as hyp")
    calm = B.debounce(keys, gap=2.0)
    assert calm.agg(F.count("*"), F.sum("event_id")).first()[:] == (n // 2, sum(range(0, n, 2)))
    words = B.keystrokes_to_tokens(keys)
    assert words.agg(F.max("seq"), F.count_distinct("token"), F.first("token")).first()[:] == (n // 4, 1, "a")
    rules = B.learn_rules(keys, key="user_id")
    assert [tuple(r)[:6] for r in rules.collect()] == [(1, "keepAsIs", None, 2, n - 2, 0)]
    presses = spark.range(n).selectExpr("1 as session_id", "id as press_no", "false as automatic", "3 as choices")
    replay = B.alternation_replay(presses)
    assert replay.first()["positions"] == [1] + [k % 3 for k in range(n - 1)]
    for out in (calm, words, rules, replay):
        assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
