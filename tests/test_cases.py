"""Stratified evaluation cases, exact rules, and their fixtures."""

import json
import random
from collections import Counter

import pytest

from keylingo.operators import decide as D
from keylingo.operators import samples as P
from keylingo.sources import readers as R

LETTERS = {"en": "abcdefghijklmnopqrstuvwxyz", "ru": "абвгдежзиклмнопрстуфхцчшэюя", "he": "אבגדהוזחטיכלמנסעפצקרשת"}


def lexicon(sizes):
    rng, out = random.Random(7), []
    for lang, n in sizes.items():
        found = {}
        while len(found) < n:
            found["".join(rng.choices(LETTERS[lang], k=rng.randint(2, 9)))] = None
        out += [(lang, w, i + 1) for i, w in enumerate(found)]
    return out


@pytest.mark.parametrize("n", [1, 7, 50, 303])
def test_quotas_sum_and_stay_near_their_shares(n):
    dealt = P.quotas(n)
    assert sum(dealt.values()) == n and all(abs(dealt[k] - n * s / 100) < 1 for k, s in P.KINDS)


def test_cases_are_stratified(spark):
    words = lexicon({"en": 21_000, "ru": 300, "he": 3})
    informal = [("en", "lol"), ("en", "gg"), ("ru", "норм"), ("he", "סבבה"), (None, "x"), ("en", None), ("fr", "y")]
    frame = spark.createDataFrame(words, "lang string, word string, rank long").cache()
    got = P.evaluation_cases(frame, spark.createDataFrame(informal, "lang string, word string"), 100).collect()
    rank = {(x, w): r for x, w, r in words}
    told = {(r["lang"], r["id"]): (r["kind"], r["intended"]) for r in got}
    assert Counter((x, k) for (x, _), (k, _) in told.items()) == Counter({(x, k): n for x in LETTERS for k, n in P.quotas(100).items()})
    of_two = lambda text: text.strip("!?.,()/ ")
    for (lang, _), (kind, text) in told.items():
        if kind == "informal":
            assert (lang, text) in informal
        if kind == "phrase":
            assert 2 <= len(text.split(" ")) <= 6
        if kind in ("short", "medium", "phrase"):
            assert all((lang, w) in rank for w in text.split(" "))
        if kind == "short" and lang != "he":
            assert 2 <= len(text) <= 3
        if kind == "mixed":
            assert len(set(text.split(" ")) & {w for x, w in informal if x == lang}) >= 1
        if kind == "informal_punctuation":
            assert of_two(text) and text[0] not in "!?"
    # half of the words are of the head, though it has a fifth of the lexicon; the rest is of the middle or, where there is no tail, of all
    ranks = [rank["en", w] for (x, _), (k, t) in told.items() if x == "en" and k in ("short", "medium", "phrase") for w in t.split(" ")]
    assert 0.4 < sum(r <= 4000 for r in ranks) / len(ranks) < 0.65 and sum(r > 20_000 for r in ranks) > 0.25 * len(ranks)
    for r in got:
        assert r["expected"] == (r["lang"] if r["lang"] == r["typed_on"] else f"{r['lang']}_from_{r['typed_on']}")
        assert (r["typed"] == r["intended"]) == (r["lang"] == r["typed_on"])
    again = P.evaluation_cases(frame.repartition(7), spark.createDataFrame(informal, "lang string, word string"), 100).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_cases_without_words_or_informal_ones(spark):
    words = spark.createDataFrame(lexicon({"ru": 50}), "lang string, word string, rank long")
    none = spark.createDataFrame([], "lang string, word string")
    kinds = Counter((r["lang"], r["kind"]) for r in P.evaluation_cases(words, none, 40).collect() if r["lang"] == r["typed_on"])
    assert kinds == Counter({("ru", k): n for k, n in P.quotas(40).items() if k in ("short", "medium", "phrase", "punctuation")})
    assert P.evaluation_cases(words.limit(0), none, 40).count() == 0


def test_exact_rules_are_read_and_applied(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps([
        {"token": "Exact", "matchMode": "exact", "action": {"type": "keepAsIs"}}, {"token": " Foo\n", "action": {"type": "keepAsIs"}}, {"token": "GHBDTN", "matchMode": "exact", "action": {"type": "preferHypothesis", "hypothesis": "ru_from_en"}},
    ]))
    rules = R.read_rules(spark, str(tmp_path / "rules.json"))
    tokens = spark.createDataFrame([("Exact",), ("exact",), ("foo\n",), (" FOO",), ("ghbdtn",), ("other",), (None,)], "token string")
    got = {r["token"]: r["rule"]["path"] if r["rule"] else None for r in D.apply_rules(tokens, rules).collect()}
    assert got == {"Exact": "rule_keep", "exact": "rule_keep", "foo\n": "rule_keep", " FOO": "rule_keep", "ghbdtn": "rule_prefer", "other": None, None: None}
    assert sorted(r["token"] for r in D.override_events(tokens, rules).collect()) == ["Exact", "exact", "foo\n", " FOO"]


def test_models_as_json_and_stale_files(spark, tmp_path):
    import os
    import time

    from pyspark.sql import functions as F

    from keylingo.operators import evaluate as E
    from keylingo.operators import models as M
    from keylingo.sources import writers as W

    phrases = spark.createDataFrame([("en", "the cat and the dog"), ("ru", "кот и пёс и кот")], "lang string, text string")
    trigrams = M.train_trigrams(phrases, langs=("en", "ru"))
    W.write_trigram_json(trigrams, M.trigram_header(trigrams), f"{tmp_path}/model")
    want = sorted((r["lang"], r["gram"], round(r["logprob"], 2)) for r in trigrams.collect())
    assert sorted(map(tuple, R.read_trigram_json(spark, f"{tmp_path}/model").collect())) == want
    one = json.loads(spark.read.text(f"{tmp_path}/model/lang=en").first()["value"])
    assert one["lang"] == "en" and one["n"] == 3 and one["unique_trigrams"] == len(one["trigrams"]) and {"smoothing_k", "total_count"} <= set(one)

    corpus = tmp_path / "corpus"
    for lang in ("en", "ru", "he"):
        (corpus / f"lang={lang}").mkdir(parents=True)
        (corpus / f"lang={lang}/a.txt").write_text("x")
        os.utime(corpus / f"lang={lang}/a.txt", (1_600_000_000, 1_600_000_000))
    stale = lambda: {r["lang"]: r["stale"] for r in M.stale_models(R.read_file_times(spark, str(corpus)), R.read_file_times(spark, f"{tmp_path}/model").withColumnRenamed("changed", "built")).collect()}
    assert stale() == {"en": False, "ru": False, "he": True}
    later = time.time() + 60
    os.utime(corpus / "lang=ru/a.txt", (later, later))
    assert stale() == {"en": False, "ru": True, "he": True}
    assert {r["lang"] for r in R.read_file_times(spark, str(corpus / "lang=en"), "xx").collect()} == {"xx"}

    log = spark.createDataFrame([("r", "a", 0, True), ("r", "a", 30_000, True), ("r", "b", 90_000, False), ("s", "b", 95_000, True)], "run string, category string, us long, passed boolean").withColumn("ts", F.timestamp_micros("us"))
    got = {r["category"]: tuple(r)[1:] for r in E.case_summary(E.case_times(log, "run")).collect()}
    assert got == {"a": (2, 0, 0), "b": (1, 1, 1), "*": (3, 1, 1)}


def test_corrected_segments_are_spliced(spark):
    import re

    from keylingo.operators import context as K

    rng, choices = random.Random(2), {"aa": "AA", "b": None, "cc": "long text", " ": "_", "x": ""}
    texts = ["", None, "aa", "aa b", " aa", "b b", "aa cc  x\n", *("".join(rng.choices(["aa", "b", "cc", "x", " ", "  ", "\n", "é"], k=rng.randint(1, 30))) for _ in range(60))]
    docs = spark.createDataFrame([(n, t, "clash") for n, t in enumerate(texts)], "doc_id long, text string, segments string")
    got = {r["doc_id"]: (r["changed"], r["text"]) for r in K.correct_segments(docs, spark.createDataFrame(list(choices.items()), "token string, chosen string")).collect()}
    want = {}
    for n, text in enumerate(texts):
        parts = re.findall(r"[ \t\n\x0b\f\r]+|[^ \t\n\x0b\f\r]+", text or "")
        changed = sum(choices.get(p) is not None for p in parts)
        if parts:
            want[n] = (changed, "".join(p if choices.get(p) is None else choices[p] for p in parts) if changed and len(parts) > 1 else None)
    assert got == want
