"""Scans and folds over one long sequence in many blocks, against the plain forms."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from keylingo.operators import blocks as S
from keylingo.operators import context as K
from keylingo.operators import feedback as B


def plain(df, columns):
    return sorted(str([r[c] for c in columns]) for r in df.select(*columns).collect())


def history(spark, n=4000):
    """One stream has two thirds of all words; keys may be null."""
    rng, ts, rows = random.Random(2), 0.0, []
    for seq in range(n):
        ts += rng.choice([0.1, 0.5, 1.0, 2.0, 2.1, 4.0])
        stream = rng.choice([1, 1, 1, 1, 2, 3, None])
        rows.append((stream, seq, ts, rng.choice(["a", "f", "B", "word"] * 6 + ["end.", "w!)", None]), rng.choice(["en", "ru", "he", None]), rng.choice([0.2, 0.41, 0.44, 0.5, 0.9, None]), rng.choice([True, False, False, None])))
    return spark.createDataFrame(rows, "stream_id long, seq long, ts double, token string, lang string, confidence double, applied boolean")


@pytest.mark.parametrize("parts", [1, 13, 60])
def test_context_over_blocks(spark, parts):
    tokens = history(spark)
    w = Window.partitionBy("stream_id").orderBy("seq")
    new = F.coalesce(F.lag("token").over(w).rlike(r"[.!?][\p{P}]*$"), F.lit(False)) | F.coalesce(F.col("ts") - F.lag("ts").over(w) > 2.0, F.lit(False))
    want = tokens.withColumn("new", new.cast("long")).withColumn("sentence", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    want = want.withColumn("last_lang", F.last_value(F.when(F.col("applied"), F.col("lang")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    s = Window.partitionBy("stream_id", "sentence").orderBy("seq")
    so_far, sure = s.rowsBetween(Window.unboundedPreceding, 0), F.when(F.col("confidence") > 0.45, F.col("lang"))
    want = want.withColumn("sure", sure).withColumn("sentence_lang", F.first_value("sure", True).over(so_far))
    want = want.withColumn("same", F.coalesce(F.col("sure") == F.col("sentence_lang"), F.lit(False)).cast("long")).withColumn("agreeing", F.sum("same").over(so_far))
    following, other, soon = F.lead("lang").over(s), F.lead("confidence").over(s), F.lead("ts").over(s) - F.col("ts") <= 5.0
    want = want.withColumn(
        "decision",
        F.when(F.col("confidence") > 0.45, "applied").when(soon & F.lower("token").isin(list("fdrjebz")) & (following == "ru"), "preposition")
        .when(soon & (F.col("confidence") >= 0.40) & (other > 0.45) & (following == F.col("lang")) & (F.col("confidence") + 0.20 > 0.45), "boosted"),
    )
    blocks = S.dealt(tokens, ("stream_id",), ("seq",), parts)
    assert blocks.select(S.BLOCK).distinct().count() == parts
    got = K.context_boost(K.sentence_dominant(K.last_language(K.sentence_ids(blocks))))
    columns = ("stream_id", "seq", "sentence", "last_lang", "sentence_lang", "agreeing", "decision")
    assert plain(got, columns) == plain(want, columns)
    assert S.BLOCK not in K.sentence_ids(tokens, parts=3).columns


def test_long_sentences_over_blocks(spark):
    """One sentence lies in all blocks, and its language leads from the middle of one."""
    n = 3000
    tokens = spark.range(n).select(F.lit(1).alias("stream_id"), F.col("id").alias("seq"), F.lit(0).cast("long").alias("sentence"), F.expr("CASE id % 3 WHEN 0 THEN 'ru' ELSE 'en' END AS lang"), F.expr("if(id < 1000, 0.1, 0.9) AS confidence"))
    got = {r["seq"]: (r["sentence_lang"], r["agreeing"]) for r in K.sentence_dominant(tokens, parts=11).collect()}
    count = 0
    for seq in range(n):
        count += seq >= 1000 and seq % 3 != 0
        assert got[seq] == (None if seq < 1000 else "en", count)


@pytest.mark.parametrize("parts", [1, 9, 60])
def test_debounce_over_blocks(spark, parts):
    rng, rows = random.Random(8), []
    for user, steps in ((1, [100_000, 300_000, 499_999, 500_000]), (2, [0, 0, 1_000, 40_000]), (3, [600_000, 5_000_000]), (None, [200_000])):
        us = 1_700_000_000_000_000
        for _ in range(1500 if user in (1, 2) else 40):
            us += rng.choice(steps)
            rows.append((user, len(rows), us))
    events = spark.createDataFrame(rows, "user_id long, event_id long, us long").withColumn("ts", F.timestamp_micros("us"))
    want, last = [], {}
    for user, number, us in sorted(rows, key=lambda r: (r[2], r[1])):
        if user not in last or us - last[user] >= 500_000:
            last[user] = us
            want.append((user or 0, number))
    got = B.debounce(events, parts=parts)
    assert sorted((r["user_id"] or 0, r["event_id"]) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("parts", [1, 9, 120])
def test_keystrokes_over_blocks(spark, parts):
    rng, rows, us = random.Random(9), [], 1_700_000_000_000_000
    kinds = [("a", False, False)] * 4 + [("é", False, False), (" ", False, False), ("\n", False, False), (None, False, False), ("x", True, False), ("x", True, False), (None, False, True)]
    for seq in range(3000):
        us += rng.choice([0, 10_000, 100_000, 349_999, 350_000, 2_000_000, 2_000_001])
        rows.append((rng.choice([1, 1, 1, 2, None]), seq, us, *rng.choice(kinds)))
    keys = spark.createDataFrame(rows, "user_id long, seq long, us long, ch string, is_backspace boolean, selects_all boolean").withColumn("ts", F.timestamp_micros("us"))
    want, states = [], {}
    for user, _, us, ch, erases, selects in rows:
        buffer, last, selected, seq = states.get(user, ([], None, None, 0))
        if last is not None and us - last > 2_000_000:
            buffer = []
        if selects:
            selected = us
        elif erases and selected is not None and us - selected < 350_000:
            buffer, selected = [], None
        elif erases:
            buffer = buffer[:-1] if None not in buffer else [None]
        elif ch in (" ", "\n"):
            if buffer and None not in buffer:
                seq += 1
                want.append((user or 0, seq, "".join(buffer)))
            buffer = []
        else:
            buffer = [None] if ch is None or None in buffer else [*buffer, ch]
        states[user] = (buffer, us, selected, seq)
    got = B.keystrokes_to_tokens(keys, parts=parts)
    assert sorted((r["user_id"] or 0, r["seq"], r["token"]) for r in got.collect()) == sorted(want) and len(want) > 100


@pytest.mark.parametrize("parts", [1, 6, 40])
def test_rows_are_numbered_over_blocks(spark, parts):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 9), n) for n in range(900)]
    got = S.numbered(spark.createDataFrame(rows, "k string, x int, n int"), ("k",), (F.desc("x"), F.asc("n")), "at", parts)
    want, count = [], {}
    for k, x, n in sorted(rows, key=lambda r: (-r[1], r[2])):
        count[k] = count.get(k, 0) + 1
        want.append((k or "", x, n, count[k]))
    assert sorted((r["k"] or "", r["x"], r["n"], r["at"]) for r in got.collect()) == sorted(want)
