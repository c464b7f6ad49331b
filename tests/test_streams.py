"""Streams cut into several batches and begun anew, against their batch twins."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keylingo.operators import context as K
from keylingo.operators import feedback as B
from keylingo.streaming import processors as R

#: Microseconds: nothing is on the first watermark.
START = 1_700_000_000_000_000


def staged(spark, folder, rows, schema, parts, shuffle=True):
    """Writes rows to one file a batch, oldest first, each file's rows in any order; then a far later row of another key moves the watermark."""
    rng, size = random.Random(1), -(-len(rows) // parts)
    for n in range(parts):
        part = rows[n * size : (n + 1) * size]
        if shuffle:
            rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in-{n}")
    return [f"{folder}/in-{n}" for n in range(parts)]


def feed(spark, run, folder, parts, schema):
    """Runs a stream over one file after the other, each by a new query from the checkpoint of the one before."""
    import shutil
    from pathlib import Path

    Path(f"{folder}/all").mkdir()
    for part in parts:
        for file in Path(part).glob("*.parquet"):
            shutil.copy(file, f"{folder}/all/{Path(part).name}-{file.name}")
        out = run(spark.readStream.schema(schema).parquet(f"{folder}/all"))
    return out


def micros(df):
    return df.withColumn("ts", F.timestamp_micros("us")).drop("us")


def test_waiting_words_expire_and_equal_the_batch_form(spark, tmp_path):
    rng, rows = random.Random(3), []
    for stream in range(6):
        us = START + rng.randint(0, 10**6)
        for seq in range(60):
            us += rng.choice([200_000, 900_000, 1_999_999, 2_000_000, 2_000_001, 4_900_000, 5_000_000, 7_000_000])
            token = rng.choice(["word", "f", "B", "end.", "x!", None, ""])
            rows.append((stream, seq, us, token, rng.choice(["en", "ru", None]), rng.choice([0.1, 0.39, 0.4, 0.44, 0.45, 0.46, 0.9, None])))
    rows.sort(key=lambda r: r[2])
    last = (99, 0, rows[-1][2] + 60_000_000, "late", "en", 0.9)
    schema = "stream_id long, seq long, us long, token string, lang string, confidence double"
    parts = staged(spark, tmp_path, [*rows, last], schema, 5)

    def run(stream):
        stream = micros(stream).withColumn("ends", F.coalesce(F.col("token").rlike(r"[.!?][\p{P}]*$"), F.lit(False)))
        return R.run_to_table(R.context_boost(stream), str(tmp_path / "boost"), "append")

    got = feed(spark, run, tmp_path, parts, schema)
    batch = spark.createDataFrame(rows, schema).withColumn("ts", F.col("us") / 1e6)
    want = K.context_boost(K.sentence_ids(batch))
    assert sorted((r["stream_id"], r["seq"], r["decision"] or "") for r in got.collect()) == sorted((r["stream_id"], r["seq"], r["decision"] or "") for r in want.collect())
    assert {r["decision"] for r in want.collect()} == {None, "applied", "boosted", "preposition"}


def test_keystrokes_in_any_batches(spark, tmp_path):
    rng, rows, us = random.Random(4), [], START
    for seq in range(900):
        us += rng.choice([10_000, 100_000, 349_999, 350_000, 2_000_000, 2_000_001])
        ch, erases, selects = rng.choice([("a", False, False), ("b", False, False), ("é", False, False), (" ", False, False), ("\n", False, False), (" ", False, False), (None, False, False), ("x", True, False), (None, False, True)])
        rows.append((rng.randint(1, 3), seq, us, ch, erases, selects))
    schema = "user_id long, seq long, us long, ch string, is_backspace boolean, selects_all boolean"
    parts = staged(spark, tmp_path, [*rows, (9, 0, us + 60_000_000, "z", False, False)], schema, 4)
    got = feed(spark, lambda s: R.run_to_table(R.keystrokes_to_tokens(micros(s)), str(tmp_path / "keys"), "append"), tmp_path, parts, schema)
    want = sorted(tuple(r) for r in B.keystrokes_to_tokens(micros(spark.createDataFrame(rows, schema))).collect())
    assert sorted(tuple(r)[:3] for r in got.collect()) == want and len(want) > 40


def test_select_all_then_backspace_clears(spark):
    keys = [(1, n, START + us, ch, erases, selects) for n, (us, ch, erases, selects) in enumerate([(0, "a", False, False), (1, "b", False, False), (2, None, False, True), (300_000, None, True, False), (300_001, "c", False, False), (300_002, " ", False, False)])]
    late = [(2, n, us + (200_000 if n >= 3 else 0), *rest) for _, n, us, *rest in keys]
    schema = "user_id long, seq long, us long, ch string, is_backspace boolean, selects_all boolean"
    got = B.keystrokes_to_tokens(micros(spark.createDataFrame(keys + late, schema)))
    assert sorted((r["user_id"], r["token"]) for r in got.collect()) == [(1, "c"), (2, "ac")]


def test_rules_are_kept_by_use(spark, tmp_path):
    rng, rows, us = random.Random(5), [], START
    for seq in range(1500):
        us += rng.choice([1_000, 500_000, 9_000_000])
        token = f"tokén{min(rng.randint(0, 40), rng.randint(0, 40))}"
        rows.append((token, seq, us, rng.choice(["reject", "apply", "override", "lookup", "none", None]), rng.choice(["h1", "h2"])))
    schema = "token string, seq long, us long, event string, hyp string"
    parts = staged(spark, tmp_path, [*rows, ("zz", 0, us + 60_000_000, "none", None)], schema, 4)
    for most in (7, 500):
        folder = tmp_path / f"m{most}"
        folder.mkdir()
        got = feed(spark, lambda s, most=most, folder=folder: R.run_to_rules(R.learn_rules(micros(s)), str(folder / "rules"), most), folder, parts, schema)
        want = B.learn_rules(micros(spark.createDataFrame(rows, schema)), most=most)
        fields = ("token", "action", "hyp", "reject", "apply", "override")
        assert sorted(str([r[f] for f in fields]) for r in got.collect()) == sorted(str([r[f] for f in fields]) for r in want.collect())
        assert want.count() == min(most, want.count()) > 5
    # a look-up keeps an old rule among the most recent
    use = [("old", 0, START, "apply", "h"), ("new", 1, START + 1, "apply", "h"), ("old", 2, START + 2, "lookup", None), ("none", 3, START + 3, "lookup", None)]
    assert [r["token"] for r in B.learn_rules(micros(spark.createDataFrame(use, schema)), most=1).collect()] == ["old"]


def test_alternation_sessions_end_by_time(spark, tmp_path):
    rng, rows, us = random.Random(6), [], START
    for seq in range(400):
        us += rng.choice([100_000, 3_000_000, 60_000_000, 60_000_001, 90_000_000])
        rows.append((rng.randint(1, 4), seq, us, rng.choice([True, False, None]), rng.choice([1, 2, 3, 5, None])))
    schema = "user_id long, seq long, us long, automatic boolean, choices long"
    parts = staged(spark, tmp_path, [*rows, (9, 0, us + 200_000_000, True, 2)], schema, 4)
    got = feed(spark, lambda s: R.run_to_table(R.alternation_events(micros(s)), str(tmp_path / "alt"), "append").drop("batch"), tmp_path, parts, schema)
    want = B.alternation_events(micros(spark.createDataFrame(rows, schema)))
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(tuple(r)) for r in want.collect())
    assert {r["event"] for r in want.collect()} == {None, "apply", "reject"}
    # the closed form is that of the replay of each press
    presses = [(f"{n}-{a}-{c}", k, a, c) for n in range(1, 12) for a in (True, False) for c in (1, 2, 3, 4) for k in range(n)]
    for r in B.alternation_replay(spark.createDataFrame(presses, "session_id string, press_no int, automatic boolean, choices int")).collect():
        n, a, c = r["session_id"].split("-")
        assert r["positions"][-1] == B.position_after(int(n), a == "True", int(c))


def test_a_token_is_decided_once(spark, tmp_path):
    schema = T.StructType([T.StructField("token", T.StringType())])
    seen = []

    def decide(tokens):
        seen.append(sorted(r["token"] for r in tokens.collect()))
        return tokens.withColumn("path", F.lit("p"))

    parts = [str(tmp_path / f"in-{n}") for n in range(3)]
    for part, words in zip(parts, (["a", "b", "a", None], ["b", "c"], ["a", "c"]), strict=True):
        spark.createDataFrame([(w,) for w in words], schema).coalesce(1).write.parquet(part)
    log = feed(spark, lambda s: R.stream_decisions(s, decide, str(tmp_path / "log")), tmp_path, parts, schema)
    assert seen == [["a", "b"], ["c"], []] and sorted(r["token"] for r in log.collect()) == ["a", "b", "c"]


@pytest.mark.parametrize("parts", [1, 3])
def test_late_rows_are_dropped_and_earlier_ones_ordered(spark, tmp_path, parts):
    schema = "user_id long, seq long, us long, ch string, is_backspace boolean"
    rows = [(1, n, START + n * 100_000, c, False) for n, c in enumerate("abc def ")]
    staged_parts = staged(spark, tmp_path, [*rows, (9, 0, START + 60_000_000, "z", False)], schema, parts)
    got = feed(spark, lambda s: R.run_to_table(R.keystrokes_to_tokens(micros(s)), str(tmp_path / "late"), "append"), tmp_path, staged_parts, schema)
    assert sorted(tuple(r)[1:3] for r in got.collect()) == [(1, "abc"), (2, "def")]


def test_keys_of_a_bucket_are_folded_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "BUCKETS", 2)
    schema = "user_id long, seq long, us long, ch string, is_backspace boolean"
    users = [None, 0, -5, 2**53 + 1, *range(1, 20)]
    rows = [(user, n, START + n * 100_000, c, False) for n, c in enumerate("ab c ") for user in users]
    parts = staged(spark, tmp_path, [*rows, (99, 0, START + 60_000_000, "z", False)], schema, 2)
    streams = []

    def run(stream):
        streams.append(R.keystrokes_to_tokens(micros(stream)))
        return R.run_to_table(streams[-1], str(tmp_path / "bucket"), "append")

    got = feed(spark, run, tmp_path, parts, schema)
    assert sorted(str(tuple(r)[:3]) for r in got.collect()) == sorted(str((user, n, t)) for user in users for n, t in ((1, "ab"), (2, "c")))
    assert "__bucket" in streams[-1]._jdf.queryExecution().logical().toString()


def test_a_batch_of_rules_is_read_once(spark, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    schema = "token string, action string, hyp string, reject long, apply long, override long, touched long, touched_seq long"
    rows = spark.createDataFrame([("a", "none", "h", 0, 0, 0, 1, 1), ("b", "none", "h", 0, 0, 0, 2, 2)], schema)

    def counted(parts):
        for part in parts:
            seen.add(part.num_rows)
            yield part

    batch = rows.mapInArrow(counted, schema)
    monkeypatch.setattr(R, "_run", lambda stream, folder, mode, sink: sink(batch, 0))
    assert R.run_to_rules(rows, str(tmp_path / "once")).count() == 2 and seen.value == 2
