"""Chat exports cut anywhere, against the JSON library."""

import json
import random

import pytest

from keylingo.sources import readers as R
from keylingo.sources.chats import read_messages


def message(rng, n):
    text = rng.choice(["plain", 'quo"ted \\ back', "br{ac}ke[t]s", "line\nend", "", ["a", {"type": "link", "text": "b}"}, "c"], "é漢🙂", "messages", "x" * 70])
    return {"id": n, "text": text, "nested": {"messages": [{"text": "no"}], "deep": [[{"a": "}"}]]}, "z": rng.choice([None, 1, True])}


def exports(rng):
    nested = {"about": "chats", "contacts": {"list": [{"messages": [{"text": "not a chat"}]}]}, "chats": {"about": "x", "list": [{"name": f"c{c}", "messages": [message(rng, n) for n in range(rng.randint(0, 9))]} for c in range(12)] + [{}]}, "left_chats": {"list": [{"messages": [{"text": "left"}]}]}}
    root = {"name": "one", "other": [{"text": "no"}], "messages": [message(rng, n) for n in range(80)]}
    return {"nested": nested, "root": root, "none": {"list": []}, "empty": {"messages": []}}


@pytest.mark.parametrize(("indent", "parts"), [(None, 1), (None, 7), (1, 7), ("\t", 1), (1, 60)])
def test_messages_of_exports_cut_anywhere(spark, tmp_path, indent, parts):
    rng, want = random.Random(parts), []
    for name, export in exports(rng).items():
        text = json.dumps(export, indent=indent, ensure_ascii=False)
        if indent == 1 and name == "root":
            text = text.replace('"messages": [', '"messages"\n:\n[', 1).replace("},\n  {", "}, {")
        (tmp_path / f"{name}.json").write_text(text)
        want += export.get("messages", []) + [m for c in export.get("chats", {}).get("list", []) for m in c.get("messages", [])]
    got = [json.loads(r["m"]) for r in read_messages(spark, str(tmp_path / "*.json"), parts).selectExpr("to_json(message) AS m").collect()]
    key = lambda m: json.dumps(m, sort_keys=True)
    assert sorted(map(key, got)) == sorted(map(key, want))
    texts = sorted(r["text"] for r in R.flatten_message_text(R.read_chat_export(spark, str(tmp_path / "*.json"), parts)).collect())
    flat = lambda t: t if isinstance(t, str) else "".join(x if isinstance(x, str) else x["text"] for x in t)
    assert texts == sorted(flat(m["text"]) for m in want) and len(want) > 100


def test_a_file_in_several_tasks_and_broken_ones(spark, tmp_path):
    rng = random.Random(3)
    export = {"messages": [message(rng, n) for n in range(3000)]}
    text = json.dumps(export, indent=1)
    (tmp_path / "big.json").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(len(text) // 9))
    try:
        found = read_messages(spark, str(tmp_path / "big.json"), 8)
        assert found.count() == 3000
        assert spark.read.text(str(tmp_path / "big.json")).rdd.getNumPartitions() >= 8
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "cut.json").write_text(text[: len(text) // 2])
    assert 1400 < read_messages(spark, str(tmp_path / "cut.json"), 5).count() < 1600
    (tmp_path / "odd.json").write_text("}}]] not json {")
    assert read_messages(spark, str(tmp_path / "odd.json"), 2).count() == 0
