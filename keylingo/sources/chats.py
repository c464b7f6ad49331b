"""Chat exports of any size: one JSON file in many tasks.

A JSON string holds no raw line end, so every line of an export begins outside of
strings, wherever a file is cut. What is unknown at a cut is only which objects
and lists are open. So lines are folded in blocks: a block says how many
containers it closes that were open before it and which ones it leaves open, a
scan over these summaries tells each block what is open where it begins, and
then it knows its messages. Parts of a message are put together by where it began.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import blocks as S

_TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)"|[:\[\]{}]')
#: Containers by kind and key that lead to a message, from the root: messages at the root, or in the chats of a list of chats.
_PATHS = ((("{", ""), ("[", "messages")), (("{", ""), ("{", "chats"), ("[", "list"), ("{", ""), ("[", "messages")))
#: Longer strings are no keys that matter.
_KEY = 64

#: (kind, key, place) of an open container.
Open = tuple[str, str, str]


def _tokens(line: str) -> Iterator[tuple[int, str, str | None]]:
    """(place, mark, string) of what tells the structure of a line."""
    for m in _TOKEN.finditer(line):
        yield m.start(), m[0][0], m[1]


def _step(stack: list[Open], key: str | None, said: str | None, mark: str, string: str | None, place: str) -> tuple[str | None, str | None, Open | None]:
    """Opens or closes a container. (key, said, closed): the key that the next value has, the last string, and what was closed."""
    if mark == '"':
        return None, string if len(string) <= _KEY else None, None
    if mark == ":":
        return said, None, None
    if mark in "[{":
        stack.append((mark, key if key is not None else "", place))
        return None, None, None
    return None, None, stack.pop() if stack else ("", "", "")


def _is_message(stack: list[Open]) -> bool:
    return stack[-1][0] == "{" and tuple(x[:2] for x in stack[:-1]) in _PATHS


#: Stand for the key and the string that are pending where a block begins.
_KEY_BEFORE, _SAID_BEFORE = "\0key", "\0said"


def _summary(rows) -> tuple:
    """How many containers of before a block closes, what it leaves open, and the key and string that are pending at its end."""
    stack: list[Open] = []
    closes, key, said = 0, _KEY_BEFORE, _SAID_BEFORE
    for _, _, line, text, *_ in rows:
        for at, mark, string in _tokens(text):
            closes += mark in "]}" and not stack
            key, said, _ = _step(stack, key, said, mark, string, f"{line}:{at}")
    return closes, stack, key, said


def _opened(containers) -> list[Open]:
    return [tuple(x.values()) if isinstance(x, dict) else x for x in containers]


def _carry(state: tuple | None, done: tuple) -> tuple:
    """What is open and pending after a block."""
    before, key, said = state or ([], None, None)
    closes, opened, ends_key, ends_said = done
    real = {_KEY_BEFORE: key, _SAID_BEFORE: said}
    opened = [(kind, real.get(name, name) or "", place) for kind, name, place in _opened(opened)]
    return [*before[: max(0, len(before) - closes)], *opened], real.get(ends_key, ends_key), real.get(ends_said, ends_said)


def _run(state: tuple | None, rows) -> Iterator[tuple]:
    """(file, message, line, part): the parts of messages, by the place where each began."""
    stack = _opened(state[0]) if state else []
    key, said = state[1:] if state else (None, None)
    message = next((stack[n][2] for n in range(len(stack)) if _is_message(stack[: n + 1])), None)
    for file, begins, line, text, *_ in rows:
        since = 0
        for at, mark, string in _tokens(text):
            key, said, closed = _step(stack, key, said, mark, string, f"{line}:{at}")
            if closed and closed[2] == message:
                yield file, message, begins, line, text[since : at + 1]
                message = None
            elif message is None and mark == "{" and _is_message(stack):
                message, since = stack[-1][2], at
        if message is not None:
            yield file, message, begins, line, text[since:]


def read_messages(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """(message variant) of exports with ``messages`` at the root or under ``chats.list``, a row a message.

    A file may be of any size, its lines of up to 2 GB. A message that a file
    breaks off in is none; an export without messages gives no rows.
    """
    read = spark.read.text(path)
    lines = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begins"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))
    placed = S.dealt(lines, ("file",), ("begins", "line"), parts)
    opened = "array<struct<kind:string,key:string,place:string>>"
    schema = T.StructType.fromDDL("file string, message string, begins bigint, line bigint, part string")
    found = S.folded(
        placed, "file", ("begins", "line"), _summary, f"closes int, opened {opened}, key string, said string", _carry, f"opened {opened}, key string, said string", _run, schema
    )
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begins", "line", "part"))), lambda x: x["part"]), "\n")
    return found.groupBy("file", "message").agg(F.try_parse_json(whole).alias("message_json")).where("message_json is not null").select(F.col("message_json").alias("message"))
