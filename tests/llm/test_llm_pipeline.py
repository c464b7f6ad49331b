"""The corpus pipeline and the registered queries on the smallest tables."""

import base64
import hashlib
import math
import re
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken
import xxhash

import __spark_entry__
import corpus_pipeline
from keylingo.llm import byte_bpe, simhash, toxicity
from keylingo.llm import queries as registered
from keylingo.llm.common import table
from test_llm_operators import brute_targets

SF = "/root/testdata/sf0.001"


def test_stages_compose(spark):
    docs = table(spark, SF, "documents")
    columns, seen, counts = docs.columns, docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, SF).cache()
        assert seen.columns == columns, name
        counts.append(seen.count())
    assert counts[1] <= counts[0] and counts[2] < counts[1] and counts[3] <= counts[2]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    bpe = byte_bpe.BytePairEncoder.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = corpus_pipeline.STAGES[-1][1](spark, seen, SF).collect()
    assert len(rows) == counts[-1]
    for r in rows:
        assert bpe.decode(r["ids"]).decode() == texts[r["doc_id"]] and r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


@pytest.fixture
def hard(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, equal and near-equal texts, clashing names."""
    prose = " ".join(f"word{n % 97} also{n}" for n in range(60))
    rows = [(n, prose.replace("also7 ", f"other{n} ") if n % 2 else prose, "en", None if n % 3 else f"s{n % 2}", n) for n in range(12)]
    rows += [(None, None, None, None, None), (None, prose, None, None, None), (3, None, "en", "s0", 1), (3, "", "en", "s0", 1), (20, " \n", "de", "s1", 1)]
    rows += [rows[0], rows[0], (21, "long text " * 30_000, "en", "s1", 1), (22, "y" * 20_000, "en", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "'a' AS row_key", "'b' AS toxicity", "'c' AS fp", "'d' AS block", "'e' AS words", "'f' AS row", "'g' AS ids")


def test_stages_take_hard_rows_and_empty_tables(spark, hard):
    for docs in (hard, hard.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert set(out.distinct().collect()) <= set(docs.distinct().collect()), name
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


def test_stages_keep_one_row_of_each_group(spark, hard):
    stages = dict(corpus_pipeline.STAGES)
    bare = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    rows = hard.collect()
    once = stages["exact_dedup"](spark, hard, SF)
    assert sorted(bare(r["text"]) for r in once.collect()) == sorted({bare(r["text"]) for r in rows})
    # by brute force over all pairs: a component of fingerprints within 4 bits keeps one row
    prints = sorted({simhash.fingerprint((r["text"] or "").encode()) & (1 << 64) - 1 for r in rows})
    root = {p: p for p in prints}
    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 4:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {p: new if q == old else q for p, q in root.items()}
    left = [simhash.fingerprint((r["text"] or "").encode()) & (1 << 64) - 1 for r in stages["simhash_near_dedup"](spark, hard, SF).collect()]
    assert sorted(root[p] for p in left) == sorted(set(root.values()))
    clean = stages["toxicity"](spark, hard, SF)
    assert clean.count() == hard.count()


def test_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert set(registered.queries()) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in registered.queries()} == {f"op{n}" for n in range(1, 14)}


def plain_pipeline(spark, rows, labels):
    """All stages on (doc_id, text, source) in plain Python, from the learned lexicon on: rows (doc_id, n_tokens, digest of ids, digest of text)."""
    lexicon = toxicity.fit(table(spark, SF, "documents"), labels)
    rows = [r for r in rows if lexicon.score(r[1] or "") < 0.5]
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    rows = [min(g, key=lambda r: (-len(r[1] or ""), r[0])) for g in groups.values()]
    prints = {r[0]: simhash.fingerprint((r[1] or "").encode()) & (1 << 64) - 1 for r in rows}
    root = {i: i for i in prints}
    for a in sorted(prints):
        for b in sorted(prints):
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4 and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if x == old else x for i, x in root.items()}
    rows = [r for r in rows if root[r[0]] == r[0]]
    sizes, streams = Counter(), {}
    for i, text, source in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += n
        seed = xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42)
        streams.setdefault(source, []).append((xxhash.xxh64_intdigest(n.to_bytes(8, "little"), seed) % (1 << 31), i, n, text))
    target, mixed = brute_targets(sizes), []
    for source, stream in streams.items():
        at = 0
        for again in range(2):
            for _, i, n, text in sorted(stream, key=lambda x: x[:3]):
                words = max(0, min(n, math.floor(target[source]) - at))
                mixed += [(i, text)] if words and words * 2 >= n else []
                at += n
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha, out = lambda raw: hashlib.sha256(raw).hexdigest(), Counter()
    for i, text in mixed:
        ids = library.encode_ordinary(text or "")
        out[i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())] += 1
    return out


def test_whole_pipeline_against_plain_python(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    want = plain_pipeline(spark, [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], labels)
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and max(want.values()) == 2 and 50 < len(want) < docs.count()


def test_sql_agrees(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in registered.oracle_sql().items():
        df = registered.queries()[name](spark, SF)
        cursor = con.execute(sql)
        columns = [c[0] for c in cursor.description]
        order = [df.columns.index(c) for c in columns]
        assert sorted(tuple(map(str, (r[n] for n in order))) for r in df.collect()) == sorted(tuple(map(str, r)) for r in cursor.fetchall())
