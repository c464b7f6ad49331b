"""Tokenizer alignment, importance resampling and licence scans against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from keylingo.llm import alignment, license_scan, queries, resample
from test_llm_operators import SCHEMA, documents

A, B = public_tokenizers.path(queries.BYTE_BPE_JSON), public_tokenizers.path(queries.PIECE_BPE)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

LICENCES = [
    "Licensed under CC BY-NC 4.0.", "cc by cc by, CC\nBY", "ccby cc-by! c c by", "the GNU general  public-license; GENERAL PUBLIC LICENSE", "all rights were reserved. All rights reserved",
    "Released under the MİT License", "Released under the MIT License.", "Released beneath the MIT License.", "x " * 3000 + "All Rights Reserved " * 40,
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "worK general public license K",
    "Redistribution and use in source and binary forms, with or without changes, are permitted", "Redistribution of use in source and binary forms, with or without modification, are permitted",
    "<|endoftext|> ▁ x", "tab\tand  two\n\nlines\r\n", " x  y", "﻿​word", "a\nb c\n", " lead", "\x00\x1f",
]


def rows():
    found = documents()
    rest = found[0][2:]
    return found + [(2000 + n, t, *rest) for n, t in enumerate(LICENCES)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = queries.queries()[name](spark, folder)
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(cursor.fetchall())


# alignment


def spans(tokens):
    at, out = 0, []
    for t in tokens:
        out.append((at, at := at + len(t)))
    return out


@pytest.fixture(scope="module")
def plain_align():
    """Tokens and links of a text by the libraries' plain calls and comparison of byte ranges."""
    a, b, own = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), alignment.aligner(A, B)
    a.encode_special_tokens = True

    def of(text):
        if not text:
            return alignment.NOTHING
        ids_a, ids_b, raw = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
        bytes_a, bytes_b = ([table[i] for i in ids] for table, ids in ((own.bytes_a, ids_a), (own.bytes_b, ids_b)))
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            return alignment.NOTHING
        of_a, of_b, links, first = spans(bytes_a), spans(bytes_b), [], 0
        for i, (start, end) in enumerate(of_a):
            while of_b[first][1] <= start:
                first += 1
            j = first
            while j < len(of_b) and of_b[j][0] < end:
                links.append((ids_a[i], ids_b[j]))
                j += 1
        groups, shared, last = [], 0, 0
        for end in sorted({e for _, e in of_a} & {e for _, e in of_b}):
            part_a, part_b = ([str(i) for i, s in zip(ids, sp, strict=True) if last < s[1] <= end] for ids, sp in ((ids_a, of_a), (ids_b, of_b)))
            groups.append(",".join(part_a) + "|" + ",".join(part_b))
            shared += len(part_a) * len(part_b)
            last = end
        return alignment.Aligned(np.array(links, "<u2").tobytes(), ";".join(groups), len(ids_a), len(ids_b), len(groups), shared)

    return of


@pytest.mark.parametrize(("seed", "memo"), [(3, alignment.MEMO), (4, 700), (5, 3)])
def test_texts_align_as_plain_calls_do(plain_align, seed, memo):
    rng = random.Random(seed)
    parts = list("abcdeE'sS 1,.!?-é日😀ﬁ\t\r\x00\x1f\x85 　​﻿") + [" ", "\n", "  ", "\n\n", "<|endoftext|>", "<s>", "<0x41>", "the", "ing", "'re", " the", "▁"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 16), weights=[4] * (len(parts) - 1) + [1])) for _ in range(6000)]
    texts += [t + " " + "x" * 60 for t in texts[:200]]
    own = alignment.Aligner(A, B, memo)
    assert own.by_chunk
    got = [x for at in range(0, len(texts), 400) for x in own.texts(texts[at : at + 400])]
    assert got == list(map(plain_align, texts))
    assert sum(x.n_a > 0 for x in got) > 3000
    assert 0 < len(own.memo) <= memo or memo == 3


def test_products_against_dense_matrices():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n, k, m = rng.integers(1, 9, 3)
        x, y = rng.integers(0, 3, (n, k)) * (rng.random((n, k)) < 0.4), rng.integers(0, 3, (k, m)) * (rng.random((k, m)) < 0.4)

        def sparse(d):
            at = [np.flatnonzero(r) for r in d]
            return alignment.CSR(np.concatenate([[0], np.cumsum([len(r) for r in at])]).astype(np.int64), np.concatenate(at).astype(np.int64), d[d != 0].astype(np.int64), d.shape[1])

        def dense(c):
            out = np.zeros((len(c.indptr) - 1, c.width), np.int64)
            for i in range(len(out)):
                out[i, c.indices[c.indptr[i] : c.indptr[i + 1]]] = c.values[c.indptr[i] : c.indptr[i + 1]]
            return out

        assert (dense(sparse(x) @ sparse(y)) == x @ y).all() and (dense(sparse(x).transposed()) == x.T).all()


@pytest.mark.parametrize("head", [5, alignment.HEAD])
def test_link_counts(docs, empty, plain_align, monkeypatch, head):
    got = alignment.link_counts(docs, A, B, head=head).collect()
    found = [(r[0], plain_align(r[1])) for r in rows()]
    links = [[tuple(p) for p in np.frombuffer(x.links, "<u2").reshape(-1, 2).tolist()] for _, x in found]
    counts, most = Counter(p for each in links for p in each), {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    want = Counter(
        (i, x.n_a, x.n_b, x.n_groups, len(each), sum(counts[p] == most[p[1]] for p in each), sum(counts[p] for p in each), hashlib.sha256(x.groups.encode()).hexdigest() if x.n_a else "", x.n_shared)
        for (i, x), each in zip(found, links, strict=True)
    )
    assert Counter(map(tuple, got)) == want
    if head == 5:
        assert alignment.link_counts(empty, A, B).count() == 0


# resampling


def plain_resample(found, target, max_n, buckets=10_000, min_words=20):
    features = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]
    each = [(i, words(t)) for i, t in found]
    of = [features(w) for _, w in each]
    s, t = Counter(b for x in of for b in x), Counter(b for x in target for b in features(words(x)))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (n_s + buckets)) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]
    out, may = [], []
    for (i, w), x in zip(each, of, strict=True):
        weight = math.floor(sum(gain[b] for b in x) / len(x)) if x else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(w), len(x), weight, score))
        if len(w) >= min_words:
            may.append((-score, i is None, i or 0))
    return out, sorted(may)[: 10 * len(may) // 100]


@pytest.mark.parametrize(("max_n", "head"), [(1, 65_536), (1, 7), (2, 65_536), (2, 9), (3, 11)])
def test_resample(spark, docs, monkeypatch, max_n, head):
    monkeypatch.setattr(resample, "PIECE", 300)
    target = ["one two a b", "axx bbx é漢", None, "", " ".join(rows()[8][1].split()[:30])]
    got = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), max_n=max_n, head=head).collect()
    want, drawn = plain_resample([r[:2] for r in rows()], target, max_n)
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    chosen = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in chosen] == list(range(1, len(drawn) + 1))
    assert [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in chosen] == drawn


def test_resample_of_empty_tables(spark, docs, empty):
    nothing = spark.createDataFrame([], "text string")
    assert resample.resample(empty, nothing).count() == 0
    got = resample.resample(docs, nothing).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(plain_resample([r[:2] for r in rows()], [], 1)[0])


def test_frequent_keeps_to_its_bound(spark):
    from keylingo.llm.common import Scratch

    counted = spark.range(2000).selectExpr("id", "1 + id % 50 as n")
    for head in (0, 3, 60, 1999, 5000):
        found = resample.frequent(counted, head, Scratch(spark, "test"), f"t{head}")
        assert len(found) <= head and len(found) >= min(head, 2000) - 80
        rest = {r["id"] for r in counted.collect()} - {r["id"] for r in found}
        assert not found or not rest or min(r["n"] for r in found) > max(1 + i % 50 for i in rest)


def test_words_are_whole_in_any_pieces():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices("aZé9 -\n/\x7f{", k=rng.randint(0, 60)))
        assert [w.decode() for part in resample.pieces(text.encode(), 5) for w in part] == words(text)


# licences


def plain_scan(texts):
    """Every template against every place of every text."""
    found, templates = [words(t) for t in texts], license_scan.BASE + license_scan.TEMPLATES
    seen = Counter(w for x in found for w in set(x))
    postings = license_scan.index(templates, seen, len(found))
    out = []
    for x in found:
        base, labels, score = [], set(), 0.0
        for t, template in enumerate(templates):
            own = [p for p in postings if p[0] == t]
            for start in range(-len(own), len(x)):
                there = [0 <= start + p[2] < len(x) and x[start + p[2]] == p[1] for p in own]
                if sum(y for y, p in zip(there, own, strict=True) if p[4]) < (sum(p[4] for p in own) + 1) // 2 or not all(y for y, p in zip(there, own, strict=True) if p[5]):
                    continue
                share = round(sum(p[3] for y, p in zip(there, own, strict=True) if y) / sum(p[3] for p in own), 6)
                if share >= license_scan.SHARE:
                    labels.add(template.label)
                    score = max(score, min(1.0, share))
                    if template.base:
                        base.append((start, template.label))
        starts = [s for s, _ in base]
        out.append((len(x), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({n for _, n in base})), ",".join(sorted(labels)), score))
    return out


def test_license_scan(docs, empty):
    got = license_scan.scan(docs).collect()
    want = plain_scan([r[1] for r in rows()])
    key = lambda i, x: (i, *x[:-1], round(x[-1], 5))
    assert Counter(key(r[0], tuple(r)[1:]) for r in got) == Counter(key(r[0], x) for r, x in zip(rows(), want, strict=True))
    assert license_scan.scan(empty).count() == 0


def test_license_labels(spark):
    rest = rows()[0][2:]
    of = {r["doc_id"]: (r["base_labels"], r["labels"]) for r in license_scan.scan(spark.createDataFrame([(n, t, *rest) for n, t in enumerate(LICENCES)], SCHEMA)).collect()}
    assert of[0] == ("cc-by", "cc-by,cc-by-nc") and of[3][0] == "gpl" and of[4] == ("reserved", "reserved") and of[2] == ("cc-by", "cc-by")
    assert of[5] == ("", "") and of[6] == ("", "mit") and of[9] == ("", "isc") and of[11] == ("", "bsd") and of[12] == ("", "")


def test_license_scan_runs_without_python(docs):
    plan = license_scan.scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian", plan)


def test_keys_are_part_of_their_templates():
    for t in license_scan.BASE + license_scan.TEMPLATES:
        found, keys = license_scan.words_and_keys(t)
        assert keys and found == words(t.text)


def test_helpers_take_clashing_names(spark, docs):
    from keylingo.llm import byte_bpe, toxicity

    path, pattern = public_tokenizers.path(queries.BYTE_BPE), public_tokenizers.PATTERN
    some = docs.where("length(text) < 2000")
    coded = byte_bpe.encode_documents(some, path, pattern)
    assert coded.columns == [*docs.columns, "ids_"]
    back = byte_bpe.decode_documents(coded, path, pattern, ids_col="ids_", out_col="TEXT")
    assert back.columns[-1] == "TEXT_" and all(bytes(r["TEXT_"]).decode() == r["text"] and r["ids"] == "i" for r in back.collect())
    labels = spark.createDataFrame([(r[0], int(i % 2)) for i, r in enumerate(rows()) if r[0] is not None], "doc_id long, toxic int")
    scored = toxicity.score(some, toxicity.fit(some, labels), out_col="Score")
    assert scored.columns[-1] == "Score_" and all(0 <= r["Score_"] <= 1 for r in scored.collect())
