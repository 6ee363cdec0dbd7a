"""Periodic runs against plain loops over all periods, and the query's rows against a literal reading of its contract."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from fieldspark.llm import periodic_runs, queries

WORD = r"[^\x20\x09-\x0D]+"


def brute(x, minimum=12):
    found = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            if x[i] == x[i + q]:
                j = i
                while j + q < len(x) and x[j] == x[j + q]:
                    j += 1
                if j + q - i >= max(minimum, 2 * q):
                    found.setdefault((i, j + q - i), q)
                i = j
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def found(x, minimum=12):
    return [tuple(r) for r in periodic_runs.runs_of(np.array(x, np.int64), minimum).tolist()]


def test_transform_multiplies_exactly():
    rng = np.random.default_rng(1)
    for n in (1, 2, 8, 64):
        a, b = (rng.integers(0, int(periodic_runs.PRIME), (3, n), dtype=np.uint64) for _ in range(2))
        assert (periodic_runs.transform(periodic_runs.transform(a), True) == a).all()
        got = periodic_runs.transform(periodic_runs.transform(a) * periodic_runs.transform(b) % periodic_runs.PRIME, True)
        for k in range(3):
            want = [sum(int(a[k, i]) * int(b[k, (j - i) % n]) for i in range(n)) % int(periodic_runs.PRIME) for j in range(n)]
            assert got[k].tolist() == want


def test_zero_sums_are_the_occurrences():
    x = np.array([1, 2, 1, 2, 9, 1, 2, 7, 1, 2] + [99] * 11, np.uint64)
    squares = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * x)])
    s, d = periodic_runs.occurrences(x, squares, np.array([0, 2]), 2)
    assert sorted(zip(s.tolist(), d.tolist(), strict=True)) == [(0, 5), (2, 3), (2, 6)]


def test_runs_against_brute_force():
    rng = random.Random(2)
    for _ in range(600):
        n, v = rng.randint(1, 200), rng.choice([1, 2, 3, 5, 30])
        x = [rng.randrange(v) for _ in range(n)]
        if rng.random() < 0.6:
            p, a = rng.randint(1, max(1, n // 2)), rng.randrange(n)
            for i in range(a + p, min(n, a + p * rng.randint(2, 9))):
                x[i] = x[i - p]
        assert found(x) == brute(x)
        assert found(x, 2) == brute(x, 2)


def test_words_of_many_runs():
    s, t = [0], [0, 1]
    while len(t) < 700:
        s, t = t, t + s
    for x in (t, [bin(i).count("1") & 1 for i in range(512)], [0] * 700, [0, 1] * 300 + [2] + [0, 1] * 50, [0, 0, 1] * 200 + [0, 0]):
        assert found(x) == brute(x)


def test_seeds_that_are_multiples_of_the_prime_are_refuted(monkeypatch):
    """With a small prime most sums of zero are none."""
    monkeypatch.setattr(periodic_runs, "PRIME", np.uint64(257))
    monkeypatch.setattr(periodic_runs, "GENERATOR", 3)
    monkeypatch.setattr(periodic_runs, "_roots", {})
    rng = random.Random(4)
    for _ in range(60):
        x = [rng.randrange(3) for _ in range(120)]
        x[40:110] = (x[40:57] * 6)[:70]
        assert found(x) == brute(x)


def test_a_very_long_text():
    x = np.random.default_rng(3).integers(0, 300_000, 400_000)
    x[100_000:] = x[100_000 + np.arange(300_000) % 70_000]
    assert found(x) == [(100_000, 300_000, 70_000)]
    assert found(np.zeros(400_000)) == [(0, 400_000, 1)]


def literal(i, text):
    """The contract of the query, read word by word."""
    words = re.findall(WORD, text or "")
    n, h = len(words), zlib.crc32(str(i).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    runs = brute(words)
    drop = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for k, w in enumerate(words) if k not in drop)
    exponent = 1000 * best[1] // best[2] if runs else None
    return (len(runs), *best, exponent, *(hashlib.sha256(t.encode()).hexdigest() for t in (listed, kept)))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    texts = [None, "", " \n ", "one", "é  日本\tx\x1cy a\x85b"] + [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 150))) for _ in range(60)]
    texts += ["\t".join(["new", "line\n"] * rng.randint(4, 30)) + t for t in texts[5:25]]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(7, texts[7], 1, "x"), (None, "a b " * 9, 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, runs string").repartition(3)


def test_table_and_digests(docs, monkeypatch):
    rows = docs.where("doc_id is not null").collect()
    want = sorted((r.doc_id, *map(str, literal(r.doc_id, r.text))) for r in rows)
    for size in (1 << 20, 200):
        monkeypatch.setattr(periodic_runs, "CHUNK", size)
        out = periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_planted_runs(docs.where("doc_id is not null"))))
        assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        assert sorted((r[0], *map(str, r[1:])) for r in out.collect()) == want
    assert any(zlib.crc32(str(r.doc_id).encode()) % 10 == 0 and r.text for r in rows)


def test_runs_are_taken_out_of_texts(docs):
    got = [r for r in periodic_runs.periodic_runs(docs).collect() if r.doc_id is None]
    assert [(r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got] == [(18, [(0, 18, 2)], "a b")]
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    for r in itertools.islice((r for r in docs if len((r.text or "").split()) < 800), 80):
        assert got[r.doc_id] == literal(r.doc_id, r.text)
