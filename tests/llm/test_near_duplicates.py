"""Near-duplicates at other numbers of partitions, and ids with several texts."""

import collections
import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import minhash_forest, shared
from fieldspark.llm import textbytes as tb


def variants(n, seed=1):
    """n documents in pairs: one text and the same with one word of 100 changed at its end."""
    rng = random.Random(seed)
    rows = []
    for k in range(n // 2):
        words = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-4], "x", "y", "z", "q"]))]
    return rows


@pytest.fixture
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize(("parts", "n", "rows"), [(1, 12, 1 << 13), (200, 2, 1), (40, 60, 1)])
def test_no_link_is_lost_at_any_number_of_partitions(spark, partitions, monkeypatch, parts, n, rows):
    """With ROWS = 1 the forest is dealt to as many partitions as there are, so that nearly no row has a neighbour."""
    monkeypatch.setattr(minhash_forest, "ROWS", rows)
    docs = spark.createDataFrame(variants(n), "doc_id long, text string").coalesce(2)
    partitions(parts)
    out = minhash_forest.components(docs, shingle=3, num=85, den=100).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: i - i % 2 for i in range(n)}


def brute(rows, size, num, den):
    """The smallest id that each id reaches by links of any of its texts."""
    sets = [(i, minhash_forest.shingle_set(t, size)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, s), (j, t) in itertools.combinations(sets, 2):
        both = len(s & t)
        if both and den * both >= num * len(s | t):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in root}


def test_an_id_with_several_texts_has_the_links_of_all(spark):
    rows = [(i + 1, t) for i, t in variants(24, seed=3)]
    text = dict(rows)
    rows += [(5, text[2]), (9, text[12]), (9, text[16] + " more"), (9, None), (30, text[1]), (30, text[3]), (31, ""), (31, "a b"), (31, "a b")]
    docs = spark.createDataFrame([*rows, (None, text[1])], "doc_id long, text string").repartition(3)
    out = minhash_forest.components(docs, shingle=3, num=85, den=100).collect()
    assert len(out) == len(rows) + 1
    want = brute(rows, 3, 85, 100)
    assert {(r.doc_id, r.component_id) for r in out if r.doc_id is not None} == set(want.items())
    assert [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(None, False)]
    sizes = collections.Counter((i, len(minhash_forest.shingle_set(t, 3))) for i, t in rows)
    assert collections.Counter((r.doc_id, r.n_shingles) for r in out if r.doc_id is not None) == sizes
    kept = {r.doc_id for r in minhash_forest.keep_one(docs, shingle=3, num=85, den=100).collect()}
    assert kept == {None} | {i for i, c in want.items() if i == c}


def test_a_pair_is_made_under_the_first_key_it_shares(spark):
    """Sets that share nearly all of 60 keys, and sets that share a few: every pair that shares a key is made, mostly once."""
    rng = random.Random(4)
    keys = {i: set(rng.sample(range(60), 58)) for i in range(12)} | {i: set(rng.sample(range(100, 400), 25)) for i in range(12, 40)}
    rows = [(i, k) for i, ks in keys.items() for k in ks]
    held = minhash_forest._with_earlier(spark.createDataFrame(rows, "id long, key long")).cache()
    other = held.select("key", F.col("id").alias("id_b"), F.col("earlier").alias("earlier_b"))
    met = [tuple(r) for r in minhash_forest._meeting(held, other, F.lit(True)).collect()]
    want = {(a, b) for a, b in itertools.permutations(keys, 2) if a > b and keys[a] & keys[b]}
    assert set(met) == want
    near = [p for p in met if p[0] < 12]
    assert len(near) <= 2 * len(set(near))  # some 56 times before
    assert {r.id: r.pop for r in held.collect()} == {i: len(ks) for i, ks in keys.items()}


def test_texts_go_to_workers_in_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    def most():
        return rows.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0]

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("some words "), 400).alias("text"))
    before = spark.conf.get(name)
    with shared.small_batches(spark):
        assert most() <= shared.BATCH + 10_000
    assert spark.conf.get(name) == before
    assert most() > 2 * shared.BATCH
    spark.conf.set(name, "1m")
    try:
        with shared.small_batches(spark):
            assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)


def test_a_worker_gives_memory_back_after_its_rows():
    """What a task's arrays took is free again; an error inside passes through."""
    out = list(tb.released(lambda batches: (b for b in batches))(iter([1, 2])))
    assert out == [1, 2]
    with pytest.raises(ZeroDivisionError):
        list(tb.released(lambda batches: (1 // b for b in batches))(iter([0])))
