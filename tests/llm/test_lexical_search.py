"""Ranked search against scores of all pairs by plain loops."""

import collections
import math
import random
import re

import numpy as np
import pytest

from fieldspark.llm import lexical_search as ls
from fieldspark.llm import queries


def terms(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def literal(docs, items, k=50):
    """(position of the item, rank, doc_id, score), reading the contract word by word."""
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    documents, words = len(bags), sum(n for _, _, n in bags)
    df = collections.Counter(t for _, b, _ in bags for t in b)
    out = []
    for at, text in enumerate(items):
        scored = []
        for i, b, n in bags:
            m = 50 + 50 * n * documents // words
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 20 * m)) for t in set(terms(text)) if b[t])
            if score > 0:
                scored.append((-score, math.inf if i is None else i))
        out += [(at, r, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgé日") for _ in range(rng.randint(1, 5))) for _ in range(150)]
    texts = [None, "", " ,.- ", "ONE", "One\x00two!three", "ÄÖ äö"] + [" ".join(rng.choice(vocabulary[: rng.choice([10, 150])]) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[9]), (None, texts[10]), (7, texts[7]), (9000, texts[8] * 300)] + [(1000 + i, texts[20]) for i in range(70)]
    items = [None, "", "?!", "one", texts[20], texts[8], "nowhere", " ".join(vocabulary)] + [" ".join(rng.choice(vocabulary) for _ in range(20)) for _ in range(12)]
    return docs, items


@pytest.mark.parametrize(("width", "docs_at_once", "items_at_once", "step", "seed"), [(1024, 512, 256, 64, 64), (4, 7, 3, 2, 2), (1, 50, 5, 1, 1)])
def test_search_equals_scoring_every_pair(spark, rows, monkeypatch, width, docs_at_once, items_at_once, step, seed):
    for name, value in (("WIDTH", width), ("DOCS", docs_at_once), ("ITEMS", items_at_once), ("STEP", step), ("SEED", seed)):
        monkeypatch.setattr(ls, name, value)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows[0]], "doc_id long, text string, score int, terms string").repartition(5)
    items = spark.createDataFrame([(i // 2, t, 3) for i, t in enumerate(rows[1])], "item_id int, text string, rank int")
    got = ls.search(docs, items, k=50)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and [f.dataType.simpleString() for f in got.schema] == ["int", "int", "bigint", "bigint"]
    # Two queries share an id here, so rows are compared as those of both.
    want = sorted((at // 2, r, str(i), s) for at, r, i, s in literal(*rows))
    assert sorted((r.item_id, r["rank"], str(r.doc_id), r.score) for r in got.collect()) == want


def test_bounds_hold():
    rng = np.random.default_rng(2)
    search = ls.Search([[0, 1, 2], [3], []], np.array([0, 0, 5, 1023]), 2, np.ones(3, np.int64))
    row, term = np.repeat(np.arange(6), 3), np.tile([0, 1, 3], 6)
    impact = rng.integers(1, 10**10, 18)
    search.show(np.arange(6), row, term, impact)
    scores = np.zeros((6, 4), np.int64)
    scores[row, term] = impact
    for q, own in enumerate(([0, 1, 2], [3])):
        want = sorted(((int(s), i) for i, s in enumerate(scores[:, own].sum(axis=1))), key=lambda x: (-x[0], x[1]))[:2]
        assert list(zip(search.score[q].tolist(), search.id[q].tolist(), strict=True)) == want
    assert not len(search.id[2])


def test_empty_tables_and_limits(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a"), (2, "b")], "item_id long, text string")
    assert ls.search(docs.limit(0), items).count() == 0 and ls.search(docs, items.limit(0)).count() == 0
    assert ls.search(docs, items, k=1).count() == 2
    with pytest.raises(ValueError, match="queries"):
        ls.search(docs, items, max_items=1)
    with pytest.raises(ValueError, match="terms"):
        ls.search(docs, items, max_terms=1)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    got = sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in queries.op12_max_sketch_search(spark, sf).collect())
    assert got == sorted((items[at].item_id, r, i, s) for at, r, i, s in literal(docs, [r.text for r in items]))
