"""Repeated passages where one id has several texts."""

import collections
import hashlib
import random

import numpy as np

from fieldspark.llm import suffix_dedup


def brute(rows, length=50):
    first = {}
    for i, t in sorted((i, t or "") for i, t in rows if i is not None):
        raw = t.encode()
        for p in range(len(raw) - length + 1):
            first.setdefault(raw[p : p + length], i)
    out = collections.Counter()
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1) if i is not None else ():
            if first[raw[p : p + length]] < i:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[i, len(raw), int(gone.sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_each_text_of_an_id_loses_its_own_spans(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, other = text(80), text(90)
    rows = [(1, text(200) + shared + text(50)), (2, text(300) + shared), (2, text(400)), (3, other + text(60)), (3, text(100) + other), (3, None), (4, other), (4, other + shared), (4, other)]
    rows += [(5, rows[0][1]), (5, text(70)), (6, shared[:49]), (None, shared), (None, None)]
    docs = spark.createDataFrame([(i, t, 7, 8) for i, t in rows], "doc_id long, text string, text_hash int, cut_code int").repartition(3)
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.cut(docs).collect())
    assert got == brute(rows)
    texts = suffix_dedup.cut_texts(docs)
    assert texts.columns == docs.columns
    digests = collections.Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in texts.collect())
    assert digests == collections.Counter((k[0], k[3]) for k in got.elements())
