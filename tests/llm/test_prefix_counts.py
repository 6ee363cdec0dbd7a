"""Prefix counts against the library, which encodes every prefix anew."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import prefix_counts, queries

PIECES = [
    "a", "the ", " the", " ", "  ", "\n", "\n\n", "\t", " \n ", "'re", "'s", "'ll", "'", "’", " 12", "3", "!?", "--------", "é", "日本", "語", "　", " ", "\x85", "\x1c",
    "՘", "՜", "\U0003fc3b", "<|endoftext|>", "<|endof", "|>", "hello world", "unbelievable", " internationalization", "aaaaaaa", "\U0001f600", "THE", "'R", "\r\n", "ſ", "\x00",
]
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def lengths(library, texts):
    return [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_every_prefix_equals_the_library(library):
    with open(PATH, "rb") as file:
        count = prefix_counts.PrefixCounter(file.read(), public_tokenizers.PATTERN)
    rng = random.Random(3)
    for _ in range(600):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 12)))
        assert count.counts(text).tolist() == lengths(library, [text[:i] for i in range(1, len(text) + 1)]), repr(text)
    long = "xyzzy" * 20_000 + " " * 3000 + "end"
    got = count.counts(long)
    assert [int(got[i - 1]) for i in (99_999, 100_000, 101_500, 103_000, 103_003)] == lengths(library, [long[:i] for i in (99_999, 100_000, 101_500, 103_000, 103_003)])


def test_bounded_tables_change_nothing(library, monkeypatch):
    monkeypatch.setattr(prefix_counts, "ROWS", 50)
    monkeypatch.setattr(prefix_counts, "PAIRS", 20)
    with open(PATH, "rb") as file:
        count = prefix_counts.PrefixCounter(file.read(), public_tokenizers.PATTERN)
    rng = random.Random(4)
    texts = ["".join(rng.choice(PIECES) for _ in range(30)) for _ in range(100)]
    assert [int(count.counts(t)[-1]) for t in texts] == lengths(library, texts)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "é", "<|endoftext|>", "line\n\n\nline"] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = [(i, t, 7, "x") for i, t in enumerate(texts)] + [(3, "é", 7, "x"), (None, "no id", 7, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, counts int, id string").repartition(3)


def test_counts_of_a_table(docs, library, spark):
    rows = docs.collect()
    got = prefix_counts.token_counts(docs, PATH, public_tokenizers.PATTERN, limit=20).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n, n > 20) for r, n in zip(rows, lengths(library, [r.text or "" for r in rows]), strict=True))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert prefix_counts.token_counts(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_truncation_and_budget_need_no_encoding(docs, library):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    table = prefix_counts.prefix_counts(rows, PATH, public_tokenizers.PATTERN).cache()
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    every = {i: lengths(library, [t[:k] for k in range(1, len(t) + 1)]) for i, t in texts.items()}

    def best(i, limit):
        return max((k + 1 for k, n in enumerate(every[i]) if n <= limit), default=0)

    for limit in (0, 1, 7):
        out = prefix_counts.truncated(rows, table, limit)
        assert out.columns == rows.columns
        assert {r.doc_id: r.text or "" for r in out.collect()} == {i: t[: best(i, limit)] for i, t in texts.items()}
    assert table.select(prefix_counts.longest_prefix(F.col("counts"), F.lit(None).cast("int")).alias("n")).where("n is not null").count() == 0
    spent = 0
    for r in sorted(prefix_counts.spend(table, 150).collect(), key=lambda r: r.doc_id):
        n = every[r.doc_id][-1] if every[r.doc_id] else 0
        assert (r.n_tokens, r.spent, r.n_chars) == (n, spent, best(r.doc_id, max(0, 150 - spent)))
        spent += n


def test_other_kinds_of_tokenizers_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as file, pytest.raises(ValueError, match="byte-level"):
        prefix_counts.PrefixCounter(file.read(), public_tokenizers.PATTERN)


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op13_prefix_counts(spark, sf).collect()}
    assert [got[r.doc_id].n_tokens for r in docs] == lengths(library, [r.text or "" for r in docs]) and len(got) == len(docs)
