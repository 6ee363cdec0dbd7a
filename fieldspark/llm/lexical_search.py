"""Ranked lexical search of a batch of queries over all documents, with hashed max-sketches.

Method. A document's impact for a term is its share of a score (weight of the term times saturated frequency). All its impacts fold
into a sketch: each term has a coordinate by hash, and a coordinate holds the greatest impact of its terms. The sum of a query's
coordinates is no less than the document's score, so a block of sketches times the matrix of queries gives upper bounds for all pairs of
the block at once. Each query then takes the block's documents by descending bound and scores them exactly until the next bound is below
its threshold, the k-th best score known so far. Nothing is estimated: the result is that of scoring every pair.

Steps.
1. One pass over the texts writes each document's length and its frequencies of terms that any query holds (postings).
2. Document frequencies of those terms, the number of documents and of terms are sums over postings; one number a term of the query set comes to the driver.
3. The k-th best score among a share of documents (one in ``SEED`` by hash) is a lower bound for that among all, and the threshold that every task starts with. So
   what tasks emit doesn't grow with their number.
4. Every task searches its documents and emits up to k for each query; a window over the queries ranks them.

Scale. The query set is a stated one: it is collected, bounded by ``max_items`` and ``max_terms`` (an error beyond: search in several
calls), and broadcast. Documents are never collected, and no pair of a query and a document below the threshold is emitted. Inside a task, queries are in blocks of ``ITEMS``, documents in blocks
of ``DOCS``.

Edge cases. A null or empty text has no terms: a document without any isn't counted and never found, a query without any
finds nothing. Equal scores go by ascending id, null ids last. Each row of docs is a document, repeated or not; each row of
items a query. Terms are compared by 64-bit hash and length. Extra columns are ignored. Empty tables give an empty table.
Ids of documents are integers.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import Scratch, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Coordinates of a sketch; documents and queries of a block; documents scored between two looks at the threshold; one document in SEED sets first thresholds.
WIDTH, DOCS, ITEMS, STEP, SEED = 1024, 512, 256, 64, 64
#: Bytes outside terms become a space, A to Z small letters.
FOLD = tb.LOWER.copy()
FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 0x20
NULL_ID = np.iinfo(np.int64).max


def terms_of(text: str | None) -> set[bytes]:
    """The distinct terms of a query."""
    small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return {t.encode() for t in re.findall(TERM, small)}


def hashes(terms: list[bytes]) -> np.ndarray:
    data, at = tb.utf8(pa.array(terms, pa.binary()))
    return tb.span_hash(tb.prefix_hash(data), at[:-1], at[1:])


def postings(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs) of each document with a term: number of terms, and for those of the vocabulary its place there and frequency."""
    code = hashes(vocabulary)
    order = np.argsort(code)
    sizes = np.array([len(t) for t in vocabulary])[order] if vocabulary else np.zeros(0, np.int64)
    known = docs.sparkSession.sparkContext.broadcast((code[order], order.astype(np.int64), sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, places, lengths = known.value
        for batch in batches:
            for lo, hi, data, at in tb.chunks(batch.column(1)):
                data = FOLD[data]
                begin, end, bounds = tb.words(data, at)
                n = np.diff(bounds)
                doc = np.repeat(np.arange(hi - lo), n)
                if len(codes):
                    found = tb.span_hash(tb.prefix_hash(data), begin, end)
                    k = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
                    hit = (codes[k] == found) & (lengths[k] == end - begin)
                    key, tf = np.unique(doc[hit] * len(codes) + places[k[hit]], return_counts=True)
                else:
                    key, tf = np.zeros(0, np.int64), np.zeros(0, np.int64)
                ends = np.searchsorted(key, np.arange(hi - lo + 1) * max(1, len(codes))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key % max(1, len(codes)), tf)]
                rows = pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), *lists], names=["id", "n", "terms", "tfs"])
                yield rows.filter(pa.array(n > 0))

    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return text.mapInArrow(run, "id long, n long, terms array<int>, tfs array<int>")


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, documents: int, words: int) -> np.ndarray:
    """Shares of a score, in 64-bit integers; tf, n and weight of each posting."""
    m = 50 + 50 * n * documents // words
    return weight * (1_000_000_000 * tf // (1000 * tf + 20 * m))


class Search:
    """The best k documents of each query among those that were shown to it."""

    def __init__(self, items: list[list[int]], coordinate: np.ndarray, k: int, least: np.ndarray):
        self.items, self.k, self.coordinate = [np.array(t, np.int64) for t in items], k, coordinate
        self.least = least.copy()
        self.score = [np.zeros(0, np.int64) for _ in items]
        self.id = [np.zeros(0, np.int64) for _ in items]
        self.blocks = []
        for lo in range(0, len(items), ITEMS):
            part = range(lo, min(lo + ITEMS, len(items)))
            terms = np.unique(np.concatenate([self.items[q] for q in part]))
            matrix = np.zeros((WIDTH, len(part)))
            for q in part:
                np.add.at(matrix[:, q - lo], coordinate[self.items[q]], 1)
            place = np.full(len(coordinate), -1)
            place[terms] = np.arange(len(terms))
            self.blocks.append((part, terms, place, matrix))

    def show(self, ids: np.ndarray, row: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        """Takes a block of documents: their ids, and row, term and impact of each posting."""
        sketch = np.zeros((len(ids), WIDTH))
        np.maximum.at(sketch.reshape(-1), row * WIDTH + self.coordinate[term], impact.astype(np.float64))
        for part, terms, place, matrix in self.blocks:
            # Sums of integers below 2^53 are exact as doubles.
            bounds = sketch @ matrix
            exact = np.zeros((len(ids), len(terms)), np.int64)
            mine = place[term] >= 0
            exact[row[mine], place[term[mine]]] = impact[mine]
            for q in part:
                bound = bounds[:, q - part.start]
                order = np.flatnonzero(bound >= self.least[q])
                order = order[np.argsort(-bound[order], kind="stable")]
                own = place[self.items[q]]
                for lo in range(0, len(order), STEP):
                    some = order[lo : lo + STEP]
                    if bound[some[0]] < self.least[q]:
                        break
                    score = exact[np.ix_(some, own)].sum(axis=1)
                    good = score >= self.least[q]
                    if good.any():
                        self.take(q, score[good], ids[some[good]])

    def take(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[q], score]), np.concatenate([self.id[q], ids])
        best = np.lexsort((ids, -score))[: self.k]
        self.score[q], self.id[q] = score[best], ids[best]
        if len(best) == self.k:
            self.least[q] = max(self.least[q], score[best[-1]])


def _searched(table: DataFrame, known) -> DataFrame:
    """(item, score, id) of each task's best documents of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, coordinate, weight, documents, words, k, least = known.value
        search = Search(items, coordinate, k, least)
        for batch in batches:
            for lo in range(0, batch.num_rows, DOCS):
                part = batch.slice(lo, DOCS)
                ids = part.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                n = part.column(1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), np.diff(part.column(2).offsets.to_numpy()))
                term, tf = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
                if len(term):
                    search.show(ids, row, term, impacts(tf, n[row], weight[term], documents, words))
        sizes = [len(s) for s in search.score]
        ids = np.concatenate([*search.id, np.zeros(0, np.int64)])
        columns = [np.repeat(np.arange(len(sizes)), sizes), np.concatenate([*search.score, np.zeros(0, np.int64)])]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(ids, mask=ids == NULL_ID)], names=["item", "score", "id"])

    return table.mapInArrow(run, "item long, score long, id long")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    max_items: int = 100_000,
    max_terms: int = 2_000_000,
) -> DataFrame:
    """(item id, rank, doc_id, score): the k best documents of each query with a score above 0."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_id_col).alias("item"), F.col(item_text_col).alias("text")).limit(max_items + 1).collect()
    if len(asked) > max_items:
        raise ValueError(f"more than {max_items} queries: search in several calls")
    sets = [sorted(terms_of(r.text)) for r in asked]
    vocabulary = sorted(set().union(*sets))
    if len(vocabulary) > max_terms:
        raise ValueError(f"queries hold more than {max_terms} terms: search in several calls")
    place = {t: i for i, t in enumerate(vocabulary)}

    lists = [[place[t] for t in s] for s in sets]
    coordinate = (hashes(vocabulary) % np.uint64(WIDTH)).astype(np.int64)
    scratch = Scratch(spark)
    try:
        table = scratch.written(postings(docs, vocabulary, id_col, text_col), "postings")
        documents, words = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = dict(table.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # at most one row a term of the queries
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * held.get(i, 0) + 1))) for i in range(len(vocabulary))], np.int64)

        def found(rows: DataFrame, least: np.ndarray) -> DataFrame:
            known = spark.sparkContext.broadcast((lists, coordinate, weight, documents, words, k, least))
            rank = F.row_number().over(W.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
            return _searched(rows, known).withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)

        least = np.ones(len(lists), np.int64)
        share = table.where(F.pmod(F.xxhash64("id", "n"), F.lit(SEED)) == 0)
        for r in found(share, least).where(F.col("rank") == k).collect():  # at most one row a query
            least[r.item] = r.score
        best = written(found(table, least), "best")
    finally:
        scratch.drop()
    names = spark.createDataFrame([(i, r.item) for i, r in enumerate(asked)], f"item long, name {items.schema[item_id_col].dataType.simpleString()}")
    return best.join(F.broadcast(names), "item").select(F.col("name").alias(item_id_col), "rank", F.col("id").alias(id_col), "score")


#: The same rows as search() with its defaults, over tables documents and benchmark.
SEARCH_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS terms FROM documents
), size AS (
  SELECT doc_id, len(terms) AS n FROM d WHERE len(terms) > 0
), total AS (
  SELECT count(*) AS documents, sum(n)::BIGINT AS words FROM size
), held AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY doc_id, term
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark
), weights AS (
  SELECT term, floor(1000 * ln((2 * documents + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM held GROUP BY term), total
), scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * documents) // words))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN size USING (doc_id), total GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""
