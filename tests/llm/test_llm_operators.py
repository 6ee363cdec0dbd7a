"""The ten operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import html
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import bpe_tree, fair_queue, knn_quality, lm_scoring, mincut_html, minhash_forest, robust_rules, suffix_dedup, syncmers, warc_revisits
from fieldspark.llm import queries as q
from fieldspark.llm import textbytes as tb

SMALL = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, tree string, a double, class string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Odd texts first, then passages and copies that repeat among plain ones."""
    rng = random.Random(5)
    rows = [None, "", "   \n\t ", "one", "two words", "ÄÖ é ß   日本語 " * 3, "x" * 5000, "a\x00b  c\x1fd", "the same line\n" * 30]
    passage = sentence(rng, 40)
    for i in range(60):
        text = sentence(rng, rng.randint(20, 160))
        if i % 4 == 0:
            text = text[: len(text) // 2] + passage[i : i + 90] + text[len(text) // 2 :]
        rows.append(text)
    base = rows[20].split() + sentence(rng, 200).split()
    for k in range(6):
        words = list(base)
        for j in rng.sample(range(len(words)), k):
            words[j] = "EDIT"
        rows.append(" ".join(words))
    return rows + [rows[12], rows[12], rows[30].upper()]


@pytest.fixture(scope="module")
def docs(spark, texts):
    langs, sources = ["en", "de", None], ["s1", None, "s0", "s2"]
    rows = [(i, t, langs[i % 3], sources[i % 4], 1, 7, "t", 0.5, "c") for i, t in enumerate(texts)]
    rows += [rows[10], (None, "a text without an id " * 5, None, None, None, None, None, None, None)]  # a repeated row, a null id
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def collected(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# Helpers on bytes.


def test_words_and_hashes():
    import pyarrow as pa

    rows = ["", " a bc\td ", None, "é", "\n", "x y"]
    data, at = tb.utf8(pa.array(rows))
    begin, end, bounds = tb.words(data, at)
    got = [[data[b:e].tobytes() for b, e in zip(begin[lo:hi], end[lo:hi], strict=True)] for lo, hi in itertools.pairwise(bounds)]
    assert got == [(r or "").encode().split() for r in rows]
    run = tb.prefix_hash(data)
    assert tb.span_hash(run, np.array([1]), np.array([2]))[0] == tb.span_hash(tb.prefix_hash(np.frombuffer(b"a", np.uint8)), np.array([0]), np.array([1]))[0]
    x = np.array([5, 3, 8, 1, 9, 2])
    assert tb.sliding_min(x, 3).tolist() == [3, 1, 1, 1] and tb.sliding_min(x, 9).tolist() == []


# 1. Language-model scoring.


def test_lm_scores_against_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SLICE", 4000)  # many slices and blocks
    good = spark.createDataFrame([(i,) for i in range(20, 40)] + [(21,), (None,)], "id long")
    out = lm_scoring.score(docs, good).collect()
    rows = [(r.doc_id, [None, *re.findall(WORD.encode(), (r.text or "").encode().lower())]) for r in docs.select("doc_id", "text").collect()]
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out if r.doc_id is not None}

    def counts(runs):
        pair, single = collections.Counter(), collections.Counter()
        for t in runs:
            pair.update(itertools.pairwise(t))
            single.update(t if len(t) > 1 else [])
        return pair, single, sum(len(t) - 1 for t in runs)

    def marked(i):
        return i is not None and 20 <= i < 40

    every, target = counts([t for _, t in rows]), counts([t for i, t in rows if marked(i)])
    for i, t in rows:
        if i is None:
            continue
        assert got[i].n_tokens == len(t) - 1
        if len(t) == 1:
            assert got[i].score is None and got[i].target_loss is None
            continue
        mine = counts([t])
        size = target[2] - mine[2] * marked(i)
        scale = size / (every[2] - mine[2])
        want = []
        for of, by, own in ((target, 1, marked(i)), (every, scale, True)):
            bits = []
            for x, y in itertools.pairwise(t):
                c = [by * (of[k][w] - own * mine[k][w]) for k, w in ((0, (x, y)), (1, y), (1, x))]
                word = (c[1] + lm_scoring.BASE * size * every[1][y] / every[2]) / (size * (1 + lm_scoring.BASE))
                bits.append(-math.log2((c[0] + lm_scoring.PRIOR * word) / (c[2] + lm_scoring.PRIOR)))
            want.append(np.mean(bits))
        assert (got[i].target_loss, got[i].background_loss) == pytest.approx(tuple(want), abs=1e-9)
        assert got[i].score == pytest.approx(want[0] - want[1], abs=1e-9)
    assert lm_scoring.score(docs.limit(0), good).count() == 0
    assert {r.score for r in lm_scoring.score(docs, good.limit(0)).collect()} <= {None, 0.0}


def test_lm_scores_tell_rare_words_apart(spark):
    """Words outside any list of frequent ones count: a text seen twice differs from one seen once."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(60))) for i in range(80)]
    rows += [(100 + i, " ".join(f"x{i // 2}y{k} w{k}" for k in range(30))) for i in range(2)]
    rows += [(200 + i, " ".join(f"z{i}y{k} w{k}" for k in range(30))) for i in range(2)]
    got = collected(lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.range(40)))
    assert min(got[i].score for i in (100, 101)) > max(got[i].score for i in (200, 201)) + 0.5


# 2. Near-duplicates.


def brute_components(rows, size, num, den):
    sets = {i: minhash_forest.shingle_set(t, size) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if both and den * both >= num * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize(("size", "num"), [(3, 85), (5, 80)])
def test_components_against_brute_force(docs, size, num):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    component, count = brute_components(rows, size, num, 100)
    out = minhash_forest.components(docs, shingle=size, num=num, den=100).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (component[r.doc_id], count[r.doc_id], component[r.doc_id] == r.doc_id)
    assert len(set(component.values())) < len(component) - 5


def test_a_hub_is_found_among_many(spark):
    """Sixty variants that are linked with their base only, not with each other."""
    rng = random.Random(8)
    base = sentence(rng, 102).split()
    rows = [(1000, " ".join(base))]
    for k in range(60):
        words = list(base)
        for j in rng.sample(range(1, 100), 2):
            words[j] = f"new{k}x{j}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    component, _ = brute_components(rows, 3, 85, 100)
    assert {r.doc_id: r.component_id for r in minhash_forest.components(df, shingle=3, num=85, den=100).collect()} == component
    kept = minhash_forest.keep_one(df.withColumn("near_id", F.lit(1)), shingle=3, num=85, den=100)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(component.values())) and kept.columns == ["doc_id", "text", "near_id"]
    assert minhash_forest.components(df.limit(0)).count() == 0


def template_rows(seed, n, couples):
    """Texts that share half their shingles; the last ones are couples over the threshold, and far apart by id."""
    rng = random.Random(seed)
    head = sentence(rng, 60)
    rows = [(i, f"{head} {' '.join(f'w{i}x{j}' for j in range(30))}") for i in range(n)]
    for k in range(couples):
        mine = [f"c{k}x{j}" for j in range(32)]
        rows.append((10_000 + k, f"{head} {' '.join(mine)}"))
        rows.append((20_000 + 7919 * k % 1000, f"{head} {' '.join(mine[:-4])} y{k} z{k} q{k} r{k}"))
    return rows


def test_pairs_that_meet_in_no_whole_key(spark):
    """One tree of eight minima: most couples share less than its whole key, and are neither neighbours nor leaders."""
    rows = template_rows(1, 150, 40)
    component, _ = brute_components(rows, 3, 85, 100)
    assert len(component) - len(set(component.values())) == 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in minhash_forest.components(df, shingle=3, num=85, den=100, trees=1).collect()} == component


def test_sets_that_the_forest_never_pairs(spark, monkeypatch):
    """The forest gives no candidate and no region, only which sets it saw; the exact way finds every link by itself."""

    def only_seen(*_):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                gone = [pa.nulls(batch.num_rows, pa.int64())] * 5
                yield pa.RecordBatch.from_arrays([batch.column(2), *gone], names=["a", "b", "region", "n", "u", "v"])

        return run

    monkeypatch.setattr(minhash_forest, "_neighbours", only_seen)
    for size, rows in ((3, template_rows(2, 60, 10)), (3, centres(4, 3, 40)), (5, short_sets(6, 300))):
        num = 85 if size == 3 else 80
        component, _ = brute_components(rows, size, num, 100)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert {r.doc_id: r.component_id for r in minhash_forest.components(df, shingle=size, num=num, den=100).collect()} == component


def centres(seed, n, copies):
    """n texts that are alike but under the threshold, each with so many copies of its own that are linked with it alone."""
    rng = random.Random(seed)
    base = sentence(rng, 102).split()
    rows = []
    for c in range(n):
        middle = list(base)
        for j in rng.sample(range(1, 100), 4):
            middle[j] = f"centre{c}x{j}"
        rows.append((900_000 + c, " ".join(middle)))  # no id of its copies
        for k in range(copies):
            words = list(middle)
            for j in rng.sample(range(1, 100), 2):
                words[j] = f"new{c}x{k}x{j}"
            rows.append((1000 * k + c, " ".join(words)))
    return rows


def short_sets(seed, n):
    """Texts of 5 to 24 words with a few of them changed, so that sets of every small size meet the threshold from both sides."""
    rng = random.Random(seed)
    bases = [[f"b{k}x{j}" for j in range(24)] for k in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases)[: rng.randint(5, 24)])
        for _ in range(rng.randint(0, 2)):
            words[rng.choice((0, len(words) - 1))] = f"n{rng.randint(0, 3)}"
        rows.append((i, " ".join(words)))
    return rows


def test_large_groups_with_several_centres(spark):
    rows = centres(5, 3, 200) + [(10**6 + i, t) for i, t in short_sets(7, 200)]
    component, _ = brute_components(rows, 3, 85, 100)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in minhash_forest.components(df, shingle=3, num=85, den=100).collect()} == component


def test_size_classes_and_keys_hold_every_pair():
    rng = random.Random(3)
    for num in (80, 85):
        top = minhash_forest.bounds_of_sizes(num, 100, 3000)
        for _ in range(300):
            m = rng.randint(1, 2000)
            n = rng.randint(m, m * 100 // num)
            assert 0 <= np.searchsorted(top, n) - np.searchsorted(top, m) <= 1
            both = -(-num * (m + n) // (100 + num))
            if both > m:
                continue
            pool = np.array([rng.getrandbits(64) for _ in range(m + n - both)], np.uint64)
            sets = [np.sort(pool[:m]), np.sort(np.r_[pool[:both], pool[m:]])]
            keys = minhash_forest._rarest(sets, num, 100, (np.zeros(0, np.uint64), np.zeros(0, np.int64))).to_pylist()
            assert set(keys[0]) & set(keys[1]) or (sets[0].tolist() == sets[1].tolist())


# 3. Repeated passages.


def brute_cut(rows, length=50):
    first = {}
    for i, t in sorted((i, t) for i, t in rows if i is not None):
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            first.setdefault(raw[p : p + length], i)
    out = {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1) if i is not None else ():
            if first[raw[p : p + length]] < i:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("common", [4096, 2])
def test_passages_against_brute_force(docs, common, monkeypatch):
    """Also with every shared minimizer taken for a very common one, whose windows are dealt one by one."""
    monkeypatch.setattr(suffix_dedup, "COMMON", common)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    expected = brute_cut(rows)
    out = suffix_dedup.cut(docs).collect()
    assert len(out) == len(rows) and sum(r.n_removed > 0 for r in out) > 10
    for r in out:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id], r.doc_id


def test_cut_texts_keeps_columns(docs):
    out = suffix_dedup.cut_texts(docs.withColumn("cut_spans", F.lit("mine")))
    assert out.columns == [*docs.columns, "cut_spans"] and out.count() == docs.count()
    assert suffix_dedup.cut(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_column_order_equals_sorting(tmp_path, block):
    data = np.frombuffer(bytes(random.Random(1).choices(b"ab", k=400)), np.uint8)
    start = np.arange(380)
    order, prefix = suffix_dedup.equal_windows(data, start, 20, str(tmp_path), block)
    rows = [data[s : s + 20].tobytes() for s in order]
    assert rows == sorted(rows) and sorted(order) == list(range(380))
    assert [a == b for a, b in itertools.pairwise(rows)] == [a == b for a, b in itertools.pairwise(prefix.tolist())]


# 4. Revisits.


def test_revisits(spark):
    tag = {"ETag": '"a"', "Content-Type": "text/html", "Content-Length": "9", "Date": "1"}
    rows = [
        (1, "http://www.A.org/x/?b=2&a=1&utm_source=q#f", 10, "response", tag, "d1"),
        (2, "https://a.org:443/x?a=1&b=2", 20, "revisit", {"etag": 'W/"a"', "Date": "2", "Content-Length": "0", "X": None}, None),
        (3, "a.org/x?a=1&b=2", 10, "revisit", {"etag": '"a"'}, None),
        (4, "a.org/x?a=1&b=2", 30, "revisit", {"etag": '"b"'}, None),
        (5, "a.org/x?a=1&b=2", 900_000, "revisit", {}, "d1"),
        (6, "a.org/x?a=1&b=2", 900_001, "revisit", None, None),
        (7, None, 40, "revisit", tag, None),
        (8, "b.org", None, "revisit", tag, None),
        (9, "a.org/x?a=1&b=2", 15, "response", {"etag": '"a"'}, "d9"),
        (10, "a.org/x?a=1&b=2", 15, "response", {"etag": '"a"'}, "d10"),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, headers map<string,string>, digest string").withColumn("bucket", F.lit(0))
    got = collected(warc_revisits.resolve(df, bucket=100), "record_id")
    assert {k: (r.response_id, r.outcome) for k, r in got.items()} == {
        2: (10, "resolved"), 3: (None, "no_response"), 4: (10, "mismatch"), 5: (10, "mismatch"), 6: (10, "unchecked"), 7: (None, "no_response"), 8: (None, "no_response"),
    }
    assert got[2].headers == 'date: 2\netag: W/"a"' and got[2].digest == "d10"
    assert warc_revisits.resolve(df.limit(0)).count() == 0


# 5. Rules.


def test_rules_base_against_brute_force(docs, spark):
    out = robust_rules.verdicts(docs)
    rows = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    got = out.collect()
    assert len(got) == docs.count()
    for r in got:
        t = rows[r.doc_id]
        w = re.findall(WORD, t)
        windows = list(zip(w, w[1:], w[2:], strict=False))
        c = collections.Counter(windows)
        covered = {j for i, x in enumerate(windows) if c[x] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        base = (len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert robust_rules.verdicts(docs.limit(0)).count() == 0


def test_repeated_words_of_a_very_long_text(spark):
    """Half a million different words, a repeated window at both ends: 64-bit hashes must not lose bits to places."""
    words = [f"w{i}" for i in range(500_000)]
    text = " ".join([*words, *words[:3], "x", *words[-4:]])
    got = robust_rules.verdicts(spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")).first()
    assert (got.n_words, got.n_repeat_words) == (500_008, 14)


def test_determinant_estimates_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 4)) * 900 + 3000).astype(int)
    x[:60] += 20_000  # a fifth lies far away
    df = spark.createDataFrame([("g", *map(int, r)) for r in x] + [("flat", 5, 5, 5, 5)] * 50, "grp string, x0 long, x1 long, x2 long, x3 long")
    got = {r.grp: r for r in robust_rules.minimum_covariance(df).collect()}
    least = (np.array(robust_rules.FLOORS) * robust_rules.UNIT) ** 2

    def floored(c):
        return c + np.diag(np.maximum(least - np.diag(c), 0))

    def estimate(rows, factor=1.0):
        return rows.mean(0), floored(np.cov(rows.T) * factor)

    def distances(m, c):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    best = None
    for start in ((np.median(x, 0), floored(np.diag((1.4826 * np.median(np.abs(x - np.median(x, 0)), 0)) ** 2))), estimate(x)):
        m, c = start
        for _ in range(robust_rules.STEPS):  # more steps than the operator may need do not move it any further
            bins = np.floor(np.log(distances(m, c) + 1e-9) * robust_rules.BINS)
            m, c = estimate(x[bins <= np.sort(bins)[int(np.ceil(0.75 * len(x))) - 1]], robust_rules.CONSISTENT)
        if best is None or np.linalg.slogdet(c)[1] < best[0]:
            best = np.linalg.slogdet(c)[1], m, c
    m, c = estimate(x[distances(*best[1:]) <= robust_rules.REWEIGHT])
    low = np.array([[got["g"][f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
    assert [got["g"][f"m{j}"] for j in range(4)] == pytest.approx(m.tolist(), abs=0.5)
    assert (low @ low.T).ravel().tolist() == pytest.approx(c.ravel().tolist(), rel=1e-3, abs=20)
    assert abs(got["g"].m0 - 3000) < 300 and got["flat"].m0 == 5


def test_small_sources_are_judged_by_their_language(spark):
    """Three junk texts of a source of their own are compared with all texts of the language, not with each other."""
    rng = random.Random(4)
    rows = [(i, sentence(rng, 80), "en", "large") for i in range(80)] + [(1000 + i, sentence(rng, 60) + " #$%&|<>" * 60, "en", "small") for i in range(3)]
    out = robust_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    kept = {r.doc_id: r.kept for r in out}
    assert not any(kept[1000 + i] for i in range(3)) and sum(kept[i] for i in range(80)) >= 78


def test_rules_keep_good_and_reject_bad(spark):
    docs = spark.read.parquet(f"{SMALL}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/../sf0.01/labels.parquet")
    rows = robust_rules.verdicts(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] > 0.98 and kept[0] < 0.3


PROSE = "<p>" + "The quick brown fox jumps over the lazy dog and runs on through the wide green fields of the valley. " * 3 + "</p>"


@pytest.mark.parametrize(
    ("page", "count"),
    [
        (f"<form action=x><div>{PROSE * 3}<input name=q><select><option>A</option></select><button>Send</button></div></form>", 3),
        (f'<div class="post comments-open">{PROSE * 3}</div>', 3),
        (f'<div class="post tag-news social">{PROSE * 3}</div>', 3),
        (f'<div id="main-notice">{PROSE * 3}</div>', 3),
        (PROSE.replace("<p>", "<p><a href=x>").replace("</p>", "</a></p>"), 1),
        (f"<article>{PROSE * 400}</article>", 400),
        (f'<div class="comments">{PROSE}</div><article>{PROSE}</article><nav>{PROSE}</nav>', 1),
    ],
)
def test_no_text_of_an_article_is_lost(page, count):
    text = mincut_html.main_text(page)
    assert text.count("jumps over") == 3 * count and "Send" not in text


def test_formulas_and_buttons_inside_a_sentence(spark):
    page = f"<article>{PROSE}<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and press <button>Go</button> now, please.</p><button>Share</button></article>"
    assert mincut_html.main_text(page).split("\n\n")[1:] == ["Let x=2 and press Go now, please."]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert mincut_html.extract(empty).count() == 0


# 6. Mixing.


def test_mix(docs, spark):
    rows = fair_queue.shares(docs).collect()
    assert len(rows) == docs.count()
    again = fair_queue.shares(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    sources = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    taken, target, longest = collections.Counter(), {}, collections.Counter()
    for r in rows:
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        s = sources[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        longest[s] = max(longest[s], r.size)
    total = sum(r.size for r in rows)
    assert sum(target.values()) == pytest.approx(total) and sum(taken.values()) <= total
    assert all(abs(taken[s] - target[s]) <= 2 * max(longest.values()) for s in target)
    assert fair_queue.shares(docs.limit(0)).count() == 0
    mixed = fair_queue.mix(docs)
    assert mixed.columns == docs.columns and mixed.where("text is null").count() == 0


def test_targets_fill_up(spark):
    for seed in range(5):
        rng = random.Random(seed)
        sizes = {f"s{i:02}": rng.choice([1, 10, 100, 10_000]) for i in range(rng.randint(1, 9))}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in fair_queue.targets(df, (5, 2, 1), 3).collect()}
        left, open_, expected = sum(sizes.values()), {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}, {}
        while open_:
            level = left / sum(open_.values())
            over = [s for s, w in open_.items() if w * level >= 3 * sizes[s]]
            for s in over or list(open_):
                expected[s] = 3 * sizes[s] if over else open_[s] * level
                left -= expected[s]
                del open_[s]
        assert got == pytest.approx(expected)


# 7. Quality classifier.


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = knn_quality.scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == k] for k in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97 and np.mean([g >= 0.3 for g in good]) > 0.98


def test_quality_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 60)] + [(11, 1), (12, None), (None, 1)], "doc_id long, quality int")
    rows = knn_quality.scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert {r.score for r in knn_quality.scores(docs, labels.limit(0)).collect()} == {0.5}
    kept = knn_quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)
    assert knn_quality.scores(docs.limit(0), labels).count() == 0


def test_words_hold_most_of_a_vector_and_rows_are_bounded():
    texts = [None, "", *(f"the {w} of that house was old and its garden was {w}" for w in ("colour", "price", "history"))] * 300
    blocks = list(knn_quality.counted(pa.array(texts, pa.string())))
    assert [b[:2] for b in blocks] == [(0, 512), (512, 1024), (1024, 1500)]
    counts = np.concatenate([b[2] for b in blocks])
    assert counts.shape == (1500, knn_quality.DIMS) and (counts[2:5] == counts[-3:]).all() and not counts[:2].any()
    x = knn_quality._weighted(counts[2:5], np.ones(knn_quality.DIMS, np.float32)) ** 2
    words = slice(knn_quality.CLASS_DIMS, knn_quality.CLASS_DIMS + knn_quality.WORD_DIMS)
    assert (x[:, words].sum(1) > x.sum(1) / 2).all()


def test_exact_neighbours():
    rng = np.random.default_rng(1)
    model = knn_quality.Model(np.ones(knn_quality.DIMS, np.float32), rng.normal(size=(knn_quality.DIMS, 8)).astype(np.float32), knn_quality._unit(rng.normal(size=(50, 8))).astype(np.float32), rng.integers(0, 2, 50).astype(float), 5)
    counts = rng.poisson(0.02, (7, knn_quality.DIMS)).astype(np.float32)
    got = model.score(counts)
    for row, score in zip(counts, got, strict=True):
        v = knn_quality._unit(knn_quality._weighted(row[None], model.idf) @ model.basis)[0]
        sim = model.vectors @ v
        best = np.argsort(-sim)[:5]
        w = np.maximum(sim[best], 0) ** 8 + 1e-12
        assert score == pytest.approx((w * model.labels[best]).sum() / w.sum(), rel=1e-3)


# 8. Fingerprints.


def test_fingerprints(docs):
    out = syncmers.compare(docs).collect()
    assert len(out) == docs.count()
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    by_text = {}
    expected = collections.Counter()
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        expected[i, len(t), hashlib.sha256(syncmers.edited(t, following).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == expected
    texts = dict(rows)
    for r in out:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        if r.n_chars > 400 and len(set(texts[r.doc_id].split())) > 20:
            assert r.near_edited > 0.4 and r.near_next < 0.4 or texts[r.doc_id] in by_text
    assert syncmers.compare(docs.limit(0)).count() == 0 and syncmers.compare(docs.where("doc_id = 15")).count() == 1


def test_syncmers_by_definition():
    data = np.frombuffer(sentence(random.Random(2), 80).encode(), np.uint8)
    place, key = syncmers.anchors(data, np.array([0, len(data)]))
    inner = tb.window_hash(tb.prefix_hash(data), syncmers.S)
    width = syncmers.K - syncmers.S + 1
    expected = [i for i in range(len(data) - syncmers.K + 1) if inner[i : i + width].min() in (inner[i], inner[i + width - 1])]
    assert place.tolist() == expected and len(key) == len(place)
    moved, _ = syncmers.anchors(data[7:], np.array([0, len(data) - 7]))
    assert set((place[place >= 7] - 7).tolist()) == set(moved.tolist())  # free of context


def test_fingerprints_of_short_texts():
    """Levels by definition, and edits of texts of 8 to 40 bytes are near, not all or nothing."""
    import pyarrow as pa

    rng = random.Random(12)
    texts = ["".join(rng.choices("abcdefghijklmnop ", k=n)) for n in (1, 5, 8, 15, 23, 31, 40, 120, 255, 256, 400)]
    for text, sketch in zip(texts, syncmers.sketches(pa.array(texts)), strict=True):
        data = np.frombuffer(text.encode(), np.uint8)
        for level, (k, s, most) in enumerate(syncmers.LEVELS):
            inner = [int(tb.span_hash(tb.prefix_hash(data), np.array([i]), np.array([i + s]))[0]) for i in range(len(data) - s + 1)]
            hashes = [int(tb.window_hash(tb.prefix_hash(data), s)[i]) for i in range(len(inner))]
            expected = [i for i in range(len(data) - k + 1) if min(hashes[i : i + k - s + 1]) in (hashes[i], hashes[i + k - s])] if len(data) < most else []
            assert sorted(int(p) & 0x3FFFFFFF for p in sketch[:, 1] if int(p) >> 30 == level) == expected
    for n in (8, 12, 20, 24, 30, 40, 100):
        text = "".join(rng.choices("abcdefghijklmnop ", k=n))
        x, y = syncmers.sketches(pa.array([text, syncmers.edited(text, "zyxwvu" * 10)]))
        assert 0.3 < syncmers.likeness(x, y) < 1 and syncmers.likeness(x, x) == 1


def brute_likeness(x, y):
    """Share of anchors that have a partner of equal hash at the place moved by the median shift, by plain loops."""
    x, y = ([(int(h), int(p)) for h, p in z] for z in (x, y))
    first = [{}, {}]
    for z, f in zip((x, y), first, strict=True):
        for h, p in z:
            f[h] = min(p, f.get(h, p))
    shifts = [first[1][h] - first[0][h] for h in first[0] if h in first[1]]
    if not shifts:
        return 0.0
    moved, good = int(np.median(shifts)), 0
    for one, two, shift in ((x, y, moved), (y, x, -moved)):
        for h, p in one:
            slack = syncmers.SLACK + max(p, p + shift) // 16
            good += any(h == g and abs(q - p - shift) <= slack for g, q in two)
    return good / (len(x) + len(y))


def test_likeness_against_brute_force():
    import pyarrow as pa

    rng = random.Random(13)
    for _ in range(12):
        text = sentence(rng, rng.randint(120, 300))
        a, b = rng.randint(0, len(text) // 2), rng.randint(1, 200)
        other = rng.choice((text[:a] + sentence(rng, b) + text[a:], text[a:] + text[: a // 2], syncmers.edited(text, sentence(rng, 100))))
        x, y = syncmers.sketches(pa.array([text, other]))
        assert syncmers.likeness(x, y) == pytest.approx(brute_likeness(x, y))


def test_a_long_text_keeps_all_anchors():
    """A shared passage in texts of 120,000 bytes is found, and repeated anchors keep every place."""
    import pyarrow as pa

    rng = random.Random(6)
    one, two = ("".join(rng.choices("abcdefghij ", k=120_000)) for _ in range(2))
    passage = "".join(rng.choices("klmnop ", k=400))
    x, y = one[:50_000] + passage + one[50_000:], two[:90_000] + passage + two[90_000:]
    data, at = tb.utf8(pa.array([x]))
    place, _ = syncmers.anchors(data, at)
    a, b, c = syncmers.sketches(pa.array([x, y, one]))
    assert sorted(a[:, 1].tolist()) == place.tolist() and len(a) > 10_000
    assert 10 / len(a) < syncmers.likeness(a, b) < 0.01
    assert syncmers.likeness(a, b) == pytest.approx(syncmers.likeness(b, a)) and syncmers.likeness(a, a) == 1
    assert syncmers.likeness(b, c) < 5 / len(b)
    twice = syncmers.sketches(pa.array([passage + one[:3000] + passage]))[0]
    assert len(set(twice[:, 0].tolist())) < len(twice)


# 9. Pages.


def test_minimum_cut_against_all_labellings():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 8)
        s, t = ([rng.random() * 2 for _ in range(n)] for _ in range(2))
        e = {(i, j): rng.random() for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}

        def cost(side):
            return sum(t[i] if side[i] else s[i] for i in range(n)) + sum(w for (i, j), w in e.items() if side[i] != side[j])  # noqa: B023

        assert cost(mincut_html.minimum_cut(s, t, e)) == pytest.approx(min(map(cost, itertools.product([0, 1], repeat=n))))


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><h1>Site</h1></header><div class="cookie-notice"><p>We use cookies
to make this site better for all. Accept them.</p></div><nav><a href=/a>Home</a></nav><div id="content"><h2>Title &amp; more</h2><p>First long   paragraph of the story,<br>which goes on and on until
it ends <b>here</b>.<p>Short &eacute; one.<ul><li>a point</li><li>another one</li></ul></div><div class="comments"><p>Great post, I like it very much, thank you for sharing it with us!</p></div>
<form><p>Your name, please, and your address.</p><input></form><footer>x</footer>"""


def test_pages(spark):
    rows = [(1, "u", PAGE, "t", 5), (2, None, None, None, None), (3, "u", "", "t", 1), (4, "u", "<p", "t", 1), (5, "u", "plain text without tags, which is long enough to be taken for content.", "t", 1), (1, "u", PAGE, "t", 5)]
    out = mincut_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    text = {r.page_id: r.text for r in out}
    assert len(out) == 6 and text[1] == "Title & more\n\nFirst long paragraph of the story, which goes on and on until it ends here.\n\nShort é one.\n\na point\n\nanother one"
    assert (text[2], text[3], text[4]) == ("", "", "") and text[5].startswith("plain") and all(r.n_chars == len(r.text) for r in out)


def test_pages_of_the_table(spark):
    for r in q.op9_mincut_html(spark, SMALL).join(spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1].replace("<b>", "").replace("</b>", "")
        parts = (" ".join(html.unescape(x.replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", body))
        assert r.text == "\n\n".join(p for p in parts if p)


# 10. Tokens.

ALPHABET = ["'", "s", "re", "r", "e", "v", "  ", "\n", " ", "\t", "a", "é", "ß", "1", "2", "!", "?", "日本", "　", "'ll", "d", "x", "<|endoftext|>", "🙂", "\x1c", "\x85", "²"]


@pytest.fixture(scope="module")
def library():
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = bpe_tree.read_ranks(file.read())
    return ranks, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_against_the_library(library):
    ranks, pattern, encoding = library
    small = bpe_tree.ByteBpe(ranks, pattern, leaf=5, piece=3)  # a tree of many joins
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40)))
        ids = np.frombuffer(small.encode(text), "<u4").tolist()
        assert ids == encoding.encode_ordinary(text) and small.decode(ids) == text.encode()
    large = bpe_tree.ByteBpe(ranks, pattern)
    for text in ("abcdefgh" * 3000, " " * 5000, "ab " * 5000):
        assert np.frombuffer(large.encode(text), "<u4").tolist() == encoding.encode_ordinary(text)


def test_tokens_of_a_table(docs, library):
    import public_tokenizers as P

    _, pattern, encoding = library
    out = bpe_tree.encode(docs, P.path("byte_bpe_50k.tiktoken"), pattern, keep_ids=True)
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    for r in out.collect():
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert (r.ids, r.n_tokens, r.ids_sha256) == (ids, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    back = bpe_tree.decode(out, P.path("byte_bpe_50k.tiktoken"))
    assert all(r.text == texts[r.doc_id] for r in back.collect())
    assert bpe_tree.encode(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), pattern).count() == 0


# The pipeline.


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, last = docs.columns, None
    for name, stage in p.STAGES:
        out = p.written(stage(spark, docs, SMALL), "stage")
        if name == "near-duplicates":
            component, _ = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80, 100)
            assert {r.doc_id for r in out.collect()} == set(component.values())
        if name == "repeated passages":
            expected = brute_cut([(r.doc_id, r.text) for r in docs.collect()])
            assert out.count() == docs.count()
            assert all(hashlib.sha256(r.text.encode()).hexdigest() == expected[r.doc_id][3] for r in out.collect() if r.text.isascii())
        last, docs = docs, out
        if name != p.STAGES[-1][0]:
            assert out.columns == columns
    texts = {r.doc_id: r.text for r in last.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in docs.collect())
    assert p.run(spark, SMALL).count() == docs.count()
