"""Quality rules with robust multivariate outliers, all in DataFrame functions.

Method. Each text gets a vector of transformed statistics: mean word length, symbols, repeated lines
and repeated words, as logarithms of shares. For each language and source the minimum
covariance determinant is estimated: from two fixed starts (medians with median deviations, and the
classical mean and covariance) concentration steps keep the 75 % of rows that are nearest by Mahalanobis
distance and estimate again, until no group's determinant moves (``STEPS`` at most); of the two starts the one with
the smaller determinant stays. It is made consistent, reweighted once, and a document is rejected if its squared distance is
over ``CUT``, the 99.99 % point of chi-square. Documents of sources with fewer than ``MIN_ROWS`` rows that pass the
base rules are judged by all such rows of their language, and where these are too few by those of the whole table; a table
that is smaller still rejects nothing by distance. ``FLOORS`` are the least standard deviations: what differs by less than such a
scale is no outlier, and determinants stay positive where a statistic is constant, as
the count of symbols is in clean text.

Scale. The texts are read once; what follows works on four numbers a row. Steps are partial
aggregations (counts of logarithmic distance bins, 1/``BINS`` wide, for the 75 %, then sums and products), so a source
with a third of all rows is no task of its own. Statistics are whole thousandths and sums are exact,
so results do not depend on the order of rows. Spark jobs run when the function is called; intermediate tables
are in the shared folder, and all but the last are deleted.

Edge cases. A null or empty text has no words and fails the base rules. Null languages and sources are
groups of their own. Ties at the 75 % (within a bin) are all inside. Repeated rows are counted each. Windows of words are compared by
64-bit hashes. An empty table gives an empty table. Extra columns are ignored by ``verdicts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Scratch, written

WORD, SPACES, SYMBOLS = r"[^\x20\x09-\x0D]+", " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Least standard deviations of the statistics, in their own unit. With them the extremes of the last two (every line repeated,
#: log 101, and half of the words, log 51) are just beyond the cut by themselves.
FLOORS = (0.10, 0.60, 0.95, 0.80)
P, SHARE, MIN_ROWS, STEPS, UNIT, BINS = 4, 0.75, 40, 8, 1000, 1024
#: A determinant has settled if its logarithm moves by no more.
SETTLED = 1e-3
#: Fixed values for four dimensions: the consistency factor at 75 %, and the 97.5 % and 99.99 % points of chi-square.
CONSISTENT, REWEIGHT, CUT = 1.486, 11.143, 23.513


def base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' other columns (as structs own.*) with the base statistics of each text."""
    keep = F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("own")
    text = F.coalesce(F.col(text_col), F.lit(""))
    chars = F.length(F.translate(text, SPACES, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    rows = docs.select(
        keep,
        F.regexp_extract_all(text, F.lit(WORD), 0).alias("w"),
        chars.cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    rows = rows.withColumn("n", F.size("w"))
    windows = F.transform(
        F.when(F.col("n") >= 3, F.sequence(F.lit(0), F.col("n") - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)),
    )
    counts = [F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines")]
    rows = rows.select("own", "n", "word_chars", "n_symbols", *counts, windows.alias("h"))
    # Only where a window repeats: windows with their places, sorted, so that equal ones become neighbours.
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    rows = rows.withColumn("s", F.when(repeats, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))

    def same(x: Column, y: Column) -> Column:
        return F.coalesce(x["h"] == y["h"], F.lit(False))

    places = F.transform("s", lambda x, i: F.when(same(x, F.get("s", i - 1)) | same(x, F.get("s", i + 1)), x["i"]))
    rows = rows.withColumn("p", F.sort_array(F.filter(places, lambda x: x.isNotNull())))
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(x - F.get("p", i - 1), F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    covered = F.coalesce(covered, F.lit(0).cast("long"))
    failed = (F.col("n") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n"))
    rows = rows.select("own", F.col("n").cast("long").alias("n_words"), "n", "n_lines", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))
    return rows.withColumn("base_failed", failed).drop("n")


def _vector() -> list[Column]:
    """The statistics, in whole thousandths."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    values = (
        F.log(chars / n),
        F.log1p(1000 * F.col("n_symbols") / chars),
        F.log1p(100 * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        F.log1p(100 * F.col("n_repeat_words") / n),
    )
    return [F.round(v * UNIT).cast("long").alias(f"x{j}") for j, v in enumerate(values)]


def _cholesky(m: list[list[Column]]) -> list[list[Column | None]]:
    rows: list[list[Column | None]] = [[None] * P for _ in range(P)]
    for i in range(P):
        for j in range(i + 1):
            rest = m[i][j]
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            rows[i][j] = F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}")
    return rows


def _factored(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the factor of the covariance c00.. (lower triangle) and the logarithm of its determinant."""
    cov = [[F.col(f"c{max(i, j)}{min(i, j)}") for j in range(P)] for i in range(P)]
    rows = _cholesky(cov)
    for i in range(P):
        for j in range(i + 1):
            stats = stats.withColumn(f"l{i}{j}", rows[i][j])
    det = F.lit(0.0)
    for j in range(P):
        det = det + 2 * F.log(F.col(f"l{j}{j}"))
    return stats.select(*keys, "rows", *[f"m{j}" for j in range(P)], *[f"l{i}{j}" for i in range(P) for j in range(i + 1)], det.alias("det"))


def _estimate(rows: DataFrame, keys: list[str], factor: float = 1.0) -> DataFrame:
    """Mean and covariance of each group, from exact sums."""
    exact = lambda c: F.sum(c.cast("decimal(20,0)")).cast("double")
    sums = [exact(F.col(f"x{j}")).alias(f"s{j}") for j in range(P)]
    products = [exact(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i in range(P) for j in range(i + 1)]
    got = rows.groupBy(*keys).agg(F.count("*").alias("rows"), *sums, *products)
    means = [(F.col(f"s{j}") / F.col("rows")).alias(f"m{j}") for j in range(P)]
    cov = []
    for i in range(P):
        for j in range(i + 1):
            c = (F.col(f"p{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("rows")) / F.greatest(F.col("rows") - 1, F.lit(1)) * factor
            cov.append((F.greatest(c, F.lit((FLOORS[i] * UNIT) ** 2)) if i == j else c).alias(f"c{i}{j}"))
    return _factored(got.select(*keys, "rows", *means, *cov), keys)


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. from m0.. by forward substitution."""
    y: list[Column] = []
    for i in range(P):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * y[k]
        y.append(rest / F.col(f"l{i}{i}"))
    out = F.lit(0.0)
    for v in y:
        out = out + v * v
    return out


def _median(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """(grp, j, name): the median of each group and statistic, to a hundredth, from counts."""
    hist = rows.groupBy("grp", "j", F.floor(value / 10).alias("bin")).agg(F.count("*").alias("c"))
    order = W.partitionBy("grp", "j").orderBy("bin")
    hist = hist.withColumn("upto", F.sum("c").over(order)).withColumn("all", F.sum("c").over(W.partitionBy("grp", "j")))
    return hist.where(2 * F.col("upto") >= F.col("all")).groupBy("grp", "j").agg((F.min("bin") * 10 + 5).cast("double").alias(name))


def _few(groups: DataFrame) -> bool:
    """Whether a table of a row a group, two hundred bytes each at most, may be broadcast."""
    return groups.limit(5001).count() <= 5000


def minimum_covariance(rows: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Robust estimates (grp, rows, m0.., l00.., det) from rows (grp, x0..)."""
    write = scratch.written if scratch else written
    each = rows.select("grp", F.posexplode(F.array(*[f"x{j}" for j in range(P)])).alias("j", "x"))
    middle = write(_median(each, F.col("x"), "med"), "median")
    small = _few(middle)

    def near(df: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
        return df.join(F.broadcast(groups) if small else groups, on)

    spread = _median(near(each, middle, ["grp", "j"]), F.abs(F.col("x") - F.col("med")), "mad")
    start = middle.join(spread, ["grp", "j"]).groupBy("grp")
    start = start.agg(*[F.max(F.when(F.col("j") == j, F.col(c))).alias(f"{c}{j}") for j in range(P) for c in ("med", "mad")])
    floors = [F.lit((x * UNIT) ** 2) for x in FLOORS]
    cov = [(F.greatest((1.4826 * F.col(f"mad{i}")) ** 2, floors[i]) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)]
    start = start.select("grp", F.lit("median").alias("start"), F.lit(0).cast("long").alias("rows"), *[F.col(f"med{j}").alias(f"m{j}") for j in range(P)], *cov)
    both = _factored(start, ["grp", "start"]).unionByName(_estimate(rows.withColumn("start", F.lit("mean")), ["grp", "start"]))
    stats = write(both, "estimates")
    for _ in range(STEPS):
        far = near(rows, stats.drop("rows"), ["grp"]).withColumn("bin", F.floor(F.log(_distance() + 1e-9) * BINS).cast("int"))
        far = far.select("grp", "start", "bin", *[f"x{j}" for j in range(P)])
        hist = far.groupBy("grp", "start", "bin").agg(F.count("*").alias("c"))
        hist = hist.withColumn("upto", F.sum("c").over(W.partitionBy("grp", "start").orderBy("bin"))).withColumn("all", F.sum("c").over(W.partitionBy("grp", "start")))
        limit = hist.where(F.col("upto") >= SHARE * F.col("all")).groupBy("grp", "start").agg(F.min("bin").alias("limit"))
        nearest = near(far, limit, ["grp", "start"]).where("bin <= limit")
        before, stats = stats, write(_estimate(nearest, ["grp", "start"], CONSISTENT), "estimates")
        moved = stats.join(before.select("grp", "start", F.col("det").alias("old")), ["grp", "start"]).where(F.abs(F.col("det") - F.col("old")) > SETTLED)
        if moved.isEmpty():
            break
    best = stats.withColumn("nth", F.row_number().over(W.partitionBy("grp").orderBy("det", "start"))).where("nth = 1").drop("nth", "start")
    inside = near(rows, best.drop("rows"), ["grp"]).where(_distance() <= REWEIGHT)
    return write(_estimate(inside, ["grp"]), "reweighted")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) for each row of docs."""
    scratch = Scratch(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    rows = base(own).select("own.*", "n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    nulls = {"ignoreNullFields": "false"}  # a null source is a source of its own, not all of its language
    levels = F.concat(F.lit("source "), F.to_json(F.struct("lang", "source"), nulls)), F.concat(F.lit("language "), F.to_json(F.struct("lang"), nulls))
    rows = rows.withColumn("of", F.array(*levels, F.lit("all")))
    rows = written(rows.select("*", *_vector()), "statistics")
    # Each document's group: its source, language or the table, the first that has enough rows.
    fit = rows.where(~F.col("base_failed"))
    counts = fit.groupBy("of").agg(F.count("*").alias("c"))
    sizes = scratch.written(counts.select(F.explode("of").alias("grp"), "c").groupBy("grp").agg(F.sum("c").alias("c")), "counts")
    enough = sizes.where(F.col("c") >= MIN_ROWS).select("grp")
    sources = rows.select("of").distinct()
    choice = sources.select("of", F.posexplode("of").alias("level", "grp")).join(enough, "grp").groupBy("of").agg(F.min_by("grp", "level").alias("grp"))
    choice = scratch.written(choice, "choice")
    small = _few(choice)
    hint = F.broadcast if small else (lambda x: x)
    used = hint(choice.select("grp").distinct())
    fitted = fit.select(F.explode("of").alias("grp"), *[f"x{j}" for j in range(P)]).join(used, "grp", "left_semi")
    estimates = minimum_covariance(fitted, scratch).where(F.col("rows") > P).drop("rows")
    judged = written(estimates.join(choice, "grp"), "estimates")
    scratch.drop()
    far = rows.join(hint(judged), "of", "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= CUT))
    return far.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
