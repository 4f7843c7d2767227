"""Quality rules by robust multivariate outliers (operator 10), in DataFrame functions only.

Each text gives a few statistics; transformed, they form a vector. For every language and source the location and
scatter of the vectors are estimated by the minimum covariance determinant: from a coordinate-wise robust start, concentration steps keep
the part of the rows nearest by Mahalanobis distance and estimate again from these, which never raises the
determinant. A row is rejected if its squared distance passes a chi-square cutoff. All steps are grouped
aggregations with map-side partial sums, so a hot source costs no task more than its share.

Every repeat of a window is found by sorting the windows' hashes inside the row (64 bits; two different windows of one
text of n words are confused with a chance below n*n / 2**65). Fixed floors under the scatter (``FLOORS``) keep groups whose
core is constant, small or made of copies from rejecting ordinary rows; groups of fewer than ``least`` rows take the estimate of
all rows of their language, or of the table if the language has as few.

Defined cases: a null text has no words and fails the base rule; a null language or source is a group of its own; repeated
rows count as often as they occur; an empty table stays empty; columns besides those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.session import release, stage

WORD = r"[^\x20\x09-\x0D]+"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Standard deviations below which no direction of a group's scatter is taken to be, by transformed statistic.
FLOORS = {"length": 0.12, "symbols": 0.10, "dup_lines": 0.15, "repeats": 0.15}
DIMS = tuple(FLOORS)
#: Squared distance with four degrees of freedom beyond which a Gaussian row lies with a chance of 2.2e-9.
CUTOFF = 46.2
#: Groups (languages and sources) up to which their estimates are broadcast; that many take about 20 MB.
MOST_GROUPS = 50_000


def repeated_words(words: Column, window: int = 8) -> Column:
    """Words covered by windows of ``window`` words that occur twice or more, from an array of words."""
    n = F.size(words)
    word_hashes = F.transform(words, lambda w: F.xxhash64(w))
    hashes = F.when(
        n > window,
        F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.xxhash64(*(F.get(F.col("_wh"), i + k - 1) for k in range(window)))),
    )
    return word_hashes, hashes


def statistics(docs: DataFrame, window: int = 8) -> DataFrame:
    """Adds the five counts of ``STATS`` to the columns of ``docs`` (which must have ``text``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    word_hashes, hashes = repeated_words(F.col("_words"), window)
    d = docs.withColumn("_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).withColumn("_wh", word_hashes)
    d = d.withColumn("_h", hashes)
    # Only where some window repeats are places sorted along with the hashes.
    some = F.size(F.array_distinct(F.col("_h"))) < F.size(F.col("_h"))
    placed = F.sort_array(F.transform(F.col("_h"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_p", F.when(some, placed))
    p = F.col("_p")
    twice = F.filter(p, lambda x, k: ((k > 0) & (F.get(p, k - 1)["h"] == x["h"])) | (F.get(p, k + 1)["h"] == x["h"]))
    d = d.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    at = F.col("_at")
    covered = F.aggregate(
        F.transform(at, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x
    )
    return (
        d.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.coalesce(F.aggregate(F.col("_words"), F.lit(0).cast("long"), lambda a, w: a + F.length(w)), F.lit(0)).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .drop("_words", "_wh", "_h", "_p", "_at")
    )


def vector(df: DataFrame) -> DataFrame:
    """Adds the transformed statistics, _x0 to _x3: log of the mean word length, log-scaled share of symbols, and the
    variance-stabilised shares of lines and words that repeat. The text's length itself is no fault, so it is not among them.

    Shares are shrunk by a few pseudo-counts, so that one odd line in a short text weighs little."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = lambda c: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(c) / (n + 20.0))))
    return (
        df.withColumn("_x0", F.log((F.col("word_chars") + 100.0) / (n + 20.0)))
        .withColumn("_x1", F.log1p(10.0 * F.col("n_symbols") / (n + 20.0)))
        .withColumn("_x2", F.asin(F.sqrt(F.least(F.lit(1.0), 10.0 * F.col("n_dup_lines") / (n + 20.0)))))
        .withColumn("_x3", share("n_repeat_words"))
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _moments(prefix: str = "") -> list[Column]:
    d = len(DIMS)
    sums = [F.avg(f"_x{i}").alias(f"{prefix}m{i}") for i in range(d)]
    return [F.count("*").alias(f"{prefix}n"), *sums, *(F.avg(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"{prefix}q{i}{j}") for i in range(d) for j in range(i + 1))]


def _factor(df: DataFrame) -> DataFrame:
    """From means and mean products to the mean and the lower Cholesky factor (l_ij) of the floored covariance."""
    d = len(DIMS)
    for i in range(d):
        for j in range(i + 1):
            cov = F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")
            if i == j:
                cov = F.greatest(cov, F.lit(0.0)) + F.lit(FLOORS[DIMS[i]] ** 2)
            known = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            value = F.sqrt(F.greatest(cov - known, F.lit(1e-12))) if i == j else (cov - known) / F.col(f"l{j}{j}")
            df = df.withColumn(f"l{i}{j}", value)
    return df.select(*(c for c in df.columns if c[0] not in "q" and c != "n"))


def _distance(df: DataFrame) -> DataFrame:
    """Adds ``_d2``, the squared Mahalanobis distance, by forward substitution with the Cholesky factor."""
    d = len(DIMS)
    for i in range(d):
        known = sum((F.col(f"l{i}{k}") * F.col(f"_z{k}") for k in range(i)), F.lit(0.0))
        df = df.withColumn(f"_z{i}", (F.col(f"_x{i}") - F.col(f"m{i}") - known) / F.col(f"l{i}{i}"))
    return df.withColumn("_d2", sum((F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(d)), F.lit(0.0))).drop(*(f"_z{i}" for i in range(d)))


def _few(staged: DataFrame, most: int = MOST_GROUPS) -> bool:
    return staged.limit(most + 1).count() <= most


def _bounded(staged: DataFrame, few: bool | None = None) -> DataFrame:
    """A staged table to be broadcast if its rows, which are counted unless ``few`` tells it, are few; else it is joined by a shuffle."""
    return F.broadcast(staged) if (_few(staged) if few is None else few) else staged


def _with(df: DataFrame, params: DataFrame, few: bool) -> DataFrame:
    """Joins a group's parameters: a few hundred bytes a group, so rows of a hot group stay where they are."""
    p = _bounded(params, few).withColumnRenamed("_g", "_pg")
    return df.join(p, F.col("_g") == F.col("_pg")).drop("_pg")


def fit(stats: DataFrame, part: float = 0.75, steps: int = 6, least: int = 200) -> DataFrame:
    """The estimates: lang, source, m0.., l00.. for every language and source of ``stats`` (a staged table with STATS).

    Rows that fail the base rule take no part. The start has the median of each coordinate and no correlation; each step keeps the ``part``
    of a group nearest to its estimate, the border being a percentile sketch of bounded size.
    """
    rows = vector(stats.filter(~base_failed()))
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("_n"))
    langs = sizes.groupBy(F.col("lang").alias("_l")).agg(F.sum("_n").alias("_ln"))
    named = sizes.join(langs, F.col("lang").eqNullSafe(F.col("_l"))).drop("_l")
    group = (
        F.when(F.col("_n") >= least, F.to_json(F.struct(F.lit("s").alias("k"), "lang", "source")))
        .when(F.col("_ln") >= least, F.to_json(F.struct(F.lit("l").alias("k"), "lang")))
        .otherwise(F.lit("all"))
    )
    named = stage(named.select("lang", "source", group.alias("_g")), "groups")
    pick = _bounded(named).select(F.col("lang").alias("_l"), F.col("source").alias("_s"), F.col("_g").alias("_own"))
    keyed = rows.join(pick, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")))
    # A pooled estimate takes all rows of the language or table, not only those of its small sources.
    levels = [F.col("_own"), F.to_json(F.struct(F.lit("l").alias("k"), "lang")), F.lit("all")]
    wanted = stage(named.select(F.col("_g").alias("_w")).distinct(), "wanted")
    few = _few(wanted)  # estimates and borders have a row for each wanted group at most
    cells = keyed.select(*(f"_x{i}" for i in range(len(DIMS))), F.explode(F.array_distinct(F.array(*levels))).alias("_g"))
    cells = stage(cells.join(_bounded(wanted, few), F.col("_g") == F.col("_w"), "left_semi"), "vectors")

    d = len(DIMS)
    half = [F.percentile_approx(f"_x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1000)).alias(f"c{i}") for i in range(d)]
    start = cells.groupBy("_g").agg(*half)
    sigma = lambda i: (F.col(f"c{i}")[2] - F.col(f"c{i}")[0]) / 1.349
    params = start.select(
        "_g", *(F.col(f"c{i}")[1].alias(f"m{i}") for i in range(d)),
        *((F.sqrt(sigma(i) * sigma(i) + FLOORS[DIMS[i]] ** 2) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(d) for j in range(i + 1)),
    )
    params = stage(params, "estimate")
    release(stats.sparkSession)
    for _ in range(steps):
        far = _distance(_with(cells, params, few))
        border = stage(far.groupBy(F.col("_g").alias("_bg")).agg(F.percentile_approx("_d2", F.lit(part), F.lit(1000)).alias("_b")), "border")
        near = far.join(_bounded(border, few), F.col("_g") == F.col("_bg")).filter("_d2 <= _b")
        params = stage(_factor(near.groupBy("_g").agg(*_moments())), "estimate")
        release(stats.sparkSession)
    return stage(named.join(params.withColumnRenamed("_g", "_pg"), F.col("_g") == F.col("_pg")).drop("_g", "_pg"), "estimates")


def judge(stats: DataFrame, estimates: DataFrame, cutoff: float = CUTOFF, part_scale: float = 1.6) -> DataFrame:
    """Adds base_failed, distance (squared) and kept. ``part_scale`` undoes the narrowing of the scatter by the kept part."""
    e = _bounded(estimates).withColumnRenamed("lang", "_el").withColumnRenamed("source", "_es")
    far = _distance(vector(stats).join(e, F.col("lang").eqNullSafe(F.col("_el")) & F.col("source").eqNullSafe(F.col("_es")), "left"))
    d2 = F.col("_d2") / part_scale
    extra = [f"_x{i}" for i in range(len(DIMS))] + [c for c in estimates.columns if c not in ("lang", "source")] + ["_el", "_es", "_d2"]
    return (
        far.withColumn("base_failed", base_failed())
        .withColumn("distance", d2)
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce(d2, F.lit(0.0)) <= cutoff))
        .drop(*extra)
    )


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, STATS, base_failed, distance, kept for every document."""
    stats = stage(statistics(docs.select("doc_id", "lang", "source", "text")).drop("text"), "stats")
    return judge(stats, fit(stats))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of ``docs``. Statistics are computed once and staged; the verdict comes back to the texts
    by doc_id and a hash of what it rests on, so rows that share a doc_id are told apart."""
    mark = F.xxhash64("lang", "source", "text").alias("_mark")
    stats = stage(statistics(docs.select("doc_id", "lang", "source", "text", mark)).drop("text"), "stats")
    keep = judge(stats, fit(stats)).filter("kept").select(F.col("doc_id").alias("__keep"), F.col("_mark").alias("__kept")).distinct()
    # The input's columns travel in one struct, so that their names may be any.
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__id"), mark)
    return rows.join(keep, F.col("__id").eqNullSafe(F.col("__keep")) & (F.col("_mark") == F.col("__kept")), "left_semi").select("__row.*")


def op10_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs).select("doc_id", *STATS, "base_failed", "kept", "distance")
