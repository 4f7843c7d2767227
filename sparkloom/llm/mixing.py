"""Mixing sources to target weights by entropy balancing (operator 5).

Every document gets a rate, the expected number of copies in the mix. Among all rates that meet the token
constraints the balance takes those of least Kullback-Leibler distance from one copy each, weighted by size;
they are exponentials of sums of multipliers, one multiplier for each constraint. The multipliers solve a convex
dual by Newton steps over cells (documents that share source, language and size class); gradient, curvature and the objective along a step are
distributed sums. Rates then become whole copies, a source's missing words being filled in the order of a hash.

Nothing is ordered in one task, however hot a source, a size or a doc_id is: running sums are taken over sorted ranges.

Defined cases: a null text has size 0, one of any length is counted whole; a null source is a source of its own and comes last; a null doc_id is one like others; ties in
the hash (rows that repeat doc_id and text) are broken by the place in the input, which changes no count of copies among them; repeated rows are documents of their
own; an empty table gives an empty mix; constraints that cannot be met raise ``Unbalanced``; columns besides those named are not read, and their names may be any.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import drop, release, stage, width

#: Multipliers up to which the full Hessian is solved on the driver (its cells are at most this squared); beyond it each family takes its diagonal steps in turn.
MOST_MULTIPLIERS = 512


class Unbalanced(RuntimeError):
    """The targets contradict each other, or the rounds ran out."""


WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weighted_targets(totals: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds ``target`` to one row per source (``source``, ``source_size``).

    Sources in code point order, null last, take the weights in turn. A target stops at ``cap`` times the
    source's size and the excess goes to the others by weight: a source is at its stop if the level at which it
    gets there, applied to all, asks for no more than is to be shared. One row per source meets in the windows.
    """
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy("_ratio", "_place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_place"), F.lit(len(weights))) + 1).cast("int"))
    t = (
        totals.withColumn("_place", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
        .withColumn("_weight", weight.cast("double"))
        .withColumn("_cap", F.lit(cap) * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_wanted", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("_caps", F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn(
            "_rest",
            F.sum("_weight").over(everything) - F.sum("_weight").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .withColumn("_stopped", F.col("_caps") + F.col("_ratio") * F.col("_rest") <= F.col("_wanted"))
    )
    free = F.sum(F.when(~F.col("_stopped"), F.col("_weight"))).over(everything)
    used = F.coalesce(F.sum(F.when(F.col("_stopped"), F.col("_cap"))).over(everything), F.lit(0.0))
    level = (F.col("_wanted") - used) / free
    return t.select("source", "source_size", F.when(F.col("_stopped"), F.col("_cap")).otherwise(level * F.col("_weight")).alias("target"))


def entropy_rates(cells: DataFrame, targets: dict[str, DataFrame], tokens: str = "tokens", rounds: int = 60, within: float = 1e-9) -> DataFrame:
    """Adds ``rate`` to cells of documents that share all their constraints.

    ``targets`` maps a column of ``cells`` to (that column, ``target``): the tokens that the mix must take for each of its values. Rates meet every target to
    the part ``within`` of all tokens, else ``Unbalanced`` is raised.
    """
    count = sum(t.limit(MOST_MULTIPLIERS + 1).count() for t in targets.values())
    if not count:
        return cells.withColumn("rate", F.lit(1.0))
    duals = _newton(cells, targets, tokens, rounds, within) if count <= MOST_MULTIPLIERS else _in_turn(cells, targets, tokens, 10 * rounds, within)
    return _rated(cells, duals, [F.col("_dual")], ["rate"])


def _rated(cells: DataFrame, duals: dict[str, DataFrame], sums: list[Column], names: list[str]) -> DataFrame:
    """Cells with exponentials of summed multipliers; ``sums`` are what one family's table adds to each exponent."""
    out, parts = cells, []
    for k, (c, dual) in enumerate(duals.items()):
        d = dual.select(F.col(c).alias(f"_key{k}"), *(x.alias(f"_part{k}_{i}") for i, x in enumerate(sums)))
        out = out.join(d, F.col(c).eqNullSafe(F.col(f"_key{k}")), "left").drop(f"_key{k}")
        parts.append([F.coalesce(F.col(f"_part{k}_{i}"), F.lit(0.0)) for i in range(len(sums))])
    made = [F.exp(sum(column, F.lit(0.0))).alias(n) for n, column in zip(names, zip(*parts))]
    return out.select(*cells.columns, *made)


def _newton(cells: DataFrame, targets: dict[str, DataFrame], tokens: str, rounds: int, within: float) -> dict[str, DataFrame]:
    """Full Newton steps with a line search by halves. The dual is sum(rate * tokens) - sum(multiplier * target); its Hessian has one entry for each pair of
    constraints that a cell shares, and is summed up where the cells are, in one job a step. Constraints that say the same leave it singular, so the least step is taken."""
    spark = cells.sparkSession
    names, keys, want = list(targets), [], []
    for c, t in targets.items():
        for r in t.select(F.col(c).alias("k"), F.col("target").cast("double").alias("t")).collect():
            keys.append((c, r["k"]))
            want.append(r["t"])
    place, want = {k: i for i, k in enumerate(keys)}, np.array(want)
    # Cells are added up by their constraints once, so that a round reads as many rows as there are combinations.
    small = stage(cells.groupBy(*names).agg(F.sum(F.col(tokens).cast("double")).alias("_w")).filter("_w > 0"), "cells")

    def table(dual: np.ndarray) -> dict[str, DataFrame]:
        made = {}
        for c, t in targets.items():
            rows = [F.struct(F.lit(k).cast(t.schema[c].dataType).alias(c), F.lit(float(dual[i])).alias("_dual")) for (f, k), i in place.items() if f == c]
            made[c] = spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows))) if rows else t.select(c, F.lit(0.0).alias("_dual"))
        return made

    def at(dual: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The dual's value, what each constraint has, and the Hessian."""
        rows = _rated(small, table(dual), [F.col("_dual")], ["_r"]).withColumn("_m", F.col("_r") * F.col("_w"))
        value, has, hessian = -float(dual @ want), np.zeros(len(keys)), np.zeros((len(keys), len(keys)))
        for r in _pair_sums(rows, names).collect():
            if r["f"] < 0:
                value += r["m"] or 0.0
                continue
            i, j = place.get((names[r["f"]], r[f"a_{r['f']}"])), place.get((names[r["g"]], r[f"b_{r['g']}"]))
            if i is not None and j is not None:
                hessian[i, j] = hessian[j, i] = r["m"]
                if i == j:
                    has[i] = r["m"]
        return value, has, hessian

    dual, total = np.zeros(len(keys)), max(float(np.abs(want).sum()), 1.0)
    value, has, hessian = at(dual)
    for _ in range(rounds):
        gap = has - want
        if np.abs(gap).max() <= within * total:
            drop(small)
            return table(dual)
        step = -np.linalg.lstsq(hessian, gap, rcond=1e-12)[0]
        slope = float(gap @ step)
        # What no step can mend lies across constraints that say the same and ask for different things.
        if not np.isfinite(step).all() or slope >= 0 or np.abs(hessian @ step + gap).max() > 0.5 * np.abs(gap).max():
            break
        part = min(1.0, 3.0 / np.abs(step).max())
        for _ in range(40):
            new = at(dual + part * step)
            if np.isfinite(new[0]) and new[0] <= value + 1e-4 * part * slope + 1e-12 * total:
                break
            part /= 2
        else:
            break
        dual, (value, has, hessian) = dual + part * step, new
    drop(small)
    raise Unbalanced("no rates meet these targets; the largest miss is %g words of %g" % (np.abs(has - want).max(), total))


def _pair_sums(rows: DataFrame, names: list[str]) -> DataFrame:
    """(f, g, a_0.., b_0.., m): summed mass for each pair of constraints, f <= g being numbers of families; f = -1 has the mass of all."""
    kinds = [rows.schema[x].dataType for x in names]
    out = []
    for f, g in [(-1, -1), *((f, g) for f in range(len(names)) for g in range(f, len(names)))]:
        pick = lambda k, p: [(F.col(x) if i == k else F.lit(None).cast(kinds[i])).alias(f"{p}_{i}") for i, x in enumerate(names)]
        out.append(F.struct(F.lit(f).alias("f"), F.lit(g).alias("g"), *pick(f, "a"), *pick(g, "b")))
    spread = rows.select(F.explode(F.array(*out)).alias("_c"), "_m").select("_c.*", "_m")
    return spread.groupBy(*(c for c in spread.columns if c != "_m")).agg(F.sum("_m").alias("m"))


def _in_turn(cells: DataFrame, targets: dict[str, DataFrame], tokens: str, rounds: int, within: float) -> dict[str, DataFrame]:
    """One family's multipliers after the other, each to its optimum given the rest; only the largest miss comes to the driver, tables are staged each round."""
    duals = {c: stage(t.select(c, F.col("target").cast("double").alias("target"), F.lit(0.0).alias("_dual")), "dual") for c, t in targets.items()}
    total = max(sum(float(t.agg(F.coalesce(F.sum(F.abs("target")), F.lit(0.0))).first()[0]) for t in duals.values()), 1.0)
    for _ in range(rounds):
        worst = 0.0
        for c in targets:
            sums = _rated(cells, duals, [F.col("_dual")], ["_rate"]).groupBy(F.col(c).alias("_key")).agg(F.sum(F.col("_rate") * F.col(tokens)).alias("_has"))
            old = duals[c]
            miss = F.abs(F.coalesce("_has", F.lit(0.0)) - F.col("target"))
            move = F.when((F.col("_has") > 0) & (F.col("target") > 0), F.log(F.col("target") / F.col("_has"))).otherwise(F.when(F.col("_has") > 0, -30.0).otherwise(0.0))
            both = stage(old.join(sums, F.col(c).eqNullSafe(F.col("_key")), "left").select(c, "target", (F.col("_dual") + move).alias("_dual"), miss.alias("_miss")), "dual")
            worst = max(worst, both.agg(F.max("_miss")).first()[0] or 0.0)
            drop(old)
            duals[c] = both
        if worst <= within * total:
            return duals
    raise Unbalanced("no rates meet these targets; the largest miss is %g words of %g" % (worst, total))


def running_sum(df: DataFrame, groups: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over a group's rows up to and including each, in ``order`` (which must tell rows apart, or ties be alike).

    Rows are sorted into ranges by group and order, so a hot group fills many; what lies before a range is a sum over the ranges' totals, one row for each range and group in it.
    """
    spread = df.withColumn("__v", value)
    ranges = stage(spread.repartitionByRange(width(df.sparkSession), *(F.asc_nulls_last(g) for g in groups), *order).withColumn("__range", F.spark_partition_id()), "ranges")
    key = F.struct(*groups)
    totals = ranges.groupBy(key.alias("__g"), "__range").agg(F.sum("__v").alias("__t"))
    upto = F.sum("__t").over(Window.partitionBy("__g").orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # A group that lies in one range alone (most do, where there are many) needs no offset.
    before = totals.withColumn("__before", upto - F.col("__t")).filter("__before <> 0").select(F.col("__g").alias("__h"), F.col("__range").alias("__s"), "__before")
    inside = F.sum("__v").over(Window.partitionBy("__range", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = ranges.withColumn("__inside", inside)
    # At most one group crosses from a range into the next, so ``before`` has no more rows than there are ranges, times groups cut by several borders.
    both = summed.join(F.broadcast(before), key.eqNullSafe(F.col("__h")) & (F.col("__range") == F.col("__s")), "left")
    return both.withColumn(name, F.col("__inside") + F.coalesce("__before", F.lit(0))).drop("__v", "__range", "__h", "__s", "__before", "__inside")


def whole_copies(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Turns rates into copies so that each source's words come near its target.

    ``docs``: doc_id, source, size, key (a hash), mark (a hash of the text) and rid; ``sources``: source, source_size, target, rate. Every document gets the whole part
    of its source's rate. The words still missing go to documents in the order of ``key`` until the next would
    overshoot; what then remains is filled greedily with the largest other documents that fit.
    """
    base = F.floor(F.col("rate") + 1e-9)
    s = stage(
        sources.select(
            F.col("source").alias("_s"), "source_size", "target", base.alias("_base"),
            F.greatest(F.lit(0), F.floor(F.col("target") + 0.5) - base * F.col("source_size")).cast("long").alias("_need"),
        ), "needs",
    )
    order = [F.col("key"), F.asc_nulls_last("doc_id"), F.col("size"), F.col("mark"), F.col("rid")]
    summed = running_sum(docs, ["source"], order, F.col("size"), "_sum")
    marked = stage(summed.join(s, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_extra", F.col("_sum") <= F.col("_need")), "marked")
    release(docs.sparkSession)
    left = marked.groupBy("source", "_need").agg(F.coalesce(F.max(F.when(F.col("_extra"), F.col("_sum"))), F.lit(0)).alias("_got"))
    left = stage(left.select(F.col("source").alias("_s"), (F.col("_need") - F.col("_got")).alias("_left")), "left")

    # What is left is less than the longest document, so few distinct sizes fit and no more rows are picked than that has words.
    sizes = marked.filter("not _extra and size > 0").groupBy("source", "size").agg(F.count("*").alias("_n"))
    fits = sizes.join(left, F.col("source").eqNullSafe(F.col("_s"))).filter("size <= _left")
    take = lambda acc, x: F.least(x["_n"], F.floor(acc["left"] / x["size"]))
    chosen = F.aggregate(
        F.sort_array(F.col("_sizes"), asc=False),
        F.struct(F.col("_left").alias("left"), F.array().cast("array<struct<size:bigint,take:bigint>>").alias("picks")),
        lambda acc, x: F.struct(
            (acc["left"] - take(acc, x) * x["size"]).alias("left"),
            F.when(
                take(acc, x) > 0, F.concat(acc["picks"], F.array(F.struct(x["size"].alias("size"), take(acc, x).cast("long").alias("take"))))
            )
            .otherwise(acc["picks"])
            .alias("picks"),
        ),
    )
    picks = (
        fits.groupBy("_s", "_left")
        .agg(F.collect_list(F.struct("size", "_n")).alias("_sizes"))
        .select("_s", F.explode(chosen["picks"]).alias("_p"))
        .select("_s", F.col("_p.size").alias("_size"), F.col("_p.take").alias("_take"))
    )
    picks = stage(picks, "picks")
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_size"))
    open_ = marked.filter("not _extra").join(picks, same).select("rid", "source", "size", "key", "doc_id", "mark", "_take")
    late = running_sum(open_, ["source", "size"], order, F.lit(1), "_place").filter("_place <= _take").select(F.col("rid").alias("_late"))
    out = marked.join(late, F.col("rid") == F.col("_late"), "left")
    extra = (F.col("_extra") | F.col("_late").isNotNull()).cast("long")
    return out.select("rid", "doc_id", "source", "size", "mark", "source_size", "target", (F.col("_base") + extra).cast("long").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per document: doc_id, source, size, mark (a hash of the text), source_size, target, copies (0 up to ``cap``)."""
    text = F.col("text").cast("string")
    # Half-octaves of size and the language make the cells; both are at hand where they are columns of the input.
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    size = word_count(text)
    sized = stage(
        docs.select(
            F.monotonically_increasing_id().alias("rid"), F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), lang.alias("lang"), size.alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"), text_mark(text).alias("mark"),
        ), "sized",
    )
    class_ = F.floor(2 * F.log2(F.col("size") + 1.0)).cast("int")
    cells = stage(sized.groupBy("source", "lang", class_.alias("class")).agg(F.sum("size").alias("tokens")), "cells")
    totals = cells.groupBy("source").agg(F.sum("tokens").alias("source_size"))
    targets = stage(weighted_targets(totals, weights, share, cap), "targets")
    release(docs.sparkSession)
    # A source without words has nothing to balance and keeps its documents once.
    rated = entropy_rates(cells, {"source": targets.filter("source_size > 0").select("source", "target")})
    rates = rated.groupBy(F.col("source").alias("_r")).agg(F.max("rate").alias("rate"))
    sources = targets.join(rates, F.col("source").eqNullSafe(F.col("_r"))).drop("_r")
    return whole_copies(sized, sources).drop("rid")


def text_mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, each as often as it has copies, with the columns of ``docs``.

    Rows that agree in doc_id, source and text are alike to the mix. Where several do, each gets an equal part of their copies and some of them, by their place, one more, so that the sum is met.
    Such rows are numbered without their texts. Groups of more than a thousandth of all rows, of which there can be no thousand, are met by a broadcast, so that no task gets a hot one.
    """
    m = mix(docs, **how).groupBy(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("mark").alias("__t")).agg(F.sum("copies").alias("__c"), F.count("*").alias("__m"))
    m = stage(m.filter("__c > 0"), "mixed")
    release(docs.sparkSession)
    # The input's columns travel in one struct, so that their names may be any.
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__id"), F.col("source").cast("string").alias("__from"), text_mark(F.col("text").cast("string")).alias("__u"))
    on = F.col("__id").eqNullSafe(F.col("__d")) & F.col("__from").eqNullSafe(F.col("__s")) & (F.col("__u") == F.col("__t"))
    copied = lambda df: df.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__c").cast("int")))).select("__row.*")
    single = rows.join(m.filter("__m = 1"), on).select("__row", "__c")
    several = m.filter("__m > 1")
    if several.isEmpty():
        return copied(single)
    every = max(docs.count() // 1000, 1)
    hot, rest = F.broadcast(several.filter(F.col("__m") > every)), several.filter(F.col("__m") <= every)
    alike = stage(rows.join(hot, on).unionByName(rows.join(rest, on)).withColumn("__rid", F.monotonically_increasing_id()), "alike")
    group = F.xxhash64("__id", "__from", "__u").alias("__g")
    numbered = running_sum(alike.select("__rid", group, "__c", "__m"), ["__g"], [F.col("__rid")], F.lit(1), "__k")
    more = numbered.select(F.col("__rid").alias("__q"), (F.floor(F.col("__c") / F.col("__m")) + (F.col("__k") <= F.col("__c") % F.col("__m")).cast("long")).alias("__n"))
    dealt = alike.join(more, F.col("__rid") == F.col("__q")).filter("__n > 0").select("__row", F.col("__n").alias("__c"))
    return copied(single.unionByName(dealt))


def op5_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS place, 1.5 * sum(source_size) OVER () AS wanted FROM s0),
s2 AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio FROM s1),
s3 AS (SELECT *, sum(cap) OVER (ORDER BY ratio, place ROWS UNBOUNDED PRECEDING)
           + ratio * (sum(w) OVER () - sum(w) OVER (ORDER BY ratio, place ROWS UNBOUNDED PRECEDING)) <= wanted AS stopped FROM s2),
s4 AS (SELECT source, source_size, CASE WHEN stopped THEN cap
           ELSE w * ((wanted - coalesce(sum(CASE WHEN stopped THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT stopped THEN w END) OVER ()) END::DOUBLE AS target FROM s3),
s AS (SELECT *, CASE WHEN source_size = 0 THEN 1 ELSE floor(target / source_size + 1e-9)::BIGINT END AS base FROM s4),
n AS (SELECT *, greatest(0, floor(target + 0.5)::BIGINT - base * source_size) AS need FROM s),
c AS (SELECT d.doc_id, d.source, d.size, d.key, n.source_size, n.target, n.base, n.need,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS total
      FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source),
m AS (SELECT *, total <= need AS extra FROM c),
l AS (SELECT source, (max(need) - coalesce(max(CASE WHEN extra THEN total END), 0))::BIGINT AS room FROM m GROUP BY source),
h AS (SELECT source, size, count(*) AS cnt FROM m WHERE NOT extra AND size > 0 GROUP BY source, size),
g AS (SELECT source, room, room AS lim, 0::BIGINT AS size, 0::BIGINT AS take FROM l
      UNION ALL
      SELECT source, room - take * size, least(size - 1, room - take * size), size, take FROM (
        SELECT g.source, g.room, h.size, least(h.cnt, g.room // h.size)::BIGINT AS take
        FROM g JOIN h ON h.source IS NOT DISTINCT FROM g.source AND h.size <= g.lim
        QUALIFY row_number() OVER (PARTITION BY g.source ORDER BY h.size DESC) = 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY source, size, extra ORDER BY key, doc_id) AS rank FROM m)
SELECT r.doc_id, r.size, r.source_size, round(r.target, 6) AS target,
       (r.size * (r.base + CASE WHEN r.extra OR r.rank <= coalesce(g.take, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r LEFT JOIN g ON g.source IS NOT DISTINCT FROM r.source AND g.size = r.size AND g.take > 0
"""
