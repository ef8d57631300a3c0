"""All pairs of two thresholds at once: a summed-area table over the ranks of two kinds' scores; and all single thresholds by change points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.integrity import cut
from memlake.operators.joins import joined_small

#: What a query adds to a pair: it abstains though it must, keeps something useful, its false discovery in UNIT-ths, shows anything though covered.
SUMS = ("abst", "kept", "fdr", "ne")


def axis(cards: DataFrame, kind: str, score: str) -> DataFrame:
    """kind, rank (from 0), theta: below all distinct scores of a kind, between neighbouring ones, above all. Rank r lets scores of rank > r pass.

    An axis holds distinct scores of one kind, as the table of pairs holds their product.
    """
    distinct = cards.select(F.col(kind).alias("kind"), F.col(score).alias("v")).distinct()
    w = Window.partitionBy("kind").orderBy("v")
    ranked = distinct.select("kind", "v", F.row_number().over(w).cast("long").alias("rank"), F.lead("v").over(w).alias("_next"))
    above = ranked.select("kind", "rank", "v", F.coalesce((F.col("v") + F.col("_next")) / 2, F.col("v") + 1.0).alias("theta"))
    below = ranked.filter("rank = 1").select("kind", F.lit(0).cast("long").alias("rank"), F.lit(None).cast("double").alias("v"), (F.col("v") - 1.0).alias("theta"))
    return above.unionByName(below)


def _outcome(cards: Column, case: Column, skill: Column, limit: int) -> Column:
    """SUMS of one query where cards of a rank above `case` or `skill` pass, in their order, up to `limit`."""
    passed = F.slice(F.filter(cards, lambda c: c["rank"] > F.when(c["first"], case).otherwise(skill)), 1, limit)
    unit = math.lcm(*range(1, limit + 1))
    n = F.size(passed)
    bad = F.size(F.filter(passed, lambda c: c["bad"]))
    fdr = F.when(n == 0, 0).when(F.forall(passed, lambda c: c["excluded"]), unit).otherwise(F.try_divide(bad * unit, n)).cast("long")
    return F.struct(
        (~F.col("covered") & (n == 0)).cast("long").alias("abst"), F.exists(passed, lambda c: c["useful"]).cast("long").alias("kept"),
        F.when(F.col("covered"), fdr).otherwise(0).cast("long").alias("fdr"), (F.col("covered") & (n > 0)).cast("long").alias("ne"),
    )


def pair_slacks(cards: DataFrame, first_kind: str, limit: int = 5, abstain: float = 0.0, useful: float = 0.5, contamination: float = 0.95) -> DataFrame:
    """For every pair of thresholds of two kinds: theta_case (of first_kind), theta_skill, the four slacks, the least one, and whether it is
    the pair to take: feasible, of the largest least slack, then the larger thresholds.

    cards: qid, kind, score, place (a query's order of showing), relevant, useful, excluded. Released are a query's first
    `limit` cards in that order whose score reaches their kind's threshold. A query's outcome changes only at its own scores, so each of its
    rectangles of pairs is worked out once and leaves its difference at four corners; sums of the corners along both axes
    are every pair's totals. Rows grow with the queries' own rectangles and the table's cells, not with cards times pairs. False
    discovery adds up in whole UNIT-ths, so totals are exact. A query's cards meet in one array: they are what a search returned.
    """
    ax = axis(cards, "kind", "score")
    ranked = cards.join(ax.filter("v is not null").select("kind", F.col("v").alias("score"), "rank"), ["kind", "score"])
    card = F.struct("place", "rank", (F.col("kind") == first_kind).alias("first"), (F.col("excluded") | ~F.col("relevant")).alias("bad"), "excluded", "useful")
    own = lambda first: F.array_sort(F.array_union(F.array(F.lit(0).cast("long")), F.collect_set(F.when((F.col("kind") == first_kind) == first, F.col("rank")))))
    queries = ranked.groupBy("qid").agg(F.array_sort(F.collect_list(card)).alias("cards"), F.bool_or("relevant").alias("covered"), F.bool_or("useful").alias("uses"), own(True).alias("rc"), own(False).alias("rs"))
    cells = queries.select("qid", "cards", "covered", "rs", F.posexplode("rc").alias("i", "case"), F.get("rc", F.col("i") + 1).alias("next_case"))
    cells = cells.select("cards", "covered", "case", "next_case", F.posexplode("rs").alias("j", "skill"), F.get("rs", F.col("j") + 1).alias("next_skill"))
    cells = cells.withColumn("f", _outcome(F.col("cards"), F.col("case"), F.col("skill"), limit))
    corner = lambda case, skill, sign: F.struct(F.col(case).alias("rc"), F.col(skill).alias("rs"), F.lit(sign).alias("sign"))
    corners = F.filter(F.array(corner("case", "skill", 1), corner("next_case", "skill", -1), corner("case", "next_skill", -1), corner("next_case", "next_skill", 1)), lambda c: c["rc"].isNotNull() & c["rs"].isNotNull())
    points = cells.select("f", F.explode(corners).alias("c")).groupBy("c.rc", "c.rs").agg(*[F.sum(F.col(f"f.{m}") * F.col("c.sign")).alias(m) for m in SUMS])

    whole = queries.agg(F.count_if(~F.col("covered")).alias("unc"), F.count_if("uses").alias("base"), F.count_if("covered").alias("cov"))
    cases = ax.filter(F.col("kind") == first_kind).select(F.col("rank").alias("rc"), F.col("theta").alias("theta_case"))
    skills = ax.filter(F.col("kind") != first_kind).select(F.col("rank").alias("rs"), F.col("theta").alias("theta_skill"))
    last = skills.agg(F.max("rs").alias("_last"))
    table = cases.crossJoin(F.broadcast(last)).select("rc", "theta_case", F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias("rs"))  # one row
    table = table.join(points, ["rc", "rs"], "left").join(skills, "rs")
    down = Window.partitionBy("rc").orderBy("rs").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy("rs").orderBy("rc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for w in (down, across):
        table = table.withColumns({m: F.sum(F.coalesce(m, F.lit(0))).over(w) for m in SUMS})
    unit = float(math.lcm(*range(1, limit + 1)))
    rate = lambda a, b, none: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(none))
    slacks = {
        "abstain_slack": rate("abst", "unc", 1.0) - abstain, "useful_slack": rate("kept", "base", 1.0) - useful,
        "fdr_slack": contamination - rate("fdr", "cov", 0.0) / unit, "shown_fdr_slack": contamination - rate("fdr", "ne", 0.0) / unit,
    }
    out = table.crossJoin(F.broadcast(whole)).select("theta_case", "theta_skill", *[F.round(v, 9).alias(k) for k, v in slacks.items()])  # one row
    out = out.withColumn("slack", F.least(*slacks))
    best = out.filter("slack >= 0").agg(F.max(F.struct("slack", "theta_case", "theta_skill")).alias("_best"))
    chosen = F.coalesce(F.struct("slack", "theta_case", "theta_skill") == F.col("_best"), F.lit(False))
    return out.crossJoin(F.broadcast(best)).withColumn("chosen", chosen).drop("_best")  # one row


def totals_from_the_top(points: DataFrame, by: str, sums: tuple[str, ...]) -> DataFrame:
    """Each row's running totals of `sums` over the rows with `by` no smaller than its own; `by` is unique.

    Rows are dealt out by range and summed within their range; the ranges' totals, one row each, are added.
    """
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(points.repartitionByRange(parts, F.desc(by)).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_part").orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_part").agg(*[F.sum(c).alias(c) for c in sums])
    ranges = ranges.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_above_{c}") for c in sums])  # a row a partition
    rows = dealt.withColumns({c: F.sum(c).over(own) for c in sums})
    return joined_small(rows, ranges, F.col("_part") == F.col("_p"), parts * 64).withColumns({c: F.col(c) + F.col(f"_above_{c}") for c in sums}).select(*points.columns)


def sweep_all(scored: DataFrame, score: str, relevant: Column) -> DataFrame:
    """threshold, tp, fp, fn, precision, recall at every distinct score; a row is counted once, at its own score, whatever the number of thresholds."""
    points = scored.select(F.col(score).alias("threshold"), relevant.alias("_rel")).groupBy("threshold").agg(F.count_if("_rel").alias("tp"), F.count_if(~F.col("_rel")).alias("fp"))
    good = points.agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("_good"))
    out = totals_from_the_top(points, "threshold", ("tp", "fp")).crossJoin(F.broadcast(good)).withColumn("fn", F.col("_good") - F.col("tp")).drop("_good")  # one row
    share = lambda a, b: F.when(b == 0, 1.0).otherwise(a / b)
    return out.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})


def floors_all(cards: DataFrame, limit: int = 5) -> DataFrame:
    """theta, and how many queries abstain as they must, keep something useful, show anything though covered, and the covered ones' false discovery, at every
    distinct score; cards as for pair_slacks, of any kind.

    A query's outcome changes only at its own scores: each leaves the difference to its outcome at the next higher one, and running sums of the
    differences are the totals. So a card counts once, not once a threshold. False discovery is in whole UNIT-ths until the end.
    """
    unit = math.lcm(*range(1, limit + 1))
    card = F.struct("place", "score", (F.col("excluded") | ~F.col("relevant")).alias("bad"), "excluded", "useful")
    queries = cards.groupBy("qid").agg(F.array_sort(F.collect_list(card)).alias("cards"), F.bool_or("relevant").alias("covered"), F.reverse(F.array_sort(F.collect_set("score"))).alias("own"))

    def outcome(theta: Column) -> Column:
        passed = F.slice(F.filter("cards", lambda c: c["score"] >= theta), 1, limit)  # nothing passes a null
        n, bad = F.size(passed), F.size(F.filter(passed, lambda c: c["bad"]))
        fdr = F.when(n == 0, 0).when(F.forall(passed, lambda c: c["excluded"]), unit).otherwise(F.try_divide(bad * unit, n))
        return F.struct((~F.col("covered") & (n == 0)).cast("long").alias("abst"), F.exists(passed, lambda c: c["useful"]).cast("long").alias("kept"), (F.col("covered") & (n > 0)).cast("long").alias("ne"), F.when(F.col("covered"), fdr).otherwise(0).cast("long").alias("fdr"))

    steps = queries.select("cards", "covered", F.posexplode("own").alias("i", "theta"), F.when(F.col("i") > 0, F.get("own", F.col("i") - 1)).alias("_above"))
    steps = steps.select("theta", outcome(F.col("theta")).alias("now"), outcome(F.col("_above")).alias("before"))
    points = steps.groupBy("theta").agg(*[F.sum(F.col(f"now.{m}") - F.col(f"before.{m}")).alias(m) for m in SUMS])
    start = queries.agg(F.count_if(~F.col("covered")).alias("_unc"))  # above all scores every query abstains
    out = totals_from_the_top(points, "theta", SUMS).crossJoin(F.broadcast(start))  # one row
    return out.select("theta", (F.col("abst") + F.col("_unc")).alias("abstained"), "kept", F.col("ne").alias("shown"), F.round(F.col("fdr") / unit, 9).alias("false_discovery"))
