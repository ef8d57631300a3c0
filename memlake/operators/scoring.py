"""Estimates, floors, arms and health of scored candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators import statistics as S

#: Sums of a floor cell: uncovered and abstained, useful before and kept, covered and shown, false discovery.
CELLS = ("unc", "abst", "base", "kept", "cov", "ne", "fdr")


def renormalised(strata: DataFrame, size: str, seen: str) -> DataFrame:
    """weight: each stratum's share, shared out among the strata with observations; gap: share but no observation."""
    everything = Window.partitionBy()  # strata are few
    share = F.col(size) / F.sum(size).over(everything)
    rows = strata.withColumn("_share", share)
    observed = F.sum(F.when(F.col(seen) > 0, F.col("_share"))).over(everything)
    weight = F.when(F.col(seen) > 0, F.col("_share") / observed).otherwise(0.0)
    return rows.withColumns({"weight": weight, "gap": (F.col(seen) == 0) & (F.col("_share") > 0)}).drop("_share")


def overall(strata: DataFrame, k: str, n: str, floor: int, z: float = 1.96) -> DataFrame:
    """rate, low, high, gaps, method of renormalised strata; null rates where nothing was observed."""
    p = F.when(F.col(n) > 0, F.col(k) / F.col(n))
    one = strata.agg(
        F.sum(F.col("weight") * p).alias("rate"),
        F.sqrt(F.sum(F.col("weight") * F.col("weight") * p * (1 - p) / F.col(n))).alias("sd"),
        F.count_if("gap").alias("gaps"),
        F.count_if(F.col(n) > 0).alias("_seen"),
        F.count_if((F.col(n) > 0) & (F.col(n) < floor)).alias("_small"),
    )
    method = F.when(F.col("_seen") == 0, "undefined").when(F.col("_small") > 0, "bootstrap").otherwise("analytic")
    half = z * F.col("sd")
    return one.select("rate", F.greatest(F.lit(0.0), F.col("rate") - half).alias("low"), F.least(F.lit(1.0), F.col("rate") + half).alias("high"), "gaps", method.alias("method"))


def decision(low: Column, high: Column, red_flag: Column, cheap: Column, needed: float) -> Column:
    """HOLD without an interval, then go, no-go, or in between."""
    go = (low >= needed) & ~red_flag & cheap
    stop = (high < needed) | red_flag | ~cheap
    return F.when(low.isNull() | high.isNull(), "HOLD").when(go, "clear GO").when(stop, "clear NO-GO").otherwise("marginal")


def band(k: Column, n: Column) -> Column:
    low, _ = S.wilson(k, n, 1.6449)
    p, mark = k / n, F.when(low < 0.25, "_exploratory").otherwise("")
    return F.when(n < 10, "invalid_n").when(p >= 0.5, F.concat(F.lit("strong_pass"), mark)).when(p >= 0.4, F.concat(F.lit("borderline_pass"), mark)).when(p >= 0.3, "weak_signal").otherwise("clear_fail")


def retrieval_report(covered: DataFrame, shown: DataFrame) -> DataFrame:
    """One row from queries (qid, covered, uses) and their shown cards (qid, r, relevant, useful); a query that shows nothing counts with zeros."""
    c = F.col
    per = shown.groupBy("qid").agg(F.count("*").alias("shown"), F.count_if("relevant").alias("rel"), F.bool_or("useful").alias("hit"), F.min(F.when(c("relevant"), c("r"))).alias("first"))
    q = covered.join(per, "qid", "left").fillna({"shown": 0, "rel": 0, "hit": False})
    some, width = c("covered") & c("first").isNotNull(), F.greatest("shown", F.lit(1))
    sums = q.agg(
        F.count("*").alias("n_total"), F.count_if("covered").alias("n_covered"), F.count_if(~c("covered")).alias("n_uncovered"), F.count_if(c("covered") & c("uses")).alias("_uses"), F.count_if(c("covered") & c("hit")).alias("_kept"), F.count_if("hit").alias("_any"),
        F.count_if(some).alias("_hits"), F.count_if(some & c("hit")).alias("_hits_useful"), *[F.count_if(c("covered") & (c("first") <= k)).alias(f"_h{k}") for k in (1, 3, 5)], F.sum(F.when(c("covered"), 1.0 / c("first"))).alias("_rr"), F.sum(c("rel") / width).alias("_prec"),
        F.sum(F.when(~c("covered"), c("rel") / width)).alias("_u_rel"), F.sum(F.when(~c("covered"), (c("shown") - c("rel")) / width)).alias("_u_irr"),
    )
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(c(a), c(b)), F.lit(0.0)), 9)
    low, _ = S.wilson(c("_kept"), c("n_covered"), 1.6449)
    out = {"coverage": ("n_covered", "n_total"), "useful_coverage": ("_uses", "n_total"), "covered_useful_hit_at_5": ("_kept", "n_covered"), "global_useful_hit_at_5": ("_any", "n_total"), "conditional_hit": ("_hits", "n_covered"), "conditional_useful": ("_hits_useful", "_hits"), "useful_exists_rate": ("_uses", "n_covered"), "hit_at_1": ("_h1", "n_covered"), "hit_at_3": ("_h3", "n_covered"), "hit_at_5": ("_h5", "n_covered"), "mrr": ("_rr", "n_covered"), "precision_at_5": ("_prec", "n_total"), "uncovered_pseudo_relevant_rate": ("_u_rel", "n_uncovered"), "uncovered_irrelevant_rate": ("_u_irr", "n_uncovered")}
    guard = (c("n_uncovered") > 0) & (F.coalesce(F.try_divide(c("_u_irr"), c("n_uncovered")), F.lit(0.0)) >= 0.6)
    return sums.select("n_total", "n_covered", "n_uncovered", *[rate(*ab).alias(name) for name, ab in out.items()], F.round(F.when(c("n_covered") > 0, low).otherwise(0.0), 9).alias("covered_useful_hit_wilson_lo"), guard.alias("go_with_guard"))


def false_discovery(shown: DataFrame, released: Column) -> DataFrame:
    """qid, returned, fdr: 0 where nothing is released, 1 where only excluded cards are, else the share not known to be relevant."""
    n, bad = F.count_if(released), F.count_if(released & (F.col("excluded") | ~F.col("relevant")))
    only = F.count_if(released & ~F.col("excluded")) == 0
    return shown.groupBy("qid").agg(n.alias("returned"), F.when(n == 0, 0.0).when(only, 1.0).otherwise(F.try_divide(bad, n)).alias("fdr"))


def floor_cells(cards: DataFrame, thetas: list[float], fold: Column) -> DataFrame:
    """fold, theta and CELLS: what each group of queries adds to the floors at each threshold. Cells are few: folds x thetas."""
    c, on = F.col, F.col("score") >= F.col("theta")
    per = cards.withColumn("fold", fold).withColumn("theta", F.explode(F.array(*map(F.lit, thetas)))).groupBy("qid", "fold", "theta").agg(
        F.bool_or("relevant").alias("covered"), F.bool_or("useful").alias("uses"), F.count_if(on).alias("shown"), F.count_if(on & (c("excluded") | ~c("relevant"))).alias("bad"), (F.count_if(on & ~c("excluded")) == 0).alias("only"), (F.count_if(on & c("useful")) > 0).alias("hit")
    )
    fdr = F.when(c("shown") == 0, 0.0).when(c("only"), 1.0).otherwise(F.try_divide(c("bad"), c("shown")))
    return per.groupBy("fold", "theta").agg(
        F.count_if(~c("covered")).alias("unc"), F.count_if(~c("covered") & (c("shown") == 0)).alias("abst"), F.count_if("uses").alias("base"), F.count_if(c("uses") & c("hit")).alias("kept"),
        F.count_if("covered").alias("cov"), F.count_if(c("covered") & (c("shown") > 0)).alias("ne"), F.coalesce(F.sum(F.when(c("covered"), fdr)), F.lit(0.0)).alias("fdr"),
    )


def slack(abstain: float = 0.0, useful: float = 0.5, contamination: float = 0.95) -> Column:
    """The least of four slacks; an empty denominator counts as met."""
    rate = lambda a, b, none: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(none))
    return F.round(F.least(rate("abst", "unc", 1.0) - abstain, rate("kept", "base", 1.0) - useful, contamination - rate("fdr", "cov", 0.0), contamination - rate("fdr", "ne", 0.0)), 9)


def held_out(cells: DataFrame, any_theta: float) -> DataFrame:
    """fold, theta (null: abstain), and the fold's own outcomes under the threshold fitted without it."""
    w = Window.partitionBy("theta")
    rest = cells.select("fold", "theta", *[(F.sum(c).over(w) - F.col(c)).alias(c) for c in CELLS]).withColumn("slack", slack()).filter("slack >= 0")
    order = Window.partitionBy("fold").orderBy(F.desc("slack"), F.desc("theta"))
    fitted = rest.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("fold", "theta")
    folds = cells.select("fold").distinct().join(fitted, "fold", "left")
    own = cells.select(F.col("fold").alias("_fold"), F.col("theta").alias("_theta"), *CELLS)
    rows = folds.join(own, (F.col("fold") == F.col("_fold")) & (F.coalesce("theta", F.lit(any_theta)) == F.col("_theta")))
    none = F.col("theta").isNull()
    return rows.select("fold", "theta", "unc", F.when(none, F.col("unc")).otherwise(F.col("abst")).alias("abstained"), "base", F.when(none, 0).otherwise(F.col("kept")).alias("kept"), F.round(F.when(none, 0.0).otherwise(F.col("fdr")), 9).alias("fdr"))


def arms(native: tuple[float, float], cos: float, cos_pair: tuple[float, float], ce: float, z: float, margin: float) -> dict[str, Column]:
    """Release predicates by name over kind, score, cos, ce, mu, sd, decoy. Add a column under a name for another arm."""
    c, case = F.col, F.col("kind") == "case"
    pair = lambda column, two: c(column) >= F.when(case, two[0]).otherwise(two[1])
    return {
        "native_pertype": pair("score", native),
        "cos_unified": c("cos") >= cos,
        "cos_pertype": pair("cos", cos_pair),
        "ce_fixed": c("ce") >= ce,
        "ce_znorm": (c("sd") > 0) & (F.round(F.try_divide(c("ce") - c("mu"), c("sd")), 9) >= z),
        "null_ref": c("ce") >= c("decoy") + margin,
    }


def directions(rows: DataFrame, released: Column) -> DataFrame:
    """For each variant of the labels (rel, use): leaks, kills, wrong and useless cards, the direction, and whether all agree."""
    c = F.col
    per = rows.groupBy("variant", "qid").agg(F.bool_or("rel").alias("covered"), F.bool_or("use").alias("uses"), F.count_if(released).alias("shown"), F.count_if(released & c("use")).alias("hits"), F.count_if(released & ~c("rel")).alias("wrong"), F.count_if(released & c("rel") & ~c("use")).alias("useless"))
    sums = per.groupBy("variant").agg(
        F.count_if(~c("covered") & (c("shown") > 0)).alias("leaks"), F.count_if(c("uses") & (c("hits") == 0)).alias("kills"), F.coalesce(F.sum(F.when(c("covered"), c("wrong"))), F.lit(0)).alias("covered_wrong"), F.coalesce(F.sum(F.when(c("covered"), c("useless"))), F.lit(0)).alias("relevant_not_useful")
    )
    label = sums.withColumn("direction", F.when(c("kills") > c("leaks"), "kill-heavy").when(c("kills") < c("leaks"), "leak-heavy").otherwise("balanced"))
    return label.withColumn("stable", F.size(F.collect_set("direction").over(Window.partitionBy())) == 1)  # one row a variant


def drift(rows: DataFrame, groups: list[str], key: list[str], score: str, observed: str, theta: float) -> DataFrame:
    """For each group the widest spread of a key's observed scores, and whether a threshold is further from every score."""
    keys = rows.groupBy(*groups, *key).agg((F.max(observed) - F.min(observed)).alias("_spread"), F.min(F.abs(F.col(score) - theta)).alias("_near"))
    out = keys.groupBy(*groups).agg(F.round(F.max("_spread"), 9).alias("drift"), F.round(F.min("_near"), 9).alias("nearest"))
    return out.withColumn("margin_ok", F.col("nearest") > F.col("drift"))


def latencies(rows: DataFrame, group: str, value: str, p95: float, most: float, least_rows: int) -> DataFrame:
    """Nearest-rank percentiles and means for each group, first calls (cold) apart, and a gate of three tests."""
    n = F.col("n")
    at = S.at_ranks(rows, group, value, {f"p{k}": F.greatest(F.ceil(n * (k / 100)), F.lit(1)) - 1 for k in (50, 95, 99)}).drop("n").withColumnRenamed(group, "_group")
    out = rows.groupBy(group).agg(
        F.count("*").alias("n"), F.count_if("cold").alias("cold"), F.min(value).alias("least"), F.max(value).alias("most"),
        F.round(F.avg(value), 6).alias("mean"), F.round(F.avg(F.when(F.col("cold"), F.col(value))), 6).alias("cold_mean"), F.round(F.avg(F.when(~F.col("cold"), F.col(value))), 6).alias("warm_mean"),
    )
    out = out.join(at, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")
    return out.withColumn("ok", (F.col("p95") <= p95) & (F.col("most") <= most) & (F.col("n") >= least_rows))


def length_report(rows: DataFrame, top: int) -> DataFrame:
    """command, n, total, p50, p95, most, share of the `top` commands by characters, from counts of each distinct length."""
    hist = rows.groupBy("command", "chars").agg(F.count("*").alias("c"))
    w = Window.partitionBy("command").orderBy("chars").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = hist.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("command")))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("chars")))  # noqa: E731  (value at 0-based place i)
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    one = run.groupBy("command").agg(F.max("n").alias("n"), F.sum(F.col("c") * F.col("chars")).alias("total"), F.floor((at(low) + at(high)) / 2).alias("p50"), at(F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1)).alias("p95"), F.max("chars").alias("most"))
    share = F.round(100.0 * F.col("total") / F.sum("total").over(Window.partitionBy()), 6)  # one row a command
    return one.withColumn("share", share).orderBy(F.desc("total"), "command").limit(top)


def healthy(status: Column, cards: Column, accepted: Column, pins: Column, needed: tuple[str, ...]) -> Column:
    """Whether a scored row counts: ok, exactly the accepted cards, every number there and finite, every pin known."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    keys = F.map_keys(cards)
    same = (F.size(F.array_except(keys, accepted)) == 0) & (F.size(F.array_except(accepted, keys)) == 0)
    numbers = F.forall(F.map_values(cards), lambda v: finite(v["cos"]) & finite(v["ce"]))
    known = F.lit(True)
    for pin in needed:
        known = known & (F.coalesce(F.try_element_at(pins, F.lit(pin)), F.lit("unknown")) != "unknown")
    return F.coalesce((status == "ok") & same & numbers & known, F.lit(False))
