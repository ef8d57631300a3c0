"""URL filters: fixed host and path rules, and association rules that Spark's FP-growth mines from labelled URLs.

A fixed rule fits its host and all subdomains where the path starts with the rule's; the longest wins. Labelled URLs are those
that a fixed rule decides, then those whose host holds a blocked word, then those of a table of labels. A URL's tokens are
its host's words by level, its path's segments and its query's names, digits as one sign. Distinct labelled URLs count
once each, so that copies carry no weight. All tokens that are common enough make the transactions. Rules `combination -> label`, of
any length, stay if support and confidence suffice and no rule with fewer of the same tokens has the same label. A URL that no fixed
rule decides takes the label of the mined rule with the highest confidence (then support, then block, then the least
tokens); without one it is allowed. Rules are found through an inverted index: each stands under its rarest token.

FP-growth lists all common combinations, 2**k for k tokens. Where a URL has more than NARROW common tokens, its table is first divided as
FP-growth does itself: for each token, the rows that have it, with their tokens that are more common (conditional tables), again
and again while a table has wider rows. Tokens that no rule can need beside those given are left out there: those in all rows of a table, as
the same rule holds without them, and those after which the rules for all labels that are common enough have been found. FP-growth then runs once
over all narrow tables. This loses no rule; many tokens that are common together, but never always, and no sign of the label still cost a
table for each of their combinations.

Null URLs and those without `://` have an empty host and path, and are allowed unless a rule says otherwise. Ids may be null
or repeat: one row out for each row in. An empty table, or one without labelled URLs, gives no mined rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import dropped, over_texts, scratch, written

#: (verdict, host, path): the rules of the registered query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
# Words that block a host for training, where no rule decides.
BLOCKED_WORDS = ("adult", "bet", "bets", "casino", "gambling", "gamble", "jackpot", "loan", "loans", "payday", "pharma", "pharmacy", "pills", "poker", "porn", "replica", "sex", "slots", "viagra", "warez", "xxx")
ALLOW, BLOCK = "allow", "block"
#: Neither the tokens in use nor those of one URL are bounded; tests read these.
VOCABULARY = WIDTH = None
#: Tables whose rows have more tokens are divided before FP-growth. Rules of more tokens than LONGEST are pruned by containment, others by lookups.
NARROW, LONGEST = 10, 3
#: More rules than these are joined to the URLs rather than held by each task.
HELD = 50_000
#: A rule needs this share of the labelled URLs, and so many of them at least, and this confidence.
SUPPORT, LEAST, CONFIDENCE = 0.002, 10, 0.9

_LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_CUT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_WORDS = re.compile(r"[^\W_]+")
_DIGITS = re.compile(r"[0-9]+")
_NAME = re.compile(r"(?:^|&)([^=&]+)")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _CUT, 1), F.lit("")), *_LETTERS)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _CUT, 2), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none. Of two as long a block wins."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == BLOCK)):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens_of(url: str | None) -> set[str]:
    """What a URL is made of; `host` tokens come with no level, the last label as `tld`."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return set()
    rest, _, _ = rest.partition("#")
    rest, _, query = rest.partition("?")
    host, _, path = rest.partition("/")
    labels = host.lower().split(".")
    out = {f"tld={labels[-1]}"} | {f"host={w}" for label in labels[:-1] for w in _WORDS.findall(label)}
    segments = [s for s in path.split("/") if s]
    for level, segment in enumerate(segments, 1):
        out.add(f"path{level}={_DIGITS.sub('#', segment.lower())}")
    return out | {f"query={n.lower()}" for n in _NAME.findall(query)}


def _tokens_made():
    return lambda x: {"label": x["label"], "tokens": [sorted(tokens_of(u)) for u in x["url"]]}


def labelled(pages: DataFrame, labels: DataFrame | None, rules: Iterable[tuple[str, str, str]] = RULES, words: Iterable[str] = BLOCKED_WORDS, url: str = "url", key: str = "page_id") -> DataFrame:
    """url and label of the distinct URLs that have one. labels has key and block (a boolean); URLs with both labels there are blocked."""
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("url")).filter(F.col("url").isNotNull())
    host = host_of(F.col("url"))
    said = fixed_rule(host, path_of(F.col("url")), rules)["verdict"]
    word = F.arrays_overlap(F.split(host, r"[^a-z0-9]+"), F.array(*map(F.lit, words)))
    if labels is not None:
        each = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max("block").alias("_block"))
        rows = rows.join(each, "_key", "left")
    else:
        rows = rows.withColumn("_block", F.lit(None).cast("boolean"))
    label = F.coalesce(said, F.when(word, BLOCK), F.when(F.col("_block"), BLOCK).when(~F.col("_block"), ALLOW))
    return rows.select("url", label.alias("label")).filter(F.col("label").isNotNull()).groupBy("url").agg(F.max("label").alias("label"))


def mined(urls: DataFrame, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE) -> DataFrame:
    """tokens (in order), label, confidence, n (URLs with both): the rules that FP-growth finds in labelled URLs and that pruning leaves."""
    with scratch() as made:
        rows = over_texts(urls, _tokens_made, "label string, tokens array<string>").withColumn("id", F.monotonically_increasing_id())
        rows = written(rows, "url-tokens")
        n = rows.count()
        need = max(least, int(-(-n * support // 1)))
        part = rows.select(F.array().cast("array<string>").alias("given"), F.lit(n).cast("long").alias("held"), "id", (F.col("label") == BLOCK).alias("block"), "tokens")
        found, ready = [], []
        while part is not None:
            part, narrow, rules = divided(part, need, confidence)
            ready += [narrow] if narrow is not None else []
            found += [rules] if rules is not None else []
        if ready:
            found.append(grown(reduce(DataFrame.unionByName, ready), need, confidence))
        rules = [written(f, "url-rules") for f in found]
    none = urls.sparkSession.createDataFrame([], "tokens array<string>, label string, confidence double, n bigint")
    kept = written(pruned(reduce(DataFrame.unionByName, rules)), "url-rules-kept") if rules else none
    dropped(*made)
    return kept


def divided(part: DataFrame, need: int, confidence: float) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """One round of dividing: the conditional tables of wide tables, the narrow tables, and the rules `given and one token -> label` of the wide ones.

    part: given (a table's tokens), held (its rows), id, block, tokens (those that may be beside the given ones). A None stands for no rows.
    """
    each = part.select("given", "held", "id", "block", F.explode("tokens").alias("token"))
    blocked = F.sum(F.col("block").cast("long"))
    counts = written(each.groupBy("given", "held", "token").agg(F.count("*").alias("n"), blocked.alias("b")).filter(F.greatest(F.col("b"), F.col("n") - F.col("b")) >= need), "url-counts")
    common = each.join(counts, ["given", "held", "token"]).groupBy("given", "held", "id", "block")
    sets = written(common.agg(F.array_sort(F.collect_list(F.struct("n", "b", "token"))).alias("tokens")), "url-sets")
    widest = sets.agg(F.max(F.size("tokens"))).first()[0]
    if widest is None:
        return None, None, None
    tokens = F.transform("tokens", lambda t: t["token"])
    if widest <= NARROW:
        return None, sets.select("given", "block", tokens.alias("tokens")), None
    wide = sets.filter(F.size("tokens") > NARROW).select("given").distinct()
    narrow = sets.join(wide, "given", "left_anti").select("given", "block", tokens.alias("tokens"))
    sides = F.explode(F.array(F.struct(F.lit(BLOCK).alias("label"), F.col("b").alias("m")), F.struct(F.lit(ALLOW).alias("label"), (F.col("n") - F.col("b")).alias("m"))))
    rules = counts.join(wide, "given", "left_semi").select(F.array_sort(F.concat("given", F.array("token"))).alias("tokens"), "n", sides.alias("s"))
    rules = rules.select("tokens", "s.label", (F.col("s.m") / F.col("n")).alias("confidence"), F.col("s.m").alias("n")).filter((F.col("n") >= need) & (F.col("confidence") >= confidence))

    def undecided(t: Column) -> Column:
        return (t["n"] < F.col("held")) & (((t["b"] >= need) & (t["b"] / t["n"] < confidence)) | ((t["n"] - t["b"] >= need) & ((t["n"] - t["b"]) / t["n"] < confidence)))

    # In order of n: a token's table has the tokens after it, the more common ones.
    left = sets.join(wide, "given", "left_semi").select("given", "id", "block", F.filter("tokens", undecided).alias("tokens")).filter(F.size("tokens") > 1)
    left = left.select("given", "id", "block", "tokens", F.posexplode("tokens").alias("at", "one"))
    after = F.slice(F.transform("tokens", lambda t: t["token"]), F.col("at") + 2, F.greatest(F.size("tokens"), F.lit(1)))
    left = left.select(F.concat("given", F.array("one.token")).alias("given"), F.col("one.n").alias("held"), "id", "block", after.alias("tokens"))
    return left.filter(F.size("tokens") > 0), narrow, rules


def grown(ready: DataFrame, need: int, confidence: float) -> DataFrame:
    """The rules with more tokens than the given ones, by one run of FP-growth over all tables: an item is a token within its table."""
    total = max(ready.count(), need)
    item = lambda token, label: F.to_json(F.struct("given", token.alias("token"), label.alias("label")))
    none = F.lit(None).cast("string")
    items = F.concat(F.transform("tokens", lambda t: item(t, none)), F.array(item(none, F.when(F.col("block"), BLOCK).otherwise(ALLOW))))
    model = FPGrowth(itemsCol="items", minSupport=need / total * (1 - 1e-9), minConfidence=confidence).fit(ready.select(items.alias("items")))
    read = lambda i: F.from_json(i, "given array<string>, token string, label string")
    found = model.associationRules.select(F.transform("antecedent", read).alias("own"), read(F.element_at("consequent", 1)).alias("to"), "confidence", "support").filter(F.col("to.label").isNotNull())
    return found.select(
        F.array_sort(F.concat("to.given", F.transform("own", lambda i: i["token"]))).alias("tokens"), F.col("to.label").alias("label"), "confidence", F.round(F.col("support") * total).cast("long").alias("n")
    )


def under(rules: DataFrame) -> DataFrame:
    """The rules and the one of their tokens that the fewest rules have."""
    each = rules.select("*", F.explode("tokens").alias("token"))
    uses = each.groupBy("token").agg(F.count("*").alias("uses"))
    least = each.select("tokens", "label", "token").join(uses, "token").groupBy("tokens", "label").agg(F.min(F.struct("uses", "token"))["token"].alias("token"))
    return rules.join(least, ["tokens", "label"])


def pruned(rules: DataFrame) -> DataFrame:
    """Without the rules that have all the tokens of another rule with the same label and more.

    A rule of at most LONGEST tokens looks up its proper subsets, 6 at most, instead of all other rules; a longer one meets those whose rarest token it has.
    """
    subsets = F.array(*(F.array_compact(F.array(*(F.get("tokens", F.lit(i)) if mask >> i & 1 else F.lit(None).cast("string") for i in range(LONGEST)))) for mask in range(1, 1 << LONGEST)))
    short = rules.filter(F.size("tokens") <= LONGEST)
    ours = short.select("tokens", "label", F.explode(F.array_distinct(subsets)).alias("part")).filter(F.size("part") < F.size("tokens"))
    smaller = rules.select(F.col("tokens").alias("part"), "label")
    more = ours.join(smaller, ["part", "label"]).select("tokens", "label")
    long = rules.filter(F.size("tokens") > LONGEST).select("tokens", "label", F.explode("tokens").alias("token"))
    parts = under(rules.select("tokens", "label")).withColumnRenamed("tokens", "part")
    holds = (F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0)
    more = more.unionByName(long.join(parts, ["token", "label"]).filter(holds).select("tokens", "label"))
    return rules.join(more.distinct(), ["tokens", "label"], "left_anti")


class Index:
    """Rules by their rarest token, at most HELD of them."""

    def __init__(self, rules: Iterable[tuple[tuple[str, ...], str, float, int]]):
        ranked = sorted(((-c, -n, label != BLOCK, tuple(tokens), label) for tokens, label, c, n in rules))
        uses: dict[str, int] = {}
        for *_, tokens, _ in ranked:
            for t in tokens:
                uses[t] = uses.get(t, 0) + 1
        self.under: dict[str, list] = {}
        for rank, (*_, tokens, label) in enumerate(ranked):
            self.under.setdefault(min(tokens, key=lambda t: (uses[t], t)), []).append((rank, frozenset(tokens), label))

    def best(self, tokens: set[str]) -> tuple[str, str] | None:
        """The label and the tokens of the first rule by rank that the tokens hold."""
        fits = [r for t in tokens for r in self.under.get(t, ()) if r[1] <= tokens]
        if not fits:
            return None
        _, own, label = min(fits, key=lambda r: r[0])
        return label, " ".join(sorted(own))


def _split():
    return lambda x: {**x, "own": [sorted(tokens_of(u)) for u in x["_url"]]}


def _matched(rules: list[tuple]):
    def make():
        index = Index(rules)

        def run(x: dict) -> dict:
            found = [index.best(tokens_of(u)) for u in x["_url"]]
            return {**{k: v for k, v in x.items() if k != "_url"}, "_label": [f and f[0] for f in found], "mined_rule": [f and f[1] for f in found]}

        return run

    return make


def joined(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows with _label and mined_rule, as _matched() gives them, by a join: for more rules than a task should hold."""
    each = over_texts(rows.select("_url").filter(F.col("_url").isNotNull()).distinct(), _split, "_url string, own array<string>")
    each = written(each.withColumn("id", F.monotonically_increasing_id()), "url-own")
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("n")).alias("n"), (F.col("label") != BLOCK).alias("b"), "tokens", "label"))
    # A URL's tokens go to the rules one by one; all of them meet only the rules found so.
    fits = each.select("id", F.explode("own").alias("token")).join(under(found), "token").join(each.select("id", "own"), "id").filter(F.size(F.array_except("tokens", "own")) == 0)
    first = fits.groupBy("id").agg(best.alias("best")).join(each.select("id", "_url"), "id")
    first = first.select("_url", F.col("best.label").alias("_label"), F.concat_ws(" ", "best.tokens").alias("mined_rule"))
    return rows.join(first, "_url", "left").select("_key", "host", "path", "_label", "mined_rule")


def judge(pages: DataFrame, labels: DataFrame | None = None, rules: Iterable[tuple[str, str, str]] = RULES, found: DataFrame | None = None, url: str = "url", key: str = "page_id") -> DataFrame:
    """One row for each page: key, host, path, rule (the fixed one, or null), verdict, mined_rule (null if none fits or a fixed rule decides).

    labels: key and block (a boolean) for some pages. found: rules mined before; else they are mined from these pages.
    """
    if found is None:
        found = mined(labelled(pages, labels, rules, url=url, key=key))
    held = [(tuple(r["tokens"]), r["label"], r["confidence"], r["n"]) for r in found.limit(HELD + 1).collect()]
    rows = pages.select(F.col(key).cast("long").alias("_key"), F.col(url).alias("_url"))
    rows = rows.select("_key", "_url", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    if len(held) > HELD:
        out = joined(rows, found)
    else:
        out = over_texts(rows, _matched(held), "_key bigint, host string, path string, _label string, mined_rule string")
    rule = fixed_rule(F.col("host"), F.col("path"), rules)
    return out.select(
        F.col("_key").alias(key), "host", "path", rule["rule"].alias("rule"), F.coalesce(rule["verdict"], F.col("_label"), F.lit(ALLOW)).alias("verdict"),
        F.when(rule["rule"].isNull(), F.col("mined_rule")).alias("mined_rule"),
    )
