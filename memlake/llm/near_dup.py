"""Near duplicates by bottom-k sketches.

A text's words (ASCII white space between them, A-Z lower-cased) give a set of shingles, hashed by one function to 64 bits;
the K smallest hashes are its sketch. Texts with equal sets are one class, so that copies are handled once.

Inverted lists. Two sets of similarity 0.8 or more share at least OVERLAP of K retained values, except with probability
P(Bin(64, 0.8) <= 31) = 2.0e-8 at most (reached by large sets of which one holds the other, at 0.8 exactly; with MARGIN's
4.4e-9 below, at most 2.4e-8 a pair; sets of at most 51 shingles are exact). So, with each sketch's values in order of how many
classes retain them, rarest first, such pairs share a value among the first K - OVERLAP + 1: only these enter the lists.
A passage that many documents share is frequent and doesn't get there, unless the documents consist mostly of it.

Overlaps. All pairs of a list would grow with its square. First each member meets its list's smallest id only, the links
found join classes to components, and then only members of different components meet; in a list all but those of its
largest component look for partners, directly in a list of at most SHORT, in a longer one by an exact prefix and positional
filter on whole sets. So a group of thousands of near copies costs a few rounds over its members, and no link that
could join two components is skipped. The union of two sketches estimates the similarity and filters (it drops a pair at 0.8 with probability P(Bin(64, 0.8) <= 30) = 4.4e-9); exact similarity on
whole sets decides.

Null texts and texts without words are linked with nothing. Rows with a null id are linked with nothing and kept.
Rows that repeat an id are one document. One row out for each row in; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import dropped, joined_small, over_texts, written

K = 64
OVERLAP = 32
#: Pairs with estimates below this part of the threshold aren't confirmed: fewer than 31 shared among the K of the union at 0.8.
MARGIN = 0.6
#: A list with more members than this is settled on whole sets.
SHORT = 32
#: Words whose hashes a task holds at once, and the longest that it holds, in bytes.
CACHE_WORDS, LONG_WORD = 100_000, 64


class Words(dict):
    """Words to their hashes."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG_WORD:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = h
        return h


def shingles(text: str, width: int, known: Words | None = None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII is lower-cased and white space
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map((Words() if known is None else known).__getitem__, words), np.uint64, len(words))
    width = min(width, len(ids))
    out = np.full(len(ids) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ ids[k : len(ids) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9))


def _sketches(width: int):
    def make():
        known = Words()

        def run(x: dict) -> dict:
            sets = [shingles(t, width, known) for t in x["_text"]]
            return {
                "_key": x["_key"],
                "n": [len(s) for s in sets],
                "fp": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "sketch": [s[:K].view(np.int64) for s in sets],
            }

        return run

    return make


def _sets(width: int):
    def make():
        known = Words()
        return lambda x: {"id": x["_key"], "full": [shingles(t, width, known).view(np.int64) for t in x["_text"]]}

    return make


def _estimates(x: dict) -> dict:
    """Similarity by the K smallest values of the union of two sketches."""
    out = []
    for a, b in zip(x["sa"], x["sb"], strict=True):
        union, n = np.unique(np.array([*a, *b], np.int64).view(np.uint64), return_counts=True)
        lowest = min(K, len(union)) if len(a) >= K or len(b) >= K else len(union)
        out.append(float((n[:lowest] > 1).sum() / lowest))
    return {"a": x["a"], "b": x["b"], "estimate": out}


def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id reachable over edges a, b (only ids that have edges). Large-star, small-star rounds."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = written(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "small")
        dropped(now, large)
        now = small
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
        seen = state


def _sets_of(ids: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """id, full: the whole sets of the texts with these ids (_key). A written table."""
    own = joined_small(texts, ids, ["_key"], "inner", 16 * ids.count(), salts=1)
    return written(over_texts(own, _sets(width), "id bigint, full array<bigint>"), "sets")


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Of the pairs a, b those whose whole sets have the similarity. A written table."""
    sets = [full.select(F.col("id").alias(i), F.col("full").alias(f"f{i}")) for i in "ab"]
    both = pairs.join(sets[0], "a").join(sets[1], "b").withColumn("_both", F.size(F.array_intersect("fa", "fb")))
    union = F.size("fa") + F.size("fb") - F.col("_both")
    return written(both.filter((100 * F.col("_both") >= percent * union) & (union > 0)).select("a", "b").distinct(), "links")


def _links(pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs a, b of class ids, those with the similarity: estimated from sketches, then confirmed. A written table."""
    ids = written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    own = joined_small(classes.select("id", "sketch"), ids, ["id"], "inner", 16 * ids.count(), salts=1)  # only these sketches move
    low, high = (own.select(F.col("id").alias(i), F.col("sketch").alias(f"s{i}")) for i in "ab")
    seen = over_texts(pairs.join(low, "a").join(high, "b").select("a", "b", "sa", "sb"), lambda: _estimates, "a bigint, b bigint, estimate double")
    near = written(seen.filter(F.col("estimate") >= MARGIN * percent / 100).select("a", "b"), "near")
    wanted = written(near.select(F.col("a").alias("_key")).unionByName(near.select(F.col("b").alias("_key"))).distinct(), "wanted")
    full = _sets_of(wanted, texts, width)
    found = _confirmed(near, full, percent)
    dropped(ids, near, wanted, full)
    return found


def _open_lists(member: DataFrame) -> DataFrame:
    """v, _many, most: the lists that hold more than one component, their length and their largest component."""
    parts = member.groupBy("v", "c").agg(F.count("*").alias("_n")).groupBy("v").agg(F.count("*").alias("_parts"), F.sum("_n").alias("_many"), F.max(F.struct("_n", "c")).alias("_most"))
    return parts.filter("_parts > 1").select("v", "_many", F.col("_most.c").alias("most"))


def _across(member: DataFrame, lists: DataFrame, condition) -> DataFrame:
    """a, b: members of the lists in different components, all but those of the largest one against the others."""
    left = member.join(lists, "v").filter("c != most").select("v", "most", *[F.col(x).alias(f"{x}a") for x in member.columns if x != "v"])
    right = member.select("v", *[F.col(x).alias(f"{x}b") for x in member.columns if x != "v"])
    apart = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("most")) | (F.col("ida") < F.col("idb")))
    return left.join(right, "v").filter(apart & condition).select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct()


def _within_reach(place: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """a, b: members of different components that share a value so early that the similarity can still be reached.

    What follows the shared value must hold at least percent / (100 + percent) of both sizes; so the smaller set, with more
    than that after the value for two of its own size, is in high reach. Members that aren't meet only smaller ones that
    are: texts that share a passage, but too little of it, meet no one.
    """
    n, left = F.col("n"), F.col("n") - F.col("at")
    tagged = place.withColumn("high", left * (100 + percent) >= 2 * percent * n).join(lists, "v")
    mine = tagged.filter("c != most").select("v", *[F.col(x).alias(f"{x}a") for x in ("id", "n", "at", "c", "high")])
    yours = tagged.select("v", *[F.col(x).alias(f"{x}b") for x in ("id", "n", "at", "c", "high")], (F.col("c") == F.col("most")).alias("mostb"))
    reach = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb")) * (100 + percent) >= percent * (F.col("na") + F.col("nb"))
    larger = (F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("mostb") | (F.col("ida") < F.col("idb"))))
    up = mine.filter("higha").join(yours, "v").filter((F.col("ca") != F.col("cb")) & larger & reach)
    down = mine.join(yours.filter("mostb and highb"), "v").filter((F.col("nb") < F.col("na")) & reach)
    return up.select(F.col("ida").alias("a"), F.col("idb").alias("b")).unionByName(down.select(F.col("ida").alias("a"), F.col("idb").alias("b"))).distinct()


def _long_lists(member: DataFrame, lists: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links across components among the members of long lists, by the exact prefix and positional filter on whole sets.

    With a set's shingles rarest first, a pair at the similarity shares one among the first n - ceil(n * similarity) + 1,
    and what either has before its first shared one can't match: a near copy with too many changes of its own drops out.
    """
    who = written(member.join(lists.select("v"), "v").select("id", "c").distinct(), "who")
    full = _sets_of(who.select(F.col("id").alias("_key")), texts, width)
    values = full.select("id", F.size("full").alias("n"), F.explode("full").alias("v"))
    held = values.join(values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), "v")
    by_set = Window.partitionBy("id", "n")
    ranked = held.withColumn("_held", F.count("*").over(by_set)).withColumn("_turn", F.row_number().over(by_set.orderBy("df", "v")))
    ranked = ranked.withColumn("at", F.col("n") - F.col("_held") + F.col("_turn") - 1)
    place = written(ranked.filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100)).join(who, "id").select("v", "id", "n", "at", "c"), "places")
    pairs = written(_within_reach(place, _open_lists(place), percent), "pairs")
    found = _confirmed(pairs, full, percent)
    dropped(who, full, place, pairs)
    return found


def find_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of docs: key, n_shingles, component_id, kept."""
    texts = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    made = over_texts(texts, _sketches(width), "_key bigint, n bigint, fp binary, sketch array<bigint>")
    rows = written(made.withColumn("_row", F.monotonically_increasing_id()), "sketches")
    named = rows.filter(F.col("_key").isNotNull() & F.col("fp").isNotNull())
    # One row stands for each class: only its number is looked for, so that sketches move only where classes are too many to broadcast.
    first = named.groupBy("fp").agg(F.min(F.struct("_key", "_row")).alias("_first"))
    first = written(first.select("fp", F.col("_first._key").alias("id"), F.col("_first._row").alias("_row")), "firsts")
    classes = joined_small(named.select("_row", "n", "sketch"), first, ["_row"], "inner", 48 * first.count(), salts=1)
    classes = written(classes.select("fp", "id", "n", "sketch"), "classes")
    whole_table, rows = rows, written(rows.select("_key", "n", "fp"), "rows")  # sketches stay with the classes only
    dropped(whole_table, first)

    # Inverted lists of the rarest retained values; one that a single class retains makes no pair but takes a place.
    # Both sides read one exchange by value: counting ids (never null) keeps its columns the same.
    values = classes.select("id", F.explode("sketch").alias("v")).filter("id is not null and v is not null").repartition("v")
    shared = values.groupBy("v").agg(F.count("id").alias("df")).filter("df > 1")
    held = values.join(shared, "v")
    exact = math.floor(K * percent / 100)
    needed = F.when(F.col("n") <= exact, F.ceil(F.col("n") * percent / 100)).otherwise(OVERLAP)
    by_class = Window.partitionBy("id")
    ranked = held.withColumn("_held", F.count("*").over(by_class)).withColumn("_turn", F.row_number().over(by_class.orderBy("df", "v")))
    ranked = ranked.join(classes.select("id", "n", F.size("sketch").alias("s")), "id")
    lists = written(ranked.filter(F.col("_turn") <= F.col("s") - needed + 1 - (F.col("s") - F.col("_held"))).select("id", "n", "v"), "lists")
    similar = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    # Each member meets its list's smallest id.
    first = lists.groupBy("v").agg(F.min(F.struct("id", "n")).alias("_first"), F.count("*").alias("_many")).filter("_many > 1")
    stars = lists.join(first, "v").select(F.col("_first.id").alias("a"), F.col("id").alias("b"), F.col("_first.n").alias("na"), F.col("n").alias("nb"))
    stars = written(stars.filter(similar & (F.col("a") != F.col("b"))).select("a", "b").distinct(), "stars")
    links = _links(stars, classes, texts, width, percent)
    joined = written(components(links), "components")

    # Then members of different components meet: in a short list directly.
    member = lists.join(joined, "id", "left").select("v", "id", "n", F.coalesce("component", "id").alias("c"))
    member = written(member, "members")
    unsettled = written(_open_lists(member), "open")
    rest = _across(member, unsettled.filter(F.col("_many") <= SHORT), similar)
    rest = written(rest.join(stars.select(F.col("a").alias("b"), F.col("b").alias("a")).unionByName(stars), ["a", "b"], "left_anti"), "rest")
    more = _links(rest, classes, texts, width, percent)
    more = more.unionByName(_long_lists(member, unsettled.filter(F.col("_many") > SHORT), texts, width, percent))
    whole = written(components(links.unionByName(more)), "components")
    label = classes.select("fp", "id").join(whole, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    dropped(lists, stars, joined, member, unsettled, rest)
    out = rows.select("_key", "n", "fp").join(label, "fp", "left")  # a hot fp is split as a skewed join
    component = F.when(F.col("_key").isNotNull(), F.coalesce("component_id", "_key"))
    return out.select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("_key"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one document of each group, all columns as they were; of rows that repeat an id one stays."""
    found = written(find_near_duplicates(docs, width, percent, text, key), "duplicates")
    gone = found.filter("not kept").select(F.col(key).alias("_gone")).distinct()
    again = found.filter(F.col("kept") & F.col(key).isNotNull()).groupBy(F.col(key).alias("_gone")).count().filter("count > 1").select("_gone")
    out = _without(docs, written(gone, "gone"), key)
    again = written(again, "again")
    if again.isEmpty():
        return out
    repeated = out.join(again, out[key] == again["_gone"], "left_semi").dropDuplicates([key])
    return _without(out, again, key).unionByName(repeated)


def _without(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """docs without these ids; the ids are broadcast only if their number allows."""
    small = 16 * ids.count() <= 32 << 20
    return docs.join(F.broadcast(ids) if small else ids, docs[key] == ids["_gone"], "left_anti")
