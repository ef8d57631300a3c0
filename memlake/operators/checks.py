"""Checks and classifications as columns and small plans: payloads, paths, commands, calls, listings, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Errors with which a failed write left no trace.
HARMLESS = ("EACCES", "ENOENT", "EPERM", "EROFS", "EEXIST")


def chosen(df: DataFrame, wanted: dict[str, str | list[str]]) -> DataFrame:
    """Rows that meet each predicate whose value isn't empty: a text is equal, a list holds."""
    for column, value in wanted.items():
        if value:
            df = df.filter(F.col(column).isin(value) if isinstance(value, list) else F.col(column) == value)
    return df


def readiness(rows: DataFrame, json: str) -> DataFrame:
    """rows with semantic, lexical from a status: each field there, of its type and right; never an error."""
    v = F.try_parse_json(json)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    true = lambda path: (kind(path) == "BOOLEAN") & F.try_variant_get(v, path, "boolean")
    text = lambda path: F.try_variant_get(v, path, "string")
    quiet = F.coalesce(kind("$.vectors.error") == "VOID", F.lit(True))
    semantic = quiet & true("$.vectors.active") & text("$.vectors.embedder").endswith("bge")
    lexical = true("$.index.exists") & (F.coalesce(text("$.index.status"), F.lit("")) != "error")
    return rows.withColumns({"semantic": F.coalesce(semantic, F.lit(False)), "lexical": F.coalesce(lexical, F.lit(False))})


def accepted_payloads(rows: DataFrame, request: str, key: str, item: str, score: str, needed: tuple[str, ...], known: tuple[str, ...]) -> DataFrame:
    """For each request its candidates, the good ones, and whether all are good."""
    v = F.try_parse_json(item)
    kind = lambda f: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")), F.lit("VOID"))
    formed = reduce(Column.__and__, [kind(f) == "STRING" for f in needed] + [kind(f).isin("STRING", "VOID") for f in known])
    finite = F.col(score).isNull() | ~(F.isnan(score) | (F.abs(F.col(score)) == float("inf")))
    once = F.count("*").over(Window.partitionBy(request, key)) == 1
    good = rows.select(request, ((F.col(key) != "") & once & finite & formed).alias("_good"))
    return good.groupBy(request).agg(F.count("*").alias("n"), F.count_if("_good").alias("good"), F.bool_and("_good").alias("accepted"))


def safe_path(path: Column, reserved: tuple[str, ...]) -> Column:
    """Relative, without empty steps or steps up, and not of a reserved name."""
    steps = F.split(path, "/")
    odd = F.exists(steps, lambda s: s.isin("", ".", ".."))
    return (path != "") & ~path.startswith("/") & ~odd & ~F.element_at(steps, -1).isin(*reserved)


def moved(path: Column, prefix: str, to: str) -> Column:
    """The path under another prefix; null if it isn't under the first or leads out of it."""
    return F.when(path.startswith(prefix) & ~F.contains(path, F.lit("..")), F.concat(F.lit(to), F.substring(path, F.lit(len(prefix) + 1), F.length(path))))


def identity(head: Column, expected: dict[str, Column]) -> Column:
    """same, foreign, or invalid where a key of the frontmatter stands twice."""
    keys = F.regexp_extract_all(head, F.lit("(?m)^([a-z_]+): "), F.lit(1))
    same = reduce(Column.__and__, [F.regexp_extract(head, rf"(?m)^{k}: (.*)$", 1) == v for k, v in expected.items()])
    return F.when(F.size(keys) != F.size(F.array_distinct(keys)), "invalid").when(same, "same").otherwise("foreign")


def command(line: Column) -> Column:
    """The first word of a shell line past `cd x &&`, wrappers with their options and assignments; null if none is left."""
    skipped = r"^(?:cd(?: [^& ][^ ]*)*(?: && ?|$)|(?:sudo|env|nohup|time|nice)(?: (?:-[^ ]*|[^ ]*=[^ ]*))*(?: |$)|[^- ][^ ]*=[^ ]*(?: |$))*"
    return F.nullif(F.split_part(F.regexp_replace(line, skipped, ""), F.lit(" "), F.lit(1)), F.lit(""))


def call_verdicts(calls: DataFrame, roots: list[str], start: str) -> DataFrame:
    """calls (event_id, pid, syscall, path, flags, rc) with a verdict; null for calls without a path.

    A relative path stands under the folder that its process last changed to; the folder is the last seen value before the
    row, one window for each process.
    """
    c = F.col
    before = Window.partitionBy("pid").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    went = F.last(F.when((c("syscall") == "chdir") & (c("rc") == "0") & c("path").startswith("/"), c("path")), ignorenulls=True).over(before)
    full = F.when(c("path").startswith("/"), c("path")).otherwise(F.concat_ws("/", F.coalesce(went, F.lit(start)), "path"))
    inside = reduce(Column.__or__, [(c("_full") == r) | c("_full").startswith(f"{r}/") for r in roots])
    harmless = c("rc").startswith("-1") & F.split_part("rc", F.lit(" "), F.lit(2)).isin(*HARMLESS)
    bad = F.when(harmless, "FAILED_WRITE_ATTEMPT").otherwise("VIOLATION")
    kind = lambda *names: c("syscall").isin(*names)
    verdict = (
        F.when(kind("getcwd"), None)
        .when(kind("openat") & (c("path") == "/dev/null"), "ALLOW_DEVICE_NODE")
        .when(inside, "ALLOW_IN_ROOT")
        .when(kind("chdir"), "CWD_NAVIGATION_OUTSIDE")
        .when(kind("stat") | (kind("openat") & (c("flags") == "O_RDONLY")), "ALLOW_READONLY_OUTSIDE")
        .when(kind("openat", "unlink", "rename"), bad)
        .otherwise("UNCLASSIFIED")
    )
    return calls.withColumn("_full", full).withColumn("verdict", verdict).drop("_full")


def log_outcome(produced: Column, log: Column) -> Column:
    structural = log.rlike(r"skipping item \(n=[0-9]+\)|only [0-9]+ rounds < min [0-9]+")
    semantic = log.rlike("filtered out by model: ?|empty (intent|approach), skipping")
    return F.when(produced, "passed").when(structural, "structural").when(semantic, "semantic").otherwise("other")


def itemized(lines: DataFrame, line: str) -> DataFrame:
    """kind (sent, other, blank, unknown) and path of a transfer's lines; any unknown line should fail the transfer."""
    x, sent = F.col(line), F.col(line).startswith(">f")
    known = x.startswith("cd") | x.startswith(".d") | x.startswith(".f")
    kind = F.when(x == "", "blank").when(sent & F.contains(x, F.lit(" ")), "sent").when(known, "other").otherwise("unknown")
    return lines.select(kind.alias("kind"), F.when(sent, F.substring(x, F.locate(" ", x) + 1, F.length(x))).alias("path"))


def blocks(files: DataFrame, text: str) -> DataFrame:
    """session, entry: the blocks between matching open and close marks, by the session named inside."""
    whole = r"(?s)<!--\s*entry:([^\s/>]+)\s*-->(?:(?!<!--\s*/?entry:).)*<!--\s*/entry:\1\s*-->"
    each = files.select(F.explode(F.regexp_extract_all(text, F.lit(whole), F.lit(0))).alias("b"))
    names = F.regexp_extract_all("b", F.lit(r"(?m)^\*\*session_id\*\*:\s*(\S+)\s*$"), F.lit(1))
    return each.select(F.explode(F.array_distinct(names)).alias("session"), F.regexp_extract("b", r"entry:([^\s/>]+)", 1).alias("entry"))


def two_way(listed: DataFrame, found: DataFrame, key: str, digest: str) -> DataFrame:
    """key, problem: listed and missing, there and unlisted, or changed."""
    a, b = listed.select(key, F.col(digest).alias("_a")), found.select(key, F.col(digest).alias("_b"))
    problem = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unlisted").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full_outer").select(key, problem.alias("problem")).filter("problem is not null")


def census_verdict(prev: Column, cur: Column) -> Column:
    """Counts kept as text beside marks: marks never compare, and a mark or a negative number as the baseline poisons it."""
    number = lambda c: F.when(c.rlike(r"^-?[0-9]{1,18}\z"), c.cast("bigint"))
    before, now = number(prev), number(cur)
    return F.when(prev == "EXEMPT", "exempt").when(before.isNull() | (before < 0), "poisoned").when(cur.isNull(), "disappeared").when(now.isNull(), "unreadable").when(now < before, "shrunk").otherwise("ok")


def publishable(manifests: DataFrame, pool: DataFrame) -> DataFrame:
    """Manifests (h, path, said, size) with a verdict; the path is only looked at, a blob is found by its hash."""
    c = F.col
    rows = manifests.join(pool.select("h", F.lit(True).alias("_there")), "h", "left")
    verdict = (
        F.when(~c("path").rlike(r"^blobs/sha256/[0-9a-f]{2}/[0-9a-f]{64}\.raw\z"), "shape")
        .when(F.substring("path", 17, 64) != c("h"), "name")
        .when(F.substring("path", 14, 2) != F.substring("h", 1, 2), "folder")
        .when(c("_there").isNull(), "missing")
        .when(c("said") != c("size"), "size")
        .otherwise("ok")
    )
    return rows.withColumn("verdict", verdict).drop("_there")
