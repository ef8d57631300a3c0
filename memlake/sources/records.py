"""Text formats as DataFrames: JSON lines with torn rows counted, tables with a hash header, Markdown entries, line protocols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of segmented JSON lines with their file; blank lines are left out, torn ones have torn = true and null fields."""
    lines = spark.read.text(path).filter(F.trim("value") != "").withColumn("file", F.col("_metadata.file_name"))
    parsed = F.from_json("value", schema)
    return lines.select("file", F.try_parse_json("value").isNull().alias("torn"), parsed.alias("row")).select("file", "torn", "row.*")


def segments(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines in folders, one a segment: segment (the folder's name), torn, and the schema's fields (null if torn).

    Files are read by byte ranges that begin after a line's end, whatever a range holds of the line before, so a segment of any size is read by
    many tasks and each line by one. Blank lines are left out.
    """
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(folder.alias("segment"), "value").filter(F.trim("value") != "")
    return lines.select("segment", F.try_parse_json("value").isNull().alias("torn"), F.from_json("value", schema).alias("row")).select("segment", "torn", "row.*")


def torn_rows(rows: DataFrame) -> DataFrame:
    """How many lines of each file were torn."""
    return rows.groupBy("file").agg(F.count_if("torn").alias("torn"), F.count("*").alias("lines"))


def hashed_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A tab-separated file whose first line is '#sha256 ' and the digest of the rest; a wrong digest fails the read."""
    whole = spark.read.text(path, wholetext=True)
    head, body = F.substring_index("value", "\n", 1), F.expr("substr(value, length(substring_index(value, '\n', 1)) + 2)")
    ok = F.when(head == F.concat(F.lit("#sha256 "), F.sha2(body, 256)), body).otherwise(F.raise_error(F.lit("the table's digest is wrong")))
    lines = whole.select(F.explode(F.split(ok, "\n")).alias("line")).filter("line != ''")
    cells = F.split("line", "\t")
    return lines.select(*[cells[i].alias(c) for i, c in enumerate(columns)])


def with_hash_header(body: Column) -> Column:
    """The text of such a file."""
    return F.concat(F.lit("#sha256 "), F.sha2(body, 256), F.lit("\n"), body)


def anchored_entries(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Markdown cut at '<!-- entry:ID -->' anchors: key, position, entry_id, body; a trailing anchor is an empty entry."""
    parts = F.split(F.col(text), "<!-- entry:")
    rows = docs.select(key, F.posexplode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(1)))).alias("position", "part"))
    return rows.select(key, "position", F.substring_index("part", " -->", 1).alias("entry_id"), F.trim(F.expr("substr(part, length(substring_index(part, ' -->', 1)) + 5)")).alias("body"))


def frontmatter(docs: DataFrame, text: str, key: str) -> DataFrame:
    """key, name, value of each 'name: value' line between leading '---' lines, and whether the name repeats in the text."""
    block = F.regexp_extract(F.col(text), r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    lines = docs.select(key, F.explode(F.split(block, "\n")).alias("line")).filter(F.col("line").rlike(r"^[A-Za-z_][A-Za-z0-9_-]*:"))
    pairs = lines.select(key, F.substring_index("line", ":", 1).alias("name"), F.trim(F.expr("substr(line, length(substring_index(line, ':', 1)) + 2)")).alias("value"))
    return pairs.withColumn("repeated", F.count("*").over(Window.partitionBy(key, "name")) > 1)


def scored_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """'[score] name -- snippet (stale)' lines as score, name, snippet, stale; other lines are left out."""
    pattern = r"^\[([0-9.]+)\] (\S+) -- (.*?)( \(stale\))?$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    hit = lines.filter(F.col(text).rlike(pattern))
    return hit.select(part(1).cast("double").alias("score"), part(2).alias("name"), part(3).alias("snippet"), (part(4) != "").alias("stale"))


def joined_calls(lines: DataFrame, pid: str, order: str, text: str) -> DataFrame:
    """System call lines with '<unfinished ...>' and 'resumed>' halves put together by process, in order."""
    w = Window.partitionBy(pid).orderBy(order)
    open_half = F.col(text).endswith("<unfinished ...>")
    before = F.last(F.when(open_half, F.regexp_replace(text, r"\s*<unfinished \.\.\.>$", "")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    resumed = F.regexp_extract(text, r"^<\.\.\. (\w+) resumed>(.*)$", 2)
    whole = F.when(F.col(text).rlike(r"^<\.\.\. \w+ resumed>"), F.concat(before, resumed)).when(~open_half, F.col(text))
    return lines.withColumn("call", whole).filter("call is not null")
