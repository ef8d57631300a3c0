"""Messages of a session: role mapping, merging of orphans, tool rounds, preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.operators import folds
from memlake.operators.integrity import cut


def merged_orphans(rows: DataFrame, keys: list[str], order: str, orphan: Column, text: str, most: int) -> DataFrame:
    """keys, at, body, merged: orphan rows joined to the row before while the whole stays within `most` characters, else rows of their own.

    Rows of equal order go by text, then by whether they are orphans. A key of any length: see folds.greedy_groups.
    """
    lean = rows.select(*keys, F.col(order).alias("place"), F.coalesce(F.col(text), F.lit("")).alias("body"), orphan.alias("orphan"))
    size = F.length("body")
    grouped = folds.greedy_groups(lean, keys, ["place", "body", "orphan"], size, size + 1, ~F.col("orphan"), F.lit(False), most)
    lines = F.array_sort(F.collect_list(F.struct("_at", "place", "body")))  # within `most` characters, or one row
    return grouped.groupBy(*keys, "group").agg(lines.alias("l")).select(*keys, F.col("l")[0]["place"].alias("at"), F.array_join(F.transform("l", lambda x: x["body"]), "\n").alias("body"), (F.size("l") - 1).cast("long").alias("merged"))


def role_shape(role: Column, text: Column) -> Column:
    """One of three message shapes: what a person says, what the assistant says, and all else with its role in front."""
    return F.when(role == "user", F.struct(F.lit("user").alias("role"), text.alias("content"))).when(role == "assistant", F.struct(F.lit("assistant").alias("role"), text.alias("content"))).otherwise(
        F.struct(F.lit("assistant").alias("role"), F.concat(F.lit("["), role, F.lit("] "), text).alias("content"))
    )


def round_bucket(n: Column) -> Column:
    return F.when(n < 3, "<3").when(n <= 5, "3-5").otherwise("6+")


#: Roles whose texts are clamped, and to how many characters.
CAPS = {"tool_call": 1200, "tool_result": 2500, "reasoning": 1000, "tool": 2500, "toolResult": 2500}


ORPHANS = ("[tool_result]", "[reasoning]", "[tool_call]")


def _starts(text: Column, prefixes) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | text.startswith(p)
    return found


def calls_tool() -> Column:
    return (F.col("role") == "assistant") & F.col("call_id").isNotNull()


def orphan_text() -> Column:
    """An assistant's row that is only the text of a tool or a thought."""
    return (F.col("role") == "assistant") & ~calls_tool() & _starts(F.col("content"), ORPHANS)


def needs_cap() -> Column:
    return (F.col("role") == "tool") | ((F.col("role") == "assistant") & ~calls_tool() & _starts(F.col("content"), ("[tool_result]", "[tool_call]")))


def shaped(rows: DataFrame, tool: Column) -> DataFrame:
    """Rows (conv_id, turn, role, call_id, content) as messages of three shapes: a person's, the assistant's, a tool's.

    Calls and results without an id can't be paired and become an assistant's text with their role in front, as thoughts
    do; other roles go.
    """
    role, call, content = F.col("role"), F.coalesce("call_id", F.lit("")), F.coalesce("content", F.lit(""))
    paired = role.isin("tool_call", "tool_result") & (call != "")
    said = F.when(role == "reasoning", F.concat(F.lit("[reasoning] "), content)).when(role.isin("user", "assistant"), content).when(~paired, F.concat(F.lit("["), role, F.lit("] "), content))
    said = said.when((role == "tool_call") & (content == ""), F.concat(F.lit("[Tool: "), tool, F.lit("]"))).otherwise(content)
    shape = F.when(role == "user", "user").when((role == "tool_result") & paired, "tool").otherwise("assistant")
    return rows.filter(role.isin("user", "assistant", "tool_call", "tool_result", "reasoning")).select("conv_id", "turn", shape.alias("role"), said.alias("content"), F.when(paired, F.col("call_id")).alias("call_id"))


def prepared(rows: DataFrame, most: int) -> DataFrame:
    """Shaped messages with their `ts` made ready: conv_id, place, role, content, held, unique_ts.

    Orphan texts join the orphan or the assistant's own text before them while both fit in `most` characters; orphans at the
    end are held back; the others' times strictly increase. A session of any length: groups are filled block by block, and
    what looks back over a session looks at the sums of blocks.
    """
    size, open_ = F.length("content"), (F.col("role") == "assistant") & ~F.col("calls")
    lean = rows.select("conv_id", "turn", "role", "content", orphan_text().alias("orphan"), calls_tool().alias("calls"), "ts")
    grouped = folds.greedy_groups(lean, ["conv_id"], ["turn", "role", "content", "orphan", "calls", "ts"], size, size + 1, ~F.col("orphan"), ~open_, most, "place")
    lines = F.array_sort(F.collect_list(F.struct("_at", "role", "content", "orphan", "ts")))  # within `most` characters, or one row
    flat = grouped.groupBy("conv_id", "place").agg(lines.alias("l")).select("conv_id", "place", F.col("l")[0]["role"].alias("role"), F.array_join(F.transform("l", lambda x: x["content"]), "\n").alias("content"), F.col("l")[0]["orphan"].alias("orphan"), F.col("l")[0]["ts"].alias("ts"))
    flat = cut(flat)  # read by the sums of blocks and again beside them
    ended = folds.with_last(flat, ["conv_id"], "place", F.when(~F.col("orphan"), F.col("place")), "_last")
    timed = folds.with_running_max(ended, ["conv_id"], "place", F.when(F.col("ts") > 0, F.col("ts") - F.col("place") - 1), "_lead")
    held = F.col("place") > F.coalesce("_last", F.lit(-1))
    unique = F.col("place") + 1 + F.greatest(F.lit(0), F.coalesce("_lead", F.lit(0)))
    return timed.select("conv_id", "place", "role", "content", held.alias("held"), F.when(~held, unique).alias("unique_ts"))
