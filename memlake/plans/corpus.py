"""Queries over conversations and documents: selection, spans, transcripts, text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.operators import joins as J
from memlake.operators import windows as W
from memlake.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

RENDERED = "concat('### ', upper(substr(role, 1, 1)), substr(role, 2), chr(10), text)"
MESSAGES = "SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE trim(coalesce(text, '')) <> ''"


def _messages(t):
    rows = t.conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    return rows.filter(F.trim("text") != "")


def _transcripts(t):
    """One transcript for each conversation: a block for each message in order of turns, equal turns by role and text."""
    block = F.concat(F.lit("### "), F.upper(F.substring("role", 1, 1)), F.expr("substr(role, 2)"), F.lit("\n"), F.col("text"))
    rows = _messages(t).select("conv_id", "turn", F.struct("turn", "role", block.alias("block")).alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list("m")), lambda m: m["block"])
    return rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.max("turn").alias("last_turn"), F.array_join(ordered, "\n\n").alias("transcript"))


_TRANSCRIPTS = f"SELECT conv_id, count(*) AS n_turns, max(turn) AS last_turn, string_agg({RENDERED}, chr(10) || chr(10) ORDER BY turn, role, text) AS transcript FROM ({MESSAGES}) GROUP BY conv_id"


@R.query(
    f"""WITH t AS ({_TRANSCRIPTS}), r AS (SELECT *, {T.redact_sql("transcript")} AS red FROM t)
SELECT conv_id, n_turns, last_turn, CAST(length(red) AS BIGINT) AS transcript_chars, red <> transcript AS redacted, sha256(red) AS digest
FROM r WHERE n_turns >= 2 AND length(red) >= 200"""
)
def conversation_export(t):
    rows = _transcripts(t).filter("n_turns >= 2").withColumn("red", T.redact(F.col("transcript")))
    return rows.filter(F.length("red") >= 200).select("conv_id", "n_turns", "last_turn", F.length("red").cast("long").alias("transcript_chars"), (F.col("red") != F.col("transcript")).alias("redacted"), F.sha2("red", 256).alias("digest"))


@R.query(f"SELECT conv_id, CAST(length(transcript) AS BIGINT) AS n_chars, sha256(transcript) AS digest FROM ({_TRANSCRIPTS})")
def transcript_render(t):
    return _transcripts(t).select("conv_id", F.length("transcript").cast("long").alias("n_chars"), F.sha2("transcript", 256).alias("digest"))


@R.query("SELECT conv_id, count(*) AS n_turns, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY conv_id HAVING count(*) BETWEEN 3 AND 12")
def conversation_select_floor(t):
    agg = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))
    return agg.filter(F.col("n_turns").between(3, 12))


@R.query(
    """SELECT o_orderkey, o_custkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3"""
)
def message_flat_view(t):
    places = t.nation.join(F.broadcast(t.region.filter("r_regionkey < 3")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    flat = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return flat.select("o_orderkey", "o_custkey", "c_name", "n_name", "r_name")


@R.query(
    """SELECT o_orderkey, epoch_ms(o_orderdate) AS ts FROM orders WHERE epoch_ms(o_orderdate) > 800000000000
OR (epoch_ms(o_orderdate) = 800000000000 AND o_orderkey > 50) ORDER BY ts, o_orderkey LIMIT 100"""
)
def keyset_page(t):
    rows = t.orders.select("o_orderkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts"))
    after = (F.col("ts") > 800000000000) | ((F.col("ts") == 800000000000) & (F.col("o_orderkey") > 50))
    return rows.filter(after).orderBy("ts", "o_orderkey").limit(100)


@R.query("SELECT epoch_ms(o_orderdate) AS ts, o_orderkey FROM orders ORDER BY ts DESC, o_orderkey DESC LIMIT 1")
def max_composite_cursor(t):
    key = F.struct(F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts"), "o_orderkey")
    return t.orders.agg(F.max(key).alias("c")).select("c.ts", "c.o_orderkey")


@R.query(
    """WITH page AS (SELECT conv_id, conv_id * 1000 + turn AS id FROM conversations WHERE conv_id * 1000 + turn > 5000 ORDER BY id LIMIT 300)
SELECT conv_id, min(id) AS span_start, max(id) AS span_end, count(*) AS n FROM page GROUP BY conv_id"""
)
def cursor_span_build(t):
    page = t.conversations.select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("id")).filter("id > 5000").orderBy("id").limit(300)
    return page.groupBy("conv_id").agg(F.min("id").alias("span_start"), F.max("id").alias("span_end"), F.count("*").alias("n"))


@R.query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 42")
def point_lookup_unique_guard(t):
    return J.unique_or_fail(t.customer.filter("c_custkey = 42"), "c_custkey").select("c_custkey", "c_name", "c_mktsegment")


@R.query("SELECT DISTINCT source, lang FROM documents")
def distinct_sources(t):
    return t.documents.select("source", "lang").distinct()


@R.query(
    """SELECT source, CASE WHEN source = 'src0' THEN 'self' WHEN source LIKE 'src1%' THEN 'known' ELSE 'quarantine' END AS class, count(*) AS n FROM documents GROUP BY ALL"""
)
def source_classification(t):
    kind = F.when(F.col("source") == "src0", "self").when(F.col("source").startswith("src1"), "known").otherwise("quarantine")
    return t.documents.groupBy("source", kind.alias("class")).agg(F.count("*").alias("n"))


@R.query(
    """SELECT role, count(*) FILTER (WHERE noise) AS dropped, count(*) FILTER (WHERE NOT noise) AS kept FROM
(SELECT role, length(regexp_replace(trim(coalesce(text, '')), '[^a-zA-Z]', '', 'g')) < 20 OR lower(trim(coalesce(text, ''))) IN ('ok', 'yes', 'no', 'thanks') AS noise FROM conversations) GROUP BY role"""
)
def noise_filter_counts(t):
    body = F.trim(F.coalesce("text", F.lit("")))
    noise = (F.length(F.regexp_replace(body, "[^a-zA-Z]", "")) < 20) | F.lower(body).isin("ok", "yes", "no", "thanks")
    rows = t.conversations.select("role", noise.alias("noise"))
    return rows.groupBy("role").agg(F.count_if("noise").alias("dropped"), F.count_if(~F.col("noise")).alias("kept"))


@R.query(
    """WITH calls AS (SELECT conv_id, turn, min(text) AS call FROM conversations WHERE role = 'user' GROUP BY ALL)
SELECT r.conv_id, r.turn, c.turn IS NULL AS unpaired, count(*) AS n FROM conversations r LEFT JOIN calls c ON r.conv_id = c.conv_id AND c.turn = r.turn - 1
WHERE r.role = 'assistant' GROUP BY ALL"""
)
def tool_pairing_unpaired(t):
    calls = t.conversations.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn")).distinct().withColumn("call", F.lit(True))
    answers = t.conversations.filter("role = 'assistant'").select("conv_id", "turn").join(calls, ["conv_id", "turn"], "left")
    return answers.groupBy("conv_id", "turn", F.col("call").isNull().alias("unpaired")).agg(F.count("*").alias("n"))


@R.query(
    """SELECT conv_id, turn, draw FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS draw FROM conversations WHERE role = 'user') WHERE draw <= 2"""
)
def first_k_user_messages(t):
    return W.top_per_key(t.conversations.filter("role = 'user'"), ["conv_id"], [F.col("turn"), F.col("text")], 2, "draw").select("conv_id", "turn", F.col("draw").cast("long").alias("draw"))


@R.query(
    """SELECT conv_id, batch, count(*) AS n, min(turn) AS lo, max(turn) AS hi FROM (SELECT conv_id, turn, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) / 3) AS BIGINT) AS batch FROM conversations) GROUP BY ALL"""
)
def fixed_batches(t):
    rows = W.batches(t.conversations, ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], 3)
    return rows.groupBy("conv_id", "batch").agg(F.count("*").alias("n"), F.min("turn").alias("lo"), F.max("turn").alias("hi"))


@R.query(
    """SELECT conv_id, count(*) FILTER (WHERE turn > last) AS held, count(*) FILTER (WHERE turn <= last) AS passed FROM
(SELECT conv_id, turn, coalesce(max(CASE WHEN role <> 'assistant' THEN turn END) OVER (PARTITION BY conv_id), -1) AS last FROM conversations) GROUP BY conv_id"""
)
def trailing_run_split(t):
    rows = W.split_trailing(t.conversations, ["conv_id"], "turn", F.col("role") == "assistant")
    return rows.groupBy("conv_id").agg(F.count_if("held_back").alias("held"), F.count_if(~F.col("held_back")).alias("passed"))


@R.query(
    """WITH mid AS (SELECT conv_id, CAST(floor(max(turn) / 2) AS BIGINT) AS target FROM conversations GROUP BY conv_id)
SELECT c.conv_id, c.turn, c.turn = m.target AS is_target FROM conversations c JOIN mid m ON c.conv_id = m.conv_id WHERE c.turn BETWEEN m.target - 1 AND m.target + 1"""
)
def context_window(t):
    mid = t.conversations.groupBy("conv_id").agg(F.floor(F.max("turn") / 2).cast("long").alias("target"))
    near = t.conversations.join(mid, "conv_id").filter(F.col("turn").between(F.col("target") - 1, F.col("target") + 1))
    return near.select("conv_id", "turn", (F.col("turn") == F.col("target")).alias("is_target"))


@R.query(
    """WITH spans AS (SELECT conv_id, min(turn) + 1 AS lo, max(turn) - 1 AS hi FROM conversations GROUP BY conv_id)
SELECT m.conv_id, m.turn, m.role FROM conversations m JOIN spans s ON m.conv_id = s.conv_id AND m.turn BETWEEN s.lo AND s.hi"""
)
def span_range_join(t):
    spans = t.conversations.groupBy("conv_id").agg((F.min("turn") + 1).alias("lo"), (F.max("turn") - 1).alias("hi"))
    return t.conversations.join(spans, "conv_id").filter("turn between lo and hi").select("conv_id", "turn", "role")


def _budget_start() -> Column:
    return F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<turn:bigint,admitted:boolean>>").alias("out"))


def _budget_step(budget: int):
    def step(state: Column, row: Column) -> Column:
        size = F.length(row["text"]).cast("long")
        fits = (state["used"] == 0) | (state["used"] + size <= budget)
        return F.struct((state["used"] + F.when(fits, size).otherwise(0)).alias("used"), F.concat(state["out"], F.array(F.struct(row["turn"].alias("turn"), fits.alias("admitted")))).alias("out"))

    return step


@R.query(
    f"""WITH RECURSIVE m AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM ({MESSAGES})),
f AS (SELECT conv_id, turn, i, size AS used, true AS admitted FROM m WHERE i = 1 UNION ALL
SELECT m.conv_id, m.turn, m.i, f.used + CASE WHEN f.used + m.size <= 1500 THEN m.size ELSE 0 END, f.used + m.size <= 1500 FROM f JOIN m ON m.conv_id = f.conv_id AND m.i = f.i + 1)
SELECT conv_id, turn, admitted FROM f"""
)
def token_budget_admission(t):
    rows = W.folded_rows(_messages(t).select("conv_id", "turn", "role", "text"), ["conv_id"], "turn", _budget_start(), _budget_step(1500))
    return rows.select("conv_id", F.explode("_state.out").alias("r")).select("conv_id", "r.turn", "r.admitted")


def _chunk_step(budget: int):
    def step(state: Column, row: Column) -> Column:
        size = F.length(row["text"]).cast("long")
        new = (state["used"] > 0) & (state["used"] + size > budget)
        chunk = state["chunk"] + new.cast("long")
        return F.struct(F.when(new, size).otherwise(state["used"] + size).alias("used"), chunk.alias("chunk"), F.concat(state["out"], F.array(F.struct(row["turn"].alias("turn"), chunk.alias("chunk")))).alias("out"))

    return step


@R.query(
    f"""WITH RECURSIVE m AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM ({MESSAGES})),
f AS (SELECT conv_id, turn, i, size AS used, 0 AS chunk FROM m WHERE i = 1 UNION ALL
SELECT m.conv_id, m.turn, m.i, CASE WHEN f.used > 0 AND f.used + m.size > 1000 THEN m.size ELSE f.used + m.size END, f.chunk + CASE WHEN f.used > 0 AND f.used + m.size > 1000 THEN 1 ELSE 0 END FROM f JOIN m ON m.conv_id = f.conv_id AND m.i = f.i + 1)
SELECT conv_id, turn, CAST(chunk AS BIGINT) AS chunk FROM f"""
)
def chunk_by_budget(t):
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("chunk"), F.array().cast("array<struct<turn:bigint,chunk:bigint>>").alias("out"))
    rows = W.folded_rows(_messages(t).select("conv_id", "turn", "role", "text"), ["conv_id"], "turn", start, _chunk_step(1000))
    return rows.select("conv_id", F.explode("_state.out").alias("r")).select("conv_id", "r.turn", "r.chunk")


@R.query("SELECT doc_id, length(regexp_replace(trim(text), '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) AS n_chars, sha256(trim(regexp_replace(text, '[ \\t\\n\\v\\f\\r]+', ' ', 'g'))) AS digest FROM documents WHERE text IS NOT NULL")
def normalize_ws(t):
    clean = T.normal_space(F.col("text"))
    return t.documents.filter("text is not null").select("doc_id", F.length(F.regexp_replace(F.trim("text"), r"\s+", " ")).cast("long").alias("n_chars"), F.sha2(clean, 256).alias("digest"))


@R.query("SELECT doc_id, sha256(source || '|' || lang || '|fact|' || sha256(trim(regexp_replace(text, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')))) AS key FROM documents WHERE text IS NOT NULL")
def fact_key(t):
    return t.documents.filter("text is not null").select("doc_id", T.fact_key(F.col("source"), F.col("lang"), F.lit("fact"), F.col("text")).alias("key"))


@R.query("SELECT item_id, coalesce(nullif(regexp_replace(regexp_replace(lower(substr(text, 1, 60)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'x') AS slug FROM benchmark")
def slug(t):
    return t.benchmark.select("item_id", T.slug(F.expr("substr(text, 1, 60)")).alias("slug"))


@R.query(f"SELECT doc_id, red <> text AS changed, sha256(red) AS digest FROM (SELECT doc_id, text, {T.redact_sql('text')} AS red FROM documents WHERE text IS NOT NULL)")
def redact_secrets(t):
    rows = t.documents.filter("text is not null").select("doc_id", "text", T.redact(F.col("text")).alias("red"))
    return rows.select("doc_id", (F.col("red") != F.col("text")).alias("changed"), F.sha2("red", 256).alias("digest"))


@R.query(
    """SELECT item_id, CASE WHEN regexp_matches(text, '[\\n\\r]') THEN 'line_break' WHEN trim(text) = '' THEN 'empty' WHEN length(trim(text)) > 150 THEN 'too_long' WHEN item_id % 7 NOT BETWEEN 1 AND 5 THEN 'limit' END AS error FROM benchmark"""
)
def query_contract_gate(t):
    return t.benchmark.select("item_id", T.contract_error(F.col("text"), F.col("item_id") % 7).alias("error"))


@R.query(
    """WITH RECURSIVE s AS (SELECT doc_id, length(coalesce(split_part(text, chr(10), 1), '')) AS a, length(coalesce(split_part(text, chr(10), 2), '')) AS b, length(coalesce(split_part(text, chr(10), 3), '')) AS c FROM documents),
g AS (SELECT doc_id, a, b, c, unnest(range(0, 301)) AS level FROM s),
l AS (SELECT doc_id, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, max(level) AS level FROM g WHERE least(a, level) + least(b, level) + least(c, level) <= 300 GROUP BY doc_id),
x AS (SELECT *, 300 - least(a, level) - least(b, level) - least(c, level) AS spare, a + b + c <= 300 AS fits FROM l)
SELECT doc_id, CASE WHEN fits THEN a ELSE least(a, level + CASE WHEN a > level AND (CASE WHEN b > level THEN 1 ELSE 0 END) + (CASE WHEN c > level THEN 1 ELSE 0 END) < spare THEN 1 ELSE 0 END) END AS a,
CASE WHEN fits THEN b ELSE least(b, level + CASE WHEN b > level AND (CASE WHEN c > level THEN 1 ELSE 0 END) < spare THEN 1 ELSE 0 END) END AS b,
CASE WHEN fits THEN c ELSE least(c, level + CASE WHEN c > level AND 0 < spare THEN 1 ELSE 0 END) END AS c FROM x"""
)
def payload_clamp(t):
    parts = {name: F.split_part("text", F.lit("\n"), F.lit(i)) for i, name in enumerate("abc", 1)}
    return T.cut_longest(t.documents.select("doc_id", "text"), parts, 300).select("doc_id", *parts)


@R.query(
    """SELECT doc_id, count(*) AS n_lines, count(DISTINCT line) AS n_distinct FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY doc_id"""
)
def document_entries(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.trim("line") != "")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.countDistinct("line").alias("n_distinct"))


@R.query(
    """SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS BIGINT) AS n_links FROM pages WHERE html IS NOT NULL"""
)
def frontmatter_parse(t):
    pages = t.pages.filter("html is not null")
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(links).cast("long").alias("n_links"))


@R.query(
    """SELECT root, count(*) AS n FROM (SELECT CASE WHEN url LIKE 'https://blog.%' THEN 'https://blog.' WHEN url LIKE 'https://www.%' THEN 'https://www.' WHEN url LIKE 'https://%' THEN 'https://' WHEN url LIKE 'http://%' THEN 'http://' END AS root FROM pages) GROUP BY root"""
)
def prefix_root_join(t):
    root = J.under_any_root(t.pages, "url", ["https://", "http://", "https://blog.", "https://www."])
    return t.pages.groupBy(root.alias("root")).agg(F.count("*").alias("n"))


@R.query(
    """SELECT source, place, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY over_cap, n_chars DESC, doc_id) AS place FROM
(SELECT doc_id, lang, source, n_chars, CASE WHEN row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) > 3 THEN 1 ELSE 0 END AS over_cap FROM documents)) WHERE place <= 20"""
)
def diversify_by_group(t):
    rows = W.diversify(t.documents.select("doc_id", "lang", "source", "n_chars"), ["lang"], "source", [F.desc("n_chars"), F.col("doc_id")], 3, 20)
    return rows.select("source", F.col("place").cast("long").alias("place"), "doc_id")


@R.query(
    """SELECT source, lang, doc_id, draw FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS draw FROM documents) WHERE draw <= 3"""
)
def hash_sample_per_stratum(t):
    rows = W.hash_sample(t.documents.select("source", "lang", "doc_id"), ["source", "lang"], F.col("doc_id"), 3)
    return rows.select("source", "lang", "doc_id", F.col("draw").cast("long").alias("draw"))


@R.query("SELECT doc_id FROM documents ORDER BY sha256(CAST(doc_id AS VARCHAR)) LIMIT 60")
def hash_sample_global(t):
    return t.documents.select("doc_id").orderBy(F.sha2(F.col("doc_id").cast("string"), 256)).limit(60)


@R.query(
    """WITH c AS (SELECT conv_id, count(*) AS n, CAST(conv_id % 10 AS BIGINT) AS workspace FROM conversations GROUP BY conv_id)
SELECT a.conv_id, b.conv_id AS related, place FROM (SELECT a.conv_id, b.conv_id AS rel, row_number() OVER (PARTITION BY a.conv_id ORDER BY b.n DESC, b.conv_id DESC) AS place
FROM c a JOIN c b ON a.workspace = b.workspace AND a.conv_id <> b.conv_id WHERE a.conv_id < 50) q JOIN c a ON a.conv_id = q.conv_id JOIN c b ON b.conv_id = q.rel WHERE place <= 3"""
)
def related_sessions(t):
    return _related(t, F.col("conv_id") < 50)


@R.query(
    """WITH c AS (SELECT conv_id, count(*) AS n, CAST(conv_id % 10 AS BIGINT) AS workspace FROM conversations GROUP BY conv_id)
SELECT conv_id, rel AS related, place FROM (SELECT a.conv_id, b.conv_id AS rel, row_number() OVER (PARTITION BY a.conv_id ORDER BY b.n DESC, b.conv_id DESC) AS place
FROM c a JOIN c b ON a.workspace = b.workspace AND a.conv_id <> b.conv_id) WHERE place <= 3"""
)
def related_sessions_all(t):
    """The same for every conversation."""
    return _related(t, F.lit(True))


def _related(t, asked):
    c = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("workspace", F.col("conv_id") % 10)
    # Each workspace's best four hold any member's best three others: the join meets four rows, not a whole workspace.
    best = W.top_per_key(c, ["workspace"], [F.desc("n"), F.desc("conv_id")], 4, "r").select("workspace", F.col("conv_id").alias("related"), F.col("n").alias("rn"))
    pairs = c.filter(asked).select("conv_id", "workspace").join(F.broadcast(best), "workspace").filter("conv_id <> related")
    return W.top_per_key(pairs, ["conv_id"], [F.desc("rn"), F.desc("related")], 3, "place").select("conv_id", "related", F.col("place").cast("long").alias("place"))


@R.query("SELECT conv_id, max(turn) AS modified, count(*) AS n FROM conversations GROUP BY conv_id ORDER BY modified DESC, conv_id LIMIT 20")
def recent_sessions(t):
    rows = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("modified"), F.count("*").alias("n"))
    return rows.orderBy(F.desc("modified"), "conv_id").limit(20)


@R.query(
    """SELECT source, regexp_replace(substr(body, 1, 400), '\\n[^\\n]*$', '') AS digest FROM (SELECT source, string_agg('- ' || substr(replace(text, chr(10), ' '), 1, 40), chr(10) ORDER BY n_chars DESC, doc_id) AS body
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE n_chars >= 500 AND text IS NOT NULL) WHERE r <= 12) GROUP BY source)"""
)
def digest_build(t):
    top = W.top_per_key(t.documents.filter("n_chars >= 500 and text is not null"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 12, "r")
    line = F.concat(F.lit("- "), F.substring(F.regexp_replace("text", "\n", " "), 1, 40))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("line")))), lambda x: x["line"]), "\n")
    return top.groupBy("source").agg(body.alias("body")).select("source", F.regexp_replace(F.substring("body", 1, 400), "\n[^\n]*$", "").alias("digest"))
