"""Queries that classify lines, names, paths and statuses made of the tables' own urls, texts, props and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions import rules as T
from memlake.operators import checks as O
from memlake.operators import windows as W
from memlake.plans.checks import _SKIP
from memlake.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_REST = "regexp_extract(url, '://[^/]*/(.*)$', 1)"


def _rest() -> Column:
    return F.regexp_extract("url", "://[^/]*/(.*)$", 1)


def _text(column: str) -> Column:
    return F.col(column).cast("string")


@R.query(
    f"""SELECT page_id, p AS path, p <> '' AND NOT starts_with(p, '/') AND len(list_filter(string_split(p, '/'), lambda x: x IN ('', '.', '..'))) = 0 AND string_split(p, '/')[-1] NOT IN ('ops.jsonl', 'meta.json') AS safe,
CASE WHEN starts_with(p, 'en/') AND NOT contains(p, '..') THEN 'kept/' || substr(p, 4) END AS moved FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/' || {_REST} WHEN 1 THEN replace({_REST}, '/', '/../') WHEN 2 THEN {_REST} || '/meta.json' WHEN 3 THEN replace({_REST}, '/', '//') ELSE {_REST} END AS p FROM pages)"""
)
def url_paths_safe(t):
    """Paths of urls: relative, without steps up or empty ones, not of a reserved name; a prefix is rewritten where nothing leads out."""
    k, rest = F.col("page_id") % 6, _rest()
    path = F.when(k == 0, F.concat(F.lit("/"), rest)).when(k == 1, F.replace(rest, F.lit("/"), F.lit("/../"))).when(k == 2, F.concat(rest, F.lit("/meta.json"))).when(k == 3, F.replace(rest, F.lit("/"), F.lit("//"))).otherwise(rest)
    rows = t.pages.select("page_id", path.alias("path"))
    return rows.select("page_id", "path", O.safe_path(F.col("path"), ("ops.jsonl", "meta.json")).alias("safe"), O.moved(F.col("path"), "en/", "kept/").alias("moved"))


_GLOBBED = "CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN replace(replace(url, '.', '['), '/', '\\') ELSE replace(url, '?', '') END"


@R.query(f"SELECT page_id, CASE WHEN regexp_matches(path, '[*?\\[]') THEN regexp_replace(replace(path, '\\', '\\\\'), '([*?\\[\\]])', '[\\1]', 'g') ELSE path END AS pattern FROM (SELECT page_id, {_GLOBBED} AS path FROM pages)")
def url_patterns(t):
    """Urls and paths as patterns that match themselves only."""
    k, u = F.col("page_id") % 3, F.col("url")
    path = F.when(k == 0, u).when(k == 1, F.replace(F.replace(u, F.lit("."), F.lit("[")), F.lit("/"), F.lit("\\"))).otherwise(F.replace(u, F.lit("?"), F.lit("")))
    return t.pages.select("page_id", T.glob_literal(path).alias("pattern"))


@R.query(
    f"""SELECT page_id, split_part(spec, '=', 1) AS alias, split_part(spec, '=', 2) AS root, CASE WHEN strpos(rel, '/') > 1 AND strpos(rel, '/') < length(rel) THEN substr(rel, strpos(rel, '/') + 1) END AS sub, contains(rel, chr(13)) AS broken
FROM (SELECT page_id, regexp_extract(url, '://([^./]*)', 1) || '=/' || page_id % 50 AS spec, CASE page_id % 4 WHEN 0 THEN {_REST} || chr(13) WHEN 1 THEN '/' || {_REST} ELSE {_REST} END AS rel FROM pages)"""
)
def url_roots(t):
    """Roots by alias and the path below the first folder; a line break in a path is told."""
    k, rest = F.col("page_id") % 4, _rest()
    spec = F.str_to_map(F.concat(F.regexp_extract("url", "://([^./]*)", 1), F.lit("=/"), (F.col("page_id") % 50).cast("string")), F.lit(":"), F.lit("="))
    rel = F.when(k == 0, F.concat(rest, F.lit("\r"))).when(k == 1, F.concat(F.lit("/"), rest)).otherwise(rest)
    at = F.locate("/", rel)
    return t.pages.select("page_id", F.map_keys(spec)[0].alias("alias"), F.map_values(spec)[0].alias("root"), F.when((at > 1) & (at < F.length(rel)), F.substring(rel, at + 1, F.length(rel))).alias("sub"), F.contains(rel, F.lit("\r")).alias("broken"))


_SHELL = "CASE event_id % 8 WHEN 0 THEN 'cd /d' || user_id || ' && ' WHEN 1 THEN 'sudo -uu' || user_id || ' ' WHEN 2 THEN 'env K=' || user_id || ' J=1 ' WHEN 3 THEN 'A' || user_id || '=x ' WHEN 4 THEN 'nohup time ' WHEN 7 THEN 'sudo env X=' || user_id || ' nice -n5 ' ELSE '' END || CASE WHEN event_id % 8 = 6 THEN 'cd /d' || user_id ELSE event_type || user_id || ' ' || props END"


@R.query(f"SELECT command, count(*) AS n, min(event_id) AS first FROM (SELECT event_id, coalesce(nullif(split_part(regexp_replace({_SHELL}, '{_SKIP}', ''), ' ', 1), ''), 'Bash') AS command FROM events) GROUP BY command")
def shell_lines(t):
    """The commands that lines run, past changes of folder, wrappers with their options, and assignments; one for each user and kind of event."""
    k, user = F.col("event_id") % 8, _text("user_id")
    before = F.when(k == 0, F.concat(F.lit("cd /d"), user, F.lit(" && "))).when(k == 1, F.concat(F.lit("sudo -uu"), user, F.lit(" "))).when(k == 2, F.concat(F.lit("env K="), user, F.lit(" J=1 "))).when(k == 3, F.concat(F.lit("A"), user, F.lit("=x ")))
    before = before.when(k == 4, "nohup time ").when(k == 7, F.concat(F.lit("sudo env X="), user, F.lit(" nice -n5 "))).otherwise("")
    line = F.concat(before, F.when(k == 6, F.concat(F.lit("cd /d"), user)).otherwise(F.concat("event_type", user, F.lit(" "), "props")))
    return t.events.select("event_id", F.coalesce(O.command(line), F.lit("Bash")).alias("command")).groupBy("command").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


_LOG = "CASE doc_id % 5 WHEN 0 THEN 'skipping item (n=' || n_chars || ')' WHEN 1 THEN 'only ' || n_chars % 9 || ' rounds < min ' || n_chars % 7 WHEN 2 THEN 'filtered out by model: ' || lang WHEN 3 THEN 'empty intent, skipping ' || source ELSE source || ' fine' END"


@R.query(f"SELECT doc_id, CASE WHEN n_chars % 4 = 0 THEN 'passed' WHEN regexp_matches(line, 'skipping item \\(n=[0-9]+\\)|only [0-9]+ rounds < min [0-9]+') THEN 'structural' WHEN regexp_matches(line, 'filtered out by model: ?|empty (intent|approach), skipping') THEN 'semantic' ELSE 'other' END AS outcome FROM (SELECT *, {_LOG} AS line FROM documents)")
def log_windows(t):
    """A job's window within a longer log, by its bytes, with whole texts on both sides of it."""
    k, n, body = F.col("doc_id") % 5, F.col("n_chars"), F.coalesce("text", F.lit(""))
    log = F.when(k == 0, F.concat(F.lit("skipping item (n="), n.cast("string"), F.lit(")"))).when(k == 1, F.concat(F.lit("only "), (n % 9).cast("string"), F.lit(" rounds < min "), (n % 7).cast("string")))
    log = log.when(k == 2, F.concat(F.lit("filtered out by model: "), "lang")).when(k == 3, F.concat(F.lit("empty intent, skipping "), "source")).otherwise(F.concat("source", F.lit(" fine")))
    window = F.decode(F.substring(F.encode(F.concat(body, log, body), "UTF-8"), F.octet_length(body) + 1, F.octet_length(log)), "UTF-8")
    return t.documents.select("doc_id", O.log_outcome(n % 4 == 0, window).alias("outcome"))


_LISTED = f"CASE page_id % 6 WHEN 0 THEN '>f+++++++++ ' || {_REST} WHEN 1 THEN 'cd+++++++++ ' || {_REST} WHEN 2 THEN '.d..t...... ' || {_REST} WHEN 3 THEN '.f...p..... ' || {_REST} WHEN 4 THEN '*' || {_REST} ELSE '' END"


@R.query(f"SELECT kind, path, count(*) AS n FROM (SELECT CASE WHEN l = '' THEN 'blank' WHEN starts_with(l, '>f') THEN 'sent' WHEN starts_with(l, 'cd') OR starts_with(l, '.d') OR starts_with(l, '.f') THEN 'other' ELSE 'unknown' END AS kind, CASE WHEN starts_with(l, '>f') THEN substr(l, strpos(l, ' ') + 1) END AS path FROM (SELECT {_LISTED} AS l FROM pages)) GROUP BY ALL")
def listing_lines(t):
    """A transfer's listing of the pages' paths: what was sent, by path, and lines that nobody knows."""
    k, rest = F.col("page_id") % 6, _rest()
    line = F.when(k == 5, "").when(k == 4, F.concat(F.lit("*"), rest)).otherwise(F.concat(F.element_at(F.array(*map(F.lit, (">f+++++++++ ", "cd+++++++++ ", ".d..t...... ", ".f...p..... "))), F.least(k + 1, F.lit(4)).cast("int")), rest))
    return O.itemized(t.pages.select(line.alias("line")), "line").groupBy("kind", "path").agg(F.count("*").alias("n"))


@R.query(
    """SELECT name, regexp_full_match(name, 'backup-[0-9]{4}') AS valid, CASE WHEN regexp_full_match(name, 'backup-[0-9]{4}') THEN CAST(substr(name, 8) AS BIGINT) END AS generation, starts_with(name, 'src') AS legacy, count(*) AS n
FROM (SELECT CASE WHEN n_chars % 7 = 0 THEN 'backup-' || doc_id WHEN n_chars % 5 = 0 THEN source || '-old' ELSE 'backup-' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') || CASE WHEN n_chars % 11 = 0 THEN '.tmp' ELSE '' END END AS name FROM documents) GROUP BY name"""
)
def backup_names(t):
    """Names of backups by the documents they were made of: those of the right form with their generation, unfinished and older ones apart."""
    n, d = F.col("n_chars"), _text("doc_id")
    name = F.when(n % 7 == 0, F.concat(F.lit("backup-"), d)).when(n % 5 == 0, F.concat("source", F.lit("-old"))).otherwise(F.concat(F.lit("backup-"), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"), F.when(n % 11 == 0, ".tmp").otherwise("")))
    valid = F.col("name").rlike(r"^backup-[0-9]{4}\z")
    return t.documents.select(name.alias("name")).groupBy("name").agg(F.count("*").alias("n")).select("name", valid.alias("valid"), F.when(valid, F.expr("try_cast(substr(name, 8) as bigint)")).alias("generation"), F.col("name").startswith("src").alias("legacy"), "n")


@R.query(
    """WITH c AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS u, count(*) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY conv_id),
m AS (SELECT conv_id, CASE conv_id % 9 WHEN 4 THEN 'READ_FAILED' WHEN 5 THEN 'EXEMPT' WHEN 6 THEN '-' || (u + 1) ELSE CAST(u AS VARCHAR) END AS prev, CASE conv_id % 10 WHEN 3 THEN NULL WHEN 7 THEN 'READ_FAILED' ELSE CAST(a AS VARCHAR) END AS cur FROM c)
SELECT conv_id, CASE WHEN prev = 'EXEMPT' THEN 'exempt' WHEN TRY_CAST(prev AS BIGINT) IS NULL OR TRY_CAST(prev AS BIGINT) < 0 THEN 'poisoned' WHEN cur IS NULL THEN 'disappeared' WHEN TRY_CAST(cur AS BIGINT) IS NULL THEN 'unreadable' WHEN TRY_CAST(cur AS BIGINT) < TRY_CAST(prev AS BIGINT) THEN 'shrunk' ELSE 'ok' END AS verdict FROM m"""
)
def census_of_turns(t):
    """A census of each conversation's turns against a former one; marks among the counts poison or hide them."""
    c = t.conversations.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("u"), F.count_if(F.col("role") == "assistant").alias("a"))
    k, m = F.col("conv_id") % 9, F.col("conv_id") % 10
    prev = F.when(k == 4, "READ_FAILED").when(k == 5, "EXEMPT").when(k == 6, F.concat(F.lit("-"), (F.col("u") + 1).cast("string"))).otherwise(_text("u"))
    cur = F.when(m == 3, None).when(m == 7, "READ_FAILED").otherwise(_text("a"))
    return c.select("conv_id", O.census_verdict(prev, cur).alias("verdict"))


@R.query("SELECT page_id, mark, CASE WHEN regexp_full_match(mark, '[0-9]+') THEN CAST(mark AS BIGINT) END AS value FROM (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS mark FROM pages)")
def marks_in_urls(t):
    """The last part of each url as a mark: a number only if the whole of it is digits."""
    mark = F.regexp_extract("url", r"([^/]*)\z", 1)
    return t.pages.select("page_id", mark.alias("mark")).select("page_id", "mark", F.when(F.col("mark").rlike(r"^[0-9]+\z"), F.expr("try_cast(mark as bigint)")).alias("value"))


_COUNTED = """'{"status":' || CASE WHEN event_id % 7 = 3 THEN '7' ELSE '"' || event_type || '"' END || ',"s":{"files":' || CASE event_id % 5 WHEN 1 THEN 'true' WHEN 2 THEN '"' || user_id || '"' ELSE CAST(user_id % 3 AS VARCHAR) END || CASE WHEN event_id % 4 = 1 THEN '' ELSE ',"bytes":' || user_id * 7 END || '}}'"""


@R.query(
    f"""SELECT user_id, count(*) FILTER (WHERE coalesce(json_type(j, '$.s.files') IN ('UBIGINT', 'BIGINT') AND json_type(j, '$.s.bytes') IN ('UBIGINT', 'BIGINT') AND json_type(j, '$.status') = 'VARCHAR', false)) AS trusted,
count(*) FILTER (WHERE coalesce(TRY_CAST(j ->> '$.s.files' AS BIGINT) > 0, false)) AS verified, count(*) AS n FROM (SELECT user_id, {_COUNTED} AS j FROM events) GROUP BY user_id"""
)
def counter_summaries(t):
    """Summaries of each user's runs that can be trusted: every counter there and a whole number, no flag or text for one."""
    e, user = F.col("event_id"), _text("user_id")
    status = F.when(e % 7 == 3, "7").otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    files = F.when(e % 5 == 1, "true").when(e % 5 == 2, F.concat(F.lit('"'), user, F.lit('"'))).otherwise((F.col("user_id") % 3).cast("string"))
    size = F.when(e % 4 == 1, "").otherwise(F.concat(F.lit(',"bytes":'), (F.col("user_id") * 7).cast("string")))
    rows = t.events.select("user_id", F.try_parse_json(F.concat(F.lit('{"status":'), status, F.lit(',"s":{"files":'), files, size, F.lit("}}"))).alias("v"))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    trusted = (kind("$.s.files") == "BIGINT") & (kind("$.s.bytes") == "BIGINT") & (kind("$.status") == "STRING")
    verified = (F.try_variant_get("v", "$.s.files", "bigint") > 0) & (kind("$.s.files") != "BOOLEAN")
    return rows.groupBy("user_id").agg(F.count_if(trusted).alias("trusted"), F.count_if(verified).alias("verified"), F.count("*").alias("n"))


_READY = """'{"vectors":{"error":' || CASE WHEN event_id % 5 = 0 THEN '"' || event_type || '"' ELSE 'null' END || ',"active":' || CASE event_id % 4 WHEN 0 THEN '"true"' WHEN 1 THEN 'false' ELSE 'true' END || ',"embedder":"' || event_type || CASE WHEN user_id % 3 = 0 THEN '-bge-m' ELSE '-bge' END || '"},"index":{"exists":' || CASE WHEN user_id % 4 = 0 THEN '1' ELSE 'true' END || CASE WHEN event_id % 3 = 0 THEN '' ELSE ',"status":"' || event_type || '"' END || CASE WHEN event_id % 11 = 0 THEN '' ELSE '}}' END"""


@R.query(
    f"""WITH v AS (SELECT user_id, CASE WHEN json_valid(j) THEN j END AS j FROM (SELECT user_id, {_READY} AS j FROM events))
SELECT user_id, count(*) FILTER (WHERE coalesce((json_type(j, '$.vectors.error') IS NULL OR json_type(j, '$.vectors.error') = 'NULL') AND json_type(j, '$.vectors.active') = 'BOOLEAN' AND (j ->> '$.vectors.active') = 'true' AND ends_with(j ->> '$.vectors.embedder', 'bge'), false)) AS semantic,
count(*) FILTER (WHERE coalesce(json_type(j, '$.index.exists') = 'BOOLEAN' AND (j ->> '$.index.exists') = 'true' AND coalesce(j ->> '$.index.status', '') <> 'error', false)) AS lexical, count(*) AS n FROM v GROUP BY user_id"""
)
def statuses_ready(t):
    """How many of each user's statuses are ready: each nested field there, of its type and right; anything odd or torn isn't."""
    e, u = F.col("event_id"), F.col("user_id")
    j = F.concat(
        F.lit('{"vectors":{"error":'), F.when(e % 5 == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise("null"), F.lit(',"active":'), F.when(e % 4 == 0, '"true"').when(e % 4 == 1, "false").otherwise("true"),
        F.lit(',"embedder":"'), "event_type", F.when(u % 3 == 0, "-bge-m").otherwise("-bge"), F.lit('"},"index":{"exists":'), F.when(u % 4 == 0, "1").otherwise("true"),
        F.when(e % 3 == 0, "").otherwise(F.concat(F.lit(',"status":"'), "event_type", F.lit('"'))), F.when(e % 11 == 0, "").otherwise("}}"),
    )
    ready = O.readiness(t.events.select("user_id", j.alias("j")), "j")
    return ready.groupBy("user_id").agg(F.count_if("semantic").alias("semantic"), F.count_if("lexical").alias("lexical"), F.count("*").alias("n"))


_OUT = "CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN '*** in database main ***' || chr(10) || 'Page ' || event_id || ': never used' WHEN 'error' THEN 'Page ' || user_id || ': never used' || CASE WHEN event_id % 2 = 0 THEN chr(10) || 'Page x' ELSE '' END ELSE 'ok' || CASE WHEN event_id % 3 = 0 THEN chr(10) ELSE '' END END"


@R.query(
    f"""SELECT user_id, CASE WHEN out = 'ok' AND err = '' AND code = 0 THEN 'A' WHEN len(list_filter(string_split(out, chr(10)), lambda l: NOT regexp_full_match(l, '\\*\\*\\* in database main \\*\\*\\*|Page [0-9]+: never used'))) = 0 AND err = 'Error: malformed' THEN 'B' ELSE 'FAIL' END AS signature, count(*) AS n
FROM (SELECT user_id, {_OUT} AS out, CASE WHEN event_id % 3 = 1 OR event_type = 'click' THEN 'Error: malformed' ELSE '' END AS err, CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS code FROM events) GROUP BY ALL"""
)
def damage_signatures(t):
    """Outputs of each user's checks by their two known shapes; every other one fails."""
    e, kind = F.col("event_id"), F.col("event_type")
    out = F.when(kind == "view", "ok").when(kind == "click", F.concat(F.lit("*** in database main ***\nPage "), e.cast("string"), F.lit(": never used")))
    out = out.when(kind == "error", F.concat(F.lit("Page "), _text("user_id"), F.lit(": never used"), F.when(e % 2 == 0, "\nPage x").otherwise(""))).otherwise(F.concat(F.lit("ok"), F.when(e % 3 == 0, "\n").otherwise("")))
    err = F.when((e % 3 == 1) | (kind == "click"), "Error: malformed").otherwise("")
    rows = t.events.select("user_id", out.alias("out"), err.alias("err"), F.when(e % 13 == 0, 1).otherwise(0).alias("code"))
    lines = F.forall(F.split("out", "\n"), lambda x: x.rlike(r"^(\*\*\* in database main \*\*\*|Page [0-9]+: never used)\z"))
    sign = F.when((F.col("out") == "ok") & (F.col("err") == "") & (F.col("code") == 0), "A").when(lines & (F.col("err") == "Error: malformed"), "B").otherwise("FAIL")
    return rows.groupBy("user_id", sign.alias("signature")).agg(F.count("*").alias("n"))


_ANSWER = "SELECT event_id, user_id, event_type, 200 + CAST(floor(coalesce(value, 0) * 10) AS BIGINT) % 400 AS http, event_id % 3 AS added FROM events"


@R.query(
    f"""SELECT user_id, count(*) FILTER (WHERE added = 0 AND (event_type IN ('click', 'view') OR (event_type = 'error' AND http = 422))) AS retry, count(*) FILTER (WHERE added = 0 AND (event_type IN ('click', 'view') OR (event_type = 'error' AND http BETWEEN 400 AND 499))) AS harmless,
count(*) FILTER (WHERE (event_type = 'click' AND http BETWEEN 500 AND 599) OR event_type = 'view') AS retryable, count(*) FILTER (WHERE event_type IN ('error', 'signup')) AS bad_response, count(*) FILTER (WHERE event_type = 'click') AS http_error, count(*) FILTER (WHERE event_type NOT IN ('error', 'signup', 'click', 'view')) AS internal FROM ({_ANSWER}) GROUP BY user_id"""
)
def answers_by_user(t):
    """Answers by what they mean: whether to try again, whether they left no trace, and whose fault they are."""
    http = 200 + F.floor(F.coalesce("value", F.lit(0.0)) * 10).cast("long") % 400
    rows = t.events.select("user_id", F.col("event_type").alias("kind"), http.alias("http"), (F.col("event_id") % 3).alias("added"))
    kind, lost, refused = F.col("kind"), F.col("kind").isin("click", "view"), F.col("kind") == "error"
    safe = lambda c: (F.col("added") == 0) & (lost | (refused & c))
    code = F.when(kind.isin("error", "signup"), "bad_response").when(kind == "click", "http_error").when(kind == "view", "timeout").otherwise("internal")
    again = F.when(kind == "click", F.col("http").between(500, 599)).otherwise(kind == "view")
    return rows.groupBy("user_id").agg(
        F.count_if(safe(F.col("http") == 422)).alias("retry"), F.count_if(safe(F.col("http").between(400, 499))).alias("harmless"), F.count_if(again).alias("retryable"),
        *[F.count_if(code == c).alias(c) for c in ("bad_response", "http_error", "internal")],
    )


@R.query("SELECT doc_id, coalesce(e, c, 0.62) AS theta, (length(text) % 100) / 100.0 >= coalesce(e, c, 0.62) AS shown FROM (SELECT doc_id, text, CASE WHEN lang = 'en' AND n_chars % 3 = 0 THEN (n_chars % 90) / 100.0 END AS e, CASE WHEN n_chars % 2 = 0 THEN (length(source) * n_chars % 80) / 100.0 END AS c FROM documents WHERE text IS NOT NULL)")
def thresholds_in_effect(t):
    """A threshold from a row's environment before the one of its source before the default."""
    n = F.col("n_chars")
    env, own = F.when((F.col("lang") == "en") & (n % 3 == 0), (n % 90) / 100.0), F.when(n % 2 == 0, (F.length("source") * n % 80) / 100.0)
    theta = F.coalesce(env, own, F.lit(0.62))
    return t.documents.filter("text is not null").select("doc_id", theta.alias("theta"), ((F.length("text") % 100) / 100.0 >= theta).alias("shown"))


_TRACED = """SELECT event_id, user_id AS pid, ['openat', 'unlink', 'stat', 'rename', 'chdir', 'getcwd', 'ioctl'][event_id % 7 + 1] AS syscall, CASE event_id % 6 WHEN 0 THEN '/data/' || event_type || '/' || user_id WHEN 1 THEN '/tmp/' || event_id WHEN 2 THEN '/dev/null' WHEN 3 THEN '/database/' || user_id WHEN 4 THEN event_type || '/' || event_id ELSE '/data' END AS path,
CASE WHEN event_id % 2 = 0 THEN 'O_RDONLY' ELSE 'O_WRONLY|O_CREAT' END AS flags, CASE event_id % 4 WHEN 0 THEN '0' WHEN 1 THEN '-1 EACCES (denied)' WHEN 2 THEN '-1 EIO' ELSE CAST(user_id % 9 AS VARCHAR) END AS rc FROM events"""
_IN = "(full_path = '/data' OR starts_with(full_path, '/data/'))"
_BAD = "CASE WHEN starts_with(rc, '-1') AND split_part(rc, ' ', 2) IN ('EACCES', 'ENOENT', 'EPERM', 'EROFS', 'EEXIST') THEN 'FAILED_WRITE_ATTEMPT' ELSE 'VIOLATION' END"


@R.query(
    f"""WITH c AS (SELECT *, CASE WHEN starts_with(path, '/') THEN path ELSE coalesce(last_value(CASE WHEN syscall = 'chdir' AND rc = '0' AND starts_with(path, '/') THEN path END IGNORE NULLS) OVER (PARTITION BY pid ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '/home') || '/' || path END AS full_path FROM ({_TRACED}))
SELECT pid, verdict, count(*) AS n FROM (SELECT pid, CASE WHEN syscall = 'getcwd' THEN NULL WHEN syscall = 'chdir' THEN CASE WHEN {_IN} THEN 'ALLOW_IN_ROOT' ELSE 'CWD_NAVIGATION_OUTSIDE' END WHEN syscall = 'openat' THEN CASE WHEN path = '/dev/null' THEN 'ALLOW_DEVICE_NODE' WHEN {_IN} THEN 'ALLOW_IN_ROOT' WHEN flags <> 'O_RDONLY' THEN {_BAD} ELSE 'ALLOW_READONLY_OUTSIDE' END
WHEN syscall = 'stat' THEN CASE WHEN {_IN} THEN 'ALLOW_IN_ROOT' ELSE 'ALLOW_READONLY_OUTSIDE' END WHEN syscall IN ('unlink', 'rename') THEN CASE WHEN {_IN} THEN 'ALLOW_IN_ROOT' ELSE {_BAD} END WHEN {_IN} THEN 'ALLOW_IN_ROOT' ELSE 'UNCLASSIFIED' END AS verdict FROM c) WHERE verdict IS NOT NULL GROUP BY ALL"""
)
def process_paths(t):
    """Each user's calls against the allowed roots, relative paths under the folder its process last went to."""
    e, user = F.col("event_id"), _text("user_id")
    pick = lambda n, *values: F.element_at(F.array(*values), (e % n + 1).cast("int"))
    call = pick(7, *map(F.lit, ("openat", "unlink", "stat", "rename", "chdir", "getcwd", "ioctl")))
    path = pick(6, F.concat(F.lit("/data/"), "event_type", F.lit("/"), user), F.concat(F.lit("/tmp/"), e.cast("string")), F.lit("/dev/null"), F.concat(F.lit("/database/"), user), F.concat("event_type", F.lit("/"), e.cast("string")), F.lit("/data"))
    rc = pick(4, F.lit("0"), F.lit("-1 EACCES (denied)"), F.lit("-1 EIO"), (F.col("user_id") % 9).cast("string"))
    calls = t.events.select("event_id", F.col("user_id").alias("pid"), call.alias("syscall"), path.alias("path"), pick(2, F.lit("O_RDONLY"), F.lit("O_WRONLY|O_CREAT")).alias("flags"), rc.alias("rc"))
    return O.call_verdicts(calls, ["/data"], "/home").filter("verdict is not null").groupBy("pid", "verdict").agg(F.count("*").alias("n"))


@R.query("SELECT doc_id, greatest(1, least(50, n)) AS shown, least(3 * greatest(1, least(50, n)), 150) AS fetched, greatest(1, least(4000, n * 100)) AS chars FROM (SELECT doc_id, length(text) % 120 - 20 AS n FROM documents WHERE text IS NOT NULL)")
def limits_asked(t):
    """How much a search shows, fetches and cuts, by what was asked for."""
    n = F.length("text") % 120 - 20
    shown = F.greatest(F.lit(1), F.least(F.lit(50), n))
    return t.documents.filter("text is not null").select("doc_id", shown.cast("long").alias("shown"), F.least(3 * shown, F.lit(150)).cast("long").alias("fetched"), F.greatest(F.lit(1), F.least(F.lit(4000), n * 100)).cast("long").alias("chars"))


@R.query(
    """SELECT o_custkey, CASE WHEN budget IS NULL THEN 'no_limit' WHEN spent >= budget THEN 'no_headroom' WHEN NOT embeds THEN 'no_embedding' ELSE 'ready' END AS verdict, count(*) AS n
FROM (SELECT o_custkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice) AS BIGINT) % 1000 END AS budget, o_orderkey % 700 AS spent, NOT starts_with(o_orderpriority, '5') AS embeds FROM orders) GROUP BY ALL"""
)
def spend_preflight(t):
    """Orders that may be sent, by customer: no limit is a failure like no headroom is."""
    budget = F.when(F.col("o_orderstatus") != "P", F.floor("o_totalprice").cast("long") % 1000)
    spent, embeds = F.col("o_orderkey") % 700, ~F.col("o_orderpriority").startswith("5")
    verdict = F.when(budget.isNull(), "no_limit").when(spent >= budget, "no_headroom").when(~embeds, "no_embedding").otherwise("ready")
    return t.orders.groupBy("o_custkey", verdict.alias("verdict")).agg(F.count("*").alias("n"))


_SCORED = f"CASE WHEN page_id % 5 = 0 THEN 'no score ' || url ELSE '[0.' || lpad(CAST(page_id % 100 AS VARCHAR), 2, '0') || '] ' || regexp_extract(url, '://([^/]*)', 1) || ' -- ' || {_REST} || CASE WHEN page_id % 3 = 0 THEN ' (stale)' ELSE '' END END"


@R.query(f"SELECT page_id, regexp_extract(line, '^\\[([0-9.]+)\\] (\\S+) -- ', 2) AS slug, TRY_CAST(nullif(regexp_extract(line, '^\\[([0-9.]+)\\] (\\S+) -- ', 1), '') AS DOUBLE) AS score, ends_with(line, '(stale)') AS stale FROM (SELECT page_id, {_SCORED} AS line FROM pages)")
def scored_pages(t):
    """Scored lines of pages with their slug; a mark at the end says that a page is stale."""
    p = F.col("page_id")
    line = F.concat(F.lit("[0."), F.lpad((p % 100).cast("string"), 2, "0"), F.lit("] "), F.regexp_extract("url", "://([^/]*)", 1), F.lit(" -- "), _rest(), F.when(p % 3 == 0, " (stale)").otherwise(""))
    line = F.when(p % 5 == 0, F.concat(F.lit("no score "), "url")).otherwise(line)
    part = lambda i: F.regexp_extract("line", r"^\[([0-9.]+)\] (\S+) -- ", i)
    return t.pages.select("page_id", line.alias("line")).select("page_id", part(2).alias("slug"), F.nullif(part(1), F.lit("")).cast("double").alias("score"), F.col("line").endswith("(stale)").alias("stale"))


@R.query("SELECT wanted, n, CASE WHEN n = 1 THEN one END AS found FROM (SELECT source || '+' || lang AS wanted, count(*) AS n, min(doc_id) AS one FROM documents WHERE contains(text, 'token') AND contains(text, lang) GROUP BY source, lang)")
def one_with_both(t):
    """For each source and language the one text that has both parts in it, if there is exactly one."""
    hits = t.documents.filter(F.contains("text", F.lit("token")) & F.contains("text", F.col("lang")))
    g = hits.groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("one"))
    return g.select(F.concat_ws("+", "source", "lang").alias("wanted"), "n", F.when(F.col("n") == 1, F.col("one")).alias("found"))


@R.query("SELECT conv_id, count(*) FILTER (WHERE noise) AS dropped, count(*) FILTER (WHERE NOT noise) AS kept FROM (SELECT conv_id, trim(CASE WHEN (conv_id + turn) % 7 = 0 THEN '  ' || ['ok', 'yes', 'no', 'thanks', 'OK', 'yes.', ''][turn % 7 + 1] || ' ' ELSE coalesce(text, '') END) IN ('ok', 'yes', 'no', 'thanks') AS noise FROM conversations) GROUP BY conv_id")
def noise_words(t):
    """Messages that are one of four words and nothing else, dropped and counted for each conversation; every seventh is made short."""
    short = F.element_at(F.array(*map(F.lit, ("ok", "yes", "no", "thanks", "OK", "yes.", ""))), (F.col("turn") % 7 + 1).cast("int"))
    body = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.concat(F.lit("  "), short, F.lit(" "))).otherwise(F.coalesce("text", F.lit("")))
    rows = t.conversations.select("conv_id", F.trim(body).isin("ok", "yes", "no", "thanks").alias("noise"))
    return rows.groupBy("conv_id").agg(F.count_if("noise").alias("dropped"), F.count_if(~F.col("noise")).alias("kept"))


@R.query("SELECT d.doc_id, d.source FROM documents d WHERE n_chars > 300 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def outside_snapshot(t):
    """Documents that a snapshot (those labelled) doesn't hold yet."""
    return t.documents.filter("n_chars > 300").join(t.labels.select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


@R.query("SELECT o_orderkey AS key, 'not_seen' AS problem FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1 AND l_quantity > 5) UNION ALL SELECT DISTINCT l_orderkey, 'not_scanned' FROM lineitem WHERE l_linenumber = 1 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def scan_against_index(t):
    """Keys of a scan that an index over other rows doesn't give, and the other way round."""
    first = t.lineitem.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("key"), "l_quantity")
    scanned = t.orders.select(F.col("o_orderkey").alias("key"), "o_orderstatus")
    seen = scanned.join(first.filter("l_quantity > 5"), "key", "left_anti").select("key", F.lit("not_seen").alias("problem"))
    return seen.unionByName(first.select("key").distinct().join(scanned.filter("o_orderstatus <> 'P'"), "key", "left_anti").select("key", F.lit("not_scanned").alias("problem")))


_JOB = "CASE page_id % 4 WHEN 0 THEN 'useful:' || page_id || ':' || url WHEN 1 THEN 'related:' || url WHEN 2 THEN url ELSE 'useful:q' || page_id % 9 || ':card' END"


@R.query(f"SELECT page_id, split_part(job, ':', 1) AS kind, CASE WHEN contains(job, ':') THEN split_part(job, ':', 2) END AS qid, CASE WHEN len(string_split(job, ':')) > 2 THEN substr(job, length(split_part(job, ':', 1)) + length(split_part(job, ':', 2)) + 3) END AS card FROM (SELECT page_id, {_JOB} AS job FROM pages)")
def job_names(t):
    """Names of jobs in three parts, of which the last keeps its colons; parts that aren't there are null."""
    k, p = F.col("page_id") % 4, _text("page_id")
    job = F.when(k == 0, F.concat(F.lit("useful:"), p, F.lit(":"), "url")).when(k == 1, F.concat(F.lit("related:"), "url")).when(k == 2, F.col("url")).otherwise(F.concat(F.lit("useful:q"), (F.col("page_id") % 9).cast("string"), F.lit(":card")))
    parts = F.split(job, ":", 3)
    return t.pages.select("page_id", parts.alias("parts")).select("page_id", F.get("parts", F.lit(0)).alias("kind"), F.get("parts", F.lit(1)).alias("qid"), F.get("parts", F.lit(2)).alias("card"))


@R.query(
    """WITH c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN to_base64(encode(coalesce(text, ''))) WHEN 1 THEN left(to_base64(encode(coalesce(text, ''))), 5) WHEN 2 THEN '*' || source ELSE to_base64(encode(source || chr(10) || lang)) END AS coded FROM documents),
k AS (SELECT *, regexp_full_match(coded, '([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?') AS good FROM c)
SELECT doc_id, CASE WHEN good THEN octet_length(from_base64(CASE WHEN good THEN coded ELSE '' END)) END AS bytes, CASE WHEN good THEN sha256(from_base64(CASE WHEN good THEN coded ELSE '' END)) END AS digest FROM k"""
)
def snapshot_bytes(t):
    """Bytes behind a snapshot's coded fields; what isn't whole base64 has none and fails nothing."""
    d, code = F.col("doc_id") % 4, lambda c: F.base64(F.encode(c, "UTF-8"))
    body = F.regexp_replace(code(F.coalesce("text", F.lit(""))), "[\r\n]", "")
    coded = F.when(d == 0, body).when(d == 1, F.substring(body, 1, 5)).when(d == 2, F.concat(F.lit("*"), "source")).otherwise(code(F.concat_ws("\n", "source", "lang")))
    rows = t.documents.select("doc_id", coded.alias("coded"))
    good = F.col("coded").rlike(r"^([A-Za-z0-9+/]{4})*+([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")
    raw = F.when(good, F.unbase64("coded"))
    return rows.select("doc_id", F.octet_length(raw).alias("bytes"), F.sha2(raw, 256).alias("digest"))


@R.query("SELECT event_id, row_number() OVER (ORDER BY started, user_id) AS place FROM (SELECT user_id, min(ts) AS started, arg_min(event_id, ts) AS event_id FROM events WHERE ts IS NOT NULL GROUP BY user_id)")
def requests_in_order(t):
    """Requests by when they began, then by id: the order itself as a number, from ranks within hours and the hours' counts."""
    first = t.events.filter("ts is not null").groupBy("user_id").agg(F.min("ts").alias("started"), F.min_by("event_id", "ts").alias("event_id"))
    rows = first.withColumn("hour", F.date_trunc("hour", "started"))
    return W.numbered_by_range(rows, "hour", [F.col("started"), F.col("user_id")], "_from_0", "_n").select("event_id", (F.col("_from_0") + 1).alias("place"))


_SWEPT = "SELECT lang, th AS theta, count(*) FILTER (WHERE s >= th AND good) AS tp, count(*) FILTER (WHERE s >= th AND NOT good) AS fp, count(*) FILTER (WHERE good) AS good FROM (SELECT lang, (n_chars % 100) / 100.0 AS s, quality = 1 AND toxic = 0 AS good FROM documents JOIN labels USING (doc_id)), (SELECT unnest([0.2, 0.4, 0.6, 0.8]) AS th) GROUP BY lang, th"


@R.query(
    f"""WITH s AS (SELECT lang, theta, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS p, CASE WHEN good = 0 THEN 1.0 ELSE tp / good END AS r, good FROM ({_SWEPT}))
SELECT lang, CASE WHEN good > 0 THEN CAST(theta AS DOUBLE) END AS theta FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p >= 0.75 DESC, CASE WHEN p >= 0.75 THEN r ELSE p END DESC, theta) AS k FROM s) WHERE k = 1"""
)
def threshold_by_language(t):
    """For each language the threshold of best recall at enough precision, swept over its own labels; none where nothing good was labelled."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    rows = t.documents.select("doc_id", "lang", ((F.col("n_chars") % 100) / 100.0).alias("s")).join(t.labels, "doc_id").select("lang", "s", good.alias("good"))
    steps = (0.2, 0.4, 0.6, 0.8)
    counts = rows.groupBy("lang").agg(F.count_if("good").alias("good"), F.array(*[F.struct(F.lit(th).alias("theta"), F.count_if((F.col("s") >= th) & F.col("good")).alias("tp"), F.count_if((F.col("s") >= th) & ~F.col("good")).alias("fp")) for th in steps]).alias("sweep"))
    share = lambda a, b: F.when(b == 0, 1.0).otherwise(a / b)
    x = counts.select("lang", "good", F.explode("sweep").alias("x")).select("lang", "good", "x.theta", share(F.col("x.tp"), F.col("x.tp") + F.col("x.fp")).alias("p"), share(F.col("x.tp"), F.col("good")).alias("r"))
    enough = F.col("p") >= 0.75
    best = W.first_per_key(x, ["lang"], [F.desc(enough), F.desc(F.when(enough, F.col("r")).otherwise(F.col("p"))), F.col("theta")])
    return best.select("lang", F.when(F.col("good") > 0, F.col("theta")).alias("theta"))
