"""Queries that check and classify: payloads, paths, commands, traces, inventories, gates, logs, sinks and search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.functions import rules as T
from memlake.operators import checks as O
from memlake.operators import windows as W
from memlake.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _pick(key: str, *values):
    """One of the values by the key's remainder."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


@R.query("SELECT count(*) AS n, count(*) FILTER (WHERE lang IN ('en', 'de')) AS chosen, min(coalesce(CASE WHEN doc_id % 2 = 0 THEN n_chars END, doc_id)) AS first FROM documents WHERE ('' = '' OR source = '')")
def optional_predicates(t):
    """Predicates that are left out where their parameter is empty: a workspace, a list of agents."""
    rows = O.chosen(t.documents, {"source": "", "lang": []})
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("lang").isin("en", "de")).alias("chosen"), F.min(F.coalesce(F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")), F.col("doc_id"))).alias("first"))


@R.query("SELECT source, count(*) FILTER (WHERE quality = 0) > 30 OR count(*) FILTER (WHERE toxic = 1) > 0 OR count(*) > 60 AS alert FROM documents JOIN labels USING (doc_id) GROUP BY source")
def report_alert(t):
    """An alert if anything fatal, over its cap or newly quarantined is in the report."""
    rows = t.documents.select("doc_id", "source").join(t.labels, "doc_id").groupBy("source")
    return rows.agg(((F.count_if(F.col("quality") == 0) > 30) | (F.count_if(F.col("toxic") == 1) > 0) | (F.count("*") > 60)).alias("alert"))


_STATUS = ("""'{"vectors":{"error":null,"active":true,"embedder":"x-bge"},"index":{"exists":true,"status":"ok"}}'""", """'{"vectors":{"error":"e","active":true,"embedder":"x-bge"},"index":{"exists":true,"status":"error"}}'""", """'{"vectors":{"active":"true","embedder":"x-bge"},"index":{"exists":true}}'""", """'{"index":[1]}'""", """'not json'""", """'{"vectors":{"error":null,"active":true,"embedder":"bge-x"},"index":{"exists":false}}'""")


@R.query(
    f"""WITH s AS (SELECT event_id, [{", ".join(_STATUS)}][event_id % 6 + 1] AS j FROM events), v AS (SELECT event_id, CASE WHEN json_valid(j) THEN j END AS j FROM s)
SELECT coalesce((json_type(j, '$.vectors.error') IS NULL OR json_type(j, '$.vectors.error') = 'NULL') AND json_type(j, '$.vectors.active') = 'BOOLEAN' AND (j ->> '$.vectors.active') = 'true' AND ends_with(j ->> '$.vectors.embedder', 'bge'), false) AS semantic,
coalesce(json_type(j, '$.index.exists') = 'BOOLEAN' AND (j ->> '$.index.exists') = 'true' AND coalesce(j ->> '$.index.status', '') <> 'error', false) AS lexical, count(*) AS n FROM v GROUP BY ALL"""
)
def readiness_gate(t):
    """Ready only if every nested field is there, of its type and right; anything odd is not ready."""
    rows = t.events.select(_pick("event_id", *[s.strip("'") for s in _STATUS]).alias("j"))
    return O.readiness(rows, "j").groupBy("semantic", "lexical").agg(F.count("*").alias("n"))


@R.query("SELECT item_id, greatest(1, least(50, n)) AS shown, least(3 * greatest(1, least(50, n)), 150) AS fetched, greatest(1, least(4000, n * 100)) AS chars FROM (SELECT item_id, item_id * 5 - 20 AS n FROM benchmark)")
def search_limits(t):
    n = F.col("item_id") * 5 - 20
    shown = F.greatest(F.lit(1), F.least(F.lit(50), n))
    return t.benchmark.select("item_id", shown.alias("shown"), F.least(3 * shown, F.lit(150)).alias("fetched"), F.greatest(F.lit(1), F.least(F.lit(4000), n * 100)).alias("chars"))


@R.query("SELECT target, count(*) AS n FROM (SELECT CASE WHEN a IN ('click', 'view') THEN a WHEN split_part(a, '/', 1) = 'purchase' THEN 'purchase' END AS target FROM (SELECT CASE WHEN event_id % 3 = 0 AND event_type = 'purchase' THEN event_type || '/sub' WHEN event_id % 50 = 0 THEN '' ELSE event_type END AS a FROM events)) GROUP BY target")
def target_sources(t):
    """Sources that count, a family by its prefix; null for all others."""
    agent = F.when((F.col("event_id") % 3 == 0) & (F.col("event_type") == "purchase"), F.concat("event_type", F.lit("/sub"))).when(F.col("event_id") % 50 == 0, "").otherwise(F.col("event_type"))
    target = F.when(F.col("a").isin("click", "view"), F.col("a")).when(F.split_part("a", F.lit("/"), F.lit(1)) == "purchase", "purchase")
    return t.events.select(agent.alias("a")).groupBy(target.alias("target")).agg(F.count("*").alias("n"))


@R.query("SELECT user_id, count(*) FILTER (WHERE tool) = 0 OR count(*) FILTER (WHERE tool AND id IS NOT NULL) > 0 AS pairable, count(id) AS usable FROM (SELECT user_id, event_type IN ('click', 'error') AND user_id % 5 <> 0 AS tool, CASE WHEN user_id % 3 = 0 THEN NULL WHEN event_id % 4 = 0 THEN nullif('', '') ELSE 'c' || event_id END AS id FROM events) GROUP BY user_id")
def pairable_sessions(t):
    """Sessions without tool rows, or with a tool row whose id is a text that isn't empty."""
    call = F.when(F.col("user_id") % 3 == 0, None).when(F.col("event_id") % 4 == 0, F.lit('""')).otherwise(F.concat(F.lit('"c'), F.col("event_id").cast("string"), F.lit('"')))
    usable = F.nullif(F.try_variant_get(F.try_parse_json(call), "$", "string"), F.lit(""))
    tool = F.col("event_type").isin("click", "error") & (F.col("user_id") % 5 != 0)
    rows = t.events.select("user_id", tool.alias("tool"), usable.alias("id"))
    return rows.groupBy("user_id").agg(((F.count_if("tool") == 0) | (F.count_if(F.col("tool") & F.col("id").isNotNull()) > 0)).alias("pairable"), F.count("id").alias("usable"))


_PAYLOADS = """SELECT event_id, user_id AS rid, event_type, CASE WHEN event_id % 9 = 0 THEN '' WHEN event_id % 10 = 1 THEN 'shared' ELSE 'c' || event_id END AS id, CASE event_id % 6 WHEN 0 THEN '{"task":"t","approach":null}' WHEN 1 THEN '{"task":"t"}' WHEN 2 THEN '{"task":7,"approach":"a"}' ELSE '{"task":"t","approach":"a","extra":null}' END AS item,
CASE WHEN event_id % 8 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 8 = 1 THEN NULL ELSE value END AS score FROM events"""


@R.query(
    f"""WITH p AS (SELECT *, id <> '' AS named, count(*) OVER (PARTITION BY rid, id) = 1 AS once, score IS NULL OR isfinite(score) AS finite, coalesce(json_type(item, '$.task') = 'VARCHAR' AND json_type(item, '$.approach') = 'VARCHAR', false) AND coalesce(json_type(item, '$.extra'), 'NULL') IN ('NULL', 'VARCHAR') AS formed FROM ({_PAYLOADS}))
SELECT rid, count(*) AS n, count(*) FILTER (WHERE named AND once AND finite AND formed) AS good, bool_and(named AND once AND finite AND formed) AS accepted FROM p GROUP BY rid"""
)
def payload_schema(t):
    """An answer counts whole or not at all: ids named and unique, scores finite or missing, fields texts, needed ones there."""
    e = F.col("event_id")
    item = F.when(e % 6 == 0, '{"task":"t","approach":null}').when(e % 6 == 1, '{"task":"t"}').when(e % 6 == 2, '{"task":7,"approach":"a"}').otherwise('{"task":"t","approach":"a","extra":null}')
    score = F.when(e % 8 == 0, float("nan")).when(e % 8 != 1, F.col("value"))
    rows = t.events.select(F.col("user_id").alias("rid"), F.when(e % 9 == 0, "").when(e % 10 == 1, "shared").otherwise(F.concat(F.lit("c"), e.cast("string"))).alias("id"), item.alias("item"), score.alias("score"))
    return O.accepted_payloads(rows, "rid", "id", "item", "score", needed=("task", "approach"), known=("task", "approach", "extra"))


_VERDICTS = """SELECT event_id, 'sj:' || user_id || ':' || event_id % 50 AS job, CASE WHEN event_id % 21 = 0 THEN 'fs:x' ELSE 'sj:' || user_id || ':' || event_id % 50 END AS id, CASE event_id % 7 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '1' ELSE 'true' END AS relevant, CASE event_id % 5 WHEN 0 THEN 'true' ELSE 'false' END AS useful, CASE WHEN event_id % 13 = 0 THEN NULL ELSE 'r' END AS reason FROM events WHERE event_type = 'click'"""


@R.query(
    f"""WITH v AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_id) AS turn FROM ({_VERDICTS})) SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN NOT starts_with(id, 'sj:') THEN 'wrong_kind' WHEN turn > 1 THEN 'duplicate' WHEN relevant IN ('true', 'false') AND useful IN ('true', 'false') AND reason IS NOT NULL AND NOT (useful = 'true' AND relevant = 'false') THEN 'ok' ELSE 'invalid' END AS outcome FROM v) GROUP BY outcome"""
)
def verdict_validity(t):
    """A verdict has flags and a reason, says useful only of what is relevant, is of its kind and the first for its job."""
    e = F.col("event_id")
    job = F.concat(F.lit("sj:"), F.col("user_id").cast("string"), F.lit(":"), (e % 50).cast("string"))
    rows = t.events.filter("event_type = 'click'").select("event_id", F.when(e % 21 == 0, "fs:x").otherwise(job).alias("id"), F.when(e % 7 == 1, "false").when(e % 7 == 2, "1").otherwise("true").alias("relevant"), F.when(e % 5 == 0, "true").otherwise("false").alias("useful"), F.when(e % 13 != 0, "r").alias("reason"))
    turn = F.row_number().over(Window.partitionBy("id").orderBy("event_id"))
    flag = lambda c: F.col(c).isin("true", "false")
    fine = flag("relevant") & flag("useful") & F.col("reason").isNotNull() & ~((F.col("useful") == "true") & (F.col("relevant") == "false"))
    outcome = F.when(~F.col("id").startswith("sj:"), "wrong_kind").when(F.col("turn") > 1, "duplicate").when(fine, "ok").otherwise("invalid")
    return rows.withColumn("turn", turn).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


_PATHS = ("views/a.json", "../up.json", "views/../x", "/etc/abs", "views//b", "ops.jsonl", "views/ops.jsonl", "", "views/.", "deep/er/c.json")


@R.query(f"SELECT p AS path, p <> '' AND NOT starts_with(p, '/') AND len(list_filter(string_split(p, '/'), lambda x: x IN ('', '.', '..'))) = 0 AND string_split(p, '/')[-1] NOT IN ('ops.jsonl', 'meta.json') AS safe, CASE WHEN starts_with(p, 'views/') AND NOT contains(p, '..') THEN 'kept/' || substr(p, 7) END AS moved, count(*) AS n FROM (SELECT {list(_PATHS)!r}[doc_id % 10 + 1] AS p FROM documents) GROUP BY p")
def safe_paths(t):
    """Relative paths without steps up and without reserved names; a prefix is rewritten only where nothing leads out."""
    rows = t.documents.select(_pick("doc_id", *_PATHS).alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    return rows.select("path", O.safe_path(F.col("path"), ("ops.jsonl", "meta.json")).alias("safe"), O.moved(F.col("path"), "views/", "kept/").alias("moved"), "n")


@R.query(
    """WITH h AS (SELECT doc_id, 'agent: ' || trim(source) || chr(10) || CASE WHEN doc_id % 7 = 0 THEN 'agent: twice' || chr(10) ELSE '' END || 'session_key: k' || doc_id AS head, CASE WHEN doc_id % 5 = 0 THEN ' other ' ELSE ' ' || source || ' ' END AS agent FROM documents),
k AS (SELECT doc_id, agent, regexp_extract_all(head, '(?m)^([a-z_]+): ', 1) AS keys, regexp_extract(head, '(?m)^agent: (.*)$', 1) AS a, regexp_extract(head, '(?m)^session_key: (.*)$', 1) AS s FROM h)
SELECT doc_id, CASE WHEN len(keys) <> len(list_distinct(keys)) THEN 'invalid' WHEN a = trim(agent) AND s = 'k' || doc_id THEN 'same' ELSE 'foreign' END AS identity FROM k"""
)
def identity_check(t):
    """Who a file says it is against who it should be; a key that stands twice is invalid."""
    d = F.col("doc_id").cast("string")
    head = F.concat(F.lit("agent: "), F.trim("source"), F.lit("\n"), F.when(F.col("doc_id") % 7 == 0, "agent: twice\n").otherwise(""), F.lit("session_key: k"), d)
    agent = F.when(F.col("doc_id") % 5 == 0, " other ").otherwise(F.concat(F.lit(" "), "source", F.lit(" ")))
    return t.documents.select("doc_id", O.identity(head, {"agent": F.trim(agent), "session_key": F.concat(F.lit("k"), d)}).alias("identity"))


@R.query(
    """WITH o AS (SELECT event_id % 6 AS form, CASE event_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN '*** in database main ***' || chr(10) || 'Page 7: never used' WHEN 2 THEN 'Page 7: never used' WHEN 3 THEN 'ok' || chr(10) || 'ok' WHEN 4 THEN 'Page x: never used' ELSE 'ok' END AS out, CASE event_id % 6 WHEN 1 THEN 'Error: malformed' WHEN 4 THEN 'Error: malformed' ELSE '' END AS err, CASE event_id % 6 WHEN 5 THEN 1 ELSE 0 END AS code FROM events)
SELECT form, CASE WHEN out = 'ok' AND err = '' AND code = 0 THEN 'A' WHEN len(list_filter(string_split(out, chr(10)), lambda l: NOT regexp_full_match(l, '\\*\\*\\* in database main \\*\\*\\*|Page [0-9]+: never used'))) = 0 AND err = 'Error: malformed' THEN 'B' ELSE 'FAIL' END AS signature, count(*) AS n FROM o GROUP BY ALL"""
)
def integrity_signature(t):
    """Two known shapes of a check's output; every other one fails, however harmless it looks."""
    out = _pick("event_id", "ok", "*** in database main ***\nPage 7: never used", "Page 7: never used", "ok\nok", "Page x: never used", "ok")
    err = _pick("event_id", "", "Error: malformed", "", "", "Error: malformed", "")
    code = F.when(F.col("event_id") % 6 == 5, 1).otherwise(0)
    rows = t.events.select((F.col("event_id") % 6).alias("form"), out.alias("out"), err.alias("err"), code.alias("code"))
    lines = F.forall(F.split("out", "\n"), lambda x: x.rlike(r"^(\*\*\* in database main \*\*\*|Page [0-9]+: never used)\z"))
    sign = F.when((F.col("out") == "ok") & (F.col("err") == "") & (F.col("code") == 0), "A").when(lines & (F.col("err") == "Error: malformed"), "B").otherwise("FAIL")
    return rows.groupBy("form", sign.alias("signature")).agg(F.count("*").alias("n"))


_COMMANDS = ("pytest -q", "cd /a && pytest", "sudo -E pytest x", "env -i A=1 B=2 make all", "FOO=1 BAR=2 ls", "nohup time ls -l", "cd /only", "", "sudo env X=1 git log", "-x odd")
_SKIP = r"^(cd( [^& ][^ ]*)*( && ?|$)|(sudo|env|nohup|time|nice)( (-[^ ]*|[^ ]*=[^ ]*))*( |$)|[^- ][^ ]*=[^ ]*( |$))*"


@R.query(f"SELECT command, count(*) AS n FROM (SELECT CASE WHEN tool <> 'Bash' THEN tool ELSE coalesce(nullif(split_part(regexp_replace(cmd, '{_SKIP}', ''), ' ', 1), ''), 'Bash') END AS command FROM (SELECT CASE WHEN event_id % 11 = 0 THEN 'Read' ELSE 'Bash' END AS tool, {list(_COMMANDS)!r}[event_id % 10 + 1] AS cmd FROM events)) GROUP BY command")
def command_names(t):
    """The command that a shell line runs, past changes of folder, wrappers with their options, and assignments."""
    rows = t.events.select(F.when(F.col("event_id") % 11 == 0, "Read").otherwise("Bash").alias("tool"), _pick("event_id", *_COMMANDS).alias("cmd"))
    return rows.groupBy(F.when(F.col("tool") != "Bash", F.col("tool")).otherwise(F.coalesce(O.command(F.col("cmd")), F.lit("Bash"))).alias("command")).agg(F.count("*").alias("n"))


@R.query(
    """SELECT event_type, status, added, CASE WHEN added > 0 THEN false WHEN event_type IN ('click', 'view') THEN true ELSE event_type = 'error' AND status = 422 END AS retry, CASE WHEN added > 0 THEN false WHEN event_type IN ('click', 'view') THEN true ELSE event_type = 'error' AND status BETWEEN 400 AND 499 END AS harmless, count(*) AS n
FROM (SELECT event_type, [402, 422, 429, 500, 503][event_id % 5 + 1] AS status, event_id % 3 AS added FROM events) GROUP BY ALL"""
)
def retry_safety(t):
    """Nothing is tried again once something was added; connection failures and one status may be, all 4xx left no trace."""
    rows = t.events.select("event_type", _pick("event_id", 402, 422, 429, 500, 503).alias("status"), (F.col("event_id") % 3).alias("added"))
    lost, refused = F.col("event_type").isin("click", "view"), F.col("event_type") == "error"
    safe = lambda c: F.when(F.col("added") > 0, False).otherwise(lost | (refused & c))
    return rows.groupBy("event_type", "status", "added").agg(F.count("*").alias("n")).select("*", safe(F.col("status") == 422).alias("retry"), safe(F.col("status").between(400, 499)).alias("harmless"))


@R.query("SELECT doc_id, CAST(coalesce(e, c, 0.62) AS DOUBLE) AS theta, (n_chars % 100) / 100.0 >= coalesce(e, c, 0.62) AS shown FROM (SELECT doc_id, n_chars, CASE WHEN doc_id % 3 = 0 THEN 0.5 END AS e, CASE WHEN doc_id % 2 = 0 THEN 0.7 END AS c FROM documents)")
def threshold_precedence(t):
    """A threshold from the environment before the one configured before the default."""
    theta = F.coalesce(F.when(F.col("doc_id") % 3 == 0, 0.5), F.when(F.col("doc_id") % 2 == 0, 0.7), F.lit(0.62))
    return t.documents.select("doc_id", theta.alias("theta"), ((F.col("n_chars") % 100) / 100.0 >= theta).alias("shown"))


#: System calls of processes: some outside of the roots, some failing, some on devices.
_CALLS = """SELECT event_id, user_id % 10 AS pid, ['openat', 'unlink', 'stat', 'rename', 'chdir', 'getcwd', 'ioctl'][event_id % 7 + 1] AS syscall, ['/data/a', '/tmp/x', '/dev/null', '/database/b', 'rel', '/data'][event_id % 6 + 1] AS path, ['O_RDONLY', 'O_WRONLY|O_CREAT'][event_id % 2 + 1] AS flags, ['0', '-1 EACCES (denied)', '-1 EIO', '3'][event_id % 4 + 1] AS rc FROM events"""
_IN = "(full_path = '/data' OR starts_with(full_path, '/data/'))"
_BAD = "CASE WHEN starts_with(rc, '-1') AND split_part(rc, ' ', 2) IN ('EACCES', 'ENOENT', 'EPERM', 'EROFS', 'EEXIST') THEN 'FAILED_WRITE_ATTEMPT' ELSE 'VIOLATION' END"


@R.query(
    f"""WITH c AS (SELECT *, CASE WHEN starts_with(path, '/') THEN path ELSE coalesce(last_value(CASE WHEN syscall = 'chdir' AND rc = '0' AND starts_with(path, '/') THEN path END IGNORE NULLS) OVER (PARTITION BY pid ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '/home') || '/' || path END AS full_path FROM ({_CALLS}))
SELECT verdict, syscall, count(*) AS n FROM (SELECT syscall, CASE WHEN syscall = 'getcwd' THEN NULL WHEN syscall = 'chdir' THEN CASE WHEN {_IN} THEN 'ALLOW_IN_ROOT' ELSE 'CWD_NAVIGATION_OUTSIDE' END WHEN syscall = 'openat' THEN CASE WHEN path = '/dev/null' THEN 'ALLOW_DEVICE_NODE' WHEN {_IN} THEN 'ALLOW_IN_ROOT' WHEN flags <> 'O_RDONLY' THEN {_BAD} ELSE 'ALLOW_READONLY_OUTSIDE' END
WHEN syscall = 'stat' THEN CASE WHEN {_IN} THEN 'ALLOW_IN_ROOT' ELSE 'ALLOW_READONLY_OUTSIDE' END WHEN syscall IN ('unlink', 'rename') THEN CASE WHEN {_IN} THEN 'ALLOW_IN_ROOT' ELSE {_BAD} END WHEN {_IN} THEN 'ALLOW_IN_ROOT' ELSE 'UNCLASSIFIED' END AS verdict FROM c) WHERE verdict IS NOT NULL GROUP BY ALL"""
)
def path_verdicts(t):
    """Each call against the allowed roots, relative paths under the folder its process last went to; tallied by verdict."""
    calls = t.events.select("event_id", (F.col("user_id") % 10).alias("pid"), _pick("event_id", "openat", "unlink", "stat", "rename", "chdir", "getcwd", "ioctl").alias("syscall"), _pick("event_id", "/data/a", "/tmp/x", "/dev/null", "/database/b", "rel", "/data").alias("path"), _pick("event_id", "O_RDONLY", "O_WRONLY|O_CREAT").alias("flags"), _pick("event_id", "0", "-1 EACCES (denied)", "-1 EIO", "3").alias("rc"))
    return O.call_verdicts(calls, ["/data"], "/home").filter("verdict is not null").groupBy("verdict", "syscall").agg(F.count("*").alias("n"))


@R.query("SELECT doc_id, len(regexp_extract_all(line, '\"((?:[^\"\\\\]|\\\\.)*)\"', 1)) AS quoted, regexp_extract(line, '<([^<>]*)>', 1) AS descriptor FROM (SELECT doc_id, 'openat(3</a/' || doc_id || '>, \"' || source || '\", \"q\\\"' || lang || '\")' AS line FROM documents)")
def quoted_parts(t):
    """What stands in quotes, an escaped quote within, and the path behind a descriptor."""
    line = F.concat(F.lit("openat(3</a/"), F.col("doc_id").cast("string"), F.lit('>, "'), "source", F.lit('", "q\\"'), "lang", F.lit('")'))
    return t.documents.select("doc_id", F.size(F.regexp_extract_all(line, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))).cast("long").alias("quoted"), F.regexp_extract(line, "<([^<>]*)>", 1).alias("descriptor"))


_LOGS = ("skipping item (n=0)", "only 2 rounds < min 3", "filtered out by model: noise", "empty intent, skipping", "all fine", "filtered out by model: x | skipping item (n=1)")


@R.query(f"SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'passed' WHEN regexp_matches(line, 'skipping item \\(n=[0-9]+\\)|only [0-9]+ rounds < min [0-9]+') THEN 'structural' WHEN regexp_matches(line, 'filtered out by model: ?|empty (intent|approach), skipping') THEN 'semantic' ELSE 'other' END AS outcome FROM (SELECT doc_id, substr('0123456789' || {list(_LOGS)!r}[doc_id % 6 + 1] || 'later', 11, length({list(_LOGS)!r}[doc_id % 6 + 1])) AS line FROM documents)")
def log_outcomes(t):
    """A window of a log, by its bytes: what was produced wins, then structural reasons, then semantic ones."""
    log = _pick("doc_id", *_LOGS)
    whole = F.encode(F.concat(F.lit("0123456789"), log, F.lit("later")), "UTF-8")
    line = F.decode(F.substring(whole, F.lit(11), F.octet_length(log)), "UTF-8")
    return t.documents.select("doc_id", O.log_outcome(F.col("doc_id") % 4 == 0, line).alias("outcome"))


_ITEMS = (">f+++++++++ a/b c.txt", "cd+++++++++ a/", ".d..t...... ./", ".f...p..... a/d", ">f..t...... e", "")


@R.query(f"SELECT kind, count(*) AS n, min(path) AS first FROM (SELECT CASE WHEN l = '' THEN 'blank' WHEN starts_with(l, '>f') THEN CASE WHEN contains(l, ' ') THEN 'sent' ELSE 'unknown' END WHEN starts_with(l, 'cd') OR starts_with(l, '.d') OR starts_with(l, '.f') THEN 'other' ELSE 'unknown' END AS kind, CASE WHEN starts_with(l, '>f') THEN substr(l, strpos(l, ' ') + 1) END AS path FROM (SELECT {list(_ITEMS)!r}[doc_id % 6 + 1] AS l FROM documents)) GROUP BY kind")
def itemize_lines(t):
    """Lines of a transfer's listing; an unknown one fails the whole listing."""
    rows = O.itemized(t.documents.select(_pick("doc_id", *_ITEMS).alias("line")), "line")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.min("path").alias("first"))


@R.query(
    """WITH m AS (SELECT doc_id, '<!-- entry:e' || doc_id || ' -->' || chr(10) || '**session_id**: s' || doc_id % 50 || chr(10) || 'body <!-- /entry:e' || doc_id || ' -->' || CASE WHEN doc_id % 3 = 0 THEN '<!-- entry:open -->' || chr(10) || '**session_id**: s1' ELSE '' END AS md FROM documents)
SELECT session, count(*) AS entries, min(entry) AS first FROM (SELECT 's' || doc_id % 50 AS session, 'e' || doc_id AS entry FROM m) GROUP BY session"""
)
def entry_blocks(t):
    """Entries between matching marks, each under the session named inside it; an open mark makes no entry."""
    d = F.col("doc_id").cast("string")
    block = F.concat(F.lit("<!-- entry:e"), d, F.lit(" -->\n**session_id**: s"), (F.col("doc_id") % 50).cast("string"), F.lit("\nbody <!-- /entry:e"), d, F.lit(" -->"))
    md = F.concat(block, F.when(F.col("doc_id") % 3 == 0, "<!-- entry:open -->\n**session_id**: s1").otherwise(""))
    return O.blocks(t.documents.select(md.alias("md")), "md").groupBy("session").agg(F.count("*").alias("entries"), F.min("entry").alias("first"))


@R.query("WITH l AS (SELECT doc_id AS name, sha256(text) AS h FROM documents WHERE doc_id % 6 <> 0), d AS (SELECT doc_id AS name, CASE WHEN doc_id % 10 = 3 THEN sha256('x') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 7 <> 0) SELECT coalesce(l.name, d.name) AS name, CASE WHEN d.name IS NULL THEN 'missing' WHEN l.name IS NULL THEN 'unlisted' ELSE 'changed' END AS problem FROM l FULL JOIN d ON l.name = d.name WHERE l.name IS NULL OR d.name IS NULL OR l.h <> d.h")
def hash_sidecars(t):
    """Listed files against those on disk, in both directions."""
    rows = t.documents.select(F.col("doc_id").alias("name"), F.sha2("text", 256).alias("h"))
    disk = rows.filter("name % 7 <> 0").withColumn("h", F.when(F.col("name") % 10 == 3, F.sha2(F.lit("x"), 256)).otherwise(F.col("h")))
    return O.two_way(rows.filter("name % 6 <> 0"), disk, "name", "h")


_NAMES = ("backup-0001", "backup-12", "backup-0003.tmp", "other", "backup-0040")


@R.query(f"SELECT name, regexp_full_match(name, 'backup-[0-9]{{4}}') AS valid, CASE WHEN regexp_full_match(name, 'backup-[0-9]{{4}}') THEN CAST(substr(name, 8) AS BIGINT) END AS generation, count(*) AS n, regexp_matches(name, '^other') AS legacy FROM (SELECT {list(_NAMES)!r}[doc_id % 5 + 1] AS name FROM documents) GROUP BY name")
def published_names(t):
    """Names of published backups: those of the right form with their generation; odd and legacy ones are told apart."""
    rows = t.documents.select(_pick("doc_id", *_NAMES).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    valid = F.col("name").rlike(r"^backup-[0-9]{4}\z")
    return rows.select("name", valid.alias("valid"), F.when(valid, F.expr("try_cast(substr(name, 8) as bigint)")).alias("generation"), "n", F.col("name").rlike("^other").alias("legacy"))


_CENSUS = "SELECT n_name AS name, ['12', 'READ_FAILED', '-1', '30', 'EXEMPT'][n_nationkey % 5 + 1] AS prev, CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE ['12', '9', '30', 'READ_FAILED'][n_nationkey % 4 + 1] END AS cur FROM nation"


@R.query(f"SELECT name, CASE WHEN prev = 'EXEMPT' THEN 'exempt' WHEN TRY_CAST(prev AS BIGINT) IS NULL OR TRY_CAST(prev AS BIGINT) < 0 THEN 'poisoned' WHEN cur IS NULL THEN 'disappeared' WHEN TRY_CAST(cur AS BIGINT) IS NULL THEN 'unreadable' WHEN TRY_CAST(cur AS BIGINT) < TRY_CAST(prev AS BIGINT) THEN 'shrunk' ELSE 'ok' END AS verdict FROM ({_CENSUS})")
def census_verdicts(t):
    """Counts or marks of a former census against the present one; a mark for a number poisons the baseline, marks never compare."""
    rows = t.nation.select(F.col("n_name").alias("name"), _pick("n_nationkey", "12", "READ_FAILED", "-1", "30", "EXEMPT").alias("prev"), F.when(F.col("n_nationkey") % 6 != 5, _pick("n_nationkey", "12", "9", "30", "READ_FAILED")).alias("cur"))
    return rows.select("name", O.census_verdict(F.col("prev"), F.col("cur")).alias("verdict"))


@R.query(f"SELECT bool_and(name IN (SELECT n_name FROM nation)) AND count(*) = 25 AS required, count(*) FILTER (WHERE TRY_CAST(cur AS BIGINT) IS NOT NULL) > 0 AS nonempty, sha256(string_agg(name || '/' || coalesce(cur, ''), chr(10) ORDER BY name)) AS fingerprint FROM ({_CENSUS})")
def gate_composition(t):
    """Legs of a gate on one row: the needed objects are there, something was counted, and a fingerprint of it all."""
    rows = t.nation.select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 6 != 5, _pick("n_nationkey", "12", "9", "30", "READ_FAILED")).alias("cur"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", F.concat("name", F.lit("/"), F.coalesce("cur", F.lit(""))).alias("l")))), lambda x: x["l"]), "\n")
    return rows.agg((F.count("*") == 25).alias("required"), (F.count_if(F.expr("try_cast(cur as bigint)").isNotNull()) > 0).alias("nonempty"), F.sha2(text, 256).alias("fingerprint"))


@R.query("SELECT mark, CASE WHEN regexp_full_match(mark, '[0-9]+') THEN CAST(mark AS BIGINT) END AS value, count(*) AS n FROM (SELECT ['7', '007', '1 2', '-3', '', '12x'][event_id % 6 + 1] AS mark FROM events) GROUP BY mark")
def watermark_parse(t):
    """A number only if the whole text is digits."""
    rows = t.events.select(_pick("event_id", "7", "007", "1 2", "-3", "", "12x").alias("mark")).groupBy("mark").agg(F.count("*").alias("n"))
    return rows.select("mark", F.when(F.col("mark").rlike(r"^[0-9]+\z"), F.expr("try_cast(mark as bigint)")).alias("value"), "n")


@R.query(
    """WITH m AS (SELECT doc_id, sha256(text) AS h, octet_length(encode(text)) AS size, CASE doc_id % 8 WHEN 0 THEN '../' || sha256(text) WHEN 1 THEN 'blobs/sha256/' || substr(sha256('y'), 1, 2) || '/' || sha256(text) || '.raw' WHEN 2 THEN 'blobs/sha256/' || substr(sha256(text), 1, 2) || '/' || sha256('z') || '.raw' ELSE 'blobs/sha256/' || substr(sha256(text), 1, 2) || '/' || sha256(text) || '.raw' END AS path,
CASE WHEN doc_id % 8 = 3 THEN 1 ELSE octet_length(encode(text)) END AS said FROM documents), p AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 8 <> 4)
SELECT doc_id, CASE WHEN NOT regexp_full_match(path, 'blobs/sha256/[0-9a-f]{2}/[0-9a-f]{64}\\.raw') THEN 'shape' WHEN substr(path, 17, 64) <> m.h THEN 'name' WHEN substr(path, 14, 2) <> substr(m.h, 1, 2) THEN 'folder' WHEN p.h IS NULL THEN 'missing' WHEN said <> size THEN 'size' ELSE 'ok' END AS verdict, 'blobs/sha256/' || substr(m.h, 1, 2) || '/' || m.h || '.raw' AS own_path FROM m LEFT JOIN p ON m.h = p.h"""
)
def publish_check(t):
    """Manifests before they are published: form of the path, name and folder against the hash, blob and size. Where a blob
    lies follows from its hash alone."""
    docs = t.documents.select("doc_id", F.sha2("text", 256).alias("h"), F.octet_length("text").alias("size"))
    at = lambda folder, name: F.concat(F.lit("blobs/sha256/"), F.substring(folder, 1, 2), F.lit("/"), name, F.lit(".raw"))
    d, other = F.col("doc_id") % 8, lambda x: F.sha2(F.lit(x), 256)
    path = F.when(d == 0, F.concat(F.lit("../"), "h")).when(d == 1, at(other("y"), F.col("h"))).when(d == 2, at(F.col("h"), other("z"))).otherwise(at(F.col("h"), F.col("h")))
    rows = docs.select("doc_id", "h", "size", path.alias("path"), F.when(d == 3, 1).otherwise(F.col("size")).alias("said"))
    return O.publishable(rows, docs.filter("doc_id % 8 <> 4").select("h").distinct()).select("doc_id", "verdict", at(F.col("h"), F.col("h")).alias("own_path"))


@R.query("""SELECT form, coalesce(json_type(j, '$.s.files') IN ('UBIGINT', 'BIGINT') AND json_type(j, '$.s.bytes') IN ('UBIGINT', 'BIGINT') AND json_type(j, '$.status') = 'VARCHAR', false) AS trusted, coalesce(TRY_CAST(j ->> '$.s.files' AS BIGINT) > 0, false) AS verified, count(*) AS n FROM (SELECT event_id % 5 AS form, ['{"status":"ok","s":{"files":3,"bytes":9}}', '{"status":"ok","s":{"files":true,"bytes":9}}', '{"status":"ok","s":{"files":3}}', '{"status":"ok","s":{"files":0,"bytes":0}}', '{"s":{"files":"3","bytes":9}}'][event_id % 5 + 1] AS j FROM events) GROUP BY ALL""")
def doctor_summary(t):
    """Every counter there and a whole number; a flag or a text for one isn't trusted."""
    rows = t.events.select((F.col("event_id") % 5).alias("form"), _pick("event_id", '{"status":"ok","s":{"files":3,"bytes":9}}', '{"status":"ok","s":{"files":true,"bytes":9}}', '{"status":"ok","s":{"files":3}}', '{"status":"ok","s":{"files":0,"bytes":0}}', '{"s":{"files":"3","bytes":9}}').alias("j"))
    v = F.try_parse_json("j")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    trusted = (kind("$.s.files") == "BIGINT") & (kind("$.s.bytes") == "BIGINT") & (kind("$.status") == "STRING")
    verified = F.try_variant_get(v, "$.s.files", "bigint") > 0
    return rows.groupBy("form", F.coalesce(trusted, F.lit(False)).alias("trusted"), F.coalesce(verified & (kind("$.s.files") != "BOOLEAN"), F.lit(False)).alias("verified")).agg(F.count("*").alias("n"))


@R.query("WITH s AS (SELECT c_custkey AS path, c_nationkey AS size FROM customer WHERE c_custkey % 3 <> 0), x AS (SELECT c_custkey AS path, c_nationkey + 100 AS size FROM customer WHERE c_custkey % 4 = 0) SELECT coalesce(x.path, s.path) AS path, coalesce(x.size, s.size) AS size, x.path IS NOT NULL AS sent FROM s FULL JOIN x ON s.path = x.path")
def inventory_update(t):
    """What was transferred overwrites its record, all else is carried over."""
    state = t.customer.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("path"), F.col("c_nationkey").alias("size"))
    sent = t.customer.filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("path"), (F.col("c_nationkey") + 100).alias("new"))
    return state.join(sent, "path", "full_outer").select("path", F.coalesce("new", "size").alias("size"), F.col("new").isNotNull().alias("sent"))


_SUBS = ("plain.txt", "s[1].jsonl", "back\\2[x].j", "what?*", "back\\only", "]close")


@R.query(f"SELECT path, CASE WHEN regexp_matches(path, '[*?\\[]') THEN regexp_replace(replace(path, '\\', '\\\\'), '([*?\\[\\]])', '[\\1]', 'g') ELSE path END AS pattern, count(*) AS n FROM (SELECT ['plain.txt', 's[1].jsonl', 'back\\2[x].j', 'what?*', 'back\\only', ']close'][doc_id % 6 + 1] AS path FROM documents) GROUP BY path")
def glob_escape(t):
    """Paths as patterns that match themselves only."""
    rows = t.documents.select(_pick("doc_id", *_SUBS).alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    return rows.select("path", T.glob_literal(F.col("path")).alias("pattern"), "n")


@R.query("SELECT alias, root, path, sub, broken, count(*) AS n FROM (SELECT split_part(spec, '=', 1) AS alias, split_part(spec, '=', 2) AS root, rel AS path, CASE WHEN strpos(rel, '/') > 1 AND strpos(rel, '/') < length(rel) THEN substr(rel, strpos(rel, '/') + 1) END AS sub, contains(rel, chr(13)) AS broken FROM (SELECT ['a=/x', 'b=/y/z'][doc_id % 2 + 1] AS spec, ['a/f', 'a', 'a/b/c', '/f', 'a/', 'a/f' || chr(13)][doc_id % 6 + 1] AS rel FROM documents)) GROUP BY ALL")
def root_spec(t):
    """Roots by alias, and relative paths cut at the first slash; line breaks in a path are told."""
    spec = F.str_to_map(_pick("doc_id", "a=/x", "b=/y/z"), F.lit(":"), F.lit("="))
    rel = _pick("doc_id", "a/f", "a", "a/b/c", "/f", "a/", "a/f\r")
    at = F.locate("/", rel)
    sub = F.when((at > 1) & (at < F.length(rel)), F.substring(rel, at + 1, F.length(rel)))
    rows = t.documents.select(F.map_keys(spec)[0].alias("alias"), F.map_values(spec)[0].alias("root"), rel.alias("path"), sub.alias("sub"), F.contains(rel, F.lit("\r")).alias("broken"))
    return rows.groupBy("alias", "root", "path", "sub", "broken").agg(F.count("*").alias("n"))
