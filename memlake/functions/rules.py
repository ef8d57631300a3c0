"""Fixed rules on text columns: secret patterns, frontmatter that keeps its identity lines, clamps, names and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIDDEN = "[REDACTED_SECRET]"

# Token formats, applied in this order.
SECRETS = (
    r"""(?i)(?:api[_-]?key|secret|token|password|credential|auth|bearer)[ \t\n\x0B\f\r]*[=:][ \t\n\x0B\f\r]*["']?[A-Za-z0-9_\-/.+]{20,}["']?""",
    r"(?i)Bearer[ \t\n\x0B\f\r]+[A-Za-z0-9._\-+/=]{20,}",
    r"sk-proj-[A-Za-z0-9\-_]{20,}",
    r"(?:sk|pk|rk|ak)-[A-Za-z0-9][A-Za-z0-9\-_]{19,}",
    r"sk-ant-[A-Za-z0-9\-_]{20,}",
    r"gh[pus]_[A-Za-z0-9]{36,}",
    r"github_pat_[A-Za-z0-9_]{22,}",
    r"xoxb-[A-Za-z0-9\-]+",
    r"AKIA[0-9A-Z]{16}",
    r"AIza[A-Za-z0-9\-_]{35}",
    r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    r"npm_[A-Za-z0-9]{36}",
    r"glpat-[A-Za-z0-9\-_]{20,}",
    r"dop_v1_[A-Za-z0-9]{64}",
)
#: Text that no pattern can match without: one cheap test spares most rows the fourteen passes.
HINT = r"(?i)key|secret|token|password|credential|auth|bearer|[spra]k-|gh[pus]_|github_pat_|xoxb-|akia|aiza|eyj|npm_|glpat-|dop_v1_"
#: Frontmatter keys whose lines say who a text is.
IDENTITY = r"^(external_id|source_id|session_key|agent|source|date):[ \t\x0B\f\r]"
#: What the clamp leaves for its marks, and the least it clamps to.
RESERVE, LEAST = 48, 200
#: Characters at which lines end.
BREAKS = r"[\n\x0B\f\r\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def hide_secrets(text: Column) -> Column:
    """Secrets replaced by a mark; doing it twice changes nothing."""
    out = text
    for pattern in SECRETS:
        out = F.regexp_replace(out, pattern, F.lit(HIDDEN))
    return F.when(text.rlike(HINT), out).otherwise(text)


def hide_in_transcript(text: Column) -> Column:
    """Secrets hidden, but for the identity lines of a frontmatter; an unclosed frontmatter stays as it is."""
    end = F.locate("\n---\n", text, 5)
    head, rest = F.substring(text, F.lit(1), end - 1), F.substring(text, end, F.length(text))
    lines = F.transform(F.split(head, "\n"), lambda x: F.when(x.rlike(IDENTITY), x).otherwise(hide_secrets(x)))
    return F.when(~text.startswith("---\n"), hide_secrets(text)).when(end == 0, text).otherwise(F.concat(F.array_join(lines, "\n"), hide_secrets(rest)))


def let(value: Column, then) -> Column:
    """then(value) with the value worked out once: inside a lambda a column would be worked out again for each element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _ends(text: Column, room: int) -> tuple[Column, Column]:
    """Head and tail of `room` characters, two parts to one, the head up to a line's end and the tail from one on where they have one."""
    head, tail = F.substring(text, 1, room * 2 // 3), F.right(text, F.lit(room - room * 2 // 3))
    head = F.when(F.contains(head, F.lit("\n")), F.regexp_replace(head, "[^\n]*\\z", "")).otherwise(head)
    return head, F.when(F.contains(tail, F.lit("\n")), F.substring(tail, F.locate("\n", tail), F.length(tail))).otherwise(tail)


def _mark(cut: Column) -> Column:
    return F.concat(F.lit("...[cut "), cut.cast("string"), F.lit(" characters]"))


def clamp_plain(text: Column, cap: int) -> Column:
    """A text longer than `cap` cut to head and tail at line ends, two parts to one, with a mark of what is missing; never
    longer than the cap, which is at least LEAST. Null becomes empty."""
    cap = max(cap, LEAST)
    head, tail = _ends(text, cap - RESERVE)
    cut = F.length(text) - F.length(head) - F.length(tail)
    return F.when(text.isNull(), "").when(F.length(text) <= cap, text).otherwise(F.concat_ws("\n", head, _mark(cut), tail))


#: Words of lines that a clamp rescues; the longest has nine letters.
ERRORS = ("error", "fail", "traceback", "exception", "panic", "fatal", "assert")
#: How many lines it rescues, the longest line that it keeps whole, and the rest of its room that isn't worth a window.
ERROR_LINES, ERROR_LINE, WORTH = 10, 300, 20


def window(line: Column, at: Column, most) -> Column:
    """A line of at most `most` characters with place `at` (from 0) in its middle, dots where it was cut."""
    return let(F.struct(line.alias("line"), at.alias("at"), F.length(line).alias("n"), (F.lit(most) - 2).cast("int").alias("span")), lambda w: F.when(w["n"] <= w["span"] + 2, w["line"]).otherwise(
        let(F.greatest(F.lit(0), F.least(w["at"] - F.floor(w["span"] / 2).cast("int"), w["n"] - w["span"])), lambda start: F.concat(
            F.when(start > 0, "…").otherwise(""), F.substring(w["line"], start + 1, w["span"]), F.when(start + w["span"] < w["n"], "…").otherwise("")
        ))
    ))


def _cut_lines(middle: Column, head: Column, tail: Column) -> Column:
    """The lines that the middle takes part in, whole, with the place (from 0) of the first error word that doesn't lie in head or tail alone."""
    word = "(?i)" + "|".join(ERRORS)
    before = F.when(F.contains(head, F.lit("\n")), "").otherwise(head)  # the first line may begin in the head, and the last one end in the tail
    after = F.when(F.contains(tail, F.lit("\n")), "").otherwise(tail)

    def across(x: Column, b: Column) -> Column:
        """How far before the middle the first word begins that ends in it."""
        found = F.lit(None).cast("int")
        for d in range(1, max(map(len, ERRORS))):
            long = "|".join(w for w in ERRORS if len(w) > d)
            found = F.when((F.length(b) >= d) & F.concat(F.right(b, F.lit(d)), F.substring(x, 1, 9)).rlike(f"^(?i:{long})"), d).otherwise(found)
        return found

    def lines(m: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            b, a = F.when(i == 0, m["before"]).otherwise(""), F.when(i == m["last"], m["after"]).otherwise("")
            inner = F.regexp_instr(F.concat(x, F.substring(a, 1, 8)), F.lit(word))
            base = F.length(b)
            at = F.coalesce(F.when(i == 0, base - across(F.concat(x, F.substring(a, 1, 8)), b)), F.when((inner > 0) & (inner <= F.length(x)), base + inner - 1))
            return F.struct(F.concat(b, x, a).alias("line"), at.cast("int").alias("at"))

        return F.filter(F.transform(m["parts"], one), lambda x: x["at"].isNotNull())

    parts = let(F.split(middle, "\n"), lambda p: F.struct(p.alias("parts"), (F.size(p) - 1).alias("last"), before.alias("before"), after.alias("after")))
    return let(parts, lines)


def clamp_rescuing(text: Column, cap: int) -> Column:
    """As clamp_plain, with a quarter of the room for lines of the cut part that name an error.

    A line counts if an error word in it doesn't lie in head or tail alone. In order, up to ERROR_LINES of them are kept, each as a window of
    ERROR_LINE characters at most; lines that don't fit are passed over, and what room is left goes to a window into the first of
    these. Never longer than the cap, which is at least LEAST. Null becomes empty.
    """
    cap = max(cap, LEAST)
    room = cap - RESERVE
    spare = room // 4

    def kept(hits: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(spare).alias("spare"), F.lit(None).cast("string").alias("line"), F.lit(None).cast("int").alias("at"))

        def step(s: Column, h: Column) -> Column:
            def put(piece: Column) -> Column:
                fits, first = F.length(piece) < s["spare"], s["at"].isNull()
                missed = ~fits & first
                return F.struct(
                    F.when(fits, F.array_append(s["kept"], piece)).otherwise(s["kept"]).alias("kept"), F.when(fits, s["spare"] - F.length(piece) - 1).otherwise(s["spare"]).alias("spare"),
                    F.when(missed, h["line"]).otherwise(s["line"]).alias("line"), F.when(missed, h["at"]).otherwise(s["at"]).alias("at"),
                )

            return F.when(F.size(s["kept"]) == ERROR_LINES, s).otherwise(let(window(h["line"], h["at"], ERROR_LINE), put))

        def finish(s: Column) -> Column:
            left = s["at"].isNotNull() & (F.size(s["kept"]) < ERROR_LINES) & (s["spare"] > WORTH)
            return F.when(left, F.array_append(s["kept"], window(s["line"], s["at"], s["spare"] - 1))).otherwise(s["kept"])

        return F.aggregate(hits, start, step, finish)

    def clamped(e: Column) -> Column:
        begin, cut = F.length(e["head"]), F.length(e["text"]) - F.length(e["head"]) - F.length(e["tail"])
        lines = kept(_cut_lines(F.substring(e["text"], begin + 1, cut), e["head"], e["tail"]))
        said = let(lines, lambda k: F.when(F.size(k) > 0, F.concat(F.array(F.lit("...[errors]")), k)).otherwise(k))
        return F.array_join(F.concat(F.array(e["head"]), said, F.array(_mark(cut), e["tail"])), "\n")

    head, tail = _ends(text, room - spare)
    whole = F.struct(text.alias("text"), head.alias("head"), tail.alias("tail"))
    return F.when(text.isNull(), "").when(F.length(text) <= cap, text).otherwise(let(whole, clamped))


def entity_slug(kind: Column, name: Column) -> Column:
    """Folder of the kind, then the name: white space as one space, lower case, slashes as dashes."""
    folder = F.when(kind == "person", "people").when(kind == "project", "projects").when(kind == "decision", "decisions").when(kind == "preference", "preferences").otherwise("projects")
    clean = F.replace(F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", ""), r"[ \t\n\x0B\f\r]+", " ")), F.lit("/"), F.lit("-"))
    return F.concat(folder, F.lit("/"), clean)


def safe_name(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("x"))


def session_key(source: Column, agent: Column, external: Column, row: Column) -> Column:
    """A letter and 64 bits of the identity's SHA-256; rows without an external id are named by their row."""
    empty = F.lit("")
    known = F.concat(F.coalesce(source, empty), F.lit("\x00"), F.coalesce(agent, empty), F.lit("\x00"), external)
    legacy = F.concat(F.lit("__legacy_rowid__\x00"), F.coalesce(agent, empty), F.lit("\x00"), row.cast("string"))
    return F.concat(F.lit("s"), F.substring(F.sha2(F.when(F.coalesce(external, empty) != "", known).otherwise(legacy), 256), 1, 16))


def local_date(epoch: Column, hours: int = 8) -> Column:
    """Date of an epoch in seconds or milliseconds at a fixed offset; a sentinel where there is none."""
    seconds = F.when(epoch > 1_000_000_000_000, F.floor(epoch / 1000)).otherwise(epoch)
    return F.when(F.coalesce(epoch, F.lit(0)) == 0, "0000-00-00").otherwise(F.date_format(F.timestamp_seconds(seconds + hours * 3600), "yyyy-MM-dd"))


def glob_literal(path: Column) -> Column:
    """A path as a pattern that matches itself only: as it is without wild cards, else each special character in brackets."""
    escaped = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("\\\\")), r"([*?\[\]])", "[$1]")
    return F.when(path.rlike(r"[*?\[]"), escaped).otherwise(path)
