"""Conversation structure repair as a scan of min-plus matrices.

A conversation is well formed if its roles' initials read `(s?(ua)+)?`. A turn is a 4x4 matrix over the states nothing,
system, user and assistant; an element is (cost, audit), the sum is the lesser element and the product adds costs and joins
audits, so a product of matrices holds the cheapest edits of a whole piece from any state to any other. Inserts are closed
over on both sides of each turn. Two audits of one piece and one cost are never one the other's beginning, so the lesser of
two stays the lesser whatever follows, and the product is associative: turns are dealt out by range of (conversation,
turn), pieces of at most PIECE turns are multiplied in their tasks, and a tree of Spark rounds with at most FAN pieces to a
group joins the pieces of a conversation that reaches over several tasks.

The first fault of a turn counts: blank (nothing but white space), duplicate (role and text seen earlier in the
conversation), truncated (its last character that isn't white space ends no sentence). Edits: K keeps (0), R sets the role
user or assistant (1), D deletes (2, a must for blank and duplicate turns), I inserts an empty user or assistant turn (5); a
truncated turn that stays adds 5. Equal costs go to the audit that is least in ASCII.

Null roles and texts are read as one space, a null id is a conversation of its own, null turns come first; rows of equal turn
go by the digest of role and text. Roles other than those with initial s, u or a can't stay; an empty role has no initial and can't
either. A conversation without rows (all of them absent) has zeros, an empty audit and the digest of the empty string.

The repaired text's digest is a chain of SHA-256, so one task reads a conversation's texts in order, a batch at a time; all else
of a long conversation is spread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import dropped, over_texts, written

#: Turns of a piece, and pieces that one group of a round joins.
PIECE, FAN = 4096, 32
# The costs of edits and the pairs of initials that may follow one another.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LEGAL = ("su", "ua", "au")

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_SPACE = " \t\n\x0b\x0c\r"

Matrix = tuple  # 16 elements, row by row: (cost, audit) or None


def _least(found: dict, at: int, element: tuple) -> None:
    if at not in found or element < found[at]:
        found[at] = element


def product(left: Matrix, right: Matrix) -> Matrix:
    """The cheapest edits of two pieces in turn."""
    found: dict[int, tuple] = {}
    for i in range(16):
        if left[i] is not None:
            (cost, audit), start, middle = left[i], i & 12, (i & 3) * 4
            for end in range(4):
                if (then := right[middle + end]) is not None:
                    _least(found, start + end, (cost + then[0], audit + then[1]))
    return tuple(map(found.get, range(16)))


def _closure() -> Matrix:
    """Any number of inserts; a third never helps."""
    steps = {s * 4 + s: (0, "") for s in range(4)}
    once = {s * 4 + USER: (INSERT, "I") for s in (NOTHING, SYSTEM, ASSISTANT)} | {USER * 4 + ASSISTANT: (INSERT, "I")}
    one = tuple(map((steps | once).get, range(16)))
    return product(one, one)


INSERTS = _closure()
#: Initials as letters of a turn's code; anything else is "o". Upper case: truncated; "-": it must go.
INITIALS = "sua"


@lru_cache(maxsize=None)
def turn_matrix(code: str) -> Matrix:
    """A turn with inserts on both sides; code is "-" or an initial, in upper case if the turn is truncated."""
    found: dict[int, tuple] = {s * 4 + s: (DELETE, "D") for s in range(4)}
    if code != "-":
        more, initial = TRUNCATED if code.isupper() else 0, code.lower()
        for start in (NOTHING, SYSTEM, ASSISTANT):
            _least(found, start * 4 + USER, (KEEP + more, "K") if initial == "u" else (REROLE + more, "R"))
        _least(found, USER * 4 + ASSISTANT, (KEEP + more, "K") if initial == "a" else (REROLE + more, "R"))
        if initial == "s":
            _least(found, NOTHING * 4 + SYSTEM, (KEEP + more, "K"))
    return product(product(INSERTS, tuple(map(found.get, range(16)))), INSERTS)


@lru_cache(maxsize=1 << 14)
def _short(codes: str) -> Matrix:
    if not codes:
        return INSERTS
    if len(codes) == 1:
        return turn_matrix(codes)
    half = len(codes) // 2
    return product(_short(codes[:half]), _short(codes[half:]))


def piece_matrix(codes: str) -> Matrix:
    """The product over a piece, as a tree; runs of eight turns are looked up."""
    level = [_short(codes[i : i + 8]) for i in range(0, len(codes), 8)] or [INSERTS]
    while len(level) > 1:
        level = [product(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def cheapest(matrix: Matrix) -> tuple[int, str]:
    """The least edits that end well: in nothing, or after an assistant."""
    return min(e for e in (matrix[NOTHING * 4 + NOTHING], matrix[NOTHING * 4 + ASSISTANT]) if e is not None)


#: What pieces add up: counts of faults and of illegal neighbours, the range of turns and how many there are, and the ends' initials.
_SUMS = ("blank", "duplicate", "truncated", "illegal", "turns")


def _joined(a: dict, b: dict) -> dict:
    """Two pieces of a conversation in order."""
    if not a["n"] or not b["n"]:
        return b if not a["n"] else a
    out = {k: a[k] + b[k] for k in ("n", *_SUMS)} | {"first": a["first"], "last": b["last"]}
    out["illegal"] += a["last"] + b["first"] not in LEGAL
    out["turns"] -= a["hi"] is not None and a["hi"] == b["lo"]
    out["lo"], out["hi"] = (b["lo"] if a["lo"] is None else a["lo"]), (a["hi"] if b["hi"] is None else b["hi"])
    out["matrix"] = product(a["matrix"], b["matrix"])
    return out


def summary(rows: list[tuple[int | None, str, str, bool]]) -> dict:
    """A piece's rows (turn, initial, fault, seen earlier) in order."""
    codes, faults, turns = [], {"blank": 0, "duplicate": 0, "truncated": 0}, [t for t, *_ in rows if t is not None]
    for _, initial, fault, seen in rows:
        fault = "duplicate" if seen and fault != "blank" else fault
        if fault:
            faults[fault] += 1
        codes.append("-" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
    initials = [r[1] for r in rows]
    return faults | {
        "n": len(rows), "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)), "turns": len(set(turns)),
        "lo": turns[0] if turns else None, "hi": turns[-1] if turns else None, "first": initials[0] if rows else "", "last": initials[-1] if rows else "",
        "matrix": piece_matrix("".join(codes)),
    }


_STATE = "n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, lo bigint, hi bigint, first string, last string, costs array<bigint>, audits array<string>"
_FIELDS = [f.split()[0] for f in _STATE.split(", ")]


def _packed(s: dict) -> dict:
    return s | {"costs": [e and e[0] for e in s["matrix"]], "audits": [e and e[1] for e in s["matrix"]]}


def _unpacked(s: dict) -> dict:
    return s | {"matrix": tuple(None if c is None else (c, a) for c, a in zip(s["costs"], s["audits"], strict=True))}


def _pieces_made() -> Callable[[dict], dict]:
    def run(x: dict) -> dict:
        out: dict = {k: [] for k in ("conv", "place", *_FIELDS)}
        for conv, place, rows in zip(x["conv"], x["place"], x["rows"], strict=True):
            firsts = {r["at"] for r in rows if r["initial"] is None}
            own = sorted((r for r in rows if r["initial"] is not None and r["initial"] != "absent"), key=lambda r: r["at"])
            made = _packed(summary([(r["turn"], r["initial"], r["fault"], r["at"] not in firsts) for r in own]))
            for k, v in (made | {"conv": conv, "place": place}).items():
                if k in out:
                    out[k].append(v)
        return out

    return run


def _pieces_joined() -> Callable[[dict], dict]:
    def run(x: dict) -> dict:
        out: dict = {k: [] for k in ("conv", "place", *_FIELDS)}
        for conv, place, pieces in zip(x["conv"], x["place"], x["pieces"], strict=True):
            made = _packed(reduce(_joined, map(_unpacked, sorted(pieces, key=lambda p: p["at"]))))
            for k, v in (made | {"conv": conv, "place": place}).items():
                if k in out:
                    out[k].append(v)
        return out

    return run


def _reports_made() -> Callable[[dict], dict]:
    def run(x: dict) -> dict:
        best = [cheapest(_unpacked({"costs": c, "audits": a})["matrix"]) for c, a in zip(x["costs"], x["audits"], strict=True)]
        gaps = [hi - lo + 1 - n if n else 0 for lo, hi, n in zip(x["lo"], x["hi"], x["turns"], strict=True)]
        return {k: x[k] for k in ("conv", "blank", "duplicate", "truncated", "illegal")} | {"gaps": gaps, "cost": [c for c, _ in best], "audit": [a for _, a in best]}

    return run


_REPORT = "conv bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


class Editor:
    """Applies an audit to a conversation's turns in order; gives the lines that stand in the repaired one."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NOTHING

    def _next(self) -> str:
        self.state, role = (ASSISTANT, "assistant") if self.state == USER else (USER, "user")
        return role

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._next(), ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "R":
            yield edit, self._next(), text
        elif edit == "K":
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
            yield edit, role, text


#: Kinds of rows in a conversation's stream: its report, its turns, its end.
_HEAD, _TURN, _END = range(3)


def _turns_repaired() -> Callable[[dict], dict]:
    """Over streams in order, the lines of repaired conversations; the state passes from batch to batch of a task."""
    held: dict = {}

    def run(x: dict) -> dict:
        out: dict = {k: [] for k in ("conv", "place", "edit", "role", "text")}
        for kind, conv, audit, role, text in zip(x["kind"], x["conv"], x["audit"], x["role"], x["text"], strict=True):
            if kind == _HEAD:
                held.update(editor=Editor(audit), place=0)
                continue
            for line in held["editor"].inserted() if kind == _END else held["editor"].turn(role, text):
                for k, v in zip(("conv", "place", "edit", "role", "text"), (conv, held["place"], *line), strict=True):
                    out[k].append(v)
                held["place"] += 1
        return out

    return run


def _digests_made() -> Callable[[dict], dict]:
    """Over streams in order, each conversation's digest of its repaired lines."""
    held: dict = {}

    def run(x: dict) -> dict:
        out: dict = {"conv": [], "repaired_sha256": [], **{k: [] for k in _COUNTS}}
        for at, (kind, role, text) in enumerate(zip(x["kind"], x["role"], x["text"], strict=True)):
            if kind == _HEAD:
                held.update(editor=Editor(x["audit"][at]), chain=hashlib.sha256(), joint="", head={k: x[k][at] for k in ("conv", *_COUNTS)})
                continue
            for _, role, text in held["editor"].inserted() if kind == _END else held["editor"].turn(role, text):
                held["chain"].update(f"{held['joint']}{role}:{text}".encode())
                held["joint"] = "\n"
            if kind == _END:
                out["repaired_sha256"].append(held["chain"].hexdigest())
                for k, v in held["head"].items():
                    out[k].append(v)
        return out

    return run


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text and present: every row with nulls as one space, damaged by the CRC-32 of its id and turn.

    Of twenty numbers 0 takes the row away (present is false), 1 empties its text, 2 removes its stops, 3 repeats it, 4 makes it a user's.
    """
    number = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)))) % 20
    rows = turns.select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"), number.cast("int").alias("_number"),
    )
    number = F.col("_number")
    text = F.when(number == 1, "").when(number == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(number == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv", "turn", F.when(number == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (number != 0).alias("present"), F.explode(copies).alias("_copy")).drop("_copy")


def _digest() -> Column:
    """Equal for equal roles and texts only."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def _fault() -> Column:
    last = F.substring(F.rtrim(F.col("text"), F.lit(_SPACE)), -1, 1)
    return F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("")


def _reports(turns: DataFrame) -> DataFrame:
    """One row for each conversation, without its digest; only keys move, no texts."""
    initial = F.substring("role", 1, 1)
    keys = turns.select(
        "conv", "turn", F.when(~F.col("present"), "absent").when(initial.isin(*INITIALS), initial).otherwise("o").alias("initial"),
        _fault().alias("fault"), _digest().alias("digest"), F.monotonically_increasing_id().alias("_tie"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "digest", "_tie")]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_tie")
    keys = written(dealt.withColumn("at", F.monotonically_increasing_id()), "turns")  # the task's number, then the row's within it
    blocks = (keys.agg(F.max(F.col("at").bitwiseAND((1 << 33) - 1))).first()[0] or 0) // PIECE + 1
    place = (F.shiftright("at", 33) * blocks + F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / PIECE)).cast("long").alias("place")
    present = F.col("initial") != "absent"
    firsts = keys.filter(present & (F.col("fault") != "blank")).groupBy("conv", "digest").agg(F.min("at").alias("at"))
    none = F.lit(None).cast("string")
    rows = keys.select("conv", place, F.struct("at", "turn", "initial", "fault").alias("row")).unionByName(
        firsts.select("conv", place, F.struct("at", F.lit(None).cast("long").alias("turn"), none.alias("initial"), none.alias("fault")).alias("row"))
    )
    grouped = rows.groupBy("conv", "place").agg(F.collect_list("row").alias("rows"))  # at most PIECE turns and as many firsts
    pieces = written(over_texts(grouped, _pieces_made, f"conv bigint, place bigint, {_STATE}"), "pieces")
    made = [keys]
    while (pieces.groupBy("conv").count().agg(F.max("count")).first()[0] or 0) > 1:
        groups = pieces.groupBy("conv", F.floor(F.col("place") / FAN).cast("long").alias("up")).agg(F.collect_list(F.struct(F.col("place").alias("at"), *_FIELDS)).alias("pieces"))
        made.append(pieces)
        pieces = written(over_texts(groups.withColumnRenamed("up", "place"), _pieces_joined, f"conv bigint, place bigint, {_STATE}"), "pieces")
    reports = written(over_texts(pieces.drop("place"), _reports_made, _REPORT), "reports")
    dropped(*made, pieces)
    return reports


def _streams(turns: DataFrame, reports: DataFrame) -> DataFrame:
    """Each conversation's report, turns in order and end, in one task; a batch of them is in memory at a time."""
    head = reports.select("conv", F.lit(_HEAD).alias("kind"), *_COUNTS)
    rows = turns.filter("present").select("conv", F.lit(_TURN).alias("kind"), "turn", _digest().alias("digest"), "role", "text")
    end = reports.select("conv", F.lit(_END).alias("kind"))
    whole = head.unionByName(rows, allowMissingColumns=True).unionByName(end, allowMissingColumns=True)
    return whole.repartition("conv").sortWithinPartitions("conv", "kind", F.col("turn").asc_nulls_first(), "digest").drop("turn", "digest")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """conv, place (from 0), edit (K, R or I), role and text of every turn of the repaired conversations.

    turns has conv, turn, role, text (no nulls in the last two) and present; rows that aren't present only name their conversation.
    """
    return over_texts(_streams(turns, _reports(turns)), _turns_repaired, "conv bigint, place bigint, edit string, role string, text string")


def repair(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row for each conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    turns is as for repaired_turns. Gaps are the whole numbers between the least and the greatest turn that no turn has.
    """
    counts = ", ".join(f"{k} {'string' if k == 'audit' else 'bigint'}" for k in _COUNTS)
    out = over_texts(_streams(turns, _reports(turns)), _digests_made, f"conv bigint, {counts}, repaired_sha256 string")
    return out.withColumnRenamed("conv", conv)


def oracle() -> str:
    """DuckDB SQL over conversations: the cheapest edits turn by turn, for each of the four states."""
    return r"""
with recursive numbered as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::bigint, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda ch: unicode(ch)::bigint)),
      lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))) % 20 as k
  from conversations
), damaged as (
  select conv_id, turn, case when k = 4 then 'user' else role end as role,
    case when k = 1 then '' when k = 2 then translate(text, '.!?', '') else text end as text
  from numbered, unnest(case when k = 3 then [1, 2] else [1] end) where k <> 0
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, unhex(sha256(length(role) || ':' || role || text))) as i from damaged
), faulty as (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
      when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
      when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else '' end as fault,
    case when i > 1 and lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) not in ('su', 'ua', 'au') then 1 else 0 end as bad
  from placed
), counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, sum((fault = 'blank')::bigint)::bigint as blank, sum((fault = 'duplicate')::bigint)::bigint as duplicate,
    sum((fault = 'truncated')::bigint)::bigint as truncated, sum(bad)::bigint as illegal, max(i) as n
  from faulty group by conv_id
), walk as (
  select conv_id, 0::bigint as i, {c: 0, a: '', o: []::varchar[]} as p, {c: 1000000000, a: '', o: []::varchar[]} as s,
    {c: 5, a: 'I', o: ['user:']} as u, {c: 10, a: 'II', o: ['user:', 'assistant:']} as v
  from counted
  union all
  select conv_id, i, p, s, list_sort([u, {c: p.c + 5, a: p.a || 'I', o: p.o || ['user:']}, {c: s.c + 5, a: s.a || 'I', o: s.o || ['user:']}, {c: v.c + 5, a: v.a || 'I', o: v.o || ['user:']}])[1],
    list_sort([v, {c: u.c + 5, a: u.a || 'I', o: u.o || ['assistant:']}, {c: p.c + 10, a: p.a || 'II', o: p.o || ['user:', 'assistant:']}, {c: s.c + 10, a: s.a || 'II', o: s.o || ['user:', 'assistant:']}])[1]
  from (
    select w.conv_id, f.i, {c: p.c + 2, a: p.a || 'D', o: p.o} as p,
      list_sort([{c: s.c + 2, a: s.a || 'D', o: s.o}, {c: p.c + stay + case when ini = 's' then 0 else 1000000 end, a: p.a || 'K', o: p.o || [role || ':' || text]}])[1] as s,
      list_sort([{c: u.c + 2, a: u.a || 'D', o: u.o}] || list_transform([p, s, v], lambda x: {c: x.c + stay + (ini <> 'u')::int, a: x.a || case when ini = 'u' then 'K' else 'R' end,
        o: x.o || [case when ini = 'u' then role else 'user' end || ':' || text]}))[1] as u,
      list_sort([{c: v.c + 2, a: v.a || 'D', o: v.o}, {c: u.c + stay + (ini <> 'a')::int, a: u.a || case when ini = 'a' then 'K' else 'R' end,
        o: u.o || [case when ini = 'a' then role else 'assistant' end || ':' || text]}])[1] as v
    from walk w join (select *, left(role, 1) as ini, case fault when '' then 0 when 'truncated' then 5 else 1000000 end as stay from faulty) f
      on w.conv_id is not distinct from f.conv_id and f.i = w.i + 1)
), ended as (
  select w.conv_id, list_sort([w.p, w.v])[1] as best from walk w join counted c on w.conv_id is not distinct from c.conv_id and w.i = c.n
)
select d.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit, sha256(coalesce(array_to_string(best.o, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) d left join counted c on d.conv_id is not distinct from c.conv_id left join ended e on d.conv_id is not distinct from e.conv_id"""
