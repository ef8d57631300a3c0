"""Secret scans: fixed patterns, and password guess costs for values in credential contexts.

The guess cost of a value is the least sum, over its segmentations, of log10 guesses for each segment: a common word, a
date, a repeat, a keyboard walk or a brute-force span; dynamic programming finds it. A repeat is any span, of whatever length
and at whatever place, that is its shortest unit two or more times; a walk is any span of four or more neighbouring keys, a part
of a longer walk too; a date or a year is one wherever it fits. A value that follows a credential
word and costs at least `threshold` is reported as a span of kind "guess", unless a pattern's span holds it already.

Null texts are read as empty: no spans. Ids may be null or repeat: one row out for each row in. Whole texts are scanned.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import over_texts

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A credential word, a sign or "is" after it, then the value.
CONTEXT = re.compile(
    r"""(?ai:(?:pass(?:word|wd|phrase|code|_?key)?|pwd|pin|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credentials?|auth(?:orization)?|bearer|login)s?)"""
    r"""["']?(?:\s{0,3}[:=]\s{0,3}|\s{1,3}(?:is|was)\s{1,3}|\s{1,3}(?=\S*[0-9]))["']?([^\s"'<>,;]{6,})"""
)
STEMS = ("pass", "pwd", "pin", "secret", "token", "key", "credential", "auth", "bearer", "login")

#: log10 of the guesses from which a value counts as a secret.
THRESHOLD = 8.0

# Common passwords and words in them, most common first.
WORDS = (
    "password 123456 12345678 qwerty abc123 letmein monkey dragon master login princess football baseball welcome shadow sunshine iloveyou "
    "trustno1 admin superman batman michael jordan hunter harley ranger buster soccer hockey killer george charlie andrew thomas robert daniel "
    "jessica ashley nicole summer winter spring autumn monday friday secret access hello flower cheese computer internet server default guest "
    "root user test example changeme love money freedom purple orange yellow silver golden ginger pepper cookie banana apple chocolate coffee "
    "tiger eagle falcon phoenix panther wolf bear lion horse correct battery staple cat dog house home family happy lucky star magic power "
    "matrix ninja pirate king queen prince knight warrior angel heaven diamond thunder storm fire water earth light dark night moon sun red "
    "blue green black white pass word key token user name the and you for with this that one two three four five six seven eight nine ten"
).split()
# Keyboard rows with the place of their first key.
ROWS = (("1234567890-=", 0.0), ("qwertyuiop[]", 0.5), ("asdfghjkl;'", 0.75), ("zxcvbnm,./", 1.25))



class Book:
    """log10 guesses of words, most common first, and of repeated units met before."""

    def __init__(self, words: Iterable[str]):
        self.rank: dict[str, float] = {}
        for w in words:
            self.rank.setdefault(w, math.log10(len(self.rank) + 2))
        self.longest = max(map(len, self.rank), default=0)
        self.units: dict[str, float] = {}

    def unit(self, unit: str) -> float:
        found = self.units.get(unit)
        if found is None:
            found = guess_cost(unit, self)[0]
            if len(unit) <= 64:
                if len(self.units) >= 4096:
                    self.units.clear()
                self.units[unit] = found
        return found


PLAIN = Book(WORDS)


def book(path: str | None) -> Book:
    """The fixed words, then the whole words of a tokenizer's vocabulary, which stand there about by how common they are."""
    if path is None:
        return PLAIN
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model.get("end_of_word_suffix") or ""
    whole = (t.removesuffix(end) for t, _ in sorted(model["vocab"].items(), key=lambda x: x[1]) if t.endswith(end))
    return Book([*WORDS, *(w for w in whole if len(w) >= 3 and w.isascii() and w.isalpha())])


LEET = str.maketrans("4@301!$57", "aaeoiisst")
#: Dates by year or by day first, and years: at one place each of these fits at one length at most.
DATES = tuple(
    (re.compile(form, re.A), cost)
    for form, cost in (
        (r"(?:19|20)\d\d([-/._ ]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])", math.log10(365 * 150)),
        (r"(?:0[1-9]|[12]\d|3[01])([-/._ ]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d", math.log10(365 * 150)),
        (r"(?:19|20)\d\d", math.log10(150)),
    )
)
#: Keys of a walk at least, log10 of where it may start, and of what each turn costs.
WALK, WALK_START, WALK_TURN = 4, math.log10(47), math.log10(8)
KEYS = {c: (i + at, y) for y, (row, at) in enumerate(ROWS) for i, c in enumerate(row)}
#: log10 guesses for starting another segment: an attacker must also find how segments join.
JOIN = 0.5


def _card(c: str) -> float:
    """log10 of the size of a character's class."""
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() and c.isascii() else math.log10(33) if c.isascii() else 2.0


def _near(a: str, b: str) -> bool:
    if a not in KEYS or b not in KEYS:
        return False
    (x, y), (u, v) = KEYS[a], KEYS[b]
    return a != b and abs(y - v) <= 1 and abs(x - u) <= 1.0


def _lower(value: str) -> str:
    """Lower case with every character at its place."""
    low = value.lower()
    return low if len(low) == len(value) else "".join(x if len(x := c.lower()) == 1 else c for c in value)


def _ranks(points: np.ndarray) -> list[np.ndarray]:
    """For each power of two the rank of the span of that length at each place (cut at the end), equal for equal spans."""
    levels, step = [np.unique(points, return_inverse=True)[1].astype(np.int64)], 1
    while step < len(points):
        now = levels[-1]
        after = np.concatenate([now[step:] + 1, np.zeros(min(step, len(now)), np.int64)])
        levels.append(np.unique(now * (len(now) + 1) + after, return_inverse=True)[1])
        step *= 2
    return levels


def _alike(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """How many characters agree from places i and j on, or, back, before them; i < j."""
    n, found = len(levels[0]), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = (i - found - (1 << k), j - found - (1 << k)) if back else (i + found, j + found)
        fits = np.flatnonzero((a >= 0) & (b + (1 << k) <= n))
        same = fits[levels[k][a[fits]] == levels[k][b[fits]]]
        found[same] += 1 << k
    return found


def _runs(low: str) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) of the maximal spans that repeat a unit at least twice; the unit is itself no repeat.

    Each such run has a place whose longest Lyndon word, in the alphabet's order or its reverse, is one of its units: so at
    most two candidates a place, each extended to both sides by ranks of spans. Work grows like n log(n)**2.
    """
    points, n = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64), len(low)
    if n < 2:
        return
    runs: set[tuple[int, int, int]] = set()
    for turn in (1, -1):
        levels = _ranks(turn * points)
        order, smaller, waiting = levels[-1].tolist(), [n] * n, []
        for i in range(n - 1, -1, -1):  # the next suffix that sorts before: where the longest Lyndon word at i ends
            while waiting and order[waiting[-1]] > order[i]:
                waiting.pop()
            if waiting:
                smaller[i] = waiting[-1]
            waiting.append(i)
        i, j = np.arange(n), np.array(smaller)
        i, j = i[j < n], j[j < n]
        end, start = j + _alike(levels, i, j), i - _alike(levels, i, j, back=True)
        period = j - i
        own = end - start >= np.where(period == 1, 3, 2 * period)
        runs.update(zip(period[own].tolist(), start[own].tolist(), end[own].tolist(), strict=True))
    yield from sorted(runs)


def _times(p: int) -> int:
    """How many times a unit makes a repeat: twice, and three characters."""
    return 3 if p == 1 else 2


def _repeats(low: str, book: Book) -> Iterator[tuple[int, int, float, str]]:
    """All repeats; their number can grow with the square of the length, so guess_cost goes by runs."""
    for p, start, end in _runs(low):
        for i in range(start, end - _times(p) * p + 1):
            for j in range(i + _times(p) * p, end + 1, p):
                yield i, j, book.unit(low[i : i + p]) + math.log10((j - i) // p + 1), "repeat"


def _walks(low: str) -> Iterator[tuple[int, int, list[int]]]:
    """(start, end, turns) of the longest walks; turns[k] counts those up to the walk's k-th key, the first two have none."""
    n, i = len(low), 0
    while i < n:
        j, turns = i + 1, [0, 0]
        while j < n and _near(low[j - 1], low[j]):
            if j >= i + 2:
                turns.append(turns[-1] + ((KEYS[low[j]][0] - KEYS[low[j - 1]][0]) * (KEYS[low[j - 1]][0] - KEYS[low[j - 2]][0]) <= 0))
            j += 1
        if j - i >= WALK:
            yield i, j, turns
        i = j


class Starts:
    """Open starts of a span whose cost is what stands before it and the logarithm of its length in some unit.

    An earlier start that is no dearer at one end stays so at all later ones, so later starts can go.
    """

    def __init__(self):
        self.open: list[tuple[int, float]] = []

    def least(self, start: int, before: float, weigh) -> tuple[float, int]:
        """Open another start; the least cost at this end, weigh(start) being the logarithm."""
        self.open.append((start, before))
        left, least = [], (math.inf, 0)
        for i, cost in self.open:
            if (here := cost + weigh(i)) < least[0]:
                left.append((i, cost))
                least = (here, i)
        self.open = left
        return least


def _segments(value: str, book: Book = PLAIN, repeats: bool = True) -> list[tuple[int, int, float, str]]:
    """(start, end, log10 guesses, kind) of words and dates, and repeats unless they are left out."""
    low = _lower(value)
    plain, n, found = low.translate(LEET), len(value), []
    for form, extra in ((low, 0.0), (plain, 0.5)) if plain != low else ((low, 0.0),):
        for i in range(n):
            for j in range(i + 3, min(n, i + book.longest) + 1):
                if (cost := book.rank.get(form[i:j])) is not None:
                    upper = sum(c.isupper() for c in value[i:j])
                    found.append((i, j, cost + extra + (0.3 if upper in (1, j - i) else 0.0 if not upper else 1.0), "word"))
    for i in range(n):
        for form, cost in DATES:
            if m := form.match(value, i):
                found.append((i, m.end(), cost, "date"))
    if repeats:
        found += _repeats(low, book)
    return found


def guess_cost(value: str, book: Book = PLAIN) -> tuple[float, list[str]]:
    """The least log10 guesses, and the kinds of the segments that give it."""
    n = len(value)
    ending: list[list[tuple[int, float, str]]] = [[] for _ in range(n + 1)]
    for i, j, cost, kind in _segments(value, book, repeats=False):
        ending[j].append((i, cost, kind))
    low = _lower(value)
    opening: dict[int, list[tuple[int, int, int, dict]]] = {}  # runs by where their first repeat ends, with open starts by phase
    for p, start, end in _runs(low):
        opening.setdefault(start + _times(p) * p, []).append((p, start, end, {}))
    walks = iter(_walks(low))
    walk, walking = next(walks, None), Starts()
    running: list[tuple[int, int, int, dict]] = []
    brute = [(math.inf, 0, "")] * (n + 1)  # cost of a prefix that ends inside a brute-force span: cost, where from, how
    done = [(0.0, 0, "")] + [(math.inf, 0, "")] * n
    for j in range(1, n + 1):
        card = _card(value[j - 1])
        brute[j] = min((done[j - 1][0] + (JOIN if j > 1 else 0.0) + card, j - 1, "new"), (brute[j - 1][0] + card, j - 1, "more"))
        done[j] = (brute[j][0], j, "brute")
        for i, cost, kind in ending[j]:
            done[j] = min(done[j], (done[i][0] + (JOIN if i else 0.0) + cost, i, kind))
        running = [r for r in running if j <= r[2]] + opening.get(j, [])
        for p, start, _, phases in running:
            i = j - _times(p) * p
            starts = phases.setdefault((i - start) % p, Starts())
            cost, i = starts.least(i, done[i][0] + (JOIN if i else 0.0) + book.unit(low[i : i + p]), lambda i, j=j, p=p: math.log10((j - i) // p + 1))
            done[j] = min(done[j], (cost, i, "repeat"))
        if walk and j > walk[1]:
            walk, walking = next(walks, None), Starts()
        if walk and walk[0] + WALK <= j:
            start, _, turns = walk  # a walk's turns begin with its third key
            i = j - WALK
            before = done[i][0] + (JOIN if i else 0.0) + WALK_START - turns[i - start + 1] * WALK_TURN
            cost, i = walking.least(i, before, lambda i, j=j: math.log10(j - i))
            done[j] = min(done[j], (cost + turns[j - 1 - start] * WALK_TURN, i, "walk"))
    kinds, j = [], n
    while j > 0:
        _, i, kind = done[j]
        kinds.append(kind)
        if kind == "brute":
            while brute[j][2] == "more":
                j -= 1
            i = j - 1
        j = i
    return done[n][0], kinds[::-1]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, rank of the kind, end as text) in order of start, then kind: the fixed patterns' matches."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


def context_values(text: str, book: Book = PLAIN) -> list[tuple[int, int, float]]:
    """(start, end, log10 guesses) of the values that follow a credential word."""
    low = text.lower()
    if not any(s in low for s in STEMS):
        return []
    return [(m.start(1), m.end(1), guess_cost(m[1].rstrip(".:!?)"), book)[0]) for m in CONTEXT.finditer(text)]


def _outside(values: list[tuple[int, int, float]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, float]]:
    """The values that no base span holds; base in order of start."""
    starts = [s for s, _, _ in base]
    furthest = list(accumulate((e for _, _, e in base), max))
    return [v for v in values if not (at := bisect_right(starts, v[0])) or furthest[at - 1] < v[1]]


def _scan(threshold: float, words_path: str | None):
    def make():
        own = book(words_path)

        def run(x: dict) -> dict:
            out: dict = {k: [] for k in ("_key", "n_assign", "n_access", "n_hex", "n_guess", "max_guess_log10", "base_sha256", "spans")}
            for key, text in zip(x["_key"], x["_text"], strict=True):
                base, values = base_spans(text), context_values(text, own)
                added = [(s, 3, e) for s, e, cost in _outside(values, base) if cost >= threshold]
                say = lambda found: ",".join(f"{(*KINDS, 'guess')[k]}:{s}:{e}" for s, k, e in found)
                kinds = [k for _, k, _ in base]
                out["_key"].append(key)
                for k, name in enumerate(KINDS):
                    out[f"n_{name}"].append(kinds.count(k))
                out["n_guess"].append(len(added))
                out["max_guess_log10"].append(max((c for _, _, c in values), default=None))
                out["base_sha256"].append(hashlib.sha256(say(base).encode()).hexdigest())
                out["spans"].append(say(sorted(base + added)))
            return out

        return run

    return make


def scan_secrets(docs: DataFrame, threshold: float = THRESHOLD, words_path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of docs: key, n_assign, n_access, n_hex, base_sha256, spans, n_guess, max_guess_log10.

    Spans are kind:start:end in code points, the end exclusive, by start, then assign, access, hex, guess. words_path: a tokenizer's file
    whose whole words join the dictionary.
    """
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = "_key bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_guess bigint, max_guess_log10 double"
    return over_texts(rows, _scan(threshold, words_path), schema).withColumnRenamed("_key", key)
