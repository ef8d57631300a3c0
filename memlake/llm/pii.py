"""Personal data by weak supervision.

Fixed patterns give base spans of kinds email, ip, card and phone; they always stay. Looser patterns give candidate spans.
Labelers of three sorts (format, gazetteer, context) vote for or against each candidate or abstain. Spark counts the
candidates for each cell (kind, votes, shape), a fixed grid of cells; expectation-maximisation over the cells' counts
estimates each labeler's reliability and each cell's probability, a logistic classifier is trained on those
probabilities, and a candidate whose cell it accepts becomes a span.

Counts cover all candidates of all texts; only cells go to the driver, at most CELLS of them.
Null texts are read as empty: no spans. Ids may be null or repeat: one row out for each row in.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import dropped, over_texts, written

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds to, in the order of their spans after the base spans.
MORE = ("email_text", "iban", "name", "national_id", "phone_local", "birth_date", "address")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Gazetteers and cue words.
FIRST_NAMES = set("james mary john patricia robert jennifer michael linda david elizabeth william barbara thomas susan peter anna maria jose juan ana luis carmen hans klaus petra sabine jean marie pierre sophie louis claire paul laura".split())
DOMAINS = set("com org net edu gov io co uk de fr es eu info gmail yahoo hotmail outlook example mail".split())
COUNTRIES = set("AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())

CANDIDATES = {
    "email_text": re.compile(r"\b[A-Za-z0-9._%+-]{2,} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]+)+"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b"),
    "name": re.compile(r"\b(?:" + "|".join(sorted(n.title() for n in FIRST_NAMES)) + r") [A-Z][a-z]{2,}\b|\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|M|Sr|Sra)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?|\b(?:name is|named) [A-Z][a-z]+(?: [A-Z][a-z]+)?"),
    "national_id": re.compile(r"\b[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}\b"),
    "phone_local": re.compile(r"(?<![\w+.])\(?[0-9]{3,5}\)?[ ./-][0-9]{2,4}[ ./-]?[0-9]{3,5}(?![\w])"),
    "birth_date": re.compile(r"(?i:\b(?:born|birth|birthday|dob|geboren|geburtsdatum|née?|naissance|nacid[oa]|nacimiento))\b[^\n0-9]{0,20}((?:[0-9]{1,2}[./-]){2}[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})\b"),
    "address": re.compile(
        r"\b[0-9]{1,5} (?:[A-Z][a-z]+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Boulevard)\b|\b[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|gasse|platz|allee) [0-9]{1,4}[a-z]?\b"
        r"|\b[0-9]{1,4},? (?:rue|avenue|boulevard|place) (?:de |du |des |la |le ){0,2}[A-ZÉ][a-zàâçéèêîôû]+|\b(?:Calle|Avenida|Plaza) (?:de |del |la ){0,2}[A-Z][a-záéíñóú]+,? [0-9]{1,4}\b"
    ),
}

FOR = re.compile(r"(?i)\b(?:tel|phone|call|fax|mobile|cell|contact|e-?mail|mail|write|reach|card|visa|ssn|social security|id|iban|account|name|mr|mrs|ms|dr|telefon|t[ée]l[ée]phone|tel[ée]fono)\b[^\n]{0,20}\Z")
AGAINST = re.compile(r"(?i)\b(?:isbn|version|page|pages|order|invoice|part|model|figure|table|chapter|total|price|section|serial|build|ratio|score|year)\b[^\n]{0,12}\Z")
LABELERS = ("format", "checksum", "gazetteer", "context", "neighbours")
LENGTHS = (8, 12, 16, 24)

#: Cells of the grid: kinds, three votes for each labeler, lengths, line starts.
CELLS = (len(MORE) + len(KINDS)) * 3 ** len(LABELERS) * (len(LENGTHS) + 1) * 2


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def iban_valid(value: str) -> bool:
    turned = value[4:] + value[:4]
    return turned.isalnum() and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    """Each @ that ends a local part, with the longest run before it that no earlier match has taken."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and (text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-")):
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            found.append((begin, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(rank of the kind, start, end): the fixed patterns' matches by kind, then start."""
    found = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))] if "." in text else []
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """Each labeler's vote: 1 for, -1 against, 0 abstains."""
    value, before, after = text[start:end], text[max(0, start - 48) : start], text[end : end + 1]
    digits = "".join(c for c in value if c.isdigit())
    form = check = gazetteer = 0
    if kind == "email":
        form, gazetteer = 1, int(value.rpartition(".")[2].lower() in DOMAINS) or -1
        check = -1 if ".." in value or "@." in value else 0
    elif kind == "ip":
        form, check = 1, -1 if value.startswith(("0.", "00")) else 1
    elif kind == "card":
        form, check, gazetteer = int(len(digits) in (16, 19)) or -1, 1, int(digits[0] in "3456") or -1
    elif kind in ("phone", "phone_local"):
        form = 1 if 9 <= len(digits) <= 13 else -1
        check = -1 if re.fullmatch(r"(?:19|20)\d\d[ ./-]\d\d[ ./-]?\d{1,4}", value) or len(set(digits)) < 3 else 0
        gazetteer = 1 if kind == "phone" and digits[0] != "0" else 0
    elif kind == "email_text":
        form, gazetteer = (1 if re.search(r"[\[(]at[\])]", value) else 0), int(re.split(r"[^A-Za-z]+", value)[-1].lower() in DOMAINS) or -1
    elif kind == "iban":
        form, check, gazetteer = 0, int(iban_valid(value.replace(" ", ""))) or -1, int(value[:2] in COUNTRIES) or -1
    elif kind == "name":
        last = re.findall("[A-Z][a-z]+", value)
        form, gazetteer = int(len(last) > 1), int(any(w.lower() in FIRST_NAMES for w in last))
    elif kind == "national_id":
        form, check = 1, -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    elif kind == "birth_date":
        year, *rest = sorted(map(int, re.findall("[0-9]+", value)), reverse=True)
        form, check = 1, 1 if 1900 <= year <= 2030 and 1 <= min(rest) <= 12 and 1 <= max(rest) <= 31 else -1
    elif kind == "address":
        form, gazetteer = 1, int(len(value.split()) > 1)
    context = 1 if kind == "birth_date" or FOR.search(before) else -1 if AGAINST.search(before) else 0
    beside = before[-1:] + after
    return form, check, gazetteer, context, -1 if any(c.isalnum() or c == "_" for c in beside) else 1


def cell(text: str, kind: int, start: int, end: int) -> int:
    """The candidate's place in the grid."""
    at = kind
    for v in votes(text, (*KINDS, *MORE)[kind], start, end):
        at = at * 3 + v + 1
    return (at * (len(LENGTHS) + 1) + sum(end - start > n for n in LENGTHS)) * 2 + (start == 0 or text[start - 1] == "\n")


def _features(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, votes (cells x labelers, 0 to 2), and the classifier's 0/1 features."""
    rest, line = np.divmod(cells, 2)
    rest, length = np.divmod(rest, len(LENGTHS) + 1)
    given = np.zeros((len(cells), len(LABELERS)), int)
    for j in reversed(range(len(LABELERS))):
        rest, given[:, j] = np.divmod(rest, 3)
    hot = [np.eye(len(KINDS) + len(MORE))[rest], np.eye(len(LENGTHS) + 1)[length], line[:, None]]
    return rest, given, np.hstack([*hot, *(np.eye(3)[given[:, j]] for j in range(given.shape[1])), np.ones((len(cells), 1))])


def reliabilities(given: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: P(vote | class) for each labeler (labelers x classes x votes), and P(personal) for each cell."""
    score = (given - 1).sum(1)
    p = 1 / (1 + np.exp(-1.5 * score.astype(float)))
    table = np.zeros((given.shape[1], 2, 3))
    for _ in range(rounds):
        prior = np.clip((p * counts).sum() / counts.sum(), 0.02, 0.98)
        for c, w in ((0, (1 - p) * counts), (1, p * counts)):
            for j in range(given.shape[1]):
                tally = np.bincount(given[:, j], w, 3) + (1.0, 1.0, 1.0)
                table[j, c] = tally / tally.sum()
        each = np.log(table[np.arange(given.shape[1]), :, given])  # cells x labelers x classes
        odds = np.log(prior / (1 - prior)) + each[..., 1].sum(1) - each[..., 0].sum(1)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return table, p


def train(cells: np.ndarray, counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """The cells that the classifier accepts: logistic regression on the cells' probabilities, each weighted by its count."""
    if not len(cells):
        return cells
    _, given, x = _features(cells)
    _, p = reliabilities(given, counts.astype(float))
    weight = counts / counts.sum()
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        curve = (x * (weight * np.maximum(q * (1 - q), 1e-4))[:, None]).T @ x + 1e-3 * np.eye(len(beta))
        step = np.linalg.solve(curve, x.T @ (weight * (p - q)) - 1e-3 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return cells[x @ beta >= 0]


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def _free(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of spans those that share no character with taken; both in order."""
    out, at = [], 0
    for s, e in spans:
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if at == len(taken) or taken[at][0] >= e:
            out.append((s, e))
    return out


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Base spans, and (rank of the kind, start, end, cell) of the looser patterns' matches outside them and each other."""
    base = base_spans(text)
    taken, found = _joined([(s, e) for _, s, e in base]), []
    digit = any(c in text for c in "0123456789")
    for k, kind in enumerate(MORE, len(KINDS)):
        if not digit and kind not in ("email_text", "name"):
            continue
        pattern = CANDIDATES[kind]
        new = _free([m.span(pattern.groups) for m in pattern.finditer(text)], taken)
        if new:
            taken = _joined(taken + new)
            found += [(k, s, e, cell(text, k, s, e)) for s, e in new]
    return base, found


def _say(spans) -> str:
    return ",".join(f"{(*KINDS, *MORE)[k]}:{s}:{e}" for k, s, e in spans)


def _annotated():
    def run(x: dict) -> dict:
        out: dict = {k: [] for k in ("_key", *(f"n_{k}" for k in KINDS), "base_sha256", "_base", "_cells", "_more")}
        for key, text in zip(x["_key"], x["_text"], strict=True):
            base, more = candidates(text)
            kinds = [k for k, _, _ in base]
            out["_key"].append(key)
            for k, name in enumerate(KINDS):
                out[f"n_{name}"].append(kinds.count(k))
            out["_base"].append(said := _say(base))
            out["base_sha256"].append(hashlib.sha256(said.encode()).hexdigest())
            out["_cells"].append([cell(text, *b) for b in base])
            out["_more"].append([{"cell": c, "span": _say([(k, s, e)])} for k, s, e, c in more])
        return out

    return run


def _texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))


_SCHEMA = "_key bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, _base string, _cells array<int>, _more array<struct<cell: int, span: string>>"


def _accepted(found: DataFrame) -> list[int]:
    """Train on the counts of all cells; the cells accepted."""
    each = found.select(F.explode(F.concat("_cells", F.transform("_more", lambda m: m["cell"]))).alias("cell"))
    rows = each.groupBy("cell").count().orderBy("cell").collect()  # at most CELLS rows
    return train(np.array([r["cell"] for r in rows], int), np.array([r["count"] for r in rows], float)).tolist()


def find_pii(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of docs: key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Spans are kind:start:end in code points, the end exclusive, by kind (base kinds first), then start.
    """
    found = written(over_texts(_texts(docs, text, key), lambda: _annotated(), _SCHEMA), "pii")
    accepted = _accepted(found)
    added = F.transform(F.filter("_more", lambda m: m["cell"].isin(accepted) if accepted else F.lit(False)), lambda m: m["span"])
    spans = F.array_join(F.filter(F.concat(F.array("_base"), added), lambda s: s != ""), ",")
    return found.select(F.col("_key").alias(key), *(f"n_{k}" for k in KINDS), "base_sha256", spans.alias("spans"), F.size(added).cast("long").alias("n_added"))


def masked(text: str, accepted: set[int]) -> str:
    """The text with each span replaced by its kind; spans that touch one another's characters become one."""
    base, more = candidates(text)
    spans = sorted([(s, e, k) for k, s, e in base] + [(s, e, k) for k, s, e, c in more if c in accepted])
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"<{(*KINDS, *MORE)[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in the text replaced, and n_chars as long as the text where docs have it; other columns and
    null texts stay. Texts aren't shuffled: they are read once to train and once to mask."""
    found = written(over_texts(docs.select(F.lit(0).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")), lambda: _annotated(), _SCHEMA).select("_cells", "_more"), "pii-cells")
    accepted = frozenset(_accepted(found))
    dropped(found)
    schema = docs.schema

    def make():
        def run(x: dict) -> dict:
            new = [t if t is None else masked(t, accepted) for t in x[text]]
            sizes = {"n_chars": [n if t is None else len(t) for t, n in zip(new, x["n_chars"], strict=True)]} if "n_chars" in x else {}
            return x | {text: new} | sizes

        return run

    return over_texts(docs, make, schema)
