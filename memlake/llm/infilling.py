"""Fill-in-middle transformation by big-integer bit-parallelism.

A text's code points become one byte each, `bytes.translate` makes a mask of those that aren't white space, and the mask is
read as one big integer. A unit ends at a bit that is set while the next isn't, or at the last code point: shifts and
boolean operations mark all ends at once, `bit_count` counts them, and the end of the k-th unit is found by halving the
integer and counting the lower half. Work is linear in a text's length, at whatever length.

Null and empty texts stay plain: no units, empty output. A null id is hashed as no digits. Ids may repeat: one row out for
each row in. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import over_texts

# The marks in front of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SOLID = bytes(0x30 if c in b" \t\n\v\f\r" else 0x31 for c in range(256))
#: Below this many bits the halves are too small to be worth a split.
_WORD = 64


def unit_ends(text: str) -> int:
    """An integer whose bit i says that a unit ends with code point i."""
    if not text:
        return 0
    solid = int(text.encode("latin-1", "replace").translate(_SOLID)[::-1], 2)
    return solid & ~(solid >> 1) | 1 << (len(text) - 1)


def ranked_bit(mask: int, width: int, rank: int) -> int:
    """The place of the rank-th set bit (from 1) of a mask of width bits."""
    at = 0
    while width > _WORD:
        half = width // 2
        low = mask & ((1 << half) - 1)
        below = low.bit_count()
        if rank <= below:
            mask, width = low, half
        else:
            mask, width, at, rank = mask >> half, width - half, at + half, rank - below
    for _ in range(rank - 1):
        mask &= mask - 1
    return at + (mask & -mask).bit_length() - 1


def end_of_units(ends: int, width: int, units: int) -> int:
    """How many code points the first units take."""
    return ranked_bit(ends, width, units) + 1 if units else 0


def choices(key: int | None, seed: int = 42) -> tuple[int, int, int, int]:
    """Four 32-bit numbers that hang on the seed and the id only."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def transform(text: str, draws: tuple[int, int, int, int], fim_percent: int = 50, spm_percent: int = 80) -> dict:
    """n, form, output and, unless the form is plain, the code points of prefix and middle."""
    ends = unit_ends(text)
    n, (h1, h2, h3, h4) = ends.bit_count(), draws
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= fim_percent:
        return {"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": text}
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (end_of_units(ends, len(text), k) for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    spm = h4 % 100 < spm_percent
    output = f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if spm else f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return {"n": n, "form": "spm" if spm else "psm", "prefix_chars": a, "middle_chars": b - a, "output": output}


def restore(output: str, form: str) -> str:
    """The text that transform() was given; no part holds a mark, so the first one of each kind is the one put in."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, _, rest = output.removeprefix(first).partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return two + middle + one if form == "spm" else one + middle + two


def _cut(seed: int, fim_percent: int, spm_percent: int):
    def make():
        def run(x: dict) -> dict:
            made = [transform(t, choices(k, seed), fim_percent, spm_percent) for k, t in zip(x["_key"], x["_text"], strict=True)]
            return {"_key": x["_key"]} | {c: [m[c] for m in made] for c in ("n", "form", "prefix_chars", "middle_chars", "output")}

        return run

    return make


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _digests(seed: int, fim_percent: int, spm_percent: int):
    def make():
        cut = _cut(seed, fim_percent, spm_percent)()

        def run(x: dict) -> dict:
            made = cut(x)
            made["restored_sha256"] = [_digest(restore(o, f)) for o, f in zip(made["output"], made["form"], strict=True)]
            made["output_sha256"] = [_digest(o) for o in made.pop("output")]
            return made

        return run

    return make


_ROW = "_key bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint"


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))


def fill_in_middle(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of docs: key, n, form, prefix_chars, middle_chars, output (the transformed text)."""
    return over_texts(_rows(docs, text, key), _cut(seed, fim_percent, spm_percent), f"{_ROW}, output string").withColumnRenamed("_key", key)


def fill_in_middle_digests(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """As fill_in_middle, with the digests of output and of the text restored from it instead of texts."""
    out = over_texts(_rows(docs, text, key), _digests(seed, fim_percent, spm_percent), f"{_ROW}, output_sha256 string, restored_sha256 string")
    return out.withColumnRenamed("_key", key)


def oracle() -> str:
    """DuckDB SQL over documents: units as a list, cut by rank."""
    return r"""
with drawn as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents
), units as (
  select doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u,
    ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4
  from drawn
), placed as (
  select *, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
      when h4 % 100 < 80 then 'spm' else 'psm' end as form
  from units
), parts as (
  select doc_id, text, n, form, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:n], '') as s from placed
)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(case form when 'plain' then text else p || m || s end) as restored_sha256
from parts"""
