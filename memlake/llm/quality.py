"""Quality rules and n-gram perplexity bands.

A modified Kneser-Ney model of characters, order 4, is counted by Spark over all texts of each language; lower orders use
continuation counts. The model is sorted arrays of n-gram codes (four symbols of 7 bits) with log probabilities and
back-off weights, searched by bisection. A document's perplexity is that of its characters; for each language a document
outside a lower and an upper band around the median is rejected. The bands are `width` times the distance from the
median to the 16th and 84th percentile, in log perplexity, over all documents that pass the rules; `slack` is a floor for
degenerate spreads, far below a real one.

The alphabet has 128 symbols, so a language's model has at most 128**4 entries and in practice a few hundred
thousand; its growth levels off, while counts grow with the corpus. It is measured before it is broadcast: beyond
MODEL_BYTES scoring goes language by language, each with its own model.

Null texts have no words; null languages are one more language. Ids may be null or repeat: one row out for each row in.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from memlake.llm.common import dropped, give_back, over_texts, sliced, small_batches, written

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
ORDER = 4
#: Symbol of each code point: 0 stands before a text; then ASCII's printable characters, the line feed, and 30 classes of others.
SYMBOL = np.concatenate([np.full(128, 2, np.uint8), (98 + np.arange(128, 0x110000) % 30).astype(np.uint8)])
SYMBOL[32:127] = np.arange(2, 97)
SYMBOL[10] = 97
SYMBOL[0] = 0  # in no text by then: it stands between texts
LETTERS = 127
#: Codes gathered before they are counted, and characters whose codes a task holds at once, however long a text is.
GATHER, WINDOW = 1_000_000, 1 << 18
MODEL_BYTES = 256 << 20


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram codes that end at each character of the texts, and each text's first place."""
    joined = "\0\0\0" + "\0\0\0".join(t.replace("\0", "\1") if "\0" in t else t for t in texts)
    symbols = SYMBOL[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    wide = symbols.astype(np.uint32)
    codes = wide[3:].copy()
    for k in (1, 2, 3):
        codes |= wide[3 - k : len(wide) - k] << np.uint32(7 * k)
    sizes = np.array([len(t) for t in texts], np.int64)
    return codes[symbols[3:] != 0], np.cumsum(sizes) - sizes


def windows(texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Codes of the texts in windows of bounded size: numbers of the texts (one, for a part of a long text), their
    codes and first places."""
    held: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        if held and size + len(text) > WINDOW:
            yield held, *coded([texts[k] for k in held])
            held, size = [], 0
        if len(text) > WINDOW:
            for at in range(0, len(text), WINDOW):
                before = min(at, ORDER - 1)
                yield [i], coded([text[at - before : at + WINDOW]])[0][before:], np.zeros(1, np.int64)
        else:
            held.append(i)
            size += len(text)
    if held:
        yield held, *coded([texts[k] for k in held])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[np.ndarray]] = {}
    waiting: Counter = Counter()
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def settle(lang: str) -> None:
        codes, counts = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
        waiting.pop(lang)
        if lang in totals:
            codes = np.concatenate([totals[lang][0], codes])
            counts = np.concatenate([totals[lang][1], counts])
            codes, at = np.unique(codes, return_inverse=True)
            counts = np.bincount(at, counts).astype(np.int64)
        totals[lang] = codes, counts

    for batch in (b for whole in batches for b in sliced(whole)):
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text:
                by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            for _, codes, _ in windows(texts):
                held.setdefault(lang, []).append(codes)
                waiting[lang] += len(codes)
                if waiting[lang] >= GATHER:
                    settle(lang)
    for lang in list(held):
        settle(lang)
    for lang, (codes, counts) in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int32)), pa.array(counts)], names=["_lang", "code", "n"])
    totals.clear()
    give_back()


class Model:
    """One language's tables: for each order sorted codes and log probabilities, sorted contexts and log back-off weights."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.tables: list[tuple[np.ndarray, ...]] = []
        order = np.argsort(codes)
        levels = [(codes[order].astype(np.uint32), counts[order].astype(np.float64))]
        for k in range(ORDER - 1, 0, -1):  # continuation counts: how many symbols stand before the shorter n-gram
            shorter, before = np.unique(levels[-1][0] & np.uint32((1 << 7 * k) - 1), return_counts=True)
            levels.append((shorter, before.astype(np.float64)))
        lower: np.ndarray | None = None
        for k, (grams, c) in enumerate(reversed(levels), 1):
            d = discounts(c)
            kind = np.minimum(c, 3).astype(int)
            contexts, at = np.unique(grams >> np.uint32(7), return_inverse=True)
            total = np.bincount(at, c)
            weight = np.bincount(at, d[kind]) / total
            p = (c - d[kind]) / total[at]
            if lower is None:
                p += weight[at] / LETTERS
            else:
                below = self.tables[-1]
                p += weight[at] * np.exp(below[1][np.searchsorted(below[0], grams & np.uint32((1 << 7 * (k - 1)) - 1))])
            lower = np.log(p).astype(np.float32)
            self.tables.append((grams, lower, contexts, np.log(np.maximum(weight, 1e-12)).astype(np.float32)))

    def log_p(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Natural log probability of each code's last symbol after the others."""
        if not order:
            return np.full(len(codes), -np.log(LETTERS), np.float32)
        grams, logs, contexts, weights = self.tables[order - 1]
        at = np.minimum(np.searchsorted(grams, codes), len(grams) - 1)
        out = logs[at]
        if len(missed := np.flatnonzero(grams[at] != codes)):
            rest = codes[missed]
            context = rest >> np.uint32(7)
            i = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            out[missed] = self.log_p(rest & np.uint32((1 << 7 * (order - 1)) - 1), order - 1) + np.where(contexts[i] == context, weights[i], 0)
        return out

    def bytes(self) -> int:
        return sum(a.nbytes for t in self.tables for a in t)


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney's discounts for counts 0, 1, 2 and 3 or more, from the counts of counts."""
    n = [0.0, *(float((counts == k).sum()) for k in (1, 2, 3, 4))]
    if not all(n[1:]):
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n[1] / (n[1] + 2 * n[2])
    return np.clip([0.0, *(k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3))], [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, Model]:
    """A model for each language, counted over all texts."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("_lang"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    counted = rows.mapInArrow(_count, "_lang string, code int, n bigint").groupBy("_lang", "code").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    langs = np.array(found["_lang"].to_pylist(), object)
    codes, counts = found["code"].to_numpy(), found["n"].to_numpy()
    return {str(k): Model(codes[own := langs == k], counts[own]) for k in dict.fromkeys(langs.tolist())}


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII's white space only
    lines = Counter(text.split("\n"))
    again = sum(n - 1 for line, n in lines.items() if n > 1 and line.strip(SPACES))
    repeated = 0
    if len(words) >= 3:
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        windows = (ids[:-2] * len(known) + ids[1:-1]) * len(known) + ids[2:]
        _, at, n = np.unique(windows, return_inverse=True, return_counts=True)
        if len(n) < len(windows):
            twice = n[at] > 1
            covered = np.zeros(len(words), bool)
            for k in range(3):
                covered[k : len(words) - 2 + k] |= twice
            repeated = int(covered.sum())
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), again, repeated


def failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > 50 * n_words


def perplexities(models: dict[str, Model], langs: list[str], texts: list[str]) -> np.ndarray:
    """Mean of minus log probability for each character of each text; NaN for empty texts and languages without a model."""
    sums = np.zeros(len(texts))
    sizes = np.array([len(t) for t in texts], np.int64)
    known = np.array([bool(t) and k in models for k, t in zip(langs, texts, strict=True)], bool)
    for lang in dict.fromkeys(langs):
        own = [i for i, x in enumerate(langs) if x == lang and known[i]]
        for numbers, codes, starts in windows([texts[i] for i in own]):
            sums[[own[k] for k in numbers]] -= np.add.reduceat(models[lang].log_p(codes).astype(np.float64), starts)
    return np.where(known, sums / np.maximum(sizes, 1), np.nan)


def _judge(shared, finish: Callable[[dict, list, np.ndarray], dict]):
    def make():
        models = shared.value

        def run(x: dict) -> dict:
            texts = [t or "" for t in x["_text"]]
            return finish(x, [base_counts(t) for t in texts], perplexities(models, x["_lang"], texts))

        return run

    return make


def _scored(x: dict, base: list, logs: np.ndarray) -> dict:
    n_words, chars, symbols, lines, repeated = zip(*base, strict=True)
    bad = [failed(n, r) for n, r in zip(n_words, repeated, strict=True)]
    return {"_key": x["_key"], "_lang": x["_lang"], "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeated, "base_failed": bad, "log_perplexity": [None if np.isnan(v) else float(v) for v in logs]}


_SCORES = "_key bigint, _lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, log_perplexity double"


def bands(scores: DataFrame, width: float, slack: float) -> dict[str, tuple[float, float]]:
    """Lower and upper log perplexity for each language, from a histogram of all scores in steps of 0.001."""
    step = F.floor(F.col("log_perplexity") * 1000).cast("long")
    rows = scores.filter(~F.col("base_failed") & F.col("log_perplexity").isNotNull()).groupBy("_lang", step.alias("bin")).count().collect()
    found = {}
    for lang in sorted({r["_lang"] for r in rows}):
        bins, n = np.array(sorted((r["bin"], r["count"]) for r in rows if r["_lang"] == lang)).T
        share = np.cumsum(n) / n.sum()
        low, mid, high = (bins[np.searchsorted(share, q)] / 1000 for q in (0.16, 0.5, 0.84))
        found[lang] = mid - max(slack, width * (mid - low)), mid + max(slack, width * (high - mid))
    return found


def _inputs(docs: DataFrame, text: str, lang: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(lang), F.lit("")).alias("_lang"), F.coalesce(F.col(text), F.lit("")).alias("_text"))


def _score_all(docs: DataFrame, models: dict[str, Model], finish, schema) -> DataFrame:
    """Score with one broadcast of all models, or, if they are too large together, language by language."""
    sc = docs.sparkSession.sparkContext
    if sum(m.bytes() for m in models.values()) <= MODEL_BYTES:
        return over_texts(docs, _judge(sc.broadcast(models), finish), schema)
    none = over_texts(docs.filter(~F.col("_lang").isin(list(models))), _judge(sc.broadcast({}), finish), schema)
    for k, m in models.items():
        none = none.unionByName(over_texts(docs.filter(F.col("_lang") == k), _judge(sc.broadcast({k: m}), finish), schema))
    return none


#: Bands: WIDTH measured spreads of the language (about 0.02 nat a character on real prose); SLACK only keeps a spread of nearly
#: nothing (a language of copies) from rejecting what differs by rounding.
WIDTH, SLACK = 6.0, 0.005


def quality_report(docs: DataFrame, width: float = WIDTH, slack: float = SLACK, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """One row for each row of docs: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_perplexity."""
    models = fit(docs, text, lang)
    scores = written(_score_all(_inputs(docs, text, lang, key), models, _scored, _SCORES), "quality")
    kept = ~F.col("base_failed") & inside(bands(scores, width, slack))
    return scores.select(F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "log_perplexity")


def inside(found: dict[str, tuple[float, float]]):
    """Whether log_perplexity lies in its language's band; true without a score or a band."""
    ok = F.lit(None).cast("boolean")
    for lang, (low, high) in found.items():
        ok = F.coalesce(ok, F.when(F.col("_lang") == lang, F.col("log_perplexity").between(low, high)))
    return F.coalesce(ok, F.lit(True))


def keep_good(docs: DataFrame, width: float = WIDTH, slack: float = SLACK, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without those that the rules or the bands reject, all columns as they were. Texts aren't shuffled: they are read
    to count, to set the bands and to filter."""
    models = fit(docs, text, lang)
    rows = docs.select(F.lit(0).cast("long").alias("_key"), F.coalesce(F.col(lang), F.lit("")).alias("_lang"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    scores = written(_score_all(rows, models, _scored, _SCORES), "quality")
    limits = bands(scores, width, slack)
    dropped(scores)
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called, none clashes with ours

    def verdict(x: dict, base: list, logs: np.ndarray) -> dict:
        keep = []
        for (n_words, _, _, _, repeated), k, v in zip(base, x["_lang"], logs, strict=True):
            low, high = limits.get(k, (-np.inf, np.inf))
            keep.append(not failed(n_words, repeated) and bool(np.isnan(v) or low <= v <= high))
        return {c: x[c] for c in names} | {"_keep": keep}

    own = docs.toDF(*names)
    of = dict(zip(docs.columns, names, strict=True))
    extended = own.withColumns({"_lang": F.coalesce(F.col(of[lang]), F.lit("")), "_text": F.coalesce(F.col(of[text]), F.lit(""))})
    out = _score_all(extended, models, verdict, StructType([*own.schema.fields, StructField("_keep", BooleanType())]))
    return out.filter("_keep").drop("_keep").toDF(*docs.columns)
