"""Best-fit packing planned over a histogram of lengths.

Documents become token ids with a separator after each; only those longer than a sequence are cut. The plan is best-fit
decreasing over counts for each length: its input is at most `capacity` pairs (length, count), whatever the corpus, and its
output is ranges of ranks within a length. Pieces get their rank within their length without one task for a common length
(rank within a hashed bucket plus the buckets before), and take the slot planned for that rank.

Null texts are read as empty: the separator alone. Ids may be null or repeat; equal rows take slots in any order.
An empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm import chunks
from memlake.llm.common import over_texts, written

#: Pieces of one length that are ranked together, about.
RANK_ROWS = 20_000
#: Words that the tokenizer gets as one text, and bytes of known words that a task holds.
TOGETHER, WORD_BYTES = 64, 96 << 20


def _id_bytes(path: str):
    """Texts to their ids as little-endian 32-bit numbers; its cache lives as long as the task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    special = [t.content for t in tok.get_added_tokens_decoder().values()]

    def whole(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    suffix = getattr(tok.model, "end_of_word_suffix", None) or ""
    ends = np.zeros(tok.get_vocab_size(), bool)
    if suffix:
        ends[[i for t, i in tok.get_vocab().items() if t.endswith(suffix)]] = True

    def pieces(missing: list[str]) -> list[bytes]:
        """Ids of words that aren't known yet: many at once, told apart by the mark that ends a word."""
        words = [w for w in missing if chunks.settled(w)] if suffix else []
        found = {}
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for group, ids in zip(groups, whole([" ".join(g) for g in groups]), strict=True):
            at = [0, *(4 * (np.flatnonzero(ends[np.frombuffer(ids, "<u4")]) + 1)).tolist()]
            if len(at) == len(group) + 1 and at[-1] == len(ids):
                found.update((w, ids[at[k] : at[k + 1]]) for k, w in enumerate(group))
        rest = [w for w in missing if w not in found]
        found.update(zip(rest, whole(rest), strict=True))
        return [found[w] for w in missing]

    cache = chunks.Cache(pieces, WORD_BYTES)
    words = chunks.words_of(path)

    def run(texts: list[str]) -> list[bytes]:
        cut = [None if any(s in t for s in special) else words(t) for t in texts]
        get = cache.load(set().union(*(c for c in cut if c)))
        rest = iter(whole([t for t, c in zip(texts, cut, strict=True) if c is None]))
        return [next(rest) if c is None else b"".join(map(get, c)) for c in cut]

    return run


def _pieces(path: str, capacity: int, separator: int):
    end = np.array([separator], "<u4").tobytes()

    def make():
        encode = _id_bytes(path)

        def run(x: dict) -> dict:
            out: dict = {k: [] for k in ("_key", "piece", "start", "length", "ids_crc32")}
            for key, ids in zip(x["_key"], encode(x["_text"]), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for k, v in (("_key", key), ("piece", piece), ("start", at // 4), ("length", len(part) // 4), ("ids_crc32", zlib.crc32(part))):
                        out[k].append(v)
            return out

        return run

    return make


def plan_best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, pieces in each sequence) from counts for each length.

    From the longest length on, each piece goes to the open sequence with the least room that still holds it, else to a
    new one. Sequences with equal room are one range of numbers, so work and rows don't depend on the counts' size.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # ranges (first sequence, how many) by room left
    plan, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = int(counts[length]), 0
        if not 0 < length <= capacity:
            raise ValueError(f"a length of {length} can't be packed into {capacity}")

        def fill(first: int, many: int, space: int, left: int, rank: int, length: int = length) -> tuple[int, int, int]:
            """Put pieces into sequences of equal room; how many sequences were used, what is left, the next rank."""
            each = space // length
            full = min(many, left // each)
            for begin, n, pieces in ((first, full, each), (first + full, int(full < many and left % each > 0 and left // each == full), left - full * each)):
                if n and pieces:
                    plan.append((length, rank, begin, capacity - space, pieces))
                    room[space - pieces * length].append((begin, n))
                    rank, left = rank + n * pieces, left - n * pieces
                    full = begin + n - first
            return full, left, rank

        for space in range(length, capacity):
            if not left:
                break
            ranges, room[space] = room[space], []
            for first, many in ranges:
                used, left, rank = fill(first, many, space, left, rank) if left else (0, left, rank)
                if used < many:
                    room[space].append((first + used, many - used))
        if left:
            new = -(-left // (capacity // length))
            fill(opened, new, capacity, left, rank)
            opened += new
    return np.array(plan, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    texts = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = "_key bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    pieces = written(over_texts(texts, _pieces(tokenizer_path, capacity, separator), schema), "pieces")
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    plan = plan_best_fit(counts, capacity)
    buckets = max(1, max(counts.values(), default=0) // RANK_ROWS)
    placed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("_key", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = placed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_bucket").orderBy("_key", "piece", "ids_crc32")
    ranked = placed.withColumn("_rank", F.row_number().over(order) - 1).join(sizes, ["length", "_bucket"])
    ranked = ranked.select("_key", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).alias("_rank"))

    order_of = np.lexsort((plan[:, 1], plan[:, 0])) if len(plan) else []
    length, rank, sequence, offset, each = plan[order_of].T if len(plan) else np.zeros((5, 0), np.int64)
    starts = (length << 44) + rank

    def make():
        def run(x: dict) -> dict:
            own, at = np.array(x["length"], np.int64), np.array(x["_rank"], np.int64)
            i = np.searchsorted(starts, (own << 44) + at, "right") - 1
            turn = at - rank[i]
            return {k: x[k] for k in ("_key", "piece", "start", "length", "ids_crc32")} | {"sequence_id": sequence[i] + turn // each[i], "offset": offset[i] + turn % each[i] * own}

        return run

    return over_texts(ranked, make, f"{schema}, sequence_id bigint, offset bigint").withColumnRenamed("_key", key)
