"""Token counts through a digest cache.

Each text's normalised content (null as empty, UTF-8) has a SHA-256 digest; with the digest of the tokenizer's file it
is the key of a stored count. Only distinct contents whose key isn't stored are encoded, once each, and appended. A content
that many rows share is made one row before it moves, in the tasks that read it, and its rows are dealt out as a skewed
partition when the counts are joined to them.

Null texts count as empty: 0 bytes, 0 tokens. Ids may be null or repeat: one row out for each row in.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm import chunks
from memlake.llm.common import BROADCAST_BYTES, over_texts, shared_dir, written

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens bigint"
#: Bytes of a digest in a broadcast, about.
ROW_BYTES = 96


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: its file's SHA-256."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def counter(path: str):
    """A function from texts to token counts as the library for this file gives them; its cache lives as long as the task."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import json

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()

    def whole(texts: list[str]) -> list[int]:
        return [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
        return whole
    special = [t["content"] for t in spec["added_tokens"]]
    cache = chunks.Cache(whole, weigh=lambda n: 0)

    def by_chunks(texts: list[str]) -> list[int]:
        cut = [None if any(s in t for s in special) else chunks.spaced(t) for t in texts]
        get = cache.load(set().union(*(c for c in cut if c)))
        rest = iter(whole([t for t, c in zip(texts, cut, strict=True) if c is None]))
        return [next(rest) if c is None else sum(map(get, c)) for c in cut]

    return by_chunks


def _encoder(path: str):
    def make():
        count = counter(path)
        return lambda x: {"digest": x["digest"], "n_tokens": count(x["text"])}

    return make


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of docs: key, n_bytes, n_tokens, over_limit. cache_path: a table of counts to read and append to
    (if None a new one in the shared folder, gone when the counts are joined). An interrupted append leaves counts that are right, so running again is safe.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    own = cache_path is None
    cache_path = cache_path or f"{shared_dir(spark)}/memlake-token-counts-{os.urandom(8).hex()}"
    base = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).cast("string").alias("_text"))
    digest = F.unhex(F.sha2("_text", 256)).alias("digest")
    digests = written(base.select("_key", digest, F.octet_length("_text").cast("long").alias("n_bytes")), "digests")
    where = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    contents, missing = base.select(digest, "_text"), None
    if files.exists(where):
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer") == version).select("digest")
        missing = written(digests.select("digest").distinct().join(known, "digest", "left_anti"), "missing")
        few = missing.count() * ROW_BYTES <= BROADCAST_BYTES
        contents = contents.join(F.broadcast(missing), "digest", "left_semi") if few else contents
    misses = contents.groupBy("digest").agg(F.any_value("_text").alias("text"))  # copies meet in the tasks that read them first
    if missing is not None and not few:
        misses = misses.join(missing, "digest", "left_semi")
    made = over_texts(misses, _encoder(tokenizer_path), "digest binary, n_tokens bigint")
    made.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer") == version)
    counts = counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # an interrupted run may have appended some twice
    counts = written(counts, "counts")  # a plain table, so that a hot digest's rows can be split
    if own:
        files.delete(where, True)
    out = digests.join(counts, "digest", "left")
    return out.select(F.col("_key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
