import hashlib
import os
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from memlake.llm import bpe, chunks, packing, token_counts

WORD, BYTE, PIECE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, digest string"
ODD = [None, "", " ", "a", "Hello world! it's  naïve", "x<|endoftext|>y <|startoftext|>", "ΟΔΟΣ Σ ς", "a\n\n b\n c \n\n", "  lead", "trail  ", "a\x1cb \x1f c", "İstanbul ｆｕｌｌ　width", "é café", "１２３ 456 ²", "don't I'll we've", "\r\n\t mixed   space", "😀 emoji 👩‍👩‍👧 zwj", "a   b    c", "foo\n \nbar", "w" * 5000, "word " * 3000]


def fuzz(n=400):
    rng = random.Random(7)
    letters = "aàbßcdeéfσΣςǅ 1²٣!?.,#'\n\t   \x1d-_<|>endoftxİ"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = ODD + fuzz() + ["Hello world! it's  naïve"] * 3
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "no id", "x"), (None, "no id", "x"), (3, "a", "again")], SCHEMA)


def test_round_trip_equals_library(docs):
    tok = Tokenizer.from_file(WORD)
    want = Counter()
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        want[(r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.round_trip(docs, WORD).collect())) == want


def coders():
    own, packer, tok = bpe.Codec(WORD), packing._id_bytes(WORD), Tokenizer.from_file(WORD)
    tok.no_truncation()

    def differ(texts):
        want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
        op6 = [[int(i) for _, ids, _ in row for i in ids.split(" ")] for row in own.parts(texts)]
        op5 = [np.frombuffer(b, "<u4").tolist() for b in packer(texts)]
        return [t for t, a, b, c in zip(texts, want, op6, op5, strict=True) if not a == b == c]

    return differ


def test_ids_equal_library_over_unicode():
    """Every code point up to U+3100 and each 89th of the others, in three contexts; pairs of combining and unassigned ones."""
    differ, rng = coders(), random.Random(3)
    points = [chr(i) for i in range(0x110000) if (i < 0x3100 or i % 89 == 0) and not 0xD800 <= i < 0xE000]
    for form in ("a{0}b", "1{0}!", "A{0}. É{0}"):
        assert not differ([form.format(c) for c in points])
    marks = [c for c in points if unicodedata.category(c) in ("Mn", "Mc", "Cn")]
    assert not differ(["a" + rng.choice(marks) + rng.choice(marks) + rng.choice("bé .1") for _ in range(5000)])


def test_cache_is_bounded_in_bytes():
    seen = []
    cache = chunks.Cache(lambda new: seen.append(len(new)) or [c.upper() for c in new], limit=50_000)
    for k in range(40):
        wanted = {f"w{k}-{i}" for i in range(20)} | {"hot", "x" * 10_000 + str(k)}
        get = cache.load(wanted)
        assert all(get(c) == c.upper() for c in wanted)
        assert cache.bytes <= 50_000 and "x" * 10_000 + str(k) not in cache.held
    get = cache.load(wanted := {f"all{i}" for i in range(2000)} | {"hot"})
    assert all(get(c) == c.upper() for c in wanted) and cache.bytes <= 50_000


def test_byte_level_codec_equals_library():
    tok, own = Tokenizer.from_file(BYTE), bpe.Codec(BYTE)
    for t in [x or "" for x in ODD] + fuzz():
        ids = tok.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == tok.decode(ids, skip_special_tokens=False)


def test_encode_then_decode(docs):
    tok = Tokenizer.from_file(WORD)
    coded = bpe.encode(docs, WORD)
    assert all(r.text == tok.decode(r.ids, skip_special_tokens=False) for r in coded.join(bpe.decode(coded, WORD), "doc_id").collect())


@pytest.mark.parametrize("path", [BYTE, WORD, PIECE])
def test_counts_equal_library(docs, path):
    if path == PIECE:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        tok = Tokenizer.from_file(path)
        count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    want = Counter((r.doc_id, len((r.text or "").encode()), count(r.text or ""), count(r.text or "") > 512) for r in docs.collect())
    assert Counter(map(tuple, token_counts.count_tokens(docs, path).collect())) == want


def test_cache_encodes_only_distinct_misses(spark, docs, tmp_path):
    at = str(tmp_path / "counts")
    docs = docs.union(docs).union(spark.createDataFrame([(7, "twice", ""), (7, "twice", ""), (7, "once", ""), (None, "twice", ""), (None, "no id", ""), (None, "no id", "")], SCHEMA))
    first = token_counts.count_tokens(docs, BYTE, cache_path=at).collect()
    stored = spark.read.parquet(at).count()
    assert stored == len({r.text or "" for r in docs.collect()}) and len(first) == docs.count()
    more = docs.union(spark.createDataFrame([(900, "new text", ""), (901, "new text", ""), (901, "new text", "")], SCHEMA))
    assert len(token_counts.count_tokens(more, BYTE, cache_path=at).collect()) == len(first) + 3
    assert spark.read.parquet(at).count() == stored + 1


def test_cache_with_many_misses(spark, docs, tmp_path, monkeypatch):
    """Beyond what may be broadcast the result is the same."""
    at = str(tmp_path / "counts")
    token_counts.count_tokens(docs.limit(3), BYTE, cache_path=at).collect()
    monkeypatch.setattr(token_counts, "BROADCAST_BYTES", -1)
    got = Counter(map(tuple, token_counts.count_tokens(docs, BYTE, cache_path=at).collect()))
    assert got == Counter(map(tuple, token_counts.count_tokens(docs, BYTE).collect()))
    assert spark.read.parquet(at).count() == len({r.text or "" for r in docs.collect()})


def test_own_cache_is_gone_and_a_hot_content_is_split(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 6000, 1, 6).selectExpr("id as doc_id", "case when id % 3 = 0 then '' else concat('text ', id % 500) end as text")
        out = token_counts.count_tokens(rows, BYTE)
        got = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in plan
    assert len(got) == 6000 and {r.n_tokens for r in got if r.doc_id % 3 == 0} == {0}
    assert not [x for x in os.listdir(shared) if x.startswith("memlake-token-counts")]


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 64, 2048])
    counts = {n: rng.choice([1, 2, 3, 40, 1000]) for n in rng.sample(range(1, cap + 1), min(cap, rng.randrange(1, 60)))}
    plan = packing.plan_best_fit(counts, cap)
    used, ranks = {}, Counter()
    for length in counts:
        rows = sorted(plan[plan[:, 0] == length].tolist(), key=lambda r: r[1])
        for (_, rank, seq, off, each), nxt in zip(rows, [r[1] for r in rows[1:]] + [counts[length]], strict=True):
            for k in range(nxt - rank):
                used.setdefault(seq + k // each, []).append((off + k % each * length, length))
                ranks[length] += 1
    assert ranks == Counter(counts)
    for slots in used.values():
        end = 0
        for at, length in sorted(slots):
            assert at == end
            end += length
        assert end <= cap
    assert len(used) <= reference_bins(counts, cap)


def reference_bins(counts, cap):
    """Best-fit decreasing, one piece at a time."""
    bins = []
    for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= length]
        if fits:
            b = min(fits, key=lambda i: bins[i])
            bins[b] -= length
        else:
            bins.append(cap - length)
    return len(bins)


def test_pack_covers_documents(docs):
    tok = Tokenizer.from_file(WORD)
    whole = docs.filter("doc_id is not null and digest != 'again'")
    rows = packing.pack(whole, WORD).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for d in whole.collect():
        ids = np.array(tok.encode(d.text or "", add_special_tokens=False).ids + [0], "<u4")
        got = sorted(by_doc[d.doc_id], key=lambda r: r.piece)
        assert [r.start for r in got] == list(range(0, len(ids), 2048))
        for r in got:
            part = ids[r.start : r.start + r.length]
            assert len(part) == r.length and r.ids_crc32 == zlib.crc32(part.tobytes())
    for slots in by_seq.values():
        end = 0
        for r in sorted(slots, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 2048


def test_pack_ranks_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 10)
    docs = spark.createDataFrame([(i, "same") for i in range(500)], "doc_id bigint, text string")
    rows = packing.pack(docs, WORD, capacity=8).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 500
    assert len({r.sequence_id for r in rows}) == 125


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(none, WORD).count() == bpe.round_trip(none, WORD).count() == token_counts.count_tokens(none, BYTE).count() == 0
