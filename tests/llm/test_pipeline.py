import random

import corpus_pipeline
from memlake.llm import near_dup, packing, pii, quality


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeiou" if k % 2 else "bcdfglmnprst") for k in range(rng.randrange(3, 9))) for _ in range(300)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(60, 200)))
    docs = [(i, text(), "en", "s", 0) for i in range(120)]
    docs += [(200 + i, docs[i][1], "en", "s", 0) for i in range(20)]
    docs += [(300, docs[3][1] + " write a.b@example.com", "en", "s", 0), (301, "short", "en", "s", 0), (302, text() + " mail x@y.org now", "en", "s", 0), (303, None, None, None, None)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    stages, now = dict(corpus_pipeline.STAGES), frame
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "packing"]
    good = stages["quality"](spark, now, str(tmp_path))
    assert good.columns == frame.columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.quality_report(frame).collect() if r.kept}
    single = stages["near_duplicates"](spark, good, str(tmp_path))
    ids = {r.doc_id for r in single.collect()}
    assert ids == {r.doc_id for r in near_dup.find_near_duplicates(good).collect() if r.kept} and not ids & {*range(200, 220), 300, 301, 303}
    masked = stages["personal_data"](spark, single, str(tmp_path))
    found = {r.doc_id: r.text for r in masked.collect()}
    assert found.keys() == ids and "<EMAIL>" in found[302] and "x@y.org" not in found[302]
    packed = {(r.doc_id, r.piece) for r in stages["packing"](spark, masked, str(tmp_path)).collect()}
    assert {d for d, _ in packed} == ids
    assert {(r.doc_id, r.piece) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == packed
    assert packing and pii


def plain_quality(rows):
    """Rules and bands one document at a time, the model over dictionaries."""
    import math
    from collections import Counter

    import test_quality

    logs, kept = {}, []
    for lang in {r[2] or "" for r in rows}:
        texts = [r[1] for r in rows if (r[2] or "") == lang and r[1]]
        p = test_quality.reference_log_p(texts) if texts else None
        for r in rows:
            if (r[2] or "") == lang and r[1]:
                s = [0, 0, 0] + [int(quality.SYMBOL[ord(c)]) for c in r[1]]
                logs[r[0]] = -sum(math.log(p(tuple(s[i - 3 : i + 1]))) for i in range(3, len(s))) / len(r[1])
    fine = []
    for r in rows:
        n, _, _, _, again = test_quality.plain(r[1] or "")
        if not (n < 50 or 100 * again > 50 * n):
            fine.append(r)
    for lang in {r[2] or "" for r in fine}:
        own = [r for r in fine if (r[2] or "") == lang]
        bins = Counter(math.floor(logs[r[0]] * 1000) for r in own)
        at = {}
        for q in (0.16, 0.5, 0.84):
            total = 0
            for b in sorted(bins):
                total += bins[b]
                if total / len(own) >= q:
                    at[q] = b / 1000
                    break
        low = at[0.5] - max(quality.SLACK, quality.WIDTH * (at[0.5] - at[0.16]))
        high = at[0.5] + max(quality.SLACK, quality.WIDTH * (at[0.84] - at[0.5]))
        kept += [r for r in own if low <= logs[r[0]] <= high]
    return kept


def plain_masked(text):
    import test_pii

    out, at = "", 0
    for kind, start, end in sorted(test_pii.plain(text), key=lambda x: x[1:]):
        if start >= at:
            out += text[at:start] + f"<{kind.upper()}>"
        at = max(at, end)
    return out + text[at:]


def test_whole_run_beside_a_plain_version(spark, tmp_path):
    import zlib

    import numpy as np
    import public_tokenizers
    import test_near_dup
    from tokenizers import Tokenizer

    rng = random.Random(21)
    words = ["".join(rng.choice("aeiou" if k % 2 else "bcdfglmnprst") for k in range(rng.randrange(3, 9))) for _ in range(300)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60, 140))) + "\\n", "en" if i % 3 else "de") for i in range(90)]
    docs += [(200 + i, docs[i][1] + (" more" if i % 2 else ""), docs[i][2]) for i in range(12)]
    docs += [(300 + i, docs[20 + i][1] + f" write a{i}@example.com or +1 (212) 555-010{i} from 10.0.0.{i}", "en") for i in range(5)]
    docs += [(400 + i, " ".join("".join(rng.choice("QXZJKVW0123456789@^~") for _ in range(6)) for _ in range(80)), "en") for i in range(4)]
    docs += [(500, None, None), (501, "short", "en"), (502, "again and again " * 60, "de")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    good = plain_quality(docs)
    single = {d for d, _, _, kept in test_near_dup.brute(good, 5) if kept}
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation()
    want = {}
    for d, text, _ in good:
        if d in single:
            ids = np.array(tok.encode(plain_masked(text), add_special_tokens=False).ids + [0], "<u4")
            for k in range(0, len(ids), 2048):
                want[d, k // 2048] = k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(single) >= 80 and {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048 and len(filled) <= -(-sum(n for _, n, _ in want.values()) // 2048) + 1


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
