import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from memlake.llm import quality as Q

WS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WS.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WS.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_base_counts():
    rng = random.Random(5)
    texts = ["", " \n", "a", "a b", "a b c a b c", "x y z\nx y z\n\n \n\nx y z", "é b c", "#*$%&|<>", "a\x1cb c\x85d"]
    texts += ["".join(rng.choice("ab \n#é\t") for _ in range(rng.randrange(200))) for _ in range(300)]
    for t in texts:
        assert Q.base_counts(t) == plain(t), repr(t)


def reference_log_p(texts, order=4):
    """Modified Kneser-Ney over dictionaries, one n-gram at a time."""
    grams = Counter()
    for t in texts:
        s = [0] * (order - 1) + [int(Q.SYMBOL[ord(c)]) for c in t]
        grams.update(tuple(s[i - order + 1 : i + 1]) for i in range(order - 1, len(s)))
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cut = {k: Q.discounts(np.array(list(c.values()), float)) for k, c in levels.items()}
    sums = {k: defaultdict(list) for k in levels}
    for k, c in levels.items():
        for g, n in c.items():
            sums[k][g[:-1]].append(n)

    def p(g):
        k = len(g)
        if not k:
            return 1 / Q.LETTERS
        rest = sums[k].get(g[:-1])
        if not rest:
            return p(g[1:])
        n, d = levels[k].get(g, 0), cut[k]
        return (max(n - d[min(n, 3)], 0) if n else 0) / sum(rest) + sum(d[min(x, 3)] for x in rest) / sum(rest) * p(g[1:])

    return p


def test_model_equals_dictionaries():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcde é") for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    codes, n = np.unique(np.concatenate([Q.coded(texts[i : i + 7])[0] for i in range(0, 60, 7)]), return_counts=True)
    model, p = Q.Model(codes, n), reference_log_p(texts)
    for t in [*texts[:10], "zz unseen letters 123", "a"]:
        s = [0, 0, 0] + [int(Q.SYMBOL[ord(c)]) for c in t]
        want = -sum(math.log(p(tuple(s[i - 3 : i + 1]))) for i in range(3, len(s))) / len(t)
        assert abs(Q.perplexities({"": model}, [""], [t])[0] - want) < 1e-4


def test_long_texts_are_scored_in_windows(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcde é\0") for _ in range(n)) for n in (1, 30, 500, 12, 64, 65, 200)]
    codes, n = np.unique(Q.coded(texts)[0], return_counts=True)
    model = {"": Q.Model(codes, n)}
    whole = Q.perplexities(model, [""] * 7, texts)
    monkeypatch.setattr(Q, "WINDOW", 64)
    assert np.allclose(whole, Q.perplexities(model, [""] * 7, texts))
    assert sum(len(c) for _, c, _ in Q.windows(texts)) == sum(map(len, texts)) and max(len(c) for _, c, _ in Q.windows(texts)) <= 64


def corpus(n=400):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeiou" if k % 2 else "bcdfglmnprst") for k in range(rng.randrange(3, 9))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60, 120))), "en") for i in range(n)]
    odd = [(n + i, " ".join("".join(rng.choice("QXZJKVW0123456789@^~") for _ in range(6)) for _ in range(80)), "en") for i in range(5)]
    dull = [(n + 10 + i, " ".join("a" * (2 + k * 7 % 97 + i) for k in range(90)), "en") for i in range(5)]
    return rows, odd, dull


def test_bands_reject_gibberish_and_dull_text_and_keep_clean(spark):
    clean, odd, dull = corpus()
    extra = [(None, None, None), (9000, "", "xx"), (9001, "too short", "en"), (0, clean[0][1], "en"), (9002, "long " * 30000, None)]
    rows = clean + odd + dull + extra
    got = Q.quality_report(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i, _, _ in clean)
    assert not any(kept[i] for i, _, _ in odd + dull)
    assert not kept[9000] and not kept[9001] and not kept[None] and not kept[9002]
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_bands_follow_the_measured_spread(spark):
    """Junk within 0.35 of the median but many spreads from it: each eighth word is run together from letter pairs; each thirtieth is no junk."""
    clean, _, _ = corpus()
    rng = random.Random(8)
    letters = "".join(t for _, t, _ in clean).replace(" ", "")
    pairs = [letters[i : i + 2] for i in range(0, 4000, 2)]

    def mixed(i, every):
        return " ".join("".join(rng.choice(pairs) for _ in range(3)) if k % every == 0 else w for k, w in enumerate(clean[i][1].split()))

    junk, some = ([(first + i, mixed(i, every), "en") for i in range(5)] for first, every in ((5000, 8), (6000, 30)))
    got = {r.doc_id: r for r in Q.quality_report(spark.createDataFrame(clean + junk + some, "doc_id bigint, text string, lang string")).collect()}
    middle = float(np.median([got[i].log_perplexity for i, _, _ in clean]))
    assert all(abs(got[i].log_perplexity - middle) < 0.35 and not got[i].base_failed for i, _, _ in junk)
    assert not any(got[i].kept for i, _, _ in junk)
    assert all(got[i].kept for i, _, _ in clean + some)


def test_filter_agrees_with_report_and_keeps_columns(spark):
    clean, odd, dull = corpus(200)
    df = spark.createDataFrame([(*r, "x", 7) for r in clean + odd + dull], "doc_id bigint, text string, lang string, _lang string, _text bigint")
    want = {r.doc_id for r in Q.quality_report(df).collect() if r.kept}
    got = Q.keep_good(df)
    assert got.columns == df.columns and {r.doc_id for r in got.collect()} == want


def test_language_by_language_scores_are_equal(spark, monkeypatch):
    clean, _, _ = corpus(80)
    df = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t, _ in clean], "doc_id bigint, text string, lang string")
    whole = sorted(map(tuple, Q.quality_report(df).collect()))
    monkeypatch.setattr(Q, "MODEL_BYTES", 0)
    assert sorted(map(tuple, Q.quality_report(df).collect())) == whole


def test_empty_table(spark):
    assert Q.quality_report(spark.createDataFrame([], "doc_id bigint, text string, lang string")).count() == 0
