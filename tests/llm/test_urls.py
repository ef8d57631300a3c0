"""URL filters beside a plain version that counts every combination, and fixed rules beside the contract."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from memlake.llm import urls

SCHEMA = "page_id bigint, url string, host string, verdict string, _key int"


def cut(url):
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    at = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[at:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at]), path[: min((i for i in map(path.find, "?#") if i >= 0), default=len(path))]


def fixed(host, path):
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else None


def plain(pages, blocked, support, least, confidence):
    """What judge() returns, by counting all combinations of at most LONGEST tokens in all labelled URLs."""
    labels = {}
    for key, url in pages:
        if url is None:
            continue
        host, path = cut(url)
        rule = fixed(host, path)
        word = set(urls.BLOCKED_WORDS) & set("".join(c if c.isascii() and c.isalnum() and not c.isupper() else " " for c in host).split())
        label = rule[1] if rule else "block" if word else None if key not in blocked else "block" if blocked[key] else "allow"
        if label:
            labels[url] = max(label, labels.get(url, ""))
    tokens = {u: urls.tokens_of(u) for u in labels}
    n, need = len(labels), max(least, -int(-len(labels) * support // 1))
    share = sum(v == "block" for v in labels.values()) / n if n else 0
    single, both = Counter(t for s in tokens.values() for t in s), Counter(t for u, s in tokens.items() for t in s if labels[u] == "block")
    surprise = lambda t: (both[t] - single[t] * share) ** 2 / max(single[t] * share * (1 - share), 1e-9)
    known = sorted((t for t in single if single[t] >= need), key=lambda t: (-surprise(t), t))[: urls.VOCABULARY]
    counts, found = Counter(), Counter()
    for u, s in tokens.items():
        own = [t for t in known if t in s][: urls.WIDTH]
        for k in range(1, urls.LONGEST + 1):
            for c in itertools.combinations(sorted(own), k):
                counts[c] += 1
                found[c, labels[u]] += 1
    rules = {(c, v): (m / counts[c], m) for (c, v), m in found.items() if m >= need and m / counts[c] >= confidence}
    kept = {r: x for r, x in rules.items() if not any((p, r[1]) in rules for k in range(1, len(r[0])) for p in itertools.combinations(r[0], k))}
    out = []
    for key, url in pages:
        host, path = cut(url)
        rule, own = fixed(host, path), urls.tokens_of(url)
        fits = sorted((-x[0], -x[1], v != "block", c, v) for (c, v), x in kept.items() if own.issuperset(c))
        verdict = rule[1] if rule else fits[0][4] if fits else "allow"
        out.append((key, host, path, rule and rule[0], verdict, " ".join(fits[0][3]) if fits and not rule else None))
    return out, kept


def made(n=400):
    hosts = ["a.example.org", "www.b.com", "cheap-pills.net", "m.good.net", "bad.site.net", "org", "x.comorg"]
    for k in range(n):
        yield k, f"https://{hosts[k % 7]}/{['en', 'de', 'fr', 'es', 'ads'][k % 5]}/{k}{['', '?ref=1&x=2', '#top'][k % 3]}"


ODD = [(None, None), (1, ""), (2, "no scheme"), (2, "://"), (3, "http://ORG/x"), (4, "http://A.Org?q"), (5, "http://É.com/de/"), (6, "http://b.com/de"), (7, "http://notcom/de/"), (8, "x://y://z.org/"), (9, "http://h/" + "a/" * 5000), (9, "http://w.org/p?" + "&".join(f"k{i}=1" for i in range(2000)))]


def judged(spark, pages, blocked, **kw):
    df = spark.createDataFrame([(k, u, "h", "v", 1) for k, u in pages], SCHEMA)
    labels = spark.createDataFrame(list(blocked.items()), "page_id bigint, block boolean")
    found = urls.mined(urls.labelled(df, labels), **kw)
    return [tuple(r) for r in urls.judge(df, labels, found=found).collect()], {(tuple(r.tokens), r.label): (r.confidence, r.n) for r in found.collect()}


def test_equals_counting(spark):
    pages = [*made(), *ODD, *[(1000 + i, "https://m.good.net/en/7") for i in range(200)]]
    blocked = {k: k % 7 == 4 and k % 5 == 4 for k in range(400)}
    got, rules = judged(spark, pages, blocked, support=0.01, least=5, confidence=0.9)
    want, kept = plain(pages, blocked, 0.01, 5, 0.9)
    assert rules.keys() == kept.keys() and all(abs(rules[r][0] - kept[r][0]) < 1e-9 and rules[r][1] == kept[r][1] for r in kept)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(len(c) > 1 and v == "block" for c, v in kept) and {r[4] for r in got if r[3] is None} == {"allow", "block"}


def test_many_tokens_in_every_url_stay_bounded(spark):
    """Forty tokens that always occur together would be 2**40 combinations."""
    pages = [(k, f"http://{'.'.join(f'w{i}' for i in range(20))}.com/{'de' if k % 2 else 'it'}/{k}?" + "&".join(f"q{i}=1" for i in range(20))) for k in range(60)]
    got, rules = judged(spark, pages, {k: False for k in range(0, 60, 2)}, support=0.1, least=5, confidence=0.9)
    assert (("path1=de",), "block") in rules and len(got) == 60
    want, kept = plain(pages, {k: False for k in range(0, 60, 2)}, 0.1, 5, 0.9)
    assert rules.keys() == kept.keys() and sorted(got, key=repr) == sorted(want, key=repr)


def test_longest_rule_and_no_labels(spark):
    pages = [(0, "http://a.example.org/es/1"), (1, "http://example.org/en/12"), (2, "http://example.org/en/2"), (3, "http://q.net/"), (4, None)]
    df = spark.createDataFrame([(k, u, "h", "v", 1) for k, u in pages], SCHEMA)
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert got == {0: ("example.org/es/", "block"), 1: ("example.org/en/1", "block"), 2: ("org/", "allow"), 3: (None, "allow"), 4: (None, "allow")}


def test_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pruning_keeps_other_labels(spark):
    rules = spark.createDataFrame([(["a"], "block", 1.0, 9), (["a", "b"], "block", 1.0, 8), (["a", "b"], "allow", 1.0, 8), (["b", "c", "d"], "block", 0.9, 7)], "tokens array<string>, label string, confidence double, n bigint")
    left = urls.pruned(rules).orderBy(F.size("tokens"), "label").collect()
    assert [(r.tokens, r.label) for r in left] == [(["a"], "block"), (["a", "b"], "allow"), (["b", "c", "d"], "block")]


def every_rule(labels, need, confidence):
    """All rules of any length over all tokens of {url: label}, without those that have another rule's tokens and more."""
    counts, found = Counter(), Counter()
    for u, v in labels.items():
        own = sorted(urls.tokens_of(u))
        for k in range(1, len(own) + 1):
            for c in itertools.combinations(own, k):
                counts[c] += 1
                found[c, v] += 1
    rules = {(c, v): (m / counts[c], m) for (c, v), m in found.items() if m >= need and m / counts[c] >= confidence}
    return {r: x for r, x in rules.items() if not any((p, r[1]) in rules for k in range(1, len(r[0])) for p in itertools.combinations(r[0], k))}


def mined_from(spark, labels, **kw):
    found = urls.mined(spark.createDataFrame(list(labels.items()), "url string, label string"), **kw)
    rows = found.collect()
    got = {(tuple(r.tokens), r.label): (r.confidence, r.n) for r in rows}
    assert len(got) == len(rows)
    return got


def same(got, want):
    return got.keys() == want.keys() and all(abs(got[r][0] - want[r][0]) < 1e-9 and got[r][1] == want[r][1] for r in want)


def test_more_tokens_than_a_vocabulary(spark):
    """A hundred hosts, each a rule of its own."""
    labels = {f"http://w{i}.net/{k}": "block" if i % 3 else "allow" for i in range(100) for k in range(6)}
    got = mined_from(spark, labels, support=0.001, least=5)
    assert same(got, every_rule(labels, 5, urls.CONFIDENCE)) and len(got) == 100


@pytest.mark.parametrize("narrow", [2, 4, 10])
def test_rules_of_any_length_in_wide_urls(spark, monkeypatch, narrow):
    """Blocked is what has five tokens together; of the others some occur nearly always, some always together, some always."""
    monkeypatch.setattr(urls, "NARROW", narrow, raising=False)
    draw, labels = random.Random(5), {}
    for k in range(500):
        own = {t for t in "abcde" if draw.random() < 0.7} | {t for t in "fg" if draw.random() < 0.9} | ({"h", "i"} if draw.random() < 0.5 else set())
        labels[f"http://net/{k}?" + "&".join(f"{t}=1" for t in sorted(own))] = "block" if own >= set("abcde") and draw.random() < 0.97 else "allow"
    want = every_rule(labels, 10, 0.9)
    assert same(mined_from(spark, labels, support=0.001, least=10, confidence=0.9), want)
    assert any(len(c) == 5 and v == "block" for c, v in want)


def test_wide_urls_with_tokens_always_together(spark):
    """Forty tokens, in half of the URLs, beside two that decide only together: 2**42 combinations. Counted with one of the forty."""
    labels, many = {}, "&".join(f"q{i}=1" for i in range(40))
    for k in range(160):
        a, b = k // 2 % 2, k // 4 % 2
        labels[f"http://net/{k}?" + "&".join(["xa=1"] * a + ["xb=1"] * b + [many] * (k % 2))] = "block" if a and b else "allow" if k % 3 or a or b else "block"
    got = mined_from(spark, labels, support=0.01, least=5, confidence=0.9)
    want = every_rule({u.replace(many, "q0=1"): v for u, v in labels.items()}, 5, 0.9)
    assert same(got, want) and (("query=xa", "query=xb"), "block") in got


def test_segments_of_any_depth(spark):
    labels = {f"http://net/{'k' * (k + 1)}/x/y/z/{'bad' if k % 2 else 'good'}": "block" if k % 2 else "allow" for k in range(40)}
    assert set(mined_from(spark, labels, least=5)) == {(("path5=bad",), "block"), (("path5=good",), "allow")}


def test_tokens_of_any_characters(spark, monkeypatch):
    """Tokens come back from the tables as they were."""
    monkeypatch.setattr(urls, "NARROW", 2, raising=False)
    signs = ['"', "\\", "\n\t", "\u2028", "\x00\x1f", "\U0001f600", "{}", "null", " ", "\u00e9"]
    labels = {f"http://net/{signs[k % 10]}/{signs[k // 10 % 10]}/{k}": "block" if k % 10 in (k // 10 % 10, 3) else "allow" for k in range(600)}
    want = every_rule(labels, 6, 0.9)
    assert same(mined_from(spark, labels, support=0.001, least=6, confidence=0.9), want) and {len(c) for c, _ in want} == {1, 2}


def test_joined_rules_judge_as_held_ones(spark, monkeypatch):
    pages = [*made(), *ODD, *[(1000 + i, "https://m.good.net/en/7") for i in range(20)]]
    blocked = {k: k % 7 == 4 and k % 5 == 4 for k in range(400)}
    held, _ = judged(spark, pages, blocked, support=0.01, least=5, confidence=0.9)
    monkeypatch.setattr(urls, "HELD", 0)
    got, _ = judged(spark, pages, blocked, support=0.01, least=5, confidence=0.9)
    assert sorted(got, key=repr) == sorted(held, key=repr) and any(r[5] for r in got)
