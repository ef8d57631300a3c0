import hashlib
import re

import numpy as np

from memlake.llm import pii

KINDS = ("email", "ip", "card", "phone")
TEXTS = [
    None,
    "",
    "mail a.b+c@x-y.example.com, b@c and x@@y.org, a@b.c@d.e",
    "ip 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 010.0.0.1 1.2.3",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 4111111111111111 9, 378282246310005",
    "call +1 (212) 555-0100 or +49 30 1234 or +1-2 +123456789012345678",
    "é😀 x@y.zz +33 1 23 45 67 89",
    "SSN 123-45-6789, IBAN DE89370400440532013000, Dr. Anna Smith, tel 0221 123456, joe at example dot com",
    "word " * 30000 + "a@b.cd",
]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_by_plain_patterns(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[2], "x"), (2, TEXTS[2], "y")]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id bigint, text string, spans string")).collect()
    assert len(got) == len(rows)
    for r in got:
        base = plain(TEXTS[2] if r.doc_id is None else TEXTS[r.doc_id] or "")
        said = [f"{k}:{s}:{e}" for k, s, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert r.spans.split(",")[: len(said)] == said or not said
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for k, _, _ in base) for n in KINDS)


def test_emails_equal_the_pattern():
    import random

    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice("a1.@-_ é%") for _ in range(30))
        assert [(s, e) for k, s, e in pii.base_spans(text) if k == 0] == [(s, e) for k, s, e in plain(text) if k == "email"]


def test_reliabilities_recover_planted_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.4
    right = np.array([0.9, 0.8, 0.7, 0.85, 0.6])
    votes = np.where(rng.random((20000, 5)) < right, truth[:, None], ~truth[:, None]) * 2
    cells, counts = np.unique(votes, axis=0, return_counts=True)
    table, p = pii.reliabilities(cells, counts.astype(float))
    assert np.abs(table[:, 1, 2] - right).max() < 0.05
    at = {tuple(c): q for c, q in zip(cells.tolist(), p, strict=True)}
    assert np.mean([(at[tuple(v)] > 0.5) == t for v, t in zip(votes.tolist(), truth, strict=True)]) > 0.93


def test_supported_candidates_are_added_and_others_not(spark):
    rows = []
    for i in range(200):
        rows.append((2 * i, f"My IBAN: DE89370400440532013000 and SSN 123-45-{1000 + i}, mail a{i}@example.com."))
        rows.append((2 * i + 1, f"version 1234 567 8901{i % 10} and order 2019 06 0512, AB12ABCD{i % 10}"))
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all("iban:" in got[2 * i] and "national_id:" in got[2 * i] for i in range(200))
    assert not any("iban" in got[2 * i + 1] for i in range(200))


def test_masking(spark):
    df = spark.createDataFrame([(1, "a@b.cd at 1.2.3.4", 17), (2, None, 0), (3, "clean", 5)], "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.mask_pii(df).collect()}
    assert got == {1: ("<EMAIL> at <IP>", 15), 2: (None, 0), 3: ("clean", 5)}


def test_empty_table(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def plain_method(texts):
    """Candidates one by one: expectation-maximisation and the classifier in plain loops; the spans that are accepted."""
    each = [(i, k, s, e, pii.votes(t, (*pii.KINDS, *pii.MORE)[k], s, e)) for i, t in enumerate(texts) for base, more in [pii.candidates(t)] for k, s, e in [*base, *((k, s, e) for k, s, e, _ in more)]]
    p = [1 / (1 + np.exp(-1.5 * sum(v))) for *_, v in each]
    for _ in range(100):
        prior = min(max(sum(p) / len(p), 0.02), 0.98)
        odds = [np.log(prior / (1 - prior))] * len(p)
        for j in range(len(pii.LABELERS)):
            for c in (0, 1):
                tally = {v: 1.0 for v in (-1, 0, 1)}
                for q, (*_, v) in zip(p, each, strict=True):
                    tally[v[j]] += q if c else 1 - q
                total = sum(tally.values())
                odds = [o + (1 if c else -1) * np.log(tally[v[j]] / total) for o, (*_, v) in zip(odds, each, strict=True)]
        new = [1 / (1 + np.exp(-np.clip(o, -30, 30))) for o in odds]
        if max(abs(a - b) for a, b in zip(new, p, strict=True)) < 1e-9:
            break
        p = new
    rows = []
    for _, k, s, e, v in each:
        rows.append([*np.eye(9 + 2)[k], *np.eye(len(pii.LENGTHS) + 1)[sum(e - s > n for n in pii.LENGTHS)], 0.0, *(x for w in v for x in np.eye(3)[w + 1]), 1.0])
    x = np.array(rows)
    x[:, 11 + len(pii.LENGTHS) + 1] = [s == 0 or texts[i][s - 1] == "\n" for i, k, s, e, v in each]
    beta = np.zeros(x.shape[1])
    for _ in range(3000):
        q = 1 / (1 + np.exp(-(x @ beta)))
        beta += 2.0 * (x.T @ (np.array(p) - q) / len(p) - 1e-3 * beta)
    return {(i, k, s, e) for (i, k, s, e, _), value in zip(each, x @ beta, strict=True) if k >= len(pii.KINDS) and value >= 0}


def test_whole_result_beside_a_plain_method(spark):
    """Names, addresses, dates of birth, local phones and ids among lookalikes: every span as a plain version has it."""
    texts = []
    for i in range(60):
        texts.append(f"Contact Dr. Anna Smith{'' if i % 2 else 'on'}, born 12.0{1 + i % 9}.19{60 + i % 40}, 12{i} Oak Tree Street, phone 0221 1234 56{i % 10}, mail a{i}@example.com.")
        texts.append(f"SSN 123-45-{1000 + i} and IBAN: DE89370400440532013000\nHauptstraße {i + 1}, tel. 0300 5551 234")
        texts.append(f"version 1234 567 8901{i % 10} of part 2019 06 0512, AB12ABCD{i % 10}, order 000-00-0000, born 99.99.2999")
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    want = plain_method(texts)
    names = (*pii.KINDS, *pii.MORE)
    added = {(i, names.index(k), int(s), int(e)) for i, spans in got.items() for k, s, e in (x.split(":") for x in spans.split(",") if x) if names.index(k) >= len(pii.KINDS)}
    assert added == want
    kinds = {names[k] for _, k, _, _ in added}
    assert {"name", "birth_date", "address", "national_id", "iban", "phone_local"} <= kinds
    assert not any("national_id" in got[3 * i + 2] or "birth_date" in got[3 * i + 2] for i in range(60))


def test_many_candidates_in_one_text_take_linear_time():
    import time

    began = time.process_time()
    base, more = pii.candidates("a@b.cd SSN 123-45-6789, tel 0221 1234 567; " * 30_000)
    assert len(base) == 30_000 and len(more) >= 60_000 and time.process_time() - began < 30
