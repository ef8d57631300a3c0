import random

import pytest

from memlake.llm import near_dup

SCHEMA = "doc_id bigint, text string, n bigint, fp string"


def brute(rows, width=2, percent=80):
    sets, comp = {}, {}
    for d, t, *_ in rows:
        words = (t or "").encode().lower().split()
        w = min(width, len(words))
        sets[d] = {tuple(words[i : i + w]) for i in range(len(words) - w + 1)} if words else set()
        comp[d] = d

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(d for d in sets if d is not None)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return sorted((d, len(sets[d]), root(d), root(d) == d) for d in ids)


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out, texts = [], []
    for i in range(n):
        roll = rng.random()
        if texts and roll < 0.5:
            words = list(rng.choice(texts))
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif roll < 0.7:
            words = [*[rng.choice(vocabulary) for _ in range(rng.randrange(1, 30))], *passage]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 250))]
        texts.append(words)
        out.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words), 0, "x"))
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("width", [2, 5])
def test_equals_brute_force(spark, seed, width, monkeypatch):
    monkeypatch.setattr(near_dup, "SHORT", (1, 4, 32)[seed])
    rows = corpus(seed)
    rows += [(1000, None, 0, ""), (1001, "", 0, ""), (1002, "  \n", 0, ""), (1003, "one", 0, ""), (1004, "ONE", 0, ""), (1005, "two words", 0, ""), (1006, "é É", 0, "")]
    got = near_dup.find_near_duplicates(spark.createDataFrame(rows, SCHEMA), width=width).collect()
    assert sorted(map(tuple, got)) == brute(rows, width)


def test_chain_in_a_large_group(spark):
    """Each text is near the next one only, so that the component hangs on links between members that aren't the list's first."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100]), 0, "") for i in range(60)]
    rows += [(i + 100, rows[5][1], 0, "") for i in range(50)]
    got = near_dup.find_near_duplicates(spark.createDataFrame(rows, SCHEMA), width=2).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert {r.component_id for r in got} == {r[2] for r in brute(rows)}


@pytest.mark.parametrize("shared", [33, 37])
def test_borderline_pair_with_an_unlucky_sketch(spark, shared):
    """Similarity 0.8 exactly, one set within the other; of the 64 smallest values both hold only so many."""
    words = sorted((f"w{i}" for i in range(1250)), key=lambda w: near_dup.shingles(w, 1)[0])
    low, rest = words[:64], words[64:]
    both = low[:shared] + rest[: 1000 - shared]
    df = spark.createDataFrame([(1, " ".join(both), 0, ""), (2, " ".join(words), 0, ""), (3, "other words", 0, "")], SCHEMA)
    assert {r.doc_id: r.component_id for r in near_dup.find_near_duplicates(df, width=1).collect()} == {1: 1, 2: 1, 3: 3}


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d", 0, ""), (None, "a b c d", 0, ""), (3, "a b c d", 0, ""), (3, "a b c d", 0, ""), (4, "A b c d", 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = near_dup.find_near_duplicates(df, width=2).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (3, 3, True), (3, 3, True), (4, 3, False)]
    kept = near_dup.keep_one_of_each(df, width=2)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 3]


def test_empty_table(spark):
    assert near_dup.find_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("share", [0.6, 0.8, 0.87])
def test_a_common_passage_makes_no_pairs(spark, share, monkeypatch):
    """Texts that are mostly one passage, but too little of it to be near one another, meet no one; nearer ones still do."""
    monkeypatch.setattr(near_dup, "SHORT", 1)
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(int(200 * share))]
    rows = [(i, " ".join([*passage, *(f"u{i}x{k}" for k in range(200 - len(passage)))]), 0, "") for i in range(60)]
    near = rows[7][1].split()
    near[150:153] = ["a", "b", "c"]
    rows += [(100, " ".join(near), 0, ""), (101, " ".join(rng.sample(passage, 20)), 0, "")]
    met = []
    within = near_dup._within_reach
    monkeypatch.setattr(near_dup, "_within_reach", lambda *x: met.append(within(*x).count()) or within(*x))
    got = near_dup.find_near_duplicates(spark.createDataFrame(rows, SCHEMA), width=1).collect()
    assert sorted(map(tuple, got)) == brute(rows, 1)
    assert sum(met) <= 2


def test_reach_loses_no_pair(spark):
    """Every pair at the similarity that shares a value stays, whichever of the two is smaller and in the largest component."""
    rng = random.Random(12)
    sets = [sorted(rng.sample(range(40), rng.randrange(8, 30))) for _ in range(80)]
    for i in range(0, 80, 2):
        sets[i + 1] = sorted({*sets[i], *rng.sample(range(40), rng.randrange(0, 4))} - set(rng.sample(sets[i], rng.randrange(0, 3))))
    place, want = [], set()
    comp = [rng.randrange(3) for _ in sets]
    for i, s in enumerate(sets):
        n = len(s)
        place += [(v, i, n, at, comp[i]) for at, v in enumerate(s) if at <= n - -(-n * 80 // 100)]
        for j in range(i):
            if comp[i] != comp[j] and 100 * len(set(s) & set(sets[j])) >= 80 * len(set(s) | set(sets[j])):
                want.add((j, i))
    df = spark.createDataFrame(place, "v bigint, id bigint, n bigint, at bigint, c bigint")
    got = {tuple(sorted((r.a, r.b))) for r in near_dup._within_reach(df, near_dup._open_lists(df), 80).collect()}
    assert want and want <= got
