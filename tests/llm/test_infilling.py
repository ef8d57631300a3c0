"""Fill-in-middle beside a plain version by regular expressions, and beside its SQL."""

import hashlib
import random
import re

import duckdb
import pytest

from memlake.llm import infilling

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, output string, n bigint, _key int"


def plain(key, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = UNITS.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return key, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    draw = random.Random(5)
    out = [None, "", " ", "\n\n", "a", " a", "a ", "<P", "x <M> y", "P>", "<<P", "é\u3000ü\x85 \xa0 z", "\x00 \x1c \x1f", "\U0001f600 b\r\n", "<" * 50, "w " * 5000, "x" * 100_000]
    return out + ["".join(draw.choice("ab é\t\n\v<P>SM\U0001f600") for _ in range(draw.randrange(300))) for _ in range(300)]


def test_equals_plain(spark):
    rows = [(k, t, "o", 7, 1) for k, t in enumerate(texts())] + [(None, "no id at all", "o", 7, 1), (3, "same id", "o", 7, 1), (3, "same id", "o", 7, 1)]
    got = infilling.fill_in_middle(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got), key=key) == sorted((plain(r[0], r[1]) for r in rows), key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_digests_and_round_trip(spark):
    rows = [(k, t, "o", 7, 1) for k, t in enumerate(texts())]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in infilling.fill_in_middle_digests(spark.createDataFrame(rows, SCHEMA)).collect():
        assert (r.output_sha256, r.restored_sha256) == (sha(plain(r.doc_id, rows[r.doc_id][1])[5]), sha(rows[r.doc_id][1] or ""))


def test_equals_sql(spark):
    rows = [(k, t, "o", 7, 1) for k, t in enumerate(texts()) if t is None or "\x00" not in t]
    df = infilling.fill_in_middle_digests(spark.createDataFrame(rows, SCHEMA))
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [r[:2] for r in rows])
    said = con.execute(infilling.oracle())
    names = [c[0] for c in said.description]
    assert sorted(said.fetchall(), key=repr) == sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("width", [1, 63, 64, 65, 1000, 4096])
def test_ranked_bits(width):
    draw = random.Random(width)
    mask = draw.getrandbits(width) | 1 << (width - 1)
    assert [infilling.ranked_bit(mask, width, k + 1) for k in range(mask.bit_count())] == [i for i in range(width) if mask >> i & 1]


def test_other_shares_and_empty_table(spark):
    rows = spark.createDataFrame([(k, "one two three", "", 0, 0) for k in range(40)], SCHEMA)
    assert {r.form for r in infilling.fill_in_middle(rows, fim_percent=100, spm_percent=0).collect()} == {"psm"}
    assert {r.form for r in infilling.fill_in_middle(rows, fim_percent=0).collect()} == {"plain"}
    assert infilling.fill_in_middle_digests(spark.createDataFrame([], SCHEMA)).collect() == []
