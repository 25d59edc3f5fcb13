"""Runs of words against a plain version."""

import hashlib
import random
import zlib

import pytest

from graphtally.llm import periods
from graphtally.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_runs(w, least=12):
    """Every maximal stretch of each period, the least period of a stretch."""
    out, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((a, b, q) for (a, b), q in out.items())


def plain_row(doc_id, text, tails):
    w = (text or "").encode().split()
    n = len(w)
    if tails and doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    dropped = {x for a, b, q in runs for x in range(a + q, b)}
    kept = [x for i, x in enumerate(w) if i not in dropped]
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    top = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    lines = "".join(f"{a},{b - a},{q}\n" for a, b, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), n, n - len(kept))


def fibonacci(n):
    a, b = b"a", b"ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def words(s):
    return [bytes([x]) for x in s]


@pytest.mark.parametrize("least", [2, 12])
def test_runs_of_small_alphabets(least):
    rng = random.Random(7)
    texts = [words(fibonacci(n)) for n in (30, 89, 200)] + [words(b"a" * n) for n in (0, 1, 2, 11, 12, 13, 70)]
    texts += [[b"%d" % rng.randrange(k) for _ in range(rng.randrange(120))] for k in (1, 2, 3, 5) for _ in range(60)]
    for _ in range(60):  # stretches that repeat, repeated
        part = [b"%d" % rng.randrange(3) for _ in range(rng.randrange(1, 7))] * rng.randrange(2, 6)
        some = [b"x%d" % rng.randrange(3) for _ in range(rng.randrange(5))]
        whole = (part + some) * rng.randrange(1, 4)
        texts.append(whole[rng.randrange(3) :] + part + some + whole)
    got = periods.runs_of(texts, periods.Runs(least))
    for t, g in zip(texts, got, strict=True):
        assert g == plain_runs(t, least), t


def test_factors():
    rng = random.Random(9)
    for _ in range(60):
        t = [b"%d" % rng.randrange(3) for _ in range(rng.randrange(1, 60))]
        names = periods.np.array([t.index(x) for x in t] + [len(t)])
        s = periods.Agreements(names)
        assert [t[i:] for i in s.order if i < len(t)] == sorted((t[i:] for i in range(len(t))), key=lambda x: [t.index(y) for y in x] + [len(t)])
        size, place = periods.previous_factors(s)

        def shared(i, j):
            n = 0
            while max(i, j) + n < len(t) and t[i + n] == t[j + n]:
                n += 1
            return n

        for i in range(len(t)):
            assert size[i] == max([shared(i, j) for j in range(i)], default=0)
            assert place[i] == -1 if size[i] == 0 else place[i] < i and shared(i, int(place[i])) == size[i]


def test_rows(spark):
    rng = random.Random(11)
    rows = [(None, "a b " * 20), (1, None), (2, ""), (3, " \t\n\x0b\f\r"), (4, "la " * 12), (4, "la " * 12), (5, "é é ü " * 9), (6, "x" * 5000 + " y"), (-7, "tick tock " * 3000 + "stop " + "tick tock " * 10)]
    rows += [(100 + i, " ".join(rng.choice(("ab", "cd", "ef")) for _ in range(rng.randrange(200)))) for i in range(60)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, n_runs int, start string, period int")
    for tails in (False, True):
        got = periods.periodic_runs(df, tails=tails).collect()
        assert sorted(map(tuple, got), key=str) == sorted((plain_row(*r, tails) for r in rows), key=str)
    assert periods.periodic_runs(df.limit(0)).count() == 0


def test_over_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((plain_row(r.doc_id, r.text, True) for r in docs), key=str)
    got = sorted(map(tuple, QUERIES["op13_lpf_runs"](spark, SF).collect()), key=str)
    assert got == want and sum(r[1] for r in got) > 20
