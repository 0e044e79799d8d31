import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewell.llm import neardup as N
from tracewell.llm import splits as P

SCHEMA = "field int, key string, text string, n int, c1 string"


def brute(rows, least, same=lambda a, b: True):
    got = set()
    bags = [(f, k, t.lower().split()) for f, k, t in rows if k and t and t.split()]
    for i, (f, k, a) in enumerate(bags):
        for g, m, b in bags[:i]:
            if f == g and k != m and same(k, m) and N.bag_overlap(a, b) >= least:
                got.add((f, min(k, m), max(k, m)))
    return got


def texts(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        base = [r.choice(vocab) for _ in range(r.choice([3, 12, 30, 90]))]
        out.append((i % 2, f"k{i}", " ".join(base)))
        for j in range(r.randrange(3)):
            w = list(base)
            for _ in range(r.randrange(1, 1 + len(w) // 6 + 1)):
                w[r.randrange(len(w))] = r.choice(vocab)
            if r.random() < 0.5:
                r.shuffle(w)
            out.append((i % 2, f"k{i}-{j}", " ".join(w)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = texts(seed)
    extra = [(0, "k0", rows[0][2]), (0, None, "a b"), (0, "e", ""), (0, "n", None), (1, "b", "   "), (1, "z", "!!")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + extra], SCHEMA)
    got = {tuple(r) for r in N.key_pairs(*N.near_duplicates(df, 0.7)).collect()}
    assert got == brute(rows, 0.7)


def test_large_blocks_and_cells(spark, monkeypatch):
    # All texts share their rarest words, so that leaves, boxes and cells are used.
    r = random.Random(5)
    rows = [(0, f"k{i:03}", "rare1 rare2 " + " ".join(f"w{r.randrange(40)}" for _ in range(10))) for i in range(260)]
    want = brute(rows, 0.7)
    df = spark.createDataFrame([(*x, 1, "x") for x in rows], SCHEMA)
    assert {tuple(x) for x in N.key_pairs(*N.near_duplicates(df, 0.7)).collect()} == want
    monkeypatch.setattr(N, "CELL", 40)
    assert {tuple(x) for x in N.key_pairs(*N.near_duplicates(df, 0.7)).collect()} == want


def test_copies(spark):
    rows = [(0, f"k{i:03}", "one two three four") for i in range(N.EXPAND + 6)] + [(0, "near", "one two three four five")]
    got = N.key_pairs(*N.near_duplicates(spark.createDataFrame([(*x, 1, "x") for x in rows], SCHEMA), 0.7))
    c = Counter(x for r in got.collect() for x in (r.key_a, r.key_b))
    assert c["k000"] == N.EXPAND + 6 and all(c[k] >= 1 for _, k, _ in rows)


def test_many_of_equal_words(spark):
    # More keys of one bag than EXPAND, in several orders: only equal texts are copies.
    w = "one two three four five six".split()
    rows = [(0, f"k{i:03}", " ".join(w[i % 2 :] + w[: i % 2])) for i in range(N.EXPAND + 6)] + [(0, "near", "one two three four five six seven")]
    got = {tuple(r) for r in N.key_pairs(*N.near_duplicates(spark.createDataFrame([(*x, 1, "x") for x in rows], SCHEMA), 0.7)).collect()}
    assert got == brute(rows, 0.7)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert N.key_pairs(*N.near_duplicates(df, 0.7)).count() == 0
    empty = spark.createDataFrame([], "key string, train boolean, text string")
    assert P.key_links(*P.cross_split(empty, 0.75)).count() == 0


@pytest.mark.parametrize("cell", [4000, 3])
def test_cross_split(spark, monkeypatch, cell):
    monkeypatch.setattr(P, "CELL", cell)
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(50):
        w = [r.choice(vocab) for _ in range(30)]
        rows.append((f"a{i}", True, " ".join(w)))
        v = list(w)
        for _ in range(r.randrange(6)):
            v[r.randrange(30)] = r.choice(vocab)
        rows.append((f"b{i}", False, " ".join(v).upper()))
    rows += [("a0", True, rows[0][2]), ("c", False, rows[0][2]), ("n", None, rows[0][2]), (None, True, "x"), ("e", False, ""), ("m", True, None)]
    df = spark.createDataFrame(rows, "key string, train boolean, text string")
    got = {(x.train_key, x.other_key) for x in P.key_links(*P.cross_split(df, 0.75)).collect()}
    bags = {(k, t): s.lower().split() for k, t, s in rows if k and t is not None and s}
    want = {(a, b) for (a, s), x in bags.items() if s for (b, t), y in bags.items() if not t and N.bag_overlap(x, y) >= 0.75}
    assert got == want


def linked(spark, rows):
    df = spark.createDataFrame(rows, "key string, train boolean, text string")
    return {(x.train_key, x.other_key): x for x in P.key_links(*P.cross_split(df, 0.75)).collect()}


def test_cross_split_without_common_chunks(spark):
    # Edits spread over a text until just above the overlap asked for, and other orders of its words.
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(900)]
    rows, want, low = [], set(), 0
    for i in range(150):
        w = [r.choice(vocab) for _ in range(32)]
        v = list(w)
        if i % 3 == 0:
            v = [x for j, x in enumerate(w) if j % 4 != 1]  # every fourth word is gone
        elif i % 3 == 1:
            for j in range(2, 32, 8):
                v[j] = f"x{i}y{j}"
        else:
            r.shuffle(v)
        rows += [(f"a{i}", True, " ".join(w)), (f"b{i}", False, " ".join(v))]
        want.add((f"a{i}", f"b{i}"))
        part = sum(k * min(n, Counter(P.chunks_of(v))[c, k]) for (c, k), n in Counter(P.chunks_of(w)).items()) / len(w)
        low += part < P.SHARE
    assert low >= 20 and set(linked(spark, rows)) == want


def test_cross_split_other_order(spark):
    # Two training records of equal words: each keeps its own chunks, and each is linked with what copies it.
    w = [f"w{i}" for i in range(30)]
    v = list(w)
    random.Random(3).shuffle(v)
    near = [*v[:28], "x1", "x2"]
    got = linked(spark, [("a", True, " ".join(w)), ("b", True, " ".join(v)), ("c", False, " ".join(w)), ("d", False, " ".join(v)), ("e", False, " ".join(near))])
    assert set(got) == {(x, y) for x in "ab" for y in "cde"}
    assert all(got[p].part_train == got[p].part_other == got[p].overlap == 1 for p in (("a", "c"), ("b", "d")))
    assert got["a", "d"].part_other == got["b", "c"].part_other < 0.5 and got["b", "e"].part_other > 0.8 > got["a", "e"].part_other


def test_sides(spark):
    rows = [("a", " TRAIN ", "x"), ("b", "Test", "x"), ("c", None, "x"), ("d", "  ", "x"), ("e", "heldout", None)]
    got = {(r.key, r.train) for r in P.task_sides(spark.createDataFrame(rows, "id string, split string, prompt string")).select("key", F.col("train")).collect()}
    assert got == {("a", True), ("b", False), ("e", False)}
