import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trainscope.llm import prefix_trie as P
from trainscope.llm.contraction import subtree_sums

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def ordered(table):
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        if conv is not None:
            text = text or ""
            convs[conv].append(((turn is not None, turn or 0, role or "", hashlib.md5(text.encode()).hexdigest()), (role or "", text)))
    return {c: [t for _, t in sorted(x)] for c, x in convs.items()}


def brute(table, every, most):
    convs = ordered(table)
    members = defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        built = convs.get(c - int(math.fmod(c, every)), [])[:h] + own[h:]  # remainders have the sign of the id, as in SQL
        for d in range(len(built) + 1):
            members[tuple(built[:d])].append((c, d == len(built)))
    kids = defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, who in members.items():
        own = (len(who) - 1) * len(path[-1][1]) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += own
    out = []
    for path, who in members.items():
        ids = ",".join(str(c) for c in sorted(c for c, end in who if end))
        out.append((min(c for c, _ in who), len(path), min(c for c, _ in members[path[:-1]]) if path else None, len(who), kids.get(path, 0),
                    leaves[path], saved[path], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, table, every, most, schema=TURNS):
    conv = F.col("conv_id")
    df = spark.createDataFrame(table, schema).repartition(5)
    got = P.prefix_trie(df, conv - conv % every, F.crc32(conv.cast("string").cast("binary")) % (most + 1), most)
    return sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("seed,every,most", [(1, 10, 5), (2, 3, 2), (3, 100, 5)])
def test_trie_against_brute_force(spark, seed, every, most):
    rng = random.Random(seed)
    table = []
    for c in range(-5, 60):
        if rng.random() < 0.85:  # some bases are absent
            for t in range(rng.choice([0, 1, 2, 3, 8, 40])):
                table.append((c, t, "ua"[t % 2], rng.choice(["x", "é", "yy", "z" * 9])))
    # A long conversation with a third of all rows, one with equal turns, and whole copies.
    table += [(71, t, "u", rng.choice("ab")) for t in range(len(table) // 2)]
    table += [(72, 3, "u", "same")] * 20 + [(73, None, None, None), (73, None, "u", "b"), (73, None, "u", "a"), (None, 1, "u", "lost")]
    table += [(c, t, "u", f"copy {t}") for c in range(200, 230) for t in range(7)]
    assert trie(spark, table, every, most) == brute(table, every, most)


def test_ends_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(P, "IDS", 7)
    table = [(c, t, "u", f"turn {t}") for c in range(100, 400) for t in range(2)]
    assert trie(spark, table, 100, 5) == brute(table, 100, 5)


def test_empty_and_clashing_columns(spark):
    assert trie(spark, [], 100, 5) == []
    assert trie(spark, [(None, 1, "u", "x")], 100, 5) == []
    wide = TURNS + ", a long, b string, depth int, id string, pos int, chars string, last string"
    table = [(1, 1, "u", None, 1, "x", 1, "x", 1, "x", "x"), (1, 2, None, "", 1, "x", 1, "x", 1, "x", "x"), (3, 1, "u", "wörd " * 30000, 1, "x", 1, "x", 1, "x", "x")]
    assert trie(spark, table, 100, 5, wide) == brute([r[:4] for r in table], 100, 5)


def sums(parents, weight):
    total = dict(weight)
    for v in sorted(parents, reverse=True):  # parents have smaller ids
        if parents[v] is not None:
            total[parents[v]] += total[v]
    return total


@pytest.mark.parametrize("shape", ["chain", "star", "comb", "random", "forest"])
def test_subtree_sums(spark, shape):
    rng, n = random.Random(5), 150
    above = {"chain": lambda v: v - 1, "star": lambda v: 0, "comb": lambda v: v - 1 if v % 2 else max(v - 2, 0),
             "random": lambda v: rng.randrange(max(0, v - 6), v), "forest": lambda v: None if v % 10 == 0 else v - 1}[shape]
    parents = {v: above(v) if v else None for v in range(n)}
    weight = {v: rng.randrange(100) for v in parents}
    kids = defaultdict(int)
    for p in parents.values():
        kids[p] += 1
    df = spark.createDataFrame([(v, p, kids[v], weight[v], 1) for v, p in parents.items()], "id long, parent long, kids long, w long, one long")
    got = {r["id"]: (r["w"], r["one"]) for r in subtree_sums(df, ["w", "one"]).collect()}
    one = sums(parents, dict.fromkeys(parents, 1))
    assert got == {v: (s, one[v]) for v, s in sums(parents, weight).items()}


def test_subtree_sums_of_nothing(spark):
    assert subtree_sums(spark.createDataFrame([], "id long, parent long, kids long, w long"), ["w"]).count() == 0
