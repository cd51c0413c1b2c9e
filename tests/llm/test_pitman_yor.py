import math
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from trainscope.llm import pitman_yor as P
from trainscope.llm.common import fold
from trainscope.llm.words import words_of

from .helpers import AWKWARD, documents, split


def plain(docs):
    """Counts and the unigram score, straight from the words."""
    def learn(d):
        return d is None or crc32(str(d).encode()) % 5 != 1

    counts = Counter(w for d, t in docs if learn(d) for w in [*split(t), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in docs:
        tokens = [*split(t), None]
        out.append((d, len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)))
    return out


def check(spark, docs, got):
    got = sorted((tuple(r) for r in got.collect()), key=str)
    want = sorted(plain(docs), key=str)
    assert [r[0] for r in got] == [r[0] for r in want] and [(r[2], r[3], r[4]) for r in got] == [r[1:4] for r in want]
    assert np.allclose([r[5] for r in got], [r[4] for r in want])
    assert all(r[6] < 0 for r in got)
    return got


def test_counts_and_base_scores(spark):
    docs = [r[:2] for r in AWKWARD]
    check(spark, docs, P.score_texts(documents(spark, AWKWARD, extra=True), fold(F.col("doc_id"), 5) != 1).select("doc_id", "learned", *"n_tokens n_known train_tokens base_score score".split()))
    assert P.score_texts(documents(spark, []), F.lit(True)).count() == 0


def test_real_texts_and_perplexity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = check(spark, [tuple(r) for r in docs.select("doc_id", "text").collect()],
                P.score_texts(docs, fold(F.col("doc_id"), 5) != 1).select("doc_id", "learned", *"n_tokens n_known train_tokens base_score score".split()))
    held = [r for r in got if not r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)  # contexts help on texts not learned from


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    words, contexts = 40, np.array([0, 5, 77, P.RARE + 3, P.LEAVES - 1])
    pairs = np.unique(rng.integers(0, words, 120) * P.LEAVES + rng.choice(contexts, 120))
    dishes = P.Dishes(pairs, rng.integers(1, 200, len(pairs)), words, 1)
    totals = P.Totals(dishes.sums().astype(float))
    for _ in range(4):
        dishes.sweep(totals)
        totals = P.Totals(dishes.sums().astype(float))
    assert (dishes.leaf_t <= dishes.leaf_c).all() and (dishes.leaf_t >= 1).all()
    root = dishes.root_p(totals)
    seen = dishes.root_c > 0
    base = (P.STRENGTH[1] + P.DISCOUNT[1] * totals.root_t) * totals.base / (P.STRENGTH[1] + totals.root_c)
    assert totals.words == seen.sum() and abs(root[seen].sum() + base - 1) < 1e-9  # one place for all unknown words
    for context in [*contexts, 9]:  # 9 has no customers
        p = dishes._now(np.flatnonzero(seen) * P.LEAVES + context, root, totals)
        new = (P.STRENGTH[0] + P.DISCOUNT[0] * totals.leaf_t[context]) / (P.STRENGTH[0] + totals.leaf_c[context])
        assert abs(p.sum() + new * base - 1) < 1e-9


def test_seating_follows_the_exact_distribution():
    """Tables of 5 customers: against the sum over all seatings, customer by customer."""
    d, weight = 0.5, 0.7
    exact = {1: 1.0}
    for c in range(1, 5):
        new = Counter()
        for t, p in exact.items():
            new[t] += p * (c - d * t)
            new[t + 1] += p * weight
        exact = new
    total = sum(exact.values())
    got = Counter(P.seat(np.full(200_000, 5), np.full(200_000, weight), d, np.random.default_rng(1)).tolist())
    for t, p in exact.items():
        assert abs(got[t] / 200_000 - p / total) < 0.01


def test_every_context_has_its_own_restaurant(spark):
    """Words beyond the numbered ones, which once shared 1,024 restaurants by hash, predict only what follows them."""
    held = {i: crc32(str(i).encode()) % 5 == 1 for i in range(20_000)}
    ids = {out: iter([i for i in held if held[i] == out]) for out in (False, True)}
    n, often = 1500, [f"often{i}" for i in range(P.LEAVES)]
    first = [f"first{i}" for i in range(n)]
    then = [often[i] if i % 2 else f"then{i}" for i in range(n)]
    docs = [(next(ids[False]), " ".join(often[i:i + 1000])) for i in range(0, len(often), 1000) for _ in range(9)]
    docs += [(next(ids[False]), f"{a} {b}") for a, b in zip(first, then) for _ in range(4)]
    classes = {}
    for i, h in enumerate(words_of(pa.array([" ".join(first)])).hash.tolist()):
        classes.setdefault(((h >> 40) % 1024, i % 2), []).append(i)
    pairs = [x[:2] for x in classes.values() if len(x) > 1]
    own = [(next(ids[True]), f"{first[a]} {then[a]}") for a, _ in pairs]
    other = [(next(ids[True]), f"{first[a]} {then[b]}") for a, b in pairs]
    docs += own + other + [(next(ids[True]), "first1 unseen1 then2 unseen2")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = check(spark, docs, P.score_texts(rows, fold(F.col("doc_id"), 5) != 1).select("doc_id", "learned", *"n_tokens n_known train_tokens base_score score".split()))
    score = {r[0]: r[6] for r in got}
    assert len(pairs) > 100
    assert np.mean([score[a[0]] - score[b[0]] for a, b in zip(own, other)]) > 2  # near 0 where both share a restaurant


def test_whole_restaurants_sum_to_one():
    rng = np.random.default_rng(5)
    words, contexts = 30, 4
    pairs = np.unique(rng.integers(0, words * contexts, 70))
    shop = P.Restaurants(pairs, rng.integers(1, 100, len(pairs)), words, 1, contexts)
    shop.given = rng.dirichlet(np.ones(words))
    for _ in range(4):
        shop.sweep(None)
    assert (shop.leaf_t <= shop.leaf_c).all() and (shop.leaf_t >= 1).all()
    for context in range(contexts):
        assert abs(shop._now(np.arange(words) * contexts + context, shop.given, None).sum() - 1) < 1e-9
