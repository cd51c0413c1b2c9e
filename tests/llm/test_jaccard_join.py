import random

import pytest

from trainscope.llm import jaccard_join as J

from .helpers import AWKWARD, documents, rows, split


def brute(docs, k, num, den):
    sets = []
    for d, text in docs:
        w = split(text)
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(sets[i]), least.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)), key=str)


def near_copies(seed, groups=12, size=14):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs, common = [], " ".join(rng.choices(words, k=40))
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice([2, 5, 30, 60, 120]))
        for _ in range(rng.randint(1, size)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append((len(docs) * 7 % 1009, " ".join(copy) + rng.choice(["", " " + common])))
    return docs


@pytest.mark.parametrize("block", [1 << 17, 300])
def test_components_against_brute_force(spark, monkeypatch, block):
    """With small blocks every large group is split, so that its parts meet only through the second search."""
    monkeypatch.setattr(J, "BLOCK", block)
    docs = near_copies(block)
    got = J.jaccard_components(documents(spark, [(d, t, "en", "a", 0) for d, t in docs]).repartition(5), 3, 90, 100)
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute(docs, 3, 90, 100)


def test_awkward_rows_and_clashing_columns(spark):
    got = J.jaccard_components(documents(spark, AWKWARD, extra=True), 3, 90, 100)
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute([r[:2] for r in AWKWARD], 3, 90, 100)
    assert J.jaccard_components(documents(spark, []), 3, 90, 100).count() == 0


def test_sets_that_link_share_a_signature():
    import numpy as np
    rng = np.random.default_rng(2)
    for num in (80, 90):
        signatures, met = J.Signatures(num, 100), 0
        for _ in range(3000):
            n = int(rng.integers(1, 200))
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            drop = rng.random(len(a)) < rng.random() * 0.2
            b = np.unique(np.concatenate([a[~drop], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 8))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and not np.array_equal(a, b) and 100 * both >= num * (len(a) + len(b) - both):
                met += 1
                assert np.intersect1d(signatures.of(a), signatures.of(b)).size
        assert met > 100


def test_divide_skip_equals_counting():
    import numpy as np
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(80)]
    lists = J.Lists(sets)
    for num in (30, 60, 90):
        for s in sets:
            want = [i for i, r in enumerate(sets) if (b := len(np.intersect1d(s, r))) and 100 * b >= num * (len(s) + len(r) - b)]
            assert sorted(lists.search(s, num, 100)) == want


def test_pipeline_judges_each_row_by_its_own_text(spark):
    from corpus_pipeline import drop_near_copies
    base, x, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "bxo")
    table = [(3, base), (5, x), (5, base + " and"), (5, other), (5, x), (None, other.upper() + " \t"), (None, "n " + "m k l " * 9),
             (None, "N  " + "m k l " * 9), (7, "\t"), (7, None), (None, " ")] + [(9, " ".join(f"h{j}w{i}" for i in range(8))) for j in range(20)]
    docs = documents(spark, [(d, t, "en", "a", 0) for d, t in table]).repartition(4)
    got = drop_near_copies(spark, docs, "").collect()
    own = sorted(((r["doc_id"], " ".join(split(r["text"]))) for r in got), key=str)
    want = [(3, base), (5, x), (5, other), (None, "n " + "m k l " * 9), (7, ""), (7, ""), (None, "")] + table[11:]
    assert own == sorted(((d, " ".join(split(t))) for d, t in want), key=str)
