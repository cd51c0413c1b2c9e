import random
from collections import defaultdict

import pytest

from trainscope.llm import suffix_dedup as S

from .helpers import AWKWARD, documents, rows, split


def brute(docs, least):
    seen = defaultdict(set)
    split_docs = {(d, t): split(t) for d, t in docs}
    for key, w in split_docs.items():
        for i in range(len(w) - least + 1):
            seen[tuple(w[i:i + least])].add(key)
    out = []
    for (d, _), w in split_docs.items():
        spans = []
        for i in range(len(w) - least + 1):
            if len(seen[tuple(w[i:i + least])]) > 1:
                if spans and spans[-1][1] >= i:
                    spans[-1][1] = i + least
                else:
                    spans.append([i, i + least])
        out += [(d, a, b, b - a) for a, b in spans]
    return sorted(out, key=str)


def corpus(seed):
    """Copies, edited copies, and passages that overlap each other in different surroundings."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(seed * 15)]
    long = rng.choices(words, k=300)
    docs = []
    for d in range(60):
        w = rng.choices(words, k=rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            a = rng.randrange(260)
            w += long[a:a + rng.randint(5, 120)] + rng.choices(words, k=rng.randint(0, 30))
        if rng.random() < 0.3 and docs:
            w = docs[-1][1].split()
            if w and rng.random() < 0.7:
                w[rng.randrange(len(w))] = "x"
        docs.append((d, " ".join(w)))
    return docs


@pytest.mark.parametrize("seed,least", [(2, 50), (40, 50), (7, 12)])
def test_passages_against_brute_force(spark, seed, least):
    docs = corpus(seed)
    got = S.repeated_passages(documents(spark, [(d, t, "en", "a", 0) for d, t in docs]).repartition(4), least)
    assert rows(got, "doc_id", "first_word", "end_word", "n_words") == brute(docs, least)


@pytest.mark.parametrize("lot", [1, 7, 64])
def test_keys_on_the_edge_of_lots(spark, lot):
    """Keys that no lot holds whole take the shuffled path, with the same result."""
    docs = corpus(3)
    got = S.repeated_passages(documents(spark, [(d, t, "en", "a", 0) for d, t in docs]).repartition(3), 50, lot)
    assert rows(got, "doc_id", "first_word", "end_word", "n_words") == brute(docs, 50)


def test_a_passage_in_a_third_of_all_documents(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(70)]
    docs = []
    for d in range(300):
        w = [f"v{rng.randrange(900)}" for _ in range(rng.randint(30, 90))]
        at = rng.randrange(len(w))
        docs.append((d, " ".join(w[:at] + passage[rng.randint(0, 9):] + w[at:] if d % 3 == 0 else w)))
    got = S.repeated_passages(documents(spark, [(d, t, "en", "a", 0) for d, t in docs]).repartition(4), 50, 16)
    assert rows(got, "doc_id", "first_word", "end_word", "n_words") == brute(docs, 50)


def test_awkward_rows(spark):
    more = [*AWKWARD, (11, "x " * 60, "en", "a", 0), (None, "x " * 70, None, None, None), (7, "wörd " * 30000, "fr", "c", 150000)]
    got = S.repeated_passages(documents(spark, more, extra=True))
    assert rows(got, "doc_id", "first_word", "end_word", "n_words") == [(11, 0, 60, 60), (None, 0, 70, 70)]
    assert S.repeated_passages(documents(spark, [])).count() == 0
