"""Awkward and missing rows, clashing columns, and small versions done by hand."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trainscope.llm import decontamination as D
from trainscope.llm import language_id as L
from trainscope.llm import mixing as M
from trainscope.llm import preferences as P
from trainscope.llm import sharding as S
from trainscope.llm import topk as K
from trainscope.llm import toxicity as T

from .helpers import AWKWARD, documents, rows, split


def test_mixing(spark):
    docs = documents(spark, AWKWARD + [(100 + i, "w " * (i % 17), "en", "ab"[i % 2], 0) for i in range(60)], extra=True)
    got = M.mix_sources(docs, [3, 1, 2], 1.5).collect()
    assert len(got) == len(AWKWARD) + 60
    taken, target = defaultdict(int), {}
    for r in got:
        assert r["size"] == len(split(r["text"])) and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    assert sum(target.values()) == pytest.approx(1.5 * sum(r["size"] for r in got))
    assert all(abs(taken[s] - target[s]) <= 30000 for s in target) and all(abs(taken[s] - target[s]) <= 20 for s in "ab")
    assert M.mix_sources(documents(spark, []), [3, 1, 2], 1.5).count() == 0


def least_capacity(sizes, shards):
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        middle, used, n = (low + high) // 2, 0, 1
        for s in sizes:
            n, used = (n + 1, s) if used + s > middle else (n, used + s)
        low, high = (low, middle) if n <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("segments", [1 << 14, 8])
def test_sharding(spark, monkeypatch, segments):
    monkeypatch.setattr(S, "SEGMENTS", segments)
    texts = ["x" * (i * 37 % 101) for i in range(300)] + ["copy " * 20] * 5
    docs = documents(spark, AWKWARD[:7] + [(100 + i, t, "en", "a", 0) for i, t in enumerate(texts)], extra=True)
    got = S.shard_documents(docs, 6).withColumn("h", F.xxhash64("text")).collect()
    by_text, slots, load = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        by_text[r["text"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        assert r["size"] == len((r["text"] or "").encode()) + 16
    assert all(len(s) == 1 for s in by_text.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for r in got:
        groups[r["h"]] += r["size"]
    assert max(load.values()) == least_capacity([groups[h] for h in sorted(groups)], 6)
    assert S.shard_documents(documents(spark, []), 6).count() == 0


def test_decontamination(spark):
    item = "Alpha beta gamma, delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    edited = item.replace("delta", "DELTA").replace("iota ", "").replace("xi", "psi")
    docs = documents(spark, AWKWARD + [(50, "a b c " + item + " d e f", "en", "a", 0), (51, "q " * 30 + edited, "en", "a", 0),
                                       (52, "alpha beta gamma something else altogether", "en", "a", 0)], extra=True)
    items = spark.createDataFrame([(1, item), (2, None), (None, item), (3, "x y")], "item_id long, text string")
    got = rows(D.contaminated_passages(docs, items), "doc_id", "item_id", "first_word", "last_word")
    assert got == [(50, 1, 3, 17), (51, 1, 30, 43)]
    assert D.without_contamination(docs, items).count() == len(AWKWARD) + 1
    assert D.contaminated_passages(docs, items.limit(0)).count() == 0 and D.contaminated_passages(documents(spark, []), items).count() == 0


@pytest.mark.parametrize("every", [4, 5])
@pytest.mark.parametrize("exact", [False, True])
def test_decontamination_of_thickly_edited_copies(spark, every, exact):
    item = [f"w{i}" for i in range(30)]
    edited = " ".join("x" if i % every == every - 1 else w for i, w in enumerate(item))
    table = [(50, "a b c " + edited + " d e f", "en", "a", 0)] + [(60, " ".join(item), "en", "a", 0)] * exact
    docs, items = documents(spark, table), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    want = [(50, 1, 3, 32 - (every == 5))] + [(60, 1, 0, 29)] * exact
    assert rows(D.contaminated_passages(docs, items), "doc_id", "item_id", "first_word", "last_word") == want
    assert D.without_contamination(docs, items).count() == 0


def test_decontamination_tells_copies_with_repeated_seeds_apart(spark):
    item = "the one of " + " ".join(f"w{i}" for i in range(9)) + " the one of " + " ".join(f"v{i}" for i in range(9))
    docs = documents(spark, [(1, "a " * 40 + item + " " + item + " a" * 40, "en", "a", 0)])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert rows(D.contaminated_passages(docs, items), "first_word", "last_word", "similarity") == [(40, 63, 1.0), (64, 87, 1.0)]


def test_top_k_ties_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    table = [(i, [0.5, 0.25]) for i in range(0, 300)] + [(700, None), (800, [nan, 1.0]), (900, [inf, 1.0]), (1000, [None, 1.0]), (None, [1.0, 1.0]), (1, [0.9, 0.9])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = rows(K.exact_top_k(df, F.col("vec_id") % 100 == 0, 3), "query_id", "rank", "vec_id")
    assert got == sorted(((q, n + 1, v) for q, best in ((0, (1, 1, 2)), (100, (1, 0, 1)), (200, (1, 0, 1))) for n, v in enumerate(best)), key=str)
    assert K.exact_top_k(df.limit(0), F.lit(True), 3).count() == 0


def test_languages(spark):
    more = [(100 + i, f"the {w} of and this is {w}", "en", "a", 0) for i, w in enumerate("cat dog sun sea".split())] + [
        (200 + i, f"der {w} und das ist nicht {w}", "de", "a", 0) for i, w in enumerate("hund baum berg haus".split())]
    docs = documents(spark, AWKWARD[:3] + more, extra=True)
    model = L.learn_languages(docs, F.col("doc_id") >= 100)
    got = {r["doc_id"]: r["lang_pred"] for r in L.identify_languages(docs, model).collect()}
    assert got[1] == got[2] == got[3] == "und" and all(got[100 + i] == "en" and got[200 + i] == "de" for i in range(4))
    assert L.identify_languages(docs, L.learn_languages(docs, F.lit(False))).where("lang_pred != 'und' or score != 0").count() == 0
    assert L.identify_languages(documents(spark, []), model).count() == 0


def edits(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(line[j] + 1, new[-1] + 1, line[j - 1] + (x != y)))
        line = new
    return line[-1]


def test_automaton_against_edit_distance():
    import random

    import numpy as np
    rng = random.Random(4)
    terms = ["rascal$", "scum$", "villainous$"]
    words = [w for t in terms for w in (t[:-1], *("".join(rng.choice([c, c, c, c, "", "x", c + "y"]) for c in t[:-1]) for _ in range(300)))]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    got = T.Automaton(terms).edits(data, ends - [len(w) for w in words], ends)
    limit = {"rascal": 1, "scum": 0, "villainous": 2}
    want = [min((e for t, k in limit.items() if (e := edits(w, t)) <= k), default=-1) if w else -1 for w in words]
    assert got.tolist() == want


def test_inflected_and_misspelled_forms_leave_a_term_its_edits(spark):
    forms = ["rascal"] * 8 + ["rascals", "raxcal"]
    table = [(i, f"a{i} b{i} {forms[i % 10]} c{i} d{i}", "en", "a", 0) for i in range(400)]
    table += [(i, f"a{i} b{i} fine c{i} d{i}", "en", "a", 0) for i in range(400, 1200)]
    asked = {2000: "razcal", 2001: "rscal", 2002: "rascalls", 2003: "rascally", 2004: "rapid"}
    docs = documents(spark, table + [(i, f"so {w} it is", "en", "a", 0) for i, w in asked.items()])
    labels = spark.createDataFrame([(i, int(i < 400)) for i in range(1200)], "doc_id long, toxic int")
    model = T.learn_toxicity(docs, labels, F.lit(True))
    got = dict(rows(T.score_toxicity(docs.where("doc_id >= 2000"), model), "doc_id", "predicted"))
    assert {w: got[i] for i, w in asked.items()} == {"razcal": 1, "rscal": 1, "rascalls": 1, "rascally": 1, "rapid": 0}


def test_whole_words_stand_beside_stems():
    found = {"idio": 100, "idiot": 94, "idiot$": 84, "idiots": 10, "idiots$": 10}
    assert T._terms(found) == ["idio", "idio$", "idiot$", "idiots$"]


def test_toxicity_rows(spark):
    docs = documents(spark, AWKWARD, extra=True)
    labels = spark.createDataFrame([(1, 0), (4, None), (8, 0)], "doc_id long, toxic int")
    got = T.score_toxicity(docs, T.learn_toxicity(docs, labels, F.lit(True))).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] < 0.5 and r["predicted"] == 0 for r in got)


def test_preferences(spark):
    turns = spark.createDataFrame([(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", None), (1, 1, "assistant", "no"),
                                   (2, None, None, "alone"), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in P.format_preferences(P.reply_pairs(turns)).collect()}
    assert set(got) == {0, 1, 2} and got[0]["prompt"] == "<|user|>\nhi<|end|>\n" and got[0]["n_common"] == 1
    span = got[0]["chosen_mask"][0]
    assert got[0]["chosen"][span["first"]:span["end"]] == "yes<|end|>\n" and "no" in got[0]["rejected"]
    assert got[2]["chosen"] == got[2]["rejected"] == "" and P.format_preferences(P.reply_pairs(turns.limit(0))).count() == 0
