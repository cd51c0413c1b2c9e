import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from trainscope.llm import quality as Q

from .helpers import AWKWARD, documents

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_letter_words")


def measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) for k in range(3) if windows[tuple(w[i:i + 3])] > 1}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines), "n_repeat_words": len(covered),
            "n_letter_words": sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", x)) for x in w)}


def kept(m):
    n = m["n_words"]
    return not (n < 50 or 100 * m["n_repeat_words"] > 50 * n or not 3 * n <= m["word_chars"] <= 10 * n or 10 * m["n_symbols"] > n
                or 100 * m["n_letter_words"] < 80 * n or 100 * m["n_dup_lines"] > 30 * m["n_lines"])


def texts(seed):
    rng = random.Random(seed)
    out = ["", None, "\n", "\n\na\n", "a\n\n a\na", "a", "a b", "a b c a b c", "a\r\na\r\n", "A b c a b c", "é ü # <b>", "x " * 3000]
    for _ in range(150):
        words = [rng.choice(["alpha", "Beta", "gämmä", "42", "#", "&&", "delta" * 4, f"w{rng.randrange(400)}"]) for _ in range(rng.randrange(160))]
        out.append("".join(w + rng.choice([" ", " ", " ", "\n", "\t", "  "]) for w in words))
        out.append(" ".join(rng.choice(["#", "alpha", "é", f"w{rng.randrange(900)}", f"w{rng.randrange(900)}"]) for _ in range(rng.randrange(120))).replace("# ", "", rng.randrange(60)))
        out.append("\n".join(rng.choice(["one line of it", "another line here", f"unlike {rng.random()} others all"]) for _ in range(rng.randrange(30))))
    return out


def test_measures_against_plain_python():
    given = texts(1)
    own = Q.Texts(pa.array(given, pa.string()))
    for m in MEASURES:
        assert getattr(own, m).tolist() == [measures(t)[m] for t in given], m
    empty = Q.Texts(pa.array([], pa.string()))
    assert all(len(getattr(empty, m)) == 0 for m in MEASURES)


@pytest.mark.parametrize("seed", [2, 3])
def test_verdicts_do_not_depend_on_the_order(seed):
    given = texts(seed)
    want = [kept(measures(t)) for t in given]
    assert 20 < sum(want) < len(want) - 20
    rng = random.Random(seed)
    for _ in range(6):
        rules = tuple(rng.sample(Q.RULES, len(Q.RULES)))
        report = tuple(rng.sample(MEASURES, rng.randrange(len(MEASURES))))
        got = Q.judge(pa.array(given, pa.string()), rules, report)
        assert (got["failed"] < 0).tolist() == want
        assert all(got[m].tolist() == [measures(t)[m] for t in given] for m in report)


def test_order_is_by_rejection_per_cost():
    rule = lambda name, measure: Q.Rule(name, (measure,), None)
    cheap, costly, shared = rule("cheap", "n_symbols"), rule("costly", "n_repeat_words"), rule("shared", "n_words")
    seconds = {"n_symbols": 1.0, "words": 4.0, "n_words": 1.0, "sums": 5.0, "n_repeat_words": 10.0}
    known = Q.Estimate(seconds, {frozenset(): 50, frozenset({"costly"}): 40, frozenset({"cheap"}): 5, frozenset({"shared", "costly"}): 3})
    # 5 texts a second; then 43 for 20 seconds against 3 for 5; then nothing is left for the last but it is cheap by now.
    assert [r.name for r in Q.order_rules((shared, costly, cheap), known)] == ["cheap", "costly", "shared"]
    # Texts that a rule has rejected no longer speak for the next one.
    known = Q.Estimate(seconds, {frozenset({"cheap", "costly"}): 90, frozenset({"shared"}): 10})
    assert [r.name for r in Q.order_rules((shared, costly, cheap), known)] == ["cheap", "shared", "costly"]


def test_cascade_rows(spark):
    table = AWKWARD + [(100 + i, t, "en", "a", 0) for i, t in enumerate(texts(4))]
    docs = documents(spark, table, extra=True).withColumnRenamed("v", "kept").repartition(4)
    for sample in (Q.SAMPLE, 10):
        got = Q.quality_cascade(docs, Q.RULES, ("n_words", "n_repeat_words"), sample)
        assert sorted(got.columns) == sorted({*docs.columns, "kept", "failed_rule", "n_words", "n_repeat_words"})
        rows = got.collect()
        assert len(rows) == len(table)
        for r in rows:
            m = measures(r["text"])
            assert (r["kept"], r["n_words"], r["n_repeat_words"]) == (kept(m), m["n_words"], m["n_repeat_words"])
            assert (r["failed_rule"] is None) == r["kept"]
    assert Q.quality_cascade(documents(spark, [])).count() == 0


def test_estimate_counts_every_sampled_text(spark):
    given = texts(5)
    known = Q.estimate(documents(spark, [(i, t, None, None, 0) for i, t in enumerate(given)]).repartition(3))
    assert sum(known.failures.values()) == len(given) and known.failures[frozenset()] == sum(kept(measures(t)) for t in given)
    assert set(known.seconds) == set(Q.NEEDS)
