"""Quality rules as a short-circuit cascade, ordered by rejection per cost."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainscope.llm.common import small_batches, table
from trainscope.llm.words import BLANKS, Powers, mix, pieces, text_bytes

#: Rows, about, on which cost and selectivity are estimated.  They decide the order of the rules and never a verdict.
SAMPLE = 20000
SYMBOLS = b"#*$%&|<>"

_BASE = np.uint64(0xD6E8FEB86659FD93)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _among(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_BLANK, _SYMBOL = _among(BLANKS), _among(SYMBOLS)
_LETTER = _among(bytes(b for b in range(256) if b >= 0x80 or chr(b).isalpha()))
_START = _among(bytes(b for b in range(256) if b & 0xC0 != 0x80))  # first bytes of code points


class Texts:
    """Some texts taken apart once, case kept; each measure is an array with one number a text."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = text_bytes(texts)
        self.n = len(texts)

    def _per_text(self, marked: np.ndarray) -> np.ndarray:
        """How many of the marked byte positions lie in each text."""
        return np.diff(np.searchsorted(marked, self.offsets))

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """First and end byte of every word."""
        blank, n = _BLANK[self.data], len(self.data)
        before, after = np.ones(n + 1, bool), np.ones(n + 1, bool)
        before[1:] = blank
        before[self.offsets] = True
        after[:n] = blank
        after[self.offsets] = True
        return np.flatnonzero(~blank & before[:n]), np.flatnonzero(~blank & after[1:]) + 1

    @cached_property
    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    @cached_property
    def _sums(self) -> np.ndarray:
        up, _ = Powers.to(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[:len(self.data)], out=total[1:])
        return total

    def _hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit name for the bytes between each start and end, wherever they stand."""
        _, down = Powers.to(len(self.data) + 1)
        return mix((self._sums[end] - self._sums[start]) * down[start])

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """The text of every line that holds a word, and the line's name with its text."""
        breaks = np.flatnonzero(self.data == 10)
        start = np.union1d(self.offsets[:-1], breaks + 1)
        end = np.append(start[1:], len(self.data))
        end = end - ((end > start) & (np.append(self.data, 0)[np.maximum(end, 1) - 1] == 10))
        first = np.searchsorted(self.words[0], start)
        worded = first < np.searchsorted(self.words[0], end)
        start, end = start[worded], end[worded]
        text = np.searchsorted(self.offsets, start, "right") - 1
        return text, mix(self._hash(start, end) + mix(text.astype(np.uint64) + np.uint64(1)))

    @cached_property
    def n_words(self) -> np.ndarray:
        return self._per_text(self.words[0])

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self._per_text(np.flatnonzero(_START[self.data] & ~_BLANK[self.data]))

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._per_text(np.flatnonzero(_SYMBOL[self.data]))

    @cached_property
    def n_letter_words(self) -> np.ndarray:
        """Words with an ASCII letter or any character beyond ASCII."""
        before = np.concatenate([[0], np.cumsum(_LETTER[self.data])])
        start, end = self.words
        return np.bincount(self.text_of_word[before[end] > before[start]], minlength=self.n)

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self.lines[0], minlength=self.n)

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        text, name = self.lines
        _, first = np.unique(name, return_index=True)
        return np.bincount(text, minlength=self.n) - np.bincount(text[first], minlength=self.n)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words that lie in a window of three words which the text has more than once."""
        start, end = self.words
        text, h = self.text_of_word, self._hash(start, end)
        at = np.flatnonzero(text[2:] == text[:-2]) if len(h) > 2 else np.zeros(0, int)
        name = mix((h[at] * _BASE + h[at + 1]) * _BASE + h[at + 2] + mix(text[at].astype(np.uint64) + np.uint64(1)))
        _, place, times = np.unique(name, return_inverse=True, return_counts=True)
        at = at[times[place] > 1]
        covered = np.zeros(len(h), bool)
        for i in range(3):
            covered[at + i] = True
        return np.bincount(text[covered], minlength=self.n)


#: What each measure needs before it; a rule is charged for what no rule before it has computed.
NEEDS = {"words": (), "lines": ("words", "sums"), "sums": (), "n_words": ("words",), "word_chars": (), "n_symbols": (),
         "n_letter_words": ("words", "n_words"), "n_lines": ("lines",), "n_dup_lines": ("lines",),
         "n_repeat_words": ("words", "n_words", "sums")}
_ATTRIBUTE = {"sums": "_sums"}


class Rule(NamedTuple):
    """A text fails the rule where ``fails`` says so of its measures."""

    name: str
    measures: tuple[str, ...]
    fails: Callable[..., np.ndarray]


#: Limits as in public filters of web text: length, mean word length, symbols a word, words with letters, repeated lines and windows.
RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 50),
    Rule("repeated_windows", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 50 * n),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c < 3 * n) | (c > 10 * n)),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    Rule("letters", ("n_letter_words", "n_words"), lambda a, n: 100 * a < 80 * n),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: 100 * d > 30 * n),
)


class Estimate(NamedTuple):
    """Seconds of each measure over the sample, and how many sampled texts fail exactly each set of rules."""

    seconds: dict[str, float]
    failures: dict[frozenset[str], int]


def _chain(measures: Iterable[str]) -> list[str]:
    """The measures with all they need, each after its needs."""
    out: list[str] = []
    for m in measures:
        for x in (*_chain(NEEDS[m]), m):
            if x not in out:
                out.append(x)
    return out


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> Estimate:
    """Cost and selectivity of the rules on about ``sample`` rows of ``docs(text)``, drawn over all of them.

    The sampled texts stay in their tasks.  What comes back is one number for each measure and one for
    each set of rules that some text fails.
    """
    rows = docs.count()
    if rows > sample:
        docs = docs.sample(fraction=sample / rows, seed=7)
    asked = _chain(m for r in rules for m in r.measures)

    def measure(batches):
        seconds = dict.fromkeys(asked, 0.0)
        failures: dict[int, int] = {}
        for batch in batches:
            for piece in pieces(batch):
                texts = Texts(piece.column(0))
                for m in asked:
                    begun = time.perf_counter()
                    getattr(texts, _ATTRIBUTE.get(m, m))
                    seconds[m] += time.perf_counter() - begun
                mask = sum((r.fails(*(getattr(texts, m) for m in r.measures)).astype(np.int64) << i for i, r in enumerate(rules)),
                           np.zeros(texts.n, np.int64))
                for x, n in zip(*(a.tolist() for a in np.unique(mask, return_counts=True))):
                    failures[x] = failures.get(x, 0) + n
        yield pa.RecordBatch.from_pydict({
            "measure": pa.array([*seconds, *[None] * len(failures)], pa.string()),
            "failed": pa.array([*[0] * len(seconds), *failures], pa.int64()),
            "amount": pa.array([*seconds.values(), *map(float, failures.values())], pa.float64())})

    found = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(measure, "measure string, failed long, amount double")
             .groupBy("measure", "failed").agg(F.sum("amount").alias("amount")).collect())
    return Estimate({r["measure"]: r["amount"] for r in found if r["measure"]},
                    {frozenset(x.name for i, x in enumerate(rules) if r["failed"] >> i & 1): int(r["amount"]) for r in found if not r["measure"]})


def order_rules(rules: tuple[Rule, ...], known: Estimate) -> tuple[Rule, ...]:
    """The rules, most rejection per cost first.

    Each next rule is judged on the sampled texts that all before it have passed, and charged only for
    measures that none of them has computed.  Rules that reject none of those come last, cheapest first.
    """
    left, done, passed, out = list(rules), set(), dict(known.failures), []
    while left:
        def worth(rule: Rule) -> tuple:
            cost = sum(known.seconds.get(m, 0.0) for m in _chain(rule.measures) if m not in done) + 1e-9
            rejected = sum(n for failed, n in passed.items() if rule.name in failed)
            return -rejected / cost, cost, rule.name

        best = min(left, key=worth)
        left.remove(best)
        out.append(best)
        done.update(_chain(best.measures))
        passed = {failed: n for failed, n in passed.items() if best.name not in failed}
    return tuple(out)


def judge(texts: pa.Array, rules: tuple[Rule, ...], report: tuple[str, ...]) -> dict[str, np.ndarray]:
    """``failed``: the place of the first rule in the cascade that a text fails, -1 for none; and the reported measures.

    A measure is computed when the first rule asks for it, and only over texts that are still in: once
    half have gone, those left are taken apart anew without the others.
    """
    n = len(texts)
    failed, values = np.full(n, -1, np.int64), {m: np.zeros(n, np.int64) for m in report}
    have = {m: np.zeros(n, bool) for m in report}
    own, rows = Texts(texts), np.arange(n)
    for place, rule in enumerate(rules):
        live = failed[rows] < 0
        if not live.any():
            break
        if 2 * live.sum() <= len(rows):
            rows = rows[live]
            own, live = Texts(texts.take(pa.array(rows))), np.ones(len(rows), bool)
        out = rule.fails(*(getattr(own, m) for m in rule.measures))
        failed[rows[live & out]] = place
        for m in report:
            if m in rule.measures:
                values[m][rows], have[m][rows] = getattr(own, m), True
    for m in report:  # what is asked for every text and was cut short by the cascade
        rest = np.flatnonzero(~have[m])
        if len(rest):
            own = own if np.array_equal(rows, rest) else Texts(texts.take(pa.array(rest)))
            rows = rest
            values[m][rest] = getattr(own, m)
    return {"failed": failed, **values}


def quality_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, report: tuple[str, ...] = (), sample: int = SAMPLE) -> DataFrame:
    """All columns of ``docs``, ``kept``, ``failed_rule`` and the measures in ``report``; columns of these names are replaced.

    ``kept`` is true for texts that pass every rule, whatever the order.  ``failed_rule`` names the
    first rule of the cascade that rejects the text, so it depends on the measured order; null if kept.
    A null or empty text has no words and no lines.  Rows are judged one by one: repeated rows and
    rows without id like others.  An empty table gives no rows.  Lines and windows are compared by 64-bit
    hashes within their text.

    The order comes from ``estimate`` on a sample.  Only the text goes to the Python side, and no row
    is shuffled.
    """
    small_batches(docs.sparkSession)
    if "text" not in docs.columns:
        raise ValueError("docs has no column text")
    ordered = order_rules(rules, estimate(docs, rules, sample))
    names = [r.name for r in ordered]
    form = ", ".join(["kept: boolean", "failed_rule: string", *(f"{m}: long" for m in report)])

    @F.arrow_udf(f"struct<{form}>")
    def verdict(texts: pa.Array) -> pa.Array:
        out = []
        for piece in pieces(pa.RecordBatch.from_arrays([texts], ["text"])):
            got = judge(piece.column(0), ordered, report)
            columns = [pa.array(got["failed"] < 0), pa.array([names[i] if i >= 0 else None for i in got["failed"]], pa.string())]
            out.append(pa.StructArray.from_arrays([*columns, *(pa.array(got[m], pa.int64()) for m in report)], ["kept", "failed_rule", *report]))
        kind = pa.struct([("kept", pa.bool_()), ("failed_rule", pa.string()), *((m, pa.int64()) for m in report)])
        return pa.concat_arrays(out) if out else pa.array([], kind)

    found = "verdict_of_cascade"
    while found in docs.columns:
        found += "_"
    judged = docs.withColumn(found, verdict.asNondeterministic()(F.col("text").cast("string")))  # so that Spark runs it once a row
    new = ["kept", "failed_rule", *report]
    return judged.select(*(c for c in docs.columns if c not in new), *(F.col(found)[c].alias(c) for c in new))


def op12_quality_cascade(spark, sf_dir: str) -> DataFrame:
    """Every document with its measures and the verdict of the cascade; ``few_words`` and ``repeated_windows`` are the base rules."""
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = quality_cascade(table(spark, sf_dir, "documents"), RULES, measures)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *measures, base.alias("base_failed"), "kept")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
p AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
g AS (
  SELECT r, i, word, lead(word, 1) OVER o AS second, lead(word, 2) OVER o AS third FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
t AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, second, third) AS times FROM g WHERE third IS NOT NULL),
c AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM t, (VALUES (0), (1), (2)) AS x(k) WHERE times > 1 GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
f AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT w.r, doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS BIGINT) AS n_letter_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN f ON f.r = w.r LEFT JOIN c ON c.r = w.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       base_failed,
       NOT (base_failed OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_symbols > n_words
            OR 100 * n_letter_words < 80 * n_words OR 100 * n_dup_lines > 30 * n_lines) AS kept
FROM b
"""
