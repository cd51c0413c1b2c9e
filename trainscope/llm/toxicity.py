"""Toxicity: Levenshtein automata over a trie of learned terms, and scores of their context."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainscope.llm.common import fold, small_batches, table
from trainscope.llm.words import BLANKS, pieces, words_of

#: Labelled rows of each class that terms and weights are learned from, at most.
SAMPLE = 4000
#: Terms (without the whole words beside stems), and misspellings known to be clean, that a model holds at most.
TERMS, CLEAN = 500, 5000
#: Letters of a term.
SHORTEST, LONGEST = 4, 24
#: How surely a term is not one by chance: log of the odds against.
SURE = math.log(1e7)
#: Words on each side that are the context of a hit.
CONTEXT = 6

SEPARATORS = BLANKS + b',.;:!?"()[]{}<>/\\|'
FEATURES = 3


class Automaton:
    """Words within edit distance of a term: the product of Levenshtein automata with the trie of all terms.

    A trie node and a number of edits make a state; sets of those are made deterministic as words need
    them.  A term that ends in ``$`` is a whole word; any other is a stem and accepts whatever follows.
    The same letters may be both.
    """

    def __init__(self, terms: list[str]):
        self.child: list[dict[int, int]] = [{}]
        self.term: list[dict[bool, int]] = [{}]  # edits allowed, of a stem and of a whole word
        for t in terms:
            data, stem = t.removesuffix("$").encode(), not t.endswith("$")
            node = 0
            for b in data:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.term.append({})
                node = self.child[node][b]
            n = len(data)
            self.term[node][stem] = (1 if n >= 8 else 0) if stem else (2 if n >= 9 else 1 if n >= 5 else 0)
        self.most = [0] * len(self.child)  # edits that some term below a node allows
        for node in range(len(self.child) - 1, -1, -1):
            self.most[node] = max([0, *self.term[node].values(), *(self.most[c] for c in self.child[node].values())])
        letters = sorted({b for c in self.child for b in c})
        self.letter = np.zeros(256, np.int64)  # 0: no letter of any term
        self.letter[letters] = np.arange(1, len(letters) + 1)
        self.byte = [None, *letters]
        self.known: dict[frozenset, int] = {frozenset(): 0}
        self.sets: list[frozenset] = [frozenset()]
        self.step = np.zeros((1, len(self.byte)), np.int64)
        self.ends = np.full(1, -1, np.int64)  # edits of the term that ends here
        self.stems = np.full(1, -1, np.int64)
        self.begin = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        least: dict[int, int] = {}
        work = list(pairs)
        while work:  # letters of the term that the word leaves out
            node, e = work.pop()
            if e > self.most[node] or least.get(node, 99) <= e:
                continue
            least[node] = e
            work += [(c, e + 1) for c in self.child[node].values()]
        key = frozenset(least.items())
        if key not in self.known:
            self.known[key] = len(self.sets)
            self.sets.append(key)
            for stem, into in ((False, "ends"), (True, "stems")):
                edits = [e for node, e in key if e <= self.term[node].get(stem, -1)]
                setattr(self, into, np.append(getattr(self, into), min(edits, default=-1)))
            self.step = np.vstack([self.step, np.full(len(self.byte), -1)])
        return self.known[key]

    def _next(self, state: int, letter: int) -> int:
        to = set()
        for node, e in self.sets[state]:
            to.add((node, e + 1))  # a letter too many
            for b, c in self.child[node].items():
                to.add((c, e if b == self.byte[letter] else e + 1))
        return self._state(to)

    def edits(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each word the edits to a term, or -1."""
        out = np.full(len(start), -1, np.int64)
        alive = np.flatnonzero(end > start)
        state, at = np.full(len(alive), self.begin), start[alive]
        while len(alive):
            letter = self.letter[data[at]]
            new = self.step[state, letter]
            if (new < 0).any():
                for s, c in set(zip(state[new < 0].tolist(), letter[new < 0].tolist())):
                    to = self._next(s, c)
                    self.step[s, c] = to
                new = self.step[state, letter]
            at = at + 1
            stem = self.stems[new] >= 0
            out[alive[stem]] = self.stems[new[stem]]
            over = ~stem & (at == end[alive])
            out[alive[over]] = self.ends[new[over]]
            go = (new > 0) & ~stem & ~over
            alive, state, at = alive[go], new[go], at[go]
        return out


def _stripped(words) -> tuple[np.ndarray, np.ndarray]:
    """Words without marks at their ends (up to three on each side)."""
    mark = np.zeros(256, bool)
    mark[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
    start, end = words.start.copy(), words.end.copy()
    for _ in range(3):
        start += (start < end) & mark[words.data[np.minimum(start, len(words.data) - 1)]]
        end -= (start < end) & mark[words.data[np.maximum(end - 1, 0)]]
    return start, end


def _quotes(data: np.ndarray) -> np.ndarray:
    """Places of quotation marks, by their UTF-8 bytes."""
    found = data == 0x22
    if len(data) > 2:
        a, b, c = data[:-2], data[1:-1], data[2:]
        found[:-2] |= (a == 0xE2) & (b == 0x80) & (((c >= 0x98) & (c <= 0x9F)) | (c == 0xB9) | (c == 0xBA))
        found[:-2] |= (a == 0xC2) & ((b == 0xAB) | (b == 0xBB))
    return np.flatnonzero(found)


def _features(texts: pa.Array, automaton: Automaton, clean: frozenset[bytes], spell: Counter | None = None) -> np.ndarray:
    """For each text logarithms of: weight of all hits (a misspelled one counts 0.6), of misspelled ones, and of all for each hundred words.

    A hit between quotation marks within its context counts a quarter; one with another hit in its
    context counts half as much again.
    """
    n = len(texts)
    out = np.zeros((n, FEATURES))
    words = words_of(texts, SEPARATORS)
    start, end = _stripped(words)
    edits = automaton.edits(words.data, start, end)
    hit = np.flatnonzero(edits >= 0)
    odd = hit[edits[hit] > 0]
    spelled = {int(i): words.data[start[i]:end[i]].tobytes() for i in odd}
    row_of = words.rows()
    if spell is not None:
        spell.update({w for w in spelled.values()})
        return out
    drop = np.array([spelled.get(int(i)) in clean for i in hit], bool) if len(hit) else np.zeros(0, bool)
    hit = hit[~drop]
    if not len(hit):
        return out
    row = row_of[hit]
    first, last = words.first[row], words.first[row + 1] - 1
    quotes = _quotes(words.data)
    left, right = words.start[np.maximum(hit - CONTEXT, first)], words.end[np.minimum(hit + CONTEXT, last)]
    edge = np.searchsorted(quotes, [left, words.start[hit], words.end[hit], right])
    # A separator before or after the window's words may itself be the mark.
    edge[0] = np.searchsorted(quotes, left - 3)
    edge[3] = np.searchsorted(quotes, right + 3)
    weight = np.where((edge[1] > edge[0]) & (edge[3] > edge[2]), 0.25, 1.0)
    near = np.zeros(len(hit), bool)
    close = (np.diff(hit) <= CONTEXT) & (np.diff(row) == 0)
    near[1:] |= close
    near[:-1] |= close
    weight = weight * np.where(near, 1.5, 1.0)
    exact = edits[hit] == 0
    weight = weight * np.where(exact, 1.0, 0.6)
    total = [np.bincount(row, w, n) for w in (weight, weight * ~exact, weight)]
    length = np.maximum(np.diff(words.first), 1)
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(total[0]), np.log1p(total[1]), np.log1p(100 * total[2] / length)
    return out


# --- learning -----------------------------------------------------------------------------

def _sample(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[DataFrame, int, int]:
    """Texts of up to ``SAMPLE`` labelled documents of each class (those of smallest hash), and the size of each class."""
    known = (labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("y"))
             .join(docs.select("doc_id").where(learn).distinct(), "doc_id"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most two times SAMPLE ids, so the broadcast is bounded.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null").select("text", "y")
    return texts, sizes.get(1, 0), sizes.get(0, 0)


def _counted(texts: DataFrame, gather, least: int) -> list[tuple[str, int, int]]:
    """``(what, toxic, other)``: documents of each class in which ``gather(piece)`` finds something."""
    def count(batches):
        found: dict[str, list[int]] = {}
        for batch in batches:
            for piece in pieces(batch):
                for what, y in gather(piece):
                    found.setdefault(what, [0, 0])[y] += 1
        yield pa.RecordBatch.from_pydict({"what": pa.array(found.keys(), pa.string()),
                                          "other": pa.array([v[0] for v in found.values()], pa.int64()),
                                          "toxic": pa.array([v[1] for v in found.values()], pa.int64())})

    sums = (texts.mapInArrow(count, "what string, other long, toxic long").groupBy("what")
            .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")))
    return [tuple(r) for r in sums.where(F.col("toxic") + F.col("other") >= least)
            .orderBy(F.desc(F.col("toxic") - F.col("other")), "what").limit(40 * TERMS).collect()]


def _beginnings(piece: pa.RecordBatch, only: dict[str, tuple[int, int]] | None = None):
    """The distinct words of each text as ``word$`` and the beginnings of those, with the class of the text.

    With ``only``, those of toxic texts among these, with the word that stands before the first of them.
    """
    words = words_of(piece.column("text"), SEPARATORS)
    start, end = _stripped(words)
    for i, y in enumerate(piece.column("y").to_pylist()):
        a, b = words.first[i], words.first[i + 1]
        _, one = np.unique(words.hash[a:b], return_index=True)
        seen = set()
        if only is not None and not y:
            continue
        for j in one + a:
            w = words.data[start[j]:end[j]].tobytes().decode("utf-8", "ignore")
            if SHORTEST <= len(w) <= LONGEST:
                own = {w + "$", *(w[:n] for n in range(SHORTEST, min(len(w), 12) + 1))}
                if only is not None:
                    before = int(words.hash[j - 1].view(np.int64)) if j > a else 0
                    yield from ((x, before) for x in own if x in only)
                seen |= own
        if only is None:
            yield from ((w, y) for w in seen)


def _neighbours(texts: DataFrame, only: dict[str, tuple[int, int]]) -> dict[str, int]:
    """In how many different surroundings toxic texts have each of these; copies of a text add none."""
    def gather(batches):
        for batch in batches:
            for piece in pieces(batch):
                found = set(_beginnings(piece, only))
                yield pa.RecordBatch.from_pydict({"what": pa.array([w for w, _ in found], pa.string()),
                                                  "before": pa.array([b for _, b in found], pa.int64())})

    seen = texts.mapInArrow(gather, "what string, before long").distinct().groupBy("what").count()
    return {r["what"]: r["count"] for r in seen.collect()}  # as many as ``only`` at most


def _candidates(counts: list[tuple[str, int, int]], toxic: int, other: int) -> tuple[dict[str, tuple[int, int]], float]:
    """What marks toxic documents, with its counts, and the number of surroundings that rules out chance."""
    rate = -math.log((toxic + 1) / (toxic + other + 2))
    return {w: (t, o) for w, t, o in counts if t * rate >= SURE and t / toxic >= 50 * o / max(other, 1)}, SURE / rate


def _terms(found: dict[str, int]) -> list[str]:
    """Whole words and stems out of what was found, by number of surroundings.

    A beginning is made longer as long as one longer beginning has nearly as many, so a word that stands
    alone ends as a whole word.  Beside a stem stand the whole words that it begins, for those allow more
    edits.
    """
    longer: dict[str, list[str]] = {}
    for w in found:
        longer.setdefault(w[:-1], []).append(w)
    terms = {}
    for w in sorted(found, key=len):
        if any(w.startswith(t.removesuffix("$")) for t in terms) or w[:-1] in found:
            continue
        while (more := max(longer.get(w, []), key=lambda x: (found[x], x), default=None)) and found[more] >= 0.95 * found[w]:
            w = more
        terms[w] = found[w]
    best = sorted(terms, key=lambda w: (-terms[w], w))[:TERMS]
    stems = tuple(w for w in best if not w.endswith("$"))
    return sorted({*best, *(w + "$" for w in stems), *(w for w in found if w.endswith("$") and w.startswith(stems))})


def _weights(x: np.ndarray, y: np.ndarray, ratio: float) -> np.ndarray:
    """Logistic regression with a weak ridge, by Newton; ``ratio`` is the true odds of the classes."""
    x = np.column_stack([np.ones(len(x)), x])
    ridge = np.array([1e-3] + [0.1] * FEATURES)
    w = np.zeros(FEATURES + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    own = max(y.sum(), 0.5) / max(len(y) - y.sum(), 0.5)
    w[0] += math.log(ratio / own)
    w[1:] = np.maximum(w[1:], [0, -w[1] / 4, 0])  # a hit never speaks for a text
    return w


class Model:
    """Terms, misspellings that are clean words, and weights."""

    def __init__(self, terms: list[str], clean: frozenset[bytes], weights: np.ndarray):
        self.terms, self.clean, self.weights = terms, clean, weights

    def score(self) -> Column:
        """The probability that the column ``text`` is toxic; null and empty texts get the base rate."""
        terms, clean, weights = self.terms, self.clean, self.weights
        made: list[Automaton] = []

        @F.arrow_udf("double")
        def score(texts: pa.Array) -> pa.Array:
            if not made:
                made.append(Automaton(terms))
            out = [np.zeros(0)]
            for piece in pieces(pa.RecordBatch.from_arrays([texts], ["text"])):
                z = weights[0] + _features(piece.column(0), made[0], clean) @ weights[1:]
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            return pa.array(np.concatenate(out))

        return score.asNondeterministic()(F.col("text").cast("string"))  # so that Spark runs it once a row


def learn_toxicity(docs: DataFrame, labels: DataFrame, learn: Column) -> Model:
    """A model from the documents that ``learn`` admits and ``labels(doc_id, toxic)`` marks 0 or 1.

    Terms and weights come from at most ``SAMPLE`` documents of each class, so the model does not grow
    with the input.  Labels that disagree on a document count as toxic.  Without documents of both
    classes there are no terms and every text gets the base rate (a half without any label).
    """
    small_batches(docs.sparkSession)
    texts, toxic, other = _sample(docs, labels, learn)
    if not toxic or not other:
        rate = (toxic + 0.5) / (toxic + other + 1)
        return Model([], frozenset(), np.array([math.log(rate / (1 - rate)), *[0.0] * FEATURES]))
    marked, least = _candidates(_counted(texts, _beginnings, 3), min(toxic, SAMPLE), min(other, SAMPLE))
    terms = _terms({w: n for w, n in _neighbours(texts, marked).items() if n >= least})
    own = Automaton(terms)

    def misspelled(piece):
        for i, y in enumerate(piece.column("y").to_pylist()):
            spell: Counter = Counter()
            _features(piece.column("text").slice(i, 1), own, frozenset(), spell)
            for w in spell:
                yield w.decode("utf-8", "ignore"), y

    # A misspelling that other documents have is a word of its own.
    found = _counted(texts, misspelled, 1)
    share = min(other, SAMPLE) / min(toxic, SAMPLE)
    clean = frozenset(w.encode() for w, t, o in sorted(found, key=lambda r: (-r[2], r[0])) if o and o >= t * share * 0.1)
    clean = frozenset(sorted(clean)[:CLEAN]) if len(clean) > CLEAN else clean

    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        out = [np.zeros((0, FEATURES))]
        for piece in pieces(pa.RecordBatch.from_arrays([texts], ["text"])):
            out.append(_features(piece.column(0), own, clean))
        return pa.array(np.concatenate(out).tolist(), pa.list_(pa.float64()))

    rows = texts.select("y", features("text").alias("x")).collect()
    x = np.array([r["x"] for r in rows]).reshape(-1, FEATURES)
    y = np.array([r["y"] for r in rows], float)
    return Model(terms, clean, _weights(x, y, toxic / other))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs``, and ``score`` and ``predicted``; columns of these names are replaced.

    Only the text is read.  Texts are not shuffled, and each row is scored by itself.
    """
    scored = docs.drop("score", "predicted").withColumn("score", model.score())
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the documents outside the fold 0 of 5."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = learn_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
