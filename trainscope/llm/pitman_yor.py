"""Hierarchical Pitman-Yor language model, seated by Gibbs sampling, and scores of whole texts."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainscope.llm.common import fold, parts_of, small_batches, stored, table
from trainscope.llm.words import mix, pieces, words_of
from trainscope.session import work_path

#: Numbers for contexts and words that every task knows: the start, RARE for any other word, then the most frequent words.
LEAVES, RARE = 1 << 15, 1
#: Discount and concentration of the restaurants of contexts, and of their parent.
DISCOUNT, STRENGTH = (0.8, 0.8), (1.0, 10.0)
#: Frequent words whose counts every task holds; all others are dealt out by word.
FREQUENT = 64
#: Frequent words whose counts are added up in one task.
TOGETHER = 4
#: Tokens of one share of the vocabulary, on average; the least number of shares.
SHARE, SHARES = 1 << 20, 8
#: Sweeps that renew the numbers of tables of whole restaurants; sweeps inside one; those before samples; samples.
ROUNDS, INNER, BURN_IN, SAMPLES = 2, 2, 3, 4
#: Dealt words of the texts that a task sends on together, and the most texts of such a lot.
MESSAGE, TEXTS = 1 << 19, 1 << 15
#: Customers of one dish that are seated as a block; further ones follow in doubling lots.
BLOCK = 64

END = mix(np.array([1], np.uint64))[0]
START_CLASS = 0


# --- seating ------------------------------------------------------------------------------

class Stirling:
    """Logarithms of the generalised Stirling numbers of a discount: ways to seat c customers at t tables."""

    made: dict[float, np.ndarray] = {}

    @classmethod
    def of(cls, d: float) -> np.ndarray:
        if d not in cls.made:
            s = np.full((BLOCK + 1, BLOCK + 2), -np.inf)
            s[0, 0] = 0.0
            for c in range(BLOCK):
                t = np.arange(1, c + 2)
                join = np.log(np.maximum(c - d * t, 1e-300)) + s[c, 1:c + 2]
                s[c + 1, 1:c + 2] = np.logaddexp(s[c, :c + 1], np.where(t <= c, join, -np.inf))
            cls.made[d] = s
        return cls.made[d]


def seat(count: np.ndarray, weight: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish by one Gibbs step given everything else.

    ``count`` customers eat the dish; ``weight`` is what a new table for it weighs: concentration and
    discounted tables of the restaurant, times the parent's probability of the dish.  Up to ``BLOCK``
    customers are reseated as a block, from the exact distribution of their number of tables.
    """
    tables = np.minimum(count, 1)
    block = np.minimum(count, BLOCK)
    log_weight = np.log(np.maximum(weight, 1e-300))
    order = np.argsort(block, kind="stable")
    edges = np.searchsorted(block[order], np.arange(2, BLOCK + 2))
    for c in range(2, BLOCK + 1):
        for a in range(edges[c - 2], edges[c - 1], 1 << 14):
            at = order[a:min(edges[c - 1], a + (1 << 14))]
            score = Stirling.of(d)[c, 1:c + 1] + log_weight[at][:, None] * np.arange(1, c + 1)
            tables[at] = 1 + np.argmax(score + rng.gumbel(size=score.shape), axis=1)
    more = np.flatnonzero(count > BLOCK)
    seated = np.full(len(more), BLOCK)
    while len(more):
        lot = np.minimum(seated, count[more] - seated)
        chance = weight[more] / (weight[more] + seated + lot / 2 - d * tables[more])
        tables[more] += rng.binomial(lot, np.clip(chance, 0, 1))
        seated = seated + lot
        go = seated < count[more]
        more, seated = more[go], seated[go]
    return tables


class Totals:
    """What restaurants need to know of all dishes together: customers and tables of each, and the vocabulary.

    Of each numbered word: customers and tables in the root, how many of these customers come from
    contexts without a number, and its tokens.
    """

    SIZE = 2 * LEAVES + 4
    WORDS = SIZE + LEAVES * np.arange(4)

    def __init__(self, x: np.ndarray):
        self.leaf_c, self.leaf_t = x[:LEAVES], x[LEAVES:2 * LEAVES]
        self.root_c, self.root_t, self.words, self.tokens = x[2 * LEAVES:self.SIZE]
        self.word_c, self.word_t, self.away, self.count = x[self.SIZE:].reshape(-1, LEAVES) if len(x) > self.SIZE else np.zeros((4, LEAVES))

    @property
    def base(self) -> float:
        return 1 / (self.words + 1)


def root_p(c: np.ndarray, tables: np.ndarray, t: Totals) -> np.ndarray:
    """Probability of dishes in the root, by their customers and tables there."""
    new = (STRENGTH[1] + DISCOUNT[1] * t.root_t) * t.base
    return (np.maximum(c - DISCOUNT[1] * tables, 0) + new) / (STRENGTH[1] + t.root_c)


class Dishes:
    """The seating of some words in all restaurants; ``pairs`` are word * LEAVES + context, sorted.

    ``away`` customers of each word come to the root from restaurants that stand elsewhere.
    """

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, n_words: int, seed: int, leaves: int = LEAVES, away: np.ndarray | int = 0):
        self.pairs, self.leaf_c, self.n_words, self.leaves, self.away = pairs, counts, n_words, leaves, away
        self.rng = np.random.default_rng(seed)
        self.word, self.leaf = pairs // leaves, pairs % leaves
        self.leaf_t = np.minimum(counts, 1)
        self._up()
        self.root_t = np.minimum(self.root_c, 1)

    def _up(self) -> None:
        self.root_c = np.bincount(self.word, self.leaf_t, self.n_words).astype(np.int64) + self.away

    def root_p(self, t: Totals) -> np.ndarray:
        return root_p(self.root_c, self.root_t, t)

    def leaf_totals(self, t: Totals) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each context's restaurant."""
        return t.leaf_c, t.leaf_t

    def sweep(self, t: Totals) -> None:
        """Reseat all customers, from the contexts to their parent, given the totals of the restaurants."""
        weight = (STRENGTH[0] + DISCOUNT[0] * self.leaf_totals(t)[1][self.leaf]) * self.root_p(t)[self.word]
        self.leaf_t = seat(self.leaf_c, weight, DISCOUNT[0], self.rng)
        self._up()
        new = np.full(self.n_words, (STRENGTH[1] + DISCOUNT[1] * t.root_t) * t.base)
        self.root_t = seat(self.root_c, new, DISCOUNT[1], self.rng)

    def sums(self) -> np.ndarray:
        return np.concatenate([np.bincount(self.leaf, self.leaf_c, LEAVES), np.bincount(self.leaf, self.leaf_t, LEAVES),
                               [self.root_c.sum(), self.root_t.sum(), (self.root_c > 0).sum(), self.leaf_c.sum()]])

    def word_sums(self, number: np.ndarray, count: np.ndarray) -> np.ndarray:
        """What ``Totals`` holds of the words with a number, from where their root stands."""
        use = number != RARE
        return np.concatenate([np.bincount(number[use], x[use], LEAVES) for x in (self.root_c, self.root_t, np.zeros(len(use)), count)])

    def predict(self, asked: np.ndarray, t: Totals) -> np.ndarray:
        """Predictive probability of each pair asked for, averaged over samples of the seating."""
        total = np.zeros(len(asked))
        for _ in range(BURN_IN):
            self.sweep(t)
        for _ in range(SAMPLES):
            self.sweep(t)
            root_p = self.root_p(t)
            for a in range(0, len(asked), 1 << 17):
                total[a:a + (1 << 17)] += self._now(asked[a:a + (1 << 17)], root_p, t)
        return total / SAMPLES

    def _now(self, asked: np.ndarray, root_p: np.ndarray, t: Totals) -> np.ndarray:
        """The same under the seating as it is."""
        word, leaf = asked // self.leaves, asked % self.leaves
        c = tables = np.zeros(len(asked))
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, asked), len(self.pairs) - 1)
            there = self.pairs[at] == asked
            c, tables = np.where(there, self.leaf_c[at], 0), np.where(there, self.leaf_t[at], 0)
        leaf_c, leaf_t = self.leaf_totals(t)
        new = (STRENGTH[0] + DISCOUNT[0] * leaf_t[leaf]) * root_p[word]
        return (np.maximum(c - DISCOUNT[0] * tables, 0) + new) / (STRENGTH[0] + leaf_c[leaf])


class Restaurants(Dishes):
    """Whole restaurants of some contexts; the root stands elsewhere and gives each word's probability there."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, n_words: int, seed: int, leaves: int):
        super().__init__(pairs, counts, n_words, seed, leaves)
        self.given: np.ndarray | None = None
        self.customers = np.bincount(self.leaf, counts, leaves)

    def root_p(self, t: Totals) -> np.ndarray:
        return self.given

    def leaf_totals(self, t: Totals) -> tuple[np.ndarray, np.ndarray]:
        return self.customers, np.bincount(self.leaf, self.leaf_t, self.leaves)

    def sweep(self, t: Totals) -> None:
        weight = (STRENGTH[0] + DISCOUNT[0] * self.leaf_totals(t)[1][self.leaf]) * self.given[self.word]
        self.leaf_t = seat(self.leaf_c, weight, DISCOUNT[0], self.rng)
        self._up()


# --- tokens ---------------------------------------------------------------------------------

def _tokens(texts: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, number, number of the context, and row of every token of the texts, each text's end included."""
    words = words_of(texts)
    n = len(texts)
    sizes = np.diff(words.first)
    row = np.repeat(np.arange(n), sizes + 1)
    ends = np.cumsum(sizes + 1) - 1
    token = np.full(len(row), END)
    inner = np.ones(len(row), bool)
    inner[ends] = False
    token[inner] = words.hash
    own = _numbers(token, known)
    context = np.empty(len(row), np.int64)
    context[1:] = own[:-1]
    context[np.append(0, ends[:-1] + 1) if n else []] = START_CLASS
    return token, own, context, row


def _numbers(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return np.where(known[at] == words, 1 + RARE + at, RARE)


def _part(words: np.ndarray, parts: int) -> np.ndarray:
    return ((words >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def _frequent_words(docs: DataFrame) -> tuple[np.ndarray, int, int]:
    """Words to get a number, most frequent first, the number of tokens, and of those that are not among them.

    Which words these are decides only where a restaurant stands, so words that are rare in a task may
    be left out there, and its message is bounded: every other context has a restaurant of its own too.
    """
    def count(batches):
        word, n, tokens = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        fresh: list[np.ndarray] = []

        def merge():
            own, times = np.unique(np.concatenate([*fresh, np.zeros(0, np.uint64)]), return_counts=True)
            every, at = np.unique(np.concatenate([word, own]), return_inverse=True)
            return every, np.bincount(at, np.concatenate([n, times]), len(every)).astype(np.int64)

        for batch in batches:
            for piece in pieces(batch):
                found = words_of(piece.column("text"))
                fresh.append(found.hash)
                tokens += len(found.hash) + piece.num_rows
                if sum(map(len, fresh)) > 1 << 20:
                    word, n = merge()
                    fresh.clear()
        word, n = merge()
        use = n > tokens >> 18
        yield pa.RecordBatch.from_arrays([pa.array([None, *word[use].view(np.int64).tolist()], pa.int64()), pa.array([tokens, *n[use].tolist()], pa.int64())], ["w", "n"])

    sums = stored(docs.select("text").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "lm-words")
    top = sums.where("w is not null").orderBy(F.desc("n"), "w").limit(LEAVES - RARE - 2).collect()
    tokens = sums.where("w is null").agg(F.sum("n")).first()[0] or 0
    return np.array([r["w"] for r in top], np.int64).view(np.uint64), tokens, tokens - sum(r["n"] for r in top)


def _deal(docs: DataFrame, known: np.ndarray, frequent: np.ndarray, shares: int, others: int) -> DataFrame:
    """Tokens by share, as messages; rows of parts below 0 hold counts of some frequent words.

    After a numbered context a token goes by its word to one of the first ``shares``, after any other
    by the context to one of the ``others``, where it stands with the number of its word.
    """
    size = len(frequent) * LEAVES
    parts = shares + others

    def deal(batches):
        counts = np.zeros(size, np.int64)
        kept: list[tuple] = []
        keys: list[np.ndarray] = []
        n_kept = n_docs = n_lots = 0

        def send():
            nonlocal kept, keys, n_kept, n_docs, n_lots
            if kept:
                lot = np.array([(TaskContext.get().partitionId() << 32) + n_lots], np.int64).tobytes()
                own, part, number, doc, token = (np.concatenate(x) for x in zip(*kept))
                order = np.lexsort((own, part))
                own, part, number, doc, token = own[order], part[order], number[order], doc[order], token[order]
                out = [(KEYS - n_lots % 1024, lot, b"", np.concatenate(keys).tobytes(), b"", b"", b"", b"", b"")]
                for a, b in zip(*(np.searchsorted(part, np.arange(parts), side) for side in ("left", "right"))):
                    if b > a:
                        word, times = np.unique(own[a:b], return_counts=True)
                        out.append((int(part[a]), lot, b"", b"", word.tobytes(), times.astype(np.uint32).tobytes(),
                                    number[a:b].tobytes(), doc[a:b].tobytes(),
                                    token[a:b][number[a:b] == RARE].tobytes()))
                yield _messages(out)
            kept, keys, n_kept, n_docs, n_lots = [], [], 0, 0, n_lots + 1

        for batch in batches:
            for whole in pieces(batch):
                for i in range(0, whole.num_rows, TEXTS):
                    piece = whole.slice(i, TEXTS)
                    if n_docs + piece.num_rows > TEXTS:
                        yield from send()
                    token, number, context, row = _tokens(piece.column("text"), known)
                    train = piece.column("train").to_numpy(zero_copy_only=False)
                    at = np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)
                    rare = context == RARE
                    hot = (frequent[at] == token) & ~rare
                    use = hot & train[row]
                    counts += np.bincount(at[use] * LEAVES + context[use], minlength=size)
                    own = np.where(rare, np.roll(token, 1), token)
                    part = np.where(rare, shares + _part(own, others), _part(own, shares)).astype(np.int32)
                    number = np.where(rare, number, context).astype(np.uint16)
                    doc = (row[~hot] + n_docs + TEXTS * train[row[~hot]]).astype(np.uint16)
                    kept.append((own[~hot], part[~hot], number[~hot], doc, token[~hot]))
                    keys.append(piece.column("key").to_numpy())
                    n_docs += piece.num_rows
                    n_kept += int((~hot).sum())
                    if n_kept >= MESSAGE:
                        yield from send()
        yield from send()
        for block in range(0, len(frequent), TOGETHER):
            own = counts[block * LEAVES:(block + TOGETHER) * LEAVES]
            full = np.flatnonzero(own)
            yield _messages([(-1 - block, b"", b"", b"", full.astype(np.uint32).tobytes(), own[full].astype(np.uint64).tobytes(), b"", b"", b"")])

    return docs.select("text", "key", "train").mapInArrow(deal, _FORM)


#: Rows of parts up to this one hold the keys of the texts of a lot; from -1 down stand the counts of frequent words.
KEYS = -(1 << 16)

_FORM = "part int, lots binary, sizes binary, texts binary, words binary, times binary, contexts binary, docs binary, rares binary"


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _FORM.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i == 0 else pa.binary()) for i in range(9)], names)


class Share:
    """All tokens of one share of the words, or of the contexts without a number.

    ``texts`` are the places, within their lot, of the texts that have some of them, ``sizes`` of each
    lot; a text to learn from has ``TEXTS`` added.  ``doc`` is the index among these of each token.
    ``own`` are the words, or the contexts, ``index`` the one of each token among them, and ``number``
    that of its context, or of its word; ``rares`` are the words of tokens where this is ``RARE``.
    """

    def __init__(self, messages: list[dict]):
        self.part = messages[0]["part"]
        empty = np.zeros(0, np.int64)
        own, number, rares, lots, sizes, texts, doc = ([empty.astype(kind)] for kind in
                                                       (np.uint64, np.uint16, np.uint64, np.int64, np.int64, np.uint16, np.int32))
        n = 0
        for m in messages:
            if not m["words"]:
                continue
            own.append(np.repeat(np.frombuffer(m["words"], np.uint64), np.frombuffer(m["times"], np.uint32)))
            number.append(np.frombuffer(m["contexts"], np.uint16))
            rares.append(np.frombuffer(m["rares"], np.uint64))
            lots.append(np.frombuffer(m["lots"], np.int64))
            if m["sizes"]:  # one stored row
                sizes.append(np.frombuffer(m["sizes"], np.int64))
                texts.append(np.frombuffer(m["texts"], np.uint16))
                doc.append(np.frombuffer(m["docs"], np.int32))
            else:
                there, at = np.unique(np.frombuffer(m["docs"], np.uint16), return_inverse=True)
                texts.append(there)
                doc.append((at + n).astype(np.int32))
                sizes.append([len(there)])
                n += len(there)
        self.lots, self.sizes, self.texts, self.doc, self.number, self.rares = (np.concatenate(x) for x in (lots, sizes, texts, doc, number, rares))
        self.sizes = self.sizes.astype(np.int64)
        self.train = self.texts >= TEXTS
        self.own, self.index = np.unique(np.concatenate(own), return_inverse=True)

    def message(self) -> tuple:
        """The same as one row to store."""
        order = np.argsort(self.index, kind="stable")
        number = self.number[order]
        word = np.zeros(len(order), np.uint64)
        word[self.number == RARE] = self.rares
        return (self.part, self.lots.tobytes(), self.sizes.tobytes(), self.texts.tobytes(), self.own.tobytes(),
                np.bincount(self.index).astype(np.uint32).tobytes(), number.tobytes(), self.doc[order].tobytes(),
                word[order][number == RARE].tobytes())

    def _customers(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs and their counts in the texts to learn from."""
        return np.unique(self.pair[self.train[self.doc]], return_counts=True)

    def numbered(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of this share's part of the totals that are not zero."""
        x = self.sums()
        at = np.flatnonzero(x)
        return at.astype(np.int32), x[at]


class WordShare(Share):
    """The words of one share with all their customers in numbered contexts, and their place in the root.

    ``asks`` are the words that shares of contexts have here, with their first tables and tokens there;
    ``told`` are later tables of the same words.
    """

    def __init__(self, row: dict, known: np.ndarray):
        super().__init__([row])
        self.asks = sorted(row.get("asks") or [], key=lambda m: m["source"])
        told = sorted(row.get("told") or self.asks, key=lambda m: m["source"])
        asked = [np.frombuffer(m["at"], np.uint64) for m in self.asks]
        words = np.unique(np.concatenate([self.own, known, *asked]))
        self.index = np.searchsorted(words, self.own)[self.index]
        self.words = words
        self.asked = [np.searchsorted(words, a) for a in asked]
        self.pair = self.index * LEAVES + self.number
        away, self.count = np.zeros(len(words)), np.zeros(len(words))
        for at, ask, m in zip(self.asked, self.asks, told):
            away[at] += np.frombuffer(m["x"], np.uint32)
            self.count[at] += np.frombuffer(ask["n"], np.uint32)
        self.away = away

    def seated(self, number: np.ndarray, totals: Totals | None) -> None:
        self.word_number = number
        if totals is not None:
            use = number != RARE
            self.away[use] += totals.away[number[use]]
        pairs, counts = self._customers()
        self.count += np.bincount(pairs // LEAVES, counts, len(self.words))
        self.dishes = Dishes(pairs, counts, len(self.words), self.part, away=self.away.astype(np.int64))

    def sums(self) -> np.ndarray:
        return np.concatenate([self.dishes.sums(), self.dishes.word_sums(self.word_number, self.count)])

    def tell(self, totals: Totals | None) -> list[tuple]:
        """Answers to the shares of contexts: probability in the root, and tokens, of each word asked for."""
        if totals is None:
            return []
        p = self.dishes.root_p(totals)
        return [(m["source"], self.part, b"", p[at].astype(np.float32).tobytes(), self.count[at].astype(np.uint32).tobytes())
                for m, at in zip(self.asks, self.asked)]

    def word_count(self, totals: Totals) -> np.ndarray:
        return np.where(self.word_number != RARE, totals.count[self.word_number], self.count)


class ContextShare(Share):
    """Whole restaurants of one share of the contexts without a number."""

    def __init__(self, row: dict, shares: int, totals: Totals | None):
        super().__init__([row])
        self.told = sorted(row.get("told") or [], key=lambda m: m["source"])
        rare = np.unique(self.rares)
        place = _part(rare, shares)
        self.rare = rare[order := np.argsort(place, kind="stable")]
        self.place = place[order]
        self.numbers = np.setdiff1d(self.number, [RARE]).astype(np.int64)
        n = len(self.numbers)
        word = np.searchsorted(self.numbers, self.number)
        word[self.number == RARE] = n + np.argsort(order)[np.searchsorted(rare, self.rares)]
        self.leaves = max(len(self.own), 1)
        self.pair = word * self.leaves + self.index
        self.index = word
        self.words = np.zeros(n + len(rare))
        pairs, counts = self._customers()
        self.count = np.bincount(pairs // self.leaves, counts, len(self.words))
        self.dishes = Restaurants(pairs, counts, len(self.words), self.part, self.leaves)
        if totals is not None:
            told = [np.frombuffer(m["x"], np.float32) for m in self.told]
            known = root_p(totals.word_c, totals.word_t, totals)[self.numbers]
            # Until the root has answered, these words have as many customers there as come from here.
            other = np.concatenate(told) if told else root_p(self.dishes.root_c[n:], self.dishes.root_t[n:], totals)
            self.dishes.given = np.concatenate([known, other])

    def sums(self) -> np.ndarray:
        x = np.zeros(Totals.SIZE + 4 * LEAVES)
        if self.dishes.given is None:  # later the root counts these itself
            x[2 * LEAVES] = self.dishes.root_c.sum()
        x[Totals.SIZE - 1] = self.dishes.leaf_c.sum()
        n = len(self.numbers)
        x[Totals.WORDS[2] + self.numbers] = self.dishes.root_c[:n]
        x[Totals.WORDS[3] + self.numbers] = self.count[:n]
        return x

    def tell(self, totals: Totals | None) -> list[tuple]:
        """Tables of each word without a number, to the share where its root stands; at first with the words."""
        first = totals is None
        tables, count = self.dishes.root_c[len(self.numbers):], self.count[len(self.numbers):]
        out = []
        for p in np.unique(self.place):
            a, b = np.searchsorted(self.place, [p, p + 1])
            out.append((int(p), self.part, self.rare[a:b].tobytes() if first else b"", tables[a:b].astype(np.uint32).tobytes(),
                        count[a:b].astype(np.uint32).tobytes() if first else b""))
        return out

    def word_count(self, totals: Totals) -> np.ndarray:
        told = [np.frombuffer(m["n"], np.uint32) for m in self.told]
        return np.concatenate([totals.count[self.numbers], *told])


def _gathered(batches):
    """One row for each share, so that later jobs need not deal again; the counts of frequent words are added up."""
    kept: list[dict] = []
    part, counts = None, None

    def finished():
        if kept:
            yield _messages([Share(kept).message()])
        elif counts is not None:
            full = np.flatnonzero(counts)
            yield _messages([(part, b"", b"", b"", full.astype(np.uint32).tobytes(), counts[full].tobytes(), b"", b"", b"")])

    for batch in batches:
        for i in range(batch.num_rows):
            m = batch.slice(i, 1).to_pylist()[0]
            if m["part"] <= KEYS:
                yield batch.slice(i, 1)
                continue
            if m["part"] != part:
                yield from finished()
                kept, part, counts = [], m["part"], np.zeros(TOGETHER * LEAVES, np.uint64)
            if part < 0:
                counts[np.frombuffer(m["words"], np.uint32)] += np.frombuffer(m["times"], np.uint64)
            else:
                kept.append(m)
    yield from finished()


def _shares(batches, known: np.ndarray, frequent: np.ndarray, shares: int, totals: Totals | None):
    rest = np.setdiff1d(known, frequent)
    place = _part(rest, shares)
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if row["part"] < shares:
                share = WordShare(row, rest[place == row["part"]])
                share.seated(_numbers(share.words, known), totals)
            else:
                share = ContextShare(row, shares, totals)
            del row
            yield share
            del share


_REPLY = "place int, lots binary, sizes binary, texts binary, known binary, base binary, log_p binary, keys binary"


def _replies(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _REPLY.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i == 0 else pa.binary()) for i in range(8)], names)


def _place(lots: np.ndarray, parts: int) -> np.ndarray:
    return (mix(lots.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


# --- the model --------------------------------------------------------------------------------

_NEWS = "part int, source int, at binary, x binary, n binary"


def _news(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _NEWS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i < 2 else pa.binary()) for i in range(5)], names)


def _bucketed(rows: DataFrame, name: str, buckets: int) -> DataFrame:
    """Rows dealt into ``buckets`` by part, stored so that joins by part need not move them again."""
    own = f"{name}_{uuid.uuid4().hex}"
    rows.write.format("parquet").bucketBy(buckets, "part").option("path", work_path(rows.sparkSession, name)).saveAsTable(own)
    dealt = rows.sparkSession.table(own)
    rows.sparkSession.sql(f"DROP TABLE {own}")  # the files stay, as those of other stored results
    return dealt


def _with(dealt: DataFrame, told: DataFrame) -> DataFrame:
    """Shares with what they are told; the few rows told are hashed, so that shares need not be sorted."""
    return dealt.join(told.hint("shuffle_hash"), "part", "left")


def _by_part(news: DataFrame, column: str, buckets: int) -> DataFrame:
    """All that is told to each share as one row."""
    return news.where("part >= 0").repartition(buckets, "part").groupBy("part").agg(F.collect_list(F.struct("source", "at", "x", "n")).alias(column))


def _sweep(dealt: DataFrame, shares_of, hot: Dishes, hot_number: np.ndarray, before: Totals | None, inner: int) -> tuple[Totals, DataFrame]:
    """Totals over all dishes, and what shares tell each other, after some sweeps under the totals before."""
    def sweep(batches):
        total = np.zeros(Totals.SIZE + 4 * LEAVES)
        for share in shares_of(batches, before):
            for _ in range(inner):
                share.dishes.sweep(before)
            at, x = share.numbered()
            total[at] += x
            yield _news(share.tell(before))
            del share
        at = np.flatnonzero(total)
        yield _news([(-1, 0, at.astype(np.int32).tobytes(), total[at].tobytes(), b"")])

    def unpack(batches):
        for batch in batches:
            for m in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(m["at"], np.int32)), pa.array(np.frombuffer(m["x"], np.float64))], ["at", "x"])

    news = stored(dealt.mapInArrow(sweep, _NEWS), "lm-news")
    got = news.where("part < 0").select("at", "x").mapInArrow(unpack, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    total = np.zeros(Totals.SIZE + 4 * LEAVES)
    total[got.column("at").to_numpy()] = got.column("x").to_numpy()
    if before is None:
        total[Totals.WORDS[0]:Totals.WORDS[1]] += total[Totals.WORDS[2]:Totals.WORDS[3]]
    else:
        hot.away = before.away[hot_number].astype(np.int64)
        hot._up()
    for _ in range(inner):
        hot.sweep(before)
    total[:Totals.SIZE] += hot.sums()
    total[Totals.SIZE:] += hot.word_sums(hot_number, np.bincount(hot.word, hot.leaf_c, hot.n_words))
    return Totals(total), news


def score_texts(docs: DataFrame, learn: Column) -> DataFrame:
    """``doc_id, learned, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs(doc_id, text)``.

    Tokens are the words (without ASCII white space, A-Z as lower case) and one end; a null text has the
    end only.  Counts come from all tokens of the rows that ``learn`` admits.  ``base_score`` is the sum
    of log10((c + 0.5) / (N + 0.5 (V + 1))), ``score`` the log10 probability by the model.  Repeated rows
    count as often as they stand and get equal scores; an empty table gives no rows.

    The context of a token is the word before it, or the start, and each context has a restaurant of
    its own.  All have the same parent, that of the empty context, over a uniform base with one place
    for all unknown words.  Given the totals of customers and tables of each restaurant, words are
    seated independently.  The ``LEAVES - RARE - 2`` most frequent words have numbers, and their totals,
    as many as the numbers, go round whole.  Tokens after these are dealt out by word: a share holds all
    numbered restaurants' customers of its words, and these words' place in the root.  Tokens after any
    other word are dealt out by context, whole restaurants to a share.  What a share of contexts needs of
    the root it knows from the totals for numbered words, and asks the share of the word for the others;
    it tells that share its tables.  Shares follow the number of tokens, not the session.  ``ROUNDS`` jobs
    renew the totals; then each task averages predictive probabilities over ``SAMPLES`` sweeps.  Counts
    of the ``FREQUENT`` words after numbered ones are added up inside the tasks, so these tokens are
    never dealt.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"), F.coalesce(learn, F.lit(False)).alias("train"))
    known, tokens, rest = _frequent_words(docs)
    frequent = np.unique(np.append(known[:FREQUENT - 1], END))
    known = np.unique(np.append(known, END))
    hot_number = _numbers(frequent, known)
    parts, shares, others = parts_of(spark), max(SHARES, (tokens - rest) // SHARE), max(SHARES // 2, rest * 3 // (2 * SHARE))
    buckets = max(parts, shares + others)
    blank = spark.range(shares).select(F.col("id").cast("int").alias("part"), *(F.lit(b"").alias(x.split()[0]) for x in _FORM.split(", ")[1:]))
    messages = _deal(docs, known, frequent, shares, others).unionByName(blank).repartition(buckets, "part").sortWithinPartitions("part")
    every = _bucketed(messages.mapInArrow(_gathered, _FORM), "lm_tokens", buckets)
    counts = np.zeros(len(frequent) * LEAVES, np.int64)
    for m in every.where(f"part < 0 and part > {KEYS}").select("part", "words", "times").toLocalIterator():  # FREQUENT * LEAVES counts at most
        counts[(-1 - m["part"]) * LEAVES + np.frombuffer(m["words"], np.uint32).astype(np.int64)] = np.frombuffer(m["times"], np.uint64)
    pairs = np.flatnonzero(counts)
    hot = Dishes(pairs, counts[pairs], len(frequent), 1 << 20)
    dealt = every.where("part >= 0")

    def shares_of(batches, totals):
        return _shares(batches, known, frequent, shares, totals)

    totals, news = _sweep(dealt, shares_of, hot, hot_number, None, 0)
    dealt = _with(dealt, _bucketed(_by_part(news, "asks", buckets), "lm_asks", buckets))
    told = dealt
    for _ in range(ROUNDS):
        totals, news = _sweep(told, shares_of, hot, hot_number, totals, INNER)
        told = _with(dealt, _by_part(news, "told", buckets))
    hot.away = totals.away[hot_number].astype(np.int64)
    hot._up()

    def score(batches):
        for share in shares_of(batches, totals):
            asked, which = np.unique(share.pair, return_inverse=True)
            del share.pair
            log_p = np.log10(share.dishes.predict(asked, totals)).astype(np.float32)[which]
            del asked, which
            word_c = share.word_count(totals)[share.index]
            sums = [np.bincount(share.doc, x, len(share.texts)) for x in ((word_c > 0).astype(float), np.log10(word_c + 0.5), log_p)]
            place = _place(share.lots, parts)
            order, texts = np.argsort(place, kind="stable"), np.argsort(np.repeat(place, share.sizes), kind="stable")
            many = np.bincount(np.repeat(place, share.sizes), minlength=parts)
            x = a = 0
            out = []
            for p, n in zip(*np.unique(place, return_counts=True)):
                lots, own = order[x:x + n], texts[a:a + many[p]]
                x, a = x + n, a + many[p]
                out.append((int(p), share.lots[lots].tobytes(), share.sizes[lots].tobytes(), (share.texts[own] % TEXTS).astype(np.uint16).tobytes(),
                            *(y[own].astype(kind).tobytes() for y, kind in zip(sums, (np.uint32, np.float64, np.float32))), b""))
            yield _replies(out)
            del share

    def keys(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield _replies([(int(_place(np.frombuffer(m["lots"], np.int64), parts)[0]), m["lots"], b"", b"", b"", b"", b"", m["texts"]) for m in rows])

    def total(batches):
        told = {"lots": [], "sizes": [], "texts": [], "known": [], "base": [], "log_p": []}
        owners = []
        for batch in batches:
            for m in batch.to_pylist():
                if m["keys"]:
                    owners.append((np.frombuffer(m["lots"], np.int64)[0], np.frombuffer(m["keys"], np.int64)))
                else:
                    for name, own in told.items():
                        own.append(m[name])
        if not owners:
            return
        lots, sizes, texts, known, base, log_p = (np.frombuffer(b"".join(own), kind) for own, kind in
                                                  zip(told.values(), (np.int64, np.int64, np.uint16, np.uint32, np.float64, np.float32)))
        owners.sort(key=lambda x: x[0])
        first = np.cumsum([0, *(len(own) for _, own in owners)])
        at = np.repeat(first[np.searchsorted([lot for lot, _ in owners], lots)], sizes) + texts
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([own for _, own in owners])), *(pa.array(np.bincount(at, x, first[-1]).astype(np.float64)) for x in (known, base, log_p))],
                                         ["key", "known", "base", "log_p"])

    # The sums of one share's texts travel packed, dealt by lot, to where the keys of its texts are.
    packed = told.mapInArrow(score, _REPLY).unionByName(every.where(f"part <= {KEYS}").mapInArrow(keys, _REPLY))
    cold = packed.repartition(parts, "place").mapInArrow(total, "key long, known double, base double, log_p double")
    cold = cold.groupBy("key").agg(*(F.max(c).alias(c) for c in ("known", "base", "log_p")))  # repeated rows have equal sums

    every_pair = np.arange(len(frequent) * LEAVES)
    hot_log = np.log10(hot.predict(every_pair, totals)).astype(np.float32)
    hot_c = totals.count[hot_number]

    @F.arrow_udf("struct<n_tokens:long,known:double,base:double,log_p:double>")
    def hot_part(texts: pa.Array) -> pa.Array:
        out = []
        for piece in pieces(pa.RecordBatch.from_arrays([texts], ["text"])):
            token, _, context, row = _tokens(piece.column(0), known)
            at = np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)
            own = (frequent[at] == token) & (context != RARE)
            n = piece.num_rows
            at, place = at[own], row[own]
            out.append([np.bincount(row, minlength=n), np.bincount(place, hot_c[at] > 0, n),
                        np.bincount(place, np.log10(hot_c[at] + 0.5), n), np.bincount(place, hot_log[at * LEAVES + context[own]], n)])
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0)] * 4
        return pa.StructArray.from_arrays([pa.array(cols[0].astype(np.int64)), *(pa.array(c.astype(np.float64)) for c in cols[1:])],
                                          ["n_tokens", "known", "base", "log_p"])

    own = docs.select("doc_id", "key", "train", hot_part.asNondeterministic()(F.col("text").cast("string")).alias("hot"))
    own = own.groupBy("key", "doc_id", "train").agg(F.count("*").alias("copies"), F.max("hot").alias("hot"))
    both = own.join(cold, "key", "left")
    add_up = lambda c: F.col(f"hot.{c}") + F.coalesce(F.col(c), F.lit(0.0))
    each = math.log10(totals.tokens + 0.5 * (totals.words + 1))
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id", F.col("train").alias("learned"), F.col("hot.n_tokens").alias("n_tokens"), F.round(add_up("known")).cast("long").alias("n_known"),
        F.lit(int(totals.tokens)).cast("long").alias("train_tokens"), (add_up("base") - F.col("hot.n_tokens") * each).alias("base_score"),
        add_up("log_p").alias("score"))


def op2_pitman_yor(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those outside the fold 1 of 5."""
    scored = score_texts(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) != 1)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
