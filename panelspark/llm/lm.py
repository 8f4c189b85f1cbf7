"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

The most frequent words are put into classes by their left neighbours; P(word | context) = P(class | context) P(word | class, context),
both softmaxes over hashed features of the context: word before, the two words before, and the word before those (skip).
All other words share one class. They are leaves of a tree by the digits of their hash, and every digit is a softmax over hashed
features of the same contexts; words of one leaf, a handful, are told apart by their exact corpus counts, and words never seen have a
share of their own. Offsets are log frequencies, so weights of zero are the smoothed unigram model. Training makes one pass over all training documents in rounds: workers take gradient steps on
their rows from the same weights, the changes of each weight row are averaged over the workers that touched it.

Words are known by 64-bit hashes. Counts cover the whole corpus and stay in tables; only the most frequent words go to tasks,
and counts of others are joined to the documents that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.tables import saved
from panelspark.llm.words import mix, slices, words

#: Words of the model: CLASSES times WIDTH at most, the end of a text among them.
CLASSES, WIDTH = 32, 64
#: Words whose counts go to every task (16 bytes each).
HEAD = 1 << 18
#: Rows of the hashed weight tables of classes and of words in classes; up to 2**16, which ``_step`` sorts by.
ROWS_CLASS, ROWS_WORD = 1 << 13, 1 << 14
#: Bits of a digit of the tree, digits at most (fewer for small corpora), and rows of its hashed weight table.
BITS, DIGITS, ROWS_TREE = 4, 4, 1 << 16
#: Rounds of one pass, workers of a round, and step size.
ROUNDS, WORKERS, STEP = 2, 24, 0.08
#: Smoothing of the unigram base.
ADD = 0.1
#: Columns of the neighbour counts that classes are made from.
NEIGHBOURS = 64
#: Words whose counts a task holds before it hands them on, about.
COUNTED = 1 << 20
END, BEFORE = np.uint64(0x0E0D0E0D0E0D0E0D), np.uint64(0x0B0E0B0E0B0E0B0E)
_CHUNK = 8192
#: Numbers that are worked on at once, about; they stay close to the processor.
_FLOATS = 1 << 18


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a run of texts, each with an end; the text of each; the one before and the one before that."""
    w = words(data, bounds, lower=True)
    n = len(w)
    counts = w.counts()
    tok = np.full(len(w.hashes) + n, END, np.uint64)
    tok[np.arange(len(w.hashes)) + np.repeat(np.arange(n), counts)] = w.hashes
    owner = np.repeat(np.arange(n), counts + 1)
    first = np.cumsum(counts + 1) - counts - 1
    one, two = np.full(len(tok), BEFORE, np.uint64), np.full(len(tok), BEFORE, np.uint64)
    one[1:], two[2:] = tok[:-1], tok[:-2]
    one[first] = two[first] = BEFORE
    after = first[counts > 0] + 1
    two[after] = BEFORE
    return tok, owner, one, two


@dataclass
class Model:
    """Vocabulary, frequencies and weights; ``words`` are sorted hashes of the model's words."""

    words: np.ndarray
    klass: np.ndarray
    slot: np.ndarray
    offset_class: np.ndarray
    offset_word: np.ndarray
    weights_class: np.ndarray
    weights_word: np.ndarray
    head: np.ndarray
    head_counts: np.ndarray
    total: int
    distinct: int
    rest_log: float
    offset_tree: np.ndarray
    weights_tree: np.ndarray
    leaf_log: np.ndarray
    seen_log: float

    @cached_property
    def places(self) -> np.ndarray:
        return marks(self.words)

    @cached_property
    def factors(self) -> Model | None:
        """The model with exponentials of its weights and offsets, which are multiplied; none if a product could leave the range of logits."""
        largest = [3 * np.abs(w).max(initial=0) + np.abs(o[o > -1e30]).max(initial=0) for w, o in zip(self.weights(), (self.offset_class, self.offset_word, self.offset_tree))]
        if max(largest) > 80.0:
            return None
        return replace(self, **{f"{kind}_{name}": np.exp(np.maximum(getattr(self, f"{kind}_{name}"), -80.0)) for kind in ("weights", "offset") for name in ("class", "word", "tree")})

    def weights(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.weights_class, self.weights_word, self.weights_tree

    def copy(self) -> Model:
        """A model with weights of its own."""
        return replace(self, **{name: getattr(self, name).copy() for name in ("weights_class", "weights_word", "weights_tree")})

    def ids(self, tok: np.ndarray) -> np.ndarray:
        at = positions(self.words, self.places, tok)
        return np.where(self.words.take(at) == tok, at, -1)

    def forward(self, tok, one, two, ids=None):
        """Feature rows and class of every token; which of them are in a class, their classes, feature rows and slots."""
        f = features(one, two)
        rows = (f % np.uint64(ROWS_CLASS)).astype(np.int64)
        ids = self.ids(tok) if ids is None else ids
        klass = np.where(ids >= 0, self.klass[ids], CLASSES)
        inside = np.flatnonzero(ids >= 0)
        own = klass[inside]
        g = (mix(f[:, inside] + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(ROWS_WORD)).astype(np.int64)
        return rows, klass, inside, own, g, self.slot[ids[inside]]

    def digits(self, tok, one, two):
        """Feature rows, nodes and digits of words outside the classes, level by level of each word."""
        depth = digits_of(len(self.leaf_log))
        level = np.arange(depth)
        leaf = leaves(tok, depth)[:, None]
        digit = (leaf >> (BITS * (depth - 1 - level))) & ((1 << BITS) - 1)
        place = (leaf >> (BITS * (depth - level))) + ((1 << BITS * level) - 1) // ((1 << BITS) - 1)
        f = features(one, two)[:, :, None] + (place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        rows = (mix(f.reshape(3, -1)) % np.uint64(ROWS_TREE)).astype(np.int64)
        return rows, place.ravel(), digit.ravel()

    def outside_log10(self, tok, one, two) -> np.ndarray:
        """What the context adds to the log probability of each word outside the classes, next to its share of the corpus counts."""
        out, depth = np.zeros(len(tok)), digits_of(len(self.leaf_log))
        m, chance = (self, _chances) if self.factors is None else (self.factors, _quotients)
        for i in range(0, len(tok), _CHUNK):
            cut = slice(i, i + _CHUNK)
            rows, place, digit = self.digits(tok[cut], one[cut], two[cut])
            q = chance(m.offset_tree, place, m.weights_tree, rows, digit)
            out[cut] = np.log10(np.maximum(q, 1e-30)).reshape(-1, depth).sum(axis=1, dtype=np.float64)
        return out + self.seen_log - self.leaf_log[leaves(tok, depth)]

    def log10(self, tok, one, two, ids=None) -> np.ndarray:
        """Log probability of each token; of words outside the model only that of their class. ``ids`` are looked up if not given."""
        out = np.zeros(len(tok))
        m, chance = (self, _chances) if self.factors is None else (self.factors, _quotients)
        for i in range(0, len(tok), _CHUNK):
            cut = slice(i, i + _CHUNK)
            rows, klass, inside, own, g, slot = self.forward(tok[cut], one[cut], two[cut], None if ids is None else ids[cut])
            out[cut] = np.log10(np.maximum(chance(m.offset_class, None, m.weights_class, rows, klass), 1e-30))
            out[i + inside] += np.log10(np.maximum(chance(m.offset_word, own, m.weights_word, g, slot), 1e-30))
        return out

    def learn(self, tok, one, two, past_class: np.ndarray, past_word: np.ndarray, past_tree: np.ndarray) -> None:
        """One gradient step, scaled by the root of each row's past squares."""
        self.__dict__.pop("factors", None)
        rows, klass, _, own, g, slot = self.forward(tok, one, two)
        p = _chances(self.offset_class, None, self.weights_class, rows)
        q = _chances(self.offset_word, own, self.weights_word, g)
        p[np.arange(len(klass)), klass] -= 1.0
        q[np.arange(len(slot)), slot] -= 1.0
        _step(self.weights_class, past_class, rows, p)
        _step(self.weights_word, past_word, g, q)
        rest = np.flatnonzero(klass == CLASSES)
        if len(rest):
            rows, place, digit = self.digits(tok[rest], one[rest], two[rest])
            q = _chances(self.offset_tree, place, self.weights_tree, rows)
            q[np.arange(len(digit)), digit] -= 1.0
            _step(self.weights_tree, past_tree, rows, q)


def marks(keys: np.ndarray) -> np.ndarray:
    """Where sorted hashes with the same first bits begin; about one hash has the same ones."""
    bits = max(1, len(keys).bit_length())
    return np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))


def positions(keys: np.ndarray, first: np.ndarray, tok: np.ndarray) -> np.ndarray:
    """Position in sorted ``keys``, whose ``marks`` are ``first``, of each token that is among them; of others a position of another key."""
    last = len(keys) - 1
    at = np.minimum(first.take((tok >> np.uint64(65 - len(first).bit_length())).astype(np.int64)), last)
    less = np.flatnonzero(keys.take(at) < tok)
    while len(less):
        some = at[less] + 1
        less, some = less[some <= last], some[some <= last]
        at[less] = some
        less = less[keys.take(some) < tok[less]]
    return at


def features(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Hashes of the three contexts of every token."""
    return np.stack([mix(one ^ np.uint64(0x11)), mix(one * np.uint64(3) + two), mix(two ^ np.uint64(0x33))])


def digits_of(leaves: int) -> int:
    return (leaves.bit_length() - 1) // BITS


def leaves(tok: np.ndarray, depth: int) -> np.ndarray:
    """Leaf of each word in a tree of ``depth`` digits."""
    return (mix(tok ^ np.uint64(0x77)) >> np.uint64(64 - BITS * depth)).astype(np.int64)


def _chances(offset: np.ndarray, at: np.ndarray | None, weights: np.ndarray, rows: np.ndarray, only: np.ndarray | None = None) -> np.ndarray:
    """Softmax of summed weight rows plus ``offset`` (its rows ``at``, or the same for all), of logits up to 80 either way.

    With ``only``, that column of each row alone.
    """
    n, width = rows.shape[1], weights.shape[1]
    out = np.empty((n, width) if only is None else n, weights.dtype)
    ones, step = np.ones(width, weights.dtype), max(1, _FLOATS // width)
    for i in range(0, n, step):
        part = slice(i, i + step)
        x = weights.take(rows[0, part], axis=0)
        x += weights.take(rows[1, part], axis=0)
        x += weights.take(rows[2, part], axis=0)
        x += offset if at is None else offset.take(at[part], axis=0)
        np.clip(x, -80.0, 80.0, out=x)
        np.exp(x, out=x)
        if only is None:
            np.divide(x, (x @ ones)[:, None], out=out[part])
        else:
            np.divide(x[np.arange(len(x)), only[part]], x @ ones, out=out[part])
    return out


def _quotients(offset: np.ndarray, at: np.ndarray | None, weights: np.ndarray, rows: np.ndarray, only: np.ndarray) -> np.ndarray:
    """What ``_chances`` gives for columns ``only``, from exponentials of weights and offsets."""
    n, width = rows.shape[1], weights.shape[1]
    out, ones, step = np.empty(n, weights.dtype), np.ones(width, weights.dtype), max(1, _FLOATS // width)
    for i in range(0, n, step):
        part = slice(i, i + step)
        x = weights.take(rows[0, part], axis=0)
        x *= weights.take(rows[1, part], axis=0)
        x *= weights.take(rows[2, part], axis=0)
        x *= offset if at is None else offset.take(at[part], axis=0)
        np.divide(x.take(np.arange(len(x)) * width + only[part]), np.maximum(x @ ones, 1e-37), out=out[part])
    return out


def _step(weights, past, rows, gradient) -> None:
    n, flat = gradient.shape[0], rows.ravel()
    if not len(flat):
        return
    bits = np.uint64(len(flat).bit_length())
    order = (flat.astype(np.uint64) << bits) + np.arange(len(flat), dtype=np.uint64)
    order.sort()  # by rows, in a row as they came
    flat = (order >> bits).astype(np.int64)
    order = (order & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    whole = np.dtype((np.void, weights.strides[0]))  # rows are written as one value each
    for some, g in _sums(gradient, order % n, start):
        own = flat.take(start.take(some))
        squares = past.take(own) + np.einsum("ij,ij->i", g, g) / g.shape[1]
        past[own] = squares
        g *= (STEP / np.sqrt(squares + 1e-3))[:, None]
        np.put(weights.view(whole), own, np.subtract(weights.take(own, axis=0), g, out=g).view(whole))


def _sums(x: np.ndarray, at: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(runs, sums) of the rows ``at`` of ``x`` between starts. Neighbours are added in rounds, runs of one length up to a power of two at once."""
    x = np.concatenate([x, np.zeros((1, x.shape[1]), x.dtype)])
    at, length = np.append(at, len(x) - 1), np.diff(np.append(start, len(at)))
    rounds = np.frexp(length - 0.5)[1]
    by_rounds, first, place = np.argsort(rounds.astype(np.uint8), kind="stable"), 0, np.zeros(1, np.int64)
    for runs in np.bincount(rounds).tolist():
        step = max(1, _FLOATS // x.shape[1] // len(place))
        for i in range(first, first + runs, step):
            some = by_rounds[i:min(i + step, first + runs)]
            # short runs end in rows of zeros; neighbours of a round stand half the rows apart
            if len(place) == 1:
                y = x.take(at.take(start.take(some)), axis=0)
            else:
                y = x.take(at.take(np.where(place[:, None] < length[some], start[some] + place[:, None], len(at) - 1)).ravel(), axis=0)
            while len(y) > len(some):
                y = np.add(y[:len(y) // 2], y[len(y) // 2:], out=y[:len(y) // 2])
            yield some, y
        first += runs
        place = np.concatenate([2 * place, 2 * place + 1])


def make_classes(neighbours: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Class of each word (most frequent first) by its left neighbours, WIDTH words a class at most."""
    n = len(counts)
    x = np.log((neighbours + 0.5) / (neighbours.sum(1, keepdims=True) + 0.5 * neighbours.shape[1]))
    x -= np.average(x, axis=0, weights=counts)
    values, vectors = np.linalg.eigh(np.cov(x.T, aweights=counts) + 1e-9 * np.eye(x.shape[1]))
    x = x @ vectors[:, ::-1][:, :8]
    klass, centre, size = np.full(n, -1), np.zeros((CLASSES, x.shape[1])), np.zeros(CLASSES, int)
    step = max(1, n // CLASSES)
    centre[:] = x[np.minimum(np.arange(CLASSES) * step // 4, n - 1)]
    for _ in range(10):
        nearest = ((x[:, None, :] - centre) ** 2).sum(2)
        klass[:] = nearest.argmin(1)
        for c in range(CLASSES):
            if (own := klass == c).any():
                centre[c] = np.average(x[own], axis=0, weights=counts[own])
    for i in range(n):  # frequent words choose first
        for c in np.argsort(nearest[i], kind="stable"):
            if size[c] < WIDTH:
                klass[i] = c
                size[c] += 1
                break
    return klass


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col(text).cast("binary").alias("text"))


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of several (words, counts), and their counts."""
    w, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(w)
    w, n = w[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    return w[first], np.add.reduceat(n, first)


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over whole texts, the end of a text as a word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for _, _, d, b in slices(batch.column(0)):
                waiting.append(np.unique(tokens(d, b)[0], return_counts=True))
                size += len(waiting[-1][0])
                if size >= COUNTED:
                    waiting = [_added(waiting)]
                    if 2 * len(waiting[0][0]) >= COUNTED:
                        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in waiting.pop()], ["word", "n"])
                    size = sum(len(w) for w, _ in waiting)
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in _added(waiting)], ["word", "n"])

    return _texts(docs, text).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def start(docs: DataFrame, counts: DataFrame, text: str, workers: int) -> Model:
    """Model with weights of zero."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    cut, upto = 1, 0  # all words of at least this count fit into the head; the table has one row per distinct count
    for r in sorted(counts.groupBy("n").agg(F.count("*").alias("k")).collect(), reverse=True):
        upto += r["k"]
        if upto > HEAD:
            cut = r["n"] + 1
            break
    top = counts.where(F.col("n") >= cut).toArrow().to_pandas().sort_values(["n", "word"], ascending=[False, True])
    head, head_counts = top["word"].to_numpy().astype(np.int64).view(np.uint64), top["n"].to_numpy().astype(np.int64)
    end = int(END.view(np.int64))
    size = CLASSES * WIDTH
    model, model_counts = head[:size].copy(), head_counts[:size].copy()
    if not (model == END).any():  # the end of a text always belongs to the model
        model, model_counts = np.append(model[:size - 1], END), np.append(model_counts[:size - 1], counts.where(F.col("word") == end).select("n").first()[0] if total else 1)
    order = np.argsort(head)
    head, head_counts = head[order], head_counts[order]
    by_hash = np.argsort(model)
    sorted_words = model[by_hash]
    frequent = np.argsort(-model_counts, kind="stable")
    left = min(NEIGHBOURS, len(model))
    marks = np.sort(model[frequent[:left]])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(len(sorted_words) * (left + 1), np.int64)
        for batch in batches:
            for _, _, d, b in slices(batch.column(0)):
                tok, _, one, _ = tokens(d, b)
                at = np.minimum(np.searchsorted(sorted_words, tok), len(sorted_words) - 1)
                mark = np.minimum(np.searchsorted(marks, one), left - 1)
                mark = np.where(marks[mark] == one, mark, left)
                ok = sorted_words[at] == tok
                cells += np.bincount(at[ok] * (left + 1) + mark[ok], minlength=len(cells))
        some = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(cells[some])], ["cell", "n"])

    cells = np.zeros(len(sorted_words) * (left + 1))
    found = _texts(docs, text).coalesce(workers).mapInArrow(pairs, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    cells[found["cell"].to_numpy().astype(int)] = found["n"].to_numpy()
    neighbours = cells.reshape(len(sorted_words), left + 1)
    counts_sorted = model_counts[by_hash]
    rank = np.argsort(-counts_sorted, kind="stable")
    klass = np.zeros(len(rank), np.int64)
    klass[rank] = make_classes(neighbours[rank], counts_sorted[rank].astype(float)) if len(rank) > 1 else 0
    slot, mass = np.zeros(len(rank), np.int64), np.zeros(CLASSES + 1)
    offset_word = np.full((CLASSES, WIDTH), -1e30, np.float32)
    smooth = counts_sorted + ADD
    for c in range(CLASSES):
        own = np.flatnonzero(klass == c)
        slot[own] = np.arange(len(own))
        mass[c] = smooth[own].sum()
        if len(own):
            offset_word[c, :len(own)] = np.log(smooth[own] / mass[c])
        else:
            offset_word[c] = 0.0
    # all other words with their own 0.1 each, and one share for words never seen
    mass[CLASSES] = max(0, total - counts_sorted.sum()) + ADD * max(1, distinct - len(rank) + 1)
    offset_class = np.log(np.maximum(mass, 1e-30) / mass.sum()).astype(np.float32)
    offset_tree, leaf_log, seen_log = make_tree(counts, sorted_words, int(distinct))
    return Model(sorted_words, klass, slot, offset_class, offset_word, np.zeros((ROWS_CLASS, CLASSES + 1), np.float32),
                 np.zeros((ROWS_WORD, WIDTH), np.float32), head, head_counts, int(total), int(distinct), float(np.log10(mass[CLASSES])),
                 offset_tree, np.zeros((ROWS_TREE, 1 << BITS), np.float32), leaf_log, seen_log)


def make_tree(counts: DataFrame, inside: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(offsets of all nodes level by level, log10 mass of each leaf, log10 mass of all) of the words that are not ``inside``."""
    depth = 1
    while depth < DIGITS and 1 << BITS * depth < distinct - len(inside):
        depth += 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, k = np.zeros(1 << BITS * depth, np.int64), np.zeros(1 << BITS * depth, np.int64)
        for batch in batches:
            word = batch.column(0).to_numpy().view(np.uint64)
            rest = inside[np.minimum(np.searchsorted(inside, word), len(inside) - 1)] != word
            leaf = leaves(word[rest], depth)
            k += np.bincount(leaf, minlength=len(k))
            np.add.at(n, leaf, batch.column(1).to_numpy()[rest])
        some = np.flatnonzero(k)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(k[some])], ["leaf", "n", "k"])

    found = counts.select("word", "n").mapInArrow(add, "leaf long, n long, k long").groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).toArrow().to_pandas()
    mass = np.zeros(1 << BITS * depth)
    mass[found["leaf"].to_numpy().astype(int)] = found["n"].to_numpy() + ADD * found["k"].to_numpy()
    offsets, below = [], mass
    for _ in range(depth):
        below = below.reshape(-1, 1 << BITS)
        above = below.sum(axis=1)
        offsets.append(np.where(below > 0, np.log(np.maximum(below, 1e-30) / np.maximum(above, 1e-30)[:, None]), -1e30))
        below = above
    return np.concatenate(offsets[::-1]).astype(np.float32), np.log10(np.where(mass > 0, mass, 1.0)), float(np.log10(max(below[0], 1e-30)))


def train(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, workers: int = WORKERS) -> Model:
    """One pass over all rows in ``rounds`` parts."""
    spark = docs.sparkSession
    for r in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        part = docs.where(F.pmod(F.xxhash64(F.lit(3), key), F.lit(rounds)) == r)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = sent.value
            own = m.copy()
            past_class, past_word, past_tree = (np.zeros(n, np.float32) for n in (ROWS_CLASS, ROWS_WORD, ROWS_TREE))
            for batch in batches:
                for _, _, d, b in slices(batch.column(0)):
                    tok, _, one, two = tokens(d, b)
                    for i in range(0, len(tok), _CHUNK):
                        own.learn(tok[i:i + _CHUNK], one[i:i + _CHUNK], two[i:i + _CHUNK], past_class, past_word, past_tree)
            for table, (past, new, old) in enumerate(zip((past_class, past_word, past_tree), own.weights(), m.weights())):
                rows = np.flatnonzero(past)
                for i in range(0, len(rows), 2048):
                    at = rows[i:i + 2048]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), table, np.int32)), pa.array(at.astype(np.int32)), pa.array([x.tobytes() for x in new[at] - old[at]], pa.binary())],
                        ["tab", "row", "change"])

        def average(group: pd.DataFrame) -> pd.DataFrame:
            out = []
            for tab, part in group.sort_values(["tab", "row"]).groupby("tab"):
                rows, start, times = np.unique(part["row"].to_numpy(), return_index=True, return_counts=True)
                sums = np.add.reduceat(np.frombuffer(b"".join(part["change"]), np.float32).reshape(len(part), -1), start, axis=0, dtype=np.float64)
                out += [(tab, r, x.tobytes()) for r, x in zip(rows.tolist(), (sums / times[:, None]).astype(np.float32))]
            return pd.DataFrame(out, columns=["tab", "row", "change"])

        schema = "tab int, row int, change binary"
        changes = _texts(part, text).coalesce(workers).mapInArrow(learn, schema).groupBy(F.pmod(F.xxhash64("tab", "row"), F.lit(64))).applyInPandas(average, schema)
        model = model.copy()
        for tab, row, change in changes.toArrow().to_pandas().itertuples(index=False):  # bounded by the size of the weights
            model.weights()[tab][row] += np.frombuffer(change, np.float32)
        sent.unpersist()
    return model


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, workers: int = WORKERS) -> DataFrame:
    """Key, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` (log10) of every row.

    Rows where ``held_out`` is true are not learned from. Null counts as an empty text, which is an end alone; rows repeat as given.
    Without training rows all words are unknown.
    """
    kind = docs.schema[key].dataType.simpleString()
    held_out = F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text"), held_out.alias("held_out"))
    learned = rows.where("not held_out")
    counts = saved(count_tokens(learned))
    model = train(learned, start(learned, counts, "text", workers), "id", "text", rounds, workers)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        known = np.append(np.searchsorted(m.head, m.words), 0)
        first_of, head_log = marks(m.head), np.log10(m.head_counts + ADD)
        for batch in batches:
            for first, end, d, b in slices(batch.column(1)):
                tok, owner, one, two = tokens(d, b)
                n = end - first
                ids = m.ids(tok) if len(m.words) else np.full(len(tok), -1)
                logs = m.log10(tok, one, two, ids) if len(m.words) else np.zeros(len(tok))
                outside = ids < 0
                at = known[ids]  # words of the model are looked up once a task
                if len(m.head):
                    at[outside] = positions(m.head, first_of, tok[outside])
                    at = np.minimum(at, len(m.head) - 1)
                in_head = m.head.take(at) == tok if len(m.head) else np.zeros(len(tok), bool)
                own = np.where(in_head, head_log.take(at), 0.0) if len(m.head) else np.zeros(len(tok))
                logs = logs + np.where(outside, own - m.rest_log, 0.0)
                tree = np.zeros(len(tok))
                tree[outside] = m.outside_log10(tok[outside], one[outside], two[outside])
                logs += np.where(in_head, tree, 0.0)
                rest = np.flatnonzero(~in_head)  # counted below, by the join; the tree holds for those that training has seen
                rest = rest[np.lexsort((tok[rest], owner[rest]))]
                new = np.flatnonzero((np.diff(owner[rest], prepend=-1) != 0) | (np.diff(tok[rest], prepend=tok[rest[:1]]) != 0))
                times = np.diff(np.append(new, len(rest)))
                sums = np.add.reduceat(tree[rest], new) if len(new) else np.zeros(0)
                cut = np.searchsorted(owner[rest[new]], np.arange(n + 1))
                cut = pa.array(cut.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(2).slice(first, n), pa.array(np.bincount(owner, minlength=n)),
                     pa.array(np.bincount(owner[in_head], minlength=n)), pa.array(np.bincount(owner, own, n)), pa.array(np.bincount(owner, logs, n)),
                     pa.ListArray.from_arrays(cut, pa.array(tok[rest[new]].view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(times.astype(np.int64))),
                     pa.ListArray.from_arrays(cut, pa.array(sums))],
                    ["id", "held_out", "n_tokens", "in_head", "own", "logs", "rare", "times", "tree"])

    found = rows.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, in_head long, own double, logs double, rare array<long>, times array<long>, tree array<double>")
    found = saved(found.withColumn("place", F.monotonically_increasing_id()))
    rare = found.where(F.size("rare") > 0).select("place", F.explode(F.arrays_zip("rare", "times", "tree")).alias("x")).select(
        "place", F.col("x.rare").alias("word"), F.col("x.times").alias("times"), F.col("x.tree").alias("tree"))
    # words outside the head are rare, so no key of this join is hot
    c = F.coalesce(F.col("n"), F.lit(0))
    sums = rare.join(counts, "word", "left").groupBy("place").agg(
        F.sum(F.col("times") * F.log10(c + ADD)).alias("rare_log"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.when(c > 0, F.col("tree")).otherwise(0.0)).alias("rare_tree"))
    done = found.join(sums, "place", "left")
    base = np.log10(model.total + ADD * (model.distinct + 1))
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return done.select(
        F.col("id").alias(key), "held_out", "n_tokens", (F.col("in_head") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), (F.col("own") + rare_log - F.col("n_tokens") * float(base)).alias("base_score"),
        (F.col("logs") + rare_log + F.coalesce("rare_tree", F.lit(0.0))).alias("score"))
