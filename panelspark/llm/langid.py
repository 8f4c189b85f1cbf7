"""Language identification by string kernels.

The blended-spectrum presence kernel of two texts counts the byte n-grams (n = 1 to 3) that both hold, over the root of the
product of their own counts. Landmarks chosen from the training blocks give Nystroem features, kernel ridge regression one
score per language (one versus rest). As the kernel is an inner product of presence vectors, landmarks, whitening and ridge weights
fold into one matrix (n-grams x languages): scoring a batch is one product of its presence matrix.

Texts are scored in blocks of equal length, so that a long text, which holds most n-grams of any language, is judged like a short
one; a text's score is the mean of its blocks by length. All of the text counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.words import slices

#: Bytes of a block.
BLOCK = 1024
#: Training blocks per language, expected (a hash of key and place decides), and landmarks in all: the fit's only bounds.
TRAIN, LANDMARKS = 400, 400
RIDGE = 1e-2

#: Bytes as symbols of 6 bits: letters without case, one for all other ASCII, the rest folded. Kinds below 0x80 stay exact.
_SYMBOL = np.zeros(256, np.int32)
for _b in range(256):
    if 65 <= _b <= 90 or 97 <= _b <= 122:
        _SYMBOL[_b] = (_b & 31)
    elif _b >= 128:
        _SYMBOL[_b] = 27 + (_b - 128) % 37
GRAMS = 64 + 64 ** 2 + 64 ** 3


def grams(data: np.ndarray) -> list[np.ndarray]:
    """Codes of the 1-, 2- and 3-grams that begin at each byte."""
    s = _SYMBOL[data]
    two = s[:-1] * 64 + s[1:]
    three = two[:-1] * 64 + s[2:]
    return [s, two + 64, three + (64 + 64 ** 2)]


@dataclass
class Model:
    """``column[code]`` is a row of ``weights`` (n-grams x languages) or -1."""

    languages: list[str]
    column: np.ndarray
    weights: np.ndarray

    def blocks(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of all blocks of a run of texts, the texts they belong to, and their lengths."""
        lengths = np.diff(bounds)
        n = np.maximum(1, -(-lengths // BLOCK))
        owner = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        # blocks of one text are equally long up to a byte
        starts = bounds[:-1][owner] + place * lengths[owner] // n[owner]
        ends = bounds[:-1][owner] + (place + 1) * lengths[owner] // n[owner]
        out = np.zeros((len(owner), len(self.languages)), np.float32)
        for first in range(0, len(owner), 512):
            rows, roots = np.zeros((min(512, len(owner) - first), len(self.weights)), np.float32), []
            for r in range(len(rows)):
                b = data[starts[first + r]:ends[first + r]]
                if len(b) == 0:
                    roots.append(1.0)
                    continue
                distinct = 0
                for c in grams(b):
                    own = np.unique(c)
                    distinct += len(own)
                    at = self.column[own]
                    rows[r, at[at >= 0]] = 1.0
                roots.append(distinct ** 0.5)
            out[first:first + len(rows)] = (rows @ self.weights) / np.array(roots, np.float32)[:, None]
        return out, owner, np.maximum(ends - starts, 1)

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        values, owner, length = self.blocks(data, bounds)
        total = np.zeros((len(bounds) - 1, values.shape[1]))
        np.add.at(total, owner, values * length[:, None])
        return total / np.bincount(owner, length, len(bounds) - 1)[:, None]


def fit(blocks: list[bytes], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression on Nystroem features of labelled blocks (already in a seeded order)."""
    languages = sorted(set(labels))
    if not blocks:
        return Model(languages, np.full(GRAMS, -1, np.int64), np.zeros((1, 0), np.float32))
    sets = [np.unique(np.concatenate(grams(np.frombuffer(b, np.uint8)))) for b in blocks]
    turn: dict[str, int] = {}
    for_each = []
    for i, lang in enumerate(labels):  # landmarks are dealt evenly over the languages
        turn[lang] = turn.get(lang, 0) + 1
        for_each.append((turn[lang], i))
    chosen = [i for _, i in sorted(for_each)[:landmarks]]
    known = np.unique(np.concatenate([sets[i] for i in chosen]))
    column = np.full(GRAMS, -1, np.int64)
    column[known] = np.arange(len(known))

    def rows(which) -> np.ndarray:
        out = np.zeros((len(which), len(known)), np.float32)
        for r, i in enumerate(which):
            at = column[sets[i]]
            out[r, at[at >= 0]] = 1.0 / len(sets[i]) ** 0.5
        return out

    marks = rows(chosen)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    good = values > 1e-6 * values[-1]
    white = vectors[:, good] / np.sqrt(values[good])
    target = np.array([[1.0 if lang == own else -1.0 for own in languages] for lang in labels])
    gram, cross = np.zeros((good.sum(), good.sum())), np.zeros((good.sum(), len(languages)))
    for first in range(0, len(blocks), 1024):
        which = range(first, min(first + 1024, len(blocks)))
        f = (rows(which) @ marks.T).astype(float) @ white
        gram += f.T @ f
        cross += f.T @ target[first:first + 1024]
    solved = np.linalg.solve(gram + ridge * len(blocks) / len(gram) * np.eye(len(gram)), cross)
    return Model(languages, column, (marks.T.astype(float) @ (white @ solved)).astype(np.float32))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = TRAIN, seed: int = 5) -> Model:
    """Fit on about ``per_language`` blocks of each language; languages are counted over all labelled rows."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text"), F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("h"))
    blocks = F.ceil(F.octet_length("text") / BLOCK)
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").agg(F.sum(blocks)).collect()}
    if not counts:
        return fit([], [])
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    # a row is drawn as often as its blocks would be, then one block of it is taken
    drawn = (labelled.withColumn("chance", 1.0 - F.pow(1.0 - share[F.col("lang")], blocks))
             .where(F.pmod("h", F.lit(1 << 40)) < F.col("chance") * float(1 << 40))
             .withColumn("at", F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), blocks)).cast("int"))
             .select("lang", "h", F.expr(f"substring(text, at * {BLOCK} + 1, {BLOCK})").alias("block")))
    rows = sorted((r["h"], r["lang"], bytes(r["block"])) for r in drawn.collect())
    return fit([b for _, _, b in rows], [x for _, x, _ in rows])


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``lang_pred`` and ``score`` of every row: half the lead of the best language over the second, cut to 0 to 1.

    ``und`` with score 0 where the text is null or has no letter, or no language was learned. With one learned language the
    score is how far it is from the rest's -1. Repeated rows are scored each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            best, lead = [], []
            for first, end, data, bounds in slices(batch.column(2)):
                s = m.score(data, bounds) if m.languages else np.zeros((end - first, 0))
                if s.shape[1] == 0:
                    best += ["und"] * (end - first)
                    lead.append(np.zeros(end - first))
                    continue
                ordered = np.sort(s, axis=1)
                second = ordered[:, -2] if s.shape[1] > 1 else np.full(end - first, -1.0)
                best += [m.languages[i] for i in s.argmax(1).tolist()]
                lead.append(np.clip((ordered[:, -1] - second) / 2, 0.0, 1.0))
            lettered = np.array(batch.column(1).to_pylist(), bool)
            lead = np.concatenate(lead) if lead else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([b if ok else "und" for b, ok in zip(best, lettered)], pa.string()), pa.array(np.where(lettered, lead, 0.0))],
                ["id", "lang_pred", "score"])

    read = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("ok"), F.col(text).cast("binary").alias("text"))
    return read.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", key)
