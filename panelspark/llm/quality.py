"""Quality rules: base rules on counts, then robust multivariate outliers per language and source.

Each text gets a vector of transformed statistics. Per (language, source) group a minimum-covariance-determinant estimate is made:
subset searches on a bounded seeded sample give a start, concentration steps over all rows refine it. The same is done per
language and over all rows, and a group's estimate is drawn towards that of its language, which is drawn towards that of all,
the more the fewer rows it has. Rows whose Mahalanobis distance exceeds the cutoff are rejected, in groups of any size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.tables import saved
from panelspark.llm.words import SPACE, hash_spans, mix, shingles, slices, spans, words

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: Coordinates of a vector.
P = 4
#: Rows of a group, expected, on which the start is searched (the only sample; all else sees all rows).
SAMPLE = 400
#: So many rows does the estimate of the level above count in that of a group.
PRIOR = 40
#: Estimates of so many groups (about 400 bytes each) are sent to all tasks, those of the largest groups; others are joined by a shuffle.
GROUPS = 10_000
#: Share of rows that an estimate must cover.
COVER = 0.75
#: Concentration steps over all rows.
STEPS = 2
#: No coordinate counts as more exact than this; else a statistic that is 0 almost everywhere would reject any other value.
FLOOR = np.array([0.25, 0.05, 0.05, 0.15])
#: Squared distance above which a row is rejected: 4 degrees of freedom, tail 1e-7.
CUTOFF = 38.2
#: Distances are counted in bins of 2^(1/16).
BINS = 16


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _own(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts."""
    return mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts of every text: see the query's contract for their rules. Null and empty texts have zeros."""
    out: dict[str, list[np.ndarray]] = {s: [] for s in STATS}
    for _, _, data, bounds in slices(column):
        w = words(data, bounds)
        n = len(bounds) - 1
        counts = w.counts()
        out["n_words"].append(counts)
        out["word_chars"].append(_sums(~SPACE[data] & ((data & 0xC0) != 0x80), bounds))
        out["n_symbols"].append(_sums(SYMBOL[data], bounds))
        # lines: runs without \n that hold the start of a word
        starts, ends = spans(data != 10, bounds)
        filled = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
        starts, ends = starts[filled], ends[filled]
        owner = np.searchsorted(bounds, starts, "right") - 1
        _, first = np.unique(_own(hash_spans(data, starts, ends), owner), return_index=True)
        out["n_dup_lines"].append(np.bincount(owner, minlength=n) - np.bincount(owner[first], minlength=n))
        # words covered by 3-word windows that occur again in the same text
        text_of = np.repeat(np.arange(n), counts)
        covered = np.zeros(len(text_of), bool)
        if len(text_of) > 2:
            whole = text_of[2:] == text_of[:-2]
            _, back, often = np.unique(_own(shingles(w.hashes, 3), text_of[:-2]), return_inverse=True, return_counts=True)
            again = (often[back] > 1) & whole
            for i in range(3):
                covered[i:len(covered) - 2 + i] |= again
        out["n_repeat_words"].append(_sums(covered, w.at))
    return {k: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for k, v in out.items()}


def vector(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) -> np.ndarray:
    """Transformed statistics: length and mean word length as logarithms, shares as square roots."""
    n = np.maximum(n_words, 1)
    return np.stack([np.log(n), np.log(np.maximum(word_chars, 1) / n), np.sqrt(n_symbols / np.maximum(word_chars, 1)),
                     np.sqrt((n_dup_lines + n_repeat_words) / n)], axis=1)


def chi2_cdf(x: float, degrees: int) -> float:
    """Even degrees of freedom."""
    term, total = 1.0, 0.0
    for k in range(degrees // 2):
        total += term
        term *= x / 2 / (k + 1)
    return 1.0 - np.exp(-x / 2) * total


def scaled(cov: np.ndarray, share: float) -> np.ndarray:
    """Covariance of the closest ``share`` of normal rows, blown up to that of all, with floors on the diagonal."""
    low, high = 0.0, 100.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, P) < share else (low, middle)
    if share < 1:
        cov = cov * share / max(chi2_cdf(high, P + 2), 1e-6)
    return cov + np.diag(np.maximum(FLOOR ** 2 - np.diag(cov), 0.05 * FLOOR ** 2))


def distance(x: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    d = x - mean
    return np.einsum("ij,jk,ik->i", d, inverse, d)


def search(x: np.ndarray, seed: int, starts: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the subset with the smallest determinant, by concentration from random starts."""
    rng, n = np.random.default_rng(seed), len(x)
    h = max(P + 1, int(np.ceil(COVER * n)))
    best = None
    for _ in range(starts):
        own = rng.choice(n, P + 1, replace=False)
        for step in range(8):
            mean = x[own].mean(0)
            cov = scaled(np.cov(x[own].T, bias=True), 1.0 if step == 0 else h / n)
            nearest = np.argsort(distance(x, mean, np.linalg.inv(cov)), kind="stable")[:h]
            if step and np.array_equal(nearest, own):
                break
            own = nearest
        mean, cov = x[own].mean(0), scaled(np.cov(x[own].T, bias=True), h / n)
        size = float(np.linalg.slogdet(cov)[1])
        if best is None or size < best[0] - 1e-12:
            best = (size, mean, cov)
    return best[1], best[2]


def pooled(levels: Sequence[tuple[int, np.ndarray, np.ndarray]], prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of a group from (rows, mean, covariance) of all rows, of each level below, and of itself.

    Each level is mixed with what the levels above give, which weighs ``prior`` rows. The distance between both means adds to the
    covariance, so a group that lies apart isn't rejected as a whole. One row can't vouch for itself, and 2 P rows or less say
    nothing about the covariance, so those don't count; a level with the rows of the level above adds nothing.
    """
    (above, mean, cov), *below = levels
    for n, own_mean, own_cov in below:
        if n < above:
            w, v = (max(0, n - free) / (max(0, n - free) + prior) for free in (1, 2 * P))
            d = own_mean - mean
            mean, cov = mean + w * d, v * own_cov + (1 - v) * cov + w * (1 - w) * np.outer(d, d)
        above = n
    return mean, cov


_ESTIMATE = "grp string, n long, mean array<double>, cov array<double>, inverse array<double>"


def _row(grp, n, mean, cov) -> pd.DataFrame:
    return pd.DataFrame({"grp": [grp], "n": [int(n)], "mean": [np.round(mean, 12).tolist()], "cov": [cov.ravel().tolist()],
                         "inverse": [np.linalg.inv(cov).ravel().tolist()]})


def _with(rows: DataFrame, table: DataFrame, limit: int = GROUPS) -> DataFrame:
    """Rows joined to a table of one row per group with its size ``n``. The largest groups are sent to all tasks, so that their rows
    stay where they are; the others are too small to be hot."""
    if table.count() <= limit:
        return rows.join(F.broadcast(table), "grp")
    cut = table.select("n").orderBy(F.desc("n")).limit(limit).agg(F.min("n")).first()[0]
    large, small = table.where(F.col("n") > cut), table.where(F.col("n") <= cut)
    return rows.join(F.broadcast(large), "grp").unionByName(
        rows.join(F.broadcast(large.select("grp")), "grp", "left_anti").join(small, "grp"))


def _distance() -> Column:
    """Squared distance of a row to the estimate beside it."""
    d = [F.col(f"x{i}") - F.col("mean")[i] for i in range(P)]
    return sum((d[i] * d[j] * F.col("inverse")[i * P + j] for i in range(P) for j in range(P)), F.lit(0.0))


def judge(docs: DataFrame, carry: Sequence[str], text: str = "text", groups: Sequence[str] = ("lang", "source"), seed: int = 7,
          prior: int = PRIOR, cutoff: float = CUTOFF, limit: int = GROUPS) -> DataFrame:
    """``carry`` columns with the counts, ``base_failed``, ``distance`` (squared, null where the base rules failed) and ``kept``.

    Null languages or sources form groups of their own. Rows that fail the base rules neither shape an estimate nor get a
    distance; all others get one, see ``pooled`` for small groups. Repeated rows count each.
    """
    names = docs.select(*carry).schema
    kinds = ", ".join(f"`c{i}` {f.dataType.simpleString()}" for i, f in enumerate(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = statistics(batch.column(batch.num_columns - 1))
            x = vector(*[s[k] for k in STATS])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *[pa.array(s[k]) for k in STATS], *[pa.array(x[:, i]) for i in range(P)]],
                [*batch.schema.names[:-1], *STATS, *[f"x{i}" for i in range(P)]])

    # the groups of a row: all rows, its language, its language and source
    keys = [F.col(g).cast("string").alias(f"g{i}") for i, g in enumerate(groups)]
    grps = F.array(*[F.to_json(F.struct(F.lit(k).alias("level"), *keys[:k])) for k in range(len(keys) + 1)])
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], grps.alias("grps"), F.xxhash64(F.lit(seed), F.monotonically_increasing_id(), *carry).alias("h"),
                       F.col(text).cast("binary").alias("t"))
    rows = rows.mapInArrow(run, kinds + ", grps array<string>, h long, " + ", ".join(f"{s} long" for s in STATS) + ", " + ", ".join(f"x{i} double" for i in range(P)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = saved(rows.withColumn("base_failed", failed))
    usable = rows.where("not base_failed").select(F.explode("grps").alias("grp"), "h", *[f"x{i}" for i in range(P)])

    sizes = saved(usable.groupBy("grp").agg(F.count("*").alias("n")))
    sample = _with(usable, sizes, limit).where(F.pmod("h", F.lit(1 << 30)) * F.col("n") < SAMPLE * (1 << 30))

    def start(group: pd.DataFrame) -> pd.DataFrame:
        x = group.sort_values("h")[[f"x{i}" for i in range(P)]].to_numpy()
        if len(x) <= 2 * P:
            mean, cov = np.median(x, axis=0), scaled(np.cov(x.T, bias=True) if len(x) > 1 else np.zeros((P, P)), 1.0)
        else:
            mean, cov = search(x, seed)
        return _row(group["grp"].iloc[0], group["n"].iloc[0], mean, cov)

    estimates = saved(sample.groupBy("grp").applyInPandas(start, _ESTIMATE))
    pairs = [(i, j) for i in range(P) for j in range(i, P)]

    def refine(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in group.itertuples():
            m = np.array(r.sums) / r.k
            cov = np.zeros((P, P))
            for (i, j), v in zip(pairs, r.products):
                cov[i, j] = cov[j, i] = v / r.k - m[i] * m[j]
            out.append(_row(r.grp, r.n, np.array(r.centre) + m, scaled(cov, min(1.0, r.k / r.n))))
        return pd.concat(out) if out else pd.DataFrame({"grp": [], "n": [], "mean": [], "cov": [], "inverse": []})

    for _ in range(STEPS):
        near = _with(usable, estimates, limit).withColumn("bin", F.floor(F.log2(_distance() + 1e-9) * BINS))
        counts = near.groupBy("grp", "n", "bin").agg(F.count("*").alias("k"))  # a few hundred bins a group
        running = F.sum("k").over(Window.partitionBy("grp").orderBy("bin"))
        edge = counts.withColumn("upto", running).where(F.col("upto") >= F.ceil(F.col("n") * COVER)).groupBy("grp", "n").agg(F.min("bin").alias("edge"))
        moved = [F.col(f"x{i}") - F.col("mean")[i] for i in range(P)]
        sums = (_with(near.drop("n"), saved(edge), limit).where("bin <= edge").groupBy("grp", "n")
                .agg(F.count("*").alias("k"), F.array(*[F.sum(m) for m in moved]).alias("sums"),
                     F.array(*[F.sum(moved[i] * moved[j]) for i, j in pairs]).alias("products"), F.first("mean").alias("centre")))
        estimates = saved(sums.groupBy("grp").applyInPandas(refine, _ESTIMATE))

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("level")
        levels = [(r.n, np.array(r.mean), np.array(r.cov).reshape(P, P)) for r in group[["n", "mean", "cov"]].itertuples(index=False)]
        return _row(group["own"].iloc[0], group["n"].iloc[-1], *pooled(levels, prior))

    chains = rows.where("not base_failed").select("grps").distinct().select(
        F.element_at("grps", -1).alias("own"), F.posexplode("grps").alias("level", "grp"))
    final = saved(_with(chains, estimates, limit).groupBy("own").applyInPandas(draw, _ESTIMATE))
    measured = rows.withColumn("grp", F.element_at("grps", -1))
    judged = _with(measured.where("not base_failed"), final, limit).withColumn("distance", _distance()).drop("n", "mean", "cov", "inverse").unionByName(
        measured.where("base_failed").withColumn("distance", F.lit(None).cast("double")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return judged.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], *STATS, "base_failed", "distance", kept.alias("kept"))
