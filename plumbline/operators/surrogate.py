"""Local linear surrogates (Ribeiro et al. 2016) for every row of a table.

Perturbed samples are drawn from the training bins, whatever the row: a row decides
only which samples fall into its own bins. So one seeded set of samples serves all
rows of a job. It is drawn and scored once; a row then compares bins, weights the
samples by its distance and solves, inside the task that holds it, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.arrays import KEY, literal_array, literal_names
from plumbline.functions.vectors import list_array, matrix_of, rank_matrix
from plumbline.operators.profiling import quartiles

GRID = 129
# Rows whose products are summed together, entries of their matrices, and rows of one matrix product.
ROWS_A_BLOCK = 2048
MOST_PRODUCTS = 1 << 21
ROWS_A_PRODUCT = 256
# The names of the two classes.
CLASS_NAMES = ("Not Fraud", "Fraud")
BINS = "feature string, bin int, n long, mean double, std double, low double, high double"


def surrogate_bins(df: DataFrame, features: list[str]) -> DataFrame:
    """``(feature, bin, n, mean, std, low, high)``: quartile bins of each feature.

    A value belongs to the first bin whose upper quartile is not below it; equal
    quartiles leave empty bins, which get no row.
    """
    cuts: dict[str, list[float]] = {}
    for r in quartiles(df, features).collect():
        cuts.setdefault(r["column"], []).append(r["quantile"])
    known = [f for f in features if f in cuts]
    if not known:
        return df.sparkSession.createDataFrame([], BINS)
    # Values carry their feature's number; cuts are looked up by it, so nothing is joined and the keys are small.
    edges = literal_array([cut for f in known for cut in sorted(cuts[f])])
    numbered = [F.struct(F.lit(i).alias("pos"), F.col(f"`{f}`").cast("double").alias("value")) for i, f in enumerate(known)]
    long = df.select(F.inline(F.array(*numbered))).where(F.col("value").isNotNull() & ~F.isnan("value"))
    place = sum((F.when(F.col("value") > edges[3 * F.col("pos") + i], 1).otherwise(0) for i in range(3)), F.lit(0))
    binned = long.groupBy("pos", place.alias("bin")).agg(
        F.count("*").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
    )
    return binned.select(
        literal_names(known)[F.col("pos")].alias("feature"),
        "bin",
        "n",
        "mean",
        "std",
        F.when(F.col("bin") == 0, F.col("least")).otherwise(F.get(edges, 3 * F.col("pos") + F.col("bin") - 1)).alias("low"),
        F.when(F.col("bin") == 3, F.col("most")).otherwise(F.get(edges, 3 * F.col("pos") + F.col("bin"))).alias("high"),
    )


def _bin_quantiles(mean: float, std: float, low: float, high: float) -> np.ndarray:
    """Quantiles of the normal distribution cut to [low, high], on an even grid.

    A deviation that is only rounding, or too small for the grid to meet, counts as none.
    """
    if not std > 1e-12 * max(abs(low), abs(high)) or not high > low:
        return np.full(GRID, mean)
    points = np.linspace(low, high, 1025)
    density = np.exp(-0.5 * ((points - mean) / std) ** 2)
    mass = np.concatenate([[0.0], np.cumsum((density[1:] + density[:-1]) / 2)])
    if not mass[-1] > 0:
        return np.full(GRID, mean)
    return np.interp(np.linspace(0, 1, GRID), mass / mass[-1], points)


def _mix(key: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    key = (key ^ (key >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return key ^ (key >> np.uint64(31))


@dataclass
class Sampler:
    """Cut points, cumulative bin shares and in-bin quantiles: four bins for each feature."""

    cuts: np.ndarray
    shares: np.ndarray
    values: np.ndarray

    def bins(self, x: np.ndarray) -> np.ndarray:
        return (x[..., None] > self.cuts).sum(axis=-1)

    def draw(self, keys: np.ndarray, samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Bins and values, both keys x samples x features."""
        width = self.cuts.shape[0]
        start = _mix(keys.astype(np.int64).view(np.uint64) + _mix(np.array([seed], np.uint64)))
        counter = np.arange(samples * width, dtype=np.uint64).reshape(1, samples, width)
        bits = _mix(start[:, None, None] + (counter + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        u = (bits >> np.uint64(32)).astype(np.float64) / 2.0**32
        v = (bits & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2.0**32 * (GRID - 1)
        chosen = sum((u >= self.shares[:, k]).astype(np.int64) for k in range(3))
        cell = v.astype(np.int64)
        at = (np.arange(width) * 4 + chosen) * GRID + cell
        table = self.values.ravel()
        lower = table.take(at)
        return chosen, lower + (table.take(at + 1) - lower) * (v - cell)


def fit_sampler(df: DataFrame, features: list[str]) -> Sampler:
    """At most four rows per feature reach the driver."""
    found = {(r["feature"], r["bin"]): r for r in surrogate_bins(df, features).collect()}
    cuts, shares, values = [], [], []
    for f in features:
        rows = [found.get((f, b)) for b in range(4)]
        total = float(sum(r["n"] for r in rows if r))
        shares.append(np.cumsum([r["n"] / total if r else 0.0 for r in rows])[:3])
        edges = [r["high"] if r else None for r in rows[:3]]
        for b in range(2, -1, -1):
            if edges[b] is None:
                edges[b] = next((r["low"] for r in rows[b + 1 :] if r), np.inf)
        cuts.append(edges)
        values.append(
            [
                _bin_quantiles(r["mean"], r["std"], r["low"], r["high"]) if r else np.zeros(GRID)
                for r in rows
            ]
        )
    return Sampler(np.array(cuts), np.array(shares), np.array(values))


def match_counts(hot: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Matched features, rows x samples, in bytes where they suffice; ``hot`` is samples' marks by feature and bin.

    Features are taken two at a time: the marks of a pair's sixteen bins are added once for all rows.
    """
    n, width = own.shape
    counted = hot.astype(np.min_scalar_type(width)).reshape(width, 4, -1)
    matches = np.zeros((n, hot.shape[1]), counted.dtype)
    for j in range(0, width - 1, 2):
        both = (counted[j][:, None] + counted[j + 1][None]).reshape(16, -1)
        matches += both.take(4 * own[:, j] + own[:, j + 1], axis=0)
    if width % 2:
        matches += counted[-1].take(own[:, -1], axis=0)
    return matches


def paired_weights(by_matches: np.ndarray) -> np.ndarray:
    """``by_matches`` of the two bytes of each 16-bit word, as one entry of two doubles."""
    words = np.arange(256 * len(by_matches), dtype=np.uint16).view(np.uint8).reshape(-1, 2)
    return by_matches.take(words, mode="clip").view(np.complex128).ravel()


def weights_of(matches: np.ndarray, by_matches: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """``by_matches`` at every entry; bytes are looked up two at a time, which halves the work."""
    if matches.dtype != np.uint8 or matches.shape[1] % 2:
        return by_matches.take(matches)
    return pairs.take(matches.view(np.uint16)).view(np.float64)


def weighted_products(
    bins: np.ndarray, scores: np.ndarray, own: np.ndarray, by_matches: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``own``: the samples' weights summed, with scores, by pair of matched features, by feature with scores.

    Rows that share the bin of a feature meet only the samples of that bin, in one matrix
    product for this feature and those after it; each row reads its own bins from it. The
    sums of a feature's first bin are what its other bins leave of the whole.
    Features whose bins hold many samples come last, where few products are left.
    """
    n, width, samples = len(own), bins.shape[1], len(bins)
    places = np.arange(4)
    order = np.argsort(((bins[:, :, None] == places).mean(axis=0) ** 2).sum(axis=1), kind="stable")
    own, pairs = own[:, order], paired_weights(by_matches)
    hot = (bins.T[order][:, None, :] == places[None, :, None]).reshape(4 * width, samples)
    marks = hot.reshape(width, 4, samples)
    matches = np.empty((n, samples), np.min_scalar_type(width))
    weight, with_score = np.zeros(n), np.zeros(n)
    for i in range(0, n, ROWS_A_PRODUCT):
        rows = slice(i, i + ROWS_A_PRODUCT)
        matches[rows] = match_counts(hot, own[rows])
        w = weights_of(matches[rows], by_matches, pairs)
        weight[rows], with_score[rows] = w.sum(axis=1), w @ scores
    products, scored = np.zeros((n, width, width)), np.zeros((n, width))
    for j in range(width):
        after = width - j - 1
        for place in places:
            held, inside = np.flatnonzero(own[:, j] == place), np.flatnonzero(marks[j, place])
            if not len(held) or not len(inside):
                continue
            others = [marks[j + 1 :, p][:, inside].T for p in (1, 2, 3)]
            later = np.column_stack([np.ones(len(inside)), scores[inside], *others])
            if len(inside) % 2:
                # One more sample that counts for nothing, so that bytes come in pairs.
                inside, later = np.append(inside, 0), np.vstack([later, np.zeros(later.shape[1])])
            for i in range(0, len(held), ROWS_A_PRODUCT):
                line = held[i : i + ROWS_A_PRODUCT]
                found = weights_of(np.ascontiguousarray(matches[line][:, inside]), by_matches, pairs) @ later
                products[line, j, j], scored[line, j] = found[:, 0], found[:, 1]
                second, third, fourth = (found[:, 2 + k * after : 2 + (k + 1) * after] for k in range(3))
                first = found[:, :1] - second - third - fourth
                products[line, j, j + 1 :] = np.choose(own[line, j + 1 :], [first, second, third, fourth])
            products[held, j + 1 :, j] = products[held, j, j + 1 :]
    back = np.argsort(order)
    return weight, with_score, products[:, back[:, None], back], scored[:, back]


@dataclass
class Lime:
    """Surrogate explainer; ``explain`` adds ``phi`` (null outside the top), ``explained_class``, ``p``.

    The class explained is the predicted one, or ``explained_class`` where the
    table already has that column. The sample count, the kernel width and the
    penalties default to the method's published settings.
    """

    features: list[str]
    sampler: Sampler
    scorer: object
    n_samples: int = 5000
    n_features: int = 10
    seed: int = 42
    kernel_width: float | None = None
    select_alpha: float = 0.01
    fit_alpha: float = 1.0

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], scorer, **settings) -> Lime:
        return cls(features, fit_sampler(df, features), scorer, **settings)

    def samples(self, predict) -> tuple[np.ndarray, np.ndarray]:
        """Bins and class-1 probabilities of the shared samples; the row itself is one more."""
        bins, values = self.sampler.draw(np.zeros(1, np.int64), self.n_samples - 1, self.seed)
        return bins[0].astype(np.int8), predict(values[0])

    def _match_weights(self, width: int) -> np.ndarray:
        """Weight of a sample by the number of features in which it falls into the row's bins."""
        span = self.kernel_width or 0.75 * np.sqrt(width)
        return np.sqrt(np.exp(-(width - np.arange(width + 1)) / span**2))

    def solve(self, bins: np.ndarray, scores: np.ndarray, x: np.ndarray, p: np.ndarray, classes: np.ndarray | None):
        """Weights (NaN outside the top) and classes of some rows.

        The ridge with a free intercept needs only weighted sums of products. Those of
        the selected features are part of those of all, so they are summed once. The row
        itself is one more sample, of weight 1 and equal to itself everywhere. The other
        class has the opposite right side. Features that weigh the same are taken in their order.
        """
        width, own = x.shape[1], self.sampler.bins(x)
        explained = (p > 0.5).astype(np.int64) if classes is None else classes
        k = min(self.n_features, width)
        phi = np.full(x.shape, np.nan)
        size = max(64, min(ROWS_A_BLOCK, MOST_PRODUCTS // max(width, 1) ** 2))
        for first_row in range(0, len(x), size):
            rows = slice(first_row, first_row + size)
            weight, with_score, products, scored = weighted_products(bins, scores, own[rows], self._match_weights(width))
            total = (weight + 1.0)[:, None]
            sums = np.einsum("ijj->ij", products) + 1.0
            left = products + 1.0 - sums[:, :, None] * sums[:, None, :] / total[:, :, None]
            mine = p[rows, None]
            right = scored + mine - sums * ((with_score[:, None] + mine) / total)
            right[explained[rows] != 1] *= -1.0
            first = np.linalg.solve(left + self.select_alpha * np.eye(width), right[:, :, None])[:, :, 0]
            top = np.sort(np.argsort(rank_matrix(first), axis=1, kind="stable")[:, :k], axis=1)
            line = np.arange(len(top))[:, None]
            chosen = left[line[:, :, None], top[:, :, None], top[:, None, :]] + self.fit_alpha * np.eye(k)
            phi[first_row + line, top] = np.linalg.solve(chosen, right[line, top][:, :, None])[:, :, 0]
        return phi, explained

    def explain(self, df: DataFrame, key: str = KEY) -> DataFrame:
        """Rows are told apart by their features alone; ``key`` may be of any type."""
        given = "explained_class" in df.columns
        predict = self.scorer.batch_function()
        shipped = df.sparkSession.sparkContext.broadcast(
            (replace(self, scorer=None), predict, *self.samples(predict))
        )

        @F.arrow_udf("struct<phi:array<double>,explained_class:int,p:double>")
        def surrogates(x: pa.Array, wanted: pa.Array) -> pa.Array:
            lime, predict, bins, scores = shipped.value
            rows = matrix_of(x)
            p = predict(rows) if len(rows) else np.zeros(0)
            classes = wanted.to_numpy(zero_copy_only=False) if given else None
            phi, explained = lime.solve(bins, scores, rows, p, classes)
            columns = [list_array(phi, np.isnan(phi)), pa.array(explained.astype(np.int32)), pa.array(p)]
            return pa.StructArray.from_arrays(columns, ["phi", "explained_class", "p"])

        wanted = F.col("explained_class") if given else F.lit(0)
        kept = [c for c in df.columns if c not in ("phi", "explained_class", "p")]
        return df.withColumn("__s", surrogates(F.col("x"), wanted)).select(*kept, "__s.*")

    def refit_gap(self, explained: DataFrame):
        """Largest gap between a row's weights and those of a plain least-squares fit, for checks.

        The row is one more sample and the intercept a column. The loss is quadratic, so one
        Newton step from the given weights, by the residuals of all samples, ends at its least point.
        """
        predict = self.scorer.batch_function()
        shipped = explained.sparkSession.sparkContext.broadcast((replace(self, scorer=None), *self.samples(predict)))

        @F.arrow_udf("double")
        def gaps(phi: pa.Array, x: pa.Array, p: pa.Array, wanted: pa.Array) -> pa.Array:
            lime, bins, scores = shipped.value
            return pa.array(lime.newton_gaps(bins, scores, matrix_of(phi), matrix_of(x), p.to_numpy(), wanted.to_numpy()))

        return gaps(F.col("phi"), F.col("x"), F.col("p"), F.col("explained_class"))

    def newton_gaps(
        self, bins: np.ndarray, scores: np.ndarray, weights: np.ndarray, x: np.ndarray, p: np.ndarray, classes: np.ndarray
    ) -> np.ndarray:
        """Largest step of each row's weights to the least point of its penalised loss."""
        width, own, samples = x.shape[1], self.sampler.bins(x), len(scores) + 1
        hot = (bins.T[:, None, :] == np.arange(4)[None, :, None]).reshape(4 * width, len(scores))
        # The row itself is the last sample, matched in every feature and of weight 1.
        marks = np.column_stack([hot, np.ones(4 * width)])
        roots, out = np.sqrt(self._match_weights(width)), np.zeros(len(x))
        z, y = np.ones((width + 2, samples)), np.empty(samples)
        for first in range(0, len(x), ROWS_A_PRODUCT):
            matches = match_counts(hot, own[first : first + ROWS_A_PRODUCT])
            for i, near in enumerate(matches, first):
                root = np.append(roots.take(near), 1.0)
                y[:-1], y[-1] = scores, p[i]
                if classes[i] != 1:
                    np.subtract(1.0, y, out=y)
                top = np.flatnonzero(~np.isnan(weights[i]))
                k = len(top)
                # Lines of the features, the intercept and the residuals, each times the root of the weight.
                lines = z[: k + 2]
                marks.take(4 * top + own[i, top], axis=0, out=lines[:k], mode="clip")
                lines[k + 1] = y - weights[i, top] @ lines[:k]
                lines[k] = 1.0
                lines *= root
                sums = lines @ lines.T
                now, penalty = np.append(weights[i, top], 0.0), np.append(np.full(k, self.fit_alpha), 0.0)
                step = np.linalg.solve(sums[:-1, :-1] + np.diag(penalty), sums[:-1, -1] - penalty * now)
                out[i] = np.abs(step[:-1]).max(initial=0.0)
        return out

    def batch_function(self):
        """``(x, classes) -> phi`` for a batch, absent weights as NaN."""
        predict = self.scorer.batch_function()
        return partial(_weights, replace(self, scorer=None), predict, *self.samples(predict))

    def condition_texts(self) -> list[str]:
        """The texts of each feature's four bins, feature by feature."""
        texts = []
        for j, f in enumerate(self.features):
            a, b, c = (float(v) for v in self.sampler.cuts[j])
            texts += [f"{f} <= {a:.2f}", f"{a:.2f} < {f} <= {b:.2f}", f"{b:.2f} < {f} <= {c:.2f}", f"{f} > {c:.2f}"]
        return texts

    def conditions(self, x: str = "x"):
        """The text of each feature's bin for this row, such as ``0.50 < V1 <= 1.25``.

        A missing value falls into the first bin, as it does in the fit.
        """
        names, texts = self.condition_texts(), []
        for j in range(len(self.features)):
            a, b, c = (float(v) for v in self.sampler.cuts[j])
            value = F.col(x)[j]
            texts.append(
                F.when(value.isNull() | F.isnan(value) | (value <= a), names[4 * j])
                .when(value <= b, names[4 * j + 1])
                .when(value <= c, names[4 * j + 2])
                .otherwise(names[4 * j + 3])
            )
        return F.array(*texts)

    def long_values(self, explained: DataFrame, key: str = KEY) -> DataFrame:
        """``(id, rank, feature, feature_pos, condition, weight)``.

        Only the features that have a weight leave a row's arrays; the text is looked up by feature and bin.
        """
        shipped = explained.sparkSession.sparkContext.broadcast(self.sampler)

        @F.arrow_udf("array<struct<rank:int,pos:int,bin:int,weight:double>>")
        def entries(phi: pa.Array, x: pa.Array) -> pa.Array:
            weights = matrix_of(phi)
            ranks = rank_matrix(weights)
            row, pos = np.nonzero(ranks)
            offsets = np.append(0, np.cumsum((ranks > 0).sum(axis=1)))
            bins = shipped.value.bins(matrix_of(x)) if len(x) else ranks
            columns = [ranks[row, pos], pos.astype(np.int32), bins[row, pos].astype(np.int32), weights[row, pos]]
            rows = pa.StructArray.from_arrays([pa.array(c) for c in columns], ["rank", "pos", "bin", "weight"])
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

        # The outer form, as in ``explode_positions``.
        rows = explained.select(key, F.inline_outer(entries("phi", "x"))).where(F.col("rank").isNotNull())
        return rows.select(
            key,
            "rank",
            literal_names(self.features)[F.col("pos")].alias("feature"),
            (F.col("pos") + 1).alias("feature_pos"),
            literal_names(self.condition_texts())[4 * F.col("pos") + F.col("bin")].alias("condition"),
            "weight",
        )


def _weights(lime: Lime, predict, bins: np.ndarray, scores: np.ndarray, x: np.ndarray, classes) -> np.ndarray:
    return lime.solve(bins, scores, x, predict(x), classes)[0]


def prediction_summary(scored: DataFrame, key: str = KEY, names: tuple[str, str] = CLASS_NAMES) -> DataFrame:
    """``(id, class, probability)``: the likelier class and its probability."""
    fraud = F.col("p") > 0.5
    return scored.select(
        key,
        F.when(fraud, names[1]).otherwise(names[0]).alias("class"),
        F.when(fraud, F.col("p")).otherwise(1 - F.col("p")).alias("probability"),
    )
