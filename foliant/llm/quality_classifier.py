"""Document quality with evidence shared along sites and their paths, by hierarchical empirical Bayes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from foliant.llm import kernels
from foliant.llm.scratch import Scratch

#: Labelled rows that the document classifier is fitted on, at most.
TRAIN_ROWS = 20_000
#: The least and most documents that a prior may weigh.
PRIOR_RANGE = (5.0, 500.0)
#: Probabilities are summed as whole numbers of this fraction, so sums are the same in any order; 9 * 10**12 rows fit.
UNIT = 1_000_000
#: Rates stay this far from 0 and 1.
EDGE = 1e-3
FEATURES = ("symbols", "capitals", "bars", "bangs", "digits", "dup_words", "log_words", "word_length", "lines_a_word", "top_word")


def text_features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text, from a few passes over the bytes."""
    buf, offsets = kernels.buffers(column)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    kinds = np.zeros((5, 256), np.uint8)
    for k, chars in enumerate((b"#*$%&<>", bytes(range(65, 91)), b"|", b"!", b"0123456789")):
        kinds[k, list(chars)] = 1
    first = 0
    while first < len(out):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + 2 * kernels.BLOCK, "right")) - 1)
        own = offsets[first : last + 1] - offsets[first]
        some = buf[offsets[first] : offsets[last]]
        starts, ends, counts = kernels.words(some, own)
        solid = np.flatnonzero(np.diff(own) > 0)

        def total(x: np.ndarray) -> np.ndarray:
            sums = np.zeros(last - first)
            if len(solid):
                sums[solid] = np.add.reduceat(x, own[solid], dtype=np.int64)
            return sums

        size = np.maximum(np.diff(own), 1)
        n = np.maximum(counts, 1)
        for k in range(5):
            out[first:last, k] = total(kinds[k][some]) / size
        accents = np.zeros(len(some), np.uint8)
        accents[1:] = (some[:-1] == 0xC3) & (some[1:] >= 0x80) & (some[1:] <= 0x9E) & (some[1:] != 0x97)
        out[first:last, 1] += total(accents) / size
        lines = total((some == 10).astype(np.uint8))
        out[first:last, 6] = np.log1p(counts)
        at = np.concatenate([[0], np.cumsum(counts)])
        letters = np.concatenate([[0], np.cumsum(ends - starts)])
        out[first:last, 7] = (letters[at[1:]] - letters[at[:-1]]) / n
        out[first:last, 8] = lines / n
        h = kernels.hash_spans(some, starts, ends, kernels.FOLD)
        for i in np.flatnonzero(counts):
            times = np.unique(h[at[i] : at[i + 1]], return_counts=True)[1]
            out[first + i, 5] = 1 - len(times) / counts[i]
            out[first + i, 9] = times.max() / counts[i]
        first = last
    return out


def _features(text: pa.Array) -> pa.Array:
    values = text_features(text)
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))


class Evidence:
    """Logistic regression on standardised features; without both classes it says nothing either way."""

    def __init__(self, rows: np.ndarray, good: np.ndarray, ridge: float = 1.0):
        self.mean = rows.mean(axis=0) if len(rows) else np.zeros(len(FEATURES))
        self.scale = np.maximum(rows.std(axis=0), 1e-9) if len(rows) else np.ones(len(FEATURES))
        self.weights = np.zeros(len(FEATURES) + 1)
        self.rate = 0.5
        if 0 < good.sum() < len(good):
            self.rate = float(good.mean())
            x = self._design(rows)
            penalty = np.diag([ridge] * len(FEATURES) + [1e-6])
            for _ in range(50):  # Newton's method, with the step held back
                p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
                hess = x.T @ (x * (p * (1 - p))[:, None]) + penalty
                step = np.linalg.solve(hess, x.T @ (good - p) - penalty @ self.weights)
                self.weights += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
                if np.abs(step).max() < 1e-8:
                    break

    def _design(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.scale, -8, 8)
        return np.hstack([z, np.ones((len(rows), 1))])

    def logit(self, features: str) -> str:
        """SQL for the log odds of an array column of features."""
        terms = [f"{w!r} * greatest(-8D, least(8D, ({features}[{i}] - {m!r}) / {s!r}))" for i, (w, m, s) in enumerate(zip(self.weights.tolist(), self.mean.tolist(), self.scale.tolist()))]
        return " + ".join([*terms, repr(self.weights[-1].item())])

    def settle(self) -> Evidence:
        """Rounds the model, so that the order of a library's sums doesn't show in it."""
        self.mean, self.scale, self.weights = self.mean.round(9), np.maximum(self.scale.round(9), 1e-9), self.weights.round(9)
        return self


def fit(features: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Evidence:
    """Evidence from a bounded sample of labelled rows, the first by a hash of the id.

    features: doc_id, features. labels: doc_id, quality. Rows without id or
    label don't count.
    """
    sample = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(train_rows)
    rows = features.join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(2 * train_rows).select("features", "quality").collect()
    x = np.array([r.features for r in rows]).reshape(-1, len(FEATURES))
    return Evidence(x, np.array([r.quality for r in rows], float)).settle()


def site_columns(url: str) -> tuple[Column, Column]:
    """(host, path) of a URL column: the host in lower case without "www.", and the first folder of its path ("" without one)."""
    address = F.col(url)
    host = F.regexp_replace(F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), r"^www\.", "")
    path = F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)/", 1)
    return F.when(address.isNotNull(), host), F.when(address.isNotNull(), path)


def quality_classifier(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str | Column = "source", path: str | Column = "lang", carry: list[str] | None = None, train_rows: int = TRAIN_ROWS, keep_at: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, evidence, host_rate, path_rate, score, kept (and struct ``row`` of the columns in ``carry``).

    A document's evidence is the log odds of a classifier fitted on a bounded
    sample of labelled rows, and its probability p what they amount to. Beta
    posteriors share it along the site: a host's rate of good documents is
    (sum of p + a * global rate) / (n + a), a path's (sum of p + b * host
    rate) / (n + b), both without the document itself, so nothing counts
    twice. The prior weights a and b come from moments: the spread of rates
    between hosts (between paths of a host) less what sampling within them
    explains; the less spread is left, the more sparse sites shrink to the
    rate above them. The score is the evidence with the path's rate in place
    of the global one; kept: keep_at or more, low as losing a clean document
    costs more than keeping a bad one.

    ``host`` and ``path`` are columns or names; ``site_columns`` makes both
    from a URL. The documents table has no address, so by default its source
    stands for the host and its language for a section of it.

    Sums are of whole numbers and scores rounded to 9 places, so reruns agree.
    Groups are summed before they are shuffled: a host with a third of all
    rows costs no more. Group tables hold four numbers a path; they are joined
    by broadcast where Spark measures them small, else by shuffle, where
    adaptive execution splits a hot host.

    Nulls in host or path form groups of their own; a document alone at its
    site has its parent's rate. A null or empty text has the features of no
    words. Null ids stay null; repeated rows count each; equal scores share a
    decision. Very long texts cost memory in proportion to one text. Columns
    that aren't named aren't read. Without labels of both kinds the evidence
    is 0, the score 0.5 and every row is kept. An empty table gives no rows.
    With ``carry`` the features are made twice, in place of a second copy of
    all texts on disk.
    """
    scratch = Scratch(df.sparkSession, "quality")
    extra = [F.struct(*carry).alias("row")] if carry else []
    site = [(F.col(c) if isinstance(c, str) else c).cast("string").alias(name) for c, name in ((host, "host"), (path, "path"))]
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), *site, F.arrow_udf(_features, ArrayType(DoubleType()))(F.coalesce(F.col(text_col), F.lit(""))).alias("features"), *extra)
    known = scratch.save(rows.drop("row"))
    model = fit(known.select("doc_id", "features"), labels, train_rows)
    evidence = F.round(F.expr(model.logit("features")), 9) if model.weights.any() else F.lit(0.0)
    # A probability in units: a whole number, so that no sum depends on its order.
    unit = F.round(UNIT / (1 + F.exp(-evidence))).cast("long")
    square = F.round(F.pow(F.col("u") / UNIT, 2) * UNIT).cast("long")

    sums = [F.count(F.lit(1)).alias("n"), F.sum("u").alias("good"), F.sum(square).alias("squares")]
    paths = scratch.save(known.select("host", "path", unit.alias("u")).groupBy("host", "path").agg(*sums))
    hosts = scratch.save(paths.groupBy("host").agg(*[F.sum(c).alias(f"host_{c}") for c in ("n", "good", "squares")]))
    all_ = hosts.select(F.sum("host_n").alias("n"), F.sum("host_good").alias("good")).first()
    mean = min(max(all_.good / UNIT / all_.n, EDGE), 1 - EDGE) if all_.n else 0.5
    a = prior_size(mean, *_moments(hosts, F.lit(mean), "host_n", "host_good", "host_squares"))
    rated = paths.join(hosts.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h"))).drop("_h")
    b = prior_size(mean, *_moments(rated, F.col("host_good") / UNIT / F.col("host_n"), "n", "good", "squares"))
    table = rated.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "n", "good", "host_n", "host_good")

    scored = (rows if carry else known).withColumn("evidence", evidence).withColumn("u", unit)
    scored = scored.join(scratch.save(table), F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
    scored = scored.withColumn("host_rate", ((F.col("host_good") - F.col("u")) / UNIT + a * mean) / (F.col("host_n") - 1 + a))
    scored = scored.withColumn("path_rate", ((F.col("good") - F.col("u")) / UNIT + b * F.col("host_rate")) / (F.col("n") - 1 + b))
    rate = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), F.col("path_rate")))
    shift = F.log(rate / (1 - rate)) - math.log(mean / (1 - mean))
    score = F.round(1 / (1 + F.exp(-(F.col("evidence") + shift))), 9) if model.weights.any() else F.lit(0.5)
    scored = scored.select("doc_id", "evidence", F.round("host_rate", 9).alias("host_rate"), F.round("path_rate", 9).alias("path_rate"), score.alias("score"), *(["row"] if carry else []))
    return scored.select("doc_id", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= keep_at).alias("kept"), *(["row"] if carry else []))


def _moments(groups: DataFrame, centre: Column, n: str, good: str, squares: str) -> tuple[float, float]:
    """Of groups' rates, weighed by rows: the mean square distance from ``centre``, and what sampling within the groups gives it."""
    rate = F.col(good) / UNIT / F.col(n)
    far = F.round(F.col(n) * F.pow(rate - centre, 2) * UNIT).cast("long")
    # n times a group's sampling variance is its unbiased variance; a single row says nothing on it.
    noise = F.when(F.col(n) > 1, F.greatest(F.lit(0.0), (F.col(squares) / UNIT - F.col(n) * rate * rate) / (F.col(n) - 1))).otherwise(F.pow(rate - centre, 2))
    got = groups.select(F.sum(far).alias("far"), F.sum(F.round(noise * UNIT).cast("long")).alias("noise"), F.sum(n).alias("n")).first()
    return (got.far / UNIT / got.n, got.noise / UNIT / got.n) if got.n else (0.0, 0.0)


def prior_size(mean: float, spread: float, noise: float) -> float:
    """Documents that a Beta prior weighs as much as, if its mean is this and its variance the spread less the noise."""
    variance = spread - noise
    if variance <= 0:
        return PRIOR_RANGE[1]
    return min(max(mean * (1 - mean) / variance - 1, PRIOR_RANGE[0]), PRIOR_RANGE[1])
