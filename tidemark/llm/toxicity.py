"""Toxicity by class-conditional Kneser-Ney models."""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gather, remainder, row_key, settle, small_batches

#: How many standard deviations of an expression's count are discounted; the
#: calibration rows choose one of them.
SPREADS = (2.0, 3.0, 5.0, 7.0, 10.0, 14.0)
#: The classifier is fitted to about so many calibration rows at most.
SAMPLE = 20_000
#: Labels, and the expressions in which the models differ, of up to so many bytes are sent to every task.
BROADCAST_BYTES = 64 << 20
EDGES = b".,;:!?\"'()[]{}|*$%&#"
FLOOR = 0.001
#: A task hands on its counts once it holds so many expressions.
HELD = 2_000_000


def expressions(text: str | None) -> set[bytes]:
    """The distinct words of a text in lower case (A-Z) without punctuation at their ends."""
    return {w for w in (x.strip(EDGES) for x in set((text or "").encode().lower().split())) if w}


def hashed(words: set[bytes]) -> np.ndarray:
    """64-bit hashes of expressions, by which they are counted."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


def discount(n: Column, total: Column, share: float, spread: float) -> Column:
    """What a class's count ``n`` of an expression loses to the backoff.

    It is one more than what the class would have of the expression's ``total``
    count if it had its ``share`` of it and half as much again, and ``spread``
    standard deviations of that.
    """
    expected = total * F.lit(share)
    return F.least(n, 1.5 * expected + spread * F.sqrt(expected) + 1)


class Models:
    """log P(expression | class) for ordinary (0) and toxic (1) texts.

    The contexts of an expression are the texts it occurs in; each counts once,
    however often the expression or the text is repeated. A class discounts its
    counts and gives what that frees to a backoff that both share:

        P(x | c) = (n_c(x) - D_c(x)) / N_c + L_c * B(x),  L_c = sum of D_c / N_c,

    where B(x) is x's share of all contexts, N_c the class's counts altogether and
    D_c(x) grows with the count that x would have in c if both classes used it
    alike (see ``discount``). So whatever both use alike, and whatever is too rare
    to tell, is left to B. There log P(x | 1) - log P(x | 0) is ``base``, the
    logarithm of L_1 / L_0, whatever B is; only the other expressions, those with a
    count beyond the discount in some class, are looked up in ``decisive``.
    """

    def __init__(self, counts: DataFrame, spreads: tuple[float, ...] = SPREADS):
        """``counts`` (h, n0, n1) are numbers of texts."""
        self.spreads = spreads
        totals = counts.agg(F.sum("n0"), F.sum("n1")).first()
        self.n = [int(x or 0) for x in totals]
        every = max(sum(self.n), 1)
        self.backoff = (F.col("n0") + F.col("n1")) / F.lit(float(every))
        over = lambda c, spread: F.col(f"n{c}") - discount(F.col(f"n{c}").cast("double"), F.col("n0") + F.col("n1"), self.n[c] / every, spread)
        self.kept = [[over(c, s) / F.lit(float(max(self.n[c], 1))) for c in (0, 1)] for s in spreads]
        least = self.kept[0]  # the smallest spread: no expression is decisive for a larger one alone
        self.candidates = gather(counts.filter((least[0] > 0) | (least[1] > 0)))
        sums = self.candidates.agg(*(F.coalesce(F.sum(k), F.lit(0.0)) for kept in self.kept for k in kept)).first()
        self.left = [[1 - sums[2 * i], 1 - sums[2 * i + 1]] for i in range(len(spreads))]

    def base(self, i: int) -> float:
        """The ratio of what isn't decisive, with the i-th spread."""
        return log(max(self.left[i][1], 1e-12)) - log(max(self.left[i][0], 1e-12))

    def decisive(self, i: int) -> DataFrame:
        """(h, gain): by how much expressions exceed that ratio."""
        kept, left = self.kept[i], self.left[i]
        logs = [F.log(kept[c] + F.lit(left[c]) * self.backoff) for c in (0, 1)]
        return self.candidates.filter((kept[0] > 0) | (kept[1] > 0)).select("h", (logs[1] - logs[0] - F.lit(self.base(i))).alias("gain"))


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the labelled rows; of several labels the highest holds."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    if known.count() * 16 <= BROADCAST_BYTES:
        known = F.broadcast(known)
    return docs.select("doc_id", "text").join(known, "doc_id")


def class_counts(rows: DataFrame) -> DataFrame:
    """(h, n0, n1): in how many distinct texts of each class an expression occurs."""
    same = rows.withColumn("same", F.xxhash64("text"))
    firsts = gather(same.groupBy("same", "toxic").agg(F.min("doc_id").alias("doc_id")))
    # Of equal texts of a class one is read; rows that repeat it under its id are merged below.
    texts = same.join(firsts, ["same", "toxic", "doc_id"], "left_semi").select("doc_id", "same", "text", "toxic")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list[np.ndarray]] = [[], []]

        def rows() -> pd.DataFrame:
            (a, n), (b, m) = (np.unique(np.concatenate([np.empty(0, np.int64), *h]), return_counts=True) for h in held)
            held[0].clear(), held[1].clear()
            return pd.DataFrame({"h": np.concatenate([a, b]), "n0": np.concatenate([n, 0 * m]), "n1": np.concatenate([0 * n, m])})

        size = 0
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                held[int(toxic == 1)].append(hashed(expressions(text)))
                size += len(held[int(toxic == 1)][-1])
                if size > HELD:
                    yield rows()
                    size = 0
        yield rows()

    keys = texts.groupBy("doc_id", "same", "toxic").agg(F.count(F.lit(1)).alias("n"))
    once = texts if keys.filter("n > 1").isEmpty() else texts.dropDuplicates(["doc_id", "same", "toxic"])
    return once.select("text", "toxic").mapInPandas(count, "h long, n0 long, n1 long").groupBy("h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def gains(docs: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """``docs`` with ``__gains``: for each table the sum of its gains over a text's expressions, by their number.

    The tables go to all tasks if they measure little enough; else the texts' hashes
    are dealt out to meet them.
    """
    n = [t.count() for t in tables]
    if sum(n) * 16 <= BROADCAST_BYTES:
        found = [t.orderBy("h").toPandas() for t in tables]
        sent = docs.sparkSession.sparkContext.broadcast([(t["h"].to_numpy(np.int64), t["gain"].to_numpy(float)) for t in found])

        @F.pandas_udf("array<double>")
        def add(texts: pd.Series) -> pd.Series:
            return pd.Series([[_sum(h, keys, values) / max(len(h), 1) for keys, values in sent.value] for h in (hashed(expressions(t)) for t in texts)])

        return docs.withColumn("__gains", add("text"))

    @F.pandas_udf("array<bigint>")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([hashed(expressions(t)) for t in texts])

    keys = ["__k1", "__k2"]
    named = docs.withColumns(dict(zip(keys, row_key(F.col("doc_id"), F.col("text")), strict=True)))
    rows = named.select(*keys, hashes("text").alias("h")).dropDuplicates(keys)
    rows = rows.select(*keys, F.size("h").alias("n"), F.explode("h").alias("h"))
    for i, t in enumerate(tables):
        rows = rows.join(t.withColumnRenamed("gain", f"g{i}"), "h", "left")
    sums = rows.groupBy(*keys).agg(F.array(*(F.coalesce(F.sum(f"g{i}"), F.lit(0.0)) / F.max("n") for i in range(len(tables)))).alias("__gains"))
    none = F.array(*[F.lit(0.0)] * len(tables))
    return named.join(sums, keys, "left").withColumn("__gains", F.coalesce("__gains", none)).drop(*keys)


def _sum(h: np.ndarray, keys: np.ndarray, values: np.ndarray) -> float:
    if not len(h) or not len(keys):
        return 0.0
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    # Sorted, so that equal texts have equal sums.
    return float(np.sort(values[at[keys[at] == h]]).sum())


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Intercept, slope and loss of a logistic curve, by Newton steps."""
    design, w = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (y - p) - ridge * w
        w += np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), slope)
    p = np.clip(1 / (1 + np.exp(-np.clip(design @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return float(w[0]), float(w[1]), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def curve(gain: np.ndarray) -> np.ndarray:
    """An increasing function of the ratio of likelihoods, on which the logistic curve stands."""
    return np.where(gain >= 0, np.log(np.maximum(gain, 0) + FLOOR), np.log(FLOOR) + np.minimum(gain, 0))


def judged(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """``docs`` with a struct ``__judged`` (held_out, score, predicted, log_ratio) beside their own columns.

    See ``score_toxicity``, which hands these out under their names.
    """
    small_batches(docs.sparkSession)
    fold = remainder(F.col("doc_id"), folds)
    labelled = with_labels(docs, labels).filter(fold != 0)
    share = min(1.0, 0.95 * SAMPLE / max(1, labelled.filter(fold == 1).count()))
    calibrates = (fold == 1) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    models = Models(settle(class_counts(labelled.filter(~calibrates))))
    tables = [models.decisive(i) for i in range(len(models.spreads))]
    seen = gains(labelled.filter(calibrates), tables).select("__gains", "toxic").toPandas()  # SAMPLE rows
    y = (seen["toxic"] == 1).to_numpy(float)
    if 0 < y.sum() < len(y):
        each = np.array(seen["__gains"].tolist())
        fits = [(*fit_logistic(curve(each[:, i]), y), i) for i in range(len(tables))]
        start, slope, _, best = min((f for f in fits if f[1] > 0), key=lambda f: (f[2], f[3]), default=(fits[0][0], 0.0, 0.0, 0))
    else:
        share = (y.sum() + 0.5) / (len(y) + 1)
        start, slope, best = log(share / (1 - share)), 0.0, 0
    gain = F.col("__gains")[0]
    at = F.when(gain >= 0, F.log(gain + FLOOR)).otherwise(F.lit(log(FLOOR)) + gain)
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), start + slope * at))))
    found = gains(docs, [tables[best]]).withColumn("__score", score)
    return found.withColumn(
        "__judged", F.struct((fold == 0).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"), (gain + models.base(best)).alias("log_ratio"))
    ).drop("__gains", "__score")


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """``docs`` with held_out, score, predicted and log_ratio.

    Rows in fold 0 (crc32 of doc_id) are held out. Of the labelled others, about
    ``SAMPLE`` rows of fold 1 at most (those whose hashed ids are below a bound)
    calibrate, and all the rest teach the two models (see ``Models``), in which
    equal texts of a class count once. ``log_ratio`` is the text's log-likelihood
    under the toxic model less that under the ordinary one, by its number of
    expressions, that is distinct words. The score is a logistic curve on an
    increasing function of that; the calibration rows give the curve, and of
    several discounts the one of least loss. Only the text decides about a score.

    Null and empty texts have no evidence and get the curve's score for none.
    Without labels of both classes all texts get the share of toxic labels, 0.5 if
    there are none. A null label teaches nothing; of several labels of an id the
    highest holds; a null id has no label. All rows are kept, with their columns,
    but for columns of these names, which are replaced.
    """
    found = judged(docs, labels, folds)
    made = {"held_out", "score", "predicted", "log_ratio"}
    return found.select(*(found[c] for c in docs.columns if c not in made), "__judged.*")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that are predicted toxic; all columns keep their values.

    Repeated rows share their fate, and null and empty texts that of texts without
    evidence. An empty table stays empty.
    """
    return judged(docs, labels).filter("__judged.predicted = 0").drop("__judged")
