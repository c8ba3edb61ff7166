"""Quality classifier: hierarchical empirical Bayes over hosts and paths.

A logistic model of the text alone, fitted on a bounded sample of labelled rows, gives each document its evidence: the log of
how much likelier its text is among good documents. Grouped sums of the model's probabilities over all documents give the
share of good documents per path and per host. Moments of these shares say how far sites differ, and so how many documents'
worth of trust the level above gets: a path is drawn towards its host and a host towards all documents, sparse ones most.
The posterior of a document joins its evidence with the share of its path; it is left out of that share itself.

Results for odd input: null and empty texts are valued as texts of no words; a null host or path is a site of its own; without
labelled rows of both classes all evidence is zero and every document stays; repeated rows are valued alike and all count;
labels that occur twice count twice; other columns are kept and not read; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import hashed_sample, stored

#: Labelled rows in the fit at most; chosen by a hash of the id.
FIT_ROWS = 20_000
THRESHOLD = 0.5
RIDGE = 1.0
LIMIT = 12.0  # of evidence, either way


WIDTH = 8


def text_features(text: Column) -> Column:
    """Shares and mean lengths that tell prose from repeated, shouted, tabular or symbol-ridden text; ``WIDTH`` values in 0 to 1."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    once = F.array(F.struct(whole.alias("text"), F.filter(F.split(whole, r"\s+"), lambda w: w != "").alias("words")))

    def features(row: Column) -> Column:
        length, count = F.greatest(F.length(row["text"]), F.lit(1)), F.greatest(F.size(row["words"]), F.lit(1))

        def share(pattern: str) -> Column:
            return (1 - F.length(F.regexp_replace(row["text"], pattern, "")) / length).cast("double")

        later = F.slice(row["words"], 2, F.greatest(F.size(row["words"]) - 1, F.lit(0)))
        repeats = F.filter(F.zip_with(later, row["words"], lambda a, b: a == b), lambda same: same)
        return F.array(
            share(r"\p{Lu}+"),
            share(r"[^\p{L}\p{N}\s]+"),
            share(r"\p{N}+"),
            F.size(F.array_distinct(row["words"])) / count,
            F.size(repeats) / count,
            F.least(F.lit(1.0), length / count / 40),
            F.least(F.lit(1.0), F.log1p(F.size(row["words"]).cast("double")) / 12),
            share(r"\|+"),
        )

    return F.transform(once, features)[0]


@dataclass
class TextModel:
    """Logistic model over features and their squares."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    bias: float
    prior: float

    def evidence(self, text: Column) -> Column:
        """Log of how much likelier the text is among good documents."""
        flat = F.lit(self.bias - self.prior)
        if not any(self.weights):
            return flat

        def total(x: Column) -> Column:
            out = flat
            for k in range(WIDTH):
                out = out + (x[k] - self.mean[k]) * (self.weights[k] / self.scale[k])
                j = k + WIDTH
                out = out + (x[k] * x[k] - self.mean[j]) * (self.weights[j] / self.scale[j])
            return F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), out))

        return F.transform(F.array(text_features(text)), total)[0]


def fit_text_model(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> TextModel:
    """Fit on at most ``rows`` labelled rows, whose features (not texts) come to the driver."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    chosen = hashed_sample(chosen, rows, "doc_id", "y")
    # The sample's size bounds what is broadcast.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("y", text_features(F.col("text")).alias("x")).collect()
    y = np.array([r.y for r in sample], float)
    if not len(y) or y.min() == y.max():
        return TextModel([0.0] * (2 * WIDTH), [1.0] * (2 * WIDTH), [0.0] * (2 * WIDTH), 0.0, 0.0)
    x = np.array([r.x for r in sample], float)
    x = np.hstack([x, x * x])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    keep = np.r_[np.full(z.shape[1] - 1, RIDGE), 1e-6]
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return TextModel(mean.tolist(), scale.tolist(), w[:-1].tolist(), float(w[-1]), float(np.log(y.mean() / (1 - y.mean()))))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def trust(n: float, groups: float, mean: float, squares: float, noise: float) -> float:
    """Documents' worth of trust in the level above, by moments.

    ``squares``: weighted mean square of the groups' distance from the level above; ``noise``: what chance alone would give.
    """
    spread = max(squares - noise, 1e-6 * mean * (1 - mean))
    return float(np.clip(mean * (1 - mean) / spread - 1, 1.0, 1e6)) if groups > 1 and n > groups else 1e6


def valued(docs: DataFrame, model: TextModel, host: str, path: str) -> DataFrame:
    """``docs`` with host, path, evidence and the model's own probability, in columns that start with _q_."""
    own = docs.withColumns({"_q_host": F.col(host), "_q_path": F.col(path), "_q_evidence": model.evidence(F.col("text"))})
    return own.withColumn("_q_p", logistic(F.col("_q_evidence") + F.lit(model.prior)))


def site_shares(values: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Sums per path with those of its host, and the global numbers: mean, and trust at either level. The driver sees seven sums."""
    paths = values.groupBy("_q_host", "_q_path").agg(F.count("*").alias("path_n"), F.sum("_q_p").alias("path_sum"))
    hosts = paths.groupBy(F.col("_q_host").alias("of_host")).agg(F.sum("path_n").alias("host_n"), F.sum("path_sum").alias("host_sum"))
    sites = stored(paths.join(hosts, F.col("_q_host").eqNullSafe(F.col("of_host"))).drop("of_host"), "sites")
    path_far = F.pow(F.col("path_sum") / F.col("path_n") - F.col("host_sum") / F.col("host_n"), 2) * F.col("path_n")
    low = sites.agg(F.count("*").alias("paths"), F.sum("path_n").alias("n"), F.sum("path_sum").alias("s"), F.sum(path_far).alias("far")).first()
    n = float(low.n or 0)
    mean = min(max((low.s or 0.0) / n, 1e-3), 1 - 1e-3) if n else 0.5
    host_far = F.pow(F.col("host_sum") / F.col("host_n") - F.lit(mean), 2) * F.col("host_n")
    high = sites.select("_q_host", "host_n", "host_sum").distinct().agg(F.count("*").alias("hosts"), F.sum(host_far).alias("far")).first()
    chance = mean * (1 - mean) / max(n, 1)
    return sites, {
        "mean": mean,
        "host_trust": trust(n, high.hosts, mean, (high.far or 0.0) / max(n, 1), chance * high.hosts),
        "path_trust": trust(n, low.paths, mean, (low.far or 0.0) / max(n, 1), chance * (low.paths - high.hosts)),
    }


def with_posterior(values: DataFrame, sites: DataFrame, numbers: dict[str, float]) -> DataFrame:
    """``values`` with _q_share (of good documents on its path, itself left out) and _q_quality (the posterior)."""
    right = sites.select([F.col(c).alias(f"_q_of_{c.removeprefix('_q_')}") for c in sites.columns])
    joined = values.join(right, F.col("_q_host").eqNullSafe(F.col("_q_of_host")) & F.col("_q_path").eqNullSafe(F.col("_q_of_path")))
    of_host = (F.col("_q_of_host_sum") - F.col("_q_p") + numbers["host_trust"] * numbers["mean"]) / (F.col("_q_of_host_n") - 1 + numbers["host_trust"])
    of_path = (F.col("_q_of_path_sum") - F.col("_q_p") + numbers["path_trust"] * of_host) / (F.col("_q_of_path_n") - 1 + numbers["path_trust"])
    share = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), of_path))
    return joined.withColumn("_q_share", share).withColumn("_q_quality", logistic(F.col("_q_evidence") + F.log(F.col("_q_share") / (1 - F.col("_q_share")))))


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """(doc_id, host, path, evidence, site_share, quality, keep) for every document; ``path`` is a part of its host."""
    model = fit_text_model(docs, labels)
    values = stored(valued(docs, model, host, path).select("doc_id", "_q_host", "_q_path", "_q_evidence", "_q_p"), "evidence")
    found = with_posterior(values, *site_shares(values))
    names = {"_q_host": "host", "_q_path": "path", "_q_evidence": "evidence", "_q_share": "site_share", "_q_quality": "quality"}
    return found.select("doc_id", *[F.col(c).alias(n) for c, n in names.items()], (F.col("_q_quality") >= THRESHOLD).alias("keep"))


def kept(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns."""
    rows = docs.select(F.struct("*").alias("row"), "text", F.col(host).alias("host"), F.col(path).alias("path"))  # given columns of any name stay as they are
    values = valued(rows, fit_text_model(docs, labels), "host", "path")
    return with_posterior(values, *site_shares(values)).where(F.col("_q_quality") >= THRESHOLD).select("row.*")
