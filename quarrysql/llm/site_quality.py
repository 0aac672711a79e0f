"""Quality classifier with site evidence: hierarchical empirical Bayes over hosts and paths.

A logistic model over the measures of the quality rules gives each document its own evidence p. Every
host's mean quality is a Beta posterior around the global mean, every path's one around its host's:

    host = (k_host * global + sum of p) / (k_host + n)
    path = (k_path * host   + sum of p) / (k_path + n)

with sums over the site's other documents, so none speaks for itself twice. The prior strengths k come
from the corpus by the method of moments: the less sites differ beyond chance, the larger k and the
more sparse sites shrink. A document's posterior log odds are its own plus those of its path over the
global ones, times ``SITE_WEIGHT``; it is kept when the posterior reaches ``KEEP``.

All sums are grouped aggregations with partial aggregation; sites come back to documents in a join
that adaptive execution may split. The logistic model is fitted on at most ``TRAIN_ROWS`` labelled
rows, taken by a hash of the document id: that bound is a parameter. All else covers every document.

Defined cases: null text counts as empty; null hosts or paths are sites of their own; labels that are
null, or of unknown documents, are ignored; with no label of either kind all evidence is 0.5; a table
of one document has no other evidence than the priors; repeated rows count each; very long texts are
measured whole; a posterior equal to ``KEEP`` is kept; an empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut
from .quality_rules import measure

TRAIN_ROWS = 20_000
SITE_WEIGHT = 0.5
KEEP = 0.5
#: The measures that the model reads, each cut off at the value given.
FEATURES = {"mean_word_chars": 20.0, "symbol_ratio": 1.0, "exclamation_ratio": 1.0, "stop_word_ratio": 0.6, "dup_line_ratio": 1.0, "repeat_ratio": 1.0, "upper_ratio": 1.0, "log_words": 12.0}
#: Bounds of the prior strengths, in documents.
LEAST_PRIOR, MOST_PRIOR = 2.0, 1000.0


@dataclass(frozen=True)
class Logistic:
    """Weights of standardised features; plain numbers, so that it compiles to a column."""

    center: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> "Logistic":
        """Newton steps on the penalised likelihood."""
        n = x.shape[1]
        if len(set(y.tolist())) < 2:
            return cls((0.0,) * n, (1.0,) * n, (0.0,) * n, 0.0)
        center, scale = x.mean(0), x.std(0)
        scale[scale < 1e-9] = 1.0
        z = np.hstack([(x - center) / scale, np.ones((len(x), 1))])
        w = np.zeros(n + 1)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            keep = np.append(np.full(n, ridge), 1e-6)
            h = z.T @ (z * (p * (1 - p))[:, None]) + np.diag(keep + 1e-6)
            step = np.linalg.solve(h, z.T @ (y - p) - keep * w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        return cls(tuple(map(float, center)), tuple(map(float, scale)), tuple(map(float, w[:-1])), float(w[-1]))

    def column(self) -> Column:
        """The probability, clipped away from 0 and 1."""
        z = F.lit(self.bias)
        for name, c, s, w in zip(FEATURES, self.center, self.scale, self.weights):
            z = z + (F.col(name) - F.lit(c)) * F.lit(w / s)
        return F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.lit(1.0) / (F.lit(1.0) + F.exp(-z))))


def features(docs: DataFrame, doc_id: Column, host: Column, path: Column, text: str = "text") -> DataFrame:
    """doc_id, host, path and the model's features; nothing of the text is kept."""
    plain = docs.select(doc_id.alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    df = measure(plain, "text").withColumns({
        "repeat_ratio": F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
        "upper_ratio": F.regexp_count("text", F.lit("[A-ZÄÖÜÉÈÊÇÀÑÓÍ]{2,}")) / F.greatest(F.col("n_words"), F.lit(1)),
        "log_words": F.log1p(F.col("n_words")),
    })
    return df.select("doc_id", "host", "path", *[F.least(F.col(n).cast("double"), F.lit(top)).alias(n) for n, top in FEATURES.items()])


def train(feats: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Logistic:
    """``labels``: doc_id, quality. Labels are counted first; those whose hash of the id is below a share
    of its range that leaves nine tenths of ``rows`` go on, so what is joined and sent to the driver has
    a bound that doesn't grow with the corpus. Should more come, the least hashes count."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = min(1.0, 0.9 * rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else known
    some = feats.join(known, "doc_id").select("doc_id", *FEATURES, "quality").toPandas()
    # Rows come in any order, and sums of floating-point numbers depend on it.
    some = some.assign(h=pd.util.hash_array(some["doc_id"].to_numpy())).sort_values(["h", "doc_id", *FEATURES]).head(rows)
    return Logistic.fit(some[list(FEATURES)].to_numpy(float), (some["quality"].to_numpy(float) > 0).astype(float))


def _strength(sites: DataFrame, mean: float) -> float:
    """The prior strength: how many documents' evidence the prior is worth, by moments.

    The spread of site means around ``mean`` beyond what the spread of documents within sites explains
    is the variance between sites; the ratio of the two is k.
    """
    row = sites.where("n > 1").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("squares") - F.col("total") * F.col("total") / F.col("n")).alias("within"), F.sum(F.col("n") * F.pow(F.col("total") / F.col("n") - mean, 2)).alias("between"),
    ).first()
    n, m = float(row["n"] or 0), int(row["m"] or 0)
    if m < 2 or n <= m:
        return MOST_PRIOR
    within = max(row["within"] / (n - m), 1e-9)
    size = (n - float(row["nn"]) / n) / (m - 1)
    between = (row["between"] / (m - 1) - within) / size
    return float(min(max(within / between, LEAST_PRIOR), MOST_PRIOR)) if between > 0 else MOST_PRIOR


def posterior(evidence: DataFrame, site_weight: float = SITE_WEIGHT, keep: float = KEEP) -> DataFrame:
    """``evidence``: doc_id, host, path, p. Adds host_posterior, path_posterior, quality and kept."""
    sums = lambda *by: evidence.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("total"), F.sum(F.col("p") * F.col("p")).alias("squares"))
    paths = cut(sums("host", "path"))
    hosts = cut(paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")]))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    mean = float(whole["total"] / whole["n"]) if whole["n"] else 0.5
    k_host, k_path = _strength(hosts, mean), _strength(paths, mean)
    h = hosts.select(F.col("host").alias("_h"), F.col("n").alias("n_host"), F.col("total").alias("total_host"))
    sites = paths.join(h, F.col("host").eqNullSafe(F.col("_h"))).select(F.col("host").alias("_host"), F.col("path").alias("_path"), "n_host", "total_host", F.col("n").alias("n_path"), F.col("total").alias("total_path"))
    df = evidence.join(sites, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    host = (k_host * F.lit(mean) + F.col("total_host") - F.col("p")) / (k_host + F.col("n_host") - 1)
    path = (k_path * F.col("host_posterior") + F.col("total_path") - F.col("p")) / (k_path + F.col("n_path") - 1)
    odds = lambda x: F.log(x / (1 - x))
    inside = lambda x: F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), x))
    df = df.withColumn("host_posterior", inside(host)).withColumn("path_posterior", inside(path))
    z = odds(F.col("p")) + site_weight * (odds(F.col("path_posterior")) - odds(inside(F.lit(mean))))
    df = df.withColumn("quality", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
    return df.select("doc_id", "host", "path", "p", "n_host", "n_path", "host_posterior", "path_posterior", "quality", (F.col("quality") >= keep).alias("kept"))


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, doc_id: Column | None = None, text: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """The posterior of every document. For pages: ``host = F.expr("parse_url(url, 'HOST')")`` and
    ``path = F.expr("parse_url(url, 'PATH')")``."""
    feats = cut(features(docs, F.col("doc_id") if doc_id is None else doc_id, host, path, text))
    model = train(feats, labels, rows)
    return posterior(feats.select("doc_id", "host", "path", model.column().alias("p")))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents have no url: their source is the host, source and language the path."""
    rounded = [F.round(c, 6).alias(c) for c in ("p", "host_posterior", "path_posterior", "quality")]
    df = score(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))
    return df.select("doc_id", "host", "path", "n_host", "n_path", *rounded, "kept")
