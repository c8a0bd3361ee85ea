"""Soft-membership mixing: domain posteriors from a labelled table, document rates from projected gradient steps.

A multinomial naive Bayes over hashed words, fitted on labelled documents, gives every document a posterior over the
domains. With n tokens and posterior p, a document at rate r adds r * n * p[d] expected tokens to domain d. Rates solve

    least squares in A r = t  (t: target tokens of each domain),  r >= 0,  nearest to 1 (weighted by tokens)

by accelerated projected gradient descent from r = 1: each step moves every rate against the gradient, p . (A r - t) for
a weight of n a document, and cuts it at 0. Every step is one aggregate over the table of posteriors and rates; the
driver sees one row of sums over domains.

Thinning (``thin``) can only drop documents, so there rates are probabilities: 0 <= r <= 1 is part of the problem, and
the projection cuts at 1 as well. Targets that no such rates meet are met as nearly as they allow, in tokens.

Scale. DataFrame functions only. The classifier is fitted on at most ``sample`` labelled rows (those with the smallest
hashes; broadcast under that bound); its table has a fixed number of buckets. Posteriors are computed within each row
and written once as (doc_id, n_tokens, p); steps read that narrow table and shuffle one row for each task.

Domains are ``low`` (quality 0), ``toxic`` (quality 1, toxic 1) and ``clean`` (quality 1, not toxic); rows without a
quality label are not used. Nulls and empty texts have no tokens, the prior as posterior, and a rate like others.
Several labels of one id count as one, with the least quality and the most toxic; which rows are taken where hashes tie
is decided by doc_id. A domain without labelled rows gets an add-one prior. An empty table gives an empty result.
Repeated rows are rated alike, and ``mixture`` keeps or drops all rows of an id together; rows without an id are rated
and stay. Extra columns are ignored by ``mixing_rates`` and kept by ``mixture``, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stage, stage, table, without
from .native import filled, hashes_of, let, words_of

DOMAINS = ("low", "toxic", "clean")


def _domain() -> Column:
    return F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2)


def classifier(docs: DataFrame, labels: DataFrame, buckets: int, sample: int) -> DataFrame:
    """One row: ``prior`` (log, by domain) and ``weights`` (log probability by domain * buckets + bucket)."""
    n = len(DOMAINS)
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", _domain().alias("domain"))
    known = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")  # at most ``sample`` rows
    cells = known.select(F.explode(F.transform(hashes_of(words_of(F.col("text"))), lambda h: F.pmod(h, F.lit(buckets)).cast("int") + F.col("domain") * buckets)).alias("bucket"))
    counts = cells.groupBy("bucket").agg(F.count("*").alias("c"))
    whole = filled(counts, n * buckets, F.coalesce("c", F.lit(0)).cast("double") + 1, "c")
    parts = [F.slice("c", d * buckets + 1, buckets) for d in range(n)]
    logs = [let(x, lambda a: let(F.aggregate(a, F.lit(0.0), lambda s, v: s + v), lambda t: F.transform(a, lambda v: F.ln(v / t)))) for x in parts]
    prior = marked.agg(F.array(*[F.ln((F.count(F.when(F.col("domain") == d, 1)) + 1.0) / (F.count("*") + n)) for d in range(n)]).alias("prior"))
    fitted = whole.select(F.concat(*logs).alias("weights")).withColumn("prior", prior.scalar())
    return stage(fitted, "classifier")


def posteriors(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 15, sample: int = 20_000, sharpness: float = 12.0) -> DataFrame:
    """doc_id, n_tokens, low, toxic, clean. Mean log-likelihoods by word are scaled by at most ``sharpness`` words:
    words of a text are not independent, and the sum over a long text would leave no soft membership."""
    n = len(DOMAINS)
    fitted = classifier(docs, labels, buckets, sample)

    def member(hashes: Column) -> Column:
        places = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
        zero = F.struct(*[F.lit(0.0).alias(d) for d in DOMAINS])
        add = lambda acc, b: F.struct(*[(acc[d] + F.get(F.col("_weights"), b + i * buckets)).alias(d) for i, d in enumerate(DOMAINS)])
        scale = F.least(F.size(hashes), F.lit(sharpness)) / F.greatest(F.size(hashes), F.lit(1))
        sums = F.aggregate(places, zero, add)
        logits = let(sums, lambda s: F.array(*[s[d] * scale + F.get(F.col("_prior"), F.lit(i)) for i, d in enumerate(DOMAINS)]))
        powers = let(logits, lambda x: F.transform(x, lambda v: F.exp(v - F.array_max(x))))
        total = lambda p: F.get(p, F.lit(0)) + F.get(p, F.lit(1)) + F.get(p, F.lit(2))
        return let(powers, lambda p: F.struct(F.size(hashes).cast("long").alias("n_tokens"), *[(F.get(p, F.lit(i)) / total(p)).alias(d) for i, d in enumerate(DOMAINS)]))

    assert n == 3
    x = docs.select("doc_id", "text", fitted.select("weights").scalar().alias("_weights"), fitted.select("prior").scalar().alias("_prior"))
    x = x.select("doc_id", let(hashes_of(words_of(F.col("text"))), member).alias("x")).select("doc_id", "x.*")
    return stage(x, "posteriors")


#: Steps of a fold; after so many the rates are written as a table.
FOLD = 10


class _Descent:
    """Accelerated projected gradient on the column of rates.

    A step is one aggregate: sums of n * p * r over domains, and whether momentum still points downhill (if not, it
    starts anew). Rates are kept as a table of (rate, look-ahead), and the steps since then as a fold over literals.
    """

    def __init__(self, members: DataFrame, targets: np.ndarray, metric: np.ndarray, most: float | None):
        self.table, self.targets, self.metric, self.most = members.withColumn("_r", F.lit(1.0)).withColumn("_y", F.lit(1.0)), targets, metric, most
        self.folded: list[tuple[np.ndarray, float]] = []
        self.inertia, self.mass = 1.0, None

    def _moved(self, at: Column, step) -> Column:
        moved = F.greatest(F.lit(0.0), at - sum(F.col(d) * step(i) for i, d in enumerate(DOMAINS)))
        return moved if self.most is None else F.least(F.lit(self.most), moved)

    def _state(self) -> DataFrame:
        """The table with all steps so far applied to ``_r`` and ``_y``."""
        if not self.folded:
            return self.table
        steps = F.array(*[F.array(*[F.lit(float(v)) for v in [*step, beta]]) for step, beta in self.folded])

        def applied(acc: Column, s: Column) -> Column:
            new = self._moved(acc["y"], lambda i: F.get(s, F.lit(i)))
            return let(new, lambda r: F.struct(r.alias("r"), (r + F.get(s, F.lit(len(DOMAINS))) * (r - acc["r"])).alias("y")))

        state = F.aggregate(steps, F.struct(F.col("_r").alias("r"), F.col("_y").alias("y")), applied)
        return self.table.withColumn("_s", state).withColumn("_r", F.col("_s.r")).withColumn("_y", F.col("_s.y")).drop("_s")

    def run(self, mass: np.ndarray, total: float, steps: int, tolerance: float, stall: float) -> DataFrame:
        """Rates after at most ``steps`` steps: fewer where totals are met within ``tolerance`` * total, or where the last
        steps brought them nearer by at most ``stall`` * total."""
        ahead, self.mass = mass, mass
        errors = [np.linalg.norm(mass - self.targets)]
        for k in range(steps):
            if errors[-1] <= tolerance * total or (k > FOLD and errors[-1 - FOLD] - errors[-1] <= stall * total):
                break
            step = self.metric @ (ahead - self.targets)
            now = F.array(*[F.lit(float(v)) for v in step])  # as data, not code: every step has the same plan
            x = self._state().withColumn("_new", let(now, lambda s: self._moved(F.col("_y"), lambda i: F.get(s, F.lit(i)))))
            sums = [F.sum(F.col("n_tokens") * F.col(d) * F.col("_new")).alias(f"_{d}") for d in DOMAINS]
            row = x.agg(*sums, F.sum(F.col("n_tokens") * (F.col("_y") - F.col("_new")) * (F.col("_new") - F.col("_r"))).alias("_uphill")).first()
            new = np.array(row[: len(DOMAINS)], float)
            if row["_uphill"] > 0:
                self.inertia = 1.0
            later = (1 + np.sqrt(1 + 4 * self.inertia**2)) / 2
            beta = (self.inertia - 1) / later
            ahead, self.mass, self.inertia = new + beta * (new - self.mass), new, later
            self.folded.append((step, beta))
            errors.append(np.linalg.norm(new - self.targets))
            if len(self.folded) == FOLD:
                before, self.table, self.folded = self.table, stage(self._state(), "rates"), []
                if k >= FOLD:
                    drop_stage(before)
        return self._state().drop("_y").withColumnRenamed("_r", "rate")


def fit_rates(members: DataFrame, weights: dict[str, float], thin: str | None = None, steps: int = 300, tolerance: float = 1e-6) -> tuple[DataFrame, np.ndarray]:
    """(``members`` with ``rate``, targets). The targets share out all tokens by ``weights``.

    With ``thin``, the name of a domain, that domain is to keep its expected tokens and the others to come down to their
    share relative to it; none goes up, and rates are at most 1. Every document has a little of every domain, so such
    targets can be out of reach: then the totals come as near as rates of at most 1 allow.
    """
    w = np.array([weights[d] for d in DOMAINS], float)
    pairs = [(i, j) for i in range(len(DOMAINS)) for j in range(i, len(DOMAINS))]
    own = [F.coalesce(F.sum(F.col("n_tokens") * F.col(d)), F.lit(0.0)) for d in DOMAINS]
    gram = [F.coalesce(F.sum(F.col("n_tokens") * F.col(DOMAINS[i]) * F.col(DOMAINS[j])), F.lit(0.0)) for i, j in pairs]
    row = members.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("_n"), *[c.alias(f"_{k}") for k, c in enumerate([*own, *gram])]).first()
    total, mass = float(row[0]), np.array(row[1 : 1 + len(DOMAINS)], float)
    targets = total * w / w.sum() if thin is None else np.minimum(mass, mass[DOMAINS.index(thin)] * w / w[DOMAINS.index(thin)])
    if not total:
        return members.withColumn("rate", F.lit(1.0)), targets
    g = np.zeros((len(DOMAINS), len(DOMAINS)))
    for (i, j), v in zip(pairs, row[1 + len(DOMAINS) :], strict=True):
        g[i, j] = g[j, i] = v
    # A step of 1 / the largest eigenvalue descends whatever the bounds. Targets that can be met are the same minimum in
    # every metric, so there the inverse of the Gram matrix makes the steps even in all domains.
    metric = np.eye(len(DOMAINS)) / np.linalg.eigvalsh(g)[-1] if thin is not None else np.linalg.inv(g + 1e-9 * np.trace(g) * np.eye(len(DOMAINS)))
    return _Descent(members, targets, metric, None if thin is None else 1.0).run(mass, total, steps, tolerance, tolerance if thin is None else 3 * tolerance), targets


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], thin: str | None = None, buckets: int = 1 << 15, sample: int = 20_000) -> DataFrame:
    """doc_id, n_tokens, low, toxic, clean (posteriors), rate (expected copies of the document; with ``thin`` at most 1)."""
    return fit_rates(posteriors(docs, labels, buckets, sample), weights, thin)[0]


def mixture(docs: DataFrame, labels: DataFrame, weights: dict[str, float], thin: str = "clean") -> DataFrame:
    """Rows of ``docs``, each kept with its rate as probability, decided by a hash of its doc_id.

    Rates are fitted between 0 and 1, so what is kept has the fitted totals in expectation. Documents that are mostly of
    the ``thin`` domain have rates of 1 and stay; what they hold of other domains stays with them.
    """
    rates = mixing_rates(docs, labels, weights, thin)
    draw = F.pmod(F.xxhash64(F.lit("mixture"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    gone = stage(rates.where(F.col("rate") <= draw).select("doc_id").distinct(), "gone")
    return without(docs, "doc_id", gone)


#: Token shares that the registered query and the pipeline aim at.
WEIGHTS = {"low": 0.02, "toxic": 0.03, "clean": 0.95}


def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), WEIGHTS)
