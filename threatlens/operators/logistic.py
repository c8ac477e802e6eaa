"""Logistic regression whose coefficients are a table.

For vocabularies that no driver or executor holds as a whole: the documents are
long rows (row, at, x), at being the term's number, and every vector over the
terms is a column of a table (at, ...). The objective is that of
``model.fit_logistic``: mean balanced loss plus |w|^2 / (2 n).

* margins  z = X w: the rows meet the coefficients by term, sums by row;
* gradient X' r: the rows meet the residuals by row, sums by term;
* the L-BFGS direction is a linear combination of the kept steps and gradient
  differences, so it needs only their inner products: one aggregate per step,
  and the two-loop recursion runs on these few numbers (vector-free L-BFGS);
* the line search works on the margins alone (a table of one row per document).

Terms of very many documents are hot join keys: the few terms with more than
1/``HOT_PARTS`` of all entries have their coefficients broadcast, all others go
through a shuffle by term.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import features as FE

HOT_PARTS = 1000            # so at most 1000 hot terms
MEMORY = 5                  # steps that L-BFGS keeps
STEPS = (0.0625, 0.125, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 16.0, 32.0, 64.0, 128.0, 256.0)


@dataclass
class Entries:
    """The training matrix as tables."""
    cold: DataFrame         # row, at, x of all terms but the hot ones
    hot: DataFrame          # row, at, x of the hot terms
    rows: DataFrame         # row, y, c (balanced weight)
    terms: DataFrame        # at, hot
    n: int


def entries(train: DataFrame, vocab: DataFrame, text_col: str, label: str) -> Entries:
    """L2-normalised TF-IDF entries of ``train`` on the terms of ``vocab`` (term, idx, idf, df)."""
    docs = written(train.select(F.col(label).cast("double").alias("y"), F.col(text_col).alias("text"))
                   .withColumn("row", F.monotonically_increasing_id()), "fit-documents")
    classes = docs.groupBy("y").agg(F.count(F.lit(1)).alias("n_c"))
    n, k = classes.agg(F.coalesce(F.sum("n_c"), F.lit(0)), F.count(F.lit(1))).first()
    weights = classes.select(F.col("y").alias("of"), (F.lit(float(n)) / (F.lit(float(k)) * F.col("n_c"))).alias("c"))   # one row per class
    rows = written(docs.select("row", "y").join(weights, F.col("y") == F.col("of")).select("row", "y", "c"), "fit-rows")
    total = vocab.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    terms = written(vocab.select(F.col("idx").cast("long").alias("at"), "term", "idf", (F.col("df") * HOT_PARTS > total).alias("hot")), "fit-terms")
    joined = FE.join_vocab(FE.term_counts(docs, "row", "text"), terms)
    raw = joined.select(F.col("id").alias("row"), "at", "hot", ((F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf")).alias("w"))
    raw = written(raw, "fit-weights")
    norms = raw.groupBy("row").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    x = written(raw.join(norms, "row").select("row", "at", (F.col("w") / F.col("norm")).alias("x"), "hot"), "fit-entries")
    return Entries(x.where("not hot").drop("hot"), x.where("hot").drop("hot"), rows, terms.select("at", "hot"), n)


def margins(e: Entries, coef: DataFrame, name: str) -> DataFrame:
    """(row, ``name``): the entries of each row times ``coef`` (at, w), summed; rows without entries are left out."""
    c = coef.join(F.broadcast(e.terms.where("hot").select("at")), "at", "left_semi")    # at most HOT_PARTS rows
    both = e.cold.join(coef, "at").unionByName(e.hot.join(F.broadcast(c), "at"))
    return both.groupBy("row").agg(F.sum(F.col("x") * F.col("w")).alias(name))


def slopes(e: Entries, residuals: DataFrame) -> DataFrame:
    """(at, g): the entries of each term times the rows' residuals (row, r), summed."""
    both = e.cold.unionByName(e.hot).join(residuals, "row")
    return both.groupBy("at").agg(F.sum(F.col("x") * F.col("r")).alias("g"))


def _sigmoid(z):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _residual(z):
    return F.col("c") * (_sigmoid(z) - F.col("y"))


def _with_gradient(e: Entries, state: DataFrame, residuals: DataFrame) -> DataFrame:
    """``state`` with ``g`` = X' r / n + w / n."""
    s = slopes(e, residuals)
    return state.join(s, "at", "left").withColumn("g", (F.coalesce("g", F.lit(0.0)) + F.col("w")) / F.lit(float(e.n)))


def descend(e: Entries, steps: int, rate: float) -> tuple[DataFrame, float]:
    """``steps`` plain gradient steps of length ``rate`` from zero: ((at, w), intercept)."""
    w, b = e.terms.select("at", F.lit(0.0).alias("w")), 0.0
    for _ in range(steps):
        z = e.rows.join(margins(e, w, "z"), "row", "left").withColumn("r", _residual(F.coalesce("z", F.lit(0.0)) + F.lit(b)))
        r = written(z.select("row", "r"), "fit-residuals")
        w = written(_with_gradient(e, w, r).select("at", (F.col("w") - F.lit(rate) * F.col("g")).alias("w")), "fit-state")
        b -= rate * r.agg(F.coalesce(F.sum("r"), F.lit(0.0))).first()[0] / e.n
    return w, b


def _direction(names: list[str], dot, kept: int) -> dict[str, float]:
    """Coefficients over the basis (s0, y0, ..., g; s0 the newest) of the L-BFGS descent direction."""
    c = {x: 0.0 for x in names}
    c["g"] = -1.0
    along = lambda v: sum(k * dot(x, v) for x, k in c.items() if k)
    alpha = {}
    for i in range(kept):
        alpha[i] = along(f"s{i}") / dot(f"s{i}", f"y{i}")
        c[f"y{i}"] -= alpha[i]
    if kept:
        scale = dot("s0", "y0") / dot("y0", "y0")
        c = {x: k * scale for x, k in c.items()}
    for i in reversed(range(kept)):
        beta = along(f"y{i}") / dot(f"s{i}", f"y{i}")
        c[f"s{i}"] += alpha[i] - beta
    return c


def _sum_of(parts):
    out = F.lit(0.0)
    for x in parts:
        out = out + x
    return out


def minimise(e: Entries, tol: float = 1e-9, max_iter: int = 1000) -> tuple[DataFrame, float, int]:
    """((at, w), intercept, steps taken) at which every partial derivative is at most ``tol``
    (or after ``max_iter`` steps). The intercept is not penalised."""
    lam = 1.0 / e.n
    b, scalar = 0.0, {}                      # the intercept's component of every basis vector
    rows = e.rows.withColumn("z", F.lit(0.0))
    residuals = written(rows.select("row", _residual(F.col("z")).alias("r")), "fit-residuals")
    scalar["g"] = residuals.agg(F.sum("r")).first()[0] * lam
    state = written(_with_gradient(e, e.terms.select("at", F.lit(0.0).alias("w")), residuals), "fit-state")
    kept = 0
    for step in range(max_iter):
        names = [f"{k}{i}" for i in range(kept) for k in "sy"] + ["g"]
        basis = [*names, "w"]
        pairs = [(a, c) for i, a in enumerate(basis) for c in basis[i:]]
        sums = state.agg(F.max(F.abs("g")).alias("largest"), *[F.sum(F.col(a) * F.col(c)).alias(f"{a}_{c}") for a, c in pairs]).first()
        if max(sums["largest"] or 0.0, abs(scalar["g"])) <= tol:
            return state.select("at", "w"), b, step
        own = {(a, c): (sums[f"{a}_{c}"] or 0.0) for a, c in pairs}
        terms_only = lambda a, c: own[(a, c)] if (a, c) in own else own[(c, a)]  # noqa: B023,E731
        dot = lambda a, c: terms_only(a, c) + scalar[a] * scalar[c]  # noqa: B023,E731
        c = _direction(names, dot, kept)
        d = _sum_of(F.lit(k) * F.col(x) for x, k in c.items() if k)
        db = sum(k * scalar[x] for x, k in c.items())
        wd = sum(k * terms_only(x, "w") for x, k in c.items())
        dd = sum(k * m * terms_only(x, v) for x, k in c.items() for v, m in c.items())
        along = margins(e, state.select("at", d.alias("w")), "zd")
        rows = written(rows.select("row", "y", "c", "z").join(along, "row", "left").select(
            "row", "y", "c", "z", (F.coalesce("zd", F.lit(0.0)) + F.lit(db)).alias("zd")), "fit-margins")
        tried = rows.agg(*[F.sum(_residual(F.col("z") + F.lit(t) * F.col("zd")) * F.col("zd")) for t in (0.0, *STEPS)]).first()
        at = [(t, s * lam + lam * (wd + t * dd)) for t, s in zip((0.0, *STEPS), tried)]      # the objective's slope along d
        t = STEPS[-1]
        for (t0, s0), (t1, s1) in zip(at, at[1:]):
            if s0 <= 0 <= s1:
                t = t0 + (t1 - t0) * (s0 / (s0 - s1)) if s0 < s1 else t1
                break
        if not t or at[0][1] >= 0:                                       # rounding: nothing left to gain
            return state.select("at", "w"), b, step
        rows = rows.withColumn("z", F.col("z") + F.lit(t) * F.col("zd"))
        residuals = written(rows.select("row", _residual(F.col("z")).alias("r")), "fit-residuals")
        gb = residuals.agg(F.sum("r")).first()[0] * lam
        older = [F.col(f"{k}{i}").alias(f"{k}{i + 1}") for i in range(min(kept, MEMORY - 1)) for k in "sy"]
        moved = state.select("at", F.col("g").alias("g_old"), (F.col("w") + F.lit(t) * d).alias("w"), (F.lit(t) * d).alias("s0"), *older)
        fresh = _with_gradient(e, moved, residuals).withColumn("y0", F.col("g") - F.col("g_old")).drop("g_old")
        state = written(fresh, "fit-state")
        for i in range(min(kept, MEMORY - 1), 0, -1):
            scalar[f"s{i}"], scalar[f"y{i}"] = scalar[f"s{i - 1}"], scalar[f"y{i - 1}"]
        scalar["s0"], scalar["y0"], scalar["g"] = t * db, gb - scalar["g"], gb
        b += t * db
        kept = min(kept + 1, MEMORY)
    return state.select("at", "w"), b, max_iter


def gradient(e: Entries, coef: DataFrame, intercept: float) -> DataFrame:
    """One row (terms, gradient): the number of terms that occur and the largest absolute partial
    derivative, the intercept's included, at ``coef`` (at, w)."""
    z = e.rows.join(margins(e, coef, "z"), "row", "left").withColumn("r", _residual(F.coalesce("z", F.lit(0.0)) + F.lit(float(intercept))))
    r = written(z.select("row", "r"), "fit-residuals")
    gb = (r.agg(F.sum("r")).first()[0] or 0.0) / e.n
    seen = slopes(e, r).join(coef, "at").select(((F.col("g") + F.col("w")) / F.lit(float(e.n))).alias("g"))
    return seen.agg(F.count(F.lit(1)).alias("terms"), F.greatest(F.max(F.abs("g")), F.lit(abs(gb))).alias("gradient"))
