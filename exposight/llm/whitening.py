"""Whitening of quantised embeddings: a weighted multiplicity covariance over distinct vectors.

Each component c of a vector becomes the integer x = floor(SCALE * c). Rows with equal x vectors are grouped first
(with partial counts before the shuffle, so a vector held by a third of all rows costs one row per task), and the
fit runs over the distinct vectors: each has fit weight one, or its number of rows with ``weights="copies"``. Two
passes over the grouped table give the weighted sums S and then the weighted centred Gram matrix
sum w (x - S/W)(x - S/W)^T, one numpy GEMM per Arrow batch, added up by Spark per matrix entry; only d x d numbers
reach the driver, which takes the eigenvectors. Each distinct vector is whitened once, by JVM expressions, and
joined back to its rows (a vector of many rows is split by the optimizer's skew handling).

Defined cases: a row whose vector is null, empty, or holds a null or non-finite entry is dropped; a null id is an id
of its own value null; repeated rows each get their rows; extra columns are not read; an empty table, or one whose
covariance is zero, gives no rows (no direction can be whitened); components with an eigenvalue not above
``EIGEN_FLOOR`` times the largest are not returned, as they cannot be scaled to unit variance. All vectors that
remain must have one length; more than one length is an error, as no covariance spans them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposight.session import materialise

SCALE = 256
EIGEN_FLOOR = 1e-12


@dataclass(frozen=True)
class Fit:
    n: int  # distinct vectors
    weight: float  # sum of fit weights
    sums: list[int]  # per dimension, over distinct vectors, weight one each
    mean: np.ndarray  # weighted
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # columns are unit eigenvectors, same order
    trace: float


def valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x`` for each valid row: x[j] = floor(SCALE * double(c[j])) + 0."""
    picked = rows.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"))
    x = F.transform("v", lambda c: F.floor(c.cast("double") * SCALE).cast("bigint") + F.lit(0))
    return picked.where(valid(F.col("v"))).select("vec_id", x.alias("x"))


def distinct_vectors(x_rows: DataFrame) -> DataFrame:
    """``x, copies``: one row per distinct x vector (partial counts before the shuffle)."""
    return x_rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))


def _gram(mean: np.ndarray, weights: str):
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(mean)
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            values = batch.column(0).values.to_numpy(zero_copy_only=False).astype(np.float64)
            centred = values.reshape(batch.num_rows, d) - mean
            w = batch.column(1).to_numpy().astype(np.float64) if weights == "copies" else np.ones(batch.num_rows)
            total += (centred * w[:, None]).T @ centred
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["gram"])

    return per_batch


def fit(vectors: DataFrame, weights: str = "one") -> Fit | None:
    """Eigen decomposition of the covariance of the distinct ``x`` vectors (divisor: the total fit weight)."""
    w = F.col("copies") if weights == "copies" else F.lit(1)
    lengths = vectors.agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("weight"), F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi")
    ).first()
    if not lengths["n"]:
        return None
    if lengths["lo"] != lengths["hi"]:
        raise ValueError(f"vectors of lengths {lengths['lo']} to {lengths['hi']}: a covariance needs one length")
    d, n, total = lengths["lo"], lengths["n"], float(lengths["weight"])
    per_dim = vectors.select(F.posexplode("x").alias("j", "c"), w.alias("w"))
    sums = per_dim.groupBy("j").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("w")).alias("ws")).collect()
    plain, weighted = [0] * d, np.zeros(d)
    for r in sums:
        plain[r["j"]], weighted[r["j"]] = int(r["s"]), float(r["ws"])
    mean = weighted / total
    partial = vectors.select("x", "copies").mapInArrow(_gram(mean, weights), "gram array<double>")
    entries = partial.select(F.posexplode("gram").alias("k", "g")).groupBy("k").agg(F.sum("g").alias("g")).collect()
    gram = np.zeros(d * d)
    for r in entries:
        gram[r["k"]] = r["g"]
    covariance = gram.reshape(d, d) / total
    covariance = (covariance + covariance.T) / 2
    values, vecs = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")
    values, vecs = values[order], vecs[:, order]
    # One sign for all rows: the entry of largest magnitude is positive.
    signs = np.sign(vecs[np.abs(vecs).argmax(axis=0), np.arange(d)])
    vecs = vecs * np.where(signs == 0, 1, signs)
    return Fit(n, total, plain, mean, values, vecs, float(np.trace(covariance)))


def _dot(x: Column, mean: np.ndarray, coefficients: np.ndarray) -> Column:
    centred = F.zip_with(x, F.array(*[F.lit(float(m)) for m in mean]), lambda a, m: a.cast("double") - m)
    scaled = F.zip_with(centred, F.array(*[F.lit(float(c)) for c in coefficients]), lambda a, c: a * c)
    return F.aggregate(scaled, F.lit(0.0), lambda acc, v: acc + v)


def _deviation(x: Column, n: int, sums: list[int]) -> Column:
    big = "decimal(38,0)"
    apart = F.zip_with(x, F.array(*[F.lit(s).cast(big) for s in sums]), lambda a, s: F.lit(n).cast(big) * a.cast(big) - s)
    squares = F.transform(apart, lambda t: (t * t).cast(big))
    return F.aggregate(squares, F.lit(0).cast(big), lambda acc, v: (acc + v).cast(big)).cast("bigint")


def whiten(
    rows: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", weights: str = "one"
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per valid row and component.

    ``n``: distinct x vectors; ``deviation``: sum over dimensions of (n x - S)^2, exact (an error if it does not fit a
    long); ``whitened``: (x - mean) projected on the component over sqrt(eigenvalue); ``explained``: eigenvalue over
    the trace; ``identity_error``: the largest absolute entry of the covariance of the whitened values over the fit
    list minus the identity.
    """
    x_rows = quantised(rows, id_col, vector_col)
    vectors = materialise(distinct_vectors(x_rows), "whiten-distinct")
    found = fit(vectors, weights)
    spark = rows.sparkSession
    schema = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    if found is None or found.values[0] <= 0:
        return spark.createDataFrame([], schema)
    keep = [k for k in range(min(components, len(found.values))) if found.values[k] > EIGEN_FLOOR * found.values[0]]
    coefficient = [found.vectors[:, k] / np.sqrt(found.values[k]) for k in keep]
    projected = vectors.select(
        "x", "copies", _deviation(F.col("x"), found.n, found.sums).alias("deviation"),
        *[_dot(F.col("x"), found.mean, c).alias(f"w{k}") for k, c in zip(keep, coefficient)],
    )
    projected = materialise(projected, "whiten-projected")
    error = identity_error(projected, [f"w{k}" for k in keep], weights)
    per_component = F.explode(
        F.array(*[
            F.struct(F.lit(k + 1).alias("component"), F.col(f"w{k}").alias("whitened"),
                     F.lit(float(found.values[k] / found.trace)).alias("explained"))
            for k in keep
        ])
    )
    joined = x_rows.join(projected.drop("copies"), "x")
    return joined.select(
        "vec_id", per_component.alias("c"), F.lit(found.n).cast("bigint").alias("n"), "deviation"
    ).select(
        "vec_id", F.col("c.component").cast("int").alias("component"), "n", "deviation", "c.whitened", "c.explained",
        F.lit(error).alias("identity_error"),
    )


def identity_error(projected: DataFrame, names: list[str], weights: str = "one") -> float:
    """Largest |cov(w_k, w_l) - [k == l]| over the fit list, centred first."""
    w = F.col("copies") if weights == "copies" else F.lit(1)
    sums = projected.agg(
        F.sum(w).alias("W"), *[F.sum(w * F.col(a)).alias(f"s_{a}") for a in names],
        *[F.sum(w * F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(names) for b in names[i:]],
    ).first()
    total = float(sums["W"])
    worst = 0.0
    for i, a in enumerate(names):
        for b in names[i:]:
            cov = sums[f"p_{a}_{b}"] / total - (sums[f"s_{a}"] / total) * (sums[f"s_{b}"] / total)
            worst = max(worst, abs(cov - (1.0 if a == b else 0.0)))
    return worst
