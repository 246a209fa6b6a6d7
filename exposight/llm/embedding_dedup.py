"""Near-duplicate vectors: int8 tile products with error bounds, then full precision where a bound leaves it open.

Vectors with equal label, length and components are collapsed first. Those of one (label, length) are dealt into
parts of about ``TILE`` rows, and a task gets one pair of parts at a time. Each unit vector x is rounded to
s * q with int8 q; its rounding error e = |x - s q| is computed, not estimated. For two vectors

    |x . y - s_x s_y (q_x . q_y)|  <=  e_x + (1 + e_x) e_y        (Cauchy-Schwarz)

so a pair whose product plus this bound is below the threshold cannot be a link and is not looked at again; all
others get their cosine in double precision. A tile returns link counts per vector and a spanning forest of its
links, never the links themselves. The products of one label grow with the square of its distinct vectors; nothing
in a task does.

Defined cases: a null label, a vector that is null, empty or zero, or one with null or non-finite components links
with nothing and is its own component; vectors of different lengths do not link; equal vectors link; a null id takes
part as an id of its own value null; repeated rows get one row each and count as others; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposight.llm.components import components
from exposight.llm.simhash import Forest
from exposight.session import materialise

TILE = 1024
EXACT_DIMS = 1024  # sums of this many int8 products are exact in single precision
SLACK = 1e-9  # above any rounding of the double arithmetic here
LINKS = "node string, links bigint, other string"


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of unit vectors → int8 rows, scales, and the length of what rounding left out."""
    scale = np.abs(unit).max(axis=1) / 127
    rounded = np.rint(unit / scale[:, None]).astype(np.int8)
    return rounded, scale, np.linalg.norm(unit - rounded * scale[:, None], axis=1)


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows; single-precision multiplication is exact on runs of EXACT_DIMS."""
    total = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], EXACT_DIMS):
        total += a[:, k : k + EXACT_DIMS].astype(np.float32) @ b[:, k : k + EXACT_DIMS].astype(np.float32).T
    return total


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, rows_at_once: int = 256):
    """Index pairs of rows of ``a`` and ``b`` with a cosine of at least ``threshold``, a slice of ``a`` at a time."""
    norm_a, norm_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    qa, sa, ea = quantised(a / norm_a[:, None])
    qb, sb, eb = quantised(b / norm_b[:, None])
    for k in range(0, len(a), rows_at_once):
        part = slice(k, k + rows_at_once)
        about = int8_products(qa[part], qb) * sa[part, None] * sb
        bound = ea[part, None] + (1 + ea[part, None]) * eb + SLACK
        i, j = np.nonzero(about + bound >= threshold)
        i += k
        keep = np.zeros(len(i), dtype=bool)
        for m in range(0, len(i), 65536):
            x, y = i[m : m + 65536], j[m : m + 65536]
            keep[m : m + 65536] = np.einsum("nd,nd->n", a[x], b[y]) / (norm_a[x] * norm_b[y]) >= threshold
        yield i[keep], j[keep]


def _tile(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        pdf = pdf.sort_values("vec_id")
        left, right = pdf[pdf["part"] == i], pdf[pdf["part"] == j]
        a, b = (np.array([np.asarray(v, dtype=float) for v in p["embedding"]]).reshape(len(p), -1) for p in (left, right))
        if not len(a) or not len(b):
            return pd.DataFrame({"node": [], "links": [], "other": []})
        ids = np.concatenate([left["vec_id"].to_numpy(), right["vec_id"].to_numpy()])
        copies_a, copies_b = left["copies"].to_numpy(), right["copies"].to_numpy()
        counts, forest = np.zeros(len(ids), dtype=np.int64), Forest(len(ids))
        for x, y in tile_links(a, b, threshold):
            if i == j:
                x, y = x[x != y], y[x != y]
            np.add.at(counts, x, copies_b[y])
            if i != j:
                np.add.at(counts, len(a) + y, copies_a[x])
            forest.join(x, y if i == j else len(a) + y)
        has = np.flatnonzero(counts)
        return pd.DataFrame({"node": ids[has], "links": counts[has], "other": ids[forest.root[has]]})

    return run


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label", tile: int = TILE,
) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``."""
    rows = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding")
    )
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & finite & nonzero, F.lit(False))
    good = rows.where(usable)
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    # A class is a node under a name of its own: ids may be null or shared.
    node = F.md5(F.to_json(F.struct("label", "embedding")))
    classes = materialise(classes.withColumn("node", node), "vector-classes")

    group = ["label", "length"]
    sized = classes.withColumn("length", F.size("embedding"))
    parts = sized.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / tile).alias("parts"))
    dealt = sized.join(parts, group).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    pair = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    cells = dealt.select(
        *group, F.col("node").alias("vec_id"), "copies", "embedding", "part", pair.alias("with")
    ).select("*", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"))
    found = cells.groupBy(*group, "i", "j").applyInPandas(_tile(threshold), LINKS)
    found = materialise(found, "vector-links")

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    groups = groups.withColumnRenamed("component", "group")
    known = classes.join(counts, "node", "left").join(groups, "node", "left")
    known = known.withColumn("group", F.coalesce("group", "node"))
    known = materialise(known.select("label", "embedding", "first", "copies", "links", "group"), "vector-groups")
    least = materialise(known.groupBy("group").agg(F.min("first").alias("component_id")), "vector-least")
    own = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    known = materialise(
        known.join(least, "group").select("label", "embedding", own.alias("n_links"), "component_id"), "vector-known"
    )
    linked = good.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
