"""Embedding near-dedup: exact cosine links within a label by PCA-ordered, tiled comparison.

Unit vectors are turned into the axes of their second moment, largest first, which changes no cosine. Vectors are laid
out along the first axis in cells as wide as the largest distance of a link, so only neighbouring cells can hold one.
Cells are cut into blocks and each pair of blocks is one tile. Inside a tile the leading dimensions are multiplied
first, the rest is bounded by the product of the suffix norms, and only pairs that can still reach the threshold get
the next dimensions; what is left is decided by the cosine of the original vectors in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm._shared import connected_components, written

COSINE, TILE, SLACK = 0.98, 2000, 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _moments(batches):
    """Sums of outer products of unit vectors, by number of dimensions."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for dim in np.unique(b.column(1).to_numpy()):
            x = _matrix(b.filter(pa.compute.equal(b.column(1), int(dim))).column(0))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            sums[int(dim)] = sums.get(int(dim), 0) + x.T @ x
    for dim, m in sums.items():
        n = dim * dim
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(m.ravel())], names=["dim", "cell", "v"])


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Axes by falling second moment for each dimension count; only dim * dim sums reach the driver."""
    rows = vectors.select("embedding", "dim").mapInArrow(_moments, "dim int, cell int, v double").groupBy("dim", "cell").agg(F.sum("v").alias("v")).toPandas()
    axes = {}
    for dim, own in rows.groupby("dim"):
        m = own.sort_values("cell").v.to_numpy().reshape(dim, dim)
        axes[int(dim)] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()
    return axes


def _first_axis(axes: dict[int, np.ndarray], width: float):
    """The cell of each vector along the first axis."""

    def run(batches):
        for b in batches:
            dims, cell = b.column(b.schema.get_field_index("dim")).to_numpy(), np.zeros(b.num_rows, np.int32)
            for dim in np.unique(dims):
                own = dims == dim
                x = _matrix(b.column(b.schema.get_field_index("embedding")).filter(pa.array(own)))
                cell[own] = np.floor(x @ axes[int(dim)][:, 0] / np.linalg.norm(x, axis=1) / width)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])

    return run


def linked_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) with cosine(x[i], y[j]) >= cosine."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    u, v = (x / nx[:, None]) @ axes, (y / ny[:, None]) @ axes
    dim, done = x.shape[1], max(1, x.shape[1] // 4)
    tail = lambda z, k: np.sqrt(np.maximum(0, 1 - np.square(z[:, :k]).sum(1)))
    part = u[:, :done] @ v[:, :done].T
    i, j = np.nonzero(part + np.outer(tail(u, done), tail(v, done)) >= cosine - SLACK)
    part = part[i, j]
    while done < dim and len(i):
        k = min(dim, done * 2)
        part = part + np.einsum("ij,ij->i", u[i, done:k], v[j, done:k])
        alive = part + tail(u, k)[i] * tail(v, k)[j] >= cosine - SLACK
        i, j, part, done = i[alive], j[alive], part[alive], k
    exact = np.einsum("ij,ij->i", x[i], y[j]) / (nx[i] * ny[j]) >= cosine
    return i[exact], j[exact]


def _tile(axes: dict[int, np.ndarray], cosine: float):
    """For each vector of a tile its number of links (copies of the other side count), and links that span them."""

    def run(table: pa.Table) -> pa.Table:
        rep, n, left = table.column("rep").to_numpy(), table.column("copies").to_numpy(), table.column("side").to_numpy() == 0
        x, inside = _matrix(table.column("embedding")), bool(left.all())
        a = np.flatnonzero(left)
        b = a if inside else np.flatnonzero(~left)
        links, up, ids, others = np.zeros(len(rep), np.int64), np.arange(len(rep)), [], []

        def top(k):
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        for s in range(0, len(a), 512):
            i, j = linked_pairs(x[a[s : s + 512]], x[b], axes[x.shape[1]], cosine)
            i, j = a[i + s], b[j]
            if inside:
                i, j = i[i < j], j[i < j]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                if (r := top(p)) != (t := top(q)):
                    up[t] = r
                    ids.append(rep[p])
                    others.append(rep[q])
        has = links > 0
        return pa.table({"rep": pa.array(np.append(rep[has], ids).astype(np.int64)), "links": pa.array(np.append(links[has], np.zeros(len(ids))).astype(np.int64)), "other": pa.array([None] * int(has.sum()) + others, pa.int64())})

    return run


def dedup_embeddings(vectors: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """Links of vectors (vec_id long, embedding array<float or double>, label) with equal non-null label and cosine >= `cosine`.

    Returns vec_id, n_links (other rows linked directly), component_id (smallest id reachable), kept (vec_id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite parts, and vectors without a label or id, link with nothing.
    Vectors of unlike length never link. Copies are compared once and counted. Repeated ids count as copies. Other columns are
    ignored; an empty table gives no rows.
    """
    e = F.col("embedding").cast("array<double>")
    sound = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    known = vectors.select("vec_id", "label", F.transform(e, lambda v: v + F.lit(0.0)).alias("embedding"), F.coalesce(sound, F.lit(False)).alias("sound"))
    known = known.withColumn("h1", F.xxhash64("label", "embedding")).withColumn("h2", F.xxhash64(F.lit(7), "embedding", "label"))
    distinct = known.where("sound").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.max("embedding").alias("embedding"))
    distinct = written(distinct.withColumn("dim", F.size("embedding")), "vectors")
    axes, width = principal_axes(distinct), math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
    kind = dict(distinct.dtypes)["label"]
    placed = distinct.select("label", "dim", "rep", "copies", "embedding").mapInArrow(_first_axis(axes, width), f"label {kind}, dim int, rep long, copies long, embedding array<double>, cell int")
    counts = written(placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks")), "cells")
    near = counts.select("label", "dim", F.col("cell").alias("other"), F.col("blocks").alias("other_blocks"))
    # a vector stands left in tiles with its own cell and the next one, right in tiles with the one before
    row = placed.join(counts, ["label", "dim", "cell"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    row = row.join(near, ["label", "dim", "other"]).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
    first = (F.col("cell") < F.col("other")) | ((F.col("cell") == F.col("other")) & (F.col("own") <= F.col("b")))
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    dealt = row.select("label", "dim", "rep", "copies", "embedding", F.when(first, 0).otherwise(1).alias("side"), pick("cell", "other").alias("c1"), pick("own", "b").alias("b1"), pick("other", "cell").alias("c2"), pick("b", "own").alias("b2"))
    found = written(dealt.groupBy("label", "dim", "c1", "b1", "c2", "b2").applyInArrow(_tile(axes, cosine), "rep long, links long, other long"), "links")

    classes = distinct.select("label", "h1", "h2", "rep", "copies")
    classes = classes.join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
    classes = classes.join(connected_components(found.where("other is not null"), "rep", "other").withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), F.lit(True).alias("sound"))
    out = known.drop("embedding").join(classes, ["label", "h1", "h2", "sound"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
