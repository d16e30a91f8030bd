"""Near-duplicate vectors: all pairs by tiles in PCA order, with suffix norms that end a comparison early."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docweave.llm.common import components, numbered
from docweave.session import stored

# Dimensions after which pairs that cannot reach the threshold are dropped, before the whole of them.
STAGES = (16, 32)
LEAD = 8
# Slack of the bounds for rounding: pairs within it are decided by their exact cosine.
SLACK = 1e-4
CHUNK = 100_000


def _numbers(values: list) -> np.ndarray | None:
    """A vector as doubles; None if it is null, empty, zero, or holds a null or a value that is not finite."""
    if not values or any(v is None for v in values):
        return None
    vector = np.array(values, np.float64)
    return vector if np.isfinite(vector).all() and vector.any() else None


def unit(rows: list[bytes], width: int) -> np.ndarray:
    """Unit vectors of stored doubles, padded with zeros to ``width``. Scaled first, so nothing overflows."""
    out = np.zeros((len(rows), width))
    for k, row in enumerate(rows):
        vector = np.frombuffer(row, np.float64)
        out[k, : len(vector)] = vector / np.abs(vector).max()
    return out / np.linalg.norm(out, axis=1, keepdims=True) if len(rows) else out


def principal_axes(classes: DataFrame, width: int) -> np.ndarray:
    """Axes by falling variance about the origin, from the second moments of all vectors.

    Each partition sends the cells of one matrix, summed by Spark; the driver sees width squared numbers.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = unit(batch.column(0).to_pylist(), width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["cell", "value"])

    summed = classes.select("vector").mapInArrow(moments, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    matrix = np.zeros(width * width)
    for cell, value in summed.collect():
        matrix[cell] = value
    return np.linalg.eigh(matrix.reshape(width, width))[1][:, ::-1].copy()


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n by the links (a, b)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            return label


def linked(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``x`` and ``y`` (rotated unit vectors) whose cosine may reach the threshold.

    After the leading dimensions the rest of a product is at most the product of the suffix norms.
    That bound is itself a product with one more coordinate, so a block of rows takes one matrix
    product; later stages go on with the pairs left only. ``same``: pairs within x, once each.
    """
    width, found = x.shape[1], []
    stages = [s for s in STAGES if s < width]
    first = stages[0] if stages else width

    def ahead(m: np.ndarray, upto: int) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 1.0 - (m[:, :upto] ** 2).sum(1)))

    left = np.column_stack([x[:, :first], ahead(x, first)]).astype(np.float32)
    right = np.column_stack([y[:, :first], ahead(y, first)]).astype(np.float32)
    rest = {s: (ahead(x, s), ahead(y, s)) for s in stages[1:]}
    for at in range(0, len(x), 512):
        i, j = np.nonzero(left[at : at + 512] @ right.T >= threshold - SLACK)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for cut in range(0, len(i), CHUNK):
            a, b = i[cut : cut + CHUNK], j[cut : cut + CHUNK]
            product, done = np.einsum("ij,ij->i", x[a, :first], y[b, :first]), first
            for s in [*stages[1:], width]:
                product = product + np.einsum("ij,ij->i", x[a, done:s], y[b, done:s])
                done = s
                more = rest[s][0][a] * rest[s][1][b] if s in rest else 0.0
                good = product + more >= threshold - SLACK
                a, b, product = a[good], b[good], product[good]
            found.append((a, b))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def near_vectors(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", column: str = "embedding", tile: int = 4096) -> DataFrame:
    """One row per vector: key, n_links, component_id and kept, for links of cosine ``threshold`` or more.

    Cosines are taken in double precision. Vectors that are null, empty, zero, or hold a null or a
    value that is not finite link with nothing, nor do vectors of different length. Equal vectors are
    one class with a count, so a vector that is repeated very often costs no more than one.
    Classes are put in order of their first principal coordinate and cut into tiles of ``tile``
    rows; pairs of tiles whose boxes of leading coordinates lie too far apart are left out, and
    every other pair is one bounded group. A group returns for each vector its number of links
    and one edge to the smallest vector it reaches there, never all pairs. Rows that repeat a key
    count as vectors of their own; ``component_id`` is the smallest key reached.
    """

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_numbers(v) for v in batch.column(1).to_pylist()]
            values = [None if v is None else v.tobytes() for v in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], names=[key, "vector"])

    narrow = vectors.select(F.col(key).cast("long").alias(key), column)
    rows = stored(narrow.mapInArrow(plain, StructType.fromDDL(f"`{key}` long, vector binary")))
    classes = rows.where(F.col("vector").isNotNull()).groupBy("vector").agg(F.min(key).alias("least"), F.count("*").alias("weight"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    width = (classes.agg(F.max(F.length("vector"))).first()[0] or 8) // 8
    axes = principal_axes(classes, width)
    lead, reach = min(LEAD, width), float(np.sqrt(2 * (1 - threshold)) + SLACK)

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(batch.column(1).to_pylist(), width) @ axes[:, :lead]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(x[:, 0]), pa.array(list(x), pa.list_(pa.float64()))],
                names=["node", "vector", "weight", "first", "lead"])

    shape = "node long, vector binary, weight long, first double, lead array<double>"
    placed = stored(classes.select("node", "vector", "weight").mapInArrow(leading, shape))
    tiles = stored(numbered(placed, F.lit(0), ["first", "node"], "rank").withColumn("tile", F.floor(F.col("rank") / tile)))

    corners = [f(F.get("lead", F.lit(k))).alias(f"{name}{k}") for k in range(lead) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    boxes = tiles.groupBy("tile").agg(*corners)
    # Tiles meet in bins of the first coordinate as wide as the reach, then by the distance of their boxes.
    bin_of = lambda c, more: F.floor(F.col(c) / reach) + more
    one = boxes.withColumn("bin", F.explode(F.sequence(bin_of("lo0", 0), bin_of("hi0", 0))))
    two = boxes.select(*[F.col(c).alias(f"{c}_") for c in boxes.columns]).withColumn(
        "bin", F.explode(F.sequence(bin_of("lo0_", -1), bin_of("hi0_", 1))))
    gap = sum(F.pow(F.greatest(F.lit(0.0), F.col(f"lo{k}") - F.col(f"hi{k}_"), F.col(f"lo{k}_") - F.col(f"hi{k}")), F.lit(2)) for k in range(lead))
    pairs = one.join(two, "bin").where((F.col("tile") <= F.col("tile_")) & (gap <= reach**2))
    pairs = stored(pairs.select(F.col("tile").alias("a"), F.col("tile_").alias("b")).distinct())

    body = tiles.select("tile", "node", "vector", "weight")
    sides = pairs.select(F.col("a").alias("tile"), "a", "b").union(pairs.where("a < b").select(F.col("b").alias("tile"), "a", "b"))

    def compare(group: pa.Table) -> pa.Table:
        at = np.argsort(group["node"].to_numpy(), kind="stable")
        tile_of, node, weight = (group[c].to_numpy()[at] for c in ("tile", "node", "weight"))
        raw = group["vector"].to_pylist()
        raw = [raw[k] for k in at]
        u, size = unit(raw, width), np.array([len(r) for r in raw])
        first = np.flatnonzero(tile_of == tile_of.min())
        other = np.flatnonzero(tile_of != tile_of.min())
        x = u @ axes
        a, b = linked(x[first], x[other] if len(other) else x[first], threshold, not len(other))
        a, b = first[a], (other if len(other) else first)[b]
        keep = []
        for cut in range(0, len(a), CHUNK):
            i, j = a[cut : cut + CHUNK], b[cut : cut + CHUNK]
            keep.append((np.einsum("ij,ij->i", u[i], u[j]) >= threshold) & (size[i] == size[j]))
        good = np.concatenate(keep) if keep else np.zeros(0, bool)
        a, b = a[good], b[good]
        links = np.zeros(len(node), np.int64)
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        hit = np.flatnonzero(links)
        return pa.table({"node": node[hit], "links": links[hit], "root": node[_smallest(len(node), a, b)][hit]})

    met = stored(body.join(sides, "tile").groupBy("a", "b").applyInArrow(compare, "node long, links long, root long"))
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    group = components(classes.select("node"), met.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = stored(classes.select("node", "vector", "least", "weight").join(group, "node").join(links, "node", "left"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select(
        "vector", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(known, "vector", "left").select(
        key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", key).alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
