"""Whitening of embeddings by a covariance weighted with multiplicities.

An entry c becomes the integer floor(64 * c) + 1000000, so that vectors are compared and summed exactly.
Equal vectors are one row with a count, which is its weight in the fit (or one, if repeats aren't to
count). Sums of entries are exact; each task multiplies its centred vectors by their weights and by
themselves (one matrix product), and the products of tasks are added entry by entry. The driver
holds a matrix of dimensions by dimensions and nothing that grows with the rows. Each distinct vector
is projected once and joined back to its rows; a vector that very many rows share is one row on one side
of that join, and adaptive skew handling splits the other side.

Defined cases: a null or empty vector, and one with a null, infinite or NaN entry, is left out; repeated rows
and ids stay; a null id keeps its row; components of equal eigenvalues come in the order that the
solver gives; a direction without variance (an eigenvalue below 1e-12 of the trace) has whitened null and no part in
identity_error; a table without a remaining vector gives an empty one; vectors of different lengths are an
error, as is a deviation beyond 64 bits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.session import discard, ship_package, stored

STEP, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Share of the trace below which a direction has no variance.
FLAT = 1e-12


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x array<bigint>) of the rows whose vector is whole and finite."""
    c = F.col("embedding").cast("array<double>")
    inf = float("inf")
    fine = F.forall(c, lambda e: F.coalesce(~F.isnan(e) & (e < inf) & (e > -inf), F.lit(False)))
    rows = embeddings.select("vec_id", c.alias("embedding")).where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(fine)
    return rows.select("vec_id", F.transform("embedding", lambda e: F.floor(e * STEP).cast("bigint") + SHIFT).alias("x"))


@dataclass
class Fit:
    """What a fit gives: weights' total, sums of entries (exact), and components as columns."""

    n: int
    sums: list[int]
    vectors: np.ndarray  # dimensions by components, unit columns
    values: np.ndarray  # eigenvalues, falling
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n in doubles: an integer near the mean is taken off first, so nothing is rounded
    but the remainder."""
    near = [s // n for s in sums]
    return (x - np.array(near, np.int64)).astype(np.float64) - np.array([(s - n * a) / n for s, a in zip(sums, near)])


def matrix(column: pa.Array) -> np.ndarray:
    """A column of integer vectors of one length as a matrix."""
    values, offsets = column.flatten().to_numpy(), column.offsets.to_numpy()
    return values.reshape(len(column), (offsets[-1] - offsets[0]) // len(column))


def weighted(rows: DataFrame, weights: str = "counts") -> DataFrame:
    """(key, x, m, weight) of the distinct vectors, m being how often one occurs."""
    if weights not in ("counts", "one"):
        raise ValueError("weights are counts or one")
    same = rows.groupBy("x").agg(F.count(F.lit(1)).alias("m"))
    return same.select(key_of().alias("key"), "x", "m", (F.col("m") if weights == "counts" else F.lit(1).cast("bigint")).alias("weight"))


def key_of():
    """A short key of a vector for joins."""
    return F.md5(F.concat_ws(",", F.col("x").cast("array<string>")))


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The fit over distinct vectors (x, weight), None without any."""
    ship_package(distinct.sparkSession)
    lengths = distinct.agg(F.min(F.size("x")), F.max(F.size("x")), F.sum("weight")).first()
    if lengths[2] is None:
        return None
    size, n = lengths[0], int(lengths[2])
    if size != lengths[1]:
        raise ValueError(f"vectors have {lengths[0]} to {lengths[1]} entries; whitening needs one length")

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * size  # Python's integers, whatever the counts
        for batch in batches:
            if batch.num_rows:
                part = matrix(batch.column(0)).astype(object) if batch.column(1).to_numpy().max() > 1 << 20 else matrix(batch.column(0))
                total = [a + int(b) for a, b in zip(total, (part * batch.column(1).to_numpy()[:, None]).sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(map(str, total), pa.string())], ["dim", "s"])

    got = distinct.select("x", "weight").mapInArrow(sums_of, "dim int, s string").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # a row a dimension
    sums = [int(s) for _, s in sorted((r.dim, r.s) for r in got)]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                c = centred(matrix(batch.column(0)), n, sums)
                total += (c * batch.column(1).to_numpy()[:, None]).T @ c
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    entries = distinct.select("x", "weight").mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()  # half a matrix
    covariance = np.zeros((size, size))
    covariance[entries["i"], entries["j"]] = covariance[entries["j"], entries["i"]] = entries["v"] / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    vectors = vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    trace = float(np.trace(covariance))
    explained = values[order] / trace if trace > 0 else np.zeros(len(order))
    return Fit(n, sums, vectors, values[order], explained)


def projected(distinct: DataFrame, model: Fit) -> DataFrame:
    """(key, weight, deviation, whitened array) of each distinct vector."""
    ship_package(distinct.sparkSession)
    alive = model.values > FLAT * max(model.values.max() / max(model.explained.max(), 1e-300), 1e-300) if model.explained.any() else np.zeros(len(model.values), bool)
    scale = np.where(alive, 1 / np.sqrt(np.where(alive, model.values, 1.0)), np.nan)
    near = [s // model.n for s in model.sums]
    rest = [s - model.n * a for s, a in zip(model.sums, near)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            y = x - np.array(near, np.int64)
            most = int(np.abs(y).max()) * model.n + max(map(abs, rest))  # bounds n * x - S
            if most * most * x.shape[1] < 1 << 63:
                deviation = ((y * model.n - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
            else:
                deviation = [sum((int(a) * model.n - b) ** 2 for a, b in zip(row, rest)) for row in y]
            white = model.centred(x) @ model.vectors * scale
            values = pa.array(white.ravel(), pa.float64(), mask=np.isnan(white.ravel()))
            lists = pa.ListArray.from_arrays(np.arange(0, white.size + 1, white.shape[1], dtype=np.int32), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(deviation, pa.int64()), lists], ["key", "weight", "deviation", "whitened"])

    return distinct.select("key", "x", "weight").mapInArrow(work, "key string, weight bigint, deviation bigint, whitened array<double>")


def identity_error(white: DataFrame, n: int, size: int) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(size), np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                z = np.nan_to_num(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, size)
                w = batch.column(0).to_numpy()[:, None]
                total += (z * w).sum(axis=0)
                products += (z * w).T @ z
        whole = np.vstack([total, products])
        at = np.indices(whole.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(whole.ravel())], ["i", "j", "v"])

    got = white.select("weight", "whitened").mapInArrow(sums_of, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()  # components squared
    whole = np.zeros((size + 1, size))
    whole[got["i"], got["j"]] = got["v"] / n
    alive = np.diag(whole[1:]) > 0
    error = np.abs(whole[1:] - np.outer(whole[0], whole[0]) - np.eye(size))[np.ix_(alive, alive)]
    return float(error.max()) if error.size else 0.0


def whiten(embeddings: DataFrame, components: int = COMPONENTS, weights: str = "counts") -> DataFrame:
    """Per remaining row of (vec_id, embedding) and component, at most ``components`` of them: vec_id,
    component (from 1), n (weights of the fit), deviation (sum over entries of (n * x - S) squared),
    whitened, explained (share of the trace), identity_error (one value)."""
    rows = quantised(embeddings)
    distinct = stored(weighted(rows, weights), "whitening-distinct")
    model = fit(distinct, components)
    spark = embeddings.sparkSession
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    if model is None:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    white = stored(projected(distinct, model), "whitening-vectors")
    error = identity_error(white, model.n, len(model.values))
    joined = rows.select("vec_id", key_of().alias("key")).join(white.select("key", "deviation", "whitened"), "key")
    shares = F.array(*map(F.lit, model.explained.tolist()))
    flat = joined.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    out = stored(flat.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", shares[F.col("place")].alias("explained"), F.lit(error).alias("identity_error")), "whitened")
    discard(distinct)
    discard(white)
    return out
