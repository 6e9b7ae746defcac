"""Integer centroid clustering over Hilbert-ordered blocks: boxes rule out centroids for whole blocks, the rest is compared exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bandweave.session import cut_lineage

KEY_DIMENSIONS, KEY_BITS = 8, 7
BLOCK = 512
LIMIT = 1 << 27
MAX_CLUSTERS = 4096


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each point (rows of integers below 2^``bits``) on the Hilbert curve of its dimensions.

    Bit planes are read from the top. The curve inside a cell is the one of the whole cube after a reflection and an
    exchange of axes that follow from the planes above, which are applied to all lower bits at once.
    """
    axes = points.astype(np.uint64).T.copy()
    count, one = len(axes), np.uint64(1)
    key = turned = np.zeros(points.shape[0], np.uint64)
    for bit in range(bits - 1, -1, -1):
        low = np.uint64((1 << bit) - 1)
        plane = (axes >> np.uint64(bit)) & one
        for axis in range(count):
            on = plane[axis].astype(bool)
            swap = np.where(on, np.uint64(0), (axes[0] ^ axes[axis]) & low)
            axes[0] ^= np.where(on, low, swap)
            if axis:
                axes[axis] ^= swap
        steps = np.bitwise_xor.accumulate(plane, axis=0)
        for axis in range(count):
            key = (key << one) | (steps[axis] ^ turned)
        turned = turned ^ steps[-1]
    return key


def usable(dimensions: int) -> Column:
    """True for a vector of ``dimensions`` components, none of them null, NaN or infinite."""
    value = F.col("vector")
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(value) == dimensions) & ~bad, F.lit(False))


def integer_vectors(vectors: DataFrame, vector: str, scale: int, dimensions: int) -> DataFrame:
    """vec_id and ``vector`` as integers floor(scale * x) of the usable rows."""
    typed = vectors.select("vec_id", F.col(vector).cast("array<double>").alias("vector")).where(usable(dimensions))
    scaled = F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x))
    fits = F.forall(scaled, lambda x: (x > -LIMIT) & (x < LIMIT))
    checked = F.when(fits, scaled).otherwise(F.raise_error(F.lit(f"a component beyond {LIMIT} after scaling: squared distances would not fit in 64 bits")))
    return typed.select("vec_id", checked.alias("vector"))


def first_centroids(found: DataFrame, clusters: int, seed: str) -> np.ndarray:
    """The vectors of the ``clusters`` smallest hashes of seed:vec_id, in hash order; rows of one id by their values."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = found.where("vec_id IS NOT NULL").select("vector", place.alias("place")).orderBy("place", "vector").limit(clusters).collect()
    return np.array([r["vector"] for r in rows], np.int64)


def blocks(found: DataFrame, dimensions: int, block: int) -> DataFrame:
    """Vectors along the curve in rows of up to ``block``: ids, packed values and the least and greatest of each component.

    The curve runs over the KEY_DIMENSIONS components of largest variance, each in 2^KEY_BITS steps between its
    extremes. Equal vectors share a key; they are spread by a hash of their id and their row, so many copies make many
    blocks in several tasks.
    """
    part = [F.col("vector")[k].cast("double") for k in range(dimensions)]
    stats = found.agg(F.array([F.struct(F.var_pop(p).alias("spread"), F.min(p).alias("low"), F.max(p).alias("high")) for p in part]).alias("s")).first()["s"]
    chosen = sorted(range(dimensions), key=lambda k: (-(stats[k]["spread"] or 0.0), k))[:KEY_DIMENSIONS]
    low = np.array([stats[k]["low"] or 0.0 for k in chosen])
    width = np.array([(stats[k]["high"] or 0.0) - (stats[k]["low"] or 0.0) + 1.0 for k in chosen])
    kind = found.schema["vec_id"].dataType.simpleString()

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dimensions)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = np.floor((matrix(batch.column(1))[:, chosen] - low) / width * (1 << KEY_BITS))
            keys = hilbert_keys(np.clip(steps, 0, (1 << KEY_BITS) - 1), KEY_BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.astype(np.int64))], names=["vec_id", "vector", "place"])

    def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                some = batch.slice(start, block)
                values = matrix(some.column(1))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column(0)),
                                                  *[pa.array([v.astype("<i4").tobytes()], pa.binary()) for v in (values, values.min(0), values.max(0))]],
                                                 names=["vec_ids", "packed", "low", "high"])

    placed = found.mapInArrow(keyed, f"vec_id {kind}, vector array<long>, place long")
    along = placed.withColumn("spread_by", F.xxhash64("vec_id", F.monotonically_increasing_id()))
    along = along.repartitionByRange("place", "spread_by").sortWithinPartitions("place", "spread_by").select("vec_id", "vector")
    return cut_lineage(along.mapInArrow(boxed, f"vec_ids array<{kind}>, packed binary, low binary, high binary"))


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids that may be nearest to a vector within the box: those no farther from it than the
    farthest corner of the box is from the best centroid."""
    under, over = low - centroids, centroids - high
    least = (np.maximum(np.maximum(under, over), 0) ** 2).sum(1)
    most = (np.maximum(np.abs(under), np.abs(over)) ** 2).sum(1)
    return np.flatnonzero(least <= most.min())


def nearest(values: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest of the centroids ``among`` (ascending) and the squared distance, in integers; ties to the smaller number."""
    best = np.full(len(values), -1, np.int64)
    distance = np.full(len(values), np.iinfo(np.int64).max)
    for number in among:
        step = values - centroids[number]
        found = np.einsum("ij,ij->i", step, step)
        closer = found < distance
        best[closer], distance[closer] = number, found[closer]
    return best, distance


def compared(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Of each block: its vectors, their clusters and distances, and the number of centroids compared."""
    dimensions = centroids.shape[1]
    for packed, low, high in zip(*[batch.column(c) for c in ("packed", "low", "high")]):
        values, low, high = [np.frombuffer(x.as_py(), "<i4").astype(np.int64) for x in (packed, low, high)]
        values, among = values.reshape(-1, dimensions), candidates(low, high, centroids)
        yield values, *nearest(values, centroids, among), len(among)


def cluster_sums(parts: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int], int]]:
    """Number of vectors, component sums and summed distance of each cluster: one row a cluster from each task,
    added up by Spark; the driver gets a row a cluster."""
    dimensions = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, spread = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for values, cluster, distance, _ in compared(batch, centroids):
                count += np.bincount(cluster, minlength=len(count))
                np.add.at(total, cluster, values)
                np.add.at(spread, cluster, distance)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(spread[some]),
                                          pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * dimensions, pa.int32()), pa.array(total[some].ravel()))],
                                         names=["cluster", "n", "spread", "sums"])

    partial = parts.select("packed", "low", "high").mapInArrow(run, "cluster int, n long, spread long, sums array<long>")
    whole = partial.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("spread").alias("spread"), F.array([F.sum(F.col("sums")[k]) for k in range(dimensions)]).alias("sums"))
    return {r["cluster"]: (r["n"], r["sums"], r["spread"]) for r in whole.collect()}


def cluster(vectors: DataFrame, clusters: int = 16, rounds: int = 3, vector: str = "embedding", scale: int = 64, dimensions: int = 64, seed: str = "1", block: int = BLOCK) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector.

    Components become floor(scale * x). ``rounds`` times every vector goes to its nearest centroid (squared Euclidean
    distance, ties to the smaller number) and each centroid moves to floor(sum / count) of its vectors, componentwise;
    one without vectors stays. Then vectors are assigned once more. All arithmetic is in integers.

    Vectors that are null, of another length, or hold a null or non-finite component take no part. Fewer usable
    vectors than ``clusters``: as many centroids as there are. Repeated rows count each; a null vec_id is clustered but
    never a first centroid; first centroids of one id are ordered by their values. Empty table, or only null ids: no rows.
    A component of 2^27 or more after scaling stops the job, as squared distances would pass 64 bits. Only vec_id and the vector are read.
    """
    if clusters > MAX_CLUSTERS:
        raise ValueError(f"at most {MAX_CLUSTERS} clusters")
    found = integer_vectors(vectors, vector, scale, dimensions)
    kind = found.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(found, clusters, seed)
    schema = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return found.sparkSession.createDataFrame([], schema)
    parts = blocks(found, dimensions, block)
    for _ in range(rounds):
        centroids = centroids.copy()
        for number, (n, sums, _) in cluster_sums(parts, centroids).items():
            centroids[number] = [s // n for s in sums]
    spreads = {number: spread for number, (_, _, spread) in cluster_sums(parts, centroids).items()}
    inertia = sum(spreads.values())
    names = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()])

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.array([spreads.get(k, 0) for k in range(len(centroids))], np.int64)
        for batch in batches:
            for ids, (values, number, distance, _) in zip(batch.column("vec_ids"), compared(batch, centroids)):
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(number, pa.int32()), pa.array(distance), pa.array(own[number]),
                                                  pa.array(np.full(len(number), inertia, np.int64)), pa.array(names[number].tolist(), pa.string())],
                                                 names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return parts.mapInArrow(assigned, schema)
