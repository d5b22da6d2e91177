"""Clustering around centroids, exact, with zone maps along a space-filling curve.

Vectors are turned to integers and stored once in the order of a Hilbert curve, in blocks with the smallest and largest value of every
component. In each round a block first asks its box which centroids can be nearest to any point in it: the centroid
nearest to the middle of the box beats another one for good if it does so in the other's best corner. Only what is left
is compared vector by vector, with exact integers. A round reads the blocks and returns one sum per centroid and task.
"""
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kinsift.llm.common import arrow_rows
from kinsift.session import materialise, release

#: Vectors of a block, and components that the curve runs through: those that vary most, 8 bits each.
BLOCK, CURVE_AXES, CURVE_BITS = 256, 7, 8
#: Integers are held to this size, so that squared distances fit a long: components beyond half a million at a scale of 256.
LARGEST = 1 << 27


def hilbert(cells, bits):
    """Position along the Hilbert curve of grid cells, one row each (after Skilling, Programming the Hilbert Curve, 2004)."""
    x = cells.astype(np.int64).copy()
    axes = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(axes):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & (q - 1))
            x[:, 0] ^= np.where(high, q - 1, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    turn, q = np.zeros(len(x), np.int64), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[:, -1] & q, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    place = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            place = (place << 1) | ((x[:, i] >> bit) & 1)
    return place


def possible(low, high, centroids):
    """Numbers, ascending, of the centroids that are nearest (ties: smaller number) to some point of the box."""
    middle = (low + high) / 2
    best = int(np.argmin(((centroids - middle) ** 2).sum(1)))
    r, c = centroids[best], centroids
    # Distance to the reference less distance to another one is linear in each component, so it is largest in a corner.
    lead = np.maximum((low - r) ** 2 - (low - c) ** 2, (high - r) ** 2 - (high - c) ** 2).sum(1)
    number = np.arange(len(c))
    return number[(lead > 0) | ((lead == 0) & (number <= best))]


def nearest(vectors, low, high, centroids):
    """(centroid, squared distance) of every vector of a block, both exact."""
    some = possible(low, high, centroids)
    c = centroids[some]
    if max(np.abs(low).max(), np.abs(high).max(), np.abs(c).max()) < (1 << 22) and vectors.shape[1] <= 64:
        # All products and sums stay under 2 ** 53, where doubles are exact.
        x, y = vectors.astype(np.float64), c.astype(np.float64)
        distance = ((x ** 2).sum(1)[:, None] - 2 * (x @ y.T) + (y ** 2).sum(1)).astype(np.int64)
    else:
        distance = np.stack([((vectors - one) ** 2).sum(1) for one in c], 1)
    at = distance.argmin(1)
    return some[at], distance[np.arange(len(at)), at]


def whole_vectors(table, vec_id, embedding, size, scale):
    """vec_id, v: vectors of exactly `size` components, none null or not finite, as integers floor(scale * x)."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-1e12)), F.lit(1e12))), F.lit(-LARGEST)), F.lit(LARGEST))
    return (table.where((F.size(embedding) == size) & ~bad)
            .select(F.col(vec_id).alias("vec_id"), F.transform(embedding, lambda x: held(x).cast("int")).alias("v")))


def first_centroids(vectors, k, seed):
    """The k vectors with the smallest digest of `seed:vec_id`; null ids come last, equal ids go by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(digest.alias("digest"), "v").orderBy(F.col("digest").isNull(), "digest", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def blocks_of(vectors, size, rows):
    """Stored blocks (n, ids, box, data) in curve order. Equal vectors may lie in several partitions."""
    # Mean and spread of every component decide the grid; where the grid lies changes the order, never the result.
    stats = vectors.select(*[F.avg(F.get("v", F.lit(i))).alias(f"m{i}") for i in range(size)],
                           *[F.stddev_pop(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(size)]).first()
    mean = np.array([stats[i] or 0.0 for i in range(size)])
    spread = np.array([stats[size + i] or 0.0 for i in range(size)])
    axes = np.argsort(-spread, kind="stable")[:CURVE_AXES]
    id_type = vectors.schema["vec_id"].dataType
    half = 1 << (CURVE_BITS - 1)

    def place(batches):
        for batch in batches:
            x = np.array(batch.column("v").flatten(), np.int64).reshape(-1, size)
            cells = np.clip((x[:, axes] - mean[axes]) / np.maximum(spread[axes], 1e-9) * (half / 3) + half, 0, 2 * half - 1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(hilbert(cells, CURVE_BITS))], ["vec_id", "v", "place"])

    def box(batches):
        ids, held = [], np.zeros((0, size), np.int32)

        def block(names, x):
            edges = np.concatenate([x.min(0), x.max(0)]).astype("<i4")
            return pa.RecordBatch.from_arrays([pa.array([names], pa.list_(to_arrow_type(id_type))), pa.array([edges.tobytes()], pa.binary()),
                                               pa.array([x.astype("<i4").tobytes()], pa.binary())], ["ids", "box", "data"])

        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            held = np.concatenate([held, np.array(batch.column("v").flatten(), np.int32).reshape(-1, size)])
            while len(ids) >= rows:
                yield block(ids[:rows], held[:rows])
                ids, held = ids[rows:], held[rows:]
        if ids:
            yield block(ids, held)

    name = id_type.simpleString()
    placed = vectors.mapInArrow(place, f"vec_id {name}, v array<int>, place long").withColumn("spread", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange("place", "spread").sortWithinPartitions("place", "spread").select("vec_id", "v")
    return materialise(ordered.mapInArrow(box, f"ids array<{name}>, box binary, data binary"))


def _read(batch, size):
    """(ids, vectors, low, high) of each block of a batch."""
    for ids, box, data in zip(batch.column("ids"), batch.column("box"), batch.column("data")):
        low, high = np.frombuffer(box.as_py(), "<i4").reshape(2, size).astype(np.int64)
        yield ids.values, np.frombuffer(data.as_py(), "<i4").reshape(-1, size).astype(np.int64), low, high


def _sums(blocks, centroids):
    """Rows (cluster, n, sums) of the vectors nearest to each centroid, folded in every task; as many rows as centroids."""
    k, size = centroids.shape

    def fold(batches):
        total, n = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, x, low, high in _read(batch, size):
                cluster, _ = nearest(x, low, high, centroids)
                for c in np.unique(cluster):
                    total[c] += x[cluster == c].sum(0)
                n += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))],
                                         ["cluster", "n", "sums"])

    found = blocks.mapInArrow(fold, "cluster int, n long, sums array<long>").groupBy("cluster").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")) for i in range(size)]).alias("sums"))
    return found.collect()


def cluster(table, k=40, rounds=5, vec_id="vec_id", embedding="embedding", size=64, scale=256, seed=2, block=BLOCK):
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors with another number of components, or a null, NaN or infinite one, are left out; null ids are kept. Repeated rows are separate
    vectors. With fewer vectors than k there are so many centroids; an empty table gives an empty one. Integers
    beyond 2 ** 27 are held there. Ties go to the smaller number. Other columns are not looked at.
    """
    spark = table.sparkSession
    vectors = whole_vectors(table, vec_id, embedding, size, scale)
    name = vectors.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {name}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    with arrow_rows(spark, 2048):
        blocks = blocks_of(vectors, size, block)
    id_type = to_arrow_type(vectors.schema["vec_id"].dataType)

    with arrow_rows(spark, 64):
        for _ in range(rounds):
            moved = centroids.copy()
            for row in _sums(blocks, centroids):
                moved[row["cluster"]] = [int(total) // row["n"] for total in row["sums"]]
            if (moved == centroids).all():
                break
            centroids = moved

        def assign(batches):
            for batch in batches:
                for ids, x, low, high in _read(batch, size):
                    at, distance = nearest(x, low, high, centroids)
                    yield pa.RecordBatch.from_arrays([ids.cast(id_type), pa.array(at.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

        placed = materialise(blocks.mapInArrow(assign, f"vec_id {name}, cluster int, distance long"))
    release(blocks)
    inertia = placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()
    total = sum(r["d"] for r in inertia)
    known = [(r["cluster"], r["d"], total, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in inertia]
    facts = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # At most k rows.
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
