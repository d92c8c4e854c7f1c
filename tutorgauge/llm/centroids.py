"""Centroid clustering with heap-ordered bounds: per cluster a heap of gaps, offset by the drift of the centroids."""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutorgauge.operators.joins import released, settled
from tutorgauge.session import new_folder

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, 3
BLOCK = 2048  # vectors whose heaps lie together
LIMIT = 1 << 27  # components beyond it could give distances that no long holds
SLACK = 1e-3  # far above the rounding of a gap, far below a grid step: a gap this small counts as expired
_STATE = "block long, keys binary, places binary, sizes binary, moved binary, popped long"


def grid_vectors(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``(id, x)``: vectors of ``dims`` components, none null, NaN or infinite, as integers ``floor(scale * component)``; others are left out."""
    v = F.col(vector)
    sound = (F.size(v) == dims) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    step = lambda c: c.cast("double") * scale
    large = F.raise_error(F.lit("a component is too large for exact distances")).cast("long")
    x = F.transform(v, lambda c: F.when(F.abs(step(c)) < LIMIT, F.floor(step(c)).cast("long")).otherwise(large))
    return table.filter(F.coalesce(sound, F.lit(False))).select(F.col(id_col).alias("id"), x.alias("x"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows: in doubles where every partial sum is below 2^53, else in longs."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * most * most < 1 << 53 else np.int64
    x, c = x.astype(kind), c.astype(kind)
    return ((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T)).astype(np.int64)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) and the gap: distance of the second nearest less that of the nearest."""
    d = squared(x, c)
    own = d.argmin(1)
    if d.shape[1] == 1:
        return own, np.full(len(x), np.inf)
    two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64))
    return own, two[:, 1] - two[:, 0]


class Heaps:
    """Heaps of the vectors of a block, one a cluster, as arrays in heap order.

    A key is the gap of a vector plus the drift its cluster had at that time, so keys need no change when centroids move:
    a vector may have left its cluster only if its key is not above the cluster's drift now.
    """

    def __init__(self, keys: list[np.ndarray], places: list[np.ndarray]):
        self.keys, self.places = keys, places

    @classmethod
    def empty(cls, k: int) -> Heaps:
        return cls([np.empty(0)] * k, [np.empty(0, np.int32)] * k)

    @classmethod
    def of(cls, keys: bytes, places: bytes, sizes: bytes) -> Heaps:
        cuts = np.cumsum(np.frombuffer(sizes, np.int32))[:-1]
        return cls(np.split(np.frombuffer(keys, np.float64), cuts), np.split(np.frombuffer(places, np.int32), cuts))

    def packed(self) -> tuple[bytes, bytes, bytes]:
        return np.concatenate(self.keys).tobytes(), np.concatenate(self.places).tobytes(), np.array([len(k) for k in self.keys], np.int32).tobytes()

    def pop(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take out what has expired: places and the clusters they were in. A heap whose top holds is not touched."""
        out, of = [], []
        for j, keys in enumerate(self.keys):
            if len(keys) == 0 or keys[0] - drift[j] > SLACK:
                continue
            heap = list(zip(keys.tolist(), self.places[j].tolist()))
            while heap and heap[0][0] - drift[j] <= SLACK:
                out.append(heapq.heappop(heap)[1])
                of.append(j)
            self.keys[j], self.places[j] = np.array([h[0] for h in heap]), np.array([h[1] for h in heap], np.int32)
        return np.array(out, np.int64), np.array(of, np.int64)

    def push(self, places: np.ndarray, own: np.ndarray, gaps: np.ndarray, drift: np.ndarray) -> None:
        for j in np.unique(own).tolist():
            mine = own == j
            heap = list(zip(self.keys[j].tolist(), self.places[j].tolist()))
            for entry in zip((gaps[mine] + drift[j]).tolist(), places[mine].tolist()):
                heapq.heappush(heap, entry)
            self.keys[j], self.places[j] = np.array([h[0] for h in heap]), np.array([h[1] for h in heap], np.int32)

    def clusters(self, n: int) -> np.ndarray:
        out = np.empty(n, np.int64)
        for j, places in enumerate(self.places):
            out[places] = j
        return out


def _blocks(vectors: DataFrame, dims: int, block: int) -> DataFrame:
    """``(block, ids, n, x)``: runs of vectors as one matrix of the narrowest whole numbers that hold them."""
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, len(batch), block):
                part = batch.iloc[at : at + block]
                x = np.array(part["x"].tolist(), np.int64).reshape(len(part), dims)
                x = x.astype(np.int16 if len(x) and np.abs(x).max() < 1 << 15 else np.int32)
                ids = [None if pd.isna(i) else i for i in part["id"].astype(object)]
                yield pd.DataFrame({"block": [number], "ids": [ids], "n": [len(part)], "x": [x.tobytes()]})
                number += 1

    return vectors.select(F.col("id"), "x").mapInPandas(run, f"block long, ids array<{kind}>, n int, x binary")


def _matrix(x: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(x, np.int16 if len(x) == 2 * n * dims else np.int32).reshape(n, dims)


def _advance(rows: DataFrame, c: np.ndarray, drift: np.ndarray, started: bool) -> DataFrame:
    """New heaps of every block; a task adds one row without a block: what its moved vectors change in sums and counts."""
    k, dims = c.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        moved, total = np.zeros((k, dims + 1), np.int64), 0
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                x = _matrix(row.x, row.n, dims)
                heaps = Heaps.of(row.keys, row.places, row.sizes) if started else Heaps.empty(k)
                places, before = heaps.pop(drift) if started else (np.arange(row.n), None)
                if len(places):
                    popped = x[places]
                    own, gaps = nearest(popped, c)
                    heaps.push(places, own, gaps, drift)
                    change = np.arange(len(places)) if before is None else np.flatnonzero(own != before)
                    mass = np.concatenate([popped[change], np.ones((len(change), 1))], axis=1).astype(np.int64)
                    np.add.at(moved, own[change], mass)
                    if before is not None:
                        np.subtract.at(moved, before[change], mass)
                    total += len(places)
                out.append((row.block, *heaps.packed(), None, 0))
            yield pd.DataFrame(out, columns=["block", "keys", "places", "sizes", "moved", "popped"]).astype({"block": "Int64"})
        if total:
            yield pd.DataFrame({"block": pd.array([None], "Int64"), "keys": [None], "places": [None], "sizes": [None], "moved": [moved.astype(">i8").tobytes()], "popped": [total]})

    return rows.mapInPandas(run, _STATE)


def _changes(state: DataFrame, k: int, dims: int) -> tuple[list[list[int]], int]:
    """Sums and counts that moved, added up exactly over all tasks: ``k * (dims + 1)`` numbers, and how many vectors were rescanned."""
    cells = F.expr(f"transform(sequence(0, {k * (dims + 1) - 1}), i -> cast(conv(hex(substring(moved, i * 8 + 1, 8)), 16, -10) as decimal(38,0)))")
    parts = state.filter("block IS NULL")
    rows = parts.select(F.posexplode(cells).alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = [0] * (k * (dims + 1))
    for r in rows:
        flat[r["at"]] = int(r["v"])
    total = parts.agg(F.coalesce(F.sum("popped"), F.lit(0)).alias("n")).first()["n"]
    return [flat[j * (dims + 1) : (j + 1) * (dims + 1)] for j in range(k)], total


def _first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the least sha256 of seed and id, null ids last, equal ids by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select("x", digest.alias("digest")).orderBy(F.col("digest").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def clustered(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, block: int = BLOCK, stats: list | None = None) -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid)`` per kept vector after exact rounds of assignment and update.

    Vectors become integers (``grid_vectors``), so distances, sums and centroids are exact. Blocks of vectors are written once as a bucketed
    table. Beside it each round writes the heaps of the blocks, 12 bytes a vector: a cluster's heap has the gap between the two
    nearest centroids of each vector, offset by the drift so far. A centroid that moved by p, while the others moved by at most q,
    closes the gaps of its vectors by at most p + q, which is added to its drift; only vectors whose key the drift has reached are
    popped, measured against all centroids and pushed again. Sums and counts change by what moved. The heaps join the bucketed
    table on the block, so vectors are never shuffled after the first write; the heaps of the round before are then deleted.

    ``stats``, if given, gets the number of vectors measured in each round. A vector of another length or with a null, NaN or
    infinite component is left out; a null id is an id (it can give a first centroid only where others are too few); repeated
    rows count each; with fewer than ``k`` vectors every one is a centroid; an empty table gives no rows. A component of
    2^27 / ``scale`` or more raises an error, as distances would not fit a long. Other columns are not read.
    """
    spark = table.sparkSession
    vectors = grid_vectors(table, id_col, vector, dims, scale)
    kind = vectors.schema["id"].dataType.simpleString()
    out_type = f"id {kind}, cluster int, distance long"
    c = _first_centroids(vectors, k, seed)
    if not len(c):
        return spark.createDataFrame([], f"{out_type}, cluster_inertia long, inertia long, centroid array<long>")
    k = len(c)
    buckets = max(spark.sparkContext.defaultParallelism, vectors.rdd.getNumPartitions())
    name, path = f"tutorgauge_blocks_{uuid.uuid4().hex}", new_folder(spark, "blocks")
    dealt = _blocks(vectors, dims, block).repartition(buckets, "block")
    dealt.write.format("parquet").option("path", path).bucketBy(buckets, "block").saveAsTable(name)
    try:
        blocks = spark.table(name)
        blocks._settled_path = path
        drift = np.zeros(k)
        state = settled(_advance(blocks.select("block", "n", "x"), c, drift, False))
        sums, popped = _changes(state, k, dims)
        for number in range(rounds):
            if stats is not None:
                stats.append(popped)
            new = np.array([[s // row[-1] for s in row[:-1]] if row[-1] else c[j].tolist() for j, row in enumerate(sums)], np.int64)
            step = np.array([float(sum((int(a) - int(b)) ** 2 for a, b in zip(new[j], c[j]))) ** 0.5 for j in range(k)])
            drift = drift + step + np.array([max(np.delete(step, j), default=0.0) for j in range(k)])
            c = new
            met = blocks.select("block", "n", "x").join(state.filter("block IS NOT NULL").select("block", "keys", "places", "sizes"), "block")
            old, state = state, settled(_advance(met.select("n", "x", "block", "keys", "places", "sizes"), c, drift, True))
            change, popped = _changes(state, k, dims)
            sums = [[a + b for a, b in zip(x, y)] for x, y in zip(sums, change)]
            released(old)
        if stats is not None:
            stats.append(popped)

        def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    own = Heaps.of(row.keys, row.places, row.sizes).clusters(row.n)
                    d = squared(_matrix(row.x, row.n, dims), c)[np.arange(row.n), own]
                    yield pd.DataFrame({"id": pd.Series(list(row.ids), dtype=object), "cluster": own.astype(np.int32), "distance": d})

        met = blocks.join(state.filter("block IS NOT NULL").select("block", "keys", "places", "sizes"), "block")
        out = settled(met.mapInPandas(assigned, out_type))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    released(blocks, state)
    own = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("cluster_inertia"))  # k rows
    own = {r["cluster"]: int(r["cluster_inertia"]) for r in own.collect()}
    facts = spark.createDataFrame([(j, own.get(j, 0), sum(own.values()), c[j].tolist()) for j in range(k)], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return out.join(F.broadcast(facts), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
