"""Best-fit packing by a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutorgauge.llm.tokens import worker_encoder
from tutorgauge.operators.joins import settled

CAPACITY = 1024
BLOCK = 8192  # pieces packed together: an island's packings have this many entries
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 6
POPULATION = 4
END_ID = 2


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's ids and the end id.

    Only a document longer than the capacity is cut, into full pieces after a first one that takes what is left
    over. A null text counts as empty: one piece of one token. Every row is a document, repeated or not.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = worker_encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc_id"].tolist(), batch["text"]):
                ids = encoder.ids(content or "") + end
                n = len(ids) // 4
                first = n % capacity or capacity
                starts = [0, *range(first, n, capacity)]
                for i, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                    rows.append((doc, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": object})

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text).alias("text"))
    out = narrow.mapInPandas(encode, "doc_id string, piece int, start long, length long, ids_crc32 long")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


# --- one island: packings are arrays that give each item's bin ------------------------


class BestFit:
    """Open bins by free room; a bit set of the rooms in use finds the tightest bin that takes an item."""

    def __init__(self, capacity: int, free: list[int]):
        self.capacity, self.free = capacity, free
        self.by_room: dict[int, list[int]] = {}
        self.rooms = 0
        for b, room in enumerate(free):
            self._open(b, room)

    def _open(self, b: int, room: int) -> None:
        self.by_room.setdefault(room, []).append(b)
        self.rooms |= 1 << room

    def put(self, length: int) -> int:
        fitting = self.rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = self.by_room[room]
            b = at.pop()
            if not at:
                self.rooms &= ~(1 << room)
        else:
            b, room = len(self.free), self.capacity
            self.free.append(0)
        self.free[b] = room - length
        self._open(b, room - length)
        return b


def best_fit(lengths: np.ndarray, order: np.ndarray, bins: np.ndarray, free: list[int], capacity: int) -> np.ndarray:
    """Puts the items of ``order`` into the tightest bins that take them; ``bins`` is changed."""
    place = BestFit(capacity, free).put
    bins[order] = [place(x) for x in lengths[order].tolist()]
    return bins


def renumbered(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller and emptier ones instead of even ones."""
    fill = np.bincount(bins, lengths)
    return -len(fill), float(((fill / capacity) ** 2).mean())


def crossover(lengths: np.ndarray, one: np.ndarray, other: np.ndarray, capacity: int, draw: np.random.Generator) -> np.ndarray:
    """Well-filled bins of ``other`` go whole into ``one``; its bins that hold any of their items are dissolved, and
    the items so displaced, with those of its worst bins, are put back by best fit, longest first."""
    fill = np.bincount(other, lengths)
    full = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = np.zeros(len(fill), bool)
    chosen[draw.choice(full, max(1, len(full) // 3), replace=False)] = True
    injected = chosen[other]
    own = np.bincount(one, lengths)
    broken = np.zeros(len(own), bool)
    broken[one[injected]] = True
    broken[np.argsort(own, kind="stable")[: max(1, len(own) // 20)]] = True
    loose = broken[one] & ~injected
    child = np.full(len(lengths), -1, np.int64)
    child[injected] = other[injected]
    stays = ~injected & ~loose
    child[stays] = one[stays] + len(fill)
    settled_items = ~loose
    child[settled_items] = renumbered(child[settled_items])
    free = (capacity - np.bincount(child[settled_items], lengths[settled_items]).astype(np.int64)).tolist()
    order = np.flatnonzero(loose)
    noise = draw.random(len(order)) * 0.02 * capacity
    return renumbered(best_fit(lengths, order[np.argsort(-(lengths[order] + noise))], child, free, capacity))


def started(lengths: np.ndarray, size: int, capacity: int, draw: np.random.Generator) -> list[np.ndarray]:
    """Best fit, longest first; and with lengths blurred more and more."""
    out = []
    for i in range(size):
        order = np.argsort(-(lengths + draw.random(len(lengths)) * 0.03 * i * capacity), kind="stable")
        out.append(renumbered(best_fit(lengths, order, np.zeros(len(lengths), np.int64), [], capacity)))
    return out


def evolve(lengths: np.ndarray, packings: list[np.ndarray], generations: int, capacity: int, draw: np.random.Generator) -> list[np.ndarray]:
    """Each generation a child of two packings replaces the worst one unless it is worse still."""
    rated = sorted(((fitness(lengths, p, capacity), i, p) for i, p in enumerate(packings)), key=lambda x: x[:2], reverse=True)
    least = -(-int(lengths.sum()) // capacity)
    for g in range(generations):
        if -rated[0][0][0] <= least:
            break
        one, other = draw.choice(len(rated), 2, replace=len(rated) < 2)
        child = crossover(lengths, rated[one][2], rated[other][2], capacity, draw)
        rated.append((fitness(lengths, child, capacity), len(rated) + g, child))
        rated = sorted(rated, key=lambda x: x[:2], reverse=True)[: len(packings)]
    return [p for _, _, p in rated]


def packed(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION, seed: int = 42) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; no piece is cut or lost, lengths run from 1 to ``capacity``.

    Full pieces are sequences of their own. The others are dealt by hash to blocks of about ``block`` pieces, so that
    every array here is bounded; a block is packed by ``islands`` populations that evolve apart in different tasks.
    After each epoch the best packing of an island moves to the next one in place of its worst; at the end a block takes the best
    packing of its islands. State settles in the shared folder after each epoch. Runs of the same settled pieces agree.
    """
    numbered = settled(pieces.withColumn("_pack_uid", F.monotonically_increasing_id()))
    light = numbered.select("_pack_uid", F.col("length").cast("int").alias("length"))
    part = light.filter(F.col("length") < capacity)
    blocks = max(1, -(-part.count() // block))
    state_type = "block int, island int, uids array<long>, lengths array<int>, packings array<array<int>>"
    grouped = part.groupBy(F.pmod(F.xxhash64("_pack_uid", F.lit(seed)), F.lit(blocks)).cast("int").alias("block")).agg(F.sort_array(F.collect_list(F.struct("_pack_uid", "length"))).alias("items"))
    base = grouped.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("items._pack_uid").alias("uids"), F.col("items.length").alias("lengths"))
    base = base.withColumn("packings", F.array().cast("array<array<int>>"))

    def epoch(number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    draw = np.random.default_rng([seed, number, row.block, row.island])
                    lengths = np.asarray(row.lengths, np.int64)
                    packings = [np.asarray(p, np.int32) for p in row.packings] or started(lengths, population, capacity, draw)
                    found = evolve(lengths, packings, generations, capacity, draw)
                    yield pd.DataFrame({"block": [row.block], "island": [row.island], "uids": [row.uids], "lengths": [row.lengths], "packings": [[p.tolist() for p in found]]})

        return run

    width = max(1, blocks * islands)
    state = settled(base.repartition(width, "block", "island").mapInPandas(epoch(0), state_type))
    for number in range(1, epochs):
        elite = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.get("packings", F.lit(0)).alias("elite"))
        met = state.join(elite, ["block", "island"])
        moved = F.concat(F.slice("packings", 1, population - 1), F.array("elite"))
        state = settled(met.select("block", "island", "uids", "lengths", moved.alias("packings")).repartition(width, "block", "island").mapInPandas(epoch(number), state_type))
    rated = state.select("block", "island", F.array_max(F.get("packings", F.lit(0))).alias("last"))
    winner = rated.groupBy("block").agg(F.min(F.struct("last", "island")).alias("w")).select("block", "w.island")

    def offsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                bins, lengths = np.asarray(row.bins, np.int64), np.asarray(row.lengths, np.int64)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(lengths[order])
                firsts = np.searchsorted(bins[order], bins[order])
                begin = (ends - lengths[order])
                yield pd.DataFrame({"uid": np.asarray(row.uids)[order], "sequence_id": (row.block << 24) + bins[order] << 1, "offset": begin - begin[firsts]})

    best = state.join(winner, ["block", "island"]).select("block", "uids", "lengths", F.get("packings", F.lit(0)).alias("bins"))
    placed = best.mapInPandas(offsets, "uid long, sequence_id long, offset long")
    whole = light.filter(F.col("length") >= capacity).select(F.col("_pack_uid").alias("uid"), (F.col("_pack_uid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    spots = settled(placed.union(whole))
    return numbered.join(spots, numbered["_pack_uid"] == spots["uid"]).drop("_pack_uid", "uid")
