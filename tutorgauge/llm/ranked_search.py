"""Ranked lexical search over bit-sliced Bloom signatures: bounds from slices, exact scores where a bound does not exclude."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutorgauge.operators.joins import released, settled, sized
from tutorgauge.operators.ranking import top_per_group

TOP = 10
BUFFER_DOCS, BUFFER_BYTES = 4096, 4 << 20  # documents that are signed together
BITS_PER_ENTRY = 16
FIRST = 100  # documents of the highest bounds that are scored for a first floor; decides how much is scored later, not what is found
TURNS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)  # odd multipliers: an entry's rows in the signature
LEVEL = 0xA0761D6478BD642F  # moves a term's hash from one level of occurrences to the next
ITEMS_PER_CHUNK = 256
CELLS = 4 << 20  # matrix cells worked on at a time
_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(b if b in _KEEP or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII; A-Z in lower case. Null has none."""
    return text.translate(_FOLD).split() if text else []


def term_hashes(found: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t) for t in found], np.uint64)


def slice_rows(entries: np.ndarray, width: int) -> list[np.ndarray]:
    """The rows of a signature of ``2^width`` rows that stand for hashed entries, one array per turn."""
    return [((entries * np.uint64(t)) >> np.uint64(64 - width)).astype(np.int64) for t in TURNS]


def at_level(hashes: np.ndarray, level: int) -> np.ndarray:
    return hashes + np.uint64(level * LEVEL % (1 << 64))


def signature(docs: list[tuple[np.ndarray, np.ndarray]], width: int) -> bytes:
    """Bit slices of documents ``(term hashes, occurrences)``: row by row one bit a document.

    A term that occurs tf times is entered at levels 0 to floor(log2(tf)).
    """
    grid = np.zeros((1 << width, len(docs)), np.uint8)
    for d, (hashes, tf) in enumerate(docs):
        for level in range(int(tf.max()).bit_length()):
            for rows in slice_rows(at_level(hashes[tf >= 1 << level], level), width):
                grid[rows, d] = 1
    return np.packbits(grid, axis=1).tobytes()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def length_norms(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], np.int64)


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Signature blocks ``(ids, keys, n, width, levels, slices, terms, dfs)`` of all documents with a term, written once.

    Documents are read in buffers and sorted into blocks by their number of entries, in powers of two, so that every block
    has as many rows as its documents need and a long text does not widen the rows of short ones. The terms of a buffer with their document
    counts stand in its first block. ``keys`` are hashes of id and text by which rows are found again. Texts are read whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"ids array<{kind}>, keys array<long>, n array<long>, width int, levels int, slices binary, terms array<binary>, dfs array<long>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, number = [], 0, count()
        vocabulary: dict[bytes, int] = {}

        def flush():
            hashes = term_hashes(list(vocabulary))
            dfs = np.zeros(len(vocabulary), np.int64)
            groups: dict[int, list] = {}
            for entry in held:
                codes, tf = entry[3], entry[4]
                dfs[codes] += 1
                entries = sum(int((tf >= 1 << level).sum()) for level in range(int(tf.max()).bit_length()))
                groups.setdefault((entries * BITS_PER_ENTRY - 1).bit_length(), []).append(entry)
            known = list(vocabulary), dfs.tolist()
            for width, rows in groups.items():
                slices = signature([(hashes[r[3]], r[4]) for r in rows], width)
                levels = max(int(r[4].max()).bit_length() for r in rows)
                yield pd.DataFrame({"ids": [[r[0] for r in rows]], "keys": [[r[1] for r in rows]], "n": [[r[2] for r in rows]], "width": [width], "levels": [levels], "slices": [slices], "terms": [known[0]], "dfs": [known[1]]})
                known = None, None

        for batch in batches:
            ids = [None if pd.isna(i) else i for i in batch["id"].astype(object)]
            for i, key, value in zip(ids, batch["key"].tolist(), batch["text"]):
                words = terms(value)
                if not words:
                    continue
                codes = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int64, len(words))
                held.append((i, key, len(words), *np.unique(codes, return_counts=True)))
                size += len(value)
                if len(held) >= BUFFER_DOCS or size >= BUFFER_BYTES:
                    yield from flush()
                    held, size = [], 0
                    vocabulary.clear()
        if held:
            yield from flush()

    return settled(_keyed(docs, id_col, text).mapInPandas(run, schema))


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text)).alias("key"), F.col(text).cast("binary").alias("text"))


class Chunk:
    """Items whose bounds are worked out together: distinct term hashes, and per item its terms and weights."""

    def __init__(self, rows: list[dict]):
        self.items = np.array([r["item"] for r in rows], np.int64)
        self.floor = [(r["least"], r["last"]) for r in rows]
        self.hashes, place = np.unique(np.concatenate([term_hashes(r["terms"]) for r in rows]), return_inverse=True)
        self.term = place.astype(np.int64)
        self.weight = np.concatenate([np.asarray(r["weights"], np.int64) for r in rows])
        self.item = np.repeat(np.arange(len(rows)), [len(r["terms"]) for r in rows])

    def bounds(self, n: np.ndarray, width: int, levels: int, slices: bytes, n_docs: int, n_terms: int) -> np.ndarray:
        """Items by documents: what a score cannot exceed.

        A term whose slices hold at levels up to l occurs at most 2^(l+1) - 1 times, and no oftener than the document has terms. Slice sums,
        weighted by the terms, are multiplied by what a level can add. False positives only raise a bound.
        """
        grid = np.frombuffer(slices, np.uint8).reshape(1 << width, -1)
        m = length_norms(n, n_docs, n_terms)
        out = np.zeros((len(self.items), len(n)), np.int64)
        alive, held = np.arange(len(self.hashes)), None
        before = np.zeros(len(n), np.int64)
        for level in range(levels):
            a, b, c = slice_rows(at_level(self.hashes[alive], level), width)
            now = grid[a] & grid[b] & grid[c]
            held = now if held is None else held & now
            some = held.any(1)
            alive, held = alive[some], held[some]
            if not len(alive):
                break
            reach = impact(np.minimum((2 << level) - 1, n), m)
            gain, before = reach - before, reach
            spot = np.full(len(self.hashes), -1)
            spot[alive] = np.arange(len(alive))
            pairs = np.flatnonzero(spot[self.term] >= 0)
            step = max(1, CELLS // len(n))
            for at in range(0, len(pairs), step):
                part = pairs[at : at + step]
                bits = np.unpackbits(held[spot[self.term[part]]], axis=1, count=len(n))
                owner, starts = np.unique(self.item[part], return_index=True)
                sums = np.add.reduceat(np.multiply(bits, self.weight[part][:, None], dtype=np.int64), starts, axis=0)
                out[owner] += sums * gain
        return out


def _chunks(asked: DataFrame, floors: DataFrame | None, chunks: int, kind: str) -> DataFrame:
    """``(chunk, payload)``: items with terms and weights, and the score (and id) that a document must reach to count."""
    if floors is None:
        floors = asked.sparkSession.createDataFrame([], f"item long, least long, last {kind}")
    met = asked.join(floors, "item", "left").select("item", "terms", "weights", F.coalesce("least", F.lit(1).cast("long")).alias("least"), "last")
    dealt = met.groupBy(F.pmod("item", F.lit(chunks)).cast("int").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("item", "terms", "weights", "least", "last"))).alias("rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            plain = lambda r: {k: list(v) if isinstance(v, np.ndarray) else v for k, v in r.items()}
            yield pd.DataFrame({"chunk": batch["chunk"], "payload": [pickle.dumps([plain(r) for r in rows]) for rows in batch["rows"]]})

    return sized(dealt.mapInPandas(run, "chunk int, payload binary"))


def _with_chunks(index: DataFrame, asked: DataFrame, chunks: int) -> DataFrame:
    blocks = index.select("ids", "keys", "n", "width", "levels", "slices", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    return blocks.join(asked, "chunk")


def _best_bounds(met: DataFrame, top: int, n_docs: int, n_terms: int) -> DataFrame:
    """``(item, key, bound)``: per task and item the documents with the highest bounds above 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple] = {}

        def out(of):
            chunk, bound, keys = of
            item = np.repeat(chunk.items, bound.shape[1])
            frame = pd.DataFrame({"item": item, "key": keys.ravel(), "bound": bound.ravel()})
            return frame[frame["bound"] > 0]

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.chunk not in best:
                    if len(best) >= 16:  # what a task remembers is bounded
                        yield out(best.pop(next(iter(best))))
                    chunk = Chunk(pickle.loads(row.payload))
                    best[row.chunk] = chunk, np.zeros((len(chunk.items), 0), np.int64), np.zeros((len(chunk.items), 0), np.int64)
                chunk, bound, keys = best[row.chunk]
                new = chunk.bounds(np.asarray(row.n, np.int64), row.width, row.levels, row.slices, n_docs, n_terms)
                bound = np.concatenate([bound, new], axis=1)
                keys = np.concatenate([keys, np.broadcast_to(np.asarray(row.keys, np.int64), new.shape)], axis=1)
                if bound.shape[1] > top:
                    keep = np.argpartition(-bound, top - 1, axis=1)[:, :top]
                    bound, keys = np.take_along_axis(bound, keep, 1), np.take_along_axis(keys, keep, 1)
                best[row.chunk] = chunk, bound, keys
        for of in best.values():
            yield out(of)

    return met.mapInPandas(run, "item long, key long, bound long")


def _not_excluded(met: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """``(item, key)`` of every document whose bound reaches the item's floor: above it, or at it with an id not beyond the last one's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, Chunk] = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.chunk not in known:
                    known.clear() if len(known) >= 16 else None
                    known[row.chunk] = Chunk(pickle.loads(row.payload))
                chunk = known[row.chunk]
                bound = chunk.bounds(np.asarray(row.n, np.int64), row.width, row.levels, row.slices, n_docs, n_terms)
                least = np.array([f[0] for f in chunk.floor], np.int64)
                item, doc = np.nonzero(bound >= least[:, None])
                tied = bound[item, doc] == least[item]
                for at in np.flatnonzero(tied):
                    last, own = chunk.floor[item[at]][1], row.ids[doc[at]]
                    tied[at] = last is not None and (own is None or pd.isna(own) or own > last)
                item, doc = item[~tied], doc[~tied]
                if len(item):
                    yield pd.DataFrame({"item": chunk.items[item], "key": np.asarray(row.keys, np.int64)[doc]})

    return met.mapInPandas(run, "item long, key long")


def _scored(docs: DataFrame, pairs: DataFrame, asked: DataFrame, chunks: int, n_docs: int, n_terms: int, kind: str) -> DataFrame:
    """``(item, id, score)``, exact and above 0, of the rows that pairs ``(item, key)`` name."""
    met = pairs.distinct().join(asked, "item").groupBy("key", F.pmod("item", F.lit(chunks)).alias("chunk"))
    wanted = settled(met.agg(F.collect_list(F.struct("item", "terms", "weights")).alias("wanted")).drop("chunk"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text, wanted in zip(batch["id"], batch["text"], batch["wanted"]):
                tf = Counter(terms(text))
                n = sum(tf.values())
                m = 10 + 90 * n * n_docs // n_terms
                for w in wanted:
                    score = sum(int(weight) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t, weight in zip(w["terms"], w["weights"]) if t in tf)
                    if score > 0:
                        out.append((w["item"], None if pd.isna(i) else i, score))
            frame = pd.DataFrame(out, columns=["item", "id", "score"])
            yield frame.astype({"item": "int64", "id": object, "score": "int64"})

    return docs.join(wanted, "key").select("id", "text", "wanted").mapInPandas(run, f"item long, id {kind}, score long")


def search(index: DataFrame, docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", first: int = FIRST) -> DataFrame:
    """``(item_id, rank, id, score)``: the ``top`` documents of each item by score, equal scores by ascending id (null ids last).

    ``index`` is ``build_index`` of the same rows. Term weights come from exact document counts of the index. Then three steps: the ``first`` documents with the highest bounds
    are scored exactly, which gives each item the score its ``top``-th document has at least; all documents whose
    bound reaches that are found; those are scored exactly and ranked. So the result is that of scoring every document, at any size.

    Items are met in chunks, each joined with the signature blocks: a stated query set against all rows. Nulls: a null text has no terms and
    is no result; an item without terms, or that no document matches, has no rows. Items that repeat id and text are one; items that share an id only are ranked apart.
    Rows that repeat an id are ranked each. No documents or no items give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = _keyed(docs, id_col, text)
    totals = index.agg(F.sum(F.size("n")).alias("docs"), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("terms")).first()
    schema = f"item_id {items.schema[item_id].dataType.simpleString()}, rank int, id {kind}, score long"
    if not totals["docs"]:
        return spark.createDataFrame([], schema)
    n_docs, n_terms = totals["docs"], totals["terms"]

    @F.pandas_udf("array<binary>")
    def distinct_terms(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(set(terms(t))) for t in texts])

    known = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text")).distinct()
    known = settled(known.select(F.xxhash64("item_id", "item_text").alias("item"), "item_id", distinct_terms(F.col("item_text").cast("binary")).alias("terms")))
    each = known.select("item", F.explode("terms").alias("term"))
    counts = index.filter("terms IS NOT NULL").select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.dfs").alias("df"))
    dfs = settled(counts.join(each.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    rated = each.join(dfs, "term").withColumn("weight", weight).filter("weight > 0")
    asked = rated.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("t"))
    asked = settled(asked.select("item", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")))
    chunks = -(-asked.count() // ITEMS_PER_CHUNK)
    if not chunks:
        return spark.createDataFrame([], schema)
    likely = _best_bounds(_with_chunks(index, _chunks(asked, None, chunks, kind), chunks), max(top, first), n_docs, n_terms)
    likely = top_per_group(likely, ["item"], [F.col("bound").desc(), "key"], max(top, first)).select("item", "key")
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    scored = top_per_group(_scored(keyed, settled(likely), asked, chunks, n_docs, n_terms, kind), ["item"], order, top)
    floors = settled(scored.filter(F.col("rank") == top).select("item", F.col("score").alias("least"), F.col("id").alias("last")))
    open_pairs = settled(_not_excluded(_with_chunks(index, _chunks(asked, floors, chunks, kind), chunks), n_docs, n_terms))
    ranked = settled(top_per_group(_scored(keyed, open_pairs, asked, chunks, n_docs, n_terms, kind), ["item"], order, top))
    out = settled(ranked.join(known.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "id", "score"))
    released(known, dfs, asked, floors, open_pairs, ranked)
    return out


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Index and search in one call; the index is deleted afterwards. See ``search``."""
    index = build_index(docs, id_col, text)
    out = search(index, docs, items, top, id_col, text, item_id, item_text)
    released(index)
    return out
