"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, connected groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorgauge.llm.components import components
from tutorgauge.operators.joins import settled

SHINGLE_WORDS = 3
MAX_BITS = 2
HOT_BLOCK = 256  # members of a block beyond which it is cut by further bits
_ALL = (1 << 64) - 1


def simhash(words: list[bytes], size: int) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included; 0 without words.

    A bit is set if more than half of the shingle hashes have it. Fewer words than a shingle count as one.
    """
    if not words:
        return 0
    size = min(size, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], 42) for s, e in zip(starts, ends[size - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | Column, size: int = SHINGLE_WORDS) -> Column:
    """SimHash of a text column as a signed long: A-Z in lower case, words between ASCII white space, null as empty."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = [simhash(t.lower().split(), size) if t is not None else 0 for t in texts]
            yield pd.Series(np.array(values, dtype=np.uint64).astype(np.int64))

    return of((F.col(text) if isinstance(text, str) else text).cast("binary"))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cut_mask(mask: int, parts: int) -> list[int]:
    """The set bits of a mask dealt to at most ``parts`` masks of neighbouring bits."""
    places = [i for i in range(64) if mask >> i & 1]
    cuts = [len(places) * i // parts for i in range(parts + 1)]
    return [sum(1 << i for i in places[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def near_fingerprints(table: DataFrame, node: str = "node", fp: str = "fp", bits: int = MAX_BITS, parts: int | None = None, hot: int = HOT_BLOCK) -> DataFrame:
    """Pairs ``(a, b)`` of nodes whose fingerprints differ in 1 to ``bits`` bits; fingerprints must be distinct.

    Pigeonhole: of ``parts`` pieces of the bits (``bits + 1`` unless given) a close pair shares at least
    ``parts - bits``, so rows are joined on every choice of that many pieces, then the Hamming distance
    is checked. A block with more than ``hot`` members is cut again by the same rule applied to the
    bits it does not fix yet, down to blocks whose free bits bound their size. No pair is lost, and a large
    group of similar texts is not paired out on one block.
    """
    parts = parts or bits + 1
    choices = [sum(c) for c in combinations(cut_mask(_ALL, parts), parts - bits)]
    paths = dict(enumerate(choices))
    base = table.select(F.col(node).alias("node"), F.col(fp).alias("fp")).filter("node IS NOT NULL AND fp IS NOT NULL")
    key = lambda p, used: F.struct(F.lit(p).alias("path"), F.col("fp").bitwiseAND(F.lit(signed(used))).alias("value"))
    spread = lambda df, keys: df.select("node", "fp", F.explode(keys).alias("k")).select("node", "fp", "k.path", "k.value")
    rows = spread(settled(base), F.array(*[key(p, u) for p, u in paths.items()]))
    found = None
    while True:
        crowded = settled(rows.groupBy("path", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot))
        paths = {r.path: paths[r.path] for r in crowded.select("path").distinct().collect()}  # at most one row a path
        fine = [u for u in paths.values() if bin(u).count("1") > 64 - 2 * bits - 2]
        here = rows if not paths else rows.join(crowded.select("path", "value"), ["path", "value"], "left_anti")
        if fine or not paths:
            here, paths = rows, {}
        right = here.select("path", "value", F.col("node").alias("b"), F.col("fp").alias("fp_b"))
        pairs = (
            here.withColumnsRenamed({"node": "a", "fp": "fp_a"})
            .join(right, ["path", "value"])
            .filter((F.col("fp_a") < F.col("fp_b")) & (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= bits))
            .select("a", "b")
        )
        found = pairs if found is None else found.union(pairs)
        if not paths:
            return found.distinct()
        # the bits a block leaves free still hold all differing bits: cut those again
        deeper, choose = {}, {}
        for p, used in paths.items():
            subs = cut_mask(_ALL & ~used, bits + 1)
            numbers = range(len(deeper), len(deeper) + len(subs))
            deeper.update({i: used | s for i, s in zip(numbers, subs)})
            choose[p] = list(numbers)
        again = F.array().cast("array<struct<path:int,value:bigint>>")
        for p, numbers in choose.items():
            again = F.when(F.col("path") == p, F.array(*[key(i, deeper[i]) for i in numbers])).otherwise(again)
        busy = rows.join(crowded.select("path", "value"), ["path", "value"], "left_semi")
        rows = settled(spread(busy, again))
        paths = deeper


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, bits: int = MAX_BITS) -> DataFrame:
    """Per row ``(id, fp, component)``: its fingerprint and the least id its links reach, its own included.

    Equal fingerprints are one node of the graph, so a group of exact copies costs one row however large it
    is. A null text counts as empty; a row with a null id has a fingerprint, belongs to no group and gets a
    null component. Repeated ids share a component only if their fingerprints link. Other columns are not read.
    """
    prints = settled(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text), size).alias("fp")))
    nodes = settled(prints.filter("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("first")))
    # a repeated id can be first of several fingerprints: number the graph by fingerprint, then take the least id
    links = near_fingerprints(nodes, "fp", "fp", bits)
    group = settled(components(links))
    placed = nodes.join(group, nodes.fp == group.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    placed = settled(placed)
    least = settled(placed.groupBy("root").agg(F.min("first").alias("component")))
    named = settled(placed.join(least, "root").select(F.col("fp").alias("fp_named"), "component"))
    out = prints.join(named, prints.fp == named.fp_named, "left")
    return out.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the least id stays, all columns as they were.

    Rows that repeat the kept id are reduced to one, the least by all its columns. Rows with a null id stay.
    """
    groups = near_duplicates(docs, id_col, text, size, bits)
    keep = settled(groups.filter("id = component").groupBy(F.col("id").alias("_simhash_kept")).agg(F.count(F.lit(1)).alias("_simhash_rows")))
    at = lambda ids: docs.join(ids.select("_simhash_kept").hint("shuffle_hash"), docs[id_col] == F.col("_simhash_kept"), "left_semi")
    out = at(keep.filter("_simhash_rows = 1"))
    repeated = keep.filter("_simhash_rows > 1")
    if not repeated.isEmpty():
        once = at(repeated).groupBy(F.col(id_col).alias("_id")).agg(F.min(F.struct(*docs.columns)).alias("_row"))
        out = out.union(once.select("_row.*"))
    nameless = docs.filter(F.col(id_col).isNull())
    return out.union(nameless)
