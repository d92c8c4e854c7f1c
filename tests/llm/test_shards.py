"""Sharding against a plain version: even counts, the mixture in every shard, odd rows."""

import zlib
from collections import Counter, defaultdict
from hashlib import md5

from tutorgauge.llm import queries, shards
from tutorgauge.session import new_folder


def plain_shards(rows, n_shards, seed=42):
    """{shard, slot: (id, text, source)} of (id, text, source) rows, all at once."""
    digest = lambda s: md5(s.encode()).hexdigest()
    sources = defaultdict(list)
    for i, text, source in rows:
        name = "0" if source is None else "1" + source
        sources[name].append((digest(f"{seed}|{'' if i is None else i}|{digest(text or '')}"), (i, text, source)))
    placed = []
    for name, own in sources.items():
        u = int(digest(f"{seed}|offset|{name}")[:8], 16) / 2**32
        placed += [((r + 1 - u) / len(own), name, r, row) for r, (_, row) in enumerate(sorted(own, key=lambda x: x[0]))]
    out = {}
    for p, (*_, row) in enumerate(sorted(placed, key=lambda x: x[:3])):
        shard = p * n_shards // len(rows)
        out[shard, p - -(-shard * len(rows) // n_shards)] = row
    return out


def test_against_plain_version(spark):
    rows = [(i, f"t{i % 50}" * (i % 7), "hot" if i % 3 else f"s{i % 40}") for i in range(900)]
    rows += [(7, "copy", "hot")] * 400 + [(None, None, None)] * 30 + [(None, "x", None), (1, "", "a"), (2, "long " * 20_000, "b")]
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, source string, shard int, _shard_row string")
    out = shards.sharded(df, shards=10)
    assert sorted(out.columns) == sorted(df.columns + ["slot"])
    got = {(r.shard, r.slot): (r.doc_id, r.text, r.source) for r in out.collect()}
    assert got == plain_shards(rows, 10)
    per_shard = Counter(s for s, _ in got)
    assert max(per_shard.values()) - min(per_shard.values()) <= 1
    share = Counter(r[2] for r in rows)
    for shard in range(10):
        here = Counter(row[2] for (s, _), row in got.items() if s == shard)
        assert all(abs(here[s] - n / 10) <= 2 + 2 * len(share) * n / len(rows) for s, n in share.items())


def test_fewer_rows_than_shards_and_none(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", None)], "doc_id long, text string, source string")
    got = [(r.shard, r.slot) for r in shards.sharded(df).collect()]
    assert len(set(got)) == 3 and {s for _, s in got} == {0} and all(0 <= s < 24 for s, _ in got)
    assert shards.sharded(df.limit(0)).count() == 0


def test_files(spark):
    df = spark.range(1000).selectExpr("id doc_id", "concat('text ', id) text", "if(id % 3 = 0, 'a', 'b') source")
    path = new_folder(spark, "test")
    shards.write_shards(df, path, shards=4)
    back = spark.read.parquet(path)
    assert sorted((r.shard, r.slot) for r in back.collect()) == [(s, k) for s in range(4) for k in range(250)]
    one = spark.read.parquet(f"{path}/shard=2")
    assert [r.slot for r in one.collect()] == list(range(250))


def test_query_columns(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.QUERIES["op13_sharding"](spark, folder).collect()
    assert len(got) == len(texts)
    assert all(r.size == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.law == "rows" and r.grown_shard is None for r in got)
