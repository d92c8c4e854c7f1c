"""Ranked search against scoring every document, bounds against exact scores."""

import math
import random
import re
from collections import Counter

import numpy as np

from tutorgauge.llm import ranked_search as rs
from tutorgauge.operators.joins import released

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def plain_ranks(docs, items, top=10):
    tfs = [(i, Counter(plain_terms(t))) for i, t in docs]
    tfs = [(i, tf) for i, tf in tfs if tf]
    n_docs, n_terms = len(tfs), sum(sum(tf.values()) for _, tf in tfs)
    df = Counter(t for _, tf in tfs for t in tf)
    out = []
    for item_id, text in sorted(set(items), key=str):
        found = []
        for i, tf in tfs:
            m = 10 + 90 * sum(tf.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2.0 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(plain_terms(text)) if t in tf)
            if score > 0:
                found.append((-score, i is None, i, i))
        out += [(item_id, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3] if not x[1] else (x[0], True, 0))[:top], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.item_id, r["rank"], r.id, r.score) for r in df.collect()), key=str)


def corpus(draw, n):
    words = [f"w{i}" for i in range(60)] + ["été", "Straße", "naïve", "İx", "東京", "a1B2"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ".join(draw.choices(words, weights, k=draw.choice([1, 5, 40, 300]))) + draw.choice([".", "\n", "-z", "", " Ω"])) for i in range(n)]


def test_against_scoring_every_document(spark, monkeypatch):
    monkeypatch.setattr(rs, "BUFFER_DOCS", 64)
    monkeypatch.setattr(rs, "ITEMS_PER_CHUNK", 4)
    draw = random.Random(4)
    docs = corpus(draw, 400)
    docs += [(1000 + i, docs[7][1]) for i in range(200)] + [docs[9]] * 3 + [(None, docs[7][1]), (5, "w1 w2"), (6, None), (7, ""), (8, "-- ..")]
    docs += [(9, "x" * 50_000 + " w3"), (10, " ".join(f"u{i} w{i % 9}" for i in range(20_000)))]
    items = [(i, (draw.choice(docs)[1] or "")[:300]) for i in range(12)]
    items += [(50, "u17 nothing"), (51, "absent words"), (52, None), (53, ""), items[0], (items[1][0], "w5 w6"), (None, "W7, w8"), (54, docs[7][1])]
    left = spark.createDataFrame([(*d, "k", 1) for d in docs], "doc_id long, text string, key string, item long").repartition(5)
    right = spark.createDataFrame([(*d, 2) for d in items], "item_id long, text string, rank int")
    want = plain_ranks(docs, items)
    assert got(rs.ranked(left, right)) == want and len(want) > 100
    assert got(rs.ranked(left, right, top=1)) == plain_ranks(docs, items, 1)


def test_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (2, None)], "item_id long, text string")
    one = rs.ranked(docs, items).collect()
    assert [(r.item_id, r["rank"], r.id) for r in one] == [(1, 1, 1)]
    for left, right in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("text IS NULL"), items), (docs, items.filter("text IS NULL"))):
        assert rs.ranked(left, right).count() == 0


def test_an_index_answers_several_searches(spark):
    docs = spark.createDataFrame(corpus(random.Random(1), 100), "doc_id long, text string")
    index = rs.build_index(docs)
    for text in ("w1 w9", "w2 東京"):
        items = spark.createDataFrame([(1, text)], "item_id long, text string")
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert got(rs.search(index, docs, items)) == plain_ranks(rows, [(1, text)])
    released(index)


def test_bounds_never_fall_below_scores_and_are_close():
    draw = random.Random(8)
    docs = [plain_terms(t) for _, t in corpus(draw, 200)]
    names = sorted({t for d in docs for t in d})
    hashes = rs.term_hashes([t.encode() for t in names])
    counts = [np.unique([names.index(t) for t in d], return_counts=True) for d in docs]
    width = 11
    slices = rs.signature([(hashes[c], tf) for c, tf in counts], width)
    levels = max(int(tf.max()).bit_length() for _, tf in counts)
    rows = [{"item": i, "terms": [t.encode() for t in draw.sample(names, 12)], "weights": [draw.randint(1, 5000) for _ in range(12)], "least": 1, "last": None} for i in range(20)]
    n = np.array([len(d) for d in docs])
    bound = rs.Chunk(rows).bounds(n, width, levels, slices, len(docs), int(n.sum()))
    m = rs.length_norms(n, len(docs), int(n.sum()))
    exact = np.array([[sum(w * (10**9 * d.count(t.decode()) // (1000 * d.count(t.decode()) + 8 * int(m[j]))) for t, w in zip(r["terms"], r["weights"]) if t.decode() in d) for j, d in enumerate(docs)] for r in rows])
    assert (bound >= exact).all()
    few = n <= 40
    assert (bound[:, few] <= 2.2 * exact[:, few]).mean() > 0.9
