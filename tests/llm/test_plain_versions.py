"""Digests, label model, scorer, trees and decoding against plain versions that share no code with them."""

import math
import random
from itertools import product

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tutorgauge.llm import digests, html_text, weak_labels


# --- fingerprints ---


def plain_digest(data):
    counts = [0] * 256
    for kind, (i, j) in enumerate(((1, 2), (2, 5), (3, 9))):
        for at in range(len(data) - j):
            x = (data[at] * 2654435761 + data[at + i] * 2246822519 + data[at + j] * 3266489917 + kind) % 2**32
            x ^= x >> 15
            counts[(x * 2654435761) % 2**32 >> 24] += 1
    order = sorted(counts)
    cuts = [order[math.floor(q * 255)] for q in (0.25, 0.5, 0.75)]
    quarters = [sum(c > cut for cut in cuts) for c in counts]
    length = min(255, round(8 * math.log2(1 + len(data)))) if data else 0
    codes = [quarters[k] << 6 | quarters[k + 1] << 4 | quarters[k + 2] << 2 | quarters[k + 3] for k in range(0, 256, 4)]
    return "".join(f"{x:02x}" for x in [length, *codes]), length, quarters


def plain_likeness(a, b):
    (one, la, qa), (two, lb, qb) = plain_digest(a), plain_digest(b)
    if one == two:
        return 1.0
    steps = sum((x - y) ** 2 for x, y in zip(qa, qb)) / 256 / 2.5
    return 1 - min(1.0, 0.9 * min(1.0, steps) + 0.1 * min(1.0, abs(la - lb) / 16))


def test_digests():
    draw = random.Random(5)
    texts = [b"", b"a", b"abc", "é".encode() * 7, b"x" * 3000] + [bytes(draw.choices(range(32, 127), k=draw.choice([8, 9, 10, 50, 700, 5000]))) for _ in range(25)]
    texts += [t[: len(t) * 3 // 4] + bytes(draw.choices(range(97, 123), k=len(t) // 4)) for t in texts]
    for t in texts:
        assert digests.digest(t) == plain_digest(t)[0]
    for a, b in zip(texts, texts[1:] + texts[:1]):
        assert digests.likeness(digests.digest(a), digests.digest(b)) == pytest.approx(plain_likeness(a, b))


def test_followers_in_a_bounded_number_of_ranges(spark, monkeypatch):
    monkeypatch.setattr(digests, "MOST_RANGES", 4)
    rows = [(i * 7 % 501, f"text {i} " * (i % 9)) for i in range(501)] + [(3, "again"), (None, "n"), (600, None), (601, "long " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.id: r for r in digests.beside_next(df, rows_per_range=5).filter("id <> 3").collect()}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    texts = {i: (t or "") for i, t in order}
    ids = [None, *sorted(texts)]
    follow = dict(zip(ids, ids[1:] + ids[:1]))
    assert len(got) == len(texts) - 1
    for i in (0, 4, 99, 250, 500, 600, 601):
        other = texts[follow[i]] if follow[i] is not None else "n"
        assert got[i].near_next == pytest.approx(plain_likeness(texts[i].encode(), other.encode())) and got[i].n_chars == len(texts[i])


# --- label model and scorer ---


def plain_label_model(codes, counts, n):
    """Two classes by expectation-maximisation, one pattern and one labeller at a time."""
    votes = [[c // 3 ** (n - 1 - k) % 3 for k in range(n)] for c in codes]
    good = [0.1 if weak_labels.BAD in v else 0.95 for v in votes]
    for _ in range(200):
        rates = []
        for side in (0, 1):
            weight = [m * (g if side else 1 - g) for m, g in zip(counts, good)]
            yes = [1 + sum(w for w, v in zip(weight, votes) if v[k] == weak_labels.GOOD) for k in range(n)]
            no = [1 + sum(w for w, v in zip(weight, votes) if v[k] == weak_labels.BAD) for k in range(n)]
            rates.append([y / (y + x) for y, x in zip(yes, no)])
        share = (sum(m * g for m, g in zip(counts, good)) + 1) / (sum(counts) + 2)
        before, good = good, []
        for v in votes:
            odds = [math.prod(r[k] if v[k] == weak_labels.GOOD else 1 - r[k] if v[k] == weak_labels.BAD else 1.0 for k in range(n)) for r in rates]
            a, b = odds[0] * (1 - share), odds[1] * share
            good.append(b / (a + b))
        if max(abs(x - y) for x, y in zip(before, good)) < 1e-9:
            break
    return good, share


def test_label_model():
    draw = random.Random(2)
    n = len(weak_labels.LABELLERS)
    codes = sorted({sum(draw.choice([0, 1, 2, 0]) * 3**k for k in range(n)) for _ in range(60)})
    counts = [draw.randint(1, 500) for _ in codes]
    good, _, share = weak_labels.label_model(np.array(codes), np.array(counts, float))
    want, want_share = plain_label_model(codes, counts, n)
    assert good == pytest.approx(want, abs=1e-6) and share == pytest.approx(want_share, abs=1e-6)


def test_scorer_is_the_model_it_was_trained_as():
    draw = np.random.default_rng(1)
    weights = draw.normal(size=weak_labels.WIDTH)
    scorer = weak_labels.Scorer(weights, 0.3)
    for text in (b"", b"one", b"one one two", b"A b C. 12 --- x" * 30, b"w" * 5000 + b" y", "été été".encode()):
        places, values = weak_labels._vector(text)
        z = 0.3 + sum(weights[p] * v for p, v in zip(places.tolist(), values.tolist()))
        assert scorer.score(text) == pytest.approx(1 / (1 + math.exp(-z)))
    assert all(len(w) <= weak_labels.LONGEST_KNOWN for w in scorer.known)


def test_whole_classifier(spark):
    draw = random.Random(9)
    prose = lambda: " ".join("".join(draw.choices("abcdeilmnorst", k=draw.randint(2, 9))) for _ in range(draw.randint(40, 200))).capitalize() + "."
    texts = [prose() for _ in range(60)] + [("BUY NOW!!! " * draw.randint(5, 60)) for _ in range(30)] + ["", None, "x" * 30_000] + [prose()] * 5
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    got = {r.id: r for r in weak_labels.classified(df, training_rows=10_000).collect()}
    data = [(t or "").encode() for t in texts]
    codes = [weak_labels.votes(d) for d in data]
    patterns = sorted(set(codes))
    good, _ = plain_label_model(patterns, [codes.count(p) for p in patterns], len(weak_labels.LABELLERS))
    posterior = dict(zip(patterns, good))
    hashed = df.select(F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("h"), "doc_id").collect()
    order = sorted({r.h: r.doc_id for r in hashed}.items())
    weights, intercept = weak_labels.fitted([(*weak_labels._vector(data[i]), posterior[codes[i]]) for _, i in order])
    for i, d in enumerate(data):
        places, values = weak_labels._vector(d)
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-(intercept + weights[places] @ values))), abs=1e-4)
        assert got[i].kept == (got[i].score >= weak_labels.THRESHOLD)


def test_few_texts_with_very_many_copies(spark):
    good = (
        "The harbour was quiet in the morning, and the boats came back with fish for the market. Most people of the town had known it for years, but they still "
        "went to see what was there. A woman bought two herrings and asked how far the men had sailed. They told her that the wind had turned at night, so that "
        "nobody could use the nets near the island. It would be better on Friday, they thought, when the weather was expected to change."
    )
    df = spark.range(4000).selectExpr("id doc_id", f"if(id % 2 = 0, '{good}', repeat('WIN $$$ click!!! ', 40)) text")
    got = weak_labels.classified(df, training_rows=2)
    kept = {(r.parity, r.kept): r.n for r in got.groupBy(F.pmod("id", F.lit(2)).alias("parity"), "kept").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kept == {(0, True): 2000, (1, False): 2000}


# --- trees and decoding ---


def test_flattened_trees_are_sparks(spark):
    draw = random.Random(3)
    rows = [([draw.random(), draw.randint(0, 4) * 1.0, draw.gauss(0, 1)],) for _ in range(400)]
    rows = [(x, float((x[0] > 0.4) ^ (x[1] > 2) if draw.random() < 0.9 else draw.random() < 0.5)) for (x,) in rows]
    df = spark.createDataFrame(rows, "x array<double>, label double").withColumn("features", array_to_vector("x"))
    model = GBTClassifier(maxIter=5, maxDepth=3, stepSize=0.3, seed=1).fit(df)
    out = model.transform(df).select("x", vector_to_array("probability")[1].alias("p")).collect()
    mine = html_text.probability(html_text.flattened(model), np.array([r.x for r in out]))
    assert mine == pytest.approx([r.p for r in out], abs=1e-9)


def best_verdicts(parent, p):
    """Every set of verdicts in which what is kept stands only in what is kept."""
    best = None
    for rest in product([False, True], repeat=len(p) - 1):
        kept = (True, *rest)
        if all(kept[parent[i]] for i in range(1, len(p)) if kept[i]):
            value = sum(math.log(q if k else 1 - q) for k, q in list(zip(kept, p))[1:])
            if best is None or value > best[0]:
                best = value, kept
    return list(best[1])


def test_decoding_against_every_choice():
    draw = random.Random(7)
    for _ in range(60):
        depth, source = 0, ""
        for _ in range(draw.randint(1, 9)):
            while depth and draw.random() < 0.45:
                source, depth = source + "</div>", depth - 1
            source, depth = source + f"<div class='c{depth}'>t", depth + 1
        page = html_text.Page(source)
        forest = html_text.Forest([page])
        p = [0.5] + [draw.uniform(0.02, 0.98) for _ in range(len(page.group) - 1)]
        assert forest.decode(np.array(p)).tolist() == best_verdicts(page.parent, p)


def test_deep_pages_are_read_in_linear_time():
    import time

    took = []
    for depth in (20_000, 80_000):
        start = time.perf_counter()
        for source in ("<div>" * depth, "<td><p>" + "<b>" * depth + "x" + "<div>y" * 1000, "<a>" * depth + "z" + "</a>" * depth):
            html_text.Page(source)
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0] + 1
