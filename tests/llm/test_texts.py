"""Token counts, fingerprints, quality rules and classifier against brute force and held-out data."""

import hashlib
import random
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

from tutorgauge.llm import digests, quality_rules, token_counts, weak_labels
from tutorgauge.llm.queries import TOKENIZER
from tutorgauge.llm.tokens import WordEncoder

ODD = " \n\t\r'aésT1²½!-.’ªº×÷ \xad日\x85"


def odd_texts(n=3000):
    draw = random.Random(2)
    return ["".join(draw.choices(ODD, k=draw.randint(0, 30))) for _ in range(n)] + ["It's we'll\n\n\nso.  Two  spaces ", "<|endoftext|> x"]


@pytest.mark.parametrize("spans", [False, True])
def test_encoder_equals_tokenizer(spans):
    plain = Tokenizer.from_file(TOKENIZER)
    plain.encode_special_tokens = True
    encoder = WordEncoder(TOKENIZER, spans)
    for text in odd_texts():
        want = plain.encode(text, add_special_tokens=False)
        got = encoder.offsets(text).tolist() if spans else np.frombuffer(encoder.ids(text), "<u4").tolist()
        assert got == ([list(o) for o in want.offsets] if spans else want.ids), text


def plain_attribution(tokens, sections, rule):
    gets = [0.0] * len(sections)
    crossing = [0] * len(sections)
    for a, b in tokens:
        b = max(b, a + 1)
        shared = {i: min(b, e) - max(a, s) for i, (s, e) in enumerate(sections) if min(b, e) > max(a, s)}
        for i, n in shared.items():
            crossing[i] += n < b - a
            if rule == "proportional":
                gets[i] += n / sum(shared.values())
        if shared and rule != "proportional":
            gets[min(shared, key=lambda i: (-shared[i] if rule == "majority" else 0, i))] += 1
    return gets, crossing


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution(rule):
    draw = random.Random(4)
    for _ in range(300):
        cuts = sorted(draw.sample(range(60), 8))
        sections = list(zip(cuts[::2], cuts[1::2])) if draw.random() < 0.5 else list(zip(cuts, cuts[1:]))
        at, tokens = 0, []
        while at < 60:
            end = at + draw.choice([0, 1, 2, 5, 20])
            tokens.append((at, end))
            at = end if draw.random() < 0.9 else end + 1
        gets, crossing = token_counts.attribute(np.array(tokens), *(np.array(x) for x in zip(*sections)), rule)
        want = plain_attribution(tokens, sections, rule)
        assert np.allclose(gets, want[0]) and crossing.tolist() == want[1]


def test_section_tokens(spark):
    plain = Tokenizer.from_file(TOKENIZER)
    texts = [(1, "one two\nthree\n\n\nfour's"), (2, ""), (3, None), (4, "é日本 " * 50), (4, "again")]
    df = spark.createDataFrame([(*r, "q") for r in texts], "doc_id long, text string, section string")
    for sections in (token_counts.line_sections("text"), token_counts.passage_sections("text", 7)):
        got = token_counts.section_tokens(df, TOKENIZER, sections).collect()
        assert sum(r.n_tokens for r in got) == sum(len(plain.encode(t or "").ids) for _, t in texts)
        assert {(r.id, r.section, r.start, r.end) for r in got if r.id in (2, 3)} == {(2, 0, 0, 0), (3, 0, 0, 0)}
    fields = df.withColumn("all", token_counts.joined_fields("section", "text")).withColumn("at", token_counts.field_sections("section", "text"))
    rows = token_counts.section_tokens(fields, TOKENIZER, "at", text="all").filter("id = 1").collect()
    assert [(r.start, r.end) for r in rows] == [(0, 2), (2, 24)]
    assert token_counts.section_tokens(df.limit(0), TOKENIZER, token_counts.line_sections("text")).count() == 0


def test_fingerprints(spark):
    draw = random.Random(9)
    texts = [None, "", "a", "abc", "é" * 9, *(" ".join("".join(draw.choices("abcdefgé", k=5)) for _ in range(draw.randint(3, 400))) for _ in range(60))]
    rows = [(i * 7 % 997, t) for i, t in enumerate(texts)] + [(500, "same")] * 3
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id int, text string, id string")
    got = digests.beside_next(df, rows_per_range=5).collect()
    order = sorted(rows, key=lambda r: r[0])
    assert len(got) == len(rows)
    by_id = {r.id: r for r in got}
    for (i, own), (_, after) in zip(order, [*order[1:], order[0]]):
        own, after = own or "", after or ""
        if i == 500 and after == "same":
            continue
        q = len(own) // 4
        edited = own[: len(own) - q] + after[:q]
        r = [x for x in got if x.id == i and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()]
        assert r and r[0].n_chars == len(own)
        assert r[0].near_edited == digests.likeness(digests.digest(own.encode()), digests.digest(edited.encode()))
        assert r[0].near_next == digests.likeness(r[0].fingerprint, digests.digest(after.encode()))
    long = [r for r in got if r.n_chars > 300]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.95
    assert by_id[0].fingerprint == "00" * 65
    assert digests.beside_next(df.limit(0)).count() == 0
    one = digests.beside_next(spark.createDataFrame([(None, "abcdefgh")], "doc_id long, text string")).first()
    assert one.id is None and one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_long_text_counts_in_steps(monkeypatch):
    data = bytes(random.Random(1).choices(range(256), k=5000))
    whole = digests.bucket_counts(data)
    monkeypatch.setattr(digests, "_STEP", 64)
    assert (digests.bucket_counts(data) == whole).all() and whole.sum() == sum(len(data) - b for _, b in digests.GAPS)


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_word_statistics():
    draw = random.Random(6)
    for _ in range(200):
        text = "".join(draw.choices(["a ", "b ", "é ", "#", "\n", "|x ", "\t", "a b c "], k=draw.randint(0, 60)))
        assert quality_rules.word_statistics(text.encode()) == plain_statistics(text), text


def plain_mcd(x, share, steps, floors):
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="lower")
    centre, cov = q[1], np.diag(np.maximum((q[2] - q[0]) / 1.349, floors) ** 2)
    for _ in range(steps):
        off = x - centre
        d = np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off)
        near = x[d <= np.sort(d)[int(np.ceil(share * len(x))) - 1]]
        centre, cov = near.mean(0), np.cov(near.T, bias=True) * quality_rules.consistency(share, x.shape[1])
        cov = cov + np.diag(np.maximum(floors**2 - np.diag(cov), 0))
    return centre, cov


def test_robust_model_follows_the_plain_one(spark):
    draw = np.random.default_rng(0)
    x = draw.normal(size=(400, 4)) @ np.array([[1.5, 0.4, 0, 0], [0, 2, 0, 0.5], [0, 0, 1.2, 0], [0, 0, 0, 2]])
    x[:60] += 25  # outliers that would drag a plain mean
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "key string, x0 double, x1 double, x2 double, x3 double")
    got = quality_rules.robust_model(rows).first()
    centre, cov = plain_mcd(x, quality_rules.SUBSET, quality_rules.STEPS, np.array(quality_rules.FLOORS))
    assert np.allclose(got.centre, centre, atol=0.05) and np.allclose(np.linalg.inv(np.array(got.inverse).reshape(4, 4)), cov, atol=0.3)
    assert np.abs(centre).max() < 0.5


def test_quality_rules(spark):
    draw = random.Random(8)
    clean = lambda n: " ".join("".join(draw.choices("abcdefgh", k=draw.randint(3, 8))) for _ in range(n))
    rows = [(i, clean(draw.randint(60, 300)), draw.choice(["en", None]), draw.choice(["s0", "s0", None])) for i in range(400)]
    bad = [(1000, clean(100).replace(" ", " ### "), "en", "s0"), (1001, clean(100).replace(" ", "|"), "en", "s0"), (1002, "x " * 200, "en", "s0"), (1003, None, None, None), (1004, "", "en", "s9"), (1005, clean(49), "en", "s0")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows + bad + bad[:1]], "doc_id long, text string, lang string, source string, n long, key string")
    got = {r.id: r for r in quality_rules.quality_table(df).collect()}
    assert all(got[i].kept for i in range(400)) and not any(got[i].kept for i in range(1000, 1006))
    assert [got[i].base_failed for i in range(1000, 1006)] == [False, True, True, True, True, True]
    kept = quality_rules.keep_quality(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == list(range(400))
    assert quality_rules.quality_table(df.limit(0)).count() == 0


def test_a_third_of_bad_rows_is_rejected(spark):
    draw = random.Random(3)
    words = lambda n: ["".join(draw.choices("abcdefghijkl", k=draw.randint(3, 8))) for _ in range(n)]
    symbols, half = words(120), words(60)
    bad = {
        "copies": lambda: " ### ".join(symbols),
        "near": lambda: " ### ".join(symbols[:-1] + words(1)),
        "repeats": lambda: " ".join(half + words(3) + half[:26] + words(3) + half[:26][::-1] + words(60)),
    }
    rows = []
    for source, text in bad.items():
        rows += [(len(rows) + i, " ".join(words(draw.randint(60, 300))), "en", source) for i in range(200)]
        rows += [(-len(rows) - i, text(), "en", source) for i in range(100)]
    got = quality_rules.quality_table(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert not any(r.base_failed for r in got)
    assert all(r.kept == (r.id >= 0) for r in got), [(r.id, r.distance) for r in got if r.kept != (r.id >= 0)][:5]


def test_label_model_finds_accuracies():
    draw = np.random.default_rng(3)
    k = len(weak_labels.LABELLERS)
    truth = draw.random(20_000) < 0.8
    right = np.linspace(0.7, 0.95, k)
    says = np.where(draw.random((20_000, k)) < right, truth[:, None], ~truth[:, None])
    digits = np.where(draw.random((20_000, k)) < 0.2, weak_labels.NONE, np.where(says, weak_labels.GOOD, weak_labels.BAD))
    codes, where, counts = np.unique(digits @ 3 ** np.arange(k)[::-1], return_inverse=True, return_counts=True)
    good, rates, share = weak_labels.label_model(codes, counts.astype(float))
    assert abs(share - 0.8) < 0.02 and ((good[where] > 0.5) == truth).mean() > 0.97
    assert np.allclose(rates[1], right, atol=0.05)


def test_classifier_on_labelled_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "x")], "doc_id long, text string")
    got = {r.id: r for r in weak_labels.classified(docs.select("doc_id", "text").union(odd)).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    hits = [got[r.doc_id].kept == (r.quality == 1) for r in labels]
    assert np.mean(hits) > 0.97 and len(got) == 1003
    assert weak_labels.classified(odd.limit(0)).count() == 0


def test_classifier_draws_copies_once(spark, monkeypatch):
    seen = []
    fit = weak_labels.fitted
    monkeypatch.setattr(weak_labels, "fitted", lambda sample, *a: seen.append(len(sample)) or fit(sample, *a))
    texts = [(i, "the same text again" if i < 300 else f"text number {i} of many") for i in range(400)]
    rows = weak_labels.classified(spark.createDataFrame(texts, "doc_id long, text string"), training_rows=10_000).collect()
    assert len(rows) == 400 and len({r.score for r in rows if r.id < 300}) == 1
    assert seen == [101]
