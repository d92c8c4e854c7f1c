"""SimHash near-duplicates, components and fuzzy lines against brute force."""

import math
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tutorgauge.llm import line_dedup, simhash
from tutorgauge.llm.components import components
from tutorgauge.operators.joins import settled

SCHEMA = "doc_id long, text string, fp string, node long"


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def corpus():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(draw.choices(words, k=draw.randint(60, 200))) for _ in range(12)]
    texts = []
    for b in base:
        texts += [b, b]
        for _ in range(3):
            w = b.split()
            w[draw.randrange(len(w))] = draw.choice(words)
            texts.append("  ".join(w).upper())
    return [*texts, None, "", " \t\n", "one", "one two", "ONE\ttwo", "É two x", "é two x"]


def test_simhash_groups(spark):
    texts = corpus()
    rows = [(i * 3, t, "x", 7) for i, t in enumerate(texts)] + [(0, texts[0], "y", 8), (None, texts[1], "z", 9)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    prints = {r[0]: plain_simhash(r[1]) for r in rows if r[0] is not None}
    assert {(r.id, r.fp & (1 << 64) - 1) for r in got if r.id is not None} == set(prints.items())
    links = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2]
    want = roots(prints, links)
    assert {(r.id, r.component) for r in got if r.id is not None} == set(want.items())
    assert len(got) == len(rows) and [r.component for r in got if r.id is None] == [None]
    kept = simhash.one_per_group(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp", "node"]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))


def test_hot_blocks_lose_no_pair(spark):
    draw = random.Random(3)
    values = {0, 1 << 63, (1 << 64) - 1}
    while len(values) < 400:  # a dense cloud: every block is hot
        x = draw.choice(sorted(values)[:40])
        for _ in range(draw.randint(1, 3)):
            x ^= 1 << draw.randrange(64)
        values.add(x)
    signed = [simhash.signed(v) for v in values]
    table = spark.createDataFrame([(s, s) for s in signed], "node long, fp long")
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    for hot in (5, 100_000):
        got = {(r.a, r.b) for r in simhash.near_fingerprints(table, hot=hot).collect()}
        assert got == want


def test_components(spark):
    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(500, x) for x in range(501, 560)] + [(draw.randrange(1000, 1100), draw.randrange(1000, 1100)) for _ in range(70)]
    edges += [(7, 7), (2, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    want = roots({x for e in edges if e[0] != e[1] for x in e}, edges)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


NORM = lambda line: " ".join(re.findall(r"[^\W_]+", line.lower()))


def plain_print(line, size):
    """SimHash of all character grams, a blank at either end of the line, as two longs of 64 bits."""
    line = f" {line} "
    grams = [line[i : i + size] for i in range(len(line) - size + 1)]
    one = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    two = [xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42) for h in one]
    return [sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs)) for hs in (one, two)]


def plain_links(lines, least=line_dedup.SIMILARITY):
    """Pairs of lines with a block in common, near fingerprints and a small edit distance, by comparing all with all."""
    spans = lambda n, parts: {math.floor(parts * math.log2(x) + 1e-9) for x in (n, n / least)}
    found = []
    for r in sorted({r for x in lines for r in spans(len(x), 2)}):
        size, _, bits, width = next(row for row in line_dedup.GRAMS if r < row[1])
        here = [x for x in lines if r in spans(len(x), 2)]
        prints = {x: plain_print(x, size) for x in here}
        blocks = {x: {(k, s, prints[x][k] >> s & (1 << width) - 1) for k in (0, 1) for s in range(0, 65 - width, width)} for x in here}
        for i, x in enumerate(here):
            for y in here[:i]:
                apart = sum(bin(p ^ q).count("1") for p, q in zip(prints[x], prints[y]))
                if apart <= bits and blocks[x] & blocks[y] and spans(len(x), 8) & spans(len(y), 8):
                    n = max(len(x), len(y))
                    if edit_distance(x, y) <= (1 - least) * n + 1e-9:
                        found.append((x, y))
    return found


def test_lines(spark):
    """The registered path against brute force: null, empty and very long texts, repeated rows, typos, changed words, other columns."""
    draw = random.Random(11)
    words = ["".join(draw.choices("abcdeéu", k=draw.randint(2, 8))) for _ in range(200)]
    lines = [" ".join(draw.choices(words, k=draw.randint(3, 90))) for _ in range(40)]
    near = []
    for x in lines:
        w = x.split()
        w[0] = w[0] + "s"
        near += [x.upper() + "!", " ".join(w), " ".join(w[::-1])]
    pool = lines + near + ["a b", "b a", "--", "", "x" * 3000, "x" * 2999 + "y"]
    docs = [(i, "\n".join(draw.choices(pool, k=draw.randint(1, 12)))) for i in range(60)] + [(60, None), (61, ""), (62, "\n\n")]
    df = spark.createDataFrame([(i, t, "e", 1) for i, t in docs], "doc_id long, text string, id string, n long")
    places = sorted((i, p, NORM(x)) for i, t in docs if t is not None for p, x in enumerate(t.split("\n")) if NORM(x))
    links = plain_links(sorted({n for _, _, n in places}))
    assert len(links) > 10
    group, first = roots({n for _, _, n in places}, links), {}
    for i, p, n in places:
        first.setdefault(group[n], (i, p))
    gone = {(i, p) for i, p, n in places if first[group[n]] != (i, p)}
    want = {i: t and "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in docs}
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "id", "n", "n_lines", "n_removed"]
    rows = got.collect()
    assert {r.doc_id: r.text for r in rows} == want
    before = dict(docs)
    assert all(r.n_removed == (before[r.doc_id].count("\n") + 1 - (r.text.count("\n") + 1 if r.text or not r.n_removed else 0)) for r in rows if r.text)
    twice = line_dedup.dedup_lines(df.limit(3).unionAll(df.limit(3))).collect()
    assert len(twice) == 6 and len({(r.doc_id, r.text) for r in twice}) == 3


def test_registered_path_on_odd_rows_and_names(spark):
    """Nulls, empty and very long lines, repeated rows and columns under names the operator uses, as op3 and the pipeline call it."""
    shared = "this passage stands in many documents of the corpus word for word"
    rows = [(0, f"{shared}\nfirst own line"), (1, f"second own line\n{shared.upper()}!"), (2, None), (3, ""), (4, "\n\n"), (5, "--\n--"), (None, shared), (None, None), (1, f"second own line\n{shared.upper()}!")]
    rows += [(6, "x" * 30_000 + "\nshort"), (7, "y " * 5000 + "\nshort"), (8, shared)]
    names = "n_lines n_removed id copy line pos first n component head known sim norm _line_doc _line_copy _line_drops _line_row _line_text _line_bits"
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in [*names.split(), "a.b"])
    df = spark.createDataFrame([(*r, *[f"{c}-{k}" for c in [*names.split(), "a.b"]]) for k, r in enumerate(rows)], schema)
    out = line_dedup.dedup_lines(df, counts=False)
    assert out.columns == df.columns
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        r = got[f"id-{k}"]
        assert r.doc_id == i and all(r[c] == f"{c}-{k}" for c in [*names.split(), "a.b"])
    text = lambda k: got[f"id-{k}"].text
    assert [text(k) for k in (2, 3, 4, 5, 7)] == [None, "", "\n\n", "--\n--", None]
    # a null id comes first: its copy of the passage is the one that stays
    assert text(6) == shared and text(0) == "first own line" and text(1) == text(8) == "second own line" and text(11) == ""
    assert text(9) == rows[9][1] and text(10) == "y " * 5000
    counted = line_dedup.dedup_lines(df)
    assert counted.columns == [c for c in df.columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    assert {r.doc_id: (r.n_lines, r.n_removed) for r in counted.filter("doc_id IN (0, 2, 4)").collect()} == {0: (2, 1), 2: (0, 0), 4: (3, 0)}


def test_pipeline_with_clashing_names(spark):
    """Every stage passes on columns whose names operators use; empty documents pass through all stages."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.lit(c) for c in ("n_lines", "n_removed", "size", "fp", "kept", "component", "id")})
    now, none = docs, docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now, none = settled(stage(spark, now, folder)), settled(stage(spark, none, folder))
        assert now.columns == docs.columns == none.columns and none.count() == 0, name
        assert now.filter("n_lines <> 'n_lines' OR id <> 'id' OR kept <> 'kept'").count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, now, folder).count() > 0 and corpus_pipeline.STAGES[-1][1](spark, none, folder).count() == 0


CLASSES = ((34, 64), (64, 128), (128, 256), (256, 512), (512, 1200))


def scattered(draw, line, share):
    """The line with that share of its characters, one at least, replaced at scattered places."""
    out = list(line)
    for i in draw.sample([i for i, c in enumerate(line) if c != " "], max(1, int(share * len(line)))):
        out[i] = draw.choice([c for c in "abcdefghijklmnopqrstuvwxyz" if c != out[i]])
    return "".join(out)


def recall(spark, lines, draw, shares=(0.01, 0.02, 0.03)):
    """Share of edited lines that are linked to their own, by (length class, share of edits)."""
    cases = [(k, s, x, scattered(draw, x, s)) for k, of in enumerate(lines) for x in of for s in shares]
    texts = sorted({t for case in cases for t in case[2:]})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = settled(line_dedup.line_prints(line_dedup._places(df, "doc_id", "text")))
    number = {r.line: r.first.id for r in prints.collect()}
    links = [(number[r.a], number[r.b]) for r in line_dedup.similar_lines(df, prints).collect()]
    for a, b in links:
        n = max(len(texts[a]), len(texts[b]))
        assert edit_distance(texts[a], texts[b]) <= (1 - line_dedup.SIMILARITY) * n + 1e-9
    group, at = roots(range(len(texts)), links), {t: i for i, t in enumerate(texts)}
    hits = Counter((k, s) for k, s, x, y in cases if group[at[x]] == group[at[y]])
    return {key: hits[key] / n for key, n in Counter((k, s) for k, s, _, _ in cases).items()}


def test_recall_of_scattered_edits(spark):
    """Lines of the given documents, five length classes, each edited at up to 3 % of its characters."""
    draw = random.Random(4)
    given = sorted({NORM(x) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() for x in (r.text or "").split("\n")})
    real = [draw.sample(of, min(40, len(of))) for of in ([x for x in given if a <= len(x) < b and re.fullmatch("[a-z ]+", x)] for a, b in CLASSES)]
    got = recall(spark, real, draw)
    print("given", {k: round(v, 2) for k, v in sorted(got.items())})
    assert sum(got.values()) / len(got) >= 0.9 and all(v >= 0.85 for (_, s), v in got.items() if s <= 0.02)


@pytest.mark.xfail(reason="known gap, figures in the README: lines of 256 characters and more whose grams never repeat reach about 0.7", strict=False)
def test_recall_of_letters_by_chance(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abcdefghijklmnoprstu", k=draw.randint(2, 9)))
    made = [[" ".join(word() for _ in range(300))[: draw.randrange(*c)].strip() for _ in range(40)] for c in CLASSES]
    hard = recall(spark, made, draw)
    print("letters by chance", {k: round(v, 2) for k, v in sorted(hard.items())})
    assert all(v >= 0.8 for (k, s), v in hard.items() if s == 0.01 and k < 4)


def test_large_group_of_near_copies_is_linked_through_its_base(spark):
    """Variants of one frequent line, each with an edit of its own, beside exact copies: all are one group."""
    draw = random.Random(9)
    base = " ".join("".join(draw.choices("abcdefghij", k=6)) for _ in range(30))
    texts = [base] * 50 + [scattered(draw, base, 0.005) for _ in range(300)]
    removed = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert removed == {i: int(i > 0) for i in range(350)}


def edited(draw, line, edits):
    """The line after that many replaced, inserted or deleted letters."""
    out = list(line)
    for _ in range(edits):
        at, how = draw.randrange(1, len(out) - 1), draw.random()
        out[at : at + (how < 0.7)] = [draw.choice("abcdefghij")] * (how < 0.4 or how >= 0.7)
    return "".join(out)


def test_letter_counts_never_rule_out_a_similar_line(spark):
    """The rings of two lines differ in no more bits than their edits allow; lines too long for the counts have none."""
    draw = random.Random(12)
    lines = ["".join(draw.choices("abcdeéüfghij ", k=draw.randint(40, 900))) for _ in range(60)]
    pairs = [(NORM(x), NORM(edited(draw, x, draw.randint(1, 12)))) for x in lines]
    texts = sorted({t for pair in pairs for t in pair}) + ["x" * 40_000, "y" * 29_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.first.id, r.range): r for r in line_dedup.line_prints(line_dedup._places(df, "doc_id", "text")).collect()}
    size = {k: next(row[0] for row in line_dedup.GRAMS if k[1] < row[1]) for k in found}
    ring = lambda n: ((1 << n % 16) - 1) & 255 if n % 16 <= 8 else 255 & 255 << n % 16 - 8
    for (i, r), row in found.items():
        padded = f" {texts[i]} "
        counts = Counter((xxhash.xxh64_intdigest(c.encode(), 42) & 60) >> 2 for c in padded[: len(padded) - size[i, r] + 1]) if len(texts[i]) <= line_dedup.COUNTED_CHARS else Counter()
        want = sorted(8 - bin(ring(counts[k])).count("1") for k in range(16))
        assert sorted(bin(x).count("1") for c in (row.c0, row.c1) for x in (c & (1 << 64) - 1).to_bytes(8, "little")) == want
    met = 0
    for a, b in pairs:
        d, at = edit_distance(a, b), [texts.index(a), texts.index(b)]
        for r in {r for i, r in found if i == at[0]} & {r for i, r in found if i == at[1]}:
            x, y = (found[i, r] for i in at)
            apart = sum(bin((x[c] ^ y[c]) & (1 << 64) - 1).count("1") for c in ("c0", "c1"))
            assert apart <= 2 * (d + size[at[0], r] - 2)
            met += 1
    assert met > 40


def test_short_lines_within_the_edits_have_a_piece_in_common(spark):
    """Random edits, up to as many as the similarity allows, leave a piece whole where the other line looks for it; few pieces are kept for it."""
    draw = random.Random(13)
    texts = []
    for _ in range(300):
        x = "".join(draw.choices("abcdefghij", k=draw.randint(34, 126)))
        y = edited(draw, x, draw.randint(1, math.floor(0.03 * len(x) + 1e-9)))
        if edit_distance(x, y) <= math.floor(0.03 * max(len(x), len(y)) + 1e-9) and x != y:
            texts += [x, y]
    assert len(texts) > 400
    df = spark.createDataFrame(list(enumerate([*texts, "z" * 200])), "doc_id long, text string")
    prints = line_dedup.line_prints(line_dedup._places(df, "doc_id", "text")).withColumn("node", F.col("first.id")).cache()
    got = {shifted: {} for shifted in (True, False)}
    for shifted, of in got.items():
        for r in line_dedup._piece_entries(prints, shifted).collect():
            of.setdefault((r.node, r.place >> 6), set()).add(r.piece)
    assert {r for _, r in got[False]} == {10, 11, 12, 13} and max(map(len, got[False].values())) <= 8 and max(map(len, got[True].values())) <= 16
    for k in range(0, len(texts), 2):
        both = {r for i, r in got[True] if i == k} & {r for i, r in got[False] if i == k + 1}
        if max(len(texts[k]), len(texts[k + 1])) < 128:
            assert any(got[True][k, r] & got[False][k + 1, r] for r in both) and any(got[True][k + 1, r] & got[False][k, r] for r in both)
    prints.unpersist()


def test_letters_spare_pairs_of_a_group_that_is_near_but_not_similar(spark, monkeypatch):
    """Lines with most of their grams in common, but letters of their own: few of their pairs are made, and each once."""
    draw = random.Random(5)
    base = [draw.choice(("onthe", "ation", "erth", "andof", "thati", "shere")) for _ in range(60)]
    lines = [" ".join(w if draw.random() > 0.1 else "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for w in base) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate([*lines, *lines[:3]])), "doc_id long, text string")
    made = []
    keep = line_dedup.settled
    monkeypatch.setattr(line_dedup, "settled", lambda t: made.append((t.columns, keep(t))) or made[-1][1])
    prints = keep(line_dedup.line_prints(line_dedup._places(df, "doc_id", "text")))
    monkeypatch.setattr(line_dedup, "released", lambda *tables: None)
    line_dedup.similar_lines(df, prints).collect()
    pairs = sum(t.count() for columns, t in made if sorted(columns) == ["a", "b"])
    assert pairs < len(lines) * (len(lines) - 1) / 2 / 3  # the fingerprints alone let nearly all pass
    assert {r.doc_id for r in line_dedup.dedup_lines(df).filter("n_removed > 0").collect()} == {150, 151, 152}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.one_per_group(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
