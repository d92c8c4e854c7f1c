"""Quality classifier: weak labellers weighed by expectation-maximisation, their posteriors train a hashed linear scorer."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GOOD, NONE, BAD = 2, 1, 0
TRAINING_ROWS = 8_000  # different texts the scorer is fitted on at most, in expectation, chosen by their hash
WIDTH = 1 << 16  # hashed features
WORD_SCALE = 0.3  # of words against their shapes, of which there are far fewer
THRESHOLD = 0.5
_UPPER, _LOWER, _SYMBOLS, _MARKS = (bytes(range(65, 91)), bytes(range(97, 123)), b"#*$%&|<>{}[]^~=_\\", b"!?")
_ENDS = (b".", b",", b";", b":", b"?", b"!")
# Frequent function words of the corpus languages.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his from or are this an at which but have "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "de la le et les des en un du une que est pour qui dans sur au par plus pas ne ce il "
    "el los se del las una con no su al lo como más pero sus le ya o este sí porque".encode().split()
)


class Evidence(NamedTuple):
    n: int
    sym: float
    up: float
    mark: float
    end: float
    size: float
    func: float
    uniq: float
    again: float
    pairs: float
    dup: float


def evidence(text: bytes) -> Evidence:
    """Words, then shares: symbols a word, capitals among cased ASCII letters, marks a word, words that end in punctuation, bytes a
    word, function words, distinct words, words like the one before, distinct word pairs, repeated lines."""
    words = text.split()
    n = len(words)
    without = lambda chars: len(text) - len(text.translate(None, chars))
    upper, lower = without(_UPPER), without(_LOWER)
    lines = [x for x in text.split(b"\n") if x.strip()]
    per = lambda x, of: x / of if of else 0.0
    return Evidence(
        n, per(without(_SYMBOLS), n), per(upper, upper + lower), per(without(_MARKS), n), per(sum(w.endswith(_ENDS) for w in words), n), per(sum(map(len, words)), n),
        per(sum(map(FUNCTION_WORDS.__contains__, words)), n), per(len(set(words)), n), per(sum(map(bytes.__eq__, words, words[1:])), n), per(len(set(zip(words, words[1:]))), n - 1), per(len(lines) - len(set(lines)), len(lines)),
    )


def _side(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else NONE


LABELLERS: dict[str, Callable[..., int]] = {
    "symbols": lambda e: _side(e.sym > 0.1, e.sym < 0.01),
    "shouting": lambda e: _side(e.up > 0.5, e.n >= 20 and e.up < 0.15),
    "marks": lambda e: _side(e.mark > 0.25, False),
    "too_short": lambda e: _side(e.n < 3, e.n >= 60),
    "sentences": lambda e: _side(e.n >= 8 and (e.end < 0.01 or e.end > 0.5), 0.02 < e.end < 0.35),
    "word_size": lambda e: _side(e.size < 2.5 or e.size > 12, 3.5 < e.size < 8),
    "function_words": lambda e: _side(e.n >= 20 and e.func < 0.02, e.func > 0.08),
    "variety": lambda e: _side(e.n >= 30 and e.uniq < 0.15, e.n >= 30 and 0.3 < e.uniq),
    "stutter": lambda e: _side(e.n >= 8 and e.again > 0.15, e.n >= 20 and e.again < 0.05),
    "word_pairs": lambda e: _side(e.n >= 30 and e.pairs < 0.4, e.n >= 30 and e.pairs > 0.7),
    "repeated_lines": lambda e: _side(e.dup > 0.4, False),
}


def votes(text: bytes) -> int:
    """All labellers' votes as the digits of one number to base three."""
    seen, code = evidence(text), 0
    for label in LABELLERS.values():
        code = 3 * code + label(seen)
    return code


def _digits(codes: np.ndarray) -> np.ndarray:
    places = 3 ** np.arange(len(LABELLERS))[::-1]
    return codes[:, None] // places % 3


def label_model(codes: np.ndarray, counts: np.ndarray, steps: int = 200, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each vote pattern, ``[class, labeller]`` probabilities of a good vote, and the share of good documents.

    Expectation-maximisation of two classes. A labeller that votes is right at its own rate in each class, and where it
    abstains it says nothing. The start takes documents with a bad vote for bad, which also says which class is which. Counts
    are smoothed by one.
    """
    digits = _digits(codes)
    is_good, is_bad = (digits == GOOD).astype(float), (digits == BAD).astype(float)
    good = np.where(is_bad.any(1), 0.1, 0.95)
    rates, share = np.zeros((2, digits.shape[1])), 0.5
    for _ in range(steps):
        before = good
        for c, p in enumerate((1 - good, good)):
            yes, no = (counts * p) @ is_good + 1, (counts * p) @ is_bad + 1
            rates[c] = yes / (yes + no)
        share = float((counts @ good + 1) / (counts.sum() + 2))
        log = [is_good @ np.log(r) + is_bad @ np.log(1 - r) + np.log(q) for r, q in zip(rates, (1 - share, share))]
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        if np.abs(good - before).max() < tolerance:
            break
    return good, rates, share


_SHAPES = bytes(88 if 65 <= b < 91 else 120 if 97 <= b < 123 or b >= 128 else 48 if 48 <= b < 58 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


def word_features(word: bytes) -> tuple[int, int]:
    """Hashed places of a word and of its shape: runs of capitals, small letters, digits and each punctuation mark."""
    shape = _RUN.sub(rb"\1", word.translate(_SHAPES))
    return xxhash.xxh32_intdigest(word) % WIDTH, xxhash.xxh32_intdigest(b"\0" + shape) % WIDTH


_AGAIN, _OLD_PAIR = (xxhash.xxh32_intdigest(x) % WIDTH for x in (b"\1again", b"\1pair"))


def repeats(words: list[bytes]) -> tuple[float, float]:
    """Shares of words like the one before and of word pairs met before, two more features of a text."""
    n = len(words)
    return (sum(map(bytes.__eq__, words, words[1:])) / n, 1 - len(set(zip(words, words[1:]))) / (n - 1)) if n > 1 else (0.0, 0.0)


def _vector(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places, and at each the features there per word of the text."""
    words = text.split()
    at = np.array([i for w in words for i in word_features(w)] + [_AGAIN, _OLD_PAIR], np.int64)
    values = np.concatenate([np.tile([WORD_SCALE, 1.0], len(words)) / max(1, len(words)), repeats(words)])
    places, where = np.unique(at, return_inverse=True)
    return places, np.bincount(where, values)


def fitted(sample: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 8, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model on soft labels, by stochastic gradients with a step size per feature."""
    weights, squares, intercept, square = np.zeros(WIDTH), np.full(WIDTH, 1e-6), 0.0, 1e-6
    draw = np.random.default_rng(0)
    for _ in range(epochs):
        for i in draw.permutation(len(sample)):
            places, values, target = sample[i]
            error = 1 / (1 + np.exp(-np.clip(intercept + weights[places] @ values, -700, 700))) - target
            slope = error * values
            squares[places] += slope * slope
            weights[places] -= rate * slope / np.sqrt(squares[places])
            square += error * error
            intercept -= rate * error / np.sqrt(square)
    return weights, float(intercept)


class Scorer:
    """Linear scores of texts; the weight of a word met before is looked up: up to a million words, of no more than 64 bytes each."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept, self.known = weights, intercept, {}

    def _weight(self, word: bytes) -> float:
        found = self.known.get(word)
        if found is None:
            a, b = word_features(word)
            found = float(WORD_SCALE * self.weights[a] + self.weights[b])
            if len(word) <= LONGEST_KNOWN:
                if len(self.known) >= KNOWN_WORDS:
                    self.known.clear()
                self.known[word] = found
        return found

    def score(self, text: bytes) -> float:
        words = text.split()
        again, old = repeats(words)
        z = self.intercept + (sum(map(self._weight, words)) / len(words) if words else 0.0) + again * self.weights[_AGAIN] + old * self.weights[_OLD_PAIR]
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def _vote_column(data: Column) -> Column:
    @F.pandas_udf("int")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([votes(t or b"") for t in texts], dtype="int32")

    return of(data)


KNOWN_WORDS, LONGEST_KNOWN = 1_000_000, 64  # what bounds the memory of a scorer


def classified(docs: DataFrame, id_col: str = "doc_id", text: str = "text", training_rows: int = TRAINING_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Per row ``id, score, kept``: the probability of a good document and whether it reaches ``threshold``.

    Vote patterns of all rows are counted (three to the power of the labellers at most, 177,147) and the label model is fitted on
    the counts. The scorer is a logistic model of hashed words, word shapes and repeats, trained on the posteriors of about
    ``training_rows`` different texts at most in expectation, drawn by their hash, copies once, at a rate that follows from the number of different texts (sketched): a bounded sample, which the driver
    holds; all rows are scored. Null and empty texts are scored as
    texts without words. Rows of equal text agree. An empty table gives no rows.
    """
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), data.alias("data"))
    voted = rows.withColumn("votes", _vote_column(F.col("data")))
    patterns = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()
    if not patterns:
        return rows.select("id", F.lit(0.0).alias("score"), F.lit(True).alias("kept"))
    codes, counts = np.array([p.votes for p in patterns]), np.array([p.n for p in patterns], float)
    good, _, share = label_model(codes, counts)
    posterior = dict(zip(codes.tolist(), good.tolist()))

    @F.pandas_udf("places array<int>, values array<double>")
    def vectors(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([[x.tolist() for x in _vector(t)] for t in texts], columns=["places", "values"])

    # copies share a hash: however many there are, one row of them is drawn, so the rate follows from the number of different texts
    hashed = rows.withColumn("hash", F.xxhash64("data"))
    texts = max(1, hashed.agg(F.approx_count_distinct("hash", 0.02)).first()[0])
    most = int(min(1.0, training_rows / texts) * (1 << 31))
    drawn = hashed.filter(F.pmod("hash", F.lit(1 << 31)) <= most)
    sample = drawn.groupBy("hash").agg(F.min("data").alias("data")).select("hash", _vote_column(F.col("data")).alias("votes"), vectors("data").alias("x")).orderBy("hash").toPandas()
    weights, intercept = fitted([(np.array(x["places"]), np.array(x["values"]), posterior[v]) for x, v in zip(sample["x"], sample["votes"])])

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(weights, intercept)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype=float)

    return rows.select("id", scores("data").alias("score")).withColumn("kept", F.col("score") >= threshold)
