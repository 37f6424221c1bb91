"""Toxic passages by maximum-scoring segments of token log-odds.

Tokens are words and their beginnings.  A token's log-odds between toxic and
other labelled texts have a Dirichlet prior in proportion to its frequency in
all documents.  Tokens whose rates differ beyond chance, by the likelihood
ratio over texts, tell, in either direction; equal texts count once.  A word
scores the log-odds of its most telling token, above zero or below, and
``-DRIFT`` if it has none.  One linear scan (Ruzzo and Tompa) over a text finds
all its maximal-scoring segments, the toxic passages.  Under the clean texts'
own word frequencies segment scores follow an extreme-value law whose rate and
constant give every segment its significance for the text's length; what the
segments exceed it by, summed, is the text's evidence, and a logistic curve
fitted to the training labels turns that into a score.

A longer text holds more of all tokens.  One that is rarer in toxic texts must
therefore be rarer to the word as well as to the text.

Bounded: the labelled texts learned from (``max_labelled``, chosen by hash).
All their tokens are tested, and every one that passes is kept.  The prior, the
search and the scores cover all documents and whole texts.

Defined results: a null or empty text has no segment and the lowest score;
without labels of both kinds no token is learned and all texts share one low
score; null labels are ignored, of repeated labels the highest counts; a null
``doc_id`` is never trained on; repeated rows are scored each, and learned from
once; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..scratch import stage
from .memory import released

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings that count as tokens.
BEGINNINGS = (4, 5, 6)
MAX_LABELLED = 200_000
#: Toxic training texts in which a token must occur.
LEAST = 4
#: Weight of the prior, as a share of the labelled texts.
PRIOR = 0.05
#: Signed root of the likelihood ratio, and log-odds, that a token needs.
SURE, CLEAR = 4.0, 1.0
DRIFT = 0.5
FOLDS, HELD_OUT = 5, 0
#: Words whose tokens or score a worker keeps at hand.
WORDS_KEPT = 100_000


def is_held_out(doc_id: Column) -> Column:
    """Whether labels of a document may only be used to test."""
    return F.pmod(F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)), F.lit(FOLDS)) == HELD_OUT


def tokens_of(word: str) -> list[str]:
    return [word, *[f"^{word[:n]}" for n in BEGINNINGS if len(word) >= n]]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, last, score) of all maximal-scoring segments of signed scores.

    Linear: only words above zero begin or end a segment, those between two of
    them are taken together.
    """
    at = np.flatnonzero(scores > 0)
    total = np.cumsum(scores)[at]
    # Each candidate: first, last, cumulative score before it, cumulative score with it.
    found: list[tuple[int, int, float, float]] = []
    lower: list[int] = []  # of each candidate, the latest one before it that begins lower, or -1
    for position, start, end in zip(at.tolist(), (total - scores[at]).tolist(), total.tolist(), strict=True):
        first, before = position, start
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = lower[j]
            if j < 0 or found[j][3] >= end:
                found.append((first, position, before, end))
                lower.append(j)
                break
            first, before = found[j][0], found[j][2]
            del found[j:], lower[j:]
    return [(a, b, after - before) for a, b, before, after in found]


class Scores(dict):
    """Score of a word, worked out once: that of its most telling token, or the drift."""

    def __init__(self, tokens: dict[str, float]):
        super().__init__()
        self.tokens = tokens

    def __missing__(self, word: str) -> float:
        if len(self) > WORDS_KEPT:
            self.clear()
        found = [s for t in tokens_of(word) if (s := self.tokens.get(t)) is not None]
        best = max(found, key=abs) if found else -DRIFT
        self[word] = best = best if best > 0 else min(best, -DRIFT)
        return best


@dataclass
class Toxicity:
    """A fitted model; small enough to send to every worker."""

    tokens: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    constant: float = 1.0
    bias: float = -1.0986
    slope: float = 1.0

    def segments(self, text: str | None, scores: Scores) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
        """Scores of the words, and the segments."""
        words = WORD.findall((text or "").lower())
        found = np.fromiter(map(scores.__getitem__, words), float, len(words))
        return found, maximal_segments(found)

    def excess(self, score: float, words: int) -> float:
        """By how much a segment exceeds what chance gives in so long a text."""
        return max(0.0, self.rate * score - np.log1p(self.constant * words))

    def evidence(self, text: str | None, scores: Scores) -> float:
        words, found = self.segments(text, scores)
        return sum(self.excess(s, len(words)) for *_, s in found)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.slope * np.asarray(evidence, float), -500, 500)))


def _extreme_rate(scores: np.ndarray, shares: np.ndarray) -> float:
    """Positive root of the moment equation: E[exp(rate * score)] = 1."""
    low, high = 0.0, 1.0

    def above(rate: float) -> bool:
        return float((shares * np.exp(np.minimum(rate * scores, 700))).sum()) > 1

    while not above(high) and high < 1e3:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if above(middle) else (middle, high)
    return max(high, 1e-6)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Bias and slope by Newton steps, with a small ridge where the classes separate."""
    design, w = np.stack([np.ones(len(x)), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - ridge * w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), gradient)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), max(float(w[1]), 1e-6)


def training_labels(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, toxic) rows to learn from: at most about ``max_labelled``, chosen by hash."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    share = min(1.0, max_labelled / max(1, usable.count()))
    return usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))


def training_texts(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) to learn from: each text of a kind once, at most about ``max_labelled``, staged.

    Rows may repeat a labelled id without bound; they are folded by text before
    the limit, and only the numbers of the rows taken are sent.
    """
    # Bounded by max_labelled, so it may be broadcast: texts aren't shuffled.
    chosen = F.broadcast(training_labels(labels, max_labelled).withColumnRenamed("doc_id", "of"))
    labelled = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("of"))
    hashed = F.md5(F.coalesce("text", F.lit("")))
    labelled = stage(labelled.select("text", "toxic", hashed.alias("same"), F.monotonically_increasing_id().alias("row")), "labelled")
    own = stage(labelled.groupBy("same", "toxic").agg(F.min("row").alias("own")), "labelled-texts")
    share = min(1.0, max_labelled / max(1, own.count()))
    own = own.where(F.pmod(F.xxhash64("same"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    return labelled.join(F.broadcast(own.select("own")), F.col("row") == F.col("own"), "left_semi").select("text", "toxic")


class Tokens(dict):
    """Tokens of a word that are wanted, as numbers; all its tokens, as they are, if ``wanted`` is None."""

    def __init__(self, wanted: dict[str, int] | None):
        super().__init__()
        self.wanted = wanted

    def __missing__(self, word: str) -> tuple:
        if len(self) > (WORDS_KEPT if self.wanted is not None else WORDS_KEPT // 5):
            self.clear()
        found = tokens_of(word)
        self[word] = out = tuple(found if self.wanted is None else [self.wanted[t] for t in found if t in self.wanted])
        return out

    def of(self, text: str | None) -> tuple[set, int]:
        """Distinct tokens of a text, and its number of words."""
        words = WORD.findall((text or "").lower())
        return set(chain.from_iterable(map(self.__getitem__, set(words)))), len(words)


def _count_all(texts: DataFrame) -> DataFrame:
    """(token, c0, c1): texts of each kind that hold each token, pre-aggregated by task.

    The empty token counts all texts, ``^`` all words.  ``texts``: (text, toxic).
    """

    def rows(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
        found = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *[pa.array([c[t] for t in found], pa.int64()) for c in counts]], ["token", "c0", "c1"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, tokens = (Counter(), Counter()), Tokens(None)
        for batch in released(batches):
            for text, kind in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found, words = tokens.of(text.as_py())
                found.add("")
                counts[kind].update(found)
                counts[kind]["^"] += words
                if len(counts[0]) + len(counts[1]) > WORDS_KEPT:
                    yield rows(counts)
                    counts[0].clear()
                    counts[1].clear()
        yield rows(counts)

    return texts.select("text", "toxic").mapInArrow(kernel, "token string, c0 long, c1 long").groupBy("token").agg(*[F.sum(c).alias(c) for c in ("c0", "c1")])


def _telling(counts: DataFrame, texts: tuple[int, int], words: tuple[int, int]) -> DataFrame:
    """(token, c0, c1) of the tokens whose rates differ beyond chance, in either direction."""
    seen = counts.where(~F.col("token").isin("", "^") & ((F.col("c1") >= LEAST) | (F.col("c0") >= LEAST)))
    # A beginning has to tell something beyond the one word that it mostly stands for.
    begun = F.array(*[F.when(F.length("token") >= n, F.concat(F.lit("^"), F.substring("token", 1, n))) for n in BEGINNINGS])
    single = seen.where(~F.col("token").startswith("^")).select(F.explode(begun).alias("of"), "c0", "c1").where("of is not null")
    most = single.groupBy("of").agg(F.max("c0").alias("most0"), F.max("c1").alias("most1"))
    told = seen.join(most, F.col("token") == F.col("of"), "left").select("token", "c0", "c1", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("most0", "most1")])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c0, c1, most0, most1 = (batch.column(i).to_numpy().astype(float) for i in range(1, 5))
            above = (c1 - most1 >= LEAST) & (_signed_root(c0, c1 - most1, *texts) >= SURE)
            below = (c0 - most0 >= LEAST) & (_signed_root(c0 - most0, c1, *texts) <= -SURE) & (_signed_root(c0 - most0, c1, *words) <= -SURE)
            kept = [batch.column(0), pa.array(np.where(above, c0, c0 - most0).astype(np.int64)), pa.array(np.where(above, c1 - most1, c1).astype(np.int64)), pa.array(above)]
            yield pa.RecordBatch.from_arrays(kept, ["token", "c0", "c1", "above"]).filter(pa.array(above | below, pa.bool_()))

    return told.mapInArrow(kernel, "token string, c0 long, c1 long, above boolean")


def _count_wanted(texts: DataFrame, wanted: dict[str, int]) -> np.ndarray:
    """Texts that hold each wanted token, and last the number of texts."""
    sent = texts.sparkSession.sparkContext.broadcast(wanted)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, table = Tokens(sent.value), np.zeros(len(sent.value) + 1, np.int64)
        for batch in released(batches):
            for text in batch.column(0):
                table[np.fromiter(tokens.of(text.as_py())[0], np.int64)] += 1
            table[-1] += batch.num_rows
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], ["i", "c"])

    # One row for each wanted token at most.
    got = texts.select("text").mapInArrow(kernel, "i long, c long").groupBy("i").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(len(wanted) + 1, np.int64)
    out[got.column("i").to_numpy()] = got.column("c").to_numpy()
    return out


def _signed_root(c0: np.ndarray, c1: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Signed root of the likelihood ratio that two rates are one."""

    def part(c: np.ndarray, n: int, rate: np.ndarray) -> np.ndarray:
        own = c / n
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(c > 0, c * np.log(own / rate), 0) + np.where(c < n, (n - c) * np.log((1 - own) / (1 - rate)), 0)

    rate = (c0 + c1) / (n0 + n1)
    return np.sign(c1 / n1 - c0 / n0) * np.sqrt(np.maximum(0, 2 * (part(c0, n0, rate) + part(c1, n1, rate))))


def log_odds(c0: np.ndarray, c1: np.ndarray, prior: np.ndarray, n0: float, n1: float, weight: float) -> np.ndarray:
    """Log-odds of tokens in ``c1`` of ``n1`` against ``c0`` of ``n0``, with ``prior`` of ``weight`` added to both."""
    return np.log((c1 + prior) / (n1 + weight - c1 - prior)) - np.log((c0 + prior) / (n0 + weight - c0 - prior))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Toxicity:
    """Learn from the labels outside the held-out fold."""
    labelled = training_texts(docs, labels, max_labelled)
    counts = stage(_count_all(labelled), "token-counts")
    totals = {r["token"]: (r["c0"], r["c1"]) for r in counts.where("token IN ('', '^')").collect()}
    texts, words = totals.get("", (0, 0)), totals.get("^", (0, 0))
    if not min(texts) or not min(words):
        return Toxicity()
    n0, n1 = texts
    # Bounded by the labelled texts: those that pass, not all that were tested.
    telling = _telling(counts, texts, words).orderBy("token").toArrow()
    names = np.array(telling.column("token").to_pylist(), object)
    if not len(names):
        return Toxicity()
    *background, n = _count_wanted(docs.select("text"), {t: i for i, t in enumerate(names.tolist())}).tolist()
    c0, c1 = (telling.column(c).to_numpy().astype(float) for c in ("c0", "c1"))
    above = telling.column("above").to_numpy()
    weight = PRIOR * (n0 + n1)
    odds = log_odds(c0, c1, weight * np.array(background) / n, n0, n1, weight)
    keep = np.where(above, odds >= CLEAR, odds <= -CLEAR)
    if not (keep & above).any():
        return Toxicity()
    model = Toxicity(dict(zip(names[keep].tolist(), odds[keep].tolist(), strict=True)))

    def segment_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model.tokens)
        for batch in released(batches):
            found = [model.segments(t.as_py(), scores) for t in batch.column(0)]
            below = [w[w < -DRIFT] for w, _ in found]
            columns = [pa.array([len(w) for w, _ in found], pa.int64()), pa.array([len(x) for x in below], pa.int64()), pa.array([float(x.sum()) for x in below], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(1), *columns, pa.array([[s for *_, s in f] for _, f in found], pa.list_(pa.float64()))], ["toxic", "words", "below", "below_sum", "found"])

    scanned = stage(labelled.mapInArrow(segment_kernel, "toxic int, words long, below long, below_sum double, found array<double>"), "segments")
    # The extreme-value law of clean text: shares of scoring words among its words.
    positive = odds[keep & above]
    least = float(positive.min())
    clean = scanned.where("toxic = 0").agg(F.sum("words"), F.sum("below"), F.sum("below_sum"), F.sum(F.size("found")), F.sum(F.size(F.filter("found", lambda s: s >= least)))).first()
    clean_words, below, below_sum, segments, sure = (float(x or 0) for x in clean)
    clean_words = max(1.0, clean_words)
    typical, shares = np.quantile(positive, np.linspace(0.05, 0.95, 10)), np.full(10, (segments + 0.5) / 10 / clean_words)
    lowered = below / clean_words
    rest = max(1e-12, 1 - shares.sum() - lowered)
    model.rate = _extreme_rate(np.r_[typical, below_sum / max(1.0, below), -DRIFT], np.r_[shares, lowered, rest])
    model.constant = (sure + 0.5) / (clean_words * np.exp(-model.rate * least))

    def evidence_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(sum(model.excess(s, n) for s in found)) for n, found in rows], pa.float64())], ["toxic", "evidence"])

    # Two numbers to a labelled text, of which there are max_labelled at most.
    got = scanned.select("toxic", "words", "found").mapInArrow(evidence_kernel, "toxic int, evidence double").toArrow()
    model.bias, model.slope = _logistic(got.column("evidence").to_numpy(), got.column("toxic").to_numpy().astype(float))
    return model


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """(doc_id, score) of every document."""
    schema = StructType([docs.schema["doc_id"], StructField("score", DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        scores = Scores(model.tokens)
        for batch in released(batches):
            evidence = [model.evidence(t.as_py(), scores) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.probability(np.array(evidence, float)))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(kernel, schema)


def keep_clean(docs: DataFrame, model: Toxicity, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose text scores below ``threshold``; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        scores = Scores(model.tokens)
        for batch in released(batches):
            evidence = [model.evidence(t.as_py(), scores) for t in batch.column(at)]
            yield batch.filter(pa.array(model.probability(np.array(evidence, float)) < threshold, pa.bool_()))

    return docs.mapInArrow(kernel, docs.schema)


def passages(docs: DataFrame, model: Toxicity) -> DataFrame:
    """Every significant toxic passage: (doc_id, start, end, passage, segment_score, p_value).

    ``start`` and ``end`` are character positions in the text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([docs.schema["doc_id"], StructField("start", LongType()), StructField("end", LongType()), StructField("passage", StringType()), StructField("segment_score", DoubleType()), StructField("p_value", DoubleType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        scores = Scores(model.tokens)
        for batch in released(batches):
            rows = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found, segments = model.segments(text, scores)
                words, found = len(found), [f for f in segments if model.excess(f[2], len(found)) > 0]
                if not found:
                    continue
                # Lowering may change a text's length; positions are those of the lowered text then.
                low = text.lower()
                spans = [m.span() for m in WORD.finditer(low)]
                shown = text if len(low) == len(text) else low
                for a, b, s in found:
                    start, end = spans[a][0], spans[b][1]
                    rows.append((i, start, end, shown[start:end], s, float(-np.expm1(-model.constant * words * np.exp(-model.rate * s)))))
            if rows:
                index, *columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index)), *map(pa.array, columns)], schema.names)

    return docs.select("doc_id", "text").mapInArrow(kernel, schema)
