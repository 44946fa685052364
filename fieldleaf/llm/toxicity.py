"""Toxic passages as maximum-scoring segments over token log-odds.

Fit, on a bounded sample of labelled rows: the log-odds between toxic and clean texts of
each word, and of its beginnings and endings (a stem with ever new endings is an open set
of words), under a Dirichlet prior of the pieces' own frequencies, taken at its cautious
end (``caution`` standard deviations towards zero). A token's score is that of its surest
sign, the highest of its pieces, lowered by ``drift``, so that ordinary text scores below
zero. Scan: the linear-time search for all maximal scoring segments. Significance: for
scores with negative mean the best segment of n ordinary tokens follows an extreme-value
law with parameters lambda and K; the evidence of a document is the sum over its segments
of lambda * S - log(K n) where positive, and a one-variable logistic curve fitted on the
sample turns it into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldleaf.llm.common import stored

WORD = re.compile(r"[^\W_]+")
AFFIX = range(3, 9)  # letters of a beginning or an ending
KNOWN_WORDS = 1 << 19  # words whose score a task remembers before it starts anew


@dataclass(frozen=True)
class Model:
    terms: dict[str, float] = field(default_factory=dict)  # positive scores of pieces, before drift
    drift: float = 1.0
    lam: float = 1.0
    k: float = 1.0
    intercept: float = -3.0
    slope: float = 0.0

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.intercept + self.slope * evidence))))


def pieces(word: str) -> list[str]:
    """The whole word, and its beginnings and endings; a word of their length is no beginning of itself."""
    return [f"^{word}$", *[f"^{word[:n]}" for n in AFFIX if n < len(word)], *[f"{word[-n:]}$" for n in AFFIX if n < len(word)]]


def maximal_segments(places: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a token sequence, in one pass.

    ``places`` and ``scores`` list the tokens whose score isn't ``-drift``; the gaps between
    them count by their length, so the time follows the number of listed tokens.
    """
    kept: list[tuple[float, float, int, int]] = []  # cumulative score before, after, start, end
    total, at = 0.0, 0
    for place, score in zip(places, scores, strict=True):
        total -= drift * (place - at)
        at = place + 1
        before, total = total, total + score
        if score <= 0:
            continue
        low, high, start = before, total, place
        while kept:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= low:
                j -= 1
            if j < 0 or kept[j][1] >= high:
                break
            low, start = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append((low, high, start, place + 1))
    return [(s, e, h - b) for b, h, s, e in kept]


class Scanner:
    """Applies a model to texts; the scores of words seen are kept, and dropped where they grow too many."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def step(self, word: str) -> float | None:
        """The word's score less the drift, None if no piece of it is a sign."""
        best = max((self.model.terms.get(p, 0.0) for p in pieces(word)), default=0.0)
        if len(self.known) >= KNOWN_WORDS:
            self.known.clear()
        self.known[word] = out = best - self.model.drift if best > 0 else None
        return out

    def steps(self, words: list[str]) -> list[tuple[int, float]]:
        known, step = self.known, self.step
        return [(i, s) for i, w in enumerate(words) if (s := known[w] if w in known else step(w)) is not None]

    def __call__(self, text: str | None) -> tuple[int, list[tuple[int, int, float]], float]:
        """Number of tokens, all maximal segments, and the document's evidence."""
        words = WORD.findall((text or "").lower())
        found = self.steps(words)
        segments = maximal_segments([i for i, _ in found], [s for _, s in found], self.model.drift)
        floor = math.log(max(self.model.k * max(len(words), 1), 1e-12))
        return len(words), segments, sum(max(0.0, self.model.lam * s - floor) for _, _, s in segments)


def scan(text: str | None, model: Model) -> tuple[int, list[tuple[int, int, float]], float]:
    return Scanner(model)(text)


def known_labels(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled documents, half of them toxic at most, chosen by a hash of doc_id."""
    known = known_labels(labels)
    chosen = [known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2) for v in (0, 1)]
    return docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").select("text", "toxic")  # bounded by rows


def fit(docs: DataFrame, labels: DataFrame, rows: int = 20_000, prior: float = 1000.0, least: float = 0.5, caution: float = 2.0, drift: float = 0.3) -> Model:
    """Fits on at most ``rows`` rows of ``labels(doc_id, toxic)``, which also bounds the pieces kept: those that are signs of toxic texts. A piece's prior count is ``least`` and its share of ``prior``."""
    labelled = sample(docs, labels, rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by = Counter(), Counter()
            for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):  # once a text: one long text is no evidence for a word
                by[toxic > 0].update({p for w in set(WORD.findall((text.as_py() or "").lower())) for p in pieces(w)})
            seen = list(by[0].keys() | by[1].keys())
            yield pa.RecordBatch.from_pydict({"piece": seen, "clean": pa.array([by[0][p] for p in seen], pa.int64()), "bad": pa.array([by[1][p] for p in seen], pa.int64())})

    counts = labelled.mapInArrow(count, "piece string, clean long, bad long").groupBy("piece").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    counts = stored(counts)
    n = counts.agg(F.coalesce(F.sum("clean"), F.lit(0)).alias("clean"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("*").alias("pieces")).first()
    if not n["clean"] or not n["bad"]:
        return Model(drift=drift)
    own = F.lit(least) + F.lit(prior) * (F.col("clean") + F.col("bad")) / F.lit(float(n["clean"] + n["bad"]))
    mass = prior + least * n["pieces"]
    odds = lambda y, size: F.log((F.col(y) + own) / (F.lit(float(size) + mass) - F.col(y) - own))
    error = F.sqrt(1 / (F.col("bad") + own) + 1 / (F.col("clean") + own))
    signs = counts.select("piece", (odds("bad", n["bad"]) - odds("clean", n["clean"]) - caution * error).alias("score")).where("score > 0")
    listed = signs.toPandas()  # bounded by rows
    model = Model(dict(zip(listed["piece"], listed["score"].tolist(), strict=True)), drift)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(model)
        for f in frames:
            got = [scanner(t) for t in f["text"]]
            steps = [Counter(round(s, 2) for _, s in scanner.steps(WORD.findall((t or "").lower()))) for t in f["text"]]
            yield pd.DataFrame({"toxic": f["toxic"], "n": [x[0] for x in got], "scores": [[s for _, _, s in x[1]] for x in got], "steps": [list(c) for c in steps], "times": [list(c.values()) for c in steps]})

    seen = labelled.mapInPandas(measure, "toxic int, n long, scores array<double>, steps array<double>, times array<long>").toPandas()  # bounded by rows
    clean = seen[seen["toxic"] == 0]
    times: Counter = Counter()
    for steps, n_of in zip(clean["steps"], clean["times"], strict=True):
        for s, m in zip(steps, n_of, strict=True):
            times[s] += m
    tokens = max(1, int(clean["n"].sum()))
    share = np.array([*times.values(), tokens - sum(times.values())]) / tokens
    lam = positive_root(np.array([*times, -drift]), share)
    best = np.array([max(s, default=0.0) for s in clean["scores"]])
    k = len(clean) / max(1e-12, float((clean["n"].clip(lower=1).to_numpy() * np.exp(-lam * best)).sum()))
    floors = np.log(k * seen["n"].clip(lower=1).to_numpy())
    evidence = np.array([sum(max(0.0, lam * x - f) for x in s) for s, f in zip(seen["scores"], floors, strict=True)])
    toxic = seen["toxic"].to_numpy()
    of = {r["toxic"]: r["count"] for r in known_labels(labels).groupBy("toxic").count().collect()}
    weight = np.array([of[c] / max(1, (toxic == c).sum()) for c in (0, 1)])  # the sample has more toxic texts than the labels
    intercept, slope = logistic(evidence, toxic.astype(float), (weight / weight.min())[toxic])
    return Model(model.terms, drift, lam, k, intercept, slope)


def positive_root(steps: np.ndarray, share: np.ndarray) -> float:
    """The positive lambda at which the mean of exp(lambda * step) is one, for steps of negative mean; 1 where there is none."""
    mean = lambda x: float((share * np.exp(np.minimum(x * steps, 500.0))).sum()) - 1
    low, high = 1e-6, 8.0
    if mean(high) <= 0 or mean(low) >= 0:
        return 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 0 else (low, mid)
    return low


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope of a weighted one-variable logistic regression, by Newton's method."""
    scale = max(float(x.std()), 1e-9)
    z = np.stack([np.ones_like(x), np.minimum(x / scale, 5)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0) / scale)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted, n_segments, evidence) for every whole text.

    Null and empty texts get the score of a text without evidence; repeated rows each give
    their row; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model)
        for b in batches:
            got = [scanner(t.as_py()) for t in b.column(1)]
            p = [model.probability(x[2]) for x in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32()), pa.array([len(x[1]) for x in got], pa.int32()), pa.array([x[2] for x in got], pa.float64())], ["doc_id", "score", "predicted", "n_segments", "evidence"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int, n_segments int, evidence double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores under ``threshold``.

    Null and empty texts score as a text without evidence; each of repeated rows is judged
    alike; equal scores fall on the same side; an empty table stays empty.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model)
        for b in batches:
            yield b.filter(pa.array([model.probability(scanner(t.as_py())[2]) < threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def passages(docs: DataFrame, model: Model, least: float = 0.0) -> DataFrame:
    """Every significant passage: (doc_id, start, end, passage, segment_score, evidence), offsets in code points of the text, end exclusive."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(model)
        for f in frames:
            rows = []
            for i, text in zip(f["doc_id"], f["text"], strict=True):
                n, segments, _ = scanner(text)
                floor = math.log(max(model.k * max(n, 1), 1e-12))
                told = [(s, e, x, model.lam * x - floor) for s, e, x in segments if model.lam * x - floor > least]
                if told:
                    at = [m.span() for m in WORD.finditer(text)] if len(text.lower()) == len(text) else [m.span() for m in WORD.finditer(text.lower())]
                    rows += [(i, at[s][0], at[e - 1][1], text[at[s][0] : at[e - 1][1]], x, v) for s, e, x, v in told]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "passage", "segment_score", "evidence"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, start int, end int, passage string, segment_score double, evidence double")


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are kept for measuring: crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def toxic_documents(docs: DataFrame, labels: DataFrame, rows: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learnt from the labels that aren't held out. A null doc_id isn't held out."""
    model = fit(docs, labels.where(~held_out()), rows)
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
