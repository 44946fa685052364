"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed counts of its letter 1-, 2- and 3-grams, weighted as
(1 + log tf) * idf and scaled to length one. For each language a spherical k-means over a
bounded sample gives ``clusters`` centroids; the nearest one by cosine names the language.
A text further from its centroid than ``reject_quantile`` of that language's own sample is
marked as not accepted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096
CHUNK = 1 << 18


@dataclass(frozen=True)
class Model:
    langs: list[str]
    owner: np.ndarray  # language of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray  # least accepted cosine by language


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a whole text; digits, marks and white space part words."""
    total = np.zeros(BINS, np.int64)
    for at in range(0, len(text), CHUNK):
        c = np.frombuffer(text[max(0, at - 2) : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        letter = (c >= 128) | ((c >= 97) & (c <= 122))
        c = np.where(letter, c, np.uint64(32))
        keep = letter | np.r_[True, letter[:-1]]
        c = c[keep]
        grams = [c * np.uint64(0x9E3779B97F4A7C15)]
        for _ in range(2):
            if len(grams[-1]) > 1:
                grams.append((grams[-1][:-1] ^ (grams[-1][:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c[len(c) - len(grams[-1]) + 1 :] * np.uint64(0x94D049BB133111EB))
        for g in grams:
            total += np.bincount((g >> np.uint64(52)).astype(np.int64), minlength=BINS)
    return total


def vectors(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.where(rows > 0, 1 + np.log(np.maximum(rows, 1)), 0).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(labelled: DataFrame, per_lang: int = 500, clusters: int = 4, reject_quantile: float = 0.001, rounds: int = 12) -> Model:
    """Learns from ``labelled(doc_id, text, lang)``: document frequencies over all its rows, centroids from about ``per_lang`` rows of each language, chosen by a hash of the row; repeated rows count once."""
    known = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(BINS, np.int64), 0
        for b in batches:
            for t in b.column(0):
                seen += counts(t.as_py()) > 0
                rows += 1
        yield pa.RecordBatch.from_pydict({"bin": pa.array(np.arange(BINS + 1), pa.int64()), "n": pa.array(np.append(seen, rows), pa.int64())})

    by_bin = {r["bin"]: r["n"] for r in known.select("text").mapInArrow(frequencies, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()}  # bounded: a row for each bin
    n = by_bin.get(BINS, 0)
    idf = np.log((1 + n) / (1 + np.array([by_bin.get(i, 0) for i in range(BINS)]))) + 1
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # bounded: a row for each language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros(0, int), np.zeros((0, BINS), np.float32), idf, np.zeros(0))
    share = F.lit(0.0)
    for lang, size in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.25 * per_lang / size))).otherwise(share)
    chosen = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30)).dropDuplicates(["doc_id", "text"])  # about 1.25 per_lang of each language; repeated rows count once

    def featured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "lang": f["lang"], "x": [np.minimum(counts(t), 65535).astype(np.uint16).tobytes() for t in f["text"]]})

    rows = chosen.mapInPandas(featured, "doc_id long, lang string, x binary").toPandas().sort_values(["lang", "doc_id"])  # bounded by per_lang
    owner, centroids, floor = [], [], []
    for k, lang in enumerate(langs):
        mine = rows.loc[rows["lang"] == lang, "x"]
        x = vectors(np.stack([np.frombuffer(v, np.uint16) for v in mine]), idf) if len(mine) else np.zeros((1, BINS), np.float32)
        own = x[np.linspace(0, len(x) - 1, min(clusters, len(x))).astype(int)]
        for _ in range(rounds):
            near = (x @ own.T).argmax(axis=1)
            own = np.stack([x[near == j].mean(axis=0) if (near == j).any() else own[j] for j in range(len(own))])
            own = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
        owner += [k] * len(own)
        centroids.append(own)
        floor.append(float(np.quantile((x @ own.T).max(axis=1), reject_quantile)))
    return Model(langs, np.array(owner), np.concatenate(centroids).astype(np.float32), idf.astype(np.float32), np.array(floor))


def predict(docs: DataFrame, model: Model, sharpness: float = 20.0) -> DataFrame:
    """(doc_id, lang_pred, score, cosine, accepted) for every whole text.

    ``und`` with score 0 for a null text and one without any letter (and for all texts if
    nothing was learnt). Of equally near languages the first by name is told. Repeated rows
    each give their row; an empty table gives an empty
    result; lang, source and other columns are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                texts = [t.as_py() or "" for t in b.column(1)]
                said = np.array([any(map(str.isalpha, t)) for t in texts]) & bool(model.langs)
                names, score, cosine, accepted = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
                if said.any():
                    near = vectors(np.stack([counts(t) for t, s in zip(texts, said, strict=True) if s]), model.idf) @ model.centroids.T
                    best = np.stack([near[:, model.owner == k].max(axis=1) for k in range(len(model.langs))], axis=1).astype(float)
                    top = best.argmax(axis=1)
                    p = np.exp(sharpness * (best - best.max(axis=1, keepdims=True)))
                    rows = np.flatnonzero(said)
                    score[rows], cosine[rows] = 1 / p.sum(axis=1), best.max(axis=1)
                    accepted[rows] = cosine[rows] >= model.floor[top]
                    for i, k in zip(rows.tolist(), top.tolist(), strict=True):
                        names[i] = model.langs[k]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names), pa.array(score), pa.array(cosine), pa.array(accepted)], ["doc_id", "lang_pred", "score", "cosine", "accepted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, cosine double, accepted boolean")


def held_out():
    """Rows kept for measuring: crc32 of doc_id as text is divisible by 5; a row without doc_id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def languages(docs: DataFrame, per_lang: int = 500) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cosine, accepted) of every document, learnt from the rows that aren't held out."""
    model = fit(docs.where(~held_out()), per_lang)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cosine", "accepted")
