"""Secret scans: fixed patterns, and character Markov models for what they miss.

Two first-order models of character pairs, one of random strings and one of ordinary
identifiers, are counted on labelled tokens: random strings made for it, and tokens of a
bounded sample of texts, labelled as secrets where the patterns find them and as ordinary
elsewhere. A token is added as a secret if its log-likelihood ratio, in all and for each
character, is high enough.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base patterns, in the order in which kinds are listed, and the least length of what counts.
ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

LONG_HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of HEX that are long enough
HINTS = ("passw", "secret", "token", "api")  # one of them is in every key of ASSIGN
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
WORD = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
SIZE = 128


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, kind's place, kind, end) of the base matches, sorted."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, "hex", m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


def pairs(token: str) -> np.ndarray:
    b = np.frombuffer(token.encode("ascii"), np.uint8).astype(np.int64)
    return b[:-1] * SIZE + b[1:]


#: The alphabets that secrets are made of: hexadecimal, capitals with digits, letters with digits, and those of base 64 in both spellings.
ALPHABETS = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"]


def random_strings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(token, secret): ``n`` labelled random strings of 20 to 59 characters, the alphabets in turn, the same at every run."""
    alphabet = F.get(F.array(*map(F.lit, ALPHABETS)), (F.col("id") % len(ALPHABETS)).cast("int"))
    letter = lambda i: F.substring(alphabet, (F.pmod(F.xxhash64("id", i), F.length(alphabet)) + 1).cast("int"), F.lit(1))
    token = F.array_join(F.transform(F.sequence(F.lit(1), (20 + F.col("id") % 40).cast("int")), letter), "")
    return spark.range(n).select(token.alias("token"), F.lit(True).alias("secret"))


def labelled_tokens(docs: DataFrame, rows: int = 20_000) -> DataFrame:
    """(token, secret) from about ``rows`` texts, chosen by a hash: what the base patterns find is labelled a secret, every other word of eight or more characters an ordinary identifier. Repeated rows count once."""
    n = max(1, docs.count())
    chosen = docs.where("text is not null").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(min(1.0, rows / n) * (1 << 30))).dropDuplicates(["doc_id", "text"]).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens: list[str] = []
            secret: list[bool] = []
            for value in b.column(0):
                text, at = value.as_py(), 0
                for s, _, kind, e in [*base_spans(text), (len(text), 3, "", len(text))]:
                    if s < at:
                        continue
                    words = [m.group() for m in WORD.finditer(text, at, s)]
                    found = [ASSIGN.match(text, s).group(2) if kind == "assign" else text[s:e]] if kind else []
                    tokens += words + found
                    secret += [False] * len(words) + [True] * len(found)
                    at = e
            yield pa.RecordBatch.from_pydict({"token": pa.array(tokens, pa.string()), "secret": pa.array(secret, pa.bool_())})

    return chosen.mapInArrow(run, "token string, secret boolean")


def fit(labelled: DataFrame, weight: float = 5.0) -> np.ndarray:
    """The log-likelihood ratio of each character pair, counted on ``labelled(token, secret)``. A pair's share is smoothed towards its second character's, by ``weight`` pairs. Null tokens and characters outside ASCII are skipped."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, SIZE * SIZE), np.int64)
        for b in batches:
            for label in (False, True):
                joined = "\0".join(t for t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t is not None and s is label)
                seen[int(label)] += np.bincount(pairs(joined.encode("ascii", "replace").decode()), minlength=SIZE * SIZE)
        seen = seen.reshape(2, SIZE, SIZE)
        seen[:, 0] = seen[:, :, 0] = 0  # the borders between tokens
        k, c = np.nonzero(seen.reshape(2, -1))
        yield pa.RecordBatch.from_pydict({"kind": pa.array(k, pa.int64()), "pair": pa.array(c, pa.int64()), "n": pa.array(seen.reshape(2, -1)[k, c], pa.int64())})

    seen = np.zeros((2, SIZE, SIZE))
    for r in labelled.select("token", "secret").mapInArrow(count, "kind long, pair long, n long").groupBy("kind", "pair").agg(F.sum("n").alias("n")).collect():  # bounded: a row for each kind and pair
        seen[r["kind"]].flat[r["pair"]] = r["n"]
    alphabet = np.zeros(SIZE)
    alphabet[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = 1
    model = []
    for own, prior in zip(seen, (0.5, 1000.0), strict=True):  # random strings use the whole alphabet, whatever the sample has
        single = own.sum(axis=0) + prior * alphabet / alphabet.sum() + 1e-9
        model.append((own + weight * single / single.sum()) / (own.sum(axis=1, keepdims=True) + weight))
    return np.log(model[1] / model[0]).ravel()


def scan(text: str | None, ratio: np.ndarray, total: float = 10.0, each: float = 0.5) -> tuple[list[tuple[int, int, str, int]], list[tuple[int, int, str, int]]]:
    """Base spans, and the spans that the models add; those never overlap base ones."""
    text = text or ""
    base, added = base_spans(text), []
    taken = iter([*base, (len(text) + 1, 0, "", len(text) + 1)])
    s, e = (x := next(taken))[0], x[3]
    for m in TOKEN.finditer(text):
        while e <= m.start():
            s, e = (x := next(taken))[0], max(e, x[3])
        if s < m.end():
            continue
        value = float(ratio[pairs(m.group())].sum())
        if value >= total and value >= each * (m.end() - m.start()):
            added.append((m.start(), 3, "markov", m.end()))
    return base, added


def told(spans: list[tuple[int, int, str, int]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(spans))


def find_secrets(docs: DataFrame, ratio: np.ndarray, total: float = 10.0, each: float = 0.5) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans) for every whole text.

    Offsets are code points, end exclusive; a span is the whole match. A null text counts as
    empty. Repeated rows each give their row; an empty table gives an empty result; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [scan(t.as_py(), ratio, total, each) for t in b.column(1)]
            kinds = [pa.array([sum(x[1] == k for x in base) for base, _ in got], pa.int64()) for k in range(3)]
            digests = pa.array([hashlib.sha256(told(base).encode()).hexdigest() for base, _ in got])
            yield pa.RecordBatch.from_arrays([b.column(0), *kinds, pa.array([len(a) for _, a in got], pa.int64()), digests, pa.array([told(base + a) for base, a in got])], ["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")
