"""Phrase collocations against brute force and against SQL."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fieldleaf.llm import collocations
from fieldleaf.llm.queries import QUERIES
from tests.against import assert_same, connect


def brute(rows, least, top, inside=100):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        frequent = {w: a for w, a in own.items() if len(w) > 1 and a >= least}
        covered = {w[i : i + m] for w, a in frequent.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if 100 * a >= inside * own[w[i : i + m]]}
        told = []
        for w, a in frequent.items():
            if w not in covered:
                score, _, left, right = min((1000 * a * n[lang] // (own[w[:k]] * own[w[k:]]), k, own[w[:k]], own[w[k:]]) for k in range(1, len(w)))
                told.append((-score, -a, " ".join(w).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(told)[:top])]
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    words = ["a", "b", "Ab", "ß", "c d", "ÄB", "x1", "e"]
    texts = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ";"]) for _ in range(rng.choice([0, 1, 5, 200])))) for _ in range(60)]
    return texts + [("en", None), ("en", ""), ("en", " .,"), *[("hot", "the same pair again and the same pair " * 30)] * 3, (None, "A A a a a a")]


@pytest.mark.parametrize("least, route_rows, block_words, inside", [(3, 200_000, 2_000_000, 100), (5, 40, 500, 100), (4, 1000, 100, 60)])
def test_against_brute_force(spark, least, route_rows, block_words, inside):
    """Blocks of several texts, pairs dealt over several tasks, ties, repeated rows and other columns."""
    rows = made(least)
    df = spark.createDataFrame([(lang, text, 1, "x") for lang, text in rows], "lang string, text string, n int, word string").repartition(3)
    got = collocations.collocations(df, least, 25, inside, block_words, route_rows).collect()
    assert sorted(map(tuple, got)) == brute(rows, least, 25, inside)


def test_empty(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(df).count() == 0


def test_full_fields(spark, monkeypatch):
    """Fields in which everything is set let more through and change nothing."""
    monkeypatch.setattr(collocations, "FIELD_BITS", (64, 64))
    rows = made(9)
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), 6).collect()
    assert sorted(map(tuple, got)) == brute(rows, 6, 2000)


def test_shared_hashes(spark):
    """Words that share their hash under one seed are told apart under the next."""
    texts = [("en", "p q r p q r p q s"), ("en", "p q")]
    weak = lambda word, seed: word[-1] % 2 + 1 if seed == 0 else word[-1]
    got = collocations.collocations(spark.createDataFrame(texts, "lang string, text string"), 2, hashed=weak).collect()
    assert sorted(map(tuple, got)) == brute(texts, 2, 2000)


def test_quicksort():
    rng = np.random.default_rng(3)
    words = rng.integers(1, 4, (500, 5)).astype(np.uint64)
    for k in range(500):
        words[k, rng.integers(2, 6) :] = 0
    words = words[np.argsort(words[:, 0], kind="stable")]
    weight = rng.integers(1, 5, 500)
    want = Counter()
    for w, n in zip(words.tolist(), weight.tolist(), strict=True):
        for k in range(1, 6):
            if 0 not in w[:k]:
                want[tuple(w[:k])] += n
    segment = words[:, 0].astype(np.int64) - 1
    found = {tuple(words[i, :length].tolist()): int(n) for at, length, total in collocations.quicksort(words, weight, segment, np.full(3, 30)) for i, n in zip(at, total, strict=True)}
    assert found == {w: n for w, n in want.items() if n >= 30}


def test_query_against_sql(spark, sf):
    assert_same(QUERIES["op13_collocations"](spark, sf), connect(sf), collocations.SQL)
