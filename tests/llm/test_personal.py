"""Personal data: base patterns against the plain regular expressions, Viterbi and likelihood against all paths, held-out accuracy."""

import hashlib
import itertools
import random
import re

import numpy as np

from fieldleaf.llm import personal
from fieldleaf.llm.queries import QUERIES

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, found):
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m.group())]


def test_base_spans():
    rng = random.Random(4)
    bits = ["a", "b.c", "@", "@", ".", "-", "+", "1", "22", "255", "256", "003", " ", " ", "(", ")", "4111 1111 1111 1111", "79927398713", "1.2.3.4", "+49 30 123456", "x@y.de", "é", "\n", "%", "0", "12345678901234"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))
        assert personal.told(personal.base_spans(text)).split(",") == (brute(text) or [""]), text


def test_long_texts_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "a@" * 200_000, "1." * 200_000, "+1(" * 100_000, "1 " * 200_000):
        personal.base_spans(text)


def scores(emit, moves, path):
    return sum(emit[t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path))


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    moves = rng.normal(size=(personal.LABELS, personal.LABELS)).astype(np.float32)
    sizes = [1, 4, 2, 3, 4, 1]
    emit = rng.normal(size=(sum(sizes), personal.LABELS)).astype(np.float32)
    starts = np.r_[0, np.cumsum(sizes)][:-1]
    got = personal.viterbi(emit, moves, starts)
    for s, n in zip(starts.tolist(), sizes, strict=True):
        best = max(itertools.product(range(personal.LABELS), repeat=n), key=lambda p: scores(emit[s : s + n], moves, p))
        assert got[s : s + n].tolist() == list(best)


def test_sure_words_change_no_path():
    """Decoding between sure words gives what decoding all of a text at once gives."""
    rng = np.random.default_rng(6)
    words = sorted(personal.CUES)[:30]
    weights = rng.normal(size=(30, 3, personal.LABELS)).astype(np.float32)
    weights[:20, 1, 0] += 12
    moves = rng.normal(size=(personal.LABELS, personal.LABELS)).astype(np.float32)
    model = personal.Model({f"cue {w}": k for k, w in enumerate(words)}, weights, moves)
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 3, 200, 50)]
    got = personal.label_texts(texts, model, {}, [np.zeros((3, personal.LABELS), np.float32)], {})
    for text, labels in zip(texts, got, strict=True):
        own = [model.emission(w) for w in text.split()]
        emit = np.array([o[1] + (own[t - 1][2] if t else 0) + (own[t + 1][0] if t + 1 < len(own) else 0) for t, o in enumerate(own)]).reshape(-1, personal.LABELS)
        edge = np.full((1, personal.LABELS), 0, np.float32)
        edge[0, 0] = personal.SURE
        whole = personal.viterbi(np.concatenate([edge, emit, edge]).astype(np.float32), moves, np.array([0]))
        assert labels[: len(own)].tolist() == whole[1:-1].tolist()


def test_likelihood():
    """Without features only transitions are learned, and their marginals become the labelled shares."""
    rows = [([""] * 6, y) for y in ([0, 1, 1, 0, 0, 2], [0, 0, 1, 1, 0, 0], [2, 0, 0, 1, 1, 0])]
    model = personal.fit_words(rows, least=10**6, penalty=1e-4, steps=400)
    want, expected = np.zeros((personal.LABELS,) * 2), np.zeros((personal.LABELS,) * 2)
    for _, y in rows:
        for a, b in itertools.pairwise(y):
            want[a, b] += 1
    paths = list(itertools.product(range(personal.LABELS), repeat=6))
    weights = np.exp([scores(np.zeros((6, personal.LABELS)), model.moves, p) for p in paths])
    for p, w in zip(paths, weights / weights.sum(), strict=True):
        for a, b in itertools.pairwise(p):
            expected[a, b] += 3 * w
    assert np.abs(want - expected).max() < 0.3


def test_held_out(spark):
    """Words of made items, of another seed and other texts than it was trained on, and untouched words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = personal.fit(personal.labelled(docs.where("doc_id % 2 = 0")))
    rows = personal.labelled(docs.where("doc_id % 2 = 1"), seed=99).collect()
    got = personal.label_texts([" ".join(r["words"]) for r in rows], model, {}, [np.zeros((3, personal.LABELS), np.float32)], {})
    pairs = [(y, g) for r, x in zip(rows, got, strict=True) for y, g in zip(r["labels"], x.tolist(), strict=False)]
    hit, given, told = sum(y == g > 0 for y, g in pairs), sum(g > 0 for _, g in pairs), sum(y > 0 for y, _ in pairs)
    assert hit / told >= 0.93
    assert hit / given >= 0.93


def test_query(spark, sf):
    """Base columns by the plain patterns over whole texts; added spans never touch base ones and are few in texts that were given none."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op12_personal"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        base = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(x.startswith(k + ":") for x in base) for k in PATTERNS]
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert [":".join(x) for x in spans[: len(base)]] == base and len(spans) - len(base) == r["n_crf"]
        taken = {p for _, s, e in spans[: len(base)] for p in range(int(s), int(e))}
        assert all(taken.isdisjoint(range(int(s), int(e))) for _, s, e in spans[len(base) :])
    assert sum(r["n_crf"] for r in got) <= len(texts) // 50


def test_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = personal.fit(personal.labelled(docs))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "card 4111.1111.1111.1111 and SSN 123-45-6789, mail anna(at)berg(dot)com"), (4, "x@y.de"), (4, "x@y.de"), (None, "call (377) 555-0271 now"), (5, "w " * 20_000 + "1.2.3.4")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, spans string, words int").repartition(2)
    got = {(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]): r["spans"] for r in personal.find_personal(df, model).collect()}
    assert len(personal.find_personal(df, model).collect()) == len(rows)
    assert got[1, 0, 0, 0, 0] == got[2, 0, 0, 0, 0] == got[3, 0, 0, 0, 0] == ""
    assert got[4, 1, 0, 0, 0] == "email:0:6" and got[5, 0, 1, 0, 0] == "ip:40000:40007"
    assert got[4, 0, 0, 0, 0] == "crf_email:51:71,crf_card:5:24,crf_id:33:44"
    assert got[None, 0, 0, 0, 0] == "crf_phone:5:19"
    assert personal.find_personal(df.where("doc_id = -1"), model).count() == 0
    none = personal.fit(personal.labelled(df.where("doc_id = -1")))
    assert {r["n_crf"] for r in personal.find_personal(df, none).collect()} == {0}
