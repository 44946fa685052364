"""Each text operator against brute force, and on rows that are odd in every way."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldleaf.llm import bpe, decontaminate, language, lines, media, passages, secrets, simhash, substrings, toxicity
from fieldleaf.llm.common import components, stored
from fieldleaf.llm.queries import QUERIES, vocabulary
from tests.against import assert_same, connect

ODD = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "word"), (1003, "word"), (None, "no number"), (1004, "a" * 3000), (1005, "long words " * 4000), (1006, "İ ΑΣ é 12 <|endoftext|> 　x"), (1007, "%%% 123 ...")]


def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named like the operators' own."""
    df = spark.createDataFrame(ODD, "doc_id long, text string").repartition(2)
    names = ["score", "fp", "block", "lines", "later", "pairs", "row", "text_hash", "key", "a", "b", "lang", "source", "n_chars", "hub", "kept_text", "toxic", "held_out", "n", "rep", "h1", "h2", "anchor", "class_id", "component", "node", "label", "starts", "line", "gone", "media", "tiles", "secret", "token"]
    return df.withColumns({n: F.lit(None).cast("long" if n in ("n_chars", "score") else "string") for n in names})


def empty(spark):
    return odd(spark).where("doc_id = -1")


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in documents(spark, sf).select("doc_id", "text").collect()}


def labels(spark):
    return spark.createDataFrame([(i, 0) for i in (1003, 1004, 1006, 1007)] + [(1005, 1), (None, 1), (1001, None)], "doc_id long, toxic int")


WHOLE = {
    "language": lambda s, d: language.languages(d.withColumn("lang", F.lit("en"))),
    "passages": lambda s, d: passages.repeated_passages(d),
    "bpe": lambda s, d: bpe.encode(d, vocabulary()),
    "media": lambda s, d: media.stored_media(d),
    "substrings": lambda s, d: substrings.dedup(d),
    "secrets": lambda s, d: secrets.find_secrets(d, secrets.fit(secrets.labelled_tokens(d))),
    "toxicity": lambda s, d: toxicity.toxic_documents(d, labels(s)),
    "lines": lambda s, d: lines.report(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", WHOLE)
def test_odd_rows(spark, name):
    got = [r["doc_id"] for r in WHOLE[name](spark, odd(spark)).collect()]
    assert sorted(map(str, got)) == sorted(str(i) for i, _ in ODD)
    assert WHOLE[name](spark, empty(spark)).count() == 0


def test_stages_on_odd_rows(spark):
    bench = spark.createDataFrame([(1, "not in there at all, never"), (2, None), (3, "")], "item_id long, text string")
    model = toxicity.fit(odd(spark), labels(spark))
    for stage in (lambda d: toxicity.keep_clean(d, model), lines.dedup, simhash.keep_one, lambda d: decontaminate.clean(d, bench)):
        out = stage(odd(spark))
        assert out.columns == odd(spark).columns
        assert {1003, 1004, 1006} <= {r["doc_id"] for r in out.collect()}
        assert stage(empty(spark)).count() == 0
    assert decontaminate.contaminated(odd(spark), bench).count() == 0
    assert decontaminate.contaminated(odd(spark), bench.where("item_id = -1")).count() == 0


def test_language(spark, sf):
    df = documents(spark, sf)
    got = language.languages(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) == df.where("crc32(cast(doc_id as string)) % 5 = 0").count()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.95
    told = {r["doc_id"]: r["lang_pred"] for r in language.predict(odd(spark), language.fit(df)).collect()}
    assert [told[i] for i in (1000, 1001, 1002, 1007)] == ["und"] * 4
    assert told[1005] != "und"


def test_nearest_centroid(spark, sf):
    """Each prediction against cosines told one by one, ties to the first language; a text far from its centroid isn't accepted."""
    df = documents(spark, sf)
    model = language.fit(df.where(~language.held_out()))
    rows = [r for r in language.predict(df.where("doc_id < 60"), model).collect() if r["lang_pred"] != "und"]
    own = texts(spark, sf)
    for r in rows:
        n = language.counts(own[r["doc_id"]])
        v = {i: (1 + np.log(n[i])) * model.idf[i] for i in np.flatnonzero(n).tolist()}
        size = sum(x * x for x in v.values()) ** 0.5
        near = defaultdict(lambda: -1.0)
        for k, c in zip(model.owner.tolist(), model.centroids, strict=True):
            near[k] = max(near[k], sum(x * c[i] for i, x in v.items()) / size)
        best = max(near.values())
        assert near[model.langs.index(r["lang_pred"])] >= best - 1e-5
        assert r["cosine"] == pytest.approx(best, abs=1e-4)
        assert r["accepted"] == (r["cosine"] >= model.floor[model.langs.index(r["lang_pred"])])
        assert r["score"] == pytest.approx(1 / sum(np.exp(20 * (x - best)) for x in near.values()), abs=1e-2)
    strange = language.predict(spark.createDataFrame([(1, "zzzz qqqq xxxx jjjj " * 20)], "doc_id long, text string"), model).first()
    assert not strange["accepted"]


def test_compact_windows():
    rng = np.random.default_rng(1)
    for n, least in ((30, 5), (1, 1), (4, 5), (60, 8)):
        v = rng.integers(0, 40, n).astype(np.uint64) << np.uint64(44)  # hashes are told apart by their high bits
        found = passages.compact_windows(v, np.array([0]), np.array([n]), least).T.tolist()
        held = {(i, j): v[c] for a, c, b in found for i in range(a, c + 1) for j in range(c + 1, b + 1) if j - i >= least}
        assert held == {(i, j): v[i:j].min() for i in range(n) for j in range(i + least, n + 1)}
    assert passages.compact_windows(np.zeros(5000, np.uint64), np.array([0]), np.array([5000]), 46).shape[1] < 5000
    many = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    parts = np.r_[0, 20, 20, 130], np.r_[20, 20, 130, 300]
    each = [passages.compact_windows(many[a:b], np.array([0]), np.array([b - a]), 7) + a for a, b in zip(*parts, strict=True)]
    assert sorted(passages.compact_windows(many, *parts, 7).T.tolist()) == sorted(np.concatenate(each, axis=1).T.tolist())


def test_passages(spark, sf):
    own = texts(spark, sf)
    got = {r["doc_id"]: r for r in passages.repeated_passages(documents(spark, sf)).collect()}
    runs = defaultdict(set)
    for i, x in own.items():
        w = x.lower().split()
        for p in range(len(w) - 49):
            runs[tuple(w[p : p + 50])].add(i)
    shared = [v for v in runs.values() if len(v) > 1]
    assert shared
    assert all(len({got[i]["class_id"] for i in v}) == 1 for v in shared)
    by_class = defaultdict(list)
    for i, r in got.items():
        by_class[r["class_id"]].append(i)
    tokens = {i: set(passages.tokens(x).tolist()) for i, x in own.items()}
    for members in by_class.values():  # nothing is put together that shares nothing
        for i in members:
            assert len(members) == 1 or any(tokens[i] & tokens[j] or own[i] == own[j] for j in members if i != j)


def test_near_passage(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    shared = [word() for _ in range(150)]
    edited = list(shared)
    edited[70] = word()
    rows = [(1, " ".join([word() for _ in range(90)] + shared + [word() for _ in range(80)])), (2, " ".join([word() for _ in range(200)] + edited)), (3, " ".join(word() for _ in range(300)))]
    got = {r["doc_id"]: r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["class_id"] for i in (1, 2, 3)] == [1, 1, 3]
    assert got[1]["similarity"] >= 0.8
    assert got[3]["passage_start"] is None


def test_recall_of_near_passages(spark):
    """Planted passages of 50 to 200 words with one to four words changed: of the pairs whose passages have a similarity of 0.8 or more nearly all are linked, and no pair of other texts."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows, near = [], []
    for k in range(200):
        shared = [word() for _ in range(rng.choice([50, 60, 80, 100, 150, 200]))]
        edited = list(shared)
        for i in rng.sample(range(len(edited)), rng.randint(1, 4)):
            edited[i] = word()
        a, b = (set(zip(*(v[i:] for i in range(5)), strict=False)) for v in (shared, edited))
        near += [k] * (len(a & b) >= 0.8 * len(a | b))
        rows += [(2 * k + side, " ".join([word() for _ in range(rng.randint(0, 120))] + x + [word() for _ in range(rng.randint(0, 120))])) for side, x in enumerate((shared, edited))]
    got = {r["doc_id"]: r["class_id"] for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) >= 60
    assert sum(got[2 * k + 1] == 2 * k for k in near) >= 0.95 * len(near)
    assert all(c in (i, i - 1) for i, c in got.items())


def test_overlaps():
    rng = random.Random(22)
    sets = [np.unique(np.array(rng.choices(range(60), k=rng.randint(0, 20)), np.uint32)) for _ in range(90)]
    want = [[len(set(x.tolist()) & set(y.tolist())) if i != j else None for j, y in enumerate(sets)] for i, x in enumerate(sets)]
    got = passages.overlaps(sets, often=12)
    assert all(want[i][j] is None or got[i, j] == want[i][j] for i in range(90) for j in range(90))


def brute_passage(a, b, least, similarity):
    """Whether any two stretches of at least ``least`` tokens are similar enough, all of them tried."""
    at = {v: i for i, v in enumerate(sorted({*a.tolist(), *b.tolist()}))}
    masks = []
    for x in (a, b):
        own = set()
        for s in range(len(x) - least + 1):
            mask = 0
            for e in range(s, len(x)):
                mask |= 1 << at[int(x[e])]
                if e - s + 1 >= least:
                    own.add(mask)
        masks.append(own)
    return any((p & q).bit_count() >= similarity * (p | q).bit_count() - 1e-12 for p in masks[0] for q in masks[1])


def test_short_near_passages():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    wanted = []
    for size in range(50, 91, 10):
        for edits in (1, 2):
            shared = [word() for _ in range(size)]
            edited = list(shared)
            for i in [size // 2] if edits == 1 else rng.sample(range(size), 2):
                edited[i] = word()
            a, b = (passages.tokens(" ".join([word() for _ in range(6)] + x + [word() for _ in range(6)])) for x in (shared, edited))
            found = passages.verified(a, b, 50, 0.8)
            wanted.append(brute_passage(a, b, 46, 0.8))
            assert (found is not None) == wanted[-1]
            assert found is None or found[4] >= 0.8 and found[1] - found[0] >= 50 and found[3] - found[2] >= 50
    assert sum(wanted) >= 5


def test_passages_against_brute_force():
    rng = random.Random(6)
    for _ in range(400):
        kinds = rng.choice([4, 8, 20, 1000])
        base = [rng.randrange(kinds) for _ in range(rng.randint(4, 14))]
        sides = []
        for _ in range(2):
            x = list(base)
            for _ in range(rng.randint(0, 4)):
                i = rng.randrange(len(x))
                x[i : i + 1] = rng.choice([[rng.randrange(kinds)], [x[i], rng.randrange(kinds)], [] if len(x) > 1 else [x[i]]])
                x = x[i:] + x[:i] if rng.random() < 0.2 else x
            sides.append(np.array([rng.randrange(kinds) for _ in range(rng.randint(0, 4))] + x + [rng.randrange(kinds) for _ in range(rng.randint(0, 4))], np.uint64))
        least, similarity = rng.choice([3, 4, 6]), rng.choice([0.6, 0.8])
        assert (passages.verified(*sides, least + passages.WIDTH - 1, similarity) is not None) == brute_passage(*sides, least, similarity)


def test_bpe(spark, sf):
    coder = bpe.tokenizer(vocabulary())
    df = odd(spark).select("doc_id", "text").unionByName(documents(spark, sf).select("doc_id", "text"))
    got = bpe.encode(df, vocabulary(), block_words=20_000, buckets=7)
    want = defaultdict(list)
    for i, x in df.collect():
        ids = coder.encode(x or "", add_special_tokens=False).ids
        want[i].append((ids, coder.decode(ids, skip_special_tokens=False)))
    seen = 0
    for r in got.collect():
        ids, said = list(r["ids"]), r["decoded"]
        assert (ids, said) in want[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
        seen += 1
    assert seen == df.count()
    some = got.where("doc_id < 50")
    back = {r["doc_id"]: r["text"] for r in bpe.decode(some, vocabulary()).collect()}
    assert back == {r["doc_id"]: r["decoded"] for r in some.collect()}


def test_media(spark, sf):
    got = {r["doc_id"]: r for r in media.stored_media(documents(spark, sf)).collect()}
    for i, x in texts(spark, sf).items():
        b = x.encode()
        b = b.ljust(-(-max(1, len(b)) // 192) * 192)
        r = got[i]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), hashlib.sha256(b).hexdigest(), zlib.crc32(b[-16:]))
        assert r["media_sha256"] == hashlib.sha256(media.wav(b)).hexdigest()
        assert media.samples_of(media.wav(b))[0] == b
    some = documents(spark, sf).where("doc_id < 6")
    table = media.as_tensors(media.tensors(media.to_media(some)).orderBy("doc_id", "tile").toArrow())
    assert table["log_mel"].type.shape == [media.TILE, media.MELS]
    held = table["log_mel"].combine_chunks().to_numpy_ndarray()
    for i in range(6):
        x = texts(spark, sf)[i].encode()
        _, rows, spans, rate = media.analyse(media.wav(x.ljust(-(-max(1, len(x)) // 192) * 192)))
        mine = [k for k, d in enumerate(table["doc_id"].to_pylist()) if d == i]
        assert np.array_equal(held[mine].reshape(-1, media.MELS)[: len(rows)], np.round(rows * 100).astype(np.int16))
        assert table["start_s"][mine[0]].as_py() == 0 and table["end_s"][mine[-1]].as_py() == ((len(rows) - 1) * media.HOP + media.FRAME) / rate
        assert got[i]["n_frames"] == len(rows) and got[i]["n_voiced"] == len(spans)


def test_log_mel():
    """The filterbank against a plain discrete Fourier transform of each frame."""
    x = np.random.default_rng(2).normal(size=700)
    rows, energy = media.log_mel(x, 6000)
    assert len(rows) == -(-(700 - media.FRAME) // media.HOP) + 1
    padded = np.r_[x, np.zeros(media.FRAME)]
    t = np.arange(media.FRAME)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, 2595 * np.log10(1 + 3000 / 700), media.MELS + 2)]
    for k in range(len(rows)):
        frame = padded[k * media.HOP : k * media.HOP + media.FRAME]
        assert energy[k] == pytest.approx(10 * np.log10((frame**2).mean()))
        windowed = frame * (0.5 - 0.5 * np.cos(2 * np.pi * t / (media.FRAME - 1)))
        power = [abs((windowed * np.exp(-2j * np.pi * t * q / media.FRAME)).sum()) ** 2 for q in range(media.FRAME // 2 + 1)]
        for m in (0, 7, 31):
            left, mid, right = edges[m : m + 3]
            share = [max(0.0, min((f - left) / (mid - left), (right - f) / (right - mid))) for f in (q * 6000 / media.FRAME for q in range(media.FRAME // 2 + 1))]
            assert rows[k, m] == pytest.approx(np.log10(max(np.dot(share, power), 1e-10)), abs=1e-4)


def test_resampling():
    x = np.random.default_rng(0).normal(size=500)
    up = np.zeros(len(x) * media.UP)
    up[:: media.UP] = x
    h = media.filters()[:, ::-1].T.ravel()
    plain = np.convolve(up, h)[: len(up)][:: media.DOWN]
    assert np.allclose(media.resample(x), plain)
    e = np.r_[np.zeros(5), np.full(3, 5.0), np.full(2, 0.5), np.full(4, -1.0), np.zeros(5)]
    assert media.voiced(e).tolist() == [[5, 10]]


def brute_substrings(rows, length=50):
    first = {}
    for i, x in rows:
        b = (x or "").encode()
        for p in range(len(b) - length + 1 if i is not None else 0):
            w = b[p : p + length]
            first[w] = min(first.get(w, i), i)
    for i, x in rows:
        b = (x or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1 if i is not None else 0):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(gone)))
        yield i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()


@pytest.mark.parametrize("limits", [{}, {"hot_rows": 3, "block_bytes": 60_000}])
def test_substrings(spark, sf, limits):
    more = spark.createDataFrame([(2002, "a" * 300), (2003, "a" * 200 + "b" * 60), (2004, "a" * 200 + "b" * 60), (2004, "é" * 100), (2005, "é" * 90), (2006, "x" * 49), (2007, "x" * 49)], "doc_id long, text string")
    df = documents(spark, sf).select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text")).unionByName(more)
    by = lambda rows: sorted(map(tuple, rows), key=str)
    assert by(substrings.dedup(df, with_text=False, **limits).collect()) == by(brute_substrings([tuple(r) for r in df.collect()]))


def test_interval_tree():
    words = sorted(["abcab", "abcde", "abd", "b", "bc", "abc"])
    lcp = [0] + [substrings.common(a.encode(), b.encode()) for a, b in zip(words, words[1:], strict=False)]
    assert {(words[a:b][0][:d], b - a) for a, b, d in substrings.intervals(lcp, 1)} == {("ab", 4), ("abc", 3), ("b", 2)}


def test_edit_distance():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rng.choices("abé", k=rng.randint(0, 12))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        assert decontaminate.edit_distance(a, b) == row[-1]


@pytest.mark.parametrize("share", [6, 10, 15])
def test_decontamination_recall(spark, sf, share):
    own = list(texts(spark, sf).values())
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rng, rows = random.Random(1), []
    for k, (i, x) in enumerate(bench):
        y = list(x)
        for _ in range(len(x) * share // 100):
            p = rng.randrange(len(y))
            y[p] = rng.choice(["", rng.choice("abcdefgh"), y[p] + rng.choice("abcdefgh")])
        rows.append((i, own[k + 20][:300] + " " + "".join(y) + " " + own[k + 60][:300]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    hits = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, items, block_bytes=3000).collect()}
    assert np.mean([(i, i) in hits for i, _ in bench]) >= 0.9
    exact = {(i, k) for i, x in texts(spark, sf).items() for k, y in bench if " ".join(y.lower().split()) in " ".join(x.lower().split())}
    found = decontaminate.contaminated(documents(spark, sf), items).collect()
    assert exact <= {(r["doc_id"], r["item_id"]) for r in found}
    dirty = {r["doc_id"] for r in found}
    kept = decontaminate.clean(documents(spark, sf), items).collect()
    assert {r["doc_id"] for r in kept} == set(texts(spark, sf)) - dirty and {r["doc_id"]: r["text"] for r in kept}.items() <= texts(spark, sf).items()
    for r in found:  # the distance told is that of the words told
        words = " ".join(texts(spark, sf)[r["doc_id"]].lower().split()[r["start_word"] : r["end_word"]])
        assert decontaminate.edit_distance(words, " ".join(dict(bench)[r["item_id"]].lower().split())) == r["distance"]


def test_decontamination_of_common_words(spark, sf):
    """Items are found though their words and pairs of words are those of many other items of the block, with a fifth of their characters edited."""
    rng = random.Random(6)
    own = [x for x in texts(spark, sf).values() if x]
    words = [w for x in own for w in x.split()]
    bench = [(i, " ".join(words[at : at + rng.randint(25, 55)])) for i, at in enumerate(rng.sample(range(len(words) - 60), 1500))]
    rows = []
    for _, x in bench[:100]:
        y = list(x)
        for _ in range(len(x) // 5):
            p = rng.randrange(len(y))
            y[p] = rng.choice(["", rng.choice("abcdefgh"), y[p] + rng.choice("abcdefgh")])
        rows.append(decontaminate.normal("before it " + "".join(y) + " after it"))
    items = decontaminate.prepare(bench, 2, 16, 8)
    hits = {(k, i) for k, i, *_ in decontaminate.matches(rows, items, 0.8)}
    assert np.mean([(k, k) in hits for k in range(len(rows))]) >= 0.95


def test_windows_by_brute_force():
    """The nearest of all windows that count, and no more than the least distance from the many tables at once; items of few bytes too."""
    rng = random.Random(8)
    line = lambda n: ["".join(rng.choices("abé", k=rng.randint(1, 4))) for _ in range(n)]
    for _ in range(40):
        item, words = " ".join(line(rng.randint(1, 5))), [w.encode() for w in line(8)]
        every = [(decontaminate.edit_distance(item, x), s, e) for s in range(8) for e in range(s + 1, 9) if decontaminate.edit_distance(item, x := b" ".join(words[s:e]).decode()) <= 0.4 * max(len(item), len(x)) + 1e-9]
        assert decontaminate.nearest(words, item, 0.6) == min(every, default=None)
    bench = [(i, "".join(rng.choices("abc é", k=n))) for i, n in enumerate([2, 5, 9, 17, 40, 63, 64, 65, 130, 700])]
    items = decontaminate.prepare(bench, 2, 16, 8)
    text = "".join(rng.choices("abc é", k=1000))
    n = np.arange(len(items.ids))
    least = items.least(decontaminate.small(text), n * 7, n * 50 + 300, n)
    assert all(d <= min(decontaminate.distances(items.texts[i].decode(), text[i * 7 : i * 50 + 300])) for i, d in enumerate(least.tolist()))
    found = decontaminate.matches([[b"x", *t.split(), b"y"] for t in items.texts], items, 0.8)
    assert {(i, i, 0) for i in n.tolist()} <= {(k, i, d) for k, i, *_, d in found}


def test_long_items():
    """An item of 100,000 characters needs no table that grows with it, and is found with some edits."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(14_000)]
    items = decontaminate.prepare([(1, " ".join(words)), (2, "two words")], 4, 64, 3)
    edited = [w if k % 3000 else "x" for k, w in enumerate(words)]
    text = [b"before"] * 50 + [w.encode() for w in edited] + [b"after"] * 50
    found = decontaminate.matches([text, [b"only", b"two", b"words"]], items, 0.8)
    assert [(k, i) for k, i, *_ in found] == [(0, 0), (1, 1)]


def test_secrets(spark):
    rng = random.Random(2)
    token = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40))
    rows = [(1, f"é Password: 'hunter22' api_key=abc token=abcdef {'AKIA' + 'B' * 16} {'AKIA' + 'B' * 15} {'ab12' * 6} {'ab12' * 5}"), (2, f"see {token} here"), (3, "internationalization of the responsibilities thesethingsareordinary")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = spark.createDataFrame([(i, "the_ordinary_identifier getResponseHandler internationalization responsibilities " + "".join(rng.choices("0123456789abcdef", k=32))) for i in range(50)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.find_secrets(df, secrets.fit(secrets.labelled_tokens(words))).collect()}
    want = []
    for k, (kind, pattern, least, group) in enumerate([("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1), ("access", "AKIA[A-Z0-9]+", 20, 0), ("hex", "[0-9a-f]+", 24, 0)]):
        want += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, rows[0][1], re.IGNORECASE if kind == "assign" else 0) if len(m.group(group)) >= least]
    assert got[1]["base_sha256"] == hashlib.sha256(",".join(x for *_, x in sorted(want)).encode()).hexdigest()
    assert (got[1]["n_assign"], got[1]["n_access"], got[1]["n_hex"]) == (2, 1, 1)
    assert got[2]["spans"] == "markov:4:44"
    assert got[3]["spans"] == ""


def test_secrets_added(spark, sf):
    """Random strings of five alphabets planted in the texts of the table are added; ordinary words are not."""
    rng = random.Random(12)
    docs = documents(spark, sf)
    model = secrets.fit(secrets.labelled_tokens(docs).unionByName(secrets.random_strings(spark)))
    own = list(texts(spark, sf).values())[:100]
    rows, want = [], set()
    for k, x in enumerate(own):
        token = "".join(rng.choices(secrets.ALPHABETS[k % 5].replace("abcdef", "abcdeg"), k=rng.randint(22, 40)))
        rows.append((k, f"{token} {x}"))
        want.add((k, f"markov:0:{len(token)}"))
    found = {(r["doc_id"], s) for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), model).collect() for s in r["spans"].split(",") if s.startswith("markov")}
    assert len(found & want) >= 90
    assert len(found - want) <= 5


def test_maximal_segments():
    rng = random.Random(7)
    for _ in range(60):
        x = [rng.choice([-1.0, -1.0, 2.0, 0.5, -3.0]) for _ in range(rng.randint(0, 25))]
        told = [(i, v) for i, v in enumerate(x) if v != -1.0]

        def best(a, b, x=x):  # the definition: the highest segment, then both sides of it
            runs = [(sum(x[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1) if sum(x[i:j]) > 0]
            if not runs:
                return []
            _, _, i, j = max(runs)
            return [*best(a, i), (i, j), *best(j, b)]

        got = toxicity.maximal_segments([i for i, _ in told], [v for _, v in told], 1.0)
        assert sum(s for *_, s in got) == pytest.approx(sum(sum(x[i:j]) for i, j in best(0, len(x))))
        assert all(s == pytest.approx(sum(x[i:j])) for i, j, s in got)


def test_toxicity(spark):
    rng = random.Random(4)
    plain = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows = []
    for i in range(600):
        w = rng.choices(plain, k=80)
        if i % 5 == 0:
            for p in rng.sample(range(80), 3):
                w[p] = rng.choice(["vile", "nasty"])
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxic_documents(df, df.select("doc_id", "toxic"), 300).collect()}
    assert all((got[i]["predicted"] == 1) == bool(y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    model = toxicity.fit(df, df.select("doc_id", "toxic"))
    for r in toxicity.passages(df.where("doc_id = 5"), model).collect():
        assert rows[5][1][r["start"] : r["end"]] == r["passage"]


def test_lines_against_sql(spark, sf):
    assert_same(QUERIES["op9_lines"](spark, sf), connect(sf), lines.SQL)


@pytest.mark.parametrize("min_run", [1, 2, 3, 5])
def test_runs_of_lines(spark, min_run):
    rng = random.Random(min_run)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", " ", "d"]) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    first = {}
    for i, x in sorted(rows):
        own = x.split("\n")
        for p in range(len(own) - min_run + 1):
            w = tuple(own[p : p + min_run])
            if any(v.strip(" ") for v in w):
                first.setdefault(w, (i, p))
    want = {}
    for i, x in rows:
        own = x.split("\n")
        gone = {q for p in range(len(own) - min_run + 1) for w in [tuple(own[p : p + min_run])] if w in first and first[w] < (i, p) for q in range(p, p + min_run)}
        want[i] = (len(own), len(gone), "\n".join(v for q, v in enumerate(own) if q not in gone))
    got = lines.kept_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_run).select("row.doc_id", "n_lines", "n_deleted", "kept_text").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want


def test_intervals_of_lines(spark):
    """Every repeated run of 2, 4, 8 lines with all its places, against all runs counted."""
    rng = random.Random(8)
    block = [f"line {k}" for k in range(9)]
    rows = [(i, "\n".join([*rng.choices("abc", k=rng.randint(0, 4)), *block[rng.randint(0, 3) : rng.randint(4, 9)], *rng.choices("abc", k=3)])) for i in range(30)]
    places = defaultdict(list)
    for i, x in {x: i for i, x in reversed(rows)}.items() and [(i, x) for x, i in {x: i for i, x in reversed(rows)}.items()]:
        own = x.split("\n")
        for length in (2, 4, 8, 16):
            for p in range(len(own) - length + 1):
                places[length, tuple(own[p : p + length])].append((i, p))
    want = {(length, *min(v), *place) for (length, _), v in places.items() if len(v) > 1 for place in v}
    got = {tuple(r) for r in lines.intervals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and {2, 4, 8} == {r[0] for r in got}


def test_repeated_rows_of_lines(spark):
    """Rows that repeat a document are judged line by line like a single one; lines 10 to 12 are a later copy."""
    x, y = [f"first {k}" for k in range(30)], [f"second {k}" for k in range(30)]
    y[10:13] = x[4:7]
    rows = [(1, "\n".join(x)), (2, "\n".join(y)), (2, "\n".join(y)), (2, "\n".join(y))]
    got = lines.kept_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "n_lines", "n_deleted", "n_runs", "kept_text").collect()
    whole, cut = (1, 30, 0, 0, "\n".join(x)), (2, 30, 3, 1, "\n".join(y[:10] + y[13:]))
    assert sorted(map(tuple, got)) == [whole, cut, cut, cut]


def test_line_stage_deletes_single_lines(spark, sf):
    """A line between other lines goes where it was said before; so does a document of nothing else."""
    notice = " ".join(f"notice{k}" for k in range(60))
    rows = [(1, f"one\n{notice}\ntwo"), (2, f"three\n{notice}\nfour"), (3, notice), (4, f"five\n\n{notice}\n\nsix")]
    got = corpus_pipeline.line_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {1: rows[0][1], 2: "three\nfour", 4: "five\n\n\nsix"}


def test_near_duplicate_stage(spark, sf):
    """Pairs with some edits: those of Jaccard 0.8 or more lose their later text, the others keep both."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows, similarities = [], {}
    for k in range(120):
        x = [word() for _ in range(rng.randint(60, 400))]
        y = list(x)
        for i in rng.sample(range(len(y)), rng.randint(1, 2 + len(y) // 30)):
            y[i] = word()
        rows += [(2 * k, " ".join(x)), (2 * k + 1, " ".join(y))]
        a, b = (set(zip(*(v[i:] for i in range(5)), strict=False)) for v in (x, y))
        similarities[2 * k + 1] = len(a & b) / len(a | b)
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame([*rows, (1000, None), (1001, " "), (1001, " "), (None, None)], "doc_id long, text string"), sf).collect()}
    near = {i for i, j in similarities.items() if j >= 0.8}
    assert min(len(near), 120 - len(near)) > 20
    assert got == {i for i, _ in rows} - near | {1000, None}


def test_links_behind_other_texts(spark):
    """Two near-duplicates behind a text that is near both and like neither, and chains of versions of which only neighbours are alike."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))

    def edited(x, places):
        return [word() if i in places else w for i, w in enumerate(x)]

    rows, gone = [], set()
    for k in range(150):
        x = [word() for _ in range(300)]
        spots = rng.sample(range(5, 295, 6), 10)
        rows += [(3 * k, " ".join(edited(x, spots[:5]))), (3 * k + 1, " ".join(edited(x, spots[5:7]))), (3 * k + 2, " ".join(edited(x, spots[7:])))]
        gone.add(3 * k + 2)
    for k in range(30):
        x = [word() for _ in range(300)]
        places = rng.sample(range(5, 295, 6), 36)
        order = rng.sample(range(10), 10)
        for at in range(10):
            rows.append((1000 + 10 * k + order[at], " ".join(x)))
            x = edited(x, places[4 * at : 4 * at + 4])
        gone.update(range(1000 + 10 * k + 1, 1000 + 10 * k + 10))
    got = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not {i for i, _ in rows} - gone - got
    assert len(gone & got) <= 0.05 * len(gone)


def test_repeated_phrases(spark):
    """Passages of exactly 50 words whose core also stands earlier in both texts and in others."""
    rng = random.Random(14)
    words = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    rows = []
    for k in range(20):
        passage = words(50)
        core = passage[13:37]
        rows += [(20 * k + side, " ".join(words(60) + core + words(80) + passage + words(60))) for side in range(2)]
        rows += [(20 * k + 2 + other, " ".join(words(40) + core + words(40))) for other in range(8)]
    got = {r["doc_id"]: r["class_id"] for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [k for k in range(20) if got[20 * k + 1] != 20 * k] == []
    assert all(got[i] == i for i, _ in rows if i % 20 != 1)


def test_simhash(spark, sf):
    got = simhash.near_duplicates(documents(spark, sf)).collect()
    own = texts(spark, sf)
    for r in got:
        assert int(r["fingerprint"], 16) == simhash.fingerprint(own[r["doc_id"]])
    row = spark.createDataFrame([("The  quick\tbrown fox",)], "t string").select(F.xxhash64(F.lit("the quick brown fox")).alias("h")).first()["h"]
    assert simhash.fingerprint("The  quick\tbrown fox") == row % (1 << 64)
    fps = np.array([int(r["fingerprint"], 16) for r in got], np.uint64)
    ids = [r["doc_id"] for r in got]
    parent = list(range(len(ids)))
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4).tolist():
            a, b = simhash.find(parent, i), simhash.find(parent, j)
            parent[max(a, b)] = min(a, b)
    least = defaultdict(lambda: 1 << 60)
    for i in range(len(ids)):
        least[simhash.find(parent, i)] = min(least[simhash.find(parent, i)], ids[i])
    assert [r["component_id"] for r in got] == [least[simhash.find(parent, i)] for i in range(len(ids))]


@pytest.mark.parametrize("size", [40, 700])
def test_buckets(size):
    rng = np.random.default_rng(size)
    base = rng.integers(0, 1 << 63, 4).astype(np.uint64)
    fps = np.unique(np.array([base[rng.integers(4)] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False))) for _ in range(size)], np.uint64))
    parent, plain = list(range(len(fps))), list(range(len(fps)))
    for a, b in simhash.bucket_forest(fps, 4):
        assert int(fps[a] ^ fps[b]).bit_count() <= 4
        x, y = simhash.find(parent, a), simhash.find(parent, b)
        parent[max(x, y)] = min(x, y)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4).tolist():
            x, y = simhash.find(plain, i), simhash.find(plain, j)
            plain[max(x, y)] = min(x, y)
    assert [simhash.find(parent, i) for i in range(len(fps))] == [simhash.find(plain, i) for i in range(len(fps))]


def test_hot_buckets(spark):
    rng = np.random.default_rng(3)
    fps = np.unique(np.array([sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(300)], np.uint64)).view(np.int64)
    reps = spark.createDataFrame([(int(f), i) for i, f in enumerate(fps)], "fp long, rep long")
    found = components(simhash.links(reps, bucket_rows=40))
    assert found.select("component").distinct().count() == 1
    assert found.count() == len(fps)


def test_keys_are_never_broadcast(spark):
    """Spark sizes exploded keys like the rows that they come from, so small tables must not tempt it to broadcast them."""
    found = simhash.links(stored(spark.createDataFrame([(i % 7, i) for i in range(50)], "fp long, rep long")))
    assert found.collect()
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = documents(spark, sf)
    own = texts(spark, sf)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet").where(~toxicity.held_out()))
    want = {i for i, x in own.items() if model.probability(toxicity.scan(x, model)[2]) < 0.3}
    got = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert {r["doc_id"] for r in got.collect()} == want
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    out = corpus_pipeline.run(spark, sf)
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= want
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns)
