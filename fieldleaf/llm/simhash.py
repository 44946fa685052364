"""SimHash near-duplicates through pivot distance tables.

Two fingerprints of 64 bits that differ in at most ``max_bits`` bits agree on at least
``blocks - max_bits`` of ``blocks`` blocks, so each such pair meets in a bucket keyed by
that many blocks. (A pivot table alone keeps more than half of all random pairs for each
pivot, so without an equality key it would need a cross join.) Every fingerprint gets its
Hamming distances to reference fingerprints; a pair of a bucket whose distances to any one
of them differ by more than ``max_bits`` is discarded by the triangle inequality, and only
the survivors are compared bit by bit. In large buckets the references are members, and
what lies within ``max_bits`` of one is linked to it at once: a large bucket gives a
spanning forest, never all its pairs.

For similarities instead of bits (``keep_one``) the fingerprints are wider, buckets come
from sampled bits, and the survivors are verified by the texts' own Jaccard similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldleaf.llm.common import components, stored, whole_groups
from fieldleaf.llm.linking import cells
from fieldleaf.llm.passages import min_hash, tokens, unpacked

SEED = 42
CHUNK = 8192
WIDE = 192  # bits of the fingerprints for similarities
PIVOTS = 16
BEST = 2  # partners that each member is tried with before all that are left


def fingerprint(text: str | None, width: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    digest, spans = xxhash.xxh64_intdigest, zip(starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)
    ones = np.zeros(64, np.int64)
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, n)
    for at in range(0, n, CHUNK):
        part = hashes[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) for every document; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def masks(blocks: int, keep: int) -> list[int]:
    """Signed masks of every choice of ``keep`` of ``blocks`` blocks of the 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]
    chosen = [sum(c) for c in combinations(parts, keep)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def bucket_forest(fp: np.ndarray, max_bits: int, pivots: int = 16, rows: int = 256) -> list[tuple[int, int]]:
    """Index pairs that connect the fingerprints of one bucket exactly as all links of at most ``max_bits`` bits would."""
    n = len(fp)
    parent = list(range(n))
    forest: list[tuple[int, int]] = []

    def join(a: int, b: int) -> None:
        x, y = find(parent, a), find(parent, b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            forest.append((a, b))

    coords, far, nearest = [], 0, np.full(n, 65, np.uint8)
    for _ in range(min(pivots, n)):
        d = np.bitwise_count(fp ^ fp[far]).astype(np.uint8)
        coords.append(d.astype(np.int8))
        for i in np.flatnonzero(d <= max_bits).tolist():
            join(far, i)
        nearest = np.minimum(nearest, d)
        far = int(nearest.argmax())
        if nearest[far] == 0:
            break
    label = np.array([find(parent, i) for i in range(n)])
    if (label == label[0]).all():
        return forest
    table = np.stack(coords)
    order = np.argsort(table[0], kind="stable")
    table, label, fp, ids = table[:, order], label[order], fp[order], order
    for at in range(0, n, rows):
        until = min(at + rows, n)
        stop = int(np.searchsorted(table[0], table[0][until - 1] + max_bits, side="right"))
        i, j = np.nonzero((label[at:until, None] != label[None, at:stop]) & (np.abs(table[0][at:until, None] - table[0][None, at:stop]) <= max_bits))
        later = j > i
        i, j = i[later] + at, j[later] + at
        for row in table[1:]:
            near = np.abs(row[i] - row[j]) <= max_bits
            i, j = i[near], j[near]
        same = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
        for a, b in zip(ids[i[same]].tolist(), ids[j[same]].tolist(), strict=True):
            join(a, b)
    return forest


def links(reps: DataFrame, max_bits: int = 4, blocks: int = 7, pivots: int = 16, bucket_rows: int = 20_000) -> DataFrame:
    """Edges (a, b) between the ``rep`` of fingerprints in ``reps(fp, rep)``: the same components as all links.

    A bucket of more than ``bucket_rows`` fingerprints is cut into that many sub-blocks and
    each pair of sub-blocks is a group of its own, so that no task holds a whole hot bucket
    and no pair is left out. The join names its way, as Spark sizes the exploded keys like
    the fingerprints and would broadcast them.
    """
    spread = reps.repartition(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")  # few bytes, many keys each
    keyed = spread.select("fp", "rep", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(blocks, blocks - max_bits)])).alias("choice", "bits"))
    sizes = keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1").select("choice", "bits", F.ceil(F.col("n") / bucket_rows).cast("int").alias("cuts"))
    part = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    met = keyed.hint("merge").join(sizes, ["choice", "bits"]).select("choice", "bits", "fp", "rep", F.explode(F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda o: F.least(o, part) * F.col("cuts") + F.greatest(o, part))).alias("cell"))

    references = np.random.default_rng(13).integers(0, 1 << 63, pivots, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.arange(pivots, dtype=np.uint64) % np.uint64(2)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["choice", "bits", "cell"]):
            fp, rep = frame["fp"].to_numpy().view(np.uint64), frame["rep"].to_numpy()
            table = np.stack([np.bitwise_count(fp ^ r).astype(np.int8) for r in references])  # distances of the frame's fingerprints to every reference
            key = frame[["choice", "bits", "cell"]]
            group = (key != key.shift()).any(axis=1).to_numpy().cumsum()
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            sizes = np.diff(np.r_[starts, len(group)])
            out: list[tuple[np.ndarray, np.ndarray]] = []
            small = np.repeat(sizes <= 32, sizes)
            for off in range(1, min(32, len(fp))):
                i = np.flatnonzero((group[:-off] == group[off:]) & small[:-off])
                if not len(i):
                    break
                for row in table:  # what one reference tells apart needs no comparison
                    i = i[np.abs(row[i] - row[i + off]) <= max_bits]
                i = i[np.bitwise_count(fp[i] ^ fp[i + off]) <= max_bits]
                out.append((rep[i], rep[i + off]))
            for s, m in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist(), strict=True):
                pairs = np.array(bucket_forest(fp[s : s + m], max_bits, pivots), np.int64).reshape(-1, 2)
                out.append((rep[s + pairs[:, 0]], rep[s + pairs[:, 1]]))
            if out:
                yield pd.DataFrame({"a": np.concatenate([x for x, _ in out]), "b": np.concatenate([y for _, y in out])})

    return met.repartition("choice", "bits", "cell").sortWithinPartitions("choice", "bits", "cell").mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4, blocks: int = 7) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document.

    Documents whose fingerprints differ in at most ``max_bits`` bits are linked;
    component_id is the smallest doc_id that can be reached. Null and wordless texts have
    fingerprint zero and are linked like any other. Rows with equal doc_id stay as they
    are; a row without a doc_id takes no part in choosing component_id. Other columns are
    ignored; an empty table gives an empty result. Equal fingerprints are collapsed before
    any comparison, with partial aggregation, so groups of copies cost one row.
    """
    fps = stored(fingerprints(docs, width))
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    known = reps.where("rep is not null")
    top = components(links(known, max_bits, blocks)).select(F.col("node").alias("rep"), "component")
    label = reps.join(top, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The SimHash of ``WIDE`` bits of distinct shingle hashes, as 64-bit words."""
    out = np.empty(WIDE // 64, np.uint64)
    for k in range(len(out)):
        h = min_hash(shingles, 100 + k)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), CHUNK):
            ones += np.unpackbits(h[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
    return out


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's runs of ``width`` words; a shorter text is one shingle."""
    x = np.unique(tokens(text, width))
    return x if len(x) else np.array([xxhash.xxh64_intdigest(b" ".join((text or "").lower().encode().split()))], np.uint64)


def differing(similarity: float) -> float:
    """The share of SimHash bits in which two sets of this Jaccard similarity and like size are expected to differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def key_places(texts: int, similarity: float, recall: float, seed: int = 11) -> np.ndarray:
    """The bits of each key, key x place: as many as make buckets of about one chance member, and as many keys as find a pair at ``similarity`` with probability ``recall``."""
    bits = max(12, math.ceil(math.log2(max(2, texts))))
    keys = math.ceil(math.log(1 - recall) / math.log(1 - (1 - differing(similarity)) ** bits))
    rng = np.random.default_rng(seed)
    return np.stack([rng.choice(WIDE, bits, replace=False) for _ in range(keys)])


def sampled_keys(fps: DataFrame, places: np.ndarray) -> DataFrame:
    """``fps(node, f0, f1, ...)`` once for each key, with the key's number above its bits."""
    keys, bits = places.shape
    names = list(fps.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                words = np.stack([b.column(names.index(f"f{k}")).to_numpy() for k in range(WIDE // 64)], axis=1)
                ones = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
                key = ones[:, places] @ (1 << np.arange(bits, dtype=np.int64)) + (np.arange(keys, dtype=np.int64) << bits)
                rows = pa.array(np.repeat(np.arange(b.num_rows), keys))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *[c.take(rows) for c in b.columns]], ["key", *names])

    return fps.mapInArrow(run, "key long, " + ", ".join(f"{n} long" for n in names))


def bucket_pairs(fps: DataFrame, texts: int, similarity: float, recall: float, bucket_rows: int, told: str) -> DataFrame:
    """Pairs (a, b), a < b, of nodes of ``fps(node, label, f0, f1, ...)`` that meet in a bucket and have near fingerprints and, unless ``told`` is hubs, different labels.

    A pair is told in the first bucket that it meets in, or not at all. ``told`` says which
    of a bucket's pairs: ``hubs`` takes members in turn that are near no earlier hub, and
    each with those that are near it: in the first bucket in which a member meets a partner
    it is told of, as a hub or with one, so that every member with a partner is among the
    pairs, while a bucket of copies gives fewer pairs than it has members; ``best`` takes
    each member's ``BEST`` nearest partners; ``all`` takes all.
    """
    expected = differing(similarity) * WIDE
    radius = int(expected + 2 * math.sqrt(expected * (1 - differing(similarity))))
    pivots = np.random.default_rng(12).integers(0, 1 << 63, (PIVOTS, WIDE // 64), dtype=np.int64).astype(np.uint64) * np.uint64(2)
    places = key_places(texts, similarity, recall)
    bits = places.shape[1]
    ones = np.zeros((len(places), WIDE), np.uint8)
    np.put_along_axis(ones, places, 1, axis=1)
    masks_of = np.packbits(ones, axis=1, bitorder="little").view(np.uint64)
    keyed = sampled_keys(fps, places)
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows).select("key", F.ceil(F.col("n") / bucket_rows).cast("int").alias("cuts"))
    rest = cells(keyed.join(hot, "key", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))).drop("cuts")

    def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int16)

    def met_before(x: np.ndarray, key: np.ndarray, rows: int = 1024) -> np.ndarray:
        """Whether fingerprints that differ in the bits ``x`` are in one bucket of an earlier key."""
        out = np.zeros(len(x), bool)
        for at in range(0, len(x), rows):
            same = ((x[at : at + rows, None] & masks_of[None]) == 0).all(axis=2)
            out[at : at + rows] = same.argmax(axis=1) < key[at : at + rows]
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["key", "cell"]):
            node, label = frame["node"].to_numpy(), frame["label"].to_numpy()
            fp = frame[[f"f{k}" for k in range(WIDE // 64)]].to_numpy().view(np.uint64)
            table = np.stack([apart(fp, p) for p in pivots], axis=1)
            key = frame[["key", "cell"]].to_numpy()
            number = key[:, 0] >> bits
            edges = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True])
            sizes = np.diff(edges)
            out: list[tuple[np.ndarray, np.ndarray]] = []

            def close(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                keep = np.abs(table[i] - table[j]).max(axis=1, initial=0) <= radius
                keep &= (label[i] != label[j]) | (told == "hubs")
                i, j = i[keep], j[keep]
                d = apart(fp[i], fp[j])
                return i[d <= radius], j[d <= radius], d[d <= radius]

            def tell(i: np.ndarray, j: np.ndarray) -> None:
                keep = ~met_before(fp[i] ^ fp[j], number[i])
                out.append((node[i[keep]], node[j[keep]]))

            twos = edges[:-1][sizes == 2]
            tell(*close(twos, twos + 1)[:2])
            for s, e in zip(edges[:-1][sizes > 2].tolist(), edges[1:][sizes > 2].tolist(), strict=True):
                if told == "hubs":
                    free = np.ones(e - s, bool)
                    while free.any():
                        hub = s + int(free.argmax())
                        _, j, _ = close(np.full(e - s, hub), np.arange(s, e))
                        free[j - s] = free[hub - s] = False
                        tell(np.full(len(j) - 1, hub), j[j != hub])
                elif (label[s:e] != label[s]).any():
                    for i in range(s, e):
                        own, j, d = close(np.full(e - s, i), np.arange(s, e))
                        first = np.argsort(d, kind="stable")[:BEST] if told == "best" else np.flatnonzero(j > i)
                        tell(own[first], j[first])
            a, b = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in out)]) for k in (0, 1))
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return rest.repartition("key", "cell").sortWithinPartitions("key", "cell", "node").mapInPandas(run, "a long, b long").distinct()


def similar_enough(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingles have the Jaccard similarity, counted on the texts."""
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("packed").alias("packed_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("packed").alias("packed_a")), "a")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, own = None, np.zeros(0, np.uint64)
        for f in frames:
            keep = []
            for a, x, y in zip(f["a"], f["packed_a"], f["packed_b"], strict=True):
                if a != known:
                    known, own = a, shingles(unpacked(x), width)
                other = shingles(unpacked(y), width)
                n = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(n >= similarity * (len(own) + len(other) - n) - 1e-9)
            yield f.loc[np.array(keep, bool), ["a", "b"]]

    return both.select("a", "b", "packed_a", "packed_b").mapInPandas(run, "a long, b long")


def similar_texts(texts: DataFrame, width: int = 5, similarity: float = 0.8, recall: float = 0.98, bucket_rows: int = 2000) -> DataFrame:
    """(node, component) of the texts ``texts(node, text)`` that have a near-duplicate: Jaccard similarity of their shingles of ``similarity`` or more.

    Fingerprints of ``WIDE`` bits meet in buckets of sampled bits, pivots and the Hamming
    distance choose pairs there, and the texts decide. The first pass tells every text that
    has a near one in some bucket; the second tries each of those with its nearest partners
    in other components, the last with all that are left there, so that no link is lost
    behind a text that is near both its ends and like neither.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            said = [t.as_py() for t in b.column(1)]
            fps = np.array([wide_fingerprint(shingles(t, width)) for t in said], np.uint64).reshape(-1, WIDE // 64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in np.ascontiguousarray(fps.T)], pa.array([pack(t.encode()) for t in said], pa.binary())], ["node", *[f"f{k}" for k in range(WIDE // 64)], "packed"])

    words = [f"f{k}" for k in range(WIDE // 64)]
    made = stored(texts.select("node", "text").mapInArrow(run, "node long, " + ", ".join(f"{w} long" for w in words) + ", packed binary"))
    n = made.count()
    fps = made.select("node", F.col("node").alias("label"), *words)
    tried = stored(bucket_pairs(fps, n, similarity, recall, bucket_rows, "hubs"))
    held = stored(tried.select(F.col("a").alias("node")).unionByName(tried.select(F.col("b").alias("node"))).distinct())
    kept = stored(made.join(held, "node"))
    texts_of = kept.select("node", "packed")
    found = stored(similar_enough(tried, texts_of, width, similarity))
    for told in ("best", "all"):
        own = kept.select("node", *words).join(components(found), "node", "left").select("node", F.coalesce("component", "node").alias("label"), *words)
        fresh = stored(bucket_pairs(own, n, similarity, recall, bucket_rows, told).join(tried, ["a", "b"], "left_anti"))
        found, tried = found.unionByName(stored(similar_enough(fresh, texts_of, width, similarity))), tried.unionByName(fresh)
    return components(found)


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs``, all columns, with one of each group of near-duplicates: that with the smallest doc_id.

    Near-duplicates have a Jaccard similarity of ``similarity`` or more of their shingles of
    ``width`` words; a shorter text is one shingle, and null and wordless texts are alike.
    Rows without a doc_id stay; repeated rows of a kept doc_id stay, and a doc_id stays if
    one of its texts does. An empty table stays empty.
    """
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    reps = stored(own.groupBy("text_hash").agg(F.min("doc_id").alias("rep")))
    once = own.join(reps.select("text_hash", F.col("rep").alias("doc_id")), ["text_hash", "doc_id"]).dropDuplicates(["text_hash"]).select(F.col("doc_id").alias("node"), "text")
    later = similar_texts(once, width, similarity).where("node <> component").select(F.col("node").alias("rep"))
    kept = reps.select("rep").distinct().join(later, "rep", "left_anti").select(F.col("rep").alias("doc_id"))
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
