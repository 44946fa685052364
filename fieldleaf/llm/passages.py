"""Near-duplicate passages through compact windows of token min-hashes.

Tokens are hashed runs of five words. For each of ``hashes`` min-hash functions the
Cartesian tree over a text's token hashes groups its subsequences: a node with minimum at c
and extent [a, b) stands for all subsequences around c inside it, which share that min-hash,
and only nodes of at least ``min_words`` words are made, about 2 / min_words for each word.

Windows whose min-hash no other text has are dropped. The others of a text are joined by
interval: windows of two functions whose extents have a subsequence of ``min_words`` words
around both minima in common give a signature of two min-hashes, which only texts with such
a subsequence share. Texts of one signature are linked in two passes (linking.py), and each
link is verified on the texts by the Jaccard similarity of two stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldleaf.llm import linking
from fieldleaf.llm.common import components, stored, whole_groups

WIDTH = 5
PART = 1 << 20  # tokens that are worked on at a time, one whole text at least
U = np.uint64
AGREE = 2  # functions whose windows meet in a signature


def tokens(text: str | None, width: int = WIDTH) -> np.ndarray:
    """A hash for each run of ``width`` words, case and white space aside; none for a shorter text."""
    words = (text or "").lower().encode().split()
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    digest = xxhash.xxh64_intdigest
    each = np.fromiter(map(digest, words), U, len(words))
    out = np.zeros(n, U)
    for k in range(width):
        out = (out ^ each[k : k + n]) * U(0x9E3779B97F4A7C15)
        out ^= out >> U(29)
    return out


def min_hash(x: np.ndarray, function: int) -> np.ndarray:
    v = (x ^ U((function + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)) * U(0xBF58476D1CE4E5B9)
    v ^= v >> U(32)
    return v * U(0x94D049BB133111EB)


def compact_windows(v: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """(start, minimum's place, end) of the nodes of at least ``least`` values in the Cartesian trees over v[start:end], all trees at once, level by level.

    Places fill the low bits of the values (as many as there are places), so that a minimum tells where it is; they are
    scattered by an odd factor, so that equal values make no deep tree.
    """
    bits = max(20, len(v).bit_length())
    mask, factor = U((1 << bits) - 1), 0x9E3779B97F4A7C15 & (1 << bits) - 1
    back = U(pow(factor, -1, 1 << bits))
    packed = np.append(v & ~mask | np.arange(len(v), dtype=U) * U(factor) & mask, ~U(0))
    out = [np.zeros((3, 0), np.int64)]
    long = ends - starts >= least
    a, b = starts[long], ends[long]
    while len(a):
        low = np.minimum.reduceat(packed, np.stack([a, b], axis=1).ravel())[::2]
        c = ((low & mask) * back & mask).astype(np.int64)
        out.append(np.stack([a, c, b]))
        left, right = c - a >= least, b - c - 1 >= least
        a, b = np.concatenate([a[left], c[right] + 1]), np.concatenate([c[left], b[right]])
        order = np.argsort(a)
        a, b = a[order], b[order]
    return np.concatenate(out, axis=1)


def windows(docs: DataFrame, min_words: int, hashes: int) -> DataFrame:
    """(key, node, start, middle, end) of all compact windows in tokens: key is a min-hash with its function in the low byte, node the text's hash."""
    least = min_words - WIDTH + 1
    names = ["key", "node", "start", "middle", "end"]

    def told(part: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        ends = sizes.cumsum()
        x, owner = np.concatenate(part), np.repeat(np.arange(len(part)), sizes)
        cols = []
        for f in range(hashes):
            v = min_hash(x, f)
            w = compact_windows(v, ends - sizes, ends, least)
            i = owner[w[1]]
            key = (v[w[1]] & U(0xFFFFFFFFFFFFFF00) | U(f)).view(np.int64)
            cols.append((key, np.array(nodes)[i], *(w - (ends - sizes)[i]).astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*cols, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nodes, size = [], [], 0
        for b in batches:
            for at, h in enumerate(b.column(0).to_pylist()):
                x = tokens(b.column(1)[at].as_py())
                if len(x) >= least:
                    part.append(x)
                    nodes.append(h)
                    size += len(x)
                if size >= PART:
                    yield told(part, nodes)
                    part, nodes, size = [], [], 0
        if part:
            yield told(part, nodes)

    return docs.select("text_hash", "text").mapInArrow(run, "key long, node long, start int, middle int, end int")


def signatures(found: DataFrame, least: int) -> DataFrame:
    """(key, node, at) for each two windows of a text that have a stretch of ``least`` tokens around both minima in common, minima less than that apart; at is the first minimum."""
    cut = lambda c: F.floor(F.col(c) / least).cast("int")
    one = found.select("node", cut("middle").alias("bin"), *[F.col(c).alias(f"{c}_1") for c in ("key", "start", "middle", "end")])
    two = found.select("node", F.explode(F.array(*[cut("middle") + k for k in (-1, 0, 1)])).alias("bin"), *[F.col(c).alias(f"{c}_2") for c in ("key", "start", "middle", "end")])
    function = lambda c: F.col(c).bitwiseAND(F.lit(255))
    low, high = F.greatest("start_1", "start_2"), F.least("end_1", "end_2")
    first, last = F.least("middle_1", "middle_2"), F.greatest("middle_1", "middle_2")
    meet = (function("key_1") < function("key_2")) & (last - first < least) & (low <= first) & (last < high) & (high - low >= least)
    return one.join(two, ["node", "bin"]).where(meet).select(F.xxhash64("key_1", "key_2").alias("key"), "node", first.alias("at"))


def neighbours(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the last one before it and the first one after it with the same value; -1 and len(x) if there is none."""
    before, after = np.full(len(x), -1), np.full(len(x), len(x))
    order = np.argsort(x, kind="stable")
    same = x[order[1:]] == x[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def sides(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of a's values whether b has it, whether it is its first in a, and a place of it in b."""
    order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    x, y = a[order_a], b[order_b]
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    hit, new, place = np.empty(len(a), bool), np.empty(len(a), bool), np.empty(len(a), np.int64)
    hit[order_a], place[order_a], new[order_a] = y[at] == x, order_b[at], np.r_[True, x[1:] != x[:-1]]
    return hit, new, place


def dense(hit: np.ndarray, new: np.ndarray, least: int, share: float) -> bool:
    """False only if no stretch of ``least`` places or more, of whatever length, has the share ``share`` of its distinct values among the hits."""
    score = np.where(hit, 1 - share, np.where(new, -share, 0.0))  # a miss seen before might not count in a stretch
    total = np.zeros(len(hit) + 1)
    score.cumsum(out=total[1:])
    return len(hit) >= least and bool((total[least:] - np.minimum.accumulate(total)[: len(total) - least]).max() > -1e-6)


def can_be(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], least: int, similarity: float) -> bool:
    """False only if no two stretches are similar enough, by the greatest shares p and q of shared values that any stretch of either side has (hits and first places each): the similarity is at most 1 / (1/p + 1/q - 1)."""
    if not dense(*one, least, similarity) or not dense(*other, least, similarity):
        return False
    low, high, bound = similarity, 1.0, 1 + 1 / similarity
    for _ in range(4):
        mid = (low + high) / 2
        low, high = (mid, high) if dense(*one, least, mid) else (low, mid)
    return dense(*other, least, 1 / (bound - 1 / high))


def ends_of_runs(x: np.ndarray, y: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a stretch of x may begin and, exclusively, end: at a value of y that follows, or is followed by, another value there at least once."""
    n = np.bincount(y, minlength=top)
    pairs, times = np.unique(y[:-1] * top + y[1:], return_counts=True)
    own = x[:-1] * top + x[1:]
    at = np.searchsorted(pairs, own)
    at[at == len(pairs)] = 0
    together = np.where(pairs[at] == own, times[at], 0) if len(pairs) else np.zeros(len(own), int)
    return np.flatnonzero((n[x] > 0) & (n[x] > np.r_[0, together])), np.flatnonzero((n[x] > 0) & (n[x] > np.r_[together, 0])) + 1


def stretches(x: np.ndarray, y: np.ndarray, top: int, least: int, similarity: float) -> np.ndarray:
    """(start, end, distinct values, those of them in y) of the stretches of x that can be most similar to one of y.

    A value at the border that both sides have next to each other never lowers the Jaccard
    similarity, nor does one that the stretch holds already, so only stretches that can't be
    widened by such a value count. Shorter ones than ``least`` are filled up on either side.
    """
    starts, ends = ends_of_runs(x, y, top)
    before, after = neighbours(x)
    hit = np.isin(x, y)
    out = [np.zeros((0, 4), np.int64)]

    total = np.r_[0, np.where(hit, 1 - similarity, np.where(before < 0, -similarity, 0.0)).cumsum()]  # a bound, as in dense()

    def add(s: int, e: np.ndarray) -> None:
        e = e[total[e] - total[s] > -1e-6]
        if not len(e):
            return
        new = before[s : e[-1]] < s
        values, shared = new.cumsum()[e - 1 - s], (new & hit[s : e[-1]]).cumsum()[e - 1 - s]
        some = shared >= similarity * values - 1e-9
        out.append(np.stack([np.full(some.sum(), s), e[some], values[some], shared[some]], axis=1))

    short: set[tuple[int, int]] = set()
    previous = np.r_[before, -1]
    widened = np.r_[hit & (before >= 0), False]  # a shared value that a stretch before it may hold already
    top_after = np.maximum.accumulate(total[::-1])[::-1]
    far = np.minimum(starts + 1, len(x) - least if len(x) >= least else 0)
    for s in starts[(top_after[np.maximum(far, 0)] - total[starts] > -1e-6) | (starts > len(x) - least)].tolist():
        limit = after[s - 1] if s and hit[s - 1] else len(x)
        e = ends[np.searchsorted(ends, s, side="right") : np.searchsorted(ends, limit, side="right")]
        e = e[~widened[e] | (previous[e] < s)]
        brief = e[e - s < least]
        for t in {s, *(np.maximum(brief, least) - least).tolist()} if len(brief) else ():
            t = min(t, len(x) - least)
            short.add((t, t + least))
        e = e[e - s >= least]
        if len(e):
            add(s, e)
    for s, e in sorted(short):
        add(s, np.array([e]))
    return np.unique(np.concatenate(out), axis=0)


def likely(a: np.ndarray, b: np.ndarray, hit: np.ndarray, place: np.ndarray, least: int, similarity: float) -> tuple[int, int, int, int, float] | None:
    """A passage as in verified() among some likely stretches: the best scoring ones of a with what b has at about the same distance."""
    for gain in (0.11, 0.05, 0.2):
        total = np.zeros(len(hit) + 1)
        np.where(hit, gain, gain - 1).cumsum(out=total[1:])
        e = int((total - np.minimum.accumulate(total)).argmax())
        s = int(total[: e + 1].argmin())
        if e - s < least:
            s = max(0, s - (least - e + s) // 2)
            e = min(len(a), s + least)
            s = max(0, e - least)
        at = s + np.flatnonzero(hit[s:e])
        if not len(at):
            continue
        far = place[at] - at
        near = place[at][np.abs(far - np.median(far)) <= least]
        if not len(near):
            continue
        t, u = int(near.min()), int(near.max()) + 1
        if u - t < least:
            t = max(0, min(t, len(b) - least))
            u = min(len(b), max(u, t + least))
        own, other = set(a[s:e].tolist()), set(b[t:u].tolist())
        n = len(own & other)
        if u - t >= least and n >= similarity * (len(own) + len(other) - n):
            return s, e + WIDTH - 1, t, u + WIDTH - 1, n / (len(own) + len(other) - n)
    return None


def verified(a: np.ndarray, b: np.ndarray, min_words: int, similarity: float) -> tuple[int, int, int, int, float] | None:
    """A long passage of a that b repeats: (start, end) in words of both and the Jaccard similarity of their tokens.

    Both have at least ``min_words`` words. Likely stretches are tried first (the whole
    texts, those of dense hits), then all: a pair is refused only if no two stretches are
    similar enough.
    """
    least = min_words - WIDTH + 1
    if min(len(a), len(b)) < least:
        return None
    hit, new, place = sides(a, b)
    if hit.sum() < similarity * similarity * least:
        return None
    back, fresh, _ = sides(b, a)
    shared = int((hit & new).sum())
    j = shared / (int(new.sum()) + int(fresh.sum()) - shared)
    if j >= similarity:
        return 0, len(a) + WIDTH - 1, 0, len(b) + WIDTH - 1, j
    if found := likely(a, b, hit, place, least, similarity):
        return found
    return searched(a, b, min_words, similarity) if can_be((hit, new), (back, fresh), least, similarity) else None


def searched(a: np.ndarray, b: np.ndarray, min_words: int, similarity: float) -> tuple[int, int, int, int, float] | None:
    """The same among all stretches: the longest of those that lie in b as their borders do; only if there is none are all stretches of both held against each other."""
    least = min_words - WIDTH + 1
    values, both = np.unique(np.r_[a, b], return_inverse=True)
    x, y, top = both[: len(a)], both[len(a) :], len(values)

    def jaccard(s: int, e: int, t: int, u: int) -> float:
        own, other = np.unique(x[s:e]), np.unique(y[t:u])
        n = len(np.intersect1d(own, other, assume_unique=True))
        return n / (len(own) + len(other) - n)

    def told(s: int, e: int, t: int, u: int, j: float) -> tuple[int, int, int, int, float]:
        return int(s), int(e) + WIDTH - 1, int(t), int(u) + WIDTH - 1, float(j)

    mine = stretches(x, y, top, least, similarity)
    theirs = stretches(y, x, top, least, similarity) if len(mine) else mine
    if not len(theirs):
        return None
    mine = mine[np.argsort(mine[:, 0] - mine[:, 1], kind="stable")]
    first, last = np.full(top, len(y)), np.full(top, -1)
    first[y[::-1]] = np.arange(len(y))[::-1]
    last[y] = np.arange(len(y))
    fresh = np.r_[0, (neighbours(y)[0] < 0).cumsum()]
    t, u = first[x[mine[:, 0]]], last[x[mine[:, 1] - 1]] + 1
    u = np.where(t < len(y), u, 0)
    t = np.minimum(t, len(y))
    whole = u - t >= least
    fewest = np.where(whole, fresh[np.maximum(u, 0)] - fresh[t], 0)
    for k in np.flatnonzero(whole & (mine[:, 3] >= similarity * (mine[:, 2] + fewest - mine[:, 3]) - 1e-9)).tolist():
        j = jaccard(mine[k, 0], mine[k, 1], t[k], u[k])
        if j >= similarity:
            return told(mine[k, 0], mine[k, 1], t[k], u[k], j)
    share, other = mine[:, 3] / mine[:, 2], theirs[:, 3] / theirs[:, 2]
    bound = 1 + 1 / similarity + 1e-9  # with shares p and q of shared values the similarity is at most 1 / (1/p + 1/q - 1)
    mine, theirs = mine[1 / share + 1 / other.max() <= bound], theirs[1 / other + 1 / share.max() <= bound]
    before = neighbours(y)[0]
    for s, e, n, _ in mine.tolist():
        near = theirs[(theirs[:, 2] >= similarity * n - 1e-9) & (theirs[:, 2] * similarity <= n + 1e-9)]
        among = np.zeros(top, bool)
        among[x[s:e]] = True
        hit = among[y]
        total = np.r_[0, hit.cumsum()]
        most = np.minimum(np.minimum(total[near[:, 1]] - total[near[:, 0]], near[:, 3]), n)
        best = None
        near = near[most >= similarity * (n + near[:, 2] - most) - 1e-9]
        for t in np.unique(near[:, 0]).tolist():
            own = near[near[:, 0] == t]
            shared = ((before[t:] < t) & hit[t:]).cumsum()[own[:, 1] - 1 - t]
            j = shared / (n + own[:, 2] - shared)
            k = int(j.argmax())
            if j[k] >= similarity and (best is None or j[k] > best[4]):
                best = told(s, e, t, own[k, 1], j[k])
        if best:
            return best
    return None


def packed_texts(docs: DataFrame) -> DataFrame:
    """(text_hash, doc_id, packed): texts as small binaries for the shuffles to come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pack(t.as_py().encode()) for t in b.column(2)], pa.binary())], ["text_hash", "doc_id", "packed"])

    return docs.select("text_hash", "doc_id", "text").mapInArrow(run, "text_hash long, doc_id long, packed binary")


def unpacked(packed: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(packed).decode()


def verify(pairs: DataFrame, texts: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) that share a passage, with its place in both and the similarity."""
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("packed").alias("packed_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("packed").alias("packed_a")), "a")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, own = None, np.zeros(0, U)
        for f in frames:
            out = []
            for a, b, x, y in zip(f["a"], f["b"], f["packed_a"], f["packed_b"], strict=True):
                if a != known:
                    known, own = a, tokens(unpacked(x))
                if found := verified(own, tokens(unpacked(y)), min_words, similarity):
                    out.append((a, b, *found))
            yield pd.DataFrame(out, columns=["a", "b", "start_a", "end_a", "start_b", "end_b", "similarity"])

    return both.select("a", "b", "packed_a", "packed_b").mapInPandas(run, "a long, b long, start_a long, end_a long, start_b long, end_b long, similarity double")


def overlaps(sets: list[np.ndarray], often: int = 32) -> np.ndarray:
    """How many values each two of ``sets`` (of distinct values) have in common: values of up to ``often`` sets by their pairs, others by a matrix product."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, value, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((m, m), np.float32)
    columns = np.flatnonzero(times > often)
    for at in range(0, len(columns), 2048):
        some = np.full(len(times), -1)
        some[columns[at : at + 2048]] = np.arange(len(columns[at : at + 2048]))
        own = some[value] >= 0
        table = np.zeros((m, 2048), np.float32)
        table[owner[own], some[value[own]]] = 1
        out += table @ table.T
    few = (times[value] > 1) & (times[value] <= often)
    order = np.lexsort((owner[few], value[few]))
    who, what = owner[few][order], value[few][order]
    pairs = [np.zeros(0, np.int64)]
    for off in range(1, min(often, len(who))):
        i = np.flatnonzero(what[:-off] == what[off:])
        if not len(i):
            break
        pairs.append(who[i] * m + who[i + off])
    half = np.bincount(np.concatenate(pairs), minlength=m * m).reshape(m, m)
    return out + half + half.T


def around(x: np.ndarray, places: list[int], least: int) -> np.ndarray:
    """The tokens of ``x`` that a passage of ``least`` tokens over one of the places (in order) may have, one stretch after another."""
    parts, end = [], 0
    for at in places:
        parts.append(x[max(end, at - least + 1) : at + least])
        end = max(end, at + least)
    return np.concatenate(parts)


def dense_pairs(own: list[np.ndarray], i: np.ndarray, j: np.ndarray, least: int, similarity: float, held: int = 1 << 23) -> np.ndarray:
    """Of the pairs (i, j) of stretches those with a shortest passage of each side, one of which has the share of the other's tokens that two equally similar sides have, and the other at least ``similarity``. About ``held`` comparisons, but those of one pair at least, are held at a time."""
    size = max(map(len, own))
    rows = max(1, held // size**2)
    table = np.zeros((len(own), size), np.uint32)
    for k, x in enumerate(own):
        table[k, : len(x)] = x
    length = np.fromiter(map(len, own), np.int64, len(own))
    keep = np.zeros(len(i), bool)

    def most(same: np.ndarray) -> np.ndarray:
        total = np.pad(same, ((0, 0), (1, 0))).cumsum(axis=1, dtype=np.int32)
        return (total[:, least:] - total[:, :-least]).max(axis=1) if size >= least else total[:, -1]

    for at in range(0, len(i), rows):
        a, b = i[at : at + rows], j[at : at + rows]
        same = table[a][:, :, None] == table[b][:, None, :]
        same &= (np.arange(size) < length[a][:, None])[:, :, None] & (np.arange(size) < length[b][:, None])[:, None, :]
        p, q = most(same.any(axis=2)), most(same.any(axis=1))
        keep[at : at + rows] = (np.minimum(p, q) >= similarity * least) & (np.maximum(p, q) >= 2 * similarity / (1 + similarity) * least)
    return keep


def close_stretches(rest: DataFrame, partners: int | None, texts: DataFrame, least: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of members with different labels whose texts have as many tokens in common around the minima that they share as the shortest similar passages; of each member only those with its best ``partners``, if that is given."""
    need = 2 * similarity / (1 + similarity) * least
    at = rest.groupBy("node").agg(F.collect_list(F.struct("key", "at", "label", "cuts")).alias("at"))  # bounded by the text's own windows

    def stretches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for node, places, packed in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                x = (tokens(unpacked(packed)) & U(0xFFFFFFFF)).astype(np.uint32)
                rows += [(p["key"], node, p["label"], p["cuts"], around(x, p["at"], least).tobytes()) for p in places]
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()
            for k in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[k : k + 10_000]], kind) for i, kind in enumerate(kinds)], ["key", "node", "label", "cuts", "tokens"])

    carried = at.join(texts, "node").select("node", "at", "packed").mapInArrow(stretches_of, "key long, node long, label long, cuts int, tokens binary")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["key", "cell"]):
            out: list[tuple[np.ndarray, np.ndarray]] = []
            group, nodes, labels, told = frame[["key", "cell"]].to_numpy(), frame["node"].to_numpy(), frame["label"].to_numpy(), frame["tokens"].to_numpy()
            edges = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1), True])
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                node, label = nodes[s:e], labels[s:e]
                if (label == label[0]).all():
                    continue
                own = [np.frombuffer(t, np.uint32) for t in told[s:e]]
                n = overlaps([np.unique(x) for x in own])
                n[(n < need) | (label[:, None] == label[None, :])] = 0
                if partners and partners < len(n):
                    best = np.argpartition(n, -partners, axis=1)[:, -partners:]
                    i, j = np.repeat(np.arange(len(n)), partners), best.ravel()
                    i, j = i[n[i, j] > 0], j[n[i, j] > 0]
                else:
                    i, j = np.nonzero(np.triu(n, 1))
                keep = dense_pairs(own, i, j, least, similarity)
                i, j = i[keep], j[keep]
                out.append((np.minimum(node[i], node[j]), np.maximum(node[i], node[j])))
            yield pd.DataFrame({k: np.concatenate([np.zeros(0, np.int64), *(x[n] for x in out)]) for n, k in enumerate("ab")}).drop_duplicates()

    return linking.cells(carried).drop("cuts").repartition("key", "cell").sortWithinPartitions("key", "cell").mapInPandas(compare, "a long, b long")


def links(docs: DataFrame, reps: DataFrame, min_words: int = 50, similarity: float = 0.8, hashes: int = 4) -> DataFrame:
    """Verified links (a, b) between texts ``docs(doc_id, text_hash, text)``, each with its passage; ``reps(text_hash, doc_id)`` names one document of each text."""
    least = min_words - WIDTH + 1
    near = stored(linking.shared(stored(windows(docs, min_words, hashes))).distinct())  # equal texts have equal windows
    members = stored(linking.shared(signatures(near, least).groupBy("key", "node").agg(F.array_sort(F.collect_set("at")).alias("at"))))
    need = members.select(F.col("node").alias("text_hash")).distinct().join(reps, "text_hash")
    texts = stored(packed_texts(docs).join(need, ["text_hash", "doc_id"]).dropDuplicates(["text_hash"]).select(F.col("text_hash").alias("node"), "packed"))
    return linking.links(members, lambda pairs: verify(pairs, texts, min_words, similarity), lambda rest, partners: close_stretches(rest, partners, texts, least, similarity))


def repeated_passages(docs: DataFrame, min_words: int = 50, similarity: float = 0.8, hashes: int = 4) -> DataFrame:
    """(doc_id, class_id, passage_start, passage_end, similarity) for every document.

    Documents are linked if they hold the same text or share a passage of at least
    ``min_words`` words whose runs of five words have a Jaccard similarity of ``similarity``
    or more. class_id is the smallest doc_id that links lead to; passage_start and
    passage_end are the words of the longest passage by which the text was linked (of equally
    long ones the last, then the most similar), end exclusive, null if it has none. A passage
    at that similarity is a candidate with probability 0.97 with four functions, and more
    surely where it is longer or more similar; exact passages always are. Null texts and rows
    without doc_id stand alone (class_id is their doc_id). Equal texts and repeated rows share
    a class and its figures; an empty table gives an empty result; other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long"), "text").withColumn("text_hash", F.xxhash64("text"))
    known = own.where("doc_id is not null and text is not null")
    reps = stored(known.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id")))
    found = stored(links(known, reps, min_words, similarity, hashes))
    side = lambda k: found.select(F.col(k).alias("text_hash"), F.struct((F.col(f"end_{k}") - F.col(f"start_{k}")).alias("n"), F.col(f"start_{k}").alias("start"), F.col(f"end_{k}").alias("end"), "similarity").alias("p"))
    figures = side("a").unionByName(side("b")).groupBy("text_hash").agg(F.max("p").alias("p"))
    rep = lambda k: reps.select(F.col("text_hash").alias(k), F.col("doc_id").alias(f"{k}_doc"))
    edges = found.select("a", "b").join(rep("a"), "a").join(rep("b"), "b").select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b"))
    top = components(edges).withColumnRenamed("node", "rep")
    label = reps.withColumnRenamed("doc_id", "rep").join(top, "rep", "left").join(figures, "text_hash", "left").select("text_hash", F.coalesce("component", "rep").alias("class_id"), "p")
    told = own.select("doc_id", F.when(F.col("text").isNotNull() & F.col("doc_id").isNotNull(), F.col("text_hash")).alias("text_hash")).join(label, "text_hash", "left")
    return told.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.col("p.start").alias("passage_start"), F.col("p.end").alias("passage_end"), F.col("p.similarity").alias("similarity"))
