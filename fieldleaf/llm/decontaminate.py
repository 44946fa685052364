"""Benchmark decontamination: edit distance turned into Hamming distance by random walks.

Every word of a text and every word of an item begins a stretch of some 32 bytes, and each
stretch is embedded by the CGK walk: a reader that copies the byte it stands on at each step
and moves on by a coin that is a hash of walk, step and byte, so that two strings of small
edit distance soon walk in step again and differ in few places of the copy. Bit-sampling
keys of several walks decide which stretches go on: an item's window is laid on a text
wherever one of the text's stretches has a key of one of the item's. What is left is verified
by the exact edit distance.

No word is left out, however common it is: the more stretches there are in a block of items,
the more samples a key has (so that chance hits stay rare) and the more keys there are (so
that recall stays). Items of less than STEPS bytes have shorter walks.

The items are held by every task in blocks of at most ``block_bytes``; more items mean more
blocks, each of which is read against all texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = 64  # of a walk; half as many bytes are read on average
DRIFT = 3  # words by which an end of a window may be moved at once
CHUNK = 1 << 14  # stretches that are embedded together
FAR = 1 << 30  # more words than a text has
APART = 4.4  # a further sample divides chance hits by this (measured on the prose given)
WORDS = 32  # of 64 characters, in items that are compared many at a time
EXTRA = 6  # samples of a key, besides those that a block's size asks for
MORE = 1.19  # and asks for so many times the keys


def normal(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table at a time as bit vectors."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every, top, plus, minus, score = (1 << len(a)) - 1, 1 << len(a) - 1, (1 << len(a)) - 1, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(diagonal | plus) & every, plus & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & every, down << 1 & every
        plus, minus = down | ~(diagonal | up) & every, up & diagonal
    return score


def distances(a: str, b: str) -> list[int]:
    """For each place in ``b``, 0 to its end, the least Levenshtein distance of ``a`` and a stretch of ``b`` that ends there."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every, top, plus, minus, score = (1 << len(a)) - 1, 1 << len(a) - 1, (1 << len(a)) - 1, 0, len(a)
    out = [score]
    for c in b:
        eq = at.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(diagonal | plus) & every, plus & diagonal
        score += bool(up & top) - bool(down & top)
        out.append(score)
        up, down = up << 1 & every, down << 1 & every
        plus, minus = down | ~(diagonal | up) & every, up & diagonal
    return out


def coins(walk: int, step: int) -> np.ndarray:
    """Whether a walk moves on from each byte at this step: a hash of walk, step and byte, so that no table grows with the texts."""
    x = (np.arange(256, dtype=np.uint64) + np.uint64((walk << 40) + (step << 8) + 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    return (x * np.uint64(0x94D049BB133111EB) >> np.uint64(63)).astype(np.int64)


def embed(buffer: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The steps of one walk, step x stretch, from each of ``starts``; ``moves`` are the walk's coins, and buffer goes on for as many bytes after the last start."""
    out, at = np.empty((len(moves), len(starts)), np.uint8), starts.copy()
    for row, move in zip(out, moves, strict=True):
        buffer.take(at, out=row, mode="clip")
        at += move.take(row)
    return out


def key(copied: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A hash of the bytes copied at ``places`` for each stretch."""
    x = copied[places[0]].astype(np.uint32)
    for j in places[1:]:
        x *= np.uint32(0x9E3779B1)
        x += copied[j]
    x *= np.uint32(0x85EBCA6B)
    return x


def word_starts(parts: list[bytes], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts (words joined and followed by single spaces) in one buffer that goes on for ``steps`` bytes, and where each word begins."""
    buffer = np.frombuffer(b"".join(parts) + bytes(steps + 1), np.uint8)
    return buffer, np.r_[0, np.flatnonzero(buffer == 32) + 1][:-1]


@dataclass
class Tier:
    """The stretches of all items that have walks of so many ``steps``."""

    steps: int
    moves: np.ndarray  # walk x step x byte
    places: np.ndarray  # walk x key x sample
    item: np.ndarray
    offset: np.ndarray  # of the stretch's first word in its item
    keys: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]  # for each walk and key: which beginnings of hashes there are, the hashes, sorted, and their stretches
    shift: np.uint32

    def hits(self, copied: np.ndarray, walk: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(stretch of the text, stretch of the items) of all that have a key in common."""
        x = key(copied, self.places[walk, k])
        some, hashes, order = self.keys[walk][k]
        at = np.flatnonzero(some.take(x >> self.shift))
        low, high = np.searchsorted(hashes, x[at], "left"), np.searchsorted(hashes, x[at], "right")
        n = high - low
        return np.repeat(at, n), order[np.repeat(low - np.r_[0, n.cumsum()[:-1]], n) + np.arange(n.sum())]


def small(text: str) -> np.ndarray:
    """A text's characters as 128 values, so that distances can only become less."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return ((c ^ c >> np.uint32(7)) & np.uint32(127)).astype(np.int64)


@dataclass
class Items:
    ids: list
    texts: list[bytes]
    sizes: np.ndarray  # words
    walks: int
    number: int  # keys of each walk
    samples: int  # of each key, at least
    seed: int

    @cached_property
    def tiers(self) -> list[Tier]:
        """Made by each worker for itself, once."""
        lengths = np.array([len(t) for t in self.texts], np.int64)
        steps_of = np.minimum(STEPS, 1 << np.floor(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        return [self.tier(steps, np.flatnonzero(steps_of == steps)) for steps in np.unique(steps_of).tolist()]

    @cached_property
    def masks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many 64-bit words each item's characters take, the first one's row, and for row and character where in the item it is."""
        n = (self.characters + 63) // 64
        n[n > WORDS] = 0  # these aren't compared many at a time
        rows = n.cumsum() - n
        bits = np.zeros((int(n.sum()), 128), np.uint64)
        for i in np.flatnonzero(n).tolist():
            at = np.arange(self.characters[i])
            np.bitwise_or.at(bits, (rows[i] + at // 64, small(self.texts[i].decode())), np.uint64(1) << (at % 64).astype(np.uint64))
        return n, rows, bits.ravel()

    def least(self, chars: np.ndarray, begin: np.ndarray, stop: np.ndarray, item: np.ndarray) -> np.ndarray:
        """No more than the least distance of each item and a stretch of chars[begin:stop]; 0 for long items.

        A column of all their tables at a time as bit vectors, a word one column behind the
        word before it, so that what that one hands on is there. Reading on after a stop can
        only find less.
        """
        out = np.zeros(len(item), np.int64)
        words, rows, bits = self.masks
        mine = np.flatnonzero(words[item] > 0)
        mine = mine[np.argsort((stop - begin)[mine], kind="stable")]
        one = np.uint64(1)
        for own in (mine[at : at + CHUNK // 4] for at in range(0, len(mine), CHUNK // 4)):
            n = words[item[own]]
            final = n.cumsum() - 1
            k = np.arange(int(n.sum())) - np.repeat(final + 1 - n, n)
            row = (np.repeat(rows[item[own]], n) + k) * 128
            at = np.repeat(begin[own], n) - k
            top = np.full(len(k), 63, np.uint64)
            top[final] = ((self.characters[item[own]] - 1) % 64).astype(np.uint64)
            plus, minus = np.full(len(k), ~np.uint64(0)), np.zeros(len(k), np.uint64)
            above, below = np.zeros(len(k) + 1, np.uint64), np.zeros(len(k) + 1, np.uint64)
            score = self.characters[item[own]]
            best = score.copy()
            head = k == 0
            for j in range(int((stop - begin)[own].max()) + int(n.max()) - 1):
                a, b = np.where(head, 0, above[:-1]), np.where(head, 0, below[:-1])
                eq = bits.take(row + chars.take(at + j, mode="clip"))
                v = eq | minus
                eq |= b
                h = (((eq & plus) + plus) ^ plus) | eq
                up, down = minus | ~(h | plus), plus & h
                above[1:], below[1:] = up >> top & one, down >> top & one
                up, down = up << one | a, down << one | b
                q, p = up & v, down | ~(v | up)
                if j < WORDS:  # words that aren't there yet
                    late = j < k
                    p, q = np.where(late, plus, p), np.where(late, minus, q)
                    above[1:][late] = below[1:][late] = 0
                plus, minus = p, q
                score += above[1:][final].astype(np.int64) - below[1:][final].astype(np.int64)
                np.minimum(best, score, out=best)
            out[own] = best
        return out

    @cached_property
    def characters(self) -> np.ndarray:
        return np.array([len(t.decode()) for t in self.texts], np.int64)

    def tier(self, steps: int, which: np.ndarray) -> Tier:
        buffer, starts = word_starts([self.texts[i] + b" " for i in which], steps)
        item = np.repeat(which, self.sizes[which])
        last = np.cumsum([len(self.texts[i]) + 1 for i in which])
        offset = np.arange(len(item)) - np.repeat(self.sizes[which].cumsum() - self.sizes[which], self.sizes[which])
        left = np.repeat(last, self.sizes[which]) - starts
        keep = (left > steps // 2) | (offset == 0)  # of the others most is outside the item
        starts, item, offset = starts[keep], item[keep], offset[keep]
        samples = max(self.samples, EXTRA + math.ceil(math.log(max(2, len(starts)), APART)))
        number = math.ceil(self.number * MORE ** max(0, samples - 12))
        samples = max(1, min(samples, 5 * steps // 16))
        rng = np.random.default_rng(self.seed + steps)
        places = np.stack([[np.sort(rng.choice(steps, samples, replace=False)) for _ in range(number)] for _ in range(self.walks)])
        moves = np.stack([[coins(w, j) for j in range(steps)] for w in range(self.walks)])
        bits = min(20, 5 + math.ceil(math.log2(max(2, len(starts)))))
        keys = []
        for w in range(self.walks):
            copied, own = embed(buffer, starts, moves[w]), []
            for p in places[w]:
                x = key(copied, p)
                order = np.argsort(x, kind="stable")
                some = np.zeros(1 << bits, bool)
                some[x >> np.uint32(32 - bits)] = True
                own.append((some, x[order], order.astype(np.int32)))
            keys.append(own)
        return Tier(steps, moves, places, item, offset, keys, np.uint32(32 - bits))


def prepare(rows: list, walks: int, keys: int, samples: int, seed: int = 7) -> Items:
    rows = [(i, w) for i, t in rows if (w := normal(t))]
    return Items([i for i, _ in rows], [b" ".join(w) for _, w in rows], np.array([len(w) for _, w in rows], np.int64), walks, keys, samples, seed)


def windows_of(buffer: np.ndarray, begin: np.ndarray, sizes: np.ndarray, items: Items) -> np.ndarray:
    """(text, item, first word, end word) of the windows that keys lay on texts, those near each other as one; words are counted in their text.

    ``begin`` is where each word of all texts begins in the buffer, ``sizes`` the texts'
    words. A window is as wide as edits may make it: a quarter more words at both ends.
    """
    if not len(begin):
        return np.zeros((0, 4), np.int64)
    ends = sizes.cumsum()
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(begin)) - np.repeat(ends - sizes, sizes)
    found = [np.zeros(0, np.int64)]
    for tier in items.tiers:
        for at in range(0, len(begin), CHUNK):
            for w in range(items.walks):
                copied = embed(buffer, begin[at : at + CHUNK], tier.moves[w])
                for k in range(tier.places.shape[1]):
                    i, j = tier.hits(copied, w, k)
                    if len(i):
                        found.append(np.unique((text[i + at] * len(items.ids) + tier.item[j]) * FAR + place[i + at] - tier.offset[j] + FAR // 2))
    pair, first = np.divmod(np.unique(np.concatenate(found)), FAR)
    if not len(pair):
        return np.zeros((0, 4), np.int64)
    hits = np.stack([*np.divmod(pair, len(items.ids)), first - FAR // 2], axis=1)
    slack = DRIFT + items.sizes[hits[:, 1]] // 4
    new = np.flatnonzero(np.r_[True, (hits[1:, :2] != hits[:-1, :2]).any(axis=1) | (hits[1:, 2] - hits[:-1, 2] > slack[1:])])
    k, item, slack = hits[new, 0], hits[new, 1], slack[new]
    first = np.maximum(hits[new, 2] - slack, 0)
    end = np.minimum(hits[np.r_[new[1:], len(hits)] - 1, 2] + items.sizes[item] + slack, sizes[k])
    return np.stack([k, item, first, end], axis=1)


def nearest(words: list[bytes], item: str, similarity: float) -> tuple[int, int, int] | None:
    """(distance, first, end) of the nearest of all windows of ``words`` that count, the first one of equally near.

    A window is no nearer than what ends where it ends or begins where it begins, so ends and
    beginnings are taken by that, until no better window can come.
    """
    said = [w.decode() for w in words]
    text = " ".join(said)
    stops = np.cumsum([len(w) + 1 for w in said])
    ahead, back = distances(item, text), distances(item[::-1], text[::-1])
    enough = lambda s, e: (1 - similarity) * max(len(item), e - s) + 1e-9
    order = sorted([(ahead[e], 1, i + 1, e) for i, e in enumerate((stops - 1).tolist())] + [(back[len(text) - s], 0, i, s) for i, s in enumerate([0, *stops[:-1].tolist()])])
    seen: tuple[list, list] = ([], [])
    best = None
    for d, is_end, i, at in order:
        if d > (1 - similarity) / similarity * len(item) + 1e-9 or best and d > best[0]:
            break
        for j, other in seen[1 - is_end]:
            (first, s), (end, e) = ((j, other), (i, at)) if is_end else ((i, at), (j, other))
            if first < end and d <= enough(s, e):
                told = edit_distance(item, text[s:e]), first, end
                if told[0] <= enough(s, e) and (best is None or told < best):
                    best = told
        seen[is_end].append((i, at))
    return best


def matches(texts: list[list[bytes]], items: Items, similarity: float) -> list[tuple[int, int, int, int, int]]:
    """(text, item, first word, end word, distance): for each text and item the nearest verified window, the first one of equally near."""
    parts = [b" ".join(words) + b" " for words in texts if words]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    buffer, begin = word_starts(parts, STEPS)
    every = windows_of(buffer, begin, sizes, items)
    if not len(every):
        return []
    chars, n = small(buffer.tobytes().decode()), ((buffer & 0xC0) != 0x80).cumsum()  # a byte's character is the n-1st
    base = sizes.cumsum() - sizes
    stops = np.r_[begin[1:], sum(map(len, parts))] - 1  # where each word ends
    item = every[:, 1]
    least = items.least(chars, n[begin[base[every[:, 0]] + every[:, 2]]] - 1, n[stops[base[every[:, 0]] + every[:, 3] - 1]] - 1, item)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for k, i, first, end in every[least <= (1 - similarity) / similarity * items.characters[item] + 1e-9].tolist():
        if best.get((k, i), (1,))[0]:
            told = nearest(texts[k][first:end], items.texts[i].decode(), similarity)
            if told:
                told = told[0], told[1] + first, told[2] + first
                best[k, i] = min(best.get((k, i), told), told)
    return [(k, i, first, end, d) for (k, i), (d, first, end) in best.items()]


def item_blocks(benchmark: DataFrame, walks: int, keys: int, samples: int, block_bytes: int) -> Iterator[Broadcast[Items]]:
    """The items in blocks of about ``block_bytes`` of text at most, each prepared and broadcast by itself."""
    spark = benchmark.sparkSession
    known = benchmark.where("text is not null").select("item_id", "text")
    size = known.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(size) // block_bytes))
    for block in range(blocks):
        mine = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # bounded by block_bytes
        yield spark.sparkContext.broadcast(prepare(sorted(((r["item_id"], r["text"]) for r in mine), key=repr), walks, keys, samples))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, walks: int = 2, keys: int = 16, samples: int = 8, block_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, distance, similarity) for each text that holds a benchmark item.

    A window of about the item's number of words counts if its edit distance, case and white
    space aside, is at most 1 - ``similarity`` of the longer of the two; the nearest is told. The recall of one key for
    a share f of differing places is (1 - f) ** samples, and that of all words of an item and
    walks * keys keys each follows. Null and empty texts and items match nothing; repeated rows each give their
    rows; empty tables give an empty result; other columns are ignored.
    """
    schema = f"doc_id long, item_id {dict(benchmark.dtypes)['item_id']}, start_word long, end_word long, distance long, similarity double"
    out = None
    for items in item_blocks(benchmark, walks, keys, samples, block_bytes):

        def run(frames: Iterator[pd.DataFrame], items=items) -> Iterator[pd.DataFrame]:
            own = items.value
            for frame in frames:
                for at in range(0, len(frame), 1024):
                    f = frame.iloc[at : at + 1024]
                    ids = f["doc_id"].tolist()
                    rows = matches([normal(t) for t in f["text"]], own, similarity) if own.ids else []
                    lengths = {k: len(own.texts[k].decode()) for _, k, *_ in rows}
                    yield pd.DataFrame([(ids[k], own.ids[i], first, end, d, 1 - d / max(lengths[i], 1)) for k, i, first, end, d in rows], columns=["doc_id", "item_id", "start_word", "end_word", "distance", "similarity"]).astype({"doc_id": "Int64"})

        found = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null").mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, walks: int = 2, keys: int = 16, samples: int = 8, block_bytes: int = 2 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item. Nothing is shuffled: each block of items is one more filter.

    Null and empty texts stay, and hold nothing; repeated rows are judged alike; an empty
    benchmark keeps all rows; an empty table stays empty.
    """
    at = docs.columns.index("text")
    for items in item_blocks(benchmark, walks, keys, samples, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            own = items.value
            for batch in batches:
                for start in range(0, batch.num_rows, 1024):
                    b = batch.slice(start, 1024)
                    hit = {k for k, *_ in matches([normal(t.as_py()) for t in b.column(at)], own, similarity)} if own.ids else set()
                    yield b.filter(pa.array([k not in hit for k in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
