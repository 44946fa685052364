"""Two tokenizers' tokens aligned by bytes, and scored through inverted bitmaps of token pairs.

Both tokenizers never join what stands on either side of a single space between two
characters that aren't white space, so a text's alignment is its words' alignments one after
another, and each different word of a block of texts is encoded and aligned once.

An id pair's postings are bitmaps over a block's documents: plane k has the documents in
which binary digit k of the number of links is 1. A pair's documents are the OR of its words'
bitmaps, so the popcount of all planes together is its number of documents, and the planes'
popcounts, each doubled k times, give its number of links. Blocks hold different documents,
so the numbers of all blocks add up to the corpus's. They are joined back to the postings,
which hand them on to the documents of their block.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldleaf.llm.common import stored

SPLIT = re.compile(r"(?<=\S) (?=\S)")  # where both tokenizers always begin anew
ODD_SPACE = re.compile(r"\A | \s|\s | \Z")
B_BITS = 16  # a pair is its A id above so many bits of its B id
DENSE = 0xFFFF  # says that a bitmap follows and not a list
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
MADE = "block long, doc int, doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string, pair long, n int, bits binary"


@cache
def byte_tokenizer(path: str):
    """A and its tokens' bytes, from the vocabulary as ranks; special tokens' strings are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, f)}
    by_id = dict(zip(ranks.values(), ranks.keys(), strict=True))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), [by_id.get(i, b"") for i in range(max(by_id) + 1)]


@cache
def piece_tokenizer(path: str):
    """B and its pieces' bytes."""
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [coder.id_to_piece(i) for i in range(coder.get_piece_size())]
    byte = re.compile(r"<0x([0-9A-F]{2})>")
    return coder, [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]


@cache
def said(a: int, b: int) -> np.ndarray:
    """How an id is written in a group: A ids within it and as its last, then B ids alike."""
    return np.array([*[f"{i}," for i in range(a)], *[f"{i}|" for i in range(a)], *[f"{i}," for i in range(b)], *[f"{i};" for i in range(b)]], object)


class Words:
    """The alignments of a list of words, each with the space before it; ``good`` tells those that both tokenizers keep byte for byte."""

    def __init__(self, words: list[str], a_path: str, b_path: str) -> None:
        (a_coder, a_bytes), (b_coder, b_bytes) = byte_tokenizer(a_path), piece_tokenizer(b_path)
        a_ids, b_ids = [a_coder.encode_ordinary(" " + w) for w in words], b_coder.encode(words, num_threads=1) if words else []
        join = b"".join
        self.good = np.fromiter((join(map(b_bytes.__getitem__, b)) == join(map(a_bytes.__getitem__, a)) == f" {w}".encode() for w, a, b in zip(words, a_ids, b_ids, strict=True)), bool, len(words))
        for i in np.flatnonzero(~self.good).tolist():
            a_ids[i] = b_ids[i] = ()
        sizes = [np.fromiter(map(len, x), np.int64, len(words)) for x in (a_ids, b_ids)]
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in zip((a_ids, b_ids), sizes, strict=True))
        a_end, b_end = (np.cumsum(np.fromiter(map(len, t), np.int64, len(t))[x]) for t, x in ((a_bytes, a), (b_bytes, b)))  # all words in a row, in which their ends are ends of both
        ends = np.union1d(a_end, b_end)
        pair = a[np.searchsorted(a_end, ends)] << B_BITS | b[np.searchsorted(b_end, ends)]
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(both, a_end), np.searchsorted(both, b_end)
        last = lambda group: np.r_[group[1:] != group[:-1], True][: len(group)]
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.searchsorted(b_group, a_group)] = a + len(a_bytes) * last(a_group)
        codes[np.arange(len(b)) + np.searchsorted(a_group, b_group, side="right")] = 2 * len(a_bytes) + b + len(b_bytes) * last(b_group)
        told = said(len(a_bytes), len(b_bytes))[codes].tolist()
        stops = np.cumsum(sizes[0] + sizes[1]).tolist()
        self.groups = ["".join(told[s:e]) for s, e in zip([0, *stops], stops, strict=False)]
        word_end = np.r_[0, a_end][np.cumsum(sizes[0])]
        count = lambda x: np.diff(np.r_[0, np.searchsorted(x, word_end, side="right")])
        self.counts = np.stack([*sizes, count(both), count(ends)], axis=1)
        self.pair = pair
        self.first_link = np.r_[0, np.cumsum(self.counts[:, 3])]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers from each start on, as many as its size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def packed(pair: np.ndarray, doc: np.ndarray, times: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(pair, documents, planes) of entries sorted by pair and doc: for each plane the number of its documents and the documents, or ``DENSE`` and a bitmap of all ``docs``, as 16-bit words."""
    starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
    n = np.diff(np.r_[starts, len(pair)])
    planes = np.frexp(np.maximum.reduceat(times, starts).astype(np.float64))[1].astype(np.int64) if len(starts) else np.zeros(0, np.int64)
    slot_of = np.repeat(np.r_[0, np.cumsum(planes)][:-1], n)
    slots, who = [], []
    for k in range(int(planes.max(initial=0))):
        on = (times >> k) & 1 == 1
        slots.append(slot_of[on] + k)
        who.append(doc[on])
    slot, who = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (slots, who))
    order = np.argsort(slot, kind="stable")
    slot, who = slot[order], who[order]
    own = np.bincount(slot, minlength=int(planes.sum()))
    wide = -(-docs // 16)
    dense = own >= wide
    size = 1 + np.where(dense, wide, own)
    at = np.r_[0, np.cumsum(size)]
    words = np.zeros(at[-1], np.uint16)
    words[at[:-1]] = np.where(dense, DENSE, own)
    few = ~dense[slot]
    rank = np.arange(len(slot)) - np.repeat(np.r_[0, np.cumsum(own)][:-1], own)
    words[(at[slot] + 1 + rank)[few]] = who[few]
    many = ~few
    np.bitwise_or.at(words, at[slot[many]] + 1 + (who[many] >> 4), np.left_shift(1, who[many] & 15).astype(np.uint16))
    offsets = (2 * at[np.r_[0, np.cumsum(planes)]]).astype(np.int32)
    return pair[starts], n, pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(words.tobytes())])


def unpacked(bits: pa.Array, docs: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(plane, row, doc) for each plane of all rows."""
    offsets = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64)
    words = np.frombuffer(bits.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint16)
    at, end = (offsets[:-1] - offsets[0]) // 2, (offsets[1:] - offsets[0]) // 2
    row, wide, plane = np.arange(len(bits)), -(-docs // 16), 0
    while len(row := row[at[row] < end[row]]):
        head = words[at[row]].astype(np.int64)
        few, many = row[head != DENSE], row[head == DENSE]
        sizes = head[head != DENSE]
        rows, who = [np.repeat(few, sizes)], [words[ranges(at[few] + 1, sizes)].astype(np.int64)]
        for i in many.tolist():
            who.append(np.flatnonzero(np.unpackbits(words[at[i] + 1 :][:wide].view(np.uint8), bitorder="little")))
            rows.append(np.full(len(who[-1]), i))
        yield plane, np.concatenate(rows), np.concatenate(who)
        at[few] += 1 + sizes
        at[many] += 1 + wide
        plane += 1


def blocks(docs: DataFrame, a_path: str, b_path: str, block_words: int) -> DataFrame:
    """Rows of two kinds: a document of a block (pair null), and a pair's postings in it (doc null).

    A block's name holds a digest of its doc_ids and its task's number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place: dict[str, int] = {}
        ids: list[int | None] = []
        texts: list[np.ndarray] = []
        seen, digest = 0, xxhash.xxh64(seed=TaskContext.get().partitionId())

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seen, digest
            block, known = digest.intdigest() >> 1, Words(list(place), a_path, b_path)
            kept = [x if known.good[x].all() else x[:0] for x in texts]
            sizes = np.fromiter(map(len, kept), np.int64, len(kept))
            at = np.r_[0, np.cumsum(sizes)]
            flat = np.concatenate([np.zeros(0, np.int64), *kept])
            total = np.zeros((len(flat) + 1, 4), np.int64)
            np.cumsum(known.counts[flat], axis=0, out=total[1:])
            counts = total[at[1:]] - total[at[:-1]]
            told = [hashlib.sha256("".join(map(known.groups.__getitem__, x.tolist()))[:-1].encode()).hexdigest() if len(x) else "" for x in kept]
            d, p = len(kept), len(place)
            yield rows(block, d, doc=pa.array(range(d), pa.int32()), doc_id=pa.array(ids, pa.int64()), groups_sha256=pa.array(told, pa.string()), **{c: pa.array(counts[:, k]) for k, c in enumerate(COUNTS)})
            key, times = np.unique(np.repeat(np.arange(d), sizes) * p + flat, return_counts=True)
            doc, word = key // max(p, 1), key % max(p, 1)
            pairs, number = np.unique(known.pair, return_inverse=True)
            links = known.counts[word, 3]
            key = number[ranges(known.first_link[word], links)] * d + np.repeat(doc, links)
            order = np.argsort(key, kind="stable")
            key, times = key[order], np.repeat(times, links)[order]
            edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            if len(edge):
                pair, n, bits = packed(pairs[key[edge] // d], key[edge] % d, np.add.reduceat(times, edge), d)
                yield rows(block, len(pair), pair=pa.array(pair), n=pa.array(n, pa.int32()), bits=bits)
            place.clear()
            ids.clear()
            texts.clear()
            seen, digest = 0, xxhash.xxh64(seed=block)

        def rows(block: int, size: int, **cols: pa.Array) -> pa.RecordBatch:
            kinds = {"block": pa.int64(), "doc": pa.int32(), "doc_id": pa.int64(), **dict.fromkeys(COUNTS, pa.int64()), "groups_sha256": pa.string(), "pair": pa.int64(), "n": pa.int32(), "bits": pa.binary()}
            own = cols | {"block": pa.array(np.full(size, block, np.int64))}
            return pa.RecordBatch.from_arrays([own.get(c, pa.nulls(size, t)) for c, t in kinds.items()], list(kinds))

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                words = (SPLIT.split(text) if ODD_SPACE.search(text) else text.split(" ")) if text else []
                for w in set(words).difference(place):
                    place[w] = len(place)
                ids.append(i)
                texts.append(np.fromiter(map(place.__getitem__, words), np.int64, len(words)))
                digest.update(repr(i).encode())
                seen += len(words) + 1
                if seen >= block_words or len(ids) == DENSE:
                    yield from flush()
        if ids:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MADE)


def pair_counts(postings: DataFrame) -> DataFrame:
    """(pair, count, best): how many documents hold a pair linked, and whether no pair of its A id is held by more."""
    counts = postings.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.shiftright("pair", B_BITS))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))  # bounded: A's vocabulary


def align(docs: DataFrame, a_path: str, b_path: str, block_words: int = 2_000_000) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every whole text.

    A encodes a space and the text, B the text, to which it adds the space itself. Texts that
    are null or empty, or that B doesn't keep byte for byte (its pieces are never longer than
    what they stand for, so it keeps a text exactly if it keeps every word), have no tokens:
    zeros, and an empty groups_sha256. Rows that repeat each give their row and count as a
    document each, and so do rows without doc_id; other columns are ignored; an empty table
    gives an empty result.
    """
    made = stored(blocks(docs, a_path, b_path, block_words))
    rows = made.where("doc is not null").select("block", "doc", "doc_id", *COUNTS, "groups_sha256")
    postings = made.where("pair is not null").select("block", "pair", "n", "bits")
    scored = postings.join(pair_counts(postings), "pair").select(F.col("block").alias("of"), "bits", "count", "best")

    def scores(own: pa.Table, told: pa.Table) -> pa.Table:
        own, d = own.sort_by("doc"), own.num_rows
        n_best, low, high = np.zeros(d, np.int64), np.zeros(d, np.int64), np.zeros(d, np.int64)
        count, best = told["count"].to_numpy(), told["best"].to_numpy().astype(np.int64)
        bits = told["bits"].combine_chunks()
        for part in bits.chunks if isinstance(bits, pa.ChunkedArray) else [bits]:
            for plane, row, doc in unpacked(part, d) if len(part) else ():
                # sums of halves are exact in doubles
                low += np.bincount(doc, count[row] & 0xFFFFFFF, d).astype(np.int64) << plane
                high += np.bincount(doc, count[row] >> 28, d).astype(np.int64) << plane
                n_best += np.bincount(doc, best[row], d).astype(np.int64) << plane
            count, best = count[len(part) :], best[len(part) :]
        out = own.select(["doc_id", *COUNTS]).append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array((high << 28) + low))
        return out.append_column("groups_sha256", own["groups_sha256"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("block").cogroup(scored.groupBy("of")).applyInArrow(scores, schema)
