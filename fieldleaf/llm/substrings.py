"""Exact substring dedup with an enhanced suffix array over shared anchors.

A match of ``length`` bytes always holds an anchor: the smallest of its ``length - GRAM + 1``
hashed runs of GRAM bytes. So it is enough to sort the suffixes that start at anchors which
occur in two documents at least.

1. Tasks cut their texts into blocks. Texts that equal a smaller doc_id's are found by their
   digest; they repeat as a whole and take no further part. Each block lists the anchor
   hashes of the others, packed by hash range; where the ranges meet, hashes of two or more
   documents are marked, and the marks go back to the blocks.
2. Each block gives the suffixes at its marked anchors: ``length`` bytes to the right and
   what a match may have to the left.
3. Suffixes are dealt out by anchor and sorted: a suffix array in parts, none of which cuts
   an interval of common prefixes of GRAM bytes or more. A stack scan of the longest common
   prefixes gives the interval tree, and in each interval the left extensions tell which
   occurrences repeat an earlier document's bytes, for all of its occurrences at once.
4. The repeated spans go back to the blocks and are cut out.

An anchor of more than ``hot_rows`` occurrences isn't sorted in one place: its windows of
``length`` bytes are taken as suffixes themselves, of which each block sends those of its first document only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldleaf.llm.common import stored

GRAM = 24
SLICE = 1 << 20
U = np.uint64


def block_stream(batches: Iterator[pa.RecordBatch], block_bytes: int, emit) -> Iterator[pa.RecordBatch]:
    """Collects (doc_id, text) rows into blocks and yields what ``emit(block, ids, texts)`` gives; a block is named by its rows, so that two readings agree or don't match at all."""
    from pyspark import TaskContext

    name, ids, texts, size = xxhash.xxh64(seed=TaskContext.get().partitionId()), [], [], 0
    for batch in batches:
        for i, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = (value.as_py() or "").encode()
            ids.append(i)
            texts.append(text)
            name.update(b"%d %d," % (-1 if i is None else i, len(text)))
            size += len(text) + 16
            if size >= block_bytes:
                block = name.intdigest()
                yield from emit(block >> 1, ids, texts)
                name, ids, texts, size = xxhash.xxh64(seed=block), [], [], 0
    if ids:
        yield from emit(name.intdigest() >> 1, ids, texts)


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, position) of every anchor; texts shorter than ``length`` have none."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    some: list[int] = []
    size = 0
    for k, t in enumerate(texts):
        if len(t) < length:
            continue
        if len(t) > SLICE:
            for at in range(0, len(t) - GRAM + 1, SLICE):  # the pieces overlap by what a window needs
                h, p, _ = picked([t[max(0, at - length) : at + SLICE + length]], length)
                p = p + max(0, at - length)
                own = (p >= at) & (p < at + SLICE)
                found.append((h[own], np.full(int(own.sum()), k), p[own]))
            continue
        some.append(k)
        size += len(t)
        if size >= SLICE:
            h, p, j = picked([texts[i] for i in some], length)
            found.append((h, np.array(some)[j], p))
            some, size = [], 0
    if some:
        h, p, j = picked([texts[i] for i in some], length)
        found.append((h, np.array(some)[j], p))
    if not found:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate([x[i] for x in found]) for i in range(3))


def picked(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, text) where a run of GRAM bytes has the smallest hash of some window."""
    sizes = np.array([len(t) for t in texts])
    ends = sizes.cumsum()
    b = np.frombuffer(b"".join(texts), np.uint8).astype(U) + U(1)
    p = U(0x9E3779B97F4A7C15)
    level, power, have = {1: b * U(0xC2B2AE3D27D4EB4F)}, {1: p}, 1
    with np.errstate(over="ignore"):
        while have < 16:
            h = level[have]
            level[2 * have], power[2 * have] = h[:-have] * power[have] + h[have:], power[have] * power[have]
            have *= 2
        h = level[16][: len(b) - GRAM + 1] * power[8] + level[8][16:]
        h ^= h >> U(32)
        h *= U(0xD6E8FEB86659FD93)
        h ^= h >> U(32)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(h)]
    inside = np.arange(len(h)) + GRAM <= ends[owner]
    h = np.where(inside, h, U(0xFFFFFFFFFFFFFFFF))
    w = length - GRAM + 1
    least = spread(np.minimum, h, w)  # of the windows that start at each place
    padded = np.concatenate([np.zeros(w - 1, U), least, np.zeros(w - 1, U)])
    chosen = np.flatnonzero((spread(np.maximum, padded, w)[: len(h)] == h) & inside)
    return h[chosen], chosen - (ends - sizes)[owner[chosen]], owner[chosen]


def spread(pick, x: np.ndarray, w: int) -> np.ndarray:
    """pick over every run of w values."""
    have = 1
    while 2 * have <= w:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


def by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in order of (bucket, hash), their buckets, where each row's hash is among them, and how often each occurs."""
    u, inverse, n = np.unique(h >> U(16), return_inverse=True, return_counts=True)
    bucket = (u % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(u), np.int64)
    place[order] = np.arange(len(u))
    return u[order], bucket[order], place[inverse], n[order]


def pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def later_copies(docs: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """(block, row, start, end): texts that equal one of a smaller doc_id, with the span that goes: all of it, or nothing under ``length`` bytes."""

    def emit(block: int, ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t) for t in texts), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()), pa.array(ids, pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([len(t) for t in texts], pa.int64())], ["block", "row", "doc_id", "h1", "h2", "n"])

    read = docs.mapInArrow(lambda it: block_stream(it, block_bytes, emit), "block long, row int, doc_id long, h1 long, h2 long, n long").where("doc_id is not null")
    first = read.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last").repartition("h1", "h2")
    later = read.join(first, ["h1", "h2"]).where("doc_id > first")
    return later.select("block", "row", F.lit(0).cast("long").alias("start"), F.when(F.col("n") >= length, F.col("n")).otherwise(0).alias("end"))


def taking_part(ids: list, texts: list[bytes], copies: list[int]) -> list[bytes]:
    """The block's texts, empty for rows that take no part."""
    out = [t if i is not None else b"" for i, t in zip(ids, texts, strict=True)]
    for k in copies:
        out[k] = b""
    return out


def hash_lists(texts: DataFrame, copies: DataFrame, length: int, buckets: int) -> DataFrame:
    """(block, bucket, hashes, seen): a block's distinct anchor hashes of a bucket, as gaps, and how often each occurs, its top bit set if in two documents."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, own = opened(left)
        h, text, _ = anchors(taking_part(ids, own, right["row"].to_pylist()), length)
        u, bucket, place, n = by_bucket(h, buckets)
        doc = np.array([-1 if i is None else i for i in ids], np.int64)[text] if len(h) else np.zeros(0, np.int64)
        low, high = np.full(len(u), np.iinfo(np.int64).max), np.full(len(u), np.iinfo(np.int64).min)
        np.minimum.at(low, place, doc)
        np.maximum.at(high, place, doc)
        seen = (np.minimum(n, 0x7FFF) | np.where(low < high, 0x8000, 0)).astype(np.uint16)
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(u) else np.zeros(0, int)
        stops = np.r_[edges[1:], len(u)]
        rows = [(left["block"][0].as_py(), int(bucket[s]), pack(np.diff(u[s:e], prepend=U(0))), pack(seen[s:e])) for s, e in zip(edges, stops if len(edges) else edges, strict=True)]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["block", "bucket", "hashes", "seen"])

    return texts.groupBy("block").cogroup(copies.groupBy("block")).applyInArrow(run, "block long, bucket long, hashes binary, seen binary")


def shared_marks(lists: DataFrame, hot_rows: int) -> DataFrame:
    """(block, bucket, marks): for each hash of a list 0 if one document has it, 1 if more have, 2 if more than ``hot_rows`` rows have it."""

    def run(t: pa.Table) -> pa.Table:
        blocks, lists = t["block"].to_pylist(), [np.cumsum(unpack(x.as_py(), U), dtype=U) for x in t["hashes"]]
        seen = np.concatenate([unpack(x.as_py(), np.uint16) for x in t["seen"]]).astype(np.int64)
        _, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        rows, more = np.bincount(inverse, seen & 0x7FFF), np.bincount(inverse, (seen >> 15) * 2 + 1)
        marks = np.where(more > 1, np.where(rows > hot_rows, 2, 1), 0).astype(np.uint8)[inverse]
        cuts = np.cumsum([len(x) for x in lists])[:-1]
        return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": t["bucket"].cast(pa.int64()), "marks": pa.array([zstandard.compress(m.tobytes(), 1) for m in np.split(marks, cuts)], pa.binary())})

    return lists.groupBy("bucket").applyInArrow(run, "block long, bucket long, marks binary")


def packed_texts(docs: DataFrame, block_bytes: int) -> DataFrame:
    def emit(block: int, ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()), pa.array(ids, pa.int64()), pa.array([packer.compress(t) for t in texts], pa.binary())], ["block", "row", "doc_id", "packed"])

    return docs.mapInArrow(lambda it: block_stream(it, block_bytes, emit), "block long, row int, doc_id long, packed binary")


def opened(t: pa.Table) -> tuple[list, list[bytes]]:
    """The block's doc_ids and texts in their order."""
    t = t.sort_by("row")
    if not t.num_rows:
        raise RuntimeError("a block without its texts: docs gave other rows when read again")
    return t["doc_id"].to_pylist(), [zstandard.decompress(x.as_py()) for x in t["packed"]]


def pieces(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray, step: int = 1) -> pa.Array:
    """Binary values buffer[start], buffer[start + step], ..., ``size`` bytes each."""
    offsets = np.r_[0, sizes.cumsum()]
    at = np.repeat(starts, sizes) + step * (np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes))
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(buffer[at])])


SUFFIX = pa.schema([("anchor", pa.int64()), ("right", pa.binary()), ("left", pa.binary()), ("block", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("pos", pa.int64()), ("back", pa.int32()), ("ahead", pa.int32())])


def suffixes(texts: DataFrame, marks: DataFrame, copies: DataFrame, length: int, buckets: int) -> DataFrame:
    """The suffixes at marked anchors: anchor, bytes to the right, bytes to the left read backwards, and where they are.

    Rows with ``ahead`` set are decided already: a block's later copies of a hot window.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, own = opened(left)
        told = right["bucket"].is_valid().to_numpy()
        h, text, pos = anchors(taking_part(ids, own, right["row"].filter(pa.array(~told)).to_pylist()), length)
        u, _, place, _ = by_bucket(h, buckets)
        listed = right.filter(pa.array(told)).sort_by("bucket")
        mark = np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(zstandard.decompress(x.as_py()), np.uint8) for x in listed["marks"]]])
        if len(mark) != len(u):
            raise RuntimeError("a block's anchors don't match its marks: docs gave other rows when read again")
        sizes = np.array([len(t) for t in own])
        begin = np.r_[0, sizes.cumsum()[:-1]]
        buffer, block = np.frombuffer(b"".join(own), np.uint8), left["block"][0].as_py()
        doc = np.array([-1 if i is None else i for i in ids], np.int64)
        reach, out = length - GRAM, []

        def rows(anchor, at, k, p, ahead_of, back_of, done=None) -> pa.Table:
            some = len(k)
            decided = np.zeros(some, np.int32) if done is None else done
            return pa.table([pa.array(anchor, pa.int64()), pieces(buffer, at, ahead_of), pieces(buffer, at - 1, back_of, -1), pa.array(np.full(some, block), pa.int64()), pa.array(k, pa.int32()), pa.array(doc[k], pa.int64()), pa.array(p, pa.int64()), pa.array(np.zeros(some), pa.int32()), pa.array(decided, pa.int32())], schema=SUFFIX)

        state = mark[place] if len(place) else np.zeros(0, np.uint8)
        plain = np.flatnonzero(state == 1)
        k, p = text[plain], pos[plain]
        out.append(rows(h[plain].view(np.int64), begin[k] + p, k, p, np.minimum(length, sizes[k] - p), np.minimum(reach, p)))
        first: dict[bytes, int] = {}  # the smallest doc_id in this block
        sent: set[tuple[int, int]] = set()
        later: set[tuple[int, int]] = set()
        hot = np.flatnonzero(state == 2)
        for j in hot[np.lexsort((pos[hot], doc[text[hot]]))].tolist():
            k, p = int(text[j]), int(pos[j])
            for s in range(max(0, p - reach), min(p, len(own[k]) - length) + 1):
                known = first.setdefault(own[k][s : s + length], int(doc[k]))
                (later if known < doc[k] else sent).add((k, s))
        if sent:
            k, p = np.array(sorted(sent)).T
            anchor = np.array([xxhash.xxh64_intdigest(own[i][s : s + length]) for i, s in zip(k, p, strict=True)], U).view(np.int64)
            out.append(rows(anchor, begin[k] + p, k, p, np.full(len(k), length), np.zeros(len(k), int)))
        if later:
            k, p = np.array(sorted(later)).T
            out.append(rows(p * 0x9E3779B1 + k, begin[k] + p, k, p, np.zeros(len(k), int), np.zeros(len(k), int), np.full(len(k), length, np.int32)))
        return pa.concat_tables(out)

    schema = "anchor long, right binary, left binary, block long, row int, doc_id long, pos long, back int, ahead int"
    both = marks.select("block", "bucket", "marks", F.lit(None).cast("int").alias("row")).unionByName(copies.select("block", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("marks"), "row"))
    return texts.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(run, schema)


def intervals(lcp: list[int], floor: int) -> Iterator[tuple[int, int, int]]:
    """(first, end, depth) of every interval of the suffix array with a common prefix of ``floor`` or more, by a stack scan; lcp[i] is that of suffixes i - 1 and i, lcp[0] is 0."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        now, start = lcp[i] if i < len(lcp) else 0, i - 1
        while stack and stack[-1][0] > now:
            depth, start = stack.pop()
            yield start, i, depth
        if now >= floor and (not stack or stack[-1][0] < now):
            stack.append((now, start))


def common(a: bytes, b: bytes) -> int:
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def extend(left: list[bytes], doc: list[int], least: int) -> dict[int, int]:
    """For the members of an interval: the longest left extension, of ``least`` or more, that a smaller doc_id shares."""
    if len(doc) == 2:
        both = common(*left)
        return {int(doc[1] > doc[0]): both} if both >= least and doc[0] != doc[1] else {}
    first = min(doc)
    if all(x == left[0] for x in left):  # no diversity to the left
        return {i: len(left[0]) for i, d in enumerate(doc) if d > first} if len(left[0]) >= least else {}
    found: dict[int, int] = {}
    waiting = [i for i, d in enumerate(doc) if d > first]
    for size in range(max(map(len, left)), least - 1, -1):
        least_doc: dict[bytes, int] = {}
        for x, d in zip(left, doc, strict=True):
            if len(x) >= size and least_doc.get(key := x[:size], d) >= d:
                least_doc[key] = d
        rest = []
        for i in waiting:
            if len(left[i]) >= size and least_doc[left[i][:size]] < doc[i]:
                found[i] = size
            else:
                rest.append(i)
        waiting = rest
        if not waiting:
            break
    return found


def repeated_spans(table: DataFrame, length: int) -> DataFrame:
    """(block, row, start, end) of bytes that repeat a smaller doc_id's, from the sorted suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            anchor, doc = t["anchor"].to_numpy(), t["doc_id"].to_pylist()
            right, left = t["right"].to_pylist(), t["left"].to_pylist()
            n = len(doc)
            lens = np.fromiter(map(len, right), np.int64, n)
            wide = np.frombuffer(b"".join([x.ljust(length, b"\0") for x in right]), np.uint8).reshape(n, length)
            differ = wide[1:] != wide[:-1]
            lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
            lcp = np.minimum(lcp, np.minimum(lens[1:], lens[:-1])) * (anchor[1:] == anchor[:-1])
            back, ahead = np.zeros(n, np.int64), t["ahead"].to_numpy().astype(np.int64)
            for first, end, depth in intervals([0, *lcp.tolist()], GRAM):
                for i, e in extend(left[first:end], doc[first:end], max(0, length - depth)).items():
                    back[first + i] = max(back[first + i], e)
                    ahead[first + i] = max(ahead[first + i], depth)
            told = np.flatnonzero(ahead)
            pos = t["pos"].to_numpy()[told]
            return pa.RecordBatch.from_arrays([t["block"].combine_chunks().take(pa.array(told)), t["row"].combine_chunks().take(pa.array(told)), pa.array(pos - back[told], pa.int64()), pa.array(pos + ahead[told], pa.int64())], ["block", "row", "start", "end"])

        for b in batches:
            if not b.num_rows:
                continue
            anchor = b.column(0).to_numpy()
            change = np.flatnonzero(anchor != anchor[-1])
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut or held and held[-1].column(0)[-1].as_py() != anchor[-1]:
                yield flush([*held, b.slice(0, cut)] if cut else held)
                held = []
            held.append(b.slice(cut))
        if held:
            yield flush(held)

    ordered = table.repartition("anchor").sortWithinPartitions("anchor", "right", "left", "doc_id")
    return ordered.mapInArrow(run, "block long, row int, start long, end long")


def cut_out(texts: DataFrame, spans: DataFrame, with_text: bool) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, own = opened(left)
        rows, start, end = (right[c].to_numpy() for c in ("row", "start", "end"))
        order = np.lexsort((start, rows))
        rows, start, end = rows[order], start[order], end[order]
        low, high = np.searchsorted(rows, np.arange(len(ids))), np.searchsorted(rows, np.arange(len(ids)), "right")
        n_removed, n_spans, digest, kept_texts = [], [], [], []
        for k, t in enumerate(own):
            kept, removed, spans, at = [], 0, 0, 0
            for s, e in zip(start[low[k] : high[k]].tolist(), end[low[k] : high[k]].tolist(), strict=True):
                if s == e:
                    continue
                if s > at or not spans:
                    kept.append(t[at:s])
                    spans, removed, at = spans + 1, removed + e - s, e
                elif e > at:
                    removed, at = removed + e - at, e
            kept.append(t[at:])
            text = b"".join(kept)
            n_removed.append(removed)
            n_spans.append(spans)
            digest.append(hashlib.sha256(text).hexdigest())
            kept_texts.append(text.decode("utf-8", "replace") if with_text else None)
        cols = {"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array([len(t) for t in own], pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        return pa.table(cols | ({"kept_text": pa.array(kept_texts, pa.string())} if with_text else {}))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    return texts.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(run, schema)


def dedup(docs: DataFrame, length: int = 50, hot_rows: int = 200_000, block_bytes: int = 8 << 20, buckets: int | None = None, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text]) of every whole text.

    Removes each byte that a string of ``length`` bytes covers which also starts in a
    document with a smaller doc_id, judged on the input. A null text counts as empty; a row
    without doc_id stays whole and is no source of copies; rows that share a doc_id are
    neither earlier nor later than each other; an empty table gives an empty result; other
    columns are ignored. ``docs`` must give the same rows in the same tasks when read again
    (a stored table does); otherwise an error is raised. kept_text replaces what a cut
    leaves of a split character.
    """
    if length < GRAM + 1:
        raise ValueError(f"length must be over {GRAM}")
    if buckets is None:
        buckets = 8 * max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select(F.col("doc_id").cast("long"), "text")
    texts = packed_texts(own, block_bytes)
    copies = stored(later_copies(own, length, block_bytes))
    marks = shared_marks(hash_lists(texts, copies, length, buckets), hot_rows)
    spans = repeated_spans(suffixes(texts, marks, copies, length, buckets), length)
    return cut_out(texts, spans.unionByName(copies), with_text)
