"""BPE encoding and decoding through a table of distinct words.

The tokenizer at hand lower-cases and drops white space, so a text's ids are the ids of its
white-space separated words one after another. The work is therefore done once for each
distinct word:

1. Spark tasks split their texts and replace each word by its position in the task's own
   word list (a block: at most ``block_words`` words of text). Texts go on as small arrays
   of positions, word lists as one row for each (block, slice of words by hash).
2. The slices are dealt out by that hash, so all blocks' copies of a word meet in one task,
   which encodes it once.
3. The ids go back to their block and are joined to the texts there by position.

No row or group is larger than a block or a slice, and a frequent word is one entry for
each block, however often it occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MADE = "block long, bucket long, doc_id long, words array<binary>, codes binary"


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@cache
def pieces(path: str) -> list[str]:
    """The pieces by id, special ones included: the bounded table that decoding joins with."""
    by_id = {i: p for p, i in tokenizer(path).get_vocab(with_added_tokens=True).items()}
    return [by_id.get(i, "") for i in range(max(by_id) + 1)]


def blocks(docs: DataFrame, block_words: int, buckets: int) -> DataFrame:
    """Rows of two kinds: a text as codes (bucket null), and a slice of a block's word list (doc_id null, codes null).

    A code is the word's slice and its place in the slice, packed as bucket + place * buckets.
    A block's name holds a digest of its doc_ids, so that a task that is run anew on other
    rows can't be joined with word lists that aren't its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, task = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId()
        place: dict[bytes, int] = {}
        slices: list[list[bytes]] = [[] for _ in range(buckets)]
        texts: list[tuple[int | None, np.ndarray]] = []
        seen, digest = 0, xxhash.xxh64(seed=task)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seen, digest
            block = digest.intdigest() >> 1
            rows = [(b, None, s, None) for b, s in enumerate(slices) if s]
            rows += [(None, i, None, packer.compress(c.view(np.uint8).reshape(-1, 4).T.tobytes())) for i, c in texts]
            for at in range(0, len(rows), 4096):
                some = rows[at : at + 4096]
                cols = [pa.array([x[k] for x in some], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary()))]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int64()), *cols], ["block", "bucket", "doc_id", "words", "codes"])
            place.clear()
            texts.clear()
            for s in slices:
                s.clear()
            seen, digest = 0, xxhash.xxh64(seed=block)

        hashed = xxhash.xxh32_intdigest
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode().split()
                for w in set(words).difference(place):
                    own = slices[b := hashed(w) % buckets]
                    place[w] = b + len(own) * buckets
                    own.append(w)
                texts.append((i, np.fromiter(map(place.__getitem__, words), np.uint32, len(words))))
                digest.update(repr(i).encode())
                seen += len(words) + 1
                if seen >= block_words:
                    yield from flush()
        if texts:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MADE)


def encoded_words(lists: DataFrame, path: str) -> DataFrame:
    """(block, bucket, ids, lengths) for word lists dealt by bucket: 2-byte ids of the slice's words one after another, and how many each word has."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, known, bucket = tokenizer(path), {}, None
        for frame in frames:
            ids, lengths = [], []
            for b, words in zip(frame["bucket"], frame["words"], strict=True):
                if b != bucket:
                    known, bucket = {}, b
                fresh = [w for w in words if w not in known]
                for w, e in zip(fresh, coder.encode_batch_fast([w.decode() for w in fresh], add_special_tokens=False), strict=True):
                    known[w] = np.array(e.ids, np.uint16).tobytes()
                found = [known[w] for w in words]
                ids.append(b"".join(found))
                lengths.append(np.fromiter((len(x) // 2 for x in found), np.uint32, len(found)).tobytes())
            yield pd.DataFrame({"block": frame["block"], "bucket": frame["bucket"], "ids": ids, "lengths": lengths})

    return lists.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(run, "block long, bucket long, ids binary, lengths binary")


def encode(docs: DataFrame, path: str, block_words: int = 4_000_000, buckets: int | None = None, also: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Encodes every whole text and decodes it again.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space),
    decoded_sha256 (of the decoded text) and what ``also`` names of ids (array<int>) and
    decoded (string). Equal to encoding the text in one piece for
    tokenizers that drop white space and have ids below 65,536. A null or empty text has no
    ids and decodes to the empty string. Repeated rows and rows without doc_id each give
    their row; an empty table gives an empty result; other columns are ignored. ``docs``
    must give the same rows in the same tasks when read twice (a stored table does); if it
    doesn't, the join fails with an error instead of giving wrong ids.
    """
    if buckets is None:
        buckets = 8 * max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    made = blocks(docs, block_words, buckets)
    words = encoded_words(made.where("bucket is not null").select("block", "bucket", "words"), path)
    texts = made.where("bucket is null").select("block", "doc_id", "codes")
    extra = "".join(f", {name} {kind}" for name, kind in (("ids", "array<int>"), ("decoded", "string")) if name in also)

    def run(lists: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            raise RuntimeError("a block of words without its texts: docs gave other rows when read again")
        known, unpack = pieces(path), zstandard.ZstdDecompressor().decompress
        start: dict[int, int] = {}
        as_ids: list[np.ndarray] = []
        numbers: list[str] = []
        decoded: list[str] = []
        for b, ids, lengths in zip(lists["bucket"], lists["ids"], lists["lengths"], strict=True):
            flat, ends = np.frombuffer(ids, np.uint16), np.frombuffer(lengths, np.uint32).cumsum().tolist()
            start[b], at, listed = len(as_ids), 0, flat.tolist()
            for end in ends:
                as_ids.append(flat[at:end])
                numbers.append(" ".join(map(str, listed[at:end])))
                decoded.append(" ".join([known[x] for x in listed[at:end]]))
                at = end
        first = np.zeros(buckets, np.int64)
        first[list(start)] = list(start.values())
        empty = {k for k, x in enumerate(numbers) if not x}
        out: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
        lengths_of = np.fromiter(map(len, as_ids), np.int64, len(as_ids))
        for packed in rows["codes"]:
            planes = np.frombuffer(unpack(packed), np.uint8).reshape(4, -1) if packed else np.zeros((4, 0), np.uint8)
            codes = np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)
            if len(codes) and not start:
                raise RuntimeError("a block of texts without its words: docs gave other rows when read again")
            entries = first[codes % buckets] + codes // buckets
            listed = entries.tolist()
            out["n_tokens"].append(int(lengths_of[entries].sum()))
            if empty:
                listed = [k for k in listed if k not in empty]
            text = " ".join([decoded[k] for k in listed])
            out["ids_sha256"].append(hashlib.sha256(" ".join([numbers[k] for k in listed]).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
            if "ids" in also:
                out["ids"].append(np.concatenate([as_ids[k] for k in listed]).astype(np.int32) if listed else np.zeros(0, np.int32))
            if "decoded" in also:
                out["decoded"].append(text)
        return pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64")} | {k: v for k, v in out.items() if k in also or k not in ("ids", "decoded")})

    return words.groupBy("block").cogroup(texts.groupBy("block")).applyInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + extra)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) for ``encoded(doc_id, ids)``: the pieces of the ids joined by a space, as this tokenizer decodes.

    A join with the table of pieces by id, one row of which is looked up for each id; an id
    outside the vocabulary and a null list give no piece. Repeated rows each give their row;
    an empty table gives an empty result.
    """
    listed = F.broadcast(encoded.sparkSession.createDataFrame(list(enumerate(pieces(path))), "id int, piece string"))  # bounded: the vocabulary
    keyed = encoded.select(F.monotonically_increasing_id().alias("row"), "doc_id", "ids").select("row", "doc_id", F.posexplode_outer("ids").alias("pos", "id"))
    joined = keyed.join(listed, "id", "left").groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece")))).alias("found"))
    return joined.select("doc_id", F.array_join("found.piece", " ").alias("text"))
