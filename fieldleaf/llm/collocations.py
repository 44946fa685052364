"""Phrase collocations: repeated runs of words that are commoner than their parts suggest.

Suffixes of at most five words are sorted as pointers by a multikey three-way quicksort, of
which the equal partitions are the phrases and their sizes the counts.

1. Words are counted by language. A word is told apart by a 64-bit hash of language and
   word; should a frequent word share its hash with another, all is done again with the next
   seed, so hashes stand for words exactly.
2. Leading pairs of frequent words are counted by a mixed key.
3. Each block of text gives its suffixes, cut where a word or a pair of neighbours isn't
   frequent (no phrase across that place is), equal ones as one row with their number. They
   go to one task for each leading pair of words, where partitions that hold too few are
   abandoned unsorted. A pair that is very common goes to several tasks by the whole suffix,
   and its parts' counts, all of them kept, are added up afterwards.

What is frequent is told to the tasks by bit fields of bounded size in which other words may
fall too: a full field lets more suffixes through and changes no count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldleaf.llm.common import stored

#: Fixed values: what ends a piece, and what stands between words.
ENDS, BETWEEN = b".,;:!?\n\x0b\x0c\r", b" \t"

DEPTH = 5
MARK = b"A"  # stands for the end of a piece: no word holds a capital once A-Z are lower-cased
TABLE = bytes.maketrans(ENDS + BETWEEN, MARK * len(ENDS) + b" " * len(BETWEEN))
FIELD_BITS = (1 << 16, 1 << 27)  # least and most bits of a field
FIVE = [f"h{k}" for k in range(1, DEPTH + 1)]


def words_of(text: str) -> list[bytes]:
    """The words of a text in order, ``MARK`` where a piece ends."""
    return text.encode().lower().translate(TABLE).replace(MARK, b" " + MARK + b" ").split()


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit key of two."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C159E3779B9))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Field:
    """A bit field over 64-bit keys."""

    def __init__(self, keys: DataFrame, key: str) -> None:
        """Set for all ``keys``; built by Spark in pieces of 4 KB, so what is collected is at most the largest field."""
        n = keys.count()
        self.size = min(FIELD_BITS[1], max(FIELD_BITS[0], 1 << (16 * n).bit_length()))
        at = F.col(key).bitwiseAND(F.lit(self.size - 1)) + 1
        self.bits = np.zeros(self.size // 8, np.uint8)
        for r in keys.groupBy(F.bitmap_bucket_number(at).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect():
            self.bits[4096 * (r["at"] - 1) :][:4096] = np.frombuffer(r["bits"], np.uint8)[: self.size // 8]

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = keys & np.uint64(self.size - 1)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0


def by_block(docs: DataFrame, digest: Callable[[bytes], int], block_words: int, work: Callable[[np.ndarray, np.ndarray, list[tuple[str, bytes]]], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` on blocks of whole texts: the words as places in the block's list (0: a piece's or text's end), the hashes of that list, and the list itself (language, word), both from place 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[bytes, int]] = {}
        listed: list[tuple[str, bytes]] = [("", b"")]
        parts: list[np.ndarray] = []
        seen = 0

        def flush() -> pa.RecordBatch:
            nonlocal seen
            prefix = {lang: f"{len(lang)}:{lang}".encode() for lang in known}
            hashes = np.fromiter((digest(prefix[lang] + w) or 1 for lang, w in listed[1:]), np.uint64, len(listed) - 1)
            out = work(np.concatenate(parts), np.r_[np.uint64(0), hashes], listed)
            known.clear()
            del listed[1:]
            parts.clear()
            seen = 0
            return out

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                place = known.setdefault(lang, {MARK: 0})
                words = words_of(text.as_py())
                for w in set(words).difference(place):
                    place[w] = len(listed)
                    listed.append((lang, w))
                parts.append(np.fromiter(map(place.__getitem__, words), np.int32, len(words)))
                parts.append(np.zeros(1, np.int32))
                seen += len(words) + 1
                if seen >= block_words:
                    yield flush()
        if parts:
            yield flush()

    return docs.mapInArrow(run, schema)


def counted_words(docs: DataFrame, digest: Callable[[bytes], int], block_words: int, least: int) -> DataFrame:
    """(lang, h, word, n, words): the words that occur ``least`` times or more, with their hash and how many different words share it, and for each language one row without h for all its others."""

    def work(at: np.ndarray, hashes: np.ndarray, listed: list[tuple[str, bytes]]) -> pa.RecordBatch:
        n = np.bincount(at, minlength=len(listed))[1:]
        langs, words = pa.array([x for x, _ in listed[1:]], pa.string()), pa.array([w.decode() for _, w in listed[1:]], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(hashes[1:].view(np.int64)), langs, words, pa.array(n, pa.int64())], ["h", "lang", "word", "n"])

    made = by_block(docs, digest, block_words, work, "h long, lang string, word string, n long")
    each = made.repartition("h").groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))  # a word is a row once for each block, so none is hot
    own = Window.partitionBy("h")
    each = each.withColumns({"total": F.sum("n").over(own), "words": F.count("*").over(own)})
    often = lambda c: F.when(F.col("total") >= least, F.col(c)).alias(c)  # noqa: E731
    return each.groupBy("lang", often("h"), often("word")).agg(F.sum("n").alias("n"), F.max("words").alias("words"))


def counted_pairs(docs: DataFrame, digest: Callable[[bytes], int], block_words: int, frequent: Field) -> DataFrame:
    """(key, n) for neighbouring words that are both frequent."""

    def work(at: np.ndarray, hashes: np.ndarray, listed: list) -> pa.RecordBatch:
        good = frequent.holds(hashes)
        good[0] = False
        i = np.flatnonzero(good[at[:-1]] & good[at[1:]])
        pair, n = np.unique(at[i].astype(np.int64) << 32 | at[i + 1], return_counts=True)
        key = mixed(hashes[pair >> 32], hashes[pair & 0xFFFFFFFF])
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n, pa.int64())], ["key", "n"])

    return by_block(docs, digest, block_words, work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def suffixes(docs: DataFrame, digest: Callable[[bytes], int], block_words: int, frequent: Field, pairs: Field, hot: np.ndarray, cuts: np.ndarray) -> DataFrame:
    """(route, shared, h1..h5, n): the suffixes of two to five words that may begin with a frequent phrase, 0 after their end.

    ``hot`` are the keys, sorted, of pairs that are dealt over ``cuts`` routes; their rows are marked as shared.
    """

    def work(at: np.ndarray, hashes: np.ndarray, listed: list) -> pa.RecordBatch:
        good = frequent.holds(hashes)
        good[0] = False
        h = hashes[at]
        start = np.flatnonzero(good[at[:-1]] & good[at[1:]])
        key = mixed(h[start], h[start + 1])
        met = pairs.holds(key)
        start, key = start[met], key[met]
        linked = np.zeros(len(at) + DEPTH, bool)
        linked[start] = True
        h = np.concatenate((h, np.zeros(DEPTH, np.uint64)))
        goes = np.ones(len(start), bool)
        cols = [h[start], h[start + 1]]
        row = key
        for k in range(2, DEPTH):
            goes = goes & linked[start + k - 1]
            cols.append(np.where(goes, h[start + k], np.uint64(0)))
            row = mixed(row, cols[-1])
        place = np.searchsorted(hot, key)
        place[place == len(hot)] = 0
        shared = hot[place] == key if len(hot) else np.zeros(len(key), bool)
        route = np.where(shared, mixed(key, row % cuts[place]), key) if len(hot) else key
        order = np.lexsort((row, route))
        first = np.ones(len(order), bool)
        if len(order):  # neighbours that are equal all through, whatever their mixed key
            first[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in cols], axis=0)
        edges = np.flatnonzero(first)
        n = np.diff(np.r_[edges, len(order)])
        kept = order[edges]
        arrays = [pa.array(route[kept].view(np.int64)), pa.array(shared[kept]), *[pa.array(c[kept].view(np.int64)) for c in cols], pa.array(n, pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, ["route", "shared", *FIVE, "n"])

    return by_block(docs, digest, block_words, work, "route long, shared boolean, " + ", ".join(f"{c} long" for c in FIVE) + ", n int")


def quicksort(words: np.ndarray, weight: np.ndarray, segment: np.ndarray, least: np.ndarray) -> list[tuple[np.ndarray, int, np.ndarray]]:
    """Multikey three-way quicksort of the rows of ``words`` (0: no word), all partitions of a round at once.

    ``segment`` numbers the partitions to begin with, in order; ``least`` is what each of
    them must weigh to be sorted further. Returns (row, length, weight) of the equal
    partitions, row being one of theirs.
    """
    found = []
    at, depth = np.arange(len(words)), np.zeros(len(least), np.int64)
    while len(at):
        key = words[at, depth[segment]]
        ended = key == 0
        if ended.any():
            at, segment, key = at[~ended], segment[~ended], key[~ended]
            if not len(at):
                break
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        sizes = np.diff(np.r_[starts, len(at)])
        number = np.repeat(np.arange(len(starts)), sizes)
        depth, least = depth[segment[starts]], least[segment[starts]]
        pivot = key[starts + sizes // 2][number]
        part = 3 * number + (key > pivot) + (key >= pivot)  # below, equal, above
        order = np.argsort(part, kind="stable")
        at, part = at[order], part[order]
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        total = np.add.reduceat(weight[at], starts)
        sizes = np.diff(np.r_[starts, len(at)])
        own, equal = part[starts] // 3, part[starts] % 3 == 1
        heavy = total >= least[own]
        for length in range(1, words.shape[1] + 1):
            done = np.flatnonzero(heavy & equal & (depth[own] + 1 == length))
            if len(done):
                found.append((at[starts[done]], length, total[done]))
        depth, least = depth[own] + equal, least[own]
        on = heavy & (depth < words.shape[1])
        keep = np.repeat(on, sizes)
        at, segment = at[keep], np.repeat(np.cumsum(on) - 1, sizes)[keep]
        depth, least = depth[on], least[on]
    return found


def counted_phrases(rows: DataFrame, least: int, chunk: int = 200_000) -> DataFrame:
    """(w, a): phrases of two words and more as arrays of hashes, and how often they occur, if at least ``least`` times."""

    def sort(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        words = np.stack([table[c].to_numpy().view(np.uint64) for c in FIVE], axis=1)
        route, shared = table["route"].to_numpy(), table["shared"].to_numpy()
        starts = np.flatnonzero(np.r_[True, route[1:] != route[:-1]])
        segment = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(route)]))
        # a shared pair's row may meet another's route; then both count as shared, so that nothing is abandoned
        lone = ~np.logical_or.reduceat(shared, starts)
        found = [x for x in quicksort(words, table["n"].to_numpy().astype(np.int64), segment, np.where(lone, least, 1)) if x[1] > 1]
        flat = [words[at, :length].ravel() for at, length, _ in found]
        ends = np.cumsum(np.concatenate([[0], *[np.full(len(at), length) for at, length, _ in found]]))
        w = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *flat]).view(np.int64)))
        return pa.RecordBatch.from_arrays([w, pa.array(np.concatenate([np.zeros(0, np.int64), *[n for *_, n in found]]), pa.int64())], ["w", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if sum(b.num_rows for b in held) >= chunk:
                route = batch.column(0).to_numpy()
                last = held[-1].column(0)[-1].as_py()
                cut = int(np.argmax(route != last)) if (route != last).any() else batch.num_rows
                held.append(batch.slice(0, cut))
                if cut == batch.num_rows:
                    continue
                yield sort(held)
                held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield sort(held)

    dealt = rows.repartition("route").sortWithinPartitions("route")
    return dealt.mapInArrow(run, "w array<long>, a long").groupBy("w").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, inside: int = 100, block_words: int = 2_000_000, route_rows: int = 200_000, hashed: Callable[[bytes, int], int] = xxhash.xxh3_64_intdigest) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases by score.

    Phrases are runs of two to five words within a piece that occur ``least`` times or more;
    one that lies inside a longer phrase with ``inside`` percent of its count is dropped (a
    phrase one word longer tells, as counts fall with length). Scores are of the
    lowest-scoring cut, in whole thousandths; ties go by count and then by the phrase's
    bytes, so ranks are unique. Null texts count as empty, a null language as ``und``;
    repeated rows count each time; doc_id and other columns are ignored; an empty table
    gives an empty result.
    """
    said = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    for seed in range(8):
        digest = partial(hashed, seed=seed)
        counted = stored(counted_words(said, digest, block_words, least))
        words = counted.where("h is not null").select("h", "lang", "word", F.col("n").alias("f"))
        if counted.where("h is not null and words > 1").isEmpty():
            break
    else:
        raise RuntimeError("frequent words share their hashes with others under every seed")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = Field(words, "h")
    pairs = stored(counted_pairs(said, digest, block_words, frequent).where(F.col("n") >= least))
    number = totals.agg(F.sum("n")).first()[0] or 0
    most = max(route_rows, number // 1_000_000)  # so that at most a million pairs are commoner
    common = pairs.where(F.col("n") > most).collect()
    hot = np.array([r["key"] for r in common], np.int64).view(np.uint64)
    order = np.argsort(hot)
    cuts = np.array([-(-r["n"] // route_rows) for r in common], np.uint64)[order]
    rows = suffixes(said, digest, block_words, frequent, Field(pairs, "key"), hot[order], cuts)
    phrases = stored(counted_phrases(rows, least))

    known = phrases.unionByName(words.select(F.array("h").alias("w"), F.col("f").alias("a")))
    count = lambda part, name: known.select(F.col("w").alias(part), F.col("a").alias(name))  # noqa: E731
    k, size = F.col("k"), F.size("w")
    halves = phrases.select("w", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).withColumns({"left": F.slice("w", F.lit(1), k), "right": F.slice("w", k + 1, size - k)})
    halves = halves.join(count("left", "l"), "left").join(count("right", "r"), "right").join(words.select(F.array("h").alias("first"), "lang"), F.slice("w", 1, 1) == F.col("first")).join(totals, "lang")
    score = F.expr("(cast(1000 as decimal(4, 0)) * cast(a as decimal(18, 0))) * cast(n as decimal(18, 0)) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    cut = halves.groupBy("lang", "w", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x")).select("lang", "w", "a", "n", "x.score", "x.l", "x.r")
    longer = phrases.where(size > 2).select(F.explode(F.array(F.slice("w", F.lit(1), size - 1), F.slice("w", F.lit(2), size - 1))).alias("w"), "a").groupBy("w").agg(F.max("a").alias("longer"))
    left = cut.join(longer, "w", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = stored(left.withColumn("place", F.rank().over(best)).where(F.col("place") <= top).drop("place"))
    named = first.select("w", F.posexplode("w").alias("at", "h")).join(words.select("h", "word"), "h").groupBy("w").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "word")))["word"], " ").alias("phrase"))
    ranked = first.join(named, "w").withColumn("rank", F.row_number().over(best.orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The query's rows in DuckDB's SQL.
SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?

]')) AS piece FROM documents),
s AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS o FROM s),
g AS (SELECT lang, list_slice(ws, o, o + k - 1) AS w, count(*) AS f FROM i, (VALUES (1), (2), (3), (4), (5)) v(k) WHERE o + k - 1 <= len(ws) GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE len(w) = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE len(w) > 1 AND f >= 100),
h AS (SELECT lang, w, f, unnest(range(1, len(w))) AS k FROM c),
q AS (SELECT h.lang, h.w, h.f, h.k, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * h.f * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
      FROM h JOIN g x ON x.lang = h.lang AND x.w = list_slice(h.w, 1, k) JOIN g y ON y.lang = h.lang AND y.w = list_slice(h.w, k + 1, len(h.w)) JOIN t ON t.lang = h.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, w ORDER BY score, k) AS first FROM q),
d AS (SELECT DISTINCT c.lang, list_slice(c.w, j, j + m - 1) AS w, c.f FROM c, (VALUES (2), (3), (4)) v(m), (VALUES (1), (2), (3), (4)) u(j) WHERE m < len(c.w) AND j + m - 1 <= len(c.w)),
e AS (SELECT lang, w, max(f) AS longer FROM d GROUP BY lang, w),
z AS (SELECT b.lang, array_to_string(b.w, ' ') AS phrase, b.f AS a, l, r, n, score FROM b LEFT JOIN e ON e.lang = b.lang AND e.w = b.w WHERE first = 1 AND (longer IS NULL OR 100 * longer < 100 * b.f))
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM z) WHERE rank <= 2000
"""
