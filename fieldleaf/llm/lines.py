"""Line dedup by distributed prefix doubling over line-id sequences, with DataFrame operations only.

The suffixes of all texts, as sequences of lines, are named round by round: first by their
first line, then by their first 2, 4, 8, ... lines, each round from the two names of the
round before that a run is made of. A name is the first place (doc_id, line) at which the
run stands, so it is a rank that needs no sort, and it tells at once which copy stays.
Suffixes of one name are an interval of the suffix array whose longest common prefix is at
least the run's length; suffixes whose run stands nowhere else leave the rounds. At the
shortest run that counts, every suffix that isn't its interval's first is a later copy;
lines of later copies, merged where runs overlap or touch, are the maximal repeated runs
that go. Deeper rounds (``intervals``) tell how long the runs are; they change no deletion.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldleaf.llm.common import stored

TEXT = ["doc_id", "h1"]
PLACE = ["doc_id", "line"]


def own_texts(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, ids): each different text once, under its smallest doc_id, with a 128-bit id and a mark (not blank) for each line."""
    read = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("text"), "text").alias("h2"), F.split("text", "\n").alias("lines"))
    ids = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("line"), x).alias("b"), (F.trim(x) != "").alias("said")))
    return read.select("h1", "h2", "doc_id", ids.alias("ids")).groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.first("ids").alias("ids"))


def named(places: DataFrame, *by: str) -> DataFrame:
    """``places`` whose ``by`` stands at two places or more, with ``first``, the first of them. The names are stored, so that the join deals both sides anew and splits a frequent one."""
    names = places.groupBy(*by).agg(F.min(F.struct(*PLACE)).alias("name"), F.count("*").alias("n")).where("n > 1").drop("n")
    return places.join(stored(names), [*by]).drop(*by).withColumnRenamed("name", "first")


def rounds(texts: DataFrame, min_run: int) -> Iterator[tuple[int, DataFrame]]:
    """(length, repeated) for each round: the places (doc_id, h1, line, said, first) whose run of ``length`` lines stands elsewhere too, and where first. Lengths double, and ``min_run`` is one of them."""
    lines = texts.select(*TEXT, F.posexplode("ids").alias("line", "id")).select(*TEXT, "line", "id.a", "id.b", "id.said")
    now, have = named(lines, "a", "b").select(*TEXT, "line", "said", "first"), 1
    while True:
        yield have, now
        step = min(have, min_run - have) if have < min_run else have  # the round before min_run overlaps: a run of 3 is named by two runs of 2
        ahead = Window.partitionBy(*TEXT).orderBy("line").rangeBetween(step, step)
        pairs = now.withColumns({"second": F.first("first").over(ahead), "said": F.col("said") | F.first("said").over(ahead)}).where("second is not null")
        now, have = named(pairs, "first", "second").select(*TEXT, "line", "said", "first"), have + step


def later_runs(texts: DataFrame, min_run: int) -> DataFrame:
    """(doc_id, h1, line, first): where a run of ``min_run`` lines, not all blank, stands that stood at ``first`` before."""
    repeated = next(now for have, now in rounds(texts, min_run) if have == min_run)
    return repeated.where(F.col("said") & (F.struct(*PLACE) > F.col("first"))).select(*TEXT, "line", "first")


def intervals(docs: DataFrame, min_run: int = 2, longest: int = 1 << 20) -> DataFrame:
    """(length, first_doc, first_line, doc_id, line): the occurrences of every repeated run of min_run, 2 min_run, 4 min_run, ... lines (not all blank), up to ``longest``: the suffix array's intervals by the common prefix that they are known to have.

    Texts that are copies as a whole count once, under their smallest doc_id. The rounds end
    when no run of that length repeats.
    """
    out = None
    for have, now in rounds(stored(own_texts(docs)), min_run):
        if have < min_run:
            continue
        now = stored(now.where("said"))
        if have > longest or now.isEmpty():
            break
        told = now.select(F.lit(have).alias("length"), F.col("first.doc_id").alias("first_doc"), F.col("first.line").alias("first_line"), "doc_id", "line")
        out = told if out is None else out.unionByName(told)
    return out if out is not None else docs.sparkSession.createDataFrame([], "length int, first_doc long, first_line int, doc_id long, line int")


def kept_lines(docs: DataFrame, min_run: int = 2) -> DataFrame:
    """(row, kept_text, n_lines, n_deleted, n_runs): row holds all of a document's columns, whatever their names.

    A line goes if it lies in a run of at least ``min_run`` lines, not all of them blank, that
    also starts at a smaller (doc_id, line). Runs are judged on the input; lines are split at
    line feeds only. Null texts and rows without doc_id stay as they are, with zero lines
    deleted, and are no source of copies. Rows that repeat a doc_id and text are equally
    early, so none is the later copy of the other. An empty table gives an empty result.
    """
    texts = stored(own_texts(docs))
    starts = later_runs(texts, min_run).groupBy(*TEXT).agg(F.array_sort(F.collect_list("line")).alias("starts"))  # bounded by the text's own lines
    known = texts.select("h1", "h2", "doc_id").join(starts, TEXT, "left").select("h1", "h2", F.col("doc_id").alias("rep"), F.coalesce("starts", F.array().cast("array<int>")).alias("starts"))
    own = docs.select(F.struct("*").alias("row"), F.when(F.col("doc_id").isNotNull(), F.xxhash64("text")).alias("h1"), F.xxhash64(F.lit("text"), "text").alias("h2"))
    read = own.withColumn("h1", F.when(F.col("row.text").isNotNull(), F.col("h1"))).join(known, ["h1", "h2"], "left").withColumn("lines", F.split("row.text", "\n"))
    every = F.filter(F.sequence(F.lit(0), F.greatest(F.size("lines") - min_run, F.lit(0))), lambda i: (i + min_run <= F.size("lines")) & F.exists(F.slice("lines", i + 1, min_run), lambda x: F.trim(x) != ""))
    starts = F.when(F.col("rep").isNull(), F.array().cast("array<int>")).when(F.col("row.doc_id") > F.col("rep"), every).otherwise(F.col("starts"))  # a later copy of a whole text
    gone = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(i, i + min_run - 1))))
    told = read.select("row", "lines", gone.alias("gone"))
    here = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.array_join(F.transform(F.array_except(here, F.col("gone")), lambda i: F.get("lines", i)), "\n")
    begun = F.size(F.array_except("gone", F.transform("gone", lambda i: i + 1)))
    number = lambda x: F.when(F.col("row.text").isNull(), 0).otherwise(x)
    return told.select("row", F.when(F.col("row.text").isNotNull(), F.when(F.size("gone") == 0, F.col("row.text")).otherwise(kept)).alias("kept_text"), number(F.size("lines")).alias("n_lines"), number(F.size("gone")).alias("n_deleted"), number(begun).alias("n_runs"))


def dedup(docs: DataFrame, min_run: int = 2) -> DataFrame:
    """``docs``, all columns, without the later copies of repeated runs; a text of which nothing is left goes as a whole."""
    found = kept_lines(docs, min_run)
    rest = found.where("n_deleted = 0 or n_deleted < n_lines and trim(kept_text) <> ''")
    cut = F.col("n_deleted") > 0
    new: dict[str, Column] = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))
    return rest.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def report(docs: DataFrame, min_run: int = 2) -> DataFrame:
    """(doc_id, n_lines, n_deleted, n_runs, kept_sha256) for every document."""
    return kept_lines(docs.select("doc_id", "text"), min_run).select("row.doc_id", "n_lines", "n_deleted", "n_runs", F.sha2(F.coalesce(F.col("kept_text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: The same for min_run 2, from the definition: pairs of lines, first copies by grouping.
SQL = """
WITH l AS (SELECT doc_id, CAST(pos AS INT) AS line, lines[pos] AS said FROM (SELECT doc_id, lines, UNNEST(range(1, len(lines) + 1)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))),
w AS (SELECT doc_id, line, said AS x, LEAD(said) OVER (PARTITION BY doc_id ORDER BY line) AS y FROM l),
f AS (SELECT x, y, MIN((doc_id, line)) AS first FROM w WHERE y IS NOT NULL AND (trim(x) <> '' OR trim(y) <> '') GROUP BY x, y),
s AS (SELECT w.doc_id, w.line FROM w JOIN f USING (x, y) WHERE (w.doc_id, w.line) > f.first),
g AS (SELECT DISTINCT doc_id, line + k.d AS line FROM s CROSS JOIN (VALUES (0), (1)) AS k(d)),
m AS (SELECT l.*, g.line IS NOT NULL AS gone, LAG(g.line IS NOT NULL, 1, false) OVER (PARTITION BY l.doc_id ORDER BY l.line) AS before FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.line = g.line)
SELECT d.doc_id, CAST(COALESCE(a.n_lines, 0) AS INT) AS n_lines, CAST(COALESCE(a.n_deleted, 0) AS INT) AS n_deleted, CAST(COALESCE(a.n_runs, 0) AS INT) AS n_runs, sha256(COALESCE(a.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN (SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (WHERE gone) AS n_deleted, COUNT(*) FILTER (WHERE gone AND NOT before) AS n_runs, string_agg(said, chr(10) ORDER BY line) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY doc_id) a ON a.doc_id = d.doc_id
"""
