"""Rule-based judgements about checked rows. They approximate what a person would say and never change a reading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldleaf.plans import defs

DITTO = "〃"
HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
#: What is said beside a name, and the words that hedge one.
NOTES = r"[(（][^)）]*[)）]|の(オス|メス|幼虫)\z"
HEDGE = "たぶん"
EXPLAINED = r"\A([^(（]+)[(（]([^)）]+)[)）]\z"


def plain_name(name: Column) -> Column:
    """A name without notes and hedge, in katakana."""
    said = F.regexp_replace(name, NOTES, "")
    said = F.when(F.startswith(said, F.lit(HEDGE)), F.substring(said, len(HEDGE) + 1, 1 << 20)).otherwise(said)
    return F.translate(said, HIRAGANA, KATAKANA)


def deletions(name: Column) -> Column:
    """A name, and it without each one and each two of its characters: names within two edits of each other share one of these."""
    places = lambda x: F.when(F.length(x) > 0, F.sequence(F.lit(1), F.length(x))).otherwise(F.array().cast("array<int>"))
    without = lambda x: F.transform(places(x), lambda k: F.concat(F.substring(x, F.lit(1), k - 1), F.substring(x, k + 1, F.length(x))))
    return F.array_distinct(F.concat(F.array(name), without(name), F.flatten(F.transform(without(name), without))))


def species(names: DataFrame, column: str) -> DataFrame:
    """``names`` with mark, species and distance: the nearest listed species within two edits, the first listed of several; ◎ if exact and not hedged, ○ otherwise, nulls for none.

    A group's name (``defs.GROUPS``) is no species, however near one it is. Each different
    name is looked up once in an index of the list's deletions, and only what meets there is
    compared, so the list may grow; names too long to be near any are not looked up.
    """
    spark = names.sparkSession
    listed = spark.createDataFrame(list(enumerate(defs.SPECIES)), "place int, species string")
    index = listed.select("place", "species", F.explode(deletions(F.col("species"))).alias("key"))
    said = plain_name(F.col("name"))
    different = names.select(F.col(column).alias("name")).distinct().withColumn("said", said)
    near = different.where((F.col("said") != "") & ~F.col("said").isin(defs.GROUPS) & (F.length("said") <= max(map(len, defs.SPECIES)) + 2))
    met = near.select("name", "said", F.explode(deletions(F.col("said"))).alias("key")).join(index, "key")
    best = met.withColumn("distance", F.levenshtein("said", "species")).where("distance <= 2").groupBy("name").agg(F.min(F.struct("distance", "place", "species")).alias("best"))
    mark = F.when((F.col("best.distance") == 0) & ~F.startswith(F.col("name"), F.lit(HEDGE)), "◎").otherwise("○")
    found = best.select(F.col("name").alias(column), mark.alias("mark"), "best.species", "best.distance")
    return names.join(found, column, "left")


def in_minato(*said: Column) -> Column:
    """Whether the town, the place, or what explains it names a listed town."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(x, F.lit(t)), F.lit(False)) for x in said for t in defs.TOWNS])


def judged(rows: DataFrame) -> DataFrame:
    """Both judgements of each row: ``rows`` (page_id, row_no, bug_name, location_town, location_name) with what is judged, and mark, species, distance and listed.

    Ditto marks take the value above them first (nothing above: blank), then a place that
    another row of the page explains takes its explanation along. All of that is one shuffle
    by page. Stored values stay as they are.
    """
    page = Window.partitionBy("page_id")
    above = page.orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    value = lambda c: F.coalesce(F.last(F.when(F.col(c) != DITTO, F.col(c)), ignorenulls=True).over(above), F.lit(""))
    part = lambda k: F.regexp_extract("location_name", EXPLAINED, k)
    told = F.collect_list(F.when(part(1) != "", F.struct("row_no", part(1).alias("name"), part(2).alias("note")))).over(page)
    read = rows.withColumns({"judged_name": value("bug_name"), "judged_town": value("location_town"), "judged_place": value("location_name"), "told": told})
    first = F.array_min(F.filter("told", lambda e: e["name"] == F.col("judged_place")))
    read = read.withColumn("explained", first["note"]).drop("told")
    read = read.withColumn("listed", in_minato(F.col("judged_town"), F.col("judged_place"), F.col("explained")))
    return species(read, "judged_name")


def without_dittos(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with judged: the column's value, or for a ditto mark the last value above it on the page."""
    above = Window.partitionBy("page_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("judged", F.coalesce(F.last(F.when(F.col(column) != DITTO, F.col(column)), ignorenulls=True).over(above), F.lit("")))


def explained(rows: DataFrame) -> DataFrame:
    """``rows`` (page_id, row_no, place) with explained: the note that some row of the page gives in brackets behind the same name; the first row's if several do. One shuffle by page."""
    named = rows.withColumns({"name": F.regexp_extract("place", EXPLAINED, 1), "note": F.regexp_extract("place", EXPLAINED, 2)})
    told = F.collect_list(F.when(F.col("name") != "", F.struct("row_no", "name", "note"))).over(Window.partitionBy("page_id"))
    first = F.array_min(F.filter("told", lambda e: e["name"] == F.col("place")))
    return named.withColumn("told", told).select(*rows.columns, first["note"].alias("explained"))
