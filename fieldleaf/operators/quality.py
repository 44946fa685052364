"""Checked rows, faults, page scores and findings."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldleaf.functions import checks
from fieldleaf.operators import flatten
from fieldleaf.operators.geometry import cell_texts
from fieldleaf.plans import defs


def page_cells(boxes: DataFrame, sheet: str = "v1") -> DataFrame:
    """All cells of every page of ``boxes``: (page_id, cells array<struct<row_no, ord, raw, unsure>>) in the sheet's order, blank and sure where no box came.

    Boxes that come partitioned by page aren't shuffled any more: cells and pages come together on that partitioning.
    """
    found = cell_texts(boxes, sheet, outside=True).groupBy("page_id").agg(F.collect_list(F.when(F.col("row_no").isNotNull(), F.struct((F.col("row_no") * 100 + F.col("ord")).alias("at"), F.struct("raw", "unsure")))).alias("x"))
    each = F.array(*[F.struct(F.lit(r).alias("row_no"), F.lit(k).alias("ord")) for r in range(1, defs.ROWS + 1) for k in range(1, len(defs.FIELDS) + 1)])
    mine = lambda c: F.col("m")[c["row_no"] * 100 + c["ord"]]
    told = F.transform(each, lambda c: F.struct(c["row_no"].alias("row_no"), c["ord"].alias("ord"), F.coalesce(mine(c)["raw"], F.lit("")).alias("raw"), F.coalesce(mine(c)["unsure"], F.lit(False)).alias("unsure")))
    return found.select("page_id", F.map_from_entries("x").alias("m")).select("page_id", told.alias("cells"))


def with_gaps(rows: DataFrame) -> DataFrame:
    """``rows`` (page_id, row_no, ...) once for each of the sheet's rows that they stand for, r: each row that came also stands for those missing after it, a page's first for those before it, and one without a number for a whole page of which nothing else came. No page is ever put together as a whole."""
    if "after" not in rows.columns:
        order = Window.partitionBy("page_id").orderBy("row_no")
        rows = rows.withColumns({"before": F.lag("row_no").over(order), "after": F.lead("row_no").over(order)})
    first, last = F.when(F.col("before").isNull(), 1).otherwise(F.col("row_no")), F.coalesce(F.col("after") - 1, F.lit(defs.ROWS))
    given = F.when(F.col("row_no").isNotNull() | F.col("after").isNull(), F.sequence(first, last))  # entries without a place give rows only where nothing else came
    return rows.select("*", F.explode(given).alias("r"))


def page_rows(placed: DataFrame, notes: bool = True, blanks: bool = True) -> DataFrame:
    """All rows of every page from numbered entries: (page_id, row_no, position, the eleven raw columns, flags, notes), nulls where a row never came.

    The first entry to claim a number is its row. flags are the columns that its ``unsure``
    names; the notes on an answer are on its rows, those on entries without a place and on
    rows that never came on the first that came (none are read without ``notes``). One
    shuffle by page and one sort, whose partitioning later page totals use again. Without
    ``blanks`` rows that never came aren't there, but a page with an entry without a place
    has one blank row without a number (with ``notes`` only if nothing else came), so every
    page stays.
    """
    read = flatten.noted_entries(placed, notes)
    same, order, page = Window.partitionBy("page_id", "row_no"), Window.partitionBy("page_id").orderBy("row_no"), Window.partitionBy("page_id")
    none = lambda kind: F.array().cast(kind)
    rows = read.withColumn("first", ~F.lag("row_no").over(page.orderBy("row_no", "position")).eqNullSafe(F.col("row_no")) | (F.row_number().over(page.orderBy("row_no", "position")) == 1))
    if notes:
        second = F.array(flatten.note(F.col("position"), 1, "second", F.concat(F.lit("dropped a second row numbered "), F.col("row_no").cast("string"))))
        own = F.concat("notes", F.when(F.col("row_no").isNull(), none(flatten.NOTE)).when(F.col("first"), F.col("late_notes")).otherwise(second))
        rows = rows.withColumn("notes", F.flatten(F.collect_list(F.when(F.size(own) > 0, own)).over(same)))
    rows = rows.where("first")
    came = F.col("row_no").isNotNull()
    only = ["page_id", "row_no", F.when(came, F.col("position")).alias("position"), *[F.when(came, F.col(f"`{f}`")).alias(f) for f in defs.FIELDS], F.when(came, F.col("flags")).otherwise(none("array<string>")).alias("flags")]
    if not (notes or blanks):
        return rows.select(*only, none(flatten.NOTE).alias("notes"))
    if notes:
        rows = rows.withColumns({"before": F.lag("row_no").over(order), "after": F.lead("row_no").over(order)})
        rows = rows.withColumns({"unplaced": F.lag(F.when(F.col("row_no").isNull(), F.col("notes"))).over(order), "came": F.collect_list("row_no").over(page)})
        lacking = F.array_except(F.sequence(F.lit(1), F.lit(defs.ROWS)), "came")
        missing = F.when(F.size(lacking) > 0, F.array(flatten.note(F.lit(flatten.AFTER_ROWS), 0, "missing", F.concat(F.lit("the page came back without row(s) "), F.array_join(lacking, ", "))))).otherwise(none(flatten.NOTE))
        rows = rows.withColumn("notes", F.concat("notes", F.coalesce("unplaced", none(flatten.NOTE)), F.when(F.col("before").isNull(), missing).otherwise(none(flatten.NOTE))))
    if not blanks:
        return rows.where(came | F.col("after").isNull()).select(*only, "notes")
    told = with_gaps(rows)
    here = F.col("row_no") == F.col("r")
    bears = F.coalesce(here, F.col("r") == 1)
    return told.select(
        "page_id", F.col("r").alias("row_no"), F.when(here, F.col("position")).alias("position"), *[F.when(here, F.col(f"`{f}`")).alias(f) for f in defs.FIELDS],
        F.when(here, F.col("flags")).otherwise(none("array<string>")).alias("flags"), (F.when(bears, F.col("notes")).otherwise(none(flatten.NOTE)) if notes else none(flatten.NOTE)).alias("notes"),
    )


def blanks_filled(wide: DataFrame) -> DataFrame:
    """(page_id, row_no, no, the eleven columns) for all rows of every page from checked rows that came (``page_rows`` without ``blanks``): so only what came is checked."""
    told = with_gaps(wide.select("page_id", "row_no", *[F.col(f"`{f}`") for f in defs.FIELDS]))
    here = F.col("row_no") == F.col("r")
    return told.select("page_id", F.col("r").alias("row_no"), F.col("r").cast("string").alias("no"), *[F.when(here, F.col(f"`{f}`")).otherwise("").alias(f) for f in defs.FIELDS])


def checked_rows(read: DataFrame) -> DataFrame:
    """One row for each page and row number: the eleven checked columns, the cells with what was read and why it was refused, both pairs' disagreements, the gaps and the notes, the row's counts (``ROW_COUNTS``), its problem cells, and its findings, each of eleven columns or more with nulls where there is none (``bad`` and ``told``, null for a row without any). Each column is checked by its own expressions, so nothing is exploded or shuffled.

    A cell is unsure if ``flags`` name its column and its value stands. Most texts are plain
    ones, which one look tells: only the others are stripped, folded and checked. Counts are
    sums of the columns' own, flags and numbers of fixed width, so who wants no cells makes none and hands on few texts.
    """
    checks.short_methods(read.sparkSession)
    col = lambda prefix, k: F.col(f"{prefix}{k}")
    numbered = list(enumerate(defs.FIELDS, 1))
    text = lambda f: F.coalesce(F.col(f"`{f}`").cast("string"), F.lit(""))
    t = read.select("page_id", "row_no", "flags", "notes", *[text(f).alias(f"came{k}") for k, f in numbered], *[((text(f) == "") | checks.is_plain(f, text(f))).alias(f"plain{k}") for k, f in numbered])
    kept = ["page_id", "row_no", "flags", "notes", *[f"plain{k}" for k, _ in numbered]]
    t = t.select(*kept, *[F.when(col("plain", k), col("came", k)).otherwise(checks.stripped(col("came", k))).alias(f"raw{k}") for k, _ in numbered])
    t = t.withColumns({**{f"offered{k}": col("raw", k) != "" for k, _ in numbered}, **{f"candidate{k}": F.when(col("plain", k), col("raw", k)).otherwise(checks.fold(F.lit(f), col("raw", k))) for k, f in numbered}})
    unlisted = lambda k, f: F.when((col("candidate", k) != "") & ~checks.on_list(F.lit(f), col("candidate", k)), LIST).otherwise(FINE)
    why = lambda k, f: F.when(~col("plain", k) & ~checks.fits_characters(F.lit(f), col("candidate", k)), CHARACTERS).otherwise(unlisted(k, f))
    t = t.withColumns({f"why{k}": why(k, f) for k, f in numbered})
    t = t.withColumns({**{f"stands{k}": (col("why", k) == FINE) & (col("candidate", k) != "") for k, _ in numbered}, **{f"value{k}": F.when(col("why", k) == FINE, col("candidate", k)).otherwise("") for k, _ in numbered}})
    reason = lambda k: F.when(col("why", k) == CHARACTERS, "characters").when(col("why", k) == LIST, "list").otherwise("")

    offered, stands = lambda k: col("offered", k), lambda k: col("stands", k)
    rejected, unsure = lambda k, f: offered(k) & ~stands(k), lambda k, f: stands(k) & F.array_contains("flags", f)
    n = lambda test: reduce(add, [test(k, f).cast("int") for k, f in numbered])
    t = t.withColumns({"n_offered": n(lambda k, f: offered(k)), "n_rejected": n(rejected), "n_unsure": n(unsure), **{f"{a}_reads_like": checks.disagreement(a, *[col("value", defs.FIELDS.index(x) + 1) for x in (a, b)]) for a, b in defs.PAIRS}})
    filled = reduce(or_, [stands(k) for k, _ in numbered])
    t = t.withColumns({"n_gaps": F.when(F.col("n_offered") > 0, len(defs.FIELDS) - F.col("n_offered")).otherwise(0), "n_disagreements": reduce(add, [(F.col(f"{a}_reads_like") != "").cast("int") for a, _ in defs.PAIRS]), "filled": filled})

    problem = lambda k, f: F.when(rejected(k, f), "rejected").when(unsure(k, f), "unsure").otherwise("")
    paired = lambda f: reduce(or_, [F.col(f"{a}_reads_like") != "" for a, b in defs.PAIRS if f in (a, b)], F.lit(False))
    seen = lambda k, f: F.when(paired(f), "disagreement").when(F.col("filled") & ~stands(k), "missing").otherwise("")
    late = lambda k, f: F.when(rejected(k, f), "rejected").when(unsure(k, f), "unsure").otherwise(seen(k, f))
    listed = lambda what: F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(f).alias("field"), what(k, f).alias("problem")) for k, f in numbered])
    cells = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(f).alias("field"), col("raw", k).alias("raw"), col("candidate", k).alias("candidate"), col("value", k).alias("value"), reason(k).alias("reason"), problem(k, f).alias("problem")) for k, f in numbered])
    gaps = F.when(F.col("n_gaps") > 0, F.array_remove(F.array(*[F.when(offered(k), "").otherwise(f) for k, f in numbered]), "")).otherwise(F.array().cast("array<string>"))
    row, at = F.concat(F.lit("row "), F.col("row_no").cast("string"), F.lit(": ")), F.col("row_no").cast("int")
    said = lambda k, f: F.when(rejected(k, f), F.concat(row, F.lit(f"{f}: rejected '"), col("candidate", k), F.when(col("why", k) == CHARACTERS, "', outside the field character set").otherwise("', not one of the printed answers"))).when(unsure(k, f), F.concat(row, F.lit(f"{f}: the engine could not read '"), col("value", k), F.lit("' cleanly")))
    gap = F.concat(row, F.lit("nothing came back for "), F.concat_ws(", ", *[F.when(~offered(k), f) for k, f in numbered]), F.lit(", but the row is filled in"))
    value = {f: col("value", k) for k, f in numbered}
    pair = lambda a, b: F.concat(row, F.lit(f"{a} "), checks.capital(value[a]), F.lit(f" does not agree with {b} '"), value[b], F.lit("', which reads like "), F.col(f"{a}_reads_like"))
    told = [F.when(rejected(k, f) | unsure(k, f), line(1, at, F.lit(k), said(k, f))) for k, f in numbered] + [F.when(F.col("n_gaps") > 0, line(1, at, F.lit(99), gap))]
    told += [F.when(F.col(f"{a}_reads_like") != "", line(2, at, F.lit(k), pair(a, b))) for k, (a, b) in enumerate(defs.PAIRS)]
    bad = [F.when(late(k, f) != "", F.struct(at.alias("row"), F.lit(f).alias("field"), late(k, f).alias("problem"))) for k, f in numbered]
    faulty = F.col("n_rejected") + F.col("n_unsure") + F.col("n_gaps") + F.col("n_disagreements") > 0
    return t.select(
        "page_id", "row_no", F.col("row_no").cast("string").alias("no"), *[col("value", k).alias(f) for k, f in numbered], cells.alias("cells"), "notes",
        *[f"{a}_reads_like" for a, _ in defs.PAIRS], gaps.alias("gaps"), *ROW_COUNTS, listed(seen).alias("seen"), listed(late).alias("found"),
        F.when(faulty, F.array(*told)).alias("told"), F.when(faulty, F.array(*bad)).alias("bad"),
    )


#: Why a value can't stand, as a number: a column of fixed width, which costs less to hand on than a text.
FINE, CHARACTERS, LIST = 0, 1, 2

#: A checked row's five counts.
ROW_COUNTS = ["n_offered", "n_rejected", "n_disagreements", "n_gaps", "n_unsure"]


def box_rows(boxes: DataFrame, sheet: str = "v1") -> DataFrame:
    """``page_rows``, without ``blanks``, of pages that came as boxes: cell texts by the boxes' centres, flags where any box is unsure; a page's boxes in no cell give a row without a number. Boxes that come partitioned by page aren't shuffled."""
    cells = cell_texts(boxes, sheet, outside=True).select("page_id", "row_no", F.when(F.col("row_no").isNotNull(), F.struct("ord", F.struct("raw", "unsure"))).alias("cell"))
    rows = cells.groupBy("page_id", "row_no").agg(F.collect_list("cell").alias("x")).select("page_id", "row_no", F.map_from_entries("x").alias("m"))
    own = lambda k: F.col("m")[F.lit(k)]
    flags = F.array_remove(F.array(*[F.when(own(k)["unsure"], f).otherwise("") for k, f in enumerate(defs.FIELDS, 1)]), "")
    return rows.select("page_id", "row_no", *[own(k)["raw"].alias(f) for k, f in enumerate(defs.FIELDS, 1)], flags.alias("flags"), F.array().cast(flatten.NOTE).alias("notes"))


def problem_cells(wide: DataFrame, cells: str) -> DataFrame:
    """(page_id, row_no, ord, field, problem): those of each row's ``cells`` that have a problem. They are exploded as an expression: a column's size would be pushed down as a filter, with copies of all eleven checks."""
    return wide.select("page_id", "row_no", F.inline(F.filter(cells, lambda c: c["problem"] != "")))


def finished_problems(wide: DataFrame) -> DataFrame:
    """(page_id, row_no, ord, field, problem) visible in finished rows: missing where a filled row has an empty value, disagreement on both columns of a pair, which wins."""
    return problem_cells(wide, "seen")


def all_problems(wide: DataFrame) -> DataFrame:
    """The same with what only the reading knows, rejected and unsure, winning where they meet. Nothing is joined or shuffled."""
    return problem_cells(wide, "found")


def score(values: Column, rejected: Column, disagreements: Column, gaps: Column, unsure: Column) -> Column:
    """1 less the share of faulty cells, never under 0; null for a page that offered nothing."""
    cells = values + gaps
    return F.when(cells > 0, F.greatest(F.lit(0.0), 1 - (rejected + disagreements + gaps + unsure) / cells))


def percent(of: Column) -> Column:
    """'91%', half to even; '' for no score."""
    return F.coalesce(F.concat(F.bround(100 * of).cast("int").cast("string"), F.lit("%")), F.lit(""))


def reports(wide: DataFrame, *more: Column) -> DataFrame:
    """One row for each page: the five counts, the score and its percentage, and ``more`` aggregates of its rows."""
    counts = wide.groupBy("page_id").agg(*[F.sum(c).alias(c.removeprefix("n_")) for c in ROW_COUNTS], *more)
    of = score(*map(F.col, ("offered", "rejected", "disagreements", "gaps", "unsure")))
    return counts.withColumn("score", of).withColumn("percent", percent(F.col("score")))


ONE_LINE = "struct<stage: int, row_no: int, ord: int, said: string>"
LINE = f"array<{ONE_LINE}>"


def line(stage: Column | int, row_no: Column, ord_: Column, said: Column) -> Column:
    """A finding by the place at which it is told; the numbers are ints."""
    return F.struct((stage if isinstance(stage, Column) else F.lit(stage)).alias("stage"), row_no.alias("row_no"), ord_.alias("ord"), said.alias("said"))


def page_reports(wide: DataFrame) -> DataFrame:
    """Each page as one row, on the partitioning that its rows have already: the report (``reports``), all rows array<struct> in order, blank ones for those that aren't in ``wide``, cells (row, field, problem), lines, its findings so far, and named, the rows that name a place (bits 0 to 7) or an insect (bits 8 to 15).

    What is collected is made before, a column at a time: an aggregate and a function of an
    array's elements evaluate what they are given without generated code.
    """
    at = F.col("row_no").cast("int")
    bit = lambda test, first: F.when(test, F.call_function("shiftleft", F.lit(1), at - 1 + first)).otherwise(0)
    place = (F.col("location_town") != "") | (F.col("location_name") != "")
    body = F.when(at.isNotNull(), F.struct(at.alias("row_no"), "no", *[F.col(f"`{f}`") for f in defs.FIELDS]))
    made = wide.select("page_id", *ROW_COUNTS, "notes", "told", "bad", body.alias("body"), bit(at.isNotNull(), 0).alias("came"), (bit(place, 0) + bit(F.col("bug_name") != "", 8)).alias("named"))
    more = [F.sort_array(F.collect_list("body")).alias("rows"), F.flatten(F.collect_list("bad")).alias("bad"), F.flatten(F.collect_list(F.when(F.size("notes") > 0, F.col("notes")))).alias("notes"), F.flatten(F.collect_list("told")).alias("told"), F.bit_or("came").alias("came"), F.bit_or("named").alias("named")]
    pages = reports(made, *more)
    blank = lambda r: F.struct(F.lit(r).alias("row_no"), F.lit(str(r)).alias("no"), *[F.lit("").alias(f) for f in defs.FIELDS])
    have = lambda bits: F.col("came").bitwiseAND(F.lit(bits))
    rows = F.array(*[F.when(have(1 << r - 1) != 0, F.get("rows", F.bit_count(have((1 << r - 1) - 1)))).otherwise(blank(r)) for r in range(1, defs.ROWS + 1)])
    there = lambda c: F.filter(c, lambda x: x.isNotNull())
    lines = F.concat(F.transform("notes", lambda n: line(0, n["position"], n["k"], n["said"])), there("told"))
    return pages.withColumns({"rows": rows, "cells": F.sort_array(there("bad")), "lines": lines}).drop("bad", "notes", "told", "came")


def with_strip(pages: DataFrame, strip: DataFrame) -> DataFrame:
    """``page_reports`` with ``strip`` (page_id, the three raw values) checked: strip array<struct<field, raw, value, reason>>, blank for a page without one, and its findings (stage 3). A page of which only the strip came stays, without a report and with blank marks where ``pages`` have any.

    Pages with both joins come cheapest by ``with_marks`` first: this join keeps pages of
    either side, so what comes after it can't use their partitioning.
    """
    raw = strip.select("page_id", *[checks.stripped(F.coalesce(f, F.lit(""))).alias(f"raw_{f}") for f in defs.HEADER_FIELDS])
    joined = pages.join(raw, "page_id", "full").fillna("", [f"raw_{f}" for f in defs.HEADER_FIELDS])
    joined = joined.withColumns({kind: F.coalesce(kind, F.array_repeat(F.lit(""), defs.ROWS)) for kind in defs.MARKS if kind in pages.columns})
    checked = {f: checks.header_value(F.lit(f), F.col(f"raw_{f}")) for f in defs.HEADER_FIELDS}
    joined = joined.withColumns({f"{name}_{f}": c for f, found in checked.items() for name, c in zip(("value", "why"), found, strict=True)})
    parts = [F.struct(F.lit(f).alias("field"), F.col(f"raw_{f}").alias("raw"), F.col(f"value_{f}").alias("value"), F.col(f"why_{f}").alias("reason")) for f in defs.HEADER_FIELDS]
    why = lambda f: F.when(F.col(f"why_{f}") == "number", "', not a number").when(F.col(f"why_{f}") == "characters", "', outside the field character set").otherwise("', not one of the printed answers")
    none = F.array().cast(LINE)
    told = [F.when(F.col(f"why_{f}") != "", F.array(line(3, F.lit(0), F.lit(k), F.concat(F.lit(f"header: {f}: rejected '"), F.col(f"raw_{f}"), why(f))))).otherwise(none) for k, f in enumerate(defs.HEADER_FIELDS, 1)]
    made = joined.withColumns({"lines": F.concat(F.coalesce("lines", none), *told), "strip": F.array(*parts)})
    return made.drop(*[f"{name}_{f}" for f in defs.HEADER_FIELDS for name in ("raw", "value", "why")])


def with_marks(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """``page_reports`` with ``flatten.page_marks`` checked against the finished rows: an array of eight for each kind of mark, the findings (stages 4 and 5), and the notes on odd entries of the lists (stage 0)."""
    joined = pages.join(marks, "page_id", "left").withColumn("named", F.coalesce("named", F.lit(0)))
    names = lambda bit: F.call_function("shiftright", F.col("named"), bit).bitwiseAND(F.lit(1)) == 1
    told = F.filter("told", lambda m: ~m["if_blank"] | ~names(m["bit"]))
    lines = F.transform(told, lambda m: line(m["stage"], m["at"], m["k"], m["said"]))
    own = lambda k: F.array(*[F.coalesce(F.when(names(F.lit(8 * k + r)), F.col("m")[F.lit(8 * k + r)]), F.lit("")) for r in range(defs.ROWS)])
    none = F.array().cast(LINE)
    made = joined.withColumns({"lines": F.concat(F.coalesce("lines", none), F.coalesce(lines, none)), "m": F.map_from_entries("kept")})
    return made.withColumns({kind: own(k) for k, kind in enumerate(defs.MARKS)}).drop("m", "told", "kept", "named")


def findings(pages: DataFrame) -> DataFrame:
    """(page_id, n_findings, findings array<string>): a page's findings in order; pages without any aren't there. Notes on the answer come first; then for each row its cells and gaps; then the disagreements, the strip, the place marks and the species marks."""
    some = F.when(F.size("lines") > 0, F.array(F.sort_array("lines")["said"]))  # as a filter it would be pushed down with copies of all that lines are made of
    return pages.select("page_id", F.explode(some).alias("findings")).select("page_id", F.size("findings").cast("long").alias("n_findings"), "findings")


def header_values(strip: DataFrame) -> DataFrame:
    """``strip`` (page_id, field, raw) with value and reason."""
    value, why = checks.header_value(F.col("field"), F.col("raw"))
    return strip.withColumns({"value": value, "reason": why})


def checked_marks(marks: DataFrame, wide: DataFrame) -> DataFrame:
    """``marks`` (page_id, row_no, kind, mark) with kept and reason: '', 'list' or 'empty', against the checked rows."""
    said = checks.strip(F.coalesce("mark", F.lit("")))
    about = F.when(F.col("kind") == "outside_minato", (F.col("location_town") != "") | (F.col("location_name") != "")).otherwise(F.col("bug_name") != "")
    listed = F.when(F.col("kind") == "outside_minato", said.isin(defs.MARKS["outside_minato"])).otherwise(said.isin(defs.MARKS["target_species"]))
    why = F.when(said == "", "").when(~listed, "list").when(~F.coalesce(about, F.lit(False)), "empty").otherwise("")
    both = marks.join(wide.select("page_id", "row_no", "location_town", "location_name", "bug_name"), ["page_id", "row_no"], "left")
    return both.withColumns({"reason": why, "kept": F.when(why == "", said).otherwise("")}).drop("location_town", "location_name", "bug_name")


def documents(pages: DataFrame, spent: DataFrame) -> DataFrame:
    """(page_id, document): each of ``page_reports``'s pages as one JSON document.

    It has the page's key (its columns settings and cache_name), its eight rows, its report
    with the problem cells by row and field name, its findings (an empty list where there are
    none), and what it cost (``spent``: calls, seconds and the three token counts, zeros where
    nothing is known). A page without a score has a null there; one without rows is no document. ``with_strip`` and
    ``with_marks`` make it a v2 document: three values more, and two lists of eight marks.
    """
    body = F.transform("rows", lambda r: F.struct(r["no"].alias("no"), *[r[f].alias(f) for f in defs.FIELDS]))
    joined = pages.where("offered is not null").join(spent, "page_id", "left")
    report = F.struct(F.col("offered").alias("values"), "rejected", "disagreements", "gaps", "unsure", "score", "percent", "cells")
    usage = F.struct(*[F.coalesce(F.col(c), F.lit(0).cast(t)).alias(c) for c, t in (("calls", "long"), ("seconds", "double"), ("prompt_tokens", "long"), ("output_tokens", "long"), ("thought_tokens", "long"))])
    parts = ["settings", "cache_name", body.alias("rows"), report.alias("report"), F.sort_array("lines")["said"].alias("findings"), usage.alias("usage")]
    if "strip" in pages.columns:
        parts += [F.get("strip.value", F.lit(k)).alias(f) for k, f in enumerate(defs.HEADER_FIELDS)]
    parts += [kind for kind in defs.MARKS if kind in pages.columns]
    return joined.select("page_id", F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("document"))
