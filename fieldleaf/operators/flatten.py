"""From raw answers to rows: fences, envelopes, row numbers, columns, flags, boxes and marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldleaf.functions.checks import once, strip, stripped
from fieldleaf.plans import defs

NUMBER = r"\A[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


def as_number(raw: Column) -> Column:
    """A double where the text is one decimal number and nothing else; null otherwise."""
    text = stripped(raw)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def row_number_of(raw: Column) -> Column:
    """The whole part of a reported row number if it is one of the sheet's rows; null otherwise."""
    whole = as_number(raw)
    whole = F.when(whole < 0, F.ceil(whole)).otherwise(F.floor(whole))
    return F.when(whole.between(1, defs.ROWS), whole.cast("int"))


def unfence(text: Column) -> Column:
    """The body of a Markdown fence, with or without a language tag or an end; other text as it came."""
    said = strip(text)
    body = F.substring(said, 4, 1 << 30)
    body = F.when(F.contains(body, F.lit("\n")), F.regexp_replace(body, r"\A[^\n]*\n", "")).otherwise(body)
    inner = F.when(F.contains(body, F.lit("```")), F.regexp_replace(body, r"(?s)```(?!.*```).*\z", "")).otherwise(body)
    return F.when(F.startswith(said, F.lit("```")), strip(inner)).otherwise(said)


def completions(answers: DataFrame) -> DataFrame:
    """``answers`` (page_id, answer) of a chat service, answer being its whole JSON: body is the first choice's text, failed says why there is none, finish_reason what the service said of it.

    failed is no_completion (no object, or no choices in it), malformed_choice, no_text or
    null; a choice without text says its reason, other answers an empty one.
    """
    is_a = lambda c, kind: F.coalesce(F.schema_of_variant(c).startswith(kind), F.lit(False))
    read = answers.withColumn("whole", F.try_parse_json("answer"))  # step by step, so that nothing is parsed twice
    read = read.withColumns({"choices": F.try_variant_get("whole", "$.choices", "variant"), "first": F.try_variant_get("whole", "$.choices[0]", "variant")})
    read = read.withColumns({"message": F.try_variant_get("first", "$.message.content", "variant"), "reason": F.try_variant_get("first", "$.finish_reason", "string")})
    read = read.withColumn("body", F.when(is_a("message", "STRING"), F.try_variant_get("message", "$", "string")))
    failed = F.when(~is_a("whole", "OBJECT") | ~is_a("choices", "ARRAY") | F.col("first").isNull(), "no_completion").when(~is_a("first", "OBJECT"), "malformed_choice").when(F.coalesce(strip(F.col("body")), F.lit("")) == "", "no_text")
    read = read.withColumn("failed", failed)
    reason = F.when(F.col("failed") == "no_text", F.coalesce(F.nullif("reason", F.lit("")), F.lit("no reason given"))).otherwise("")
    return read.withColumn("finish_reason", reason).select(*[c for c in answers.columns if c != "answer"], "body", "failed", "finish_reason")


def envelopes(responses: DataFrame) -> DataFrame:
    """``responses`` (page_id, body) with status, page and rows: the object that came, and the list of row objects as a VARIANT and as its own text.

    Status is ok, no_text, not_json or no_rows, or what ``failed`` says already where
    ``completions`` read a chat service's answers. A bare list is a page with an empty strip
    and no marks; an object has its list under rows. A page's status never raises.
    """
    said = responses.withColumn("content", unfence(F.col("body"))).withColumn("json", F.try_parse_json("content"))
    kind = F.schema_of_variant("json")
    bare = kind.startswith("ARRAY")
    listed = F.when(bare, F.col("json")).when(kind.startswith("OBJECT"), F.try_variant_get("json", "$.rows", "variant"))
    read = said.withColumn("rows", listed).withColumn("is_list", F.coalesce(F.schema_of_variant("rows").startswith("ARRAY"), F.lit(False)))
    status = F.when(F.coalesce(F.col("content"), F.lit("")) == "", "no_text").when(F.col("json").isNull(), "not_json").when(~F.col("is_list"), "no_rows").otherwise("ok")
    if "failed" in responses.columns:
        status = F.coalesce("failed", status)
    text = F.when(bare, F.col("content")).otherwise(F.get_json_object("content", "$.rows"))
    told = read.select(*[c for c in responses.columns if c != "failed"], status.alias("status"), F.when(kind.startswith("OBJECT"), F.col("json")).alias("page"), "rows", text.alias("rows_text"))
    kept = [c for c in told.columns if c not in ("status", "page", "rows", "rows_text")]
    return once(told.withColumnsRenamed({c: f"{c}_" for c in ("status", "page", "rows", "rows_text")}), status=F.col("status_"), **{c: F.when(F.col("status_") == "ok", F.col(f"{c}_")) for c in ("page", "rows", "rows_text")}).select(*kept, "status", "page", "rows", "rows_text")


def entries_of(read: DataFrame) -> DataFrame:
    """(page_id, position, kind, text, value) for each entry of ``envelopes``'s rows: what kind of JSON it is, its text as it was written and its VARIANT; position counts from 1."""
    values = F.col("rows").cast("array<variant>")
    both = F.arrays_zip(F.from_json("rows_text", "array<string>").alias("text"), values.alias("value"), F.transform(values, F.schema_of_variant).alias("kind"))
    return read.where("status = 'ok'").select("page_id", F.posexplode(both).alias("pos", "e")).select("page_id", (F.col("pos") + 1).alias("position"), "e.kind", "e.text", "e.value")


def answer_rows(read: DataFrame) -> DataFrame:
    """(page_id, position, no_raw, the eleven columns, unsure) for each row object of ``envelopes``'s rows.

    Values that aren't strings keep the text that they were written in (7.0 stays 7.0);
    unsure is a VARIANT, null if the row has none. Unknown columns never get here.
    """
    named = once(entries_of(read).where(F.col("kind").startswith("OBJECT")), m=F.from_json("text", "map<string,string>"))
    return named.select("page_id", "position", F.col("m")["no"].alias("no_raw"), *[F.col("m")[f].alias(f) for f in defs.FIELDS], F.try_variant_get("value", "$.unsure", "variant").alias("unsure"))


def strip_values(read: DataFrame) -> DataFrame:
    """(page_id, school, grade, school_class) of every page that came: blank where the page is a bare list or lacks them."""
    return read.where("status = 'ok'").select("page_id", *[F.coalesce(F.try_variant_get("page", f"$.{f}", "string"), F.lit("")).alias(f) for f in defs.HEADER_FIELDS])


def mark_entries(read: DataFrame) -> DataFrame:
    """(page_id, kind, position, no_raw, mark, odd) for each entry of a page's two lists of marks; odd is 'not a list' for what is no list, 'not an object' for an entry that is none, else ''. An absent list marks nothing."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.try_variant_get("page", f"$.{k}", "variant").alias("listed")) for k in defs.MARKS])
    lists = read.where("status = 'ok'").select("page_id", F.explode(kinds).alias("k")).select("page_id", "k.kind", "k.listed").withColumn("is", F.schema_of_variant("listed")).where("is <> 'VOID'")
    listed = F.col("is").startswith("ARRAY")
    each = lists.select("page_id", "kind", listed.alias("is_list"), F.posexplode_outer(F.when(listed, F.col("listed").cast("array<variant>"))).alias("pos", "e")).where("not is_list or pos is not null")
    odd = F.when(~F.col("is_list"), "not a list").when(~F.coalesce(F.schema_of_variant("e").startswith("OBJECT"), F.lit(False)), "not an object").otherwise("")
    return each.select("page_id", "kind", F.coalesce(F.col("pos") + 1, F.lit(0)).alias("position"), F.try_variant_get("e", "$.no", "string").alias("no_raw"), F.try_variant_get("e", "$.mark", "string").alias("mark"), odd.alias("odd"))


def numbered(entries: DataFrame) -> DataFrame:
    """``entries`` with row_no (null if it can't be placed) and a note on what was odd about its number."""
    told = once(entries, whole_=as_number(F.col("no_raw")))
    whole, at = F.col("whole_"), F.when(F.col("whole_") < 0, F.ceil("whole_")).otherwise(F.floor("whole_"))
    told = told.withColumn("whole_", F.when(F.abs(whole) < 1e9, at.cast("int")))
    note = (
        F.when(whole.isNull(), F.concat(F.lit("dropped a row: '"), F.coalesce("no_raw", F.lit("")), F.lit("' is not a row number")))
        .when(~whole.between(1, defs.ROWS), F.concat(F.lit("dropped row "), whole.cast("string"), F.lit(f": the sheet has {defs.ROWS} rows")))
        .when(whole != F.col("position"), F.concat(F.lit("row "), whole.cast("string"), F.lit(" came back in position "), F.col("position").cast("string")))
        .otherwise("")
    )
    return told.withColumns({"row_no": F.when(whole.between(1, defs.ROWS), whole), "note": note}).drop("whole_")


def first_wins(placed: DataFrame) -> DataFrame:
    """Rows with a number, each marked as kept or not: the first to claim a number keeps it."""
    order = Window.partitionBy("page_id", "row_no").orderBy("position")
    return placed.where("row_no is not null").withColumn("kept", F.row_number().over(order) == 1)


def missing_rows(entries: DataFrame, kept: DataFrame) -> DataFrame:
    """(page_id, missing): the row numbers that a page never gave, for pages that lack some."""
    got = kept.groupBy("page_id").agg(F.collect_set("row_no").alias("seen"))
    every = F.sequence(F.lit(1), F.lit(defs.ROWS))
    lacking = F.array_except(every, F.coalesce("seen", F.array().cast("array<int>")))
    return entries.select("page_id").distinct().join(got, "page_id", "left").select("page_id", F.array_join(lacking, ", ").alias("missing")).where("missing <> ''")


def long_cells(rows: DataFrame) -> DataFrame:
    """(page_id, row_no, position, ord, field, text) of the cells that hold something; unknown columns never get here."""
    cells = F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.lit(f).alias("field"), stripped(F.coalesce(F.col(f"`{f}`").cast("string"), F.lit(""))).alias("text")) for i, f in enumerate(defs.FIELDS)])
    return rows.select("page_id", "row_no", "position", F.inline(cells)).where("text <> ''")  # a filter of the array would evaluate all cells without generated code


def read_unsure(unsure: Column) -> Column:
    """struct(flags array<string>, odd array<struct<k, name, note>>) of a row's ``unsure``, a VARIANT, without exploding it: only names of the sheet's columns are flags.

    What stands for nothing (null, false, 0, a blank string, an empty list or object) says
    nothing; anything else that isn't a list is odd, and so is each entry that isn't a string
    or names no column. A string's name is the string, anything else's its JSON text.
    """
    kind = F.schema_of_variant(unsure)
    nothing = F.coalesce(kind, F.lit("VOID")).isin("VOID", "OBJECT<>") | F.to_json(unsure).isin("false", "0", '""', "[]")
    string = lambda e: F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string"))
    known = lambda e: F.coalesce(string(e).isin(defs.FIELDS), F.lit(False))
    told = lambda k, name, note: F.struct(k.cast("int").alias("k"), name.alias("name"), F.lit(note).alias("note"))
    each = F.when(~nothing & kind.startswith("ARRAY"), unsure.cast("array<variant>"))
    odd = F.filter(F.transform(each, lambda e, k: F.when(~known(e), told(k, F.coalesce(string(e), F.to_json(e), F.lit("null")), "names no column"))), lambda x: x.isNotNull())
    flags = F.array_distinct(F.transform(F.filter(each, known), string))
    no_list = F.array(told(F.lit(0), F.to_json(unsure), "not a list"))
    return F.struct(
        F.coalesce(flags, F.array().cast("array<string>")).alias("flags"),
        F.when(nothing, F.slice(no_list, 1, 0)).otherwise(F.coalesce(odd, no_list)).alias("odd"),
    )


def sure_flags(unsure: Column) -> Column:
    """``read_unsure``'s flags alone, without a function for each element: as texts, no number, list or object is the name of a column."""
    return F.coalesce(F.array_intersect(F.try_variant_get(unsure, "$", "array<string>"), F.array(*map(F.lit, defs.FIELDS))), F.array().cast("array<string>"))


def unsure_flags(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flags (page_id, row_no, field) and notes (page_id, row_no, k, name, note) from each row's ``unsure``, as ``read_unsure`` reads it."""
    read = rows.select("page_id", "row_no", read_unsure(F.col("unsure")).alias("u"))
    flags = read.select("page_id", "row_no", F.explode("u.flags").alias("field"))
    return flags, read.select("page_id", "row_no", F.explode("u.odd").alias("o")).select("page_id", "row_no", "o.*")


def note(position: Column, k: Column | int, kind: Column | str, said: Column) -> Column:
    """What was odd about an answer, by the place at which it is told: the entry's position, and k among those of one entry."""
    of = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(position, of(k), of(kind), said).cast(ONE_NOTE)


ONE_NOTE = "struct<position: int, k: int, kind: string, said: string>"
NOTE = f"array<{ONE_NOTE}>"


def quoted(x: Column) -> Column:
    return F.concat(F.lit("'"), x, F.lit("'"))


def noted_entries(placed: DataFrame, noted: bool = True) -> DataFrame:
    """``numbered`` entries with flags (array<string>), notes, and late_notes, which only count for an entry that keeps its number; both are left out without ``noted``.

    ``unsure`` (VARIANT) and ``odd`` (the JSON text of an entry that is no object) are read
    where they are there.
    """
    if not noted:
        return placed.withColumn("flags", sure_flags(F.col("unsure")) if "unsure" in placed.columns else F.array().cast("array<string>"))
    at = F.col("position")
    odd = F.col("odd") if "odd" in placed.columns else F.lit(None).cast("string")
    read = placed.withColumn("u", read_unsure(F.col("unsure")) if "unsure" in placed.columns else F.lit(None).cast("struct<flags: array<string>, odd: array<struct<k: int, name: string, note: string>>>"))
    kind = F.when(F.col("row_no").isNotNull(), "position").when(F.col("note").startswith("dropped row "), "range").otherwise("number")
    none = F.array().cast(NOTE)
    notes = F.when(odd.isNotNull(), F.array(note(at, 0, "not_object", F.concat(F.lit("dropped a row that is not an object: "), odd)))).when(F.col("note") != "", F.array(note(at, 0, kind, F.col("note")))).otherwise(none)
    row = F.concat(F.lit("row "), F.col("row_no").cast("string"), F.lit(": unsure "))
    said = lambda o: F.when(o["note"] == "not a list", F.concat(F.lit("is not a list: "), o["name"])).otherwise(F.concat(F.lit("names no column of this sheet: "), o["name"]))
    late = F.transform("u.odd", lambda o: note(at, o["k"] + 2, F.when(o["note"] == "not a list", "unsure_list").otherwise("unsure_name"), F.concat(row, said(o))))
    return read.withColumns({"flags": F.coalesce("u.flags", F.array().cast("array<string>")), "notes": notes, "late_notes": F.when(F.size("u.odd") > 0, late).otherwise(none)}).drop("u")


AFTER_ROWS = 1 << 30  # position of what is told after a page's entries


def page_marks(listed: DataFrame) -> DataFrame:
    """``listed`` (page_id, position, no_raw, kind, mark, odd) for whole pages, by one shuffle and with ``row_marks``'s rows: (page_id, kept array<struct<bit, mark>>, told array<struct<stage, at, k, said, if_blank, bit>>).

    kept are the marks that stand if their row names a place or an insect, bit saying which
    (``quality.page_reports``'s named); told is what is said of the others: notes on odd
    entries, place marks first, after all notes on rows, then the marks that are none, and
    (if_blank) what is said of a mark whose row names nothing.
    """
    whole = as_number(F.col("no_raw")).cast("long").cast("string")
    read = row_marks(listed).withColumns({"text": stripped(F.coalesce("mark", F.lit(""))), "whole": F.when(F.col("note") == "range", whole), "number": F.array_position(F.array(*map(F.lit, defs.MARKS)), F.col("kind")).cast("int")})
    note, place = F.col("note"), F.col("kind") == "outside_minato"
    on_list = F.when(place, F.col("text").isin(defs.MARKS["outside_minato"])).otherwise(F.col("text").isin(defs.MARKS["target_species"]))
    odd = F.concat(
        "kind",
        F.when(note == "not a list", " is not a list")
        .when(note == "not an object", ": dropped an entry that is not an object")
        .when(note == "number", F.concat(F.lit(": dropped a mark for "), quoted(F.coalesce("no_raw", F.lit(""))), F.lit(": not a row number")))
        .when(note == "range", F.concat(F.lit(": dropped a mark for row "), F.col("whole"), F.lit(f": the sheet has {defs.ROWS} rows")))
        .otherwise(F.concat(F.lit(": dropped a second mark for row "), F.col("row_no").cast("string"))),
    )
    why = F.when(~F.col("on_list"), "not one of the marks").when(place, "the row names no place").otherwise("the row names no insect")
    dropped = F.concat(F.lit("row "), F.col("row_no").cast("string"), F.lit(": "), F.col("kind"), F.lit(": dropped "), quoted(F.coalesce("mark", F.lit(""))), F.lit(", "), why)
    read = read.withColumns({"on_list": on_list, "bit": (F.col("number") - 1) * 8 + F.col("row_no") - 1})
    at, k = F.when(note != "", F.lit(AFTER_ROWS + 1) + F.col("number")).otherwise(F.col("row_no")), F.when(note != "", F.col("position").cast("int")).otherwise(0)
    stage = F.when(note != "", 0).when(place, 4).otherwise(5)
    told = F.struct(stage.alias("stage"), at.alias("at"), k.alias("k"), F.when(note != "", odd).otherwise(dropped).alias("said"), ((note == "") & F.col("on_list")).alias("if_blank"), F.coalesce("bit", F.lit(0)).alias("bit"))
    made = read.select("page_id", F.when((note == "") & F.col("on_list"), F.struct("bit", F.col("text").alias("mark"))).alias("kept"), F.when((note != "") | (F.col("text") != ""), told).alias("told"))
    return made.groupBy("page_id").agg(F.collect_list("kept").alias("kept"), F.collect_list("told").alias("told"))


def detection_boxes(answers: DataFrame, unsure_below: float = 0.5) -> DataFrame:
    """Detections ``(page_id, detections array<struct<text, confidence, points array<struct<x, y>>>>)`` as boxes.

    The box encloses the points; blank texts go silently, a missing or unreadable position
    leaves a note; a confidence under ``unsure_below`` makes the reading unsure, none does not.
    """
    d = answers.select("page_id", F.posexplode("detections").alias("pos", "d"))
    corners = {axis: F.sort_array(F.col(f"d.points.{axis}").try_cast("array<double>")) for axis in "xy"}  # nulls come first
    told = d.select("page_id", "pos", stripped(F.coalesce("d.text", F.lit(""))).alias("text"), F.col("d.confidence").alias("confidence"), F.coalesce(F.size("d.points"), F.lit(0)).alias("n"), *[c.alias(axis) for axis, c in corners.items()]).where("text <> ''")
    note = F.when(F.col("n") <= 0, "no position").when(F.get("x", F.lit(0)).isNull() | F.get("y", F.lit(0)).isNull(), "unreadable position").otherwise("")
    told = told.withColumn("note", note)
    edge = lambda axis, k: F.when(F.col("note") == "", F.get(axis, k))
    first, last = F.lit(0), F.col("n") - 1
    return told.select("page_id", F.col("pos").alias("seq"), "text", edge("x", first).alias("l"), edge("y", first).alias("t"), edge("x", last).alias("r"), edge("y", last).alias("b"), F.coalesce(F.col("confidence") < unsure_below, F.lit(False)).alias("unsure"), "note")


def anchored_boxes(documents: DataFrame) -> DataFrame:
    """Anchored text ``(page_id, text, symbols, tokens)`` as boxes in reading order.

    Symbols are preferred over tokens. An entry's text is what its segments cut out of the
    document's; entries are ordered by their first segment's start, ties as given; no
    vertices leaves a note.
    """
    entries = F.when(F.size("symbols") > 0, F.col("symbols")).otherwise(F.col("tokens"))
    e = documents.select("page_id", "text", F.posexplode(entries).alias("pos", "e"))
    start = F.coalesce(F.get("e.segments.start", F.lit(0)), F.lit(0))
    cut = lambda s: F.substring(F.col("text"), F.coalesce(s["start"], F.lit(0)).cast("int") + 1, (s["end"] - F.coalesce(s["start"], F.lit(0))).cast("int"))
    said = F.when(F.size("e.segments") == 1, F.coalesce(cut(F.get("e.segments", F.lit(0))), F.lit(""))).otherwise(F.array_join(F.transform("e.segments", cut), ""))  # most have one, which needs no function of elements
    placed = F.size("e.vertices") > 0
    edge = lambda pick, axis: F.when(placed, pick(F.col(f"e.vertices.{axis}")))
    read = e.select("page_id", stripped(said).alias("text"), start.alias("start"), "pos", edge(F.array_min, "x").alias("l"), edge(F.array_min, "y").alias("t"), edge(F.array_max, "x").alias("r"), edge(F.array_max, "y").alias("b"), F.when(placed, "").otherwise("no position").alias("note")).where("text <> ''")
    return read.withColumn("seq", F.row_number().over(Window.partitionBy("page_id").orderBy("start", "pos"))).drop("start", "pos")


def header_boxes(pages: DataFrame) -> DataFrame:
    """(page_id, field, text, l, t, r, b): one box for each strip value that isn't blank, at its band."""
    told = F.array(*[F.struct(F.lit(f).alias("field"), strip(F.coalesce(F.col(f), F.lit(""))).alias("text"), *[F.lit(v).alias(k) for k, v in zip("ltrb", defs.HEADER_BANDS[f], strict=True)]) for f in defs.HEADER_FIELDS])
    return pages.select("page_id", F.explode(F.filter(told, lambda c: c["text"] != "")).alias("c")).select("page_id", "c.*")


def row_marks(marks: DataFrame) -> DataFrame:
    """``marks`` (page_id, position, no_raw, kind, mark) with row_no and a note: '', 'number', 'range' or 'second', or what is ``odd`` about the entry; the first mark of a row wins, and position is no matter."""
    odd = F.col("odd") if "odd" in marks.columns else F.lit("")
    whole = as_number(F.col("no_raw"))
    placed = marks.withColumns({"row_no": F.when(odd == "", row_number_of(F.col("no_raw"))), "odd": odd})
    order = Window.partitionBy("page_id", "kind", "row_no").orderBy("position")
    note = F.when(F.col("odd") != "", F.col("odd")).when(whole.isNull(), "number").when(F.col("row_no").isNull(), "range").when(F.row_number().over(order) > 1, "second").otherwise("")
    return placed.withColumn("note", note).drop("odd")


def token_counts(log: DataFrame) -> DataFrame:
    """``log`` with output_tokens: engines named beta count their thoughts in the answer already, the others don't; what isn't a number counts as zero."""
    n = lambda c: F.coalesce(F.col(c).try_cast("long"), F.lit(0))
    return log.withColumns({"prompt_tokens": n("prompt_tokens"), "thought_tokens": n("thought_tokens"), "output_tokens": n("answer_tokens") + F.when(F.col("model") == "beta", F.lit(0)).otherwise(n("thought_tokens"))})
