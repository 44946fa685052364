"""The sheet's rules on single values and small pages."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from fieldleaf.functions import checks
from fieldleaf.operators import compare, flatten, geometry, identity, intake, judge, quality, usage
from fieldleaf.plans import defs
from fieldleaf.streaming import streams

VALUES = [
    ("what_doing", "④", "4"), ("what_doing", "⑩", "10"), ("what_doing", "❹", "4"), ("what_doing", "⑪", ""), ("what_doing", "0", ""), ("what_doing", "11", ""),
    ("symbol", "し", ""), ("symbol", "きく", ""), ("symbol", " き　", "き"), ("map_symbol", "g", "g"), ("map_symbol", "ⓖ", "g"), ("map_symbol", "Z", ""), ("map_symbol", "ℊ", ""),
    ("found_month", "④", ""), ("found_month", "⁸", ""), ("found_month", "/8", ""), ("found_month", "７", "7"), ("found_month", "8\n", "8"), ("found_month", "8\n9", ""),
    ("bug_name", "㋐ゲハ", "アゲハ"), ("bug_name", "", ""), ("notice", "ストロ윤인していた", ""), ("location_chome", "山", ""), ("location_chome", "③", ""),
]


def test_values(spark):
    df = spark.createDataFrame(VALUES, "field string, raw string, want string")
    value = checks.candidate(F.col("field"), F.col("raw"))
    got = df.select("field", "raw", "want", F.when(checks.reason(F.col("field"), value) == "", value).otherwise("").alias("got")).where("got <> want").collect()
    assert got == []


def test_folds_agree_with_unicode():
    import unicodedata

    assert (len(defs.FOLDS), len(defs.RINGED_DIGITS)) == (171, 51)
    assert all(unicodedata.normalize("NFKC", k) == v for k, v in defs.FOLDS.items())
    assert not set("".join([*defs.FOLDS.values(), *defs.RINGED_DIGITS.values()])) & {*defs.FOLDS, *defs.RINGED_DIGITS}


def test_header(spark):
    rows = [("grade", "④", "4"), ("grade", "⁴", "⁴"), ("grade", "4年", ""), ("grade", " ", ""), ("school_class", "２", "2"), ("school", "芝", "芝"), ("school", "고", "")]
    value, _ = checks.header_value(F.col("field"), F.col("raw"))
    assert spark.createDataFrame(rows, "field string, raw string, want string").select("*", value.alias("got")).where("got <> want").count() == 0


@pytest.mark.parametrize(("letter_field", "letter", "wording", "want"), [("map_symbol", "B", "芝公園", "G/K"), ("symbol", "け", "池のそば", ""), ("symbol", "き", "しめった地面", ""), ("symbol", "き", "", ""), ("symbol", "き", "どこか", ""), ("map_symbol", "b", "小学校", "")])
def test_disagreement(spark, letter_field, letter, wording, want):
    assert spark.range(1).select(checks.disagreement(letter_field, F.lit(letter), F.lit(wording)).alias("x")).first()["x"] == want


def test_score(spark):
    rows = [(32, 7, 0, 1, 0, "76%"), (2, 2, 4, 0, 0, "0%"), (0, 0, 0, 0, 0, ""), (10, 0, 0, 1, 0, "91%"), (8, 7, 0, 0, 0, "12%")]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e int, want string")
    assert df.where(quality.percent(quality.score(*map(F.col, "abcde"))) != F.col("want")).count() == 0


def page(spark, row, unsure=False):
    rows = [(1, r, 1, *[row.get(f) if r == 1 else None for f in defs.FIELDS], defs.FIELDS if unsure else [], []) for r in range(1, defs.ROWS + 1)]
    read = spark.createDataFrame(rows, "page_id long, row_no int, position int, " + ", ".join(f"`{f}` string" for f in defs.FIELDS) + f", flags array<string>, notes {flatten.NOTE}")
    return quality.checked_rows(read)


FULL = dict(zip(defs.FIELDS, ["アゲハ", "か", "花", "④", "8", "3", "芝", "1", "花だん", "C", "いた"], strict=True))


def test_pages(spark):
    told = quality.reports(page(spark, FULL | {"notice": ""})).first()
    assert (told["percent"], told["offered"], told["gaps"]) == ("91%", 10, 1)
    told = quality.reports(page(spark, FULL | {"found_month": "④"}, unsure=True)).first()
    assert (told["rejected"], told["unsure"], told["gaps"]) == (1, 10, 0)
    problems = {r["field"]: r["problem"] for r in quality.all_problems(page(spark, FULL | {"found_month": "④", "notice": "", "map_symbol": "B"})).collect()}
    assert problems == {"found_month": "rejected", "notice": "missing", "map_symbol": "disagreement", "location_name": "disagreement"}
    assert quality.reports(page(spark, {})).first()["score"] is None
    lines = quality.findings(quality.page_reports(page(spark, FULL | {"found_month": "④", "notice": ""}))).first()["findings"]
    assert lines == ["row 1: found_month: rejected '④', outside the field character set", "row 1: nothing came back for notice, but the row is filled in"]
    assert page(spark, FULL).count() == defs.ROWS


def test_grid(spark):
    for sheet in ("v1", "v2"):
        rows, cols = defs.row_edges(sheet), defs.column_edges(sheet)
        cells = [(r, k + 1, cols[k][0], rows[r - 1], cols[k][1], rows[r]) for r in range(1, 9) for k in range(11)]
        df = spark.createDataFrame(cells, "want_row int, want_ord int, l double, t double, r double, b double")
        assert geometry.placed(df, sheet).where("row_no <> want_row or ord <> want_ord or row_no is null").count() == 0
    edge = spark.createDataFrame([(0.2424, 0.1526), (0.5200, 0.2), (0.05, 0.2), (0.1, 0.9764)], "x double, y double")
    assert [tuple(r) for r in edge.select(geometry.row_at(F.col("y")), geometry.ord_at(F.col("x"))).collect()] == [(2, 2), (2, None), (2, None), (None, 1)]


def test_boxes_make_cells(spark):
    b = (0.07, 0.04, 0.24, 0.15)
    boxes = spark.createDataFrame([(1, 2, "ハ\n", *b, False), (1, 1, "アゲ", *b, True), (1, 3, "x", 0.0, 0.0, 0.01, 0.01, False)], "page_id long, seq int, text string, l double, t double, r double, b double, unsure boolean")
    assert [tuple(r) for r in geometry.cell_texts(boxes).collect()] == [(1, 1, 1, "アゲハ", True)]
    assert geometry.outside(boxes).first()["text"] == "x"


def test_row_numbers(spark):
    rows = [("3", 3), ("3.0", 3), (" 3 ", 3), ("3.7", 3), ("no.3", None), ("inf", None), ("9", None), ("0.9", None), ("3d", None), ("", None), (None, None), ("1e400", None), ("-1", None)]
    got = spark.createDataFrame(rows, "no_raw string, want int").select("no_raw", "want", flatten.row_number_of(F.col("no_raw")).alias("got"))
    assert got.where("not (want <=> got)").collect() == []


def test_envelopes(spark):
    rows = [("a", '[{"no": 1}]', "ok"), ("b", '{"rows": []}', "ok"), ("c", '{"rows": 3}', "no_rows"), ("d", "[1", "not_json"), ("e", "", "no_text"), ("f", "```json\n[]\n```", "ok"), ("g", "```[]", "ok"), ("h", None, "no_text"), ("i", '"x"', "no_rows"), ("j", "null", "no_rows")]
    df = spark.createDataFrame(rows, "page_id string, body string, want string")
    assert [r["page_id"] for r in flatten.envelopes(df).where("status <> want").collect()] == []


def test_completions(spark):
    said = lambda content, **more: json.dumps({"choices": [{"message": {"content": content}, **more}]})
    rows = [("a", said("[]"), "ok", ""), ("b", "[1]", "no_completion", ""), ("c", '{"error": "no such endpoint"}', "no_completion", ""), ("d", '{"choices": []}', "no_completion", ""), ("e", '{"choices": ["x"]}', "malformed_choice", ""), ("f", said(None, finish_reason="length"), "no_text", "length"), ("g", said(" "), "no_text", "no reason given"), ("h", said(5), "no_text", "no reason given"), ("i", said("oops"), "not_json", ""), ("j", "nothing", "no_completion", ""), ("k", said('```json\n{"rows": []}\n```'), "ok", ""), ("l", None, "no_completion", ""), ("m", said("7"), "no_rows", "")]
    df = spark.createDataFrame(rows, "page_id string, answer string, want string, reason string")
    got = flatten.envelopes(flatten.completions(df))
    assert got.where("status <> want or finish_reason <> reason").collect() == []
    assert got.count() == len(rows)


def test_answer_rows_and_flags(spark):
    body = '[{"no": 3.0, "bug_name": 7.0, "colour": "red", "notice": null, "unsure": ["notice", 5, "colour"]}, "oops", {"no": "4", "bug_name": true, "unsure": "notice"}, {"no": 5, "unsure": {}}, {"no": 6, "unsure": []}]'
    read = flatten.envelopes(spark.createDataFrame([(1, body)], "page_id long, body string"))
    rows = flatten.answer_rows(read)
    assert [tuple(r) for r in rows.select("position", "no_raw", "bug_name", "notice").orderBy("position").collect()] == [(1, "3.0", "7.0", None), (3, "4", "true", None), (4, "5", None, None), (5, "6", None, None)]
    flags, notes = flatten.unsure_flags(flatten.numbered(rows))
    assert [tuple(r)[1:] for r in flags.collect()] == [(3, "notice")]
    assert sorted(tuple(r)[1:] for r in notes.collect()) == [(3, 1, "5", "names no column"), (3, 2, "colour", "names no column"), (4, 0, '"notice"', "not a list")]


def test_page_with_strip_and_marks(spark):
    page_ = {"rows": [], "grade": "4", "outside_minato": [{"no": 1, "mark": "◎"}, "x", {"mark": "○"}, {"no": 9, "mark": "○"}, {"no": "1.0", "mark": "△"}], "target_species": "none"}
    read = flatten.envelopes(spark.createDataFrame([(1, json.dumps(page_)), (2, "[]"), (3, '{"rows": [], "target_species": null}')], "page_id long, body string"))
    assert {tuple(r) for r in flatten.strip_values(read).collect()} == {(1, "", "4", ""), (2, "", "", ""), (3, "", "", "")}
    got = flatten.row_marks(flatten.mark_entries(read)).orderBy("kind", "position").collect()
    assert [(r["page_id"], r["kind"], r["row_no"], r["note"]) for r in got] == [(1, "outside_minato", 1, ""), (1, "outside_minato", None, "not an object"), (1, "outside_minato", None, "number"), (1, "outside_minato", None, "range"), (1, "outside_minato", 1, "second"), (1, "target_species", None, "not a list")]


def test_document_of_a_blank_page(spark):
    none = spark.createDataFrame([], "page_id long, calls long, seconds double, prompt_tokens long, output_tokens long, thought_tokens long")
    strip = spark.createDataFrame([(1, None, " 4 ", "x")], "page_id long, school string, grade string, school_class string")
    listed = spark.createDataFrame([(1, 1, "1", "outside_minato", " ◎"), (1, 2, "2", "outside_minato", "◎"), (1, 3, "1", "target_species", "〇")], "page_id long, position int, no_raw string, kind string, mark string")

    def made(row):
        pages = quality.with_marks(quality.with_strip(quality.page_reports(page(spark, row)), strip), flatten.page_marks(listed))
        return json.loads(quality.documents(pages.withColumns({"settings": F.lit("engine=x"), "cache_name": F.lit("x_m1")}), none).first()["document"])

    got = made({})
    assert (got["report"]["score"], got["report"]["percent"], got["report"]["cells"], got["usage"]["calls"]) == (None, "", [], 0)
    assert got["findings"] == ["header: school_class: rejected 'x', not a number", "row 1: outside_minato: dropped ' ◎', the row names no place", "row 2: outside_minato: dropped '◎', the row names no place", "row 1: target_species: dropped '〇', not one of the marks"]
    assert (got["grade"], got["school"], got["outside_minato"], got["target_species"]) == ("4", "", [""] * 8, [""] * 8)
    assert [r["no"] for r in got["rows"]] == list("12345678")
    assert got["cache_name"] == "x_m1"
    assert made(FULL)["outside_minato"] == ["◎"] + [""] * 7


def test_notes_in_order(spark):
    """All kinds of notes on one answer, and flags of a kept row only; marks for rows that came twice, nowhere, or in no list."""
    rows = [{"no": 2, "bug_name": "トンボ", "unsure": ["bug_name", "colour", None]}, "oops", {"no": "no.3"}, {"no": 2, "bug_name": "アリ", "unsure": "notice"}, {"no": 9}, {"no": 6, "notice": "いた", "unsure": {"a": 1}}, {"no": 7.0, "symbol": "", "unsure": ["symbol"]}]
    body = json.dumps({"rows": rows, "outside_minato": [{"no": 2, "mark": "◎"}, 5, {"no": "2", "mark": "○"}, {"no": 12}, {"no": None}], "target_species": {}})
    read = flatten.envelopes(spark.createDataFrame([(1, body)], "page_id long, body string"))
    odd = flatten.entries_of(read).where("kind not like 'OBJECT%'").select("page_id", "position", F.col("text").alias("odd"))
    wide = quality.checked_rows(quality.page_rows(flatten.numbered(flatten.answer_rows(read).unionByName(odd, allowMissingColumns=True))))
    pages = quality.with_marks(quality.page_reports(wide), flatten.page_marks(flatten.mark_entries(read)))
    told = pages.first()
    lines = [x["said"] for x in sorted(told["lines"], key=lambda x: (x["stage"], x["row_no"], x["ord"])) if x["stage"] == 0]
    assert lines == [
        "row 2 came back in position 1",
        "row 2: unsure names no column of this sheet: colour",
        "row 2: unsure names no column of this sheet: null",
        "dropped a row that is not an object: oops",
        "dropped a row: 'no.3' is not a row number",
        "row 2 came back in position 4",
        "dropped a second row numbered 2",
        "dropped row 9: the sheet has 8 rows",
        'row 6: unsure is not a list: {"a":1}',
        "the page came back without row(s) 1, 3, 4, 5, 8",
        "outside_minato: dropped an entry that is not an object",
        "outside_minato: dropped a second mark for row 2",
        "outside_minato: dropped a mark for row 12: the sheet has 8 rows",
        "outside_minato: dropped a mark for '': not a row number",
        "target_species is not a list",
    ]
    assert (told["unsure"], told["rows"][1]["bug_name"], told["outside_minato"]) == (1, "トンボ", [""] * 8)


def test_first_row_wins_and_marks(spark):
    e = spark.createDataFrame([(1, 1, "3"), (1, 2, "3.0"), (1, 3, "x")], "page_id long, position int, no_raw string")
    got = flatten.first_wins(flatten.numbered(e)).orderBy("position").collect()
    assert [(r["position"], r["kept"]) for r in got] == [(1, True), (2, False)]
    m = spark.createDataFrame([(1, 1, "2", "k", "◎"), (1, 2, "2", "k", "○"), (1, 3, "9", "k", "◎"), (1, 4, "?", "k", "◎")], "page_id long, position int, no_raw string, kind string, mark string")
    assert [r["note"] for r in flatten.row_marks(m).orderBy("position").collect()] == ["", "second", "range", "number"]


def test_detections(spark):
    one = lambda text, sure, points: (text, sure, points)
    quad = [("0.2", "0.1"), ("0.4", "0.1"), ("0.4", "0.3"), ("0.1", "0.3")]
    rows = [(1, [one("a", 0.4, quad), one(" ", 0.9, quad), one("b", None, None), one("c", 0.9, [("x", "1")]), one("d", None, quad)])]
    df = spark.createDataFrame(rows, "page_id long, detections array<struct<text string, confidence double, points array<struct<x string, y string>>>>")
    got = {r["text"]: (r["l"], r["b"], r["unsure"], r["note"]) for r in flatten.detection_boxes(df).collect()}
    assert got == {"a": (0.1, 0.3, True, ""), "b": (None, None, False, "no position"), "c": (None, None, False, "unreadable position"), "d": (0.1, 0.3, False, "")}


def test_attempts(spark):
    s = lambda *x: spark.createDataFrame(list(x), "page_id long, attempt int, seconds double, ok boolean")
    got = {r["page_id"]: tuple(r)[1:] for r in usage.rollup(s((1, 1, 5.0, False), (1, 2, 6.0, True), (1, 3, 1.0, True), (2, 1, 1.0, False), (2, 2, 1.0, False), (2, 3, 1.0, False), (2, 4, 1.0, False), (2, 5, 1.0, True), (3, 1, 239.0, False), (3, 2, 1.0, True))).collect()}
    assert got == {1: ("ok", 2, 11.0), 2: ("failed", 4, 4.0), 3: ("out_of_time", 1, 239.0)}


def test_species(spark):
    rows = [("シオカラトンボ", "◎"), ("しおからとんぼ", "◎"), ("シオカラトンホ", "○"), ("たぶんギンヤンマ", "○"), ("キアゲハの幼虫", "◎"), ("カナブン(オス)", "◎"), ("ハチ", None), ("", None), (None, None), ("カマキリ", None), ("かまきり", None), ("アゲハチョウ", None), ("トンボ", None), ("チョウのなかま", None), ("アゲハ", None), ("カメムシ", None), ("カマキリの幼虫", None), ("x" * 3000, None), ("オオカマキリ", "◎")]
    df = spark.createDataFrame([(n, w) for n, w in rows], "name string, want string")
    got = judge.species(df.select("name"), "name")
    assert got.count() == len(rows)
    assert df.join(got, df["name"].eqNullSafe(got["name"])).where("not mark <=> want").collect() == []


def test_species_against_all_distances(spark):
    """The index of deletions finds what comparing with every listed name finds."""
    rng = random.Random(8)
    letters = "".join(defs.SPECIES)
    names = set(defs.SPECIES)
    for s in defs.SPECIES:
        for _ in range(12):
            x = list(s)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(x) + 1)
                x[at : at + rng.randint(0, 1)] = rng.choice(letters) * rng.randint(0, 1)
            names.add("".join(x))
    df = spark.createDataFrame([(n,) for n in sorted(names)], "name string")
    got = {r["name"]: (r["distance"], r["species"]) for r in judge.species(df, "name").collect()}
    for n in names:
        best = min((distance(n, s), k) for k, s in enumerate(defs.SPECIES))
        want = (best[0], defs.SPECIES[best[1]]) if n and best[0] <= 2 and n not in defs.GROUPS else (None, None)
        assert got[n] == want, n


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_judged_rows(spark):
    rows = [(1, 1, "オオカマキリ", "家の前", "バングエド(フィリピン)"), (1, 2, "〃", "〃", "バングエド"), (1, 3, "", "六本木", "〃"), (1, 4, "〃", "", ""), (2, 1, "〃", "道", "バングエド")]
    df = spark.createDataFrame(rows, "page_id long, row_no int, bug_name string, location_town string, location_name string")
    got = {(r["page_id"], r["row_no"]): (r["bug_name"], r["judged_name"], r["mark"], r["judged_place"], r["explained"], r["listed"]) for r in judge.judged(df).collect()}
    assert got == {(1, 1): ("オオカマキリ", "オオカマキリ", "◎", "バングエド(フィリピン)", None, False), (1, 2): ("〃", "オオカマキリ", "◎", "バングエド", "フィリピン", False), (1, 3): ("", "", None, "バングエド", "フィリピン", True), (1, 4): ("〃", "", None, "", None, False), (2, 1): ("〃", "", None, "バングエド", None, False)}


def test_files_are_weighed_before_they_are_read(spark, tmp_path):
    for k, content in enumerate([intake.PNG + b"1", intake.PNG + b"x" * 99, b"GIF", b"\x89PN"]):
        (tmp_path / f"key={k}").mkdir()
        (tmp_path / f"key={k}" / "page").write_bytes(content)
    light, heavy = intake.files(spark, str(tmp_path), 50)
    assert "content" not in heavy.columns
    plan = light._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,50)" in plan
    got = {r["key"]: r["status"] for r in intake.triage_files(spark, str(tmp_path), 50).collect()}
    assert got == {0: 200, 1: 413, 2: 415, 3: 415}


def test_store_is_not_shuffled(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"s{i % 2}", f"c{i % 3}", i) for i in range(60)], "page_id long, settings string, cache_name string, percent int")
    name = identity.file_store(pages.where("page_id % 2 = 0"), "store_of_a_test", str(tmp_path / "store"), 4)
    wanted = pages.select("page_id", "settings", "cache_name").unionByName(spark.createDataFrame([(2, "other", "c2")], "page_id long, settings string, cache_name string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        told = identity.reusable(wanted, name)
        got = {(r["page_id"], r["settings"]): r["cached"] for r in told.collect()}
        plan = told._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(i, f"s{i % 2}"): i % 2 == 0 for i in range(60)} | {(2, "other"): False}
    assert plan.count("Exchange hashpartitioning") == 1 or plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    spark.sql(f"DROP TABLE {name}")


def test_late_pages_are_dropped(spark, tmp_path):
    """Files one at a time: a page's rows and calls add up over files, a page that comes after its window went out is lost."""
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    call = lambda p, t, ok=True: (p, t, 1, int(ok), 2.0, 0, None, None, None, None, None)
    row = lambda p, t, *n: (p, t, 0, 0, 0.0, 1, *n)
    files = [[call(1, at(1, 5)), row(1, at(1, 6), 4, 1, 0, 0, 0), call(2, at(1, 7), False)], [row(1, at(1, 6), 4, 0, 0, 0, 1)], [row(2, at(5, 0), 0, 0, 0, 0, 0)], [call(8, at(5, 10))], [row(3, at(1, 30), 5, 5, 0, 0, 0)], [call(9, at(9, 0))]]
    schema = "page_id long, at timestamp, calls long, succeeded long, seconds double, rows long, " + ", ".join(f"{c} long" for c in streams.COUNTS)
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/raw{k}")
        (tmp_path / "in").mkdir(exist_ok=True)
        part = next((tmp_path / f"raw{k}").glob("part-*.parquet"))
        part.rename(tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = streams.arriving(spark, f"{tmp_path}/in", schema, files=1)
    got = [tuple(r)[1:] for r in streams.drained(streams.quality_totals(stream, "at"), f"{tmp_path}/out", f"{tmp_path}/checkpoint").orderBy("start").collect()]
    assert got == [(2, 1, 4.0, 1, 8, 1, 0, 0, 1, 0.75), (1, 1, 2.0, 1, 0, 0, 0, 0, 0, None)]


def test_fingerprints_and_intake(spark):
    df = spark.createDataFrame([("x", "b", 2), ("x", "a", 1), ("y", "a", 1), ("y", "b", 2), ("z", "a", 2), ("z", "b", 1)], "k string, line string, ord int")
    free = {r["k"]: r["digest"] for r in identity.fingerprint(df, ["k"], "line").collect()}
    tied = {r["k"]: r["digest"] for r in identity.fingerprint(df, ["k"], "line", "ord").collect()}
    assert free["x"] == free["y"] == free["z"]
    assert tied["x"] == tied["y"] != tied["z"]
    content = spark.createDataFrame([(intake.PNG + b"1", 200), (intake.PNG + b"x" * 99, 413), (b"GIF", 415), (b"", 415)], "c binary, want int")
    assert content.where(intake.triage(F.col("c"), 50) != F.col("want")).count() == 0


def test_compare(spark):
    cell = "page_id long, row_no int, ord int, text string"
    got = compare.compare(spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 1, 3, "c")], cell), spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 2, "x"), (1, 1, 4, "d")], cell))
    assert {r["ord"]: r["outcome"] for r in got.collect()} == {1: "equal", 2: "differing", 3: "only_left", 4: "only_right"}


def test_pages_end_once(spark, tmp_path):
    """Calls over several files: a success, four failures, a call past the budget, a page that is given up, and calls after a page's end."""
    t = lambda s: datetime.datetime(2024, 1, 1, 0, 0, 0) + datetime.timedelta(seconds=s)
    files = [
        [(1, 1, t(0), 5.0, False, None), (2, 1, t(0), 1.0, False, None), (3, 1, t(0), 239.5, False, None), (4, 1, t(1), 2.0, False, None)],
        [(1, 2, t(10), 6.0, True, "a"), (2, 2, t(9), 1.0, False, None), (2, 3, t(19), 1.0, False, None), (3, 2, t(250), 1.0, True, "c")],
        [(2, 4, t(60), 1.0, False, None), (2, 5, t(70), 1.0, True, "b"), (1, 3, t(80), 1.0, True, "z")],
        [(9, 1, t(90_000), 1.0, True, "n")],
    ]
    schema = "page_id long, attempt int, at timestamp, seconds double, ok boolean, answer string"
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/raw{k}")
        next((tmp_path / f"raw{k}").glob("part-*.parquet")).rename(tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    ended = streams.finished_pages(streams.arriving(spark, f"{tmp_path}/in", schema, files=1))
    got = sorted(tuple(r) for r in streams.drained(ended, f"{tmp_path}/out", f"{tmp_path}/checkpoint").collect())
    assert got == [(1, "ok", 2, 11.0, "a"), (2, "failed", 4, 4.0, None), (3, "out_of_time", 1, 239.5, None), (4, "failed", 1, 2.0, None), (9, "ok", 1, 1.0, "n")]


def test_pages_move_once(spark, sf):
    """Entries are brought together by page once, by the columns that are read, and a page's counts need no cells."""
    from fieldleaf.queries import QUERIES

    plan = QUERIES["e4_counts"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "candidate, " not in plan


def test_plain_texts(spark):
    """A text that is plain is one that neither strip nor fold changes and that fits its column; every other case of an answer is known."""
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    for field in ("bug_name", "found_day", "map_symbol"):
        x = F.concat(F.lit("1" if field != "map_symbol" else "a"), "c")
        same = (checks.candidate(F.lit(field), x) == x) & checks.fits_characters(F.lit(field), x)
        inner = F.col("c").isin(list(defs.SPACES))  # a space inside isn't plain, though it stays
        assert spark.createDataFrame([(c,) for c in chars], "c string").where((checks.is_plain(field, x) != same) & ~inner).count() == 0
    told = F.upper("c").isin([x.upper() for x in defs.CHOICES["map_symbol"]])
    assert spark.createDataFrame([(c,) for c in chars], "c string").where(checks.on_list(F.lit("map_symbol"), F.col("c")) != told).count() == 0


def test_pages_share_state(spark, tmp_path):
    """256 page numbers are one group, so that Python is called for blocks; a call without a page has its own."""
    calls = spark.range(600).select(F.col("id").alias("page_id"), F.lit(1).alias("attempt"), F.timestamp_seconds(F.col("id")).alias("at"), F.lit(1.0).alias("seconds"), (F.col("id") % 3 > 0).alias("ok"), F.lit("a").alias("answer"))
    calls = calls.unionByName(calls.where("page_id = 1").withColumn("page_id", F.lit(None).cast("long")))
    calls.write.parquet(f"{tmp_path}/in")
    schema = "page_id long, attempt int, at timestamp, seconds double, ok boolean, answer string"
    ended = streams.finished_pages(streams.arriving(spark, f"{tmp_path}/in", schema))
    run = ended.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress) <= 4
    got = spark.read.parquet(f"{tmp_path}/out").where("outcome = 'ok'")
    assert (got.count(), got.where("page_id is null and answer = 'a'").count()) == (401, 1)


def test_only_what_came_is_checked(spark):
    """Page totals and finished rows from the rows that came are those of all eight; a page of which nothing can be placed stays."""
    rows = [(1, 1, "2", "トンボ"), (1, 2, "2", "セミ"), (1, 3, "x", "ハチ"), (1, 4, "7", " ㋐リ　"), (2, 1, "x", "ガ"), (2, 2, "9", "チョウ"), (3, 1, "1", "고")]
    e = spark.createDataFrame(rows, "page_id long, position int, no_raw string, bug_name string").withColumns({f: F.lit("" if f == "symbol" else "1").cast("string") for f in defs.FIELDS if f != "bug_name"})
    e = e.withColumn("unsure", F.try_parse_json(F.lit('["notice","colour","notice",3,null]')))
    came = quality.checked_rows(quality.page_rows(flatten.numbered(e), notes=False, blanks=False))
    whole = quality.checked_rows(quality.page_rows(flatten.numbered(e), notes=False))
    assert came.count() == 5  # two rows of page 1 and one for what has no place on it, one of page 2, one of page 3
    assert quality.reports(came).orderBy("page_id").collect() == quality.reports(whole).orderBy("page_id").collect()
    columns = ["page_id", "row_no", "no", *[f"`{f}`" for f in defs.FIELDS]]
    assert quality.blanks_filled(came).select(*columns).orderBy("page_id", "row_no").collect() == whole.select(*columns).orderBy("page_id", "row_no").collect()
    assert quality.all_problems(came).orderBy("page_id", "row_no", "ord").collect() == quality.all_problems(whole).orderBy("page_id", "row_no", "ord").collect()


def test_short_ways_tell_the_same(spark):
    """Flags without notes and the quick strip, against the long ways, on odd values."""
    odd = ["null", "[]", "{}", '"notice"', "7", "false", '["notice"]', '["where","notice","where",null,5,1.50,true]', '[["notice"],{"notice":1},"Notice"," notice","symbol"]', '["\\"notice\\"","notice"]']
    read = spark.createDataFrame([(x,) for x in [*odd, None]], "x string").select(F.try_parse_json("x").alias("v"))
    assert read.where(~flatten.sure_flags(F.col("v")).eqNullSafe(flatten.read_unsure(F.col("v"))["flags"])).count() == 0
    texts = ["", " ", "a", " a", "a　", " ", "あ い", "\x1fあ ", "​あ", "😀 ", *[f"{c}x{c}" for c in defs.SPACES]]
    both = spark.createDataFrame([(x,) for x in [*texts, None]], "x string")
    assert both.where(~checks.stripped(F.col("x")).eqNullSafe(checks.strip(F.col("x")))).count() == 0


def test_findings_of_what_came(spark):
    """Only rows that came are checked where findings are told too; report, rows, cells and findings are those of all eight rows, in either order of marks and strip."""
    rows = [(1, 1, "2", "トンボ"), (1, 2, "2", "セミ"), (1, 3, "x", "ハチ"), (1, 4, "7", " ㋐リ　"), (2, 1, "x", "ガ"), (2, 2, "9", "チョウ"), (3, 1, "1", "고")]
    e = spark.createDataFrame(rows, "page_id long, position int, no_raw string, bug_name string").withColumns({f: F.lit("" if f == "symbol" else "K" if f == "map_symbol" else "1").cast("string") for f in defs.FIELDS if f != "bug_name"})
    e = flatten.numbered(e.withColumn("unsure", F.try_parse_json(F.lit('["notice","colour","notice",3,null]'))))
    strip = spark.createDataFrame([(1, "芝", "x", "1"), (4, None, " 4 ", None)], "page_id long, school string, grade string, school_class string")
    listed = [(p, i, no, kind, mark) for p in (1, 2, 3) for kind in defs.MARKS for i, (no, mark) in enumerate([("2", "◎"), ("2", "○"), ("7", "?"), ("8", "○"), ("x", "○"), ("12", "")])]
    marks = flatten.page_marks(spark.createDataFrame(listed, "page_id long, position int, no_raw string, kind string, mark string"))
    came, whole = (quality.page_reports(quality.checked_rows(quality.page_rows(e, blanks=b))) for b in (False, True))
    assert quality.page_rows(e, blanks=False).count() == 4  # two rows of page 1, one of pages 2 and 3
    told = lambda df: [(r["page_id"], r["offered"], r["rejected"], r["percent"], r["rows"], r["cells"], sorted(r["lines"]), r["strip"], *[r[k] for k in defs.MARKS]) for r in df.orderBy("page_id").collect()]
    got = told(quality.with_strip(quality.with_marks(came, marks), strip))
    assert got == told(quality.with_marks(quality.with_strip(whole, strip), marks))
    assert [len(r[4]) for r in got[:3]] == [defs.ROWS] * 3
    assert got[0][8:] == (["", "◎", *[""] * 6], ["", "◎", *[""] * 6])
    assert (got[3][1], got[3][8:]) == (None, ([""] * 8, [""] * 8))


def test_cells_and_findings_are_told_once(spark, sf):
    """No filter is pushed down with a copy of what findings are made of, and cells are exploded by generated code."""
    from fieldleaf import queries

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (size(" not in plan(queries.QUERIES["e8_findings"](spark, sf))
    assert "lambda" not in plan(flatten.long_cells(queries.kept(spark, sf)))
    assert spark.range(1).where(F.array_join(F.array(*[checks.capital(F.lit(c)) for x in defs.CHOICES["map_symbol"] for c in checks.cases(x)]), "") != "".join(x for x in defs.CHOICES["map_symbol"] for _ in checks.cases(x))).count() == 0
