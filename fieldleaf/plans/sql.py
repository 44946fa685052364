"""The same results in DuckDB's SQL, written from the rules and not from the DataFrame code."""

from __future__ import annotations

import re

from fieldleaf.plans import defs
from fieldleaf.sources.survey import prelude


def text(x: str) -> str:
    """A string as an SQL expression, control characters by number."""
    parts, plain = [], ""
    for c in x:
        if c.isprintable() and c != "'" or c == " ":
            plain += c
        else:
            parts += [f"'{plain}'"] * bool(plain) + [f"chr({ord(c)})"]
            plain = ""
    return "(" + " || ".join(parts + [f"'{plain}'"] * bool(plain or not parts)) + ")"


def listed(xs: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in xs)


def trim(x: str) -> str:
    return f"trim({x}, {text(defs.SPACES)})"


def folded(field: str, x: str) -> str:
    plain = f"translate({x}, '{''.join(defs.FOLDS)}', '{''.join(defs.FOLDS.values())}')"
    single = {k: v for k, v in defs.RINGED_DIGITS.items() if len(v) == 1}
    ringed = f"translate({plain}, '{''.join(single)}', '{''.join(single.values())}')"
    for k, v in defs.RINGED_DIGITS.items():
        if len(v) > 1:
            ringed = f"replace({ringed}, '{k}', '{v}')"
    return f"CASE WHEN {field} IN ({listed(defs.NUMBER_FIELDS)}) THEN {plain} ELSE {ringed} END"


def fits(field: str, x: str) -> str:
    return f"CASE WHEN {field} IN ({listed(defs.NUMBER_FIELDS)}) THEN regexp_full_match({x}, '[0-9]*') WHEN {field} IN ({listed(defs.LETTER_FIELDS)}) THEN regexp_full_match({x}, '[A-Za-z]*') ELSE regexp_full_match({x}, '[{defs.script_class()}]*') END"


def on_list(field: str, x: str) -> str:
    return "CASE " + field + " " + " ".join(f"WHEN '{f}' THEN upper({x}) IN ({listed([v.upper() for v in vs + defs.SPELLINGS.get(f, [])])})" for f, vs in defs.CHOICES.items()) + " ELSE true END"


def reason(field: str, x: str) -> str:
    return f"CASE WHEN NOT ({fits(field, x)}) THEN 'characters' WHEN {x} <> '' AND NOT ({on_list(field, x)}) THEN 'list' ELSE '' END"


NUMBER = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"
V2_CELLS = ", ".join(f"({r}, {k + 1}, '{f}', {defs.column_edges('v2')[k][0]!r}e0, {defs.row_edges('v2')[r - 1]!r}e0, {defs.column_edges('v2')[k][1]!r}e0, {defs.row_edges('v2')[r]!r}e0)" for r in range(1, 9) for k, f in enumerate(defs.FIELDS))
PIVOT = ", ".join(f"max(value) FILTER (WHERE ord = {k + 1}) AS \"{f}\"" for k, f in enumerate(defs.FIELDS))
WORDS = ", ".join(f"('{p}', '{letter}', '{w}')" for p, by in defs.PAIR_WORDS.items() for letter, ws in by.items() for w in ws)
BANDS = ", ".join(f"('{f}', {l}e0, {t}e0, {r}e0, {b}e0)" for f, (l, t, r, b) in defs.HEADER_BANDS.items())  # noqa: E741

LAYERS = [
    f"numbered AS (SELECT *, CASE WHEN regexp_full_match({trim('no_raw')}, '{NUMBER}') THEN CAST(trunc(TRY_CAST({trim('no_raw')} AS DOUBLE)) AS INT) END AS n FROM survey_entries)",
    "placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY page_id, n ORDER BY position) = 1 AS kept FROM numbered WHERE n BETWEEN 1 AND 8)",
    f"kept_long AS (SELECT p.page_id, CAST(p.n AS INT) AS row_no, p.position, g.ord, g.field, {trim('g.raw')} AS text FROM placed p JOIN survey_long g ON g.page_id = p.page_id AND g.position = p.position WHERE p.kept AND {trim('g.raw')} <> '')",
    "cells AS (SELECT p.page_id, c.row_no, c.ord, c.field, COALESCE(k.text, '') AS raw, COALESCE(c.field = CASE (p.page_id + k.position) % 6 WHEN 0 THEN 'notice' WHEN 1 THEN 'symbol' WHEN 3 THEN 'where' END, false) AS unsure FROM (SELECT DISTINCT page_id FROM survey_entries) p CROSS JOIN survey_cells c LEFT JOIN kept_long k ON k.page_id = p.page_id AND k.row_no = c.row_no AND k.ord = c.ord)",
    f"known AS (SELECT field, raw, candidate, {reason('field', 'candidate')} AS reason FROM (SELECT field, raw, {folded('field', 'raw')} AS candidate FROM (SELECT DISTINCT field, raw FROM cells)))",
    "checked AS (SELECT c.*, k.candidate, k.reason, CASE WHEN k.reason = '' THEN k.candidate ELSE '' END AS value, CASE WHEN c.raw <> '' AND (k.reason <> '' OR k.candidate = '') THEN 'rejected' WHEN k.reason = '' AND k.candidate <> '' AND c.unsure THEN 'unsure' ELSE '' END AS problem FROM cells c JOIN known k ON k.field = c.field AND k.raw = c.raw)",
    f"finished AS (SELECT page_id, row_no, {PIVOT} FROM checked GROUP BY page_id, row_no)",
    f"pair_words(pair, letter, word) AS (VALUES {WORDS})",
    "pairs AS (SELECT page_id, row_no, 'symbol' AS pair, 0 AS k, 'where' AS other, upper(symbol) AS letter, \"where\" AS wording FROM finished UNION ALL SELECT page_id, row_no, 'map_symbol', 1, 'location_name', upper(map_symbol), location_name FROM finished)",
    "told AS (SELECT c.*, (SELECT string_agg(DISTINCT w.letter, '/' ORDER BY w.letter) FROM pair_words w WHERE w.pair = c.pair AND contains(c.wording, w.word)) AS named FROM (SELECT DISTINCT pair, letter, wording FROM pairs WHERE wording <> '') c WHERE EXISTS (SELECT 1 FROM pair_words w WHERE w.pair = c.pair AND w.letter = c.letter) AND NOT EXISTS (SELECT 1 FROM pair_words w WHERE w.pair = c.pair AND w.letter = c.letter AND contains(c.wording, w.word)))",
    "disagreements AS (SELECT p.*, t.named FROM pairs p JOIN told t ON t.pair = p.pair AND t.letter = p.letter AND t.wording = p.wording WHERE t.named IS NOT NULL)",
    "gaps AS (SELECT page_id, row_no, ord, field FROM (SELECT *, max(raw) OVER (PARTITION BY page_id, row_no) AS most FROM cells) WHERE most <> '' AND raw = '')",
    "counts AS (SELECT c.page_id, count(*) FILTER (WHERE c.raw <> '') AS offered, count(*) FILTER (WHERE c.problem = 'rejected') AS rejected, COALESCE(any_value(d.n), 0) AS disagreements, COALESCE(any_value(g.n), 0) AS gaps, count(*) FILTER (WHERE c.problem = 'unsure') AS unsure FROM checked c LEFT JOIN (SELECT page_id, count(*) AS n FROM disagreements GROUP BY page_id) d ON d.page_id = c.page_id LEFT JOIN (SELECT page_id, count(*) AS n FROM gaps GROUP BY page_id) g ON g.page_id = c.page_id GROUP BY c.page_id)",
    "scored AS (SELECT *, CASE WHEN offered + gaps > 0 THEN greatest(0e0, 1 - (rejected + disagreements + gaps + unsure) / CAST(offered + gaps AS DOUBLE)) END AS score FROM counts)",
    "reports AS (SELECT *, CASE WHEN score IS NULL THEN '' ELSE CAST(CAST(round_even(100 * score, 0) AS INT) AS VARCHAR) || '%' END AS percent FROM scored)",
    "finished_problems AS (SELECT c.page_id, c.row_no, c.ord, c.field, CASE WHEN d.page_id IS NOT NULL THEN 'disagreement' ELSE 'missing' END AS problem FROM (SELECT *, max(value) OVER (PARTITION BY page_id, row_no) AS most FROM checked) c LEFT JOIN disagreements d ON d.page_id = c.page_id AND d.row_no = c.row_no AND c.field IN (d.pair, d.other) WHERE d.page_id IS NOT NULL OR (c.most <> '' AND c.value = ''))",
    "header_long AS (SELECT page_id, f.field, CASE f.field WHEN 'school' THEN school WHEN 'grade' THEN grade ELSE school_class END AS raw FROM survey_header CROSS JOIN (VALUES ('school'), ('grade'), ('school_class')) AS f(field))",
    f"header_checked AS (SELECT *, CASE WHEN why = '' THEN candidate ELSE '' END AS value, why AS reason FROM (SELECT *, CASE WHEN field = 'school' THEN {reason('field', 'candidate')} WHEN candidate = '' OR regexp_full_match(candidate, '[{defs.digit_class()}]+') THEN '' ELSE 'number' END AS why FROM (SELECT *, {trim(folded('field', 'raw'))} AS candidate FROM header_long)))",
    f"marks_placed AS (SELECT page_id, position, no_raw, kind, mark, n, ok, CASE WHEN NOT ok THEN 'number' WHEN n IS NULL THEN 'range' WHEN ROW_NUMBER() OVER (PARTITION BY page_id, kind, n ORDER BY position) > 1 THEN 'second' ELSE '' END AS note FROM (SELECT *, CASE WHEN ok AND trunc(TRY_CAST({trim('no_raw')} AS DOUBLE)) BETWEEN 1 AND 8 THEN CAST(trunc(TRY_CAST({trim('no_raw')} AS DOUBLE)) AS INT) END AS n FROM (SELECT *, regexp_full_match({trim('no_raw')}, '{NUMBER}') AS ok FROM survey_marks)))",
    f"marks_checked AS (SELECT m.page_id, m.n AS row_no, m.kind, m.mark, CASE WHEN said = '' THEN '' WHEN said NOT IN ('◎', '○') AND NOT (said = '△' AND m.kind = 'outside_minato') THEN 'list' WHEN m.kind = 'outside_minato' AND COALESCE(f.location_town, '') = '' AND COALESCE(f.location_name, '') = '' OR m.kind = 'target_species' AND COALESCE(f.bug_name, '') = '' THEN 'empty' ELSE '' END AS reason, said FROM (SELECT *, {trim('mark')} AS said FROM marks_placed WHERE note = '') m LEFT JOIN finished f ON f.page_id = m.page_id AND f.row_no = m.n)",
    f"header_bands(field, l, t, r, b) AS (VALUES {BANDS})",
    f"v2_cells(row_no, ord, field, l, t, r, b) AS (VALUES {V2_CELLS})",
    "tokens AS (SELECT page_id, attempt, started_at, seconds, ok, model, prompt_tokens, COALESCE(thought_tokens, 0) AS thought_tokens, answer_tokens + CASE WHEN model = 'beta' THEN 0 ELSE COALESCE(thought_tokens, 0) END AS output_tokens FROM attempt_log)",
    "clocks AS (SELECT *, COALESCE(sum(seconds) OVER (PARTITION BY page_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) + (pow(2, attempt - 1) - 1) AS clock FROM attempt_log)",
    "entries_b AS (SELECT page_id, row_no, ord, field, CASE WHEN ord = 1 AND page_id % 10 = 0 THEN 'カナブン' ELSE text END AS text FROM kept_long WHERE NOT (ord = 6 AND (page_id + row_no) % 17 = 0) AND NOT (page_id % 23 = 0 AND row_no = 1) UNION ALL SELECT page_id, row_no, 12, 'extra', '追加' FROM placed2 WHERE page_id % 19 = 0)",
]
LAYERS.insert(-1, "placed2 AS (SELECT page_id, CAST(n AS INT) AS row_no, position FROM placed WHERE kept)")
ANSWERED = "page_id % 51 NOT BETWEEN 2 AND 11"  # the pages that came
WHOLE = "(page_id % 51 = 1 OR page_id % 51 > 13)"  # those of them with strip and lists of marks
LAYERS += [
    "judged AS (SELECT page_id, row_no, bug_name, COALESCE(last_value(CASE WHEN bug_name <> '〃' THEN bug_name END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY row_no), '') AS judged_name, COALESCE(last_value(CASE WHEN location_town <> '〃' THEN location_town END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY row_no), '') AS judged_town, COALESCE(last_value(CASE WHEN location_name <> '〃' THEN location_name END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY row_no), '') AS judged_place FROM finished)",
    f"statuses AS (SELECT DISTINCT page_id, CASE WHEN {ANSWERED} THEN 'ok' WHEN page_id % 51 IN (2, 10) THEN 'not_json' WHEN page_id % 51 IN (3, 8) THEN 'no_text' WHEN page_id % 51 IN (4, 9) THEN 'no_rows' WHEN page_id % 51 = 7 THEN 'malformed_choice' ELSE 'no_completion' END AS status, CASE page_id % 51 WHEN 3 THEN 'length' WHEN 8 THEN 'no reason given' ELSE '' END AS finish_reason FROM survey_entries)",
    "keyed AS (SELECT page_id, 'engine=' || engine || ';model=' || model || ';checks=c1' || CASE WHEN engine = 'gamma' THEN '' ELSE ';grid=g1;prompt=p1' END || CASE WHEN page_id % 2 = 0 THEN '' ELSE ';sheet=v2;header=h1' END AS settings, engine || '_' || model || CASE WHEN page_id % 2 = 0 THEN '' ELSE '_v2' END AS cache_name FROM (SELECT page_id, ['alpha', 'beta', 'gamma'][1 + page_id % 3] AS engine, CASE WHEN page_id % 5 < 2 THEN 'm1' ELSE 'm2' END AS model FROM counts))",
    "problems AS (SELECT * FROM (SELECT c.page_id, c.row_no, c.ord, c.field, CASE WHEN c.problem <> '' THEN c.problem ELSE f.problem END AS problem FROM checked c LEFT JOIN finished_problems f ON f.page_id = c.page_id AND f.row_no = c.row_no AND f.field = c.field) WHERE problem IS NOT NULL)",
    "missing AS (SELECT page_id, string_agg(CAST(row_no AS VARCHAR), ', ' ORDER BY row_no) AS missing FROM (SELECT p.page_id, r.row_no FROM (SELECT DISTINCT page_id FROM survey_entries) p CROSS JOIN range(1, 9) r(row_no) WHERE NOT EXISTS (SELECT 1 FROM placed k WHERE k.page_id = p.page_id AND k.n = r.row_no)) GROUP BY page_id)",
    "notes AS (SELECT page_id, 0 AS stage, CAST(position AS INT) AS row_no, 0 AS ord, CASE WHEN n IS NULL THEN 'dropped a row: ''' || no_raw || ''' is not a row number' WHEN n NOT BETWEEN 1 AND 8 THEN 'dropped row ' || n || ': the sheet has 8 rows' ELSE 'row ' || n || ' came back in position ' || position END AS said FROM numbered WHERE n IS NULL OR n NOT BETWEEN 1 AND 8 OR n <> position UNION ALL SELECT page_id, 0, CAST(position AS INT), 1, 'dropped a second row numbered ' || n FROM placed WHERE NOT kept UNION ALL SELECT page_id, 0, CAST(position AS INT), 0, 'dropped a row that is not an object: ' || odd FROM survey_oddities UNION ALL SELECT page_id, 0, CAST(position AS INT), u.ord, 'row ' || row_no || ': unsure ' || u.said FROM placed2 p JOIN (VALUES (1, 3, 'names no column of this sheet: colour'), (3, 4, 'names no column of this sheet: null'), (4, 2, 'is not a list: ' || chr(34) || 'notice' || chr(34))) u(m, ord, said) ON u.m = (page_id + position) % 6 UNION ALL SELECT page_id, 0, 1073741824 + CASE kind WHEN 'outside_minato' THEN 2 ELSE 3 END, CAST(position AS INT), kind || CASE note WHEN 'number' THEN ': dropped a mark for ''' || no_raw || ''': not a row number' WHEN 'range' THEN ': dropped a mark for row ' || CAST(trunc(TRY_CAST(no_raw AS DOUBLE)) AS BIGINT) || ': the sheet has 8 rows' ELSE ': dropped a second mark for row ' || n END FROM marks_placed WHERE note <> '' UNION ALL SELECT page_id, 0, 1073741824, 0, 'the page came back without row(s) ' || missing FROM missing)",
    f"late AS (SELECT page_id, 3 AS stage, 0 AS row_no, CASE field WHEN 'school' THEN 1 WHEN 'grade' THEN 2 ELSE 3 END AS ord, 'header: ' || field || ': rejected ''' || {trim('raw')} || ''', ' || CASE reason WHEN 'number' THEN 'not a number' WHEN 'characters' THEN 'outside the field character set' ELSE 'not one of the printed answers' END AS said FROM header_checked WHERE reason <> '' UNION ALL SELECT page_id, CASE kind WHEN 'outside_minato' THEN 4 ELSE 5 END, row_no, 0, 'row ' || row_no || ': ' || kind || ': dropped ''' || mark || ''', ' || CASE WHEN reason = 'list' THEN 'not one of the marks' WHEN kind = 'outside_minato' THEN 'the row names no place' ELSE 'the row names no insect' END FROM marks_checked WHERE reason <> '')",
]


def query(select: str) -> str:
    return "WITH " + ",\n".join(prelude() + LAYERS) + "\n" + select


def placed_boxes(cells: str) -> str:
    return f"SELECT x.*, COALESCE(c.row_no, 0) AS row_no, COALESCE(c.ord, 0) AS ord FROM survey_boxes x LEFT JOIN {cells} c ON (x.l + x.r) / 2 >= c.l AND (x.l + x.r) / 2 < c.r AND (x.t + x.b) / 2 >= c.t AND (x.t + x.b) / 2 < c.b"


FINDINGS = """SELECT page_id, count(*) AS n_findings, string_agg(said, chr(10) ORDER BY stage, row_no, ord, said) AS findings FROM (
SELECT page_id, 1 AS stage, row_no, ord, 'row ' || row_no || ': ' || field || CASE WHEN problem = 'unsure' THEN ': the engine could not read ''' || value || ''' cleanly' ELSE ': rejected ''' || candidate || ''', ' || CASE reason WHEN 'characters' THEN 'outside the field character set' ELSE 'not one of the printed answers' END END AS said FROM checked WHERE problem <> ''
UNION ALL SELECT page_id, 1, row_no, 99, 'row ' || row_no || ': nothing came back for ' || string_agg(field, ', ' ORDER BY ord) || ', but the row is filled in' FROM gaps GROUP BY page_id, row_no
UNION ALL SELECT * FROM notes UNION ALL SELECT * FROM late
UNION ALL SELECT page_id, 2, row_no, k, 'row ' || row_no || ': ' || pair || ' ' || letter || ' does not agree with ' || other || ' ''' || wording || ''', which reads like ' || named FROM disagreements) GROUP BY page_id"""

ROW_SAID = " || '|' || ".join(["CAST(row_no AS VARCHAR)", *[f'"{f}"' for f in defs.FIELDS]])
MARKS_SAID = "SELECT page_id, " + ", ".join(f"string_agg(CASE WHEN kind = '{k}' THEN COALESCE(kept, '') END, '|' ORDER BY row_no) AS {k}" for k in defs.MARKS) + " FROM (SELECT p.page_id, r.row_no, k.kind, max(CASE WHEN m.reason = '' THEN m.said END) AS kept FROM (SELECT page_id FROM counts) p CROSS JOIN range(1, 9) r(row_no) CROSS JOIN (VALUES ('outside_minato'), ('target_species')) k(kind) LEFT JOIN marks_checked m ON m.page_id = p.page_id AND m.row_no = r.row_no AND m.kind = k.kind GROUP BY ALL) GROUP BY page_id"
DOCUMENTS = f"""SELECT c.page_id, k.settings, k.cache_name, w.rows, concat_ws('|', c.offered, c.rejected, c.disagreements, c.gaps, c.unsure, r.percent) AS report, r.score, COALESCE(b.cells, '') AS cells, COALESCE(f.findings, '') AS findings, COALESCE(f.n_findings, 0) AS n_findings, COALESCE(u.calls, 0) AS calls, COALESCE(u.seconds, 0e0) AS seconds, concat_ws('|', COALESCE(u.prompt_tokens, 0), COALESCE(u.output_tokens, 0), COALESCE(u.thought_tokens, 0)) AS tokens, COALESCE(h.strip, '||') AS strip, m.outside_minato, m.target_species
FROM counts c JOIN reports r ON r.page_id = c.page_id JOIN keyed k ON k.page_id = c.page_id
JOIN (SELECT page_id, md5(string_agg({ROW_SAID}, chr(10) ORDER BY row_no)) AS rows FROM finished GROUP BY page_id) w ON w.page_id = c.page_id
LEFT JOIN (SELECT page_id, string_agg(row_no || '|' || field || '|' || problem, chr(10) ORDER BY row_no, field) AS cells FROM problems GROUP BY page_id) b ON b.page_id = c.page_id
LEFT JOIN ({FINDINGS}) f ON f.page_id = c.page_id
LEFT JOIN (SELECT page_id, count(*) AS calls, round(sum(seconds), 3) AS seconds, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(thought_tokens)::BIGINT AS thought_tokens FROM tokens GROUP BY page_id) u ON u.page_id = c.page_id
LEFT JOIN (SELECT page_id, max(value) FILTER (WHERE field = 'school') || '|' || max(value) FILTER (WHERE field = 'grade') || '|' || max(value) FILTER (WHERE field = 'school_class') AS strip FROM header_checked GROUP BY page_id) h ON h.page_id = c.page_id
JOIN ({MARKS_SAID}) m ON m.page_id = c.page_id"""

#: The rules' layers once more over cells that came as boxes: names from these on carry a prefix.
RULES = ["cells", "known", "checked", "finished", "pairs", "told", "disagreements", "gaps", "counts", "scored", "reports", "finished_problems", "problems"]
OF_BOXES = re.compile(r"\b(" + "|".join(RULES) + r")\b")
BOX_CELLS = f"box_cells AS (SELECT p.page_id, c.row_no, c.ord, c.field, COALESCE({trim('k.raw')}, '') AS raw, COALESCE(k.unsure, false) AS unsure FROM (SELECT DISTINCT page_id FROM survey_boxes) p CROSS JOIN survey_cells c LEFT JOIN (SELECT page_id, row_no, ord, replace(string_agg(text, '' ORDER BY seq), chr(10), '') AS raw, bool_or(unsure) AS unsure FROM ({placed_boxes('survey_cells')}) WHERE row_no > 0 GROUP BY ALL) k ON k.page_id = p.page_id AND k.row_no = c.row_no AND k.ord = c.ord)"


def box_layers() -> list[str]:
    by_name = {x.split(" AS (", 1)[0]: x for x in LAYERS}
    return [BOX_CELLS, *[OF_BOXES.sub(r"box_\1", by_name[name]) for name in RULES[1:]]]


PARTS = FINDINGS.split("UNION ALL SELECT * FROM notes UNION ALL SELECT * FROM late")
BOX_STRIP = "UNION ALL SELECT * FROM late WHERE stage = 3 AND page_id IN (SELECT page_id FROM box_counts)"
BOX_FINDINGS = OF_BOXES.sub(r"box_\1", PARTS[0]) + BOX_STRIP + OF_BOXES.sub(r"box_\1", PARTS[1])
BOX_DOCUMENTS = DOCUMENTS.replace(f"({FINDINGS})", "(@)").rsplit("\n", 1)[0].replace(", m.outside_minato, m.target_species", "")
for plain, own in {"FROM counts c JOIN reports r": "FROM box_counts c JOIN box_reports r", "FROM finished": "FROM box_finished", "FROM problems": "FROM box_problems", "c.disagreements": "c.box_disagreements", "c.gaps": "c.box_gaps", "(@)": f"({BOX_FINDINGS})"}.items():
    BOX_DOCUMENTS = BOX_DOCUMENTS.replace(plain, own)

SPECIES = ", ".join(f"({k}, '{s}')" for k, s in enumerate(defs.SPECIES))
#: levenshtein counts bytes here, so each kana becomes one byte first.
ONE_BYTE = "".join(map(chr, range(0x30A1, 0x30F7))) + "ー", "".join(c for c in map(chr, range(33, 127)) if c != "'")[:87]
TOWNS = ", ".join(f"('{t}')" for t in defs.TOWNS)
KANA = "".join(map(chr, range(0x3041, 0x3097))), "".join(map(chr, range(0x30A1, 0x30F7)))
JUDGED = "SELECT page_id, row_no, COALESCE(last_value(CASE WHEN bug_name <> '〃' THEN bug_name END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY row_no), '') AS judged FROM finished"

ROLLUP = "SELECT page_id, CASE WHEN w IS NOT NULL AND (x IS NULL OR w < x) THEN 'ok' WHEN x IS NOT NULL THEN 'out_of_time' ELSE 'failed' END AS status, count(*) FILTER (WHERE attempt <= last) AS attempts, COALESCE(round(sum(seconds) FILTER (WHERE attempt <= last), 6), 0e0) AS call_seconds FROM (SELECT *, least(COALESCE(w, 4), COALESCE(x - 1, 4)) AS last FROM (SELECT *, min(attempt) FILTER (WHERE ok) OVER (PARTITION BY page_id) AS w, min(attempt) FILTER (WHERE clock >= 240) OVER (PARTITION BY page_id) AS x FROM clocks WHERE attempt <= 4)) GROUP BY page_id, w, x"
#: A page without an end of its own is given up when the log is 240 seconds and the late hour past its last call.
ENDED = f"SELECT f.page_id, f.status AS outcome, f.attempts, f.call_seconds FROM ({ROLLUP}) f JOIN (SELECT page_id, max(started_at) AS last FROM attempt_log GROUP BY page_id) l ON l.page_id = f.page_id WHERE f.status <> 'failed' OR f.attempts = 4 OR l.last + INTERVAL 240 second < (SELECT max(started_at) - INTERVAL 1 hour FROM attempt_log) UNION ALL SELECT page_id, 'ok', 1, 0e0 FROM statuses WHERE page_id NOT IN (SELECT page_id FROM attempt_log)"

SELECTS = {
    "a1_intake": "SELECT doc_id, CAST(CASE WHEN strlen(text) > 4096 THEN 413 WHEN starts_with(text, 'The ') THEN 200 ELSE 415 END AS BIGINT) AS status FROM documents",
    "a2_requests": "SELECT request_id, q.engine, CASE WHEN status = 'ok' THEN COALESCE(q.model, standard) END AS model, status FROM (SELECT r.*, CASE r.engine WHEN 'alpha' THEN 'm1' WHEN 'beta' THEN 'm2' END AS standard, CASE WHEN r.engine NOT IN ('alpha', 'beta', 'gamma') THEN 'unknown engine' WHEN r.model IS NULL THEN 'ok' WHEN r.engine = 'gamma' THEN 'engine takes no model' WHEN (r.engine, r.model) NOT IN (('alpha', 'm1'), ('alpha', 'm2'), ('beta', 'm2')) THEN 'model not allowed' ELSE 'ok' END AS status FROM (SELECT event_id AS request_id, ['alpha', 'alpha', 'beta', 'gamma', 'delta'][1 + event_id % 5] AS engine, [NULL, 'm1', 'm2', 'zz'][1 + event_id % 4] AS model FROM events) r) q",
    "a3_sink": "SELECT r.page_id, k.cache_name, k.settings, r.percent FROM reports r JOIN keyed k ON k.page_id = r.page_id",
    "b1_unfence": f"SELECT doc_id, sha256({trim('text')}) AS said FROM documents",
    "b2_envelope": "SELECT page_id, status, finish_reason FROM statuses",
    "b3_rows": f"SELECT e.page_id, CAST(e.position AS BIGINT) AS position, e.no_raw, e.bug_name, e.where_ AS place, e.notice, CASE WHEN {WHOLE.replace('page_id', 'e.page_id')} THEN h.school ELSE '' END AS school, CASE WHEN {WHOLE.replace('page_id', 'e.page_id')} THEN h.grade ELSE '' END AS grade, CASE WHEN {WHOLE.replace('page_id', 'e.page_id')} THEN h.school_class ELSE '' END AS school_class FROM survey_entries e LEFT JOIN survey_header h ON h.page_id = e.page_id WHERE e.{ANSWERED}",
    "b4_row_number": "SELECT page_id, CAST(position AS BIGINT) AS position, no_raw, CAST(CASE WHEN n BETWEEN 1 AND 8 THEN n END AS BIGINT) AS row_no, CASE WHEN n IS NULL THEN 'dropped a row: ''' || no_raw || ''' is not a row number' WHEN n NOT BETWEEN 1 AND 8 THEN 'dropped row ' || n || ': the sheet has 8 rows' WHEN n <> position THEN 'row ' || n || ' came back in position ' || position ELSE '' END AS note FROM numbered",
    "b5_first_wins": "SELECT page_id, CAST(position AS BIGINT) AS position, CAST(n AS BIGINT) AS row_no, kept FROM placed",
    "b6_missing": "SELECT page_id, missing FROM missing",
    "b7_columns": "SELECT CAST(ord AS BIGINT) AS ord, field, text, count(*) AS n FROM kept_long GROUP BY ord, field, text",
    "b8_unsure": f"SELECT page_id, CAST(row_no AS BIGINT) AS row_no, u.note, u.name FROM placed2 p JOIN (VALUES (0, '', 'notice'), (1, '', 'symbol'), (1, 'names no column', 'colour'), (3, '', 'where'), (3, 'names no column', 'null'), (4, 'not a list', '\"notice\"')) u(m, note, name) ON u.m = (page_id + position) % 6 WHERE {ANSWERED}",
    "b9_detections": f"SELECT page_id, count(*) FILTER (WHERE ok) AS n_boxes, count(*) FILTER (WHERE NOT ok) AS n_notes, count(*) FILTER (WHERE ok AND unsure AND page_id % 5 <> 0) AS n_unsure, min(l) FILTER (WHERE ok) AS least_l, max(b) FILTER (WHERE ok) AS most_b FROM (SELECT *, page_id % 17 <> 0 AND seq % 23 <> 0 AS ok FROM survey_boxes WHERE {trim('text')} <> '') GROUP BY page_id",
    "b10_anchored": f"SELECT page_id, count(*) AS n, string_agg({trim('text')}, '|' ORDER BY seq) AS said FROM survey_boxes WHERE {trim('text')} <> '' GROUP BY page_id",
    "b11_header_boxes": f"SELECT h.page_id, h.field, {trim('h.raw')} AS text, b.l, b.r FROM header_long h JOIN header_bands b ON b.field = h.field WHERE {trim('h.raw')} <> ''",
    "b12_marks": f"SELECT page_id, kind, CAST(ROW_NUMBER() OVER (PARTITION BY page_id, kind ORDER BY position) AS BIGINT) AS position, CAST(n AS BIGINT) AS row_no, mark, note FROM marks_placed WHERE {WHOLE} UNION ALL SELECT p.page_id, m.kind, m.position, m.row_no, m.mark, m.note FROM (SELECT DISTINCT page_id FROM survey_entries WHERE page_id % 51 = 13) p CROSS JOIN (VALUES ('outside_minato', 0, NULL, NULL, 'not a list'), ('target_species', 1, NULL, NULL, 'not an object'), ('target_species', 2, NULL, '◎', 'number'), ('target_species', 3, NULL, '○', 'range'), ('target_species', 4, 3, '○', ''), ('target_species', 5, 3, '△', 'second')) m(kind, position, row_no, mark, note)",
    "b13_tokens": "SELECT page_id, CAST(attempt AS BIGINT) AS attempt, CAST(prompt_tokens AS BIGINT) AS prompt_tokens, CAST(thought_tokens AS BIGINT) AS thought_tokens, CAST(output_tokens AS BIGINT) AS output_tokens FROM tokens",
    "c1_cell_at": f"SELECT page_id, count(*) AS n, count(*) FILTER (WHERE row_no = 0) AS n_outside, CAST(sum((row_no * 100 + ord) * seq) AS BIGINT) AS placed, CAST(sum(CASE WHEN unsure THEN row_no * 100 + ord ELSE 0 END) AS BIGINT) AS unsure FROM ({placed_boxes('survey_cells')}) GROUP BY page_id",
    "c2_cell_at_v2": f"SELECT page_id, count(*) AS n, count(*) FILTER (WHERE row_no = 0) AS n_outside, CAST(sum((row_no * 100 + ord) * seq) AS BIGINT) AS placed, CAST(sum(CASE WHEN unsure THEN row_no * 100 + ord ELSE 0 END) AS BIGINT) AS unsure FROM ({placed_boxes('v2_cells')}) GROUP BY page_id",
    "c3_header_at": "SELECT COALESCE(b.field, '') AS field, count(*) AS n FROM (SELECT (o_orderkey % 1000) / 1000e0 * 0.3e0 AS x, 0.88e0 + (o_custkey % 130) / 1000e0 AS y FROM orders) p LEFT JOIN header_bands b ON p.x >= b.l AND p.x < b.r AND p.y >= b.t AND p.y < b.b GROUP BY b.field",
    "c4_dense": "SELECT CAST(c.row_no AS BIGINT) AS row_no, CAST(c.ord AS BIGINT) AS ord, c.field, count(*) AS n, sum(page_id)::BIGINT AS pages FROM (SELECT DISTINCT page_id FROM survey_entries) CROSS JOIN survey_cells c GROUP BY ALL",
    "c5_address": "SELECT CAST(a.row_no AS BIGINT) AS row_no, a.field, a.n, c.l, c.t, c.r, c.b FROM (SELECT l_linenumber + CAST(l_quantity AS BIGINT) % 3 AS row_no, ['" + "', '".join([*defs.FIELDS, "colour"]) + "'][1 + l_partkey % 12] AS field, count(*) AS n FROM lineitem GROUP BY ALL) a LEFT JOIN survey_cells c ON c.row_no = a.row_no AND c.field = a.field",
    "c6_cell_text": f"SELECT page_id, md5(string_agg(raw, '|' ORDER BY row_no, ord)) AS said FROM (SELECT p.page_id, c.row_no, c.ord, COALESCE(k.raw, '') AS raw FROM (SELECT DISTINCT page_id FROM survey_boxes) p CROSS JOIN survey_cells c LEFT JOIN (SELECT page_id, row_no, ord, replace(string_agg(text, '' ORDER BY seq), chr(10), '') AS raw FROM ({placed_boxes('survey_cells')}) WHERE row_no > 0 GROUP BY ALL) k ON k.page_id = p.page_id AND k.row_no = c.row_no AND k.ord = c.ord) GROUP BY page_id",
    "c7_unsure_cells": f"SELECT page_id, string_agg(CAST(cell AS VARCHAR), ' ' ORDER BY cell) AS cells FROM (SELECT DISTINCT page_id, row_no * 100 + ord AS cell FROM ({placed_boxes('survey_cells')}) WHERE row_no > 0 AND unsure) GROUP BY page_id",
    "c8_header_text": f"SELECT page_id, field, {trim('raw')} AS raw FROM header_long",
    "c9_outside": f"SELECT page_id, string_agg(CAST(seq AS VARCHAR), ' ' ORDER BY seq) AS boxes FROM ({placed_boxes('survey_cells')}) WHERE row_no = 0 GROUP BY page_id",
    "d1_unwrap": "SELECT raw, replace(raw, chr(10), '') AS value, count(*) AS n FROM survey_long GROUP BY raw",
    "d2_strip": f"SELECT raw, {trim('raw')} AS value, count(*) AS n FROM survey_long GROUP BY raw",
    "d3_fold": f"SELECT field, raw, {folded('field', 'raw')} AS value, n FROM (SELECT field, raw, count(*) AS n FROM survey_long GROUP BY field, raw)",
    "d4_characters": f"SELECT field, raw, {fits('field', trim('raw'))} AS fits, n FROM (SELECT field, raw, count(*) AS n FROM survey_long WHERE field IN ({listed(defs.NUMBER_FIELDS + defs.LETTER_FIELDS)}) GROUP BY field, raw)",
    "d5_scripts": f"SELECT doc_id, regexp_full_match(replace(text, chr(10), ''), '[{defs.script_class()}]*') AS fits FROM documents",
    "d6_list": f"SELECT field, raw, {on_list('field', 'raw')} AS listed, n FROM (SELECT field, raw, count(*) AS n FROM survey_long GROUP BY field, raw)",
    "d7_check": f"SELECT field, raw, CASE WHEN reason = '' THEN candidate ELSE '' END AS value, reason, n FROM (SELECT *, {reason('field', 'candidate')} AS reason FROM (SELECT field, raw, {folded('field', trim('raw'))} AS candidate, count(*) AS n FROM survey_long GROUP BY field, raw))",
    "d8_header": "SELECT page_id, field, value, reason FROM header_checked",
    "d9_place_marks": "SELECT page_id, CAST(row_no AS BIGINT) AS row_no, CASE WHEN reason = '' THEN said ELSE '' END AS kept, reason FROM marks_checked WHERE kind = 'outside_minato'",
    "d10_species_marks": "SELECT page_id, CAST(row_no AS BIGINT) AS row_no, CASE WHEN reason = '' THEN said ELSE '' END AS kept, reason FROM marks_checked WHERE kind = 'target_species'",
    "e1_gaps": "SELECT page_id, CAST(row_no AS BIGINT) AS row_no, string_agg(field, ', ' ORDER BY ord) AS gaps FROM gaps GROUP BY page_id, row_no",
    "e2_disagreements": "SELECT page_id, CAST(row_no AS BIGINT) AS row_no, pair, letter, wording, named FROM disagreements",
    "e3_finished_problems": "SELECT page_id, CAST(row_no AS BIGINT) AS row_no, field, problem FROM finished_problems",
    "e4_counts": "SELECT page_id, offered, rejected, CAST(disagreements AS BIGINT) AS disagreements, CAST(gaps AS BIGINT) AS gaps, unsure FROM counts",
    "e5_score": "SELECT page_id, score FROM scored",
    "e6_percent": "SELECT page_id, percent FROM reports",
    "e7_all_problems": "SELECT page_id, CAST(row_no AS BIGINT) AS row_no, field, problem FROM problems",
    "e8_findings": FINDINGS,
    "e9_wide": 'SELECT page_id, CAST(row_no AS VARCHAR) AS "no", bug_name, symbol, "where" AS place, what_doing, found_month, found_day, location_town, location_chome, location_name, map_symbol, notice FROM finished',
    "e10_document": DOCUMENTS,
    "e10_box_document": BOX_DOCUMENTS,
    "f1_totals": "SELECT model, count(*) AS calls, round(sum(seconds), 3) AS seconds, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(thought_tokens)::BIGINT AS thought_tokens FROM tokens GROUP BY model",
    "f2_spend": "SELECT page_id, CAST(attempt AS BIGINT) AS attempt, CAST(sum(output_tokens) OVER (PARTITION BY page_id ORDER BY attempt) AS BIGINT) AS total, CAST(output_tokens AS BIGINT) AS spent FROM tokens",
    "f3_rollup": ROLLUP,
    "f4_timing": "SELECT page_id, CAST(attempt AS BIGINT) AS attempt, attempt > 4 AS one_too_many, clock >= 240 AS after_budget FROM clocks WHERE attempt > 4 OR clock >= 240",
    "f5_in_flight": "SELECT date_trunc('day', make_timestamp(us)) AS bucket, CAST(max(load) AS BIGINT) AS most, CAST(sum(CASE WHEN step > 0 THEN greatest(0, least(change, load - 1)) ELSE 0 END) AS BIGINT) AS over_cap FROM (SELECT *, sum(change) OVER (ORDER BY us, step ROWS UNBOUNDED PRECEDING) AS load FROM (SELECT us, step, step * count(*) AS change FROM (SELECT epoch_us(started_at) AS us, 1 AS step FROM attempt_log UNION ALL SELECT epoch_us(started_at) + CAST(round(seconds * 1e6) AS BIGINT), -1 FROM attempt_log) GROUP BY us, step)) GROUP BY ALL",
    "g1_fingerprint": "SELECT field, left(sha256(string_agg(DISTINCT raw, chr(10) ORDER BY raw)), 8) AS digest, 'any order' AS kind FROM survey_long GROUP BY field UNION ALL SELECT field, left(sha256(string_agg(position || '=' || raw, chr(10) ORDER BY position, raw)), 8), 'in order' FROM (SELECT DISTINCT field, position, raw FROM survey_long) GROUP BY field",
    "g2_settings": "SELECT engine, model, sheet, n, 'engine=' || engine || ';model=' || model || ';checks=c1' || CASE WHEN engine = 'gamma' THEN '' ELSE ';grid=g1;prompt=p1' END || CASE WHEN sheet = 'v1' THEN '' ELSE ';sheet=v2;header=h1' END AS settings, engine || '_' || model || CASE WHEN sheet = 'v1' THEN '' ELSE '_v2' END AS cache_name FROM (SELECT model AS engine, 'm' || CAST(1 + page_id % 2 AS VARCHAR) AS model, s.sheet, count(*) AS n FROM attempt_log CROSS JOIN (VALUES ('v1'), ('v2')) AS s(sheet) GROUP BY ALL)",
    "g3_cached": "SELECT page_id, cache_name, settings, page_id % 3 <> 1 AND NOT (page_id % 5 = 0 AND contains(settings, 'prompt=p1')) AS cached FROM (SELECT page_id, 'engine=' || engine || ';model=' || model || ';checks=c1' || CASE WHEN engine = 'gamma' THEN '' ELSE ';grid=g1;prompt=p1' END || CASE WHEN page_id % 2 = 0 THEN '' ELSE ';sheet=v2;header=h1' END AS settings, engine || '_' || model || CASE WHEN page_id % 2 = 0 THEN '' ELSE '_v2' END AS cache_name FROM (SELECT o_orderkey AS page_id, ['alpha', 'beta', 'gamma'][1 + o_orderkey % 3] AS engine, CASE WHEN o_orderkey % 5 < 2 THEN 'm1' ELSE 'm2' END AS model FROM orders))",
    "g4_current": "SELECT page_id, model, CAST(attempt AS BIGINT) AS attempt, seconds FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY page_id, model ORDER BY started_at DESC, attempt DESC) AS n FROM attempt_log) WHERE n = 1",
    "g5_drift": "SELECT key, before, after, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT COALESCE(a.key, b.key) AS key, a.value AS before, b.value AS after FROM (SELECT doc_id AS key, left(sha256(text), 8) AS value FROM documents WHERE doc_id % 7 <> 1) a FULL JOIN (SELECT doc_id AS key, left(sha256(CASE WHEN doc_id % 5 = 0 THEN text || '.' ELSE text END), 8) AS value FROM documents WHERE doc_id % 11 <> 1) b ON a.key = b.key) WHERE before IS DISTINCT FROM after",
    "h1_compare": "SELECT page_id, CAST(ord AS BIGINT) AS ord, count(*) AS cells, count(*) FILTER (WHERE a = b) AS equal_cells, count(*) FILTER (WHERE a <> b) AS differing, count(*) FILTER (WHERE b IS NULL) AS only_left, count(*) FILTER (WHERE a IS NULL) AS only_right, count(*) FILTER (WHERE a = b) / CAST(count(*) AS DOUBLE) AS rate FROM (SELECT COALESCE(x.page_id, y.page_id) AS page_id, COALESCE(x.ord, y.ord) AS ord, x.text AS a, y.text AS b FROM kept_long x FULL JOIN entries_b y ON x.page_id = y.page_id AND x.row_no = y.row_no AND x.ord = y.ord) GROUP BY ALL",
    "h2_models": "SELECT model, runs, least_s, round(mean_s, 6) AS mean_s, most_s, output_tokens, thought_tokens, round(thought_tokens / CAST(output_tokens AS DOUBLE), 6) AS thinking_share, round(mean_s / min(mean_s) OVER (), 6) AS slowdown, round(mean_score, 6) AS mean_score FROM (SELECT model, count(*) AS runs, min(seconds) AS least_s, avg(seconds) AS mean_s, max(seconds) AS most_s, sum(output_tokens)::BIGINT AS output_tokens, sum(thought_tokens)::BIGINT AS thought_tokens, avg(score) AS mean_score FROM tokens t LEFT JOIN scored s ON s.page_id = t.page_id GROUP BY model)",
    "h3_tally": "SELECT bug_name AS name, count(*) AS n FROM finished WHERE bug_name <> '' GROUP BY bug_name ORDER BY n DESC, name LIMIT 28",
    "h4_open_first": "SELECT page_id, score, percent FROM reports ORDER BY score NULLS FIRST, page_id LIMIT 100",
    "i1_species": f"SELECT j.page_id, CAST(j.row_no AS BIGINT) AS row_no, j.bug_name, j.judged_name, CASE WHEN m.d <= 2 THEN CASE WHEN m.d = 0 AND NOT starts_with(j.judged_name, 'たぶん') THEN '◎' ELSE '○' END END AS mark, CASE WHEN m.d <= 2 THEN m.best END AS species, CAST(CASE WHEN m.d <= 2 THEN m.d END AS BIGINT) AS distance FROM judged j LEFT JOIN (SELECT f.judged_name, min(levenshtein(translate(f.said, '{ONE_BYTE[0]}', '{ONE_BYTE[1]}'), translate(s.name, '{ONE_BYTE[0]}', '{ONE_BYTE[1]}'))) AS d, arg_min(s.name, levenshtein(translate(f.said, '{ONE_BYTE[0]}', '{ONE_BYTE[1]}'), translate(s.name, '{ONE_BYTE[0]}', '{ONE_BYTE[1]}')) * 100 + s.k) AS best FROM (SELECT judged_name, translate(CASE WHEN starts_with(plain, 'たぶん') THEN substr(plain, 4) ELSE plain END, '{KANA[0]}', '{KANA[1]}') AS said FROM (SELECT DISTINCT judged_name, regexp_replace(judged_name, '[(（][^)）]*[)）]|の(オス|メス|幼虫)$', '', 'g') AS plain FROM judged)) f CROSS JOIN (VALUES {SPECIES}) AS s(k, name) WHERE f.said <> '' AND f.said NOT IN ({listed(defs.GROUPS)}) GROUP BY f.judged_name) m ON m.judged_name = j.judged_name",
    "i2_places": f"SELECT page_id, CAST(row_no AS BIGINT) AS row_no, judged_town, judged_place, explained, EXISTS (SELECT 1 FROM (VALUES {TOWNS}) AS t(town) WHERE contains(judged_town, town) OR contains(judged_place, town) OR contains(COALESCE(explained, ''), town)) AS listed FROM (SELECT j.*, e.note AS explained FROM judged j LEFT JOIN (SELECT page_id, regexp_extract(location_name, '^([^(（]+)[(（]([^)）]+)[)）]$', 1) AS name, arg_min(regexp_extract(location_name, '^([^(（]+)[(（]([^)）]+)[)）]$', 2), row_no) AS note FROM finished WHERE regexp_matches(location_name, '^([^(（]+)[(（]([^)）]+)[)）]$') GROUP BY ALL) e ON e.page_id = j.page_id AND e.name = j.judged_place)",
    "i3_ditto": f"SELECT page_id, CAST(row_no AS BIGINT) AS row_no, judged FROM ({JUDGED})",
    "i4_explained": "SELECT f.page_id, CAST(f.row_no AS BIGINT) AS row_no, f.location_name AS place, e.note AS explained FROM finished f LEFT JOIN (SELECT page_id, regexp_extract(location_name, '^([^(（]+)[(（]([^)）]+)[)）]$', 1) AS name, arg_min(regexp_extract(location_name, '^([^(（]+)[(（]([^)）]+)[)）]$', 2), row_no) AS note FROM finished WHERE regexp_matches(location_name, '^([^(（]+)[(（]([^)）]+)[)）]$') GROUP BY ALL) e ON e.page_id = f.page_id AND e.name = f.location_name WHERE f.location_name <> ''",
    "j1_stream": f"SELECT o.page_id, o.outcome, o.attempts, o.call_seconds, CASE WHEN o.outcome = 'ok' THEN COALESCE(s.status, 'no_completion') END AS status, CASE WHEN o.outcome = 'ok' THEN COALESCE(s.finish_reason, '') END AS finish_reason, r.offered, r.rejected, CAST(r.disagreements AS BIGINT) AS disagreements, CAST(r.gaps AS BIGINT) AS gaps, r.unsure, r.percent FROM ({ENDED}) o LEFT JOIN statuses s ON s.page_id = o.page_id LEFT JOIN reports r ON r.page_id = s.page_id AND s.status = 'ok' AND o.outcome = 'ok'",
    "j2_once": "SELECT event_id, count(*) AS n FROM events GROUP BY event_id",
    "j3_totals": "SELECT start, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(succeeded) AS BIGINT) AS succeeded, round(sum(seconds), 3) AS seconds, count(score) FILTER (WHERE true) + count(*) FILTER (WHERE came AND score IS NULL) AS pages, CAST(sum(offered) AS BIGINT) AS offered, CAST(sum(rejected) AS BIGINT) AS rejected, CAST(sum(disagreements) AS BIGINT) AS disagreements, CAST(sum(gaps) AS BIGINT) AS gaps, CAST(sum(unsure) AS BIGINT) AS unsure, round(avg(score), 9) AS mean_score FROM (SELECT time_bucket(INTERVAL 1 hour, started_at) AS start, count(*) AS calls, count(*) FILTER (WHERE ok) AS succeeded, sum(seconds) AS seconds, false AS came, 0 AS offered, 0 AS rejected, 0 AS disagreements, 0 AS gaps, 0 AS unsure, NULL AS score FROM attempt_log GROUP BY ALL UNION ALL SELECT time_bucket(INTERVAL 1 hour, a.at), 0, 0, 0e0, true, s.offered, s.rejected, s.disagreements, s.gaps, s.unsure, s.score FROM scored s JOIN (SELECT page_id, min(started_at) AS at FROM attempt_log GROUP BY page_id) a ON a.page_id = s.page_id) WHERE start + INTERVAL 1 hour <= (SELECT max(started_at) - INTERVAL 1 hour FROM attempt_log) GROUP BY start",
}

LAYERS += box_layers()
SQL = {name: query(select) for name, select in SELECTS.items()}
