"""Value checks as column expressions: a value is kept whole or emptied whole, never repaired."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldleaf.plans import defs

SCRIPT = rf"\A[{defs.script_class()}]*\z"
DIGITS = r"\A[0-9]*\z"
LETTERS = r"\A[A-Za-z]*\z"
HEADER_DIGITS = rf"\A[{defs.digit_class()}]+\z"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each computed once a row: as they come out of a generator, a later filter on them isn't pushed down as a copy of their expressions."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def short_methods(spark: SparkSession) -> None:
    """Stages of which Spark's code would be one long method run operator by operator, in short ones: the JVM compiles no method over 8,000 bytes (Spark's own advice on HotSpot)."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", 8000)


def class_of(codes: set[int]) -> str:
    """The inside of a regular expression's class, as few ranges: a class is searched range by range."""
    out = []
    for a in sorted(c for c in codes if c - 1 not in codes):
        b = a
        while b + 1 in codes:
            b += 1
        out.append(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}")
    return "".join(out)


ODD = set(map(ord, [*defs.SPACES, *defs.FOLDS, *defs.RINGED_DIGITS]))
#: Writing that is allowed and that neither ``strip`` nor ``fold`` changes.
PLAIN = rf"\A[{class_of({c for a, b in defs.SCRIPTS for c in range(a, b + 1)} - ODD)}]*\z"


def is_plain(field: str, text: Column) -> Column:
    """Whether a text of the column stands as it is, but for its list: most do, and one look tells it."""
    return text.rlike(DIGITS if field in defs.NUMBER_FIELDS else LETTERS if field in defs.LETTER_FIELDS else PLAIN)


def cases(text: str) -> list[str]:
    """Every text that is ``text`` in upper case, so that a comparison needs none made."""
    return ["".join(p) for p in product(*[CASES.get(c, [c]) for c in text.upper()])]


KNOWN = {c for xs in [*defs.CHOICES.values(), *defs.PAIR_WORDS.values()] for x in xs for c in x.upper()}
CASES: dict[str, list[str]] = {}
for char in map(chr, range(0x110000)):
    if char.upper() in KNOWN:
        CASES.setdefault(char.upper(), []).append(char)


def capital(answer: Column) -> Column:
    """``upper`` of a listed answer, without what any text would need."""
    return F.translate(answer, *map("".join, zip(*[(c, x) for x, cs in CASES.items() for c in cs if c != x], strict=True)))


def unwrap(text: Column) -> Column:
    """Line breaks taken out of what one cell's boxes hold."""
    return F.translate(text, defs.LINE_BREAKS, "")


def strip(text: Column) -> Column:
    """White space of any script off both ends."""
    return F.btrim(text, F.lit(defs.SPACES))


def stripped(text: Column) -> Column:
    """``strip`` of a column: one look at both ends tells whether there is anything to take off, as trimming compares each end with every kind of white space."""
    at_end = lambda k: F.substring(text, k, 1).isin(list(defs.SPACES))
    return F.when(at_end(1) | at_end(-1), strip(text)).otherwise(text)


def fold(field: Column, text: Column) -> Column:
    """Width variants and rings folded; ringed digits stay in the number columns, where they are no number."""
    plain = F.translate(text, "".join(defs.FOLDS), "".join(defs.FOLDS.values()))
    single = defs.FOLDS | {k: v for k, v in defs.RINGED_DIGITS.items() if len(v) == 1}
    ringed = F.translate(text, "".join(single), "".join(single.values()))
    double = {k: v for k, v in defs.RINGED_DIGITS.items() if len(v) > 1}
    replaced = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), double.items(), ringed)
    ringed = F.when(text.rlike(f"[{''.join(double)}]"), replaced).otherwise(ringed)  # few values need the fourteen replacements
    return F.when(field.isin(defs.NUMBER_FIELDS), plain).otherwise(ringed)


def fits_characters(field: Column, text: Column) -> Column:
    return F.when(field.isin(defs.NUMBER_FIELDS), text.rlike(DIGITS)).when(field.isin(defs.LETTER_FIELDS), text.rlike(LETTERS)).otherwise(text.rlike(SCRIPT))


def on_list(field: Column, text: Column) -> Column:
    """True for columns without a list, and for a printed answer or another spelling of it in either case."""
    out = F.lit(True)
    for name, answers in defs.CHOICES.items():
        out = F.when(field == name, text.isin([c for x in answers + defs.SPELLINGS.get(name, []) for c in cases(x)])).otherwise(out)
    return out


def candidate(field: Column, raw: Column) -> Column:
    return fold(field, strip(raw))


def reason(field: Column, value: Column) -> Column:
    """Why a folded value can't stand: '', 'characters' or 'list'."""
    return F.when(~fits_characters(field, value), "characters").when((value != "") & ~on_list(field, value), "list").otherwise("")


def header_value(field: Column, raw: Column) -> tuple[Column, Column]:
    """(value, reason) of a strip value: the two numbers must be digits all through, the school is checked as writing."""
    number, writing = strip(fold(field, raw)), candidate(field, raw)
    is_number = field.isin(defs.HEADER_NUMBER_FIELDS)
    why = F.when(is_number, F.when((number == "") | number.rlike(HEADER_DIGITS), "").otherwise("number")).otherwise(reason(field, writing))
    return F.when(why == "", F.when(is_number, number).otherwise(writing)).otherwise(""), why


def disagreement(letter_field: str, letter: Column, wording: Column) -> Column:
    """The other letters, sorted and joined by '/', that a wording reads like while none of its own letter's words is in it; '' if there is no complaint."""
    words = defs.PAIR_WORDS[letter_field]
    holds = lambda x: reduce(lambda a, b: a | b, [F.contains(wording, F.lit(w)) for w in words[x]])
    listed = [x for x in sorted(words) if words[x]]
    own = reduce(lambda out, x: F.when(letter.isin(cases(x)), holds(x)).otherwise(out), listed, F.lit(None).cast("boolean"))
    named = F.concat_ws("/", *[F.when(holds(x), x) for x in listed])
    return F.when((wording != "") & ~own, named).otherwise("")
