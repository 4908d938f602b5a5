"""Numbers and dates read from answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names by number.
MONTHS = {
    "january": 1, "januar": 1, "jänner": 1, "jan": 1, "february": 2, "februar": 2, "feb": 2, "march": 3, "märz": 3, "maerz": 3, "mar": 3, "mär": 3,
    "april": 4, "apr": 4, "may": 5, "mai": 5, "june": 6, "juni": 6, "jun": 6, "july": 7, "juli": 7, "jul": 7, "august": 8, "aug": 8,
    "september": 9, "sept": 9, "sep": 9, "october": 10, "oktober": 10, "oct": 10, "okt": 10, "november": 11, "nov": 11, "december": 12, "dezember": 12, "dec": 12, "dez": 12,
}
_NAMES = "|".join(sorted(MONTHS, key=len, reverse=True))
_LONG = "January|February|March|April|May|June|July|August|September|October|November|December"
#: Date forms in one alternation, so that matches come in the order of the text.
DATE = (
    r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}\.\d{1,2}\.\d{4}\b|\b\d{1,2}/\d{1,2}/\d{4}\b"
    rf"|\b(?:{_LONG}) \d{{1,2}}, \d{{4}}\b|\b\d{{1,2}}-[A-Z][a-z]{{2}}-\d{{4}}\b|\b\d{{1,2}}\.? (?i:{_NAMES})\.? \d{{4}}\b"
)
_READING = "array<struct<value: double, decimals: int>>"


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def _month(name: Column) -> Column:
    months = F.create_map(*(x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(str(v)))))
    return F.try_element_at(months, F.lower(name))


def parse_date(m: Column) -> Column:
    """One matched date form as a date; null where there is no such day."""
    get = lambda p, i: F.regexp_extract(m, p, i)
    dotted, named, english, dashed = r"^(\d{1,2})[./](\d{1,2})[./](\d{4})$", r"^(\d{1,2})\.? (\p{L}+)\.? (\d{4})$", r"^(\p{L}+) (\d{1,2}), (\d{4})$", r"^(\d{1,2})-(\p{L}+)-(\d{4})$"
    return (
        F.when(m.rlike(r"^\d{4}-"), F.try_to_date(m, "yyyy-MM-dd"))
        .when(m.rlike(dotted), _day(get(dotted, 3), get(dotted, 2), get(dotted, 1)))
        .when(m.rlike(english), _day(get(english, 3), _month(get(english, 1)), get(english, 2)))
        .when(m.rlike(dashed), _day(get(dashed, 3), _month(get(dashed, 2)), get(dashed, 1)))
        .otherwise(_day(get(named, 3), _month(get(named, 2)), get(named, 1)))
    )


def dates(s: Column) -> Column:
    """All dates of a text in its order, numeric, English and German forms."""
    return F.filter(F.transform(F.regexp_extract_all(s, F.lit(DATE), F.lit(0)), parse_date), lambda d: d.isNotNull())


def readings(s: Column) -> Column:
    """Every value that the first number of a text can mean, with its stated decimals; empty if there is no number.

    Of two different separators the last is decimal; one that repeats parts thousands; a lone one
    before three digits is both, unless in a percentage; a percentage is also its hundredth.
    """
    bare = F.regexp_replace(F.regexp_replace(s, r"(?i)\b(?:CHF|EUR|USD|GBP|JPY)\b|[$€£]", ""), "['’   ]", "")
    return _bound(F.regexp_extract(bare, r"[-+]?\d[\d.,]*\s*%?", 0), _meanings)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _meanings(token: Column) -> Column:
    raw = F.regexp_replace(F.trim(F.replace(token, F.lit("%"), F.lit(""))), r"[.,]+$", "")
    return F.when(token == "", F.array().cast(_READING)).otherwise(_bound(raw, lambda r: _values(r, token.endswith("%"))))


def _values(raw: Column, percent: Column) -> Column:
    one = lambda text, decimals: F.struct(text.try_cast("double").alias("value"), decimals.cast("int").alias("decimals"))
    plain = F.regexp_replace(raw, "[.,]", "")
    after = F.regexp_extract(raw, r"[.,](\d*)$", 1)
    both = raw.rlike(r"\.") & raw.rlike(",")
    many = raw.rlike(r"\..*\.") | raw.rlike(",.*,")
    decimal = F.concat(F.regexp_replace(F.regexp_replace(raw, r"[.,]\d*$", ""), "[.,]", ""), F.lit("."), after)
    found = (
        F.when(~raw.rlike("[.,]"), F.array(one(raw, F.lit(0))))
        .when(both, F.array(one(decimal, F.length(after))))
        .when(many, F.array(one(plain, F.lit(0))))
        .when((F.length(after) == 3) & ~percent, F.array(one(decimal, F.lit(3)), one(plain, F.lit(0))))
        .otherwise(F.array(one(decimal, F.length(after))))
    )
    hundredths = lambda f: F.transform(f, lambda x: F.struct((x["value"] / 100).alias("value"), (x["decimals"] + 2).alias("decimals")))
    return F.filter(_bound(found, lambda f: F.when(percent, F.concat(f, hundredths(f))).otherwise(f)), lambda x: x["value"].isNotNull())


def numbers_match(answer: Column, gold: Column, tolerance: float = 0.005) -> Column:
    """Whether any reading of the answer is any of the gold's, within the tolerance or half its last digit."""

    def one(x: Column, g: Column) -> Column:
        y, apart = g["value"], F.abs(x["value"] - g["value"])
        return ((y == 0) & (F.abs(x["value"]) < 1e-9)) | ((y != 0) & (apart <= tolerance * F.abs(y))) | (apart <= 0.5 * F.pow(F.lit(10.0), -g["decimals"]) * (1 + 1e-9))

    return _bound(readings(gold), lambda meant: F.exists(readings(answer), lambda x: F.exists(meant, lambda g: one(x, g))))


def score(answer: Column, kind: Column, value: Column, values: Column) -> Column:
    """(correct, method, failure) of an answer against a gold of a kind; correct is null where a judge is needed."""
    from .text import extract_final, is_refusal, norm_text

    final = extract_final(answer)
    a, g = norm_text(final), norm_text(value)
    rest = F.substr(a, F.length(g) + 1)
    qualified = a.startswith(g) & rest.rlike(r"^(?:\s*[,(;]|\s+[–-]\s)")
    want = F.array_distinct(F.flatten(F.transform(F.coalesce(values, F.array().cast("array<string>")), dates)))
    got = F.array_distinct(dates(final))
    same_set = (F.size(F.array_except(want, got)) == 0) & (F.size(F.array_except(got, want)) == 0) & (F.size(want) > 0)
    first = F.get(dates(final), F.lit(0)) == F.get(dates(value), F.lit(0))
    refused = is_refusal(final)
    correct = (
        F.when(kind == "unanswerable", refused)
        .when(refused, F.lit(False))
        .when(kind == "free", F.lit(None).cast("boolean"))
        .when(kind == "exact", (a == g) | qualified)
        .when(kind == "numeric", numbers_match(final, value))
        .when(kind == "date", F.coalesce(first, F.lit(False)))
        .when(kind == "date_list", same_set)
        .otherwise(F.raise_error(F.concat(F.lit("unknown gold kind "), kind)).cast("boolean"))
    )
    method = F.when(kind == "unanswerable", F.lit("refusal")).when(refused, kind).when(kind == "free", F.lit("llm")).otherwise(kind)
    failure = F.when((kind == "unanswerable") & ~refused, F.lit("answered_unanswerable"))
    return F.struct(correct.alias("correct"), method.alias("method"), failure.alias("failure"))
