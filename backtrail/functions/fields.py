"""Column expressions that decode the raw text and code fields of an event."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
# Texts that stand for "no language given".
EMPTY_LANGUAGES = ("", "not available", "null")
# Texts that stand for a missing category.
EMPTY_CATEGORIES = ("nan", "None", "")


def event_time(text) -> Column:
    """Timestamp of the event; null when the text is not a time."""
    return F.try_to_timestamp(_c(text), F.lit(TIME_FORMAT))


def int_or(field, default: int = -1, kind: str = "int") -> Column:
    """Whole number, `default` when null or not a number."""
    # a failed cast is a raised and caught error, many times as slow; no number has letters or is without digits
    hopeless = (F.typeof(_c(field)) == "string") & ~_c(field).cast("string").rlike("^[^A-Za-z]*[0-9][^A-Za-z]*$")
    return F.coalesce(F.when(hopeless, None).otherwise(_c(field).try_cast(kind)), F.lit(default).cast(kind))


def shifted_code(field) -> Column:
    """0 for null, otherwise the code plus one, so that 0 can mean padding."""
    return F.coalesce(_c(field).try_cast("int") + 1, F.lit(0))


def missing(field) -> Column:
    return _c(field).isNull().cast("int")


def is_unset(field) -> Column:
    """1 where a decoded field carries the -1 that stands for null."""
    return (_c(field) == -1).cast("int")


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def extract_int(field, pattern: str, default: int | None = -1) -> Column:
    """First group of the pattern as a number."""
    found = F.nullif(F.regexp_extract(_c(field), pattern, 1), F.lit("")).try_cast("int")
    return found if default is None else F.coalesce(found, F.lit(default))


def piece(field, separator: str, index: int) -> Column:
    """The index-th piece (from 0) of a text split on a pattern; null when there are fewer."""
    return F.get(F.split(_c(field), separator), F.lit(index))


# -- battery ---------------------------------------------------------------------------------


def battery_percent(field) -> Column:
    return extract_int(field, r"(\d{1,3})")


def battery_number(field) -> Column:
    """The text without its percent sign as a number, null when that fails."""
    return F.trim(F.regexp_replace(_c(field), "%", "")).try_cast("double")


def battery_code(field) -> Column:
    """NaN for null, -2 for an unmeasured and -1 for an unavailable battery, else the percentage."""
    text = _c(field)
    digits = F.regexp_replace(F.regexp_replace(text, "^:", ""), "%.*$", "")
    return (
        F.when(text.isNull(), F.lit(float("nan")))
        .when(text == "NaN%", F.lit(-2.0))
        .when(text == "not available", F.lit(-1.0))
        .otherwise(digits.try_cast("double"))
    )


def battery_available(code: Column) -> Column:
    return code.isNotNull() & ~F.isnan(code) & (code >= 0)


def battery_share(code: Column) -> Column:
    """Charge between 0 and 1, 0 when unknown."""
    return F.when(battery_available(code), F.least(code, F.lit(100.0)) / 100.0).otherwise(0.0)


def battery_reason(code: Column) -> Column:
    """Magnitude of the negative codes, 0 otherwise."""
    return F.when(code.isNotNull() & ~F.isnan(code) & (code < 0), -code).otherwise(0.0)


# -- system version and screen -------------------------------------------------------------------


def version_major(field) -> Column:
    return extract_int(field, r"^(\d+)")


def version_first_piece(field) -> Column:
    return piece(field, r"\.", 0).try_cast("long")


def version_number(field) -> Column:
    """Major, minor and patch in one number with two digits each for minor and patch; 0 for null."""
    parts = [F.coalesce(piece(field, r"\.", i).try_cast("int"), F.lit(0)) for i in range(3)]
    return F.when(_c(field).isNull(), 0).otherwise(parts[0] * 10000 + parts[1] * 100 + parts[2])


def version_parts(field) -> Column:
    return F.when(_c(field).isNull(), 0).otherwise(F.size(F.split(_c(field), r"\.")))


def screen_width(field) -> Column:
    return extract_int(field, r"^(\d+)")


def screen_height(field) -> Column:
    return extract_int(field, r"x(\d+)$")


def screen_pixels(width, height, unknown: int | None = None) -> Column:
    """Product of the sides; with `unknown`, that value unless both sides are known."""
    area = _c(width) * _c(height)
    return area if unknown is None else F.when((_c(width) > 0) & (_c(height) > 0), area).otherwise(unknown)


def screen_ratio(width, height, epsilon: float = 0.0) -> Column:
    known = (_c(width) > 0) & (_c(height) > 0)
    return F.when(known, _c(width).cast("double") / (_c(height).cast("double") + epsilon)).otherwise(0.0)


# -- languages -----------------------------------------------------------------------------------


def language_or_null(field) -> Column:
    return F.when(F.lower(_c(field)).isin(*EMPTY_LANGUAGES), F.lit(None)).otherwise(_c(field))


def language_letters(field) -> Column:
    """First two letters before any list or weight sign, in lower case."""
    return F.substring(F.regexp_replace(F.lower(_c(field)), r"[;,\s].*", ""), 1, 2)


def language_tag(field) -> Column:
    """`xx` or `xx-XX` at the start of the header, `unknown` otherwise."""
    found = F.regexp_extract(_c(field), r"^([a-zA-Z]{2}(?:-[a-zA-Z]{2})?)", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("unknown"))


def language_base(field) -> Column:
    """The part before the first comma, semicolon and dash, in lower case; empty when null."""
    text = F.coalesce(F.lower(_c(field)), F.lit(""))
    for sign in (",", ";", "-"):
        text = F.split_part(text, F.lit(sign), F.lit(1))
    return text


def hashed_text(text: Column) -> Column:
    """64-bit code of a text, 0 for the empty one."""
    return F.when(text == "", F.lit(0).cast("long")).otherwise(F.xxhash64(text))


def language_count(field) -> Column:
    return F.when(_c(field).isNotNull(), F.regexp_count(_c(field), F.lit(","))+ 1).otherwise(0)


def suspicious_language(field, exact: bool = False) -> Column:
    text = F.coalesce(F.lower(_c(field)), F.lit(""))
    hit = text.isin("en-us", "*") if exact else text.rlike(r"en-us|\*")
    return hit.cast("int")


def language_mismatch(accept, browser) -> Column:
    """1 when both are given and differ, 0 when they agree, -1 when one is missing."""
    both = _c(accept).isNotNull() & _c(browser).isNotNull()
    return F.when(both, (_c(accept) != _c(browser)).cast("int")).otherwise(-1)


def browser_language_state(field) -> Column:
    return F.when(_c(field).isNull(), 0).when(_c(field) == "not available", 1).otherwise(2)


# -- devices ---------------------------------------------------------------------------------------


def device_number(width, height, system, language) -> Column:
    """Device fingerprint as one number; the language takes three digits, counted upwards from -1 = 999."""
    return (
        _c(width).cast("long") * 100_000_000
        + _c(height).cast("long") * 100_000
        + _c(system).cast("long") * 1_000
        + F.pmod(_c(language).cast("long"), F.lit(1000))
    )


def device_text(*raw) -> Column:
    """The raw device fields joined by bars, a question mark for each missing one."""
    return F.concat_ws("|", *[F.coalesce(_c(f).cast("string"), F.lit("?")) for f in raw])


def device_hash(*raw) -> Column:
    return F.xxhash64(device_text(*raw))


# -- categories and flags ----------------------------------------------------------------------------


def crossed(a, b) -> Column:
    return F.concat_ws("_x_", _c(a).cast("string"), _c(b).cast("string"))


def category_or_missing(field) -> Column:
    text = _c(field).cast("string")
    return F.when(text.isNull() | text.isin(*EMPTY_CATEGORIES), "MISSING").otherwise(text)


def known(*fields) -> Column:
    """1 when any of the shifted codes is set."""
    return reduce(lambda a, b: a | b, [F.coalesce(_c(f), F.lit(0)) > 0 for f in fields]).cast("int")


def any_equal(value, *fields) -> Column:
    return reduce(lambda a, b: a | b, [_c(f) == value for f in fields]).cast("int")


def all_equal(value, *fields) -> Column:
    return reduce(lambda a, b: a & b, [_c(f) == value for f in fields]).cast("int")


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value
