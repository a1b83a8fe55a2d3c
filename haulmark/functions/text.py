"""Text and parsing functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(text: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def alnum(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def address_key(street: Column, city: Column, state: Column, zipcode: Column) -> Column:
    """street|city|state|zip5, normalised; null without a street."""
    return F.when(normalize(street) != "", F.concat_ws("|", normalize(street), normalize(city), F.lower(F.trim(state)), F.substring(zipcode, 1, 5)))


#: Fixed value: kilometres in a mile.
MILE_KM = 1.609344
SPEED = r"(?i)^[0-9]+(\.[0-9]+)?\s*(mph|km/h|kph)?$"


def speed_tag(tag: Column) -> Column:
    """struct<kph, status> of a tag like '30 mph', '30 mph; 50' or "['30 mph', '50']".

    The least speed counts, and only if every part is a speed over zero: the first part that isn't
    one says what is wrong with the tag.
    """
    flat = F.when(tag.startswith("["), F.replace(F.regexp_replace(tag, r"[\[\]'\"]", ""), F.lit(","), F.lit(";"))).otherwise(tag)
    parts = F.filter(F.transform(F.split(flat, ";"), lambda p: F.trim(p)), lambda p: p != "")

    def read(part: Column) -> Column:
        value = F.regexp_extract(part, r"^([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double") * F.when(F.lower(part).endswith("mph"), MILE_KM).otherwise(1.0)
        wrong = F.when(~part.rlike(SPEED), "non_numeric_or_conditional").when(value <= 0, "invalid_numeric")
        return F.struct(value.alias("kph"), wrong.alias("wrong"))

    each = F.transform(parts, read)
    wrong = F.get(F.filter(F.transform(each, lambda x: x["wrong"]), lambda x: x.isNotNull()), F.lit(0))
    status = F.when(tag.isNull() | (F.size(parts) == 0), "missing").otherwise(F.coalesce(wrong, F.when(F.size(parts) == 1, "parsed_single").otherwise("parsed_multivalue_conservative_min")))
    return F.struct(F.when(wrong.isNull(), F.array_min(F.transform(each, lambda x: x["kph"]))).alias("kph"), status.alias("status"))


def multivalue(tag: Column) -> Column:
    """Values of "['a', 'b']", 'a;b' or 'a' as an array."""
    bare = F.regexp_replace(tag, r"[\[\]'\" ]", "")
    return F.filter(F.split(bare, "[,;]"), lambda x: x != "")


def canonical(values: Column) -> Column:
    """Distinct values, sorted and joined with '|'."""
    return F.array_join(F.array_sort(F.array_distinct(values)), "|")


def number_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)))


def route_relation(a: Column, b: Column) -> Column:
    """'unknown' if either has no tokens, 'exact' if they share one, else 'conflict'."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), "unknown").when(F.arrays_overlap(a, b), "exact").otherwise("conflict")


def connector_tokens(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(F.upper(text), "[, ]+"), lambda x: x != "")))


def tri_bool(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("1", "true", "yes", "y"), True).when(low.isin("0", "false", "no", "n"), False)


def try_number(text: Column) -> Column:
    """A finite double, or null."""
    found = text.try_cast("double")
    return F.when(~F.isnan(found) & (F.abs(found) < F.lit(float("inf"))), found)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def checkpoint_label(seconds: Column) -> Column:
    """60.0 as '60s', 0.5 as '0p5s'."""
    whole = F.floor(seconds) == seconds
    return F.concat(F.when(whole, F.floor(seconds).cast("string")).otherwise(F.replace(seconds.cast("string"), F.lit("."), F.lit("p"))), F.lit("s"))


def unsafe_path(path: Column) -> Column:
    """Absolute, empty, with '.', '..' or empty parts, or with a backslash."""
    bad = F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))
    return path.isNull() | bad | path.contains("\\")
