"""Which values of a field carry no information: missing, damaged or cut off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is written where a value is missing (lower case, outer blanks ignored).
STAND_INS = (
    "n/a", "na", "n.a.", "n.a", "none", "null", "nil", "nan", "unknown", "unk", "tbd", "tba", "missing", "pending",
    "not available", "not provided", "not assigned", "not known", "not given", "not applicable", "not specified",
    "description pending", "name pending", "no description available", "no description", "to be annotated", "see source record", "uncharacterized", "uncharacterised", "undefined", "unspecified", "unnamed",
    "#n/a", "#ref!", "#name?", "#value!", "#div/0!", "#null!", "#num!",
)
# Fixed patterns: dates, powers of ten and serial numbers that a spreadsheet makes of names.
_MONTH = "(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*"
SPREADSHEET = (
    rf"(?i)^(\d{{1,4}}[-/ ]{_MONTH}([-/ ]\d{{2,4}})?|{_MONTH}[-/ ]\d{{1,4}}|\d{{1,4}}[-/.]\d{{1,2}}[-/.]\d{{1,4}}"
    r"|\d+(\.\d+)?e[+-]?\d+|\d+(\.\d+)?)$"
)
# Fixed patterns: marks of a text that was cut off.
CUT_OFF = r"(?i)(…|\.\.+|[\[(<{](\.\.\.?|…|truncated|cut( off)?|cont(inued|\.)?|more)[\])>}]?\.?)\s*$"


def is_missing(c: Column) -> Column:
    """Null, blank, punctuation only, or a stand-in for a missing value."""
    flat = F.lower(F.trim(c))
    return c.isNull() | flat.rlike(r"^[^\p{L}\p{N}]*$") | flat.isin(*STAND_INS)


def is_spreadsheet_damage(c: Column) -> Column:
    """A date, power of ten or number that stands where a name should be."""
    return F.coalesce(F.trim(c).rlike(SPREADSHEET), F.lit(False))


def is_cut_off(c: Column) -> Column:
    """A text that ends in a mark of truncation."""
    return F.coalesce(c.rlike(CUT_OFF), F.lit(False))


def usable(c: Column) -> Column:
    return ~(is_missing(c) | is_spreadsheet_damage(c) | is_cut_off(c))


def bare_number(c: Column) -> Column:
    """The number (long) of an identifier written as a number with an optional prefix, leading zeros or `.0`.

    Null where the text isn't such a number, or is zero.
    """
    digits = F.regexp_extract(c, r"(?i)^\s*(?:[a-z]+\s*[:#]?\s*)?0*([1-9][0-9]{0,17})(?:\.0+)?\s*$", 1)
    return F.when(digits != "", digits.cast("long"))
