"""Column functions shared by the plans: blanks, rates, versions, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks as Python's str.isspace sees them; Java's \s knows ASCII only.
BLANK = r"[\s\x1C-\x1F\x85\xA0  -     　]"


#: The same characters one by one.
BLANKS = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column | str) -> Column:
    """text without blanks at both ends; looks at the ends alone, where a pattern would try every blank inside."""
    return F.btrim(text, F.lit(BLANKS))


def squeeze(text: Column) -> Column:
    """text without blanks."""
    return F.regexp_replace(text, f"{BLANK}+", "")


def per_thousand(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 1000.0, whole), F.lit(0.0))


def semver(text: Column) -> Column:
    """struct(major, minor, patch) of x.y.z, else null.  Structs compare as tuples."""
    got = lambda i: F.try_to_number(F.regexp_extract(text, r"^([0-9]+)\.([0-9]+)\.([0-9]+)\z", i), F.lit("999999999")).cast("int")
    return F.when(text.rlike(r"^[0-9]{1,9}\.[0-9]{1,9}\.[0-9]{1,9}\z"), F.struct(got(1).alias("major"), got(2).alias("minor"), got(3).alias("patch")))


def penalty_score(findings: Column, line_weight: Column, document_weight: Column, prose: Column, half: int = 40, floor: int = 1000) -> Column:
    """100 without findings, else 1..99 from the density of line findings and the document findings, in integers.

    With w findings of lines per ``floor`` characters and d of the document the score is 100 * half / (half + d + w),
    rounded half up.
    """
    m = F.greatest(prose.cast("long"), F.lit(floor).cast("long"))
    top = 100 * half * m
    low = (half + document_weight) * m + 1000 * line_weight
    number = 2 * top + low
    rounded = ((number - F.pmod(number, 2 * low)) / (2 * low)).cast("long")  # exact: the division leaves nothing over
    return F.when(findings == 0, F.lit(100)).otherwise(F.least(F.lit(99), F.greatest(F.lit(1), rounded))).cast("long")


def around(text: Column, start: Column, end: Column, reach: int = 18) -> Column:
    """The characters from ``reach`` before start to ``reach`` after end (0-based, end excluded)."""
    low = F.greatest(start - reach, F.lit(0))
    return F.substr(text, low + 1, end + reach - low)
