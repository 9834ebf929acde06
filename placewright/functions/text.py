"""Text, time and small coercions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placewright.wording import APPROVE_ANSWERS, TRUE_WORDS

#: Every character Unicode calls white space, plus the ASCII separators.
#: Java's plain ``\s`` would leave no-break and wide spaces in place.
BLANK = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

#: A run of white space other than one plain space. Leaving single spaces alone
#: keeps the number of replacements small.
BLANK_RUN = f" {BLANK}+|(?! ){BLANK}+"

TIME_ZONE = "Asia/Kolkata"


def blank_trim(text: Column) -> Column:
    """Trim all white space (``trim`` alone only takes spaces)."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def clean_text(text: Column) -> Column:
    """One space for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANK_RUN, " "))


EPOCH = "1970-01-01 00:00:00"


def local_time(epoch_ms: Column) -> Column:
    """Wall-clock time in the posting time zone, as TIMESTAMP_NTZ: the result
    does not depend on the time zone of the session."""
    seconds = (epoch_ms / 1000).cast("decimal(18, 6)")
    zero = F.lit(0)
    utc = F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds)
    return F.convert_timezone(F.lit("UTC"), F.lit(TIME_ZONE), utc)


def urn_id(urn: Column) -> Column:
    """``urn:x:y:(ID,REST)`` -> ``ID``; NULL when there is no bracket."""
    inside = F.try_element_at(F.split(urn, r"\("), F.lit(2))
    return F.try_element_at(F.split(inside, ","), F.lit(1))


def strip_fences(reply: Column) -> Column:
    """Model reply without Markdown code fences."""
    bare = F.replace(F.replace(reply, F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    return blank_trim(bare)


def as_bool(value: Column) -> Column:
    """Loose yes/no text to a boolean; NULL counts as no."""
    return F.coalesce(F.lower(blank_trim(value.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def is_approval(answer: Column) -> Column:
    return F.coalesce(F.lower(blank_trim(answer)).isin(*APPROVE_ANSWERS), F.lit(False))


def csv_list(answer: Column) -> Column:
    """Comma-separated answer to a list without blanks."""
    parts = F.split(F.coalesce(answer, F.lit("")), ",")
    return F.filter(F.transform(parts, blank_trim), lambda part: part != "")


def first_non_empty(items: Column, n: int = 3) -> Column:
    """The first ``n`` list entries that are neither NULL nor empty."""
    return F.slice(F.filter(items, lambda item: item != ""), 1, n)


def has_text(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def any_name_pattern(names: list[str]) -> str:
    """One alternation over literal names, longest first so that the longer
    of two names with the same start wins."""
    quoted = [
        "".join(ch if ch.isalnum() or ch.isspace() else "\\" + ch for ch in name)
        for name in sorted(set(names), key=lambda n: (-len(n), n))
    ]
    return r"\b(" + "|".join(quoted) + r")\b"


def names_in_text(text: Column, names: list[str]) -> Column:
    """Known names in ``text`` in order of appearance, joined by a space."""
    found = F.regexp_extract_all(text, F.lit(any_name_pattern(names)), F.lit(1))
    return F.array_join(found, " ")
