"""String expressions of the corpus and graph formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the formats.
BLANKS = " \t"
LINE_BLANKS = " \t\r\n"
ALL_BLANKS = " \t\r\n\f\x0b"
NO_ROLE = ("", "none", "head")


def strip(col: Column, chars: str = BLANKS) -> Column:
    """Without the given characters at both ends."""
    return F.btrim(col, F.lit(chars))


def quote_regex(text: str) -> str:
    """A pattern for the text itself."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def split_exact(col: Column, delimiter: str) -> Column:
    """Fields between exact delimiters; trailing empty fields are kept."""
    return F.split(col, quote_regex(delimiter), -1)


def split_blank(col: Column) -> Column:
    """Fields between runs of white space; none of an empty string."""
    return F.filter(F.split(col, r"\s+", -1), lambda x: x != "")


def rsplit_relation(col: Column) -> tuple[Column, Column, Column]:
    """`relation=head` divided at its last `=`: (is there one, relation, head)."""
    has = F.contains(col, F.lit("="))
    head = F.substring_index(col, "=", -1)
    relation = F.left(col, F.length(col) - F.length(head) - 1)
    return has, relation, head


def role_key(col: Column) -> Column:
    """A role as stored in the graph: stripped, in lower case, `head` for the head of an event (null, empty, `None` or `HEAD`)."""
    plain = F.lower(strip(col, ALL_BLANKS))
    return F.when(plain.isNull() | plain.isin(*NO_ROLE), F.lit("head")).otherwise(plain)


def word_key(col: Column) -> Column:
    """A word form for comparison: stripped and in lower case."""
    return F.lower(strip(col, ALL_BLANKS))


def event_members(form: Column) -> Column:
    """The distinct members of an event form in code point order.

    Null where the form is null or empty or any member isn't three non-empty parts separated by `@`.
    """
    members = F.transform(F.split(form, ",", -1), lambda x: strip(x))
    sound = F.forall(members, lambda x: x.rlike(r"\A[^@]+@[^@]+@[^@]+\z"))
    return F.when(sound, F.array_sort(F.array_distinct(members)))


def event_key(form: Column) -> Column:
    """The members of `event_members`, joined by commas: the same for every order and spacing."""
    return F.array_join(event_members(form), ",")
