"""Whether a column's header names a date or an identifier, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fragments of headers of dates, ordinary words that hold such a fragment, whole words of dates, of events, and of what is no
# date beside an event; whole words of identifiers and how such words end.
DATE_PARTS = ("date", "dt", "time", "day", "period", "expir", "effectiv", "matur", "birth", "fecha", "datum", "giorno", "tarih")
NO_DATE_PARTS = ("bandwidth", "width", "breadth", "hundredth", "thousandth", "lifetime", "overtime", "runtime", "downtime", "uptime", "timeout", "anytime",
                 "update", "candidate", "validate", "mandate", "accommodate", "consolidate", "liquidate", "sedate", "intimidate")
DATE_WORDS = ("at", "on", "ts", "dob", "doj", "when", "since", "until", "due", "asof", "eff", "tag", "dia", "jour")
EVENT_WORDS = ("created", "updated", "modified", "posted", "issued", "closed", "opened")
NO_DATE_WORDS = ("by", "id", "user", "no", "num", "number", "code", "count")
ID_WORDS = ("id", "no", "nbr", "num", "number", "code", "ref", "key", "acct", "account", "policy", "invoice", "order", "customer", "cust", "sku", "zip", "pin",
            "postal", "postcode", "serial", "ssn", "tin", "ein")
ID_ENDS = ("number", "nbr", "code")


def words(header: Column) -> Column:
    """The lower-case words of a header: ASCII letters and digits, cut at capitals too; none for null."""
    cut = header
    for before, after in (("[a-z0-9]", "[A-Z]"), ("[A-Z]", "[A-Z][a-z]")):
        cut = F.regexp_replace(cut, f"({before})({after})", "$1 $2")
    return F.coalesce(F.regexp_extract_all(F.lower(cut), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))


def _any(found: Column, of: tuple[str, ...]) -> Column:
    return F.arrays_overlap(found, F.array(*map(F.lit, of)))


def names_date(header: Column) -> Column:
    """A date's fragment stands in the header outside ordinary words, or a date's word in it, or an event's without a person or number."""
    bare = F.regexp_replace(F.lower(header), "|".join(NO_DATE_PARTS), " ")
    found = words(header)
    return F.coalesce(bare.rlike("|".join(DATE_PARTS)), F.lit(False)) | _any(found, DATE_WORDS) | (_any(found, EVENT_WORDS) & ~_any(found, NO_DATE_WORDS))


def names_identifier(header: Column) -> Column:
    found = words(header)
    return _any(found, ID_WORDS) | F.exists(found, lambda w: w.rlike(f"({'|'.join(ID_ENDS)})$"))
