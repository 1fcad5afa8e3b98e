"""Mail dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and the zone names RFC 5322 still admits, in hours.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ZONE_HOURS = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "AST": -4, "ADT": -3, "EST": -5, "EDT": -4,
    "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
}

_LAYOUT = (
    r"^\s*(?:[A-Za-z]+\.?,?\s+|[A-Za-z]+,)?"           # weekday
    r"(\d{1,2})[\s-]+([A-Za-z]{3})[A-Za-z]*[\s-]+"     # day, month
    r"(\d{4}|\d{2})\s+"                                # year
    r"(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?"              # time
    r"(?:\s*([+-]\d{4})|\s+([A-Za-z]{1,5}))?"          # zone
    r"\s*(?:\([^()]*\)\s*)?$"                          # comment
)


_PARTS = 8


def _timestamp(parts: Column) -> Column:
    def part(number: int) -> Column:
        return F.nullif(parts[number - 1], F.lit(""))

    def number(at: int) -> Column:
        return part(at).cast("int")

    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(part(2))).cast("int")
    short = F.when(number(3) < 69, number(3) + 2000).otherwise(number(3) + 1900)
    year = F.when(F.length(part(3)) == 4, number(3)).otherwise(short)
    local = F.try_make_timestamp_ntz(
        year, F.nullif(month, F.lit(0)), number(1), number(4), number(5),
        F.coalesce(number(6), F.lit(0)).cast("decimal(16,6)"),
    )
    ahead = F.abs(number(7))
    minutes = F.signum(number(7).cast("double")).cast("int") * (F.floor(ahead / 100) * 60 + ahead % 100)
    zones = F.create_map(*[F.lit(v) for name, hours in ZONE_HOURS.items() for v in (name, hours * 60)])
    shift = F.coalesce(minutes, F.try_element_at(zones, F.upper(part(8))), F.lit(0)).cast("int")
    return (local - F.make_dt_interval(F.lit(0), F.lit(0), shift)).cast("timestamp_ntz")


def parse_mail_date(header: Column) -> Column:
    """UTC TIMESTAMP_NTZ of a Date header; NULL when it cannot be read.

    A missing or unknown zone counts as UTC.
    """
    groups = "|".join(f"${number}" for number in range(1, _PARTS + 1))
    parts = F.when(header.rlike(_LAYOUT), F.split(F.regexp_replace(header, _LAYOUT, groups), r"\|"))
    # Bound once as a lambda variable, since every part is used several times.
    return F.transform(F.array(parts), lambda p: F.when(p.isNotNull(), _timestamp(p)))[0]
