"""Date parsing for the shapes exports contain. Absent or impossible dates are null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tieline.functions import fixed_values as fv
from tieline.functions.text import clean, let

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _month_number(name: Column) -> Column:
    table = F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in fv.MONTH_NAMES.items())))
    return F.try_element_at(table, F.lower(name))


def _instant(y: Column, mo: Column, d: Column, h: Column | None = None, mi: Column | None = None,
             s: Column | None = None) -> Column:
    zero = F.lit(0)
    as_int = lambda c: c.try_cast("int")
    # A group that matched nothing is '', which a cast would refuse by way of an exception; with a leading zero it is a number.
    filled = lambda c: zero if c is None else F.coalesce(as_int(F.concat(F.lit("0"), c)), zero)
    made = F.try_make_timestamp_ntz(
        as_int(y), as_int(mo), as_int(d), filled(h), filled(mi), filled(s).cast("decimal(16,6)")
    )
    return F.when(as_int(y) >= 100, made)


def parse_date(c: Column) -> Column:
    """The instant a text names, null when it names none."""
    return let(clean(c), _read)


def _read(raw: Column) -> Column:
    part = lambda pattern, i: F.regexp_extract(raw, pattern, i)
    iso = r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2}))?)?"
    day_first = r"^(\d{1,2})\s+([A-Za-z]{3,})\.?,?\s+(\d{4})$"
    month_first = r"^([A-Za-z]{3,})\.?\s+(\d{1,2}),?\s+(\d{4})$"
    month_only = r"^([A-Za-z]{3,})\.?\s+(\d{4})$"
    slashes = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    one = F.lit(1)
    first, second = part(slashes, 1).try_cast("int"), part(slashes, 2).try_cast("int")
    year = raw.try_cast("int")
    seconds = F.when(F.length(raw) == 13, raw.try_cast("long") / 1000.0).otherwise(raw.try_cast("double"))
    # Timestamps without zone keep parsing independent of the session's zone.
    from_epoch = F.expr(EPOCH) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return (
        F.when(raw.rlike(r"^(\d{13}|\d{10})$"), from_epoch)
        .when(raw.rlike(iso), _instant(*[part(iso, i) for i in range(1, 7)]))
        .when(
            raw.rlike(day_first) & _month_number(part(day_first, 2)).isNotNull(),
            _instant(part(day_first, 3), _month_number(part(day_first, 2)), part(day_first, 1)),
        )
        .when(
            raw.rlike(month_first) & _month_number(part(month_first, 1)).isNotNull(),
            _instant(part(month_first, 3), _month_number(part(month_first, 1)), part(month_first, 2)),
        )
        .when(
            raw.rlike(month_only) & _month_number(part(month_only, 1)).isNotNull(),
            _instant(part(month_only, 2), _month_number(part(month_only, 1)), one),
        )
        .when(raw.rlike(r"^\d{4}$") & year.between(1900, 2200), _instant(year, one, one))
        .when(
            raw.rlike(slashes),
            _instant(
                part(slashes, 3),
                F.when(first > 12, second).otherwise(first),
                F.when(first > 12, first).otherwise(second),
            ),
        )
    )


def date_only(ts: Column) -> Column:
    return ts.cast("date")


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def iso_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def iso_instant(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def age_days(now: Column, ts: Column) -> Column:
    """Fractional days from `ts` to `now`; negative for a future `ts`."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(now) - micros(ts)) / F.lit(86400e6)
