"""Column expressions: calendar, buckets, bits, keyed randomness and report rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY, WEEK, MONTH = "DAY", "WEEK", "MONTH"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# calendar


def day_index(ts, tz: str = "UTC") -> Column:
    """Days since 1970-01-01 of a UTC timestamp, in a zone."""
    local = _c(ts) if tz == "UTC" else F.from_utc_timestamp(_c(ts), tz)
    return F.date_diff(F.to_date(local), F.lit("1970-01-01").cast("date"))


def day_to_date(day) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), _c(day).cast("int"))


def date_to_day(date) -> Column:
    return F.date_diff(_c(date), F.lit("1970-01-01").cast("date"))


def week_index(day) -> Column:
    """Weeks begin on Sunday; 1970-01-01, a Thursday, lies in week 0."""
    return F.floor((_c(day) + 4) / 7).cast("int")


def week_to_date(week) -> Column:
    """The Sunday that begins a week; week 0 begins on 1970-01-01."""
    return day_to_date(F.greatest(_c(week) * 7 - 4, F.lit(0)))


def month_index(day) -> Column:
    date = day_to_date(day)
    return ((F.year(date) - 1970) * 12 + F.month(date) - 1).cast("int")


def month_to_date(month) -> Column:
    return F.make_date(F.floor(_c(month) / 12).cast("int") + 1970, F.pmod(_c(month), F.lit(12)).cast("int") + 1, F.lit(1))


def epoch_index(day, epoch: str = DAY) -> Column:
    return {DAY: lambda: _c(day).cast("int"), WEEK: lambda: week_index(day), MONTH: lambda: month_index(day)}[epoch]()


def midnight_utc(day) -> Column:
    """Unix seconds at which a day begins."""
    return _c(day).cast("long") * 86400


def date_string(day) -> Column:
    """Year-month-day without padding."""
    return F.date_format(day_to_date(day), "y-M-d")


def date_suffix(day) -> Column:
    return F.date_format(day_to_date(day), "yyyyMMdd")


# buckets: 0 is underflow, 1..n are half-open intervals, n + 1 is overflow


def linear_bucket(v, floor: int, n: int, step: int) -> Column:
    v = _c(v)
    return F.when(v < floor, 0).when(v >= floor + n * step, n + 1).otherwise(F.floor((v - floor) / step) + 1).cast("int")


def exponential_floors(floor: int, n: int, step: int, multiplier: int) -> list[int]:
    return [floor] + [floor + step * multiplier**i for i in range(n)]


def exponential_bucket(v, floor: int, n: int, step: int, multiplier: int) -> Column:
    floors = F.array(*[F.lit(x).cast("long") for x in exponential_floors(floor, n, step, multiplier)])
    return F.size(F.filter(floors, lambda x: x <= _c(v))).cast("int")


# bits and randomness


def next_pow2(x) -> Column:
    """Smallest power of two that is at least x."""
    x = _c(x).cast("long")
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(x - 1))))


def bits_of(data: str, k: int) -> Column:
    """Places below k of set bits of binary data of any length; place 0 is the lowest bit of the last byte."""
    byte = lambda i: F.conv(F.hex(F.substring(F.col(data), (F.lit(-1) - F.floor(i / 8)).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.call_function("getbit", byte(i), F.pmod(i, F.lit(8))) == 1)


def keyed_uniform(salt: str, *parts) -> Column:
    """A number in [0, 1) that depends on salt and parts alone, so a retried task draws the same."""
    text = F.concat_ws("|", F.lit(salt), *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def laplace(scale: float, salt: str, *parts) -> Column:
    u = keyed_uniform(salt, *parts) - 0.5
    return -F.lit(scale) * F.signum(u) * F.log(F.greatest(1 - 2 * F.abs(u), F.lit(1e-15)))


def fold_cohort(cohort, m: int) -> Column:
    return F.pmod(_c(cohort), F.lit(m))


def bit_array(bits) -> Column:
    """'0'/'1' string to an array whose first member is the lowest (last) bit."""
    return F.transform(F.split(F.reverse(_c(bits)), ""), lambda b: b.cast("int"))


# rendering


def csv_string(s, most: int = 256) -> Column:
    """Quoted string of at most `most` bytes, with bytes outside 0x20-0x7E, quotes and percent signs as %HH."""
    data = F.substring(F.encode(_c(s), "UTF-8"), 1, most)
    codes = F.filter(F.split(F.regexp_replace(F.hex(data), "(..)", "$1,"), ","), lambda h: h != "")
    plain = lambda h: F.chr(F.conv(h, 16, 10).cast("long"))
    shown = F.transform(codes, lambda h: F.when((h >= "20") & (h <= "7E") & (h != "22") & (h != "25"), plain(h)).otherwise(F.concat(F.lit("%"), h)))
    return F.concat(F.lit('"'), F.array_join(shown, ""), F.lit('"'))


def csv_header(name) -> Column:
    return F.regexp_replace(F.substring(_c(name), 1, 128), "[^A-Za-z0-9]", "_")


def format_float(x) -> Column:
    text = F.format_string("%.3f", _c(x).cast("double"))
    return F.when(text.isin("0.000", "-0.000"), "0").otherwise(text)


def clip_count(x) -> Column:
    return F.greatest(F.lit(0.0), _c(x).cast("double"))


def confidence_interval(est, se, clip: bool = False) -> tuple[Column, Column]:
    low, high = _c(est) - 1.96 * _c(se), _c(est) + 1.96 * _c(se)
    return (F.greatest(low, F.lit(0.0)), F.greatest(high, F.lit(0.0))) if clip else (low, high)


def value_to_string(kind="kind", s="s", i="i", idx="idx", d="d", b="b", label="label") -> Column:
    """Report text of a value: quoted string, integer, 3-decimal double, digest of bytes, or an index's label."""
    return (
        F.when(_c(kind) == "string", csv_string(s))
        .when(_c(kind) == "int", _c(i).cast("string"))
        .when(_c(kind) == "double", format_float(d))
        .when(_c(kind) == "blob", F.base64(F.unhex(F.sha2(_c(b), 256))))
        .when(_c(kind) == "index", F.coalesce(csv_string(label), F.format_string('"<index %d>"', _c(idx))))
    )


def display_value(kind="kind", s="s", i="i", idx="idx", d="d", label="label") -> Column:
    return (
        F.when(_c(kind) == "string", _c(s))
        .when(_c(kind) == "int", _c(i).cast("string"))
        .when(_c(kind) == "double", F.format_string("%.5f", _c(d)))
        .when(_c(kind) == "blob", F.lit("[blob]"))
        .when(_c(kind) == "index", F.coalesce(_c(label), F.format_string("<index %d>", _c(idx))))
    )


def export_name(customer, project, config, first, last=None) -> Column:
    parts = [F.lit("report"), *[_c(x).cast("string") for x in (customer, project, config)], date_suffix(first)]
    return F.concat_ws("_", *parts, *([F.when(_c(last) != _c(first), date_suffix(last))] if last is not None else []))


def export_path(customer, project, config, name, extension: str = ".csv") -> Column:
    folder = F.concat_ws("_", *[_c(x).cast("string") for x in (customer, project, config)])
    return F.concat(folder, F.lit("/"), _c(name), F.when(F.instr(_c(name), ".") > 0, "").otherwise(extension))


def profile_strings(*fields) -> Column:
    """The set fields of a profile as name:value strings."""
    return F.array_compact(F.array(*[F.when(F.coalesce(_c(f), F.lit("")) != "", F.concat(F.lit(f + ":"), _c(f))) for f in fields]))
