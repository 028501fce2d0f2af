"""Numbers, sizes, spans and identifiers as readers see them; a dash stands for what is missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The signs in use.
DASH, MINUS = "—", "−"


def _or_dash(known: Column, text: Column) -> Column:
    return F.when(known, text).otherwise(DASH)


def _known(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x.cast("double"))


def _trimmed(x: Column) -> Column:
    """A number with thousands separators and up to two places, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_number(x, 2), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def number(x: Column, digits: int = 3) -> Column:
    return _or_dash(_known(x), F.replace(F.format_string(f"%.{digits}f", x.cast("double")), F.lit("-"), F.lit(MINUS)))


def change(x: Column, digits: int = 3) -> Column:
    sign = F.when(x > 0, "+").when(x < 0, MINUS).otherwise("±")
    return _or_dash(_known(x), F.concat(sign, F.format_string(f"%.{digits}f", F.abs(x.cast("double")))))


def percent(x: Column) -> Column:
    return _or_dash(_known(x), F.concat(F.format_string("%.1f", x.cast("double")), F.lit("%")))


def size(n: Column) -> Column:
    """Bytes in the largest unit that leaves a whole number; one place below ten."""
    units = ["KB", "MB", "GB", "TB"]
    value = n.cast("double")

    def shown(k: int) -> Column:
        v = value / 1024 ** (k + 1)
        return F.concat(F.when(v >= 10, F.format_string("%.0f", F.floor(v + 0.5).cast("double"))).otherwise(F.format_string("%.1f", v)), F.lit(f" {units[k]}"))

    large = reduce(lambda acc, k: acc.when(value < 1024.0 ** (k + 2), shown(k)), range(1, len(units) - 1), F.when(value < 1024.0**2, shown(0))).otherwise(shown(len(units) - 1))
    return _or_dash(_known(n) & (n >= 0), F.when(value < 1024, F.concat(F.format_string("%.0f", value), F.lit(" B"))).otherwise(large))


def km2(x: Column) -> Column:
    v = x.cast("double")
    text = F.when(v >= 100, F.format_number(F.floor(v + 0.5), 0)).when(v >= 10, _trimmed(F.round(v, 1))).otherwise(F.format_string("%.2f", v))
    return _or_dash(_known(x), F.concat(text, F.lit(" km²")))


def area_limit(x: Column) -> Column:
    v = x.cast("double")
    return _or_dash(_known(x), F.concat(F.when(v >= 100, F.format_number(F.floor(v + 0.5), 0)).otherwise(_trimmed(F.round(v, 2))), F.lit(" km²")))


def day_span(days: Column) -> Column:
    """Days, and years beside them from two years on."""
    whole = F.floor(days.cast("double") + 0.5)
    label = F.concat(F.format_number(whole, 0), F.lit(" days"))
    return _or_dash(_known(days), F.when(whole < 730, label).otherwise(F.concat(label, F.lit(" (about "), _trimmed(F.round(whole / 365.25, 1)), F.lit(" years)"))))


def granules(count: Column, tiles: Column) -> Column:
    named = F.when((count > 1) & (F.size(tiles) > 0), F.concat(F.lit(" · "), F.array_join(tiles, ", "))).otherwise("")
    return F.concat(count.cast("string"), F.when(count == 1, " granule").otherwise(" granules"), named)


def truncate_middle(text: Column, longest: int = 24) -> Column:
    keep = max(4, (longest - 1) // 2)
    return F.when(F.char_length(text) <= longest, text).otherwise(F.concat(F.left(text, F.lit(keep)), F.lit("…"), F.right(text, F.lit(keep))))


def short_digest(text: Column, length: int = 8) -> Column:
    return _or_dash(F.coalesce(text, F.lit("")) != "", F.left(text, F.lit(length)))


def day(iso: Column) -> Column:
    return _or_dash(F.coalesce(iso, F.lit("")) != "", F.left(iso, F.lit(10)))


def minute(iso: Column) -> Column:
    """A time in UTC to the minute; other text as it is."""
    at = iso.try_cast("timestamp")
    return _or_dash(F.coalesce(iso, F.lit("")) != "", F.coalesce(F.concat(F.date_format(at, "yyyy-MM-dd HH:mm"), F.lit(" UTC")), iso))
