"""Site date texts -> epoch seconds. Anything unreadable becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storygraph.functions.text import strip
from storygraph.params import DAY_S

# Albanian month names in calendar order.
MONTHS_SQ = (
    "Janar", "Shkurt", "Mars", "Prill", "Maj", "Qershor",
    "Korrik", "Gusht", "Shtator", "Tetor", "Nëntor", "Dhjetor",
)

SITE_ZONE = "Europe/Tirane"


def local_to_epoch(wall: Column, zone: str = SITE_ZONE) -> Column:
    """Local wall time -> epoch seconds; an hour that occurs twice means the later one.

    ``to_utc_timestamp`` takes the earlier of the two, so one hour is added
    whenever the later instant still shows the same wall time.
    """
    stamp = wall.cast("timestamp")
    early = F.to_utc_timestamp(stamp, zone)
    late = early + F.expr("interval 1 hour")
    return F.unix_timestamp(F.when(F.from_utc_timestamp(late, zone) == stamp, late).otherwise(early))


def parse_iso(text: Column, zone: str = SITE_ZONE) -> Column:
    """ISO-8601; a text without offset is read in the site's zone."""
    has_offset = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    aware = F.unix_timestamp(F.try_to_timestamp(text))
    return F.when(has_offset, aware).otherwise(local_to_epoch(F.try_to_timestamp(text), zone))


def parse_named_month(text: Column, zone: str = SITE_ZONE) -> Column:
    """``21 Tetor, 2024 14:30``."""
    pieces = F.split(strip(F.translate(text, ",", "")), r"(?U)\s+")
    months = F.create_map(*[F.lit(x) for i, name in enumerate(MONTHS_SQ, 1) for x in (name, i)])

    def piece(i: int) -> Column:
        return F.try_element_at(pieces, F.lit(i))

    stamp = F.format_string(
        "%s-%02d-%s %s", piece(3), F.try_element_at(months, piece(2)), F.lpad(piece(1), 2, "0"), piece(4)
    )
    complete = (F.size(pieces) == 4) & F.try_element_at(months, piece(2)).isNotNull()
    return F.when(complete, local_to_epoch(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd H:m")), zone))


def parse_day_month_year(date: Column, time: Column, zone: str = SITE_ZONE) -> Column:
    """``21/10/2024`` and ``14:30`` from two places of the page."""
    joined = F.concat(strip(date), F.lit(" "), strip(time))
    return local_to_epoch(F.try_to_timestamp(joined, F.lit("d/M/yyyy H:m")), zone)


def utc_day(epoch: Column) -> Column:
    """Start of the UTC day of an epoch second."""
    return epoch - F.pmod(epoch, F.lit(DAY_S))
