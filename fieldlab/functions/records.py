"""Column functions over device records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldlab.constants import (
    ADDRESS_LABEL, BAND_LABELS, CLASS_LABEL, COORDINATES_LABEL, HIGH, MODERATE, NO_ADDRESS, SHARE_TITLE,
)

# The commonest shape of a timestamp, and the ISO-8601 grammar of the devices' parser
# (groups: year, month, day, hour, minute, second, fraction, zone, sign, zone hours, zone minutes).
COMMON_STAMP = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX"
STAMP = r"^([+-]?\d{4,6})-?(\d\d)-?(\d\d)(?:[ T](\d\d)(?::?(\d\d)(?::?(\d\d)(?:[.,](\d+))?)?)?( ?[zZ]| ?([-+])(\d\d)(?::?(\d\d))?)?)?\z"
#: Years beyond this do not fit a timestamp of microseconds.
LAST_YEAR = 275_760


def instant(text: Column) -> Column:
    """The instant of an ISO-8601 text; null if it is none.

    Extended and basic forms, a blank for the T, commas for points, any number
    of decimals (cut after the microseconds) and zones with or without a colon
    are read; parts beyond their range carry over, as 30 February does into
    March.  A text without a zone is read in the session time zone, which jobs
    set to the device's zone or UTC.
    """
    mark = "\x01"  # one match gives all parts, each behind a mark
    parts = F.split(F.regexp_replace(text, STAMP, "".join(f"{mark}${k}" for k in range(1, 12))), mark)
    matched = F.when(~F.contains(text, F.lit(mark)), parts)

    def read(part: Column) -> Column:
        number = lambda k: F.coalesce(F.get(part, F.lit(k)).try_cast("long"), F.lit(0))
        year = number(1).cast("int")
        day = F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), number(2).cast("int") - 1), number(3).cast("int") - 1)
        seconds = F.unix_date(day).cast("long") * 86_400 + number(4) * 3600 + number(5) * 60 + number(6)
        offset = (number(10) * 3600 + number(11) * 60) * F.when(part[9] == "-", -1).otherwise(1)
        micros = F.rpad(part[7], 6, "0").substr(1, 6).try_cast("long")
        utc = F.timestamp_micros((seconds - offset) * 1_000_000 + F.coalesce(micros, F.lit(0)))
        at = F.when(part[8] == "", F.to_utc_timestamp(utc, F.current_timezone())).otherwise(utc)
        return F.when((F.size(part) == 12) & (F.abs(year) <= LAST_YEAR), at)

    # the one-element array binds the parts to a name, so the match is made once, and only if the common shape fails
    return F.coalesce(F.try_to_timestamp(text, F.lit(COMMON_STAMP)), F.get(F.transform(F.array(matched), read), F.lit(0)))


def instant_or_epoch(text: Column) -> Column:
    return F.coalesce(instant(text), F.timestamp_seconds(F.lit(0)))


def utc_text(at: Column) -> Column:
    """A timestamp as an ISO-8601 text in UTC: three decimals, or six where they are needed."""
    utc = F.to_utc_timestamp(at, F.current_timezone())
    shape = lambda decimals: F.date_format(utc, f"yyyy-MM-dd'T'HH:mm:ss.{decimals}'Z'")
    return F.when(F.unix_micros(at) % 1000 == 0, shape("SSS")).otherwise(shape("SSSSSS"))


def has_coordinates() -> Column:
    return F.col("latitude").isNotNull() & F.col("longitude").isNotNull()


def has_valid_address() -> Column:
    return F.coalesce((F.col("address") != "") & (F.col("address") != NO_ADDRESS), F.lit(False))


def has_classification() -> Column:
    return F.coalesce(F.col("texture_class") != "", F.lit(False))


def fixed(value: Column, digits: int) -> Column:
    """A number with ``digits`` places, halves away from zero, without grouping."""
    return F.round(value.cast("decimal(24,10)"), digits).cast(f"decimal(24,{digits})").cast("string")


def confidence_band(score: Column) -> Column:
    """high, moderate or low; null and NaN are low."""
    return F.when(score.isNull() | F.isnan(score), "low").when(score >= HIGH, "high").when(score >= MODERATE, "moderate").otherwise("low")


def band_label(band: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in BAND_LABELS.items() for x in kv)), band)


def display_stamp(text: Column, connector: str = " às ") -> Column:
    """dd/MM/yyyy, the connector and HH:mm; an unreadable text stays as it is."""
    at = instant(text)
    return F.coalesce(F.concat(F.date_format(at, "dd/MM/yyyy"), F.lit(connector), F.date_format(at, "HH:mm")), text)


def display_coordinates() -> Column:
    return F.when(has_coordinates(), F.concat(fixed(F.col("latitude"), 6), F.lit(", "), fixed(F.col("longitude"), 6))).otherwise(COORDINATES_LABEL)


def display_confidence() -> Column:
    return F.coalesce(F.concat(fixed(F.col("confidence_score") * 100, 1), F.lit("%")), F.lit("-"))


def confidence_chip() -> Column:
    """Whole percent and band label; the label alone for scores that are not finite."""
    score, label = F.col("confidence_score"), band_label(confidence_band(F.col("confidence_score")))
    finite = ~F.isnan(score) & (F.abs(score) != float("inf"))
    return F.when(score.isNull(), None).when(finite, F.concat(fixed(score * 100, 0), F.lit("% · "), label)).otherwise(label)


def display_address() -> Column:
    return F.when(has_valid_address(), F.col("address")).otherwise(ADDRESS_LABEL)


def display_class() -> Column:
    return F.when(has_classification(), F.col("texture_class")).otherwise(CLASS_LABEL)


def share_caption(include_location: bool = False, title: str = SHARE_TITLE) -> Column:
    """Title, class and date on a line each; the place only if asked for."""
    percent = F.when(F.col("confidence_score").isNotNull(), F.concat(F.lit(" ("), display_confidence(), F.lit(")"))).otherwise("")
    lines = [F.lit(title), F.when(has_classification(), F.concat(F.lit("Classe: "), F.col("texture_class"), percent))]
    if include_location:
        lines += [F.when(has_valid_address(), F.concat(F.lit("Local: "), "address")), F.when(has_coordinates(), F.concat(F.lit("Coordenadas: "), display_coordinates()))]
    return F.concat_ws("\n", *lines, F.concat(F.lit("Data: "), display_stamp(F.col("timestamp"))))


def compose_address(street: Column, locality: Column, area: Column) -> Column:
    joined = F.concat_ws(", ", *(F.nullif(x, F.lit("")) for x in (street, locality, area)))
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(NO_ADDRESS))


def address_contains(term: str) -> Column:
    """Literal, case-insensitive search; % _ and backslash stand for themselves."""
    return F.contains(F.lower("address"), F.lit(term.strip().lower()))


def stored_image_path(uuid: Column, source_path: Column) -> Column:
    """soil_images/<uuid><extension of the source, .jpg by default>; null for a uuid with a path separator."""
    name = F.regexp_extract(source_path, r"[^/\\]*$", 0)
    extension = F.regexp_extract(name, r"[^.](\.[^.]*)$", 1)
    return F.when(~F.contains(uuid, F.lit("/")) & ~F.contains(uuid, F.lit("\\")), F.concat(F.lit("soil_images/"), uuid, F.when(extension == "", ".jpg").otherwise(extension)))
