"""Timestamps in any form, precision and zone to one instant in UTC (problem 3)."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlery.functions.timeaxis import SECOND

# Month names and their short forms in the languages of the sources.
MONTHS = {
    1: "january jan januar jänner janvier janv enero ene січня січень січ",
    2: "february feb februar février févr febrero лютого лютий лют",
    3: "march mar märz mär mrz mars marzo березня березень бер",
    4: "april apr avril avr abril abr квітня квітень кві квіт",
    5: "may mai mayo травня травень тра трав",
    6: "june jun juni juin junio червня червень чер черв",
    7: "july jul juli juillet juil julio липня липень лип",
    8: "august aug août agosto ago серпня серпень сер серп",
    9: "september sep sept septembre septiembre set вересня вересень вер",
    10: "october oct oktober okt octobre octubre жовтня жовтень жов жовт",
    11: "november nov novembre noviembre листопада листопад лис лист",
    12: "december dec dezember dez décembre déc diciembre dic грудня грудень гру груд",
}
# Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "ist": 330, "sgt": 480, "hkt": 480, "jst": 540, "kst": 540, "aest": 600, "aedt": 660,
    "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420,
    "mdt": -360, "pst": -480, "pdt": -420,
}
# Units of relative times and their length in seconds.
RELATIVE_UNITS = {
    1: "s sec secs second seconds с сек секунд секунди секунду",
    60: "m min mins minute minutes хв хвилин хвилини хвилину",
    3600: "h hr hrs hour hours год годин години годину",
    86400: "d day days день дня дні днів дн",
    604800: "w wk wks week weeks тиж тижд тиждень тижні тижня тижнів",
    2592000: "mo month months міс місяць місяці місяців",
    31536000: "y yr yrs year years рік роки років",
}
YESTERDAY, NOW = ("yesterday", "вчора", "учора"), ("just now", "now", "щойно", "зараз", "тільки що")

TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([ap])\.?m\.?)?"
ZONE = r"\s*((?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?|[a-z]{1,5})?(?:\s*\([a-z ]+\))?"
CLOCK = rf"(?:(?:,|\s)\s*(?:at |о |об |um |à )?{TIME})?{ZONE}$"
WEEKDAY = r"(?:\p{L}{2,12}\.?,?\s+)?"
# pattern, then the canonical y|month|d|h|mi|s|fraction|a or p|zone|order that it becomes
WALL_FORMS = [
    (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:(?:t|,|\s)\s*{TIME})?{ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9|"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:t?(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d+))?)?{ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8|"),
    (rf"^{WEEKDAY}(\d{{1,2}})(?:st|nd|rd|th|\.)?\s+(?:de )?(\p{{L}}+)\.?,?\s+(?:de )?(\d{{4}})(?: р\.?)?{CLOCK}", "$3|$2|$1|$4|$5|$6|$7|$8|$9|"),
    (rf"^{WEEKDAY}(\p{{L}}+)\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){CLOCK}", "$3|$1|$2|$4|$5|$6|$7|$8|$9|"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}){CLOCK}", "$3|$2|$1|$4|$5|$6|$7|$8|$9|"),
    (rf"^(\d{{4}})[./](\d{{1,2}})[./](\d{{1,2}}){CLOCK}", "$1|$2|$3|$4|$5|$6|$7|$8|$9|"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}){CLOCK}", "$3|$2|$1|$4|$5|$6|$7|$8|$9|/"),
    (rf"^(\d{{4}})年(\d{{1,2}})月(\d{{1,2}})日(?:\s*{TIME})?{ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9|"),
]
EPOCH = r"^(?:/date\()?(-?\d{9,19})(?:\.(\d+))?(?:[+-]\d{4})?(?:\)/)?$"
AGO = r"^(?:about |almost |близько )?(\d{1,6}|an?|one)\s*(\p{L}+)\.?\s+(?:ago|тому)$"
FIRST_YEAR, LAST_YEAR = 1970, 2100
#: Seconds that stand for no beginning or end.
FOREVER = 9_000_000_000_000


def _lookup(words: dict[int, str], key: Column) -> Column:
    found = F.lit(None).cast("long")
    for value, names in words.items():
        found = F.when(key.isin(*names.split()), F.lit(value).cast("long")).otherwise(found)
    return found


def parse_form(text: Column, order: Column) -> Column:
    """What a text says: struct of instant_us (fixed), wall_us (local time, no zone) and ago_s (relative); others null.

    Texts that are no time, impossible dates (31 February) and hours, and unknown zone names give all nulls. ``order`` is
    YMD, DMY or MDY and read only for numeric dates with slashes whose year doesn't lead; YMD and null leave such a date
    without a reading. White space of any kind around and inside is evened out; case doesn't matter.
    """
    t = F.lower(F.trim(F.regexp_replace(text, r"[\s  -​ 　﻿]+", " ")))
    form = F.lit(None).cast("string")
    for pattern, parts in reversed(WALL_FORMS):
        form = F.when(t.rlike(pattern), F.regexp_replace(t, pattern, parts)).otherwise(form)
    form = F.when(t.rlike(EPOCH), F.regexp_replace(t, EPOCH, "@|$1|$2")).when(t.rlike(AGO), F.regexp_replace(t, AGO, "-|$1|$2")).otherwise(form)
    form = F.when(t.isin(*YESTERDAY), F.lit("-|1|day")).when(t.isin(*NOW), F.lit("-|0|s")).otherwise(form)
    return F.transform(F.array(F.struct(F.split(form, r"\|").alias("p"), order.alias("o"))), _read)[0]


def _read(x: Column) -> Column:
    p = x["p"]
    part = lambda i: F.nullif(F.get(p, F.lit(i)), F.lit(""))
    number = lambda i: part(i).try_cast("int")
    fraction = lambda i: F.coalesce(F.rpad(F.substring(part(i), 1, 6), 6, "0").try_cast("long"), F.lit(0).cast("long"))

    # counts since 1970: by their number of digits seconds, milli-, micro- or nanoseconds
    count, digits = part(1).try_cast("decimal(19,0)"), F.length(F.ltrim(part(1), F.lit("-")))
    epoch = (
        F.when(digits <= 10, count * SECOND + fraction(2))
        .when(digits <= 13, count * 1000 + F.substring(F.rpad(F.coalesce(part(2), F.lit("")), 3, "0"), 1, 3).try_cast("long"))
        .when(digits <= 16, count)
        .otherwise(F.floor(count / 1000))
        .try_cast("long")
    )
    ago = F.when(F.get(p, F.lit(1)).isin("a", "an", "one"), F.lit(1)).otherwise(number(1)) * _lookup(RELATIVE_UNITS, part(2))

    slashed = F.get(p, F.lit(9)) == "/"
    first, second = number(2), number(1)  # of a slashed date as written, first/second/year
    month = F.when(slashed, F.when(x["o"] == "MDY", first).when(x["o"] == "DMY", second)).otherwise(F.coalesce(number(1), _lookup(MONTHS, part(1)).cast("int")))
    day = F.when(slashed, F.when(x["o"] == "MDY", second).when(x["o"] == "DMY", first)).otherwise(first)
    half = part(7)
    hour = F.when(half.isNull(), F.coalesce(number(3), F.lit(0))).when(number(3).between(1, 12), number(3) % 12 + F.when(half == "p", 12).otherwise(0))
    date = F.call_function("try_make_timestamp_ntz", number(0), month, day, hour, F.coalesce(number(4), F.lit(0)), F.coalesce(number(5), F.lit(0)).cast("decimal(16,6)"))
    wall = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), date) + fraction(6)

    zone = part(8)
    shift = F.regexp_replace(F.regexp_replace(zone, "^(utc|gmt)", ""), ":", "")
    sign = F.when(shift.startswith("-"), -1).otherwise(1)
    size = F.substring(shift, 2, 4)
    minutes = F.when(F.length(size) <= 2, size.try_cast("int") * 60).otherwise(
        F.substring(F.lpad(size, 4, "0"), 1, 2).try_cast("int") * 60 + F.substring(F.lpad(size, 4, "0"), 3, 2).try_cast("int")
    )
    names: dict[int, str] = {}
    for name, m in ABBREVIATIONS.items():
        names[m] = f"{names.get(m, '')} {name}"
    offset = F.when(shift.rlike("^[+-]"), sign * minutes).otherwise(_lookup(names, zone))
    kind = F.get(p, F.lit(0))
    return F.struct(
        F.when(kind == "@", epoch).when(~kind.isin("@", "-") & zone.isNotNull(), wall - offset * 60 * SECOND).cast("long").alias("instant_us"),
        F.when(~kind.isin("@", "-") & zone.isNull(), wall).cast("long").alias("wall_us"),
        F.when(kind == "-", ago).cast("long").alias("ago_s"),
    )


def _changes(zone: str) -> list[tuple[int, int]]:
    """(second since 1970 from which it holds, offset in seconds) of a zone, the first without a beginning."""
    try:
        info = ZoneInfo(zone)
    except (KeyError, ValueError, OSError):
        return []
    offset = lambda s: int(datetime.fromtimestamp(s, UTC).astimezone(info).utcoffset() / timedelta(seconds=1))
    start, end, step = -366 * 86_400, (LAST_YEAR - 1969) * 366 * 86_400, 5 * 86_400
    found, at, now = [(-FOREVER, offset(start))], start, offset(start)
    while at < end:
        if (then := offset(at + step)) != now:
            lo, hi = at, at + step
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if offset(mid) == now else (lo, mid)
            found.append((hi, then))
            now = then
        at += step
    return found


def offset_intervals(zones: DataFrame) -> DataFrame:
    """Validity intervals of the offsets of each zone, in local time, exploded to the years they touch.

    One row per zone and year with an array of (lo, hi, offset_us): at most one row for each IANA zone and year, so under
    80,000 short rows whatever the data. Years are clamped to 1970..2100, beyond which the outer intervals hold.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for zone in batch["zone"]:
                changes = _changes(zone)
                for i, (since, offset) in enumerate(changes):
                    until = changes[i + 1][0] if i + 1 < len(changes) else FOREVER
                    lo, hi = since + offset, until + offset
                    year = lambda s: min(LAST_YEAR, max(FIRST_YEAR, 1970 + s // 31_556_952))
                    out += [(zone, y, lo, hi, offset) for y in range(max(FIRST_YEAR, year(lo - 3 * 86_400) - (i > 0)), year(hi + 3 * 86_400) + 1)]
            yield pd.DataFrame(out, columns=["zone", "year", "lo", "hi", "offset"])

    each = zones.where("zone is not null").mapInPandas(rows, "zone string, year int, lo long, hi long, offset long")
    span = F.struct(*[(F.col(c) * SECOND).alias(c) for c in ("lo", "hi", "offset")])
    return each.groupBy("zone", "year").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def local_to_utc(wall: Column, spans: Column) -> Column:
    """Instant of a wall time: of two matching intervals the earlier instant, of none the offset before the change."""
    matching = F.transform(F.filter(spans, lambda s: (wall >= s["lo"]) & (wall < s["hi"])), lambda s: wall - s["offset"])
    ended = F.filter(spans, lambda s: s["hi"] <= wall)
    return F.when(F.size(matching) > 0, F.array_min(matching)).otherwise(wall - F.try_element_at(ended, F.lit(-1))["offset"])


def _resolved(rows: DataFrame, parsed: str, zone: str, intervals: DataFrame, to: str) -> DataFrame:
    """Adds ``to``: the fixed instant, or that of the local time in the zone, by an as-of join to the offset intervals."""
    wall = F.col(f"{parsed}.wall_us")
    year = F.greatest(F.lit(FIRST_YEAR), F.least(F.lit(LAST_YEAR), F.year(F.date_from_unix_date(F.floor(wall / (86_400 * SECOND)).try_cast("int")))))
    spans = intervals.select(F.col("zone").alias("_zone"), F.col("year").alias("_year"), F.col("spans").alias("_spans"))
    joined = rows.withColumn("_at", year).join(F.broadcast(spans), (F.col(zone) == F.col("_zone")) & (F.col("_at") == F.col("_year")), "left")
    return joined.withColumn(to, F.coalesce(F.col(f"{parsed}.instant_us"), local_to_utc(wall, F.col("_spans")))).drop("_at", "_zone", "_year", "_spans")


def news_instants(news: DataFrame, sources: DataFrame, collector_zone: str = "Europe/Kyiv") -> DataFrame:
    """news_id, field_name, instant_us of every published_at and scraped_at that gives an instant; a news_id counts once.

    published_at without zone is wall time of its source (no known source, no instant); scraped_at is wall time of the
    collector and day first. Relative times count back from the item's scraped_at instant; scraped_at itself can't be
    relative. Of differing rows with one news_id the least (scraped_at, published_at, source) is read.
    """
    once = news.groupBy("news_id").agg(F.min(F.struct("scraped_at", "published_at", "source")).alias("item")).select("news_id", "item.*")
    places = sources.where("source_name is not null").groupBy("source_name").agg(F.min(F.struct("time_zone", "date_order")).alias("place"))
    rows = once.join(places, once["source"] == places["source_name"], "left")
    rows = rows.select(
        "news_id",
        parse_form(F.col("scraped_at"), F.lit("DMY")).alias("scraped"),
        parse_form(F.col("published_at"), F.col("place.date_order")).alias("published"),
        F.col("place.time_zone").alias("zone"),
        F.lit(collector_zone).alias("home"),
    )
    zones = sources.select(F.col("time_zone").alias("zone")).union(sources.sparkSession.createDataFrame([(collector_zone,)], "zone string")).distinct()
    intervals = offset_intervals(zones)
    rows = _resolved(rows, "scraped", "home", intervals, "scraped_us")
    rows = _resolved(rows, "published", "zone", intervals, "published_us")
    published = F.coalesce(F.col("published_us"), F.col("scraped_us") - F.col("published.ago_s") * SECOND)
    both = F.array(
        F.struct(F.lit("published_at").alias("field_name"), published.alias("instant_us")),
        F.struct(F.lit("scraped_at").alias("field_name"), F.col("scraped_us").alias("instant_us")),
    )
    return rows.select("news_id", F.explode(both).alias("x")).select("news_id", "x.*").where("instant_us is not null")
