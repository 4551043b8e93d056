"""Problem 3: forms of time, zones and changes of the clock, against zoneinfo."""

from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pytest

from candlery.operators.instants import news_instants

SOURCES = [("ny", "America/New_York", "MDY"), ("kyiv", "Europe/Kyiv", "DMY"), ("tokyo", "Asia/Tokyo", "YMD"), ("odd", "No/Where", "DMY"), (None, "UTC", "DMY")]


def us(*parts, zone="UTC", fold=0, micro=0):
    at = datetime(*parts, tzinfo=ZoneInfo(zone), fold=fold).astimezone(UTC)
    return int(at.timestamp()) * 1_000_000 + micro


CASES = [
    ("2024-05-04T15:05:25Z", "ny", us(2024, 5, 4, 15, 5, 25)),
    ("2025-02-08T14:58:20.340669986+05:30", "ny", us(2025, 2, 8, 9, 28, 20, micro=340669)),
    ("2024-01-24 01:01:37,5", "ny", us(2024, 1, 24, 6, 1, 37, micro=500000)),
    ("20250809T152231Z", "ny", us(2025, 8, 9, 15, 22, 31)),
    ("1745111958.10", "ny", 1745111958100000),
    ("1738419683982", "ny", 1738419683982000),
    ("/Date(1741520734952+0900)/", "ny", 1741520734952000),
    ("Tue, 10 Oct 2023 17:29:12 EDT", "tokyo", us(2023, 10, 10, 21, 29, 12)),
    ("06/05/2024 07:00", "ny", us(2024, 6, 5, 7, 0, zone="America/New_York")),
    ("06/05/2024 07:00", "kyiv", us(2024, 5, 6, 7, 0, zone="Europe/Kyiv")),
    ("06.05.2024 07:00", "ny", us(2024, 5, 6, 7, 0, zone="America/New_York")),
    ("2024/10/23 08:55", "tokyo", us(2024, 10, 23, 8, 55, zone="Asia/Tokyo")),
    ("September 10, 2024 at 12:51 am", "ny", us(2024, 9, 10, 0, 51, zone="America/New_York")),
    ("June 23, 2025 4:33 PM EDT", "tokyo", us(2025, 6, 23, 20, 33)),
    ("29 березня 2025, 21:42", "kyiv", us(2025, 3, 29, 21, 42, zone="Europe/Kyiv")),
    ("16 März 2023", "kyiv", us(2023, 3, 16, zone="Europe/Kyiv")),
    ("  23/6/2024\t", "kyiv", us(2024, 6, 23, zone="Europe/Kyiv")),
    # the hour that comes twice: the earlier; the hour that is skipped: the offset before the change
    ("2024-11-03 01:30:00", "ny", us(2024, 11, 3, 1, 30, zone="America/New_York", fold=0)),
    ("2024-03-10 02:30:00", "ny", us(2024, 3, 10, 7, 30)),
    ("3 hours ago", "ny", us(2024, 7, 1, 9)),
    ("45 хв тому", "ny", us(2024, 7, 1, 11, 15)),
    ("yesterday", "ny", us(2024, 6, 30, 12)),
    ("just now", "ny", us(2024, 7, 1, 12)),
    ("an hour ago", "ny", us(2024, 7, 1, 11)),
    ("31 February 2024", "ny", None), ("0000-00-00 00:00:00", "ny", None), ("soon", "ny", None), ("", "ny", None), (None, "ny", None),
    ("2024-01-01 25:00", "ny", None), ("2024-01-01 10:00", "odd", None), ("2024-01-01 10:00", None, None), ("Mon, 1 Jan 2024 10:00:00 XYZ", "ny", None),
]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, text, "2024-07-01T12:00:00Z", source, "clash") for i, (text, source, _) in enumerate(CASES)]
    rows += [(900, None, "01/07/2024 15:00", None, "x"), (900, None, "01/07/2024 15:00", None, "x"), (901, "2 days ago", "n/a", "ny", "x")]
    news = spark.createDataFrame(rows, "news_id long, published_at string, scraped_at string, source string, zone string")
    return news, spark.createDataFrame(SOURCES, "source_name string, time_zone string, date_order string")


def test_every_form(tables):
    found = {(r.news_id, r.field_name): r.instant_us for r in news_instants(*tables).collect()}
    wrong = [(c, found.get((i, "published_at"))) for i, c in enumerate(CASES) if found.get((i, "published_at")) != c[2]]
    assert not wrong
    assert found[900, "scraped_at"] == us(2024, 7, 1, 12)
    assert (901, "published_at") not in found and (901, "scraped_at") not in found


def test_once_each_and_empty(tables):
    news, sources = tables
    assert news_instants(news, sources).groupBy("news_id", "field_name").count().where("count > 1").count() == 0
    assert news_instants(news.limit(0), sources).count() == 0
    assert news_instants(news, sources.limit(0)).where("field_name = 'scraped_at'").count() > 0
