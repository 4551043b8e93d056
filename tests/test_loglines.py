"""Problem 6: layouts, entries over several lines, resent and disordered lines."""

from datetime import UTC, datetime

import pytest

from candlery.operators import loglines

STORED = datetime(2024, 3, 1, 0, 0, 5)
US = int((STORED - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
LINES = [
    ("2024-02-01 10:28:51 - WebSocket - WARNING - [logger.py:110] - відсутні дані", "2024-02-01 10:28:51", "WARNING", "WebSocket"),
    ("2024-02-14 07:13:53,007 - INFO - ERROR - x", "2024-02-14 07:13:53", "ERROR", "INFO"),
    ("23.01.2024 22:13:34 | ІНФО | ARIMAModeler | m", "2024-01-23 22:13:34", "INFO", "ARIMAModeler"),
    ("[2024-01-15T04:46:52.131Z] [FATAL] [binance_client] m", "2024-01-15 04:46:52", "CRITICAL", "binance_client"),
    ("02/01/2024 02:49:27.354 INFO  [pool-3-thread-11] WebSocket - fetched", "2024-01-02 02:49:27", "INFO", "WebSocket"),
    ("2024-01-02 02:49:50.038 UTC [5525] INFO LOG:  m", "2024-01-02 02:49:50", "INFO", "INFO"),
    ("Feb 29 05:31:26 node6 DataCleaner[9741]: <error> m\r", "2024-02-29 05:31:26", "ERROR", "DataCleaner"),
    ("Dec 31 23:59:59 node6 DataCleaner[9741]: <warn> m", "2023-12-31 23:59:59", "WARNING", "DataCleaner"),
    ("E0117 08:02:44.695875 2065 BinanceClient.py:392] m", "2024-01-17 08:02:44", "ERROR", "BinanceClient.py"),
    ('ts=2024-01-14T02:27:57+03:00 msg="a level=error \\"b\\"" component=INFO level=warn', "2024-01-13 23:27:57", "WARNING", "INFO"),
    ('{"msg":"x","logger":"crypto_bot","lvl":"critical","time":1704854695.505}', "2024-01-10 02:44:55", "CRITICAL", "crypto_bot"),
]
FURTHER = ["Traceback (most recent call last):", "  File \"/srv/a.py\", line 1, in f", "2024-01-02  0.12  64.3", "{", '  "a": 1', "}", "\tSELECT 1", "", None, " 2024-02-01 10:28:51 - A - INFO - indented", "2024-13-45 10:28:51 - A - INFO - no date"]


@pytest.mark.parametrize(("line", "at", "level", "part"), LINES)
def test_headers(line, at, level, part):
    header, us, lv, component, _ = loglines.parse_line(line, US)
    assert header
    assert (datetime.fromtimestamp(us / 1e6, UTC).strftime("%Y-%m-%d %H:%M:%S"), lv, component) == (at, level, part)


@pytest.mark.parametrize("line", FURTHER)
def test_further_lines(line):
    assert not loglines.parse_line(line, US)[0]


SCHEMA = "id long, stream_id string, program string, line_no long, log_level string, message string, component string, stored_at timestamp_ntz, block string"


def logs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_entries(spark, monkeypatch):
    text = [LINES[0][0], *FURTHER[:3], LINES[1][0], FURTHER[6]]
    rows = [(i, "s1", "p", i + 2, "INFO", t, "guess", STORED, "x") for i, t in enumerate(text)]
    rows += [(100, "s1", "p", 2, None, text[0], None, datetime(2024, 5, 1), "x"), rows[2], (101, "s1", "p", 1, None, "no header yet", None, STORED, "x")]
    rows += [(200, "event_a", "p", 1, " Warning", "one\ntwo", " part ", STORED, "x"), (201, None, "p", 1, "INFO", text[0], None, STORED, "x"), (202, "s1", "p", None, None, text[0], None, STORED, "x")]
    expected = {("s1", 2, 4, "2024-02-01 10:28:51", "WARNING", "WebSocket"), ("s1", 6, 2, "2024-02-14 07:13:53", "ERROR", "INFO"), ("event_a", 1, 1, "2024-03-01 00:00:05", "WARNING", "part")}
    for size in (8192, 2):
        monkeypatch.setattr(loglines, "BLOCK_LINES", size)
        out = loglines.log_entries(logs(spark, rows[::-1])).collect()
        assert {tuple(r)[:6] for r in out} == expected
    first = next(r for r in out if r.line_no == 2)
    assert first.message == "\n".join(["відсутні дані", *FURTHER[:3]])


def test_empty(spark):
    assert loglines.log_entries(logs(spark, [])).count() == 0
    assert loglines.log_entries(logs(spark, [(None,) * 9])).count() == 0
