"""Log lines of unlike programs into whole entries with time, level, component and message (problem 6)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlery.functions.timeaxis import floor_div, micros, utc_text
from candlery.session import ensure_checkpoint_dir

# Spellings of the levels in two languages.
LEVELS = {
    "DEBUG": "debug dbg trace d налагодження",
    "INFO": "info inf information notice log i інфо інформація",
    "WARNING": "warning warn wrn w попередження увага",
    "ERROR": "error err e помилка",
    "CRITICAL": "critical crit fatal panic f c emerg alert критично критична",
}
LEVEL_OF = {word: level for level, words in LEVELS.items() for word in words.split()}
# English month abbreviations of syslog.
SYSLOG_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()

WORDS = "|".join(sorted((w for w in LEVEL_OF if len(w) > 2), key=len, reverse=True))
LEVEL = rf"(?P<level>(?i:{WORDS}))"
ISO = r"(?P<y>\d{4})-(?P<mo>\d\d)-(?P<d>\d\d)[T ](?P<h>\d\d):(?P<mi>\d\d):(?P<s>\d\d)(?:[.,]\d+)?"
DMY = r"(?P<d>\d\d)(?P<sep>[./])(?P<mo>\d\d)(?P=sep)(?P<y>\d{4}) (?P<h>\d\d):(?P<mi>\d\d):(?P<s>\d\d)(?:[.,]\d+)?"
ZONE = r"\s?(?P<zone>Z|UTC|GMT|[+-]\d\d:?\d\d)?"
PART = r"(?P<part>\S(?:.*?\S)??)"
#: Lines in one block of a stream; a block, never a whole stream, is what one task orders.
BLOCK_LINES = 8_192


def _dashed(prefix: str) -> str:
    return rf"^{prefix}{ZONE} - \s*{PART}\s* - \s*{LEVEL}\s* - (?:\[(?P<file>[^\]:]+):\d+\] - )?(?P<msg>.*)"


# layout -> (literal anchors, of which one must be in the line; the anchored expression that verifies and extracts)
LAYOUTS = {
    "dashed": ([" - "], _dashed(ISO)),
    "dashed_dmy": ([" - "], _dashed(DMY)),
    "piped": ([" | ", "|"], rf"^(?:{ISO}|{DMY.replace('?P<', '?P<b_').replace('?P=sep', '?P=b_sep')}){ZONE}\s*\|\s*{LEVEL}\s*\|\s*{PART}\s*\|\s?(?P<msg>.*)"),
    "bracketed": (["] ["], rf"^\[{ISO}{ZONE}\]\s*\[\s*{LEVEL}\s*\]\s*\[\s*{PART}\s*\]\s?(?P<msg>.*)"),
    "threaded": (["] "], rf"^(?:{ISO}|{DMY.replace('?P<', '?P<b_').replace('?P=sep', '?P=b_sep')}){ZONE}\s+{LEVEL}\s+\[[^\]]*\]\s+{PART}\s+-(?: (?P<msg>.*)|$)"),
    "server": (["] "], rf"^{ISO}{ZONE} \[\d+\] \s*{PART}\s+{LEVEL}:(?P<msg>.*)"),
    "syslog": ([": <", "]: "], rf"^(?P<mon>[A-Z][a-z]{{2}}) +(?P<d>\d{{1,2}}) (?P<h>\d\d):(?P<mi>\d\d):(?P<s>\d\d)(?:\.\d+)? \S+ {PART}(?:\[\d+\])?: <{LEVEL}>(?P<msg>.*)"),
    "glog": (["] "], r"^(?P<letter>[DIWEFC])(?P<mo>\d\d)(?P<d>\d\d) (?P<h>\d\d):(?P<mi>\d\d):(?P<s>\d\d)(?:\.\d+)? +\d+ (?P<file>[^\s:\]]+):\d+\](?P<msg>.*)"),
    "logfmt": (["ts=", "time="], None),
    "json": (['{"', "{ "], None),
}
LOGFMT = re.compile(r'([A-Za-z_][\w.]*)=("(?:[^"\\]|\\.)*"|\S*)')
FIELDS = T.StructType(
    [T.StructField("header", T.BooleanType()), T.StructField("at_us", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("level", "component", "text")]
)


@cache
def _router():
    """The automaton of all anchors, and the verifier of each layout. One is built in each Python worker."""
    import ahocorasick

    automaton, by_anchor = ahocorasick.Automaton(), {}
    for layout, (anchors, _) in LAYOUTS.items():
        for anchor in anchors:
            by_anchor.setdefault(anchor, []).append(layout)
    for anchor, layouts in by_anchor.items():
        automaton.add_word(anchor, layouts)
    automaton.make_automaton()
    return automaton, {layout: re.compile(pattern, re.DOTALL) for layout, (_, pattern) in LAYOUTS.items() if pattern}


def _offset(zone: str | None) -> int | None:
    """Seconds east of UTC of Z, +02:00, +0200 or nothing; None if the text is no zone."""
    if not zone or zone in ("Z", "z", "UTC", "GMT"):
        return 0
    m = re.fullmatch(r"([+-])(\d\d):?(\d\d)", zone)
    return (1 if m[1] == "+" else -1) * (int(m[2]) * 3600 + int(m[3]) * 60) if m else None


def _utc_us(y: int, mo: int, d: int, h: int, mi: int, s: int, zone: str | None = None) -> int | None:
    offset = _offset(zone)
    try:
        at = datetime(y, mo, d, h, mi, s, tzinfo=UTC)
    except ValueError:
        return None
    return None if offset is None else (int(at.timestamp()) - offset) * 1_000_000


def _latest_year(mo: int, d: int, h: int, mi: int, s: int, stored_us: int | None) -> int | None:
    """The latest instant of a date without year that is not after stored_us."""
    if stored_us is None:
        return None
    year = (datetime(1970, 1, 1) + timedelta(microseconds=stored_us)).year
    for y in range(year, year - 9, -1):  # eight years reach the last 29 February
        at = _utc_us(y, mo, d, h, mi, s)
        if at is not None and at <= stored_us:
            return at
    return None


def _text_us(text: object) -> int | None:
    if isinstance(text, int | float) and not isinstance(text, bool):
        return int(text * 1_000_000) // 1_000_000 * 1_000_000 if abs(text) < 1e11 else int(text) // 1000 * 1_000_000
    m = re.fullmatch(ISO + ZONE, str(text).strip())
    if m:
        return _utc_us(*(int(m[k]) for k in ("y", "mo", "d", "h", "mi", "s")), m["zone"])
    return int(float(text)) * 1_000_000 if re.fullmatch(r"\d{9,10}(\.\d+)?", str(text).strip()) else None


def _keyed(pairs: dict) -> tuple | None:
    """An entry from named values (JSON or key=value), whatever the order of the keys."""
    pick = lambda *names: next((pairs[n] for n in names if pairs.get(n) is not None), None)
    at, level = pick("time", "ts", "timestamp", "@timestamp", "datetime"), pick("lvl", "level", "levelname", "severity")
    level = LEVEL_OF.get(str(level).strip().lower()) if level is not None else None
    at_us = _text_us(at) if at is not None else None
    if level is None or at_us is None:
        return None
    part = pick("logger", "component", "name", "module", "file", "filename")
    return at_us, level, None if part is None else str(part).strip() or None, str(pick("msg", "message") or "")


def _verify(layout: str, pattern: re.Pattern | None, line: str, stored_us: int | None) -> tuple | None:
    if layout == "json":
        if not line.startswith("{"):
            return None
        try:
            found = json.loads(line)
        except ValueError:
            return None
        return _keyed(found) if isinstance(found, dict) else None
    if layout == "logfmt":
        if not line.startswith(("ts=", "time=")):
            return None
        return _keyed({k: v[1:-1].replace('\\"', '"') if v[:1] == '"' else v for k, v in LOGFMT.findall(line)})
    m = pattern.match(line)
    if not m:
        return None
    g = m.groupdict()
    level = LEVEL_OF.get((g.get("level") or g.get("letter") or "").lower())
    h, mi, s = (int(g.get(k) or g.get("b_" + k)) for k in ("h", "mi", "s"))
    if g.get("y") or g.get("b_y"):
        at = _utc_us(*(int(g.get(k) or g.get("b_" + k)) for k in ("y", "mo", "d")), h, mi, s, g.get("zone"))
    else:
        month = SYSLOG_MONTHS.index(g["mon"]) + 1 if g.get("mon") in SYSLOG_MONTHS else int(g.get("mo") or 0)
        at = _latest_year(month, int(g["d"]), h, mi, s, stored_us) if month else None
    part = (g.get("part") or g.get("file") or "").strip()
    return None if at is None or level is None else (at, level, part or None, (g.get("msg") or "").strip())


def parse_line(line: str | None, stored_us: int | None) -> tuple:
    """(header, time in µs, level, component, message text) of one line; header is false for a further line."""
    if not line or line[0].isspace():
        return False, None, None, None, line
    automaton, patterns = _router()
    bare = line.rstrip("\r\n")
    tried = set()
    for _, layouts in automaton.iter(bare):
        for layout in layouts:
            if layout not in tried:
                tried.add(layout)
                if (found := _verify(layout, patterns.get(layout), bare, stored_us)) is not None:
                    return True, *found
        if len(tried) == len(LAYOUTS):
            break
    return False, None, None, None, line


@F.pandas_udf(FIELDS)
def _parsed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    names = FIELDS.fieldNames()
    for lines, stored in batches:
        times = [None if pd.isna(x) else int(x) for x in stored]
        out = pd.DataFrame([parse_line(a, b) for a, b in zip(lines, times, strict=True)], columns=names)
        out["at_us"] = out["at_us"].astype("Int64")
        yield out


def level_name(text: Column) -> Column:
    """One of DEBUG, INFO, WARNING, ERROR, CRITICAL; null for an unknown spelling."""
    word, found = F.lower(F.trim(text)), F.lit(None).cast("string")
    for level, words in LEVELS.items():
        found = F.when(word.isin(*words.split()), F.lit(level)).otherwise(found)
    return found


def parsed_lines(logs: DataFrame) -> DataFrame:
    """Every line of every stream once: stream_id, line_no, block, head (line_no if it begins an entry) and its fields.

    Of repeated or resent lines the one stored first counts. Rows without stream or line number have no place in a file
    and are left out.
    """
    lines = logs.select("stream_id", "line_no", "log_level", "component", "message", "id", micros(logs, "stored_at").alias("stored_us")).where(
        "stream_id is not null and line_no is not null"
    )
    first = F.min(F.struct(F.col("stored_us").isNull().alias("late"), "stored_us", "id", "message", "log_level", "component"))
    lines = lines.groupBy("stream_id", "line_no").agg(first.alias("x")).select("stream_id", "line_no", "x.stored_us", "x.message", "x.log_level", "x.component")
    whole = F.col("stream_id").startswith("event_")
    # rows written whole need no parser
    parsed = lines.withColumn("p", _parsed(F.when(~whole, F.col("message")), F.col("stored_us")))
    return parsed.select(
        "stream_id",
        "line_no",
        floor_div(F.col("line_no"), BLOCK_LINES).alias("block"),
        F.when(whole | F.col("p.header"), F.col("line_no")).alias("head"),
        F.when(whole, F.col("stored_us")).otherwise(F.col("p.at_us")).alias("at_us"),
        F.when(whole, level_name(F.col("log_level"))).otherwise(F.col("p.level")).alias("log_level"),
        F.when(whole, F.trim("component")).otherwise(F.col("p.component")).alias("component"),
        F.coalesce(F.when(whole, F.col("message")).otherwise(F.col("p.text")), F.lit("")).alias("text"),
    )


def log_entries(logs: DataFrame, with_message: bool = True) -> DataFrame:
    """stream_id, line_no, n_lines, logged_at, log_level, component and, if asked for, message: one row per entry.

    The message is the text after the header and all further lines, joined by line feeds. Lines before the first header
    of a stream belong to no entry and are left out. Lines are parsed once, ordered in blocks of a stream and joined to
    the last header of their block; what stands before the first header of a block is one row, which goes to the last
    header of an earlier block. So one stream may hold any share of all rows. Blocks are cut off by a checkpoint in the
    shared folder.
    """
    ensure_checkpoint_dir(logs.sparkSession)
    inside = Window.partitionBy("stream_id", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = parsed_lines(logs).withColumn("first_line", F.last("head", ignorenulls=True).over(inside))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("message")
    # grouped where the blocks lie
    parts = lines.groupBy("stream_id", "block", "first_line").agg(
        F.count("*").alias("n_lines"), F.max("at_us").alias("at_us"), F.max("log_level").alias("log_level"), F.max("component").alias("component"), *[texts] * with_message
    )
    parts = parts.checkpoint()
    ahead = Window.partitionBy("stream_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.groupBy("stream_id", "block").agg(F.max("first_line").alias("head")).select("stream_id", "block", F.last("head", ignorenulls=True).over(ahead).alias("carried"))
    orphans = parts.where("first_line is null").drop("first_line").join(carried, ["stream_id", "block"]).withColumnRenamed("carried", "first_line")
    whole = parts.where("first_line is not null").unionByName(orphans.where("first_line is not null"))
    message = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "message"))), lambda x: x["message"]), "\n").alias("message") if with_message else None
    entries = whole.groupBy("stream_id", "first_line").agg(
        F.sum("n_lines").alias("n_lines"), F.max("at_us").alias("at_us"), F.max("log_level").alias("log_level"), F.max("component").alias("component"), *[message] * with_message
    )
    return entries.select(
        "stream_id", F.col("first_line").alias("line_no"), "n_lines", utc_text(F.col("at_us")).alias("logged_at"), "log_level", "component", *["message"] * with_message
    )
