"""Window expressions as SQL text, valid in Spark SQL and (after a few renames) in DuckDB, for staged feature plans.

Ratios divide by nullif(x, 0), logarithms take nullif(greatest(x, 0), 0): null instead of an error or an infinity.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

W = "partition by symbol order by open_time"
WC = f"({W} rows between unbounded preceding and current row)"
WP = "(partition by symbol)"
#: Decimals that doubles are rounded to in results that are compared across engines.
DIGITS = 6


def frame(n: int, end: int = 0) -> str:
    """The n rows that end ``end`` rows before the current one."""
    last = "current row" if end == 0 else f"{end} preceding"
    return f"({W} rows between {n - 1 + end} preceding and {last})"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) over ({W})"


def lead(x: str, k: int = 1) -> str:
    return f"lead({x}, {k}) over ({W})"


def ratio(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def log(x: str) -> str:
    return f"ln(nullif(greatest({x}, 0), 0))"


def roll(fn: str, x: str, n: int, least: int | None = None) -> str:
    """fn over the last n rows, null until ``least`` (default n) of them have a value."""
    least = n if least is None else least
    call = f"percentile({x}, {fn[1:]})" if fn.startswith("q0") else f"{fn}({x})"
    value = f"{call} over {frame(n)}"
    return value if least <= 1 and fn not in ("skewness", "kurtosis") else f"case when count({x}) over {frame(n)} >= {least} then {value} end"


def duck(text: str) -> str:
    """The few functions that DuckDB names otherwise."""
    text = re.sub(r"\bpercentile\(", "quantile_cont(", text)
    text = re.sub(r"\b(last_value|first_value)\(([^()]*|[^()]*\([^()]*\)[^()]*)\) ignore nulls", r"\1(\2 ignore nulls)", text)
    text = re.sub(r"\bweekday\(([^()]*)\)", r"(isodow(\1) - 1)", text)
    text = re.sub(r"\bseconds_between\(", "date_diff('second', ", text)
    return re.sub(r"\bdays_between\(", "date_diff('day', ", text)


def spark_text(text: str) -> str:
    text = re.sub(r"\bseconds_between\(", "timestampdiff(SECOND, ", text)
    return re.sub(r"\bdays_between\(", "timestampdiff(DAY, ", text)


@dataclass
class Features:
    """Columns computed in stages over an ordered table; a stage may use the columns of those before it.

    A value is SQL text, or a pair (Spark, DuckDB) where they differ. Names in ``whole`` are integers, the rest doubles.
    """

    stages: list[dict]
    whole: set[str] = field(default_factory=set)
    where: str = ""
    keys: tuple[str, ...] = ("symbol", "open_time")
    hidden: set[str] = field(default_factory=set)

    def apply(self, df: DataFrame, by: tuple[str, ...] = ("symbol",), keep: tuple[str, ...] = ()) -> DataFrame:
        """The plan over series told apart by the columns ``by``; columns of the input named in ``keep`` come along."""
        df = self.stacked(df, by)
        return df.selectExpr(*by, *[k for k in self.keys if k != "symbol"], *keep, *self._outputs("try_cast"))

    def apply_blocked(self, bars: DataFrame, reach: int) -> DataFrame:
        """The plan over bars with feed_id, tf and per, in time blocks: no task holds a series. ``reach`` is how many bars
        before or after a bar its columns may look at; plans that carry values along a whole series have none."""
        from candlery.operators.bars import SERIES, edged_blocks

        rows = self.stacked(edged_blocks(bars, reach, "close"), (*SERIES, "blk")).where("own")
        return rows.selectExpr(*SERIES, *[k for k in self.keys if k != "symbol"], *self._outputs("try_cast"))

    def stacked(self, df: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
        """The input with the columns of all stages, hidden ones too."""
        series = f"partition by {', '.join(by)}"
        for stage in self.stages:
            texts = {name: spark_text(x if isinstance(x, str) else x[0]) for name, x in stage.items()}
            df = df.selectExpr("*", *[f"{x.replace('partition by symbol', series)} as {name}" for name, x in texts.items()])
        return df.where(spark_text(self.where)) if self.where else df

    def sql(self, base: str) -> str:
        parts, last = [f"s0 as ({base})"], "s0"
        for i, stage in enumerate(self.stages, 1):
            columns = ", ".join(f"{duck(x if isinstance(x, str) else x[1])} as {name}" for name, x in stage.items())
            parts.append(f"s{i} as (select *, {columns} from {last})")
            last = f"s{i}"
        where = f" where {duck(self.where)}" if self.where else ""
        return f"with {', '.join(parts)} select {', '.join([*self.keys, *self._outputs('cast')])} from {last}{where}"

    def _outputs(self, cast: str) -> list[str]:
        names = [n for stage in self.stages for n in stage if n not in self.hidden]
        return [f"cast({n} as bigint) as {n}" if n in self.whole else f"round(cast({n} as double), {DIGITS}) as {n}" for n in names]
