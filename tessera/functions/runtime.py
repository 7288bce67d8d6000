"""Run timing as column functions: durations, timestamps, elapsed time, paths."""

from __future__ import annotations

import atexit
import sys
import time
from datetime import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINUTE, HOUR = 60_000_000, 3_600_000_000


def _two(c: Column) -> Column:
    text = c.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def format_elapsed(micros: Column) -> Column:
    """`HH h MM min SS.SS sec` of microseconds; no hours below one. Seconds round half up, after the split, without a carry."""
    rest = F.pmod(micros, F.lit(HOUR))
    hours, minutes = ((micros - rest) / HOUR).cast("long"), F.floor(rest / MINUTE).cast("long")
    cents = F.floor((F.pmod(rest, F.lit(MINUTE)) + 5000) / 10_000).cast("long")
    short = F.concat(_two(minutes), F.lit(" min "), _two(F.floor(cents / 100)), F.lit("."), _two(F.pmod(cents, F.lit(100))), F.lit(" sec"))
    return F.when(hours > 0, F.concat(_two(hours), F.lit(" h "), short)).otherwise(short)


def format_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def elapsed(start: Column, end: Column) -> Column:
    """Whole microseconds between two timestamps."""
    return F.timestamp_diff("MICROSECOND", start, end)


def script_path(argv0: Column) -> Column:
    """Null for a missing or empty name."""
    return F.when(argv0 != "", argv0)


def is_inside(path: Column, root: str) -> Column:
    """Whether a path is root or below it, by whole components; null is false."""
    root = root.rstrip("/")
    return F.coalesce((path == root) | path.startswith(root + "/"), F.lit(False))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def run_report(runs: DataFrame, script: str = "script", ts: str = "ts", root: str | None = None) -> DataFrame:
    """script, started, finished, total for each run, from its first and last event; with a root, of scripts inside only."""
    named = runs.select(script_path(F.col(script)).alias("script"), F.col(ts).alias("ts"))
    if root is not None:
        named = named.filter(is_inside(F.col("script"), root))
    ends = named.groupBy("script").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return ends.select(base_name(F.col("script")).alias("script"), format_timestamp(F.col("a")).alias("started"), format_timestamp(F.col("b")).alias("finished"), format_elapsed(elapsed(F.col("a"), F.col("b"))).alias("total"))


def resolved(argv: list[str]) -> Path | None:
    """The absolute path of the running script; None if there is no name or it can't be resolved."""
    try:
        return Path(argv[0]).resolve() if argv and argv[0] else None
    except (OSError, RuntimeError, ValueError):
        return None


class RunTimer:
    """Reports a driver program's run time when the program ends, if its script is inside root."""

    def __init__(self, root: str, argv: list[str] | None = None, out=print):
        self.root, self.out, self.began, self.clock = Path(root).resolve(), out, datetime.now(), time.perf_counter()
        self.script = resolved(sys.argv if argv is None else argv)

    def inside(self) -> bool:
        return self.script is not None and self.script.is_relative_to(self.root)

    def report(self) -> None:
        if self.inside():
            us = round((time.perf_counter() - self.clock) * 1e6)
            cents = (us % MINUTE + 5000) // 10_000
            total = f"{us // HOUR:02d} h " * (us >= HOUR) + f"{us % HOUR // MINUTE:02d} min {cents // 100:02d}.{cents % 100:02d} sec"
            rule = "=" * 80
            self.out(f"\n{rule}\nGLOBAL EXECUTION TIME\n{rule}\nScript: {self.script.name}\nStarted: {self.began:%Y-%m-%d %H:%M:%S}\nFinished: {datetime.now():%Y-%m-%d %H:%M:%S}\nTotal execution time: {total}\n{rule}")

    def at_exit(self) -> RunTimer:
        atexit.register(self.report)
        return self
