"""Pacing and state: token buckets, backoff, schedules, bounded captures, and deduplication of streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rowloom.operators.dedupe import NOTHING, SeenKeys, in_order, matching

#: Bucket size and refill, schedule limits and capture limits (fixed values).
BURST, PER_SECOND = 10, 1.0
MOST_SCHEDULES, MIN_MINUTES = 20, 1
MOST_CAPTURES, MOST_CAPTURE_BYTES, FINISHED_RUNS = 5000, 32_000_000, 5


def grants(df: DataFrame, key: str = "host", ts: str = "ts", burst: int = BURST, per_second: float = PER_SECOND, order: str | None = None, span_s: int = 3600) -> DataFrame:
    """grant_time of each request: when its host's token bucket lets it go, requests waiting in order of time.

    The k-th token of a host is there at the time of some earlier request j plus what refilling takes from then, so
    grant_k = max over j <= k of ts_j + (k - j + 1 - burst) / rate, at least ts_k: a running maximum of ts_j - j / rate.
    Numbers and maxima run within spans of time; what comes before a span is its host's sums over earlier spans, so no
    task holds all requests of a host.
    """
    epoch = "TIMESTAMP_NTZ'1970-01-01 00:00:00'" if dict(df.dtypes)[ts] == "timestamp_ntz" else "TIMESTAMP'1970-01-01 00:00:00Z'"
    micros = F.expr(f"timestampdiff(MICROSECOND, {epoch}, `{ts}`)")
    step = int(1_000_000 / per_second)
    w = W.partitionBy("__key", "__span").orderBy(ts, *([order] if order else []))
    timed = df.withColumns({"__key": F.struct(F.col(key)), "__span": F.floor(micros / (span_s * 1_000_000))})
    ahead = timed.withColumn("__n", F.row_number().over(w)).withColumn("__base", micros - F.col("__n") * step)
    ahead = ahead.withColumn("__peak", F.max("__base").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    earlier = W.partitionBy("__key").orderBy("__span").rowsBetween(W.unboundedPreceding, -1)
    spans = ahead.groupBy("__key", "__span").agg(F.count(F.lit(1)).alias("__in"), F.max("__base").alias("__top"))
    spans = spans.withColumn("__before", F.coalesce(F.sum("__in").over(earlier), F.lit(0)))
    spans = spans.withColumn("__high", F.max(F.col("__top") - F.col("__before") * step).over(earlier)).drop("__in", "__top")
    all_ = ahead.join(spans, ["__key", "__span"])
    peak = F.greatest("__high", F.col("__peak") - F.col("__before") * step)
    granted = F.greatest(micros, peak + (F.col("__before") + F.col("__n") + 1 - burst) * step)
    waits = all_.withColumn("__wait", (granted - micros).cast("long"))
    return waits.withColumn("grant_time", F.expr(f"timestampadd(MICROSECOND, __wait, `{ts}`)")).select(*df.columns, "grant_time")


def backoff_ms(attempt: int, base_ms: int = 1000, max_ms: int = 60_000, jitter: float = 0.0) -> int:
    """The wait before attempt number `attempt` (from 0); jitter from -1 to 1 moves it by up to a fifth."""
    delay = min(base_ms * 2**attempt, max_ms)
    return max(0, int(delay + 0.2 * delay * jitter + 0.5))


def requests_per_hour(steps: int, min_ms: float, max_ms: float) -> int:
    return int(3_600_000 / ((min_ms + max_ms) / 2) * steps + 0.5)


def missed_windows(last_run_ms: Column, every_minutes: Column, now_ms: Column) -> Column:
    """Runs that a schedule should have had since its last but had not; none if it never ran."""
    period = F.greatest(F.lit(1), F.coalesce(every_minutes, F.lit(1))) * 60_000
    missed = F.floor((now_ms - last_run_ms) / period) - 1
    return F.when(F.coalesce(last_run_ms, F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(0), missed)).cast("long")


def normalise_schedule(given: dict) -> tuple[dict, str]:
    """A schedule that can run, and a note where it had to be changed."""
    from urllib.parse import urlsplit

    url = str(given.get("url") or "").strip()
    parts = urlsplit(url)
    if not parts.scheme or (parts.scheme in ("http", "https") and not parts.netloc):
        raise ValueError(f"{url!r} is no whole web address to run on a schedule")
    if parts.scheme not in ("http", "https"):
        raise ValueError(f"schedules open web pages; {parts.scheme}: is none")
    if not (given.get("pipeline") or {}).get("steps"):
        raise ValueError("nothing to run: the pipeline has no steps")
    try:
        every = float(given.get("everyMinutes"))
    except (TypeError, ValueError):
        every = 0.0
    note = "" if every >= MIN_MINUTES else f"raised to the shortest interval, {MIN_MINUTES} minute"
    return {"name": str(given.get("name") or "")[:80] or parts.hostname, "url": url, "everyMinutes": int(max(every, MIN_MINUTES) + 0.5), "enabled": given.get("enabled") is not False, "pipeline": given["pipeline"], "lastRunAt": given.get("lastRunAt")}, note


def add_schedule(known: list[dict], given: dict) -> tuple[list[dict], str]:
    """The schedules with one more (or a changed one of the same name), and a note; there is room for MOST_SCHEDULES."""
    made, note = normalise_schedule(given)
    others = [s for s in known if s["name"] != made["name"]]
    if len(others) >= MOST_SCHEDULES:
        raise ValueError(f"all {MOST_SCHEDULES} schedules are taken")
    return [*others, made], note


def due(schedules: DataFrame, running: DataFrame, now_ms: Column) -> DataFrame:
    """Of schedules (name, every_minutes, enabled, last_run_ms), those to run now, with the windows they missed (reported,
    not made up). One whose last run (running: name) has not ended is passed over."""
    period = F.greatest(F.lit(MIN_MINUTES), F.coalesce("every_minutes", F.lit(MIN_MINUTES))) * 60_000
    ready = F.coalesce(F.col("last_run_ms"), F.lit(0)) + period <= now_ms
    free = schedules.where(F.coalesce("enabled", F.lit(True)) & ready).join(running.select("name"), "name", "left_anti")
    return free.withColumn("missed", missed_windows(F.col("last_run_ms"), F.col("every_minutes"), now_ms))


def cap_captures(df: DataFrame, run: str, order: str, size: str, most: int = MOST_CAPTURES, most_bytes: int = MOST_CAPTURE_BYTES) -> DataFrame:
    """Captures that a run keeps: a capture that does not fit is skipped and uses up nothing, later ones may still fit.

    Runs that fit as a whole (found by aggregates) are not touched; only the others are replayed in order. Captures of no
    run (null) are one run, and those without a place in the order (null) come last.
    """
    totals = df.groupBy(run).agg(F.count(F.lit(1)).alias("__n"), F.sum(size).alias("__bytes"))
    over = totals.where((F.col("__n") > most) | (F.col("__bytes") > most_bytes)).select(run)

    def replay(batches):
        used, kept, at = 0, 0, NOTHING
        for b in batches:
            out = []
            for group, n in zip(b.column(run).to_pylist(), b.column(size).to_pylist(), strict=True):
                if group != at:
                    used, kept, at = 0, 0, group
                fits = kept < most and used + (n or 0) <= most_bytes
                used, kept = used + (n or 0) * fits, kept + fits
                out.append(bool(fits))
            yield b.filter(pa.array(out, pa.bool_()))

    full = in_order(matching(df, over, [run], "left_semi"), run, order, replay)
    return matching(df, over, [run], "left_anti").unionByName(full)


def last_runs(df: DataFrame, group: str, finished: str, most: int = FINISHED_RUNS) -> DataFrame:
    """The newest finished runs of each group."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(group).orderBy(F.col(finished).desc()))).where(F.col("__n") <= most).drop("__n")


# ---- streams --------------------------------------------------------------------------------------------------------


def dedupe_stream(stream: DataFrame, keys: list[str], event_time: str | None = None, within: str | None = None) -> DataFrame:
    """Keep-first over a stream; with an event time, state is forgotten once the watermark has passed by `within`."""
    if event_time and within:
        return stream.withWatermark(event_time, within).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def bounded_dedupe_stream(stream: DataFrame, key: str, partition: str, limit: int) -> DataFrame:
    """Keep-first with a memory of `limit` keys for each partition value, oldest forgotten first, in the stream's own order."""
    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory = SeenKeys(limit, state.get[0] if state.exists else ())
        for pdf in batches:
            yield pdf[[memory.add(k) for k in pdf[key]]]
        state.update((list(memory.keys),))

    return stream.groupBy(partition).applyInPandasWithState(update, stream.schema, "keys array<string>", "append", GroupStateTimeout.NoTimeout)


def append_stream(stream: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Write a stream as an append-only dataset; without a trigger it takes what is there and stops."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def event_counts(stream: DataFrame, event_time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts of each key in tumbling windows of event time; later rows than `late` are left out."""
    return stream.withWatermark(event_time, late).groupBy(F.window(event_time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
