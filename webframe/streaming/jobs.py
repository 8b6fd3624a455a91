"""Streaming versions of the capture and item jobs.

Arrival order has no meaning across partitions, so time bounds (watermarks)
take the place of "oldest falls out"; rows later than the watermark are dropped
by Structured Streaming. Where an exact count bound is wanted, use the
``foreachBatch`` writer of the sinks module.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webframe.functions import text as T
from webframe.operators.extract import extract_dom, finish_rows, node_columns, node_tags
from webframe.operators.items import GROW_HEIGHT, GROW_NODES
from webframe.operators.rules import Rule
from webframe.sources.nodes import html_nodes


def stream_correlate(requests: DataFrame, ends: DataFrame, delay: str = "10 minutes", within: str = "5 minutes") -> DataFrame:
    """Requests with their end; those without one are emitted after the watermark, end columns NULL.

    ``requests``: id, ts, ...; ``ends``: id, end_ts, status, failed.
    """
    r = requests.withWatermark("ts", delay)
    e = ends.select(F.col("id").alias("end_id"), "end_ts", "status", "failed").withWatermark("end_ts", delay)
    on = (F.col("id") == F.col("end_id")) & (F.col("end_ts") >= F.col("ts")) & (F.col("end_ts") <= F.col("ts") + F.expr(f"interval {within}"))
    out = r.join(e, on, "left_outer").drop("end_id")
    micros = F.unix_micros(F.col("end_ts")) - F.unix_micros(F.col("ts"))
    return out.withColumn("duration_ms", F.round(micros / 1000.0, 2))


def stream_dedupe(items: DataFrame, cols: Sequence[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each content once within the watermark; state grows with the distinct hashes of that time."""
    hashed = items.withColumn("content_hash", T.stable_hash(*cols))
    return hashed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["content_hash"])


def stats_by_window(captures: DataFrame, ts: str = "ts", window: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Totals per time window and MIME type; the same plan serves batch and stream."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    mime = F.coalesce(F.nullif("mime_type", F.lit("")), F.lit("unknown")).alias("mime")
    return captures.groupBy(w.alias("w"), mime).agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce(F.col("failed"), F.lit(False))).alias("failed"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "mime", "total", "failed")


def stream_stats(captures: DataFrame, ts: str = "ts", window: str = "10 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    return stats_by_window(captures.withWatermark(ts, delay), ts, window, slide)


def idle_ms(text: str) -> int:
    """Milliseconds of "3 hours", "10 minutes" and the like."""
    n, unit = text.split()
    return int(float(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.removesuffix("s")])


_GROWTH_OUT = "page_id bigint, rounds int, reason string, grew boolean, height_gain int, node_gain int"
_GROWTH_STATE = "h0 int, n0 int, h1 int, n1 int, step int, round int, flat int, grew boolean, done boolean, held string"


def stream_growth_stop(series: DataFrame, max_rounds: int = 8, page: str = "page_id", idle: str | None = "24 hours") -> DataFrame:
    """Stop decision per page as soon as it can be made.

    State per page is one row of counters and the rounds that came before their turn,
    which wait until those before them are there; round 0 is the state before. Rounds
    after ``max_rounds`` decide nothing and are left out, so a page has a few rows. A page
    that sends nothing for ``idle`` is forgotten, so the state does not grow for ever.
    Timers keep a stream going that has read all there is; without ``idle`` it ends.
    """
    forget = None if idle is None else idle_ms(idle)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = list(state.get) if state.exists else [0, 0, 0, 0, 0, -1, 0, False, False, "{}"]
        held = {int(k): v for k, v in json.loads(s[9]).items()}
        if not s[8]:
            for rows in batches:
                held.update({int(r.round): (int(r.height), int(r.nodes)) for r in rows.itertuples(index=False) if r.round > s[5]})
        while not s[8] and s[5] + 1 in held:
            k = s[5] + 1
            h, n = held.pop(k)
            if k == 0:
                s[:9] = [h, n, h, n, 0, 0, 0, False, False]
                continue
            jump = h - s[2]
            grown = jump > GROW_HEIGHT or n - s[3] > GROW_NODES
            s[2:8] = [h, n, jump, k, 0 if grown else s[6] + 1, s[7] or grown]
            reason = None
            if s[6] >= 2:
                reason = "settled"
            elif k >= max_rounds:
                reason = "infinite" if k >= 3 and jump > GROW_HEIGHT else "max_rounds"
            if reason:
                s[8] = True
                yield pd.DataFrame(
                    {"page_id": [key[0]], "rounds": [k], "reason": [reason], "grew": [s[7]],
                     "height_gain": [max(0, h - s[0])], "node_gain": [max(0, n - s[1])]}
                )
        s[9] = "{}" if s[8] else json.dumps(held)
        state.update(tuple(s))
        if forget is not None:
            state.setTimeoutDuration(forget)

    told = series.where(F.col("round") <= max_rounds)  # the last round that counts decides at the latest
    return told.groupBy(page).applyInPandasWithState(
        step, _GROWTH_OUT, _GROWTH_STATE, "append", GroupStateTimeout.NoTimeout if forget is None else GroupStateTimeout.ProcessingTimeTimeout
    )


def extract_batch(rule: Rule, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: extraction closes within a page, so each batch is complete."""

    def run(pages: DataFrame, epoch: int) -> None:
        nodes = html_nodes(pages, node_columns(rule), node_tags(rule), carry=("url",))
        write(finish_rows(extract_dom(nodes, rule, ("url",)), rule), epoch)

    return run
