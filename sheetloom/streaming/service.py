"""Service metrics, breaker states and dirty rectangles, over batches and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graphs, spatial


def request_metrics(events: DataFrame, ts: str, value: str, kind: str) -> DataFrame:
    """(hour, kind, n, lo, hi, mean, p50, p99) of each hour; exact linear percentiles."""
    r = lambda c, n: F.round(c, 6).alias(n)
    return events.groupBy(F.date_trunc("hour", ts).alias("hour"), kind).agg(F.count("*").alias("n"), r(F.min(value), "lo"), r(F.max(value), "hi"), r(F.avg(value), "mean"), r(F.percentile(value, 0.5), "p50"), r(F.percentile(value, 0.99), "p99"))


def windowed_metrics(events: DataFrame, ts: str, value: str, kind: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The same as a stream: event-time windows with a watermark, sums and sketches only."""
    w = F.window(ts, window)
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return events.withWatermark(ts, late).groupBy(w.alias("w"), kind).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"), F.percentile_approx(value, 0.99, 10000).alias("p99")).select("w.start", "w.end", kind, "n", "lo", "hi", "mean", "p99")


class Breaker:
    """closed until limit failures in a row; open for rest seconds; half-open until the next call decides."""

    def __init__(self, limit: int, rest: float, state: str = "closed", failures: int = 0, since: float = 0.0) -> None:
        self.limit, self.rest, self.state, self.failures, self.since = limit, rest, state, failures, since

    def see(self, at: float, failed: bool) -> str:
        if self.state == "open" and at - self.since >= self.rest:
            self.state = "half_open"
        if self.state == "open":
            return self.state
        if failed:
            self.failures += 1
            if self.state == "half_open" or self.failures >= self.limit:
                self.state, self.since, self.failures = "open", at, 0
        else:
            self.state, self.failures = "closed", 0
        return self.state


def breaker_states(events: DataFrame, key: str, order: list[str], limit: int, rest: float) -> DataFrame:
    """(key, time, state) after each event of a key, in order; events has failed. A key's events stream by with
    one small state, sorted by Spark, so that a key of any size fits."""
    fields = [f"`{key}` {events.schema[key].dataType.simpleString()}", "time double", "state string"]

    def work(frames):
        now, breaker = None, None
        for pdf in frames:
            out = []
            for k, at, failed in zip(pdf["k"], pdf["at"], pdf["failed"], strict=True):
                if breaker is None or k != now:
                    now, breaker = k, Breaker(limit, rest)
                out.append((k, at, breaker.see(at, bool(failed))))
            yield pd.DataFrame(out, columns=[key, "time", "state"])

    time = F.unix_micros(F.col(order[0]).cast("timestamp")) / 1e6
    rows = events.select(F.col(key).alias("k"), time.alias("at"), F.coalesce("failed", F.lit(False)).alias("failed"), *(F.col(o).alias(f"o{i}") for i, o in enumerate(order)))
    return rows.repartition("k").sortWithinPartitions("k", *(f"o{i}" for i in range(len(order)))).mapInPandas(work, ", ".join(fields))


def breaker_stream(events: DataFrame, key: str, ts: str, limit: int, rest: float) -> DataFrame:
    """The breaker as a stateful stream: one row (key, time, state) per event, the state kept between batches."""
    schema = f"`{key}` {events.schema[key].dataType.simpleString()}, time double, state string"

    def step(k, frames, state):
        breaker = Breaker(limit, rest, *state.get) if state.exists else Breaker(limit, rest)
        for pdf in frames:
            out = [(k[0], at, breaker.see(at, bool(f))) for at, f in sorted(zip(pdf["at"], pdf["failed"], strict=True))]
            yield pd.DataFrame(out, columns=[key, "time", "state"])
        state.update((breaker.state, breaker.failures, breaker.since))

    rows = events.select(key, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at"), "failed")
    return rows.groupBy(key).applyInPandasWithState(step, schema, "state string, failures int, since double", "append", "NoTimeout")


def merged_dirty_boxes(boxes: DataFrame, page: str = "page", most: int | None = None) -> DataFrame:
    """(page, component, x0, y0, x1, y1, n): envelopes of a page's boxes that touch each other, directly or by steps.

    A page with more than most envelopes is given as one."""
    b = boxes.select(F.col(page).alias("page"), "id", "x0", "y0", "x1", "y1")
    edges = spatial.overlap_pairs(b, b).filter("page = r_page and id < r_id").select(F.col("id").alias("a"), F.col("r_id").alias("b"))
    comps = graphs.components(edges)
    named = b.join(comps, b["id"] == comps["node"], "left").withColumn("component", F.coalesce("component", "id"))
    merge = lambda df, n: df.groupBy("page", "component").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum(n).alias("n"))
    out = merge(named, F.lit(1))
    if most is not None:
        count = out.groupBy("page").agg(F.count("*").alias("parts"), F.min("component").alias("first"))
        many = out.join(count, "page").withColumn("component", F.when(F.col("parts") > most, F.col("first")).otherwise(F.col("component")))
        out = merge(many, F.col("n"))
    return out.withColumnRenamed("page", page)
