"""Outbox, reading quota and rate limit, over tables and over streams. Time is always a column or a parameter."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BATCH, MOST_ATTEMPTS, ERROR_CHARS = 20, 3, 2000


def claim(outbox: DataFrame, batch: int = BATCH, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """The oldest pending rows (created, id) below the cap of attempts, with an attempt more. One writer at a time calls this."""
    ready = outbox.filter((F.col("status") == "PENDING") & (F.col("attempts") < most_attempts))
    return ready.orderBy("created", "id").limit(batch).withColumn("attempts", F.col("attempts") + 1)


def drained(claimed: DataFrame, sent: Column, error: Column, has_parent: Column, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """Claimed rows after sending: FAILED without a parent, SENT, or FAILED once attempts are used up, else PENDING with the error."""
    status = F.when(~has_parent, "FAILED").when(sent, "SENT").when(F.col("attempts") >= most_attempts, "FAILED").otherwise("PENDING")
    return claimed.withColumn("status", status).withColumn("error", F.when(~sent | ~has_parent, F.substring(F.when(~has_parent, F.lit("no notification")).otherwise(error), 1, ERROR_CHARS)))


def fan_out(published: DataFrame, users: DataFrame, author: str = "author", slice_rows: int = 50_000, task_mails: int = 20_000_000) -> DataFrame:
    """article, user_id: each first publication for every active user who wants mail, but its author.

    One row for each mail is what is asked for, so the rows are the product of both tables. Publications are counted first and broadcast in slices of about ``slice_rows``, so what a task holds is
    bounded however many there are; the ids of users are dealt out, once a slice, so that a task makes about ``task_mails`` mails, whatever files the users come in.
    """
    wanted, own = users.filter("active AND wants_mail").select("user_id"), published.select("article", author)
    articles = own.count()
    slices = -(-articles // slice_rows)
    mails = wanted.count() * -(-articles // max(1, slices))
    wanted = wanted.repartition(max(1, -(-mails // task_mails)))
    parts = [own.filter(F.pmod(F.xxhash64("article"), F.lit(slices)) == k) if slices > 1 else own for k in range(max(1, slices))]
    out = [wanted.join(F.broadcast(part), F.col("user_id") != F.col(author)).select("article", "user_id") for part in parts]
    return reduce(DataFrame.unionByName, out)


def quota(reads: DataFrame, limit: int) -> DataFrame:
    """guest, article, first_read, allowed: the first so many different articles of a guest are free, and stay so. 0 lifts the limit.
    Repeated reads are gone before the window, which then holds a guest's different articles only."""
    first = reads.groupBy("guest", "article").agg(F.min("at").alias("first_read"))
    place = F.row_number().over(Window.partitionBy("guest").orderBy("first_read", "article"))
    return first.withColumn("allowed", F.lit(True) if limit == 0 else place <= limit)


def _limited(times: list[int], start: int | None, count: int, window: int, most: int) -> tuple[list[bool], int | None, int]:
    out = []
    for t in times:
        if start is None or t - start >= window:
            start, count = t, 0
        count += 1
        out.append(count <= most)
    return out, start, count


def limited(hits: DataFrame, window_us: int, most: int) -> DataFrame:
    """key, id, at (microseconds), allowed: a window opens with the first hit of a key and lasts so long; the first so many hits in it pass.

    Windows depend on the hits before them, so a key's hits pass in order through one task as a stream; a batch and one
    key's counters are all that it holds.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, count = None, None, 0
        for batch in batches:
            keep = []
            for k, t in zip(batch["key"].tolist(), batch["at"].tolist(), strict=True):
                if k != key:
                    key, start, count = k, None, 0
                own, start, count = _limited([t], start, count, window_us, most)
                keep += own
            yield batch.assign(allowed=keep)

    rows = hits.select("key", "id", "at")
    schema = f"key {hits.schema['key'].dataType.simpleString()}, id {hits.schema['id'].dataType.simpleString()}, at long, allowed boolean"
    return rows.repartition("key").sortWithinPartitions("key", "at", "id").mapInPandas(run, schema)


def limited_stream(hits: DataFrame, window_us: int, most: int) -> DataFrame:
    """``limited`` over a stream with columns key, id, at; state is one window a key and goes when it is over. Hits of one trigger are
    taken in order of time; hits of later triggers are later."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        own = pd.concat(list(batches)).sort_values(["at", "id"])
        keep, start, count = _limited(own["at"].tolist(), start, count, window_us, most)
        state.update((start, count))
        state.setTimeoutDuration(max(1, (start + window_us - int(own["at"].iloc[-1])) // 1000))  # what is left of the window, however often hits come
        yield own.assign(allowed=keep)[["key", "id", "at", "allowed"]]

    schema = f"key {hits.schema['key'].dataType.simpleString()}, id {hits.schema['id'].dataType.simpleString()}, at long, allowed boolean"
    return hits.select("key", "id", "at").groupBy("key").applyInPandasWithState(run, schema, "start long, count long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def first_reads_stream(reads: DataFrame, delay: str = "1 day") -> DataFrame:
    """First reads over a stream of guest, article, at (a timestamp): repetitions within the delay are dropped, older state goes."""
    return reads.withWatermark("at", delay).dropDuplicatesWithinWatermark(["guest", "article"])
