"""Queries over a log of jobs: fair order, places and waits, admission, pruning and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The states of a job.
ACTIVE = ("queued", "extracting", "awaiting_model", "judging")
CANCELABLE = ("queued", "extracting", "awaiting_model")
TERMINAL = ("done", "error", "canceled")


def current(events: DataFrame) -> DataFrame:
    """(job_id, session, status, ts): each job's latest state of a log of states."""
    best = F.max_by(F.struct("session", "status", "ts"), F.struct("ts", "seq"))
    return events.groupBy("job_id").agg(best.alias("b")).select("job_id", "b.session", "b.status", "b.ts")


def fair_order(jobs: DataFrame, last_served: DataFrame) -> DataFrame:
    """(job_id, session, position): jobs that wait for a model; sessions served longest ago first, then by waiting time, position from 0.

    Shares one queue, so it is one sorted run over the waiting jobs alone.
    """
    waiting = jobs.where((F.col("status") == "awaiting_model") & ~F.col("canceled"))
    waiting = waiting.join(last_served.select("session", "seq"), "session", "left").withColumn("seq", F.coalesce("seq", F.lit(0)))
    return waiting.select("job_id", "session", (F.row_number().over(Window.orderBy("seq", "enqueued_at", "job_id")) - 1).cast("long").alias("position"))


def pick_next(jobs: DataFrame, last_served: DataFrame) -> DataFrame:
    """The first waiting job whose session has none being judged."""
    busy = jobs.where("status = 'judging'").select("session").distinct()
    return fair_order(jobs, last_served).join(busy, "session", "left_anti").orderBy("position").limit(1)


def rolling_latency(done: DataFrame, last: int = 20) -> DataFrame:
    """(job_id, finished, avg_ms): the mean latency of the last jobs up to each."""
    return done.select("job_id", "finished", F.avg("latency_ms").over(Window.orderBy("finished", "job_id").rowsBetween(1 - last, 0)).alias("avg_ms"))


def positions_and_waits(jobs: DataFrame, last_served: DataFrame, avg_ms: DataFrame, lanes: int = 1) -> DataFrame:
    """(job_id, position, eta_ms): whole rounds of lanes ahead times the mean, and one more; null without a mean (avg_ms has one row)."""
    judging = jobs.where("status = 'judging'").agg(F.count(F.lit(1)).alias("judging"))
    out = fair_order(jobs, last_served).join(F.broadcast(judging)).join(F.broadcast(avg_ms.select("avg_ms").limit(1)), how="left")
    eta = F.expr(f"CAST(((position + judging) div {lanes}) * avg_ms + avg_ms AS BIGINT)")
    return out.select("job_id", "position", eta.alias("eta_ms"))


def active_counts(jobs: DataFrame) -> DataFrame:
    """(session, active, waiting, judging)."""
    active = F.count_if(F.col("status").isin(*ACTIVE))
    return jobs.groupBy("session").agg(active.alias("active"), F.count_if(F.col("status") == "awaiting_model").alias("waiting"), F.count_if(F.col("status") == "judging").alias("judging"))


def admitted(requests: DataFrame, jobs: DataFrame, cap: int = 100, per_session: int = 5) -> DataFrame:
    """requests (request_id, session) with admitted: in order of request_id, within the caps on active jobs."""
    held = jobs.where(F.col("status").isin(*ACTIVE)).groupBy("session").agg(F.count(F.lit(1)).alias("held"))
    total = jobs.agg(F.count_if(F.col("status").isin(*ACTIVE)).alias("all_held"))
    r = requests.join(held, "session", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    r = r.withColumn("k", F.row_number().over(Window.partitionBy("session").orderBy("request_id")))
    r = r.withColumn("fits", F.col("held") + F.col("k") <= per_session)
    r = r.join(F.broadcast(total)).withColumn("n", F.sum(F.col("fits").cast("long")).over(Window.orderBy("request_id")))
    return r.select("request_id", "session", (F.col("fits") & (F.col("all_held") + F.col("n") <= cap)).alias("admitted"))


def pruned(jobs: DataFrame, max_jobs: int = 1000) -> DataFrame:
    """Job ids to forget: of the jobs beyond max_jobs, the oldest that have ended."""
    total = jobs.agg(F.count(F.lit(1)).alias("total"))
    ended = jobs.where(F.col("status").isin(*TERMINAL)).withColumn("age", F.row_number().over(Window.orderBy("created", "job_id")))
    return ended.join(F.broadcast(total)).where(F.col("age") <= F.col("total") - max_jobs).select("job_id")


def expired(folders: DataFrame, jobs: DataFrame, now: float, hours: float = 12.0) -> DataFrame:
    """Folders (job_id, modified) older than the retention, those of active jobs excepted."""
    active = jobs.where(F.col("status").isin(*ACTIVE)).select("job_id")
    return folders.where(F.lit(now) - F.col("modified") > hours * 3600).join(active, "job_id", "left_anti").select("job_id")


def owned(jobs: DataFrame, session: str) -> DataFrame:
    """A session's own jobs, newest first."""
    return jobs.where(F.col("session") == session).orderBy(F.desc("created"))
