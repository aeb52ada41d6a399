"""Job-log analytics: queue positions, mean durations and announced waits, set-wise.

``jobs``: job_id, lane, submitted_at, started_at, finished_at (seconds), status.
Running sums and as-of lookups go by hour slots: what the slots before hold comes from one
row a slot, the rest from a window inside the slot, so no lane is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds announced for a lane without finished jobs.
DEFAULT_SECONDS = {"student": 35.0, "teacher": 150.0}
SLOT = 3600


def _default(lane: Column) -> Column:
    return F.when(lane == "student", DEFAULT_SECONDS["student"]).otherwise(DEFAULT_SECONDS["teacher"])


def running_sums(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add sums over the rows up to each one, in ``order`` (its first column is a time in seconds)."""
    df = df.select("*", F.floor(F.col(order[0]).cast("double") / SLOT).alias("_slot"), *(c.alias(f"_v_{n}") for n, c in sums.items()))
    per = df.groupBy(*by, "_slot").agg(*(F.sum(f"_v_{n}").alias(f"_p_{n}") for n in sums))
    before = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*by, "_slot", *(F.coalesce(F.sum(f"_p_{n}").over(before), F.lit(0)).alias(f"_p_{n}") for n in sums))
    inside = Window.partitionBy(*by, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(per, [*by, "_slot"])
    for n in sums:
        out = out.withColumn(n, F.col(f"_p_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)))
    return out.drop("_slot", *(f"_{k}_{n}" for n in sums for k in "vp"))


def last_known(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add the last non-null ``value`` up to each row, in ``order``."""
    df = df.withColumn("_slot", F.floor(F.col(order[0]).cast("double") / SLOT))
    per = df.groupBy(*by, "_slot").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_p"))
    before = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*by, "_slot", F.last("_p", ignorenulls=True).over(before).alias("_p"))
    inside = Window.partitionBy(*by, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(per, [*by, "_slot"])
    return joined.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inside), "_p")).drop("_slot", "_p")


def queue_positions(jobs: DataFrame) -> DataFrame:
    """(job_id, ahead): jobs waiting when a job was submitted that run before it.

    Students run before teachers, each lane in order of submission.  A job waits from its
    submission to its start, so the number waiting is arrivals less departures so far: two
    running sums over one stream of events instead of a join of intervals.  Starts at the
    very time of a submission count as gone.
    """
    waits = F.col("started_at").isNull() | (F.col("started_at") > F.col("submitted_at"))
    arrived = jobs.select("job_id", "lane", F.col("submitted_at").alias("t"), F.lit(1).alias("kind"), F.when(waits, 1).otherwise(0).alias("step"))
    gone = jobs.filter(waits & F.col("started_at").isNotNull()).select("job_id", "lane", F.col("started_at").alias("t"), F.lit(0).alias("kind"), F.lit(-1).alias("step"))
    student = F.when(F.col("lane") == "student", F.col("step")).otherwise(0)
    run = running_sums(arrived.unionByName(gone), [], ["t", "kind", "job_id"], {"everyone": F.col("step"), "students": student})
    ahead = F.when(F.col("lane") == "student", F.col("students")).otherwise(F.col("everyone")) - F.col("step")
    return run.filter("kind = 1").select("job_id", ahead.cast("long").alias("ahead"))


def lane_means(jobs: DataFrame, last: int = 8) -> DataFrame:
    """(lane, finished_at, job_id, mean_seconds) after each finished job: mean of the lane's last ones."""
    done = jobs.filter((F.col("status") == "done") & F.col("finished_at").isNotNull())
    micros = F.round((F.col("finished_at") - F.col("started_at")) * 1_000_000).cast("long")
    run = running_sums(done.select("lane", "finished_at", "job_id", micros.alias("took")), ["lane"], ["finished_at", "job_id"], {"n": F.lit(1), "total": F.col("took")})
    earlier = run.select("lane", (F.col("n") + last).alias("n"), F.col("total").alias("old"))
    mean = (F.col("total") - F.coalesce("old", F.lit(0))) / F.least("n", F.lit(last)) / 1_000_000
    return run.join(earlier, ["lane", "n"], "left").select("lane", "finished_at", "job_id", mean.alias("mean_seconds"))


def mean_at(jobs: DataFrame, asked: DataFrame, last: int = 8) -> DataFrame:
    """(job_id, lane, mean_seconds) for ``asked`` (job_id, lane, t): the lane's mean as known at t, else the default."""
    means = lane_means(jobs, last).select("job_id", "lane", F.col("finished_at").alias("t"), F.lit(0).alias("kind"), "mean_seconds")
    probes = asked.select("job_id", "lane", "t", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("mean_seconds"))
    known = last_known(means.unionByName(probes), ["lane"], ["t", "kind", "job_id"], "mean_seconds", "m").filter("kind = 1")
    return known.select("job_id", "lane", F.coalesce("m", _default(F.col("lane"))).alias("mean_seconds"))


def mean_at_submission(jobs: DataFrame, last: int = 8) -> DataFrame:
    return mean_at(jobs, jobs.select("job_id", "lane", F.col("submitted_at").alias("t")), last)


def announced_wait(jobs: DataFrame) -> DataFrame:
    """(job_id, ahead, wait_seconds): jobs ahead at the teachers' mean, the rest of the running job, one's own mean.

    The running job is the one last started before the submission, unless it had finished;
    its rest is its lane's mean less its time so far, never below zero.
    """
    starts = jobs.filter("started_at is not null").select("job_id", F.col("started_at").alias("t"), F.lit(1).alias("kind"), F.struct("started_at", "finished_at", "lane").alias("run"))
    asks = jobs.select("job_id", F.col("submitted_at").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast(starts.schema["run"].dataType).alias("run"))
    now = last_known(starts.unionByName(asks), [], ["t", "kind", "job_id"], "run", "r").filter("kind = 0")
    busy = F.col("r").isNotNull() & (F.col("r.finished_at").isNull() | (F.col("r.finished_at") > F.col("t")))
    now = now.select("job_id", F.when(busy, F.col("t") - F.col("r.started_at")).alias("so_far"), F.when(busy, F.col("r.lane")).alias("run_lane"))
    lanes = F.explode(F.array(*map(F.lit, DEFAULT_SECONDS)))
    both = mean_at(jobs, jobs.select("job_id", lanes.alias("lane"), F.col("submitted_at").alias("t")))
    pick = lambda k: F.max(F.when(F.col("lane") == k, F.col("mean_seconds"))).alias(f"{k}_mean")
    means = both.groupBy("job_id").agg(*map(pick, DEFAULT_SECONDS))
    of = lambda lane: F.when(F.col(lane) == "student", F.col("student_mean")).otherwise(F.col("teacher_mean"))
    rest = F.when(F.col("run_lane").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), of("run_lane") - F.col("so_far")))
    whole = jobs.select("job_id", "lane").join(queue_positions(jobs), "job_id").join(now, "job_id").join(means, "job_id")
    return whole.select("job_id", "ahead", (F.col("ahead") * F.col("teacher_mean") + rest + of("lane")).alias("wait_seconds"))


def outcomes(jobs: DataFrame) -> DataFrame:
    """Counts and durations by lane and status."""
    took = F.col("finished_at") - F.col("started_at")
    return jobs.groupBy("lane", "status").agg(F.count(F.lit(1)).alias("jobs"), F.avg(took).alias("mean_seconds"), F.max(took).alias("max_seconds"))
