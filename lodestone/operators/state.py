"""Resumable runs as state replayed from an event log, and over run files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_LENGTH = 1000


def items(events: DataFrame) -> DataFrame:
    """(run_id, item, done, failed, error): done once any event says so, failed if the last event does."""
    own = events.where(F.col("kind").isin("done", "failed"))
    last = F.max_by(F.struct("kind", "error"), F.struct("ts", "event_id"))
    out = own.groupBy("run_id", "item").agg(F.bool_or(F.col("kind") == "done").alias("done"), last.alias("x"))
    return out.select("run_id", "item", "done", (F.col("x.kind") == "failed").alias("failed"), F.when(F.col("x.kind") == "failed", F.substring("x.error", 1, ERROR_LENGTH)).alias("error"))


def replay(events: DataFrame) -> DataFrame:
    """(run_id, status, updated_at, finished_at, completed, failures) of each run.

    A finish makes a run partial or complete by the failures at that time; later marks make it running.
    """
    per = items(events).groupBy("run_id").agg(F.count_if("done").alias("completed"), F.count_if("failed").alias("failures"))
    order = F.struct("ts", "event_id")
    last = events.groupBy("run_id").agg(F.max_by("kind", order).alias("last"), F.max("ts").alias("updated_at"), F.max(F.when(F.col("kind") == "finish", F.col("ts"))).alias("finished_at"))
    out = last.join(per, "run_id", "left").na.fill({"completed": 0, "failures": 0})
    # marks after a finish reopen the run; with none, the failures of the end are those of the finish
    status = F.when(F.col("last") != "finish", "running").when(F.col("failures") > 0, "partial").otherwise("complete")
    return out.select("run_id", status.alias("status"), "updated_at", "finished_at", "completed", "failures")


def pending(wanted: DataFrame, events: DataFrame) -> DataFrame:
    """Wanted (run_id, item) that no event marks done."""
    done = events.where("kind = 'done'").select("run_id", "item").distinct()
    return wanted.join(done, ["run_id", "item"], "left_anti")


def all_done(wanted: DataFrame, events: DataFrame) -> DataFrame:
    """(run_id, all_done) over wanted (run_id, item)."""
    done = events.where("kind = 'done'").select("run_id", "item", F.lit(True).alias("_d")).distinct()
    return wanted.join(done, ["run_id", "item"], "left").groupBy("run_id").agg(F.bool_and(F.coalesce("_d", F.lit(False))).alias("all_done"))


def resumable(runs: DataFrame, fingerprint_col: str = "fingerprint") -> DataFrame:
    """Of each fingerprint, the newest run that isn't complete."""
    rest = runs.where(F.col("status") != "complete")
    return rest.groupBy(fingerprint_col).agg(F.max_by(F.struct(*[c for c in runs.columns if c != fingerprint_col]), F.coalesce(F.col("updated_at").cast("string"), F.lit(""))).alias("r")).select(fingerprint_col, "r.*")


def open_run(runs: DataFrame, fingerprint: str, run_id: str | None = None, resume: bool = True) -> DataFrame:
    """The run to continue: the named one, or the newest resumable one; empty if a new one is to start.

    A named run with another fingerprint is an error.
    """
    if run_id is not None:
        same = F.col("fingerprint") == fingerprint
        wrong = F.when(~same, F.raise_error(F.lit(f"run {run_id} has other parameters")))
        return runs.where(F.col("run_id") == run_id).where(F.coalesce(wrong.cast("boolean"), F.lit(True)))
    return resumable(runs.where((F.col("fingerprint") == fingerprint) & F.lit(resume)))


def newest(runs: DataFrame, most: int = 20, by: str = "updated_at", tie: str = "run_id") -> DataFrame:
    """Status report: the newest runs."""
    return runs.orderBy(F.col(by).desc(), F.col(tie)).limit(most)


def groups_by_profile(urls: DataFrame, key, ordinal: str = "ordinal") -> DataFrame:
    """(profile, urls in order)."""
    return urls.groupBy(key.alias("profile")).agg(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, "url"))), lambda x: x["url"]).alias("urls"))
