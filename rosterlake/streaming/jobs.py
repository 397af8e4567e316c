"""A job queue as tables: enqueue, claim, resume, memoise; and the same as micro-batches of a stream.

One driver writes a state table per micro-batch, so the row locks of a database aren't needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enqueue(candidates: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates that have no job yet, one per key (the least row on repeats)."""
    rest = [c for c in candidates.columns if c not in keys]
    one = candidates.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_b")).select(*keys, "_b.*") if rest else candidates.select(*keys).distinct()
    return one.join(existing.select(*keys).distinct(), keys, "left_anti")


def claim_oldest(jobs: DataFrame, n: int, open_status: str = "queued") -> DataFrame:
    """The n oldest open jobs with one attempt more (a distributed top-n, ties by id)."""
    return jobs.where(F.col("status") == open_status).orderBy(F.col("created_at").asc_nulls_last(), "job_id").limit(n).withColumn("attempts", F.coalesce("attempts", F.lit(0)) + 1).withColumn("status", F.lit("running"))


def apply_claims(jobs: DataFrame, claimed: DataFrame) -> DataFrame:
    """The job table after a claim: claimed rows replaced, all others as they were."""
    c = claimed.select("job_id", F.col("status").alias("_s"), F.col("attempts").alias("_a"))
    return jobs.join(c, "job_id", "left").withColumn("status", F.coalesce("_s", "status")).withColumn("attempts", F.coalesce("_a", "attempts")).drop("_s", "_a")


def settle(jobs: DataFrame, error, max_attempts: int = 3) -> DataFrame:
    """Running jobs after their run: ``completed`` without an error, ``queued`` again while attempts are
    left, else ``failed``; ``released`` marks claims to be given up. Other jobs stay as they are. A missing
    number of attempts counts as none, a missing maximum as ``max_attempts``."""
    ran = F.coalesce(F.col("status") == "running", F.lit(False))
    left = F.coalesce("attempts", F.lit(0)) < F.coalesce("max_attempts", F.lit(max_attempts))
    done = F.when(error.isNull(), "completed").when(left, "queued").otherwise("failed")
    return jobs.withColumn("released", F.col("status").isNotNull() & ran & error.isNotNull() & left).withColumn("status", F.when(ran, done).otherwise(F.col("status")))


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run has left to do."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def memoised(rows: DataFrame, fingerprint: list[str], results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows joined with known results; distinct fingerprints that still need a call)."""
    fp = F.sha2(F.concat_ws("|", *[F.coalesce(F.lower(F.trim(c)), F.lit("")) for c in fingerprint]), 256)
    keyed = rows.withColumn("fingerprint", fp)
    return keyed.join(results, "fingerprint", "left"), keyed.select("fingerprint").distinct().join(results.select("fingerprint"), "fingerprint", "left_anti")


def open_once(items: DataFrame, keys: list[str], seq: str, existing_open: DataFrame) -> DataFrame:
    """Review items to open: the first per key, none where one is open already."""
    from rosterlake.operators.dedupe import first_seen

    return first_seen(items, keys, seq).join(existing_open.select(*keys).distinct(), keys, "left_anti")


def run_stream(source: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Drive ``step(batch, batch_id)`` over all available input, resuming from the checkpoint."""
    source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_state(updates: DataFrame, key: str, seq: str, watermark_col: str | None = None, delay: str = "30 days") -> DataFrame:
    """Streaming or batch: last state per key. On a stream a watermark bounds the state kept."""
    src = updates.withWatermark(watermark_col, delay) if watermark_col and updates.isStreaming else updates
    rest = [c for c in updates.columns if c not in (key, seq)]
    return src.groupBy(key).agg(F.max(F.struct(seq, *rest)).alias("b")).select(key, f"b.{seq}", *[f"b.{c}" for c in rest])
