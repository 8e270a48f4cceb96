"""Jobs as rows: claims with leases, heartbeats, retries with growing delays, handlers, and cursors that resume.

A table of jobs has job, kind, status, attempts, most_attempts, worker, lease_until, retry_at and created. Every change
is a function of the table and of the present time, so that it is a plan like any other and can be run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmap.functions import stats
from kinmap.functions.ids import backoff_seconds

#: Bounds of a lease, in seconds.
SHORTEST, LONGEST = 5, 86_400


def _later(now: Column, seconds: Column) -> Column:
    return now + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def reap(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease is over go to retry, or are dead where no attempt is left."""
    over = (F.col("status") == "running") & F.coalesce(F.col("lease_until") <= now, F.lit(False))
    again = F.col("attempts") < F.col("most_attempts")
    return jobs.withColumns({
        "status": F.when(over & again, "retry").when(over, "dead").otherwise(F.col("status")),
        "retry_at": F.when(over, F.when(again, now)).otherwise(F.col("retry_at")),
        "worker": F.when(~over, F.col("worker")),
        "lease_until": F.when(~over, F.col("lease_until")),
    })


def claim(jobs: DataFrame, worker: str, now: Column, limit: int, lease_seconds: int = 300, kinds: tuple[str, ...] = ()) -> DataFrame:
    """The table after a worker took the oldest due jobs, `limit` at most; limit is a page of work, not of the table."""
    if not SHORTEST <= lease_seconds <= LONGEST:
        raise ValueError(f"a lease is {SHORTEST} to {LONGEST} seconds")
    reaped = reap(jobs, now)
    due = F.col("status").isin("queued", "retry") & F.coalesce(F.col("retry_at") <= now, F.lit(True))
    due = due & F.col("kind").isin(*kinds) if kinds else due
    taken = reaped.filter(due).orderBy("created", "job").limit(limit).select("job", F.lit(True).alias("_taken"))
    rows = reaped.join(F.broadcast(taken), "job", "left")
    mine = F.coalesce("_taken", F.lit(False))
    return rows.withColumns({
        "status": F.when(mine, "running").otherwise(F.col("status")),
        "attempts": F.col("attempts") + mine.cast("int"),
        "worker": F.when(mine, worker).otherwise(F.col("worker")),
        "lease_until": F.when(mine, _later(now, F.lit(lease_seconds))).otherwise(F.col("lease_until")),
    }).select(*jobs.columns)


def heartbeat(jobs: DataFrame, worker: str, now: Column, lease_seconds: int = 300) -> DataFrame:
    """Longer leases of the jobs a worker still holds; a lease that is over isn't his any more."""
    mine = (F.col("status") == "running") & (F.col("worker") == worker) & (F.col("lease_until") > now)
    return jobs.withColumn("lease_until", F.when(F.coalesce(mine, F.lit(False)), _later(now, F.lit(lease_seconds))).otherwise(F.col("lease_until")))


def finish(jobs: DataFrame, results: DataFrame, worker: str, now: Column) -> DataFrame:
    """The table after a worker's results (job, outcome): done, permanent or retryable; only of jobs he holds.

    A retryable failure waits backoff_seconds(); without an attempt left it is dead, and so is a permanent one.
    """
    rows = jobs.join(results.select("job", "outcome"), "job", "left")
    held = F.coalesce((F.col("status") == "running") & (F.col("worker") == worker) & (F.col("lease_until") > now) & F.col("outcome").isNotNull(), F.lit(False))
    again = (F.col("outcome") == "retryable") & (F.col("attempts") < F.col("most_attempts"))
    status = F.when(F.col("outcome") == "done", "succeeded").when(again, "retry").otherwise("dead")
    return rows.withColumns({
        "status": F.when(held, status).otherwise(F.col("status")),
        "retry_at": F.when(held & again, _later(now, backoff_seconds(F.col("attempts"), F.col("job")))).otherwise(F.col("retry_at")),
        "worker": F.when(~held, F.col("worker")),
        "lease_until": F.when(~held, F.col("lease_until")),
    }).select(*jobs.columns)


class Permanent(Exception):
    """A failure that trying again doesn't mend."""


class Handlers:
    """Kinds of job and the functions that do them."""

    def __init__(self) -> None:
        self.by_kind: dict[str, Callable[[dict], None]] = {}

    def add(self, kind: str) -> Callable:
        def keep(f: Callable[[dict], None]) -> Callable[[dict], None]:
            if kind in self.by_kind:
                raise ValueError(f"{kind} has a handler")
            self.by_kind[kind] = f
            return f

        return keep

    def run(self, job: dict) -> str:
        """Outcome of one job, as finish() takes it."""
        try:
            if job["kind"] not in self.by_kind:
                raise Permanent(f"no handler for {job['kind']}")
            self.by_kind[job["kind"]](job)
        except Permanent:
            return "permanent"
        except Exception:  # noqa: BLE001  any other failure may pass
            return "retryable"
        return "done"


def pages(rows: DataFrame, key: str, after: int | None, size: int) -> Iterator[tuple[DataFrame, int]]:
    """(rows of a page, its last key) in the order of key, from after a cursor on.

    Whoever stores the last key when a page is done can go on from there after a crash; a page is found by its key, so
    what was done is neither read nor done again.
    """
    while True:
        page = (rows if after is None else rows.filter(F.col(key) > after)).orderBy(key).limit(size)
        last = page.agg(F.max(key)).first()[0]
        if last is None:
            return
        yield (rows if after is None else rows.filter(F.col(key) > after)).filter(F.col(key) <= last), last
        after = last


def cursor_pages(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows with `page`, from 0, of `size` keys in order: all pages at once, without a window over the whole table."""
    return stats.ranked(rows, key, [], "_n").withColumn("page", F.expr(f"(_n - 1) div {size}")).drop("_n")

