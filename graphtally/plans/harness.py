"""Trials of estimators over patterns: mean, time, variance, q-error percentiles, result and error files."""

from __future__ import annotations

import resource
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.base import Estimator
from ..operators.graph import Graph
from .costs import Watch
from .pattern import Pattern
from .store import Store

SCHEMA = "query string, method string, seed int, est double, ms double, status string, error string, driver_kb long, executor_kb long, execution_kb long, cpu_ms double, shuffle_kb double, spill_kb double"


def within(spark: SparkSession, seconds: float | None, work):  # noqa: ANN001, ANN201
    """What ``work`` returns, or a TimeoutError: its Spark jobs are cancelled when the time is over."""
    if seconds is None:
        return work()
    sc, group, late = spark.sparkContext, uuid.uuid4().hex, threading.Event()

    def stop() -> None:
        late.set()
        while not done.wait(0.2):  # work may start another job after one was cancelled
            sc.cancelJobGroup(group)

    done, timer = threading.Event(), threading.Timer(seconds, stop)
    sc.setJobGroup(group, "trial", interruptOnCancel=True)
    timer.start()
    try:
        return work()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"no result in {seconds:g} s") from e
        raise
    finally:
        done.set()
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


def run_trials(spark: SparkSession, g: Graph, patterns: dict[str, Pattern], methods: list[Estimator], n: int = 30, seed: int = 0, timeout: float | None = None, summaries: dict[str, Store] | None = None, repeat_fixed: bool = False) -> DataFrame:
    """One row per trial; fixed estimators run once (unless times are what is asked), whatever goes wrong becomes a row.

    Summaries are built once per method and read by every trial.  Status is ok, error or
    timeout; a timeout ends the trials of its pattern and method.  A method whose trials are
    data makes them together: they share the time, the cost and one fate, and get as many
    timeouts' time.  ``driver_kb`` is the peak of the driver's Python so far, the columns after
    it are what the trial's jobs cost the executors (see ``Cost``).
    """
    rows, summaries = [], dict(summaries or {})

    def spent(watch: Watch, n: int = 1) -> tuple:
        c = watch.cost()
        return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, c.executor_kb, c.execution_kb, c.cpu_ms / n, c.shuffle_kb / n, c.spill_kb / n

    for m in methods:
        if m.name not in summaries:
            summaries[m.name] = m.summarize(g, Store.scratch(spark), patterns.values())
        for name, p in patterns.items():
            if m.batched:
                began, found, status, error, watch = time.perf_counter(), {}, "ok", None, Watch(spark)
                seeds = [seed + i for i in range(n)]
                try:
                    with watch:
                        found = dict(within(spark, timeout and timeout * n, lambda m=m, p=p, seeds=seeds: [tuple(r) for r in m.trials(g, p, seeds, summaries[m.name]).collect()]))
                except TimeoutError as e:
                    status, error, seeds = "timeout", str(e), seeds[:1]
                except Exception as e:  # noqa: BLE001
                    status, error = "error", f"{type(e).__name__}: {str(e)[:500]}"
                took, cost = (time.perf_counter() - began) * 1000 / len(seeds), spent(watch, len(seeds))
                rows += [(name, m.name, s, found.get(s), took, status, error, *cost) for s in seeds]
                continue
            for i in range(1 if m.fixed and not repeat_fixed else n):
                began = time.perf_counter()
                est, status, error, watch = None, "ok", None, Watch(spark)
                try:
                    with watch:
                        est = float(within(spark, timeout, lambda m=m, p=p, i=i: m.estimate(g, p, seed + i, summaries[m.name])))
                except TimeoutError as e:
                    status, error = "timeout", str(e)
                except Exception as e:  # noqa: BLE001
                    status, error = "error", f"{type(e).__name__}: {str(e)[:500]}"
                took = (time.perf_counter() - began) * 1000
                rows.append((name, m.name, seed + i, est, took, status, error, *spent(watch)))
                if status == "timeout":
                    break
    return spark.createDataFrame(rows, SCHEMA)


def trial_stats(trials: DataFrame) -> DataFrame:
    """(query, method, avg_est, avg_ms, var_pop, ests); estimates of -1e9 and less are no results."""
    t = trials.where("status = 'ok' and est > -1e9")
    return t.groupBy("query", "method").agg(F.avg("est").alias("avg_est"), F.avg("ms").alias("avg_ms"), F.var_pop("est").alias("var_pop"), F.transform(F.sort_array(F.collect_list(F.struct("seed", "est"))), lambda x: x["est"]).alias("ests"))


def cost_report(trials: DataFrame) -> DataFrame:
    """(query, method, trials, avg_ms, cpu_ms, shuffle_kb, spill_kb, executor_kb, execution_kb, driver_kb): means of what adds up, peaks of memory, whatever the status."""
    means = [F.avg(c).alias(a) for c, a in (("ms", "avg_ms"), ("cpu_ms", "cpu_ms"), ("shuffle_kb", "shuffle_kb"), ("spill_kb", "spill_kb"))]
    return trials.groupBy("query", "method").agg(F.count("*").alias("trials"), *means, *[F.max(c).alias(c) for c in ("executor_kb", "execution_kb", "driver_kb")])


def qerrors(trials: DataFrame, truth: DataFrame) -> DataFrame:
    """(query, method, seed, qerr) with ``truth`` (query, matches); both sides count 1 at least."""
    t = trials.where("status = 'ok' and est > -1e9").join(truth, "query")
    e, m = F.greatest("est", F.lit(1.0)), F.greatest(F.col("matches").cast("double"), F.lit(1.0))
    return t.select("query", "method", "seed", F.greatest(e / m, m / e).alias("qerr"))


def qerror_report(errors: DataFrame) -> DataFrame:
    """(method, mean, std, p5, p25, p50, p75, p95)."""
    cuts = (5, 25, 50, 75, 95)
    return errors.groupBy("method").agg(F.avg("qerr").alias("mean"), F.stddev("qerr").alias("std"), *[F.percentile("qerr", F.lit(c / 100)).alias(f"p{c}") for c in cuts])


def result_lines(stats: DataFrame) -> DataFrame:
    """Two lines a query: name, mean, time and variance; then the number of estimates and each."""
    one = F.format_string("%s %.17g %.17g %.17g", "query", "avg_est", "avg_ms", "var_pop")
    two = F.concat_ws(" ", F.size("ests").cast("string"), F.transform("ests", lambda x: x.cast("string")))
    return stats.select("query", "method", F.concat_ws("\n", one, two).alias("value"))


def error_lines(trials: DataFrame) -> DataFrame:
    """One line for each trial that gave nothing: query, then 1 for a timeout or 2 for an error."""
    bad = trials.where("status <> 'ok'")
    return bad.select("query", "method", F.concat_ws(" ", "query", F.when(F.col("status") == "timeout", F.lit("1")).otherwise(F.lit("2"))).alias("value"))
