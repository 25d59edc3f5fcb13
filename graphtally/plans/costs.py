"""What the Spark jobs of a piece of work cost the executors."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Memory of an executor's JVM, of its Python workers and of its other processes, each as Spark names it.
JVM = ("JVMHeapMemory", "JVMOffHeapMemory")
TREE = ("ProcessTreeJVMRSSMemory", "ProcessTreePythonRSSMemory", "ProcessTreeOtherRSSMemory")


@dataclass
class Cost:
    """Sums over the stages that ran, and peaks over stages; what Spark didn't measure is None.

    ``executor_kb`` is the most memory of one executor: its resident processes, Python workers
    included, with ``spark.executor.processTreeMetrics.enabled``, else heap and off-heap of its
    JVM.  Spark polls both with heartbeats, or every ``spark.executor.metrics.pollingInterval``,
    so a shorter trial without that setting has none.  Each kind's peak counts even if the kinds
    had theirs at different times.  ``execution_kb`` is the execution memory that the tasks of a
    stage held, summed over the tasks.
    """

    cpu_ms: int = 0
    shuffle_kb: int = 0
    spill_kb: int = 0
    execution_kb: int = 0
    executor_kb: int | None = None
    stages: int = 0


class Watch:
    """Marks the jobs started inside ``with`` and tells what they cost.

    Jobs bear a tag, so the groups by which others cancel them stay as they are.  Stages that
    the session no longer holds (``spark.ui.retainedStages``) are left out.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.sc, self.tag = spark.sparkContext, f"graphtally-{uuid.uuid4().hex}"

    def __enter__(self) -> Watch:
        self.sc.addJobTag(self.tag)
        return self

    def __exit__(self, *_: object) -> None:
        self.sc.removeJobTag(self.tag)

    def cost(self) -> Cost:
        """The cost of the marked jobs, once all that happened in them is known."""
        own, out = self.sc._jsc.sc(), Cost()
        own.listenerBus().waitUntilEmpty(600_000)  # ms; its own 10 s may be short after many tasks
        jobs = [self.sc.statusTracker().getJobInfo(j) for j in own.statusTracker().getJobIdsForTag(self.tag)]
        for stage in sorted({i for j in jobs if j is not None for i in j.stageIds}):
            try:
                s = own.statusStore().lastStageAttempt(stage)
            except Py4JJavaError as e:
                if "NoSuchElement" not in e.java_exception.getClass().getName():
                    raise
                continue
            if s.status().toString() in ("SKIPPED", "PENDING"):
                continue
            out.stages += 1
            out.cpu_ms += s.executorCpuTime() // 1_000_000
            out.shuffle_kb += s.shuffleWriteBytes() // 1024
            out.spill_kb += s.diskBytesSpilled() // 1024
            out.execution_kb = max(out.execution_kb, s.peakExecutionMemory() // 1024)
            if s.peakExecutorMetrics().isDefined():
                m = s.peakExecutorMetrics().get()
                kb = max(sum(m.getMetricValue(k) for k in kinds) for kinds in (JVM, TREE)) // 1024
                out.executor_kb = max(out.executor_kb or 0, kb) or None
        return out
