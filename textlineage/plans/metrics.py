"""Where a job's time goes: Spark's own figures of its stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYOUT = (
    "stage int, name string, tasks int, seconds double, cpu_seconds double, gc_seconds double, rows_in long, rows_out long, read_mb double, written_mb double, "
    "shuffle_read_mb double, shuffle_written_mb double, spilled_mb double, median_s double, longest_s double, most_rows long, skew double"
)


class StageWatch:
    """Collects the stages that run within its block; `table()` has a row for each.

        with StageWatch(spark) as w:
            df.write.parquet(path)
        w.table().show()

    Seconds are sums over tasks; most_rows are those that the largest task read, skew is that over the mean of all tasks. Stages that were skipped, as their output was there, have no row. Spark keeps the last
    spark.ui.retainedStages stages, and the driver holds a row of each.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.rows = spark, []
        self._sc = spark.sparkContext._jsc.sc()

    def stages(self) -> list:
        self._sc.listenerBus().waitUntilEmpty(60_000)
        gateway = self.spark.sparkContext._gateway
        none = gateway.jvm.java.util.ArrayList()
        found = self._sc.statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
        return [found.apply(i) for i in range(found.size())]

    def __enter__(self) -> StageWatch:
        self._seen = max((s.stageId() for s in self.stages()), default=-1)
        return self

    def __exit__(self, *error) -> None:
        gateway = self.spark.sparkContext._gateway
        half = gateway.new_array(gateway.jvm.double, 2)
        half[0], half[1] = 0.5, 1.0
        mb = lambda n: n / 1e6
        for s in self.stages():
            if s.stageId() <= self._seen or not s.numCompleteTasks():
                continue
            times = self._sc.statusStore().taskSummary(s.stageId(), s.attemptId(), half)
            median, longest, most = 0.0, 0.0, 0
            if times.isDefined():
                t = times.get()
                median, longest = (t.executorRunTime().apply(i) / 1e3 for i in (0, 1))
                most = int(max(t.inputMetrics().recordsRead().apply(1), t.shuffleReadMetrics().readRecords().apply(1)))
            read = s.inputRecords() + s.shuffleReadRecords()
            self.rows.append((
                s.stageId(), s.name().partition(" at ")[0], s.numCompleteTasks(), s.executorRunTime() / 1e3, s.executorCpuTime() / 1e9, s.jvmGcTime() / 1e3, read, s.outputRecords() + s.shuffleWriteRecords(),
                mb(s.inputBytes()), mb(s.outputBytes()), mb(s.shuffleReadBytes()), mb(s.shuffleWriteBytes()), mb(s.diskBytesSpilled()), median, longest, most, most * s.numCompleteTasks() / max(read, 1),
            ))

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, LAYOUT).orderBy(F.desc("seconds"), "stage")

    def text(self) -> str:
        """The table, the longest stage first, in columns."""
        names = [f.split()[0] for f in LAYOUT.split(", ")]
        cells = [names, *[[f"{v:.1f}" if isinstance(v, float) else str(v) for v in r] for r in sorted(self.rows, key=lambda r: -r[3])]]
        widths = [max(map(len, c)) for c in zip(*cells, strict=True)]
        return "\n".join(" | ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)) for r in cells)
