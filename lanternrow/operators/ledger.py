"""A ledger of tasks that are done once, however often runs are killed, resumed or doubled.

A run takes the tasks that no published attempt has done, writes their rows to a folder of its own,
and publishes that folder by renaming an entry to the next free number, which the file system lets
one of several runs do. Of attempts that did the same task the one of the lowest number counts, for
all readers. What a killed run left behind has no entry and is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runs import pending


class Ledger:
    """Stages of tasks in a folder that the cluster shares. A stage's rows have task, error and what the stage makes of a task."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _context(self):
        return self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri(), self.spark._jsc.hadoopConfiguration())

    def attempts(self, stage: str) -> list[tuple[int, str]]:
        """Published attempts of a stage, (number, folder of its rows) in order; there are as many as runs."""
        at = self._path(f"{self.folder}/{stage}/entries")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted((int(n.split("-")[0]), f"{self.folder}/{stage}/staged/{n.split('-', 1)[1]}") for n in names if not n.startswith((".", "_")))

    def rows(self, stage: str) -> DataFrame | None:
        """The rows that count of each task that was done or failed: a task's done row, else its last failure. None before the first attempt."""
        found = None
        for n, path in self.attempts(stage):
            one = self.spark.read.parquet(path).withColumn("attempt", F.lit(n))
            found = one if found is None else found.unionByName(one)
        if found is None:
            return None
        order = F.when(F.col("error").isNull(), F.col("attempt")).otherwise(F.lit(1 << 30) - F.col("attempt"))
        first = found.groupBy("task").agg(F.min(F.struct(F.col("error").isNotNull().alias("bad"), order.alias("o"), "attempt")).alias("m")).select("task", F.col("m.attempt").alias("attempt"))
        return found.join(first, ["task", "attempt"])

    def todo(self, stage: str, tasks: DataFrame) -> DataFrame:
        """Tasks that no published attempt has done; those in error are to be done again."""
        rows = self.rows(stage)
        return tasks if rows is None else pending(tasks, rows.select("task", F.when(F.col("error").isNotNull(), "error").alias("failure")), "task")

    def run(self, stage: str, tasks: DataFrame, work: Callable[[DataFrame], DataFrame]) -> int:
        """Does the tasks (task, …) that are to do; how many failed. work gives a row (task, error, …) for each of the tasks it is given."""
        todo = self.todo(stage, tasks)
        if todo.isEmpty():
            return 0
        staged = self.stage(stage, todo, work)
        self.publish(stage, staged)
        return self.spark.read.parquet(f"{self.folder}/{stage}/staged/{staged}").filter("error is not null").count()

    def stage(self, stage: str, todo: DataFrame, work: Callable[[DataFrame], DataFrame]) -> str:
        """Writes the rows of an attempt, which nobody reads until it is published; its name."""
        name = uuid.uuid4().hex
        work(todo).write.parquet(f"{self.folder}/{stage}/staged/{name}")
        return name

    def publish(self, stage: str, name: str) -> int:
        """Makes an attempt count, under the next free number. Publishing it again changes nothing."""
        known = self.attempts(stage)
        if done := [n for n, path in known if path.endswith(f"/{name}")]:
            return done[0]
        jvm, context = self.spark._jvm, self._context()
        top = f"{self.folder}/{stage}"
        fs = self._path(top).getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(self._path(f"{top}/entries"))
        n = known[-1][0] + 1 if known else 1
        # numbers are claimed by a folder that only one run can make; the entry's name then says whose it is
        while not self._claim(context, f"{top}/claims/{n}"):
            n += 1
        fs.create(self._path(f"{top}/entries/.{name}"), True).close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(self._path(f"{top}/entries/.{name}"), self._path(f"{top}/entries/{n}-{name}"), none)
        return n

    def _claim(self, context, path: str) -> bool:
        from py4j.protocol import Py4JJavaError

        fs = self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(self._path(path).getParent())
        flags = self.spark._jvm.java.util.EnumSet.of(self.spark._jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.CreateOpts, 0)
        try:
            # without OVERWRITE, a file that is there is an error
            context.create(self._path(path), flags, options).close()
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True
