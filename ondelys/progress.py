"""Progress and cancellation of the jobs started in a block of code."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Task:
    """The jobs of one group: how far they are, and their end."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.cancelled = spark, name, False

    def progress(self) -> float:
        """Share of the tasks of the group's jobs that are done, 0 before the first."""
        tracker, done, all_ = self.spark.sparkContext.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(self.name):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                if found := tracker.getStageInfo(stage):
                    done, all_ = done + found.numCompletedTasks, all_ + found.numTasks
        return done / all_ if all_ else 0.0

    def cancel(self) -> None:
        """End the running jobs of the group; the code that waits for them gets an error."""
        self.cancelled = True
        self.spark.sparkContext.cancelJobGroup(self.name)


@contextmanager
def task(spark: SparkSession, description: str = "") -> Iterator[Task]:
    """Jobs started inside, by this thread, form a group that can be watched and cancelled from another."""
    found = Task(spark, f"ondelys-{uuid.uuid4().hex}")
    spark.sparkContext.setJobGroup(found.name, description or found.name, interruptOnCancel=True)
    try:
        yield found
    finally:
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            spark.sparkContext.setLocalProperty(key, None)
