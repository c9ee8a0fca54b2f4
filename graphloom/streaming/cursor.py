"""Result cursors, cancellation by request id, and edge feeds."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


@contextmanager
def run_as(spark: SparkSession, request_id: str | None) -> Iterator[None]:
    """Jobs started within can be cancelled by the request id."""
    if request_id is None:
        yield
        return
    spark.sparkContext.addJobTag(_tag(request_id))
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(_tag(request_id))


def _tag(request_id: str) -> str:
    return "graphloom-" + request_id.replace(",", "_")


def cancel(spark: SparkSession, request_id: str) -> bool:
    """Cancels the request's running jobs, whatever thread they were started in; whether there were any."""
    sc = spark.sparkContext
    tracker = sc._jsc.sc().statusTracker()
    jobs = [tracker.getJobInfo(i) for i in tracker.getJobIdsForTag(_tag(request_id))]
    running = any(j.isDefined() and j.get().status().name() == "RUNNING" for j in jobs)
    sc.cancelJobsWithTag(_tag(request_id))
    return running


class Cursor:
    """Rows one partition at a time, as dicts; close() ends it early."""

    def __init__(self, df: DataFrame, request_id: str | None = None):
        self.df, self.request_id, self._rows, self.closed = df, request_id, None, False

    def __iter__(self) -> Iterator[dict]:
        return self

    def __next__(self) -> dict:
        if self.closed:
            raise StopIteration
        with run_as(self.df.sparkSession, self.request_id):
            if self._rows is None:
                self._rows = self.df.toLocalIterator()
            try:
                return next(self._rows).asDict(recursive=True)
            except StopIteration:
                self.closed = True
                raise

    def close(self) -> None:
        self.closed, self._rows = True, None


def profile(df: DataFrame) -> dict:
    """Runs a query without keeping its rows: seconds, and each physical operator's metrics."""
    began = time.perf_counter()
    query = df._jdf.queryExecution()
    rows = query.toRdd().count()
    took, out, todo = time.perf_counter() - began, [], [query.executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        seq = node.metrics().toSeq()
        metrics = {seq.apply(i)._1(): seq.apply(i)._2().value() for i in range(seq.size())}
        out.append({"op": node.nodeName(), "metrics": metrics})
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        if hasattr(node, "plan") and "QueryStage" in node.getClass().getSimpleName():
            todo.append(node.plan())
    return {"seconds": took, "rows": rows, "operators": out}


def edge_feed(spark: SparkSession, path: str, schema: str, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """An extension: new edge files of a folder, each micro-batch handed to sink(edges, batch number) once."""
    feed = spark.readStream.schema(schema).parquet(path)
    return feed.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
