"""Watching folders and following a build as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codeloom.sources.files import scan

RING = 400


def snapshot(spark: SparkSession, roots: Iterable[str]) -> DataFrame:
    """(path, size, modified) of the program files below the roots; contents are not read."""
    out = None
    for root in roots:
        part = scan(spark, root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
        out = part if out is None else out.unionByName(part)
    return out.dropDuplicates(["path"])


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): ADDED, REMOVED or CHANGED between two snapshots."""
    o, n = old.toDF("path", "o_size", "o_mod"), new.toDF("path", "n_size", "n_mod")
    change = F.when(F.col("o_size").isNull(), "ADDED").when(F.col("n_size").isNull(), "REMOVED").when((F.col("o_size") != F.col("n_size")) | (F.col("o_mod") != F.col("n_mod")), "CHANGED")
    return o.join(n, "path", "full_outer").withColumn("change", change).where("change is not null").select("path", "change")


def fingerprint(snap: DataFrame) -> tuple[int, int]:
    """(latest change, number of files): equal while nothing happened."""
    r = snap.agg(F.max(F.unix_micros("modified")).alias("m"), F.count("*").alias("n")).first()
    return (r["m"] or 0, r["n"])


def watch(spark: SparkSession, roots: list[str], rebuild: Callable[[DataFrame], Any], every: str = "1 second", quiet: float = 1.5):
    """A query that lists the folders at each trigger and calls ``rebuild`` with the changes since the last call.

    A change is acted on when nothing has changed for ``quiet`` seconds, so that a file is not read half written.
    """
    import time

    state: dict[str, Any] = {"last": None, "seen": None, "at": 0.0}

    def tick(batch: DataFrame, _: int) -> None:
        rows = [tuple(r) for r in snapshot(spark, roots).collect()]  # names and times of one project's files
        now = time.time()
        if state["last"] is None:
            state["last"] = state["seen"] = sorted(rows)
            return
        if sorted(rows) != state["seen"]:
            state["seen"], state["at"] = sorted(rows), now
        if state["seen"] != state["last"] and now - state["at"] >= quiet:
            schema = "path string, size long, modified timestamp"
            changes = diff(spark.createDataFrame(state["last"], schema), spark.createDataFrame(state["seen"], schema))
            state["last"] = state["seen"]
            rebuild(changes)

    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.foreachBatch(tick).trigger(processingTime=every).start()


def fold(state: dict[str, Any], event: dict[str, Any]) -> dict[str, Any]:
    """One build event into the status: kinds start, stage, file, log, finished. A stage ends the one before it, counts
    never fall, the log keeps its last lines, and what is finished stays finished until the next start."""
    kind = event["kind"]
    if kind == "start":
        return {"state": "RUNNING", "stages": [], "done": 0, "total": int(event.get("total") or 0), "log": [], "verdict": None}
    if state["state"] in ("DONE", "FAILED"):
        return state
    if kind == "stage":
        stages = [[name, "DONE"] for name, _ in state["stages"]]
        return state | {"stages": [*stages, [event["text"], "RUNNING"]]}
    if kind == "file":
        return state | {"done": max(state["done"], int(event.get("done") or 0)), "total": max(state["total"], int(event.get("total") or 0))}
    if kind == "log":
        return state | {"log": [*state["log"], event["text"]][-RING:]}
    if kind == "finished":
        ok = event.get("text") is not None
        return state | {"state": "DONE" if ok else "FAILED", "verdict": event.get("text"), "stages": [[name, "DONE" if ok else s] for name, s in state["stages"]]}
    return state


EMPTY = {"state": "IDLE", "stages": [], "done": 0, "total": 0, "log": [], "verdict": None}


def status(events: DataFrame) -> DataFrame:
    """Status of each build from a stream of (build, seq, kind, text, done, total): (build, state, done, total, stage,
    n_log, verdict) after each batch, events of a batch in the order of ``seq``."""
    import json

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else EMPTY
        for r in pd.concat(list(batches)).sort_values("seq").to_dict("records"):
            now = fold(now, {k: (None if v is None or v != v else v) for k, v in r.items()})
        state.update((json.dumps(now),))
        stage = now["stages"][-1][0] if now["stages"] else None
        yield pd.DataFrame([(key[0], now["state"], now["done"], now["total"], stage, len(now["log"]), now["verdict"])], columns=["build", "state", "done", "total", "stage", "n_log", "verdict"])

    return events.groupBy("build").applyInPandasWithState(run, "build string, state string, done long, total long, stage string, n_log int, verdict string", "json string", "update", GroupStateTimeout.NoTimeout)
