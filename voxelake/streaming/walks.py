"""Slice walks as a stream: slices arrive in any order, a walk ends at its first cause.

A walk's state is its seed, the last slice that was judged and the slices that wait for
an earlier one, never more than the limit of slices. Each slice that closes a gap is judged at
once; a cause, or the limit, ends the walk, and what comes after it is ignored. A walk
without news for ``patience`` (behind the watermark) is closed: slices that wait are
judged without the missing ones, as a batch would, and its state goes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxelake.operators.walk import Limits

OUT = "walk_id long, kept int, stop string, version int"


def cause(previous: float, area: float, score: float, seed: float, limits: Limits) -> str | None:
    """``walk.cause`` of one slice; what is not a number meets no rule."""
    rules = (
        (area == 0, "vanished"),
        (area < limits.min_area, "collapsed"),
        (previous > 0 and area > previous * limits.growth, "leaked"),
        (previous > 0 and area < previous * limits.shrink, "collapsed"),
        (seed > 0 and area > seed * limits.drift, "drifted"),
        (score < limits.min_score, "low-score"),
    )
    return next((name for holds, name in rules if holds), None)


def begun() -> dict:
    return {"seed": None, "previous": None, "next": 0, "kept": 0, "waiting": {}, "stop": None, "seen": 0}


def judge(w: dict, limits: Limits, gaps: bool = False) -> dict:
    """Judges what waits in turn; ``gaps``: missing slices are passed over."""
    while w["waiting"] and w["stop"] is None:
        step = min(map(int, w["waiting"])) if gaps else w["next"]
        if str(step) not in w["waiting"]:
            break
        area, score = w["waiting"].pop(str(step))
        w["seed"] = area if w["seed"] is None else w["seed"]
        if step > 0:
            w["stop"] = cause(w["previous"] or 0, area, score, w["seed"], limits)
            if w["stop"] is None:
                w["kept"] = step
                w["stop"] = "limit" if step >= limits.max_slices else None
        w["previous"], w["next"] = area, step + 1
    if w["stop"]:
        w["waiting"] = {}
    return w


def walk_stream(slices: DataFrame, limits: Limits = Limits(), late: str = "1 hour", patience: str = "1 day") -> DataFrame:
    """walk_id, kept, stop, version of each walk of a stream of slices (walk_id, step, area, score, ts), whenever it changes.

    The latest version is the answer so far; ``stop`` is edge while a walk may go on.
    Walks that have no slice but their seed are not listed. Rows without walk, step or time take no part.
    """
    gap = int(pd.Timedelta(patience).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        w = json.loads(state.get[0]) if state.exists else begun()
        before = (w["kept"], w["stop"], w["next"])
        if state.hasTimedOut:
            w = judge(w, limits, gaps=True)
            state.remove()
        else:
            newest = state.getCurrentWatermarkMs()
            for step, area, score, at in (r for b in batches for r in zip(*(b[c].tolist() for c in ("step", "area", "score", "at")), strict=True)):
                newest = max(newest, int(at))
                if w["stop"] is None and step >= w["next"] and step <= limits.max_slices:
                    w["waiting"].setdefault(str(int(step)), (float(area), float(score)))
                w["seen"] += 1
            w = judge(w, limits)
            state.update((json.dumps(w),))
            state.setTimeoutTimestamp(newest + gap)
        if w["next"] > 1 and (w["kept"], w["stop"], w["next"]) != before:
            yield pd.DataFrame({"walk_id": [key[0]], "kept": [w["kept"]], "stop": [w["stop"] or "edge"], "version": [w["next"] * 2 + bool(w["stop"])]})

    known = slices.filter(F.col("walk_id").isNotNull() & F.col("step").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    columns = known.select("walk_id", "step", F.col("area").cast("double"), F.col("score").cast("double"), F.unix_millis("ts").alias("at"), "ts")
    return columns.groupBy("walk_id").applyInPandasWithState(run, OUT, "json string", "update", GroupStateTimeout.EventTimeTimeout)
