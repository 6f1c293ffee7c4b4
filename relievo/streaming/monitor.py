"""Run progress from heartbeats and logs, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.base import as_col

STALE_S = 180.0
DONE_SHARE = 0.999


def run_state(step, steps, age_s) -> Column:
    """done beats stalled beats running."""
    share = as_col(step) / F.greatest(as_col(steps), F.lit(1))
    return (F.when(share >= DONE_SHARE, "done").when(as_col(age_s) > STALE_S, "stalled")
            .otherwise("running"))


def latest(heartbeats: DataFrame, keys=("run",), order: str = "updated") -> DataFrame:
    """The last heartbeat of each run; `max_by` combines before the shuffle."""
    rest = [c for c in heartbeats.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(order, "step")).alias("_h")
    return heartbeats.groupBy(*keys).agg(picked).select(*keys, "_h.*")


def status(heartbeats: DataFrame, now, keys=("run",)) -> DataFrame:
    """Latest heartbeat per run with its state, share done and remaining seconds.

    `updated` and `now` are epoch seconds.
    """
    h = latest(heartbeats, keys)
    age = as_col(now) - F.col("updated")
    state = run_state("step", "steps", age)
    return h.withColumns({
        "age_s": age, "share": F.col("step") / F.greatest(F.col("steps"), F.lit(1)), "state": state,
        "eta_s": F.when(state == "running", F.greatest(
            F.col("seconds_per_step") * (F.col("steps") - F.col("step")), F.lit(0.0)))})


def progress_from_logs(lines: DataFrame, text: str = "line", keys=("run",), order: str = "pos") -> DataFrame:
    """Progress of runs that only left a log: last step line, total steps and finish marker."""
    # A line is words; "name=value" words are fields, and a word like "(2.5s/step)" is a pace.
    words = F.split(F.trim(text), "[ \\t]+")
    named = F.filter(words, lambda w: w.contains("="))
    given = F.get(F.filter(named, lambda w: F.substring_index(w, "=", 1) == "steps"), 0)
    paces = F.filter(words, lambda w: w.startswith("(") & w.endswith("s/step)"))
    head = F.array_join(F.slice(words, 1, 2), " ")
    number = F.expr("try_cast(get(_words, 1) as bigint)")
    d = lines.withColumns({
        "_words": words, "_given": F.substring_index(given, "=", -1), "_pace": F.substring_index(F.substring_index(F.get(paces, 0), "s/step)", 1), "(", -1),
        "_done": (head == "final val") | (head == "=== EVAL")})
    told = (F.get("_words", 0) == "step") & F.expr("try_cast(_pace as double)").isNotNull()
    d = d.withColumns({"_total": F.expr("try_cast(_given as bigint)"), "_step": F.when(told, number),
                       "_rate": F.when(told, F.expr("try_cast(_pace as double)"))})
    out = d.groupBy(*keys).agg(
        F.max_by("_step", F.when(F.col("_step").isNotNull(), F.col(order))).alias("step"),
        F.max_by("_rate", F.when(F.col("_step").isNotNull(), F.col(order))).alias("seconds_per_step"),
        F.max_by("_total", F.when(F.col("_total").isNotNull(), F.col(order))).alias("steps"),
        F.bool_or("_done").alias("finished"))
    out = out.where(F.col("step").isNotNull() & (F.col("steps") > 0))
    return out.withColumn("step", F.when(F.col("finished"), F.col("steps")).otherwise(F.col("step"))).withColumn(
        "eta_s", F.when(F.col("finished"), F.lit(0.0)).otherwise(
            F.col("seconds_per_step") * (F.col("steps") - F.col("step"))))


def with_logs(heartbeats: DataFrame, logged: DataFrame, keys=("run",)) -> DataFrame:
    """Heartbeat rows, plus log rows of the runs that have no heartbeat."""
    return heartbeats.unionByName(logged.join(heartbeats.select(*keys), list(keys), "left_anti"),
                                  allowMissingColumns=True)


def status_stream(heartbeats: DataFrame, stale_s: float = STALE_S, forget_s: float = 86_400.0, mode: str = "update") -> DataFrame:
    """State changes of each run from a stream of (run, step, steps, seconds_per_step, updated).

    The state per run is its last heartbeat; a processing-time timeout reports `stalled` when
    none follows. With mode "append" the changes can go to a log of files. A finished run keeps a marker for `forget_s`, so a late older beat is not reported.
    """
    out = "run string, step bigint, steps bigint, state string, eta_s double"
    state = "step bigint, steps bigint, rate double, updated double"

    def track(key, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            step, steps, _, _ = held.get
            held.remove()
            if step / max(steps, 1) >= DONE_SHARE:
                return  # the marker of a finished run
            yield pd.DataFrame([(key[0], step, steps, "stalled", None)], columns=["run", "step", "steps", "state", "eta_s"])
            return
        step, steps, rate, updated = held.get if held.exists else (-1, 0, 0.0, float("-inf"))
        if held.exists and step / max(steps, 1) >= DONE_SHARE:
            held.setTimeoutDuration(int(forget_s * 1000))
            return
        for pdf in batches:
            last = pdf.sort_values(["updated", "step"]).iloc[-1]
            if (last["updated"], last["step"]) >= (updated, step):
                step, steps = int(last["step"]), int(last["steps"])
                rate, updated = float(last["seconds_per_step"]), float(last["updated"])
        done = step / max(steps, 1) >= DONE_SHARE
        held.update((step, steps, rate, updated))
        held.setTimeoutDuration(int((forget_s if done else stale_s) * 1000))
        yield pd.DataFrame([(key[0], step, steps, "done" if done else "running",
                             0.0 if done else max(rate * (steps - step), 0.0))],
                           columns=["run", "step", "steps", "state", "eta_s"])

    return heartbeats.groupBy("run").applyInPandasWithState(
        track, out, state, mode, GroupStateTimeout.ProcessingTimeTimeout)
