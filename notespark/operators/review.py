"""Spaced repetition: due queues and the fold of reviews into memory states.

The step of the FSRS-6 scheduler is one SQL expression over the state before and a review; a state
is folded over a schedule's reviews in time order with ``aggregate``, without leaving the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import defaults as d
from ..tables import kept
from .store import with_ids

AGAIN, HARD, GOOD, EASY = 1, 2, 3, 4


def step_sql(s: str, dif: str, days: str, rating: str) -> tuple[str, str]:
    """Expressions of stability and difficulty after a review; ``s`` is null before the first one."""
    w = d.FSRS_WEIGHTS
    start = f"(CASE {rating} WHEN 1 THEN {w[0]}D0 WHEN 2 THEN {w[1]}D0 WHEN 3 THEN {w[2]}D0 ELSE {w[3]}D0 END)".replace("D0", "e0")
    first = lambda g: f"greatest(1e0, least(10e0, {w[4]}e0 - exp({w[5]}e0 * ({g} - 1)) + 1e0))"
    factor = 0.9 ** (-1 / w[20]) - 1
    recall = f"power(1e0 + {factor!r}e0 * {days} / {s}, -{w[20]}e0)"
    bonus = f"(CASE {rating} WHEN 2 THEN {w[15]}e0 WHEN 4 THEN {w[16]}e0 ELSE 1e0 END)"
    success = f"{s} * (1e0 + exp({w[8]}e0) * (11e0 - {dif}) * power({s}, -{w[9]}e0) * (exp({w[10]}e0 * (1e0 - {recall})) - 1e0) * {bonus})"
    lapse = f"least({w[11]}e0 * power({dif}, -{w[12]}e0) * (power({s} + 1e0, {w[13]}e0) - 1e0) * exp({w[14]}e0 * (1e0 - {recall})), {s} / exp({w[17] * w[18]!r}e0))"
    growth = f"exp({w[17]}e0 * ({rating} - 3 + {w[18]}e0)) * power({s}, -{w[19]}e0)"
    same_day = f"{s} * (CASE WHEN {rating} >= 3 THEN greatest({growth}, 1e0) ELSE {growth} END)"
    later = f"CASE WHEN {days} = 0 THEN {same_day} WHEN {rating} = 1 THEN {lapse} ELSE {success} END"
    stability = f"greatest(1e-3, least(36500e0, CASE WHEN {s} IS NULL THEN {start} ELSE {later} END))"
    moved = f"{dif} - {w[6]}e0 * ({rating} - 3) * (10e0 - {dif}) / 9e0"
    reverted = f"{w[7]}e0 * {first(4)} + {1 - w[7]!r}e0 * ({moved})"
    difficulty = f"CASE WHEN {s} IS NULL THEN {first(rating)} ELSE greatest(1e0, least(10e0, {reverted})) END"
    return stability, difficulty


def next_memory(s: float | None, dif: float | None, days: int, rating: int) -> tuple[float, float]:
    """The same step as ``step_sql`` on plain numbers, for streams that keep states."""
    w = d.FSRS_WEIGHTS
    hold = lambda low, x, high: max(low, min(high, x))
    first = lambda g: hold(1.0, w[4] - math.exp(w[5] * (g - 1)) + 1, 10.0)
    if s is None:
        return hold(1e-3, w[hold(1, rating, 4) - 1], 36500.0), first(rating)
    recall = (1 + (0.9 ** (-1 / w[20]) - 1) * days / s) ** -w[20]
    if days == 0:
        growth = math.exp(w[17] * (rating - 3 + w[18])) * s ** -w[19]
        after = s * (max(growth, 1.0) if rating >= GOOD else growth)
    elif rating == AGAIN:
        after = min(w[11] * dif ** -w[12] * ((s + 1) ** w[13] - 1) * math.exp(w[14] * (1 - recall)), s / math.exp(w[17] * w[18]))
    else:
        bonus = {HARD: w[15], EASY: w[16]}.get(rating, 1.0)
        after = s * (1 + math.exp(w[8]) * (11 - dif) * s ** -w[9] * (math.exp(w[10] * (1 - recall)) - 1) * bonus)
    moved = dif - w[6] * (rating - 3) * (10 - dif) / 9
    return hold(1e-3, after, 36500.0), hold(1.0, w[7] * first(4) + (1 - w[7]) * moved, 10.0)


def fold_reviews(reviews: DataFrame) -> DataFrame:
    """``reviews``: schedule_id, reviewed_at (seconds), review_id, rating.  One row a schedule:
    stability, difficulty, reps, lapses, state, last_reviewed, next_review.
    """
    ordered = F.array_sort(F.collect_list(F.struct("reviewed_at", "review_id", "rating"))).alias("events")
    stability, difficulty = step_sql("a.s", "a.d", "greatest(floor((e.reviewed_at - a.at) / 86400), 0)", "e.rating")
    init = "named_struct('s', cast(null AS double), 'd', cast(null AS double), 'at', cast(null AS bigint), 'reps', 0L, 'lapses', 0L)"
    merge = (
        f"named_struct('s', cast({stability} AS double), 'd', cast({difficulty} AS double), 'at', e.reviewed_at, "
        "'reps', a.reps + 1L, 'lapses', a.lapses + CASE WHEN e.rating = 1 THEN 1L ELSE 0L END)"
    )
    folded = reviews.groupBy("schedule_id").agg(ordered).withColumn("m", F.expr(f"aggregate(events, {init}, (a, e) -> {merge})"))
    return folded.select(
        "schedule_id",
        F.col("m.s").alias("stability"),
        F.col("m.d").alias("difficulty"),
        F.col("m.reps").alias("reps"),
        F.col("m.lapses").alias("lapses"),
        F.when(F.col("m.reps") == 1, "learning").otherwise("review").alias("state"),
        F.col("m.at").alias("last_reviewed"),
        (F.col("m.at") + (F.col("m.s") * 86400).cast("long")).alias("next_review"),
    )


def due(schedules: DataFrame, now: int, limit: int | None = None) -> DataFrame:
    found = schedules.where(F.col("next_review") <= now)
    return found if limit is None else found.orderBy("next_review", "schedule_id").limit(limit)


def rescheduled(schedules: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    """``schedules`` with next reviews ``days`` from now for the targets in ``requests`` (target_type,
    target_id, days); targets without a schedule get a new one, with an id of its own.  Of several requests
    for a target the soonest counts; one without a target or days does nothing.
    """
    keys = ["target_type", "target_id"]
    wanted = requests.where("target_type IS NOT NULL AND target_id IS NOT NULL AND days IS NOT NULL").groupBy(*keys).agg(F.min("days").alias("days"))
    at = F.lit(now) + (F.col("days") * 86400).cast("long")
    moved = schedules.join(wanted, keys, "left").withColumn("next_review", F.when(F.col("days").isNotNull(), at).otherwise(F.col("next_review")))
    absent = kept(wanted.join(schedules.select(*keys), keys, "left_anti").withColumn("next_review", at).withColumn("state", F.lit("new")).drop("days"))
    return moved.drop("days").unionByName(with_ids(absent, schedules, "schedule_id", *keys), allowMissingColumns=True)
