"""Execution statistics of tools and the adaptive debounce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLEAN_RUNS, DIRTY_RUNS, UP, DOWN, LEAST, MOST = 5, 3, 1.1, 0.9, 0.5, 2.0
KEY = ("linter_name", "work_dir")


def summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*KEY).agg(
        F.count("*").alias("runs"),
        F.avg("duration_ms").alias("avg_ms"),
        F.sum("violation_count").alias("violations"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.max("executed_at").alias("last_run"),
        F.max_by("duration_ms", F.struct("executed_at", "duration_ms")).alias("last_ms"),
    )


def record(runs: DataFrame, new: DataFrame) -> DataFrame:
    """Appends executions; one per tool, folder and time, the recorded one first."""
    known = runs.select(*KEY, "executed_at")
    fresh = new.dropDuplicates([*KEY, "executed_at"]).join(known, [*KEY, "executed_at"], "left_anti")
    return runs.unionByName(fresh)


def islands(runs: DataFrame, *order: str) -> DataFrame:
    """KEY, island, clean, n: maximal stretches of equal outcome (clean or not) of each tool's runs in the
    given order, which starts with executed_at, numbered from one. Stretches are found within days first,
    so that no window is larger than a day of one tool and folder; days are then joined by their first and
    last outcomes. A null violation count isn't clean."""
    day = [*KEY, "day"]
    w = Window.partitionBy(*day).orderBy(*order)
    clean = F.coalesce(F.col("violation_count") == 0, F.lit(False))
    seconds = dict(runs.dtypes)["executed_at"] in ("int", "bigint", "double")  # times may be numbers too
    marked = runs.withColumns({"day": F.floor(F.col("executed_at") / 86_400) if seconds else F.to_date("executed_at"), "clean": clean})
    marked = marked.withColumn("change", F.coalesce(F.lag("clean").over(w) != F.col("clean"), F.lit(True)).cast("int"))
    local = marked.withColumn("local", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*day, "local", "clean").agg(F.count("*").alias("n"))
    v = Window.partitionBy(*KEY).orderBy("day")
    days = local.groupBy(*day).agg(F.max("local").alias("most"), F.min_by("clean", "local").alias("first"), F.max_by("clean", "local").alias("last"))
    joined = days.withColumn("joined", F.coalesce(F.lag("last").over(v) == F.col("first"), F.lit(False)).cast("int"))
    before = F.coalesce(F.sum(F.col("most") - F.col("joined")).over(v.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = joined.select(*day, (before - F.col("joined")).alias("shift"))
    return local.join(shifts, day).groupBy(*KEY, (F.col("shift") + F.col("local")).alias("island"), "clean").agg(F.sum("n").alias("n"))


def adaptation(runs: DataFrame, start: float = 1.0) -> DataFrame:
    """factor, clean and dirty: the state after folding each tool's runs by time. After CLEAN_RUNS
    clean runs in a row every clean run raises the factor, after DIRTY_RUNS dirty ones every dirty
    run lowers it. Only stretches long enough to move the factor are folded, each in one step, as the
    factor moves one way within a stretch."""
    found = islands(runs, "executed_at", "violation_count")
    steps = F.when(F.col("clean"), F.col("n") - (CLEAN_RUNS - 1)).otherwise(F.col("n") - (DIRTY_RUNS - 1))
    moves = F.array_sort(F.collect_list(F.when(steps > 0, F.struct("island", "clean", steps.alias("steps")))))

    def step(factor: Column, move: Column) -> Column:
        up = F.least(F.lit(MOST), factor * F.pow(F.lit(UP), move["steps"]))
        return F.when(move["clean"], up).otherwise(F.greatest(F.lit(LEAST), factor * F.pow(F.lit(DOWN), move["steps"])))

    last = F.max(F.struct("island", "clean", "n")).alias("last")
    folded = found.groupBy(*KEY).agg(F.aggregate(moves, F.lit(start), step).alias("factor"), last)
    streak = lambda clean: F.when(F.col("last.clean") == clean, F.col("last.n")).otherwise(0).cast("int")
    return folded.select(*KEY, "factor", streak(True).alias("clean"), streak(False).alias("dirty"))


def base_debounce(avg_ms: Column) -> Column:
    """Seconds by the average duration; five minutes without runs."""
    bands = ((100, 0), (1_000, 5), (30_000, 300), (300_000, 3_600), (900_000, 10_800))
    out = F.when(avg_ms.isNull(), 300)
    for below, seconds in bands:
        out = out.when(avg_ms < below, seconds)
    return out.otherwise(28_800)


def debounce(runs: DataFrame, now: Column, start: float = 1.0) -> DataFrame:
    """debounce_s from the last seven days' average and the adaptation factor, a day at most."""
    recent = runs.where(F.col("executed_at") >= now - F.expr("INTERVAL 7 DAYS")).groupBy(*KEY).agg(F.avg("duration_ms").alias("avg_ms"), F.count("*").alias("recent_runs"))
    state = adaptation(runs, start)
    joined = state.join(recent, list(KEY), "left")
    seconds = F.least(base_debounce(F.col("avg_ms")) * F.col("factor"), F.lit(86_400.0))
    return joined.select(*KEY, "factor", F.coalesce("recent_runs", F.lit(0)).alias("recent_runs"), seconds.alias("debounce_s"))


def should_skip(runs: DataFrame, now: Column, explicit_s: float | None = None) -> DataFrame:
    """skip: the last run is more recent than the debounce; a configured one beats the adaptive."""
    last = runs.groupBy(*KEY).agg(F.max("executed_at").alias("last_run"))
    limits = last.withColumn("debounce_s", F.lit(explicit_s)) if explicit_s is not None else last.join(debounce(runs, now).select(*KEY, "debounce_s"), list(KEY))
    since = F.timestamp_diff("SECOND", F.col("last_run"), now)
    return limits.select(*KEY, "last_run", "debounce_s", (since < F.col("debounce_s")).alias("skip"))


def category(avg_ms: Column) -> Column:
    return F.when(avg_ms < 1_000, "Fast").when(avg_ms < 5_000, "Medium").when(avg_ms < 15_000, "Slow").otherwise("Very Slow")


def streaks(runs: DataFrame) -> DataFrame:
    """Runs of equal outcome (clean or not) per tool, in order."""
    return islands(runs, "executed_at", "duration_ms").withColumnRenamed("n", "runs")


def enabled(settings: DataFrame) -> DataFrame:
    """linter: the tools that some configuration enables, each once."""
    return settings.where("enabled").select(F.col("linter_name").alias("linter")).distinct()
