"""Dependency graphs of tasks: schedules, slack and the critical path, for all graphs at once."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, IntegralType, LongType, NullType, StructField, StructType

from millrace.operators import layout
from millrace.operators.arrow import map_arrow
from millrace.sources.sinks import written


def longest_paths(tasks: DataFrame, edges: DataFrame, start: str, end: str, extend: tuple[str, ...] = ()) -> DataFrame:
    """(dag, task, at, path): the longest way along edges to each task, summed over the durations of the tasks before it.

    The tasks reached by k edges follow from those by k - 1 by one join and one grouped maximum. Levels are written out,
    until one is empty. A way over more edges than its graph has tasks runs in a cycle, which is an error.
    ``tasks`` and ``edges`` are read once a level, so they had better be tables. ``path`` are the tasks of that way in order, of several as long the greatest; it is kept only if ``extend`` names it.
    """
    weighted = written(edges.join(tasks.select("dag", F.col("task").alias(start), "duration"), ["dag", start]).select("dag", F.col(start).alias("_from"), F.col(end).alias("_to"), "duration"))
    most = tasks.groupBy("dag").count().agg(F.max("count")).first()[0] or 0
    task = F.col("task")
    path = [F.array(task).alias("path")] if "path" in extend else []
    level = tasks.select("dag", "task", F.lit(0).cast("long").alias("at"), *path)
    levels = [level]
    while not level.isEmpty():
        if len(levels) > most:
            raise ValueError("the graph has a cycle")
        onward = weighted.join(level.withColumnRenamed("task", "_from"), ["dag", "_from"]).withColumn("at", F.col("at") + F.col("duration"))
        grouped = onward.groupBy("dag", F.col("_to").alias("task"))
        if path:
            best = grouped.agg(F.max(F.struct("at", "path")).alias("_b"))
            level = written(best.select("dag", "task", "_b.at", F.concat("_b.path", F.array("task")).alias("path")))
        else:
            level = written(grouped.agg(F.max("at").alias("at")))
        levels.append(level)
    found = reduce(DataFrame.union, levels)
    if path:
        return found.groupBy("dag", "task").agg(F.max(F.struct("at", "path")).alias("_b")).select("dag", "task", "_b.*")
    return found.groupBy("dag", "task").agg(F.max("at").alias("at"))


#: Tasks and edges up to which a graph is laid out in one worker's memory (about 300 bytes for each); larger ones go by joins.
LARGE = 1 << 20


def slack(tasks: DataFrame, edges: DataFrame, large: int = LARGE) -> DataFrame:
    """(dag, task, duration, early_start, early_finish, late_start, late_finish, slack, makespan) for every graph at once.

    ``tasks`` (dag, task, duration), ``edges`` (dag, task, upstream); edges from or to what is no task do not count. Graphs
    may be of any depth; a cycle is an error. Each graph's rows meet in one worker by a single shuffle and are laid out there;
    graphs of more than ``large`` rows, and durations that are neither whole nor double, go level by level instead.
    """
    if not _whole(tasks) and not isinstance(tasks.schema["duration"].dataType, DoubleType):
        return _finished(_by_levels(tasks, edges))
    laid, rest = _laid_out(tasks, edges, large)
    plan = laid.select("dag", "task", "duration", F.col("at").alias("early_start"), "tail", "makespan")
    if rest:
        plan = plan.union(_by_levels(*rest).select(*plan.columns))
    return _finished(plan)


def _whole(tasks: DataFrame) -> bool:
    return isinstance(tasks.schema["duration"].dataType, IntegralType)


def _finished(plan: DataFrame) -> DataFrame:
    late = plan.withColumn("early_finish", F.col("early_start") + F.col("duration")).withColumn("late_finish", F.col("makespan") - F.col("tail"))
    late = late.withColumn("late_start", F.col("late_finish") - F.col("duration")).withColumn("slack", F.col("late_start") - F.col("early_start"))
    return late.select("dag", "task", "duration", "early_start", "early_finish", "late_start", "late_finish", "slack", "makespan")


def _laid_out(tasks: DataFrame, edges: DataFrame, large: int, shorter: Column | None = None) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """(dag, task, duration, at, tail, makespan, sooner) of the graphs of at most about ``large`` rows, and the larger ones' tasks and edges."""
    # What compares a task with an upstream also holds both.
    name = tasks.select("task").union(edges.select("task")).union(edges.select("upstream")).schema[0].dataType
    length = tasks.schema["duration"].dataType
    null = F.lit(None)
    nodes = tasks.select("dag", F.col("task").cast(name).alias("task"), "duration", (null if shorter is None else shorter).cast("long").alias("shorter"), null.cast(name).alias("upstream"), F.lit(False).alias("edge"))
    links = edges.select("dag", F.col("task").cast(name).alias("task"), null.cast(length).alias("duration"), null.cast("long").alias("shorter"), F.col("upstream").cast(name).alias("upstream"), F.lit(True).alias("edge"))
    rows = nodes.union(links.where("upstream is not null")).where("dag is not null and task is not null")
    sums = LongType() if _whole(tasks) else DoubleType()
    kinds = [*[rows.schema[c] for c in ("dag", "task", "duration")], *[StructField(c, sums) for c in ("at", "tail", "makespan", "sooner")], StructField("state", IntegerType())]
    run = partial(layout.lay_out, most=large, shortened=shorter is not None)
    laid = written(map_arrow(rows.repartition("dag").sortWithinPartitions("dag"), run, StructType([StructField(f.name, f.dataType) for f in kinds])))
    states = {r.state for r in laid.where(F.col("state") != layout.FINE).select("state").distinct().collect()}
    if layout.CYCLE in states:
        raise ValueError("the graph has a cycle")
    # Ids as they came, where those of edges made them wider.
    back = [F.col(c) if laid.schema[c].dataType.simpleString() == (kind := tasks.schema[c].dataType).simpleString() else F.col(c).cast(kind).alias(c) for c in ("dag", "task")]
    fine = laid.where(F.col("state") == layout.FINE).select(*back, "duration", "at", "tail", "makespan", "sooner")
    if layout.LARGE not in states:
        return fine, None
    dags = laid.where(F.col("state") == layout.LARGE).select("dag").distinct()
    return fine, (written(tasks.join(dags, "dag", "left_semi")), written(edges.join(dags, "dag", "left_semi")))


def _by_levels(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(dag, task, duration, early_start, tail, makespan) by joins, a level at a time."""
    tasks, edges = written(tasks.select("dag", "task", "duration")), edges.select("dag", F.col("task").alias("downstream"), "upstream")
    for end in ("downstream", "upstream"):
        edges = edges.join(tasks.select("dag", F.col("task").alias(end)), ["dag", end], "left_semi")
    edges = written(edges)
    ahead = longest_paths(tasks, edges, "upstream", "downstream").withColumnRenamed("at", "early_start")
    behind = longest_paths(tasks, edges, "downstream", "upstream").withColumnRenamed("at", "tail")
    both = written(tasks.join(ahead, ["dag", "task"]).join(behind, ["dag", "task"]))
    return both.join(both.groupBy("dag").agg(F.max(F.col("early_start") + F.col("duration")).alias("makespan")), "dag")


def gains(tasks: DataFrame, edges: DataFrame, shorter: Column, large: int = LARGE) -> DataFrame:
    """(dag, task, duration, makespan, gain): how much sooner each graph would end if that task alone took ``shorter``.

    ``shorter`` is a Column of ``duration``. Only tasks without slack can gain. The end is then that of the longest way through
    the task or of the longest that leaves it out; both are found with the schedule. Graphs of more than ``large`` rows, and
    durations that are not whole, are laid out once for each task without slack: of m tasks of which n have no slack, n * m rows.
    """
    if not _whole(tasks) or not isinstance(tasks.select(shorter.alias("s")).schema["s"].dataType, (IntegralType, NullType)):
        return _gains_by_layouts(tasks, edges, shorter)
    laid, rest = _laid_out(tasks, edges, large, shorter)
    gain = F.coalesce(F.col("makespan") - F.col("sooner"), F.lit(0))
    rows = laid.select("dag", "task", "duration", "makespan", gain.alias("gain"))
    return rows.union(_gains_by_layouts(*rest, shorter).select(*rows.columns)) if rest else rows


def _gains_by_layouts(tasks: DataFrame, edges: DataFrame, shorter: Column) -> DataFrame:
    plan = written(_finished(_by_levels(tasks, edges)))
    changed = plan.where("slack = 0").select("dag", F.col("task").alias("changed"))
    case = F.struct("dag", "changed").alias("dag")
    duration = F.when(F.col("task") == F.col("changed"), shorter).otherwise(F.col("duration"))
    laid = written(plan.join(changed, "dag").select(case, "task", duration.alias("duration")))
    links = written(edges.select("dag", F.col("task").alias("downstream"), "upstream").join(changed, "dag").select(case, "downstream", "upstream"))
    ends = longest_paths(laid, links, "upstream", "downstream").join(laid, ["dag", "task"]).groupBy("dag").agg(F.max(F.col("at") + F.col("duration")).alias("sooner"))
    ends = ends.select("dag.dag", F.col("dag.changed").alias("task"), "sooner")
    gain = F.coalesce(F.col("makespan") - F.col("sooner"), F.lit(0))
    return plan.join(ends, ["dag", "task"], "left").select("dag", "task", "duration", "makespan", gain.alias("gain"))
