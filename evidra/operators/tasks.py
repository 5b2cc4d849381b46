"""Checks on a task graph given as (task, dep) edges: unknown dependencies, readiness, cycles, generated queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.shared import cut, drop


def orphans(edges: DataFrame, tasks: DataFrame) -> DataFrame:
    """Dependencies that are no tasks, with the tasks that name them."""
    return edges.where("dep IS NOT NULL").join(tasks.select(F.col("task").alias("dep")).distinct(), "dep", "left_anti").select("task", "dep")


def ready(edges: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks that are not done and whose dependencies all are; tasks has task, done, priority."""
    deps = edges.where("dep IS NOT NULL").join(tasks.select(F.col("task").alias("dep"), F.col("done").alias("dep_done")), "dep", "left")
    open_ = deps.groupBy("task").agg(F.bool_and(F.coalesce("dep_done", F.lit(False))).alias("all_done")).where("NOT all_done").select("task")
    return tasks.where("NOT done").join(open_, "task", "left_anti").select("task", "priority")


def walks(single: DataFrame) -> list[DataFrame]:
    """Where tasks with one dependency each lead, by pointer doubling: (task, at, depth, open) after 1, 2, 4 ... steps, a row
    a task. A walk stops at what is no task of single; walks still open in the last table never stop, as they run in a cycle."""
    n, steps = single.count(), 1
    found = [cut(single.select("task", F.col("dep").alias("at"), F.lit(1).cast("long").alias("depth"), F.lit(True).alias("open")), "walks")]
    while steps < 2 * n and not found[-1].where("open").isEmpty():
        now = found[-1]
        to = now.select(F.col("task").alias("at"), F.col("at").alias("to"), F.col("depth").alias("more"), F.lit(True).alias("met"))
        far = now.where("open").join(to, "at", "left").select(
            "task", F.when(F.col("met"), F.col("to")).otherwise(F.col("at")).alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("met", F.lit(False)).alias("open")
        )
        found.append(cut(now.where("NOT open").unionByName(far), "walks"))
        steps *= 2
    return found


def branches(edges: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Tasks with several dependencies; the walks of the others; and each dependency of the first with where its walk stops:
    task, dep, at, depth, open."""
    edges = cut(edges.select("task", "dep").distinct(), "edges")
    branch = cut(edges.groupBy("task").agg(F.count("*").alias("n")).where("n > 1").select("task"), "branches")
    steps = walks(edges.join(branch, "task", "left_anti"))
    last = steps[-1].select(F.col("task").alias("dep"), "at", "depth", "open", F.lit(True).alias("met"))
    way = edges.join(branch, "task").join(last, "dep", "left")
    way = way.select("task", "dep", F.when(F.col("met"), F.col("at")).otherwise(F.col("dep")).alias("at"), (1 + F.coalesce("depth", F.lit(0))).alias("depth"), F.coalesce("open", F.lit(False)).alias("open"))
    way = cut(way, "ways")
    drop(edges)
    return branch, steps, way


def renamed(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


#: Walks kept at most for each edge; beyond it tasks are settled level by level.
GROWTH = 16


def long_walks(edges: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """(task, at) tables: from which task a walk of exactly 1, 2, 4 ... edges leads where, each pair once, made by doubling until no walk
    is so long; and the tasks whose walks never end, where there are any, as they run into a cycle. An empty list where walks lead to so many
    places that the tables would grow beyond GROWTH times the edges."""
    found = [cut(edges.select("task", F.col("dep").alias("at")).distinct(), "walks")]
    size = found[0].agg(F.count("*"), F.count_distinct("task")).first()
    steps = 1
    while True:
        now = found[-1]
        longer = cut(now.join(renamed(now, task="at", at="to"), "at").select("task", F.col("to").alias("at")).distinct(), "walks")
        steps, n = 2 * steps, longer.count()
        if not n:
            drop(longer)
            return found, None
        if steps > size[1]:  # longer than all tasks in a row
            return found, cut_and_drop(longer.select("task").distinct(), longer)
        if n > GROWTH * size[0]:
            drop(longer, *found)
            return [], None
        found.append(longer)


def cut_and_drop(out: DataFrame, *tables: DataFrame) -> DataFrame:
    kept = cut(out, "kept")
    drop(*tables)
    return kept


def ancestors(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """task, root, depth: each task's last ancestor, along the longest way where there are several; no root and no depth where
    a way runs into a cycle. Walks are doubled in length, and then each task goes as far as any of its walks does, longest ones first:
    two rounds for each doubling of the depth. Graphs in which walks of one length lead to very many places are settled by a round
    for each level of tasks with several dependencies."""
    tables, lost = long_walks(edges.where("dep IS NOT NULL"))
    if not tables:
        return by_levels(spark, edges)
    at = tables[0].select("task").distinct().withColumns({"at": F.col("task"), "depth": F.lit(0)})
    if lost is not None:
        at = at.join(lost, "task", "left_anti")
    at = cut(at, "at")
    for k in reversed(range(len(tables))):
        on = at.join(renamed(tables[k], task="at", at="to"), "at").select("task", F.col("to").alias("at"), (F.col("depth") + 2**k).alias("depth")).distinct()
        on = cut(on, "at")
        at = cut_and_drop(on.unionByName(at.join(on.select("task").distinct(), "task", "left_anti")), on, at)
    out = at.groupBy("task").agg(F.max("at").alias("root"), F.max("depth").cast("int").alias("depth"))
    if lost is not None:
        out = out.unionByName(lost.select("task", F.lit(None).cast(out.schema["root"].dataType).alias("root"), F.lit(None).cast("int").alias("depth")))
    return cut_and_drop(out, at, *tables, *([lost] if lost is not None else []))


def by_levels(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """ancestors() by a round for each doubling of the chains' length, and for each level of tasks with several dependencies."""
    branch, steps, way = branches(edges)
    known = spark.createDataFrame([], T.StructType([T.StructField("task", branch.schema["task"].dataType), T.StructField("root", way.schema["at"].dataType), T.StructField("depth", T.LongType())]))
    inner = renamed(branch, task="at").withColumn("inner", F.lit(True))
    tables = []
    while True:
        reached = way.join(inner, "at", "left").join(renamed(known, task="at", root="root", depth="more"), "at", "left")
        fixed = ~F.col("open") & (F.col("inner").isNull() | F.col("more").isNotNull())
        best = F.max(F.struct((F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.when(F.col("more").isNull(), F.col("at")).otherwise(F.col("root")).alias("root")))
        new = reached.groupBy("task").agg(F.bool_and(fixed).alias("fixed"), best.alias("best")).where("fixed").join(known, "task", "left_anti")
        new = cut(new.select("task", "best.root", "best.depth"), "levels")
        if new.isEmpty():
            drop(new)
            break
        known = cut(known.unionByName(new), "levels")
        drop(new, *tables)
        tables = [known]
    ends = steps[-1].join(inner, "at", "left").join(renamed(known, task="at", root="root", depth="more"), "at", "left")
    lost = F.col("open") | (F.col("inner").isNotNull() & F.col("more").isNull())
    single = ends.select(
        "task", F.when(~lost, F.when(F.col("more").isNull(), F.col("at")).otherwise(F.col("root"))).alias("root"), F.when(~lost, F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
    )
    return cut_and_drop(single.unionByName(branch.join(known, "task", "left")).withColumn("depth", F.col("depth").cast("int")), branch, way, *steps, *tables)


#: Rounds of peeling go on while each takes away at least this share of the edges.
PEELED = 1 / 8


def peeled(edges: DataFrame) -> DataFrame:
    """edges (task, dep) as a table, without those that are on no cycle because nothing needs their task or their dep needs nothing. All
    rounds together look at a few times the edges, as each leaves less; what a round hardly changes, such as long chains, is left."""
    edges = cut(edges, "peeled")
    n, before = edges.count(), 0
    while n and (not before or before - n >= PEELED * before):
        needed, needing = edges.select(F.col("dep").alias("task")), edges.select(F.col("task").alias("dep"))
        edges = cut_and_drop(edges.join(needed, "task", "left_semi").join(needing, "dep", "left_semi").select("task", "dep"), edges)
        n, before = edges.count(), n
    return edges


def cyclic(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Tasks on a cycle, with the length of the shortest one through them.

    What is on no cycle is peeled first, as far as that goes quickly. Tasks with one dependency are followed by pointer doubling. What never stops leads to a cycle of such tasks alone: its
    tasks are where all walks are after as many steps as there are tasks. All other cycles have tasks with several
    dependencies: the graph of these, its edges as long as the walks between, is peeled from both ends, and only in what is
    left are the shortest ways between all pairs sought."""
    all_ = edges = cut(edges.where("dep IS NOT NULL").select("task", "dep").distinct(), "edges")
    self_ = edges.where("task = dep").select("task", F.lit(1).cast("long").alias("length"))
    inner = peeled(edges.where("task <> dep"))
    branch, steps, way = branches(inner)
    on = steps[-1].where("open").select(F.col("at").alias("task")).distinct()
    least = steps[0].join(on, "task", "left_semi").select("task", F.col("task").alias("least"))
    used = [all_, inner, branch, way, *steps]
    for s in steps:  # the least task of the first 1, 2, 4 ... of a walk
        then = s.join(renamed(least, task="at", least="then"), "at").select("task", "then")
        used.append(least := cut(least.join(then, "task").select("task", F.least("least", "then").alias("least")), "cycles"))
    alone = least.join(least.groupBy("least").agg(F.count("*").alias("length")), "least").select("task", "length")

    core = cut(way.where("NOT open").join(renamed(branch, task="at"), "at", "left_semi").select("task", "dep", "at", "depth"), "core")
    used.append(core)
    n = core.count()
    while n:
        kept = core.join(core.select("task").withColumnRenamed("task", "at").distinct(), "at", "left_semi").join(core.select("at").withColumnRenamed("at", "task").distinct(), "task", "left_semi")
        core, before = cut(kept.select("task", "dep", "at", "depth"), "core"), n
        used.append(core)
        n = core.count()
        if n == before:
            break
    if not n:
        return cut_and_drop(shortest(self_.unionByName(alone)), *used)
    ways = cut(core.groupBy("task", "at").agg(F.min("depth").alias("depth")), "pairs")
    size = None
    while size != (size := tuple(ways.agg(F.count("*"), F.sum("depth")).first())):
        longer = ways.join(renamed(ways, task="at", at="to", depth="more"), "at").select("task", F.col("to").alias("at"), (F.col("depth") + F.col("more")).alias("depth"))
        ways = cut_and_drop(ways.unionByName(longer).groupBy("task", "at").agg(F.min("depth").alias("depth")), ways)
    back = renamed(ways, task="at", at="task", depth="more")
    through = cut(core.join(back, ["task", "at"], "left").select("task", "dep", F.when(F.col("task") == F.col("at"), F.col("depth")).otherwise(F.col("depth") + F.col("more")).alias("length")).where("length IS NOT NULL"), "through")
    used += [ways, through]
    chain = shortest(renamed(through, dep="task", length="length"))
    for s in steps:  # a cycle that enters a walk goes through all of it
        onward = s.join(chain, "task").select(F.col("at").alias("task"), "length")
        used.append(chain := cut(shortest(chain.unionByName(onward)), "through"))
    found = shortest(self_.unionByName(alone).unionByName(through.select("task", "length")).unionByName(chain.join(branch, "task", "left_anti")))
    return cut_and_drop(found, *used)


def shortest(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("task").agg(F.min("length").cast("int").alias("length"))


def generated(template: DataFrame, items: DataFrame) -> DataFrame:
    """A queue: each template role for each item; templates are few."""
    return items.crossJoin(F.broadcast(template)).select(F.concat_ws("-", "role", "item").alias("task_id"), "role", "item", "priority")
