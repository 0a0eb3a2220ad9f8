"""Plans as tables: tasks, what they need, and the tools that they call; for all plans at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwright.plans.registry import query
from planwright.sources.tables import table
from planwright.staging import staged

PLACEHOLDER = r"\{\{task_(\d+)_result\}\}"


def levels(tasks: DataFrame, needs: DataFrame) -> DataFrame:
    """(plan, task, level): the length of the longest chain of what each task needs.

    ``tasks``: plan, task. ``needs``: plan, task, needed; what isn't a task of the plan is passed over. Each round takes the tasks that need nothing
    that is left, so there are as many rounds as the longest chain has tasks. Raises ValueError where tasks need each other.
    """
    left = staged(tasks.select("plan", "task").distinct(), "tasks")
    there = left.withColumnRenamed("task", "needed")
    needs = staged(needs.select("plan", "task", "needed").distinct().join(there, ["plan", "needed"], "left_semi").join(left, ["plan", "task"], "left_semi"), "needs")
    out, level = left.select("plan", "task", F.lit(0).alias("level")).where("false"), 0
    while not left.isEmpty():
        ready = staged(left.join(needs, ["plan", "task"], "left_anti"), "ready")
        if ready.isEmpty():
            raise ValueError("tasks need each other")
        out = out.union(ready.select("plan", "task", F.lit(level).alias("level")))
        left = staged(left.join(ready, ["plan", "task"], "left_anti"), "tasks")
        needs = staged(needs.join(ready.withColumnRenamed("task", "needed"), ["plan", "needed"], "left_anti").select("plan", "task", "needed"), "needs")
        level += 1
    return out


def placeholder_needs(tasks: DataFrame) -> DataFrame:
    """(plan, task, needed): the tasks whose results each task's arguments name, itself aside."""
    named = F.transform(F.regexp_extract_all("arguments", F.lit(PLACEHOLDER), F.lit(1)), lambda n: n.cast(tasks.schema["task"].dataType))
    return tasks.select("plan", "task", F.explode(F.array_distinct(named)).alias("needed")).where("task <> needed")


def with_prerequisites(tasks: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks, needs): plans whose tools' prerequisites are in them, and who needs them.

    ``tasks``: plan, task (from 1), tool, arguments. ``rules``: tool, before (the tool that has to come first; one for each tool, a short list). A plan that lacks the
    tool gets one task for it, numbered 0 and downwards in the order of the tools' names; where it has some, the first counts.
    """
    wanted = tasks.join(F.broadcast(rules), "tool").select("plan", "task", "before")  # rules are a short list
    first = tasks.groupBy("plan", F.col("tool").alias("before")).agg(F.min("task").alias("needed"))
    missing = wanted.select("plan", "before").distinct().join(first, ["plan", "before"], "left_anti")
    added = missing.groupBy("plan").agg(F.array_sort(F.collect_set("before")).alias("b")).select("plan", F.posexplode("b").alias("at", "tool"))
    added = added.select("plan", (-F.col("at")).cast(tasks.schema["task"].dataType).alias("task"), "tool", F.lit("").alias("arguments"))
    every = tasks.select("plan", "task", "tool", "arguments").unionByName(added)
    known = first.unionByName(added.select("plan", F.col("tool").alias("before"), F.col("task").alias("needed")))
    return every, wanted.join(known, ["plan", "before"]).where("task <> needed").select("plan", "task", "needed")


def dispatched(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """``calls`` (id, tool, arguments) with ``outcome``: ok, ``unknown tool``, or ``missing argument`` where the tool needs some and there are none.

    ``tools``: tool, needs_arguments; a registry, one row for each tool.
    """
    known = calls.join(F.broadcast(tools), "tool", "left")
    blank = F.trim(F.coalesce("arguments", F.lit(""))) == ""
    outcome = F.when(F.col("needs_arguments").isNull(), "unknown tool").when(F.col("needs_arguments") & blank, "missing argument").otherwise("ok")
    return known.withColumn("outcome", outcome).drop("needs_arguments")


_TASKS = """WITH RECURSIVE t AS (SELECT event_id // 8 AS plan, event_id % 8 + 1 AS task, event_type AS tool, CASE WHEN event_id % 3 = 0 AND event_id % 8 > 0 THEN 'about {{task_' || (event_id % 8) || '_result}} and {{task_1_result}}' ELSE '' END AS arguments FROM events)"""


def plan_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight events are a plan; the type is the tool."""
    k = F.col("event_id") % 8
    said = F.when((F.col("event_id") % 3 == 0) & (k > 0), F.concat(F.lit("about {{task_"), k.cast("string"), F.lit("_result}} and {{task_1_result}}"))).otherwise("")
    return table(spark, sf_dir, "events").select(F.expr("event_id div 8").alias("plan"), (k + 1).alias("task"), F.col("event_type").alias("tool"), said.alias("arguments"))


@query(_TASKS + """, n AS (SELECT plan, task, task - 1 AS needed FROM t WHERE task > 1 AND task % 3 <> 1 UNION SELECT plan, task, task - 3 FROM t WHERE task > 3 AND task % 2 = 0),
l(plan, task, level) AS (SELECT plan, task, 0 FROM t UNION SELECT n.plan, n.task, level + 1 FROM l JOIN n ON n.plan = l.plan AND n.needed = l.task) SELECT plan, task, max(level) AS level FROM l GROUP BY ALL""")
def k13_task_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks of all plans by the longest chain of what they need."""
    t = plan_tasks(spark, sf_dir).select("plan", "task")
    needs = t.where("task > 1 and task % 3 <> 1").withColumn("needed", F.col("task") - 1).unionByName(t.where("task > 3 and task % 2 = 0").withColumn("needed", F.col("task") - 3))
    return levels(t, needs)


@query(_TASKS + """, r(tool, before) AS (VALUES ('purchase', 'signup'), ('error', 'view')), w AS (SELECT plan, task, before FROM t JOIN r USING (tool)), f AS (SELECT plan, tool AS before, min(task) AS needed FROM t GROUP BY ALL),
m AS (SELECT DISTINCT plan, before FROM w ANTI JOIN f USING (plan, before)), a AS (SELECT plan, 1 - row_number() OVER (PARTITION BY plan ORDER BY before) AS task, before AS tool FROM m),
e AS (SELECT plan, task, tool FROM t UNION ALL SELECT * FROM a), k AS (SELECT * FROM f UNION ALL SELECT plan, tool, task FROM a),
n AS (SELECT w.plan, w.task, k.needed FROM w JOIN k USING (plan, before) WHERE w.task <> k.needed UNION SELECT plan, task, CAST(unnest(regexp_extract_all(arguments, 'task_(\\d+)_result', 1)) AS BIGINT) FROM t),
g AS (SELECT plan, task, string_agg(needed, ',' ORDER BY needed) AS needs FROM n WHERE task <> needed GROUP BY ALL) SELECT e.plan, e.task, e.tool, coalesce(g.needs, '') AS needs FROM e LEFT JOIN g USING (plan, task)""")
def r15_plan_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing prerequisites are put into the plans; placeholders become needs."""
    t = plan_tasks(spark, sf_dir)
    rules = spark.createDataFrame([("purchase", "signup"), ("error", "view")], "tool string, before string")
    every, needs = with_prerequisites(t, rules)
    told = needs.unionByName(placeholder_needs(t)).distinct().groupBy("plan", "task").agg(F.array_join(F.array_sort(F.collect_list("needed")), ",").alias("needs"))
    return every.join(told, ["plan", "task"], "left").select("plan", "task", "tool", F.coalesce("needs", F.lit("")).alias("needs"))


@query(_TASKS + """, c AS (SELECT plan * 8 + task AS id, tool, arguments FROM t) SELECT tool, CASE tool WHEN 'view' THEN 'ok' WHEN 'purchase' THEN CASE WHEN arguments = '' THEN 'missing argument' ELSE 'ok' END WHEN 'signup' THEN 'ok' ELSE 'unknown tool' END AS outcome, count(*) AS calls, CAST(sum(id) AS BIGINT) AS ids FROM c GROUP BY ALL""")
def d2_tool_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by the names of tools, and what becomes of them."""
    calls = plan_tasks(spark, sf_dir).select((F.col("plan") * 8 + F.col("task")).alias("id"), "tool", "arguments")
    tools = spark.createDataFrame([("view", False), ("purchase", True), ("signup", False)], "tool string, needs_arguments boolean")
    return dispatched(calls, tools).groupBy("tool", "outcome").agg(F.count("*").alias("calls"), F.sum("id").alias("ids"))
