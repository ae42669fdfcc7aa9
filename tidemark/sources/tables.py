"""Table sources: parquet reads and the task/project views derived from them.

The test data holds TPC-H-like tables; tasks and projects are derived from
orders/customer/part/nation with the rules fixed in FIXTURES.md. At cluster
scale the derivation is a pair of equi joins: the part side is bounded by
construction (only part keys in (-200, 200) can match ``o_orderkey % 200``),
so it is broadcast; the customer side grows with the data and is left to the
planner (sort-merge, or a runtime broadcast chosen by AQE from real sizes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TASK_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("task", T.StringType(), False),
    T.StructField("project_id", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("archived", T.BooleanType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("ai_enhanced", T.BooleanType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("parent_task_id", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

PROJECT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("user_id", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

# The virtual list ids and titles of the app's sidebar.
VIRTUAL_PROJECTS = [
    ("INBOX", "Inbox"),
    ("TODAY", "Today"),
    ("NEXT_7", "Next 7 Days"),
]

# Task text templates of the derived fixture (FIXTURES.md §2).
TASK_TEMPLATES = [
    "Buy",
    "Call Sarah Lee tomorrow at 3:30 pm about",
    "Email the client about",
    "Meeting with Bob Stone and review",
    "urgent fix for",
    "Doctor appointment on 12/05/2024 for",
    "gym session then",
    "Plan team retreat next week for",
    "Pay bill for",
    "Someday maybe research",
    "Prepare presentation by Friday morning for",
    "Write blog post about",
]

# Texts of the derived fixture that reach the arms of the text rules which the templates miss.
RULE_TEXTS = [
    "Organize team retreat with Anna Berg before March 5",
    "team retreat",
    "Launch product on July 4 asap",
    "launch",
    "Water the plants when possible",
    "Visit family on December 24 in the evening",
    "Read hobby magazine at home eventually",
    "quick sync with Tom at 9:15am",
    "standup on monday",
    "Clara Jones and me check the budget",
    "deep work next month",
    "Join the workshop on 3/4",
    "project planning low priority",
    "Purchase a creative design, nice to have",
    "Book flight for the trip on Saturday night",
    "Study for the course",
    "Interview candidate with Eve",
    "Emergency: tax deadline",
    "Phone the bank about money",
    "Take medicine",
    "do   demo   today",
    "Schedule workout tomorrow",
    "Urgent",
]

_EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table of the test data set."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def virtual_projects(spark: SparkSession) -> DataFrame:
    """The constant 3-row virtual project dimension."""
    return spark.createDataFrame(VIRTUAL_PROJECTS, "id string, name string")


def _created_at(key: Column) -> Column:
    minutes = ((key * 7919) % 172800).cast("int")
    return F.expr(_EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), minutes)


def derive_tasks(orders: DataFrame, customer: DataFrame, part: DataFrame) -> DataFrame:
    """Tasks view: one task per order (FIXTURES.md §2)."""
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    c = customer.select("c_custkey", "c_mktsegment")
    # Only keys in (-200, 200) can equal o_orderkey % 200: a bounded side.
    p = (part.where((F.col("p_partkey") > -200) & (F.col("p_partkey") < 200))
         .select("p_partkey", "p_name"))
    j = (o.join(c, o.o_custkey == c.c_custkey)
         .join(F.broadcast(p), (o.o_orderkey % 200) == p.p_partkey))
    k = F.col("o_orderkey")
    base = _created_at(k)
    templates = F.array(*[F.lit(t) for t in TASK_TEMPLATES])
    template = F.element_at(templates, (k % 12).cast("int") + 1)
    prio1 = F.substring("o_orderpriority", 1, 1)
    due = F.date_format(base + F.expr("interval 10 days"), "dd/MM/yyyy")
    metadata = F.when(
        k % 5 != 0,
        F.concat(F.lit('{"category":"'), F.lower("c_mktsegment"), F.lit('","tags":["'),
                 F.lower(F.expr("substr(o_orderpriority, 3)")), F.lit('"]}')))
    parent = F.when(((k + 1) % 4 != 0) & (k >= 2), F.floor((k + 1) / 3).cast("long"))
    return j.select(
        (k + 1).alias("id"),
        F.concat(template, F.lit(" "), F.col("p_name")).alias("task"),
        (F.col("o_custkey") % 30).cast("string").alias("project_id"),
        F.when(k % 4 == 0, F.lit(None).cast("string"))
         .when(k % 4 == 1, F.lit("")).otherwise(due).alias("date"),
        F.when(prio1.isin("1", "2"), "high").when(prio1 == "3", "medium")
         .when(prio1 == "5", "low").alias("priority"),
        (F.col("o_orderstatus") == "F").alias("archived"),
        F.concat(F.lit("u"), (F.col("o_custkey") % 20).cast("string")).alias("user_id"),
        (k % 3 == 0).alias("ai_enhanced"),
        metadata.alias("metadata"),
        parent.alias("parent_task_id"),
        base.alias("created_at"),
        (base + F.make_dt_interval(F.lit(0), F.lit(0), ((k * 131) % 20160).cast("int")))
        .alias("updated_at"),
    )


def derive_projects(nation: DataFrame) -> DataFrame:
    """Projects view: one project per nation, created n hours into 2024."""
    n = F.col("n_nationkey")
    ts = F.expr(_EPOCH) + F.make_dt_interval(F.lit(0), n.cast("int"))
    return nation.select(
        n.cast("string").alias("id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("u"), (n % 20).cast("string")).alias("user_id"),
        ts.alias("created_at"),
        ts.alias("updated_at"),
    )


def load_views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(tasks, projects) derived from the parquet tables under ``sf_dir``."""
    tasks = derive_tasks(read_table(spark, sf_dir, "orders"),
                         read_table(spark, sf_dir, "customer"),
                         read_table(spark, sf_dir, "part"))
    return tasks, derive_projects(read_table(spark, sf_dir, "nation"))


def rule_texts(tasks: DataFrame) -> DataFrame:
    """``tasks`` with every other dozen of ids saying one of RULE_TEXTS instead."""
    texts = F.array(*[F.lit(t) for t in RULE_TEXTS])
    text = F.element_at(texts, (F.floor(F.col("id") / 24) % len(RULE_TEXTS)).cast("int") + 1)
    return tasks.withColumn("task", F.when(F.floor(F.col("id") / 12) % 2 == 0, text).otherwise(F.col("task")))


def pending_children(tasks: DataFrame) -> DataFrame:
    """``tasks`` with every fifth child pending: no parent id, but the text of its user's first active root."""
    first = (tasks.where(~F.col("archived") & F.col("parent_task_id").isNull())
             .groupBy("user_id").agg(F.min_by("task", "id").alias("_text")))
    pending = F.col("parent_task_id").isNotNull() & (F.col("id") % 5 == 0) & F.col("_text").isNotNull()
    named = F.to_json(F.struct(F.col("_text").alias("parentTask")))
    return (tasks.join(first, "user_id", "left").withColumn("_pending", pending)
            .withColumn("metadata", F.when(F.col("_pending"), named).otherwise(F.col("metadata")))
            .withColumn("parent_task_id", F.when(~F.col("_pending"), F.col("parent_task_id")))
            .drop("_text", "_pending"))


def parsed_answers(events: DataFrame) -> DataFrame:
    """``events`` with most ``props`` replaced by the JSON of a parsed task, fields missing, empty or zero in turn."""
    n = F.col("event_id")
    parts = [F.when(n % 2 == 0, F.concat(F.lit('"taskName":"'), "event_type", F.lit('"'))),
             F.when(n % 3 == 0, '"priority":"low"').when(n % 3 == 1, '"priority":""'),
             F.when(n % 5 != 0, '"category":"work"'),
             F.when(n % 7 != 0, '"estimatedDuration":"1 hour"'),
             F.when(n % 4 != 0, F.concat(F.lit('"confidence":0.'), (n % 10).cast("string")))]
    made = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return events.withColumn("props", F.when(F.floor(n / 8) % 4 != 0, made).otherwise(F.col("props")))


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt over the session's shuffle partitions.

    For callers that run CPU-heavy expressions on a table of few file splits
    (each test table is one row group, which Spark cannot split).
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dirty_tasks(tasks: DataFrame) -> DataFrame:
    """Dirty copy for the data-quality checks (FIXTURES.md §2 notes)."""
    i = F.col("id")
    t = (tasks.where(i % 7 != 0)
         .withColumn("task", F.when(i % 11 == 0, F.lit("")).otherwise(F.col("task")))
         .withColumn("priority", F.when(i % 13 == 0, F.lit("urgent")).otherwise(F.col("priority")))
         .withColumn("parent_task_id", F.when(i % 17 == 0, i).otherwise(F.col("parent_task_id"))))
    return t.unionByName(t.where(i % 19 == 0))
