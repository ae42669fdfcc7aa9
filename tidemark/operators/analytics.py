"""Per-user productivity reports.

Every report runs for all users at once: the reference's per-user function
becomes ``groupBy("user_id")``. Scalar parts of a report are folded into one
aggregation with FILTER-style conditional aggregates, so ``tasks`` is scanned
and shuffled once (partial aggregation runs before the shuffle, so a user
holding a third of all rows still sends only one partial row per map task).
Passing ``user_id`` restricts to one user; the filter reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import (
    avg_micros_as, days_before, js_math_round_percent, percent, round_decimal2,
    micros_between, ts_lit,
)
from tidemark.operators.joins import with_project_name

DAY = 86400.0
HOUR = 3600.0


def scope_user(df: DataFrame, user_id: str | None) -> DataFrame:
    """B1: row-level visibility; None keeps every user."""
    return df if user_id is None else df.where(F.col("user_id") == F.lit(user_id))


def scope_user_frame(df: DataFrame, viewers: DataFrame, viewer_col: str = "user_id") -> DataFrame:
    """B1 for many viewers at once: each viewer sees exactly its own rows.

    ``viewers`` holds one row per viewer; the policy is an equi join on the
    owner column, adding the ``viewer`` column.
    """
    v = viewers.select(F.col(viewer_col).alias("viewer")).distinct()
    return df.join(v, df["user_id"] == v["viewer"], "inner")


def _arch() -> Column:
    return F.col("archived") == F.lit(True)


def _ai() -> Column:
    return F.col("ai_enhanced") == F.lit(True)


def _completion_secs() -> Column:
    return F.when(_arch(), micros_between("created_at", "updated_at"))


# --------------------------------------------------------------------------
# user analytics
# --------------------------------------------------------------------------

def user_totals(tasks: DataFrame, user_id: str | None = None) -> DataFrame:
    """Total, completed (archived) and AI-enhanced counts per user."""
    return (scope_user(tasks, user_id).groupBy("user_id")
            .agg(F.count("*").alias("total_tasks"),
                 F.count_if(_arch()).alias("completed_tasks"),
                 F.count_if(_ai()).alias("ai_enhanced_count")))


def user_analytics_scalars(tasks: DataFrame, user_id: str | None = None) -> DataFrame:
    """D1 + D2 + D5: counts, rates (2 dp, 0 without tasks), mean completion days."""
    secs = _completion_secs()
    agg = (scope_user(tasks, user_id).groupBy("user_id")
           .agg(F.count("*").alias("total_tasks"),
                F.count_if(_arch()).alias("completed_tasks"),
                F.count_if(_ai()).alias("ai_enhanced_count"),
                avg_micros_as(secs, DAY).alias("average_completion_time_days")))
    return agg.select(
        "user_id", "total_tasks", "completed_tasks",
        percent(F.col("completed_tasks"), F.col("total_tasks")).alias("completion_rate"),
        percent(F.col("ai_enhanced_count"), F.col("total_tasks")).alias("ai_enhanced_percentage"),
        "average_completion_time_days")


def user_rates(tasks: DataFrame, user_id: str | None = None) -> DataFrame:
    """Completion and AI percentages (DECIMAL, half away from zero)."""
    return user_analytics_scalars(tasks, user_id).select(
        "user_id", "completion_rate", "ai_enhanced_percentage")


def user_rates_int(tasks: DataFrame, user_id: str | None = None) -> DataFrame:
    """The browser-side variant with integer Math.round percentages."""
    t = user_totals(tasks, user_id)
    return t.select(
        "user_id", "total_tasks", "completed_tasks",
        js_math_round_percent(F.col("completed_tasks"), F.col("total_tasks")).alias("completion_rate"),
        js_math_round_percent(F.col("ai_enhanced_count"), F.col("total_tasks"))
        .alias("ai_enhanced_percentage"))


def tasks_by_priority(tasks: DataFrame, user_id: str | None = None) -> DataFrame:
    """D3 long form: (user_id, priority, task_count); NULL priority has no key."""
    return (scope_user(tasks, user_id).where(F.col("priority").isNotNull())
            .groupBy("user_id", "priority").agg(F.count("*").alias("task_count")))


def tasks_by_project(tasks: DataFrame, projects: DataFrame, user_id: str | None = None) -> DataFrame:
    """D4 long form: (user_id, project_name, task_count); equal names merge."""
    t = with_project_name(scope_user(tasks, user_id).select("user_id", "project_id"), projects)
    return t.groupBy("user_id", "project_name").agg(F.count("*").alias("task_count"))


def avg_completion_days(tasks: DataFrame, user_id: str | None = None) -> DataFrame:
    """Mean days from creation to last update of archived tasks (NULL if none)."""
    return (scope_user(tasks, user_id).groupBy("user_id")
            .agg(avg_micros_as(_completion_secs(), DAY).alias("average_completion_time_days")))


def productivity_trend(tasks: DataFrame, *, as_of=None, days: int = 30,
                       user_id: str | None = None) -> DataFrame:
    """D6 long form: per user and creation day in the last ``days`` days."""
    t = scope_user(tasks, user_id).where(F.col("created_at") >= days_before(as_of, days))
    return (t.groupBy("user_id", F.to_date("created_at").alias("date"))
            .agg(F.count_if(_arch()).alias("completed"), F.count("*").alias("created")))


def user_analytics(tasks: DataFrame, projects: DataFrame, *, as_of=None,
                   user_id: str | None = None) -> DataFrame:
    """The full analytics record per user (flagship of the reference).

    One scan of ``tasks``: the four groupings of the record (per user, per
    user and priority, per user and project name, per user and creation day
    in the trend window) are grouping sets of a single aggregation (an
    Expand before the partial aggregation), followed by one small per-user
    aggregation that builds the maps and the ordered trend list. The maps
    have one entry per distinct key (priority domain, project names of the
    user's tasks) and the trend list at most one entry per day of the window.
    With an explicit ``user_id`` that has no tasks, one zero row is returned.
    """
    t = with_project_name(
        scope_user(tasks, user_id).select("user_id", "priority", "project_id", "archived", "ai_enhanced",
                                          "created_at", "updated_at"), projects)
    in_trend = F.col("created_at") >= days_before(as_of, 30)
    t = t.select("user_id", "priority", "project_name", "archived", "ai_enhanced",
                 F.when(in_trend, F.to_date("created_at")).alias("trend_day"),
                 _completion_secs().alias("_secs"))
    sets = [["user_id"], ["user_id", "priority"], ["user_id", "project_name"], ["user_id", "trend_day"]]
    gs = (t.groupingSets(sets, "user_id", "priority", "project_name", "trend_day")
          .agg(F.grouping_id().alias("_gid"), F.count("*").alias("_n"), F.count_if(_arch()).alias("_done"),
               F.count_if(_ai()).alias("_ai"), F.sum("_secs").alias("_sum_us"), F.count("_secs").alias("_n_us")))
    # grouping_id bits follow the column list (user_id, priority, project_name, trend_day): 1 = not grouped
    g_user, g_prio, g_proj, g_day = 0b0111, 0b0011, 0b0101, 0b0110
    gid = F.col("_gid")
    per_user = gs.groupBy("user_id").agg(
        F.max(F.when(gid == g_user, F.col("_n"))).alias("total_tasks"),
        F.max(F.when(gid == g_user, F.col("_done"))).alias("completed_tasks"),
        F.max(F.when(gid == g_user, F.col("_ai"))).alias("_ai_n"),
        F.max(F.when(gid == g_user, F.col("_sum_us"))).alias("_sum_us"),
        F.max(F.when(gid == g_user, F.col("_n_us"))).alias("_n_us"),
        F.map_from_entries(F.collect_list(F.when((gid == g_prio) & F.col("priority").isNotNull(),
                                                 F.struct("priority", F.col("_n").alias("task_count")))))
        .alias("tasks_by_priority"),
        F.map_from_entries(F.collect_list(F.when(gid == g_proj,
                                                 F.struct("project_name", F.col("_n").alias("task_count")))))
        .alias("tasks_by_project"),
        F.sort_array(F.collect_list(F.when((gid == g_day) & F.col("trend_day").isNotNull(),
                                           F.struct(F.col("trend_day").alias("date"), F.col("_done").alias("completed"),
                                                    F.col("_n").alias("created")))))
        .alias("productivity_trend"))
    out = per_user.select(
        "user_id", "total_tasks", "completed_tasks",
        percent(F.col("completed_tasks"), F.col("total_tasks")).alias("completion_rate"),
        percent(F.col("_ai_n"), F.col("total_tasks")).alias("ai_enhanced_percentage"),
        F.when(F.col("_n_us") > 0, F.col("_sum_us").cast("double") / (F.col("_n_us") * F.lit(DAY * 1e6)))
        .alias("average_completion_time_days"),
        "tasks_by_priority", "tasks_by_project", "productivity_trend")
    if user_id is not None:
        spark = tasks.sparkSession
        one = spark.createDataFrame([(user_id,)], "user_id string")
        zero = F.lit(0).cast("long")
        zdec = F.lit(0).cast("decimal(10,2)")
        out = one.join(out, "user_id", "left").select(
            "user_id",
            F.coalesce("total_tasks", zero).alias("total_tasks"),
            F.coalesce("completed_tasks", zero).alias("completed_tasks"),
            F.coalesce("completion_rate", zdec).alias("completion_rate"),
            F.coalesce("ai_enhanced_percentage", zdec).alias("ai_enhanced_percentage"),
            "average_completion_time_days", "tasks_by_priority", "tasks_by_project",
            "productivity_trend")
    return out


def user_analytics_json(tasks: DataFrame, projects: DataFrame, **kw) -> DataFrame:
    """D7 as (user_id, JSON text), the sink form of the reference's RETURNS JSON."""
    rec = user_analytics(tasks, projects, **kw)
    body = F.struct(*[c for c in rec.columns if c != "user_id"])
    return rec.select("user_id", F.to_json(body).alias("analytics"))


# --------------------------------------------------------------------------
# productivity insights
# --------------------------------------------------------------------------

def daily_completions(tasks: DataFrame, *, as_of=None, days_back: int = 30,
                      user_id: str | None = None) -> DataFrame:
    """Archived tasks by day of last update within ``days_back`` days."""
    t = scope_user(tasks, user_id).where(_arch() & (F.col("updated_at") >= days_before(as_of, days_back)))
    secs = micros_between("created_at", "updated_at")
    return (t.groupBy("user_id", F.to_date("updated_at").alias("date"))
            .agg(F.count("*").alias("completed"),
                 avg_micros_as(secs, HOUR).alias("avg_completion_time_hours"),
                 F.count_if(_ai()).alias("ai_enhanced_completed")))


def project_performance(tasks: DataFrame, projects: DataFrame, *, as_of=None, days_back: int = 30,
                        user_id: str | None = None, coalesce_unknown: bool = True) -> DataFrame:
    """Per project name, tasks created within ``days_back``: completion %, mean hours."""
    t = scope_user(tasks, user_id).where(F.col("created_at") >= days_before(as_of, days_back))
    t = with_project_name(t.select("user_id", "project_id", "archived", "created_at", "updated_at"),
                          projects, coalesce_unknown=coalesce_unknown)
    return (t.groupBy("user_id", "project_name")
            .agg(F.count("*").alias("_n"), F.count_if(_arch()).alias("_done"),
                 avg_micros_as(_completion_secs(), HOUR).alias("avg_completion_time"))
            .select("user_id", "project_name",
                    percent(F.col("_done"), F.col("_n"), zero_when_empty=False).alias("completion_rate"),
                    "avg_completion_time"))


def insight_scalars(tasks: DataFrame, *, as_of=None, days_back: int = 30,
                    user_id: str | None = None) -> DataFrame:
    """D10-D13 in one pass over tasks (one row per user with tasks).

    peak day (0 = Sunday) / hour: mode of archived updates in the window,
    lowest value on ties; velocity: (last 7 d - the 7 d before) / 7, 2 dp, 0
    unless the user has more than 7 archived tasks ever; AI success: archived
    share of AI tasks created in the window, 2 dp, else 0.
    """
    now = ts_lit(as_of)
    start = days_before(as_of, days_back)
    upd = F.col("updated_at")
    in_win = _arch() & (upd >= start)
    c7 = F.count_if(_arch() & (upd >= now - F.make_dt_interval(F.lit(7))))
    c14 = F.count_if(_arch() & (upd >= now - F.make_dt_interval(F.lit(14)))
                     & (upd < now - F.make_dt_interval(F.lit(7))))
    created_in = F.col("created_at") >= start
    agg = (scope_user(tasks, user_id).groupBy("user_id")
           .agg(F.mode(F.when(in_win, F.dayofweek(upd) - 1), True).alias("peak_productivity_day"),
                F.mode(F.when(in_win, F.hour(upd)), True).alias("peak_productivity_hour"),
                F.count_if(_arch()).alias("_n_arch"), c7.alias("_c7"), c14.alias("_c14"),
                F.count_if(_ai() & created_in).alias("_ai"),
                F.count_if(_ai() & _arch() & created_in).alias("_ai_done")))
    velocity = F.when(F.col("_n_arch") > 7,
                      round_decimal2((F.col("_c7") - F.col("_c14")) / F.lit(7.0).cast("decimal(2,1)"))
                      ).otherwise(F.lit(0).cast("decimal(10,2)"))
    return agg.select("user_id", F.col("peak_productivity_day").cast("int").alias("peak_productivity_day"),
                      F.col("peak_productivity_hour").cast("int").alias("peak_productivity_hour"),
                      velocity.alias("completion_velocity"),
                      percent(F.col("_ai_done"), F.col("_ai")).alias("ai_task_success_rate"))


def peak_day(tasks: DataFrame, **kw) -> DataFrame:
    """Mode of day-of-week (0 = Sunday) of archived updates in the window."""
    return insight_scalars(tasks, **kw).select("user_id", "peak_productivity_day")


def peak_hour(tasks: DataFrame, **kw) -> DataFrame:
    """Mode of hour of archived updates in the window."""
    return insight_scalars(tasks, **kw).select("user_id", "peak_productivity_hour")


def completion_velocity(tasks: DataFrame, **kw) -> DataFrame:
    """Completion velocity per user."""
    return insight_scalars(tasks, **kw).select("user_id", "completion_velocity")


def ai_success_rate(tasks: DataFrame, **kw) -> DataFrame:
    """Archived share of AI tasks created in the window."""
    return insight_scalars(tasks, **kw).select("user_id", "ai_task_success_rate")


def productivity_insights(tasks: DataFrame, projects: DataFrame, *, as_of=None, days_back: int = 30,
                          user_id: str | None = None) -> DataFrame:
    """The insights record per user: scalars + ordered daily list + project list.

    One scan of ``tasks``: the scalar fields, the daily completions (by day
    of the last update) and the project performance (tasks created in the
    window, by project name) are grouping sets of one aggregation, then one
    small per-user aggregation assembles the lists (bounded by the days of
    the window and the user's project names).
    """
    now = ts_lit(as_of)
    start = days_before(as_of, days_back)
    upd = F.col("updated_at")
    t = with_project_name(
        scope_user(tasks, user_id).select("user_id", "project_id", "archived", "ai_enhanced",
                                          "created_at", "updated_at"), projects)
    in_win = _arch() & (upd >= start)
    created_in = F.col("created_at") >= start
    t = t.select(
        "user_id", "archived", "ai_enhanced", "created_at", "updated_at",
        F.when(in_win, F.to_date(upd)).alias("done_day"),
        F.when(created_in, F.col("project_name")).alias("win_project"),
        F.when(in_win, F.dayofweek(upd) - 1).alias("_dow"), F.when(in_win, F.hour(upd)).alias("_hour"),
        _completion_secs().alias("_secs"),
        (_arch() & (upd >= now - F.make_dt_interval(F.lit(7)))).alias("_w7"),
        (_arch() & (upd >= now - F.make_dt_interval(F.lit(14))) & (upd < now - F.make_dt_interval(F.lit(7))))
        .alias("_w14"),
        created_in.alias("_created_in"))
    sets = [["user_id"], ["user_id", "done_day"], ["user_id", "win_project"], ["user_id", "_dow"],
            ["user_id", "_hour"]]
    gs = (t.groupingSets(sets, "user_id", "done_day", "win_project", "_dow", "_hour")
          .agg(F.grouping_id().alias("_gid"),
               F.count_if(_arch()).alias("_n_arch"), F.count_if("_w7").alias("_c7"), F.count_if("_w14").alias("_c14"),
               F.count_if(_ai() & F.col("_created_in")).alias("_ai"),
               F.count_if(_ai() & _arch() & F.col("_created_in")).alias("_ai_done"),
               F.count("*").alias("_n"), F.count_if(_ai()).alias("_ai_all"),
               F.sum("_secs").alias("_sum_us"), F.count("_secs").alias("_n_us"),
               F.sum(F.when(F.col("done_day").isNotNull(), micros_between("created_at", "updated_at")))
               .alias("_day_sum_us")))
    # grouping_id bits follow (user_id, done_day, win_project, _dow, _hour): 1 = not grouped
    g_user, g_day, g_proj, g_dow, g_hour = 0b01111, 0b00111, 0b01011, 0b01101, 0b01110
    gid = F.col("_gid")
    hours = lambda s, n: F.when(n > 0, s.cast("double") / (n * F.lit(HOUR * 1e6)))
    daily = F.struct(F.col("done_day").alias("date"), F.col("_n").alias("completed"),
                     hours(F.col("_day_sum_us"), F.col("_n")).alias("avg_completion_time_hours"),
                     F.col("_ai_all").alias("ai_enhanced_completed"))
    perf = F.struct(F.col("win_project").alias("project_name"),
                    percent(F.col("_n_arch"), F.col("_n"), zero_when_empty=False).alias("completion_rate"),
                    hours(F.col("_sum_us"), F.col("_n_us")).alias("avg_completion_time"))

    def mode_of(g, col):
        # most frequent value, lowest value on ties: max of (count, -value)
        best = F.max(F.when((gid == g) & F.col(col).isNotNull(), F.struct(F.col("_n").alias("n"), (-F.col(col)).alias("v"))))
        return (-best["v"]).cast("int")

    per_user = gs.groupBy("user_id").agg(
        *[F.max(F.when(gid == g_user, F.col(c))).alias(c)
          for c in ["_n_arch", "_c7", "_c14", "_ai", "_ai_done"]],
        mode_of(g_dow, "_dow").alias("_peak_day"), mode_of(g_hour, "_hour").alias("_peak_hour"),
        F.sort_array(F.collect_list(F.when((gid == g_day) & F.col("done_day").isNotNull(), daily)))
        .alias("daily_completions"),
        F.collect_list(F.when((gid == g_proj) & F.col("win_project").isNotNull(), perf)).alias("project_performance"))
    velocity = F.when(F.col("_n_arch") > 7,
                      round_decimal2((F.col("_c7") - F.col("_c14")) / F.lit(7.0).cast("decimal(2,1)"))
                      ).otherwise(F.lit(0).cast("decimal(10,2)"))
    return per_user.select(
        "user_id", F.col("_peak_day").cast("int").alias("peak_productivity_day"),
        F.col("_peak_hour").cast("int").alias("peak_productivity_hour"),
        velocity.alias("completion_velocity"),
        percent(F.col("_ai_done"), F.col("_ai")).alias("ai_task_success_rate"),
        F.when(F.size("daily_completions") > 0, F.col("daily_completions")).alias("daily_completions"),
        F.when(F.size("project_performance") > 0, F.col("project_performance")).alias("project_performance"))


def insights_single_scope(tasks: DataFrame, *, as_of=None, days_back: int = 30,
                          user_id: str | None = None) -> DataFrame:
    """The first version's single scope (tasks created within the window).

    Peaks and velocity count every task in scope, not only archived ones,
    and the "> 7" gate counts the scope.
    """
    now = ts_lit(as_of)
    upd = F.col("updated_at")
    t = scope_user(tasks, user_id).where(F.col("created_at") >= days_before(as_of, days_back))
    c7 = F.count_if(upd >= now - F.make_dt_interval(F.lit(7)))
    c14 = F.count_if((upd >= now - F.make_dt_interval(F.lit(14))) & (upd < now - F.make_dt_interval(F.lit(7))))
    agg = (t.groupBy("user_id")
           .agg(F.mode(F.dayofweek(upd) - 1, True).alias("peak_productivity_day"),
                F.mode(F.hour(upd), True).alias("peak_productivity_hour"),
                F.count("*").alias("_n"), c7.alias("_c7"), c14.alias("_c14"),
                F.count_if(_ai()).alias("_ai"), F.count_if(_ai() & _arch()).alias("_ai_done")))
    velocity = F.when(F.col("_n") > 7,
                      round_decimal2((F.col("_c7") - F.col("_c14")) / F.lit(7.0).cast("decimal(2,1)"))
                      ).otherwise(F.lit(0).cast("decimal(10,2)"))
    return agg.select("user_id", F.col("peak_productivity_day").cast("int").alias("peak_productivity_day"),
                      F.col("peak_productivity_hour").cast("int").alias("peak_productivity_hour"),
                      velocity.alias("completion_velocity"),
                      percent(F.col("_ai_done"), F.col("_ai")).alias("ai_task_success_rate"))


def distinct_projects_perf(tasks: DataFrame, projects: DataFrame, *, as_of=None, days_back: int = 30,
                           user_id: str | None = None) -> DataFrame:
    """D18 long form: the first version's DISTINCT project entries (name not coalesced)."""
    perf = project_performance(tasks, projects, as_of=as_of, days_back=days_back,
                               user_id=user_id, coalesce_unknown=False)
    return perf.distinct()


def distinct_projects_perf_set(tasks: DataFrame, projects: DataFrame, **kw) -> DataFrame:
    """D18 nested form: per user the set of project entries (json_agg DISTINCT)."""
    return (distinct_projects_perf(tasks, projects, **kw).groupBy("user_id")
            .agg(F.collect_set(F.struct("project_name", "completion_rate", "avg_completion_time"))
                 .alias("project_performance")))


# --------------------------------------------------------------------------
# statistics and views
# --------------------------------------------------------------------------

def user_statistics(tasks: DataFrame) -> DataFrame:
    """The stored per-user statistics (materialized view body)."""
    return (tasks.groupBy("user_id")
            .agg(F.count("*").alias("total_tasks"),
                 F.count_if(_arch()).alias("completed_tasks"),
                 F.count_if(_ai()).alias("ai_enhanced_tasks"),
                 F.countDistinct("project_id").alias("active_projects"),
                 avg_micros_as(_completion_secs(), DAY).alias("avg_completion_days"),
                 F.max("created_at").alias("last_task_created"),
                 F.max(F.when(_arch(), F.col("updated_at"))).alias("last_task_completed")))


def productivity_analytics(tasks: DataFrame, *, as_of=None, days: int = 90) -> DataFrame:
    """Per user and creation day over the last ``days`` days.

    ``most_common_priority`` is the mode, lowest value on ties, NULLs ignored.
    Ordered user asc, date desc like the reference view.
    """
    t = tasks.where(F.col("created_at") >= days_before(as_of, days))
    return (t.groupBy("user_id", F.to_date("created_at").alias("date"))
            .agg(F.count("*").alias("tasks_created"),
                 F.count_if(_arch()).alias("tasks_completed"),
                 F.count_if(_ai()).alias("ai_tasks_created"),
                 F.count_if(_ai() & _arch()).alias("ai_tasks_completed"),
                 avg_micros_as(_completion_secs(), HOUR).alias("avg_completion_hours"),
                 F.mode("priority", True).alias("most_common_priority"))
            .orderBy("user_id", F.col("date").desc()))


def project_task_counts(projects: DataFrame, tasks: DataFrame, user_id: str | None = None) -> DataFrame:
    """Every project with its number of tasks (archived included), 0 if none.

    Tasks are counted per project id first (partial aggregation), so only
    one row per project crosses into the join.
    """
    counts = tasks.groupBy(F.col("project_id").alias("_pid")).agg(F.count("*").alias("task_count"))
    p = scope_user(projects, user_id)
    return (p.join(counts, p["id"] == counts["_pid"], "left").drop("_pid")
            .withColumn("task_count", F.coalesce("task_count", F.lit(0)).cast("long")))


# The advice lines of the prioritisation report.
PRIORITY_INSIGHT_LINES = [
    "%d tasks analyzed for intelligent prioritization",
    "Consider tackling high-priority items during your peak energy hours",
    "Group similar tasks together for better efficiency",
]


def priority_insights(tasks: DataFrame, group: str = "user_id") -> DataFrame:
    """Per group the three insight lines; the first names the task count."""
    n = tasks.groupBy(group).agg(F.count("*").alias("_n"))
    lines = F.array(F.format_string(PRIORITY_INSIGHT_LINES[0], F.col("_n")),
                    *[F.lit(s) for s in PRIORITY_INSIGHT_LINES[1:]])
    return n.select(group, F.posexplode(lines).alias("insight_no", "insight"))


def _count_join_back(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """COUNT(*) OVER (PARTITION BY keys) as aggregate + join back.

    A window would sort each whole partition in one task; the aggregate is
    combined map-side and the join back is a plain equi join that AQE can
    split when one key is hot.
    """
    counts = rows.groupBy(*[F.col(k).alias("_k_" + k) for k in keys]).agg(F.count("*").alias(name))
    cond = [F.col(k).eqNullSafe(F.col("_k_" + k)) for k in keys]
    return rows.join(counts, cond, "left").drop(*["_k_" + k for k in keys])


def priority_window_count(tasks: DataFrame, user_id: str | None = None) -> DataFrame:
    """Each task with the number of the user's tasks of the same priority."""
    t = scope_user(tasks, user_id).select("id", "user_id", "priority")
    return _count_join_back(t, ["user_id", "priority"], "priority_count")


def project_window_count(tasks: DataFrame, projects: DataFrame, user_id: str | None = None) -> DataFrame:
    """Each task with the number of the user's tasks of the same project name."""
    t = with_project_name(scope_user(tasks, user_id).select("id", "user_id", "project_id"), projects)
    return _count_join_back(t.select("id", "user_id", "project_name"),
                            ["user_id", "project_name"], "project_count")
