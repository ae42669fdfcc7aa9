"""Nested API forms next to the flat query forms."""

import datetime as dt
import json

from tidemark.operators import analytics as A
from tidemark.operators import joins as J
from tidemark.sources.tables import TASK_SCHEMA, virtual_projects
from tests.test_operators import tasks

T0 = dt.datetime(2024, 5, 1)


def projects(spark):
    return spark.createDataFrame([("1", "Inbox", "u1", T0, T0), ("2", "Work", "u1", T0, T0)],
                                 "id string, name string, user_id string, created_at timestamp_ntz, "
                                 "updated_at timestamp_ntz")


def test_with_subtasks_embeds_sorted_children(spark):
    t = tasks(spark, [dict(id=1), dict(id=3, parent_task_id=1), dict(id=2, parent_task_id=1), dict(id=4)])
    got = {r.id: [c.id for c in r.subtasks] for r in J.with_subtasks(t).collect()}
    assert got == {1: [2, 3], 2: [], 3: [], 4: []}


def test_user_analytics_json(spark):
    t = tasks(spark, [dict(id=1, archived=True, project_id="2"), dict(id=2, priority="high", project_id="9")])
    r = A.user_analytics_json(t, projects(spark), as_of="2024-05-15 00:00:00").first()
    doc = json.loads(r.analytics)
    assert doc["total_tasks"] == 2 and doc["completed_tasks"] == 1
    assert doc["tasks_by_priority"] == {"medium": 1, "high": 1}
    assert doc["tasks_by_project"] == {"Work": 1, "Unknown Project": 1}
    assert [d["created"] for d in doc["productivity_trend"]] == [2]


def test_project_title_virtual_first(spark):
    sel = spark.createDataFrame([("INBOX",), ("2",), ("zz",)], "selected_project string")
    got = {r.selected_project: r.title for r in J.project_title(sel, projects(spark), virtual_projects(spark)).collect()}
    assert got == {"INBOX": "Inbox", "2": "Work", "zz": None}


def test_hierarchy_order_with_pending_child(spark):
    t = tasks(spark, [
        dict(id=1, task="Plan trip", created_at=T0),
        dict(id=2, task="Book hotel", parent_task_id=1, created_at=T0 + dt.timedelta(hours=1)),
        dict(id=3, task="Pack", metadata='{"parentTask": "Plan trip", "type": "subtask"}',
             created_at=T0 + dt.timedelta(hours=2)),
        dict(id=4, task="Other", created_at=T0 + dt.timedelta(hours=3)),
        dict(id=5, task="orphan child", parent_task_id=99, created_at=T0),
    ])
    order = [r.id for r in J.display_order(J.task_hierarchy(t)).collect()]
    # newest root first; children follow their root newest first; a child of a missing root is dropped
    assert order == [4, 1, 3, 2]
    assert TASK_SCHEMA.fieldNames()[0] == "id"
