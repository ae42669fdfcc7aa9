from tidemark.sources.tables import (  # noqa: F401
    read_table, derive_tasks, derive_projects, load_views, dirty_tasks,
    VIRTUAL_PROJECTS, virtual_projects, TASK_SCHEMA, PROJECT_SCHEMA,
)
