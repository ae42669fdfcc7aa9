"""tidemark: task and productivity analytics as Spark DataFrame jobs.

Every operator is a plain function ``DataFrame -> DataFrame`` built from
Spark expressions, so Catalyst can push filters into the parquet scan, prune
columns and pick join strategies; nothing runs on the driver.
"""

__version__ = "0.1.0"
