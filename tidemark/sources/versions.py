"""Tables whose stored folders have different schemas (A3): several versions read as one.

A schema migration adds columns and widens types, but rows written before it
stay as they were. The folders of a table are ``root/version=<n>``; all are
read by one scan with the present schema, whose readers widen numbers and give
NULL for absent columns. A NULL that was stored stays NULL; a column that a
version did not have gets the default that the migration gave its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Types that a column may have had before it got the type on the left, by the Parquet readers' widening.
WIDER = {
    T.LongType(): (T.IntegerType(), T.ShortType(), T.ByteType()),
    T.IntegerType(): (T.ShortType(), T.ByteType()),
    T.DoubleType(): (T.FloatType(), T.IntegerType(), T.ShortType(), T.ByteType()),
    T.TimestampNTZType(): (T.DateType(),),
}


def version_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/version={version}"


def write_version(rows: DataFrame, root: str, version: int) -> None:
    """Store ``rows`` as they are, with their own schema, as one version of the table."""
    rows.write.mode("overwrite").parquet(version_path(root, version))


def read_versions(spark: SparkSession, root: str, versions: list[int], schema: T.StructType,
                  defaults: dict[str, Column] | None = None) -> DataFrame:
    """The rows of all ``versions`` with the columns of ``schema``, in one scan.

    A column is the stored value, widened; where a version does not have it,
    it is ``defaults[name]`` (NULL without one). A column that was stored with a
    type that does not widen to its present one is an error, and so is a
    version without files. Columns that the present schema no longer has are not read.
    """
    defaults = defaults or {}
    absent: dict[str, list[int]] = {f.name: [] for f in schema}
    for v in versions:
        stored = {f.name: f.dataType for f in spark.read.parquet(version_path(root, v)).schema}
        for f in schema:
            have = stored.get(f.name)
            if have is None:
                absent[f.name].append(v)
            elif have != f.dataType and have not in WIDER.get(f.dataType, ()):
                raise ValueError(f"version {v}: {f.name} is {have.simpleString()}, which does not widen to "
                                 f"{f.dataType.simpleString()}")
    kept = T.StructType([T.StructField(f.name, f.dataType) for f in schema if len(absent[f.name]) < len(versions)])
    rows = (spark.read.schema(kept.add("version", T.IntegerType())).option("basePath", root)
            .parquet(*[version_path(root, v) for v in versions]))
    cols = []
    for f in schema:
        default = defaults.get(f.name, F.lit(None)).cast(f.dataType)
        if len(absent[f.name]) == len(versions):
            value = default
        elif absent[f.name]:
            value = F.when(F.col("version").isin(absent[f.name]), default).otherwise(F.col(f.name))
        else:
            value = F.col(f.name)
        cols.append(value.alias(f.name))
    return rows.select(*cols)
