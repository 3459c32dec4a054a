"""Table sources and sinks.

S1  ``read_table``      parquet (default), any ``spark.read`` format, or JDBC.
S5  ``write_table``     replace a table: parquet folder or catalog table;
                        ``replace_partitions`` only some partitions of it.
S6  ``write_pipe_text`` ``|``-separated text, no header, empty string and null
                        both written as empty and read back as null;
                        ``split_pipe_text`` sets lines aside that do not parse.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from shelfsense.sources.workspace import Workspace


def read_table(spark: SparkSession, path_or_table: str, fmt: str = "parquet",
               schema: StructType | None = None,
               options: Mapping[str, str] | None = None) -> DataFrame:
    """Read one table.  ``fmt='table'`` reads the catalog, ``fmt='jdbc'`` reads
    ``path_or_table`` as ``dbtable`` with connection settings in ``options``."""
    if fmt == "table":
        return spark.table(path_or_table)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if options:
        reader = reader.options(**options)
    if fmt == "jdbc":
        return reader.format("jdbc").option("dbtable", path_or_table).load()
    return reader.format(fmt).load(path_or_table)


#: Schemas of Parquet tables by path, time of change and size.
_schemas: dict[tuple, StructType] = {}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, read afresh; only its schema, which Spark reads from the
    footers in a job of its own, is kept for as long as the table is unchanged."""
    of, fs = _fs(spark, path)
    status = fs.getFileStatus(of(path))
    key = (path, status.getModificationTime(), status.getLen())
    if key not in _schemas:
        if len(_schemas) > 1000:
            _schemas.clear()
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def load_tables(spark: SparkSession, base_dir: str,
                names: Iterable[str]) -> dict[str, DataFrame]:
    """``{name: DataFrame}`` for ``{base_dir}/{name}.parquet``."""
    return {n: read_parquet(spark, f"{base_dir}/{n}.parquet") for n in names}


def _fs(spark: SparkSession, target: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(target).getFileSystem(spark._jsc.hadoopConfiguration())


def recover_table(spark: SparkSession, target: str) -> None:
    """Put ``target`` back if a swap was interrupted between its two renames, and
    remove what interrupted writes left beside it."""
    path, fs = _fs(spark, target)
    left = [s.getPath() for s in fs.globStatus(path(f"{target.rstrip('/')}{_ASIDE}*")) or []]
    for old in left:
        if not fs.exists(path(target)):
            fs.rename(old, path(target))
        else:
            fs.delete(old, True)
    for staged in fs.globStatus(path(f"{target.rstrip('/')}{_STAGED}*")) or []:
        fs.delete(staged.getPath(), True)


#: What is beside a table while it is replaced.
_STAGED, _ASIDE = "__staged-", "__aside-"


def _swap(spark: SparkSession, staged: str, target: str) -> None:
    path, fs = _fs(spark, target)
    aside = f"{target.rstrip('/')}{_ASIDE}{uuid.uuid4().hex}"
    had = fs.exists(path(target))
    if had and not fs.rename(path(target), path(aside)):
        raise OSError(f"cannot move {target} aside")
    if not fs.rename(path(staged), path(target)):
        if had:
            fs.rename(path(aside), path(target))
        raise OSError(f"cannot move the new table to {target}")
    if had:
        fs.delete(path(aside), True)
    spark.catalog.refreshByPath(target)


def write_table(df: DataFrame, target: str, fmt: str = "parquet",
                partition_by: Iterable[str] | None = None,
                options: Mapping[str, str] | None = None) -> None:
    """Replace ``target`` with ``df``.

    The new table is written beside the old one and takes its place by two
    renames, so ``df`` may read ``target`` itself and a write that fails leaves
    the old table as it was; ``recover_table`` (run by the next write as well)
    mends a swap that was cut off between the renames.  On stores without a
    rename the swap is a copy.  Two writers of one target at a time are not
    supported.

    Unlike a truncate-then-append of a fixed table, the overwrite always applies
    to the named target.  ``fmt='table'`` saves to the catalog, through a staged
    copy as well; ``fmt='jdbc'`` truncates and reloads the database table in
    place.
    """
    spark = df.sparkSession
    writer = df.write.mode("overwrite")
    if options:
        writer = writer.options(**options)
    if fmt == "jdbc":
        writer.format("jdbc").option("dbtable", target).option("truncate", "true").save()
        return
    if fmt == "table":
        work = Workspace(spark, "table")
        try:
            writer = work.save(df, "new").write.mode("overwrite").options(**(options or {}))
            if partition_by:
                writer = writer.partitionBy(*partition_by)
            writer.saveAsTable(target)
        finally:
            work.drop()
        return
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    recover_table(spark, target)
    staged = f"{target.rstrip('/')}{_STAGED}{uuid.uuid4().hex}"
    try:
        writer.format(fmt).save(staged)
        _swap(spark, staged, target)
    finally:
        path, fs = _fs(spark, target)
        fs.delete(path(staged), True)


def replace_partitions(df: DataFrame, target: str, partition_by: Iterable[str], fmt: str = "parquet") -> None:
    """Replace only the partitions of ``target`` that ``df`` has rows for (one
    month, say); the others keep their files.  ``df`` may read ``target``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partition_by).format(fmt).save(target))
    df.sparkSession.catalog.refreshByPath(target)


def write_pipe_text(df: DataFrame, path: str) -> None:
    """S6 bulk text: ``|`` separator, no header, null and '' written as empty."""
    out = df.select([
        F.when(F.col(f.name) == "", None).otherwise(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, StringType) else F.col(f.name)
        for f in df.schema.fields
    ])
    (out.write.mode("overwrite")
        .option("sep", "|").option("header", "false")
        .option("nullValue", "").option("emptyValue", "")
        .csv(path))


def read_pipe_text(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read S6 text back with an explicit schema; empty fields become null."""
    return (spark.read.schema(schema)
            .option("sep", "|").option("header", "false")
            .option("nullValue", "").option("emptyValue", "")
            .option("mode", "FAILFAST")
            .csv(path))


def split_pipe_text(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """S6 text as (rows, rejected): the lines that parse, with ``schema``, and
    (line, reason) of those with too few or too many fields or a value of the
    wrong type.  Blank lines are no rows, as for the plain reader; every other
    line is in exactly one of the two.
    """
    bad = "__line"
    while bad in schema.fieldNames():
        bad += "_"
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parse = {"sep": "|", "nullValue": "", "emptyValue": "", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    lines = spark.read.text(path).where(F.trim("value") != "")
    read = lines.select("value", F.from_csv("value", f"{ddl}, `{bad}` string", parse).alias("row"))
    failed = F.col("row").isNull() | F.col("row")[bad].isNotNull()
    rows = read.where(~failed).select(*[F.col("row")[f.name].alias(f.name) for f in schema.fields])
    # the same line with every field as text has a null at its end where fields are missing
    texts = ", ".join(f"`{f.name}` string" for f in schema.fields) + f", `{bad}` string"
    as_text = F.from_csv("value", texts, parse)
    reason = F.when(as_text.isNull() | as_text[bad].isNotNull(), "number of fields").otherwise("value")
    return rows, read.where(failed).select(F.col("value").alias("line"), reason.alias("reason"))
