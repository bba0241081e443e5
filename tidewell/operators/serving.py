"""Serving store: documents to ordered child rows and back, canonical JSON, scoped replacement."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def shred(documents: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """"" for the scalar columns, and for each array column its rows with a dense ``ord`` from 0."""
    arrays = [f for f in documents.schema.fields if isinstance(f.dataType, ArrayType)]
    scalar = [c for c in documents.columns if c not in {f.name for f in arrays}]
    out = {"": documents.select(*scalar, *[F.col(f.name).isNotNull().alias(f"has_{f.name}") for f in arrays])}
    for f in arrays:
        rows = documents.select(*keys, F.posexplode(f.name).alias("ord", "item"))
        nested = isinstance(f.dataType.elementType, StructType)
        out[f.name] = rows.select(*keys, "ord", "item.*") if nested else rows.select(*keys, "ord", F.col("item").alias("value"))
    return out


def rebuild(tables: dict[str, DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """The documents again, columns in ``order``: each child table is grouped once; null and empty arrays stay apart."""
    out = tables[""]
    for name, rows in tables.items():
        if not name:
            continue
        columns = [c for c in rows.columns if c not in (*keys, "ord")]
        item = F.col("value") if columns == ["value"] else F.struct(*columns)
        lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", item.alias("item")))).alias("_l"))
        lists = lists.select(*keys, F.transform("_l", lambda x: x["item"]).alias(name))
        kind = lists.schema[name].dataType.simpleString()
        out = out.join(lists, keys, "left").withColumn(name, F.when(F.col(f"has_{name}"), F.coalesce(name, F.array().cast(kind)))).drop(f"has_{name}")
    return out.select(*order)


def sorted_struct(schema: StructType, value: Column) -> Column:
    """A struct with its fields, at all depths, in alphabetical order."""

    def ordered(kind, column: Column) -> Column:
        if isinstance(kind, StructType):
            return F.when(column.isNotNull(), F.struct(*[ordered(f.dataType, column[f.name]).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType | ArrayType):
            return F.transform(column, lambda x: ordered(kind.elementType, x))
        return column

    return ordered(schema, value)


def canonical_json(documents: DataFrame, keys: list[str], name: str = "body") -> DataFrame:
    """keys and the document as JSON with sorted keys, no spaces, nulls written out."""
    row = F.struct(*documents.columns)
    return documents.select(*keys, F.to_json(sorted_struct(documents.schema, row), {"ignoreNullFields": "false"}).alias(name))


def write_json_tree(documents: DataFrame, path_col: str, body_col: str, folder: str) -> None:
    """One text file for each document; files are named by Spark's partition of the path, and stale ones go."""
    documents.select(F.col(body_col).alias("value"), F.col(path_col).alias("document")).write.mode("overwrite").partitionBy("document").text(folder)


def offload(tables: dict[str, DataFrame], folder: str, live_runs: list[str]) -> None:
    """Replaces the runs in tables, and drops partitions of runs that are no longer live."""
    for name, rows in tables.items():
        path = f"{folder}/{name or 'document'}"
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
        spark = rows.sparkSession
        top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in files.listStatus(top):
            run = status.getPath().getName()
            if run.startswith("run_id=") and run.removeprefix("run_id=") not in live_runs:
                files.delete(status.getPath(), True)


def document(tables: dict[str, DataFrame], keys: list[str], order: list[str], **key: object) -> DataFrame:
    """A route's document: the rows of one key, rebuilt; no rows if it does not exist."""
    found = {}
    for name, rows in tables.items():
        for column, value in key.items():
            rows = rows.where(F.col(column) == F.lit(value))
        found[name] = rows
    return rebuild(found, keys, order)


def manifest(runs: DataFrame, members: DataFrame, schema_version: int) -> DataFrame:
    """A row for each run with its sizes, and the version of the document contract."""
    sizes = members.groupBy("run_id").agg(F.count("*").alias("n_users"), F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("n_clusters"))
    return runs.join(sizes, "run_id", "left").withColumns({"n_users": F.coalesce("n_users", F.lit(0)), "n_clusters": F.coalesce("n_clusters", F.lit(0)), "schema_version": F.lit(schema_version)})


def write_atomically(body: str, path: str, spark) -> None:
    """Writes a small document beside its place, with a newline at its end, and renames it over what is there in one step."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    target, part = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.part")
    files = target.getFileSystem(conf)
    stream = files.create(part, False)
    stream.write(bytearray((body.rstrip("\n") + "\n").encode()))
    stream.close()
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(files.makeQualified(target).toUri(), conf)
    context.rename(files.makeQualified(part), files.makeQualified(target), options)
