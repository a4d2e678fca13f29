"""Table scans: parquet folders or a JDBC database, by table name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from folioseek.plans.sizing import BROADCAST_BYTES
from folioseek.sources.schemas import SCHEMAS


@dataclass(frozen=True)
class Tables:
    """The tables that jobs work on; each is a lazy DataFrame."""

    documents: DataFrame
    users: DataFrame
    notes: DataFrame
    correspondents: DataFrame
    document_tags: DataFrame
    tags: DataFrame
    sources: DataFrame
    chunks: DataFrame


def read_parquet(
    spark: SparkSession, path: str, schema: T.StructType | None = None, columns: dict[str, str] | None = None
) -> DataFrame:
    """Scan a parquet table; ``columns`` maps names in the file to names used here."""
    df = spark.read.parquet(path)
    for theirs, ours in (columns or {}).items():
        df = df.withColumnRenamed(theirs, ours)
    return df if schema is None else conform(df, schema)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    key: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 64,
    columns: dict[str, str] | None = None,
    schema: T.StructType | None = None,
    **options: str,
) -> DataFrame:
    """Scan a database table, split over ``partitions`` ranges of the integer ``key``."""
    reader = spark.read.format("jdbc").options(**jdbc_options(url, table, key, bounds, partitions, **options))
    df = reader.load()
    for theirs, ours in (columns or {}).items():
        df = df.withColumnRenamed(theirs, ours)
    return df if schema is None else conform(df, schema)


def jdbc_options(
    url: str,
    table: str,
    key: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 64,
    **options: str,
) -> dict[str, str]:
    """Reader options; a partitioned scan needs the key and its bounds."""
    found = {"url": url, "dbtable": table, "fetchsize": "10000", **options}
    if (key is None) != (bounds is None):
        raise ValueError("give key and bounds together")
    if key is not None:
        found |= {
            "partitionColumn": key,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return found


#: Columns a source table may lack; they are then null.
OPTIONAL = frozenset({"deleted_at", "metadata", "created_at", "updated_at", "error", "error_message", "chunk_run", "deleted", "id"})


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in its order and types.

    A column the table lacks becomes null if it is one of ``OPTIONAL``, else it is an error. A
    vector stored as text is parsed; a text that is no vector ends the job with an error (use
    ``vector_text.decode`` to set such rows aside).
    """
    from pyspark.sql import functions as F

    from folioseek.sources import vector_text

    present = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in present and f.name not in OPTIONAL]
    if missing:
        raise ValueError(f"the table lacks {', '.join(missing)}; it has {', '.join(df.columns)}")

    def column(f: T.StructField):
        if f.name not in present:
            return F.lit(None).cast(f.dataType).alias(f.name)
        if isinstance(f.dataType, T.ArrayType) and isinstance(present[f.name], T.StringType):
            return vector_text.parsed(f.name).alias(f.name)
        return F.col(f.name).cast(f.dataType).alias(f.name)

    return df.select(*map(column, schema.fields))


def load_tables(spark: SparkSession, root: str, names: dict[str, str] | None = None) -> Tables:
    """All tables below ``root``, one parquet folder each; ``names`` overrides folder names."""
    names = names or {}
    return Tables(**{
        name: read_parquet(spark, f"{root}/{names.get(name, name)}", schema) for name, schema in SCHEMAS.items()
    })


def join_path(tables: Tables, start: str, *path: str, how: str = "left", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Follow foreign keys by name, e.g. ``join_path(t, "documents", "document_tags", "tag")``.

    Columns come out prefixed with the path name (the start table with its own name). A table within
    ``limit`` is broadcast; past it hot and null keys are spread over the tasks.
    """
    from pyspark.sql import functions as F

    from folioseek.plans import sizing
    from folioseek.sources.schemas import FOREIGN_KEYS

    def prefixed(name: str, prefix: str) -> DataFrame:
        df = getattr(tables, name)
        return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])

    table, prefix, joined = start, start, prefixed(start, start)
    for step in path:
        if step not in FOREIGN_KEYS.get(table, {}):
            raise ValueError(f"no path {step!r} from {table}")
        here, other, there = FOREIGN_KEYS[table][step]
        right = prefixed(other, step).withColumn("_key", F.col(f"{step}_{there}"))
        joined = sizing.lookup_join(joined.withColumn("_key", F.col(f"{prefix}_{here}")), right, "_key", how, limit).drop("_key")
        table, prefix = other, step
    return joined
