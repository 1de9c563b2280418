"""Helpers shared by the corpus operators: words, shared folders, stored tables, batch sizes."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papertrail.session import ensure_checkpoint_dir

#: Rows and bytes of one Arrow batch; a batch of long texts then stays far below a worker's memory.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20

#: A-Z in lower case and every byte that is not part of a word as a blank. Bytes from 0x80
#: on belong to characters outside ASCII, which are word characters.
_BLANKS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

#: What separates words, for regular expressions on the JVM side.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes: A-Z in lower case, runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_BLANKS).split() if text else []


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case. ``lower`` also changes letters outside ASCII; the Kelvin sign is the only one
    of them that would become an ASCII letter by itself, so it is replaced first. A dotted capital I
    becomes an i with a combining dot, which is no plain word of a phrase either."""
    return F.lower(F.replace(text, F.lit("K"), F.lit("ĸ")))


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session, which otherwise hold 10,000 texts of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def new_folder(spark: SparkSession, what: str) -> str:
    """A new path below the folder that driver and executors share (``spark.checkpoint.dir``)."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/llm-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write a table once into the shared folder and read it back: cuts the lineage, is
    compressed and column-pruned, and survives the loss of executors."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder name as Hadoop writes it (``file:/x``, ``hdfs://…`` or a plain path)."""
    uri = re.sub(r"^file:/+", "/", uri)
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as one Arrow batch; unlike pandas, longs keep their precision beside nulls."""
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def longs(*names: str) -> pa.Schema:
    return pa.schema([(n, pa.int64()) for n in names])


def ddl(schema: pa.Schema) -> str:
    """An Arrow schema of plain columns as Spark writes it."""
    names = {pa.int64(): "long", pa.float64(): "double", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def positions(df: DataFrame, order: list[Column], what: str, out: str = "position") -> DataFrame:
    """Adds the place of every row, from 0, in the order given; the order should be total but for equal rows.

    Rows are dealt by ranges and sorted within them, so no task sees all of them; what precedes a range is
    added up over one row per range. ``df`` is read twice (once for the bounds), so store what is costly.
    """
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    kept = stored(ranged.withColumn("__at", F.monotonically_increasing_id()), what)
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = kept.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    return (kept.withColumn("__part", part).join(F.broadcast(offsets), "__part")
            .withColumn(out, F.col("__before") + within).drop("__part", "__before", "__at"))
