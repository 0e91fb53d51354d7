"""What the corpus operators share: table access, row keys, shared storage, digests.

Conventions that hold for every operator of this subpackage
------------------------------------------------------------
* Input columns are picked by name right at the start, so extra columns with
  any name never clash with the operator's own (which begin with ``_``).
* A null text counts as an empty text.
* ``doc_id`` is expected to be unique. Rows that repeat an id are told apart
  by their text; rows that repeat both get one identical result row each.
* A null ``doc_id`` is an id of its own, larger than all others.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Words between ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Words of digits, lower-case ASCII letters and all that is not ASCII.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands for a null doc_id where ids are compared.
NO_ID = 2**63 - 1
#: A side may be broadcast up to this many bytes, as estimated from its counted rows.
BROADCAST_BYTES = 32 << 20
#: Packed rows leave Python by so many, so that no worker and no executor holds a second whole batch of them.
PART = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` has a fast path for pure ASCII; the rest goes by ``translate``."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def packed(documents: DataFrame) -> DataFrame:
    """Each row as one struct, _doc, so that no column of it can clash with an operator's own."""
    return documents.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in documents.columns]).alias("_doc"))


def of(name: str) -> Column:
    """A column of a packed row."""
    return F.col("_doc").getField(name)


def parts(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Packed rows (_doc) by PART, each part with the field at place: a text need not be sent beside the row that holds it."""
    for b in batches:
        for at in range(0, b.num_rows, PART):
            docs = b.column(0).slice(at, PART)
            yield docs, docs.field(place)


def place_of(name: str, documents: DataFrame) -> int:
    """Where documents have a column, which Spark finds in any case."""
    names = documents.columns
    return names.index(name) if name in names else [c.lower() for c in names].index(name)


def unpacked(df: DataFrame, documents: DataFrame, **new: Column) -> DataFrame:
    """The columns of documents again, some with new values; n_chars follows a new text."""
    if "text" in new and "n_chars" in documents.columns:
        new = new | {"n_chars": F.length(new["text"]).cast(documents.schema["n_chars"].dataType)}
    return df.select(*[new.get(c, of(c)).alias(c) for c in documents.columns])


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


@cache
def _own_dir(application: str) -> str:
    path = tempfile.mkdtemp(prefix=f"quillon-{application}-")
    atexit.register(shutil.rmtree, path, True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Only where driver and executors are one process may it be a folder of our
    own; a cluster without a named folder is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or _own_dir(context.applicationId)).rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit; the folder's owner clears it then
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that :func:`stored` wrote, once what was made of them is stored itself."""
    for df in tables:
        _remove(df.sparkSession, df._stored_at)


def fits(rows: int, row_bytes: int) -> bool:
    """Whether so many rows may be broadcast."""
    return rows * row_bytes <= BROADCAST_BYTES


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df, to be broadcast if its counted rows times row_bytes stay under BROADCAST_BYTES; else Spark joins by shuffle."""
    return F.broadcast(df) if fits(rows, row_bytes) else df


def dealt(df: DataFrame) -> DataFrame:
    """df, whose joins go by shuffle: for rows that Python makes many of. Spark takes them for as few as they are made from, and would broadcast them by that."""
    return df.hint("merge")


def marked(places: Column) -> Column:
    """For sorted, distinct, whole places an array that has 1 at each of them and 0 before, as long as the last one needs. Linear."""
    begins = F.array_except(places, F.transform(places, lambda x: x + 1))
    ends = F.array_except(places, F.transform(places, lambda x: x - 1))
    upto = F.concat(F.array(F.lit(-1)), ends)
    gaps = F.zip_with(begins, F.slice(upto, F.lit(1), F.size(begins)), lambda b, e: b - e - 1)
    runs = F.zip_with(begins, ends, lambda b, e: e - b + 1)
    return F.flatten(F.zip_with(gaps, runs, lambda g, n: F.concat(F.array_repeat(F.lit(0), g), F.array_repeat(F.lit(1), n))))


def one_of_each(documents: DataFrame, found: DataFrame) -> DataFrame:
    """documents with one row left for each root of found (id, tag, root): the smallest id's, and of its texts the one of the smallest hash.

    id is doc_id with NO_ID for null, tag the text's xxhash64. Rows that repeat
    id and text are told apart by nothing: any of them will do.
    """
    first = found.groupBy("root").agg(F.min(F.struct("id", "tag")).alias("f"))
    kept = stored(first.select(F.col("f.id").alias("_id"), F.col("f.tag").alias("_tag")), "kept")
    own, tag = F.coalesce(of("doc_id"), F.lit(NO_ID)), F.xxhash64(of("text"))
    rows = packed(documents).join(kept, (own == F.col("_id")) & (tag == F.col("_tag")), "left_semi")
    if found.groupBy("id", "tag").count().where("count > 1").limit(1).count():
        rows = rows.withColumn("_i", own).withColumn("_t", tag).dropDuplicates(["_i", "_t"])
    return unpacked(rows, documents)
