"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The white space of the word rule [^\x20\x09-\x0D]+ in Java's and RE2's syntax.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of every row; a null text is empty. Other columns don't matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def fold_of(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    text = F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str)
                      else doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % n


def sample_of(rows: DataFrame, key: list[str], n: int) -> list[Row]:
    """At most ``n`` rows, those of the smallest hashes of ``key``. The hashes are chosen first,
    so each task sends ``n`` numbers and only rows of the sample reach the driver."""
    hashed = rows.withColumn("_hash", F.xxhash64(*key))
    least = [r[0] for r in hashed.select("_hash").orderBy("_hash").limit(n).collect()]
    if not least:
        return []
    taken = hashed.where(F.col("_hash") <= least[-1]).limit(n).collect()
    return sorted(taken, key=lambda r: r["_hash"])


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, in UTF-8."""
    return text.encode().lower().split()


def map_batches(df: DataFrame, fn: Callable[[], Callable[[pa.RecordBatch], dict]],
                schema: str | StructType) -> DataFrame:
    """Map Arrow batches: ``fn()`` runs once a task and gives the function for its batches."""
    shape = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        out, step = to_arrow_schema(shape), fn()
        for batch in batches:
            columns = step(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, shape)
