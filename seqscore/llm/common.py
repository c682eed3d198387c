"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqscore.session import cut_lineage, ensure_checkpoint_dir, table_path

__all__ = ["cut_lineage", "ensure_checkpoint_dir", "table", "slices", "held_out", "select_rows"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def held_out(doc_id: str = "doc_id"):
    """True on the rows that no model may learn from: crc32 of the id's text, mod 4, is 2.
    A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` has about ``most`` bytes in each, one row at least."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        step = max(1, int(rows * most / max(col.nbytes, 1)))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def select_rows(docs: DataFrame, wanted, text: str = "text", most: int = 4 << 20) -> DataFrame:
    """The rows of ``docs``, with all their columns, for which ``wanted(list of UTF-8 texts)``
    is true; null text counts as empty. Nothing is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, most):
            bodies = [t.as_py() or b"" for t in batch.column(batch.schema.get_field_index(text)).cast(pa.binary())]
            yield batch.filter(pa.array(wanted(bodies), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
