"""Dataset registration as a stream: upload manifests (json lines with
``file_name, rows, columns, description``) arrive in a folder; each
micro-batch is recorded append-if-absent into the catalog table.  The
write is idempotent by ``file_name``, so a batch replayed after a failure
registers nothing twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tablelens.sources.catalog import CATALOG_SCHEMA, empty_catalog, record_datasets

MANIFEST_SCHEMA = "file_name string, rows long, columns int, description string, upload_time timestamp_ntz"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(CATALOG_SCHEMA).parquet(path)
    except AnalysisException:
        return empty_catalog(spark)


def run_registration(spark: SparkSession, inbox: str, catalog_path: str, checkpoint: str,
                     available_now: bool = True):
    manifests = spark.readStream.schema(MANIFEST_SCHEMA).json(inbox)

    def sink(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        current = read_catalog(spark, catalog_path)
        when = batch.agg(F.max("upload_time")).first()[0]
        updated = record_datasets(current, batch.select("file_name", "rows", "columns", "description"), when)
        new_rows = updated.join(current.select("file_name"), "file_name", "left_anti")
        new_rows.select(*current.columns).write.mode("append").parquet(catalog_path)

    q = manifests.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    if available_now:
        q = q.trigger(availableNow=True)
    return q.start()
