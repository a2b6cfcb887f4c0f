"""Scored payments kept by ingestion day, with the day's sums beside them.

Each batch of scored rows is laid out by the day it was ingested, and adds its
counts and amounts to an aggregate by (ingestion day, transaction day,
category, predicted fraud). The daily reports read the sums of one day, and
rows of one day where they list rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylake.sources.aggregate_store import AggregateStore
from paylake.sources.period_table import PeriodTable

DAY = "ingest_day"


class ScoredStore:
    def __init__(self, spark: SparkSession, root: str, grain: str = "month"):
        self.rows = PeriodTable(spark, f"{root.rstrip('/')}/rows", DAY, grain)
        self.sums = AggregateStore(spark, f"{root.rstrip('/')}/sums", [DAY, "transaction_date", "category", "is_fraud_predicted"],
                                   sums=["n", "amount", "n_amount"], by=DAY)

    def add(self, scored: DataFrame, batch_id, derive=None) -> None:
        """Store a batch; one that is written again changes nothing. ``derive`` adds columns that follow
        from a row's others, after rows are shuffled and sorted."""
        folders = self.rows.append(scored.withColumn(DAY, F.to_date("ingested_at")), batch_id, F.desc("is_fraud_predicted"), derive=derive)
        # from what was written, so that sums and rows agree also after a failure between the two
        mine = self.rows.folders(folders)
        self.sums.add(mine.select(DAY, F.to_date("trans_date_trans_time").alias("transaction_date"), "category", "is_fraud_predicted",
                                  F.lit(1).cast("long").alias("n"), F.col("amt").cast("decimal(38,2)").alias("amount"),
                                  F.when(F.col("amt").isNotNull(), 1).otherwise(0).cast("long").alias("n_amount")), batch_id)
        self.rows.compact()
        if self.sums.compact():
            self.sums.vacuum()

    def day_rows(self, day) -> DataFrame:
        """The rows ingested on one day; only the folders of its period are opened."""
        return self.rows.read(day, day)

    def day(self, day) -> DataFrame:
        """The sums of one ingestion day."""
        return self.sums.read(F.col(DAY) == F.lit(str(day)[:10]).cast("date"))
