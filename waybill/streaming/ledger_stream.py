"""The ledger fed by a stream: each micro-batch is appended with running numbers.

A batch that is run again after a failure must not be appended twice, so each batch
carries its number in the path; reading takes all of them together.  Its numbers are
claimed (:mod:`waybill.operators.claims`) under the stream's and the batch's name, so a
batch that is run again gets the numbers it had, other writers may append in between,
and no batch reads the rows of earlier ones.

A submission that is sent again within a time is no second booking: which ids were seen
is the stream's state, kept as long as that time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from waybill.operators.claims import claim_of_batch
from waybill.operators.ledger import numbered, real
from waybill.session import Tables


def once(bookings: DataFrame, submission: str, sent_at: str, within: str = "7 days") -> DataFrame:
    """A stream's bookings without those whose ``submission`` came before, up to
    ``within`` earlier by the event time ``sent_at`` (a timestamp).  Later ones than the
    watermark, the same time behind the latest, are dropped; null ids are one id."""
    return bookings.withWatermark(sent_at, within).dropDuplicatesWithinWatermark([submission])


def append_stream(bookings: DataFrame, path: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """Append a stream of bookings (see ``ledger``) below ``path``; ``sno`` runs
    through all micro-batches and ``batch`` names each."""

    def write(batch: DataFrame, number: int) -> None:
        with Tables(batch.sparkSession, "ledger") as tables:
            rows = numbered(real(batch), order, put=tables.put)
            n = rows.count()
            first = claim_of_batch(batch.sparkSession, path, n, "stream", number) if n else 1
            rows.withColumn("sno", rows["sno"] + (first - 1)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return bookings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
