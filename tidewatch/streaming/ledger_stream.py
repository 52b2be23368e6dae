"""A stream of predictions appended to a ledger, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.bands import band_by_rank
from ..functions.scalars import add_business_days_10


def with_prediction(df: DataFrame, asof: str = "asof", rank: str = "rank") -> DataFrame:
    """Signal, band and resolving date beside a ranked probability."""
    b = band_by_rank(F.col(rank))
    return df.withColumns({"signal": (F.col(rank) >= 0.70).cast("int"), "band_lo": b["lo"], "band_hi": b["hi"], "label_resolves_after": add_business_days_10(F.col(asof).cast("date"))})


def append_predictions(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream's rows to the ledger at ``path`` as JSON lines.

    Each micro-batch goes to its own folder, written over on a retry, so a batch
    that is run again after a failure leaves one copy.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={epoch}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
