"""Requests that keep arriving: the same answering job, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from credence.plans.ask import Answers, screen
from credence.session import settle, settled_scope


def screen_stream(requests: DataFrame) -> DataFrame:
    """Input check, intent and trace id of a streaming request table; stateless, so nothing is kept."""
    return screen(requests)


def answer_stream(
    requests: DataFrame,
    answer: Callable[[DataFrame], Answers],
    folder: str,
    checkpoint: str,
    **trigger,
) -> StreamingQuery:
    """Answers requests and appends responses and audit rows below `folder`.

    By default it stops after what is there; `processingTime="10 seconds"` goes on with what keeps arriving.

    Each micro-batch owns one batch_id=N folder and overwrites it, so a batch that runs
    again after a failure leaves its rows once.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        with settled_scope(batch.sparkSession):
            answers = answer(settle(batch))
            answers.responses.write.mode("overwrite").parquet(f"{folder}/responses/batch_id={batch_id}")
            answers.audit_log().withColumn("logged_at", F.current_timestamp()).write.mode("overwrite").parquet(
                f"{folder}/audit/batch_id={batch_id}"
            )

    return (
        requests.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
