"""Streams of raw listings into a table without duplicates, and streams of scoring requests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from forecourt.operators.append import append_new
from forecourt.operators.audit import write_audit
from forecourt.operators.scoring import score
from forecourt.operators.training import PriceModel
from forecourt.params import RequestRules


def append_stream(stream: DataFrame, target: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Append the new rows of every micro-batch and stop when the input is used up.

    The target itself is the dedup state, so nothing grows in the executors. A batch that runs
    again after a failure replaces its own folder (see `append_new`).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # The id that Spark gives a query lives in its checkpoint, so it survives restarts and no
        # other stream has it, also not one that begins anew at the same place.
        stored = batch.sparkSession.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0]
        append_new(batch, target, keys, batch_id, writer=json.loads(stored)["id"])

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def score_stream(
    requests: DataFrame, model: PriceModel, target: str, checkpoint: str, rules: RequestRules = RequestRules()
) -> StreamingQuery:
    """Score a stream of requests into the audit table; a batch that runs again replaces its own rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        stored = batch.sparkSession.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0]
        write_audit(score(batch, model, rules), target, batch_id, writer=json.loads(stored)["id"])

    return (
        requests.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
