"""The rule suite on a stream: every micro-batch is an increment.

The streaming checkpoint takes the place of a stored "last validated"
timestamp: each row is validated once, also across restarts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plumbline.model import Dataset, Rule
from plumbline.plans.suite import SuiteRun, run_suite


def validate_stream(
    stream: DataFrame,
    dataset: Dataset,
    rules: Sequence[Rule],
    *,
    results_path: str,
    checkpoint_path: str,
    failed_rows_path: str | None = None,
    datasets: Mapping[str, Dataset] | None = None,
    trigger: Mapping[str, object] | None = None,
    on_batch: Callable[[SuiteRun], None] | None = None,
) -> StreamingQuery:
    """Run the suite on every micro-batch and store its results.

    A batch writes to its own folder and overwrites it, so a batch that is
    repeated after a failure leaves one set of results.
    """

    def validate(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        # Several jobs read the batch; it is computed once.
        batch.persist()
        try:
            run = run_suite(dataset.with_frame(batch), rules, run_id=batch_id, datasets=datasets)
            run.results.write.mode("overwrite").parquet(f"{results_path}/batch={batch_id}")
            if failed_rows_path is not None:
                failed = run.failed_rows()
                if failed is not None:
                    failed.write.mode("overwrite").parquet(f"{failed_rows_path}/batch={batch_id}")
            if on_batch is not None:
                on_batch(run)
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(validate)
        .option("checkpointLocation", checkpoint_path)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
