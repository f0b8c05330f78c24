"""Index maintenance from a stream: each micro-batch is inserted (or deleted) once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def maintain(index, stream: DataFrame, checkpoint: str, v: str = "embedding", key: str | None = None, deleted: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Applies a stream of rows to an index: rows whose boolean column `deleted` is true are deleted, others inserted.

    A batch's deletions come before its insertions, so a key that has both is updated. Both count from the moment on when
    the index's metadata is saved, with the batch's number: a batch that is delivered again is skipped if it was, and
    written over what was left of it if not.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if index.meta.get("last_batch", -1) >= number:
            return
        batch.persist()
        try:
            own = key or index.meta["key"]
            if deleted is not None:
                gone = batch.where(F.col(deleted))
                if not gone.isEmpty():
                    index.delete(gone, own, commit=False)
            new = batch if deleted is None else batch.where(~F.coalesce(F.col(deleted), F.lit(False)))
            if not new.isEmpty():
                index.insert(new, v, own, commit=False)
            index.meta["last_batch"] = number
            index.store.save_meta(index.meta)
        except BaseException:
            index.meta.clear()  # what was written doesn't count; the next try writes over it
            index.meta.update(index.store.load_meta())
            raise
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
