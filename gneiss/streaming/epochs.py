"""Collection by epochs: the spans in which objects are set aside, in batch, and as a stream of references with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

GRACE = 2


def quarantine_spans(references: DataFrame, key: str, grace: int = GRACE) -> DataFrame:
    """(key, referenced, quarantined, deleted): for references (key, epoch), each time an object is set aside the epoch after
    its last reference, and when it is deleted, null if it is referred to again before.

    References are made distinct first, so a hot object brings one row an epoch into the window."""
    e = references.select(key, F.col("epoch").cast("long").alias("epoch")).distinct()
    last = e.agg(F.max("epoch").alias("last"))
    w = Window.partitionBy(key).orderBy("epoch")
    rows = e.withColumn("next", F.lead("epoch").over(w)).join(F.broadcast(last))  # one row
    until = F.coalesce("next", F.col("last") + 1)
    rows = rows.where(until > F.col("epoch") + 1)
    return rows.select(key, F.col("epoch").alias("referenced"), (F.col("epoch") + 1).alias("quarantined"), F.when(until > F.col("epoch") + 1 + grace, F.col("epoch") + 1 + grace).alias("deleted"))


def stream_collect(references: DataFrame, grace: int = GRACE) -> DataFrame:
    """A stream of (digest, epoch) to (digest, epoch, action): ``reference`` at first sight, ``rescue`` when an object comes
    back after more than an epoch without reference but within the grace, ``readmit`` when it was deleted by then."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        epochs = sorted({int(e) for f in frames for e in f["epoch"]})
        out = []
        for e in epochs:
            if last is None:
                out.append((key[0], e, "reference"))
            elif e > last + 1 + grace:
                out.append((key[0], e, "readmit"))
            elif e > last + 1:
                out.append((key[0], e, "rescue"))
            last = e if last is None else max(last, e)
        state.update((last,))
        yield pd.DataFrame(out, columns=["digest", "epoch", "action"])

    return references.groupBy("digest").applyInPandasWithState(step, "digest string, epoch long, action string", "last long", "append", GroupStateTimeout.NoTimeout)
