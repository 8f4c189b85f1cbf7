"""Finding the rows that hold tokens of a shared set, whatever its size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many tokens (8 bytes each) go to all tasks; more are joined by a shuffle.
BROADCAST = 4_000_000


def offered(source: DataFrame, tokens: Callable[[], DataFrame], shared: DataFrame, limit: int = BROADCAST):
    """(``source`` with a column ``own``, function (row's ``own``) -> sorted tokens to look for).

    ``source`` has a column ``id``, ``tokens()`` gives (id, token), ``shared`` has distinct ``token``. Rows that can't hold any may be
    missing from the result.
    """
    if shared.count() <= limit:
        values = np.sort(shared.toArrow()["token"].to_numpy().view(np.uint64))
        sent = source.sparkSession.sparkContext.broadcast(values)
        return source.withColumn("own", F.lit(None).cast("array<long>")), lambda own: sent.value
    held = tokens().join(shared, "token").groupBy("id").agg(F.collect_set("token").alias("own"))
    return source.join(held, "id"), lambda own: np.sort(np.array(own.as_py(), np.int64).view(np.uint64))


def present(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the values are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def flat(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64))
