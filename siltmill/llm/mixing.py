"""Models fitted on shards of a table, and mixed.

A table's rows are dealt to shards by a hash, each shard is fitted on its own, and every weight of the mixed model is the mean
over the shards, each counted as often as it has seen what the weight stands for. The weights go to the driver added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Parts that a shard's weights are sent in; the same parts of all shards are added up together.
PARTS = 16
#: Columns of a shard's part: values (float32, one row or number for each of the counts) and counts (float32).
SCHEMA = "part int, shard int, value binary, seen binary"


def parts_of(shard: int, value: np.ndarray, seen: np.ndarray, first: int = 0) -> Iterator[tuple[int, int, bytes, bytes]]:
    """The rows of SCHEMA of one array of weights, numbered from `first` on."""
    for i, (v, s) in enumerate(zip(np.array_split(value, PARTS), np.array_split(seen, PARTS))):
        yield first + i, shard, v.astype(np.float32).tobytes(), s.astype(np.float32).tobytes()


def mixed(parts: DataFrame) -> dict[int, np.ndarray]:
    """For each part the flat mean of its values over the shards, weighted by the counts; the plain mean where no shard has a count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for part, _, value, seen in zip(*(c.to_pylist() for c in batch.columns)):
                s = np.frombuffer(seen, np.float32).astype(np.float64)[:, None]
                v = np.frombuffer(value, np.float32).astype(np.float64).reshape(len(s), -1)
                if part in sums:
                    for total, x in zip(sums[part], (v * s, s, v, 1)):
                        total += x
                else:
                    sums[part] = [v * s, s.copy(), v.copy(), np.ones(1)]
        values = [np.where(s > 0, vs / np.maximum(s, 1e-30), v / n).astype(np.float32).tobytes() for vs, s, v, n in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(values, pa.binary())], ["part", "value"])

    # in the order of the shards, so that rounding is the same in every run
    ordered = parts.select("part", "shard", "value", "seen").repartition(PARTS, "part").sortWithinPartitions("part", "shard")
    found = ordered.mapInArrow(run, "part int, value binary").toArrow()
    return {p: np.frombuffer(v, np.float32) for p, v in zip(found.column(0).to_pylist(), found.column(1).to_pylist())}


def joined(found: dict[int, np.ndarray], first: int = 0) -> np.ndarray:
    """The array whose parts begin at `first`."""
    return np.concatenate([found[first + i] for i in range(PARTS)])
