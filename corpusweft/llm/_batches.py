"""What the operators share: Arrow batches of bounded size, texts as bytes, and checkpoints in the shared folder."""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A batch sent to Python holds about so many bytes: arrays over a batch take some 60 times that in a worker.
BATCH_BYTES = 1 << 20
#: Python workers are reused, so what a task has freed goes back to the system: for the C library, the sizes from which it does. The same wherever it runs.
WORKER_ENVIRONMENT = {"MALLOC_MMAP_THRESHOLD_": str(1 << 19), "MALLOC_TRIM_THRESHOLD_": str(1 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is not None


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches end by bytes, not only by rows: texts differ in length by a factor of 1000."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    for name, value in WORKER_ENVIRONMENT.items():
        spark.sparkContext.environment.setdefault(name, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's ``spark.checkpoint.dir``.

    Where that is unset, it is a temporary one in local mode (tests), and an error elsewhere.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through files in the shared folder, which survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def unused(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to differ from all those taken, whatever the case."""
    known, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in known:
            name = f"_{name}"
        known.add(name.lower())
        out.append(name)
    return out


def texts_as_bytes(batch: pa.RecordBatch, column: str | int = "text") -> list[bytes]:
    """The UTF-8 bytes of each text of a column, by name or place; null counts as empty."""
    return [b"" if t is None else t for t in batch.column(column).cast(pa.binary()).to_pylist()]


def lengths(items: list) -> np.ndarray:
    return np.fromiter(map(len, items), np.int64, len(items))


def ends_of(sizes: np.ndarray) -> np.ndarray:
    """0, then the running total: item i spans [ends[i], ends[i + 1])."""
    ends = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    return ends


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0] + 1, ... (sizes[0] of them), then those of the next span."""
    ends = ends_of(sizes)
    return np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Numbers(dict):
    """Numbers keys in the order they are first looked up, so that ``map(numbers.__getitem__, keys)`` runs in C."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number
