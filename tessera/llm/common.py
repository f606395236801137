"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The white space that the word rules know: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
#: str.translate table that lower-cases A-Z only.
FOLD = str.maketrans(UPPER, LOWER)
#: Documents handed to a Python batch function at once; bounds a worker's memory, not the result.
ROWS = 256


class Memory(dict):
    """Values by key, made when first asked for. Two generations bound it: a full younger one becomes the elder, whose
    entries come back on use. Keys over LONGEST characters are made anew each time."""

    LONGEST = 64

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self.make, self.size, self.elder = make, size, {}

    def __missing__(self, key):
        value = self.elder.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.LONGEST:
            self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.size:
            self.elder = dict(self)
            self.clear()
        self[key] = value


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a session on one machine (local master) may leave it unset; elsewhere that is an error,
    because executors cannot read each other's local folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file:///tmp/checkpoints"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing will read again: all that follows from them must have been cut itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.cut_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that nothing will read again, now that a table is cut: else they stay until the driver happens to collect its garbage."""
    jvm, bus = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().listenerBus()
    with suppress(Py4JJavaError):  # events still under way hold the plan; a busy bus only means that files stay longer
        bus.waitUntilEmpty(10_000)
    for _ in range(2):  # plans that Python lets go of, then what hangs on them
        gc.collect()
        jvm.System.gc()


def pack(*arrays: np.ndarray) -> bytes:
    """Columns of numbers: bytes of equal weight side by side, compressed."""
    import zstandard

    parts = [zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()) for a in arrays]
    kinds = ",".join(a.dtype.str for a in arrays).encode()
    head = np.array([len(kinds), len(arrays[0]), len(parts), *map(len, parts)], "<i8")
    return head.tobytes() + kinds + b"".join(parts)


def unpack(body: bytes) -> list[np.ndarray]:
    import zstandard

    k, n, m = (int(x) for x in np.frombuffer(body, "<i8", 3))
    sizes = np.frombuffer(body, "<i8", m, 24)
    at = 24 + 8 * m + k
    out = []
    for kind, size in zip(body[24 + 8 * m : at].decode().split(","), sizes.tolist()):
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[at : at + size], max_output_size=max(1, n * np.dtype(kind).itemsize)), np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, n).T).view(kind).ravel())
        at += size
    return out


def fold(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def map_lists(df: DataFrame, make: Callable[[], Callable], schema: str, rows: int = ROWS) -> DataFrame:
    """mapInArrow with Python lists.

    ``make()`` runs once a task and returns ``fn(*columns) -> columns``; ``fn`` gets at most ``rows`` rows.
    """
    out = StructType.fromDDL(schema)
    kinds, names = to_arrow_schema(out), out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = fn(*(c.to_pylist() for c in part.columns))
                if len(got[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(v, type=k) for v, k in zip(got, kinds.types, strict=True)], names=names)

    return df.mapInArrow(run, out)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
