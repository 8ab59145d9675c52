"""What several operators share: the shared folder, written tables and packed numbers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where that is unset, a local session gets a folder of its own; a cluster must name one.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-kindred-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/kindred/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has gone before
            pass

    atexit.register(remove)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: it is computed once and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined_apart(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined with right, an aggregate by key (a long) with one row for each.

    The join is on the key's complement, so that it has a shuffle of its own and does not take over
    that of the aggregate: adaptive execution can then split the rows of a hot key among tasks.
    """
    other = right.select(F.bitwise_not(F.col(key)).alias("_not"), *(c for c in right.columns if c != key))
    return left.withColumn("_not", F.bitwise_not(F.col(key))).join(other, "_not", how).drop("_not")


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: one pass that decides how many groups the data is dealt into."""
    return docs.select(F.sum(F.octet_length(whole_text())).alias("b")).first()["b"] or 0


def slices(batch: pa.RecordBatch, column: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of a text column, whole rows each."""
    sizes = np.cumsum(np.diff(np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset :][: batch.num_rows + 1]).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()  # a worker lives on for other tasks; what was freed goes back


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays by name as one zstd string; an array of objects holds byte strings."""
    import zstandard

    flat: dict[str, np.ndarray] = {}
    for k, v in arrays.items():
        if v.dtype == object:
            flat[f"{k}#"] = np.fromiter(map(len, v), np.uint32, len(v))
            v = np.frombuffer(b"".join(v), np.uint8)
        flat[k] = v
    head = ";".join(f"{k}:{v.dtype.str}:{','.join(map(str, v.shape))}" for k, v in flat.items()).encode()
    body = b"".join(np.ascontiguousarray(v).tobytes() for v in flat.values())
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + body)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n, out = int.from_bytes(raw[:4], "little"), {}
    at = 4 + n
    for one in raw[4:at].decode().split(";"):
        name, kind, shape = one.split(":")
        dims = tuple(map(int, shape.split(",")))
        count = int(np.prod(dims))
        out[name] = np.frombuffer(raw, kind, count, at).reshape(dims)
        at += count * np.dtype(kind).itemsize
    for name in [k for k in out if k.endswith("#")]:
        ends = np.cumsum(out.pop(name), dtype=np.int64)
        flat = out[name[:-1]].tobytes()
        own = np.empty(len(ends), object)
        own[:] = [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        out[name[:-1]] = own
    return out
