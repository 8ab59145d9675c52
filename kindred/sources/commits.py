"""Tables that change by commits: immutable folders of rows, and a small manifest that names the current ones.

    path/data/<id>/          rows of one write, never changed
    path/commits/<version>   a manifest: which folders are the table since this version

A write puts its rows into a new folder, then its manifest into a file of its own, and at last
renames that file to the next version's name, which fails if another writer has taken it
(``CommitConflict``). So whatever step a driver dies at, readers see the table before or after; what is
left behind is named by no manifest and goes with ``vacuum``. The rename must not replace a file
and must be one step, as on HDFS and on a local disk with one writer; a plain object store gives
neither.

A keyed table takes its changes as further folders, so an upsert writes only what has changed; a
read keeps the newest row of each key. Once there are ``most_deltas`` of them the next upsert also
merges, which keeps the cost of a read bounded. Writers that number their writes (the epochs of a
stream) leave the number in the manifest: the same write again is recognised and skipped.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class CommitConflict(RuntimeError):
    """Another writer has committed since the table was read; read and write again."""


@dataclass
class Manifest:
    version: int = 0
    schema: str = ""
    base: list[str] = field(default_factory=list)
    deltas: list[str] = field(default_factory=list)
    epochs: dict[str, int] = field(default_factory=dict)
    note: str = ""

    @property
    def folders(self) -> list[str]:
        return [*self.base, *self.deltas]


class Table:
    """The table at a path; ``key`` and ``newest`` name the columns of one that takes upserts."""

    def __init__(self, spark: SparkSession, path: str, key: str | None = None, newest: str | None = None, most_deltas: int = 8):
        self.spark, self.path, self.key, self.newest, self.most_deltas = spark, path.rstrip("/"), key, newest, most_deltas
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # --- reading --------------------------------------------------------------------------------

    def head(self) -> Manifest | None:
        """The newest manifest, or None of a table that was never written."""
        versions = self._versions()
        return self.manifest(versions[-1]) if versions else None

    def manifest(self, version: int) -> Manifest:
        source, fs = self._at(f"commits/{version:020d}")
        stream = fs.open(source)
        try:
            return Manifest(**json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def exists(self) -> bool:
        return bool(self._versions())

    def read(self, schema: StructType | str | None = None, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of an older one that vacuum has left.

        A table that was never written is empty and needs a schema. A manifest whose folders are
        gone is an error, never an empty table.
        """
        at = self.head() if version is None else self.manifest(version)
        if at is None:
            if schema is None:
                raise ValueError(f"no table at {self.path}, and no schema for an empty one")
            return self.spark.createDataFrame([], schema)
        return self._rows(at)

    def history(self) -> DataFrame:
        """A row for each version that is left: version, note, folders."""
        rows = [(m.version, m.note, len(m.base), len(m.deltas)) for m in map(self.manifest, self._versions())]
        return self.spark.createDataFrame(rows, "version long, note string, base int, deltas int")

    def _rows(self, at: Manifest) -> DataFrame:
        kind = StructType.fromJson(json.loads(at.schema))
        if not at.folders:
            return self.spark.createDataFrame([], kind)
        for folder in at.folders:
            source, fs = self._at(f"data/{folder}")
            if not fs.exists(source):
                raise FileNotFoundError(f"{source.toString()}, which version {at.version} names")
        parts = [self.spark.read.schema(kind).parquet(f"{self.path}/data/{folder}") for folder in at.folders]
        if not at.deltas:
            return reduce(DataFrame.unionByName, parts)
        every = reduce(DataFrame.unionByName, [p.withColumn("_order", F.lit(0 if folder in at.base else 1 + at.deltas.index(folder))) for p, folder in zip(parts, at.folders)])
        rows = every.groupBy(self.key).agg(F.max_by(F.struct(*kind.names), F.struct(F.col(self.newest), "_order")).alias("_row"))
        return rows.select(*(F.col("_row")[c].alias(c) for c in kind.names))

    # --- writing --------------------------------------------------------------------------------

    def overwrite(self, df: DataFrame, writer: str = "", epoch: int | None = None) -> DataFrame:
        """df in place of the table, which df may read. An epoch that ``writer`` has committed changes nothing."""
        head = self.head() or Manifest()
        if not self._done(head, writer, epoch):
            self._commit(head, df, base=[self._write(df)], deltas=[], epochs=self._epochs(head, writer, epoch), note="overwrite")
        return self.read()

    def upsert(self, changes: DataFrame, writer: str = "", epoch: int | None = None) -> DataFrame:
        """Put changes into the table: of each key the row that is last by ``newest`` stays; a change wins a tie.

        Of several changes to a key the last by ``newest`` counts; equal ones end by the row's own order.
        """
        if self.key is None or self.newest is None:
            raise ValueError("a table takes upserts by a key and a column that orders its rows")
        head = self.head() or Manifest()
        if self._done(head, writer, epoch):
            return self.read()
        last = changes.groupBy(self.key).agg(F.max(F.struct(F.col(self.newest).alias("_newest"), *changes.columns)).alias("_row"))
        folder = self._write(last.select(*(F.col("_row")[c].alias(c) for c in changes.columns)))
        epochs, fields = self._epochs(head, writer, epoch), {"base": head.base, "deltas": [*head.deltas, folder]}
        note = "upsert"
        if len(fields["deltas"]) > self.most_deltas:
            merged = self._rows(Manifest(head.version, changes.schema.json(), fields["base"], fields["deltas"]))
            fields, note = {"base": [self._write(merged)], "deltas": []}, "upsert and merge"
        self._commit(head, changes, **fields, epochs=epochs, note=note)
        return self.read()

    def merge(self) -> DataFrame:
        """One folder in place of the base and its deltas, with the same rows."""
        head = self.head()
        if head is not None and head.deltas:
            rows = self._rows(head)
            self._commit(head, rows, base=[self._write(rows)], deltas=[], epochs=head.epochs, note="merge")
        return self.read()

    def vacuum(self, keep: int = 1) -> int:
        """Delete what the last ``keep`` versions do not name; how many folders went. Not to be run beside a writer."""
        versions = self._versions()
        kept = versions[-keep:]
        named = {folder for v in kept for folder in self.manifest(v).folders}
        gone = 0
        for v in versions[: len(versions) - len(kept)]:  # manifests first: what they name may go then
            self._step("drop manifest")
            self._delete(f"commits/{v:020d}")
        for name in self._names("commits"):
            if name.startswith("new-"):
                self._delete(f"commits/{name}")
        for folder in self._names("data"):
            if folder not in named:
                self._step("drop folder")
                self._delete(f"data/{folder}")
                gone += 1
        return gone

    def _write(self, df: DataFrame) -> str:
        folder = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/data/{folder}")
        self._step("rows written")
        return folder

    def _commit(self, head: Manifest, df: DataFrame, base: list[str], deltas: list[str], epochs: dict[str, int], note: str) -> None:
        own = Manifest(head.version + 1, df.schema.json(), base, deltas, epochs, note)
        fresh, fs = self._at(f"commits/new-{uuid.uuid4().hex}")
        out = fs.create(fresh, False)
        out.write(bytearray(json.dumps(asdict(own)).encode()))
        self._step("manifest begun")
        out.close()
        self._step("manifest written")
        to, _ = self._at(f"commits/{own.version:020d}")
        if fs.exists(to) or not self._renamed(fs, fresh, to):
            fs.delete(fresh, False)
            raise CommitConflict(f"version {own.version} of {self.path} is another writer's")
        self._step("committed")

    def _renamed(self, fs, fresh, to) -> bool:
        """Rename without replacing: where a version's name is taken, it stays as it is."""
        from py4j.protocol import Py4JJavaError

        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(self._jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            context.rename(fresh, to, options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    @staticmethod
    def _done(head: Manifest, writer: str, epoch: int | None) -> bool:
        return epoch is not None and head.epochs.get(writer, -1) >= epoch

    @staticmethod
    def _epochs(head: Manifest, writer: str, epoch: int | None) -> dict[str, int]:
        return head.epochs if epoch is None else {**head.epochs, writer: epoch}

    def _step(self, name: str) -> None:
        """Called between the steps of a write; tests break off here."""

    # --- files ----------------------------------------------------------------------------------

    def _at(self, name: str):
        p = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self._conf)

    def _names(self, folder: str) -> list[str]:
        p, fs = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _versions(self) -> list[int]:
        return [int(n) for n in self._names("commits") if n.isdigit()]

    def _delete(self, name: str) -> None:
        p, fs = self._at(name)
        fs.delete(p, True)
