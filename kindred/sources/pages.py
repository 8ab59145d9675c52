"""A catalog of pages as a source of its own: read page by page up to the first that fails, up to PARTITIONS input partitions of whole pages.

A page is a folder ``page=N`` with a file of one line of JSON: the catalog's total, and the page's rows.
The first page says how many pages there are; it is read while the scan is planned, the others in tasks.
The folder may be on any file system that pyarrow opens by its address.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "corpus_pages"
#: Catalogs of more pages have several in a partition: a task for each small page costs more than the page.
PARTITIONS = 192


class Pages(InputPartition):
    """Pages from ``first`` on, each by its files."""

    def __init__(self, first: int, files: list[list[str]]):
        super().__init__(first)
        self.first, self.files = first, files


class PageReader(DataSourceReader):
    def __init__(self, path: str, partitions: int = PARTITIONS):
        self.path, self.most = path, partitions

    def _opened(self):
        from pyarrow import fs

        # Spark writes local paths as file:/a, pyarrow reads file:///a.
        path = "file:///" + self.path[6:].lstrip("/") if self.path.startswith("file:/") else self.path
        return fs.FileSystem.from_uri(path)

    def _page(self, files: list[str]) -> dict | None:
        """The page, or None if it fails: not there, not to be parsed, or of another shape."""
        system, _ = self._opened()
        try:
            with system.open_input_stream(files[0]) as f:
                page = json.loads(f.read())
        except (OSError, ValueError, IndexError):
            return None
        well = isinstance(page, dict) and isinstance(page.get("total"), int) and isinstance(page.get("rows"), list)
        return page if well else None

    def partitions(self) -> list[Pages]:
        from pyarrow import fs

        system, base = self._opened()
        files: dict[int, list[str]] = {}
        for x in sorted(system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)), key=lambda x: x.path):
            name = x.path.split("/")[-2]
            if x.type == fs.FileType.File and name.startswith("page=") and not x.base_name.startswith((".", "_")):
                files.setdefault(int(name[5:]), []).append(x.path)
        first = self._page(files.get(0, []))
        if first is None or not first["rows"]:
            return [Pages(0, [[]])]  # which fails too: Spark takes no list for one partition without a page
        n_pages = -(-first["total"] // len(first["rows"]))
        step = -(-n_pages // self.most)
        return [Pages(at, [files.get(i, []) for i in range(at, min(n_pages, at + step))]) for at in range(0, n_pages, step)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for number, files in enumerate(partition.files, partition.first):
            page = self._page(files)
            if page is None:
                yield number, None, None
            else:
                for i, row in enumerate(page["rows"]):
                    yield number, i, json.dumps(row)


class PageSource(DataSource):
    """Rows (page, place, value); a page that fails is one row without place and value."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "page int, place int, value string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"], int(self.options.get("partitions", PARTITIONS)))


def scan_pages(spark: SparkSession, path: str, schema: str, partitions: int = PARTITIONS) -> DataFrame:
    """The rows of all pages before the first that fails, parsed to schema; none if there is no first page."""
    spark.dataSource.register(PageSource)
    pages = spark.read.format(NAME).option("partitions", partitions).load(path)
    failed = pages.where("place IS NULL").agg(F.min("page")).first()[0]
    good = pages.where("place IS NOT NULL") if failed is None else pages.where(f"place IS NOT NULL AND page < {failed}")
    return good.select(F.from_json("value", schema).alias("x")).select("x.*")


def write_pages(rows: DataFrame, path: str, total: int, broken: int | None = None) -> None:
    """rows (page and others) as a catalog of pages; the page ``broken`` is cut off in its middle."""
    others = [c for c in rows.columns if c != "page"]
    line = F.to_json(F.struct(F.lit(total).alias("total"), F.array_sort(F.collect_list(F.struct(*others))).alias("rows")))
    lines = rows.groupBy("page").agg(line.alias("value"))
    cut = lines if broken is None else lines.withColumn("value", F.when(F.col("page") == broken, F.substr("value", F.lit(1), F.length("value") / 2)).otherwise(F.col("value")))
    cut.write.partitionBy("page").text(path)
