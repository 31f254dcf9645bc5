"""Directory trees of Markdown as a data source, and rewrites back to disk.

Files are read byte for byte: a leading byte order mark is dropped and noted, line ends stay.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from linkgraph.functions.paths import DEFAULT_EXCLUDES
from linkgraph.operators.documents import Options, Tree

_BOM = b"\xef\xbb\xbf"


def _read(file: str) -> tuple[str | None, bool]:
    with open(file, "rb") as stream:
        data = stream.read()
    try:
        return data.removeprefix(_BOM).decode("utf-8"), data.startswith(_BOM)
    except UnicodeDecodeError:
        return None, data.startswith(_BOM)


class _Part(InputPartition):
    def __init__(self, files: list[str]) -> None:
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = os.path.realpath(options["path"])
        self.excludes = (*DEFAULT_EXCLUDES, *filter(None, options.get("excludes", "").split("\n")))
        self.size = int(options.get("files_per_partition", "500"))

    def partitions(self) -> list[InputPartition]:
        found: list[str] = []
        for at, dirs, names in os.walk(self.root):
            dirs[:] = sorted(d for d in dirs if not any(fnmatchcase(d, x) for x in self.excludes))
            found += [os.path.relpath(os.path.join(at, x), self.root) for x in sorted(names) if x.lower().endswith(".md")]
        return [_Part(found[i : i + self.size]) for i in range(0, len(found), self.size)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for name in partition.files:
            file = os.path.join(self.root, name)
            real = os.path.realpath(file)
            if not os.path.exists(real):
                continue
            inside = os.path.relpath(real, self.root)
            if inside.split(os.sep)[0] == "..":
                yield name.replace(os.sep, "/"), inside.replace(os.sep, "/"), "out_of_root", None, False
            elif os.path.isfile(real):
                content, bom = _read(real)
                yield name.replace(os.sep, "/"), inside.replace(os.sep, "/"), "ok", content, bom


class MarkdownTree(DataSource):
    """spark.read.format("mdtree").load(root): name, path, state, content, has_bom.

    path is the canonical one, with symbolic links resolved; state is ok or out_of_root.  Options:
    excludes (directory globs, one a line), files_per_partition.
    """

    @classmethod
    def name(cls) -> str:
        return "mdtree"

    def schema(self) -> str:
        return "name string, path string, state string, content string, has_bom boolean"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def scanned(spark: SparkSession, root: str, options: Options = Options()) -> DataFrame:
    spark.dataSource.register(MarkdownTree)
    return spark.read.format("mdtree").option("excludes", "\n".join(options.excludes)).load(root)


def out_of_root(scan: DataFrame) -> DataFrame:
    return scan.where("state = 'out_of_root'").select(F.col("name").alias("path"))


def tree(spark: SparkSession, root: str, options: Options = Options()) -> Tree:
    """Documents, everything that exists under root, and a probe for what lies outside."""
    real = os.path.realpath(root)
    scan = scanned(spark, root, options)
    docs = scan.where("state = 'ok'").dropDuplicates(["path"]).select("path", "content", "has_bom")
    rows = [(".", "dir")]
    for at, dirs, names in os.walk(real):
        base = os.path.relpath(at, real)
        join = lambda x, base=base: x if base == "." else f"{base}/{x}".replace(os.sep, "/")
        rows += [(join(x), "dir" if os.path.isdir(os.path.join(at, x)) else "file") for x in (*dirs, *names) if os.path.exists(os.path.join(at, x))]

    def probe(outside: DataFrame) -> DataFrame:
        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                full = [os.path.join(real, x) for x in batch["path"]]
                batch = batch.assign(type=["dir" if os.path.isdir(x) else "file" if os.path.exists(x) else None for x in full])
                yield batch[batch["type"].notna()]

        return outside.mapInPandas(look, "path string, type string")

    return Tree(docs, spark.createDataFrame(rows, "path string, type string"), probe, out_of_root(scan))


def under(name: str, root: str) -> str:
    """A path as a user gives it, absolute or from the working directory, as a path under root, with links resolved."""
    found = os.path.relpath(os.path.realpath(name), os.path.realpath(root))
    return found.replace(os.sep, "/")


def path_list(spark: SparkSession, file: str) -> DataFrame:
    """path, one a line, trimmed, without empty lines."""
    return spark.read.text(file).select(F.trim("value").alias("path")).where("path <> ''")


def scope_of(scope: DataFrame, listing: DataFrame) -> DataFrame:
    """scope (path), all of which must be Markdown files of listing (path, type)."""
    checked = scope.join(listing.select("path", "type"), "path", "left").where(~(F.coalesce(F.col("type") == "file", F.lit(False)) & F.lower("path").endswith(".md")))
    if wrong := [x.path for x in checked.limit(5).collect()]:
        raise ValueError(f"no Markdown files under the root: {', '.join(wrong)}")
    return scope.select("path").distinct()


def write(rewrites: DataFrame, root: str) -> int:
    """Write rewrites (path, new_content) under root, keeping byte order marks and line ends; the number of files.

    Each file is replaced as a whole; a symbolic link is refused.
    """
    real = os.path.realpath(root)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["new_content"], strict=True):
                file = os.path.join(real, path)
                if os.path.islink(file):
                    raise ValueError(f"{path} is a symbolic link")
                bom = b""
                if os.path.exists(file):
                    with open(file, "rb") as old:
                        bom = _BOM if old.read(3) == _BOM else b""
                part = f"{file}.{os.getpid()}.part"
                with open(part, "wb") as out:
                    out.write(bom + content.encode("utf-8"))
                os.replace(part, file)
            yield pd.DataFrame({"n": [len(batch)]})

    return rewrites.mapInPandas(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
