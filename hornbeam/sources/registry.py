"""Saved registry documents as a data source: spark.read.format("registry") and spark.readStream.

A folder holds one folder for each registry, and in it a document for each package, as JSON, named by the package with
`/` written as `%2F`. Each file is listed once, in the driver; tasks read the files, some of each registry a partition.
The options registry and pkg leave other files out before any is read. (Filters are not pushed down: this version of Spark
keeps what is pushed with the source and not with the scan, so that two filters on one DataFrame would meet.) Stores that pyarrow knows (local and HDFS
paths, object stores) can be read; the path must be seen by all executors. As a stream, a folder's new files come in the
order of their times of change, FILES of them at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from hornbeam.sources import metadata

SCHEMA = "registry string, pkg string, value string"
#: Files of a partition, and of a micro-batch.
FILES, BATCH = 200, 2000


@dataclass(frozen=True)
class Registry:
    """language: the normalizer of its documents; list_of: where names stand in its lists."""

    name: str
    language: str


#: Registries whose documents can be normalized (fixed names).
REGISTRIES = {r.name: r for r in (Registry("npmjs", "javascript"), Registry("pypi", "python"), Registry("rubygems", "ruby"), Registry("packagist", "php"), Registry("nuget", "csharp"))}


def _store(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def file_name(pkg: str) -> str:
    return quote(pkg, safe="@ ~") + ".json"


def _files(path: str, wanted: Callable[[str, str], bool]) -> list[tuple[int, str, str, str]]:
    """(time of change in microseconds, registry, pkg, path) of all documents, oldest first."""
    from pyarrow import fs

    store, root = _store(path)
    found = []
    for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        parts = info.path.removeprefix(root).strip("/").split("/")
        if info.type == fs.FileType.File and len(parts) == 2 and parts[1].endswith(".json"):
            registry, pkg = parts[0], unquote(parts[1].removesuffix(".json"))
            if wanted(registry, pkg):
                found.append(((info.mtime_ns or 0) // 1000, registry, pkg, info.path))
    return sorted(found)


@dataclass
class Documents(InputPartition):
    files: tuple[tuple[str, str, str], ...]

    def __init__(self, files):
        super().__init__(None)
        self.files = tuple(files)


def _read(path: str, part: Documents) -> Iterator[tuple[str, str, str]]:
    store, _ = _store(path)
    for registry, pkg, file in part.files:
        with store.open_input_stream(file) as f:
            yield registry, pkg, f.read().decode("utf-8", "replace")


def _parts(files: list[tuple[int, str, str, str]]) -> list[Documents]:
    """FILES of one registry each."""
    by: dict[str, list[tuple[str, str, str]]] = {}
    for _, registry, pkg, file in files:
        by.setdefault(registry, []).append((registry, pkg, file))
    return [Documents(own[at : at + FILES]) for _, own in sorted(by.items()) for at in range(0, len(own), FILES)]


class RegistryReader(DataSourceReader):
    def __init__(self, path: str, registry: str | None = None, pkg: str | None = None):
        self.path, self.registry, self.pkg = path, registry, pkg

    def wanted(self, registry: str, pkg: str) -> bool:
        return self.registry in (None, registry) and self.pkg in (None, pkg)

    def partitions(self) -> list[Documents]:
        return _parts(_files(self.path, self.wanted)) or [Documents(())]

    def read(self, partition: Documents) -> Iterator[tuple]:
        return _read(self.path, partition)


class RegistryStream(DataSourceStreamReader):
    """An offset is the time of change and path of the last file that was read."""

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most
        self.at: tuple[int, str] | None = None

    def initialOffset(self) -> dict:
        return {"time": -1, "file": ""}

    def _after(self, at: tuple[int, str]) -> list[tuple[int, str, str, str]]:
        return sorted((f for f in _files(self.path, lambda *_: True) if (f[0], f[3]) > at), key=lambda f: (f[0], f[3]))

    def latestOffset(self) -> dict:
        new = self._after(self.at or (-1, ""))[: self.most]
        if new:
            self.at = new[-1][0], new[-1][3]
        time, file = self.at or (-1, "")
        return {"time": time, "file": file}

    def partitions(self, start: dict, end: dict) -> list[Documents]:
        until = end["time"], end["file"]
        self.at = max(self.at or until, until)  # after a restart reading goes on from here
        return _parts([f for f in self._after((start["time"], start["file"])) if (f[0], f[3]) <= until]) or [Documents(())]

    def read(self, partition: Documents) -> Iterator[tuple]:
        return _read(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class RegistrySource(DataSource):
    """Options: path (the folder), registry and pkg (of a batch: these only), maxFilesPerTrigger (of a stream)."""

    @classmethod
    def name(cls) -> str:
        return "registry"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RegistryReader(self.options["path"], self.options.get("registry"), self.options.get("pkg"))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return RegistryStream(self.options["path"], int(self.options.get("maxfilespertrigger", BATCH)))


def register(spark: SparkSession) -> None:
    """spark.read.format("registry").load(folder) then works."""
    spark.dataSource.register(RegistrySource)


def normalized(docs: DataFrame, registry: str) -> DataFrame:
    """Rows of schemas.METADATA of one registry's documents."""
    if registry not in REGISTRIES:
        raise ValueError(f"no registry {registry}")
    return metadata.normalize(docs.filter(docs["registry"] == registry).select("pkg", "value"), REGISTRIES[registry].language)


def all_normalized(spark: SparkSession, path: str) -> DataFrame:
    """Rows of schemas.METADATA with their registry, of every registry that is known."""
    out = None
    for name in REGISTRIES:
        one = normalized(spark.read.format("registry").option("registry", name).load(path), name).withColumn("registry", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
