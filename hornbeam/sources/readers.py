"""Readers of files: package lists, documents, logs, requirement lists, dependency trees, sources and archives."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import posixpath
import tarfile
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.functions.storage import in_arrow
from hornbeam.operators.extract import EXTENSIONS
from hornbeam.sources.schemas import ALERTS, PACKAGES


def packages(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """A CSV package list; names like `null` stay text. The header's spaces become underscores; extra columns by name."""
    schema = ", ".join(x for x in (PACKAGES, extra) if x)
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\0").option("enforceSchema", True).csv(path)


def package_list(table: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(name, version or null, language) of a package list without those of a list of finished names."""
    rows = table.select(F.col("package_name").alias("name"), F.nullif("version", F.lit("")).alias("version"), "language").filter(F.col("name").isNotNull())
    return rows if done is None else rows.join(done.select("name").distinct(), "name", "left_anti")


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def alerts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines with alerts, and the lines that are no JSON."""
    parsed = F.from_json("value", f"{ALERTS}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    raw = spark.read.text(path).filter(F.trim("value") != "").select("value", parsed.alias("a"))
    bad = F.col("a._bad").isNotNull()
    return raw.filter(~bad).select("a.rule", "a.output", "a.output_fields"), raw.filter(bad).select(F.col("value").alias("line"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def requirements(text: DataFrame, column: str = "value") -> DataFrame:
    """(name, version) of lines like name==1.0; comments and other lines are left out."""
    p = F.split(F.trim(F.col(column)), "==")
    return text.filter(F.trim(F.col(column)).rlike(r"^[^#=\s]+==\S+$")).select(F.lower(p[0]).alias("name"), p[1].alias("version"))


def shown(text: DataFrame, column: str = "value") -> DataFrame:
    """(name, version, requires) of printed package headers, one text a package: Name, Version and Requires lines."""
    field = lambda k: F.nullif(F.trim(F.regexp_extract(column, rf"(?m)^{k}:[ \t]*(.*)$", 1)), F.lit(""))
    requires = F.coalesce(F.filter(F.transform(F.split(field("Requires"), ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""), F.array().cast("array<string>"))
    return text.select(F.lower(field("Name")).alias("name"), field("Version").alias("version"), requires.alias("requires")).filter("name IS NOT NULL")


def declared(requirement: Column) -> Column:
    """The lower-case name that a requirement like `Name [extra] (>=1)` begins with."""
    return F.nullif(F.lower(F.regexp_extract(requirement, r"^\s*([A-Za-z0-9._-]+)", 1)), F.lit(""))


def frozen_and_declared(frozen: DataFrame, names: DataFrame) -> DataFrame:
    return frozen.join(names.select(F.lower("name").alias("name")).distinct(), "name", "left_semi")


def gems(text: DataFrame, column: str = "value") -> DataFrame:
    """(name, version) of lines like `name (default: 1.0, 0.9)`: the first version."""
    pattern = r"^(\S+) \((?:default: )?([^,)\s]+)"
    return text.filter(F.col(column).rlike(pattern)).select(F.regexp_extract(column, pattern, 1).alias("name"), F.regexp_extract(column, pattern, 2).alias("version"))


def maven_tree(text: DataFrame, column: str = "value") -> DataFrame:
    """(name, version, depth, direct) of a printed dependency tree: group/artifact, depth 1 is direct."""
    pattern = r"^(?:\[INFO\] )?((?:[| ]  )*)(?:\+-|\\-) ([^:\s]+):([^:\s]+):[^:\s]+:(?:[^:\s]+:)??([^:\s]+)(?::(?:compile|test|runtime|provided|system|import))?(?:\s.*)?$"
    part = lambda k: F.regexp_extract(column, pattern, k)
    depth = (F.length(part(1)) / 3 + 1).cast("int")
    return text.filter(F.col(column).rlike(pattern)).select(F.concat_ws("/", part(2), part(3)).alias("name"), part(4).alias("version"), depth.alias("depth"), (depth == 1).alias("direct"))


def locked_npm(locks: DataFrame) -> DataFrame:
    """(pkg, name, version, direct) of shrinkwraps (pkg, lock JSON text, declared array of names)."""
    entries = F.map_entries(F.from_json("lock", "struct<dependencies:map<string,struct<version:string>>>")["dependencies"])
    rows = locks.select("pkg", "declared", F.explode(entries).alias("e"))
    return rows.select("pkg", F.col("e.key").alias("name"), F.col("e.value.version").alias("version"), F.coalesce(F.array_contains("declared", F.col("e.key")), F.lit(False)).alias("direct"))


def locked_composer(locks: DataFrame) -> DataFrame:
    """The same of composer locks (pkg, lock JSON text, declared array of names)."""
    entries = F.from_json("lock", "struct<packages:array<struct<name:string,version:string>>>")["packages"]
    rows = locks.select("pkg", "declared", F.explode(entries).alias("e"))
    return rows.select("pkg", "e.name", "e.version", F.coalesce(F.array_contains("declared", F.col("e.name")), F.lit(False)).alias("direct"))


def poms(files: DataFrame, column: str = "content") -> DataFrame:
    """(pkg, dependencies, developers) of POM documents as text; namespaces are cut off first."""
    dependency, developer = "struct<groupId:string,artifactId:string,version:string,scope:string>", "struct<name:string,email:string>"
    schema = f"groupId string, artifactId string, version string, dependencies struct<dependency:array<{dependency}>>, developers struct<developer:array<{developer}>>"
    plain = F.regexp_replace(F.regexp_replace(F.col(column).cast("string"), r"\s(xmlns(:\w+)?|xsi:\w+)=\"[^\"]*\"", ""), r"<(/?)\w+:", "<$1")
    x = files.select(F.from_xml(plain, schema).alias("x")).select("x.*")
    return x.select(F.concat_ws("/", "groupId", "artifactId").alias("pkg"), "version", F.coalesce("dependencies.dependency", F.array()).alias("dependencies"), F.coalesce("developers.developer", F.array()).alias("developers"))


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, content, length) of all files below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "content", "length")


def one_a_name(table: DataFrame) -> DataFrame:
    """The first path of each file name."""
    return table.withColumn("_n", F.element_at(F.split("path", "/"), -1)).groupBy("_n").agg(F.min_by(F.struct(*table.columns), "path").alias("r")).select("r.*")


def sources(spark: SparkSession, path: str, language: str) -> DataFrame:
    """Files of a language by extension; Rakefiles count as Ruby. Other files are not opened."""
    names = [f"*{e}" for e in EXTENSIONS[language]] + ["Rakefile"] * (language == "ruby")
    return files(spark, path, "{" + ",".join(names) + "}").withColumn("language", F.lit(language))


#: The first bytes of archives (fixed values).
MAGIC = {"zip": b"PK\x03\x04", "gz": b"\x1f\x8b\x08", "bz2": b"BZh", "xz": b"\xfd7zXZ\x00", "rar": b"Rar!\x1a\x07"}


def archive_kind(content: bytes, name: str = "") -> str | None:
    for kind, magic in MAGIC.items():
        if content[: len(magic)] == magic:
            return kind
    if content[257:262] == b"ustar":
        return "tar"
    return None


def members(content: bytes, name: str, most_bytes: int):
    """(path, bytes or None, error or None) of an archive's files, archives within opened too, however deep, and their
    paths joined by two dots. Names that lead out of the archive are skipped; an archive that does not open, of a kind
    that is known but not read (rar) too, is a row with its error; more than most_bytes in all, counted at every level,
    ends the archive with an error."""
    left = [most_bytes]

    def read(stream) -> bytes:
        got = stream.read(left[0] + 1)
        left[0] -= len(got)
        if left[0] < 0:
            raise MemoryError("the archive is too large")
        return got

    def inside(kind: str, data: bytes):
        """(path, bytes) of one archive; a compressed file that is no archive has the path None."""
        if kind == "zip":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for i in z.infolist():
                    if not i.is_dir():
                        yield i.filename, read(z.open(i))
        elif kind == "tar":
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                for m in t:
                    if m.isfile():
                        yield m.name, read(t.extractfile(m))
        elif kind in ("gz", "bz2", "xz"):
            make = {"gz": lambda b: gzip.GzipFile(fileobj=b), "bz2": bz2.BZ2File, "xz": lzma.LZMAFile}[kind]
            plain = read(make(io.BytesIO(data)))
            if archive_kind(plain) == "tar":
                yield from inside("tar", plain)
            else:
                yield None, plain
        else:
            raise ValueError(f"{kind} archives are not read")

    todo = [("", content)]  # of archives that are still closed
    while todo:
        outer, data = todo.pop()
        kind = archive_kind(data)
        if kind is None:
            yield outer, data, None
            continue
        found = []
        try:
            for path, body in inside(kind, data):
                path = outer if path is None else posixpath.normpath(path)
                if path is not outer:
                    if path.startswith(("/", "..")):
                        continue
                    path = f"{outer}..{path}" if outer else path
                found.append((path, body))
        except MemoryError as e:
            yield outer or None, None, f"{type(e).__name__}: {e}"
            return
        except Exception as e:  # noqa: BLE001  whatever a damaged archive makes of a decoder
            yield outer or None, None, f"{type(e).__name__}: {e}"[:300]
        todo += reversed(found)


UNPACKED = "archive string, path string, content binary, error string"


def unpack(table: DataFrame, most_bytes: int = 256 << 20) -> DataFrame:
    """Rows of UNPACKED of (path, content): one a file in each archive; what does not open gives its error. Files go on
    as they are read, a few megabytes at a time."""
    kinds, names = (pa.string(), pa.string(), pa.binary(), pa.string()), ["archive", "path", "content", "error"]

    def work(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, size = [], 0
                for row in members(content or b"", path, most_bytes):
                    rows.append((path, *row))
                    size += len(row[1] or b"") + 100
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return table.select("path", "content").transform(in_arrow, work, UNPACKED)


def index_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Names on saved index pages: the targets of links, without slashes at the end."""
    found = F.explode(F.regexp_extract_all(F.col(html), F.lit('href="([^"]+)"'), F.lit(1)))
    return pages.select(found.alias("link")).filter(~F.col("link").startswith("..")).select(F.regexp_replace(F.element_at(F.split(F.regexp_replace("link", "/+$", ""), "/"), -1), r"\?.*$", "").alias("name")).filter("name <> ''").distinct()


#: Registry -> where names stand in a saved list (fixed values of the registries' formats): JSON schema and expression.
NAME_LISTS = {
    "npm": ("struct<rows:array<struct<id:string>>>", lambda d: d["rows"]["id"]),
    "npm_all": ("array<string>", lambda d: d),
    "packagist": ("struct<packageNames:array<string>>", lambda d: d["packageNames"]),
    "rubygems": ("array<struct<name:string>>", lambda d: d["name"]),
    "nuget": ("struct<items:array<struct<`nuget:id`:string>>>", lambda d: d["items"]["nuget:id"]),
}


def listed_names(documents: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """(name): distinct names in saved lists of a registry, one JSON document a row; what does not parse has none."""
    schema, names = NAME_LISTS[kind]
    return documents.select(F.explode(names(F.from_json(F.col(column), schema))).alias("name")).filter("name <> ''").distinct()


def without_urls(urls: DataFrame, done: DataFrame, column: str = "url") -> DataFrame:
    """Rows whose URL a list of finished ones (same column) has not, whatever the scheme's case and slashes at the end."""
    plain = lambda c: F.regexp_replace(F.concat(F.lower(F.regexp_extract(c, r"^[A-Za-z]+://[^/]*", 0)), F.regexp_replace(c, r"^[A-Za-z]+://[^/]*", "")), "/+$", "")
    return urls.join(done.select(plain(F.col(column)).alias("_done")).distinct(), plain(F.col(column)) == F.col("_done"), "left_anti")


def wrapped_lines(text: DataFrame, order: str = "n", column: str = "value", key: str = "file") -> DataFrame:
    """(file, name, version): a list in which a long name stands on a line of its own before its version."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    p = F.split(F.trim(F.col(column)), r"\s+")
    rows = text.withColumn("p", p).withColumn("q", F.lead("p").over(w)).withColumn("o", F.lag("p").over(w))
    name, version = F.col("p")[0], F.when(F.size("p") >= 2, F.col("p")[1]).otherwise(F.col("q")[0])
    alone = (F.size("p") == 1) & (F.size("o") == 1)  # the second line of a pair
    return rows.filter(~F.coalesce(alone, F.lit(False)) & (name != "")).select(key, name.alias("name"), version.alias("version"))


def npm_tarballs(docs: DataFrame) -> DataFrame:
    """(pkg, version, url) of full npm documents as text in column value."""
    versions = F.from_json("value", "struct<name:string,versions:map<string,struct<dist:struct<tarball:string>>>>")
    x = docs.select(versions.alias("d")).select("d.name", F.explode(F.map_entries("d.versions")).alias("e"))
    return x.select(F.col("name").alias("pkg"), F.col("e.key").alias("version"), F.col("e.value.dist.tarball").alias("url"))


def recorded_downloads(records: DataFrame) -> DataFrame:
    """(pkg, downloads): the sum of saved records that count mirrors too."""
    return records.filter(F.col("category") == "with_mirrors").groupBy("pkg").agg(F.sum("downloads").alias("downloads"))
