"""Registry documents in one shape, and what follows from it: versions, authors, dependency edges, flags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornbeam.functions.names import EMAIL
from hornbeam.sources import schemas
from hornbeam.sources.readers import declared

HOOKS = ["preinstall", "install", "postinstall"]
TESTS = ["test", "pretest", "posttest", "test:browser", "test:browserless"]
NO_DEPS = "array<struct<name:string,version:string>>"


def _map_deps(m: Column) -> Column:
    return F.coalesce(F.transform(F.map_entries(m), lambda e: F.struct(e.key.alias("name"), e.value.alias("version"))), F.array().cast(NO_DEPS))


def _gem_deps(a: Column) -> Column:
    return F.coalesce(F.transform(a, lambda d: F.struct(d["name"].alias("name"), d["requirements"].alias("version"))), F.array().cast(NO_DEPS))


def _found(text: Column) -> Column:
    return F.coalesce(F.array_distinct(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))), F.array().cast("array<string>"))


def _releases(m: Column, at=lambda v: v.try_cast("timestamp")) -> Column:
    return F.coalesce(F.transform(F.map_entries(m), lambda e: F.struct(e.key.alias("version"), at(e.value).alias("ts"))), F.array().cast("array<struct<version:string,ts:timestamp>>"))


def _rows(docs: DataFrame, schema: str) -> DataFrame:
    return docs.select("pkg", F.from_json("value", schema).alias("d"))


def _ruby() -> dict[str, Column]:
    made = F.array(F.struct(F.col("d.version").alias("version"), F.lit(None).cast("timestamp").alias("ts")))
    return {
        "author": F.col("d.authors"), "emails": _found(F.col("d.authors")), "homepage": F.col("d.homepage_uri"), "license": F.array_join("d.licenses", ", "),
        "dependencies": _gem_deps(F.col("d.dependencies.runtime")), "dev_dependencies": _gem_deps(F.col("d.dependencies.development")), "releases": F.filter(made, lambda r: r.version.isNotNull()), "has_exercise": F.lit(True),
    }


def _python() -> dict[str, Column]:
    deps = F.transform("d.info.requires_dist", lambda r: F.struct(declared(r).alias("name"), F.nullif(F.trim(F.regexp_replace(r, r"^\s*[A-Za-z0-9._-]+", "")), F.lit("")).alias("version")))
    made = F.map_filter("d.releases", lambda _, v: F.size(v) > 0)
    last = lambda v: F.array_max(F.transform(v, lambda f: f["upload_time"].try_cast("timestamp")))
    who = F.concat_ws(" ", "d.info.author_email", "d.info.maintainer", "d.info.maintainer_email")
    return {
        "author": F.col("d.info.author"), "emails": _found(who), "description": F.col("d.info.summary"), "homepage": F.col("d.info.home_page"), "license": F.col("d.info.license"),
        "dependencies": F.coalesce(deps, F.array().cast(NO_DEPS)), "releases": _releases(made, last), "has_exercise": F.lit(True),
    }


def _javascript() -> dict[str, Column]:
    times = F.map_filter("d.time", lambda k, _: ~k.isin("created", "modified"))
    script = lambda names: F.coalesce(F.arrays_overlap(F.map_keys("d.scripts"), F.array(*map(F.lit, names))), F.lit(False))
    return {
        "author": F.array_join("d.maintainers", ", "), "emails": _found(F.array_join("d.maintainers", " ")), "description": F.col("d.description"), "homepage": F.col("d.homepage"), "license": F.col("d.license"),
        "dependencies": _map_deps(F.col("d.dependencies")), "dev_dependencies": _map_deps(F.col("d.devDependencies")), "releases": _releases(times), "has_install": script(HOOKS), "has_main": F.coalesce("d.bin", "d.main", "d.browser").isNotNull(),
        "has_test": script(TESTS), "has_exercise": F.coalesce("d.main", "d.browser").isNotNull(),
    }


def _php() -> dict[str, Column]:
    versions = F.map_filter("d.package.versions", lambda k, _: ~k.rlike("[#/]"))
    times = F.filter(F.map_values(versions), lambda v: v["time"].isNotNull())
    latest = F.element_at(F.array_sort(F.transform(times, lambda v: F.struct(v["time"].try_cast("timestamp").alias("ts"), v["version"].alias("version"), F.map_entries(v["require"]).alias("require"), F.coalesce(F.size(v["bin"]), F.lit(0)).alias("bins")))), F.when(F.size(times) > 0, -1).otherwise(F.lit(None)))
    deps = F.transform(F.filter(latest["require"], lambda e: e.key.contains("/")), lambda e: F.struct(e.key.alias("name"), e.value.alias("version")))
    people = F.filter(F.array_distinct(F.flatten(F.transform(F.map_values(versions), lambda v: F.coalesce(F.transform(v["authors"], lambda a: a["email"]), F.array().cast("array<string>"))))), lambda e: e.isNotNull())
    return {
        "emails": F.coalesce(people, F.array().cast("array<string>")), "description": F.col("d.package.description"), "dependencies": F.coalesce(deps, F.array().cast(NO_DEPS)),
        "releases": _releases(versions, lambda v: v["time"].try_cast("timestamp")), "has_main": F.coalesce(latest["bins"] > 0, F.lit(False)), "has_exercise": F.coalesce(F.col("d.package.type") == "library", F.lit(False)),
    }


def _csharp() -> dict[str, Column]:
    entries = F.coalesce(F.transform(F.flatten(F.transform("d.items", lambda p: p["items"])), lambda i: i["catalogEntry"]), F.array().cast("array<struct<id:string,version:string,published:string,authors:string>>"))
    people = F.array_join(F.array_distinct(F.filter(F.transform(entries, lambda e: e["authors"]), lambda a: a.isNotNull())), ", ")
    return {"author": people, "emails": _found(people), "releases": F.transform(entries, lambda e: F.struct(e["version"].alias("version"), e["published"].try_cast("timestamp").alias("ts")))}


#: Language -> the schema of its registry's documents, and columns of schemas.METADATA made of a document d; columns that
#: a registry does not tell of are null, empty or false. A new registry is a new entry.
NORMALIZERS: dict[str, tuple[str, Callable[[], dict[str, Column]]]] = {
    "ruby": (schemas.GEM, _ruby), "python": (schemas.PYPI, _python), "javascript": (schemas.NPM, _javascript), "php": (schemas.PACKAGIST, _php), "csharp": (schemas.NUGET, _csharp),
}


def normalize(docs: DataFrame, language: str) -> DataFrame:
    """Rows of schemas.METADATA of raw documents (pkg, value). A document that does not parse gives nulls and empty
    lists. Java comes from POMs (readers.poms) and raises here, as do languages without a registry."""
    if language not in NORMALIZERS:
        raise ValueError(f"no normalizer for {language}")
    schema, columns = NORMALIZERS[language]
    text, none, off = F.lit(None).cast("string"), F.array().cast(NO_DEPS), F.lit(False)
    unknown = {"author": text, "emails": F.array().cast("array<string>"), "description": text, "homepage": text, "license": text, "dependencies": none, "dev_dependencies": none, "releases": F.array().cast("array<struct<version:string,ts:timestamp>>"), "has_install": off, "has_main": off, "has_test": off, "has_exercise": off}
    return _rows(docs, schema).select("pkg", F.lit(language).alias("language"), *[c.alias(k) for k, c in (unknown | columns()).items()])


def gem_records(docs: DataFrame) -> DataFrame:
    """(name, author, version, url, downloads, dependencies) of gem documents (value); dependencies: names of those that
    are needed to run, none where the document tells of none. A document that does not parse gives no row."""
    d = docs.select(F.from_json("value", f"{schemas.GEM}, project_uri string").alias("d")).filter("d.name IS NOT NULL")
    needs = F.coalesce(F.col("d.dependencies.runtime.name"), F.array().cast("array<string>"))
    return d.select("d.name", F.col("d.authors").alias("author"), "d.version", F.col("d.project_uri").alias("url"), "d.downloads", needs.alias("dependencies"))


def release_rows(metadata: DataFrame) -> DataFrame:
    """(pkg, version, ts): one row a release."""
    return metadata.select("pkg", F.explode("releases").alias("r")).select("pkg", "r.version", "r.ts")


def package_records(metadata: DataFrame, dependencies: DataFrame | None = None) -> DataFrame:
    """One row a package with its metadata and, of a dependency table (src, dst), its dependencies, declared ones where
    that table has none; known tells what was found: metadata, dependencies, both."""
    if dependencies is None:
        return metadata.withColumn("known", F.lit("metadata"))
    flat = dependencies.filter(F.col("dst").isNotNull()).groupBy(F.col("src").alias("pkg")).agg(F.array_sort(F.collect_set("dst")).alias("requires"))
    both = metadata.withColumn("_m", F.lit(True)).join(flat, "pkg", "full_outer")
    known = F.when(F.col("_m").isNull(), "dependencies").when(F.col("requires").isNull(), "metadata").otherwise("both")
    names = F.coalesce("requires", F.array_sort(F.array_distinct(F.col("dependencies.name"))), F.array().cast("array<string>"))
    return both.withColumn("known", known).withColumn("requires", names).drop("_m")


def aggregated(packages: DataFrame, metadata: DataFrame) -> DataFrame:
    """packages (package_name) with their metadata, null where there is none: the whole list in one table."""
    return packages.join(metadata.withColumnRenamed("pkg", "package_name"), "package_name", "left")


def with_time(packages: DataFrame, versions: DataFrame) -> DataFrame:
    """A package list with a row for each version, its time as yyyy-MM-dd."""
    v = versions.select(F.col("pkg").alias("package_name"), "version", F.date_format("ts", "yyyy-MM-dd").alias("release_time"))
    return packages.drop("version").join(v, "package_name")


def with_author(packages: DataFrame, metadata: DataFrame) -> DataFrame:
    return packages.join(metadata.select(F.col("pkg").alias("package_name"), "author", "emails"), "package_name", "left")


def edges(metadata: DataFrame) -> DataFrame:
    """(src, dst): a package and each of its declared dependencies."""
    return metadata.select(F.col("pkg").alias("src"), F.explode("dependencies.name").alias("dst")).filter("dst IS NOT NULL").distinct()


def versioned_edges(dependencies: DataFrame) -> DataFrame:
    """(src, dst) between name==version nodes from (src, src_version, dst, dst_version)."""
    node = lambda a, b: F.concat_ws("==", a, F.coalesce(b, F.lit("latest")))
    return dependencies.select(node("src", F.col("src_version")).alias("src"), node("dst", F.col("dst_version")).alias("dst")).distinct()


def python_major(classifiers: Column) -> Column:
    """python3 where a classifier names it and none names 2, else python2."""
    three = F.exists(classifiers, lambda c: c.startswith("Programming Language :: Python :: 3"))
    two = F.exists(classifiers, lambda c: c.startswith("Programming Language :: Python :: 2"))
    return F.when(F.coalesce(three & ~two, F.lit(False)), "python3").otherwise("python2")


def valid_versions(status: Column) -> Column:
    """Of a map version -> build status, those that built."""
    return F.map_filter(status, lambda _, v: v == "ok")
