"""Findings of other engines' reports as rows, and the catalogue as the lists that engines take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Engine -> shape of a report (fixed values of the engines' formats) and, of one finding, the columns of FINDING.
REPORTS = {
    "php": (
        "array<struct<source_name:array<string>,source_line:array<int>,source_file:array<string>,sink_name:string,sink_line:int,sink_file:string,vuln_name:string,vuln_id:string>>",
        lambda d: d,
        lambda f: (F.get(f["source_name"], 0), F.get(f["source_file"], 0), F.get(f["source_line"], 0), f["sink_name"], f["sink_file"], f["sink_line"], f["vuln_name"], f["vuln_id"]),
    ),
    "ruby": (
        "struct<warnings:array<struct<warning_type:string,fingerprint:string,message:string,file:string,line:int,code:string,user_input:string>>>",
        lambda d: d["warnings"],
        lambda f: (f["user_input"], f["file"], F.lit(None).cast("int"), f["code"], f["file"], f["line"], f["warning_type"], f["fingerprint"]),
    ),
    "python": (
        "struct<vulnerabilities:array<struct<source:struct<label:string,line_number:int,path:string>,sink:struct<label:string,line_number:int,path:string>,type:string,source_trigger_word:string,sink_trigger_word:string>>>",
        lambda d: d["vulnerabilities"],
        lambda f: (f["source_trigger_word"], f["source"]["path"], f["source"]["line_number"], f["sink_trigger_word"], f["sink"]["path"], f["sink"]["line_number"], f["type"], F.lit(None).cast("string")),
    ),
}
FINDING = ["source", "source_file", "source_line", "sink", "sink_file", "sink_line", "kind", "finding"]


def parsed(reports: DataFrame, engine: str, column: str = "value") -> DataFrame:
    """(pkg, columns of FINDING) of reports (pkg, JSON text), equal findings of a package once; a report that does not
    parse gives no rows. A finding without an id of its own gets one from its ends."""
    schema, rows, columns = REPORTS[engine]
    f = reports.select("pkg", F.explode(rows(F.from_json(F.col(column), schema))).alias("f"))
    out = f.select("pkg", *[c.alias(n) for c, n in zip(columns(F.col("f")), FINDING)])
    own = F.sha2(F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FINDING[:-1]]), 256)
    return out.withColumn("finding", F.coalesce("finding", own)).distinct()


def report_of(catalogue: DataFrame, engine: str) -> DataFrame:
    """(json): the document of sources and sinks that an engine takes, names in order. Dangers count as sources where an
    engine knows no other kind; for php, sinks come with their argument places, and those without any are left out."""
    of = lambda *kinds: F.col("functionality").isin(*kinds)
    names = lambda fits: F.array_sort(F.collect_set(F.when(fits, F.col("full_name"))))
    if engine == "python":
        empty = F.from_json(F.lit("{}"), "map<string,string>")
        sinks = F.map_from_entries(F.transform(names(of("SINK")), lambda n: F.struct(n, empty)))
        return catalogue.agg(F.to_json(F.struct(names(of("SOURCE", "DANGER")).alias("sources"), sinks.alias("sinks"))).alias("json"))
    if engine == "php":
        one = lambda fits, *more: F.array_sort(F.collect_set(F.when(fits, F.struct(F.col("name"), F.col("base_type").alias("instanceof"), *more))))
        places = F.transform("arg_ids", lambda k: (k + 1).cast("string")).alias("parameters")
        return catalogue.agg(F.to_json(F.struct(one(of("SOURCE")).alias("sources"), one(of("SINK", "DANGER") & (F.size("arg_ids") > 0), places).alias("sinks"))).alias("json"))
    raise ValueError(f"no lists for {engine!r}")


def signature_lines(signatures: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(line) as an engine for byte code takes them: `<class: result name(arguments)> -> _SOURCE_`, one for each signature
    (base_type, name, result, arguments) of a method that the catalogue has."""
    kind = F.concat(F.lit("_"), F.when(F.col("functionality") == "SOURCE", "SOURCE").otherwise("SINK"), F.lit("_"))
    wanted = catalogue.select("base_type", "name", kind.alias("kind")).distinct()
    return signatures.join(wanted, ["base_type", "name"]).select(F.format_string("<%s: %s %s(%s)> -> %s", "base_type", "result", "name", F.array_join("arguments", ","), "kind").alias("line")).distinct()


def file_counts(calls: DataFrame) -> DataFrame:
    """(pkg, file, calls): how many calls each file has; a file without any that failed is not among them."""
    return calls.filter(F.col("full_name").isNotNull()).groupBy("pkg", "file").agg(F.count("*").alias("calls"))


def metadata_counts(metadata: DataFrame) -> DataFrame:
    """(pkg, versions, dependencies): how many a package's metadata tells of."""
    size: Column = F.size("releases")
    return metadata.select("pkg", size.alias("versions"), F.size("dependencies").alias("dependencies"))


def group_seeds(*tables: DataFrame, name: str = "name") -> DataFrame:
    """(seed): distinct groups, what comes before the slash, of names in several registries."""
    out = None
    for t in tables:
        part = t.select(F.substring_index(name, "/", 1).alias("seed"))
        out = part if out is None else out.union(part)
    return out.filter("seed <> ''").distinct()
