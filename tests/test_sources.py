import gzip
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from hornbeam.sources import merged, metadata, readers, sinks
from hornbeam.sources import registry as registry_source
from hornbeam.streaming import alerts as stream
from hornbeam.streaming import sync
from tests.conftest import rows


def text(spark, *lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def test_lists(spark, tmp_path):
    (tmp_path / "p.csv").write_text('package name,version,source,downloads,language\nnull,1.0,npm,"{\'overall\': 3}",javascript\nNA,,npm,,javascript\n')
    p = readers.packages(spark, str(tmp_path / "p.csv"))
    assert [r.package_name for r in p.orderBy("package_name").collect()] == ["NA", "null"]
    done = spark.createDataFrame([("NA",)], "name string")
    assert rows(readers.package_list(p, done)) == [("null", "1.0", "javascript")]
    sinks.write_csv(p, str(tmp_path / "out"))
    assert readers.packages(spark, str(tmp_path / "out")).count() == 2


def test_dependency_formats(spark):
    assert rows(readers.requirements(text(spark, "Six==1.0", "# x==1", "bad"))) == [("six", "1.0")]
    assert rows(readers.gems(text(spark, "rake (default: 12.3, 11.0)", "json (2.1.0)", "x"))) == [("json", "2.1.0"), ("rake", "12.3")]
    got = rows(readers.maven_tree(text(spark, "[INFO] +- junit:junit:jar:4.12:test", "[INFO] |  \\- org.hamcrest:core:jar:1.3:test", "[INFO] done")))
    assert got == [("junit/junit", "4.12", 1, True), ("org.hamcrest/core", "1.3", 2, False)]
    lock = json.dumps({"dependencies": {"a": {"version": "1.0"}, "b": {"version": "2.0"}}})
    assert rows(readers.locked_npm(spark.createDataFrame([("p", lock, ["a"])], "pkg string, lock string, declared array<string>"))) == [("p", "a", "1.0", True), ("p", "b", "2.0", False)]
    lock = json.dumps({"packages": [{"name": "x/y", "version": "v1"}]})
    assert rows(readers.locked_composer(spark.createDataFrame([("p", lock, ["x/y"])], "pkg string, lock string, declared array<string>"))) == [("p", "x/y", "v1", True)]
    pom = '<project xmlns="http://m/4"><groupId>g</groupId><artifactId>a</artifactId><dependencies><dependency><groupId>h</groupId><artifactId>b</artifactId></dependency></dependencies><developers><developer><email>x@y.z</email></developer></developers></project>'
    x = readers.poms(spark.createDataFrame([(pom,)], "content string")).first()
    assert x.pkg == "g/a" and x.dependencies[0].artifactId == "b" and x.developers[0].email == "x@y.z"
    wrapped = spark.createDataFrame([("f", 1, "Short 1.0"), ("f", 2, "A.Very.Long.Name"), ("f", 3, "2.0")], "file string, n int, value string")
    assert rows(readers.wrapped_lines(wrapped)) == [("f", "A.Very.Long.Name", "2.0"), ("f", "Short", "1.0")]


def test_alert_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"rule": "read_file", "output_fields": {"fd.name": "/x"}}\n{"rule": "cut\n')
    good, bad = readers.alerts(spark, str(tmp_path / "a.json"))
    assert [r.rule for r in good.collect()] == ["read_file"] and bad.count() == 1


def test_normalizers(spark):
    docs = lambda d: spark.createDataFrame([("p", json.dumps(d)), ("bad", "{"), ("none", None)], "pkg string, value string")
    gem = metadata.normalize(docs({"name": "p", "version": "1", "authors": "A <a@b.c>", "licenses": ["MIT"], "dependencies": {"runtime": [{"name": "q", "requirements": ">= 1"}], "development": []}}), "ruby")
    npm = metadata.normalize(docs({"time": {"created": "2020-01-01T00:00:00Z", "1.0": "2020-02-01T00:00:00Z"}, "dependencies": {"q": "^1"}, "scripts": {"postinstall": "x"}, "maintainers": ["m <m@n.o>"]}), "javascript")
    pypi = metadata.normalize(docs({"info": {"author_email": "a@b.c", "requires_dist": ["Six (>=1)"]}, "releases": {"1.0": [{"upload_time": "2020-01-01T00:00:00"}], "2.0": []}}), "python")
    php = metadata.normalize(docs({"package": {"versions": {"1.0": {"version": "1.0", "time": "2020-01-01T00:00:00Z", "require": {"a/b": "1", "php": "7"}, "authors": [{"email": "x@y.z"}]}, "dev-a/b": {"time": "2021-01-01T00:00:00Z"}}}}), "php")
    nuget = metadata.normalize(docs({"items": [{"items": [{"catalogEntry": {"id": "p", "version": "1.0", "published": "2020-01-01T00:00:00Z", "authors": "Z"}}]}]}), "csharp")
    by = {r.pkg: r for r in npm.collect()}
    assert by["p"].has_install and [x.version for x in by["p"].releases] == ["1.0"] and by["bad"].dependencies == [] and by["none"].has_install is False
    every = gem.unionByName(npm).unionByName(pypi).unionByName(php).unionByName(nuget)
    assert {(r.src, r.dst) for r in metadata.edges(every).collect()} == {("p", "q"), ("p", "six"), ("p", "a/b")}
    assert {r.version for r in metadata.release_rows(pypi).collect()} == {"1.0"}
    assert php.filter("pkg = 'p'").first().emails == ["x@y.z"]


def test_archives(spark, tmp_path):
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w:gz") as t:
        info = tarfile.TarInfo("d/x.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("a.tgz", inner.getvalue())
        z.writestr("../evil", b"no")
        z.writestr("b.txt", b"yes")
    df = spark.createDataFrame([("p.zip", bytearray(outer.getvalue())), ("bad.gz", bytearray(gzip.compress(b"x")[:12]))], "path string, content binary")
    got = {(r.archive, r.path): r for r in readers.unpack(df).collect()}
    assert set(got) == {("p.zip", "a.tgz..d/x.txt"), ("p.zip", "b.txt"), ("bad.gz", None)} and bytes(got["p.zip", "a.tgz..d/x.txt"].content) == b"hi" and got["bad.gz", None].error
    assert readers.unpack(df, most_bytes=3).filter("error LIKE '%large%'").count() == 1


def test_stream_equals_batch(spark, tmp_path):
    from hornbeam.operators.behavior import alert_values

    lines = [{"ts": f"2024-01-01T00:{k % 60:02d}:00", "rule": "read_file", "output_fields": {"container.name": f"p{k % 3}..1.0..job", "fd.name": f"/f{k % 5}"}} for k in range(40)]
    for k in range(4):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, lines[k::4])))
    schema = "ts timestamp, rule string, output_fields map<string,string>"
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    stream.store(read, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = alert_values(spark.read.schema(schema).json(str(tmp_path / "in"))).distinct()
    got = spark.read.parquet(str(tmp_path / "out")).select(*batch.columns).distinct()
    assert got.withColumn("version", F.col("version").cast("string")).exceptAll(batch).count() == 0 and got.count() == batch.count() == 15
    q = stream.windowed_sets(read).writeStream.format("memory").queryName("sets").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("sets").count() == 3


def test_sync_keeps_each_row_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    snap = lambda *v: "\n".join(json.dumps({"pkg": "p", "version": x, "url": f"u/{x}"}) for x in v)
    for name, vs in (("1.json", ("1", "2")), ("2.json", ("2", "3", "3"))):
        (tmp_path / "in" / name).write_text(snap(*vs))
        sync.sync(sync.snapshots(spark, str(tmp_path / "in")), str(tmp_path / "known"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.version for r in spark.read.parquet(str(tmp_path / "known")).collect()) == ["1", "2", "3"]
    # a table that is there but cannot be read is an error, not an empty one
    (tmp_path / "broken" / "part=1").mkdir(parents=True)
    (tmp_path / "broken" / "part=1" / "x.parquet").write_bytes(b"no parquet")
    (tmp_path / "in2").mkdir()
    (tmp_path / "in2" / "1.json").write_text("\n".join(json.dumps({"pkg": f"p{k}", "version": "1", "url": "u"}) for k in range(2000)))
    with pytest.raises(StreamingQueryException):
        sync.sync(sync.snapshots(spark, str(tmp_path / "in2")), str(tmp_path / "broken"), str(tmp_path / "cp2")).awaitTermination()


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = {"rule": "read_file", "output_fields": {"container.name": "p..1.0..job", "fd.name": "/f"}}
    (tmp_path / "in" / "1.json").write_text(json.dumps(line))
    for k in range(2):  # as if the first run had failed before it was marked as done
        read = spark.readStream.schema("rule string, output_fields map<string,string>").json(str(tmp_path / "in"))
        stream.store(read, str(tmp_path / "out"), str(tmp_path / f"cp{k}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_deep_and_unread_archives(spark):
    data = b"deep"
    for k in range(7):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(f"{k}.zip" if k else "x.txt", data)
        data = out.getvalue()
    mixed = io.BytesIO()
    with zipfile.ZipFile(mixed, "w") as z:
        z.writestr("a.rar", b"Rar!\x1a\x07\x00rest")
        z.writestr("b.zip", b"PK\x03\x04 no archive")
        z.writestr("c.txt.gz", gzip.compress(b"plain"))
    df = spark.createDataFrame([("deep.zip", bytearray(data)), ("mixed.zip", bytearray(mixed.getvalue())), ("none", None)], "path string, content binary")
    got = {(r.archive, r.path): r for r in readers.unpack(df).collect()}
    assert bytes(got["deep.zip", "6.zip..5.zip..4.zip..3.zip..2.zip..1.zip..x.txt"].content) == b"deep"
    assert got["mixed.zip", "a.rar"].error and got["mixed.zip", "b.zip"].error and bytes(got["mixed.zip", "c.txt.gz"].content) == b"plain" and len(got) == 5


def test_files_by_language(spark, tmp_path):
    for name in ("a.py", "b.rb", "Rakefile", "sub/c.py", "d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    found = lambda language: sorted(r.path.split("/")[-1] for r in readers.sources(spark, str(tmp_path), language).collect())
    assert found("python") == ["a.py", "c.py"] and found("ruby") == ["Rakefile", "b.rb"] and readers.files(spark, str(tmp_path)).count() == 5
    assert readers.one_a_name(readers.files(spark, str(tmp_path)).select("path")).count() == 5


def test_small_readers(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"a": 1,\n "b": "x"}')
    assert tuple(readers.documents(spark, str(tmp_path / "d.json"), "a int, b string").first()) == (1, "x")
    frozen = spark.createDataFrame([("six", "1"), ("os", "2")], "name string, version string")
    assert rows(readers.frozen_and_declared(frozen, spark.createDataFrame([("Six",)], "name string"))) == [("six", "1")]
    doc = json.dumps({"name": "p", "versions": {"1": {"dist": {"tarball": "u1"}}, "2": {"dist": {"tarball": "u2"}}}})
    assert rows(readers.npm_tarballs(text(spark, doc, "{"))) == [("p", "1", "u1"), ("p", "2", "u2")]
    records = spark.createDataFrame([("p", "with_mirrors", 3), ("p", "with_mirrors", 4), ("p", "without_mirrors", 1)], "pkg string, category string, downloads long")
    assert rows(readers.recorded_downloads(records)) == [("p", 7)]
    assert rows(readers.shown(text(spark, "Name: Six\nVersion: 1.0\nRequires: A, b\n", "Version: 2"))) == [("six", "1.0", ["a", "b"])]
    lists = {"npm": {"rows": [{"id": "a"}]}, "npm_all": ["a"], "packagist": {"packageNames": ["a"]}, "rubygems": [{"name": "a"}], "nuget": {"items": [{"nuget:id": "a"}]}}
    for kind, d in lists.items():
        assert rows(readers.listed_names(text(spark, json.dumps(d), "no json"), kind)) == [("a",)], kind
    urls = spark.createDataFrame([("HTTP://X.org/A/",), ("http://x.org/b",)], "url string")
    assert rows(readers.without_urls(urls, spark.createDataFrame([("http://x.org/A",)], "url string"))) == [("http://x.org/b",)]


def test_small_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert json.loads(sinks.as_mapping(df, "k", "v").first().json) == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        sinks.as_mapping(df, "k", "v", most=1)
    sinks.write_documents(df, str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).count() == 2
    for _ in range(2):
        sinks.append_results(df.withColumn("language", F.lit("x")), str(tmp_path / "results"))
    assert spark.read.parquet(str(tmp_path / "results")).count() == 4
    assert rows(sinks.without_done(spark.createDataFrame([("a",), ("z",)], "k string"), str(tmp_path / "results"), ["k"])) == [("z",)]
    sinks.write_graph(spark.createDataFrame([("a", "b")], "src string, dst string"), str(tmp_path / "graph"))
    assert spark.read.parquet(str(tmp_path / "graph")).count() == 1
    wide = spark.createDataFrame([("a", 0, 2), ("b", None, 0)], "name string, a int, b int")
    assert rows(sinks.pairs_from_matrix(wide, "name")) == [("a", "a", 0), ("a", "b", 2), ("b", "b", 0)]


def test_small_metadata(spark):
    v = spark.createDataFrame([("p", "1", "2020-01-02 03:04:05")], "pkg string, version string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    listed = spark.createDataFrame([("p", "x"), ("q", "y")], "package_name string, version string")
    assert rows(metadata.with_time(listed, v)) == [("p", "1", "2020-01-02")]
    npm = metadata.normalize(spark.createDataFrame([("p", json.dumps({"maintainers": ["m <m@n.o>"], "scripts": {"pretest": "x"}, "browser": "b", "dependencies": {"z": "1"}}))], "pkg string, value string"), "javascript")
    assert npm.select("has_test", "has_exercise", "has_install").first() == (True, True, False)
    assert {r.package_name: r.emails for r in metadata.with_author(listed, npm).collect()} == {"p": ["m@n.o"], "q": None}
    assert {r.package_name: r.has_test for r in metadata.aggregated(listed, npm).collect()} == {"p": True, "q": None}
    edges = metadata.versioned_edges(spark.createDataFrame([("a", "1", "b", None)], "src string, src_version string, dst string, dst_version string"))
    assert rows(edges) == [("a==1", "b==latest")]
    c = spark.createDataFrame([(["Programming Language :: Python :: 3"],), (["Programming Language :: Python :: 3", "Programming Language :: Python :: 2"],), (None,)], "c array<string>")
    assert [r[0] for r in c.select(metadata.python_major(F.col("c"))).collect()] == ["python3", "python2", "python2"]
    s = spark.createDataFrame([({"1": "ok", "2": "bad"},)], "s map<string,string>")
    assert s.select(metadata.valid_versions(F.col("s"))).first()[0] == {"1": "ok"}
    both = metadata.package_records(npm, spark.createDataFrame([("p", "y"), ("q", "w")], "src string, dst string"))
    assert sorted((r.pkg, tuple(r.requires), r.known) for r in both.collect()) == [("p", ("y",), "both"), ("q", ("w",), "dependencies")]
    assert metadata.package_records(npm).first().known == "metadata"


DOCUMENTS = {
    "npmjs": ("@a/b", {"description": "d", "dependencies": {"x": "^1"}, "time": {"1.0.0": "2020-01-01T00:00:00Z"}}),
    "pypi": ("flask", {"info": {"author": "A", "requires_dist": ["jinja2 (>=2)"]}, "releases": {"1.0": [{"upload_time": "2020-01-01T00:00:00"}]}}),
    "rubygems": ("rails", {"authors": "B", "version": "6.0", "dependencies": {"runtime": [{"name": "rack", "requirements": ">= 0"}], "development": []}}),
    "packagist": ("mono/log", {"package": {"description": "l", "type": "library", "versions": {"1.0": {"version": "1.0", "time": "2020-01-01T00:00:00+00:00", "require": {"psr/log": "1.*"}}}}}),
    "nuget": ("Json", {"items": [{"items": [{"catalogEntry": {"id": "Json", "version": "1.0", "published": "2020-01-01T00:00:00Z", "authors": "C"}}]}]}),
}


def save(folder, registry, pkg, document):
    import json

    (folder / registry).mkdir(parents=True, exist_ok=True)
    file = folder / registry / registry_source.file_name(pkg)
    file.write_text(json.dumps(document))
    return file


def test_registries_as_a_source(spark, tmp_path):
    registry_source.register(spark)
    for name, (pkg, document) in DOCUMENTS.items():
        save(tmp_path / "in", name, pkg, document)
    (tmp_path / "in" / "notes.txt").write_text("x")
    docs = spark.read.format("registry").load(str(tmp_path / "in"))
    assert sorted((r.registry, r.pkg) for r in docs.collect()) == sorted((k, v[0]) for k, v in DOCUMENTS.items())
    got = {r.registry: r for r in registry_source.all_normalized(spark, str(tmp_path / "in")).collect()}
    assert set(got) == set(registry_source.REGISTRIES) and [d.name for d in got["pypi"].dependencies] == ["jinja2"] and got["packagist"].pkg == "mono/log" and got["nuget"].author == "C"
    assert {k: [r.version for r in v.releases] for k, v in got.items()} == {"npmjs": ["1.0.0"], "pypi": ["1.0"], "rubygems": ["6.0"], "packagist": ["1.0"], "nuget": ["1.0"]}
    with pytest.raises(ValueError):
        registry_source.normalized(docs, "cpan")
    assert spark.read.format("registry").load(str(tmp_path / "none")).count() == 0


def test_registry_partitions_and_options(spark, tmp_path, monkeypatch):
    for k in range(5):
        save(tmp_path, "pypi", f"p{k}", {})
    save(tmp_path, "npmjs", "p1", {})
    monkeypatch.setattr(registry_source, "FILES", 2)
    reader = registry_source.RegistryReader(str(tmp_path))
    assert [len(p.files) for p in reader.partitions()] == [1, 2, 2, 1]
    assert [len(p.files) for p in registry_source.RegistryReader(str(tmp_path), "pypi").partitions()] == [2, 2, 1]
    registry_source.register(spark)
    one = spark.read.format("registry").option("registry", "pypi").option("pkg", "p1").load(str(tmp_path))
    assert [(r.registry, r.pkg) for r in one.collect()] == [("pypi", "p1")] and one.rdd.getNumPartitions() == 1
    docs = spark.read.format("registry").load(str(tmp_path))
    both = docs.filter("registry = 'pypi' AND pkg = 'p2'").union(docs.filter("registry = 'npmjs'"))
    assert rows(both.select("registry", "pkg")) == [("npmjs", "p1"), ("pypi", "p2")]


def test_registry_stream(spark, tmp_path):
    import os

    registry_source.register(spark)
    for k in range(5):
        os.utime(save(tmp_path / "in", "pypi", f"p{k}", {"k": k}), (1000 + k, 1000 + k))

    def run():
        docs = spark.readStream.format("registry").option("maxFilesPerTrigger", 2).load(str(tmp_path / "in"))
        q = docs.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(r.pkg for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["p0", "p1", "p2", "p3", "p4"]
    os.utime(save(tmp_path / "in", "pypi", "p9", {}), (2000, 2000))
    assert run() == ["p0", "p1", "p2", "p3", "p4", "p9"]  # begins again where it has stopped


def test_a_table_that_many_add_to(spark, tmp_path):
    t = merged.MergedTable(spark, str(tmp_path / "t"), "pkg string, version string, files array<string>, hosts array<string>, n int", ["pkg", "version"], ["files", "hosts"])
    assert t.read().count() == 0
    rows_of = lambda *x: spark.createDataFrame(x, "pkg string, version string, files array<string>, hosts array<string>, n int")
    one, two = rows_of(("p", "1", ["b", "a"], [], 1), ("p", "1", ["c"], ["h"], 3), ("q", None, None, ["h"], 1)), rows_of(("p", "1", ["a", "d"], ["g"], 2))
    for _ in range(2):  # the second time is a rerun
        t.add(one, "one", 0)
        t.add(two, "two", 0)
    want = [("p", "1", ["a", "b", "c", "d"], ["g", "h"], 3), ("q", None, [], ["h"], 1)]
    got = lambda: sorted((r.pkg, r.version, r.files or [], r.hosts, r.n) for r in t.read().collect())
    assert got() == want
    t.compact()
    assert got() == want
    t.add(two, "two", 0)  # again after it was compacted
    assert got() == want
    t.add(rows_of(("p", "1", ["e"], None, None)), "two", 1)
    want[0] = ("p", "1", ["a", "b", "c", "d", "e"], ["g", "h"], 3)
    assert got() == want
    t.compact()
    t.compact()
    assert got() == want
    (tmp_path / "t" / "added" / "three@0").mkdir()  # not finished
    assert got() == want
    with pytest.raises(ValueError):
        t.add(one, "a/b", 0)


def test_graphs_by_kind(spark, tmp_path):
    from hornbeam.sources import graphs

    rows_ = [("a", "1", "b", None), ("b", "2", "c", "3"), ("d", "1", "a", "1"), ("a", "2", "b", None), (None, "1", "b", None)]
    made = graphs.kinds(spark.createDataFrame(rows_, "src string, src_version string, dst string, dst_version string"), spark.createDataFrame([("a",), ("zz",)], "id string"))
    graphs.write(made, str(tmp_path / "g"))
    got = lambda **how: sorted(map(tuple, graphs.load(spark, str(tmp_path / "g"), **how).collect()))
    assert got() == [("a", "b"), ("b", "c"), ("d", "a")] and got(popular=True) == [("a", "b"), ("b", "c")]
    assert got(popular=True, versions=True) == [("a==1", "b==latest"), ("a==2", "b==latest"), ("b==2", "c==3")]
    with pytest.raises(ValueError):
        graphs.load(spark, str(tmp_path / "g"), versions=True)
    assert "PartitionFilters: [isnotnull(kind" in graphs.load(spark, str(tmp_path / "g"))._jdf.queryExecution().executedPlan().toString()


def test_gem_records_of_odd_documents(spark):
    docs = spark.createDataFrame([(x,) for x in ('{"name": "a", "authors": "b", "version": "1", "project_uri": "u", "downloads": 3}', "no", None, "{}")], "value string")
    assert [tuple(r) for r in metadata.gem_records(docs).collect()] == [("a", "b", "1", "u", 3, [])]
