"""Checks of calls as rows of a table: an index of calls by method, target and chain, and what is looked up in it.

The index is made of the rows of extract.api_calls(). A call's direct target is what is written before it; a call on
another call's value (`User.where(a).order(b)`) has no direct target, but the target and the names of its whole chain. A
call is nested where it is the target of another one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.functions.storage import Parts, cut

CHECK = "check string, methods array<string>, method_pattern string, targets array<string>, target_pattern string, chained boolean, nested_ok boolean, argument string, place int, unless string, message string, confidence string"
#: Checks of Ruby code. methods or method_pattern: the call's name; targets or target_pattern: what it is called on ("" is
#: nothing), of the whole chain if chained; nested_ok: also where it is the target of another call; argument: a pattern
#: that some argument, or the one at place, has; unless: a pattern that the call's text must not have.
_FROM_USER = r"\b(?:params|cookies|request\.env|session)\b"
RUBY = [
    ("execute", ["system", "exec", "spawn", "popen", "capture2", "capture3", "syscall"], None, None, r"^$|^(?:Kernel|IO|Open3|Process|PTY)$", False, True, r"#\{|" + _FROM_USER, None, r"shellescape|Shellwords", "a command made of parts", "medium"),
    ("execute", ["builtin_xstring"], None, None, None, False, True, r"#\{", None, r"shellescape|Shellwords", "a command made of parts", "medium"),
    ("evaluation", ["eval", "instance_eval", "class_eval", "module_eval"], None, None, None, False, True, _FROM_USER, None, None, "code of a user's is run", "high"),
    ("deserialize", ["load", "restore", "load_documents", "load_stream", "object_load"], None, ["Marshal", "YAML", "CSV", "Oj"], None, False, True, None, None, r"SafeLoader|safe:\s*true", "objects are made of data", "medium"),
    ("send", ["send", "__send__", "public_send", "try"], None, None, None, False, True, _FROM_USER, 0, None, "a user names the method", "high"),
    ("file_access", ["open", "read", "readlines", "new", "delete", "mv", "cp", "rm", "mkdir", "chmod"], None, ["File", "IO", "Dir", "FileUtils", "Kernel", "Pathname"], None, False, True, _FROM_USER, None, r"basename", "a user names the file", "medium"),
    ("redirect", ["redirect_to", "redirect_back"], None, [""], None, False, True, _FROM_USER, 0, r"only_path", "a user names the address", "high"),
    ("render_inline", ["render"], None, [""], None, False, True, r"^(?::inline\s*=>|inline:)", None, None, "a template within code", "low"),
    ("sql", ["where", "order", "group", "having", "joins", "from", "select", "find_by_sql", "delete_all", "update_all", "pluck"], None, None, r"^[A-Z]", True, True, r"^\".*#\{", 0, r"sanitize_sql|\.to_i\}", "a query made of parts", "high"),
    ("weak_hash", ["digest", "hexdigest", "base64digest", "new"], None, None, r"^(?:OpenSSL::)?Digest::(?:MD5|SHA1)$", False, True, None, None, None, "a weak hash", "low"),
    ("unsafe_reflection", ["constantize", "safe_constantize", "const_get", "qualified_const_get"], None, None, None, True, True, None, None, None, "a class named by data", "medium"),
    ("dynamic_finder", None, r"^find_by_\w*(?:password|token)\w*$", None, r"^[A-Z]", False, True, None, None, r"\.to_s", "a finder of secrets takes any type", "medium"),
    ("unescaped", ["raw", "html_safe", "content_tag"], None, None, None, True, False, _FROM_USER, None, r"\bh\(|escape", "a user's text as markup", "medium"),
]


def ruby_checks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RUBY, CHECK)


def index(calls: DataFrame) -> DataFrame:
    """(pkg, version, language, file, method, target, root, chain, nested, arguments, source, start_row, start_col):
    target: what is written before the call, "" for nothing, null for a call's value; root and chain: target and names
    of the first call of the chain up to this one. Rounds: the longest chain."""
    key = ["pkg", "version", "file"]
    c = calls.filter(F.col("name").isNotNull()).select(*key, "language", F.col("name").alias("method"), F.when(F.col("base_type") != "dummy", F.col("base_type")).when(F.col("base_type").isNull(), "").alias("target"), "arguments", "source", "start_row", "start_col", "end_row", "end_col")
    c = cut(c.withColumn("version", F.coalesce("version", F.lit(""))))
    here = [*key, "start_row", "start_col"]
    onward = c.filter("target IS NULL").select(*key, F.col("start_row").alias("end_row"), (F.col("start_col") + 1).alias("end_col"), F.col("method").alias("next"), F.col("start_row").alias("row"), F.col("start_col").alias("col"))
    first = c.filter("target IS NOT NULL").select(*key, "end_row", "end_col", "start_row", "start_col", "method", F.col("target").alias("root"), F.array("method").alias("chain"))
    found = Parts(first.select(*here, "method", "root", "chain").distinct())
    ends, last = c.select(*here, "method", F.col("end_row"), F.col("end_col")).distinct(), found.all()
    while not last.isEmpty():
        step = last.join(ends, [*here, "method"]).drop("start_row", "start_col").join(onward, [*key, "end_row", "end_col"])
        last = found.add(step.select(*key, F.col("row").alias("start_row"), F.col("col").alias("start_col"), F.col("next").alias("method"), "root", F.concat("chain", F.array("next")).alias("chain")).distinct())
    nested = onward.select(*key, "end_row", "end_col").distinct().withColumn("nested", F.lit(True))
    chained = c.join(found.all().groupBy(*here, "method").agg(F.min("root").alias("root"), F.min("chain").alias("chain")), [*here, "method"], "left").join(nested, [*key, "end_row", "end_col"], "left")
    return chained.select(*key, "language", "method", "target", "root", F.coalesce("chain", F.array("method")).alias("chain"), F.coalesce("nested", F.lit(False)).alias("nested"), "arguments", "source", "start_row", "start_col")


#: Rows of a table of checks that are broadcast.
BROADCAST = 10_000


def find(calls: DataFrame, checks: DataFrame) -> DataFrame:
    """(pkg, version, file, check, message, confidence, method, target, source, start_row, start_col): calls of an index()
    that a check (rows of CHECK) is about. Checks that list methods meet calls by method; only those with a pattern of
    methods are held against all calls."""
    checks = cut(checks)
    if checks.count() > BROADCAST:
        raise ValueError(f"more than {BROADCAST} checks")
    named = checks.filter("methods IS NOT NULL").withColumn("method", F.explode(F.array_distinct("methods")))
    by_name = calls.join(F.broadcast(named), "method")
    both = by_name.select(*calls.columns, *checks.columns)
    loose = checks.filter("methods IS NULL AND method_pattern IS NOT NULL")
    if patterns := [r.method_pattern for r in loose.select("method_pattern").distinct().collect()]:  # BROADCAST at most
        fits = F.filter(F.array(*map(F.lit, patterns)), lambda x: F.rlike("method", x))
        by_pattern = calls.withColumn("method_pattern", F.explode(fits)).join(F.broadcast(loose), "method_pattern")
        both = both.unionByName(by_pattern.select(*both.columns))
    on = F.when(F.coalesce("chained", F.lit(False)), F.col("root")).otherwise(F.col("target"))
    both = both.withColumn("_on", on)
    target = F.expr("(targets IS NULL AND target_pattern IS NULL) OR coalesce(array_contains(targets, _on), false) OR coalesce(rlike(_on, target_pattern), false)")
    some = F.expr("argument IS NULL OR coalesce(CASE WHEN place IS NULL THEN exists(arguments, a -> rlike(a, argument)) ELSE rlike(get(arguments, place), argument) END, false)")
    kept = both.filter(target & some & F.expr("(coalesce(nested_ok, false) OR NOT nested) AND NOT coalesce(rlike(source, unless), false)"))
    return kept.select("pkg", "version", "file", "check", "message", "confidence", "method", "target", "source", "start_row", "start_col").distinct()
