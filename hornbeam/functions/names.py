"""Column builders for names, versions, hosts, e-mail addresses and digests. All stay in Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[\w\.-]+@[\w\.-]+"
#: The IPv4 networks that are not for general use (RFC 6890, and RFC 5771 for multicast).
PRIVATE_IPV4 = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
]


def as_bytes(text: Column) -> Column:
    """A string with one character for each UTF-8 byte, so that lengths and distances count bytes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def edit_distance(a: Column, b: Column, metric: str = "bytes", limit: int | None = None) -> Column:
    """Levenshtein distance by bytes or chars, or by bytes over the longer length; -1 beyond the limit."""
    if metric != "chars":
        a, b = as_bytes(a), as_bytes(b)
    found = F.levenshtein(a, b, limit) if limit is not None else F.levenshtein(a, b)
    return found if metric != "normalized" else F.when(F.greatest(F.length(a), F.length(b)) == 0, F.lit(0.0)).otherwise(found / F.greatest(F.length(a), F.length(b)))


def emails(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)))


def file_name(name: Column) -> Column:
    """A package name as results are filed under: slashes and odd characters become two dots."""
    return F.regexp_replace(F.replace(name, F.lit("/"), F.lit("..")), r"[^a-zA-Z0-9_.-]", "..")


def container_name(name: Column) -> Column:
    """A package name as containers are called: no leading @, and a marker before a first character that is no letter or digit."""
    plain = file_name(F.regexp_replace(name, "^@", ""))
    return F.when(plain.rlike(r"^[a-zA-Z0-9]"), plain).otherwise(F.concat(F.lit("san.."), plain))


def result_key(name: Column, version: Column, kind: Column, sudo: Column | None = None) -> Column:
    """name:version[:sudo].kind, `latest` where there is no version."""
    mark = F.lit(None).cast("string") if sudo is None else F.when(sudo, F.lit("sudo"))
    return F.concat_ws(".", F.concat_ws(":", file_name(name), F.coalesce(version, F.lit("latest")), mark), kind)


#: What the file of each kind of result ends in, and whether it is one of a version.
RESULT_KINDS = {
    "trace": ("strace", True), "trace_dep": ("dep.strace", True), "metadata": ("metadata.json", True), "versions": ("versions.json", False), "version2hash": ("version2hash.json", False),
    "dep": ("dep.json", True), "flatten_dep": ("flatten_dep.json", True), "astgen": ("astgen.txt", True), "compare_versions": ("compare_versions.json", False), "astfilter": ("astfilter.txt", True),
    "taint": ("taint.txt", True), "danger": ("danger.txt", True), "static": ("static.txt", True), "dynamic": ("dynamic.txt", True), "concolic": ("dynamic.txt", True), "result": ("result.txt", True),
}


def result_keys(name: Column, version: Column, sudo: Column | None = None) -> Column:
    """A map of kind -> file name for all of RESULT_KINDS; only kinds of a version carry it and the mark of sudo."""
    of = lambda suffix, versioned: result_key(name, version, F.lit(suffix), sudo) if versioned else F.concat_ws(".", file_name(name), F.lit(suffix))
    return F.create_map(*[x for kind, how in RESULT_KINDS.items() for x in (F.lit(kind), of(*how))])


def split_container(name: Column) -> Column:
    """(package, version or null, sudo) of name..version..job, split from the right; null if there are not two splits."""
    pattern = r"^(.*)[.][.]((?:(?![.][.]).)*)[.][.]((?:(?![.][.]).)*)$"
    version = F.regexp_extract(name, pattern, 2)
    found = F.struct(
        F.regexp_extract(name, pattern, 1).alias("pkg"),
        F.when(version != "None", version).alias("version"),
        F.regexp_extract(name, pattern, 3).endswith("sudo").alias("sudo"),
    )
    return F.when(name.rlike(pattern), found)


def is_hostname(host: Column) -> Column:
    """At most 255 characters, a dot within, labels of 1 to 63 letters, digits and hyphens that no hyphen begins or ends."""
    plain = F.regexp_replace(host, r"\.$", "")
    labels = F.split(plain, "[.]")
    good = F.forall(labels, lambda x: x.rlike(r"^(?!-)[A-Za-z0-9-]{1,63}(?<!-)$"))
    return F.coalesce((F.length(host) <= 255) & plain.contains(".") & good, F.lit(False))


def first_hostname(payload: Column) -> Column:
    """The first valid host name in a DNS payload whose parts two dots separate, or null."""
    parts = F.transform(F.split(payload, "[.][.]"), lambda x: F.regexp_replace(x, r"^\.+|\.+$", ""))
    return F.get(F.filter(parts, is_hostname), 0)


def version_array(version: Column) -> Column:
    """v1.10.0 -> [1, 10, 0], of numbers of up to 38 digits; arrays compare number by number; a blank or odd part counts as 0."""
    return F.transform(F.split(F.btrim(version, F.lit("v")), "[.]"), lambda x: F.coalesce(x.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")))


def is_plain_version(version: Column) -> Column:
    """Digits and dots with at least one digit, v allowed around them."""
    return version.rlike(r"^v*[0-9.]*[0-9][0-9.]*v*$")


def time_bucket(first: Column, ts: Column, gap_days: int) -> Column:
    """Whole gaps between ts and first, towards zero."""
    seconds = F.unix_micros(first.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    return (seconds / F.lit(gap_days * 86_400_000_000)).cast("long")


def md5_prefix(text: Column) -> Column:
    """The first 16 hex digits of the md5."""
    return F.substring(F.md5(F.encode(text, "UTF-8")), 1, 16)


def md5_number(text: Column) -> Column:
    """The same as a number, which needs an unsigned 64-bit type: a decimal."""
    return F.conv(md5_prefix(text), 16, 10).cast("decimal(20,0)")


def draw(key: Column, seed: int = 0) -> Column:
    """A number from 0 up to 2**52 that key and seed decide, the same in any engine that has md5."""
    digits = F.substring(F.md5(F.encode(F.concat(key.cast("string"), F.lit(f"|{seed}")), "UTF-8")), 1, 13)
    return F.conv(digits, 16, 10).cast("long")


def is_ascii(text: Column) -> Column:
    return text.rlike(r"^[\x15-\x7f]*$")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "[^/]*$", ""), "/$", "")


def literal_map(cell: Column, value: str = "bigint") -> Column:
    """A cell with a flat Python dict literal as a map; null if it does not parse."""
    plain = F.regexp_replace(F.regexp_replace(F.translate(cell, "'", '"'), r"\bu\"", '"'), r"\bNone\b", "null")
    return F.from_json(plain, f"map<string,{value}>")


def literal_json(cell: Column) -> Column:
    """A Python literal of dicts, lists, strings, numbers, True, False and None as JSON text, which from_json takes with
    any schema. Strings may have the other kind of quote in them."""
    strings = F.regexp_replace(cell, r"\bu(?=['\"])", "")
    # a string in single quotes: its double quotes are escaped, its escaped single quotes are not, and its ends change
    parts = F.regexp_extract_all(strings, F.lit(r"""('(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|[^'"]+)"""), F.lit(1))
    quoted = lambda x: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(x.substr(F.lit(2), F.length(x) - 2), r'(?<!\\)"', r'\\"'), r"\\'", "'"), F.lit('"'))
    words = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    return F.array_join(F.transform(parts, lambda x: F.when(x.startswith("'"), quoted(x)).when(x.startswith('"'), x).otherwise(words(x))), "")


def is_yes(text: Column) -> Column:
    return F.coalesce(F.lower(text).isin("yes", "true", "t", "1", "enabled"), F.lit(False))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1))


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)


def is_npm_name(name: Column) -> Column:
    """No characters that npm names do not have, and @ only as the first."""
    return F.coalesce(name.rlike(r"^@?[^@\s~'!()*\"<>\\{}|^`?#%&=+,:;\[\]]+$"), F.lit(False))


def maven_coordinate(path: Column) -> Column:
    """org/example/lib/ -> org.example/lib."""
    plain = F.regexp_replace(path, "^/+|/+$", "")
    return F.concat_ws("/", F.translate(F.regexp_extract(plain, "^(.*)/[^/]+$", 1), "/", "."), F.regexp_extract(plain, "([^/]+)$", 1))


def reversed_octets(ip: Column) -> Column:
    return F.array_join(F.reverse(F.split(ip, "[.]")), ".")


def ipv4_number(ip: Column) -> Column:
    p = F.split(ip, "[.]")
    octet = lambda k: F.get(p, k).try_cast("long")
    return octet(0) * 16777216 + octet(1) * 65536 + octet(2) * 256 + octet(3)


def in_network(ip: Column, cidr: str) -> Column:
    """Whether an address lies in a network like 10.0.0.0/8, by comparing numbers."""
    base, _, bits = cidr.partition("/")
    a = sum(int(x) << s for x, s in zip(base.split("."), (24, 16, 8, 0)))
    size = 1 << (32 - int(bits or 32))
    low = a // size * size
    return F.coalesce(ipv4_number(ip).between(low, low + size - 1), F.lit(False))


def is_private_ip(ip: Column) -> Column:
    """Whether an address is in one of PRIVATE_IPV4; false for anything else, null included."""
    out = F.lit(False)
    for network in PRIVATE_IPV4:
        out = out | in_network(ip, network)
    return out


def has_domain(text: Column) -> Column:
    """Whether two words stand side by side with a dot between them."""
    return F.coalesce(text.rlike(r"\w[.]\w"), F.lit(False))


def ends_with_any(text: Column, suffixes: list[str]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | text.endswith(s)
    return F.coalesce(out, F.lit(False))


def source_range(text: Column, start_row: Column, start_col: Column, end_row: Column, end_col: Column) -> Column:
    """The part of a text between two places; rows count from 1, columns from 0, the end is not included."""
    lines = F.split(text, "\n")
    inside = F.slice(lines, start_row, end_row - start_row + 1)
    first_cut = F.substring(F.array_join(inside, "\n"), start_col + 1, F.length(text))
    tail = F.length(F.element_at(inside, -1)) - end_col
    return first_cut.substr(F.lit(1), F.length(first_cut) - tail)


def months_ago(day: Column, months: int) -> Column:
    """The day that is so many twelfths of 365 days earlier."""
    return F.date_sub(day, months * 365 // 12)


def url_join(base: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", ""))


def query_string(parameters: Column) -> Column:
    """a=b&c=d of a map, keys in order."""
    pairs = F.array_sort(F.map_entries(parameters))
    return F.array_join(F.transform(pairs, lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"]))), "&")
