"""API calls in source files. One Python worker function per language, behind a registry; sources are only parsed.

mode `reference` resolves `from m import f as g` for bare names alone and leaves other bases as written; `resolved`
also follows `import a.b as c`. A file that does not parse gives one row with its error, and costs no other file's rows.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.functions.deadline import within
from hornbeam.functions.storage import in_arrow

CALL = "base_type string, name string, full_name string, arguments array<string>, source string, start_row int, start_col int, end_row int, end_col int"
#: Language -> extensions (fixed values).
EXTENSIONS = {"python": [".py"], "javascript": [".js"], "ruby": [".rb"], "php": [".php"], "java": [".class", ".jar", ".dex", ".apk"]}
Call = tuple[str | None, str, list[str], str, int, int, int, int]


def python_calls(source: str, mode: str = "reference") -> Iterator[Call]:
    tree = ast.parse(source)
    alias, module, bases = {}, {}, {}
    for node in ast.walk(tree):
        if isinstance(node, ast.ImportFrom):
            for a in node.names:
                if a.asname:
                    alias.setdefault(a.asname, a.name)
                if node.module and not node.level:
                    module.setdefault(a.name, node.module)
        elif isinstance(node, ast.Import):
            for a in node.names:
                bases.setdefault(a.asname or a.name, a.name)
    raw = source.encode("utf-8", "surrogatepass")
    line = [0, *(m.end() for m in re.finditer(rb"\r\n|\r|\n", raw))]  # places are counted in bytes of a line
    text = lambda n: raw[line[n.lineno - 1] + n.col_offset : line[n.end_lineno - 1] + n.end_col_offset].decode("utf-8", "surrogatepass") or ast.unparse(n)
    calls = sorted((n for n in ast.walk(tree) if isinstance(n, ast.Call)), key=lambda n: (n.lineno, n.col_offset, -(n.end_lineno or 0), -(n.end_col_offset or 0)))
    for node in calls:
        f = node.func
        if isinstance(f, ast.Attribute):
            name, base = f.attr, f.value.id if isinstance(f.value, ast.Name) else text(f.value)
            if mode == "resolved":
                head, dot, rest = base.partition(".")
                base = bases.get(base) or (bases[head] + dot + rest if head in bases else base)
        else:
            name = text(f)
            name = alias.get(name, name)
            base = module.get(name)
        arguments = [text(a) for a in node.args] + [("**" + text(k.value)) if k.arg is None else f"{k.arg}={text(k.value)}" for k in node.keywords]
        yield base, name, arguments, text(node), node.lineno, node.col_offset, node.end_lineno or node.lineno, node.end_col_offset or 0


#: Per language: strings and comments to pass over, and the shape of a call's name before its bracket.
_BLANK = {
    "ruby": r"#(?!\{)[^\n]*|^=begin.*?^=end|'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"",
    "php": r"//[^\n]*|#[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"",
}
_NAME = {
    "javascript": r"(?:([A-Za-z_$][\w$]*(?:\??\.[A-Za-z_$][\w$]*)*|\)|\])\s*\??\.\s*)?([A-Za-z_$][\w$]*)\s*(?:\?\.\s*)?\(",
    "ruby": r"(?:([A-Za-z_@$][\w:@]*(?:\.[a-z_]\w*[?!]?)*|\)|\])\s*(?:\.|&\.)\s*)?([A-Za-z_]\w*[?!]?)(?:\s*\(|[ \t]+(?=['\"\w:@$\[]))",
    "php": r"(?:(\$?[A-Za-z_\\][\w\\]*|\)|\])\s*(?:->|::)\s*)?([A-Za-z_][\w\\]*)\s*\(",
}
NOT_CALLS = {
    "javascript": {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "with", "super"},
    "ruby": {"if", "unless", "while", "until", "def", "class", "module", "return", "and", "or", "not", "end", "do", "then", "else", "elsif", "case", "when", "in", "puts_", "yield", "begin", "rescue", "ensure", "alias"},
    "php": {"if", "for", "foreach", "while", "switch", "catch", "function", "return", "array", "list", "isset", "empty", "elseif", "fn", "match", "declare"},
}
_BACKTICK = {"ruby": "builtin_xstring", "php": "shell_exec"}


#: What ends plain code in a script: comments, strings, the start of a template, a slash; and braces, within templates.
_SCRIPT = r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?|`|/"
_IN_CODE, _IN_TEMPLATE_CODE = re.compile(_SCRIPT, re.S), re.compile(_SCRIPT + "|[{}]", re.S)
_TEMPLATE = re.compile(r"(?:\\.|(?!\$\{)[^`\\])*", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_BEFORE_REGEX = re.compile(r"(?:^|[^\w$)\]'\"`.]|(?<![\w$.])(?:return|typeof|case|in|of|delete|void|instanceof|new|do|else|throw|await|yield))$")


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def _masked_script(source: str) -> str:
    """Strings, templates' text, regular expressions and comments blanked; what templates compute is kept. A slash
    begins a regular expression where no value stands before it."""
    out, at, depths, last = [], 0, [], ""
    while True:
        m = (_IN_TEMPLATE_CODE if depths else _IN_CODE).search(source, at)
        gap = source[at : m.start() if m else len(source)]
        out.append(gap)
        last = (last + gap[-40:]).rstrip()[-20:]
        if not m:
            return "".join(out)
        at, text = m.end(), m[0]
        if text[:2] in ("//", "/*"):
            out.append(_blank(text))
            continue
        if text == "/":
            regex = _REGEX.match(source, m.start()) if _BEFORE_REGEX.search(last) else None
            out.append(text if regex is None else "/" + _blank(regex[0][1:-1]) + "/")
            at, last = (at, "/") if regex is None else (regex.end(), "]")
            continue
        if text == "{":
            depths[-1] += 1
            out.append(text)
            last = "{"
            continue
        if text == "}" and depths[-1]:
            depths[-1] -= 1
            out.append(text)
            last = "}"
            continue
        if text in "`}":  # into a template's text, or back to it
            if text == "}":
                depths.pop()
            inside = _TEMPLATE.match(source, at)
            out.append(("`" if text == "`" else " ") + _blank(inside[0]))
            at = inside.end()
            if source[at : at + 2] == "${":
                out.append("  ")
                depths.append(0)
                at, last = at + 2, "{"
            else:
                out.append(source[at : at + 1])
                at, last = at + 1, "`"
            continue
        out.append(text[0] + _blank(text[1:-1]) + (text[-1] if len(text) > 1 else ""))
        last = '"'


def masked(source: str, language: str) -> str:
    """The source with strings' and comments' insides blanked, places kept."""
    if language == "javascript":
        return _masked_script(source)
    return re.sub(_BLANK[language], lambda m: _blank(m[0]) if m[0][:1] in "/#=" else m[0][0] + _blank(m[0][1:-1]) + m[0][-1:], source, flags=re.S | re.M)


def brackets(text: str) -> dict[int, int]:
    """Where each opening bracket is closed; one that never is, at the last character."""
    out, open_ = {}, []
    for m in re.finditer(r"[()\[\]{}]", text):
        if m[0] in "([{":
            open_.append(m.start())
            out[m.start()] = len(text) - 1
        elif open_:
            out[open_.pop()] = m.start()
    return out


def parts_of(source: str, plain: str, a: int, b: int, strip: bool = True) -> list[str]:
    """What stands between the commas of source[a:b]."""
    out, depth, start = [], 0, a
    for m in re.compile(r"[()\[\]{},]").finditer(plain, a, b):
        depth += (m[0] in "([{") - (m[0] in ")]}")
        if m[0] == "," and not depth:
            out.append(source[start : m.start()])
            start = m.end()
    if out or source[start:b].strip():
        out.append(source[start:b])
    return [x.strip() for x in out] if strip else out


def token_calls(source: str, language: str) -> Iterator[Call]:
    """Calls found by tokens: name, base as written (`dummy` after a bracket), arguments up to the closing bracket."""
    plain, commands = masked(source, language), []
    if language in _BACKTICK:
        commands = [(m.start(), m.end() - 1, None, _BACKTICK[language], [m[0][1:-1]]) for m in re.finditer(r"`[^`]*`", plain)]
        plain = re.sub(r"`[^`]*`", lambda m: "`" + _blank(m[0][1:-1]) + "`", plain)
    closed = brackets(plain)
    line = [0, *(m.end() for m in re.finditer("\n", source))]

    def place(k: int) -> tuple[int, int]:
        import bisect

        row = bisect.bisect_right(line, k)
        return row, k - line[row - 1]

    found = []
    for m in re.finditer(_NAME[language], plain):
        name, base = m[2], m[1]
        before = plain[max(0, m.start(2) - 100) : m.start(2)].rstrip()[-9:]
        if name in NOT_CALLS[language] or (base or "") in NOT_CALLS[language] or re.search(r"\b(function|def|fn)$", before):
            continue
        if plain[m.end() - 1] == "(":
            end = closed[m.end() - 1]
            arguments = parts_of(source, plain, m.end(), end)
        else:
            end = (plain.find("\n", m.end()) + len(plain) + 1) % (len(plain) + 1) - 1
            arguments = parts_of(source, plain, m.end(), end + 1)
        found.append((m.start(1) if base else m.start(2), end, "dummy" if base in (")", "]") else base, name, arguments))
    for a, b, base, name, arguments in sorted(found + commands, key=lambda x: x[:2]):
        yield base, name, arguments, source[a : b + 1], *place(a), *place(b + 1)


EXTRACTORS: dict[str, Callable[[str, str], Iterator[Call]]] = {"python": python_calls} | {x: (lambda source, mode, x=x: token_calls(source, x)) for x in ("javascript", "ruby", "php")}
OUT = f"pkg string, version string, language string, file string, {CALL}, error string"


#: Seconds that one file may take.
SECONDS = 60.0


def file_calls(language: str, content: str | None, mode: str = "reference", most_bytes: int = 8 << 20, seconds: float | None = SECONDS) -> tuple[list[Call], str | None]:
    """The calls of one file, or none and why."""
    try:
        if content is None or len(content) > most_bytes:
            raise ValueError("no content" if content is None else "too large")
        if language not in EXTRACTORS:
            raise ValueError(f"no extractor for {language}")
        with within(seconds):
            return list(EXTRACTORS[language](content, mode)), None
    except (SyntaxError, ValueError, RecursionError, MemoryError, TimeoutError) as e:
        return [], f"{type(e).__name__}: {e}"[:500]


def api_calls(files: DataFrame, mode: str = "reference", most_bytes: int = 8 << 20, seconds: float | None = SECONDS) -> DataFrame:
    """Rows of OUT from files (pkg, version, language, path, content): one a call, or one with an error for a file that
    is null, larger than most_bytes, of a language without an extractor, does not parse, or not in so many seconds."""
    names = [x.split()[0] for x in OUT.replace("array<string>", "a").split(", ")]
    kinds = [pa.string()] * 7 + [pa.list_(pa.string()), pa.string()] + [pa.int32()] * 4 + [pa.string()]

    def work(batches):
        for b in batches:
            rows = []
            for pkg, version, language, path, content in zip(*(c.to_pylist() for c in b.columns)):
                found, error = file_calls(language, content, mode, most_bytes, seconds)
                if error is not None:
                    rows.append((pkg, version, language, path, *[None] * 9, error))
                for base, name, arguments, source, *where in found:
                    rows.append((pkg, version, language, path, base, name, f"{base}.{name}" if base else name, arguments, source, *where, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names)

    return files.select("pkg", "version", "language", "path", F.col("content").cast("string")).transform(in_arrow, work, OUT)


class ApiCalls:
    """The table function: a row a call of one source, or one row with its error."""

    def eval(self, language: str, source: str, mode: str = "reference"):
        found, error = file_calls(language, source, mode)
        if error is not None:
            yield (*[None] * 9, error)
        for base, name, arguments, text, *where in found:
            yield base, name, f"{base}.{name}" if base else name, arguments, text, *where, None


def register(spark: SparkSession, name: str = "api_calls_of") -> None:
    """SQL then has it: SELECT ... FROM files f, LATERAL api_calls_of(f.language, f.content [, mode]) c."""
    spark.udtf.register(name, F.udtf(ApiCalls, returnType=f"{CALL}, error string"))


def known_calls(calls: DataFrame, catalogue: DataFrame, func_only: bool = False) -> DataFrame:
    """Calls in the catalogue: by full name, or by function alone (with a base .name). Both `::` and `->` count as dots."""
    key = lambda c: F.regexp_replace(c, "::|->", ".")
    if func_only:
        last = lambda c: F.when(key(c).contains("."), F.concat(F.lit("."), F.element_at(F.split(key(c), "[.]"), -1))).otherwise(key(c))
        return calls.join(catalogue.select(last(F.col("full_name")).alias("_k")).distinct(), last(F.col("full_name")) == F.col("_k"), "left_semi")
    return calls.join(catalogue.select(key(F.col("full_name")).alias("_k")).distinct(), key(F.col("full_name")) == F.col("_k"), "left_semi")
