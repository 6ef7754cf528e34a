"""URL rules as globs, run together by one bit-parallel Shift-And automaton over each canonical URL.

Canonical form: a dot, the host in lower case, the path. A rule (host, path) becomes the glob `*.host` + path + `**`:
`*` is any run without a slash, so that it stays in the host, and `**` is any run. Each literal byte of each glob is
one bit of a state that spans as many 64-bit words as needed; a byte of the URL shifts the whole state once, masks it
by that byte's word row and keeps the bits that loop on it. Null URLs and URLs without `://` have an empty host and
path and fit no rule; so does a URL with an empty path. Among rules that fit the longest wins, then the first. Work
grows with the bytes of URLs times the words of the state; a very long URL costs its own length only. Repeated rows and
null ids each give their own row; an empty table gives an empty result; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hornbeam.llm.common import in_arrow

#: (verdict, host, path): the rules of op8.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
DEFAULT = "allow"
_SPLIT = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path, empty where there are none."""
    m = _SPLIT.search(url or "")
    return (m[1].translate(_TO_LOWER), m[2]) if m else ("", "")


_TO_LOWER = {c: c + 32 for c in range(65, 91)}


class GlobSet:
    """Globs over bytes: `*` any run without `/`, `**` any run, `?` one byte but `/`, a backslash before a literal."""

    def __init__(self, globs: list[bytes]):
        bits: list[list] = []  # for each state: the bytes that enter it, the bytes it loops on
        self.first, last = [], []
        for g in globs:
            self.first.append(len(bits))
            bits.append([np.zeros(256, bool), np.zeros(256, bool)])
            at = 0
            while at < len(g):
                c = g[at : at + 1]
                if c == b"*":
                    wide = g[at + 1 : at + 2] == b"*"
                    loop = np.ones(256, bool)
                    loop[ord("/")] = wide
                    bits[-1][1] |= loop
                    at += 1 + wide
                    continue
                enter = np.zeros(256, bool)
                if c == b"?":
                    enter[:] = True
                    enter[ord("/")] = False
                else:
                    at += c == b"\\"
                    enter[g[at]] = True
                bits.append([enter, np.zeros(256, bool)])
                at += 1
            last.append(len(bits) - 1)
        self.words = max(1, -(-len(bits) // 64))
        self.enter, self.loop = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        for k, (enter, loop) in enumerate(bits):
            one = np.uint64(1 << (k % 64))
            self.enter[enter, k // 64] |= one
            self.loop[loop, k // 64] |= one
        self.start = np.zeros(self.words, np.uint64)
        for k in self.first:
            self.start[k // 64] |= np.uint64(1 << (k % 64))
        self.last = [(k // 64, np.uint64(1 << (k % 64))) for k in last]

    def match(self, texts: list[bytes], cells: int = 1 << 22) -> np.ndarray:
        """(texts, globs): which globs fit each whole text."""
        out = np.zeros((len(texts), len(self.last)), bool)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        at = 0
        while at < len(order):
            step = max(1, cells // max(1, len(texts[order[at]])))
            part = order[at : at + step]
            at += len(part)
            lengths = np.array([len(texts[i]) for i in part])
            width = int(lengths[0])
            chars = np.frombuffer(b"".join(texts[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
            state = np.repeat(self.start[None], len(part), 0)
            live = len(part)
            for p in range(width):
                while lengths[live - 1] <= p:
                    live -= 1
                d, c = state[:live], chars[:live, p]
                moved = d << np.uint64(1)
                moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
                state[:live] = (moved & self.enter[c]) | (d & self.loop[c])
            for k, (word, bit) in enumerate(self.last):
                out[part, k] = (state[:, word] & bit) != 0
        return out


def _glob(host: str, path: str) -> bytes:
    plain = lambda s: re.sub(rb"([*?\\])", rb"\\\1", s.encode())
    return b"*." + plain(host) + plain(path) + b"**"


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict): rule is the host and path of the rule that won, or null."""
    names = [h + p for _, h, p in rules]
    rank = np.array([(len(n) << 20) - k for k, n in enumerate(names)], np.int64)
    globs = [_glob(h, p) for _, h, p in rules]

    def work(batches):
        automaton = GlobSet(globs)
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            fits = automaton.match([f".{h}{p}".encode("utf-8", "surrogatepass") for h, p in parts])
            best = np.where(fits, rank, -1)
            won = best.argmax(1) if names else np.zeros(len(parts), int)
            some = fits.any(1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array([names[k] if s else None for k, s in zip(won, some)], pa.string()), pa.array([rules[k][0] if s else default for k, s in zip(won, some)], pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return pages.select(pages[id_col].cast("long"), pages[url_col].cast("string")).transform(in_arrow, work, "page_id long, host string, path string, rule string, verdict string")
