"""Byte-level BPE encoding by batched numpy merge rounds, and decoding.

A text is cut at the strings of added tokens, then into words (the pattern below), and each word starts as the symbols of
its bytes. The distinct words of a batch stand side by side in one flat array. A round looks up all adjacent pairs of a
word by binary search over the sorted pair keys, takes the lowest rank of each word and merges that pair wherever the word
has it, from the left; words without a pair leave the array. A pair's parts are always older than the pair, which is
checked on loading, so a merge makes later pairs only and a round may merge all places of a pair at once. Words of over
LONG symbols are merged rank by rank instead of round by round, with the places of each rank kept apart, so that a word
of millions of characters costs no more than its merges. A worker remembers the tokens of the words that it has seen, up
to a bound.

Decoding puts the bytes of all tokens together; what is no UTF-8 becomes U+FFFD, ids that the model does not have are
left out.

Defined results: null and empty texts have no tokens, and no tokens are the empty text (null for null ids in decode());
repeated rows and null document ids each give their own row; an empty table gives an empty result; extra columns are left
out, whatever their names. A text is cut for reading at single spaces between other characters only, which are always the
start of a word, so the whole text counts. A model with other steps than these is refused.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornbeam.llm.common import bounds, in_arrow
from hornbeam.llm.tokens import tokenizer_path

#: Code points that became letters and numbers after version 16 of Unicode, which the library's classes are of.
LATER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 "
    "16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED "
    "1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: No text whose bytes are all smaller has one of them.
LEAD = 0xD5
#: Fixed value: the words of a text, by its letters and numbers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{l}{n}]+|\s+(?!\S)|\s+"
NONE = np.iinfo(np.int32).max
#: Words of more symbols are merged by rank. Words that a worker remembers, and symbols of all of them together.
LONG, REMEMBERED, SYMBOLS = 256, 300_000, 4_000_000
#: Characters of a text that are cut into words at a time, tokens that are decoded at a time.
CHUNK, TOKENS = 1 << 20, 1 << 16
_BREAK = re.compile(r"(?<=\S) (?=\S)")


def _ranges(text: str) -> str:
    return "".join("-".join(re.escape(chr(int(x, 16))) for x in r.split("-")) for r in text.split())


def byte_characters() -> list[str]:
    """The character that stands for each byte in a vocabulary: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = itertools.count(0x100)
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Stretches of flat one after another."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


class ByteBPE:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before, after, added = spec["model"], spec["pre_tokenizer"] or {}, spec["decoder"] or {}, spec["added_tokens"]
        odd = [spec["normalizer"], before.get("add_prefix_space", True), not before.get("use_regex"), model.get("dropout"), model.get("unk_token"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"), model.get("byte_fallback"), model.get("ignore_merges")]
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or after.get("type") != "ByteLevel" or any(odd) or any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("this codec is for byte-level BPE without normalization, affixes and prefix space")
        vocab, chars = model["vocab"], byte_characters()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = {c: -1 for c in chars}
        for r, (a, b) in enumerate(pairs):
            if a not in made or b not in made or a + b in made:
                raise ValueError("a pair is older than its parts, or makes what another makes")
            made[a + b] = r
        size = max([*vocab.values(), *(a["id"] for a in added)]) + 1
        self.base = np.array([vocab[c] for c in chars], np.int32)
        self.left, self.right, self.made = (np.array([vocab[x] for x in side], np.int32) for side in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        keys = self.left.astype(np.int64) * size + self.right
        self.order = np.argsort(keys).astype(np.int32)
        self.size, self.keys = size, keys[self.order]
        self.added = {a["content"]: a["id"] for a in added}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        of = {c: k for k, c in enumerate(chars)}
        spelled = [b""] * size
        for token, i in [*vocab.items(), *self.added.items()]:
            spelled[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        self.spelled = self._table(spelled)
        self.decimal = self._table([f"{i},".encode() for i in range(size)])
        self.later = re.compile(f"[{_ranges(LATER)}]")
        self.words = regex.compile(PATTERN.format(L=r"\p{L}", N=r"\p{N}", l=r"\p{L}", n=r"\p{N}"))
        now = f"[{_ranges(LATER)}]"
        self.words_as_then = regex.compile("(?V1)" + PATTERN.replace(r"[^\s{l}{n}]", rf"(?:[^\s\p{{L}}\p{{N}}]|{now})").format(L=rf"[\p{{L}}--{now}]", N=rf"[\p{{N}}--{now}]"))
        self.forget()

    @staticmethod
    def _table(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(t) for t in texts], np.int64)
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths, lengths

    def forget(self) -> None:
        self.seen: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where there is none."""
        if not len(self.keys):
            return np.full(len(left), NONE, np.int32)
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE)

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of many words, numbered in order, side by side -> their tokens, and the word of each."""
        done = []
        while len(symbols):
            rank = np.full(len(symbols), NONE, np.int32)
            rank[:-1] = np.where(word[1:] == word[:-1], self._rank(symbols[:-1], symbols[1:]), NONE)
            at = bounds(word)
            low = np.repeat(np.minimum.reduceat(rank, at[:-1]), np.diff(at))
            live = low != NONE
            if not live.all():
                done.append((symbols[~live], word[~live]))
                symbols, word, rank, low = symbols[live], word[live], rank[live], low[live]
            if not len(symbols):
                break
            p = np.flatnonzero(rank == low)
            p = p[self._every_other(np.diff(p) == 1)]
            symbols[p] = self.made[rank[p]]
            symbols, word = np.delete(symbols, p + 1), np.delete(word, p + 1)
        if not done:
            return symbols, word
        symbols, word = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    @staticmethod
    def _every_other(follows: np.ndarray) -> np.ndarray:
        """Of places of which each may overlap the one before it (follows), those that are merged from the left."""
        begins = np.concatenate(([True], ~follows))
        k = np.arange(len(begins))
        return (k - np.maximum.accumulate(np.where(begins, k, 0))) % 2 == 0

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The tokens of one word, rank by rank: places of each rank wait together until theirs is the lowest."""
        n = len(symbols)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(p: np.ndarray) -> None:
            p = p[(p >= 0) & (after[p] < n)]
            rank = self._rank(symbols[p], symbols[after[p]])
            some = np.argsort(rank, kind="stable")
            rank, p = rank[some], p[some]
            at = bounds(rank)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                if (r := int(rank[a])) != NONE:
                    if r not in waiting:
                        waiting[r] = []
                        heapq.heappush(heap, r)
                    waiting[r].append(p[a:b])

        wait(np.arange(n - 1))
        while heap:
            r = heapq.heappop(heap)
            p = np.unique(np.concatenate(waiting.pop(r)))
            p = p[alive[p] & (after[p] < n)]
            p = p[(symbols[p] == self.left[r]) & (symbols[after[p]] == self.right[r])]
            if not len(p):
                continue
            p = p[self._every_other(after[p[:-1]] == p[1:])]
            q = after[p]
            symbols[p], alive[q], after[p] = self.made[r], False, after[q]
            inside = after[p] < n
            before[after[p[inside]]] = p[inside]
            wait(np.unique(np.concatenate((p, before[p]))))
        return symbols[alive]

    def _tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words side by side, and how many each has."""
        raws = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(r) for r in raws], np.int64)
        symbols, number = self.base[np.frombuffer(b"".join(raws), np.uint8)], np.repeat(np.arange(len(words)), sizes)
        long = np.flatnonzero(sizes > LONG)
        short = ~np.isin(number, long) if len(long) else np.ones(len(number), bool)
        parts = [self.merge(symbols[short], number[short])]
        ends = np.cumsum(sizes)
        for k in long.tolist():
            got = self.merge_long(symbols[ends[k] - sizes[k] : ends[k]].copy())
            parts.append((got, np.full(len(got), k)))
        ids, number = (np.concatenate(x) for x in zip(*parts))
        if len(long):
            order = np.argsort(number, kind="stable")
            ids, number = ids[order], number[order]
        return ids, np.bincount(number, minlength=len(words))

    def _words(self, text: str) -> Iterator[list[str]]:
        """The words of a stretch without added tokens, those of about CHUNK characters at a time."""
        high = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).max()
        cut = (self.words_as_then if high >= LEAD and self.later.search(text) else self.words).findall
        at = 0
        while len(text) - at > CHUNK:
            m = _BREAK.search(text, at + CHUNK)
            end = m.start() if m else len(text)
            yield cut(text[at:end])
            at = end
        yield cut(text[at:] if at else text)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts side by side, and how many each has."""
        if len(self.seen) > REMEMBERED or len(self.ids) > SYMBOLS:
            self.forget()
        seen, old, lists, n_words = self.seen, len(self.seen), [], []
        for text in texts:
            n = 0
            for k, part in enumerate(self.special.split(text or "") if self.special else [text or ""]):
                if k % 2:
                    lists.append(np.array([-1 - self.added[part]], np.int64))
                    n += 1
                    continue
                for words in self._words(part) if part else ():
                    lists.append(np.fromiter(map(seen.__getitem__, words), np.int64, len(words)))
                    n += len(words)
            n_words.append(n)
        new = list(itertools.islice(seen, old, None))
        if new:
            ids, lengths = self._tokens(new)
            self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(lengths) - lengths))
            self.ids, self.lengths = np.concatenate((self.ids, ids)), np.concatenate((self.lengths, lengths))
        word = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        # added tokens stand behind the words' for the moment
        pool = np.concatenate((self.ids, np.arange(self.size, dtype=np.int32)))
        special = word < 0
        starts, lengths = np.empty(len(word), np.int64), np.ones(len(word), np.int64)
        starts[special], starts[~special] = len(self.ids) - 1 - word[special], self.starts[word[~special]]
        lengths[~special] = self.lengths[word[~special]]
        upto = np.concatenate(([0], np.cumsum(lengths)))
        edges = np.concatenate(([0], np.cumsum(n_words, dtype=np.int64)))
        return gather(pool, starts, lengths), np.diff(upto[edges])

    def _spell(self, table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> bytes:
        flat, starts, lengths = table
        return b"".join(gather(flat, starts[ids[at : at + TOKENS]], lengths[ids[at : at + TOKENS]]).tobytes() for at in range(0, len(ids), TOKENS))

    def decode(self, ids: np.ndarray) -> str:
        return self._spell(self.spelled, ids[(ids >= 0) & (ids < self.size)]).decode("utf-8", "replace")

    def listed(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return self._spell(self.decimal, ids)[:-1]


@lru_cache(maxsize=2)
def codec(path: str) -> ByteBPE:
    """One for each worker: it lives on beside the tasks."""
    return ByteBPE(path)


def model_path() -> str:
    return tokenizer_path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every whole text; path: the model's file on the executors."""
    path = path or model_path()

    def work(batches):
        own = codec(path)
        for b in batches:
            ids, n = own.encode(b.column(1).to_pylist())
            ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).transform(in_arrow, work, "doc_id long, ids array<int>")


def _lists(column: pa.Array) -> Iterator[np.ndarray | None]:
    for k in range(len(column)):
        one = column[k]
        yield None if not one.is_valid else one.values.drop_null().to_numpy(zero_copy_only=False)


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    path = path or model_path()

    def work(batches):
        own = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if i is None else own.decode(i) for i in _lists(b.column(1))], pa.string())], ["doc_id", "text"])

    return encoded.select(encoded[id_col].cast("long"), encoded[ids_col].cast("array<int>")).transform(in_arrow, work, "doc_id long, text string")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """DIGESTS of (doc_id, ids): of the ids in decimal, joined by commas, and of the text that they decode to."""
    path = path or model_path()

    def work(batches):
        own = codec(path)
        for b in batches:
            rows = [(len(i), hashlib.sha256(own.listed(i)).hexdigest(), hashlib.sha256(own.decode(i).encode()).hexdigest()) for i in _lists(b.column(1))]
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").transform(in_arrow, work, DIGESTS)
