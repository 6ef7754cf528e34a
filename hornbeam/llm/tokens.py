"""Token counts of a SentencePiece BPE model by merging with a heap and a linked list; no identifiers are made.

The text gets one leading word mark, and each space becomes a word mark. Initial symbols are characters; a character
outside the vocabulary never merges and counts as its UTF-8 bytes (byte fallback). The lowest-rank adjacent pair is
popped again and again, the leftmost of equals, and each merge takes one from the count. No piece of the vocabulary
has a word mark after another character, which is checked on loading, so merging never crosses the start of a run of
marks: a text is counted unit by unit, and units' counts are remembered in a table of bounded size that is emptied
when full. Memory beside the table is that of the longest unit.

Defined results: null and empty texts have no tokens; repeated rows and null ids each give their own row; an empty table
gives an empty result; extra columns are left out. A model with pieces of users or unused ones is refused.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornbeam.llm.common import in_arrow

MARK = "▁"
#: Fixed values of the format: types of pieces.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Units whose counts a worker remembers.
REMEMBERED = 400_000
LIMIT = 4096


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCounter:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not model.trainer_spec.byte_fallback:
            raise ValueError("this counter is for BPE models with byte fallback, a leading mark and no normalization")
        normal = [p for p in model.pieces if p.type == NORMAL]
        if any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in model.pieces):
            raise ValueError("a piece is one of a user's or unused")
        if any(MARK in p.piece.lstrip(MARK) for p in normal):
            raise ValueError("a piece has a word mark after another character")
        scores = {s: k for k, s in enumerate(sorted({p.score for p in normal}, reverse=True))}
        self.rank = {p.piece: scores[p.score] for p in normal}
        merging = {c for p in self.rank if len(p) > 1 for c in p}
        alone = "".join(c for c in map(chr, range(128)) if c not in merging)  # these never merge and end a unit
        self.unit = re.compile(f"{MARK}*[^{MARK}{re.escape(alone)}]+|{MARK}+|[{re.escape(alone)}]" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.seen: dict[str, int] = {}

    def count_unit(self, unit: str) -> int:
        rank = self.rank.get
        symbols: list[str | None] = list(unit)
        n = count = len(symbols)
        for c in symbols:
            if c not in self.rank:
                count += len(c.encode("utf-8", "surrogatepass")) - 1
        heap = [(r, i, pair) for i in range(n - 1) if (r := rank(pair := unit[i : i + 2])) is not None]
        if not heap:
            return count
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, pair = pop(heap)
            left = symbols[i]
            if left is None or (j := after[i]) >= n or left + symbols[j] != pair:
                continue  # one of its symbols has merged since
            symbols[i], symbols[j] = pair, None
            count -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(new := pair + symbols[k])) is not None:
                    push(heap, (r, i, new))
            if (h := before[i]) >= 0 and (r := rank(new := symbols[h] + pair)) is not None:
                push(heap, (r, h, new))
        return count

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        seen, total = self.seen, 0
        for unit in self.unit.findall(MARK + text.replace(" ", MARK)):
            n = seen.get(unit)
            if n is None:
                n = self.count_unit(unit)
                if len(seen) >= REMEMBERED:
                    seen.clear()
                if len(unit) <= 64:
                    seen[unit] = n
            total += n
        return total


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text; path: the model's file on the executors."""
    path = path or tokenizer_path()

    def work(batches):
        counter = PieceCounter(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([counter.count(t) for t in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(docs[text_col].cast("string")), F.lit(0)).cast("long")
    found = docs.select(docs[id_col].cast("long"), docs[text_col].cast("string"), size).transform(in_arrow, work, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
