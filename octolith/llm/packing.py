"""Best-fit packing of tokenised documents into sequences of bounded length, in bulk-synchronous rounds.

Documents and gaps stand sorted by length, as classes: pieces of one length, sequences with one gap. In a round every
unplaced length looks at once for its successor, the smallest gap that holds it (a sweep over both sorted lists); of the
pieces that want the same gap, rank decides (longer ones first, then by their place), the others try again in the next
round; the gaps are updated, and the next round follows. A length that no gap holds opens sequences, the longest first.
Lengths above half the capacity open theirs to begin with; then lengths take part by halves (those above a quarter, an
eighth and so on), so short pieces fill what is left of the gaps of long ones.

A class is a row of at most `capacity` rows, so the sweeps run over two arrays of bounded size, which the driver holds
whatever the number of pieces; a round moves whole ranges of ranks, and the plan is a list of ranges (length, ranks from
.. to) -> (sequences from .., offset). Ranks are given and looked up on the executors, where the pieces stay.

Cases: a null text is an empty one: its only token is the end mark. Repeated rows are packed each. Null doc_id:
as any other. An empty table gives no rows. Other columns are ignored. Any vocabulary in the tokenizers format will do.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from octolith.llm.common import text_slices, texts_only, written

CAPACITY, END = 4096, 1
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local long"
OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Words, and pre-tokens of words, whose ids a worker remembers; beyond, it forgets them and starts anew.
REMEMBERED = 500_000


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: The tokenizer for which `Ids` knows the pre-tokens itself: how it normalises, splits and ends words.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    A vocabulary whose tokenizer isn't KNOWN gets every text whole. No pre-token of the known one spans white space, so the ids of a text of ASCII and Latin-1
    letters are those of its words, which are remembered; a new word is cut into pre-tokens here and only the
    merges are left to the tokenizer. Any other text goes to the tokenizer whole.
    """

    #: Characters (in Latin-1) for which normalising is lower-casing and every pre-token is as in PRE.
    PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
    PRE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        config = json.loads(self.tokenizer.to_str())
        self.quick = all(config[k] == v for k, v in KNOWN.items()) and config["model"]["type"] == "BPE" and all(a["content"].startswith("<|") for a in config["added_tokens"])
        self.known: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}
        # A byte is a printable character to the merges: itself, or 256 and up by turn.
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in own]
        self.shown = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def plain(self, text: str) -> bool:
        try:
            return not text.encode("latin-1").translate(None, self.PLAIN) and "<|" not in text
        except UnicodeEncodeError:
            return False

    def token(self, pre: str) -> bytes:
        ids = self.tokens.get(pre)
        if ids is None:
            shown = pre.encode().decode("latin-1").translate(self.shown)
            ids = self.tokens[pre] = b"".join(t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(shown))
        return ids

    def of(self, text: str) -> bytes:
        if not self.quick or not self.plain(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.lower().split()
        if len(self.known) > REMEMBERED:
            self.known = {}
        if len(self.tokens) > REMEMBERED:
            self.tokens = {}
        for w in set(words).difference(self.known):
            self.known[w] = b"".join(map(self.token, self.PRE.findall(w)))
        return b"".join(map(self.known.__getitem__, words))


def _sweep(lengths: np.ndarray, left: np.ndarray, gaps: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One matching of lengths (longest first) with gaps (smallest first): each length's successor, and how many get it.

    Of the lengths with one successor the longer ones come first, as long as there are sequences with that gap.
    """
    to = np.searchsorted(gaps, lengths)
    before = np.cumsum(left) - left
    first = np.r_[True, to[1:] != to[:-1]]
    before -= np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(to)]))
    there = np.where(to < len(gaps), free[np.minimum(to, len(gaps) - 1)] if len(gaps) else 0, 0)
    return to, np.clip(there - before, 0, left)


def best_fit(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Ranges (length, first rank, pieces, first sequence, offset) that place all pieces."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges of sequences (first, number)
    free = np.zeros(capacity + 1, np.int64)  # sequences by gap
    left = np.zeros(capacity + 1, np.int64)
    left[list(lengths)] = list(lengths.values())
    rank = np.zeros(capacity + 1, np.int64)
    plan, sequences = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if gap:
            gaps.setdefault(gap, []).append((first, n))
            free[gap] += n

    def place(length: int, n: int, gap: int) -> list[tuple[int, int, int]]:
        """n pieces into sequences with that gap; the gaps that come of it."""
        made = []
        while n:
            first, have = gaps[gap].pop()
            take = min(n, have)
            if have > take:
                gaps[gap].append((first + take, have - take))
            free[gap] -= take
            plan.append((length, int(rank[length]), take, first, capacity - gap))
            made.append((gap - length, first, take))
            rank[length] += take
            left[length] -= take
            n -= take
        return made

    bound = capacity  # lengths above half of it take part
    while left.any():
        while True:
            live = np.flatnonzero(left[bound // 2 + 1 :])[::-1] + bound // 2 + 1
            if not len(live):
                break
            have = np.flatnonzero(free)
            to, take = _sweep(live, left[live], have, free[have])
            made = []
            for i in np.flatnonzero(take):
                made += place(int(live[i]), int(take[i]), int(have[to[i]]))
            for x in made:
                put(*x)
            # Without a gap: all of the lengths that need sequences of their own, or else the longest.
            for length in live[to == len(have)].tolist()[: None if bound == capacity else 1]:
                n = -(-int(left[length]) // (capacity // length))
                put(capacity, sequences, n)
                sequences += n
                for x in place(length, min(n, int(left[length])), capacity):
                    put(*x)
        bound //= 2
    return plan


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Each document's pieces, with their place among those of the same length in their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, task = Ids(path), TaskContext.get().partitionId()
        end = np.array([END], "<u4").tobytes()
        met: dict[int, int] = {}
        for b in batches:
            for row, stop, texts in text_slices(b):
                rows = []
                for k, text in enumerate(texts.to_pylist(), row):
                    x = ids.of(text) + end
                    for p, at in enumerate(range(0, len(x), 4 * capacity)):
                        part = x[at : at + 4 * capacity]
                        n = len(part) // 4
                        met[n] = met.get(n, -1) + 1
                        rows.append((k, p, at // 4, n, zlib.crc32(part), met[n]))
                k, p, at, n, crc, local = (np.array(c, np.int64) for c in zip(*rows))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(k)), pa.array(p.astype(np.int32)), pa.array(at), pa.array(n), pa.array(crc), pa.array(np.full(len(k), task, np.int32)), pa.array(local)], names=[c.split()[0] for c in PIECE.split(", ")])

    return texts_only(docs).mapInArrow(run, PIECE)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = written(pieces(docs, path, capacity), "pieces")
    counts = written(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {int(r.length): int(r.n) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    plan = sorted(best_fit(histogram, capacity))
    table = docs.sparkSession.sparkContext.broadcast(np.array(plan, np.int64).reshape(-1, 5))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, _, first, offset = table.value.T
        key = (length << 48) | rank
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column(6).to_numpy(zero_copy_only=False) + b.column(5).to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, (b.column(3).to_numpy(zero_copy_only=False) << 48) | own, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(first[at] + own - rank[at]), pa.array(offset[at])], names=[c.split()[0] for c in OUT.split(", ")])

    return cut.join(base.hint("merge"), ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "local", "base").mapInArrow(place, OUT)
