"""Language ID: prediction by partial matching over bytes.

For each language a tree of byte contexts of up to three bytes is counted. A byte costs -log2 of its share in
the longest context that has seen it, plus the escapes from the longer ones (method C: a context with D
distinct successors of T escapes with D / (T + D)); a byte that no context has seen, not even the empty one, one in as
many as there are symbols. The statistics are frozen after training. The trees of all languages are kept as one, whose
nodes are the byte strings that some language has seen, each with its cost and its escape under every language, so a
byte is looked up once for all of them and the tree is as large as what was seen. A text's exact code length under each
language is the sum of its bytes' costs; the shortest wins.

Training reads at most `per_language` whole documents of each language, and no more of them than `bytes_per_language`
holds (a bounded sample of labelled rows, chosen by a hash of doc_id); every document is scored over its whole text.

Cases: a null text, or one without a letter, is `und` with score 0, as is every text if nothing is learned.
Ties go to the smallest language name. Repeated documents are reported each. Null doc_id: not held out and not
learned from. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from octolith.llm.common import raw, text_slices, texts_only

ORDER = 3
OUT = "doc_id long, held_out boolean, lang_pred string, score double"
_LETTER = regex.compile(r"\p{L}")


class Model:
    """languages; symbol of each byte (0 stands before a text, the last for bytes that training never saw); and by order k
    of contexts the tree's nodes: grams[k], numbers of k + 1 symbols in base `symbols`, with the cost of the last after the
    others; contexts[k] with the cost of an escape (0 in languages that haven't seen it)."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.languages = sorted(texts)
        seen = sorted({b for ts in texts.values() for t in ts for b in set(t)})
        self.symbols = a = len(seen) + 2
        self.symbol = np.full(256, a - 1, np.int64)
        self.symbol[seen] = np.arange(1, a - 1)
        self.grams, self.costs, self.contexts, self.escapes = [], [], [], []
        every = [self._numbers(texts[x]) for x in self.languages]
        for k in range(ORDER + 1):
            at = [x % a ** (k + 1) for x in every]
            codes = np.unique(np.concatenate([np.zeros(0, np.int64), *at]))
            contexts = np.unique(codes // a)
            escape = np.zeros((len(contexts), len(at)), np.float32)
            counts = []
            for i, x in enumerate(at):
                gram, n = np.unique(x, return_counts=True)
                where = np.searchsorted(contexts, gram // a)
                total, distinct = np.bincount(where, n, len(contexts)), np.bincount(where, minlength=len(contexts))
                have = distinct > 0
                escape[have, i] = -np.log2(distinct[have] / (total + distinct)[have])
                counts.append((np.searchsorted(codes, gram), -np.log2(n / (total + distinct)[where])))
            cost = escape[np.searchsorted(contexts, codes // a)] + self._cost(codes, k - 1)
            for i, (row, bits) in enumerate(counts):
                cost[row, i] = bits
            self.grams.append(codes)
            self.costs.append(cost)
            self.contexts.append(contexts)
            self.escapes.append(escape)

    def _numbers(self, texts: list[bytes]) -> np.ndarray:
        """Each byte with the three before it, as numbers."""
        a = self.symbols
        out = [np.zeros(0, np.int64)]
        for t in texts:
            s = np.concatenate([np.zeros(ORDER, np.int64), self.symbol[np.frombuffer(t, np.uint8)]])
            out.append(((s[:-3] * a + s[1:-2]) * a + s[2:-1]) * a + s[3:])
        return np.concatenate(out)

    def _cost(self, numbers: np.ndarray, order: int) -> np.ndarray:
        """The cost, in each language, of the last symbol of each number after as many as `order` before it."""
        a = self.symbols
        out = np.zeros((len(numbers), len(self.languages)), np.float32)
        todo = np.arange(len(numbers))
        for k in range(order, -1, -1):
            x = numbers[todo] % a ** (k + 1)
            at = np.minimum(np.searchsorted(self.grams[k], x), max(len(self.grams[k]) - 1, 0))
            hit = self.grams[k][at] == x if len(self.grams[k]) else np.zeros(len(x), bool)
            out[todo[hit]] += self.costs[k][at[hit]]
            todo, x = todo[~hit], x[~hit] // a
            if len(todo) and len(self.contexts[k]):
                at = np.minimum(np.searchsorted(self.contexts[k], x), len(self.contexts[k]) - 1)
                hit = self.contexts[k][at] == x
                out[todo[hit]] += self.escapes[k][at[hit]]
        out[todo] += np.float32(np.log2(a))
        return out

    def code_lengths(self, texts: pa.Array) -> np.ndarray:
        """Bits of each text under each language."""
        data, at = raw(texts)
        docs, a = len(texts), self.symbols
        s = np.zeros(len(data) + ORDER * docs, np.int64)
        place = np.arange(len(data)) + ORDER * np.repeat(np.arange(1, docs + 1), np.diff(at))
        s[place] = self.symbol[data]
        numbers = ((s[place - 3] * a + s[place - 2]) * a + s[place - 1]) * a + s[place]
        out = np.zeros((docs, len(self.languages)))
        full = np.flatnonzero(np.diff(at))
        if len(full) and self.languages:
            out[full] = np.add.reduceat(self._cost(numbers, ORDER), at[:-1][full], dtype=np.float64)
        return out


def train(docs: DataFrame, per_language: int = 200, bytes_per_language: int = 4_000_000) -> Model:
    """A model of the documents whose crc32(doc_id as text) mod 3 is not 1 and whose lang isn't null."""
    rows = texts_only(docs, "lang").where(F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    rows = rows.withColumn("u", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))).withColumn("size", F.octet_length("text").cast("long")).where(F.col("size") <= bytes_per_language)
    counts = rows.groupBy("lang").count().collect()
    keep = F.lit(False)
    for lang, n in counts:  # a hash keeps about three times what is needed, then the window is small
        keep = F.when(F.col("lang") == lang, F.col("u") < int(min(1.0, (3 * per_language + 50) / n) * (1 << 20)) + 1).otherwise(keep)
    order = Window.partitionBy("lang").orderBy("u", "doc_id")
    chosen = rows.where(keep).withColumn("i", F.row_number().over(order)).where(F.col("i") <= per_language)
    chosen = chosen.withColumn("so_far", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("so_far") <= bytes_per_language)
    texts: dict[str, list[bytes]] = {}
    for r in chosen.orderBy("lang", "i").select("lang", "text").collect():
        texts.setdefault(r.lang, []).append(r.text.encode())
    return Model(texts)


def language_id(docs: DataFrame, per_language: int = 200, learn: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (the winner's share of 2**-bits, from 0 to 1).

    The model is trained on `learn`, by default on docs.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs if learn is None else learn, per_language))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        names = np.array([*m.languages, "und"], object)
        for b in batches:
            for row, end, texts in text_slices(b):
                known = np.array([bool(m.languages) and bool(_LETTER.search(t)) for t in texts.to_pylist()], bool)
                best, score = np.full(len(known), len(m.languages)), np.zeros(len(known))
                if known.any():
                    bits = m.code_lengths(texts)
                    win = bits.argmin(1)
                    share = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
                    best[known], score[known] = win[known], share[known]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, end - row), b.column(2).slice(row, end - row), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return texts_only(docs).withColumn("held_out", held).mapInArrow(run, OUT)
