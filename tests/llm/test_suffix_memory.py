"""What a task of the suffix dedup holds at once doesn't grow with what it reads."""

import tracemalloc

import numpy as np
import pyarrow as pa

from octolith.llm import suffix_dedup


def test_pieces_held_at_once():
    rng = np.random.default_rng(10)

    def batches():
        for k in range(40):
            texts = [rng.integers(97, 123, 10_000, np.uint8).tobytes().decode() for _ in range(100)]
            ids = pa.array(np.arange(100 * k, 100 * k + 100))
            yield pa.RecordBatch.from_arrays([ids, pa.array(texts), ids], names=["doc", "text", "place"])

    tracemalloc.start()
    try:
        sent = [(b.num_rows, b.nbytes) for b in suffix_dedup._cut(100, 8)(batches())]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(size for _, size in sent) > 15e6
    assert peak < 60e6
