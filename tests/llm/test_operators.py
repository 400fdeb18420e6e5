"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import itertools

import numpy as np
import pytest

from octolith.llm import decontaminate, exact_dedup, jaccard, language, license_scan, packing, passages, pii, sharding, suffix_dedup
from octolith.llm.common import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, class string, label long"
LONG = " ".join(f"word{i}" for i in range(120))
NEAR = LONG.replace("word60", "other")
ROWS = [
    (1, "Alpha beta gamma", "en"), (2, None, "en"), (3, "", None), (4, "Alpha beta gamma", "en"), (4, "Alpha beta gamma", "en"),
    (None, "some text without a number", "fr"), (6, LONG, "en"), (7, NEAR, "en"), (8, "x " + LONG + " y z", None), (9, "123 456", "en"),
    (10, "Überall steht ein Haus mit Tür", "de"), (11, "a" * 5000, "en"), (12, LONG + " all rights reserved", "en"), (13, "a " * 300, "en"),
]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "docs")
    spark.createDataFrame([(d, t, l, "s", 1, 99, "c", 5) for d, t, l in ROWS], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "none")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bench(spark):
    return spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(30, 45))), (2, None), (3, "beta gamma"), (None, "x")], "item_id long, text string")


OPERATORS = {
    "exact": exact_dedup.exact_dedup, "language": language.language_id, "license": license_scan.license_scan, "pii": pii.find_pii,
    "decontaminate": lambda d: decontaminate.contamination(d, bench(d.sparkSession)), "jaccard": jaccard.jaccard_components,
    "sharding": sharding.shard, "packing": lambda d: packing.pack(d, tokenizer()), "passages": passages.repeated_passages, "suffix": suffix_dedup.remove_repeats,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(none, name):
    assert OPERATORS[name](none).count() == 0


def test_exact_dedup(docs):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id in (1, 4):
            assert (r.keep_id, r.group_size, r.kept) == (4, 3, r.doc_id == 4)
        if r.doc_id in (2, 3):
            assert (r.keep_id, r.group_size) == (3, 2) and r.text_sha256 == hashlib.sha256(b"").hexdigest()


def test_language(docs):
    got = {r.doc_id: r for r in language.language_id(docs).collect()}
    assert got[2].lang_pred == got[3].lang_pred == got[9].lang_pred == "und" and got[6].lang_pred != "und"


def test_license_and_expressions(docs):
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert (got[12].n_base, got[12].first_word, got[12].base_labels) == (1, 120, "reserved") and got[2].n_words == 0
    assert license_scan.evaluate(license_scan.postfix("GPL-3.0-only OR (MIT AND Apache-2.0)")) == "permissive"


def test_pii_spans():
    assert pii.base_spans("a@b@c.de 1.2.3.4 +1 (555) 123-4567")[:2] == [[(2, 8)], [(9, 16)]]


def test_decontamination_in_blocks(docs, spark):
    one = sorted(map(str, decontaminate.contamination(docs, bench(spark)).collect()))
    assert one == sorted(map(str, decontaminate.contamination(docs, bench(spark), block=2).collect()))
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench(spark)).collect()}
    assert (got[6].n_hit, got[4].n_hit, got[9].contaminated) == (15, 2, False)


def test_jaccard(docs):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    got = {r.doc_id: r for r in jaccard.jaccard_components(docs).collect()}
    assert all(got[d].n_shingles == len(shingles(t)) for d, t, _ in ROWS)
    assert got[7].component_id == got[8].component_id == got[12].component_id == 6 and got[4].component_id == 1
    assert (got[2].component_id, got[3].component_id) == (2, 3)


def test_signatures_meet_at_the_threshold():
    """Every pair of sets that links shares a signature, or both go the second way."""
    import numpy as np

    rng = np.random.default_rng(1)
    for size, _ in itertools.product((1, 3, 4, 7, 12, 30, 90, 400), range(40)):
        base = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        gone = int(rng.integers(0, size // 4 + 1))
        other = np.unique(np.concatenate([base[gone:], rng.integers(0, 2**63, size // 7 - gone // 2 if size // 7 > gone // 2 else 0, dtype=np.uint64)]))
        common = len(np.intersect1d(base, other))
        if len(other) and 100 * common >= 75 * (len(base) + len(other) - common):
            (a, spare_a), (b, spare_b) = jaccard.signatures(base), jaccard.signatures(other)
            assert set(a.tolist()) & set(b.tolist()) or spare_a < 0 and spare_b < 0
            assert spare_a == jaccard.spare(base)


def test_sharding(docs):
    got = sharding.shard(docs).collect()
    assert len({(r.shard, r.slot) for r in got}) == len(ROWS)
    assert len({r.shard for r in got if r.doc_id in (1, 4)}) == 1


def test_packing(docs):
    got = packing.pack(docs, tokenizer()).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 4096 and {r.length for r in got if r.doc_id in (2, 3)} == {1}


def test_passages(docs):
    assert {7, 8, 12} <= {r.doc_id for r in passages.repeated_passages(docs).collect()}


def test_compact_windows():
    rng = np.random.default_rng(5)
    for sizes in ((0,), (4,), (5,), (80,), (), (7, 3, 80, 5, 0, 41, 6)):
        first = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        h = rng.integers(0, 9, first[-1], dtype=np.uint64) << np.uint64(50)
        expected = set()
        for at, size in zip(first.tolist(), sizes):
            value = h[at : at + size].tolist()
            for c in range(size):
                low = next((i + 1 for i in range(c - 1, -1, -1) if value[i] <= value[c]), 0)
                high = next((i - 1 for i in range(c + 1, size) if value[i] < value[c]), size - 1)
                if high - low + 1 >= 5:
                    expected.add((at + low, at + c, at + high))
        assert set(zip(*(x.tolist() for x in passages.compact_windows(h, 5, first)))) == expected


def test_passages_chain_over_edits():
    x = np.arange(1, 201, dtype=np.uint64)
    y = np.r_[x[:80], np.array([900, 901], np.uint64), x[83:]]
    assert passages.grown(x, y, [(10, 10), (150, 149)], 46, 0.75) == [(0, 199, 0, 198, 197 / 202)]
    assert passages.grown(x, y[:40], [(10, 10)], 46, 0.75) == []


@pytest.mark.parametrize("collection", [2000, 2])
def test_suffix_dedup(spark, collection, monkeypatch):
    """With collections of 2, groups are split again until the whole window is known."""
    monkeypatch.setattr(suffix_dedup, "COLLECTION", collection)
    line = "the quick brown fox jumps over the lazy dog while seventeen patient herons watch from the quiet river bank at dusk. "
    more = [(100 + i, f"{'abcdefgh'[i % 8] * (i + 3)} {line[i % 3:]}{'zyxwvuts'[i % 8] * (2 * i + 1)}", "x") for i in range(12)] + [(200, "a" * 400, "x"), (201, "a" * 150, "x")]
    rows = ROWS + more
    docs = written(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), "docs")
    seen, want = set(), []
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        hit = [False] * len(b)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                hit[i : i + 100] = [True] * 100
            seen.add(b[i : i + 100])
        want.append((d, len(b), sum(hit), hashlib.sha256(bytes(c for c, h in zip(b, hit) if not h)).hexdigest()))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_collection_order():
    texts = [b"banana", b"", b"ananas", b"banana", b"n"]
    text, start = suffix_dedup.collection_order(texts)
    got = list(zip(text.tolist(), start.tolist()))
    assert got == sorted(((i, j) for i, t in enumerate(texts) for j in range(len(t))), key=lambda x: (texts[x[0]][x[1] :], x[0]))


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline as p

    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    left = docs
    for _, stage in p.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {None, 10, 11, 13}
    assert {r.doc_id for r in p.packed(spark, left, str(tmp_path)).collect()} == {None, 10, 11, 13}
