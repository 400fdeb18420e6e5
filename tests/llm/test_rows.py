"""Stages of the pipeline on rows with null and repeated doc_ids: each row stays or goes by itself."""

from octolith.llm import decontaminate


def text(name, k=60):
    return " ".join(f"{name}{i}" for i in range(k))


LEAK = text("leak", 12)
STAY = [
    *((i, text(f"plain{i}x"), "en") for i in range(20, 27)),
    (None, text("clean"), None), (None, text("second"), None), (5, text("five"), None), (5, "one equal copy", None), (9, "twice the same row", None),
    (7, text("seven"), None), (3, text("near"), None), (4, text("mixed"), None), (None, text("nameless"), None), (None, "equal without a number", None),
]
GO = {
    "language": [(None, None, None), (None, "123", None), (5, "456", None)],
    "exact dedup": [(None, "one equal copy", None), (9, "twice the same row", None), (None, "equal without a number", None), (None, "equal without a number", None)],
    "near dedup": [(3, text("near") + " more", None), (None, text("mixed") + " more", None), (None, text("nameless") + " more", None)],
    "decontamination": [(None, LEAK, None), (7, "then " + LEAK, None)],
}


def test_stages_judge_each_row(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([(1, LEAK)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    some = lambda rows: sorted(((d, t) for d, t, _ in rows), key=str)
    for name, stage in p.STAGES[:-1]:
        path = str(tmp_path / name)
        spark.createDataFrame([*GO[name], *STAY] if name != "near dedup" else [*STAY, *GO[name]], "doc_id long, text string, lang string").coalesce(1).write.parquet(path)
        left = stage(spark, spark.read.parquet(path), str(tmp_path))
        assert left.columns == ["doc_id", "text", "lang"]
        assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == some(STAY), name
