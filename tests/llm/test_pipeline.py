"""The pipeline's stages on a small table: what each keeps, drops and returns."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(0)
    text = lambda: "\n".join(" ".join(f"w{rng.randrange(5000)}" for _ in range(20)) for _ in range(4))
    good = [text() for _ in range(60)]
    bad = [" ".join(f"w{rng.randrange(5000)}$$$" for _ in range(80)) for _ in range(40)]
    shared = " ".join(f"s{k}" for k in range(60))
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(200, good[0]), (201, text() + "\n" + shared), (202, text() + "\nlead " + shared + " tail " + text().replace("\n", " ")), (203, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(100)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram join", "substring dedup", "packing"]
    at, held = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        at = spark.read.parquet(str(tmp_path / f"out{k}"))
        held.append(at)
        if k < 4:
            assert at.columns == docs.columns
            assert at.filter("n_chars <> char_length(text)").count() == 0
    kept = {r["doc_id"] for r in held[0].collect()}
    assert set(range(60)) <= kept and not kept & set(range(60, 100)) and {200, 201, 202} <= kept
    lines = {r["doc_id"]: r["text"] for r in held[1].collect()}
    assert lines[200] == "" and lines[0] == good[0]
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, held[0], str(tmp_path)).collect()} == kept - {200}
    passages = {r["doc_id"]: r["text"] for r in held[3].collect()}
    assert "s30" in passages[201] and "s30" not in passages[202] and "tail" in passages[202]
    assert held[4].select("doc_id").distinct().count() == len(passages)
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["ids_crc32"] for r in run.collect()) == sorted(r["ids_crc32"] for r in held[4].collect())


def test_near_duplicates_keep_one_row_of_each_group(spark, tmp_path):
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(80))
    a, b, c, d = (text() for _ in range(4))
    rows = [(5, a), (5, b), (3, a + " more"), (7, c), (7, c), (None, c), (None, d), (None, d), (9, ""), (9, ""), (None, None), (8, " ")]
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    want = [(5, b), (3, a + " more"), (7, c), (None, d), (9, ""), (9, ""), (None, None), (8, " ")]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), str(tmp_path)).count() == 0
