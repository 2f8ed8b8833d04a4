from test_ngram_join import brute

import corpus_pipeline
from quarry.llm import sentencepiece_lattice as sp
from quarry.llm.mixing import mix_sources


def test_stages_keep_columns_and_take_effect(documents, spark, tables):
    docs = documents
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, tables).collect(), None if name == "sentencepiece" else before.schema)
        sizes.append(docs.count())
        if name != "sentencepiece":
            assert docs.columns == before.columns
    assert sizes[1] <= sizes[0] and sizes[3] < sizes[2] and sizes[3] == sizes[4] == sizes[5]


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert out.columns == ["doc_id", "mix_place", "n_tokens", "ids"] and out.count() > 100


def test_run_equals_brute_force_in_the_order_of_the_mixture(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for stage in (corpus_pipeline.judge_quality, corpus_pipeline.identify_language):  # trained: taken as they are
        docs = spark.createDataFrame(stage(spark, docs, tables).collect(), docs.schema)
    rows = docs.collect()
    first = {doc_id for doc_id, _, least in brute(rows) if doc_id is not None and doc_id == least}
    left = spark.createDataFrame([r for r in rows if r.doc_id in first], docs.schema)
    order = sorted(mix_sources(left).collect(), key=lambda r: (r.mix_slot, r.mix_position))
    vocabulary, known = sp.Vocabulary.load(), {}
    want = []
    for place, r in enumerate(order):
        words = sp.words_of(r.text)
        known |= {w: sp.best_path(w, vocabulary) for w in words if w not in known}
        ids = [i for w in words for i in known[w]]
        want.append((r.doc_id, place, len(ids), ids))
    assert [tuple(r) for r in corpus_pipeline.run(spark, tables).collect()] == want


def test_encoding_keeps_the_order_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(sp, "BLOCK_DOCS", 16)
    docs = spark.createDataFrame([(i * 7919 % 1009, f"text {i}") for i in range(1009)], "doc_id long, text string").repartition(7).sortWithinPartitions("text")
    docs = corpus_pipeline.Scratch(spark, "test").keep(docs.orderBy("text", "doc_id"))
    want = [i * 7919 % 1009 for i in sorted(range(1009), key=lambda i: f"text {i}")]
    assert [r.doc_id for r in corpus_pipeline.encode_pieces(spark, docs, "").collect()] == want


def test_stages_spare_columns_of_the_same_names(documents, spark, tables):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "x", "y", "z", 7.5, 3) for r in documents.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, keep string, lang_pred string, quality_score double, place int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns, name
        assert {(r.score, r.keep, r.lang_pred, r.quality_score, r.place) for r in out.collect()} == {("x", "y", "z", 7.5, 3)}, name


def test_rows_of_one_id_and_different_texts_stay(spark, tables):
    a, b = " ".join(f"word{i}" for i in range(40)), " ".join(f"other{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, a), (None, b), (None, None), (3, ""), (3, ""), (4, f"{a} more")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, tables).collect()), key=str)
    assert got == sorted([(1, a), (1, b), (None, None), (3, ""), (3, "")], key=str)


def test_empty_table(documents, spark, tables):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).collect() == []
