"""The pipeline's stages against plain forms of the same rules."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import __spark_entry__ as entry

from .test_operators import brute_components, documents  # noqa: F401

SMALL = "/root/testdata/sf0.001"


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "n-gram Jaccard join", "packing"]
    names = entry.queries()
    assert names["pipeline"] is corpus_pipeline.run
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = corpus_pipeline.good_ones(spark, docs, SMALL)
    assert kept.dtypes == docs.dtypes
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    good, bad = [d for d, q in labels.items() if q == 1], [d for d, q in labels.items() if q == 0]
    assert sum(d in ids for d in good) == len(good) and sum(d in ids for d in bad) <= 0.1 * len(bad)
    told = corpus_pipeline.known_language(spark, docs, SMALL)
    assert told.dtypes == docs.dtypes
    assert told.count() >= 0.995 * docs.count()


def test_one_of_each_group_stays(spark, documents):  # noqa: F811
    rows = [(i, r.text) for i, r in enumerate(documents.collect())]
    groups = Counter(c for (_, _, c) in brute_components(rows))
    out = corpus_pipeline.one_of_each(spark, documents.withColumn("component_id", documents.n_chars), SMALL)
    assert out.count() == len(groups) and "component_id" in out.columns
    texts = {r.text for r in documents.collect()}
    assert {r.text for r in out.collect()} <= texts


def test_first_rows_do_not_depend_on_scan_splits(spark, documents, tmp_path):  # noqa: F811
    """The split of the input's scan changes between the join and the reading of its result."""
    path, names = str(tmp_path / "docs"), ("spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum")
    documents.repartition(16).write.parquet(path)
    docs = spark.read.parquet(path)
    want = len(Counter(c for (_, _, c) in brute_components([(i, r.text) for i, r in enumerate(docs.collect())])))
    before = spark.conf.get(names[0])
    try:
        spark.conf.set(names[0], "1k")
        out = corpus_pipeline.one_of_each(spark, docs, SMALL)
        spark.conf.set(names[0], "1g")
        spark.conf.set(names[1], "1")
        groups = Counter(c for (_, _, c) in brute_components([(i, r.text) for i, r in enumerate(out.collect())]))
    finally:
        spark.conf.set(names[0], before)
        spark.conf.unset(names[1])
    # one row of every group: as many rows as before, and no two of them alike
    assert len(groups) == want and max(groups.values()) == 1


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert set(out.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    per = out.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert per and all(r["sum(length)"] == r["max(doc_tokens)"] for r in per)


def test_stages_take_odd_tables(spark, documents):  # noqa: F811
    """Nulls anywhere, clashing extra columns, repeated rows, and no rows at all."""
    names = ["score", "kept", "host", "path", "lang_pred", "held_out", "ids", "uid", "start", "length", "evidence", "component_id", "n", "sid", "part", "x", "p", "_row"]
    odd = documents
    for i, n in enumerate(names):
        odd = odd.withColumn(n, documents.text if i % 2 else documents.n_chars)
    for stage in (corpus_pipeline.good_ones, corpus_pipeline.known_language, corpus_pipeline.one_of_each):
        out = stage(spark, odd, SMALL)
        assert out.dtypes == odd.dtypes
        assert set(map(tuple, out.collect())) <= set(map(tuple, odd.collect()))
        assert stage(spark, odd.limit(0), SMALL).count() == 0
    assert corpus_pipeline.packed(spark, odd, SMALL).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    assert corpus_pipeline.packed(spark, odd.limit(0), SMALL).count() == 0
