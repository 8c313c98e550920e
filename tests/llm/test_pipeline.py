"""The pipeline stage by stage against plain readings, and on odd rows."""

import brute
import corpus_pipeline
from odd_rows import frame, odd  # noqa: F401
from hallwatch.llm import best_fit_packing


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.settle(stage(spark, docs, folder))
        assert docs.columns == names
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if k == 0:
            labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
            assert all(not brute.quality_counts(r.text)[-1] for r in after.values())
            assert all(i in after for i, r in before.items() if i in labels and labels[i].quality == 1 and not brute.quality_counts(r.text)[-1])
        if k == 1:
            assert len(after) == len(before)
        if k == 2:
            assert set(after) == {i for i, _, c in brute.jaccard([(i, r.text) for i, r in before.items()]) if i == c}
        if k == 3:
            want = {i: (n, gone, sha) for i, n, gone, sha in brute.cut_repeats([(i, r.text) for i, r in before.items()])}
            for i, r in before.items():
                if want[i][1] == 0:
                    assert after[i] == r
                elif want[i][1] < want[i][0]:
                    assert brute.sha(after[i].text) == want[i][2] and after[i].n_chars == len(after[i].text)
                else:
                    assert i not in after
    packed = best_fit_packing.pack(docs)
    assert packed.agg({"length": "sum"}).first()[0] == sum(len(brute.words(r.text)) for r in docs.collect())
    assert corpus_pipeline.run(spark, folder).count() == packed.count()


def test_odd_rows(spark, odd):
    for rows in (odd, []):
        docs = frame(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            assert set(stage(spark, docs, "").columns) >= {"doc_id"}
            if stage is not corpus_pipeline.packing:
                out = stage(spark, docs, "")
                assert out.columns == docs.columns and out.count() <= len(rows)
