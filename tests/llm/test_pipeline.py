"""The pipeline stage by stage against brute force on the smallest tables."""

import corpus_pipeline
from marginalia.llm.storage import cut, table
from marginalia.llm import quality
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    items = [tuple(r) for r in table(spark, SF, "benchmark").collect()]
    columns = docs.columns
    outputs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), "stage")
        outputs.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    kept = [{r["doc_id"]: r["text"] for r in out.select("doc_id", "text").collect()} for out in outputs]

    source = table(spark, SF, "documents")
    model = quality.learn(source, table(spark, SF, "labels"))
    scored = quality.score(source, model).collect()
    assert set(kept[0]) == {r["doc_id"] for r in scored if r["score"] >= quality.CUT_SCORE}

    last = {}
    for key, text in sorted(kept[0].items()):
        last[brute.lower(text)] = key
    assert set(kept[1]) == set(last.values())

    found = brute.near_components(kept[1].items())
    assert set(kept[2]) == set(found.values())

    clean = set()
    for key, text in kept[2].items():
        n_words, n_hit, _ = brute.contamination(text, items)
        if not (n_hit and 20 * n_hit >= n_words):
            clean.add(key)
    assert set(kept[3]) == clean

    mixed = outputs[4].select("doc_id", "position", "copy", "size").collect()
    assert {r["doc_id"] for r in mixed} <= clean
    total = sum(len(brute.space_words(kept[3][k])) for k in clean)
    assert abs(sum(r["size"] for r in mixed) - total) <= 0.05 * total


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
