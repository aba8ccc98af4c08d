"""The corpus pipeline on a small corpus, stage by stage."""

from collections import Counter

import corpus_pipeline
from tests.llm.test_small_cases import brute_targets


def test_stages_take_effect(spark, tmp_path):
    bench = " ".join(f"bench{i}" for i in range(20))
    good = [(i, f"calm sentence number {i} about river{i} and tree{i * 7} under sky{i * 3}", "en", f"s{i % 2}") for i in range(40)]
    around = " ".join(f"plain{i} word" for i in range(400))
    extra = [(90, good[3][1], "en", "s0"), (91, bench, "en", "s1"), (92, f"{around} {bench} {around}x", "en", "s1")]
    bad = [(100 + i, f"BUY!!! NOW!!! ### $$$ {i} CHEAP!!! ###", "en", "s0") for i in range(40)]
    rows = [(i, t, lang, s, len(t)) for i, t, lang, s in good + extra + bad]
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, *_ in good + extra] + [(i, 0, 0) for i, *_ in bad], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        path = f"{folder}/out-{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = Counter(r["doc_id"] for r in docs.collect())
        assert name == "shards" or docs.columns == columns
    assert set(seen["quality"]) == {i for i, *_ in good + extra}
    assert set(seen["near_dedup"]) == set(seen["quality"]) - {90} and max(seen["near_dedup"].values()) == 1
    assert set(seen["decontamination"]) == set(seen["near_dedup"]) - {91, 92}
    clean = [r for r in rows if r[0] in seen["decontamination"]]
    sizes = Counter()
    for _, t, _, s, _ in clean:
        sizes[s] += len(t.split())
    goal = brute_targets(sizes)
    for s in sizes:
        taken = sum(len(t.split()) * seen["mix"][i] for i, t, _, source, _ in clean if source == s)
        assert abs(taken - goal[s]) <= 12
    assert seen["shards"] == seen["mix"]
    final = corpus_pipeline.run(spark, folder)
    assert Counter(r["doc_id"] for r in final.collect()) == seen["shards"]
