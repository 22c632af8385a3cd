import pytest

import __spark_entry__
import corpus_pipeline
from slotforge.llm import decontaminate, linededup, packing, quality, simhash


def test_stages(spark, sf):
    """Each stage does to its own input what its operator says, and the end result covers what is left, token for token."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "packing"]
    step = [docs]
    for _, stage in corpus_pipeline.STAGES:
        step.append(stage(spark, step[-1], sf).cache())
    for made in step[1:-1]:
        assert made.columns == columns and made.dtypes == docs.dtypes
    kept = {r["id"] for r in quality.judge(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
    assert {r["doc_id"] for r in step[1].collect()} == kept
    lines = {r["doc_id"]: r["text"] for r in linededup.LineStore.build(step[1]).apply(step[1]).collect()}
    assert {r["doc_id"]: r["text"] for r in step[2].collect()} == lines and all(r["n_chars"] == len(r["text"]) for r in step[2].collect())
    rows, roots = simhash.similar_texts(step[2])
    root = {r["node"]: r["root"] for r in roots.collect()}
    first = {}
    for r in rows.collect():
        g = root.get(r["h"], r["h"])
        first[g] = min(first.get(g, r["id"]), r["id"])
    groups = set(first.values())
    assert {r["doc_id"] for r in step[3].collect()} == groups
    bad = {r["id"] for r in decontaminate.contaminated(step[3], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in step[4].collect()} == groups - bad
    words = {r["doc_id"]: len(r["text"].encode().split()) + 1 for r in step[4].collect()}
    packed = step[5].collect()
    assert {i: sum(r["length"] for r in packed if r["doc_id"] == i) for i in words} == words
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"]) for r in whole) == sorted((r["doc_id"], r["piece"], r["length"]) for r in packed)
    assert all(r["bin_size"] in packing.CAPACITIES for r in packed)


@pytest.mark.parametrize("n", range(1, 11))
def test_registered(n):
    assert sum(k.startswith(f"op{n}_") for k in __spark_entry__.queries()) == 1


def test_empty_documents(spark, sf, make_docs):
    empty = make_docs([]).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def test_odd_documents_through_all_stages(spark, sf, make_docs):
    """Null and empty texts, repeated ids and rows, missing ids, a very long text: nothing fails, and what is good is packed whole."""
    good = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("n_chars between 300 and 2000").orderBy("doc_id").limit(3).collect()]
    words = [f"word{i} of the long text" for i in range(60_000)]
    rows = [(1, None), (2, ""), (3, good[0]), (3, good[0]), (3, good[1]), (4, good[0]), (None, good[2]), (5, " ".join(words)), (6, "\n\n")]
    docs = make_docs(rows).select("doc_id", "text", "lang", "source", "n_chars")
    step = [docs]
    for _, stage in corpus_pipeline.STAGES:
        step.append(stage(spark, step[-1], sf))
    for made in step[1:-1]:
        assert made.columns == docs.columns
    near = sorted((str(r["doc_id"]), r["text"]) for r in step[3].collect())
    before = {(str(r["doc_id"]), r["text"]) for r in step[2].collect()}
    assert set(near) <= before and ("4", good[0]) not in near
    words_left = sum(len(r["text"].encode().split()) + 1 for r in step[4].collect())
    assert sum(r["length"] for r in step[5].collect()) == words_left
