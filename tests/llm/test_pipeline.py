"""The pipeline, stage by stage, against plain code on its own input."""

import re

import pytest

import corpus_pipeline
from mailspark.llm import toxicity

from .test_decontamination import brute_force as leaks
from .test_minhash import by_brute_force as groups
from .test_mixing import targets

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    """Rows of the input and of every stage."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found, folder = [docs], tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        path = str(folder / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        found.append(docs)
    return found


def test_stage_names_and_columns(outputs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert all(o.columns == outputs[0].columns for o in outputs[:5])


def test_toxic_documents_go(spark, outputs):
    before, after = (outputs[k].collect() for k in (0, 1))
    model = toxicity.fit(outputs[0], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if model.score(r["text"]) < 0.5}
    assert len(after) < len(before)


def test_one_of_each_group_stays(outputs):
    before, after = ([(r["doc_id"], r["text"]) for r in outputs[k].collect()] for k in (1, 2))
    names = groups(before, 5, 80)
    assert sorted(i for i, _ in after) == sorted(set(names.values()))


def test_benchmark_items_go(spark, outputs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    before, after = ([(r["doc_id"], r["text"]) for r in outputs[k].collect()] for k in (2, 3))
    bad = {d for d, _ in leaks([(i, t) for i, t in before if len(t) < 6000], items)}
    assert {i for i, _ in after} == {i for i, _ in before} - bad


def test_sources_are_mixed(outputs):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    before, after = (outputs[k].collect() for k in (3, 4))
    sizes, largest, taken, times = {}, {}, {}, {}
    for r in before:
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
        largest[r["source"]] = max(largest.get(r["source"], 0), words(r["text"]))
    for r in after:
        taken[r["source"]] = taken.get(r["source"], 0) + words(r["text"])
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    want = targets(sizes)
    assert max(times.values()) <= 2 and set(times) <= {r["doc_id"] for r in before}
    assert all(abs(taken.get(s, 0) - want[s]) <= 2 * largest[s] for s in sizes)


def test_shards_are_even(outputs):
    before, after = (outputs[k].collect() for k in (4, 5))
    assert len(after) == len(before)
    size = {}
    for r in after:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
    assert sorted(size) == list(range(8)) and max(size.values()) - min(size.values()) <= 4 * max(r["size"] for r in after)


def test_run(spark, outputs):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == outputs[-1].columns
    assert sorted((r["doc_id"], r["shard"]) for r in got.collect()) == sorted((r["doc_id"], r["shard"]) for r in outputs[-1].collect())
