import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from mailspark.operators import search
from mailspark.operators.vector_index import VectorIndex, learn_centres, measured_probes

SCHEMA = "thread_id string, chunk_no int, embedding array<float>"


def clustered(n, width=16, centres=40, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, width))
    raw = middle[rng.integers(0, centres, n)] + 0.35 * rng.normal(size=(n, width))
    return raw.astype(np.float32)


def brute(rows, asked, k):
    unit = np.array([r[2] for r in rows], dtype=np.float64)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    out = {}
    for name, vector in asked:
        q = np.array(vector, dtype=np.float32).astype(np.float64)
        scores = unit @ (q / np.sqrt(q @ q))
        order = sorted(range(len(rows)), key=lambda i: (-round(scores[i], 12), rows[i][:2]))[:k]
        out[name] = [rows[i][:2] for i in order]
    return out


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    raw = clustered(4000)
    rows = [(f"t{i // 5}", i % 5, [float(x) for x in v]) for i, v in enumerate(raw)]
    index = VectorIndex(spark, str(tmp_path_factory.mktemp("index")))
    index.build(spark.createDataFrame(rows, SCHEMA).repartition(6), ("thread_id", "chunk_no"))
    return index, rows


def asked_of(spark, rows, every=50):
    asked = [(i, rows[i][2]) for i in range(0, len(rows), every)]
    return asked, spark.createDataFrame(asked, "question int, embedding array<float>")


def answers(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["question"], r["rank"])):
        out.setdefault(r["question"], []).append((r["thread_id"], r["chunk_no"]))
    return out


def test_exact_search_equals_the_scan(spark, built):
    index, rows = built
    asked, questions = asked_of(spark, rows)
    assert answers(index.search(questions, 10, exact=True)) == brute(rows, asked, 10)
    # One probed cell only: the bounds have to open all others that matter.
    assert answers(index.search(questions, 10, probes=1, exact=True)) == brute(rows, asked, 10)


def test_recall_and_share_of_rows_read(spark, built):
    index, rows = built
    asked, questions = asked_of(spark, rows, 20)
    best, near = brute(rows, asked, 10), answers(index.search(questions, 10))
    recall = np.mean([len(set(best[q]) & set(near[q])) / 10 for q in best])
    sizes = {r["cell"]: r["n"] for r in index.cells().collect()}
    read = index.probed(questions.withColumnRenamed("embedding", "v")).groupBy("question").agg(F.collect_list("cell").alias("cells")).collect()
    share = np.mean([sum(sizes.get(c, 0) for c in r["cells"]) for r in read]) / len(rows)
    assert recall >= 0.9 and share < 0.25


def test_only_files_of_probed_cells_are_read(spark, built):
    index, rows = built
    one = spark.createDataFrame([(0, rows[0][2])], "question int, embedding array<float>")
    cells = [r["cell"] for r in index.probed(one.withColumnRenamed("embedding", "v"), 2).collect()]
    blocks = index.blocks(cells)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert blocks.agg(F.sum("n")).first()[0] < len(rows) / 4


def test_recall_on_vectors_without_clusters(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    from mailspark.checks.queries import QUERIES
    found = QUERIES["vector_index_recall"](spark, SF).collect()
    assert len(found) == vectors.where("vec_id % 20 = 0").count()
    assert sum(r["found"] for r in found) >= 0.9 * sum(r["best"] for r in found)


def test_batches_are_added(spark, tmp_path):
    raw = clustered(600, seed=5)
    rows = [(f"t{i}", 0, [float(x) for x in v]) for i, v in enumerate(raw)]
    frame = spark.createDataFrame(rows, SCHEMA)
    index = VectorIndex(spark, str(tmp_path / "index"))
    index.build(frame.where("thread_id < 't3'"), ("thread_id", "chunk_no"))
    index.add(frame.where("thread_id >= 't3'"), 1)
    index.add(frame.where("thread_id >= 't3'"), 1)
    asked, questions = asked_of(spark, rows)
    assert answers(index.search(questions, 7, exact=True)) == brute(rows, asked, 7)


def test_odd_vectors_and_ties(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [("a", i, [1.0, 0.0, 0.0]) for i in range(30)] + [("b", i, [0.0, 1.0 + i, 0.0]) for i in range(5)]
    odd = [("c", 0, None), ("c", 1, [nan, 1.0, 1.0]), ("c", 2, [0.0, 0.0, 0.0]), ("c", 3, [1.0, 2.0]), ("c", 4, [inf, 0.0, 0.0]), ("c", 5, [1.0, None, 0.0])]
    index = VectorIndex(spark, str(tmp_path / "index"))
    index.build(spark.createDataFrame(rows + odd, SCHEMA), ("thread_id", "chunk_no"))
    questions = spark.createDataFrame(
        [(1, [2.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, 1.0])], "question int, embedding array<float>")
    found = answers(index.search(questions, 4, exact=True))
    assert found == {1: [("a", i) for i in range(4)], 2: [("b", i) for i in range(4)]}
    assert len(answers(index.search(questions, 100, exact=True))[1]) == 35
    with pytest.raises(ValueError):
        VectorIndex(spark, str(tmp_path / "empty")).build(spark.createDataFrame(odd[:1], SCHEMA), ("thread_id", "chunk_no"))


def test_same_answers_as_the_plain_search(spark, built):
    index, rows = built
    frame = spark.createDataFrame(rows, SCHEMA)
    plain = search.top_k(frame, rows[7][2], 5, tie="thread_id").select("thread_id", "chunk_no").collect()
    one = spark.createDataFrame([(7, rows[7][2])], "question int, embedding array<float>")
    assert answers(index.search(one, 5, exact=True))[7] == [tuple(r) for r in plain]


def test_cells_are_learned_from_the_sample():
    raw = clustered(2000).astype(np.float64)
    unit = raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))
    centres = learn_centres(unit, 40)
    assert (unit @ centres.T).max(axis=1).mean() > 0.85
    assert 1 <= measured_probes(unit, centres, 0.95, 10) <= 12


def test_a_question_is_written_once_whatever_it_probes(spark, built, monkeypatch):
    from mailspark.operators import vector_index

    index, rows = built
    asked, questions = asked_of(spark, rows, 20)
    written = []
    keep = vector_index.stored

    def stored(frame, label):
        written.append(keep(frame, label))
        return written[-1]

    monkeypatch.setattr(vector_index, "stored", stored)
    cells = index.cells().count()
    assert answers(index.search(questions, 10, probes=cells)) == brute(rows, asked, 10)
    width, sizes = 16, [sum(len(v) for r in frame.collect() for v in r if isinstance(v, (bytes, bytearray))) for frame in written]
    # Unit vectors, a score and a bit per cell.
    assert max(sizes) <= len(asked) * (8 * width + 8 + (cells + 7) // 8 + 8)
    assert sum(frame.count() for frame in written) <= 2 * len(asked)


def test_many_blocks_of_questions_meet_without_a_broadcast(spark, built, monkeypatch):
    from mailspark.operators import vector_index

    index, rows = built
    asked, questions = asked_of(spark, rows, 20)
    monkeypatch.setattr(vector_index, "QUESTIONS", 16)
    monkeypatch.setattr(vector_index, "_SMALL_BLOCKS", 2)
    found = index.search(questions, 10, exact=True)
    assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()
    assert answers(found) == brute(rows, asked, 10)
