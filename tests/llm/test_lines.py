from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from conftest import SF
from mailspark.llm.lines import BLANKS, LineRuns, deduplicated, line_digests, long_lines, repeated_lines

LONG = "A line that is long enough to be told from others, number "


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, min_docs=5, min_chars=40):
    holders = defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    keeper = {k: max(d for d in docs if d is not None) for k, docs in holders.items() if len(docs) >= min_docs}
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if keeper.get(key(line), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def order(rows):
    return sorted(rows, key=repr)


def same(frame, rows, **options):
    got = [tuple(r) for r in deduplicated(frame, **options).select("doc_id", "n_lines", "n_dropped", "text").collect()]
    assert order(got) == order(brute(rows))


def test_equals_brute_force_on_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    expected = [(d, n, g, sha256(t.encode()).hexdigest()) for d, n, g, t in brute(rows)]
    assert any(r[2] for r in expected)
    got = line_digests(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert order(tuple(r) for r in got) == order(expected)


def test_cases(documents):
    common = LONG + "one"
    rows = [
        (1, f"  {common.upper()}\t\nown"), (2, f"{common}\n{common}"), (3, f"x\n{common}\r\n"), (4, common), (5, f"{common}\n{common}\nz"),
        (None, common), (None, f"{common}\nnull"), (7, None), (8, ""), (9, "\n\n"), (4, common), (4, f"{common} \nelse"),
        (10, "short\nshort"), (11, "short"), (12, "short"), (13, "short"), (14, "short"), (15, "É" * 40), (16, "é" * 40),
    ]
    same(documents(rows), rows)


def test_four_documents_are_too_few_and_rows_without_id_count_once(documents):
    rows = [(i, LONG + "two") for i in range(3)] + [(None, LONG + "two")] * 3
    same(documents(rows), rows)
    rows += [(9, LONG + "two")]
    same(documents(rows), rows)


@pytest.mark.parametrize("batches, fanout", [(1, 2), (3, 2), (16, 2), (5, 4)])
def test_batches_and_levels_do_not_change_the_result(documents, batches, fanout):
    rows = [(i, "\n".join(f"{LONG}{j}" for j in range(1, 30) if i % j == 0)) for i in range(120)]
    same(documents(rows), rows, batches=batches, fanout=fanout)


def test_empty_table_and_clashing_columns(documents):
    assert line_digests(documents([])).collect() == []
    names = "mark string, place int, places string, h0 string, h1 string, key string, line string, keeper int, of_doc int, n_lines int"
    rows = [(i, LONG + "three", None, None, None, "m", 1, "p", "0", "1", "k", "l", 2, 3, 4) for i in range(6)]
    same(documents(rows, names), rows)


def test_a_very_long_text_and_a_hot_line(documents):
    text = "\n".join(f"{LONG}{i}" for i in range(60_000))
    rows = [(0, text)] + [(i, LONG + "7") for i in range(1, 400)] + [(i, f"{LONG}8\n{i}") for i in range(400, 406)]
    same(documents(rows), rows)


def test_runs_are_compacted_and_sorted(spark):
    runs = LineRuns(spark, fanout=3, buckets=2)
    for n in range(7):
        batch = spark.range(100).select(
            F.xxhash64(F.col("id") + 50 * n).alias("h0"), F.xxhash64(F.col("id") + 50 * n, F.lit(1)).alias("h1"), F.lit(100 - n).alias("doc_id"))
        runs.add(batch)
        seen = runs.seen()
        assert seen.count() == seen.select("h0", "h1").distinct().count() == 50 * n + 100
        assert runs.unseen(batch).isEmpty()
    assert [len(level) for level in runs.levels] == [1, 2]
    plan = runs.unseen(runs.seen().limit(0).unionByName(batch))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftAnti") == 3
    runs.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_only_the_batch_is_shuffled(spark):
    runs = LineRuns(spark, fanout=4, buckets=4)
    hashed = spark.range(1000).select(F.xxhash64("id").alias("h0"), F.xxhash64("id", F.lit(1)).alias("h1"), F.col("id").alias("doc_id"))
    runs.add(hashed.where("id < 500"))
    runs.add(hashed.where("id < 700"))
    plan = runs.unseen(hashed.repartition(4, "h0", "h1"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 1
    runs.drop()


def test_lines_of_every_text_are_read(documents):
    rows = [(1, f"{LONG}a\nshort\n{LONG}b"), (2, None)]
    assert sorted(r["place"] for r in long_lines(documents(rows)).collect()) == [0, 2]
    assert repeated_lines(documents(rows)).collect() == []
