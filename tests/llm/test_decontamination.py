import re

from mailspark.llm.decontamination import SEEDS, contaminated, decontaminate

from .conftest import CLASHING

ITEM = [f"item{k}" for k in range(20)]


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def around(words, i):
    return " ".join([f"a{i}x{k}" for k in range(15)] + words + [f"b{i}x{k}" for k in range(15)])


def found(spark, documents, docs, items):
    return sorted((r["doc_id"], r["item_id"]) for r in contaminated(documents(docs), bench(spark, items)).collect())


def test_substitutions(spark, documents):
    replaced = lambda *at: [("other" if k in at else w) for k, w in enumerate(ITEM)]
    docs = [
        (1, around(ITEM, 1)), (2, around(replaced(5), 2)), (3, around(replaced(3, 11), 3)), (4, around(replaced(2, 9, 16), 4)),
        (5, around(replaced(*range(0, 20, 2)), 5)), (6, around(ITEM[:14], 6)), (7, around(ITEM[:6], 7)), (8, around([], 8)),
        (9, around([w.upper() + "," for w in ITEM], 9)),
    ]
    assert found(spark, documents, docs, [(50, " ".join(ITEM))]) == [(i, 50) for i in (1, 2, 3, 4, 6, 9)]


def test_places(spark, documents):
    r = contaminated(documents([(1, around(ITEM, 1))]), bench(spark, [(50, " ".join(ITEM))])).first()
    assert (r["score"], r["item_words"], r["doc_start"], r["doc_end"]) == (20, 20, 15, 35)


def brute_force(docs, items):
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    out = set()
    for d, text in docs:
        for i, item in items:
            w, b = words(text), words(item)
            for shift in range(-len(b) + 1, len(w)):
                best = run = 0
                for k, x in enumerate(b):
                    run = max(run, 0) + (1 if 0 <= shift + k < len(w) and w[shift + k] == x else -1)
                    best = max(best, run)
                if len(b) >= 5 and best >= min(10, max(-(-len(b) * 6 // 10), min(len(b), 7))):
                    out.add((d, i))
    return sorted(out)


def test_against_brute_force(spark, documents):
    """Items of 5 to 40 words, whole or in part, with every eighth word replaced."""
    items = [(n, " ".join(f"w{n}y{k}" for k in range(n))) for n in range(5, 41)]
    docs = []
    for n, text in items:
        words = text.split()
        docs.append((len(docs), around(words, len(docs))))
        if n >= 12:
            docs.append((len(docs), around(["zz" if k % 8 == 4 else w for k, w in enumerate(words)], len(docs))))
            docs.append((len(docs), around(words[n // 3:], len(docs))))
    docs.append((len(docs), around([], 999)))
    assert found(spark, documents, docs, items) == brute_force(docs, items)


def test_cases(spark, documents, long_text):
    short = "five words are just enough"
    items = [(1, short), (2, "four words too few"), (3, None), (4, ""), (None, " ".join(ITEM)), (6, short)]
    docs = [(1, None), (2, ""), (3, f"x {short} y"), (3, f"x {short} y"), (4, "four words too few"), (None, short), (5, f"{long_text} {short}")]
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(documents(docs), bench(spark, items)).collect()}
    assert got == {(d, i) for d in (3, None, 5) for i in (1, 6)}
    left = decontaminate(documents(docs, CLASHING), bench(spark, items))
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "2", "4"]
    assert left.columns == documents(docs, CLASHING).columns


def test_empty_tables(spark, documents):
    assert found(spark, documents, [], [(1, " ".join(ITEM))]) == []
    assert found(spark, documents, [(1, around(ITEM, 1))], []) == []


def test_seeds():
    assert len({len(s) for s in SEEDS}) == 1 and all(s[0] == s[-1] == "1" for s in SEEDS)


def test_very_many_equal_words(spark, documents):
    """A hundred thousand equal words against an item of thirty: every place is a hit, and
    the best one is the first."""
    docs = [(1, "tick " * 100_000), (2, around(["tick"] * 30, 2)), (3, around(["tick"] * 4, 3)), (None, "tick " * 40)]
    rows = contaminated(documents(docs), bench(spark, [(50, "tick " * 30)])).collect()
    assert {(r["doc_id"], r["score"], r["doc_start"], r["doc_end"]) for r in rows} == {
        (1, 30, 0, 30), (2, 30, 15, 45), (None, 30, 0, 30)}
