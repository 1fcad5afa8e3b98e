import hashlib
import math
import re

from mailspark.llm.mixing import mix, mixed_sizes

from .conftest import CLASHING


def targets(sizes):
    """By the words of the rule: share by weight, cut at twice the source, reshare."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    out, open_ = {}, list(order)
    rest = 1.5 * sum(sizes.values())
    while open_:
        share = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return {**out, **share}
        for s in over:
            out[s] = 2.0 * sizes[s]
            rest -= out[s]
            open_.remove(s)
    return out


def rows_of(n):
    return [(i, "wort " * ((i * 37) % 60), "en", None if i % 13 == 0 else "src0" if i % 3 else f"s{i % 7}") for i in range(n)]


def test_targets_and_copies(documents):
    rows = rows_of(900)
    sizes, words = {}, {}
    for i, text, _, source in rows:
        words[i] = len(re.findall(r"[^\x20\x09-\x0D]+", text))
        sizes[source] = sizes.get(source, 0) + words[i]
    want = targets(sizes)
    got = mixed_sizes(documents(rows, CLASHING)).collect()
    assert len(got) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        source = rows[r["doc_id"]][3]
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == sizes[source]
        assert math.isclose(r["target"], want[source])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[source] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 60 + 0.01 * want[s] for s in sizes)
    # Systematic: by size within a source, the sum of copies follows the rate throughout.
    for source in sizes:
        rate = want[source] / sizes[source]
        copies = [r["taken"] // r["size"] for r in sorted(got, key=lambda r: (r["size"], r["doc_id"])) if r["size"] and rows[r["doc_id"]][3] == source]
        total = 0
        for k, c in enumerate(copies, 1):
            total += c
            assert abs(total - k * rate) < 2.0


def test_offset_is_fixed(documents):
    docs = documents(rows_of(200))
    assert sorted(map(tuple, mixed_sizes(docs).collect())) == sorted(map(tuple, mixed_sizes(docs.repartition(7)).collect()))
    assert 0 <= int(hashlib.md5(b"mix:src0").hexdigest()[:8], 16) / 2**32 < 1


def test_cases(documents, long_text):
    assert mixed_sizes(documents([])).collect() == []
    got = mixed_sizes(documents([(1, None), (2, ""), (3, "    "), (None, None, None, "a")])).collect()
    assert sorted((r["doc_id"] or 0, r["size"], r["taken"]) for r in got) == [(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 1, got and [r["taken"] for r in got if r["doc_id"] == 3][0])]
    one = mixed_sizes(documents([(1, long_text, "en", "s"), (1, long_text, "en", "s")])).collect()
    assert sum(r["taken"] for r in one) == 600_000 and one[0]["target"] == 600_000


def test_rows_are_emitted(documents):
    rows = rows_of(300)
    docs = documents(rows, CLASHING)
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixed_sizes(docs).collect() if r["size"]}
    out = mix(docs)
    assert out.columns == docs.columns
    seen = {}
    for r in out.collect():
        assert r["text"] == rows[r["doc_id"]][1]
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert {i: seen.get(i, 0) for i in taken} == taken
    # A repeated row counts once.
    assert sorted(map(str, mix(documents(rows + rows[:50])).collect())) == sorted(map(str, mix(documents(rows)).collect()))
