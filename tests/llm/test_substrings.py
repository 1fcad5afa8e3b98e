import random

import numpy as np

from mailspark.llm.substrings import borders, chunks, documents_with_repeats, gear_hashes, without_repeats, _GEAR

from .conftest import CLASHING


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_gear_hash_is_the_rolling_one():
    data = np.frombuffer(prose(1, 60).encode(), dtype=np.uint8)
    h, want = 0, []
    for byte in data:
        h = (2 * h + int(_GEAR[byte])) & 0xFFFFFFFF
        want.append(h)
    assert gear_hashes(data).tolist() == want


def test_borders_resist_insertions():
    text = prose(2, 400)
    ends = borders(np.frombuffer(text.encode(), dtype=np.uint8))
    longer = "inserted words before " + text
    shift = len(longer) - len(text)
    moved = borders(np.frombuffer(longer.encode(), dtype=np.uint8)) - shift
    assert len(set(ends[3:].tolist()) - set(moved.tolist())) == 0


def test_passages_are_found_at_any_place(documents):
    rows, holders = [], {}
    for p in range(20):
        passage = prose(1000 + p, 55)
        for c in range(3):
            i = len(rows)
            rows.append((i, f"{prose(i, 30 + 13 * c)} {passage} {prose(5000 + i, 40)}"))
            holders[i] = p
    clean = list(range(len(rows), len(rows) + 40))
    rows += [(i, prose(90_000 + i, 120)) for i in clean]
    got = {r["doc_id"]: r for r in documents_with_repeats(documents(rows)).collect()}
    assert set(got) == set(holders)
    for i, r in got.items():
        for p in r["passages"]:
            # The text of a passage is in the document that is named as its first.
            assert rows[i][1].encode()[p["start"]:p["end"]] in rows[p["first_doc"]][1].encode()
            assert p["first_doc"] == 3 * holders[i]


def test_removal_keeps_the_first(documents):
    passage = prose(7, 80)
    rows = [(1, f"{prose(1, 50)} {passage}"), (2, f"{passage} {prose(2, 50)}"), (3, prose(3, 60)), (4, None)]
    docs = documents(rows, CLASHING)
    got = {r["doc_id"]: r["text"] for r in without_repeats(docs).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1] and got[4] is None
    assert len(got[2]) < len(rows[1][1]) - 300 and got[2].endswith(rows[1][1][-200:])
    assert without_repeats(docs).columns == docs.columns


def test_stretches_are_cut_where_the_holder_changes(documents):
    a, b, c = (prose(s, 60) for s in (11, 12, 13))
    grown = [(1, f"{a} {b}"), (2, f"{a} {b} {c}"), (3, f"{a} {b} {c}")]
    shrunk = [(1, a), (2, f"{c} {a}"), (3, f"{c} {a}")]
    for rows, old in ((grown, f"{a} {b}"), (shrunk, a)):
        texts, docs = dict(rows), documents(rows)
        got = {r["doc_id"]: r for r in documents_with_repeats(docs).collect()}
        for i in texts:
            for p in got[i]["passages"]:
                assert texts[i].encode()[p["start"]:p["end"]] in texts[p["first_doc"]].encode()
        # A byte more where the space before or behind is the same.
        assert [got[i]["removable"] - n for i, n in ((1, 0), (2, len(old)), (3, len(texts[3])))] == [0, 0, 0]
        assert {p["first_doc"] for p in got[2]["passages"]} == {p["first_doc"] for p in got[3]["passages"]} == {1, 2}
        left = {r["doc_id"]: r["text"].strip() for r in without_repeats(docs).collect()}
        assert left == {1: texts[1], 2: c, 3: ""}


def test_short_words(documents):
    """Passages of 51 words that few whole chunks fit in, at their exact place."""
    def words(seed, n):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([2, 3, 3, 4]))) for _ in range(n))

    rows, want = [], {}
    for p in range(30):
        passage = words(1000 + p, 51)
        for _ in range(2):
            i = len(rows)
            head = words(i, 40 + i % 7)
            rows.append((i, f"{head} {passage} {words(5000 + i, 40)}"))
            want[i] = (len(head) + 1, len(head) + 1 + len(passage))
    got = {r["doc_id"]: r["passages"] for r in documents_with_repeats(documents(rows)).collect()}
    assert set(got) == set(want)
    for i, (start, end) in want.items():
        (p,) = got[i]
        # A letter more can be equal by chance, and with it a word more begins.
        assert start - 6 <= p["start"] <= start and end <= p["end"] <= end + 6 and 51 <= p["words"] <= 53


def test_characters_stay_whole(documents):
    passage = " ".join("äöüßéèêç"[k % 8] * 3 + str(k) for k in range(120))
    got = without_repeats(documents([(1, "x " + passage), (2, "yy " + passage + " Schluß")])).collect()
    assert all("�" not in r["text"] for r in got)


def test_cases(documents, long_text):
    rows = [(1, None), (2, ""), (3, "short"), (4, "short"), (5, "a" * 50_000), (6, long_text), (6, long_text), (None, prose(3, 90)), (7, prose(3, 90))]
    got = {r["doc_id"] for r in documents_with_repeats(documents(rows)).collect()}
    # Rows of one document repeat nothing of each other.
    assert 7 in got and len(got) == 2 and not got & {1, 2, 3, 4, 5, 6}
    assert documents_with_repeats(documents([])).collect() == []


def test_periodic_texts(documents):
    rows = [(1, "and " * 400), (2, "x " + "and " * 300), (3, prose(1, 100))]
    assert {r["doc_id"] for r in documents_with_repeats(documents(rows)).collect()} == {1, 2}
    made = chunks(documents([(1, "a" * 100_000)])).collect()
    assert max(r["end"] - r["start"] for r in made) < 300
