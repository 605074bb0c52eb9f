import hashlib

from barloom.llm import automaton, passages


def brute(rows):
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


def test_matches_brute_force(docs, corpus):
    expected = brute([(i, t) for i, t, *_ in corpus if i is not None])
    got = {r["doc_id"]: tuple(r)[1:] for r in passages.remove_repeats(docs(corpus)).collect()}
    assert got.pop(None)[1] == 0
    assert got == expected
    assert sum(r[1] for r in expected.values()) > 3000


def test_repeats_inside_one_document_and_equal_ids_stay(docs):
    words = " ".join(f"w{i}" for i in range(60))
    got = passages.remove_repeats(docs([(1, words + " " + words), (2, words), (2, words), (3, "x " + words)])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (2, 60), (2, 60), (3, 60)]


def test_empty_table(docs):
    assert passages.remove_repeats(docs([])).count() == 0


def test_automaton_gives_matching_statistics():
    import random

    draw = random.Random(1)
    for _ in range(60):
        texts = [[draw.choice([b"a", b"b", b"c"]) for _ in range(draw.randint(0, 12))] for _ in range(3)]
        query = [draw.choice([b"a", b"b", b"c", b"d"]) for _ in range(15)]
        a = automaton.Automaton()
        for t in texts:
            a.add(t)
        pieces = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        expected = [max((n for n in range(e + 2) if n == 0 or tuple(query[e + 1 - n : e + 1]) in pieces), default=0) for e in range(15)]
        assert a.matches(query).tolist() == expected


def test_bounded_reference(docs, spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(55))
    reference = spark.createDataFrame([(passage,), (passage,), (None,)], "text string")
    got = {r["doc_id"]: r for r in automaton.remove_reference(docs([(1, f"a {passage} b"), (2, passage[:100]), (3, None)]), reference).collect()}
    assert (got[1]["kept"], got[1]["n_removed"]) == ("a b", 55)
    assert got[2]["n_removed"] == got[3]["n_removed"] == 0
    monkeypatch.setattr(automaton, "MOST_WORDS", 10)
    try:
        automaton.remove_reference(docs([(1, "a")]), reference)
    except ValueError:
        return
    raise AssertionError("a reference above the bound must be refused")
