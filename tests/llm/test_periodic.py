import random

from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import periodic


def brute(words, min_length, min_exponent):
    """Every period, every stretch, every smaller period."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(min_length, min_exponent * q):
                own = words[i : i + length]
                if not any(own[d:] == own[: length - d] for d in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 7), st.integers(2, 9), st.sampled_from([(6, 4), (1, 2), (4, 3), (8, 2), (1, 4)]))
def test_runs_equal_brute_force(words, period, times, limits):
    words = words + words[-period:] * times + words[:5]
    assert periodic.runs(words, *limits) == brute(words, *limits)


def test_extensions_equal_a_scan():
    draw = random.Random(3)
    s = [draw.randint(1, 3) for _ in range(60)] + [1, 2] * 20 + [0]
    lce = periodic.Extensions(s)
    for i in range(len(s)):
        for j in range(len(s)):
            if i != j:
                k = 0
                while max(i, j) + k < len(s) and s[i + k] == s[j + k]:
                    k += 1
                assert lce(periodic.np.array([i]), periodic.np.array([j]))[0] == k


def test_stretches_without_runs_do_not_hide_any():
    draw = random.Random(4)
    noise = lambda n: [f"n{draw.randrange(10**9)}" for _ in range(n)]
    words = noise(500) + ["a", "b"] * 5 + noise(90) + ["a", "b"] * 4 + ["a"] * 7 + noise(3) + list("xyz") * 4 + noise(400)
    assert periodic.runs(words) == brute(words, 6, 4) and len(periodic.runs(words)) == 4


def test_very_long_documents():
    draw = random.Random(5)
    body = [draw.randint(0, 9) for _ in range(5000)]
    assert (0, 30_000, 5000) in periodic.runs(body * 6)
    assert periodic.runs(["a"] * 30_000) == [(0, 30_000, 1)]
    assert periodic.runs([*range(50_000)]) == []


def test_collapse_drops_all_but_the_first_period():
    words = "k a b a b a b a b k".split()
    assert periodic.collapse(words, periodic.runs(words)) == ["k", "a", "b", "k"]
    assert periodic.collapse(words, []) == words


def test_defined_cases(spark):
    rows = [(1, None, "x", 7), (2, "", "x", 7), (3, " \t\n", "x", 7), (4, "a a a a a a", "x", 7), (4, "a a a a a a", "x", 7), (None, "a\x0ba a  a\na a b", "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")
    out = periodic.collapse_runs(docs)
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect()]
    same = (4, 6, [(0, 6, 1)], "a")
    assert sorted(got, key=str) == sorted([(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), same, same, (None, 7, [(0, 6, 1)], "a b")], key=str)
    assert periodic.collapse_runs(docs.filter("doc_id > 9")).count() == 0
    digests = {r["doc_id"]: r for r in periodic.run_digests(periodic.planted(docs)).collect()}
    assert digests[1]["n_runs"] == 0 and digests[1]["start"] is None and digests[1]["runs_sha256"] is not None
    assert digests[4]["exponent_milli"] == 6000 and digests[None]["length"] == 6


def test_settings_change_the_runs(spark):
    docs = spark.createDataFrame([(1, "x y x y x y z")], "doc_id long, text string")
    assert [tuple(r) for r in periodic.collapse_runs(docs, min_length=4, min_exponent=3).first()["runs"]] == [(0, 6, 2)]
    assert periodic.collapse_runs(docs).first()["runs"] == []
