import os

import numpy as np
import pytest
import xxhash

from barloom.llm import vptree


def brute_print(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, bits=2):
    prints = {i: brute_print(t) for i, t in rows}
    group = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= bits and group[b] < group[a]:
                    group[a], changed = group[b], True
    return prints, group


def test_fingerprints_and_components_match_brute_force(docs, corpus):
    known = [(i, t) for i, t, *_ in corpus if i is not None]
    prints, group = brute_components(known)
    got = {r["doc_id"]: r for r in vptree.components(docs(corpus)).collect()}
    assert len(got) == len(corpus)
    for i in prints:
        assert got[i]["fingerprint"] == f"{prints[i]:016x}"
        assert got[i]["component_id"] == group[i]


def test_pairs_are_exact_at_any_tree(spark, monkeypatch):
    draw = np.random.default_rng(3)
    centre = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = draw.integers(0, 64, (40, 30, 3))
    prints = np.unique(np.concatenate([centre, *[c ^ np.bitwise_xor.reduce(np.uint64(1) << f.astype(np.uint64), axis=1) for c, f in zip(centre, flips, strict=True)]]))
    expected = {(int(a), int(b)) for a in prints for b in prints if a < b and int(a ^ b).bit_count() <= 2}
    got = {(int(prints[i]), int(prints[j])) for a, b in vptree.near_pairs(prints, prints, 2) for i, j in zip(a, b, strict=True)}
    assert got == expected
    monkeypatch.setattr(vptree, "SHARD_NODES", 64)
    nodes = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "print long")
    edges = {(r["a"], r["b"]) for r in vptree.links(nodes).collect()}
    roots = {r["node"]: r["root"] for r in vptree.connected(vptree.links(nodes)).collect()}
    whole = {int(np.uint64(x)) for e in edges for x in np.array(e, np.int64).view(np.uint64)}
    assert whole == {x for pair in expected for x in pair}
    parent = {int(x): int(x) for x in prints.view(np.int64)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in expected:
        x, y = find(int(np.array(a, np.uint64).view(np.int64))), find(int(np.array(b, np.uint64).view(np.int64)))
        parent[max(x, y)] = min(x, y)
    assert all(roots.get(x, x) == find(x) for x in parent)


def test_one_of_each_keeps_columns_and_rows_without_id(docs):
    rows = [(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (7, "other words here now")]
    kept = vptree.one_of_each(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 7]


def test_empty_table(docs):
    assert vptree.components(docs([])).count() == 0
    assert vptree.one_of_each(docs([])).count() == 0


def test_one_of_similar_drops_near_copies_and_copies_without_id(docs):
    draw = np.random.default_rng(11)
    base = [f"w{x}" for x in draw.integers(0, 10**6, 300)]

    def changed(k):
        return " ".join(w if i % (300 // k) else f"new{i}" for i, w in enumerate(base))

    near, far = changed(4), changed(20)
    assert vptree.similarity(" ".join(base), near) >= 0.8 > vptree.similarity(" ".join(base), far)
    assert (vptree.simhash(" ".join(base), 5) ^ vptree.simhash(near, 5)).bit_count() > vptree.BITS
    rows = [(5, " ".join(base)), (3, near), (9, far), (None, near), (None, "no id at all"), (None, "no id at all"), (2, None), (4, ""), (4, "one two")]
    kept = vptree.one_of_similar(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted(((r["doc_id"] or -1), r["text"]) for r in kept.collect()) == sorted([(3, near), (9, far), (-1, "no id at all"), (2, None), (4, "one two")], key=lambda x: x[0])
    assert vptree.one_of_similar(docs([])).count() == 0


def similar_pairs(texts):
    """All pairs at 0.8 or more, by an inverted list of shingles."""
    sets = {i: vptree.shingles(t) for i, t in texts.items()}
    where = {}
    for i, own in sets.items():
        for s in own:
            where.setdefault(s, []).append(i)
    met = {(a, b) for ids in where.values() for a in ids for b in ids if a < b}
    return {(a, b) for a, b in met if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


def groups_of(items, pairs):
    of = {i: i for i in items}

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        of[max(a, b)] = min(a, b)
    return {i: top(i) for i in items}


def test_links_in_a_family_with_a_template_are_found(docs):
    draw = np.random.default_rng(5)
    template = [f"t{i}" for i in range(240)]
    rows = []
    for k in range(150):
        own = [f"own{k}x{i}" for i in range(30)]
        twin = [f"own{k}x{i}" if draw.random() > 0.1 else f"twin{k}x{i}" for i in range(30)]
        rows += [(2 * k, " ".join(template + own)), (2 * k + 1, " ".join(template + twin))]
    texts = dict(rows)
    pairs = similar_pairs(texts)
    assert 100 < len(pairs) < 400
    group = groups_of(texts, pairs)
    kept = {r["doc_id"] for r in vptree.one_of_similar(docs(rows)).collect()}
    want = {i for i in texts if group[i] == i}
    # A recall of 0.95 or more of the links; no text goes without one.
    assert want <= kept and len(kept - want) <= 0.05 * (len(texts) - len(want))


def test_rare_partners_are_few_and_hold_most_pairs(spark):
    draw = np.random.default_rng(8)
    base = [[f"b{k}w{i}" for i in range(80)] for k in range(4)]
    texts = {}
    for i in range(160):
        words = list(base[i % 4])
        for _ in range(draw.integers(0, 8)):
            words[draw.integers(0, 80)] = f"n{draw.integers(0, 40)}"
        texts[f"k{i:03d}"] = " ".join(words[: draw.integers(60, 81)])
    frame = spark.createDataFrame([(k, t, k) for k, t in texts.items()], "key string, text string, root string")
    met = {(r["a"], r["b"]) for r in vptree.rare_partners(frame).collect()}
    assert len(met) <= 2 * vptree.RAREST * len(texts)
    # Links between components are what counts: the pairs met give nearly the components of all pairs.
    pairs = similar_pairs(texts)
    want, got = groups_of(texts, pairs), groups_of(texts, met & pairs)
    assert len(set(got.values())) <= len(set(want.values())) + 0.05 * len(texts)


def test_no_link_is_lost_in_families_with_a_template(docs):
    draw = np.random.default_rng(13)
    rows = []
    for family in range(2):
        template = [f"f{family}t{i}" for i in range(240)]
        for k in range(150):
            own = [f"f{family}own{k}x{i}" for i in range(30)]
            for twin in range(2):
                changed = [f"{w}twin" if twin and draw.random() < 0.4 else w for w in own]
                rows.append((len(rows), " ".join(template + changed)))
    texts = dict(rows)
    pairs = similar_pairs(texts)
    assert 100 < len(pairs) < 400
    group = groups_of(texts, pairs)
    assert {r["doc_id"] for r in vptree.one_of_similar(docs(rows)).collect()} == {i for i in texts if group[i] == i}


def test_prefixes_meet_all_similar_pairs_and_parity_bounds_the_difference(spark):
    draw = np.random.default_rng(21)
    sets = {}
    for i in range(300):
        base = draw.integers(0, 1 << 62, draw.integers(1, 60) if i % 3 else 2_500, dtype=np.uint64) if i % 5 == 0 else own
        own = np.unique(np.concatenate([base[draw.random(len(base)) > 0.1], draw.integers(0, 1 << 62, draw.integers(1, 1 + max(1, len(base) // 8)), dtype=np.uint64)]))
        sets[f"k{i:03d}"] = own
    often = np.zeros(1 << vptree.BUCKET_BITS, np.uint16)
    often[draw.integers(0, 1 << 20, 1 << 18)] = 9
    rows = [(k, k, len(h), vptree.prefix(h, often).view(np.int64).tolist(), bytearray(vptree.parity(h))) for k, h in sets.items()]
    met = {(r["a"], r["b"]) for r in vptree.prefix_partners(spark.createDataFrame(rows, "key string, root string, n int, prefix array<long>, parity binary")).collect()}
    near = 0
    for a in sets:
        for b in sets:
            if a < b:
                common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                whole = len(sets[a]) + len(sets[b])
                assert vptree.differing(vptree.parity(sets[a]), vptree.parity(sets[b])) <= whole - 2 * common
                if common >= 0.8 * (whole - common):
                    near += 1
                    assert (a, b) in met
    assert near > 50


def joined_rows(plan):
    """The rows that the joins of an executed plan made, most of any one."""
    rows = [plan.metrics().get("numOutputRows").get().value()] if "Join" in plan.nodeName() else []
    inner = [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if plan.nodeName().endswith("QueryStage") else []
    children = plan.children()
    for child in inner + [children.apply(i) for i in range(children.size())]:
        rows.append(joined_rows(child))
    return max(rows, default=0)


def test_texts_that_share_a_passage_give_no_row_for_each_pair(spark):
    draw = np.random.default_rng(34)
    passage = draw.integers(0, 1 << 62, 250, dtype=np.uint64)
    sets = [np.unique(np.concatenate([passage, draw.integers(0, 1 << 62, 60, dtype=np.uint64)])) for _ in range(150)]
    # Ten twins that lie at 0.8 or more of one text.
    sets += [np.unique(np.concatenate([own[draw.random(len(own)) > 0.03], draw.integers(0, 1 << 62, 8, dtype=np.uint64)])) for own in sets[:10]]
    often = np.zeros(1 << vptree.BUCKET_BITS, np.uint16)
    rows = [(f"{i:03d}", f"{i:03d}", len(h), vptree.prefix(h, often).view(np.int64).tolist(), bytearray(vptree.parity(h))) for i, h in enumerate(sets)]
    frame = spark.createDataFrame(rows, "key string, root string, n int, prefix array<long>, parity binary")
    partners = vptree.prefix_partners(frame)
    met = {(int(r["a"]), int(r["b"])) for r in partners.collect()}
    assert {(i, 150 + i) for i in range(10)} <= met
    assert joined_rows(partners._jdf.queryExecution().executedPlan()) <= 30 * len(sets)


def test_keys_may_be_bytes(spark):
    text = " ".join(f"w{i}" for i in range(100))
    frame = spark.createDataFrame([(b"\xff\x00", text), (b"\xfe\x80", text + " end"), (b"\x80", "other words")], "key binary, text string")
    assert {(bytes(r["a"]), bytes(r["b"])) for r in vptree.similar_texts(frame).collect()} == {(b"\xfe\x80", b"\xff\x00")}


def test_equals_the_exact_join_on_the_tables(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    table = spark.read.parquet(path)
    rows = [(r["doc_id"], r["text"] or "") for r in table.collect()]
    first = {}
    for i, text in sorted(rows):
        first.setdefault(text, i)
    texts = {i: t for t, i in first.items()}
    group = groups_of(texts, similar_pairs(texts))
    assert {r["doc_id"] for r in vptree.one_of_similar(table).collect()} == {i for i in texts if group[i] == i}
