import zlib

import pytest

from barloom.llm import mixing, sharding


def water(sizes, ratio=1.5, cap=2.0):
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    goal, capped = ratio * sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in capped]
        rest = goal - sum(cap * sizes[s] for s in capped)
        over = [s for s in free if rest * weight[s] / sum(weight[x] for x in free) > cap * sizes[s]]
        if not over:
            return {s: cap * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in sizes}
        capped |= set(over)


def test_targets_and_words_taken(docs, corpus):
    got = mixing.mix(docs(corpus)).collect()
    assert len(got) == len(corpus)
    sizes, taken = {}, {}
    for r in got:
        assert r["size"] == len((r["text"] or "").encode().split())
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    targets = water(sizes)
    for r in got:
        assert r["target"] == pytest.approx(targets[r["source"]]) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
    again = {(r["doc_id"], r["text"]): r["taken"] for r in mixing.mix(docs(corpus[::-1])).collect()}
    assert again == {(r["doc_id"], r["text"]): r["taken"] for r in got}


def test_repeated_rows_share_the_part_at_the_cut(docs):
    rows = [(1, "a b c d e f g", "en", "s")] * 6 + [(2, "x", "en", "t")]
    got = mixing.mix(docs(rows)).collect()
    assert len({r["taken"] for r in got if r["doc_id"] == 1}) == 1
    assert all(r["taken"] <= 2 * r["size"] for r in got)


def test_mixture_repeats_documents(docs, corpus):
    mixed = {}
    rows = mixing.mixed_documents(docs(corpus))
    assert rows.columns == [c for c in docs(corpus).columns if c != "size"]
    for r in rows.collect():
        mixed[r["doc_id"]] = mixed.get(r["doc_id"], 0) + len((r["text"] or "").encode().split())
    for r in mixing.mix(docs(corpus)).collect():
        assert mixed.get(r["doc_id"], 0) == r["taken"]


def test_shards_are_level_and_keep_equal_texts(docs, corpus):
    rows = [(i, f"{t} {i % 300}", "en" if i % 2 else None, f"s{i % 5}") for i, t in enumerate("word " * (i % 40) for i in range(1200))]
    got = sharding.kd_shards(docs(rows), shards=6, slots_of=50).collect()
    text = {i: t for i, t, *_ in rows}
    loads, slots, homes = {}, {}, {}
    for r in got:
        assert (r["size"], r["text_crc32"]) == (len(text[r["doc_id"]].encode()) + 8, zlib.crc32(text[r["doc_id"]].encode()))
        assert r["law"] == "bytes" and r["grown_shard"] is None
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        homes.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert sorted(loads) == list(range(6)) and max(loads.values()) < 1.1 * min(loads.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    assert len(sharding.kd_shards(docs(corpus)).collect()) == len(corpus)


def test_a_group_too_large_for_a_shard_is_cut(docs):
    rows = [(i, "the same text over and over") for i in range(400)] + [(400 + i, f"text {i}" * 3) for i in range(600)]
    loads = {}
    for r in sharding.kd_shards(docs(rows), shards=8).collect():
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
    assert len(loads) == 8 and max(loads.values()) < 1.2 * min(loads.values())


def test_one_text_only_and_empty_tables(docs):
    assert mixing.mix(docs([])).count() == 0 and mixing.mixed_documents(docs([])).count() == 0
    assert sharding.kd_shards(docs([])).count() == 0
    assert sharding.kd_shards(docs([(1, None), (1, None), (None, "")])).count() == 3
    assert sorted(r["taken"] for r in mixing.mix(docs([(1, None), (2, "")])).collect()) == [0, 0]
