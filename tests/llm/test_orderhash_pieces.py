import hashlib
import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import orderhash, pieces


def brute_order_minhash(text):
    """The definition of the fingerprint, element by element."""
    if not text:
        return [0] * orderhash.SLOTS
    k = min(orderhash.K, len(text))
    mask, mix = (1 << 64) - 1, lambda x: int(orderhash.mix64(np.array([x], np.uint64))[0])
    kmers = []
    for i in range(len(text) - k + 1):
        h = 0
        for c in text[i : i + k]:
            h = (h * int(orderhash.BASE) + ord(c) + 1) & mask
        kmers.append(mix(h))
    seen, ranked = Counter(), []
    for i, h in enumerate(kmers):
        ranked.append((mix((h + seen[h >> 24] * int(orderhash.GOLDEN)) & mask) >> 24 << 24 | i, i))
        seen[h >> 24] += 1
    ranked.sort()
    out = []
    for slot in range(orderhash.SLOTS):
        first = next((j for j, (r, _) in enumerate(ranked) if r >> 58 >= slot), len(ranked))
        places = sorted(ranked[(first + t) % len(ranked)][1] for t in range(orderhash.TUPLE))
        h = 0
        for p in places:
            h = mix((h * int(orderhash.BASE) + kmers[p]) & mask)
        out.append(h >> 48)
    return out


@pytest.mark.parametrize("text", ["", "a", "abc", "abababababababab", "The quick brown fox jumps over it. " * 3, "日本𝄞語é" * 5])
def test_order_minhash_by_definition(text):
    assert orderhash.order_minhash(text).tolist() == brute_order_minhash(text)


def test_order_counts():
    a, b = "alpha beta gamma delta " * 20, "one two three four five " * 20
    same_set = orderhash.likeness(orderhash.order_minhash(a + b), orderhash.order_minhash(b + a))
    edited = orderhash.likeness(orderhash.order_minhash(a + b), orderhash.order_minhash(a + b[:-20]))
    assert edited > same_set and orderhash.likeness(orderhash.order_minhash(a), orderhash.order_minhash(b)) < 0.1


def test_fingerprints_of_next_and_edited_text(docs, corpus, monkeypatch):
    monkeypatch.setattr(orderhash, "RANGE_ROWS", 9)  # several ranges
    rows = [r for r in corpus if r[0] is not None]
    got = {r["doc_id"]: r for r in orderhash.fingerprints(docs(rows)).collect()}
    assert len(got) == len(rows)
    text, ids = {i: t or "" for i, t, *_ in rows}, sorted(r[0] for r in rows)
    for n, i in enumerate(ids):
        following = text[ids[(n + 1) % len(ids)]]
        m = len(text[i]) // 4
        changed = text[i][: len(text[i]) - m] + following[:m]
        mine, other, last = (orderhash.order_minhash(t) for t in (text[i], changed, following))
        assert got[i]["n_chars"] == len(text[i])
        assert got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert got[i]["fingerprint"] == orderhash.shown(mine) and got[i]["edited_fingerprint"] == orderhash.shown(other)
        assert got[i]["near_edited"] == float((mine == other).mean()) and got[i]["near_next"] == float((mine == last).mean())


def test_null_and_equal_ids_and_single_rows(docs, corpus):
    assert orderhash.fingerprints(docs([])).count() == 0
    one = orderhash.fingerprints(docs([(5, "a lonely text here")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert orderhash.fingerprints(docs([(1, "a b"), (1, "a b"), (None, "c"), (2, None)])).count() == 4


needs_model = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no tokenizer files")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


TEXTS = ["", None, "a", "  the  cat\n\n sat ", "▁x ▁", "日本𝄞語\n x\t", "\u0000\r\n", "a" * 3000, "The quick brown fox."]


@needs_model
def test_every_sample_decodes_to_its_text(vocabulary):
    rows = pieces.Encoder(vocabulary, 4, 1).encode(list(range(len(TEXTS))), TEXTS)
    for i, text in enumerate(TEXTS):
        own = [r for r in rows if r[0] == i]
        assert own and all(pieces.decode(r[5].tolist(), vocabulary) == (text or "") for r in own)
        assert len({tuple(r[5].tolist()) for r in own}) == len(own)
        assert [r[1] for r in own] == list(range(len(own)))
        assert all(a[3] > b[3] for a, b in zip(own, own[1:], strict=False))


def test_split_follows_the_rule():
    import random

    draw = random.Random(6)
    for _ in range(3000):
        text = "".join(draw.choice(["a", "bc", " ", " ", "\n", "\n\n", "\t", "\uffff"][: draw.choice([4, 6, 8])]) for _ in range(draw.randint(0, 9)))
        assert [pieces.chunk_text(c) for c in pieces.split(text)] == (pieces.CHUNKS.findall(" " + text) if text else [])


def all_segmentations(text, vocabulary):
    """Log-probability of every segmentation, by recursion over pieces."""
    ids = {p: i for i, p in vocabulary.text_of.items()}
    out = {}

    def walk(at, path, weight):
        if at == len(text):
            out[tuple(path)] = weight
        for end in range(at + 1, len(text) + 1):
            i = ids.get(text[at:end])
            if i is not None:
                walk(end, [*path, i], weight + vocabulary.log_weight[i])

    walk(0, [], 0.0)
    total = math.log(sum(map(math.exp, out.values())))
    return {k: v - total for k, v in out.items()}


@needs_model
def test_scores_and_chances_match_enumeration(vocabulary):
    exact = all_segmentations("▁the▁cat", vocabulary)
    every = pieces.Encoder(vocabulary, 10_000, 3).encode([0], ["the cat"])
    found = {tuple(r[5].tolist()) for r in every}
    assert len(found) == len(every) and found <= set(exact)
    assert sum(math.exp(v) for k, v in exact.items() if k not in found) < 1e-10
    for r in every:
        assert r[2] == pytest.approx(exact[tuple(r[5].tolist())], abs=1e-9) and r[4] == 0.0
    n, first, inside = 6000, Counter(), Counter()
    for r in pieces.Encoder(vocabulary, 2, 9).encode(list(range(n)), ["the cat"] * n):
        first[tuple(r[5].tolist())] += r[1] == 0
        inside[tuple(r[5].tolist())] += 1
    chance = {k: math.exp(v) for k, v in exact.items()}
    for k in sorted(chance, key=chance.get)[-4:]:
        among = chance[k] + sum(chance[j] * chance[k] / (1 - chance[j]) for j in chance if j != k)
        assert abs(first[k] / n - chance[k]) < 4.5 * math.sqrt(chance[k] * (1 - chance[k]) / n)
        assert abs(inside[k] / n - among) < 4.5 * math.sqrt(among * (1 - among) / n)


@needs_model
def test_kept_lattices_change_nothing(vocabulary):
    texts = ["the cat sat on the mat", "the dog and the cat", "another one"]
    encoder = pieces.Encoder(vocabulary, 3, 5)
    apart = [tuple(r[5].tolist()) for i, t in enumerate(texts) for r in encoder.encode([i], [t])]
    assert apart == [tuple(r[5].tolist()) for r in pieces.Encoder(vocabulary, 3, 5).encode([0, 1, 2], texts)]


@needs_model
def test_samples_depend_on_row_and_seed_only(docs, corpus):
    def run(rows):
        return {(r["doc_id"], r["sample"]): (r["log_prob"], r["pieces"]) for r in pieces.sampled_segmentations(docs(rows)).collect()}

    assert run(corpus) == run(corpus[::-1])
    assert pieces.sampled_segmentations(docs([])).count() == 0
    assert pieces.sampled_segmentations(docs([(1, None), (1, None)])).count() == 2


def test_decoding_gives_every_text_back(spark, docs, corpus):
    known = {i: t for i, t, *_ in corpus if i is not None and i != 70}
    frame = docs([r for r in corpus if r[0] in known])
    samples = pieces.sampled_segmentations(frame)
    out = pieces.decoded(samples.withColumn("text", F.lit("clash")))
    assert out.columns == [*samples.columns, "text"]
    rows = out.collect()
    assert {r["doc_id"] for r in rows} == set(known)
    assert all(r["text"] == (known[r["doc_id"]] or "") for r in rows)
    assert pieces.decoded(samples.filter("doc_id = -5")).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id long, pieces array<int>")
    assert pieces.decoded(none).first()["text"] == ""
