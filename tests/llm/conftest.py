import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size long, print string, shard string"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) with columns whose names clash with results."""

    def make(rows):
        full = [(*r, *("en", "a")[len(r) - 2 :])[:4] for r in rows]
        return spark.createDataFrame([(*r, len(r[1] or ""), "x", -1, "y", "z") for r in full], SCHEMA)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Nulls, empties, ties, copies, near copies, shared passages, a long text and blanks of all kinds."""
    draw = random.Random(5)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of"]

    def words(n):
        return ["".join(draw.choices(syllables, k=draw.randint(1, 3))) for _ in range(n)]

    passage, long_one = words(70), words(6000)
    rows = [(0, None), (1, ""), (2, " \t\n\x0b\x0c\r"), (3, "one two"), (4, "one two"), (5, "naïve ▁ Ⅷ 日本 𝄞 x y")]
    for i in range(6, 40):
        body = words(draw.randint(1, 160))
        if i % 3 == 0:
            body[len(body) // 2 : len(body) // 2] = passage
        rows.append((i, draw.choice([" ", "\n", "  "]).join(body)))
    near = words(300)
    for i in range(40, 60):
        own = list(near)
        own[draw.randrange(300)] = "changed"
        rows.append((i, " ".join(own)))
    rows += [(60 + i, " ".join(near)) for i in range(8)]
    rows += [(70, " ".join(long_one)), (71, " ".join(long_one[100:3000])), (None, "no id " + " ".join(passage)), (72, "x" * 5000)]
    return [(i, t, draw.choice(["en", "de", None]), draw.choice(["a", "a", "a", "b", None])) for i, t in rows]
