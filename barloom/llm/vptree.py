"""SimHash near-duplicates by vantage-point trees over Hamming space.

1. ``fingerprints``: 64 majority bits over the XXH64 of 3-word shingles of the whole text.
2. Equal fingerprints become one node before anything else, so copies never meet as pairs.
3. A tree of vantage points, fitted on a bounded sample of nodes, parts Hamming space: at each
   vantage point a node goes inside (distance <= radius) or outside. Its leaves are the shards.
4. Every node is stored in one shard and queried in each shard that its ball of ``bits`` reaches:
   by the triangle inequality a branch is left out if distance - bits > radius, or
   distance + bits <= radius. That finds every pair exactly, whatever the sample.
5. Within a shard a second tree prunes the same way down to leaves of 32 nodes. A shard hands on
   the edges of its spanning forest only, so a group of near copies gives a line for each node,
   not for each pair.
6. ``components``: alternating large and small stars over these edges until nothing changes.

The only rows on the driver are the sample (``SAMPLE_PER_SHARD`` times the shards, 2**18 at most).

``one_of_similar`` is the dedup of the pipeline: texts whose 5-word shingles have a Jaccard similarity of 0.8 or
more. At 0.8 two prints differ in about 10 of 64 bits, and balls of that radius reach nearly every leaf of any
tree, so the trees give candidates at ``BITS`` and 20 bands of 5 min-hashes of the same shingles give more. Each member of a
band meets the band's least text; each candidate is confirmed on the shingles themselves. That joins nearly all; what it leaves
apart is exact: texts of different components that share one of the n / 5 + 1 first shingles of their sets, in one order of all
shingles, meet (``prefix_partners``). Any order is right; seldom shingles come first, as counted on a bounded sample. Only shingles that
two texts put first go on, those of the same texts as one; sizes, places and parities of the sets decide in the join itself, so that
it gives about the pairs that are similar. Within a group of texts that share a passage all pairs are still compared.
Null ids take part by their texts.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other; fewer
than three words are one shingle; repeated rows and equal texts share a component; a null ``doc_id``
names no component unless all ids of the component are null (then null); empty tables give empty
results; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import GOLDEN, arrow_map, matched, mix64
from barloom.session import cut_lineage, stored

BITS = 2
SHINGLE = 3
SEED = 42
#: Nodes a shard stores, about, and sampled nodes per shard for its vantage points.
SHARD_NODES = 16_384
SAMPLE_PER_SHARD = 64
MOST_SAMPLED = 1 << 18
LEAF = 32
#: Shingles whose bits are counted at once: bounds memory for very long texts.
CHUNK = 1 << 16
#: Similarity of the pipeline's near copies, on shingles of so many words.
SIMILAR = 0.8
SIMILAR_SHINGLE = 5
BANDS = 20
BAND_ROWS = 5
#: Shingles whose min-hashes are taken at once.
HASH_CHUNK = 1 << 12
#: Tasks over which the members of one band, or the partners of one text, are dealt; and the partners from which a text is.
SALTS = 16
MANY_PARTNERS = 256
#: Pairs of ``prefix_partners`` up to which the keys of their texts are broadcast.
FEW_PAIRS = 1 << 17
#: Min-hashes by which ``rare_partners`` meet, and how many of them, the rarest first, a text uses.
SIGNATURE = BANDS * BAND_ROWS
RAREST = 16
#: Texts on which the order of shingles is fitted, bits of a shingle's bucket, and how often a bucket must be met there to come later.
SAMPLED_TEXTS = 1 << 14
BUCKET_BITS = 22
SELDOM = 6
#: Bits of a set's parity, at least.
PARITY_BITS = 512


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle; fewer words than ``shingle`` are one, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def majority_bits(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[a : a + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the shingles' XXH64; 0 without words."""
    return majority_bits(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, print (the 64 bits as a signed long)."""

    def run(batch: dict) -> dict:
        prints = np.fromiter((simhash(t, shingle) for t in batch["text"].to_pylist()), np.uint64)
        return {"doc_id": batch["doc_id"], "print": prints.view(np.int64)}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, print long")


class Tree:
    """A vantage-point tree in arrays: point and radius per inner node, children after it, leaves numbered."""

    def __init__(self, points: np.ndarray, depth: int, leaf: int) -> None:
        self.point, self.radius, self.inside, self.outside, self.leaves = [], [], [], [], 0
        self.members: list[np.ndarray] = []
        self.root = self._grow(points, np.arange(len(points)), depth, leaf)

    def _grow(self, points: np.ndarray, own: np.ndarray, depth: int, leaf: int) -> int:
        if depth > 0 and len(own) > leaf:
            # Of a few candidates, the vantage point with the widest spread of distances prunes most.
            tried = points[own[:: max(1, len(own) // 5)][:5]]
            spans = [np.bitwise_count(points[own] ^ p).astype(np.int16) for p in tried]
            best = max(range(len(tried)), key=lambda i: spans[i].std())
            far, radius = spans[best], int(np.median(spans[best]))
            radius = radius if (far > radius).any() else radius - 1
            within = far <= radius
            if within.any() and not within.all():
                k = len(self.point)
                self.point.append(tried[best])
                self.radius.append(radius)
                self.inside.append(0)
                self.outside.append(0)
                self.inside[k] = self._grow(points, own[within], depth - 1, leaf)
                self.outside[k] = self._grow(points, own[~within], depth - 1, leaf)
                return k
        self.leaves += 1
        self.members.append(own)
        return -self.leaves

    def route(self, prints: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, indices of the prints whose ball of ``bits`` reaches it); bits 0 gives the home leaf."""
        todo = [(self.root, np.arange(len(prints)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -node - 1, rows
                continue
            far = np.bitwise_count(prints[rows] ^ self.point[node]).astype(np.int16)
            todo.append((self.inside[node], rows[far - bits <= self.radius[node]]))
            todo.append((self.outside[node], rows[far + bits > self.radius[node]]))


def near_pairs(stored: np.ndarray, asked: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (asked, stored) of all pairs within ``bits`` whose asked print is the smaller one."""
    tree = Tree(stored, 64, LEAF)
    for leaf, rows in tree.route(asked, bits):
        own = tree.members[leaf]
        for a in range(0, len(rows), CHUNK):
            part = rows[a : a + CHUNK]
            close = np.bitwise_count(asked[part][:, None] ^ stored[own][None, :]) <= bits
            i, j = np.nonzero(close & (asked[part][:, None] < stored[own][None, :]))
            if len(i):
                yield part[i], own[j]


def _forest(a: np.ndarray, b: np.ndarray, parent: dict[int, int]) -> None:
    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """``nodes`` (print, distinct) -> edges (a, b) that connect what lies within ``bits``, as a forest per shard."""
    count = nodes.count()
    depth = max(0, math.ceil(math.log2(max(1, count) / SHARD_NODES)))
    size = min(MOST_SAMPLED, SAMPLE_PER_SHARD << depth)
    picked = nodes.orderBy(F.xxhash64("print"), "print").limit(size).collect()
    sample = np.array([r["print"] for r in picked], dtype=np.int64).view(np.uint64)
    tree = Tree(sample, depth, 1)

    def route(batch: dict) -> dict:
        prints = batch["print"].to_numpy().view(np.uint64)
        home = np.full(len(prints), -1)
        for leaf, rows in tree.route(prints, 0):
            home[rows] = leaf
        shard, asked = [home], [np.arange(len(prints))]
        for leaf, rows in tree.route(prints, bits):
            away = rows[home[rows] != leaf]
            shard.append(np.full(len(away), leaf))
            asked.append(away)
        rows, shards = np.concatenate(asked), np.concatenate(shard)
        return {"shard": shards, "print": prints[rows].view(np.int64), "stored": home[rows] == shards}

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        prints = pdf["print"].to_numpy().view(np.uint64)
        stored = prints[pdf["stored"].to_numpy()]
        parent: dict[int, int] = {}
        for a, b in near_pairs(stored, prints, bits):
            _forest(prints[a], stored[b], parent)
        found = []
        for x in parent:
            r = x
            while parent[r] != r:
                r = parent[r]
            if r != x:
                found.append((r, x))
        edges = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})

    routed = arrow_map(nodes.select("print"), route, "shard int, print long, stored boolean")
    return routed.groupBy("shard").applyInPandas(pairs, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (node, root): the smallest node of each component; roots themselves are left out."""
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct())
    state = None
    while True:
        both = edges.union(edges.select("root", "node"))
        least = both.groupBy("node").agg(F.min("root").alias("least"))
        large = (
            both.join(least, "node")
            .filter(F.col("root") > F.col("node"))
            .select(F.col("root").alias("node"), F.least("least", "node").alias("root"))
            .distinct()
        )
        least = large.groupBy("node").agg(F.min("root").alias("least"))
        small = large.join(least, "node").select(
            F.explode(F.array(F.struct("node", F.col("least").alias("root")), F.struct(F.col("root").alias("node"), F.col("least").alias("root")))).alias("e")
        )
        edges = cut_lineage(small.select("e.*").filter(F.col("node") != F.col("root")).distinct())
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            return edges
        state = tuple(seen)


def components(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the component)."""
    prints = cut_lineage(fingerprints(docs, shingle))
    nodes = cut_lineage(prints.groupBy("print").agg(F.min("doc_id").alias("least_id")))
    roots = connected(links(nodes, bits))
    named = cut_lineage(
        nodes.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    )
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = named.join(ids, "root").select("print", "component_id")
    return prints.join(of, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """The document with the smallest id of each component, once; rows without an id stay as they are."""
    kept = components(docs, bits, shingle).filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.filter(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


ODD = mix64(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)
SHIFT = mix64(np.arange(1001, BANDS * BAND_ROWS + 1001, dtype=np.uint64) * GOLDEN)


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The min-hash of the shingles under each permutation."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for a in range(0, len(hashes), HASH_CHUNK):
        np.minimum(least, (hashes[a : a + HASH_CHUNK, None] * ODD + SHIFT).min(axis=0), out=least)
    return least


def band_keys(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Keys under which similar texts meet: the bands of min-hashes, and the print itself."""
    least = least_hashes(hashes)
    rows = [row.tobytes() for row in least.reshape(BANDS, BAND_ROWS)] + [bits.to_bytes(8, "little")]
    return np.array([xxhash.xxh64_intdigest(row, k) for k, row in enumerate(rows)], np.uint64).view(np.int64)


def shingles(text: str | None, shingle: int = SIMILAR_SHINGLE) -> set[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}


def similarity(a: str | None, b: str | None) -> float:
    """Exact Jaccard similarity of the 5-word shingles."""
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def similar_texts(texts: DataFrame) -> DataFrame:
    """``texts`` (key, text; a key names one text) -> edges (a, b) of texts at ``SIMILAR`` or more, whose components are those of all such pairs."""
    often = frequent_shingles(texts)

    def keyed(batch: dict) -> dict:
        own = [shingle_hashes(t, SIMILAR_SHINGLE) for t in batch["text"].to_pylist()]
        prints = [majority_bits(h) for h in own]
        bands = [band_keys(h, p) for h, p in zip(own, prints, strict=True)]
        flat = pa.array(np.concatenate(bands))
        lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, BANDS + 1, dtype=np.int32), flat)
        sets = [np.unique(h) for h in own]
        prefixes = [prefix(h, often) for h in sets]
        ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
        return {
            "key": batch["key"],
            "print": np.array(prints, np.uint64).view(np.int64),
            "bands": lists,
            "n": [len(h) for h in sets],
            "prefix": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(prefixes).view(np.int64))),
            "parity": [parity(h) for h in sets],
        }

    schema = f"key {kind_of(texts)}, print long, bands array<long>, n int, prefix array<long>, parity binary"
    keys = stored(arrow_map(texts, keyed, schema).dropDuplicates(["key"]), "zstd")
    rows = keys.select("key", F.explode("bands").alias("band"))
    stars = rows.groupBy("band").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter(F.col("first") < F.col("last"))
    met = _salted(rows, stars.drop("last"), "band", "key").filter(F.col("key") != F.col("first"))
    met = met.select(F.col("first").alias("a"), F.col("key").alias("b"))
    nodes = cut_lineage(keys.groupBy("print").agg(F.min("key").alias("key")))
    tree = (
        links(nodes.select("print"))
        .join(nodes.select(F.col("print").alias("a"), "key"), "a")
        .join(nodes.select(F.col("print").alias("b"), F.col("key").alias("other")), "b")
        .filter(F.col("key") != F.col("other"))
        .select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"))
    )
    edges = cut_lineage(_confirmed(met.union(tree).distinct(), texts))
    roots = connected(edges)
    return edges.union(_confirmed(_partners(keys, roots.withColumnRenamed("node", "key")), texts, FEW_PAIRS))


def kind_of(texts: DataFrame) -> str:
    """The type of the keys."""
    return texts.schema["key"].dataType.simpleString()


def _salted(rows: DataFrame, one: DataFrame, on: str, by: str) -> DataFrame:
    """``rows`` joined with ``one``, which has a row per ``on``; rows of one key are dealt out by ``by``."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    copies = one.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies, [on, "salt"]).drop("salt")


def _confirmed(pairs: DataFrame, texts: DataFrame, few: int = 0) -> DataFrame:
    """The pairs (a, b) of keys whose texts are similar. The keys of ``few`` pairs or less are broadcast, which spares a shuffle of all texts."""
    pairs = cut_lineage(pairs)
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    keys = F.broadcast(keys) if few and pairs.count() <= few else keys
    needed = stored(texts.join(keys, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")), "zstd")
    # Only texts with many partners are copied for several tasks.
    many = F.broadcast(pairs.groupBy("a").count().filter(F.col("count") > MANY_PARTNERS).select("a", F.lit(SALTS - 1).cast("long").alias("salts")))
    dealt = pairs.join(many, "a", "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.lit(SALTS)))).drop("salts")
    left = needed.join(pairs.select(F.col("a").alias("key")).distinct(), "key", "left_semi").select(F.col("key").alias("a"), F.col("text").alias("x"))
    left = left.join(many, "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(0).cast("long"))))).drop("salts")
    both = dealt.join(left, ["a", "salt"]).drop("salt")
    both = both.join(needed.select(F.col("key").alias("b"), F.col("text").alias("y")), "b")

    def confirmed(batch: dict) -> dict:
        near = [similarity(x, y) >= SIMILAR for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True)]
        return {name: batch[name].filter(pa.array(near, pa.bool_())) for name in ("a", "b")}

    return arrow_map(both.select("a", "b", "x", "y"), confirmed, f"a {kind_of(texts)}, b {kind_of(texts)}")


def frequent_shingles(texts: DataFrame) -> np.ndarray:
    """How often shingles occur in a sample of about ``SAMPLED_TEXTS`` texts, by ``BUCKET_BITS`` of their hash; seldom ones count as 0."""
    some = texts.filter(F.pmod(F.xxhash64("key"), F.lit(max(1, texts.count()))) < SAMPLED_TEXTS)

    def counted(batch: dict) -> dict:
        own = [np.unique(shingle_hashes(t, SIMILAR_SHINGLE)) for t in batch["text"].to_pylist()]
        buckets, times = np.unique(np.concatenate(own) >> np.uint64(64 - BUCKET_BITS), return_counts=True)
        return {"bucket": buckets.astype(np.int64), "times": times}

    found = arrow_map(some.dropDuplicates(["key"]), counted, "bucket long, times long")
    found = found.groupBy("bucket").agg(F.sum("times").alias("times")).filter(F.col("times") >= SELDOM).toPandas()
    often = np.zeros(1 << BUCKET_BITS, np.uint16)
    often[found["bucket"].to_numpy(np.int64)] = np.minimum(found["times"].to_numpy(np.int64), np.iinfo(np.uint16).max)
    return often


def prefix(own: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The shingles, seldom ones first, of which two sets at ``SIMILAR`` share one: 4/5 of a set are common, so one of any 1/5 + 1 is."""
    times = often[(own >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
    return own[np.lexsort((own, times))][: len(own) // 5 + 1]


def parity(own: np.ndarray) -> bytes:
    """Whether an odd number of shingles falls on each bit; a bit or more for two shingles, ``PARITY_BITS`` at least."""
    bits = PARITY_BITS
    while bits * 2 < len(own):
        bits *= 2
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two parities differ: at most the number of shingles that only one of the sets has."""
    short, long = sorted((a, b), key=len)
    x = int.from_bytes(long, "little")
    for size in (len(long) >> k for k in range(1, (len(long) // len(short)).bit_length())):
        x = (x >> 8 * size) ^ (x & (1 << 8 * size) - 1)
    return (x ^ int.from_bytes(short, "little")).bit_count()


def _differing(x: Column, y: Column) -> Column:
    """``differing`` of two parities in longs, the longer at most twice as long."""
    def half(p: Column) -> Column:
        size = (F.size(p) / 2).cast("int")
        return F.zip_with(F.slice(p, 1, size), F.slice(p, size + 1, size), lambda a, b: a.bitwiseXOR(b))

    a, b = F.when(F.size(x) > F.size(y), half(x)).otherwise(x), F.when(F.size(y) > F.size(x), half(y)).otherwise(y)
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, n: total + n)


def prefix_partners(texts: DataFrame) -> DataFrame:
    """(key, root, n, prefix, parity) -> pairs (a, b) of texts of different roots that may be similar; no similar pair is left out.

    Similar sets share a shingle of their prefixes, and their sizes, the places of the first one they share and the bits
    of their parities allow a similarity of 4/5: common >= 4/9 of both sizes, so at most 1/9 lies in one set only.
    """
    return _partners(texts, texts.select("key", "root"))


def _partners(texts: DataFrame, roots: DataFrame) -> DataFrame:
    """``prefix_partners`` of ``texts`` (key, n, prefix, parity), whose root is their key unless ``roots`` (key, root) names another.

    A shingle that one text alone, or texts of one root alone, put first joins nothing. Shingles that the same texts put first join the
    same pairs, so they are one (by the XOR of the texts' hashes; lists that agree in it by chance only give more pairs).
    """
    ident = F.xxhash64("key").alias("id")
    places = texts.select(ident, F.posexplode("prefix").alias("at", "shingle"))
    alike = Window.partitionBy("shingle")
    shared = places.select("*", F.min("id").over(alike).alias("_lo"), F.max("id").over(alike).alias("_hi")).filter("_lo < _hi").select("id", "at", "shingle")
    named = texts.select("key", "n").join(roots, "key", "left").select(ident, "n", F.xxhash64(F.coalesce("root", "key")).alias("root"))
    rooted = shared.join(named, "id")
    lists = [F.min("root").over(alike).alias("_lo"), F.max("root").over(alike).alias("_hi"), F.bit_xor(F.xxhash64("id")).over(alike).alias("ids")]
    rooted = rooted.select("*", *lists).filter("_lo < _hi")
    rooted = stored(rooted.groupBy("ids", "id", "root", "n").agg(F.min("at").alias("at")))

    def in_longs(batch: dict) -> dict:
        own = [np.frombuffer(p, "<i8") for p in batch["parity"].to_pylist()]
        ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
        return {"id": batch["id"], "parity": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(own)))}

    needed = texts.select(ident, "parity").join(rooted.select("id").distinct(), "id", "left_semi")
    listed = rooted.join(arrow_map(needed, in_longs, "id long, parity array<long>"), "id")
    x, y = (listed.select(*[F.col(c).alias(f"{c}_{side}") for c in ("ids", "at", "id", "root", "n", "parity")]) for side in "xy")
    both = F.col("n_x") + F.col("n_y")
    left = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    possible = (F.col("id_x") < F.col("id_y")) & (F.col("root_x") != F.col("root_y")) & (9 * left >= 4 * both)
    met = x.join(y, (F.col("ids_x") == F.col("ids_y")) & possible & (9 * _differing(F.col("parity_x"), F.col("parity_y")) <= both))
    met = met.select("id_x", "id_y").distinct()
    a, b = (texts.select(F.xxhash64("key").alias(f"id_{side}"), F.col("key").alias(f"key_{side}")) for side in "xy")
    pairs = met.join(a, "id_x").join(b, "id_y")
    return pairs.select(F.least("key_x", "key_y").alias("a"), F.greatest("key_x", "key_y").alias("b"))


def rare_partners(texts: DataFrame) -> DataFrame:
    """(key, text, root) -> pairs (a, b) of texts of different roots that share rare min-hashes.

    Of two texts at ``SIMILAR`` four in five of ``SIGNATURE`` min-hashes agree. What a family shares is frequent and tells its members not
    apart; each text therefore takes its ``RAREST`` min-hashes that occur under several roots, and meets the texts with the
    least and the greatest root there. The number of pairs grows with the number of texts only, but links are lost:
    ``similar_texts`` meets by ``prefix_partners`` instead.
    """

    def signed(batch: dict) -> dict:
        own = [least_hashes(shingle_hashes(t, SIMILAR_SHINGLE))[:SIGNATURE] for t in batch["text"].to_pylist()]
        tokens = mix64(np.stack(own) + np.arange(SIGNATURE, dtype=np.uint64) * GOLDEN).view(np.int64)
        return {**{c: np.repeat(batch[c].to_numpy(), SIGNATURE) for c in ("id", "root")}, "token": tokens.ravel()}

    ids = cut_lineage(texts.select(F.xxhash64("key").alias("id"), "key"))
    rows = texts.select(F.xxhash64("key").alias("id"), F.xxhash64("root").alias("root"), "text")
    rows = stored(arrow_map(rows, signed, "id long, root long, token long"))
    place = F.struct("root", "id")
    often = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("times"), F.min(place).alias("first"), F.max(place).alias("last"))
    shared = matched(rows, stored(often.filter("first.root < last.root")), ["token"])
    rank = F.row_number().over(Window.partitionBy("id").orderBy("times", "token"))
    rare = shared.withColumn("_rank", rank).filter(F.col("_rank") <= RAREST)
    met = rare.select("id", "root", F.explode(F.array("first", "last")).alias("other")).filter(F.col("root") != F.col("other.root"))
    met = met.select(F.least("id", "other.id").alias("x"), F.greatest("id", "other.id").alias("y")).distinct()
    named = met.join(ids.select(F.col("id").alias("x"), F.col("key").alias("k")), "x").join(ids.select(F.col("id").alias("y"), F.col("key").alias("other")), "y")
    return named.select(F.least("k", "other").alias("a"), F.greatest("k", "other").alias("b")).distinct()


def one_of_similar(docs: DataFrame) -> DataFrame:
    """One row of each component of similar texts: the one with the smallest id, a null id only if there is no other."""
    key = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    named = docs.select(F.col("doc_id").cast("long").alias("id"), key.alias("key"), "text")
    roots = connected(similar_texts(named.select("key", "text")))
    of = named.groupBy("key").agg(F.min("id").alias("id")).join(roots.withColumnRenamed("node", "key"), "key", "left")
    # Ids first, so that a null id wins only among null ids; of equal ids the least key.
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best")
    best = of.groupBy(F.coalesce("root", "key").alias("root")).agg(best)
    # Joined and made distinct by the same columns, so that the rows are shuffled once; a key has one id.
    one = {"__near_key": F.col("best.key"), "__near_none": F.col("best.none"), "__near_id": F.coalesce("best.id", F.lit(0).cast("long"))}
    ident = F.col("doc_id").cast("long")
    placed = docs.withColumns({"__near_key": key, "__near_none": ident.isNull(), "__near_id": F.coalesce(ident, F.lit(0).cast("long"))})
    return placed.join(best.select(*[c.alias(name) for name, c in one.items()]), list(one)).dropDuplicates(list(one)).select(*docs.columns)
