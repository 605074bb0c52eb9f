"""K-d tree partitioning of documents into shards of near equal bytes; DataFrame functions only.

Rows are pre-aggregated to groups of equal texts, with metadata (size of a row, language, source, first
doc_id) as dimensions. A node of the tree is a box with a number of leaves; it is split along its
widest dimension, in shares of the dimension's whole extent, at the weighted quantile that
leaves each side the bytes of its leaves. Quantiles come from histograms that are refined where the goal
lies, five rounds at most, so a level is a few small aggregations over the groups and nothing is
sorted in one task. What the driver holds is one row per node.

Groups of more than an eighth of a leaf's bytes (under 8 per leaf by counting, so their number is
bounded) would spoil any split: they go to the emptiest shard first, largest first, and the tree
gives each leaf what is left of its target. A group over 1.25 targets can't be kept whole at equal
sizes and is cut into pieces by a hash of the doc_id; all other equal texts share a shard.

Defined cases: a null text has size 8 and checksum 0; null languages, sources and ids come
first in their dimension; repeated rows share a shard and have slots of their own; empty tables
give empty results; columns other than doc_id, text, lang and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.session import cut_lineage

DIMENSIONS = ("size", "lang", "source", "first_id")
#: Histogram bins a round.
BINS = 4096
#: A coordinate is a dimension's share of its extent in 2**20 steps, then 2**30 of a hash that parts ties.
STEP_BITS, TIE_BITS = 20, 30
SPAN = 1 << (STEP_BITS + TIE_BITS)
HEAVY_SHARE = 8
SPLIT_ABOVE = 1.25
#: Rows a slot window holds, about.
SLOT_ROWS = 65_536


def _order_code(column: str) -> Column:
    """A number that follows the order of the first six bytes of a string; null is -1."""
    head = F.rpad(F.hex(F.substring(F.encode(F.col(column), "UTF-8"), 1, 6)), 12, "0")
    return F.coalesce(F.conv(head, 16, 10).cast("double"), F.lit(-1.0))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        _order_code("lang").alias("lang"),
        _order_code("source").alias("source"),
    )


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("text_hash", "size", "text_crc32").agg(
        F.count(F.lit(1)).alias("rows"),
        (F.sum("size")).alias("weight"),
        F.min("lang").alias("lang"),
        F.min("source").alias("source"),
        F.min("doc_id").alias("first_id"),
    )


def kd_shards(docs: DataFrame, shards: int = 24, slots_of: int = SLOT_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: sizes decide, not keys)."""
    rows = cut_lineage(_rows(docs))
    groups = cut_lineage(_groups(rows))
    placed = _place(rows, groups, shards)
    key = ["text_hash", "size", "text_crc32"]
    sharded = rows.join(placed, key).select("doc_id", "size", "text_crc32", F.element_at("targets", _piece() + 1).alias("shard"))
    return with_slots(sharded, slots_of).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def with_slots(sharded: DataFrame, slots_of: int) -> DataFrame:
    """Number each shard's rows from 0, by hash bucket and doc_id; only bucket counts are accumulated per shard."""
    sharded = cut_lineage(sharded)
    buckets = max(1, sharded.count() // slots_of)
    sharded = sharded.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    counts = sharded.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    starts = counts.select("shard", "bucket", before.alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    return sharded.join(starts, ["shard", "bucket"]).withColumn("slot", (F.col("start") + rank - 1).cast("long"))


def _piece() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("pieces")).cast("int")


def _place(rows: DataFrame, groups: DataFrame, shards: int) -> DataFrame:
    """Per group key: the pieces it is cut into and the shard of each."""
    key = ["text_hash", "size", "text_crc32"]
    total = groups.agg(F.sum("weight")).first()[0] or 0
    target = total / shards
    # Weights add up to the total, so at most HEAVY_SHARE * shards groups are heavy.
    heavy = groups.filter(F.col("weight") > target / HEAVY_SHARE).collect()
    pieces_of = {
        tuple(g[k] for k in key): 1 if g["weight"] <= SPLIT_ABOVE * target else min(g["rows"], int(g["weight"] * HEAVY_SHARE / target) + 1)
        for g in heavy
    }
    spark = groups.sparkSession
    items = [(g["weight"], tuple(g[k] for k in key), 0) for g in heavy if pieces_of[tuple(g[k] for k in key)] == 1]
    if cut := [(*k, n) for k, n in pieces_of.items() if n > 1]:
        table = spark.createDataFrame(cut, "text_hash long, size long, text_crc32 long, pieces int")
        weights = rows.join(F.broadcast(table), key).groupBy(*key, _piece().alias("piece")).agg(F.sum("size").alias("w"))
        items += [(r["w"], tuple(r[k] for k in key), r["piece"]) for r in weights.collect()]
    loads, homes = [0.0] * shards, {k: [0] * n for k, n in pieces_of.items()}
    for weight, k, piece in sorted(items, key=lambda x: (-x[0], x[1:])):
        homes[k][piece] = least = min(range(shards), key=lambda i: (loads[i], i))
        loads[least] += weight
    heavy_rows = [(*k, pieces_of[k], shards_) for k, shards_ in homes.items()]
    rest = _boxed(groups.filter(F.col("weight") <= target / HEAVY_SHARE))
    wants = _levelled(loads, total)
    light = _split(rest, wants).select(*key, F.lit(1).alias("pieces"), F.array("shard").alias("targets"))
    schema = "text_hash long, size long, text_crc32 long, pieces int, targets array<int>"
    return light.union(spark.createDataFrame(heavy_rows, schema)) if heavy_rows else light


def _levelled(loads: list[float], total: float) -> list[float]:
    """What each leaf still gets so that all end level, as far as the heavy groups allow."""
    open_ = sorted(range(len(loads)), key=lambda i: loads[i])
    rest, level, n = total - sum(loads), 0.0, 0
    for k, i in enumerate(open_):
        n, level = k + 1, (rest + sum(loads[j] for j in open_[: k + 1])) / (k + 1)
        if k + 1 == len(open_) or loads[open_[k + 1]] >= level:
            break
    return [max(0.0, level - x) if i in open_[:n] else 0.0 for i, x in enumerate(loads)]


def _boxed(groups: DataFrame) -> DataFrame:
    """Coordinates of each dimension: its share of the extent, ties parted by a hash."""
    sizes = groups.withColumn("log_size", F.log2(F.col("size").cast("double"))).withColumn(
        "id", F.coalesce(F.col("first_id").cast("double"), F.lit(-1.0))
    )
    raw = {"size": "log_size", "lang": "lang", "source": "source", "first_id": "id"}
    ends = sizes.agg(*[f(c).alias(f"{n}_{d}") for d, c in raw.items() for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = sizes
    for i, (d, c) in enumerate(raw.items()):
        lo, hi = ends[f"lo_{d}"] or 0.0, ends[f"hi_{d}"] or 0.0
        step = F.floor((F.col(c) - F.lit(lo)) * F.lit(((1 << STEP_BITS) - 1) / (hi - lo) if hi > lo else 0.0)).cast("long")
        tie = F.pmod(F.xxhash64("text_hash", "size", F.lit(i)), F.lit(1 << TIE_BITS))
        out = out.withColumn(f"at_{d}", step * (1 << TIE_BITS) + tie)
    return cut_lineage(out.select("text_hash", "size", "text_crc32", "weight", *[f"at_{d}" for d in DIMENSIONS]))


def _split(groups: DataFrame, wants: list[float]) -> DataFrame:
    """Split boxes level by level until each holds one leaf; adds ``shard``."""
    nodes = {0: (0, len(wants))}  # node -> its leaves, as a range
    current = groups.withColumn("node", F.lit(0))
    while any(b - a > 1 for a, b in nodes.values()):
        wide = {n: r for n, r in nodes.items() if r[1] - r[0] > 1}
        boxes = current.groupBy("node").agg(
            F.sum("weight").alias("weight"),
            *[f(f"at_{d}").alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))],
        )
        found = {r["node"]: r for r in boxes.collect()}
        cuts = {}
        for n, (a, b) in wide.items():
            box, middle = found.get(n), (a + b) // 2
            if box is None:
                continue
            steps = {d: box[f"hi_{d}"] - box[f"lo_{d}"] for d in DIMENSIONS}
            widest = max(DIMENSIONS, key=lambda d: (steps[d] >> TIE_BITS, -DIMENSIONS.index(d)))
            share = sum(wants[a:middle]) / (sum(wants[a:b]) or 1.0)
            cuts[n] = [widest, box[f"lo_{widest}"], box[f"hi_{widest}"] + 1, share * box["weight"], box["weight"]]
        open_ = dict(cuts)
        while open_:
            open_ = _refine(current, open_, cuts)
        for c in cuts.values():
            # What is left of the interval goes to the side that it brings nearer to its goal.
            c[1] = c[2] if 2 * c[3] >= c[4] else c[1]
        new, number = {}, {}
        for n, (a, b) in nodes.items():
            middle = (a + b) // 2 if b - a > 1 else b
            number[n] = (len(new), len(new) + 1)
            new[len(new)] = (a, middle)
            if middle < b:
                new[len(new)] = (middle, b)
        to = F.lit(-1)
        for n, (left, right) in number.items():
            side = F.when(F.col(f"at_{cuts[n][0]}") < F.lit(cuts[n][1]), F.lit(left)).otherwise(F.lit(right)) if n in cuts else F.lit(left)
            to = F.when(F.col("node") == n, side).otherwise(to)
        current, nodes = cut_lineage(current.withColumn("node", to)), new
    leaf = F.element_at(F.array(*[F.lit(nodes[n][0]) for n in sorted(nodes)]), F.col("node") + 1)
    return current.withColumn("shard", leaf.cast("int"))


def _refine(current: DataFrame, open_: dict[int, list], cuts: dict[int, list]) -> dict[int, list]:
    """Narrow each open node's interval to the bin that its goal falls in.

    A cut is [dimension, start, end, goal from the start on, weight inside]. Nodes stay open until their interval
    holds one group or one coordinate, which takes five rounds at most.
    """
    bin_ = F.lit(None)
    for n, (d, lo, hi, *_) in open_.items():
        at = F.col(f"at_{d}")
        inside = (F.col("node") == n) & (at >= F.lit(lo)) & (at < F.lit(hi))
        bin_ = F.when(inside, F.floor((at - F.lit(lo)) / F.lit(_width(lo, hi))).cast("long")).otherwise(bin_)
    binned = current.select("node", "weight", bin_.alias("bin")).filter("bin is not null")
    sums = binned.groupBy("node", "bin").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("groups"))
    # A node has BINS bins at most.
    running = sums.withColumn("upto", F.sum("w").over(Window.partitionBy("node").orderBy("bin")))
    goals = current.sparkSession.createDataFrame([(n, float(c[3])) for n, c in open_.items()], "node int, goal double")
    reached = running.join(F.broadcast(goals), "node").filter(F.col("upto") >= F.col("goal"))
    hits = reached.groupBy("node").agg(F.min_by(F.struct("bin", "w", "upto", "groups"), "bin").alias("hit")).collect()
    still = {}
    for n, hit in ((r["node"], r["hit"]) for r in hits):
        d, lo, hi, goal, _ = cuts[n]
        width = _width(lo, hi)
        start = lo + hit["bin"] * width
        cuts[n][:] = [d, start, min(hi, start + width), goal - (hit["upto"] - hit["w"]), hit["w"]]
        if hit["groups"] > 1 and width > 1:
            still[n] = cuts[n]
    return still


def _width(lo: int, hi: int) -> int:
    return max(1, -(-(hi - lo) // BINS))
