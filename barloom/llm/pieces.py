"""SentencePiece encoding and decoding: Gumbel top-k segmentations without replacement.

The vocabulary comes from a SentencePiece model file. A piece weighs ``1 / (rank + SHIFT) ** alpha`` and a
segmentation the product of its pieces, normalised over the lattice of all segmentations of the text.
Characters without a piece are spelled in byte pieces, so decoding gives every text back.

Pieces never reach over the start of a run of blanks, nor over a line feed: the lattice of a text is
a chain of small lattices, one per chunk, and equal chunks share one. ``Lattice`` builds many
distinct chunks at once in arrays: edges, backward sums and conditional edge
probabilities. A sample walks all chunks of a text in step.

``top_k`` is the A-star search of Gumbel top-k: a node is a set of segmentations (a fixed prefix, a
chunk where given choices are excluded) and its key the greatest perturbed log-probability in the set.
A popped node gives its sample; the rest of its set falls into disjoint nodes, one for each chunk where a
segmentation may leave the sample, whose keys are Gumbels truncated at the popped key. Keys fall, so
samples come out distinct and in order; all keys of a sample's nodes are computed in one array.
With kappa the key that comes after the k-th sample, a segmentation's chance of being among the
samples is 1 - exp(-exp(log_prob - kappa)): ``log_inclusion`` is its logarithm.

Uniform numbers are hashes of (seed, doc_id, sample, chunk, step): reruns agree on any partitioning. Those of a first sample have 21
bits, so an edge with a conditional probability under about 5e-7 may never be drawn there, although ``log_inclusion`` counts it.

``decoded`` gives samples back their text.

Defined cases: null and empty texts have one segmentation without pieces (log_prob 0, log_inclusion 0); a text
with fewer than k segmentations gives all of them (what has less than 1e-12 of a chunk's mass is none); a null ``doc_id`` is a key of its own; repeated rows
give equal rows; empty tables give empty results; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barloom.llm.common import GOLDEN, mix64, uniform

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
K = 2
ALPHA = 1.0
SHIFT = 10.0
SEED = 42
BLANK = 0x2581
#: Stands for a literal U+2581 in a text, which must not read as a blank: no piece has it.
LITERAL = 0x110000
BASE = np.uint64(0x100000001B3)
CHUNKS = re.compile(r" *[^ \n]+|\n| +")
#: Before the name of a chunk that has no blank: no chunk of a text without it is named so.
MARK = "\uffff"
#: Characters of documents that are encoded together.
GROUP_CHARS = 1 << 19
#: Chunks whose lattices a task keeps for the documents that follow.
KEPT_CHUNKS = 1 << 16
TABLE_BITS = 19


class Vocabulary:
    """Pieces, their ids and log-weights, and a hash table over all prefixes of pieces."""

    def __init__(self, pieces: list[tuple[int, str]], byte_ids: dict[int, int], alpha: float = ALPHA) -> None:
        ranked = {i: r for r, (i, _) in enumerate(pieces)}
        self.byte_ids = byte_ids
        self.text_of = {i: p for i, p in pieces}
        self.log_byte = -alpha * math.log(len(pieces) + SHIFT)
        hashes: dict[int, int] = {}
        for i, p in pieces:
            h = 0
            for n, c in enumerate(p):
                h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                if n + 1 == len(p):
                    hashes[h] = i
                else:
                    hashes.setdefault(h, -1)
        self.longest = max((len(p) for _, p in pieces), default=0)
        keys = np.fromiter(hashes, np.uint64, len(hashes))
        ids = np.fromiter(hashes.values(), np.int64, len(hashes))
        self.keys = np.zeros(1 << TABLE_BITS, np.uint64)
        self.ids = np.full(1 << TABLE_BITS, -2, np.int64)
        slot = (mix64(keys) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.ids[at] == -2
            _, first = np.unique(at[free], return_index=True)
            now = left[free][first]
            self.keys[slot[now]], self.ids[slot[now]] = keys[now], ids[now]
            left = np.setdiff1d(left, now)
            slot[left] = (slot[left] + 1) & ((1 << TABLE_BITS) - 1)
        self.single = self.find(np.arange(1, 0x3001, dtype=np.uint64))
        self.log_weight = np.zeros(max(ranked, default=0) + 1)
        for i, r in ranked.items():
            self.log_weight[i] = -alpha * math.log(r + SHIFT)

    @classmethod
    def load(cls, model: str = MODEL, alpha: float = ALPHA) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        byte_ids, pieces = {}, []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(p[3:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces.append((i, p))
        if len(byte_ids) != 256 or any(re.search("[^▁]▁|\n", p) for _, p in pieces):
            raise ValueError("the model needs byte pieces and pieces that hold blanks at their start only")
        return cls(pieces, byte_ids, alpha)

    def first(self, points: np.ndarray) -> np.ndarray:
        """``find`` for single characters, most of them by a table."""
        out = self.single[np.minimum(points, len(self.single) - 1)]
        high = np.nonzero(points >= len(self.single))[0]
        out[high] = self.find(points[high].astype(np.uint64) + np.uint64(1))
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Id of a piece, -1 for a mere prefix, -2 for neither."""
        at = (mix64(keys) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        out = np.full(len(keys), -2, np.int64)
        left = np.arange(len(keys))
        while len(left):
            ids = self.ids[at[left]]
            same = self.keys[at[left]] == keys[left]
            out[left[same]] = ids[same]
            left = left[~same & (ids != -2)]
            at[left] = (at[left] + 1) & ((1 << TABLE_BITS) - 1)
        return out


def split(text: str) -> list[str]:
    """Names of the chunks of a text: a chunk without the blank before it, or MARK and a chunk without a blank.

    SentencePiece puts a blank before the text. The plain form of the rule is ``CHUNKS``; texts without runs of blanks take
    the faster way of marking line starts and splitting at blanks.
    """
    if not text:
        return []
    if text[0] == " " or "  " in text or MARK in text:
        return [c[1:] if c[0] == " " and c[1:2] != MARK else MARK + c for c in CHUNKS.findall(" " + text)]
    if "\n" not in text:
        return text.split(" ")
    marked = text.replace("\n", f" {MARK}\n {MARK}").replace(f"{MARK} ", "")
    return marked.removesuffix(f" {MARK}").split(" ")


def chunk_text(name: str) -> str:
    return name[1:] if name[:1] == MARK else " " + name


def _points(chunks: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points[points == BLANK] = LITERAL
    points[points == 32] = BLANK
    return points


def _byte_count(points: np.ndarray) -> np.ndarray:
    plain = np.where(points == LITERAL, BLANK, points)
    return 1 + (plain > 0x7F) + (plain > 0x7FF) + (plain > 0xFFFF)


class Lattice:
    """The lattices of distinct chunks, side by side.

    Edges are sorted by start; ``first[p]`` is the first edge from position p. ``until`` is the cumulative
    conditional probability among the edges of a position: the edge for u is the first above it.
    """

    def __init__(self, chunks: list[str], vocabulary: Vocabulary) -> None:
        points = _points(chunks)
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        self.points = points
        self.end = np.cumsum(lengths)
        self.start = self.end - lengths
        stop = np.repeat(self.end, lengths)
        alive, keys = np.arange(len(points)), np.zeros(len(points), np.uint64)
        starts, sizes, ids = [], [], []
        for n in range(1, vocabulary.longest + 1):
            fits = alive + n <= stop[alive]
            alive, keys = alive[fits], keys[fits]
            keys = keys * BASE + points[alive + n - 1].astype(np.uint64) + np.uint64(1)
            found = vocabulary.find(keys) if n > 1 else vocabulary.first(points)
            hit = found >= 0
            starts.append(alive[hit])
            sizes.append(n)
            ids.append(found[hit])
            if n == 1:
                spelled = np.setdiff1d(alive, alive[hit], assume_unique=True)
                starts.append(spelled)
                sizes.append(1)
                ids.append(-points[spelled] - 1)
            going = found >= -1
            alive, keys = alive[going], keys[going]
            if not len(alive):
                break
        # Sorted by position, longest first (there the first edge tends to be the likeliest): each length has
        # a position once, so counting places the edges without a sort.
        per_position = np.zeros(len(points) + 1, np.int64)
        for at in starts:
            per_position[at + 1] += 1
        self.first = np.cumsum(per_position)
        edges = int(self.first[-1])
        self.at, self.size, self.piece = np.zeros(edges, np.int64), np.zeros(edges, np.int64), np.zeros(edges, np.int64)
        free = self.first[:-1].copy()
        for at, size, piece in zip(starts[::-1], sizes[::-1], ids[::-1], strict=True):
            row = free[at]
            self.at[row], self.size[row], self.piece[row] = at, size, piece
            free[at] += 1
        weight = vocabulary.log_weight[np.maximum(self.piece, 0)]
        spelled = np.nonzero(self.piece < 0)[0]
        weight[spelled] = _byte_count(-self.piece[spelled] - 1) * vocabulary.log_byte
        # Backward sums by distance to the chunk's end, in logarithms.
        beta = np.zeros(len(points) + 1)
        to = self.at + self.size
        to = np.where(to == stop[self.at], len(points), to) if len(to) else to
        away = (stop - np.arange(len(points)))[self.at] if len(to) else np.zeros(0, np.int64)
        furthest = int(away.max()) if len(away) else 0
        by_distance = np.argsort(away.astype(np.int16 if furthest < 1 << 15 else np.int64), kind="stable")
        bounds = np.concatenate(([0], np.cumsum(np.bincount(away, minlength=furthest + 1)[1:])))
        total = np.zeros(len(self.at))
        for d in range(len(bounds) - 1):
            e = by_distance[bounds[d] : bounds[d + 1]]
            if not len(e):
                continue
            p = self.at[e]
            sums = weight[e] + beta[to[e]]
            heads = np.concatenate(([0], np.nonzero(p[1:] != p[:-1])[0] + 1))
            top = np.maximum.reduceat(sums, heads)
            spread = np.diff(np.append(heads, len(e)))
            beta[p[heads]] = top + np.log(np.add.reduceat(np.exp(sums - np.repeat(top, spread)), heads))
            total[e] = sums
        self.log_prob = total - beta[self.at] if len(self.at) else total
        running = np.cumsum(np.exp(self.log_prob))
        before = np.concatenate(([0.0], running))[self.first[self.at]] if len(self.at) else running
        self.until = running - before
        # The last edge of a position takes what rounding leaves.
        self.until[self.first[1:] - 1] = 1.0
        self.size, self.piece = self.size.astype(np.int8), self.piece.astype(np.int32)
        del self.at, self.points

    def joined(self, other: Lattice) -> Lattice:
        """The lattices of both, the chunks of ``other`` last."""
        out = Lattice.__new__(Lattice)
        edges, positions = len(self.size), len(self.first) - 1
        out.first = np.concatenate((self.first[:-1], other.first + edges))
        out.start = np.concatenate((self.start, other.start + positions))
        out.end = np.concatenate((self.end, other.end + positions))
        for name in ("size", "piece", "log_prob", "until"):
            setattr(out, name, np.concatenate((getattr(self, name), getattr(other, name))))
        return out

    def sample(self, chunks: np.ndarray, keys: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges in text order, their number per chunk, and each chunk's log-probability."""
        pos, stop = self.start[chunks], self.end[chunks]
        active = np.arange(len(chunks))
        log_prob = np.zeros(len(chunks))
        whose, edges, words = [], [], keys
        while len(active):
            # All arrays follow ``active``; a word of random bits serves three steps.
            step = len(edges)
            words = words >> PART if step % 3 else mix64(keys + np.uint64((turn * TURN + step) * MIX_STEP & MASK))
            goal = (words & LOW).astype(np.float64)
            goal += 0.5
            goal *= 2.0**-21
            e = self.first[pos]
            late = np.nonzero(self.until[e] <= goal)[0]
            while len(late):
                e[late] += 1
                late = late[self.until[e[late]] <= goal[late]]
            log_prob[active] += self.log_prob[e]
            pos = pos + self.size[e]
            whose.append(active)
            edges.append(e)
            going = np.nonzero(pos < stop)[0]
            active, pos, stop, keys, words = active[going], pos[going], stop[going], keys[going], words[going]
        counts = np.zeros(len(chunks), np.int64)
        for own in whose:
            counts[own] += 1
        starts, path = np.cumsum(counts) - counts, np.zeros(int(counts.sum()), np.int64)
        for step, (own, e) in enumerate(zip(whose, edges, strict=True)):
            path[starts[own] + step] = e
        return path, counts, log_prob

    def sample_but(self, chunk: int, excluded: list[tuple[int, ...]], key: np.uint64, turn: int) -> tuple[np.ndarray, float] | None:
        """A segmentation of one chunk other than the excluded ones, by its share of what they leave."""
        p, stop, path = int(self.start[chunk]), int(self.end[chunk]), []
        # Mass of each excluded path from here on, given the walk so far.
        left = [(x, float(self.log_prob[list(x)].sum())) for x in excluded]
        log_prob, step = 0.0, 0
        while p < stop:
            a, b = int(self.first[p]), int(self.first[p + 1])
            logs = self.log_prob[a:b].tolist()
            mass = [math.exp(x) for x in logs]
            for x, lp in left:
                mass[x[step] - a] = max(0.0, mass[x[step] - a] - math.exp(lp))
            total = sum(mass)
            if total <= 0.0:
                return None
            u, e = float(_uniform(np.array([key], np.uint64), turn, step)[0]) * total, 0
            for e, m in enumerate(mass):
                if u < m:
                    break
                u -= m
            else:
                e = max(range(len(mass)), key=mass.__getitem__)  # what rounding leaves
            left = [(x, lp - logs[e]) for x, lp in left if x[step] == a + e and step + 1 < len(x)]
            log_prob += logs[e]
            path.append(a + e)
            p += int(self.size[a + e])
            step += 1
        return np.array(path, np.int64), log_prob


MIX_STEP = 0xD1B54A32D192ED03
#: Steps that lie between two turns of the search: more than a chunk that anyone writes has pieces.
TURN = 1 << 40
MASK = (1 << 64) - 1
PART, LOW = np.uint64(21), np.uint64((1 << 21) - 1)


def _uniform(keys: np.ndarray, turn: int, step: int = 0) -> np.ndarray:
    return uniform(keys + np.uint64((turn * TURN + step) * MIX_STEP & MASK))


def row_keys(ids: list[int | None], seed: int) -> np.ndarray:
    plain = np.array([1 << 63 if i is None else i & 0xFFFFFFFFFFFFFFFF for i in ids], np.uint64)
    with np.errstate(over="ignore"):
        return mix64(mix64(plain + GOLDEN) + np.uint64(seed))


def token_keys(row: np.uint64, n: int) -> np.ndarray:
    """A key for each chunk of a text."""
    return mix64(row + np.arange(n, dtype=np.uint64) * GOLDEN)


def _gumbel_below(phi: np.ndarray, u: np.ndarray, top: float) -> np.ndarray:
    """Gumbels of location phi truncated at ``top``."""
    return phi - np.log(np.exp(phi - top) - np.log(u))


def top_k(lattice: Lattice, chunks: np.ndarray, row: np.uint64, k: int, keys: np.ndarray, drawn: tuple) -> list[tuple]:
    """Up to k samples (edges, log_prob, perturbed, log_inclusion), perturbed falling.

    ``keys`` are the chunks' keys and ``drawn`` the first sample, which is a plain one (turn 0).
    """
    n = len(chunks)
    top = float(-np.log(-np.log(uniform(np.array([row], np.uint64))))[0])
    heap: list[tuple] = [(-top, 0, None, 0, ())]
    out, turn = [], 0
    while heap and len(out) < k:
        key, _, parent, t, excluded = heapq.heappop(heap)
        if parent is None:
            edges, counts, probs = drawn
        else:
            edges, counts, probs, starts = parent
            turn += 1
            left = lattice.sample_but(int(chunks[t]), list(excluded), keys[t], 2 * turn)
            if left is None:
                continue
            tail = lattice.sample(chunks[t + 1 :], keys[t + 1 :], 2 * turn)
            edges = np.concatenate((edges[: starts[t]], left[0], tail[0]))
            counts = np.concatenate((counts[:t], [len(left[0])], tail[1]))
            probs = np.concatenate((probs[:t], [left[1]], tail[2]))
        starts = np.concatenate(([0], np.cumsum(counts)))
        out.append((edges, float(probs.sum()), -key))
        if not n:
            continue
        rest = -np.expm1(probs[t:])
        if excluded:
            rest[0] -= sum(math.exp(float(lattice.log_prob[list(x)].sum())) for x in excluded)
        open_ = np.nonzero(rest >= 1e-12)[0]
        if len(open_):
            before = np.cumsum(probs[t:]) - probs[t:] + probs[:t].sum()
            u = _uniform(keys[t:][open_], 2 * turn + 1)
            best = _gumbel_below(before[open_] + np.log(rest[open_]), u, -key)
            # The k - len(out) nodes that can still be popped, and the one that gives kappa.
            m = k + 1 - len(out)
            for j in (np.argpartition(-best, m)[:m] if len(best) > m else range(len(best))):
                at = int(open_[j]) + t
                own = tuple(edges[starts[at] : starts[at + 1]].tolist())
                heapq.heappush(heap, (-float(best[j]), turn * (n + 1) + at, (edges, counts, probs, starts), at, (*(excluded if at == t else ()), own)))
    kappa = -heap[0][0] if heap else -math.inf
    return [(e, lp, g, _log_inclusion(lp - kappa)) for e, lp, g in out]


def _log_inclusion(x: float) -> float:
    return 0.0 if x > 30 else x if x < -30 else math.log(-math.expm1(-math.exp(x)))


def piece_ids(ids: np.ndarray, byte_ids: dict[int, int]) -> np.ndarray:
    """Piece ids of a path; what has no piece (-1 - code point) becomes byte pieces."""
    low = (ids < 0) & (ids >= -128)
    if low.any():
        ascii_ids = np.array([byte_ids[b] for b in range(128)])
        ids = ids.copy()
        ids[low] = ascii_ids[-1 - ids[low]]
    spelled = np.nonzero(ids < 0)[0]
    if not len(spelled):
        return ids
    parts, at = [], 0
    for i in spelled.tolist():
        point = int(-ids[i] - 1)
        raw = chr(BLANK if point == LITERAL else point).encode("utf-8", "surrogatepass")
        parts += [ids[at:i], np.array([byte_ids[b] for b in raw], np.int64)]
        at = i + 1
    return np.concatenate([*parts, ids[at:]])


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """The text of a segmentation."""
    byte_of = {i: b for b, i in vocabulary.byte_ids.items()}
    raw = b"".join(
        bytes([byte_of[i]]) if i in byte_of else vocabulary.text_of[i].replace("▁", " ").encode("utf-8") for i in ids
    )
    return raw.decode("utf-8", "surrogatepass")[1:]


class Encoder:
    """Encodes groups of documents; keeps the lattices of the first chunks it has seen."""

    def __init__(self, vocabulary: Vocabulary, k: int, seed: int) -> None:
        self.vocabulary, self.k, self.seed = vocabulary, k, seed
        self.known: dict[str, int] = {}
        self.lattice = Lattice([], vocabulary)

    def encode(self, ids: list, texts: list) -> list[tuple]:
        """(row, rank, log_prob, perturbed, log_inclusion, piece ids) of all samples."""
        rows, keys = [], row_keys(ids, self.seed)
        seen: defaultdict[str, int] = defaultdict(itertools.count(len(self.known)).__next__, self.known)
        tokens = [np.fromiter(map(seen.__getitem__, c), np.int64, len(c)) for c in (split(t or "") for t in texts)]
        lattice = self.lattice.joined(Lattice([chunk_text(c) for c in itertools.islice(seen, len(self.known), None)], self.vocabulary))
        if len(self.known) < KEPT_CHUNKS:
            self.known, self.lattice = dict(seen), lattice
        with np.errstate(over="ignore", divide="ignore"):
            own = [token_keys(key, len(t)) for key, t in zip(keys, tokens, strict=True)]
            first = lattice.sample(np.concatenate(tokens), np.concatenate(own), 0)
            ends = np.cumsum([len(t) for t in tokens])
            edge_ends = np.concatenate(([0], np.cumsum(first[1])))
            for i, (chunks, chunk_keys, b) in enumerate(zip(tokens, own, ends.tolist(), strict=True)):
                a = b - len(chunks)
                drawn = (first[0][edge_ends[a] : edge_ends[b]], first[1][a:b], first[2][a:b])
                for rank, (edges, lp, g, inc) in enumerate(top_k(lattice, chunks, keys[i], self.k, chunk_keys, drawn)):
                    rows.append((i, rank, lp, g, inc, piece_ids(lattice.piece[edges], self.vocabulary.byte_ids)))
        return rows


def _groups(texts: list) -> list[list[int]]:
    out, size = [[]] if texts else [], 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if out[-1] and size + n > GROUP_CHARS:
            out.append([])
            size = 0
        out[-1].append(i)
        size += n
    return out


SCHEMA = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, pieces array<int>"


def sampled_segmentations(docs: DataFrame, model: str = MODEL, k: int = K, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """A row for each document and sample: its rank, score, inclusion score and piece ids."""
    vocabulary = Vocabulary.load(model, alpha)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, k, seed)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for group in _groups(texts):
                own = [ids[i] for i in group]
                rows = encoder.encode(own, [texts[i] for i in group])
                lengths = np.array([len(r[5]) for r in rows], np.int64)
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                values = np.concatenate([r[5] for r in rows]).astype(np.int32)
                columns = [
                    pa.array([own[r[0]] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array(lengths),
                    *[pa.array([r[c] for r in rows], pa.float64()) for c in (2, 3, 4)],
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", "pieces"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def decoded(samples: DataFrame, model: str = MODEL, alpha: float = ALPHA) -> DataFrame:
    """``samples`` with ``text``, what their ``pieces`` spell; null pieces spell nothing."""
    vocabulary = Vocabulary.load(model, alpha)
    kept = [c for c in samples.columns if c != "text"]
    schema = StructType([*(samples.schema[c] for c in kept), *StructType.fromDDL("text string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_of = {i: bytes([b]) for b, i in vocabulary.byte_ids.items()}
        spelled: dict[int, bytes] = {}
        for batch in batches:
            texts = []
            for ids in batch.column("pieces").to_pylist():
                for i in set(ids or ()) - spelled.keys():
                    spelled[i] = byte_of[i] if i in byte_of else vocabulary.text_of[i].replace(chr(BLANK), " ").encode("utf-8")
                texts.append(b"".join([spelled[i] for i in ids or ()]).decode("utf-8", "surrogatepass")[1:])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "text"])

    return samples.select(*kept).mapInArrow(run, schema)
