"""Passages that repeat across documents: shared k-mer seeds, collinear chains of them, and alignment along the chains."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, slices
from .hashing import word_hashes
from .ngram_join import ALONE, COUNTERS, HOT, MEMO, Counters, _digest, _summed, _texts, components, crowds, merged, salts_of

#: Words in a seed, and k-mers of which the least is taken as one: a run of K + WINDOW - 1 equal words has a seed in common.
K, WINDOW = 8, 16
#: A chain's gain for a seed, and its cost for each word that it moves on in either text.
GAIN, GAP = 8.0, 0.2
#: How far below its best an extension may fall, and how far it may reach beyond a chain.
DROP, REACH = 8, 64


class Words:
    """Texts as arrays of 64-bit hashes of their words, and the seeds of such an array."""

    def __init__(self) -> None:
        self.factors = [np.uint64(xxhash.xxh3_64_intdigest(bytes((i,))) | 1) for i in range(K)]

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        return word_hashes(t.as_py() for t in texts)

    def seeds(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the minimizers: of each WINDOW k-mers in a row, the last of the least."""
        count = len(hashes) - K + 1
        if count < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        mers = np.zeros(count, np.uint64)
        for i, factor in enumerate(self.factors):
            mers += hashes[i : i + count] * factor
        mers = (mers ^ (mers >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        width = min(WINDOW, count)
        views = np.lib.stride_tricks.sliding_window_view(mers, width)
        at = np.unique(np.arange(len(views)) + width - 1 - np.argmin(views[:, ::-1], axis=1))
        return at, mers[at]


def chains(anchors: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Disjoint chains of anchors (x, y), each rising in both, by the best sum of gains less gap costs.

    In order of x, an anchor's best predecessor is the largest of f + GAP * (x + y) among smaller y, which a Fenwick tree
    of maxima over the ranks of y keeps; its own f is that less GAP * (x + y), if above nothing at all, and GAIN. Chains are
    read back from the best ends, without the anchors that an earlier chain has.
    """
    anchors = sorted(set(anchors))
    if all(p[0] < q[0] and p[1] < q[1] for p, q in pairwise(anchors)):  # the one before is the best predecessor
        score, before = [], []
        for i, (x, y) in enumerate(anchors):
            gained = score[-1] - GAP * (x + y - anchors[i - 1][0] - anchors[i - 1][1]) if i else 0.0
            score.append(GAIN + max(0.0, gained))
            before.append(i - 1 if gained > 0 else -1)
        return _read_back(anchors, score, before)
    rank = {y: i + 1 for i, y in enumerate(sorted({y for _, y in anchors}))}
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(rank) + 1)
    score, before, waiting, x0 = [0.0] * len(anchors), [-1] * len(anchors), [], None

    def put(i: int) -> None:
        x, y = anchors[i]
        entry, r = (score[i] + GAP * (x + y), i), rank[y]
        while r < len(tree):
            if entry > tree[r]:
                tree[r] = entry
            r += r & -r

    for i, (x, y) in enumerate(anchors):
        if x != x0:  # anchors at one x do not follow each other
            for j in waiting:
                put(j)
            waiting, x0 = [], x
        best, r = (-1e18, -1), rank[y] - 1
        while r:
            best = max(best, tree[r])
            r -= r & -r
        gained = best[0] - GAP * (x + y)
        score[i], before[i] = GAIN + max(0.0, gained), best[1] if gained > 0 else -1
        waiting.append(i)
    return _read_back(anchors, score, before)


def _read_back(anchors: list[tuple[int, int]], score: list[float], before: list[int]) -> list[list[tuple[int, int]]]:
    used, out = [False] * len(anchors), []
    for i in sorted(range(len(anchors)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(anchors[i])
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def _reach(equal: np.ndarray) -> int:
    """How far to extend along a diagonal: to the best balance of equal over unequal words before it drops too far."""
    balance = np.cumsum(np.where(equal, 1, -1))
    if not len(balance):
        return 0
    fallen = np.flatnonzero(np.maximum.accumulate(np.maximum(balance, 0)) - balance > DROP)
    balance = balance[: fallen[0]] if len(fallen) else balance
    best = int(np.argmax(balance)) if len(balance) else 0
    return best + 1 if len(balance) and balance[best] > 0 else 0


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two short arrays, the second row by row at once."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0)))
    return int(row[-1])


def _equal(a: np.ndarray, b: np.ndarray, p: int, q: int, x: int, y: int) -> int:
    """Equal words in order between two places of a chain."""
    return int(np.count_nonzero(a[p:x] == b[q:y])) if x - p == y - q else _common(a[p:x], b[q:y])


def align(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int]], inner: int | None = None) -> tuple[int, int, int, int, int]:
    """(a from, a to, b from, b to, equal words in order) of the passage that a chain lies in; inner: those between its ends."""
    (x, y), (u, v) = chain[0], chain[-1]
    n = min(x, y, REACH)
    back = _reach((a[x - n : x] == b[y - n : y])[::-1])
    if inner is None:
        inner = sum(_equal(a, b, *p, *q) for p, q in pairwise(chain))
    n = min(len(a) - u - K, len(b) - v - K, REACH)
    ahead = K + _reach(a[u + K : u + K + n] == b[v + K : v + K + n])
    equal = _equal(a, b, x - back, y - back, x, y) + inner + _equal(a, b, u, v, u + ahead, v + ahead)
    return x - back, u + ahead, y - back, v + ahead, equal


def _run(a: np.ndarray, b: np.ndarray, x: int, y: int) -> tuple[int, int, int, int, int]:
    """The run of equal words around an anchor, as align has it."""
    n, m = min(x, y), min(len(a) - x, len(b) - y)
    back, ahead = ((~e).argmax() if not e.all() else len(e) for e in ((a[x - n : x] == b[y - n : y])[::-1], a[x : x + m] == b[y : y + m]))
    return int(x - back), int(x + ahead), int(y - back), int(y + ahead), int(back + ahead)


def passages_of(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int]], least: int, similarity: float) -> list[tuple[int, int, int, int, int]]:
    """The passages that a chain has, as align gives them: the whole if it is alike enough, else those of its two parts.

    A chain is parted at the step with most unequal words; what has no such step is a run of equal words. Each run of least
    words on the chain is in one of them.
    """
    fits = lambda p, q, r, s, equal: min(q - p, s - r) >= least and equal >= similarity * max(q - p, s - r)
    whole = align(a, b, chain)
    if fits(*whole) or min(whole[1] - whole[0], whole[3] - whole[2]) < least:
        return [whole] if fits(*whole) else []
    equal = np.array([_equal(a, b, *p, *q) for p, q in pairwise(chain)], np.int64)
    unequal, sums = np.diff(np.array(chain), axis=0).max(1) - equal if len(chain) > 1 else equal, np.concatenate(([0], np.cumsum(equal)))
    found, waiting = set(), [(0, len(chain))]
    while waiting:
        i, j = waiting.pop()
        steps = unequal[i : j - 1]
        part = align(a, b, chain[i:j], int(sums[j - 1] - sums[i])) if j - i < len(chain) else whole
        if fits(*part):
            found.add(part)
        elif len(steps) and steps.max():
            cut = i + int(steps.argmax()) + 1
            waiting += [(i, cut), (cut, j)]
        elif fits(*(run := _run(a, b, *chain[i]))):
            found.add(run)
    return sorted(x for x in found if not any(x != y and y[0] <= x[0] and x[1] <= y[1] and y[2] <= x[2] and x[3] <= y[3] for y in found))


def seed_rows(texts: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(sig, n_words, at, seeds) of each distinct text of a task, and how often seeds occur by their counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counters, seen, kinds = Words(), Counters(), set(), [pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
        names = ["sig", "n_words", "at", "seeds", "block", "counts"]
        for batch in slices(batches, 1):
            rows = []
            for hashes in words.of(batch.column(1)):
                sig = _digest(hashes)
                if len(hashes) and sig not in seen:
                    if len(seen) > MEMO:
                        seen.clear()
                    seen.add(sig)
                    at, seeds = words.seeds(hashes)
                    counters.add(seeds)
                    rows.append((sig, len(hashes), at.astype("<i4").tobytes(), seeds.astype("<u8").tobytes(), None, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
        rows = [(None, None, None, None, b, c) for b, c in counters.blocks()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    found = kept(texts.mapInArrow(run, "sig binary, n_words long, at binary, seeds binary, block int, counts binary"), "seeds")
    counts = _summed(found.where(F.col("sig").isNull()).select("block", "counts"))
    return found.where(F.col("sig").isNotNull()).select("sig", "n_words", "at", "seeds"), counts


def seed_pairs(nodes: DataFrame, counts: np.ndarray) -> DataFrame:
    """(node, x, other, y): each occurrence of a seed beside that of the first text in its run, and of the text before.

    A further occurrence in the first text itself comes beside its own first, node and other being one.
    So a seed in m texts gives at most 2m pairs. Seeds that very many texts have are dealt to several tasks by salt, each
    with a first text of its own; those first texts are then paired in the same way.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(crowds(nodes.select("seeds"), counts))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 2):
            at, seeds = ([np.frombuffer(x.as_py(), kind) for x in batch.column(i)] for i, kind in ((1, "<i4"), (2, "<u8")))
            lengths = np.array([len(x) for x in at], np.int64)
            if lengths.sum():
                nodes, seeds = np.repeat(batch.column(0).to_numpy(), lengths), np.concatenate(seeds)
                yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array(salts_of(seeds, nodes, shared.value)), pa.array(nodes), pa.array(np.concatenate(at).astype(np.int32))], names=["seed", "salt", "node", "at"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), np.int64)  # of the last run: its first row, and those that its last two texts begin with
        for batch in batches:
            rows = np.concatenate((held, [c.to_numpy() for c in batch.columns]), axis=1)
            seed, salt, node, at = rows
            if not len(seed):
                continue
            key = np.concatenate(([True], (seed[1:] != seed[:-1]) | (salt[1:] != salt[:-1])))
            begins = np.flatnonzero(key | np.concatenate(([True], node[1:] != node[:-1])))  # each text's first row in a run
            text = np.searchsorted(begins, np.arange(len(seed)), "right") - 1
            first = np.flatnonzero(key)[np.cumsum(key) - 1]
            before = begins[np.maximum(text - 1, 0)]
            new = np.arange(len(seed)) >= held.shape[1]
            beside_first = np.flatnonzero(new & (~key | (salt != ALONE)))  # beside itself: a salt's first text, even if alone there
            beside_last = np.flatnonzero(new & (before > first) & (begins[text] > first))
            held = rows[:, sorted({int(first[-1]), max(int(before[-1]), int(first[-1])), int(begins[-1])})]
            x, y = np.concatenate((beside_first, beside_last)), np.concatenate((first[beside_first], before[beside_last]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (seed[x], salt[x], node[x], at[x], node[y], at[y])], names=["seed", "salt", "node", "x", "other", "y"])

    schema = "seed long, salt long, node long, x long, other long, y long"
    deal = lambda rows: rows.repartition("seed", "salt").sortWithinPartitions("seed", "salt", "node", "at").select("seed", F.col("salt").cast("long").alias("salt"), "node", F.col("at").cast("long").alias("at")).mapInArrow(pairs, schema)
    near = kept(deal(nodes.select("node", "at", "seeds").mapInArrow(spread, "seed long, salt int, node long, at int")), "seed-pairs")
    firsts = near.where((F.col("salt") != ALONE) & (F.col("node") == F.col("other")) & (F.col("x") == F.col("y"))).select("seed", F.lit(ALONE).alias("salt"), "node", F.col("x").alias("at"))
    return near.unionAll(deal(firsts)).select("node", "x", "other", "y")


def chained(pairs: DataFrame, least: int) -> DataFrame:
    """(node, other, xs, ys, long) of the chains of a pair of texts: long, if one could lie in a passage of least words.

    The other anchors of a pair, and those of a text with itself, are one row. So each anchor is in one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchors, out = None, [], []

        def close() -> None:
            loose = []
            for chain in chains(anchors) if key[0] != key[1] else [sorted(set(anchors))]:
                if key[0] != key[1] and chain[-1][0] + K - chain[0][0] >= least - 2 * (WINDOW - 1):
                    out.append((*key, [x for x, _ in chain], [y for _, y in chain], True))
                else:
                    loose += chain
            if loose:
                out.append((*key, [x for x, _ in loose], [y for _, y in loose], False))

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_()]
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["node", "other", "xs", "ys", "long"])
            out.clear()
            return made

        for batch in batches:
            node, other = (batch.column(i).to_numpy() for i in (0, 1))
            if not len(node):
                continue
            cuts = [0, *(np.flatnonzero((node[1:] != node[:-1]) | (other[1:] != other[:-1])) + 1).tolist(), len(node)]
            places = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            for begin, end in pairwise(cuts):
                own = (int(node[begin]), int(other[begin]))
                if key != own:
                    if key:
                        close()
                    key, anchors = own, []
                anchors += places[begin:end]
            yield batch_of()
        if key:
            close()
            yield batch_of()

    dealt = pairs.repartition("node", "other").sortWithinPartitions("node", "other", "x", "y").select("node", "other", "x", "y")
    return dealt.mapInArrow(run, "node long, other long, xs array<int>, ys array<int>, long boolean")


def spanning(chains: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """(node, shared): where a text has a seed that texts of other components have too.

    An anchor between two components opens the run of its seed, which the anchor's places name: all that came beside one
    of these places are in that run. hops: 1, or 2 where runs were parted by salts, whose first texts came beside each other.
    """
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    met = chains.join(of("node"), "node", "left").join(of("other"), "other", "left")
    between = met.where(F.coalesce("root_node", "node") != F.coalesce("root_other", "other"))
    anchors = lambda rows: rows.select("node", "other", F.explode(F.arrays_zip("xs", "ys")).alias("a")).select("node", F.col("a.xs").alias("x"), "other", F.col("a.ys").alias("y"))
    sides = anchors(between)
    places = kept(sides.select("node", F.col("x").alias("at")).unionAll(sides.select(F.col("other").alias("node"), F.col("y").alias("at"))).distinct(), "spanning")
    for _ in range(hops if not places.isEmpty() else 0):
        firsts = places.select(F.col("node").alias("other"), F.col("at").alias("y"))
        beside = anchors(chains.join(firsts.select("other").distinct(), "other", "left_semi")).join(firsts, ["other", "y"], "left_semi")
        places = kept(places.unionAll(beside.select("node", F.col("x").alias("at"))).distinct(), "spanning")
    return places.groupBy("node").agg(F.collect_set("at").alias("shared"))


def words_table(texts: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, words) of the wanted nodes, a word as four bytes of its hash."""
    wanted = wanted.join(nodes.select("node", "sig"), "node")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counters()
        for batch in batches:
            counters.add(np.array([int.from_bytes(x.as_py()[:8], "little") for x in batch.column(0)], np.uint64))
        blocks = list(counters.blocks())
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()), pa.array([c for _, c in blocks], pa.binary())], names=["block", "counts"])

    marked = texts.sparkSession.sparkContext.broadcast(np.packbits(_summed(wanted.select("sig").mapInArrow(mark, "block int, counts binary")) > 0))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, bits = Words(), set(), marked.value
        for batch in slices(batches, 1):
            rows = []
            for hashes in words.of(batch.column(1)):
                sig = _digest(hashes)
                at = int.from_bytes(sig[:8], "little") % COUNTERS
                if bits[at >> 3] >> (7 - (at & 7)) & 1 and sig not in seen:
                    if len(seen) > MEMO:
                        seen.clear()
                    seen.add(sig)
                    rows.append((sig, (hashes >> np.uint64(32)).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in range(2)], names=["sig", "words"])

    return kept(texts.mapInArrow(words_of, "sig binary, words binary").groupBy("sig").agg(F.first("words").alias("words")).join(wanted, "sig").select("node", "words"), "words")


def shared_seeds(pairs: DataFrame) -> DataFrame:
    """(node, shared): where a text has a seed that another has too."""
    return pairs.select("node", F.col("x").alias("at")).unionAll(pairs.select(F.col("other").alias("node"), F.col("y").alias("at"))).groupBy("node").agg(F.collect_set(F.col("at").cast("int")).alias("shared"))


def open_windows(shared: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """(node, opens): where in a text runs of least words may begin that another has too, by the seeds that others share.

    Each WINDOW k-mers of such a run have a seed that is shared, and so has each seed that lies WINDOW - 1 or more within it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = least - K - WINDOW + 1
        for batch in batches:
            rows = []
            for node, n_words, at, own in zip(*(batch.column(i) for i in range(4)), strict=True):
                begins = np.arange(max(n_words.as_py() - least + 1, 0))
                own = np.sort(np.asarray(own.values, np.int64))
                alone = np.setdiff1d(np.frombuffer(at.as_py(), "<i4"), own)
                has = np.zeros(n_words.as_py() + 1, bool)
                has[own] = True
                some = np.concatenate(([0], np.cumsum(has)))
                views = some[np.minimum(np.arange(n_words.as_py()) + WINDOW, len(has))] > some[: n_words.as_py()]
                bad = np.concatenate(([0], np.cumsum(~views)))
                good = bad[begins + max(last, 0) + 1] == bad[begins]
                good &= np.searchsorted(alone, begins + last, "right") <= np.searchsorted(alone, begins + WINDOW - 1)
                if good.any():
                    rows.append((node.as_py(), begins[good].astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["node", "opens"])

    return kept(nodes.select("node", "n_words", "at").where(F.col("n_words") >= least).join(shared, "node").select("node", "n_words", "at", "shared").mapInArrow(run, "node long, opens binary"), "opens")


def window_pairs(opens: DataFrame, wide: DataFrame, passages: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """Pairs as of seed_pairs, by equal runs of least words, of the runs that no passage has in some text that has them,
    and of those that texts of several components may have (wide).

    These are few: most that texts share is in a passage with one of the two partners of its seeds.
    """
    spans = passages.select("node", "begin", "end").unionAll(passages.select(F.col("other").alias("node"), F.col("other_begin").alias("begin"), F.col("other_end").alias("end"))).groupBy("node").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    table = kept(opens.join(words, "node").join(spans, "node", "left").join(wide.select("node", F.col("opens").alias("wide")), "node", "left").select("node", "opens", "words", F.coalesce("spans.begin", F.array().cast("array<long>")).alias("begins"), F.coalesce("spans.end", F.array().cast("array<long>")).alias("ends"), F.coalesce("wide", F.lit(b"")).alias("wide")), "open-words")
    factors = [np.uint64(xxhash.xxh3_64_intdigest(i.to_bytes(4, "little")) | 1) for i in range(least)]

    def windows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for node, opens, words, begins, ends, wide in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at, words = np.frombuffer(opens, "<i4").astype(np.int64), np.frombuffer(words, "<u4").astype(np.uint64)
            hashes = np.zeros(len(at), np.uint64)
            for i, factor in enumerate(factors):
                hashes += words[at + i] * factor
            hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            hashes ^= hashes >> np.uint64(32)
            held = np.zeros(len(at), bool)
            for begin, end in zip(begins, ends, strict=True):
                held |= (begin <= at) & (at + least <= end)
            held &= ~np.isin(at, np.frombuffer(wide, "<i4"))
            yield node, at, hashes, held

    def free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counters()
        for batch in slices(batches, 1, 2):
            for _, _, hashes, held in windows(batch):
                counters.add(hashes[~held])
        blocks = list(counters.blocks())
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()), pa.array([c for _, c in blocks], pa.binary())], names=["block", "counts"])

    marked = words.sparkSession.sparkContext.broadcast(np.packbits(_summed(table.mapInArrow(free, "block int, counts binary")) > 0))

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 2):
            rows = []
            for node, at, hashes, _ in windows(batch):
                low = (hashes & np.uint64(COUNTERS - 1)).astype(np.int64)
                hits = marked.value[low >> 3] >> (7 - (low & 7)).astype(np.uint8) & 1 > 0
                if hits.any():
                    rows.append((node, at[hits].astype("<i4").tobytes(), hashes[hits].astype("<u8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["node", "at", "seeds"])

    found = kept(table.mapInArrow(hit, "node long, at binary, seeds binary"), "windows")
    pairs = seed_pairs(found, np.full(COUNTERS, np.iinfo(np.uint32).max, np.uint32)).where("node != other")
    return pairs.unionAll(pairs.select("node", (F.col("x") + least - K).alias("x"), "other", (F.col("y") + least - K).alias("y")))


def aligned(found: DataFrame, words: DataFrame, least: int, similarity: float) -> DataFrame:
    """(node, begin, end, other, other_begin, other_end, equal) of the chains' passages that are long and alike enough.

    Only the words around a chain travel: those of its node are cut out where the node's text is, then meet the other's.
    """
    begin, end = (F.greatest(F.element_at("xs", 1) - REACH, F.lit(0)), F.element_at("xs", -1) + K + REACH)
    own = found.join(words, "node").select("node", "other", "xs", "ys", begin.alias("begin"), F.substr("words", begin * 4 + 1, (end - begin) * 4).alias("part"))
    both = own.join(words.select(F.col("node").alias("other"), F.col("words").alias("of_other")), "other").select("node", "other", "xs", "ys", "begin", "part", "of_other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5, 6):
            out = []
            for node, other, xs, ys, begin, part, of_other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.frombuffer(part, "<u4"), np.frombuffer(of_other, "<u4")
                for p, q, r, s, equal in passages_of(a, b, [(x - begin, y) for x, y in zip(xs, ys, strict=True)], least, similarity):
                    out.append((node, p + begin, q + begin, other, r, s, equal))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(7)], names=["node", "begin", "end", "other", "other_begin", "other_end", "equal"])

    return both.mapInArrow(run, "node long, begin long, end long, other long, other_begin long, other_end long, equal long")


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50, similarity: float = 0.8) -> DataFrame:
    """Passages of least words or more that two documents share: id, begin, end, other_id, other_begin, other_end, equal, kind,
    group_id.

    Begin and end count words, the end exclusive. Texts of the same words (A-Z and a-z alike) are one class, named by its
    least id; passages are between classes (kind passage), each from both sides, and each other member of a class has one
    row that names the class (kind copy), if it has least words. group_id is the least id that passages and copies reach.

    Every run of least equal words that a class shares with another
    has seeds in common with the first text of each seed's run and with the text before it; where these texts
    have no passage with it, or where texts of several groups have its seeds, runs of least words themselves are met, each
    text with the first that has the run. So all texts that have a passage are found, and two that share a run of least equal
    words have one group_id, whether or not their pair has a row. Passages may differ in words up to the similarity. Null and empty texts share
    nothing; a null id names a class only if it has no other; rows that repeat an id are copies if they are alike.
    """
    texts = _texts(df, id_col, text_col)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in slices(batches, 1):
            signed = [(_digest(x), len(x)) for x in words.of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in signed], pa.binary()), pa.array([x[1] for x in signed], pa.int64())], names=["id", "sig", "size"])

    kind = df.schema[id_col].dataType.simpleString()
    members = kept(texts.mapInArrow(sign, f"id {kind}, sig binary, size long").where("size > 0"), "members")
    least_ids = members.groupBy("sig").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    rows, counts = seed_rows(texts)
    nodes = kept(rows.groupBy("sig").agg(*(F.first(c).alias(c) for c in ("n_words", "at", "seeds"))).join(least_ids, "sig").withColumn("node", F.monotonically_increasing_id()), "nodes")
    pairs = kept(seed_pairs(nodes, counts), "pairs")
    chains = kept(chained(pairs, least), "chains")
    found = chains.where("long").drop("long")
    opens = open_windows(shared_seeds(pairs), nodes, least)
    words = words_table(texts, nodes, found.select("node").unionAll(found.select(F.col("other").alias("node"))).unionAll(opens.select("node")).distinct())
    passages = kept(aligned(found, words, least, similarity), "passages")
    edges = lambda rows: rows.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    roots = kept(components(edges(passages)), "roots")
    wide = open_windows(spanning(chains, roots, 2 if counts.max() >= 2 * HOT else 1), nodes, least)
    rest = kept(chained(window_pairs(opens, wide, passages, words, least), least).where("long"), "chains")
    more = kept(aligned(rest, words, least, similarity), "passages")
    roots = roots if more.isEmpty() else merged(roots, edges(more))
    passages = passages.unionAll(more)
    groups = least_ids.join(nodes.select("sig", "node"), "sig").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = kept(groups.join(groups.groupBy("root").agg(F.min("id").alias("group_id")), "root").select("sig", "node", "group_id"), "groups")
    mirrored = passages.select(F.col("other").alias("node"), F.col("other_begin").alias("begin"), F.col("other_end").alias("end"), F.col("node").alias("other"), F.col("begin").alias("other_begin"), F.col("end").alias("other_end"), "equal")
    named = nodes.select("node", F.col("id").alias("_id"))
    grouped = groups.select("node", "group_id")
    sides = passages.unionAll(mirrored).distinct().join(named.join(grouped, "node"), "node").join(named.select(F.col("node").alias("other"), F.col("_id").alias("_other")), "other")
    out = sides.select(F.col("_id").alias(id_col), "begin", "end", F.col("_other").alias("other_id"), "other_begin", "other_end", "equal", F.lit("passage").alias("kind"), "group_id")
    classes = least_ids.where("copies > 1").select("sig", F.col("id").alias("other_id"))
    copies = members.where(F.col("size") >= least).join(classes, "sig").join(groups.select("sig", "group_id"), "sig").where(~F.col("id").eqNullSafe(F.col("other_id")))
    zero = F.lit(0).cast("long")
    return out.unionAll(copies.select(F.col("id").alias(id_col), zero.alias("begin"), F.col("size").alias("end"), "other_id", zero.alias("other_begin"), F.col("size").alias("other_end"), F.col("size").alias("equal"), F.lit("copy").alias("kind"), "group_id"))
