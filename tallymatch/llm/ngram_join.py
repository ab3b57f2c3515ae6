"""Self-join of documents on the Jaccard similarity of their word shingles, by adaptive prefixes that must match often enough."""

from __future__ import annotations

import hashlib
import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, slices
from .hashing import MIX, word_hashes

#: Counters of the frequency sketch, which goes to every worker; they are handed on in blocks.
COUNTERS, BLOCK = 1 << 22, 1 << 14
#: Texts that a worker remembers having handed on, before it starts anew.
MEMO = 500_000
#: Shared prefix tokens that may be asked for, and what a longer prefix costs against a candidate.
MOST_MATCHES, TOKEN_COST = 4, 0.02
#: Estimated distinct texts with a token for each task that its run is dealt to; the salt of a run that is not dealt out.
HOT, ALONE = 1 << 13, -1
#: In a run longer than LONG, each member is also paired with so many before it.
LONG, BEFORE = 16, 12
#: Members of an open run up to which all its pairs are tried first; square of a run's length for each of its members above
#: which centres are tried before all pairs, how many times at most, and how often open runs are narrowed in a row.
SHORT, MANY, CENTRES, NARROWINGS = 48, 8, 2, 2
#: Members of a block, of which two are compared at once.
TOGETHER = 128


class Shingles:
    """The distinct shingles of texts, as sorted 64-bit hashes of their words' hashes."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.factors = [np.uint64(xxhash.xxh3_64_intdigest(bytes((i,))) | 1) for i in range(n)]

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        return map(self._set, word_hashes(t.as_py() for t in texts))

    def _set(self, hashes: np.ndarray) -> np.ndarray:
        if len(hashes) <= self.n:
            return np.array([xxhash.xxh3_64_intdigest(hashes.tobytes())], np.uint64) if len(hashes) else hashes
        count = len(hashes) - self.n + 1
        out = np.zeros(count, np.uint64)
        for i, factor in enumerate(self.factors):
            out += hashes[i : i + count] * factor
        out ^= out >> np.uint64(31)
        out *= MIX
        out.sort()
        return out[np.concatenate(([True], out[1:] != out[:-1]))]


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def raw_hashes(texts: pa.Array) -> np.ndarray:
    """A hash of each text's bytes, which costs little beside that of its shingles."""
    return np.fromiter((xxhash.xxh3_64_intdigest(t.as_buffer()) for t in texts), np.uint64, len(texts)).view(np.int64)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


class Counters:
    """Occurrences of hashes by their low bits; what a task has counted goes on as blocks of numbers."""

    def __init__(self) -> None:
        self.counts, self.waiting, self.size = np.zeros(COUNTERS, np.uint32), [], 0

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append(hashes)
        self.size += len(hashes)
        if self.size >= COUNTERS // 4:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            self.counts += np.bincount((np.concatenate(self.waiting) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
            self.waiting, self.size = [], 0

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        self.flush()
        for i in range(0, COUNTERS, BLOCK):
            if self.counts[i : i + BLOCK].any():
                yield i // BLOCK, np.minimum(self.counts[i : i + BLOCK], 0xFFFF).astype("<u2").tobytes()


def _summed(blocks: DataFrame) -> np.ndarray:
    """The sum of all tasks' (block, counts) rows, first in groups and then over those; its size is fixed."""

    def add(kind: str):
        def run(rows: pa.Table) -> pa.Table:
            total = np.zeros(BLOCK, np.int64)
            for x in rows["counts"]:
                total += np.frombuffer(x.as_py(), kind)
            return pa.table({"block": rows["block"].slice(0, 1), "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())})

        return run

    part = F.pmod(F.spark_partition_id(), F.lit(64))
    schema = "block int, counts binary"
    sums = blocks.withColumn("part", part).groupBy("block", "part").applyInArrow(add("<u2"), schema).groupBy("block").applyInArrow(add("<u4"), schema)
    out = np.zeros(COUNTERS, np.uint32)
    for r in sums.collect():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(bytes(r.counts), "<u4")
    return out


def survey(texts: DataFrame, kind: str, n: int) -> DataFrame:
    """One row per text (id, sig, size, raw), sig naming its set of shingles and raw its bytes, and each task's counters
    (block, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counters = Shingles(n), Counters()
        for batch in slices(batches, 1, size=1 << 20):
            sigs, sizes = [], []
            for found in shingles.of(batch.column(1)):
                counters.add(found)
                sigs.append(_digest(found))
                sizes.append(len(found))
            k = len(sigs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64()), pa.array(raw_hashes(batch.column(1))), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=["id", "sig", "size", "raw", "block", "counts"])
        blocks = list(counters.blocks())
        k = len(blocks)
        kind = batch.column(0).type if blocks else pa.int64()
        if k:
            yield pa.RecordBatch.from_arrays([pa.nulls(k, kind), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array([b for b, _ in blocks], pa.int32()), pa.array([c for _, c in blocks], pa.binary())], names=["id", "sig", "size", "raw", "block", "counts"])

    return texts.mapInArrow(run, f"id {kind}, sig binary, size long, raw long, block int, counts binary")


def least_overlap(size: int, percent: int) -> int:
    """Shingles that a set must share with any that reaches the similarity."""
    return -(-percent * size // 100)


def prefix(shingles: np.ndarray, counts: np.ndarray, noise: float, percent: int) -> tuple[np.ndarray, int]:
    """A set's rarest shingles, in the common order of (counter, hash), and how many of them a partner must share.

    Two sets that reach the similarity share m of their first size - least_overlap + m shingles, for every m. A larger m
    costs longer prefixes, and lets in candidates that share m at least: at most the sum of their frequencies / m.
    """
    often = counts[(shingles & np.uint64(COUNTERS - 1)).astype(np.int64)]
    order = np.lexsort((shingles, often))
    size = len(shingles)
    first = size - least_overlap(size, percent) + 1
    sums = np.cumsum(np.maximum(often[order[: first + MOST_MATCHES - 1]].astype(float) - noise, 0))
    choices = [(sums[min(first + m - 1, size) - 1] / m + TOKEN_COST * (first + m - 1), m) for m in range(1, MOST_MATCHES + 1) if first + m - 1 <= size]
    m = min(choices)[1]
    return shingles[order[: first + m - 1]], m


def enough(a: Column, matches_a: Column, b: Column, matches_b: Column, percent: int) -> Column:
    """Shared prefix tokens without which two sets of sizes a and b can't reach the similarity.

    What the set whose prefix ends first shares with the other, it shares within both prefixes or past its own; so those
    tokens and all past its prefix must make up the least overlap of the two sizes.
    """
    overlap = F.ceil(percent * (a + b) / (100 + percent))
    within = lambda n, m: overlap - F.ceil(percent * n / 100) + m
    return F.greatest(F.least(matches_a, matches_b), F.least(within(a, matches_a), within(b, matches_b)))


def prefixes(texts: DataFrame, counts: np.ndarray, n: int, percent: int) -> DataFrame:
    """(sig, matches, tokens) of each distinct set of a task; sets alike in different tasks come once each."""
    shared, noise = texts.sparkSession.sparkContext.broadcast(counts), float(counts.sum()) / COUNTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingles(n), set()
        for batch in slices(batches, 1, size=1 << 20):
            rows = []
            for found in shingles.of(batch.column(1)):
                sig = _digest(found)
                if len(found) and sig not in seen:
                    if len(seen) > MEMO:
                        seen.clear()
                    seen.add(sig)
                    tokens, matches = prefix(found, shared.value, noise, percent)
                    rows.append((sig, matches, tokens.astype("<u8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["sig", "matches", "tokens"])

    return texts.mapInArrow(run, "sig binary, matches int, tokens binary")


def crowds(lists: DataFrame, counts: np.ndarray) -> np.ndarray:
    """Counters of what distinct texts' lists of hashes hold, where the counters of all texts could call for several salts."""
    if counts.max() < 2 * HOT:
        return np.zeros(COUNTERS, np.uint32)
    shared = lists.sparkSession.sparkContext.broadcast(counts >= 2 * HOT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counters()
        for batch in batches:
            for x in batch.column(0):
                hashes = np.frombuffer(x.as_py(), "<u8")
                counters.add(hashes[shared.value[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)]])
        blocks = list(counters.blocks())
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()), pa.array([c for _, c in blocks], pa.binary())], names=["block", "counts"])

    return _summed(lists.mapInArrow(run, "block int, counts binary"))


def salts_of(hashes: np.ndarray, nodes: np.ndarray, crowded: np.ndarray) -> np.ndarray:
    """A salt from 0 by node for each hash that very many distinct texts have, and ALONE for all others."""
    parts = crowded[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)] // HOT
    return np.where(parts > 1, nodes % np.maximum(parts, 1), ALONE).astype(np.int32)


def tokens_of(nodes: DataFrame, crowded: np.ndarray) -> DataFrame:
    """(token, salt, node, packed size and matches) of all prefixes; a token that very many sets have gets several salts."""
    shared = nodes.sparkSession.sparkContext.broadcast(crowded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            lists = [np.frombuffer(x.as_py(), "<u8") for x in batch.column(3)]
            lengths = np.array([len(x) for x in lists], np.int64)
            if not lengths.sum():
                continue
            tokens = np.concatenate(lists)
            nodes = np.repeat(batch.column(0).to_numpy(), lengths)
            sizes, matches = (np.repeat(batch.column(i).to_numpy(), lengths) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(salts_of(tokens, nodes, shared.value)), pa.array(nodes), pa.array((sizes << 8) | matches)], names=["token", "salt", "node", "packed"])

    return nodes.select("node", "size", F.col("matches").cast("long").alias("matches"), "tokens").mapInArrow(run, "token long, salt int, node long, packed long")


def beside_equals(token: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Which rows of a sorted batch can matter to runs: most tokens are one set's alone. The ends' runs may go on in another
    batch, and the first of a run with a salt is not alone with its token."""
    same = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
    keep = salt != ALONE
    keep[[0, -1]] = True
    keep[1:] |= same
    keep[:-1] |= same
    return keep


def runs(tokens: DataFrame, percent: int) -> DataFrame:
    """The members of each token's run of two or more, and whom to try first: (token, node, size, matches, other,
    other_size, other_matches, member).

    Along a run by size, the first member is the centre of those after it up to the first too large for it, which is the
    next centre; each member comes once with its centre as other (member true). Past the LONGth of a run, members come
    with the BEFORE ones before them too, as in a large group of near copies many don't reach the similarity to the centre.
    Rows stream through in sorted order; nothing holds a run whole. A token with salts has one such run per salt, of one
    member or more; the first members of these runs are then met with each other along a run of their own.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre, waiting, place, before = None, None, None, 0, deque(maxlen=BEFORE)
        for batch in batches:
            if not batch.num_rows:
                continue
            out, columns = [], [c.to_numpy() for c in batch.columns]
            keep = beside_equals(*columns[:2])
            for token, salt, packed, node in zip(*(c[keep].tolist() for c in columns), strict=True):
                if key != (token, salt):
                    if waiting and key[1] != ALONE:  # alone under its salt, not with its token
                        out.append(waiting)
                    key, centre, waiting, place = (token, salt), (node, packed), (token, node, packed, node, packed, 1), 1
                    before.clear()
                else:
                    if 100 * (centre[1] >> 8) < percent * (packed >> 8):
                        centre = (node, packed)
                    if waiting:  # the first row of a run goes on only now: it may have been alone
                        out.append(waiting)
                        waiting = None
                    out.append((token, node, packed, *centre, 1))
                    place += 1
                    if place > LONG:
                        out += [(token, node, packed, *x, 0) for x in before if x[0] != centre[0] and 100 * (x[1] >> 8) >= percent * (packed >> 8)]
                before.append((node, packed))
            if out:
                yield batch_of(out)
        if waiting and key[1] != ALONE:
            yield batch_of([waiting])

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["token", "node", "packed", "other", "of_other", "member"])

    size, matches = lambda c: F.shiftright(c, 8), lambda c: F.col(c).bitwiseAND(255)
    deal = lambda rows: rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "packed", "node").select("token", "salt", "packed", "node").mapInArrow(stream, "token long, node long, packed long, other long, of_other long, member long")
    firsts = tokens.where(F.col("salt") != ALONE).groupBy("token", "salt").agg(F.min(F.struct("packed", "node")).alias("f")).select("token", F.lit(ALONE).alias("salt"), "f.packed", "f.node")
    found = deal(tokens).unionAll(deal(firsts).withColumn("member", F.lit(0).cast("long")))
    return found.select("token", "node", size("packed").alias("size"), matches("packed").alias("matches"), "other", size("of_other").alias("other_size"), matches("of_other").alias("other_matches"), (F.col("member") > 0).alias("member"))


def sets_of(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, shingles) of the sets that are wanted (node, sig, raw), each read off one text: that with the bytes' hash raw.

    A fixed-size filter of these hashes spares most other texts the shingling, and the shuffle to the join.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counters()
        for batch in batches:
            counters.add(batch.column(0).to_numpy().view(np.uint64))
        blocks = list(counters.blocks())
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()), pa.array([c for _, c in blocks], pa.binary())], names=["block", "counts"])

    marked = texts.sparkSession.sparkContext.broadcast(np.packbits(_summed(wanted.select("raw").mapInArrow(mark, "block int, counts binary")) > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen, bits = Shingles(n), set(), marked.value
        for batch in slices(batches, 1, size=1 << 20):
            rows, at = [], raw_hashes(batch.column(1)) & (COUNTERS - 1)
            for found in shingles.of(batch.column(1).filter(pa.array(bits[at >> 3] >> (7 - (at & 7)) & 1 > 0))):
                sig = _digest(found)
                if sig not in seen:
                    if len(seen) > MEMO:
                        seen.clear()
                    seen.add(sig)
                    rows.append((sig, found.astype("<u8").view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["sig", "shingles"])

    found = texts.mapInArrow(run, "sig binary, shingles array<long>").groupBy("sig").agg(F.first("shingles").alias("shingles"))
    return found.join(wanted.select("node", "sig"), "sig").select("node", "shingles")


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity, by their whole sets."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"of_{c}"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(100 * both >= percent * (F.size("of_a") + F.size("of_b") - both)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that the edges (a, b) connect each of their nodes with.

    Large-star and small-star steps in turn until a round changes nothing. Each step sends a node's larger or smaller
    neighbours to the least one; the written table that ends it cuts the lineage.
    """
    edges = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")

    def stars(edges: DataFrame, large: bool) -> DataFrame:
        own = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
        least = own.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("least", "a").alias("least"))
        moved = own.join(least, "a")
        if large:
            out = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        else:
            out = moved.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b")), F.struct("a", F.col("least").alias("b")))).alias("x")).select("x.a", "x.b")
        return out.where("a > b").distinct()

    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before, now = None, mark(edges)
    while before != now:
        edges = kept(stars(stars(edges, True), False), "edges")
        before, now = now, mark(edges)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())


def block_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of members of open runs that share enough of their open tokens, between components.

    Members are dealt to blocks by the longest run that they are in. Two blocks that have a token in common meet once, and
    one product of their tables of members by tokens counts what each pair shares, so only pairs with enough become rows.
    """
    lengths = rows.groupBy("token").agg(F.count("*").alias("n"))
    members = rows.join(lengths, "token").groupBy("node").agg(*(F.first(c).alias(c) for c in ("size", "matches", "root")), F.collect_list("token").alias("tokens"), F.max(F.struct("n", "token"))["token"].alias("main"))
    members = kept(members, "members")
    parts = members.groupBy("main").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    placed = members.join(parts, "main").withColumn("block", F.xxhash64("main", F.pmod(F.xxhash64("node"), F.col("parts")))).drop("main", "parts")
    blocks = kept(placed.groupBy("block").agg(F.collect_list(F.struct("node", "size", "matches", "root", "tokens")).alias("members")), "blocks")
    tokens = blocks.select("block", F.explode(F.array_distinct(F.flatten("members.tokens"))).alias("token"))
    met = tokens.select("token", F.col("block").alias("x")).join(tokens.select("token", F.col("block").alias("y")), "token").where("x <= y").select("x", "y").distinct()
    side = lambda c: blocks.select(F.col("block").alias(c), F.col("members").alias(f"of_{c}"))

    def table(members: list[dict], names: dict[int, int]) -> np.ndarray:
        out = np.zeros((len(members), len(names)), np.float32)
        for i, m in enumerate(members):
            out[i, [names[t] for t in m["tokens"] if t in names]] = 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up = lambda x, y: -(-x // y)
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (batch.column(k)[i].as_py() for k in (0, 1))
                common = {t for m in x for t in m["tokens"]} & {t for m in y for t in m["tokens"]}
                names = {t: k for k, t in enumerate(common)}
                shared = table(x, names) @ table(y, names).T
                (node_a, size_a, matches_a, root_a), (node_b, size_b, matches_b, root_b) = ([np.array([m[c] for m in side], np.int64) for c in ("node", "size", "matches", "root")] for side in (x, y))
                overlap = up(percent * (size_a[:, None] + size_b), 100 + percent)
                within = np.minimum(overlap - up(percent * size_a, 100)[:, None] + matches_a[:, None], overlap - up(percent * size_b, 100) + matches_b)
                keep = shared >= np.maximum(np.minimum(matches_a[:, None], matches_b), within)
                keep &= (root_a[:, None] != root_b) & (100 * size_a[:, None] >= percent * size_b) & (100 * size_b >= percent * size_a[:, None])
                p, q = np.nonzero(keep)
                a, b = np.minimum(node_a[p], node_b[q]), np.maximum(node_a[p], node_b[q])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    both = met.join(side("x"), "x").join(side("y"), "y").select("of_x", "of_y")
    return both.mapInArrow(run, "a long, b long").distinct()


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots after more links (a, b): only the components that these connect are worked on."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    joined = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    onto = components(joined).select(F.col("node").alias("root"), F.col("root").alias("onto"))
    old = roots.join(onto, "root", "left").select("node", F.coalesce("onto", "root").alias("root"))
    new = onto.select(F.col("root").alias("node"), F.col("onto").alias("root")).join(roots, "node", "left_anti")
    return kept(old.unionAll(new), "roots")


def size_bands(rows: DataFrame, percent: int) -> DataFrame:
    """rows with band and home: each in its own band of sizes (home) and in the next larger one, where smaller sizes are met.

    Sizes that can reach the similarity are at most a factor of 100 / percent apart, a little less than a band is wide.
    """
    own = F.floor(F.log("size") / (math.log(100 / percent) + 1e-6)).cast("int")
    bands = F.array(F.struct(own.alias("band"), F.lit(True).alias("home")), F.struct((own + 1).alias("band"), F.lit(False).alias("home")))
    return rows.withColumn("_b", F.explode(bands)).select("*", "_b.band", "_b.home").drop("_b")


def open_rows(known: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Members (token, node, size, matches, root, open) of runs that span components, without those that share too few
    open tokens with anyone to reach the similarity.

    open counts a member's tokens that one of another component has too: no partner can share more of its prefix. The
    least that any partner of the sizes there would need follows from enough(), which falls in one part with the
    partner's size and rises in the other. Members that go leave other runs narrower, so this is done again.
    """
    rows = known.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    for _ in range(NARROWINGS):
        runs = rows.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("size").alias("least"), F.max("size").alias("most"), F.min("matches").alias("fewest")).where("low != high").drop("low", "high")
        rows = rows.select("token", "node", "size", "matches", "root").join(runs, "token")
        partners = rows.groupBy("node").agg(F.first("size").alias("n"), F.first("matches").alias("m"), F.count("*").alias("open"), F.min("least").alias("least"), F.max("most").alias("most"), F.min("fewest").alias("fewest"))
        least = F.greatest("least", F.ceil(F.col("n") * percent / 100))
        most = F.least("most", F.floor(F.col("n") * 100 / percent))
        overlap = F.ceil(percent * (F.col("n") + least) / (100 + percent))
        own = overlap - F.ceil(percent * F.col("n") / 100) + F.col("m")
        theirs = F.floor(percent * (F.col("n") + most) / (100 + percent) - percent * most / 100 - 1e-9) + F.col("fewest")
        stay = partners.where((least <= most) & (F.col("open") >= F.greatest(F.least("m", "fewest"), F.least(own, theirs)))).select("node", "open")
        rows = kept(rows.drop("least", "most", "fewest").join(stay, "node"), "open")
    return rows


def near_sizes(percent: int) -> Column:
    return (100 * F.col("size_a") >= percent * F.col("size_b")) & (100 * F.col("size_b") >= percent * F.col("size_a"))


def centre_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Each member of an open run beside the one with most open tokens, where that is of another component."""
    side = lambda c: [F.col(x).alias(f"{x}_{c}") for x in ("size", "matches", "root")]
    best = rows.groupBy("token", "band").agg(F.max(F.struct("open", "node", "size", "matches", "root", "home")).alias("x")).select("token", "band", F.col("x.node").alias("a"), *(F.col(f"x.{c}").alias(f"{c}_a") for c in ("size", "matches", "root")), F.col("x.home").alias("home_a"))
    pairs = rows.select("token", "band", "home", F.col("node").alias("b"), *side("b")).join(best, ["token", "band"])
    return pairs.where((F.col("root_a") != F.col("root_b")) & (F.col("home") | F.col("home_a")) & near_sizes(percent))


def all_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs of members that open runs have between components, once for each token that they share."""
    sides = [rows.select("token", "band", F.col("home").alias(f"home_{c}"), F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("size", "matches", "root"))) for c in "ab"]
    return sides[0].join(sides[1], ["token", "band"]).where((F.col("root_a") < F.col("root_b")) & (F.col("home_a") | F.col("home_b")) & near_sizes(percent))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """Per row of df: id, n_shingles and component_id, the least id reachable by links of that similarity.

    Sets alike are one node, so copies cost nothing more. A node's prefix meets others in runs of equal tokens. First members
    of a run are held against its centres and, in long runs, against those before them, and what links forms components.
    Of the runs that still span components, members that share too little with anyone are put aside. All pairs of the short
    ones come first; what is left can only share tokens of long runs, so most members of these share too little. While the
    rest would make many pairs, each is held against the run's most connected member, as long as that links any; then all
    pairs that two components have between them and that share enough tokens are verified. So no link that could change a component is
    left out, and pairs within one are not formed. Sets of shingles are compared as 64-bit hashes. Texts without a word
    link with nothing and keep their own id; null ids count only where a component has no other; rows with one id and
    different texts stay apart unless linked.
    """
    kind = df.schema[id_col].dataType.simpleString()
    texts = _texts(df, id_col, text_col)
    surveyed = kept(survey(texts, kind, n), "survey")
    members = surveyed.where(F.col("sig").isNotNull()).select("id", "sig", "size", "raw")
    counts = _summed(surveyed.where(F.col("sig").isNull()).select("block", "counts"))
    sized = members.where("size > 0").groupBy("sig").agg(F.min("id").alias("least_id"), F.first("size").alias("size"), F.min("raw").alias("raw"))
    distinct = prefixes(texts, counts, n, percent).groupBy("sig").agg(F.first("matches").alias("matches"), F.first("tokens").alias("tokens"))
    nodes = kept(distinct.join(sized, "sig").withColumn("node", F.monotonically_increasing_id()), "nodes")
    met = kept(runs(tokens_of(nodes, crowds(nodes.select("tokens"), counts)), percent), "runs")

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("node")).distinct().unionAll(pairs.select(F.col("b").alias("node")).distinct()).distinct().join(nodes.select("node", "sig", "raw"), "node")
        return kept(links(pairs, kept(sets_of(texts, wanted, n), "sets"), percent), "links") if not pairs.isEmpty() else pairs

    def plausible(pairs: DataFrame, others: DataFrame | None = None) -> DataFrame:
        """Pairs that share enough tokens; others: (node, others), tokens that pairs has no rows for and that may be shared too."""
        counted = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), *(F.first(c).alias(c) for c in ("size_a", "matches_a", "size_b", "matches_b")))
        most = F.col("shared")
        if others is not None:
            for c in "ab":
                counted = counted.join(others.select(F.col("node").alias(c), F.col("others").alias(f"others_{c}")), c, "left")
            most += F.least(F.coalesce("others_a", F.lit(0)), F.coalesce("others_b", F.lit(0)))
        return counted.where(most >= enough(*map(F.col, ("size_a", "matches_a", "size_b", "matches_b")), percent)).select("a", "b")

    ordered = lambda p: p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    starred = met.where("node != other").select(F.col("other").alias("a"), F.col("node").alias("b"), F.col("other_size").alias("size_a"), F.col("other_matches").alias("matches_a"), F.col("size").alias("size_b"), F.col("matches").alias("matches_b"))
    tried = kept(ordered(plausible(starred)), "tried")
    roots = components(verified(tried))
    known = kept(met.where("member").select("token", "node", "size", "matches"), "known")
    untried = lambda pairs: kept(ordered(pairs).join(tried, ["a", "b"], "left_anti"), "tried")
    bands = size_bands(open_rows(known, roots, percent), percent)
    bands = kept(bands.join(bands.groupBy("token", "band").agg(F.count("*").alias("n")), ["token", "band"]), "bands")
    known = kept(bands.where(F.col("n") > SHORT).select("token", "node", "size", "matches").distinct(), "known")
    others = known.groupBy("node").agg(F.count("*").alias("others"))
    pairs = untried(plausible(all_pairs(bands.where(F.col("n") <= SHORT), percent), others))
    if not pairs.isEmpty():
        roots, tried = merged(roots, verified(pairs)), tried.unionAll(pairs)
    for turn in range(CENTRES + 1):
        rows = open_rows(known, roots, percent)
        bands = size_bands(rows, percent)
        sums = bands.groupBy("token", "band").agg(F.count("*").alias("n")).agg(F.sum("n").alias("members"), F.sum(F.col("n") * F.col("n")).alias("pairs")).first()
        if not sums.members:
            break
        whole = turn == CENTRES or sums.pairs <= MANY * sums.members
        pairs = untried(block_pairs(rows, percent) if whole else plausible(centre_pairs(bands, percent)))
        found = verified(pairs)
        if not whole and found.isEmpty():  # no centre links any more
            whole, pairs = True, untried(block_pairs(rows, percent))
            found = verified(pairs)
        if not found.isEmpty():
            roots = merged(roots, found)
        if whole:
            break
        known, tried = rows.select("token", "node", "size", "matches"), tried.unionAll(pairs)
    named = nodes.select("node", "sig", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = named.join(least, "root").select("sig", "component_id")
    out = members.join(classes, "sig", "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
