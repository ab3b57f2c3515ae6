"""Language-model scores by a probabilistic suffix tree over bytes, beside a unigram base over words."""

from __future__ import annotations

from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, slices
from .hashing import ends_among, words_at

#: Symbols that a context has at most: with the next one they fill 48 bits of a key, and a text's number the other 16.
DEPTH = 5
#: Bytes that no UTF-8 text has: before a text's first, and after its last.
START, END = b"\xfe", b"\xff"
SYMBOLS = 256
#: The weight of the shorter context for each kind of symbol that a context was seen with.
STRENGTH = 4
#: Bytes of texts that are sorted at once, and that share one table of values; entries that a worker holds before it sums them.
PART, BATCH, HELD = 1 << 20, 48 << 20, 600_000
#: What marks the key of a word, its hash otherwise; keys of symbols are below.
WORD_KEY = np.uint64(1 << 63)

READ = "batch long, key long, n long, docs binary"


def symbol_keys(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of each lower-case text and for its end: the depth symbols before it and itself as one number, the
    latest in the highest byte; and how many symbols each text has."""
    joined = b"".join(START * depth + t + END for t in texts)
    data = np.frombuffer(joined, np.uint8)
    eights = np.ndarray((len(joined) - depth,), "<u8", joined + bytes(8), strides=(1,))
    keys = eights[data[depth:] != START[0]]
    keys &= np.uint64((1 << 8 * (depth + 1)) - 1)
    return keys, np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The key of each word of each lower-case text, and how many words each text has."""
    begins, _, hashes = words_at(b" ".join(texts))
    hashes |= WORD_KEY
    return hashes, np.diff(ends_among(begins, texts), prepend=0)


class Sums:
    """Keys of one kind and their sums over what was added, summed up whenever HELD more keys wait."""

    def __init__(self) -> None:
        self.keys, self.n, self.waiting = np.zeros(0, np.uint64), np.zeros(0, np.int32), []

    def add(self, keys: np.ndarray, counted: bool) -> None:
        keys, n = np.unique(keys, return_counts=True)
        self.waiting.append((keys, n.astype(np.int32) * counted))
        if sum(len(k) for k, _ in self.waiting) > HELD:
            self.settle()

    def settle(self) -> None:
        keys, n = (np.concatenate((old, *new)) for old, new in zip((self.keys, self.n), zip(*self.waiting, strict=True), strict=False)) if self.waiting else (self.keys, self.n)
        self.waiting, self.keys, self.n = [], None, None
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        del order
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
        self.keys, self.n = keys[first], np.add.reduceat(n, first) if len(first) else n


def read_batches(rows: DataFrame, depth: int) -> DataFrame:
    """rows (id, held_out, text) as batches of about BATCH bytes: (batch, key, n) of each key in a batch, n counting training
    texts alone, and one row (batch, n, docs) with the number of those and the rows themselves, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in READ.split(", ")])
        sums, sink, stream, size, training, number = (Sums(), Sums()), None, None, 0, 0, TaskContext.get().partitionId() << 32

        def out() -> Iterator[pa.RecordBatch]:
            stream.close()
            blob = sink.getvalue()
            docs = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, blob.size], np.int32)), blob])
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.nulls(1, pa.int64()), pa.array([training], pa.int64()), docs], schema=schema)
            for kind in sums:
                kind.settle()
                for i in range(0, len(kind.keys), 1 << 16):
                    some, n = kind.keys[i : i + (1 << 16)].view(np.int64), kind.n[i : i + (1 << 16)].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number)), pa.array(some), pa.array(n), pa.nulls(len(some), pa.binary())], schema=schema)

        for batch in slices(batches, 2, size=PART):
            if stream is None:
                sink = pa.BufferOutputStream()
                stream = pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False))
            stream.write_batch(batch)
            held = batch.column(1).to_pylist()
            texts = [t.lower() for t in batch.column(2).to_pylist()]
            for train in (True, False):
                some = [t for t, h in zip(texts, held, strict=True) if (h is False) == train]
                if some:
                    sums[0].add(symbol_keys(some, depth)[0], train)
                    sums[1].add(word_keys(some)[0], train)
                training += len(some) * train
            size += sum(map(len, texts))
            if size >= BATCH:
                yield from out()
                sums, sink, stream, size, training, number = (Sums(), Sums()), None, None, 0, 0, number + 1
        if stream is not None:
            yield from out()

    return rows.mapInArrow(run, READ)


def suffix_tree(counts: DataFrame, depth: int = DEPTH, least: int = 4, divergence: float = 2.0) -> DataFrame:
    """(key, value) over (key, n) of symbols: the log10 probability of a key's last symbol after those before it.

    A context is a state of the tree if it was seen least times and total * KL(its next symbols || those of its suffix) is
    at least divergence nats for each kind of its next symbols and one more, which is about what chance alone would give.
    A symbol's probability in a state is n + w * (that in the longest state its suffix ends in) over total + w, where w is
    STRENGTH for each kind of symbol that the state was seen with (Witten and Bell); in the root that rest is evenly spread.
    What is no state has the value of its longest suffix that is one. Level by level, a context's own table is one window
    and its suffix's values come by one join, so the tree is as large as the corpus makes it.
    """
    levels = [counts.select("key", "n")]
    for _ in range(depth):
        levels.append(levels[-1].groupBy(F.shiftright("key", 8).alias("key")).agg(F.sum("n").alias("n")))
    above = None
    for k, level in enumerate(reversed(levels)):
        rows = level.withColumn("context", F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1)))
        rows = rows.withColumn("suffix", F.shiftright("key", 8)).join(above, "suffix") if k else rows.withColumns({"p_above": F.lit(1 / SYMBOLS)})
        own = Window.partitionBy("context")
        rows = rows.withColumns({"total": F.sum("n").over(own), "kinds": F.count(F.when(F.col("n") > 0, 1)).over(own)})
        state = F.col("total") > 0
        if k:
            gain = F.sum(F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n") * F.col("total_above") / (F.col("n_above") * F.col("total"))))).over(own)
            state = (F.col("total") >= least) & (F.coalesce(gain, F.lit(0.0)) >= divergence * (1 + F.col("kinds")))
        weight = STRENGTH * F.col("kinds")
        p = F.when(state, (F.col("n") + weight * F.col("p_above")) / (F.col("total") + weight)).otherwise(F.col("p_above"))
        above = rows.select(F.col("key").alias("suffix"), F.col("n").alias("n_above"), F.col("total").alias("total_above"), p.alias("p_above"))
    return above.select(F.col("suffix").alias("key"), F.log10("p_above").alias("value"))


def scored(values: pa.Table, docs: pa.Table, depth: int) -> pa.Table:
    """(id, held_out, n_words, n_known, logs, score) of a batch's texts by the values of its keys: of symbols their log10
    probability, of words their training count."""
    keys, value = values["key"].to_numpy().view(np.uint64), values["value"].to_numpy()
    order = np.argsort(keys)
    keys, value = keys[order], value[order]
    out = []
    for blob in docs["docs"]:
        for batch in pa.ipc.open_stream(blob.as_buffer()):
            texts = [t.lower() for t in batch.column(2).to_pylist()]
            n = len(texts)
            symbols, sizes = symbol_keys(texts, depth)
            symbols <<= np.uint64(16)
            symbols |= np.repeat(np.arange(n, dtype=np.uint64), sizes)
            symbols.sort()
            own = symbols >> np.uint64(16)
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            logs = np.repeat(value[np.searchsorted(keys, own[first])], np.diff(first, append=len(own)))
            score = np.bincount((symbols & np.uint64(0xFFFF)).astype(np.int64), logs, n)
            words, lengths = word_keys(texts)
            kinds, kind = np.unique(words, return_inverse=True)
            seen = value[np.searchsorted(keys, kinds)] if len(kinds) else np.zeros(0)
            owner = np.repeat(np.arange(n), lengths)
            known, base = (np.bincount(owner, of[kind], n) for of in ((seen > 0).astype(float), np.log10(seen + 1)))
            out.append(pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], names=["id", "held_out", "n_words", "n_known", "logs", "score"]))
    return pa.Table.from_batches(out)


def lm_scores(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, **tree: float) -> DataFrame:
    """Per row of df: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the text).

    Both models learn from the rows where held_out is false; where it is null (as with a null id) a row only gets scores.
    The tree's symbols are the bytes of the text, A-Z as a-z, and its end; contexts reach back up to depth of them, over
    words' borders and to a mark before the text. Counts of words and of symbols after their contexts are tables. A batch
    of texts asks for each of its keys once, by a join, and gets all their values as one group, which is no larger than
    the batch. Words are told apart by 63 bits of a hash. A null text is an empty one, whose only token and symbol is its
    end. With no training rows every token is unknown and every symbol as likely as any. Repeated rows are kept, and each trains.
    """
    if not 1 <= depth <= DEPTH:
        raise ValueError(f"depth must be from 1 to {DEPTH}")
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.coalesce(max(-(-size // BATCH), df.sparkSession.sparkContext.defaultParallelism))  # small files share a batch
    read = kept(read_batches(rows, depth), "lm-read")
    found, docs = read.where("key is not null").select("batch", "key", "n"), read.where("docs is not null").select("batch", "n", "docs")
    counts = kept(found.groupBy("key").agg(F.sum("n").alias("n")), "lm-counts")
    words = counts.where("key < 0")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    ends = docs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    model = kept(suffix_tree(counts.where("key >= 0"), depth, **tree), "lm-tree").unionAll(words.select("key", F.col("n").cast("double")))
    values = found.select("batch", "key").join(model, "key").select("batch", "key", "value")
    out = values.groupBy("batch").cogroup(docs.select(F.col("batch").alias("of"), "docs").groupBy("of")).applyInArrow(lambda a, b: scored(a, b, depth), f"id {kind}, held_out boolean, n_words long, n_known long, logs double, score double")
    tokens = F.col("n_words") + 1
    base = F.col("logs") + F.lit(log10(ends + 1)) - tokens * F.lit(log10(n + ends + v + (ends > 0) + 1))
    return out.select(F.col("id").alias(id_col), "held_out", tokens.alias("n_tokens"), (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"), F.lit(n + ends).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
