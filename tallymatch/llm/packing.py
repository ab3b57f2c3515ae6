"""Packing documents into windows of tokens with the neighbours that a sharded BM25 index finds for each seed."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: The usual constants of BM25.
K1, B = 1.2, 0.75
#: Words that a worker remembers the ids of, before it starts anew.
MEMO = 1_000_000
#: ASCII marks that may follow letters; an apostrophe may belong to them, and a bracket begin a special token.
MARKS = b".,;:!?|*%$#&)]}\"+=/-"

#: A byte that no UTF-8 text has; and which bytes are such marks, end a word that a mark may follow, or part words.
CUT = b"\xff"
IS_MARK = np.isin(np.arange(256), list(b".,;:!?"))
IS_LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz"))
IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E), CUT[0]])

PIECES = "doc {}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


@lru_cache(maxsize=4)
def _encoder(path: str) -> Callable[[list[bytes]], list[bytes]]:
    """The library's ids of texts, as 32-bit little-endian integers.

    The tokenizer parts texts at white space before anything can merge, so the ids of a text are those of its words, and
    each distinct word of the texts is encoded once. That is only taken as given where the file says so; else texts are encoded whole.
    """
    import json

    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    drops_space = parts[0].get("type") == "Split" and parts[0].get("invert") and parts[0].get("behavior") == "Removed" and r"[^\s\p{L}\p{N}]+" in parts[0]["pattern"].get("Regex", "")
    plain = all(n.get("type") in ("NFC", "Replace", "Lowercase") for n in (spec.get("normalizer") or {}).get("normalizers", [{}]))
    special = not any(c.isspace() or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"] for c in t["content"])
    as_bytes = lambda e: np.array(e.ids, "<u4").tobytes()
    if not (drops_space and plain and special):
        return lambda texts: [as_bytes(model.encode(t.decode(), add_special_tokens=False)) for t in texts]
    memo: dict[bytes, bytes] = {}
    suffix = (spec["model"].get("end_of_word_suffix") or "") if parts[-1].get("type") == "ByteLevel" else ""
    ends = np.zeros(model.get_vocab_size(), bool)
    if suffix:
        ends[[i for t, i in model.get_vocab().items() if t.endswith(suffix)]] = True

    def learn(new: list[bytes]) -> None:
        """New words' ids. Runs of letters end in one id with the end mark each, so many go through the library at once;
        a run of marks after letters has ids of its own, and case does not count."""
        parted = {w: (low, stem) for w in new if suffix and ((stem := (low := w.lower()).rstrip(MARKS)).isalpha() or stem.decode().lower().isalpha())}
        stems = [x for x in dict.fromkeys(stem for _, stem in parted.values()) if x not in memo]
        ids = np.array(model.encode_batch_fast([b" ".join(stems).decode()], add_special_tokens=False)[0].ids, "<u4")
        after = np.flatnonzero(ends[ids]) + 1
        if len(after) == len(stems):
            found = ids.tobytes()
            at = [0, *(after * 4).tolist()]
            memo.update(zip(stems, (found[i:j] for i, j in zip(at, at[1:], strict=False)), strict=True))
        tails = dict.fromkeys(low[len(stem) :] for low, stem in parted.values() if stem in memo and low != stem)
        alone = [w for w in new if w not in parted or parted[w][1] not in memo] + [t for t in tails if t not in memo]
        memo.update(zip(alone, map(as_bytes, model.encode_batch_fast([w.decode() for w in alone], add_special_tokens=False)), strict=True))
        for w, (low, stem) in parted.items():
            if w not in memo:
                memo[w] = memo[stem] + (memo[low[len(stem) :]] if low != stem else b"")

    def encode(texts: list[bytes]) -> list[bytes]:
        words = [t.split() for t in (marks_apart(texts) if suffix else texts)]
        new = set().union(*words).difference(memo)
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = set().union(*words)
        learn(sorted(new))
        return [b"".join(map(memo.__getitem__, w)) for w in words]

    return encode


def marks_apart(texts: list[bytes]) -> list[bytes]:
    """Texts with ASCII in lower case and a space between a letter and a single mark that ends the word. Neither is
    anything to a tokenizer that parts letters from marks and has no case, and leaves fewer distinct words."""
    data = np.frombuffer(CUT.join(texts).lower() + CUT, np.uint8)
    at = np.flatnonzero(IS_LETTER[data[:-2]] & IS_MARK[data[1:-1]] & IS_SPACE[data[2:]]) + 1
    return np.insert(data, at, 0x20).tobytes()[:-1].split(CUT)


class Index:
    """A shard's inverted index: postings by term, with BM25 weights."""

    def __init__(self, docs: list[np.ndarray]) -> None:
        found = [np.unique(d, return_counts=True) for d in docs]
        self.terms = [t for t, _ in found]
        sizes = np.array([len(t) for t in self.terms])
        lengths = np.array([len(d) for d in docs], float)
        owner, terms = np.repeat(np.arange(len(docs)), sizes), np.concatenate(self.terms)
        times = np.concatenate([c for _, c in found]).astype(float)
        order = np.argsort(terms, kind="stable")
        self.docs = owner[order]
        names, at, spread = np.unique(terms[order], return_index=True, return_counts=True)
        self.begin, self.count = np.zeros(int(names.max()) + 2, np.int64), np.zeros(int(names.max()) + 2, np.int64)
        self.begin[names], self.count[names] = at, spread
        idf = np.log1p((len(docs) - spread + 0.5) / (spread + 0.5))
        norm = K1 * (1 - B + B * lengths / lengths.mean())
        times = times[order]
        self.weights = np.repeat(idf, spread) * times * (K1 + 1) / (times + norm[self.docs])

    def scores(self, doc: int) -> np.ndarray:
        """Of all documents, with a document's terms as the question."""
        counts = self.count[self.terms[doc]]
        at = np.repeat(self.begin[self.terms[doc]] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        return np.bincount(self.docs[at], self.weights[at], len(self.terms))


def pack(docs: list[np.ndarray], window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; every id is in one, and only the last window has room.

    Whole windows of a long document come first. Then the unused rest of each document, longest first, seeds a window:
    of what is unused, the neighbours with the best scores that fit go in whole; when none fits, the best one is cut.
    """
    start, left = np.zeros(len(docs), np.int64), np.array([len(d) for d in docs], np.int64)
    sequence = 0
    for i in np.flatnonzero(left >= window):
        while left[i] >= window:
            yield int(i), int(start[i]), window, sequence, 0
            start[i] += window
            left[i] -= window
            sequence += 1
    index = Index(docs)
    for seed in np.argsort(-left, kind="stable"):
        if not left[seed]:
            continue
        room, best, offset = window, None, 0
        piece = seed
        while True:
            take = int(min(left[piece], room))
            yield int(piece), int(start[piece]), take, sequence, offset
            start[piece] += take
            left[piece] -= take
            offset, room = offset + take, room - take
            if not room:
                break
            if best is None:
                best = index.scores(seed)
            fits = np.flatnonzero((left > 0) & (left <= room))
            pool = fits if len(fits) else np.flatnonzero(left > 0)
            if not len(pool):
                break
            piece = pool[np.argmax(best[pool])]
        sequence += 1


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, shard_tokens: int = 1 << 19) -> DataFrame:
    """Pieces of documents in sequences of at most window ids: id, start, length, doc_tokens, sequence_id, offset, ids.

    A document's ids are the tokenizer's, then end_id; ids holds a piece's, little-endian in 32 bits. A hash of id and
    text deals documents to shards of about shard_tokens, so shards stay one size at any scale, whatever key is hot; each
    has an index of its own and at most one window with room left. Null texts are empty ones, null ids and repeated rows
    are packed like any other, an empty table gives no pieces. sequence_id is the shard's number * 2^32 + its window's.
    """
    rows = df.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.count("*").alias("n")).first()
    shards = max(1, math.ceil(((size.bytes or 0) / 2.7 + size.n) / shard_tokens))
    kind = df.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = _encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, 2, size=1 << 20):
            packed = pa.array([x + end for x in ids(batch.column(2).to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["doc", "shard", "ids"])

    def fill(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("doc", "ascending"), ("ids", "ascending")])
        docs = [np.frombuffer(x.as_py(), "<u4") for x in shard["ids"]]
        pieces = list(pack(docs, window))
        doc, start, length, sequence, offset = map(pa.array, zip(*pieces, strict=True))
        first = shard["shard"][0].as_py() << 32
        return pa.table({
            "doc": shard["doc"].take(doc), "start": start.cast(pa.int64()), "length": length.cast(pa.int64()), "doc_tokens": pa.array([len(docs[p[0]]) for p in pieces], pa.int64()),
            "sequence_id": pa.array([first + p[3] for p in pieces], pa.int64()), "offset": offset.cast(pa.int64()), "ids": pa.array([docs[d][s : s + n].tobytes() for d, s, n, _, _ in pieces], pa.binary()),
        })

    shard = F.pmod(F.xxhash64("doc", "text"), F.lit(shards)).cast("long")
    encoded = rows.select("doc", shard.alias("shard"), F.col("text").cast("binary").alias("text")).mapInArrow(encode, f"doc {kind}, shard long, ids binary")
    return encoded.groupBy("shard").applyInArrow(fill, PIECES.format(kind)).withColumnRenamed("doc", id_col)
