"""Two tokenizers' tokens of the same texts side by side: groups of tokens between common ends, and links that end together.

An event is a token's end. Both tokenizers' events are one table, packed in rows of a document, a side and a window of
offsets; rows are dealt by document, sorted by offset, and streamed through a machine whose state is one open group.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import kept, slices

#: Bytes of a document that a row has the events of, and links that a row of the result has at most, but for the last window's.
WINDOW, MOST_LINKS = 1 << 14, 1 << 18
#: Parts of texts whose tokens a worker remembers, before it starts anew.
MEMO = 300_000
#: New parts that go through a library at once.
TOGETHER = 2_048

#: Fixed value: how byte-level tokenizers of this kind part a text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

EVENTS = "window long, side int, begin int, ids binary"
LINKS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
_PLAIN = regex.compile(r"[\n\r\t\x20-\x7e¡-¬®-ɏ‐-‧€]*+")


def _byte_level() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: visible ones of Latin-1 are themselves, others follow from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    unseen = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(unseen)}


class Tokens:
    """A tokenizer's ids, and each id's bytes, of a text after a space. Both kinds part at single spaces, if their files say so."""

    def __init__(self, path: str) -> None:
        if path.endswith(".model"):
            import sentencepiece
            from sentencepiece.sentencepiece_model_pb2 import ModelProto

            model, mark = sentencepiece.SentencePieceProcessor(model_file=path), "▁"
            (spec := ModelProto()).ParseFromString(model.serialized_model_proto())
            norm = spec.normalizer_spec
            self.bytes_of = [bytes([int(p.piece[1:-1], 16)]) if p.type == p.BYTE else p.piece.replace(mark, " ").encode() for p in spec.pieces]
            self.apart = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and all(mark not in p.piece.lstrip(mark) for p in spec.pieces)
            self.encode = self.joined = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.encode_special_tokens = True
            model.no_truncation()
            model.no_padding()
            level, vocabulary = _byte_level(), model.get_vocab(with_added_tokens=True)
            self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
            for token, i in vocabulary.items():
                self.bytes_of[i] = bytes(level[c] for c in token) if all(c in level for c in token) else token.encode()
            own = json.loads(model.to_str())["pre_tokenizer"] or {}
            self.apart = own.get("type") == "ByteLevel" and own.get("use_regex", True) and not own.get("add_prefix_space") and model.normalizer is None
            self.encode = lambda texts: [model.encode(f" {t}", add_special_tokens=False).ids for t in texts]
            self.joined = self._by_ranks(json.loads(model.to_str())["model"]) if self.apart else self.encode
        self.sizes = np.array([len(x) for x in self.bytes_of], np.int64)

    def _by_ranks(self, model: dict) -> Callable[[list[str]], list[list[int]]]:
        """The same ids by tiktoken, which is quicker, where merges make ids in their order and every token makes itself:
        then the first merge that fits is the one of the least id. Else the library's own way."""
        level, merges = _byte_level(), [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"].get(a + b) for a, b in merges]
        ranks = {bytes(level[c] for c in token): i for token, i in model["vocab"].items() if all(c in level for c in token)}
        if made != sorted(made) or len(ranks) != len(model["vocab"]) or set(made) | {ranks.get(bytes([b])) for b in range(256)} != set(ranks.values()):
            return self.encode
        import tiktoken

        quick = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        own = [t for t in (x.decode("utf-8", "ignore") for x in ranks) if t]
        if any(quick.encode_ordinary(f" {t}") != ids for t, ids in zip(own, self.encode(own), strict=True)):
            return self.encode
        return lambda texts: [quick.encode_ordinary(f" {t}") for t in texts]


class Pair:
    """Both tokenizers over texts: their ids where both give back the text, by parts between single spaces where that is exact."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.sides = (Tokens(path_a), Tokens(path_b))
        self.apart = all(t.apart for t in self.sides)
        self._forget()

    def _learn(self, parts: list[str]) -> None:
        """New parts' ids: many parts in a row go through each library at once, and are told apart by where they end."""
        for i in range(0, len(parts), TOGETHER):
            some = parts[i : i + TOGETHER]
            text = " ".join(some)
            data = b" " + text.encode()
            ends_of = np.cumsum([len(part.encode()) + 1 for part in some])
            found = [np.array(t.joined([text])[0], np.uint16) for t in self.sides]
            upto = [np.cumsum(t.sizes[ids]) for t, ids in zip(self.sides, found, strict=True)]
            cuts = [np.searchsorted(ends, ends_of) for ends in upto]
            if all(b"".join(map(t.bytes_of.__getitem__, ids.tolist())) == data and np.array_equal(ends[at], ends_of) for t, ids, ends, at in zip(self.sides, found, upto, cuts, strict=True)):
                self._keep(some, found, [at + 1 for at in cuts], np.ones(len(some), bool))
            else:
                alone = [[t.encode([part])[0] for part in some] for t in self.sides]
                whole = [all(b"".join(map(t.bytes_of.__getitem__, lists[k])) == b" " + part.encode() for t, lists in zip(self.sides, alone, strict=True)) for k, part in enumerate(some)]
                self._keep(some, [np.fromiter(chain.from_iterable(lists), np.uint16) for lists in alone], [np.cumsum([len(ids) for ids in lists]) for lists in alone], np.array(whole))

    def _keep(self, parts: list[str], ids: list[np.ndarray], ends: list[np.ndarray], whole: np.ndarray) -> None:
        self.memo.update(zip(parts, range(len(self.memo), len(self.memo) + len(parts)), strict=True))
        self.whole.append(whole)
        for k in (0, 1):
            self.ends[k].append(ends[k] + self.size[k])
            self.ids[k].append(ids[k])
            self.size[k] += len(ids[k])

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.whole = [np.zeros(0, bool)]
        self.ids, self.ends, self.size = [[np.zeros(0, np.uint16)] for _ in "ab"], [[np.zeros(1, np.int64)] for _ in "ab"], [0, 0]

    def _whole(self, text: str) -> list[np.ndarray]:
        """Ids of a text that goes through the libraries as it is."""
        found = [t.encode([text])[0] for t in self.sides]
        whole = all(b"".join(map(t.bytes_of.__getitem__, ids)) == b" " + text.encode() for t, ids in zip(self.sides, found, strict=True))
        return [np.array(ids if whole else [], np.uint16) for ids in found]

    def tokens(self, texts: list[str]) -> list[list[np.ndarray]]:
        """Ids of each side for each text; none where the text is empty or a side doesn't give it back."""
        parted = [text.split(" ") if text and self.apart and _PLAIN.fullmatch(text) else [""] for text in texts]
        parted = [parts if "" not in parts else None for parts in parted]
        new = set().union(*filter(None, parted)).difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self._forget()
            new = set().union(*filter(None, parted))
        self._learn(list(new))
        self.whole = [np.concatenate(self.whole)]
        self.ids, self.ends = ([[np.concatenate(x)] for x in kept] for kept in (self.ids, self.ends))
        whole, (ids_a, ids_b), (ends_a, ends_b) = self.whole[0], (x[0] for x in self.ids), (x[0] for x in self.ends)
        out = []
        for text, parts in zip(texts, parted, strict=True):
            if not parts:
                out.append(self._whole(text) if text else [np.zeros(0, np.uint16)] * 2)
                continue
            rows = np.fromiter(map(self.memo.__getitem__, parts), np.int64, len(parts))
            out.append([gathered(ids_a, ends_a, rows), gathered(ids_b, ends_b, rows)] if whole[rows].all() else [np.zeros(0, np.uint16)] * 2)
        return out


def packed(ids: np.ndarray) -> bytes:
    """Ids of 16 bits, low bytes and high bytes apart, compressed; their number goes before."""
    both = ids.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()
    return len(ids).to_bytes(4, "little") + pa.compress(both, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    both = np.frombuffer(pa.decompress(data[4:], 2 * n, "zstd", asbytes=True), np.uint8).reshape(2, -1)
    return both[0].astype(np.int64) | both[1].astype(np.int64) << 8


def gathered(values: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The values of the rows given, one after another."""
    begins, sizes = starts[rows], starts[rows + 1] - starts[rows]
    ends = np.cumsum(sizes)
    return values[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1])]


@lru_cache(maxsize=2)
def _pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def events(df: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """row (of df), key, window, side (0 and 1), and its tokens that end in that window: their ids, 16 bits each, compressed,
    and where the first begins, from the window's own offset on. An id's bytes give its token's end.

    Every row of df has a row of events at least.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(path_a, path_b)
        for b in slices(batches, 2, size=1 << 20):
            at, windows, sides, begins, ids_of = [], [], [], [], []
            for i, found in enumerate(pair.tokens(b.column(2).to_pylist())):
                for side, ids in enumerate(found):
                    ends = np.cumsum(pair.sides[side].sizes[ids])
                    window = (ends - 1) // WINDOW
                    cuts = np.flatnonzero(np.diff(window)) + 1 if len(ids) and window[-1] else []
                    for part, part_ids in zip(np.split(ends, cuts), np.split(ids, cuts), strict=True):
                        if len(part) or not side:
                            first = int((part[0] - 1) // WINDOW) if len(part) else 0
                            at.append(i)
                            windows.append(first)
                            sides.append(side)
                            begins.append(int(part[0]) - int(pair.sides[side].sizes[part_ids[0]]) - first * WINDOW if len(part) else 0)
                            ids_of.append(packed(part_ids))
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(windows, pa.int64()), pa.array(sides, pa.int32()), pa.array(begins, pa.int32()), pa.array(ids_of, pa.binary())], names=["row", "key", "window", "side", "begin", "ids"])

    return df.mapInArrow(cut, StructType([*df.schema.fields[:2], *StructType.fromDDL(EVENTS)]))


class Names:
    """Ids as they stand in groups: before another of its side, and as the last of its side."""

    def __init__(self) -> None:
        plain = [str(i).encode() for i in range(1 << 16)]
        self.table = [s + end for end in (b",", b"|", b",", b";") for s in plain]

    def text(self, ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> bytes:
        """Groups one after another, each with a semicolon; last: whether an id is the last of its side in its group."""
        closed_a, closed_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before_b = np.concatenate([[0], np.flatnonzero(last_b) + 1])[closed_a]
        before_a = np.concatenate([[0], np.flatnonzero(last_a) + 1])[closed_b + 1]
        codes = np.empty(len(ids_a) + len(ids_b), np.int64)
        codes[np.arange(len(ids_a)) + before_b] = ids_a + (last_a.astype(np.int64) << 16)
        codes[np.arange(len(ids_b)) + before_a] = ids_b + ((2 + last_b.astype(np.int64)) << 16)
        return b"".join(map(self.table.__getitem__, codes.tolist()))


class Machine:
    """One document's sweep. Its state: the ids of the group still open, sums, and the links not yet given out."""

    def __init__(self, names: Names) -> None:
        self.names, self.open = names, [np.zeros(0, np.uint16)] * 2
        self.sums, self.held = np.zeros(4, np.int64), b""
        self.digest, self.links = hashlib.sha256(), []

    def window(self, ends: list[np.ndarray], ids: list[np.ndarray]) -> None:
        """All events of one window: ends met by both sides close a group and link the tokens there."""
        met = [np.isin(ends[k], ends[1 - k]) for k in (0, 1)]
        self.sums[:2] += len(ids[0]), len(ids[1])
        n = int(np.count_nonzero(np.diff(ends[0][met[0]], prepend=-1)))
        at = [np.flatnonzero(m) for m in met]
        if len(at[0]) == n and len(at[1]) == n:  # one token of a side ends at an offset, but for tokens without a byte
            linked = [ids[k][at[k]] for k in (0, 1)]
            last = met
        else:
            shared = np.unique(ends[0][met[0]])
            spans = [(np.searchsorted(ends[k], shared), np.searchsorted(ends[k], shared, "right")) for k in (0, 1)]
            pairs = [np.meshgrid(ids[0][i:j], ids[1][p:q], indexing="ij") for i, j, p, q in zip(*spans[0], *spans[1], strict=True)]
            linked = [np.concatenate([p[k].ravel() for p in pairs]) for k in (0, 1)]
            last = [np.isin(np.arange(len(ends[k])), spans[k][1] - 1) for k in (0, 1)]
        self.sums[2:] += n, len(linked[0])
        if len(linked[0]):
            self.links.append(np.stack(linked, axis=1).astype("<u2").tobytes())
        if n:
            cut = [int(np.flatnonzero(x)[-1]) + 1 for x in last]
            done = [np.concatenate([self.open[k], ids[k][: cut[k]]]) for k in (0, 1)]
            ends_of = [np.concatenate([np.zeros(len(self.open[k]), bool), last[k][: cut[k]]]) for k in (0, 1)]
            text = self.held + self.names.text(*done, *ends_of)
            self.digest.update(text[:-1])
            self.held = text[-1:]
            self.open = [ids[k][cut[k] :] for k in (0, 1)]
        else:
            self.open = [np.concatenate([self.open[k], ids[k]]) for k in (0, 1)]

    def given(self, end: bool) -> tuple[int, int, int, int, str | None, bytes] | None:
        """What is to be given out: links when there are many, and all at the document's end."""
        if not end and sum(map(len, self.links)) < 4 * MOST_LINKS:
            return None
        row = (*self.sums.tolist(), (self.digest.hexdigest() if self.held else "") if end else None, b"".join(self.links))
        self.sums, self.links = np.zeros(4, np.int64), []
        return row


def sweep(found: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """row, key, sums, groups_sha256 (in a document's last row alone) and links, 32 bits each, in one or more rows a document.

    Rows of a document come together and by offset, so no more than a window and the open group is held of any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes = Names(), [t.sizes for t in _pair(path_a, path_b).sides]
        none = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        machine, current, own, window = None, None, None, None
        ends, ids = list(none), list(none)
        out: list[tuple] = []
        rows: list[pa.Array] = []

        def close(end: bool) -> None:
            machine.window(ends, ids)
            row = machine.given(end)
            if row:
                out.append((current, *row))
                rows.append(own)

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            made = pa.RecordBatch.from_arrays([pa.concat_arrays(rows), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.int64()) for c in columns[1:5]), pa.array(columns[5], pa.string()), pa.array(columns[6], pa.binary())], names=["row", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])
            out.clear()
            rows.clear()
            return made

        for b in slices(batches, 5):
            for i, (key, w, side, begin, data) in enumerate(zip(*(b.column(c).to_pylist() for c in range(1, 6)), strict=True)):
                if machine and (key != current or w != window):
                    close(key != current)
                    ends, ids = list(none), list(none)
                if key != current:
                    machine, current, own = Machine(names), key, b.column(0).slice(i, 1)
                window = w
                ids[side] = unpacked(data)
                ends[side] = begin + np.cumsum(sizes[side][ids[side]])
            if len(out) >= 1000 or sum(len(r[6]) for r in out) > 1 << 22:
                yield batch()
        if machine:
            close(True)
            yield batch()

    schema = StructType([*found.schema.fields[:2], *StructType.fromDDL(LINKS)])
    return found.repartition("key").sortWithinPartitions("key", "window", "side").mapInArrow(run, schema)


def link_counts(linked: DataFrame) -> DataFrame:
    """pair (A's id * 2^16 + B's) and count: how many links of all documents hold it. Added up in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting, size = [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate(waiting), return_counts=True)
            both, where = np.unique(np.concatenate([pairs, new]), return_inverse=True)
            return both, np.bincount(where, np.concatenate([counts, n])).astype(np.int64)

        for b in slices(batches, 0):
            for links in b.column(0).to_pylist():
                waiting.append(as_pairs(links))
                size += len(waiting[-1])
            if size > 1 << 20:
                pairs, counts = added()
                waiting, size = [], 0
        if size:
            pairs, counts = added()
        for i in range(0, len(pairs), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + (1 << 16)]), pa.array(counts[i : i + (1 << 16)])], names=["pair", "count"])

    return linked.select("links").mapInArrow(count, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))


def as_pairs(links: bytes) -> np.ndarray:
    both = np.frombuffer(links, "<u2").astype(np.int64).reshape(-1, 2)
    return both[:, 0] << 16 | both[:, 1]


def most_pairs(path_a: str, path_b: str) -> int:
    """How many different pairs can be linked at all: tokens that end together are the one a suffix of the other, so each has
    no more partners than its bytes, times the ids that share a suffix."""
    sides = [t.bytes_of for t in _pair(path_a, path_b).sides]
    total = 0
    for own, other in (sides, sides[::-1]):
        ids: dict[bytes, int] = {}
        for x in other:
            ids[x] = ids.get(x, 0) + 1
        total += sum(ids.get(x[i:], 0) for x in own for i in range(len(x) + 1))
    return total


def align_tokens(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of df: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    path_a and path_b: tokenizer files, each of less than 2^16 ids. A null or empty text, and one that a tokenizer does not
    give back byte by byte, has no tokens: zeros and an empty digest. Repeated rows and null ids are kept apart by a key of
    each row; an empty table gives no rows. Texts of any length are cut into windows after they are encoded.

    Counts of pairs are sent to all workers: most_pairs bounds them by the vocabularies, whatever the input's size.
    """
    spark = df.sparkSession
    rows = df.select(F.struct(F.col(id_col).alias("id")).alias("row"), F.monotonically_increasing_id().alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    linked = kept(sweep(events(rows, path_a, path_b), path_a, path_b), "links")
    counted = link_counts(linked)
    best = counted.groupBy(F.col("pair") % (1 << 16)).agg(F.max("count").alias("most"), F.collect_list(F.struct("pair", "count")).alias("pairs"))
    table = best.select("most", F.explode("pairs").alias("x")).select("x.pair", "x.count", (F.col("x.count") == F.col("most")).alias("best")).toArrow().sort_by("pair")
    if table.num_rows > most_pairs(path_a, path_b):
        raise ValueError("more pairs than two tokens that end together can make")
    sent = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "count", "best")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = sent.value
        for b in slices(batches, 7):
            found = [as_pairs(x) for x in b.column(7).to_pylist()]
            at = np.searchsorted(pairs, np.concatenate(found))
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            upto = [np.concatenate([[0], np.cumsum(x[at])]) for x in (best, counts)] if len(pairs) else [np.zeros(1, np.int64)] * 2
            yield pa.RecordBatch.from_arrays([*b.columns[:7], *(pa.array(np.diff(x[cuts]).astype(np.int64)) for x in upto)], names=[*b.schema.names[:7], "n_best", "count_sum"])

    schema = StructType([*linked.schema.fields[:7], *StructType.fromDDL("n_best long, count_sum long")])
    sums = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    out = linked.mapInArrow(score, schema).groupBy("key").agg(F.first("row").alias("row"), *(F.sum(c).alias(c) for c in sums), F.max("groups_sha256").alias("groups_sha256"))
    return out.select(F.col("row.id").alias(id_col), *sums, "groups_sha256")
