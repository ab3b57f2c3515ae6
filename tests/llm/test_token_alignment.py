"""Cross-tokenizer alignment against its definition, token by token."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymatch.llm import token_alignment

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, key string, row int, side string, links string, n_a string"


def made():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("theinganderousation") for _ in range(rng.randint(1, 9))) + rng.choice(("", "", ",", ".", "'s", "-x9"))
    texts = [" ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(40)]
    texts += ["", None, " ", "a", "  two  spaces ", "line\nbreaks\n\n then  more\t\ttabs \n x", "é漢字\U0001d4b3 ñandú \x00\x85　x", "has ▁ in it", "<|endoftext|> <s> </s> <0x41> <unk>", "don't I'll 123 4567", "​﻿ zero", "x" * 40_000, "ab " * 20_000, " ".join(word() for _ in range(9_000))]
    texts += ["".join(chr(rng.choice((9, 10, 13, 32, 32, 65, 97, 98, 0xE9, 0x2581 if i % 5 == 0 else 99, 0x4E00, 39, 0x1F600))) for _ in range(60)) for i in range(30)]
    return texts


def plain(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    level = {chr(x): x for x in seen} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in seen)}
    docs = []
    for t in texts:
        whole = b" " + (t or "").encode()
        tokens_a = [(i, bytes(level[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids] if t else []
        tokens_b = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)] if t else []
        if any(b"".join(x for _, x in s) != whole for s in (tokens_a, tokens_b)):
            tokens_a = tokens_b = []
        ends = []
        for tokens in (tokens_a, tokens_b):
            at, own = 0, []
            for i, x in tokens:
                at += len(x)
                own.append((at, i))
            ends.append(own)
        at_b = dict(ends[1])  # no token of these files is without a byte
        links = [(i, at_b[e]) for e, i in ends[0] if e in at_b]
        groups, open_, common = [], ([], []), {e for e, _ in ends[0]} & {e for e, _ in ends[1]}
        for e, side, i in sorted([(e, 0, i) for e, i in ends[0]] + [(e, 1, i) for e, i in ends[1]]):
            open_[side].append(str(i))
            if e in common and side:
                groups.append(",".join(open_[0]) + "|" + ",".join(open_[1]))
                open_ = ([], [])
        docs.append((len(tokens_a), len(tokens_b), groups, links))
    counts = Counter(x for d in docs for x in d[3])
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [(n_a, n_b, len(g), len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for n_a, n_b, g, ls in docs]


@pytest.mark.parametrize(("window", "most", "memo"), [(1 << 14, 1 << 18, 300_000), (64, 50, 40)])
def test_against_the_definition(spark, monkeypatch, window, most, memo):
    for name, value in (("WINDOW", window), ("MOST_LINKS", most), ("MEMO", memo), ("TOGETHER", min(memo, 2048))):
        monkeypatch.setattr(token_alignment, name, value)
    texts = made()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, texts[0]), (5, texts[5])]
    df = spark.createDataFrame([(i, t, "k", 1, "s", "l", "n") for i, t in rows], SCHEMA).repartition(3)
    got = token_alignment.align_tokens(df, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = plain([t for _, t in rows])
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted((str(i), *w) for (i, _), w in zip(rows, want, strict=True))
    assert token_alignment.align_tokens(df.limit(0), A, B).count() == 0


def test_tokens_by_parts_are_those_of_whole_texts():
    """Random strings of all that could make a part's tokens depend on the parts beside it."""
    rng, pair = random.Random(8), token_alignment.Pair(A, B)
    alphabet = [" ", " ", "\n", "\t", "\r", "a", "b", "The", "'s", "'", "1", "22", "!", "...", "é", "ß", "¬", "’", "µ", "²", "ı", "…"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25))) for _ in range(3_000)]
    for text, found in zip(texts, pair.tokens(texts), strict=True):
        assert all(np.array_equal(x, t.encode([text])[0]) for x, t in zip(found, pair.sides, strict=True)), repr(text)


def test_quick_ids_are_the_library_s():
    pair = token_alignment.Pair(A, B)
    assert pair.apart and pair.sides[0].joined is not pair.sides[0].encode
    rng = random.Random(9)
    alphabet = [chr(c) for c in (*range(0x20, 0x7F), *range(0xA1, 0x250), 0x2010, 0x2019, 0x20AC, 9, 10, 13) if c != 0xAD]
    texts = ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(3_000)] + alphabet
    assert pair.sides[0].joined(texts) == pair.sides[0].encode(texts)


def test_bound_of_pairs():
    assert 100_000 < token_alignment.most_pairs(A, B) < 1_000_000


def test_machine_links_all_tokens_without_bytes():
    """Two tokens of A and two of B that end at one offset make four links in one group."""
    machine = token_alignment.Machine(token_alignment.Names())
    machine.window([np.array([1, 3, 3, 5]), np.array([3, 3, 5])], [np.array([10, 11, 12, 13]), np.array([20, 21, 22])])
    n_a, n_b, n_groups, n_links, digest, links = machine.given(True)
    assert (n_a, n_b, n_groups, n_links) == (4, 3, 2, 5) and digest == hashlib.sha256(b"10,11,12|20,21;13|22").hexdigest()
    assert [(x >> 16, x & 0xFFFF) for x in token_alignment.as_pairs(links).tolist()] == [(11, 20), (11, 21), (12, 20), (12, 21), (13, 22)]


def test_rows_of_events(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string").select(F.struct("id").alias("row"), F.monotonically_increasing_id().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = token_alignment.events(df, A, B).collect()
    assert sorted((r.row.id, r.side, r.begin, len(token_alignment.unpacked(r.ids))) for r in rows) == [(1, 0, 0, 2), (1, 1, 0, 2), (2, 0, 0, 0)]
