"""Fill-in-middle against its definition in plain Python."""

import hashlib
import re

from pyspark.sql import functions as F

from tallymatch.llm.fill_in_middle import fill_in_middle, fim_digests, restored

SCHEMA = "doc_id long, text string, n long, form string, units string, h1 int"
TEXTS = ["", None, "one line", "a\nb\nc", "a\nb\nc\n", "\n\n\n", "x\r\ny z\x85\nlast", "has <P> in it\nand more", "<M", "<\nP>\n<S\n>", "<S\n<S\n<P\n<P\n", "\U0001d4b3\né" * 50, "line\n" * 30_000, "y" * 300_000, "a\x00b\nc"]
MADE = [(i, TEXTS[i % len(TEXTS)]) for i in range(len(TEXTS) * 12)] + [(None, "a\nb\nc\nd"), (None, "a\nb\nc\nd"), (3, "a\nb\nc")]


def plain(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    assert "".join(units) == text
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"


def test_digests(spark):
    df = spark.createDataFrame([(i, t, 1, "f", "u", 2) for i, t in MADE], SCHEMA).repartition(3)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted((str(i), (r := plain(i, t))[0], r[1], r[2], r[3], digest(r[4]), digest(t or "")) for i, t in MADE)
    got = fim_digests(fill_in_middle(df))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fim_digests(fill_in_middle(df.limit(0))).count() == 0


def test_outputs_and_rates(spark):
    df = spark.createDataFrame(MADE, "doc_id long, text string")
    for rate, spm, seed in ((40, 50, 7), (100, 0, 8), (100, 100, 9), (0, 50, 7)):
        got = fill_in_middle(df, seed=seed, rate=rate, spm_rate=spm).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
        assert len(got) == len(MADE)
        for r in got:
            n, form, pre, mid, output = plain(r.doc_id, r.text, seed, rate, spm)
            assert (r.n, r.form, r.output) == (n, form, output) and [p if p is None else len(p) for p in (r.prefix, r.middle)] == [pre, mid]
            assert r.back == r.text


def test_words_and_other_sentinels(spark):
    """Units and sentinels are parameters; cuts never fall inside a unit."""
    df = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i))) for i in range(40)], "id int, body string")
    for r in fill_in_middle(df, "id", "body", units=r"\S+\s*|\s+", sentinels=("[pre]", "[suf]", "[mid]")).collect():
        assert r.n == r.id and (r.form == "plain") == (r.id == 0)
        if r.id:
            assert r.prefix + r.middle + r.suffix == r.text and all(p == "" or p.startswith("w") for p in (r.prefix, r.middle, r.suffix))
            assert r.output == (f"[pre]{r.prefix}[suf]{r.suffix}[mid]{r.middle}" if r.form == "psm" else f"[suf]{r.suffix}[pre]{r.prefix}[mid]{r.middle}")
