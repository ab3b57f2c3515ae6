"""What op8 spares itself: tokens that one set alone has, and shingles of texts that no pair asks for."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallymatch.llm import ngram_join


def test_only_rows_beside_equals_or_at_ends_or_with_salts_matter():
    token = np.array([1, 2, 2, 3, 4, 4, 5, 6, 6])
    salt = np.array([-1, -1, -1, -1, 0, 1, -1, -1, -1])
    assert ngram_join.beside_equals(token, salt).tolist() == [True, True, True, False, True, True, False, True, True]
    assert ngram_join.beside_equals(token[:1], salt[:1]).tolist() == [True]


def test_runs_that_batches_part(spark):
    """A run is whole though a batch ends within it, wherever that is."""
    rows = [(t, -1, n, (6 << 8) | 1) for t, n in [(1, 0), (2, 1), (2, 2), (3, 3), (4, 4), (4, 5), (4, 6), (5, 7)]]
    tokens = spark.createDataFrame(rows, "token long, salt int, node long, packed long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "2", "3", "100"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = sorted((r.token, r.node, r.other) for r in ngram_join.runs(tokens, 75).collect())
            assert got == [(2, 1, 1), (2, 2, 1), (4, 4, 4), (4, 5, 4), (4, 6, 4)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_sets_are_read_off_the_wanted_text(spark):
    """Texts of one set differ in bytes; the one that is named gives the set, and no other is asked."""
    texts = [b"a b c d e f", b"A b c d e f", b"u v w x y z", b"", b"a b c d e f"]
    df = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "id long, text binary").repartition(1)
    sets = list(ngram_join.Shingles(5).of(pa.array(texts, pa.binary())))
    raws = ngram_join.raw_hashes(pa.array(texts, pa.binary()))
    assert raws[0] == raws[4] != raws[1]
    wanted = spark.createDataFrame([(7, bytearray(ngram_join._digest(sets[0])), int(raws[1]))], "node long, sig binary, raw long")
    (row,) = ngram_join.sets_of(df, wanted, 5).collect()
    assert row.node == 7 and sorted(x % (1 << 64) for x in row.shingles) == sets[0].tolist()
    other = wanted.withColumn("raw", F.lit(int(raws[2])))  # a text of another set: it is read, and not taken for the wanted one
    assert ngram_join.sets_of(df, other, 5).count() == 0
