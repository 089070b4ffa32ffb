import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import bloom, copies

SCHEMA = "rec_id bigint, id string, label string, tab string, key string, h bigint"


def rows_of(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash", 0) for r in rows], SCHEMA)
    return copies.keyed(df, "t", "rec_id", loose=("id", "label"))


def bare(x):
    return "".join(c for c in x.lower() if c.isalnum())


def key(x):
    fields = re.findall(r"([\w-]+)\s*=\s*([\w-]+)", x)
    return (bare(re.sub(r"([\w-]+)\s*=\s*([\w-]+)", "", x)), tuple(sorted((bare(a), bare(b)) for a, b in fields))) if fields else bare(x)


def brute(rows):
    groups = {}
    for i, a, b in rows:
        if a and b and a.strip() and b.strip():
            groups.setdefault((key(a), key(b)), []).append(i)
    return sorted((min(g), i) for g in groups.values() for i in g if i > min(g))


def found(spark, rows, **kw):
    return sorted((r.kept_id, r.copy_id) for r in copies.found_copies(rows_of(spark, rows), len(rows), **kw).collect())


CASES = [
    (1, "a_b", "Foo()"), (2, "A b", "foo"), (3, "ab", "f-o.o"), (4, "ab", "fooo"), (5, None, "foo"), (6, "ab", " "), (7, "ab", None), (8, "", "foo"),
    (9, "x", "Disk[env=qa; name=a-b]"), (10, "x", "DISK{NAME = A-B / ENV = QA}"), (11, "x", "Disk[env=ab; name=qa]"), (12, "x", "Tape[env=qa; name=a-b]"),
    (13, "höhe", "señal"), (14, "HÖHE", "SEÑAL!"), (15, "hohe", "senal"), (16, "long", "x" * 100_000), (17, "LONG", "X" * 100_000), (18, "x=1", "y"), (19, "X = 1", "Y"),
]


def test_spellings(spark):
    assert found(spark, CASES) == brute(CASES) == [(1, 2), (1, 3), (9, 10), (13, 14), (16, 17), (18, 19)]


def test_collapsed_counts_all_rows(spark):
    got = {r.kept_id: r.copies for r in copies.collapsed(rows_of(spark, CASES), len(CASES)).collect()}
    assert sum(got.values()) == len(CASES) and got[1] == 3 and got[5] == 1


def test_random_rows_slices_and_a_hot_group(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(string.ascii_letters + "_- ") for _ in range(rng.randint(1, 3)))
    rows = [(i, word(), word()) for i in range(1500)] + [(i, "Hot", "group") for i in range(1500, 2300)]
    want = brute(rows)
    assert found(spark, rows) == want
    assert found(spark, rows, per_key=16, most_bits=1 << 13) == want  # several slices, full filters


def test_empty(spark):
    empty = copies.keyed(spark.createDataFrame([], SCHEMA), "t", "rec_id", loose=("id", "label"))
    assert copies.found_copies(empty, 0).count() == 0 and copies.collapsed(empty, 0).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_filter_misses_no_repeat(spark, parts):
    df = spark.range(4000, numPartitions=parts).select(F.xxhash64(F.col("id") % 3500).alias("h"))
    bits = bloom.filter_bits(4000, 16, 1 << 20)
    filter_ = bloom.repeat_filter(df, bits)
    h = np.array([r.h for r in df.collect()])
    hit = bloom._has(filter_, bloom.positions(h, bits))
    values, counts = np.unique(h, return_counts=True)
    again = np.isin(h, values[counts > 1])
    assert hit[again].all() and hit[~again].mean() < 0.05
