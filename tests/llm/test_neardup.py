import random

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import neardup as N


def texts(rng, n, words=60, vocabulary=400):
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            w = rng.choice(out).split()
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(vocabulary)}"
        else:
            w = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(1, words))]
        out.append(" ".join(w))
    return out


def brute(rows, k, t):
    sets = {i: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for i, w in ((i, x.split()) for i, x in rows if i is not None and x is not None)}
    out = set()
    for a in sets:
        for b in sets:
            if a < b:
                both = len(sets[a] & sets[b])
                same_text = dict(rows)[a] == dict(rows)[b]
                if same_text or (both and both / len(sets[a] | sets[b]) >= t):
                    out.add((a, b))
    return out


def found(spark, rows, k, t):
    df = spark.createDataFrame([(i, x, "clash", 1) for i, x in rows], "id bigint, words string, k1 string, s int")
    members, pairs = N.near_duplicates(df, k, t)
    return {(r.a, r.b) for r in N.all_pairs(members, pairs).collect()}, members


@pytest.mark.parametrize("k,t,seed", [(3, 0.6, 1), (5, 0.8, 2), (2, 0.5, 3), (1, 0.9, 4)])
def test_exact_against_brute_force(spark, k, t, seed):
    rows = list(enumerate(texts(random.Random(seed), 250)))
    got, members = found(spark, rows, k, t)
    assert got == brute(rows, k, t)
    assert members.count() == len(rows)


def test_boilerplate_copies_nulls_and_short_texts(spark):
    rng = random.Random(9)
    shared = " ".join(f"b{i}" for i in range(40))
    rows = [(i, shared + " " + " ".join(f"u{i}x{j}" for j in range(rng.randint(5, 40)))) for i in range(120)]
    rows += [(500 + i, "same words in every row of this group") for i in range(30)] + [(900, None), (901, ""), (902, "one"), (None, "a b c d")]
    got, _ = found(spark, rows, 3, 0.6)
    assert got == brute([r for r in rows if r[0] is not None and r[1] is not None], 3, 0.6)


def test_a_hot_class_is_split_and_repeated_rows_count_once(spark):
    rows = [(i, "one text that very many rows share " * 3) for i in range(90)] + [(200, "one text that very many rows share " * 3 + "x"), (3, "one text that very many rows share " * 3), (200, "one text that very many rows share " * 3 + "x")]
    df = spark.createDataFrame([(i, x, "clash", 1) for i, x in rows], "id bigint, words string, k1 string, s int")
    members, pairs = N.near_duplicates(df, 3, 0.6)
    got = [(r.a, r.b) for r in N.all_pairs(members, pairs, per_salt=7).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 3, 0.6)


def test_empty_and_very_long(spark):
    assert found(spark, [], 3, 0.6)[0] == set()
    long = [f"w{i}" for i in range(20_000)]
    other = [*long[:15_000], *(f"v{i}" for i in range(2_000)), *long[15_000:]]
    assert found(spark, [(1, " ".join(long)), (2, " ".join(other)), (3, "short text")], 3, 0.6)[0] == {(1, 2)}


def test_salted_tokens_give_the_same(spark):
    rows = list(enumerate(texts(random.Random(6), 150, vocabulary=30)))
    df = spark.createDataFrame(rows, "id bigint, words string")
    _, sets = N.text_classes(df, 2)
    a = {(r.a, r.b) for r in N.similar_pairs(sets, 150, 0.5).collect()}
    b = {(r.a, r.b) for r in N.similar_pairs(sets, 150, 0.5, per_salt=5, most_matches=1, most_buckets=1 << 16).collect()}
    assert a == b and a


def test_groups_and_repeated_rows(spark):
    base = [f"w{i}" for i in range(40)]
    a, b, c = " ".join(base), " ".join([*base[:36], "x", *base[37:]]), " ".join([*base[:30], *(f"z{i}" for i in range(40))])
    rows = [(1, a), (1, a), (2, a), (3, b), (4, c)]
    df = spark.createDataFrame(rows, "id bigint, words string")
    members, pairs = N.near_duplicates(df, 3, 0.6)
    got = {r.id: (r.class_id, r.group_id, r.copies, r.links) for r in N.groups(members, pairs).collect()}
    assert got == {1: (1, 1, 2, 1), 2: (1, 1, 2, 1), 3: (3, 1, 1, 1), 4: (4, 4, 1, 0)}


def test_words(spark):
    df = spark.createDataFrame([("  Foo_BAR-7\nbaz é ",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(N.words(F.col("x"))).collect()] == ["foo bar 7 baz", "", None]
