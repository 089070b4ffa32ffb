import random
from collections import Counter, defaultdict

import pytest

from quillgraph.llm import mixing, packing, tokens

BUDGETS = "budget_id int, label string, capacity int"


@pytest.mark.parametrize("capacity", [1, 2, 7, 100, 2048])
@pytest.mark.parametrize("seed", range(6))
def test_plan(capacity, seed):
    rng = random.Random(seed)
    items = [rng.randint(1, capacity if rng.random() < 0.4 else max(1, capacity // 4)) for _ in range(rng.randint(0, 500))]
    runs, n = packing.plan_containers(dict(Counter(items)), capacity)
    ranks, space, large = Counter(), Counter(), Counter()
    for size, a, b, each, first in runs:
        assert ranks[size] == a and (b - a) % each == 0
        ranks[size] = b
        for r in range(a, b):
            space[first + (r - a) // each] += size
            large[first + (r - a) // each] += 3 * size > capacity
    assert ranks == Counter(items) and set(space) == set(range(n))
    assert all(v <= capacity for v in space.values()) and all(v <= 2 for v in large.values())
    assert n <= 1.25 * -(-sum(items) // capacity) + 1 or all(3 * s > capacity for s in items) or n <= sum(2 * s > capacity for s in items) + -(-sum(s for s in items if 2 * s <= capacity) // capacity) + 1


def packed(spark, items, budgets):
    rows = packing.pack(spark.createDataFrame(items, "doc_id bigint, tokens bigint, item string"), spark.createDataFrame(budgets, BUDGETS))
    return rows.collect()


def test_pack(spark):
    rng = random.Random(1)
    items = [(i, rng.choice([3, 10, 10, 10, 40, 170, 0]), "clash") for i in range(600)] + [(7, 33, "again"), (7, 33, "again"), (9999, 100_000, "x"), (10, None, "x"), (None, 5, "x")]
    budgets = [(1, "a", 50), (2, "b", 64), (3, "bad", 0), (4, "null", None)]
    rows = packed(spark, items, budgets)
    for b, capacity in ((1, 50), (2, 64)):
        mine = [r for r in rows if r.budget_id == b]
        space, by_doc = Counter(), defaultdict(int)
        for r in mine:
            by_doc[r.doc_id] += r.n_tokens
            if r.n_tokens:
                space[r.container] += r.n_tokens
        want = defaultdict(int)
        for d, t, _ in items:
            want[d] += t or 0
        assert all(r.part == 0 or by_doc[r.doc_id] > capacity for r in mine)
        assert by_doc == want and max(space.values()) <= capacity and set(space) == set(range(len(space)))
        fewest = max(-(-sum(want.values()) // capacity), sum(2 * r.n_tokens > capacity for r in mine))
        assert len(space) <= 1.02 * fewest + 1
    assert {r.budget_id for r in rows} == {1, 2}


def test_pack_empty(spark):
    assert packed(spark, [], [(1, "a", 10)]) == [] and packed(spark, [(1, 5, "x")], []) == []


WEIGHTS = "source string, target_share double, max_repeats int, tokens int"


def test_mix(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["Big_One", "big-one", " BIG ONE ", "mid", "MID"]), rng.randint(1, 60), "c") for i in range(3000)] + [(5000 + i, "tiny", 20, "c") for i in range(30)]
    docs += [(9001, None, 50, "c"), (9002, "unlisted", 50, "c"), (9003, "mid", 0, "c"), (9004, "mid", None, "c")]
    weights = [("big_one", 0.5, 1, 0), ("mid", 0.2, 2, 0), ("tiny", 0.1, 3, 0), ("absent", 0.2, 1, 0), (None, 0.1, 1, 0)]
    mixed, shares = mixing.mix(spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint, slot string"), spark.createDataFrame(weights, WEIGHTS), block_tokens=100)
    rows = sorted(mixed.collect(), key=lambda r: r.first_token)
    at = 0
    for r in rows:
        assert r.first_token == at
        at += r.tokens
    uses = Counter((s, d) for s, d, _ in {(r.source, r.doc_id, r.repeat) for r in rows})
    assert max(n for (s, _), n in uses.items() if s == "big_one") == 1 and max(n for (s, _), n in uses.items() if s == "tiny") <= 3
    report = {r.source: r for r in shares.collect()}
    assert report["absent"].tokens == 0 and report["tiny"].repeats == 3
    for s, want in (("big_one", 0.625), ("mid", 0.25), ("tiny", 0.125)):
        assert report[s].actual_share == pytest.approx(want, abs=1e-4)
        got = 0
        for r in rows:
            got += r.tokens * (r.source == s)
            assert abs(got - want * (r.first_token + r.tokens)) < 200  # within a block it may be one more block away
            if (r.first_token + r.tokens) % 100 == 0:
                assert abs(got - want * (r.first_token + r.tokens)) < 100
    whole = {(r.source, r.doc_id, r.repeat): 0 for r in rows}
    for r in rows:
        whole[r.source, r.doc_id, r.repeat] += r.tokens
    sizes = {d: t for d, _, t, _ in docs}
    assert sum(sizes[d] != t for (_, d, _), t in whole.items()) <= 3  # only the document at a quota


@pytest.mark.parametrize("seed", range(5))
def test_schedule_stays_within_a_block(seed):
    rng = random.Random(seed)
    weights = {f"s{i}": rng.randint(1, 60) for i in range(rng.randint(1, 12))}
    period, got = sum(weights.values()), Counter()
    for at, s in enumerate(mixing.schedule(weights), 1):
        got[s] += 1
        assert all(abs(got[x] * period - at * w) < period for x, w in weights.items())
    assert got == weights


def test_weights_of_shares():
    assert mixing.whole_weights({"a": 0.22, "b": 0.18, "c": 0.6}) == {"a": 11, "b": 9, "c": 30}
    assert mixing.whole_weights({"a": 1 / 3, "b": 1e-12}, 1000) == {"a": 1000, "b": 1} and mixing.whole_weights({}) == {}


@pytest.mark.parametrize("block", [7, 64, 1000])
def test_mix_covers_every_token_once(spark, block):
    docs = [(i, "ab"[i % 3 == 0], 1 + i * 37 % 91) for i in range(200)] + [(900, "c", 5000), (901, "c", 1)]
    weights = [("a", 0.5, 2, 0), ("b", 0.3, 1, 0), ("c", 0.2, 3, 0)]
    mixed, shares = mixing.mix(spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint"), spark.createDataFrame(weights, WEIGHTS), block_tokens=block)
    rows, at = sorted(mixed.collect(), key=lambda r: r.first_token), 0
    for r in rows:
        assert r.first_token == at
        at += r.tokens
    assert at == sum(r.quota for r in shares.collect()) and len({(r.source, r.doc_id, r.repeat, r.from_token) for r in rows}) == len(rows)


def test_mix_without_anything(spark):
    docs, weights = spark.createDataFrame([], "doc_id bigint, source string, tokens bigint"), spark.createDataFrame([("a", 1.0, 1, 0)], WEIGHTS)
    mixed, shares = mixing.mix(docs, weights)
    assert mixed.count() == 0 and shares.head().tokens == 0


def test_one_of_each_text(spark):
    docs = spark.createDataFrame([(3, "a  b\n", "x"), (2, "a b", "y"), (5, " a b", "x"), (4, "c", "x")], "doc_id bigint, text string, source string")
    assert sorted((r.doc_id, r.source) for r in mixing.one_of_each_text(docs, "text").collect()) == [(2, "y"), (4, "x")]


def test_tokens_of_whole_texts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "word " * 50_000), (5, "日本語 <|endoftext|>")], "i int, text string")
    got = {r.i: r.tokens for r in tokens.with_tokens(df, "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 50_000 and got[5] > 3
