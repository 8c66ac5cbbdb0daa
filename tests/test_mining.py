"""Hand-checked mining, thresholds, properties and the monotone sweep."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.ml.fpm import FPGrowth

from trolley.operators.mining import MiningParams, mine, sweep
from trolley.plans.study import Study

FIVE = [["a", "b"], ["a", "b"], ["a", "b", "c"], ["a", "c"], ["b", "c"]]


def itemsets_of(res):
    return {tuple(r["items"]): r["freq"] for r in res.itemsets.collect()}


def rules_of(res):
    return {(tuple(r["antecedent"]), tuple(r["consequent"])): (r["confidence"], r["lift"], r["support"]) for r in res.rules.collect()}


@pytest.mark.parametrize(
    "support,expected,n_rules",
    [
        (0.2, {"a": 4, "b": 4, "c": 3, "ab": 3, "ac": 2, "bc": 2, "abc": 1}, 8),
        (0.4, {"a": 4, "b": 4, "c": 3, "ab": 3, "ac": 2, "bc": 2}, 6),
        (0.41, {"a": 4, "b": 4, "c": 3, "ab": 3}, 2),
        (0.6, {"a": 4, "b": 4, "c": 3, "ab": 3}, 2),
    ],
)
def test_five_baskets(make_baskets, support, expected, n_rules):
    res = mine(make_baskets(FIVE), MiningParams(support, 0.5))
    got = {"".join(k): v for k, v in itemsets_of(res).items()}
    assert got == expected
    assert res.rules.count() == n_rules
    assert res.n_baskets == 5


def test_five_basket_rule_measures(make_baskets):
    rules = rules_of(mine(make_baskets(FIVE), MiningParams(0.2, 0.5)))
    exp = {
        (("a",), ("b",)): (0.75, 0.9375, 0.6),
        (("b",), ("a",)): (0.75, 0.9375, 0.6),
        (("a",), ("c",)): (0.5, 0.5 / 0.6, 0.4),
        (("b",), ("c",)): (0.5, 0.5 / 0.6, 0.4),
        (("c",), ("a",)): (2 / 3, (2 / 3) / 0.8, 0.4),
        (("c",), ("b",)): (2 / 3, (2 / 3) / 0.8, 0.4),
        (("a", "c"), ("b",)): (0.5, 0.625, 0.2),
        (("b", "c"), ("a",)): (0.5, 0.625, 0.2),
    }
    assert set(rules) == set(exp)
    for k, v in exp.items():
        assert rules[k] == pytest.approx(v, rel=1e-12)
    assert (("a", "b"), ("c",)) not in rules  # confidence 1/3


def test_null_basket_leaves_denominator(spark):
    df = spark.createDataFrame([(0, ["a", "b"]), (1, None), (2, ["a", "b"])], "basket_id long, items array<string>")
    res = mine(df, MiningParams(0.6, 0.5))
    assert res.n_baskets == 2
    assert itemsets_of(res)[("a", "b")] == 2
    assert all(s == 1.0 for _, _, s in rules_of(res).values())


def test_empty_input(make_baskets):
    res = mine(make_baskets([]), MiningParams(0.1, 0.1))
    assert res.itemsets.count() == 0 and res.rules.count() == 0


def test_duplicate_items_rejected(make_baskets):
    with pytest.raises(Exception, match="unique"):
        mine(make_baskets([["a", "a"], ["a", "b"]]), MiningParams(0.1, 0.1))


@pytest.mark.parametrize("bad", [0, -0.1, 1.5])
def test_params_validated(bad):
    with pytest.raises(ValueError):
        MiningParams(bad, 0.5)
    with pytest.raises(ValueError):
        MiningParams(0.5, bad)


def test_min_count_is_inclusive_ceiling():
    assert MiningParams(0.41, 0.5).min_count(5) == 3
    assert MiningParams(0.4, 0.5).min_count(5) == 2


@pytest.fixture(scope="module")
def small_study(spark):
    s = Study(spark, "/root/testdata/sf0.001")
    yield s
    s.release()


def test_properties(small_study):
    res = small_study.mined
    sets = itemsets_of(res)
    n = res.n_baskets
    k = res.params.min_count(n)
    for items, freq in sets.items():
        assert freq >= k
        for i in range(len(items)):  # downward closed, support never rises
            sub = items[:i] + items[i + 1 :]
            if sub:
                assert sub in sets and sets[sub] >= freq
    for (a, c), (conf, lift, sup) in rules_of(res).items():
        assert sup <= conf <= 1.0 + 1e-12
        u = tuple(sorted(a + c))
        assert sets[u] == round(sup * n)
        assert conf == pytest.approx(sets[u] / sets[a])
        assert lift == pytest.approx(conf / (sets[c] / n))
    rules = rules_of(res)
    for (a, c), (_, lift, _) in rules.items():
        if len(a) == 1 and (c, a) in rules:
            assert rules[(c, a)][1] == pytest.approx(lift, rel=1e-12)


def test_expected_sizes_at_sf0001(small_study):
    res = small_study.mined
    assert res.n_baskets == 1351
    sizes = {}
    for items in itemsets_of(res):
        sizes[len(items)] = sizes.get(len(items), 0) + 1
    assert sizes == {1: 25, 2: 300, 3: 542}
    assert res.rules.count() == 2142
    assert res.rules.where("lift > 1").count() == 1373


def test_filtered_equals_remining(small_study):
    base = small_study.mined
    for s, c in [(0.01, 0.2), (0.02, 0.3), (0.03, 0.15)]:
        again = mine(small_study.baskets, MiningParams(s, c))
        cut = base.filtered(s, c)
        assert itemsets_of(cut) == itemsets_of(again)
        assert rules_of(cut) == rules_of(again)
        again.unpersist()


def test_sweep_counts(small_study):
    rows = sweep(small_study.baskets, [(0.005, 0.1), (0.02, 0.3)], mined=small_study.mined).collect()
    got = {(r["min_support"], r["min_confidence"]): (r["n_itemsets"], r["n_rules"]) for r in rows}
    assert got[(0.005, 0.1)] == (867, 2142)
    n = small_study.mined.n_baskets
    assert got[(0.02, 0.3)][0] == sum(1 for f in itemsets_of(small_study.mined).values() if f >= math.ceil(0.02 * n))


def _brute_force(baskets, support, confidence):
    """Every subset of every basket, counted; rules from the frequent ones."""
    from itertools import combinations

    n = len(baskets)
    counts = {}
    for b in baskets:
        items = sorted(b)
        for k in range(1, len(items) + 1):
            for sub in combinations(items, k):
                counts[sub] = counts.get(sub, 0) + 1
    k_min = math.ceil(support * n)
    freq = {s: f for s, f in counts.items() if f >= k_min}
    rules = {}
    for u, fu in freq.items():
        if len(u) < 2:
            continue
        for c in u:
            a = tuple(x for x in u if x != c)
            conf = fu / freq[a]
            if conf >= confidence:
                rules[(a, (c,))] = (conf, conf / (freq[(c,)] / n), fu / n)
    return freq, rules


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_random_baskets_match_brute_force(make_baskets, seed):
    import random

    rnd = random.Random(seed)
    universe = [f"i{k}" for k in range(9)]
    baskets = [sorted(rnd.sample(universe, rnd.randint(1, 6))) for _ in range(120)]
    support, confidence = rnd.choice([0.05, 0.1, 0.15]), rnd.choice([0.2, 0.5])
    freq, rules = _brute_force(baskets, support, confidence)
    res = mine(make_baskets(baskets), MiningParams(support, confidence))
    assert itemsets_of(res) == freq
    got = rules_of(res)
    assert set(got) == set(rules)
    for k, v in rules.items():
        assert got[k] == pytest.approx(v, rel=1e-12)


def test_mined_tables_are_cut_from_their_lineage(small_study):
    res = small_study.mined
    for df in (res.itemsets, res.rules):
        lineage = df.rdd.toDebugString().decode()
        assert "ReliableCheckpointRDD" in lineage
        assert "FPGrowth" not in lineage


def test_filtered_rejects_looser_thresholds(small_study):
    with pytest.raises(ValueError):
        small_study.mined.filtered(0.001, 0.1)
    with pytest.raises(ValueError):
        small_study.mined.filtered(0.005, 0.05)


def test_sweep_gives_a_row_for_each_setting_as_given(make_baskets):
    rows = sweep(make_baskets(FIVE), [(0.2, 0.5), (0.2, 0.5)]).collect()
    assert len(rows) == 2 and rows[0] == rows[1]


def test_sweep_mines_at_the_loosest_setting(make_baskets):
    settings = [(0.6, 0.5), (0.2, 0.9), (0.4, 0.5)]
    rows = sweep(make_baskets(FIVE), settings).collect()
    got = {(r["min_support"], r["min_confidence"]): (r["n_itemsets"], r["n_rules"]) for r in rows}
    for s, c in settings:
        direct = mine(make_baskets(FIVE), MiningParams(s, c))
        assert got[(s, c)] == (direct.itemsets.count(), direct.rules.count())


@pytest.mark.parametrize("num_partitions", [1, 3, 16])
def test_hot_item_matches_brute_force_at_any_group_count(make_baskets, num_partitions):
    """One item in nine baskets of ten: its conditional database is the
    largest FP-growth group; the result is exact whatever the group count."""
    import random

    rnd = random.Random(11)
    universe = [f"i{k}" for k in range(10)]
    baskets = []
    for _ in range(300):
        b = set(rnd.sample(universe, rnd.randint(1, 4)))
        if rnd.random() < 0.9:
            b.add("hot")
        baskets.append(sorted(b))
    freq, rules = _brute_force(baskets, 0.04, 0.3)
    res = mine(make_baskets(baskets).repartition(5), MiningParams(0.04, 0.3, num_partitions))
    assert itemsets_of(res) == freq
    got = rules_of(res)
    assert set(got) == set(rules)
    for k, v in rules.items():
        assert got[k] == pytest.approx(v, rel=1e-12)
    res.unpersist()


@pytest.mark.parametrize(("strict", "loose", "confidence"), [(0.3, 0.05, 0.1), (0.2, 0.19, 0.6), (0.9, 0.03, 0.3), (0.1, 0.1, 0.05)])
def test_loosened_equals_mining_anew(spark, make_baskets, strict, loose, confidence):
    """Without a fit: itemsets and rules at a lower support, from those at a higher one."""
    from trolley.operators.items import item_counts

    rnd = random.Random(int(strict * 100))
    rows = [sorted({rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))} | ({"hot"} if rnd.random() < 0.9 else set())) for _ in range(250)]
    baskets = make_baskets(rows).persist()
    wanted = mine(baskets, MiningParams(loose, confidence))
    fits = []
    start = mine(baskets, MiningParams(strict, 0.5))
    original = FPGrowth.fit
    try:
        FPGrowth.fit = lambda self, *a, **k: fits.append(1) or original(self, *a, **k)
        got = start.loosened(baskets, item_counts(baskets), loose, confidence)
    finally:
        FPGrowth.fit = original
    assert not fits
    sets = lambda r: sorted((tuple(x["items"]), x["freq"]) for x in r.itemsets.collect())
    rules = lambda r: sorted((tuple(x["antecedent"]), tuple(x["consequent"]), x["confidence"], x["lift"], x["support"]) for x in r.rules.collect())
    assert sets(got) == sets(wanted)
    assert rules(got) == rules(wanted)
    with pytest.raises(ValueError):
        got.loosened(baskets, item_counts(baskets), min(1.0, loose * 2), confidence)
    baskets.unpersist()


def test_loosened_without_baskets(spark, make_baskets):
    from trolley.operators.items import item_counts

    baskets = spark.createDataFrame([], "basket_id long, items array<string>")
    got = mine(baskets, MiningParams(0.5, 0.5)).loosened(baskets, item_counts(baskets), 0.1, 0.1)
    assert got.itemsets.collect() == [] and got.rules.collect() == []


@pytest.mark.parametrize(("support", "rows"), [(0.05, 100), (0.02, 150), (0.3, 60), (0.1, 1000), (0.6, 1)])
def test_projected_items_give_the_same(spark, make_baskets, support, rows):
    """Oversized items mined apart: the itemsets and rules of FP-growth, with one item in every basket."""
    rnd = random.Random(rows)
    baskets = [sorted({rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))} | {"all"} | ({"most"} if rnd.random() < 0.7 else set())) for _ in range(220)]
    frame = make_baskets(baskets).persist()
    wanted = mine(frame, MiningParams(support, 0.2))
    got = mine(frame, MiningParams(support, 0.2, num_partitions=3, max_group_rows=rows))
    assert itemsets_of(got) == itemsets_of(wanted) and got.itemsets.count() == wanted.itemsets.count()
    assert rules_of(got) == rules_of(wanted)
    frame.unpersist()


def test_no_item_group_is_as_large_as_its_baskets(spark, make_baskets, monkeypatch):
    """What FP-growth is given holds no item in more baskets than the bound, but by itself in its own projection."""
    frame = make_baskets([["all", chr(97 + k % 20), chr(97 + (k * 7 + 3) % 20)] for k in range(200)])
    largest = []
    original = FPGrowth.fit

    def fit(self, data, *more):
        counts = data.selectExpr("explode(items) as item").groupBy("item").count()
        largest.append(max((r["count"] for r in counts.collect()), default=0))
        return original(self, data, *more)

    monkeypatch.setattr(FPGrowth, "fit", fit)
    mine(frame, MiningParams(0.02, 0.2, max_group_rows=50))
    assert len(largest) == 2 and max(largest) <= 50


def test_projected_without_baskets(spark):
    baskets = spark.createDataFrame([], "basket_id long, items array<string>")
    got = mine(baskets, MiningParams(0.5, 0.5, max_group_rows=3))
    assert got.itemsets.collect() == [] and got.rules.collect() == []


def test_equal_baskets_are_mined_once(spark, make_baskets, monkeypatch):
    """Patterns grow over different baskets with their counts; every itemset of brute force."""

    def fit(*_):
        raise AssertionError("an item's baskets would be gathered")

    monkeypatch.setattr(FPGrowth, "fit", fit)
    rnd = random.Random(5)
    kinds = [sorted({rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 4))}) for _ in range(12)] + [list("abcd")]
    baskets = [kinds[min(12, int(rnd.expovariate(0.3)))] for _ in range(300)]
    got = itemsets_of(mine(make_baskets(baskets), MiningParams(0.05, 0.2, num_partitions=3)))
    sets = {c for b in kinds for k in range(1, len(b) + 1) for c in itertools.combinations(b, k)}
    counted = {c: sum(set(c) <= set(b) for b in baskets) for c in sets}
    assert got == {c: k for c, k in counted.items() if k >= 15}
