import itertools
import os
import random
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from lonja.operators import betweenness as module
from lonja.operators import cooccurrence
from lonja.operators.betweenness import betweenness
from lonja.operators.cooccurrence import shared_holders
from lonja.operators.quantiles import percentiles
from lonja.runtime import drop_staged


def brandes(edges):
    """Normalised betweenness by the textbook algorithm."""
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    score = dict.fromkeys(near, 0.0)
    for source in near:
        order, parents = [], defaultdict(list)
        paths, distance = Counter({source: 1}), {source: 0}
        queue = deque([source])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in distance:
                    distance[w] = distance[v] + 1
                    queue.append(w)
                if distance[w] == distance[v] + 1:
                    paths[w] += paths[v]
                    parents[w].append(v)
        passed = Counter()
        for w in reversed(order):
            for v in parents[w]:
                passed[v] += paths[v] / paths[w] * (1 + passed[w])
            if w != source:
                score[w] += passed[w]
    n = len(near)
    return {v: s / ((n - 1) * (n - 2)) for v, s in score.items()}


def scores(spark, edges, **options):
    df = spark.createDataFrame(edges, "src string, dst string")
    return {row.node: row.betweenness for row in betweenness(df, **options).collect()}


@pytest.mark.parametrize(
    "edges, expected",
    [
        ([("a", "b"), ("b", "c")], {"a": 0, "b": 1, "c": 0}),
        ([("h", x) for x in "abcd"], {"h": 1, "a": 0, "b": 0, "c": 0, "d": 0}),
        ([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")], dict.fromkeys("abcd", 1 / 6)),
        ([("a", "b")], {}),
    ],
)
def test_betweenness_of_known_graphs(spark, edges, expected):
    assert scores(spark, edges) == pytest.approx(expected)


def test_betweenness_of_random_graph_with_split_hubs(spark):
    chance = random.Random(11)
    edges = {(f"s{chance.randrange(6)}", f"b{chance.randrange(25)}") for _ in range(60)}
    edges |= {("s0", f"b{i}") for i in range(20)} | {("x", "y"), ("y", "z")}
    found = scores(spark, sorted(edges), rounds=2, per_slot=3)
    assert found == pytest.approx(brandes(edges))


def staged_names(spark):
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/lonja-{spark.sparkContext.applicationId}"
    return sorted(n.rsplit("-", 1)[0] for n in os.listdir(folder)) if os.path.exists(folder) else []


def test_at_most_one_round_keeps_its_levels(spark, monkeypatch):
    drop_staged(spark)
    chance = random.Random(2)
    edges = sorted({(f"s{chance.randrange(9)}", f"b{chance.randrange(30)}") for _ in range(70)})
    seen, searched = [], module._search
    monkeypatch.setattr(module, "_search", lambda *given: seen.append(staged_names(spark)) or searched(*given))
    result = betweenness(spark.createDataFrame(edges, "src string, dst string"), rounds=4)
    assert len(seen) == 4 and not any(name in ("level", "dependency") for names in seen for name in names)
    assert set(staged_names(spark)) <= {"nodes", "rounds"}
    assert {r.node: r.betweenness for r in result.collect()} == pytest.approx(brandes(edges))
    drop_staged(spark)


def test_betweenness_from_a_sample_of_nodes(spark):
    chance = random.Random(8)
    edges = sorted({(f"s{chance.randrange(12)}", f"b{chance.randrange(40)}") for _ in range(110)})
    df = spark.createDataFrame(edges, "src string, dst string")
    exact = brandes(edges)
    whole = betweenness(df, sources=len(exact) + 5, rounds=2).collect()
    assert {r.node: r.betweenness for r in whole} == pytest.approx(exact)
    assert {r.standard_error for r in whole} == {0.0}
    some = betweenness(df, sources=30, rounds=2).collect()
    assert {r.node for r in some} == set(exact)
    near = [abs(r.betweenness - exact[r.node]) <= 3 * r.standard_error + 1e-9 for r in some]
    assert sum(near) >= 0.9 * len(near) and any(r.standard_error > 0 for r in some)
    assert sum(r.betweenness for r in some) == pytest.approx(sum(exact.values()), rel=0.3)
    with pytest.raises(ValueError):
        betweenness(df, sources=0)


def pairs_by_hand(baskets):
    counts = Counter()
    for items in baskets.values():
        counts.update(itertools.combinations(sorted(items), 2))
    return dict(counts)


@pytest.mark.parametrize("tile_items, matrix_items", [(1000, 256), (12, 256), (12, 3), (2, 256)])
def test_shared_holders_counts_every_pair(spark, monkeypatch, tile_items, matrix_items):
    monkeypatch.setattr(cooccurrence, "MATRIX_ITEMS", matrix_items)
    monkeypatch.setattr(cooccurrence, "HOLDERS_PER_PRODUCT", 7)
    monkeypatch.setattr(cooccurrence, "PAIRS_PER_COUNT", 50)
    chance = random.Random(5)
    baskets = {
        f"h{h}": {f"i{chance.randrange(40)}" for _ in range(chance.randrange(1, 9))}
        for h in range(60)
    }
    baskets["everything"] = {f"i{i}" for i in range(40)}
    rows = [(h, i) for h, items in baskets.items() for i in items]
    holdings = spark.createDataFrame(rows, "holder string, item string")
    items = holdings.groupBy("item").agg(F.count("*").alias("holders"))
    found = shared_holders(holdings, items, items.count(), tile_items=tile_items)
    by_pair = {(r.item_a, r.item_b): r.shared for r in found.collect()}
    assert by_pair == pairs_by_hand(baskets)


def interpolated(values, fraction):
    values = sorted(values)
    at = (len(values) - 1) * fraction
    low, high = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
    return low + (high - low) * (at - int(at))


@pytest.mark.parametrize(
    "values",
    [
        [1.0],
        [1.0, 2.0],
        [5.0, 1.0, 3.0, 2.0],
        [0.0] * 500 + [float(i) for i in range(1000)],
        [random.Random(1).gauss(0, 1) for _ in range(3001)],
    ],
    ids=["one", "two", "four", "ties", "many"],
)
@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_percentiles_are_exact(spark, values, accuracy):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    fractions = (0.8, 0.5, 0.2, 0.0, 1.0)
    found = percentiles(df, "x", fractions, accuracy)
    assert found == pytest.approx([interpolated(values, f) for f in fractions], abs=1e-12)


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert percentiles(df, "x", (0.5, 0.2)) == [None, None]


def test_percentiles_with_a_rank_beside_the_bracket(spark):
    df = spark.range(7).select(F.col("id").cast("double").alias("x"))
    assert percentiles(df, "x", (0.2, 0.33), 10_000) == pytest.approx([1.2, 1.98])
