import random

from pyspark.sql import functions as F

from lustrum.llm.common import ascii_lower, few_broadcast, gapless_rank
from lustrum.llm.components import connected_components


def roots(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return {(x, top(x)) for x in up if top(x) != x}


def run(spark, edges, kind="long"):
    return {tuple(r) for r in connected_components(spark.createDataFrame(edges, f"a {kind}, b {kind}")).collect()}


def test_random_graphs(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(None, 1), (2, None), (5, 5)]
    assert run(spark, edges) == roots(edges)


def test_paths_and_hubs(spark):
    path = [(i, i + 1) for i in range(400)]
    random.Random(1).shuffle(path)
    hub = [(1000, 1001 + i) for i in range(500)] + [(3000 + i, 3999) for i in range(300)]
    assert run(spark, path + hub) == roots(path + hub)


def test_words_and_nothing(spark):
    edges = [("b", "a"), ("c", "b"), ("x", "y"), ("c", "a")]
    assert run(spark, edges, "string") == roots(edges)
    assert run(spark, []) == set() and run(spark, [(1, 1)]) == set()


def test_gapless_rank(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    got = gapless_rank(df, ["g"], F.pmod(F.xxhash64("id"), F.lit(7)), [F.col("id")], "r").collect()
    for g in range(3):
        assert sorted(r.r for r in got if r.g == g) == list(range(sum(r.g == g for r in got)))


def test_small_things(spark):
    assert spark.range(1).select(ascii_lower(F.lit("AZaz09ÉÀ"))).first()[0] == "azaz09ÉÀ"
    few = spark.range(10)
    assert "Broadcast" in spark.range(100).join(few_broadcast(few, 10), "id")._jdf.queryExecution().toString()
    assert few_broadcast(few, 9).count() == 10
