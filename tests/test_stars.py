"""Communities over the indicator-context star."""
import itertools

import pytest

from beaconry.operators import stars

SCHEMA = "ioc string, context_id string"


def planted(spark, families, width, contexts, hub=True):
    """Every context names all but one indicator of its family."""
    rows = [
        (f"f{f:02d}-{i}", f"x{f:02d}-{c}")
        for f in range(families) for c in range(contexts) for i in range(width) if (i + c) % width
    ]
    if hub:
        rows += [("hub", f"x{f:02d}-0") for f in range(families)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("families, width", [(4, 6), (12, 4), (5, 30)])
def test_planted_families_are_found(spark, families, width):
    got = {r.id: r.community for r in stars.membership(planted(spark, families, width, 5)).collect() if r.id != "hub"}
    assert len(got) == families * width
    for f in range(families):
        assert len({got[f"f{f:02d}-{i}"] for i in range(width)}) == 1
    assert len(set(got.values())) == families


def test_one_edge_per_mention(spark):
    mentions = planted(spark, 3, 40, 5).union(planted(spark, 1, 40, 1, hub=False))  # the first context again
    edges = stars.star_edges(mentions)
    assert edges.count() == mentions.distinct().count()
    weights = {r.a: r.w for r in edges.groupBy("a").sum("w").withColumnRenamed("sum(w)", "w").collect()}
    assert all(w == pytest.approx(1.0) for w in weights.values())


def test_modularity_against_all_partitions(spark):
    """No partition of a small graph does better than the one found."""
    mentions = planted(spark, 2, 3, 3, hub=False)
    ids = sorted({r.ioc for r in mentions.collect()})
    shares = {i: 1 / mentions.where(f"ioc = '{i}'").count() for i in ids}
    edges = [(r.ioc, r.context_id, shares[r.ioc]) for r in mentions.collect()]
    total = 2 * sum(w for *_, w in edges)

    def quality(group):
        side = {}
        for context in {c for _, c, _ in edges}:
            pull = {}
            for i, c, w in edges:
                if c == context:
                    pull[group[i]] = pull.get(group[i], 0) + w
            side[context] = min(pull, key=lambda g: (-round(pull[g], 9), g))
        volume = {}
        for i, c, w in edges:
            volume[group[i]] = volume.get(group[i], 0) + w
            volume[side[c]] = volume.get(side[c], 0) + w
        return sum(2 * w for i, c, w in edges if group[i] == side[c]) / total - sum(v * v for v in volume.values()) / total**2

    found = stars.membership(mentions)
    mine = {r.id: r.community for r in found.collect()}
    assert stars.star_modularity(mentions, found) == pytest.approx(quality(mine))
    best = max(quality(dict(zip(ids, marks))) for marks in itertools.product("abc", repeat=len(ids)))
    assert quality(mine) == pytest.approx(best)


def test_edges_of_the_table(spark):
    rows = [(None, "x"), ("a", None), ("a", "x"), ("a", "x"), ("b", "x"), ("x", "y")]  # "x" names an indicator and a context
    got = {r.id: r.community for r in stars.membership(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"a": "a", "b": "a", "x": "x"}
    assert stars.membership(spark.createDataFrame([], SCHEMA)).collect() == []
