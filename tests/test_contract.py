import random

import pytest

from poremetry.operators.contract import smallest_reachable
from poremetry.workspace import _paths, scoped_tables


def brute(links):
    nodes = {x for link in links for x in link}
    root = {x: x for x in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


@pytest.mark.parametrize("kind", ["path", "star", "random"])
def test_smallest_reachable(spark, kind):
    rng = random.Random(3)
    links = {
        "path": [(i, i + 1) for i in range(100)],
        "star": [(500, i) for i in range(60)] + [(7, 900)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
    }[kind]
    with scoped_tables(spark):
        before = len(_paths(spark))
        table = spark.createDataFrame([(1, a, b) for a, b in links], "g int, a bigint, b bigint")
        found = {r.node: r.root for r in smallest_reachable(table, ("g",)).collect()}
        rounds = (len(_paths(spark)) - before) / 3
    assert found == {k: v for k, v in brute([x for x in links if x[0] != x[1]]).items()}
    assert rounds <= (18 if kind == "path" else 12)


def test_no_links(spark):
    assert smallest_reachable(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_tables_go_with_their_scope(spark, tmp_path):
    import glob

    from poremetry.workspace import materialize, workspace_dir

    with scoped_tables(spark):
        assert materialize(spark.range(5)).count() == 5
        kept = len(glob.glob(f"{workspace_dir(spark)}/poremetry/*"))
    assert len(glob.glob(f"{workspace_dir(spark)}/poremetry/*")) == kept - 1
