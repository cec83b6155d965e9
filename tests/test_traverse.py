import random

import pytest

from graphloom.operators import traverse as T

EDGE = "graph_id string, src_id string, relation string, dst_id string, source string, edge_id string"
#: A ferry town: two quays lead to a mill over a bridge with three names, and the mill's lane leads back.
TOWN = [("g", "quay", "road", "bridge", "old"), ("g", "quay", "road", "bridge", "new"), ("g", "quay", "road", "bridge", "map"), ("g", "quay", "road", "ferry", "map"), ("g", "ferry", "lane", "mill", ""), ("g", "bridge", "lane", "mill", ""), ("g", "bridge", "lane", "quay", ""), ("g", "mill", "road", "quay", ""), ("g", "mill", "road", "inn", "")]


def graph(spark, edges):
    return spark.createDataFrame([(*e, "-".join(e[1:])) for e in edges], EDGE)


def seeds(spark, *ids):
    return spark.createDataFrame([(i, "g", i) for i in ids], "query_id string, graph_id string, seed_id string")


def paths(spark, edges, relations, fanout, *ids, **kw):
    return sorted((r.query_id, *r.edge_path) for r in T.traverse(seeds(spark, *ids), graph(spark, edges), relations, fanout, **kw).collect())


def brute(edges, relations, fanout, ids, cycle_first=True, cycles="path"):
    out = set()
    for seed in ids:
        states = [((seed,), ())]
        for relation in relations:
            nxt = []
            for nodes, path in states:
                mine = sorted((e for e in edges if e[1] == nodes[-1] and relation in ("*", e[2])), key=lambda e: (e[2], e[3], e[4]))
                keep = (lambda e: e[3] not in nodes) if cycles == "path" else (lambda e: True)
                mine = [e for e in mine if keep(e)][:fanout] if cycle_first else [e for e in mine[:fanout] if keep(e)]
                nxt += [((*nodes, e[3]), (*path, "-".join(e[1:]))) for e in mine]
            states = nxt
        out |= {(seed, *path) for _, path in states}
    return sorted(out)


def test_town(spark):
    assert paths(spark, TOWN, ["road"], 2, "quay") == [("quay", "quay-road-bridge-map"), ("quay", "quay-road-bridge-new")]
    # the lane back to the quay is a cycle; it takes a place only where cycles are dropped last
    assert paths(spark, TOWN, ["road", "lane"], 9, "quay") == brute(TOWN, ["road", "lane"], 9, ["quay"])
    assert len(paths(spark, TOWN, ["road", "lane", "road"], 9, "quay")) == 4
    assert len(paths(spark, TOWN, ["road", "lane", "road"], 9, "quay", cycles="none")) == 20
    assert paths(spark, TOWN, ["road"], 5, "nobody") == []
    for fanout, kw in ((0, {}), (1, {"cycles": "odd"})):
        with pytest.raises(ValueError):
            paths(spark, TOWN, ["road"], fanout, "quay", **kw)


def test_the_orders_differ_where_a_cycle_is_among_the_first(spark):
    edges = [("g", "a", "r", "b", ""), ("g", "b", "r", "a", ""), ("g", "b", "r", "c", "")]
    assert paths(spark, edges, ["r", "r"], 1, "a") == [("a", "a-r-b-", "b-r-c-")]
    assert paths(spark, edges, ["r", "r"], 1, "a", cycle_first=False) == []


@pytest.mark.parametrize("cycle_first", [True, False])
def test_random_graphs(spark, cycle_first):
    random.seed(11)
    for relations in (["r", "q"], ["*", "r", "*"]):
        # few nodes and many parallel edges: cycles and ties abound
        edges = sorted({("g", random.choice("abcd"), random.choice("rq"), random.choice("abcdef"), random.choice("xyz")) for _ in range(60)})
        for fanout in (1, 2, 4):
            assert paths(spark, edges, relations, fanout, "a", "b", cycle_first=cycle_first) == brute(edges, relations, fanout, ["a", "b"], cycle_first)


def test_a_hub_joins_with_few_edges(spark):
    edges = [("g", "hub", "r", f"d{i:05d}", s) for i in range(2000) for s in "xyz"] + [("g", "a", "r", "hub", "")]
    assert T.bounded_adjacency(graph(spark, edges), 3, 2).where("src_id = 'hub'").count() == 6 * 3
    assert paths(spark, edges, ["r", "r"], 3, "a") == brute(edges, ["r", "r"], 3, ["a"])


def test_sets_profile_closure_and_hash(spark):
    s, g = seeds(spark, "quay"), graph(spark, TOWN)
    sets = {(r.hop, r.node) for r in T.frontier_sets(s, g, ["road", "lane"], 5, 1).collect()}
    assert sets == {(0, "quay"), (1, "bridge"), (2, "mill")}
    levels = T.traverse_levels(s, g, ["road", "lane"], 5)
    assert [(r.hop, r.n_states, r.n_nodes) for r in T.depth_profile(levels).orderBy("hop").collect()] == [(1, 4, 2), (2, 4, 1)]
    assert T.closure(s, levels, g).count() == 7
    found = T.traverse(s, g, ["road", "lane"], 5)
    assert T.path_hashes(found).collect() == T.path_hashes(found.repartition(7)).collect()
