import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import community, iterative
from tidemill.plans import registry
from tidemill.plans.catalog import Written


def graph(spark, pairs):
    return iterative.both_ways(spark.createDataFrame([(str(a), str(b), float(w)) for a, b, w in pairs], "a string, b string, w double"), "a", "b", "w")


def clique(names):
    return [(a, b, 1) for a in names for b in names if a < b]


def blocks(seed, groups=4, size=8, inside=0.7, across=0.08):
    r = random.Random(seed)
    names = [f"g{g}n{i}" for g in range(groups) for i in range(size)]
    return [(a, b, r.randint(1, 3)) for a in names for b in names if a < b and r.random() < (inside if a[:2] == b[:2] else across)]


def labels(df):
    return {r.node: r.community_id for r in df.collect()}


def quality(pairs, of):
    """Modularity by the definition, over all pairs of nodes."""
    w = {}
    for a, b, x in pairs:
        w[str(a), str(b)] = w[str(b), str(a)] = float(x)
    k = {}
    for (a, _), x in w.items():
        k[a] = k.get(a, 0) + x
    m = sum(k.values())
    return sum(w.get((a, b), 0) - k[a] * k[b] / m for a in k for b in k if of[a] == of[b]) / m


@pytest.mark.parametrize("pairs", [clique("abcdefghijklmnop"), [("hub", f"n{i}", 1) for i in range(30)], [(f"l{i}", f"r{j}", 1) for i in range(5) for j in range(6)], blocks(1)], ids=["clique", "star", "bipartite", "blocks"])
def test_neighbours_have_different_colours(spark, pairs):
    got = {r.node: r.colour for r in community.colours(graph(spark, pairs)).collect()}
    assert set(got) == {str(x) for a, b, _ in pairs for x in (a, b)}
    assert all(got[str(a)] != got[str(b)] for a, b, _ in pairs)
    assert len(set(got.values())) <= 1 + max(sum(x in (a, b) for a, b, _ in pairs) for x in got)


def brute_propagation(pairs, colour, rounds=8):
    near = {}
    for a, b, w in pairs:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    of = {n: n for n in near}
    for _ in range(rounds):
        before = dict(of)
        for n in sorted(near, key=lambda n: colour[n]):
            votes = {}
            for m, w in near[n]:
                votes[of[m]] = votes.get(of[m], 0) + w
            of[n] = min(votes, key=lambda x: (-votes[x], x))
        if of == before:
            break
    return of


@pytest.mark.parametrize("pairs", [blocks(2, size=5), [(f"l{i}", f"r{j}", 1) for i in range(4) for j in range(5)], [(f"p{i:02}", f"p{i + 1:02}", 1) for i in range(12)]], ids=["blocks", "bipartite", "path"])
def test_label_propagation_node_by_node(spark, pairs):
    """As if each node moved alone, in the order of colours; partitioning doesn't matter, bipartite graphs settle."""
    e = graph(spark, pairs)
    colour = {r.node: r.colour for r in community.colours(e).collect()}
    got = labels(community.label_propagation(e))
    assert got == brute_propagation(pairs, colour)
    assert got == labels(community.label_propagation(e.repartition(3, "dst")))
    if pairs[0][1].startswith("r"):
        assert len(set(got.values())) == 1


def test_louvain_on_cliques(spark):
    """Two cliques with one link, and a ring of six cliques of five."""
    two = clique("abcde") + clique("vwxyz") + [("e", "v", 1)]
    got = labels(community.louvain(graph(spark, two)))
    assert got == {x: "a" for x in "abcde"} | {x: "v" for x in "vwxyz"}
    ring = [x for i in range(6) for x in clique([f"c{i}n{j}" for j in range(5)])] + [(f"c{i}n0", f"c{(i + 1) % 6}n1", 1) for i in range(6)]
    got = labels(community.louvain(graph(spark, ring)))
    assert got == {f"c{i}n{j}": f"c{i}n0" for i in range(6) for j in range(5)}


@pytest.mark.parametrize("seed", range(2))
def test_louvain_is_at_least_as_modular_as_propagation(spark, seed):
    pairs = blocks(seed, across=0.15)
    e = graph(spark, pairs)
    mine, other = labels(community.louvain(e)), labels(community.label_propagation(e))
    assert quality(pairs, mine) >= quality(pairs, other) - 1e-9
    assert quality(pairs, mine) >= quality(pairs, {n: n[:2] for n in mine}) - 1e-9
    assert mine == labels(community.louvain(e.repartition(3, "dst")))


def test_graphs_without_edges(spark):
    e = graph(spark, [("a", "b", 1)]).limit(0)
    assert not labels(community.louvain(e)) and not labels(community.label_propagation(e)) and community.colours(e).isEmpty()
    loops = spark.createDataFrame([("a", "a", 1.0)], "src string, dst string, w double")
    assert not labels(community.louvain(loops))


def test_weeks_keep_all_their_repositories(spark, tmp_path):
    """Of a week's repositories all but the 120 with the most actors were left out. Here 65 pairs share two actors each."""
    rows = [(f"u{i}{x}", f"r{i}{y}") for i in range(65) for x in "ab" for y in "pq"] + [("u0a", "alone")]
    events = spark.createDataFrame(rows, "actor_login string, repo_name string").selectExpr("*", "DATE '2024-01-30' AS metric_date")
    events.write.parquet(f"{tmp_path}/ev_net")
    got = registry.queries()["g11_repo_community_weekly"](spark, Written({"ev_net": f"{tmp_path}/ev_net"})).collect()
    assert {(r.week_idx, r.repo_name) for r in got} == {(3, f"r{i}{y}") for i in range(65) for y in "pq"} and len(got) == 130
    assert len({r.community_id for r in got}) == 65 and all(r.community_size == 2 and r.community_id[:-1] == r.repo_name[:-1] for r in got)
