"""Strongly connected components, and the greedy choice within them, against brute force."""

import random

from storyloom.operators import graphs


def brute(links):
    after = {}
    for s, t in links:
        after.setdefault(s, set()).add(t)

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for t in after.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    far = {n: reach(n) for n in {n for e in links for n in e}}
    groups = {n: {m for m in far[n] if n in far[m]} | {n} for n in far}
    return {n: min(g) for n, g in groups.items() if len(g) > 1}


def test_components_of_random_graphs(spark):
    r = random.Random(4)
    for nodes, edges in ((30, 25), (40, 60), (12, 60)):
        links = [(f"n{r.randrange(nodes):02d}", f"n{r.randrange(nodes):02d}") for _ in range(edges)]
        df = spark.createDataFrame([*links, *links[:5], ("n00", None), (None, None)], "source string, target string")
        assert {x.node: x.component for x in graphs.strong_components(df).collect()} == brute([e for e in links if e[0] != e[1]])


def test_chains_rings_and_no_edges(spark):
    chain = [(i, i + 1) for i in range(60)]
    ring = [(1000 + i, 1000 + (i + 1) % 40) for i in range(40)]
    df = spark.createDataFrame([*chain, *ring, (60, 1000), (1039, 2000), (5, 5)], "source long, target long")
    assert {x.node: x.component for x in graphs.strong_components(df).collect()} == {1000 + i: 1000 for i in range(40)}
    assert graphs.strong_components(df.limit(0)).collect() == []


def test_projects_that_share_ids_choose_apart(spark):
    schema = "relation_id string, source_event_id string, target_event_id string, relation_type string, confidence double, source string, is_inferred boolean, project string, usable_for_ordering boolean"
    row = lambda i, s, t, p, c: (i, s, t, "before", c, "llm", False, p, True)
    edges = spark.createDataFrame([row("a", "x", "y", "p", 0.9), row("b", "y", "x", "q", 0.8), row("c", "y", "z", "p", 0.7), row("d", "z", "x", "p", 0.6), row("e", "x", "x", "q", 0.5), row("f", "q", "r", "q", 0.5)], schema)
    blocked = edges.where("relation_id = 'f'").select("relation_id")
    for most in (1_000_000, 3, 1):
        got = {(x.component, x.relation_id): (x.selected, x.skip_reason) for x in graphs.select_acyclic(edges, blocked, by="project", one_task=most).collect()}
        assert got == WANT


WANT = {("p", "a"): (True, None), ("p", "c"): (True, None), ("p", "d"): (False, "would_create_cycle"), ("q", "b"): (True, None), ("q", "e"): (False, "self_edge"), ("q", "f"): (False, "hard_conflict")}


def test_components_of_groups_take_one_table_unless_a_group_is_large(spark, monkeypatch):
    r = random.Random(6)
    links = [(f"{g}-{r.randrange(9)}", f"{g}-{r.randrange(9)}", g) for g in ["a", "b", "c", None] for _ in range(14)] + [(f"d-{i}", f"d-{(i + 1) % 40}", "d") for i in range(40)]
    df = spark.createDataFrame([*links, *links[:5], ("a-0", None, "a")], "source string, target string, project string")
    tables, write = [], graphs.written
    monkeypatch.setattr(graphs, "written", lambda rows: tables.append(1) or write(rows))
    for most, packed in ((1_000_000, 20_000), (1_000_000, 1), (30, 20_000)):
        tables.clear()
        monkeypatch.setattr(graphs, "TOGETHER", packed)
        got = graphs.strong_components(df, by="project", one_task=most).collect()
        assert {x.node: x.component for x in got} == brute([e[:2] for e in links if e[0] != e[1]])
        assert len(tables) == 1 or most == 30
    assert graphs.strong_components(df.limit(0), by="project").collect() == []
