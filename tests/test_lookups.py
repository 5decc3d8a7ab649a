"""Graph lookups, chunk text, routing, evaluation and throttling on small inputs."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cataloom.functions import text as T
from cataloom.operators import chunks as C
from cataloom.operators import evaluation as E
from cataloom.operators import graph as G
from cataloom.operators import routing as D
from cataloom.operators import vectors as V
from cataloom.streaming import throttle

EDGE = "edge_id string, from_id string, from_name string, attribute string, fk_name string, targets array<struct<entity_id:string,name:string>>, is_audit boolean, is_polymorphic boolean"


@pytest.fixture(scope="module")
def graph(spark):
    names = "A B C D Loop Lone".split()
    nodes = spark.createDataFrame(
        [(n.lower(), n, "x", f"{n} (x)", None) for n in names] + [("a2", "A", "y", "A (y)", None)],
        "entity_id string, name string, layer string, display_name string, parent_id string"
    )

    def edge(f, attribute, *to, audit=False):
        return (
            f"{f.lower()}::{attribute}Id", f.lower(), f, attribute, f"{attribute}Id", [(t.lower(), t) for t in to], audit,
            len(set(to)) > 1
        )

    edges = spark.createDataFrame(
        [
            edge("A", "toB", "B"), edge("B", "any", "C", "D"), edge("C", "d", "D"), edge("Loop", "parentLoop", "Loop"),
            edge("Lone", "owner", "A", audit=True)
        ],
        EDGE
    )
    return nodes, edges, G.edge_targets(edges)


def pairs(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pair_id int, name_a string, name_b string")


def test_paths(spark, graph):
    nodes, _, targets = graph
    p = pairs(spark, ("A", "D"), ("D", "A"), ("A", "A"), ("A", "Nope"), ("Lone", "A"), ("Loop", "A"))
    found = {r.pair_id: r.hops for r in G.shortest_paths(p, nodes, targets).collect()}
    assert found == {0: 2, 1: 2, 2: 0, 3: None, 4: None, 5: None}
    assert G.shortest_paths(p, nodes, targets, max_hops=1).where("hops is not null").count() == 1
    assert G.path_labels(
        G.shortest_paths(p.where("pair_id = 0"), nodes, targets), nodes
    ).first().label == "A (x) -> B (x) (via toB) -> D (x) (via any)"


@pytest.fixture
def hub(spark):
    """A hub of 300 spokes, each with a leaf of its own; every tenth spoke also leads on to the next one."""
    nodes = ["hub"] + [f"{kind}{i}" for kind in "sl" for i in range(300)]
    ways = [(f"s{i}", "hub") for i in range(300)] + [(f"l{i}", f"s{i}") for i in range(300)] + [(f"s{i}", f"s{i + 1}") for i in range(0, 300, 10)]
    named = spark.createDataFrame([(n, n, "x", n, None) for n in nodes], "entity_id string, name string, layer string, display_name string, parent_id string")
    edges = [(f"{a}::{b}", a, a, "way", "wayId", [(b, b)], False, False) for a, b in ways]
    return named, G.edge_targets(spark.createDataFrame(edges, EDGE)), ways


def hops_of(ways, start):
    """Distances from a node by breadth-first search."""
    near = {}
    for a, b in ways:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    far, queue = {start: 0}, [start]
    for at in queue:
        for n in near[at]:
            if n not in far:
                far[n] = far[at] + 1
                queue.append(n)
    return far


def test_hubs_are_split_and_give_the_same_paths(spark, hub, monkeypatch):
    nodes, targets, ways = hub
    asked = [(f"l{i}", f"l{(7 * i + 3) % 300}") for i in range(60)] + [("l0", "l1"), ("s0", "s1"), ("hub", "l5")]
    p = pairs(spark, *asked)
    sources = spark.createDataFrame([(f"s{i}",) for i in range(40)], "source string")
    found = []
    for cell in (10**6, 12):
        monkeypatch.setattr(G, "CELL", cell)
        paths = {r.pair_id: (r.hops, r.path) for r in G.shortest_paths(p, nodes, targets).collect()}
        within = {(r.source, r.entity_id): r.hops for r in G.within_hops(sources, targets, 2).collect()}
        found.append((paths, within))
    assert found[0] == found[1]
    paths, within = found[1]
    assert {k: x[0] for k, x in paths.items()} == {i: hops_of(ways, a).get(b) for i, (a, b) in enumerate(asked)}
    assert within == {(f"s{i}", n): far for i in range(40) for n, far in hops_of(ways, f"s{i}").items() if far <= 2}


def test_no_cell_of_a_hub_holds_much_more_than_its_share(spark, hub, monkeypatch):
    monkeypatch.setattr(G, "CELL", 20)
    adjacency = G.Adjacency.of(G.neighbours(hub[1]))
    frontier = spark.range(500).select(F.col("id").alias("pair_id"), F.when(F.col("id") < 400, "hub").otherwise("s1").alias("at"))
    rows, edges = G.split(frontier, 500, "pair_id", adjacency)
    on = ["at", "row_cell", "edge_cell"]
    sizes = rows.groupBy(on).count().toPandas(), edges.withColumnRenamed("src", "at").groupBy(on).count().toPandas()
    for side, n_cells in zip(sizes, (20 * 15, 20 * 15)):
        side = side[side["at"] == "hub"]
        assert len(side) == n_cells and side["count"].max() <= 3 * 20
    assert len(sizes[0][sizes[0]["at"] == "s1"]) == 1  # 100 rows of 3 edges make 300, less than 20**2
    joined = G.expanded(frontier, 500, "pair_id", adjacency).select("pair_id", "dst", "edge_id")
    plain = frontier.join(adjacency.edges, F.col("at") == F.col("src")).select("pair_id", "dst", "edge_id")
    assert joined.columns == ["pair_id", "dst", "edge_id"]
    assert joined.exceptAll(plain).isEmpty() and plain.exceptAll(joined).isEmpty()


def test_relations_notes_and_misses(spark, graph):
    nodes, edges, targets = graph
    assert [r.edge_id for r in G.relations(pairs(spark, ("B", "A"), ("A", "D")), targets).collect()] == ["a::toBId"]
    near = {(r.side, r.edge_id): (r.lexical, r.structural) for r in G.near_misses(pairs(spark, ("A", "D")), targets).collect()}
    assert near == {("b", "b::anyId"): (True, True), ("b", "c::dId"): (False, True)}
    notes = {
        r.name: r.note for r in G.infrastructure_notes(
            spark.createDataFrame([("Lone",), ("A",), ("Nope",)], "name string"), nodes, targets
        ).collect()
    }
    assert notes == {"Lone": "Lone has no business relationships, only 1 audit links."}
    assert {r.entity_id: (r.n_out, r.n_in) for r in G.degrees(edges).collect()}["loop"] == (1, 1)


def test_find_prefers_exact_names_and_specific_layers(spark, graph):
    asked = spark.createDataFrame([(1, "A"), (2, "loop"), (3, "zz")], "request_id int, wanted string")
    assert {r.request_id: r.entity_id for r in G.find(asked, graph[0], ["y", "x"]).collect()} == {1: "a2", 2: "loop"}


def test_relationship_text(spark, graph):
    nodes, edges, _ = graph
    told = {
        r.chunk_id: r.text for r in C.relationship_chunks(
            edges, nodes,
            spark.createDataFrame([("a", "toB", "Points on. More.")], "entity_id string, name string, description string")
        ).collect()
    }
    assert told["rel:a::toBId"] == "A (x) has a many-to-one relationship to B: each A (x) refers to one B, via attribute toB (foreign key toBId). Reverse: a B can have many A (x) records. Attribute description: Points on."
    assert told["rel:loop::parentLoopId"] == "A Loop can have a parent Loop, via attribute parentLoop (foreign key parentLoopId). Reverse: A Loop can be the parent of many Loop records."
    assert "any can refer to C or D. Each B record" in told["rel:b::anyId"] and len(told) == 4


def told_tokens(text):
    return len(re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+|[^\w\s]", text))


def test_entity_text_fits_its_budget(spark):
    def parts(n, description, groups):
        plain = [f"attribute{i}Name (string)" for i in range(n)]
        return (
            "e%d" % n,
            [
                "Big (x) is an entity in the x layer of the catalog.", "It has no parent entity.",
                "Standard audit fields: 1 common system fields such as createdById.", None
            ],
            plain, [f"{p}: {description}" for p in plain], n, groups
        )

    named = [f"inheritedName{i}" for i in range(30)]
    rows = [
        parts(60, "Some long description of this.", [("P (x)", named, named)]), parts(2, "Some long description of this.", []),
        parts(0, "", []), parts(9, "word " * 9, [("P (x)", named, named), ("Q (x)", named[:4], named[:4])])
    ]
    frame = spark.createDataFrame(
        rows,
        "entity_id string, fixed array<string>, plain array<string>, told array<string>, n_own int, groups array<struct<base:string,names:array<string>,useful:array<string>>>"
    )
    found = {r.entity_id: r.text for r in C.fitted(frame).collect()}

    def shown(row, described, inherited, own):
        _, fixed, plain, told, n, groups = row
        items = [*told[: min(described, own)], *plain[min(described, own) : own]]
        rest = f"; and {n - own} more" if n > own else ""
        lines = [*fixed[:2], f"Own attributes ({n}): {'; '.join(items)}{rest}." if n else "Own attributes: none."]
        if groups:
            lines.append(
                f"Inherited attributes ({sum(len(g[1]) for g in groups)}): " + "; ".join(
                    f"{len(g[1])} from {g[0]} ({', '.join(g[2][:inherited])}{f', +{len(g[1]) - inherited} more' if len(g[1]) > inherited else ''})" for g in groups
                ) + "."
            )
        return "\n".join([*lines, fixed[2]])

    for row in rows:
        n = row[4]
        caps = [c for c in dict.fromkeys((n, 12, 8)) if c <= n]
        wishes = [(d, i, c) for d in (4, 2, 0) for i in (8, 5, 3) for c in caps] + [(0, 3, min(5, n)), (0, 3, min(3, n))]
        assert found[row[0]] == next(t for w in wishes if told_tokens(t := shown(row, *w)) <= C.BUDGET)
    assert "attribute0Name (string): Some" in found["e2"] and "and 4 more" not in found["e2"]


def test_text_functions(spark):
    rows = spark.createDataFrame([("",), ("One two. Three",), ("word " * 20,), ("x" * 60,), (None,)], "t string")
    assert [r[0] for r in rows.select(T.short(F.col("t"), 48)).collect()] == [
        "", "One two.", ("word " * 9).strip() + "…", "x" * 48 + "…", None
    ]
    tokens = spark.createDataFrame([("parentAccount FKName12 – ä!",)], "t string").select(T.estimated_tokens(F.col("t"))).first()[0]
    assert tokens == 2 + 3 + 1 + 1


def test_mentions_and_routes(spark):
    q = spark.createDataFrame(
        [
            (1, "How does product relate to Lead and Bank?"), (2, "FinancialProduct?"), (3, "what of Sales Order, product"),
            (4, "ownerId?"), (5, None)
        ],
        "question_id int, question string"
    )
    names = spark.createDataFrame([("Product",), ("Bank",), ("Lead",), ("Sales Order",)], "name string")
    m = D.mentions(q, names)
    assert {(r.question_id, r["rank"]): r.name for r in m.collect()} == {
        (1, 1): "Product", (1, 2): "Lead", (1, 3): "Bank", (3, 1): "Sales Order", (3, 2): "Product"
    }
    r = {
        x.question_id: (x.route, x.first, x.second) for x in D.routes(
            q, m, D.mentions(q, spark.createDataFrame([("ownerId",)], "name string"))
        ).collect()
    }
    assert r == {
        1: ("pair", "Product", "Lead"), 2: ("vector", None, None), 3: ("pair", "Sales Order", "Product"),
        4: ("attribute", "ownerId", None), 5: ("vector", None, None)
    }


ITEM = "question_id int, section long, ord string, text string, chunk_type string, source string, entity string, attribute string, is_audit boolean"


def test_context_order_and_prompt(spark):
    items = spark.createDataFrame(
        [(1, 3, "0", "note", "note", "note", "A", None, None), (1, 0, "e1", "edge", "relationship", "direct_edge", "A", "x", False)],
        ITEM
    )
    found = spark.createDataFrame(
        [
            (1, 0, "000001", "hit", "passage", "vector_search", None, None, None),
            (2, 0, "000001", "other", "passage", "vector_search", None, None, None)
        ],
        ITEM
    )
    routed = spark.createDataFrame(
        [(1, "pair", "A", "B"), (2, "vector", None, None)], "question_id int, route string, first string, second string"
    )
    ctx = D.assembled(items, found, routed)
    assert [r.text for r in ctx.where("question_id = 1").orderBy("pos").collect()] == [
        "Facts about A and B from the graph:", "edge", "note", D.SECOND_HEADER, "hit"
    ]
    told = spark.createDataFrame([(3, "Beware.")], "question_id int, instruction string")
    prompts = {
        r.question_id: (r.system, r.prompt) for r in D.prompts(
            spark.createDataFrame([(2, "Q?"), (3, "R?")], "question_id int, question string"), ctx, told
        ).collect()
    }
    assert prompts == {2: (D.SYSTEM, "[1] (passage) other\n\nQuestion: Q?"), 3: (D.SYSTEM + "\n\nBeware.", D.EMPTY + "\n\nQuestion: R?")}


def test_pair_items_take_a_path_only_as_a_last_resort(spark):
    routed = spark.createDataFrame(
        [(1, "pair", "A", "B"), (2, "pair", "A", "C"), (3, "pair", "Lone", "B"), (4, "single", "A", None)],
        "question_id int, route string, first string, second string"
    )
    relations = spark.createDataFrame([(1, "e1")], "pair_id int, edge_id string")
    near = spark.createDataFrame([(3, "b", "e2", 1), (4, "a", "e2", 1)], "pair_id int, side string, edge_id string, rank long")
    notes = spark.createDataFrame([("Lone", "Lone has none.")], "name string, note string")
    told = spark.createDataFrame(
        [("e1", "A to B", "A", "x", False), ("e2", "C to B", "C", "y", True)],
        "edge_id string, text string, entity string, attribute string, is_audit boolean"
    )
    paths = spark.createDataFrame([(k, 2, "A -> C") for k in (1, 2, 3)], "pair_id int, hops long, label string")
    found = sorted(
        (r.question_id, r.section, r.source, r.text) for r in D.pair_items(routed, relations, near, notes, told, paths).collect()
    )
    assert found == [
        (1, 0, "direct_edge", "A to B"),
        (2, 4, "multi_hop_path", "There is no direct relationship, but a path of 2 hops: A -> C."), (3, 2, "near_miss", "C to B"),
        (3, 3, "note", "Lone has none.")
    ]


def test_search_ties_filters_and_repeats(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "chunk_id long, vector array<float>")
    q = spark.createDataFrame([(9, [2.0, 0.0]), (8, [0.0, 1.0])], "query_id long, vector array<float>")
    hits = V.top_k(q, c, 3, dimensions=2, at_once=1)
    assert [(r.chunk_id, r["rank"]) for r in hits.where("query_id = 9").orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3)]
    texts = hits.where("query_id = 9").join(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "chunk_id long, text string"), "chunk_id")
    assert [r.chunk_id for r in V.selected(texts, 2).orderBy("rank").collect()] == [1, 3]


def test_truncation(spark):
    texts = ["ends in the", "fine.**", "", "no mark", None, "**"]
    assert [
        r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(E.truncation(F.col("t"))).collect()
    ] == ["dangling", None, "empty", "open", "empty", "open"]


def test_throttle(spark):
    at = pd.to_datetime(
        ["2024-01-01 00:00", "2024-01-01 00:10", "2024-01-01 00:20", "2024-01-01 01:00", "2024-01-01 01:00:01"], format="mixed"
    )
    log = spark.createDataFrame(pd.DataFrame({"event_id": range(5), "key": "k", "ts": at}))
    assert [r.admitted for r in throttle.admitted(log, 2).orderBy("event_id").collect()] == [True, True, False, False, True]


def test_a_stream_admits_what_the_batch_admits(spark):
    from cataloom.jobs import registry

    stream, batch = (
        registry.QUERIES[q](spark, "/root/testdata/sf0.001").select("event_id", "admitted").collect() for q in ("t1_admission_stream", "t1_admission")
    )
    assert sorted(map(tuple, stream)) == sorted(map(tuple, batch)) and len(stream) > 100
