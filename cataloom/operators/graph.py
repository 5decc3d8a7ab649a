"""Lookups in an entity graph, batched over tables of pairs or names.

``nodes``: entity_id, name, layer, parent_id, ...; ``edges``: edge_id, from_id, from_name, attribute, fk_name,
targets array<struct<entity_id, name>>, is_audit, is_polymorphic.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cataloom.sources.shared import materialize


def edge_targets(edges: DataFrame) -> DataFrame:
    """One row per edge and target: the form that joins use."""
    return edges.select(
        "edge_id", "from_id", "from_name", "attribute", "fk_name", "is_audit", "is_polymorphic", F.explode("targets").alias("t")
    ).select(
        "edge_id", "from_id", "from_name", "attribute", "fk_name", "is_audit", "is_polymorphic", F.col("t.entity_id").alias("to_id"), F.col("t.name").alias("to_name")
    )


def layer_of(document: Column, prefixes: Sequence[tuple[str, str]]) -> Column:
    """Label of the first prefix that a document's path starts with, else its folder, else ``root``."""
    out = F.when(F.contains(document, F.lit("/")), F.element_at(F.split(document, "/"), -2)).otherwise(F.lit("root"))
    for prefix, label in reversed(prefixes):
        out = F.when(F.startswith(document, F.lit(prefix)), F.lit(label)).otherwise(out)
    return out


def display_names(nodes: DataFrame, folder: Column) -> DataFrame:
    """display_name: ``Name (layer)``, with ``: folder`` where two nodes would share it."""
    base = F.concat("name", F.lit(" ("), "layer", F.lit(")"))
    many = F.count("*").over(Window.partitionBy("name", "layer")) > 1
    return nodes.withColumn(
        "display_name", F.when(many, F.concat("name", F.lit(" ("), "layer", F.lit(": "), folder, F.lit(")"))).otherwise(base)
    )


def degrees(edges: DataFrame) -> DataFrame:
    """entity_id, n_out, n_in of business edges; an edge counts once per distinct target node."""
    business = edges.where(~F.col("is_audit"))
    out = business.select(F.col("from_id").alias("entity_id"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    into = business.select(
        F.explode(F.array_distinct(F.transform("targets", lambda t: t["entity_id"]))).alias("entity_id"), F.lit(0).alias("o"),
        F.lit(1).alias("i")
    )
    return out.unionByName(into).groupBy("entity_id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of nodes per layer with a total, and of edges by kind: (metric, value)."""
    layers = nodes.groupBy("layer").count().select(F.concat(F.lit("nodes:"), "layer").alias("metric"), F.col("count").alias("value"))
    total = nodes.agg(F.count("*").alias("value")).select(F.lit("nodes").alias("metric"), "value")
    known = nodes.select(F.col("entity_id").alias("to_id"))
    kinds = edges.agg(
        F.count("*").alias("edges"), F.count_if("is_audit").alias("audit_edges"),
        F.count_if("is_polymorphic").alias("polymorphic_edges")
    )
    kinds = kinds.select(
        F.explode(
            F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in ("edges", "audit_edges", "polymorphic_edges")))
        ).alias("x")
    ).select("x.*")
    lost = edge_targets(edges).join(known, "to_id", "left_anti").agg(F.count("*").alias("value")).select(
        F.lit("unresolved_targets").alias("metric"), "value"
    )
    return layers.unionByName(total).unionByName(kinds).unionByName(lost)


def find(requests: DataFrame, nodes: DataFrame, priority: Sequence[str]) -> DataFrame:
    """Best node per (request_id, wanted): exact name before any case, then the most specific layer, then the id."""
    rank = F.lit(len(priority))
    for k, layer in reversed(list(enumerate(priority))):
        rank = F.when(F.col("layer") == layer, k).otherwise(rank)
    hits = requests.join(nodes.select("entity_id", "name", "layer"), F.lower("wanted") == F.lower("name"))
    order = Window.partitionBy("request_id").orderBy(F.desc(F.col("wanted") == F.col("name")), rank, "entity_id")
    return hits.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("request_id", "wanted", "entity_id", "layer")


def relations(pairs: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges between any node named A and any node named B, both ways, audit edges too."""
    columns = ("pair_id", "edge_id", "from_id", "to_id", "attribute", "is_audit")
    ends = targets.select("edge_id", "from_id", "to_id", "attribute", "is_audit", "from_name", "to_name")
    there = pairs.join(
        ends, (F.col("name_a") == F.col("from_name")) & (F.col("name_b") == F.col("to_name"))
    ).select(*columns, F.lit("out").alias("direction"))
    back = pairs.join(
        ends, (F.col("name_b") == F.col("from_name")) & (F.col("name_a") == F.col("to_name"))
    ).select(*columns, F.lit("in").alias("direction"))
    first = F.struct("direction", "from_id", "to_id", "attribute", "is_audit")
    return there.unionByName(back).groupBy("pair_id", "edge_id").agg(F.max(first).alias("x")).select("pair_id", "edge_id", "x.*")


def party_names(targets: DataFrame) -> DataFrame:
    """All names that a polymorphic edge points to."""
    return targets.where("is_polymorphic").select(F.col("to_name").alias("name")).distinct()


def near_misses(pairs: DataFrame, targets: DataFrame, limit: int = 5) -> DataFrame:
    """For pairs without a direct edge: A's outgoing and B's incoming business edges that hint at the other side.

    lexical: the missing name is part of the attribute or of a target's name; structural: a target is a party type.
    The best ``limit`` of each side stay, ties by edge.
    """
    direct = relations(pairs, targets).select("pair_id").distinct()
    open_pairs = pairs.join(direct, "pair_id", "left_anti")
    party = party_names(targets).withColumn("_party", F.lit(True))
    business = targets.where(~F.col("is_audit")).join(party, F.col("to_name") == F.col("name"), "left").drop("name")
    holds = lambda text, name: F.contains(F.lower(text), F.lower(name))
    side_a = open_pairs.join(business, F.col("name_a") == F.col("from_name")).select(
        "pair_id", F.lit("a").alias("side"), "edge_id", "attribute", F.col("name_b").alias("missing"), "to_name", "_party"
    )
    into_b = open_pairs.join(
        business.select(F.col("to_name").alias("hit"), "edge_id").distinct(), F.col("name_b") == F.col("hit")
    ).select("pair_id", "name_a", "edge_id").distinct()
    side_b = into_b.join(business, "edge_id").select(
        "pair_id", F.lit("b").alias("side"), "edge_id", "attribute", F.col("name_a").alias("missing"), "to_name", "_party"
    )
    scored = side_a.unionByName(side_b).groupBy("pair_id", "side", "edge_id", "attribute").agg(
        F.bool_or(
            holds(F.col("attribute"), F.col("missing")) | holds(F.col("to_name"), F.col("missing"))
        ).alias("lexical"), F.bool_or(F.coalesce("_party", F.lit(False))).alias("structural")
    )
    order = Window.partitionBy("pair_id", "side").orderBy(F.desc("lexical"), F.desc("structural"), "edge_id")
    return scored.where("lexical or structural").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def infrastructure_notes(names: DataFrame, nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """name, note for known names without any business edge; a self-edge counts on both ends."""
    out = targets.select("edge_id", F.col("from_id").alias("entity_id"), "is_audit").distinct()
    ends = out.unionByName(targets.select("edge_id", F.col("to_id").alias("entity_id"), "is_audit").distinct())
    counts = ends.groupBy("entity_id").agg(F.count_if(~F.col("is_audit")).alias("business"), F.count_if("is_audit").alias("audit"))
    known = names.select("name").distinct().join(nodes.select("name", "entity_id"), "name").join(counts, "entity_id", "left")
    by_name = known.groupBy("name").agg(
        F.sum(F.coalesce("business", F.lit(0))).alias("business"), F.sum(F.coalesce("audit", F.lit(0))).alias("audit")
    )
    note = F.when(
        F.col("audit") > 0, F.format_string("%s has no business relationships, only %d audit links.", "name", "audit")
    ).otherwise(F.format_string("%s has no relationships at all.", "name"))
    return by_name.where("business = 0").select("name", note.alias("note"))


def neighbours(targets: DataFrame) -> DataFrame:
    """Undirected business adjacency: src, dst, edge_id, attribute."""
    business = targets.where(~F.col("is_audit"))
    there = business.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "edge_id", "attribute")
    return there.unionByName(business.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"), "edge_id", "attribute"))


#: Rows of either side that a cell of a split node takes. A node is split when its expansion makes more rows than the square of this.
CELL = 1000
#: Nodes that a hop splits at most, so that their list can be broadcast.
MOST_SPLIT = 100_000


class Adjacency(NamedTuple):
    """Written edges (src, dst, ...), how many each node has (src, degree), and how many any node has at most."""

    edges: DataFrame
    fan_out: DataFrame
    most: int

    @classmethod
    def of(cls, edges: DataFrame) -> Adjacency:
        edges = materialize(edges, "adjacency")
        fan_out = materialize(edges.groupBy("src").agg(F.count("*").alias("degree")), "fan-out")
        return cls(edges, fan_out, fan_out.agg(F.max("degree")).first()[0] or 0)


def split(frontier: DataFrame, n_rows: int, key: str, adjacency: Adjacency) -> tuple[DataFrame, DataFrame]:
    """Both sides of an expansion with the columns row_cell and edge_cell, on which (with at = src) they are to be joined.

    What each node's expansion will make is counted first. A node that makes more than CELL**2 rows, and more than its share of
    1/MOST_SPLIT of the hop (so that there are fewer than MOST_SPLIT such nodes), has its frontier rows dealt into row cells by
    ``key`` and its edges into edge cells; each row goes once to every cell of the other side. All other nodes are one cell.
    ``n_rows``: how many rows the frontier has at most; few rows and low degrees make no hub, and nothing is counted then.
    """
    one = F.lit(0).cast("long")
    whole = tuple(side.withColumn("row_cell", one).withColumn("edge_cell", one) for side in (frontier, adjacency.edges))
    if n_rows * adjacency.most <= CELL**2:
        return whole
    work = frontier.groupBy("at").agg(F.count("*").alias("n_rows")).join(adjacency.fan_out, F.col("at") == F.col("src")).select(
        "at", "n_rows", "degree", (F.col("n_rows").cast("double") * F.col("degree")).alias("made")
    )
    total = work.agg(F.sum("made").alias("all"), F.max("made").alias("most")).first()
    least = max(CELL**2, (total["all"] or 0) / MOST_SPLIT)
    if (total["most"] or 0) <= least:
        return whole
    cells = lambda c: F.ceil(F.col(c) / CELL).cast("long")
    heavy = F.broadcast(work.where(F.col("made") > least).select("at", cells("n_rows").alias("_rows"), cells("degree").alias("_edges")))
    one_of = lambda n, *c: F.coalesce(F.pmod(F.xxhash64(*c), n), F.lit(0).cast("long"))
    each_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1).cast("long")) - 1))
    rows = frontier.join(heavy, "at", "left").withColumn("row_cell", one_of("_rows", key)).withColumn("edge_cell", each_of(F.col("_edges")))
    edges = adjacency.edges.join(heavy.withColumnRenamed("at", "src"), "src", "left").withColumn(
        "edge_cell", one_of("_edges", *(c for c in adjacency.edges.columns if c != "src"))
    ).withColumn("row_cell", each_of(F.col("_rows")))
    return rows.drop("_rows", "_edges"), edges.drop("_rows", "_edges")


def expanded(frontier: DataFrame, n_rows: int, key: str, adjacency: Adjacency) -> DataFrame:
    """The frontier joined with the edges of its nodes, in cells: a hub with many edges, or one that many frontiers reach, has many tasks."""
    rows, edges = split(frontier, n_rows, key, adjacency)
    on = (F.col("at") == F.col("src")) & (rows["row_cell"] == edges["row_cell"]) & (rows["edge_cell"] == edges["edge_cell"])
    return rows.join(edges, on).drop(rows["row_cell"], rows["edge_cell"], edges["row_cell"], edges["edge_cell"])


def _widened(frontier: DataFrame, n_rows: int, adjacency: Adjacency, seen: list[DataFrame]) -> DataFrame:
    """The nodes one hop further that a side hasn't seen: pair_id, at, edge_id, attribute, prev (its smallest way back).

    Edges go both ways, so a neighbour of the latest hop that has been seen is of that hop or the one before it.
    """
    way = F.struct("edge_id", F.col("at").alias("prev"), "attribute")
    step = expanded(frontier, n_rows, "pair_id", adjacency).groupBy("pair_id", F.col("dst").alias("next")).agg(F.min(way).alias("w"))
    fresh = step.select("pair_id", F.col("next").alias("at"), "w.edge_id", "w.prev", "w.attribute")
    return materialize(fresh.join(reduce(DataFrame.unionByName, seen[-2:]), ["pair_id", "at"], "left_anti"), "frontier")


def shortest_paths(pairs: DataFrame, nodes: DataFrame, targets: DataFrame, max_hops: int = 4) -> DataFrame:
    """pair_id, hops, path array<struct<edge_id, attribute, from_id, to_id>>; hops null when there is none.

    Both ends search in turn, a hop at a time, so that neither goes further than half the way; a pair is done as soon as its
    sides meet (at the smallest node, if at several). Each reached node keeps one way back, by the smallest edge and node, and
    paths are put together at the end, a join a hop.
    """
    hop = "array<struct<edge_id:string,attribute:string,from_id:string,to_id:string>>"
    named = nodes.select("name", "entity_id")
    ends = [
        pairs.join(named, F.col(c) == F.col("name")).select(
            "pair_id", F.col("entity_id").alias("at")
        ).distinct() for c in ("name_a", "name_b")
    ]
    none = F.lit(None).cast("string")
    sides = []
    for mine, other in (ends, ends[::-1]):
        start = mine.join(other.select("pair_id").distinct(), "pair_id", "left_semi")
        sides.append(
            [materialize(start.select("pair_id", "at", none.alias("edge_id"), none.alias("prev"), none.alias("attribute")), "frontier")]
        )
    fronts = [side[0].select("pair_id", "at") for side in sides]
    seen = [[front] for front in fronts]
    adjacency = Adjacency.of(neighbours(targets))
    n_rows = [side[0].count() for side in sides]
    meetings: list[DataFrame] = []
    for hops in range(max_hops + 1):
        turn = (hops + 1) % 2
        if hops:
            wider = _widened(fronts[turn], n_rows[turn], adjacency, seen[turn])
            n_rows[turn] = wider.count()
            sides[turn].append(wider)
            fronts[turn] = wider.select("pair_id", "at")
            seen[turn].append(fronts[turn])
        # What a side has just reached and the other one has seen is in the other's latest hop: else they would have met before.
        met = fronts[0].join(fronts[1], ["pair_id", "at"]).groupBy("pair_id").agg(F.min("at").alias("meet"))
        meetings.append(materialize(met, "met"))
        fronts = [front.join(meetings[-1].select("pair_id"), "pair_id", "left_anti") for front in fronts]
        if hops and not n_rows[turn]:
            break
    found = [
        _path(met, k, sides).select("pair_id", F.lit(k).alias("hops"), F.col("path").cast(hop).alias("path")) for k,
        met in enumerate(meetings)
    ]
    whole = reduce(DataFrame.unionByName, found)
    return pairs.select("pair_id").distinct().join(whole, "pair_id", "left").select(
        "pair_id", F.col("hops").cast("long").alias("hops"), "path"
    )


def _path(met: DataFrame, hops: int, sides: list[list[DataFrame]]) -> DataFrame:
    """pair_id, path of the pairs that have met after so many hops."""
    rows = met.select(
        "pair_id", "meet",
        F.array().cast("array<struct<edge_id:string,attribute:string,from_id:string,to_id:string>>").alias("path")
    )
    for side, own in ((0, (hops + 1) // 2), (1, hops // 2)):
        rows = rows.withColumn("at", F.col("meet"))
        for k in range(own, 0, -1):
            step = sides[side][k].select("pair_id", F.col("at").alias("_at"), "edge_id", "prev", "attribute")
            rows = rows.join(step, (rows["pair_id"] == step["pair_id"]) & (F.col("at") == F.col("_at"))).drop(step["pair_id"])
            ends = ("prev", "at") if side == 0 else ("at", "prev")
            one = F.array(F.struct("edge_id", "attribute", F.col(ends[0]).alias("from_id"), F.col(ends[1]).alias("to_id")))
            rows = rows.select(
                "pair_id", "meet", (F.concat(one, "path") if side == 0 else F.concat("path", one)).alias("path"),
                F.col("prev").alias("at")
            )
    return rows


def within_hops(sources: DataFrame, targets: DataFrame, hops: int) -> DataFrame:
    """source, entity_id, hops: every node within so many undirected business hops, at its smallest distance."""
    adjacency = Adjacency.of(neighbours(targets).select("src", "dst").distinct())
    rounds = [sources.select("source", F.col("source").alias("entity_id"), F.lit(0).cast("long").alias("hops"))]
    for k in range(1, hops + 1):
        frontier = rounds[-1].select("source", F.col("entity_id").alias("at"))
        step = expanded(frontier, rounds[-1].count(), "source", adjacency).select("source", F.col("dst").alias("entity_id")).distinct()
        # Edges go both ways: what has been seen of the neighbours is of the last two rounds.
        before = reduce(DataFrame.unionByName, [r.select("source", "entity_id") for r in rounds[-2:]])
        fresh = step.join(before, ["source", "entity_id"], "left_anti")
        rounds.append(materialize(fresh.withColumn("hops", F.lit(k).cast("long")), "hop"))
    return reduce(DataFrame.unionByName, rounds)


def path_labels(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """pair_id, hops, label: ``A -> B (via attribute) -> ...`` with display names."""
    hops = paths.where("hops > 0").select("pair_id", "hops", F.posexplode("path").alias("pos", "h"))
    shown = nodes.select("entity_id", "display_name")
    a = hops.join(
        shown.withColumnRenamed("entity_id", "from_").withColumnRenamed("display_name", "from_label"),
        F.col("h.from_id") == F.col("from_")
    )
    b = a.join(shown.withColumnRenamed("entity_id", "to_").withColumnRenamed("display_name", "to_label"), F.col("h.to_id") == F.col("to_"))
    item = F.struct("pos", "from_label", F.concat(F.lit(" -> "), "to_label", F.lit(" (via "), "h.attribute", F.lit(")")).alias("text"))
    steps = b.groupBy("pair_id", "hops").agg(F.array_sort(F.collect_list(item)).alias("s"))
    return steps.select(
        "pair_id", "hops",
        F.concat(F.element_at("s", 1)["from_label"], F.array_join(F.transform("s", lambda x: x["text"]), "")).alias("label")
    )
