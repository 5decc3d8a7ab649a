"""Queries on the entity graph of the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.operators import graph as G
from cataloom.operators import inheritance as H
from cataloom.sources import adapters as A
from cataloom.sources.shared import written_once

PREFIXES = (("orders", "sales"), ("customer", "sales"), ("supplier", "purchasing"), ("part", "purchasing"))

NODES = """nodes AS (
  SELECT 'orders#'||o_orderkey AS entity_id, 'E'||o_orderkey AS name, 'orders' AS layer, 'customer#'||o_custkey AS parent_id FROM orders
  UNION ALL SELECT 'customer#'||c_custkey, 'E'||c_custkey, 'customer', 'nation#'||c_nationkey FROM customer
  UNION ALL SELECT 'supplier#'||s_suppkey, 'E'||s_suppkey, 'supplier', 'nation#'||s_nationkey FROM supplier
  UNION ALL SELECT 'part#'||p_partkey, 'E'||p_partkey, 'part', NULL FROM part
  UNION ALL SELECT 'nation#'||n_nationkey, 'N'||n_nationkey, 'nation', 'region#'||n_regionkey FROM nation
  UNION ALL SELECT 'region#'||r_regionkey, 'R'||r_regionkey, 'region', NULL FROM region)"""
TARGETS = """low AS (SELECT l_orderkey, min(l_suppkey) AS s FROM lineitem GROUP BY 1),
urgent AS (SELECT o_orderkey, o_custkey, s FROM orders JOIN low ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'),
targets AS (
  SELECT 'nation#'||n_nationkey||'::regionkey' AS edge_id, 'nation#'||n_nationkey AS from_id, 'N'||n_nationkey AS from_name, 'region' AS attribute,
  'region#'||n_regionkey AS to_id, 'R'||n_regionkey AS to_name, true AS is_audit, false AS is_polymorphic FROM nation
  UNION ALL SELECT 'customer#'||c_custkey||'::nationkey', 'customer#'||c_custkey, 'E'||c_custkey, 'nation', 'nation#'||c_nationkey, 'N'||c_nationkey,
  true, false FROM customer
  UNION ALL SELECT 'supplier#'||s_suppkey||'::nationkey', 'supplier#'||s_suppkey, 'E'||s_suppkey, 'nation', 'nation#'||s_nationkey, 'N'||s_nationkey,
  true, false FROM supplier
  UNION ALL SELECT 'orders#'||o_orderkey||'::custkey', 'orders#'||o_orderkey, 'E'||o_orderkey, 'customer', 'customer#'||o_custkey, 'E'||o_custkey,
  false, false FROM orders
  UNION ALL SELECT DISTINCT 'orders#'||l_orderkey||'::partkey_'||l_partkey, 'orders#'||l_orderkey, 'E'||l_orderkey, 'part', 'part#'||l_partkey,
  'E'||l_partkey, false, false FROM lineitem
  UNION ALL SELECT DISTINCT 'orders#'||l_orderkey||'::suppkey_'||l_suppkey, 'orders#'||l_orderkey, 'E'||l_orderkey, 'supplier',
  'supplier#'||l_suppkey, 'E'||l_suppkey, false, false FROM lineitem
  UNION ALL SELECT 'orders#'||o_orderkey||'::partykey', 'orders#'||o_orderkey, 'E'||o_orderkey, 'party', 'customer#'||o_custkey, 'E'||o_custkey,
  false, o_custkey <> s FROM urgent
  UNION ALL SELECT 'orders#'||o_orderkey||'::partykey', 'orders#'||o_orderkey, 'E'||o_orderkey, 'party', 'supplier#'||s, 'E'||s, false, o_custkey <> s
  FROM urgent)"""
PAIRS = """pairs AS (
  SELECT o_orderkey AS pair_id, 'E'||o_orderkey AS name_a, 'E'||o_custkey AS name_b FROM orders WHERE o_orderkey % 100 = 0
  UNION ALL SELECT o_orderkey, 'E'||o_orderkey, 'Enone' FROM orders WHERE o_orderkey % 100 = 1)"""
CHAIN = NODES + """, chain AS (
  SELECT entity_id, entity_id AS ancestor_id, 0 AS depth FROM nodes
  UNION ALL SELECT c.entity_id, n.parent_id, depth + 1 FROM chain c JOIN nodes n ON n.entity_id = c.ancestor_id WHERE n.parent_id IS NOT NULL)"""
ATTRS = """attrs AS (
  SELECT 'orders#'||o_orderkey AS entity_id, ord, name, data_type, CASE name WHEN 'customer' THEN 'custkey' WHEN 'nation' THEN 'id' END AS fk_name,
  CASE name WHEN 'customer' THEN 'customer' WHEN 'nation' THEN 'customer,nation' END AS fk_targets, CAST(NULL AS VARCHAR) AS description
    FROM orders, (VALUES (0,'key','integer'),(1,'status','string'),(2,'totalprice','decimal'),(3,'customer','entity'),(4,'nation','entity')) v(ord,
    name, data_type) WHERE ord < 4 OR o_orderpriority = '1-URGENT'
  UNION ALL SELECT 'customer#'||c_custkey, ord, name, data_type, CASE name WHEN 'nation' THEN 'nationkey' WHEN 'createdBy' THEN 'createdById' END,
  CASE name WHEN 'nation' THEN 'nation' WHEN 'createdBy' THEN 'user' END,
    CASE name WHEN 'name' THEN c_name WHEN 'nation' THEN 'Home of the customer, as told. May change.'
    WHEN 'createdBy' THEN 'Who made the record. Filled once.' END
    FROM customer, (VALUES (0,'key','integer'),(1,'name','string'),(2,'acctbal','decimal'),(3,'segment','string'),(4,'nation','entity'),(5,'createdBy','entity')) v(ord, name, data_type) WHERE ord < 5 OR c_mktsegment = 'BUILDING'
  UNION ALL SELECT 'supplier#'||s_suppkey, ord, name, data_type, fk, CASE WHEN fk IS NOT NULL THEN 'user' END, NULL FROM supplier,
  (VALUES (0,'key','integer',NULL),(1,'maker','entity','createdById')) v(ord, name, data_type, fk)
  UNION ALL SELECT 'part#'||p_partkey, ord, name, data_type, fk, CASE WHEN fk IS NOT NULL THEN 'user' END, NULL FROM part,
  (VALUES (0,'key','integer',NULL),(1,'owner','entity','ownerId')) v(ord, name, data_type, fk)
  UNION ALL SELECT 'nation#'||n_nationkey, ord, name, data_type, CASE name WHEN 'region' THEN 'regionkey' END, CASE name
  WHEN 'region' THEN 'region' END, CASE name WHEN 'name' THEN n_name END
    FROM nation, (VALUES (0,'key','integer'),(1,'name','string'),(2,'region','entity')) v(ord, name, data_type)
  UNION ALL SELECT 'region#'||r_regionkey, ord, name, data_type, CASE name WHEN 'createdBy' THEN 'createdById' END, CASE name
  WHEN 'createdBy' THEN 'user' END, CASE name WHEN 'regionname' THEN r_name ELSE 'Who made the record. Filled once.' END
    FROM region, (VALUES (0,'regionname','string'),(5,'createdBy','entity')) v(ord, name, data_type))"""
RESOLVED = CHAIN + ", " + ATTRS + """, decl AS (
  SELECT c.entity_id, c.depth, c.ancestor_id, a.ord, a.name, a.data_type, a.fk_name, a.fk_targets, a.description,
    row_number() OVER (PARTITION BY c.entity_id, a.name ORDER BY c.depth, a.ord DESC) AS rn,
    lead(a.fk_name) OVER (PARTITION BY c.entity_id, a.name ORDER BY c.depth, a.ord DESC) AS before_fk,
    lead(a.description) OVER (PARTITION BY c.entity_id, a.name ORDER BY c.depth, a.ord DESC) AS before_text
  FROM chain c JOIN attrs a ON a.entity_id = c.ancestor_id),
resolved AS (
  SELECT entity_id, name, depth, ord, ancestor_id AS declared_in, data_type, fk_targets, CASE WHEN fk_name = 'id' AND before_fk <> 'id' THEN before_fk
  ELSE fk_name END AS fk_name,
    CASE WHEN fk_name = 'id' AND before_fk <> 'id' THEN coalesce(description, before_text) ELSE description END AS description,
    CASE WHEN declared_in LIKE 'region#%' OR name IN ('regionname', 'createdBy') OR coalesce(fk_name, '') = 'createdById' THEN 'standard'
    WHEN depth = 0 THEN 'own' ELSE 'inherited' END AS origin,
    (name IN ('regionname', 'createdBy') OR coalesce(fk_name, '') = 'createdById') AND declared_in NOT LIKE 'region#%' AS inlined,
    row_number() OVER (PARTITION BY entity_id ORDER BY depth DESC, ord, name) AS pos
  FROM decl WHERE rn = 1)"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edge_targets(A.edges(spark, sf_dir))


def _is_region(entity_id):
    return F.startswith(entity_id, F.lit("region#"))


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All attributes of all entities, written once a session; a region plays the standard entity of those below it."""
    return written_once(spark, sf_dir, "resolved-attributes", lambda: H.inherited(A.declaring_nodes(spark, sf_dir), _is_region))


def fk_text(c: str = "fk_targets"):
    return F.coalesce(F.array_join(F.array_sort(F.transform(c, lambda t: t["entity"])), ","), F.lit("")).alias("targets")


def g1_layers(spark, sf_dir):
    return A.nodes(spark, sf_dir).groupBy(G.layer_of(F.col("document"), PREFIXES).alias("label")).agg(F.count("*").alias("n"))


def g2_display_names(spark, sf_dir):
    # Layer labels made coarser, so that names do collide.
    n = A.nodes(spark, sf_dir).withColumn("layer", G.layer_of(F.col("document"), PREFIXES))
    return G.display_names(n, F.col("document")).select("entity_id", "display_name")


def g6_edges(spark, sf_dir):
    e = A.edges(spark, sf_dir)
    return e.select(
        "edge_id", "from_id", "attribute",
        F.array_join(F.array_sort(F.transform("targets", lambda t: t["entity_id"])), ",").alias("to_ids"), "is_audit",
        "is_polymorphic"
    )


def g7_degrees(spark, sf_dir):
    return G.degrees(A.edges(spark, sf_dir))


def g8_summary(spark, sf_dir):
    return G.summary(A.nodes(spark, sf_dir), A.edges(spark, sf_dir))


def g9_find(spark, sf_dir):
    p = A.pairs(spark, sf_dir)
    wanted = p.select(
        F.col("pair_id").alias("request_id"),
        F.when(F.col("pair_id") % 200 < 100, F.lower("name_b")).otherwise(F.col("name_b")).alias("wanted")
    )
    return G.find(wanted, A.nodes(spark, sf_dir), A.LAYERS)


def q1_pair_relations(spark, sf_dir):
    return G.relations(A.pairs(spark, sf_dir), targets(spark, sf_dir))


def q2_party_names(spark, sf_dir):
    return G.party_names(targets(spark, sf_dir))


def q3_near_misses(spark, sf_dir):
    return G.near_misses(A.pairs(spark, sf_dir), targets(spark, sf_dir))


def q4_infrastructure_notes(spark, sf_dir):
    return G.infrastructure_notes(A.nodes(spark, sf_dir).select("name"), A.nodes(spark, sf_dir), targets(spark, sf_dir))


def _path_pairs(spark, sf_dir):
    # Customers of an order, and customers to a part of one of their orders: one hop and more.
    o, l = (A.table(spark, sf_dir, x) for x in ("orders", "lineitem"))
    two = o.where("o_orderkey % 100 = 2").join(
        l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_partkey").alias("p")), "o_orderkey"
    )
    name = lambda c: F.concat(F.lit("E"), F.col(c).cast("string"))
    return A.pairs(spark, sf_dir).unionByName(
        two.select(F.col("o_orderkey").alias("pair_id"), name("o_custkey").alias("name_a"), name("p").alias("name_b"))
    )


PATH_PAIRS = PAIRS + """, path_pairs AS (SELECT * FROM pairs UNION ALL
  SELECT o_orderkey, 'E'||o_custkey, 'E'||(SELECT max(l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) FROM orders WHERE o_orderkey % 100 = 2
  AND o_orderkey IN (SELECT l_orderkey FROM lineitem))"""
HOPS = """adj AS (SELECT DISTINCT * FROM (SELECT from_id AS src, to_id AS dst FROM targets WHERE NOT is_audit UNION ALL SELECT to_id, from_id
  FROM targets WHERE NOT is_audit)),
a0 AS (SELECT pair_id, entity_id AS loc FROM path_pairs JOIN nodes ON name = name_a), goal AS (SELECT pair_id, entity_id AS loc FROM path_pairs
  JOIN nodes ON name = name_b),
h0 AS (SELECT DISTINCT pair_id FROM a0 JOIN goal USING (pair_id, loc)), a1 AS (SELECT DISTINCT pair_id, dst AS loc FROM a0 JOIN adj ON src = loc),
h1 AS (SELECT DISTINCT pair_id FROM a1 JOIN goal USING (pair_id, loc)), g1 AS (SELECT DISTINCT pair_id, dst AS loc FROM goal JOIN adj ON src = loc),
h2 AS (SELECT DISTINCT pair_id FROM a1 JOIN g1 USING (pair_id, loc)), a2 AS (SELECT DISTINCT pair_id, dst AS loc FROM a1 JOIN adj ON src = loc
  WHERE pair_id NOT IN (SELECT pair_id FROM h2)),
h3 AS (SELECT DISTINCT pair_id FROM a2 JOIN g1 USING (pair_id, loc)), g2 AS (SELECT DISTINCT pair_id, dst AS loc FROM g1 JOIN adj ON src = loc
  WHERE pair_id NOT IN (SELECT pair_id FROM h3)), h4 AS (SELECT DISTINCT pair_id FROM a2 JOIN g2 USING (pair_id, loc)),
hops AS (SELECT pair_id, CASE WHEN pair_id IN (SELECT pair_id FROM h0) THEN 0 WHEN pair_id IN (SELECT pair_id FROM h1) THEN 1
  WHEN pair_id IN (SELECT pair_id FROM h2) THEN 2 WHEN pair_id IN (SELECT pair_id FROM h3) THEN 3 WHEN pair_id IN (SELECT pair_id
  FROM h4) THEN 4 END AS hops FROM path_pairs)"""


def _paths(spark, sf_dir):
    return G.shortest_paths(_path_pairs(spark, sf_dir), A.nodes(spark, sf_dir), targets(spark, sf_dir))


def q5_shortest_paths(spark, sf_dir):
    return _paths(spark, sf_dir).select("pair_id", "hops")


def q6_within_hops(spark, sf_dir):
    sources = A.table(spark, sf_dir, "part").where("p_partkey % 100 = 0").select(
        F.concat(F.lit("part#"), F.col("p_partkey").cast("string")).alias("source")
    )
    return G.within_hops(sources, targets(spark, sf_dir), 2)


def q7_path_labels(spark, sf_dir):
    return G.path_labels(_paths(spark, sf_dir), A.nodes(spark, sf_dir))


def h1_chains(spark, sf_dir):
    return H.chains(A.nodes(spark, sf_dir)).select("entity_id", "ancestor_id", F.col("depth").cast("long").alias("depth"))


def h4_standard_fields(spark, sf_dir):
    return resolved(spark, sf_dir).groupBy("name", "origin", "inlined").agg(F.count("*").alias("n"))


def h5_resolved_attributes(spark, sf_dir):
    return resolved(spark, sf_dir).select(
        "entity_id", "name", "origin", "inlined", "pos", "declared_in", "data_type", "fk_name", fk_text(), "description"
    )


def h6_canonical_fk_names(spark, sf_dir):
    return H.canonical_fk_names(resolved(spark, sf_dir))


def h7_attribute_counts(spark, sf_dir):
    return H.attribute_counts(resolved(spark, sf_dir))


def q8_entity_details(spark, sf_dir):
    n = A.nodes(spark, sf_dir)
    return H.entity_details(n, targets(spark, sf_dir), resolved(spark, sf_dir), H.chains(n))


def q8_attribute_rows(spark, sf_dir):
    return H.attribute_rows(A.nodes(spark, sf_dir), resolved(spark, sf_dir))


def q8_relationship_rows(spark, sf_dir):
    return H.relationship_rows(A.nodes(spark, sf_dir), targets(spark, sf_dir))


def q9_attribute_holders(spark, sf_dir):
    return H.attribute_holders(resolved(spark, sf_dir))


def q9_attribute_details(spark, sf_dir):
    return H.attribute_details(resolved(spark, sf_dir)).withColumn("targets", F.array_join("targets", ","))


def q10_attribute_tokens(spark, sf_dir):
    return H.attribute_tokens(H.attribute_details(resolved(spark, sf_dir)))


def q11_collisions(spark, sf_dir):
    return H.collisions(resolved(spark, sf_dir))


DETAILS = """details AS (SELECT name, string_agg(DISTINCT t, ',' ORDER BY t) AS targets, count(DISTINCT CASE
  WHEN depth = 0 THEN entity_id END) AS n_declared_by, count(DISTINCT CASE WHEN depth > 0 THEN entity_id END) AS n_inherited_by,
  min(fk_name) AS fk_name, count(DISTINCT t) > 1 AS is_polymorphic
  FROM (SELECT name, entity_id, depth, fk_name, unnest(string_split(fk_targets, ',')) AS t FROM resolved WHERE origin <> 'standard'
  AND fk_name IS NOT NULL AND fk_name NOT IN ('id', 'ownerId') AND fk_targets IS NOT NULL) GROUP BY name)"""

QUERIES = {f.__name__: f for f in (
    g1_layers, g2_display_names, g6_edges, g7_degrees, g8_summary, g9_find, q1_pair_relations, q2_party_names, q3_near_misses, q4_infrastructure_notes, q5_shortest_paths, q6_within_hops, q7_path_labels,
    h1_chains, h4_standard_fields, h5_resolved_attributes, h6_canonical_fk_names, h7_attribute_counts, q8_entity_details, q8_attribute_rows, q8_relationship_rows, q9_attribute_details, q9_attribute_holders, q10_attribute_tokens, q11_collisions,
)}

_W = "WITH RECURSIVE "
_LABEL = "CASE WHEN layer IN ('orders','customer') THEN 'sales' WHEN layer IN ('supplier','part') THEN 'purchasing' ELSE 'root' END"
ORACLE_SQL = {
    "g1_layers": f"{_W}{NODES} SELECT {_LABEL} AS label, count(*) AS n FROM nodes GROUP BY 1",
    "g2_display_names": f"{_W}{NODES}, l AS (SELECT entity_id, name, layer AS document, {_LABEL} AS label FROM nodes) SELECT entity_id, CASE WHEN count(*) OVER (PARTITION BY name, label) > 1 THEN name||' ('||label||': '||document||')' ELSE name||' ('||label||')' END AS display_name FROM l",
    "g6_edges": f"{_W}{TARGETS} SELECT edge_id, from_id, attribute, string_agg(to_id, ',' ORDER BY to_id) AS to_ids, bool_or(is_audit) AS is_audit, bool_or(is_polymorphic) AS is_polymorphic FROM targets GROUP BY 1, 2, 3",
    "g7_degrees": f"{_W}{TARGETS} SELECT entity_id, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (SELECT DISTINCT from_id AS entity_id, edge_id, 1 AS o, 0 AS i FROM targets WHERE NOT is_audit UNION ALL SELECT DISTINCT to_id, edge_id, 0, 1 FROM targets WHERE NOT is_audit) GROUP BY 1",
    "g8_summary": f"{_W}{NODES}, {TARGETS}, e AS (SELECT edge_id, bool_or(is_audit) AS a, bool_or(is_polymorphic) AS p FROM targets GROUP BY 1) SELECT 'nodes:'||layer AS metric, count(*) AS value FROM nodes GROUP BY 1 UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'audit_edges', count(*) FROM e WHERE a UNION ALL SELECT 'polymorphic_edges', count(*) FROM e WHERE p UNION ALL SELECT 'unresolved_targets', count(*) FROM targets WHERE to_id NOT IN (SELECT entity_id FROM nodes)",
    "g9_find": f"{_W}{NODES}, {PAIRS}, w AS (SELECT pair_id AS request_id, CASE WHEN pair_id % 200 < 100 THEN lower(name_b) ELSE name_b END AS wanted FROM pairs) SELECT request_id, wanted, entity_id, layer FROM w JOIN nodes ON lower(wanted) = lower(name) QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY (wanted = name) DESC, list_position(['orders','customer','supplier','part','nation','region'], layer), entity_id) = 1",
    "q1_pair_relations": f"{_W}{TARGETS}, {PAIRS}, r AS (SELECT pair_id, edge_id, from_id, to_id, attribute, is_audit, 'out' AS direction FROM pairs JOIN targets ON name_a = from_name AND name_b = to_name UNION ALL SELECT pair_id, edge_id, from_id, to_id, attribute, is_audit, 'in' FROM pairs JOIN targets ON name_b = from_name AND name_a = to_name) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY pair_id, edge_id ORDER BY direction DESC, from_id DESC, to_id DESC) = 1",
    "q2_party_names": f"{_W}{TARGETS} SELECT DISTINCT to_name AS name FROM targets WHERE is_polymorphic",
    "q3_near_misses": f"""{_W}{TARGETS}, {PAIRS}, direct AS (SELECT DISTINCT pair_id FROM pairs JOIN targets ON (name_a = from_name
    AND name_b = to_name) OR (name_b = from_name AND name_a = to_name)),
      op AS (SELECT * FROM pairs WHERE pair_id NOT IN (SELECT pair_id FROM direct)), party AS (SELECT DISTINCT to_name FROM targets
      WHERE is_polymorphic),
      b AS (SELECT t.*, to_name IN (SELECT to_name FROM party) AS party FROM targets t WHERE NOT is_audit),
      s AS (SELECT pair_id, 'a' AS side, edge_id, attribute, name_b AS missing, to_name, party FROM op JOIN b ON name_a = from_name
        UNION ALL SELECT pair_id, 'b', b.edge_id, b.attribute, name_a, b.to_name, b.party FROM (SELECT DISTINCT pair_id, name_a, edge_id FROM op
        JOIN b ON name_b = to_name) i JOIN b USING (edge_id)),
      g AS (SELECT pair_id, side, edge_id, attribute, bool_or(contains(lower(attribute), lower(missing)) OR contains(lower(to_name),
      lower(missing))) AS lexical, bool_or(party) AS structural FROM s GROUP BY 1, 2, 3, 4)
      SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY lexical DESC, structural DESC, edge_id) AS rank FROM g WHERE lexical
      OR structural QUALIFY rank <= 5""",
    "q4_infrastructure_notes": f"""{_W}{NODES}, {TARGETS}, ends AS (SELECT DISTINCT edge_id, from_id AS entity_id, is_audit, 1 AS d FROM targets
    UNION ALL SELECT DISTINCT edge_id, to_id, is_audit, 2 FROM targets),
      c AS (SELECT name, count(edge_id) FILTER (NOT is_audit) AS business, count(edge_id) FILTER (is_audit) AS audit FROM nodes LEFT
      JOIN ends USING (entity_id) GROUP BY 1)
      SELECT name, CASE WHEN audit > 0 THEN name||' has no business relationships, only '||audit||' audit links.'
      ELSE name||' has no relationships at all.' END AS note FROM c WHERE business = 0""",
    "q5_shortest_paths": f"{_W}{NODES}, {TARGETS}, {PATH_PAIRS}, {HOPS} SELECT pair_id, CAST(hops AS BIGINT) AS hops FROM hops",
    "q6_within_hops": f"{_W}{TARGETS}, adj AS (SELECT DISTINCT * FROM (SELECT from_id AS src, to_id AS dst FROM targets WHERE NOT is_audit UNION ALL SELECT to_id, from_id FROM targets WHERE NOT is_audit)), s AS (SELECT 'part#'||p_partkey AS source FROM part WHERE p_partkey % 100 = 0), r AS (SELECT source, source AS entity_id, 0 AS h FROM s UNION ALL SELECT source, dst, 1 FROM s JOIN adj ON src = source UNION ALL SELECT source, b.dst, 2 FROM s JOIN adj a ON a.src = source JOIN adj b ON b.src = a.dst) SELECT source, entity_id, CAST(min(h) AS BIGINT) AS hops FROM r GROUP BY 1, 2",
    "h1_chains": f"{_W}{CHAIN} SELECT entity_id, ancestor_id, CAST(depth AS BIGINT) AS depth FROM chain",
    "h4_standard_fields": f"{_W}{RESOLVED} SELECT name, origin, inlined, count(*) AS n FROM resolved GROUP BY 1, 2, 3",
    "h5_resolved_attributes": f"{_W}{RESOLVED} SELECT entity_id, name, origin, inlined, pos, declared_in, data_type, fk_name, coalesce(fk_targets, '') AS targets, description FROM resolved",
    "h6_canonical_fk_names": f"{_W}{RESOLVED} SELECT entity_id, name, nullif(fk_name, 'id') AS fk_name FROM resolved",
    "h7_attribute_counts": f"{_W}{RESOLVED} SELECT entity_id, count(*) FILTER (origin = 'own') AS own, count(*) FILTER (origin = 'inherited') AS inherited, count(*) FILTER (origin = 'standard') AS standard, count(*) AS total FROM resolved GROUP BY 1",
    "q8_entity_details": f"""{_W}{RESOLVED}, {TARGETS}, r AS (SELECT entity_id, count(*) FILTER (origin = 'own') AS own,
    count(*) FILTER (origin = 'inherited') AS inherited, count(*) FILTER (origin = 'standard') AS standard, count(*) AS total,
        coalesce(string_agg(name, ',' ORDER BY pos) FILTER (origin = 'own'), '') AS own_names, coalesce(string_agg(name, ','
        ORDER BY pos) FILTER (origin = 'inherited'), '') AS inherited_names, coalesce(string_agg(name, ',' ORDER BY pos) FILTER (origin = 'standard'),
        '') AS standard_names FROM resolved GROUP BY 1),
      line AS (SELECT entity_id, string_agg(ancestor_id, '>' ORDER BY depth) AS chain FROM chain GROUP BY 1), o AS (SELECT from_id AS entity_id,
      count(DISTINCT edge_id) AS n_out FROM targets WHERE NOT is_audit GROUP BY 1), i AS (SELECT to_id AS entity_id, count(DISTINCT edge_id) AS n_in
      FROM targets WHERE NOT is_audit GROUP BY 1)
      SELECT n.entity_id, name||' ('||layer||')' AS display_name, coalesce(own, 0) AS own, coalesce(inherited, 0) AS inherited, coalesce(standard,
      0) AS standard, coalesce(total, 0) AS total, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, coalesce(own_names, '') AS own_names,
      coalesce(inherited_names, '') AS inherited_names, coalesce(standard_names, '') AS standard_names, line.chain AS chain,
        coalesce((SELECT string_agg(m.layer, ',' ORDER BY m.layer) FROM nodes m WHERE m.name = n.name AND m.layer <> n.layer), '') AS other_layers
      FROM nodes n LEFT JOIN r USING (entity_id) LEFT JOIN line USING (entity_id) LEFT JOIN o USING (entity_id) LEFT JOIN i USING (entity_id)""",
    "q8_attribute_rows": f"{_W}{RESOLVED} SELECT r.entity_id, pos, r.name, origin, CASE WHEN fk_name IS NOT NULL THEN 'reference to '||replace(fk_targets, ',', '/') ELSE data_type END AS label, fk_name, r.description, CASE WHEN origin <> 'own' THEN n.name||' ('||n.layer||')' END AS declared_by FROM resolved r JOIN nodes n ON n.entity_id = r.declared_in",
    "q8_relationship_rows": f"""{_W}{NODES}, {TARGETS}, disp AS (SELECT entity_id, name||' ('||layer||')' AS shown FROM nodes), b AS (SELECT *,
    split_part(edge_id, '::', 2) AS fk_name FROM targets WHERE NOT is_audit)
      SELECT from_id AS entity_id, 'outgoing' AS direction, edge_id, attribute, fk_name, bool_or(is_polymorphic) AS is_polymorphic,
      string_agg(DISTINCT shown, ', ' ORDER BY shown) AS others FROM b JOIN disp d ON d.entity_id = to_id GROUP BY edge_id, from_id, attribute,
      fk_name
      UNION ALL SELECT DISTINCT to_id, 'incoming', edge_id, attribute, fk_name, is_polymorphic, shown FROM b JOIN disp d ON d.entity_id = from_id""",
    "q9_attribute_holders": f"{_W}{RESOLVED} SELECT DISTINCT name, entity_id, CASE WHEN depth = 0 THEN 'declared' ELSE 'inherited' END AS held FROM resolved WHERE origin <> 'standard' AND fk_name IS NOT NULL AND fk_name NOT IN ('id', 'ownerId') AND fk_targets IS NOT NULL",
    "q9_attribute_details": f"{_W}{RESOLVED}, {DETAILS} SELECT * FROM details",
    "q10_attribute_tokens": f"{_W}{RESOLVED}, {DETAILS} SELECT name AS token, name FROM details UNION SELECT fk_name, name FROM details",
    "q11_collisions": f"{_W}{RESOLVED} SELECT name, count(DISTINCT fk_targets) AS n_sets FROM resolved WHERE fk_name IS NOT NULL AND fk_targets IS NOT NULL GROUP BY 1 HAVING count(DISTINCT fk_targets) > 1",
}
