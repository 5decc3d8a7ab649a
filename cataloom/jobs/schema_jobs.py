"""Queries on schema documents made from the parts table."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.functions.paths import dirname, is_live_document
from cataloom.operators import chunks as C
from cataloom.operators import graph as G
from cataloom.operators import inheritance as H
from cataloom.operators import relationships as R
from cataloom.operators import resolution as N
from cataloom.sources import index as I
from cataloom.sources import schema_documents as S
from cataloom.sources.shared import materialize, shared_dir, written_once

#: Name of the entity that provides the standard fields.
STANDARD = "CdsStandard"


class Catalog:
    """The tables of one corpus. What several queries need of the corpus of a folder is written once a session."""

    def __init__(self, spark: SparkSession, docs: DataFrame, sf_dir: str | None = None):
        self.spark, self.docs, self.sf_dir = spark, docs, sf_dir
        self.good, self.bad = S.parsed(docs)
        self._tables: dict[str, DataFrame] = {}
        self.live = self._kept("documents", lambda: self.good.where(is_live_document(F.col("path"))))
        self.entities, self.groups = S.definitions(self.live)

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Catalog:
        return cls(spark, S.from_parts(spark, sf_dir), sf_dir)

    def _kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if self.sf_dir is not None:
            return written_once(self.spark, self.sf_dir, f"corpus-{name}", build)
        if name not in self._tables:
            self._tables[name] = materialize(build(), name)
        return self._tables[name]

    @property
    def imports(self) -> DataFrame:
        return self._kept("imports", lambda: S.imports(self.live))

    @property
    def closures(self) -> DataFrame:
        return self._kept("closures", lambda: N.closure(self.live.select(F.col("path").alias("doc")), self.imports))

    def flat(self) -> DataFrame:
        return self._kept("flat", lambda: N.flattened(self.entities, self.groups))

    def expanded(self) -> DataFrame:
        return self._kept("expanded", lambda: N.expanded(self.flat(), self.imports, self.groups))

    def parents(self) -> DataFrame:
        return self._kept("parents", lambda: N.parents(self.entities, self.imports))

    def resolve(self, requests: DataFrame) -> DataFrame:
        """doc, wanted, id: the entities that names mean in documents, null where nothing defines them."""
        found = N.resolve(requests, self.imports, self.entities)
        return found.select("doc", "wanted", F.concat("found_doc", F.lit("#"), "found_name").alias("id"))

    def resolved(self) -> DataFrame:
        """Attributes after inheritance: document, entity, attribute, fk_name, targets, origin, depth, declared_in, home, ..."""
        return self._kept("resolved", self._resolved)

    def _resolved(self) -> DataFrame:
        own = self.expanded().select(
            F.concat("doc", F.lit("#"), "owner").alias("entity_id"), "ord", "home", "name", "data_type", "fk_name", "fk_targets",
            "description"
        )
        # The standard names that a leaf's document sees, whether or not it has the standard entity above it.
        seen = self.resolve(
            self.entities.select("doc", F.lit(STANDARD).alias("wanted"))
        ).where("id is not null").join(self.entities.select("doc", "name"), "doc")
        offered = own.select(
            F.col("entity_id").alias("id"), F.explode(F.array_compact(F.array("name", "fk_name"))).alias("given")
        ).distinct()
        standard = seen.join(offered, "id").select(F.concat("doc", F.lit("#"), "name").alias("entity_id"), F.col("given").alias("name"))
        out = H.resolved(own, H.chains(self.parents()), standard, F.substring_index("ancestor_id", "#", -1) == STANDARD)
        out = out.withColumn(
            "document", F.substring_index("entity_id", "#", 1)
        ).withColumn("entity", F.substring_index("entity_id", "#", -1))
        return out.withColumnRenamed("name", "attribute").withColumnRenamed("fk_targets", "targets")

    def fk_nodes(self) -> DataFrame:
        return N.fk_nodes(self.entities)

    def direct(self) -> DataFrame:
        return R.extracted(self.fk_nodes()).withColumn("sources", F.array(F.lit("document")))

    def canonical(self) -> DataFrame:
        """Direct relationships under the keys' real names."""
        return self._kept("direct", self._canonical)

    def _canonical(self) -> DataFrame:
        base = self.resolved().where((F.col("fk_name") != N.PLACEHOLDER) & F.col("fk_name").isNotNull())
        return R.canonical(self.direct(), base.select("document", "entity", "attribute", F.col("fk_name").alias("base_fk")))

    def seeds(self, *folders: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [S.seeds(self.entities, folder) for folder in folders])

    def relationships(self) -> DataFrame:
        """Direct ones with canonical names, derived ones, and those of manifests, merged."""
        target = F.struct(F.col("target_entity").alias("entity"), F.col("target_attribute").alias("attribute"))
        manifest = S.manifest_relationships(self.good).select(
            "document", "entity", F.col("fk").alias("fk_name"), F.array(target).alias("targets"), "traits",
            F.array(F.lit("manifest")).alias("sources")
        )
        return R.merged(
            self.canonical(), R.derived(self.resolved(), self.canonical()),
            manifest.withColumn("attribute", F.lit(None).cast("string")).withColumn("fk_inferred", F.lit(False))
        )

    def of_seeds(self, seeds: DataFrame) -> DataFrame:
        """The seeds' own relationships, direct and derived, merged."""
        mine = lambda rows: rows.join(
            seeds.select(F.col("doc").alias("document"), F.col("name").alias("entity")), ["document", "entity"], "left_semi"
        )
        return R.merged(mine(self.canonical()), mine(R.derived(self.resolved(), self.canonical())))

    def chosen(self, *folders: str) -> DataFrame:
        """Targets of the seeds' relationships, by the seed rule."""
        seeds = self.seeds(*folders)
        wanted = R.wanted_targets(self.of_seeds(seeds))
        found = self.resolve(wanted.select(F.col("document").alias("doc"), F.col("target").alias("wanted")))
        return R.chosen_targets(
            found.select(F.col("doc").alias("document"), F.col("wanted").alias("target"), F.col("id").alias("import_id")), seeds
        )

    def graph(self, *folders: str) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of the graph around the entities of some folders."""
        seeds = self.seeds(*folders)
        chosen = self._kept("chosen-" + "-".join(folders), lambda: self.chosen(*folders))
        nodes = lambda: R.nodes(
            R.node_set(seeds, chosen, self.parents()), self.entities, G.layer_of(F.col("document"), ()),
            dirname(F.col("document"))
        )
        edges = lambda: R.edges(self.of_seeds(seeds), chosen, S.AUDIT)
        return self._kept("nodes-" + "-".join(folders), nodes), self._kept("edges-" + "-".join(folders), edges)


def text(c: str):
    return F.coalesce(F.array_join(c, ","), F.lit(""))


def targets_text(c: str = "targets"):
    """``entity.attribute`` of each target, or ``entity`` alone."""
    return text(F.transform(c, lambda t: F.concat_ws(".", t["entity"], t["attribute"])))


def s1_documents(spark, sf_dir):
    """The corpus written as a tree of files and read again, with what is wrong with those that are no documents."""
    folder = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    S.write_tree(S.from_parts(spark, sf_dir), folder)
    return S.read_tree(spark, folder).select("path", F.col("reason").isNull().alias("ok"), "reason")


def s1_document_refresh(spark, sf_dir):
    """The tree read, and read again after the brands' documents have come: only they are read then."""
    place, docs = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}", S.from_parts(spark, sf_dir)
    late = F.startswith("path", F.lit("brands/"))
    for part in (docs.where(~late), docs.where(late)):
        S.write_tree(part, f"{place}/tree")
        files = S.refreshed(spark, f"{place}/tree", f"{place}/documents")
    return files.select("path", "reason", "read_in")


def s2_entity_documents(spark, sf_dir):
    return S.entity_documents(S.from_parts(spark, sf_dir)).select("path")


def s3_imports(spark, sf_dir):
    return S.imports(Catalog.of(spark, sf_dir).good).select("doc", F.col("ord").cast("long").alias("ord"), "target_doc", "moniker")


def s4_definitions(spark, sf_dir):
    c = Catalog.of(spark, sf_dir)
    return c.entities.select("doc", "name", "extends", F.lit("entity").alias("kind")).unionByName(
        c.groups.select("doc", "name", F.lit(None).cast("string").alias("extends"), F.lit("group").alias("kind"))
    )


def s5_manifest_relationships(spark, sf_dir):
    return S.manifest_relationships(Catalog.of(spark, sf_dir).good).withColumn("traits", text("traits"))


def s6_seeds(spark, sf_dir):
    return Catalog.of(spark, sf_dir).seeds("parts")


def s8_subset(spark, sf_dir):
    """Documents reached from the seeds. The copy is written, its graph is built anew, and both graphs are counted."""
    c = Catalog.of(spark, sf_dir)
    seeds = c.seeds("parts").select(F.col("doc").alias("root")).distinct()
    reached = c.closures.join(seeds, "root", "left_semi").select("doc").distinct()
    aliased = c.imports.where("moniker is not null").join(reached, "doc", "left_semi").select(F.col("target_doc").alias("root")).distinct()
    kept = reached.unionByName(c.closures.join(aliased, "root", "left_semi").select("doc")).distinct()
    subset = materialize(c.docs.join(kept.withColumnRenamed("doc", "path"), "path", "left_semi"), "subset")

    def counts(catalog: Catalog) -> DataFrame:
        nodes, edges = catalog.graph("parts")
        lost = R.unresolved(edges).agg(F.count("*").alias("n_unresolved"))
        return nodes.agg(F.count("*").alias("n_nodes")).join(edges.agg(F.count("*").alias("n_edges"))).join(lost)

    # Two rows of one value each, so these joins are of single rows.
    whole, part = (counts(x) for x in (c, Catalog(spark, subset)))
    verdict = whole.join(part.toDF("m_nodes", "m_edges", "m_unresolved")).withColumn(
        "verified",
        (F.col("n_nodes") == F.col("m_nodes")) & (F.col("n_edges") == F.col("m_edges")) & (F.col("n_unresolved") == F.col("m_unresolved"))
    )
    return subset.select("path").join(F.broadcast(verdict.select("n_nodes", "n_edges", "n_unresolved", "verified")))


def n1_import_closure(spark, sf_dir):
    return Catalog.of(spark, sf_dir).closures


def _requests(c: Catalog) -> DataFrame:
    parents = c.entities.where(F.col("extends") != N.ROOT).select("doc", F.col("extends").alias("wanted"))
    return parents.unionByName(c.direct().select(F.col("document").alias("doc"), F.explode("targets.entity").alias("wanted"))).distinct()


def n2_n3_resolved_names(spark, sf_dir):
    c = Catalog.of(spark, sf_dir)
    return N.resolve(
        _requests(c), c.imports, c.entities
    ).where("found_doc is not null").select("doc", "wanted", "found_doc", "found_name")


def n4_unresolved(spark, sf_dir):
    """Names of parents, targets and groups that nothing defines where they are written."""
    c = Catalog.of(spark, sf_dir)
    names = N.resolve(_requests(c), c.imports, c.entities)
    groups = N.resolve(c.flat().where("kind = 'group'").select("doc", F.col("name").alias("wanted")), c.imports, c.groups)
    return names.unionByName(groups).where("found_doc is null").select("doc", "wanted").distinct()


def h2_expanded_groups(spark, sf_dir):
    e = Catalog.of(spark, sf_dir).expanded()
    return e.select(
        "doc", "owner", "name", F.array_join(F.transform("ord", lambda x: x.cast("string")), ".").alias("ord"),
        text("group_path").alias("group_path"), "home"
    )


def h3_projected_attributes(spark, sf_dir):
    e = Catalog.of(spark, sf_dir).expanded()
    return e.select(
        "doc", "owner", "name", "data_type", "fk_name", targets_text("fk_targets").alias("targets"), H.type_label().alias("label")
    )


def r1_extracted(spark, sf_dir):
    return Catalog.of(spark, sf_dir).direct().select("document", "entity", "attribute", "fk_name", targets_text().alias("targets"))


def r1_skipped(spark, sf_dir):
    return R.skipped(Catalog.of(spark, sf_dir).fk_nodes())


def r2_audit_share(spark, sf_dir):
    d = Catalog.of(spark, sf_dir).direct().withColumn(
        "folder", F.substring_index("document", "/", 1)
    ).withColumn("audit", R.is_audit(F.col("fk_name"), S.AUDIT))
    return d.groupBy("folder").agg(
        F.count("*").alias("n"), F.count_if("audit").alias("n_audit"),
        F.round(F.avg(F.col("audit").cast("int")), 6).alias("share")
    )


def _blank(c: str):
    return F.coalesce(c, F.lit("")).alias(c)


def r3_merged(spark, sf_dir):
    m = Catalog.of(spark, sf_dir).relationships()
    return m.select(
        "document", "entity", "fk_name", targets_text().alias("targets"), text("traits").alias("traits"),
        text("sources").alias("sources"), "fk_inferred", "attribute", _blank("inherited_from"), _blank("resolve_from")
    )


def r4_canonical(spark, sf_dir):
    return Catalog.of(spark, sf_dir).canonical().select("document", "entity", "attribute", "fk_name", "fk_inferred")


def r5_derived(spark, sf_dir):
    c = Catalog.of(spark, sf_dir)
    return R.derived(c.resolved(), c.direct()).select(
        "document", "entity", "attribute", "fk_name", targets_text().alias("targets"), text("sources").alias("sources"),
        "fk_inferred", _blank("inherited_from"), "resolve_from"
    )


def r6_polymorphic(spark, sf_dir):
    return Catalog.of(spark, sf_dir).direct().select(
        "document", "entity", "attribute", R.is_polymorphic(F.col("targets")).alias("is_polymorphic")
    )


def g3_chosen_targets(spark, sf_dir):
    c = Catalog.of(spark, sf_dir)
    one, two = c.chosen("parts").withColumn("seeds", F.lit("parts")), c.chosen("parts", "types").withColumn("seeds", F.lit("parts+types"))
    return one.unionByName(two).select("seeds", "document", "target", "import_id", "chosen_id", "resolved_by")


def g4_deviations(spark, sf_dir):
    return R.deviations(Catalog.of(spark, sf_dir).chosen("parts", "types"))


def g5_node_set(spark, sf_dir):
    c = Catalog.of(spark, sf_dir)
    return R.node_set(c.seeds("parts"), c.chosen("parts"), c.parents())


def g6_document_edges(spark, sf_dir):
    """The edges of the graph around the parts, from documents alone."""
    _, edges = Catalog.of(spark, sf_dir).graph("parts")
    to = F.transform(
        "targets",
        lambda t: F.concat(
            F.concat_ws(".", t["name"], t["attribute"]), F.lit(">"), F.coalesce(t["entity_id"], F.lit("?")), F.lit(":"),
            t["resolved_by"]
        )
    )
    return edges.select(
        "edge_id", "from_id", "attribute", "fk_name", text(to).alias("targets"), "is_audit", "is_polymorphic", "fk_inferred",
        _blank("inherited_from"), text("sources").alias("sources")
    )


def g6_unresolved_targets(spark, sf_dir):
    return R.unresolved(Catalog.of(spark, sf_dir).graph("parts")[1])


def g8_document_summary(spark, sf_dir):
    return G.summary(*Catalog.of(spark, sf_dir).graph("parts"))


def c7_document_chunks(spark, sf_dir):
    """Sentences about the relationships that documents declare."""
    nodes, edges = Catalog.of(spark, sf_dir).graph("parts")
    return C.relationship_chunks(edges, nodes).select("chunk_id", "text")


def s7_index_rebuild(spark, sf_dir):
    """An index of entity descriptions: built anew, opened again as it is, and built again under another model's tag."""
    place = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    c = Catalog.of(spark, sf_dir)
    rows = c.entities.select(
        F.concat("doc", F.lit("#"), "name").alias("chunk_id"), F.substring_index("doc", "/", 1).alias("chunk_type"),
        F.concat("name", F.lit(" extends "), F.coalesce("extends", F.lit("nothing"))).alias("text")
    )
    opened = [I.open_or_build(rows, place, model) for model in ("hashing-64", "hashing-64", "hashing-128")]
    done = ",".join("built" if x.built else "opened" for x in opened)
    return opened[-1].rows.select("chunk_id", "chunk_type", "text", "model").withColumn("done", F.lit(done))


BASE = r"""ty AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS i FROM (SELECT DISTINCT p_type FROM part)),
br AS (SELECT 'B'||b AS b, i FROM (SELECT regexp_extract(p_brand, '(\d+)', 1) AS b, min(p_type) AS p_type FROM part GROUP BY 1)
  JOIN ty USING (p_type)),
pa AS (SELECT p_partkey AS k, 'P'||p_partkey AS p, 'B'||regexp_extract(p_brand, '(\d+)', 1) AS b, p_size % 6 AS j FROM part),
direct AS (
  SELECT 'parts/'||p||'.cdm.json' AS document, p AS entity, 'alt' AS attribute, 'altId' AS fk_name, 'T'||j||'.typeId' AS targets FROM pa
  UNION ALL SELECT 'parts/'||p||'.cdm.json', p, 'createdBy', 'createdById', 'User' FROM pa WHERE k % 10 = 0
  UNION ALL SELECT 'brands/'||b||'.cdm.json', b, 'regarding', 'id', 'T0,T1' FROM br
  UNION ALL SELECT 'types/T'||i||'.cdm.json', 'T'||i, 'regarding', 'regardingId', 'T0' FROM ty
  UNION ALL SELECT 'types/T'||i||'.cdm.json', 'T'||i, 'inner', 'innerKey', 'T0' FROM ty),
ent AS (SELECT 'std.cdm.json' AS doc, 'CdsStandard' AS name, 'CdmEntity' AS extends UNION ALL SELECT 'types/T'||i||'.cdm.json', 'T'||i, 'CdsStandard'
  FROM ty
  UNION ALL SELECT 'brands/'||b||'.cdm.json', b, 'base_T'||i||'/T'||i FROM br UNION ALL SELECT 'parts/'||p||'.cdm.json', p, b FROM pa),
names AS (SELECT doc, extends AS wanted, CASE WHEN extends = 'CdsStandard' THEN 'std.cdm.json'
  WHEN extends LIKE 'base%' THEN 'types/'||split_part(extends, '/', 2)||'.cdm.json' ELSE 'brands/'||extends||'.cdm.json' END AS found_doc FROM ent
  WHERE extends <> 'CdmEntity'
  UNION SELECT document, unnest(string_split(regexp_replace(targets, '\.[^,]*', '', 'g'), ',')), NULL FROM direct),
resolved AS (SELECT doc, wanted, CASE WHEN found_doc IS NOT NULL THEN found_doc WHEN wanted = 'T0' THEN 'types/T0.cdm.json'
  WHEN doc = 'types/'||wanted||'.cdm.json' THEN doc END AS found_doc FROM names)"""
_CHOSEN = """used AS (SELECT DISTINCT b FROM pa), ch AS (SELECT 'parts' AS seeds, 'parts/'||p||'.cdm.json' AS document, 'T'||j AS target, CASE
  WHEN j = 0 THEN 'types/T0.cdm.json#T0' END AS import_id, CASE WHEN j = 0 THEN 'types/T0.cdm.json#T0' END AS chosen_id, CASE
  WHEN j = 0 THEN 'import_order' END AS resolved_by FROM pa
  UNION ALL SELECT 'parts', 'parts/'||p||'.cdm.json', 'User', NULL, NULL, NULL FROM pa WHERE k % 10 = 0
  UNION ALL SELECT 'parts', 'brands/'||b||'.cdm.json', 'T0', 'types/T0.cdm.json#T0', 'types/T0.cdm.json#T0', 'import_order' FROM used UNION ALL
  SELECT 'parts', 'brands/'||b||'.cdm.json', 'T1', NULL, NULL, NULL FROM used
  UNION ALL SELECT 'parts+types', 'parts/'||p||'.cdm.json', 'T'||j, CASE WHEN j = 0 THEN 'types/T0.cdm.json#T0' END, CASE WHEN j IN (SELECT i
  FROM ty) THEN 'types/T'||j||'.cdm.json#T'||j END, CASE WHEN j IN (SELECT i FROM ty) THEN 'seed_layer' END FROM pa
  UNION ALL SELECT 'parts+types', 'parts/'||p||'.cdm.json', 'User', NULL, NULL, NULL FROM pa WHERE k % 10 = 0
  UNION ALL SELECT 'parts+types', 'brands/'||b||'.cdm.json', 'T0', 'types/T0.cdm.json#T0', 'types/T0.cdm.json#T0', 'seed_layer' FROM used
  UNION ALL SELECT 'parts+types', 'brands/'||b||'.cdm.json', 'T1', NULL, CASE WHEN 1 IN (SELECT i FROM ty) THEN 'types/T1.cdm.json#T1' END, CASE
  WHEN 1 IN (SELECT i FROM ty) THEN 'seed_layer' END FROM used
  UNION ALL SELECT 'parts+types', 'types/T'||i||'.cdm.json', 'T0', 'types/T0.cdm.json#T0', 'types/T0.cdm.json#T0', 'seed_layer' FROM ty)"""
_ATTRS = """att AS (SELECT 'std.cdm.json' AS doc, 'CdsStandard' AS owner, 'createdBy' AS name, '0.0' AS ord, 'audit' AS group_path,
  'entity' AS data_type, 'createdById' AS fk_name, 'User' AS targets
  UNION ALL SELECT 'std.cdm.json', 'CdsStandard', 'createdOn', '0.1.0', 'audit,stamps', 'dateTime', NULL, ''
  UNION ALL SELECT 'types/T'||i||'.cdm.json', 'T'||i, 'size', '0', '', 'integer', NULL, '' FROM ty UNION ALL SELECT 'types/T'||i||'.cdm.json', 'T'||i,
  'regarding', '1', '', 'entity', 'regardingId', 'T0' FROM ty
  UNION ALL SELECT 'types/T'||i||'.cdm.json', 'T'||i, 'box', '2', '', 'string', NULL, '' FROM ty UNION ALL SELECT 'types/T'||i||'.cdm.json', 'T'||i,
  'ghost', '3', '', 'entity', 'id', '' FROM ty
  UNION ALL SELECT 'brands/'||b||'.cdm.json', b, 'retail', '0', '', 'decimal', NULL, '' FROM br UNION ALL SELECT 'brands/'||b||'.cdm.json', b,
  'regarding', '1', '', 'entity', 'id', 'T0,T1' FROM br
  UNION ALL SELECT 'parts/'||p||'.cdm.json', p, 'size', '0', '', 'integer', NULL, '' FROM pa UNION ALL SELECT 'parts/'||p||'.cdm.json', p, 'alt', '1',
  '', 'entity', 'altId', 'T'||j||'.typeId' FROM pa
  UNION ALL SELECT 'parts/'||p||'.cdm.json', p, 'createdBy', '2', '', 'entity', 'createdById', 'User' FROM pa WHERE k % 10 = 0)"""
_MANIFEST = "m AS (SELECT 'parts/'||p||'.cdm.json' AS document, p AS entity, 'altId' AS fk, 'types/T'||j||'.cdm.json' AS target_doc, 'T'||j AS target_entity, 'typeId' AS target_attribute, 'means.relation' AS traits FROM pa WHERE k % 3 = 0)"
_DERIVED = "de AS (SELECT 'parts/'||p||'.cdm.json' AS document, p AS entity, 'regarding' AS attribute, 'regardingId' AS fk_name, 'T0,T1' AS targets, 'inherited' AS sources, false AS fk_inferred, 'brands/'||b||'.cdm.json#'||b AS inherited_from, 'brands/'||b||'.cdm.json' AS resolve_from FROM pa)"
_DOCS = """docs AS (SELECT 'std.cdm.json' AS path, true AS ok UNION ALL SELECT 'types/T'||i||'.cdm.json', true FROM ty UNION ALL
  SELECT 'brands/_allImports.cdm.json', true UNION ALL SELECT 'brands/'||b||'.cdm.json', true FROM br
  UNION ALL SELECT 'parts/'||p||'.cdm.json', true FROM pa UNION ALL SELECT 'parts/'||p||'.1.0.cdm.json', true FROM pa WHERE k % 50 = 0 UNION ALL
  SELECT 'bad/'||k||'.cdm.json', false FROM pa WHERE k % 500 = 0
  UNION ALL SELECT DISTINCT 'parts/'||b||'.manifest.cdm.json', true FROM pa WHERE k % 3 = 0 UNION ALL SELECT 'notes/N'||k||'.1.cdm.json', true FROM pa
  WHERE k % 100 = 0 UNION ALL SELECT 'notes/_shared.cdm.json', true)"""
_CANON = "ca AS (SELECT document, entity, attribute, CASE WHEN fk_name = 'id' THEN 'regardingId' ELSE fk_name END AS fk_name, false AS fk_inferred, targets FROM direct)"
_EDGES = """ed AS (SELECT 'parts/'||p||'.cdm.json#'||p||'::altId' AS edge_id, 'alt' AS attribute, 'T'||j||'.typeId' AS shown, CASE
  WHEN j = 0 THEN 'types/T0.cdm.json#T0' END AS id, false AS fk_audit, '' AS inherited_from, 'document' AS sources FROM pa
  UNION ALL SELECT 'parts/'||p||'.cdm.json#'||p||'::createdById', 'createdBy', 'User', NULL, true, '', 'document' FROM pa WHERE k % 10 = 0
  UNION ALL SELECT 'parts/'||p||'.cdm.json#'||p||'::regardingId', 'regarding', t, CASE WHEN t = 'T0' THEN 'types/T0.cdm.json#T0' END, false,
  'brands/'||b||'.cdm.json#'||b, 'inherited' FROM pa, (VALUES ('T0'), ('T1')) v(t))"""
_NODES = """ti AS (SELECT DISTINCT i FROM br JOIN used USING (b) UNION SELECT 0 FROM used), no AS (
  SELECT 'parts/'||p||'.cdm.json#'||p AS entity_id, 'brands/'||b||'.cdm.json#'||b AS parent_id FROM pa UNION ALL SELECT 'brands/'||b||'.cdm.json#'||b,
  'types/T'||i||'.cdm.json#T'||i FROM br JOIN used USING (b)
  UNION ALL SELECT 'types/T'||i||'.cdm.json#T'||i, 'std.cdm.json#CdsStandard' FROM ti UNION ALL SELECT 'std.cdm.json#CdsStandard', NULL)"""
_W = "WITH "

QUERIES = {f.__name__: f for f in (
    s1_documents, s1_document_refresh, s2_entity_documents, s3_imports, s4_definitions, s5_manifest_relationships, s6_seeds, s7_index_rebuild, s8_subset, n1_import_closure, n2_n3_resolved_names, n4_unresolved,
    h2_expanded_groups, h3_projected_attributes, r1_extracted, r1_skipped, r2_audit_share, r3_merged, r4_canonical, r5_derived, r6_polymorphic, g3_chosen_targets, g4_deviations, g5_node_set, g6_document_edges,
    g6_unresolved_targets, g8_document_summary, c7_document_chunks,
)}

ORACLE_SQL = {
    "s1_documents": f"{_W}{BASE}, {_DOCS} SELECT *, CASE WHEN NOT ok THEN 'not JSON' END AS reason FROM docs",
    "s1_document_refresh": f"{_W}{BASE}, {_DOCS} SELECT path, CASE WHEN NOT ok THEN 'not JSON' END AS reason, CAST(CASE WHEN path LIKE 'brands/%' THEN 1 ELSE 0 END AS BIGINT) AS read_in FROM docs",
    "s2_entity_documents": f"{_W}{BASE}, {_DOCS} SELECT path FROM docs WHERE path NOT LIKE '%.1.0.cdm.json' AND path NOT LIKE '%.manifest.%' AND path NOT LIKE '%/_allImports.cdm.json'",
    "s3_imports": f"""{_W}{BASE} SELECT 'types/T'||i||'.cdm.json' AS doc, 0 AS ord, 'std.cdm.json' AS target_doc, CAST(NULL AS VARCHAR) AS moniker
    FROM ty UNION ALL SELECT 'types/T'||i||'.cdm.json', 1, 'types/T0.cdm.json', NULL FROM ty WHERE i > 0
      UNION ALL SELECT 'brands/_allImports.cdm.json', 0, 'std.cdm.json', NULL UNION ALL SELECT 'brands/_allImports.cdm.json', i + 1,
      'types/T'||i||'.cdm.json', 'base_T'||i FROM ty
      UNION ALL SELECT 'brands/'||b||'.cdm.json', 0, 'brands/_allImports.cdm.json', NULL FROM br UNION ALL SELECT 'brands/'||b||'.cdm.json', 1,
      'types/T0.cdm.json', NULL FROM br
      UNION ALL SELECT 'parts/'||p||v||'.cdm.json', 0, 'brands/'||b||'.cdm.json', NULL FROM pa, (VALUES (''), ('.1.0')) x(v) WHERE v = ''
      OR k % 50 = 0 UNION ALL SELECT 'parts/'||p||v||'.cdm.json', 1, 'std.cdm.json', NULL FROM pa, (VALUES (''), ('.1.0')) x(v) WHERE v = ''
      OR k % 50 = 0""",
    "s4_definitions": f"{_W}{BASE} SELECT doc, name, extends, 'entity' AS kind FROM ent UNION ALL SELECT 'std.cdm.json', g, NULL, 'group' FROM (VALUES ('audit'), ('stamps')) v(g)",
    "s5_manifest_relationships": f"{_W}{BASE}, {_MANIFEST} SELECT * FROM m",
    "s6_seeds": f"{_W}{BASE} SELECT 'parts/'||p||'.cdm.json' AS doc, p AS name FROM pa",
    "s7_index_rebuild": f"{_W}{BASE} SELECT doc||'#'||name AS chunk_id, split_part(doc, '/', 1) AS chunk_type, name||' extends '||extends AS text, 'hashing-128' AS model, 'built,opened,built' AS done FROM ent",
    "s8_subset": f"{_W}{BASE}, {_DOCS}, {_CHOSEN}, {_EDGES}, {_NODES} SELECT path, (SELECT count(*) FROM no) AS n_nodes, (SELECT count(DISTINCT edge_id) FROM ed) AS n_edges, (SELECT count(*) FROM ed WHERE id IS NULL) AS n_unresolved, true AS verified FROM docs WHERE ok AND path NOT LIKE '%.1.0.cdm.json' AND path NOT LIKE '%.manifest.%' AND path NOT LIKE 'notes/%'",
    "n1_import_closure": f"""{_W}{BASE} SELECT 'std.cdm.json' AS root, 'std.cdm.json' AS doc, CAST(0 AS BIGINT) AS rank UNION ALL
    SELECT 'brands/_allImports.cdm.json', d, r FROM (VALUES ('brands/_allImports.cdm.json', 0), ('std.cdm.json', 1)) v(d, r)
      UNION ALL SELECT path, path, 0 FROM (SELECT 'notes/N'||k||'.1.cdm.json' AS path FROM pa WHERE k % 100 = 0 UNION ALL
      SELECT 'notes/_shared.cdm.json') UNION ALL SELECT 'types/T'||i||'.cdm.json', 'types/T'||i||'.cdm.json', 0 FROM ty UNION ALL
      SELECT 'types/T'||i||'.cdm.json', 'std.cdm.json', 1 FROM ty UNION ALL SELECT 'types/T'||i||'.cdm.json', 'types/T0.cdm.json', 2 FROM ty
      WHERE i > 0
      UNION ALL SELECT 'brands/'||b||'.cdm.json', coalesce(d, 'brands/'||b||'.cdm.json'), r FROM br, (VALUES (NULL, 0),
      ('brands/_allImports.cdm.json', 1), ('std.cdm.json', 2), ('types/T0.cdm.json', 3)) v(d, r)
      UNION ALL SELECT 'parts/'||p||'.cdm.json', CASE r WHEN 0 THEN 'parts/'||p||'.cdm.json' WHEN 1 THEN 'brands/'||b||'.cdm.json' ELSE d END, r
      FROM pa, (VALUES (NULL, 0), (NULL, 1), ('brands/_allImports.cdm.json', 2), ('std.cdm.json', 3), ('types/T0.cdm.json', 4)) v(d, r)""",
    "n2_n3_resolved_names": f"{_W}{BASE} SELECT DISTINCT doc, wanted, found_doc, split_part(wanted, '/', -1) AS found_name FROM resolved WHERE found_doc IS NOT NULL",
    "n4_unresolved": f"{_W}{BASE} SELECT DISTINCT doc, wanted FROM resolved WHERE found_doc IS NULL UNION ALL SELECT 'types/T'||i||'.cdm.json', 'lostGroup' FROM ty",
    "h2_expanded_groups": f"{_W}{BASE}, {_ATTRS} SELECT doc, owner, name, ord, group_path, doc AS home FROM att",
    "h3_projected_attributes": f"{_W}{BASE}, {_ATTRS} SELECT doc, owner, name, data_type, fk_name, targets, CASE WHEN fk_name IS NOT NULL AND targets = '' THEN 'reference' WHEN fk_name IS NOT NULL THEN 'reference to '||replace(regexp_replace(targets, '\\.[^,]*', '', 'g'), ',', '/') ELSE data_type END AS label FROM att",
    "r1_extracted": f"{_W}{BASE} SELECT * FROM direct",
    "r1_skipped": f"{_W}{BASE} SELECT 'types/T'||i||'.cdm.json' AS document, 'T'||i AS entity, CAST(1 AS BIGINT) AS n FROM ty",
    "r2_audit_share": f"{_W}{BASE} SELECT split_part(document, '/', 1) AS folder, count(*) AS n, count(*) FILTER (fk_name = 'createdById') AS n_audit, round(avg(CASE WHEN fk_name = 'createdById' THEN 1.0 ELSE 0 END), 6) AS share FROM direct GROUP BY 1",
    "r3_merged": f"""{_W}{BASE}, {_CANON}, {_DERIVED}, {_MANIFEST} SELECT document, entity, fk_name, targets, CASE WHEN document IN (SELECT document
    FROM m) AND fk_name = 'altId' THEN 'means.relation' ELSE '' END AS traits, CASE WHEN document IN (SELECT document FROM m)
    AND fk_name = 'altId' THEN 'document,manifest' ELSE 'document' END AS sources, fk_inferred, attribute, '' AS inherited_from,
    document AS resolve_from FROM ca
      UNION ALL SELECT document, entity, fk_name, targets, '', sources, fk_inferred, attribute, inherited_from, resolve_from FROM de""",
    "r4_canonical": f"{_W}{BASE}, {_CANON} SELECT document, entity, attribute, fk_name, fk_inferred FROM ca",
    "r5_derived": f"{_W}{BASE}, {_DERIVED} SELECT * FROM de",
    "r6_polymorphic": f"{_W}{BASE} SELECT document, entity, attribute, targets LIKE '%,%' AS is_polymorphic FROM direct",
    "g3_chosen_targets": f"{_W}{BASE}, {_CHOSEN} SELECT * FROM ch",
    "g4_deviations": f"{_W}{BASE}, {_CHOSEN} SELECT target, count(*) AS n FROM ch WHERE seeds = 'parts+types' AND chosen_id IS NOT NULL AND chosen_id IS DISTINCT FROM import_id GROUP BY 1",
    "g5_node_set": f"{_W}{BASE}, {_CHOSEN}, {_NODES} SELECT entity_id, parent_id FROM no",
    "g6_document_edges": f"""{_W}{BASE}, {_CHOSEN}, {_EDGES} SELECT edge_id, split_part(edge_id, '::', 1) AS from_id, attribute, split_part(edge_id,
    '::', 2) AS fk_name, string_agg(shown||'>'||coalesce(id, '?')||':import_order', ',' ORDER BY shown) AS targets,
      any_value(fk_audit) AS is_audit, count(*) > 1 AS is_polymorphic, false AS fk_inferred, any_value(inherited_from) AS inherited_from,
      any_value(sources) AS sources FROM ed GROUP BY 1, 3""",
    "g6_unresolved_targets": f"{_W}{BASE}, {_CHOSEN}, {_EDGES} SELECT edge_id, split_part(shown, '.', 1) AS name FROM ed WHERE id IS NULL",
    "g8_document_summary": f"""{_W}{BASE}, {_CHOSEN}, {_EDGES}, {_NODES}, e AS (SELECT edge_id, any_value(fk_audit) AS a, count(*) > 1 AS p FROM ed
    GROUP BY 1)
      SELECT 'nodes:'||CASE WHEN contains(entity_id, '/') THEN split_part(entity_id, '/', 1) ELSE 'root' END AS metric, count(*) AS value FROM no
      GROUP BY 1 UNION ALL SELECT 'nodes', count(*) FROM no UNION ALL SELECT 'edges', count(*) FROM e
      UNION ALL SELECT 'audit_edges', count(*) FROM e WHERE a UNION ALL SELECT 'polymorphic_edges', count(*) FROM e WHERE p UNION ALL
      SELECT 'unresolved_targets', count(*) FROM ed WHERE id IS NULL""",
    "c7_document_chunks": f"""{_W}{BASE} SELECT 'rel:parts/'||p||'.cdm.json#'||p||'::altId' AS chunk_id,
    p||' has a many-to-one relationship to T'||j||': each '||p||' refers to one T'||j||', via attribute alt (foreign key altId). Reverse: a T'||j||' can have many '||p||' records.' AS text FROM pa
      UNION ALL SELECT 'rel:parts/'||p||'.cdm.json#'||p||'::regardingId',
      p||' has a many-to-one polymorphic relationship via attribute regarding (foreign key regardingId): regarding can refer to T0 or T1. Each '||p||' record refers to one record of one of these types. Reverse: a T0 or T1 can be referred to by many '||p||' records. This relationship is inherited from '||b||' (brands).' FROM pa""",
}
