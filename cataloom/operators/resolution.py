"""Names of schema documents resolved through imports, and attributes flattened out of nested groups.

The document helper (``flattened``) is the only Python here: it walks one document's JSON and emits ordered rows; all
matching of names is joins.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cataloom.sources.shared import materialize

ROOT = "CdmEntity"
#: Name of a foreign key that stands for the one of an overridden declaration.
PLACEHOLDER = "id"
TARGETS = "array<struct<entity:string,attribute:string>>"
FLAT = (
    "doc string, owner_kind string, owner string, ord array<int>, kind string, name string, data_type string, description string, fk_name string, "
    f"fk_targets {TARGETS}, is_fk boolean, group_path array<string>"
)
NODES = f"document string, entity string, ord int, attribute string, fk_name string, targets {TARGETS}, skipped boolean"
TARGET = pa.list_(pa.struct([("entity", pa.string()), ("attribute", pa.string())]))
IDENTIFIER = "is.identifiedBy"
#: Documents of more imports are looked into once for all who ask.
HUB = 1000


def _edges(imports: DataFrame) -> DataFrame:
    """at, ord, next: unaliased imports of other documents; of several imports of one document the first."""
    plain = imports.where(F.col("moniker").isNull() & (F.col("doc") != F.col("target_doc")))
    return plain.groupBy(F.col("doc").alias("at"), F.col("target_doc").alias("next")).agg(F.min("ord").alias("ord"))


def _smallest(rounds: DataFrame, *keys: str) -> DataFrame:
    """The smallest path of each key over the rounds so far; rounds are kept as they were written, and none is rewritten."""
    return rounds.groupBy(*keys).agg(F.min("path").alias("before"))


def closure(roots: DataFrame, imports: DataFrame) -> DataFrame:
    """root, doc, rank: the documents visible from each root through unaliased imports, depth first in the order of declaration.

    The first visit of a depth-first walk is the smallest path of import ordinals. Each round goes on only from documents
    whose smallest path got smaller, so that a round has one row per (root, doc) at most; a path round a cycle is longer than
    the one it comes back to, so it is never smaller, and the rounds end.
    """
    plain = _edges(imports)
    rounds = frontier = materialize(
        roots.select(F.col("doc").alias("root")).distinct().select(
            "root", F.col("root").alias("doc"), F.array().cast("array<int>").alias("path")
        ),
        "closure"
    )
    while True:
        step = frontier.join(plain, F.col("doc") == F.col("at")).groupBy("root", F.col("next").alias("doc")).agg(
            F.min(F.concat("path", F.array("ord"))).alias("path")
        )
        known = _smallest(rounds, "root", "doc")
        frontier = materialize(
            step.join(known, ["root", "doc"], "left").where(F.col("before").isNull() | (F.col("path") < F.col("before"))).drop("before"),
            "closure-step"
        )
        if frontier.isEmpty():
            break
        rounds = rounds.unionByName(frontier)
    best = _smallest(rounds, "root", "doc")
    return best.select("root", "doc", (F.row_number().over(Window.partitionBy("root").orderBy("before")) - 1).cast("long").alias("rank"))


def _hub_answers(plain: DataFrame, hubs: DataFrame, holders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(at of the shared hubs; at, key, found): the first holder of each key behind each hub, whoever asks.

    What a hub finds is the same for all who come to it only if it doesn't lie on a cycle: else the walk may have come through
    documents that the hub would visit itself. Hubs on cycles are searched like other documents.
    """
    behind = materialize(closure(hubs.select(F.col("at").alias("doc")), plain.select(
        F.col("at").alias("doc"), "ord", F.col("next").alias("target_doc"), F.lit(None).cast("string").alias("moniker")
    )), "hub-closures")
    back = behind.join(plain, (F.col("doc") == F.col("at")) & (F.col("root") == F.col("next"))).select(F.col("root").alias("hub"))
    shared = materialize(hubs.select("at").join(back, F.col("at") == F.col("hub"), "left_anti"), "hubs")
    answers = behind.join(shared, F.col("root") == F.col("at"), "left_semi").join(holders, "doc").groupBy(F.col("root").alias("at"), "key").agg(
        F.min_by("doc", "rank").alias("found")
    )
    return shared, materialize(answers, "hub-answers")


def _graph(imports: DataFrame, hub: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges of unaliased imports, and the documents of more than ``hub`` of them, if there are any."""
    plain = materialize(_edges(imports), "import-edges")
    large = plain.groupBy("at").count().where(F.col("count") > hub).select("at")
    return plain, None if large.isEmpty() else materialize(large, "large-documents")


def first_holders(asked: DataFrame, imports: DataFrame, holders: DataFrame, hub: int = HUB) -> DataFrame:
    """start, key, found: the first document that holds the key on the depth-first walk from a document over unaliased imports.

    asked has (start, key), holders (doc, key). Keys that nothing holds and keys that the start holds itself are settled without
    a walk. The others walk on together, a round per import, a row per (start, key, document) at most: a walk ends where the key
    is held, and what lies after a holder that was found already, in the walk's order, is left. Documents of more than ``hub``
    imports aren't walked into by each who asks: what lies behind them is listed once, and all who come there read its answers.
    Missing starts or keys have no row.
    """
    return _first_holders(asked, *_graph(imports, hub), holders)


def _first_holders(asked: DataFrame, plain: DataFrame, large: DataFrame | None, holders: DataFrame) -> DataFrame:
    asked = asked.select("start", "key").where("start is not null and key is not null").distinct()
    holders = materialize(holders.select("doc", "key").distinct().join(asked, "key", "left_semi"), "holders")
    here = holders.select(F.col("doc").alias("at"), "key", F.col("doc").alias("found"))
    shared = None
    if large is not None:
        # A hub that asks for a name itself reads its own answer like the others.
        shared, answers = _hub_answers(plain, large, holders)
        here = here.join(shared, "at", "left_anti").unionByName(answers)
    step = asked.join(holders.select("key").distinct(), "key").select("start", "key", F.col("start").alias("at"), F.array().cast("array<int>").alias("path"))
    found = rounds = None
    while True:
        step = step.join(here, ["at", "key"], "left")
        if shared is not None:
            step = step.join(shared.withColumn("closed", F.lit(True)), "at", "left").where("found is not null or closed is null").drop("closed")
        step = materialize(step, "names-step")
        hits = step.where("found is not null").select("start", "key", "path", "found")
        found = hits if found is None else found.unionByName(hits)
        rounds = step.drop("found") if rounds is None else rounds.unionByName(step.drop("found"))
        open_ = step.where("found is null").drop("found")
        if open_.isEmpty():
            break
        first = found.groupBy("start", "key").agg(F.min("path").alias("until"))
        further = open_.join(plain, "at").select("start", "key", F.col("next").alias("at"), F.concat("path", F.array("ord")).alias("path"))
        further = further.join(first, ["start", "key"], "left").where("until is null or path < until").drop("until")
        # One grouping finds the smallest path of this round and of those before.
        both = further.withColumn("new", F.lit(True)).unionByName(rounds.withColumn("new", F.lit(False)))
        step = both.groupBy("start", "key", "at").agg(
            F.min(F.when(F.col("new"), F.col("path"))).alias("path"), F.min(F.when(~F.col("new"), F.col("path"))).alias("before")
        ).where("path is not null and (before is null or path < before)").drop("before")
    return found.groupBy("start", "key").agg(F.min_by("found", "path").alias("found"))


def resolve(requests: DataFrame, imports: DataFrame, definitions: DataFrame, hub: int = HUB) -> DataFrame:
    """(doc, wanted) -> found_doc, found_name; null where nothing defines the name.

    ``Name`` is looked up in the document, then in what it imports, in order. ``moniker/Name`` first finds the document behind
    the first such moniker that is seen from there, and then looks only there and in what that imports. Names are searched for
    on demand: no table of all visible documents is made.
    """
    wanted = materialize(requests.select("doc", "wanted").distinct(), "wanted")
    aliased = wanted.where(F.contains("wanted", F.lit("/"))).select(
        "doc", "wanted", F.substring_index("wanted", "/", 1).alias("moniker"),
        F.expr("substring(wanted, instr(wanted, '/') + 1)").alias("name")
    )
    asked = wanted.where(~F.contains("wanted", F.lit("/"))).select(
        "doc", "wanted", F.col("wanted").alias("name"), F.col("doc").alias("start")
    )
    graph = _graph(imports, hub)
    if not aliased.isEmpty():
        named = imports.where("moniker is not null").groupBy(F.col("doc").alias("holder"), "moniker").agg(F.min_by("target_doc", "ord").alias("start"))
        via = _first_holders(
            aliased.select(F.col("doc").alias("start"), F.col("moniker").alias("key")), *graph,
            named.select(F.col("holder").alias("doc"), F.col("moniker").alias("key"))
        ).select(F.col("start").alias("doc"), F.col("key").alias("moniker"), F.col("found").alias("holder"))
        asked = materialize(
            asked.unionByName(aliased.join(via, ["doc", "moniker"]).join(named, ["holder", "moniker"]).select("doc", "wanted", "name", "start")), "asked"
        )
    first = _first_holders(
        asked.select("start", F.col("name").alias("key")), *graph, definitions.select("doc", F.col("name").alias("key"))
    ).select("start", F.col("key").alias("name"), F.col("found").alias("found_doc"))
    hit = asked.join(first, ["start", "name"]).select("doc", "wanted", "found_doc", F.col("name").alias("found_name"))
    return wanted.join(hit, ["doc", "wanted"], "left")


def _identifier(entity: dict) -> str | None:
    """The target's attribute that an entity node names as its identifier."""
    for trait in entity.get("appliedTraits") or []:
        if isinstance(trait, dict) and trait.get("traitReference") == IDENTIFIER:
            named = [x for x in (trait.get("arguments") or [])[:1] if isinstance(x, str)]
            if named:
                return named[0].split("/")[-1]
    return None


def _targets(entity: object) -> set[tuple[str, str | None]]:
    """(entity, attribute) an entity node refers to: one, or those of an inline entity's attributes."""
    reference = entity.get("entityReference") if isinstance(entity, dict) else None
    if isinstance(reference, str):
        return {(reference, _identifier(entity))}
    members = (reference.get("hasAttributes") or []) if isinstance(reference, dict) else []
    return set().union(*(_targets(m.get("entity")) for m in members if isinstance(m, dict)), set())


def _sorted_targets(entity: object) -> list[dict]:
    return [{"entity": e, "attribute": a} for e, a in sorted(_targets(entity), key=lambda t: (t[0], t[1] or ""))]


def _fk_nodes(items: list) -> Iterator[tuple[str | None, str | None, list[dict]]]:
    """(attribute, fk_name, targets) of every node at any depth that refers to an entity by a key; a missing key name is the placeholder's."""
    left = list(reversed(items))
    while left:
        node = left.pop()
        if isinstance(node, dict):
            entity, guidance = node.get("entity"), node.get("resolutionGuidance")
            if isinstance(entity, dict) and "entityReference" in entity and isinstance(guidance, dict) and "entityByReference" in guidance:
                key = (guidance["entityByReference"] or {}).get("foreignKeyAttribute") or {}
                name = node.get("name")
                yield name if isinstance(name, str) and name else None, key.get("name") or PLACEHOLDER, _sorted_targets(entity)
            left.extend(reversed(list(node.values())))
        elif isinstance(node, list):
            left.extend(reversed(node))


def _member(member: object, order: list[int], groups: list[str]) -> Iterator[tuple]:
    """Rows (ord, kind, name, data_type, description, fk_name, fk_targets, is_fk, group_path) of a member of an attribute list."""
    if isinstance(member, str):
        yield order, "group", member, None, None, None, None, False, groups
        return
    if not isinstance(member, dict):
        return
    if "attributeGroupReference" in member:
        group = member["attributeGroupReference"]
        if isinstance(group, dict) and isinstance(group.get("members"), list):
            path = [*groups, group["attributeGroupName"]] if isinstance(group.get("attributeGroupName"), str) else groups
            for i, inner in enumerate(group["members"]):
                yield from _member(inner, [*order, i], path)
        else:
            name = group.get("attributeGroupName") if isinstance(group, dict) else group
            if isinstance(name, str):
                yield order, "group", name, None, None, None, None, False, groups
        return
    if not isinstance(member.get("name"), str):
        return
    kind = member.get("dataType")
    kind = kind.get("dataTypeReference") if isinstance(kind, dict) else kind
    guidance = member.get("resolutionGuidance")
    by_reference = guidance.get("entityByReference") if isinstance(guidance, dict) else None
    is_fk = isinstance(by_reference, dict) and isinstance(member.get("entity"), dict)
    fk = None
    if is_fk:
        named = by_reference.get("foreignKeyAttribute")
        fk = named.get("name") if isinstance(named, dict) and isinstance(named.get("name"), str) else PLACEHOLDER
    if kind is None and isinstance(member.get("entity"), dict):
        kind = "entity"
    kind = kind if isinstance(kind, str) else None
    text = member.get("description")
    yield order, "attribute", member["name"], kind, text if isinstance(text, str) else None, fk, _sorted_targets(member["entity"]) if is_fk else None, is_fk, groups


def flattened(entities: DataFrame, groups: DataFrame) -> DataFrame:
    """Ordered member rows of entities and named groups: attributes, and references to named groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (
            pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.string(), pa.string(),
            pa.string(), TARGET, pa.bool_(), pa.list_(pa.string())
        )
        names = [x.split()[0] for x in FLAT.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for doc, owner_kind, owner, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                whole = json.loads(text)
                for i, member in enumerate(whole.get("hasAttributes" if owner_kind == "entity" else "members") or []):
                    for order, kind, name, data_type, description, fk, targets, is_fk, path in _member(member, [i], []):
                        rows.append((doc, owner_kind, owner, order, kind, name, data_type, description, fk, targets, is_fk, path))
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    both = entities.select("doc", F.lit("entity").alias("k"), "name", "json").unionByName(
        groups.select("doc", F.lit("group").alias("k"), "name", "json")
    )
    return both.mapInArrow(run, FLAT)


def fk_nodes(entities: DataFrame) -> DataFrame:
    """document, entity, ord, attribute, fk_name, targets, skipped: every foreign key written anywhere in an entity's attributes, in order.

    Skipped ones have no target, or neither a key's name nor one of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = (
            pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), TARGET, pa.bool_()
        ), [x.split()[0] for x in NODES.split(", ")]
        for batch in batches:
            rows = []
            for doc, owner, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for k, (attribute, fk, targets) in enumerate(_fk_nodes(json.loads(text).get("hasAttributes") or [])):
                    rows.append((doc, owner, k, attribute, fk, targets, not targets or attribute is None and fk == PLACEHOLDER))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names)

    return entities.select("doc", "name", "json").mapInArrow(run, NODES)


def expanded(flat: DataFrame, imports: DataFrame, groups: DataFrame) -> DataFrame:
    """Attributes of entities (home: the document in which they are written) with named groups put in, transitively; a group that is met again on its own path is skipped.

    Each group's members are joined in where it is referred to; the ordinal paths keep the order of declaration.
    """
    columns = ("doc", "owner", "ord", "home", "name", "data_type", "description", "fk_name", "fk_targets", "is_fk", "group_path")
    references = flat.where("kind = 'group'").select("doc", F.col("name").alias("wanted"))
    found = materialize(resolve(references, imports, groups).where("found_doc is not null"), "group-names")
    members = flat.where("owner_kind = 'group'").select(
        F.col("doc").alias("found_doc"), F.col("owner").alias("found_name"), F.col("ord").alias("m_ord"), "kind", "name",
        "data_type", "description", "fk_name", "fk_targets", "is_fk", F.col("group_path").alias("m_path")
    )
    own = flat.where("owner_kind = 'entity'").withColumn("home", F.col("doc")).withColumn("seen", F.array().cast("array<string>"))
    done = own.where("kind = 'attribute'").select(*columns)
    open_ = own.where("kind = 'group'").select("doc", "owner", "ord", "home", "seen", "group_path", F.col("name").alias("wanted"))
    while True:  # seen ends every cycle
        hit = open_.join(
            found.withColumnRenamed("doc", "home"), ["home", "wanted"]
        ).withColumn("id", F.concat("found_doc", F.lit("#"), "found_name")).where(~F.array_contains("seen", F.col("id")))
        inside = hit.join(members, ["found_doc", "found_name"]).select(
            "doc", "owner", F.concat("ord", "m_ord").alias("ord"), F.col("found_doc").alias("home"), F.concat("seen", F.array("id")).alias("seen"), F.concat(
                "group_path", F.array("found_name"), "m_path"
            ).alias("group_path"),
            "kind", "name", "data_type", "description", "fk_name", "fk_targets", "is_fk",
        )
        inside = materialize(inside, "group-members")
        done = done.unionByName(inside.where("kind = 'attribute'").select(*columns))
        open_ = inside.where("kind = 'group'").select("doc", "owner", "ord", "home", "seen", "group_path", F.col("name").alias("wanted"))
        if open_.isEmpty():
            break
    return done


def parents(entities: DataFrame, imports: DataFrame) -> DataFrame:
    """entity_id, parent_id, wanted: the resolved parent; null for the built-in root and for names that nothing defines."""
    asked = entities.where(F.col("extends").isNotNull() & (F.col("extends") != ROOT))
    found = resolve(asked.select("doc", F.col("extends").alias("wanted")), imports, entities)
    joined = entities.join(found.withColumnRenamed("wanted", "extends"), ["doc", "extends"], "left")
    return joined.select(
        F.concat("doc", F.lit("#"), "name").alias("entity_id"),
        F.concat("found_doc", F.lit("#"), "found_name").alias("parent_id"),
        F.when(F.col("extends") != ROOT, F.col("extends")).alias("wanted")
    )
