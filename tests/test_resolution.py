"""Small corpora of schema documents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cataloom.operators import inheritance as H
from cataloom.operators import relationships as R
from cataloom.operators import resolution as N
from cataloom.sources import adapters as A
from cataloom.sources import schema_documents as S
from cataloom.sources import shared


def fk(name, target, column="xId"):
    guidance = {"entityByReference": {"foreignKeyAttribute": {"name": column}} if column else {}}
    return {"name": name, "entity": {"entityReference": target}, "resolutionGuidance": guidance}


CORPUS = {
    "std.cdm.json": {"imports": [], "definitions": [
        {"attributeGroupName": "audit", "members": [{"name": "createdBy", **fk("createdBy", "User", "createdById")}, "stamps"]},
        {"attributeGroupName": "stamps", "members": [{"name": "createdOn", "dataType": "dateTime"}, "audit"]},
        {"entityName": "CdsStandard", "extendsEntity": "CdmEntity", "hasAttributes": [{"attributeGroupReference": "audit"}]},
    ]},
    "base/Thing.cdm.json": {
        "imports": [{"corpusPath": "/std.cdm.json"}],
        "definitions": [
            {
                "entityName": "Thing", "extendsEntity": "CdsStandard",
                "hasAttributes": [{"name": "label", "dataType": "string"}, fk("regarding", "Thing", "regardingId")]
            }
        ]
    },
    "hub.cdm.json": {"imports": [{"corpusPath": "base/Thing.cdm.json", "moniker": "base_Thing"}], "definitions": []},
    "app/Thing.cdm.json": {
        "imports": [{"corpusPath": "../hub.cdm.json"}, {"corpusPath": "/std.cdm.json"}],
        "definitions": [
            {
                "entityName": "Thing", "extendsEntity": {"entityReference": "base_Thing/Thing"},
                "hasAttributes": [fk("regarding", "Thing", None)]
            }
        ]
    },
    "app/Leaf.cdm.json": {"imports": [{"corpusPath": "Thing.cdm.json"}, {"corpusPath": "Leaf.cdm.json"}], "definitions": [
        {"entityName": "Leaf", "hasAttributes": []},
        {
            "entityName": "Leaf", "extendsEntity": "Thing",
            "hasAttributes": [
                {"name": "label", "dataType": "string"}, {"name": "createdBy", "dataType": "string"},
                {
                    "name": "many",
                    "entity": {"entityReference": {"entityName": "any", "hasAttributes": [fk("a", "A"), fk("b", "B"), fk("c", "A")]}},
                    "resolutionGuidance": {"entityByReference": {}}
                },
                {"name": "plain", "entity": {"entityReference": "A"}}
            ]
        },
        {
            "entityName": "Orphan", "extendsEntity": "Nowhere",
            "hasAttributes": [{"name": "x", "dataType": {"dataTypeReference": "integer"}}]
        }, {"other": 1},
    ]},
    "app/Leaf.1.5.cdm.json": {"imports": [], "definitions": []},
    "app/_allImports.cdm.json": {"imports": [], "definitions": []},
    "app/m.manifest.cdm.json": {
        "relationships": [{"fromEntity": "Leaf.cdm.json/Leaf", "fromEntityAttribute": "labelId", "toEntity": "/base/Thing.cdm.json/Thing"}]
    },
}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(k, json.dumps(v)) for k, v in CORPUS.items()] + [
        ("bad.cdm.json", '{"imports": ['), ("list.cdm.json", "[1]"), ("empty.cdm.json", "")
    ]
    good, bad = S.parsed(spark.createDataFrame(rows, "path string, json string"))
    entities, groups = S.definitions(good)
    imports = S.imports(good)
    closures = N.closure(good.select(F.col("path").alias("doc")), imports)
    return {"good": good, "bad": bad, "entities": entities, "groups": groups, "imports": imports, "closures": closures}


def test_malformed_documents_go_to_quarantine(corpus):
    assert {r.path for r in corpus["bad"].collect()} == {"bad.cdm.json", "list.cdm.json", "empty.cdm.json"}


def test_reading_a_tree(spark, tmp_path):
    (tmp_path / "tree" / "a").mkdir(parents=True)
    (tmp_path / "tree" / "a" / "x.cdm.json").write_text('{"imports":\n []}')
    assert [tuple(r) for r in S.read_tree(spark, str(tmp_path / "tree")).collect()] == [("a/x.cdm.json", '{"imports":\n []}', None)]


def test_entity_documents_and_seeds(corpus):
    assert {r.path for r in S.entity_documents(corpus["good"]).collect()} == {
        "std.cdm.json", "base/Thing.cdm.json", "hub.cdm.json", "app/Thing.cdm.json", "app/Leaf.cdm.json"
    }
    assert {(r.doc, r.name) for r in S.seeds(corpus["entities"], "app").collect()} == {
        ("app/Thing.cdm.json", "Thing"), ("app/Leaf.cdm.json", "Leaf"), ("app/Leaf.cdm.json", "Orphan")
    }


def test_manifest_paths(corpus):
    row = S.manifest_relationships(corpus["good"]).first()
    assert (row.document, row.entity, row.target_doc, row.target_entity) == ("app/Leaf.cdm.json", "Leaf", "base/Thing.cdm.json", "Thing")


def test_closure_is_depth_first_and_ends_on_cycles(corpus):
    found = {r.doc: r["rank"] for r in corpus["closures"].where("root = 'app/Leaf.cdm.json'").collect()}
    assert found == {"app/Leaf.cdm.json": 0, "app/Thing.cdm.json": 1, "hub.cdm.json": 2, "std.cdm.json": 3}


def test_names_and_monikers(spark, corpus):
    asked = spark.createDataFrame(
        [
            ("app/Leaf.cdm.json", "Thing"), ("app/Leaf.cdm.json", "base_Thing/Thing"), ("app/Leaf.cdm.json", "None"),
            ("base/Thing.cdm.json", "Thing"), ("app/Leaf.cdm.json", "nope/Thing")
        ],
        "doc string, wanted string"
    )
    found = {(r.doc, r.wanted): r.found_doc for r in N.resolve(asked, corpus["imports"], corpus["entities"]).collect()}
    assert found == {
        ("app/Leaf.cdm.json", "Thing"): "app/Thing.cdm.json", ("app/Leaf.cdm.json", "base_Thing/Thing"): "base/Thing.cdm.json",
        ("app/Leaf.cdm.json", "None"): None, ("base/Thing.cdm.json", "Thing"): "base/Thing.cdm.json",
        ("app/Leaf.cdm.json", "nope/Thing"): None
    }


def test_groups_expand_once_around_a_cycle(corpus):
    e = N.expanded(N.flattened(corpus["entities"], corpus["groups"]), corpus["imports"], corpus["groups"])
    found = {r.name: r.group_path for r in e.where("owner = 'CdsStandard'").collect()}
    assert found == {"createdBy": ["audit"], "createdOn": ["audit", "stamps"]}


def test_inheritance_override_and_placeholder(corpus):
    flat = N.flattened(corpus["entities"], corpus["groups"])
    own = N.expanded(flat, corpus["imports"], corpus["groups"]).select(
        F.concat("doc", F.lit("#"), "owner").alias("entity_id"), "ord", "home", "name", "data_type", "fk_name", "fk_targets",
        "description"
    )
    parents = N.parents(corpus["entities"], corpus["imports"])
    chain = H.chains(parents)
    leaf = "app/Leaf.cdm.json#Leaf"
    assert [
        r.ancestor_id for r in chain.where(F.col("entity_id") == leaf).orderBy("depth").collect()
    ] == [leaf, "app/Thing.cdm.json#Thing", "base/Thing.cdm.json#Thing", "std.cdm.json#CdsStandard"]
    std = F.col("ancestor_id") == "std.cdm.json#CdsStandard"
    standard = chain.where(std).select("entity_id").withColumn(
        "name", F.explode(F.array(*map(F.lit, ("createdBy", "createdOn", "createdById"))))
    )
    found = H.resolved(own, chain, standard, std).where(F.col("entity_id") == leaf).orderBy("pos").collect()
    assert [(r.name, r.origin, r.inlined) for r in found] == [
        ("createdOn", "standard", False), ("regarding", "inherited", False), ("label", "own", False),
        ("createdBy", "standard", True), ("many", "own", False), ("plain", "own", False)
    ]
    assert next(r for r in found if r.name == "regarding").fk_name == "regardingId"
    assert [r.wanted for r in parents.where("parent_id is null and wanted is not null").collect()] == ["Nowhere"]


def test_relationships(spark, corpus):
    direct = R.extracted(N.fk_nodes(corpus["entities"]))
    found = {(r.document, r.attribute): (r.fk_name, [t.entity for t in r.targets]) for r in direct.collect()}
    assert found == {
        ("base/Thing.cdm.json", "regarding"): ("regardingId", ["Thing"]), ("app/Thing.cdm.json", "regarding"): ("id", ["Thing"]),
        ("app/Leaf.cdm.json", "many"): ("id", ["A", "B"])
    } | {("app/Leaf.cdm.json", n): ("xId", [t]) for n, t in zip("abc", "ABA")}
    base = spark.createDataFrame(
        [("app/Thing.cdm.json", "Thing", "regarding", "regardingId")],
        "document string, entity string, attribute string, base_fk string"
    )
    named = {(r.document, r.attribute): (r.fk_name, r.fk_inferred) for r in R.canonical(direct, base).collect()}
    assert named["app/Thing.cdm.json", "regarding"] == ("regardingId", False) and named["app/Leaf.cdm.json", "many"] == ("manyId", True)


def test_merge_and_seed_rule(spark):
    a = spark.createDataFrame(
        [("d", "e", "f", [("X", "k")], ["t1"], ["s1"], True, "", None, "d")],
        f"document string, entity string, fk_name string, targets {R.TARGETS}, traits array<string>, sources array<string>, fk_inferred boolean, attribute string, inherited_from string, resolve_from string"
    )
    b = spark.createDataFrame([("d", "e", "f", [("Y", None), ("X", "k")], None, ["s2"], False, "attr", "base#B", "base")], a.schema)
    row = R.merged(a, b).first()
    assert (
        [tuple(t) for t in row.targets], row.traits, row.sources, row.fk_inferred, row.attribute
    ) == ([("X", "k"), ("Y", None)], ["t1"], ["s1", "s2"], False, "attr")
    assert (row.inherited_from, row.resolve_from) == ("base#B", "d")
    wanted = spark.createDataFrame(
        [("d", "Party", "lib#Party"), ("d", "m/Party", "lib#Party"), ("d", "Two", None)],
        "document string, target string, import_id string"
    )
    seeds = spark.createDataFrame([("seed", "Party"), ("s1", "Two"), ("s2", "Two")], "doc string, name string")
    found = {r.target: (r.chosen_id, r.resolved_by) for r in R.chosen_targets(wanted, seeds).collect()}
    assert found == {"Party": ("seed#Party", "seed_layer"), "m/Party": ("lib#Party", "import_order"), "Two": (None, None)}
    assert [tuple(r) for r in R.deviations(R.chosen_targets(wanted, seeds)).collect()] == [("Party", 1)]


def test_deep_chains_and_imports_are_followed_to_their_end(spark):
    nodes = spark.createDataFrame(
        [(f"e{i:02d}", f"e{i + 1:02d}" if i < 35 else None) for i in range(36)], "entity_id string, parent_id string"
    )
    assert H.chains(nodes).where("entity_id = 'e00'").count() == 36
    imports = spark.createDataFrame(
        [(f"d{i:02d}", 0, f"d{i + 1:02d}", None) for i in range(35)], "doc string, ord int, target_doc string, moniker string"
    )
    found = N.closure(spark.createDataFrame([("d00",)], "doc string"), imports).collect()
    assert sorted((r["rank"], r.doc) for r in found) == [(i, f"d{i:02d}") for i in range(36)]


def test_a_diamond_of_imports_has_one_row_a_document_and_round(spark):
    rows = [(f"d{i:02d}{a}", k, f"d{i + 1:02d}{b}", None) for i in range(30) for a in "xy" for k, b in enumerate("xy")]
    imports = spark.createDataFrame(rows, "doc string, ord int, target_doc string, moniker string")
    found = {r.doc: r["rank"] for r in N.closure(spark.createDataFrame([("d00x",)], "doc string"), imports).collect()}
    # Depth first: down the x side, then each y on the way back up.
    assert len(found) == 61 and [
        d for d, _ in sorted(found.items(), key=lambda x: x[1])
    ] == [f"d{i:02d}x" for i in range(31)] + [f"d{i:02d}y" for i in range(30, 0, -1)]


def first_by_walk(start, key, edges, held):
    """The first holder of a key that a recursive depth-first walk comes to."""
    seen, stack = set(), [start]
    while stack:
        doc = stack.pop()
        if doc in seen:
            continue
        seen.add(doc)
        if (doc, key) in held:
            return doc
        stack.extend(b for _, b in sorted(edges.get(doc, []), reverse=True))
    return None


@pytest.mark.parametrize("hub", [2, 1000])
def test_names_searched_on_demand_are_those_of_a_walk(spark, hub):
    """Random imports with cycles, repeated imports and documents that import themselves, and hubs on and off cycles."""
    rng = random.Random(hub)
    docs = [f"d{i:02d}" for i in range(40)]
    edges = {}
    for i, doc in enumerate(docs):
        # Half of the imports go to later documents alone, so that some hubs lie on no cycle.
        pool = docs[i:] if i % 2 else docs
        edges[doc] = [(k, rng.choice(pool)) for k in range(rng.choice([0, 1, 2, 3, 6]))]
    held = {(rng.choice(docs), f"k{rng.randrange(12)}") for _ in range(25)}
    asked = [(d, f"k{k}") for d in docs for k in range(13)] + [("absent", "k1"), ("d00", None), (None, "k1")]
    imports = [(a, k, b, None) for a, out in edges.items() for k, b in out] + [("d00", 99, None, None), ("d01", 99, "d02", "alias")]
    found = N.first_holders(
        spark.createDataFrame(asked + asked[:5], "start string, key string"),
        spark.createDataFrame(imports, "doc string, ord int, target_doc string, moniker string"),
        spark.createDataFrame(sorted(held), "doc string, key string"), hub
    ).collect()
    got = {(r.start, r.key): r.found for r in found}
    assert len(found) == len(got)
    wanted = {(d, k): first_by_walk(d, k, edges, held) for d, k in asked if d and k}
    assert got == {x: y for x, y in wanted.items() if y is not None}


def test_no_names_asked_and_no_imports(spark):
    imports = spark.createDataFrame([], "doc string, ord int, target_doc string, moniker string")
    asked = spark.createDataFrame([("a", "X"), ("b", "X"), ("b", "m/X")], "doc string, wanted string")
    definitions = spark.createDataFrame([("a", "X"), ("a", "X")], "doc string, name string")
    assert sorted((r.doc, r.wanted, r.found_doc) for r in N.resolve(asked, imports, definitions).collect()) == [
        ("a", "X", "a"), ("b", "X", None), ("b", "m/X", None)
    ]
    assert N.resolve(asked.limit(0), imports, definitions).count() == 0


def test_a_hub_of_many_imports_asked_by_many_stays_linear(spark, tmp_path):
    """n documents import a hub of n imports, and each asks for another name: no step makes a row for each pair of the two."""
    n = 1000
    hub = 500
    ids = spark.range(n).select(F.col("id").cast("int").alias("i"))
    imports = ids.select(F.concat(F.lit("ask"), "i").alias("doc"), F.lit(0).alias("ord"), F.lit("hub").alias("target_doc")).unionByName(
        ids.select(F.lit("hub").alias("doc"), F.col("i").alias("ord"), F.concat(F.lit("leaf"), "i").alias("target_doc"))
    ).withColumn("moniker", F.lit(None).cast("string"))
    asked = ids.select(F.concat(F.lit("ask"), "i").alias("doc"), F.concat(F.lit("N"), "i").alias("wanted"))
    definitions = ids.select(F.concat(F.lit("leaf"), "i").alias("doc"), F.concat(F.lit("N"), "i").alias("name"))
    made = []
    whole = N.materialize

    def counted(df, name, *by):
        out = whole(df, name, *by)
        made.append(out.count())
        return out

    N.materialize = counted
    try:
        rows = N.resolve(asked, imports, definitions, hub).collect()
    finally:
        N.materialize = whole
    assert len(rows) == n and all(r.found_doc == "leaf" + r.wanted[1:] for r in rows)
    assert max(made) <= 2 * n + 2


def test_groups_nested_deeply_are_expanded(spark):
    groups = [{"attributeGroupName": f"g{i}", "members": [{"name": f"a{i}", "dataType": "string"}, f"g{i + 1}"]} for i in range(20)]
    doc = {"imports": [], "definitions": [*groups, {"entityName": "E", "hasAttributes": ["g0"]}]}
    good, _ = S.parsed(spark.createDataFrame([("d.cdm.json", json.dumps(doc))], "path string, json string"))
    entities, found = S.definitions(good)
    imports = S.imports(good)
    assert N.expanded(N.flattened(entities, found), imports, found).count() == 20


def test_keys_at_any_depth_are_edges_and_hollow_ones_are_counted(spark):
    inner = fk("inner", "T", "innerKey")
    doc = {
        "entityName": "E",
        "hasAttributes": [
            {"name": "box", "holds": {"deep": [inner]}}, fk("ghost", {"entityName": "none", "hasAttributes": []}),
            {
                "name": "named",
                "entity": {
                    "entityReference": "U",
                    "appliedTraits": [{"traitReference": "is.identifiedBy", "arguments": ["U/(resolvedAttributes)/uId"]}]
                },
                "resolutionGuidance": {"entityByReference": {}}
            }
        ]
    }
    nodes = N.fk_nodes(spark.createDataFrame([("d", "E", json.dumps(doc))], "doc string, name string, json string"))
    assert [
        (r.attribute, r.fk_name, [tuple(t) for t in r.targets]) for r in R.extracted(nodes).collect()
    ] == [("inner", "innerKey", [("T", None)]), ("named", "id", [("U", "uId")])]
    assert [tuple(r) for r in R.skipped(nodes).collect()] == [("d", "E", 1)]


def test_standard_fields_by_key_name_and_audit_keys(spark):
    types = f"entity_id string, ord int, name string, data_type string, fk_name string, fk_targets {R.TARGETS}, description string"
    own = spark.createDataFrame(
        [
            ("e", 0, "maker", "entity", "createdById", [("user", None)], None),
            ("e", 1, "owner", "entity", "ownerId", [("user", None)], None),
            ("e", 2, "bank", "entity", "bankId", [("Bank", None)], None)
        ],
        types
    )
    chain = spark.createDataFrame([("e", "e", 0)], "entity_id string, ancestor_id string, depth int")
    standard = spark.createDataFrame([("e", "createdById")], "entity_id string, name string")
    found = H.resolved(own, chain, standard)
    assert {(r.name, r.origin, r.inlined) for r in found.collect()} == {
        ("maker", "standard", True), ("owner", "own", False), ("bank", "own", False)
    }
    assert [r.name for r in H.attribute_details(found).collect()] == ["bank"]


def test_documents_that_look_versioned(spark):
    names = [
        "Account.cdm.json", "Account.1.cdm.json", "Account.1.5.cdm.json", "Account.1.5.2.cdm.json", "_allImports.cdm.json",
        "_other.cdm.json", "x.manifest.cdm.json", "a.json"
    ]
    kept = S.entity_documents(spark.createDataFrame([(f"f/{n}",) for n in names], "path string")).collect()
    assert {r.path for r in kept} == {"f/Account.cdm.json", "f/Account.1.cdm.json", "f/_other.cdm.json"}


def test_an_index_is_opened_again_unless_the_model_changes(spark, tmp_path):
    from cataloom.sources import index as I

    rows = spark.createDataFrame([("a", "t", "text")], "chunk_id string, chunk_type string, text string")
    built = [I.open_or_build(rows, str(tmp_path / "index"), m).built for m in ("one", "one", "two")]
    assert built == [True, False, True] and I.open_or_build(rows, str(tmp_path / "index"), "two").rows.first().model == "two"


@pytest.mark.parametrize("cycles", [False, True])
def test_attributes_taken_over_from_parents_are_those_of_whole_chains(spark, cycles):
    draw = random.Random(7)
    names = [f"e{i:02d}" for i in range(60)]
    parent = {n: (draw.choice(names[:i]) if i and draw.random() < 0.9 else None) for i, n in enumerate(names)}
    parent |= {"e55": "lost"} | ({"e03": "e09", "e09": "e03", "e01": "e01", "e20": "e09"} if cycles else {})
    rows = {
        n: [
            (k, draw.choice("abcdef"), "entity", draw.choice([None, "id", "realId", "fId"]), [("T", None)], draw.choice([None, f"of {n} {k}"]))
            for k in range(draw.randint(0, 4))
        ] for n in names
    }
    own = f"array<struct<ord:int,name:string,data_type:string,fk_name:string,fk_targets:{R.TARGETS},description:string>>"
    nodes = spark.createDataFrame([(n, parent[n], rows[n]) for n in names], f"entity_id string, parent_id string, own {own}")
    walked = {}
    for n in names:
        walked[n], up = [n], parent[n]
        while up and up not in walked[n]:
            walked[n].append(up)
            up = parent.get(up)
    chain = H.chains(nodes)
    assert sorted(map(tuple, chain.collect())) == sorted((n, a, d) for n in names for d, a in enumerate(walked[n]))
    some = spark.createDataFrame([("e55",), ("e20",), ("e59",)], "entity_id string")
    assert sorted(map(tuple, H.chains(nodes, some).collect())) == sorted((n, a, d) for n in ("e55", "e20", "e59") for d, a in enumerate(walked[n]))
    is_standard = lambda c: c.isin("e00", "e02")
    above = chain.where(is_standard(F.col("ancestor_id")))
    flat = nodes.select("entity_id", F.inline("own"))
    offered = flat.select(F.col("entity_id").alias("ancestor_id"), F.explode(F.array_compact(F.array("name", "fk_name"))).alias("name"))
    wanted = H.resolved(flat, chain, above.join(offered, "ancestor_id").select("entity_id", "name").distinct(), is_standard(F.col("ancestor_id")))
    found = H.inherited(nodes, is_standard)
    assert sorted(map(str, found.select(wanted.columns).collect())) == sorted(map(str, wanted.collect())) and wanted.count() > 200


def test_attributes_are_written_once_and_chains_not_at_all(spark, monkeypatch):
    written = {}
    write = shared.materialize

    def counted(rows, name, *by):
        out = write(rows, name, *by)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(H, "materialize", counted)
    nodes = A.declaring_nodes(spark, "/root/testdata/sf0.001")
    found = H.inherited(nodes, lambda c: F.startswith(c, F.lit("region#")))
    assert found.count() > 9 * nodes.count() > 9000
    # What is written on the way are parents: customers, nations, regions.
    assert sum(written.values()) <= 2 * nodes.where("not startswith(entity_id, 'orders#')").count()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 6 and "Window" not in plan
