"""Schema documents: JSON files that import each other and define entities and attribute groups."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cataloom.functions.paths import dirname, is_entity_document, joined
from cataloom.sources import versions
from cataloom.sources.shared import materialize
from cataloom.sources.tables import table

SHAPE = "imports array<struct<corpusPath:string,moniker:string>>, definitions array<string>, relationships array<struct<fromEntity:string,fromEntityAttribute:string,toEntity:string,toEntityAttribute:string,exhibitsTraits:array<string>>>"


def _store(folder: str):
    """The file system that a folder is in, and the folder's path there. Spark's own readers leave out names that begin with an underscore, as hubs of imports do."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + os.path.abspath(folder))
    return store, root.rstrip("/")


def write_tree(docs: DataFrame, folder: str) -> int:
    """Write each (path, json) as a file below a shared folder, in tasks; a file appears whole or not at all, and a task run again writes the same. The number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("json").to_pylist()):
                place, part = f"{root}/{path}", f"{root}/{path}.{uuid.uuid4().hex}{PART}"
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(part) as out:
                    out.write(text.encode())
                store.move(part, place)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return docs.select("path", "json").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


#: Ending of a file that isn't written yet.
PART = ".part"
LISTING = "path string, size long, modified long"


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), size, modified (nanoseconds) of all files. The folder's own entries are listed here, what is below each of them in tasks."""
    from pyarrow import fs

    store, root = _store(folder)
    entries = [(x.path[len(root) + 1 :], x.type == fs.FileType.Directory) for x in store.get_file_info(fs.FileSelector(root))]

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for path, is_folder in zip(batch.column("path").to_pylist(), batch.column("is_folder").to_pylist()):
                here = store.get_file_info(fs.FileSelector(f"{root}/{path}", recursive=True) if is_folder else [f"{root}/{path}"])
                files = [x for x in here if x.type == fs.FileType.File and not x.path.endswith(PART)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.path[len(root) + 1 :] for x in files], pa.string()), pa.array([x.size for x in files], pa.int64()), pa.array([x.mtime_ns for x in files], pa.int64())],
                    ["path", "size", "modified"]
                )

    return spark.createDataFrame(entries, "path string, is_folder boolean").repartition("path").mapInArrow(below, LISTING)


def loaded(files: DataFrame, folder: str) -> DataFrame:
    """path, size, modified, json, reason of listed files; reason says why a file is no document, else null. A file that can't be read doesn't stop the others."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                text, reason = None, None
                try:
                    with store.open_input_stream(f"{root}/{path}") as file:
                        text = file.read().decode()
                except OSError:
                    reason = "unreadable"
                except UnicodeDecodeError:
                    reason = "not UTF-8"
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in ("path", "size", "modified")), pa.array([text]).cast(pa.string()), pa.array([reason]).cast(pa.string())], ["path", "size", "modified", "json", "reason"])

    rows = files.repartition(F.xxhash64("path")).mapInArrow(read, LISTING + ", json string, reason string")
    wrong = F.when(F.trim("json") == "", "empty").when(F.try_parse_json("json").isNull(), "not JSON").when(~F.rlike("json", F.lit(r"^\s*\{")), "not an object")
    return rows.withColumn("reason", F.coalesce("reason", wrong))


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(path, json, reason) of all files below a folder; paths are relative to it."""
    return loaded(listed(spark, folder), folder).select("path", "json", "reason")


def refreshed(spark: SparkSession, folder: str, place: str) -> DataFrame:
    """path, size, modified, json, reason, read_in of the files below a folder, kept as a versioned table at ``place``.

    Files that the version before has as they are now aren't read again; read_in is the version in which a file was read. A run that fails leaves the version before.
    """
    before = versions.current(spark, place)
    files = materialize(listed(spark, folder), "listing")
    number = before.number + 1 if before else 0
    if before is None:
        kept, new = None, files
    else:
        known = before.rows(spark)
        kept, new = known.join(files, ["path", "size", "modified"], "left_semi"), files.join(known, ["path", "size", "modified"], "left_anti")
    rows = loaded(new, folder).withColumn("read_in", F.lit(number).cast("long"))
    rows = rows if kept is None else kept.select(rows.columns).unionByName(rows)
    return versions.publish(rows, place).rows(spark, rows.schema)


def parsed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, doc) of the documents that are JSON objects, and the quarantine (path) of those that aren't."""
    checked = docs.withColumn("_ok", F.try_parse_json("json").isNotNull() & F.rlike("json", F.lit(r"^\s*\{")))
    return checked.where("_ok").select("path", F.from_json("json", SHAPE).alias("doc")), checked.where(~F.coalesce("_ok", F.lit(False))).select("path")


def entity_documents(docs: DataFrame) -> DataFrame:
    return docs.where(is_entity_document(F.col("path")))


def imports(good: DataFrame) -> DataFrame:
    """doc, ord, target_doc, moniker, in the order of declaration."""
    rows = good.select("path", F.posexplode("doc.imports").alias("ord", "i"))
    return rows.select(
        F.col("path").alias("doc"), "ord", joined(dirname(F.col("path")), F.col("i.corpusPath")).alias("target_doc"),
        F.col("i.moniker").alias("moniker")
    )


def definitions(good: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (doc, name, extends, description, json) and attribute groups (doc, name, json); of a name's definitions in a document the last one counts."""
    rows = good.select(F.col("path").alias("doc"), F.posexplode("doc.definitions").alias("ord", "json"))
    field = lambda p: F.get_json_object("json", p)
    entity = rows.withColumn("name", field("$.entityName")).where("name is not null")
    entity = entity.groupBy("doc", "name").agg(F.max_by("json", "ord").alias("json"))
    extends = F.coalesce(
        F.when(~F.startswith(field("$.extendsEntity"), F.lit("{")), field("$.extendsEntity")),
        field("$.extendsEntity.entityReference")
    )
    group = rows.withColumn("name", field("$.attributeGroupName")).where("name is not null").groupBy("doc", "name").agg(F.max_by("json", "ord").alias("json"))
    return entity.select("doc", "name", extends.alias("extends"), field("$.description").alias("description"), "json"), group


def manifest_relationships(good: DataFrame) -> DataFrame:
    """document, entity, fk, target_doc, target_entity, target_attribute, traits of every relationship of the manifests; paths relative to the manifest's folder or absolute."""
    rows = good.select("path", F.explode("doc.relationships").alias("r"))
    last = lambda c: F.substring_index(c, "/", -1)
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    return rows.select(
        joined(
            dirname(F.col("path")), folder(F.col("r.fromEntity"))
        ).alias("document"), last("r.fromEntity").alias("entity"), F.col("r.fromEntityAttribute").alias("fk"),
        joined(
            dirname(F.col("path")), folder(F.col("r.toEntity"))
        ).alias("target_doc"), last("r.toEntity").alias("target_entity"), F.col("r.toEntityAttribute").alias("target_attribute"),
        F.coalesce("r.exhibitsTraits", F.array().cast("array<string>")).alias("traits"),
    )


def seeds(entities: DataFrame, folder: str) -> DataFrame:
    """Entities of the unversioned documents directly inside a folder."""
    return entities.where(is_entity_document(F.col("doc")) & (dirname(F.col("doc")) == folder)).select("doc", "name")


#: Audit names of the corpus that :func:`from_parts` makes.
AUDIT = ("createdById",)


def _fk(name: str, fk: str, target: str | Column, identifier: Column | None = None) -> Column:
    reference = F.lit(target) if isinstance(target, str) else target
    traits = [] if identifier is None else [
        F.array(F.struct(F.lit("is.identifiedBy").alias("traitReference"), F.array(identifier).alias("arguments"))).alias("appliedTraits")
    ]
    return F.struct(
        F.lit(name).alias("name"), F.struct(reference.alias("entityReference"), *traits).alias("entity"),
        F.struct(
            F.struct(F.struct(F.lit(fk).alias("name")).alias("foreignKeyAttribute")).alias("entityByReference")
        ).alias("resolutionGuidance"),
    )


EMPTY = '{"imports": [], "definitions": []}'
#: An attribute that holds a foreign key deeper down, and one whose foreign key has no target.
BOX = (
    '{"name":"box","dataType":"string","holds":[{"name":"inner","entity":{"entityReference":"T0"},'
    '"resolutionGuidance":{"entityByReference":{"foreignKeyAttribute":{"name":"innerKey"}}}}]}'
)
GHOST = '{"name":"ghost","entity":{"entityReference":{"entityName":"none","hasAttributes":[]}},"resolutionGuidance":{"entityByReference":{}}}'
STANDARD = """{"imports": [], "definitions": [
 {"attributeGroupName": "audit", "members": [{"name": "createdBy", "description": "Who made the record.", "entity": {"entityReference": "User"}, "resolutionGuidance": {"entityByReference": {"foreignKeyAttribute": {"name": "createdById"}}}}, "stamps"]},
 {"attributeGroupName": "stamps", "members": [{"name": "createdOn", "dataType": "dateTime"}, {"attributeGroupReference": "audit"}]},
 {"entityName": "CdsStandard", "extendsEntity": "CdmEntity", "hasAttributes": [{"attributeGroupReference": {"attributeGroupName": "audit"}}]}]}"""


def from_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, json): a corpus of schema documents made from the parts table."""
    part = table(spark, sf_dir, "part")
    types = part.select("p_type").distinct().select("p_type", (F.row_number().over(Window.orderBy("p_type")) - 1).alias("i"))  # a handful of types
    number = F.regexp_extract("p_brand", r"(\d+)", 1)
    text = lambda *cols: F.to_json(F.struct(*cols))
    imp = lambda path, moniker=None: F.struct(
        path.alias("corpusPath"), (F.lit(None).cast("string") if moniker is None else moniker).alias("moniker")
    )
    name = F.concat(F.lit("T"), F.col("i").cast("string"))
    size = '{"name":"size","dataType":"integer"}'

    def entity(entity_name: Column, extends: Column, *attributes: Column) -> Column:
        head = F.concat(F.lit('{"entityName":"'), entity_name, F.lit('","extendsEntity":"'), extends, F.lit('","hasAttributes":['))
        return F.concat(head, F.concat_ws(",", *attributes), F.lit("]}"))

    def document(imports_: Column, *defs: Column) -> Column:
        return F.concat(F.lit('{"imports":'), F.to_json(imports_), F.lit(',"definitions":['), F.concat_ws(",", *defs), F.lit("]}"))

    std, t0 = imp(F.lit("/std.cdm.json")), imp(F.lit("/types/T0.cdm.json"))
    type_docs = types.select(
        F.concat(F.lit("types/"), name, F.lit(".cdm.json")).alias("path"),
        document(
            F.when(F.col("i") == 0, F.array(std)).otherwise(F.array(std, t0)),
            entity(
                name, F.lit("CdsStandard"), F.lit(size), F.to_json(_fk("regarding", "regardingId", "T0")), F.lit(BOX),
                F.lit(GHOST), F.lit('"lostGroup"')
            )
        ).alias("json")
    )
    hub = types.groupBy().agg(
        F.array_sort(F.collect_list(imp(F.concat(F.lit("/types/"), name, F.lit(".cdm.json")), F.concat(F.lit("base_"), name)))).alias("all")
    )
    hub = hub.select(F.lit("brands/_allImports.cdm.json").alias("path"), document(F.concat(F.array(std), "all")).alias("json"))
    brands = part.groupBy(number.alias("b")).agg(F.min("p_type").alias("p_type")).join(types, "p_type")
    inline = '{"name":"regarding","entity":{"entityReference":{"entityName":"either","hasAttributes":[{"name":"a","entity":{"entityReference":"T0"}},{"name":"b","entity":{"entityReference":"T1"}}]}},"resolutionGuidance":{"entityByReference":{}}}'
    brand_name = F.concat(F.lit("B"), "b")
    brand_docs = brands.select(
        F.concat(F.lit("brands/"), brand_name, F.lit(".cdm.json")).alias("path"),
        document(
            F.array(imp(F.lit("_allImports.cdm.json")), t0),
            entity(
                brand_name, F.concat(F.lit("base_"), name, F.lit("/"), name),
                F.lit('{"name":"retail","dataType":{"dataTypeReference":"decimal"}}'), F.lit(inline)
            )
        ).alias("json")
    )
    key, brand = F.col("p_partkey").cast("string"), F.concat(F.lit("B"), number)
    target = F.concat(F.lit("T"), (F.col("p_size") % 6).cast("string"))
    part_json = document(
        F.array(imp(F.concat(F.lit("/brands/"), brand, F.lit(".cdm.json"))), std),
        entity(
            F.concat(F.lit("P"), key), brand, F.lit('{"name":"size","dataType":"integer","description":"Own size."}'),
            F.to_json(_fk("alt", "altId", target, F.concat(target, F.lit("/(resolvedAttributes)/typeId")))),
            F.when(F.col("p_partkey") % 10 == 0, F.to_json(_fk("createdBy", "createdById", "User")))
        ),
    )
    part_docs = part.select(F.concat(F.lit("parts/P"), key, F.lit(".cdm.json")).alias("path"), part_json.alias("json"))
    versioned = part.where("p_partkey % 50 = 0").select(
        F.concat(F.lit("parts/P"), key, F.lit(".1.0.cdm.json")).alias("path"), part_json.alias("json")
    )
    bad = part.where("p_partkey % 500 = 0").select(
        F.concat(F.lit("bad/"), key, F.lit(".cdm.json")).alias("path"), F.lit('{"imports": [').alias("json")
    )
    relation = F.struct(
        F.concat(F.lit("P"), key, F.lit(".cdm.json/P"), key).alias("fromEntity"), F.lit("altId").alias("fromEntityAttribute"), F.concat(
            F.lit("/types/"), target, F.lit(".cdm.json/"), target
        ).alias("toEntity"),
        F.lit("typeId").alias("toEntityAttribute"), F.array(F.lit("means.relation")).alias("exhibitsTraits"),
    )
    # Not versioned, whatever it looks like; and not a hub of imports.
    notes = part.where("p_partkey % 100 = 0").select(
        F.concat(F.lit("notes/N"), key, F.lit(".1.cdm.json")).alias("path"), F.lit(EMPTY).alias("json")
    )
    notes = notes.unionByName(spark.range(1).select(F.lit("notes/_shared.cdm.json").alias("path"), F.lit(EMPTY).alias("json")))
    manifests = part.where("p_partkey % 3 = 0").groupBy(brand.alias("b")).agg(F.collect_list(relation).alias("relationships"))
    manifests = manifests.select(
        F.concat(F.lit("parts/"), "b", F.lit(".manifest.cdm.json")).alias("path"), text("relationships").alias("json")
    )
    standard = spark.range(1).select(F.lit("std.cdm.json").alias("path"), F.lit(STANDARD).alias("json"))
    out = standard
    for d in (type_docs, hub, brand_docs, part_docs, versioned, bad, notes, manifests):
        out = out.unionByName(d)
    return out
