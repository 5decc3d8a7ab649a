"""Queries on text: chunks, vectors, questions, answers and request logs."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.functions import text as T
from cataloom.jobs import graph_jobs as J
from cataloom.operators import chunks as C
from cataloom.operators import evaluation as E
from cataloom.operators import graph as G
from cataloom.operators import inheritance as H
from cataloom.operators import routing as D
from cataloom.operators import vectors as V
from cataloom.sources import adapters as A
from cataloom.sources import index as I
from cataloom.sources.shared import fingerprint, materialize, shared_dir, written_once
from cataloom.sources.tables import table
from cataloom.streaming import throttle


def c1_token_estimates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("n_tokens"))


def c2_short_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.short(F.col("text"), 48).alias("short"))


def c3_identifier_helpers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    camel = F.concat(F.lower(F.substring_index("p_name", " ", 1)), F.initcap(F.substring_index("p_name", " ", -1)))
    target = F.initcap(F.substring_index("p_name", " ", -1))
    return p.select(
        "p_partkey", T.humanized(camel).alias("humanized"), T.self_qualifier(camel, target).alias("qualifier"),
        T.article(F.col("p_name")).alias("article"), T.listed(F.array("p_brand", "p_type", "p_name"), "or").alias("listed")
    )


def c4_representative(spark, sf_dir):
    r = J.resolved(spark, sf_dir).withColumn(
        "shown", F.when(F.col("pos") % 3 == 0, F.concat("name", F.lit("Base"))).otherwise(F.col("name"))
    )
    names = r.groupBy("entity_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "shown"))), lambda x: x["shown"]).alias("names")
    )
    return names.select("entity_id", F.array_join(T.representative(F.col("names"), 3), ",").alias("names"))


def c5_labels(spark, sf_dir):
    return C.labels(A.nodes(spark, sf_dir))


def c6_entity_chunks(spark, sf_dir):
    n = A.nodes(spark, sf_dir)
    return C.entity_chunks(n, J.resolved(spark, sf_dir), H.lines(n, "display_name"), J.targets(spark, sf_dir)).select("chunk_id", "text")


def c7_relationship_chunks(spark, sf_dir):
    return C.relationship_chunks(A.edges(spark, sf_dir), A.nodes(spark, sf_dir)).select("chunk_id", "text")


def _details(spark, sf_dir):
    """Attribute details with the layers that declare or inherit each, in place of thousands of single entities."""
    fks = H.business_keys(J.resolved(spark, sf_dir)).withColumn("layer", F.substring_index("entity_id", "#", 1))
    flat = fks.select("name", "layer", "depth", "fk_name", F.explode("fk_targets").alias("t"))
    out = flat.groupBy("name").agg(
        F.array_sort(F.collect_set("t.entity")).alias("targets"),
        F.array_sort(F.collect_set(F.when(F.col("depth") == 0, F.col("layer")))).alias("declared_by"),
        F.array_sort(F.collect_set(F.when(F.col("depth") > 0, F.col("layer")))).alias("inherited_by"),
        F.min("fk_name").alias("fk_name")
    )
    return out.withColumn("is_polymorphic", F.size("targets") > 1)


def c8_attribute_chunks(spark, sf_dir):
    return C.attribute_chunks(_details(spark, sf_dir)).select("chunk_id", "text")


def c6_within_budget(spark, sf_dir):
    """Does each entity's text keep to its budget, and how many lines has it?"""
    told = c6_entity_chunks(spark, sf_dir)
    return told.select(
        "chunk_id", (T.estimated_tokens(F.col("text")) <= C.BUDGET).alias("fits"),
        F.size(F.split("text", "\n")).cast("long").alias("n_lines")
    )


def _index(spark, sf_dir):
    """Chunks of all three kinds, without those of infrastructure entities."""
    n = A.nodes(spark, sf_dir)
    entities = C.entity_chunks(n, J.resolved(spark, sf_dir), H.lines(n, "display_name"), J.targets(spark, sf_dir)).withColumn(
        "name", F.concat(F.lit("entity/"), F.regexp_extract("chunk_id", "^entity:([a-z]+)#", 1))
    )
    rel = C.relationship_chunks(A.edges(spark, sf_dir), n).withColumn("name", F.regexp_extract("chunk_id", "^rel:([a-z]+)#", 1))
    attributes = C.attribute_chunks(_details(spark, sf_dir)).withColumn("name", F.lit("attribute"))
    return entities.unionByName(rel).unionByName(attributes).where(~F.col("name").isin("entity/region"))


def c9_index_input(spark, sf_dir):
    return _index(spark, sf_dir).groupBy("name").agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.startswith("name", F.lit("entity/")), 0).otherwise(F.length("text"))).alias("chars")
    )


def c10_index_metadata(spark, sf_dir):
    entry = lambda k: F.coalesce(F.col("metadata")[k], F.lit(""))
    return _index(spark, sf_dir).select(
        "chunk_id", F.array_join(F.array_sort(F.map_keys("metadata")), ",").alias("keys"), entry("targets").alias("targets"),
        entry("attribute_count").alias("counts"), entry("parent_id").alias("parent_id")
    )


def v1_embeddings(spark, sf_dir):
    v = table(spark, sf_dir, "documents").select("doc_id", V.embed(F.col("text")).alias("vector"))
    return v.select(
        "doc_id", F.size("vector").cast("long").alias("dimensions"),
        F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 3).alias("norm")
    )


def v2_over_length(spark, sf_dir):
    return T.over_length(table(spark, sf_dir, "documents"), 512).select("doc_id", "n_tokens")


def v2_model_lengths(spark, sf_dir):
    """The same by a tokenizer's own count."""
    import public_tokenizers

    own = lambda text: T.model_tokens(text, public_tokenizers.path("word_bpe_49k.json"))
    return T.over_length(table(spark, sf_dir, "documents"), 512, own).select("doc_id", "n_tokens")


def _hits(spark, sf_dir, k):
    e = table(spark, sf_dir, "embeddings")
    return V.top_k(
        e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")),
        e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), k
    )


def v3_top_k(spark, sf_dir):
    return _hits(spark, sf_dir, 5).select("query_id", "chunk_id", "rank")


def v4_filtered_search(spark, sf_dir):
    """Vectors of other labels than the query's own, from 15 fetched."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    hits = _hits(spark, sf_dir, 15).join(labels.toDF("chunk_id", "c_label"), "chunk_id").join(labels.toDF("query_id", "q_label"), "query_id")
    free = hits.where("c_label != q_label").withColumn("text", F.col("chunk_id").cast("string"))
    return V.selected(free, 5).select("query_id", "chunk_id", "rank")


#: The model whose vectors the index holds, and hits of a question.
MODEL, K = "hashing-64", 5


def stored_index(spark, sf_dir) -> DataFrame:
    """chunk_id, chunk_type, text, metadata, vector of all chunks, in the shared folder: built by the first who asks, and anew for another model or other tables."""
    place = f"{shared_dir(spark)}/chunk-index-{spark.sparkContext.applicationId}-{fingerprint(spark, sf_dir)}"
    rows = _index(spark, sf_dir).select(
        "chunk_id", F.col("metadata")["chunk_type"].alias("chunk_type"), "text", "metadata", V.embed(F.col("text")).alias("vector")
    )
    return I.open_or_build(rows, place, MODEL).rows


def question_vectors(questions: DataFrame) -> DataFrame:
    """query_id, vector, with the prefix that questions get."""
    return questions.select(F.col("question_id").alias("query_id"), V.embed(F.col("question"), is_query=True).alias("vector"))


def v3_question_hits(spark, sf_dir):
    """The nearest chunks of every question, in the stored index."""
    asked = question_vectors(A.questions(spark, sf_dir))
    return V.top_k(asked, stored_index(spark, sf_dir), K).select(F.col("query_id").alias("question_id"), "chunk_id", "rank")


def v4_other_layers(spark, sf_dir):
    """The nearest chunks of questions about one entity, without those of entities of its name in other layers."""
    q = Questions(spark, sf_dir)
    meant = q.meant()
    asked = question_vectors(q.questions).join(meant.select("query_id"), "query_id", "left_semi")
    hits = V.filtered(asked, stored_index(spark, sf_dir), K, lambda rows: D.other_layers(rows, meant))
    return hits.select(F.col("query_id").alias("question_id"), "chunk_id", "rank")


def _tokens(spark, sf_dir):
    """token, name of every FK attribute; the dictionary is written once."""
    return written_once(spark, sf_dir, "attribute-tokens", lambda: H.attribute_tokens(H.attribute_details(J.resolved(spark, sf_dir))))


def _mentions(spark, sf_dir):
    return D.mentions(A.questions(spark, sf_dir), A.nodes(spark, sf_dir).select("name"))


def _routes(spark, sf_dir):
    q = A.questions(spark, sf_dir)
    return D.routes(q, _mentions(spark, sf_dir), D.mentions(q, _tokens(spark, sf_dir).select(F.col("token").alias("name")).distinct()))


class Questions:
    """What the questions' contexts are made of; tables that several of them need are written."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir
        self.nodes, self.questions = A.nodes(spark, sf_dir), A.questions(spark, sf_dir)
        self.routed = written_once(spark, sf_dir, "routes", lambda: _routes(spark, sf_dir))
        self.singles = self.routed.where("route = 'single'")

    @cached_property
    def targets(self) -> DataFrame:
        """Edges and their targets; only pairs and single entities need them."""
        return written_once(self.spark, self.sf_dir, "targets", lambda: J.targets(self.spark, self.sf_dir))

    def pairs(self) -> DataFrame:
        p = self.routed.where("route = 'pair'").select(
            F.col("question_id").alias("pair_id"), F.col("first").alias("name_a"), F.col("second").alias("name_b")
        )
        found, near = (materialize(x, "pair-facts") for x in (G.relations(p, self.targets), G.near_misses(p, self.targets)))
        notes = G.infrastructure_notes(p.select(F.explode(F.array("name_a", "name_b")).alias("name")), self.nodes, self.targets)
        wanted = found.select("edge_id").unionByName(near.select("edge_id")).distinct()
        edges = A.edges(self.spark, self.sf_dir).join(wanted, "edge_id", "left_semi")
        sentences = C.relationship_chunks(edges, self.nodes, audit=True).select(
            F.regexp_replace("chunk_id", "^rel:", "").alias("edge_id"), "text"
        )
        told = sentences.join(edges.select("edge_id", F.col("from_name").alias("entity"), "attribute", "is_audit"), "edge_id")
        lost = p.join(found.select("pair_id").unionByName(near.select("pair_id")).distinct(), "pair_id", "left_anti")
        return D.pair_items(
            self.routed, found, near, notes, told, G.path_labels(G.shortest_paths(lost, self.nodes, self.targets), self.nodes)
        )

    def owners(self) -> DataFrame:
        """question_id, name, entity_id of questions about one entity."""
        asked = self.singles.select(F.col("question_id").alias("request_id"), F.col("first").alias("wanted"))
        return G.find(asked, self.nodes, A.LAYERS).select(
            F.col("request_id").alias("question_id"), F.col("wanted").alias("name"), "entity_id"
        )

    def single(self) -> DataFrame:
        owners = materialize(self.owners(), "owners")
        mine = owners.select("entity_id").distinct()
        attributes = J.resolved(self.spark, self.sf_dir).join(mine, "entity_id", "left_semi")
        touched = self.targets.join(mine.withColumnRenamed("entity_id", "from_id"), "from_id", "left_semi").unionByName(
            self.targets.join(mine.withColumnRenamed("entity_id", "to_id"), "to_id", "left_semi")
        ).distinct()
        whole = self.targets.join(touched.select("edge_id").distinct(), "edge_id", "left_semi")
        lines = D.entity_lines(self.nodes, attributes, H.lines(self.nodes, "display_name"), whole).join(mine, "entity_id", "left_semi")
        return D.single_items(owners, lines)

    def attribute(self) -> DataFrame:
        asked = self.routed.where("route = 'attribute'").select(
            "question_id", F.col("first").alias("token")
        ).join(_tokens(self.spark, self.sf_dir), "token").select("question_id", "name").distinct()
        texts = C.attribute_chunks(_details(self.spark, self.sf_dir)).select(
            F.regexp_replace("chunk_id", "^attribute:", "").alias("name"), "text"
        )
        return D.attribute_items(asked, texts)

    def structural(self) -> DataFrame:
        return materialize(self.pairs().unionByName(self.single()).unionByName(self.attribute()), "structural")

    def meant(self) -> DataFrame:
        """query_id, name, layer of the entity that a question about one entity means."""
        found = self.owners().join(self.nodes.select("entity_id", "layer"), "entity_id")
        return materialize(found.select(F.col("question_id").alias("query_id"), "name", "layer"), "meant")

    def passages(self, structural: DataFrame) -> DataFrame:
        """The nearest chunks of each question that its structural items don't hold already; questions about one entity fetch more, as they leave out other layers'."""
        index, meant = stored_index(self.spark, self.sf_dir), self.meant()
        asked = materialize(question_vectors(self.questions), "question-vectors")
        about = asked.join(meant.select("query_id"), "query_id", "left_semi")
        single = V.filtered(about, index, K, lambda rows: D.unseen(D.other_layers(rows, meant), structural))
        near = materialize(V.top_k(asked.join(about.select("query_id"), "query_id", "left_anti"), index, K), "near")
        rest = V.selected(D.unseen(V.described(near, index), structural), K)
        return D.search_items(single.unionByName(rest.select(single.columns)), self.nodes)

    def contexts(self) -> DataFrame:
        structural = self.structural()
        return D.assembled(structural, materialize(self.passages(structural), "passages"), self.routed)


def d1_mentions(spark, sf_dir):
    return _mentions(spark, sf_dir)


def d1_phrases(spark, sf_dir):
    """Names of several words, many of which begin alike, in questions about parts."""
    p = table(spark, sf_dir, "part")
    asked = p.select(
        F.col("p_partkey").alias("question_id"), F.concat(F.lit("Is "), F.upper("p_name"), F.lit(", a "), "p_type", F.lit(" of "), "p_brand", F.lit(", sold?")).alias("question")
    )
    few = p.where("p_partkey % 3 = 0").select(F.col("p_name").alias("name"))
    return D.mentions(asked, few.unionByName(p.select(F.col("p_type").alias("name"))).unionByName(p.select(F.col("p_brand").alias("name"))).distinct())


def d2_routes(spark, sf_dir):
    return _routes(spark, sf_dir)


def d3_pair_context(spark, sf_dir):
    return Questions(spark, sf_dir).pairs().drop("is_audit")


def d4_entity_lines(spark, sf_dir):
    n = A.nodes(spark, sf_dir)
    return D.entity_lines(n, J.resolved(spark, sf_dir), H.lines(n, "display_name"), J.targets(spark, sf_dir))


def d5_attribute_context(spark, sf_dir):
    return Questions(spark, sf_dir).attribute().select("question_id", "text", "source", "attribute")


def d6_layer_collisions(spark, sf_dir):
    q = Questions(spark, sf_dir)
    owners = materialize(q.owners().select("question_id", "entity_id"), "owners")
    return D.layer_collisions(q.questions, owners, H.chains(q.nodes, owners), q.nodes)


def d7_contexts(spark, sf_dir):
    return Questions(spark, sf_dir).contexts().select("question_id", "pos", "text", "chunk_type", "source")


def d8_prompts(spark, sf_dir):
    q = Questions(spark, sf_dir)
    return D.prompts(q.questions, q.contexts(), D.ambiguities(d6_layer_collisions(spark, sf_dir)))


def d9_source_trace(spark, sf_dir):
    return Questions(spark, sf_dir).contexts().select("question_id", "pos", "entity", "chunk_type", "source", "attribute", "is_audit")


PHRASES = ("la la", "der die", "the and", "que de", "in")


def e1_phrases(spark, sf_dir):
    a = A.answers(spark, sf_dir)
    return a.select(
        "number", "run_ts", E.first_phrase(F.col("answer"), PHRASES).alias("phrase"),
        F.size(E.mentioned(F.col("answer"), PHRASES)).cast("long").alias("n_mentioned")
    )


def e2_context_items(spark, sf_dir):
    e = A.edges(spark, sf_dir).select(
        F.col("from_id").alias("question_id"),
        F.create_map(F.lit("attribute"), F.col("attribute"), F.lit("audit"), F.col("is_audit").cast("string")).alias("metadata")
    )
    return E.has_item(e, {"attribute": "party", "audit": "false"})


def e3_truncation(spark, sf_dir):
    return A.answers(spark, sf_dir).select("number", "run_ts", E.truncation(F.col("answer")).alias("truncation"))


def e4_ground_truth(spark, sf_dir):
    """Who refers to each entity (audit links too), what is in each layer, what each attribute points to: rows instead of lists, as hubs have no bound."""
    t, n = J.targets(spark, sf_dir), A.nodes(spark, sf_dir)
    referring = t.select(F.lit("referring").alias("kind"), F.col("to_id").alias("key"), F.col("from_name").alias("member"))
    layers = n.select(F.lit("layer").alias("kind"), F.col("layer").alias("key"), F.col("name").alias("member"))
    keys = H.business_keys(J.resolved(spark, sf_dir)).select(
        F.lit("targets").alias("kind"), F.col("name").alias("key"), F.explode("fk_targets.entity").alias("member")
    )
    return referring.unionByName(layers).unionByName(keys).distinct()


def _judged(spark, sf_dir):
    a = E.latest(A.answers(spark, sf_dir))
    return E.verdicts(a, [E.truncation(F.col("answer")).isNull(), F.length("answer") > 200])


def e5_verdicts(spark, sf_dir):
    return _judged(spark, sf_dir).select("number", "passed")


def e6_category_summary(spark, sf_dir):
    return E.category_summary(_judged(spark, sf_dir))


def e7_timing_table(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("number"), F.col("event_type").alias("stage"), F.col("value").alias("seconds")
    )
    return E.timing_table(t, ("click", "view", "error", "signup"), ("click_view", "click", "view"))


def e8_latest_results(spark, sf_dir):
    """Three runs put into the store, one after the other, and the store read."""
    place, answers = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}", A.answers(spark, sf_dir)
    for run in (1, 0, 2):
        E.upserted(answers.where(F.col("run_ts") % 3 == run), place)
    return E.stored(spark, place).select("number", "run_ts", F.length("answer").alias("n"))


def e8_missing_numbers(spark, sf_dir):
    return E.missing_numbers(A.answers(spark, sf_dir).where("number % 7 != 3"))


def t1_admission(spark, sf_dir):
    return throttle.admitted(
        table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), "ts"), limit=2, window_seconds=24 * 3600
    )


def t1_admission_stream(spark, sf_dir):
    """The events as a stream, run to its end into a table."""
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parquet*").select(
        "event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts")
    )
    run = throttle.admitted_stream(
        events, limit=2, window_seconds=24 * 3600
    ).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(throttle.OUTPUT).parquet(f"{place}/out")


QUERIES = {f.__name__: f for f in (
    c1_token_estimates, c2_short_texts, c3_identifier_helpers, c4_representative, c5_labels, c6_entity_chunks, c6_within_budget, c7_relationship_chunks, c8_attribute_chunks, c9_index_input, c10_index_metadata, v1_embeddings, v2_over_length, v3_top_k, v3_question_hits, v4_filtered_search, v4_other_layers,
    v2_model_lengths, d1_mentions, d1_phrases, d2_routes, d3_pair_context, d4_entity_lines, d5_attribute_context, d6_layer_collisions, d7_contexts, d8_prompts, d9_source_trace, e1_phrases, e2_context_items, e3_truncation, e4_ground_truth, e5_verdicts, e6_category_summary, e7_timing_table,
    e8_latest_results, e8_missing_numbers, t1_admission, t1_admission_stream,
)}

_W = "WITH RECURSIVE "
_TOKENS = "tok AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Z]?[a-z]+')) + len(regexp_extract_all(regexp_replace(text, '[A-Z]?[a-z]+', '_', 'g'), '[A-Z]+|[0-9]+|[^\\pL\\pN_\\s]')) AS n_tokens FROM documents)"
_LABELS = "labels_ AS (SELECT entity_id, name, CASE WHEN count(*) OVER (PARTITION BY name) = 1 THEN name ELSE name||' ('||layer||')' END AS label FROM nodes)"
_DET = """det AS (SELECT name, list_sort(list(DISTINCT t)) AS targets, list_sort(list(DISTINCT layer) FILTER (depth = 0)) AS dec, list_sort(list(DISTINCT layer) FILTER (depth > 0)) AS inh, min(fk_name) AS fk_name FROM (SELECT name, split_part(entity_id, '#', 1) AS layer, depth, fk_name, unnest(string_split(fk_targets, ',')) AS t FROM resolved WHERE origin <> 'standard' AND fk_name IS NOT NULL AND fk_name NOT IN ('id', 'ownerId') AND fk_targets IS NOT NULL) GROUP BY name)"""


def _list(items: str, word: str) -> str:
    return f"CASE WHEN len({items}) = 1 THEN {items}[1] ELSE array_to_string({items}[:len({items}) - 1], ', ')||' {word} '||{items}[len({items})] END"


_ATTRIBUTE_TEXT = f"""'The attribute `'||name||'` is a '||CASE WHEN len(targets) > 1 THEN 'polymorphic ' ELSE '' END||'reference ('||array_to_string(list_filter([CASE WHEN dec IS NOT NULL THEN 'declared on '||{_list('dec', 'and')} END, CASE WHEN inh IS NOT NULL THEN 'inherited by '||{_list('inh', 'and')} END], lambda x: x IS NOT NULL), '; ')||') that '||CASE WHEN len(targets) > 1 THEN 'can point to: '||{_list('targets', 'or')} ELSE 'points to '||targets[1] END||'.'"""
_REL = """rel AS (SELECT t.edge_id, t.attribute, split_part(t.edge_id, '::', 2) AS fk_name, f.label AS frm, bool_or(t.is_polymorphic) AS poly,
  list(g.label ORDER BY CASE WHEN t.to_id LIKE 'customer%' THEN 0 ELSE 1 END) AS tos FROM targets t JOIN labels_ f ON f.entity_id = t.from_id
  JOIN labels_ g ON g.entity_id = t.to_id WHERE NOT t.is_audit GROUP BY 1, 2, 3, 4),
reltext AS (SELECT 'rel:'||edge_id AS chunk_id, CASE
  WHEN poly THEN frm||' has a many-to-one polymorphic relationship via attribute '||attribute||' (foreign key '||fk_name||'): '||attribute||' can refer to '||array_to_string(tos, ' or ')||'. Each '||frm||' record refers to one record of one of these types. Reverse: an '||array_to_string(tos, ' or ')||' can be referred to by many '||frm||' records.'
  ELSE frm||' has a many-to-one relationship to '||tos[1]||': each '||frm||' refers to one '||tos[1]||', via attribute '||attribute||' (foreign key '||fk_name||'). Reverse: an '||tos[1]||' can have many '||frm||' records.' END AS text FROM rel)"""
_QUESTIONS = J.PAIRS + """, questions AS (SELECT 'p'||pair_id AS question_id, 'How does '||name_a||' relate to '||name_b||'?' AS question FROM pairs
  UNION ALL SELECT 's'||c_custkey, 'Which nation facts does E'||c_custkey||' have?' FROM customer
  UNION ALL SELECT 'a'||n_nationkey, 'What can the nationkey attribute point to?' FROM nation UNION ALL SELECT 'v'||conv_id||'_'||turn, text
  FROM conversations WHERE role = 'user'),
qwords AS (SELECT question_id, lower(w[i]) AS word, i FROM (SELECT question_id, regexp_extract_all(question, '[\\pL\\pN_\\pM]+') AS w FROM questions),
  unnest(range(1, len(w) + 1)) AS r(i)),
ment AS (SELECT question_id, name, row_number() OVER (PARTITION BY question_id ORDER BY min(i), name) AS rank FROM qwords JOIN (SELECT DISTINCT name
  FROM nodes) ON lower(name) = word GROUP BY question_id, name)"""
_ROUTES = """tk AS (SELECT DISTINCT token FROM (SELECT name AS token FROM det UNION SELECT fk_name FROM det)), tm AS (SELECT question_id,
  count(DISTINCT token) AS m, arg_min(token, i) AS t1 FROM qwords JOIN tk ON lower(token) = word GROUP BY 1),
routes AS (SELECT question_id, CASE WHEN n >= 2 THEN 'pair' WHEN n = 1 THEN 'single' WHEN m = 1 THEN 'attribute' ELSE 'vector' END AS route, CASE
  WHEN n >= 1 THEN e1 WHEN m = 1 THEN t1 END AS first, CASE WHEN n >= 2 THEN e2 END AS second
  FROM questions LEFT JOIN (SELECT question_id, count(*) AS n, max(name) FILTER (rank = 1) AS e1, max(name) FILTER (rank = 2) AS e2 FROM ment
  GROUP BY 1) USING (question_id) LEFT JOIN tm USING (question_id))"""
_ITEM = "name||' ('||CASE WHEN fk_name IS NOT NULL THEN 'reference to '||replace(fk_targets, ',', '/') ELSE data_type END||')'||CASE WHEN description IS NOT NULL THEN ': '||description ELSE '' END"
_LINES = f"""disp AS (SELECT entity_id, name||' ('||layer||')' AS shown FROM nodes), cn AS (SELECT n.entity_id,
  count(r.name) FILTER (origin = 'own') AS own, count(r.name) FILTER (origin = 'inherited') AS inh FROM nodes n LEFT JOIN resolved r USING (entity_id)
  GROUP BY 1),
passed AS (SELECT r.*, d.shown AS base, min(pos) OVER (PARTITION BY r.entity_id, d.shown) AS first FROM resolved r
  JOIN disp d ON d.entity_id = r.declared_in WHERE origin = 'inherited'),
links AS (SELECT from_id AS entity_id, 'out/'||edge_id AS pos, '- (outgoing) refers to '||string_agg(DISTINCT d.shown, ', '
  ORDER BY d.shown)||' via attribute '||attribute||' (foreign key '||split_part(edge_id, '::', 2)||')'||CASE
  WHEN bool_or(is_polymorphic) THEN ' (polymorphic: any one of these)' ELSE '' END AS line FROM targets t JOIN disp d ON d.entity_id = t.to_id
  WHERE NOT is_audit GROUP BY edge_id, from_id, attribute
  UNION ALL SELECT to_id, 'in/'||edge_id,
  '- (incoming) is referred to by '||any_value(d.shown)||' via attribute '||attribute||' (foreign key '||split_part(edge_id, '::', 2)||')'||CASE
  WHEN bool_or(is_polymorphic) THEN ' (polymorphic: any one of these)' ELSE '' END FROM targets t JOIN disp d ON d.entity_id = t.from_id
  WHERE NOT is_audit GROUP BY edge_id, to_id, attribute),
nl AS (SELECT n.entity_id, count(l.pos) AS n FROM nodes n LEFT JOIN links l USING (entity_id) GROUP BY 1),
lines AS (SELECT entity_id, 0 AS section, '' AS pos, name||' ('||layer||'), a '||layer||'-layer entity.' AS line FROM nodes UNION ALL
  SELECT entity_id, 1, '', replace(entity_id, '#', ' ') FROM nodes
  UNION ALL SELECT n.entity_id, 2, '', 'Note: '||n.name||' also exists in other layers: '||string_agg(d.shown, ', ' ORDER BY d.shown)||'.'
  FROM nodes n JOIN nodes m ON m.name = n.name AND m.entity_id <> n.entity_id JOIN disp d ON d.entity_id = m.entity_id GROUP BY n.entity_id, n.name
  UNION ALL SELECT n.entity_id, 3, '', 'Full parent chain (immediate ancestor first): '||coalesce(up.line, '(none)')||'.' FROM nodes n LEFT
  JOIN (SELECT c.entity_id, string_agg(d.shown, ' -> ' ORDER BY c.depth) AS line FROM chain c JOIN disp d ON d.entity_id = c.ancestor_id
  WHERE c.depth > 0 GROUP BY 1) up USING (entity_id)
  UNION ALL SELECT entity_id, 4, '', CASE WHEN own > 0 THEN 'Own attributes, full list ('||own||'):' ELSE 'Own attributes: none.' END FROM cn
  UNION ALL SELECT entity_id, 4, lpad(CAST(pos AS VARCHAR), 9, '0'), '- '||{_ITEM} FROM resolved WHERE origin = 'own'
  UNION ALL SELECT entity_id, 5, '', CASE WHEN inh > 0 THEN 'Inherited attributes, full list by ancestor ('||inh||' total):'
  ELSE 'Inherited attributes: none.' END FROM cn UNION ALL SELECT entity_id, 5, lpad(CAST(first AS VARCHAR), 9, '0'),
  '- from '||base||' ('||count(*)||'):' FROM passed GROUP BY entity_id, base, first
  UNION ALL SELECT entity_id, 5, lpad(CAST(first AS VARCHAR), 9, '0')||'/'||lpad(CAST(pos AS VARCHAR), 9, '0'), '  - '||{_ITEM} FROM passed
  UNION ALL SELECT entity_id, 6, '', 'Standard audit fields ('||count(*)||'): '||string_agg(name, ', ' ORDER BY pos)||'.' FROM resolved
  WHERE origin = 'standard' GROUP BY 1
  UNION ALL SELECT entity_id, 7, '', CASE WHEN n > 0 THEN 'Relationships, non-audit, both directions ('||n||'):' ELSE 'Relationships: none.' END
  FROM nl UNION ALL SELECT entity_id, 7, pos, line FROM links)"""
_PAIR_ITEMS = """pr AS (SELECT question_id AS pair_id, first AS name_a, second AS name_b FROM routes WHERE route = 'pair'),
dir AS (SELECT DISTINCT pair_id, edge_id FROM pr JOIN targets ON (name_a = from_name AND name_b = to_name) OR (name_b = from_name
  AND name_a = to_name)),
op AS (SELECT * FROM pr WHERE pair_id NOT IN (SELECT pair_id FROM dir)), party AS (SELECT DISTINCT to_name FROM targets WHERE is_polymorphic),
  bt AS (SELECT t.*, to_name IN (SELECT to_name FROM party) AS party FROM targets t WHERE NOT is_audit),
ms AS (SELECT pair_id, 1 AS section, edge_id, attribute, name_b AS missing, to_name, party FROM op JOIN bt ON name_a = from_name UNION ALL
  SELECT pair_id, 2, b.edge_id, b.attribute, name_a, b.to_name, b.party FROM (SELECT DISTINCT pair_id, name_a, edge_id FROM op
  JOIN bt ON name_b = to_name) i JOIN bt b USING (edge_id)),
mg AS (SELECT pair_id, section, edge_id, bool_or(contains(lower(attribute), lower(missing)) OR contains(lower(to_name), lower(missing))) AS lexical,
  bool_or(party) AS structural FROM ms GROUP BY 1, 2, 3),
mr AS (SELECT *, row_number() OVER (PARTITION BY pair_id, section ORDER BY lexical DESC, structural DESC, edge_id) AS rank FROM mg WHERE lexical
  OR structural QUALIFY rank <= 5),
told AS (SELECT DISTINCT t.edge_id, x.text, t.from_name AS entity, t.attribute FROM targets t JOIN reltext x ON x.chunk_id = 'rel:'||t.edge_id),
pair_items AS (SELECT pair_id AS question_id, 0 AS section, edge_id AS ord, text, 'relationship' AS chunk_type, 'direct_edge' AS source, entity,
  attribute, false AS is_audit FROM dir JOIN told USING (edge_id)
  UNION ALL SELECT pair_id, section, lpad(CAST(rank AS VARCHAR), 3, '0'), text, 'relationship', 'near_miss', entity, attribute, false FROM mr
  JOIN told USING (edge_id))"""
_BRIEF = "CASE WHEN contains(description, '. ') THEN split_part(description, '. ', 1)||'.' ELSE description END"
_ENTITY_TEXT = f"""eown AS (SELECT entity_id, count(*) AS n, string_agg(CASE WHEN r <= 4 THEN told ELSE plain END, '; ' ORDER BY pos) AS line
  FROM (SELECT entity_id, pos, name||' ('||CASE WHEN fk_name IS NOT NULL THEN 'reference to '||replace(fk_targets, ',', '/') ELSE data_type END||')' AS plain,
  plain||coalesce(': '||{_BRIEF}, '') AS told, row_number() OVER (PARTITION BY entity_id ORDER BY pos) AS r FROM resolved WHERE origin = 'own') GROUP BY 1),
epass AS (SELECT entity_id, sum(n) AS n, string_agg(n||' from '||base||' ('||names||CASE WHEN n > 8 THEN ', +'||(n - 8)||' more' ELSE '' END||')', '; '
  ORDER BY first) AS line FROM (SELECT entity_id, base, count(*) AS n, min(pos) AS first, string_agg(name, ', ' ORDER BY pos) FILTER (r <= 8) AS names
  FROM (SELECT r.entity_id, r.name, pos, d.name||' ('||d.layer||')' AS base, row_number() OVER (PARTITION BY r.entity_id, declared_in ORDER BY pos) AS r
  FROM resolved r JOIN nodes d ON d.entity_id = r.declared_in WHERE origin = 'inherited') GROUP BY 1, 2) GROUP BY 1),
estd AS (SELECT entity_id, count(*) AS n, string_agg(field, ', ' ORDER BY pos) FILTER (r <= 4) AS line FROM (SELECT entity_id, pos, CASE
  WHEN fk_name IS NOT NULL AND fk_name <> 'id' THEN fk_name ELSE name END AS field, row_number() OVER (PARTITION BY entity_id ORDER BY pos) AS r
  FROM resolved WHERE origin = 'standard') GROUP BY 1),
erel AS (SELECT entity_id, count(*) AS n, string_agg(label, ', ' ORDER BY r) FILTER (r <= 12) AS line FROM (SELECT from_id AS entity_id, label,
  row_number() OVER (PARTITION BY from_id ORDER BY min(edge_id), label) AS r FROM targets t JOIN labels_ l ON l.entity_id = t.to_id WHERE NOT is_audit
  GROUP BY from_id, label) GROUP BY 1),
eup AS (SELECT c.entity_id, string_agg(n.name||' ('||n.layer||')', ' → ' ORDER BY depth) AS line FROM chain c JOIN nodes n ON n.entity_id = c.ancestor_id
  WHERE depth > 0 GROUP BY 1),
etext AS (SELECT 'entity:'||n.entity_id AS chunk_id, n.name, n.layer, concat_ws(E'\\n', n.name||' ('||layer||') is an entity in the '||layer||
  ' layer of the catalog. '||replace(n.entity_id, '#', ' '), coalesce('Parent chain: '||eup.line||'.', 'It has no parent entity.'),
  coalesce('Own attributes ('||eown.n||'): '||eown.line||'.', 'Own attributes: none.'), 'Inherited attributes ('||epass.n||'): '||epass.line||'.',
  'Standard audit fields: '||estd.n||' common system fields such as '||estd.line||'.',
  'Related entities: '||erel.line||CASE WHEN erel.n > 12 THEN ', and '||(erel.n - 12)||' more' ELSE '' END||'.') AS text FROM nodes n LEFT
  JOIN eup USING (entity_id) LEFT JOIN eown USING (entity_id) LEFT JOIN epass USING (entity_id) LEFT JOIN estd USING (entity_id) LEFT
  JOIN erel USING (entity_id))"""


def _vectors(name: str, rows: str, key: str, text: str) -> str:
    """SQL of the hashing model: ``name`` with id and u of the rows."""
    sums = ", ".join(f"CAST(coalesce(sum(s) FILTER (d = {i}), 0) AS FLOAT)" for i in range(V.DIMENSIONS))
    return f"""{name}w AS (SELECT {key} AS id, h % {V.DIMENSIONS} AS d, CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END AS s FROM (SELECT {key},
  CAST('0x'||left(md5(w), 8) AS BIGINT) AS h FROM (SELECT {key}, unnest(string_split_regex(lower({text}), '\\s+')) AS w FROM {rows}) WHERE w <> '')),
{name}n AS (SELECT id, [{sums}] AS v FROM {name}w GROUP BY 1),
{name} AS (SELECT id, CAST(list_transform(v, lambda x: CAST(x / CAST(sqrt(CAST(list_inner_product(v, v) AS DOUBLE)) AS FLOAT) AS DOUBLE)) AS DOUBLE[{V.DIMENSIONS}]) AS u
  FROM {name}n)"""


_SEARCH = f"""{_ENTITY_TEXT}, idx AS (SELECT chunk_id, 'entity' AS chunk_type, text, name, layer, name AS owner, CAST(NULL AS VARCHAR) AS attribute FROM etext
  WHERE layer <> 'region' UNION ALL SELECT x.chunk_id, 'relationship', x.text, NULL, NULL, f.name, r.attribute FROM reltext x
  JOIN rel r ON x.chunk_id = 'rel:'||r.edge_id JOIN nodes f ON f.entity_id = split_part(r.edge_id, '::', 1)
  UNION ALL SELECT 'attribute:'||name, 'attribute', {_ATTRIBUTE_TEXT}, NULL, NULL, NULL, name FROM det),
{_vectors('cv', 'idx', 'chunk_id', 'text')},
asked AS (SELECT question_id, '{V.PREFIX}'||question AS t FROM questions), {_vectors('qv', 'asked', 'question_id', 't')},
best AS (SELECT q.id, min(row(CAST(round(array_cosine_distance(q.u, c.u) * 1e9) AS BIGINT), c.id), {K + V.OVERFETCH}) AS m FROM qv q, cv c GROUP BY 1),
near AS (SELECT id AS question_id, m[i][2] AS chunk_id, i AS r FROM best, unnest(range(1, len(m) + 1)) AS u(i)),
own AS (SELECT question_id, r.first AS name, entity_id, layer FROM routes r JOIN nodes n ON n.name = r.first WHERE route = 'single'
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY list_position(['orders','customer','supplier','part','nation','region'], layer),
  entity_id) = 1)"""
_COLLISIONS = r"""spelt AS (SELECT question_id, w[i] AS word, i FROM (SELECT question_id, regexp_extract_all(question, '[\pL\pN_\pM]+') AS w FROM questions),
  unnest(range(1, len(w) + 1)) AS r(i)),
collisions AS (SELECT question_id, arg_min(word, row(depth, i)) AS word, arg_min(layer, row(depth, i)) AS layer FROM (SELECT r.question_id, n.entity_id
  FROM routes r JOIN nodes n ON n.name = r.first WHERE route = 'single' QUALIFY row_number() OVER (PARTITION BY r.question_id
  ORDER BY list_position(['orders','customer','supplier','part','nation','region'], layer), n.entity_id) = 1) o JOIN chain c USING (entity_id)
  JOIN nodes a ON a.entity_id = c.ancestor_id JOIN spelt USING (question_id) WHERE depth > 0 AND lower(word) = lower(a.layer) AND length(word) > 2 GROUP BY 1)"""
_RETRIEVAL = f"{J.RESOLVED}, {J.TARGETS}, {_LABELS}, {_REL}, {_DET}, {_QUESTIONS}, {_ROUTES}, {_SEARCH}"
_FOUND = f"""vm AS (SELECT n.question_id, i.text, min(r) AS r, arg_min(i.chunk_type, r) AS chunk_type, arg_min(i.owner, r) AS owner,
  arg_min(i.attribute, r) AS attribute FROM near n JOIN idx i USING (chunk_id) LEFT JOIN own o USING (question_id)
  WHERE (r <= {K} OR o.name IS NOT NULL) AND NOT coalesce(i.chunk_type = 'entity' AND i.name = o.name AND i.layer <> o.layer, false)
  AND NOT EXISTS (FROM structural s WHERE s.question_id = n.question_id AND s.text = i.text) GROUP BY 1, 2),
found AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY r) AS rank FROM vm QUALIFY rank <= {K})"""
_CONTEXT = f"""{_RETRIEVAL}, {_LINES}, {_PAIR_ITEMS},
texts AS (SELECT entity_id, string_agg(line, E'\\n' ORDER BY section, pos, line) AS text FROM lines WHERE entity_id IN (SELECT entity_id FROM own)
  GROUP BY 1),
attribute_items AS (SELECT question_id, 0 AS section, '' AS ord, {_ATTRIBUTE_TEXT} AS text, 'attribute' AS chunk_type, 'attribute_lookup' AS source,
  CAST(NULL AS VARCHAR) AS entity, name AS attribute, CAST(NULL AS BOOLEAN) AS is_audit FROM (SELECT DISTINCT r.question_id, d.* FROM routes r
  JOIN det d ON r.first IN (d.name, d.fk_name) WHERE route = 'attribute')),
structural AS (SELECT * FROM pair_items UNION ALL SELECT question_id, 0, '', text, 'entity_detail', 'entity_lookup', name, NULL, NULL FROM own
  JOIN texts USING (entity_id) UNION ALL SELECT * FROM attribute_items),
{_FOUND},
allitems AS (SELECT question_id, 1 AS part, section, ord, text, chunk_type, source, entity, attribute, is_audit FROM structural
  UNION ALL SELECT question_id, 3, 0, lpad(CAST(rank AS VARCHAR), 6, '0'), text, chunk_type, 'vector_search', owner, attribute, NULL FROM found
  UNION ALL SELECT question_id, 0, 0, '', CASE route WHEN 'pair' THEN 'Facts about '||first||' and '||second||' from the graph:'
  WHEN 'single' THEN 'Full record of '||first||' from the graph:' ELSE 'Facts about the attribute '||first||' from the graph:' END, 'section_header',
  'section_header', NULL, NULL, NULL FROM routes WHERE question_id IN (SELECT question_id FROM structural)
  UNION ALL SELECT DISTINCT question_id, 2, 0, '', 'Further passages from search:', 'section_header', 'section_header', NULL, NULL, NULL FROM found
  WHERE question_id IN (SELECT question_id FROM structural)),
context AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY part, section, ord, text) AS pos FROM allitems)"""
_LAST = "last AS (SELECT conv_id AS number, 'cat'||conv_id % 9 AS category, text AS answer, conv_id % 4 = 3 AS manual, turn AS run_ts FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)"
_CUT = "CASE WHEN coalesce(trim(answer, E' \\t\\n\\r'), '') = '' THEN 'empty' WHEN lower(list_extract(regexp_extract_all(core, '[A-Za-z'']+'), -1)) IN (" + ", ".join(f"'{w}'" for w in E.DANGLING) + ") THEN 'dangling' WHEN NOT contains('.!?)]}\"''|', right(core, 1)) THEN 'open' END"
_JUDGED = _LAST + f", judged AS (SELECT *, CASE WHEN NOT manual THEN ({_CUT}) IS NULL AND length(answer) > 200 END AS passed FROM (SELECT *, regexp_replace(rtrim(answer, E' \\t\\n\\r'), '[*_`]+$', '') AS core FROM last))"

#: A request after the other of each key, with the times of those admitted before.
_ADMITTED = """WITH RECURSIVE e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS key, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
w AS (SELECT event_id, key, ts, r, true AS admitted, [ts] AS held FROM e WHERE r = 1
  UNION ALL SELECT event_id, key, ts, r, len(live) < 2, CASE WHEN len(live) < 2 THEN list_append(live, ts) ELSE live END
  FROM (SELECT e.*, list_filter(w.held, lambda h: e.ts - h <= INTERVAL 24 HOURS) AS live FROM w JOIN e ON e.key = w.key AND e.r = w.r + 1))
SELECT event_id, key, ts, admitted FROM w"""

ORACLE_SQL = {
    "c1_token_estimates": f"{_W}{_TOKENS} SELECT doc_id, CAST(n_tokens AS BIGINT) AS n_tokens FROM tok",
    "c2_short_texts": r"""WITH f AS (SELECT doc_id, regexp_extract(trim(text), '(?s)^(.*?[.!?])\s', 1) AS a, trim(text) AS t FROM documents),
    g AS (SELECT doc_id, CASE WHEN a = '' THEN t ELSE a END AS s FROM f), h AS (SELECT doc_id, s, left(s, 48) AS c FROM g)
      SELECT doc_id, CASE WHEN length(s) <= 48 THEN s ELSE regexp_replace(CASE WHEN contains(c, ' ') THEN regexp_replace(c, '(?s) [^ ]*$', '')
      ELSE c END, '[,;:]+$', '')||'…' END AS short FROM h""",
    "c3_identifier_helpers": "SELECT p_partkey, lower(split_part(p_name, ' ', 1)||' '||split_part(p_name, ' ', 2)) AS humanized, lower(split_part(p_name, ' ', 1)) AS qualifier, CASE WHEN left(lower(p_name), 1) IN ('a','e','i','o','u') THEN 'an' ELSE 'a' END AS article, p_brand||', '||p_type||' or '||p_name AS listed FROM part",
    "c4_representative": f"{_W}{J.RESOLVED}, u AS (SELECT entity_id, name, pos, pos % 3 = 0 AS shadow, min(CASE WHEN pos % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id) AS lone FROM resolved), v AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY pos) AS r FROM u WHERE NOT shadow OR lone = 1) SELECT entity_id, string_agg(name||CASE WHEN shadow THEN 'Base' ELSE '' END, ',' ORDER BY pos) AS names FROM v WHERE r <= 3 GROUP BY 1",
    "c5_labels": f"{_W}{J.NODES}, {_LABELS} SELECT entity_id, label FROM labels_",
    "c6_entity_chunks": f"{_W}{J.RESOLVED}, {J.TARGETS}, {_LABELS}, {_ENTITY_TEXT} SELECT chunk_id, text FROM etext",
    "v3_question_hits": f"{_W}{_RETRIEVAL} SELECT question_id, chunk_id, r AS rank FROM near WHERE r <= {K}",
    "v4_other_layers": f"""{_W}{_RETRIEVAL} SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY r) AS rank FROM near
    JOIN idx i USING (chunk_id) JOIN own o USING (question_id) WHERE NOT (i.chunk_type = 'entity' AND i.name = o.name AND i.layer <> o.layer)
      QUALIFY rank <= {K}""",
    "c7_relationship_chunks": f"{_W}{J.NODES}, {J.TARGETS}, {_LABELS}, {_REL} SELECT * FROM reltext",
    "c8_attribute_chunks": f"{_W}{J.RESOLVED}, {_DET} SELECT 'attribute:'||name AS chunk_id, {_ATTRIBUTE_TEXT} AS text FROM det",
    "c6_within_budget": f"""{_W}{J.RESOLVED}, {J.TARGETS} SELECT 'entity:'||entity_id AS chunk_id, true AS fits,
    3 + count(*) FILTER (origin = 'inherited' AND r = 1) + count(*) FILTER (origin = 'standard' AND r = 1) + any_value(CASE
    WHEN entity_id IN (SELECT from_id FROM targets WHERE NOT is_audit) THEN 1 ELSE 0 END) AS n_lines
      FROM nodes LEFT JOIN (SELECT entity_id, origin, row_number() OVER (PARTITION BY entity_id, origin) AS r FROM resolved) USING (entity_id)
      GROUP BY entity_id""",
    "c9_index_input": f"{_W}{J.RESOLVED}, {J.TARGETS}, {_LABELS}, {_REL}, {_DET} SELECT name, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT split_part(substr(chunk_id, 5), '#', 1) AS name, text FROM reltext UNION ALL SELECT 'attribute', {_ATTRIBUTE_TEXT} FROM det UNION ALL SELECT 'entity/'||layer, '' FROM nodes WHERE layer <> 'region') GROUP BY 1",
    "c10_index_metadata": f"""{_W}{J.RESOLVED}, {J.TARGETS}, {_DET}, cnt AS (SELECT entity_id, count(*) FILTER (origin = 'own') AS own,
    count(*) FILTER (origin = 'inherited') AS inherited, count(*) FILTER (origin = 'standard') AS standard, count(*) AS total FROM resolved
    GROUP BY 1)
      SELECT 'rel:'||edge_id AS chunk_id, 'attribute,chunk_type,fk_name,from_id,is_audit,targets' AS keys, string_agg(to_id, ',' ORDER BY CASE
      WHEN to_id LIKE 'customer%' THEN 0 ELSE 1 END) AS targets, '' AS counts, '' AS parent_id FROM targets WHERE NOT is_audit GROUP BY 1
      UNION ALL SELECT 'attribute:'||name, 'attribute,chunk_type,fk_name,targets', array_to_string(targets, ','), '', '' FROM det
      UNION ALL SELECT 'entity:'||entity_id, 'attribute_count,chunk_type,document,entity_id,layer,name'||CASE
      WHEN parent_id IS NOT NULL THEN ',parent_id' ELSE '' END, '', printf('{{"own":%d,"inherited":%d,"standard":%d,"total":%d}}', own, inherited,
      standard, total), coalesce(parent_id, '') FROM nodes JOIN cnt USING (entity_id) WHERE layer <> 'region'""",
    "v1_embeddings": "SELECT doc_id, 64 AS dimensions, CASE WHEN regexp_matches(text, '\\S') THEN 1.0 ELSE 0.0 END AS norm FROM documents",
    "v2_over_length": f"{_W}{_TOKENS} SELECT doc_id, CAST(n_tokens AS BIGINT) AS n_tokens FROM tok WHERE n_tokens > 512",
    "v3_top_k": "SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9), c.vec_id) AS rank FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5",
    "v4_filtered_search": "WITH h AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, q.label AS ql, c.label AS cl, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9), c.vec_id) AS r FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 QUALIFY r <= 15) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM h WHERE ql <> cl QUALIFY rank <= 5",
    "d1_mentions": f"{_W}{J.NODES}, {_QUESTIONS} SELECT * FROM ment",
    "d2_routes": f"{_W}{J.RESOLVED}, {_DET}, {_QUESTIONS}, {_ROUTES} SELECT * FROM routes",
    "d3_pair_context": f"{_W}{_CONTEXT} SELECT question_id, section, ord, text, chunk_type, source, entity, attribute FROM pair_items",
    "d4_entity_lines": f"{_W}{J.RESOLVED}, {J.TARGETS}, {_LINES} SELECT entity_id, section, pos, line FROM lines",
    "d5_attribute_context": f"{_W}{_CONTEXT} SELECT question_id, text, source, attribute FROM attribute_items",
    "d6_layer_collisions": f"{_W}{J.RESOLVED}, {_DET}, {_QUESTIONS}, {_ROUTES}, {_COLLISIONS} SELECT * FROM collisions",
    "d7_contexts": f"{_W}{_CONTEXT} SELECT question_id, pos, text, chunk_type, source FROM context",
    "d8_prompts": f"""{_W}{_CONTEXT}, {_COLLISIONS}, block AS (SELECT question_id, string_agg('['||pos||'] ('||chunk_type||') '||text, E'\\n\\n'
    ORDER BY pos) AS block FROM context GROUP BY 1)
      SELECT question_id, '{D.SYSTEM.replace("'",
      "''")}'||coalesce(E'\\n\\nThe word "'||word||'" may also mean the layer "'||layer||'"; name both readings and answer for each.', '') AS system,
      coalesce(block, '{D.EMPTY}')||E'\\n\\nQuestion: '||question AS prompt
      FROM questions JOIN routes USING (question_id) LEFT JOIN block USING (question_id) LEFT JOIN collisions USING (question_id)""",
    "d9_source_trace": f"{_W}{_CONTEXT} SELECT question_id, pos, entity, chunk_type, source, attribute, is_audit FROM context",
    "e1_phrases": "WITH a AS (SELECT conv_id AS number, turn AS run_ts, list_filter([" + ", ".join(f"'{p}'" for p in PHRASES) + "], lambda p: contains(lower(text), p)) AS hit FROM conversations WHERE role = 'assistant') SELECT number, run_ts, hit[1] AS phrase, CAST(len(hit) AS BIGINT) AS n_mentioned FROM a",
    "e2_context_items": f"{_W}{J.TARGETS} SELECT from_id AS question_id, bool_or(attribute = 'party' AND NOT is_audit) AS found FROM targets GROUP BY 1",
    "e3_truncation": f"WITH a AS (SELECT conv_id AS number, turn AS run_ts, text AS answer, regexp_replace(rtrim(text, E' \\t\\n\\r'), '[*_`]+$', '') AS core FROM conversations WHERE role = 'assistant') SELECT number, run_ts, {_CUT} AS truncation FROM a",
    "e4_ground_truth": f"{_W}{J.RESOLVED}, {J.TARGETS}, {_DET} SELECT 'referring' AS kind, to_id AS key, from_name AS member FROM targets UNION SELECT 'layer', layer, name FROM nodes UNION SELECT 'targets', name, unnest(targets) FROM det",
    "e5_verdicts": f"{_W}{_JUDGED} SELECT number, passed FROM judged",
    "e6_category_summary": f"{_W}{_JUDGED} SELECT category, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, count(*) FILTER (manual) AS manual, count(*) AS total FROM judged GROUP BY ROLLUP (category)",
    "e7_timing_table": "WITH p AS (SELECT user_id AS number, round(sum(value) FILTER (event_type = 'click'), 6) AS click, round(sum(value) FILTER (event_type = 'view'), 6) AS \"view\", round(sum(value) FILTER (event_type = 'error'), 6) AS error, round(sum(value) FILTER (event_type = 'signup'), 6) AS signup FROM events GROUP BY 1) SELECT *, round(click + \"view\", 6) AS click_view, round(coalesce(click, 0) + coalesce(\"view\", 0) + coalesce(error, 0) + coalesce(signup, 0), 6) AS total FROM p",
    "e8_latest_results": f"{_W}{_LAST} SELECT number, run_ts, length(answer) AS n FROM last",
    "d1_phrases": """WITH q AS (SELECT p_partkey AS question_id, lower('Is '||p_name||', a '||p_type||' of '||p_brand||', sold?') AS t FROM part),
    n AS (SELECT p_name AS name FROM part WHERE p_partkey % 3 = 0 UNION SELECT p_type FROM part UNION SELECT p_brand FROM part),
    apart AS (SELECT question_id, t, ' '||regexp_replace(t, '([^\\pL\\pN_])', ' \\1 ', 'g')||' ' AS x FROM q),
    m AS (SELECT question_id, name, strpos(t, lower(name)) AS place FROM apart JOIN (SELECT name, ' '||regexp_replace(lower(name), '([^\\pL\\pN_])',
      ' \\1 ', 'g')||' ' AS y FROM n) ON contains(x, y))
      SELECT question_id, name, row_number() OVER (PARTITION BY question_id ORDER BY place, name) AS rank FROM m""",
    "t1_admission": _ADMITTED,
    "t1_admission_stream": _ADMITTED,
    "e8_missing_numbers": "WITH a AS (SELECT DISTINCT conv_id AS n FROM conversations WHERE role = 'assistant' AND conv_id % 7 <> 3) SELECT number FROM (SELECT unnest(range(min(n), max(n) + 1)) AS number FROM a) WHERE number NOT IN (SELECT n FROM a)",
}
