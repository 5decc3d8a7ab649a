"""Stored indexes and results, file trees, search with filters, phrases and admission of hot keys."""

import datetime
import os
import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cataloom.functions import text as T
from cataloom.jobs import graph_jobs, registry
from cataloom.operators import evaluation as E
from cataloom.operators import routing as D
from cataloom.operators import vectors as V
from cataloom.sources import index as I
from cataloom.sources import schema_documents as S
from cataloom.sources import shared, versions
from cataloom.streaming import throttle


def failing(rows):
    """Rows of which one can't be made."""
    return rows.withColumn("text", F.when(F.col("chunk_id") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("text")))


def chunks(spark, *rows):
    return spark.createDataFrame(list(rows), "chunk_id string, chunk_type string, text string")


def test_an_index_survives_a_build_that_fails(spark, tmp_path):
    place, rows = str(tmp_path / "index"), chunks(spark, ("a", "x", "one"), ("b", "y", "two"))
    first = I.open_or_build(rows, place, "m1")
    again = I.open_or_build(rows.where("false"), place, "m1")
    assert first.built and not again.built and again.rows.count() == 2
    with pytest.raises(Exception, match="lost"):
        I.build(failing(rows), place, "m2")
    after = I.open_or_build(rows, place, "m1")
    assert not after.built and sorted(r.text for r in after.rows.collect()) == ["one", "two"]
    other = I.open_or_build(chunks(spark, ("c", "x", "three")), place, "m2")
    assert other.built and [(r.text, r.model) for r in other.rows.collect()] == [("three", "m2")]
    # A reader of the version before goes on with it.
    assert sorted(r.text for r in first.rows.collect()) == ["one", "two"]
    assert [v.number for v in [versions.current(spark, place)]] == [1]


def test_results_are_upserted_run_by_run(spark, tmp_path):
    place = str(tmp_path / "results")
    run = lambda *rows: spark.createDataFrame(list(rows), "number long, run_ts long, answer string")
    assert E.stored(spark, place) is None
    E.upserted(run((1, 5, "a"), (2, 5, "b")), place)
    E.upserted(run((2, 4, "older"), (3, 6, "c")), place)
    with pytest.raises(Exception, match="lost"):
        E.upserted(run((9, 9, "x")).withColumn("answer", F.raise_error(F.lit("lost"))), place)
    E.upserted(run((1, 7, "newer")), place)
    assert sorted(map(tuple, E.stored(spark, place).collect())) == [(1, 7, "newer"), (2, 5, "b"), (3, 6, "c")]


@pytest.mark.parametrize("numbers", [[3, 4, 9, 9, 12], [5], [], [0, 2_100_000], [-7, -3, 0]])
def test_missing_numbers(spark, numbers):
    rows = spark.createDataFrame([(n,) for n in numbers], "number int")
    got = sorted(r[0] for r in E.missing_numbers(rows).collect())
    assert got == sorted(set(range(min(numbers, default=0), max(numbers, default=-1) + 1)) - set(numbers))


def test_a_tree_of_files(spark, tmp_path):
    root = tmp_path / "corpus"
    docs = [("a/corpus/x.cdm.json", "{}"), ("_all.cdm.json", '{"imports": []}'), ("b c/ü+1%20.json", '{"k": "日"}'), ("bad/1.json", '{"imports": ['), ("bad/2.json", "[1]"), ("bad/3.json", " ")]
    assert S.write_tree(spark.createDataFrame(docs, "path string, json string").repartition(3), str(root)) == len(docs)
    (root / "bad/4.json").write_bytes(b"\xff\xfe")
    (root / "bad/5.json.part").write_text("{}")
    os.symlink(root / "nowhere", root / "bad/6.json")
    got = {r.path: (r.json, r.reason) for r in S.read_tree(spark, str(root)).collect()}
    want = {p: (j, None) for p, j in docs[:3]} | {"bad/1.json": (docs[3][1], "not JSON"), "bad/2.json": ("[1]", "not an object"), "bad/3.json": (" ", "empty"), "bad/4.json": (None, "not UTF-8")}
    assert {p: v for p, v in got.items() if p != "bad/6.json"} == want
    assert S.loaded(spark.createDataFrame([("gone.json", 1, 1)], S.LISTING), str(root)).first().reason == "unreadable"


def test_a_tree_is_read_again_where_it_changed(spark, tmp_path):
    root, place = str(tmp_path / "tree"), str(tmp_path / "documents")
    write = lambda *rows: S.write_tree(spark.createDataFrame(list(rows), "path string, json string"), root)
    write(("a.json", "{}"), ("d/b.json", "{}"), ("c.json", "{}"))
    S.refreshed(spark, root, place)
    time.sleep(0.05)
    write(("d/b.json", '{"n": 1}'), ("e.json", "{}"))
    os.remove(f"{root}/c.json")
    got = sorted((r.path, r.read_in, r.json) for r in S.refreshed(spark, root, place).collect())
    assert got == [("a.json", 0, "{}"), ("d/b.json", 1, '{"n": 1}'), ("e.json", 1, "{}")]


def test_tables_derived_once_follow_their_files(spark, tmp_path):
    folder = str(tmp_path / "sf")
    build = lambda: spark.read.parquet(f"{folder}/t.parquet").select((F.col("id") * 2).alias("x"))
    seen = []
    for n in (3, 3, 5):
        if not seen or n != seen[-1]:
            time.sleep(0.05)
            spark.range(n).write.mode("overwrite").parquet(f"{folder}/t.parquet")
        seen.append(shared.written_once(spark, folder, "doubled", build).count())
    assert seen == [3, 3, 5]


def test_every_text_with_a_word_has_a_unit_vector(spark, tmp_path):
    words = ["w%d" % i for i in range(1000)]
    sums = {w: V.hashing_model([w])[0] for w in words}
    a, b = next((a, b) for a in words for b in words if not (sums[a] + sums[b]).any())
    texts = [f"{a} {b}", f"{b}\n{a} {a}\t{b}", "\u00a0", "\x0b", "word", "", " \t\n", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = {i: (n, float(x)) for i, n, x in con.execute(registry.ORACLE_SQL["v1_embeddings"]).fetchall()}
    got = {r["doc_id"]: (r["dimensions"], r["norm"]) for r in registry.QUERIES["v1_embeddings"](spark, str(tmp_path)).collect()}
    assert got == wanted and [got[i][1] for i in range(8)] == [1, 1, 1, 1, 1, 0, 0, 0]


def test_nearest_with_names_of_any_type_and_many_ties(spark):
    rng = np.random.default_rng(1)
    kinds = rng.integers(-1, 2, (9, 4)).astype(float)
    stored = [(f"c{i:04d}", [float(x) for x in kinds[rng.integers(9)]]) for i in range(3000)]
    rng.shuffle(stored)
    asked = [(f"q{i}", [float(x) for x in rng.integers(-1, 2, 4)]) for i in range(7)]
    hits = V.top_k(
        spark.createDataFrame(asked, "query_id string, vector array<float>"), spark.createDataFrame(stored, "chunk_id string, vector array<float>").repartition(3), 6, dimensions=4, at_once=3
    )
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, round(r.distance, 6)))
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    for name, q in asked:
        near = sorted((round(1 - float(unit(q) @ unit(v)), 9), c) for c, v in stored)[:6]
        assert got[name] == [(c, round(d, 6)) for d, c in near]


def test_queries_of_one_vector_are_searched_once(spark, monkeypatch):
    draw = np.random.default_rng(3)
    stored = draw.integers(-2, 3, (5000, 4)).astype(float)
    asked = np.repeat(draw.integers(-2, 3, (40, 4)).astype(float), 25, axis=0)
    rows = lambda vectors, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], f"{name} long, vector array<float>")
    sent = []
    broadcast = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: sent.append(len(x[0])) or broadcast(x))
    found = V.top_k(rows(asked, "query_id"), rows(stored, "chunk_id"), 7, 4).orderBy("query_id", "rank").collect()
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    far = np.rint((1 - unit(asked) @ unit(stored).T) * 1e9)
    nearest = np.argsort(far, axis=1, kind="stable")[:, :7]
    assert [r.chunk_id for r in found] == nearest.ravel().tolist()
    assert sum(sent) == len(np.unique(asked, axis=0)) <= 40


def test_contexts_of_attributes_and_layers_need_no_edges(spark, monkeypatch):
    def unwanted(*_):
        raise AssertionError("edges are read")

    monkeypatch.setattr(graph_jobs, "targets", unwanted)
    for name in ("d5_attribute_context", "d6_layer_collisions"):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count()


def test_search_fetches_more_for_those_that_run_short(spark):
    index = spark.createDataFrame([(f"c{i:02d}", [1.0, i / 100], f"text {i // 2}", {"n": str(i)}) for i in range(60)], "chunk_id string, vector array<float>, text string, metadata map<string,string>")
    asked = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.6])], "query_id string, vector array<float>")
    rounds = []

    def wanted(hits):
        rounds.append(hits.select("query_id").distinct().count())
        return hits.where("query_id = 'b' or int(metadata['n']) >= 40")

    got = V.filtered(asked, index, 3, wanted, overfetch=5, dimensions=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.text) for r in got] == [("a", 1, "text 20"), ("a", 2, "text 21"), ("a", 3, "text 22"), ("b", 1, "text 29"), ("b", 2, "text 28"), ("b", 3, "text 27")]
    assert rounds == [2, 1, 1, 1] and not V.filtered(asked, index, 3, lambda hits: hits.where("false"), dimensions=2).count()


def test_other_layers_are_left_out(spark):
    hit = lambda q, kind, name, layer: (q, {"chunk_type": kind, "name": name, "layer": layer})
    rows = [hit(1, "entity", "Account", "core"), hit(1, "entity", "Account", "banking"), hit(1, "entity", "Lead", "core"), hit(1, "relationship", "Account", "core"), hit(2, "entity", "Account", "core")]
    rows += [(1, {"chunk_type": "attribute"})]
    hits = spark.createDataFrame(rows, "query_id int, metadata map<string,string>")
    meant = spark.createDataFrame([(1, "Account", "banking")], "query_id int, name string, layer string")
    kept = D.other_layers(hits, meant).collect()
    assert len(kept) == 5 and all(r.query_id == 2 or r.metadata.get("layer") != "core" or r.metadata["name"] != "Account" or r.metadata["chunk_type"] != "entity" for r in kept)


def test_inherited_relationships_name_their_base(spark):
    nodes = spark.createDataFrame([("n1", "A (x)"), ("n2", "B (x)"), ("n3", "Base (x)")], "entity_id string, display_name string")
    edge = "edge_id string, from_id string, to_id string, to_name string, attribute string, fk_name string, is_audit boolean, is_polymorphic boolean, inherited_from string"
    targets = spark.createDataFrame([("e1", "n1", "n2", "B", "b", "bId", False, True, "n3"), ("e1", "n1", None, "Gone", "b", "bId", False, True, "n3"), ("e2", "n2", "n1", "A", "a", "aId", True, False, None)], edge)
    got = sorted((r.entity_id, r.line) for r in D.relationship_lines(nodes, targets).collect())
    tail = "via attribute b (foreign key bId) (polymorphic: any one of these) [inherited from Base (x)]"
    assert got == [("n1", f"- (outgoing) refers to B (x), Gone {tail}"), ("n2", f"- (incoming) is referred to by A (x) {tail}")]


def test_phrases_are_found_by_their_tokens(spark):
    names = ["Sales Order", "sales", "Sales Order Line", "C++", ".NET", "Sales-Order", "Order", "Ünit Cost", "a.b", "  ", "Lead"]
    asked = ["The SALES order line and order", "sales-order, C++ and .net", "xC++ C++x a.NET", "presales orders", "ünit cost of a.b? Sales  Order", "", None, "leads lead"]
    rows = spark.createDataFrame(list(enumerate(asked)), "question_id int, question string")
    got = {}
    for r in D.mentions(rows, spark.createDataFrame([(n,) for n in names + names[:2]], "name string")).orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append(r.name)
    import re

    for i, q in enumerate(asked):
        want = sorted((m.start(), n) for n in names if (m := re.search(rf"(?<!\w){re.escape(n)}(?!\w)", q or "", re.IGNORECASE)))
        assert got.get(i, []) == [n for _, n in want]


def test_a_million_phrases_with_one_beginning_take_one_row_a_word(spark):
    names = spark.range(200_000).select(F.concat(F.lit("the unit "), F.col("id").cast("string"), F.lit(" end")).alias("name"))
    asked = spark.range(50).select(F.col("id").alias("question_id"), F.concat(F.lit("is the unit "), (F.col("id") * 7).cast("string"), F.lit(" end of the unit")).alias("question"))
    got = sorted((r.question_id, r.name) for r in D.mentions(asked, names).collect())
    assert got == sorted((i, f"the unit {i * 7} end") for i in range(50))


def replayed(rows, limit, window):
    held, out = {}, {}
    for event, key, t in sorted(rows, key=lambda r: (str(r[1]), r[2] or datetime.datetime.min, r[0])):
        mine = [x for x in held.get(key, []) if t is not None and t - x <= window]
        out[event] = t is not None and len(mine) < limit
        if t is not None:
            held[key] = mine + [t] * out[event]
    return out


@pytest.mark.parametrize(("limit", "gap"), [(1, 40), (2, 500), (5, 3), (3, 5000)])
def test_admission_of_a_hot_key_equals_replay(spark, monkeypatch, limit, gap):
    rng = random.Random(limit)
    at, rows = datetime.datetime(2024, 1, 1), []
    for i in range(4000):
        at += datetime.timedelta(seconds=rng.choice([0, 1, gap]))
        rows.append((i, None if i % 97 == 0 else "hot" if rng.random() < 0.4 else f"k{rng.randrange(30)}", None if i % 501 == 0 else at))
    log = spark.createDataFrame(rows, "event_id long, key string, ts timestamp").repartition(7)
    rounds = []
    real = throttle._replayed
    monkeypatch.setattr(throttle, "_replayed", lambda starts, *rest: rounds.append(len(starts)) or real(starts, *rest))
    monkeypatch.setattr(throttle, "GUESSES", 2)
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = throttle.admitted(log, limit, 600)
        assert {r.event_id: r.admitted for r in got.collect()} == replayed(rows, limit, datetime.timedelta(seconds=600))
        assert len(rounds) > 2 and any(rounds) or gap > 600
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_lengths_by_a_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["One two three.", None, "", "long " * 900, "Größe 日本語"]
    model = Tokenizer.from_file(path)
    model.no_truncation()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r.n for r in rows.select("id", T.model_tokens(F.col("text"), path).alias("n")).collect()}
    assert got == {i: None if t is None else len(model.encode(t, add_special_tokens=False)) for i, t in enumerate(texts)}
    assert [r.id for r in T.over_length(rows, 512, lambda c: T.model_tokens(c, path)).collect()] == [3]
    assert [r.id for r in T.over_length(rows, 512).collect()] == [3]
