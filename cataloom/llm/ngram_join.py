"""Self-join of documents on the Jaccard similarity of their word shingles, with a token-group matrix.

1. Documents with equal shingle sets are one *set*; copies are never compared.
2. Of each set only a prefix under one global order of shingles is looked at: two sets of the wanted similarity share a
   shingle in their prefixes. Shingles found often come last in the order (a list of fixed size, found by counting in each
   task), so that passages which many documents share don't bring unrelated ones together.
3. Similar sets are put into groups: a prefix shingle's leader is the most central set that has it, and each set is compared
   with the few leaders that most of its shingles name; linked sets and leaders form groups (components of these stars).
4. The token-group matrix holds for each group the union of its members' prefix shingles and the range of their sizes. What
   a set shares with a group's union, plus the shingles behind the prefixes, bounds its overlap with every member; only
   groups that reach the least overlap that the sizes allow are opened, and their members pass the same bound one by one
   before they are compared exactly.
5. Components over all links.

A group of thousands of near copies therefore costs one comparison per member, not one per pair, yet every link between
different groups is found: the answer is exact (shingles are compared by 64-bit hashes).

Defined results: a null or wordless text has no shingles and is linked with nothing; a text of fewer words than a shingle is
one shingle; repeated rows and ids share their class; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cataloom.llm import bloom
from cataloom.llm import kernels as K
from cataloom.llm.components import components
from cataloom.sources.shared import materialize

#: Length of the list of frequent shingles.
FREQUENT = 50_000
#: Sub-postings of a frequent shingle.
SALTS = 64
#: Leaders that a set is compared with to find its group.
LEADERS = 3


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, data, offsets in K.slices(column):
        starts, ends, first = K.word_spans(data, offsets)
        hashes = K.span_hash(K.prefix_hash(data, fold_case=True), starts, ends)
        windows = K.window_hash(hashes, words)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= words:
                yield K.distinct(windows[a : b - words + 1])
            elif b > a:
                yield K.mix(K.window_hash(hashes[a:b], int(b - a)) + K.U(b - a))
            else:
                yield np.zeros(0, np.uint64)


def set_id(tokens: np.ndarray) -> int:
    """64-bit name of a set."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def prefix_length(n: int, percent: int) -> int:
    """So many shingles of a set of n include one of any set that similar."""
    return n - -(-percent * n // 100) + 1


PROFILE = "doc_id long, n_shingles long, set_id long, token long, n long"


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_id of every document (set_id null without shingles); and rows (token, n) without n_shingles.

    The latter are the shingles that a batch of a task has had at least three times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.drop_resident()
        seen: set[int] = set()
        for batch in batches:
            n, ids, parts = [], [], []
            for tokens in shingle_sets(batch.column("text"), words):
                n.append(len(tokens))
                name = set_id(tokens) if len(tokens) else None
                ids.append(name)
                if name is not None and name not in seen:
                    seen.add(name)
                    parts.append(tokens)
            token, count = np.unique(np.concatenate(parts), return_counts=True) if parts else (
                np.zeros(0, np.uint64), np.zeros(0, np.int64)
            )
            token, count = token[count >= 3].view(np.int64), count[count >= 3].astype(np.int64)
            rows, more = batch.num_rows, len(token)
            none = lambda k: pa.nulls(k, pa.int64())
            columns = [
                [batch.column("doc_id"), none(more)], [pa.array(n, pa.int64()), none(more)],
                [pa.array(ids, pa.int64()), none(more)], [none(rows), pa.array(token)], [none(rows), pa.array(count)]
            ]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in columns], ["doc_id", "n_shingles", "set_id", "token", "n"])

    return K.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PROFILE)


def _new_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Per batch the sets that the task hasn't had before: copies within a task cost nothing more."""
    seen: set[int] = set()
    for batch in batches:
        out = []
        for tokens in shingle_sets(batch.column("text"), words):
            if len(tokens) and (name := set_id(tokens)) not in seen:
                seen.add(name)
                out.append((name, tokens))
        yield out


def frequent_shingles(counted: DataFrame, size: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """At most ``size`` shingles that many sets have, with lower bounds of their counts. Only the order of shingles depends on them, never the result."""
    top = counted.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(size).toPandas()
    token = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], top["n"].to_numpy(np.int64)[order]


def prefixes(docs: DataFrame, words: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """token, salt, set_id, n: the prefix of each set, rare shingles first. Frequent shingles are dealt over salts."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = shared.value
        for sets in _new_sets(batches, words):
            tokens, salts, names, sizes = [], [], [], []
            for name, own in sets:
                n, keep = len(own), prefix_length(len(own), percent)
                rank = np.zeros(n, np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    rank = np.where(common[at] == own, counts[at], 0)
                chosen = np.lexsort((own, rank))[:keep] if rank.any() else np.arange(keep)
                tokens.append(own[chosen])
                salts.append(np.where(rank[chosen] > 0, 1 + name % SALTS, 0))
                names.append(np.full(keep, name))
                sizes.append(np.full(keep, n))
            join = lambda x, kind: pa.array(np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64), pa.int64()).cast(kind)
            yield pa.RecordBatch.from_arrays(
                [join(tokens, pa.int64()), join(salts, pa.int32()), join(names, pa.int64()), join(sizes, pa.int32())],
                ["token", "salt", "set_id", "n"]
            )

    return docs.select("text").mapInArrow(run, "token long, salt int, set_id long, n int")


def set_tokens(docs: DataFrame, words: int, wanted: DataFrame) -> DataFrame:
    """set_id, tokens (binary, sorted) of the wanted sets: one more scan, thinned by a filter."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom.sized(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _new_sets(batches, words):
            names = np.array([x[0] for x in sets], np.int64)
            pick = np.flatnonzero(bloom.may_hold(shared.value, names))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[pick]), pa.array([sets[i][1].tobytes() for i in pick], pa.binary())], ["set_id", "tokens"]
            )

    found = docs.select("text").mapInArrow(run, "set_id long, tokens binary")
    # Sets come once from each task that has them.
    return found.join(wanted, "set_id", "left_semi").groupBy("set_id").agg(F.first("tokens").alias("tokens"))


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids that reach the similarity; sets: set_id, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("set_id").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("set_id").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def least_overlap(n: str, m: str, percent: int):
    """Prefix shingles that sets of sizes n and m share at least if they are linked.

    Linked sets have ceil(percent (n + m) / (100 + percent)) shingles in common. Those outside the common prefix come, in
    the global order, behind the end of one of the prefixes, where ceil(percent n / 100) - 1 shingles are left.
    """
    both = F.ceil(F.lit(percent) * (F.col(n) + F.col(m)) / F.lit(100 + percent) - F.lit(1e-9))
    behind = F.greatest(
        F.ceil(F.lit(percent) * F.col(n) / F.lit(100) - F.lit(1e-9)), F.ceil(F.lit(percent) * F.col(m) / F.lit(100) - F.lit(1e-9))
    ) - 1
    return F.greatest(both - behind, F.lit(1))


def least_overlap_between(n: str, low: str, high: str, percent: int):
    """A bound that :func:`least_overlap` of n and any size from low to high reaches.

    Without its ceilings it rises up to n and falls after, so its least value stands at an end. The ceilings make it
    uneven, but never bring it down to the value without them: it is above, so at least the next whole number.
    """
    smooth = lambda m: F.lit(percent / (100 + percent)) * (F.col(n) + F.col(m)) - F.lit(percent / 100) * F.greatest(n, m)
    return F.greatest(F.floor(F.least(smooth(low), smooth(high)) - F.lit(1e-9)) + 1, F.lit(1))


def _sizes_fit(n: str, m: str, percent: int):
    return (100 * F.col(n) >= percent * F.col(m)) & (100 * F.col(m) >= percent * F.col(n))


def promising(pairs: DataFrame, postings: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and common prefix shingles allow a link. postings: token, set_id, n."""
    left = postings.select(F.col("set_id").alias("a"), "token", F.col("n").alias("na"))
    right = postings.select(F.col("set_id").alias("b"), "token", F.col("n").alias("nb"))
    shared = pairs.join(left, "a").join(right, ["b", "token"]).where(_sizes_fit("na", "nb", percent))
    return shared.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared")).where(
        F.col("shared") >= least_overlap("na", "nb", percent)
    ).select("a", "b")


def classes(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, set_id, component_id (the smallest doc_id that links reach) of every document."""
    profiled = materialize(profiles(docs, words), "shingle-profiles")
    own = profiled.where("n_shingles is not null").select("doc_id", "n_shingles", "set_id")
    # Postings of prefix shingles that two sets or more have, with the posting's leader.
    frequent = frequent_shingles(profiled)
    # Of a posting only sets stay that have one of fitting size in it; a frequent shingle may have it under another salt (they start at 1).
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = Window.partitionBy("token", "salt").orderBy("n", "set_id")
    dealt = prefixes(docs, words, percent, frequent).repartition(parts, "token", "salt").distinct().withColumn("_less", F.lag("n").over(place)).withColumn("_more", F.lead("n").over(place))
    postings = dealt.where(
        (F.col("salt") != 0) | (100 * F.col("_less") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("_more"))
    )
    postings = materialize(postings.select("token", "set_id", "n"), "postings")

    # Groups: the leader of a shingle is the most central set that has it, the one whose prefix is shared most.
    df = postings.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    central = postings.join(df, "token").groupBy("set_id").agg((F.sum("df") / F.max("n")).alias("central"))
    leaders = postings.join(central, "set_id").groupBy("token").agg(
        F.max(F.struct("central", "set_id")).alias("x")
    ).select("token", F.col("x.set_id").alias("leader"))
    named = postings.join(leaders, "token").where("leader != set_id").groupBy("set_id", "leader").count()
    best = named.withColumn(
        "_r", F.row_number().over(Window.partitionBy("set_id").orderBy(F.desc("count"), "leader"))
    ).where(F.col("_r") <= LEADERS)
    named_pairs = best.select(F.col("set_id").alias("a"), F.col("leader").alias("b"))
    stars = materialize(promising(named_pairs, postings, percent), "stars")
    near = materialize(linked(stars, set_tokens(docs, words, _ends(stars)), percent), "star-links")
    groups = materialize(components(near), "groups")
    opened = _between_groups(postings, groups, percent)
    if opened.isEmpty():
        final = groups
    else:
        final = components(near.unionByName(linked(opened, set_tokens(docs, words, _ends(opened)), percent)))
    least = own.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    joined = least.join(
        final.select(F.col("node").alias("set_id"), "component"), "set_id", "left"
    ).withColumn("component", F.coalesce("component", "set_id"))
    reps = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_set = joined.join(reps, "component").select("set_id", "component_id")
    return own.join(by_set, "set_id", "left").select(
        "doc_id", "n_shingles", "set_id", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def representatives(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` without those that a document of smaller id represents: one of each class of near duplicates stays, as do all without shingles."""
    found = classes(docs, words, percent)
    gone = materialize(found.where("component_id != doc_id").select("doc_id").distinct(), "near-copies")
    shared = docs.sparkSession.sparkContext.broadcast(bloom.sized(gone))
    doc = F.col("doc_id").cast("long")
    flagged = docs.select(
        F.struct("*").alias("row"), doc.alias("doc_id"),
        (doc.isNotNull() & bloom.hits(shared, F.coalesce(doc, F.lit(0)))).alias("hit")
    )
    kept = flagged.where("hit").join(gone.hint("merge"), "doc_id", "left_anti")
    return flagged.where(~F.col("hit")).select("row").unionByName(kept.select("row")).select("row.*")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()


def _between_groups(postings: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of different groups that may be linked, through the token-group matrix."""
    at = postings.join(
        groups.select(F.col("node").alias("set_id"), F.col("component").alias("grp")), "set_id", "left"
    ).withColumn("grp", F.coalesce("grp", "set_id"))
    at = materialize(at.select("token", "set_id", "n", "grp"), "grouped-postings")
    matrix = at.groupBy("token", "grp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("members"))
    mixed = matrix.groupBy("token").count().where("count > 1").select("token")
    extent = at.groupBy("grp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.approx_count_distinct("set_id").alias("size"))
    # The sets of the smaller group ask the larger one; a group's sizes are cut to those that fit the set's.
    rank = F.struct("size", "grp")
    asked = at.join(mixed, "token", "left_semi").join(extent, "grp").select("token", "set_id", "n", rank.alias("mine"))
    other = matrix.join(mixed, "token", "left_semi").join(extent, "grp").select(
        "token", "grp", "low", "high", "members", "least", "most", rank.alias("theirs")
    )
    fits = (F.col("mine") < F.col("theirs")) & (100 * F.col("high") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("low"))
    met = asked.join(other, "token").where(fits).select("set_id", "grp", "n", "least", "most", "token", "members")
    met = met.withColumn(
        "least", F.greatest("least", F.ceil(F.lit(percent) * F.col("n") / 100).cast("int"))
    ).withColumn("most", F.least("most", F.floor(F.lit(100) * F.col("n") / percent).cast("int")))
    cell = Window.partitionBy("set_id", "grp")
    met = met.withColumn("bound", least_overlap_between("n", "least", "most", percent))
    met = met.withColumn("shared", F.count("*").over(cell)).withColumn("place", F.row_number().over(cell.orderBy("members", "token")))
    # A member with enough of the shared shingles has one of those that are left when all but bound - 1 are taken, the rarest ones.
    probes = met.where((F.col("shared") >= F.col("bound")) & (F.col("place") <= F.col("shared") - F.col("bound") + 1))
    probes = materialize(probes.select(F.col("set_id").alias("a"), F.col("n").alias("na"), "grp", "token"), "open-groups")
    theirs = at.select("token", "grp", F.col("set_id").alias("b"), F.col("n").alias("nb"))
    pairs = probes.join(theirs, ["token", "grp"]).where(_sizes_fit("na", "nb", percent)).select("a", "b").distinct()
    return materialize(promising(pairs, postings, percent), "opened")
