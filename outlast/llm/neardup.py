"""Near-duplicates by an inverted join over MinHash signature coordinates.

A document is the set of its 2-word shingles. A signature coordinate is a hash of a few MinHash values.
Documents with equal sets form one class at once. Each class is posted under every coordinate-value
pair of its signature prefix: two signatures that agree in ``match`` of ``coordinates`` places must
agree within the first ``coordinates - match + 1``, so lists of those places hold every wanted pair.
Collisions are counted by merging the two signatures, skipping pairs that cannot reach the threshold,
and what is left is confirmed on the full sets.

A list of n posts is never expanded into its pairs. In a round each list names its hub, the member that
meets the most others over all lists (of a group of near copies, the text they were made from), and one
member by lot; each class is held against the one of these that it meets in most lists, one pair per
class and round, and components merge. Lists that hold one component only are done. When few
cross-component pairs of like size are left, or the rounds stop paying, all of those are checked, so no
link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlast.llm.words import column, hashed_words, mix, pair_hash, text_column, text_slices
from outlast.session import cut_lineage

WORDS_PER_SHINGLE = 2
COORDINATES = 40
VALUES_PER_COORDINATE = 4
MATCH = 4
ROUNDS = 3
BLOCK = 256
HOT_CLASSES = 1000  # a class with more than this share of all rows is hot: fewer than this number can be
BROADCAST_IDS = 500_000  # ids of up to this number (16 bytes each) are sent to the texts, more are joined by a shuffle


def shingle_sets(texts: pa.Array, words: int = WORDS_PER_SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; shorter texts are one shingle, empty ones none."""
    hashes, starts = hashed_words(texts)
    grams = hashes
    for n in range(1, words):
        grams = pair_hash(grams[:-1], hashes[n:]) if len(grams) > 1 else grams[:0]
    for low, high in zip(starts[:-1], starts[1:]):
        if high - low >= words:
            yield np.unique(grams[low:high - words + 1])
        elif high > low:
            whole = hashes[low:low + 1]
            for n in range(low + 1, high):
                whole = pair_hash(whole, hashes[n:n + 1])
            yield mix(whole + np.uint64(high - low))
        else:
            yield hashes[:0]


def minhashes(shingles: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The least of each linear hash over the shingles, in slices that keep memory bounded."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 2048):
        part = short[at:at + 2048]
        np.minimum(least, (factors[:, None] * part[None, :] + offsets[:, None]).min(axis=1), out=least)
    return least


def signatures(docs: DataFrame, words: int, coordinates: int, values: int) -> DataFrame:
    """doc_id, n_shingles, shingles_hash (16 bytes, null for empty sets), signature (array of bigint)."""
    draw = np.random.default_rng(20240229)
    factors = draw.integers(0, 1 << 31, coordinates * values, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    offsets = draw.integers(0, 1 << 32, coordinates * values, dtype=np.uint32)
    places = mix(np.arange(1, coordinates + 1, dtype=np.uint64))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in text_slices(batches):
            sizes, digests, least = [], [], []
            for shingles in shingle_sets(text_column(batch), words):
                sizes.append(len(shingles))
                digests.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                least.append(minhashes(shingles, factors, offsets))
            table = np.array(least, np.uint64).reshape(-1, coordinates, values)
            keys = np.broadcast_to(places, table.shape[:2])
            for v in range(values):
                keys = pair_hash(keys, table[:, :, v])
            flat = pa.array(keys.reshape(-1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * coordinates), flat)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists],
                ["doc_id", "n_shingles", "shingles_hash", "signature"])

    return docs.select("doc_id", "text").mapInArrow(
        sign, "doc_id bigint, n_shingles bigint, shingles_hash binary, signature array<bigint>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = [s.view(np.int64) for s in shingle_sets(text_column(batch), words)]
            yield pa.RecordBatch.from_arrays([column(batch, "class"), pa.array(sets, pa.list_(pa.int64()))],
                                             ["class", "shingles"])

    return docs.mapInArrow(collect, "class bigint, shingles array<bigint>")


def _smallest(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` (class, label) after the components that ``edges`` (a, b: labels) join took their least label."""
    pairs = cut_lineage(edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
                        .unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    found = cut_lineage(pairs.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("to")))
    while True:
        # Hooking to the least neighbour's label, then following pointers.
        ends = pairs.join(found.select(F.col("node").alias("y"), F.col("to").alias("y_to")), "y")
        hooked = ends.groupBy(F.col("x").alias("node")).agg(F.min("y_to").alias("near"))
        nearer = found.join(hooked, "node").select("node", F.least("to", "near").alias("next"), "to")
        jump = found.select(F.col("node").alias("next"), F.col("to").alias("far"))
        moved = cut_lineage(nearer.join(jump, "next", "left").select(
            "node", F.least("next", F.coalesce("far", "next")).alias("to"), (F.col("to") != F.least(
                "next", F.coalesce("far", "next"))).alias("changed")))
        found = moved.select("node", "to")
        if moved.where("changed").isEmpty():
            break
    return cut_lineage(labels.join(found.withColumnRenamed("node", "label"), "label", "left")
                       .select("class", F.coalesce("to", "label").alias("label")))


def _confirmed(pairs: DataFrame, signed: DataFrame, sets: DataFrame, match: int, similarity: int) -> DataFrame:
    """Of ``pairs`` (a, b, label_a, label_b), those that agree in ``match`` coordinates and on their sets."""

    def side(table: DataFrame, name: str, value: str) -> DataFrame:
        return table.select(F.col("class").alias(name), F.col(value).alias(f"{value}_{name}"))

    agreed = F.size(F.array_intersect("signature_a", "signature_b"))  # a value names its place, too
    likely = (pairs.join(side(signed, "a", "signature"), "a").join(side(signed, "b", "signature"), "b")
              .where(agreed >= match).drop("signature_a", "signature_b"))
    both = likely.join(side(sets, "a", "shingles"), "a").join(side(sets, "b", "shingles"), "b")
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return (both.withColumn("common", common)
            .withColumn("all", F.size("shingles_a") + F.size("shingles_b") - F.col("common"))
            .where(F.col("common").cast("bigint") * 100 >= F.col("all").cast("bigint") * similarity)
            .select("a", "b", "label_a", "label_b"))


def _ordered(x: Column, y: Column, x_label: Column, y_label: Column) -> list[Column]:
    first = x < y
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b"),
            F.when(first, x_label).otherwise(y_label).alias("label_a"),
            F.when(first, y_label).otherwise(x_label).alias("label_b")]


def _links_across(left: DataFrame, signed: DataFrame, sets: DataFrame, match: int, similarity: int) -> DataFrame:
    """Links (a, b, label_a, label_b) between components among the posts ``left`` (key, class, label).

    Lists with the same prevailing component form a cluster. Its other classes are held against all of the
    cluster, block by block; a block meets BLOCK classes on either side, however large the cluster is.
    """
    sizes = left.groupBy("key", "label").agg(F.count("*").alias("n"))
    most = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("cluster"))
    members = cut_lineage(left.join(most, "key").select(
        "cluster", "class", "label", (F.col("label") == F.col("cluster")).alias("prevails")).distinct())
    counts = members.groupBy("cluster").agg(F.count_if("prevails").alias("inner"), F.count_if(~F.col("prevails")).alias("outer"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK)).cast("int")
    dealt = (members.join(counts.select("cluster", blocks("inner").alias("inner"), blocks("outer").alias("outer")), "cluster")
             .withColumn("block", F.pmod(F.xxhash64("class"), F.when(F.col("prevails"), F.col("inner")).otherwise(F.col("outer"))).cast("int"))
             .join(signed, "class").join(sets, "class"))
    row = ["cluster", "class", "label", "signature", "shingles"]
    # An outer block meets all inner blocks (numbered below 0) and the outer blocks from itself on.
    asking = dealt.where(~F.col("prevails")).select(
        *row, F.col("block").alias("own"), F.explode(F.sequence(-F.col("inner"), F.col("outer") - 1)).alias("other")).where(
        "other < 0 OR other >= own")
    number = F.when(F.col("prevails"), -F.col("block") - 1).otherwise(F.col("block"))
    asked = dealt.select(*[F.col(c).alias(c) for c in row], F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("own"), number.alias("other")).where(
        "other < 0 OR other >= own")

    def compare(one, two):
        names = ["a", "b", "label_a", "label_b"]
        if not one.num_rows or not two.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        flat = [t["shingles"].combine_chunks() for t in (one, two)]
        ends = [np.concatenate(([0], np.cumsum(f.value_lengths().to_numpy()))) for f in flat]
        values = [f.flatten().to_numpy() for f in flat]
        count = [np.diff(e) for e in ends]
        signs = [np.array(t["signature"].to_pylist(), np.int64) for t in (one, two)]
        labels, classes = ([t[c].to_numpy() for t in (one, two)] for c in ("label", "class"))
        found = []
        for i in range(one.num_rows):
            near = np.minimum(count[0][i], count[1]) * 100 >= similarity * np.maximum(count[0][i], count[1])
            near &= (labels[1] != labels[0][i]) & ((signs[1] == signs[0][i]).sum(axis=1) >= match)
            rows = np.flatnonzero(near)
            if not len(rows):
                continue
            own = np.sort(values[0][ends[0][i]:ends[0][i + 1]])
            theirs = np.concatenate([values[1][ends[1][j]:ends[1][j + 1]] for j in rows])
            at = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
            starts = np.concatenate(([0], np.cumsum(count[1][rows])))[:-1]
            common = np.add.reduceat((own[at] == theirs).astype(np.int64), starts)
            for j in rows[common * 100 >= similarity * (len(own) + count[1][rows] - common)]:
                found.append((classes[0][i], classes[1][j], labels[0][i], labels[1][j]))
        return pa.table({n: pa.array([f[k] for f in found], pa.int64()) for k, n in enumerate(names)})

    keys = ["cluster", "own", "other"]
    return asking.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(
        compare, "a bigint, b bigint, label_a bigint, label_b bigint")


def near_duplicates(docs: DataFrame, similarity: int = 80, words: int = WORDS_PER_SHINGLE,
                    coordinates: int = COORDINATES, values: int = VALUES_PER_COORDINATE, match: int = MATCH,
                    rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Two documents are linked if 100 * |intersection| >= ``similarity`` * |union| of their shingle sets;
    component_id is the least doc_id that links reach. A pair at similarity 0.8 agrees in fewer than
    4 of 40 coordinates of 4 values with a probability below 3e-6; such a pair is not found directly.

    Documents without words are linked with nothing. doc_id is a key: rows that repeat one are each
    answered by their own text. A null doc_id takes no part: component_id null, kept false. Other
    columns are not read. An empty table gives an empty result.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed_docs = cut_lineage(signatures(source, words, coordinates, values))
    named = signed_docs.where(F.col("doc_id").isNotNull())
    classes = cut_lineage(named.where(F.col("shingles_hash").isNotNull()).groupBy("shingles_hash")
                          .agg(F.min("doc_id").alias("class"), F.count("*").alias("n")))
    # One row per class: its smallest member's (rows that repeat a doc_id with other words stay apart).
    signed = (named.join(classes.drop("n"), ["shingles_hash"]).where(F.col("doc_id") == F.col("class"))
              .select("class", "signature").dropDuplicates(["class", "signature"]))
    posts = signed.select("class", F.explode(F.slice("signature", 1, coordinates - match + 1)).alias("key"))
    shared = posts.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high")
    lists = cut_lineage(posts.join(shared.select("key"), "key"))
    labels = cut_lineage(lists.select("class").distinct().withColumn("label", F.col("class")))
    members = labels.select("class")
    signed = cut_lineage(signed.join(members, "class"))
    wanted = members.withColumnRenamed("class", "doc_id")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    sets = cut_lineage(_sets(source.join(wanted, "doc_id")
                             .select(F.col("doc_id").alias("class"), "text"), words))
    tried = None
    for number in range(rounds + 1):
        open_lists = lists.join(labels, "class")
        mixed = (open_lists.groupBy("key", "label").agg(F.count("*").alias("n"))
                 .groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1"))
        left = cut_lineage(open_lists.join(mixed.select("key", "n"), "key"))
        if left.isEmpty():
            break
        last = number == rounds
        if last:
            links = cut_lineage(_links_across(left, signed, sets, match, similarity))
        else:
            met_by = left.groupBy("class").agg(F.sum("n").alias("met"))
            lot = F.xxhash64("class", F.lit(number))
            named = left.select("key", "class").join(met_by, "class").groupBy("key").agg(
                F.max_by("class", F.struct("met", -F.col("class"))).alias("hub"),
                F.max_by("class", lot).alias("drawn"))
            ends = labels.select(F.col("class").alias("pivot"), F.col("label").alias("pivot_label"))
            met = left.select("key", "class", "label").join(named, "key").select(
                "class", "label", F.explode(F.array_distinct(F.array("hub", "drawn"))).alias("pivot"))
            met = (met.groupBy("class", "label", "pivot").agg(F.count("*").alias("collisions"))
                   .join(ends, "pivot").where(F.col("label") != F.col("pivot_label")))
            met = met.select(*_ordered(F.col("class"), F.col("pivot"), F.col("label"), F.col("pivot_label")),
                             "class", "collisions")
            if tried is not None:
                met = met.join(tried, ["a", "b"], "left_anti")
            best = met.groupBy("class").agg(F.max(F.struct("collisions", "a", "b", "label_a", "label_b")).alias("p"))
            pairs = best.select("p.a", "p.b", "p.label_a", "p.label_b").distinct()
            pairs = cut_lineage(pairs)
            tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
            links = cut_lineage(_confirmed(pairs, signed, sets, match, similarity))
        if not links.isEmpty():
            labels = _smallest(links.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")), labels)
        if last:
            break
    moved = labels.where(F.col("class") != F.col("label"))
    total = classes.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_CLASSES > total
    resolved = lambda some: some.join(moved, "class", "left").select(
        "shingles_hash", F.coalesce("label", "class").alias("component_id"))
    often = resolved(classes.where(hot)).withColumnRenamed("component_id", "often")
    others = resolved(classes.where(~hot)).withColumnRenamed("shingles_hash", "rare_hash")
    # Hot classes are answered by a broadcast; their rows, and those without words, are dealt by their ids
    # (8 bytes at most, which no hash of 16 equals) and meet nothing in the join of the others.
    spread = F.unhex(F.hex(F.xxhash64("doc_id")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("often", "component_id", "doc_id"))
    return (signed_docs.drop("signature").join(F.broadcast(often), "shingles_hash", "left")
            .withColumn("rare_hash", F.coalesce(F.when(F.col("often").isNull(), F.col("shingles_hash")), spread))
            .join(others, "rare_hash", "left")
            .select("doc_id", "n_shingles", component.alias("component_id"),
                    F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")))


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns; one row for each doc_id, none for a null one."""
    kept = near_duplicates(docs, **options).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
