"""A Merkle manifest of documents, and the proof of every document checked by a recursive query.

Leaves of a source ascend by doc_id and form a tree of runs of three; the roots of the sources form
another such tree. Nodes are stored as rows linked to the node LINK levels above them (fewer at the top of
a tree), with the siblings on the way, so that a leaf reaches the root in few steps. A recursive query then
ascends from every leaf: each step joins the next link, appends its siblings to the proof and folds them into
the leaf's hash. Digests are kept as 32 bytes and hashed as hexadecimal text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlast.session import cut_lineage

RUN = 3
LINK = 4  # levels between a node and the one it is linked to
BLOCK = RUN ** LINK
TOP = -1  # the number of the tree over the sources
BROADCAST_ROWS = 100_000  # of about 0.4 kB each: the linked rows above the first link, if no more than these

RESULT = ("doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "verified boolean")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text: Column) -> Column:
    """SHA-256 of a row's fields with ``text`` for its text, as 32 bytes."""
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    return F.unhex(F.sha2(F.concat(*[_field(f) for f in fields]).cast("binary"), 256))


def tampered_text() -> Column:
    """The text without line feeds where 2 divides the CRC-32 of the decimal doc_id, else null."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(chosen & F.contains(F.col("text"), F.lit("\n")), F.replace(F.col("text"), F.lit("\n"), F.lit("")))


def _ordered(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows with ``at``, which ascends with ``keys`` (nulls first); written, as it names partitions."""
    return cut_lineage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                       .withColumn("at", F.monotonically_increasing_id()))


def _runs(ordered: DataFrame, group: str) -> DataFrame:
    """Where each group's rows of each partition begin: one row per group and partition that holds it."""
    found = ordered.groupBy(F.col(group).alias("_group"), F.shiftright("at", 33).alias("_part")).agg(
        F.min("at").alias("_first"), F.count("*").alias("_size"))
    every = Window.partitionBy("_group")
    before = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumns({"_before": F.coalesce(F.sum("_size").over(before), F.lit(0)), "n": F.sum("_size").over(every)})


def _placed(ordered: DataFrame, runs: DataFrame, group: str) -> DataFrame:
    """Add ``idx``, the place in the group, and ``n``, the group's size: no task holds a group."""
    same = ordered[group].eqNullSafe(runs["_group"]) & (F.shiftright(ordered["at"], 33) == runs["_part"])
    return (ordered.join(runs, same).withColumn("idx", F.col("at") - F.col("_first") + F.col("_before"))
            .drop("_group", "_part", "_first", "_size", "_before"))


def _blocks(nodes: DataFrame, members: list[str]) -> DataFrame:
    """Nodes (tree, idx, n, hash) in blocks of BLOCK neighbours, with up to LINK levels above them.

    ``levels[0]`` holds the block's own digests as text, the last level one. ``depth`` counts the levels
    above: LINK unless the tree ends in the block.
    """
    depth = sum(((F.col("n") > RUN ** level).cast("int") for level in range(LINK)), F.lit(0))
    grouped = nodes.groupBy("tree", F.expr(f"idx div {BLOCK}").alias("block")).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "hash", *members))).alias("members"))
    levels = F.expr(f"""aggregate(filter(sequence(1, {LINK}), x -> x <= depth),
        array(transform(members, m -> lower(hex(m.hash)))),
        (built, x) -> concat(built, array(transform(
            sequence(0, cast((size(element_at(built, -1)) - 1) div {RUN} as int)),
            i -> sha2(array_join(slice(element_at(built, -1), i * {RUN} + 1, {RUN}), ''), 256)))))""")
    return cut_lineage(grouped.withColumn("depth", depth).withColumn("levels", levels))


def _linked(blocks: DataFrame, level: int, members: list[str], above: Column) -> DataFrame:
    """One row per node: its link (up_tree, up_round, up_idx) and ``steps``, the siblings of each level."""
    wide = F.col("n") > BLOCK
    powers = f"array({', '.join(str(RUN ** j) for j in range(LINK))})"
    place = f"cast(place div {powers}[j] as int)"
    steps = F.expr(f"""transform(filter(sequence(0, {LINK - 1}), j -> j < depth), j -> named_struct(
        'before', unhex(array_join(slice(levels[j], {place} - {place} % {RUN} + 1, {place} % {RUN}), '')),
        'after', unhex(array_join(slice(levels[j], {place} + 2, {RUN - 1} - {place} % {RUN}), ''))))""")
    nodes = blocks.select("tree", "block", "n", "depth", "levels", F.posexplode("members").alias("place", "m"))
    return nodes.select(
        "tree", F.lit(level).alias("round"), "m.idx", "m.hash", *[f"m.{c}" for c in members], steps.alias("steps"),
        F.when(wide, F.col("tree")).otherwise(above).alias("up_tree"),
        F.when(wide, level + 1).otherwise(F.when(above.isNotNull(), 0)).alias("up_round"),
        F.when(wide, F.col("block")).otherwise(F.when(above.isNotNull(), F.col("tree"))).alias("up_idx"))


def _climbed(nodes: DataFrame, members: list[str], above: Column) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Links of the nodes given, links of all later rounds, and (tree, hash) of the roots."""
    links, roots, level = [], [], 0
    while True:
        blocks = _blocks(nodes, members if level == 0 else [])
        links.append(_linked(blocks, level, members if level == 0 else [], above))
        tops = blocks.select("tree", "block", "n", F.unhex(F.expr("element_at(levels, -1)[0]")).alias("hash"))
        roots.append(tops.where(F.col("n") <= BLOCK).select("tree", "hash"))
        nodes = tops.where(F.col("n") > BLOCK).select(
            "tree", F.col("block").alias("idx"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), "hash")
        level += 1
        if nodes.isEmpty():
            break
    ends = roots[0]
    for more in roots[1:]:
        ends = ends.unionByName(more)
    return links[0], links[1:], ends


FOLD = ("aggregate({steps}, {start}, (h, s) -> unhex(sha2(concat(lower(hex(s.before)), lower(hex(h)), "
        "lower(hex(s.after))), 256)))")
APPEND = "aggregate({steps}, {start}, (p, s) -> concat(p, s.before, s.after))"


def _ascend(leaves: DataFrame, nodes: DataFrame, broadcast: bool) -> DataFrame:
    """One row per leaf at the root: its folded hash, its proof and the root of its source."""
    spark = leaves.sparkSession
    # The number of rows a recursive query may make is limited by default; it makes one per leaf and link.
    held = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    try:
        return cut_lineage(spark.sql(f"""
            WITH RECURSIVE climb(doc_id, leaf, subroot, tree, round, idx, folded, proof) AS (
                SELECT doc_id, hash, cast(NULL AS binary), up_tree, up_round, up_idx,
                       {FOLD.format(steps="steps", start="coalesce(tampered, hash)")},
                       {APPEND.format(steps="steps", start="X''")}
                FROM {{leaves}}
                UNION ALL
                SELECT {"/*+ BROADCAST(n) */" if broadcast else ""} c.doc_id, c.leaf,
                       CASE WHEN n.tree = {TOP} AND n.round = 0 THEN n.hash ELSE c.subroot END,
                       n.up_tree, n.up_round, n.up_idx,
                       {FOLD.format(steps="n.steps", start="c.folded")}, {APPEND.format(steps="n.steps", start="c.proof")}
                FROM climb c JOIN {{nodes}} n ON n.tree = c.tree AND n.round = c.round AND n.idx = c.idx)
            SELECT doc_id, leaf, subroot, folded, sha2(lower(hex(proof)), 256) AS proof_sha256
            FROM climb WHERE tree IS NULL""", leaves=leaves, nodes=nodes))
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", held)


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, roots and checked proof of every row of ``docs`` (doc_id, source, lang, n_chars, text).

    A leaf is the SHA-256 of the row's fields. ``proof_sha256`` is the SHA-256 of the siblings from the leaf up
    to the root, ``folded_root`` what they make of the tampered leaf (``tampered_text``) and ``verified`` whether
    that is the root.

    Null fields are part of the leaf; rows without an id come first in their source and are not tampered,
    rows without a source form a source of their own, the first. Rows that repeat a doc_id in a source are ordered by
    their digests; equal rows have equal leaves, and proofs in that order. Whole texts are hashed. A source of one
    row has its leaf as root. Other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("bigint").alias("n_chars"),
                       F.col("text").cast("string").alias("text"))
    without = tampered_text()
    digests = rows.select("doc_id", "source", leaf_digest(F.col("text")).alias("hash"),
                          F.when(without.isNotNull(), leaf_digest(without)).alias("tampered"))
    ordered = _ordered(digests, "source", "doc_id", "hash", "tampered")
    runs = cut_lineage(_runs(ordered, "source"))
    sources = _ordered(runs.select(F.col("_group").alias("source")).distinct().withColumn("all", F.lit(0)), "source")
    trees = _placed(sources, _runs(sources, "all"), "all").select("source", F.col("idx").alias("tree"))
    numbered = runs.join(trees, runs["_group"].eqNullSafe(trees["source"])).drop("source")
    leaves = _placed(ordered, numbered, "source").select("tree", "idx", "n", "hash", "doc_id", "tampered")
    first, upper, subroots = _climbed(leaves, ["doc_id", "tampered"], F.lit(TOP).cast("bigint"))
    subroots = cut_lineage(subroots)
    count = subroots.count()
    if count == 0:
        return spark.createDataFrame([], RESULT)
    over = subroots.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("idx"),
                           F.lit(count).cast("bigint").alias("n"), "hash")
    top_first, top_upper, root = _climbed(over, [], F.lit(None).cast("bigint"))
    nodes = top_first
    for more in [*top_upper, *upper]:
        nodes = nodes.unionByName(more)
    nodes = cut_lineage(nodes)
    found = _ascend(first, nodes, nodes.count() <= BROADCAST_ROWS)
    root_text = bytes(root.first()["hash"]).hex()

    def text(digest: str) -> Column:
        return F.lower(F.hex(digest))

    return found.select(
        "doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), F.lit(root_text).alias("root"),
        "proof_sha256", text("folded").alias("folded_root"),
        (text("folded") == root_text).alias("verified"))
