"""A uniform shuffle of rows into shards of equal size, by a hypergeometric communication matrix.

How many rows each input partition sends to each shard is drawn first: the counts of a uniform shuffle follow
a multivariate hypergeometric law whose margins are the sizes of partitions and shards. They are drawn down a
binary tree over the partitions, where every node deals its counts to its two halves. Then each partition
permutes its rows and cuts them by its counts, and every shard permutes what it received. So shards have exact
sizes without a global order, and only narrow rows move. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlast.functions.hashing import PRIME
from outlast.functions.ordering import number_rows
from outlast.session import cut_lineage

SHARDS = 8
PART_BITS = 33  # the bits of a row's number that hold its place in its partition


# From the weight of the count ``at`` to that of the next one and to that of the one before; 0 outside the support.
UP = "({w}) * (_k - ({at})) * (_m - ({at})) / ((({at}) + 1) * (_n - _k - _m + ({at}) + 1))"
DOWN = ("({w}) * greatest({at}, 0D) * greatest(_n - _k - _m + ({at}), 0D) / ((_k - ({at}) + 1) * (_m - ({at}) + 1))")


def with_draw(rows: DataFrame, good: str, total: str, drawn: str, uniform: str, name: str) -> DataFrame:
    """Add ``name``: how many of ``drawn`` out of ``total`` items are ``good``, by inversion at ``uniform`` in [0, 1).

    The weights of the counts around the mode follow from it by ratios, upwards and downwards in turn, over ten
    standard deviations and ten counts more; beyond lies less than a rounding error. A first walk adds them up,
    a second one stops where the uniform's share of the sum is reached. The arguments are SQL expressions.
    """
    start = f"'up', 1D, 'down', {DOWN.format(w='1D', at='_mode')}"
    step = (f"'up', if(_mode + j < least(_k, _m), {UP.format(w='a.up', at='_mode + j')}, 0D), "
            f"'down', {DOWN.format(w='a.down', at='_mode - 1 - j')}")
    return (rows.selectExpr("*", f"cast({good} as double) as _k", f"cast({total} as double) as _n",
                            f"cast({drawn} as double) as _m", f"{uniform} as _u")
            .selectExpr("*", "greatest(least(cast(floor((_m + 1) * (_k + 1) / (_n + 2)) as double), _k, _m), "
                             "_m + _k - _n, 0D) as _mode",
                        "sequence(0, cast(ceil(sqrt(_m * _k * (_n - _k) * (_n - _m) / greatest(_n * _n * (_n - 1), 1D)) * 10) "
                        "as int) + 10) as _steps")
            .selectExpr("*", f"aggregate(_steps, named_struct({start}, 'sum', 0D), (a, j) -> "
                             f"named_struct({step}, 'sum', a.sum + a.up + a.down)).sum as _sum")
            .selectExpr("*", f"""cast(coalesce(aggregate(_steps,
                named_struct({start}, 'left', _u * _sum, 'found', cast(null as double)), (a, j) -> named_struct(
                    {step}, 'left', a.left - a.up - a.down, 'found', coalesce(a.found, case
                        when a.left < a.up then _mode + j when a.left < a.up + a.down then _mode - 1 - j end))).found,
                _mode) as bigint) as {name}""")
            .drop("_k", "_n", "_m", "_u", "_mode", "_steps", "_sum"))


def communication_matrix(sizes: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(part, counts): how many rows each partition sends to each shard.

    ``sizes`` is (part, size) with one row per partition that has rows. The counts of a partition add up to
    its size, those of a shard to the rows over the shards, rounded down or up (first shards up). One small job
    per level of the tree over the partitions; the tables have one row per partition at most.
    """
    sizes = cut_lineage(sizes)
    rows, top = sizes.agg(F.sum("size"), F.max("part")).first()
    rows, levels = rows or 0, (top or 0).bit_length()
    wanted = [rows // shards + (s < rows % shards) for s in range(shards)]
    nodes = sizes.groupBy(F.lit(0).cast("bigint").alias("node")).agg(F.sum("size").alias("size")).withColumn(
        "counts", F.array(*[F.lit(w).cast("bigint") for w in wanted]))
    for level in range(1, levels + 1):
        below = sizes.groupBy(F.shiftright("part", levels - level).alias("child")).agg(F.sum("size").alias("child_size"))
        left = below.where(F.col("child") % 2 == 0).select(F.shiftright("child", 1).alias("node"), F.col("child_size").alias("left_size"))
        split = nodes.join(left, "node", "left").withColumn("left_size", F.coalesce("left_size", F.lit(0)))
        split = split.selectExpr("*", "size as _pool", "left_size as _open")
        for i in range(shards - 1):  # the left half draws its rows of one shard after the other
            uniform = f"shiftrightunsigned(xxhash64({seed}, {level}, node, {i}), 11) / 9007199254740992D"
            split = with_draw(split, f"counts[{i}]", "_pool", "_open", uniform, "_c")
            split = split.selectExpr("* except (_pool, _open, _c)", f"_pool - counts[{i}] as _pool",
                                     "_open - _c as _open", f"_c as _c{i}")
        taken = F.array(*[F.col(f"_c{i}") for i in range(shards - 1)], F.col("_open"))
        halves = split.select("node", "size", "left_size", "counts", taken.alias("taken")).select(
            "*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
        is_left = F.col("side") == 0
        nodes = cut_lineage(halves.select(
            (F.col("node") * 2 + F.col("side")).alias("node"),
            F.when(is_left, F.col("left_size")).otherwise(F.col("size") - F.col("left_size")).alias("size"),
            F.when(is_left, F.col("taken")).otherwise(F.zip_with("counts", "taken", lambda a, b: a - b)).alias("counts"))
            .where("size > 0"))
    return nodes.select(F.col("node").alias("part"), "counts")


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """Deal the rows of ``docs`` (doc_id, text) to ``shards`` shards in a uniformly random order.

    Columns: doc_id, size (bytes of the text plus 1), text_crc32, law (always ``rows``: the shards' row counts
    are at most one apart), shard, slot (0, 1, ... in each shard: its order) and grown_shard (always null).

    Rows are dealt one by one, so null or repeated doc_ids and equal texts may meet or part like any others. A
    null text has size 1 and the checksum of an empty one. Other columns are not read. An empty table gives
    an empty result. The rows' facts are written once with their partitions, so that every later read sees the same
    rows in them even if executors are lost.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    facts = cut_lineage(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", PART_BITS)
    matrix = communication_matrix(facts.groupBy(part.alias("part")).agg(F.count("*").alias("size")), shards, seed)

    def random_key(step: int) -> Column:
        return F.xxhash64(F.lit(seed), F.lit(step), F.col("at"))

    # First permutation: a partition's rows in the order of a hash; its counts cut that order.
    local = Window.partitionBy("part").orderBy(random_key(1), "at")
    ranked = facts.withColumn("part", part).withColumn("rank", F.row_number().over(local) - 1).join(matrix, "part")
    ends = F.aggregate("counts", F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).alias("shard")),
                       lambda a, c: F.struct((a["end"] + c).alias("end"),
                                             (a["shard"] + (a["end"] + c <= F.col("rank")).cast("int")).alias("shard")))
    dealt = cut_lineage(ranked.select("doc_id", "size", "text_crc32", "at", ends["shard"].alias("shard")))
    # Second permutation: the rows of a shard in the order of another hash, numbered by slices of its range.
    spread = F.pmod(random_key(2), F.lit(PRIME))
    placed = number_rows(dealt, spread, F.xxhash64(F.lit(seed), F.lit(3), F.col("at")), ["shard"], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                         (F.col("slot") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
