"""How the sources of a language differ in their terms: a recount over minimal perfect hashes.

A first pass counts exactly in how many documents of its language each term occurs; the frequent ones are kept.
They are dealt to shards, and every shard becomes a minimal perfect hash (hash and displace) with its keys
stored in place order. A second pass over the texts looks every word up in the broadcast shards, verifies
the stored key, and increments the slots of its (language, source) group, an array with one place per kept
term. Shares are integers, and all sums and orders are Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlast.llm.words import column, mix, text_slices
from outlast.session import cut_lineage

LEAST_DOCUMENTS = 30
TOP_TERMS = 50
SHARD_KEYS = 16_384
KEYS_PER_BUCKET = 4
BROADCAST_BYTES = 64 << 20  # of stored keys and displacements at once; more take further passes over the texts
SLOT_ARRAYS_BYTES = 64 << 20  # of a task's slot arrays; beyond, their counts are sent on and they start anew
BLOCK_CELLS = 1 << 16  # sources x terms of one block of the pair sums
STEP = np.uint64(0x9E3779B97F4A7C15)

# Bytes outside terms become blanks, A-Z become a-z; bytes of longer characters belong to terms.
FOLDED = bytes(32 if b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if b <= 0x5A else b for b in range(256))


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """A code per term of all texts, the distinct terms by code, and where each text's terms start (one entry more)."""
    texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = bytes(memoryview(texts.buffers()[2] or b"")[offsets[0]:offsets[-1]]).translate(FOLDED)
    folded = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])),
                                                             pa.py_buffer(data)])
    lists = pc.ascii_split_whitespace(folded)
    flat, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    filled = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate(([0], np.cumsum(filled.to_numpy(zero_copy_only=False))))
    coded = flat.filter(filled).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, before[starts - starts[0]]


def key_hashes(lang: str, terms: list[str], seed: int = 0) -> np.ndarray:
    """64-bit hashes of (lang, term); a term holds no NUL, so the two are told apart."""
    tail = b"\0" + lang.encode()
    return np.fromiter((xxhash.xxh3_64_intdigest(t.encode() + tail, seed) for t in terms), np.uint64, len(terms))


def _place(hashes: np.ndarray, displacement: np.ndarray, size: int) -> np.ndarray:
    return (mix(hashes + displacement.astype(np.uint64) * STEP) % np.uint64(size)).astype(np.int64)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def build_hash(lang: str, terms: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(seed, displacements, order): ``order[slot]`` is the index of the term that owns the slot.

    Buckets take, largest first, the first displacement that sends their keys to free slots of their own. Buckets of
    one key, the last, take a free slot outright: a displacement of -1 - slot. The seed changes until all
    hashes differ, so any set of distinct terms has a perfect hash.
    """
    size, seed = len(terms), 0
    while len(np.unique(hashes := key_hashes(lang, terms, seed))) < size:
        seed += 1
    buckets = max(1, -(-size // KEYS_PER_BUCKET))
    bucket = _bucket(hashes, buckets)
    counts = np.bincount(bucket, minlength=buckets)
    members = np.split(np.argsort(bucket, kind="stable"), np.cumsum(counts)[:-1])
    displaced, owner = np.zeros(buckets, np.int64), np.full(size, -1, np.int64)
    tries = np.arange(64)
    for b in np.argsort(-counts, kind="stable"):
        if counts[b] <= 1:
            break
        at = 0
        while True:
            places = _place(hashes[members[b]][None, :], (tries + at)[:, None], size)
            ordered = np.sort(places, axis=1)
            fits = (owner[places] < 0).all(axis=1) & (ordered[:, 1:] > ordered[:, :-1]).all(axis=1)
            if fits.any():
                first = int(fits.argmax())
                displaced[b], owner[places[first]] = at + first, members[b]
                break
            at += len(tries)
    free = iter(np.flatnonzero(owner < 0))
    for b in np.flatnonzero(counts == 1):
        slot = next(free)
        displaced[b], owner[slot] = -1 - slot, members[b][0]
    return seed, displaced, owner


@dataclass(frozen=True)
class Shard:
    base: int  # the language's slots before this shard
    seed: int
    displaced: np.ndarray
    keys: pa.Array  # by slot


@dataclass(frozen=True)
class PerfectHashes:
    """The shards of one round, by language: a number of shards, and those present by number."""

    sizes: dict[str, int]
    shards: dict[str, dict[int, Shard]]

    def slots(self, lang: str, terms: pa.Array) -> np.ndarray:
        """The slot of each term in its language, -1 for terms that are not stored here."""
        found = np.full(len(terms), -1, np.int64)
        present = self.shards.get(lang)
        if not present or not len(terms):
            return found
        words = terms.to_pylist()
        hashes = key_hashes(lang, words)
        number = (hashes % np.uint64(self.sizes[lang])).astype(np.int64)
        for i, shard in present.items():
            mine = np.flatnonzero(number == i)
            if not len(mine):
                continue
            own = hashes[mine] if shard.seed == 0 else key_hashes(lang, [words[j] for j in mine], shard.seed)
            displaced = shard.displaced[_bucket(own, len(shard.displaced))]
            slot = np.where(displaced < 0, -1 - displaced, _place(own, np.maximum(displaced, 0), len(shard.keys)))
            same = pc.equal(shard.keys.take(pa.array(slot)), terms.take(pa.array(mine))).to_numpy(zero_copy_only=False)
            found[mine[same]] = shard.base + slot[same]
        return found


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, pa.Array]]:
    """(language, its rows, their texts) for each language of a batch."""
    codes = column(batch, "lang").dictionary_encode()
    number, texts = codes.indices.to_numpy(), column(batch, "text")
    for code, lang in enumerate(codes.dictionary.to_pylist()):
        rows = np.flatnonzero(number == code)
        yield lang, rows, texts.take(pa.array(rows))


def document_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, documents): in how many documents of the language a term occurs."""

    def count(batches):
        for batch in text_slices(batches):
            for lang, _, texts in _by_lang(batch):
                codes, terms, starts = terms_of(texts)
                if len(terms):
                    document = np.repeat(np.arange(len(texts)), np.diff(starts))
                    once = np.unique(document * len(terms) + codes) % len(terms)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(terms), pa.string()), terms.cast(pa.string()),
                         pa.array(np.bincount(once, minlength=len(terms)))], ["lang", "term", "documents"])

    counted = docs.select("lang", "text").mapInArrow(count, "lang string, term string, documents bigint")
    return counted.groupBy("lang", "term").agg(F.sum("documents").alias("documents"))


def perfect_hashes(kept: DataFrame) -> DataFrame:
    """One row per shard of the kept terms (lang, term): lang, shard, shards, base, seed, displaced, keys, bytes."""
    sizes = kept.groupBy("lang").agg(F.ceil(F.count("*") / SHARD_KEYS).cast("int").alias("shards"))

    def numbered(batches):
        for batch in batches:
            shard = np.empty(batch.num_rows, np.int64)
            langs, shards = column(batch, "lang").to_pylist(), column(batch, "shards").to_numpy()
            for i, (lang, term) in enumerate(zip(langs, column(batch, "term").to_pylist())):
                shard[i] = xxhash.xxh3_64_intdigest(term.encode() + b"\0" + lang.encode()) % int(shards[i])
            yield batch.append_column("shard", pa.array(shard))

    def build(key, table):
        lang, shard = key[0].as_py(), key[1].as_py()
        terms = table["term"].to_pylist()
        seed, displaced, owner = build_hash(lang, terms)
        keys = [terms[i] for i in owner]
        return pa.table({"lang": [lang], "shard": [shard], "shards": [table["shards"][0].as_py()], "seed": [seed],
                         "displaced": [displaced.tolist()], "keys": [keys],
                         "bytes": [8 * len(displaced) + sum(len(k.encode()) + 8 for k in keys)]},
                        schema=pa.schema([("lang", pa.string()), ("shard", pa.int64()), ("shards", pa.int32()), ("seed", pa.int64()),
                                          ("displaced", pa.list_(pa.int64())), ("keys", pa.list_(pa.string())), ("bytes", pa.int64())]))

    placed = kept.select("lang", "term").join(sizes, "lang").mapInArrow(numbered, "lang string, term string, shards int, shard bigint")
    built = cut_lineage(placed.groupBy("lang", "shard").applyInArrow(
        build, "lang string, shard bigint, shards int, seed bigint, displaced array<bigint>, keys array<string>, bytes bigint"))
    before = Window.partitionBy("lang").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return built.join(built.select("lang", "shard", F.coalesce(F.sum(F.size("keys")).over(before), F.lit(0)).alias("base")),
                      ["lang", "shard"])


def _rounds(hashes: DataFrame, limit: int) -> Iterator[DataFrame]:
    """The shards in runs of about ``limit`` bytes: a row per shard reaches the driver for that, without its keys."""
    at, chosen = 0, []
    for row in hashes.select("lang", "shard", "bytes").orderBy("lang", "shard").toLocalIterator():
        if chosen and at + row["bytes"] > limit:
            yield _chosen(hashes, chosen)
            at, chosen = 0, []
        at += row["bytes"]
        chosen.append((row["lang"], row["shard"]))
    if chosen:
        yield _chosen(hashes, chosen)


def _chosen(hashes: DataFrame, names: list[tuple[str, int]]) -> DataFrame:
    wanted = hashes.sparkSession.createDataFrame(names, "lang string, shard bigint")
    return hashes.join(F.broadcast(wanted), ["lang", "shard"], "left_semi")


def slot_counts(docs: DataFrame, hashes: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(lang, source, slot, count) of the kept terms that occur in a group; written."""
    spark, parts = docs.sparkSession, []
    for shards in _rounds(hashes, limit):
        sizes: dict[str, int] = {}
        present: dict[str, dict[int, Shard]] = {}
        for r in shards.toLocalIterator():
            sizes[r["lang"]] = r["shards"]
            present.setdefault(r["lang"], {})[r["shard"]] = Shard(
                r["base"], r["seed"], np.array(r["displaced"], np.int64), pa.array(r["keys"], pa.string()))
        shared = spark.sparkContext.broadcast(PerfectHashes(sizes, present))

        def recount(batches, shared=shared):
            tables, groups = shared.value, {}
            low = {lang: min(s.base for s in found.values()) for lang, found in tables.shards.items()}
            high = {lang: max(s.base + len(s.keys) for s in found.values()) for lang, found in tables.shards.items()}

            def sent():
                for (lang, source), slots in groups.items():
                    at = np.flatnonzero(slots)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(at), pa.string()), pa.array([source] * len(at), pa.string()),
                         pa.array(at + low[lang]), pa.array(slots[at])], ["lang", "source", "slot", "count"])
                groups.clear()

            held = 0
            for batch in text_slices(batches):
                names = column(batch, "source").dictionary_encode()
                for lang, rows, texts in _by_lang(batch):
                    if lang not in low:
                        continue
                    size = high[lang] - low[lang]
                    codes, terms, starts = terms_of(texts)
                    slot = tables.slots(lang, terms)[codes]
                    stored = slot >= 0
                    source = np.repeat(names.indices.to_numpy()[rows], np.diff(starts))[stored].astype(np.int64)
                    cells, times = np.unique(source * size + slot[stored] - low[lang], return_counts=True)
                    of, first = np.unique(cells // size, return_index=True)
                    for code, one, count in zip(of, np.split(cells % size, first[1:]), np.split(times, first[1:])):
                        group = lang, names.dictionary[int(code)].as_py()
                        if group not in groups:
                            if groups and held + 8 * size > SLOT_ARRAYS_BYTES:
                                yield from sent()
                                held = 0
                            groups[group] = np.zeros(size, np.int64)
                            held += 8 * size
                        groups[group][one] += count
            yield from sent()

        counted = docs.mapInArrow(recount, "lang string, source string, slot bigint, count bigint")
        parts.append(cut_lineage(counted.groupBy("lang", "source", "slot").agg(F.sum("count").alias("count"))))
        shared.unpersist()
    counts = spark.createDataFrame([], "lang string, source string, slot bigint, count bigint") if not parts else parts[0]
    for more in parts[1:]:
        counts = counts.unionByName(more)
    return counts


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), in decimals as counts may be large."""
    return F.expr(f"(1000000000BD * cast({count} + 5 as decimal(19,0))) div cast({total} + 5 * {kept} as decimal(20,0)) + 1")


def _pair_sums(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, one, other, value): for sources one < other the summed differences of their shares over all kept terms.

    ``shares`` is (lang, slot, number, p) where a term occurs, ``groups`` (lang, number, kept, p0) with the share of
    absent terms. Slots go in blocks, each a small dense matrix of all sources of a language, so no row is made
    per pair and term.
    """
    langs = groups.groupBy("lang").agg(
        F.first("kept").alias("kept"), F.transform(F.sort_array(F.collect_list(F.struct("number", "p0"))), lambda g: g["p0"]).alias("p0"))
    langs = langs.withColumn("width", F.greatest(F.lit(1), F.expr(f"{BLOCK_CELLS} div size(p0)")).cast("bigint"))
    blocks = langs.withColumn("block", F.explode(F.expr("sequence(0L, greatest(kept - 1, 0L) div width)")))
    # A language's width is repeated on its rows; both sides then meet by (language, block).
    placed = shares.join(langs.select("lang", "width"), "lang").withColumn("block", F.expr("slot div width"))

    def differences(key, left, right):
        row = {name: right[name][0].as_py() for name in ("p0", "width", "kept")}
        block, p0 = key[1].as_py(), np.array(row["p0"], np.int64)
        low = block * row["width"]
        cells = np.repeat(p0[:, None], min(row["width"], row["kept"] - low), axis=1)
        cells[left["number"].to_numpy(), left["slot"].to_numpy() - low] = left["p"].to_numpy()
        one, other = np.triu_indices(len(p0), 1)
        values = [np.abs(cells[i + 1:] - cells[i]).sum(axis=1) for i in range(len(p0))]
        return pa.table({"lang": pa.array([key[0].as_py()] * len(one), pa.string()), "one": pa.array(one, pa.int64()),
                         "other": pa.array(other, pa.int64()), "value": pa.array(np.concatenate(values), pa.int64())})

    sums = placed.select("lang", "block", "slot", "number", "p").groupBy("lang", "block").cogroup(
        blocks.select("lang", "block", "kept", "width", "p0").groupBy("lang", "block")).applyInArrow(
            differences, "lang string, one bigint, other bigint, value bigint")
    return sums.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS,
               limit: int = BROADCAST_BYTES) -> DataFrame:
    """Compare the sources of each language of ``docs`` (text, lang, source): lang, source, part, item, value, rank.

    Part ``pair``: how far the shares of every other source of the language differ, over all kept terms. Part
    ``term``: the ``top`` terms whose share in the source exceeds that in the language by most. A kept term occurs in at
    least ``least_documents`` documents of the language. Ranks start at 1 and ascend with falling values,
    ties with the item's bytes.

    Null texts, languages and sources are empty ones, and an empty language or source is one like others. Texts
    without terms count for their group alone; a language without kept terms has pairs of value 0 and no
    terms. Whole texts are counted, repeated rows each time. Other columns are not read. An empty table gives an
    empty result. Hashes beyond ``limit`` bytes are broadcast in several rounds, each another pass over the texts.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = cut_lineage(document_counts(rows).where(F.col("documents") >= least_documents).select("lang", "term"))
    hashes = cut_lineage(perfect_hashes(kept))
    counts = slot_counts(rows, hashes, limit)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = (rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
              .fillna(0, ["total", "kept"]))
    numbered = Window.partitionBy("lang").orderBy("source")
    groups = cut_lineage(groups.select(
        "lang", "source", "total", "kept", (F.row_number().over(numbered) - 1).cast("bigint").alias("number"),
        F.when(F.col("kept") > 0, share("0L", "total", "kept")).otherwise(0).alias("p0"),
        F.sum("total").over(Window.partitionBy("lang")).alias("lang_total")))
    every = F.sum("count").over(Window.partitionBy("lang", "slot"))
    shares = counts.withColumn("lang_count", every).join(groups, ["lang", "source"]).select(
        "lang", "source", "slot", "number", share("count", "total", "kept").alias("p"),
        share("lang_count", "lang_total", "kept").alias("q"))
    shares = cut_lineage(shares)
    keys = hashes.select("lang", "base", F.posexplode("keys").alias("at", "item")).select(
        "lang", (F.col("base") + F.col("at")).alias("slot"), "item")
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (shares.where("p > q").join(keys, ["lang", "slot"]).select("lang", "source", "item", (F.col("p") - F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= top))
    sums = cut_lineage(_pair_sums(shares.select("lang", "slot", "number", "p"), groups))
    both = sums.unionByName(sums.select("lang", F.col("one").alias("other"), F.col("other").alias("one"), "value"))
    names = groups.select("lang", "number", "source")
    pairs = (both.join(names.withColumnRenamed("number", "one"), ["lang", "one"])
             .join(names.select("lang", F.col("number").alias("other"), F.col("source").alias("item")), ["lang", "other"])
             .select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(ranks)))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(
        terms.withColumn("part", F.lit("term")).select(columns))
