"""Language-model scoring by deleted interpolation of word n-grams.

P(w | v) mixes the maximum-likelihood estimates of the bigram and the unigram and a uniform distribution.
The weights depend on a bucket of the context's count and are learned by expectation-maximisation: held-out
documents of the learning set are explained by counts from which they are deleted.

Counts never leave Spark whole. A block of documents reduces its n-grams to sorted distinct hashes with their
own counts, cut into ranges of the hash; one task per range adds up all blocks' counts and answers each block
in the order it asked. A word that is in every document costs one entry per block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlast.llm.words import column, fold_of, pair_hash, split_words, text_column, word_hashes
from outlast.session import cut_lineage

FOLDS, HELD_OUT = 7, 2
INNER_FOLDS = 8  # of the learning documents, one in so many is held out for the mixture weights
BLOCK_BITS = 10  # documents of a block: 2 to this power
RANGE_BYTES = 16 << 20  # of text per range of hashes
LEAST_RANGES = 32
STEPS = 20
ENOUGH = 1e-4
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)  # hashes of no word


@dataclass
class Ngrams:
    """Of the documents of a block: distinct hashes, the place of every token's n-gram, and token bounds."""

    words: np.ndarray
    pairs: np.ndarray
    word_of: np.ndarray
    pair_of: np.ndarray
    context_of: np.ndarray
    starts: np.ndarray


def ngrams(texts: pa.Array) -> Ngrams:
    """Tokens are the words of a text and then one end; the first token's context is the start."""
    codes, distinct, word_starts = split_words(texts)
    documents = len(texts)
    starts = word_starts + np.arange(documents + 1)
    hashes = np.empty(starts[-1], np.uint64)
    ends = starts[1:] - 1
    inside = np.ones(len(hashes), bool)
    inside[ends] = False
    hashes[inside] = word_hashes(distinct)[codes]
    hashes[ends] = END
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[starts[:-1]] = START
    words, places = np.unique(np.concatenate((hashes, before)), return_inverse=True)
    pairs, pair_of = np.unique(pair_hash(before, hashes), return_inverse=True)
    return Ngrams(words, pairs, places[:len(hashes)], pair_of, places[len(hashes):], starts)


def pack_hashes(hashes: np.ndarray) -> bytes:
    """Sorted distinct uint64 as the width of a step, the first and the steps."""
    if not len(hashes):
        return b""
    steps = np.diff(hashes)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return (bytes([width]) + hashes[:1].astype("<u8").tobytes()
            + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes())


def unpack_hashes(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    width = data[0]
    steps = np.zeros(((len(data) - 9) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(np.concatenate((np.frombuffer(data, "<u8", 1, 1), steps.reshape(-1).view("<u8"))), dtype=np.uint64)


def pack_counts(*counts: np.ndarray) -> bytes:
    """Equally long counts, their bytes ordered by significance and compressed."""
    import zstandard

    planes = np.stack(counts).astype("<u8").reshape(-1).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_counts(data: bytes, series: int) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(series, -1).astype(np.int64)


def _fingerprint(ids: pa.Array, starts: np.ndarray) -> int:
    return zlib.crc32(starts.tobytes(), zlib.crc32(str(ids.to_pylist()).encode()))


def _with_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, text, held_out, kind (0: not learned from, 1: learned from, 2: held out for the weights), block.

    A block is a run of rows of one partition; documents of kind 2 have blocks of their own.
    """
    fold = fold_of(F.col("doc_id"), FOLDS)
    inner = F.pmod(F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / FOLDS), F.lit(INNER_FOLDS))
    kind = F.when(fold.isNull() | (fold == HELD_OUT), 0).when(inner == 0, 2).otherwise(1)
    run = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS) * 2
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), kind.alias("kind"), run.alias("run"))
    return rows.select("doc_id", "text", "held_out", "kind",
                       (F.col("run") + F.when(F.col("kind") == 2, 1).otherwise(0)).alias("block"))


def _ranges_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of the ranges starts in sorted hashes, and their end."""
    return np.searchsorted((hashes >> np.uint64(32)).astype(np.int64) * ranges >> 32, np.arange(ranges + 1))


def ask(rows: DataFrame, ranges: int) -> DataFrame:
    """A row per block and range: the block's distinct n-grams there, with its learned and held-out counts."""
    names = ["block", "check", "range", "words", "word_counts", "pairs", "pair_counts"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def questions(block: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        grams = ngrams(text_column(table))
        sizes = np.diff(grams.starts)
        kinds = column(table, "kind").to_numpy()
        kind = np.repeat(kinds, sizes)
        first = np.zeros(len(kind), bool)
        first[grams.starts[:-1]] = True

        def counted(places: np.ndarray, size: int, wanted: int) -> np.ndarray:
            return np.bincount(places[kind == wanted], minlength=size)

        # The start is counted as the context of first tokens, all other words where they stand.
        word_counts, pair_counts = [], []
        for wanted in (1, 2):
            of_words = counted(grams.word_of, len(grams.words), wanted)
            of_words += np.bincount(grams.context_of[first & (kind == wanted)], minlength=len(grams.words))
            word_counts.append(of_words)
            pair_counts.append(counted(grams.pair_of, len(grams.pairs), wanted))
        w, p = _ranges_of(grams.words, ranges), _ranges_of(grams.pairs, ranges)
        check = _fingerprint(column(table, "doc_id"), grams.starts)
        out = []
        for r in range(ranges):
            a, b, c, d = w[r], w[r + 1], p[r], p[r + 1]
            if b > a or d > c:
                out.append((block, check, r, pack_hashes(grams.words[a:b]), pack_counts(*(x[a:b] for x in word_counts)),
                            pack_hashes(grams.pairs[c:d]), pack_counts(*(x[c:d] for x in pair_counts))))
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            blocks = column(batch, "block").to_numpy()
            for block in dict.fromkeys(blocks.tolist()):
                for old in [b for b in held if b // 2 != block // 2]:  # rows come in runs
                    yield questions(old, held.pop(old))
                held.setdefault(block, []).append(batch.filter(pa.array(blocks == block)))
        for block in list(held):
            yield questions(block, held.pop(block))

    return rows.select("doc_id", "text", "kind", "block").mapInArrow(
        run, "block bigint, check bigint, range int, words binary, word_counts binary, pairs binary, pair_counts binary")


def answer(asked: DataFrame) -> DataFrame:
    """``asked`` with the corpus' counts instead of the block's; a row with a null block has the range's totals."""
    names = ["block", "check", "range", "word_counts", "pair_counts"]

    def total(keys: list[np.ndarray], counts: list[np.ndarray]):
        ends = np.cumsum([len(k) for k in keys])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = [np.bincount(place, np.concatenate([c[i] for c in counts]), len(distinct)).astype(np.int64)
                for i in range(2)]
        return distinct, sums, np.split(place, ends[:-1])

    def run(key, table):
        order = table.sort_by("block")
        out = []
        sides = {}
        for name in ("word", "pair"):
            keys = [unpack_hashes(x) for x in order[f"{name}s"].to_pylist()]
            counts = [unpack_counts(x, 2) for x in order[f"{name}_counts"].to_pylist()]
            sides[name] = total(keys, counts)
        words, (learned, held), _ = sides["word"]
        true = words != START
        starts = [int(x[~true].sum()) for x in (learned, held)]
        numbers = [int(learned[true].sum()), int(held[true].sum()), int((learned[true] > 0).sum()),
                   int((learned + held)[true].astype(bool).sum()), *starts]
        for i, (block, check) in enumerate(zip(order["block"].to_pylist(), order["check"].to_pylist())):
            reply = [pack_counts(*(s[sides[name][2][i]] for s in sides[name][1])) for name in ("word", "pair")]
            out.append((block, check, key[0].as_py(), *reply, None))
        out.append((None, None, key[0].as_py(), None, None, numbers))
        types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        return pa.table([pa.array(v, t) for v, t in zip(zip(*out), types)], names=[*names, "totals"])

    return asked.groupBy("range").applyInArrow(
        run, "block bigint, check bigint, range int, word_counts binary, pair_counts binary, totals array<bigint>")


def _read_block(docs, replies):
    """The n-grams of a block's documents and its answers: (learned, held-out) counts of words and of pairs."""
    table = docs.sort_by("row").combine_chunks()
    batch = table.to_batches()[0]
    grams = ngrams(text_column(batch))
    replies = replies.sort_by("range")
    if set(replies["check"].to_pylist()) != {_fingerprint(column(batch, "doc_id"), grams.starts)}:
        raise ValueError("the documents came in another order than before: score a written table")
    counts = [np.concatenate([unpack_counts(x, 2) for x in replies[f"{name}_counts"].to_pylist()], axis=1)
              for name in ("word", "pair")]
    return batch, grams, counts[0], counts[1]


def _bucket(counts):
    """0 for an unseen context, else 1 + the whole part of its count's binary logarithm."""
    return np.where(counts > 0, np.frexp(np.maximum(counts, 1).astype(float))[1], 0)


def held_out_tuples(held: DataFrame, replies: DataFrame) -> DataFrame:
    """How often each (pair, context, word) count, without the held-out documents, occurs in these."""

    def run(docs, answers):
        names = ["pair", "context", "word", "n"]
        if not docs.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        _, grams, words, pairs = _read_block(docs, answers)
        rows = np.stack((pairs[0][grams.pair_of], words[0][grams.context_of], words[0][grams.word_of]))
        distinct, n = np.unique(rows, axis=1, return_counts=True)
        return pa.table([pa.array(x.astype(np.int64)) for x in (*distinct, n)], names=names)

    tuples = held.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        run, "pair bigint, context bigint, word bigint, n bigint")
    return tuples.groupBy("pair", "context", "word").agg(F.sum("n").alias("n"))


def learn_weights(tuples: DataFrame, tokens: int, distinct: int, steps: int = STEPS) -> dict[int, tuple[float, float, float]]:
    """Per bucket of the context's count, the weights of pair, word and uniform estimates, by EM.

    The driver keeps three numbers per bucket; buckets are powers of two, so there are at most 64.
    """
    bucket = F.when(F.col("context") > 0, F.floor(F.log2(F.col("context").cast("double"))) + 1).otherwise(0).cast("int")
    rows = cut_lineage(tuples.select(
        bucket.alias("bucket"), F.col("n").cast("double").alias("n"),
        F.when(F.col("context") > 0, F.col("pair") / F.col("context")).otherwise(F.lit(0.0)).alias("two"),
        (F.col("word") / F.lit(float(max(1, tokens)))).alias("one"), F.lit(1.0 / (distinct + 1)).alias("none")))
    weights: dict[int, tuple[float, float, float]] = {}
    for _ in range(steps):
        parts: list[Column] = []
        for i, name in enumerate(("two", "one", "none")):
            weight = F.lit(1 / 3)
            for b, w in weights.items():
                weight = F.when(F.col("bucket") == b, F.lit(w[i])).otherwise(weight)
            parts.append(weight * F.col(name))
        shares = rows.select("bucket", "n", *[p.alias(f"p{i}") for i, p in enumerate(parts)])
        mixed = F.col("p0") + F.col("p1") + F.col("p2")
        sums = shares.groupBy("bucket").agg(F.sum("n").alias("n"), *[
            F.sum(F.col("n") * F.col(f"p{i}") / mixed).alias(f"s{i}") for i in range(3)]).collect()
        new = {r["bucket"]: tuple(r[f"s{i}"] / r["n"] for i in range(3)) for r in sums}
        moved = max((abs(x - y) for b, w in new.items() for x, y in zip(w, weights.get(b, (1, 1, 1)))), default=0)
        weights = new
        if moved < ENOUGH:
            break
    return weights


def weight_table(weights: dict[int, tuple[float, float, float]]) -> np.ndarray:
    """Weights of all 65 buckets; one without held-out tokens takes those of the next lower, or a default."""
    table = np.empty((65, 3))
    last = None
    for b in range(65):
        found = weights.get(b)
        if found is None:
            found = last or ((0.0, 0.9, 0.1) if b == 0 else (0.5, 0.4, 0.1))
        elif b:
            last = found
        # A little of each estimate is kept, so that every token has a probability.
        table[b] = np.maximum(found, 1e-6)
        table[b] /= table[b].sum()
    return table


def score_documents(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text).

    The model learns from documents with crc32(doc_id as text) mod 7 other than 2. base_score is the add-one
    unigram log10 probability, score the mixture's. Null texts are empty: one end. A null doc_id is neither
    learned from nor held out; rows that repeat a doc_id are answered, and learned from, row by row. Other
    columns are not read. Without learning documents both scores are 0 for tokens of probability 1. An empty
    table gives an empty result.

    ``docs`` is read three times and must give the same rows in the same partitions, as a written table does;
    other rows are an error.
    """
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    ranges = max(LEAST_RANGES, -(-size // range_bytes))
    rows = _with_blocks(docs)
    replies = cut_lineage(answer(ask(rows, ranges)))
    totals = replies.where("block is null").select(*[F.sum(F.get("totals", F.lit(i))).alias(f"t{i}") for i in range(6)]).first()
    learned, held, learned_distinct, distinct, _, _ = (int(t or 0) for t in totals)
    replies = replies.where("block is not null").drop("totals")
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    weights = weight_table(learn_weights(
        held_out_tuples(numbered.where("kind = 2"), replies.where("block % 2 = 1")), learned, learned_distinct))
    tokens = learned + held

    def run(documents, answers):
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not documents.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        batch, grams, words, pairs = _read_block(documents, answers)
        words, pairs = words.sum(axis=0), pairs.sum(axis=0)
        word, context, pair = words[grams.word_of], words[grams.context_of], pairs[grams.pair_of]
        mix = weights[_bucket(context)]
        two = pair / np.maximum(context, 1)
        chance = mix[:, 0] * two + mix[:, 1] * (word / max(1, tokens)) + mix[:, 2] / (distinct + 1)
        if not tokens:
            chance = np.ones_like(chance)
        base = np.log10((word + 1) / (tokens + distinct + 1))
        at = grams.starts[:-1]
        columns = [np.diff(grams.starts), np.add.reduceat((word > 0).astype(np.int64), at),
                   np.full(len(at), tokens), np.add.reduceat(base, at), np.add.reduceat(np.log10(chance), at)]
        return pa.table([column(batch, "doc_id"), column(batch, "held_out"),
                         *[pa.array(c, t) for c, t in zip(columns, types[2:])]], names=names)

    return numbered.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
             "base_score double, score double")
