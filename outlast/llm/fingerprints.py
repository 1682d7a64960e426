"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A document is its words weighted by their counts. For each sample and word, two Gamma(2, 1) variates r, c
and a uniform b come from hashes of both; with t = floor(ln(weight) / r + b) the word competes with
a = c / (exp(r * (t - b)) * exp(r)), and the least a wins. The sample is the winning (word, t): two documents
draw the same one with a probability equal to their generalised Jaccard similarity.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlast.functions.ordering import slot_of

SAMPLES = 40
BUCKET_BYTES = 4 << 20
MOST_BUCKETS = 1 << 16
FIRST_ID = -(1 << 63)
SPACE = r"[\x20\x09-\x0D]+"
UP_TO_LAST_SPACE = r"(?s)^.*[\x20\x09-\x0D]"
LN2 = math.log(2)


def _bits(hashed: Column, start: int, size: int) -> Column:
    return F.shiftrightunsigned(hashed, start).bitwiseAND(F.lit((1 << size) - 1))


def _series(s: str, center: float) -> Column:
    """ln(x) for s = (x - center) / (x + center), where the column ``{s}2`` holds s squared."""
    odd, total = F.col(f"{s}2"), F.lit(1 / 11)
    for k in (9, 7, 5, 3, 1):
        total = total * odd + 1 / k
    return total * F.col(s) * 2.0 + math.log(center)


def candidates(terms: DataFrame, log_weights: list[str], samples: int, draws: Column | None = None) -> DataFrame:
    """Every row of ``terms`` once per sample (column j), with the candidate of each of ``log_weights``.

    A candidate has ln(a) in the upper bits and a hash of (term, t) in the lower 30: the least value is the
    sample. It is null for a null weight. ``draws`` is an array of sample numbers other than 0, 1, ...; a
    negative number marks a row whose candidate is the term itself.

    -ln(u) of a uniform u is ln(2) times the zeros before the first set bit of a hash plus -ln of a uniform in
    (1/2, 1); two of them make a Gamma(2, 1) variate. So it takes bits and one short series, whose argument the
    range of the mantissas bounds; ln(c) is 8 ln of the eighth root of c. Steps are columns of their own, each
    referred to more than once, so that the plan keeps them apart and generated methods stay short.
    """
    numbers = F.sequence(F.lit(0), F.lit(samples - 1)) if draws is None else draws
    rows = terms.select("*", F.explode(numbers).alias("j"))
    rows = rows.withColumns({"h": F.xxhash64("term", F.lit(1), "j"), "g": F.xxhash64("term", F.lit(2), "j")})

    def mantissa(hashed: str, start: int, size: int) -> Column:
        return (_bits(F.col(hashed), start, size) + 0.5) * (0.5 / (1 << size)) + 0.5

    rows = rows.withColumns({  # the zeros end at two bits set beyond the places drawn
        "hz": _bits(F.col("h"), 0, 18).bitwiseOR(F.lit(3 << 18)), "gz": _bits(F.col("g"), 0, 20).bitwiseOR(F.lit(3 << 20)),
        "hm": mantissa("h", 18, 15) * mantissa("h", 33, 15), "gm": mantissa("g", 20, 22) * mantissa("g", 42, 22),
        "b": (_bits(F.col("h"), 48, 16) + 0.5) / float(1 << 16)})
    rows = rows.withColumns({z: F.col(z).bitwiseAND(F.col(z) - 1) for z in ("hz", "gz")})  # without the first one
    rows = rows.withColumns({s: (F.col(m) - 0.5) / (F.col(m) + 0.5) for s, m in (("hs", "hm"), ("gs", "gm"))})
    rows = rows.withColumns({f"{s}2": F.col(s) * F.col(s) for s in ("hs", "gs")})

    def gamma(zeros: str, s: str) -> Column:
        second = F.bit_count(F.col(zeros).bitwiseAND(-F.col(zeros)) - 1)
        return (second - 1) * LN2 - _series(s, 0.5)

    rows = rows.withColumns({"r": gamma("hz", "hs"), "root": F.sqrt(F.sqrt(F.sqrt(gamma("gz", "gs"))))})
    rows = rows.withColumn("cs", (F.col("root") - 0.8) / (F.col("root") + 0.8)).withColumn("cs2", F.col("cs") * F.col("cs"))
    rows = rows.withColumn("log_c", _series("cs", 0.8) * 8.0)
    rows = rows.withColumns({f"t_{w}": F.floor(F.col(w) / F.col("r") + F.col("b")) for w in log_weights})

    def least(w: str) -> Column:
        t = F.col(f"t_{w}")
        log_a = F.col("log_c") - F.col("r") * (t - F.col("b") + 1.0)
        ordered = F.floor((F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), log_a)) + 1024.0) * float(1 << 22))
        packed = F.shiftleft(ordered, 30).bitwiseOR(F.xxhash64("term", t).bitwiseAND(F.lit((1 << 30) - 1)))
        return F.when(F.col("j") < 0, F.col("term")).when(t.isNotNull(), packed)

    return rows.select(*terms.columns, "j", *[least(w).alias(f"least_{w}") for w in log_weights])


def as_text(samples: Column) -> Column:
    """Eight hexadecimal digits per sample; the empty string without terms."""
    digits = F.transform(samples, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")))
    return F.when(F.get(samples, F.lit(0)).isNull(), "").otherwise(F.array_join(digits, ""))


def likeness(one: Column, other: Column, samples: int) -> Column:
    """The share of equal samples; 1 for two documents without terms, 0 if only one has none."""
    equal = F.size(F.filter(F.zip_with(one, other, lambda x, y: x.eqNullSafe(y)), lambda x: x))
    return equal.cast("double") / F.lit(float(samples))


def _bucketed(docs: DataFrame) -> DataFrame:
    """The documents by ranges of ids (bucket), and in each range also the first document of the next one (guest).

    Ranges hold about BUCKET_BYTES of text each; ids descend within them, and the lowest range is followed
    by the highest. Equal ids share a range.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST_ID)).alias("id"),
                       F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 2
    while buckets < MOST_BUCKETS and buckets * BUCKET_BYTES < size:
        buckets *= 2
    shares = [i / buckets for i in range(1, buckets)]
    bounds = rows.agg(F.percentile_approx("id", shares, 4 * buckets)).first()[0] or [0] * (buckets - 1)
    rows = rows.withColumn("bucket", slot_of(F.col("id"), F.lit(bounds).cast("array<bigint>"), buckets - 1).cast("int"))
    # One number per bucket reaches the driver: the largest id there, which precedes the next bucket's end.
    found = {r["bucket"]: r["top"] for r in rows.groupBy("bucket").agg(F.max("id").alias("top")).collect()}
    filled = sorted(found)
    above = dict(zip(filled, filled[1:] + filled[:1]))
    top, before = (F.get(F.lit([t.get(i, FIRST_ID) for i in range(buckets)]).cast("array<bigint>"), F.col("bucket"))
                   for t in (found, above))
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    there = F.struct(before.cast("int").alias("bucket"), F.lit(True).alias("guest"))
    placed = rows.select("id", "doc_id", "text", F.explode(
        F.when(F.col("id") == top, F.array(here, there)).otherwise(F.array(here))).alias("place"))
    dealt = placed.select("place.bucket", "place.guest", "id", "doc_id", "text").repartition(buckets, "bucket")
    following = Window.partitionBy("bucket").orderBy("guest", F.desc("id"), F.xxhash64("text"), "text")
    return dealt.select("bucket", "guest", "doc_id", "text", F.row_number().over(following).alias("place"),
                        F.lead("text").over(following).alias("next_text"))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprint every text of ``docs`` (doc_id, text) and its edited text.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document by descending doc_id; the first follows the last. Columns: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next (shares of equal samples).

    Null texts are empty. Null doc_ids come after all others. Rows that repeat a doc_id follow each other in
    an order of their texts. A text without words has an empty fingerprint, equal only to another such.
    Texts of any length are read whole; other columns are not read. An empty table gives an empty result.
    """
    placed = _bucketed(docs)
    keys = ["bucket", "place"]
    length = F.length("text")
    cut = F.when(F.col("guest"), 0).otherwise(F.floor(length / 2)).cast("int")
    # Up to the last space before the cut both versions have the same words, which are counted once for both.
    parts = placed.select(*keys, "guest", "doc_id", length.alias("size"), F.substring("text", F.lit(1), length - cut).alias("head"),
                          F.substring("text", length - cut + 1, cut).alias("tail"),
                          F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut).alias("new_tail"))
    parts = parts.withColumn("both", F.regexp_extract("head", UP_TO_LAST_SPACE, 0))
    parts = parts.withColumn("rest", F.substring("head", F.length("both") + 1, F.length("head")))
    digest = F.sha2(F.concat("head", "new_tail").cast("binary"), 256)
    facts = [F.col("doc_id"), F.col("size"), F.col("guest").cast("int"),
             *[F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10) for i in range(4)]]
    worded = parts.select(*keys, F.array(*[f.cast("string") for f in facts]).alias("facts"),
                          F.split("both", SPACE).alias("both"), F.split(F.concat("rest", "tail"), SPACE).alias("old"),
                          F.split(F.concat("rest", "new_tail"), SPACE).alias("new"))
    # What is told of a document travels as further rows after its words, so the texts are dealt once and not joined.
    shared = F.size("both")
    old = shared + F.size("old")
    everything = worded.select(*keys, shared.alias("n0"), old.alias("n1"), (old + F.size("new")).alias("n2"), F.posexplode(
        F.concat("both", "old", "new", "facts")).alias("pos", "word"))
    fact = F.greatest(F.lit(-1), F.col("pos") - F.col("n2"))  # the number of the fact, -1 for a word
    told = everything.where((F.col("word") != "") | (F.col("pos") >= F.col("n2"))).select(
        *keys, fact.alias("fact"), F.when(fact >= 0, F.col("word").try_cast("bigint")).otherwise(F.xxhash64("word")).alias("term"),
        (F.col("pos") < F.col("n1")).cast("int").alias("old"),
        ((F.col("pos") < F.col("n0")) | ((F.col("pos") >= F.col("n1")) & (F.col("pos") < F.col("n2")))).cast("int").alias("new"))
    terms = told.groupBy(*keys, "fact", "term").agg(F.sum("old").alias("old"), F.sum("new").alias("new"))

    def log_of(weight: str) -> Column:
        return F.when(F.col(weight) > 0, F.log(F.col(weight).cast("double"))).alias(weight)

    numbers = F.when(F.col("fact") >= 0, F.array(-1 - F.col("fact"))).otherwise(F.sequence(F.lit(0), F.lit(samples - 1)))
    rows = candidates(terms.select(*keys, "fact", "term", log_of("old"), log_of("new")), ["old", "new"], samples, numbers)
    least = rows.groupBy(*keys, "j").agg(F.min("least_old").alias("s0"), F.min("least_new").alias("s1"))

    def told_of(number: int) -> Column:
        return F.max(F.when(F.col("j") == -1 - number, F.col("s0")))

    drawn = F.sort_array(F.collect_list(F.when(F.col("j") >= 0, F.struct("j", "s0", "s1"))))
    joined = least.groupBy(*keys).agg(drawn.alias("drawn"), *[told_of(i).alias(f"f{i}") for i in range(len(facts))])
    none = F.array_repeat(F.lit(None).cast("bigint"), samples)
    joined = joined.withColumns({s: F.when(F.size("drawn") > 0, F.col(f"drawn.{s}")).otherwise(none) for s in ("s0", "s1")})
    following = Window.partitionBy("bucket").orderBy("place")
    sha = F.lower(F.concat(*[F.lpad(F.hex(f"f{3 + i}"), 16, "0") for i in range(4)]))
    return joined.withColumn("next", F.lead("s0").over(following)).where("f2 = 0").select(
        F.col("f0").alias("doc_id"), F.col("f1").alias("n_chars"), sha.alias("edited_sha256"),
        as_text(F.col("s0")).alias("fingerprint"), as_text(F.col("s1")).alias("edited_fingerprint"),
        likeness(F.col("s0"), F.col("s1"), samples).alias("near_edited"),
        likeness(F.col("s0"), F.col("next"), samples).alias("near_next"))
