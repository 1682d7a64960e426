import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from outlast.llm import fingerprints


def likeness(one, two):
    a, b = (Counter(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in (one, two))
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


def edited(rows):
    texts = [t or "" for _, t in rows]
    return [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for t, n in zip(texts, texts[1:] + texts[:1])]


@pytest.mark.parametrize("bucket_bytes", [4 << 20, 40_000])
def test_documents(documents, bucket_bytes, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", bucket_bytes)
    rows = in_order([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])
    found = {r.doc_id: r for r in fingerprints.fingerprints(documents).collect()}
    assert len(found) == len(rows)
    texts = [t or "" for _, t in rows]
    for (i, _), text, following, new in zip(rows, texts, texts[1:] + texts[:1], edited(rows)):
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert r.near_edited == pytest.approx(likeness(text, new), abs=0.45)
        assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1)
    wanted = [likeness(t, n) for t, n in zip(texts, edited(rows))]
    assert np.mean([abs(found[i].near_edited - w) for (i, _), w in zip(rows, wanted)]) < 0.1
    by_text = {}
    for (i, _), text in zip(rows, texts):
        by_text.setdefault(text, set()).add(found[i].fingerprint)
    assert all(len(s) == 1 for s in by_text.values())


def test_odd_rows(odd_documents, odd_rows, no_documents):
    found = fingerprints.fingerprints(odd_documents).collect()
    assert Counter((r.doc_id, r.n_chars) for r in found) == Counter((r[0], len(r[1] or "")) for r in odd_rows)
    known = in_order([r[:2] for r in odd_rows if r[0] is not None])
    by_id = {r.doc_id: r for r in found}
    for (i, text), (_, following) in zip(known, known[1:]):
        if i != 7:
            new = edited([(i, text), (0, following)])[0]
            assert by_id[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
    assert by_id[3].fingerprint == "" and by_id[4].near_next == 1.0  # blank, then empty
    assert by_id[6].near_next == 1.0 and by_id[5].fingerprint == by_id[6].fingerprint
    assert fingerprints.fingerprints(no_documents).collect() == []


def test_collisions_equal_weighted_jaccard(llm):
    """Many samples of two weighted sets collide as often as their generalised Jaccard similarity says."""
    one, two = {"a": 3, "b": 1, "c": 7, "d": 2}, {"a": 5, "b": 1, "c": 2, "e": 4}
    rows = [(k, n, 0, i) for i, s in enumerate((one, two)) for k, n in s.items()]
    terms = llm.createDataFrame(rows, "word string, weight int, version int, place int").select(
        "place", "version", F.xxhash64("word").alias("term"), F.log(F.col("weight").cast("double")).alias("w"))
    samples = 400
    least = fingerprints.candidates(terms, ["w"], samples).groupBy("j", "place").agg(F.min("least_w").alias("s"))
    equal = least.groupBy("j").agg((F.min("s") == F.max("s")).cast("int").alias("same")).agg(F.sum("same")).first()[0]
    wanted = (3 + 1 + 2) / (5 + 1 + 7 + 2 + 4)
    assert equal / samples == pytest.approx(wanted, abs=0.08)


def test_draws_follow_gamma(llm):
    """P(r < q) of a Gamma(2, 1) variate is 1 - exp(-q) (1 + q); with weight e^100 t tells r apart."""
    terms = llm.range(500).select(F.xxhash64("id").alias("term"), F.lit(0.0).alias("w"))
    rows = fingerprints.candidates(terms, ["w"], 40).select((F.shiftright("least_w", 30) / float(1 << 22) - 1024.0).alias("log_a"))
    found = np.sort([r.log_a for r in rows.collect()])
    draw = np.random.default_rng(5)
    r, c, b = draw.gamma(2, 1, 200_000), draw.gamma(2, 1, 200_000), draw.random(200_000)
    wanted = np.sort(np.log(c) - r * (1 - b))  # weight 1: t is 0
    for q in (0.01, 0.1, 0.3, 0.5, 0.7, 0.9, 0.99):
        assert np.mean(found < np.quantile(wanted, q)) == pytest.approx(q, abs=0.012)


def test_plan_is_native_and_deals_texts_once(documents):
    plan = fingerprints.fingerprints(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange") == 1 and "hashpartitioning(bucket" in plan
