import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from outlast.llm import langid, quality

from .conftest import SF


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def test_gradients_match_differences():
    draw = np.random.default_rng(1)
    net = langid.new_network(["a", "b", "c"], 3, 2, 5, np.float64)
    taken, labels = draw.integers(0, 256, (6, 4)), np.array([0, 1, 2, 1])
    real = (np.arange(6)[:, None] < np.array([6, 4, 1, 6])).astype(float)
    _, gradients = langid.loss_and_gradients(net, taken, real, labels)
    for array, gradient in zip(net.arrays(), gradients):
        places = [tuple(p) for p in np.argwhere(np.abs(gradient) > 1e-4)[:4]]
        for place in places:
            kept = array[place]
            array[place] = kept + 1e-6
            up, _ = langid.loss_and_gradients(net, taken, real, labels)
            array[place] = kept - 1e-6
            down, _ = langid.loss_and_gradients(net, taken, real, labels)
            array[place] = kept
            assert (up - down) / 2e-6 == pytest.approx(gradient[place], rel=1e-3, abs=1e-7)


def test_pooled_reads_every_position():
    net = langid.new_network(["a", "b"], 4, 4, 2)
    texts = [b"x" * 300 + bytes(range(256)), b"short", b"", b"y" * langid.WINDOW]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    found = langid.pooled(net, data, ends - [len(t) for t in texts], ends)
    for text, probs in zip(texts, found):
        each = [langid.probabilities(net, np.frombuffer(text[i:i + langid.WINDOW], np.uint8)[:, None], None)[:, :, 0]
                for i in range(0, len(text), langid.WINDOW)]
        whole = np.concatenate(each).mean(axis=0) if each else np.zeros(2)
        assert probs == pytest.approx(whole, abs=1e-5)


@pytest.fixture(scope="module")
def network(documents):
    return langid.fit_languages(documents)


def test_languages_of_held_out_documents(documents, network):
    truth = {r.doc_id: r.lang for r in documents.collect()}
    rows = langid.predict(documents, network).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert np.mean(held) > 0.95


def test_language_of_odd_rows(odd_documents, odd_rows, no_documents, network):
    rows = langid.predict(odd_documents, network).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        if r.doc_id in (2, 3, 4, 10):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None:
            assert r.lang_pred in network.languages
    assert langid.predict(no_documents, network).collect() == []
    assert langid.fit_languages(no_documents) is None
    assert {r.lang_pred for r in langid.predict(odd_documents, None).collect()} == {"und"}
    kept = langid.keep_known_language(odd_documents, None)
    assert kept.schema == odd_documents.schema
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 5, 6, 7, 7, 8, 9, 11]


def brute_ftrl(rows, labels, epochs, alpha, beta, l1, l2, order):
    z, n = {}, {}
    for _ in range(epochs):
        for i in order():
            w = {}
            for k, v in rows[i]:
                zk = z.get(k, 0.0)
                w[k] = 0.0 if abs(zk) <= l1 else -(zk - np.sign(zk) * l1) / ((beta + n.get(k, 0.0) ** 0.5) / alpha + l2)
            p = 1 / (1 + np.exp(-sum(w[k] * v for k, v in rows[i])))
            for k, v in rows[i]:
                g = (p - labels[i]) * v
                sigma = ((n.get(k, 0.0) + g * g) ** 0.5 - n.get(k, 0.0) ** 0.5) / alpha
                z[k] = z.get(k, 0.0) + g - sigma * w[k]
                n[k] = n.get(k, 0.0) + g * g
    return {k: 0.0 if abs(zk) <= l1 else -(zk - np.sign(zk) * l1) / ((beta + n[k] ** 0.5) / alpha + l2) for k, zk in z.items()}


def test_ftrl_updates():
    draw = np.random.default_rng(0)
    rows = [(np.sort(draw.choice(16, 4, replace=False)), draw.random(4)) for _ in range(20)]
    labels = draw.integers(0, 2, 20)
    w = quality.train_ftrl(rows, labels, 4, 3, 0.5, 1.0, 0.01, 0.1, seed=9)
    again = np.random.default_rng(9)
    brute = brute_ftrl([list(zip(*r)) for r in rows], labels, 3, 0.5, 1.0, 0.01, 0.1, lambda: again.permutation(20))
    for k in range(17):
        assert w[k] == pytest.approx(brute.get(k, 0.0))


def test_scores_are_dot_products():
    texts = pa.array(["a b a b c", "", "A"])
    model = quality.QualityModel(np.random.default_rng(0).normal(size=(1 << 10) + 1).astype(np.float32), True)
    for score, (slots, values) in zip(quality.score_batch(model, texts), quality.features(texts, 10)):
        assert score == pytest.approx(1 / (1 + np.exp(-sum(model.weights[s] * v for s, v in zip(slots, values)))))
    one, _, upper = quality.features(texts, 10)
    assert len(one[0]) == 3 + 3 + 1 and np.square(one[1][:-1]).sum() == pytest.approx(1)
    assert list(upper[0]) == list(next(quality.features(pa.array(["a"]), 10))[0])


def test_quality_of_held_out_documents(llm):
    docs, labels = (llm.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in quality.score_quality(docs, model).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows]) > 0.93


def test_quality_of_odd_rows(llm, odd_documents, odd_rows, no_documents):
    labels = llm.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 0), (8, None, 0), (9, 0, 1), (9, 0, 1), (77, 1, 0)],
                                 "doc_id bigint, quality int, toxic int")
    model = quality.fit_quality(odd_documents, labels)
    rows = quality.score_quality(odd_documents, model).collect()
    assert len(rows) == len(odd_rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1
    untrained = quality.fit_quality(odd_documents, labels.where("false"))
    assert not untrained.trained
    assert {r.score for r in quality.score_quality(odd_documents, untrained).collect()} == {0.5}
    assert quality.keep_good(odd_documents, untrained).count() == len(odd_rows)
    assert quality.score_quality(no_documents, model).collect() == []
    assert not quality.fit_quality(no_documents, labels).trained


def test_labels_without_documents_use_up_no_sample(llm, documents):
    """A few documents beside many labels of others train as they do beside their own labels."""
    own = llm.read.parquet(f"{SF}/labels.parquet").where("quality is not null").select("doc_id", "quality")
    others = llm.range(10**6, 10**6 + 5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast(own.schema["quality"].dataType).alias("quality"))
    alone = quality.fit_quality(documents, own, most=64)
    beside = quality.fit_quality(documents, own.unionByName(others), most=64)
    assert alone.trained and beside.trained
    assert np.array_equal(alone.weights, beside.weights)


def test_language_stage_keeps_documents_of_learned_languages(llm):
    """The score limit costs almost none of the documents that op6 puts in a language, and few of their beginnings."""
    docs = llm.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").where("lang is not null")
    net = langid.fit_languages(docs)
    for text, least in ((F.col("text"), 0.995), (F.substring("text", 1, 30), 0.98)):
        some = docs.withColumn("text", text)
        known = langid.predict(some, net).where("lang_pred <> 'und'").count()
        assert known > 900 and langid.keep_known_language(some, net).count() >= least * known
