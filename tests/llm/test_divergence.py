import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from outlast.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute_force(rows, least, top=50):
    """Rows are (text, lang, source)."""
    rows = [tuple(v or "" for v in r) for r in rows]
    for lang in {r[1] for r in rows}:
        documents, counts = Counter(), {}
        for text, _, source in (r for r in rows if r[1] == lang):
            found = terms(text)
            documents.update(set(found))
            counts.setdefault(source, Counter()).update(found)
        kept = [t for t, n in documents.items() if n >= least]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s]
            over = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", over, top)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    yield lang, s, part, item, value, rank


def found(df, **options):
    return sorted(map(tuple, divergence.divergence(df, **options).collect()))


@pytest.mark.parametrize("shard_keys,options", [(None, {}), (40, {"limit": 2_000, "least_documents": 4})])
def test_documents_equal_brute_force(documents, shard_keys, options, monkeypatch):
    if shard_keys:  # many shards, several rounds, and blocks of few slots
        monkeypatch.setattr(divergence, "SHARD_KEYS", shard_keys)
        monkeypatch.setattr(divergence, "SLOT_ARRAYS_BYTES", 4_000)
        monkeypatch.setattr(divergence, "BLOCK_CELLS", 700)
    rows = [(r.text, r.lang, r.source) for r in documents.collect()]
    result = found(documents, **options)
    assert result == sorted(brute_force(rows, options.get("least_documents", 30)))
    assert {r[2] for r in result} == {"pair", "term"}


def test_odd_rows(odd_documents, odd_rows, no_documents):
    rows = [(r[1], r[2], r[3]) for r in odd_rows]
    for least in (1, 2, 30):
        assert found(odd_documents, least_documents=least) == sorted(brute_force(rows, least))
    assert divergence.divergence(no_documents).collect() == []


def test_groups_ties_and_nulls(llm):
    rows = [("A b, a_b é", "x", "s1"), ("a b", "x", "s2"), ("a b", "x", "s2"), (None, "x", None), ("12", "y", "s1"),
            ("12", "y", "s2"), ("b a c", None, "s1"), ("Z \x00 z", None, ""), ("ÄB äb ÄB", "x", "s3")]
    df = llm.createDataFrame(rows, "text string, lang string, source string")
    for least in (1, 2):
        assert found(df, least_documents=least) == sorted(brute_force(rows, least))
    assert ("y", "s1", "pair", "s2", 0, 1) in found(df)


def test_terms_of_a_slice():
    texts = ["zero", "Ab[c]d ÄÖ x", "", "9a9", "-"]
    codes, words, starts = divergence.terms_of(pa.array(texts).slice(1))
    flat = words.take(pa.array(codes)).to_pylist()
    assert [flat[a:b] for a, b in zip(starts[:-1], starts[1:])] == [terms(t) for t in texts[1:]]


@pytest.mark.parametrize("size", [1, 2, 5, 3000])
def test_hashes_are_perfect_and_verify_keys(size):
    words = [f"w{i}" for i in range(size)]
    seed, displaced, owner = divergence.build_hash("en", words)
    assert sorted(owner) == list(range(size))
    shard = divergence.Shard(10, seed, displaced, pa.array([words[i] for i in owner]))
    table = divergence.PerfectHashes({"en": 1}, {"en": {0: shard}})
    slots = table.slots("en", pa.array(words))
    assert sorted(slots) == list(range(10, 10 + size))
    assert set(table.slots("en", pa.array([f"v{i}" for i in range(2000)]))) == {-1}
    assert np.all(table.slots("de", pa.array(words)) == -1)
