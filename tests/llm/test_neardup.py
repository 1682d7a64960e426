import re

import numpy as np
import pyarrow as pa
import pytest

from outlast.llm import neardup


def shingles(text, size=2):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words)} if 0 < len(words) < size else set(zip(*(words[i:] for i in range(size))))


def components(rows, similarity=80, size=2):
    """doc_id -> (size of its set, least doc_id that links reach), by all pairs."""
    sets = {i: shingles(t, size) for i, t in rows}
    ids = sorted(sets)
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= similarity * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return {i: (len(sets[i]), root(i)) for i in ids}


def check(found, rows):
    wanted = components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == wanted
    assert all(r.kept == (r.doc_id == r.component_id) for r in found if r.doc_id is not None)


def test_documents(documents):
    check(neardup.near_duplicates(documents).collect(), [(r.doc_id, r.text) for r in documents.collect()])


@pytest.mark.parametrize("rounds", [0, 8])
def test_large_groups_and_chains(llm, rounds):
    """Groups of near copies, a chain whose ends are not alike, and exact copies, by any number of rounds."""
    draw = np.random.default_rng(3)
    rows, base = [], [f"w{i}" for i in draw.integers(0, 500, 120)]
    for i in range(70):
        copy = list(base)
        for p in draw.integers(0, len(copy), 4):
            copy[p] = f"x{draw.integers(0, 9)}"
        rows.append((1000 - i, " ".join(copy)))
    chain = [f"c{i}" for i in range(100)]
    for i in range(30):
        chain[3 * i] = f"new{i}"
        rows.append((2000 + i, " ".join(chain)))
    rows += [(3000 + i, "exactly the same few words") for i in range(40)]
    rows += [(4000 + i, " ".join(f"u{v}" for v in draw.integers(0, 30, 25))) for i in range(60)]
    found = neardup.near_duplicates(llm.createDataFrame(rows, "doc_id bigint, text string"), rounds=rounds).collect()
    check(found, rows)
    assert len({r.component_id for r in found if r.doc_id < 3000}) < 10


def test_odd_rows(odd_documents, odd_rows, no_documents):
    found = neardup.near_duplicates(odd_documents).collect()
    assert len(found) == len(odd_rows)
    check(found, [r[:2] for r in odd_rows if r[0] is not None])
    assert all(r.component_id is None and not r.kept for r in found if r.doc_id is None)
    assert neardup.near_duplicates(no_documents).collect() == []
    kept = neardup.keep_one_of_each(odd_documents)
    assert kept.schema == odd_documents.schema
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 8, 9, 10, 11]


def test_prefix_holds_every_pair_above_the_threshold():
    """Signatures that agree in ``match`` places agree within the prefix."""
    draw = np.random.default_rng(5)
    prefix = neardup.COORDINATES - neardup.MATCH + 1
    for _ in range(200):
        places = draw.choice(neardup.COORDINATES, neardup.MATCH, replace=False)
        assert (places < prefix).any()


def test_minhashes_agree_as_often_as_sets_do():
    draw = np.random.default_rng(8)
    factors = draw.integers(0, 1 << 31, 2000, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    offsets = draw.integers(0, 1 << 32, 2000, dtype=np.uint32)
    one, two = (next(neardup.shingle_sets(pa.array([" ".join(f"w{i}" for i in range(low, low + 3001))]))) for low in (0, 300))
    share = (neardup.minhashes(one, factors, offsets) == neardup.minhashes(two, factors, offsets)).mean()
    assert share == pytest.approx(2700 / 3300, abs=0.04)
