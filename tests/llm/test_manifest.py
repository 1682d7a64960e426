import hashlib
import zlib

import pytest

from outlast.llm import manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    fields = [None if f is None else str(f) for f in (row[0], row[3], row[2], row[4], text)]
    return digest(*["-" if f is None else f"{len(f.encode())}:{f}" for f in fields])


def climbed(hashes):
    """The root, and per leaf the (place, run) of each level."""
    paths, where = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        runs = [hashes[i:i + 3] for i in range(0, len(hashes), 3)]
        for leaf, at in enumerate(where):
            paths[leaf].append((at % 3, runs[at // 3]))
        hashes, where = [digest(*r) for r in runs], [at // 3 for at in where]
    return hashes[0], paths


def brute_force(rows):
    """Rows are (doc_id, text, lang, source, n_chars)."""
    def order(row):
        return row[0] is not None, row[0] or 0, leaf_of(row, row[1])

    by_source = {}
    for row in sorted(rows, key=order):
        by_source.setdefault(row[3], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climbed([leaf_of(r, r[1]) for r in by_source[s]]) for s in names}
    root, paths = climbed([trees[s][0] for s in names])
    for s, above in zip(names, paths):
        for row, path in zip(by_source[s], trees[s][1]):
            leaf = leaf_of(row, row[1])
            tampered = row[0] is not None and row[1] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            folded, proof = leaf_of(row, row[1].replace("\n", "")) if tampered else leaf, []
            for place, run in path + above:
                proof += run[:place] + run[place + 1:]
                folded = digest(*run[:place], folded, *run[place + 1:])
            yield row[0], leaf, trees[s][0], root, digest(*proof), folded, folded == root


def rows_of(df):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]


def found(df):
    return sorted(map(tuple, manifest.manifest(df).collect()), key=repr)


@pytest.mark.parametrize("block", [None, 1])
def test_documents_equal_brute_force(documents, block, monkeypatch):
    if block:  # links of one level, and a joined instead of a broadcast table
        monkeypatch.setattr(manifest, "LINK", 1)
        monkeypatch.setattr(manifest, "BLOCK", 3)
        monkeypatch.setattr(manifest, "BROADCAST_ROWS", 0)
    result = found(documents)
    assert result == sorted(brute_force(rows_of(documents)), key=repr)
    assert 0 < sum(not r[-1] for r in result) < len(result)


@pytest.mark.parametrize("sizes", [[1], [4], [1, 82, 3], [244, 9, 27, 28, 81]])
def test_shapes_of_trees(llm, sizes):
    rows = [(100 * s + i, f"text {i}\n", None, f"s{s:03}", i) for s, n in enumerate(sizes) for i in range(n)]
    df = llm.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert found(df) == sorted(brute_force(rows), key=repr)


def test_sources_over_two_rounds(llm):
    rows = [(i, "a\nb", "en", None if i == 5 else f"é{i}", 3) for i in range(100)]
    df = llm.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert found(df) == sorted(brute_force(rows), key=repr)


def test_odd_rows(odd_documents, odd_rows, no_documents):
    assert found(odd_documents) == sorted(brute_force(odd_rows), key=repr)
    assert manifest.manifest(no_documents).collect() == []
