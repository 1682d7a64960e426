import base64
import hashlib
import struct

import pytest

from outlast.llm import warc

from .conftest import SF


def expected(rows, least=0):
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if p is not None and (h or "").encode() == payload and len(payload) >= least]
        refers = min(same) if same and page_id is not None and min(same) != page_id else None
        out.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                    "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_pages(llm, tmp_path):
    pages = llm.read.parquet(f"{SF}/pages.parquet").repartition(3)
    warc.write_archives(pages, str(tmp_path / "a"))
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    back = warc.read_archives(llm, str(tmp_path / "a"), with_payload=True)
    assert got(back) == expected(rows)
    payloads = {r.page_id: bytes(r.payload) for r in back.collect() if r.payload is not None}
    assert all(payloads[i] == (h or "").encode() for i, _, h in rows if i in payloads)
    archives = [p.read_bytes() for p in (tmp_path / "a").glob("part-*")]
    assert any(a[:4] == struct.pack("<I", warc.DICTIONARY_FRAME) for a in archives)


@pytest.mark.parametrize("least", [0, 3])
def test_odd_pages(llm, tmp_path, least):
    rows = [(5, "http://a/\r\nX: y z", "<p>ä</p>"), (3, None, "<p>ä</p>"), (9, "u", None), (8, "u", ""), (None, "u", "<p>ä</p>"),
            (None, None, None), (4, "u", "x" * 300_000), (4, "u", "x" * 300_000), (7, "u", "x" * 300_000), (6, "u", "ab"), (2, "u", "ab")]
    pages = llm.createDataFrame([(*r, 1, "d") for r in rows], "page_id bigint, url string, html string, refers_to int, digest string")
    warc.write_archives(pages, str(tmp_path / "a"), least)
    assert got(warc.read_archives(llm, str(tmp_path / "a"))) == expected(rows, least)
    warc.write_archives(pages.where("false"), str(tmp_path / "b"))
    assert warc.read_archives(llm, str(tmp_path / "b")).collect() == []


def archive(records, with_dictionary=True):
    lead, compressor = warc.dictionary_frame(records * 20)
    return lead + warc.EMPTY_FRAME.encode().join(compressor.compress(r) for r in records), lead


def test_archives_are_validated():
    records = [warc.record_bytes(i, f"http://h/{i}", (f"<html>{i} " + "text and words " * 40).encode(), None) for i in range(60)]
    data, lead = archive(records)
    assert lead[:4] == struct.pack("<I", warc.DICTIONARY_FRAME)
    assert [r["fields"]["warc-record-id"] for r in warc.archive_records(data)] == [f"<urn:page:{i}>" for i in range(60)]
    for broken in (data[:-1], data[:-400], data[len(lead):], data[:5], data + b"\x00" * 9):
        with pytest.raises(Exception):
            list(warc.archive_records(broken))
    good = records[0]
    for bad in (good.replace(b"WARC/1.1", b"WARK/1.1"), good.replace(b"text and", b"test and", 1), good[:-2], good + b"x",
                good.replace(b"WARC-Date", b"WARC-Data"), good.replace(b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:A")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    import zstandard

    both = zstandard.ZstdCompressor().compress(records[0] + records[1])
    with pytest.raises(ValueError):
        list(warc.archive_records(both))
