import hashlib
import random
import zlib

import pytest

from cargoledger.llm import common, warc

SCHEMA = "page_id long, url string, html string, digest string"


def expected(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        head = max(same, default=None)
        revisit = len(data) >= 1000 and page is not None and page != head
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", head if revisit else None))
    return sorted(out, key=repr)


def run(spark, rows, **how):
    folder = common.scratch_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), folder, **how)
    found = warc.read_archives(spark, folder)
    return found, warc.resolve_revisits(found).drop("url")


def test_round_trip(spark):
    long = "<p>é</p>" * 300
    rows = [(1, "http://a", long), (2, "http://b\r\nX: y", long), (3, None, long), (4, "u", None), (5, "u", ""), (6, "u", "short"),
            (7, "u", "short"), (None, "u", long), (8, "u", "WARC/1.1\r\n\r\n\x1f\x8b\x08" * 80), (9, "u", "x" * 400_000), (6, "u", "short")]
    rows += [(100 + k, "u", f"page {k}" * 50) for k in range(50)]
    found, pages = run(spark, rows, archive_bytes=4000)
    assert sorted(map(tuple, pages.collect()), key=repr) == expected(rows)
    assert found.where("kind = 'gap'").count() == 0
    html = {r["page_id"]: r["html"] for r in found.where("record_type = 'response'").collect()}
    assert html[8] == rows[8][2] and html[9] == rows[9][2]


def test_empty_table(spark):
    folder = common.scratch_path(spark, "warc-test")
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(
        spark._jvm.org.apache.hadoop.fs.Path(folder)
    )
    assert warc.write_archives(spark.createDataFrame([], SCHEMA), folder).collect() == []
    assert warc.read_archives(spark, folder).collect() == []


def archive(packed, n=30):
    rng = random.Random(3)
    records = [warc.page_record(k, "u", "".join(rng.choices("abc <>é\n", k=rng.randrange(50, 900))), "0" * 40, None) for k in range(n)]
    parts = [warc.gzip_member(r) if packed else r for r in records]
    starts = [sum(map(len, parts[:k])) for k in range(n + 1)]
    return b"".join(parts), starts


def read(data):
    found = list(warc.salvage(data))
    spans = [(f[1], f[2]) for f in found]
    edges = [0, *[b for _, b in spans]]
    assert [a for a, _ in spans] == edges[:-1] and edges[-1] == len(data)
    return [warc._page_number(f[3]["warc-record-id"]) for f in found if f[0] == "record"], [f[1:] for f in found if f[0] == "gap"]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_goes_on_behind_damage(packed):
    data, starts = archive(packed)
    assert read(data) == (list(range(30)), [])
    rng = random.Random(9)
    for _ in range(60):
        hit = rng.randrange(30)
        at = rng.randrange(starts[hit], starts[hit + 1])
        kind = rng.randrange(3)
        if kind == 0:  # a changed byte; one that no check covers leaves the record as it is
            bad = data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :]
        elif kind == 1:  # bytes lost
            bad = data[:at] + data[at + rng.randrange(1, 40) :]
        else:  # bytes put in
            bad = data[:at] + b"\x1f\x8b\x08WARC/1.1\r\njunk" + data[at:]
        pages, gaps = read(bad)
        assert set(range(30)) - set(pages) <= {hit, hit + 1}
        assert [p for p in pages if p is not None and p not in (hit, hit + 1)] == [p for p in range(30) if p not in (hit, hit + 1)]
        assert len(gaps) <= 2


def test_salvage_of_rubbish_and_torn_ends():
    data, starts = archive(True)
    assert read(b"") == ([], [])
    assert read(b"no archive at all") == ([], [(0, 17, "neither member nor version line")])
    pages, gaps = read(data[: starts[29] + 20])
    assert pages == list(range(29)) and gaps == [(starts[29], starts[29] + 20, "member without end")]


def test_each_record_touches_its_own_bytes_only(monkeypatch):
    data, starts = archive(True)
    taken = []
    real = zlib.decompressobj

    class Counted:
        def __init__(self, *how):
            self.inner = real(*how)

        def decompress(self, chunk, most):
            taken.append(len(chunk))
            return self.inner.decompress(chunk, most)

        def __getattr__(self, name):
            return getattr(self.inner, name)

    monkeypatch.setattr(warc, "CHUNK", 64)
    monkeypatch.setattr(warc.zlib, "decompressobj", Counted)
    assert read(data) == (list(range(30)), [])
    assert sum(taken) < len(data) + 30 * 64


def test_member_that_inflates_without_bound_is_a_gap():
    small, large = b"x" * 900, b"y" * 5000
    member = warc.gzip_member(large)
    with pytest.raises(warc.BadRecord, match="beyond the limit"):
        warc._member_at(member, 0, most=4999)
    assert warc._member_at(b"--" + member + b"tail", 2, most=5000) == (large, len(member))
    assert warc._member_at(warc.gzip_member(small), 0, most=5000)[0] == small


def test_false_version_lines_cost_no_copies():
    record = warc.page_record(7, "u", "text", "0" * 40, None)
    lie = b"WARC/1.1\r\nContent-Length: 99999999999\r\n\r\n"
    pages, gaps = read(lie * 3000 + record)
    assert pages == [7] and len(gaps) == 1 and "length" in gaps[0][2]
