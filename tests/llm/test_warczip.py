import hashlib
import io
import zipfile

import pytest

from evidlake.llm import warczip
from evidlake.llm.shared import open_fs


def build(members, limit=None, monkeypatch=None, method=zipfile.ZIP_STORED):
    if limit:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method, allowZip64=True) as z:
        for n, d in members.items():
            with z.open(zipfile.ZipInfo(n) if method == 0 else n, "w", force_zip64=True) as f:
                f.write(d)
        z.comment = b"a comment PK"
    return out.getvalue()


MEMBERS = {"a.txt": b"x" * 500, "dir/b.bin": bytes(range(256)) * 3, "é.txt": b"", "d": b"tail"}


@pytest.mark.parametrize("limit", [None, 100])
def test_directory_and_ranges(limit, monkeypatch):
    raw = build(MEMBERS, limit, monkeypatch)
    assert (b"PK\x06\x06" in raw) == bool(limit)
    z = warczip.StoredZip(io.BytesIO(raw), len(raw))
    assert {n: z.read(n) for n in z.members} == MEMBERS
    assert z.read("dir/b.bin", 250, 20) == MEMBERS["dir/b.bin"][250:270]


def test_refusals():
    raw = build({"a": b"aaaaaaaaaaaaaaaaaaaaaaaa"}, method=zipfile.ZIP_DEFLATED)
    with pytest.raises(ValueError, match="compressed"):
        warczip.StoredZip(io.BytesIO(raw), len(raw)).place("a")
    with pytest.raises(ValueError):
        warczip.StoredZip(io.BytesIO(b"no zip"), 6)


def test_round_trip(spark, tmp_path):
    big, other = "é" * 500, "y" * 1000
    rows = [(1, "http://a/ b\r\nX: 1", big), (2, None, big), (9, "u", big), (9, "v", big), (3, "s", "short"), (4, "s", "short"), (5, "n", None), (6, "e", ""),
            (None, "z", big), (None, "q", other), (None, "q", other), (7, "r", "HTTP\r\n\r\nWARC/1.1\r\n\r\n" * 60)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    folder = f"file://{tmp_path}/w"
    packages = warczip.write_packages(df, folder)
    got = warczip.read_packages(packages).collect()
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, x in rows if x == h and j is not None]
        again = len(data) >= 1000 and bool(same) and max(same) != i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert {r.payload for r in got if r.page_id == 7} == {rows[-1][2].encode()}
    for p in packages.collect():
        fs, name = open_fs(p.path)
        with fs.open_input_file(name) as f:
            assert zipfile.ZipFile(f).testzip() is None
    assert warczip.archive_pages(df.where("page_id > 99"), folder=f"file://{tmp_path}/e").collect() == []


def test_packages_are_bounded_and_long_or_equal_pages_kept(spark, tmp_path):
    page = "<p>" + "words and more words " * 60
    df = spark.range(0, 3000, 1, 2).selectExpr("id as page_id", "'u' as url", f"case when id % 2 = 0 then '{page}' else concat('<p>', id) end as html")
    df = df.union(spark.createDataFrame([(5000, "u", "long " * 1_000_000)], "page_id long, url string, html string"))
    packages = warczip.write_packages(df, f"file://{tmp_path}/w", package_bytes=20_000)
    written = packages.collect()
    assert len(written) > 20 and sum(p.records for p in written) == 3001 and len({p.package for p in written}) == len(written)
    got = warczip.read_packages(packages).groupBy("record_type").count().collect()
    assert sorted(map(tuple, got)) == [("response", 1502), ("revisit", 1499)]
