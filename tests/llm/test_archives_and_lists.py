"""ZIP packages of WARC records, temporal lists."""

import base64
import gzip
import hashlib
import random
import zipfile
from datetime import datetime, timedelta

import pytest

from quayside.llm.temporal_lists import judge_captures, validity
from quayside.llm.zip_warc import directory, read_packages, record_ranges, round_trip, write_packages
from quayside.storage import fresh_path

PAGES = [(1, "http://a/x", "same"), (2, "http://b/y\r\nz", "same"), (3, None, None), (4, "http://c", ""), (5, "http://é/ü", "long é " * 50000),
         (5, "http://é/ü", "long é " * 50000), (6, "u", "once"), (None, "n", "same"), (None, "m", "nobody"), (None, "m", "nobody")]
SCHEMA = "page_id long, url string, html string, sha string, keeper string"


def pages_of(spark, rows=PAGES):
    return spark.createDataFrame([(*x, "s", "k") for x in rows], SCHEMA)


def brute(rows):
    keeper = {}
    for page_id, _, html in rows:
        keeper[html or ""] = max(keeper.get(html or "", -1), -1 if page_id is None else page_id)
    out = []
    for page_id, _, html in rows:
        data, best = (html or "").encode(), keeper[html or ""]
        first = page_id == best or best == -1
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit",
                    None if first else best))
    return sorted(out, key=repr)


def test_round_trip(spark):
    found = round_trip(pages_of(spark)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, found.collect()), key=repr) == brute(PAGES)
    assert round_trip(pages_of(spark, [])).count() == 0
    small = round_trip(pages_of(spark), least_bytes=10)
    assert {x.record_type for x in small.collect() if x.payload_bytes < 10} == {"response"}


@pytest.mark.parametrize("zip64", [False, True])
def test_payloads_come_back_and_packages_are_plain_zips(spark, zip64):
    written = write_packages(pages_of(spark), fresh_path(spark, "t"), zip64=zip64, package_bytes=2000)
    rows = read_packages(written).collect()
    assert {(x.page_id, bytes(x.payload).decode()) for x in rows if x.payload is not None} >= {(6, "once"), (5, "long é " * 50000), (2, "same")}
    assert {x.url for x in rows} >= {"http://b/y%0D%0Az", None, "http://é/ü"}
    for (path, _) in written.collect():
        local = path.removeprefix("file:")
        with zipfile.ZipFile(local) as archive, open(local, "rb") as file:
            import pyarrow as pa

            own = list(directory(pa.PythonFile(file), archive.fp.seek(0, 2) or archive.fp.tell()))
            assert [(x[0], x[1], x[3]) for x in own] == [(x.filename, x.compress_type, x.file_size) for x in archive.infolist()]
            assert archive.testzip() is None


def test_damaged_packages_are_refused(tmp_path):
    (tmp_path / "a.zip").write_bytes(b"no zip")
    with pytest.raises(ValueError):
        list(record_ranges(str(tmp_path / "a.zip")))


def test_lists_against_brute_force(spark):
    rng, start = random.Random(4), datetime(2024, 1, 1)
    patterns = ["a.org", "b.a.org", "b.a.org/x", "b.a.org/x/y", "c.net", "org"]
    entries = [(i, start + timedelta(hours=rng.randint(0, 240)), rng.choice(patterns), rng.choice(["add", "remove"])) for i in range(200)]
    entries += [(900, None, "a.org", "add"), (901, start, None, "add"), (902, start, "a.org", "other")]
    urls = ["http://b.a.org/x/y/z?q", "https://A.org:80/", "http://u:p@c.net", "ftp://q.b.a.org/x", "nonsense", "", None]
    captures = [(i, rng.choice(urls), start + timedelta(hours=rng.randint(-5, 250))) for i in range(300)]
    captures += [(1000, urls[0], None), captures[0], (None, urls[1], start + timedelta(hours=100))]

    def active(pattern, when):
        past = [(t, i, a) for i, t, p, a in entries if p == pattern and t and t <= when and a in ("add", "remove")]
        return max(past)[0] if past and max(past)[2] == "add" else None

    def own_patterns(url):
        host = {urls[0]: "b.a.org", urls[1]: "a.org", urls[2]: "c.net", urls[3]: "q.b.a.org"}.get(url)
        path = {urls[0]: ["x", "y", "z"], urls[3]: ["x"]}.get(url, [])
        parts = host.split(".") if host else []
        return [".".join(parts[i:]) for i in range(len(parts))] + [host + "/" + "/".join(path[: i + 1]) for i in range(len(path))]

    wanted = set()
    for page, url, when in captures:
        hits = [(len(p), p, at) for p in own_patterns(url) if when and (at := active(p, when))]
        best = max(hits) if hits else (0, None, None)
        wanted.add((page, url, when, "undated" if when is None else "blocked" if hits else "allowed", len(hits), best[1], best[2]))
    found = judge_captures(
        spark.createDataFrame([(*x, 1) for x in captures], "page_id long, url string, fetched_at timestamp_ntz, pattern int"),
        spark.createDataFrame(entries, "entry_id long, listed_at timestamp_ntz, pattern string, action string")).collect()
    assert {(x.page_id, x.url, x.fetched_at, x.verdict, x.n_rules, x.rule, x.listed_at) for x in found} == wanted
    assert sum(x.captures for x in found) == len(captures)


def test_empty_lists_and_captures(spark):
    none = spark.createDataFrame([], "entry_id long, listed_at timestamp_ntz, pattern string, action string")
    one = spark.createDataFrame([(1, "http://a.org", datetime(2024, 1, 1))], "page_id long, url string, fetched_at timestamp_ntz")
    assert [x.verdict for x in judge_captures(one, none).collect()] == ["allowed"]
    assert judge_captures(one.limit(0), none).count() == 0
    assert validity(none).count() == 0


# -- packages of other writers

def plain_record(kind, uri, block, extra=""):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{abs(hash(uri))}>\r\n"
    head += f"WARC-Target-URI: <{uri}>\r\n{extra}Content-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def foreign_records():
    page = lambda text: b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + text
    return [("warcinfo", plain_record("warcinfo", "info", b"software: x\r\n")), ("request", plain_record("request", "http://a/", b"GET / HTTP/1.1\r\n\r\n")),
            ("a", plain_record("response", "http://a/", page(b"<html>a</html>"), "WARC-Payload-Digest: sha256:abc\r\n")),
            ("b", plain_record("response", "http://b/", page(b"b" * 3_000_000))), ("c", plain_record("resource", "http://c/", b"resource")),
            ("d", plain_record("response", "http://d/", page(b"")))]


def foreign_package(path, archive, index=None, packed=True, cut=0, method=zipfile.ZIP_STORED):
    """A package with one archive of foreign records; ``index(places)`` gives the name and bytes of its index."""
    data, places = b"", {}
    for name, record in foreign_records():
        own = gzip.compress(record) if packed else record
        places[name] = (len(data), len(own))
        data += own
    with zipfile.ZipFile(path, "w", method) as package:
        package.writestr(archive, data[: len(data) - cut])
        if index:
            package.writestr(*index(places))
    return str(path)


def read_foreign(spark, path):
    rows = read_packages(spark.createDataFrame([(path,)], "package string"))
    return {x.url: (x.payload_bytes, x.payload_digest, x.record_type, x.page_id, bytes(x.payload)) for x in rows.collect()}


EVERY = {f"http://{n}/": (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), t, None, p)
         for n, p, t in (("a", b"<html>a</html>", "response"), ("b", b"b" * 3_000_000, "response"), ("c", b"resource", "resource"), ("d", b"", "response"))}


def cdxj(places, of, text=str):
    return "".join(f'com,{n})/ 2024 {{"offset": "{o}", "length": "{m}", "filename": "{of}"}}\n' for n, (o, m) in places.items() if len(n) == 1)


@pytest.mark.parametrize("index", [
    None,
    lambda p: ("indexes/index.cdx.gz", gzip.compress(("!meta {}\n" + cdxj(p, "data.warc.gz")).encode())),
    lambda p: ("indexes/index.cdxj", cdxj(p, "archive/data.warc.gz")),
    lambda p: ("index.cdx", " CDX N b a m s k r M S V g\n" + "".join(f"{n} 2024 http://{n}/ - 200 X - - {m} {o} data.warc.gz\n" for n, (o, m) in p.items())),
])
def test_packages_of_other_writers(spark, tmp_path, index):
    path = foreign_package(tmp_path / "x.wacz", "archive/data.warc.gz", index)
    assert read_foreign(spark, path) == EVERY
    assert read_foreign(spark, f"file://{path}") == EVERY


def test_plain_archives_are_walked(spark, tmp_path):
    assert read_foreign(spark, foreign_package(tmp_path / "x.zip", "data.warc", packed=False)) == EVERY


@pytest.mark.parametrize("cut", [3, 500, 5000])
@pytest.mark.parametrize("packed", [True, False])
def test_a_damaged_archive_is_refused(spark, tmp_path, cut, packed):
    path = foreign_package(tmp_path / "x.zip", "data.warc.gz" if packed else "data.warc", packed=packed, cut=cut)
    if not packed and cut == 3:
        assert read_foreign(spark, path) == EVERY   # only blank lines after the last record are gone
        return
    with pytest.raises(Exception, match="data.warc"):
        read_foreign(spark, path)


@pytest.mark.parametrize("index, method, said", [
    (lambda p: ("index.cdxj", cdxj(p, "other.warc.gz")), zipfile.ZIP_STORED, "does not hold"),
    (lambda p: ("index.cdxj", 'x 1 {"offset": 1, "length": }\n'), zipfile.ZIP_STORED, "damaged line"),
    (lambda p: ("index.cdxj", 'x 1 {"offset": 99999999, "length": 5, "filename": "data.warc.gz"}\n'), zipfile.ZIP_STORED, "beyond its end"),
    (None, zipfile.ZIP_DEFLATED, "compressed inside"),
])
def test_what_cannot_be_read_is_refused(spark, tmp_path, index, method, said):
    with pytest.raises(Exception, match=said):
        read_foreign(spark, foreign_package(tmp_path / "x.zip", "data.warc.gz", index, method=method))


def test_packages_keep_the_scheme_of_their_folder(spark, tmp_path):
    folder = f"file://{tmp_path}/with scheme"
    packages = write_packages(pages_of(spark), folder)
    assert all(x.package.startswith(folder + "/") for x in packages.collect())
    assert read_packages(packages).count() == len(PAGES)
