"""Downloads from a server of this test, which breaks off answers and counts what it gives."""

import http.server
import io
import threading
import zipfile
import zlib

import pytest
from pulseloom.sources import remote


@pytest.fixture
def server(monkeypatch):
    monkeypatch.setattr(remote, "PAUSE", 0.01)
    files, seen = {}, []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            data = files[self.path]
            first, last = self.headers["Range"].removeprefix("bytes=").split("-")
            first, last = int(first), min(int(last), len(data) - 1)
            seen.append((self.path, first, last))
            if self.path in broken and broken[self.path] > 0:
                broken[self.path] -= 1
                self.send_error(503)
                return
            if first >= len(data):
                self.send_error(416)
                return
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {first}-{last}/{len(data)}")
            self.send_header("Content-Length", str(last + 1 - first))
            self.end_headers()
            self.wfile.write(data[first : last + 1])

        def log_message(self, *args):
            pass

    broken = {}
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    s.files, s.seen, s.broken, s.url = files, seen, broken, f"http://127.0.0.1:{s.server_port}"
    yield s
    s.shutdown()


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(f"{name}.csv", data)
    return out.getvalue()


def test_downloads_resume_and_are_whole(spark, server, tmp_path):
    server.files |= {"/a": zipped(a="x" * 5000), "/b": zipped(b="y" * 100), "/bad": b"no zip"}
    server.broken["/a"] = 3
    (tmp_path / "a.zip.parts").mkdir()
    (tmp_path / "a.zip.parts" / f"{0:020d}").write_bytes(server.files["/a"][:1000])
    rows = spark.createDataFrame([(f"{server.url}/{n}", f"{tmp_path}/{n}.zip") for n in "ab"], "url string, path string")
    got = {r["path"][-5:]: (r["size"], r["fresh"]) for r in remote.download_all(rows, 1000, 0.01).collect()}
    assert got == {"a.zip": (len(server.files["/a"]), True), "b.zip": (len(server.files["/b"]), True)}
    assert (tmp_path / "a.zip").read_bytes() == server.files["/a"]
    assert min(first for path, first, _ in server.seen if path == "/a") == 1000
    assert {p.name for p in tmp_path.iterdir()} == {"a.zip", "b.zip"}
    assert not any(r["fresh"] for r in remote.download_all(rows).collect())
    with pytest.raises(ValueError):
        remote.download(f"{server.url}/bad", f"{tmp_path}/bad.zip")
    assert sum(path == "/bad" and first == 0 for path, first, _ in server.seen) == 2
    assert not (tmp_path / "bad.zip").exists()


def test_directories_are_read_without_the_members(spark, server):
    server.files["/z"] = zipped(one="1\n" * 300_000, two="22")
    got = {r["name"]: r for r in remote.zip_directory(spark.createDataFrame([(f"{server.url}/z",)], "url string")).collect()}
    assert {n: (r["size"], r["crc"]) for n, r in got.items()} == {"one.csv": (600_000, zlib.crc32(b"1\n" * 300_000)), "two.csv": (2, zlib.crc32(b"22"))}
    assert sum(last + 1 - first for _, first, last in server.seen) < 300_000


def test_ranges_are_joined(spark, server, tmp_path):
    server.files["/z"] = zipped(one="".join(map(str, range(20_000))))
    rows = spark.createDataFrame([(f"{server.url}/z", f"{tmp_path}/z.zip")], "url string, path string")
    got = remote.download_ranges(rows, 10_000).first()
    assert (got["size"], got["crc"]) == (len(server.files["/z"]), zlib.crc32(server.files["/z"]))
    assert (tmp_path / "z.zip").read_bytes() == server.files["/z"] and len(list(tmp_path.iterdir())) == 1


def test_crc_of_joined_files(spark, tmp_path):
    parts = [b"h,k\n1,2\n", b"h,k\n", b"h,k\n3,4\n5,6\n"]
    for i, p in enumerate(parts):
        (tmp_path / str(i)).write_bytes(p)
    rows = spark.createDataFrame([("month", f"{tmp_path}/{i}", i) for i in range(3)], "whole string, path string, n int")
    whole = b"h,k\n1,2\n3,4\n5,6\n"
    got = remote.joined_crc(rows).first()
    assert (got["whole"], got["crc"], got["size"]) == ("month", zlib.crc32(whole), len(whole))
    for a, b in ((b"", b"x"), (b"abc", b""), (b"a" * 1000, b"b" * 777)):
        assert remote.crc_of_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
