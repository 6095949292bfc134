"""Files that lie behind HTTP: resumed downloads, remote ZIP directories, ranges, and checksums of joined files.

Every file, or range of one, is a row of a table and a task of its own. Targets are paths of a file system that all
workers reach (file, HDFS or an object store, by pyarrow); a file is published by a rename once it is whole.
"""

from __future__ import annotations

import io
import time
import urllib.error
import urllib.request
import zipfile
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP = 8 << 20  # bytes of a request
FAILURES = 20  # in a row without progress
PAUSE = 30.0  # seconds at most between tries


def place(path: str):
    """The file system and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_range(url: str, first: int, end: int, timeout: float = 60.0) -> tuple[bytes, int | None]:
    """Bytes [first, end) of a URL, fewer at its end, and its size if the server tells; b"" at or beyond the end."""
    request = urllib.request.Request(url, headers={"Range": f"bytes={first}-{end - 1}"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            told = answer.headers.get("Content-Range", "")
            size = int(told.rsplit("/", 1)[1]) if told.rsplit("/", 1)[-1].isdigit() else None
            if answer.status == 206:
                return answer.read(), size
            answer.read(first)  # the server gives the whole file
            return answer.read(end - first), int(answer.headers["Content-Length"]) if "Content-Length" in answer.headers else None
    except urllib.error.HTTPError as e:
        if e.code == 416:
            return b"", None
        raise


def patient(read, pause: float = 1.0):
    """What read() gives, tried again after pauses that double; the last error if FAILURES tries in a row fail."""
    for k in range(FAILURES):
        try:
            return read()
        except (OSError, urllib.error.URLError):
            if k == FAILURES - 1:
                raise
            time.sleep(min(PAUSE, pause * 2**k))


def whole_zip(data) -> bool:
    try:
        with zipfile.ZipFile(data) as z:
            return z.testzip() is None
    except (zipfile.BadZipFile, zlib.error, EOFError, OSError, ValueError):  # what damage makes of seeks and members
        return False


def download(url: str, path: str, step: int = STEP, pause: float = 1.0) -> tuple[int, bool]:
    """Downloads a ZIP file unless it is there; its size and whether it was downloaded.

    Pieces are kept beside it, so what an earlier try got isn't fetched again. A file that is no whole ZIP is fetched
    once more from nothing; one that still isn't is an error.
    """
    from pyarrow import fs

    store, at = place(path)
    if store.get_file_info(at).type == fs.FileType.File:
        return store.get_file_info(at).size, False
    pieces = f"{at}.parts"
    for last in (False, True):
        store.create_dir(pieces, recursive=True)
        have = sorted((int(i.base_name), i.size) for i in store.get_file_info(fs.FileSelector(pieces)) if i.base_name.isdigit())
        got = 0
        for first, size in have:
            if first == got:
                got += size
        while data := patient(lambda got=got: read_range(url, got, got + step)[0], pause):
            with store.open_output_stream(f"{pieces}/{got:020d}.new") as f:
                f.write(data)
            store.move(f"{pieces}/{got:020d}.new", f"{pieces}/{got:020d}")
            got += len(data)
        names = sorted(i.path for i in store.get_file_info(fs.FileSelector(pieces)) if i.base_name.isdigit())
        with store.open_output_stream(f"{at}.part") as out:
            for name in names:
                with store.open_input_stream(name) as f:
                    while data := f.read(STEP):
                        out.write(data)
        store.delete_dir(pieces)
        with store.open_input_file(f"{at}.part") as f:
            good = whole_zip(f)
        if good:
            store.move(f"{at}.part", at)
            return got, True
        store.delete_file(f"{at}.part")
        if last:
            raise ValueError(f"{url} is no whole ZIP file")
    raise AssertionError


def download_all(files: DataFrame, step: int = STEP, pause: float = 1.0) -> DataFrame:
    """files (url, path) with size and fresh (whether it was downloaded now); each file is a task. Conversion reads what
    they name in a job of its own, so downloads run side by side and the conversion after them."""

    def run(batches):
        import pandas as pd

        for b in batches:
            made = [download(u, p, step, pause) for u, p in zip(b["url"], b["path"], strict=True)]
            yield b[["url", "path"]].assign(size=pd.Series([n for n, _ in made], dtype="int64"), fresh=pd.Series([f for _, f in made], dtype="bool"))

    return each(files.select("url", "path")).mapInPandas(run, "url string, path string, size long, fresh boolean")


def each(rows: DataFrame) -> DataFrame:
    """rows dealt to a task each, up to ten thousand of them."""
    return rows.repartition(max(1, min(10_000, rows.count())))


class RangeReader(io.RawIOBase):
    """A URL as a file that can be searched; reads fetch only what is asked for."""

    def __init__(self, url: str, pause: float = 1.0):
        self.url, self.pause, self.at = url, pause, 0
        self.size = patient(lambda: read_range(url, 0, 1), pause)[1]
        if self.size is None:
            raise OSError(f"{url} doesn't tell its size")

    def readable(self):
        return True

    def seekable(self):
        return True

    def tell(self):
        return self.at

    def seek(self, offset, whence=io.SEEK_SET):
        self.at = max(0, offset + (0, self.at, self.size)[whence])
        return self.at

    def readinto(self, into):
        end = min(self.size, self.at + len(into))
        if end <= self.at:
            return 0
        data = patient(lambda: read_range(self.url, self.at, end)[0], self.pause)
        into[: len(data)] = data
        self.at += len(data)
        return len(data)


MEMBER = "url string, name string, size long, compressed long, crc long, offset long"


def zip_directory(urls: DataFrame, buffer: int = 1 << 16) -> DataFrame:
    """The members of remote ZIP files (url), read from their directories at the files' ends."""

    def run(batches):
        import pandas as pd

        for b in batches:
            for url in b["url"]:
                with zipfile.ZipFile(io.BufferedReader(RangeReader(url), buffer)) as z:
                    rows = [(url, m.filename, m.file_size, m.compress_size, m.CRC, m.header_offset) for m in z.infolist()]
                yield pd.DataFrame(rows, columns=["url", "name", "size", "compressed", "crc", "offset"])

    return each(urls.select("url")).mapInPandas(run, MEMBER)


def download_ranges(url_paths: DataFrame, step: int = 64 << 20) -> DataFrame:
    """Downloads large files (url, path) range by range, a task each, and joins the ranges; path, size and crc of each.

    A range that is there in full isn't fetched again. A joined file that is no whole ZIP is an error.
    """
    sized = url_paths.select("url", "path").mapInPandas(lambda batches: (b.assign(size=[RangeReader(u).size for u in b["url"]]) for b in batches), "url string, path string, size long")
    rows = [tuple(r) for r in sized.collect()]  # a row per file
    spark = url_paths.sparkSession
    ranges = spark.createDataFrame(rows, "url string, path string, size long").withColumn("first", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("size") - 1), F.lit(step)).cast("array<long>")))

    def fetch(batches):
        from pyarrow import fs

        for b in batches:
            for url, path, size, first in b[["url", "path", "size", "first"]].itertuples(index=False):
                store, at = place(path)
                name, n = f"{at}.ranges/{first:020d}", min(step, size - first)
                if store.get_file_info(name).type != fs.FileType.File or store.get_file_info(name).size != n:
                    store.create_dir(f"{at}.ranges", recursive=True)
                    with store.open_output_stream(f"{name}.new") as f:
                        f.write(patient(lambda url=url, first=first, n=n: read_range(url, first, first + n)[0]))
                    store.move(f"{name}.new", name)
            yield b[["path"]]

    each(ranges).mapInPandas(fetch, "path string").count()

    def join(batches):
        import pandas as pd
        from pyarrow import fs

        for b in batches:
            out = []
            for path, size in b[["path", "size"]].itertuples(index=False):
                store, at = place(path)
                n = crc = 0
                with store.open_output_stream(f"{at}.part") as f:
                    for i in sorted(store.get_file_info(fs.FileSelector(f"{at}.ranges")), key=lambda i: i.base_name):
                        if i.base_name.isdigit():
                            with store.open_input_stream(i.path) as g:
                                while data := g.read(STEP):
                                    f.write(data)
                                    n, crc = n + len(data), zlib.crc32(data, crc)
                with store.open_input_file(f"{at}.part") as f:
                    if n != size or not whole_zip(f):
                        raise ValueError(f"{path} is no whole ZIP file")
                store.move(f"{at}.part", at)
                store.delete_dir(f"{at}.ranges")
                out.append((path, n, crc))
            yield pd.DataFrame(out, columns=["path", "size", "crc"])

    return spark.createDataFrame(each(spark.createDataFrame(rows, "url string, path string, size long")).mapInPandas(join, "path string, size long, crc long").collect(), "path string, size long, crc long")


def crc_of_joined(first: int, second: int, length: int) -> int:
    """The CRC-32 of two byte strings joined, from theirs and the second's length: as many zero bytes are put behind the
    first by squaring the matrix, over two elements, of one zero bit."""

    def times(m: list[int], v: int) -> int:
        out = 0
        for row in m:
            if not v:
                break
            if v & 1:
                out ^= row
            v >>= 1
        return out

    matrix = [0xEDB88320] + [1 << i for i in range(31)]
    for _ in range(3):  # eight zero bits
        matrix = [times(matrix, row) for row in matrix]
    while length:
        if length & 1:
            first = times(matrix, first)
        matrix, length = [times(matrix, row) for row in matrix], length >> 1
    return first ^ second


def joined_crc(parts: DataFrame) -> DataFrame:
    """whole, crc and size of what the files (whole, path, n) of each `whole` give when joined in the order of n, with the
    header line of all but the first left out. Each file is read in a task of its own; only checksums meet."""

    def read(batches):
        import pandas as pd

        for b in batches:
            out = []
            for whole, path, n, head in b.itertuples(index=False):
                store, at = place(path)
                crc = size = 0
                with store.open_input_stream(at) as f:
                    data = f.read(STEP)
                    if not head:
                        data = data[data.find(b"\n") + 1 :]
                    while data:
                        crc, size = zlib.crc32(data, crc), size + len(data)
                        data = f.read(STEP)
                out.append((whole, n, crc, size))
            yield pd.DataFrame(out, columns=["whole", "n", "crc", "size"])

    def fold(key, pdf):
        import pandas as pd

        crc = size = 0
        for _, c, length in pdf.sort_values("n")[["n", "crc", "size"]].itertuples(index=False):
            crc, size = crc_of_joined(crc, int(c), int(length)), size + int(length)
        return pd.DataFrame([(key[0], crc, size)], columns=["whole", "crc", "size"])

    firsts = parts.groupBy("whole").agg(F.min("n").alias("__first"))
    rows = parts.join(firsts, "whole").select("whole", "path", F.col("n").cast("long").alias("n"), (F.col("n") == F.col("__first")).alias("head"))
    return each(rows).mapInPandas(read, "whole string, n long, crc long, size long").groupBy("whole").applyInPandas(fold, "whole string, crc long, size long")
