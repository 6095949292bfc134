"""Token ids in ORC files.

Documents are dealt out by ranges of doc_id, sorted and encoded, and each task writes one file: file names and
rows ascend by doc_id. Rows hold doc_id, the offset of their first id in the file, their number of ids and the
ids. ORC's writer run-length encodes the integers, keeps minima and maxima of every few thousand rows, and adds
Bloom filters on doc_id, so that readers split files by stripe and skip what a filter on doc_id excludes.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import kept, staged

CACHE = 500_000  # words of a generation that a worker remembers
#: Python's split() takes these for white space, the tokenizers library does not.
NOT_SPACE = tuple(map(chr, range(0x1C, 0x20)))

PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
WIDE = re.compile("[\u0130-\U0010ffff]")


class Words(dict):
    """Ids of words by `make`; those of the last two generations of CACHE words are kept."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
        if len(self) >= CACHE:
            self.old = self.copy()
            self.clear()
        self[word] = ids
        return ids


class WordCache:
    """The library's ids of a text, with those of its words remembered.

    Holds for tokenizers that treat white space as a border of no tokens of its own, as those with a split
    pattern that removes it do: what stands between white space is encoded alone. Words of letters with
    punctuation behind go straight to the library's model.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = self.tokenizer.to_str().replace(" ", "")
        #: The kind of tokenizer whose words of letters are one piece: folded, cut at borders of letters, by bytes.
        self.folds = '"type":"Lowercase"' in spec and "[\\\\p{L}]+" in spec
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        self.tails = Words(self.ids)
        self.known = Words(self.word if self.folds else self.ids)

    def ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        m = PLAIN.fullmatch(word)
        if not m:
            return self.ids(word)
        word, tail = m.groups()
        if not word.isascii():
            word = word.encode("utf-8").decode("latin-1").translate(self.letters)
        ids = array("I", [x.id for x in self.model.tokenize(word)]).tobytes()
        return ids + self.tails[tail] if tail else ids

    def encode(self, texts: list[str]) -> list[bytes]:
        get, out = self.known.__getitem__, []
        for t in texts:
            if any(c in t for c in NOT_SPACE):
                out.append(self.ids(t))
            else:
                if self.folds and not WIDE.search(t):
                    t = t.lower()  # below U+0130 that is what the library does
                out.append(b"".join(map(get, t.split())))
        return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, stripe_bytes: int = 16 << 20, stride: int = 2000) -> None:
    """Writes the ids of every row's text, each with end_id after it, to ORC files in the folder `path`.

    Null texts count as empty. Null doc_ids come first; rows with equal doc_ids are ordered by the text's hash, then by
    text, nulls first, so that one doc_id that many rows share is dealt to several files too.
    An empty table makes no rows. Columns other than doc_id and text are not stored.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words, at = kept(("words", tokenizer), lambda: WordCache(tokenizer)), 0
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                made = [x + end for x in words.encode([t or "" for t in b.column(1).to_pylist()])]
                sizes = np.array([len(x) // 4 for x in made], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(made), "<i4")))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at + offsets[:-1]), pa.array(sizes), ids], ["doc_id", "at", "n_tokens", "ids"])
                at += int(offsets[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    rows = rows.mapInArrow(run, "doc_id long, at long, n_tokens long, ids array<int>")
    writer = rows.write.option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", stride)
    writer.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).option("compression", "zstd").orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids; a filter on doc_id reaches the files."""
    rows = spark.read.schema("doc_id long, at long, n_tokens long, ids array<int>").orc(path)
    rows = rows.withColumn("part", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long"))
    files = rows.groupBy("part").agg(F.max(F.col("at") + F.col("n_tokens")).alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = staged(files.select(F.col("part").alias("p"), before.alias("base")), "files")  # a row per file
    if files.count() <= 100_000:  # at most a few MB
        files = F.broadcast(files)
    return rows.join(files, F.col("part") == F.col("p")).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of what read_tokens() gives."""

    def run(batches):
        for b in batches:
            lists = b.column(3)
            flat, at = np.asarray(lists.values).astype("<u4"), np.asarray(lists.offsets)
            crc = [zlib.crc32(flat[x:y].tobytes()) for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
