"""Byte-pair encoding and decoding with an index of pair occurrences.

Texts are cut into words by the vocabulary's pattern. The words of a slice of rows that a worker has not met
lately are laid out as one linked sequence of symbols, and an index holds, for each pair of neighbours, all
places where it stands. The active pair of lowest rank is merged at all its places, left to right, and the
lists of the pairs beside them are updated, until no pair has a rank. Words are independent, so this gives
what word-by-word merging gives, at the cost of one pass over the distinct words.
"""

from __future__ import annotations

import hashlib
import json
from heapq import heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memory, annotate, kept

#: Fixed value: the pattern of byte-level vocabularies of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
CACHE = 350_000  # words of a generation that a worker remembers


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: itself if it prints, else the next from U+0100."""
    prints = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class Bpe:
    """Of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, words: int = CACHE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.first = [vocab[x] for x in letters]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        own = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        back = {x: b for b, x in enumerate(letters)}
        self.bytes = [b""] * (1 + max([*vocab.values(), *own.values()]))
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[x] for x in token) if all(x in back for x in token) else token.encode("utf-8")
        for token, i in own.items():
            self.bytes[i] = token.encode("utf-8")
        self.special = {k: np.uint32(i).astype("<u4").tobytes() for k, i in own.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(own, key=len, reverse=True))) + ")") if own else None
        self.words = regex.compile(PATTERN)
        self.known = Memory(self.ids, words)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        if not words:
            return []
        merges, sym, left, right, starts = self.merges, [], [], [], []
        places: dict[int, list[int]] = {}
        heap: list[tuple[int, int]] = []
        for word in words:
            i, n = len(sym), len(word)
            starts.append(i)
            sym += [self.first[b] for b in word]
            left += [-1, *range(i, i + n - 1)] if n else []
            right += [*range(i + 1, i + n), -1] if n else []
            for at in range(i, i + n - 1):
                pair = sym[at] << 32 | sym[at + 1]
                if pair in places:
                    places[pair].append(at)
                elif pair in merges:
                    places[pair] = [at]
                    heappush(heap, (merges[pair][0], pair))
        while heap:
            _, pair = heappop(heap)
            a, b, new = pair >> 32, pair & 0xFFFFFFFF, merges[pair][1]
            for i in sorted(places.pop(pair)):
                j = right[i]
                if sym[i] != a or j < 0 or sym[j] != b:
                    continue  # an earlier merge took it
                sym[i], sym[j] = new, -1
                right[i] = k = right[j]
                h = left[i]
                if k >= 0:
                    left[k] = i
                    beside = new << 32 | sym[k]
                    if beside in places:
                        places[beside].append(i)
                    elif beside in merges:
                        places[beside] = [i]
                        heappush(heap, (merges[beside][0], beside))
                if h >= 0:
                    beside = sym[h] << 32 | new
                    if beside in places:
                        places[beside].append(h)
                    elif beside in merges:
                        places[beside] = [h]
                        heappush(heap, (merges[beside][0], beside))
        ends = [*starts[1:], len(sym)]
        return [[x for x in sym[i:j] if x >= 0] for i, j in zip(starts, ends, strict=True)]

    def parts(self, text: str) -> list[str]:
        """Words and special tokens of a text."""
        if self.split and any(k in text for k in self.special):
            return [w for x in self.split.split(text) for w in ([x] if x in self.special else self.words.findall(x))]
        return self.words.findall(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        rows = [self.parts(t) if t else [] for t in texts]
        known = self.known.of(set().union(*rows))
        return [b"".join(map(known.__getitem__, row)) for row in rows]

    def ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word or special token."""
        made = iter(self.merge([w.encode("utf-8") for w in words if w not in self.special]))
        return [self.special[w] if w in self.special else np.array(next(made), "<u4").tobytes() for w in words]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, fields: str = "n_tokens long, ids binary") -> DataFrame:
    """docs with n_tokens and ids (little-endian unsigned 32-bit integers) of the text.

    path names a byte-level BPE file of the tokenizers library that each worker can open. Null texts count as
    empty; special tokens in a text get their ids. Input columns that have a result's name are replaced.
    """

    def run():
        bpe = kept(("bpe", path), lambda: Bpe(path))

        def work(texts):
            made = bpe.encode(texts)
            return [[len(x) // 4 for x in made], made]

        return work

    return annotate(docs, run, fields)


def decode(rows: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """rows with the text of their ids; a null for a null, U+FFFD for what is not UTF-8."""

    def run():
        bpe = kept(("bpe", path), lambda: Bpe(path))
        return lambda column: [[None if x is None else bpe.decode(x) for x in column]]

    return annotate(rows, run, f"`{to}` string", ids)


def encode_and_decode(docs: DataFrame, path: str, ids: str = "token_ids", to: str = "decoded", words: int = CACHE) -> DataFrame:
    """docs with n_tokens, ids and the text of the ids, made in one pass; null texts count as empty, input columns that
    have a result's name are replaced. words: how many of a generation a worker remembers."""

    def run():
        bpe = kept(("bpe", path, words), lambda: Bpe(path, words))

        def work(texts):
            made = bpe.encode(texts)
            return [[len(x) // 4 for x in made], made, list(map(bpe.decode, made))]

        return work

    return annotate(docs, run, f"n_tokens long, `{ids}` binary, `{to}` string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for every row of docs (doc_id, text); null texts count as empty."""

    def run():
        bpe = kept(("bpe", path), lambda: Bpe(path))

        def work(texts):
            made = bpe.encode(texts)
            sha = lambda x: hashlib.sha256(x).hexdigest()
            return [[len(x) // 4 for x in made], [sha(x) for x in made], [sha(bpe.decode(x).encode("utf-8")) for x in made]]

        return work

    return annotate(docs.select("doc_id", "text"), run, "n_tokens long, ids_sha256 string, decoded_sha256 string", drop=("text",))
