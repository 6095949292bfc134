"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton knows every run of words of any item. A document's words stream through it, and at each word
it holds the longest run that ends there and stands in an item. Where that reaches a window's length, the
window's words are hit. A numeric filter first finds stretches whose neighbouring words all follow each other
in some item; nothing outside of them can hold a window, so only they go through the automaton.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, kept, staged, unused

#: A word is a run of digits, letters and characters beyond ASCII; A-Z count as a-z.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
BLOCK_WORDS = 100_000  # an automaton of so many has at most twice as many states
FIELDS = "{p}n_words long, {p}n_hit long, {p}longest int, {p}items array<string>, {p}hits binary"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(TO_WORDS).split() if text else []


class Ids(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


class Automaton:
    """Of a list of (item, words); window is how many words make a match of an item that has as many."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.ids = window, Ids()
        self.size, self.link, self.next = [0], [-1], [{}]
        coded = [(k, [self.ids.setdefault(w, len(self.ids)) for w in words]) for k, words in items if words]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self.extend(last, c)
        n = len(self.size)
        self.full: dict[int, set[str]] = {}  # items by the state of a whole window
        self.short: list[list[tuple[int, str]]] = [[] for _ in range(n)]  # whole items that end a state's run
        for k, codes in coded:
            v, m = 0, 0
            for c in codes:
                v, m = self.step(v, m, c)
                if m >= window:
                    self.full.setdefault(self.up(v), set()).add(k)
            if len(codes) < window:
                self.short[v].append((len(codes), k))
        for v in sorted(range(1, n), key=self.size.__getitem__):
            self.short[v] = self.short[self.link[v]] + self.short[v]
        self.least = min([window, *(len(codes) for _, codes in coded)], default=window)
        pairs = {a * len(self.ids) + b for _, codes in coded for a, b in zip(codes, codes[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)

    def extend(self, last: int, c: int) -> int:
        size, link, nxt = self.size, self.link, self.next
        if c in nxt[last]:
            q = nxt[last][c]
            return q if size[q] == size[last] + 1 else self.clone(last, c, q)
        new = len(size)
        size.append(size[last] + 1)
        link.append(0)
        nxt.append({})
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if size[q] == size[p] + 1 else self.clone(p, c, q)
        return new

    def clone(self, p: int, c: int, q: int) -> int:
        new = len(self.size)
        self.size.append(self.size[p] + 1)
        self.link.append(self.link[q])
        self.next.append(dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def step(self, v: int, m: int, c: int) -> tuple[int, int]:
        """The state and length of the longest match after word c."""
        nxt = self.next
        while c not in nxt[v]:
            if v == 0:
                return 0, 0
            v = self.link[v]
            m = self.size[v]
        return nxt[v][c], m + 1

    def up(self, v: int) -> int:
        """The state of the last `window` words of a match in state v."""
        while self.size[self.link[v]] >= self.window:
            v = self.link[v]
        return v

    def match(self, words: list[bytes], hit: np.ndarray, found: set[str]) -> int:
        """Marks hit words and adds items; the longest match in words."""
        longest = 0
        if not self.ids:
            return 0
        a = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        code = a[:-1] * len(self.ids) + a[1:]
        at = np.searchsorted(self.pairs, code)
        known = (a[:-1] >= 0) & (a[1:] >= 0) & (at < len(self.pairs))
        known[known] = self.pairs[at[known]] == code[known]
        edge = np.diff(np.concatenate([[0], known.astype(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        if self.least == 1:
            alone = a >= 0
            for x, y in zip(begin, end, strict=True):
                alone[x:y] = False
            begin = np.concatenate([begin, np.flatnonzero(alone)])
            end = np.concatenate([end, np.flatnonzero(alone) + 1])
        far = end - begin >= self.least
        for x, y in zip(begin[far].tolist(), end[far].tolist(), strict=True):
            v = m = 0
            for i, c in enumerate(a[x:y].tolist(), x):
                v, m = self.step(v, m, c)
                longest = max(longest, m)
                if m >= self.window:
                    hit[i + 1 - self.window : i + 1] = True
                    found |= self.full[self.up(v)]
                for n, k in self.short[v]:
                    if m >= n:
                        hit[i + 1 - n : i + 1] = True
                        found.add(k)
        return longest


def blocks_of(benchmark: DataFrame, most: int):
    """Lists of (item_id as text, words) with about `most` words each, fetched one after the other."""
    block, n = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        words = words_of(text)
        if words and item is not None:
            block.append((item, words))
            n += len(words)
            if n >= most:
                yield block
                block, n = [], 0
    yield block  # the last may be empty


def with_last(items):
    """The items, each with whether it is the last."""
    items = iter(items)
    held = next(items)
    for x in items:
        yield held, False
        held = x
    yield held, True


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = 13, prefix: str = "", block_words: int = BLOCK_WORDS, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with n_words, n_hit (words within an occurrence of a window), longest (words of the longest run shared
    with an item), items (sorted ids of items with occurring windows) and hits (a bit per word), each name after prefix.

    A window is `window` consecutive words of an item, or all words of a shorter one. Items are taken in blocks
    of about block_words words, one automaton each, so a large benchmark needs more passes, not more memory.
    Null and empty texts have no words; items with null ids or without words match nothing; repeated rows and
    items change nothing but their own rows. Input columns that have a result's name are replaced.
    """
    spark = docs.sparkSession
    for i, (block, last) in enumerate(with_last(blocks_of(benchmark, block_words))):
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex
        first = i == 0
        fields = FIELDS.format(p=prefix)
        before = [f"{prefix}hits", f"{prefix}items", f"{prefix}longest"]

        def run(sent=sent, name=name, first=first):
            automaton = kept(("automaton", name), lambda: Automaton(sent.value, window))

            def work(rows):
                out = []
                for row in rows:
                    text, (bits, had, most) = (row, (b"", (), 0)) if first else (row["t"], (row["h"], row["i"], row["l"]))
                    words = words_of(text)
                    hit = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(words)).astype(bool) if bits else np.zeros(len(words), bool)
                    found = set(had)
                    longest = automaton.match(words, hit, found) if words else 0
                    out.append((len(words), int(hit.sum()), max(longest, most), sorted(found), np.packbits(hit).tobytes()))
                return list(zip(*out, strict=True)) or [[]] * 5

            return work

        if first:
            docs = annotate(docs, run, fields, drop=drop if last else ())
        else:
            state = F.struct(F.col("text").alias("t"), *(F.col(f"`{c}`").alias(k) for c, k in zip(before, "hil", strict=True)))
            docs = annotate(docs.withColumn(f"{prefix}state", state), run, fields, f"{prefix}state", drop=(f"{prefix}state", *(drop if last else ())))
        if not last:
            docs = staged(docs, "matched")  # so that one automaton at a time is in a worker's memory
    return docs


def contaminated(prefix: str = "", coverage: int = 20) -> F.Column:
    """Whether a hit document's hit words are at least one in `coverage`."""
    n, hit = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_hit")
    return (hit > 0) & (coverage * hit >= n)


def cut(text: str | None, bits: bytes) -> str | None:
    """The text without its hit words; what stands between words stays."""
    if not text or not any(bits):
        return text
    raw = text.encode("utf-8")
    marked = raw.translate(TO_WORDS)
    hit = np.unpackbits(np.frombuffer(bits, np.uint8))
    out, at, k = [], 0, 0
    for word in marked.split():
        i = marked.index(word, at)
        out.append(raw[at:i])
        if not hit[k]:
            out.append(raw[i : i + len(word)])
        at, k = i + len(word), k + 1
    return (b"".join(out) + raw[at:]).decode("utf-8")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage: int = 20) -> DataFrame:
    """docs without contaminated rows; in the other rows that have hits, the hit words are cut from the text. Null and
    empty texts stay as they are, other columns pass through whatever their names."""
    p = prefix_for(docs)
    x = find_items(docs, benchmark, window, p).where(~contaminated(p, coverage))
    (both,) = unused(x, "own_cut")
    x = x.withColumn(both, F.struct(F.col("text").alias("t"), F.col(f"{p}hits").alias("h")))
    x = annotate(x, lambda: lambda rows: [[cut(r["t"], r["h"]) for r in rows]], "text string", both)
    return x.select([F.col(f"`{c}`") for c in docs.columns])


def prefix_for(docs: DataFrame) -> str:
    """A prefix of find_items() with which no result is named like a column of docs."""
    p = "hit_"
    while any(c.lower().startswith(p) for c in docs.columns):
        p = "_" + p
    return p
