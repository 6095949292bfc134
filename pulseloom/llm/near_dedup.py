"""Near-duplicate documents by a chosen-path similarity join on minwise signatures.

A document is its set of distinct k-word shingles. Equal sets are one class, so copies cost one row.
Classes are branched by several independent random trees: each node picks one coordinate of the minwise
signature (sometimes two, so that a pair as similar as the threshold keeps about one common child in
expectation) and a class goes to the child named by its minwise token there. Nodes that hold one class or
one component end; nodes that stay large are branched further. In a small node all classes are compared by
signature, and what looks similar is confirmed on the full sets.

Each level loses some pairs, so trees are added with depth: classes whose nodes are still large get as many
more trees as keep a pair at the threshold in a common node with a probability of RECALL.

Classes that are already connected need no comparison with each other. So the trees run in two steps: the
first links most copies through the likeliest pairs of a few trees, the second compares all that is left
across components. A large group of near copies is connected by about as many confirmed pairs as it has
members. Nothing is capped: in a large node the classes of its largest component are dealt out in blocks that
meet only the blocks of the other classes, and a node that deepest branching leaves with many others as all
pairs of blocks across components.
"""

from __future__ import annotations

from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import filtered, kept, labels, sorted_side, spread_join, staged, stars, unused

T = 64  # coordinates of a signature
SMALL = 1024  # classes in a node that are compared exhaustively
FIRST = 3  # levels of a tree before its nodes are counted
RECALL = 0.99  # least probability that a pair at the threshold shares a node that is compared
FEW = 3  # trees of the first step
EARLY = 3  # rounds towards components after it; labels of what is surely connected are enough there
PART = 128  # classes that are compared at once while links are still few
CACHE = 150_000  # words whose hashes a worker keeps


class Hashes(dict):
    """64-bit hashes of words; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased, in UTF-8; split at ASCII white space only."""
    return text.encode("utf-8").lower().split() if text else []


def shingles(words: list[bytes], k: int, hashes: Hashes) -> np.ndarray:
    """The sorted set of 64-bit hashes of k-word shingles; of fewer words, of the whole sequence."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(len(h), k), np.uint64)
    for i in range(min(len(h), k)):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def key_of(shingle_set: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingle_set.tobytes())


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, rk (hash of the text), n_shingles, cid (16 bytes naming the set; null if empty), sig."""
    rng = np.random.default_rng(7)
    mul = rng.integers(1, 1 << 63, T, np.uint64) * np.uint64(2) + np.uint64(1)
    xor = rng.integers(0, 1 << 63, T, np.uint64)

    def run(batches):
        hashes = kept(("hashes",), Hashes)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = [shingles(words_of(t), k, hashes) for t in batch.column(2).to_pylist()]
                full = [s for s in sets if len(s)]
                sig = np.empty((len(full), T), np.uint16)
                if full:
                    flat = np.concatenate(full)
                    starts = np.cumsum([0] + [len(s) for s in full[:-1]])
                    for i in range(T):
                        x = (flat ^ xor[i]) * mul[i]
                        x ^= x >> np.uint64(32)
                        x *= mul[i - 1]
                        sig[:, i] = ((np.minimum.reduceat(x, starts) >> np.uint64(20)) & np.uint64(0xFFFF)).astype(np.uint16)
                rows = iter(sig)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([key_of(s) if len(s) else None for s in sets], pa.binary()), pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary())],
                    ["doc_id", "rk", "n_shingles", "cid", "sig"],
                )

    rows = docs.select("doc_id", F.xxhash64("text").alias("rk"), "text")
    return rows.mapInArrow(run, "doc_id long, rk long, n_shingles long, cid binary, sig binary")


@cache
def trees_for(levels: int, threshold: float, least: int) -> int:
    """So many trees, `least` or more, that RECALL of simulated pairs at the threshold share a node of them at a level.

    The trees are not independent, as all take from the same T coordinates; so their own nodes are simulated.
    """
    rng, n = np.random.default_rng(11), 4000
    a, b = rng.integers(0, 1 << 16, (2, n, T)).astype(np.uint16)
    b = np.where(rng.random((n, T)) < threshold, a, b)
    met, t = np.zeros(n, bool), 0
    while t < least or met.mean() < RECALL:
        (i, x), (j, y) = (descend(sig, np.full(n, root(t)), 0, levels, threshold) for sig in (a, b))
        met[i[np.isin(mixed(x, i, 0), mixed(y, j, 0))]] = True
        t += 1
    return t


def root(tree: int) -> np.uint64:
    return np.uint64(0x51ED2701 + tree)


def descend(sig: np.ndarray, nodes: np.ndarray, start: int, levels: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows of sig and their nodes `levels` levels under the given ones, which lie at level `start`."""
    i, n = np.arange(len(sig)), nodes
    for level in range(start, start + levels):
        one, other, two = picks(n, level, threshold)
        i, n, c = np.concatenate([i, i[two]]), np.concatenate([n, n[two]]), np.concatenate([one, other[two]])
        n = mixed(n, sig[i, c], level * T + c)
    return i, n


def picks(nodes: np.ndarray, level: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The coordinate that each node takes, a second one, and whether it takes that too: no node in the first levels,
    that all classes go through, then so many that nodes take 1 / threshold on average."""
    h = mixed(nodes, np.full(len(nodes), 1 + level, np.uint64), 1 << 20)
    one = h % np.uint64(T)
    other = (one + np.uint64(1) + (h >> np.uint64(8)) % np.uint64(T - 1)) % np.uint64(T)
    two = (h >> np.uint64(32)).astype(float) / 2**32 < (1 / threshold - 1 if level >= FIRST else 0)
    return one.astype(int), other.astype(int), two


def branch(rows: DataFrame, trees: list[int], start: int, levels: int, threshold: float) -> DataFrame:
    """Adds `levels` levels to the paths of rows (tree, node, cid, comp, sig); from the roots if start is 0."""
    def run(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, T)
            if start:
                todo = [(t, np.flatnonzero(b.column("tree").to_numpy() == t)) for t in trees]
                nodes = b.column("node").to_numpy().astype(np.uint64)
            else:
                todo, nodes = [(t, np.arange(b.num_rows)) for t in trees], None
            for t, at in todo:
                i, n = descend(sig[at], nodes[at] if start else np.full(len(at), root(t)), start, levels, threshold)
                for k in range(0, len(i), 10_000):
                    j, m = at[i[k : k + 10_000]], n[k : k + 10_000]
                    x = b.take(pa.array(j))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), t, np.int32)), pa.array(m.astype(np.int64)), x.column("cid"), x.column("comp"), x.column("sig")], ["tree", "node", "cid", "comp", "sig"])

    cols = ["tree", "node", "cid", "comp", "sig"] if start else ["cid", "comp", "sig"]
    return rows.select(*cols).mapInArrow(run, "tree int, node long, cid binary, comp binary, sig binary")


def mixed(node: np.ndarray, token: np.ndarray, salt) -> np.ndarray:
    x = (node ^ (token.astype(np.uint64) + (np.asarray(salt).astype(np.uint64) << np.uint64(17)))) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def by_node(rows: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """What work gives for the rows of each (node, part): a list of rows of `schema` from lists of the columns.

    Rows come sorted by node, so a task streams through its nodes and holds one at a time.
    """

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        held = None

        def made(table, cuts):
            out = []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y - x > 1:
                    part = table.slice(x, y - x)
                    out += work(int(part.column(0)[0].as_py()), int(part.column(1)[0].as_py()), *(part.column(c).to_pylist() for c in columns))
            cols = list(zip(*out, strict=True)) or [[]] * len(target)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target, strict=True)], schema=target)

        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            key = [t.column(i).to_numpy() for i in (0, 1)]
            cuts = (np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])) + 1).tolist()
            if cuts:
                yield made(t, [0, *cuts])
            held = t.slice(cuts[-1] if cuts else 0)
        if held is not None and held.num_rows:
            yield made(held, [0, held.num_rows])

    x = rows.select("node", "part", *columns).repartition("node", "part").sortWithinPartitions("node", "part")
    return x.mapInArrow(run, schema)


class Joined:
    """Components that grow together."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.root(x)] = self.root(y)


def likely(cid: list, comp: list, sig: list, least: float) -> tuple[list, list, np.ndarray]:
    """Rows without repeated cid: their places, their components as numbers, and (i, j, coordinates that agree) of the
    pairs of different components that agree in `least` of the coordinates."""
    at = list({c: i for i, c in reversed(list(enumerate(cid)))}.values())[::-1]
    names: dict = {}
    codes = np.array([names.setdefault(comp[i], len(names)) for i in at])
    found = []
    if len(names) > 1:
        s = np.frombuffer(b"".join([sig[i] for i in at]), np.uint16).reshape(len(at), T)
        need = int(np.ceil(least * T))
        for i in range(len(at) - 1):
            same = (s[i + 1 :] == s[i]).sum(1)
            j = np.flatnonzero((same >= need) & (codes[i + 1 :] != codes[i]))
            if len(j):
                found.append(np.stack([np.full(len(j), i), j + i + 1, same[j]], 1))
    return at, codes.tolist(), np.concatenate(found) if found else np.empty((0, 3), int)


def node_pairs(rows: DataFrame, least: float) -> DataFrame:
    """The likeliest pair (a, b) for each two components that join when likely pairs are taken, best first, in a (node, part)."""

    def work(node, part, cid, comp, sig):
        at, codes, pairs = likely(cid, comp, sig, least)
        sets, out = Joined(max(codes) + 1), []
        for i, j, _ in pairs[np.argsort(-pairs[:, 2], kind="stable")].tolist():
            if sets.root(codes[i]) != sets.root(codes[j]):
                sets.join(codes[i], codes[j])
                out.append(tuple(sorted((cid[at[i]], cid[at[j]]))))
        return out

    return by_node(rows, ["cid", "comp", "sig"], work, "a binary, b binary").distinct()


def node_links(rows: DataFrame, docs: DataFrame, classes: DataFrame, least: float, k: int, percent: int) -> DataFrame:
    """Confirmed pairs (a, b) across the components of each (node, part): enough of them to join all that are linked.

    Each node compares its classes exhaustively, on signatures first. A node with no more likely pairs than classes
    hands them on, so that pairs of several trees are confirmed once. In others the classes with a partner get their
    texts and are compared in place: what is moved grows with classes and not with pairs.
    """

    def first(node, part, cid, comp, sig):
        at, codes, pairs = likely(cid, comp, sig, least)
        if len(pairs) <= len(at):
            return [(None, None, None, None, None, *sorted((cid[at[i]], cid[at[j]]))) for i, j, _ in pairs.tolist()]
        return [(node, part, cid[at[i]], comp[at[i]], sig[at[i]], None, None) for i in np.unique(pairs[:, :2]).tolist()]

    def second(node, part, cid, comp, sig, text):
        hashes = kept(("hashes",), Hashes)
        at, codes, pairs = likely(cid, comp, sig, least)
        full, sets, out = {}, Joined(max(codes) + 1), []
        for i, j, _ in pairs[np.argsort(-pairs[:, 2], kind="stable")].tolist():
            if sets.root(codes[i]) != sets.root(codes[j]):
                for x in (i, j):
                    if x not in full:
                        full[x] = shingles(words_of(text[at[x]]), k, hashes)
                if similar(full[i], full[j], percent):
                    sets.join(codes[i], codes[j])
                    out.append(tuple(sorted((cid[at[i]], cid[at[j]]))))
        return out

    kind = "node long, part long, cid binary, comp binary, sig binary, a binary, b binary"
    found = staged(by_node(rows, ["cid", "comp", "sig"], first, kind), "found")
    pairs = staged(found.where("a IS NOT NULL").select("a", "b").distinct(), "pairs")
    dense = found.where("cid IS NOT NULL")
    texts = texts_of(dense.select("cid").unionByName(ends_of(pairs)).distinct(), docs, classes)
    dense = by_node(dense.join(sorted_side(texts), "cid"), ["cid", "comp", "sig", "text"], second, "a binary, b binary")
    return confirm(pairs, texts, k, percent).unionByName(dense).distinct()


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    total = len(x) + len(y)
    both = np.sort(np.concatenate([x, y]))
    both = int((both[1:] == both[:-1]).sum())
    return 100 * both >= percent * (total - both)


def texts_of(ids: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """cid and text, once for each cid of ids. A filter of the wanted rows keeps most other texts out of the exchange."""
    wanted = staged(ids.join(sorted_side(classes.select("cid", "doc_id", "rk")), "cid"), "wanted")
    rows = filtered(docs.select("doc_id", F.xxhash64("text").alias("rk"), "text"), wanted, ["doc_id", "rk"], "maybe").where("maybe")
    wanted = wanted.select("cid", F.col("doc_id").alias("d"), F.col("rk").alias("r"))
    texts = rows.join(sorted_side(wanted), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("rk") == F.col("r"))).select("cid", "text")
    return staged(texts.dropDuplicates(["cid"]), "texts")  # copies of a row share doc_id and hash


def split_nodes(rows: DataFrame, trees: list[int], threshold: float, rounds: int, salt: int, every: bool) -> DataFrame:
    """Rows (node, part, cid, comp, sig) of the small nodes; large ones are branched, then dealt out in parts.

    Without `every` the parts of a large node are blocks of its classes. With it they hold all pairs across components:
    the classes of a node's largest component make blocks that meet only blocks of the other classes. That makes at
    most five times as many rows of a node of SMALL classes or SMALL / 2 others; the rest are branched. Before classes
    are branched in every tree, they get the trees that RECALL needs at the next depth.
    """
    done, start, x, block = [], FIRST, branch(rows, trees, 0, FIRST, threshold), SMALL // 4 if every else PART
    for r in range(rounds + 1):
        x = x.withColumn("h", F.xxhash64("comp"))
        size = x.groupBy("tree", "node", "h").agg(F.count("*").alias("m")).groupBy("tree", "node").agg(F.sum("m").alias("n"), F.max("m").alias("m"), F.max_by("h", "m").alias("top"), F.count("*").alias("c"))
        x = staged(spread_join(x, staged(size.where("c > 1").drop("c"), "sizes"), ["tree", "node"]), "nodes")
        few = 2 * block if every else block
        done.append(x.where(f"n <= {few}").withColumn("part", F.lit(0).cast("long")))
        x = x.where(f"n > {few}")
        deal = F.lit(r == rounds) | ((F.col("n") <= SMALL) | (F.col("n") - F.col("m") <= SMALL // 2) if every else F.lit(False))
        done.append(dealt(x.where(deal), block, salt, every))
        x = x.where(~deal)
        if r == rounds or x.isEmpty():
            break
        deeper = branch(x, trees, start, 2, threshold)
        start += 2
        more = list(range(len(trees), trees_for(start, threshold, len(trees)))) if every else []
        if more:
            at_risk = x.select("cid", "comp", "sig").dropDuplicates(["cid"])
            deeper = deeper.unionByName(branch(at_risk, more, 0, start, threshold))
            trees = trees + more
        x = deeper
    return reduce(DataFrame.unionByName, [d.select("tree", "node", "part", "cid", "comp", "sig") for d in done])


def dealt(x: DataFrame, block: int, salt: int, every: bool) -> DataFrame:
    """x (rows of nodes with n classes, m of them of the component with hash `top`) with part; rows stand once for each."""
    place = lambda n: F.pmod(F.xxhash64("cid", F.lit(salt)), F.ceil(n / block)).cast("int")
    if not every:
        return x.withColumn("part", place(F.col("n")).cast("long"))
    of_top, b, g = F.col("h") == F.col("top"), F.ceil(F.col("m") / block).cast("int"), F.ceil((F.col("n") - F.col("m")) / block).cast("int")
    x = x.withColumn("own", F.when(of_top, place(F.col("m"))).otherwise(b + place(F.col("n") - F.col("m"))))
    x = x.withColumn("other", F.explode(F.sequence(F.when(of_top, b).otherwise(0), b + g - 1)))
    return x.withColumn("part", F.least("own", "other").cast("long") * (1 << 31) + F.greatest("own", "other"))


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union; texts: cid and text."""

    def run(batches):
        hashes, last = Hashes(), {}

        def of(cid, text):
            if cid not in last:
                if len(last) > 64:
                    last.clear()
                last[cid] = shingles(words_of(text), k, hashes)
            return last[cid]

        for b in batches:
            keep = []
            for i, (a, c, ta, tc) in enumerate(zip(*(b.column(x).to_pylist() for x in ("a", "b", "ta", "tb")), strict=True)):
                if similar(of(a, ta), of(c, tc), percent):
                    keep.append(i)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    x = pairs.join(sorted_side(texts.select(F.col("cid").alias("a"), F.col("text").alias("ta"))), "a").join(sorted_side(texts.select(F.col("cid").alias("b"), F.col("text").alias("tb"))), "b")
    return x.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def groups(docs: DataFrame, k: int, threshold: float, trees: int = 10, rounds: int = 4) -> DataFrame:
    """doc_id, rk, n_shingles, comp (null without shingles) and component_id for every row of docs."""
    percent = round(100 * threshold)
    least = threshold - 4 * (threshold * (1 - threshold) / T) ** 0.5
    sigs = staged(signatures(docs, k), "signatures")
    classes = staged(sigs.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "rk", "sig")).alias("s"), F.count("*").alias("n")).select("cid", "low", "n", "s.doc_id", "s.rk", "s.sig"), "classes")
    linked = comps = None
    for step, own in enumerate((list(range(FEW)), list(range(trees)))):
        rows = classes.select("cid", "sig")
        rows = rows.join(sorted_side(comps), rows.cid == comps.node, "left").select("cid", F.coalesce("comp", "cid").alias("comp"), "sig") if comps is not None else rows.withColumn("comp", F.col("cid"))
        every = step == 1
        rows = split_nodes(rows, own, threshold, rounds if every else 1, step, every)
        if every:
            new = node_links(rows, docs, classes, least, k, percent)
        else:
            pairs = staged(node_pairs(rows, least), "pairs")
            new = confirm(pairs, texts_of(ends_of(pairs), docs, classes), k, percent)
        edges = staged(new, "links") if linked is None else staged(new, "links").unionByName(linked.select(F.col("u").alias("a"), F.col("v").alias("b")))
        linked = stars(edges, rounds=None if every else EARLY)
        comps = labels(linked)
    lowest = classes.join(sorted_side(comps), classes.cid == comps.node, "left").select("cid", F.coalesce("comp", "cid").alias("comp"), "low", "n")
    lowest = staged(lowest, "lowest")
    ids = staged(lowest.groupBy("comp").agg(F.min("low").alias("component_id")), "ids")
    owner = staged(lowest.select("cid", "comp", "n").join(sorted_side(ids), "comp"), "owners")
    out = spread_join(sigs.where("cid IS NOT NULL").select("doc_id", "rk", "n_shingles", "cid"), owner, ["cid"]).select("doc_id", "rk", "n_shingles", "comp", "component_id")
    return out.unionByName(sigs.where("cid IS NULL").select("doc_id", "rk", "n_shingles", F.lit(None).cast("binary").alias("comp"), F.col("doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, trees: int = 10, rounds: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text; other columns are ignored).

    Documents are linked if 100 * |A & B| >= 100 * threshold * |A | B| for their sets of distinct k-word
    shingles (one shingle of all words if there are fewer). component_id is the smallest doc_id reachable,
    kept says that it is the row's own. Null, empty and blank texts have no shingles and are linked with
    nothing. Rows that repeat count as copies: if they share a doc_id, each has it as its own. Rows with a
    null doc_id are linked but never name a component unless all of it has none; they are not kept otherwise.
    An empty table gives an empty result.
    """
    out = groups(docs, k, threshold, trees, rounds)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row of docs of each group of near duplicates: of the smallest doc_id, null last, then of the smallest hash
    of the text; of rows equal in both any one, as they are copies. Rows without shingles (null, empty or blank texts)
    all stay. Other columns pass through whatever their names; an empty table gives an empty result."""
    found = staged(groups(docs, k, threshold).where("comp is not null").groupBy("comp", "doc_id", "rk").agg(F.count("*").alias("n")), "rows")
    first = found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rk")).alias("f"))
    first = staged(first.select("comp", F.col("f.doc_id").alias("fd"), F.col("f.rk").alias("fr")), "first")
    kept = F.col("doc_id").eqNullSafe(F.col("fd")) & (F.col("rk") == F.col("fr"))
    maybe, rk, d, r, one = unused(docs, "own_maybe", "own_rk", "own_d", "own_r", "own_one")
    # What goes, or has copies of which one stays. Most rows are neither; a filter keeps them out of the join.
    known = staged(found.join(sorted_side(first), "comp").withColumn("one", kept).where("n > 1 OR NOT one").select("doc_id", "rk", "one"), "known")
    x = filtered(docs.withColumn(rk, F.xxhash64("text")), known.select("doc_id", F.col("rk").alias(rk)), ["doc_id", rk], maybe)
    there = F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(rk) == F.col(r))
    out = x.where(maybe).join(known.select(F.col("doc_id").alias(d), F.col("rk").alias(r), F.col("one").alias(one)), there, "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    plain = x.where(~F.col(maybe)).select(columns).unionByName(out.where(F.col(one).isNull()).select(columns))
    return plain.unionByName(out.where(one).dropDuplicates(["doc_id", rk]).select(columns))
