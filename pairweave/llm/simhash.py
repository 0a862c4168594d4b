"""9. SimHash near-duplicates, linked exactly through vantage-point trees.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Distinct fingerprints (equal
ones are grouped first, so copies cost nothing) are dealt to shards by a vantage-point tree: each inner node splits by
the Hamming distance to a vantage point. A fingerprint lives in one leaf and is also sent, as a query, to every leaf
that the triangle bound cannot rule out, so each pair within the radius meets in the home leaf of either. A leaf that no
vantage point splits is dealt into parts of a bounded number of home points, each of which meets the whole leaf. The more
shards, the more points are sent to each, so a shard is a grid of cells: parts of its home points by parts of what is
sent; a group is a cell, and bounded. A shard's own vantage-point tree prunes again, down to blocks that are compared whole. A shard returns each member's local
root, a forest rather than all pairs; large-star/small-star rounds join the forests of all shards.

The tree is fitted on a bounded sample (at most ``SAMPLE`` fingerprints of least hash), which decides how even the
shards are, not what is found. Texts are read once and never shuffled. Hot fingerprints and hubs of large classes are
looked up where their rows are (``looked_up``).

Null and empty texts have fingerprint zero and are linked like any other. A null id is ignored in the smallest id of a
class. Repeated rows repeat. Only the id and the text are carried. Texts of any length are hashed whole, chunk by chunk. An
empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slices, bytes_list, fresh, looked_up, written

SHINGLE, RADIUS, SEED = 3, 2, 42
SAMPLE = 1 << 18
#: Fingerprints that live in one shard, about: an eighth of all, but no fewer or more than these. The fewer shards, the fewer
#: are sent to several of them. And fingerprints in a block that is compared whole.
SHARDS, SHARD, BLOCK = 8, (20_000, 1 << 20), 512
#: Home points, and points sent, in one group.
CELL = 1 << 21
#: Bytes of a text whose words are hashed at once: a text of any length takes some 30 times as many bytes, beside itself.
CHUNK = 1 << 20
WHITE = re.compile(rb"[\t-\r ]")


def shingle_bits(words: list[bytes], shingle: int) -> tuple[np.ndarray, int]:
    """How often each bit is set in the hashes of the shingles (of all words, if they are fewer), and how many those are."""
    joined = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts = np.concatenate(([0], spaces + 1))[: max(1, len(words) - shingle + 1)]
    ends = np.concatenate((spaces, [len(joined)]))[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype="<u8",
    )
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return bits, len(hashes)


def chunks_of_words(data: bytes, size: int) -> Iterator[list[bytes]]:
    """The words of a text, from about ``size`` bytes at a time; a chunk ends with white space."""
    at = 0
    while at < len(data):
        white = WHITE.search(data, at + size) if at + size < len(data) else None
        end = white.end() if white else len(data)
        yield data[at:end].lower().split()  # bytes: A-Z only; parted at space and \t to \r
        at = end


def fingerprint(data: bytes, shingle: int = SHINGLE, chunk: int = CHUNK) -> int:
    """The 64-bit fingerprint of a text's UTF-8 bytes; a chunk's last words go on to the next chunk."""
    set_bits, n, held = np.zeros(64, np.int64), 0, []
    for words in chunks_of_words(data, chunk):
        held += words
        if len(held) >= shingle:
            bits, more = shingle_bits(held, shingle)
            set_bits, n = set_bits + bits, n + more
            held = held[len(held) - shingle + 1 :]
    if not n and held:
        set_bits, n = shingle_bits(held, shingle)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprinter(shingle: int = SHINGLE):
    """Column function: text to its fingerprint as a signed 64-bit number."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        of = lambda some: np.array([fingerprint(x, shingle) for x in bytes_list(some)], dtype=np.uint64)
        return by_slices(texts, pa.int64(), lambda some: pa.array(of(some).view(np.int64)))

    return run


def distance(a: np.ndarray, b: np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def split_of(points: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """A vantage point and a distance that leave the least pairs to compare; None if no split saves any."""
    best, found = 0.97, None
    for vantage in points[:: max(1, len(points) // 8)][:8]:
        share = np.cumsum(np.bincount(distance(points, vantage), minlength=65)) / len(points)
        at = lambda d: share[np.clip(d, 0, 64)] * (d >= 0)
        d = np.arange(65)
        work = share * at(d + radius) + (1 - share) * (1 - at(d - radius))
        k = int(work.argmin())
        if work[k] < best and 0 < share[k] < 1:
            best, found = work[k], (np.uint64(vantage), k)
    return found


class VantageTree:
    """Shards of fingerprint space: nodes of (vantage, distance, inner child, outer child), children below 0 are leaves.

    A leaf has the number of its first shard and as many shards as hold about ``shard`` home points each.
    """

    def __init__(self, sample: np.ndarray, total: int, radius: int, shard: int):
        self.radius, self.nodes, self.leaves, self.parts = radius, [], 0, {}
        self.root = self._grow(sample, total / max(1, len(sample)), shard, 0)

    def _grow(self, points: np.ndarray, weight: float, shard: int, depth: int) -> int:
        found = split_of(
            points, self.radius,
        ) if len(points) * weight > shard and len(points) >= 8 and depth < 40 else None
        if found is None:
            leaf, parts = self.leaves, max(1, round(len(points) * weight / shard))
            self.leaves += parts
            self.parts[leaf] = parts
            return -leaf - 1
        vantage, k = found
        inner = distance(points, vantage) <= k
        self.nodes.append(None)
        at = len(self.nodes) - 1
        self.nodes[at] = (
            vantage, k, self._grow(points[inner], weight, shard, depth + 1),
            self._grow(points[~inner], weight, shard, depth + 1),
        )
        return at

    def deal(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of a point, leaf, and whether the point lives there, for each leaf that a point is sent to."""
        out, todo = [], [(self.root, np.arange(len(points)), np.ones(len(points), dtype=bool))]
        while todo:
            node, rows, home = todo.pop()
            if node < 0:
                leaf, parts = -node - 1, self.parts[-node - 1]
                own = (points[rows] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)
                out += [(rows, np.full(len(rows), leaf + i), home & (own == i)) for i in range(parts)]
                continue
            vantage, k, inner, outer = self.nodes[node]
            d = distance(points[rows], vantage).astype(np.int64)
            near, far = d <= k + self.radius, d > k - self.radius
            todo.append((inner, rows[near], home[near] & (d[near] <= k)))
            todo.append((outer, rows[far], home[far] & (d[far] > k)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Forest:
    """Disjoint sets of numbered members, joined many pairs at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, members: np.ndarray) -> np.ndarray:
        found = self.parent[members]
        while True:
            above = self.parent[found]
            if (above == found).all():
                self.parent[members] = found
                return found
            found = above

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b = ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def join_near(
    points: np.ndarray, home: np.ndarray, radius: int, block: int = BLOCK, sent: np.ndarray | None = None,
) -> Forest:
    """The forest of links within ``radius`` between points at home and those sent to a shard (all, if not told)."""
    forest, every = Forest(len(points)), np.arange(len(points))
    todo = [(every[home], every if sent is None else every[sent])]
    while todo:
        own, sent = todo.pop()
        if not len(own) or not len(sent):
            continue
        found = split_of(points[own[:: max(1, len(own) // 2048)]], radius) if len(own) > block else None
        if found:
            vantage, k = found
            d_own, d_sent = distance(points[own], vantage).astype(np.int64), distance(
                points[sent], vantage,
            ).astype(np.int64)
            todo.append((own[d_own <= k], sent[d_sent <= k + radius]))
            todo.append((own[d_own > k], sent[d_sent > k - radius]))
            continue
        for at in range(0, len(own), block):
            some = own[at : at + block]
            step = max(1, (1 << 21) // len(some))
            for start in range(0, len(sent), step):
                others = sent[start : start + step]
                x, y = np.nonzero(np.bitwise_count(points[some][:, None] ^ points[others][None, :]) <= radius)
                forest.join(some[x], others[y])
    return forest


def cells_of(dealt: DataFrame, cell: int) -> DataFrame:
    """``dealt`` (leaf, fp, home) with ``h``, ``s`` and ``sent``: a grid of a leaf's home points in parts of ``cell`` and of all its
    points in parts of ``cell``, so that each home point meets each other point in one cell, and no cell holds over about
    twice ``cell`` points, however many a leaf has. Nearly all leaves are one cell."""
    # One row a leaf: the tree that is broadcast has as many.
    sizes = dealt.groupBy("leaf").agg(
        F.ceil(F.count_if("home") / cell).cast("int").alias("hs"), F.ceil(F.count("*") / cell).cast("int").alias("ss"),
    ).where("hs > 0")
    own = dealt.join(F.broadcast(sizes), "leaf").withColumns({
        "own_h": F.pmod(F.xxhash64("fp", F.lit(1)), "hs").cast("int"), "own_s": F.pmod(F.xxhash64("fp", F.lit(2)), "ss").cast("int"),
    })
    place = lambda h, s, home, sent: F.struct(h.alias("h"), s.alias("s"), home.alias("home"), sent.alias("sent"))
    yes, no, every = F.lit(True), F.lit(False), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at_home = F.transform(every("ss"), lambda s: place(F.col("own_h"), s, yes, s == F.col("own_s")))
    sent_to = lambda hs: F.transform(hs, lambda h: place(h, F.col("own_s"), no, yes))
    others = F.filter(every("hs"), lambda h: h != F.col("own_h"))
    cells = F.when(F.col("home"), F.concat(at_home, sent_to(others))).otherwise(sent_to(every("hs")))
    return own.select("leaf", "fp", F.inline(cells))


def local_links(fps: DataFrame, radius: int, shard: int | None = None, cell: int = CELL) -> DataFrame:
    """Edges (a, b) of a forest for each cell of a shard over the distinct fingerprints of column fp."""
    spark = fps.sparkSession
    total = fps.count()
    shard = shard or min(SHARD[1], max(SHARD[0], total // SHARDS))
    wanted = min(SAMPLE, max(1 << 14, 64 * (total // shard)))
    sample = np.array(
        [r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(wanted).collect()], dtype=np.int64,
    ).view(np.uint64)
    tree = VantageTree(sample, total, radius, shard)
    shared = spark.sparkContext.broadcast(tree)

    def deal(batches):
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            rows, leaf, home = shared.value.deal(points)
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf.astype(np.int64)), pa.array(points[rows].view(np.int64)), pa.array(home)],
                names=["leaf", "fp", "home"],
            )

    def link(table: pa.Table) -> pa.Table:
        points = table.column("fp").to_numpy().view(np.uint64)
        home, sent = (table.column(c).to_numpy().astype(bool) for c in ("home", "sent"))
        forest = join_near(points, home, radius, sent=sent)
        root = forest.roots(np.arange(len(points)))
        joined = np.flatnonzero(root != np.arange(len(points)))
        return pa.table({"a": points[joined].view(np.int64), "b": points[root[joined]].view(np.int64)})

    dealt = written(fps.select("fp").mapInArrow(deal, "leaf bigint, fp bigint, home boolean"), "dealt")
    return cells_of(dealt, cell).groupBy("leaf", "h", "s").applyInArrow(link, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of the edges (a, b), by alternating star contraction.

    A node's least neighbour reaches the node's edges by ``looked_up``: a hub's edges stay where they are.
    """
    pairs = edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"),
    ).distinct().checkpoint()
    before = _state(pairs)
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        met = looked_up(both, least, ["u"], 2 * before[0])
        large = met.where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v"),
        ).where("u <> v").distinct().checkpoint()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = looked_up(large, least, ["u"], large.count()).select(
            F.col("v").alias("u"), F.col("m").alias("v"),
        ).union(least.select("u", F.col("m").alias("v")))
        pairs = small.where("u <> v").distinct().checkpoint()
        after = _state(pairs)
        if before == after:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = after


def _state(pairs: DataFrame) -> tuple:
    """Number and an order-free digest of pairs."""
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def classes(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS,
    shard: int | None = None, cell: int = CELL,
) -> DataFrame:
    """doc_id, fp (signed 64-bit fingerprint), component_id (least id of the class), root (least fingerprint of the class) of each row."""
    docs = written(df.select(F.col(doc_id).alias("doc_id"), fingerprinter(shingle)(F.col(text)).alias("fp")), "simhash")
    fps = docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    linked = components(local_links(fps.select("fp"), radius, shard, cell))
    of_root = written(linked.join(fps, linked["node"] == fps["fp"]).select("node", "root", "least"), "roots")
    least = of_root.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    of_root = looked_up(of_root, least, ["root"]).select(F.col("node").alias("fp"), "component_id", "root")
    own = fps.join(of_root, "fp", "left")
    # A class whose rows all have null ids has none; a class of one fingerprint is its own root.
    least = F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id"))
    of_fp = written(
        own.select("fp", "n", least.alias("component_id"), F.coalesce("root", "fp").alias("root")), "classes",
    )
    return looked_up(docs, of_fp, ["fp"]).select("doc_id", "fp", "component_id", "root")


def digests(df: DataFrame, **kept) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return classes(df, **kept).select(
        "doc_id", F.format_string("%016x", F.col("fp")).alias("fingerprint"), "component_id",
    )


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **kept) -> DataFrame:
    """The rows of ``df`` without those of a class's later ids, and of rows with an equal id and text all but one.

    Rows with a null id are kept only if no row of their class has an id, and then once.
    """
    return _kept(df, classes(df, doc_id, text, **kept), doc_id, text, kept.get("shingle", SHINGLE))


def _kept(df: DataFrame, found: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    repeated = df.groupBy(doc_id).agg(F.count("*").alias("n")).where(
        F.col(doc_id).isNull() | (F.col("n") > 1)
    ).limit(1).count()
    if repeated:  # ids do not tell the rows apart: one row of each (id, text), then one text of each class
        df = df.dropDuplicates([doc_id, text])
        fp, least = fresh(df, "fp"), fresh(df, "least")
        # By root: classes may share their least id where ids repeat.
        best = classes(df, doc_id, text, shingle=shingle).groupBy("root", "fp").agg(
            F.min(F.col("doc_id")).alias("least")
        )
        first = best.groupBy("root").agg(
            F.min_by("fp", F.struct(F.col("least").isNull(), "least", "fp")).alias("fp"), F.min("least").alias("least"),
        )
        keep = first.select(F.col("least").alias(least), F.col("fp").alias(fp))
        numbered = df.withColumn(fp, fingerprinter(shingle)(F.col(text))).join(keep, fp).where(
            F.col(doc_id).eqNullSafe(F.col(least))
        )
        return numbered.dropDuplicates([fp, least]).select(*df.columns)
    later = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(doc_id))
    return df.join(later, doc_id, "left_anti").select(*df.columns)
