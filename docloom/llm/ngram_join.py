"""Near duplicates: an exact Jaccard join of word-shingle sets over count vectors.

Every distinct set becomes a point: its shingles are hashed into GROUPS groups and
the group counts are the coordinates.  No two sets share more shingles than the sum
of the lesser of their coordinates, so an R-tree over the points is searched by
branch and bound for partners that could still reach the threshold, and what
survives is verified on the full sets.

One R-tree over all points wouldn't distribute.  Sets that reach the threshold share
a shingle among the first n - ceil(t n) + 1 of each in any common order, so shingles
of those prefixes deal the points to blocks, and each block has its own tree.  The
order puts frequent shingles last (they are counted in all documents; the order
decides on cost alone, not on results), so common passages form no blocks.

Groups of copies: equal sets are one point, and blocks of the same members are one
block.  The trees first tell which points have any possible partner; texts of the
others aren't looked at again.  Every point has a home, its largest block, cut into
cells of TILE points by hash.  Sets travel to cells, not to blocks: a cell's tree is
searched for pairs and these are verified on the sets at once.  A pair that links found
before connect is skipped, so a group of thousands of near copies costs about one
comparison a member, not one a pair, and a task returns a spanning forest, at most a
row for each point.  That leaves a few clusters a group; those of a home of several
cells are compared by one point each.  Then the trees of blocks that still hold several
clusters tell which points of which pairs of cells have a possible partner in another
cluster, and these are verified cell by cell.  Nothing is capped: every link between
two components is found.

Blocks of more than BLOCK_TILE points are dealt to tiles; only points without a partner
in their own tile, or still apart in the end, are looked up in the others.

Defined cases.  Null, empty or word-less text: empty set, linked with nothing.
Very long text: one set, in pieces of a megabyte; a count above 254 is read as the
size of the set, which only weakens the bound.  Ties: of equal sets the one read first
stands for the others; a component is named by its least id.  Null ids: linked like
others and given the component's least id, null if none.  Repeated ids or rows: each
row by its own text.  Empty table: no rows.  Extra and clashing columns: ignored by
`join_components`, kept by `keep_one`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, packed, text_key, unpacked
from .components import components
from .shingles import sets_of

GROUPS = 512
#: A count of this or more is stored as this and read as beyond any other.
MANY = 255
LEAF = 16
#: Shingles whose rank is kept, the most frequent (a bound for the broadcast).
MAX_FREQUENT = 1 << 16
#: Points of a block that are searched together, without their sets.
BLOCK_TILE = 1024
#: Points of a cell, and bytes of their sets.
TILE = 256
BYTES = 16 << 20
#: Points that a task takes up at once, whole blocks of them.
CHUNK = 8192


def frequent_shingles(docs: DataFrame, size: int = 5) -> np.ndarray:
    """The most frequent shingles, frequent last.

    All documents are counted.  Runs of about a million shingles report those that
    are in one of 256 of the run's documents (16 at least); whatever is that frequent
    overall is so in some run.
    """

    def count(batches):
        def counted(held, docs_held):
            if not held:
                return
            h, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= max(16, docs_held // 256)
            yield pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(n[often])], ["h", "n"])

        held, total = [], 0
        for batch in batches:
            for s in sets_of(batch.column(0), size):
                held.append(s)
                total += len(s)
                if total >= 1 << 20:
                    yield from counted(held, len(held))
                    held, total = [], 0
        yield from counted(held, len(held))

    found = docs.select("text").mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "h").limit(MAX_FREQUENT).collect()
    return np.array([r.h for r in reversed(top)], np.int64).view(np.uint64)


def points(docs: DataFrame, frequent: np.ndarray, percent: int = 80, size: int = 5) -> DataFrame:
    """Per row: doc_id, _k1, _k2, n, f1, f2 (128 bits of the set), vec (counts), prefix."""
    order = np.argsort(frequent)
    known = frequent[order]

    def measure(batches):
        for batch in batches:
            cols = {k: [] for k in ("n", "f1", "f2", "vec", "prefix")}
            for s in sets_of(batch.column(3), size):
                n = len(s)
                digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                vec = np.minimum(np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS), MANY)
                take = n - (percent * n + 99) // 100 + 1 if n else 0
                if n and len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    hot = known[at] == s
                    s = np.concatenate([s[~hot], s[hot][np.argsort(order[at[hot]])]])
                cols["n"].append(n)
                cols["f1"].append(digest[0])
                cols["f2"].append(digest[1])
                cols["vec"].append(vec.astype(np.uint8).tobytes())
                cols["prefix"].append(s[:take].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3], pa.array(cols["n"], pa.int64()), pa.array(cols["f1"], pa.int64()),
                    pa.array(cols["f2"], pa.int64()), pa.array(cols["vec"], pa.binary()), pa.array(cols["prefix"], pa.list_(pa.int64())),
                ],
                ["doc_id", "_k1", "_k2", "n", "f1", "f2", "vec", "prefix"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), *text_key(F.col("text")), "text")
    return rows.mapInArrow(
        measure, "doc_id bigint, _k1 bigint, _k2 bigint, n bigint, f1 bigint, f2 bigint, vec binary, prefix array<bigint>"
    )


def _counts(vecs: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Count vectors; where a count was cut, the size of the set, which none exceeds."""
    c = np.frombuffer(b"".join(vecs), np.uint8).reshape(len(vecs), GROUPS).astype(np.int32)
    return np.where(c == MANY, sizes[:, None].astype(np.int32), c)


class RTree:
    """A packed R-tree over count vectors, in order of size and then of the coordinates.

    levels: from the points up, of every node the greatest coordinates, the least and
    greatest size of a set below it, and the least and greatest root.  Points of a
    root that would fill a leaf come together.
    """

    def __init__(self, vecs: np.ndarray, sizes: np.ndarray, roots: np.ndarray):
        spread = np.argsort(-vecs.var(0))[:4] if len(vecs) > LEAF else np.zeros(0, np.int64)
        band = np.floor(np.log(np.maximum(sizes, 1)) / np.log(1.25))
        _, of, n = np.unique(roots, return_inverse=True, return_counts=True)
        crowd = np.where(n[of] >= LEAF, of, -1)
        self.rows = np.lexsort([*(vecs[:, k] for k in spread[::-1]), band, crowd])
        kind = np.int16 if sizes.max(initial=0) < 1 << 15 else np.int32
        top, size, root = vecs[self.rows].astype(kind), sizes[self.rows], roots[self.rows]
        level = (top, size, size, root, root)
        self.levels = [level]
        while len(level[0]) > 1:
            cuts = np.arange(0, len(level[0]), LEAF)
            level = tuple(f.reduceat(x, cuts) for f, x in zip((np.maximum, np.minimum, np.maximum, np.minimum, np.maximum), level))
            self.levels.append(level)


def search(a: RTree, b: RTree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points of different roots whose sets could have a Jaccard similarity of `percent`.

    Both trees are walked down together; a pair of nodes is followed while the summed
    minima of their coordinates allow the overlap that their sizes ask for.
    """
    depth = max(len(a.levels), len(b.levels))
    i = j = np.zeros(1, np.int64)
    for level in range(depth - 1, -1, -1):
        sides = []
        for tree, nodes in ((a, i), (b, j)):
            own = min(level, len(tree.levels) - 1)
            sides.append((tree.levels[own], nodes, own == level and level < len(tree.levels) - 1))
        if level < depth - 1:  # from the nodes above to their children
            k = np.arange(LEAF)
            down_a, down_b = (k if s[2] else k[:1] for s in sides)
            i = np.repeat(i * (LEAF if sides[0][2] else 1), len(down_a) * len(down_b)) + np.tile(np.repeat(down_a, len(down_b)), len(i))
            j = np.repeat(j * (LEAF if sides[1][2] else 1), len(down_a) * len(down_b)) + np.tile(np.tile(down_b, len(down_a)), len(j))
        (top_a, low_a, high_a, first_a, last_a), (top_b, low_b, high_b, first_b, last_b) = sides[0][0], sides[1][0]
        there = (i < len(top_a)) & (j < len(top_b))
        i, j = i[there], j[there]
        fits = (100 * high_a[i] >= percent * low_b[j]) & (100 * high_b[j] >= percent * low_a[i])
        fits &= (first_a[i] != last_b[j]) | (last_a[i] != first_b[j])
        i, j = i[fits], j[fits]
        both = np.zeros(len(i), np.int64)
        for at in range(0, len(i), 4096):
            run = slice(at, at + 4096)
            both[run] = np.minimum(top_a[i[run]], top_b[j[run]]).sum(1, dtype=np.int64)
        fits = (100 + percent) * both >= percent * (low_a[i] + low_b[j])
        i, j = i[fits], j[fits]
    return a.rows[i], b.rows[j]


def _close(vecs: np.ndarray, sizes: np.ndarray, roots: np.ndarray, percent: int) -> np.ndarray:
    """Which points have a possible partner of another root.

    Neighbours in the order of a tree are tried first: in a group of copies that
    settles nearly all, and only the rest is searched for.
    """
    tree = RTree(vecs, sizes, roots)
    live = np.zeros(len(sizes), bool)
    for at in range(0, len(sizes), LEAF):
        near = tree.rows[at : at + LEAF]
        both = np.minimum(vecs[near, None], vecs[None, near]).sum(2)
        fits = (100 + percent) * both >= percent * (sizes[near, None] + sizes[None, near])
        fits &= roots[near, None] != roots[None, near]
        live[near] = fits.any(1)
    rest = np.flatnonzero(~live)
    if len(rest) and len(sizes) > LEAF:
        a, b = search(RTree(vecs[rest], sizes[rest], roots[rest]), tree, percent)
        live[rest[a]] = live[b] = True
    return live


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows, sorted by the first `keys` columns, as tables of whole groups with the places where groups begin."""
    held, rows = [], 0

    def cut(parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        new = np.ones(table.num_rows, bool)
        if table.num_rows:
            new[1:] = False
            for k in range(keys):
                x = table.column(k).to_numpy()
                new[1:] |= x[1:] != x[:-1]
        return table, np.flatnonzero(new)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            table, starts = cut(held)
            if len(starts) > 1:
                yield table.slice(0, starts[-1]), starts[:-1]
                table = table.slice(starts[-1])
            held, rows = table.to_batches(), table.num_rows
    if rows:
        yield cut(held)


def _pairs_within(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All i < j of groups that begin at `starts`."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.repeat(starts, sizes)
    i = first + np.arange(len(first)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    after = np.repeat(starts + sizes, sizes) - i - 1
    a = np.repeat(i, after)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after) - after, after)
    return a, b


def _bounded(vecs: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs could reach the threshold, by sizes and summed minima."""
    fits = (100 * n[i] >= percent * n[j]) & (100 * n[j] >= percent * n[i])
    at = np.flatnonzero(fits)
    for k in range(0, len(at), 4096):
        run = at[k : k + 4096]
        both = np.minimum(vecs[i[run]], vecs[j[run]]).sum(1, dtype=np.int64)
        fits[run] = (100 + percent) * both >= percent * (n[i[run]] + n[j[run]])
    return fits


def _possible(rows: DataFrame, vectors: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(h, root, node, n) of the points of blocks (h, tiles, root, node, n) that have a possible partner of another root."""
    b = rows.join(vectors, "node").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    b = b.select("h", "tile", "tiles", "root", "node", "n", "vec")
    kind = "h bigint, tile int, tiles int, root bigint, node bigint, n bigint"

    def within(batches):
        for table, starts in _whole_groups(batches, 2):
            root, n = (table.column(c).to_numpy() for c in ("root", "n"))
            vecs = _counts(table.column("vec").to_pylist(), n)
            sizes = np.diff(np.append(starts, len(n)))
            live = np.zeros(len(n), bool)
            few = sizes <= LEAF
            i, j = _pairs_within(starts[few], sizes[few])
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            fits = _bounded(vecs, n, i, j, percent)
            live[i[fits]] = live[j[fits]] = True
            for start, size in zip(starts[~few], sizes[~few]):
                own = slice(start, start + size)
                live[own] = _close(vecs[own], n[own], root[own], percent)
            rest = table.select(["h", "tile", "tiles", "root", "node", "n"])
            yield from rest.append_column("live", pa.array(live)).to_batches()

    told = b.repartition("h", "tile").sortWithinPartitions("h", "tile").mapInArrow(within, kind + ", live boolean")
    told = scratch.settle(told)
    found = told.where("live").select("h", "root", "node", "n")
    alone = told.where("not live and tiles > 1").select("h", "tiles", "tile", "root", "node", "n")
    if alone.isEmpty():
        return found
    # What has no partner in its tile is looked up in the other tiles.
    asked = alone.join(vectors, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).where("other <> tile")
    asked = asked.select(*(F.col(c).alias(a) for c, a in zip(("h", "other", "root", "node", "n", "vec"), ("h", "tile", "root", "node", "n", "vec"))))

    def across(asked: pa.Table, there: pa.Table) -> pa.Table:
        names = ["h", "root", "node", "n"]
        if not asked.num_rows or not there.num_rows:
            return asked.select(names).slice(0, 0)
        trees = []
        for t in (asked, there):
            root, n = t.column("root").to_numpy(), t.column("n").to_numpy()
            trees.append(RTree(_counts(t.column("vec").to_pylist(), n), n, root))
        i, j = search(*trees, percent)
        return pa.concat_tables([asked.take(pa.array(np.unique(i))).select(names), there.take(pa.array(np.unique(j))).select(names)])

    whole = b.where("tiles > 1").select("h", "tile", "root", "node", "n", "vec")
    far = asked.groupBy("h", "tile").cogroup(whole.groupBy("h", "tile")).applyInArrow(across, "h bigint, root bigint, node bigint, n bigint")
    return found.unionByName(far).distinct()


def forest(sets: list[np.ndarray], roots: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links (root, root) that connect what the points of each group (two lists of places) connect.

    Pairs that the links found so far connect aren't compared.
    """
    up: dict[int, int] = {}
    links: list[tuple[int, int]] = []

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def meet(i: int, j: int) -> None:
        x, y = top(int(roots[i])), top(int(roots[j]))
        if x == y:
            return
        a, b = sets[i], sets[j]
        if len(a) > len(b):
            a, b = b, a
        if not len(a) or 100 * len(a) < percent * len(b):
            return
        at = np.searchsorted(b, a)
        both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
        if 100 * both >= percent * (len(a) + len(b) - both):
            up[max(x, y)] = min(x, y)
            links.append((min(x, y), max(x, y)))

    for left, right in groups:
        own = np.unique(np.concatenate([left, right]))
        if len(own) < 2:
            continue
        n = np.array([len(sets[k]) for k in own], np.int64)
        vecs = np.stack([np.bincount((sets[k] & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS) for k in own])
        if len(own) <= LEAF:
            i, j = _pairs_within(np.zeros(1, np.int64), np.array([len(own)]))
            fits = _bounded(vecs, n, i, j, percent)
            for a, b in zip(own[i[fits]], own[j[fits]]):
                meet(a, b)
            continue
        # Neighbours in the tree's order first, which joins most copies.
        order = own[RTree(vecs, n, roots[own]).rows]
        for a, b in zip(order, order[1:]):
            meet(a, b)
        now = np.array([top(int(x)) for x in roots[own]])
        if (now == now[0]).all():
            continue
        sides = [np.searchsorted(own, x) for x in (left, right)]
        trees = [RTree(vecs[x], n[x], now[x]) for x in sides[: 1 if left is right else 2]]
        i, j = search(trees[0], trees[-1], percent)
        # Those that could share most first.
        i, j = sides[0][i], sides[1][j]
        if left is right:
            i, j = i[i < j], j[i < j]
        for a, b in zip(own[i], own[j]):
            meet(a, b)
    return links


def _sides(table: pa.Table, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows of each group (t1, t2) that are of t1 and that are of t2."""
    own, t1, t2 = (table.column(c).to_numpy() for c in ("own", "t1", "t2"))
    out = []
    for start, end in zip(starts, np.append(starts[1:], len(own))):
        at = np.arange(start, end)
        out.append((at, at) if t1[start] == t2[start] else (at[own[at] == t1[start]], at[own[at] == t2[start]]))
    return out


def _linked(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between roots, a forest for each (t1, t2) of rows (t1, t2, own, root, node)."""
    b = sets.join(bounded(rows), "node").select("t1", "t2", "own", "root", "s")

    def link(batches):
        for table, starts in _whole_groups(batches, 2):
            points = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("s").combine_chunks()]
            links = forest(points, table.column("root").to_numpy(), _sides(table, starts), percent)
            found = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return b.repartition("t1", "t2").sortWithinPartitions("t1", "t2").mapInArrow(link, "a bigint, b bigint").distinct()


def _apart(rows: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """(t1, t2, own, root, node): points of blocks (h, tiles, root, node, n, cell) with a possible
    partner of another root, and the two cells (t1 <= t2) that such pairs are of."""
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("bigint")
    b = rows.withColumn("own", tile).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles").cast("bigint") - 1)))
    b = b.select("h", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"), "own", "root", "node", "n", "cell")
    b = b.join(vectors, "node").select("h", "t1", "t2", "own", "root", "node", "n", "cell", "vec")

    def search_all(batches):
        for table, starts in _whole_groups(batches, 3):
            root, node, n, cell = (table.column(c).to_numpy() for c in ("root", "node", "n", "cell"))
            vecs = _counts(table.column("vec").to_pylist(), n)
            for left, right in _sides(table, starts):
                if not len(left) or not len(right):
                    continue
                trees = [RTree(vecs[x], n[x], root[x]) for x in (left, right)[: 1 if left is right else 2]]
                i, j = search(trees[0], trees[-1], percent)
                i, j = left[i], right[j]
                ends = np.sort(np.stack([cell[i], cell[j]]), axis=0)
                found = [np.stack([*ends, cell[k], root[k], node[k]], 1) for k in (i, j)]
                found = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.T.copy()], ["t1", "t2", "own", "root", "node"])

    kind = "t1 bigint, t2 bigint, own bigint, root bigint, node bigint"
    return b.repartition("h", "t1", "t2").sortWithinPartitions("h", "t1", "t2").mapInArrow(search_all, kind).distinct()


def _once(blocks: DataFrame, value: str) -> DataFrame:
    """The blocks in which `value` differs, those of the same values once, with the tiles that they are dealt to."""
    seen = blocks.groupBy("h").agg(
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("m"),
        F.bit_xor(F.xxhash64(value)).alias("sig"), F.bit_xor(F.xxhash64(F.lit(7), value)).alias("sig2"),
    )
    seen = seen.where("lo <> hi").groupBy("m", "lo", "hi", "sig", "sig2").agg(F.min("h").alias("h"))
    return blocks.join(seen.select("h", F.ceil(F.col("m") / BLOCK_TILE).cast("int").alias("tiles")), "h")


def _renamed(rows: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """`rows` with the roots that the links lead to."""
    found = components(links, scratch).select(F.col("node").alias("root"), F.col("root").alias("_new"))
    return rows.join(found, "root", "left").withColumn("root", F.coalesce("_new", "root")).drop("_new")


def join_components(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """Per row of `docs`: doc_id, _k1, _k2, n_shingles, component_id.  Links are found only as far as components need them."""
    scratch = Scratch(docs.sparkSession)
    pts = scratch.settle(points(docs, frequent_shingles(docs, size), percent, size).withColumn("node", F.monotonically_increasing_id()))
    # Equal sets are one node, the least; only sets that stand for others are joined.
    same = pts.where("n > 0").groupBy("f1", "f2").agg(F.min("node").alias("rep"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c"))
    same = scratch.settle(same.where("c > 1").drop("c"))
    named = pts.where("n > 0").select("doc_id", "_k1", "_k2", "n", "node", "f1", "f2").join(bounded(same), ["f1", "f2"], "left")
    least = F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    named = scratch.settle(named.withColumn("least", least).withColumn("rep", F.coalesce("rep", "node")).drop("f1", "f2"))
    own = pts.where("n > 0").join(bounded(named.where("node <> rep").select("node")), "node", "left_anti")
    posts = own.select(F.explode("prefix").alias("h"), "node", "n").repartition("h")
    blocks = scratch.settle(_once(posts, "node").withColumn("root", F.col("node")))
    # Most blocks are of the same few documents, which share a line, and most of
    # those documents are too different: the trees leave what has a possible partner.
    vectors = pts.select("node", "vec")
    live = scratch.settle(_possible(blocks, vectors, scratch, percent))
    scratch.drop(blocks)

    wanted = live.select("node").distinct().join(named.where("node = rep").select("node", "doc_id", "_k1", "_k2"), "node")
    wanted = bounded(scratch.settle(wanted))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(F.col("text")), "text").alias("d")
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"w.{c}")) for c in ("doc_id", "_k1", "_k2")]

    def full(batches):
        for batch in batches:
            sets = pa.array([s.tobytes() for s in sets_of(batch.column(1), size)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["node", "s"])

    sets = scratch.settle(keyed.join(wanted.alias("w"), on).select("w.node", "d.text").mapInArrow(full, "node bigint, s binary"))

    # Every point in its cell.
    of = live.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("size"))
    of = of.select("h", "m", F.ceil(F.greatest(F.col("m") / TILE, 8 * F.col("size") / BYTES)).cast("int").alias("cells"))
    home = live.join(of, "h").groupBy("node", "root").agg(F.max(F.struct("m", "h", "cells")).alias("b"))
    cell = F.xxhash64("b.h", F.pmod(F.xxhash64("node"), F.col("b.cells")))
    home = scratch.settle(home.select("node", "root", F.col("b.h").alias("home"), F.col("b.cells").alias("cells"), cell.alias("cell")))
    rows = home.select(*(F.col("cell").alias(c) for c in ("t1", "t2", "own")), "root", "node")
    labels = scratch.settle(_renamed(home.select("node", "root"), scratch.settle(_linked(rows, sets, percent)), scratch))
    if not home.where("cells > 1").isEmpty():
        # Of homes with several cells, one point for each cluster, the one that names it.
        heads = home.where("cells > 1").select("home", "cells", "node").join(labels, "node").groupBy("home", "root").agg(F.max("cells").alias("cells"))
        own = F.xxhash64("home", F.pmod(F.xxhash64("root"), F.ceil(F.col("cells") / TILE)))
        heads = heads.select(*(own.alias(c) for c in ("t1", "t2", "own")), "root", F.col("root").alias("node"))
        labels = scratch.settle(_renamed(labels, scratch.settle(_linked(scratch.settle(heads), sets, percent)), scratch))

    # What could still link two clusters.
    several = live.drop("root").join(labels, "node").groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    left = live.drop("root").join(several.where("lo <> hi").select("h"), "h", "left_semi").join(labels, "node")
    left = scratch.settle(_once(left, "node").join(home.select("node", "cell"), "node"))
    rows = scratch.settle(_apart(left, vectors, percent))
    labels = scratch.settle(_renamed(labels, scratch.settle(_linked(rows, sets, percent)), scratch))

    # Clusters of different sets, then the least id of any member.
    tops = named.select("rep", "least").distinct().join(labels.withColumnRenamed("node", "rep"), "rep")
    tops = tops.groupBy("root").agg(F.min("least").alias("component_id"))
    by_rep = labels.join(tops, "root").select(F.col("node").alias("rep"), "component_id")
    linked = named.join(by_rep, "rep", "left").select(
        "doc_id", "_k1", "_k2", F.col("n").alias("n_shingles"), F.coalesce("component_id", "least").alias("component_id")
    )
    empty = pts.where("n = 0").select("doc_id", "_k1", "_k2", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    found = scratch.settle(linked.unionByName(empty))
    scratch.close(found)
    return found


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return join_components(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """`docs` with one document of each component, that with the least id; the same columns.

    Documents without words are kept, and those without an id if no other of their
    component has one.  Of rows with the same id and text one is kept.
    """
    found = join_components(docs, percent)
    kept = found.where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select("doc_id", "_k1", "_k2").distinct()
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("doc_id", "_k1", "_k2")]
    own = packed(docs).alias("d").join(kept.alias("k"), on, "left_semi")
    return unpacked(own.dropDuplicates(["doc_id", "_k1", "_k2"]), docs.columns)
