"""N-gram Jaccard self-join by a MinHash LSH forest, verified exactly.

1. *Sketch.* Each text's set of word shingles gives ``trees`` signatures of ``max_depth`` MinHash values, one for each
   trie of the forest. A trie keeps the hash of a signature's first ``floor`` values and one byte of each deeper value.
   ``floor`` is the depth to which prefixes may be shortened: the longest at which a pair right at the threshold
   meets in some trie with the target probability.
2. *Copies.* Texts with one shingle set become one node, so copies are never expanded into pairs.
3. *Subtrees.* Nodes under one prefix of ``floor`` values are linked to the smallest of them; components of these
   stars hold every candidate pair.
4. *Descent.* A component of bounded size is one unit of work, many small ones together. Of a larger one, each subtree
   is a unit; a subtree beyond the bounds is cut into hashed blocks, and each pair of blocks is a unit. A unit sorts
   the signatures of each trie and takes the pairs with the longest common prefix first. Links found so far give, for
   each item, the recall that its present prefix length reaches: a link of similarity s is met with probability
   1 - (1 - s ** depth) ** trees, and one more link right at the threshold is assumed unseen. The prefix of an item is
   shortened by one value at a time until that recall reaches the target; a pair is met while either item goes on.
5. *Verification.* Sets of candidate pairs are intersected. A unit returns one row per node: the number of its links
   and a neighbour that spans its local class. No pair becomes a row.
6. *Classes.* Components of the spanning links.
7. *Counts.* In classes of three nodes and more, the sets of all members are intersected, block by block, so that a link
   that met in no trie is counted too and the number of links of a node does not depend on the units of the descent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.components import connected_components
from quarryline.llm.textnp import BASE, mixed, shingle_hashes, slices
from quarryline.runtime import written


#: Ids up to which they are broadcast (8 bytes each); beyond, texts are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def met(similarity, depth, trees: int):
    """The probability that a pair shares a prefix of ``depth`` values in one of ``trees`` tries."""
    return 1 - (1 - similarity**depth) ** trees


def match_depth(threshold: float, trees: int, max_depth: int, target: float) -> int:
    """The longest prefix at which a pair at the threshold is met with probability ``target``; 1 at least."""
    depth = max_depth
    while depth > 1 and met(threshold, depth, trees) < target:
        depth -= 1
    return depth


def distinct_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted shingle set of each text."""
    hashes, counts = shingle_hashes(texts, n)
    ends = np.cumsum(counts)
    return [np.unique(hashes[e - c : e]) for e, c in zip(ends, counts, strict=True)]


def signatures(sets: list[np.ndarray], trees: int, floor: int, max_depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(sets x trees) hashes of the first ``floor`` values and (sets x trees x rest) a byte of each deeper value.

    The sets must not be empty. Two deeper values agree by chance in one of 256 cases, which costs a needless
    comparison and loses nothing.
    """
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    seeds = mixed(np.arange(1, 2 * trees * max_depth + 1, dtype=np.uint64))
    keys, tails = np.zeros((len(sets), trees), np.uint64), np.zeros((len(sets), trees, max_depth - floor), np.uint8)
    for t in range(trees):
        for d in range(max_depth):
            k = t * max_depth + d
            salt, factor = np.uint32(seeds[2 * k] & np.uint64(0xFFFFFFFF)), np.uint32((seeds[2 * k + 1] & np.uint64(0xFFFFFFFF)) | np.uint64(1))
            least = np.minimum.reduceat((low ^ salt) * factor, starts)
            if d < floor:
                keys[:, t] = mixed(keys[:, t] * np.uint64(BASE) + least + np.uint64(d))
            else:
                tails[:, t, d - floor] = mixed(least.astype(np.uint64)) >> np.uint64(56)
    return keys, tails


def sketch(docs: DataFrame, n: int, trees: int, floor: int, max_depth: int) -> DataFrame:
    """(doc_id, set_a, set_b, n_shingles, keys, tails); keys and tails are empty for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, 1 << 20):
                sets = distinct_sets(texts[a:b], n)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list[list[int]] = [[] for _ in sets]
                tails = [b""] * len(sets)
                if full:
                    prefixes, rest = signatures([sets[i] for i in full], trees, floor, max_depth)
                    for i, row, tail in zip(full, prefixes.view(np.int64), rest, strict=True):
                        keys[i], tails[i] = row, tail.tobytes()
                one = np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                two = np.array([mixed(s ^ np.uint64(BASE)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                size = np.array([len(s) for s in sets], np.int32)
                columns = [ids.slice(a, b - a), pa.array(one), pa.array(two), pa.array(size), pa.array(keys, pa.list_(pa.int64())), pa.array(tails, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "set_a", "set_b", "n_shingles", "keys", "tails"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, set_a long, set_b long, n_shingles int, keys array<long>, tails binary")


def shingle_sets(rows: DataFrame, n: int) -> DataFrame:
    """The columns of ``rows`` with ``text`` replaced by ``shingles``, the bytes of its sorted set."""
    names = [c for c in rows.columns if c != "text"]
    schema = rows.select(*names).schema.add("shingles", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(len(names)).to_pylist()]
            for a, b in slices(texts, 1 << 20):
                sets = [s.tobytes() for s in distinct_sets(texts[a:b], n)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(names))), pa.array(sets, pa.binary())], names=[*names, "shingles"])

    return rows.select(*names, "text").mapInArrow(run, schema)


def common_depth(keys: np.ndarray, tails: np.ndarray, a: int, others: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Which tries ``a`` shares with each of ``others``, and the longest prefix that they share in one of them."""
    same = keys[others] == keys[a]
    deeper = np.cumprod(tails[others] == tails[a], axis=2, dtype=np.int8).sum(2)
    return same, np.where(same, floor + deeper, 0).max(1)


class Classes:
    """Disjoint sets of positions; the root of each is the one with the smallest name."""

    def __init__(self, names: np.ndarray) -> None:
        self.names, self.parent = names, list(range(len(names)))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        x, y = self.root(i), self.root(j)
        if x != y:
            low, high = (x, y) if self.names[x] < self.names[y] else (y, x)
            self.parent[high] = low


def linked(
    nodes: np.ndarray, copies: np.ndarray, keys: np.ndarray, tails: np.ndarray, sets: list[np.ndarray], groups: list[tuple[int, np.ndarray]], sides: np.ndarray | None, threshold: float, target: float, floor: int
) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of linked documents and a spanning neighbour (as a position) of each node of a unit, and the pairs met.

    ``groups`` are (tree, positions) that share a subtree; tree -1 takes a pair whichever trie it meets in, any
    other only the pairs that meet there first, so that units do not count a pair twice. With ``sides`` only
    pairs across the two sides count.
    """
    trees, max_depth = keys.shape[1], floor + tails.shape[2]
    depths = np.arange(floor, max_depth + 1)
    unseen = 1 - met(threshold, depths, trees)
    size = np.array([len(s) for s in sets], np.int64)
    value, ids = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(size) - size
    candidates: dict[int, list[np.ndarray]] = {}
    for tree, at in groups:
        for i, a in enumerate(at[:-1]):
            candidates.setdefault(int(a), []).append(at[i + 1 :])
    # Pairs by the length of their longest common prefix.
    levels: list[list[tuple[int, np.ndarray]]] = [[] for _ in depths]
    only = next((t for t, _ in groups if t >= 0), -1)
    for a, found in candidates.items():
        others = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
        if sides is not None:
            others = others[sides[others] != sides[a]]
        # A pair cannot reach the threshold if one set is too small for the other.
        others = others[np.minimum(size[others], size[a]) >= threshold * np.maximum(size[others], size[a]) - 1e-9]
        for k in range(0, len(others), 1024):
            some = others[k : k + 1024]
            same, depth = common_depth(keys, tails, a, some, floor)
            if only >= 0:
                first = same.argmax(1) == only
                some, depth = some[first], depth[first]
            for d in np.unique(depth):
                levels[d - floor].append((a, some[depth == d]))

    n_links, n_met = np.zeros(len(nodes), np.int64), 0
    links, missed, open_ = np.zeros(len(nodes)), np.zeros((len(depths), len(nodes))), np.ones(len(nodes), bool)
    classes = Classes(nodes)
    flag = np.zeros(len(value), np.int32)
    for level in range(len(depths) - 1, -1, -1):
        for a, others in levels[level]:
            others = others if open_[a] else others[open_[others]]
            if not len(others):
                continue
            n_met += len(others)
            own = ids[start[a] : start[a] + size[a]]
            flag[own] = 1
            for k in range(0, len(others), 256):
                some = others[k : k + 256]
                sums = np.cumsum(size[some]) - size[some]
                at = np.repeat(start[some] - sums, size[some]) + np.arange(int(size[some].sum()))
                both = np.add.reduceat(flag[ids[at]], sums)
                whole = size[a] + size[some] - both
                close = both >= threshold * whole - 1e-9
                near = some[close]
                if len(near):
                    chance = met((both[close] / whole[close])[None], depths[:, None], trees)
                    lost = 1 / chance - 1
                    missed[:, a] += lost.sum(1)
                    missed[:, near] += lost
                    links[a] += len(near)
                    links[near] += 1
                    n_links[a] += copies[near].sum()
                    n_links[near] += copies[a]
                    for b in near:
                        classes.join(a, int(b))
            flag[own] = 0
        # Expected share of an item's links that prefixes of this length have met.
        open_ &= links < target * (links + missed[level] + unseen[level])
    return n_links, np.array([classes.root(i) for i in range(len(nodes))], np.int64), n_met


def verify_unit(table: pa.Table, threshold: float, target: float, floor: int) -> pa.Table:
    """Rows (unit, node, copies, keys, tails, tree, side, shingles) of one unit to rows (node, other, n_links)."""
    all_nodes = table.column("node").to_numpy()
    nodes, first, back = np.unique(all_nodes, return_index=True, return_inverse=True)
    trees = len(table.column("keys")[0])
    keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(all_nodes), -1)[first]
    take = lambda name: table.column(name).take(pa.array(first))
    copies = take("copies").to_numpy()
    tails = take("tails").to_pylist()
    tails = np.frombuffer(b"".join(tails), np.uint8).reshape(len(nodes), trees, len(tails[0]) // trees)
    sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in take("shingles")]
    tree, side = table.column("tree").to_numpy(), table.column("side").to_numpy()[first]
    groups: list[tuple[int, np.ndarray]] = []
    for t in np.unique(tree):
        at = np.unique(back[tree == t])
        for k in range(trees) if t < 0 else [int(t)]:
            # The trie in sorted order; equal keys are one subtree.
            order = at[np.lexsort((*tails[at, k].T[::-1], keys[at, k]))]
            cut = np.flatnonzero(np.diff(keys[order, k])) + 1
            groups += [(int(t), np.sort(g)) for g in np.split(order, cut) if len(g) > 1]
    # Units of several tries do not share pairs, so each trie's are met by themselves.
    parts = [linked(nodes, copies, keys, tails, sets, [g for g in groups if g[0] == t], side if (side >= 0).any() else None, threshold, target, floor) for t in sorted({g[0] for g in groups})]
    n = sum((p[0] for p in parts), np.zeros(len(nodes), np.int64))
    classes = Classes(nodes)
    for _, root, _ in parts:
        for i, r in enumerate(root):
            classes.join(i, int(r))
    root = np.array([classes.root(i) for i in range(len(nodes))], np.int64)
    some = n > 0
    return pa.table({"node": nodes[some], "other": nodes[root[some]], "n_links": n[some]}, schema=pa.schema([("node", pa.int64()), ("other", pa.int64()), ("n_links", pa.int64())]))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each of ``left`` shares with each of ``right`` (sorted sets), exactly.

    Only elements of both sides count, some thousands at a time: products of 0 and 1 matrices, whose sums of at most
    4,096 are exact in single precision.
    """
    out = np.zeros((len(left), len(right)), np.int64)
    if not len(left) or not len(right):
        return out
    one, two = np.concatenate(left), np.concatenate(right)
    row = np.repeat(np.arange(len(left)), [len(s) for s in left])
    col = np.repeat(np.arange(len(right)), [len(s) for s in right])
    shared = np.intersect1d(one, two)
    if right is left:
        # What only one set holds meets nothing but itself.
        value, n = np.unique(one, return_counts=True)
        shared = value[n > 1]
        out[np.arange(len(left)), np.arange(len(left))] = [len(s) for s in left]
    at_one, at_two = np.searchsorted(shared, one), np.searchsorted(shared, two)
    in_one, in_two = at_one < len(shared), at_two < len(shared)
    in_one[in_one] = shared[at_one[in_one]] == one[in_one]
    in_two[in_two] = shared[at_two[in_two]] == two[in_two]
    row, at_one, col, at_two = row[in_one], at_one[in_one], col[in_two], at_two[in_two]
    by_one, by_two = np.argsort(at_one, kind="stable"), np.argsort(at_two, kind="stable")
    row, at_one, col, at_two = row[by_one], at_one[by_one], col[by_two], at_two[by_two]
    sums = np.zeros(out.shape, np.int64)
    for k in range(0, len(shared), 4096):
        a, b = np.searchsorted(at_one, [k, k + 4096])
        c, d = np.searchsorted(at_two, [k, k + 4096])
        wide = min(4096, len(shared) - k)
        x, y = np.zeros((len(left), wide), np.float32), np.zeros((len(right), wide), np.float32)
        x[row[a:b], at_one[a:b] - k] = 1
        y[col[c:d], at_two[c:d] - k] = 1
        sums += (x @ y.T).astype(np.int64)
    return np.maximum(out, sums)


def count_links(table: pa.Table, threshold: float) -> pa.Table:
    """Rows (node, class_id, copies, side, shingles) of one unit to rows (node, others): the documents linked to a node
    among the members of its class, or across the two sides of a pair of blocks."""
    node, klass, copies, side = (table.column(c).to_numpy() for c in ("node", "class_id", "copies", "side"))
    sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in table.column("shingles")]
    size = np.array([len(s) for s in sets], np.int64)
    n = np.zeros(len(node), np.int64)
    order = np.argsort(klass, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(klass[order])) + 1):
        within = side[at[0]] < 0
        left = at if within else at[side[at] == side[at].min()]
        right = at if within else at[side[at] != side[at].min()]
        mine = [sets[i] for i in left]
        both = overlaps(mine, mine if within else [sets[i] for i in right])
        close = both >= threshold * (size[left][:, None] + size[right][None] - both) - 1e-9
        if within:
            np.fill_diagonal(close, False)
        n[left] += close @ copies[right]
        if not within:
            n[right] += close.T @ copies[left]
    return pa.table({"node": node, "others": n}, schema=pa.schema([("node", pa.int64()), ("others", pa.int64())]))


def class_links(known: DataFrame, members: DataFrame, n: int, threshold: float, block: int, unit_shingles: int) -> DataFrame:
    """(node, others) of the ``members`` (node, class_id, copies, n_shingles) of classes of three nodes and more.

    Small classes are packed into units; a class beyond ``block`` nodes or ``unit_shingles`` shingles is cut into hashed
    blocks, and each pair of blocks is a unit.
    """
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("mass")).where("size > 2")
    members = written(members.join(sizes, "class_id"), "forest-members")
    n_members, all_mass = members.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    packs = 1 + max(n_members // block, all_mass // unit_shingles)
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("mass") / unit_shingles)).cast("int")
    cut = members.select("node", "class_id", blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    small = cut.where("blocks = 1").select("node", F.pmod(F.xxhash64("class_id"), F.lit(packs)).alias("unit"), F.lit(-1).alias("low"), F.lit(-1).alias("high"), F.lit(-1).alias("side"))
    large = cut.where("blocks > 1").withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "mate"), F.greatest("own", "mate")
    large = large.select("node", F.col("class_id").alias("unit"), low.alias("low"), high.alias("high"), F.when(low == high, -1).otherwise(F.col("own")).alias("side"))
    if n_members <= BROADCAST_ROWS:
        known = known.join(F.broadcast(members.select(F.col("node").alias("doc_id"))), "doc_id", "left_semi")
    wanted = members.select("node", "class_id", "copies")
    texts = known.select(F.col("doc_id").alias("node"), "text").join(wanted, "node").dropDuplicates(["node"])
    units = shingle_sets(texts.select("node", "class_id", "copies", "text"), n).join(small.unionByName(large), "node")
    counted = units.groupBy("unit", "low", "high").applyInArrow(lambda table: count_links(table, threshold), "node long, others long")
    return counted.groupBy("node").agg(F.sum("others").alias("others"))


def jaccard_classes(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, trees: int = 20, max_depth: int = 8, target: float = 0.9999, block: int = 1000, unit_shingles: int = 1 << 20, exact_counts: bool = True
) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, rep_id, n_shingles.

    Two documents are linked if the sets of their ``n``-word shingles (lower-case runs of letters, digits and
    underscores) have a Jaccard similarity of ``threshold`` or more. ``n_links`` counts all other linked
    documents of the class, copies included (without ``exact_counts`` those that the forest met, which ``target``
    bounds from below and which ``block`` may change); ``rep_id`` is the smallest doc_id with the same set; ``class_id`` is the
    smallest doc_id that chains of links reach. A text of fewer than ``n`` words has one shingle of all its
    words. Null and empty texts, and those without words, link to nothing. A repeated row
    counts as a copy. Rows without doc_id take no part: their class_id and rep_id are null; ids must be integers. An
    empty table gives no rows; other columns are ignored. A unit of work aims at ``block`` nodes and
    ``unit_shingles`` shingles (8 bytes each).
    """
    floor = match_depth(threshold, trees, max_depth, target)
    known = docs.where(F.col("doc_id").isNotNull())
    sketches = written(sketch(known, n, trees, floor, max_depth), "forest-sketches")
    worded = sketches.where("n_shingles > 0")
    # Copies have one signature, so any of a set's rows has the node's.
    nodes = worded.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"), F.first("tails").alias("tails"), F.first("n_shingles").alias("n_shingles"))
    nodes = written(nodes, "forest-nodes")

    spots = nodes.select("node", "n_shingles", F.posexplode("keys").alias("tree", "key"))
    shared = spots.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("weight"), F.min("node").alias("lead")).where("members > 1")
    spots = written(spots.join(shared, ["tree", "key"]), "forest-subtrees")
    near = connected_components(spots.where("node <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v")))
    near = near.join(nodes.select("node", "n_shingles"), "node")
    near = written(near, "forest-candidates")
    sizes = near.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("mass"))
    fits = (F.col("size") <= block) & (F.col("mass") <= unit_shingles)
    near = near.join(sizes, "component").withColumn("fits", fits)
    n_near, all_mass = near.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    packs = 1 + max(n_near // block, all_mass // unit_shingles)

    small = near.where("fits").select("node", F.pmod(F.xxhash64("component"), F.lit(packs)).alias("unit"), F.lit(-1).alias("tree"), F.lit(-1).alias("side"))
    # In large components each subtree is met on its own, in blocks if it is large itself.
    large = spots.join(near.where(~F.col("fits")).select("node"), "node", "left_semi")
    blocks = F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("weight") / unit_shingles))
    large = large.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    whole = large.where("blocks = 1").select("node", (F.pmod(F.xxhash64("tree", "key"), F.lit(16 * packs)) + packs).alias("unit"), "tree", F.lit(-1).alias("side"))
    pairs = large.where("blocks > 1").withColumn("mate", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    low, high = F.least("own", "mate"), F.greatest("own", "mate")
    pairs = pairs.select("node", (F.shiftrightunsigned(F.xxhash64("tree", "key", low, high), 2) + 17 * packs).alias("unit"), "tree", F.when(low == high, -1).otherwise(F.col("own")).alias("side"))
    meetings = small.unionByName(whole).unionByName(pairs)

    # Most texts meet nothing: where the ids of those that do are few, the others stay where they are.
    known = known.withColumn("doc_id", F.col("doc_id").cast("long"))
    if n_near <= BROADCAST_ROWS:
        known = known.join(F.broadcast(near.select(F.col("node").alias("doc_id"))), "doc_id", "left_semi")
    wanted = near.select("node").join(nodes.select("node", "keys", "tails", "copies"), "node")
    texts = known.select(F.col("doc_id").cast("long").alias("node"), "text").join(wanted, "node").dropDuplicates(["node"])
    sets = shingle_sets(texts.select("node", "copies", "keys", "tails", "text"), n)
    units = sets.join(meetings, "node").select("unit", "node", "copies", "keys", "tails", "tree", "side", "shingles")
    links = written(units.groupBy("unit").applyInArrow(lambda table: verify_unit(table, threshold, target, floor), "node long, other long, n_links long"), "forest-links")

    classes = connected_components(links.where("node <> other").select(F.col("node").alias("u"), F.col("other").alias("v"))).withColumnRenamed("component", "class_id")
    counts = links.groupBy("node").agg(F.sum("n_links").alias("others"))
    if exact_counts:
        classes = written(classes, "forest-classes")
        exact = class_links(known, classes.join(nodes.select("node", "copies", "n_shingles"), "node"), n, threshold, block, unit_shingles)
        counts = counts.join(exact.withColumnRenamed("others", "exact"), "node", "left").select("node", F.coalesce("exact", "others").alias("others"))
    nodes = nodes.select("set_a", "set_b", F.col("node"), "copies").join(counts, "node", "left").join(classes, "node", "left")
    rows = sketches.join(nodes, ["set_a", "set_b"], "left")
    empty = F.col("n_shingles") == 0
    out = rows.select(
        "doc_id",
        F.when(empty, F.col("doc_id")).otherwise(F.coalesce("class_id", "node")).alias("class_id"),
        F.when(empty, F.lit(0)).otherwise(F.col("copies") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("node")).alias("rep_id"),
        "n_shingles",
    )
    null = F.lit(None).cast("long")
    unknown = docs.where(F.col("doc_id").isNull()).select(null.alias("doc_id"), null.alias("class_id"), F.lit(0).cast("long").alias("n_links"), null.alias("rep_id"), F.lit(0).alias("n_shingles"))
    return out.unionByName(unknown)
