"""Near-duplicates by an LSH forest: MinHash signatures in several sorted orders.

1. Sketch. Every text becomes its shingle set's MinHash signature (HASHES functions, a byte of each kept)
   and, per tree, a key of the tree's first levels (`depth` functions, whole hashes). Equal sets go on
   as one.
2. Forest. A tree is an order of all signatures: by its key, then by the signature's other bytes in the
   tree's own rotation. A region is a run of equal keys. Inside a region, rows whose signatures agree well
   enough are joined; only a spanning star of each joined set leaves the task. All rows of a dense region
   (more than REGION rows) are joined as they are. Range partitioning by the whole order spreads a dense
   region over tasks; the parts of a region that lies over several tasks are joined by its key.
3. Clusters. Connected candidates are a cluster, almost always a few documents.
4. Confirmation. Each text of a cluster is shipped once to its cluster, and links are confirmed on full
   shingle sets, whole cluster at a time. A cluster above CLUSTER_SHINGLES is confirmed in two passes: in
   blocks along every tree's order, which joins most of what belongs together, and then in all pairs of
   blocks that can hold a link between texts not joined yet. So each pair of a cluster is compared or
   joined already, at any size of the cluster.

How likely a link is to be missed by all trees follows from `depth`: (1 - s ** depth) ** TREES for
similarity s, chosen to be below 1 in 50,000 at the threshold and vanishing above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from paperloom.llm.common import give_back, mix, parts_for, settle, slices
from paperloom.llm.shingles import shingle_sets
from paperloom.operators.graph import connected

HASHES, TREES = 64, 16
MISSED = 2e-5
REGION = 2048
CLUSTER_SHINGLES = 4_000_000
BLOCK_ROWS = 4096
#: Shingles a confirming task holds at a time.
BUCKET_SHINGLES = 500_000
BITMAP_WORDS = 1 << 19

_XOR = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_MUL = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)


def depth_for(percent: int) -> int:
    """The deepest common prefix to ask for that still finds a pair at the threshold."""
    depth = 1
    while (1 - (percent / 100) ** (depth + 1)) ** TREES <= MISSED and depth < HASHES // TREES:
        depth += 1
    return depth


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set (not empty)."""
    least = np.full(HASHES, np.uint64(2**64 - 1))
    for i in range(0, len(shingles), 2048):
        some = shingles[i : i + 2048]
        np.minimum(least, ((some[None, :] ^ _XOR[:, None]) * _MUL[:, None]).min(1), out=least)
    return mix(least)


def sketch(docs: DataFrame, key: str, text: str, depth: int) -> DataFrame:
    """Rows (key, n_shingles, set_id, regions, bytes); the last three are null for an empty set."""
    levels = HASHES // TREES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            give_back()
            for batch in slices(whole, "text", 1 << 20):
                sizes, sets, regions, low = [], [], [], []
                for shingles in shingle_sets(batch.column("text")):
                    sizes.append(len(shingles))
                    if not len(shingles):
                        sets.append(None), regions.append(None), low.append(None)
                        continue
                    values = signature(shingles)
                    region = np.arange(1, TREES + 1, dtype=np.uint64)
                    for level in range(depth):
                        region = mix(region + values[level::levels])
                    sets.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                    regions.append(region.view(np.int64))
                    low.append((values & np.uint64(255)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key"),
                        pa.array(sizes, pa.int64()),
                        pa.array(sets, pa.binary()),
                        pa.array(regions, pa.list_(pa.int64())),
                        pa.array(low, pa.binary()),
                    ],
                    ["key", "n_shingles", "set_id", "regions", "low"],
                )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_shingles long, set_id binary, regions array<long>, low binary")


def in_tree_order(rows: DataFrame, *before: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per tree (node, region, path and the columns `before` and `carry`), sorted by `before`, region and
    path."""
    levels = HASHES // TREES
    trees = rows.select(
        *before, *carry, F.col("key").alias("node"), "low", F.posexplode("regions").alias("_tree", "region")
    )
    at = F.col("_tree") * levels
    path = F.concat(F.substr("low", at + 1, F.lit(HASHES)), F.substr("low", F.lit(1), at))
    trees = trees.select(*before, *carry, "node", "region", path.alias("path"), "_tree")
    order = [*before, "region", "path", "node"]
    return trees.repartitionByRange(*order).sortWithinPartitions(*order)


def _turned_back(paths: np.ndarray, trees: np.ndarray) -> np.ndarray:
    """Signatures from their tree's rotation."""
    levels = HASHES // TREES
    places = (np.arange(HASHES)[None, :] - trees[:, None] * levels) % HASHES
    return np.take_along_axis(paths, places, 1)


def link_sets(n: int, related: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """For n items the first item of each one's connected set. `related(i, others)` tells which others
    are linked with i; an item already reached is never asked about again."""
    root = np.full(n, -1)
    rest = np.arange(n)
    while len(rest):
        first, rest = rest[0], rest[1:]
        root[first] = first
        queue = [first]
        while queue and len(rest):
            i = queue.pop()
            hit = related(i, rest)
            reached, rest = rest[hit], rest[~hit]
            root[reached] = first
            queue.extend(reached.tolist())
    return root


def _region_edges(nodes: list, bits: np.ndarray, least: float) -> tuple[list, list]:
    """Spanning star of the rows of one region whose signatures agree in `least` positions or more."""
    root = link_sets(len(nodes), lambda i, others: (bits[others] == bits[i]).sum(1) >= least)
    members = np.flatnonzero(root != np.arange(len(nodes)))
    pairs = [(nodes[i], nodes[root[i]]) for i in members.tolist() if nodes[i] != nodes[root[i]]]
    return [a for a, _ in pairs], [b for _, b in pairs]


def candidate_edges(forest: DataFrame, agreeing: float, region_rows: int = REGION) -> DataFrame:
    """Edges (source, target) between rows of one region of the sorted order `forest` (from `in_tree_order`).

    A region of more than `region_rows` rows, and one that may go on in another task, is joined whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list = []
        regions, paths = np.zeros(0, np.int64), np.zeros((0, HASHES), np.uint8)
        trees = np.zeros(0, np.int64)
        kind = None
        dense = None  # (region, first node) while the rows at hand go on with a region that is joined whole
        first = True

        def regions_of(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal nodes, regions, paths, trees, dense, first
            sources, targets, shared = [], [], []
            begin = 0
            for end in [*(np.flatnonzero(regions[1:] != regions[:-1]) + 1).tolist(), len(nodes)]:
                if begin == end:
                    break
                region, at_end = int(regions[begin]), end == len(nodes)
                if dense is not None and dense[0] != region:
                    dense = None
                if at_end and not last and dense is None and not first and end - begin <= region_rows:
                    break  # the region may go on
                if dense is None and (first or at_end or end - begin > region_rows):
                    dense = region, nodes[begin]
                    if first or at_end:  # other tasks may hold more of it
                        sources.append(nodes[begin]), targets.append(None), shared.append(region)
                if dense is not None:
                    more = [n for n in nodes[begin:end] if n != dense[1]]
                    a, b = more, [dense[1]] * len(more)
                elif end - begin > 1:
                    a, b = _region_edges(nodes[begin:end], _turned_back(paths[begin:end], trees[begin:end]), agreeing)
                else:
                    a, b = [], []
                sources.extend(a)
                targets.extend(b)
                shared.extend([None] * len(a))
                first = False
                begin = end
            nodes, regions, paths, trees = nodes[begin:], regions[begin:], paths[begin:], trees[begin:]
            if sources:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sources, kind), pa.array(targets, kind), pa.array(shared, pa.int64())],
                    ["source", "target", "region"],
                )

        for batch in batches:
            kind = batch.column("node").type
            nodes += batch.column("node").to_pylist()
            regions = np.concatenate([regions, batch.column("region").to_numpy()])
            trees = np.concatenate([trees, batch.column("_tree").to_numpy()])
            joined = b"".join(batch.column("path").to_pylist())
            paths = np.concatenate([paths, np.frombuffer(joined, np.uint8).reshape(-1, HASHES)])
            yield from regions_of(False)
        yield from regions_of(True)

    kind = forest.schema["node"].dataType.simpleString()
    rows = forest.select("node", "region", "path", F.col("_tree").cast("long").alias("_tree"))
    edges = settle(rows.mapInArrow(run, f"source {kind}, target {kind}, region long"))
    parts = edges.filter(F.col("region").isNotNull()).select("region", "source")
    least = parts.groupBy("region").agg(F.min("source").alias("target"))
    over_tasks = parts.join(least, "region").filter(F.col("source") != F.col("target")).select("source", "target")
    return edges.filter(F.col("region").isNull()).select("source", "target").unionByName(over_tasks)


def _confirmed(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """First member of each one's connected set, by exact similarity of shingle sets.

    Shingles are put in order of rarity. Two sets at the threshold share one of the rarest of either: of the
    larger, n, the first n - r + 1 for r the least overlap with any set; of the smaller, likewise with any
    set of its size or more. Only sets that do are compared in full.
    """
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    _, ids, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rarity = np.empty(len(often), np.int64)
    rarity[np.argsort(often, kind="stable")] = np.arange(len(often))
    ids = rarity[ids]
    for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        ids[a : a + n].sort()
    as_larger = sizes + (-percent * sizes) // 100 + 1
    as_smaller = sizes + (-2 * percent * sizes) // (100 + percent) + 1
    marked = np.zeros(len(often), bool)

    def common(own: np.ndarray, others: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How many of the first `counts` shingles of each other set are in `own`."""
        if not len(others):
            return np.zeros(0, np.int64)
        marked[own] = True
        if len(others) < 8:
            found = np.array([marked[ids[a : a + n]].sum() for a, n in zip(starts[others], counts, strict=True)])
        else:
            ends = np.cumsum(counts)
            places = np.arange(ends[-1]) + np.repeat(starts[others] - (ends - counts), counts)
            found = np.add.reduceat(marked[ids[places]], ends - counts, dtype=np.int64)
        marked[own] = False
        return found

    def related(i: int, others: np.ndarray) -> np.ndarray:
        n, own = sizes[i], ids[starts[i] : starts[i] + sizes[i]]
        out = np.zeros(len(others), bool)
        smaller = np.flatnonzero((sizes[others] <= n) & (sizes[others] * 100 >= percent * n))
        larger = np.flatnonzero((sizes[others] > n) & (n * 100 >= percent * sizes[others]))
        hit = common(own[: as_larger[i]], others[smaller], as_smaller[others[smaller]]) > 0
        also = common(own[: as_smaller[i]], others[larger], as_larger[others[larger]]) > 0
        at = np.concatenate([smaller[hit], larger[also]])
        asked = others[at]
        both = common(own, asked, sizes[asked])
        out[at] = 100 * both >= percent * (n + sizes[asked] - both)
        return out

    return link_sets(len(sets), related)


def confirm(texts: DataFrame, percent: int) -> DataFrame:
    """Rows (node, root) from (bucket, block, node, text): links inside each block, as a star."""

    def run(batch: pa.Table) -> pa.Table:
        give_back()
        order = batch.sort_by([("block", "ascending"), ("node", "ascending")]).combine_chunks()
        blocks, nodes = order.column("block").to_pylist(), order.column("node").to_pylist()
        column, out_node, out_root, begin = order.column("text"), [], [], 0
        for end in range(1, len(blocks) + 1):
            if end < len(blocks) and blocks[end] == blocks[begin]:
                continue
            if end - begin > 1:
                sets = list(shingle_sets(column.slice(begin, end - begin)))
                root = _confirmed(sets, percent)
                out_node += nodes[begin:end]
                out_root += [nodes[begin + r] for r in root.tolist()]
            begin = end
        kind = order.schema.field("node").type
        return pa.table({"node": pa.array(out_node, kind), "root": pa.array(out_root, kind)})

    kind = texts.schema["node"].dataType.simpleString()
    return texts.groupBy("bucket").applyInArrow(run, f"node {kind}, root {kind}")


def _blocks(ordered: DataFrame, block_rows: int, block_shingles: int) -> DataFrame:
    """`ordered` (sorted inside its partitions; columns cluster, run and n_shingles) with a column block: runs of at
    most `block_rows` rows and `block_shingles` shingles (one row at least), each of one cluster and run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held, filled, before = TaskContext.get().partitionId() << 32, -1, 0, 0, None
        for batch in batches:
            out = []
            of = zip(batch.column("cluster").to_pylist(), batch.column("run").to_pylist(), strict=True)
            for now, n in zip(of, batch.column("n_shingles").to_pylist(), strict=True):
                if now != before or held == block_rows or filled + n > block_shingles:
                    block, held, filled, before = block + 1, 0, 0, now
                held += 1
                filled += n
                out.append(part + block)
            yield batch.append_column("block", pa.array(out, pa.int64()))

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema)
    return ordered.mapInArrow(run, f"{ddl}, block long")


def _tree_blocks(members: DataFrame, block_rows: int, block_shingles: int) -> DataFrame:
    """Rows (node, block): blocks along every tree's order of a cluster."""
    ordered = in_tree_order(members, "cluster", carry=("n_shingles",))
    ordered = ordered.select("cluster", "node", "n_shingles", F.lit(0).alias("run"))
    return _blocks(ordered, block_rows, block_shingles).select("node", F.col("block").cast("string").alias("block"))


def _pair_blocks(
    members: DataFrame, joined: DataFrame, percent: int, block_rows: int, block_shingles: int
) -> tuple[DataFrame, int]:
    """Rows (node, block), a block for each pair of blocks of a cluster that can hold a link between texts
    which `joined` (node, root) has not joined; and the shingles in all of them.

    Large joined sets have blocks of their own, so that pairs within one are passed over; all others are in
    order of size, so that pairs of blocks too unlike in size are passed over.
    """
    known = members.select("cluster", F.col("key").alias("node"), "n_shingles").join(joined, "node", "left")
    known = settle(known.withColumn("root", F.coalesce("root", "node")))
    sizes = known.groupBy("root").agg(F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("_all"))
    large = sizes.filter((F.col("_n") > block_rows) | (F.col("_all") > block_shingles))
    large = large.select("root", F.col("root").alias("run"))
    order = ["cluster", "run", "n_shingles", "node"]
    ordered = known.join(large, "root", "left").repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = settle(_blocks(ordered.select("cluster", "node", "n_shingles", "root", "run"), block_rows, block_shingles))
    outline = blocks.groupBy("cluster", "block").agg(
        F.min("n_shingles").alias("least"),
        F.max("n_shingles").alias("most"),
        F.sum("n_shingles").alias("all"),
        F.min("root").alias("low"),
        F.max("root").alias("high"),
    )
    a, b = outline.alias("a"), outline.alias("b")
    pairs = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.block") <= F.col("b.block")))
    alike = (F.col("a.most") * 100 >= percent * F.col("b.least")) & (F.col("b.most") * 100 >= percent * F.col("a.least"))
    joined_already = F.least("a.low", "b.low") == F.greatest("a.high", "b.high")
    pairs = settle(
        pairs.filter(alike & ~joined_already).select(
            F.concat_ws("-", "a.block", "b.block").alias("pair"),
            F.array_distinct(F.array("a.block", "b.block")).alias("_both"),
            (F.col("a.all") + F.when(F.col("a.block") < F.col("b.block"), F.col("b.all")).otherwise(0)).alias("all"),
        )
    )
    rows = blocks.select("node", "block").join(pairs.select("pair", F.explode("_both").alias("block")), "block")
    return rows.select("node", F.col("pair").alias("block")), pairs.agg(F.sum("all")).first()[0] or 0


_WORD, _BITS, _MARK = "__near_word", "__near_bits", "__near_mark"


def _marked(docs: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """`docs` with a column _MARK: true for all rows whose key is in `ids` (one column), and for few others.

    The ids go into a bitmap by their hash. It has BITMAP_WORDS rows of 64 bits at most, which is why it
    can be broadcast at any size of the corpus. While it is sparse it tells most rows apart without a
    shuffle; a full one marks all rows and is still right. Null keys are not marked.
    """
    word = lambda k: F.pmod(F.shiftright(F.xxhash64(k), 6), F.lit(BITMAP_WORDS))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(k), F.lit(64)).cast("int"))
    own = F.col(ids.columns[0])
    bitmap = ids.groupBy(word(own).alias(_WORD)).agg(F.bit_or(bit(own)).alias(_BITS))
    there = F.col(key).isNotNull() & (F.coalesce(F.col(_BITS).bitwiseAND(bit(F.col(key))), F.lit(0)) != 0)
    joined = docs.withColumn(_WORD, word(F.col(key))).join(F.broadcast(bitmap), _WORD, "left")
    return joined.withColumn(_MARK, there).drop(_WORD, _BITS)


def _joined(stars: DataFrame) -> DataFrame:
    """Stars (node, root) that share nodes as one star for each connected set."""
    edges = stars.select(F.col("node").alias("source"), F.col("root").alias("target"))
    return connected(edges).select("node", F.col("cluster").alias("root"))


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    percent: int = 85,
    region_rows: int = REGION,
    cluster_shingles: int = CLUSTER_SHINGLES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per row of `docs`: key, n_shingles, component_id, kept.

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of five-word shingles
    (A-Z lower-cased; fewer words are one shingle). `component_id` is the least key that can be reached
    by links, the document's own included; `kept` is true where that is its own. A text that is null,
    empty or without words has an empty set, is linked with nothing and kept. Rows of one key count as
    one document for links: their links are joined. A row with a null key is linked with nothing, has a
    null component and is not kept. Repeated rows give repeated rows; only the named columns are read.
    """
    sketches = settle(sketch(docs, key, text, depth_for(percent)))
    linkable = sketches.filter(F.col("set_id").isNotNull() & F.col("key").isNotNull())
    classes = settle(linkable.groupBy("set_id").agg(F.min("key").alias("key")))
    unique = linkable.join(classes, ["set_id", "key"])
    # a margin of four to five standard deviations of the agreement at the threshold
    agreeing = HASHES * (percent / 100 - 0.22)
    edges = candidate_edges(in_tree_order(unique), agreeing, region_rows)
    clusters = connected(edges)  # (node, cluster)
    members = settle(
        unique.select("key", "n_shingles", "regions", "low")
        .join(clusters.select(F.col("node").alias("key"), "cluster"), "key")
        .dropDuplicates(["key"])
    )
    weights = members.groupBy("cluster").agg(F.sum("n_shingles").alias("_all"))
    total = weights.agg(F.sum("_all"), F.max("_all")).first()
    oversize = (total[1] or 0) > cluster_shingles
    block_shingles = cluster_shingles // 4  # a pair of blocks is half of what is confirmed whole
    by_cluster = F.concat(F.lit("c"), F.col("cluster").cast("string")).alias("block")
    if oversize:
        large = weights.filter(F.col("_all") > cluster_shingles).select("cluster")
        oversized = settle(members.join(large, "cluster", "left_semi"))
        blocks = _tree_blocks(oversized, block_rows, block_shingles).unionByName(
            members.join(large, "cluster", "left_anti").select(F.col("key").alias("node"), by_cluster)
        )
        blocks = settle(blocks)
    else:
        blocks = members.select(F.col("key").alias("node"), by_cluster)
    rows = docs.select(F.col(key).alias("node"), F.col(text).alias("text"))

    def links(blocks: DataFrame, some: DataFrame, size: int) -> DataFrame:
        buckets = parts_for(size, BUCKET_SHINGLES, 64)
        texts = _marked(rows, "node", some.select("key")).filter(_MARK).join(blocks, "node")
        return settle(confirm(texts.withColumn("bucket", F.pmod(F.xxhash64("block"), F.lit(buckets))), percent))

    stars = links(blocks, members, (total[0] or 0) * (TREES if oversize else 1))
    if oversize:
        pairs, size = _pair_blocks(oversized, _joined(stars), percent, block_rows, block_shingles)
        if size:
            stars = stars.unionByName(links(pairs, oversized, size))
    shared = linkable.groupBy("key").agg(F.min("set_id").alias("_a"), F.max("set_id").alias("_b"))
    shared = shared.filter(F.col("_a") != F.col("_b")).select("key")
    repeated = not shared.isEmpty()
    if repeated:  # keys with several texts join the links of these
        named = linkable.join(shared, "key").select("set_id", F.col("key").alias("node"))
        named = named.join(classes.withColumnRenamed("key", "root"), "set_id").select("node", "root")
        stars = stars.unionByName(named)
    if oversize or repeated:
        stars = _joined(stars)
    else:
        stars = stars.groupBy("node").agg(F.min("root").alias("root"))
    roots = classes.select("set_id", F.col("key").alias("node")).join(stars, "node", "left")
    roots = roots.select("set_id", F.coalesce("root", "node").alias("_root"))
    component = F.when(F.col("key").isNotNull(), F.coalesce("_root", "key"))
    return (
        sketches.select("key", "n_shingles", "set_id")
        .join(roots, "set_id", "left")
        .select(
            F.col("key").alias(key),
            "n_shingles",
            component.alias("component_id"),
            F.coalesce(component == F.col("key"), F.lit(False)).alias("kept"),
        )
    )




def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component the document of the least key stays.

    Of rows that repeat a key one stays. Rows with a null key cannot be told apart and all stay. Only
    rows that a bitmap of the dropped keys marks are joined with these; the others stay where they are.
    """
    judged = settle(near_duplicates(docs, key, text, percent).select(F.col(key).alias("_id"), "kept").filter("_id IS NOT NULL"))
    dropped = judged.filter(~F.col("kept")).select("_id").distinct()
    marked = _marked(docs, key, dropped)
    unsure = marked.filter(_MARK).join(dropped, F.col(key) == F.col("_id"), "left_anti")
    kept = marked.filter(~F.col(_MARK)).unionByName(unsure).select(docs.columns)
    repeated = judged.filter("kept").groupBy("_id").count().filter("count > 1")
    if repeated.isEmpty():
        return kept
    return kept.filter(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(kept.filter(F.col(key).isNull()))
