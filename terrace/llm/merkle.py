"""Merkle manifest of a table by time-forward processing.

A node's label is its height and its place among the nodes of that height.
The forward sweep meets the nodes in label order: each takes the digests its
children left for it in a queue ordered by label, hashes them and leaves its own
digest for its parent. The reversed sweep meets them in falling order and leaves
each child the proof suffix above it: its siblings' digests, then what its
parent was left.

The sweeps run in bands of ``BAND`` heights. Inside a band a block of
``arity ** BAND`` nodes has a heap for its queue; from band to band the shuffle
is the queue, sorted by (tree, block) and on disk, so a tree of any size needs
the memory of one block a task. A band's digests are a written table, smaller by
the block size than the one below it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import settings, stored

BAND = 10
NODES = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("digest", pa.string()), ("n", pa.int64())])
NODES_DDL = "tree string, place long, digest string, n long"
ABOVE = pa.schema([
    ("tree", pa.string()), ("place", pa.int64()), ("suffix", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
    ("top_place", pa.int64()), ("top_n", pa.int64()),
])
ABOVE_DDL = "tree string, place long, suffix string, subroot string, root string, top_place long, top_n long"
PROVED = pa.schema([
    ("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()),
    ("folded_root", pa.string()), ("verified", pa.bool_()), ("place", pa.int64()), ("tree_leaves", pa.int64()), ("proof_digests", pa.int64()),
])
PROVED_DDL = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, "
    "place long, tree_leaves long, proof_digests long"
)


def joined_hash(digests: Iterable[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def height(n: int, arity: int) -> int:
    """Heights above the leaves of a tree with ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def forward(digests: list[str], levels: int, arity: int) -> list[list[str]]:
    """Digests of all nodes of a block, height by height, from those of its lowest nodes."""
    found = [list(digests)] + [[] for _ in range(levels)]
    queue = [(1, i // arity, i, d) for i, d in enumerate(digests)] if levels else []
    heapq.heapify(queue)
    while queue:
        level, place = queue[0][:2]
        left: list[str] = []
        while queue and queue[0][:2] == (level, place):
            left.append(heapq.heappop(queue)[3])
        digest = joined_hash(left)
        found[level].append(digest)
        if level < levels:
            heapq.heappush(queue, (level + 1, place // arity, place, digest))
    return found


def backward(found: list[list[str]], suffix: str, arity: int) -> list[str]:
    """The proof of each lowest node of a block: siblings on its way up, then ``suffix``."""
    top = len(found) - 1
    proofs = [""] * len(found[0])
    queue = [(-top, 0, suffix)]
    while queue:
        level, place, above = heapq.heappop(queue)
        level, place = -level, -place
        if level == 0:
            proofs[place] = above
            continue
        run = range(place * arity, min((place + 1) * arity, len(found[level - 1])))
        for child in run:
            siblings = "".join(found[level - 1][i] for i in run if i != child)
            heapq.heappush(queue, (1 - level, -child, siblings + above))
    return proofs


def steps(place: int, n: int, arity: int) -> list[tuple[int, int]]:
    """(place in its run, size of the run) on the way from a leaf to the root of its tree."""
    out = []
    while n > 1:
        start = place // arity * arity
        out.append((place - start, min(arity, n - start)))
        place, n = place // arity, -(-n // arity)
    return out


def folded(leaf: str, proof: str, way: list[tuple[int, int]]) -> str:
    """The root that a leaf and its proof give."""
    digest, at = leaf, 0
    for place, size in way:
        others = proof[at:at + 64 * (size - 1)]
        digest = joined_hash((others[:64 * place], digest, others[64 * place:]))
        at += len(others)
    return digest


def leaf_digest(fields: list[Column]) -> Column:
    """Hash of the fields, each ``-`` for null or its UTF-8 length, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0, by ``order`` within its ``tree``) and ``n``, the rows of that tree.

    One range sort; a row's number in its written partition plus one offset for
    each (tree, partition). The last of ``order`` must tell equal rows apart, so
    that copies of one row spread over partitions.
    """
    run = stored(
        rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_row", F.monotonically_increasing_id()), "placed"
    ).withColumn("_part", F.shiftright("_row", 33))
    sums = run.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_first"))
    whole = Window.partitionBy("tree")  # a row for each partition that holds some of the tree
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n"))
    out = run.join(sums, ["tree", "_part"])
    return out.withColumn("place", F.col("_row") + F.col("_shift")).drop("_row", "_part", "_shift")


def _blocks(nodes: DataFrame, width: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / F.lit(width)).cast("long"))


def bands(leaves: DataFrame, arity: int, band: int = BAND) -> list[DataFrame]:
    """The nodes at the foot of each band, as written tables; the last one holds a root for each tree."""
    width = arity ** band

    def raised(block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        n = block["n"][0].as_py()
        found = forward(block["digest"].to_pylist(), min(height(n, arity), band), arity)
        return pa.table([[block["tree"][0].as_py()], [block["block"][0].as_py()], found[-1], [-(-n // width)]], schema=NODES)

    out = [leaves.select("tree", "place", "digest", "n")]
    largest = out[0].agg(F.max("n")).first()[0]
    while True:
        out.append(stored(_blocks(out[-1], width).groupBy("tree", "block").applyInArrow(raised, NODES_DDL), "nodes"))
        if largest is None or largest <= width:
            return out
        largest = -(-largest // width)


def lowered(nodes: DataFrame, above: DataFrame, arity: int, band: int = BAND) -> DataFrame:
    """Proof suffixes of the nodes at the foot of a band, from those of its blocks' roots."""

    def sent(key: tuple, block: pa.Table, over: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        n, size = block["n"][0].as_py(), block.num_rows
        found = forward(block["digest"].to_pylist(), min(height(n, arity), band), arity)
        proofs = backward(found, over["suffix"][0].as_py(), arity)
        same = {c: [over[c][0].as_py()] * size for c in ("tree", "subroot", "root", "top_place", "top_n")}
        return pa.table({**same, "place": block["place"].to_pylist(), "suffix": proofs}, schema=ABOVE)

    blocks = _blocks(nodes, arity ** band).groupBy("tree", "block")
    return blocks.cogroup(above.withColumnRenamed("place", "block").groupBy("tree", "block")).applyInArrow(sent, ABOVE_DDL)


def proved(leaves: DataFrame, above: DataFrame, arity: int, band: int = BAND) -> DataFrame:
    """Every leaf with its proof's hash, and the root folded from what the leaf now shows."""

    def sent(key: tuple, block: pa.Table, over: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        one = {c: over[c][0].as_py() for c in over.column_names}
        n = block["n"][0].as_py()
        leaf, shown, place = (block[c].to_pylist() for c in ("digest", "shown", "place"))
        proofs = backward(forward(leaf, min(height(n, arity), band), arity), one["suffix"], arity)
        up = steps(one["top_place"], one["top_n"], arity)
        roots = [folded(s, p, steps(i, n, arity) + up) for s, p, i in zip(shown, proofs, place, strict=True)]
        return pa.table({
            "doc_id": block["doc_id"], "leaf": leaf, "subroot": [one["subroot"]] * len(leaf), "root": [one["root"]] * len(leaf),
            "proof_sha256": [joined_hash([p]) for p in proofs], "folded_root": roots, "verified": [r == one["root"] for r in roots],
            "place": place, "tree_leaves": [n] * len(leaf), "proof_digests": [len(p) // 64 for p in proofs],
        }, schema=PROVED)

    blocks = _blocks(leaves, arity ** band).groupBy("tree", "block")
    return blocks.cogroup(above.withColumnRenamed("place", "block").groupBy("tree", "block")).applyInArrow(sent, PROVED_DDL)


def manifest(docs: DataFrame, arity: int = 2, tampered: Column | None = None, band: int = BAND) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, lang, n_chars, text): its leaf, proof and check.

    Each lang has a tree over its documents by ascending doc_id, the roots of
    these form a tree by lang (null first, then UTF-8 bytes). Rows where
    ``tampered`` is true are folded from a leaf whose n_chars is one more.

    Nulls are fields of their own (``-``); a null lang is a tree, null doc_ids
    come first in theirs. Rows of one doc_id follow each other by leaf digest;
    equal rows are leaves of their own. Empty texts hash as ``0:``. A lang of one
    document has its leaf as root. An empty table gives no rows. Other columns
    are ignored.
    """
    settings(docs.sparkSession)
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    more = {**fields, "n_chars": F.col("n_chars").cast("decimal(38,0)") + F.lit(1)}
    leaf = leaf_digest(list(fields.values()))
    changed = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf.alias("digest"),
        F.when(changed, leaf_digest(list(more.values()))).alias("shown"),
    )
    rows = stored(rows, "leaves").withColumn("shown", F.coalesce("shown", "digest")).withColumn("_id", F.monotonically_increasing_id())
    leaves = placed(rows, ["doc_id", "digest", "_id"]).drop("_id")
    feet = bands(leaves, arity, band)

    subroots = feet[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    tops = placed(subroots, ["of"])
    upper = bands(tops, arity, band)
    root = upper[-1].select("tree", F.col("digest").alias("root"))
    above = root.select("tree", F.lit(0).cast("long").alias("place"), F.lit("").alias("suffix"), F.lit(None).cast("string").alias("subroot"), "root",
                        F.lit(0).cast("long").alias("top_place"), F.lit(1).cast("long").alias("top_n"))
    for nodes in reversed(upper[:-1]):
        above = stored(lowered(nodes, above, arity, band), "suffixes")
    above = above.select("place", "suffix", "root").join(tops, "place").select(
        F.col("of").alias("tree"), F.lit(0).cast("long").alias("place"), "suffix", F.col("digest").alias("subroot"), "root",
        F.col("place").alias("top_place"), F.col("n").alias("top_n"))
    for nodes in reversed(feet[1:-1]):
        above = stored(lowered(nodes, above, arity, band), "suffixes")
    return proved(leaves, above, arity, band)
