"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A tree has regions, regions have racks, racks have shards with a weight; an
inner node weighs what its shards weigh. A row descends level by level. At each
node every child draws ln(u) / weight, u being a uniform hash of (row key,
child's path), and the largest draw wins. A child's draw depends on nothing but
its own path and weight, so a change moves rows only out of subtrees that got
lighter and into subtrees that got heavier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import repeated

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]

#: Rows of a shard are numbered in so many independent runs.
SLOT_BUCKETS = 256


def balanced_tree(n_shards: int = 16, racks: int = 2, per_rack: int = 2) -> Tree:
    """Shards 0 to n_shards - 1 of weight 1, ``per_rack`` to a rack and ``racks`` racks to a region."""
    tree: Tree = {}
    for shard in range(n_shards):
        rack = shard // per_rack
        tree.setdefault(f"region{rack // racks}", {}).setdefault(f"rack{rack}", {})[shard] = 1.0
    return tree


def grown_tree(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own: all other subtrees keep their weights."""
    return {**tree, f"region+{shard}": {f"rack+{shard}": {shard: weight}}}


def _key(doc_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("#"), doc_id.cast("string")), F.lit("null"))


def _draw(key: Column, path: str, weight: float) -> Column:
    u = (F.xxhash64(F.concat(key, F.lit("|" + path))).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)
    return F.log(u) / F.lit(float(weight))


def _winner(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the largest draw; at equal draws that of the earlier one."""
    if len(children) == 1:
        return children[0][2]
    tries = [F.struct(_draw(key, path, w).alias("d"), F.lit(-i).alias("i")) for i, (path, w, _) in enumerate(children)]
    won = -F.greatest(*tries)["i"]
    out = F.when(won == 0, children[0][2])
    for i, (_, _, value) in enumerate(children[1:], 1):
        out = out.when(won == i, value)
    return out


def shard_of(doc_id: Column, tree: Tree) -> Column:
    """Expression for the shard of a row with this id. A null id is a key like any other. Weights must be positive."""
    key = _key(doc_id)
    regions = []
    for region, racks in tree.items():
        below = []
        for rack, shards in racks.items():
            leaves = [(f"{region}/{rack}/{s}", w, F.lit(s)) for s, w in shards.items()]
            below.append((f"{region}/{rack}", sum(shards.values()), _winner(key, leaves)))
        regions.append((region, sum(sum(s.values()) for s in racks.values()), _winner(key, below)))
    return _winner(key, regions).cast("int")


def assign(docs: DataFrame, tree: Tree, grown: Tree | None = None, id_col: str = "doc_id", text_col: str = "text", buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Shard, slot and size of every row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Sizes are the text's UTF-8 bytes plus 1; a null text counts as empty. Slots
    run gapless from 0 in each shard: a shard's rows are dealt by a hash of
    their id into ``buckets`` runs, each numbered by itself and shifted by the
    rows of the runs before it, so no task sorts a whole shard. Equal rows are
    counted before that and spread again after, so a row repeated very often is
    one row to the sort. Other columns are ignored, whatever their names. An
    empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = _key(F.col(id_col))
    bucket = F.pmod(F.xxhash64(F.concat(key, F.lit("|slot"))), F.lit(buckets)).cast("int")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(F.col(id_col), tree).alias("shard"),
        (shard_of(F.col(id_col), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        bucket.alias("bucket"),
    )
    # Reads the id column alone. At most shards x buckets rows.
    sizes = docs.select(shard_of(F.col(id_col), tree).alias("shard"), bucket.alias("bucket")).groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    distinct = rows.groupBy("shard", "bucket", "doc_id", "size", "text_crc32", "grown_shard").agg(F.count("*").alias("n"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = distinct.withColumn("first", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(starts), ["shard", "bucket"])
    slot = F.col("start") + F.col("first") + F.col("_nth")
    return repeated(placed.select("doc_id", "size", "text_crc32", "shard", "grown_shard", "start", "first", F.col("n").alias("_n")), "_n").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard"
    )
