"""Sharding by best-fit-decreasing bin packing of indivisible groups (equal texts stay together).

Groups of over 1 / (1000 x shards) of the bytes or rows are few by arithmetic (at most 2000 x shards), so they are packed
first and exactly, wherever they are, on the driver. The rest is dealt by hash into parts of bounded size; each part packs its
groups, largest first, into the tightest of the capacities that the large groups left over, scaled to the part. The open
capacities live in a balanced search tree. A group that fits nowhere goes to the emptiest shard, since the number of shards
is given; a group above the fair share (a third of all rows, say) stays whole in a shard of its own size and the others
share the rest evenly.

Defined cases: null text is an empty text of 8 bytes; a very long text is a large group; repeated rows are separate rows of one group; ties are packed by digest;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorframe.llm.shared import stage, text_or_empty

SHARDS = 24
PART_GROUPS = 50_000
PIECE_ROWS = 100_000


class CapacityTree:
    """A treap of (remaining capacity, bin): tightest fit, emptiest bin and update in logarithmic time."""

    def __init__(self, capacities):
        self.root, self.seed = None, 1
        for index, room in enumerate(capacities):
            self.insert((room, index))

    def insert(self, item):
        self.seed = self.seed * 1103515245 + 12345 & 0x7FFFFFFF
        low, high = self._split(self.root, item)
        self.root = self._merge(self._merge(low, [item, self.seed, None, None]), high)

    def take(self, need: float):
        """Remove and return the item with the least room of at least need, or the one with the most room."""
        node, best = self.root, None
        while node is not None:
            if node[0][0] >= need:
                best, node = node, node[2]
            else:
                node = node[3]
        if best is None:
            best = self.root
            while best[3] is not None:
                best = best[3]
        low, rest = self._split(self.root, best[0])
        _, high = self._split(rest, (best[0][0], best[0][1] + 1))
        self.root = self._merge(low, high)
        return best[0]

    def _split(self, node, item):
        """Nodes below item, and the others."""
        if node is None:
            return None, None
        if node[0] < item:
            node[3], high = self._split(node[3], item)
            return node, high
        low, node[2] = self._split(node[2], item)
        return low, node

    def _merge(self, a, b):
        if a is None or b is None:
            return b if a is None else a
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b


def best_fit_decreasing(sizes, capacities) -> list[int]:
    """Bin of each size; sizes come in decreasing order."""
    tree, out = CapacityTree(capacities), []
    for size in sizes:
        room, index = tree.take(size)
        tree.insert((room - size, index))
        out.append(index)
    return out


def slim_rows(docs: DataFrame) -> DataFrame:
    raw = text_or_empty().cast("binary")
    return docs.select("doc_id", (F.octet_length(text_or_empty()) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
                       F.unhex(F.sha2(raw, 256)).alias("digest"))


def pack_groups(groups: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """groups (digest, bytes, n) -> (digest, shard) of the large groups, bounded, and of the small ones."""
    spark = groups.sparkSession
    total, rows, count = groups.agg(F.sum("bytes"), F.sum("n"), F.count("*")).first()
    total, rows = total or 0, rows or 0
    edge = 1000 * shards
    is_large = (F.col("bytes") * edge > total) | (F.col("n") * edge > rows)
    large = sorted(groups.where(is_large).select("bytes", "digest").collect(), key=lambda r: (-r[0], bytes(r[1])))
    capacity = -(-total // shards)
    placed = best_fit_decreasing([r[0] for r in large], [float(capacity)] * shards)
    room = [float(capacity)] * shards
    for r, shard in zip(large, placed):
        room[shard] -= r[0]
    room = [max(0.0, x) for x in room]
    scale = sum(room) or 1.0

    def pack(part):
        part = part.sort_values(["bytes", "digest"], ascending=[False, True])
        whole = float(part["bytes"].sum())
        part["shard"] = best_fit_decreasing(part["bytes"].tolist(), [whole * x / scale for x in room])
        return part[["digest", "shard"]]

    parts = max(1, -(-count // PART_GROUPS))
    small = (groups.where(~is_large).select("digest", "bytes", F.pmod(F.xxhash64("digest"), F.lit(parts)).alias("part"))
             .groupBy("part").applyInPandas(pack, "digest binary, shard int"))
    return spark.createDataFrame([(bytes(r[1]), s) for r, s in zip(large, placed)], "digest binary, shard int"), small


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (position in the shard, without gaps), grown_shard (null: law bytes)."""
    slim = stage(slim_rows(docs))
    groups = stage(slim.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    large, small = pack_groups(groups, shards)
    # large has at most 2000 x shards rows
    known = slim.join(F.broadcast(large.withColumnRenamed("shard", "fixed")), "digest", "left")
    placed = stage(known.where("fixed IS NOT NULL").withColumnRenamed("fixed", "shard").unionByName(
        known.where("fixed IS NULL").drop("fixed").join(small, "digest")))
    pieces = max(1, placed.count() // PIECE_ROWS)
    keyed = placed.withColumn("piece", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(pieces)))
    counts = keyed.groupBy("shard", "piece").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("piece")) - F.col("rows")
    place = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("doc_id", "digest")) - 1
    return keyed.withColumn("place", place).join(counts.select("shard", "piece", before.alias("before")), ["shard", "piece"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
