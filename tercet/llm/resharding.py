"""Resharding by minimum-cost flow: move as few bytes as the new capacities allow.

The old layout gives every document a shard, and its files hold one block each: an old shard's rows
of one size class. Blocks are the supplies of a flow network, the new shards' row capacities are the
demands, and an arc costs nothing where a block stays and its mean bytes a row where it moves. The
network has shards x size classes nodes whatever the data's size, and successive shortest paths
solve it. The flow says how many rows each block sends where; taken by size within the old shard,
these are intervals of a global sort, so that shard and slot of a row follow from its position.
Files of blocks with rows that move are rewritten; the files of all other blocks stay as they are,
and their rows' slots stand in the table of places alone.

The law is ``rows``: counts of the new shards are at most one apart. Each shard takes the whole part
of the mean and, as one more node, an odd row at most, so that the flow also chooses where the odd
rows save most. Among all ways to reach the capacities it moves the fewest bytes, a row counted as
its block's mean (each over-full shard gives its smallest documents).

Defined cases: null text has no bytes and size 1; a null doc_id belongs to old shard 0; ties in
size are ordered by a row number; repeated rows each get their own slot; very long texts are rows like
others, in a size class of their own; an empty table gives an
empty result; other columns are not carried.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tercet.llm.common import looked_up, new_path, partitions, sorted_positions, table, written

N_SHARDS = 8
OLD_SHARDS = 6
LAW = "rows"


def min_cost_flow(supplies: list[int], demands: list[int], cost: list[list[float]]) -> list[list[int]]:
    """Flow from supplies to demands (equal sums) of least cost, by successive shortest paths."""
    n, m = len(supplies), len(demands)
    flow = [[0] * m for _ in range(n)]
    left, need = list(supplies), list(demands)
    while any(left):
        distance = [0.0 if left[i] else float("inf") for i in range(n)] + [float("inf")] * m
        came: list[int] = [-1] * (n + m)
        queue, waiting = deque(i for i in range(n) if left[i]), {i for i in range(n) if left[i]}
        while queue:
            u = queue.popleft()
            waiting.discard(u)
            arcs = [(n + j, cost[u][j]) for j in range(m)] if u < n else [(i, -cost[i][u - n]) for i in range(n) if flow[i][u - n]]
            for v, c in arcs:
                if distance[u] + c < distance[v] - 1e-9:
                    distance[v], came[v] = distance[u] + c, u
                    if v not in waiting:
                        waiting.add(v)
                        queue.append(v)
        end = min((n + j for j in range(m) if need[j]), key=lambda v: distance[v])
        path = [end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        path.reverse()
        amount = min(left[path[0]], need[end - n], *(flow[v][u - n] for u, v in zip(path, path[1:], strict=False) if u >= n), 1 << 62)
        for u, v in zip(path, path[1:], strict=False):
            if u < n:
                flow[u][v - n] += amount
            else:
                flow[v][u - n] -= amount
        left[path[0]] -= amount
        need[end - n] -= amount
    return flow


#: Cost of an arc that may not be used.
NEVER = 1e15


def transfers(blocks: list[tuple[int, int, int, int]], n_shards: int) -> list[tuple[int, int, int, int]]:
    """From (old shard, size class, rows, bytes) to (old shard, size class, rows, new shard), smallest rows first."""
    blocks = sorted(blocks)
    base, odd = divmod(sum(b[2] for b in blocks), n_shards)
    to_shard = [[0.0 if j == shard else size / rows for j in range(n_shards)] for shard, _, rows, size in blocks]
    # every shard has its base, and a place for one row more; what fills the places that stay free comes from nowhere
    cost = [row + row for row in to_shard] + [[NEVER] * n_shards + [0.0] * n_shards]
    flow = min_cost_flow([*(b[2] for b in blocks), n_shards - odd], [base] * n_shards + [1] * n_shards, cost)
    out = []
    for (shard, size_class, _, _), row in zip(blocks, flow, strict=False):
        sent = [row[j] + row[n_shards + j] for j in range(n_shards)]
        # inside a block that is split, its smallest rows move and the others stay
        out += [(shard, size_class, n, j) for j, n in enumerate(sent) if n and j != shard]
        if shard < n_shards and sent[shard]:
            out.append((shard, size_class, sent[shard], shard))
    return out


def _by_interval(old: Column, rank: Column, parts: list[tuple[int, int, int, int]], value) -> Column:
    """parts: (old shard, first rank, end rank, index); the value of the part that holds the row."""
    out = F.lit(None).cast("long")
    for shard, low, high, i in parts:
        out = F.when((old == shard) & (rank >= low) & (rank < high), value(i)).otherwise(out)
    return out


def assigned(rows: DataFrame, n_shards: int = N_SHARDS) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Shard and slot of ``rows(id, old_shard, class, size)`` (written, by id), and the blocks (old shard, class) with rows that move."""
    sized = rows.select("id", "old_shard", "class", "size")
    blocks = [tuple(r) for r in sized.groupBy("old_shard", "class").agg(F.count("*"), F.sum("size")).collect()]
    moves = transfers(blocks, n_shards)
    ranked, before = sorted_positions(sized.select("id", "old_shard", "size"), [F.col("old_shard"), F.col("size"), F.col("id")], "ranked")
    firsts: dict[int, int] = {}
    at = 0
    for shard in sorted({b[0] for b in blocks}):
        firsts[shard] = at
        at += sum(b[2] for b in blocks if b[0] == shard)
    parts, used, filled, slots = [], dict.fromkeys(firsts, 0), [0] * n_shards, []
    for i, (shard, _, n, j) in enumerate(moves):
        parts.append((shard, used[shard], used[shard] + n, i))
        slots.append(filled[j] - used[shard])
        used[shard] += n
        filled[j] += n
    first = looked_up(firsts, F.col("old_shard"))
    rank = F.col("_row") + looked_up(before, F.col("_pid")) - first
    named = ranked.withColumn("rank", rank)
    places = named.select(
        "id",
        _by_interval(F.col("old_shard"), F.col("rank"), parts, lambda i: F.lit(moves[i][3]).cast("long")).cast("int").alias("shard"),
        _by_interval(F.col("old_shard"), F.col("rank"), parts, lambda i: F.col("rank") + slots[i]).alias("slot"),
    )
    return written(places, "places"), sorted({(shard, size_class) for shard, size_class, _, j in moves if j != shard})


def old_layout(docs: DataFrame, n_shards: int = OLD_SHARDS) -> DataFrame:
    """The layout before: by a checksum of doc_id (id, old shard, size class, doc_id, text)."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(
        "doc_id", "text",
        size.alias("size"),
        F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n_shards)), F.lit(0)).cast("int").alias("old_shard"),
        F.floor(F.log2(size.cast("double"))).cast("int").alias("class"),
        F.monotonically_increasing_id().alias("id"),
    )


def reshard(old_path: str, new_path_: str, spark: SparkSession, n_shards: int = N_SHARDS) -> DataFrame:
    """Reshard the files under ``old_path``/old_shard=N/class=N (rows with id and size); returns all rows with shard and slot.

    Blocks with rows that move are written to ``new_path_``/shard=N and read back; of the others only the
    places are joined, their files stay. Columns are kept; ``slot`` is the place in the shard, from 0.
    """
    old = spark.read.parquet(old_path)
    places, affected = assigned(old, n_shards)
    moves = F.lit(False)
    for shard, size_class in affected:
        moves = moves | ((F.col("old_shard") == shard) & (F.col("class") == size_class))
    stay = old.filter(~moves).join(places, "id").drop("old_shard", "class", "id")
    if not affected:
        return stay
    old.filter(moves).join(places, "id").drop("old_shard", "class", "id").write.partitionBy("shard").option("compression", "zstd").parquet(new_path_)
    return stay.unionByName(spark.read.parquet(new_path_).select(*stay.columns))


def op7_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = old_layout(table(spark, sf_dir, "documents"))
    if docs.isEmpty():
        new = docs.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    else:
        path = new_path(spark, "old-shards")
        # by ranges, so that a task has few blocks and a large block many tasks
        laid = docs.repartitionByRange(partitions(spark), "old_shard", "class", "id")
        laid.write.partitionBy("old_shard", "class").option("compression", "zstd").parquet(path)
        new = reshard(path, new_path(spark, "new-shards"), spark)
    return new.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
