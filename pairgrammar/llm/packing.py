"""Best-fit packing of documents into training sequences under conflicts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgrammar.session import scratch_path

CAPACITY = 4096  # tokens a bin
SAME_SOURCE = 4  # pieces of one source in a bin
SHARD_BINS, SHARD_PIECES = 2048, 50_000  # about as much as one task packs


def word_count(text: Column) -> Column:
    """Words between blanks and tab to carriage return."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, same_source: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; pieces should come largest first.

    Bins are listed by residual and a bitmap tells which residuals have bins. The search starts at
    the piece's size and goes on to the next larger residual as long as every bin there conflicts:
    a bin whose cluster bitmap has the piece's cluster, or whose source bitmap says that the source
    has filled its places. Where no bin is left, one opens.
    """
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    times: dict = {}
    for c in clusters:
        times[c] = times.get(c, 0) + 1
    cluster_bit = {c: 1 << i for i, c in enumerate(k for k, n in times.items() if n > 1)}
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0
    used, in_clusters, full, held = [], [], [], []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        own, kin = source_bit[source], cluster_bit.get(cluster, 0)
        rest, chosen = (free >> size) << size, -1
        while rest and chosen < 0:
            residual = (rest & -rest).bit_length() - 1
            rest &= rest - 1
            for place, b in enumerate(at[residual]):
                if not full[b] & own and not in_clusters[b] & kin:
                    chosen = b
                    at[residual].pop(place)
                    if not at[residual]:
                        free ^= 1 << residual
                    break
        if chosen < 0:
            chosen = len(used)
            used.append(0)
            in_clusters.append(0)
            full.append(0)
            held.append({})
        out.append((chosen, used[chosen]))
        used[chosen] += size
        in_clusters[chosen] |= kin
        count = held[chosen][source] = held[chosen].get(source, 0) + 1
        if count >= same_source:
            full[chosen] |= own
        residual = capacity - used[chosen]
        if residual:
            at[residual].append(chosen)
            free |= 1 << residual
    return out


def pack(docs: DataFrame, key: str = "doc_id", size: str = "n_tokens", source: str = "source", cluster: str = "cluster", capacity: int = CAPACITY, same_source: int = SAME_SOURCE) -> DataFrame:
    """``key``, ``piece``, ``start``, ``n_tokens``, ``bin``, ``offset``: where every token of every document goes.

    A document over ``capacity`` tokens is cut into pieces; all but the last fill bins of their own. No
    bin holds two pieces of one cluster or more than ``same_source`` of one source; null clusters
    conflict with nothing, a null source is one source. Documents are dealt into shards of bounded
    size by hash, so a hot source or cluster is spread over all of them; each shard is packed by
    best fit, largest first, ties by key and piece. A document without tokens has one row with a null
    bin. Repeated rows are placed each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"), F.col(source).cast("string").alias("source"), F.col(cluster).cast("string").alias("cluster"))
    path = scratch_path(spark, "sizes")
    given.write.parquet(path)
    given = spark.read.parquet(path)
    last = F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0).cast("long"))
    pieces = given.select("key", "source", "cluster", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = pieces.select("key", "source", "cluster", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece") * capacity).alias("n_tokens"))
    sums = given.agg(F.sum("size").alias("tokens"), F.count("*").alias("docs")).first()
    shards = max(1, -(-(sums["tokens"] or 0) // (capacity * SHARD_BINS)), -(-sums["docs"] // SHARD_PIECES))
    shard = F.pmod(F.xxhash64("key", "piece", "cluster"), F.lit(shards))

    def work(rows: pa.Table) -> pa.Table:
        t = rows.to_pydict()
        order = sorted((i for i, n in enumerate(t["n_tokens"]) if n), key=lambda i: (-t["n_tokens"][i], t["key"][i] is None, t["key"][i] or 0, t["piece"][i]))
        spots = best_fit([t["n_tokens"][i] for i in order], [t["source"][i] for i in order], [t["cluster"][i] if t["cluster"][i] is not None else (i,) for i in order], capacity, same_source)
        bins: list[int | None] = [None] * rows.num_rows
        offsets: list[int | None] = [None] * rows.num_rows
        for i, (b, o) in zip(order, spots):
            bins[i], offsets[i] = (t["shard"][i] << 32) + b, o
        return pa.table({"key": rows["key"], "piece": rows["piece"], "start": rows["start"], "n_tokens": rows["n_tokens"], "bin": pa.array(bins, pa.int64()), "offset": pa.array(offsets, pa.int64())})

    dealt = pieces.withColumn("shard", shard).repartition(shards, "shard")
    packed = dealt.groupBy("shard").applyInArrow(work, "key long, piece long, start long, n_tokens long, bin long, offset long")
    return packed.withColumnRenamed("key", key)
