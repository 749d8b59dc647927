"""Operator 10: shards by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked. Every linked document starts in a shard that its id decides; in each round a
document moves towards the shard that holds most of its neighbours, while capacity quotas decide how many may enter: a
move is taken with probability room / demand, so a round needs only sums per shard. What has no links fills the shards,
and what a shard holds beyond its share is dealt anew, so that row counts end at most one apart (law ``rows``).

Neighbours meet through one row per (text group, shard), never as pairs. Groups beyond ``salt_rows`` rows are split by a
salt in every join and numbering, into as many parts as their rows ask for. Groups with more than one in ``HOT`` of all
rows, fewer than ``HOT``, tell their rows the number of parts by a broadcast, the others by a shuffle in which no key is
larger than that. Only sums per shard reach the driver.

Defined results: a null text counts as empty; repeated rows are separate documents; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.llm.base import keep, numbered

N_SHARDS = 16
ROUNDS = 16
SALT_ROWS = 250
HOT = 20_000
BUCKETS = 1024


def _pick(values: list[int]):
    """Column array of 64-bit literals."""
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def _bucket(*cols):
    return F.pmod(F.xxhash64(*cols), F.lit(BUCKETS))


def _loads(df: DataFrame, n_shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in df.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    return [found.get(s, 0) for s in range(n_shards)]


def propagate(linked: DataFrame, quota: list[int], n_shards: int, rounds: int) -> DataFrame:
    """Rounds of label propagation over (group key, salt, shard) rows under the quotas."""
    keys = ["crc", "hash", "size"]
    for turn in range(rounds):
        loads = _loads(linked, n_shards)
        # a shard with next to no room is closed, so that large groups turn to the next one
        room = [max(0, q - x) if q - x > q // 20 else 0 for q, x in zip(quota, loads, strict=True)]
        cells = keep(linked.groupBy(*keys, "shard").agg(F.count("*").alias("n"), F.max("salts").alias("salts")))
        # the fullest shard of the group that still has room
        open_ = F.element_at(_pick(room), F.col("shard") + 1) > 0
        goal = cells.where(open_).groupBy(*keys).agg(F.max(F.struct("n", (-F.col("shard")).alias("shard"))).alias("top"))
        wish = cells.join(goal, keys).select(
            *keys, "shard", "n", "salts", (-F.col("top.shard")).alias("goal"), F.col("top.n").alias("goal_n"))
        wish = keep(wish.where("goal <> shard and (goal_n > n or (goal_n = n and goal < shard))"))
        demand = {r["goal"]: r["n"] for r in wish.groupBy("goal").agg(F.sum("n").alias("n")).collect()}
        if not demand:
            break
        # share of the wishes for a shard that its room can take
        share = F.array(*[F.lit(min(1.0, room[s] / demand[s]) if s in demand else 0.0) for s in range(n_shards)])
        moves = wish.select(*keys, "shard", "goal", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        draw = (F.pmod(F.xxhash64(F.lit(turn), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20)))
        take = F.col("goal").isNotNull() & (draw < F.element_at(share, F.col("goal") + 1))
        linked = keep(linked.join(moves, [*keys, "salt", "shard"], "left")
                      .withColumn("shard", F.when(take, F.col("goal")).otherwise(F.col("shard"))).drop("goal"))
    return linked


def assign_shards(docs: DataFrame, n_shards: int = N_SHARDS, rounds: int = ROUNDS, salt_rows: int = SALT_ROWS, most_hot: int = HOT,
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = keep(docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(F.encode(raw, "utf-8")).alias("crc"), F.xxhash64(raw).alias("hash")))
    keys = ["crc", "hash", "size"]
    total = rows.count()
    share = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    sizes = keep(rows.groupBy(*keys).count().where("count > 1").select(
        *keys, "count", F.ceil(F.col("count") / salt_rows).cast("int").alias("salts")))
    hot = F.col("count") > total / most_hot
    first = rows.join(F.broadcast(sizes.where(hot).drop("count")), keys, "left")
    rest = first.where("salts is null").drop("salts").join(sizes.where(~hot).drop("count"), keys, "left")
    marked = keep(first.where("salts is not null").unionByName(rest).withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.col("salts")).cast("int"), F.lit(0))))
    linked = marked.where("salts is not null").withColumn("shard", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(n_shards)).cast("int"))
    linked = propagate(keep(linked), share, n_shards, rounds)
    linked = keep(numbered(linked, "shard", _bucket(*keys, "salt"), [*keys, "doc_id"], "place"))
    loads = _loads(linked, n_shards)
    fits = F.col("place") < F.element_at(_pick(share), F.col("shard") + 1)
    # rows without links, and those beyond a shard's share, fill what is left
    free = marked.where("salts is null").select("doc_id", *keys, "salt").unionByName(linked.where(~fits).select("doc_id", *keys, "salt"))
    free = numbered(free.withColumn("all", F.lit(0)), "all", _bucket(*keys, "salt"), [*keys, "doc_id"], "place").drop("all")
    ends, at = [], 0
    for s in range(n_shards):
        at += share[s] - min(share[s], loads[s])
        ends.append(at)
    filled = free.withColumn("shard", F.size(F.filter(_pick(ends), lambda e: e <= F.col("place"))))
    placed = linked.where(fits).select("doc_id", *keys, "shard").unionByName(filled.select("doc_id", *keys, "shard"))
    out = numbered(keep(placed), "shard", _bucket("doc_id"), ["doc_id", *keys], "slot")
    return out.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int"),
        F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
