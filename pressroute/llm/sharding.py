"""Sharding by balanced label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pressroute.llm.common import dense_index, stage
from pressroute.operators.joins import split_join

GROUP = ["k1", "k2"]
ROW = ["doc_id", *GROUP]


def quotas(rows: int, shards: int) -> list[int]:
    """Rows of each shard: at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def allowed_moves(wanted: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of the wanted moves (from, to) may happen: swaps of equal size, then what a shard has room for."""
    allowed, room = {}, list(room)
    for (a, b), n in sorted(wanted.items()):
        allowed[a, b] = min(n, wanted.get((b, a), 0))
    for (a, b), n in sorted(wanted.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - allowed[a, b], room[b])
        allowed[a, b] += more
        room[b] -= more
    return {k: n for k, n in allowed.items() if n}


def _preferred(linked: DataFrame, shards: int, barred: list[int]) -> DataFrame:
    """Linked rows with the shard that holds most of their group (``to``) and what a move would gain.

    A group's counts are summed map-side and come as at most ``shards`` rows, so its size does not
    matter. Of shards with equal counts the group's own hash decides, the same for all its members:
    two that are apart do not change places for ever. ``barred`` shards take nobody new.
    """
    counts = linked.groupBy(*GROUP, "shard").agg(F.count(F.lit(1)).alias("n"))
    held = counts.groupBy(*GROUP).agg(F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("held"))
    joined = split_join(linked, held, GROUP)
    entries = F.transform(F.map_entries("held"), lambda e: F.struct(
        e["value"].alias("n"), F.pmod(F.xxhash64(F.col("k1"), e["key"]), F.lit(1 << 20)).alias("lot"), e["key"].alias("shard")))
    open_to = F.filter(entries, lambda e: (e["shard"] == F.col("shard")) | ~e["shard"].isin(barred)) if barred else entries
    best = F.array_max(open_to)
    return joined.withColumn("best", best).withColumns({
        "to": F.col("best")["shard"], "gain": F.col("best")["n"] - F.col("held")[F.col("shard")] + 1}).drop("held", "best")


def propagate(linked: DataFrame, rows: int, quota: list[int], rounds: int) -> DataFrame:
    """Move linked rows towards their groups' shards; no shard ever holds more than its quota.

    Every second round leaves out shards without room, so that a group larger than a shard spills into
    as few others as can be. Ends when nobody may move. The driver sees counts by pair of shards only.
    """
    shards = len(quota)
    for turn in range(rounds):
        load = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        room = [quota[s] - load.get(s, 0) for s in range(shards)]
        barred = [s for s in range(shards) if not room[s]] if turn % 2 else []
        chosen = stage(_preferred(linked, shards, barred), "shard-wishes")
        movers = chosen.where("`to` != shard")
        wanted = {(r["shard"], r["to"]): r["n"] for r in movers.groupBy("shard", "to").agg(F.count(F.lit(1)).alias("n")).collect()}
        allowed = allowed_moves(wanted, room)
        if not allowed:
            if barred or not wanted:
                break
            continue
        limits = F.create_map(*[F.lit(x) for (a, b), n in allowed.items() for x in (a * shards + b, n)])
        movers = movers.withColumn("level", -F.floor(F.log2("gain")))  # the largest gains go first
        ranked = dense_index(movers, rows, ["shard", "to", "level"], ROW, "nth")
        sizes = movers.groupBy("shard", "to", "level").agg(F.count(F.lit(1)).alias("n"))
        ahead = Window.partitionBy("shard", "to").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.select("shard", "to", "level", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
        moved = ranked.join(sizes, ["shard", "to", "level"]).withColumn(
            "shard", F.when(F.col("nth") + F.col("ahead") < F.coalesce(limits[F.col("shard") * shards + F.col("to")], F.lit(0)),
                            F.col("to")).otherwise(F.col("shard")))
        linked = stage(moved.select(linked.columns).unionByName(chosen.where("`to` = shard").select(linked.columns)), "shard-linked")
    return linked


def shard_documents(docs: DataFrame, shards: int = 24, rounds: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, shard, slot, k1, k2`` (the hashes of its text); the shards' row counts differ by one at most.

    Rows of equal text are linked. Linked rows begin spread evenly and move, round by round, to the
    shard that holds most of their group, under the shards' quotas; rows without links then fill the
    quotas up. ``size`` is the text's UTF-8 bytes plus 8, ``slot`` numbers a shard's rows from 0.

    A null text has no bytes and the checksum of none (0), and is equal to an empty one. Null ids are
    allowed, repeated rows are rows of their own, an empty table gives an empty result, and other
    columns are ignored. With fewer rows than shards some shards are empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = stage(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")), "shard-rows")
    groups = base.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    told = stage(split_join(base, groups, GROUP, "left"), "shard-told")
    linked, free = told.where("members is not null").drop("members"), told.where("members is null").drop("members")
    rows, n_linked = told.count(), linked.count()
    quota = quotas(rows, shards)

    linked = stage(dense_index(linked, n_linked, [], ROW, "nth").withColumn(
        "shard", F.pmod("nth", F.lit(shards)).cast("int")).drop("nth"), "shard-linked")
    linked = propagate(linked, n_linked, quota, rounds)
    load = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    filled, ends = 0, []
    for s in range(shards):
        filled += quota[s] - load.get(s, 0)
        ends.append(filled)
    spread = dense_index(free, rows - n_linked, [], ROW, "nth").withColumn(
        "shard", F.size(F.filter(F.lit(ends), lambda e: e <= F.col("nth"))).cast("int")).drop("nth")
    placed = stage(linked.unionByName(spread), "shard-placed")
    return dense_index(placed, rows, ["shard"], ROW, "slot").select(
        "doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), *GROUP)


def cut_links(placed: DataFrame) -> DataFrame:
    """One row: ``links`` (rows beyond the first of each group) and ``cut``, those outside their group's fullest shard."""
    counts = placed.groupBy(*GROUP, "shard").agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy(*GROUP).agg(F.sum("n").alias("all"), F.max("n").alias("most"))
    return groups.agg(F.sum(F.col("all") - 1).alias("links"), F.sum(F.col("all") - F.col("most")).alias("cut"))
