"""SimHash near-duplicates by pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from pressroute.llm.common import stage
from pressroute.llm.components import connected_components
from pressroute.operators.joins import split_join

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
SEED = 42
#: Reference fingerprints: hashes of 0, 1, 2, ..
PIVOTS = 16
#: Of this many blocks of a fingerprint two stay equal when MAX_DISTANCE bits change.
BLOCKS = MAX_DISTANCE + 2
#: Fingerprints in a bucket whose pairs are tried; a larger bucket goes by neighbourhoods.
PAIRED_BUCKET = 64
#: Words hashed at a time, so that a very long text needs little memory at once.
WORDS_AT_ONCE = 200_000


def fingerprint(data: bytes) -> int:
    """Signed 64-bit SimHash of a text in UTF-8: word shingles with repeats, XXH64, a bit is set if over half have it."""
    import numpy as np
    from xxhash import xxh64_digest

    words = data.lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    width = min(SHINGLE_WORDS, len(words))
    counts, total = np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, total, WORDS_AT_ONCE):
        part = words[at:at + WORDS_AT_ONCE + width - 1]
        joined, lengths = b" ".join(part), np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[:len(part) - width + 1].tolist()
        hashes = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1:].tolist())])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` of every whole text; null counts as empty."""
    def compute(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            yield pa.record_batch([batch.column(0), pa.array([fingerprint(t.as_py() or b"") for t in texts], pa.int64())],
                                  ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(compute, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _pivots() -> list[int]:
    from xxhash import xxh64_digest

    return [int.from_bytes(xxh64_digest(str(i).encode(), SEED), "big", signed=True) for i in range(PIVOTS)]


def _masks() -> list[int]:
    width = 64 // BLOCKS
    return [int.from_bytes((((1 << width) - 1) << (b * width)).to_bytes(8, "big"), "big", signed=True) for b in range(BLOCKS)]


def distance_table(prints: DataFrame) -> DataFrame:
    """``fp, far, blocks``: the Hamming distance to every pivot, whole (``far``) and block by block (``blocks[block][pivot]``)."""
    def distances(mask: int) -> Column:
        return F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p)).bitwiseAND(F.lit(mask))).cast("tinyint") for p in _pivots()])

    return prints.select("fp", distances(-1).alias("far"), F.array(*[distances(m) for m in _masks()]).alias("blocks"))


def _ball(fp: Column) -> Column:
    """The fingerprint and the 64 that differ from it in one bit."""
    one = F.lit(1).cast("bigint")
    return F.concat(F.array(fp), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: fp.bitwiseXOR(F.call_function("shiftleft", one, i))))


def linked_fingerprints(prints: DataFrame) -> DataFrame:
    """Links ``a > b`` that join all distinct fingerprints at MAX_DISTANCE or fewer bits, directly or through others.

    Two of the blocks of such a pair are equal, and then so are all pivot distances inside them:
    these distances are the bucket key, for each choice of two blocks. Within a bucket a pair is
    discarded when its whole distances to any pivot differ by more than MAX_DISTANCE (the triangle
    inequality), and the survivors are compared bit by bit.

    Buckets of over PAIRED_BUCKET fingerprints are not paired. Each of their members meets its
    neighbours in the balls of radius one: fingerprints two bits apart share a centre, and all that
    share a centre (65 at most) are within two bits of each other, so a link to the least of them
    loses none. That costs 65 rows for each member, whatever the bucket's size.
    """
    table = distance_table(prints)
    keyed = stage(table.select("fp", "far", F.explode(F.array(*[
        F.struct(F.lit(i).alias("choice"), F.xxhash64(F.col("blocks")[x], F.col("blocks")[y]).alias("key"))
        for i, (x, y) in enumerate(combinations(range(BLOCKS), 2))])).alias("bucket")).select("fp", "far", "bucket.*"), "simhash-buckets")
    sizes = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stage(split_join(keyed, sizes, ["choice", "key"]), "simhash-shared")

    few = shared.where(F.col("n") <= PAIRED_BUCKET).drop("n")
    other = few.select("choice", "key", F.col("fp").alias("b"), F.col("far").alias("far_b"))
    apart = F.greatest(*[F.abs(F.col("far")[i].cast("int") - F.col("far_b")[i].cast("int")) for i in range(PIVOTS)])
    paired = (few.withColumnRenamed("fp", "a").join(other, ["choice", "key"]).where("a > b").where(apart <= MAX_DISTANCE)
              .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE).select("a", "b"))

    many = shared.where(F.col("n") > PAIRED_BUCKET).select("fp").distinct()
    met = many.select("fp", F.explode(_ball(F.col("fp"))).alias("centre")).groupBy("centre").agg(F.collect_set("fp").alias("near"))
    by_ball = met.where(F.size("near") > 1).select(F.explode("near").alias("a"), F.array_min("near").alias("b")).where("a > b")
    return paired.unionByName(by_ball).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, fp, component_id``, the least id reachable over links of MAX_DISTANCE bits.

    Equal fingerprints are linked, those of texts without words (zero) too. A null id keeps its row and
    counts only where its whole component has no other id (then null). Repeated rows share a component;
    an empty table gives an empty result; other columns are ignored.
    """
    prints = stage(fingerprints(docs, id_col, text_col), "simhash-prints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = connected_components(linked_fingerprints(distinct.select("fp")), "simhash")
    placed = stage(distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-placed")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage(split_join(placed.select("fp", "root"), named, ["root"]).select("fp", "component_id"), "simhash-named")
    return split_join(prints, named, ["fp"]).select("doc_id", "fp", "component_id")
