"""Near-duplicates by b-bit MinHash: bands of minima find candidates, their packed low bits estimate, full sets confirm."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

from pyspark.sql import Column, DataFrame, functions as F

from pressroute.llm.common import key_map, stage, with_key_flag
from pressroute.llm.components import connected_components
from pressroute.operators.joins import split_join

SHINGLE_WORDS = 3
#: Sets are linked when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: A pair of sets at the threshold shares no band with probability (1 - 0.85**4)**32, less than 1e-10.
BANDS, BAND_ROWS = 32, 4
MINIMA = BANDS * BAND_ROWS
#: Low bits kept of each minimum, in as many bit planes of 64 minima a word.
LOW_BITS = 2
#: A candidate is discarded if a pair at the threshold would agree in so few low bits with at most this probability.
DISCARD = 1e-9
#: Buckets of more texts go by their members' shared shingles.
SMALL_BUCKET = 8
#: Words of the bitmap that holds the shared shingles of a member of a larger bucket by their hash.
BITMAP = [f"bits{i}" for i in range(16)]
#: Shingle hashes sent on at a time.
HASHES_AT_ONCE = 200_000
ROWS_PER_BATCH = 256
#: Sizes of sets that differ by less than this factor share a key of the join in larger buckets.
SIZE_STEP = 1.02
SEED = 20240117
WORD_BITS = 21


def least_agreement() -> int:
    """Fewest agreeing minima, of MINIMA, with which a pair is still confirmed on its sets."""
    p = PERCENT / 100 + (1 - PERCENT / 100) / (1 << LOW_BITS)
    below = 0.0
    for agreeing in range(MINIMA + 1):
        below += math.comb(MINIMA, agreeing) * p**agreeing * (1 - p) ** (MINIMA - agreeing)
        if below > DISCARD:
            return agreeing
    return MINIMA


def shingle_codes(words: list[bytes], numbers: dict[bytes, int]):
    """Each distinct shingle once, as whole numbers that are equal only for equal shingles under the same ``numbers``
    (words from 1 on, added to as they come). Fewer words than SHINGLE_WORDS make one shingle."""
    import numpy as np

    own = [numbers.setdefault(w, len(numbers) + 1) for w in words]
    if len(own) < SHINGLE_WORDS:
        own = [0] * (SHINGLE_WORDS - len(own)) + own if own else []
    if len(numbers) >= 1 << WORD_BITS:  # more words than fit: exact all the same, only slower
        shingles = {tuple(own[i:i + SHINGLE_WORDS]) for i in range(len(own) - SHINGLE_WORDS + 1)}
        return np.array(sorted(reduce(lambda code, w: code << 42 | w, s, 0) for s in shingles), object)
    row = np.array(own, np.int64)
    return np.unique(row[:-2] << 2 * WORD_BITS | row[1:-1] << WORD_BITS | row[2:]) if len(row) else row


def _mixed(x):
    import numpy as np

    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: list[bytes]):
    """64-bit hashes of the distinct shingles of a text."""
    import numpy as np
    from xxhash import xxh64_intdigest

    numbers: dict[bytes, int] = {}
    codes = shingle_codes(words, numbers)
    hashed = np.array([0, *(xxh64_intdigest(w, SEED) for w in numbers)], np.uint64)
    if codes.dtype == object:
        parts = [np.array([int(c) >> shift & (1 << 42) - 1 for c in codes], np.int64) for shift in (84, 42, 0)]
    else:
        parts = [codes >> shift & (1 << WORD_BITS) - 1 for shift in (2 * WORD_BITS, WORD_BITS, 0)]
    out = np.zeros(len(codes), np.uint64)
    for part in parts:
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashed[part])
    return out


def signer():
    """A function from a set's hashes to its minima: 32-bit permutations, half of them over either half of a hash."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    offsets = rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)

    def minima(hashes):
        halves = (hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32))
        out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
        for k, half in enumerate(halves):
            mine = slice(k * MINIMA // 2, (k + 1) * MINIMA // 2)
            for at in range(0, len(half), 1024):
                out[mine] = np.minimum(out[mine], (half[at:at + 1024, None] * factors[mine] + offsets[mine]).min(axis=0))
        return out

    return minima


def text_key(words: list[bytes]) -> bytes | None:
    """128 bits of the SHA-256 of a text's words; None if there is none. Texts of the same words have the same set."""
    return sha256(b" ".join(words)).digest()[:16] if words else None


def _keyed(docs: DataFrame) -> DataFrame:
    """``key, text`` of the texts that have words."""
    def compute(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_BATCH):
                text = batch.column(0).slice(at, ROWS_PER_BATCH)
                keys = pa.array([text_key((t.as_py() or b"").lower().split()) for t in text.cast(pa.binary())], pa.binary())
                yield pa.record_batch([keys, text], ["key", "text"]).filter(keys.is_valid())

    return docs.select("text").mapInArrow(compute, "key binary, text string")


PLANES = [f"plane{i}" for i in range(LOW_BITS * MINIMA // 64)]


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, key, n_shingles, plane.., bands`` of every whole text: the set's size, the low bits of its minima packed
    in planes, and a hash of the full minima of each band."""
    def compute(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        minima_of = signer()
        names = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            keys, sizes, planes, bands = [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                words = (text.as_py() or b"").lower().split()  # bytes: A-Z and the six ASCII blanks
                keys.append(text_key(words))
                hashes = shingle_hashes(words)
                sizes.append(len(hashes))
                minima = minima_of(hashes)
                planes.append(np.packbits([((minima >> b) & 1).astype(np.uint8) for b in range(LOW_BITS)]).view(np.int64))
                band = names.copy()
                for column in minima.reshape(BANDS, BAND_ROWS).T:
                    band = _mixed(band * np.uint64(31) + column)
                bands.append(band.view(np.int64) if len(hashes) else [])
            yield pa.record_batch([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), *[pa.array([p[i] for p in planes], pa.int64()) for i in range(len(PLANES))],
                                   pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "key", "n_shingles", *PLANES, "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(compute, f"doc_id {kind}, key binary, n_shingles long, {', '.join(f'{p} long' for p in PLANES)}, bands array<long>")


def _alike(a: str, b: str) -> Column:
    """Whether two sets may be similar enough by their sizes and by the agreement of their low bits."""
    words = MINIMA // 64
    differ = [reduce(Column.bitwiseOR, [F.col(f"{a}_plane{plane * words + w}").bitwiseXOR(F.col(f"{b}_plane{plane * words + w}")) for plane in range(LOW_BITS)])
              for w in range(words)]
    agree = F.lit(MINIMA) - reduce(Column.__add__, [F.bit_count(d) for d in differ])
    sizes = F.col(f"{a}_n_shingles"), F.col(f"{b}_n_shingles")
    return (100 * F.least(*sizes) >= PERCENT * F.greatest(*sizes)) & (agree >= least_agreement())


def _shared_shingles(members: DataFrame, bodies: DataFrame) -> DataFrame:
    """``id, shared, bits..`` of the members of larger buckets that could be linked at all.

    A shingle in two members' intersection stands in two of them at least, so a member can only be linked if
    PERCENT of its shingles are ``shared``. A bit is set for the hash of each of those: one that is set for a
    member and not for another is at least one shingle that the other lacks.
    """
    spark_rows = split_join(bodies, members, ["id"])

    def hashes(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        def together(ids, found):
            return pa.record_batch([pa.array(np.repeat(ids, [len(f) for f in found]), pa.int64()), pa.array(np.concatenate(found), pa.int64())], ["id", "hash"])

        for batch in batches:
            ids, found, rows = [], [], 0
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                ids.append(at)
                found.append(shingle_hashes((text.as_py() or b"").lower().split()).view(np.int64))
                rows += len(found[-1])
                if rows > HASHES_AT_ONCE:
                    yield together(np.array(ids, np.int64), found)
                    ids, found, rows = [], [], 0
            if ids:
                yield together(np.array(ids, np.int64), found)

    alone = (spark_rows.select("id", "text").mapInArrow(hashes, "id long, hash long").groupBy("hash")
             .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").groupBy("id").agg(F.collect_list("hash").alias("alone")))

    def count(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids, shared, bits = [], [], []
            for at, text, own in zip(batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2)):
                every = shingle_hashes((text.as_py() or b"").lower().split())
                rest = every[~np.isin(every.view(np.int64), np.array(own.as_py() or [], np.int64))]
                if 100 * len(rest) >= PERCENT * len(every):
                    ids.append(at.as_py())
                    shared.append(len(rest))
                    bitmap = np.zeros(64 * len(BITMAP), bool)
                    bitmap[(rest % np.uint64(len(bitmap))).astype(np.int64)] = True
                    bits.append(np.packbits(bitmap).view(np.int64))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(shared, pa.int64()), *[pa.array([b[i] for b in bits], pa.int64()) for i in range(len(BITMAP))]],
                                  ["id", "shared", *BITMAP])

    return spark_rows.join(alone, "id", "left").select("id", "text", "alone").mapInArrow(count, f"id long, shared long, {', '.join(f'{b} long' for b in BITMAP)}")


def _confirmed(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets are similar enough."""
    def compare(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        last, numbers, left = None, {}, None
        for batch in batches:
            links = []
            for a, b, one, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())):
                if a != last or len(numbers) > 1 << WORD_BITS - 1:
                    last, numbers = a, {}
                    left = shingle_codes(one.as_py().lower().split(), numbers)
                right = shingle_codes(other.as_py().lower().split(), numbers)
                if left.dtype != right.dtype:  # the second text took the words over the bound
                    last = None
                    left = shingle_codes(one.as_py().lower().split(), numbers)
                both = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * both >= PERCENT * (len(left) + len(right) - both):
                    links.append((a, b))
            yield pa.record_batch([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    right = split_join(pairs.withColumnRenamed("b", "id"), bodies, ["id"]).select("a", F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = split_join(right.withColumnRenamed("a", "id"), bodies, ["id"])
    return both.select(F.col("id").alias("a"), "b", "text", "text_b").mapInArrow(compare, "a long, b long")


def _classes(members: DataFrame, links: DataFrame, purpose: str) -> DataFrame:
    """The rows with ``class``: the least id reachable over the links found so far."""
    roots = connected_components(links, purpose).select(F.col("node").alias("id"), "root")
    return split_join(members, roots, ["id"], "left").withColumn("class", F.coalesce("root", "id")).drop("root")


def linked_texts(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """Links ``a, b`` that join all texts (``id, key, n_shingles, plane.., bands``) whose sets are similar enough, directly
    or through others.

    Texts that share a band meet in its bucket. First each is tried against one text of the bucket, which joins
    nearly all that belong together; then the pairs of a bucket that are still in different classes are tried, so
    a group of thousands of copies costs its members and not their pairs. What is tried must pass ``_alike``.

    In buckets of over SMALL_BUCKET texts the members that share too few shingles with any other are out
    (texts with a passage or a layout in common), the one text is the member with the largest share of shared
    shingles (the copy with the fewest changes), and remaining pairs must pass the bounds of their shared
    shingles, in whole and cell by cell. All three only leave out pairs that cannot be linked.
    """
    banded = texts.select("id", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")).where("n > 1")
    shared = stage(split_join(banded, buckets, ["band"]), "minhash-shared")

    there = stage(shared.select("id").distinct().join(texts.drop("bands"), "id"), "minhash-there")
    flagged = with_key_flag(_keyed(docs), key_map(there, ["key"], "minhash-keys"), ["key"], "__flagged").where("__flagged")
    one_each = flagged.groupBy("key").agg(F.first("text").alias("text"))
    bodies = stage(one_each.join(there.select("id", "key"), "key").select("id", "text"), "minhash-bodies")
    marks = ["n_shingles", *PLANES]
    there = there.select("id", F.struct(*marks).alias("mark"))

    larger = shared.where(F.col("n") > SMALL_BUCKET)
    crowd = stage(_shared_shingles(larger.select("id").distinct(), bodies), "minhash-crowd")
    crowd = crowd.join(there.select("id", F.col("mark.n_shingles").alias("size")), "id")
    larger = larger.select("band", "id").join(crowd.select("id", (F.col("shared") / F.col("size")).alias("share")), "id")
    centres = larger.groupBy("band").agg(F.max_by("id", F.struct("share", -F.col("id"))).alias("centre"))
    stars = split_join(larger.select("band", "id"), centres, ["band"]).select("id", "centre").unionByName(
        shared.where(F.col("n") <= SMALL_BUCKET).select("id", F.col("low").alias("centre")))
    stars = stars.where("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    marked = stars
    for key, side in (("a", "one"), ("b", "other")):
        marked = marked.join(there.select(F.col("id").alias(key), *[F.col(f"mark.{m}").alias(f"{side}_{m}") for m in marks]), key)
    tried = stage(marked.where(_alike("one", "other")).select("a", "b"), "minhash-tried")
    links = stage(_confirmed(tried, bodies), "minhash-links")

    few = shared.where(F.col("n") <= SMALL_BUCKET).select("band", "id").join(there, "id").select(
        "*", *[F.lit(None).cast("long").alias(c) for c in ("shared", *BITMAP)])
    many = larger.select("band", "id").join(there, "id").join(crowd.select("id", "shared", *BITMAP), "id")
    placed = stage(_classes(few.unionByName(many), links, "minhash-first").select(
        "band", "id", "class", "mark.*", "shared", *BITMAP), "minhash-placed")
    counted = placed.groupBy("band", "class").agg(F.count(F.lit(1)).alias("members"))
    split = counted.groupBy("band").agg(F.count(F.lit(1)).alias("classes"), F.max_by("class", F.struct("members", "class")).alias("main")).where("classes > 1")
    open_ = stage(split_join(placed, split.select("band", "main"), ["band"]), "minhash-open")
    pairs = stage(_open_pairs(open_).join(tried, ["a", "b"], "left_anti"), "minhash-rest")
    return links.unionByName(_confirmed(pairs, bodies))


def _open_pairs(members: DataFrame) -> DataFrame:
    """``a, b``: the pairs of a bucket's members (``band, id, class, n_shingles, plane.., shared, bits..``) in different
    classes that may be similar enough. ``main`` is the class that most of the bucket are in.

    One of a pair is not in the main class, so a bucket of many copies costs its members times those outside. In
    larger buckets sizes are keys of the join as well: with s shared shingles of n, a member can only be linked to
    sets of 85 % of n to s (1 + 1 / 0.85) - n shingles, for a copy with many changes hardly any of its bucket.
    """
    columns = [c for c in members.columns if c != "band"]
    sides = [members.select("band", *[F.col(c).alias(f"{side}_{c}") for c in columns]) for side in ("one", "other")]
    outside = sides[0].where("one_class <> one_main")

    def step(n: Column) -> Column:
        return F.floor(F.log(n) / math.log(SIZE_STEP))

    n, shared = F.col("one_n_shingles"), F.col("one_shared")
    least, most = n * PERCENT / 100, F.least(n * 100 / PERCENT, shared * (100 + PERCENT) / PERCENT - n)
    reach = F.sequence(step(least) - 1, step(F.greatest(most, least)) + 1)  # a step more for rounding
    small = outside.where("one_shared is null").join(sides[1].where("other_shared is null"), "band")
    large = outside.where("one_shared is not null").withColumn("step", F.explode(reach)).join(
        sides[1].where("other_shared is not null").withColumn("step", step(F.col("other_n_shingles"))), ["band", "step"])

    def apart(pairs: DataFrame) -> DataFrame:
        once = (F.col("other_class") == F.col("other_main")) | (F.col("one_id") < F.col("other_id"))
        return pairs.where((F.col("one_class") != F.col("other_class")) & once & _alike("one", "other"))

    # The intersection must reach PERCENT of what the union has at least: both sizes without it, and the shingles of
    # one member only beside the larger shared part. Each expression stands once: the JVM leaves long methods uncompiled.
    sizes = F.col("one_n_shingles") + F.col("other_n_shingles")
    alone = sizes - F.least("one_shared", "other_shared")
    needed = F.greatest(sizes * PERCENT / (100 + PERCENT), alone * PERCENT / 100)
    found = apart(large)
    for x, y in (("one", "other"), ("other", "one")):
        lacking = reduce(Column.__add__, [F.bit_count(F.col(f"{x}_{b}").bitwiseAND(F.bitwise_not(F.col(f"{y}_{b}")))) for b in BITMAP])
        found = found.where(F.col(f"{x}_shared") >= needed).where(F.col(f"{x}_shared") - lacking >= needed)
    ids = F.least("one_id", "other_id").alias("a"), F.greatest("one_id", "other_id").alias("b")
    return apart(small).select(*ids).unionByName(found.select(*ids)).distinct()


def minhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    A text's set holds its distinct shingles of SHINGLE_WORDS words (A-Z in lower case, words between ASCII white
    space; fewer words make one shingle). Sets with 100 * intersection >= PERCENT * union are linked; ``component_id``
    is the least id reachable over links, and the row that has it is ``kept``.

    A null text, or one without words, has no shingles and is linked with nothing. Texts of the same words are one
    text to the search, so copies cost nothing there. A null id keeps its row; its component has a null id only if it
    has no other (such a row is kept). Rows that repeat an id and a text share all results. Texts of any length are
    read whole. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = stage(signatures(rows), "minhash-signed")
    first = [F.first(c).alias(c) for c in ("n_shingles", *PLANES, "bands")]
    texts = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), *first).withColumn("id", F.monotonically_increasing_id())
    texts = stage(texts, "minhash-texts")
    placed = stage(_classes(texts.select("id", "key", "least"), linked_texts(texts.drop("least"), rows), "minhash-last"), "minhash-classes")
    named = placed.groupBy("class").agg(F.min("least").alias("component_id"))
    named = stage(split_join(placed.select("key", "class"), named, ["class"]).select("key", "component_id"), "minhash-named")
    found = split_join(signed.where("key is not null").select("doc_id", "key", "n_shingles"), named, ["key"]).select("doc_id", "n_shingles", "component_id")
    alone = signed.where("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
