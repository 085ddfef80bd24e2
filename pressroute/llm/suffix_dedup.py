"""Passages that repeat across documents, by sparse suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from pressroute.llm.common import key_map, stage, with_key_flag
from pressroute.operators.joins import split_join

#: Words of a passage, at least.
PASSAGE = 50
#: Words of a suffix that are compared; suffixes are kept at the least of WINDOW neighbouring starts.
#: A passage of GRAM + WINDOW - 1 words holds such a start, and the same one in every place.
GRAM = 26
WINDOW = PASSAGE - GRAM + 1
KEY = ["k1", "k2"]

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= 400_000:
            self.clear()
        self[word] = found = xxh64_intdigest(word)
        return found


def word_hashes(text: bytes, known: _Hashes) -> np.ndarray:
    """Hashes of the words: A-Z in lower case, cut at ASCII white space."""
    words = text.lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words (a polynomial in the words' hashes, differences of prefix sums)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words) - 1, _BASE)]), dtype=np.uint64)
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(_inverse(int(_BASE))))]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * power, dtype=np.uint64)])
    return _mix((sums[size:] - sums[:-size]) * back)


def kept_starts(grams: np.ndarray) -> np.ndarray:
    """Starts of the kept suffixes: the least hash (of equal ones the leftmost) of every WINDOW neighbouring runs."""
    if len(grams) < WINDOW:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    parts = [np.argmin(views[a:a + 50_000], axis=1) + np.arange(a, min(a + 50_000, len(views))) for a in range(0, len(views), 50_000)]
    return np.unique(np.concatenate(parts))


def _sparse_suffixes(rows: DataFrame) -> DataFrame:
    """``head, k1, k2, pos``: the kept suffixes of each text of PASSAGE words or more, with the hash of their first GRAM words."""
    def suffixes(batches: Iterator):
        import pyarrow as pa

        known = _Hashes()
        for batch in batches:
            heads, owners, places = [], [], []
            for i, text in enumerate(batch.column(2).cast(pa.binary())):
                grams = run_hashes(word_hashes(text.as_py(), known), GRAM)
                at = kept_starts(grams)
                heads.append(grams[at])
                owners.append(np.full(len(at), i))
                places.append(at)
            owner = pa.array(np.concatenate(owners) if owners else np.zeros(0, np.int64))
            yield pa.record_batch([pa.array(np.concatenate(heads).view(np.int64)), batch.column(0).take(owner), batch.column(1).take(owner),
                                   pa.array(np.concatenate(places).astype(np.int32))], ["head", *KEY, "pos"])

    return rows.select(*KEY, "text").mapInArrow(suffixes, "head long, k1 long, k2 long, pos int")


def _compare_neighbours(ordered: DataFrame) -> DataFrame:
    """Of sorted suffixes, those whose head a neighbour of another text has, too.

    A run of equal heads may go on in the next partition, so that one of any length is spread over many tasks.
    A piece of a run that touches an end of its partition and holds one text only is undecided there: a sum of
    the pieces at the ends (``place`` is 1 for undecided ones, 2 for others) tells whether there is another text.
    """
    def compare(batches: Iterator):
        import pyarrow as pa

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        head, k1, k2 = (table.column(c).to_numpy() for c in ("head", *KEY))
        new = np.concatenate([[True], head[1:] != head[:-1]])
        other = np.concatenate([[False], ((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) & ~new[1:]])
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        shared = np.maximum.reduceat(other, starts)
        edge = np.zeros(len(starts), bool)
        edge[[0, -1]] = True
        place = np.where(edge, np.where(shared, 2, 1), 0).astype(np.int32)
        rows = np.flatnonzero((shared | edge)[run])
        yield from table.take(pa.array(rows)).append_column("place", pa.array(place[run[rows]])).to_batches()

    found = stage(ordered.mapInArrow(compare, "head long, k1 long, k2 long, pos int, place int"), "suffix-neighbours")
    text = F.struct(*KEY)
    split = found.where("place > 0").groupBy("head").agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a != b").select("head")
    undecided = split_join(found.where("place = 1").drop("place"), split, ["head"])
    return found.where("place != 1").drop("place").unionByName(undecided)


def _shared_windows(texts: DataFrame) -> DataFrame:
    """``run, text_id, start``: extend matches left and right, to every run of PASSAGE words that holds a matched suffix's head."""
    def windows(batches: Iterator):
        import pyarrow as pa

        known = _Hashes()
        for batch in batches:
            for i, (text, places) in enumerate(zip(batch.column(1).cast(pa.binary()), batch.column(2))):
                runs = run_hashes(word_hashes(text.as_py(), known), PASSAGE)
                near = (np.array(places.as_py(), np.int64)[:, None] - np.arange(WINDOW)).ravel()
                starts = np.unique(near[(near >= 0) & (near < len(runs))])
                yield pa.record_batch([pa.array(runs[starts].view(np.int64)), batch.column(0).take(pa.array(np.full(len(starts), i))),
                                       pa.array(starts.astype(np.int32))], ["run", "text_id", "start"])

    return texts.select("text_id", "text", "places").mapInArrow(windows, "run long, text_id long, start int")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage: ``doc_id, first_word, n_words, other_doc_id``.

    A passage is a longest stretch of a document's words (A-Z in lower case, cut at ASCII white space) each of
    which lies in a run of PASSAGE words that stands in a document of another id, too. ``other_doc_id`` is
    such a document. Documents without one have no row.

    Texts are reduced to their suffixes at minimiser positions; these are sorted (by the hash of their first
    GRAM words, text and place) and compared with their neighbours. Runs of PASSAGE words around the matched
    ones, to the left and to the right, are then compared among all texts and joined to passages. Equal texts
    are worked on once, and are one passage from end to end.

    Null and empty texts and those under PASSAGE words have no passage. Rows that repeat id and text are
    one document. A null id is an id of its own. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit("second"), F.col("text"))})
    n_words = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    owners = stage(rows.select("doc_id", *KEY, n_words.alias("words")).where(F.col("words") >= PASSAGE).distinct(), "suffix-owners")
    held = stage(owners.groupBy(*KEY).agg(F.first("words").alias("words"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"),
                                          F.count(F.lit(1)).alias("ids")), "suffix-held")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["head", *KEY, "pos"]
    suffixes = stage(_sparse_suffixes(rows), "suffix-sparse")
    matched = _compare_neighbours(suffixes.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    wanted = stage(matched.groupBy(*KEY).agg(F.collect_set("pos").alias("places")), "suffix-matched")

    again = with_key_flag(rows, key_map(wanted, KEY, "suffix-texts"), KEY, "again").where("again").select(*KEY, "text")
    texts = again.groupBy(*KEY).agg(F.first("text").alias("text")).join(wanted, KEY)  # copies meet before the shuffle
    texts = stage(texts.withColumn("text_id", F.monotonically_increasing_id()), "suffix-read")
    windows = stage(_shared_windows(texts), "suffix-windows")
    twice = windows.groupBy("run").agg(F.min("text_id").alias("a"), F.max("text_id").alias("b")).where("a != b")
    shared = split_join(windows, twice, ["run"]).select(
        "text_id", "start", F.when(F.col("a") == F.col("text_id"), F.col("b")).otherwise(F.col("a")).alias("other"))

    by_start = Window.partitionBy("text_id").orderBy("start")
    begins = F.coalesce(F.col("start") > F.lag("start").over(by_start) + PASSAGE, F.lit(True))
    spans = shared.withColumn("begins", begins).withColumn("span", F.sum(F.col("begins").cast("long")).over(by_start)).groupBy(
        "text_id", "span").agg(F.min("start").alias("first_word"), (F.max("start") - F.min("start") + PASSAGE).alias("n_words"), F.min("other").alias("other"))
    names = texts.select("text_id", *KEY)
    least = names.join(held, KEY).select(F.col("text_id").alias("other"), F.col("least").alias("other_doc_id"))
    spans = stage(split_join(spans, least, ["other"]).join(names, "text_id").select(*KEY, "first_word", "n_words", "other_doc_id"), "suffix-spans")

    whole = split_join(owners, held.where("ids > 1").drop("words"), KEY).select(
        "doc_id", F.lit(0).alias("first_word"), F.col("words").alias("n_words"),
        F.when(F.col("doc_id").eqNullSafe(F.col("least")), F.when(F.col("most") == F.col("least"), F.lit(None)).otherwise(F.col("most"))).otherwise(
            F.col("least")).alias("other_doc_id"))
    alone = held.where("ids = 1").select(*KEY, F.col("least").alias("doc_id"))
    return split_join(spans, alone, KEY).select("doc_id", "first_word", "n_words", "other_doc_id").unionByName(whole)
