"""Benchmark decontamination by a positional inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pressroute.llm.common import alnum_words, count_alnum_words, key_map, once, stage, with_key_flag
from pressroute.operators.joins import split_join

#: Words of a window; an item of fewer words is one window.
WINDOW_WORDS = 13
#: Rarest words of a window whose posting lists are intersected.
RAREST = 3
#: A text is told from others by two independent 64-bit hashes; every match is verified in the text itself.
KEY = ["k1", "k2"]


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit("second"), F.col("text"))})


def _bits(offset: str) -> Column:
    return F.call_function("shiftleft", F.lit(1), F.col(offset))


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, window, n``: every distinct window of each item as words joined by spaces, and its number of words."""
    words = items.select(F.col(id_col).cast("string").alias("item_id"), alnum_words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (WINDOW_WORDS - 1), F.lit(1)))
    cut = words.select("item_id", "words", F.explode(starts).alias("start")).select(
        "item_id", F.slice("words", F.col("start"), F.lit(WINDOW_WORDS)).alias("cut"))
    return cut.select("item_id", F.concat_ws(" ", "cut").alias("window"), F.size("cut").alias("n")).distinct()


def rarest_terms(windows: DataFrame, texts: DataFrame) -> DataFrame:
    """``window, term, offset, need``: each distinct window's rarest words in the corpus, ``need`` of them.

    Word counts are summed map-side over all texts before they meet the windows' words (an inner join,
    since the optimizer would move a semi join below the sum). A window with a word that no text has is
    left out: it cannot occur.
    """
    terms = windows.select("window").distinct().select("window", F.posexplode(F.split("window", " ")).alias("offset", "term"))
    counts = texts.select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    counts = stage(counts.join(terms.select("term").distinct(), "term"), "decontaminate-counts")
    ranked = split_join(terms, counts, ["term"], "left").withColumns({
        "place": F.row_number().over(Window.partitionBy("window").orderBy(F.col("n").asc_nulls_first(), "offset")),
        "least": F.min(F.coalesce("n", F.lit(0))).over(Window.partitionBy("window"))})
    return ranked.where((F.col("place") <= RAREST) & (F.col("least") > 0)).select(
        "window", "term", "offset", F.least(F.lit(RAREST), F.size(F.split("window", " "))).alias("need"))


def positional_index(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, k1, k2, pos``: every place of the given terms in the texts."""
    places = texts.select(*KEY, F.posexplode("words").alias("pos", "term"))
    return places.join(terms, "term", "left_semi").select("term", *KEY, "pos")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, spans, item_ids``.

    ``spans`` holds (start, n) of every place where a window of an item stands in the text's words,
    ``item_ids`` the items (as text, sorted) with such a window; both are empty arrays where there is none.

    The rarest words of each window are looked up in the positional index; their lists, moved by the
    words' offsets, must meet at one start. Surviving places are compared with the text word by word.
    Texts that are equal share their postings. Only texts with a surviving place are read again: a
    bitmap of fixed size picks them, and an exact join follows.

    Null and empty texts have no words and no spans; items without words are ignored; repeated rows
    give repeated rows; null ids pass through. Without items, nothing is contaminated.
    """
    rows = _keyed(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    texts = rows.select(*KEY, alnum_words(F.col("text")).alias("words"))
    windows = stage(benchmark_windows(items, item_id_col, item_text_col), "decontaminate-windows")
    seeds = stage(rarest_terms(windows, texts), "decontaminate-seeds")
    terms = stage(seeds.select("term").distinct(), "decontaminate-terms")
    index = stage(positional_index(texts, terms), "decontaminate-index")

    meets = split_join(index, seeds, ["term"]).withColumn("start", F.col("pos") - F.col("offset")).where("start >= 0")
    places = meets.groupBy("window", "need", *KEY, "start").agg(F.bit_or(_bits("offset")).alias("met")).where(F.bit_count("met") == F.col("need"))
    wanted = stage(places.groupBy(*KEY).agg(F.collect_list(F.struct("start", "window")).alias("places")), "decontaminate-places")

    again = with_key_flag(rows, key_map(wanted, KEY, "decontaminate-texts"), KEY, "again").where("again")
    distinct = split_join(again.select(*KEY, "text"), wanted.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.first("text").alias("text"))
    stands = lambda words: F.filter(F.transform("places", lambda p: F.struct(
        p["start"].alias("start"), p["window"].alias("window"), F.size(F.split(p["window"], " ")).alias("n"))), lambda p: F.concat_ws(
            " ", F.slice(words, p["start"] + 1, p["n"])) == p["window"])
    checked = distinct.join(wanted, KEY).select(*KEY, once(alnum_words(F.col("text")), stands).alias("places")).where(F.size("places") > 0)
    verified = stage(checked, "decontaminate-verified")

    found = verified.select(*KEY, F.explode(F.array_distinct(F.transform("places", lambda p: p["window"]))).alias("window"))
    owners = split_join(found, windows.select("window", "item_id"), ["window"]).groupBy(*KEY).agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    spans = verified.select(*KEY, F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["n"].alias("n"))).alias("spans"))
    hits = stage(spans.join(owners, KEY), "decontaminate-hits")

    sized = stage(rows.select("doc_id", *KEY, count_alnum_words(F.col("text")).alias("n_words")), "decontaminate-sizes")
    none = "array<struct<start:int,n:int>>"
    return split_join(sized, hits, KEY, "left").select(
        "doc_id", "n_words", F.coalesce(F.array_distinct("spans"), F.array().cast(none)).alias("spans"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def words_hit(spans: Column) -> Column:
    """Number of word positions inside any span."""
    return F.size(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))).cast("long")


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
