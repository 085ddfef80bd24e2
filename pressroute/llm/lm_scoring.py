"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised: count c has level 1 + floor(log2(c)). An n-gram is put
into the filter once for each level up to its own, so asking for level 1, 2, .. until one is missing gives the
level back, and never too small a one.

Every word and pair of the corpus is kept, so the filter grows with the corpus. It is cut into parts by
ranges of the n-grams' hashes and never gathered in one place: the distinct n-grams of some texts are sent to the
parts that hold them, and the levels found are sent back to where the texts' scores are added up.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pressroute.llm.common import ascii_lower, stage
from pressroute.operators.joins import split_join

#: Stands for the end of a text; no word holds white space.
END = "\n"
#: Bits of the filter for each entry, and probes for each.
BITS, PROBES = 10, 3
#: Training tokens for each part of the filter, and the fewest parts. Nothing else decides how many there are, since
#: the filter's mistakes, and with them the scores, hang on it.
PART_TOKENS, LEAST_PARTS = 4_000_000, 16
#: Weight of the word's own probability against the pair's count.
PRIOR = 500.0
#: Most common words whose exact counts are broadcast, and the bytes a word among them may have: 30 MB at most.
COMMON_WORDS, COMMON_BYTES = 300_000, 64
#: Words that a worker keeps while it reads a task, about 200 bytes each.
CACHED_WORDS = 60_000
#: Pairs a task gathers before it sums and hands them on.
GATHERED = 2_000_000
#: Tokens read together, and tokens whose n-grams are looked up together.
TOKENS_AT_ONCE, LOOKED_UP = 200_000, 2_000_000
#: N-grams whose places in the filter are found together.
PLACED = 500_000

_STEP = 0x9E3779B97F4A7C15
_GOLDEN = np.uint64(_STEP)


def _mix(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values (the finaliser of a public random generator, splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_gram(words: np.ndarray) -> np.ndarray:
    """Odd numbers."""
    return _mix(words + _GOLDEN) | np.uint64(1)


def pair_gram(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Even numbers."""
    return _mix(_mix(before) + words * _GOLDEN) & ~np.uint64(1)


def word_hash(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word)


def words_of(text: bytes | None) -> list[bytes]:
    """Words with A-Z in lower case, and the end."""
    return [*(text or b"").lower().split(), END.encode()]


def levels(counts: np.ndarray, unit: int = 1) -> np.ndarray:
    """0 below one unit, 1 from there, one more with each doubling."""
    return np.frexp((counts // unit).astype(np.float64))[1]


def count_of_level(level: np.ndarray, unit: int = 1) -> np.ndarray:
    """The middle of the counts that have this level; 0 for level 0."""
    return np.where(level > 0, (3 * unit * np.exp2(level.astype(np.float64) - 1) - 1) / 2, 0.0)


def _place(grams: np.ndarray, level: int, probe: int, size: np.ndarray) -> np.ndarray:
    """The bit number that this probe reads, within ``size`` bits."""
    return (_mix(grams + np.uint64((level * PROBES + probe) * _STEP % 2**64)) >> np.uint64(32)) * size >> np.uint64(32)


def make_bits(grams: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The bytes of a filter that holds every n-gram up to its level."""
    size = max(64, int(level.sum()) * BITS + 7 & ~7)
    bits = np.zeros(size, bool)
    for start in range(0, len(grams), PLACED):  # a part holds millions of n-grams: their places are found a slice at a time
        own, own_level = grams[start:start + PLACED], level[start:start + PLACED]
        for at in range(1, int(own_level.max(initial=0)) + 1):
            reached = own[own_level >= at]
            for probe in range(PROBES):
                bits[_place(reached, at, probe, np.uint64(size))] = True
    return np.packbits(bits, bitorder="little")


def number(grams: np.ndarray, parts: int) -> np.ndarray:
    """N-grams as numbers, 2**32 for each part. A part has some million n-grams, so far fewer share one than the filter mistakes."""
    low, parts = np.uint64(2**32 - 1), np.uint64(parts)
    return (grams >> np.uint64(32)) * parts + ((grams & low) * parts >> np.uint64(32))


def part_of(numbers: np.ndarray) -> np.ndarray:
    """The part of a number: numbers in order are in the order of their parts."""
    return (numbers >> np.uint64(32)).astype(np.int64)


class Filter:
    """The filter's parts that are here, end to end."""

    def __init__(self, parts: int, held: dict[int, bytes]):
        self.parts = parts
        self.start, self.size, self.here = np.zeros(parts, np.uint64), np.full(parts, 64, np.uint64), np.zeros(parts, bool)
        blobs, at = [], 0
        for part, blob in sorted(held.items()):
            self.start[part], self.size[part], self.here[part] = at, len(blob) * 8, True
            blobs.append(blob)
            at += len(blob) * 8
        self.bytes = np.frombuffer(b"".join(blobs) or b"\0" * 8, np.uint8)

    def level(self, grams: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Asks for level after level until one is missing; a part without n-grams has none."""
        found, active, at = np.zeros(len(grams), np.int64), np.flatnonzero(self.here[part]), 1
        while len(active):
            start, size = self.start[part[active]], self.size[part[active]]
            for probe in range(PROBES):
                bit = start + _place(grams[active], at, probe, size)
                there = (self.bytes[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                active, start, size = active[there], start[there], size[there]
            found[active] = at
            at += 1
        return found


def _pack(values: np.ndarray) -> bytes:
    """Bytes by significance, which the shuffle's compression then shortens."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(np.frombuffer(data, np.uint8).reshape(size, -1).T.tobytes(), kind)


def _summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in order, and their summed counts."""
    order = np.argsort(grams, kind="stable")  # runs that are in order already are merged
    grams, counts = grams[order], counts[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.add.reduceat(counts, first)


def _pack_grams(grams: np.ndarray) -> bytes:
    """Packs n-grams that are in order."""
    return _pack(np.diff(grams, prepend=np.uint64(0)))


def _unpack_grams(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def _ends(grams: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins in n-grams that are in order, and the end."""
    return np.searchsorted(part_of(grams), np.arange(parts + 1))


def _by_part(grams: np.ndarray, counts: np.ndarray, parts: int) -> Iterator:
    """A row (part, grams, counts) of each part; ``grams`` in order."""
    import pyarrow as pa

    ends = _ends(grams, parts)
    for part in np.flatnonzero(np.diff(ends)):
        own = slice(ends[part], ends[part + 1])
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([_pack_grams(grams[own])], pa.binary()),
                               pa.array([_pack(counts[own])], pa.binary())], ["part", "grams", "counts"])


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found = word_hash(word)
        return found


def gather_pairs(training: DataFrame, parts: int) -> DataFrame:
    """``part, grams, counts``: summed counts of word pairs, each task's pairs of a part in one row."""
    def gather(batches: Iterator):
        import pyarrow as pa

        def rows(words: list[np.ndarray], heads: list[np.ndarray]):
            word, head = np.concatenate(words), np.concatenate(heads)
            yield from _by_part(*_summed(number(pair_gram(head, word), parts), np.ones(len(word), np.int64)), parts)

        known, words, heads, held = _Hashes(), [], [], 0
        end = np.array([word_hash(END.encode())], np.uint64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                own = words_of(text.as_py())
                hashes = np.fromiter(map(known.__getitem__, own), np.uint64, len(own))
                words.append(hashes)
                heads += [end, hashes[:-1]]
                held += len(own)
                if held >= GATHERED:
                    yield from rows(words, heads)
                    words, heads, held = [], [], 0
        if held:
            yield from rows(words, heads)

    return training.mapInArrow(gather, "part int, grams binary, counts binary")


def gather_words(counts: DataFrame, parts: int) -> DataFrame:
    """The same of single words, from their exact counts."""
    def gather(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                words = np.fromiter((word_hash(w.as_py()) for w in batch.column(0).cast(pa.binary())), np.uint64, batch.num_rows)
                yield from _by_part(*_summed(number(word_gram(words), parts), batch.column(1).to_numpy()), parts)

    return counts.select("token", "c").mapInArrow(gather, "part int, grams binary, counts binary")


def build_filter(gathered: DataFrame) -> DataFrame:
    """``part, bits``: the filter's parts. Each has its own size, by the entries it holds."""
    def build(frame):
        import pandas as pd

        grams = np.concatenate([_unpack_grams(x) for x in frame["grams"]])
        grams, counts = _summed(grams, np.concatenate([_unpack(x, np.int64) for x in frame["counts"]]))
        return pd.DataFrame({"part": frame["part"].iloc[:1], "bits": [make_bits(grams, levels(counts)).tobytes()]})

    return gathered.groupBy("part").applyInPandas(build, "part int, bits binary")


class _Words(dict):
    """This worker's words: hash, and the exact count if the word is common (else -1)."""

    def __init__(self, common: dict[bytes, int]):
        super().__init__()
        self.common = common
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.hash, self.exact = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def rows(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.forget()
        fresh = [w for w in set(words) if w not in self]
        if fresh:
            hashes = np.fromiter(map(word_hash, fresh), np.uint64, len(fresh))
            self.update(zip(fresh, range(len(self), len(self) + len(fresh))))
            self.hash = np.concatenate([self.hash, hashes])
            self.exact = np.concatenate([self.exact, np.fromiter((self.common.get(w, -1) for w in fresh), np.int64, len(fresh))])
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


_state: dict[str, _Words] = {}


def score_documents(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    keep: list[str] | None = None) -> DataFrame:
    """One row per input row: ``doc_id``, the ``keep`` columns, ``n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are the words (A-Z in lower case, cut at ASCII white space) and one end. ``base_score`` is the sum of
    log10((c + 0.5) / (N + 0.5 (V + 1))) with exact training counts: common words from a broadcast table of bounded
    size, all others by a join. ``score`` is the sum of log10 p(word | word before), where
    p = (c(before, word) + PRIOR p(word)) / (c(before) + PRIOR), p(word) as in the base, and all counts c are what
    the filter says; every word and pair of the training rows is in it.

    A null text is empty: one token, the end. Null ids and repeated rows pass through. Without training rows every
    count is 0. An empty table gives an empty result; further columns are ignored.
    """
    spark, keep = docs.sparkSession, keep or []
    lowered = training.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = F.array_remove(F.split(ascii_lower(F.col("text")), r"[\x20\x09-\x0D]+"), "")
    counts = stage(lowered.select(F.explode(F.concat(words, F.array(F.lit(END)))).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("c")), "lm-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, scale = total["n"], total["n"] + 0.5 * (total["v"] + 1)
    common = _common_words(counts)

    parts = max(LEAST_PARTS, -(-n // PART_TOKENS))
    filters = stage(build_filter(gather_pairs(lowered, parts).unionByName(gather_words(counts, parts))), "lm-filter")
    given = docs.select(F.col(id_col).alias("doc_id"), *[F.col(k).alias(f"__keep{i}") for i, k in enumerate(keep)],
                        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = given.columns[:-1]
    fields = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in names)
    told = stage(given.mapInArrow(_reader(len(names), parts, spark.sparkContext.broadcast(common), scale, uuid.uuid4().hex), ", ".join(
        [fields, *(f"{c} {kind}" for c, kind in TOLD)])), "lm-read")
    scored = told.where("n_tokens is not null").select(*names, "n_tokens", "base", "known", "rare", "times")
    asked = told.where("part is not null").select("asker", "part", "words", "pairs")
    found = asked.groupBy("part").cogroup(filters.groupBy("part")).applyInPandas(_answer, "asker long, part int, words binary, pairs binary")
    texts = told.where("sizes is not null").select("asker", "words", "tokens", "sizes", "rows")
    scores = texts.groupBy("asker").cogroup(found.groupBy("asker")).applyInPandas(_adder(parts, scale), "row long, score double")

    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select(
        "row", F.col("r.rare").alias("token"), F.col("r.times").alias("times"))
    rare = split_join(rare, counts, ["token"], "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(float(scale)))).alias("rare_base"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    return scored.drop("rare", "times").join(scores, "row").join(rare, "row", "left").select(
        "doc_id", *[F.col(f"__keep{i}").alias(k) for i, k in enumerate(keep)], "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "score")


def _common_words(counts: DataFrame) -> dict[bytes, int]:
    """Exact counts of the words down to a count at which they are COMMON_WORDS at most."""
    step = F.floor(F.log2("c") * 4)
    short = counts.where(F.octet_length("token") <= COMMON_BYTES)
    most, least = 0, None
    for r in short.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():
        most += r["n"]
        if most > COMMON_WORDS:
            break
        least = r["step"]
    if least is None:
        return {}
    return {r["token"].encode(): r["c"] for r in short.where(step >= least).collect()}


#: What ``_reader`` tells besides the rows' own columns.
TOLD = [("n_tokens", "long"), ("base", "double"), ("known", "long"), ("rare", "array<string>"), ("times", "array<long>"), ("asker", "long"),
        ("part", "int"), ("words", "binary"), ("pairs", "binary"), ("tokens", "binary"), ("sizes", "binary"), ("rows", "binary")]


def _reader(keys, parts, common, scale, name):
    """Three kinds of rows; ``name`` tells this call's state in a worker from another's.

    Of each text the exact counts (up to ``times``). Of some texts together, named by the first one's row: for each
    part the numbers of distinct words and pairs to look up in it, in order; and what adds the scores up: the distinct
    words' hashes, each token as a place in them, the texts' sizes and rows.
    """
    def read(batches: Iterator):
        import pandas as pd
        import pyarrow as pa

        if name not in _state:
            _state.clear()
            _state[name] = _Words(common.value)
        known = _state[name]
        kinds = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()),
                 "array<long>": pa.list_(pa.int64())}
        words, sizes, rows = [], [], []

        def told(own: list, n: int, **values):
            return pa.record_batch([*own, *[pa.array(values[c], kinds[k]) if c in values else pa.nulls(n, kinds[k]) for c, k in TOLD]],
                                   [*names, *[c for c, _ in TOLD]])

        def counted(own: list, texts: list[list[bytes]]):
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            starts = np.cumsum(size) - size
            tokens = [t for text in texts for t in text]
            at = known.rows(tokens)
            hashes, exact = known.hash[at], known.exact[at]
            words.append(hashes)
            sizes.append(size)
            rows.append(own[-1].to_numpy())
            rare = [Counter(tokens[i].decode() for i in np.flatnonzero(exact[a:a + n] < 0) + a) for a, n in zip(starts, size)]
            return told(own, len(texts), n_tokens=size, known=np.add.reduceat((exact >= 0).astype(np.int64), starts),
                        base=np.add.reduceat(np.where(exact >= 0, np.log10((np.maximum(exact, 0) + 0.5) / scale), 0.0), starts),
                        rare=[list(c) for c in rare], times=[list(c.values()) for c in rare])

        def together():
            word, size, asker = np.concatenate(words), np.concatenate(sizes), int(rows[0][0])
            tokens, distinct = pd.factorize(word)  # numbered as they come, so common words have low numbers
            singles = np.unique(number(word_gram(distinct), parts))
            pairs = np.sort(pd.unique(number(pair_gram(_before(word, size), word), parts)))
            nothing = [pa.nulls(1, kind) for kind in key_kinds]
            yield told(nothing, 1, asker=[asker], words=[distinct.tobytes()], tokens=[zlib.compress(_pack(tokens.astype(np.int32)), 1)],
                       sizes=[_pack(size)], rows=[_pack(np.concatenate(rows))])
            one, two = _ends(singles, parts), _ends(pairs, parts)
            asked = np.flatnonzero(np.diff(one) + np.diff(two))
            nothing = [pa.nulls(len(asked), kind) for kind in key_kinds]
            yield told(nothing, len(asked), asker=np.full(len(asked), asker), part=asked.astype(np.int32),
                       words=[_pack_grams(singles[one[p]:one[p + 1]]) for p in asked], pairs=[_pack_grams(pairs[two[p]:two[p + 1]]) for p in asked])
            for held in (words, sizes, rows):
                held.clear()

        for batch in batches:
            names, key_kinds = batch.schema.names[:keys], batch.schema.types[:keys]
            texts, from_row, n_held = [], 0, 0
            for at, text in enumerate(batch.column(keys).cast(pa.binary()), 1):
                texts.append(words_of(text.as_py()))
                n_held += len(texts[-1])
                if n_held >= TOKENS_AT_ONCE or at == batch.num_rows:
                    yield counted([batch.column(i).slice(from_row, at - from_row) for i in range(keys)], texts)
                    texts, from_row, n_held = [], at, 0
                    if sum(map(len, words)) >= LOOKED_UP:
                        yield from together()
        if words:
            yield from together()
        known.forget()

    return read


def _answer(asked, held):
    """The levels of all n-grams that are looked up in one part, one asker's at a time: a part is asked by every
    asker, so their n-grams together grow with the corpus, while one asker's are bounded by LOOKED_UP."""
    import pandas as pd

    found = Filter(1, {0: bytes(x) for x in held["bits"]})

    def levels_of(column) -> list[bytes]:
        def one(data) -> bytes:
            grams = _unpack_grams(data)
            return found.level(grams, np.zeros(len(grams), np.int64)).astype(np.int8).tobytes()

        return [one(x) for x in column]

    return pd.DataFrame({"asker": asked["asker"], "part": asked["part"], "words": levels_of(asked["words"]), "pairs": levels_of(asked["pairs"])})


def _before(word: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The hash before each token's, the end's at the start of a text."""
    end = np.array([word_hash(END.encode())], np.uint64)
    before = np.concatenate([end, word[:-1]])
    before[np.cumsum(sizes) - sizes] = end
    return before


def _adder(parts, scale):
    """Scores of the texts that were looked up together."""
    def add(texts, found):
        import pandas as pd

        text, found = texts.iloc[0], found.sort_values("part")
        single, pair = (count_of_level(np.frombuffer(b"".join(found[c]), np.int8)) for c in ("words", "pairs"))
        distinct, sizes = np.frombuffer(text["words"], np.uint64), _unpack(text["sizes"], np.int64)
        tokens = _unpack(zlib.decompress(text["tokens"]), np.int32)
        starts, word = np.cumsum(sizes) - sizes, distinct[tokens]
        alone = single[np.unique(number(word_gram(distinct), parts), return_inverse=True)[1]]
        at_end = alone[tokens[sizes[0] - 1]]  # every text has the end as its last token
        alone = alone[tokens]
        seen = np.concatenate([[at_end], alone[:-1]])
        seen[starts] = at_end
        own, numbers = pd.factorize(number(pair_gram(_before(word, sizes), word), parts))
        held = np.empty(len(numbers))
        held[np.argsort(numbers)] = pair
        logs = np.log10((np.minimum(held[own], seen) + PRIOR * (alone + 0.5) / scale) / (seen + PRIOR))
        return pd.DataFrame({"row": _unpack(text["rows"], np.int64), "score": np.add.reduceat(logs, starts)})

    return add
