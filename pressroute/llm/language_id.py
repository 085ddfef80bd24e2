"""Language identification by unigrams over a fixed vocabulary, summed over all segmentations.

A word's probability in a language is the sum, over every way to cut it into vocabulary pieces,
of the product of the pieces' probabilities; a forward pass over its bytes gives that sum. The
probabilities come from expectation maximisation over the word counts of labelled rows.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pressroute.llm.bpe import Vocabulary, vocabulary
from pressroute.llm.common import stage

#: Words whose log-probabilities a worker keeps, about 250 bytes each; they stay for its next task.
CACHED_WORDS = 300_000
#: Bytes up to which plain products cannot underflow; longer words go by logarithms.
SHORT = 40
ROWS_PER_BATCH = 256
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    """Runs of letters in lower case; none if the text has no letter."""
    words = _WORD.findall(text.lower()) if text else []
    return words if any(c.isalpha() for w in words for c in w) else []


def _spans(data: bytes, voc: Vocabulary) -> list[tuple[int, int, int]]:
    """(start, end, piece) of every vocabulary piece in the data, by end."""
    return [(at + 1 - size, at + 1, piece) for at, (size, piece) in voc.automaton.iter(data.decode("latin-1"))]


def expected_pieces(word: str, probability: list[float], voc: Vocabulary) -> dict[int, float]:
    """Expected number of uses of each piece over all segmentations of the word (forward and backward sums)."""
    data = f" {word}".encode()
    spans = _spans(data, voc)
    if len(data) > SHORT:
        return _expected_long(len(data), spans, probability)
    ahead, back = [1.0] + [0.0] * len(data), [0.0] * len(data) + [1.0]
    for start, end, piece in spans:
        ahead[end] += ahead[start] * probability[piece]
    for start, end, piece in reversed(spans):  # by end, so what follows a span is complete
        back[start] += back[end] * probability[piece]
    found: dict[int, float] = {}
    for start, end, piece in spans:
        found[piece] = found.get(piece, 0.0) + ahead[start] * probability[piece] * back[end] / ahead[-1]
    return found


def _expected_long(size: int, spans: list[tuple[int, int, int]], probability: list[float]) -> dict[int, float]:
    """The same by logarithms."""
    logs = [math.log(probability[p]) for _, _, p in spans]
    ahead, back = [0.0] + [-math.inf] * size, [-math.inf] * size + [0.0]
    for (start, end, _), cost in zip(spans, logs):
        ahead[end] = float(np.logaddexp(ahead[end], ahead[start] + cost))
    for (start, end, _), cost in zip(reversed(spans), reversed(logs)):
        back[start] = float(np.logaddexp(back[start], back[end] + cost))
    found: dict[int, float] = {}
    for (start, end, piece), cost in zip(spans, logs):
        found[piece] = found.get(piece, 0.0) + math.exp(ahead[start] + cost + back[end] - ahead[-1])
    return found


class WordScores(dict):
    """Row of each word in a growing matrix of log-probabilities, one column per language."""

    def __init__(self, path: str, table: np.ndarray):
        super().__init__()
        self.voc, self.size = vocabulary(path), table.shape[0]
        self.table = [tuple(row) for row in table.T.tolist()]
        self.logs = np.zeros((4096, self.size))

    def score(self, data: bytes) -> list[float]:
        if len(data) > SHORT:
            return self._score_long(data)
        table, nothing = self.table, (0.0,) * self.size
        ahead = [(1.0,) * self.size] + [nothing] * len(data)
        for at, (size, piece) in self.voc.automaton.iter(data.decode("latin-1")):
            at += 1
            ahead[at] = [t + a * p for t, a, p in zip(ahead[at], ahead[at - size], table[piece])]
        return [math.log(x) for x in ahead[-1]]

    def _score_long(self, data: bytes) -> list[float]:
        ahead = [np.zeros(self.size)] + [np.full(self.size, -np.inf)] * len(data)
        for start, end, piece in _spans(data, self.voc):
            ahead[end] = np.logaddexp(ahead[end], ahead[start] + np.log(self.table[piece]))
        return ahead[-1].tolist()

    def __missing__(self, word: str) -> int:
        row = len(self)
        if row >= len(self.logs):
            self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
        self.logs[row] = self.score(f" {word}".encode())
        self[word] = row
        return row

    def forget(self) -> None:
        self.clear()
        self.logs = np.zeros((4096, self.size))

    def text(self, words: list[str]) -> np.ndarray:
        """Log-probability of a text's words in each language."""
        if len(self) >= CACHED_WORDS:
            self.forget()
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.logs[rows].sum(axis=0)


_loaded: dict[str, WordScores] = {}


class LanguageModel:
    """Piece probabilities of each language: ``table[language, piece]``; languages in order of name."""

    def __init__(self, path: str, languages: list[str], table: np.ndarray, name: str):
        self.path, self.languages, self.table, self.name = path, languages, table, name

    def scores(self) -> WordScores:
        """This worker's word scores; one model at a time is kept."""
        if self.name not in _loaded:
            _loaded.clear()
            _loaded[self.name] = WordScores(self.path, self.table)
        return _loaded[self.name]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its share of the likelihood of all; of equals, the first by name."""
        words = letter_words(text)
        if not words or not self.languages:
            return UNDETERMINED, 0.0
        logs = self.scores().text(words)
        best = int(np.argmax(logs))
        return self.languages[best], round(float(1 / np.exp(logs - logs[best]).sum()), 6)


def train_language_model(labelled: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
                         rows_per_language: int = 400, rounds: int = 2, smoothing: float = 0.1) -> LanguageModel:
    """Fit piece probabilities by expectation maximisation.

    Takes about ``rows_per_language`` labelled rows of each language, whole texts, chosen by a hash of
    their id: the bound that lets the fit cost the same at any size. Word counts and expected uses of
    pieces are summed by Spark; the driver gets one number per language and piece (the vocabulary's
    size times the number of languages). Rows without text or label are ignored; without any labelled
    row the model knows no language.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        "text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages, grain = sorted(sizes), 1 << 30
    voc, name = vocabulary(path), uuid.uuid4().hex
    table = np.full((len(languages), max(voc.tokens) + 1), 1.0 / len(voc.tokens))
    if not languages:
        return LanguageModel(path, languages, table, name)

    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(grain, math.ceil(rows_per_language / sizes[lang] * grain)))])
    chosen = rows.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(grain)) < share[F.col("lang")]).select("lang", "text")

    def words(batches):
        import pandas as pd

        for batch in batches:
            counts = Counter((lang, w) for lang, text in zip(batch["lang"], batch["text"]) for w in letter_words(text))
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["lang", "word", "n"])

    counts = stage(chosen.mapInPandas(words, "lang string, word string, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n")).repartition(spark.sparkContext.defaultParallelism), "language-words")

    for _ in range(rounds):
        now, at = table.tolist(), {lang: i for i, lang in enumerate(languages)}

        def uses(batches, now=now, at=at):
            import pandas as pd

            here = vocabulary(path)
            total: dict[tuple[str, int], float] = {}
            for batch in batches:
                for lang, word, n in zip(batch["lang"], batch["word"], batch["n"]):
                    for piece, x in expected_pieces(word, now[at[lang]], here).items():
                        total[lang, piece] = total.get((lang, piece), 0.0) + n * x
            yield pd.DataFrame([(*k, x) for k, x in total.items()], columns=["lang", "piece", "uses"])

        summed = counts.mapInPandas(uses, "lang string, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))
        table = np.full(table.shape, smoothing)
        for r in summed.collect():
            table[at[r["lang"]], r["piece"]] += r["uses"]
        table /= table.sum(axis=1, keepdims=True)
    return LanguageModel(path, languages, table, name)


def identify_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None,
                      names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """The columns of ``keep`` with the language and its score (0 to 1) under ``names``, from the whole text alone.

    ``und`` with score 0 if the text is null or has no letter, or if the model knows no language. Of
    equally likely languages the first by name. Repeated rows and null ids pass through; columns that
    are not named in ``keep`` are ignored.
    """
    import pyarrow as pa

    keep = keep or []

    def predict(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_BATCH):
                part = batch.slice(at, ROWS_PER_BATCH)
                found = [model.predict(t.as_py()) for t in part.column(len(keep))]
                yield pa.record_batch([*[part.column(i) for i in range(len(keep))], pa.array([f[0] for f in found], pa.string()),
                                       pa.array([f[1] for f in found], pa.float64())], [*keep, *names])

    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    fields = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keep)
    return rows.mapInArrow(predict, f"{fields}`{names[0]}` string, `{names[1]}` double")
