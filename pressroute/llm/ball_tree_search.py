"""Ranked lexical search: exact inner products, with subtrees of sparse ball trees pruned best-first."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window, functions as F

from pressroute.llm.common import stage

#: Documents of one tree, and entries (document and term) after which a tree is closed early.
TREE_DOCS, TREE_ENTRIES = 4096, 2_000_000
LEAF_DOCS = 64
#: Items are searched for in blocks of about so many bytes of text; what a block sends to the tasks follows from it.
BLOCK_BYTES = 4 << 20
#: Float sums of up to 2**20 terms, none below zero, are off by less than this share.
SLACK = 1e-9

# A-Z to a-z; every other ASCII character that is no digit or letter separates terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(data: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return data.translate(_TERM_BYTES).split()


def term_vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id, n, terms, counts`` of every whole text: how many terms it has, and which of the vocabulary how often."""
    def compute(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        number = {t: i for i, t in enumerate(vocabulary)}
        for batch in batches:
            lengths, found, counts = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                words = terms(text.as_py() or b"")
                known = np.fromiter((number.get(w, -1) for w in words), np.int32, len(words))
                which, often = np.unique(known[known >= 0], return_counts=True)
                lengths.append(len(words))
                found.append(which.tobytes())
                counts.append(often.astype(np.int32).tobytes())
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(lengths, pa.int64()), pa.array(found, pa.binary()),
                                   pa.array(counts, pa.binary())], ["doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(compute, "doc_id long, n long, terms binary, counts binary")


def document_frequencies(vectors: DataFrame, size: int) -> DataFrame:
    """``term, df``: in how many documents each term of the vocabulary stands, added up in the tasks first."""
    def count(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(t.as_py() for t in batch.column(0)), np.int32), minlength=size)
        there = np.flatnonzero(total)
        yield pa.record_batch([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], ["term", "df"])

    return vectors.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class BallTree:
    """Balls around groups of sparse vectors. A node knows its centroid, the radius around it, and the largest value of
    each term, which is the same bound term by term."""

    def __init__(self, ids, starts, terms, values, size: int):
        import numpy as np

        self.np, self.ids, self.starts, self.terms, self.values, self.size = np, ids, starts, terms, values, size
        self.nodes: list[dict] = []
        self._build()

    def _entries(self, docs):
        """Places of the entries of some documents, and where each document's begin among them."""
        np = self.np
        lengths = self.starts[docs + 1] - self.starts[docs]
        begins = np.cumsum(lengths) - lengths
        return np.arange(lengths.sum()) + np.repeat(self.starts[docs] - begins, lengths), begins

    def _dense(self, doc: int):
        row = self.np.zeros(self.size)
        part = slice(self.starts[doc], self.starts[doc + 1])
        row[self.terms[part]] = self.values[part]
        return row

    def _build(self) -> None:
        np = self.np
        todo = [(np.arange(len(self.ids)), None)]
        while todo:
            docs, parent = todo.pop()
            at, begins = self._entries(docs)
            which, value = self.terms[at], self.values[at].astype(np.float64)
            mean = np.bincount(which, value, self.size) / len(docs)
            top = np.zeros(self.size)
            np.maximum.at(top, which, value)
            present = np.flatnonzero(top)
            square = np.add.reduceat(value * value, begins)

            def apart(other):  # squared distances, never too small by more than the slack added below
                return square - 2 * np.add.reduceat(value * other[which], begins) + other @ other

            away = apart(mean)
            node = {"present": present, "mean": mean[present], "top": top[present], "docs": docs, "children": [],
                    "radius": math.sqrt(max(0.0, (away + SLACK * (square + mean @ mean)).max()))}
            self.nodes.append(node)
            if parent is not None:
                parent["children"].append(node)
            if len(docs) <= LEAF_DOCS:
                continue
            one = apart(self._dense(docs[away.argmax()]))
            near = one <= apart(self._dense(docs[one.argmax()]))
            if near.all() or not near.any():  # copies of one text
                near = np.arange(len(docs)) < len(docs) // 2
            node["docs"] = None
            todo += [(docs[near], node), (docs[~near], node)]

    def bound(self, node: dict, query: dict) -> float:
        """No document below the node scores more: dot product with the centroid plus norm times radius, rounded up,
        or the sum of the terms' largest values, if that is less."""
        np = self.np
        place = np.searchsorted(node["present"], query["terms"])
        place[place == len(node["present"])] = 0
        there = node["present"][place] == query["terms"]
        place, weight = place[there], query["weights"][there]
        ball = float(weight @ node["mean"][place]) + query["norm"] * node["radius"]
        box = float(weight @ node["top"][place])
        return math.ceil(min(ball, box) * (1 + SLACK)) + 1 if box else 0

    def search(self, query: dict, best: list, keep: int) -> None:
        """Puts the documents that belong to the best into ``best``, a heap of (score, -id), at most ``keep`` long."""
        np = self.np
        dense = np.zeros(self.size, np.int64)
        dense[query["terms"]] = query["weights"]
        order = 0
        open_ = [(-self.bound(self.nodes[0], query), 0, self.nodes[0])]
        while open_:
            bound, _, node = heapq.heappop(open_)
            if -bound < (best[0][0] if len(best) == keep else 1):  # an equal score may still win by its id
                return
            for child in node["children"]:
                order += 1
                heapq.heappush(open_, (-self.bound(child, query), order, child))
            if node["children"]:
                continue
            at, begins = self._entries(node["docs"])
            scores = np.add.reduceat(self.values[at] * dense[self.terms[at]], begins)
            for i in np.flatnonzero(scores >= (best[0][0] if len(best) == keep else 1)).tolist():
                entry = (int(scores[i]), -self.ids[node["docs"][i]])
                if len(best) < keep:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)


def _search_block(vectors: DataFrame, queries: list[dict], size: int, n_docs: int, n_terms: int, keep: int) -> DataFrame:
    """``item, doc_id, score``: of each task's documents the best of every query."""
    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        asked = [{"item": q["item"], "terms": np.array(q["terms"], np.int64), "weights": np.array(q["weights"], np.int64),
                  "norm": math.sqrt(sum(w * w for w in q["weights"])) * (1 + SLACK)} for q in queries]
        best: list[list] = [[] for _ in asked]
        ids, rows, entries = [], [], 0

        def close() -> None:
            nonlocal entries
            if ids:
                starts = np.cumsum([0, *(len(t) for t, _ in rows)])
                tree = BallTree(np.array(ids, object), starts, np.concatenate([t for t, _ in rows]), np.concatenate([v for _, v in rows]), size)
                for query, heap in zip(asked, best):
                    tree.search(query, heap, keep)
            ids.clear(), rows.clear()
            entries = 0

        for batch in batches:
            for doc_id, n, which, often in zip(*(c.to_pylist() for c in batch.columns)):
                if not which:
                    continue
                count = np.frombuffer(often, np.int32).astype(np.int64)
                m = 10 + 90 * n * n_docs // n_terms
                ids.append(-math.inf if doc_id is None else doc_id)
                rows.append((np.frombuffer(which, np.int32), 1_000_000_000 * count // (1000 * count + 8 * m)))
                entries += len(count)
                if len(ids) == TREE_DOCS or entries >= TREE_ENTRIES:
                    close()
        close()
        found = [(q["item"], None if i == math.inf else -i, s) for q, heap in zip(asked, best) for s, i in heap]
        yield pa.record_batch([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))],
                              ["item", "doc_id", "score"])

    return vectors.mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, keep: int = 10, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``keep`` highest-scoring documents of every item, equal scores by ascending id.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), its value in a document 10^9 tf div (1000 tf + 8 m) with
    m = 10 + 90 n N div L; a score is the sum over the item's distinct terms of weight times value, in whole numbers.

    One pass keeps of each document only the terms that some item has, N, L and df are counted over all documents, and
    a second pass cuts every task's documents into trees and searches them for all items. Documents are never
    shuffled; what leaves a task is ``keep`` rows an item. Items go in blocks of about BLOCK_BYTES of text (one, if an
    item is longer), and a block's terms and weights are all that is sent to the tasks.

    Ids of documents are integers. Only documents with a score above 0 are ranked. A null or empty text has no terms;
    an item without terms, or an empty table, gives no rows. Each row is a document or an item of its own: repeated
    rows are ranked, and asked for, as often as they stand there. A null document id ranks behind its equals. Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    id_type = asked.schema["item_id"].dataType.simpleString()
    found = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        wanted = [sorted(set(terms((r.text or "").encode()))) for r in part]
        vocabulary = sorted(set().union(*wanted))
        if not vocabulary and (found is not None or block < blocks - 1):
            continue
        vectors = stage(term_vectors(rows, vocabulary), "search-vectors")
        total = vectors.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
        df = Counter({r.term: r.df for r in document_frequencies(vectors, len(vocabulary)).collect()})
        number = {t: i for i, t in enumerate(vocabulary)}
        weight = [math.floor(1000 * math.log((2 * total.docs + 2) / (2 * df[i] + 1))) for i in range(len(vocabulary))]
        queries = [{"item": i, "terms": (own := [number[t] for t in w if df[number[t]]]), "weights": [weight[k] for k in own]}
                   for i, w in enumerate(wanted)]
        best = _search_block(vectors, [q for q in queries if q["terms"]], len(vocabulary), total.docs, total.terms, keep)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(part)], f"item int, item_id {id_type}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).join(names, "item").select(
            "item_id", "rank", "doc_id", "score")
        found = ranked if found is None else found.unionByName(ranked)
    return found
