"""Held-out texts leaking into training texts, by a BM25 index of the held-out items and block-max WAND (problem 7).

The terms of the index are pairs of successive words, which tell apart texts that share a vocabulary. Every document is cut into passages of 2 * RUN words that begin every RUN words, so that each run of RUN words lies
whole in some passage. Each passage is a query against the inverted index of the items; all items above a threshold are
retrieved. The threshold is an item's own: the least BM25 score that RUN successive words of it can reach, by which its
impacts are divided, so that 1 is the threshold of all and no leak is missed. Retrieved items are then checked word for
word.
"""

from __future__ import annotations

from bisect import bisect_left
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate, pairwise
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.plans.runtime import spread

K1, B = 1.2, 0.75
BLOCK = 32
#: Items of one index; more items are held in several indexes, one after the other.
ITEMS = 20_000

words_of = re.compile(r"[^\W_]+").findall


def terms_of(w: list[str]) -> list[str]:
    """The terms of successive words: their pairs."""
    return [f"{a} {b}" for a, b in pairwise(w)]


class Index:
    """BM25 postings in blocks with their greatest impacts."""

    def __init__(self, items: list[tuple[int, str]], run: int):
        self.run = run
        texts = [(i, w) for i, t in items if t and len(w := words_of(t.lower())) >= run]
        self.ids = [i for i, _ in texts]
        self.grams = [{" ".join(w[i : i + run]) for i in range(len(w) - run + 1)} for _, w in texts]
        terms = [terms_of(w) for _, w in texts]
        n, mean, span = len(texts), sum(map(len, terms)) / max(1, len(texts)), run - 1
        df = Counter(x for w in terms for x in set(w))
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for at, w in enumerate(terms):
            tf = Counter(w)
            impact = {x: log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * k * (K1 + 1) / (k + K1 * (1 - B + B * len(w) / mean)) for x, k in tf.items()}
            floor = min(sum(impact[x] for x in set(w[i : i + span])) for i in range(len(w) - span + 1)) * (1 - 1e-9)
            for x, s in impact.items():
                postings[x].append((at, s / floor))
        self.most = {x: max(s for _, s in p) for x, p in postings.items()}
        # Of each term: items in order, impacts, greatest impact of each block.
        self.lists = {x: ([a for a, _ in p], [s for _, s in p], [max(s for _, s in p[i : i + BLOCK]) for i in range(0, len(p), BLOCK)]) for x, p in postings.items()}

    def above(self, query: set[str]) -> list[int]:
        """Places of all items whose score for the terms of ``query`` is 1 or more."""
        cursors = [[*self.lists[x], self.most[x], 0] for x in query if x in self.lists]
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0][c[4]])
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += c[3]
                if total >= 1:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0][cursors[pivot][4]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0][cursors[pivot + 1][4]] == item:
                pivot += 1
            upto = cursors[: pivot + 1]
            # The blocks in which the item would stand.
            bound, ends = 0.0, []
            for c in upto:
                ids = c[0]
                p = bisect_left(ids, item, c[4])
                if p < len(ids):
                    b = p // BLOCK
                    bound += c[2][b]
                    ends.append(ids[min((b + 1) * BLOCK, len(ids)) - 1])
            if bound < 1:
                target = min([*(e + 1 for e in ends), *(c[0][c[4]] for c in cursors[pivot + 1 : pivot + 2])], default=item + 1)
                target = max(target, item + 1)
            elif upto[0][0][upto[0][4]] == item:
                if sum(c[1][c[4]] for c in upto) >= 1:
                    found.append(item)
                target = item + 1
            else:
                target = item
            for c in upto:
                c[4] = bisect_left(c[0], target, c[4])  # postings of skipped blocks aren't walked
            cursors = [c for c in cursors if c[4] < len(c[0])]
        return found

    def leaks(self, text: str) -> set[int]:
        """Ids of the items that share ``run`` successive words with ``text``."""
        run, out = self.run, set()
        w = words_of(text.lower())
        if len(w) < run:
            return out
        most, terms = self.most, terms_of(w)
        sums = [0.0, *accumulate(most.get(x, 0.0) for x in terms)]
        for a in range(0, max(1, len(w) - run + 1), run):
            z = min(a + 2 * run, len(w))
            if sums[z - 1] - sums[a] < 1:
                continue
            passage = w[a:z]
            grams = None
            for item in self.above(set(terms[a : z - 1])):
                if self.ids[item] in out:
                    continue
                grams = grams or {" ".join(passage[i : i + run]) for i in range(len(passage) - run + 1)}
                if not grams.isdisjoint(self.grams[item]):
                    out.add(self.ids[item])
        return out


def leaked(documents: DataFrame, items: DataFrame, run: int = 13) -> DataFrame:
    """(doc_id, item_id): documents and the items with which they share ``run`` successive words.

    ``documents``: doc_id, text; ``items``: item_id, text. Texts that are null or too short, and null ids, are no cases;
    repeated rows give one row; empty tables give an empty result. Documents are read once, without a shuffle before the
    few results, for each index of ``ITEMS`` items.
    """
    spark = documents.sparkSession
    src = spread(documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()))
    clean = items.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    blocks = max(1, -(-clean.count() // ITEMS))
    out = None
    for k in range(blocks):
        some = clean.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()  # about ITEMS items
        held = spark.sparkContext.broadcast(Index([tuple(r) for r in some], run))

        def find(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in batches:
                hits = [(d, i) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i in index.leaks(t)]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in hits], pa.int64()), pa.array([i for _, i in hits], pa.int64())], ["doc_id", "item_id"])

        part = src.mapInArrow(find, "doc_id long, item_id long")
        out = part if out is None else out.unionByName(part)
    return out.distinct()
