"""Blocks of queries against blocks of items: pairs are scored in memory, and only what can still win is written."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.plans.runtime import stage, width

#: Rows of a block of queries, and of one of items unless they are narrow.
BLOCK = 50_000


def in_blocks(queries: DataFrame, items: DataFrame, keys: tuple[str, str], run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, most: int = BLOCK, staged: bool = False, few: bool = False) -> DataFrame:
    """``run`` over each pair of a block of ``queries`` and a block of ``items``, as Arrow tables without empty ones.

    Blocks of items have about ``most`` rows. ``keys`` are the keys of both sides, by which they are dealt out. A row travels once for each block of the other side;
    small queries are cut further until all tasks have work, or, if they are ``few`` beside the items, the items. No row of a pair is shuffled but what ``run``
    returns. ``staged``: the items are a staged table.
    """
    asked, index = stage(queries, "asked"), items if staged else stage(items, "items")
    n, m = asked.count(), index.count()
    c, b, tasks = max(1, -(-m // most)), max(1, -(-n // BLOCK)), width(asked.sparkSession)
    if few:
        c = max(c, min(-(-tasks // b), -(-m // 2000)))
    else:
        b = max(b, min(-(-tasks // c), -(-n // 200)))
    other = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    at = lambda key, of: F.pmod(F.xxhash64(key), F.lit(of)).cast("int")
    q = asked.withColumn("_b", at(keys[0], b)).withColumn("_c", other(c)).groupBy("_b", "_c")
    x = index.withColumn("_c", at(keys[1], c)).withColumn("_b", other(b)).groupBy("_b", "_c")
    return q.cogroup(x).applyInArrow(_whole(run, pa_schema(asked, schema)), schema)


def pa_schema(df: DataFrame, schema: str) -> pa.Schema:
    """The Arrow schema of Spark's ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)


def _whole(run: Callable, schema: pa.Schema) -> Callable:
    """``run`` where both sides have rows, else no row."""

    def both(q: pa.Table, x: pa.Table) -> pa.Table:
        return run(q, x).cast(schema) if q.num_rows and x.num_rows else schema.empty_table()

    return both


def column(t: pa.Table, name: str) -> pa.Array:
    """A column in one piece."""
    c = t[name].combine_chunks()
    return c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks)


def listed(t: pa.Table, *names: str, step: int = 2000) -> Iterator[tuple]:
    """The rows of some columns, a few at a time as Python's values."""
    for k in range(0, t.num_rows, step):
        yield from zip(*(t[c].slice(k, step).to_pylist() for c in names), strict=True)


def entries(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The entries of all lists, and the row of each."""
    return pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)


def joined_words(texts: pa.Array) -> pa.Array:
    """The words of texts that are joined by single blanks, as lists; of an empty text, none."""
    lists = pc.split_pattern(texts, " ")
    return pc.if_else(pc.equal(texts, ""), pa.scalar([], lists.type), lists)


def nearest(q: pa.Table, x: pa.Table, k: int, least: float, step: int = 100) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of ``q`` the rows of ``x`` (``name``) whose ``v`` is nearest by cosine, at least ``least``, ascending, and the cosines.

    The ``k`` best, and those that tie with the last one. Vectors of different lengths never meet; a row isn't its own answer if ``qid`` and ``name`` are of one type.
    """
    out = [(np.zeros(0, np.int64), np.zeros(0))] * q.num_rows
    asked, known = column(q, "v"), column(x, "v")
    sizes, lengths = (pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False) for v in (asked, known))
    same = q.schema.field("qid").type == x.schema.field("name").type
    place = {w: i for i, w in enumerate(column(x, "name").to_pylist())} if same else {}
    own = np.array([place.get(w, -1) for w in column(q, "qid").to_pylist()], np.int64)

    def unit(v: pa.Array, rows: np.ndarray, size: int) -> np.ndarray:
        m = pc.list_flatten(v.take(pa.array(rows))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    for size in np.intersect1d(sizes, lengths)[::-1].tolist():
        if not size:
            continue
        rows, those = np.flatnonzero(lengths == size), np.flatnonzero(sizes == size)
        m = unit(known, rows, size).T
        for at in range(0, len(those), step):  # a few at a time, for memory
            some = those[at : at + step]
            cosines = unit(asked, some, size) @ m
            for i, c in zip(some.tolist(), cosines, strict=True):
                near = np.flatnonzero((c >= least - 1e-12) & (rows != own[i]))
                if len(near) > k:
                    near = near[c[near] >= np.partition(c[near], -k)[-k] - 1e-9]
                out[i] = rows[near], c[near]
    return out


class Postings:
    """The rows in which a word stands, ascending; ``order`` sorts what else belongs to the entries alike."""

    def __init__(self, words: pa.Array, rows: np.ndarray):
        d = words.dictionary_encode()
        codes = d.indices.to_numpy(zero_copy_only=False)
        self.words = d.dictionary.to_pylist()
        self.at = {w: i for i, w in enumerate(self.words)}
        self.order = np.argsort(codes, kind="stable")
        self.rows = rows[self.order]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(self.at)))]).tolist()

    def codes(self, words: Iterable[str]) -> list[int]:
        """Numbers of those words that stand somewhere."""
        return [i for w in words if (i := self.at.get(w)) is not None]

    def place(self, code: int) -> slice:
        return slice(self.ends[code], self.ends[code + 1])

    def of(self, codes: list[int]) -> np.ndarray:
        """The rows of the words of ``codes``, one after the other."""
        return np.concatenate([self.rows[self.place(i)] for i in codes]) if codes else self.rows[:0]


class Phrases:
    """Distinct phrases, written as words with blanks (and a text after a line end), each with the rows that have it."""

    def __init__(self, lists: pa.Array):
        self.owners = Postings(*entries(lists))
        split = [p.partition("\n") for p in self.owners.words]
        words = [p[0].split(" ") if p[0] else [] for p in split]
        self.texts = [p[2] for p in split]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.index = Postings(pa.array([x for w in words for x in w], pa.string()), np.repeat(np.arange(len(words)), self.sizes))

    def met(self, words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that share a word with ``words``, and how many."""
        shared = np.bincount(self.index.of(self.index.codes(words)), minlength=len(self.sizes))
        some = np.flatnonzero(shared)
        return some, shared[some]

    def best(self, n: int, some: np.ndarray, share: np.ndarray) -> np.ndarray:
        """For each of ``n`` rows the greatest share of its phrases, else 0."""
        out = np.zeros(n)
        for i in np.argsort(share, kind="stable").tolist():  # later ones are greater
            out[self.owners.rows[self.owners.place(some[i])]] = share[i]
        return out

    def shares(self, n: int, words: Iterable[str]) -> np.ndarray:
        """The best share of a phrase of two terms or more, with two of them shared or a share of 0.6, for ``n`` rows."""
        some, shared = self.met(words)
        share = shared / self.sizes[some]
        ok = (self.sizes[some] >= 2) & ((shared >= 2) | (share >= 0.6))
        return self.best(n, some[ok], share[ok])
