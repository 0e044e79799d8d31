"""Same or near-same records across splits, by content-defined chunks (problem 4).

A record is normalised to its words. A rolling hash over the last ``WINDOW`` characters, looked at where a word ends,
decides whether a chunk ends there, so an edit changes only the chunks next to it. Digests of chunks are joined across
the splits, rarest first: a record is entered under its leading chunks only, so many that any record sharing at least
``SHARE`` of its words in whole chunks meets it under one of them. Edits that leave fewer whole chunks, or another order
of the words, are met by the words themselves: on the same join a record is also entered under its rarest words, so many
that two records without a common one can't have the overlap asked for. So no pair is missed. A join row is kept only if
the places of the word met and two 64-bit sets of hashed words allow the overlap, which loses nothing. Of what is left
the lengths of shared chunks are summed into a fraction for each of the two records, and the overlap is checked on the
words.

A digest that many records hold is split into a square of cells: a training record is entered along its row, another
along its column, so that each pair meets in one cell and no cell is large.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.words import words
from tracewell.llm.neardup import FREQ_BITS, _ragged, bag_overlap, group_frequencies, leading
from tracewell.plans.runtime import bounded_broadcast, spread, stage

WINDOW = 4
#: Share of word ends that end a chunk, as (numerator, denominator).
CUT = (2, 3)
SHARE = 0.35
#: Records under one digest that share a cell.
CELL = 4_000
#: Pairs of copies up to which a link between two classes of copies is written out.
EXPAND = 4_096


def chunks_of(w: list[str]) -> list[tuple[str, int]]:
    """The chunks of a record's words, each with its number of words."""
    out, begin, tail = [], 0, ""
    for i, x in enumerate(w):
        tail = (tail + " " + x)[-WINDOW:]
        if zlib.crc32(tail.encode()) % CUT[1] < CUT[0]:
            out.append((" ".join(w[begin : i + 1]), i + 1 - begin))
            begin = i + 1
    if begin < len(w):
        out.append((" ".join(w[begin:]), len(w) - begin))
    return out


def _digest(s: str) -> int:
    return int.from_bytes(blake2b(s.encode(), digest_size=8).digest(), "little", signed=True)


@lru_cache(1 << 16)
def _word(x: str, nth: int) -> int:
    """Digest of the nth copy of a word, apart from those of chunks."""
    return _digest(f"\n{x} {nth}")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, train, w) to (key, train, n, c1, c2, m1, m2, d, l, e); e are digests of the words."""
    for b in batches:
        rows = []
        for w in b.column(2).to_pylist():
            chunks = chunks_of(w)
            bag = blake2b("\n".join(sorted(x for x, _ in chunks)).encode(), digest_size=16).digest()  # of chunks, so that no record's own are lost
            m = [0, 0]
            for x in set(w):
                h = zlib.crc32(x.encode())
                m[h & 1] |= 1 << (h >> 1) % 64
            c = Counter()
            for chunk, length in chunks:
                c[_digest(chunk), length] += 1
            # The nth copy of a chunk is a chunk of its own.
            d = [(x if i == 0 else _digest(f"{x} {i}"), length) for (x, length), k in c.items() for i in range(k)]
            rows.append((len(w), int.from_bytes(bag[:8], "little", signed=True), int.from_bytes(bag[8:], "little", signed=True), *(x - (x >> 63 << 64) for x in m), [x for x, _ in d], [x for _, x in d], [_word(x, i) for x, k in Counter(w).items() for i in range(k)]))
        cols = [list(x) for x in zip(*rows, strict=True)] or [[] for _ in range(8)]
        kinds = [pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, t) for x, t in zip(cols, kinds, strict=True))], ["key", "train", "n", "c1", "c2", "m1", "m2", "d", "l", "e"])


def _leading(classes: DataFrame, frequencies: np.ndarray, least: float) -> DataFrame:
    """A row for each leading chunk and word of each class, and for each cell of it that the class stands in.

    ``most``: how many words a record met there for the first time can share; of a chunk, all.
    """
    spark = classes.sparkSession
    held = spark.sparkContext.broadcast(frequencies.astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = held.value
        for b in batches:
            if not b.num_rows:
                continue
            d, off = _ragged(b.column(6))
            length = b.column(7)
            length = (length.values.to_numpy()[length.offsets.to_numpy()[0] : length.offsets.to_numpy()[-1]]).astype(np.int64)
            size = np.diff(off)
            row = np.repeat(np.arange(len(size)), size)
            f = freq[(d >> np.uint64(64 - FREQ_BITS)).astype(np.int64)]
            order = np.lexsort((d, f, row))
            d, f, length = d[order], f[order], length[order]
            n = b.column(1).to_numpy().astype(np.int64)
            before = np.cumsum(length) - length
            left = n[row] - (before - before[off[:-1]][row])  # words in this chunk and the more frequent ones
            keep = left >= SHARE * n[row]
            d, f, row = d[keep], f[keep], row[keep]
            e, off = _ragged(b.column(8))
            size = np.diff(off)
            of = np.repeat(np.arange(len(size)), size)
            g = freq[(e >> np.uint64(64 - FREQ_BITS)).astype(np.int64)]
            order = np.lexsort((e, g, of))
            at = np.arange(len(e)) - np.repeat(off[:-1], size)
            keep = at < leading(n, least)[of]
            most = np.concatenate([n[row], (n[of] - at)[keep]]).astype(np.int32)
            d, f, row = (np.concatenate(x) for x in ((d, e[order][keep]), (f, g[order][keep]), (row, of[keep])))
            train = b.column(0).to_numpy(zero_copy_only=False).astype(bool)
            c1 = b.column(2).to_numpy()
            cells = np.maximum(1, -(-f // CELL))
            of = np.repeat(np.arange(len(d)), cells)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
            own = (c1[row].view(np.uint64) % cells.astype(np.uint64)).astype(np.int64)
            cell = np.where(train[row[of]], own[of] * cells[of] + nth, nth * cells[of] + own[of])
            take = pa.array(row[of])
            yield pa.RecordBatch.from_arrays([pa.array(d[of].view(np.int64)), pa.array(cell.astype(np.int32)), pa.array(most[of]), *(b.column(i).take(take) for i in range(6))], ["tok", "cell", "most", "train", "n", "c1", "c2", "m1", "m2"])

    return classes.select("train", "n", "c1", "c2", "m1", "m2", "d", "l", "e").mapInArrow(run, "tok long, cell int, most int, train boolean, n int, c1 long, c2 long, m1 long, m2 long")


def cross_split(records: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Classes of records of equal chunks, in whatever order, and links across splits.

    ``records``: key STRING, train BOOLEAN, text STRING. Returns (members, links): members (key, train, c1, c2); links
    (a1, a2, b1, b2, part_a, part_b, overlap), a row per training class a and other class b whose overlap of words is at
    least ``least``; part_a and part_b are the shares of each record's words that lie in shared chunks.

    Rows with a null key, side or text or without a word are no cases; a record stored twice counts once; equal records
    of the two sides are linked as well; an empty table gives empty results.
    """
    src = spread(records.select("key", "train", "text")).where(F.col("key").isNotNull() & F.col("train").isNotNull() & F.col("text").isNotNull()).select("key", "train", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    sig = stage(src.mapInArrow(_signatures, "key string, train boolean, n int, c1 long, c2 long, m1 long, m2 long, d array<long>, l array<int>, e array<long>"), "chunks")
    frequencies = group_frequencies(sig.select(F.concat("d", "e").alias("h")))
    classes = sig.groupBy("train", "c1", "c2").agg(F.min(F.struct("d", "l", "n", "m1", "m2", "e")).alias("x")).select("train", "c1", "c2", "x.*")
    classes = stage(classes, "chunk-classes")
    rows = _leading(classes, frequencies, least)
    a = rows.where("train").select("tok", "cell", F.col("most").alias("ta"), F.col("n").alias("na"), F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("m1").alias("p1"), F.col("m2").alias("p2"))
    b = rows.where("not train").select("tok", "cell", F.col("most").alias("tb"), F.col("n").alias("nb"), F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.col("m1").alias("q1"), F.col("m2").alias("q2"))
    need = F.ceil((F.col("na") + F.col("nb")) * F.lit(least / (1 + least)) - F.lit(1e-9))
    bits = lambda x, y: F.bit_count(F.col(f"{x}1").bitwiseAND(F.bitwise_not(f"{y}1"))) + F.bit_count(F.col(f"{x}2").bitwiseAND(F.bitwise_not(f"{y}2")))
    met = a.join(b, ["tok", "cell"]).where((F.least("ta", "tb") >= need) & (bits("p", "q") <= F.col("na") - need) & (bits("q", "p") <= F.col("nb") - need))
    pairs = stage(met.select("a1", "a2", "b1", "b2").distinct(), "chunk-pairs")

    ends = pairs.select(F.lit(True).alias("train"), F.col("a1").alias("c1"), F.col("a2").alias("c2")).union(pairs.select(F.lit(False), "b1", "b2")).distinct()
    of = classes.join(bounded_broadcast(stage(ends, "chunk-ends"), 1_000_000), ["train", "c1", "c2"], "left_semi").select("train", "c1", "c2", "d", "l")
    who = sig.join(bounded_broadcast(ends, 1_000_000), ["train", "c1", "c2"], "left_semi").groupBy("train", "c1", "c2").agg(F.min("key").alias("key"))
    texts = src.join(bounded_broadcast(stage(who, "chunk-who"), 1_000_000), ["train", "key"]).select("train", "c1", "c2", "w").dropDuplicates(["train", "c1", "c2", "w"])
    whole = texts.join(of, ["train", "c1", "c2"])
    left = whole.where("train").select(F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("w").alias("wa"), F.col("d").alias("da"), F.col("l").alias("la"))
    right = whole.where("not train").select(F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.col("w").alias("wb"), F.col("d").alias("db"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            wa, wb, da, la, db = (x.column(i).to_pylist() for i in range(4, 9))
            shared = [sum(k for d, k in zip(p, q, strict=True) if d in r) for p, q, r in zip(da, la, map(set, db), strict=True)]
            parts = [pa.array([s / len(w) for s, w in zip(shared, v, strict=True)], pa.float64()) for v in (wa, wb)]
            yield pa.RecordBatch.from_arrays([*(x.column(i) for i in range(4)), *parts, pa.array([bag_overlap(p, q) for p, q in zip(wa, wb, strict=True)], pa.float64())], ["a1", "a2", "b1", "b2", "part_a", "part_b", "overlap"])

    both = pairs.join(left, ["a1", "a2"]).join(right, ["b1", "b2"]).select("a1", "a2", "b1", "b2", "wa", "wb", "da", "la", "db")
    links = both.mapInArrow(check, "a1 long, a2 long, b1 long, b2 long, part_a double, part_b double, overlap double").where(F.col("overlap") >= least)
    links = links.groupBy("a1", "a2", "b1", "b2").agg(*(F.max(c).alias(c) for c in ("part_a", "part_b", "overlap")))
    return sig.select("key", "train", "c1", "c2").distinct(), links


def key_links(members: DataFrame, links: DataFrame) -> DataFrame:
    """(train_key, other_key, part_train, part_other, overlap) for the pairs of keys that ``links`` stand for.

    A link between classes of n and m copies is written out if n * m is at most ``EXPAND``; else each copy of one side
    is linked with the least key of the other, so that every copy stands in a link.
    """
    sizes = members.groupBy("train", "c1", "c2").agg(F.count("*").alias("copies"), F.min("key").alias("rep"))
    sizes = stage(sizes, "chunk-sizes")
    side = lambda flag, p: sizes.where(flag).select(F.col("c1").alias(f"{p}1"), F.col("c2").alias(f"{p}2"), F.col("copies").alias(f"n{p}"), F.col("rep").alias(f"r{p}"))
    of = lambda flag, p: members.where(flag).select(F.col("c1").alias(f"{p}1"), F.col("c2").alias(f"{p}2"), F.col("key").alias(f"k{p}"))
    known = links.join(side("train", "a"), ["a1", "a2"]).join(side("not train", "b"), ["b1", "b2"])
    few = known.where(F.col("na") * F.col("nb") <= EXPAND).join(of("train", "a"), ["a1", "a2"]).join(of("not train", "b"), ["b1", "b2"])
    many = known.where(F.col("na") * F.col("nb") > EXPAND)
    star = many.join(of("train", "a"), ["a1", "a2"]).withColumn("kb", F.col("rb")).unionByName(many.join(of("not train", "b"), ["b1", "b2"]).withColumn("ka", F.col("ra")))
    out = [F.col("ka").alias("train_key"), F.col("kb").alias("other_key"), F.col("part_a").alias("part_train"), F.col("part_b").alias("part_other"), "overlap"]
    return few.select(*out).unionByName(star.select(*out)).dropDuplicates(["train_key", "other_key"])


def task_sides(tasks: DataFrame) -> DataFrame:
    """(key, train, text) of tasks; case and outer blanks of split don't count; a null or blank split is no split."""
    split = F.lower(F.trim("split"))
    return tasks.where(F.col("split").isNotNull() & (F.trim("split") != "")).select(F.col("id").alias("key"), (split == "train").alias("train"), F.col("prompt").alias("text"))
