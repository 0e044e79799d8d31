"""Near-duplicate records with small edits, by a count-vector R-tree (problem 2).

A text is the bag of its words; the overlap of two texts is |A ∩ B| / |A ∪ B| over bags. Equal
sequences of words form a class, and one representative of each class goes into the tree.

The tree. Words are hashed into ``GROUPS`` groups and a text becomes the point of its group counts; the sum of the
coordinate minima of two points bounds their shared words from above. A second, very fine hashing (64 bits) gives the
leading coordinates, rarest first by a table of ``2**FREQ_BITS`` group frequencies over all texts: two texts without a
common one among their leading coordinates have a sum of minima below what the overlap asks for, so a point stands
under each of its leading coordinates and is met nowhere else. That level of the tree is the partitioning. Inside a
partition the entries are packed along (leading coordinate, size, counts) into leaves with bounding boxes, and the
tree is joined with itself: boxes, then points, are dropped by coordinate intervals, sizes, rank of the leading
coordinate and the summed minima. Survivors are checked on the exact words.

A leading coordinate whose group is so frequent that its entries might not fit one task is split into a triangle of
cells, so that every pair still meets in exactly one cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.words import word_hashes, words
from tracewell.plans.runtime import bounded_broadcast, spread, stage

GROUPS = 63
FREQ_BITS = 18
CHUNKS = 64
LEAF = 64
#: Entries of one leading coordinate that one task takes; beyond, the coordinate is split into cells.
CELL = 40_000
#: Copies of one text up to which all their pairs are written; beyond, each copy is paired with the representative.
EXPAND = 64
#: Ids of candidates up to which they are broadcast (16 bytes each).
BROADCAST_IDS = 1_000_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (as unsigned) and offsets of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)[offsets[0] : offsets[-1]]
    return values, offsets - offsets[0]


def group_frequencies(hashes: DataFrame) -> np.ndarray:
    """Frequencies of ``2**FREQ_BITS`` word groups over all rows of ``hashes`` (column h): a table of fixed size."""
    per = (1 << FREQ_BITS) // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << FREQ_BITS, np.int64)
        for b in batches:
            total += np.bincount((_ragged(b.column(0))[0] >> np.uint64(64 - FREQ_BITS)).astype(np.int64), minlength=1 << FREQ_BITS)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([total[i * per : (i + 1) * per].tobytes() for i in range(CHUNKS)], pa.binary())], ["chunk", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in t.column("counts").to_pylist())
        return pa.table({"chunk": t.column("chunk")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    parts = hashes.mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect()  # 64 rows
    out = np.zeros(1 << FREQ_BITS, np.int64)
    for chunk, counts in parts:
        out[chunk * per : (chunk + 1) * per] = np.frombuffer(counts, np.int64)
    return out


def leading(n: np.ndarray, least: float) -> np.ndarray:
    """How many leading coordinates a text of ``n`` words needs so that no pair with overlap ``least`` is missed."""
    return n - np.ceil(n * least - 1e-9).astype(np.int64) + 1


def points(hashed: DataFrame, frequencies: np.ndarray, least: float) -> DataFrame:
    """The points of texts: (field, key, c1, c2, n, v1, v2, v3, lead).

    c1, c2 identify the sequence of words (sums of hashes mixed with their places), so that another order is another
    class, linked as any other text; v1 to v3 hold 63 counts of 3 bits,
    counts beyond 7 stay out and are known from n; lead are the leading coordinates, rarest first.
    """
    level = np.minimum(255, (8 * np.log2(frequencies + 1.0)).astype(np.int64)).astype(np.uint8)
    held = hashed.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = held.value
        for b in batches:
            h, off = _ragged(b.column(2))
            n = np.diff(off)
            rows = np.repeat(np.arange(len(n)), n)
            place = _mix(h) + (np.arange(len(h)) - np.repeat(off[:-1], n)).astype(np.uint64) * _GOLD
            a, c = _mix(place), _mix(place ^ _GOLD)
            c1, c2 = np.add.reduceat(a, off[:-1]), np.add.reduceat(c, off[:-1])  # no text here is without words
            lev = rarity[(h >> np.uint64(64 - FREQ_BITS)).astype(np.int64)]
            order = np.lexsort((h, lev, rows))
            h = h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
            start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            nth = (np.arange(len(h)) - start).astype(np.uint64)
            e = h + nth * _GOLD  # the nth copy of a word is a coordinate of its own
            counts = np.bincount(rows * GROUPS + (h % np.uint64(GROUPS)).astype(np.int64), minlength=len(n) * GROUPS).reshape(len(n), GROUPS)
            capped = np.minimum(counts, 7).astype(np.uint64).reshape(len(n), 3, 21)
            v = (capped << (np.arange(21, dtype=np.uint64) * np.uint64(3))).sum(2, dtype=np.uint64).view(np.int64)
            most = leading(n, least)
            keep = np.arange(len(h)) - np.repeat(off[:-1], n) < np.repeat(most, n)
            lead = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(most)]).astype(np.int32)), pa.array(e[keep].view(np.int64)))
            cells = [b.column(0), b.column(1), *(pa.array(x.view(np.int64)) for x in (c1, c2)), pa.array(n.astype(np.int32)), *(pa.array(np.ascontiguousarray(v[:, i])) for i in range(3)), lead]
            yield pa.RecordBatch.from_arrays(cells, ["field", "key", "c1", "c2", "n", "v1", "v2", "v3", "lead"])

    return hashed.mapInArrow(run, "field int, key string, c1 long, c2 long, n int, v1 long, v2 long, v3 long, lead array<long>")


class Entries:
    """Entries of a part of the tree, sorted along (leading coordinate, size)."""

    def __init__(self, field, tok, rid, n, pos, v, least: float):
        order = np.lexsort((n, tok, field))
        self.field, self.tok, self.rid, self.n, self.pos = (x[order] for x in (field, tok, rid, n, pos))
        v = v[order].view(np.uint64)
        self.counts = ((v[:, :, None] >> (np.arange(21, dtype=np.uint64) * np.uint64(3))) & np.uint64(7)).astype(np.uint8).reshape(len(n), GROUPS)
        self.over = self.n - self.counts.sum(1, dtype=np.int64)
        self.least, self.found = least, []

    def test(self, i: np.ndarray, j: np.ndarray) -> None:
        """Keep the pairs (i, j) that sizes, ranks and summed minima allow."""
        n, m = self.n[i], self.n[j]
        need = np.ceil((n + m) * (self.least / (1 + self.least)) - 1e-9)
        ok = (self.rid[i] != self.rid[j]) & (np.minimum(n - self.pos[i], m - self.pos[j]) >= need)
        i, j, need = i[ok], j[ok], need[ok]
        for a in range(0, len(i), 100_000):
            x, y = i[a : a + 100_000], j[a : a + 100_000]
            bound = np.minimum(self.counts[x], self.counts[y]).sum(1, dtype=np.int64) + np.minimum(self.over[x], self.over[y])
            ok = bound >= need[a : a + 100_000]
            x, y = x[ok], y[ok]
            r, s = self.rid[x], self.rid[y]
            self.found.append(np.stack([self.field[x].astype(np.int64), np.minimum(r, s), np.maximum(r, s)], 1))

    def join(self) -> np.ndarray:
        """Pairs (field, id, id) that survive, each once."""
        same = np.zeros(len(self.tok), bool)
        same[1:] = (self.tok[1:] == self.tok[:-1]) & (self.field[1:] == self.field[:-1])
        start = np.flatnonzero(~same)
        size = np.diff(np.append(start, len(self.tok)))
        # Coordinates that fit one leaf: all leaves at once, entry against the d-th next.
        block = np.repeat(size, size)
        end = np.repeat(start + size, size)
        at = np.flatnonzero((block > 1) & (block <= LEAF))
        for d in range(1, LEAF):
            at = at[at + d < end[at]]
            if not len(at):
                break
            self.test(at, at + d)
        for s, k in zip(start[size > LEAF], size[size > LEAF], strict=True):
            self._large(int(s), int(k))
        if not self.found:
            return np.zeros((0, 3), np.int64)
        return np.unique(np.concatenate(self.found), axis=0)

    def _large(self, s: int, k: int) -> None:
        """Join the leaves below one coordinate, box by box."""
        # Packed by size, then along the counts, so that boxes are small.
        own = s + np.lexsort((*self.counts[s : s + k].T[:8], self.n[s : s + k]))
        leaves = [own[a : a + LEAF] for a in range(0, k, LEAF)]
        low = np.array([self.n[x].min() for x in leaves])
        high = np.array([self.n[x].max() for x in leaves])
        top = np.stack([self.counts[x].max(0) for x in leaves])
        over = np.array([self.over[x].max() for x in leaves])
        share = self.least / (1 + self.least)
        for i, x in enumerate(leaves):
            j = np.arange(i, len(leaves))
            j = j[low[j] * self.least <= high[i]]  # leaves are in order of size
            bound = np.minimum(top[i], top[j]).sum(1, dtype=np.int64) + np.minimum(over[i], over[j])
            for y in j[bound >= (low[i] + low[j]) * share - 1e-9]:
                a, b = np.triu_indices(len(x), 1) if y == i else (np.repeat(np.arange(len(x)), len(leaves[y])), np.tile(np.arange(len(leaves[y])), len(x)))
                self.test(x[a], (x if y == i else leaves[y])[b])


def candidates(reps: DataFrame, frequencies: np.ndarray, least: float) -> DataFrame:
    """(field, ra, rb): pairs of ids (c1) that the tree cannot rule out, each perhaps more than once."""
    spark = reps.sparkSession
    held = spark.sparkContext.broadcast(np.minimum(65535, -(-frequencies // CELL)).astype(np.uint16))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each leading coordinate of each text, and for each cell if the coordinate is split."""
        parts = held.value
        for b in batches:
            e, off = _ragged(b.column(6))
            size = np.diff(off)
            row = np.repeat(np.arange(len(size)), size)
            pos = np.arange(len(e)) - np.repeat(off[:-1], size)
            k = np.maximum(1, parts[(e >> np.uint64(64 - FREQ_BITS)).astype(np.int64)]).astype(np.int64)
            if (k > 1).any():
                own = (b.column(1).to_numpy().view(np.uint64)[row] % k.astype(np.uint64)).astype(np.int64)
                of = np.repeat(np.arange(len(e)), k)
                other = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)
                lo, hi = np.minimum(own[of], other), np.maximum(own[of], other)
                e, row, pos = e[of], row[of], pos[of]
                e = np.where(k[of] > 1, _mix(e ^ (lo * 65536 + hi + 1).astype(np.uint64)), e)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(e.view(np.int64)), pa.array(pos.astype(np.int32)), *(b.column(i).take(take) for i in range(6))], ["tok", "pos", "field", "rid", "n", "v1", "v2", "v3"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by coordinate; whole coordinates are joined, some 200 000 entries at a time."""

        def out(t: pa.Table) -> pa.RecordBatch:
            c = [t.column(i).to_numpy() for i in range(8)]
            f = Entries(c[2], c[0], c[3], c[4].astype(np.int64), c[1].astype(np.int64), np.stack(c[5:8], 1), least).join()
            return pa.RecordBatch.from_arrays([pa.array(f[:, 0].astype(np.int32)), pa.array(f[:, 1].copy()), pa.array(f[:, 2].copy())], ["field", "ra", "rb"])

        wait: list[pa.RecordBatch] = []
        held_rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            wait.append(b)
            held_rows += b.num_rows
            if held_rows >= 200_000:
                t = pa.Table.from_batches(wait)
                tok = t.column(0).to_numpy()
                cut = int(np.searchsorted(tok, tok[-1]))
                if cut:
                    yield out(t.slice(0, cut))
                    wait = t.slice(cut).to_batches()
                    held_rows = t.num_rows - cut
        if wait:
            yield out(pa.Table.from_batches(wait))

    rows = reps.select("field", F.col("c1").alias("rid"), "n", "v1", "v2", "v3", "lead").mapInArrow(spread, "tok long, pos int, field int, rid long, n int, v1 long, v2 long, v3 long")
    return rows.repartition("tok").sortWithinPartitions("tok").mapInArrow(join, "field int, ra long, rb long")


def bag_overlap(a, b) -> float:
    """Shared words by all words, each as often as it occurs."""
    from collections import Counter

    x, y = Counter(a), Counter(b)
    shared = sum((x & y).values())
    return shared / max(1, len(a) + len(b) - shared)


def near_duplicates(texts: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Classes and links of ``texts`` (field INT, key STRING, text STRING).

    Returns (members, links): members are (field, c1, c2, key), a row per key and class of equal word sequences; links are
    (field, a1, a2, b1, b2, overlap), a row per pair of different classes of one field whose overlap is at least
    ``least``, found by the tree and checked on the words themselves.

    Rows with a null key or without a word are no cases; rows stored twice count once; a key with several texts stands
    in the class of each; ties don't arise; an empty table gives empty results.
    """
    src = spread(texts.select("field", "key", "text")).where(F.col("key").isNotNull() & F.col("text").isNotNull())
    hashed = src.select("field", "key", word_hashes(F.col("text")).alias("h")).where(F.size("h") > 0)
    frequencies = group_frequencies(hashed.select("h"))
    sig = stage(points(hashed, frequencies, least), "points")
    first = [F.first(c).alias(c) for c in ("n", "v1", "v2", "v3", "lead")]
    reps = sig.groupBy("field", "c1", "c2").agg(*first)
    pairs = stage(candidates(reps, frequencies, least).distinct(), "candidates")

    ends = pairs.select("field", F.explode(F.array("ra", "rb")).alias("c1")).distinct()
    who = sig.select("field", "key", "c1", "c2").join(bounded_broadcast(stage(ends, "ends"), BROADCAST_IDS), ["field", "c1"], "left_semi").groupBy("field", "c1", "c2").agg(F.min("key").alias("key"))
    who = stage(who, "who")
    # The texts of representatives; a key with several texts gives several, of which the right one decides.
    kept = src.join(bounded_broadcast(who, BROADCAST_IDS), ["field", "key"]).select("field", "c1", "c2", words(F.col("text")).alias("w")).dropDuplicates(["field", "c1", "c2", "w"])
    left = kept.select("field", F.col("c1").alias("ra"), F.col("c2").alias("a2"), F.col("w").alias("wa"))
    right = kept.select("field", F.col("c1").alias("rb"), F.col("c2").alias("b2"), F.col("w").alias("wb"))
    both = pairs.join(left, ["field", "ra"]).join(right, ["field", "rb"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wa, wb = b.column(5).to_pylist(), b.column(6).to_pylist()
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array([bag_overlap(x, y) for x, y in zip(wa, wb, strict=True)], pa.float64())], ["field", "a1", "a2", "b1", "b2", "overlap"])

    checked = both.select("field", "ra", "a2", "rb", "b2", "wa", "wb").mapInArrow(verify, "field int, a1 long, a2 long, b1 long, b2 long, overlap double")
    links = checked.where(F.col("overlap") >= least).groupBy("field", "a1", "a2", "b1", "b2").agg(F.max("overlap").alias("overlap"))
    return sig.select("field", "c1", "c2", "key").distinct(), links


def key_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(field, key_a, key_b), key_a < key_b: the pairs of keys that classes and links stand for.

    Classes of up to ``EXPAND`` copies are written out in all pairs. In a larger one each copy is paired with the least
    key, its representative, which alone stands in the links of the class: no link between different texts is lost.
    """
    sizes = members.groupBy("field", "c1", "c2").agg(F.count("*").alias("copies"), F.min("key").alias("rep"))
    several = sizes.where("copies > 1")
    cls = ["field", "c1", "c2"]
    m = members.join(several, cls)
    small = m.where(F.col("copies") <= EXPAND)
    inside = small.select(*cls, F.col("key").alias("key_a")).join(small.select(*cls, F.col("key").alias("key_b")), cls).where("key_a < key_b").select("field", "key_a", "key_b")
    star = m.where(F.col("copies") > EXPAND).where("rep < key").select("field", F.col("rep").alias("key_a"), F.col("key").alias("key_b"))
    shown = members.join(sizes, cls).where((F.col("copies") <= EXPAND) | (F.col("key") == F.col("rep")))
    a = shown.select("field", F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("key").alias("x"))
    b = shown.select("field", F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.col("key").alias("y"))
    across = links.join(a, ["field", "a1", "a2"]).join(b, ["field", "b1", "b2"]).where("x <> y").select("field", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
    return inside.unionByName(star).unionByName(across).distinct()


def stacked(skills: DataFrame, lessons: DataFrame) -> DataFrame:
    """(field, key, text) of the three text fields: 0 skill_body, 1 skill_description, 2 lesson_rule."""
    both = F.array(F.struct(F.lit(0).alias("field"), F.col("body").alias("text")), F.struct(F.lit(1).alias("field"), F.col("description").alias("text")))
    of_skills = skills.select(F.col("name").alias("key"), F.inline(both)).select("field", "key", "text")
    return of_skills.unionByName(lessons.select(F.lit(2).alias("field"), F.col("id").alias("key"), F.col("rule").alias("text")))


FIELDS = ("skill_body", "skill_description", "lesson_rule")
