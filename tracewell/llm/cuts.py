"""Texts cut off by field limits or broken transfers (problem 5).

1. Hazards. For each source and length, the hazard is the number of different texts that end at this length over those
   that reach it, by window functions over the table of lengths. Each is tested against the pooled hazard of the
   neighbouring lengths (a bound on the Poisson tail); a length is significant if it passes Benjamini-Hochberg within
   its source and at least half of the texts that reach it end there.
2. Endings. Over all texts it is counted how often three successive words (names and numbers made alike) are followed
   by more, by the end of a statement, or by the end of the text. An ending is open if its words are hardly ever the
   last of a statement, if its last word hardly ever follows the two before (a torn word), or if JSON, quotes or
   backticks are left open; it is closed by a full stop or where its words often end a statement or text.
3. A text is cut if it ends in a broken character; if it ends at a significant length of its source or in a mark such
   as [truncated], but not in a full stop; if it ends in dots and isn't closed; and elsewhere if it is open.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.words import word_hashes
from tracewell.llm.neardup import FREQ_BITS, group_frequencies
from tracewell.plans.runtime import spread, stage

#: Lengths on either side whose hazards are pooled; false-discovery rate; least hazard of a limit.
NEIGHBOURS, FALSE_RATE, LEAST_HAZARD = 40, 0.01, 0.5
#: Share of all words below which a word is taken for a name.
NAME_SHARE = 1e-4
#: Share of a statement's ends among what follows some words, below which they are open, and from which they are closed.
OPEN, CLOSED, SEEN = 0.03, 0.25, 10

#: Marks that say that something was cut.
_mark = re.compile(r"\s*(?:(?:…|\.\.\.)\s*)?[\[(<{][^\[(<{\n]{0,40}?\b(?:truncated|snip|snipped|cut|clipped|omitted|elided|more (?:chars|characters|bytes|lines))\b[^\n]{0,20}[\])>}]\s*$|\s*(?:…|\.\.\.)\s*$", re.I)
_word = re.compile(r"[^\W_]+")
_stop = re.compile(r"[.?!]+[\"'`)\]}*]*(?:\s|$)|[^\w]*\n")


def tool_texts(traces: DataFrame) -> DataFrame:
    """(trace_id, step_pos, call_pos, agent, field, text) of results and errors that aren't null or empty."""
    calls = traces.where(F.col("id").isNotNull()).select(F.col("id").alias("trace_id"), "agent", F.posexplode("steps.tool_calls").alias("step_pos", "calls")).select("trace_id", "agent", "step_pos", F.posexplode(F.transform("calls", lambda c: F.struct(c["result"].alias("result"), c["error"].alias("error")))).alias("call_pos", "c"))
    each = calls.select("trace_id", "agent", "step_pos", "call_pos", F.inline(F.array(F.struct(F.lit("result").alias("field"), F.col("c.result").alias("text")), F.struct(F.lit("error").alias("field"), F.col("c.error").alias("text")))))
    return each.where(F.col("text") != "").select("trace_id", "step_pos", "call_pos", "agent", "field", "text")


def significant_lengths(texts: DataFrame) -> DataFrame:
    """(agent, length, ended, reached, hazard, p): lengths at which texts of an agent end too often."""
    counts = texts.where(F.col("agent").isNotNull()).groupBy("agent", F.length("text").alias("length")).agg(F.count_distinct(F.xxhash64("text")).alias("ended"))
    up = Window.partitionBy("agent").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    near = Window.partitionBy("agent").orderBy("length").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    own = counts.withColumn("reached", F.sum("ended").over(up))
    pooled = own.withColumn("other", (F.sum("ended").over(near) - F.col("ended") + 0.5) / (F.sum("reached").over(near) - F.col("reached") + 1.0))
    # With rows only where texts end, neighbours without a row are left out, which makes the pooled hazard larger.
    expected = pooled.withColumn("hazard", F.col("ended") / F.col("reached")).withColumn("due", F.least(F.col("other"), F.lit(1.0)) * F.col("reached"))
    k, due = F.col("ended"), F.col("due")
    tested = expected.withColumn("p", F.when(k <= due, 1.0).otherwise(F.exp(k - due + k * F.log(due / k))))
    whole = Window.partitionBy("agent")
    ranked = tested.withColumn("rank", F.row_number().over(whole.orderBy("p", "length"))).withColumn("tests", F.count("*").over(whole))
    last = F.max(F.when(F.col("p") <= F.col("rank") / F.col("tests") * FALSE_RATE, F.col("rank"))).over(whole)
    return ranked.withColumn("last", last).where((F.col("rank") <= F.col("last")) & (F.col("hazard") >= LEAST_HAZARD) & (F.col("ended") >= 3)).select("agent", "length", "ended", "reached", "hazard", "p")


def body_of(text: str) -> tuple[str, int]:
    """The text without a mark at its end; 2 for a mark in words, 1 for mere dots, 0 for none."""
    m = _mark.search(text)
    if not m or not text[: m.start()].strip():
        return text, 0
    return text[: m.start()], 2 if any(c.isalpha() for c in m.group()) else 1


def _kinds(words: list[str], hashes: np.ndarray, frequent: np.ndarray) -> list[str]:
    common = frequent[(hashes.view(np.uint64) >> np.uint64(64 - FREQ_BITS)).astype(np.int64)]
    return [("0" if not w.isalpha() else w if c else "N") for w, c in zip(words, common.tolist(), strict=True)]


def _hashes(words: list[str], h: pa.ListScalar) -> np.ndarray:
    """The words' hashes, from the JVM where both sides find the same words, else made here (they are the same)."""
    given = h.values.to_numpy(zero_copy_only=False) if h.is_valid else np.zeros(0, np.int64)
    if len(given) == len(words):
        return given
    return np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in words], np.uint64).view(np.int64)


def _joined(kind: str, low: str, start: int, end: int) -> str:
    """A word's kind with the signs between it and the word before."""
    gap = low[start:end].strip()
    return gap[:2] + kind if gap else kind


def structure(body: str) -> bool:
    """Whether JSON, a row, a bracket, a quote or a backtick is left open at the end."""
    head = body[:2]
    if head in ('{"', "[{", "{\n", "[\n", '["', "{ "):
        try:
            json.loads(body)
        except ValueError:
            return True
        return False
    if body.endswith("\n"):
        return False
    first, _, rest = body.partition("\n")
    line = body[body.rfind("\n") + 1 :]
    if rest and (k := first.count(",")) >= 2 and " " not in first and line.count(",") < k:
        return True
    if line.count("(") > line.count(")"):
        return True
    return bool(re.search(r',"[^"]*$', line)) and line.count('"') % 2 == 1 or line.count("`") % 2 == 1 and "```" not in line


def contexts(texts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(a, b, c, within, ends, finals): counts of three successive words over all texts.

    within: inside a text; ends: of these, at the end of a statement or line; finals: at the end of the text.
    """
    held = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = held.value
        within: Counter = Counter()
        ends: Counter = Counter()
        finals: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(within.keys() | finals.keys())
            return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), *(pa.array([c[k] for k in keys], pa.int64()) for c in (within, ends, finals))], ["a", "b", "c", "within", "ends", "finals"])

        for b in batches:
            for text, h in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                body = body_of(text)[0]
                low = body.lower()
                found = list(_word.finditer(low))
                n = len(found)
                if not n:
                    continue
                own = [m.group() for m in found]
                kind = _kinds(own, _hashes(own, h), flags)
                a, c2 = "$", "$"
                for i in range(n - 1):
                    last = _joined(kind[i], low, found[i - 1].end(), found[i].start()) if i and c2 not in "^$" else kind[i]
                    key = (a, c2, last)
                    within[key] += 1
                    if (e := found[i].end()) + 1 < found[i + 1].start() or low[e] == "\n":
                        if _stop.match(low, e):
                            ends[key] += 1
                            a, c2 = "^", "^"
                            continue
                    a, c2 = c2, kind[i]
                last = _joined(kind[-1], low, found[-2].end(), found[-1].start()) if n > 1 and c2 not in "^$" else kind[-1]
                finals[a, c2, last] += 1
            if len(within) > 300_000:
                yield out()
                for c in (within, ends, finals):
                    c.clear()
        yield out()

    rows = texts.select("text", word_hashes(F.col("text")).alias("h")).mapInArrow(run, "a string, b string, c string, within long, ends long, finals long")
    return rows.groupBy("a", "b", "c").agg(*(F.sum(x).alias(x) for x in ("within", "ends", "finals")))


def endings(texts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """The texts whose ending needs a look, without the text itself.

    (trace_id, step_pos, call_pos, agent, field, length, broken, mark, open, a, b, c); left out are texts that end with
    a full stop and leave nothing open.
    """
    held = texts.sparkSession.sparkContext.broadcast(frequent)
    names = ["trace_id", "step_pos", "call_pos", "agent", "field", "length", "broken", "mark", "open", "a", "b", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = held.value
        for b in batches:
            take, rows = [], []
            for i, (text, h) in enumerate(zip(b.column(5).to_pylist(), b.column(6), strict=True)):
                body, mark = body_of(text)
                broken = text.endswith("�")
                left = structure(body)
                tail = body.rstrip()
                if not broken and not left and (not tail or body.endswith("\n") or tail[-1] in ".?!}]" or tail[-2:] in ('."', ".)", ".`", '?"', '!"')):
                    continue
                low = body.lower()
                found = list(_word.finditer(low))
                n = len(found)
                kind = []
                if n:
                    at = max(0, n - 3)
                    own = [m.group() for m in found]
                    kind = _kinds(own[at:], _hashes(own, h)[at:], flags)
                    for j in range(n - at - 2, -1, -1):  # words of an earlier statement don't count
                        if _stop.match(body, found[at + j].end()):
                            kind = ["^", "^", *kind[j + 1 :]][-3:]
                            break
                kind = ["$"] * (3 - len(kind)) + kind
                if n > 1 and kind[1] not in "^$":
                    kind[2] = _joined(kind[2], low, found[-2].end(), found[-1].start())
                left = left or body[-1:] in (" ", "\t", ",")
                if n and low[found[-1].end() :].strip():  # signs after the last word: its words tell nothing
                    kind = ["$", "$", "$"]
                take.append(i)
                rows.append((len(text), broken, mark, left, *kind))
            cols = [list(x) for x in zip(*rows, strict=True)] or [[] for _ in range(7)]
            kinds = [pa.int32(), pa.bool_(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(take, pa.int64())) for i in range(5)), *(pa.array(x, t) for x, t in zip(cols, kinds, strict=True))], names)

    rows = texts.select("trace_id", "step_pos", "call_pos", "agent", "field", "text", word_hashes(F.col("text")).alias("h"))
    return rows.mapInArrow(run, "trace_id string, step_pos int, call_pos int, agent string, field string, length int, broken boolean, mark int, open boolean, a string, b string, c string")


def cut_texts(traces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cut, texts, limits): cut is (trace_id, step_pos, call_pos, field, agent, cause), a row per text that was cut; the
    cause is the first that holds of limit, broken, mark, dots and ending.

    ``traces``: id, agent, steps. Null or empty texts, null steps or calls and null ids are no cases; texts of a null
    agent have no significant lengths; a trace delivered twice counts once; empty tables give empty results. Whole texts
    are used for all counts.
    """
    texts = stage(tool_texts(spread(traces.select("id", "agent", "steps"))), "tool-texts")
    frequencies = group_frequencies(texts.select(word_hashes(F.col("text")).alias("h")))
    frequent = frequencies >= max(5.0, frequencies.sum() * NAME_SHARE)
    limits = stage(significant_lengths(texts), "limits")
    table = stage(contexts(texts, frequent), "contexts")
    sums = lambda *x: [F.sum(c).alias(c + str(len(x))) for c in ("within", "ends", "finals")]
    pairs = table.groupBy("a", "b").agg(F.sum(F.col("within") + F.col("finals")).alias("after"))
    twos = table.groupBy("b", "c").agg(*sums("b", "c"))
    ones = table.groupBy("b").agg(F.sum(F.col("within") + F.col("finals")).alias("after1"))
    look = stage(endings(texts, frequent), "endings")
    # Endings whose words tell nothing have nothing to look up; they would all meet under one key. Counts by one word are
    # at most as many as the words above NAME_SHARE.
    bare = F.col("c") == "$"
    met = look.where(~bare).join(table, ["a", "b", "c"], "left").join(pairs, ["a", "b"], "left").join(twos, ["b", "c"], "left").join(F.broadcast(ones), "b", "left")
    judged = met.unionByName(look.where(bare), allowMissingColumns=True).join(limits.select("agent", "length", F.lit(True).alias("limit")), ["agent", "length"], "left")
    within, finals, after, within2, finals2, after1 = (F.coalesce(F.col(x), F.lit(0)) for x in ("within", "finals", "after", "within2", "finals2", "after1"))
    share: Column = F.col("ends") / F.when(within > 0, within)
    share2: Column = F.col("ends2") / F.when(within2 > 0, within2)
    yes = lambda x: F.coalesce(x, F.lit(False))
    whole = F.col("a").isin("$") & F.col("b").isin("$")  # a text of one word is merely short
    word = ~F.col("b").isin("^", "$", "N", "0") & (F.length("b") > 0)
    told = ~whole & (word | F.col("a").rlike("^[a-z]") | ~F.col("c").rlike("[N0]$"))  # some of the words says something
    often = told & yes(F.when(within >= SEEN, share < OPEN).otherwise((within2 >= 3 * SEEN) & (share2 < OPEN / 3)))
    fragment = F.col("c").rlike("[N0]$") & word & (within < SEEN)
    torn = fragment & yes(F.when(after >= 3 * SEEN, (within + finals) / after < OPEN).otherwise((after1 >= 10 * SEEN) & ((within2 + finals2) / F.when(after1 > 0, after1) < OPEN / 3)))
    is_open = F.col("open") | often | torn
    at_limit = yes(F.col("limit"))
    closed = ~F.col("open") & yes(F.when(within >= SEEN, share >= CLOSED).otherwise((finals >= SEEN) & ((within + finals) / F.when(after > 0, after) >= CLOSED)))
    # The first reason that holds: a hazard or a broken character is evidence by itself, an ending only what is left.
    cause = F.when(at_limit, "limit").when(F.col("broken"), "broken").when(F.col("mark") == 2, "mark").when((F.col("mark") == 1) & ~closed, "dots").when((F.col("mark") == 0) & is_open, "ending")
    cut = judged.select("trace_id", "step_pos", "call_pos", "field", "agent", cause.alias("cause")).where(F.col("cause").isNotNull())
    return cut.dropDuplicates(["trace_id", "step_pos", "call_pos", "field"]), texts, limits
