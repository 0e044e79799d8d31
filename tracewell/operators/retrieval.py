"""Ranked retrieval: profile index, coverage with gates, BM25, vectors, fusion, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import ERROR_ID, PROBLEM, facet_terms, fts_terms, intent, query_terms
from tracewell.plans.blocks import BLOCK, in_blocks
from tracewell.plans.runtime import stage

# Thresholds and weights of the ranking.
RECALL_THRESHOLD, RECALL_MARGIN, QUERY_THRESHOLD = 0.08, 0.55, 0.3
EMBED_THRESHOLD, EMBED_TOP, EMBED_STRONG, HYBRID_LEXICAL, HYBRID_EMBED = 0.45, 10, 0.62, 0.5, 0.5
WEIGHTS = {"name": 3, "applies_when": 3, "queries": 2, "symptoms": 2, "description": 1}
ANCHOR = 3
AUTHORING = r"(?i)\b(writ\w*|creat\w*|new|scaffold\w*|author\w*|generat\w*|template|scratch|bootstrap\w*|design\w*)\b"
BM25_WEIGHTS, K1, B = {"name": 5.0, "description": 3.0, "body": 1.0, "queries": 4.0}, 1.2, 0.75
RETRIEVABLE = ("active", "candidate")
DUPLICATE = 0.75
QUERY_DROP = ("a", "an", "the", "is", "are", "was", "i", "me", "my", "we")
KEYWORD_DROP = ("a", "an", "the", "of", "in", "for", "and", "or", "to", "with", "your", "my", "own", "our")


def latest_skills(skills: DataFrame) -> DataFrame:
    """A row per name, of its latest export (by updated, then version, then uses); status in small letters without blanks."""
    w = Window.partitionBy("name").orderBy(F.desc_nulls_last("updated"), F.desc_nulls_last("version"), F.desc_nulls_last("uses"), F.desc_nulls_last("recalls"))
    return skills.where(F.col("name").isNotNull()).withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth").withColumn("status", F.lower(F.trim("status")))


def retrievable(skills: DataFrame, *fields: str) -> DataFrame:
    """Name and ``fields`` of each retrievable skill, of its latest export. What other exports hold in ``fields`` isn't shuffled."""
    live = F.lower(F.trim("status")).isin(*RETRIEVABLE)
    slim = skills.select("name", "status", "updated", "version", "uses", "recalls", *(F.when(live, F.col(c)).alias(c) for c in fields))
    return latest_skills(slim).where(F.col("status").isin(*RETRIEVABLE)).select("name", *fields)


def profiles(skills: DataFrame) -> DataFrame:
    """(name, term, weight): a skill's terms with the greatest weight of the fields they stand in; the body is left out."""
    text = lambda c: F.regexp_replace("name", "-", " ") if c == "name" else F.col(c) if c == "description" else F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ")
    fields = F.array(*(F.struct(F.lit(w).alias("weight"), facet_terms(text(c)).alias("terms")) for c, w in WEIGHTS.items()))
    rows = skills.select("name", F.inline(fields)).select("name", "weight", F.explode("terms").alias("term"))
    return rows.groupBy("name", "term").agg(F.max("weight").alias("weight"))


def idf(index: DataFrame, names: DataFrame) -> DataFrame:
    """(term, idf): ln(1 + n / df), n skills; ``names`` is one row per skill."""
    n = names.agg(F.count("*").alias("n"))
    return index.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("term", F.log(1 + F.col("n") / F.col("df")).alias("idf"))


#: Terms of a skill by the field with the greatest weight in which they stand, joined by blanks: weights of the columns of ``covered``.
INDEXED = {"anchored": 3, "told": 2, "second": 2, "third": 1}


def covering(error: bool, k: int, near: tuple[int, int, float, float] | None = None):
    """A function of blocks (see ``coverage``): candidates of each query that pass the gates, (qid, name, score, weight).

    Of a block only those leave that can be among the ``k`` first: before them, by weight and score, stand fewer than ``k``
    whose score isn't less, so that any later threshold that they pass leaves fewer than ``k`` before them.

    With ``near`` (vectors, lexical, least cosine, strong cosine; see ``hybrid_recall``) the nearest skills of the block by
    vector are added, with or without a score, as many as ``vectors``, and of the others the ``lexical`` best by score alone;
    two more columns have the cosine and whether the vector alone may bring the skill (see ``precision_gate``).
    """

    def run(q, x):
        import re

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from tracewell.plans.blocks import Phrases, Postings, column, entries, joined_words, nearest

        x = x.take(pc.sort_indices(column(x, "name")))  # so that places are in order of names
        names, n_rows = column(x, "name"), x.num_rows
        found = [entries(joined_words(column(x, c))) for c in INDEXED]
        index = Postings(pa.concat_arrays([w for w, _ in found]), np.concatenate([r for _, r in found]))
        sizes = [len(r) for _, r in found]
        weights = np.repeat(np.array([*INDEXED.values()], np.float64), sizes)[index.order]
        anchor = np.repeat(np.array([1.0, 1.0, 0.0, 0.0]), sizes)[index.order]
        bars, phrases = Postings(*entries(joined_words(column(x, "bars")))), Phrases(column(x, "phrases"))
        anchors, authoring = (column(x, c).to_numpy(zero_copy_only=False) for c in ("anchors", "authoring"))
        broad = np.maximum(1.0, anchors / 4.0) ** 0.25
        special = np.array([bool(re.search(r"[_.0-9]", w)) for w in index.words], np.float64)
        if error:
            symptoms, nots, unlike = Phrases(column(x, "symptoms")), Phrases(column(x, "nots")), Postings(*entries(column(x, "unlike")))
        if "shown" in q.column_names:
            place = {w: i for i, w in enumerate(names.to_pylist())}
        if near:
            vectors, lexical, least, enough = near
            closest, q = nearest(q, x, vectors, least), q.drop_columns("v")
        at, own, scores, sums, cosines, alone = [], [], [], [], [], []
        for i, asked in enumerate(q.to_pylist()):
            terms, words = asked["terms"].split(), asked["words"].split()
            close, cosine = closest[i] if near else (anchors[:0], None)
            codes = index.codes(terms)
            hit = index.of(codes)
            known = dict(zip(terms, asked["idfs"], strict=True))
            sizes = [index.ends[c + 1] - index.ends[c] for c in codes]
            n = np.bincount(hit, minlength=n_rows)
            idfs = np.repeat([known[index.words[c]] for c in codes], sizes)
            mass = np.bincount(hit, np.concatenate([weights[index.place(c)] for c in codes]) * idfs if codes else None, n_rows)
            anchored = np.bincount(hit, np.concatenate([anchor[index.place(c)] for c in codes]) if codes else None, n_rows)
            phrase = phrases.shares(n_rows, words)
            told = None
            if error:
                some, shared = symptoms.met(words)
                size = symptoms.sizes[some]
                some, shared, size = (v[(shared >= 2) | (shared == size)] for v in (some, shared, size))
                whole = np.array([len(symptoms.texts[j]) >= 6 and symptoms.texts[j] in asked["low"] for j in some.tolist()], bool)
                some, share = (v[whole | ((shared >= 2) & (size >= 2))] for v in (some, np.where(whole, 1.0, shared / size)))
                told = symptoms.best(n_rows, some, share)
                phrase = np.maximum(phrase, told)
            strong = phrase >= QUERY_THRESHOLD
            c = np.flatnonzero(((n > 0) & ((anchored > 0) | (anchors == 0))) | strong) if terms else anchors[:0]
            if not len(c) and not len(close):
                continue
            barred = np.zeros(n_rows, bool)
            barred[bars.of(bars.codes(terms))] = True
            if told is not None and (told >= 0.6).any():
                # A told symptom outweighs a word: then most of a phrase must be there, or for a symptom word for word, the phrase.
                barred[told >= 0.6] = False
                some, shared = nots.met(terms)
                for j in some[(shared >= 2) & (shared / nots.sizes[some] >= 0.6)].tolist():
                    r = nots.owners.rows[nots.owners.place(j)]
                    barred[r[(told[r] >= 0.6) & (told[r] < 1)]] = True
                for j, said in enumerate(unlike.words):
                    if said and said in asked["low"]:
                        r = unlike.rows[unlike.place(j)]
                        barred[r[told[r] >= 1]] = True
            if "shown" in q.column_names and asked["shown"]:
                barred[[place[w] for w in asked["shown"] if w in place]] = True
            ok = ~barred[c]
            if not error:
                if len(terms) >= 3:
                    specific = np.bincount(hit, np.repeat(special[codes], sizes), n_rows) if codes else np.zeros(n_rows)
                    ok &= ~((n[c] == 1) & ~strong[c] & ~((specific[c] > 0) | ((anchored[c] > 0) & asked["problem"])))
                if asked["intent"] == "create":
                    ok &= authoring[c]
            c = c[ok]
            score = np.maximum(mass[c] / (asked["q_mass"] * 3.0 * broad[c]), phrase[c])
            c, score = c[score >= RECALL_THRESHOLD], score[score >= RECALL_THRESHOLD]
            if not len(c) and not len(close):
                continue
            weight = n[c] + 2 * strong[c] + (4 * (told[c] >= 0.6) if told is not None else 0)
            nice, left, best = np.round(score, 9), np.zeros(len(c), bool), np.zeros(0)
            for w in np.unique(weight)[::-1]:
                j = np.flatnonzero((weight == w) & (score > (best[-1] if len(best) == k else -1)))
                j = j[np.argsort(-nice[j], kind="stable")[:k]]
                for p in j.tolist():
                    if len(best) < k or score[p] > best[-1]:
                        left[p] = True
                        best = np.sort(np.append(best, score[p]))[::-1][:k]
            if near:
                other = np.flatnonzero(~np.isin(c, close))
                left |= np.isin(c, close)
                left[other[np.argsort(-np.round(score[other] / 2, 9), kind="stable")[:lexical]]] = True
            c, score, weight = c[left], score[left], weight[left]
            if near:
                rows = np.union1d(c, close)
                score, weight, cosine = (_spread(len(rows), np.searchsorted(rows, r), v) for r, v in ((c, score), (c, weight), (close, cosine)))
                c = rows
                cosines.append(cosine)
                alone.append(((asked["intent"] != "create") | authoring[c]) & ((cosine >= enough) | strong[c] | (anchors[c] == 0) | (anchored[c] > 0)) & ~barred[c])
            at.append(np.full(len(c), i))
            own.append(c)
            scores.append(score)
            sums.append(weight)
        joined = lambda v, kind: pa.array(np.concatenate(v) if v else [], kind, from_pandas=True)
        whole = lambda v: pc.cast(joined(v, pa.float64()), pa.int64())
        out = {"qid": column(q, "qid").take(joined(at, pa.int64())), "name": names.take(joined(own, pa.int64())), "score": joined(scores, pa.float64()), "weight": whole(sums)}
        return pa.table(out | ({"cosine": joined(cosines, pa.float64()), "alone": joined(alone, pa.bool_())} if near else {}))

    return run


def _spread(n, at, values):
    """``n`` values, those ``at`` some places; elsewhere not a number."""
    import numpy as np

    out = np.full(n, np.nan)
    out[at] = values
    return out


_FIRST = lambda: Window.partitionBy("qid").orderBy(F.desc("weight"), F.desc(F.round("score", 9)), "name")


def covered(queries: DataFrame, skills: DataFrame, k: int, error: bool = False, shown: DataFrame | None = None, vectors: DataFrame | None = None, near: tuple[int, int, float, float] | None = None) -> DataFrame:
    """(qid, name, score, weight): of the skills that cover a query's terms and pass all gates, those that can be among the
    ``k`` first within the margin, which ``within`` marks. With ``near`` also those that are near by ``vectors`` (qid, v), and
    two more columns. See ``coverage``, ``covering``."""
    empty = F.array().cast("array<string>")
    fields = ("description", "applies_when", "symptoms", "not_for", "queries")
    joined = lambda c: F.array_join(F.coalesce(c, empty), " ")
    keyed = lambda c, terms, least: F.filter(F.transform(F.coalesce(F.filter(c, lambda s: s.isNotNull()), empty), lambda s: F.when(F.size(terms(s)) >= least, terms(s))), lambda t: t.isNotNull())
    named = F.regexp_replace("name", "-", " ")
    lib = retrievable(skills, *fields, *(["embedding"] if near else []))
    lib = lib.withColumns({"anchored": facet_terms(F.concat_ws(" ", named, joined("applies_when"))), "told": facet_terms(joined("symptoms")) if error else empty, "second": facet_terms(F.concat_ws(" ", joined("queries"), joined("symptoms"))), "third": facet_terms(F.col("description"))})
    lib = lib.withColumn("own", F.array_union("anchored", "told"))
    index = {"anchored": F.col("anchored"), "told": F.array_except("told", "anchored"), "second": F.array_except("second", "own"), "third": F.array_except(F.array_except("third", "own"), "second")}
    cols = {"anchors": F.size("own"), "authoring": F.coalesce(F.concat_ws(" ", named, F.array_join("applies_when", " ")).rlike(AUTHORING), F.lit(False)), "bars": F.array_join(F.array_except(facet_terms(joined("not_for")), "own"), " "), "phrases": F.transform(keyed("queries", query_terms, 2), lambda t: F.array_join(t, " "))}
    if error:
        said = F.filter(F.transform(F.coalesce("symptoms", empty), lambda s: F.lower(F.trim(s))), lambda s: s.isNotNull() & (F.size(query_terms(s)) > 0))
        cols["symptoms"] = F.transform(said, lambda s: F.concat(F.array_join(query_terms(s), " "), F.lit("\n"), s))
        cols["nots"] = F.transform(keyed("not_for", lambda s: F.array_except(facet_terms(s), F.col("own")), 2), lambda t: F.array_join(t, " "))
        cols["unlike"] = F.filter(F.transform(F.coalesce("not_for", empty), F.lower), lambda s: s.isNotNull())
    if near:
        cols["v"] = F.col("embedding")
    lib = stage(lib.select("name", *(F.array_join(c, " ").alias(n) for n, c in index.items()), *(c.alias(n) for n, c in cols.items())), "skills")
    terms = F.filter(F.split(F.concat_ws(" ", *INDEXED), " "), lambda w: w != "")
    weights = stage(idf(lib.select("name", F.explode(terms).alias("term")), lib), "idf")
    most = weights.agg(F.max("idf").alias("most"))
    asked = queries.where(F.col("qid").isNotNull()).select("qid", "text", facet_terms(F.col("text")).alias("all"), query_terms(F.col("text")).alias("words"), intent(F.col("text")).alias("intent"))
    asked = stage(asked.where((F.lit(near is not None) | (F.size("all") > 0)) & (F.lit(error) | ~F.col("intent").isin("knowledge", "creative"))), "queries")
    told = asked.select("qid", F.explode("all").alias("term")).join(weights, "term", "left").join(F.broadcast(most))
    mass = told.groupBy("qid").agg(F.sum(F.coalesce("idf", "most", F.lit(1.0))).alias("q_mass"), F.collect_list(F.struct("term", "idf")).alias("t"))
    problem = F.lit(error) | F.col("text").rlike(ERROR_ID) | F.col("text").rlike(PROBLEM)
    known = [F.coalesce(F.array_join(F.transform("t", lambda t: t["term"]), " "), F.lit("")).alias("terms"), F.coalesce(F.transform("t", lambda t: t["idf"]), F.array().cast("array<double>")).alias("idfs")]
    asker = asked.join(mass, "qid", "left").select("qid", F.array_join("words", " ").alias("words"), "intent", F.coalesce("q_mass", F.lit(1.0)).alias("q_mass"), *known, F.coalesce(problem, F.lit(False)).alias("problem"), *([F.lower("text").alias("low")] if error else []))
    if shown is not None:
        asker = asker.join(shown.groupBy("qid").agg(F.collect_set("name").alias("shown")), "qid", "left")
    if near:
        asker = asker.join(vectors.select("qid", "v"), "qid", "left")
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, name string, score double, weight long" + (", cosine double, alone boolean" if near else "")
    return in_blocks(asker, lib, ("qid", "name"), covering(error, k, near), schema, staged=True, few=near is not None)


def within(found: DataFrame) -> DataFrame:
    """``found`` (see ``covered``) with ``lexical``: the score where it comes within the margin of the first, else null."""
    return found.withColumn("first", F.first("score").over(_FIRST())).withColumn("lexical", F.when(F.col("score") >= F.col("first") * RECALL_MARGIN, F.col("score"))).drop("first")


def coverage(queries: DataFrame, skills: DataFrame, k: int = 3, error: bool = False, shown: DataFrame | None = None) -> DataFrame:
    """(qid, rank, name, score): skills that cover a query's terms, with abstention.

    With ``error`` the queries are error texts: intents don't matter, recorded symptoms count as anchors and as phrases,
    and a skill whose symptom is told isn't ruled out by a single word. ``shown`` (qid, name) is left out of the result.

    ``queries``: qid (a key), text. Queries for knowledge or creative work get nothing. A skill is met through the index of
    terms or of phrase terms of its block, so no pair without a common word is looked at, and equal texts are asked once;
    then single-hit, anchor and not_for gates, score, threshold and margin to the first. Ties go to the lesser name.
    """
    asked = queries.where(F.col("qid").isNotNull() & (F.col("text") != "")).select("qid", "text")
    if shown is None:
        asked = stage(asked, "texts")
        texts = stage(asked.groupBy("text").agg(F.min("qid").alias("rep")), "distinct")
        found = covered(texts.select(F.col("rep").alias("qid"), "text"), skills, k, error)
    else:
        found = covered(asked, skills, k, error, shown)
    ranked = within(found).where("lexical is not null").withColumn("rank", F.row_number().over(_FIRST())).where(F.col("rank") <= k).select("qid", "rank", "name", "score")
    if shown is None:
        ranked = asked.join(texts, "text").select("qid", "rep").join(ranked.withColumnRenamed("qid", "rep"), "rep").select("qid", "rank", "name", "score")
    return ranked


def bm25(queries: DataFrame, skills: DataFrame, k: int = 5) -> DataFrame:
    """(qid, rank, name, score): BM25 over weighted fields of retrievable skills, through an inverted index; ties go to the
    lesser name."""
    lib = latest_skills(skills).where(F.col("status").isin(*RETRIEVABLE))
    field = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ") if c == "queries" else F.col(c)
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(field(c), F.lit(""))), F.lit("[a-z0-9_]{3,}"), F.lit(0))
    terms = lib.select("name", F.inline(F.array(*(F.struct(F.lit(w).alias("w"), words(c).alias("t")) for c, w in BM25_WEIGHTS.items())))).select("name", "w", F.explode("t").alias("term"))
    tf = terms.groupBy("name", "term").agg(F.sum("w").alias("tf"))
    size = tf.groupBy("name").agg(F.sum("tf").alias("len"))
    shape = size.agg(F.avg("len").alias("mean"), F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    asked = queries.where(F.col("qid").isNotNull()).select("qid", F.explode(F.array_distinct(fts_terms(F.col("text")))).alias("term"))
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    used = tf.join(asked.select("term").distinct(), "term", "left_semi")
    scores = asked.join(used, "term").join(df, "term").join(size, "name").join(F.broadcast(shape)).groupBy("qid", "name").agg(F.sum(part).alias("score"))
    top = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "name")
    return scores.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("qid", "rank", "name", "score")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 for vectors of different length or without length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int = EMBED_TOP, least: float = EMBED_THRESHOLD, block: int = 2000) -> DataFrame:
    """(qid, rank, id, cosine): the ``k`` nearest of all vectors for a stated set of queries, exactly.

    Queries (qid, v) and vectors (id, v) are packed into blocks of about ``block`` rows; each pair of blocks is one row for
    Python, so a vector travels once a block of queries and is multiplied with all of them. Only the ``k`` best of a query
    within a pair that reach ``least`` leave it. Ties go to the lesser id. A query isn't its own answer. Vectors of
    different lengths never meet; null and empty ones have no neighbours.
    """
    usable = lambda d, c: d.where(F.col(c).isNotNull() & (F.size("v") > 0)).select(c, "v")
    kinds = queries.schema["qid"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    same, salts = kinds[0] == kinds[1], 16

    def packed(d: DataFrame, c: str, at: str, rows: str) -> tuple[DataFrame, int]:
        n = max(1, -(-d.count() // block))
        hashed = d.groupBy(F.pmod(F.xxhash64(c), F.lit(n)).cast("int").alias(at), F.size("v").alias("dim"))
        return hashed.agg(F.collect_list(F.struct(F.col(c).alias("k"), "v")).alias(rows)), n  # about ``block`` rows

    (q, blocks), (x, _) = packed(usable(queries, "qid"), "qid", "b", "qs"), packed(usable(vectors, "id"), "id", "c", "xs")
    q = q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    x = x.withColumns({"salt": F.pmod("c", F.lit(salts)), "b": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    met = q.join(x, ["b", "dim", "salt"]).select("qs", "xs")

    def run(batches):
        import numpy as np
        import pandas as pd

        unit = lambda rows: (x := np.stack(rows).astype(np.float64)) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        none = pd.DataFrame({"qid": [], "id": [], "cosine": []})
        for p in batches:
            out = [none]
            for qs, xs in zip(p["qs"], p["xs"], strict=True):
                qid, ids = (np.array([r["k"] for r in rows], object) for rows in (qs, xs))
                asked, known = unit([r["v"] for r in qs]), unit([r["v"] for r in xs]).T
                for at in range(0, len(asked), 500):  # a few at a time, for memory
                    c, own = asked[at : at + 500] @ known, qid[at : at + 500]
                    if same:
                        c[own[:, None] == ids] = -2
                    for i in np.flatnonzero(c.max(1) >= least - 1e-12):
                        near = np.flatnonzero(c[i] >= least - 1e-12)
                        if len(near) > k:  # those that tie with the last one stay
                            near = near[c[i, near] >= np.partition(c[i, near], -k)[-k] - 1e-9]
                        out.append(pd.DataFrame({"qid": own[i], "id": ids[near], "cosine": c[i, near]}))
            yield pd.concat(out) if len(out) > 1 else none

    near = met.mapInPandas(run, f"qid {kinds[0]}, id {kinds[1]}, cosine double")
    top = Window.partitionBy("qid").orderBy(F.desc(F.round("cosine", 9)), "id")
    return near.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("qid", "rank", "id", "cosine")


def hybrid(lexical: DataFrame, vectors: DataFrame, k: int = 3) -> DataFrame:
    """(qid, rank, id, score): lexical (qid, id, score) and vector (qid, id, cosine) candidates in one ranking."""
    return fused(lexical.join(vectors, ["qid", "id"], "full"), k)


def fused(both: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, score): candidates (qid, id, score, cosine) in one ranking; what a candidate lacks is null."""
    score = HYBRID_LEXICAL * F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0))) + HYBRID_EMBED * F.coalesce("cosine", F.lit(0.0))
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("fused", 9)), "id")
    d = both.select("qid", "id", score.alias("fused"))
    d = d.withColumn("best", F.first("fused").over(w)).where(F.col("fused") >= F.col("best") * RECALL_MARGIN)
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "id", F.col("fused").alias("score"))


def facts_of(kept: DataFrame) -> DataFrame:
    """(name, anchor_terms, phrases, bars, authoring): what the gates ask of a skill; ``kept`` is one row a skill."""
    empty = F.array().cast("array<string>")
    joined = lambda c: F.array_join(F.coalesce(c, empty), " ")
    anchors = facet_terms(F.concat_ws(" ", F.regexp_replace("name", "-", " "), joined("applies_when")))
    d = kept.select("name", anchors.alias("anchor_terms"), F.transform(F.coalesce("queries", empty), query_terms).alias("phrases"), facet_terms(joined("not_for")).alias("not"), F.concat_ws(" ", F.regexp_replace("name", "-", " "), F.array_join("applies_when", " ")).rlike(AUTHORING).alias("authoring"))
    return d.select("name", "anchor_terms", "phrases", F.array_except("not", "anchor_terms").alias("bars"), F.coalesce("authoring", F.lit(False)).alias("authoring"))


def phrase_share(phrases: Column, words: Column) -> Column:
    """The best share of a phrase's terms among ``words``, of phrases of two terms with two shared or a share of 0.6; else 0."""

    def one(p: Column) -> Column:
        both = F.size(F.array_intersect(p, words))
        return F.when((F.size(p) >= 2) & ((both >= 2) | (both / F.size(p) >= 0.6)), both / F.size(p)).otherwise(0.0)

    return F.coalesce(F.array_max(F.transform(phrases, one)), F.lit(0.0))


def precision_gate(candidates: DataFrame, queries: DataFrame, skills: DataFrame, strong: float = EMBED_STRONG) -> DataFrame:
    """``candidates`` (qid, name, cosine) that a vector alone may bring: the query asks for a task, or for authoring of a
    skill about that; the cosine is ``strong``, or an anchor or a phrase is met (or the skill has no anchor); and no word
    stands against it. ``queries``: qid, text; ``skills`` is one row a skill."""
    asked = queries.select("qid", facet_terms(F.col("text")).alias("terms"), query_terms(F.col("text")).alias("words"), intent(F.col("text")).alias("intent"))
    d = candidates.join(asked, "qid").join(facts_of(skills), "name")
    near = (F.col("cosine") >= strong) | (phrase_share(F.col("phrases"), F.col("words")) >= QUERY_THRESHOLD) | (F.size("anchor_terms") == 0) | F.arrays_overlap("anchor_terms", "terms")
    ok = F.col("intent").isin("task", "create") & ((F.col("intent") != "create") | F.col("authoring")) & near & ~F.arrays_overlap("bars", "terms")
    return d.where(F.coalesce(ok, F.lit(False))).select("qid", "name", "cosine")


def hybrid_recall(queries: DataFrame, vectors: DataFrame, skills: DataFrame, k: int = 3, least: float = EMBED_THRESHOLD, strong: float = EMBED_STRONG) -> DataFrame:
    """(qid, rank, name, score): lexical hits and the nearest skills by vector, fused; those that only a vector brings pass
    the precision gate first. ``queries``: qid, text; ``vectors``: qid, v; skills with a vector of that length take part.

    Both are found in one pass over blocks of skills, so a skill travels once for each block of queries. The nearest of all are
    among the nearest of each block. A lexical hit that isn't near counts by its score alone, so of these no more than the
    ``k`` best of a block can be among the first."""
    top = Window.partitionBy("qid").orderBy(F.desc_nulls_last(F.round("cosine", 9)), "name")
    found = covered(queries, skills, 1, vectors=vectors, near=(EMBED_TOP, k, least, strong))
    d = within(found).withColumn("nth", F.row_number().over(top))
    near = (F.col("nth") <= EMBED_TOP) & F.col("cosine").isNotNull() & (F.col("lexical").isNotNull() | F.col("alone"))
    d = d.select("qid", F.col("name").alias("id"), F.col("lexical").alias("score"), F.when(near, F.col("cosine")).alias("cosine"))
    return fused(d.where("score is not null or cosine is not null"), k).withColumnRenamed("id", "name")


def covering_best(least: float):
    """A function of blocks (see ``duplicates_of``): the skill that covers each lesson best, (id, name, score)."""

    def run(q, x):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from tracewell.plans.blocks import Phrases, Postings, column, entries, listed

        x = x.take(pc.sort_indices(column(x, "name")))  # so that places are in order of names
        index, phrases, names = Postings(*entries(column(x, "anchor_terms"))), Phrases(column(x, "phrases")), column(x, "name")
        anchors = pc.list_value_length(column(x, "anchor_terms")).to_numpy(zero_copy_only=False)
        need = np.maximum(np.ceil(least * anchors - 1e-9), 1).astype(np.int64)
        met: dict[tuple, tuple[float, int] | None] = {}  # by the words that any skill of the block has

        def best(codes: list[int], words: list[str]) -> tuple[float, int] | None:
            n = np.bincount(index.of(codes), minlength=x.num_rows)
            c = np.flatnonzero(n >= need)
            found = [(float(v), int(r)) for v in [(n[c] / anchors[c]).max(initial=0.0)] for r in c[n[c] / anchors[c] >= v - 1e-12][:1] if v >= least]
            some, shared = phrases.met(words)
            share = shared / phrases.sizes[some]
            for j in np.flatnonzero((share >= least) & ((shared >= 2) | (share >= 0.6))).tolist():
                r = phrases.owners.rows[phrases.owners.place(some[j])]
                found += [(float(share[j]), int(i)) for i in r[n[r] > 0][:1]]
            return min(found, key=lambda f: (-round(f[0], 9), f[1]), default=None)

        at, own, scores = [], [], []
        for i, (terms, words) in enumerate(listed(q, "terms", "words")):
            codes, words = sorted(index.codes(terms)), [w for w in words if w in phrases.index.at]
            if not codes:
                continue
            key = (*codes, -1, *sorted(phrases.index.codes(words)))
            if key not in met:
                met[key] = best(codes, words)
            if met[key]:
                at.append(i)
                scores.append(met[key][0])
                own.append(met[key][1])
        return pa.table({"id": column(q, "id").take(pa.array(at, pa.int64())), "name": names.take(pa.array(own, pa.int64())), "score": pa.array(scores, pa.float64())})

    return run


def duplicates_of(lessons: DataFrame, skills: DataFrame, least: float = DUPLICATE) -> DataFrame:
    """(id, name, score): the skill that covers a lesson's situation: the greatest of the share of its anchors in the
    lesson's terms and of its best phrase, where an anchor is shared and the score is ``least`` or more; ties go to the lesser
    name. ``lessons``: id, triggers, rule; ``skills``: one row a skill, of any status. Only the best of each block of skills
    leaves it."""
    probe = F.concat_ws(" ", F.array_join(F.coalesce("triggers", F.array().cast("array<string>")), " "), F.coalesce("rule", F.lit("")))
    asked = lessons.select("id", facet_terms(probe).alias("terms"), query_terms(probe).alias("words"))
    own = facts_of(skills).select("name", "anchor_terms", F.transform(F.filter("phrases", lambda p: F.size(p) >= 2), lambda p: F.array_join(p, " ")).alias("phrases"))
    d = in_blocks(asked, own, ("id", "name"), covering_best(least), f"id {lessons.schema['id'].dataType.simpleString()}, name string, score double", 4 * BLOCK)
    best = d.groupBy("id").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "name", "score")).alias("b"))
    return best.select("id", "b.name", "b.score")


def _words(c: Column, drop: tuple[str, ...] = ()) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\W+"), lambda w: (w != "") & ~w.isin(*drop, "")))


def chunk_score(text: Column, title: Column, category: Column, keywords: Column) -> Column:
    """3 for each word shared with the title, 2 with the category, 2 for each keyword that stands in the text, and 1 more
    for each of several words of which at most one is missing. Empty words don't count; null texts and lists are empty."""
    low, tokens = F.lower(F.coalesce(text, F.lit(""))), _words(text, QUERY_DROP)

    def one(total: Column, k: Column) -> Column:
        parts = _words(k, KEYWORD_DROP)
        near = (F.size(parts) > 1) & (F.size(F.array_intersect(parts, tokens)) >= F.greatest(F.lit(1), F.size(parts) - 1))
        return total + F.when(F.contains(low, F.lower(k)) & (k != ""), 2).otherwise(0) + F.when(near, 1).otherwise(0)

    return 3 * F.size(F.array_intersect(_words(title), tokens)) + 2 * F.size(F.array_intersect(_words(category), tokens)) + F.aggregate(F.coalesce(keywords, F.array().cast("array<string>")), F.lit(0), one)


def newest(k: int, shared: int):
    """A function of blocks (see ``related_lessons``): the ``k`` newest lessons for each query, (qid, id, ts, shared)."""

    def run(q, x):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from tracewell.plans.blocks import Postings, column, entries, listed

        x = x.take(pc.sort_indices(x.select(["old", "ts", "id"]), sort_keys=[("old", "ascending"), ("ts", "descending"), ("id", "ascending")]))
        index, ids, n = Postings(*entries(column(x, "words"))), column(x, "id"), x.num_rows
        place = {w: i for i, w in enumerate(ids.to_pylist())}
        at, own, counts = [], [], []
        for i, (qid, words) in enumerate(listed(q, "qid", "words")):
            lists = [index.rows[index.place(c)] for c in index.codes(words)]
            if len(lists) < shared:
                continue
            upto = 1 << 10
            while True:  # the newest first, as many as needed
                met = np.bincount(np.concatenate([r[: np.searchsorted(r, upto)] for r in lists]))
                near = np.flatnonzero(met >= shared)
                near = near[near != place.get(qid, -1)][:k]
                if len(near) == k or upto >= n:
                    break
                upto *= 8
            at.append(np.full(len(near), i))
            own.append(near)
            counts.append(met[near])
        joined = lambda v: pa.array(np.concatenate(v) if v else [], pa.int64())
        own = joined(own)
        return pa.table({"qid": column(q, "qid").take(joined(at)), "id": ids.take(own), "ts": column(x, "ts").take(own), "shared": joined(counts)})

    return run


def related_lessons(queries: DataFrame, lessons: DataFrame, k: int = 4, shared: int = 3) -> DataFrame:
    """(qid, rank, id, shared): generalizable lessons that share at least ``shared`` distinctive words with a query lesson.

    Both are (id, words, ts, generalizable), ids keys, words distinct. Shared words are counted through an index of words of
    a block of lessons in order of time, from which only the ``k`` newest leave. Newest first; ties go to the lesser id.
    """
    old = F.when(F.col("ts").isNull(), 2).when(F.isnan(F.col("ts").cast("double")), 0).otherwise(1)  # as Spark orders them
    index = lessons.where(F.col("generalizable") & F.col("id").isNotNull()).select("id", "words", "ts", old.alias("old"))
    asked = queries.where(F.col("id").isNotNull()).select(F.col("id").alias("qid"), "words")
    kind = {c: lessons.schema[c].dataType.simpleString() for c in ("id", "ts")}
    pairs = in_blocks(asked, index, ("qid", "id"), newest(k, shared), f"qid {kind['id']}, id {kind['id']}, ts {kind['ts']}, shared int")
    top = Window.partitionBy("qid").orderBy(F.desc_nulls_last("ts"), "id")
    return pairs.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("qid", "rank", "id", "shared")


def chunk_topk(queries: DataFrame, chunks: DataFrame, k: int = 6, fallback: int = 3) -> DataFrame:
    """(qid, rank, chunk, score): the ``k`` best chunks of each query; a query without any gets the first ``fallback``.

    ``queries``: qid, text; ``chunks``: chunk, title, category, keywords. Chunks are met through an index of the words of
    title, category and keywords, and of the first three characters of keywords (a keyword that stands in a text begins with
    three characters of it). Ties go to the lesser chunk; the first chunks are those with the least names.
    """
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    starts = F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1)))
    grams = F.flatten(F.transform(starts, lambda i: F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda n: F.concat(F.lit("="), F.substring(low, i, n)))))
    asked = queries.where(F.col("qid").isNotNull()).select("qid", "text", F.array_union(_words(F.col("text"), QUERY_DROP), F.array_distinct(grams)).alias("keys"))
    own = chunks.where(F.col("chunk").isNotNull()).select("chunk", "title", "category", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))
    heads = F.transform(F.filter("keywords", lambda x: x != ""), lambda x: F.concat(F.lit("="), F.left(F.lower(x), F.lit(3))))
    index = own.select("chunk", F.explode(F.array_union(_words(F.concat_ws(" ", "title", "category", F.array_join("keywords", " "))), heads)).alias("key"))
    met = asked.select("qid", F.explode("keys").alias("key")).join(index, "key").select("qid", "chunk").distinct()
    scored = met.join(asked.select("qid", "text"), "qid").join(own, "chunk").select("qid", "chunk", chunk_score(F.col("text"), F.col("title"), F.col("category"), F.col("keywords")).alias("score")).where("score > 0")
    top = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "chunk"))).where(F.col("rank") <= k)
    first = own.select("chunk").distinct().orderBy("chunk").limit(fallback).withColumn("rank", F.row_number().over(Window.orderBy("chunk")))  # ``fallback`` rows
    rest = asked.select("qid").join(top.select("qid").distinct(), "qid", "left_anti").withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(fallback))))
    return top.select("qid", "rank", "chunk", "score").unionByName(rest.join(F.broadcast(first), "rank").select("qid", "rank", "chunk", F.lit(0).alias("score")))
