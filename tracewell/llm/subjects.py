"""Subject areas of documents, by distributed latent Dirichlet allocation (problem 8).

The model is fitted first, from starts that come from the corpus alone. Words in at least ``OWN_SHARE`` of the documents
have a row each (their number is bounded by the mean number of words of a document over that share); all rarer words share
``HASHED`` rows, so none is left out. Topics, fewer where words are few, start at anchors: words whose company in documents is farthest from that of
the words taken before (Gram-Schmidt over rows of co-occurrence, held as a random projection of fixed width). Variational
EM then runs over all documents until the share of words that change their topic falls below ``SETTLED``; each round is one
map, in which a task adds expected counts of (row, topic), a table whose size is fixed. A document's later steps look only
at the topics that carry weight in it, and end when its proportions no longer move.

After the fit each topic's top terms are listed, and the topic is given the subject whose inspected terms (``TERMS``, drawn
up by reading such lists) weigh most among them, if they outweigh those of any other subject; the rest belong to none. The
words of a statement vote for the subjects of their topics, given the document's proportions, by how much more likely they
are there than anywhere; a subject is given where its share of the statements is ``SHARE`` or more.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.plans.runtime import spread, stage

#: Terms found by inspecting the top terms of fitted topics, by subject; in English, German and Spanish.
TERMS = {
    "version_control": ("merge commit branch stash rebase tag", "zweig anwenden zusammenführen konflikt historie", "rama fusionar fusión etiqueta historial"),
    "packaging": ("package wheel lockfile distribution yanked editable", "abhängigkeit paket umgebung sperrdatei version", "paquete dependencia entorno versión"),
    "databases": ("migration index table replica query transaction", "transaktion tabelle abfrage fremdschlüssel", "tabla transacción índice consulta foránea"),
    "networking": ("proxy packet port route gateway handshake", "namensauflösung lastverteiler verbindung route", "puerto balanceador conexión ruta resolución"),
    "containers": ("pod image node volume container deployment", "volume knoten image replica container pod leeren", "volumen nodo contenedor imagen réplica"),
    "testing": ("test suite fixture flaky teardown snapshot", "testlauf testabdeckung testfall erwartungswert", "prueba cobertura aserción pruebas simular"),
    "file_formats": ("header field parse encoding schema comma", "spalten kodierung trennzeichen kopfzeile feld", "cabecera columnas campo codificación fichero"),
    "security": ("certificate credential permission session signature account", "zertifikat rechte zugriffsregel berechtigung", "firma certificado permisos regla acceso"),
    "scheduling": ("queue lease cron job clock overlapping", "warteschlange zeitplan zeitzone auftrag lauf", "tarea cola horaria ejecución horario"),
    "observability": ("alert metric latency span log label", "alarm metrik latenz protokollzeile", "alerta métrica latencia registro traza"),
}
#: Topics, at most, and words with a row of their own for each.
TOPICS, WORDS_A_TOPIC = 128, 6
OWN_SHARE, HASHED = 0.001, 1024
#: Shares of documents between which a word may be an anchor, and the width of the projection.
ANCHOR_FROM, ANCHOR_TO, WIDTH = 0.005, 0.1, 512
SETTLED, MOST_ROUNDS = 0.07, 40
FULL_STEPS, STEPS, KEPT, STILL = 2, 12, 16, 0.002
ALPHA, ETA = 0.1, 0.02
SHARE = 0.25
#: A topic is given a subject for at least so many of its terms among so many top ones, of at least that weight, and that
#: many times the weight of the next subject's.
LEAST_TERMS, TOP_TERMS, LEAST_WEIGHT, MARGIN = 3, 40, 0.03, 2.0
#: Least sum of log ratios (word in topic : word anywhere) by which a statement counts for a subject.
EVIDENCE = 4.0
#: Added to a document's topic proportions when they serve as prior of its words.
PRIOR = 0.003
PER = 64  # rows of a table of sums in one record

_word = re.compile(r"[^\W\d_]+").findall
_lead = re.compile(r"^\s*(?:\[\d+\]\s*[A-Z]+:|[-*+]\s+(?:\[[ x]\]\s*)?|\d+[.)]\s+|>\s*)+\s*")
_end = re.compile(r"(?<=[.!?])\s+|\n+")
_skip = re.compile(r"^\s*(?:#|```|v\d+\.\d+|[A-Z]{4,}\s*$|\|)")
_tag = re.compile(r"</?[a-zA-Z][^<>]{0,80}>")


def statements(text: str) -> list[str]:
    """The statements of a text: sentences and list items, without headings, fences and table rows."""
    out = []
    for part in _end.split(_tag.sub(" ", text)):
        if part and not _skip.match(part):
            part = _lead.sub("", part)
            if len(_word(part)) >= 2:
                out.append(part)
    return out


def _digamma(x: np.ndarray) -> np.ndarray:
    """Digamma for positive numbers, by recurrence and the asymptotic series."""
    shift = np.zeros_like(x)
    x = x.copy()
    for _ in range(6):
        low = x < 6
        shift = np.where(low, shift - 1 / x, shift)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


class Bags:
    """Documents as rows of words and counts, laid end to end; ``at`` holds where each begins."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, at: np.ndarray):
        self.ids, self.counts, self.at = ids, counts, at
        self.size = np.diff(at)

    @classmethod
    def of(cls, b: pa.RecordBatch) -> Bags:
        """Bags of a batch with columns ids and counts (lists of integers, none null)."""
        at = b.column("ids").offsets.to_numpy()
        return cls(b.column("ids").flatten().to_numpy(), b.column("counts").flatten().to_numpy(), at - at[0])

    def blocks(self, cells: int = 16_384) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(documents, ids, counts) of documents of like length, padded with counts of 0; at most ``cells`` a block, or one document."""
        order = np.argsort(self.size, kind="stable")
        order = order[self.size[order] > 0]
        i = 0
        while i < len(order):
            # Sizes rise, so a block is as long as its last document allows.
            n = max(1, int(np.searchsorted(np.arange(1, min(512, len(order) - i) + 1) * self.size[order[i : i + 512]], cells, side="right")))
            some = order[i : i + n]
            wide = int(self.size[some[-1]])
            place = self.at[some][:, None] + np.arange(wide)
            real = np.arange(wide) < self.size[some][:, None]
            place = np.where(real, place, self.at[some][:, None])
            yield some, self.ids[place], np.where(real, self.counts[place], 0).astype(np.float32)
            i += n


def infer(ids: np.ndarray, counts: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gamma, kept, weights, b) of a block: Dirichlet parameters of all topics; the topics that carry weight in each
    document, the expected counts of its words by those, and their word weights."""
    n, k = len(ids), beta.shape[1]
    b = beta[ids]
    gamma = np.full((n, k), ALPHA + counts.sum(1, keepdims=True) / k, np.float32)
    for _ in range(FULL_STEPS):
        t = np.exp(_digamma(gamma) - _digamma(gamma.sum(1, keepdims=True))).astype(np.float32)
        weight = counts / (np.matmul(b, t[:, :, None])[:, :, 0] + 1e-30)
        gamma = ALPHA + t * np.matmul(weight[:, None, :], b)[:, 0, :]
    few = min(KEPT, k)
    kept = np.argpartition(-gamma, few - 1, axis=1)[:, :few]
    b = np.take_along_axis(b, kept[:, None, :], axis=2)
    rest = ALPHA * (k - few)
    g = np.take_along_axis(gamma, kept, axis=1)
    g = ALPHA + (g - ALPHA) * (counts.sum(1, keepdims=True) / np.maximum((g - ALPHA).sum(1, keepdims=True), 1e-30))
    for _ in range(STEPS - FULL_STEPS):
        t = np.exp(_digamma(g) - _digamma(g.sum(1, keepdims=True) + rest)).astype(np.float32)
        weight = counts / (np.matmul(b, t[:, :, None])[:, :, 0] + 1e-30)
        new = ALPHA + t * np.matmul(weight[:, None, :], b)[:, 0, :]
        moved = np.abs(new - g).sum(1) / new.sum(1)
        g = new
        if moved.max() < STILL:
            break
    gamma = np.full((n, k), ALPHA, np.float32)
    np.put_along_axis(gamma, kept, g, axis=1)
    return gamma, kept, weight[:, :, None] * t[:, None, :] * b, b


def expectation(bags: Bags, beta: np.ndarray, sums: np.ndarray) -> None:
    """Add the expected counts of (row, topic) over ``bags`` to ``sums``."""
    k = beta.shape[1]
    keys, values = [], []
    for _, ids, counts in bags.blocks():
        _, kept, w, _ = infer(ids, counts, beta)
        real = counts > 0
        keys.append((ids[:, :, None].astype(np.int64) * k + kept[:, None, :])[real].ravel())
        values.append(w[real].ravel())
    if keys:
        sums += np.bincount(np.concatenate(keys), np.concatenate(values), sums.size).reshape(sums.shape)


def projection(share: np.ndarray) -> np.ndarray:
    """A random projection of rows over words with the given shares: signs over the root of the share."""
    signs = np.random.default_rng(5).integers(0, 2, (len(share), WIDTH), dtype=np.int8) * 2 - 1
    return (signs / np.sqrt(np.maximum(share, 1e-9))[:, None] / np.sqrt(WIDTH)).astype(np.float32)


def company(bags: Bags, project: np.ndarray, row_of: np.ndarray, sums: np.ndarray) -> None:
    """Add to the row of each candidate word the mean projection of the other words with a row of their own, by document."""
    own = len(project)
    for a, e in zip(bags.at[:-1], bags.at[1:], strict=True):
        ids = bags.ids[a:e]
        ids = ids[ids < own]
        at = row_of[ids]
        here = at >= 0
        if len(ids) > 1 and here.any():
            p = project[ids]
            sums[at[here]] += (p.sum(0) - p[here]) / (len(ids) - 1)


def anchors(rows: np.ndarray, seen: np.ndarray, mean: np.ndarray, k: int) -> list[int]:
    """Places of up to ``k`` rows, each the farthest from the span of those before; ``rows`` are sums over ``seen`` documents."""
    x = rows / np.maximum(seen, 1)[:, None] - mean
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    out: list[int] = []
    while len(out) < min(k, len(x)):
        left = (x**2).sum(1)
        j = int(left.argmax())
        if left[j] < 1e-6:
            break
        out.append(j)
        b = x[j] / np.sqrt(left[j])
        x = x - np.outer(x @ b, b)
    return out


def beside(bags: Bags, topic_of: np.ndarray, sums: np.ndarray) -> None:
    """Add to (row, topic) how often a word stands in a document of the topic's anchor, each document weighing 1."""
    k = sums.shape[1]
    keys, values = [], []
    for a, e in zip(bags.at[:-1], bags.at[1:], strict=True):
        ids = bags.ids[a:e]
        t = topic_of[ids]
        t = t[t >= 0]
        if len(t):
            keys.append((ids[:, None].astype(np.int64) * k + t).ravel())
            values.append(np.full(len(ids) * len(t), 1 / len(ids)))
    if keys:
        sums += np.bincount(np.concatenate(keys), np.concatenate(values), sums.size).reshape(sums.shape)


class Topics:
    """A fitted model: rows of words, weights of rows by topic, the subject of each topic, and the words' overall shares."""

    def __init__(self, words: list[str], counts: np.ndarray, beta: np.ndarray, subjects: list[str]):
        self.place = {w: i for i, w in enumerate(words)}
        self.words, self.beta, self.subjects = words, beta, subjects
        self.total = counts / max(1.0, counts.sum())
        self.of = np.full(beta.shape[1], -1)

    def top_terms(self) -> list[list[str]]:
        """For each topic its top terms, by weight and by how much likelier they are in it than anywhere."""
        own = self.beta[: len(self.words)]
        lift = own * np.log(np.maximum(own / np.maximum(self.total[: len(own), None], 1e-12), 1e-12))
        return [[self.words[i] for i in np.argsort(-lift[:, t], kind="stable")[:TOP_TERMS]] for t in range(own.shape[1])]

    def map_topics(self) -> list[tuple[int, str | None, list[str]]]:
        """Give each topic the subject whose inspected terms weigh most among its top terms; (topic, subject, top terms)."""
        out = []
        sizes = [len(" ".join(TERMS.get(s, (s.replace("_", " "),))).split()) for s in self.subjects]
        known = {w: i for i, s in enumerate(self.subjects) for g in TERMS.get(s, (s.replace("_", " "),)) for w in g.split()}
        for t, top in enumerate(self.top_terms()):
            score, met = np.zeros(len(self.subjects)), np.zeros(len(self.subjects))
            for w in top:
                if w in known:
                    score[known[w]] += self.beta[self.place[w], t]
                    met[known[w]] += 1
            best, j = np.sort(score), int(score.argmax())
            if met[j] >= min(LEAST_TERMS, sizes[j]) and best[-1] > LEAST_WEIGHT and (len(best) < 2 or best[-1] >= MARGIN * best[-2]):
                self.of[t] = j
            out.append((t, self.subjects[self.of[t]] if self.of[t] >= 0 else None, top))
        return out

    def shares(self, bags: Bags, said: list[np.ndarray], ends: list[np.ndarray]) -> list[dict[str, float]]:
        """For each document, the share of its statements by subject. ``said``: places in the document's bag of the distinct
        words of its statements, end to end; ``ends``: where each statement ends there."""
        vote = np.zeros((self.beta.shape[1], len(self.subjects) + 1), np.float32)
        vote[np.arange(len(self.of)), self.of] = 1
        lift = np.maximum(np.log(self.beta + 1e-9) - np.log(self.total[:, None] + 1e-9), 0).astype(np.float32)
        lift[len(self.words) :] = 0  # a shared row says nothing of the word
        out: list[dict[str, float]] = [{} for _ in said]
        for some, ids, counts in bags.blocks():
            gamma, *_ = infer(ids, counts, self.beta)
            theta = gamma / gamma.sum(1, keepdims=True) + PRIOR
            q = theta[:, None, :] * self.beta[ids]
            votes = np.matmul(q * lift[ids], vote)[:, :, :-1] / q.sum(2)[:, :, None]  # documents, words, subjects
            for d, e in zip(some, votes, strict=True):
                score = np.add.reduceat(e[said[d]], np.append(0, ends[d][:-1]), axis=0)
                best = score.argmax(1)
                for j in best[score[np.arange(len(score)), best] >= EVIDENCE]:
                    name = self.subjects[j]
                    out[d][name] = out[d].get(name, 0) + 1 / len(score)
        return out


def pack(docs: list[list[int]]) -> Bags:
    """Bags of lists of rows, each bag in order of rows."""
    ids, counts, at = [], [], [0]
    for d in docs:
        c: dict[int, int] = {}
        for i in d:
            c[i] = c.get(i, 0) + 1
        own = sorted(c)
        ids += own
        counts += [c[i] for i in own]
        at.append(len(ids))
    return Bags(np.array(ids, np.int32), np.array(counts, np.int32), np.array(at))


def _lists(c: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column of lists of integers, none null."""
    return np.split(c.flatten().to_numpy(), c.offsets.to_numpy()[1:-1] - c.offsets.to_numpy()[0])


def _added(bags: DataFrame, shape: tuple[int, int], add) -> np.ndarray:
    """The sum of a table of fixed ``shape`` to which ``add(bags, sums)`` adds, over all rows; only records of ``PER`` rows
    are shuffled, as many for each task as the table has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(shape, np.float64)
        for b in batches:
            add(Bags.of(b), sums)
        if sums.any():
            at = range(0, len(sums), PER)
            yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.int32()), pa.array([sums[a : a + PER].astype(np.float32).tobytes() for a in at], pa.binary())], ["at", "sums"])

    def total(t: pa.Table) -> pa.Table:
        x = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in t.column("sums").to_pylist())
        return pa.table({"at": t.column("at")[:1], "sums": pa.array([x.tobytes()], pa.binary())})

    out = np.zeros(shape)
    for at, x in bags.mapInArrow(run, "at int, sums binary").groupBy("at").applyInArrow(total, "at int, sums binary").collect():  # the table
        out[at : at + PER] = np.frombuffer(x, np.float64).reshape(-1, shape[1])
    return out


def fit(documents: DataFrame, subjects: list[str]) -> tuple[Topics, DataFrame] | None:
    """The model of ``documents`` (doc_id, text; no nulls), with its topics mapped to ``subjects``, and the documents as
    bags of rows (doc_id, ids, counts, said, ends: see ``Topics.shares``); None without words."""
    context = documents.sparkSession.sparkContext

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, ends = [], []
            for t in b.column(1).to_pylist():
                own: list[str] = []
                end = []
                for s in statements(t):
                    own += _word(s.lower())
                    end.append(len(own))
                words.append(own)
                ends.append(end)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))], ["doc_id", "w", "ends"])

    texts = documents.select("doc_id", "text").mapInArrow(split, "doc_id long, w array<string>, ends array<int>").where(F.size("w") > 0)
    texts = stage(texts, "subject-words")
    n = texts.count()
    seen = texts.select(F.explode(F.array_distinct("w")).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    words = sorted(tuple(r) for r in seen.where(F.col("df") >= max(2.0, n * OWN_SHARE)).collect())  # as many as a share allows
    if not words or not subjects:
        return None
    df = np.array([c for _, c in words], np.float64)
    held = context.broadcast({w: i for i, (w, _) in enumerate(words)})

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = held.value
        for b in batches:
            rows, said, ends = [], [], []
            for d, end in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                own = [i if (i := place.get(w)) is not None else len(place) + zlib.crc32(w.encode()) % HASHED for w in d]
                at = {w: i for i, w in enumerate(sorted(set(own)))}
                flat: list[int] = []
                upto = []
                for a, e in zip([0, *end], end, strict=False):
                    flat += {at[w] for w in own[a:e]}
                    upto.append(len(flat))
                rows.append(own)
                said.append(flat)
                ends.append(upto)
            x = pack(rows)
            lists = [pa.ListArray.from_arrays(pa.array(x.at, pa.int32()), pa.array(v, pa.int32())) for v in (x.ids, x.counts)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists, pa.array(said, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], ["doc_id", "ids", "counts", "said", "ends"])

    whole = stage(texts.mapInArrow(number, "doc_id long, ids array<int>, counts array<int>, said array<int>, ends array<int>"), "subject-bags")
    bags = whole.select("ids", "counts")
    rows = len(words) + HASHED
    share = df / df.sum()
    among = np.flatnonzero((df >= ANCHOR_FROM * n) & (df <= ANCHOR_TO * n)) if n * ANCHOR_FROM >= 2 else np.arange(len(words))
    row_of = np.full(rows, -1)
    row_of[among] = np.arange(len(among))
    project = projection(share)
    tools = context.broadcast((project, row_of))
    near = _added(bags, (len(among), WIDTH), lambda b, s: company(b, *tools.value, s))
    picked = [int(among[i]) for i in anchors(near, df[among], share @ project, min(TOPICS, -(-len(words) // WORDS_A_TOPIC)))]
    topic_of = np.full(rows, -1)
    topic_of[picked] = np.arange(len(picked))
    starts = context.broadcast(topic_of)
    lam = _added(bags, (rows, max(1, len(picked))), lambda b, s: beside(b, starts.value, s))
    total = _added(bags, (rows, 1), lambda b, s: np.add.at(s[:, 0], b.ids, b.counts))[:, 0]
    lam = lam / np.maximum(lam.sum(0), 1e-12) + 0.3 * (total / total.sum())[:, None] + 1e-9
    lam[picked, np.arange(len(picked))] += 0.3
    beta, last = (lam / lam.sum(0)).astype(np.float32), None
    for _ in range(MOST_ROUNDS):
        now = context.broadcast(beta)
        sums = _added(bags, beta.shape, lambda b, s, now=now: expectation(b, now.value, s))
        beta = np.exp(_digamma(sums + ETA) - _digamma((sums + ETA).sum(0, keepdims=True))).astype(np.float32)
        now.unpersist()
        if last is not None and np.abs(sums - last).sum() < SETTLED * sums.sum():
            break
        last = sums
    model = Topics([w for w, _ in words], total, beta, subjects)
    model.map_topics()
    return model, whole


def document_subjects(documents: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject, share): subjects with at least ``SHARE`` of a document's statements.

    ``documents``: doc_id, text; ``subjects``: subject. Null, blank or statement-less texts and null ids have no
    subject; of a doc_id that stands twice the greater share counts; equal shares are both given; empty tables give an
    empty result. Only tables of fixed size (rows of words by topics, or by the projection's width) reach the driver.
    """
    names = sorted(r[0] for r in subjects.select("subject").distinct().collect() if r[0])
    src = spread(documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()))
    fitted = fit(src, names)
    if fitted is None:
        return documents.sparkSession.createDataFrame([], "doc_id long, subject string, share double")
    final = documents.sparkSession.sparkContext.broadcast(fitted[0])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = final.value.shares(Bags.of(b), _lists(b.column("said")), _lists(b.column("ends")))
            rows = [(d, s, v) for d, x in zip(b.column("doc_id").to_pylist(), found, strict=True) for s, v in x.items() if v >= SHARE - 1e-9]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], ["doc_id", "subject", "share"])

    return fitted[1].mapInArrow(assign, "doc_id long, subject string, share double").groupBy("doc_id", "subject").agg(F.max("share").alias("share"))
