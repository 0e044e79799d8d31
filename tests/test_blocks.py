"""Recall over wide tables: the pairs that share a word are scored in memory, not shuffled."""

import numpy as np
import pytest

from tracewell.catalogue import QUERIES
from tracewell.operators import retrieval
from tracewell.plans.blocks import in_blocks

N = 300


def shuffled(spark, df, what="shuffleWriteRecords"):
    """The rows of ``df``, and how many records (or what of ``what``) its stages wrote to shuffles."""
    g = spark.sparkContext._gateway

    def written():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, g.new_array(g.jvm.double, 0), g.jvm.java.util.ArrayList())
        return sum(getattr(stages.apply(i), what)() for i in range(stages.size()))

    before = written()
    rows = df().collect()
    return rows, written() - before


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """A folder with skills and lessons that all share words."""
    d = tmp_path_factory.mktemp("wide")
    rows = [(f"alpha-n{i}x", f"handles alpha for own{i}", "", "active", 1, 0, 0, 0, 1.0, [1.0, i / N], ["alpha"], [f"alpha broke at own{i}"], [], [f"alpha beta own{i}"]) for i in range(N)]
    spark.createDataFrame(rows, "name string, description string, body string, status string, version int, uses long, recalls long, successes long, updated double, embedding array<float>, applies_when array<string>, symptoms array<string>, not_for array<string>, queries array<string>").write.parquet(f"{d}/skills.parquet")
    spark.createDataFrame([(f"{i:08x}", ["alpha gamma"], f"delta epsilon own{i}", True, float(i), None) for i in range(N)], "id string, triggers array<string>, rule string, generalizable boolean, ts double, skill_ref string").write.parquet(f"{d}/lessons.parquet")
    return str(d)


def test_retrieval_eval_pairs(spark, wide):
    rows, records = shuffled(spark, lambda: QUERIES["retrieval_eval"](spark, wide))
    assert [(r["class"], r.n, r.hits, r.false_fires) for r in rows] == [("active", N, N, 0)]
    assert records < N * N / 4


def test_offline_bench_pairs(spark, wide):
    rows, records = shuffled(spark, lambda: QUERIES["offline_bench"](spark, wide))
    assert [(r.n, r.at_1, r.in_set, r.false_fires) for r in rows] == [(N, N, N, 0)]
    assert records < N * N / 4


def test_error_recall_pairs(spark, wide):
    asked = spark.createDataFrame([(i, f"OSError: alpha broke at own{i}") for i in range(N)], "qid int, text string")
    rows, records = shuffled(spark, lambda: retrieval.coverage(asked, spark.read.parquet(f"{wide}/skills.parquet"), 1, error=True))
    assert {(r.qid, r.name, r.score) for r in rows} == {(i, f"alpha-n{i}x", 1.0) for i in range(N)}
    assert records < N * N / 4


def test_lesson_duplicates_pairs(spark, wide):
    lib = spark.read.parquet(f"{wide}/skills.parquet")
    lessons = spark.createDataFrame([(f"l{i}", [f"alpha n{i}x"], "") for i in range(N)] + [("none", ["gamma"], None), ("half", ["alpha"], "nothing of beta")], "id string, triggers array<string>, rule string")
    rows, records = shuffled(spark, lambda: retrieval.duplicates_of(lessons, lib))
    assert {r.id: (r.name, r.score) for r in rows} == {f"l{i}": (f"alpha-n{i}x", 1.0) for i in range(N)}
    assert records < N * N / 4


def test_related_lessons_pairs(spark, wide):
    d = spark.read.parquet(f"{wide}/lessons.parquet").selectExpr("id", "ts", "generalizable", "split(concat_ws(' ', triggers[0], rule), ' ') AS words")
    rows, records = shuffled(spark, lambda: retrieval.related_lessons(d, d))
    newest = [f"{i:08x}" for i in reversed(range(N))]
    assert {(r.qid, r["rank"], r.id, r.shared) for r in rows} == {(q, k + 1, x, 4) for q in newest for k, x in enumerate([x for x in newest[:5] if x != q][:4])}
    assert records < N * N / 4


def test_hybrid_recall_pairs(spark, wide):
    lib = spark.read.parquet(f"{wide}/skills.parquet")
    asked, vectors = lib.selectExpr("name AS qid", "queries[0] AS text"), lib.selectExpr("name AS qid", "embedding AS v")
    rows, records = shuffled(spark, lambda: retrieval.hybrid_recall(asked, vectors, lib))
    top = {r.qid: r.name for r in rows if r["rank"] == 1}
    assert len(rows) == 3 * N and len(top) == N and all(abs(int(a[7:-1]) - int(b[7:-1])) <= 6 for a, b in top.items())  # a near one, fused with its words
    assert records < N * N / 2


def test_hybrid_eval_pairs(spark, wide):
    rows, records = shuffled(spark, lambda: QUERIES["hybrid_eval"](spark, wide))
    asked = spark.read.parquet(f"{wide}/skills.parquet").where("conv(left(md5(name), 8), 16, 10) % 20 = 0").count()
    assert [(r.tp + r.fp + r.fn, r.tn) for r in rows] == [(asked, 0)]
    assert records < 10_000


def test_hybrid_eval_bytes(spark, tmp_path):
    # Vectors travel twice, for the latest export and to their block; those of exports that can't be retrieved don't.
    n, size = 400, 500
    v = np.random.default_rng(1).normal(1.5, size=(n, size)).astype(np.float32)
    rows = [(f"alpha-n{i}x", f"handles alpha for own{i}", "active" if i % 2 else "retired", 1, 0, 0, 1.0, v[i].tolist(), ["alpha"], [], [], [f"alpha beta own{i}"]) for i in range(n)]
    spark.createDataFrame(rows, "name string, description string, status string, version int, uses long, recalls long, updated double, embedding array<float>, applies_when array<string>, symptoms array<string>, not_for array<string>, queries array<string>").write.parquet(f"{tmp_path}/skills.parquet")
    rows, written = shuffled(spark, lambda: QUERIES["hybrid_eval"](spark, str(tmp_path)), "shuffleWriteBytes")
    assert sum(rows[0]) > 10
    assert written < 1.5 * v.nbytes


def test_hybrid_recall_parts(spark, monkeypatch):
    # One pass over blocks equals the parts one after the other, odd queries and vectors included.
    r = np.random.default_rng(5)
    words = ["rebase", "merge", "docker", "image", "cache", "alembic", "pytest", "fixture", "v1.2", "of"]
    some = lambda k: " ".join(r.choice(words, k))
    skills = []
    for i in range(90):
        v = [0.0] * 4 if i == 7 else [1.0, 2.0] if i == 8 else None if i == 9 else [] if i == 10 else [float(x) for x in r.integers(-2, 4, 4)]
        skills.append((f"{'write' if i % 9 == 0 else 'fix'}-{r.choice(words[:8])}-{i}", some(4), ("active", " Candidate", "retired")[i % 3], 1, 0, 0, float(i), v, [some(2)] if i % 4 else None, [some(2), None], [some(1)] if i % 5 == 0 else [], [some(3), some(2)] if i % 2 else None))
    skills.append((*skills[0][:2], "retired", 1, 0, 0, 99.0, *skills[0][7:]))  # a later export
    lib = spark.createDataFrame(skills, "name string, description string, status string, version int, uses long, recalls long, updated double, embedding array<float>, applies_when array<string>, symptoms array<string>, not_for array<string>, queries array<string>")
    texts = [None, "", "of", "3 4", "what is a rebase", "write a poem", "write a new docker image", "fix v1.2"] + [f"fix {some(k % 6 + 1)}" for k in range(40)]
    asked = spark.createDataFrame([(skills[i][0] if i % 3 == 0 else f"q{i}", t) for i, t in enumerate(texts)], "qid string, text string")
    vectors = asked.select("qid").collect()
    vectors = spark.createDataFrame([(q.qid, [1.0, 1.0] if i == 11 else [0.0] * 4 if i == 12 else None if i == 13 else [float(x) for x in r.integers(-2, 4, 4)]) for i, q in enumerate(vectors) if i != 14] + [("unasked", [1.0] * 4)], "qid string, v array<float>")
    monkeypatch.setattr(retrieval, "in_blocks", lambda *a, **k: in_blocks(*a, **k | {"most": 12}))
    kept = retrieval.latest_skills(lib).where("status in ('active', 'candidate')")
    near = retrieval.cosine_topk(vectors, kept.selectExpr("name AS id", "embedding AS v"), 10, 0.45).withColumnRenamed("id", "name")
    lexical = retrieval.coverage(asked, lib, 1000).select("qid", "name", "score")
    alone = retrieval.precision_gate(near.join(lexical, ["qid", "name"], "left_anti"), asked, kept)
    both = near.join(lexical, ["qid", "name"], "left_semi").select("qid", "name", "cosine").unionByName(alone)
    parts = retrieval.hybrid(lexical.withColumnRenamed("name", "id"), both.withColumnRenamed("name", "id"), 3)
    whole = lambda d, c: sorted((x.qid, x["rank"], x[c], round(x.score, 9)) for x in d.collect())
    got = whole(retrieval.hybrid_recall(asked, vectors, lib), "name")
    assert got == whole(parts, "id") and len({q for q, *_ in got}) > 30 and {"q1", "q2"} & {q for q, *_ in got}
