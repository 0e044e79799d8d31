"""Sessions, stores, streams, prompts and gates on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from tracewell.functions import context, messages
from tracewell.operators import lifecycle, retrieval, sessions
from tracewell.sources.store import Store
from tracewell.streaming import ingest

EVENT = "session string, seq int, kind string, agent string, name string, text string, args string, result string, error string, flag boolean, code int, confidence double, bullets array<string>"


def events(spark, rows):
    base = dict.fromkeys(["session", "seq", "kind", "agent", "name", "text", "args", "result", "error", "flag", "code", "confidence", "bullets"])
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], EVENT)


def test_sessions(spark):
    e = lambda s, n, k, **x: {"session": s, "seq": n, "kind": k, **x}
    rows = [
        e("a", 2, "tool", name="bash", args='{"c":1}', result="ok"), e("a", 1, "task", text="do it", agent="x"), e("a", 3, "tool", name="bash", error="boom"), e("a", 4, "recall", name="s2"), e("a", 5, "recall", name="s1"), e("a", 6, "recall", name="s2"),
        e("a", 7, "ok", text="fine"), e("a", 8, "verify", flag=False), e("a", 9, "used", bullets=["b-1", "b-2"]), e("a", 9, "misled", bullets=["b-3"]), e("a", 10, "observe", text="seen"), e("a", 11, "odd"),
        e("b", 1, "verify", code=0, text="made"), e("c", 1, "raise", error="KeyError"), e("d", 1, "say", text="hi"), e(None, 1, "say"), e("e", 1, None), e("f", 1, "verify", flag=True), e("g", 1, "verify", code=2), e("h", 1, "partial", text="x" * 400),
    ]
    got = {r.session: r for r in sessions.build(events(spark, rows)).collect()}
    sig = lambda k: [(x.source, x.outcome, x.confidence, x.detail) for x in got[k].signals]
    a = got["a"]
    assert a.task == "do it" and a.agent == "x" and a.skills_used == ["s2", "s1"] and a.bullets_helpful == ["b-1", "b-2"] and a.bullets_harmful == ["b-3"]
    assert [(s.role, s.content, [(c.name, c.result, c.error) for c in s.tool_calls]) for s in a.steps] == [("user", "do it", []), ("assistant", "", [("bash", "ok", None)]), ("assistant", "", [("bash", None, "boom")]), ("tool", "seen", [])]
    assert sig("a") == [("test", "failure", 0.9, "checker failed")] and sig("b") == [("test", "success", 0.9, "made")] and sig("f")[0][1] == "success" and sig("g")[0][1] == "failure"
    assert got["c"].steps[0].tool_calls[0].error == "KeyError" and sig("c")[0][:2] == ("session", "failure") and sig("d") == [] and len(sig("h")[0][3]) == 300 and sig("h")[0][2] == 0.8
    assert set(got) == set("abcdfgh") and sessions.build(events(spark, [])).count() == 0
    shown = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("a", 3, "x"), ("a", 0, "_principles"), (None, 1, "z")], "session string, seq int, name string")
    assert [tuple(r) for r in sessions.attribute(shown).collect()] == [("a", ["x", "y"])]


def test_evaluations(spark):
    pending = spark.createDataFrame([("e1", "s", "t"), ("e2", "s", "t"), ("e3", "s", "t")], "id string, skill string, task string")
    results = spark.createDataFrame([("e1", True, None), ("e2", True, "crash"), ("e9", True, None)], "id string, ok boolean, error string")
    assert {r.id: (r.outcome, r.detail) for r in sessions.run_evaluations(pending, results).collect()} == {"e1": ("success", ""), "e2": ("failure", "crash"), "e3": ("failure", "no run")}
    runs = spark.createDataFrame([("a", 0, None, None), ("b", 3, 0, None), ("c", 124, 3, None), ("d", 1, 0, None), ("e", 0, None, "broken"), ("f", None, None, None)], "task string, exit_code int, recheck_code int, harness_error string")
    assert {r.task: (r.status, r.rechecked, r.passed) for r in sessions.checked(runs).collect()} == {"a": ("pass", False, True), "b": ("pass", True, True), "c": ("timeout", True, False), "d": ("fail", False, False), "e": ("pass", False, False), "f": ("fail", False, False)}


def test_overrides(spark):
    skills = spark.createDataFrame([("a", "candidate", 1, False, None), ("b", "candidate", 0, None, None), ("c", "active", 1, True, False)], "name string, status string, successes long, cleared boolean, approved boolean")
    todo = spark.createDataFrame([("a", 1, "approve", None), ("b", 1, "approve", None), ("c", 2, "status", "retired"), ("c", 1, "approve", None), ("zz", 1, "approve", None)], "name string, seq int, action string, status string")
    got = {r.name: (r.status, r.cleared, r.approved) for r in sessions.overrides(skills, todo).collect()}
    assert got == {"a": ("active", True, True), "b": ("candidate", True, True), "c": ("retired", True, True)}


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    assert s.applied == [1] and Store(spark, s.path).applied == []
    traces = lambda *r: spark.createDataFrame(r, "id string, ts double, json string")
    s.add("traces", traces(("a", 2.0, "1"), ("b", 1.0, "1"), ("c", 3.0, "1")))
    assert [r.id for r in s.pending().collect()] == ["b", "a", "c"] and [r.id for r in s.pending(1).collect()] == ["b"] and ingest.backlog(s)
    s.mark_processed(spark.createDataFrame([("a",), ("b",)], "id string"))
    assert [r.id for r in s.pending().collect()] == ["c"] and not ingest.backlog(s)
    s.add("traces", traces(("a", 2.0, "2")))  # stored again: pending again, the last row counts
    assert [(r.id, r.json) for r in s.pending().collect()] == [("a", "2"), ("c", "1")] and s.table("traces").count() == 3
    skill = lambda v, st, trig: spark.createDataFrame([("k", v, st, f"d{v}", "b", trig)], "name string, version int, status string, description string, body string, triggers array<string>")
    s.save_skills(skill(1, "active", ["t"]))
    s.save_skills(skill(2, "quarantine", None))
    assert s.table("skills").first().triggers == ["t"] and s.versions("k") == [1, 2] and s.rollback("k", 1) == 3
    row = s.table("skills").first()
    assert (row.version, row.status, row.description) == (3, "active", "d1")
    with pytest.raises(KeyError):
        s.rollback("k", 9)
    s.add("recalls", spark.createDataFrame([("k",), ("k",), ("j",)], "name string"))
    assert {tuple(r) for r in s.recalled().collect()} == {("k", 2), ("j", 1)}
    s.backup(f"file://{tmp_path}/b")
    s.add("traces", traces(("z", 9.0, "1")))
    s.restore(f"file://{tmp_path}/b")
    assert s.table("traces").count() == 3 and s.table("principles").count() == 0
    with pytest.raises(FileNotFoundError):
        s.restore(f"file://{tmp_path}/nothing")


def test_process(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.add("traces", spark.createDataFrame([(f"t{i}", float(i), "x" if i != 2 else "bad") for i in range(7)], "id string, ts double, json string"))

    def derive(d):
        ok = F.col("json") != "bad"
        return d.select("id", F.when(ok, F.array(F.struct(F.concat(F.lit("l-"), "id").alias("id"), F.col("json")))).alias("lesson"), F.when(~ok, "broken").alias("problem"))

    one = ingest.process(s, derive, 4)
    assert one == {"traces": 4, "failed": 1, "lessons": 3, "principles_due": 0} and [r.subject for r in s.table("audit").collect()] == ["t2"]
    assert ingest.process(s, derive, 4) == {"traces": 3, "failed": 0, "lessons": 3, "principles_due": 1}
    assert ingest.process(s, derive)["traces"] == 0 and s.table("lessons").count() == 6
    s.add("traces", spark.createDataFrame([("t1", 1.0, "y")], "id string, ts double, json string"))
    assert ingest.work(s, derive) == 1 and s.table("lessons").count() == 6 and s.table("lessons").where("id = 'l-t1'").first().json == "y"


def test_late_rows(spark, tmp_path):
    row = lambda i, t, k="a": (i, k, f"2024-01-{t}")
    for n, rows in enumerate([[row(1, "01 10:00:00"), row(2, "02 10:00:00")], [row(2, "02 10:00:00"), row(4, "04 00:00:00", "b")], [row(3, "01 11:00:00")]]):
        spark.createDataFrame(rows, "id long, k string, t string").select("id", "k", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(f"file://{tmp_path}/in/{n}")
    schema = "id long, k string, ts timestamp"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
    got = {(r["from"].day, r.k, r.n) for r in ingest.windows(stream(), "ts", ["k"]).collect()}
    assert got == {(1, "a", 1), (2, "a", 2)}  # row 3 came after its day was closed; the day of row 4 is open
    assert {(r.k, r.n) for r in ingest.counters(stream(), "k", "id", "ts", "30 days").collect()} == {("a", 3), ("b", 1)}


def test_prompts(spark):
    at = lambda c: spark.range(1).select(c).first()[0]
    s, n = F.lit, F.lit(None).cast("string")
    md = at(context.skill_md(s("k"), s("Use: it."), s("\n- a\n"), s(True)))
    assert md == '---\nname: k\ndescription: "Use: it' + context.PROVISIONAL + '"\n---\n\n- a\n' and at(context.skill_md(s("k"), n, n, F.lit(None).cast("boolean"))) == "---\nname: k\ndescription: \n---\n\n\n"
    assert at(context.labelled(s("candidate"), s("x"))).startswith("> UNVERIFIED") and at(context.labelled(s("active"), s("x"))) == "x"
    assert at(context.skills_text(F.array(s("a"), s("b")))) == "a\n\nb" and at(context.hints_text(F.array().cast("array<string>"))) == "" and at(context.hints_text(F.array(s("a")))).endswith("\n\na")
    assert at(context.prompt(s("doc"), s("  "), s("t"), n, n)) == "doc\n\nTask: t"
    assert at(context.prompt(s("doc"), s("c"), s("t"), s("code"), s("why"))) == "doc\n\nc\n\nTask: t\n\nYour previous attempt:\n```python\ncode\n```\nIt failed with:\nwhy\nWrite a corrected version."
    assert [at(context.hook_mode(s(e), s(a))) for e, a in [("Stop", "prompt"), ("x", "stop"), (None, None), ("x", "y")]] == ["stop", "stop", None, None]
    chunk = lambda u: F.struct(s("c").alias("category"), s("t").alias("title"), s("x").alias("content"), u.alias("url"))
    assert at(context.chunks_text(F.array(chunk(s("u")), chunk(n)))) == "[c] t\nx\nURL: u\n\n---\n\n[c] t\nx"
    assert at(messages.yaml_quote(s('a "b" \\ c: d'))) == json.dumps('a "b" \\ c: d') and at(messages.yaml_quote(s("a\nb"))) == "a b"


def test_decisions_in_order(spark):
    lesson = lambda i, t="t", g=True, c=0.9, b="no_skill", ref=None: (i, t, g, c, b, ref)
    rows = [
        lesson("gone", "none"), lesson("eval", "e"), lesson("small", "s"), lesson("dark", "u"), lesson("own", g=None), lesson("weak", c=None), lesson("mine", b="skill_wrong", ref="live"), lesson("stuck", b="skill_wrong", ref="held"),
        lesson("fixed", "t2", b="skill_incomplete", ref="live"), lesson("twin", "t2"), lesson("alone", "t2", c=0.5), lesson("pair", "t2", c=0.5), lesson("new", "t2"), lesson("lost", "t2", b="skill_wrong", ref="nobody"),
    ]
    lessons = spark.createDataFrame(rows, "id string, trace_id string, generalizable boolean, confidence double, blame string, skill_ref string")
    outcomes = spark.createDataFrame([("t", None, 5, "failure"), ("t2", None, 5, "failure"), ("e", "ev", 5, "failure"), ("s", None, 1, "success"), ("u", None, 3, "unknown")], "trace_id string, eval_id string, calls int, trace_outcome string")
    skills = lambda n: spark.createDataFrame([("live", "active", ["t"]), ("held", "quarantine", ["t"])] + [(f"k{i}", "active", None) for i in range(n)], "name string, status string, provenance array<string>")
    twins, related, tried = spark.createDataFrame([("twin", "live")], "id string, name string"), spark.createDataFrame([("pair",)], "id string"), spark.createDataFrame([("live",)], "name string")
    run = lambda n: {r.id: (r.decision, r.name) for r in lifecycle.decisions(lessons, outcomes, skills(n), twins, related, tried).collect()}
    got = run(20)
    assert got == {
        "gone": ("orphan", None), "eval": ("eval run", None), "small": ("trivial", None), "dark": ("unknown outcome", None), "own": ("not general", None), "weak": ("low confidence", None), "mine": ("contributed", "live"), "stuck": ("resume", "held"),
        "fixed": ("patch", "live"), "twin": ("patch", "live"), "alone": ("single evidence", None), "pair": ("create", None), "new": ("create", None), "lost": ("create", None),
    }
    assert run(2)["alone"] == ("create", None)  # a small library asks for less


def test_sceptic(spark):
    lessons = spark.createDataFrame([(i, "t", "failure", 0.9, "because", [1]) for i in ("direct", "partial", "none", "told", "silent")] + [("und", "t", "failure", 0.9, "Undetermined: x", None), ("bare", "t", None, 0.9, None, None), ("good", "t", "success", 0.9, "x", None), ("cited", "t", "failure", 0.9, "x", [0])], "id string, trace_id string, outcome string, confidence double, root_cause string, evidence_steps array<int>")
    calls = spark.createDataFrame([("t", 0, "boom"), ("t", 1, None)], "id string, step_pos int, error string")
    answers = spark.createDataFrame([("direct", "direct", True), ("partial", "Partial", True), ("none", "none", False), ("told", "direct", False), ("good", "none", False)], "id string, support string, quoted boolean")
    got = {r.id: r.cap for r in lifecycle.grounding(lessons, calls, answers).collect()}
    assert got == {"direct": 0.9, "partial": 0.65, "none": 0.35, "told": 0.35, "silent": 0.9, "und": 0.9, "bare": 0.35, "good": 0.9, "cited": 0.75}


def test_precision_gate(spark):
    skills = spark.createDataFrame([("fix-rebase", ["rebase stuck"], ["merge"], ["resume my rebase now"]), ("write-docker", ["new Dockerfile"], None, None), ("bare", None, None, None)], "name string, applies_when array<string>, not_for array<string>, queries array<string>")
    asked = spark.createDataFrame([(1, "the rebase hangs"), (2, "my branch hangs"), (3, "what is a rebase"), (4, "write a new thing"), (5, "rebase breaks on merge"), (6, "resume now my work")], "qid int, text string")
    near = spark.createDataFrame([(q, n, c) for q in range(1, 7) for n in ("fix-rebase", "write-docker", "bare") for c in (0.5,)] + [(2, "write-docker", 0.7)], "qid int, name string, cosine double")
    got = {(r.qid, r.name, r.cosine) for r in retrieval.precision_gate(near, asked, skills).collect()}
    assert (1, "fix-rebase", 0.5) in got and (2, "fix-rebase", 0.5) not in got and (2, "write-docker", 0.7) in got and not {q for q, *_ in got} & {3}
    assert (4, "write-docker", 0.5) not in got and (4, "fix-rebase", 0.5) not in got and (5, "fix-rebase", 0.5) not in got and (6, "fix-rebase", 0.5) in got
    assert "bare" not in {n for _, n, _ in got}  # its only anchor is its name


def test_hot_term(spark):
    # One word in every query and vector block splits alike: neighbours equal brute force, ties and odd lengths included.
    import numpy as np

    r = np.random.default_rng(3)
    v = [(i, [float(x) for x in r.normal(size=6)]) for i in range(90)] + [(90, [1.0] * 6), (91, [1.0] * 6), (92, [2.0] * 6), (93, [1.0, 2.0]), (94, None), (95, []), (96, [0.0] * 6)]
    df = spark.createDataFrame(v, "id long, v array<double>")
    got = {(x.qid, x.id): x["rank"] for x in retrieval.cosine_topk(df.withColumnRenamed("id", "qid"), df, 3, 0.1, block=20).collect()}
    m = {i: np.array(x) / np.linalg.norm(x) for i, x in v if x and any(x)}
    for i, x in m.items():
        near = sorted(((-round(float(x @ y), 9), j) for j, y in m.items() if j != i and len(y) == len(x) and x @ y >= 0.1))[:3]
        assert [j for _, j in near] == [j for (q, j), k in sorted(got.items(), key=lambda p: p[1]) if q == i]
