"""Further queries of the core: scans, sessions, prompts, recall reports and evaluation reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.functions import context, messages, text
from tracewell.operators import lifecycle, reports, retrieval, sessions, stats, traces
from tracewell.queries import _WIL, FACET, LATEST, LESSONS, ORACLES, OUTCOME, PROFILE, QUERIES, SKILLS, _asked, _lessons, _lit, _outcomes, _skills, _traces, query
from tracewell.sources.tables import table
from tracewell.streaming import ingest

EVAL = f"{OUTCOME}, ev AS (SELECT eval_id AS id, skills_used[1] AS skill, CASE WHEN outcome = 'success' AND confidence >= 0.5 THEN 'passed' ELSE 'failed' END AS status, id AS trace_id FROM (SELECT *, row_number() OVER (PARTITION BY eval_id ORDER BY ts DESC NULLS LAST, id) AS nth FROM oc WHERE eval_id IS NOT NULL) q WHERE q.nth = 1)".replace("SELECT * EXCLUDE (s, f, p)", "SELECT * EXCLUDE (s, f, p, nth)")


# ---- scans


@query("SELECT DISTINCT id, agent, ts FROM traces WHERE id = (SELECT min(id) FROM traces)")
def trace_lookup(spark, sf_dir):
    """The trace of one id (the least)."""
    t = _traces(spark, sf_dir)
    return t.join(F.broadcast(t.agg(F.min("id").alias("id"))), "id").select("id", "agent", "ts").distinct()


@query(f"WITH {LESSONS} SELECT id, trace_id, ts FROM le ORDER BY ts DESC NULLS LAST, id LIMIT 200")
def lesson_scan(spark, sf_dir):
    """The 200 newest lessons (a top-k report)."""
    return _lessons(spark, sf_dir).orderBy(F.desc_nulls_last("ts"), "id").limit(200).select("id", "trace_id", "ts")


@query(f"WITH {SKILLS} SELECT name, status, array_to_string(coalesce(queries, []), ' ') AS triggers FROM ls WHERE status IN ('active', 'candidate')")
def skills_by_status(spark, sf_dir):
    """Retrievable skills with the texts that trigger them."""
    return _skills(spark, sf_dir).where(F.col("status").isin(*retrieval.RETRIEVABLE)).select("name", "status", F.array_join(F.coalesce("queries", F.array().cast("array<string>")), " ").alias("triggers"))


@query(f"WITH {EVAL} SELECT * FROM ev")
def evals_scan(spark, sf_dir):
    """Evaluations that runs report, by their newest run."""
    return sessions.evaluations(_outcomes(spark, sf_dir))


@query(f"WITH {EVAL}, {SKILLS} SELECT 'host-' || name AS id, name AS skill FROM ls WHERE status = 'candidate' AND name NOT IN (SELECT skill FROM ev WHERE skill IS NOT NULL) ORDER BY id LIMIT 10")
def pending_host_evals(spark, sf_dir):
    """The first ten candidates that still wait for an evaluation (a top-k view)."""
    ran = sessions.evaluations(_outcomes(spark, sf_dir)).select(F.col("skill").alias("name"))
    return _skills(spark, sf_dir).where("status = 'candidate'").join(ran, "name", "left_anti").select(F.concat(F.lit("host-"), "name").alias("id"), F.col("name").alias("skill")).orderBy("id").limit(10)


@query("SELECT epoch_us(ts) AS at, event_type AS kind, user_id::VARCHAR AS subject, props AS detail FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def audit_scan(spark, sf_dir):
    """The 50 newest events as an audit trail (a top-k report)."""
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("subject"), F.col("props").alias("detail"))


@query("SELECT event_id, value FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 500")
def metric_scan(spark, sf_dir):
    """The 500 newest values of one metric (a top-k report)."""
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", "value")


PRINCIPLES = f"{LESSONS}, pr AS (SELECT skill_ref AS id, min(ts) AS ts, arg_min(rule, (ts, id)) AS rule, count(*) AS evidence FROM le WHERE generalizable AND skill_ref IS NOT NULL AND rule <> '' AND ts IS NOT NULL GROUP BY skill_ref HAVING count(*) >= 3)"


def _principles(spark, sf_dir):
    d = _lessons(spark, sf_dir).where("generalizable and skill_ref is not null and rule <> '' and ts is not null")
    g = d.groupBy(F.col("skill_ref").alias("id")).agg(F.min("ts").alias("ts"), F.min_by("rule", F.struct("ts", "id")).alias("rule"), F.collect_set("id").alias("ids"))  # lessons of one skill
    return reports.principles(g).select("id", "ts", "rule", F.size("ids").cast("bigint").alias("evidence"))


@query(f"WITH {PRINCIPLES} SELECT id, rule, evidence FROM pr")
def principles_scan(spark, sf_dir):
    """Principles: the first rule of each situation with three lessons or more."""
    return _principles(spark, sf_dir).select("id", "rule", "evidence")


@query("SELECT count(*) AS n, count(*) AS same FROM (SELECT 1 FROM traces WHERE id IS NOT NULL)")
def trace_json_roundtrip(spark, sf_dir):
    """Traces, and those that are the same after they were written as JSON and read again."""
    t = _traces(spark, sf_dir).where("id is not null").select("id", "task", "agent", "ts", "skills_used", "bullets_helpful", "bullets_harmful", "steps", "signals", "eval_id", "metadata")
    d = t.select(F.to_json(F.struct(*t.columns)).alias("j"))
    back = F.to_json(F.from_json("j", t.schema))
    return d.agg(F.count("*").alias("n"), F.count_if(back == F.col("j")).alias("same"))


@query("SELECT count(*) AS submitted, count(DISTINCT id) AS ids, count(DISTINCT (id, received)) AS stored FROM traces WHERE id IS NOT NULL")
def concurrency_check(spark, sf_dir):
    """Deliveries, distinct ids, and distinct deliveries."""
    t = _traces(spark, sf_dir).where("id is not null").select("id", "received")
    return t.agg(F.count("*").alias("submitted"), F.count_distinct("id").alias("ids"), F.count_distinct(F.struct("id", "received")).alias("stored"))


# ---- sessions

_KIND = "CASE event_type WHEN 'view' THEN 'say' WHEN 'click' THEN 'tool' WHEN 'error' THEN 'tool' WHEN 'purchase' THEN 'verify' WHEN 'signup' THEN 'partial' END"


@query(f"""WITH e AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS session, event_id AS seq, {_KIND} AS kind, event_type, value FROM events),
o AS (SELECT session, arg_max(CASE WHEN kind = 'partial' THEN 'partial' WHEN value < 100 THEN 'success' ELSE 'failure' END, seq) FILTER (WHERE kind IN ('verify', 'partial')) AS outcome, arg_max(CASE WHEN kind = 'partial' THEN 'session' ELSE 'test' END, seq) FILTER (WHERE kind IN ('verify', 'partial')) AS source, count(*) FILTER (WHERE kind IN ('say', 'tool')) AS steps, count(*) FILTER (WHERE kind = 'tool') AS calls, count(*) FILTER (WHERE event_type = 'error') AS errors FROM e GROUP BY session)
SELECT session, steps, calls, errors, outcome, source FROM o""")
def session_traces(spark, sf_dir):
    """The events of each user and day as a recorded session, built into a trace: its steps, calls, errors and outcome."""
    e = table(spark, sf_dir, "events")
    kind = F.expr(_KIND)
    d = e.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("session"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("user_id").cast("string").alias("agent"), F.col("event_type").alias("name"), F.col("props").alias("text"),
        F.lit("{}").alias("args"), F.when(F.col("event_type") == "click", "ok").alias("result"), F.when(F.col("event_type") == "error", "failed").alias("error"), F.when(F.col("event_id") % 2 == 0, F.col("value") < 100).alias("flag"),
        F.when(F.col("event_id") % 2 == 1, (F.col("value") >= 100).cast("int")).alias("code"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("array<string>").alias("bullets"),
    )
    t = sessions.build(d)
    calls = F.col("steps.tool_calls")
    last = F.try_element_at("signals", F.lit(1))
    return t.select("session", F.size("steps").cast("bigint").alias("steps"), traces.n_calls(calls).cast("bigint").alias("calls"), traces.n_errors(calls).cast("bigint").alias("errors"), last["outcome"].alias("outcome"), last["source"].alias("source"))


@query("WITH s AS (SELECT DISTINCT agent AS session, ts AS seq, unnest(skills_used) AS name FROM traces WHERE agent IS NOT NULL), f AS (SELECT session, name, min(seq) AS seq FROM s WHERE name IS NOT NULL GROUP BY ALL) SELECT session, len(list(name)) AS n, md5(string_agg(name, ',' ORDER BY seq NULLS FIRST, name)) AS digest FROM f GROUP BY session")
def recall_attribution(spark, sf_dir):
    """Skills shown to each agent, each once, in order of their first showing."""
    d = _traces(spark, sf_dir).select(F.col("agent").alias("session"), F.col("ts").alias("seq"), F.explode("skills_used").alias("name"))
    return sessions.attribute(d).select("session", F.size("skills").cast("bigint").alias("n"), F.md5(F.array_join("skills", ",")).alias("digest"))


_EXIT = "CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 3 WHEN 'click' THEN 124 ELSE 0 END"


@query(f"WITH r AS (SELECT event_id, {_EXIT} AS e, (event_id % 3)::INTEGER AS again, event_type = 'signup' AS broken FROM events), c AS (SELECT *, CASE WHEN e IN (3, 124) THEN again ELSE e END AS code FROM r) SELECT CASE WHEN code = 0 THEN 'pass' WHEN code IN (3, 124) THEN 'timeout' ELSE 'fail' END AS status, e IN (3, 124) AS rechecked, code = 0 AND NOT broken AS passed, count(*) AS n FROM c GROUP BY ALL")
def checked_runs(spark, sf_dir):
    """Events as runs with exit codes, rechecked where they ended by time: their status."""
    d = table(spark, sf_dir, "events").select(F.expr(_EXIT).alias("exit_code"), (F.col("event_id") % 3).cast("int").alias("recheck_code"), F.when(F.col("event_type") == "signup", "broken").alias("harness_error"))
    return sessions.checked(d).groupBy("status", "rechecked", "passed").agg(F.count("*").alias("n"))


@query(f"""WITH {SKILLS}, {LESSONS}, c AS (SELECT skill_ref AS name, list(CASE outcome WHEN 'success' THEN 'approve' WHEN 'failure' THEN 'quarantine' ELSE '' END ORDER BY ts NULLS FIRST, id) AS todo, bool_or(outcome = 'success') AS yes FROM le WHERE skill_ref IS NOT NULL GROUP BY skill_ref)
SELECT name, list_reduce(list_concat([coalesce(status, '')], coalesce(todo, [])), lambda s, x: CASE WHEN x = 'approve' THEN CASE WHEN s = 'candidate' AND coalesce(successes, 0) >= 1 THEN 'active' ELSE s END WHEN x = '' THEN s ELSE x END) AS status, coalesce(yes, false) AS approved FROM ls LEFT JOIN c USING (name)""")
def manual_overrides(spark, sf_dir):
    """Skills after commands made of their lessons in order: a success approves, a failure puts into quarantine."""
    seq = F.row_number().over(Window.partitionBy("skill_ref").orderBy(F.asc_nulls_first("ts"), "id"))
    todo = _lessons(spark, sf_dir).where("skill_ref is not null").select(F.col("skill_ref").alias("name"), seq.alias("seq"), F.when(F.col("outcome") == "success", "approve").when(F.col("outcome") == "failure", "status").alias("action"), F.when(F.col("outcome") == "failure", "quarantine").alias("status"))
    own = _skills(spark, sf_dir).select("name", F.coalesce("status", F.lit("")).alias("status"), "successes", F.lit(False).alias("cleared"), F.lit(False).alias("approved"))
    return sessions.overrides(own, todo).select("name", "status", "approved")


# ---- prompts

_YAML = lambda x: f"(CASE WHEN regexp_matches(trim(replace({x}, chr(10), ' ')), '[:#\"''{{}}\\[\\]]') THEN '\"' || replace(replace(replace(trim(replace({x}, chr(10), ' ')), '\\', '\\\\'), '\"', '\\\"'), chr(9), '\\t') || '\"' ELSE trim(replace({x}, chr(10), ' ')) END)"
_DESC = f"CASE WHEN coalesce(provisional, false) AND NOT contains(lower(coalesce(description, '')), 'provisional') THEN regexp_replace(coalesce(description, ''), '\\.+$', '') || {_lit(context.PROVISIONAL)} ELSE coalesce(description, '') END"
MD = f"{SKILLS}, md AS (SELECT name, status, '---' || chr(10) || 'name: ' || name || chr(10) || 'description: ' || {_YAML('d')} || chr(10) || '---' || chr(10) || chr(10) || regexp_replace(coalesce(body, ''), '^\\s+|\\s+$', '', 'g') || chr(10) AS md FROM (SELECT *, {_DESC} AS d FROM ls)), lb AS (SELECT name, CASE WHEN status = 'candidate' THEN {_lit(context.UNVERIFIED)} || md ELSE md END AS t FROM md)"


def _labelled(spark, sf_dir):
    d = _skills(spark, sf_dir)
    return d.select("name", context.labelled(F.col("status"), context.skill_md(F.col("name"), F.col("description"), F.col("body"), F.col("provisional"))).alias("t"))


@query(f"WITH {MD} SELECT name, md5(t) AS digest FROM lb")
def labelled_skills(spark, sf_dir):
    """Skills as files, candidates with their note, by digest."""
    return _labelled(spark, sf_dir).select("name", F.md5("t").alias("digest"))


@query(f"WITH {LATEST}, {MD}, u AS (SELECT id, unnest(skills_used) AS name, generate_subscripts(skills_used, 1) AS k FROM lt) SELECT u.id, count(*) AS skills, md5(string_agg(t, chr(10) || chr(10) ORDER BY k)) AS digest FROM u JOIN lb USING (name) GROUP BY u.id")
def skills_prompts(spark, sf_dir):
    """The texts of the skills that each trace was shown, as they stand in a prompt."""
    u = traces.slim(_traces(spark, sf_dir)).select("id", F.posexplode("skills_used").alias("k", "name"))
    g = u.join(_labelled(spark, sf_dir), "name").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", "t"))).alias("x"))  # a trace's own
    return g.select("id", F.size("x").cast("bigint").alias("skills"), F.md5(context.skills_text(F.transform("x", lambda s: s["t"]))).alias("digest"))


@query(f"WITH {PRINCIPLES} SELECT string_agg('- ' || rule, chr(10) ORDER BY ts, id) AS text, '# Principles' || chr(10) || chr(10) || 'Cross-cutting rules distilled from many lessons. Apply on every task.' || chr(10) || chr(10) || string_agg('- **' || rule || '** _(evidence: ' || evidence || ' lessons)_', chr(10) ORDER BY ts, id) || chr(10) AS file FROM (SELECT * FROM pr ORDER BY evidence DESC, id LIMIT 20)")
def principles_text(spark, sf_dir):
    """The 20 best supported principles, as a prompt's list and as a file."""
    top = _principles(spark, sf_dir).orderBy(F.desc("evidence"), "id").limit(20)
    g = top.agg(F.sort_array(F.collect_list(F.struct("ts", "id", "rule", "evidence"))).alias("x"))  # 20 rows
    return g.select(context.bullet_list(F.transform("x", lambda r: r["rule"])).alias("text"), context.principles_md(F.col("x")).alias("file"))


@query(f"SELECT suite, {_lit(context.NOTES)} || string_agg('- ' || quirk, chr(10) ORDER BY quirk) AS notes FROM (SELECT DISTINCT suite, quirk FROM tasks WHERE quirk IS NOT NULL AND suite IS NOT NULL) GROUP BY suite")
def oracle_notes(spark, sf_dir):
    """Notes for an oracle: the quirks of each suite."""
    d = table(spark, sf_dir, "tasks").where("quirk is not null and suite is not null").groupBy("suite").agg(F.sort_array(F.collect_set("quirk")).alias("q"))
    return d.select("suite", F.concat(F.lit(context.NOTES), context.bullet_list(F.col("q"))).alias("notes"))


@query(f"SELECT DISTINCT id, md5(concat_ws(chr(10) || chr(10), coalesce(source, ''), nullif(trim(coalesce(quirk, '')), ''), 'Task: ' || coalesce(prompt, ''), CASE WHEN coalesce(check_expr, '') <> '' THEN {_lit(context.PREVIOUS)} || check_expr || {_lit(context.FAILED)} || CASE WHEN trap THEN 'crashed' ELSE 'wrong' END || {_lit(context.AGAIN)} END)) AS digest FROM tasks WHERE id IS NOT NULL")
def task_prompts(spark, sf_dir):
    """Prompts of tasks after a failed attempt, with what the agent sees of it."""
    t = table(spark, sf_dir, "tasks").where("id is not null")
    told = context.agent_feedback(F.when(F.col("trap"), "code"), F.lit("crashed"), "wrong")
    return t.select("id", F.md5(context.prompt(F.col("source"), F.col("quirk"), F.col("prompt"), F.col("check_expr"), told)).alias("digest")).distinct()


@query("SELECT DISTINCT id, CASE WHEN coalesce(trap, false) THEN 'tests passed' WHEN lower(trim(split)) = 'train' THEN coalesce(prompt, '') ELSE 'AssertionError: test failed: assert ' || coalesce(check_expr, '') END AS told FROM tasks WHERE id IS NOT NULL")
def learning_messages(spark, sf_dir):
    """What an attempt at each task would tell a learner."""
    stage = F.when(F.lower(F.trim("split")) == "train", "code")
    return table(spark, sf_dir, "tasks").where("id is not null").select("id", messages.learning_message(F.coalesce("trap", F.lit(False)), stage, F.col("prompt"), F.col("check_expr")).alias("told")).distinct()


@query(f"WITH {SKILLS} SELECT name, md5(concat_ws(chr(10), name, coalesce(description, ''), left(coalesce(body, ''), 2000))) AS digest FROM ls")
def embedding_texts(spark, sf_dir):
    """The text that stands for each skill in an embedding."""
    return _skills(spark, sf_dir).select("name", F.md5(context.embedding_text(F.col("name"), F.col("description"), F.col("body"))).alias("digest"))


@query(f"WITH k AS ({ORACLES['chunk_topk']}) SELECT qid, string_agg('[' || split_part(about, ',', 1) || '] ' || replace(subject, '_', ' ') || chr(10) || about, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS block FROM k JOIN subjects ON subject = chunk GROUP BY qid")
def chunk_context(spark, sf_dir):
    """The best chunks of each evaluation text as a block of context."""
    a = table(spark, sf_dir, "subjects").select(F.col("subject").alias("chunk"), F.split_part("about", F.lit(","), F.lit(1)).alias("category"), F.regexp_replace("subject", "_", " ").alias("title"), F.col("about").alias("content"), F.lit(None).cast("string").alias("url"))
    g = QUERIES["chunk_topk"](spark, sf_dir).join(a, "chunk").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "category", "title", "content", "url"))).alias("x"))  # six at most
    return g.select("qid", context.chunks_text(F.col("x")).alias("block"))


@query("WITH t AS (SELECT DISTINCT id, list_transform(coalesce(steps, [])[-6:], lambda s: {'r': s.role, 'c': s.content}) AS tail FROM traces WHERE id IS NOT NULL) SELECT id, md5(coalesce((list_filter(tail, lambda s: s.r = 'user')[-1]).c, '')) AS digest FROM t")
def last_user_turn(spark, sf_dir):
    """The last user text among the last six steps of each trace."""
    empty = F.array().cast("array<struct<role:string,content:string>>")
    return _traces(spark, sf_dir).where("id is not null").select("id", F.md5(context.last_user_text(F.coalesce(F.transform("steps", lambda s: F.struct(s["role"].alias("role"), s["content"].alias("content"))), empty))).alias("digest")).distinct()


@query(f"WITH {MD} SELECT name, name AS parsed, trim(replace(d, chr(10), ' ')) AS description FROM (SELECT name, {_DESC} AS d FROM ls) WHERE NOT regexp_matches(d, '[:#\"''{{}}\\[\\]\\\\]')")
def front_matter_roundtrip(spark, sf_dir):
    """Front matter of skills as files, read again (of descriptions that need no quotes)."""
    d = _skills(spark, sf_dir)
    fields = messages.front_matter(context.skill_md(F.col("name"), F.col("description"), F.col("body"), F.col("provisional")))["fields"]
    told = d.select("name", fields["name"].alias("parsed"), fields["description"].alias("description"), "provisional", F.col("description").alias("own"))
    return told.where(~F.coalesce("own", F.lit("")).rlike(r"[:#\"'{}\[\]\\]") & ~F.coalesce("description", F.lit("")).contains(":")).select("name", "parsed", "description")


@query("SELECT event_id, (user_id % 5) * 60 + (event_id % 7) + 0.5 AS seconds FROM events")
def retry_waits(spark, sf_dir):
    """Waiting times read from messages made of events."""
    said = F.concat(F.lit("Rate limit reached; try again in "), (F.col("user_id") % 5).cast("string"), F.lit("m"), (F.col("event_id") % 7).cast("string"), F.lit(".5s."))
    return table(spark, sf_dir, "events").select("event_id", messages.retry_after(said).alias("seconds"))


@query("WITH d AS (SELECT doc_id, trim(coalesce(text, '')) AS x, len(regexp_extract_all(coalesce(text, ''), '(?m)^```')) AS n, regexp_extract_all(coalesce(text, ''), '(?sm)^```[^\\n]*\\n(.*?)^```', 1) AS b FROM documents) SELECT doc_id, n AS fences, CASE WHEN n % 2 = 1 THEN NULL ELSE md5(array_to_string(list_transform(b, lambda x: rtrim(regexp_replace(x, '\\n+$', ''))), chr(10) || chr(10))) END AS digest FROM d WHERE n > 0")
def document_code(spark, sf_dir):
    """Code blocks of documents with fences; null where a fence is left open."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"(?m)^```")).cast("bigint").alias("fences")).where("fences > 0")
    return d.select("doc_id", "fences", F.md5(messages.extract_code(F.col("text"))).alias("digest"))


# ---- recall


def _sql_recall(asked: str, limit: str = "WHERE rank <= 3") -> str:
    """SQL of ranked recall over the queries (qid, text) of ``asked``."""
    sql = ORACLES["coverage_topk"].replace("SELECT item_id AS qid, text,", "SELECT qid, text,").replace("FROM eval_items WHERE item_id IS NOT NULL", f"FROM ({asked})")
    return sql.replace("WHERE rank <= 3", limit)


@query(f"WITH {PROFILE} SELECT term, weight FROM px WHERE name = (SELECT min(name) FROM px)")
def skill_profile(spark, sf_dir):
    """The profile of one skill (the least)."""
    p = retrieval.profiles(_skills(spark, sf_dir).where(F.col("status").isin(*retrieval.RETRIEVABLE)))
    return p.join(F.broadcast(p.agg(F.min("name").alias("name"))), "name").select("term", "weight")


@query(f"WITH k AS ({ORACLES['coverage_topk']}), {SKILLS} SELECT qid, rank, name, status, version, round(score, 2)::DOUBLE AS score, CASE WHEN coalesce(uses, 0) > 0 THEN round(coalesce(successes, 0) / uses, 2) ELSE 0.0 END::DOUBLE AS hit_rate, CASE WHEN coalesce(recalls, 0) > 0 THEN round(coalesce(uses, 0) / recalls, 2) ELSE 0.0 END::DOUBLE AS trigger_precision, coalesce(len(provenance), 0)::INTEGER AS traces FROM k JOIN ls USING (name)")
def recall_hits(spark, sf_dir):
    """The hits of ranked recall as they are shown, with rates and provenance."""
    share = lambda a, b: F.when(F.coalesce(F.col(b), F.lit(0)) > 0, F.round(F.coalesce(F.col(a), F.lit(0)) / F.col(b), 2)).otherwise(0.0)
    s = _skills(spark, sf_dir).select("name", "status", "version", share("successes", "uses").alias("hit_rate"), share("uses", "recalls").alias("trigger_precision"), F.coalesce(F.array_size("provenance"), F.lit(0)).alias("traces"))
    return QUERIES["coverage_topk"](spark, sf_dir).join(s, "name").select("qid", "rank", "name", "status", "version", F.round("score", 2).alias("score"), "hit_rate", "trigger_precision", "traces")


@query(f"WITH k AS ({ORACLES['coverage_topk']}), {SKILLS} SELECT name, coalesce(any_value(recalls), 0) + count(k.qid) AS recalls FROM ls LEFT JOIN k USING (name) GROUP BY name")
def recall_counts(spark, sf_dir):
    """How often each skill was shown, the hits of ranked recall included."""
    k = QUERIES["coverage_topk"](spark, sf_dir).groupBy("name").agg(F.count("*").alias("n"))
    return _skills(spark, sf_dir).select("name", "recalls").join(k, "name", "left").select("name", (F.coalesce("recalls", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("recalls"))


_PROBES = "SELECT name AS qid, queries[1] AS text FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY updated DESC NULLS LAST, version DESC NULLS LAST, uses DESC NULLS LAST, recalls DESC NULLS LAST) AS nth FROM skills WHERE name IS NOT NULL) WHERE nth = 1 AND queries[1] <> ''"


def _probes(spark, sf_dir):
    d = _skills(spark, sf_dir)
    return d.select(F.col("name").alias("qid"), F.try_element_at("queries", F.lit(1)).alias("text"), "status").where("text <> ''")


@query(f"WITH k AS ({_sql_recall(_PROBES, 'WHERE rank <= 1')}), {SKILLS}, p AS (SELECT p.qid, CASE WHEN status IN ('active', 'candidate') THEN p.qid END AS target, k.name AS got, coalesce(status, 'none') AS class FROM ({_PROBES}) p JOIN ls ON ls.name = p.qid LEFT JOIN k ON k.qid = p.qid) SELECT class, count(*) AS n, count(*) FILTER (WHERE target = got) AS hits, count(*) FILTER (WHERE target IS NULL AND got IS NULL) AS abstained, count(*) FILTER (WHERE target IS NULL AND got IS NOT NULL) AS false_fires, round({_WIL('count(*) FILTER (WHERE target IS NOT DISTINCT FROM got)', 'count(*)')[0]}, 6)::DOUBLE AS low FROM p GROUP BY class")
def retrieval_eval(spark, sf_dir):
    """Recall of each skill by its first query, by status: hits at rank 1, and abstentions and false fires for those that can't be recalled."""
    probes = _probes(spark, sf_dir).select("qid", F.coalesce("status", F.lit("none")).alias("class"), F.when(F.col("status").isin(*retrieval.RETRIEVABLE), F.col("qid")).alias("target"))
    d = reports.probe_eval(retrieval.coverage(_probes(spark, sf_dir).select("qid", "text"), table(spark, sf_dir, "skills"), 1), probes)
    return d.withColumn("low", F.round(stats.wilson(F.col("hits") + F.col("abstained"), F.col("n"))[0], 6))


@query(f"WITH k AS ({_sql_recall(_PROBES, 'WHERE rank <= 2')}), {SKILLS}, e AS (SELECT p.qid FROM ({_PROBES}) p JOIN ls ON ls.name = p.qid AND status IN ('active', 'candidate')) SELECT count(*) AS n, count(*) FILTER (WHERE one = e.qid) AS at_1, count(*) FILTER (WHERE one = e.qid OR two = e.qid) AS in_set, count(*) FILTER (WHERE one <> e.qid) AS false_fires FROM e LEFT JOIN (SELECT qid, max(name) FILTER (WHERE rank = 1) AS one, max(name) FILTER (WHERE rank = 2) AS two FROM k GROUP BY qid) h USING (qid)")
def offline_bench(spark, sf_dir):
    """Recall of skills by their first query: at rank 1, among two, and false fires; those that can't be recalled are skipped."""
    probes = _probes(spark, sf_dir).where(F.col("status").isin(*retrieval.RETRIEVABLE)).select("qid", "text")
    h = retrieval.coverage(probes, table(spark, sf_dir, "skills"), 2).groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("name"))).alias("one"), F.max(F.when(F.col("rank") == 2, F.col("name"))).alias("two"))
    d = probes.join(h, "qid", "left")
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("one") == F.col("qid")).alias("at_1"), F.count_if((F.col("one") == F.col("qid")) | (F.col("two") == F.col("qid"))).alias("in_set"), F.count_if(F.col("one") != F.col("qid")).alias("false_fires"))


_TWENTIETH = "('0x' || left(md5(name), 8))::BIGINT % 20 = 0"
_HASKED = f"SELECT name AS qid, description AS text FROM ls WHERE {_TWENTIETH} AND description <> ''"


def _hybrid_sql() -> str:
    lexical = _sql_recall(_HASKED, "").replace("round(score, 6)::DOUBLE AS score", "score")
    lexical = lexical[len("WITH ") :]  # its parts come first
    head, tail = lexical.rsplit("\nSELECT", 1)
    words = f"""qe AS ({_HASKED}), lx AS (SELECT{tail}), v AS (SELECT name, embedding::DOUBLE[] AS e FROM lib WHERE len(embedding) > 0), qv AS (SELECT ls.name AS qid, ls.embedding::DOUBLE[] AS e FROM ls JOIN qe ON qe.qid = ls.name WHERE len(ls.embedding) > 0),
cs AS (SELECT qid, name, coalesce(list_dot_product(qv.e, v.e) / nullif(sqrt(list_dot_product(qv.e, qv.e)) * sqrt(list_dot_product(v.e, v.e)), 0), 0.0) AS cosine FROM qv JOIN v ON len(qv.e) = len(v.e) AND qid <> name), nr AS (SELECT qid, name, cosine FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(cosine, 9) DESC, name) AS k FROM cs WHERE cosine >= 0.45 - 1e-12) WHERE k <= 10),
sa AS (SELECT name, {FACET("concat_ws(' ', replace(name, '-', ' '), array_to_string(coalesce(applies_when, []), ' '))")} AS anchors, not_for, queries, regexp_matches(concat_ws(' ', replace(name, '-', ' '), array_to_string(applies_when, ' ')), {_lit(retrieval.AUTHORING)}) AS authoring FROM lib),
sp AS (SELECT qid, nr.name, max(b.phrase) AS phrase FROM nr LEFT JOIN bp b USING (qid, name) GROUP BY ALL),
ok AS (SELECT nr.* FROM nr JOIN qa USING (qid) JOIN sa USING (name) LEFT JOIN sp USING (qid, name) WHERE (qid, name) NOT IN (SELECT (qid, name) FROM lx) AND intent IN ('task', 'create') AND (intent <> 'create' OR coalesce(authoring, false)) AND (cosine >= 0.62 OR coalesce(phrase, 0) >= 0.3 OR len(anchors) = 0 OR list_has_any(anchors, terms)) AND NOT list_has_any(list_filter({FACET("array_to_string(coalesce(not_for, []), ' ')")}, lambda x: NOT list_contains(anchors, x)), terms)),
al AS (SELECT * FROM ok UNION ALL SELECT nr.* FROM nr WHERE (qid, name) IN (SELECT (qid, name) FROM lx)),
fu AS (SELECT coalesce(lx.qid, al.qid) AS qid, coalesce(lx.name, al.name) AS name, 0.5 * least(1.0, coalesce(score, 0.0)) + 0.5 * coalesce(cosine, 0.0) AS fused FROM lx FULL JOIN al ON lx.qid = al.qid AND lx.name = al.name),
fg AS (SELECT *, first_value(fused) OVER (PARTITION BY qid ORDER BY round(fused, 9) DESC, name) AS best FROM fu), fh AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(fused, 9) DESC, name) AS rank FROM fg WHERE fused >= best * 0.55)
SELECT qid, rank::INTEGER AS rank, name, round(fused, 6)::DOUBLE AS score FROM fh WHERE rank <= 3"""
    return f"WITH {head}, {words}"


@query(_hybrid_sql())
def hybrid_recall(spark, sf_dir):
    """Lexical and vector recall fused, for the skills of which the first 8 hex digits of the name's MD5 are divisible by 20:
    each asks with its description and its embedding."""
    own = _skills(spark, sf_dir).where(F.conv(F.left(F.md5("name"), F.lit(8)), 16, 10).cast("bigint") % 20 == 0).where("description <> ''")
    asked, vectors = own.select(F.col("name").alias("qid"), F.col("description").alias("text")), own.select(F.col("name").alias("qid"), F.col("embedding").alias("v"))
    return retrieval.hybrid_recall(asked, vectors, table(spark, sf_dir, "skills")).withColumn("score", F.round("score", 6))


# ---- evaluation reports


@query(f"WITH {EVAL}, {SKILLS}, v AS (SELECT name, array_to_string(list_sort(list(DISTINCT version)), ',') AS versions FROM skills WHERE name IS NOT NULL AND version IS NOT NULL GROUP BY name), n AS (SELECT skill, count(*) AS evals, count(*) FILTER (WHERE status = 'passed') AS passed FROM ev GROUP BY skill) SELECT ls.name, status, versions, coalesce(evals, 0) AS evals, coalesce(passed, 0) AS passed, coalesce(uses, 0) AS uses, coalesce(provisional, false) AS provisional FROM ls LEFT JOIN v USING (name) LEFT JOIN n ON n.skill = ls.name")
def inspect_skills(spark, sf_dir):
    """Each skill with its versions and evaluations."""
    v = lifecycle.versions(table(spark, sf_dir, "skills")).select("name", F.array_join(F.transform("versions", lambda x: x.cast("string")), ",").alias("versions"))
    n = sessions.evaluations(_outcomes(spark, sf_dir)).groupBy(F.col("skill").alias("name")).agg(F.count("*").alias("evals"), F.count_if(F.col("status") == "passed").alias("passed"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return _skills(spark, sf_dir).join(v, "name", "left").join(n, "name", "left").select("name", "status", "versions", zero("evals"), zero("passed"), zero("uses"), F.coalesce("provisional", F.lit(False)).alias("provisional"))


@query(f"WITH {LESSONS} SELECT outcome, round_even(100 * avg(generalizable::INTEGER), 0)::DOUBLE AS general FROM le GROUP BY outcome")
def percent_general(spark, sf_dir):
    """Of the lessons of each outcome, the percentage that is generalizable (halves to even); null without any."""
    return _lessons(spark, sf_dir).groupBy("outcome").agg(F.bround(100 * F.avg(F.col("generalizable").cast("int")), 0).alias("general"))


@query("WITH r AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS passes FROM events WHERE event_type IN ('purchase', 'error') GROUP BY ALL) SELECT user_id, epoch_us(day) AS day FROM r WHERE n = 3 AND passes <= 1")
def necessity_eligible(spark, sf_dir):
    """Users and days with exactly three runs (purchases pass, errors fail) of which at most one passed."""
    d = table(spark, sf_dir, "events").where("event_type in ('purchase', 'error')").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("passes"))
    return d.where("n = 3 and passes <= 1").select("user_id", F.unix_micros(F.col("day").cast("timestamp")).alias("day"))


@query("SELECT DISTINCT t.id, arm, rep::INTEGER AS rep FROM tasks t, (SELECT unnest(['on', 'off']) AS arm), (SELECT unnest([0, 1, 2]) AS rep) WHERE t.id IS NOT NULL AND coalesce(t.suite % 3 <> rep OR arm = 'off', true)")
def missing_runs(spark, sf_dir):
    """Runs of tasks, by arm and repeat, that are still to do: those of arm 'on' whose repeat is the suite modulo 3 are done."""
    t = table(spark, sf_dir, "tasks").where("id is not null").select("id", "suite").distinct()
    wanted = t.select("id", F.explode(F.array(F.lit("on"), F.lit("off"))).alias("arm")).select("id", "arm", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("rep"))
    done = t.select("id", F.lit("on").alias("arm"), (F.col("suite") % 3).cast("int").alias("rep"))
    return reports.missing_jobs(wanted, done, ["id", "arm", "rep"]).distinct()


_NEED = {"train": 18, "test": 18, "dev": 3, "heldout": 3}


@query("WITH n AS (SELECT DISTINCT id, suite, lower(trim(split)) AS split FROM tasks WHERE id IS NOT NULL), c AS (SELECT suite, split, count(*) AS n FROM n GROUP BY ALL), s AS (SELECT DISTINCT suite FROM n) SELECT s.suite, w.split, coalesce(n, 0) AS n, need, coalesce(n, 0) >= need AS done FROM s CROSS JOIN (VALUES " + ", ".join(f"('{k}', {v})" for k, v in _NEED.items()) + ") w(split, need) LEFT JOIN c ON c.suite IS NOT DISTINCT FROM s.suite AND c.split = w.split")
def suite_progress(spark, sf_dir):
    """Tasks of each suite and split against those required."""
    t = table(spark, sf_dir, "tasks").where("id is not null").select("id", "suite", F.lower(F.trim("split")).alias("split")).distinct()
    need = F.array(*(F.struct(F.lit(k).alias("split"), F.lit(v).alias("need")) for k, v in _NEED.items()))
    every = t.select("suite").distinct().select("suite", F.inline(need))
    c = t.groupBy(F.col("suite").alias("_s"), F.col("split").alias("_p")).agg(F.count("*").alias("n"))
    d = every.join(c, F.col("suite").eqNullSafe(F.col("_s")) & (F.col("split") == F.col("_p")), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return d.select("suite", "split", "n", "need", (F.col("n") >= F.col("need")).alias("done"))


_ARMS = "ar AS (SELECT user_id AS task, CASE WHEN event_type IN ('click', 'purchase') THEN 'on' ELSE 'off' END AS arm, list(value > 20 ORDER BY event_id) AS ok FROM events GROUP BY ALL), pa AS (SELECT x.task, x.ok AS x, y.ok AS y, least(len(x.ok), len(y.ok)) AS n FROM ar x JOIN ar y ON x.task = y.task AND x.arm = 'on' AND y.arm = 'off')"
_P = lambda w, k: f"CASE WHEN {w} + {k} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least({w}, {k}) + 1), lambda i: exp(lgamma({w} + {k} + 1) - lgamma(i + 1) - lgamma({w} + {k} - i + 1) - ({w} + {k}) * ln(2.0))))) END"


def _arms(spark, sf_dir):
    arm = F.when(F.col("event_type").isin("click", "purchase"), "on").otherwise("off")
    g = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("task"), arm.alias("arm")).agg(F.sort_array(F.collect_list(F.struct("event_id", (F.col("value") > 20).alias("ok")))).alias("x"))  # a task's trials
    return g.select("task", "arm", F.transform("x", lambda s: s["ok"]).alias("ok"))


@query(f"WITH {_ARMS}, r AS (SELECT *, list_sum(list_transform(x, lambda v: v::INTEGER)) / len(x) AS rx, list_sum(list_transform(y, lambda v: v::INTEGER)) / len(y) AS ry, len(list_filter(range(1, n + 1), lambda i: x[i] AND NOT y[i])) AS w, len(list_filter(range(1, n + 1), lambda i: NOT x[i] AND y[i])) AS l FROM pa), s AS (SELECT count(*) AS tasks, count(*) FILTER (WHERE rx > ry) AS wins, count(*) FILTER (WHERE rx < ry) AS losses, sum(n)::BIGINT AS trials, sum(w)::BIGINT AS trial_wins, sum(l)::BIGINT AS trial_losses FROM r) SELECT tasks, wins, losses, trials, trial_wins, trial_losses, round({_P('wins', 'losses')}, 6)::DOUBLE AS p FROM s")
def ab_report(spark, sf_dir):
    """Users as tasks, clicks and purchases against other events as arms, values over 20 as passes: wins and losses by task and trial."""
    return reports.ab(_arms(spark, sf_dir), "on", "off").withColumn("p", F.round("p", 6)).drop("trial_p")


@query(f"WITH {_ARMS} SELECT task, n::INTEGER AS n, len(list_filter(x[1:n], lambda v: v))::INTEGER AS on_passes, len(list_filter(y[1:n], lambda v: v))::INTEGER AS off_passes FROM pa")
def ab_export(spark, sf_dir):
    """The same arms, cut to a common number of trials for each task."""
    a = _arms(spark, sf_dir)
    side = lambda arm, c: a.where(F.col("arm") == arm).select("task", F.col("ok").alias(c))
    d = side("on", "x").join(side("off", "y"), "task").withColumn("n", F.least(F.size("x"), F.size("y")))
    passes = lambda c: F.size(F.filter(F.slice(c, F.lit(1), F.col("n")), lambda v: v))
    return d.select("task", "n", passes("x").alias("on_passes"), passes("y").alias("off_passes"))


@query("SELECT event_type, (list_sort(list(value)))[len(list(value)) // 2 + 1] AS median FROM events WHERE value IS NOT NULL GROUP BY event_type")
def upper_medians(spark, sf_dir):
    """The upper median of the values of each type of event."""
    return reports.upper_median(["event_type"], "value", table(spark, sf_dir, "events").where("value is not null"))


@query("WITH r AS (SELECT user_id, date_trunc('day', ts) AS day, max((event_type = 'purchase')::INTEGER) = 1 AS a, max((event_type = 'signup')::INTEGER) = 1 AS b FROM events GROUP BY ALL), s AS (SELECT count(*) AS pairs, count(*) FILTER (WHERE a AND NOT b) AS wins, count(*) FILTER (WHERE b AND NOT a) AS losses FROM r) SELECT pairs, wins, losses, round(" + _P("wins", "losses") + ", 6)::DOUBLE AS p, CASE WHEN " + _P("wins", "losses") + " < 0.05 AND wins > losses THEN 'better' WHEN " + _P("wins", "losses") + " < 0.05 AND losses > wins THEN 'worse' ELSE 'no difference shown' END AS verdict FROM s")
def paired_verdict(spark, sf_dir):
    """Days of users with a purchase against those with a signup: discordant pairs, sign test and verdict."""
    g = table(spark, sf_dir, "events").groupBy(F.concat_ws("-", "user_id", F.date_trunc("day", "ts")).alias("k")).agg(F.bool_or(F.col("event_type") == "purchase").alias("a"), F.bool_or(F.col("event_type") == "signup").alias("b"))
    d = stats.paired(g.select("k", F.col("a").alias("ok")), g.select("k", F.col("b").alias("ok")), "k", "ok")
    return d.select("pairs", "wins", "losses", F.round("p", 6).alias("p"), stats.verdict(F.col("p"), F.col("wins"), F.col("losses"), F.lit(0.0)).alias("verdict"))


@query("WITH c AS (SELECT user_id AS task, event_id % 10 AS part, bool_and(event_type <> 'error') AS ok FROM events GROUP BY ALL) SELECT task, bool_and(ok) AS passed, min(part) FILTER (WHERE NOT ok) AS first_failure FROM c GROUP BY task")
def check_summaries(spark, sf_dir):
    """Users as tasks of ten parts each: whether all passed, and the first that failed."""
    d = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("task"), (F.col("event_id") % 10).alias("index")).agg(F.bool_and(F.col("event_type") != "error").alias("ok"))
    return reports.check_summary(d.withColumns({"part": F.lit("a"), "status": F.when(F.col("ok"), "pass").otherwise("fail")}))


@query("WITH a AS (SELECT user_id % 3 AS condition, user_id, list(event_type = 'purchase' ORDER BY event_id) AS ok, sum(len(props)) AS chars, bool_or(event_type = 'signup' AND value > 90) AS bad FROM events GROUP BY ALL), s AS (SELECT condition, count(*) FILTER (WHERE NOT bad AND ok[-1]) AS k, count(*) FILTER (WHERE NOT bad AND ok[1]) AS first_k, count(*) FILTER (WHERE NOT bad) AS n, count(*) FILTER (WHERE bad) AS errors, avg(chars) FILTER (WHERE NOT bad) AS context FROM a GROUP BY condition) SELECT condition, k, first_k, n, errors, round(context, 6)::DOUBLE AS context FROM s")
def episode_report(spark, sf_dir):
    """Users as episodes of three conditions, events as attempts: passes at last and at first, context, harness errors."""
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 3).alias("condition"), "user_id").agg(
        F.sort_array(F.collect_list(F.struct("event_id", (F.col("event_type") == "purchase").alias("ok")))).alias("x"), F.sum(F.length("props")).alias("context_chars"), F.bool_or((F.col("event_type") == "signup") & (F.col("value") > 90)).alias("bad")
    )  # an episode's attempts
    d = e.select("condition", F.transform("x", lambda s: s["ok"]).alias("attempts"), "context_chars", F.when(F.col("bad"), "broken").alias("harness_error"))
    return reports.episodes(d).select("condition", "k", "first_k", "n", "errors", F.round("context", 6).alias("context"))


@query(f"WITH k AS ({ORACLES['hybrid_recall']}), q AS (SELECT qid, max(name) FILTER (WHERE rank = 1) AS got FROM k GROUP BY qid), {SKILLS}, a AS (SELECT name AS qid, status IN ('active', 'candidate') AS live FROM ls WHERE {_TWENTIETH} AND description <> '') SELECT count(*) FILTER (WHERE live AND got = qid) AS tp, count(*) FILTER (WHERE live AND got <> qid OR NOT live AND got IS NOT NULL) AS fp, count(*) FILTER (WHERE live AND got IS NULL) AS fn, count(*) FILTER (WHERE NOT live AND got IS NULL) AS tn FROM a LEFT JOIN q USING (qid)")
def hybrid_eval(spark, sf_dir):
    """Confusion counts of hybrid recall: a live skill asks for itself, another for none."""
    top = QUERIES["hybrid_recall"](spark, sf_dir).where("rank = 1").select("qid", F.col("name").alias("got"))
    own = _skills(spark, sf_dir).where(F.conv(F.left(F.md5("name"), F.lit(8)), 16, 10).cast("bigint") % 20 == 0).where("description <> ''").select(F.col("name").alias("qid"), F.coalesce(F.col("status").isin(*retrieval.RETRIEVABLE), F.lit(False)).alias("live"))
    d = own.join(top, "qid", "left")
    live, got, right = F.col("live"), F.col("got").isNotNull(), F.coalesce(F.col("got") == F.col("qid"), F.lit(False))
    return d.agg(F.count_if(live & right).alias("tp"), F.count_if((live & got & ~right) | (~live & got)).alias("fp"), F.count_if(live & ~got).alias("fn"), F.count_if(~live & ~got).alias("tn"))


# ---- streams


@query("WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events), w AS (SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT epoch_us(day) AS day, event_type, n FROM w, m WHERE day + INTERVAL 1 DAY <= mark")
def stream_windows(spark, sf_dir):
    """Events by day and type as a stream with a watermark: the days it has closed."""
    d = ingest.windows(_events(spark, sf_dir), "ts", ["event_type"])
    return d.select(F.unix_micros("from").alias("day"), "event_type", "n")


@query("SELECT user_id, count(*) AS n, epoch_us(max(ts)) AS last FROM events GROUP BY user_id")
def stream_counters(spark, sf_dir):
    """Events of each user, counted as state of a stream, repeats once."""
    d = ingest.counters(_events(spark, sf_dir), "user_id", "event_id", "ts")
    return d.select("user_id", "n", F.unix_micros("last").alias("last"))


def _events(spark, sf_dir):
    return ingest.files_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
