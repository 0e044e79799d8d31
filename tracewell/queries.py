"""The core's queries by name, each over whole tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import safety, text
from tracewell.operators import lifecycle, normalise, playbook, retrieval, sanitize, stats, traces
from tracewell.sources.tables import table
from tracewell.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its own name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Parts of the SQL.
LATEST = """lt0 AS (SELECT id, agent, ts, received, eval_id, skills_used, signals,
  coalesce(list_sum(list_transform(steps, lambda s: coalesce(len(s.tool_calls), 0))), 0)::BIGINT AS calls,
  coalesce(list_sum(list_transform(steps, lambda s: coalesce(len(list_filter(s.tool_calls, lambda c: coalesce(c.error <> '', false))), 0))), 0)::BIGINT AS errors,
  row_number() OVER (PARTITION BY id ORDER BY received DESC NULLS LAST, coalesce(len(signals), 0) DESC) AS nth
  FROM traces WHERE id IS NOT NULL),
lt AS (SELECT * FROM lt0 WHERE nth = 1)"""
_w = lambda o: f"coalesce(list_sum(list_transform(list_filter(signals, lambda s: s.outcome = '{o}'), lambda s: coalesce(s.confidence, 0.0))), 0.0)"
OUTCOME = f"""{LATEST},
gu AS (SELECT *, CASE WHEN calls = 0 THEN 'unknown' WHEN errors / calls > 0.4 THEN 'failure' WHEN errors = 0 THEN 'success' ELSE 'partial' END AS guess FROM lt),
vo AS (SELECT *, coalesce(len(signals), 0) = 0 AS bare, {_w('success')} AS s1, {_w('failure')} AS f1, {_w('partial')} AS p1 FROM gu),
wo AS (SELECT *, CASE WHEN bare THEN CASE guess WHEN 'success' THEN 0.25 ELSE 0.0 END ELSE s1 END AS s,
  CASE WHEN bare THEN CASE guess WHEN 'failure' THEN 0.4 ELSE 0.0 END ELSE f1 END AS f,
  CASE WHEN bare THEN CASE guess WHEN 'partial' THEN 0.3 ELSE 0.0 END ELSE p1 END AS p FROM vo),
oc AS (SELECT * EXCLUDE (s, f, p), greatest(s, f, p) AS best, CASE WHEN greatest(s, f, p) <= 0 THEN 'unknown' WHEN s = greatest(s, f, p) THEN 'success' WHEN f = greatest(s, f, p) THEN 'failure' ELSE 'partial' END AS outcome,
  CASE WHEN greatest(s, f, p) <= 0 THEN 0.0 ELSE least(1.0, greatest(s, f, p)) END AS confidence FROM wo)"""
CALLS = """st AS (SELECT id, agent, unnest(steps) AS s, generate_subscripts(steps, 1) - 1 AS step_pos FROM traces WHERE id IS NOT NULL),
ca0 AS (SELECT id, agent, step_pos, unnest(s.tool_calls) AS c, generate_subscripts(s.tool_calls, 1) - 1 AS call_pos FROM st),
ca AS (SELECT id, step_pos, call_pos, min(agent) AS agent, min(c.name) AS name, min(c.args) AS args, min(c.result) AS result, min(c.error) AS error, min(c.duration_ms) AS duration_ms FROM ca0 GROUP BY ALL)"""
SKILLS = """ls AS (SELECT * REPLACE (lower(trim(status)) AS status) FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY updated DESC NULLS LAST, version DESC NULLS LAST, uses DESC NULLS LAST, recalls DESC NULLS LAST) AS nth FROM skills WHERE name IS NOT NULL) WHERE nth = 1)"""
LESSONS = "le AS (SELECT DISTINCT ON (id) * FROM lessons WHERE id IS NOT NULL)"


def _q(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _terms(x: str, least: int, stop: list[str]) -> str:
    """SQL of the tokenizers: distinct terms of the expression ``x``."""
    raw = f"regexp_extract_all(lower(coalesce({x}, '')), {_lit(text.TOKEN)})"
    return f"list_filter(list_distinct(flatten(list_transform({raw}, lambda w: list_concat([w], string_split_regex(w, '[_.-]+'))))), lambda p: len(p) >= {least} AND NOT regexp_full_match(p, '[0-9]+') AND NOT list_contains({_q(stop)}, p))"


FACET = lambda x: _terms(x, 3, text.FACET_STOP)
QUERY = lambda x: _terms(x, 2, text.QUERY_STOP)


def _traces(s, d):
    return table(s, d, "traces")


def _outcomes(s, d):
    return traces.with_outcome(traces.slim(_traces(s, d)))


def _skills(s, d):
    return retrieval.latest_skills(table(s, d, "skills"))


def _lessons(s, d):
    return lifecycle.latest_lessons(table(s, d, "lessons"))


# ---- traces


@query(f"WITH {LATEST} SELECT id, agent, calls, errors, coalesce(len(signals), 0)::BIGINT AS n_signals FROM lt")
def trace_latest(spark, sf_dir):
    """The latest delivery of each trace, with its calls, failed calls and signals."""
    return traces.slim(_traces(spark, sf_dir)).select("id", "agent", F.col("calls").cast("bigint"), F.col("errors").cast("bigint"), F.coalesce(F.array_size("signals"), F.lit(0)).cast("bigint").alias("n_signals"))


@query(f"WITH {LATEST} SELECT id, CASE WHEN calls = 0 THEN 'unknown' WHEN errors / calls > 0.4 THEN 'failure' WHEN errors = 0 THEN 'success' ELSE 'partial' END AS outcome, CASE WHEN calls = 0 THEN 0.0 WHEN errors / calls > 0.4 THEN 0.4 WHEN errors = 0 THEN 0.25 ELSE 0.3 END::DOUBLE AS confidence FROM lt")
def heuristic_outcome(spark, sf_dir):
    """Outcome and confidence by the share of failed tool calls."""
    o, c = traces.heuristic(F.col("calls"), F.col("errors"))
    return traces.slim(_traces(spark, sf_dir)).select("id", o.alias("outcome"), c.alias("confidence"))


@query(f"WITH {OUTCOME} SELECT id, outcome, round(confidence, 6)::DOUBLE AS confidence FROM oc")
def outcome_vote(spark, sf_dir):
    """Outcome and confidence by the weighted vote of signals."""
    return _outcomes(spark, sf_dir).select("id", "outcome", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {CALLS} SELECT name, count(*) AS calls, count(*) FILTER (WHERE error <> '') AS errors, median(duration_ms)::DOUBLE AS median_ms FROM ca GROUP BY name")
def latency_by_tool(spark, sf_dir):
    """Calls, failed calls and median duration of each tool."""
    return traces.calls_of(_traces(spark, sf_dir)).groupBy("name").agg(F.count("*").alias("calls"), F.count_if(F.col("error") != "").alias("errors"), F.median("duration_ms").alias("median_ms"))


@query(f"WITH {CALLS} SELECT agent, count(result) AS results, count(*) FILTER (WHERE " + " OR ".join(f"contains(lower(left(result, 200)), {_lit(m)})" for m in text.ERROR_MARKERS) + ") AS like_errors FROM ca GROUP BY agent")
def error_sniff(spark, sf_dir):
    """For each agent, results and those that look like errors."""
    return traces.calls_of(_traces(spark, sf_dir)).groupBy("agent").agg(F.count("result").alias("results"), F.count_if(text.error_sniff(F.col("result"))).alias("like_errors"))


@query(f"WITH {LATEST} SELECT id, agent, ts FROM lt ORDER BY ts DESC NULLS LAST, id LIMIT 20")
def recent_traces(spark, sf_dir):
    """The 20 newest traces (a top-k report)."""
    return traces.slim(_traces(spark, sf_dir)).orderBy(F.desc_nulls_last("ts"), "id").limit(20).select("id", "agent", "ts")


@query(f"WITH {LATEST} SELECT lt.id, lt.ts FROM lt WHERE eval_id IS NULL AND NOT EXISTS (SELECT 1 FROM lessons l WHERE l.trace_id = lt.id)")
def pending_traces(spark, sf_dir):
    """Traces, but for evaluation runs, from which no lesson was drawn yet."""
    return traces.slim(_traces(spark, sf_dir)).where("eval_id is null").join(table(spark, sf_dir, "lessons").select(F.col("trace_id").alias("id")), "id", "left_anti").select("id", "ts")


@query(f"WITH {OUTCOME} SELECT id, eval_id, outcome = 'success' AND confidence >= 0.5 AS passed FROM oc WHERE eval_id IS NOT NULL")
def eval_decision(spark, sf_dir):
    """Whether each evaluation run passed: a success with a confidence of at least 0.5."""
    return _outcomes(spark, sf_dir).where("eval_id is not null").select("id", "eval_id", ((F.col("outcome") == "success") & (F.col("confidence") >= 0.5)).alias("passed"))


_F2 = lambda x: f"printf('%.2f', {x})"
_LINES = """list_transform(steps, lambda s, i: list_concat(CASE WHEN coalesce(s.content, '') <> '' THEN ['[' || (i - 1) || '] ' || upper(coalesce(s.role, '')) || ': ' || left(s.content, 800)] ELSE [] END,
 list_transform(coalesce(s.tool_calls, []), lambda c: '[' || (i - 1) || '] TOOL ' || coalesce(c.name, '') || '(' || left(coalesce(c.args, '{}'), 400) || ')' || CASE WHEN coalesce(c.error, '') <> '' THEN chr(10) || '      ERROR: ' || left(c.error, 600) WHEN c.result IS NOT NULL THEN chr(10) || '      -> ' || left(c.result, 400) ELSE '' END)))"""


@query(f"""WITH {OUTCOME.replace("SELECT id, agent, ts, received,", "SELECT id, task, steps, agent, ts, received,").replace("row_number() OVER (PARTITION BY id ORDER BY received DESC NULLS LAST, coalesce(len(signals), 0) DESC)", "1")},
t AS (SELECT id, array_to_string(list_concat(['TASK: ' || coalesce(task, ''), 'AGENT: ' || coalesce(agent, ''), 'SKILLS USED: ' || CASE WHEN len(skills_used) > 0 THEN '[' || chr(39) || array_to_string(skills_used, chr(39) || ', ' || chr(39)) || chr(39) || ']' ELSE 'none' END, ''], flatten({_LINES}),
 ['', 'SIGNALS: ' || CASE WHEN len(signals) > 0 THEN array_to_string(list_transform(signals, lambda s: coalesce(s.source, '') || '=' || coalesce(s.outcome, '') || '(' || {_F2("coalesce(s.confidence, 0.0)")} || ') ' || coalesce(s.detail, '')), '; ')
  ELSE 'tool_errors=' || guess || '(' || CASE WHEN calls = 0 THEN '0.00' WHEN guess = 'failure' THEN '0.40' WHEN guess = 'success' THEN '0.25' ELSE '0.30' END || ') ' || CASE WHEN calls = 0 THEN 'no tool calls' ELSE errors || '/' || calls || ' tool calls errored' END END,
  'OUTCOME: ' || outcome || ' (conf ' || {_F2("confidence")} || ')']), chr(10)) AS text FROM oc)
SELECT DISTINCT id, md5(CASE WHEN len(text) > 12000 THEN left(text, 6000) || chr(10) || '...[truncated]...' || chr(10) || right(text, 6000) ELSE text END) AS digest FROM t""")
def compact_render(spark, sf_dir):
    """A readable rendering of each delivery, by its digest."""
    return traces.compact(_traces(spark, sf_dir).where("id is not null")).select("id", F.md5("text").alias("digest")).distinct()


# ---- safety


def _redact_sql() -> str:
    texts = """st0 AS (SELECT id, task, unnest(steps) AS s, generate_subscripts(steps, 1) - 1 AS step_pos FROM traces WHERE id IS NOT NULL),
st1 AS (SELECT id, step_pos, unnest(s.tool_calls) AS c, generate_subscripts(s.tool_calls, 1) - 1 AS call_pos FROM st0),
st AS (SELECT DISTINCT id, step_pos, -1 AS call_pos, 'content' AS field, s.content AS t0 FROM st0 UNION SELECT id, step_pos, call_pos, 'result', c.result FROM st1 UNION SELECT id, step_pos, call_pos, 'error', c.error FROM st1 UNION SELECT id, -1, -1, 'task', task FROM traces WHERE id IS NOT NULL)"""
    ctes, names = [texts], []
    for i, (k, p, g) in enumerate(safety.REDACTIONS):
        new = {"": "", "1": "\\1", "12": "\\1"}[g] + f"[REDACTED:{k}]" + ("\\2" if g == "12" else "")
        before = f"r{i - 1}" if i else "st"
        ctes.append(f"r{i} AS MATERIALIZED (SELECT id, step_pos, call_pos, field, regexp_replace(t0, {_lit(p)}, {_lit(new)}, 'g') AS t0{''.join(', ' + n for n in names)}, len(regexp_extract_all(t0, {_lit(p)})) AS n{i} FROM {before} WHERE t0 IS NOT NULL)")
        names.append(f"n{i}")
    return f"WITH {', '.join(ctes)} SELECT id, step_pos::INTEGER AS step_pos, call_pos::INTEGER AS call_pos, field, md5(t0) AS digest, ({' + '.join(names)})::INTEGER AS found FROM r{len(safety.REDACTIONS) - 1} WHERE {' + '.join(names)} > 0"


@query(_redact_sql())
def redacted_texts(spark, sf_dir):
    """Tasks, contents, results and errors in which something was redacted: a digest of what is left, and the number of
    replacements (arguments are walked as JSON: sanitized_traces)."""
    return sanitize.redacted_texts(_traces(spark, sf_dir))


_PLAIN = [(k, p) for k, p in safety.INJECTIONS if "(?!" not in p]


@query(
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), f AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, len(regexp_extract_all(x, {_lit(p)}))::BIGINT AS found FROM t" for k, p in _PLAIN)
    + ") SELECT * FROM f WHERE found > 0"
)
def injection_findings(spark, sf_dir):
    """Findings of each document by kind, but for the kind that looks ahead."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("x"))
    counts = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_count("x", F.lit(p)).cast("bigint").alias("found")) for k, p in _PLAIN))
    return d.select("doc_id", F.inline(counts)).where("found > 0")


@query()
def injection_callouts(spark, sf_dir):
    """Documents and skills with a finding of any kind, the looking-ahead one included (RE2 can't say it)."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), "text").unionByName(_skills(spark, sf_dir).select(F.col("name").alias("key"), F.concat_ws("\n", "description", "body").alias("text")))
    return d.select("key", F.size(safety.injection_findings(F.col("text"))).alias("found")).where("found > 0")


@query(f"WITH {CALLS} SELECT id, step_pos::INTEGER AS step_pos, call_pos::INTEGER AS call_pos, len(args) > 2000 AS args_cut, len(result) > 3000 AS result_cut, len(error) > 3000 AS error_cut FROM ca WHERE len(args) > 2000 OR len(result) > 3000 OR len(error) > 3000")
def capped_fields(spark, sf_dir):
    """Tool calls of which a field is over its cap."""
    over = lambda c, n: F.length(c) > n
    d = traces.calls_of(_traces(spark, sf_dir)).select("id", "step_pos", "call_pos", over("args", safety.MAX_ARGS).alias("args_cut"), over("result", safety.MAX_RESULT).alias("result_cut"), over("error", safety.MAX_RESULT).alias("error_cut"))
    return d.where("args_cut or result_cut or error_cut")


@query(f"WITH {SKILLS} SELECT name AS key FROM ls WHERE regexp_matches(concat_ws(chr(10), name, description, body), {_lit(safety.RISKY)}) UNION ALL SELECT doc_id::VARCHAR FROM documents WHERE regexp_matches(text, {_lit(safety.RISKY)})")
def risky_texts(spark, sf_dir):
    """Skills and documents with network, credential or destructive vocabulary."""
    own = _skills(spark, sf_dir).where(F.concat_ws("\n", "name", "description", "body").rlike(safety.RISKY)).select(F.col("name").alias("key"))
    return own.unionByName(table(spark, sf_dir, "documents").where(F.col("text").rlike(safety.RISKY)).select(F.col("doc_id").cast("string").alias("key")))


# ---- messages

_EXPECT = """ex AS (SELECT DISTINCT id, step_pos, call_pos, coalesce(c.name, '?') AS name, md5(CASE WHEN coalesce(c.args, '') = '' THEN '{}' WHEN json_valid(c.args) THEN c.args ELSE to_json({'raw': c.args})::VARCHAR END) AS args,
  coalesce(c.error, c.result) AS t, c.error IS NOT NULL OR """ + "(" + " OR ".join(f"contains(lower(left(c.result, 200)), {_lit(m)})" for m in text.ERROR_MARKERS) + ") AS bad FROM ca0)"
_MESSAGES = f"WITH {CALLS.split(', ca AS')[0] if False else CALLS[: CALLS.rindex('ca AS')].rstrip().rstrip(',')}, {_EXPECT} SELECT id, step_pos::INTEGER AS step_pos, call_pos::INTEGER AS call_pos, name, args, md5(CASE WHEN NOT bad THEN t END) AS result, md5(CASE WHEN bad THEN t END) AS error FROM ex"


def _calls_of_steps(d):
    calls = d.select("id", F.posexplode(F.col("s.tool_calls")).alias("step_pos", "calls")).select("id", "step_pos", F.posexplode("calls").alias("call_pos", "c"))
    return calls.select("id", "step_pos", "call_pos", "c.name", F.md5("c.args").alias("args"), F.md5("c.result").alias("result"), F.md5("c.error").alias("error")).distinct()


def _steps(spark, sf_dir):
    return _traces(spark, sf_dir).where("id is not null and not coalesce(exists(steps, s -> s is null or coalesce(exists(s.tool_calls, c -> c is null), false)), false)")


@query(_MESSAGES)
def openai_calls(spark, sf_dir):
    """Tool calls of the traces, written as messages with answers in turns of role tool and normalised again."""
    return _calls_of_steps(_steps(spark, sf_dir).select("id", normalise.openai_steps(normalise.to_openai(F.col("steps"))).alias("s")))


@query(_MESSAGES.replace("CASE WHEN coalesce(c.args, '') = '' THEN '{}' WHEN json_valid(c.args) THEN c.args ELSE to_json({'raw': c.args})::VARCHAR END", "CASE WHEN coalesce(c.args, '') = '' THEN '{}' ELSE c.args END"))
def anthropic_calls(spark, sf_dir):
    """Tool calls of the traces, written as messages of content blocks and normalised again."""
    return _calls_of_steps(_steps(spark, sf_dir).select("id", normalise.anthropic_steps(normalise.to_anthropic(F.col("steps"))).alias("s")))


@query("WITH d AS (SELECT DISTINCT id, task, coalesce(len(list_filter(flatten(list_transform(coalesce(steps, []), lambda s: coalesce(s.tool_calls, []))), lambda c: c.result IS NOT NULL OR c.error IS NOT NULL)), 0) > 0 AS told, coalesce(len(list_filter(steps, lambda s: s.role = 'tool' AND coalesce(len(s.tool_calls), 0) = 0)), 0) > 0 AS bare, steps IS NOT NULL AS steps, coalesce(agent, 'unknown') AS agent, ascii(right(coalesce(id, '0'), 1)) % 4 AS kind FROM traces WHERE id IS NOT NULL) SELECT DISTINCT id, CASE WHEN kind = 3 THEN 'not an object' WHEN task IS NULL THEN 'no task' WHEN NOT steps THEN 'no steps or messages' END AS problem, CASE WHEN kind = 3 OR task IS NULL OR NOT steps THEN NULL WHEN kind = 0 THEN 'canonical' WHEN bare OR kind = 1 AND told THEN 'openai' ELSE 'anthropic' END AS format, CASE WHEN NOT (kind = 3 OR task IS NULL OR NOT steps) THEN agent END AS agent FROM d")
def payload_formats(spark, sf_dir):
    """Payloads made of the traces (by the last character of their ids: steps, messages of either kind, or broken JSON), normalised: format and problem."""
    kind = F.pmod(F.ascii(F.right("id", F.lit(1))), F.lit(4))
    d = _traces(spark, sf_dir).where("id is not null").select("id", "task", "agent", "steps", kind.alias("kind"))
    payload = F.when(kind == 0, F.to_json(F.struct("task", "agent", "steps"))).when(kind == 1, F.to_json(F.struct("task", "agent", normalise.to_openai(F.col("steps")).alias("messages")))).when(kind == 2, F.to_json(F.struct("task", "agent", normalise.to_anthropic(F.col("steps")).alias("messages"))))
    return normalise.normalise(d.select("id", F.coalesce(payload, F.lit("[broken")).alias("payload")).withColumnRenamed("id", "key")).select(F.col("key").alias("id"), "problem", "format", "agent").distinct()


# ---- text


@query(f"WITH {LESSONS} SELECT id, unnest({FACET('rule')}) AS term FROM le")
def facet_terms(spark, sf_dir):
    """Content words of lesson rules."""
    return _lessons(spark, sf_dir).select("id", F.explode(text.facet_terms(F.col("rule"))).alias("term"))


@query(f"SELECT DISTINCT id, unnest({QUERY('prompt')}) AS term FROM tasks")
def query_terms(spark, sf_dir):
    """Query words of task prompts."""
    return table(spark, sf_dir, "tasks").select("id", F.explode(text.query_terms(F.col("prompt"))).alias("term")).distinct()


@query(f"WITH t AS (SELECT DISTINCT id, unnest({FACET('prompt')}) AS term FROM tasks), n AS (SELECT count(DISTINCT id) AS n FROM tasks) SELECT term, count(*) AS df, round(ln(1 + any_value(n) / count(*)), 9)::DOUBLE AS idf FROM t, n GROUP BY term")
def term_idf(spark, sf_dir):
    """Terms of task prompts with document frequency and idf."""
    t = table(spark, sf_dir, "tasks")
    n = t.agg(F.count_distinct("id").alias("n"))
    d = t.select("id", F.explode(text.facet_terms(F.col("prompt"))).alias("term")).distinct().groupBy("term").agg(F.count("*").alias("df"))
    return d.join(F.broadcast(n)).select("term", "df", F.round(F.log(1 + F.col("n") / F.col("df")), 9).alias("idf"))


_I = text
_INTENT = lambda x: f"CASE WHEN regexp_matches({x}, {_lit(_I.CREATIVE)}) THEN 'creative' WHEN regexp_matches({x}, {_lit(_I.ERROR_ID)}) OR regexp_matches({x}, {_lit(_I.PROBLEM)}) THEN 'task' WHEN regexp_matches({x}, {_lit(_I.EXPLAIN)}) THEN 'knowledge' WHEN regexp_matches({x}, {_lit(_I.CREATE)}) OR regexp_matches({x}, {_lit(_I.CREATE_HOW)}) THEN 'create' WHEN regexp_matches({x}, {_lit(_I.PROCEDURAL)}) OR regexp_matches({x}, {_lit(_I.WHY)}) THEN 'task' WHEN regexp_matches({x}, {_lit(_I.QUESTION)}) THEN 'knowledge' ELSE 'task' END"


@query(f"WITH q AS (SELECT 'task' AS source, coalesce(prompt, '') AS x FROM tasks UNION ALL SELECT 'document', coalesce(text, '') FROM documents) SELECT source, {_INTENT('x')} AS intent, count(*) AS n FROM q GROUP BY ALL")
def intent_class(spark, sf_dir):
    """Intents of task prompts and documents."""
    d = table(spark, sf_dir, "tasks").select(F.lit("task").alias("source"), F.col("prompt").alias("x")).unionByName(table(spark, sf_dir, "documents").select(F.lit("document").alias("source"), F.col("text").alias("x")))
    return d.groupBy("source", text.intent(F.col("x")).alias("intent")).agg(F.count("*").alias("n"))


_TELL = f"regexp_matches(x, {_lit(text.ERROR_LINE)}) OR regexp_matches(x, {_lit(text.ERROR_ID)})"


@query(
    rf"""WITH {CALLS}, c AS (SELECT id, step_pos, call_pos, list_filter(list_transform(string_split(regexp_replace(regexp_replace(error, '\b[0-9a-f]{{7,40}}\b', ' ', 'g'), '(?:/[\w.\-]+)+/([\w.\-]+)', '\1', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM ca WHERE error <> ''),
k AS (SELECT *, list_filter(lines, lambda x: {_TELL}) AS kept FROM c),
m AS (SELECT *, CASE WHEN len(lines) = 0 OR list_contains(kept, lines[-1]) THEN kept ELSE list_append(kept, lines[-1]) END AS a FROM k)
SELECT id, step_pos::INTEGER AS step_pos, call_pos::INTEGER AS call_pos, right(array_to_string(list_slice(a, greatest(len(a) - 7, 1), len(a)), chr(10)), 900) AS signature FROM m"""
)
def error_signature(spark, sf_dir):
    """The informative part of each error of a tool call."""
    return traces.calls_of(_traces(spark, sf_dir)).where("error <> ''").select("id", "step_pos", "call_pos", text.error_signature(F.col("error")).alias("signature"))


@query(f"WITH {LESSONS}, w AS (SELECT id, list_filter(string_split(regexp_replace(lower(coalesce(rule, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS f FROM le), k AS (SELECT id, CASE WHEN len(list_filter(f, lambda w: NOT list_contains({_q(text.SLUG_STOP)}, w))) > 0 THEN list_filter(f, lambda w: NOT list_contains({_q(text.SLUG_STOP)}, w)) ELSE f END AS f FROM w) SELECT id, coalesce(nullif(trim(left(array_to_string(f[1:4], '-'), 40), '-'), ''), 'skill') AS slug FROM k")
def lesson_slugs(spark, sf_dir):
    """A short name for each lesson."""
    return _lessons(spark, sf_dir).select("id", text.slug(F.col("rule")).alias("slug"))


# ---- bullets

_HEAD = "CASE WHEN lower(h) IN ('preconditions', 'procedure', 'verification', 'failure modes', 'scope limits') THEN lower(h) ELSE 'procedure' END"
BULLETS = rf"""{SKILLS}, ln AS (SELECT name, unnest(string_split(coalesce(body, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(body, ''), chr(10)), 1) - 1 AS pos FROM ls),
hd AS (SELECT *, CASE WHEN regexp_matches(line, '^##\s+(.*)$') AND trim(regexp_extract(line, '^##\s+(.*)$', 1)) <> '' THEN trim(regexp_extract(line, '^##\s+(.*)$', 1)) END AS h0 FROM ln),
se AS (SELECT *, last_value(h0 IGNORE NULLS) OVER (PARTITION BY name ORDER BY pos ROWS UNBOUNDED PRECEDING) AS h FROM hd),
it AS (SELECT name, pos, {_HEAD} AS section, trim(regexp_extract(line, '^\s*(?:[-*]|\d+\.)\s+(.*)$', 1)) AS t FROM se WHERE regexp_matches(line, '^\s*(?:[-*]|\d+\.)\s+(.*)$')),
bu AS (SELECT name, pos::INTEGER AS pos, section, nullif(regexp_extract(t, '^\[(b-[0-9a-f]{{6}})\]', 1), '') AS bullet, trim(regexp_replace(t, '^\[b-[0-9a-f]{{6}}\]\s*', '')) AS content FROM it WHERE t <> '')"""


@query(f"WITH {BULLETS} SELECT * FROM bu")
def body_bullets(spark, sf_dir):
    """Bullets of skill bodies."""
    return playbook.bullets(_skills(spark, sf_dir))


@query(f"WITH {BULLETS} SELECT name, (5 - count(DISTINCT section))::BIGINT AS missing, coalesce(bool_or(section = 'verification' AND (contains(content, '`') OR regexp_matches(content, {_lit(playbook.OBSERVABLE)}))), false) AS concrete FROM bu GROUP BY name")
def body_shape(spark, sf_dir):
    """Sections that each body lacks, and whether its verification names something concrete."""
    return playbook.shape(playbook.bullets(_skills(spark, sf_dir))).select("name", F.size("missing").cast("bigint").alias("missing"), "concrete")


_TOK = lambda x: f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]{{3,}}'))"


@query(f"WITH {BULLETS}, t AS (SELECT name, section, pos, {_TOK('content')} AS t FROM bu) SELECT a.name, a.section, a.pos, b.pos AS other FROM t a JOIN t b ON a.name = b.name AND a.section = b.section AND a.pos < b.pos WHERE least(len(a.t), len(b.t)) > 0 AND len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)) >= 0.85")
def bullet_duplicates(spark, sf_dir):
    """Pairs of near-equal bullets within a section of a skill."""
    return playbook.duplicates(playbook.bullets(_skills(spark, sf_dir)))


@query("WITH x AS (SELECT DISTINCT id, bullets_helpful AS h, bullets_harmful AS m FROM traces WHERE id IS NOT NULL), u AS (SELECT unnest(h) AS bullet, 1 AS a, 0 AS b FROM x UNION ALL SELECT unnest(m), 0, 1 FROM x) SELECT bullet, sum(a)::BIGINT AS helpful, sum(b)::BIGINT AS harmful FROM u WHERE bullet IS NOT NULL GROUP BY bullet")
def bullet_feedback(spark, sf_dir):
    """Helpful and harmful reports of each bullet."""
    return playbook.feedback(_traces(spark, sf_dir).where("id is not null").select("id", "bullets_helpful", "bullets_harmful").distinct())


_ALIKE = "least(len(k.t), len(x[1].t)) > 0 AND len(list_intersect(k.t, x[1].t)) / least(len(k.t), len(x[1].t)) >= 0.85"


@query(f"""WITH {BULLETS}, tr AS (SELECT DISTINCT id, bullets_helpful AS h, bullets_harmful AS m FROM traces WHERE id IS NOT NULL), fb AS (SELECT bullet, sum(a)::BIGINT AS helpful, sum(b)::BIGINT AS harmful FROM (SELECT unnest(h) AS bullet, 1 AS a, 0 AS b FROM tr UNION ALL SELECT unnest(m), 0, 1 FROM tr) GROUP BY bullet),
rows AS (SELECT name, pos, section, content, coalesce(helpful, 0) AS helpful, coalesce(harmful, 0) AS harmful, {_TOK('content')} AS t FROM bu LEFT JOIN fb USING (bullet)),
li AS (SELECT name, list([{{'pos': pos, 'section': section, 'content': content, 'helpful': helpful, 'harmful': harmful, 't': t}}] ORDER BY pos) AS l FROM rows WHERE NOT (harmful >= 3 AND harmful > helpful) GROUP BY name),
fo AS (SELECT name, list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.section = x[1].section AND {_ALIKE})) > 0
  THEN list_transform(acc, lambda k, i: {{'pos': k.pos, 'section': k.section, 'content': k.content, 'helpful': k.helpful + CASE WHEN i = list_position(list_transform(acc, lambda k: k.section = x[1].section AND {_ALIKE}), true) THEN x[1].helpful ELSE 0 END, 'harmful': k.harmful + CASE WHEN i = list_position(list_transform(acc, lambda k: k.section = x[1].section AND {_ALIKE}), true) THEN x[1].harmful ELSE 0 END, 't': k.t}})
  ELSE list_concat(acc, x) END) AS kept FROM li),
un AS (SELECT name, unnest(kept) AS k FROM fo), ra AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k.section IN ('verification', 'scope limits') DESC, k.helpful - k.harmful DESC, k.pos DESC) AS place FROM un)
SELECT name, k.pos AS pos, k.section AS section, k.content AS content, k.helpful AS helpful, k.harmful AS harmful FROM ra WHERE place <= 60""")
def refined_bullets(spark, sf_dir):
    """Bullets of every skill after pruning, merging and capping."""
    b = playbook.bullets(_skills(spark, sf_dir))
    f = bullet_feedback(spark, sf_dir)
    return playbook.refine(b.join(f, "bullet", "left").select("name", "pos", "section", "content", F.coalesce("helpful", F.lit(0)).alias("helpful"), F.coalesce("harmful", F.lit(0)).alias("harmful")))


@query(f"""WITH {BULLETS}, {LESSONS}, tt AS (SELECT name, section, pos, {_TOK('content')} AS t FROM bu), op AS (SELECT skill_ref AS name, row_number() OVER (PARTITION BY skill_ref ORDER BY ts, id) AS seq, trim(coalesce(rule, '')) AS content FROM le WHERE skill_ref IS NOT NULL),
st AS (SELECT name, list({{'s': section, 'c': '', 't': t, 'n': 0}} ORDER BY pos) AS l FROM tt GROUP BY name), oo AS (SELECT name, list([{{'s': 'procedure', 'c': content, 't': {_TOK('content')}, 'n': 1}}] ORDER BY seq) AS o, count(*) AS n FROM op WHERE content <> '' GROUP BY name),
j AS (SELECT name, coalesce(l, []) AS l, o, coalesce(oo.n, 0) AS n FROM st FULL JOIN (SELECT DISTINCT name FROM op) USING (name) LEFT JOIN oo USING (name)),
f AS (SELECT name, n, len(l) AS had, CASE WHEN o IS NULL THEN l ELSE list_reduce(list_concat([l], o), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.s = 'procedure' AND {_ALIKE})) > 0 THEN acc ELSE list_concat(acc, x) END) END AS r FROM j)
SELECT name, len(r)::INTEGER AS bullets, (len(r) - had)::INTEGER AS added, (n - (len(r) - had))::INTEGER AS deduped FROM f""")
def delta_applied(spark, sf_dir):
    """Each skill's bullets after its lessons were added in order of time: how many there are, were added, or were there already."""
    rules = _lessons(spark, sf_dir).where("skill_ref is not null").select(F.col("skill_ref").alias("name"), F.row_number().over(Window.partitionBy("skill_ref").orderBy("ts", "id")).alias("seq"), F.lit("ADD").alias("type"), F.lit(None).cast("string").alias("bullet"), F.lit("procedure").alias("section"), F.col("rule").alias("content"))
    return playbook.apply_delta(playbook.bullets(_skills(spark, sf_dir)), rules).select("name", F.size("bullets").alias("bullets"), "added", "deduped")


_LONG = "list_distinct(list_filter(string_split_regex(lower(coalesce(description, '')), '\\s+'), lambda w: len(w) > 5))"


@query(f"WITH {SKILLS}, d AS (SELECT name, list_sort({_LONG}) AS w FROM ls), c AS (SELECT w, min(name) AS rep FROM d WHERE len(w) > 0 GROUP BY w) SELECT a.rep AS a, b.rep AS b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 9)::DOUBLE AS jaccard FROM c a JOIN c b ON a.rep < b.rep WHERE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) > 0.6 UNION ALL SELECT rep, name, 1.0 FROM d JOIN c USING (w) WHERE rep < name")
def near_descriptions(spark, sf_dir):
    """Skills with nearly the same long words in their descriptions."""
    return playbook.near_descriptions(_skills(spark, sf_dir)).withColumn("jaccard", F.round("jaccard", 9))


# ---- retrieval

_J = lambda c: f"array_to_string(coalesce({c}, []), ' ')"
PROFILE = f"""{SKILLS}, lib AS (SELECT * FROM ls WHERE status IN ('active', 'candidate')),
pf AS (SELECT name, 3 AS w, unnest({FACET("replace(name, '-', ' ')")}) AS term FROM lib UNION ALL SELECT name, 3, unnest({FACET(_J('applies_when'))}) FROM lib UNION ALL SELECT name, 2, unnest({FACET(_J('queries'))}) FROM lib UNION ALL SELECT name, 2, unnest({FACET(_J('symptoms'))}) FROM lib UNION ALL SELECT name, 1, unnest({FACET('description')}) FROM lib),
px AS (SELECT name, term, max(w)::INTEGER AS weight FROM pf GROUP BY ALL)"""


@query(f"WITH {PROFILE} SELECT * FROM px")
def profile_weights(spark, sf_dir):
    """The term index of retrievable skills."""
    return retrieval.profiles(_skills(spark, sf_dir).where(F.col("status").isin(*retrieval.RETRIEVABLE)))


_asked = lambda s, d: table(s, d, "eval_items").select(F.col("item_id").alias("qid"), "text")


@query(f"""WITH {PROFILE}, n AS (SELECT count(*) AS n FROM lib), ix AS (SELECT term, ln(1 + any_value(n) / count(*)) AS idf FROM px, n GROUP BY term), mx AS (SELECT max(idf) AS most FROM ix),
qa AS (SELECT item_id AS qid, text, {FACET('text')} AS terms, {QUERY('text')} AS words, {_INTENT("coalesce(text, '')")} AS intent FROM eval_items WHERE item_id IS NOT NULL),
q AS (SELECT * FROM qa WHERE len(terms) > 0 AND intent NOT IN ('knowledge', 'creative')),
qt AS (SELECT qid, unnest(terms) AS term FROM q),
ma AS (SELECT qid, sum(coalesce(idf, most, 1.0)) AS q_mass FROM qt LEFT JOIN ix USING (term), mx GROUP BY qid),
hi AS (SELECT qid, name, count(*) AS hits, sum(idf * weight) AS mass, count(*) FILTER (WHERE weight >= 3) AS anchored, min(term) AS one FROM qt JOIN px USING (term) JOIN ix USING (term) GROUP BY ALL),
an AS (SELECT name, count(*) AS anchors, list(term) AS anchor_terms FROM px WHERE weight >= 3 GROUP BY name),
ph AS (SELECT name, {QUERY('p')} AS pt FROM (SELECT name, unnest(queries) AS p FROM lib)),
bp AS (SELECT qid, name, max(len(list_intersect(pt, words)) / len(pt)) AS phrase FROM q, ph WHERE len(pt) >= 2 AND (len(list_intersect(pt, words)) >= 2 OR len(list_intersect(pt, words)) / len(pt) >= 0.6) GROUP BY ALL),
fa AS (SELECT coalesce(hi.qid, bp.qid) AS qid, coalesce(hi.name, bp.name) AS name, coalesce(hits, 0) AS n, mass, coalesce(anchored, 0) AS anchored, one, coalesce(phrase, 0.0) AS phrase FROM hi FULL JOIN bp ON hi.qid = bp.qid AND hi.name = bp.name),
fb AS (SELECT fa.*, q.text, q.terms, q.intent, ma.q_mass, coalesce(an.anchors, 0) AS anchors, coalesce(an.anchor_terms, []) AS anchor_terms, lib.not_for, lib.applies_when FROM fa JOIN q USING (qid) JOIN ma USING (qid) JOIN lib USING (name) LEFT JOIN an USING (name)),
fc AS (SELECT * FROM fb WHERE (n > 0 OR phrase >= 0.3)
  AND NOT (n = 1 AND phrase < 0.3 AND len(terms) >= 3 AND NOT (regexp_matches(one, '[_.0-9]') OR (anchored > 0 AND (regexp_matches(text, {_lit(text.ERROR_ID)}) OR regexp_matches(text, {_lit(text.PROBLEM)})))))
  AND NOT (phrase < 0.3 AND anchors > 0 AND anchored = 0)
  AND NOT len(list_intersect(list_filter({FACET(_J('not_for'))}, lambda x: NOT list_contains(anchor_terms, x)), terms)) > 0
  AND (intent <> 'create' OR regexp_matches(concat_ws(' ', replace(name, '-', ' '), array_to_string(applies_when, ' ')), {_lit(retrieval.AUTHORING)}))),
sc AS (SELECT qid, name, n + CASE WHEN phrase >= 0.3 THEN 2 ELSE 0 END AS weight, greatest(CASE WHEN n > 0 THEN mass / (q_mass * 3.0 * pow(greatest(1.0, anchors / 4.0), 0.25)) ELSE 0.0 END, phrase) AS score FROM fc),
ra AS (SELECT *, first_value(score) OVER (PARTITION BY qid ORDER BY weight DESC, round(score, 9) DESC, name) AS first FROM sc WHERE score >= 0.08),
rb AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, round(score, 9) DESC, name) AS rank, name, score FROM ra WHERE score >= first * 0.55)
SELECT qid, rank::INTEGER AS rank, name, round(score, 6)::DOUBLE AS score FROM rb WHERE rank <= 3""")
def coverage_topk(spark, sf_dir):
    """The skills that cover each evaluation text, with abstention: the ranked recall."""
    return retrieval.coverage(_asked(spark, sf_dir), table(spark, sf_dir, "skills")).withColumn("score", F.round("score", 6))


@query()
def error_recall(spark, sf_dir):
    """Skills for the error signatures of traces whose id (its last 8 hex digits) is divisible by 20 (see tests)."""
    e = traces.calls_of(_traces(spark, sf_dir)).where("error <> ''").where(F.conv(F.right("id", F.lit(8)), 16, 10).cast("bigint") % 20 == 0)
    asked = e.select(text.error_signature(F.col("error")).alias("text")).distinct().select(F.xxhash64("text").alias("qid"), "text")
    return retrieval.coverage(asked, table(spark, sf_dir, "skills"), error=True)


_BW = " UNION ALL ".join(f"SELECT name, {w} AS w, unnest(regexp_extract_all(lower(coalesce({_J('queries') if c == 'queries' else c}, '')), '[a-z0-9_]{{3,}}')  ) AS term FROM ls WHERE status IN ('active', 'candidate')" for c, w in retrieval.BM25_WEIGHTS.items())


@query(f"""WITH {SKILLS}, te AS ({_BW}), tf AS (SELECT name, term, sum(w) AS tf FROM te GROUP BY ALL), sz AS (SELECT name, sum(tf) AS len FROM tf GROUP BY name), sh AS (SELECT avg(len) AS mean, count(*) AS n FROM sz), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id AS qid, unnest(list_distinct((list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{{3,}}'), lambda w: NOT list_contains({_q('the and for with this that from into how can you please using'.split())}, w)))[1:20])) AS term FROM eval_items),
s AS (SELECT qid, name, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN sz USING (name), sh GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, name) AS rank FROM s) SELECT qid, rank::INTEGER AS rank, name, round(score, 6)::DOUBLE AS score FROM r WHERE rank <= 5""")
def bm25_topk(spark, sf_dir):
    """The five best skills for each evaluation text by weighted BM25."""
    return retrieval.bm25(_asked(spark, sf_dir), table(spark, sf_dir, "skills")).withColumn("score", F.round("score", 6))


_COS = "WITH c AS (SELECT a.vec_id AS qid, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cosine FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(cosine, 9) DESC, id) AS rank FROM c WHERE cosine >= 0.2 - 1e-12)"


@query(f"{_COS} SELECT qid, rank::INTEGER AS rank, id, round(cosine, 6)::DOUBLE AS cosine FROM r WHERE rank <= 10")
def cosine_topk(spark, sf_dir):
    """The ten nearest of all vectors for every vector whose id is divisible by 20."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieval.cosine_topk(v.where("id % 20 = 0").withColumnRenamed("id", "qid"), v, 10, 0.2).withColumn("cosine", F.round("cosine", 6))


@query(f"{_COS}, v AS (SELECT qid, id, cosine FROM r WHERE rank <= 10), t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS t FROM documents WHERE text IS NOT NULL), l AS (SELECT v.qid, v.id, CASE WHEN least(len(a.t), len(b.t)) > 0 THEN len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)) ELSE 0.0 END AS score FROM v JOIN t a ON a.doc_id = v.qid JOIN t b ON b.doc_id = v.id), f AS (SELECT qid, id, 0.5 * least(1.0, coalesce(score, 0.0)) + 0.5 * coalesce(cosine, 0.0) AS fused FROM v LEFT JOIN l USING (qid, id)), g AS (SELECT *, first_value(fused) OVER (PARTITION BY qid ORDER BY round(fused, 9) DESC, id) AS best FROM f), h AS (SELECT qid, id, fused, row_number() OVER (PARTITION BY qid ORDER BY round(fused, 9) DESC, id) AS rank FROM g WHERE fused >= best * 0.55) SELECT qid, rank::INTEGER AS rank, id, round(fused, 6)::DOUBLE AS score FROM h WHERE rank <= 3")
def hybrid_fusion(spark, sf_dir):
    """Vector neighbours fused with the overlap of the documents of the same ids."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    near = retrieval.cosine_topk(v.where("id % 20 = 0").withColumnRenamed("id", "qid"), v, 10, 0.2).select("qid", "id", "cosine")
    t = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.token_set(F.col("text")).alias("t"))
    lex = near.join(t.select(F.col("doc_id").alias("qid"), F.col("t").alias("a")), "qid").join(t.select(F.col("doc_id").alias("id"), F.col("t").alias("b")), "id").select("qid", "id", text.overlap_coefficient(F.col("a"), F.col("b")).alias("score"))
    return retrieval.hybrid(lex, near).withColumn("score", F.round("score", 6))


_DW = f"list_filter(list_distinct(list_filter(list_transform(string_split_regex(lower(concat_ws(' ', array_to_string(coalesce(triggers, []), ' '), rule)), '[ \\n\\t\\r]+'), lambda w: trim(w, '.,:;()')), lambda w: len(w) > 3)), lambda w: NOT list_contains({_q(text.GENERIC)}, w))"


@query(f"WITH {LESSONS}, w AS (SELECT id, ts, coalesce(generalizable, false) AS g, {_DW} AS w FROM le), p AS (SELECT a.id AS qid, b.id, b.ts, len(list_intersect(a.w, b.w)) AS shared FROM w a JOIN w b ON a.id <> b.id AND b.g WHERE ('0x' || right(a.id, 8))::BIGINT % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ts DESC NULLS LAST, id) AS rank FROM p WHERE shared >= 3) SELECT qid, rank::INTEGER AS rank, id, shared::INTEGER AS shared FROM r WHERE rank <= 4")
def related_lessons(spark, sf_dir):
    """For every lesson whose id (its last 8 hex digits) is divisible by 20, the newest four that share three words."""
    d = _lessons(spark, sf_dir).select("id", "ts", F.coalesce("generalizable", F.lit(False)).alias("generalizable"), text.distinctive_words(F.col("triggers"), F.col("rule")).alias("words"))
    return retrieval.related_lessons(d.where(F.conv(F.right("id", F.lit(8)), 16, 10).cast("bigint") % 20 == 0), d)


_SP = lambda x, drop=(): f"list_distinct(list_filter(string_split_regex(lower(coalesce({x}, '')), '[^a-z0-9_]+'), lambda w: w <> '' AND NOT list_contains({_q(drop)}::VARCHAR[], w)))"
_KW = _SP("k", retrieval.KEYWORD_DROP)


@query(f"""WITH c AS (SELECT subject AS chunk, replace(subject, '_', ' ') AS title, split_part(about, ',', 1) AS category, list_transform(string_split(about, ','), lambda x: trim(x)) AS keywords FROM subjects),
q AS (SELECT item_id AS qid, text, {_SP('text', retrieval.QUERY_DROP)} AS tokens FROM eval_items),
s AS (SELECT qid, chunk, 3 * len(list_intersect({_SP('title')}, tokens)) + 2 * len(list_intersect({_SP('category')}, tokens)) + list_sum(list_transform(keywords, lambda k: CASE WHEN k <> '' AND contains(lower(text), lower(k)) THEN 2 ELSE 0 END + CASE WHEN len({_KW}) > 1 AND len(list_intersect({_KW}, tokens)) >= greatest(1, len({_KW}) - 1) THEN 1 ELSE 0 END)) AS score FROM q, c),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk) AS rank FROM s WHERE score > 0),
f AS (SELECT chunk, row_number() OVER (ORDER BY chunk) AS rank FROM c)
SELECT qid, rank::INTEGER AS rank, chunk, score::INTEGER AS score FROM r WHERE rank <= 6 UNION ALL SELECT qid, f.rank::INTEGER, f.chunk, 0 FROM q, f WHERE f.rank <= 3 AND qid NOT IN (SELECT qid FROM r)""")
def chunk_topk(spark, sf_dir):
    """The best subject descriptions for each evaluation text by keyword scores, or the first three."""
    about = table(spark, sf_dir, "subjects")
    chunks = about.select(F.col("subject").alias("chunk"), F.regexp_replace("subject", "_", " ").alias("title"), F.split_part("about", F.lit(","), F.lit(1)).alias("category"), F.transform(F.split("about", ","), lambda x: F.trim(x)).alias("keywords"))
    return retrieval.chunk_topk(_asked(spark, sf_dir), chunks)


# ---- lifecycle


@query(f"WITH {SKILLS} SELECT name, status, CASE WHEN coalesce(uses, 0) > 0 THEN round(successes / uses, 9) ELSE 0.0 END::DOUBLE AS hit_rate, CASE WHEN coalesce(recalls, 0) > 0 THEN round(coalesce(uses, 0) / recalls, 9) ELSE 0.0 END::DOUBLE AS trigger_precision FROM ls")
def skill_rates(spark, sf_dir):
    """Hit rate and trigger precision of each skill; 0 where undefined."""
    share = lambda a, b: F.when(F.coalesce(b, F.lit(0)) > 0, F.round(F.coalesce(F.col(a), F.lit(0)) / F.col(b), 9)).otherwise(0.0)
    return _skills(spark, sf_dir).select("name", "status", share("successes", "uses").alias("hit_rate"), share("uses", "recalls").alias("trigger_precision"))


@query(f"WITH {LESSONS}, r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts DESC NULLS LAST, id) AS nth FROM le WHERE trace_id IS NOT NULL) SELECT trace_id, id, outcome FROM r WHERE nth = 1")
def lesson_for_trace(spark, sf_dir):
    """The newest lesson of each trace."""
    w = Window.partitionBy("trace_id").orderBy(F.desc_nulls_last("ts"), "id")
    return _lessons(spark, sf_dir).where("trace_id is not null").withColumn("nth", F.row_number().over(w)).where("nth = 1").select("trace_id", "id", "outcome")


@query()
def sanitized_traces(spark, sf_dir):
    """Traces after redaction and caps: what was redacted, cut and dropped, and the length of the JSON of the steps (an
    ordered cap over whole traces, arguments walked as JSON: see tests)."""
    d = sanitize.sanitize(_traces(spark, sf_dir).where("id is not null"))
    return d.select("id", "redacted", "truncated", "steps_dropped", F.length(F.to_json("steps")).alias("chars"), F.md5(F.to_json(F.struct("task", "steps"))).alias("digest")).distinct()


@query(f"""WITH RECURSIVE {OUTCOME}, {SKILLS}, u AS (SELECT DISTINCT unnest(skills_used) AS name, ts, id, outcome FROM oc), o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts, id) AS k FROM u WHERE name IN (SELECT name FROM ls) AND ts IS NOT NULL),
f AS (SELECT name, 0::BIGINT AS k, coalesce(uses, 0)::BIGINT AS uses, coalesce(successes, 0)::BIGINT AS successes, coalesce(failures, 0)::BIGINT AS failures, status FROM ls WHERE name IN (SELECT name FROM o) UNION ALL
 SELECT name, k, uses, successes, failures, CASE WHEN s1 = 'active' AND uses >= 4 AND successes / uses < 0.4 THEN 'quarantine' ELSE s1 END FROM (SELECT f.name, o.k, f.uses + 1 AS uses, f.successes + (o.outcome = 'success')::BIGINT AS successes, f.failures + (o.outcome = 'failure')::BIGINT AS failures, CASE WHEN f.status = 'candidate' AND f.successes + (o.outcome = 'success')::BIGINT >= 1 THEN 'active' ELSE f.status END AS s1 FROM f JOIN o ON o.name = f.name AND o.k = f.k + 1))
SELECT name, uses, successes, failures, status FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k DESC) AS r FROM f) WHERE r = 1""")
def usage_fold(spark, sf_dir):
    """Counters and status of each used skill of the library after replaying all traces in order; all count as cleared."""
    u = _outcomes(spark, sf_dir).select(F.explode("skills_used").alias("name"), "ts", "id", "outcome").distinct()
    return lifecycle.usage_fold(u, _skills(spark, sf_dir).withColumn("cleared", F.lit(True)))


_NOW = 1775000000.0


_CURATE = lambda most: f"WITH {SKILLS}, a AS (SELECT name, uses, coalesce(CASE WHEN uses > 0 THEN successes / uses END, 0.0) AS rate, coalesce(({_NOW} - CASE WHEN coalesce(last_used, 0) > 0 THEN last_used ELSE created END) / 86400 > 60, false) AND coalesce(uses, 0) = 0 AS old FROM ls WHERE status = 'active'), r AS (SELECT *, row_number() OVER (ORDER BY rate DESC, uses DESC NULLS LAST, name DESC) AS place FROM a WHERE NOT old) SELECT name, 'retire' AS action FROM a WHERE old UNION ALL SELECT name, 'quarantine' FROM r WHERE place > {most}"


@query(_CURATE(lifecycle.MAX_ACTIVE))
def curated(spark, sf_dir):
    """Active skills to retire as of a fixed day, or to quarantine beyond the 200 best (the library's cap)."""
    return lifecycle.curate(_skills(spark, sf_dir), F.lit(_NOW))


@query(_CURATE(60))
def curated_small(spark, sf_dir):
    """The same for a library of at most 60 active skills, so that the cap acts on small tables as well."""
    return lifecycle.curate(_skills(spark, sf_dir), F.lit(_NOW), 60)


@query("SELECT name, array_to_string(list_sort(list(DISTINCT version)), ',') AS versions, max(version) AS latest, max(version) + 1 AS next FROM skills WHERE name IS NOT NULL AND version IS NOT NULL GROUP BY name")
def skill_versions(spark, sf_dir):
    """Versions of each skill, and the one that a rollback would write."""
    return lifecycle.versions(table(spark, sf_dir, "skills")).withColumn("versions", F.array_join(F.transform("versions", lambda v: v.cast("string")), ","))


@query("WITH d AS (SELECT DISTINCT id, agent, received FROM traces WHERE id IS NOT NULL) SELECT id, agent, row_number() OVER w AS version, received AS valid_from, lead(received) OVER w AS valid_to, lead(received) OVER w IS NULL AS current FROM d WINDOW w AS (PARTITION BY id ORDER BY received, agent)")
def deliveries_scd2(spark, sf_dir):
    """Deliveries of traces as versions with validity."""
    d = _traces(spark, sf_dir).where("id is not null").select("id", "agent", "received").distinct()
    return lifecycle.scd2(d, "id", "received", ["agent"]).select("id", "agent", "version", "valid_from", "valid_to", "current")


@query(f"WITH {CALLS}, {LESSONS}, fe AS (SELECT DISTINCT id, step_pos FROM ca WHERE error <> ''), ev AS (SELECT id, trace_id, unnest(evidence_steps) AS step FROM le), ci AS (SELECT DISTINCT ev.id FROM ev JOIN fe ON fe.id = ev.trace_id AND fe.step_pos = ev.step), f AS (SELECT le.id, ci.id IS NOT NULL AS cited, CASE WHEN coalesce(len(evidence_steps), 0) = 0 AND coalesce(outcome <> 'success', true) AND NOT starts_with(lower(trim(coalesce(root_cause, ''))), 'undetermined') THEN least(coalesce(confidence, 0.0), 0.35) ELSE coalesce(confidence, 0.0) END AS c FROM le LEFT JOIN ci USING (id)) SELECT id, cited, round(CASE WHEN cited THEN least(c, 0.75) ELSE c END, 9)::DOUBLE AS cap FROM f")
def lesson_grounding(spark, sf_dir):
    """Whether lessons cite a failed step, and the confidence that is left to them."""
    return lifecycle.grounding(_lessons(spark, sf_dir), traces.calls_of(_traces(spark, sf_dir))).withColumn("cap", F.round("cap", 9))


_PROBE = "concat_ws(' ', array_to_string(coalesce(triggers, []), ' '), coalesce(rule, ''))"
DUPLICATES = f"""pr AS (SELECT id, {FACET(_PROBE)} AS terms, {QUERY(_PROBE)} AS words FROM le),
fs AS (SELECT name, {FACET("concat_ws(' ', replace(name, '-', ' '), array_to_string(coalesce(applies_when, []), ' '))")} AS anchors, queries FROM ls),
fq AS (SELECT name, {QUERY('p')} AS pt FROM (SELECT name, unnest(queries) AS p FROM fs)),
pp AS (SELECT id, name, max(len(list_intersect(pt, words)) / len(pt)) AS phrase FROM pr, fq WHERE len(pt) >= 2 AND (len(list_intersect(pt, words)) >= 2 OR len(list_intersect(pt, words)) / len(pt) >= 0.6) GROUP BY ALL),
du AS (SELECT id, name, greatest(len(list_intersect(anchors, terms)) / len(anchors), coalesce(phrase, 0.0)) AS score FROM pr JOIN fs ON list_has_any(anchors, terms) LEFT JOIN pp USING (id, name)),
dd AS (SELECT id, name, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, name) AS nth FROM du WHERE score >= 0.75) WHERE nth = 1)"""


@query(f"WITH {SKILLS}, {LESSONS}, {DUPLICATES} SELECT id, name, round(score, 6)::DOUBLE AS score FROM dd")
def lesson_duplicates(spark, sf_dir):
    """The skill that covers each lesson's situation already."""
    return retrieval.duplicates_of(_lessons(spark, sf_dir), _skills(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"""WITH {OUTCOME}, {SKILLS}, {LESSONS}, {DUPLICATES}, w AS (SELECT id, coalesce(generalizable, false) AS g, {_DW} AS w FROM le), re AS (SELECT DISTINCT a.id FROM w a JOIN w b ON a.id <> b.id AND b.g AND len(list_intersect(a.w, b.w)) >= 3),
sz AS (SELECT count(*) FILTER (WHERE status IN ('active', 'candidate')) AS size FROM ls), tr AS (SELECT DISTINCT unnest(skills_used) AS name FROM oc WHERE eval_id IS NOT NULL),
x AS (SELECT le.*, oc.id AS tid, oc.eval_id, oc.calls, oc.outcome AS o, CASE WHEN bl.name IS NOT NULL THEN bl.name ELSE dd.name END AS name, sz.size FROM le LEFT JOIN oc ON oc.id = le.trace_id LEFT JOIN ls bl ON bl.name = le.skill_ref AND le.blame IN ('skill_wrong', 'skill_incomplete', 'skill_misapplied') LEFT JOIN dd ON dd.id = le.id, sz),
y AS (SELECT x.*, ls.status, coalesce(list_contains(ls.provenance, x.trace_id), false) AS mine, tr.name IS NOT NULL AS tried, re.id IS NOT NULL AS related FROM x LEFT JOIN ls ON ls.name = x.name LEFT JOIN tr ON tr.name = x.name LEFT JOIN re ON re.id = x.id)
SELECT id, name, CASE WHEN tid IS NULL THEN 'orphan' WHEN eval_id IS NOT NULL THEN 'eval run' WHEN calls < 2 AND o <> 'failure' THEN 'trivial' WHEN o = 'unknown' THEN 'unknown outcome' WHEN NOT coalesce(generalizable, false) THEN 'not general' WHEN coalesce(confidence, 0.0) < CASE WHEN size < 12 THEN 0.3 ELSE 0.4 END THEN 'low confidence'
 WHEN mine AND status IN ('active', 'candidate') THEN 'contributed' WHEN mine AND status = 'quarantine' AND NOT tried THEN 'resume' WHEN name IS NULL AND NOT related AND coalesce(confidence, 0.0) < CASE WHEN size < 12 THEN 0.5 ELSE 0.8 END THEN 'single evidence' WHEN name IS NOT NULL THEN 'patch' ELSE 'create' END AS decision FROM y""")
def lesson_decisions(spark, sf_dir):
    """What each lesson leads to, and the skill it is about."""
    o, lessons, skills = _outcomes(spark, sf_dir), _lessons(spark, sf_dir), _skills(spark, sf_dir)
    d = lessons.select("id", "ts", F.coalesce("generalizable", F.lit(False)).alias("generalizable"), text.distinctive_words(F.col("triggers"), F.col("rule")).alias("words"))
    related = retrieval.related_lessons(d, d, 1).select(F.col("qid").alias("id"))
    tried = o.where("eval_id is not null").select(F.explode("skills_used").alias("name"))
    return lifecycle.decisions(lessons, o.select(F.col("id").alias("trace_id"), "eval_id", "calls", F.col("outcome").alias("trace_outcome")), skills, retrieval.duplicates_of(lessons, skills), related, tried)


@query(f"WITH {LESSONS} SELECT skill_ref AS name, count(DISTINCT id) AS lessons, count(DISTINCT trace_id) AS traces, count(DISTINCT id) < 2 AS provisional FROM le WHERE skill_ref IS NOT NULL GROUP BY skill_ref")
def evidence_union(spark, sf_dir):
    """Lessons and traces behind each skill."""
    return lifecycle.evidence(_lessons(spark, sf_dir))


@query(f"WITH {LESSONS}, x AS (SELECT skill_ref AS name, ts, id, rule, coalesce(sum(len(rule) + 2) OVER (PARTITION BY skill_ref ORDER BY ts DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after FROM le WHERE skill_ref IS NOT NULL AND rule IS NOT NULL) SELECT name, right(string_agg(rule, chr(10) || chr(10) ORDER BY ts, id), 8000) AS context FROM x WHERE after < 8000 GROUP BY name")
def skill_context(spark, sf_dir):
    """The last 8000 characters of the rules behind each skill, in order of time."""
    d = _lessons(spark, sf_dir).withColumnRenamed("skill_ref", "name")
    return lifecycle.context_tail(d, "name", ["ts", "id"], "rule")


@query(f"WITH {LESSONS} SELECT le.id, le.trace_id FROM le WHERE trace_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM traces t WHERE t.id = le.trace_id)")
def orphan_lessons(spark, sf_dir):
    """Lessons whose trace was purged."""
    return _lessons(spark, sf_dir).where("trace_id is not null").join(_traces(spark, sf_dir).select(F.col("id").alias("trace_id")), "trace_id", "left_anti").select("id", "trace_id")


@query(f"WITH {SKILLS}, {LESSONS} SELECT 'skills ' || coalesce(status, 'none') AS what, count(*) AS n FROM ls GROUP BY status UNION ALL SELECT 'lessons', count(*) FROM le UNION ALL SELECT 'traces', count(DISTINCT id) FROM traces UNION ALL SELECT 'tasks', count(DISTINCT id) FROM tasks")
def library_stats(spark, sf_dir):
    """Counts of skills by status, lessons, traces and tasks."""
    of = lambda what, d: d.select(F.lit(what).alias("what"), F.col("n"))
    s = _skills(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n")).select(F.concat(F.lit("skills "), F.coalesce("status", F.lit("none"))).alias("what"), "n")
    return s.unionByName(of("lessons", _lessons(spark, sf_dir).agg(F.count("*").alias("n")))).unionByName(of("traces", _traces(spark, sf_dir).agg(F.count_distinct("id").alias("n")))).unionByName(of("tasks", table(spark, sf_dir, "tasks").agg(F.count_distinct("id").alias("n"))))


@query(f"WITH {OUTCOME}, r AS (SELECT outcome = 'success' AS ok, row_number() OVER (ORDER BY ts DESC, id) AS k FROM oc WHERE ts IS NOT NULL), t AS (SELECT *, count(*) OVER () AS n FROM r WHERE k <= 200) SELECT count(*) AS episodes, round(avg(ok::INTEGER), 9)::DOUBLE AS rate, round(avg(ok::INTEGER) FILTER (WHERE n >= 4 AND k > n - n // 2), 9)::DOUBLE AS first_half, round(avg(ok::INTEGER) FILTER (WHERE n >= 4 AND k <= n - n // 2), 9)::DOUBLE AS second_half, round(avg(ok::INTEGER) FILTER (WHERE k <= 20), 9)::DOUBLE AS last_20 FROM t")
def episode_metrics(spark, sf_dir):
    """Success rates over the newest 200 traces (the report's size): all, halves in order of time (of at least 4), last 20."""
    d = _outcomes(spark, sf_dir).where("ts is not null").orderBy(F.desc("ts"), "id").limit(200).select("ts", "id", (F.col("outcome") == "success").cast("int").alias("ok"))
    d = d.withColumns({"k": F.row_number().over(Window.orderBy(F.desc("ts"), "id")), "n": F.count("*").over(Window.partitionBy())})  # 200 rows
    half = F.col("n") - F.floor(F.col("n") / 2)
    mean = lambda c: F.round(F.avg(F.when(c, F.col("ok"))), 9)
    return d.agg(F.count("*").alias("episodes"), mean(F.lit(True)).alias("rate"), mean((F.col("n") >= 4) & (F.col("k") > half)).alias("first_half"), mean((F.col("n") >= 4) & (F.col("k") <= half)).alias("second_half"), mean(F.col("k") <= 20).alias("last_20"))


# ---- statistics

_Z = 1.96
_WIL = lambda k, n: (f"greatest(0.0, ({k} / {n} + {_Z}*{_Z}/(2*{n})) / (1 + {_Z}*{_Z}/{n}) - {_Z}*sqrt(({k}/{n})*(1-{k}/{n})/{n} + {_Z}*{_Z}/(4.0*{n}*{n}))/(1+{_Z}*{_Z}/{n}))", f"least(1.0, ({k} / {n} + {_Z}*{_Z}/(2*{n})) / (1 + {_Z}*{_Z}/{n}) + {_Z}*sqrt(({k}/{n})*(1-{k}/{n})/{n} + {_Z}*{_Z}/(4.0*{n}*{n}))/(1+{_Z}*{_Z}/{n}))")


@query(f"WITH {OUTCOME}, g AS (SELECT agent, count(*) FILTER (WHERE outcome = 'success') AS k, count(*) AS n FROM oc GROUP BY agent) SELECT agent, k, n, round(k / n, 6)::DOUBLE AS rate, round({_WIL('k', 'n')[0]}, 6)::DOUBLE AS low, round({_WIL('k', 'n')[1]}, 6)::DOUBLE AS high FROM g")
def wilson_by_agent(spark, sf_dir):
    """Success rate of each agent with its interval."""
    d = stats.rate(_outcomes(spark, sf_dir).withColumn("ok", F.col("outcome") == "success"), ["agent"], "ok")
    return d.select("agent", "k", "n", *(F.round(c, 6).alias(c) for c in ("rate", "low", "high")))


@query(f"WITH {OUTCOME}, d AS (SELECT split_part(agent, '-', 1) AS kind, date_trunc('day', received) AS day, count(*) FILTER (WHERE outcome = 'success') AS s, count(*) FILTER (WHERE outcome = 'failure') AS f FROM oc WHERE agent IS NOT NULL AND received IS NOT NULL GROUP BY ALL), w AS (SELECT kind, count(*) FILTER (WHERE s > f) AS wins, count(*) FILTER (WHERE s < f) AS losses FROM d GROUP BY kind) SELECT kind, wins, losses, round(CASE WHEN wins + losses = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1), lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2.0))))) END, 6)::DOUBLE AS p FROM w")
def sign_test_by_kind(spark, sf_dir):
    """For each kind of agent, days with more successes than failures against the others, and the sign test."""
    d = _outcomes(spark, sf_dir).where("agent is not null and received is not null").groupBy(F.substring_index("agent", "-", 1).alias("kind"), F.date_trunc("day", "received").alias("day")).agg(F.count_if(F.col("outcome") == "success").alias("s"), F.count_if(F.col("outcome") == "failure").alias("f"))
    w = d.groupBy("kind").agg(F.count_if(F.col("s") > F.col("f")).alias("wins"), F.count_if(F.col("s") < F.col("f")).alias("losses"))
    return w.withColumn("p", F.round(stats.sign_test(F.col("wins"), F.col("losses")), 6))


# ---- extensions: not of the reference, labelled as such


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2)::DOUBLE AS total FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup_report(spark, sf_dir):
    """Subtotals of line items."""
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, k::BIGINT AS session, count(*) AS events, min(ts) AS began FROM s GROUP BY ALL")
def ext_session_windows(spark, sf_dir):
    """Sessions of users, parted by half an hour without an event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 30 MINUTES")
    d = table(spark, sf_dir, "events").withColumn("session", F.sum(F.when(gap, 0).otherwise(1)).over(w))
    return d.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("began"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS distinct_ids FROM events GROUP BY event_type")
def events_stream_ingest(spark, sf_dir):
    """The events table taken in as a stream of files until nothing is left, then counted."""
    return ingest.ingest_files(spark, f"{sf_dir}/events.parquet", ["event_id"]).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("distinct_ids"))
