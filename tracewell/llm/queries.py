"""The queries pN_... of the problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, cuts, leaks, neardup, secrets, splits, subjects, vectors
from tracewell.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live credentials in arguments, results and contents, by the place of their first character."""
    return secrets.credentials(table(spark, sf_dir, "traces")).select("trace_id", "step_pos", "call_pos", "field", "start_pos")


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a credential, each with its credentials replaced."""
    return secrets.redacted(table(spark, sf_dir, "traces"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of near-duplicate skill bodies, skill descriptions and lesson rules (overlap 0.70 or more)."""
    texts = neardup.stacked(table(spark, sf_dir, "skills"), table(spark, sf_dir, "lessons"))
    pairs = neardup.key_pairs(*neardup.near_duplicates(texts, 0.70))
    name = F.element_at(F.array(*map(F.lit, neardup.FIELDS)), F.col("field") + 1)
    return pairs.select(name.alias("field"), "key_a", "key_b")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of skills of which one is among the other's 8 most similar, with a cosine of 0.80 or more."""
    near = vectors.similar_pairs(table(spark, sf_dir, "skills"), "name", "embedding", 96, 8, 0.80)
    return near.select(F.least("a", "b").alias("name_a"), F.greatest("a", "b").alias("name_b")).distinct()


def _p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.key_links(*splits.cross_split(splits.task_sides(table(spark, sf_dir, "tasks")), 0.75))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a training task and a task of another split whose prompts overlap by 0.75 or more."""
    return _p4(spark, sf_dir).where("train_key <> other_key").select(F.least("train_key", "other_key").alias("task_a"), F.greatest("train_key", "other_key").alias("task_b")).distinct()


def p4_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each split (but train) and source: tasks, tasks that overlap with training, and their greatest and mean share of chunks."""
    tasks = table(spark, sf_dir, "tasks")
    own = tasks.where("id is not null and trim(split) <> ''").select(F.col("id").alias("other_key"), F.lower(F.trim("split")).alias("split"), "source").where("split <> 'train'").distinct()
    hit = _p4(spark, sf_dir).groupBy("other_key").agg(F.max("part_other").alias("part"))
    return own.join(hit, "other_key", "left").groupBy("split", "source").agg(F.count("*").alias("tasks"), F.count("part").alias("overlapping"), F.max("part").alias("most_shared"), F.avg("part").alias("mean_shared"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results and errors of tool calls that were cut."""
    return cuts.cut_texts(table(spark, sf_dir, "traces"))[0].select("trace_id", "step_pos", "call_pos", "field")


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each agent and field: texts, cut texts, the rate of cut ones, and how many of them stand at a significant length,
    have a mark (words, dots or a broken character), or are known by their ending alone."""
    cut, texts, _ = cuts.cut_texts(table(spark, sf_dir, "traces"))
    every = texts.groupBy("agent", "field").agg(F.count_distinct("trace_id", "step_pos", "call_pos").alias("texts"))
    of = lambda *kinds: F.count_if(F.col("cause").isin(*kinds))
    sums = cut.groupBy(F.col("agent").alias("_a"), F.col("field").alias("_f")).agg(F.count("*").alias("cut"), of("limit").alias("at_limit"), of("broken", "mark", "dots").alias("marked"), of("ending").alias("by_ending"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    met = every.join(sums, F.col("agent").eqNullSafe(F.col("_a")) & (F.col("field") == F.col("_f")), "left")
    return met.select("agent", "field", "texts", zero("cut"), (F.coalesce("cut", F.lit(0)) / F.col("texts")).alias("rate"), zero("at_limit"), zero("marked"), zero("by_ending"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    return bpe.encode_texts(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the held-out items of which they hold at least 13 successive words."""
    return leaks.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each kind of held-out item: items, items that leaked, and documents they leaked into."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "kind").distinct()
    return items.join(p7_found(spark, sf_dir), "item_id", "left").groupBy("kind").agg(F.count_distinct("item_id").alias("items"), F.count_distinct(F.when(F.col("doc_id").isNotNull(), F.col("item_id"))).alias("leaked"), F.count("doc_id").alias("doc_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the subjects with which at least a quarter of their statements deal."""
    return subjects.document_subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subjects")).select("doc_id", "subject")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject: documents with it, and their share of all documents."""
    n = table(spark, sf_dir, "documents").agg(F.count_distinct("doc_id").alias("n"))  # one row
    return p8_found(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("documents")).join(F.broadcast(n)).select("subject", "documents", (F.col("documents") / F.col("n")).alias("share"))


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p4_by_source": p4_by_source, "p5_found": p5_found, "p5_rates": p5_rates, "p6_ids": p6_ids, "p7_found": p7_found, "p7_items": p7_items, "p8_found": p8_found, "p8_composition": p8_composition}
# The same in SQL, by all pairs, where SQL can say it.
_BAGS = """b AS (SELECT f, k, w, count(*) AS c FROM (SELECT f, k, unnest(regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+')) AS w FROM x) GROUP BY ALL),
n AS (SELECT f, k, sum(c) AS n FROM b GROUP BY ALL),
s AS (SELECT a.f, a.k AS i, b.k AS j, sum(least(a.c, b.c)) AS m FROM b a JOIN b ON a.f = b.f AND a.w = b.w AND a.k < b.k GROUP BY ALL),
o AS (SELECT s.f, i, j, m / (p.n + q.n - m) AS overlap FROM s JOIN n p ON p.f = s.f AND p.k = i JOIN n q ON q.f = s.f AND q.k = j)"""
ORACLES = {
    "p2_found": f"WITH x AS (SELECT DISTINCT 'skill_body' AS f, name AS k, body AS t FROM skills UNION SELECT 'skill_description', name, description FROM skills UNION SELECT 'lesson_rule', id, rule FROM lessons), {_BAGS} SELECT f AS field, i AS key_a, j AS key_b FROM o WHERE overlap >= 0.70",
    "p3_found": """WITH v AS (SELECT name, any_value(embedding)::DOUBLE[] AS e FROM skills WHERE len(embedding) = 96 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0 GROUP BY name),
c AS (SELECT a.name AS x, b.name AS y, list_cosine_similarity(a.e, b.e) AS cos FROM v a JOIN v b ON a.name <> b.name), r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY cos DESC, y) AS k FROM c)
SELECT DISTINCT least(x, y) AS name_a, greatest(x, y) AS name_b FROM r WHERE k <= 8 AND cos >= 0.80""",
    "p4_found": f"WITH y AS (SELECT DISTINCT id, lower(trim(split)) = 'train' AS train, prompt FROM tasks WHERE trim(split) <> ''), x AS (SELECT DISTINCT 0 AS f, id AS k, prompt AS t FROM y), {_BAGS} SELECT DISTINCT i AS task_a, j AS task_b FROM o JOIN y p ON p.id = i JOIN y q ON q.id = j WHERE overlap >= 0.75 AND p.train <> q.train",
    "p7_found": """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
g AS (SELECT item_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i)), h AS (SELECT doc_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d))
SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (g)""",
}
