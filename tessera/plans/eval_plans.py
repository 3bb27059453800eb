"""Answer evaluation queries (family B) over the events-derived answer log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evals as E
from ..operators.textjoin import contains_any, first_contained
from ..sources.fixtures import answers, eval_tasks, with_answer_scores
from ..sources.tables import read_table
from .oracle_views import with_answers
from .registry import register

MIN_SCORED = 30
MIN_ANSWERS = 140


def scored(spark, sf_dir):
    return with_answer_scores(answers(spark, sf_dir))


@register("F5_F8_scored_answers",
          with_answers("SELECT task_id, agent_name, prediction, true_answer, is_correct, is_near_correct FROM scored"))
def scored_answers(spark, sf_dir):
    return scored(spark, sf_dir).select("task_id", "agent_name", "prediction", "true_answer",
                                        "is_correct", "is_near_correct")


ACC_SQL = f"""SELECT model_id, agent_action_type, source, round(avg(CAST(is_correct AS DOUBLE)) * 100, 2) AS acc,
       count(is_correct) AS n_scored
FROM scored GROUP BY model_id, agent_action_type, source HAVING count(is_correct) > {MIN_SCORED}"""


@register("A35_accuracy_by_subset", with_answers(ACC_SQL))
def accuracy(spark, sf_dir):
    return E.accuracy_by_subset(scored(spark, sf_dir), min_scored=MIN_SCORED)


@register("A36_accuracy_pivot",
          with_answers(f"""SELECT model_id, source,
  max(CASE WHEN agent_action_type = 'code' THEN acc END) AS acc_code,
  max(CASE WHEN agent_action_type = 'tool-calling' THEN acc END) AS acc_tool_calling
FROM ({ACC_SQL}) a GROUP BY model_id, source"""))
def accuracy_pivot(spark, sf_dir):
    return E.accuracy_pivot(E.accuracy_by_subset(scored(spark, sf_dir), min_scored=MIN_SCORED))


@register("A37_answers_per_agent",
          with_answers("SELECT agent_name, count(*) AS n_answers FROM scored GROUP BY agent_name"))
def answers_per_agent(spark, sf_dir):
    return E.answer_counts(scored(spark, sf_dir))[0]


FIRST_SQL = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY agent_name, question ORDER BY task_id) AS rn
                 FROM scored) WHERE rn = 1"""


@register("A37_W2_answers_per_agent_task_deduplicated",
          with_answers(f"SELECT agent_name, task, count(*) AS n_answers FROM ({FIRST_SQL}) f GROUP BY agent_name, task"))
def answers_per_agent_task(spark, sf_dir):
    return E.answer_counts(scored(spark, sf_dir))[1]


EXPECTED_ANSWERS = 165


@register("A37_completeness",
          with_answers(f"SELECT count(*) AS total, count(*) = {EXPECTED_ANSWERS} AS is_complete FROM ({FIRST_SQL}) f"))
def completeness(spark, sf_dir):
    return E.completeness(scored(spark, sf_dir), EXPECTED_ANSWERS)


@register("W2_first_answer_per_agent_question",
          with_answers(f"SELECT agent_name, question, task_id, prediction FROM ({FIRST_SQL}) f"))
def first_answers(spark, sf_dir):
    return E.first_per_key(scored(spark, sf_dir), ["agent_name", "question"], "task_id").select(
        "agent_name", "question", "task_id", "prediction")


@register("A38_mean_score_by_agent",
          with_answers("SELECT agent_name, round(avg(CAST(is_correct AS DOUBLE)), 3) AS mean_is_correct FROM scored GROUP BY agent_name"))
def mean_score(spark, sf_dir):
    return E.mean_score_by_agent(scored(spark, sf_dir))


@register("A39_A41_F9_agent_task_table",
          with_answers("""SELECT agent_name, task, avg(CAST(is_correct AS DOUBLE)) AS is_correct,
  avg(CAST(is_near_correct AS DOUBLE)) AS is_near_correct, avg(len(intermediate_steps)) AS count_steps,
  count(question) AS count,
  avg(CAST(epoch(strptime(end_time, '%Y-%m-%d %H:%M:%S')) - epoch(strptime(start_time, '%Y-%m-%d %H:%M:%S')) AS INTEGER)) AS duration
FROM scored GROUP BY agent_name, task"""))
def agent_task(spark, sf_dir):
    return E.agent_task_table(scored(spark, sf_dir))


def _err_sql():
    names = list(E.ERROR_TYPES)
    per_run = ", ".join(f"len(list_filter(intermediate_steps, lambda s: s.error_type = '{e}')) AS \"{e}\"" for e in names)
    means = ", ".join(f"avg(\"{e}\") AS \"{e}\"" for e in names)
    melt = " UNION ALL ".join(f"SELECT is_correct, '{n}' AS variable, CAST(\"{n}\" AS DOUBLE) AS value FROM m"
                              for n in names + ["Count steps"])
    return with_answers(melt, f""",
r AS (SELECT is_correct, {per_run}, len(intermediate_steps) AS "Count steps" FROM scored),
m AS (SELECT is_correct, {means}, avg("Count steps") AS "Count steps" FROM r GROUP BY is_correct)""")


@register("A40_error_counts_by_correctness", _err_sql())
def error_counts(spark, sf_dir):
    return E.error_counts_by_correctness(scored(spark, sf_dir))


@register("A42_tool_call_counts",
          with_answers("""SELECT agent_name, tool, count(*) AS n_calls FROM (
  SELECT agent_name, unnest(flatten(list_transform(intermediate_steps,
         lambda s: regexp_extract_all(coalesce(s.llm_output, ''), '\\b(\\w+)\\(', 1)))) AS tool FROM scored) t
WHERE tool = lower(tool) AND tool <> upper(tool) GROUP BY agent_name, tool"""))
def tool_calls(spark, sf_dir):
    return E.tool_call_counts(scored(spark, sf_dir))


MAJ_SQL = """SELECT m.question, m.prediction, f.task, f.is_correct FROM (
  SELECT question, prediction FROM (
    SELECT question, prediction, row_number() OVER (PARTITION BY question ORDER BY n DESC, prediction) AS rn
    FROM (SELECT question, prediction, count(*) AS n FROM {src}
          WHERE prediction IS NOT NULL AND prediction NOT IN ('Unable to determine', 'None')
          GROUP BY question, prediction)) WHERE rn = 1) m
LEFT JOIN (SELECT question, prediction, task, is_correct FROM (
    SELECT *, row_number() OVER (PARTITION BY question, prediction ORDER BY task_id) AS rn FROM {src}
    WHERE prediction IS NOT NULL AND prediction NOT IN ('Unable to determine', 'None')) WHERE rn = 1) f
ON m.question = f.question AND m.prediction = f.prediction"""

ORACLE_SQL = """SELECT question, task_id, agent_name, prediction, is_correct FROM (
  SELECT *, row_number() OVER (PARTITION BY question ORDER BY NOT is_correct, task_id) AS rn FROM {src}) WHERE rn = 1"""


@register("A43_J3_majority_vote", with_answers(MAJ_SQL.format(src="scored")))
def majority(spark, sf_dir):
    return E.majority_vote(scored(spark, sf_dir))


@register("A44_oracle_ensemble", with_answers(ORACLE_SQL.format(src="scored")))
def oracle(spark, sf_dir):
    return E.oracle_ensemble(scored(spark, sf_dir))


@register("A43_A44_P9_ensemble_scores",
          with_answers(f"""SELECT (SELECT avg(CAST(is_correct AS DOUBLE)) * 100 FROM ({MAJ_SQL.format(src="big")})) AS majority_score,
       (SELECT avg(CAST(is_correct AS DOUBLE)) * 100 FROM ({ORACLE_SQL.format(src="big")})) AS oracle_score""",
                       f""",
big AS (SELECT * FROM scored WHERE agent_name IN (
          SELECT agent_name FROM scored GROUP BY agent_name HAVING count(*) > {MIN_ANSWERS}))"""))
def ensemble(spark, sf_dir):
    return E.ensemble_scores(scored(spark, sf_dir), MIN_ANSWERS)


@register("W1_expanding_accuracy",
          with_answers("""SELECT agent_name, task_id, substring(question, 1, 50) AS question_label,
  count(*) OVER w AS running_index,
  sum(CAST(is_correct AS BIGINT)) OVER w / count(*) OVER w AS expanding_accuracy
FROM scored WINDOW w AS (PARTITION BY agent_name ORDER BY task_id ROWS UNBOUNDED PRECEDING)"""))
def expanding(spark, sf_dir):
    return E.expanding_accuracy(scored(spark, sf_dir))


@register("P8_P10_incorrect_answers",
          with_answers("""SELECT task_id, agent_name, prediction FROM scored
WHERE NOT is_correct AND prediction IS NOT NULL AND prediction NOT IN ('Unable to determine', 'None')"""))
def incorrect(spark, sf_dir):
    return E.exclude_non_answers(E.correct_subset(scored(spark, sf_dir), False)).select(
        "task_id", "agent_name", "prediction")


@register("J4_resume_unanswered_tasks",
          with_answers("""SELECT task_order, question, file_name FROM eval_tasks
WHERE question NOT IN (SELECT question FROM answers
                       WHERE agent_name = 'agent_error' AND source = 'GAIA' AND prediction IS NOT NULL)
  AND question IN (SELECT question FROM answers WHERE agent_name = 'agent_view')"""))
def resume(spark, sf_dir):
    a = answers(spark, sf_dir)
    done = a.where((F.col("agent_name") == "agent_error") & (F.col("source") == "GAIA")
                   & F.col("prediction").isNotNull())
    wanted = a.where(F.col("agent_name") == "agent_view")
    return E.unanswered_tasks(eval_tasks(spark, sf_dir), done, only=wanted)


ATTACH_SQL = """
SELECT attachment_type, avg(CAST(is_correct AS DOUBLE)) AS is_correct, avg(len(intermediate_steps)) AS count_steps,
       count(question) AS question
FROM (SELECT s.*, CASE WHEN m.file_name IS NULL THEN 'Not found'
                       WHEN m.file_name <> '' THEN (string_split(m.file_name, '.'))[-1] ELSE 'None' END AS attachment_type
      FROM scored s LEFT JOIN (
        SELECT question, file_name FROM (
          SELECT q.question, t.file_name, row_number() OVER (PARTITION BY q.question ORDER BY t.task_order) AS rn
          FROM (SELECT DISTINCT question FROM scored) q JOIN eval_tasks t ON contains(q.question, t.question))
        WHERE rn = 1) m ON s.question = m.question) x
GROUP BY attachment_type"""


@register("J5_A45_accuracy_by_attachment_type", with_answers(ATTACH_SQL))
def attachment_accuracy(spark, sf_dir):
    sc = scored(spark, sf_dir)
    qs = sc.select("question").distinct().withColumn("_qtext", F.col("question"))
    tasks = eval_tasks(spark, sf_dir).select(F.col("question").alias("task_question"), "file_name", "task_order")
    found = first_contained(qs, "question", "_qtext", tasks, "task_question", "task_question", "task_order")
    fn = F.col("matched_file_name")
    att = found.select("question", F.when(F.col("task_question").isNull(), F.lit("Not found"))
                       .when(fn != "", E.file_extension(fn)).otherwise(F.lit("None")).alias("attachment_type"))
    j = sc.join(att, "question", "left")
    return j.groupBy("attachment_type").agg(
        F.avg(F.col("is_correct").cast("double")).alias("is_correct"),
        F.avg(F.size("intermediate_steps")).alias("count_steps"),
        F.count("question").alias("question"))


@register("F10_parse_subset_names",
          with_answers("""SELECT subset, array_to_string(parts[1:len(parts) - 2], '/') AS model_id,
       parts[-2] AS agent_action_type, parts[-1] AS task
FROM (SELECT subset, string_split(subset, '__') AS parts FROM (
  SELECT DISTINCT replace(model_id, '/', '__') || '__' || agent_action_type || '__' || lower(source) AS subset FROM answers))"""))
def subset_names(spark, sf_dir):
    a = answers(spark, sf_dir)
    names = a.select(F.concat_ws("__", F.replace("model_id", F.lit("/"), F.lit("__")), "agent_action_type",
                                 F.lower("source")).alias("subset")).distinct()
    return names.select("subset", *E.parse_subset_name("subset"))


@register("F11_attachment_classes",
          with_answers("""SELECT CASE WHEN file_name IS NULL OR file_name = '' THEN 'none'
  WHEN (string_split(file_name, '.'))[-1] IN ('png', 'jpg', 'jpeg') THEN 'image'
  WHEN (string_split(file_name, '.'))[-1] IN ('pdf', 'xls', 'xlsx', 'docx', 'doc', 'xml') THEN 'document'
  WHEN (string_split(file_name, '.'))[-1] IN ('mp3', 'm4a', 'wav') THEN 'audio' ELSE 'other' END AS attachment_class,
  count(*) AS n FROM answers GROUP BY 1"""))
def attachment_classes(spark, sf_dir):
    return answers(spark, sf_dir).groupBy(E.attachment_class("file_name").alias("attachment_class")).agg(
        F.count(F.lit(1)).alias("n"))


@register("P7_documents_containing_benchmark_passages",
          "SELECT d.doc_id, d.source FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))")
def documents_with_passages(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "source", "text"])
    bench = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    return contains_any(docs, "doc_id", "text", bench, "item_id", "text").select("doc_id", "source")
