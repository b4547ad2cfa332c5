"""Queries of the evaluation operators: rollouts, verdicts, sequences, policy signals, verification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import preferences, qualify, rollouts, sequences, splits, verify

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


R = "r AS (SELECT * FROM rollouts QUALIFY row_number() OVER (PARTITION BY rollout_id ORDER BY arrived_at) = 1)"
ONE = "one AS (SELECT * FROM problems QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY pos) = 1)"
REWARD = "CASE WHEN verifier_status IN ('CE', 'RE', 'TLE') THEN 0.0 ELSE coalesce(reward_passed / nullif(reward_total, 0), 0.0) END"
#: The last rollout of a problem and model, as the old and new runs of comparisons.
FIRST = "f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY problem_id, model_revision ORDER BY rollout_id) = 1), lo AS (SELECT min(model_revision) AS a, max(model_revision) AS b FROM r), old AS (SELECT f.* FROM f, lo WHERE model_revision = a), new AS (SELECT f.* FROM f, lo WHERE model_revision = b)"


def delivered(spark: SparkSession, folder: str, **derived: Column) -> DataFrame:
    """Each rollout once, with columns that are derived from a row where it is read."""
    rows = table(spark, folder, "rollouts")
    return rollouts.one_delivery(rows.withColumns(derived) if derived else rows)


def runs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """First rollout per problem of the first and of the last model revision by name."""
    rows = delivered(spark, folder)
    kept = [c for c in rows.columns if c not in ("problem_id", "model_revision")]
    first = rows.groupBy("problem_id", "model_revision").agg(*(F.min_by(c, "rollout_id").alias(c) for c in kept))
    ends = table(spark, folder, "rollouts").agg(F.min("model_revision").alias("a"), F.max("model_revision").alias("b"))
    both = first.crossJoin(F.broadcast(ends))  # one row
    return both.where("model_revision = a").drop("a", "b"), both.where("model_revision = b").drop("a", "b")


@query(f"WITH {R} SELECT rollout_id, problem_id, verifier_status FROM r")
def rollout_deliveries(spark, folder):
    return delivered(spark, folder).select("rollout_id", "problem_id", "verifier_status")


@query(f"WITH {R}, g AS (SELECT *, split_part(problem_id, ':', 1) AS source FROM r) SELECT CASE WHEN grouping(source) = 0 THEN source END AS source, CASE WHEN grouping(model_revision) = 0 THEN model_revision END AS model_revision, count(*) AS total, count_if(verifier_status = 'AC') AS accepted, count_if(verifier_status = 'AC') / count(*) AS acceptance_rate FROM g GROUP BY GROUPING SETS ((source), (model_revision), ())")
def verdict_summary(spark, folder):
    rows = delivered(spark, folder).withColumn("source", F.substring_index("problem_id", ":", 1))
    return rollouts.verdict_summary(rows, "source", "model_revision")


@query(f"WITH {R} SELECT model_revision, verifier_status, count(*) AS n FROM r GROUP BY ALL")
def status_counts(spark, folder):
    return delivered(spark, folder).groupBy("model_revision", "verifier_status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {R} SELECT model_revision, count(*) AS total, count_if(verifier_status = 'AC') / count(*) AS pass_at_1, count_if(verifier_status IN ('AC', 'WA')) / count(*) AS executable_rate, coalesce(avg(testcase_pass_rate), 0) AS mean_testcase_pass_rate,
avg(coalesce(reward_passed / nullif(reward_total, 0), 0)) AS reward_mean, avg(coalesce(heldout_passed / nullif(heldout_total, 0), 0)) AS heldout_mean,
avg(coalesce(reward_passed / nullif(reward_total, 0), 0)) - avg(coalesce(heldout_passed / nullif(heldout_total, 0), 0)) AS generalization_gap, count_if(hit_max_new_tokens) AS cap_hits, count_if(hit_max_new_tokens) / count(*) AS cap_hit_rate,
avg(response_token_count) AS mean_response_tokens FROM r GROUP BY 1""")
def rollout_metrics(spark, folder):
    return rollouts.rollout_metrics(delivered(spark, folder), "model_revision")


_PCT = "list_sort(list(v))[round_even({q} / 100.0::DOUBLE * (count(*) - 1), 0)::BIGINT + 1]"


@query(f"WITH {R} SELECT model_revision, count(*)::DOUBLE AS count, {_PCT.format(q=50)} AS p50, {_PCT.format(q=95)} AS p95, {_PCT.format(q=99)} AS p99, max(v) AS max FROM (SELECT model_revision, response_token_count::DOUBLE AS v FROM r WHERE response_token_count IS NOT NULL) GROUP BY 1")
def numeric_stats(spark, folder):
    return stats.numeric_stats(delivered(spark, folder), "response_token_count", (50, 95, 99), ("model_revision",))


@query(f"WITH {R} SELECT count(*)::DOUBLE AS count, {_PCT.format(q=50)} AS p50, {_PCT.format(q=95)} AS p95, max(v) AS max FROM (SELECT generation_latency_ms AS v FROM r WHERE generation_latency_ms IS NOT NULL)")
def latency_stats(spark, folder):
    return stats.numeric_stats(delivered(spark, folder), "generation_latency_ms", (50, 95))


@query(f"WITH {R}, t AS (SELECT unnest([256, 512, 1024, 2048, 4096])::BIGINT AS threshold) SELECT model_revision, threshold, count_if(response_token_count <= threshold) AS count, count_if(response_token_count <= threshold) / count(response_token_count) AS rate FROM r, t GROUP BY 1, 2")
def threshold_counts(spark, folder):
    return stats.threshold_counts(delivered(spark, folder), "response_token_count", (256, 512, 1024, 2048, 4096), ("model_revision",))


_DIST = "SELECT 'source' AS field, coalesce(source, 'None') AS value FROM {0} UNION ALL SELECT 'difficulty', coalesce(difficulty, 'None') FROM {0} UNION ALL SELECT 'lang', coalesce(lang, 'None') FROM {0}"


@query(f"WITH {ONE}, d AS ({_DIST.format('one')}) SELECT field, value, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY field) AS rate FROM d GROUP BY 1, 2")
def distribution(spark, folder):
    from .curation import one_problem

    return stats.distribution(one_problem(table(spark, folder, "problems")), "source", "difficulty", "lang")


@query(f"""WITH {ONE}, s AS (SELECT * FROM one WHERE problem_id IN (SELECT problem_id FROM rollouts WHERE verifier_status = 'AC')),
a AS (SELECT field, value, count(*) / sum(count(*)) OVER (PARTITION BY field) AS rate FROM ({_DIST.format('s')}) GROUP BY 1, 2), b AS (SELECT field, value, count(*) / sum(count(*)) OVER (PARTITION BY field) AS rate FROM ({_DIST.format('one')}) GROUP BY 1, 2)
SELECT field, value, coalesce(a.rate, 0) - coalesce(b.rate, 0) AS delta FROM a FULL JOIN b USING (field, value)""")
def distribution_shift(spark, folder):
    from .curation import one_problem

    rows = one_problem(table(spark, folder, "problems"))
    solved = table(spark, folder, "rollouts").where("verifier_status = 'AC'").select("problem_id").distinct()
    columns = ("source", "difficulty", "lang")
    return stats.distribution_shift(stats.distribution(rows.join(solved, "problem_id", "left_semi"), *columns), stats.distribution(rows, *columns))


@query(f"WITH {R}, {FIRST} SELECT o.verifier_status AS old_status, n.verifier_status AS new_status, count(*) AS n FROM old o JOIN new n USING (problem_id) GROUP BY 1, 2")
def transition_matrix(spark, folder):
    return rollouts.transitions(*runs(spark, folder))


@query(f"""WITH {R}, {FIRST}, j AS (SELECT trunc(o.generation_latency_ms)::BIGINT AS ol, trunc(n.generation_latency_ms)::BIGINT AS nl, o.response_token_count AS ot, n.response_token_count AS nt, o.verifier_status AS os, n.verifier_status AS ns FROM old o JOIN new n USING (problem_id))
SELECT count(*) AS n, sum(ol)::BIGINT AS old_latency, sum(nl)::BIGINT AS new_latency, sum(nl) / sum(ol) AS latency_ratio, sum(ot)::BIGINT AS old_tokens, sum(nt)::BIGINT AS new_tokens, sum(nt) / sum(ot) AS token_ratio, count_if(ns = 'AC' AND os <> 'AC') AS added_accepted FROM j""")
def generation_cost(spark, folder):
    return rollouts.cost_ratio(*runs(spark, folder))


@query(f"WITH {R}, {FIRST} SELECT o.problem_id, CASE WHEN o.response_token_count >= 2048 THEN n.verifier_status ELSE o.verifier_status END AS verifier_status, CASE WHEN o.response_token_count >= 2048 THEN n.response_token_count ELSE o.response_token_count END AS response_token_count, o.response_token_count >= 2048 AS rerun FROM old o JOIN new n USING (problem_id)")
def override_join(spark, folder):
    old, new = runs(spark, folder)
    pilot = old.join(new.select("problem_id"), "problem_id", "left_semi").select("problem_id", "verifier_status", "response_token_count")
    return rollouts.override(pilot, new, 2048, ["verifier_status", "response_token_count"])


@query(f"WITH {R} SELECT count_if(response_token_count >= 2048) AS capped, count(*) AS total, CASE WHEN count_if(response_token_count >= 2048) <= floor(count(*) * 0.05) THEN 'choose_4096' ELSE 'stop_no_auto_increase' END AS decision FROM r")
def length_policy(spark, folder):
    one = delivered(spark, folder).agg(F.count_if(F.col("response_token_count") >= 2048).alias("capped"), F.count(F.lit(1)).alias("total"))
    return one.withColumn("decision", rollouts.length_policy(F.col("capped"), F.col("total")))


@query(f"""WITH {R}, {FIRST}, m AS (SELECT split_part(problem_id, ':', 1) AS source, 'old' AS k, verifier_status, testcase_pass_rate FROM old UNION ALL SELECT split_part(problem_id, ':', 1), 'new', verifier_status, testcase_pass_rate FROM new),
g AS (SELECT source, k, count_if(verifier_status = 'AC') / count(*) AS pass_at_1, coalesce(avg(testcase_pass_rate), 0) AS mean_testcase_pass_rate FROM m GROUP BY 1, 2), l AS (SELECT source, k, 'pass_at_1' AS metric, pass_at_1 AS v FROM g UNION ALL SELECT source, k, 'mean_testcase_pass_rate', mean_testcase_pass_rate FROM g)
SELECT x.source, x.metric, x.v AS a, y.v AS b, y.v - x.v AS delta FROM l x JOIN l y ON x.source = y.source AND x.metric = y.metric AND x.k = 'old' AND y.k = 'new'""")
def model_comparison(spark, folder):
    old, new = (x.withColumn("source", F.substring_index("problem_id", ":", 1)) for x in runs(spark, folder))
    return rollouts.metric_deltas(rollouts.rollout_metrics(old, "source"), rollouts.rollout_metrics(new, "source"), ["pass_at_1", "mean_testcase_pass_rate"], "source")


@query(f"WITH {R} SELECT verifier_status, rollout_id, rank FROM (SELECT verifier_status, rollout_id, row_number() OVER (PARTITION BY verifier_status ORDER BY problem_id, rollout_id) AS rank FROM r WHERE verifier_status <> 'AC') WHERE rank <= 5")
def failure_samples(spark, folder):
    rows = delivered(spark, folder).where("verifier_status <> 'AC'").select("verifier_status", "problem_id", "rollout_id")
    return rollouts.first_k(rows, ["verifier_status"], ["problem_id", "rollout_id"], 5).select("verifier_status", "rollout_id", "rank")


@query(f"WITH {R}, h AS (SELECT rollout_id, sha256(rollout_id::VARCHAR || '|' || verifier_status) AS h, row_number() OVER (ORDER BY rollout_id) - 1 AS rank FROM r), b AS (SELECT rank // 4096 AS b, count(*) AS n, sha256(string_agg(h, ',' ORDER BY rank)) AS h FROM h GROUP BY 1) SELECT sum(n)::BIGINT AS rows, CASE WHEN count(*) = 1 THEN any_value(h) ELSE sha256(string_agg(h, ',' ORDER BY b)) END AS dataset_hash FROM b")
def dataset_hash(spark, folder):
    rows = delivered(spark, folder)
    return rollouts.ordered_hash(rows, "rollout_id", F.sha2(F.concat_ws("|", F.col("rollout_id").cast("string"), "verifier_status"), 256))


@query(f"WITH {R} SELECT rollout_id, {REWARD} AS dense_reward, CASE WHEN {REWARD} = 1.0 THEN 1.0 ELSE 0.0 END AS binary_reward FROM r")
def rewards(spark, folder):
    return delivered(spark, folder).select("rollout_id", rollouts.reward().alias("dense_reward"), rollouts.reward(True).alias("binary_reward"))


@query(f"WITH {R}, x AS (SELECT *, {REWARD} AS reward FROM r) SELECT rollout_id, reward, (reward - avg(reward) OVER w) / (stddev_pop(reward) OVER w + 1e-6) AS advantage FROM x WINDOW w AS (PARTITION BY problem_id, model_revision)")
def group_advantage(spark, folder):
    out = rollouts.group_advantage(delivered(spark, folder), ["problem_id", "model_revision"])
    return out.select("rollout_id", "reward", F.round("advantage", 6).alias("advantage"))


SQL["group_advantage"] = SQL["group_advantage"].replace("(reward - avg(reward) OVER w) / (stddev_pop(reward) OVER w + 1e-6) AS advantage", "round((reward - avg(reward) OVER w) / (stddev_pop(reward) OVER w + 1e-6), 6) AS advantage")


@query(f"WITH {R}, g AS (SELECT min({REWARD}) AS lo, max({REWARD}) AS hi FROM r GROUP BY problem_id, model_revision) SELECT count(*) AS groups, count_if(lo = hi) AS zero, count_if(lo = hi AND lo = 1) AS all_solved, count_if(lo = hi AND hi = 0) AS all_failed FROM g")
def zero_variance(spark, folder):
    return rollouts.zero_variance(delivered(spark, folder), ["problem_id", "model_revision"])


@query(f"WITH {R} SELECT model_revision, count_if(reward_passed = reward_total) AS full_reward, count_if(reward_passed = reward_total AND heldout_passed < heldout_total) AS false_positives, coalesce(count_if(reward_passed = reward_total AND heldout_passed < heldout_total) / nullif(count_if(reward_passed = reward_total), 0), 0) AS fpr, avg(reward_passed / nullif(reward_total, 0)) - avg(heldout_passed / nullif(heldout_total, 0)) AS gap FROM r GROUP BY 1")
def fpr_gap(spark, folder):
    return rollouts.false_positive_gap(delivered(spark, folder), "model_revision")


@query(f"WITH {R}, g AS (SELECT problem_id, count(*) AS n, count_if(verifier_status = 'AC')::BIGINT AS c FROM r GROUP BY 1) SELECT problem_id, n, c, CASE WHEN n < 4 THEN NULL WHEN n - c < 4 THEN 1.0 WHEN c = 0 THEN 0.0 ELSE round(1.0 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1.0::DOUBLE - 4.0::DOUBLE / i)), 9) END AS pass_at_4 FROM g")
def pass_at_k(spark, folder):
    g = delivered(spark, folder).groupBy("problem_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verifier_status") == "AC").alias("c"))
    return g.withColumn("pass_at_4", F.round(stats.pass_at_k(F.col("n"), F.col("c"), 4), 9))


@query(f"WITH {R} SELECT rollout_id, CASE WHEN 'CE' IN (a, b) THEN 'CE' WHEN 'TLE' IN (a, b) THEN 'TLE' WHEN 'RE' IN (a, b) THEN 'RE' WHEN a = 'AC' AND b = 'AC' THEN 'AC' ELSE 'WA' END AS status FROM (SELECT rollout_id, CASE WHEN reward_passed = reward_total THEN 'AC' ELSE verifier_status END AS a, CASE WHEN heldout_passed = heldout_total THEN 'AC' ELSE verifier_status END AS b FROM r)")
def combined_verdict(spark, folder):
    s = F.col("verifier_status")
    a, b = F.when(F.col("reward_passed") == F.col("reward_total"), "AC").otherwise(s), F.when(F.col("heldout_passed") == F.col("heldout_total"), "AC").otherwise(s)
    return delivered(spark, folder).select("rollout_id", rollouts.combined_status(a, b).alias("status"))


_TRIED = f"""{R}, k AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY rollout_id) AS attempt_index FROM r), t AS (SELECT * FROM k WHERE attempt_index <= 3)"""


def attempted(spark: SparkSession, folder: str) -> DataFrame:
    """The first three rollouts of each problem as its attempts; a top-k per group precedes the collection, so a list holds three items."""
    top = rollouts.first_k(delivered(spark, folder), ["problem_id"], ["rollout_id"], 3)
    item = F.struct(F.col("rank").alias("attempt_index"), F.col("verifier_status").alias("status"), F.col("testcase_pass_rate").alias("pass_rate"), F.concat(F.lit("case_"), "testcase_passed").alias("first_failure"), F.lit(None).cast("string").alias("slow_status"))
    return top.groupBy("problem_id").agg(F.array_sort(F.collect_list(item)).alias("attempts"))


@query(f"WITH {_TRIED} SELECT problem_id, attempt_index::INT AS attempt_index, verifier_status AS status FROM t QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY CASE WHEN verifier_status = 'AC' THEN 0 ELSE 1 END, CASE WHEN verifier_status = 'AC' THEN 0 ELSE -coalesce(testcase_pass_rate, 0) END, attempt_index) = 1")
def best_attempt(spark, folder):
    rows = attempted(spark, folder).withColumn("b", qualify.best_attempt(F.col("attempts")))
    return rows.select("problem_id", "b.attempt_index", "b.status")


@query(f"""WITH {_TRIED}, w AS (SELECT problem_id, count(*) AS n, max(coalesce(testcase_pass_rate, 0)) AS best FROM t WHERE verifier_status = 'WA' GROUP BY 1), s AS (SELECT problem_id, max(c) AS c FROM (SELECT problem_id, testcase_passed, count(*) AS c FROM t WHERE verifier_status = 'WA' GROUP BY 1, 2) GROUP BY 1)
SELECT DISTINCT t.problem_id, coalesce(w.n >= 2 AND s.c >= 2 AND w.best >= 0.95, false) AS suspected FROM t LEFT JOIN w USING (problem_id) LEFT JOIN s USING (problem_id)""")
def suspected_test_issue(spark, folder):
    return attempted(spark, folder).select("problem_id", qualify.suspected_test_issue(F.col("attempts")).alias("suspected"))


@query(f"""WITH {_TRIED}, p AS (SELECT DISTINCT problem_id FROM problems), b AS (SELECT problem_id, max(CASE WHEN attempt_index = 1 THEN verifier_status END) AS first, CASE WHEN bool_or(verifier_status = 'AC') THEN 'AC' ELSE 'not_ac' END AS best, max(CASE WHEN attempt_index = 2 THEN verifier_status END) AS ocr FROM t GROUP BY 1),
m AS (SELECT 'ref_at_1' AS metric, coalesce(first, 'NO_SOURCE') AS status FROM p LEFT JOIN b USING (problem_id) UNION ALL SELECT 'ref_at_any3', coalesce(best, 'NO_SOURCE') FROM p LEFT JOIN b USING (problem_id) UNION ALL SELECT 'ocr', ocr FROM p LEFT JOIN b USING (problem_id) WHERE ocr IS NOT NULL)
SELECT metric, status, count(*) AS n, (sum(count(*)) OVER (PARTITION BY metric))::BIGINT AS total, count(*) / sum(count(*)) OVER (PARTITION BY metric) AS rate FROM m GROUP BY 1, 2""")
def metric_bundle(spark, folder):
    rows = table(spark, folder, "problems").select("problem_id").distinct().join(attempted(spark, folder), "problem_id", "left")
    first, second = F.get("attempts", F.lit(0))["status"], F.get("attempts", F.lit(1))["status"]
    best = F.when(F.col("attempts").isNotNull(), F.when(F.exists("attempts", lambda a: a["status"] == "AC"), "AC").otherwise("not_ac"))
    return qualify.metric_bundle(rows, first, best, second)


_SEVERAL = "any valid|any one|any of|any order|print any|output any|if there are multiple|if multiple|multiple answers|multiple correct|all possible|in any order|arbitrary"


@query(f"""WITH {R}, {ONE}, c AS (SELECT unnest(['exact_normalized_mismatch', 'whitespace_tokenization_mismatch', 'unsupported_multiple_output_style_problem', 'suspected_source_testcase_issue', 'unknown']) AS category),
w AS (SELECT CASE WHEN testcase_total = testcase_passed THEN 'unknown' WHEN regexp_matches(lower(prompt), '{_SEVERAL}') THEN 'unsupported_multiple_output_style_problem' ELSE 'exact_normalized_mismatch' END AS category
      FROM r LEFT JOIN one USING (problem_id) WHERE verifier_status = 'WA') SELECT category, count(w.category) AS n FROM c LEFT JOIN w USING (category) GROUP BY 1""")
def wa_diagnostics(spark, folder):
    """Wrong answers of the rollouts by category. They hold no outputs, so none is known to differ in white space only; see `qualification` for that."""
    from .curation import one_problem

    rows = delivered(spark, folder).where("verifier_status = 'WA'").select("problem_id", (F.col("testcase_total") - F.col("testcase_passed")).alias("mismatches"))
    several = one_problem(table(spark, folder, "problems"), several=text.allows_several_answers("prompt")).select("problem_id", F.when(F.col("several"), "any order").otherwise("").alias("hint"))
    joined = rows.join(several, "problem_id", "left")
    category = qualify.wrong_answer_category(F.col("mismatches"), F.lit(0), F.coalesce("hint", F.lit(""))).alias("category")
    return qualify.zero_filled(joined.select(category), "category", qualify.WA_CATEGORIES)


_S = "trim(raw_response, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"
_BODY = "CASE WHEN starts_with(s, '<think>') AND contains(s, '</think>') THEN trim(substr(s, instr(s, '</think>') + 8), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) ELSE s END"
# Fences by cutting at the back-quotes: every second piece that another piece follows and that begins with a tag and a line end.
_PIECES = "list_filter(list_transform(range(2, len(x), 2), lambda i: x[i]), lambda y: regexp_matches(y, '^[A-Za-z0-9_+-]*[ \\t]*\\n'))"
_TAG = "split_part(trim(split_part(y, chr(10), 1), ' ' || chr(9)), ' ', 1)"
_CODE = "substr(y, instr(y, chr(10)) + 1)"


@query(f"""WITH {R}, s AS (SELECT rollout_id, {_S} AS s FROM r), b AS (SELECT rollout_id, {_BODY} AS b FROM s),
g AS (SELECT rollout_id, b, string_split(b, '```') AS x FROM b), h AS (SELECT rollout_id, b, {_PIECES} AS f FROM g),
f AS (SELECT rollout_id, b, list_transform(f, lambda y: {_TAG}) AS l, list_transform(f, lambda y: {_CODE}) AS c FROM h),
p AS (SELECT *, list_position(list_transform(l, lambda x: lower(x) IN ('python', 'py', 'python3')), true) AS k FROM f)
SELECT rollout_id, CASE WHEN b IS NULL THEN NULL WHEN b = '' THEN 'empty' WHEN k > 0 THEN 'fenced:' || lower(l[k]) WHEN len(l) > 0 THEN 'fenced:untyped' WHEN starts_with(b, '```') AND ends_with(b, '```') THEN 'fence-stripped' ELSE 'direct' END AS strategy,
sha256(CASE WHEN b = '' THEN '' WHEN k > 0 THEN trim(c[k], chr(32) || chr(9) || chr(10) || chr(13)) || chr(10) WHEN len(l) > 0 THEN trim(c[1], chr(32) || chr(9) || chr(10) || chr(13)) || chr(10) WHEN starts_with(b, '```') AND ends_with(b, '```') THEN trim(trim(b, '`'), chr(32) || chr(9) || chr(10) || chr(13)) || chr(10) ELSE b || chr(10) END) AS code_hash FROM p""")
def extract_code(spark, folder):
    found = text.let(text.extract_code("raw_response"), lambda x: F.struct(x["strategy"].alias("strategy"), F.sha2(x["code"], 256).alias("code_hash")))
    return delivered(spark, folder, x=found).select("rollout_id", "x.strategy", "x.code_hash")


@query(f"""WITH {R}, a AS (SELECT rollout_id, raw_response AS c, regexp_replace(raw_response, '^\\s+', '') AS b FROM r WHERE raw_response IS NOT NULL),
t AS (SELECT *, starts_with(b, '<think>') AS th, CASE WHEN starts_with(b, '<think>') THEN instr(substr(b, 8), '</think>') ELSE 0 END AS cl, (length(c) - length(replace(c, '```', ''))) // 3 AS marks, string_split(c, '```') AS x FROM a), w AS (SELECT *, {_PIECES} AS f FROM t), x AS (SELECT *, len(f) > 0 AS hasf, CASE WHEN len(f) > 0 THEN instr(c, '```' || f[1]) ELSE 0 END AS pos_f FROM w),
u AS (SELECT *, th AND cl > 0 AS closed, length(c) - length(b) + 7 + cl AS close_at FROM x), v AS (SELECT *, NOT th OR (closed AND (NOT hasf OR pos_f > close_at)) AS moves FROM u)
SELECT rollout_id, th AS starts_with_think, closed AS closed_think, th AND NOT closed AS unclosed_think, marks > 0 AS fenced_code, moves AS valid_reasoning_to_code_transition, NOT (th AND NOT closed) AND marks % 2 = 0 AND moves AND trim(CASE WHEN th AND closed THEN substr(b, 7 + cl + 8) ELSE b END, chr(32) || chr(9) || chr(10) || chr(13)) <> '' AS format_valid,
CASE WHEN th AND NOT closed THEN 'unclosed_think' WHEN th AND marks > 0 THEN 'think_fenced' WHEN th THEN 'think_unfenced' WHEN marks > 0 THEN 'fenced' ELSE 'plain' END AS format_class FROM v""")
def format_flags(spark, folder):
    flags = text.format_flags("raw_response", text.is_text(text.without_think("raw_response")))
    return delivered(spark, folder, f=F.when(F.col("raw_response").isNotNull(), flags)).where("f IS NOT NULL").select("rollout_id", "f.*")


_IDS = "list_transform(range(0, (prompt_token_count % 7 + response_token_count % 11)::BIGINT), lambda i: (i * 31 + rollout_id) % 1000)"


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Short made-up token rows: 7 and 11 bound the lengths."""
    rows = delivered(spark, folder).select("rollout_id", (F.col("prompt_token_count") % 7).alias("p"), (F.col("response_token_count") % 11).alias("n"))
    ids = F.transform(F.when(F.col("p") + F.col("n") > 0, F.sequence(F.lit(0), F.col("p") + F.col("n") - 1)).otherwise(F.array().cast("array<bigint>")), lambda i: (i * 31 + F.col("rollout_id")) % 1000)
    return rows.withColumn("input_ids", ids)


@query(f"WITH {R} SELECT rollout_id, list_transform({_IDS}, lambda x, i: CASE WHEN i > prompt_token_count % 7 THEN x ELSE -100 END) AS labels FROM r")
def response_labels(spark, folder):
    return _tokens(spark, folder).select("rollout_id", sequences.response_labels(F.col("input_ids"), F.col("p"), F.col("n")).alias("labels"))


@query(f"WITH {R}, t AS (SELECT rollout_id, rollout_id % 97 AS batch, {_IDS} AS ids FROM r), w AS (SELECT batch, max(len(ids)) AS w FROM t GROUP BY 1) SELECT rollout_id, list_concat(ids, list_transform(range(0, w - len(ids)), lambda i: 0::BIGINT)) AS input_ids, list_concat(list_transform(ids, lambda x: 1), list_transform(range(0, w - len(ids)), lambda i: 0)) AS attention_mask FROM t JOIN w USING (batch)")
def pad_batch(spark, folder):
    rows = _tokens(spark, folder).withColumn("batch", F.col("rollout_id") % 97).withColumn("labels", F.col("input_ids"))
    return sequences.pad_batches(rows, "batch", 0).select("rollout_id", "input_ids", "attention_mask")


_MEMBER = {f"clean_response_le_{n}": f"r <= {n}" for n in (1024, 2048, 3072, 4096)} | {f"clean_code_start_le_{n}": f"r <= 4096 AND c >= 0 AND c <= {n}" for n in (1024, 2048, 3072, 4096)} | {f"clean_joint_response_le_{a}_code_start_le_{b}": f"r <= {a} AND c >= 0 AND c <= {b}" for a, b in ((4096, 3072), (4096, 2048), (3072, 2048))}


@query(f"WITH {R}, x AS (SELECT rollout_id, response_token_count + 1 AS r, instr(raw_response, '```') - 1 AS c, prompt_token_count + response_token_count + 1 <= 8192 AND contains(raw_response, '```') AS ok FROM r) SELECT rollout_id, " + ", ".join(f"coalesce(ok AND {v}, false) AS {k}" for k, v in _MEMBER.items()) + " FROM x")
def v3_membership(spark, folder):
    rows = delivered(spark, folder, at=F.instr("raw_response", "```") - 1)
    rules = sequences.membership(F.col("at") >= 0, F.col("prompt_token_count") + F.col("response_token_count") + 1 <= 8192, F.col("response_token_count") + 1, F.col("at"))
    return rows.select("rollout_id", *(v.alias(k) for k, v in rules.items()))


@query(f"WITH {ONE} SELECT problem_id, sha256('### Problem' || chr(10) || prompt || chr(10) || chr(10) || '### Solution' || chr(10)) AS prompt_hash, sha256('### Problem' || chr(10) || prompt || chr(10) || chr(10) || '### Solution' || chr(10) || reference_code) AS target_hash FROM one")
def prompt_serialization(spark, folder):
    from .curation import one_problem

    hashes = {"prompt_hash": F.sha2(sequences.prompt_text(F.col("prompt")), 256), "target_hash": F.sha2(sequences.target_text(F.col("prompt"), F.col("reference_code")), 256)}
    return one_problem(table(spark, folder, "problems"), **hashes).select("problem_id", *hashes)


@query("SELECT pos % 8 AS shard, count(*) AS n FROM problems GROUP BY 1")
def shard_counts(spark, folder):
    return table(spark, folder, "problems").groupBy(splits.shard("pos", 8).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


_GRADED = f"{R}, g AS (SELECT problem_id, rollout_id, response_token_count AS tokens, {REWARD} AS reward FROM r WHERE verifier_status IN ('AC', 'WA')), k AS (SELECT *, CASE WHEN reward = 1 THEN 'chosen' WHEN reward >= 0.5 THEN 'hard' WHEN reward <= 0.2 THEN 'easy' END AS grade FROM g)"
_PAIRED = f"{_GRADED}, pr AS (SELECT c.problem_id, c.rollout_id AS chosen_id, c.reward - x.reward AS margin, x.grade AS kind, x.rollout_id AS rejected_id, abs(x.tokens - c.tokens) AS gap, x.tokens AS xt, c.tokens AS ct FROM k c JOIN k x ON c.problem_id = x.problem_id AND c.grade = 'chosen' AND x.grade IN ('hard', 'easy'))"


@query(f"""WITH {_PAIRED} SELECT problem_id, chosen_id, kind, gap FROM (SELECT *, row_number() OVER (PARTITION BY chosen_id, kind ORDER BY gap) AS n FROM pr) WHERE n = 1""")
def preference_pairs(spark, folder):
    rows = delivered(spark, folder)
    t = rows.select("rollout_id", "response_token_count")
    pairs = preferences.preference_pairs(rows)
    a, b = t.select(F.col("rollout_id").alias("chosen_id"), F.col("response_token_count").alias("x")), t.select(F.col("rollout_id").alias("rejected_id"), F.col("response_token_count").alias("y"))
    return pairs.join(a, "chosen_id").join(b, "rejected_id").select("problem_id", "chosen_id", "kind", F.abs(F.col("x") - F.col("y")).alias("gap"))


@query(f"WITH {_PAIRED} SELECT problem_id, chosen_id FROM pr GROUP BY 1, 2 HAVING count(DISTINCT kind) = 2")
def matched_triples(spark, folder):
    return preferences.matched_triples(preferences.preference_pairs(delivered(spark, folder))).select("problem_id", "chosen_id")


@query(f"""WITH {_PAIRED}, n AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY chosen_id, kind ORDER BY gap, xt > ct, rejected_id) = 1)
SELECT problem_id, chosen_id, rejected_id, kind, margin FROM n WHERE xt // 256 = ct // 256""")
def length_matched_pairs(spark, folder):
    rows = delivered(spark, folder)
    return preferences.length_matched(preferences.preference_pairs(rows), rows, 256)


_Q = "list_sort(list(success))[round_even({q} / 100.0::DOUBLE * (count(*) - 1), 0)::BIGINT + 1]"


@query(f"WITH {R}, p AS (SELECT problem_id, count_if(verifier_status = 'AC') / count(*) AS success FROM r GROUP BY 1), q AS (SELECT {_Q.format(q=25)} AS a, {_Q.format(q=50)} AS b, {_Q.format(q=75)} AS c FROM p) SELECT problem_id, success, (success > a)::INT + (success > b)::INT + (success > c)::INT AS stratum FROM p, q")
def difficulty_strata(spark, folder):
    return preferences.difficulty_strata(delivered(spark, folder))


@query()
def bootstrap_pass_rate(spark, folder):
    return rollouts.bootstrap_mean(delivered(spark, folder), "problem_id", (F.col("verifier_status") == "AC").cast("double"), 200, 20260904)


def _pairs_to_build(spark: SparkSession, folder: str) -> DataFrame:
    from .curation import one_problem

    p = one_problem(table(spark, folder, "problems")).select("source", "source_id", "problem_id", sequences.prompt_text(F.col("prompt")).alias("prompt"), F.coalesce("reference_code", F.lit("")).alias("code"))
    r = table(spark, folder, "reasoning").where("reasoning IS NOT NULL").select("source", "source_id", F.concat("reasoning", F.lit("\n")).alias("response"), "reasoning_id")
    return p.join(r, ["source", "source_id"]).select(F.concat_ws("#", "problem_id", F.col("reasoning_id").cast("string")).alias("problem_id"), "prompt", F.concat("response", F.lit("```python\n"), "code", F.lit("```\n")).alias("response"), "code")


# What construction gives over characters: p, r and s are the lengths of prompt and response and the place of the code.
_SPACES = "[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_BUILT = f"""{ONE}, b AS (SELECT o.problem_id || '#' || r.reasoning_id AS problem_id, '### Problem' || chr(10) || o.prompt || chr(10) || chr(10) || '### Solution' || chr(10) AS prompt,
 r.reasoning || chr(10) || '```python' || chr(10) || coalesce(o.reference_code, '') || '```' || chr(10) AS response, coalesce(o.reference_code, '') AS code FROM one o JOIN reasoning r USING (source, source_id) WHERE r.reasoning IS NOT NULL),
l AS (SELECT *, coalesce(length(prompt), 0) AS p, length(response) AS r, CASE WHEN regexp_matches(code, '[^{_SPACES[1:]}') AND contains(response, code) THEN instr(response, code) - 1 END AS s,
 length(response) - length(regexp_replace(response, '^{_SPACES}+', '')) AS lead, regexp_extract(response, '```[A-Za-z0-9_+-]*[ \\t]*\\n') AS opener FROM b),
k AS (SELECT *, p + r + 1 AS f, substr(response, lead + 1, 7) = '<think>' AS thinks, instr(substr(response, lead + 8), '</think>') AS away FROM l),
z AS (SELECT *, CASE WHEN s IS NULL THEN 'unlocatable_final_code' WHEN thinks AND NOT (away > 0 AND lead + 6 + away < s) THEN 'unclosed_or_late_think' END AS bad,
 CASE WHEN thinks THEN lead + 6 + away WHEN opener <> '' AND instr(response, opener) - 1 + length(opener) <= s THEN instr(response, opener) - 1 ELSE s END AS tail FROM k)"""
_V1 = _BUILT + """, u AS (SELECT *, CASE WHEN f <= 2048 THEN NULL WHEN s IS NULL THEN 'unlocatable_final_code' WHEN 2048 - p - (r - s) - 1 < 0 THEN 'prompt_plus_preserved_code_overflow' END AS reason, f <= 2048 AS fits,
 least(s, greatest(2048 - p - (r - s) - 1, 0)) AS room FROM z),
v AS (SELECT problem_id, p, f, reason, fits AND reason IS NULL AS full_fit, NOT fits AND reason IS NULL AS cut, CASE WHEN reason = 'unlocatable_final_code' THEN r ELSE coalesce(s, r) END AS original, CASE WHEN reason IS NOT NULL THEN 0 WHEN fits THEN coalesce(s, r) ELSE room END AS retained,
 0 AS suffix, CASE WHEN reason IS NOT NULL THEN '' WHEN fits THEN response ELSE substr(response, 1, room) || substr(response, s + 1) END AS kept_text, 0 AS end_token FROM u)"""
_V2 = _BUILT + """, u AS (SELECT *, r - tail AS sl, 1023 - (r - tail) AS room, r + 1 <= 1024 AS fits, CASE WHEN s = 0 THEN r ELSE s END AS place FROM z),
w AS (SELECT *, CASE WHEN bad IS NOT NULL THEN bad WHEN fits AND f > 2048 THEN 'prompt_plus_response_over_sequence_budget' WHEN fits THEN NULL WHEN sl + 1 > 1024 THEN 'mandatory_structural_suffix_over_response_budget'
 WHEN thinks AND room < lead + 7 THEN 'reasoning_prefix_cannot_fit' WHEN p + 1024 > 2048 THEN 'prompt_plus_preserved_code_overflow' END AS reason FROM u),
v AS (SELECT problem_id, p, f, reason, fits AND reason IS NULL AS full_fit, NOT fits AND reason IS NULL AS cut, CASE WHEN reason IS NOT NULL THEN r ELSE place END AS original, CASE WHEN reason IS NOT NULL THEN 0 WHEN fits THEN place ELSE room END AS retained,
 CASE WHEN bad IS NOT NULL OR reason = 'prompt_plus_response_over_sequence_budget' THEN 0 ELSE sl END AS suffix, CASE WHEN reason IS NOT NULL THEN '' WHEN fits THEN response ELSE substr(response, 1, room) || substr(response, tail + 1) END AS kept_text, 1 AS end_token FROM w)"""
_V3 = _BUILT + """, w AS (SELECT *, CASE WHEN bad IS NOT NULL THEN bad WHEN r + 1 > 1024 THEN 'natural_response_over_budget' WHEN f > 2048 THEN 'prompt_plus_response_over_sequence_budget' END AS reason FROM z),
v AS (SELECT problem_id, p, f, reason, reason IS NULL AS full_fit, false AS cut, r AS original, CASE WHEN reason IS NULL THEN r ELSE 0 END AS retained, 0 AS suffix, CASE WHEN reason IS NULL THEN response ELSE '' END AS kept_text, 1 AS end_token FROM w)"""
_TOLD = """SELECT problem_id, p::INT AS prompt_tokens, f::INT AS full_sequence_tokens, CASE WHEN reason IS NULL THEN p + length(kept_text) + 1 ELSE 0 END::INT AS final_sequence_tokens, full_fit, cut AS reasoning_truncated, original::INT AS original_reasoning_tokens, retained::INT AS retained_reasoning_tokens,
suffix::INT AS mandatory_suffix_tokens, reason IS NOT NULL AS dropped, reason AS drop_reason, sha256(kept_text) AS response_hash, CASE WHEN reason IS NULL THEN length(kept_text) + end_token ELSE 0 END::BIGINT AS supervised_tokens FROM v"""


def _built(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return sequences.build_sequences(_pairs_to_build(spark, folder), version, 2048, 1024)


def _told(rows: DataFrame) -> DataFrame:
    """The columns of constructed sequences, with the response as its hash and the labels as their number; `integrity` looks at the tokens."""
    kept = [
        "problem_id", "prompt_tokens", "full_sequence_tokens", "final_sequence_tokens", "full_fit", "reasoning_truncated", "original_reasoning_tokens", "retained_reasoning_tokens", "mandatory_suffix_tokens", "dropped",
        "drop_reason",
    ]
    return rows.select(*kept, F.sha2("final_response", 256).alias("response_hash"), sequences.supervised_tokens(F.col("labels")).alias("supervised_tokens"))


@query(f"WITH {_V1} {_TOLD}")
def sft_v1(spark, folder):
    return _told(_built(spark, folder, 1))


@query(f"WITH {_V2} {_TOLD}")
def sft_v2(spark, folder):
    return _told(_built(spark, folder, 2))


@query(f"WITH {_V3} {_TOLD}")
def sft_v3(spark, folder):
    return _told(_built(spark, folder, 3))


def _stats_sql(version: str) -> str:
    return f"""WITH {version}, t AS ({_TOLD}) SELECT count(*) AS rows, count_if(NOT dropped)::BIGINT AS usable, count_if(dropped)::BIGINT AS dropped, count_if(full_fit)::BIGINT AS full_fit, count_if(reasoning_truncated)::BIGINT AS truncated,
max(final_sequence_tokens) AS longest, sum(supervised_tokens)::BIGINT AS supervised_tokens FROM t"""


@query(_stats_sql(_V1))
def sft_v1_stats(spark, folder):
    return sequences.construction_stats(_built(spark, folder, 1))


@query(_stats_sql(_V2))
def sft_v2_stats(spark, folder):
    return sequences.construction_stats(_built(spark, folder, 2))


@query(_stats_sql(_V3))
def sft_v3_stats(spark, folder):
    return sequences.construction_stats(_built(spark, folder, 3))


@query(f"WITH {_V2}, t AS ({_TOLD}) SELECT problem_id, ['labels_align', 'eos_supervised', 'response_supervised', 'labels_copy_tokens'] AS failed FROM t WHERE NOT dropped AND final_sequence_tokens % 5 = 0")
def sft_v2_integrity(spark, folder):
    """Sequences of version 2, every fifth length of which has lost its last label."""
    rows = _built(spark, folder, 2)
    damaged = F.when(F.col("final_sequence_tokens") % 5 == 0, F.slice("labels", F.lit(1), F.greatest(F.size("labels") - 1, F.lit(0)))).otherwise(F.col("labels"))
    return sequences.integrity(rows.withColumn("labels", damaged), 2048, 1024, 3)


@query(f"WITH {_BUILT} SELECT coalesce(bad, 'valid') AS reason, count(*) AS n FROM z GROUP BY 1")
def response_structure(spark, folder):
    """Structure of every reasoning text with its problem's code appended, by validity reason."""
    rows = sequences.build_sequences(_pairs_to_build(spark, folder), 3, 1 << 20, 1 << 20)
    return rows.groupBy(F.coalesce("drop_reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query()
def verify_reference_code(spark, folder):
    """Every problem's reference code against its own test cases; programs that wait for more input end at once."""
    from .curation import one_problem

    rows = one_problem(table(spark, folder, "problems")).where("reference_code IS NOT NULL").select("problem_id", F.col("reference_code").alias("code"), "tests")
    out = verify.verify_codes(rows, sandbox=verify.Sandbox(wall_time_seconds=1.0, cpu_time_seconds=1, memory_mb=512))
    return out.select("problem_id", "status", "passed", "total", verify.failure_class(F.col("status"), F.col("error_type"), F.col("error_message")).alias("failure_class"))
