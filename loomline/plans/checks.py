"""Queries of gates, frozen manifests, reports, source rows and files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_tests, keys, stats, text
from ..functions.storage import checkpointed
from ..operators import gates, joins, overlap, qualify, rollouts, sequences, splits, validate, verify
from ..sources import files, jsonl, ordinal
from .curation import _ASSIGNED, _BLOCK, _GRAMS, _MANIFEST, _NINE, _TESTS, ONE, _heldout, _is, _strip, nine_overlaps, one_problem, table
from .details import _shared
from .evaluation import _V1, R, _pairs_to_build, _tokens, delivered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Rollouts as stream candidates: dataset, split and index are the parts of problem_id.
@query(f"""WITH {R}, s AS (SELECT rollout_id AS pos, split_part(problem_id, ':', 1) AS d, split_part(problem_id, ':', 2) AS s, try_cast(split_part(problem_id, ':', 3) AS BIGINT) AS i, verifier_status AS j, testcase_pass_rate AS p, raw_response AS t FROM r),
k AS (SELECT *, CASE WHEN d NOT IN ('kodewell', 'arbory', 'lintel', 'holdout') THEN 'dataset_not_selected' WHEN i IS NULL THEN 'bad_index' WHEN s = '' THEN 'missing_source_split' END AS early,
       CASE WHEN j <> 'AC' THEN 'bad_judgement' WHEN p IS NULL OR p < 1.0 THEN 'low_pass_rate' WHEN NOT {_is('t')} THEN 'missing_reasoning' END AS own FROM s),
f AS (SELECT d, s, i, min(pos) AS first FROM k WHERE early IS NULL AND own IS NULL GROUP BY ALL)
SELECT pos, CASE WHEN early IS NOT NULL THEN early WHEN pos > first THEN 'duplicate_problem' ELSE own END AS reject_reason FROM k LEFT JOIN f USING (d, s, i)""")
def candidate_cascade(spark, folder):
    part = lambda k: F.get(F.split("problem_id", ":"), F.lit(k))
    rows = delivered(spark, folder).select(
        F.col("rollout_id").alias("pos"), part(0).alias("dataset"), part(1).alias("split"), part(2).alias("index"), F.col("verifier_status").alias("judgement"), F.col("testcase_pass_rate").alias("pass_rate"),
        F.col("raw_response").alias("reasoning"),
    )
    return joins.candidate_cascade(rows, "pos", ["kodewell", "arbory", "lintel", "holdout"], "ac", 1.0).select("pos", "reject_reason")


@query(f"""SELECT pos, CASE WHEN source_id LIKE '%:%' THEN split_part(source_id, ':', 1) ELSE 'none' END || ':' || pos AS source_id, CASE WHEN {_is('difficulty')} THEN {_strip('difficulty')} ELSE 'unknown' END AS difficulty,
sha256({_strip('prompt')}) AS prompt_hash, sha256({_strip('reference_code')}) AS code_hash, len(tests)::INT AS n_tests FROM problems WHERE {_is('prompt')} AND {_is('reference_code')} AND len(tests) > 0""")
def source_rows(spark, folder):
    """Problems as source rows with JSON columns, and back."""
    rows = table(spark, folder, "problems").select(
        F.col("source").alias("dataset"), F.lower(F.coalesce(keys.source_split("source_id"), F.lit("none"))).alias("split"), F.col("pos").alias("index"), F.col("prompt").alias("question"), "difficulty",
        F.lit(None).cast("string").alias("url"), F.to_json(F.struct(F.col("tests.input").alias("inputs"), F.col("tests.output").alias("outputs"))).alias("input_output"),
        F.to_json(F.array_compact(F.array("reference_code"))).alias("solutions"),
    )
    made = joins.source_rows(rows)
    return made.select(
        F.col("metadata.source_index").alias("pos"), "source_id", "difficulty", F.sha2("prompt", 256).alias("prompt_hash"), F.sha2("reference_code", 256).alias("code_hash"), F.size("tests").alias("n_tests")
    )


@query("SELECT pos, found, CASE WHEN found THEN h END AS code_hash FROM (SELECT pos, pos % 7 <> 0 AND reference_code IS NOT NULL AND trim(reference_code) <> '' AS found, sha256(reference_code) AS h FROM problems)")
def json_solutions(spark, folder):
    doc = F.when(F.col("pos") % 7 == 0, F.lit("no array")).otherwise(F.to_json(F.array_compact(F.array("reference_code", F.lit("  ")))))
    first = F.get(json_tests.solutions(doc), F.lit(0))
    return table(spark, folder, "problems").select("pos", first.isNotNull().alias("found"), F.sha2(first, 256).alias("code_hash"))


@query("WITH p AS (SELECT DISTINCT problem_id, split FROM split_manifest WHERE split = 'dev') SELECT 'same' AS case, count(*) AS rows_a, count(*) AS rows_b, true AS passed FROM p UNION ALL SELECT 'one_less', count(*) - 1, count(*), false FROM p UNION ALL SELECT 'changed', count(*), count(*), false FROM p")
def split_equality_gate(spark, folder):
    """A split written as a file and read back, against the filtered whole; then with a row less, and with a changed row."""
    whole = table(spark, folder, "split_manifest").select("problem_id", "split").distinct().where("split = 'dev'")
    path = _shared(spark)
    jsonl.write_jsonl(whole, path, keys.stable_json(problem_id=keys.json_string("problem_id"), split=keys.json_string("split")), order="problem_id")
    part = checkpointed(jsonl.read_jsonl(spark, path, "problem_id string, split string"))
    first = part.agg(F.min("problem_id").alias("f"))
    marked = part.crossJoin(F.broadcast(first))  # one row
    cases = {"same": part, "one_less": marked.where("problem_id <> f").drop("f"), "changed": marked.withColumn("split", F.when(F.col("problem_id") == F.col("f"), "pt").otherwise(F.col("split"))).drop("f")}
    out = None
    for name, rows in cases.items():
        one = gates.same_order(rows, whole, "problem_id", F.concat_ws("|", "problem_id", "split")).select(F.lit(name).alias("case"), "rows_a", "rows_b", "passed")
        out = one if out is None else out.unionByName(one)
    return out


@query("WITH p AS (SELECT DISTINCT problem_id FROM problems) SELECT count(*) AS rows, sha256('[' || string_agg(to_json(problem_id)::VARCHAR, ',' ORDER BY problem_id) || ']') AS list_hash FROM p")
def manifest_hash(spark, folder):
    return rollouts.list_hash(table(spark, folder, "problems").select("problem_id").distinct(), "problem_id", F.col("problem_id"))


_VALID = f"v AS (SELECT problem_id, split FROM c GROUP BY 1, 2), g AS (SELECT count(*) AS records, count_if(NOT ({_is('prompt')} AND {_is('reference_code')} AND {_is('difficulty')})) AS invalid FROM v JOIN one USING (problem_id))"


@query(f"WITH {_TESTS}, {_MANIFEST}, {_VALID}, {_GRAMS.replace(ONE + ',', '')}, {_BLOCK}, {_NINE} SELECT records, invalid, (SELECT sum(ids + texts + near) FROM nine)::BIGINT AS overlaps, 2::BIGINT AS manifest_issues, false AS passed FROM g")
def data_gate(spark, folder):
    """The gate over processed problems, whose manifest lacks its first row and has a changed second one."""
    rows = checkpointed(_heldout(spark, folder).where("reward_tests IS NOT NULL").withColumn("reasoning", F.lit("r")))
    fields = ["split", "reward_test_ids", "heldout_test_ids", "reward_fingerprints", "heldout_fingerprints"]
    expected = splits.test_manifest(rows).withColumn("o", F.lit(1))
    two = [r.problem_id for r in expected.select("problem_id").orderBy("problem_id").limit(2).collect()]
    actual = expected.where(F.col("problem_id") != two[0]).withColumn("heldout_test_ids", F.when(F.col("problem_id") == two[1], F.array(F.lit("x"))).otherwise(F.col("heldout_test_ids")))
    return gates.data_gate(rows, validate.valid_processed(), nine_overlaps(spark, folder), joins.manifest_diff(expected, actual, fields, "o"))


# A manifest frozen from split_manifest: hashes of the prompts, one of them stale where the split is dev.
_FROZEN = f"{ONE}, m AS (SELECT problem_id, min(split) AS split FROM split_manifest GROUP BY 1), st AS (SELECT problem_id, CASE WHEN split IS NULL THEN 'missing' WHEN split = 'dev' THEN 'mismatch' WHEN split = 'sft' THEN 'selected' ELSE 'not_member' END AS frozen FROM one LEFT JOIN m USING (problem_id))"


def _frozen(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = one_problem(table(spark, folder, "problems"), response_hash=F.sha2(F.coalesce("prompt", F.lit("")), 256)).select("problem_id", "response_hash")
    m = table(spark, folder, "split_manifest").groupBy("problem_id").agg(F.min("split").alias("split"))
    known = m.join(rows, "problem_id", "left")
    stale = F.when(F.col("split") == "dev", F.lit("stale")).otherwise(F.col("response_hash"))
    return rows, known.select("problem_id", stale.alias("source_response_hash"), (F.col("split") == "sft").alias("member"))


@query(f"WITH {_FROZEN} SELECT problem_id, frozen FROM st")
def frozen_status(spark, folder):
    rows, manifest = _frozen(spark, folder)
    return joins.frozen_status(rows, manifest, F.col("response_hash")).select("problem_id", "frozen")


@query(f"WITH {_FROZEN} SELECT problem_id FROM st WHERE frozen = 'selected'")
def frozen_selection(spark, folder):
    """Members of the manifest, from rows that it knows and whose hash it has; others would fail the query."""
    rows, manifest = _frozen(spark, folder)
    fresh = manifest.where("source_response_hash <> 'stale'")
    return joins.frozen_selection(rows.join(fresh.select("problem_id"), "problem_id", "left_semi"), fresh, F.col("response_hash")).select("problem_id")


@query(f"WITH {_FROZEN} SELECT count_if(frozen = 'selected') AS selected, count_if(frozen = 'missing') AS missing, count_if(frozen = 'mismatch') AS mismatched, 100::BIGINT AS expected, false AS passed FROM st")
def frozen_gate(spark, folder):
    rows, manifest = _frozen(spark, folder)
    return gates.frozen_gate(joins.frozen_status(rows, manifest, F.col("response_hash")), 100)


_NR = "list_sort(list({c}))[round_even({q}::DOUBLE * (count({c}) - 1), 0)::BIGINT + 1]"
_PROFILE = f"{ONE}, t AS (SELECT split_part(source_id, ':', 1) AS split, pos, problem_id, (coalesce(length(prompt), 0) + 27)::DOUBLE AS p, coalesce(length(reference_code), 0)::DOUBLE AS c FROM one)"


@query(f"WITH {_PROFILE}, u AS (SELECT split, 'prompt' AS field, p AS v FROM t UNION ALL SELECT split, 'code', c FROM t) SELECT split, field, count(*)::DOUBLE AS count, {_NR.format(c='v', q=0.5)} AS p50, {_NR.format(c='v', q=0.95)} AS p95, max(v) AS max FROM u GROUP BY 1, 2")
def token_profile(spark, folder):
    rows = _profiled(spark, folder)
    long = rows.unpivot(["split"], ["prompt_tokens", "code_tokens"], "field", "tokens").withColumn("field", F.regexp_replace("field", "_tokens", ""))
    return stats.numeric_stats(long, "tokens", (50, 95), ("split", "field"))


def _profiled(spark: SparkSession, folder: str) -> DataFrame:
    one = one_problem(table(spark, folder, "problems")).select("problem_id", "pos", keys.id_label("source_id").alias("split"), sequences.prompt_text(F.coalesce("prompt", F.lit(""))).alias("text"), "reference_code")
    counts = sequences.token_counts(one, {"prompt_tokens": "text", "code_tokens": "reference_code"})
    return checkpointed(one.select("problem_id", "pos", "split").join(counts, "problem_id"))


@query(f"WITH {_PROFILE} SELECT split, count_if(p + 256 > 900) AS overflow, coalesce(list(problem_id ORDER BY pos) FILTER (WHERE p + 256 > 900)[:20], []) AS sample FROM t GROUP BY 1")
def context_overflow(spark, folder):
    return sequences.context_overflow(_profiled(spark, folder), "prompt_tokens", 256, 900, "split", "pos")


_RULES = {"short": "response_token_count <= 512", "medium": "response_token_count <= 2048", "solved": "verifier_status = 'AC'", "none": "response_token_count < 0"}
_BY_RULE = " UNION ALL ".join(f"SELECT '{n}' AS rule, * FROM r WHERE {c}" for n, c in _RULES.items())


@query(f"""WITH {R}, s AS (SELECT 'all' AS rule, * FROM r UNION ALL {_BY_RULE}), l AS (SELECT rule, 'model_revision' AS field, coalesce(model_revision, 'None') AS value FROM s UNION ALL SELECT rule, 'verifier_status', coalesce(verifier_status, 'None') FROM s),
c AS (SELECT rule, field, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY rule, field) AS total FROM l GROUP BY rule, field, value), w AS (SELECT * FROM c WHERE rule = 'all'), q AS (SELECT unnest({list(_RULES)}) AS rule),
z AS (SELECT rule, count(*) AS size FROM s GROUP BY 1)
SELECT q.rule, coalesce(z.size, 0) AS count, coalesce(z.size, 0) / w.total AS rate, w.field, w.value, coalesce(c.n / c.total, 0) AS share, coalesce(c.n / c.total, 0) - w.n / w.total AS delta
FROM q CROSS JOIN w LEFT JOIN c ON c.rule = q.rule AND c.field = w.field AND c.value = w.value LEFT JOIN z ON z.rule = q.rule""")
def subset_summary(spark, folder):
    return stats.subset_summary(delivered(spark, folder), {n: F.expr(c) for n, c in _RULES.items()}, "model_revision", "verifier_status")


_FLAG = "starts_with(b, '<think>')"


@query(f"""WITH {R}, a AS (SELECT *, regexp_replace(coalesce(raw_response, ''), '^\\s+', '') AS b FROM r), f AS (SELECT *, {_FLAG} AS th, {_FLAG} AND contains(substr(b, 8), '</think>') AS closed, contains(b, '```') AS fenced FROM a)
SELECT model_revision, count(*) AS total, count_if(verifier_status = 'AC') / count(*) AS pass_at_1, avg(coalesce(reward_passed / nullif(reward_total, 0), 0)) - avg(coalesce(heldout_passed / nullif(heldout_total, 0), 0)) AS generalization_gap,
count_if(th) AS starts_with_think_count, count_if(closed) AS closed_think_count, count_if(th AND NOT closed) AS unclosed_think_count, count_if(fenced) AS fenced_code_count, count_if(th AND NOT closed) / count(*) AS unclosed_think_rate FROM f GROUP BY 1""")
def format_metrics(spark, folder):
    response = F.coalesce("raw_response", F.lit(""))
    out = rollouts.format_metrics(delivered(spark, folder, f=text.format_flags(response, text.is_text(text.without_think(response)))), "f", "model_revision")
    return out.select("model_revision", "total", "pass_at_1", "generalization_gap", "starts_with_think_count", "closed_think_count", "unclosed_think_count", "fenced_code_count", "unclosed_think_rate")


@query(f"WITH {R} SELECT sum(response_token_count % 11)::BIGINT AS supervised_tokens FROM r")
def supervised_tokens(spark, folder):
    labels = sequences.response_labels(F.col("input_ids"), F.col("p"), F.col("n"))
    return _tokens(spark, folder).agg(F.sum(sequences.supervised_tokens(labels)).alias("supervised_tokens"))


@query(f"WITH {R} SELECT rollout_id, 2048 AS max_new_tokens, response_token_count >= 2048 AS hit_max_new_tokens FROM r")
def final_policy(spark, folder):
    rows = delivered(spark, folder)
    return rollouts.final_policy(rows, 2048, rows.count()).select("rollout_id", "max_new_tokens", "hit_max_new_tokens")


@query(f"WITH {R} SELECT rollout_id, verifier_status, CASE WHEN verifier_status <> 'AC' THEN verifier_status || '|' || coalesce(testcase_passed::VARCHAR, 'none') END AS failure_key FROM r")
def compact_rollouts(spark, folder):
    return rollouts.compact(delivered(spark, folder)).select("rollout_id", "verifier_status", "failure_key")


_ENDS = "e AS (SELECT problem_id, reference_code AS c, prompt || chr(10) || replace(reference_code, ' ', '  ') || chr(10) AS loose, prompt || chr(10) || reference_code || chr(10) AS t FROM one WHERE prompt IS NOT NULL AND reference_code IS NOT NULL)"


@query(f"WITH {ONE}, {_ENDS} SELECT problem_id, CASE WHEN {_is('c')} THEN instr(t, c) - 1 END AS start, CASE WHEN {_is('c')} THEN instr(t, c) - 1 + length(c) END AS stop, CASE WHEN NOT {_is('c')} THEN NULL WHEN contains(loose, c) THEN 'exact' ELSE 'whitespace_normalized' END AS loose_method FROM e")
def locate_code(spark, folder):
    """The reference code behind the prompt it belongs to, as it is and with doubled blanks."""
    rows = one_problem(table(spark, folder, "problems")).where("prompt IS NOT NULL AND reference_code IS NOT NULL")
    exact, loose = (F.concat("prompt", F.lit("\n"), c, F.lit("\n")) for c in (F.col("reference_code"), F.replace("reference_code", F.lit(" "), F.lit("  "))))
    found = rows.select("problem_id", text.locate_code(exact, "reference_code").alias("a"), text.locate_code(loose, "reference_code").alias("b"))
    return found.select("problem_id", F.col("a.start").alias("start"), F.col("a.end").alias("stop"), F.col("b.method").alias("loose_method"))


# Documents against evaluation items: doc_id and item_id as ids of one space, lang and topic-free text, thread keys as urls.
_EXTERNAL = """
d AS (SELECT doc_id::VARCHAR AS id, thread_key AS url, trim(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g')) AS norm FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id::VARCHAR AS id, 'thread:warmup:' || (item_id % 2) AS url, trim(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g')) AS norm FROM eval_items),
w AS (SELECT *, CASE WHEN norm = '' THEN [] ELSE string_split(norm, ' ') END AS w FROM (SELECT 'd' AS kind, * FROM d UNION ALL SELECT 'e', * FROM e)),
s AS (SELECT kind, id, url, norm, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [norm] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS grams FROM w),
g AS (SELECT kind, id, len(grams) AS n, unnest(grams) AS g FROM s),
c AS (SELECT a.id AS p, b.id AS q, count(*) AS k, any_value(a.n) AS n, any_value(b.n) AS m FROM (SELECT * FROM g WHERE kind = 'd') a JOIN (SELECT * FROM g WHERE kind = 'e') b USING (g) GROUP BY 1, 2),
o AS (SELECT a.id AS problem_id, b.id AS external_id, 'id' AS kind FROM s a JOIN s b ON a.id = b.id AND a.kind = 'd' AND b.kind = 'e'
 UNION ALL SELECT a.id, b.id, 'url' FROM s a JOIN s b ON a.url = b.url AND a.kind = 'd' AND b.kind = 'e'
 UNION ALL SELECT a.id, b.id, 'text' FROM s a JOIN s b ON a.norm = b.norm AND a.norm <> '' AND a.kind = 'd' AND b.kind = 'e'
 UNION ALL SELECT p, q, 'near' FROM c WHERE k / (n + m - k) >= 0.5 UNION ALL SELECT p, q, 'contained' FROM c WHERE k / m >= 0.1)
"""


@query(f"WITH {_EXTERNAL} SELECT external_id, kind, count(*) AS n FROM o GROUP BY 1, 2")
def external_overlap(spark, folder):
    docs = table(spark, folder, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("problem_id"), F.col("doc_id").alias("pos"), F.col("text").alias("prompt"), F.col("thread_key").alias("url"))
    items = table(spark, folder, "eval_items").select(
        F.col("item_id").cast("string").alias("problem_id"), F.col("item_id").alias("pos"), F.col("text").alias("prompt"), F.concat(F.lit("thread:warmup:"), (F.col("item_id") % 2).cast("string")).alias("url")
    )
    return overlap.external_overlap(docs, items, 5, 0.5, 0.1).groupBy("external_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def _written(spark: SparkSession, folder: str) -> str:
    """One JSONL file of (id, problem_id) in order of pos, with a blank line after it."""
    path = _shared(spark)
    rows = table(spark, folder, "problems").select("pos", "problem_id")
    line = keys.stable_json(id=F.when(F.col("pos") % 2 == 0, F.col("pos").cast("string")), problem_id=keys.json_string("problem_id"))
    jsonl.write_jsonl(rows, path, line, order="pos", single=True)
    return path


@query("SELECT ordinal, sha256('{\"id\":' || CASE WHEN pos % 2 = 0 THEN pos::VARCHAR ELSE 'null' END || ',\"problem_id\":' || to_json(problem_id)::VARCHAR || '}') AS line_hash FROM (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS ordinal FROM problems)")
def line_ordinals(spark, folder):
    return ordinal.numbered_lines(spark, _written(spark, folder)).select("ordinal", F.sha2("value", 256).alias("line_hash"))


@query("SELECT CASE WHEN pos % 2 = 0 THEN pos ELSE ordinal END AS index, problem_id FROM (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS ordinal FROM problems) WHERE CASE WHEN pos % 2 = 0 THEN pos ELSE ordinal END IN (SELECT rollout_id FROM rollouts WHERE verifier_status = 'AC')")
def line_rows_wanted(spark, folder):
    wanted = table(spark, folder, "rollouts").where("verifier_status = 'AC'").select(F.col("rollout_id").alias("index"))
    return ordinal.wanted_lines(spark, _written(spark, folder), "id long, problem_id string", wanted).select("index", "problem_id")


@query("SELECT sha256(string_agg('{\"id\":' || CASE WHEN pos % 2 = 0 THEN pos::VARCHAR ELSE 'null' END || ',\"problem_id\":' || to_json(problem_id)::VARCHAR || '}' || chr(10), '' ORDER BY pos)) AS sha256 FROM problems")
def file_hash(spark, folder):
    return files.file_hashes(spark, _written(spark, folder)).where("file LIKE 'part-%'").select("sha256")


@query()
def qualification(spark, folder):
    """Every problem's reference code as its attempts, run and rolled up: verdict, failure class, wrong-answer category, candidate flags."""
    rows = one_problem(table(spark, folder, "problems")).where("reference_code IS NOT NULL").select("problem_id", F.col("reference_code").alias("code"), "tests", "prompt")
    box = verify.Sandbox(wall_time_seconds=1.0, cpu_time_seconds=1, memory_mb=512)
    out = checkpointed(verify.diagnosed(rows, box))
    flags = qualify.candidate_flags(F.lit(True), F.col("status") == "AC", F.col("status") == "AC")
    return out.select("problem_id", "status", "failure_class", "wa_category", "first_failure", *(v.alias(k) for k, v in flags.items()))


@query()
def reference_attempts(spark, folder):
    """Up to three programs per problem, stopping at the first accepted one: the code without its last line, then the code itself."""
    rows = one_problem(table(spark, folder, "problems")).where("reference_code IS NOT NULL").select("problem_id", "tests", F.array(F.regexp_replace("reference_code", "[^\\n]*\\n?$", ""), F.col("reference_code")).alias("codes"))
    tried = verify.attempts(rows, "codes", "tests", verify.Sandbox(wall_time_seconds=1.0, cpu_time_seconds=1, memory_mb=512))
    return tried.select("problem_id", F.size("attempts").alias("n"), qualify.best_attempt(F.col("attempts"))["status"].alias("best"), qualify.suspected_test_issue(F.col("attempts")).alias("suspected"))


# Programs made from a problem's first test case, whose verdicts are known: by pos they print its output, the same with blanks at line ends,
# something else, do not compile, raise, or (one in 24) never end.
_KINDS = "CASE pos % 6 WHEN 0 THEN 'AC' WHEN 1 THEN 'AC' WHEN 2 THEN 'WA' WHEN 3 THEN 'CE' WHEN 4 THEN 'RE' ELSE CASE WHEN pos % 24 = 5 THEN 'TLE' ELSE 'RE' END END"


def _programs(spark: SparkSession, folder: str) -> DataFrame:
    rows = one_problem(table(spark, folder, "problems")).where(F.size("tests") > 0).select("problem_id", "pos", F.slice("tests", 1, 1).alias("tests"))
    output = keys.json_string(F.coalesce(F.get("tests", F.lit(0))["output"], F.lit("")))
    shown = [F.concat(F.lit("import sys\nsys.stdout.write("), output, F.lit(end)) for end in (")\n", " + '  \\n\\n')\n", " + 'x')\n")]
    others = [F.lit(c) for c in ("def\n", "raise ValueError('boom')\n", "while True:\n    pass\n")]
    kind = F.when((F.col("pos") % 6 == 5) & (F.col("pos") % 24 != 5), F.lit(5)).otherwise((F.col("pos") % 6).cast("int") + 1)
    code = F.element_at(F.array(*shown, *others), kind)
    return rows.withColumns({"program": code, "right": shown[0]})


@query(f"WITH {ONE}, p AS (SELECT *, {_KINDS} AS status FROM one WHERE len(tests) > 0) SELECT problem_id, status, CASE status WHEN 'AC' THEN 1 ELSE 0 END AS passed, 1 AS total, CASE status WHEN 'AC' THEN 'accepted' WHEN 'CE' THEN 'bad_reference_solution_or_extraction' WHEN 'TLE' THEN 'timeout_or_resource_limit' WHEN 'WA' THEN 'wrong_output_source_data_or_judging_mismatch' ELSE 'runtime_error_requires_inspection' END AS failure_class, CASE WHEN status NOT IN ('AC', 'CE') THEN status END AS first_status FROM p")
def verified_responses(spark, folder):
    """Responses with a fenced program each: extracted, run against a test case, rolled up and classified."""
    rows = _programs(spark, folder).withColumn("response", F.concat(F.lit("<think>\nso\n</think>\nThe program:\n```python\n"), "program", F.lit("```\n")))
    out = verify.verify_responses(rows.select("problem_id", "response", "tests"), "response", "tests", verify.Sandbox(wall_time_seconds=2.0, cpu_time_seconds=1, memory_mb=512))
    kind = verify.failure_class(F.col("status"), F.col("error_type"), F.col("error_message"))
    return out.select("problem_id", "status", "passed", "total", kind.alias("failure_class"), verify.first_failure(F.col("status"), F.col("runs"))["status"].alias("first_status"))


@query(f"WITH {ONE}, p AS (SELECT *, CASE WHEN pos % 6 = 5 AND pos % 24 <> 5 THEN 4 ELSE pos % 6 END AS k FROM one WHERE len(tests) > 0) SELECT problem_id, (CASE WHEN k < 2 THEN 1 ELSE 2 END)::INT AS tried, (CASE WHEN k < 2 THEN 1 ELSE 2 END)::INT AS best_index, 'AC' AS best, CASE WHEN k < 2 THEN NULL WHEN k = 2 THEN 'WA' WHEN k = 3 THEN 'CE' WHEN k = 4 THEN 'RE' ELSE 'TLE' END AS first_failed, CASE WHEN k = 5 THEN 'TLE' END AS slow FROM p")
def solution_attempts(spark, folder):
    """A program per problem and, after it, right ones: attempts stop at the first accepted one, and a timeout is run again with more time."""
    rows = _programs(spark, folder).select("problem_id", "tests", F.array("program", "right", "right", "right").alias("codes"))
    box = {"cpu_time_seconds": 1, "memory_mb": 512}
    tried = verify.attempts(rows, "codes", "tests", verify.Sandbox(wall_time_seconds=2.0, **box), slow=verify.Sandbox(wall_time_seconds=2.5, **box))
    best, first = qualify.best_attempt(F.col("attempts")), F.get("attempts", F.lit(0))
    failed = F.when(first["status"] != "AC", first["status"])
    return tried.select("problem_id", F.size("attempts").alias("tried"), best["attempt_index"].alias("best_index"), best["status"].alias("best"), failed.alias("first_failed"), first["slow_status"].alias("slow"))


@query()
def target_diagnostic(spark, folder):
    """Where the reference code stands in each response: counts, and nearest-rank percentiles of its place."""
    rows = checkpointed(sequences.target_diagnostic(_pairs_to_build(spark, folder), 2048))
    n = F.count(F.lit(1))
    counts = rows.agg(
        n.alias("total"), F.count_if("exact").alias("exact"), F.count_if("normalized").alias("normalized"), F.count_if("full_fit").alias("full_fit"), F.count_if("reasoning_truncated").alias("truncated"),
        F.count_if(F.col("drop_reason") == "unlocatable_final_code").alias("unlocatable"), F.count_if(F.col("drop_reason") == "prompt_plus_preserved_code_overflow").alias("overflow"),
    )
    place = stats.numeric_stats(rows, "start_ratio", (5, 50, 95))
    return counts.crossJoin(place.select(F.round("p5", 6).alias("start_p5"), F.round("p50", 6).alias("start_p50"), F.round("p95", 6).alias("start_p95")))  # one row each


SQL["target_diagnostic"] = f"""WITH {_V1}, x AS (SELECT s / r::DOUBLE AS v FROM u WHERE s IS NOT NULL)
SELECT (SELECT count(*) FROM v) AS total, (SELECT count_if(code <> '' AND contains(response, code)) FROM u) AS exact, (SELECT count_if(s IS NOT NULL) FROM u) AS normalized, (SELECT count_if(f <= 2048) FROM u) AS full_fit,
(SELECT count(*) FROM v WHERE cut) AS truncated, (SELECT count(*) FROM v WHERE reason = 'unlocatable_final_code') AS unlocatable, (SELECT count(*) FROM v WHERE reason = 'prompt_plus_preserved_code_overflow') AS overflow,
round({_NR.format(c='v', q=0.05)}, 6) AS start_p5, round({_NR.format(c='v', q=0.5)}, 6) AS start_p50, round({_NR.format(c='v', q=0.95)}, 6) AS start_p95 FROM x"""
