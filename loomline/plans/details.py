"""Queries of sources, scalar rules and smaller operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_tests, keys, stats, text
from ..functions.storage import checkpointed
from ..operators import gates, joins, qualify, rollouts, sequences, splits, validate, verify
from ..sources import files, jsonl, ordinal
from .curation import _MANIFEST, _TESTS, ONE, _heldout, _is, _strip, one_problem, table
from .evaluation import R, attempted, delivered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _shared(spark: SparkSession) -> str:
    """A new folder next to the checkpoints, which all executors share."""
    checkpointed(spark.range(1))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


@query("SELECT problem_id, pos, sha256(coalesce(prompt, '')) AS prompt_hash FROM problems")
def jsonl_round_trip(spark, folder):
    path = _shared(spark)
    rows = table(spark, folder, "problems").select("problem_id", "pos", F.coalesce("prompt", F.lit("")).alias("prompt"))
    line = keys.stable_json(problem_id=keys.json_string("problem_id"), pos=F.col("pos").cast("string"), prompt=keys.json_string("prompt"))
    jsonl.write_jsonl(rows, path, line, order="pos")
    return jsonl.read_jsonl(spark, path, "problem_id string, pos long, prompt string").select("problem_id", "pos", F.sha2("prompt", 256).alias("prompt_hash"))


@query("SELECT row_number() OVER () - 1 AS ordinal, pos FROM problems")
def shard_ordinals(spark, folder):
    return ordinal.numbered_shards(spark, f"{folder}/problems.parquet").select("ordinal", "pos")


@query("SELECT ordinal, pos FROM (SELECT row_number() OVER () - 1 AS ordinal, pos FROM problems) WHERE ordinal IN (SELECT DISTINCT rollout_id FROM rollouts WHERE verifier_status = 'AC')")
def shard_rows_wanted(spark, folder):
    wanted = table(spark, folder, "rollouts").where("verifier_status = 'AC'").select(F.col("rollout_id").alias("index"))
    return ordinal.wanted_shards(spark, f"{folder}/problems.parquet", wanted).select("ordinal", "pos")


@query("SELECT problem_id, split FROM split_manifest WHERE split = 'dev'")
def split_scan(spark, folder):
    return ordinal.prefix(table(spark, folder, "split_manifest"), "problem_id", None, "dev").select("problem_id", "split")


@query("SELECT 'train' AS source_split, count(*) AS n FROM problems WHERE source_id LIKE 'train:%' UNION ALL SELECT 'test', count(*) FROM problems WHERE source_id LIKE 'test:%' UNION ALL SELECT 'missing:absent', 0")
def splits_present(spark, folder):
    root = _shared(spark)
    rows = table(spark, folder, "problems").select("pos", keys.source_split("source_id").alias("s"))
    for s in ("train", "test"):
        rows.where(F.col("s") == s).select("pos").write.parquet(f"{root}/{s}")
    df, missing = files.read_splits(spark, root, ["train", "test", "absent"])
    counts = df.groupBy("source_split").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(spark.createDataFrame([(f"missing:{m}", 0) for m in missing], "source_split string, n long"))


@query("SELECT rollout_id, min(verifier_status) AS verifier_status FROM rollouts GROUP BY 1")
def shard_merge(spark, folder):
    rows = table(spark, folder, "rollouts").select("rollout_id", "verifier_status")
    return files.merge_shards([rows.where("rollout_id % 2 = 0"), rows.where("rollout_id % 2 = 1")], "rollout_id", "verifier_status")


@query(f"SELECT reasoning_id, {_strip('reasoning')} = reasoning AS already, sha256({_strip('reasoning')}) AS stripped, len(list_filter(regexp_split_to_array(reasoning, '[\\x09-\\x0D\\x1C-\\x20\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda w: w <> '')) AS words FROM reasoning WHERE reasoning IS NOT NULL")
def white_space(spark, folder):
    rows = table(spark, folder, "reasoning").where("reasoning IS NOT NULL")
    s = text.strip("reasoning")
    return rows.select("reasoning_id", (s == F.col("reasoning")).alias("already"), F.sha2(s, 256).alias("stripped"), F.size(text.words("reasoning")).cast("long").alias("words"))


@query(f"WITH {ONE} SELECT problem_id, try_cast(CASE WHEN contains(source_id, ':') THEN substr(source_id, instr(source_id, ':') + 1) ELSE source_id END AS BIGINT) AS idx, lower(trim(coalesce(metadata.source_split, ''))) AS source_split FROM one")
def source_index_parse(spark, folder):
    rows = one_problem(table(spark, folder, "problems"))
    return rows.select("problem_id", keys.source_index("source_id").try_cast("long").alias("idx"), F.lower(text.strip(json_tests.as_text("metadata.source_split"))).alias("source_split"))


@query(f"WITH {ONE}, t AS (SELECT problem_id, unnest(tests) AS t FROM one) SELECT problem_id, t.test_id AS test_id, trim(replace(replace(t.output, chr(13), ''), chr(10), ' ')) = trim(replace(replace(t.input, chr(13), ''), chr(10), ' ')) AS same FROM t")
def output_equals_input(spark, folder):
    rows = one_problem(table(spark, folder, "problems")).select("problem_id", F.explode("tests").alias("t"))
    flat = lambda c: F.trim(F.replace(F.replace(F.col(c), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" ")))
    return rows.select("problem_id", "t.test_id", (flat("t.output") == flat("t.input")).alias("same"))


@query(f"WITH {R}, x AS (SELECT rollout_id, CASE verifier_status WHEN 'RE' THEN CASE testcase_passed % 4 WHEN 0 THEN 'ModuleNotFoundError: x' WHEN 1 THEN 'EOFError' WHEN 2 THEN 'operation disabled' ELSE 'boom' END END AS err, verifier_status AS s FROM r) SELECT rollout_id, CASE s WHEN 'AC' THEN 'accepted' WHEN 'CE' THEN 'bad_reference_solution_or_extraction' WHEN 'TLE' THEN 'timeout_or_resource_limit' WHEN 'WA' THEN 'wrong_output_source_data_or_judging_mismatch' ELSE CASE WHEN contains(err, 'ModuleNotFoundError') THEN 'unsupported_dependency' WHEN contains(err, 'operation disabled') THEN 'unsupported_process_or_network_use' WHEN contains(err, 'EOFError') THEN 'unsupported_io_format_or_bad_test_input' ELSE 'runtime_error_requires_inspection' END END AS failure_class FROM x")
def failure_classes(spark, folder):
    k = F.col("testcase_passed") % 4
    err = F.when(F.col("verifier_status") == "RE", F.when(k == 0, "ModuleNotFoundError: x").when(k == 1, "EOFError").when(k == 2, "operation disabled").otherwise("boom"))
    return delivered(spark, folder).select("rollout_id", verify.failure_class(F.col("verifier_status"), err, F.lit(None).cast("string")).alias("failure_class"))


@query(f"WITH {R}, k AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY rollout_id) AS n FROM r), t AS (SELECT * FROM k WHERE n <= 3) SELECT count_if(verifier_status = 'TLE') AS tle, count_if(verifier_status = 'TLE' AND testcase_pass_rate > 0.5) AS recovered, count_if(verifier_status = 'TLE' AND n = 1) AS first_tle, count_if(verifier_status = 'TLE' AND n = 1 AND testcase_pass_rate > 0.5) AS first_recovered FROM t")
def slow_recoveries(spark, folder):
    rows = attempted(spark, folder).withColumn("attempts", F.transform("attempts", lambda a: a.withField("slow_status", F.when(a["pass_rate"] > 0.5, "AC").otherwise("TLE"))))
    return qualify.slow_recoveries(rows)


_FLAGS = "f AS (SELECT problem_id, bool_or(verifier_status = 'AC') AS ok, bool_or(heldout_passed = heldout_total) AS held FROM rollouts GROUP BY 1), m AS (SELECT problem_id, min(split) AS split FROM split_manifest GROUP BY 1), j AS (SELECT m.problem_id, split, ok, held, contains(m.problem_id, 'train') AS stdio FROM m LEFT JOIN f USING (problem_id))"


def _flagged(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "rollouts").groupBy("problem_id").agg(F.bool_or(F.col("verifier_status") == "AC").alias("ok"), F.bool_or(F.col("heldout_passed") == F.col("heldout_total")).alias("held"))
    m = table(spark, folder, "split_manifest").groupBy("problem_id").agg(F.min("split").alias("split"))
    return m.join(f, "problem_id", "left").withColumn("stdio", F.col("problem_id").contains("train"))


@query(f"WITH {_FLAGS} SELECT count_if(split = 'sft' AND stdio AND ok AND held) AS sft, count_if(split = 'pt' AND stdio AND ok) AS pt, count_if(split = 'dev' AND stdio AND ok) AS dev FROM j")
def eligible_counts(spark, folder):
    rows = _flagged(spark, folder)
    flags = qualify.candidate_flags(F.col("stdio"), F.col("ok"), F.col("held"))
    return rows.agg(*(F.count_if((F.col("split") == s) & flags[f"{s}_candidate"]).alias(s) for s in splits.SPLITS))


@query(f"WITH {_FLAGS} SELECT problem_id, CASE WHEN NOT stdio THEN 'skipped_call_based' WHEN NOT coalesce(ok, false) THEN 'source_reference_not_verified:no_source_solution' WHEN split = 'sft' AND NOT coalesce(held, false) THEN 'ocr_solution_not_ac:unknown' ELSE 'eligible' END AS label FROM j")
def record_failures(spark, folder):
    none = F.lit(None).cast("string")
    return _flagged(spark, folder).select("problem_id", qualify.record_failure(F.col("split"), F.col("stdio"), F.col("ok"), F.col("held"), none, none).alias("label"))


@query("SELECT count(*) AS candidates, count_if(reason IS NULL) AS accepted, count_if(reason = 'missing_source_problem') AS missing, count_if(reason = 'duplicate_problem') AS duplicate, count_if(reason = 'invalid_output') AS invalid FROM (" + f"""
WITH {ONE}, c AS (SELECT r.reasoning_id AS pos, r.source AS dataset, split_part(r.source_id, ':', 1) AS s, try_cast(split_part(r.source_id, ':', 2) AS BIGINT) AS i, r.reasoning, r.source || ':' || r.source_id AS pid FROM reasoning r WHERE contains(r.source_id, ':')),
j AS (SELECT c.*, o.problem_id AS hit, {_is('o.prompt')} AND {_is('coalesce(o.reference_code, chr(32))')} AND {_is('c.reasoning')} AND coalesce(len(o.tests) > 0 AND len(list_filter(o.tests, lambda t: NOT ({_is('t.input')} AND {_is('t.output')}))) = 0, false) AS good
      FROM c LEFT JOIN one o ON o.source = c.dataset AND o.source_id = c.s || ':' || c.i),
k AS (SELECT *, CASE WHEN hit IS NULL THEN 'missing_source_problem' WHEN NOT good THEN 'invalid_output' END AS own FROM j),
f AS (SELECT pid, min(pos) AS first FROM k WHERE own IS NULL GROUP BY 1) SELECT CASE WHEN k.pos > f.first THEN 'duplicate_problem' ELSE own END AS reason FROM k LEFT JOIN f USING (pid))""")
def assembly_report(spark, folder):
    r = table(spark, folder, "reasoning").where(F.col("source_id").contains(":"))
    c = r.select(
        F.col("reasoning_id").alias("pos"), F.col("source").alias("dataset"), F.substring_index("source_id", ":", 1).alias("source_split"), F.get(F.split("source_id", ":"), F.lit(1)).try_cast("long").alias("index"),
        "reasoning", F.lit(None).cast("string").alias("solution"), F.concat_ws(":", "source", "source_id").alias("problem_id"),
    ).withColumn("source_id", F.concat_ws(":", "source_split", "index"))
    s = one_problem(table(spark, folder, "problems")).where(F.col("source_id").contains(":"))
    s = s.select(
        F.col("source").alias("dataset"), F.substring_index("source_id", ":", 1).alias("source_split"), F.get(F.split("source_id", ":"), F.lit(1)).try_cast("long").alias("index"),
        F.substring_index("source_id", ":", 1).alias("src_source_split"), F.col("source_id").alias("src_source_id"), "prompt", "reference_code", "tests",
    )
    reason = F.col("reject_reason")
    return joins.assemble(c, s).agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(reason.isNull()).alias("accepted"), F.count_if(reason == "missing_source_problem").alias("missing"), F.count_if(reason == "duplicate_problem").alias("duplicate"),
        F.count_if(reason == "invalid_output").alias("invalid"),
    )


@query(f"WITH {R} SELECT rollout_id FROM r WHERE rollout_id <= coalesce((SELECT rollout_id FROM r WHERE verifier_status = 'AC' ORDER BY rollout_id LIMIT 1 OFFSET 499), (SELECT max(rollout_id) FROM r))")
def target_limited(spark, folder):
    return splits.until_target(delivered(spark, folder), "rollout_id", F.col("verifier_status") == "AC", 500).select("rollout_id")


@query(f"WITH {_TESTS}, {_MANIFEST}, v AS (SELECT problem_id, split FROM c GROUP BY 1, 2) SELECT problem_id, split, prompt IS NOT NULL AND {_is('prompt')} AND {_is('reference_code')} AND {_is('difficulty')} AS valid FROM v JOIN one USING (problem_id)")
def processed_validity(spark, folder):
    rows = _heldout(spark, folder).where("reward_tests IS NOT NULL").withColumn("reasoning", F.lit("r"))
    return rows.select("problem_id", "split", validate.valid_processed().alias("valid"))


@query(f"WITH {_TESTS}, {_MANIFEST} SELECT problem_id, count(*)::INT AS n_all, count_if(k <= cut)::INT AS n_reward, count_if(k > cut)::INT AS n_heldout FROM c GROUP BY 1")
def tests_in_scope(spark, folder):
    rows = _heldout(spark, folder).where("reward_tests IS NOT NULL")
    return rows.select("problem_id", *(F.size(qualify.tests_in_scope(s)).alias(f"n_{s}") for s in ("all", "reward", "heldout")))


@query(f"WITH {_TESTS}, {_MANIFEST} SELECT split, count(*) AS found FROM (SELECT problem_id, split FROM c GROUP BY 1, 2) GROUP BY 1")
def policy_view_counts(spark, folder):
    rows = gates.policy_view(_heldout(spark, folder).where("reward_tests IS NOT NULL"))
    return rows.groupBy("split").agg(F.count("reward_tests").alias("found"))


@query(f"WITH {R}, x AS (SELECT problem_id, verifier_status FROM r WHERE response_token_count >= 2048) SELECT verifier_status, count(*) AS n FROM x GROUP BY 1")
def capped_rollouts(spark, folder):
    return rollouts.capped(delivered(spark, folder), 2048).groupBy("verifier_status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT split, count(*)::DOUBLE AS count, list_sort(list(v))[round_even(0.5::DOUBLE * (count(*) - 1), 0)::BIGINT + 1] AS p50, list_sort(list(v))[round_even(0.95::DOUBLE * (count(*) - 1), 0)::BIGINT + 1] AS p95, max(v) AS max FROM (SELECT split_part(source_id, ':', 1) AS split, length(prompt)::DOUBLE AS v FROM problems WHERE prompt IS NOT NULL) GROUP BY 1")
def length_profile(spark, folder):
    rows = table(spark, folder, "problems").select(F.substring_index("source_id", ":", 1).alias("split"), F.length("prompt").alias("length"))
    return stats.numeric_stats(rows, "length", (50, 95), ("split",))


@query(f"WITH {R} SELECT model_revision, count_if(generation_latency_ms IS NULL) AS missing, count_if(isfinite(generation_latency_ms)) AS finite FROM r GROUP BY 1")
def finite_check(spark, folder):
    x = F.col("generation_latency_ms")
    return delivered(spark, folder).groupBy("model_revision").agg(F.count_if(x.isNull()).alias("missing"), F.count_if(stats.is_finite(x)).alias("finite"))
