"""Queries of the curation operators: keys, validation, joins, splits, overlap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_tests, keys, text
from ..operators import gates, joins, overlap, qualify, splits, validate

SEED = 20260904
RATIOS = {"sft": 0.6, "pt": 0.3, "dev": 0.1}
LEAST = {"min_total_tests_by_split": {"sft": 2, "pt": 10, "dev": 10}}
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


# One delivery per problem_id, as SQL and as a DataFrame.
ONE = "one AS (SELECT * FROM problems QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY pos) = 1)"
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _is(c: str) -> str:
    return "coalesce(regexp_matches(" + c + ", '[^" + SPACE[1:-1] + "]'), false)"


def _strip(c: str) -> str:
    return "regexp_replace(" + c + ", '^" + SPACE + "+|" + SPACE + "+$', '', 'g')"


def _fp(i: str, o: str) -> str:
    return "sha256('{\"input\":' || to_json(" + i + ")::VARCHAR || ',\"output\":' || to_json(" + o + ")::VARCHAR || '}')"


def _valid_problem(prefix: str = "") -> str:
    fields = " AND ".join(_is(prefix + c) for c in ("source", "source_id", "prompt", "reference_code"))
    bad = "NOT (" + _is("t.input") + " AND " + _is("t.output") + ")"
    return f"{fields} AND coalesce(len({prefix}tests) > 0 AND len(list_filter({prefix}tests, lambda t: {bad})) = 0, false)"


def _valid_reasoning() -> str:
    return "(" + _is("problem_id") + " OR (" + _is("source") + " AND " + _is("source_id") + ")) AND " + _is("reasoning")


ORDER_KEY = "sha256('{\"problem_id\":' || to_json(problem_id)::VARCHAR || ',\"seed\":" + str(SEED) + "}')"


def one_problem(problems: DataFrame, **derived: Column) -> DataFrame:
    """Each problem_id once: the delivery with the smallest pos, with columns that are derived from a row where it is read.

    Each column is an aggregate of its own, so the optimiser drops those that a query does not use: they are neither read nor shuffled.
    """
    rows = problems.withColumns(derived) if derived else problems
    return rows.groupBy("problem_id").agg(*(F.min_by(c, "pos").alias(c) for c in rows.columns if c != "problem_id"))


@query("SELECT pos, trim(regexp_replace(lower(coalesce(prompt, '')), '[^a-z0-9_]+', ' ', 'g')) AS normalized, sha256(trim(regexp_replace(lower(coalesce(prompt, '')), '[^a-z0-9_]+', ' ', 'g'))) AS norm_hash FROM problems")
def text_normalize(spark, folder):
    c = F.coalesce("prompt", F.lit(""))
    return table(spark, folder, "problems").select("pos", text.normalize(c).alias("normalized"), text.normalized_hash(c).alias("norm_hash"))


@query(f"SELECT pos, {ORDER_KEY} AS order_key, sha256(to_json(prompt)::VARCHAR) AS prompt_hash, CASE WHEN contains(source_id, ':') THEN nullif(split_part(source_id, ':', 1), '') END AS source_split, CASE WHEN contains(source_id, ':') THEN substr(source_id, instr(source_id, ':') + 1) ELSE source_id END AS source_index, source || ':' || source_id AS made_id FROM problems")
def problem_keys(spark, folder):
    rows = table(spark, folder, "problems")
    return rows.select(
        "pos", keys.split_order_key("problem_id", SEED).alias("order_key"), keys.stable_hash(keys.json_string("prompt")).alias("prompt_hash"),
        keys.source_split("source_id").alias("source_split"), keys.source_index("source_id").alias("source_index"), keys.make_problem_id("source", "source_id").alias("made_id"),
    )


@query(f"SELECT pos, {_valid_problem()} AS valid FROM problems")
def problem_validity(spark, folder):
    return table(spark, folder, "problems").select("pos", validate.valid_raw_problem().alias("valid"))


@query(f"SELECT reasoning_id, {_valid_reasoning()} AS valid FROM reasoning")
def reasoning_validity(spark, folder):
    return table(spark, folder, "reasoning").select("reasoning_id", validate.valid_reasoning().alias("valid"))


_JOINED = f"""
r AS (SELECT * FROM reasoning WHERE {_valid_reasoning()}),
a AS (SELECT {_strip('problem_id')} AS key, count(*) AS n, min_by(reasoning, reasoning_id) AS reasoning FROM r WHERE {_is('problem_id')} GROUP BY 1),
b AS (SELECT {_strip('source')} || ':' || {_strip('source_id')} AS key, count(*) AS n, min_by(reasoning, reasoning_id) AS reasoning FROM r
      WHERE {_is('source')} AND {_is('source_id')} GROUP BY 1),
j AS (SELECT p.pos, p.problem_id, {_valid_problem('p.')} AS valid,
             coalesce(a.n, 0) AS n1, coalesce(b.n, 0) AS n2, a.reasoning AS r1, b.reasoning AS r2
      FROM problems p LEFT JOIN a ON a.key = p.problem_id LEFT JOIN b ON b.key = {_strip('p.source')} || ':' || {_strip('p.source_id')}),
o AS (SELECT *, CASE WHEN NOT valid THEN 'invalid_problem' WHEN n1 > 1 OR n2 > 1 THEN 'ambiguous' WHEN n1 = 0 AND n2 = 0 THEN 'no_reasoning' END AS reject_reason FROM j)
"""


@query(f"WITH {_JOINED} SELECT pos, problem_id, CASE WHEN reject_reason IS NULL THEN CASE WHEN n1 = 1 THEN 'problem_id' ELSE 'source/source_id' END END AS mapping_key, CASE WHEN reject_reason IS NULL THEN sha256(coalesce(r1, r2)) END AS reasoning_hash, reject_reason FROM o")
def exact_join(spark, folder):
    out = joins.exact_join(table(spark, folder, "problems"), table(spark, folder, "reasoning"), strict=False)
    return out.select("pos", "problem_id", "mapping_key", F.sha2("reasoning", 256).alias("reasoning_hash"), "reject_reason")


@query(f"WITH {_JOINED} SELECT coalesce(reject_reason, 'joined') AS outcome, CASE WHEN reject_reason IS NULL THEN CASE WHEN n1 = 1 THEN 'problem_id' ELSE 'source/source_id' END ELSE 'none' END AS mapping_key, count(*) AS problems FROM o GROUP BY 1, 2")
def join_report(spark, folder):
    return joins.join_report(joins.exact_join(table(spark, folder, "problems"), table(spark, folder, "reasoning"), strict=False))


# The stream is the table of rollouts by rollout_id and arrival; a rollout is accepted if its verdict is AC and enough test cases pass.
_STREAM = """
s AS (SELECT *, row_number() OVER (ORDER BY rollout_id, arrived_at) AS n FROM (SELECT DISTINCT rollout_id, problem_id, verifier_status, testcase_pass_rate, arrived_at FROM rollouts)),
r AS (SELECT *, CASE WHEN NOT contains(problem_id, ':') THEN 'missing_source_split' END AS early,
             CASE WHEN verifier_status <> 'AC' THEN 'bad_judgement' WHEN testcase_pass_rate IS NULL OR testcase_pass_rate < 1.0 THEN 'low_pass_rate' END AS own FROM s),
f AS (SELECT problem_id, min(rollout_id) AS first_id FROM r WHERE early IS NULL AND own IS NULL GROUP BY 1)
"""


@query("WITH " + _STREAM.replace("row_number() OVER (ORDER BY rollout_id, arrived_at)", "rollout_id").replace("DISTINCT ", "DISTINCT ON (rollout_id) ").replace("FROM rollouts)", "FROM rollouts ORDER BY rollout_id, arrived_at)") + "SELECT r.rollout_id, coalesce(early, CASE WHEN r.rollout_id > f.first_id THEN 'duplicate_problem' ELSE own END) AS reject_reason FROM r LEFT JOIN f USING (problem_id)")
def first_accepted(spark, folder):
    from ..operators.rollouts import one_delivery

    rows = one_delivery(table(spark, folder, "rollouts"))
    early = F.when(~F.col("problem_id").contains(":"), "missing_source_split")
    own = validate.first_reason(("bad_judgement", F.col("verifier_status") != "AC"), ("low_pass_rate", ~validate.passes(F.col("testcase_pass_rate"), 1.0)))
    return joins.first_accepted(rows, ["problem_id"], "rollout_id", own.isNull(), own, early).select("rollout_id", "reject_reason")


@query("WITH w AS (SELECT DISTINCT problem_id FROM rollouts WHERE verifier_status = 'AC') SELECT pos, problem_id FROM problems WHERE problem_id IN (SELECT problem_id FROM w)")
def wanted_semi_join(spark, folder):
    wanted = table(spark, folder, "rollouts").where("verifier_status = 'AC'")
    return joins.semi_by_keys(table(spark, folder, "problems").select("pos", "problem_id"), wanted, ["problem_id"])


def _split(spark, folder) -> DataFrame:
    return splits.assign_splits(one_problem(table(spark, folder, "problems")), SEED, RATIOS)


_ASSIGNED = f"""
{ONE},
k AS (SELECT *, row_number() OVER (ORDER BY {ORDER_KEY}, pos) - 1 AS rank, count(*) OVER () AS total FROM one),
q AS (SELECT total, total * 0.6::DOUBLE AS a, total * 0.3::DOUBLE AS b, total * 0.1::DOUBLE AS c FROM (SELECT count(*) AS total FROM one)),
z AS (SELECT total, floor(a) AS fa, floor(b) AS fb, floor(c) AS fc, a - floor(a) AS ra, b - floor(b) AS rb, c - floor(c) AS rc, total - floor(a) - floor(b) - floor(c) AS rest FROM q),
n AS (SELECT fa + (1 + (rb > ra)::INT + (rc > ra)::INT <= rest)::INT AS na, fb + (1 + (ra >= rb)::INT + (rc > rb)::INT <= rest)::INT AS nb FROM z),
assigned AS (SELECT k.*, CASE WHEN rank < na THEN 'sft' WHEN rank < na + nb THEN 'pt' ELSE 'dev' END AS split FROM k, n)
"""


@query(f"WITH {_ASSIGNED} SELECT problem_id, split FROM assigned")
def split_assign(spark, folder):
    return _split(spark, folder).select("problem_id", "split")


@query(f"WITH {ONE} SELECT problem_id, {ORDER_KEY} AS order_key FROM one ORDER BY 2, pos LIMIT 100")
def hash_sample(spark, folder):
    return splits.hash_sample(one_problem(table(spark, folder, "problems")), SEED, 100).select("problem_id", keys.split_order_key("problem_id", SEED).alias("order_key"))


_TESTS = f"""
{ONE},
e AS (SELECT problem_id, pos, unnest(tests) AS t, generate_subscripts(tests, 1) AS i FROM one),
fp AS (SELECT problem_id, pos, i, t.input AS input, t.output AS output, {_fp('t.input', 't.output')} AS fingerprint,
              CASE WHEN {_is('t.test_id')} THEN {_strip('t.test_id')} END AS given FROM e),
u AS (SELECT *, coalesce(given, 'case_' || lpad((i - 1)::VARCHAR, 4, '0') || '_' || substr(fingerprint, 1, 10)) AS test_id FROM fp
      QUALIFY row_number() OVER (PARTITION BY problem_id, fingerprint ORDER BY i) = 1)
"""


@query(f"WITH {_TESTS} SELECT problem_id, test_id, fingerprint FROM u")
def testcase_dedup(spark, folder):
    tests = F.transform(splits.distinct_tests("tests"), lambda t: F.struct(t["test_id"].alias("test_id"), t["fingerprint"].alias("fingerprint")))
    rows = one_problem(table(spark, folder, "problems"), distinct_tests=tests).select("problem_id", F.explode("distinct_tests").alias("t"))
    return rows.select("problem_id", "t.test_id", "t.fingerprint")


def _heldout(spark, folder) -> DataFrame:
    rows = _split(spark, folder)
    return splits.reward_heldout(rows, SEED, 0.7, splits.least_tests_column(LEAST))


_MANIFEST = (
    _ASSIGNED.replace(ONE + ",", "")
    + f""",
h AS (SELECT u.*, a.split, sha256('{{"input":' || to_json(input)::VARCHAR || ',"output":' || to_json(output)::VARCHAR || ',"problem_id":' || to_json(u.problem_id)::VARCHAR || ',"seed":{SEED},"test_id":' || to_json(test_id)::VARCHAR || '}}') AS h,
             count(*) OVER (PARTITION BY u.problem_id) AS n FROM u JOIN assigned a USING (problem_id)),
c AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY h) AS k, least(greatest(round_even(n * 0.7::DOUBLE, 0)::INT, 1), n - 1) AS cut FROM h
      WHERE n >= 2 AND n >= CASE split WHEN 'sft' THEN 2 ELSE 10 END)
"""
)


@query(f"WITH {_TESTS}, {_MANIFEST} SELECT problem_id, test_id, CASE WHEN k <= cut THEN 'reward' ELSE 'heldout' END AS part FROM c")
def reward_heldout_split(spark, folder):
    rows = _heldout(spark, folder).where("reward_tests IS NOT NULL")

    def side(part: str) -> Column:
        return F.transform(f"{part}_tests", lambda t: F.struct(t["test_id"].alias("test_id"), F.lit(part).alias("part")))

    return rows.select("problem_id", F.explode(F.concat(side("reward"), side("heldout"))).alias("t")).select("problem_id", "t.test_id", "t.part")


@query(f"""WITH {_TESTS}, {_MANIFEST} SELECT problem_id, split, list(test_id ORDER BY k) FILTER (WHERE k <= cut) AS reward_test_ids, list(test_id ORDER BY k) FILTER (WHERE k > cut) AS heldout_test_ids,
list(fingerprint ORDER BY k) FILTER (WHERE k <= cut) AS reward_fingerprints, list(fingerprint ORDER BY k) FILTER (WHERE k > cut) AS heldout_fingerprints FROM c GROUP BY 1, 2""")
def test_split_manifest(spark, folder):
    return splits.test_manifest(_heldout(spark, folder))


@query(f"WITH {_TESTS}, {_MANIFEST}, g AS (SELECT problem_id FROM c GROUP BY 1) SELECT a.split, count(*) AS problems, count(g.problem_id) AS kept, count(*) - count(g.problem_id) AS too_few_tests FROM assigned a LEFT JOIN g USING (problem_id) GROUP BY 1")
def drop_reasons(spark, folder):
    kept = F.count("reward_tests")
    return _heldout(spark, folder).groupBy("split").agg(F.count(F.lit(1)).alias("problems"), kept.alias("kept"), (F.count(F.lit(1)) - kept).alias("too_few_tests"))


@query("""WITH m AS (SELECT problem_id, max_by(struct_pack(split, reward_test_ids, heldout_test_ids), reward_fingerprints) AS r, count(*) AS n FROM split_manifest GROUP BY 1),
p AS (SELECT DISTINCT problem_id FROM problems)
SELECT coalesce(p.problem_id, m.problem_id) AS problem_id, issue FROM p FULL JOIN m USING (problem_id), unnest([CASE WHEN m.problem_id IS NULL THEN 'missing' END, CASE WHEN p.problem_id IS NULL THEN 'extra' END, CASE WHEN n > 1 THEN 'duplicate' END]) AS t(issue) WHERE issue IS NOT NULL""")
def manifest_diff(spark, folder):
    manifest = table(spark, folder, "split_manifest").select("problem_id", F.to_json("reward_fingerprints").alias("o"), F.lit(1).alias("there"))
    expected = table(spark, folder, "problems").select("problem_id", F.lit("").alias("o"), F.lit(1).alias("there")).distinct()
    return joins.manifest_diff(expected, manifest, ["there"], "o")


@query("SELECT norm_hash, n, first_id FROM (SELECT sha256(trim(regexp_replace(lower(coalesce(prompt, '')), '[^a-z0-9_]+', ' ', 'g'))) AS norm_hash, count(DISTINCT problem_id) AS n, min(problem_id) AS first_id FROM problems GROUP BY 1) WHERE n > 1")
def exact_dup_groups(spark, folder):
    return overlap.exact_groups(table(spark, folder, "problems"))


_GRAMS = f"""
{ONE},
t AS (SELECT problem_id, source_id, trim(regexp_replace(lower(coalesce(prompt, '')), '[^a-z0-9_]+', ' ', 'g')) AS norm FROM one),
w AS (SELECT problem_id, source_id, norm, CASE WHEN norm = '' THEN [] ELSE string_split(norm, ' ') END AS w FROM t),
s AS (SELECT problem_id, source_id, sha256(norm) AS norm_hash, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [norm] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS grams FROM w)
"""


@query(f"WITH {_GRAMS} SELECT problem_id, len(grams) AS n_grams, norm_hash FROM s")
def ngram_sets(spark, folder):
    rows = overlap.shingled(table(spark, folder, "problems"), 5)
    return rows.select("problem_id", F.size("grams").cast("long").alias("n_grams"), "norm_hash")


def _sides(spark, folder) -> tuple[DataFrame, DataFrame]:
    rows = overlap.shingled(table(spark, folder, "problems").withColumn("side", keys.source_split("source_id")), 5, keep=("side",))
    return rows.where("side = 'train'").drop("side"), rows.where("side IN ('test', 'valid')").drop("side")


_PAIRS = """
l AS (SELECT problem_id AS left_id, len(grams) AS n, unnest(grams) AS g FROM s WHERE split_part(source_id, ':', 1) = 'train' AND contains(source_id, ':')),
r AS (SELECT problem_id AS right_id, len(grams) AS m, unnest(grams) AS g FROM s WHERE split_part(source_id, ':', 1) IN ('test', 'valid') AND contains(source_id, ':')),
p AS (SELECT left_id, right_id, count(*)::DOUBLE / (any_value(n) + any_value(m) - count(*)) AS score FROM l JOIN r USING (g) GROUP BY 1, 2 HAVING score >= 0.8)
"""


@query(f"WITH {_GRAMS}, {_PAIRS} SELECT left_id, right_id, round(score, 6) AS score FROM p")
def near_dup_pairs(spark, folder):
    left, right = _sides(spark, folder)
    return overlap.near_pairs(left, right, 0.8)


@query(f"""WITH {_GRAMS}, x AS (SELECT *, CASE WHEN source_id LIKE 'train:%' THEN 'left' WHEN source_id LIKE 'test:%' OR source_id LIKE 'valid:%' THEN 'right' END AS side FROM s)
SELECT norm_hash, side, problem_id FROM x WHERE side IS NOT NULL AND norm_hash IN (SELECT norm_hash FROM x GROUP BY 1 HAVING count(DISTINCT side) = 2)""")
def exact_overlap(spark, folder):
    left, right = _sides(spark, folder)
    return overlap.exact_overlap(left, right)


@query(f"""WITH {_GRAMS}, {_PAIRS} SELECT DISTINCT problem_id FROM (SELECT right_id AS problem_id FROM p
UNION ALL SELECT problem_id FROM s WHERE (source_id LIKE 'test:%' OR source_id LIKE 'valid:%') AND norm_hash IN (SELECT norm_hash FROM s WHERE source_id LIKE 'train:%'))""")
def blocked_ids(spark, folder):
    left, right = _sides(spark, folder)
    return overlap.blocked(left, right, 0.8)


def _three(spark, folder) -> list[DataFrame]:
    rows = overlap.shingled(_split(spark, folder), 5, keep=("split",))
    return [rows.where(F.col("split") == s).drop("split") for s in splits.SPLITS]


_BLOCK = """
x AS (SELECT s.*, a.split FROM s JOIN assigned a USING (problem_id)),
y AS (SELECT problem_id, split, len(grams) AS n, unnest(grams) AS g FROM x),
near AS (SELECT a.problem_id AS a, b.problem_id AS b, a.split AS sa, b.split AS sb FROM y a JOIN y b ON a.g = b.g AND a.split <> b.split
         GROUP BY 1, 2, 3, 4 HAVING count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.8),
same AS (SELECT a.problem_id AS a, b.problem_id AS b, a.split AS sa, b.split AS sb FROM x a JOIN x b ON a.norm_hash = b.norm_hash AND a.split <> b.split),
hit AS (SELECT * FROM near UNION SELECT * FROM same),
pt AS (SELECT DISTINCT b AS problem_id FROM hit WHERE sa = 'sft' AND sb = 'pt'),
dev AS (SELECT DISTINCT b AS problem_id FROM hit WHERE sb = 'dev' AND (sa = 'sft' OR (sa = 'pt' AND a NOT IN (SELECT problem_id FROM pt))))
"""


@query(f"WITH {_GRAMS}, {_ASSIGNED.replace(ONE + ',', '')}, {_BLOCK} SELECT 'pt' AS split, problem_id FROM pt UNION ALL SELECT 'dev', problem_id FROM dev")
def sequential_blocking(spark, folder):
    return overlap.sequential_blocking(*_three(spark, folder), 0.8)


_NINE = """
pr AS (SELECT * FROM (VALUES ('sft', 'pt'), ('sft', 'dev'), ('pt', 'dev')) v(l, r)),
nine AS (SELECT l || '_' || r AS pair, (SELECT count(*) FROM (SELECT problem_id FROM x WHERE split = l INTERSECT SELECT problem_id FROM x WHERE split = r)) AS ids,
 (SELECT count(DISTINCT u.norm_hash) FROM x u JOIN x v ON u.norm_hash = v.norm_hash WHERE u.split = l AND v.split = r) AS texts, (SELECT count(*) FROM near WHERE sa = l AND sb = r) AS near FROM pr)
"""


def nine_overlaps(spark, folder) -> DataFrame:
    sets = dict(zip(splits.SPLITS, _three(spark, folder)))
    out = None
    for a, b in (("sft", "pt"), ("sft", "dev"), ("pt", "dev")):
        row = overlap.overlap_counts(sets[a], sets[b], 0.8, f"{a}_{b}")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"WITH {_GRAMS}, {_ASSIGNED.replace(ONE + ',', '')}, {_BLOCK}, {_NINE} SELECT *, ids + texts + near = 0 AS passed FROM nine")
def overlap_gate(spark, folder):
    return gates.overlap_gate(nine_overlaps(spark, folder))


@query("""WITH e AS (SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g')) AS norm FROM eval_items),
d AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g')) AS norm FROM documents WHERE text IS NOT NULL),
f AS (SELECT id, kind, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [norm] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS grams
FROM (SELECT *, CASE WHEN norm = '' THEN [] ELSE string_split(norm, ' ') END AS w FROM (SELECT 'd' || doc_id AS id, 'd' AS kind, norm FROM d UNION ALL SELECT 'e' || item_id, 'e', norm FROM e))),
g AS (SELECT id, kind, len(grams) AS n, unnest(grams) AS g FROM f)
SELECT a.id AS left_id, b.id AS right_id, count(*)::DOUBLE / any_value(b.n) AS share FROM (SELECT * FROM g WHERE kind = 'd') a JOIN (SELECT * FROM g WHERE kind = 'e') b USING (g) GROUP BY 1, 2 HAVING share >= 0.1""")
def external_decontamination(spark, folder):
    docs = table(spark, folder, "documents").where("text IS NOT NULL").select(F.concat(F.lit("d"), "doc_id").alias("problem_id"), F.col("doc_id").alias("pos"), F.col("text").alias("prompt"))
    items = table(spark, folder, "eval_items").select(F.concat(F.lit("e"), "item_id").alias("problem_id"), F.col("item_id").alias("pos"), F.col("text").alias("prompt"))
    return overlap.containment_pairs(overlap.shingled(docs, 5), overlap.shingled(items, 5), 0.1)


@query(f"WITH {ONE} SELECT source || '/' || coalesce(nullif(lower(trim(metadata.source_split)), ''), CASE WHEN contains(source_id, ':') THEN split_part(source_id, ':', 1) END, 'unknown') AS source_split, count(*) AS n FROM one GROUP BY 1")
def source_distribution(spark, folder):
    return one_problem(table(spark, folder, "problems")).groupBy(F.concat_ws("/", "source", keys.split_label("metadata.source_split", "source_id")).alias("source_split")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ONE} SELECT source || '/' || CASE WHEN contains(source_id, ':') THEN split_part(source_id, ':', 1) ELSE source_id END AS source_split, count(*) AS n FROM one GROUP BY 1")
def id_distribution(spark, folder):
    return one_problem(table(spark, folder, "problems")).groupBy(F.concat_ws("/", "source", keys.id_label("source_id")).alias("source_split")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT pos, t.test_id AS test_id, regexp_replace(regexp_replace(regexp_replace(t.output, '\\r\\n?', chr(10), 'g'), '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n+$', '') AS normalized FROM (SELECT pos, unnest(tests) AS t FROM problems)""")
def judge_output(spark, folder):
    rows = table(spark, folder, "problems").select("pos", F.explode("tests").alias("t"))
    return rows.select("pos", "t.test_id", text.normalize_output("t.output").alias("normalized"))


@query("SELECT pos, len(tests)::INT AS n, sha256(array_to_string(list_transform(tests, lambda t: t.input || chr(0) || t.output), chr(1))) AS content, pos % 3 = 0 AS call_based FROM problems")
def json_tests_roundtrip(spark, folder):
    doc = F.to_json(F.struct(F.col("tests.input").alias("inputs"), F.col("tests.output").alias("outputs")))
    rows = table(spark, folder, "problems").select("pos", json_tests.tests(doc).alias("t"), F.when(F.col("pos") % 3 == 0, F.lit("solve")).alias("fn_name"))
    content = F.array_join(F.transform("t", lambda t: F.concat(t["input"], F.lit("\0"), t["output"])), "\x01")
    return rows.select("pos", F.size("t").alias("n"), F.sha2(content, 256).alias("content"), (json_tests.protocol(F.col("fn_name"), F.lit(None).cast("string")) == "call_based").alias("call_based"))


@query(f"WITH {ONE} SELECT problem_id, coalesce(regexp_matches(lower(prompt), 'any valid|any one|any of|any order|print any|output any|if there are multiple|if multiple|multiple answers|multiple correct|all possible|in any order|arbitrary'), false) AS several, source = 'kodewell' AND regexp_matches(lower(concat_ws(' ', prompt, topic, difficulty, reference_code)), '\\binteractive\\b') AS interactive FROM one")
def prompt_hints(spark, folder):
    """Interactive problems are told by four fields, and only in one source."""
    hinted = (F.col("source") == "kodewell") & validate.interactive("prompt", "topic", "difficulty", "reference_code")
    rows = one_problem(table(spark, folder, "problems"), several=text.allows_several_answers("prompt"), interactive=hinted)
    return rows.select("problem_id", "several", "interactive")


@query("""WITH m AS (SELECT problem_id, min(split) AS split FROM split_manifest GROUP BY 1), v AS (SELECT problem_id, bool_or(verifier_status = 'AC') AS ok, bool_or(heldout_passed = heldout_total) AS held FROM rollouts GROUP BY 1)
SELECT m.problem_id, m.split FROM m JOIN v USING (problem_id) WHERE ok AND (split <> 'sft' OR held)""")
def eligible_view(spark, folder):
    processed = table(spark, folder, "split_manifest").groupBy("problem_id").agg(F.min("split").alias("split")).withColumn("source", F.substring_index("problem_id", ":", 1))
    ok = table(spark, folder, "rollouts").groupBy("problem_id").agg(F.bool_or(F.col("verifier_status") == "AC").alias("ok"), F.bool_or(F.col("heldout_passed") == F.col("heldout_total")).alias("held"))
    manifest = processed.join(ok, "problem_id").select("problem_id", "split", "source", *(c.alias(n) for n, c in qualify.candidate_flags(F.lit(True), F.col("ok"), F.col("held")).items()))
    return joins.eligible_view(processed, manifest).select("problem_id", "split")


@query("""WITH a AS (SELECT DISTINCT problem_id FROM problems), b AS (SELECT DISTINCT problem_id FROM split_manifest), c AS (SELECT DISTINCT problem_id FROM rollouts)
SELECT 'common' AS kind, count(*) AS n FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'without_split', count(*) FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'any', count(*) FROM (FROM a UNION FROM b UNION FROM c)""")
def id_sets(spark, folder):
    a, b, c = (table(spark, folder, t).select("problem_id").distinct() for t in ("problems", "split_manifest", "rollouts"))
    parts = {"common": a.intersect(b), "without_split": a.join(b, "problem_id", "left_anti"), "any": a.unionByName(b).unionByName(c).distinct()}
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out
