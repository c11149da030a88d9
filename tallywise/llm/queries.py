"""The driver's queries of this subpackage (p4, p6, p7, p8) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywise.llm import leakage, membership, packing, quality, tokens
from tallywise.sources.tables import table

_GRAINS = {"day": ("day",), "project": ("project",), "pair": ("day", "project")}


def _membership_state(t: DataFrame) -> DataFrame:
    return membership.state(t, "session_id", {"day": F.to_date("record_timestamp"), "project": F.col("project")})


def p4_session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sessions by day, project and both."""
    pat = membership.patterns(_membership_state(table(spark, sf_dir, "token_records")))
    return membership.counts(pat, _GRAINS, "n_sessions").withColumn("error_bound", F.lit(membership.ERROR))


def p4_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from two overlapping partial results: records loaded in time, and late ones."""
    t = table(spark, sf_dir, "token_records")
    late = F.coalesce(F.col("loaded_at") > F.col("record_timestamp") + F.expr("interval 1 hour"), F.lit(False))
    st = membership.merge(_membership_state(t.where(~late)), _membership_state(t.where(late)))
    return membership.counts(membership.patterns(st), {"project": ("project",)}, "n_sessions").select("project", "n_sessions")


def p4_weekend_and_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with records both at a weekend and on a weekday, from pattern totals."""
    pat = membership.patterns(_membership_state(table(spark, sf_dir, "token_records")))
    weekend = F.dayofweek("day").isin(1, 7)
    return membership.combination(pat, all_of=[weekend, ~weekend]).withColumnRenamed("n", "n_sessions")


def p4_models_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different models of each session: a model's set of sessions is a wide pattern of many parts."""
    t = table(spark, sf_dir, "token_records")
    pat = membership.patterns(membership.state(t, "model", {"session_id": F.col("session_id")}))
    return membership.counts(pat, {"session": ("session_id",)}, "n_models").select("session_id", "n_models")


def p4_models_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models seen both at a weekend and on a weekday, over their sets of sessions and days."""
    t = table(spark, sf_dir, "token_records")
    pat = membership.patterns(membership.state(t, "model", {"session_id": F.col("session_id"), "day": F.to_date("record_timestamp")}))
    weekend = F.dayofweek("day").isin(1, 7)
    return membership.combination(pat, all_of=[weekend, ~weekend]).withColumnRenamed("n", "n_models")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or its containers."""
    out, _ = packing.fill(tokens.with_lengths(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")
    return out


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the packing laid into several containers: those that have a second placed piece."""
    return p6_containers(spark, sf_dir).where("piece = 1 and container is not null").select("doc_id")


def p6_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was laid where, checked: documents, those whose pieces don't add up to their tokens, containers over the capacity, and that none is empty."""
    d = p6_containers(spark, sf_dir)
    doc = d.groupBy("doc_id").agg(F.sum("size").alias("laid"), F.max("n_tokens").alias("n"), F.countDistinct("container").alias("in"), F.count(F.lit(1)).alias("pieces"))
    doc = doc.agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("laid") != F.col("n")) | (F.col("in") != F.col("pieces"))).alias("wrong"))
    use = d.groupBy("container").agg(F.sum("size").alias("used"))
    use = use.agg(F.count_if(F.col("used") > packing.CAPACITY).alias("over"), (F.max("container") + 1 - F.count(F.lit(1))).alias("unused"), F.count_if(F.col("used") == 0).alias("empty"))
    return doc.join(F.broadcast(use))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers hold how many tokens, by twentieth of the capacity."""
    one = p6_containers(spark, sf_dir).groupBy("container").agg(F.sum("size").alias("tokens"))
    return one.groupBy(F.ceil(F.col("tokens") * 20 / packing.CAPACITY).alias("twentieth")).agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))


def p7_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap of test items and documents, with substitutions."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_overlaps(spark, sf_dir).where(f"exact_run >= {leakage.SPAN}").select("item_id", "doc_id").distinct()


def p7_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as p7_found by the shuffled join that any number of test items takes."""
    d = leakage.leaks_joined(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return d.where(f"exact_run >= {leakage.SPAN}").select("item_id", "doc_id").distinct()


def _scores(spark: SparkSession, sf_dir: str, with_figures: bool) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("withdrawn", F.col("author").isNull())
    return quality.outlier_scores(docs, table(spark, sf_dir, "common_words"), table(spark, sf_dir, "doc_labels"), keep=["withdrawn"], with_figures=with_figures)


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of every document's text, and the outlier score of its own text."""
    return _scores(spark, sf_dir, True)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose(_scores(spark, sf_dir, False)).where("not withdrawn").select("doc_id")


def p8_length_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact ranks of each text length within the language as written, by the operator's range-partitioned sort."""
    d = table(spark, sf_dir, "documents").select("lang", F.length("text").cast("double").alias("chars"), F.lit(1).alias("n"))
    return quality.tails(d, ["lang"], "chars")


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            p4_session_counts, p4_merged, p4_weekend_and_weekday, p4_models_by_session, p4_models_of_both, p6_found, p6_containers, p6_complete, p6_fill, p7_found, p7_joined, p7_overlaps, p8_found, p8_scores, p8_length_ranks,
        )
    }


def _plain_sql(c: str) -> str:
    """The words of a text as DuckDB reads them, for the markup that these tables hold."""
    x = c
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    steps = (
        (r"[\x{00ad}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]", ""),
        (r"(?i)\[img\][^\[\]]*\[/img\]", " "),
        (r"(?i)</?(?:b|i|u|s|em|strong|span|font|a|code|small|big)\b[^<>]*>|\[/?(?:b|i|u|s|size|color|font|url|code)(?:=[^\[\]]*)?\]", ""),
        (r"(?i)</?[a-z][a-z0-9]*\b[^<>]*>|\[/?(?:quote|list|\*|img|center|spoiler)(?:=[^\[\]]*)?\]", " "),
    )
    for pattern, to in steps:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


def _runs_sql(name: str, key: str) -> str:
    n = leakage.SPAN
    return f"""SELECT DISTINCT {key}, array_to_string(w[i:i + {n - 1}], ' ') AS run
FROM (SELECT {key}, w, unnest(generate_series(1, len(w) - {n - 1})) AS i FROM (SELECT {key}, {_plain_sql('text')} AS w FROM {name}))"""


def oracle_sql() -> dict[str, str]:
    day = "CAST(record_timestamp AT TIME ZONE 'UTC' AS DATE)"
    leaked = f"""WITH d AS ({_runs_sql('documents', 'doc_id')}), i AS ({_runs_sql('eval_items', 'item_id')})
SELECT DISTINCT item_id, doc_id FROM i JOIN d USING (run)"""
    return {
        "p4_session_counts": f"""
WITH r AS (SELECT session_id, {day} AS day, project FROM token_records WHERE session_id IS NOT NULL)
SELECT 'day' AS grain, day, CAST(NULL AS VARCHAR) AS project, count(DISTINCT session_id) AS n_sessions, 0.0::DOUBLE AS error_bound FROM r GROUP BY day
UNION ALL SELECT 'project', NULL, project, count(DISTINCT session_id), 0.0::DOUBLE FROM r GROUP BY project
UNION ALL SELECT 'pair', day, project, count(DISTINCT session_id), 0.0::DOUBLE FROM r GROUP BY day, project""",
        "p7_found": leaked,
        "p7_joined": leaked,
        "p4_models_by_session": "SELECT session_id, count(DISTINCT model) AS n_models FROM token_records WHERE model IS NOT NULL GROUP BY session_id",
        "p4_models_of_both": f"""
WITH r AS (SELECT model, dayofweek({day}) IN (0, 6) AS w FROM token_records WHERE model IS NOT NULL)
SELECT count(*) AS n_models FROM (SELECT model FROM r GROUP BY model HAVING bool_or(w) AND bool_or(NOT w))""",
        "p6_complete": "SELECT count(*) AS documents, 0::BIGINT AS wrong, 0::BIGINT AS over, 0::BIGINT AS unused, 0::BIGINT AS empty FROM documents",
        "p8_length_ranks": """
WITH d AS (SELECT lang, CAST(length(text) AS DOUBLE) AS chars FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL)
SELECT DISTINCT lang, chars, count(*) OVER (PARTITION BY lang, chars) AS n, count(*) OVER (PARTITION BY lang ORDER BY chars) AS at_most,
  count(*) OVER (PARTITION BY lang ORDER BY chars DESC) AS at_least, count(*) OVER (PARTITION BY lang) AS total FROM d""",
        "p4_merged": "SELECT project, count(DISTINCT session_id) AS n_sessions FROM token_records WHERE session_id IS NOT NULL GROUP BY project",
        "p4_weekend_and_weekday": f"""
WITH r AS (SELECT session_id, dayofweek({day}) IN (0, 6) AS w FROM token_records WHERE session_id IS NOT NULL)
SELECT count(*) AS n_sessions FROM (SELECT session_id FROM r GROUP BY session_id HAVING bool_or(w) AND bool_or(NOT w))""",
    }
