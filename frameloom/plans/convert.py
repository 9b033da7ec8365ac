"""Conversion routing, outcomes, statistics and settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.functions import scalars as X
from frameloom.operators import conversion as C
from frameloom.operators import validation as V
from frameloom.plans.base import query, table

JOBS_SQL = "jobs AS (SELECT l_extendedprice AS before, l_extendedprice * (1 - l_discount) AS after, l_linenumber AS attempts, l_returnflag <> 'R' AS success FROM lineitem)"
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
TRIES_SQL = "tries AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS before, n AS attempt, l_extendedprice * (1 - n * l_discount) AS after FROM lineitem, (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS n))"


def jobs(spark, d):
    price, cut = F.col("l_extendedprice"), F.col("l_discount")
    return table(spark, d, "lineitem").select(price.alias("before"), (price * (1 - cut)).alias("after"), F.col("l_linenumber").alias("attempts"), (F.col("l_returnflag") != "R").alias("success"))


def tries(spark, d):
    li = table(spark, d, "lineitem")
    each = li.select(*KEY, F.col("l_extendedprice").alias("before"), "l_discount", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("attempt"))
    return each.withColumn("after", F.col("before") * (1 - F.col("attempt") * F.col("l_discount"))).drop("l_discount")


@query("""SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'missing' WHEN doc_id % 13 = 0 THEN 'not a file' WHEN 10 * coalesce(toxic, 0) > 0 THEN 'already converted' WHEN n_chars <= 1000 THEN 'below threshold' ELSE 'convert' END AS decision
  FROM documents LEFT JOIN labels USING (doc_id)""")
def should_convert_case(spark, d):
    work = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    ratio = 10 * F.coalesce("toxic", F.lit(0))
    return work.select("doc_id", C.should_convert(F.col("doc_id") % 17 != 0, F.col("doc_id") % 13 != 0, ratio, F.col("n_chars"), threshold=1000).alias("decision"))


RATIO_SQL = "w AS (SELECT doc_id, toxic * (n_chars % 997) / 10.0::DOUBLE AS ratio FROM documents LEFT JOIN labels USING (doc_id))"


def work_list(spark, d):
    """doc_id and the reduction in percent that an earlier conversion noted, null without one."""
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.select("doc_id", (F.col("toxic") * (F.col("n_chars") % 997) / 10.0).alias("ratio"))


@query(f"WITH {RATIO_SQL} SELECT doc_id, NOT coalesce(ratio > 0, false) AS selected, CASE WHEN ratio > 0 THEN concat('Déjà converti (-', printf('%.1f', ratio), '%)') ELSE 'En attente' END AS state FROM w")
def selection_flag(spark, d):
    """What the list shows of a file, and whether it is chosen at first."""
    ratio = F.col("ratio")
    return work_list(spark, d).select("doc_id", C.selected(ratio, True).alias("selected"), C.list_state(ratio).alias("state"))


@query(f"WITH {RATIO_SQL} SELECT doc_id FROM w WHERE ratio IS NULL OR ratio <= 0")
def selected_rows(spark, d):
    return work_list(spark, d).where(C.selected(F.col("ratio"), True)).select("doc_id")


@query(f"""WITH {TRIES_SQL}, o AS (SELECT *, l_orderkey % 3 AS mode, (before - after) / before * 100 AS rate, after <= 30000 AS fits, after < before AND (after <= 30000 OR l_orderkey % 3 = 2 OR attempt >= 3) AS ok FROM tries)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, attempt, ok AS accepted, CASE WHEN ok AND fits THEN 'reduced' WHEN ok THEN 'reduced above threshold' WHEN after >= before THEN 'not smaller' ELSE 'above threshold' END AS outcome,
  CASE WHEN NOT ok THEN 'kept' WHEN mode = 0 THEN 'replaced' WHEN mode = 1 AND fits THEN 'deleted' WHEN mode = 2 THEN 'deleted' ELSE 'kept' END AS original,
  CASE WHEN ok AND fits THEN printf('Succès (-%.1f%%)', rate) WHEN ok THEN printf('Réduit (-%.1f%%) mais > seuil', rate) WHEN mode <> 2 AND attempt < 3 THEN NULL WHEN after >= before THEN printf('Échec: taille finale +%.1f%%', -rate) ELSE printf('Échec: taille finale (-%.1f%%) > seuil', rate) END AS message FROM o""")
def conversion_outcome(spark, d):
    """Outcome, message and the original's fate; settings by order: replaced, deleted within the threshold, or one attempt only and deleted whenever smaller."""
    b, a, n, mode = F.col("before"), F.col("after"), F.col("attempt"), F.col("l_orderkey") % 3
    many, one = [C.accepted(b, a, n, 30_000, several) for several in (True, False)]
    rows = tries(spark, d).withColumns({"mode": mode, "ok": F.when(mode == 2, one).otherwise(many)})
    ok, single = F.col("ok"), F.col("mode") == 2
    original = F.when(F.col("mode") == 0, C.original_fate(ok, a, 30_000, True, False, False)).when(single, C.original_fate(ok, a, 30_000, False, True, True)).otherwise(C.original_fate(ok, a, 30_000, False, True, False))
    return rows.select(*KEY, "attempt", ok.alias("accepted"), F.when(single, C.outcome(b, a, n, 30_000, False)).otherwise(C.outcome(b, a, n, 30_000)).alias("outcome"), original.alias("original"), F.when(single, C.message(b, a, n, 30_000, False)).otherwise(C.message(b, a, n, 30_000)).alias("message"))


@query(f"""WITH {TRIES_SQL}, o AS (SELECT *, after < before AND (after <= 30000 OR attempt >= 3) AS ok FROM tries)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, attempt, after, ok AS accepted FROM o
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY CASE WHEN ok THEN attempt ELSE 10 - attempt END) = 1""")
def first_successful_attempt(spark, d):
    return C.first_accepted(tries(spark, d), KEY, 30_000)


@query(f"WITH {JOBS_SQL} SELECT before, after, CASE WHEN before > 0 THEN (before - after) / before * 100 ELSE 0 END AS reduction, CASE WHEN before > 0 THEN after / before ELSE 0 END AS ratio FROM jobs")
def reduction_percent(spark, d):
    b, a = F.col("before"), F.col("after")
    return jobs(spark, d).select("before", "after", X.reduction_percent(b, a).alias("reduction"), F.when(b > 0, a / b).otherwise(F.lit(0.0)).alias("ratio"))


@query(f"WITH {JOBS_SQL} SELECT round(coalesce(sum(before - after) FILTER (WHERE success), 0), 3) AS space_saved FROM jobs")
def stats_space_saved(spark, d):
    return C.statistics(jobs(spark, d)).select(F.round("space_saved", 3).alias("space_saved"))


@query(f"WITH {JOBS_SQL} SELECT round(coalesce(avg(CASE WHEN before > 0 THEN after / before ELSE 0 END) FILTER (WHERE success), 0), 9) AS avg_ratio FROM jobs")
def stats_avg_ratio(spark, d):
    return C.statistics(jobs(spark, d)).select(F.round("avg_ratio", 9).alias("avg_ratio"))


@query(f"WITH {JOBS_SQL} SELECT round(coalesce(avg(CASE WHEN success THEN 1.0::DOUBLE ELSE 0 END), 0), 9) AS success_rate FROM jobs")
def stats_success_rate(spark, d):
    return C.statistics(jobs(spark, d)).select(F.round("success_rate", 9).alias("success_rate"))


@query(f"WITH {JOBS_SQL} SELECT round(coalesce(avg(attempts), 0), 9) AS avg_attempts FROM jobs")
def stats_avg_attempts(spark, d):
    return C.statistics(jobs(spark, d)).select(F.round("avg_attempts", 9).alias("avg_attempts"))


SAID = (
    "{}", '{"crf": 20, "preset": "slow", "attempts": [{"crf": 18}, {"preset": "fast"}, {}]}', '{"manual_mode": true, "size_threshold": 5, "use_size_threshold": false, "attempts": []}',
    '{"crf": ', '{"delete_if_smaller": true, "delete_if_threshold": true, "replace_original": true, "ignore_converted": false, "multiple_attempts": false}', "no json",
)
SAID_SQL = "said AS (SELECT event_id, [" + ", ".join(f"'{x}'" for x in SAID) + "][event_id % 6 + 1] AS t FROM events), j AS (SELECT event_id, CASE WHEN json_valid(t) THEN t ELSE '{}' END AS t FROM said)"
BOOLEANS = {"use_size_threshold": True, "manual_mode": False, "delete_if_smaller": False, "delete_if_threshold": False, "replace_original": False, "ignore_converted": True, "multiple_attempts": True}


def settings(spark, d):
    """Events as users with a settings text each."""
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.col("event_id") % len(SAID) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", C.settings_of(said).alias("s"))


@query(f"""WITH {SAID_SQL} SELECT event_id, coalesce(CAST(json_extract_string(t, '$.crf') AS INTEGER), 28) AS crf, coalesce(json_extract_string(t, '$.preset'), 'medium') AS preset, coalesce(CAST(json_extract_string(t, '$.size_threshold') AS BIGINT), 104857600) AS size_threshold,
  {", ".join(f"coalesce(CAST(json_extract_string(t, '$.{b}') AS BOOLEAN), {str(v).lower()}) AS {b}" for b, v in BOOLEANS.items())},
  CASE WHEN coalesce(json_array_length(t, '$.attempts'), 0) = 0 THEN '28 medium,30 slow,32 veryslow'
       ELSE array_to_string(list_transform(range(0, CAST(json_array_length(t, '$.attempts') AS BIGINT)), lambda i: concat(coalesce(json_extract_string(t, concat('$.attempts[', i, '].crf')), '28'), ' ', coalesce(json_extract_string(t, concat('$.attempts[', i, '].preset')), 'medium'))), ',') END AS attempts FROM j""")
def settings_defaults(spark, d):
    """All fields of the settings, each with its default where the text lacks it; all defaults where it is broken."""
    s = settings(spark, d).select("event_id", "s.*")
    return s.withColumn("attempts", F.array_join(F.transform("attempts", lambda a: F.concat(a["crf"].cast("string"), F.lit(" "), a["preset"])), ","))


@query(f"""WITH {SAID_SQL}, n AS (SELECT event_id, t, CAST(event_id % 4 + 1 AS INTEGER) AS n, coalesce(json_array_length(t, '$.attempts'), 0) AS listed FROM j),
p AS (SELECT event_id, n, CASE WHEN json_extract_string(t, '$.manual_mode') = 'true' THEN concat(coalesce(json_extract_string(t, '$.crf'), '28'), ' ', coalesce(json_extract_string(t, '$.preset'), 'medium')) WHEN listed = 0 THEN ['28 medium', '30 slow', '32 veryslow'][n]
  WHEN n <= listed THEN concat(coalesce(json_extract_string(t, concat('$.attempts[', n - 1, '].crf')), '28'), ' ', coalesce(json_extract_string(t, concat('$.attempts[', n - 1, '].preset')), 'medium')) END AS p FROM n)
SELECT event_id, n AS attempt, CASE WHEN p IS NOT NULL THEN concat('ffmpeg -i in', event_id, '.mkv -c:v libx264 -crf ', split_part(p, ' ', 1), ' -preset ', split_part(p, ' ', 2), ' -y in', event_id, '_conv.mkv') END AS command,
  CASE n WHEN 1 THEN 'libx264 23 medium' WHEN 2 THEN 'libx264 28 slow' WHEN 3 THEN 'libx265 32 veryslow' END AS progressive FROM p""")
def transcode_plan(spark, d):
    """The encoder call of an attempt under each user's settings, and the progressive table's parameters; no command where an attempt isn't listed."""
    n, name = (F.col("event_id") % 4 + 1).cast("int"), F.concat(F.lit("in"), F.col("event_id").cast("string"))
    command = C.transcode_command(F.concat(name, F.lit(".mkv")), F.concat(name, F.lit("_conv.mkv")), C.attempt_parameters(F.col("s"), n))
    g = C.progressive_parameters(n)
    return settings(spark, d).select("event_id", n.alias("attempt"), F.array_join(F.when(C.attempt_parameters(F.col("s"), n).isNotNull(), command), " ").alias("command"), F.when(g.isNotNull(), F.concat_ws(" ", g["codec"], g["crf"].cast("string"), g["preset"])).alias("progressive"))


@query("""WITH c AS (SELECT p_partkey, ['', 'Erreur: x', 'En attente', 'processing', 'idle', 'error', 'Erreur'][p_partkey % 7 + 1] AS state FROM part)
SELECT p_partkey, state, state NOT IN ('idle', 'error') AS busy, left(state, 6) = 'Erreur' AS failed FROM c""")
def state_flags(spark, d):
    """Busy states, and texts that are shown as errors."""
    states = F.array(*map(F.lit, ("", "Erreur: x", "En attente", "processing", "idle", "error", "Erreur")))
    rows = table(spark, d, "part").select("p_partkey", F.element_at(states, (F.col("p_partkey") % 7 + 1).cast("int")).alias("state"))
    return rows.select("p_partkey", "state", V.busy(F.col("state")).alias("busy"), V.is_error_state(F.col("state")).alias("failed"))
