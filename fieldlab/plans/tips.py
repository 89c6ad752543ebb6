"""Queries over cached advisories and research attempts."""

from pyspark.sql import functions as F

from fieldlab.constants import DISCLAIMER
from fieldlab.functions import tips as T
from fieldlab.operators import tips as O
from fieldlab.plans.catalogue import _W
from fieldlab.sources.standins import ATTEMPTS_SQL, RECORDS_SQL, TIPS_SQL, attempt_log, records, table, tips_cache

QUERIES, SQL = {}, {}
_RT = f"WITH {RECORDS_SQL}, {TIPS_SQL} "
_T = f"WITH {TIPS_SQL} "
_STAMP = "2026-01-01T00:00:00.000Z"


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("tips_for_record", _RT + "SELECT id, uuid, t.record_uuid IS NOT NULL AS cached, CASE WHEN NOT broken THEN status END AS status FROM records LEFT JOIN tips_cache t ON t.record_uuid = uuid WHERE NOT deleted")
def _(spark, d):
    return O.for_records(records(spark, d), tips_cache(spark, d)).select("id", "uuid", "cached", F.col("tips.status").alias("status"))


@query("tips_eligible_uncached", _RT + "SELECT id, uuid, texture_class FROM records WHERE NOT deleted AND texture_class <> '' AND uuid NOT IN (SELECT record_uuid FROM tips_cache)")
def _(spark, d):
    return O.work_list(records(spark, d), tips_cache(spark, d)).select("id", "uuid", "texture_class")


@query("tips_upsert", _T + f"SELECT record_uuid, CASE WHEN conv_id % 3 = 0 THEN '2026-02-02T00:00:00.000Z' ELSE '{_STAMP}' END AS retrieved_at FROM tips_cache UNION ALL SELECT DISTINCT 'new-' || conv_id, '2026-02-02T00:00:00.000Z' FROM turns WHERE conv_id % 3 = 0")
def _(spark, d):
    cache = tips_cache(spark, d)
    old = cache.select("record_uuid", "retrieved_at")
    fresh = cache.where("conv_id % 3 = 0").select(F.explode(F.array("record_uuid", F.concat(F.lit("new-"), "conv_id"))).alias("record_uuid"), F.lit("2026-02-02T00:00:00.000Z").alias("retrieved_at"))
    return O.upsert(old, fresh)


@query("tips_delete", _T + "SELECT record_uuid FROM tips_cache WHERE conv_id % 4 <> 1")
def _(spark, d):
    cache = tips_cache(spark, d)
    return O.delete(cache, cache.where("conv_id % 4 = 1").select("record_uuid").unionByName(cache.select(F.concat(F.lit("none-"), "record_uuid").alias("record_uuid")))).select("record_uuid")


@query("tips_parse", _T + "SELECT record_uuid, CASE WHEN broken THEN 'malformedResponse' ELSE 'success' END AS outcome, CASE WHEN broken THEN -1 ELSE n_tips END AS n_tips, CASE WHEN broken THEN -1 ELSE n_sources END AS n_sources FROM tips_cache")
def _(spark, d):
    p = tips_cache(spark, d).select("record_uuid", T.parse_payload(F.col("payload_json")).alias("p"))
    return p.select("record_uuid", F.when(F.col("p").isNull(), "malformedResponse").otherwise("success").alias("outcome"), F.coalesce(F.size("p.tips"), F.lit(-1)).alias("n_tips"), F.coalesce(F.size("p.sources"), F.lit(-1)).alias("n_sources"))


@query("tips_serialize", _T + f"""SELECT c.record_uuid, CAST(to_json({{'status': c.status,
    'tips': coalesce((SELECT list({{'text': text, 'citations': [CAST(turn AS INT), CAST(turn + 1 AS INT)]}} ORDER BY turn, text) FROM turns t WHERE t.conv_id = c.conv_id AND role = 'assistant'), []),
    'sources': coalesce((SELECT list({{'title': title, 'url': url, 'publisher': publisher, 'date': CAST(NULL AS VARCHAR)}} ORDER BY source_no) FROM source s WHERE s.conv_id = c.conv_id), []),
    'disclaimer': disclaimer, 'model': 'm1', 'retrievedAt': '{_STAMP}'}}) AS VARCHAR) AS body FROM tips_cache c""")
def _(spark, d):
    return tips_cache(spark, d).select("record_uuid", T.serialize_payload(F.col("payload")).alias("body"))


@query("tip_citations", _T + """, cited AS (SELECT t.conv_id, tip_no, unnest([turn, turn + 1]) AS c FROM tip t),
  good AS (SELECT x.conv_id, tip_no, c + 1 AS label, title FROM cited x JOIN source s ON s.conv_id = x.conv_id AND s.source_no = c)
  SELECT k.record_uuid, CAST(t.tip_no AS INT) AS tip_no, CAST(coalesce(label, -1) AS INT) AS label, title FROM tip t JOIN tips_cache k ON k.conv_id = t.conv_id
  LEFT JOIN good g ON g.conv_id = t.conv_id AND g.tip_no = t.tip_no WHERE NOT broken""")
def _(spark, d):
    return O.citations(tips_cache(spark, d)).withColumn("label", F.coalesce("label", F.lit(-1)))


@query("tips_status", _T + f"""SELECT record_uuid, CASE WHEN n_tips = 0 THEN 'abstained' ELSE status END AS shown, CASE WHEN trim(disclaimer, ' ' || chr(9) || chr(10)) = '' THEN '{DISCLAIMER}' ELSE disclaimer END AS disclaimer,
  coalesce((SELECT string_agg(concat_ws(' — ', title, publisher), '; ' ORDER BY source_no) FROM source s WHERE s.conv_id = c.conv_id), '') AS titles FROM tips_cache c WHERE NOT broken""")
def _(spark, d):
    p = tips_cache(spark, d).select("record_uuid", T.parse_payload(F.col("payload_json")).alias("p")).where("p IS NOT NULL")
    return p.select("record_uuid", T.shown_status(F.col("p")).alias("shown"), T.shown_disclaimer(F.col("p")).alias("disclaimer"), F.array_join(T.source_titles(F.col("p")), "; ").alias("titles"))


@query("research_requests", _W + """SELECT id, CASE WHEN texture_class <> '' THEN CAST(to_json({'recordUuid': uuid, 'textureClass': texture_class, 'latitude': latitude, 'longitude': longitude, 'address': address, 'locale': 'pt-BR'}) AS VARCHAR) END AS body,
  CASE WHEN coalesce(texture_class, '') = '' THEN 'invalidRecord' END AS failure FROM records WHERE NOT deleted""")
def _(spark, d):
    r = O.live(records(spark, d)).select("id", T.request_body().alias("body"))
    return r.withColumn("failure", F.when(F.col("body").isNull(), "invalidRecord"))


@query("response_outcome", f"WITH {ATTEMPTS_SQL} SELECT event_id, outcome, retryable FROM judged")
def _(spark, d):
    return O.attempt_outcomes(attempt_log(spark, d)).select("event_id", "outcome", "retryable")


@query("attempts_to_result", f"""WITH {ATTEMPTS_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY retryable, CASE WHEN retryable THEN -attempt ELSE attempt END) AS place FROM judged WHERE attempt <= 3)
  SELECT request, attempt, outcome FROM placed WHERE place = 1""")
def _(spark, d):
    return O.final_results(attempt_log(spark, d))
