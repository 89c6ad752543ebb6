from pyspark.sql import functions as F

from fieldlab.functions import tips as T
from fieldlab.operators import tips as O

GOOD = '{"status":"grounded","tips":[{"text":"t","citations":[0,5,-1]},{"text":"u","citations":[]}],"sources":[{"title":"S","url":"u","publisher":null,"date":null}],"disclaimer":" ","model":"m","retrievedAt":"2026-01-01T00:00:00.000Z"}'


def test_broken_payloads_never_raise(spark):
    bodies = [GOOD, "nope", "[]", "{}", "", None, GOOD.replace('"S"', "null"), GOOD.replace("grounded", "odd"), GOOD.replace('"m"', "null"), GOOD.replace("2026-01-01T00:00:00.000Z", "x"), GOOD.replace("[0,5,-1]", "null")]
    got = [r[0] for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(T.parse_payload(F.col("b")).isNotNull()).collect()]
    assert got == [True] + [False] * 10


def test_types_of_the_contract(spark):
    """Each wrong body is refused, whatever a lenient reader would make of it."""
    swap = lambda a, b: GOOD.replace(a, b, 1)
    wrong = [
        swap('"text":"t"', '"text":5'), swap('"disclaimer":" "', '"disclaimer":{"a":1}'), swap('"m"', "true"), swap('"publisher":null', '"publisher":7'), GOOD + " trailing", GOOD.replace('"', "'"),
        GOOD + GOOD, f"[{GOOD}]", GOOD + "}", GOOD + ',"end":"x"}', GOOD[:-1], swap("[0,5,-1]", "[0,1.0]"), swap("[0,5,-1]", '["0"]'), swap("[0,5,-1]", "{}"), swap("[0,5,-1]", "[null]"), swap('"tips":[', '"tips":[3,'), swap('"tips":[', '"tips":[null,'),
        swap('"url":"u"', '"uri":"u"'), swap('"sources":[', '"sources":["s",'), swap('"status":"grounded"', '"status":["grounded"]'), swap('"model"', '"Model"'), '"text"', "null", "5", "{}{}",
    ]
    fine = [GOOD, f"  {GOOD}\n", swap('"model"', '"more":{"x":[1,"a",null]},"model"'), swap('"publisher":null,"date":null', '"date":"2020"'), swap("[0,5,-1]", "[]"), swap("[0,5,-1]", "[9000000000]"), swap('"disclaimer":" "', '"disclaimer":"\\u00e9\\" ]}"')]
    rows = spark.createDataFrame([(b, False) for b in wrong] + [(b, True) for b in fine], "b string, want boolean").select("b", "want", T.parse_payload(F.col("b")).alias("p")).collect()
    assert [r["b"] for r in rows if (r["p"] is not None) != r["want"]] == []
    assert {r["p"]["tips"][0]["citations"][0] for r in rows if r["want"] and r["p"]["tips"][0]["citations"]} == {0, -1}
    assert spark.createDataFrame([(GOOD, None, 200)], "b string, t string, s int").select(T.outcome(F.col("s"), F.col("t"), F.col("b"))).first()[0] == "success"


def test_serialized_instants_are_utc(spark):
    stamps = {"2026-01-01T10:00:00-05:00": "2026-01-01T15:00:00.000Z", "2026-01-01T00:00:00Z": "2026-01-01T00:00:00.000Z", "20260101 101112.1234567": "2026-01-01T10:11:12.123456Z", "2026-01-01T00:00:00.120+0130": "2025-12-31T22:30:00.120Z"}
    rows = spark.createDataFrame([(k,) for k in stamps], "s string").select("s", T.parse_payload(F.replace(F.lit(GOOD), F.lit("2026-01-01T00:00:00.000Z"), F.col("s"))).alias("p"))
    for r in rows.select("s", T.serialize_payload(F.col("p")).alias("j")).collect():
        assert f'"retrievedAt":"{stamps[r["s"]]}"' in r["j"], r


def test_upsert_keeps_one_row_a_record(spark):
    kind = "record_uuid string, payload_json string, retrieved_at string"
    cache = spark.createDataFrame([("a", "old", "2026-01-01T00:00:00Z"), ("b", "old", "2026-01-01T00:00:00Z")], kind)
    new = spark.createDataFrame([("a", "x", "2026-01-02T00:00:00Z"), ("a", "y", "2026-01-02T03:00:00+05:00"), ("a", "x", "2026-01-02T00:00:00Z"), ("c", "p", "t"), ("c", "q", "t")], kind)
    assert sorted(map(tuple, O.upsert(cache, new).collect())) == [("a", "x", "2026-01-02T00:00:00Z"), ("b", "old", "2026-01-01T00:00:00Z"), ("c", "q", "t")]


def test_locale_of_a_request(spark):
    row = spark.createDataFrame([("u", "c", 1.0, 2.0, "a")], "uuid string, texture_class string, latitude double, longitude double, address string")
    assert '"locale":"en-GB"' in row.select(T.request_body("en-GB")).first()[0] and '"locale":"pt-BR"' in row.select(T.request_body()).first()[0]


def test_citations_out_of_range_are_dropped(spark):
    cache = spark.createDataFrame([("r", GOOD)], "record_uuid string, payload_json string")
    rows = sorted((r["tip_no"], r["label"], r["title"]) for r in O.citations(cache).collect())
    assert rows == [(0, 1, "S"), (1, None, None)]


def test_round_trip_and_display(spark):
    p = spark.createDataFrame([(GOOD,)], "b string").select(T.parse_payload(F.col("b")).alias("p"))
    assert p.select(T.serialize_payload(F.col("p"))).first()[0] == GOOD
    shown = p.select(T.shown_status(F.col("p")), T.shown_disclaimer(F.col("p")), T.source_titles(F.col("p"))).first()
    assert shown[0] == "grounded" and shown[1].startswith("Dicas") and shown[2] == ["S"]


def test_attempts(spark):
    log = [("a", 1, 503, None, None), ("a", 2, 200, None, GOOD), ("b", 1, 503, None, None), ("b", 2, None, "timeout", None), ("b", 3, 500, None, GOOD), ("b", 4, 200, None, GOOD), ("c", 1, 401, None, None), ("c", 2, 200, None, GOOD), ("d", 1, 404, None, None), ("e", 1, 200, None, GOOD + "x")]
    df = spark.createDataFrame(log, "request string, attempt int, status_code int, transport string, body string")
    got = {r["request"]: (r["attempt"], r["outcome"]) for r in O.final_results(df).collect()}
    assert got == {"a": (2, "success"), "b": (3, "upstreamUnavailable"), "c": (1, "unauthenticated"), "d": (1, "upstreamUnavailable"), "e": (1, "malformedResponse")}
