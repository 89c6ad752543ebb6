"""Column functions over cached advisories and research attempts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldlab.constants import DISCLAIMER, LOCALE
from fieldlab.functions.records import instant, utc_text
from fieldlab.schemas import TIPS_PAYLOAD

#: The same with citations as wide as JSON numbers are read.
TIPS_PAYLOAD_WIDE = f"struct<{TIPS_PAYLOAD.replace('array<int>', 'array<bigint>')}>"


def _kind(value: Column, path: str) -> Column:
    """The JSON type at a path of a variant: null if there is nothing, ``VOID`` for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def _is_text(value: Column, path: str) -> Column:
    return F.coalesce(_kind(value, path) == "STRING", F.lit(False))


def _may_be_text(value: Column, path: str) -> Column:
    return F.coalesce(_kind(value, path), F.lit("VOID")).isin("VOID", "STRING")


def _each(value: Column, path: str, test) -> Column:
    """Whether there is a list at the path whose elements all pass."""
    items = F.when(F.startswith(_kind(value, path), F.lit("ARRAY")), F.try_variant_get(value, path, "array<variant>"))
    return F.coalesce(F.forall(items, test), F.lit(False))


def parse_payload(body: Column) -> Column:
    """The payload struct; null where the body breaks the contract, never an error.

    The body has to be one JSON object and nothing behind it, with every member
    of its type: numbers do not pass for texts, nor texts or decimals for
    citations.  Members beyond the contract are passed over; an object that
    has a member twice is refused.  Citations beyond an int point at nothing
    (-1).
    """
    # a last member of its own shows that the whole text was read: its value cannot stand in the body
    end = F.sha2(body, 256)
    v = F.try_parse_json(F.concat(F.lit('{"body":'), body, F.lit(',"end":"'), end, F.lit('"}')))
    tip = lambda t: _is_text(t, "$.text") & _each(t, "$.citations", lambda c: F.schema_of_variant(c) == "BIGINT")
    source = lambda s: _is_text(s, "$.title") & _is_text(s, "$.url") & _may_be_text(s, "$.publisher") & _may_be_text(s, "$.date")

    def checked(v: Column) -> Column:
        typed = (F.try_variant_get(v, "$.end", "string") == end) & F.startswith(_kind(v, "$.body"), F.lit("OBJECT"))
        for name in ("status", "disclaimer", "model", "retrievedAt"):
            typed = typed & _is_text(v, f"$.body.{name}")
        typed = typed & _each(v, "$.body.tips", tip) & _each(v, "$.body.sources", source)
        p = F.try_variant_get(v, "$.body", TIPS_PAYLOAD_WIDE)
        holds = p["status"].isin("grounded", "abstained") & instant(p["retrievedAt"]).isNotNull()
        index = lambda c: F.when(F.abs(c) < 1 << 31, c).otherwise(-1).cast("int")
        tips = F.transform(p["tips"], lambda t: F.struct(t["text"].alias("text"), F.transform(t["citations"], index).alias("citations")))
        whole = F.struct(p["status"].alias("status"), tips.alias("tips"), *(p[c].alias(c) for c in ("sources", "disclaimer", "model", "retrievedAt")))
        return F.when(F.coalesce(typed, F.lit(False)), F.when(F.coalesce(holds, F.lit(False)), whole))

    # the one-element array binds the parsed body to a name, so it is parsed once
    return F.get(F.transform(F.array(v), checked), F.lit(0))


def serialize_payload(payload: Column) -> Column:
    """JSON of a payload struct, its instant in UTC; empty publishers and dates are kept as null."""
    at = instant(payload["retrievedAt"])
    utc = payload.withField("retrievedAt", F.when(at.isNotNull(), utc_text(at)).otherwise(payload["retrievedAt"]))
    return F.to_json(utc, {"ignoreNullFields": "false"})


def shown_status(payload: Column) -> Column:
    return F.when((payload["status"] == "abstained") | (F.size(payload["tips"]) == 0), "abstained").otherwise("grounded")


def shown_disclaimer(payload: Column) -> Column:
    blank = payload["disclaimer"].rlike(r"^[\s\x85\ufeff\p{Z}]*\z")  # white space of any kind
    return F.when(blank, DISCLAIMER).otherwise(payload["disclaimer"])


def source_titles(payload: Column) -> Column:
    return F.transform(payload["sources"], lambda s: F.concat_ws(" — ", s["title"], s["publisher"]))


def valid_citations(payload: Column) -> Column:
    """The tips with the citations that point at a source."""
    n = F.size(payload["sources"])
    return F.transform(payload["tips"], lambda t: F.struct(t["text"].alias("text"), F.filter(t["citations"], lambda c: (c >= 0) & (c < n)).alias("citations")))


def request_body(locale: str = LOCALE) -> Column:
    """What research is asked for a record; null without a uuid or a class."""
    body = F.struct(F.col("uuid").alias("recordUuid"), F.col("texture_class").alias("textureClass"), "latitude", "longitude", "address", F.lit(locale).alias("locale"))
    return F.when((F.col("uuid") != "") & (F.col("texture_class") != ""), F.to_json(body, {"ignoreNullFields": "false"}))


def outcome(status_code: Column, transport: Column, body: Column) -> Column:
    """The kind of one attempt; ``transport`` names a timeout or network failure, and the body of a 200 has to keep the contract."""
    return (
        F.when(transport.isNotNull(), transport)
        .when((status_code == 200) & parse_payload(F.when(status_code == 200, body)).isNotNull(), "success")
        .when(status_code == 200, "malformedResponse")
        .when(status_code == 401, "unauthenticated")
        .when(status_code == 429, "rateLimited")
        .otherwise("upstreamUnavailable")
    )


def retryable(kind: Column, status_code: Column) -> Column:
    return kind.isin("timeout", "network") | ((kind == "upstreamUnavailable") & (status_code.isNull() | (status_code >= 500)))
