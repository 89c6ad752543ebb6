"""Queries of the photo audit, over 8 x 8 planes and over photos of several shapes."""

from pyspark.sql import functions as F

from fieldlab.constants import QualityCriteria
from fieldlab.operators import quality as Q
from fieldlab.sources.standins import PHOTOS_SQL, PLANES_SQL, photos, planes, table

QUERIES, SQL = {}, {}
SIDE = 8
#: Thresholds that set the small planes apart.
CRITERIA = C = QualityCriteria(min_blur=35000.0, min_luma=120.0, max_luma=135.0, max_clipped=0.01, min_contrast=48.0, max_cast=0.06, max_specular=0.01, min_side=SIDE)
_W = f"WITH {PLANES_SQL}, lit AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS l FROM planes)"
_LUMA = "avg(l) AS mean_luma, stddev_pop(l) AS contrast, avg((l <= 2.0 OR l >= 253.0)::INT::DOUBLE) AS clipped"
_CAST = "greatest(abs(avg(r) - avg(g)), abs(avg(r) - avg(b)), abs(avg(g) - avg(b))) / 255 AS cast_"
_SHINY = """avg((l >= 250.0 AND CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END <= 0.1::DOUBLE)::INT::DOUBLE) AS specular"""
_EDGE = """edges AS (SELECT image_id, lag(l) OVER rw + lead(l) OVER rw + lag(l) OVER cl + lead(l) OVER cl - 4 * l AS e FROM lit
  WINDOW rw AS (PARTITION BY image_id, y ORDER BY x), cl AS (PARTITION BY image_id, x ORDER BY y)),
blurs AS (SELECT image_id, var_pop(e) AS blur FROM edges WHERE e IS NOT NULL GROUP BY image_id)"""
def _failing(c):
    """The criteria that the rows of ``metrics`` fail, with what was measured."""
    return f"""failing AS (
  SELECT image_id, 1 AS no, 'blur' AS criterion, true AS blocking, blur AS measured, {c.min_blur}::DOUBLE AS threshold FROM metrics WHERE blur < {c.min_blur}
  UNION ALL SELECT image_id, 2, 'exposure', true, mean_luma, CASE WHEN mean_luma < {c.min_luma} THEN {c.min_luma}::DOUBLE ELSE {c.max_luma}::DOUBLE END FROM metrics WHERE mean_luma < {c.min_luma} OR mean_luma > {c.max_luma}
  UNION ALL SELECT image_id, 3, 'clipping', true, clipped, {c.max_clipped}::DOUBLE FROM metrics WHERE clipped > {c.max_clipped}::DOUBLE
  UNION ALL SELECT image_id, 4, 'contrast', false, contrast, {c.min_contrast}::DOUBLE FROM metrics WHERE contrast < {c.min_contrast}
  UNION ALL SELECT image_id, 5, 'colorCast', false, cast_, {c.max_cast}::DOUBLE FROM metrics WHERE cast_ > {c.max_cast}::DOUBLE
  UNION ALL SELECT image_id, 6, 'specular', false, specular, {c.max_specular}::DOUBLE FROM metrics WHERE specular > {c.max_specular}::DOUBLE
  UNION ALL SELECT image_id, 7, 'resolution', true, side, {c.min_side} FROM metrics WHERE side < {c.min_side})"""


_ALL = f"""{_W}, {_EDGE}, metrics AS (SELECT * FROM (SELECT image_id, {_LUMA}, {_CAST}, {_SHINY}, 8 AS side FROM lit GROUP BY image_id) JOIN blurs USING (image_id)),
{_failing(C)}"""


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df, *names):
    return df.select(*(F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns))


@query("roi_square", "SELECT doc_id, (n_chars - least(n_chars, doc_id % 3000 + 1)) // 2 AS x, (doc_id % 3000 + 1 - least(n_chars, doc_id % 3000 + 1)) // 2 AS y, least(n_chars, doc_id % 3000 + 1) AS side FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", Q.roi(F.col("n_chars"), F.col("doc_id") % 3000 + 1).alias("roi")).select("doc_id", "roi.*")


@query("luma_stats", f"{_W} SELECT image_id, round(mean_luma, 6) AS mean_luma, round(contrast, 6) AS contrast, round(clipped, 6) AS clipped FROM (SELECT image_id, {_LUMA} FROM lit GROUP BY image_id)")
def _(spark, d):
    return rounded(Q.luma_stats(planes(spark, d)), "mean_luma", "contrast", "clipped")


@query("color_cast", f'{_W} SELECT image_id, round(cast_, 6) AS "cast" FROM (SELECT image_id, {_CAST} FROM lit GROUP BY image_id)')
def _(spark, d):
    return rounded(Q.color_cast(planes(spark, d)), "cast")


@query("specular_fraction", f"{_W} SELECT image_id, round(specular, 6) AS specular FROM (SELECT image_id, {_SHINY} FROM lit GROUP BY image_id)")
def _(spark, d):
    return rounded(Q.specular_fraction(planes(spark, d)), "specular")


@query("box_downscale", f"""{_W}, w AS (SELECT o, i, (least((o + 1) * 1.6::DOUBLE, i + 1) - greatest(o * 1.6::DOUBLE, i)) / 1.6::DOUBLE AS w FROM (SELECT unnest(range(5)) AS o) CROSS JOIN (SELECT unnest(range(8)) AS i)),
  ww AS (SELECT * FROM w WHERE w > 0)
  SELECT image_id, CAST(wy.o AS INT) AS y, CAST(wx.o AS INT) AS x, round(sum(l * wx.w * wy.w), 10) AS v FROM lit JOIN ww wx ON wx.i = x JOIN ww wy ON wy.i = y GROUP BY 1, 2, 3""")
def _(spark, d):
    return Q.box_downscale(planes(spark, d).select("image_id", "y", "x", Q.luma().alias("v")), SIDE, 5).select("image_id", "y", "x", F.round("v", 10).alias("v"))


@query("laplacian_variance", f"{_W}, {_EDGE} SELECT image_id, round(blur, 4) AS blur FROM blurs")
def _(spark, d):
    return Q.laplacian_variance(planes(spark, d).select("image_id", "y", "x", Q.luma().alias("v"))).select("image_id", F.round("blur", 4).alias("blur"))


_VERDICT = "CASE WHEN max(blocking::INT) = 1 THEN 'blocking' WHEN count(criterion) > 0 THEN 'advisory' ELSE 'ok' END AS verdict"


@query("quality_verdict", f"{_ALL} SELECT m.image_id, {_VERDICT} FROM metrics m LEFT JOIN failing f ON f.image_id = m.image_id GROUP BY 1")
def _(spark, d):
    return Q.pixel_metrics(planes(spark, d), SIDE).select("image_id", Q.verdict(Q.failures(CRITERIA)).alias("verdict"))


#: Photos above this side are averaged down for blur, and smaller ones than the least side fail.
BLUR, LEAST = 12, 10
AUDIT = A = QualityCriteria(min_blur=20000.0, min_luma=120.0, max_luma=135.0, max_clipped=0.01, min_contrast=48.0, max_cast=0.06, max_specular=0.01, min_side=LEAST)
_AUDIT = f"""WITH {PHOTOS_SQL}, lit AS (SELECT image_id, least(w, h) AS side, x - (w - least(w, h)) // 2 AS x, y - (h - least(w, h)) // 2 AS y, r, g, b, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS l
    FROM photos WHERE x - (w - least(w, h)) // 2 BETWEEN 0 AND least(w, h) - 1 AND y - (h - least(w, h)) // 2 BETWEEN 0 AND least(w, h) - 1),
  share AS (SELECT o, i, (least((o + 1) * 16 / {BLUR}::DOUBLE, i + 1) - greatest(o * 16 / {BLUR}::DOUBLE, i)) * {BLUR} / 16::DOUBLE AS part FROM (SELECT unnest(range({BLUR})) AS o) CROSS JOIN (SELECT unnest(range(16)) AS i)),
  sw AS (SELECT * FROM share WHERE part > 0),
  plane AS (SELECT image_id, x, y, l FROM lit WHERE side <= {BLUR} UNION ALL SELECT image_id, a.o, b.o, sum(l * a.part * b.part) FROM lit JOIN sw a ON a.i = x JOIN sw b ON b.i = y WHERE side > {BLUR} GROUP BY 1, 2, 3),
  edges AS (SELECT image_id, lag(l) OVER rw + lead(l) OVER rw + lag(l) OVER cl + lead(l) OVER cl - 4 * l AS e FROM plane WINDOW rw AS (PARTITION BY image_id, y ORDER BY x), cl AS (PARTITION BY image_id, x ORDER BY y)),
  blurs AS (SELECT image_id, var_pop(e) AS blur FROM edges WHERE e IS NOT NULL GROUP BY image_id),
  metrics AS (SELECT * FROM (SELECT image_id, any_value(side) AS side, {_LUMA}, {_CAST}, {_SHINY} FROM lit GROUP BY image_id) JOIN blurs USING (image_id)),
  failing AS (SELECT image_id, unnest([{{'no': 1, 'name': 'blur', 'hit': blur < {A.min_blur}, 'blocking': true}}, {{'no': 2, 'name': 'exposure', 'hit': mean_luma NOT BETWEEN {A.min_luma} AND {A.max_luma}, 'blocking': true}},
    {{'no': 3, 'name': 'clipping', 'hit': clipped > {A.max_clipped}::DOUBLE, 'blocking': true}}, {{'no': 4, 'name': 'contrast', 'hit': contrast < {A.min_contrast}, 'blocking': false}}, {{'no': 5, 'name': 'colorCast', 'hit': cast_ > {A.max_cast}::DOUBLE, 'blocking': false}},
    {{'no': 6, 'name': 'specular', 'hit': specular > {A.max_specular}::DOUBLE, 'blocking': false}}, {{'no': 7, 'name': 'resolution', 'hit': side < {LEAST}, 'blocking': true}}]) AS f FROM metrics)
  SELECT m.image_id, round(any_value(blur), 4) AS blur, round(any_value(mean_luma), 11) AS mean_luma, round(any_value(contrast), 6) AS contrast, round(any_value(specular), 6) AS specular, CAST(any_value(side) AS INT) AS side,
    coalesce(string_agg(f.name, ',' ORDER BY f.no) FILTER (WHERE f.hit), '') AS failing, CASE WHEN bool_or(f.hit AND f.blocking) THEN 'blocking' WHEN bool_or(f.hit) THEN 'advisory' ELSE 'ok' END AS verdict
  FROM metrics m JOIN failing f ON f.image_id = m.image_id GROUP BY 1"""


#: The same up to the metrics, with every failing criterion.
_SHOTS = f"""{_AUDIT.split(",\n  failing AS")[0]}, {_failing(A)}"""


def shots(spark, d):
    """Photos as images, and their metrics."""
    return Q.image_metrics(Q.as_images(photos(spark, d)), "image_id", BLUR)


def _places(x):
    """So many places that neither sum errors nor ties show."""
    return f"CASE criterion WHEN 'blur' THEN round({x}, 4) WHEN 'exposure' THEN round({x}, 11) ELSE round({x}, 6) END"


@query("quality_evaluate", f"{_SHOTS} SELECT image_id, criterion, blocking, {_places('measured')} AS measured, threshold, {_places('abs(measured - threshold)')} AS margin FROM failing")
def _(spark, d):
    f = shots(spark, d).select("image_id", F.explode(Q.failures(AUDIT)).alias("f")).select("image_id", "f.*")
    return f.select("image_id", "criterion", "blocking", F.expr(_places("measured")).alias("measured"), "threshold", F.expr(_places("margin")).alias("margin"))


@query("image_quality_audit", _AUDIT)
def image_quality_audit(spark, d):
    a = Q.audit(Q.as_images(photos(spark, d)), "image_id", AUDIT, BLUR)
    # means are multiples of 0.001 / 256, whole at 11 places
    return a.select("image_id", F.round("blur", 4).alias("blur"), F.round("mean_luma", 11).alias("mean_luma"), F.round("contrast", 6).alias("contrast"), F.round("specular", 6).alias("specular"), "side", F.array_join(F.transform("failures", lambda f: f["criterion"]), ",").alias("failing"), "verdict")


@query("verify_images", "SELECT vec_id AS image_id FROM embeddings WHERE vec_id % 50 = 0")
def _(spark, d):
    cut = planes(spark, d).where("NOT (image_id % 50 = 0 AND y = 3)")
    return Q.verify_images(Q.as_images(cut, SIDE), "image_id")


@query("image_features", f"""WITH {PLANES_SQL}, blocks AS (SELECT image_id, y // 2 AS oy, x // 2 AS ox, avg(r) / 255 AS r, avg(g) / 255 AS g, avg(b) / 255 AS b FROM planes GROUP BY ALL),
  v AS (SELECT image_id, oy, ox, unnest([1, 2, 3]) AS c, unnest([r, g, b]) AS v FROM blocks)
  SELECT image_id, CAST(count(*) AS INT) AS n_features, list(round(v, 5) ORDER BY oy, ox, c) AS features FROM v GROUP BY image_id""")
def _(spark, d):
    f = Q.resize_features(Q.as_images(planes(spark, d), SIDE), "image_id", 4)
    return f.select("image_id", F.size("features").alias("n_features"), F.transform("features", lambda v: F.round(v.cast("double"), 5)).alias("features"))
