"""The queries of the image and sequence operators, by name, and DuckDB SQL for each.

Images are the vectors of ``embeddings``, as rasters of 8 by 8; pairs of images are a vector and the
one with the next id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.functions import strings
from rasterloom.model import Domain, raster
from rasterloom.operators import derived, geometry, metrics, sequence, spatial, stats, voxel
from rasterloom.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
GRID = Domain((8, 8, 1))
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PX = """px AS (SELECT vec_id AS image_id, ((pos - 1) % 8)::INT AS x, ((pos - 1) // 8)::INT AS y, embedding[pos]::DOUBLE AS v
    FROM embeddings, LATERAL (SELECT unnest(range(1, 65)) AS pos))"""
PAIR = f"""{PX}, bo AS (SELECT p.vec_id AS image_id, p.embedding AS a, q.embedding AS b FROM embeddings p JOIN embeddings q ON q.vec_id = p.vec_id + 1),
    pr AS (SELECT image_id, ((pos - 1) % 8)::INT AS x, ((pos - 1) // 8)::INT AS y, a[pos]::DOUBLE AS a, b[pos]::DOUBLE AS b FROM bo, LATERAL (SELECT unnest(range(1, 65)) AS pos))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of all vectors, in one row each; nothing is shuffled."""
    return raster(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", GRID)


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels dealt out by image before they are unrolled, so that the shuffle moves arrays and windows need none."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").withColumnRenamed("vec_id", "image_id").repartition("image_id")
    return raster(vectors, "image_id", "embedding", GRID)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels ``a`` of an image and ``b`` of the one with the next id: vectors are joined before they are unrolled."""
    left = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("a"))
    right = table(spark, sf_dir, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    both = left.join(right, "vec_id").select("vec_id", F.arrays_zip("a", "b").alias("ab"))
    rows = both.select(F.col("vec_id").alias("image_id"), F.posexplode("ab").alias("pos", "ab"))
    return rows.select("image_id", (F.col("pos") % 8).cast("int").alias("x"), F.floor(F.col("pos") / 8).cast("int").alias("y"), F.lit(0).alias("z"), F.col("ab.a").cast("double").alias("a"), F.col("ab.b").cast("double").alias("b"))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def V() -> Column:  # noqa: N802
    """The value of a voxel; made where a query is, since columns need a session."""
    return F.col("v")


def pointwise(name: str, value: Callable[[], Column], sql: str, digits: int | None = 6, source: str = "px", of: Callable = images) -> None:
    """Register a query of one expression over voxels, ``out``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return of(spark, sf_dir).select("image_id", "x", "y", (F.round(value(), digits) if digits is not None else value()).alias("out"))

    run.__name__ = name
    out = f"round(({sql})::DOUBLE, {digits})" if digits is not None else sql
    query(f"WITH {PX if source == 'px' else PAIR} SELECT image_id, x, y, {out} AS out FROM {source}")(run)


pointwise("voxel_scan", lambda: V(), "v")
pointwise("voxel_add_vs", lambda: voxel.add_vs(V(), 0.5), "v + 0.5")
pointwise("voxel_sub_vs", lambda: voxel.sub_vs(V(), 0.5), "v - 0.5")
pointwise("voxel_mul_vs", lambda: voxel.mul_vs(V(), 3.0), "v * 3.0")
pointwise("voxel_div_vs", lambda: voxel.div_vs(V(), 4.0), "v * (1 / 4.0)")
pointwise("voxel_sub_sv", lambda: voxel.sub_sv(2.0, V()), "2.0 - v")
pointwise("voxel_div_sv", lambda: voxel.div_sv(2.0, V() + 3), "2.0 / (v + 3)")
pointwise("voxel_abs", lambda: voxel.absolute(V()), "abs(v)")
pointwise("voxel_constant", lambda: voxel.constant(7), "7.0")
pointwise("voxel_arith_vv", lambda: (F.col("a") + F.col("b")) * F.col("a") - F.col("b"), "(a + b) * a - b", source="pr", of=pairs)
pointwise("voxel_div_vv", lambda: voxel.divide(F.col("a"), F.col("b") + 2), "a / (b + 2)", source="pr", of=pairs)
pointwise("voxel_mask", lambda: voxel.masked(V(), V() > 0.1), "CASE WHEN v > 0.1 THEN v ELSE 0 END")
pointwise("voxel_eq_sv", lambda: voxel.eq_sv(0.0, F.round(V(), 1)), "round(v, 1) = 0", None)
pointwise("voxel_geq_sv", lambda: voxel.geq_sv(0.1, V()), "v >= 0.1", None)
pointwise("voxel_leq_sv", lambda: voxel.leq_sv(0.1, V()), "v <= 0.1", None)
pointwise("voxel_between", lambda: voxel.between(-0.1, 0.1, V()), "v BETWEEN -0.1 AND 0.1", None)
pointwise("voxel_compare_vv", lambda: (F.col("a") < F.col("b")) & (F.col("a") != F.col("b")) | (F.col("a") >= F.col("b") + 0.1), "a < b AND a <> b OR a >= b + 0.1", None, "pr", pairs)
pointwise("mask_and_or_not", lambda: voxel.or_(voxel.and_(V() > 0, V() < 0.1), voxel.not_(V() > -0.1)), "v > 0 AND v < 0.1 OR NOT v > -0.1", None)
pointwise("mask_difference", lambda: derived.difference(V() > 0, V() > 0.1), "v > 0 AND NOT v > 0.1", None)
pointwise("mask_xor", lambda: derived.xor(F.col("a") > 0, F.col("b") > 0), "(a > 0) <> (b > 0)", None, "pr", pairs)
pointwise("mask_constants", lambda: voxel.tt() & ~voxel.ff() & voxel.bconstant(True), "true", None)
pointwise("voxel_border", lambda: voxel.border(GRID), "x IN (0, 7) OR y IN (0, 7)", None)
pointwise("voxel_coords", lambda: voxel.coordinate("x") + 10 * voxel.coordinate("y") + 100 * voxel.coordinate("z"), "x + 10 * y")
pointwise("voxel_div_z", lambda: voxel.div_z(V(), F.round(V(), 1), -1.0), "CASE WHEN round(v, 1) = 0 THEN -1 ELSE v / round(v, 1) END")
pointwise("voxel_if", lambda: voxel.if_(V() > 0, V(), -V()), "CASE WHEN v > 0 THEN v ELSE -v END")
pointwise("voxel_if_scalar", lambda: voxel.if_(F.lit(True), V(), -V()), "v")
pointwise("boolean_to_number", lambda: derived.boolean_to_number(V() > 0, 5), "CASE WHEN v > 0 THEN 5 ELSE 0 END")
pointwise("threshold_equal", lambda: voxel.threshold_equal(F.round(V(), 1), 0.1, 9.0, 2.0), "CASE WHEN round(v, 1) = 0.1 THEN 9 ELSE 2 END")
pointwise("binary_threshold", lambda: voxel.binary_threshold(V(), 0.0, 0.1, 255, 3), "CASE WHEN v BETWEEN 0 AND 0.1 THEN 255 ELSE 3 END", None)
pointwise("vector_intensity", lambda: voxel.intensity(voxel.rgb(V(), V() * 2, V() * 3)), "0.2126 * v + 0.7152 * (v * 2) + 0.0722 * (v * 3)")
pointwise("vector_components", lambda: voxel.component(voxel.rgb(V(), V() * 2, V() * 3), 0) + voxel.component(voxel.rgb(V(), V() * 2, V() * 3), 1) * 10 + voxel.component(voxel.rgb(V(), V() * 2, V() * 3), 2) * 100, "v + v * 20 + v * 300")
pointwise("vector_alpha", lambda: voxel.alpha(voxel.rgb(V(), V(), V())) + voxel.alpha(voxel.rgba(V(), V(), V(), V() * 2)), "255 + v * 2")
pointwise("overlay_color", lambda: derived.overlay_color(V() > 0, F.lit(200.0), V()), "CASE WHEN v > 0 THEN 200 ELSE v END")
pointwise("geom_circle", lambda: geometry.circle(V(), 3, 4, 2.5, 200), "CASE WHEN (x - 3) * (x - 3) + (y - 4) * (y - 4) <= 6.25 THEN 200 ELSE v END")
_TURN, _HALF = "(2 * pi() / 5)", "(pi() / 5)"
_FOLD = f"(((atan2(y - 3.3, x - 3.1) + pi()) % {_TURN}) - {_HALF})"
pointwise("geom_polygon", lambda: geometry.regular_polygon(V(), 3.1, 3.3, 3.2, 5, 150), f"CASE WHEN sqrt((x - 3.1) * (x - 3.1) + (y - 3.3) * (y - 3.3)) <= 3.2 * cos({_HALF}) / greatest(cos({_FOLD}), 1e-9) THEN 150 ELSE v END")


@query("SELECT 0::BIGINT AS image_id, x, y, 5.0::DOUBLE AS v FROM (SELECT unnest(range(6))::INT AS y), (SELECT unnest(range(4))::INT AS x)")
def geom_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.blank(spark, 6, 4, 5).select("image_id", "x", "y", "v")


@query(f"WITH {PX} SELECT image_id, x - 2 AS x, y - 1 AS y, v FROM px WHERE x BETWEEN 2 AND 4 AND y BETWEEN 1 AND 4")
def extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxel.extract(images(spark, sf_dir), (3.7, 4, 1), (2, 1, 0)).select("image_id", "x", "y", "v")


# aggregates of images
@query(f"WITH {PX} SELECT image_id, min(v) AS min, max(v) AS max FROM px GROUP BY image_id")
def img_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.extrema(images(spark, sf_dir))


@query(f"WITH {PX} SELECT image_id, round(avg(v) FILTER (WHERE v > 0), 6) AS avg FROM px GROUP BY image_id")
def avg_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.average(images(spark, sf_dir), V(), V() > 0).withColumn("avg", F.round("avg", 6))


@query(f"WITH {PX} SELECT image_id, round(coalesce(avg(v) FILTER (WHERE v > 0.3), 0), 6) AS avg FROM px GROUP BY image_id")
def avg0_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.average(images(spark, sf_dir), V(), V() > 0.3, empty=0).withColumn("avg", F.round("avg", 6))


@query(f"WITH {PX} SELECT image_id, (count(*) FILTER (WHERE v > 0.1))::DOUBLE AS volume FROM px GROUP BY image_id")
def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.volume(images(spark, sf_dir), V() > 0.1)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles of ``df`` rounded, so that the order of sums doesn't show."""
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query(f"""WITH {PX} SELECT image_id, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sigma,
    round(var_samp(v), 6) AS variance, round(sum(v), 6) AS sum, count(v) AS count FROM px GROUP BY image_id""")
def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.statistics(images(spark, sf_dir)))


@query(f"""WITH {PX} SELECT image_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max,
    round(median(v), 6) AS median, count(v) AS total, count(DISTINCT v) AS n_unique FROM px GROUP BY image_id""")
def array_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.array_stats(images(spark, sf_dir)))


@query(f"""WITH {PX} SELECT image_id, 0.1::DOUBLE AS value, count(*) FILTER (WHERE round(v, 1) = 0.1) AS count, count(*) AS total,
    round(100.0 * (count(*) FILTER (WHERE round(v, 1) = 0.1)) / count(*), 6) AS percentage FROM px GROUP BY image_id""")
def count_pixels_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.count_pixels(images(spark, sf_dir), F.round(V(), 1), 0.1))


@query(f"""WITH {PX}, c AS (SELECT image_id, (floor(v * 10))::BIGINT AS value, count(*) AS count FROM px GROUP BY ALL)
    SELECT image_id, value, count, round(100.0 * count / sum(count) OVER (PARTITION BY image_id), 6) AS percentage FROM c""")
def count_pixels_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.count_pixels(images(spark, sf_dir), F.floor(V() * 10)))


@query(f"WITH {PX} SELECT image_id, x, y, round(100 * v / max(v) OVER (PARTITION BY image_id), 6) AS out FROM px")
def norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(spark, sf_dir).select("image_id", "x", "y", F.round(derived.norm(V(), 100.0), 6).alias("out"))


@query(f"""WITH {PX}, e AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM px WINDOW w AS (PARTITION BY image_id))
    SELECT image_id, x, y, round((v - lo) * (255 / (hi - lo)), 6) AS out FROM e""")
def rescale_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = Window.partitionBy("image_id")
    low, high = F.min("v").over(of), F.max("v").over(of)
    return grouped(spark, sf_dir).select("image_id", "x", "y", F.round((V() - low) * F.try_divide(F.lit(255.0), high - low), 6).alias("out"))


def _rank_sql(ties: float) -> str:
    return f"""(rank() OVER (PARTITION BY image_id, v > 0 ORDER BY v) - 1 + {ties} * count(*) OVER (PARTITION BY image_id, v > 0, v)) / count(*) OVER (PARTITION BY image_id, v > 0)"""


def _percentiles(ties: float) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = grouped(spark, sf_dir)
        return rows.select("image_id", "x", "y", F.round(stats.percentiles(rows, V(), V() > 0, ties), 6).alias("out"))

    run.__name__ = f"percentiles_c{str(ties).replace('.', '').rstrip('0') or '0'}"
    sql = f"WITH {PX}, r AS (SELECT *, {_rank_sql(ties)} AS p FROM px) SELECT image_id, x, y, round(CASE WHEN v > 0 THEN p ELSE -1 END, 6) AS out FROM r"
    return query(sql)(run)


_percentiles(0.0)
_percentiles(0.5)
_percentiles(1.0)


# metrics of label images
LABELS = PAIR + ", lb AS (SELECT image_id, CASE WHEN a > 0.1 THEN 2 WHEN a > 0 THEN 1 ELSE 0 END AS a, CASE WHEN b > 0.1 THEN 2 WHEN b > 0 THEN 1 ELSE 0 END AS b FROM pr)"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = lambda c: F.when(F.col(c) > 0.1, 2).when(F.col(c) > 0, 1).otherwise(0)
    return pairs(spark, sf_dir).select("image_id", label("a").alias("a"), label("b").alias("b"))


@query(f"""WITH {LABELS} SELECT image_id, round(count(*) FILTER (WHERE a = b) / count(*), 6) AS accuracy, count(*) FILTER (WHERE a = b) AS correct,
    count(*) AS total, count(*) FILTER (WHERE a <> b) AS incorrect FROM lb GROUP BY image_id""")
def pixel_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.pixel_accuracy(labels(spark, sf_dir)))


@query(f"""WITH {LABELS}, k AS (SELECT unnest(range(3)) AS k), i AS (SELECT DISTINCT image_id FROM lb)
    SELECT i.image_id, t.k::INT AS truth, p.k::INT AS predicted, count(lb.a) AS n FROM i CROSS JOIN k t CROSS JOIN k p
    LEFT JOIN lb ON lb.image_id = i.image_id AND lb.b = t.k AND lb.a = p.k GROUP BY ALL""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(labels(spark, sf_dir), 3)


@query(f"""WITH {LABELS}, k AS (SELECT unnest(range(3)) AS k), c AS (SELECT image_id, k, count(*) FILTER (WHERE a = k AND b = k) AS h,
        count(*) FILTER (WHERE a = k) AS p, count(*) FILTER (WHERE b = k) AS t FROM lb, k GROUP BY ALL),
    s AS (SELECT image_id, k, CASE WHEN p = 0 THEN 0 ELSE h / p END AS pr, CASE WHEN t = 0 THEN 0 ELSE h / t END AS re FROM c)
    SELECT image_id, k::INT AS class, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1 FROM s""")
def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.class_scores(metrics.confusion_matrix(labels(spark, sf_dir), 3)))


@query(f"""WITH {LABELS} SELECT image_id, round(2.0 * (count(*) FILTER (WHERE a = 1 AND b = 1)) / nullif((count(*) FILTER (WHERE a = 1)) + (count(*) FILTER (WHERE b = 1)), 0), 6) AS dice
    FROM lb GROUP BY image_id""")
def dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rounded(metrics.overlap(labels(spark, sf_dir), 1)).select("image_id", "dice")
    return found.select("image_id", F.when(~F.isnan("dice"), F.col("dice")).alias("dice"))


@query(f"""WITH {LABELS} SELECT image_id, round(coalesce(count(*) FILTER (WHERE a = 2 AND b = 2) / nullif(count(*) FILTER (WHERE a = 2 OR b = 2), 0), 0), 6) AS jaccard
    FROM lb GROUP BY image_id""")
def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.overlap(labels(spark, sf_dir), 2)).select("image_id", "jaccard")


@query("""SELECT 1 AS all, round(count(*) FILTER (WHERE quality = toxic) / count(*), 6) AS accuracy, count(*) FILTER (WHERE quality = toxic) AS correct,
    count(*) AS total, count(*) FILTER (WHERE quality <> toxic) AS incorrect FROM labels""")
def label_map_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.lit(1).alias("all"), F.col("quality").alias("a"), F.col("toxic").alias("b"))
    return rounded(metrics.pixel_accuracy(rows, "all"))


@query(f"""WITH {PAIR} SELECT image_id, count(*) FILTER (WHERE a = b) AS equal, count(*) FILTER (WHERE a <> b) AS different,
    round(100.0 * (count(*) FILTER (WHERE a = b)) / count(*), 6) AS percent_equal, round(avg(b - a), 6) AS mean_diff, round(avg(abs(b - a)), 6) AS mae,
    round(max(abs(b - a)), 6) AS max_abs_diff, round(min(b - a), 6) AS min_diff, round(max(b - a), 6) AS max_diff FROM pr GROUP BY image_id""")
def compare_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.compare_arrays(pairs(spark, sf_dir)))


# neighbourhoods; m is the mask, in SQL as a table of its voxels
def _near_sql(of: str) -> str:
    return f"EXISTS (SELECT 1 FROM px n WHERE n.image_id = p.image_id AND abs(n.x - p.x) <= 1 AND abs(n.y - p.y) <= 1 AND {of})"


def spatially(name: str, sql: str, make: Callable[[DataFrame], DataFrame], kind: str = "bool") -> None:
    """Register a query that adds a column ``out`` to the images."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = make(grouped(spark, sf_dir))
        return rows.select("image_id", "x", "y", F.round("out", 6).alias("out") if kind == "double" else F.col("out"))

    run.__name__ = name
    query(sql)(run)


def M() -> Column:  # noqa: N802
    return V() > 0.05


spatially("near", f"WITH {PX} SELECT image_id, x, y, {_near_sql('n.v > 0.05')} AS out FROM px p", lambda d: spatial.near(d, M(), GRID, "out"))
spatially("interior", f"WITH {PX} SELECT image_id, x, y, NOT {_near_sql('NOT n.v > 0.05')} AS out FROM px p", lambda d: spatial.interior(d, M(), GRID, "out"))
spatially("ext_boundary", f"WITH {PX} SELECT image_id, x, y, NOT v > 0.05 AND {_near_sql('n.v > 0.05')} AS out FROM px p", lambda d: derived.external_boundary(d, M(), GRID, "out"))


def _components(mask: str, name: str = "c") -> str:
    """Common tables: components of a mask, ``name`` with ``image_id, x, y, root``."""
    return f"""{name}_m AS (SELECT image_id, x, y, y * 8 + x AS i FROM px WHERE {mask}),
    {name}_e AS (SELECT a.image_id, a.i AS s, b.i AS d FROM {name}_m a JOIN {name}_m b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
    {name}_r AS (SELECT image_id, i AS s, i AS d FROM {name}_m UNION SELECT r.image_id, r.s, e.d FROM {name}_r r JOIN {name}_e e ON r.image_id = e.image_id AND r.d = e.s),
    {name} AS (SELECT image_id, (s % 8)::INT AS x, (s // 8)::INT AS y, min(d) AS root FROM {name}_r GROUP BY ALL)"""


def _touched(sql: str) -> str:
    """Components ``c`` of which a voxel ``p`` fulfils ``sql``."""
    return f"t AS (SELECT DISTINCT c.image_id, c.root FROM c JOIN px p USING (image_id, x, y) WHERE {sql}), h AS (SELECT c.image_id, c.x, c.y FROM c JOIN t USING (image_id, root))"


_IN_H = "EXISTS (SELECT 1 FROM h WHERE h.image_id = p.image_id AND h.x = p.x AND h.y = p.y)"
_NEAR_H = "EXISTS (SELECT 1 FROM h WHERE h.image_id = p.image_id AND abs(h.x - p.x) <= 1 AND abs(h.y - p.y) <= 1)"
def C() -> Column:  # noqa: N802
    return V() > 0.08


spatially(
    "lcc",
    f"""WITH RECURSIVE {PX}, {_components('v > 0.08')}, n AS (SELECT *, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS label FROM c)
    SELECT px.image_id, px.x, px.y, coalesce(label, 0) AS out FROM px LEFT JOIN n USING (image_id, x, y)""",
    lambda d: spatial.lcc(d, C(), GRID, "out"),
    "bigint",
)
spatially("through", f"WITH RECURSIVE {PX}, {_components('v > 0.08')}, {_touched('p.v > 0.2')} SELECT image_id, x, y, {_IN_H} AS out FROM px p", lambda d: spatial.through(d, V() > 0.2, C(), GRID, "out"))
spatially(
    "maxvol",
    f"""WITH RECURSIVE {PX}, {_components('v > 0.08')}, s AS (SELECT image_id, root, rank() OVER (PARTITION BY image_id ORDER BY count(*) DESC) AS k FROM c GROUP BY image_id, root),
    h AS (SELECT c.image_id, c.x, c.y FROM c JOIN s USING (image_id, root) WHERE k = 1) SELECT image_id, x, y, {_IN_H} AS out FROM px p""",
    lambda d: spatial.maxvol(d, C(), GRID, "out"),
)
_TOUCH = _near_sql("n.v < -0.2")
spatially("touch", f"WITH RECURSIVE {PX}, {_components('v > 0.08')}, {_touched(_TOUCH)} SELECT image_id, x, y, {_IN_H} AS out FROM px p", lambda d: derived.touch(d, C(), V() < -0.2, GRID, "out"))
spatially("grow", f"WITH RECURSIVE {PX}, {_components('v > 0.08')}, {_touched(_TOUCH)} SELECT image_id, x, y, v < -0.2 OR {_IN_H} AS out FROM px p", lambda d: derived.grow(d, V() < -0.2, C(), GRID, "out"))
spatially(
    "may_reach",
    f"WITH RECURSIVE {PX}, {_components('v > 0.08')}, {_touched(_TOUCH)} SELECT image_id, x, y, {_TOUCH} OR {_NEAR_H} AS out FROM px p",
    lambda d: derived.may_reach(d, V() < -0.2, C(), GRID, "out"),
)
_OUT = _near_sql("NOT (n.v > 0.05 OR n.v < -0.05)")
spatially(
    "surrounded",
    f"WITH RECURSIVE {PX}, {_components('NOT v < -0.05')}, {_touched(_OUT)} SELECT image_id, x, y, v > 0.05 AND NOT ({_OUT} OR {_NEAR_H}) AS out FROM px p",
    lambda d: derived.surrounded(d, V() > 0.05, V() < -0.05, GRID, "out"),
)


@query(f"""WITH RECURSIVE {PX}, {_components('v > 0.08')}, n AS (SELECT *, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS label FROM c),
    f AS (SELECT p.image_id, min(coalesce(label, 0)) AS lo, max(coalesce(label, 0)) AS hi FROM px p LEFT JOIN n USING (image_id, x, y) WHERE p.v > 0.25 GROUP BY p.image_id)
    SELECT image_id, lo AS min_cc, hi AS max_cc, coalesce(lo = hi AND lo > 0, true) AS collected FROM (SELECT DISTINCT image_id FROM px) LEFT JOIN f USING (image_id)""")
def collect_cc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.collect_cc(grouped(spark, sf_dir), V() > 0.25, C(), GRID)


# distances: to the outline, whose voxels have a neighbour outside of the mask
def _dt(mask: str, source: str = "px", name: str = "d") -> str:
    """Common tables: the signed distance ``name`` to a mask over the voxels of ``source``."""
    return f"""{name}_m AS (SELECT image_id, x, y, {mask} AS m FROM {source}),
    {name}_o AS (SELECT image_id, x, y FROM {name}_m p WHERE m AND EXISTS (SELECT 1 FROM {name}_m n WHERE n.image_id = p.image_id AND abs(n.x - p.x) <= 1 AND abs(n.y - p.y) <= 1 AND NOT n.m)),
    {name} AS (SELECT p.image_id, p.x, p.y, any_value(m) AS m, CASE WHEN any_value(m) THEN -1 ELSE 1 END * sqrt(coalesce(min((o.x - p.x) * (o.x - p.x) + (o.y - p.y) * (o.y - p.y))::DOUBLE, 'Infinity'::DOUBLE)) + 0.0 AS d
        FROM {name}_m p LEFT JOIN {name}_o o ON o.image_id = p.image_id GROUP BY ALL)"""


def D() -> Column:  # noqa: N802
    return V() > 0.1


spatially("dt", f"WITH {PX}, {_dt('v > 0.1')} SELECT image_id, x, y, round(d, 6) AS out FROM d", lambda d: spatial.dt(d, D(), GRID, "out"), "double")
spatially("pdt", f"WITH {PX}, {_dt('v > 0.1')} SELECT image_id, x, y, round(greatest(d, 0), 6) AS out FROM d", lambda d: derived.pdt(d, D(), GRID, "out"), "double")
spatially("dist_leq", f"WITH {PX}, {_dt('v > 0.1')} SELECT image_id, x, y, d <= 1.5 AS out FROM d", lambda d: derived.dist_leq(d, 1.5, D(), GRID, "out"))
spatially("dist_geq", f"WITH {PX}, {_dt('v > 0.1')} SELECT image_id, x, y, greatest(d, 0) >= 1.5 AS out FROM d", lambda d: derived.dist_geq(d, 1.5, D(), GRID, "out"))
spatially("erode", f"WITH {PX}, {_dt('NOT v > -0.1')} SELECT image_id, x, y, d > 1 AS out FROM d", lambda d: derived.erode(d, V() > -0.1, 1.0, GRID, "out"))
spatially("dilate", f"WITH {PX}, {_dt('v > 0.2')} SELECT image_id, x, y, d <= 1.5 AS out FROM d", lambda d: derived.dilate(d, V() > 0.2, 1.5, GRID, "out"))
spatially("smoothen", f"WITH {PX}, {_dt('NOT v > -0.1')}, k AS (SELECT image_id, x, y, greatest(d, 0) >= 1 AS keep FROM d), {_dt('keep', 'k', 'f')} SELECT image_id, x, y, d <= 1 AS out FROM f", lambda d: derived.smoothen(d, V() > -0.1, 1.0, GRID, "out"))
spatially("open", f"WITH {PX}, {_dt('NOT v > -0.1')}, k AS (SELECT image_id, x, y, d > 1 AS keep FROM d), {_dt('keep', 'k', 'f')} SELECT image_id, x, y, d <= 1 AS out FROM f", lambda d: derived.imopen(d, V() > -0.1, 1.0, GRID, "out"))
spatially("close", f"WITH {PX}, {_dt('v > 0.1')}, k AS (SELECT image_id, x, y, d <= 1 AS keep FROM d), {_dt('NOT keep', 'k', 'f')} SELECT image_id, x, y, d > 1 AS out FROM f", lambda d: derived.imclose(d, D(), 1.0, GRID, "out"))
spatially(
    "gradient",
    f"""WITH {PX}, g AS (SELECT image_id, x, y, (coalesce(lead(v) OVER r, v) - coalesce(lag(v) OVER r, v)) / 2 AS gx, (coalesce(lead(v) OVER c, v) - coalesce(lag(v) OVER c, v)) / 2 AS gy
    FROM px WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)) SELECT image_id, x, y, round(sqrt(gx * gx + gy * gy), 6) AS out FROM g""",
    lambda d: spatial.gradient(d, V(), GRID, "out"),
    "double",
)


def _flow_sql(rounds: int, step: float) -> str:
    """A CTE for each round of a flat image: neighbours along rows and columns, then diagonal ones, then the step."""
    beside = lambda f, v, w: f"coalesce({f}({v}) OVER {w}, {v})"
    lines = "WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)"
    parts, at = [PX], "px"
    for k in range(rounds):
        parts += [
            f"a{k} AS (SELECT image_id, x, y, v, {beside('lead', 'v', 'r')} AS e, {beside('lag', 'v', 'r')} AS w, {beside('lead', 'v', 'c')} AS s, {beside('lag', 'v', 'c')} AS n FROM {at} {lines})",
            f"b{k} AS (SELECT *, {beside('lead', 's', 'r')} - {beside('lag', 's', 'r')} - {beside('lead', 'n', 'r')} + {beside('lag', 'n', 'r')} AS d, (e - w) / 2 AS gx, (s - n) / 2 AS gy FROM a{k} {lines})",
            f"f{k} AS (SELECT image_id, x, y, v + {step} * CASE WHEN gx * gx + gy * gy > 1e-9 THEN ((s - 2 * v + n) * gx * gx + (e - 2 * v + w) * gy * gy - gx * gy * d / 2) / (gx * gx + gy * gy) ELSE 0 END AS v FROM b{k})",
        ]
        at = f"f{k}"
    return f"WITH {', '.join(parts)} SELECT image_id, x, y, round(v, 6) AS out FROM {at}"


spatially("dt_by_lines", f"WITH {PX}, {_dt('v > 0.1')} SELECT image_id, x, y, round(d, 6) AS out FROM d", lambda d: spatial.dt_by_lines(d, D(), GRID, "out"), "double")
spatially("curvature_flow_by_windows", _flow_sql(3, 0.05), lambda d: spatial.curvature_flow_by_windows(d, V(), GRID, 0.05, 3, "out"), "double")


@query(_flow_sql(3, 0.05))
def curvature_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.curvature_flow(grouped(spark, sf_dir), V(), GRID, 0.05, 3, "out").select("image_id", "x", "y", F.round("out", 6).alias("out"))


@query(f"""WITH {PX}, f AS (SELECT image_id, v, min(v) OVER w AS lo, max(v) OVER w AS hi FROM px WHERE v > -0.2 WINDOW w AS (PARTITION BY image_id)),
    b AS (SELECT image_id, lo, hi, CASE WHEN hi = lo THEN 0 ELSE least(15, floor((v - lo) / ((hi - lo) / 16))::INT) END AS bin FROM f),
    h AS (SELECT image_id, lo, hi, k, count(*) FILTER (WHERE bin = k) AS n FROM b, (SELECT unnest(range(16)) AS k) GROUP BY ALL),
    s AS (SELECT image_id, lo, hi, k, sum(n) OVER c AS n0, sum(n * (k + 0.5)) OVER c AS s0, sum(n) OVER a AS n, sum(n * (k + 0.5)) OVER a AS s FROM h
        WINDOW c AS (PARTITION BY image_id ORDER BY k ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY image_id)),
    g AS (SELECT *, round(coalesce(n0 * (n - n0) * pow(s0::DOUBLE / nullif(n0, 0) - (s - s0)::DOUBLE / nullif(n - n0, 0), 2), 0), 9) AS g FROM s),
    t AS (SELECT image_id, lo + (k + 1) * ((hi - lo) / 16) AS threshold, row_number() OVER (PARTITION BY image_id ORDER BY g DESC, k) AS place FROM g)
    SELECT image_id, round(threshold, 6) AS threshold FROM t WHERE place = 1""")
def otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.otsu(images(spark, sf_dir), "v", V() > -0.2, 16))


@query(f"""WITH {PX}, l AS (SELECT image_id, x, y, v, min(v) OVER w AS lo, max(v) OVER w AS hi FROM px WINDOW w AS (PARTITION BY image_id)),
    b AS (SELECT image_id, x, y, v, CASE WHEN hi > lo AND v >= lo AND v < hi THEN least(3, floor((v - lo) / ((hi - lo) / 4))::INT) END AS bin FROM l),
    k AS (SELECT unnest(range(4)) AS k),
    g AS (SELECT image_id, k, count(*) FILTER (WHERE bin = k AND v > 0) AS g FROM b, k GROUP BY ALL),
    h AS (SELECT p.image_id, p.x, p.y, k, count(*) FILTER (WHERE n.bin = k) AS h FROM b p JOIN b n ON n.image_id = p.image_id AND abs(n.x - p.x) <= 1 AND abs(n.y - p.y) <= 1, k GROUP BY ALL),
    s AS (SELECT h.image_id, x, y, 4 * sum(h * h) - sum(h) * sum(h) AS hh, 4 * sum(g * g) - sum(g) * sum(g) AS gg, 4 * sum(h * g) - sum(h) * sum(g) AS hg FROM h JOIN g USING (image_id, k) GROUP BY ALL)
    SELECT image_id, x, y, round(CASE WHEN hh = 0 AND gg = 0 THEN 1 WHEN hh = 0 OR gg = 0 THEN 0 ELSE hg::DOUBLE / (sqrt(hh::DOUBLE) * sqrt(gg::DOUBLE)) END, 6) AS out FROM s""")
def cross_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = Window.partitionBy("image_id")
    rows = grouped(spark, sf_dir).withColumns({"lo": F.min("v").over(of), "hi": F.max("v").over(of)})
    return stats.cross_correlation(rows, GRID, 1.0, V(), V(), V() > 0, F.col("lo"), F.col("hi"), 4, "out").select("image_id", "x", "y", F.round("out", 6).alias("out"))


@query(f"""WITH {PX} SELECT image_id, count(*) FILTER (WHERE v > 0.1 AND NOT v > 0) = 0 AS included, count(*) FILTER (WHERE (v > 0.1) <> (v > 0)) = 0 AS equal,
    count(*) FILTER (WHERE (v > 0.1) <> (v > 0)) > 0 AS differ, count(*) FILTER (WHERE v > 0.4) = 0 AS empty FROM px GROUP BY image_id""")
def mask_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouped(spark, sf_dir)
    parts = [derived.leq_b(rows, V() > 0.1, V() > 0), derived.eq_b(rows, V() > 0.1, V() > 0), derived.neq_b(rows, V() > 0.1, V() > 0), derived.empty_b(rows, V() > 0.4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "image_id")
    return out


@query(f"""WITH RECURSIVE {PX}, r AS (SELECT image_id, x, y, {_rank_sql(0.0)} AS p FROM px WHERE v > 0),
    q AS (SELECT px.image_id, px.x, px.y, coalesce(p, -1) AS v FROM px LEFT JOIN r USING (image_id, x, y)),
    {_components('v >= 0.7').replace('FROM px', 'FROM q')},
    t AS (SELECT DISTINCT c.image_id, c.root FROM c WHERE EXISTS (SELECT 1 FROM q n WHERE n.image_id = c.image_id AND abs(n.x - c.x) <= 1 AND abs(n.y - c.y) <= 1 AND n.v >= 0.93)),
    h AS (SELECT c.image_id, c.x, c.y FROM c JOIN t USING (image_id, root))
    SELECT image_id, (count(*) FILTER (WHERE v >= 0.93))::DOUBLE AS vol_seed, (count(*) FILTER (WHERE v >= 0.93 OR {_IN_H}))::DOUBLE AS vol_grown FROM q p GROUP BY image_id""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank inside a mask, take seeds and a looser mask, grow the one in the other, and measure, for each image."""
    rows = grouped(spark, sf_dir)
    rows = rows.withColumn("p", stats.percentiles(rows, V(), V() > 0, 0.0))
    rows = derived.grow(rows, F.col("p") >= 0.93, F.col("p") >= 0.7, GRID, "grown")
    return rows.groupBy("image_id").agg(F.count_if(F.col("p") >= 0.93).cast("double").alias("vol_seed"), F.count_if("grown").cast("double").alias("vol_grown"))


# sequences: the items of a vector, the lines of an order by number, the turns of a conversation
def E() -> Column:  # noqa: N802
    return F.transform("embedding", lambda x: x.cast("double"))


SEQ = "s AS (SELECT vec_id AS seq_id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq_id"), E().alias("a"))


def arrays(name: str, value: Callable[[Column], Column], sql: str, digits: int | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = value(F.col("a"))
        return vectors(spark, sf_dir).select("seq_id", (F.round(out, digits) if digits is not None else out).alias("out"))

    run.__name__ = name
    query(f"WITH {SEQ} SELECT seq_id, {f'round(({sql})::DOUBLE, {digits})' if digits is not None else sql} AS out FROM s")(run)


def joined(a: Column) -> Column:
    """An array as text, in millionths."""
    return F.array_join(F.transform(a, lambda x: F.round(x * 1000000).cast("bigint")), " ")


def _joined(sql: str) -> str:
    return f"array_to_string(list_transform({sql}, lambda x: round(x * 1000000)::BIGINT), ' ')"


arrays("seq_map", lambda a: joined(sequence.mapped(a, lambda x: x * 2 + 1)), _joined("list_transform(a, lambda x: x * 2 + 1)"))
arrays("seq_filter", lambda a: F.size(sequence.filtered(a, lambda x: x > 0.1)).cast("bigint"), "len(list_filter(a, lambda x: x > 0.1))")
arrays("seq_index", lambda a: sequence.item(a, 3), "a[4]", 6)
arrays("seq_slice", lambda a: joined(sequence.sliced(a, 2, 7)), _joined("a[3:7]"))
arrays("seq_slice_open", lambda a: F.size(sequence.sliced(a, 60, None)).cast("bigint") * 100 + F.size(sequence.sliced(a, 5, 2)).cast("bigint"), "len(a[61:]) * 100")
arrays("subsequence", lambda a: joined(sequence.subsequence(a, 1, 4)), _joined("a[2:4]"))
arrays("seq_broadcast_scalar", lambda a: joined(sequence.mapped(a, lambda x: x + 10)), _joined("list_transform(a, lambda x: x + 10)"))
arrays("seq_zip", lambda a: joined(sequence.zipped(a, F.reverse(a), lambda x, y: x - y)), _joined("list_transform(a, lambda x, i: x - list_reverse(a)[i])"))
arrays("fold_sum", lambda a: sequence.fold("+", a), "list_sum(a)", 6)
arrays("fold_prod", lambda a: sequence.fold("*", sequence.mapped(a, lambda x: x + 1), F.lit(1.0)), "list_product(list_transform(a, lambda x: x + 1))", 6)
arrays("fold_min", lambda a: sequence.fold("min", a), "list_min(a)", 6)
arrays("fold_max", lambda a: sequence.fold("max", a), "list_max(a)", 6)
arrays("fold_and", lambda a: sequence.fold("&&", sequence.mapped(a, lambda x: x > -0.35)), "list_bool_and(list_transform(a, lambda x: x > -0.35))")
arrays("fold_or", lambda a: sequence.fold("||", sequence.mapped(a, lambda x: x > 0.35)), "list_bool_or(list_transform(a, lambda x: x > 0.35))")
arrays("fold_sub", lambda a: sequence.fold("-", a, F.lit(10.0)), "10 - list_sum(a)", 6)
arrays("fold_div", lambda a: sequence.fold("/", sequence.mapped(a, lambda x: x + 1), F.lit(100.0)), "100 / list_product(list_transform(a, lambda x: x + 1))", 6)
arrays("argmax", lambda a: sequence.argmax(a), "list_position(a, list_max(a)) - 1")
arrays("vector_uint32", lambda a: F.array_join(sequence.vector(sequence.mapped(a, lambda x: F.abs(x) * 100), "uint32"), " "), "array_to_string(list_transform(a, lambda x: trunc(abs(x) * 100)::BIGINT), ' ')")
arrays("vector_double", lambda a: joined(sequence.vector(a, "double")), _joined("a"))


@query("SELECT i AS idx, i + 3 AS value FROM (SELECT unnest(range(1000)) AS i)")
def seq_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.table_range(spark, 3, 1003)


@query("SELECT l_orderkey, max(a) AS argmax FROM (SELECT l_orderkey, first_value(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS a FROM lineitem) GROUP BY l_orderkey")
def rows_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("idx"), F.col("l_quantity").alias("value"))
    return sequence.table_argmax(rows, ["l_orderkey"])


@query("""SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total, min(l_quantity) AS least, max(l_quantity) AS most, bool_and(l_quantity > 5) AS all_large,
    bool_or(l_returnflag = 'R') AS returned FROM lineitem GROUP BY l_orderkey""")
def rows_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("total"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.bool_and(F.col("l_quantity") > 5).alias("all_large"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"))


@query("""SELECT idx, o_orderkey AS value FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders WHERE o_totalprice > 100000) WHERE idx BETWEEN 100 AND 299""")
def rows_filter_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter closes the gaps that it leaves before a slice counts places."""
    rows = table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 100000).select(F.col("o_orderkey").alias("idx"), F.col("o_orderkey").alias("value"))
    kept = sequence.renumbered(rows).where(F.col("idx").between(100, 299))
    return kept.select("idx", "value")


@query("SELECT conv_id, arg_min(text, turn) AS first_text, count(*) FILTER (WHERE role = 'user') AS asked, max(turn) AS last FROM conversations GROUP BY conv_id")
def rows_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_text"), F.count_if(F.col("role") == "user").alias("asked"), F.max("turn").alias("last"))


# scalars and strings
@query("""SELECT p_partkey, round((p_retailprice + 10) * 2 - p_size / 4.0, 6) AS arith, p_size = 10 AS eq, p_size <> 10 AS neq, p_size <= 10 AS leq, p_size < 10 AS lt,
    p_size >= 10 AS geq, p_size > 10 AS gt, p_size > 10 AND p_retailprice > 1000 AS both, p_size > 10 OR p_retailprice > 1000 AS either, NOT p_size > 10 AS neither, p_size BETWEEN 5 AND 20 AS inside FROM part""")
def scalar_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round((price + 10) * 2 - size / 4.0, 6).alias("arith"), (size == 10).alias("eq"), (size != 10).alias("neq"), (size <= 10).alias("leq"), (size < 10).alias("lt"),
        (size >= 10).alias("geq"), (size > 10).alias("gt"), ((size > 10) & (price > 1000)).alias("both"), ((size > 10) | (price > 1000)).alias("either"), (~(size > 10)).alias("neither"), size.between(5, 20).alias("inside"),
    )


@query("SELECT p_partkey, p_name || '/' || p_size || '/' || CASE WHEN p_size > 10 THEN 'True' ELSE 'False' END || '/' || printf('%.1f', p_size::DOUBLE) AS out FROM part")
def str_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    slash = (F.lit("/"), "string")
    size = F.col("p_size")
    out = strings.concat((F.col("p_name"), "string"), slash, (size, "int"), slash, (size > 10, "boolean"), slash, (size.cast("double"), "double"))
    return table(spark, sf_dir, "part").select("p_partkey", out.alias("out"))


@query("SELECT p_partkey, printf('%04d', p_size) || ' ' || printf('%.2f', p_retailprice) || ' ' || printf('%.1f', p_size * 100.0) || '% of ' || p_brand AS out FROM part")
def str_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = strings.format_string("{:04d} {:.2f} {:.1%} of {}", F.col("p_size"), F.col("p_retailprice"), F.col("p_size"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", out.alias("out"))


@query("SELECT i, f FROM (WITH RECURSIVE r(i, a, f) AS (SELECT 0, 0::BIGINT, 1::BIGINT UNION ALL SELECT i + 1, f, a + f FROM r WHERE i < 40) SELECT i::BIGINT AS i, a AS f FROM r)")
def fibonacci(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(1).cast("bigint").alias("b"))
    step = lambda s, _: F.struct(s["b"].alias("a"), (s["a"] + s["b"]).alias("b"))
    return spark.range(41).select(F.col("id").alias("i"), F.aggregate(sequence.array_range(F.lit(0).cast("bigint"), F.col("id")), start, step)["a"].alias("f"))




# programs of the surface language, and pages of their sequences
def program(spark: SparkSession, sf_dir: str, text: str):
    """An engine for a program in which ``img`` is the set of all images."""
    from rasterloom.plans import primitives
    from rasterloom.plans.engine import Engine

    return Engine(spark, text, bindings={"img": primitives.image_of(grouped(spark, sf_dir), GRID)})


FLAGSHIP = """
import "vox1"
p = percentiles(img, img > 0, 0)
seeds = 0.93 .<= p
grown = grow(seeds, geq_sv(0.7, p))
print "vol_seed" volume(seeds)
print "vol_grown" volume(grown)
"""


@query(SQL["flagship"])
def lang_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    (_, seed), (_, grown) = program(spark, sf_dir, FLAGSHIP).run()
    rows = grown.frame.df.select("image_id", seed.value.alias("s"), grown.value.alias("g"))
    return rows.groupBy("image_id").agg(F.first("s").alias("vol_seed"), F.first("g").alias("vol_grown"))


@query(f"WITH {PX} SELECT image_id, x, y, NOT ((v * 2 + 1) * 3 > 3.2) AS out FROM px")
def lang_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One precedence, from the left; ``!`` negates voxels."""
    ((_, out),) = program(spark, sf_dir, 'print "m" !(img * 2 + 1 * 3 > 3.2)').run()
    return out.result().select("image_id", "x", "y", F.col("v").alias("out"))


def language(name: str, text: str, sql: str, digits: int | None = 6) -> None:
    """Register a query of the image that the expression ``text`` makes of all images."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ((_, out),) = program(spark, sf_dir, f'import "simpleitk"\nimport "masks"\nprint "m" {text}').run()
        value = F.col("value" if out.whole else "v")
        return out.result().select("image_id", *([] if out.whole else ["x", "y"]), (value if digits is None else F.round(value.cast("double"), digits)).alias("out"))

    run.__name__ = name
    query(sql)(run)


_EXTREMA = f"WITH {PX}, e AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi, avg(v) OVER w AS mean, stddev_samp(v) OVER w AS dev FROM px WINDOW w AS (PARTITION BY image_id))"
language("lang_cast", 'Cast(RescaleIntensity(img, 0, 255), GetPixelIDValueFromString("sitkUInt8"))', f"{_EXTREMA} SELECT image_id, x, y, floor(0 + (v - lo) * (255 / (hi - lo))) AS out FROM e")
language("lang_cast_wraps", 'Cast(img * 1000, GetPixelIDValueFromString("sitkInt8"))', f"WITH {PX} SELECT image_id, x, y, (((trunc(v * 1000)::BIGINT + 128) % 256 + 256) % 256 - 128)::DOUBLE AS out FROM px")
language("lang_normalize", "Normalize(img)", f"{_EXTREMA} SELECT image_id, x, y, round((v - mean) / dev, 6) AS out FROM e")
language("lang_filter_masks", "Mask(img, Or(And(Greater(img, 0), Less(img, 0.1)), Equal(BinaryThreshold(img, 0.2, 0.3, 1, 0), 1)), 7)", f"WITH {PX} SELECT image_id, x, y, round(CASE WHEN v > 0 AND v < 0.1 OR v BETWEEN 0.2 AND 0.3 THEN v ELSE 7 END, 6) AS out FROM px")
language("lang_filter_arithmetic", "Sqrt(Add(Square(img), Abs(Multiply(img, Subtract(img, 1)))))", f"WITH {PX} SELECT image_id, x, y, round(sqrt(v * v + abs(v * (v - 1))), 6) AS out FROM px")
language("lang_filter_windowing", "InvertIntensity(IntensityWindowing(ShiftScale(img, 1, 2), 1, 2, 0, 10))", f"WITH {PX} SELECT image_id, x, y, round(255 - (greatest(1, least(2, (v + 1) * 2)) - 1) * 10, 6) AS out FROM px")
language("lang_compose", "VectorIndexSelectionCast(Compose(img, img * 2, img * 3), 2)", f"WITH {PX} SELECT image_id, x, y, round(v * 3, 6) AS out FROM px")
language("lang_crop", "Crop(img, [1, 2, 0], [2, 1, 0])", f"WITH {PX} SELECT image_id, x - 1 AS x, y - 2 AS y, round(v, 6) AS out FROM px WHERE x BETWEEN 1 AND 5 AND y BETWEEN 2 AND 6")
language("lang_pad", "ConstantPad(img, [1, 0, 0], [0, 2, 0], 5)", f"""WITH {PX}, g AS (SELECT vec_id AS image_id, gx::INT AS x, gy::INT AS y FROM embeddings, (SELECT unnest(range(9)) AS gx), (SELECT unnest(range(10)) AS gy))
    SELECT g.image_id, g.x, g.y, round(coalesce(v, 5), 6) AS out FROM g LEFT JOIN px ON px.image_id = g.image_id AND px.x + 1 = g.x AND px.y = g.y""")
language("lang_signed_distance", "SignedMaurerDistanceMap(Greater(img, 0.1))", f"WITH {PX}, {_dt('v > 0.1')} SELECT image_id, x, y, round(d * abs(d), 6) AS out FROM d")
language("lang_binary_dilate", "BinaryDilate(Greater(img, 0.2), 1)", f"WITH {PX}, b AS (SELECT image_id, x, y, v > 0.2 AS m FROM px) SELECT p.image_id, p.x, p.y, (CASE WHEN EXISTS (SELECT 1 FROM b n WHERE n.m AND n.image_id = p.image_id AND abs(n.x - p.x) <= 1 AND abs(n.y - p.y) <= 1) THEN 1 ELSE 0 END)::DOUBLE AS out FROM b p")
language("lang_library", "rim(band(0, 0.2, img))", f"WITH {PX}, b AS (SELECT image_id, x, y, v BETWEEN 0 AND 0.2 AS m FROM px), n AS (SELECT p.image_id, p.x, p.y, p.m, bool_and(n.m) AS inner_m FROM b p JOIN b n ON n.image_id = p.image_id AND abs(n.x - p.x) <= 1 AND abs(n.y - p.y) <= 1 GROUP BY ALL) SELECT image_id, x, y, m AND NOT inner_m AS out FROM n", None)
language("lang_empty", "emptyB(img > 0.3) || nemptyB(img < (0 - 0.35))", f"WITH {PX} SELECT image_id, NOT bool_or(v > 0.3) OR bool_or(v < -0.35) AS out FROM px GROUP BY image_id", None)
language("lang_fold_images", "fold max [img, img * 2, 0 - img]", f"WITH {PX} SELECT image_id, x, y, round(greatest(v, v * 2, -v), 6) AS out FROM px")
language("lang_thresholds", "(0 .<= img) & (img .< 0.1)", f"WITH {PX} SELECT image_id, x, y, v >= 0 AND v < 0.1 AS out FROM px", None)
language("lang_let", "(let t = avg(img, img > 0) in img > t)", f"WITH {PX}, a AS (SELECT image_id, avg(v) FILTER (WHERE v > 0) AS t FROM px GROUP BY image_id) SELECT image_id, x, y, coalesce(v > t, false) AS out FROM px JOIN a USING (image_id)", None)


@query(f"WITH {PX} SELECT image_id % 3 AS file, x, y, round(v, 6) AS out FROM px WHERE image_id < 3")
def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three images written as files of three formats, and read back by the program."""
    import tempfile
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp()
    folder, held = f"{folder}/images-{uuid.uuid4().hex}", []
    for k, suffix in enumerate((".nrrd", ".nii.gz", ".vtk")):
        one = images(spark, sf_dir).where(F.col("image_id") == k)
        path = sinks.write_image(one, f"{folder}/{k}{suffix}", GRID)[0]
        ((_, out),) = program(spark, sf_dir, f'print "x" ReadImage("{path}")').run()
        held.append(out.result().select(F.lit(k).cast("bigint").alias("file"), "x", "y", F.round("v", 6).alias("out")))
    return held[0].union(held[1]).union(held[2])


def _values(spark: SparkSession, values: list) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "idx bigint, value double")


@query("SELECT unnest([0, 1, 2])::BIGINT AS idx, unnest([9, 10, 285])::DOUBLE AS value")
def lang_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """
    sq(a) = a * a
    print "precedence" 1+2*3
    print "fold" fold + 0 range(0,5)
    print "squares" fold + 0 (for i in range(0,10) do sq(i))
    """
    return _values(spark, [v for _, v in program(spark, sf_dir, text).run()])


@query("SELECT i - 500 AS idx, (i + 1000)::BIGINT * 2 AS value FROM (SELECT unnest(range(500, 600)) AS i)")
def lang_long_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long range is a table: the map is a projection, and the slice a predicate of its source."""
    ((_, out),) = program(spark, sf_dir, 'print "s" (for i in range(1000, 2000000) do (i * 2))[500:600]').run()
    return out.select("idx", F.col("value").cast("bigint").alias("value"))


@query("SELECT i AS idx, (i * i)::DOUBLE AS value FROM (SELECT unnest(range(20, 25)) AS i)")
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = program(spark, sf_dir, 'print "s" for i in range(0, 1000) do i * i')
    items, _ = engine.page(engine.plan.goals[0].id, 20, 5)
    return spark.createDataFrame([(20 + k, float(v)) for k, v in enumerate(items)], "idx bigint, value double")


@query("SELECT regexp_replace(c_name || ' ' || c_mktsegment, '[^A-Za-z0-9_-]+', '_', 'g') AS case_id, count(*) AS n FROM (SELECT 'Case#' || (c_custkey % 50) AS c_name, c_mktsegment FROM customer) GROUP BY 1 HAVING count(*) > 1")
def case_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterloom.operators import cases

    name = F.concat(F.lit("Case#"), (F.col("c_custkey") % 50).cast("string"), F.lit(" "), F.col("c_mktsegment"))
    return cases.duplicates(table(spark, sf_dir, "customer").select(name.alias("case_id")))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: event-time windows, here over the whole table."""
    from rasterloom.streaming import events

    return events.tumbling(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))
