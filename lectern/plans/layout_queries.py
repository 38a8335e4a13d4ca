"""Queries over page geometry. Pages are orders, boxes their lines; coordinates are maps of the lines' numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import layout as L
from ..sources.tables import balanced, document_lines, table
from . import sql as S
from .text_queries import _BULLET, _TERMINAL, _heading, _layout_go

QUERIES: dict = {}
SQL: dict = {}
C = F.col


def query(statement: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if statement:
            SQL[f.__name__] = statement
        return f

    return add


W, H = 600.0, 800.0
# One box a line item: place and size from part, supplier and quantity; ties are broken by the line number.
_BOX = """l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS box,
    CASE WHEN l_suppkey % 9 = 0 THEN l_linenumber::VARCHAR ELSE 'item ' || l_partkey END AS text,
    (l_partkey % 12 * 40 + l_suppkey % 3)::DOUBLE AS x0, (l_partkey % 12 * 40 + 30 + l_suppkey % 7 * 60)::DOUBLE AS x1,
    (l_quantity * 15)::DOUBLE AS top, (l_quantity * 15 + 10 + l_suppkey % 4)::DOUBLE AS bottom, (8 + l_quantity::INT % 5)::DOUBLE AS size"""
_B = f"b AS (SELECT {_BOX} FROM lineitem)"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem")
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    x = C("l_partkey") % 12 * 40
    return df.select(
        C("l_orderkey").alias("page"), number.alias("box"), F.when(C("l_suppkey") % 9 == 0, C("l_linenumber").cast("string")).otherwise(F.concat(F.lit("item "), C("l_partkey").cast("string"))).alias("text"),
        (x + C("l_suppkey") % 3).cast("double").alias("x0"), (x + 30 + C("l_suppkey") % 7 * 60).cast("double").alias("x1"), (C("l_quantity") * 15).cast("double").alias("top"),
        (C("l_quantity") * 15 + 10 + C("l_suppkey") % 4).cast("double").alias("bottom"), (8 + C("l_quantity").cast("int") % 5).cast("double").alias("size"),
    )


_ORDER = f"""{_B}, f AS (SELECT *, top > {H * 0.88} AND length(text) <= 8 AND NOT regexp_matches(text, '[A-Za-z\\x{{3400}}-\\x{{9fff}}]') AS footer FROM b),
    s AS (SELECT *, NOT footer AND x0 < {W * 0.45} AND x1 > {W * 0.55} AND x1 - x0 > {W * 0.18} AS spanning FROM f),
    g0 AS (SELECT *, coalesce(sum(spanning::INT) OVER (PARTITION BY page ORDER BY top RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS seg0,
                  row_number() OVER (PARTITION BY page, spanning ORDER BY top, box) - 1 AS span_no FROM s),
    g AS (SELECT *, CASE WHEN footer THEN 1000000 WHEN spanning THEN span_no ELSE seg0 END AS segment, CASE WHEN spanning THEN 1 WHEN footer THEN 2 ELSE 0 END AS kind FROM g0),
    n AS (SELECT *, CASE WHEN kind = 0 AND (max(greatest(top, bottom)) OVER o IS NULL OR top > max(greatest(top, bottom)) OVER o + {max(6.0, H * 0.015)}) THEN 1 ELSE 0 END AS fresh
          FROM g WINDOW o AS (PARTITION BY page, segment, kind ORDER BY top, x0, box ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    a AS (SELECT *, sum(fresh) OVER (PARTITION BY page, segment, kind ORDER BY top, x0, box ROWS UNBOUNDED PRECEDING) AS band FROM n),
    r AS (SELECT *, dense_rank() OVER (PARTITION BY page ORDER BY segment, kind, band) - 1 AS region FROM a),
    q AS (SELECT *, row_number() OVER (PARTITION BY page, region ORDER BY x0, box) AS k FROM r),
    c AS (SELECT page, region, box, k, x0 AS total, 1 AS n, 0 AS col FROM q WHERE k = 1
          UNION ALL
          SELECT q.page, q.region, q.box, q.k, CASE WHEN abs(q.x0 - c.total / c.n) > {W * 0.12} THEN q.x0 ELSE c.total + q.x0 END,
                 CASE WHEN abs(q.x0 - c.total / c.n) > {W * 0.12} THEN 1 ELSE c.n + 1 END, CASE WHEN abs(q.x0 - c.total / c.n) > {W * 0.12} THEN c.col + 1 ELSE c.col END
          FROM c JOIN q ON q.page = c.page AND q.region = c.region AND q.k = c.k + 1),
    m AS (SELECT q.*, CASE WHEN q.kind = 0 THEN c.col ELSE 0 END AS "column" FROM q JOIN c ON q.page = c.page AND q.box = c.box),
    ro AS (SELECT page, box, region, "column", CASE WHEN kind = 0 THEN max("column") OVER (PARTITION BY page, region) + 1 ELSE 1 END AS column_count,
           row_number() OVER (PARTITION BY page, region, "column" ORDER BY top, x0, box) - 1 AS position, count(*) OVER (PARTITION BY page, region, "column") AS column_units, spanning, footer, size, text, top FROM m)"""
_ORDER_COLUMNS = ["page", "box", "region", "column", "column_count", "position", "column_units", "spanning", "footer"]


@query(f"""WITH RECURSIVE {_ORDER} SELECT page, box, region, "column", column_count, position, column_units, spanning, footer FROM ro""")
def q_reading_order(spark: SparkSession, d: str) -> DataFrame:
    return L.reading_order(_boxes(spark, d), W, H).select(*_ORDER_COLUMNS)


_PAIRS = """lag(region) OVER w AS region0, lag("column") OVER w AS column0, lag(position) OVER w AS position0, lag(column_units) OVER w AS units0, lag(column_count) OVER w AS count0, lag(size) OVER w AS size0, lag(text) OVER w AS text0
    FROM ro WINDOW w AS (PARTITION BY page ORDER BY region, "column", position)"""
_CONFIRMED = """coalesce(region = region0 AND "column" = column0 + 1 AND position0 = units0 - 1 AND position = 0 AND least(column_count, count0) >= 2 AND abs(size - size0) / greatest(size, size0, 1.0) <= 0.18, false)"""


@query(f"WITH RECURSIVE {_ORDER}, p AS (SELECT *, {_PAIRS}) SELECT page, box, {_CONFIRMED} AS confirmed FROM p")
def q_continuation_layout(spark: SparkSession, d: str) -> DataFrame:
    return _confirmed(spark, d).select("page", "box", "confirmed")


def _confirmed(spark: SparkSession, d: str) -> DataFrame:
    """Adds the unit before in reading order and whether the layout confirms that a sentence flows on."""
    order = Window.partitionBy("page").orderBy("region", "column", "position")
    df = L.reading_order(_boxes(spark, d), W, H).withColumn("b", F.lag(F.struct("region", "column", "position", "column_units", "column_count", "size", "text")).over(order))
    flows = (C("region") == C("b.region")) & (C("column") == C("b.column") + 1) & (C("b.position") == C("b.column_units") - 1) & (C("position") == 0) & (F.least("column_count", "b.column_count") >= 2)
    near = F.abs(C("size") - C("b.size")) / F.greatest(C("size"), C("b.size"), F.lit(1.0)) <= 0.18
    return df.withColumn("confirmed", F.coalesce(flows & near, F.lit(False)))


def _sql_hint() -> str:
    broken = f"({_heading('v')} OR {_heading('v0')} OR regexp_matches({S.lstrip('text')}, {_BULLET}))"
    sentence = rf"'[。！？.!?…]{S.WS}*[\"''”’」』）)\]]*$'".replace('\\"', '"')
    return f"""CASE WHEN text0 IS NULL OR {broken} OR region <> region0 THEN 'separate'
        WHEN NOT regexp_matches(v0, {sentence}) AND {_CONFIRMED} THEN 'strong' WHEN {_layout_go("v0", "v1")} THEN 'possible' ELSE 'separate' END"""


@query(f"""WITH RECURSIVE {_ORDER}, p AS (SELECT *, {_PAIRS}), v AS (SELECT *, {S.strip("text")} AS v, {S.lstrip("text")} AS v1, {S.strip("coalesce(text0, '')")} AS v0 FROM p)
    SELECT page, box, {_sql_hint()} AS hint FROM v""")
def q_hints(spark: SparkSession, d: str) -> DataFrame:
    """strong, possible or separate for every unit, from layout and text."""
    df = _confirmed(spark, d)
    before = C("b.text")
    broken = T.heading_like(C("text")) | T.heading_like(before) | T.bullet_like(C("text"))
    hint = F.when(before.isNull() | broken | (C("region") != C("b.region")), "separate").when(~T.sentence_end(before) & C("confirmed"), "strong").when(T.layout_may_continue(before, C("text")), "possible").otherwise("separate")
    return df.select("page", "box", hint.alias("hint"))


@query(f"WITH {_B} SELECT page, box, (x0 + x1) / 2 BETWEEN 50 AND 550 AND (top + bottom) / 2 BETWEEN 40 AND 700 AS visible FROM b")
def q_box_visible(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(spark, d).select("page", "box", L.visible(None, F.lit(50), F.lit(40), F.lit(550), F.lit(700)).alias("visible"))


# Characters: every box as one character shifted by its number.
_CHARS = "ch AS (SELECT page, box AS ch, x0 + 2 AS cx0, x0 + 8 AS cx1, top + 1 AS ctop, top + 9 AS cbottom, size, [(box % 5) / 4.0::DOUBLE, 0.25::DOUBLE, (box % 3) / 2.0::DOUBLE] AS color FROM b)"


def _chars(boxes: DataFrame) -> DataFrame:
    return boxes.select("page", C("box").alias("ch"), (C("x0") + 2).alias("cx0"), (C("x0") + 8).alias("cx1"), (C("top") + 1).alias("ctop"), (C("top") + 9).alias("cbottom"), C("size").alias("csize"),
                        F.array(C("box") % 5 / 4, F.lit(0.25), C("box") % 3 / 2).alias("color"))


_INSIDE = "b JOIN ch USING (page) WHERE cx0 >= x0 - 0.5 AND cx1 <= x1 + 0.5 AND ctop >= top - 0.5 AND cbottom <= bottom + 0.5"


@query(f"WITH {_B}, {_CHARS} SELECT page, box, ch FROM {_INSIDE}")
def q_chars_in_box(spark: SparkSession, d: str) -> DataFrame:
    boxes = _boxes(spark, d)
    return L.chars_in_boxes(boxes.drop("size", "text"), _chars(boxes)).select("page", "box", "ch")


def _rgb_columns(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, C("color")[0].alias("r"), C("color")[1].alias("g"), C("color")[2].alias("b"))


@query(f"""WITH {_B}, {_CHARS}, k AS (SELECT page, box, [round(x, 4) FOR x IN color] AS color, count(*) AS n, min(ch) AS first FROM {_INSIDE} GROUP BY ALL)
    SELECT page, box, c[1] AS r, c[2] AS g, c[3] AS b FROM (SELECT page, box, arg_max(color, n * 1000 - first) AS c FROM k GROUP BY page, box)""")
def q_dominant_color(spark: SparkSession, d: str) -> DataFrame:
    """The colour of most characters of a box, the first seen among equals."""
    boxes = _boxes(spark, d)
    seen = L.chars_in_boxes(boxes.drop("size", "text"), _chars(boxes)).withColumn("color", F.transform(L.rgb(C("color")), lambda x: F.round(x, 4)))
    counts = seen.groupBy("page", "box", "color").agg(F.count("*").alias("n"), F.min("ch").alias("first"))
    return _rgb_columns(counts.groupBy("page", "box").agg(F.max_by("color", F.struct("n", -C("first"))).alias("color")), "page", "box")


@query(f"""WITH {_B}, {_CHARS}, z AS (SELECT page, box, any_value(x0) AS x0, any_value(x1) AS x1, any_value(top) AS top, any_value(bottom) AS bottom, list_sort(list(ch.size)) AS s FROM {_INSIDE} GROUP BY ALL),
    u AS (SELECT *, s[len(s) // 2 + 1] AS size FROM z),
    v AS (SELECT page, box, greatest(0.0, x0) AS l, least({W}, x1) AS r, least({H}, {H} - top + size * 0.2) AS t, greatest(0.0, {H} - bottom - size * 0.35) AS o, least(36.0, greatest(5.5, size)) AS font_size FROM u)
    SELECT page, box, round(l, 6) AS "left", round(r, 6) AS "right", round(t, 6) AS top, round(o, 6) AS bottom, font_size FROM v WHERE r - l >= 3 AND t - o >= 4""")
def q_unit_box(spark: SparkSession, d: str) -> DataFrame:
    """A unit's box from the upper median size of its characters, seen from the bottom of the page."""
    boxes = _boxes(spark, d)
    seen = L.chars_in_boxes(boxes.drop("size", "text"), _chars(boxes)).groupBy("page", "box", "x0", "x1", "top", "bottom").agg(F.sort_array(F.collect_list("csize")).alias("s"))
    size = F.element_at("s", F.expr("cast(size(s) div 2 + 1 as int)"))
    out = seen.select("page", "box", F.greatest(F.lit(0.0), C("x0")).alias("l"), F.least(F.lit(W), C("x1")).alias("r"), F.least(F.lit(H), H - C("top") + size * 0.2).alias("t"), F.greatest(F.lit(0.0), H - C("bottom") - size * 0.35).alias("o"), F.least(F.lit(36.0), F.greatest(F.lit(5.5), size)).alias("font_size"))
    out = out.where((C("r") - C("l") >= 3) & (C("t") - C("o") >= 4))
    return out.select("page", "box", F.round("l", 6).alias("left"), F.round("r", 6).alias("right"), F.round("t", 6).alias("top"), F.round("o", 6).alias("bottom"), "font_size")


@query(f"""WITH {_B}, o AS (SELECT a.page, a.box, min(c.x0) AS near FROM b a JOIN b c ON a.page = c.page AND c.x0 > a.x0 + 1 AND abs(c.top - a.top) <= greatest(2.0, greatest(a.size, c.size) * 0.35) GROUP BY ALL)
    SELECT b.page, b.box, least({W - 48.0}, coalesce(near - 4, {W - 48.0})) AS "right" FROM b LEFT JOIN o ON o.page = b.page AND o.box = b.box""")
def q_right_bound(spark: SparkSession, d: str) -> DataFrame:
    """The right edge of a unit: the margin, or shortly before the next unit in its row."""
    a = _boxes(spark, d).select("page", "box", "x0", "top", "size")
    b = a.select("page", C("x0").alias("ox0"), C("top").alias("otop"), C("size").alias("osize"))
    tolerance = F.greatest(F.lit(2.0), F.greatest("size", "osize") * 0.35)
    near = a.join(b, "page").where((C("ox0") > C("x0") + 1) & (F.abs(C("otop") - C("top")) <= tolerance)).groupBy("page", "box").agg(F.min("ox0").alias("near"))
    return a.join(near, ["page", "box"], "left").select("page", "box", F.least(F.lit(W - 48.0), F.coalesce(C("near") - 4, F.lit(W - 48.0))).alias("right"))


@query(f"WITH {_B} SELECT page, min(x0) AS x0, max(x1) AS x1, min(top) AS top, max(bottom) AS bottom FROM b GROUP BY page")
def q_bounds_union(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(spark, d).groupBy("page").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))


@query(f"""WITH RECURSIVE {_B}, q AS (SELECT page, box, top, row_number() OVER (PARTITION BY page ORDER BY top, box) AS k FROM b),
    c AS (SELECT page, box, k, top AS anchor, 0 AS row_no FROM q WHERE k = 1
          UNION ALL SELECT q.page, q.box, q.k, CASE WHEN abs(q.top - c.anchor) > 2 THEN q.top ELSE least(c.anchor, q.top) END, CASE WHEN abs(q.top - c.anchor) > 2 THEN c.row_no + 1 ELSE c.row_no END
          FROM c JOIN q ON q.page = c.page AND q.k = c.k + 1)
    SELECT page, box, row_no FROM c""")
def q_row_merge(spark: SparkSession, d: str) -> DataFrame:
    docs = _boxes(spark, d).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("top", "box"))).alias("l"))
    rows = L.merged_rows(F.transform("l", lambda x: x["top"]))
    return docs.select("page", F.explode(F.arrays_zip(F.transform("l", lambda x: x["box"]).alias("box"), rows.alias("row_no"))).alias("z")).select("page", "z.box", "z.row_no")


_COMPONENTS = """CASE l_linenumber % 4 WHEN 0 THEN [l_discount * 10] WHEN 1 THEN [l_discount * 15 - 0.1::DOUBLE, l_tax, 1.5::DOUBLE] WHEN 2 THEN [l_discount, l_tax, 0.5::DOUBLE, l_discount * 5] ELSE [l_tax, l_tax] END"""


@query(f"""WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, {_COMPONENTS} AS c FROM lineitem), m AS (SELECT *, [least(1.0, greatest(0.0, x)) FOR x IN c] AS m FROM k)
    SELECT l_orderkey, l_linenumber, l_partkey, z[1] AS r, z[2] AS g, z[3] AS b FROM (SELECT l_orderkey, l_linenumber, l_partkey, [round(x, 6) FOR x IN CASE len(c) WHEN 1 THEN [m[1], m[1], m[1]] WHEN 3 THEN m WHEN 4 THEN [1 - least(1.0, m[1] + m[4]), 1 - least(1.0, m[2] + m[4]), 1 - least(1.0, m[3] + m[4])]
    ELSE [0.08::DOUBLE, 0.08, 0.08] END] AS z FROM m)""")
def q_rgb(spark: SparkSession, d: str) -> DataFrame:
    n = C("l_linenumber") % 4
    parts = F.when(n == 0, F.array(C("l_discount") * 10)).when(n == 1, F.array(C("l_discount") * 15 - 0.1, C("l_tax"), F.lit(1.5))).when(n == 2, F.array(C("l_discount"), C("l_tax"), F.lit(0.5), C("l_discount") * 5)).otherwise(F.array("l_tax", "l_tax"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.transform(L.rgb(parts), lambda x: F.round(x, 6)).alias("color")).transform(_rgb_columns, "l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH k AS (SELECT p_partkey, p_size * 30.0::DOUBLE AS w, p_retailprice AS h, (p_partkey % 5 * 90)::INT AS r FROM part), t AS (SELECT *, (r % 360) IN (90, 270) AS turn FROM k),
    s AS (SELECT p_partkey, CASE WHEN turn THEN h ELSE w END AS w, CASE WHEN turn THEN w ELSE h END AS h FROM t)
    SELECT p_partkey, CASE WHEN w BETWEEN 36 AND 20000 AND h BETWEEN 36 AND 20000 THEN w ELSE 612.0 END AS width, CASE WHEN w BETWEEN 36 AND 20000 AND h BETWEEN 36 AND 20000 THEN h ELSE 792.0 END AS height FROM s""")
def q_page_size(spark: SparkSession, d: str) -> DataFrame:
    size = L.page_size(C("p_size") * F.lit(30.0), C("p_retailprice"), (C("p_partkey") % 5 * 90).cast("int"))
    return table(spark, d, "part").withColumn("s", size).select("p_partkey", "s.width", "s.height")


@query("""SELECT p_partkey, abs(c0 - m0) > 0.01 OR abs(c1 - m1) > 0.01 AS distinct_crop, c0 - m0 AS "left", m1 - c1 AS top,
    m0 = 0 AND c0 >= m0 - 0.01 AND c1 <= m1 + 0.01 AND c1 - c0 >= 1 AS supported
    FROM (SELECT p_partkey, (p_partkey % 3)::DOUBLE AS m0, p_retailprice AS m1, (p_size % 4)::DOUBLE AS c0, p_retailprice - (p_size % 3) AS c1 FROM part)""")
def q_page_crop(spark: SparkSession, d: str) -> DataFrame:
    """Crop against media bounds: distinct, visible origin, supported."""
    df = table(spark, d, "part").select("p_partkey", (C("p_partkey") % 3).cast("double").alias("m0"), C("p_retailprice").alias("m1"), (C("p_size") % 4).cast("double").alias("c0"), (C("p_retailprice") - C("p_size") % 3).alias("c1"))
    fine = (C("m0") == 0) & (C("c0") >= C("m0") - 0.01) & (C("c1") <= C("m1") + 0.01) & (C("c1") - C("c0") >= 1)
    return df.select("p_partkey", ((F.abs(C("c0") - C("m0")) > 0.01) | (F.abs(C("c1") - C("m1")) > 0.01)).alias("distinct_crop"), (C("c0") - C("m0")).alias("left"), (C("m1") - C("c1")).alias("top"), fine.alias("supported"))


@query("""SELECT vec_id, m[1] AS m0, m[2] AS m1, m[3] AS m2, m[4] AS m3, m[5] AS m4, m[6] AS m5 FROM (SELECT vec_id, [round(x, 4) + 0.0 FOR x IN [a[1]*b[1] + a[2]*b[3], a[1]*b[2] + a[2]*b[4], a[3]*b[1] + a[4]*b[3], a[3]*b[2] + a[4]*b[4], a[5]*b[1] + a[6]*b[3] + b[5], a[5]*b[2] + a[6]*b[4] + b[6]]] AS m
    FROM (SELECT vec_id, embedding[1:6]::DOUBLE[] AS a, embedding[7:12]::DOUBLE[] AS b FROM embeddings))""")
def q_matrix_mul(spark: SparkSession, d: str) -> DataFrame:
    e = C("embedding").cast("array<double>")
    df = table(spark, d, "embeddings").select("vec_id", L.matrix_product(F.slice(e, 1, 6), F.slice(e, 7, 6)).alias("m"))
    return df.select("vec_id", *((F.round(C("m")[i], 4) + 0.0).alias(f"m{i}") for i in range(6)))


_OCR = rf"""o AS (SELECT doc_id, line_no, line, regexp_replace(line, '[{S.IN}]+', '', 'g') AS k, (doc_id * 7 + line_no) % 100 / 100.0::DOUBLE AS score, length(line) * 6.0::DOUBLE AS w, (8 + line_no % 60)::DOUBLE AS h FROM dl)"""


@query(rf"""WITH {S.DOCS}, {_OCR} SELECT doc_id, line_no, score >= 0.45 AND k <> '' AND NOT (length(k) = 1 AND regexp_matches(k, '\p{{L}}')) AND regexp_matches(k, '[A-Za-z\x{{3400}}-\x{{9fff}}\x{{3040}}-\x{{30ff}}\x{{ac00}}-\x{{d7af}}]')
    AND w >= 2 AND h >= 2 AND h <= w * 1.8 AS kept FROM o""")
def q_ocr_filter(spark: SparkSession, d: str) -> DataFrame:
    zero = F.lit(0.0)
    kept = L.ocr_kept(C("line"), (C("doc_id") * 7 + C("line_no")) % 100 / F.lit(100.0), zero, zero, F.length("line") * F.lit(6.0), (8 + C("line_no") % 60).cast("double"))
    return document_lines(spark, d).select("doc_id", "line_no", kept.alias("kept"))


_LABEL = r"'^(?:[0-9]{1,4}|[ivxlcdmIVXLCDM]{1,12})(?:\s*[-–]\s*[0-9]{1,4})?$'"


@query(rf"""WITH {S.DOCS}, c AS (SELECT doc_id, line_no, list_filter(list_transform(string_split_regex({S.strip("line")}, '[ \t]{{4,}}'), lambda x: {S.collapsed("x")}), lambda x: x <> '') AS c FROM dl WHERE {S.strip("line")} <> ''),
    r AS (SELECT doc_id, len(c) >= 2 AND regexp_matches(c[-1], {_LABEL}) AS numbered FROM c WHERE len(c) > 0)
    SELECT doc_id, count(*) AS n_rows, count_if(numbered)::BIGINT AS n_numbered, count(*) >= 5 AND count_if(numbered) >= greatest(4, (count(*) + 1) // 2) AS toc FROM r GROUP BY doc_id""")
def q_toc_rows(spark: SparkSession, d: str) -> DataFrame:
    """Contents pages: rows of cells divided by wide gaps, mostly with a page label at the end."""
    cells = F.filter(F.transform(F.split(T.strip(C("line")), r"[ \t]{4,}"), T.collapsed), lambda x: x != "")
    rows = document_lines(spark, d).where(T.strip(C("line")) != "").select("doc_id", cells.alias("c")).where(F.size("c") > 0)
    numbered = (F.size("c") >= 2) & F.element_at("c", -1).rlike(_LABEL.strip("'").replace(r"\s", r"\s"))
    out = rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.count_if(numbered).alias("n_numbered"))
    return out.withColumn("toc", (C("n_rows") >= 5) & (C("n_numbered") >= F.greatest(F.lit(4), F.expr("(n_rows + 1) div 2"))))


@query(rf"""WITH {S.DOCS}, v AS (SELECT doc_id, {S.collapsed("line")} AS v FROM dl), w AS (SELECT doc_id, v, regexp_matches(v, '[A-Za-z]') AND NOT regexp_matches(v, '\p{{Nd}}') AS alpha, regexp_extract_all(v, '[A-Za-z]+') AS t FROM v WHERE v <> '')
    SELECT doc_id, count(*) AS n, count(*) >= 6 AND ((count_if(alpha) >= 6 AND count_if(alpha AND length(regexp_replace(v, '[{S.IN}\x{{ad}}]+', '', 'g')) <= 3) / greatest(1, count_if(alpha)) >= 0.65)
        OR bool_or(len(t) >= 8 AND len(list_filter(t, lambda x: length(x) <= 2)) / len(t) >= 0.7)
        OR sum(len(regexp_extract_all(' ' || v, '(?:^|[^\p{{L}}\p{{N}}_])[B-HJ-Z] [a-z]{{2,}}(?:$|[^\p{{L}}\p{{N}}_])'))) >= 2) AS fragmented FROM w GROUP BY doc_id""")
def q_fragmented(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose text came out in single glyphs: many tiny units, a unit of mostly one- and two-letter tokens, or two
    words whose capital stands apart (A and I are words of their own)."""
    v = document_lines(spark, d).select("doc_id", T.collapsed(C("line")).alias("v")).where("v <> ''")
    alpha = C("v").rlike("[A-Za-z]") & ~C("v").rlike(r"\p{Nd}")
    t = F.regexp_extract_all("v", F.lit("[A-Za-z]+"), F.lit(0))
    broken = (F.size(t) >= 8) & (F.size(F.filter(t, lambda x: F.length(x) <= 2)) / F.greatest(F.size(t), F.lit(1)) >= 0.7)
    out = v.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(alpha).alias("a"), F.count_if(alpha & (F.length(T.layout_key(C("v"))) <= 3)).alias("tiny"), F.bool_or(broken).alias("broken"), F.sum(F.regexp_count("v", F.lit(r"(?U)\b[B-HJ-Z]\s+[a-z]{2,}\b"))).alias("apart"))
    return out.select("doc_id", "n", ((C("n") >= 6) & (((C("a") >= 6) & (C("tiny") / F.greatest(C("a"), F.lit(1)) >= 0.65)) | C("broken") | (C("apart") >= 2))).alias("fragmented"))


# The two extractions of a page: layout units are its lines with bogus blanks, plain ones without; of some documents the
# plain text has a line less, or another word.
_LAID = "regexp_replace(line, '([b-hj-z])([a-z]{3})', '\\1 \\2')"
_PLAIN = "CASE WHEN doc_id % 7 = 0 AND line_no = 0 THEN line || 'x' ELSE line END"


@query(rf"""WITH {S.DOCS}, la AS (SELECT doc_id, line_no, CASE WHEN doc_id % 3 = 0 THEN line ELSE {_LAID} END AS unit FROM dl), pl AS (SELECT doc_id, line_no, {_PLAIN} AS unit FROM dl WHERE doc_id % 5 <> 0 OR line_no > 0),
    p AS (SELECT coalesce(la.doc_id, pl.doc_id) AS doc_id, count(la.unit) AS n, count(la.unit) = count(pl.unit) AND coalesce(bool_and(regexp_replace(la.unit, '[{S.IN}]+', '', 'g') = regexp_replace(pl.unit, '[{S.IN}]+', '', 'g')), true) AS same,
        sum(length(la.unit) - length(replace(la.unit, ' ', '')))::BIGINT AS a, sum(length(pl.unit) - length(replace(pl.unit, ' ', '')))::BIGINT AS b FROM la FULL JOIN pl ON la.doc_id = pl.doc_id AND la.line_no = pl.line_no GROUP BY 1)
    SELECT doc_id, n, coalesce(same, false) AS same, CASE WHEN same AND b < a THEN 'plain' ELSE 'layout' END AS choice FROM p""")
def q_spacing_choice(spark: SparkSession, d: str) -> DataFrame:
    """The plain extraction of a page is chosen if it has as many units, with the same signs, and fewer blanks."""
    lines = document_lines(spark, d)
    laid = lines.select("doc_id", "line_no", F.when(C("doc_id") % 3 == 0, C("line")).otherwise(L.first_replaced(C("line"), "([b-hj-z])([a-z]{3})", "$1 $2")).alias("laid"))
    plain = lines.where("doc_id % 5 <> 0 or line_no > 0").select("doc_id", "line_no", F.expr(_PLAIN).alias("plain"))
    return L.spacing_choice(laid, plain, "doc_id", "line_no")


@query(rf"""WITH RECURSIVE {S.DOCS}, a AS (SELECT doc_id, list(line ORDER BY line_no) AS l FROM dl GROUP BY doc_id),
    r AS (SELECT doc_id, l, 0 AS i, '' AS held, []::VARCHAR[] AS out FROM a
          UNION ALL
          SELECT doc_id, l, i + 1, CASE WHEN len(c) <> 1 THEN '' WHEN h = '' OR fresh THEN c[1]
                WHEN ends_with(held, '-') AND regexp_matches(c[1], '^[\p{{L}}\p{{N}}]') THEN substr(held, 1, length(held) - 1) || c[1] ELSE held || ' ' || c[1] END,
            CASE WHEN len(c) = 0 THEN flushed WHEN len(c) > 1 THEN flushed || c WHEN fresh THEN flushed ELSE out END
          FROM (SELECT *, CASE WHEN h = '' THEN out ELSE out || [h] END AS flushed,
                       len(c) = 1 AND h <> '' AND (regexp_matches(h, {_TERMINAL}) OR {_heading("h")} OR {_heading("v")} OR regexp_matches(v, {_BULLET})) AS fresh
                FROM (SELECT *, {S.collapsed("held")} AS h, coalesce(c[1], '') AS v
                      FROM (SELECT *, list_filter(list_transform(string_split_regex({S.strip("l[i + 1]")}, '[ \t]{{4,}}'), lambda x: {S.collapsed("x")}), lambda x: x <> '') AS c FROM r WHERE i < len(l)))))
    SELECT doc_id, sha256(array_to_string(CASE WHEN held = '' THEN out ELSE out || [{S.collapsed("held")}] END, chr(10))) AS digest, len(out) + (held <> '')::INT AS n FROM r WHERE i = len(l)""")
def q_pdf_page_units(spark: SparkSession, d: str) -> DataFrame:
    df = balanced(table(spark, d, "documents").where("text is not null").select("doc_id", "text")).select("doc_id", L.page_units(F.split(T.normalized(C("text")), "\n")).alias("u"))
    return df.select("doc_id", F.sha2(F.array_join("u", "\n"), 256).alias("digest"), F.size("u").cast("long").alias("n"))


# Recognised lines: every box with a text of its own; some are headings, bullets or end in stops, most run on.
_SAID = """CASE WHEN l_partkey % 11 = 0 THEN 'CHAPTER ' || l_suppkey WHEN l_partkey % 13 = 0 THEN '- part ' || l_partkey WHEN l_partkey % 7 = 0 THEN 'it ends at ' || l_partkey || '.'
    WHEN l_partkey % 5 = 0 THEN 'goes on with a hyphen-' ELSE 'the line ' || l_partkey || ' goes on' END"""
_LINES = f"""b AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS box, {_SAID} AS text, 40.0::DOUBLE + l_suppkey % 3 * 20 AS x0,
    (240 + l_partkey % 60)::DOUBLE AS x1, (l_linenumber * 14 + l_quantity % 4)::DOUBLE AS top, (l_linenumber * 14 + 11)::DOUBLE AS bottom, 9.0::DOUBLE AS size FROM lineitem)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem")
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return df.select(C("l_orderkey").alias("page"), number.alias("box"), F.expr(_SAID).alias("text"), (40.0 + C("l_suppkey") % 3 * 20).cast("double").alias("x0"), (240 + C("l_partkey") % 60).cast("double").alias("x1"),
                     (C("l_linenumber") * 14 + C("l_quantity") % 4).cast("double").alias("top"), (C("l_linenumber") * 14 + 11).cast("double").alias("bottom"), F.lit(9.0).alias("size"))


_OCR_LINES = _ORDER.replace(_B, _LINES)
_TALL = f"greatest(greatest(1.0, q.bottom - q.top) * 1.35, {H * 0.012})"


@query(rf"""WITH RECURSIVE {_OCR_LINES}, o AS (SELECT ro.page, ro.box, ro.text, b.x0, b.x1, b.top, b.bottom, row_number() OVER w AS k,
        coalesce(region = lag(region) OVER w AND "column" = lag("column") OVER w, false) AND NOT regexp_matches({S.lstrip("ro.text")}, {_BULLET}) AND NOT ({_heading(S.strip("ro.text"))}) AS joins
        FROM ro JOIN b USING (page, box) WINDOW w AS (PARTITION BY ro.page ORDER BY region, "column", position)),
    gr AS (SELECT page, k, 0 AS block, text, x0, x1, top, bottom, 1 AS n FROM o WHERE k = 1
          UNION ALL
          SELECT page, k, CASE WHEN j THEN block ELSE block + 1 END, CASE WHEN NOT j THEN t WHEN ends_with(text, '-') AND regexp_matches(t, '^[\p{{L}}\p{{N}}]') THEN substr(text, 1, length(text) - 1) || t ELSE text || ' ' || t END,
                 CASE WHEN j THEN least(x0, a0) ELSE a0 END, CASE WHEN j THEN greatest(x1, a1) ELSE a1 END, CASE WHEN j THEN least(top, a_top) ELSE a_top END, CASE WHEN j THEN greatest(bottom, a_bottom) ELSE a_bottom END, CASE WHEN j THEN n + 1 ELSE 1 END
          FROM (SELECT q.page, q.k, gr.block, gr.text, gr.x0, gr.x1, gr.top, gr.bottom, gr.n, q.text AS t, q.x0 AS a0, q.x1 AS a1, q.top AS a_top, q.bottom AS a_bottom,
                       q.joins AND q.top - gr.bottom <= {_TALL} AND abs(q.x0 - gr.x0) <= {W * 0.06} AND NOT regexp_matches(gr.text, {_TERMINAL}) AS j
                FROM gr JOIN o q ON q.page = gr.page AND q.k = gr.k + 1))
    SELECT page, block, arg_max(text, k) AS text, arg_max(x0, k) AS x0, arg_max(x1, k) AS x1, arg_max(top, k) AS top, arg_max(bottom, k) AS bottom, arg_max(n, k) AS n FROM gr GROUP BY page, block""")
def q_ocr_groups(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a page as blocks."""
    lines = L.reading_order(_lines(spark, d), W, H)
    return L.ocr_blocks(lines, W, H)


# Fragments: the words of a document's lines; in some documents one is lost, one is left over, or two are swapped.
def _key(x: str) -> str:
    return rf"regexp_replace({x}, '[{S.IN}\x{{ad}}]+', '', 'g')"



@query(rf"""WITH {S.DOCS}, u AS (SELECT doc_id, line_no, {_key("line")} AS key FROM dl WHERE {_key("line")} <> ''),
    w0 AS (SELECT doc_id, line_no, unnest(range(len(w)))::INT AS i, unnest(w) AS word FROM (SELECT doc_id, line_no, string_split({S.collapsed("line")}, ' ') AS w FROM dl WHERE {_key("line")} <> '')),
    w1 AS (SELECT doc_id, line_no, i, word, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, i) AS k FROM w0),
    w2 AS (SELECT doc_id, line_no, i, CASE WHEN doc_id % 9 = 1 AND k = 2 THEN reverse(word) ELSE word END AS word FROM w1 WHERE NOT (doc_id % 6 = 1 AND k = 3)
           UNION ALL SELECT doc_id, max(line_no), 1000000, 'over' FROM w1 WHERE doc_id % 8 = 1 GROUP BY doc_id),
    fr AS (SELECT doc_id, {_key("word")} AS key, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, i) AS k FROM w2),
    fa AS (SELECT doc_id, string_agg(key, '' ORDER BY k) AS all_fragments FROM fr GROUP BY doc_id),
    fe AS (SELECT doc_id, k, sum(length(key)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM fr),
    ue AS (SELECT doc_id, line_no, key, sum(length(key)) OVER (PARTITION BY doc_id ORDER BY line_no) AS stop FROM u),
    ok AS (SELECT ue.doc_id, bool_and(fe.k IS NOT NULL) AND any_value(fa.all_fragments) = string_agg(ue.key, '' ORDER BY line_no) AS fits
           FROM ue LEFT JOIN fa ON fa.doc_id = ue.doc_id LEFT JOIN (SELECT doc_id, stop, max(k) AS k FROM fe GROUP BY ALL) fe ON fe.doc_id = ue.doc_id AND fe.stop = ue.stop GROUP BY ue.doc_id),
    al AS (SELECT ue.doc_id, line_no, coalesce(fits, false) AS mapped, (SELECT 1) AS one, ue.stop - length(ue.key) AS start, ue.stop FROM ue JOIN ok USING (doc_id))
    SELECT al.doc_id, line_no, mapped, CASE WHEN mapped THEN count(fe.k) END AS fragments FROM al LEFT JOIN fe ON mapped AND fe.doc_id = al.doc_id AND fe.stop > al.start AND fe.stop <= al.stop GROUP BY al.doc_id, line_no, mapped""")
def q_fragment_map(spark: SparkSession, d: str) -> DataFrame:
    """Fragments against units: how many make up each unit; a page whose fragments are other signs, too few or too many has none."""
    units = document_lines(spark, d).select("doc_id", "line_no", T.layout_key(C("line")).alias("key"), F.split(T.collapsed(C("line")), " ").alias("words")).where("key <> ''")
    words = units.select("doc_id", "line_no", F.posexplode("words").alias("i", "word"))
    words = words.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "i")))
    over = words.where("doc_id % 8 = 1").groupBy("doc_id").agg(F.max("line_no").alias("line_no")).select("doc_id", "line_no", F.lit(1_000_000).alias("i"), F.lit("over").alias("word"))
    kept = words.where("not (doc_id % 6 = 1 and k = 3)").select("doc_id", "line_no", "i", F.when((C("doc_id") % 9 == 1) & (C("k") == 2), F.reverse("word")).otherwise(C("word")).alias("word"))
    return L.fragment_map(units.select("doc_id", "line_no", "key"), kept.unionByName(over).select("doc_id", "line_no", "i", T.layout_key(C("word")).alias("key")))


@query(f"WITH {_B} SELECT page, box, x0 >= 0 AND x1 <= {W} + 0.01 AND {H} - bottom >= 0 AND {H} - top <= {H} + 0.01 AND x1 - x0 >= 3 AND bottom - top >= 4 AS valid FROM b")
def q_box_valid(spark: SparkSession, d: str) -> DataFrame:
    """Whether a stored box lies on its page and can hold text."""
    low, high = H - C("bottom"), H - C("top")
    return _boxes(spark, d).select("page", "box", ((C("x0") >= 0) & (C("x1") <= W + 0.01) & (low >= 0) & (high <= H + 0.01) & (C("x1") - C("x0") >= 3) & (high - low >= 4)).alias("valid"))


@query(f"""WITH {_B}, p AS (SELECT page, box, x0 * 2 AS pl, x1 * 2 AS pr, top * 2 AS pt, bottom * 2 AS pb, (box % 5) / 4.0::DOUBLE AS g FROM b)
    SELECT page, box, round(greatest(0.0, pl / {2 * W} * {W}), 6) AS x0, round(least({W}, pr / {2 * W} * {W}), 6) AS x1, round(greatest(0.0, pt / {2 * H} * {H}), 6) AS top, round(least({H}, pb / {2 * H} * {H}), 6) AS bottom,
        CASE WHEN 0.2126 * g + 0.7152 * g + 0.0722 * g >= 0.55 THEN 'dark' ELSE 'light' END AS ink, round(greatest(5.5, least(72.0, (pb - pt) / 2 * 0.72)), 6) AS size FROM p""")
def q_ocr_scale(spark: SparkSession, d: str) -> DataFrame:
    """Recognised boxes from pixels to points, the ink that reads on their background, the size of their text."""
    b = _boxes(spark, d).select("page", "box", (C("x0") * 2).alias("pl"), (C("x1") * 2).alias("pr"), (C("top") * 2).alias("pt"), (C("bottom") * 2).alias("pb"), (C("box") % 5 / 4).alias("g"))
    light = C("g") * 0.2126 + C("g") * 0.7152 + C("g") * 0.0722
    return b.select("page", "box", F.round(F.greatest(F.lit(0.0), C("pl") / (2 * W) * W), 6).alias("x0"), F.round(F.least(F.lit(W), C("pr") / (2 * W) * W), 6).alias("x1"), F.round(F.greatest(F.lit(0.0), C("pt") / (2 * H) * H), 6).alias("top"),
                    F.round(F.least(F.lit(H), C("pb") / (2 * H) * H), 6).alias("bottom"), F.when(light >= 0.55, "dark").otherwise("light").alias("ink"), F.round(F.greatest(F.lit(5.5), F.least(F.lit(72.0), (C("pb") - C("pt")) / 2 * 0.72)), 6).alias("size"))


@query(rf"""WITH {S.DOCS}, {_B}, r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS row_no, {S.collapsed("line")} AS title FROM dl WHERE {S.strip("line")} <> ''),
    x AS (SELECT page AS doc_id, row_number() OVER (PARTITION BY page ORDER BY top, box) - 1 AS row_no, x0, x1, top, bottom FROM b),
    n AS (SELECT doc_id FROM (SELECT doc_id, count(*) AS n FROM r GROUP BY ALL) JOIN (SELECT doc_id, count(*) AS m FROM x GROUP BY ALL) USING (doc_id) WHERE n = m)
    SELECT doc_id, row_no, title, x0, x1, top, bottom FROM r JOIN x USING (doc_id, row_no) WHERE doc_id IN (SELECT doc_id FROM n)""")
def q_toc_join(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a contents page (here a document's lines) with the boxes of their lines, where a page has as many of both."""
    lines = document_lines(spark, d).where(T.strip(C("line")) != "")
    rows = lines.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1).alias("row_no"), T.collapsed(C("line")).alias("title"))
    boxes = _boxes(spark, d).select(C("page").alias("doc_id"), (F.row_number().over(Window.partitionBy("page").orderBy("top", "box")) - 1).alias("row_no"), "x0", "x1", "top", "bottom")
    return L.positional(rows, boxes, "doc_id", "row_no")
