"""Page geometry: boxes, characters and lines as rows of a page."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

C = F.col
DARK = (0.08, 0.08, 0.08)


def clamped(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def rgb(components: Column) -> Column:
    """Gray, RGB or CMYK components as clamped RGB; any other number of them is nearly black."""
    at = [clamped(F.get(components, F.lit(i))) for i in range(4)]
    ink = [F.lit(1.0) - F.least(F.lit(1.0), at[i] + at[3]) for i in range(3)]
    n = F.size(components)
    return F.when(n == 1, F.array(at[0], at[0], at[0])).when(n == 3, F.array(*at[:3])).when(n == 4, F.array(*ink)).otherwise(F.array(*map(F.lit, DARK)))


def page_size(width: Column, height: Column, rotation: Column) -> Column:
    """Size of a page as seen: turned by 90 or 270 it is swapped; an absurd size gives letter paper."""
    turn = F.pmod(rotation, F.lit(360)).isin(90, 270)
    w, h = F.when(turn, height).otherwise(width), F.when(turn, width).otherwise(height)
    fine = w.between(36, 20000) & h.between(36, 20000)
    return F.struct(F.when(fine, w).otherwise(612.0).alias("width"), F.when(fine, h).otherwise(792.0).alias("height"))


def matrix_product(a: Column, b: Column) -> Column:
    """Product of two affine matrices of six numbers."""
    x, y = [F.get(a, F.lit(i)) for i in range(6)], [F.get(b, F.lit(i)) for i in range(6)]
    return F.array(x[0] * y[0] + x[1] * y[2], x[0] * y[1] + x[1] * y[3], x[2] * y[0] + x[3] * y[2], x[2] * y[1] + x[3] * y[3], x[4] * y[0] + x[5] * y[2] + y[4], x[4] * y[1] + x[5] * y[3] + y[5])


def visible(box: DataFrame, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return ((C("x0") + C("x1")) / 2).between(left, right) & ((C("top") + C("bottom")) / 2).between(top, bottom)


def clusters(xs: Column, reach: Column) -> Column:
    """Column numbers for sorted left edges: a box joins the last column if it is near the mean of that column's edges."""
    start = F.struct(F.lit(-1).alias("no"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = (a["n"] == 0) | (F.abs(x - a["sum"] / F.greatest(a["n"], F.lit(1))) > reach)
        no = F.when(new, a["no"] + 1).otherwise(a["no"])
        return F.struct(no.alias("no"), F.when(new, x).otherwise(a["sum"] + x).alias("sum"), F.when(new, 1).otherwise(a["n"] + 1).alias("n"), F.concat(a["out"], F.array(no)).alias("out"))

    return F.aggregate(xs, start, step)["out"]


def reading_order(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """Adds region, column, column_count, position, column_units, spanning, footer to (page, box, text, x0, x1, top, bottom).

    Footers come last. Boxes that span the page divide it; between them, gaps divide bands, bands have columns, columns
    are read from top to bottom. Everything is windows over one page except the columns' running means, a fold per region.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\A\s+|\s+\z", "")
    footer = (C("top") > height * 0.88) & (F.length(text) <= 8) & ~text.rlike(r"[A-Za-z\x{3400}-\x{9fff}]")
    span = ~C("footer") & (C("x0") < width * 0.45) & (C("x1") > width * 0.55) & (C("x1") - C("x0") > width * 0.18)
    page = Window.partitionBy("page")
    df = boxes.withColumn("footer", footer).withColumn("spanning", span)
    # A segment is what lies above the k-th spanning box; a box at the height of a span comes after it.
    by_top = page.orderBy("top").rangeBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("segment", F.sum(F.when(C("spanning"), 1).otherwise(0)).over(by_top))
    span_no = F.row_number().over(Window.partitionBy("page", "spanning").orderBy("top", "box"))
    below = F.count_if("spanning").over(page) + 1  # the footer's segment, after every other
    df = df.withColumn("segment", F.when(C("footer"), below).when(C("spanning"), span_no - 1).otherwise(C("segment")))
    free = ~C("footer") & ~C("spanning")
    kind = F.when(C("spanning"), 1).when(C("footer"), 2).otherwise(0)
    df = df.withColumn("kind", kind)
    order = Window.partitionBy("page", "segment", "kind").orderBy("top", "x0", "box")
    low = F.max(F.greatest("top", "bottom")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new_band = F.when(free & (low.isNull() | (C("top") > low + max(6.0, height * 0.015))), 1).otherwise(0)
    df = df.withColumn("_new", new_band)
    df = df.withColumn("band", F.sum("_new").over(order))
    region = F.dense_rank().over(page.orderBy("segment", "kind", "band")) - 1
    df = df.withColumn("region", region)
    # One row per region folds its left edges once; its boxes come back from that row.
    rows = df.drop("_new", "band", "segment", "kind").columns
    regions = df.groupBy("page", "region").agg(F.sort_array(F.collect_list(F.struct("x0", "box", *(c for c in rows if c not in ("page", "region", "x0", "box"))))).alias("_l"))
    regions = regions.withColumn("_c", clusters(F.transform("_l", lambda s: s["x0"]), F.lit(width * 0.12)))
    df = regions.select("page", "region", F.element_at("_c", -1).alias("_last"), F.explode(F.arrays_zip("_l", "_c")).alias("_z")).select("page", "region", "_last", "_z._l.*", C("_z._c").alias("_no"))
    df = df.withColumn("column", F.when(free, C("_no")).otherwise(0)).withColumn("column_count", F.when(free, C("_last") + 1).otherwise(1))
    column = Window.partitionBy("page", "region", "column")
    df = df.withColumn("position", F.row_number().over(column.orderBy("top", "x0", "box")) - 1).withColumn("column_units", F.count("*").over(column))
    return df.select(*rows, "column", "column_count", "position", "column_units")


def page_units(lines: Column) -> Column:
    """Visual lines of a page as units. Blank lines, rows of cells, stops, headings and bullets part them.

    What a line's own text says is computed before the fold; the fold looks at the unit collected so far only.
    """

    def seen(raw: Column) -> Column:
        cells = F.filter(F.transform(F.split(T.strip(raw), r"[ \t]{4,}"), T.collapsed), lambda x: x != "")
        return F.struct(cells.alias("cells"), F.size(cells).alias("n"), F.get(cells, F.lit(0)).alias("line"))

    def judged(x: Column) -> Column:
        starts = T.heading_like(x["line"]) | T.bullet_like(x["line"])
        return F.struct(x["cells"].alias("cells"), x["n"].alias("n"), x["line"].alias("line"), starts.alias("starts"), x["line"].rlike(r"\A[\p{L}\p{N}]").alias("word"))

    def flush(a: Column) -> Column:
        return F.when(a["held"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["held"])))

    def step(a: Column, x: Column) -> Column:
        held = a["held"]
        parts = (held == "") | (x["n"] != 1) | x["starts"] | T.terminal_line(held) | T.heading_like(held)
        glued = F.when(held.endswith("-") & x["word"], F.concat(F.substr(held, F.lit(1), F.length(held) - 1), x["line"])).otherwise(F.concat(held, F.lit(" "), x["line"]))
        kept = F.struct(glued.alias("held"), a["out"].alias("out"))
        fresh = F.struct(F.when(x["n"] == 1, x["line"]).otherwise("").alias("held"), F.when(x["n"] > 1, F.concat(flush(a), x["cells"])).otherwise(flush(a)).alias("out"))
        return F.when(parts, fresh).otherwise(kept)

    start = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(F.transform(F.transform(lines, seen), judged), start, step, flush)


def merged_rows(tops: Column) -> Column:
    """Row numbers of line boxes sorted by top: a box within 2 of its row's first top joins the row."""
    start = F.struct(F.lit(-1).alias("no"), F.lit(0.0).alias("top"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        new = (a["no"] < 0) | (F.abs(t - a["top"]) > 2.0)
        no = F.when(new, a["no"] + 1).otherwise(a["no"])
        return F.struct(no.alias("no"), F.when(new, t).otherwise(F.least(a["top"], t)).alias("top"), F.concat(a["out"], F.array(no)).alias("out"))

    return F.aggregate(tops, start, step)["out"]


def chars_in_boxes(boxes: DataFrame, chars: DataFrame) -> DataFrame:
    """Range join of characters and boxes of one page, with half a point of tolerance: equal page, then the bounds."""
    inside = (C("cx0") >= C("x0") - 0.5) & (C("cx1") <= C("x1") + 0.5) & (C("ctop") >= C("top") - 0.5) & (C("cbottom") <= C("bottom") + 0.5)
    return boxes.join(chars, "page").where(inside)


def ocr_kept(text: Column, score: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Lines worth keeping of a recognised page."""
    compact = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+", "")
    lone = (F.length(compact) == 1) & compact.rlike(r"\p{L}")
    shape = (right - left >= 2) & (bottom - top >= 2) & (bottom - top <= (right - left) * 1.8)
    return (score >= 0.45) & (compact != "") & ~lone & compact.rlike(r"[A-Za-z\x{3400}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]") & shape


_BLOCK = pa.schema([("page", pa.int64()), ("block", pa.int32()), ("text", pa.string()), ("x0", pa.float64()), ("x1", pa.float64()), ("top", pa.float64()), ("bottom", pa.float64()), ("n", pa.int32())])
_STOP = re.compile(r"[。！？.!?；;：:]\s*[\"'”’」』）)\]]*$")


def ocr_blocks(lines: DataFrame, width: float, height: float) -> DataFrame:
    """Recognised lines in reading order, joined into blocks of one flow.

    Whether a line may join the one before at all (same column, no bullet, no heading) is columns. What is left looks at
    the block that it would join, its lowest edge, its left edge and its last stop, so it is a loop; it runs over sorted
    partitions in one pass, with one open block, instead of one call per page.
    """
    order = Window.partitionBy("page").orderBy("region", "column", "position")
    tall = F.greatest(F.lit(1.0), C("bottom") - C("top"))
    flows = (C("region") == F.lag("region").over(order)) & (C("column") == F.lag("column").over(order))
    joins = F.coalesce(flows, F.lit(False)) & ~T.bullet_like(C("text")) & ~T.heading_like(C("text"))
    df = lines.withColumn("joins", joins).withColumn("reach", F.greatest(tall * 1.35, F.lit(height * 0.012)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: dict | None = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if block and row["page"] == block["page"] and row["joins"] and row["top"] - block["bottom"] <= row["reach"] and abs(row["x0"] - block["x0"]) <= width * 0.06 and not _STOP.search(block["text"]):
                    held, text = block["text"], row["text"]
                    block["text"] = held[:-1] + text if held.endswith("-") and text[:1].isalnum() else f"{held} {text}"
                    block |= {k: f(block[k], row[k]) for k, f in (("x0", min), ("x1", max), ("top", min), ("bottom", max))} | {"n": block["n"] + 1}
                    continue
                number = block["block"] + 1 if block and block["page"] == row["page"] else 0
                if block:
                    done.append(block)
                block = {k: row[k] for k in ("page", "text", "x0", "x1", "top", "bottom")} | {"block": number, "n": 1}
            yield pa.RecordBatch.from_pylist(done, schema=_BLOCK)
        yield pa.RecordBatch.from_pylist([block] if block else [], schema=_BLOCK)

    ordered = df.repartition("page").sortWithinPartitions("page", "region", "column", "position")
    return ordered.select("page", "joins", "reach", "text", "x0", "x1", "top", "bottom").mapInArrow(run, "page long, block int, text string, x0 double, x1 double, top double, bottom double, n int")


def first_replaced(text: Column, pattern: str, new: str) -> Column:
    """text with the first match of pattern replaced."""
    return F.regexp_replace(text, rf"(?s)\A(.*?){pattern}", "$1" + new.replace("$2", "$3").replace("$1", "$2"))


def spacing_choice(laid: DataFrame, plain: DataFrame, page: str, order: str) -> DataFrame:
    """(page, n, same, choice) of two extractions (page, order, laid) and (page, order, plain): plain if it has as many units,
    of the same signs, with fewer blanks. Units meet by position; a page that only one side has stays as it is."""
    blanks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    bare = lambda c: F.regexp_replace(c, rf"(?U){T.WS}+", "")
    both = laid.join(plain, [page, order], "full").groupBy(page).agg(
        F.count("laid").alias("n"), F.count("plain").alias("m"), F.bool_and(bare(C("laid")) == bare(C("plain"))).alias("equal"), F.sum(blanks(C("laid"))).alias("a"), F.sum(blanks(C("plain"))).alias("b")
    )
    same = (C("n") == C("m")) & F.coalesce("equal", F.lit(True))
    return both.select(page, "n", same.alias("same"), F.when(same & (C("b") < C("a")), "plain").otherwise("layout").alias("choice"))


def fragment_map(units: DataFrame, fragments: DataFrame) -> DataFrame:
    """(doc_id, line_no, mapped, fragments): fragments (doc_id, line_no, i, key) of each unit (doc_id, line_no, key), in order.

    A page is mapped if its fragments spell exactly its units and every unit ends with a fragment; otherwise none of its
    units is. Both sides become running lengths, so that a unit's end is an equality.
    """
    stops = Window.partitionBy("doc_id").orderBy("line_no", "i")
    spelled = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "i", "key"))), lambda x: x["key"]), "")
    f = fragments.withColumn("stop", F.sum(F.length("key")).over(stops)).withColumn("k", F.row_number().over(stops))
    u = units.withColumn("stop", F.sum(F.length("key")).over(Window.partitionBy("doc_id").orderBy("line_no")))
    ends = f.groupBy("doc_id", "stop").agg(F.max("k").alias("k"))
    text = fragments.groupBy("doc_id").agg(F.sha2(spelled, 256).alias("digest"))
    own = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "key"))), lambda x: x["key"]), "")
    pages = u.groupBy("doc_id").agg(F.sha2(own, 256).alias("own")).join(text, "doc_id", "left").select("doc_id", F.coalesce(C("own") == C("digest"), F.lit(False)).alias("spelled"))
    met = u.join(ends, ["doc_id", "stop"], "left")
    page = Window.partitionBy("doc_id")
    met = met.join(pages, "doc_id").withColumn("mapped", C("spelled") & (F.count("k").over(page) == F.count("*").over(page)))
    n = C("k") - F.coalesce(F.lag("k").over(page.orderBy("line_no")), F.lit(0))
    return met.select("doc_id", "line_no", "mapped", F.when(C("mapped"), n).cast("long").alias("fragments"))


def positional(rows: DataFrame, boxes: DataFrame, page: str, order: str) -> DataFrame:
    """Rows and boxes (page, order, …) of a page side by side by their order, and only where both have as many."""
    counts = rows.groupBy(page).agg(F.count("*").alias("_n")).join(boxes.groupBy(page).agg(F.count("*").alias("_m")), page).where("_n = _m").select(page)
    return rows.join(boxes, [page, order]).join(counts, page, "left_semi")
