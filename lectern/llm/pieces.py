"""Problem 3: splitting oversized items at natural boundaries.

Method: one regular expression with bounded quantifiers consumes the text on the JVM. Its alternatives are ordered by
boundary strength (blank line, line end, sentence end, white space) over the upper half of a piece; then comes the last
boundary of any strength in the lower half, and at the end plain characters; none can run beyond the limit. A run consumes capacity - overlap
characters at most; the pieces get their overlap by array functions that look back from each run's start, so consecutive
pieces share exactly `overlap` characters (all of the first, if it is shorter) and no piece is longer than `capacity`.

Everything is an expression of one row: no shuffle of texts, no Python, linear time in the text's length (a failed
alternative looks at one piece only; running sums are taken in blocks). Rows delivered twice are made distinct by the
queries before they are cut.

Every piece also tells its item's longest stretch without a boundary among those that a cut goes through (0 if no cut
does): the pieces before a hard cut end inside it, the piece after it begins inside it, so a fold over the pieces adds it
up. An item must be cut hard if and only if that stretch exceeds the capacity.

Defined results: an item within the limit is one piece; null and empty texts have none; characters are code points, so
no pair of surrogates is cut; overlap must be smaller than capacity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import normal_column, table

#: White space as the rest of the engine sees it, and the signs that end sentences.
SPACE = r"\s\x1c-\x1f\x85  "
STOPS = ".!?…。！？"
_CLOSERS = "\"'”’»›」』）)\\]"


def pattern(most: int) -> str:
    """Alternatives by strength over 1..most characters. (?<=...) looks at the end of what the greedy part took."""
    half = max(1, most // 2)
    ends = [r"(?<=\n[ \t]{0,8}\n)", r"(?<=\n)", rf"(?<=[{STOPS}][{_CLOSERS}]{{0,3}})(?![{STOPS}{_CLOSERS}])", rf"(?<=[{SPACE}])"]
    upper = "|".join(f".{{{half},{most}}}{e}" for e in ends)
    lower = f".{{1,{half}}}(?:{'|'.join(ends)})"
    return f"(?sU)(?:.{{1,{most}}}\\z|{upper}|{lower}|.{{1,{most}}})"


def runs(text: Column, capacity: int, overlap: int) -> Column:
    """The text cut into consecutive runs of at most capacity - overlap characters; joined they give the text again."""
    return F.regexp_extract_all(text, F.lit(pattern(capacity - overlap)), F.lit(0))


#: Runs whose lengths are summed at once.
BLOCK = 512


def running(lengths: str) -> str:
    """SQL of 0 and the running sums of an array of lengths, block by block, so that no long array is copied per step."""
    sums = "aggregate({}, cast(array(0L) as array<bigint>), (a, n) -> concat(a, array(element_at(a, -1) + n)))"
    blocks = f"transform(sequence(0, (size({lengths}) - 1) div {BLOCK}), b -> {sums.format(f'slice({lengths}, b * {BLOCK} + 1, {BLOCK})')})"
    offsets = sums.format("transform(_blocks, b -> element_at(b, -1))")
    joined = f"concat(array(0L), flatten(transform(_blocks, (b, i) -> transform(slice(b, 2, {BLOCK}), n -> n + _offsets[i]))))"
    return f"element_at(transform(array({blocks}), _blocks -> element_at(transform(array({offsets}), _offsets -> {joined}), 1)), 1)"


def pieces(df: DataFrame, key: str, text: str, capacity: int, overlap: int) -> DataFrame:
    """(key, piece, start_char, end_char, cut, stretch, piece_text), one row per piece; cut tells how the piece ends."""
    if not 0 <= overlap < capacity:
        raise ValueError("the overlap must be smaller than the capacity")
    whole = F.when(F.length("_text") <= capacity, F.array("_text")).otherwise(runs(F.col("_text"), capacity, overlap))
    out = df.select(F.col(key).alias("_key"), normal_column(F.col(text)).alias("_text")).where("length(_text) > 0").withColumn("_runs", whole)
    out = out.withColumn("_lengths", F.transform("_runs", lambda r: F.length(r))).withColumn("_ends", F.expr(running("_lengths")))
    # The open stretch at the end of each run, and the longest that went over an end.
    solid, lead, trail = (f"(?sU){x}" for x in (rf"\A[^{SPACE}{STOPS}]*+\z", rf"\A[^{SPACE}{STOPS}]*+", rf"[^{SPACE}{STOPS}]*+\z"))

    def step(a, r):
        first = a["open"] + F.length(F.regexp_extract(r, lead, 0))
        left = F.when(r.rlike(solid), a["open"] + F.length(r)).otherwise(F.length(F.regexp_extract(r, trail, 0)))
        return F.struct(left.alias("open"), F.when((a["open"] > 0) & (F.length(F.regexp_extract(r, lead, 0)) > 0), F.greatest(a["best"], first)).otherwise(a["best"]).alias("best"))

    fold = F.aggregate("_runs", F.struct(F.lit(0).alias("open"), F.lit(0).alias("best")), step, lambda a: a["best"])
    out = out.withColumn("_stretch", F.when(F.size("_runs") > 1, fold).otherwise(F.lit(0)))
    # The look-back comes from the two runs before, which nearly always hold it; else from the text itself.
    near = f"right(concat(coalesce(get(_runs, i - 2), ''), coalesce(get(_runs, i - 1), '')), {overlap})"
    back = f"if(i > 2 and length(_runs[i - 1]) + length(_runs[i - 2]) < {overlap}, substring(_text, cast(greatest(0, _ends[i] - {overlap}) + 1 as int), cast(least({overlap}, _ends[i]) as int)), {near})"
    each = f"transform(_runs, (r, i) -> struct(i as piece, if(i = 0, 0L, greatest(0L, _ends[i] - {overlap})) as start_char, _ends[i + 1] as end_char, i = size(_runs) - 1 as last, r as run, if(i = 0, r, concat({back}, r)) as piece_text))"
    out = out.select("_key", F.col("_stretch").alias("stretch"), F.explode(F.expr(each)).alias("p")).select("_key", "stretch", "p.*")
    cut = (
        F.when(F.col("last"), "end")
        .when(F.col("run").rlike(r"\n[ \t]{0,8}\n\z"), "paragraph")
        .when(F.col("run").rlike(r"\n\z"), "line")
        .when(F.col("run").rlike(rf"(?U)[{STOPS}][{_CLOSERS}]{{0,3}}\z"), "sentence")
        .when(F.col("run").rlike(rf"(?U)[{SPACE}]\z"), "word")
        .otherwise("hard")
    )
    return out.select(F.col("_key").alias(key), "piece", "start_char", "end_char", cut.alias("cut"), "stretch", "piece_text")


def limits(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    row = table(spark, sf_dir, "size_limits").where("item = 'piece'").select("capacity", "overlap").first()
    return row.capacity, row.overlap or 0


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all files; files delivered again count once."""
    capacity, overlap = limits(spark, sf_dir)
    return pieces(table(spark, sf_dir, "files").select("file_id", "content").distinct(), "file_id", "content", capacity, overlap)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files above the limit: hard_cut if their pieces were cut inside a stretch longer than a piece, else cut."""
    capacity, overlap = limits(spark, sf_dir)
    # Which deliveries are equal shows in the result, so no text is moved to make them distinct.
    cut = pieces(table(spark, sf_dir, "files").select("file_id", "content"), "file_id", "content", capacity, overlap)
    need = F.when((F.col("cut") == "hard") & (F.col("stretch") > capacity), "hard_cut").otherwise("cut")
    rows = cut.where("cut <> 'end' or piece > 0").groupBy("file_id").agg(F.max(need).alias("need"))
    return rows
