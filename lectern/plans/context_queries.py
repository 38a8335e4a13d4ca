"""Queries over contexts, reference windows, prompts and the whole pipeline, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context as X
from ..operators import pipeline as P
from ..operators import units as U
from ..sources.tables import document_lines, file_lines, files, lines, table, texts
from . import sql as S
from .text_queries import _CORE, _DETECT, _OPEN

QUERIES: dict = {}
SQL: dict = {}
C = F.col
#: A small model window, so that the budgets bind.
SIZE = 2048


def query(statement: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if statement:
            SQL[f.__name__] = statement
        return f

    return add


def _units(spark: SparkSession, d: str) -> DataFrame:
    """Translatable units of files: (file_id, line_no, line, position, text)."""
    return U.translatable(U.document_units(file_lines(spark, d))).select("file_id", "line_no", "line", "position", "unit.text")


_T = S.UNITS + ", t AS (SELECT file_id, line_no, line, text, row_number() OVER (PARTITION BY file_id ORDER BY line_no) - 1 AS position FROM u WHERE translate)"
_CAP_BEFORE, _CAP_AFTER = T.context_caps(SIZE)
_B = "'[原文]' || chr(10) || {x} || chr(10) || '[译文]' || chr(10) || '译：' || {x}"
_BEFORE = f"""b AS (SELECT *, {_B.format(x="t1")} AS b1, {_B.format(x="t2")} AS b2, lag(1, 1) OVER w AS h1, lag(1, 2) OVER w AS h2
        FROM (SELECT *, lag(text, 1) OVER w AS t1, lag(text, 2) OVER w AS t2 FROM t WINDOW w AS (PARTITION BY file_id ORDER BY line_no)) WINDOW w AS (PARTITION BY file_id ORDER BY line_no)),
    cb AS (SELECT *, CASE WHEN b1 IS NULL OR {S.tokens("b1")} > {_CAP_BEFORE} THEN '' WHEN b2 IS NULL OR {S.tokens("b1")} + {S.tokens("b2")} > {_CAP_BEFORE} THEN b1
        ELSE b2 || chr(10) || chr(10) || b1 END AS context_before FROM b)"""
_AFTER = f"""a AS (SELECT *, {S.strip("lead(text, 1) OVER w")} AS n1, {S.strip("lead(text, 2) OVER w")} AS n2 FROM cb WINDOW w AS (PARTITION BY file_id ORDER BY line_no)),
    ca AS (SELECT *, CASE WHEN n1 IS NULL OR {S.tokens("n1")} > {_CAP_AFTER} THEN '' WHEN n2 IS NULL OR {S.tokens("n1")} + {S.tokens("n2")} > {_CAP_AFTER} THEN n1
        ELSE n1 || chr(10) || chr(10) || n2 END AS context_after FROM a)"""


@query(f"WITH {_T}, {_BEFORE} SELECT file_id, line_no, context_before FROM cb")
def q_context_before(spark: SparkSession, d: str) -> DataFrame:
    return X.with_context(_units(spark, d), "file_id", SIZE).select("file_id", "line_no", "context_before")


_NEXT = f"""nx AS (SELECT *, {S.strip("lead(unit, 1) OVER w")} AS n1, {S.strip("lead(unit, 2) OVER w")} AS n2 FROM pc WINDOW w AS (PARTITION BY file_id ORDER BY line_no, piece))"""


@query(f"""WITH RECURSIVE {_T}, {S.pieces("t", "file_id, line_no", T.unit_limit(SIZE))}, {_NEXT}
    SELECT file_id, line_no, piece, CASE WHEN n1 IS NULL OR {S.tokens("n1")} > {_CAP_AFTER} THEN '' WHEN n2 IS NULL OR {S.tokens("n1")} + {S.tokens("n2")} > {_CAP_AFTER} THEN n1 ELSE n1 || chr(10) || chr(10) || n2 END AS context_after FROM nx""")
def q_context_after(spark: SparkSession, d: str) -> DataFrame:
    """What follows every request, piece by piece."""
    df = X.semantic_units(_units(spark, d).select("file_id", "line_no", "text"), "text", SIZE)
    return X.with_future(df.select("file_id", "line_no", F.posexplode("pieces").alias("piece", "unit")), "file_id", SIZE).select("file_id", "line_no", "piece", "context_after")


_EDGE = rf"coalesce(line_no - lag(line_no) OVER (PARTITION BY file_id ORDER BY line_no) > 1, true) OR regexp_matches(line, '^{S.WS}{{0,3}}#{{1,6}}[ \t]+')"


@query(f"WITH {_T} SELECT file_id, line_no, {_EDGE} AS boundary FROM t")
def q_boundary(spark: SparkSession, d: str) -> DataFrame:
    return X.boundaries(_units(spark, d), "file_id").select("file_id", "line_no", "boundary")


@query(f"""WITH {_T}, g AS (SELECT *, CASE WHEN line_no - lag(line_no) OVER (PARTITION BY file_id ORDER BY line_no) > 1 THEN chr(10) || line ELSE line END AS x FROM t)
    SELECT file_id, sha256({S.strip("x")}) AS digest FROM (SELECT file_id, string_agg(x, chr(10) ORDER BY line_no) AS x FROM g GROUP BY ALL)""")
def q_excerpt(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return _units(spark, d).groupBy("file_id").agg(pairs.alias("p")).select("file_id", F.sha2(X.excerpt(C("p")), 256).alias("digest"))


_FIXED = len(X.BASE_PROMPT)


def _fixed() -> int:
    style = "【风格偏好（自动判断）】\n" + X.STYLES["自动判断"]
    return X.tokens_of(X.BASE_PROMPT + "\n\n" + style) + 512


_SAFETY = max(256, min(4096, int(SIZE * 0.06)))
_PIECES = S.pieces("t", "file_id, line_no", T.unit_limit(SIZE))


@query(f"""WITH RECURSIVE {_T}, {_PIECES}, n AS (SELECT file_id, max({S.tokens("unit")}) AS n FROM pc GROUP BY ALL)
    SELECT file_id, greatest(0, {SIZE - _fixed() - _CAP_BEFORE - _SAFETY} - n - greatest(256, trunc(n * 1.5::DOUBLE)::INT + 256)) AS budget FROM n""")
def q_reference_budget(spark: SparkSession, d: str) -> DataFrame:
    """Every file with words, its long lines by their pieces."""
    return X.reference_budget(_units(spark, d), "file_id", SIZE)


_CORE_BUDGET = 200


@query(f"""WITH {_T}, k AS (SELECT file_id, sum({S.tokens("text")})::BIGINT AS estimate, any_value(ext) AS ext FROM t JOIN nf USING (file_id) GROUP BY file_id)
    SELECT file_id, CASE WHEN estimate <= {_CORE_BUDGET} THEN '全文原文参考' ELSE '当前语义窗口参考' END AS kind, ext IN ('.srt', '.vtt') AS excerpted FROM k""")
def q_reference_kind(spark: SparkSession, d: str) -> DataFrame:
    units = U.translatable(U.document_units(file_lines(spark, d))).select("file_id", "ext", "unit.text")
    df = units.groupBy("file_id").agg(F.sum(T.tokens(C("text"))).alias("n"), F.max("ext").alias("ext"))
    return df.select("file_id", F.when(C("n") <= _CORE_BUDGET, "全文原文参考").otherwise("当前语义窗口参考").alias("kind"), C("ext").isin(U.SUBTITLES).alias("excerpted"))


@query(f"""WITH RECURSIVE {_T}, e AS (SELECT file_id, position, {S.tokens("line")} + 2 AS cost, {_EDGE} AS edge FROM t),
    c AS (SELECT file_id, position, edge, sum(cost) OVER (PARTITION BY file_id ORDER BY position)::BIGINT AS total, count(*) OVER (PARTITION BY file_id) AS n FROM e),
    a AS (SELECT file_id, list(total ORDER BY position) AS total, list(edge ORDER BY position) AS edge, any_value(n) AS n FROM c GROUP BY file_id),
    r AS (SELECT file_id, total, edge, n, 0::BIGINT AS window_no, NULL::BIGINT AS first, 0::BIGINT AS last FROM a
          UNION ALL
          SELECT file_id, total, edge, n, window_no + 1, last, CASE WHEN stop < n AND back IS NOT NULL AND back - last >= greatest(1, (stop - last) // 3) THEN back ELSE stop END
          FROM (SELECT *, list_max(list_filter(generate_series(last + 1, stop), lambda i: i >= n OR edge[i + 1])) AS back
                FROM (SELECT *, last + greatest(1, len(list_filter(total[last + 1:n], lambda x: x - (CASE WHEN last = 0 THEN 0 ELSE total[last] END) <= {_CORE_BUDGET}))) AS stop FROM r WHERE last < n)))
    SELECT file_id, window_no - 1 AS window_no, first, last FROM r WHERE window_no > 0""")
def q_reference_windows(spark: SparkSession, d: str) -> DataFrame:
    units = X.boundaries(_units(spark, d), "file_id").select("file_id", "position", (T.tokens(C("line")) + 2).alias("cost"), "boundary")
    docs = units.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("position", "cost", "boundary"))).alias("u"))
    made = X.windows(F.transform("u", lambda x: x["cost"]), F.transform("u", lambda x: x["boundary"]), _CORE_BUDGET)
    return docs.select("file_id", F.posexplode(made).alias("window_no", "w")).select("file_id", C("window_no").cast("long").alias("window_no"), C("w.first").cast("long").alias("first"), C("w.last").cast("long").alias("last"))


@query()
def q_reference_plan(spark: SparkSession, d: str) -> DataFrame:
    """Each window with its overlap of two units on both sides, cut to the budget: one excerpt shared by its positions."""
    units = X.boundaries(_units(spark, d), "file_id")
    docs = units.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("position", (T.tokens(C("line")) + 2).alias("cost"), "boundary", "line_no", "line"))).alias("u"))
    made = X.windows(F.transform("u", lambda x: x["cost"]), F.transform("u", lambda x: x["boundary"]), _CORE_BUDGET)
    w = docs.select("file_id", "u", F.posexplode(made).alias("window_no", "w"))
    return w.select("file_id", "window_no", "w.first", "w.last", X.trimmed(C("u"), C("w.first"), C("w.last"), 2, 2, int(_CORE_BUDGET / 0.68)).alias("reference"))


@query(f"""SELECT style, extra, '{X.BASE_PROMPT}' || chr(10) || chr(10) || CASE WHEN extra <> '' THEN '【用户补充要求】' || chr(10) || extra || chr(10) || chr(10) ELSE '' END
    || '【风格偏好（' || style || '）】' || chr(10) || CASE style {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.STYLES.items())} ELSE '{X.STYLES["自动判断"]}' END AS prompt
    FROM (SELECT DISTINCT kind AS style, {S.strip("status")} AS extra FROM jobs UNION ALL SELECT unnest([{", ".join(f"'{k}'" for k in X.STYLES)}]), '')""")
def q_system_prompt(spark: SparkSession, d: str) -> DataFrame:
    """Job kinds stand in as unknown styles and states as additions, besides all known styles."""
    df = table(spark, d, "jobs").select(C("kind").alias("style"), T.strip(C("status")).alias("extra")).distinct()
    df = df.unionByName(spark.createDataFrame([(k, "") for k in X.STYLES], "style string, extra string"))
    return df.select("style", "extra", X.system_prompt(C("extra"), C("style")).alias("prompt"))


_MODE = rf"""m AS (SELECT *, CASE WHEN p <> '' AND c <> '' AND NOT regexp_matches(regexp_replace(p, {_CORE}, ''), '[.!?。！？…]$')
        AND (regexp_matches(regexp_replace(c, {_OPEN}, ''), '^[a-zà-öø-ÿ]') OR regexp_matches(p, '[-–—,;]$')) THEN 'possible' ELSE '' END AS mode
    FROM (SELECT *, {S.strip("coalesce(lag(text) OVER (PARTITION BY file_id ORDER BY line_no), '')")} AS p, {S.lstrip("text")} AS c FROM ca))"""
_NL2 = "chr(10) || chr(10)"
_PROMPT = f"""pr AS (SELECT m.file_id, line_no, mode, CASE WHEN context_before = '' AND context_after = '' THEN '{X.ALONE}' ELSE '{X.BESIDE}' ||
        concat_ws({_NL2}, CASE WHEN context_before <> '' THEN '{X.BEFORE}' || context_before END, CASE WHEN context_after <> '' THEN '{X.AFTER}' || context_after END) END
        || CASE WHEN mode = 'possible' THEN {_NL2} || '{X.POSSIBLE}' ELSE '' END || {_NL2} || '【当前待译文本（' || {_DETECT.format(x="text")} || ' → ' || target_language || '）】' || chr(10) || text AS prompt
    FROM m JOIN f ON m.file_id = f.file_id)"""


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    units = X.with_context(_units(spark, d), "file_id", SIZE).withColumn("previous", F.lag("text").over(Window.partitionBy("file_id").orderBy("line_no")))
    units = units.withColumn("mode", T.may_continue(C("previous"), C("text"))).join(files(spark, d, "target_language"), "file_id")
    return units.withColumn("prompt", X.prompt(C("text"), C("context_before"), C("context_after"), C("mode"), T.detected_language(C("text")), C("target_language")))


@query(f"WITH {_T}, {_BEFORE}, {_AFTER}, {_MODE}, {_PROMPT} SELECT file_id, line_no, mode, sha256(prompt) AS digest, length(prompt) AS n FROM pr")
def q_prompt(spark: SparkSession, d: str) -> DataFrame:
    return _prompts(spark, d).select("file_id", "line_no", "mode", F.sha2("prompt", 256).alias("digest"), F.length("prompt").alias("n"))


_NOTES = [("", ""), ("possible", X.POSSIBLE), ("strong", X.STRONG)]
_FORMS = ["once", "again", "again_old"]


def _sql_form(form: str) -> str:
    fixed = "CASE WHEN context_before <> '' THEN '【固定全文原文参考（只供理解，禁止翻译或输出）】' || chr(10) || line || chr(10) || '【固定全文原文参考结束】' END"
    around = f"concat_ws({_NL2}, {fixed}, CASE WHEN context_before <> '' THEN '{X.BEFORE}' || context_before END, CASE WHEN context_after <> '' THEN '{X.AFTER}' || context_after END)"
    if form == "once":
        return f"CASE WHEN {around} = '' THEN '{X.ALONE}' ELSE '{X.BESIDE}' || {around} END"
    wish, old = (X.AGAIN_OLD, f"{_NL2} || '{X.OLD}' || '旧：' || text") if form == "again_old" else (X.AGAIN_NEW, "''")
    return f"'{X.AGAIN}{wish}{X.AGAIN_ONLY}' || CASE WHEN {around} = '' THEN '' ELSE {around} || {_NL2} END || {old}"


@query(f"""WITH {_T}, {_BEFORE}, {_AFTER}, fo AS (SELECT ca.*, target_language FROM ca JOIN f ON ca.file_id = f.file_id),
    pf AS ({" UNION ALL ".join(f"SELECT file_id, line_no, '{form}' AS form, '{mode}' AS mode, {_sql_form(form)} || {_NL2 + " || '" + note + "' || " if note else ""}{_NL2} || '【当前待译文本（' || {_DETECT.format(x='text')} || ' → ' || target_language || '）】' || chr(10) || text AS prompt FROM fo" for form in _FORMS for mode, note in _NOTES)})
    SELECT file_id, line_no, form, mode, sha256(prompt) AS digest FROM pf""")
def q_prompt_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every unit's request in all nine forms: once, anew and anew with its old text, each with every note; the fixed
    reference (here the line) stands where something comes before."""
    units = X.with_context(_units(spark, d), "file_id", SIZE).join(files(spark, d, "target_language"), "file_id")
    units = units.withColumn("form", F.explode(F.array(*map(F.lit, _FORMS)))).withColumn("mode", F.explode(F.array(*(F.lit(m) for m, _ in _NOTES))))
    reference = F.when(C("context_before") != "", C("line")).otherwise("")
    old = F.when(C("form") == "again_old", F.concat(F.lit("旧："), "text")).otherwise("")
    made = X.prompt(C("text"), C("context_before"), C("context_after"), C("mode"), T.detected_language(C("text")), C("target_language"), reference, F.lit("全文原文参考"), C("form") != "once", old)
    return units.select("file_id", "line_no", "form", "mode", F.sha2(made, 256).alias("digest"))


@query(f"""WITH {_T}, {_BEFORE}, {_AFTER}, e AS (SELECT file_id, line_no, {S.tokens("text")} + {S.tokens("context_before")} + {S.tokens("context_after")} + 1 + {_fixed() - 512} + 1 + 384 AS est, {S.tokens("text")} AS n FROM ca)
    SELECT file_id, line_no, est, {SIZE} - est - 96 AS available, {SIZE} - est - 96 >= 256 AS feasible,
        CASE WHEN {SIZE} - est - 96 >= 256 THEN least({SIZE} - est - 96, least(80000, greatest(384, trunc(n * 2.25::DOUBLE)::INT + 384))) END AS max_tokens FROM e""")
def q_request_budget(spark: SparkSession, d: str) -> DataFrame:
    df = X.with_context(_units(spark, d), "file_id", SIZE)
    est = T.tokens(C("text")) + T.tokens(C("context_before")) + T.tokens(C("context_after")) + (1 + _fixed() - 512 + 1 + 384)
    df = df.select("file_id", "line_no", est.alias("est"), T.output_budget(C("text")).alias("budget")).withColumn("available", SIZE - C("est") - 96)
    return df.select("file_id", "line_no", "est", "available", (C("available") >= 256).alias("feasible"), F.when(C("available") >= 256, F.least("available", "budget")).alias("max_tokens"))


@query(f"WITH RECURSIVE {_T}, {_PIECES} SELECT file_id, line_no, piece, unit FROM pc")
def q_semantic_units(spark: SparkSession, d: str) -> DataFrame:
    """Lines as requests; lines above the limit are cut into sentences."""
    df = X.semantic_units(_units(spark, d).select("file_id", "line_no", "text"), "text", SIZE)
    return df.select("file_id", "line_no", F.posexplode("pieces").alias("piece", "unit"))


@query(f"WITH {_T} SELECT file_id, line_no, position, '译：' || text AS translated FROM t")
def q_translate_stub(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).select("file_id", "line_no", "position", U.stub(C("text")).alias("translated"))


_DU = f"""dx AS (SELECT doc_id, line_no, line, regexp_extract(line, {S.PLAIN}, 1) AS prefix, regexp_extract(line, {S.PLAIN}, 2) AS text, regexp_extract(line, {S.PLAIN}, 3) AS suffix FROM dl)"""


@query(f"""WITH {S.DOCS}, {_DU} SELECT doc_id, count_if(text <> '')::BIGINT AS n_units, sha256(string_agg(CASE WHEN text <> '' THEN prefix || '译：' || text || suffix ELSE line END, chr(10) ORDER BY line_no)) AS out_digest
    FROM dx GROUP BY doc_id""")
def q_translate_document(spark: SparkSession, d: str) -> DataFrame:
    """Plain documents through the pipeline: units, stub, reassembly."""
    units = U.translated(document_lines(spark, d).withColumn("unit", T.plain_unit(C("line"))), "doc_id")
    pairs = F.sort_array(F.collect_list(F.struct("line_no", "out")))
    out = units.groupBy("doc_id").agg(F.count_if("unit.translate").alias("n_units"), F.array_join(F.transform(pairs, lambda p: p["out"]), "\n").alias("out"))
    return out.select("doc_id", "n_units", F.sha2("out", 256).alias("out_digest"))


@query(f"""WITH {S.UNITS} SELECT file_id, count_if(translate)::BIGINT AS n_units, sha256(string_agg(CASE WHEN translate THEN prefix || '译：' || text || suffix ELSE line END, chr(10) ORDER BY line_no)) AS out_digest FROM u GROUP BY file_id""")
def q_translate_file(spark: SparkSession, d: str) -> DataFrame:
    """Files of every format through the pipeline."""
    units = U.translated(U.document_units(file_lines(spark, d)))
    pairs = F.sort_array(F.collect_list(F.struct("line_no", "out")))
    out = units.groupBy("file_id").agg(F.count_if("unit.translate").alias("n_units"), F.array_join(F.transform(pairs, lambda p: p["out"]), "\n").alias("out"))
    return out.select("file_id", "n_units", F.sha2("out", 256).alias("out_digest"))


@query(f"""WITH RECURSIVE {_T}, {S.pieces("t", "file_id, line_no", T.unit_limit(65536))},
    j AS (SELECT file_id, line_no, string_agg({S.rstrip("'译：' || unit")}, '' ORDER BY piece) AS body FROM pc GROUP BY ALL)
    SELECT u.file_id, u.line_no, CASE WHEN {S.strip("coalesce(r.text, '')")} <> '' THEN r.text ELSE prefix || body || suffix END AS out, {S.strip("coalesce(r.text, '')")} <> '' AS resumed
    FROM u JOIN j USING (file_id, line_no) LEFT JOIN resume_lines r ON r.file_id = u.file_id AND r.line_no = u.line_no WHERE translate""")
def q_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Files through the pluggable pipeline with the stub as model, replaying checkpoints; a long line piece by piece."""
    units = U.document_units(file_lines(spark, d))
    out = P.translate_units(units, P.stub_model, resume=table(spark, d, "resume_lines"))
    return out.select("file_id", "line_no", "out", "resumed")
