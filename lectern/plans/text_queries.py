"""Queries over texts, lines and units, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fitting import background, fit_box, line_direction
from ..operators import units as U
from ..sources.tables import balanced, document_lines, file_lines, files, table, texts
from . import sql as S

QUERIES: dict = {}
SQL: dict = {}


def query(statement: str | None = None):
    """Registers a query under its name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if statement:
            SQL[f.__name__] = statement
        return f

    return add


C = F.col


@query(rf"""
    WITH {S.FILES},
    v AS (SELECT file_id, t, content, (length(content) - length(replace(content, '\r\n', ''))) // 2 AS crlf, replace(content, '\r\n', '') AS rest
          FROM (SELECT file_id, t, coalesce(content, '') AS content FROM nf)),
    c AS (SELECT *, length(rest) - length(replace(rest, '\r', '')) AS cr, length(rest) - length(replace(rest, '\n', '')) AS lf FROM v)
    SELECT file_id, CASE WHEN crlf > 0 AND crlf >= greatest(cr, lf) THEN 'crlf' WHEN cr > lf THEN 'cr' ELSE 'lf' END AS eol,
           starts_with(content, '﻿') AS bom, length(t) AS n_chars, sha256(t) AS digest FROM c
""".replace(r"'\r\n'", "chr(13) || chr(10)").replace(r"'\r'", "chr(13)").replace(r"'\n'", "chr(10)").replace(r"'﻿'", "chr(65279)"))  # fmt: skip
def q_text_normalize(spark: SparkSession, d: str) -> DataFrame:
    df = texts(spark, d)
    return df.select("file_id", T.line_ending(C("content")).alias("eol"), F.coalesce(C("content"), F.lit("")).startswith("﻿").alias("bom"), F.length("t").alias("n_chars"), F.sha2("t", 256).alias("digest"))


@query(f"""
    WITH {S.FILES}
    SELECT file_id, sha256(CASE WHEN coalesce(text_bom, false) THEN chr(65279) ELSE '' END
        || replace(t, chr(10), CASE text_eol WHEN 'crlf' THEN chr(13) || chr(10) WHEN 'cr' THEN chr(13) ELSE chr(10) END)) AS output_sha256 FROM nf
""")  # fmt: skip
def q_text_encode(spark: SparkSession, d: str) -> DataFrame:
    df = files(spark, d, "content", "text_eol", "text_bom")
    return df.select("file_id", F.sha2(F.encode(T.encoded(C("content"), C("text_eol"), C("text_bom")), "UTF-8"), 256).alias("output_sha256"))


@query(f"WITH {S.FILES} SELECT file_id, source_sha256, sha256(t) AS digest, coalesce(source_sha256 = sha256(t), false) AS same FROM nf")
def q_text_digest(spark: SparkSession, d: str) -> DataFrame:
    df = files(spark, d, "content", "source_sha256").withColumn("digest", F.sha2(T.normalized(C("content")), 256))
    return df.select("file_id", "source_sha256", "digest", F.coalesce(C("source_sha256") == C("digest"), F.lit(False)).alias("same"))


@query(f"WITH {S.LINES} SELECT file_id, line_no, line FROM l")
def q_lines(spark: SparkSession, d: str) -> DataFrame:
    return file_lines(spark, d).select("file_id", "line_no", "line")


@query(f"""
    WITH {S.DOCS}
    SELECT doc_id, line_no, regexp_extract(line, {S.PLAIN}, 2) <> '' AS translate, regexp_extract(line, {S.PLAIN}, 1) AS prefix,
           regexp_extract(line, {S.PLAIN}, 2) AS text, regexp_extract(line, {S.PLAIN}, 3) AS suffix FROM dl
""")
def q_plain_units(spark: SparkSession, d: str) -> DataFrame:
    return document_lines(spark, d).withColumn("u", T.plain_unit(C("line"))).select("doc_id", "line_no", "u.*")


@query(f"WITH {S.LINES}, {S.FENCED} SELECT file_id, line_no, is_fence, in_fence FROM fe")
def q_fence_state(spark: SparkSession, d: str) -> DataFrame:
    return U.fence_state(file_lines(spark, d)).select("file_id", "line_no", "is_fence", "in_fence")


@query(f"""WITH {S.LINES}, {S.MARKDOWN} SELECT file_id, line_no, translate, CASE WHEN translate THEN prefix END AS prefix,
    CASE WHEN translate THEN text END AS text, CASE WHEN translate THEN suffix END AS suffix FROM md""")
def q_markdown_units(spark: SparkSession, d: str) -> DataFrame:
    lines = file_lines(spark, d).where(~C("ext").isin(U.BINARY + U.SUBTITLES))
    return U.markdown_units(lines).select("file_id", "line_no", "unit.*")


@query(f"WITH {S.LINES}, {S.SUBTITLE} SELECT file_id, line_no, header FROM su4 WHERE ext = '.vtt'")
def q_vtt_header(spark: SparkSession, d: str) -> DataFrame:
    return U.subtitle_locks(file_lines(spark, d).where(C("ext") == ".vtt")).select("file_id", "line_no", "header")


@query(f"WITH {S.LINES}, {S.SUBTITLE} SELECT file_id, line_no, block FROM su4 WHERE ext = '.vtt'")
def q_vtt_blocks(spark: SparkSession, d: str) -> DataFrame:
    return U.subtitle_locks(file_lines(spark, d).where(C("ext") == ".vtt")).select("file_id", "line_no", "block")


@query(f"WITH {S.LINES}, {S.SUBTITLE} SELECT file_id, line_no, timing, cue FROM su4")
def q_cue_lock(spark: SparkSession, d: str) -> DataFrame:
    return U.subtitle_locks(file_lines(spark, d).where(C("ext").isin(U.SUBTITLES))).select("file_id", "line_no", "timing", "cue")


@query(f"""WITH {S.LINES}, {S.SUBTITLE} SELECT file_id, line_no, translate, CASE WHEN translate THEN prefix END AS prefix,
    CASE WHEN translate THEN text END AS text, CASE WHEN translate THEN suffix END AS suffix FROM su""")
def q_subtitle_units(spark: SparkSession, d: str) -> DataFrame:
    return U.subtitle_units(file_lines(spark, d).where(C("ext").isin(U.SUBTITLES))).select("file_id", "line_no", "unit.*")


@query(f"WITH {S.UNITS} SELECT file_id, ext, line_no, translate, prefix, text, suffix FROM u")
def q_document_units(spark: SparkSession, d: str) -> DataFrame:
    return U.document_units(file_lines(spark, d)).select("file_id", "ext", "line_no", "unit.*")


@query(f"WITH {S.UNITS} SELECT file_id, line_no, row_number() OVER (PARTITION BY file_id ORDER BY line_no) - 1 AS position, text FROM u WHERE translate")
def q_translatable(spark: SparkSession, d: str) -> DataFrame:
    return U.translatable(U.document_units(file_lines(spark, d))).select("file_id", "line_no", "position", "unit.text")


@query(f"WITH {S.DOCS} SELECT doc_id, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS digest, count(*) AS n_lines FROM dl GROUP BY doc_id")
def q_rebuild_document(spark: SparkSession, d: str) -> DataFrame:
    df = U.rebuilt(document_lines(spark, d), "doc_id", "line")
    return df.select("doc_id", F.sha2("content", 256).alias("digest"), F.size(F.split("content", "\n")).cast("long").alias("n_lines"))


@query(f"""WITH {S.UNITS} SELECT file_id, line_no, prefix || '译：' || text || suffix AS out FROM u WHERE translate""")
def q_reassemble(spark: SparkSession, d: str) -> DataFrame:
    return U.translated(U.document_units(file_lines(spark, d)).where("unit.translate")).select("file_id", "line_no", "out")


@query(f"""WITH {S.UNITS}, o AS (SELECT *, prefix || '译：' || text || suffix AS out FROM u WHERE translate)
    SELECT file_id, line_no, {S.strip("substr(out, length(prefix) + 1, length(out) - length(prefix) - length(suffix))")} AS back FROM o""")
def q_strip_affixes(spark: SparkSession, d: str) -> DataFrame:
    df = U.translated(U.document_units(file_lines(spark, d)).where("unit.translate"))
    return df.select("file_id", "line_no", T.strip_affixes(C("out"), C("unit.prefix"), C("unit.suffix")).alias("back"))


@query(rf"SELECT choice_id, attempt, regexp_replace({S.strip('content')}, '{S.WS}*\r?\n+{S.WS}*', ' ', 'g') AS one FROM (SELECT DISTINCT choice_id, attempt, content FROM choices)")
def q_one_line(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "choices").select("choice_id", "attempt", "content").distinct().select("choice_id", "attempt", T.one_line(C("content")).alias("one"))


@query(f"SELECT doc_id, {S.collapsed('text')} AS clean FROM documents")
def q_normal_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.collapsed(C("text")).alias("clean"))


@query(r"SELECT doc_id, regexp_matches(text, '[^\x09\x0a\x0d\x20-\x{d7ff}\x{e000}-\x{fffd}\x{10000}-\x{10ffff}]') AS illegal FROM documents")
def q_xml_illegal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.xml_illegal(C("text")).alias("illegal"))


_TERMINAL = rf"'[。！？.!?；;：:]{S.WS}*[\"''”’」』）)\]]*$'".replace('\\"', '"')
_SENTENCE = rf"'[。！？.!?…]{S.WS}*[\"''”’」』）)\]]*$'".replace('\\"', '"')


@query(f"""WITH {S.DOCS} SELECT doc_id, line_no, regexp_matches({S.rstrip("line")}, {_TERMINAL}) AS terminal FROM dl""")
def q_terminal_line(spark: SparkSession, d: str) -> DataFrame:
    return document_lines(spark, d).select("doc_id", "line_no", T.terminal_line(C("line")).alias("terminal"))


@query(f"""WITH {S.DOCS} SELECT doc_id, line_no, regexp_matches({S.rstrip("line")}, {_SENTENCE}) AS ends FROM dl""")
def q_sentence_end(spark: SparkSession, d: str) -> DataFrame:
    return document_lines(spark, d).select("doc_id", "line_no", T.sentence_end(C("line")).alias("ends"))


_BULLET = rf"'^(?:[-*•▪◦]{S.WS}+|\(?\p{{Nd}}{{1,4}}[.)、]{S.WS}*|[A-Za-z][.)]{S.WS}+)'"


@query(f"""WITH {S.DOCS} SELECT doc_id, line_no, regexp_matches({S.lstrip("line")}, {_BULLET}) AS bullet FROM dl""")
def q_bullet_like(spark: SparkSession, d: str) -> DataFrame:
    return document_lines(spark, d).select("doc_id", "line_no", T.bullet_like(C("line")).alias("bullet"))


def _heading(v: str) -> str:
    stop = rf"'[。！？.!?；;：:]{S.WS}*[\"''”’」』）)]*$'".replace('\\"', '"')
    words = rf"list_filter(string_split_regex({v}, '{S.WS}+'), lambda w: w <> '')"
    titled = rf"""len(list_filter({words}, lambda w: regexp_matches(regexp_replace(w, '^["''“”‘’()\[\]{{}}]+', ''), '^[\p{{Lu}}\p{{Lt}}]')))"""
    n = f"len({words})"
    return rf"""({v} <> '' AND length({v}) <= 100 AND NOT regexp_matches({v}, {stop}) AND (
        regexp_matches({v}, '(?i)^(?:chapter|section|part|appendix|volume|book)(?:[^\p{{L}}\p{{N}}_]|$)')
        OR (regexp_matches({v}, '\p{{L}}') AND NOT regexp_matches({v}, '[\p{{Ll}}ªº]'))
        OR ({n} BETWEEN 2 AND 12 AND {titled} >= greatest(2, {n} - 2))
        OR ({n} = 1 AND regexp_matches({v}, '[\x{{3400}}-\x{{9fff}}\x{{3040}}-\x{{30ff}}\x{{ac00}}-\x{{d7af}}]') AND length({v}) <= 16)))"""


@query(f"""WITH {S.DOCS} SELECT doc_id, line_no, {_heading("v")} AS heading FROM (SELECT doc_id, line_no, {S.strip("line")} AS v FROM dl)""")
def q_heading_like(spark: SparkSession, d: str) -> DataFrame:
    return document_lines(spark, d).select("doc_id", "line_no", T.heading_like(C("line")).alias("heading"))


_OPEN = r"""'^["''“”‘’(\[{]+'"""
_CORE = rf"""'[{S.IN}"''”’」』）)\]]+$'"""


@query(rf"""WITH {S.DOCS},
    x AS (SELECT doc_id, line_no, {S.strip("coalesce(p, '')")} AS p, {S.lstrip("line")} AS c
          FROM (SELECT doc_id, line_no, line, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS p FROM dl))
    SELECT doc_id, line_no, CASE WHEN p <> '' AND c <> '' AND NOT regexp_matches(regexp_replace(p, {_CORE}, ''), '[.!?。！？…]$')
        AND (regexp_matches(regexp_replace(c, {_OPEN}, ''), '^[a-zà-öø-ÿ]') OR regexp_matches(p, '[-–—,;]$')) THEN 'possible' ELSE '' END AS mode FROM x""")
def q_continuation_text(spark: SparkSession, d: str) -> DataFrame:
    previous = F.lag("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    return document_lines(spark, d).withColumn("p", previous).select("doc_id", "line_no", T.may_continue(C("p"), C("line")).alias("mode"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _layout_go(p: str, c: str) -> str:
    return rf"""({p} <> '' AND {c} <> '' AND NOT regexp_matches({p}, {_SENTENCE}) AND (regexp_matches(regexp_replace({c}, {_OPEN}, ''), '^[a-zà-öø-ÿ]')
        OR regexp_matches({p}, '[-–—,;]$') OR regexp_extract(lower({p}), '([a-z]+)[^a-z]*$', 1) IN ({_STOP})))"""


@query(rf"""WITH {S.DOCS},
    x AS (SELECT doc_id, line_no, {S.strip("coalesce(p, '')")} AS p, {S.lstrip("line")} AS c
          FROM (SELECT doc_id, line_no, line, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS p FROM dl))
    SELECT doc_id, line_no, {_layout_go("p", "c")} AS may FROM x""")
def q_continuation_pdf(spark: SparkSession, d: str) -> DataFrame:
    previous = F.lag("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    return document_lines(spark, d).withColumn("p", previous).select("doc_id", "line_no", T.layout_may_continue(C("p"), C("line")).alias("may"))


_DETECT = (
    "CASE "
    + " ".join(rf"WHEN regexp_matches({{x}}, '[\x{{{{{a}}}}}-\x{{{{{b}}}}}]') THEN '{n}'" for a, b, n in T.SCRIPT_LANGUAGES)
    + rf""" WHEN regexp_matches({{x}}, '[\x{{{{4e00}}}}-\x{{{{9fff}}}}]') THEN CASE WHEN length(regexp_replace({{x}}, '[^{T.TRADITIONAL}]', '', 'g')) >
        length(regexp_replace({{x}}, '[^{T.SIMPLIFIED}]', '', 'g')) THEN '繁体中文' ELSE '中文' END
      WHEN regexp_matches({{x}}, '[a-zA-Z]') THEN '英文' ELSE '中文' END"""
)


@query("SELECT doc_id, " + _DETECT.format(x="text") + " AS language FROM documents WHERE text IS NOT NULL")
def q_detect_lang(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.detected_language(C("text")).alias("language"))


@query(rf"""WITH {S.FILES} SELECT file_id, CASE WHEN target_language = '日文' OR regexp_matches(t, '[\x{{3040}}-\x{{30ff}}]') THEN 'japanese'
    WHEN target_language = '韩文' OR regexp_matches(t, '[\x{{ac00}}-\x{{d7af}}]') THEN 'korean' WHEN target_language IN ('繁体中文', '粤语') THEN 'traditional_chinese'
    WHEN target_language = '中文' OR regexp_matches(t, '[\x{{3400}}-\x{{9fff}}]') THEN 'simplified_chinese' ELSE 'unicode' END AS script
    FROM (SELECT file_id, target_language, coalesce(translated_content, '') AS t FROM f)""")
def q_target_script(spark: SparkSession, d: str) -> DataFrame:
    df = files(spark, d, "translated_content", "target_language")
    return df.select("file_id", T.target_script(F.coalesce("translated_content", F.lit("")), C("target_language")).alias("script"))


@query(r"SELECT doc_id, regexp_matches(text, '[\x{0600}-\x{08ff}\x{0900}-\x{0dff}\x{0e00}-\x{0fff}\x{1000}-\x{109f}\x{1780}-\x{18af}]') AS shaping FROM documents")
def q_shaping(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.shaping(C("text")).alias("shaping"))


@query(rf"SELECT doc_id, regexp_replace(coalesce(text, ''), '[{S.IN}\x{{ad}}]+', '', 'g') AS key FROM documents")
def q_layout_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.layout_key(C("text")).alias("key"))


@query(rf"""WITH {S.DOCS}, v AS (SELECT doc_id, line_no, regexp_extract(line, '([0-9]{{1,4}}){S.WS}*$', 1) AS label, {S.collapsed("line")} AS v FROM dl),
    h AS (SELECT *, substr(v, 1, greatest(0, length(v) - length(label))) AS head FROM v)
    SELECT doc_id, line_no, label, CASE WHEN label <> '' AND ends_with(v, label) AND regexp_matches(head, '[ .·…]$') AND regexp_replace(head, '[ .·…]+$', '') <> ''
        THEN regexp_replace(head, '[ .·…]+$', '') ELSE v END AS title FROM h""")
def q_toc_title(spark: SparkSession, d: str) -> DataFrame:
    df = document_lines(spark, d).withColumn("label", F.regexp_extract("line", rf"(?U)([0-9]{{1,4}}){T.WS}*\z", 1))
    return df.select("doc_id", "line_no", "label", T.toc_title(C("line"), C("label")).alias("title"))


@query(f"SELECT doc_id, {S.tokens('text')} AS tokens FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def q_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.tokens(C("text")).alias("tokens"))


@query(f"SELECT doc_id, least(80000, greatest(384, trunc({S.tokens('text')} * 2.25::DOUBLE)::INT + 384)) AS budget FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def q_output_budget(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.output_budget(C("text")).alias("budget"))


@query("""SELECT size, total * 2 // 3 AS plain_before, greatest(128, trunc(total * 2 / 3)::INT) AS before, greatest(128, total - greatest(128, trunc(total * 2 / 3)::INT)) AS after
    FROM (SELECT max_tokens AS size, greatest(256, least(8192, trunc(greatest(2048, max_tokens) * 0.15::DOUBLE)::INT)) AS total FROM (SELECT DISTINCT max_tokens FROM choices WHERE max_tokens IS NOT NULL))""")
def q_context_caps(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "choices").where("max_tokens is not null").select(C("max_tokens").alias("size")).distinct()
    df = df.withColumn("total", F.greatest(F.lit(256), F.least(F.lit(8192), (F.greatest(F.lit(2048), C("size")) * F.lit(0.15)).cast("int"))))
    before = F.greatest(F.lit(128), F.floor(C("total") * 2 / 3).cast("int"))
    return df.select("size", F.expr("total * 2 div 3").alias("plain_before"), before.alias("before"), F.greatest(F.lit(128), C("total") - before).alias("after"))


_SENTENCES = rf"'(?s).+?(?:[。！？.!?]+[”’\"」』）)\]]*{S.WS}*|$)'".replace('\\"', '"')


@query(f"SELECT doc_id, unnest(range(len(s))) AS sentence_no, unnest(s) AS sentence FROM (SELECT doc_id, regexp_extract_all(text, {_SENTENCES}) AS s FROM documents WHERE text <> '')")
def q_sentences(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents").where("text <> ''").select("doc_id", F.posexplode(T.sentences(C("text"))).alias("sentence_no", "sentence"))
    return df


@query(f"""WITH {S.FILES}, p AS (SELECT file_id, target_language, list_filter(list_transform(string_split(t, chr(10)), lambda x: {S.strip("x")}), lambda x: x <> '') AS p FROM nf)
    SELECT file_id, sha256(CASE WHEN target_language IN ('中文', '繁体中文', '粤语', '日文', '韩文') THEN array_to_string(p, '') ELSE array_to_string(p, ' ') END) AS digest FROM p""")
def q_join_units(spark: SparkSession, d: str) -> DataFrame:
    df = files(spark, d, "content", "target_language")
    return df.select("file_id", F.sha2(T.joined_units(F.split(T.normalized(C("content")), "\n"), C("target_language")), 256).alias("digest"))


_MARKS = r"""' \t\r\n,.;:!?，。！？；：、)]}）】》」』”’'"""


@query(rf"""WITH RECURSIVE w AS (SELECT doc_id, {S.collapsed("text")} AS x FROM documents WHERE length(text) > 0),
    v AS (SELECT doc_id, x, length(x) AS n, least(16, greatest(4, length(x) // 20)) AS r, [length(s) FOR s IN string_split(x, ' ')][1:4] AS w FROM w),
    t AS (SELECT *, list_sum([greatest(1, y) FOR y IN w])::INT AS total FROM v),
    c AS (SELECT doc_id, x, n, r, w, total, 0 AS i, 0 AS s, 0 AS last FROM t
          UNION ALL
          SELECT doc_id, x, n, r, w, total, i + 1, s + greatest(1, w[i + 1])::INT,
            CASE WHEN g <= last THEN last WHEN g >= n THEN n ELSE coalesce((SELECT k FROM (SELECT unnest(generate_series(greatest(last + 1, g - r), least(n, g + r))) AS k)
                WHERE regexp_matches(substr(x, k::INT, 1), '[ \t\r\n,.;:!?，。！？；：、)\]}}）】》」』”’]') OR (k < n AND regexp_matches(substr(x, (k + 1)::INT, 1), '[ \t\r\n,.;:!?，。！？；：、)\]}}）】》」』”’]'))
                ORDER BY abs(k - g), k LIMIT 1), g)::INT END
          FROM (SELECT *, round_even(n * (s + greatest(1, w[i + 1]))::DOUBLE / total, 0)::INT AS g FROM c WHERE i < len(w) - 1))
    SELECT doc_id, i AS cut_no, last AS cut FROM c WHERE i > 0""")
def q_partition_text(spark: SparkSession, d: str) -> DataFrame:
    df = balanced(table(spark, d, "documents").where("length(text) > 0").select("doc_id", "text")).select("doc_id", T.collapsed(C("text")).alias("x"))
    weights = F.transform(F.slice(F.split("x", " "), 1, 4), F.length)
    cuts = df.select("doc_id", F.posexplode(T.partition_cuts(C("x"), weights)).alias("i", "cut"))
    return cuts.select("doc_id", (C("i") + 1).alias("cut_no"), "cut")


@query(r"""WITH v AS (SELECT doc_id, text AS x, length(text) AS n, least(16, greatest(4, length(text) // 20)) AS r, length(text) // 3 AS g FROM documents WHERE length(text) > 0),
    k AS (SELECT doc_id, x, n, g, unnest(generate_series(greatest(1, g - r), least(n, g + r))) AS k FROM v WHERE g > 0),
    b AS (SELECT doc_id, arg_min(k, abs(k - g) * 100000000 + k) AS k FROM k
          WHERE regexp_matches(substr(x, k::INT, 1), '[ \t\r\n,.;:!?，。！？；：、)\]}）】》」』”’]') OR (k < n AND regexp_matches(substr(x, (k + 1)::INT, 1), '[ \t\r\n,.;:!?，。！？；：、)\]}）】》」』”’]')) GROUP BY doc_id)
    SELECT doc_id, CASE WHEN g <= 0 THEN 0 WHEN g >= n THEN n ELSE coalesce(k, g) END::INT AS cut FROM v LEFT JOIN b USING (doc_id)""")
def q_nearest_boundary(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents").where("length(text) > 0")
    return df.select("doc_id", T.nearest_boundary(C("text"), F.expr("cast(length(text) div 3 as int)"), F.lit(0)).alias("cut"))


@query(rf"""WITH RECURSIVE {S.DOCS}, a AS (SELECT doc_id, list({S.collapsed("line")} ORDER BY line_no) AS a FROM dl GROUP BY doc_id),
    r AS (SELECT doc_id, a, 0 AS i, '' AS x FROM a
          UNION ALL
          SELECT doc_id, a, i + 1, CASE WHEN a[i + 1] = '' THEN x WHEN x = '' THEN a[i + 1]
            WHEN ends_with(x, '-') AND regexp_matches(a[i + 1], '^[\p{{L}}\p{{N}}]') THEN substr(x, 1, length(x) - 1) || a[i + 1] ELSE x || ' ' || a[i + 1] END
          FROM r WHERE i < len(a))
    SELECT doc_id, sha256(x) AS digest, length(x) AS n FROM r WHERE i = len(a)""")
def q_dehyphenate(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents").where("text is not null").select("doc_id", T.dehyphenated(F.split(T.normalized(C("text")), "\n")).alias("x"))
    return df.select("doc_id", F.sha2("x", 256).alias("digest"), F.length("x").alias("n"))


@query("SELECT event_id, lower(list_extract(string_split(tag, '}'), -1)) AS name FROM (SELECT event_id, '{urn:x:' || user_id || '}' || upper(event_type) AS tag FROM events)")
def q_local_name(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events").withColumn("tag", F.concat(F.lit("{urn:x:"), C("user_id").cast("string"), F.lit("}"), F.upper("event_type")))
    return df.select("event_id", T.local_name(C("tag")).alias("name"))


_SUFFIX = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANGUAGE_SUFFIXES.items())


@query(rf"""WITH {S.FILES}, b AS (SELECT file_id, target_language, CASE WHEN x = '' THEN 'translated.md' ELSE x END AS b
        FROM (SELECT file_id, target_language, regexp_extract(replace(coalesce(name, ''), '\', '/'), '([^/]*)$', 1) AS x FROM f)),
    e AS (SELECT *, regexp_extract(b, '(?s)^\.*[^.].*(\.[^.]*)$', 1) AS e FROM b)
    SELECT file_id, substr(b, 1, length(b) - length(e)) || '.' || CASE target_language {_SUFFIX} ELSE 'translated' END || CASE WHEN e = '' THEN '.md' ELSE e END AS output_name FROM e""")
def q_output_filename(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d, "name", "target_language").select("file_id", T.output_name(C("name"), C("target_language")).alias("output_name"))


@query(f"""WITH {S.FILES} SELECT file_id, ext, ext IN ('.docx', '.epub', '.pdf') AS is_binary,
    CASE WHEN f2 IN ('docx', 'epub', 'pdf', 'text') THEN f2 ELSE 'text' END AS format FROM (SELECT *, lower({S.strip("coalesce(source_format, '')")}) AS f2 FROM nf)""")
def q_enum_normalize(spark: SparkSession, d: str) -> DataFrame:
    df = files(spark, d, "name", "source_format").withColumn("f", F.lower(T.strip(F.coalesce("source_format", F.lit("")))))
    ext = T.extension(C("name"))
    return df.select("file_id", ext.alias("ext"), ext.isin(U.BINARY).alias("is_binary"), F.when(C("f").isin("docx", "epub", "pdf", "text"), C("f")).otherwise("text").alias("format"))


@query(r"SELECT DISTINCT file_id, source_sha256, coalesce(regexp_full_match(substr(source_sha256, 1, 32) || regexp_extract(lower(name), '\.[^.]*$'), '[0-9a-f]{32}\.(docx|epub|pdf)'), false) AS valid FROM files")
def q_source_id(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.substring("source_sha256", 1, 32), F.regexp_extract(F.lower("name"), r"\.[^.]*\z", 0))
    return files(spark, d, "source_sha256", "name").select("file_id", "source_sha256", F.coalesce(made.rlike(r"\A[0-9a-f]{32}\.(docx|epub|pdf)\z"), F.lit(False)).alias("valid"))


@query()
def q_line_direction(spark: SparkSession, d: str) -> DataFrame:
    """Direction of every line by its first strong character."""
    return document_lines(spark, d).select("doc_id", "line_no", line_direction(C("line"), F.lit("阿拉伯文")).alias("direction"))


@query("SELECT vec_id, coalesce(round(list_aggregate(p, 'median') / 255.0, 5), 1.0) AS background FROM (SELECT vec_id, [round((x + 1) * 100, 0)::DOUBLE FOR x IN embedding[1:16]::DOUBLE[]] AS p FROM embeddings)")
def q_background(spark: SparkSession, d: str) -> DataFrame:
    """Background from edge pixels; here pixels are made of vector components."""
    pixels = F.transform(F.slice(C("embedding").cast("array<double>"), 1, 16), lambda x: F.round((x + 1) * 100, 0))
    return table(spark, d, "embeddings").select("vec_id", background(pixels).alias("background"))


@query()
def q_fit_text(spark: SparkSession, d: str) -> DataFrame:
    """Lines set into boxes of one size: the largest size that fits, with its wrapped lines."""
    df = document_lines(spark, d).withColumn("f", fit_box(C("line"), F.lit(240.0), F.lit(40.0), F.lit(12.0)))
    return df.select("doc_id", "line_no", F.round("f.size", 4).alias("size"), "f.lines")
