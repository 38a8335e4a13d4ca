"""Queries over jobs, events, checkpoints, page selections and the output index, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import jobs as J
from ..operators import units as U
from ..sources.tables import document_lines, file_lines, files, lines, table, texts
from . import sql as S

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


def _events(spark: SparkSession, d: str) -> DataFrame:
    return J.events_once(table(spark, d, "job_events"))


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").distinct()


_EV = "e AS (SELECT job_id, seq, kind, file_id, file_name, idx, line_no, text, done, total, ts, min(arrived_at) AS arrived_at FROM job_events GROUP BY ALL)"
_INDEX = "x AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY output_name ORDER BY written_at DESC, source_sha256 DESC NULLS LAST, source_name DESC NULLS LAST) AS n FROM output_index) WHERE n = 1)"


@query(f"WITH {_EV} SELECT job_id, file_id, line_no, arg_max(text, seq) AS text, max(seq) AS seq FROM e WHERE kind = 'chunk' AND text IS NOT NULL GROUP BY ALL")
def q_partials_latest(spark: SparkSession, d: str) -> DataFrame:
    # A doubled event changes no maximum, so nothing is made distinct first.
    chunks = table(spark, d, "job_events").where("kind = 'chunk' and text is not null")
    return chunks.groupBy("job_id", "file_id", "line_no").agg(F.max_by("text", "seq").alias("text"), F.max("seq").alias("seq"))


@query(f"""WITH {_EV}, c AS (SELECT job_id, file_id, max(seq) AS cleared FROM e WHERE kind = 'file_done' GROUP BY ALL)
    SELECT job_id, file_id, line_no, arg_max(text, e.seq) AS text FROM e LEFT JOIN c USING (job_id, file_id)
    WHERE kind = 'line_done' AND text IS NOT NULL AND (cleared IS NULL OR e.seq > cleared) GROUP BY ALL""")
def q_completed_partials(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "job_events")
    done = e.where("kind = 'file_done'").groupBy("job_id", "file_id").agg(F.max("seq").alias("cleared"))
    kept = e.where("kind = 'line_done' and text is not null").join(done, ["job_id", "file_id"], "left").where("cleared is null or seq > cleared")
    return kept.groupBy("job_id", "file_id", "line_no").agg(F.max_by("text", "seq").alias("text"))


@query(f"WITH {_EV} SELECT job_id, seq, kind FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS n FROM e) WHERE n <= 256")
def q_event_tail(spark: SparkSession, d: str) -> DataFrame:
    return J.tail(table(spark, d, "job_events").select("job_id", "seq", "kind"))


@query(f"""WITH {S.UNITS}, r AS (SELECT file_id, line_no FROM resume_lines WHERE {S.strip("coalesce(text, '')")} <> '' GROUP BY ALL)
    SELECT u.file_id, count(r.line_no) AS done, count(*) AS total FROM u LEFT JOIN r ON r.file_id = u.file_id AND r.line_no = u.line_no WHERE translate GROUP BY ALL""")
def q_progress(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "resume_lines").where(T.strip(F.coalesce("text", F.lit(""))) != "").select("file_id", "line_no", F.lit(1).alias("kept")).distinct()
    units = U.document_units(file_lines(spark, d)).where("unit.translate").select("file_id", "line_no")
    return units.join(kept, ["file_id", "line_no"], "left").groupBy("file_id").agg(F.count("kept").alias("done"), F.count("*").alias("total"))


@query(f"""WITH {_EV} SELECT job_id, count(DISTINCT CASE WHEN kind = 'file_done' THEN file_id END) AS done, count(DISTINCT CASE WHEN kind = 'fail' THEN file_id END) AS failed,
    max(total) FILTER (kind IN ('file_progress', 'line_done')) AS total FROM e GROUP BY ALL""")
def q_job_progress(spark: SparkSession, d: str) -> DataFrame:
    # Files of a job first, jobs after: no distinct set of a hot job has to fit into one task.
    per_file = table(spark, d, "job_events").groupBy("job_id", "file_id").agg(F.max((C("kind") == "file_done").cast("int")).alias("done"), F.max((C("kind") == "fail").cast("int")).alias("failed"), F.max(F.when(C("kind").isin("file_progress", "line_done"), C("total"))).alias("total"))
    known = C("file_id").isNotNull().cast("int")
    return per_file.groupBy("job_id").agg(F.sum(C("done") * known).alias("done"), F.sum(C("failed") * known).alias("failed"), F.max("total").alias("total"))


@query("""WITH j AS (SELECT DISTINCT * FROM jobs) SELECT job_id, kind, status, total, done, CASE WHEN status = 'running' THEN current_file END AS current_file,
    CASE WHEN status <> 'running' THEN strftime(finished_at, '%Y-%m-%d %H:%M:%S.%f') END AS finished_at, status <> 'running' AS full_payload FROM j""")
def q_snapshot(spark: SparkSession, d: str) -> DataFrame:
    running = C("status") == "running"
    return _jobs(spark, d).select("job_id", "kind", "status", "total", "done", F.when(running, C("current_file")).alias("current_file"), F.when(~running, F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("finished_at"), (~running).alias("full_payload"))


@query(f"""WITH {S.FILES} SELECT file_id, job_id, row_number() OVER (PARTITION BY job_id ORDER BY (ext IN ('.srt', '.vtt')) DESC, idx, file_id) AS turn FROM nf""")
def q_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Subtitle files have priority; within both groups the original order holds."""
    df = files(spark, d, "job_id", "name", "idx").withColumn("first", T.extension(C("name")).isin(U.SUBTITLES))
    return J.turns(df).select("file_id", "job_id", "turn")


_TTL_DAYS, _MOST, _CHARS = 60, 50, 60_000


@query(f"""WITH RECURSIVE {S.FILES}, j AS (SELECT DISTINCT job_id, status, coalesce(finished_at, created_at) AS ended FROM jobs WHERE status <> 'running'),
    s AS (SELECT job_id, sum(length(coalesce(translated_content, '')))::BIGINT AS chars FROM f GROUP BY ALL),
    o AS (SELECT job_id, coalesce(chars, 0) AS chars, row_number() OVER (ORDER BY ended DESC, job_id) AS n FROM j LEFT JOIN s USING (job_id)
          WHERE ended >= (SELECT max(ended) FROM j) - INTERVAL {_TTL_DAYS} DAY),
    r AS (SELECT 0 AS n, 0 AS kept, 0::BIGINT AS chars, NULL::VARCHAR AS job_id
          UNION ALL
          SELECT o.n, CASE WHEN r.kept < {_MOST} AND (r.kept = 0 OR r.chars + o.chars <= {_CHARS}) THEN r.kept + 1 ELSE r.kept END,
                 CASE WHEN r.kept < {_MOST} AND (r.kept = 0 OR r.chars + o.chars <= {_CHARS}) THEN r.chars + o.chars ELSE r.chars END,
                 CASE WHEN r.kept < {_MOST} AND (r.kept = 0 OR r.chars + o.chars <= {_CHARS}) THEN o.job_id END
          FROM r JOIN o ON o.n = r.n + 1)
    SELECT job_id FROM r WHERE job_id IS NOT NULL""")
def q_retention(spark: SparkSession, d: str) -> DataFrame:
    """Finished jobs that stay: young enough, then from the newest while count and characters allow.

    Only jobs of the retention time are read, however long the history is.
    """
    jobs = _jobs(spark, d).where("status <> 'running'").select("job_id", F.coalesce("finished_at", "created_at").alias("at")).distinct()
    newest = jobs.agg(F.max("at")).first()[0]  # one value
    young = jobs.where(C("at") >= F.lit(newest) - F.expr(f"interval {_TTL_DAYS} days"))
    sizes = files(spark, d, "job_id", "translated_content").groupBy("job_id").agg(F.sum(F.length(F.coalesce("translated_content", F.lit("")))).alias("chars"))
    return J.retained(young.join(sizes, "job_id", "left").select("job_id", "at", F.coalesce("chars", F.lit(0)).alias("chars")), _MOST, _CHARS)


@query(f"WITH {S.FILES} SELECT job_id, sum(length(coalesce(content, '')) + length(coalesce(translated_content, '')) + length(coalesce(name, '')))::BIGINT AS chars FROM f GROUP BY ALL")
def q_job_text_chars(spark: SparkSession, d: str) -> DataFrame:
    df = files(spark, d, "job_id", "content", "translated_content", "name")
    each = F.aggregate(F.array("content", "translated_content", "name"), F.lit(0), lambda a, x: a + F.length(F.coalesce(x, F.lit(""))))
    return df.groupBy("job_id").agg(F.sum(each).alias("chars"))


_FOLD = "replace(lower(name), 'ß', 'ss')"


@query(f"WITH {S.FILES} SELECT job_id, {_FOLD} AS key, count(*) AS n FROM f GROUP BY ALL HAVING count(*) > 1")
def q_duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of one job that collide regardless of case."""
    return files(spark, d, "job_id", "name").groupBy("job_id", F.expr(_FOLD).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


@query(rf"""WITH {S.FILES}, v AS (SELECT file_id, ext, lower({S.strip("coalesce(source_format, '')")}) AS fmt, name, content FROM nf)
    SELECT file_id, 'format' AS rule FROM v WHERE fmt NOT IN ('', 'text') AND '.' || fmt <> ext
    UNION ALL SELECT file_id, 'suffix' FROM v WHERE ext NOT IN ('.md', '.markdown', '.txt', '.text', '.srt', '.vtt', '.docx', '.epub', '.pdf')
    UNION ALL SELECT file_id, 'path' FROM v WHERE name IS NULL OR name = '' OR contains(name, '/') OR contains(name, '\')
    UNION ALL SELECT file_id, 'empty' FROM v WHERE {S.strip("coalesce(content, '')")} = ''
    UNION ALL SELECT file_id, 'twice' FROM (SELECT file_id, count(*) OVER (PARTITION BY job_id, {_FOLD}) AS n FROM f WHERE name IS NOT NULL) WHERE n > 1
    UNION ALL SELECT DISTINCT r.file_id, 'resume' FROM resume_lines r LEFT JOIN f USING (file_id) WHERE f.file_id IS NULL OR r.line_no < 0
        OR r.line_no >= len(string_split(coalesce(f.content, ''), chr(10)))""")
def q_request_violations(spark: SparkSession, d: str) -> DataFrame:
    every = files(spark, d, "job_id", "name", "source_format", "content")
    folded = every.where("name is not null").select("file_id", "job_id", F.expr(_FOLD).alias("key"))
    twice = folded.groupBy("job_id", "key").agg(F.count("*").alias("n")).where("n > 1").join(folded, ["job_id", "key"])
    df = every.drop("job_id").withColumn("fmt", F.lower(T.strip(F.coalesce("source_format", F.lit(""))))).withColumn("ext", T.extension(C("name")))
    rules = {
        "format": ~C("fmt").isin("", "text") & (F.concat(F.lit("."), C("fmt")) != C("ext")),
        "suffix": ~C("ext").isin(".md", ".markdown", ".txt", ".text", ".srt", ".vtt", ".docx", ".epub", ".pdf"),
        "path": C("name").isNull() | (C("name") == "") | C("name").contains("/") | C("name").contains("\\"),
        "empty": T.strip(F.coalesce("content", F.lit(""))) == "",
    }
    broken = df.select("file_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))).alias("rule"))
    counts = df.select("file_id", F.size(F.split(F.coalesce("content", F.lit("")), "\n")).alias("n"))
    resume = table(spark, d, "resume_lines").join(counts, "file_id", "left").where("n is null or line_no < 0 or line_no >= n")
    return broken.unionByName(twice.select("file_id", F.lit("twice").alias("rule"))).unionByName(resume.select("file_id", F.lit("resume").alias("rule")).distinct())


@query("""SELECT choice_id, attempt, unnest(range(attempt)) AS failure, least(20.0::DOUBLE, 1.5::DOUBLE * pow(2, unnest(range(attempt)))) AS delay
    FROM (SELECT DISTINCT choice_id, attempt FROM choices WHERE attempt > 0)""")
def q_retry_schedule(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "choices").where("attempt > 0").select("choice_id", "attempt").distinct()
    df = df.select("choice_id", "attempt", F.explode(F.sequence(F.lit(0), C("attempt") - 1)).alias("failure"))
    return df.withColumn("delay", F.least(F.lit(20.0), F.lit(1.5) * F.pow(F.lit(2.0), C("failure"))))


@query("""WITH RECURSIVE c AS (SELECT DISTINCT choice_id, max_tokens AS budget, 4000 AS lim FROM choices WHERE finish_reason = 'length' AND max_tokens IS NOT NULL),
    r AS (SELECT choice_id, 0 AS step, budget, lim FROM c
          UNION ALL SELECT choice_id, step + 1, least(lim, greatest(budget + 256, trunc(budget * 1.75::DOUBLE)::INT)), lim FROM r
          WHERE step < 4 AND least(lim, greatest(budget + 256, trunc(budget * 1.75::DOUBLE)::INT)) > budget)
    SELECT choice_id, step, budget FROM r""")
def q_budget_growth(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "choices").where("finish_reason = 'length' and max_tokens is not null").select("choice_id", "max_tokens").distinct()
    return df.select("choice_id", F.posexplode(J.grown_budgets(C("max_tokens"), F.lit(4000), 5)).alias("step", "budget"))


@query(f"WITH {_INDEX} SELECT output_name, source_name, source_sha256, target_language, strftime(written_at, '%Y-%m-%d %H:%M:%S.%f') AS written_at FROM x")
def q_index_upsert(spark: SparkSession, d: str) -> DataFrame:
    return J.upserted(table(spark, d, "output_index")).select("output_name", "source_name", "source_sha256", "target_language", F.date_format("written_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("written_at"))


@query(f"WITH {_INDEX}, {S.FILES} SELECT output_name FROM x WHERE source_name NOT IN (SELECT name FROM f WHERE translated_content IS NULL AND name IS NOT NULL) OR source_name IS NULL")
def q_index_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = files(spark, d, "name", "translated_content").where("translated_content is null").select(C("name").alias("source_name"))
    return J.upserted(table(spark, d, "output_index")).join(gone, "source_name", "left_anti").select("output_name")


@query(f"WITH {_INDEX}, {S.FILES} SELECT output_name FROM x WHERE source_name IN (SELECT name FROM f WHERE translated_content IS NOT NULL) AND NOT contains(output_name, '/')")
def q_index_prune(spark: SparkSession, d: str) -> DataFrame:
    there = files(spark, d, "name", "translated_content").where("translated_content is not null").select(C("name").alias("source_name"))
    return J.upserted(table(spark, d, "output_index")).where(~C("output_name").contains("/")).join(there, "source_name", "left_semi").select("output_name")


@query(f"""WITH {_INDEX}, s AS (SELECT output_name, any_value(source_name) AS source_name FROM output_index WHERE source_format = 'pdf' AND source_name IS NOT NULL GROUP BY ALL),
    m AS (SELECT output_name, min(source_name) AS source_name FROM output_index WHERE source_format = 'pdf' AND source_name IS NOT NULL GROUP BY ALL)
    SELECT coalesce(x.output_name, m.output_name) AS output_name, coalesce(m.source_name, x.source_name) AS source_name, m.output_name IS NOT NULL AS legacy FROM x FULL JOIN m USING (output_name)""")
def q_index_merge(spark: SparkSession, d: str) -> DataFrame:
    """Older per-file records (here: those of PDF outputs) override the index; invalid ones are skipped."""
    index = table(spark, d, "output_index")
    old = index.where("source_format = 'pdf' and source_name is not null").groupBy("output_name").agg(F.min("source_name").alias("old_name"), F.lit(True).alias("legacy"))
    merged = J.upserted(index).select("output_name", "source_name").join(old, "output_name", "full")
    return merged.select("output_name", F.coalesce("old_name", "source_name").alias("source_name"), F.coalesce("legacy", F.lit(False)).alias("legacy"))


@query(f"""WITH {_INDEX}, {S.FILES} SELECT f.file_id, f.name, x.output_name, x.target_language FROM f LEFT JOIN x ON x.source_name = f.name AND x.source_sha256 = f.source_sha256""")
def q_history_left_join(spark: SparkSession, d: str) -> DataFrame:
    index = J.upserted(table(spark, d, "output_index")).select(C("source_name").alias("name"), "source_sha256", "output_name", "target_language")
    return files(spark, d, "name", "source_sha256").join(index, ["name", "source_sha256"], "left").select("file_id", "name", "output_name", "target_language")


@query(f"""WITH {S.UNITS} SELECT u.file_id, u.line_no, CASE WHEN {S.strip("coalesce(r.text, '')")} <> '' THEN r.text ELSE prefix || '译：' || u.text || suffix END AS out,
    {S.strip("coalesce(r.text, '')")} <> '' AS resumed FROM u LEFT JOIN resume_lines r ON r.file_id = u.file_id AND r.line_no = u.line_no WHERE translate""")
def q_resume(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "resume_lines").select("file_id", "line_no", C("text").alias("kept"))
    df = U.translated(U.document_units(file_lines(spark, d)).where("unit.translate")).join(kept, ["file_id", "line_no"], "left")
    there = T.strip(F.coalesce("kept", F.lit(""))) != ""
    return df.select("file_id", "line_no", F.when(there, C("kept")).otherwise(C("out")).alias("out"), there.alias("resumed"))


_TWO = (
    S.FILES
    + f""", a AS (SELECT file_id, unnest(range(len(x))) AS line_no, unnest(x) AS line FROM (SELECT file_id, string_split(t, chr(10)) AS x FROM nf)),
    b AS (SELECT file_id, unnest(range(len(x))) AS line_no, unnest(x) AS old FROM (SELECT file_id, string_split({S.normalized("translated_content")}, chr(10)) AS x FROM f WHERE translated_content IS NOT NULL))"""
)


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    df = files(spark, d, "content", "translated_content")
    a = lines(df.select("file_id", T.normalized(C("content")).alias("t")), "file_id")
    b = lines(df.where("translated_content is not null").select("file_id", T.normalized(C("translated_content")).alias("t")), "file_id").withColumnRenamed("line", "old")
    return a, b


@query(f"""WITH {_TWO} SELECT coalesce(a.file_id, b.file_id) AS file_id, count(a.line_no) AS n_source, count(b.line_no) AS n_translated,
    CASE WHEN count(b.line_no) < count(a.line_no) THEN 'fewer' WHEN count(b.line_no) > count(a.line_no) THEN 'more' ELSE 'equal' END AS fit
    FROM a FULL JOIN b ON a.file_id = b.file_id AND a.line_no = b.line_no GROUP BY 1""")
def q_zip_units(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    both = a.withColumn("s", F.lit(1)).join(b.withColumn("t", F.lit(1)), ["file_id", "line_no"], "full").groupBy("file_id").agg(F.count("s").alias("n_source"), F.count("t").alias("n_translated"))
    return both.withColumn("fit", F.when(C("n_translated") < C("n_source"), "fewer").when(C("n_translated") > C("n_source"), "more").otherwise("equal"))


@query(f"WITH {_TWO} SELECT a.file_id, a.line_no, coalesce(b.old, a.line) AS line, b.old IS NULL AS padded FROM a LEFT JOIN b ON a.file_id = b.file_id AND a.line_no = b.line_no")
def q_pad_lines(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return a.join(b, ["file_id", "line_no"], "left").select("file_id", "line_no", F.coalesce("old", "line").alias("line"), C("old").isNull().alias("padded"))


@query(f"""WITH {S.UNITS}, p AS (SELECT file_id, min(line_no) AS first FROM u WHERE translate GROUP BY ALL)
    SELECT file_id, sha256(string_agg(CASE WHEN line_no = first THEN prefix || '改：' || text || suffix ELSE line END, chr(10) ORDER BY line_no)) AS digest FROM u LEFT JOIN p USING (file_id) GROUP BY file_id""")
def q_update_line(spark: SparkSession, d: str) -> DataFrame:
    """The first translatable line rewritten, every other line as it was."""
    units = U.document_units(file_lines(spark, d))
    first = F.min(F.when(C("unit.translate"), C("line_no"))).over(Window.partitionBy("file_id"))
    df = units.withColumn("at", first).withColumn("new", F.when(C("line_no") == C("at"), F.concat("unit.prefix", F.lit("改："), "unit.text", "unit.suffix")).otherwise(C("line")))
    return U.rebuilt(df, "file_id", "new").select("file_id", F.sha2("content", 256).alias("digest"))


@query(f"""WITH {_INDEX}, v AS (SELECT *, {S.EXT.replace("name", "output_name")} AS ext FROM x)
    SELECT count_if(ext IN ('.docx', '.epub', '.pdf'))::BIGINT AS source_files, count_if(ext NOT IN ('.docx', '.epub', '.pdf'))::BIGINT AS auxiliary_files,
           sum(length(coalesce(preview_content, '')))::BIGINT AS total_chars FROM v""")
def q_cache_stats(spark: SparkSession, d: str) -> DataFrame:
    df = J.upserted(table(spark, d, "output_index")).withColumn("b", T.extension(C("output_name")).isin(U.BINARY))
    return df.agg(F.count_if("b").alias("source_files"), F.count_if(~C("b")).alias("auxiliary_files"), F.sum(F.length(F.coalesce("preview_content", F.lit("")))).alias("total_chars"))


_PAGES = rf"""v AS (SELECT output_name, pdf_page_count AS n, pdf_page_selection AS sel, lower({S.strip("pdf_page_selection")}) AS v FROM x WHERE pdf_page_count IS NOT NULL),
    t AS (SELECT output_name, n, sel, v, list_transform(string_split(v, ','), lambda k: {S.strip("k")}) AS t FROM v),
    q AS (SELECT *, list_bool_and(list_transform(t, lambda k: regexp_matches(k, '^[0-9]+(?:{S.WS}*-{S.WS}*[0-9]+)?$'))) AS fine,
          list_transform(t, lambda k: [try_cast(regexp_extract(k, '^([0-9]+)', 1) AS INT), try_cast(coalesce(nullif(regexp_extract(k, '-{S.WS}*([0-9]+)$', 1), ''), regexp_extract(k, '^([0-9]+)', 1)) AS INT)]) AS r FROM t),
    sp AS (SELECT output_name, n, CASE WHEN n < 1 THEN NULL WHEN sel IS NULL OR sel = '' OR v = 'all' THEN generate_series(1, n)
          WHEN fine AND list_bool_and(list_transform(r, lambda k: k[1] >= 1 AND k[2] <= n AND k[1] <= k[2])) THEN list_sort(list_distinct(flatten(list_transform(r, lambda k: generate_series(k[1], k[2]))))) END AS pages FROM q)"""


def _selected(spark: SparkSession, d: str) -> DataFrame:
    df = J.upserted(table(spark, d, "output_index")).where("pdf_page_count is not null")
    return df.select("output_name", C("pdf_page_count").alias("n"), J.page_selection(C("pdf_page_selection"), C("pdf_page_count")).alias("pages"))


@query(f"WITH {_INDEX}, {_PAGES} SELECT output_name, n, array_to_string(pages, ' ') AS pages, len(pages) AS n_pages FROM sp")
def q_page_selection(spark: SparkSession, d: str) -> DataFrame:
    df = _selected(spark, d)
    return df.select("output_name", "n", F.array_join(C("pages").cast("array<string>"), " ").alias("pages"), F.when(C("pages").isNotNull(), F.size("pages")).cast("long").alias("n_pages"))


@query(f"""WITH {_INDEX}, {_PAGES}, e AS (SELECT output_name, n, len(pages) AS k, unnest(pages) AS p FROM sp),
    g AS (SELECT output_name, n, k, p, p - row_number() OVER (PARTITION BY output_name ORDER BY p) AS g FROM e),
    i AS (SELECT output_name, n, k, min(p) AS a, max(p) AS b FROM g GROUP BY output_name, n, k, g)
    SELECT output_name, CASE WHEN any_value(k) = any_value(n) THEN 'all' ELSE string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) END AS ranges FROM i GROUP BY output_name""")
def q_page_ranges(spark: SparkSession, d: str) -> DataFrame:
    return _selected(spark, d).where("pages is not null").select("output_name", J.page_ranges(C("pages"), C("n")).alias("ranges"))


@query(f"""WITH {_INDEX}, {_PAGES}, r AS (SELECT output_name, n, pages[1] AS a, pages[-1] AS b FROM sp WHERE pages IS NOT NULL)
    SELECT output_name, a AS first, b AS last, b - a + 1 AS n_pages, array_to_string(generate_series(a, b), ' ') AS pages FROM r""")
def q_page_range(spark: SparkSession, d: str) -> DataFrame:
    df = _selected(spark, d).where("pages is not null").select("output_name", F.element_at("pages", 1).alias("first"), F.element_at("pages", -1).alias("last"))
    return df.withColumn("n_pages", C("last") - C("first") + 1).withColumn("pages", F.array_join(F.sequence("first", "last").cast("array<string>"), " "))


@query(f"""WITH {_INDEX}, {_PAGES}, e AS (SELECT output_name, unnest(generate_series(1, n)) AS page, pages FROM sp)
    SELECT output_name, page, coalesce(list_contains(pages, page), false) AS selected FROM e""")
def q_page_split(spark: SparkSession, d: str) -> DataFrame:
    df = _selected(spark, d).where("n >= 1").select("output_name", F.explode(F.sequence(F.lit(1), C("n"))).alias("page"), "pages")
    return df.select("output_name", "page", F.coalesce(F.array_contains("pages", C("page")), F.lit(False)).alias("selected"))


@query(f"""WITH {_INDEX}, {_PAGES}, p AS (SELECT output_name, unnest(pages) AS page FROM sp),
    c AS (SELECT output_name, unnest(generate_series(1, n)) AS page FROM sp WHERE output_name IN (SELECT output_name FROM x WHERE pdf_recognition_mode = 'ocr') AND n > 0)
    SELECT output_name, page FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.output_name = p.output_name AND c.page = p.page)""")
def q_cache_miss(spark: SparkSession, d: str) -> DataFrame:
    """Selected pages that no cache row covers; pages of recognised outputs count as cached."""
    index = J.upserted(table(spark, d, "output_index"))
    wanted = _selected(spark, d).select("output_name", F.explode("pages").alias("page"))
    cached = index.where("pdf_recognition_mode = 'ocr' and pdf_page_count > 0").select("output_name", F.explode(F.sequence(F.lit(1), C("pdf_page_count"))).alias("page"))
    return wanted.join(cached, ["output_name", "page"], "left_anti")


@query(f"""WITH {_INDEX}, {_PAGES}, e AS (SELECT output_name, unnest(pages) AS page FROM sp), c AS (SELECT output_name, page, page % 4 + 1 AS units FROM e)
    SELECT output_name, page, (coalesce(sum(units) OVER (PARTITION BY output_name ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS first_unit, units FROM c""")
def q_page_slices(spark: SparkSession, d: str) -> DataFrame:
    """Where each page's units start in the flat list; pages have page % 4 + 1 units here."""
    df = _selected(spark, d).select("output_name", F.explode("pages").alias("page")).withColumn("units", C("page") % 4 + 1)
    before = Window.partitionBy("output_name").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return df.select("output_name", "page", F.coalesce(F.sum("units").over(before), F.lit(0)).alias("first_unit"), "units")


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE try_cast(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_id % 7 = 0 AS fell_back FROM events")
def q_json_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh text is broken first; broken JSON gives the empty object."""
    df = table(spark, d, "events").withColumn("raw", F.when(C("event_id") % 7 == 0, F.concat(F.lit("["), "props")).otherwise(C("props")))
    parsed = F.from_json("raw", "k bigint, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return df.select("event_id", parsed["k"].alias("k"), parsed["_bad"].isNotNull().alias("fell_back"))


@query(f"""WITH {_EV} SELECT job_id, seq, '{{"kind":"' || kind || '","done":' || coalesce(done::VARCHAR, 'null') || ',"total":' || coalesce(total::VARCHAR, 'null') || '}}' AS json FROM e""")
def q_json_emit(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("job_id", "seq", F.to_json(F.struct("kind", "done", "total"), {"ignoreNullFields": "false"}).alias("json"))


@query("""SELECT choice_id, attempt, coalesce(content, '') AS content, finish_reason FROM (SELECT DISTINCT choice_id, attempt, content, finish_reason FROM choices)""")
def q_sse_parse(spark: SparkSession, d: str) -> DataFrame:
    """Replies written as server-sent events in two deltas, read again: deltas in order, the last finish reason."""
    df = table(spark, d, "choices").select("choice_id", "attempt", "content", "finish_reason").distinct()
    half = F.expr("cast(length(coalesce(content, '')) div 2 as int)")
    a, b = F.expr("left(coalesce(content, ''), cast(length(coalesce(content, '')) div 2 as int))"), F.substr(F.coalesce("content", F.lit("")), half + 1)

    def event(piece, reason=None):
        choice = F.struct(F.struct(piece.alias("content")).alias("delta"), *([reason.alias("finish_reason")] if reason is not None else []))
        return F.concat(F.lit("data: "), F.to_json(F.struct(F.array(choice).alias("choices"))))

    stream = df.select("choice_id", "attempt", F.posexplode(F.array(F.lit(": keep-alive"), event(a), event(b, C("finish_reason")), F.lit("data: [DONE]"))).alias("n", "line"))
    data = F.when(C("line").startswith("data:"), T.strip(F.substr("line", F.lit(6))))
    read = stream.withColumn("e", F.from_json(F.when(data != "[DONE]", data), "choices array<struct<delta: struct<content: string>, text: string, finish_reason: string>>"))
    c = C("e.choices")[0]
    piece = F.coalesce(c["delta"]["content"], c["text"], F.lit(""))
    out = read.groupBy("choice_id", "attempt").agg(F.sort_array(F.collect_list(F.struct("n", piece.alias("piece"), c["finish_reason"].alias("reason")))).alias("l"))
    reasons = F.filter(F.transform("l", lambda x: x["reason"]), lambda x: x.isNotNull())
    return out.select("choice_id", "attempt", F.array_join(F.transform("l", lambda x: x["piece"]), "").alias("content"), F.try_element_at(reasons, F.lit(-1)).alias("finish_reason"))


@query("""SELECT choice_id, attempt, coalesce(max_tokens, 4096) AS max_tokens, coalesce(finish_reason, 'stop') AS finish_reason, 0.7::DOUBLE AS temperature
    FROM (SELECT DISTINCT choice_id, attempt, max_tokens, finish_reason FROM choices)""")
def q_config_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Settings of a request laid over the defaults."""
    df = table(spark, d, "choices").select("choice_id", "attempt", "max_tokens", "finish_reason").distinct()
    defaults = F.create_map(F.lit("max_tokens"), F.lit("4096"), F.lit("finish_reason"), F.lit("stop"), F.lit("temperature"), F.lit("0.7"))
    own = F.map_filter(F.create_map(F.lit("max_tokens"), C("max_tokens").cast("string"), F.lit("finish_reason"), C("finish_reason")), lambda k, v: v.isNotNull())
    merged = F.map_from_entries(F.concat(F.map_entries(F.map_filter(defaults, lambda k, v: ~F.array_contains(F.map_keys(own), k))), F.map_entries(own)))
    return df.withColumn("m", merged).select("choice_id", "attempt", C("m")["max_tokens"].cast("int").alias("max_tokens"), C("m")["finish_reason"].alias("finish_reason"), C("m")["temperature"].cast("double").alias("temperature"))


@query(f"""WITH {_EV}, k AS (SELECT job_id, kind, min(seq) AS seq FROM e GROUP BY ALL) SELECT job_id, string_agg(kind, ',' ORDER BY seq) AS kinds FROM k GROUP BY job_id""")
def q_ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of a job's events in the order of their first occurrence; at most one row per kind is gathered."""
    first = table(spark, d, "job_events").groupBy("job_id", "kind").agg(F.min("seq").alias("seq"))
    return first.groupBy("job_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "kind"))), lambda x: x["kind"]), ",").alias("kinds"))


@query(f"""WITH {S.UNITS}, p AS (SELECT file_id, line_no, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS n, count(*) OVER (PARTITION BY file_id) AS total FROM u WHERE translate)
    SELECT file_id, 2 * n - 1 AS seq, 'line_done' AS kind, line_no, NULL::BIGINT AS done, total FROM p
    UNION ALL SELECT file_id, 2 * n, 'progress', NULL, n, total FROM p
    UNION ALL SELECT file_id, 0, 'progress', NULL, 0, max(total) FROM p GROUP BY file_id
    UNION ALL SELECT file_id, 2 * max(total) + 1, 'file_done', NULL, NULL, max(total) FROM p GROUP BY file_id""")
def q_event_log(spark: SparkSession, d: str) -> DataFrame:
    """The events that a document's run writes, in order."""
    p = U.translatable(U.document_units(file_lines(spark, d))).select("file_id", "line_no", (C("position") + 1).cast("long").alias("n"))
    p = p.withColumn("total", F.count("*").over(Window.partitionBy("file_id")))
    none = F.lit(None)
    each = p.select("file_id", "total", F.explode(F.array(
        F.struct((2 * C("n") - 1).alias("seq"), F.lit("line_done").alias("kind"), C("line_no"), none.cast("long").alias("done")),
        F.struct((2 * C("n")).alias("seq"), F.lit("progress").alias("kind"), none.cast("int").alias("line_no"), C("n").alias("done")),
    )).alias("e"))
    ends = p.groupBy("file_id").agg(F.max("total").alias("total")).select("file_id", "total", F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("seq"), F.lit("progress").alias("kind"), none.cast("int").alias("line_no"), F.lit(0).cast("long").alias("done")),
        F.struct((2 * C("total") + 1).alias("seq"), F.lit("file_done").alias("kind"), none.cast("int").alias("line_no"), none.cast("long").alias("done")),
    )).alias("e"))
    return each.unionByName(ends).select("file_id", "e.seq", "e.kind", "e.line_no", "e.done", "total")


_PIECES = rf"""'(?s).{{1,40}}'"""


@query(f"""WITH c AS (SELECT DISTINCT choice_id, attempt, content FROM choices WHERE content <> ''), p AS (SELECT choice_id, attempt, regexp_extract_all(content, {_PIECES}) AS p FROM c)
    SELECT choice_id, attempt, unnest(generate_series(1, len(p))) AS delta, unnest([array_to_string(p[1:i], '') FOR i IN generate_series(1, len(p))]) AS preview FROM p""")
def q_cumulative_preview(spark: SparkSession, d: str) -> DataFrame:
    """What a reader sees after each delta of a reply; deltas have 40 characters here."""
    df = table(spark, d, "choices").where("content <> ''").select("choice_id", "attempt", "content").distinct()
    df = df.withColumn("p", F.regexp_extract_all("content", F.lit("(?s).{1,40}"), F.lit(0)))
    return df.select("choice_id", "attempt", F.posexplode("p").alias("i", "_"), "p").select("choice_id", "attempt", (C("i") + 1).cast("long").alias("delta"), F.array_join(F.slice("p", F.lit(1), C("i") + 1), "").alias("preview"))


@query(f"""WITH {_INDEX}, {S.FILES} SELECT x.output_name, CASE WHEN x.source_format = 'pdf' THEN x.preview_content ELSE coalesce(x.preview_content, {S.normalized("f.translated_content")}) END AS preview
    FROM x LEFT JOIN f ON f.name = x.source_name AND f.source_sha256 = x.source_sha256""")
def q_output_preview(spark: SparkSession, d: str) -> DataFrame:
    """What a reader sees of an output: the stored preview of a PDF, else the text itself without its BOM."""
    index = J.upserted(table(spark, d, "output_index")).select("output_name", C("source_name").alias("name"), "source_sha256", C("source_format").alias("form"), "preview_content")
    both = index.join(files(spark, d, "name", "source_sha256", "translated_content"), ["name", "source_sha256"], "left")
    text = F.coalesce("preview_content", T.normalized(C("translated_content")))
    return both.select("output_name", F.when(C("form") == "pdf", C("preview_content")).otherwise(text).alias("preview"))


@query(f"""WITH {_INDEX} SELECT output_name, CASE WHEN pdf_page_count IS NULL THEN NULL WHEN lower({S.strip("coalesce(pdf_recognition_mode, '')")}) = 'ocr' THEN '1' ELSE 'all' END AS preselected,
    CASE WHEN lower({S.strip("coalesce(pdf_recognition_mode, '')")}) IN ('auto', 'text', 'ocr') THEN lower({S.strip("pdf_recognition_mode")}) ELSE 'auto' END AS mode FROM x""")
def q_import_selection(spark: SparkSession, d: str) -> DataFrame:
    """Recognition mode, auto if it is none, and the pages an import starts with: one of a scan, else all."""
    mode = F.lower(T.strip(F.coalesce("pdf_recognition_mode", F.lit(""))))
    df = J.upserted(table(spark, d, "output_index"))
    return df.select("output_name", F.when(C("pdf_page_count").isNotNull(), F.when(mode == "ocr", "1").otherwise("all")).alias("preselected"), F.when(mode.isin("auto", "text", "ocr"), mode).otherwise("auto").alias("mode"))


@query(f"""SELECT job_id, CASE WHEN lower({S.strip("kind")}) IN ('full', 'neighbor', 'unit') THEN lower({S.strip("kind")}) ELSE 'neighbor' END AS context_mode,
    CASE WHEN status IN ('strong', 'possible', 'separate') THEN status END AS hint FROM (SELECT DISTINCT job_id, kind, status FROM jobs)""")
def q_mode_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Unknown context modes become neighbor, unknown hints null; job kinds and states stand in for them."""
    kind = F.lower(T.strip(C("kind")))
    return _jobs(spark, d).select("job_id", "kind", "status").distinct().select("job_id", F.when(kind.isin("full", "neighbor", "unit"), kind).otherwise("neighbor").alias("context_mode"), F.when(C("status").isin("strong", "possible", "separate"), C("status")).alias("hint"))


@query(f"""WITH {_EV}, z AS (SELECT job_id, max(seq) AS last FROM e GROUP BY ALL)
    SELECT job_id, seq, 'data: {{"kind":"' || kind || '","seq":' || seq || '}}' || chr(10) || chr(10) || CASE WHEN seq = last THEN ': end' || chr(10) || chr(10) ELSE '' END AS frame FROM e JOIN z USING (job_id)""")
def q_event_frames(spark: SparkSession, d: str) -> DataFrame:
    """Events as server-sent frames; the last one of a job is followed by a closing comment."""
    e = _events(spark, d).select("job_id", "seq", "kind")
    # One row a job meets its events by (job_id, seq), which no job makes hot.
    ends = table(spark, d, "job_events").groupBy("job_id").agg(F.max("seq").alias("seq")).withColumn("last", F.lit(True))
    frame = F.concat(F.lit("data: "), F.to_json(F.struct("kind", "seq")), F.lit("\n\n"), F.when(C("last"), ": end\n\n").otherwise(""))
    return e.join(ends, ["job_id", "seq"], "left").select("job_id", "seq", frame.alias("frame"))


@query(f"""WITH x AS (SELECT DISTINCT output_name, written_at, length(coalesce(preview_content, '')) AS size, coalesce(pdf_page_count, 0) % 2 AS version FROM output_index), {_INDEX.replace("x AS", "nx AS", 1)}
    SELECT x.output_name AS source_id, x.version::INT AS version, x.size, x.written_at AS mtime, coalesce(x.version = 1 AND x.size = length(coalesce(nx.preview_content, '')) AND x.written_at = nx.written_at, false) AS valid
    FROM x LEFT JOIN nx USING (output_name)""")
def q_ocr_cache_valid(spark: SparkSession, d: str) -> DataFrame:
    """Recognition caches against the files as they are: every write of an output stands for a cache, the last for the file."""
    index = table(spark, d, "output_index")
    size = F.length(F.coalesce("preview_content", F.lit("")))
    now = J.upserted(index).select(C("output_name").alias("source_id"), size.alias("size"), C("written_at").alias("mtime"))
    caches = index.select(C("output_name").alias("source_id"), (F.coalesce("pdf_page_count", F.lit(0)) % 2).cast("int").alias("version"), size.alias("size"), C("written_at").alias("mtime")).distinct()
    return J.cache_states(now, caches)


@query(f"""WITH {_INDEX}, {S.FILES}, r AS (SELECT job_id, name AS output_name, translated_content AS content FROM f WHERE translated_content IS NOT NULL)
    SELECT job_id, r.output_name, sha256(coalesce(x.preview_content, r.content)) AS digest, x.preview_content IS NOT NULL AS edited
    FROM r LEFT JOIN x ON x.source_name = r.output_name WHERE NOT coalesce(x.target_language = '日文', false)""")
def q_job_results(spark: SparkSession, d: str) -> DataFrame:
    """Results of jobs after the index: a stored preview is an edit of the output, an index entry in Japanese a deletion."""
    index = J.upserted(table(spark, d, "output_index")).select(C("source_name").alias("output_name"), "preview_content", "target_language")
    results = files(spark, d, "job_id", "name", "translated_content").where("translated_content is not null").select("job_id", C("name").alias("output_name"), C("translated_content").alias("content"))
    out = J.rewritten(results, index.where("preview_content is not null").select("output_name", C("preview_content").alias("new")), index.where("target_language = '日文'"))
    return out.select("job_id", "output_name", F.sha2("content", 256).alias("digest"), "edited")


@query("SELECT coalesce(kind, 'document') AS kind, arg_min(job_id, (created_at, job_id)) AS job_id FROM jobs WHERE status = 'running' GROUP BY 1")
def q_running_job(spark: SparkSession, d: str) -> DataFrame:
    return J.first_running(table(spark, d, "jobs"))


@query(f"""WITH {S.UNITS}, jb AS (SELECT DISTINCT job_id, status, coalesce(done, 0) AS done FROM jobs),
    n AS (SELECT file_id, count_if(translate) AS n FROM u GROUP BY ALL),
    o AS (SELECT f.file_id, f.job_id, translated_content IS NULL AS failed, coalesce(n.n, 0) AS n, row_number() OVER (PARTITION BY f.job_id ORDER BY idx, f.file_id) - 1 AS turn FROM f LEFT JOIN n ON n.file_id = f.file_id),
    k AS (SELECT o.*, status, CASE WHEN status = 'interrupted' AND turn > done THEN 0 WHEN status = 'interrupted' AND turn = done THEN 1 WHEN failed THEN 3 ELSE 3 * n + 4 END AS size FROM o JOIN jb USING (job_id)),
    b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY job_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM k),
    lu AS (SELECT b.job_id, b.file_id, base, line_no, row_number() OVER (PARTITION BY b.file_id ORDER BY line_no) AS i FROM b JOIN u ON u.file_id = b.file_id AND u.translate WHERE size = 3 * n + 4 AND NOT failed AND size > 1),
    ev AS (SELECT job_id, base + 1 AS seq, 'progress' AS kind, file_id, NULL::BIGINT AS line_no, turn AS done FROM b WHERE size > 0
           UNION ALL SELECT job_id, base + 2, 'file_progress', file_id, NULL, 0 FROM b WHERE size > 3
           UNION ALL SELECT job_id, base + 3 * i, 'chunk', file_id, line_no, NULL FROM lu
           UNION ALL SELECT job_id, base + 3 * i + 1, 'line_done', file_id, line_no, NULL FROM lu
           UNION ALL SELECT job_id, base + 3 * i + 2, 'file_progress', file_id, NULL, i FROM lu
           UNION ALL SELECT job_id, base + size - 1, CASE WHEN failed THEN 'fail' ELSE 'file_done' END, file_id, NULL, NULL FROM b WHERE size > 1
           UNION ALL SELECT job_id, base + size, 'overall_progress', file_id, NULL, turn + 1 FROM b WHERE size > 1
           UNION ALL SELECT job_id, sum(size) + 1, CASE WHEN any_value(status) = 'interrupted' THEN 'interrupted' ELSE 'done' END, NULL, NULL, NULL FROM b WHERE status <> 'running' GROUP BY job_id)
    SELECT job_id, seq::BIGINT AS seq, kind, file_id, line_no, done::BIGINT AS done FROM ev""")
def q_job_events(spark: SparkSession, d: str) -> DataFrame:
    """All nine kinds of events that the run of each job writes, in order. A file without an answer fails; an interrupted
    job stops while its next file is at work; a running one has no end yet."""
    jobs = _jobs(spark, d).select("job_id", "status", F.coalesce("done", F.lit(0)).alias("stop")).distinct()
    units = U.translatable(U.document_units(file_lines(spark, d))).select("file_id", "line_no", (C("position") + 1).cast("long").alias("i"))
    own = files(spark, d, "job_id", "idx", C("translated_content").isNull().alias("failed")).withColumn("first", F.lit(False))
    order = J.turns(own, 1024).withColumn("turn", C("turn").cast("long") - 1)
    order = order.join(units.groupBy("file_id").agg(F.count("*").alias("n")), "file_id", "left").fillna(0, ["n"]).join(jobs, "job_id")
    stopped = C("status") == "interrupted"
    size = F.when(stopped & (C("turn") > C("stop")), 0).when(stopped & (C("turn") == C("stop")), 1).when(C("failed"), 3).otherwise(3 * C("n") + 4)
    b = J.running(order.withColumn("size", size.cast("long")), "job_id", "turn", "size")
    none = F.lit(None).cast("long")

    def event(seq, kind, line_no=none, done=none):
        return F.struct(seq.cast("long").alias("seq"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), line_no.cast("long").alias("line_no"), done.cast("long").alias("done"))

    base, n = C("before"), C("size")
    frame = F.array(
        F.when(n > 0, event(base + 1, "progress", done=C("turn"))), F.when(n > 3, event(base + 2, "file_progress", done=F.lit(0))),
        F.when(n > 1, event(base + n - 1, F.when(C("failed"), "fail").otherwise("file_done"))), F.when(n > 1, event(base + n, "overall_progress", done=C("turn") + 1)),
    )
    around = b.select("job_id", "file_id", F.explode(F.array_compact(frame)).alias("e"))
    at = base + 3 * C("i")
    each = F.array(event(at, "chunk", C("line_no")), event(at + 1, "line_done", C("line_no")), event(at + 2, "file_progress", done=C("i")))
    inside = b.where("size > 3").join(units, "file_id").select("job_id", "file_id", F.explode(each).alias("e"))
    last = b.where("status <> 'running'").groupBy("job_id").agg((F.sum("size") + 1).alias("seq"), F.any_value(F.when(stopped, "interrupted").otherwise("done")).alias("kind"))
    ends = last.select("job_id", F.lit(None).cast("long").alias("file_id"), event(C("seq"), C("kind")).alias("e"))
    return around.unionByName(inside).unionByName(ends).select("job_id", "e.seq", "e.kind", "file_id", "e.line_no", "e.done")


@query(f"""WITH {S.DOCS}, p AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM dl WHERE {S.strip("line")} <> ''),
    n AS (SELECT dn.doc_id, count(p.i) AS n FROM dn LEFT JOIN p USING (doc_id) GROUP BY ALL)
    SELECT doc_id, 0::BIGINT AS seq, 'dialog_progress' AS kind, NULL::BIGINT AS line_no, 0::BIGINT AS done, n AS total FROM n
    UNION ALL SELECT doc_id, 2 * i - 1, 'dialog_chunk', line_no, NULL, NULL FROM p
    UNION ALL SELECT doc_id, 2 * i, 'dialog_progress', NULL, i, n FROM p JOIN n USING (doc_id)
    UNION ALL SELECT doc_id, 2 * n + 1, 'dialog_done', NULL, NULL, NULL FROM n UNION ALL SELECT doc_id, 2 * n + 2, 'done', NULL, NULL, 1 FROM n""")
def q_dialog_events(spark: SparkSession, d: str) -> DataFrame:
    """A text as a dialog: plain units, no output, events of its own kinds."""
    lines_ = document_lines(spark, d).withColumn("worded", T.strip(C("line")) != "")
    whole = Window.partitionBy("doc_id")
    p = lines_.select("doc_id", "line_no", "worded", F.count_if("worded").over(whole.orderBy("line_no")).alias("i"), F.count_if("worded").over(whole).alias("n"))
    none = F.lit(None).cast("long")

    def event(seq, kind, line_no=none, done=none, total=none):
        return F.struct(seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), line_no.cast("long").alias("line_no"), done.cast("long").alias("done"), total.cast("long").alias("total"))

    i, n = C("i"), C("n")
    each = F.array(event(2 * i - 1, "dialog_chunk", C("line_no")), event(2 * i, "dialog_progress", done=i, total=n))
    around = F.array(event(F.lit(0), "dialog_progress", done=F.lit(0), total=n), event(2 * n + 1, "dialog_done"), event(2 * n + 2, "done", total=F.lit(1)))
    ends = p.where("line_no = 0").select("doc_id", F.explode(around).alias("e"))
    return p.where("worded").select("doc_id", F.explode(each).alias("e")).unionByName(ends).select("doc_id", "e.*")
