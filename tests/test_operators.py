"""Small fixtures with known answers for the operators of units, contexts, jobs, layout and containers."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.parts import shares
from lectern.operators import context as X
from lectern.operators import jobs as J
from lectern.operators import layout as L
from lectern.operators import units as U
from lectern.sinks.files import text_outputs, write_files
from lectern.sources import containers as K
from lectern.sources.tables import lines


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'int' if isinstance(values[n], int) else 'string'}" for n in names))
    return df.select(column.alias("x")).first().x


def units_of(spark, content, name):
    df = spark.createDataFrame([(1, content, name)], "file_id long, content string, name string").withColumn("t", T.normalized(F.col("content"))).withColumn("ext", T.extension(F.col("name")))
    return U.document_units(lines(df, "file_id", "ext")).orderBy("line_no").collect()


def test_markdown_units(spark):
    rows = units_of(spark, '# Chapter\nFirst line.\n\n- Second "quoted" line.\n> Third line.', "a.md")
    assert [r.line_no for r in rows if r.unit.translate] == [0, 1, 3, 4]
    assert [r.unit.prefix for r in rows if r.unit.translate] == ["# ", "", "- ", "> "]
    fenced = units_of(spark, "~~~\n# code\n```\n# text", "a.md")
    assert [r.unit.translate for r in fenced] == [False, False, False, True]


def test_subtitles_with_bom_and_crlf(spark):
    rows = units_of(spark, "﻿1\r\n00:00:01,000 --> 00:00:02,000\r\nHello\r\n", "a.srt")
    assert [r.unit.text for r in rows if r.unit.translate] == ["Hello"]
    vtt = units_of(spark, "WEBVTT\n\nintro\n00:01.000 --> 00:02.000 align:start\nOne\n\nNOTE a\nhidden\n\n00:03.000 --> 00:04.000\nTwo", "a.vtt")
    assert [r.unit.text for r in vtt if r.unit.translate] == ["One", "Two"]


def test_containers_lines_are_plain(spark):
    rows = units_of(spark, "# not a heading\n---", "a.docx")
    assert [r.unit.text for r in rows] == ["# not a heading", "---"]


@pytest.mark.parametrize("text,eol", [("", "lf"), (None, "lf"), ("a\rb\r", "cr"), ("a\r\nb\n", "crlf"), ("a\nb\r", "lf"), ("a\r\nb\n\n", "lf")])
def test_line_ending(spark, text, eol):
    assert one(spark, T.line_ending(F.col("t")), t=text) == eol


def test_names(spark):
    for name, target, want in [("dir\\a.b.md", "英文", "a.b.en.md"), ("", "中文", "translated.zh.md"), ("x", "?", "x.translated.md"), (".hidden", "日文", ".hidden.ja.md")]:
        assert one(spark, T.output_name(F.col("n"), F.col("t")), n=name, t=target) == want


def test_languages(spark):
    for text, want in [("かな", "日文"), ("한", "韩文"), ("們說", "繁体中文"), ("们说", "中文"), ("abc", "英文"), ("123", "中文"), ("abc ж", "俄文")]:
        assert one(spark, T.detected_language(F.col("t")), t=text) == want


def test_page_selection(spark):
    for text, want in [("1,3-5,8", [1, 3, 4, 5, 8]), ("all", list(range(1, 11))), ("", list(range(1, 11))), ("1,,3", None), ("0,2", None), ("2-1", None), ("1,11", None), ("x", None)]:
        assert one(spark, J.page_selection(F.col("s"), F.lit(10)), s=text) == want
    assert one(spark, J.page_ranges(J.page_selection(F.col("s"), F.lit(10)), F.lit(10)), s="8,1,3-4,5") == "1,3-5,8"


def test_retention_skips_what_is_too_large(spark):
    df = spark.createDataFrame([("a", 3, 10), ("b", 2, 10), ("c", 1, 2)], "job_id string, at int, chars long")
    assert [r.job_id for r in J.retained(df, 50, 12).collect()] == ["a", "c"]


def test_reading_order_of_two_columns(spark):
    boxes = [(1, "title", 50, 550, 20, 40), (2, "left 1", 50, 250, 60, 80), (3, "right 1", 330, 520, 60, 80), (4, "left 2", 52, 250, 85, 100), (5, "right 2", 331, 500, 85, 100), (6, "7", 290, 310, 780, 790)]
    df = spark.createDataFrame([(1, b[0], b[1], *map(float, b[2:])) for b in boxes], "page long, box int, text string, x0 double, x1 double, top double, bottom double")
    out = L.reading_order(df, 600.0, 800.0).orderBy("region", "column", "position").collect()
    assert [r.text for r in out] == ["title", "left 1", "left 2", "right 1", "right 2", "7"]
    assert out[1].column_count == 2 and out[0].spanning and out[-1].footer


def test_shares_and_cuts_agree(spark):
    text, weights = "one two, three four five six seven", [3, 5, 9, 2]
    df = spark.createDataFrame([(text, weights)], "t string, w array<int>")
    cuts = df.select(T.partition_cuts(F.col("t"), F.col("w")).alias("c")).first().c
    parts = shares(text, weights)
    assert "".join(parts) == text and [len("".join(parts[: i + 1])) for i in range(3)] == cuts


def test_sub_units():
    long = "Some words here. " * 200
    parts = X.sub_units(long, 100, X.tokens_of)
    assert len(parts) > 1 and all(X.tokens_of(p) <= 100 for p in parts) and " ".join(parts).split() == long.split()
    assert X.sub_units("short", 100, X.tokens_of) == ["short"]
    assert "".join(X.sub_units("字" * 500, 100, X.tokens_of)) == "字" * 500


def test_containers(spark):
    docx = K.packed(["Hello world", "Table cell & more"], "docx")
    assert [u[3] for u in K.extract(docx, "docx")] == ["Hello world", "Table cell & more"]
    again = K.build(docx, ["译 <a>", " x "], "docx")
    assert [u[3] for u in K.extract(again, "docx")] == ["译 <a>", "x"]
    for wrong in (["one"], ["a", "b", "c"], ["a", "\x01"]):
        with pytest.raises(K.ContainerError):
            K.build(docx, wrong, "docx")
    for data in (b"", b"no zip", K.packed([], "docx"), K.packed(["a"], "epub")):
        with pytest.raises(K.ContainerError):
            list(K.extract(data, "docx"))
    rows = K.container_units(spark.createDataFrame([(1, bytearray(docx)), (2, bytearray(b"x")), (3, None)], "k long, c binary"), "k", "c", "docx").collect()
    assert sorted((r.key, r.text is None) for r in rows) == [(1, False), (1, False), (2, True), (3, True)]


def epub(body, extra=None):
    data = io.BytesIO(K.packed(["x"], "epub"))
    out = io.BytesIO()
    with zipfile.ZipFile(data) as a, zipfile.ZipFile(out, "w") as b:
        for i in a.infolist():
            b.writestr(i, f'<?xml version="1.0"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml"><body>{body}</body></html>' if i.filename.endswith("xhtml") else a.read(i))
        for k, v in (extra or {}).items():
            b.writestr(k, v)
    return out.getvalue()


def test_epub_blocks_entities_and_encryption():
    book = epub("<div>Intro <b>bold</b><p>One<br/>two&nbsp;three</p>tail<script>no</script> end</div><!-- c -->")
    assert [u[3] for u in K.extract(book, "epub")] == ["Intro bold", "One two three", "tail end"]
    built = K.build(book, ["A B", "C", "D"], "epub")
    assert [u[3] for u in K.extract(built, "epub")] == ["A B", "C", "D"] and b"<!DOCTYPE html>" in zipfile.ZipFile(io.BytesIO(built)).read("OPS/a.xhtml")
    assert zipfile.ZipFile(io.BytesIO(built)).infolist()[0].filename == "mimetype"
    locked = {"META-INF/encryption.xml": '<e><CipherReference URI="OPS/a.xhtml"/></e>'}
    with pytest.raises(K.ContainerError):
        list(K.extract(epub("<p>x</p>", locked), "epub"))
    assert list(K.extract(epub("<p>x</p>", {"META-INF/encryption.xml": '<e><CipherReference URI="OPS/f.otf"/></e>'}), "epub"))


def test_text_sink(spark, tmp_path):
    df = spark.createDataFrame([("a.txt", "x\ny", "crlf", True), ("b.txt", None, None, None)], "output_name string, content string, text_eol string, text_bom boolean")
    write_files(text_outputs(df), str(tmp_path))
    assert (tmp_path / "a.txt").read_bytes() == b"\xef\xbb\xbfx\r\ny" and (tmp_path / "b.txt").read_bytes() == b"" and len(list(tmp_path.iterdir())) == 2


def test_pdf_needs_its_library(spark):
    from lectern.sources import pdf

    if pdf.pypdf is None:
        with pytest.raises(RuntimeError):
            pdf.pdf_pages(spark.createDataFrame([], "k long, c binary"), "k", "c")


def pipeline_units(spark, content):
    df = spark.createDataFrame([(1, content, "a.txt"), (2, "solo", "b.txt")], "file_id long, t string, name string").withColumn("ext", T.extension(F.col("name")))
    return U.document_units(lines(df, "file_id", "ext"))


def test_pipeline_resumes_and_retries(spark):
    from lectern.operators import pipeline as P

    resume = spark.createDataFrame([(1, 0, "译：One!"), (1, 2, " ")], "file_id long, line_no int, text string")
    rows = P.translate_units(pipeline_units(spark, "One.\n\n- Two.\nThree."), P.flaky(P.stub_model, 0.3, 1), P.Settings(retries=30), resume).orderBy("file_id", "line_no").collect()
    assert [(r.line_no, r.out, r.resumed) for r in rows if r.file_id == 1] == [(0, "译：One!", True), (2, "- 译：Two.", False), (3, "译：Three.", False)]


def test_pipeline_errors_end_one_document(spark):
    from lectern.operators import pipeline as P

    def model(prompt, size):
        if "Two" in prompt.rpartition("】\n")[2]:
            raise P.ServiceError(400)
        return P.stub_model(prompt, size)

    rows = P.translate_units(pipeline_units(spark, "One.\nTwo.\nThree."), model).orderBy("file_id", "line_no").collect()
    assert [r.error is None for r in rows] == [True, False, False, True]


def test_replies_cut_for_length_get_more_room():
    from lectern.operators import pipeline as P

    asked = []

    def model(prompt, size):
        asked.append(size)
        return "x", "length" if size < 2000 else "stop"

    assert P.complete(model, "p", 400, 3000, 9) == "x" and asked == [400, 700, 1225, 2143]
    with pytest.raises(P.LengthError):
        P.complete(model, "p", 400, 1000, 9)
    waits = []
    with pytest.raises(P.ServiceError):
        P.complete(P.flaky(P.stub_model, 2, 0), "p", 400, 1000, 3, waits.append)
    assert waits == [0.0, 0.0]


def test_history_is_capped():
    from lectern.operators import pipeline as P

    history = [(f"s{i}", f"t{i}") for i in range(6)]
    assert P.recent(history, P.Settings(context_units=3)).count("[原文]") == 3
    assert P.recent(history, P.Settings(context_mode="unit")) == ""
    assert P.recent([("x" * 9000, "y")], P.Settings(context_size=2048)) == ""


def test_fitting():
    from lectern.functions.fitting import fitted, wrapped

    assert wrapped("aa bb cc", 10, 30) == ["aa bb", "cc"] and wrapped("abcdefgh", 10, 20) == ["abcd", "efgh"] and wrapped("", 10, 20) == [""]
    size, lines_ = fitted("one two three four", 40, 30, 12)
    assert size < 12 and size * 1.15 + (len(lines_) - 1) * size * 1.2 <= 30.01
    assert fitted("word " * 500, 40, 20, 12) is None and fitted("a", 100, 30, 12)[0] == 12


def test_cache_and_archives(spark, tmp_path):
    import hashlib

    from lectern.sinks.files import write_archives
    from lectern.sources.cache import binary_files, verified

    data = K.packed(["a"], "docx")
    good = "0" * 32 + ".docx"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / good).write_bytes(data)
    manifest = [(good, hashlib.sha256(data).hexdigest(), "docx"), ("1" * 32 + ".epub", "x", "epub"), ("x.docx", "x", "docx"), (good, "0", "docx"), (good, "0", "pdf")]
    states = verified(binary_files(spark, str(tmp_path / "in")), spark.createDataFrame(manifest, "source_id string, source_sha256 string, source_format string"))
    assert sorted(r.state for r in states.collect()) == ["bad_id", "digest", "format", "missing", "ok"]
    rows = spark.createDataFrame([("j", "a.txt", bytearray(b"1")), ("j", "b.txt", bytearray(b"2")), ("k", "a.txt", None)], "job_id string, output_name string, content binary")
    write_archives(rows, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["j.zip", "k.zip"]
    assert zipfile.ZipFile(tmp_path / "out" / "j.zip").namelist() == ["a.txt", "b.txt"]


def test_streams_survive_a_second_start(spark, tmp_path):
    from lectern.streaming import events as E

    events = spark.createDataFrame([("j", i, "chunk", 1, "f", 0, i % 2, f"t{i}", None, 3, None, None) for i in range(400)], E.EVENTS)
    events.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        out = E.run_available(E.latest_partials(E.event_stream(spark, str(tmp_path / "in"))), ["job_id", "file_id", "line_no"], ["seq"], str(tmp_path / "state"))
        assert sorted((r.line_no, r.text) for r in out.collect()) == [(0, "t398"), (1, "t399")]
    tail = E.run_available(E.bounded_tail(E.event_stream(spark, str(tmp_path / "in"))), ["job_id"], [], str(tmp_path / "tail")).first()
    assert list(tail.seqs) == list(range(144, 400))


def test_reference_windows_are_trimmed(spark):
    def loop(lines_, first, last, budget):
        left, right = max(0, first - 2), min(len(lines_), last + 2)
        while X.tokens_of(text := "\n".join(lines_[left:right]).strip()) > budget:
            if left < first:
                left += 1
            elif right > last:
                right -= 1
            elif last - first > 1:
                last -= 1
                right = last
            else:
                return ""
        return text

    rows = [[f"line {i} " + "x" * (i * 7 % 40) for i in range(9)]]
    df = spark.createDataFrame([([(i, x) for i, x in enumerate(rows[0])],)], "u array<struct<line_no: int, line: string>>")
    for first, last in ((0, 3), (2, 5), (4, 9), (8, 9)):
        for budget in (200, 60, 45, 30, 20, 12, 5):
            got = df.select(X.trimmed(F.col("u"), F.lit(first), F.lit(last), 2, 2, budget).alias("x")).first().x
            assert got == loop(rows[0], first, last, budget), (first, last, budget)


def test_names_that_collide_in_one_job(spark, tmp_path):
    from lectern.plans.catalogue import QUERIES

    rows = [(1, "j", "Straße.md"), (2, "j", "STRASSE.md"), (3, "j", "other.md"), (4, "k", "straße.md"), (5, "j", None), (6, "j", None)]
    df = spark.createDataFrame(rows, "file_id long, job_id string, name string").withColumn("source_format", F.lit("md")).withColumn("content", F.lit("x"))
    df.write.parquet(str(tmp_path / "files.parquet"))
    spark.createDataFrame([], "file_id long, line_no int, text string").write.parquet(str(tmp_path / "resume_lines.parquet"))
    assert [tuple(r) for r in QUERIES["q_duplicate_names"](spark, str(tmp_path)).collect() if r.key] == [("j", "strasse.md", 2)]
    assert sorted(r.file_id for r in QUERIES["q_request_violations"](spark, str(tmp_path)).where("rule = 'twice'").collect()) == [1, 2]


def test_index_over_itself_and_cleared(spark, tmp_path):
    from lectern.sinks.files import clear_index, write_index

    path = str(tmp_path / "index")
    schema = "output_name string, source_sha256 string, source_name string, written_at int"
    write_index(spark.createDataFrame([("a", "1", "x", 1), ("b", "2", "y", 1)], schema), spark.createDataFrame([], schema), path)
    write_index(spark.read.parquet(path), spark.createDataFrame([("a", "3", "x", 2), ("c", "4", "z", 2)], schema), path)
    assert sorted((r.output_name, r.source_sha256) for r in spark.read.parquet(path).collect()) == [("a", "3"), ("b", "2"), ("c", "4")]
    assert clear_index(spark, path) == 3 and clear_index(spark, path) == 0


def test_cached_source_is_whole_or_not_there(tmp_path):
    from lectern.sinks.files import cache_source, delete_source

    folder = tmp_path / "cache"
    source, digest = cache_source(str(folder), "a.DOCX", b"data")
    assert (folder / source).read_bytes() == b"data" and source.endswith(".docx") and len(digest) == 64
    (folder / f"{source}.ocr.json").write_text("{}")

    def fail():
        raise OSError("disk")

    with pytest.raises(OSError):
        cache_source(str(folder), "b.pdf", b"data", fail)
    assert sorted(x.name for x in folder.iterdir()) == [source, f"{source}.ocr.json"]
    assert delete_source(str(folder), source) and not delete_source(str(folder), source) and not list(folder.iterdir())
    for name, data in (("a.txt", b"x"), ("a.pdf", b"")):
        with pytest.raises(ValueError):
            cache_source(str(folder), name, data)
    with pytest.raises(ValueError):
        delete_source(str(folder), "../a.pdf")


def test_archive_takes_what_came_out_well(spark):
    from lectern.sinks.files import finished

    rows = spark.createDataFrame([("j", "a", "1", "ok"), ("j", "b", "2", "error"), ("j", "c", "3", "ok")], "job_id string, output_name string, content string, status string")
    disk = spark.createDataFrame([("c", "edited"), ("d", "x")], "output_name string, content string")
    assert sorted(tuple(r) for r in finished(rows, disk).collect()) == [("j", "a", "1"), ("j", "c", "edited")]
    assert finished(rows).count() == 2


def test_transport_failures_are_tried_again():
    from lectern.operators import pipeline as P

    waits, calls = [], iter([TimeoutError("late"), P.ServiceError(503, 90.0), ConnectionError("gone"), ("done", "stop")])

    def model(prompt, size):
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert P.complete(model, "p", 100, 1000, 5, waits.append) == "done" and waits == [1.5, 60.0, 6.0]
    for error in (P.ServiceError(400), P.LengthError("long")):
        calls = iter([error])
        with pytest.raises(type(error)):
            P.complete(model, "p", 100, 1000, 5, waits.append)


def test_checkpoint_with_two_texts_for_a_line_is_asked_again(spark):
    from lectern.operators import pipeline as P

    df = spark.createDataFrame([(1, "One.\nTwo.", "a.txt")], "file_id long, t string, name string").withColumn("ext", T.extension(F.col("name")))
    resume = spark.createDataFrame([(1, 0, "A"), (1, 0, "B"), (1, 1, "C"), (1, 1, "C")], "file_id long, line_no int, text string")
    rows = P.translate_units(U.document_units(lines(df, "file_id", "ext")), P.stub_model, resume=resume).collect()
    assert sorted((r.line_no, r.out, r.resumed) for r in rows) == [(0, "译：One.", False), (1, "C", True)]


def test_heading_starts_a_block(spark):
    rows = [(1, 0, 0, 0, "first words of text", 40.0, 300.0, 10.0, 20.0), (1, 0, 0, 1, "CHAPTER TWO", 40.0, 300.0, 22.0, 32.0), (1, 0, 0, 2, "and more-", 40.0, 300.0, 34.0, 44.0), (1, 0, 0, 3, "over text", 41.0, 310.0, 46.0, 56.0), (1, 0, 1, 0, "next column", 340.0, 500.0, 48.0, 58.0), (2, 0, 0, 0, "next page", 40.0, 300.0, 58.0, 68.0)]
    df = spark.createDataFrame(rows, 'page long, region int, column int, position int, text string, x0 double, x1 double, top double, bottom double')
    got = sorted((r.page, r.block, r.text, r.n) for r in L.ocr_blocks(df, 600.0, 800.0).collect())
    # What follows a heading closely joins it; the heading itself joins nothing.
    assert got == [(1, 0, "first words of text", 1), (1, 1, "CHAPTER TWO and moreover text", 3), (1, 2, "next column", 1), (2, 0, "next page", 1)]


def test_running_sums_in_buckets_and_blocks(spark):
    df = spark.createDataFrame([(k, i, i % 3) for k, n in (("a", 40), ("b", 1)) for i in range(n)], "k string, i long, v long")
    got = {(r.k, r.i): r.before for r in J.running(df, "k", "i", "v", 7).collect()}
    assert got == {(k, i): sum(j % 3 for j in range(i)) for k, i in got} and len(got) == 41
    for n in (0, 1, 7, 8, 30):
        a = spark.createDataFrame([(list(range(n)),)], "a array<int>").select(T.running(F.col("a"), 7).alias("s")).first().s
        assert a == [sum(range(i)) for i in range(n + 1)]


def test_retention_skips_a_job_too_large(spark):
    jobs = spark.createDataFrame([("a", 5, 80), ("b", 4, 30), ("c", 3, 20), ("d", 2, 1), ("e", 1, 0)], "job_id string, at int, chars long")
    assert sorted(r.job_id for r in J.retained(jobs, 3, 100).collect()) == ["a", "c", "e"]
    assert [r.job_id for r in J.retained(jobs, 1, 10).collect()] == ["a"]


def test_xhtml_with_named_entities():
    assert [K.xhtml_state(x) for x in (b"<a>x</a>", b"<a>x&nbsp;&amp;y</a>", b"<a><b></a>", b"")] == ["xml", "spelled", "rejected", "rejected"]
