"""Fixtures on what the queries must not leave out."""

from lectern.operators import context as X
from lectern.plans.catalogue import QUERIES


def tables(spark, folder, files, resume=()):
    spark.createDataFrame(files, "file_id long, name string, content string, target_language string").write.parquet(f"{folder}/files.parquet")
    spark.createDataFrame(list(resume), "file_id long, line_no int, text string").write.parquet(f"{folder}/resume_lines.parquet")
    return str(folder)


def pieces(text, limit):
    """The loop that takes one sentence after the other; no sentence of the fixtures is above the limit itself."""
    out, held = [], ""
    for sentence in text.replace(". ", ". \0").split("\0"):
        if held and X.tokens_of(held + sentence) > limit:
            out.append(held.strip())
            held = ""
        held += sentence
    return [*out, held.strip()]


def test_pipeline_returns_lines_above_the_limit(spark, tmp_path):
    long = "".join(f"Sentence {i} has some words. " for i in range(600)).strip()
    want = pieces(long, 2048)
    assert len(want) > 2
    d = tables(spark, tmp_path, [(1, "a.md", f"# Short.\n{long}\n- End.", "中文"), (2, "b.txt", long, "中文")], [(2, 0, "done")])
    rows = QUERIES["q_pipeline"](spark, d).orderBy("file_id", "line_no").collect()
    assert [(r.file_id, r.line_no, r.resumed) for r in rows] == [(1, 0, False), (1, 1, False), (1, 2, False), (2, 0, True)]
    assert [r.out for r in rows] == ["# 译：Short.", "".join("译：" + p for p in want), "- 译：End.", "done"]


def test_reference_budget_counts_the_pieces_of_long_lines(spark, tmp_path):
    long = "".join(f"Sentence {i} has some words. " for i in range(90)).strip()
    want = pieces(long, 256)
    largest = max(map(X.tokens_of, want))
    assert len(want) > 1 and X.tokens_of("Short.") < largest <= 256
    d = tables(spark, tmp_path, [(1, "a.txt", f"Short.\n{long}", "中文"), (2, "b.txt", long, "中文"), (3, "c.txt", "Short.", "中文"), (4, "d.txt", " \n", "中文")])
    got = {r.file_id: r.budget for r in QUERIES["q_reference_budget"](spark, d).collect()}
    fixed = X.tokens_of(X.BASE_PROMPT + "\n\n【风格偏好（自动判断）】\n" + X.STYLES["自动判断"]) + 512
    budget = lambda n: max(0, 2048 - fixed - 204 - n - max(256, int(n * 1.5) + 256) - 256)
    assert got == {1: budget(largest), 2: budget(largest), 3: budget(X.tokens_of("Short."))}


def prompts(spark, folder, content, name="a.txt", **settings):
    """What the model receives for each unit, in order."""
    import json

    from pyspark.sql import functions as F

    from lectern.functions import text as T
    from lectern.operators import pipeline as P
    from lectern.operators import units as U
    from lectern.sources.tables import lines

    folder.mkdir(exist_ok=True)
    path = str(folder / "asked")

    def model(prompt, size):
        with open(path, "a") as f:
            f.write(json.dumps(prompt) + "\n")
        return P.stub_model(prompt, size)

    df = spark.createDataFrame([(1, content, name)], "file_id long, t string, name string").withColumn("ext", T.extension(F.col("name")))
    rows = P.translate_units(U.document_units(lines(df, "file_id", "ext")), model, P.Settings(**settings)).collect()
    assert all(r.error is None for r in rows)
    with open(path) as f:
        return list(map(json.loads, f))


def task(text, source="英文"):
    return f"\n\n【当前待译文本（{source} → 中文）】\n{text}"


def test_request_of_neighbours(spark, tmp_path):
    got = prompts(spark, tmp_path / "a", "One and\ntwo.\n\nThree.\nFour.")
    pair = "[原文]\n{0}\n[译文]\n译：{0}".format
    assert got == [
        X.BESIDE + X.AFTER + "two.\n\nThree." + task("One and"),
        X.BESIDE + X.BEFORE + pair("One and") + "\n\n" + X.AFTER + "Three.\n\nFour.\n\n".strip() + "\n\n" + X.POSSIBLE + task("two."),
        X.BESIDE + X.BEFORE + pair("One and") + "\n\n" + pair("two.") + "\n\n" + X.AFTER + "Four." + task("Three."),
        X.BESIDE + X.BEFORE + pair("two.") + "\n\n" + pair("Three.") + task("Four."),
    ]
    assert prompts(spark, tmp_path / "b", "One.\nдва.", context_mode="unit") == [X.ALONE + task(x, "俄文") for x in ("One.", "два.")]
    assert X.AFTER not in prompts(spark, tmp_path / "c", "One.\nTwo.", future_units=0)[0]


def test_a_long_next_line_enters_by_its_pieces(spark, tmp_path):
    long = "".join(f"Sentence {i} has some words. " for i in range(400)).strip()
    got = prompts(spark, tmp_path / "a", f"One.\n{long}\nEnd.", context_size=2048)
    own = pieces(long, 256)
    assert [p.rpartition("】\n")[2] for p in got] == ["One.", *own, "End."]
    # The first piece is above the cap of 128 tokens, so nothing follows; the last piece sees the line after it.
    assert X.AFTER not in got[0] and X.AFTER + "End." in got[-2]
    wide = prompts(spark, tmp_path / "b", f"One.\n{long}\nEnd.", context_size=65536)
    first, second = pieces(long, 2048)
    assert X.tokens_of(first) <= 2731 < X.tokens_of(first) + X.tokens_of(second)
    assert X.AFTER + first + task("One.") in wide[0]


def test_full_mode_has_the_reference(spark, tmp_path):
    text = "One.\n\n```\ncode\n```\n- Two.\nThree."
    got = prompts(spark, tmp_path / "a", text, "a.md", context_mode="full")
    fixed = f"【固定全文原文参考（只供理解，禁止翻译或输出）】\n{text}\n【固定全文原文参考结束】"
    assert len(got) == 3 and got[0] == X.BESIDE + fixed + task("One.") and all(fixed in p and X.AFTER not in p for p in got)
    subtitles = "1\n00:00:01,000 --> 00:00:02,000\nHello.\n\n2\n00:00:03,000 --> 00:00:04,000\nThere."
    assert "输出）】\nHello.\n\nThere.\n【固定全文" in prompts(spark, tmp_path / "b", subtitles, "a.srt", context_mode="full")[0]


def test_full_mode_has_windows_where_the_whole_is_too_long(spark, tmp_path):
    lines_ = [f"Line {i} of the text, with some more words in it." for i in range(120)]
    size = 3000
    got = prompts(spark, tmp_path / "a", "\n".join(lines_), context_mode="full", context_size=size)
    n = max(map(X.tokens_of, lines_))
    budget = size - X.fixed_tokens() - 512 - 300 - n - max(256, int(n * 1.5) + 256) - 256
    assert X.tokens_of("\n".join(lines_)) > budget
    core, at, want = int(budget * 0.68), 0, []
    while at < len(lines_):
        end, used = at, 0
        while end < len(lines_) and (end == at or used + X.tokens_of(lines_[end]) + 2 <= core):
            used += X.tokens_of(lines_[end]) + 2
            end += 1
        want += ["\n".join(lines_[max(0, at - 2) : end + 2])] * (end - at)
        at = end
    kind = "固定当前语义窗口参考"
    assert len(set(want)) > 1 and len(got) == len(lines_)
    for p, w in zip(got, want):
        assert f"【{kind}（只供理解，禁止翻译或输出）】\n{w}\n【{kind}结束】" in p
