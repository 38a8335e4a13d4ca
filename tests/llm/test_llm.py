import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import DATA, same
from lectern.llm import clean, language, packing, pairs, pieces, quality, sentences, tokenizer
from lectern.llm.common import normal
from lectern.llm.queries import QUERIES, SQL
from lectern.llm.refusal import declines

from .conftest import CONTENT, EN, FR
from .refusals import HARMLESS, HELD_OUT


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def found(spark, world, name):
    return [tuple(r) for r in QUERIES[name](spark, world).collect()]


# 1


def test_pairs(spark, world):
    got = dict(found(spark, world, "p1_found"))
    assert got == {2: "empty", 3: "refusal", 4: "truncated", 5: "copied", 6: "empty", 7: "empty", 8: "empty", 9: "copied", 10: "empty", 11: "empty", 12: "wrong_language", 14: "empty"}


def test_later_attempt_replaces_a_failed_one(spark):
    rows = [(1, 5, 0, 1, "length", "a"), (2, 5, 0, 2, "stop", "ab"), (2, 5, 0, 2, "stop", "ab"), (3, 6, 0, 1, "stop", "x"), (4, 6, 1, 1, "length", "y"), (5, 7, 0, 1, None, " ")]
    df = spark.createDataFrame(rows, "choice_id long, file_id long, line_no int, attempt int, finish_reason string, content string").withColumn("arrived_at", F.current_timestamp())
    assert {r.file_id: (r.finish_reason, r.cut_lines) for r in pairs.last_replies(df).collect()} == {5: ("stop", 0), 6: ("length", 1), 7: (None, 0)}


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


def test_subsequence_against_the_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(30))] for _ in range(2))
        assert pairs.subsequence(a, b) == plain_lcs(a, b)


def test_subsequence_in_blocks(monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 7)
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(60))] for _ in range(2))
        assert pairs.subsequence(a, b) == plain_lcs(a, b)


def test_refusals_that_no_template_words():
    """Held-out wordings: at least nine of ten in every language together, and in each all but one."""
    missed = {k: [s for s in v if pairs.refusal_share(s) < 0.5] for k, v in HELD_OUT.items()}
    assert sum(map(len, missed.values())) <= 0.1 * sum(map(len, HELD_OUT.values())) and max(map(len, missed.values())) <= 1
    assert [s for s in HARMLESS if pairs.refusal_share(s) >= 0.5] == []
    assert all(declines(x) for x in pairs.REFUSALS if x != "Please consult a professional.")
    long = "I am sorry to say that, " + "having read every line of what was sent to me with the care that it deserves, " * 4 + "I cannot translate this text."
    assert len(pairs.tokens(long)) > 70 and pairs.refusal_share(long) == 1.0


def test_the_gravest_verdict_of_a_file_stands(spark):
    """Deliveries that differ: empty before refusal before copied, with the figures of the delivery it came from."""
    rows = [(1, EN, "I'm sorry, but I can't translate this text.", None), (1, EN, None, None), (1, EN, EN, None), (2, EN, EN, None), (2, EN, FR, None)]
    files = spark.createDataFrame(rows, "file_id long, content string, translated_content string, target_language string")
    choices = spark.createDataFrame([(i, i, 0, 1, "stop", "x") for i in (1, 2)], "choice_id long, file_id long, line_no int, attempt int, finish_reason string, content string").withColumn("arrived_at", F.current_timestamp())
    languages = spark.createDataFrame([("en", "x", "English", "eng")], "lang string, label string, name_en string, iso3 string")
    got = {r.file_id: r for r in pairs.pairs(files, choices, languages, pairs.Languages([], {})).collect()}
    assert got[1].defect == "empty" and got[2].defect == "copied" and got[2].subsequence == 1.0 == got[2].containment


def test_quoted_excuses_are_no_refusals():
    assert pairs.refusal_share("“I'm sorry, but I can't translate this text.”") == 0
    assert pairs.refusal_share("对不起，我无法翻译这段文字。") == 1
    assert pairs.refusal_share(EN) == 0


# 2


@pytest.mark.parametrize(
    "text,want",
    [
        ("Dr. Ash paid 3.5 kg to J. K. Elm. He left!", 2),
        ("The man said: “Who is there? Come in.” Nobody came.", 2),
        ("“Run!” said the man. He ran.", 2),
        ("老人说：“请进。谁在那里？”他走了。“快跑！”她说。", 3),
        ("「走れ！」と彼は言った。彼は走った。", 2),
        ("A title\nThe text begins. It goes on", 3),
        ("A line that has been wrapped because it is too\nlong for the page ends here. Next one is as well\nwrapped.", 2),
        ("One\n\ntwo", 2),
        ("(He left. It was late.) She stayed (until ten. Or so).", 2),
        ("Er kam am 5. März. Es war z. B. spät.", 2),
        ("See Sect. 5 of Ash et al. The rest is in Chap. 7.", 1),
        ("", 0),
        (" \n ", 0),
        ("...", 1),
        ("คนสวนอ่านแผนที่ กัปตันพูดว่า“วิ่ง! ใคร” นาย Ash เปิดประตู", 3),
    ],
)
def test_sentences(text, want):
    got = sentences.units(text)
    assert len(got) == want
    assert "".join("".join(text[a:b].split()) for a, b in got) == "".join(text.split())


def test_sentence_chunks_compose(spark, world):
    files = spark.read.parquet(f"{world}/files.parquet")
    got: dict = {}
    for r in sentences.sentence_units(files, "file_id", "content", chunk=900).distinct().collect():
        got.setdefault(r.file_id, []).append((r.start_char, r.end_char))
    for i, c in CONTENT.items():
        assert sorted(got.get(i, [])) == sentences.units(normal(c or "")), i


def test_entry_states_by_the_tree(spark):
    """The scan over three levels against a plain loop, on random functions of a few states."""
    rng = random.Random(11)
    rows, want = [], {}
    for row, n in ((1, 1), (2, 63), (3, 64), (4, 65), (5, 4097 + 5)):
        state = 0
        for k in range(n):
            f = [rng.randrange(5) for _ in range(5)] if rng.random() < 0.5 else rng.sample(range(5), 5)
            rows.append((row, k, f))
            want[row, k] = state
            state = f[state]
    rng.shuffle(rows)
    got = sentences.entry_states(spark.createDataFrame(rows, "row long, chunk int, f array<int>")).collect()
    assert {(r.row, r.chunk): r.entry for r in got} == want


def test_function_of_a_chunk():
    """From every entry state the function gives the exit and the starts of a plain run."""
    rng = random.Random(12)
    for _ in range(60):
        symbols = [(rng.randrange(sentences.SYMBOLS) if rng.random() < 0.97 else sentences.END, i) for i in range(rng.randrange(60))]
        exits, pick, starts = sentences.function(symbols)
        for state in range(len(exits)):
            assert (starts[pick[state]], exits[state]) == sentences.run(symbols, state)


# 3


def test_pieces(spark, world):
    rows = pieces.pieces(spark.read.parquet(f"{world}/files.parquet"), "file_id", "content", 500, 50).distinct().collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.file_id, []).append(r)
    for i, c in CONTENT.items():
        if i == 9:
            continue
        text, last = normal(c or ""), 0
        for r in sorted(by.get(i, []), key=lambda r: r.piece):
            assert r.piece_text == text[r.start_char : r.end_char] and len(r.piece_text) <= 500
            assert r.start_char == max(0, last - 50) if r.piece else r.start_char == 0
            last = r.end_char
        assert last == len(text)
    assert {r.cut for r in by[9]} == {"word", "end"} and {r.cut for r in by[10]} == {"hard", "end"}
    assert sorted(found(spark, world, "p3_found")) == [(9, "cut"), (10, "hard_cut")]
    # A stretch of 495 unbroken signs is cut by pieces of 450, but no piece of 500 needs to be cut in it.
    near = pieces.pieces(spark.createDataFrame([(1, "a b " * 100 + "x" * 495 + " c" * 300), (2, "a b " * 100 + "x" * 505 + " c" * 300), (3, "y" * 2000), (4, "z. " * 400)], "i long, t string"), "i", "t", 500, 50)
    assert {r.i: r.stretch for r in near.collect()} == {1: 495, 2: 505, 3: 2000, 4: 0}
    # Running sums over several blocks.
    long = pieces.pieces(spark.createDataFrame([(1, "ab " * 9000)], "i long, t string"), "i", "t", 30, 5).orderBy("piece").collect()
    assert len(long) > 2 * pieces.BLOCK and long[-1].end_char == 27_000 and all(b.start_char == a.end_char - 5 for a, b in zip(long, long[1:]))
    with pytest.raises(ValueError):
        pieces.pieces(spark.createDataFrame([], "a long, b string"), "a", "b", 5, 5)


# 4


@pytest.mark.parametrize(
    "text,want",
    [
        ("Prices ($5-$9), (a < b > c), C:\\new\\tab.txt, file_name_v2, 5 * 3 * 2, (#12), {slot_7}, [3]\n• one\n– two", []),
        ("# T", ["heading", "markdown"]), ("T\n===\nx", ["heading", "markdown"]), ("- a\n- b", ["list", "markdown"]), ("1. a\n2. b", ["list", "markdown"]), ("am\n16. März um zwölf", []),
        ("== T ==", ["heading", "wiki"]), ("*a\n** b", ["list", "wiki"]), ("x<ref>y</ref> [[a|b]]", ["wiki"]), ("<math>a_1</math>", ["formula", "wiki"]), ("''a'' {{b|c}}", ["wiki"]),
        ("<h2>T</h2><ul><li>a</ul>", ["heading", "html", "list"]), ("<pre><code>x &lt; **y**</code></pre>", ["code", "html"]), ("a&nbsp;b", ["html"]), ("1\n00:00:01,000 --> 00:00:02,000\n<i>a</i>", ["html"]),
        ("\\section{T}\n\\begin{itemize}\n\\item a\n\\end{itemize}", ["heading", "latex", "list"]), ("so $a_1 + b$ holds", ["formula", "latex"]), ("\\begin{verbatim}\n<b>x</b>\n\\end{verbatim}", ["code", "latex"]),
        ("```\n# x\n<b>\n$a_1$\n```", ["code", "markdown"]), ("教授**在第**二版里 `x`", ["markdown"]), (None, []), ("", []), ("plain", []),
    ],
)
def test_traits(text, want):
    assert clean.clean(text)[1] == want


def test_clean_text_keeps_structure(spark, world):
    text = clean.clean("<div><h1>T</h1><p>Some <b>bold</b> text, and more.</p><ul><li>a</li></ul><script>x()</script></div>\n```\nif a < b:\n```\n$a_1$")[0]
    assert [x for x in text.split("\n") if x] == ["# T", "Some bold text, and more.", "- a", "```", "if a < b:", "```", "$a_1$"]
    rows = found(spark, world, "p4_found")
    assert sorted(t for i, t in rows if i == 12) == ["code", "heading", "list", "markdown"] and [t for i, t in rows if i == 14] == ["html"]


def page(i):
    """A page with labelled leaves: (its HTML, texts of content, texts of boilerplate)."""
    rng = random.Random(i)
    words = "river stone lantern market window garden letter winter harbour bridge keeper clock".split()
    said = lambda n: ", ".join(" ".join(rng.choice(words) for _ in range(5)) for _ in range(n)).capitalize() + "."
    paragraphs = [" ".join(said(3) for _ in range(rng.randrange(2, 5))) for _ in range(rng.randrange(2, 5))]
    items, cells = [f"{rng.choice(words)} no {i} {k}" for k in range(3)], [f"{rng.choice(words)} {i}{k}" for k in range(4)]
    menu, related = [f"{w.capitalize()} {i}" for w in ("home", "news", "shop", "about")], [f"Also {rng.choice(words)} {i} {k}" for k in range(3)]
    title = f"The {rng.choice(words)} of {rng.choice(words)} {i}"
    html = (
        "<html><body><header><nav><ul>" + "".join(f"<li><a href='/{k}'>{m}</a></li>" for k, m in enumerate(menu)) + "</ul></nav></header>"
        + f"<main><article><h1>{title}</h1>" + "".join(f"<p>{p}" for p in paragraphs) + "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>"
        + "<table><tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr></table></article></main>"
        + "<aside><h2>Related</h2>" + "".join(f"<div><a href='#'>{x}</a></div>" for x in related) + "</aside>"
        + f"<footer><div><a>Terms {i}</a><a>Contact {i}</a></div></footer></body></html>"
    )
    return html, [title, *paragraphs, *items, *cells], [*menu, "Related", *related, f"Terms {i} Contact {i}"]


def test_boilerplate_goes_and_content_stays(spark):
    """Thirty labelled pages, and documents that the choice must not touch."""
    pages = {i: page(i) for i in range(30)}
    rows = [(i, h) for i, (h, _, _) in pages.items()] + [(100, EN), (101, "<ul><li>one</li><li>two</li></ul>"), (102, "<nav><ul><li>Home</li><li>News</li></ul></nav>\n" + EN), (103, None), (None, "<p>" + EN)] * 2
    read = clean.readings(spark.createDataFrame(rows, "file_id long, content string").distinct(), "file_id", "content", True).cache()
    got = {r.file_id: r for r in clean.selected(read).collect()}
    for i, (_, content, boilerplate) in pages.items():
        lines = {x.lstrip("#- ") for x in got[i].clean_text.split("\n")}
        assert set(content) <= lines and not lines & set(boilerplate) and got[i].dropped == len(boilerplate)
        assert got[i].traits == ["heading", "html", "list"]
    assert got[100].clean_text == EN and got[101].clean_text == "- one\n- two" and got[101].traits == ["html", "list"]
    # The only list is a menu: its markup is HTML, but no list is content.
    assert got[102].clean_text.strip() == EN and got[102].traits == ["html"]
    assert got[103].clean_text is None and got[None].clean_text == EN
    # The sums of tables and of one pass in memory give the same choice, and without a threshold all stays.
    by_path, limit = clean.ratios([x for _, h in set(rows) for x in clean.Reading(h).sums])
    for i, (h, _, _) in pages.items():
        r = clean.Reading(h)
        assert r.clean(r.kept(by_path, limit)) == got[i].clean_text
    assert sum(r.dropped for r in clean.selected(read, threshold=0.0).collect()) == 0


def test_paths_reach_from_the_root():
    """Containers far above a leaf tell its path from another's; nested commands are all taken off."""
    deep = "<div>" * 12
    r = clean.Reading(f"<nav>{deep}<p>one</p>{'</div>' * 12}</nav><article>{deep}<p>two</p>")
    assert [t for t in r.texts if t] == ["one", "two"] and len({k for k in r.keys if k}) == 2
    assert clean.clean("\\section{T}\n" + "\\emph{" * 9 + "deep" + "}" * 9)[0] == "# T\ndeep"
    assert clean.clean("<div>" * 5000 + "text")[0] == "text"


# 5


def test_languages_of_segments(spark, world):
    got = found(spark, world, "p5_found")
    assert sorted(r for r in got if r[0] == 11) == [(11, 0, 0, "en"), (11, 1, 1, "de")]
    assert not [r for r in got if r[0] in (1, 6, 7, 8, 13)]


def test_language_of_held_out_lines(spark):
    """Lines of documents that the dictionaries have not seen, with labels that their common words confirm."""
    model = language.fit(spark, "/root/testdata/sf0.01", rows=500)
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 10 = 3 and length(text) > 200 and lang in ('en', 'fr', 'de', 'es', 'it', 'pt', 'zh', 'ja', 'ko', 'ru', 'ar', 'th')").collect()
    right = total = 0
    for r in rows:
        s = model.segments(r.text)
        if s:
            total += 1
            right += max(s, key=lambda x: x[4])[2] == r.lang
    assert total > 400 and right / total > 0.88  # some labels are wrong, some texts are noise


# 6


def test_ids_equal_those_of_the_whole_text(spark, world):
    coder = tokenizer.encoding(f"{tokenizer.FOLDER}/{tokenizer.NAME}.tiktoken")
    df = spark.read.parquet(f"{world}/documents.parquet")
    want = {r.doc_id: coder.encode_ordinary(r.text or "") for r in df.select("doc_id", "text").collect()}
    for chunk, overlap in ((4096, 256), (1000, 16)):
        got = {r.doc_id: r.ids for r in tokenizer.encode(df, "doc_id", "text", chunk=chunk, overlap=overlap).collect()}
        assert got == want
    back = {r.doc_id: r.text for r in tokenizer.decode(tokenizer.encode(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert all(back[r.doc_id] == (r.text or "") for r in df.select("doc_id", "text").collect())


def test_rows_with_one_key_are_texts_of_their_own(spark):
    texts = ["word " * 2400, "other words " * 700, "word " * 2400, None, "short"]
    coder = tokenizer.encoding(f"{tokenizer.FOLDER}/{tokenizer.NAME}.tiktoken")
    df = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    want = sorted(coder.encode_ordinary(t or "") for t in texts)
    assert sorted(list(r.ids) for r in tokenizer.encode(df, "doc_id", "text").collect()) == want
    assert sorted(r.tokens for r in tokenizer.sizes(df, "doc_id", "text", chunk=500, overlap=30).collect()) == sorted(map(len, want))


# 7


def test_packing(spark):
    rng = np.random.default_rng(3)
    sizes = [*rng.integers(1, 100, 400).tolist(), *[33] * 300, 250, 100, 0, None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, tokens int")
    rows = packing.pack(df, "doc_id", "tokens", 100).collect()
    fill: dict = {}
    for r in rows:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.tokens
    total = sum(s or 0 for s in sizes)
    assert max(fill.values()) <= 100 and sorted(fill) == list(range(len(fill)))
    assert sum(r.tokens for r in rows) == total and len(fill) <= 1.03 * -(-total // 100)
    assert sorted((r.part, r.tokens) for r in rows if r.doc_id == 700) == [(0, 100), (1, 100), (2, 50)]
    assert len(rows) == len({(r.doc_id, r.part) for r in rows}) == 702 + 2


def best_fit(histogram, capacity):
    rooms = []
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            room = min((r for r in rooms if r >= n), default=None)
            if room is not None:
                rooms.remove(room)
            rooms.append((capacity if room is None else room) - n)
    return len(rooms)


@pytest.mark.parametrize("seed,low,high,count", [(1, 1, 100, 600), (2, 5, 60, 400), (3, 30, 55, 300), (4, 1, 7, 50), (5, 80, 100, 30), (6, 10, 100, 40)])
def test_configuration_program(seed, low, high, count):
    """The plan holds exactly the histogram, the program's bound is one, and rounding costs little."""
    rng = np.random.default_rng(seed)
    histogram = {int(n): int(c) for n, c in zip(*np.unique(rng.integers(low, high + 1, count), return_counts=True))}
    got = packing.plan(histogram, 100)
    held: dict = {}
    for config, times in got.configs:
        assert sum(n * k for n, k in config.items()) <= 100
        for n, k in config.items():
            held[n] = held.get(n, 0) + k * times
    assert held == histogram
    used = sum(t for _, t in got.configs)
    volume = -(-sum(n * c for n, c in histogram.items()) // 100)
    assert volume <= used <= 1.04 * best_fit(histogram, 100) + 1
    if len(got.program.length):
        assert got.program.bound <= got.program.value * (1 + 1e-9)
        # Every class is covered by the fractional solution, scaled to its value.
        scale = got.program.value / sum(x for _, x in got.program.configs)
        for j, need in enumerate(got.program.need):
            assert scale * sum(x * c.get(j, 0) for c, x in got.program.configs) >= need * (1 - 1e-9)


def test_program_places_most_items():
    """On the lengths of the test tables the program, not the best fit after it, fills most containers."""
    rng = np.random.default_rng(8)
    lengths = np.minimum(rng.lognormal(6, 1, 20_000).astype(int) + 1, 2048)
    histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}
    got = packing.plan(histogram, 2048)
    assert got.placed > 0.75 * len(lengths) and got.program.rounds > 100
    assert sum(t for _, t in got.configs) <= 1.002 * lengths.sum() / 2048 + 1


def test_knapsack_against_brute_force():
    rng = random.Random(5)
    for _ in range(40):
        n = rng.randrange(1, 6)
        lengths, values, counts = [rng.randrange(1, 12) for _ in range(n)], [rng.random() for _ in range(n)], [rng.randrange(1, 4) for _ in range(n)]
        found = packing.knapsack(np.array(lengths), np.array(values), np.array(counts), 20)
        best = {0: 0.0}
        for a, v, c in zip(lengths, values, counts):
            for _ in range(c):
                for w, x in list(best.items()):
                    if w + a <= 20:
                        best[w + a] = max(best.get(w + a, 0), x + v)
        assert sum(values[j] * k for j, k in found.items()) == pytest.approx(max(best.values()))
        assert sum(lengths[j] * k for j, k in found.items()) <= 20 and all(k <= counts[j] for j, k in found.items())


# 8


@pytest.fixture(scope="module")
def fitted(spark):
    common = quality.common_words(spark, DATA)
    stats = quality.document_statistics(spark.read.parquet(f"{DATA}/documents.parquet"), common).cache()
    return common, stats, quality.fit(stats, common)


def test_examples_have_their_shapes(fitted):
    common, _, mixture = fitted
    for shape, text in quality.EXAMPLES:
        x = quality.opened(np.array([[quality.statistics(text, common)[c] for c in quality.STATISTICS]]))
        assert quality.SHAPES[mixture.posteriors(x)[0].argmax()] == shape, text


def test_the_mixture_decides_every_shape(fitted):
    """Shapes are the largest posteriors, and another mapping of the components gives other shapes."""
    common, stats, mixture = fitted
    rows = quality.shapes(stats, mixture).where("n_lines > 0").collect()
    assert all(r.shape == max(quality.SHAPES, key=lambda s: r[f"p_{s}"]) for r in rows)
    turned = quality.Mixture(mixture.centre, mixture.scale, mixture.model, np.roll(mixture.shapes, 1, axis=1))
    other = {r.doc_id: r.shape for r in quality.shapes(stats, turned).collect()}
    assert all(other[r.doc_id] == quality.SHAPES[(quality.SHAPES.index(r.shape) + 1) % 4] for r in rows)
    with pytest.raises(RuntimeError):
        quality.fit(stats, common, passes=1)


def test_shapes(spark, world):
    assert sorted(found(spark, world, "p8_found")) == [(7, "junk"), (8, "list"), (9, "table"), (10, "junk"), (15, "junk")]


def test_mixture_passes_raise_the_likelihood(fitted):
    common, stats, _ = fitted
    x = quality.opened(np.array([[r[c] for c in quality.STATISTICS] for r in stats.where("n_lines > 0").collect()]))
    fits = [quality.fit(stats, common, gain=g) for g in (1.0, 0.05, 1e-3)]
    likelihood = [np.logaddexp.reduce(quality._log_joint((x - m.centre) / m.scale, *m.model), axis=1).mean() for m in fits]
    assert likelihood[0] <= likelihood[1] <= likelihood[2] and likelihood[0] < likelihood[2]
    assert likelihood[2] == pytest.approx(fits[2].likelihood)


def test_chunks_compose_on_random_texts():
    rng = random.Random(7)
    bits = ["\n", "\n\n", " ", " He said: “Run!” ", "“", "”", "(", ")", "«", "»", "„", "5. März", "Dr. ", "e.g. ", "word ", "。", "！", "「走れ！」と", "他说：“好。”", "…", "a.b", "คน ", "　", ":", "- x", "한국 어.", "x" * 40, "foo bar baz " * 5, "قال: «نعم.»"]
    for _ in range(250):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(400)))
        assert "".join("".join(text[a:b].split()) for a, b in sentences.units(text)) == "".join(text.split())
        state, starts, chunk = 0, [], 700
        for k in range(-(-len(text) // chunk)):
            base = max(0, k * chunk - sentences.MARGIN)
            own = [(s, base + at) for s, at in sentences.lex(text[base : (k + 1) * chunk + sentences.MARGIN]) if k * chunk <= base + at < (k + 1) * chunk]
            got, state = sentences.run(own, state)
            starts += got
        assert starts == sentences.run(sentences.lex(text))[0]
