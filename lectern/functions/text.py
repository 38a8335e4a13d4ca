"""Column functions over one text: normalisation, unit parts, predicates, language, token budgets.

Every function maps Columns to Columns, so Catalyst sees plain expressions. White space is Unicode white space plus
U+001C to U+001F; `.` excludes line feeds only (flag d), and positions count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f]"

# Output suffix by target language.
LANGUAGE_SUFFIXES = dict(
    x.split(":")
    for x in (
        "中文:zh 繁体中文:zh-hant 粤语:yue 藏文:bo 英文:en 法文:fr 西班牙文:es 葡萄牙文:pt 德文:de 意大利文:it 荷兰文:nl 瑞典文:sv 波兰文:pl 捷克文:cs "
        "斯洛伐克文:sk 斯洛文尼亚文:sl 克罗地亚文:hr 塞尔维亚文:sr 罗马尼亚文:ro 匈牙利文:hu 保加利亚文:bg 乌克兰文:uk 希腊文:el 立陶宛文:lt 俄文:ru 韩文:ko "
        "泰文:th 越南文:vi 马来文:ms 印尼文:id 菲律宾文:fil 印地文:hi 孟加拉文:bn 乌尔都文:ur 泰米尔文:ta 泰卢固文:te 马拉地文:mr 古吉拉特文:gu 阿拉伯文:ar "
        "希伯来文:he 波斯文:fa 高棉文:km 缅甸文:my 哈萨克文:kk 蒙古文:mn 维吾尔文:ug 日文:ja"
    ).split()
)
# Scripts in the order of the tests; the first one that occurs names the language.
SCRIPT_LANGUAGES = [
    ("3040", "30FF", "日文"), ("AC00", "D7AF", "韩文"), ("05D0", "05EA", "希伯来文"), ("0600", "06FF", "阿拉伯文"), ("0F00", "0FFF", "藏文"),
    ("0980", "09FF", "孟加拉文"), ("0A80", "0AFF", "古吉拉特文"), ("0900", "097F", "印地文"), ("0B80", "0BFF", "泰米尔文"), ("0C00", "0C7F", "泰卢固文"),
    ("0E00", "0E7F", "泰文"), ("1000", "109F", "缅甸文"), ("1780", "17FF", "高棉文"), ("1800", "18AF", "蒙古文"), ("0370", "03FF", "希腊文"), ("0400", "04FF", "俄文"),
]
SIMPLIFIED = "们国说时对这为点让认识还样从实开会现道起吗个子于后体气无门问题关东长发马鱼鸟车银间队阶阳阴风飞见亲观欢边进过"
TRADITIONAL = "們國說時對這為點讓認識還樣從實開會現道起嗎個子於後體氣無門問題關東長髮馬魚鳥車銀間隊階陽陰風飛見親觀歡邊進過"
STOP_WORDS = "and or but because although while when if to of for from with without the a an this that these those very more most immediately directly particularly especially".split()


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{WS}+|{WS}+\z", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{WS}+", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){WS}+\z", "")


def without_bom(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\x{feff}", "")


def normalized(c: Column) -> Column:
    """One leading BOM dropped, CRLF and CR to LF; null becomes the empty text."""
    return F.regexp_replace(without_bom(F.coalesce(c, F.lit(""))), "\r\n?", "\n")


def occurrences(c: Column, what: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))) / len(what)).cast("int")


def line_ending(c: Column) -> Column:
    """The vote: crlf if it is not outnumbered and occurs, else cr if it outnumbers lf, else lf."""
    text = F.coalesce(c, F.lit(""))
    rest = F.replace(text, F.lit("\r\n"), F.lit(""))
    crlf, cr, lf = occurrences(text, "\r\n"), occurrences(rest, "\r"), occurrences(rest, "\n")
    return F.when((crlf > 0) & (crlf >= F.greatest(cr, lf)), "crlf").when(cr > lf, "cr").otherwise("lf")


def encoded(content: Column, eol: Column, bom: Column) -> Column:
    """The output text: LF replaced by the remembered line ending, with the BOM if it had one."""
    separator = F.when(eol == "crlf", "\r\n").when(eol == "cr", "\r").otherwise("\n")
    return F.concat(F.when(F.coalesce(bom, F.lit(False)), "﻿").otherwise(""), F.replace(normalized(content), F.lit("\n"), separator))


def extension(name: Column) -> Column:
    """The last suffix of a name in small letters, with its dot; leading dots of the base name start no suffix."""
    base = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/]*)\z", 1)
    return F.lower(F.regexp_extract(base, r"(?s)\A\.*[^.].*(\.[^.]*)\z", 1))


def output_name(name: Column, target: Column) -> Column:
    """Base name, suffix of the target language, then the old suffix, or .md."""
    base = F.regexp_extract(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/")), r"([^/]*)\z", 1)
    base = F.when(base == "", "translated.md").otherwise(base)
    old = F.regexp_extract(base, r"(?s)\A\.*[^.].*(\.[^.]*)\z", 1)
    stem = F.regexp_replace(base, r"(?s)\A(\.*[^.].*)\.[^.]*\z", "$1")
    suffix = F.coalesce(F.create_map(*(F.lit(x) for kv in LANGUAGE_SUFFIXES.items() for x in kv))[target], F.lit("translated"))
    return F.concat(stem, F.lit("."), suffix, F.when(old == "", ".md").otherwise(old))


PLAIN = rf"(?Ud)\A({WS}*)(.*?)([ \t]*)\z"


def plain_unit(line: Column) -> Column:
    """struct(translate, prefix, text, suffix) of a plain line."""
    part = [F.regexp_extract(line, PLAIN, i) for i in (1, 2, 3)]
    return F.struct((part[1] != "").alias("translate"), part[0].alias("prefix"), part[1].alias("text"), part[2].alias("suffix"))


FENCE = rf"(?U)\A{WS}*(?:```|~~~)"
INDENT = r"\A(?: {4}|\t)"
RULE = rf"(?U)\A{WS}{{0,3}}(?:(?:\*{WS}*){{3,}}|(?:-{WS}*){{3,}}|(?:_{WS}*){{3,}})\z"
_MARKER = r"(?:[-+*]|\d+[.)])"
STRUCTURES = [
    rf"(?Ud)\A({WS}{{0,3}}#{{1,6}}[ \t]+)(.*?)([ \t]*)\z",
    rf"(?Ud)\A({WS}*(?:>{WS}*)*{_MARKER}{WS}+\[[ xX]\]{WS}+)(.*?)([ \t]*)\z",
    rf"(?Ud)\A({WS}*(?:>{WS}*)*{_MARKER}{WS}+)(.*?)([ \t]*)\z",
    rf"(?Ud)\A({WS}*(?:>{WS}*)+)(.*?)([ \t]*)\z",
    PLAIN,
]


def markdown_unit(line: Column, in_fence: Column) -> Column:
    """struct(translate, prefix, text, suffix): the first structure that matches gives the prefix."""
    locked = line.rlike(FENCE) | in_fence | (strip(line) == "") | line.rlike(INDENT) | line.rlike(RULE)

    def part(i: int) -> Column:
        c = F.when(line.rlike(STRUCTURES[0]), F.regexp_extract(line, STRUCTURES[0], i))
        for p in STRUCTURES[1:-1]:
            c = c.when(line.rlike(p), F.regexp_extract(line, p, i))
        return c.otherwise(F.regexp_extract(line, STRUCTURES[-1], i))

    text = part(2)
    translate = ~locked & (text != "")
    return F.struct(translate.alias("translate"), *(F.when(translate, c).alias(n) for n, c in (("prefix", part(1)), ("text", text), ("suffix", part(3)))))


TIMING = r"(?U)\A\s*(?:\d{1,3}:)?\d{2}:\d{2}[,.]\d{3}\s+-->\s+(?:\d{1,3}:)?\d{2}:\d{2}[,.]\d{3}(?:\s+.*)?\z"


def strip_affixes(line: Column, prefix: Column, suffix: Column) -> Column:
    """A translated line without the kept prefix and suffix, stripped."""
    text = F.when((prefix != "") & line.startswith(prefix), F.substr(line, F.length(prefix) + 1)).otherwise(line)
    return strip(F.when((suffix != "") & text.endswith(suffix), F.substr(text, F.lit(1), F.length(text) - F.length(suffix))).otherwise(text))


def one_line(c: Column) -> Column:
    return F.regexp_replace(strip(c), rf"(?U){WS}*\r?\n+{WS}*", " ")


def collapsed(c: Column) -> Column:
    """Every run of white space as one blank, stripped."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?U){WS}+", " "), r"\A +| +\z", "")


def xml_illegal(c: Column) -> Column:
    return c.rlike(r"[^\x09\x0a\x0d\x20-\x{d7ff}\x{e000}-\x{fffd}\x{10000}-\x{10ffff}]")


def terminal_line(c: Column) -> Column:
    return rstrip(c).rlike(rf"(?U)[。！？.!?；;：:]{WS}*[\"'”’」』）)\]]*\z")


def sentence_end(c: Column) -> Column:
    return rstrip(c).rlike(rf"(?U)[。！？.!?…]{WS}*[\"'”’」』）)\]]*\z")


def bullet_like(c: Column) -> Column:
    return lstrip(c).rlike(rf"(?U)\A(?:[-*•▪◦]{WS}+|\(?\d{{1,4}}[.)、]{WS}*|[A-Za-z][.)]{WS}+)")


def heading_like(c: Column) -> Column:
    """Short, no terminal stop; named section, no small letter, title case of 2 to 12 words, or one short East Asian word."""
    value = strip(c)
    words = F.filter(F.split(value, rf"(?U){WS}+"), lambda w: w != "")
    titled = F.size(F.filter(words, lambda w: F.regexp_replace(w, r"\A[\"'“”‘’()\[\]{}]+", "").rlike(r"\A[\p{Lu}\p{Lt}]")))
    n = F.size(words)
    named = value.rlike(r"(?iU)\A(?:chapter|section|part|appendix|volume|book)\b")
    upper = value.rlike(r"\p{L}") & ~value.rlike(r"\p{javaLowerCase}")
    east = (n == 1) & value.rlike(r"[\x{3400}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]") & (F.length(value) <= 16)
    stop = value.rlike(rf"(?U)[。！？.!?；;：:]{WS}*[\"'”’」』）)]*\z")
    return (value != "") & (F.length(value) <= 100) & ~stop & (named | upper | (n.between(2, 12) & (titled >= F.greatest(F.lit(2), n - 2))) | east)


_STARTS_SMALL = r"\A[a-zà-öø-ÿ]"
_OPENERS = r"\A[\"'“”‘’(\[{]+"


def may_continue(previous: Column, current: Column) -> Column:
    """Text hint: possible or ''. A previous unit without a stop, then a small letter or an open end."""
    p, c = strip(F.coalesce(previous, F.lit(""))), lstrip(F.coalesce(current, F.lit("")))
    core = F.regexp_replace(p, rf"(?U)[\s\x1c-\x1f\"'”’」』）)\]]+\z", "")
    go = F.regexp_replace(c, _OPENERS, "").rlike(_STARTS_SMALL) | p.rlike(r"[-–—,;]\z")
    return F.when((p != "") & (c != "") & ~core.rlike(r"[.!?。！？…]\z") & go, "possible").otherwise("")


def layout_may_continue(previous: Column, current: Column) -> Column:
    """The variant of page layouts; a last word that wants more counts too."""
    p, c = strip(F.coalesce(previous, F.lit(""))), lstrip(F.coalesce(current, F.lit("")))
    last = F.regexp_extract(F.lower(p), r"(?s).*?([a-z]+)[^a-z]*\z", 1)
    go = F.regexp_replace(c, _OPENERS, "").rlike(_STARTS_SMALL) | p.rlike(r"[-–—,;]\z") | last.isin(STOP_WORDS)
    return (p != "") & (c != "") & ~sentence_end(p) & go


def detected_language(c: Column, over: WindowSpec | None = None) -> Column:
    """The language that the scripts of a text suggest; Latin letters alone say English, nothing says Chinese.

    over: of all texts of a window together.
    """
    some = (lambda x: x) if over is None else lambda x: F.max(x).over(over)
    all_ = (lambda x: x) if over is None else lambda x: F.sum(x).over(over)
    out = F.when(F.lit(False), "")
    for low, high, name in SCRIPT_LANGUAGES:
        out = out.when(some(c.rlike(rf"[\x{{{low}}}-\x{{{high}}}]")), name)
    simp = all_(F.length(F.regexp_replace(c, f"[^{SIMPLIFIED}]", "")))
    trad = all_(F.length(F.regexp_replace(c, f"[^{TRADITIONAL}]", "")))
    out = out.when(some(c.rlike(r"[\x{4e00}-\x{9fff}]")), F.when((trad > 0) & (trad > simp), "繁体中文").otherwise("中文"))
    return out.when(some(c.rlike("[a-zA-Z]")), "英文").otherwise("中文")


def target_script(c: Column, target: Column) -> Column:
    return (
        F.when((target == "日文") | c.rlike(r"[\x{3040}-\x{30ff}]"), "japanese").when((target == "韩文") | c.rlike(r"[\x{ac00}-\x{d7af}]"), "korean")
        .when(target.isin("繁体中文", "粤语"), "traditional_chinese").when((target == "中文") | c.rlike(r"[\x{3400}-\x{9fff}]"), "simplified_chinese").otherwise("unicode")
    )


def shaping(c: Column) -> Column:
    return c.rlike(r"[\x{0600}-\x{08ff}\x{0900}-\x{0dff}\x{0e00}-\x{0fff}\x{1000}-\x{109f}\x{1780}-\x{18af}]")


def layout_key(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\x1c-\x1f\x{ad}]+", "")


def toc_title(c: Column, label: Column) -> Column:
    """A contents entry without its page label and the leaders before it."""
    value, mark = collapsed(c), strip(F.coalesce(label, F.lit("")))
    head = F.substr(value, F.lit(1), F.length(value) - F.length(mark))
    title = F.regexp_replace(head, r"[ .·…]+\z", "")
    return F.when((mark != "") & value.endswith(mark) & head.rlike(r"[ .·…]\z") & (title != ""), title).otherwise(value)


def tokens(c: Column) -> Column:
    """Estimated tokens: 1.2 for a sign outside ASCII, 1/3.2 for one inside, truncated, plus one."""
    text = F.coalesce(c, F.lit(""))
    inside = F.length(F.regexp_replace(text, r"[^\x00-\x7f]+", ""))
    outside = F.length(text) - inside
    return F.greatest(F.lit(1), (outside * F.lit(1.2) + inside / F.lit(3.2)).cast("int") + 1)


def output_budget(c: Column) -> Column:
    return F.least(F.lit(80000), F.greatest(F.lit(384), (tokens(c) * F.lit(2.25)).cast("int") + 384))


def context_size(n: int) -> int:
    return max(2048, n)


def context_caps(n: int) -> tuple[int, int]:
    """Tokens for context before and after a unit."""
    total = max(256, min(8192, int(context_size(n) * 0.15)))
    before = max(128, int(total * 2 / 3))
    return before, max(128, total - before)


def unit_limit(n: int) -> int:
    """Tokens above which a line is cut into sentences."""
    return max(256, min(2048, int(context_size(n) * 0.05)))


SENTENCES = rf"(?Us).+?(?:[。！？.!?]+[”’\"」』）)\]]*{WS}*|\z)"


def sentences(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(SENTENCES), F.lit(0))


def joined_units(parts: Column, target: Column) -> Column:
    """Stripped parts without blanks ones; East Asian targets take no separator."""
    kept = F.filter(F.transform(parts, strip), lambda p: p != "")
    return F.when(target.isin("中文", "繁体中文", "粤语", "日文", "韩文"), F.array_join(kept, "")).otherwise(F.array_join(kept, " "))


def dehyphenated(lines: Column) -> Column:
    """Lines joined by a blank, or without the hyphen where a word goes on."""

    def step(acc: Column, line: Column) -> Column:
        value = collapsed(line)
        return F.when(value == "", acc).when(acc == "", value).when(acc.endswith("-") & value.rlike(r"(?U)\A[\p{L}\p{N}]"), F.concat(F.substr(acc, F.lit(1), F.length(acc) - 1), value)).otherwise(F.concat(acc, F.lit(" "), value))

    return F.aggregate(lines, F.lit(""), step)


def local_name(tag: Column) -> Column:
    return F.lower(F.substring_index(tag, "}", -1))


def nearest_boundary(text: Column, target: Column, minimum: Column) -> Column:
    """The cut near target that touches white space or punctuation; the nearest, then the lowest."""
    n = F.length(text)
    radius = F.least(F.lit(16), F.greatest(F.lit(4), F.floor(n / 20).cast("int")))
    low, high = F.greatest(minimum + 1, target - radius), F.least(n, target + radius)
    marks = r"\A[ \t\r\n,.;:!?，。！？；：、)\]}）】》」』”’]\z"
    near = F.filter(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(text, i, F.lit(1)).rlike(marks) | ((i < n) & F.substr(text, i + 1, F.lit(1)).rlike(marks)))
    best = F.array_min(F.transform(near, lambda i: F.struct(F.abs(i - target).alias("gap"), i.alias("at"))))["at"]
    return F.when(target <= minimum, minimum).when(target >= n, n).otherwise(F.coalesce(best, target)).cast("int")


def partition_cuts(text: Column, weights: Column) -> Column:
    """Cut positions that divide a text in proportion to weights (each at least 1), at boundaries, never backwards."""
    w = F.transform(weights, lambda x: F.greatest(F.lit(1), x).cast("int"))
    total = F.aggregate(w, F.lit(0), lambda a, x: a + x)
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"), F.array().cast("array<int>").alias("cuts"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["sum"] + x
        at = nearest_boundary(text, F.rint(F.length(text) * s.cast("double") / total).cast("int"), acc["last"])
        return F.struct(s.alias("sum"), at.alias("last"), F.concat(acc["cuts"], F.array(at)).alias("cuts"))

    return F.aggregate(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), start, step)["cuts"]


def running(numbers: Column, block: int = 256) -> Column:
    """0 and the running sums of an array, in blocks: no array longer than a block is copied once per element."""

    def sums(a: Column) -> Column:
        return F.aggregate(a, F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(numbers), F.lit(1)) - 1) / block).cast("int")), lambda i: sums(F.slice(numbers, i * block + 1, F.lit(block))))

    def joined(parts: Column) -> Column:
        before = sums(F.transform(parts, lambda p: F.element_at(p, -1)))
        moved = F.transform(F.arrays_zip(parts.alias("p"), before.alias("b")), lambda z: F.transform(F.slice(z["p"], 2, block), lambda n: n + z["b"]))
        return F.concat(F.array(F.lit(0)), F.flatten(F.filter(moved, lambda a: a.isNotNull())))

    # The blocks are summed once and used twice.
    return F.element_at(F.transform(F.array(parts), joined), 1)
