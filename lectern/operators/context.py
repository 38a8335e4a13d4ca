"""What a unit's request sees around it: sub-units, neighbours, reference windows, prompts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import takewhile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .units import SUBTITLES, stub

C = F.col

# Wording of the prompts.
BASE_PROMPT = (
    "你是专业文档翻译引擎。指令优先级严格为：硬性规则 > 用户补充要求 > 风格偏好；低优先级内容与高优先级冲突时，必须服从高优先级内容。\n"
    "【硬性规则】\n1. 忠实、完整地翻译，不得省略、概括、捏造内容或额外解释。\n2. 只输出当前待译单元的译文，不输出说明、标签、定位键或原文。\n"
    "3. 当前单元可能在句中截断。不得补写前后文；承接上文时不得重复已有内容；相邻译文拼接后应连贯。单元内部不要自行换行。\n"
    "4. 结合参考上下文统一术语、专名、称谓和语气，但不得重复输出参考内容。\n5. 原样保留 URL、行内代码、变量、占位符、数字、Markdown 行内标记及字幕内联标签。"
)
STYLES = {
    "自动判断": "根据当前文本判断合适风格：剧情重视情景、人物口吻和自然表达；专业内容重视准确、直接和通俗易懂；其他内容保持自然清晰。",
    "通用自然": "表达自然流畅、清楚易读，不过度书面化，也不额外润色或扩写。",
    "剧情文学": "保持情节、事实、视角和人物设定不变，可适度润色措辞、节奏、氛围与人物口吻，使译文具有自然的叙事感；不得新增情节。",
    "专业技术": "术语准确一致，表达直截了当、逻辑清楚且通俗易懂；避免文学化修饰、含混措辞和不必要的复杂句。",
    "对话字幕": "语言口语化、简洁自然，保留人物语气、情绪和身份差异；控制句长，不添加对白。",
    "正式商务": "使用正式、克制、清晰的商务表达，信息明确，措辞礼貌，术语和称谓一致。",
    "学术论文": "使用准确、客观、中性的学术表达，保持论证关系、限定条件、术语、数据和引文含义。",
    "轻小说网文": "保持剧情与人物设定，语言轻快顺畅、富有画面感，对话自然，可适度本地化措辞但不得改写情节。",
}
ALONE = "只翻译【当前待译文本】，只输出对应译文，不得输出说明、标签或原文；单元内部不要自行换行。"
BESIDE = "以下固定参考和已确认译文只用于理解语境、消除歧义并统一术语、称谓和语气。\n只翻译【当前待译文本】，不得翻译、续写或输出任何前文和下文参考。\n\n"
POSSIBLE = (
    "【单元边界判断】\n当前原文可能是上一单元的后半句，也可能只是没有规范标点的新段落。请结合最近原文和已确认译文判断：若为续句，只译当前实际内容并直接衔接，"
    "不得重复上文；若为新段落，则正常完整翻译。不得仅因缺少标点而省略主语或信息。"
)
STRONG = "【跨单元衔接提示】\n版面结构表明当前原文是上一单元同一句话的后半段。只译当前实际出现的内容，直接承接上一段译文；不要重复上一段已有的主语、动作或修饰语，也不要补成独立句。"
AGAIN = "这是重译任务。参考内容只用于理解语境、消除歧义并统一术语、称谓和语气。\n"
AGAIN_OLD = "请对照原文检查旧译文中的错译、漏译、增译、称谓、术语、语气和不自然表达，然后完整地重新翻译当前文本。旧译文可能有错，只能作为纠错参考。\n"
AGAIN_NEW = "请忽略旧版译文，基于原文和本轮已经确认的新译文，完整地重新翻译当前文本。\n"
AGAIN_ONLY = "只输出修正后的完整译文，不得输出分析、修改说明、原文、旧译文或前后文；单段译文内部不要自行换行。\n\n"
OLD = "【当前旧译文（仅供检查，不得盲目照抄）】\n"
BEFORE, AFTER = "【最近已确认译文（用于统一术语、称谓和语气）】\n", "【邻近下文参考（尚未翻译的原文）】\n"


def system_prompt(extra: Column, style: Column) -> Column:
    """Rules, then the user's additions, then the style; an unknown style keeps its name with the default's text."""
    styles = F.create_map(*(F.lit(x) for kv in STYLES.items() for x in kv))
    added = T.strip(F.coalesce(extra, F.lit("")))
    return F.concat_ws("\n\n", F.lit(BASE_PROMPT), F.when(added != "", F.concat(F.lit("【用户补充要求】\n"), added)), F.concat(F.lit("【风格偏好（"), style, F.lit("）】\n"), F.coalesce(styles[style], F.lit(STYLES["自动判断"]))))


_SENTENCE_ENDS = re.compile(r"(?s).+?(?:[。！？.!?]+[”’\"」』）)\]]*\s*|$)")


def sub_units(text: str, limit: int, tokens: Callable[[str], int]) -> list[str]:
    """A line as requests: the line itself, or stretches of whole sentences within the limit.

    From each place the furthest sentence end within the limit is taken. Where not even one sentence fits, the cut falls
    at the last blank in the upper half of what should fit, or else right there.
    """
    if tokens(text) <= limit:
        return [text]
    ends = [m.end() for m in _SENTENCE_ENDS.finditer(text)] or [len(text)]
    out: list[str] = []
    at = nearest = 0
    while at < len(text):
        while ends[nearest] <= at:
            nearest += 1
        fitting = takewhile(lambda e: tokens(text[at:e]) <= limit, ends[nearest:])
        to = max(fitting, default=0)
        if not to:
            size = ends[nearest] - at
            room = max(1, size * limit // tokens(text[at : at + size]))
            blank = text.rfind(" ", at + max(1, room // 2), at + room + 1)
            to = blank if blank > at else at + room
        if piece := text[at:to].strip():
            out.append(piece)
        at = to + len(text[to:]) - len(text[to:].lstrip())
    return out or [text]


def tokens_of(text: str) -> int:
    inside = sum(map(str.isascii, text)) if not text.isascii() else len(text)
    return max(1, int((len(text) - inside) * 1.2 + inside / 3.2) + 1)


def semantic_units(df: DataFrame, text: str, size: int) -> DataFrame:
    """Adds pieces: only lines above the limit leave the JVM; the cut depends on what is left, so it is a loop."""
    limit = T.unit_limit(size)

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: sub_units(x, limit, tokens_of))

    over = T.tokens(C(text)) > limit
    short = df.where(~over).withColumn("pieces", F.array(text))
    return short.unionByName(df.where(over).withColumn("pieces", cut(C(text))))


def fixed_tokens() -> int:
    """The system prompt without additions, in the default style."""
    return tokens_of(BASE_PROMPT + "\n\n【风格偏好（自动判断）】\n" + STYLES["自动判断"])


def reference_budget(units: DataFrame, key: str, size: int) -> DataFrame:
    """(key, budget): tokens that the fixed reference of a document may take, by the largest of its requests.

    Requests are the pieces of its lines, so a long line counts by its pieces; only lines above the limit leave the JVM.
    """
    size = T.context_size(size)
    limit = T.unit_limit(size)

    @F.pandas_udf("int")
    def largest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda a: max((tokens_of(p) for x in a for p in sub_units(x, limit, tokens_of) if p.strip()), default=0)).astype("int32")

    n = T.tokens(C("text"))
    docs = units.groupBy(key).agg(F.max(F.when((n <= limit) & (T.strip(C("text")) != ""), n)).alias("short"), F.collect_list(F.when(n > limit, C("text"))).alias("long"))
    docs = docs.select(key, F.greatest(F.coalesce("short", F.lit(0)), largest("long")).alias("n"))
    # The budget of the largest reply grows with the request; without any request the least of both counts.
    reply = F.when(C("n") > 0, F.greatest(F.lit(256), (C("n") * F.lit(1.5)).cast("int") + 256)).otherwise(256)
    free = size - fixed_tokens() - 512 - T.context_caps(size)[0] - max(256, min(4096, int(size * 0.06)))
    return docs.select(key, F.greatest(F.lit(0), F.lit(free) - F.greatest(C("n"), F.lit(1)) - reply).alias("budget"))


def block(source: Column, translated: Column) -> Column:
    return F.concat(F.lit("[原文]\n"), source, F.lit("\n[译文]\n"), translated)


def capped(items: Column, cap: int) -> Column:
    """The longest prefix of an array of texts whose token estimates add up to at most cap."""
    start = F.struct(F.lit(0).alias("used"), F.lit(True).alias("open"), F.array().cast("array<string>").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        used = a["used"] + T.tokens(x)
        fits = a["open"] & (used <= cap)
        return F.struct(F.when(fits, used).otherwise(a["used"]).alias("used"), fits.alias("open"), F.when(fits, F.concat(a["kept"], F.array(x))).otherwise(a["kept"]).alias("kept"))

    return F.aggregate(items, start, step)["kept"]


def with_context(units: DataFrame, key: str, size: int, before: int = 2, after: int = 2) -> DataFrame:
    """Adds context_before and context_after of translatable units (text, line_no), with the stub's translations.

    One window partitioning by document; frames of a few rows.
    """
    order = Window.partitionBy(key).orderBy("line_no")
    cap_before, cap_after = T.context_caps(size)
    past = F.collect_list(block(C("text"), stub(C("text")))).over(order.rowsBetween(-before, -1))
    coming = F.collect_list("text").over(order.rowsBetween(1, after))
    return units.withColumn("context_before", F.array_join(F.reverse(capped(F.reverse(past), cap_before)), "\n\n")).withColumn("context_after", F.array_join(capped(F.transform(coming, T.strip), cap_after), "\n\n"))


def with_future(requests: DataFrame, key: str, size: int, after: int = 2) -> DataFrame:
    """Adds context_after to requests (key, line_no, piece, unit): the next pieces, of the same line or of the lines after
    it, whole ones while the token cap allows."""
    order = Window.partitionBy(key).orderBy("line_no", "piece")
    coming = F.collect_list("unit").over(order.rowsBetween(1, after)) if after > 0 else F.array().cast("array<string>")
    return requests.withColumn("context_after", F.array_join(capped(F.transform(coming, T.strip), T.context_caps(size)[1]), "\n\n"))


def prompt(
    text: Column, before: Column, after: Column, mode: Column, source: Column, target: Column,
    reference: Column | None = None, kind: Column | None = None, again: Column | None = None, old: Column | None = None,
) -> Column:
    """A unit's request. mode: strong, possible or ''; again: whether it is translated anew, with the old text if there is one."""
    reference, kind, again, old = (F.lit(v) if c is None else c for c, v in ((reference, ""), (kind, ""), (again, False), (old, "")))
    note = F.when(mode == "strong", F.lit("\n\n" + STRONG)).when(mode == "possible", F.lit("\n\n" + POSSIBLE)).otherwise("")
    task = F.concat(F.lit("\n\n【当前待译文本（"), source, F.lit(" → "), target, F.lit("）】\n"), text)
    fixed = F.concat(F.lit("【固定"), kind, F.lit("（只供理解，禁止翻译或输出）】\n"), reference, F.lit("\n【固定"), kind, F.lit("结束】"))
    around = F.concat_ws("\n\n", F.when(reference != "", fixed), F.when(before != "", F.concat(F.lit(BEFORE), before)), F.when(after != "", F.concat(F.lit(AFTER), after)))
    anew = F.concat(
        F.lit(AGAIN), F.when(old != "", F.lit(AGAIN_OLD)).otherwise(AGAIN_NEW), F.lit(AGAIN_ONLY), F.when(around != "", F.concat(around, F.lit("\n\n"))).otherwise(""),
        F.when(old != "", F.concat(F.lit("\n\n" + OLD), old)).otherwise(""),
    )
    return F.concat(F.when(again, anew).when(around == "", F.lit(ALONE)).otherwise(F.concat(F.lit(BESIDE), around)), note, task)


def request(text: str, before: str, after: str, mode: str, source: str, target: str, reference: str = "", kind: str = "") -> str:
    """prompt() for one unit whose history is known only as the loop goes, with the fixed reference if there is one."""
    fixed = f"【固定{kind}（只供理解，禁止翻译或输出）】\n{reference}\n【固定{kind}结束】" if reference else ""
    around = "\n\n".join(x for x in (fixed, before and BEFORE + before, after and AFTER + after) if x)
    note = {"strong": "\n\n" + STRONG, "possible": "\n\n" + POSSIBLE}.get(mode, "")
    return (BESIDE + around if around else ALONE) + note + f"\n\n【当前待译文本（{source} → {target}）】\n{text}"


def may_continue(previous: str, current: str) -> str:
    """T.may_continue for one pair of texts."""
    p, c = previous.strip(), current.lstrip()
    if not p or not c or re.search(r"[.!?。！？…]\Z", re.sub(r"[\s\"'”’」』）)\]]+\Z", "", p)):
        return ""
    return "possible" if re.match(r"[a-zà-öø-ÿ]", re.sub(r"^[\"'“”‘’([{]+", "", c)) or p.endswith(("-", "–", "—", ",", ";")) else ""


def reference_plan(units: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """(file_id, line_no, reference, kind) of the first unit of every window; it holds up to the next one.

    A document whose reference fits its budget has one window with the whole text, of subtitles the units only.
    """
    translated = boundaries(units.where("unit.translate").select("file_id", "ext", "line_no", "line", "unit.text"), "file_id")
    item = F.struct("line_no", "line", (T.tokens(C("line")) + 2).alias("cost"), "boundary")
    docs = translated.groupBy("file_id").agg(F.max("ext").alias("ext"), F.sort_array(F.collect_list(item)).alias("u")).join(reference_budget(translated, "file_id", size), "file_id").where("budget > 0")
    whole = units.where(~C("ext").isin(SUBTITLES)).groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("a"))
    whole = whole.select("file_id", T.strip(F.array_join(F.transform("a", lambda x: x["line"]), "\n")).alias("whole"))
    pairs = F.transform("u", lambda x: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line")))
    docs = docs.join(whole, "file_id", "left").withColumn("whole", F.when(C("ext").isin(SUBTITLES), excerpt(pairs)).otherwise(C("whole")))
    fits = (C("whole") != "") & (T.tokens(C("whole")) <= C("budget"))
    one = docs.where(fits).select("file_id", F.get("u", F.lit(0))["line_no"].alias("line_no"), C("whole").alias("reference"), F.lit("全文原文参考").alias("kind"))
    core = F.greatest(F.lit(128), (C("budget") * F.lit(0.68)).cast("int"))
    made = windows(F.transform("u", lambda x: x["cost"]), F.transform("u", lambda x: x["boundary"]), core)
    many = docs.where(~fits).select("file_id", "u", "budget", F.explode(made).alias("w"))
    cut = trimmed(C("u"), C("w.first"), C("w.last"), before, after, C("budget"))
    return one.unionByName(many.select("file_id", F.get("u", C("w.first"))["line_no"].alias("line_no"), cut.alias("reference"), F.lit("当前语义窗口参考").alias("kind")))


def boundaries(units: DataFrame, key: str) -> DataFrame:
    """Adds boundary: a window of a document may start at its first unit, after a gap, or at a heading."""
    gap = C("line_no") - F.lag("line_no").over(Window.partitionBy(key).orderBy("line_no"))
    return units.withColumn("boundary", F.coalesce(gap > 1, F.lit(True)) | C("line").rlike(rf"(?U)\A{T.WS}{{0,3}}#{{1,6}}[ \t]+"))


def excerpt(pairs: Column) -> Column:
    """Ordered (line_no, line) pairs as text, one blank line for every gap, stripped."""
    start = F.struct(F.lit(-1).alias("last"), F.lit("").alias("text"))

    def step(a: Column, p: Column) -> Column:
        gap = F.when(a["last"] < 0, "").when(p["line_no"] - a["last"] > 1, "\n\n").otherwise("\n")
        return F.struct(p["line_no"].alias("last"), F.concat(a["text"], gap, p["line"]).alias("text"))

    return T.strip(F.aggregate(pairs, start, step)["text"])


def windows(costs: Column, edges: Column, budget: int | Column) -> Column:
    """Core windows of a document as array<struct(first, last)>: one fold step per window.

    costs: tokens + 2 by position; edges: whether a window may start there. A window takes units while they fit, at
    least one, and goes back to its last edge if that keeps a third of it.
    """
    n = F.size(costs)
    sums = T.running(costs)
    return_type = "array<struct<first: int, last: int>>"

    def step(a: Column, _: Column) -> Column:
        start = a["at"]
        base = F.get(a["sums"], start)
        fit = F.size(F.filter(F.slice(a["sums"], start + 2, F.greatest(n - start, F.lit(0))), lambda s: s - base <= budget))
        end = start + F.greatest(F.lit(1), fit)
        marks = F.filter(F.when(end > start, F.sequence(start + 1, end)), lambda i: (i >= n) | F.coalesce(F.get(edges, i), F.lit(True)))
        back = F.array_max(marks)
        stop = F.when((end < n) & back.isNotNull() & (back - start >= F.greatest(F.lit(1), F.floor((end - start) / 3).cast("int"))), back).otherwise(end)
        return F.when(start >= n, a).otherwise(F.struct(stop.alias("at"), a["sums"].alias("sums"), F.concat(a["out"], F.array(F.struct(start.alias("first"), stop.alias("last")))).alias("out")))

    start = F.struct(F.lit(0).alias("at"), sums.alias("sums"), F.array().cast(return_type).alias("out"))
    return F.aggregate(costs, start, step)["out"]


def trimmed(units: Column, first: Column, last: Column, before: int, after: int, budget: int | Column) -> Column:
    """The excerpt of a window with its overlap, cut until it fits: overlap before, overlap after, the core from its end.

    units: array<struct(line_no, line, …)>; at least one unit of the core must fit, else the excerpt is empty. Only a
    window that does not fit at once tries its cuts, in order.
    """
    left, right = F.greatest(F.lit(0), first - before), F.least(F.size(units), last + after)

    def at(a: Column, b: Column) -> Column:
        return excerpt(F.transform(F.slice(units, a + 1, b - a), lambda x: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"))))

    def cut(i: Column) -> Column:
        gone_left = F.least(i, first - left)
        gone_right = i - gone_left
        return at(left + gone_left, right - gone_right)

    whole = at(left, right)
    most = (first - left) + (right - last) + (last - first - 1)
    tried = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), most)), cut)
    fits = F.filter(tried, lambda t: T.tokens(t) <= budget)
    return F.when(T.tokens(whole) <= budget, whole).when(most < 1, "").otherwise(F.coalesce(F.get(fits, F.lit(0)), F.lit("")))
