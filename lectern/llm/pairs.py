"""Problem 1: broken prompt and response pairs.

A pair is a file's content and its translated content. Prompt and response are aligned by shingle containment and, where
that leaves doubt, by the longest common subsequence of their words (bit-parallel, after equal ends and words that only
one side has are taken off, and in blocks of BLOCK words, so that memory stays small whatever the length). Responses are
aligned with refusal templates: whole sentences (below) and templates of slots (`refusal`), by the same subsequence. The
defects, the first that applies:

* empty: null, or no word apart from lines that are never translated, while the prompt has words;
* refusal: at least half of the response aligns with refusal templates;
* copied: at least three quarters of the prompt's words that need translation come back in order;
* wrong_language: most of the response is in neither the prompt's language nor the target;
* truncated: fewer worded lines than the prompt, an end in mid-sentence, or a last reply that ended for length.

Only verdicts are shuffled by key; a small input is spread over the cores first. Attempts are reduced to the last of each
line before they meet a file. Defined results: a file without a reply is no pair; a file delivered twice gives one row,
that of the gravest verdict in the order above; null content counts as empty text; an unknown target language only
switches off the language tests; ties between attempts go to the later arrival.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, map_rows, normal, spread, table
from .language import Languages, fit
from .markup import BLANK, CODE, NUMBER, TEXT, plain, scan
from .refusal import declines
from .refusal import refusing as slotted

SHINGLE = 3
COPIED = 0.75
#: A containment outside these bounds decides alone.
DOUBT = (0.2, 0.97)
ALIKE = 0.6
BLOCK = 16_384
DEFECTS = ("empty", "refusal", "copied", "wrong_language", "truncated")

# What a refusing model says, by language.
REFUSALS = """
I'm sorry, but I can't translate this text.
I am unable to assist with that.
Sorry, this is something I'd rather not render into another language.
I must decline to work on this passage.
It would not be appropriate for me to translate the material you sent.
As a language model I am not able to process this request.
As an AI assistant I cannot help with this request.
No translation can be offered here because the passage may be harmful.
My instructions do not allow me to handle text of this kind; try another tool.
This request goes against the guidelines, so no translation is given.
Unfortunately I cannot provide a translation of this content.
Please consult a professional.
对不起，我无法翻译这段文字。
抱歉，我不便处理这段内容。
作为语言模型，我不能处理这个请求。
本人只是一个人工智能助手，无权翻译此类材料。
我没有办法协助完成您的要求。
恕我不能完成这项翻译。
该请求违反规定，因此不提供翻译。
内容可能不合适，因此未予翻译。
请换一段文字，这一段我不予处理。
很遗憾，这份内容无法提供译文，请咨询专业人士。
申し訳ありませんが、この文章は翻訳できません。
恐れ入りますが、この依頼はお受けできません。
言語モデルとして、このご依頼には対応できません。
この種の文章を訳すことは控えさせていただきます。
このご依頼は規定に反するため、翻訳は行いません。
残念ながら、この内容の翻訳はご提供できません。
죄송하지만 이 글은 번역할 수 없습니다.
이런 자료를 옮기는 것은 적절하지 않습니다.
언어 모델로서 이 요청을 처리할 수 없습니다.
이 요청은 지침에 어긋나므로 번역을 제공하지 않습니다.
안타깝게도 이 내용의 번역을 제공할 수 없습니다.
이 구절은 다루지 않겠습니다.
Je suis désolé, mais je ne peux pas traduire ce texte.
Il m'est malheureusement impossible de fournir une traduction de ce contenu.
En tant que modèle de langue, je ne suis pas en mesure de traiter cette demande.
Je préfère ne pas traiter ce passage.
Traduire un tel document ne serait pas approprié de ma part.
Cette demande est contraire aux règles, aucune traduction n'est donc donnée.
Es tut mir leid, aber ich kann diesen Text nicht übersetzen.
Leider ist es mir nicht möglich, eine Übersetzung dieses Inhalts zu liefern.
Als Sprachmodell bin ich nicht in der Lage, diese Anfrage zu bearbeiten.
Diesen Abschnitt darf ich leider nicht bearbeiten.
Diese Anfrage verstößt gegen die Richtlinien, daher erfolgt keine Übersetzung.
Es wäre nicht angemessen, dieses Material zu übersetzen.
Lo siento, pero no puedo traducir este texto.
Lamentablemente no me es posible ofrecer una traducción de este contenido.
Como modelo de lenguaje, no estoy en condiciones de procesar esta solicitud.
Prefiero no trabajar con este pasaje.
Esta solicitud va contra las directrices, por lo que no se da ninguna traducción.
No sería apropiado que yo tradujera este material.
Mi dispiace, ma non posso tradurre questo testo.
Purtroppo non mi è possibile fornire una traduzione di questo contenuto.
In quanto modello linguistico non sono in grado di elaborare questa richiesta.
Preferisco non lavorare su questo passo.
Questa richiesta è contraria alle linee guida, quindi non viene data alcuna traduzione.
Non sarebbe opportuno che io traducessi questo materiale.
Sinto muito, mas não posso traduzir este texto.
Infelizmente não me é possível oferecer uma tradução deste conteúdo.
Como modelo de linguagem, não estou em condições de processar este pedido.
Prefiro não trabalhar neste trecho.
Este pedido vai contra as diretrizes, por isso nenhuma tradução é dada.
Não seria apropriado que eu traduzisse este material.
Извините, но я не могу перевести этот текст.
К сожалению, я не могу предоставить перевод этого содержания.
Как языковая модель, я не в состоянии обработать этот запрос.
Я вынужден отказаться от работы с этим отрывком.
Этот запрос противоречит правилам, поэтому перевод не даётся.
Было бы неуместно переводить этот материал.
عذرا، لا أستطيع ترجمة هذا النص.
للأسف لا يمكنني تقديم ترجمة لهذا المحتوى.
بصفتي نموذجا لغويا، لا أستطيع معالجة هذا الطلب.
هذا الطلب يخالف القواعد، لذلك لا تقدم ترجمة.
أفضل عدم العمل على هذا المقطع.
ليس من المناسب أن أترجم هذه المادة.
ขออภัย ฉันแปลข้อความนี้ไม่ได้
ขอโทษด้วย ฉันไม่สามารถแปลเนื้อหานี้ได้
ในฐานะแบบจำลองภาษา ฉันไม่สามารถดำเนินการตามคำขอนี้ได้
คำขอนี้ขัดต่อแนวทาง จึงไม่มีการแปลให้
น่าเสียดายที่ไม่สามารถให้คำแปลของเนื้อหานี้ได้
ฉันขอไม่ทำงานกับข้อความนี้
""".strip().split("\n")

_DENSE = "぀-ヿ㐀-䶿一-鿿豈-﫿ก-๎"
_TOKEN = re.compile(rf"[{_DENSE}]|[^\W\d_{_DENSE}]+")
_WORD = re.compile(rf"[{_DENSE}가-힯]|[^\W\d_]{{2,}}")
_SENTENCE = re.compile(r"[^.!?。！？;；\n]+[.!?。！？;；]*[”»」\")]*")
_OPEN = tuple("“„«‹「『‘\"")
_ENDS = re.compile(r"[.!?。！？…؟।:：;；]+[\"'“”‘’»›«」』）)\]}*_`~<>/a-z\s]*$")
#: A script whose sentences end without a stop.
_UNSTOPPED = re.compile(r"[ก-๎]")
_CLOSED = re.compile(r"</\w+>$")


def tokens(text: str) -> list[str]:
    """Words in small letters; signs of scripts without blanks stand alone."""
    return _TOKEN.findall(text.lower())


def subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a long integer's bits at a time.

    Equal ends belong to it, and words that only one side has do not. What is left of the shorter side is taken in blocks;
    a block hands its carry of every word of the other side to the next, so the result does not depend on BLOCK.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    both = set(a) & set(b)
    a, b = [x for x in a if x in both], [x for x in b if x in both]
    if len(a) > len(b):
        a, b = b, a
    total = head + tail
    carries = bytearray(len(b))
    for start in range(0, len(a), BLOCK):
        block = a[start : start + BLOCK]
        at: dict[str, int] = {}
        for i, x in enumerate(block):
            at[x] = at.get(x, 0) | 1 << i
        n = len(block)
        full = (1 << n) - 1
        row = full
        more = start + n < len(a)
        for j, x in enumerate(b):
            hit = row & at.get(x, 0)
            if hit or carries[j]:
                added = row + hit + carries[j]
                carries[j] = added >> n if more else 0
                row = (added | row - hit) & full
        total += n - row.bit_count()
    return total


def containment(a: list[str], b: list[str], size: int = SHINGLE) -> float:
    """Share of a's shingles that b has too."""
    size = min(size, len(a))
    if not size:
        return 0.0
    held = set(zip(*(b[i:] for i in range(size))))
    own = list(zip(*(a[i:] for i in range(size))))
    return sum(x in held for x in own) / len(own)


_TEMPLATES = [tokens(x) for x in REFUSALS]
_TEMPLATE_SETS = [set(x) for x in _TEMPLATES]


def refusing(sentence: str) -> bool:
    """Whether a sentence aligns with a template: with one of slots, or a whole one by twice the common subsequence
    against both lengths."""
    if slotted(sentence, subsequence):
        return True
    own = tokens(sentence)
    held = set(own)
    for t, s in zip(_TEMPLATES, _TEMPLATE_SETS):
        if len(held & s) >= ALIKE * 0.8 * len(s) and 2 * subsequence(own, t) >= ALIKE * (len(own) + len(t)):
            return True
    return False


def refusal_share(text: str) -> float:
    """Share of the response's letters in refusing sentences. Quoted speech refuses nothing."""
    if not declines(text):
        return 0.0
    own = total = 0
    known: dict[str, bool] = {}
    for sentence in _SENTENCE.findall(text):
        s = sentence.strip().lower()
        n = len(s)
        if not n:
            continue
        total += n
        if s.startswith(_OPEN):
            continue
        if s not in known:
            known[s] = refusing(s)
        own += n * known[s]
    return own / total if total else 0.0


class Pairs:
    """Judges one pair. targets: language by label."""

    def __init__(self, languages: Languages, targets: dict[str, str]):
        self.languages, self.targets = languages, targets

    def judge(self, content: str | None, answer: str | None, target: str | None) -> tuple[str | None, float, float, int, bool]:
        """(defect or None, containment, subsequence share, last line of the response, whether the ends can be compared)."""
        lines = normal(content or "").split("\n")
        kinds = scan(lines)
        asked = [(i, plain(x)) for i, (x, k) in enumerate(zip(lines, kinds)) if k == TEXT]
        asked = [(i, x) for i, x in asked if _WORD.search(x)]
        if answer is None or not answer.strip():
            return "empty", 0.0, 0.0, -1, False
        back = normal(answer).split("\n")
        back_kinds = scan(back)
        given = [(i, plain(x)) for i, (x, k) in enumerate(zip(back, back_kinds)) if k == TEXT]
        given = [(i, x) for i, x in given if _WORD.search(x)]
        if not given:
            return "empty" if asked or not any(k in (NUMBER, TEXT, CODE) for k in back_kinds) else None, 0.0, 0.0, -1, False
        if not asked:
            return None, 0.0, 0.0, given[-1][0], False
        text = "\n".join(x for _, x in given)
        if refusal_share(text) >= 0.5:
            return "refusal", 0.0, 0.0, given[-1][0], False
        a, b = tokens(" ".join(x for _, x in asked)), tokens(text)
        share = containment(a, b)
        same = share
        if DOUBT[0] <= share <= DOUBT[1]:
            same = subsequence(a, b) / len(a)
        elif share > DOUBT[1]:
            same = 1.0
        goal = self.targets.get((target or "").strip().lower())
        if same >= COPIED:
            own = self.languages.segments(content)
            if not goal or sum(n for *_, k, _, n in own if k == goal) < 0.5 * sum(x[4] for x in own):
                return "copied", share, same, given[-1][0], False
        found = self.languages.segments(answer)
        letters = sum(x[4] for x in found)
        if goal and letters and sum(n for *_, k, _, n in found if k == goal) < 0.5 * letters:
            own = {k for *_, k, _, _ in self.languages.segments(content)}
            if sum(n for *_, k, _, n in found if k != goal and k not in own) > 0.5 * letters:
                return "wrong_language", share, same, given[-1][0], False
        full = sum(k != BLANK for k in kinds)
        got = sum(k != BLANK for k in back_kinds)
        last, end = lines[asked[-1][0]].strip(), back[given[-1][0]].strip()
        lost = sum(k != BLANK for k in kinds[asked[-1][0] + 1 :])
        left = sum(k != BLANK for k in back_kinds[given[-1][0] + 1 :])
        if got < full and not (got + lost >= full and left == 0 and lost):
            return "truncated", share, same, given[-1][0], False
        tag = _CLOSED.search(last)
        if tag and tag[0] not in end and tag[0] in lines[asked[-1][0]]:
            return "truncated", share, same, given[-1][0], False
        if _ENDS.search(plain(last)) and not _ENDS.search(plain(end)) and not _UNSTOPPED.search(text):
            return "truncated", share, same, given[-1][0], False
        return None, share, same, given[-1][0], True


VERDICTS = pa.schema([("file_id", pa.int64()), ("verdict", pa.string()), ("containment", pa.float64()), ("subsequence", pa.float64()), ("last_line", pa.int32())])


def last_replies(choices: DataFrame) -> DataFrame:
    """(file_id, last_line, finish_reason of the last attempt at the last line that got words back)."""
    last = F.struct(F.coalesce("attempt", F.lit(0)), "arrived_at", "choice_id")
    lines = choices.where("file_id is not null").groupBy("file_id", "line_no").agg(F.max_by(F.struct("finish_reason", F.expr("length(trim(coalesce(content, ''))) > 0").alias("worded")), last).alias("r"))
    said = F.when(F.col("r.worded"), F.struct(F.coalesce("line_no", F.lit(-1)).alias("n"), F.col("r.finish_reason").alias("finish_reason")))
    return lines.groupBy("file_id").agg(F.max(said).alias("m"), F.count_if(F.col("r.finish_reason") == "length").alias("cut_lines")).select("file_id", F.col("m.finish_reason").alias("finish_reason"), "cut_lines")


def pairs(files: DataFrame, choices: DataFrame, languages: DataFrame, model: Languages) -> DataFrame:
    """One row per file with a reply: defect (or null), containment, subsequence share, finish_reason, cut_lines."""
    targets = {}
    for r in bounded(languages, 1_000, "languages"):
        targets |= {str(x).strip().lower(): r.lang for x in (r.lang, r.label, r.name_en, r.iso3) if x}
    judge = Pairs(model, targets).judge

    def each(file_id, content, answer, target):
        return [(file_id, *judge(content, answer, target)[:4])]

    verdicts = map_rows(files, ["file_id", "content", "translated_content", "target_language"], each, VERDICTS, "file_id long, verdict string, containment double, subsequence double, last_line int")
    # Deliveries of one file are equal; should they differ, the gravest stands, whole.
    rank = F.coalesce(*(F.when(F.col("verdict") == d, F.lit(i)) for i, d in enumerate(DEFECTS)), F.lit(len(DEFECTS)))
    gravest = F.min(F.struct(rank.alias("rank"), -F.col("containment"), "subsequence", "verdict", "containment")).alias("v")
    joined = verdicts.where("file_id is not null").groupBy("file_id").agg(gravest).select("file_id", "v.verdict", "v.containment", "v.subsequence").join(last_replies(choices), "file_id")
    defect = F.coalesce("verdict", F.when(F.col("finish_reason") == "length", F.lit("truncated")))
    return joined.select("file_id", defect.alias("defect"), "containment", "subsequence", "finish_reason", "cut_lines")


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair with its alignment figures and defect."""
    files = spread(table(spark, sf_dir, "files").select("file_id", "content", "translated_content", "target_language"))
    return pairs(files, table(spark, sf_dir, "choices"), table(spark, sf_dir, "languages"), fit(spark, sf_dir))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defective files."""
    return p1_pairs(spark, sf_dir).where("defect is not null").select("file_id", "defect")
