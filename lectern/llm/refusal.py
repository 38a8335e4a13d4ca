"""Refusals: sentences in which a model declines, aligned with templates of slots.

A template says in which order the slots of a refusal stand: an apology or the speaker, what cannot be done, and the act
(with its object), or object, act and inability where the language ends on the verb. PHRASES fill the slots in each
language. An automaton finds the phrases; around each inability the phrases make a sequence of slots, and the longest
common subsequence with the templates tells whether it is one, with half of the letters it spans explained by phrases.
A sentence of any length is looked at whole. Quoted speech refuses nothing.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick

#: Letters between an inability and its act or speaker, at most; share of the letters from first to last that phrases explain.
NEAR = 80
EXPLAINED = 0.5

# What fills the slots, by language. Slots: a apology, s speaker, n inability, i inability in the first person,
# v act, o object. A star stands for any ending; scripts without blanks and Korean match anywhere.
PHRASES = """
en a: sorry | apolog* | unfortunately | regret* | afraid
en s: i | me | my | ai | language model | assistant | request* | guideline* | polic* | instructions
en n: cannot | can not | can't | can’t | couldn't | unable | not able | won't | won’t | will not | decline* | refus* | impossible | not possible | not permitted | not allowed | not something | not appropriate | not be appropriate | inappropriate | outside what | beyond what | rather not | not comfortable | do not allow | goes against | against | no translation
en v: translat* | help* | assist* | process* | handl* | fulfil* | comply* | provid* | offer* | render* | complet* | work* | deal* | respond* | proceed* | given
en o: this | that | text* | content* | passage* | material* | document* | here | such | with | for | of | to | am | is | be | it | as | an
zh a: 对不起 | 抱歉 | 不好意思 | 很遗憾 | 遗憾 | 恕
zh s: 我 | 本人 | 助手 | 语言模型 | 人工智能 | ai | 请求 | 规定
zh n: 不能 | 无法 | 不便 | 没法 | 没有办法 | 无权 | 不予 | 未予 | 不被允许 | 不了 | 超出 | 违反 | 不提供 | 不会
zh v: 翻译 | 帮 | 处理 | 完成 | 提供 | 译文 | 协助 | 回答 | 满足
zh o: 这段 | 这份 | 此类 | 这个 | 该 | 文字 | 内容 | 材料 | 要求 | 您 | 作为 | 为 | 的 | 请
ja a: 申し訳 | すみません | 恐れ入ります | 残念 | ごめん
ja s: 私 | ai | アシスタント | 言語モデル | ご依頼 | 依頼 | リクエスト | 規定
ja n: できません | できかね | お断り | られません | お受けできない | いたしかね | 控え | 行いません | 断りします | 断りいたし | 反する
ja v: 翻訳 | 訳 | 手伝 | 扱う | 対応 | 応じ | お受け | 提供 | 処理
ja o: この | その | テキスト | 文章 | 文書 | 内容 | こと | ありません | ございません | ですが | として | する | を | は | が | の
ko a: 죄송 | 미안 | 안타깝 | 유감
ko s: 저는 | ai | 도우미 | 언어 모델 | 요청 | 지침
ko n: 수 없 | 못합니다 | 못해 | 거절 | 적절하지 않 | 않겠 | 어긋나 | 제공하지 않
ko v: 번역 | 도와 | 처리 | 옮기 | 다루 | 제공 | 드릴 | 해야
ko o: 이런 | 이 | 글 | 문장 | 텍스트 | 자료 | 내용 | 구절 | 로서 | 으로 | 합니다 | 습니다
fr a: désolé* | regret* | malheureusement | navré* | excus*
fr s: je | m | me | ia | modèle de langue | assistant | demande* | règles
fr i: je ne peux | je ne suis pas | je dois refuser | m'est impossible | je préfère ne pas
fr n: impossible | refus* | ne serait pas approprié | contraire | aucune traduction
fr v: trad* | aid* | trait* | fournir | assister | répondre
fr o: ce | cette | cet | un | une | tel | de | texte | document | contenu | passage | vous | avec | en | tant que | mais | pas | donnée | il | est | malheureusement | mesure | autorisé*
de a: leid | entschuldig* | leider | bedau* | verzeih*
de s: ich | mir | ki | sprachmodell | assistent | anfrage* | richtlinien
de n: nicht | ablehn* | unmöglich | verweiger* | keine übersetzung | verstößt
de v: übersetz* | helf* | bearbeit* | verarbeit* | liefer* | beantwort*
de o: diese* | der | die | das | den | es | text* | inhalt* | abschnitt* | material | kann | darf | bin | muss | möglich | zu | bei | als | eine | aber | befugt | lage | solche* | wäre | angemessen
es a: lo siento | perdón | lament* | desafortunadamente | temo | disculp*
es s: me | yo | ia | modelo de lenguaje | asistente | solicitud | petición | directrices
es i: no puedo | no estoy | no soy capaz | debo negarme | prefiero no | no me es posible
es n: imposible | no es posible | no sería apropiado | contra las | ninguna traducción
es v: trad* | ayud* | proces* | ofrecer | trabajar | proporcionar
es o: este | esta | un | una | el | la | texto | contenido | fragmento | pasaje | material | con | como | a | que | pero | de | autorizado | da
it a: mi dispiace | mi spiace | scusa* | purtroppo | sfortunatamente | spiacente
it s: mi | io | ia | modello linguistico | assistente | richiesta | linee guida
it i: non posso | non sono | devo rifiutare | preferisco non | non mi è possibile
it n: impossibile | non è possibile | non sarebbe opportuno | contraria | alcuna traduzione
it v: trad* | aiut* | elabor* | fornire | lavorare
it o: questo | questa | un | una | testo | contenuto | brano | passo | materiale | con | come | di | a | in grado | ma | autorizzato
pt a: desculp* | lament* | infelizmente | sinto muito | perdão
pt s: me | eu | ia | modelo de linguagem | assistente | pedido | diretrizes
pt i: não posso | não estou | não consigo | não sou capaz | devo recusar | prefiro não | não me é possível
pt n: impossível | não é possível | não seria apropriado | contra as | nenhuma tradução
pt v: trad* | ajudar | process* | fornecer | oferecer | trabalhar
pt o: este | esta | deste | desta | neste | um | uma | texto | conteúdo | trecho | material | com | como | a | de | mas | autorizado | dada
ru a: извин* | простите | прошу прощения | к сожалению | сожале*
ru s: я | мне | ии | языковая модель | помощник | запрос* | просьб* | правил*
ru n: не могу | не в состоянии | не разрешено | отказ* | невозможно | не смогу | неуместно | противоречит | не даётся | не имею права
ru v: перев* | помочь | обработ* | выполнить | предоставить | работ*
ru o: этот | этого | этой | эту | этим | такие | с | от | текст* | фрагмент* | отрыв* | материал* | содержан* | но | как | вынужден
ar a: آسف | عذرا | أعتذر | للأسف | مع الأسف | المعذرة
ar s: أنا | بصفتي | نموذجا لغويا | مساعد* | الطلب | القواعد
ar i: لا أستطيع | لا يمكنني | لست قادرا | أرفض | لن أتمكن | أفضل عدم
ar n: ليس من المناسب | لا تقدم | يخالف
ar v: ترجم* | الترجمة | المساعدة | معالجة | تقديم | العمل | أترجم
ar o: هذا | هذه | النص | المحتوى | المقطع | المادة | في | على | أن | يجب | لهذا | آليا | لذلك
th a: ขออภัย | ขอโทษ | เสียใจ | น่าเสียดาย
th s: ฉัน | ผม | ai | แบบจำลองภาษา | คำขอ
th n: ไม่สามารถ | ไม่ได้ | ปฏิเสธ | ขอไม่ | ขัดต่อ | ไม่มีการ
th v: แปล | ช่วย | ดำเนินการ | ทำงาน | ให้คำ
th o: ข้อความ | เนื้อหา | เอกสาร | เรื่อง | นี้ | การ | ได้ | ด้วย | ในฐานะ | ครับ | ค่ะ | ต้อง | กับ | ตาม | ของ | ที่ | รับอนุญาต | ให้
""".strip()

TEMPLATES = ["anv", "snv", "nvs", "vns", "avn", "svn", "nva", "iv", "vi"]
_QUOTED = re.compile(r"[“„«‹「『\"][^“„«‹「『”»›」』\"]*[”»›」』“\"]?")
_LOOSE = ("zh", "ja", "ko", "th")


@lru_cache(1)
def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """Finders of inabilities alone and of all phrases: (length, slot, language, whether any ending will do)."""
    rare, every = {}, {}
    for line in PHRASES.split("\n"):
        head, _, phrases = line.partition(": ")
        lang, slot = head.split()
        for phrase in phrases.split(" | "):
            word = phrase.rstrip("*")
            entry = (len(word), slot, lang, phrase != word)
            every.setdefault(word, []).append(entry)
            if slot in "ni":
                rare.setdefault(word, []).append(entry)
    out = []
    for table in (rare, every):
        a = ahocorasick.Automaton()
        for word, entries in table.items():
            a.add_word(word, entries)
        a.make_automaton()
        out.append(a)
    return tuple(out)


def _found(automaton: ahocorasick.Automaton, text: str) -> dict[str, list[tuple[int, int, str]]]:
    """(start, end, slot) of the phrases by language, the longest of those that overlap."""
    out: dict[str, list[tuple[int, int, str]]] = {}
    n = len(text)
    for last, entries in automaton.iter(text):
        for size, slot, lang, open_end in entries:
            a, b = last + 1 - size, last + 1
            if lang not in _LOOSE or text[a].isascii():
                if a and text[a - 1].isalnum() or not open_end and b < n and text[b].isalnum():
                    continue
                while open_end and b < n and text[b].isalnum():
                    b += 1
            out.setdefault(lang, []).append((a, b, slot))
    for lang, found in out.items():
        found.sort(key=lambda x: (x[0] - x[1], x[0]))
        taken: list[tuple[int, int, str]] = []
        for x in found:
            if all(x[1] <= y[0] or x[0] >= y[1] for y in taken):
                taken.append(x)
        out[lang] = sorted(taken)
    return out


def declines(text: str) -> bool:
    """Whether a text can hold a refusal at all: some inability is worded in it."""
    return next(automata()[0].iter(text.lower()), None) is not None


def refusing(sentence: str, subsequence) -> bool:
    """Whether a sentence aligns with a template of slots. subsequence(a, b) is the length of the longest common one."""
    text = _QUOTED.sub(" ", sentence.lower())
    if not declines(text):
        return False
    for found in _found(automata()[1], text).values():
        for a, b, slot in found:
            if slot not in "ni":
                continue
            near = [x for x in found if x[1] > a - NEAR and x[0] < b + NEAR]
            slots = "".join(x[2] for x in near)
            if "v" not in slots:
                continue
            for template in TEMPLATES:
                if slot in template and subsequence(list(slots), list(template)) == len(template):
                    span = text[near[0][0] : near[-1][1]]
                    whole = sum(map(str.isalnum, span))
                    own = sum(map(str.isalnum, "".join(text[x[0] : x[1]] for x in near)))
                    if own >= EXPLAINED * whole:
                        return True
    return False
