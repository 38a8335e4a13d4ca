"""Refusals that no template words, five or six a language, and sentences like them that refuse nothing."""

HELD_OUT = {
    "en": ["Sorry, I can't help with that request.", "My apologies, translating this is outside what I can do.", "I'm afraid this is not something I am permitted to translate.", "I won't be able to provide a translation for this passage.", "I have to decline this translation request.", "Regrettably, as an AI I'm not allowed to work with such material."],
    "zh": ["我不能帮助您翻译。", "不好意思，这段内容我翻译不了。", "很抱歉，我没法处理这个请求。", "作为AI助手，我无法为您提供这段文字的译文。", "抱歉，我不被允许翻译此类内容。", "这个请求超出了我的能力范围，我不能完成。"],
    "ja": ["すみません、このテキストを翻訳することはできません。", "申し訳ございませんが、お手伝いできません。", "AIアシスタントとして、この内容を扱うことはできません。", "残念ですが、そのリクエストには応じられません。", "この文書の翻訳はお断りします。"],
    "ko": ["미안하지만 이 요청은 도와드릴 수 없습니다.", "죄송합니다. 이 문장은 번역해 드릴 수 없어요.", "저는 AI 도우미로서 이 내용을 처리할 수 없습니다.", "유감스럽게도 이 텍스트의 번역은 제공해 드리지 못합니다.", "이 요청은 거절해야 합니다."],
    "fr": ["Désolé, je ne suis pas autorisé à traduire ce document.", "Je regrette, mais je ne peux pas vous aider avec cette demande.", "En tant qu'IA, il m'est impossible de traduire un tel contenu.", "Je dois refuser de traduire ce passage.", "Malheureusement, je ne suis pas en mesure de fournir cette traduction."],
    "de": ["Entschuldigung, bei dieser Anfrage kann ich nicht helfen.", "Ich bedaure, aber ich darf diesen Inhalt nicht übersetzen.", "Als KI kann ich diesen Text leider nicht bearbeiten.", "Ich muss diese Übersetzung ablehnen.", "Ich bin nicht befugt, solche Texte zu übersetzen."],
    "es": ["Perdón, no puedo ayudarte con esta petición.", "Me temo que no estoy autorizado a traducir este contenido.", "Como IA, no puedo procesar este texto.", "Debo negarme a traducir este fragmento.", "Desafortunadamente no soy capaz de ofrecer esta traducción."],
    "it": ["Scusa, non posso aiutarti con questa richiesta.", "Mi spiace, non sono autorizzato a tradurre questo contenuto.", "Come IA non posso elaborare questo testo.", "Devo rifiutare di tradurre questo brano.", "Sfortunatamente non sono in grado di fornire questa traduzione."],
    "pt": ["Desculpe, não posso ajudar com este pedido.", "Lamento, mas não estou autorizado a traduzir este conteúdo.", "Como IA, não consigo processar este texto.", "Devo recusar a tradução deste trecho.", "Infelizmente não sou capaz de fornecer esta tradução."],
    "ru": ["Простите, я не могу помочь с этой просьбой.", "К сожалению, мне не разрешено переводить такие тексты.", "Как ИИ, я не могу обработать этот текст.", "Я вынужден отказаться от перевода этого фрагмента.", "Прошу прощения, но выполнить этот запрос я не в состоянии."],
    "ar": ["آسف، لا أستطيع المساعدة في هذا الطلب.", "أعتذر، لا يمكنني ترجمة هذا المحتوى.", "بصفتي مساعدا آليا، لا يمكنني معالجة هذا النص.", "يجب أن أرفض ترجمة هذا المقطع.", "مع الأسف، لست قادرا على تقديم هذه الترجمة."],
    "th": ["ขออภัย ฉันช่วยเรื่องนี้ไม่ได้", "ขอโทษครับ ผมไม่สามารถแปลข้อความนี้ได้", "ในฐานะ AI ฉันไม่สามารถดำเนินการกับเนื้อหานี้ได้", "ฉันต้องขอปฏิเสธการแปลข้อความนี้", "เสียใจด้วย ฉันไม่ได้รับอนุญาตให้แปลเอกสารนี้"],
}

#: Ordinary sentences with a word or two of a refusal.
HARMLESS = [
    "The old editor could not translate the letter without help from the captain.", "Nobody was able to open the door, so the request was sent again.", "“I can't help you with this text,” said the captain.", "The rules do not allow dogs in the garden.", "She was sorry that the translation of the book was late.",
    "老编辑没有办法打开这扇门。", "船长说：“对不起，我不能帮您翻译这封信。”", "工程师无法在暴风雨之前完成报告。", "船長は扉を開けることができなかった。", "「申し訳ありませんが、できません」と船長は言った。",
    "선장은 문을 열 수 없었다.", "Le capitaine ne pouvait pas traduire la lettre sans dictionnaire.", "Der Kapitän konnte den Brief nicht übersetzen, denn er war müde.", "El capitán no pudo traducir la carta antes de la tormenta.", "Il capitano non poteva aprire la porta del giardino.",
    "O capitão não conseguiu abrir a porta.", "Капитан не мог перевести письмо без словаря.", "لم يستطع القبطان فتح الباب قبل العاصفة.", "กัปตันเปิดประตูไม่ได้ก่อนพายุ", "He declined the invitation and went home without a word.",
]
