"""Broken prompt and response pairs (problem 2).

Ordered rules over whole texts: emptiness, unclosed delimiters and abrupt endings, refusal phrases in several languages,
copied questions, and script or language mismatch. Every rule that triggers emits its defect; `first_defect` keeps the first
by the order of DEFECTS. An answer that begins with its question and goes on is named by `pair_defects`, but is no defect to
`first_defect`: what follows may be a proper answer.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFECTS = ("empty", "truncated", "refusal", "copies_question", "other_language")
BEGINS = "begins_with_question"

# Frequent function words that tell languages in Latin letters apart.
FUNCTION_WORDS = {
    "en": "the of and to is was in that for with which what who how many where did this it its are be by on at as from since when while has have not an can after before between there their",
    "de": "der die das und ist ein eine einen dem den des nicht mit von zu im für auf wird wurde welche welcher welches wer wie viele wo wann hatte als auch nur bei aus nach vor zwischen seit durch weil zwar daher noch wieder ich wenn",
    "fr": "de le la les des du et est un une dans que qui pour pas sur avec quel quelle quels quelles combien où au aux ce cette ces il elle ne en par plus sont était ont depuis entre mais donc je lui son sa ses car puis comme avait alors peux",
    "es": "de el la los las del y es un una en que qué quién cuántos cuántas cuál dónde por para con no se su sus lo al como más pero son fue entre desde este esta esto hay ya pues sin sobre era donde porque luego fue tuvo queda solo",
    "pt": "de o os as do da dos das e é um uma em no na nos nas que quem quantos quantas qual onde por para com não se seu sua ao à como mais mas são foi entre desde este esta isto há já pois sem sobre era porque depois também ele ela pelo pela",
    "it": "di il lo la gli le del della dei delle dello degli e è un una uno in nel nella che chi quanti quante quale dove per con non si suo sua al alla come più ma sono fu tra fra da dal dalla questo questa anche perché poi era stato stata",
    "nl": "de het een en is was van in dat voor met die wat wie hoe veel waar niet op aan als uit bij naar tussen sinds door omdat ook nog maar wordt werd zijn hun deze dit er ik welke wanneer",
    "sv": "och är var en ett den det de som för med till på av inte har hade hur många när från mellan sedan eller men också om att vad vem vilken vilka sin sitt jag",
    "pl": "w na z jest był była nie się że od za o jak co kto ile gdzie kiedy który która które przez po między ale oraz dla czy są tego tej ten ta jego jej",
    "tr": "ve bir bu da de için ile ne kim kaç nerede hangi olarak olan daha çok gibi sonra önce arasında ama değil var yok mi mı o şu kadar tarafından",
}
# Ways in which a speaker declines to answer, by language. They are looked for in the final answer only.
_I = r"\b(?:I|we)\s+(?:(?:must|have|to|will|would|shall|should|do|am|are|need|respectfully|politely|therefore|simply|really|still|just|also|forced|going|sorry|afraid|but)\s+){0,4}"
_NOT = r"(?:cannot|can not|can['’]?t|could not|couldn['’]?t|(?:am |are |['’]m |['’]re )?(?:unable|not able|not allowed|not permitted|not in a position) to|won['’]?t|will not|do not wish to|don['’]?t wish to)"
_SAY = r"(?:answer|help|respond|reply|assist|provide|share|comment|discuss|disclose|comply|say|tell|give|name|reveal|fulfil|fulfill)"
REFUSALS = {
    "en": [
        rf"(?:^|\b(?:I|we|I['’]m|we['’]re|am|are)\b[^.!?]{{0,60}}?){_NOT}\s+(?:\w+\s+){{0,2}}?{_SAY}\b",
        rf"{_I}(?:decline|refuse)\b|^(?:declin|refus)ing\b|\b(?:must|have to)\s+(?:decline|refuse)\b",
        r"\b(?:I|we)(?:['’]d|\s+would)\s+(?:rather|prefer)\s+(?:to\s+)?not\b|\bI\s+prefer not to\b",
        r"\b(?:nothing|not something|not anything|no(?:t)? a thing)\s+(?:that\s+)?I\s+(?:can|could|may|am able to)\b",
        r"\bagainst my\s+(?:\w+\s+)?(?:guidelines|rules|policy|policies|instructions|principles)\b|\bnot be appropriate\b|\binappropriate to\b",
        r"\bmy\s+(?:\w+\s+)?(?:rules|instructions|guidelines|policies|policy|settings)\s+(?:forbid|prohibit|prevent|stop|bar|keep|do not allow|don['’]t allow|do not let|don['’]t let)\b",
        r"\bI\s+(?:lack|have no|do not have|don['’]?t have)\s+(?:the\s+|any\s+)?(?:access|knowledge|information|permission)\b",
        r"\bno answer can be given\b|\bI must ask you to\b|\b(?:outside|beyond) (?:of )?(?:my|what I)\b",
        r"\bI(?:\s+am|['’]m)?\s+(?:really\s+|honestly\s+|simply\s+)?(?:do not|don['’]?t|not sure I)\s+know\b(?:\s+(?:the answer|that|this|who|what|when|where|how|which)\b|\W*$)",
        r"\b(?:I|we)(?:\s+am|\s+are|['’]m|['’]re|\s+do)?\s*(?:not|n['’]t)\s+(?:feel\s+|really\s+)?comfortable\b",
        r"\bas an?\s+(?:AI|artificial intelligence|(?:large\s+)?language model|(?:virtual\s+|digital\s+)?assistant)\b[^.!?]*(?:\b(?:not|cannot|unable|lack|no)\b|n['’]t\b)",
    ],
    "de": [
        r"(?:\b(?:kann|darf|möchte|will|werde|könnte|soll) ich|\bich (?:kann|darf|möchte|will|werde|könnte|soll)|\bkann (?:man|hier)?)\b[^.!?]{0,60}\b(?:nicht|nichts|keinerlei|keine?n?)\b[^.!?]{0,40}\b(?:klären|beantworten|helfen|weiterhelfen|antworten|sagen|weitergeben|geben|nennen|mitteilen|dienen|äußern|machen|liefern|preisgeben)\b",
        r"\bich\b[^.!?]{0,40}\b(?:keine|nicht zur)\s+(?:auskunft|antwort|angaben?)\b|\bich\s+(?:muss\s+)?(?:\w+\s+)?(?:verweigere|lehne|ablehnen|weigere mich)\b",
        r"\btut (?:mir|uns) (?:sehr )?leid\b[^.!?]*\b(?:nicht|keine?n?)\b|\b(?:geht|ist) (?:mir )?leider nicht\b|\bist mir (?:leider )?nicht (?:möglich|erlaubt|gestattet)\b|\bich weiß (?:es |das )?(?:leider )?nicht\b",
    ],
    "fr": [
        r"\b(?:je|nous)\s+ne\s+(?:peux|puis|pouvons|souhaite|veux|dois|saurais)\s+(?:pas|rien)?\s*(?:vous\s+|y\s+)?(?:répondre|aider|dire|donner|fournir|commenter|communiquer|partager)\b",
        r"\bje\s+(?:préfère|préférerais)\s+ne\s+(?:rien|pas)\b|\bje\s+(?:me\s+)?refuse\b|\bje\s+(?:dois|regrette de devoir)\s+(?:refuser|décliner)\b|\bje\s+décline\b",
        r"\bje ne suis pas (?:en mesure|autorisée?|capable)\b|\bil m['’]est impossible\b|\bje (?:ne )?sais pas\W*$",
    ],
    "es": [
        r"\bno\s+(?:puedo|podemos|debo|quiero|me es posible|estoy autorizad[oa] a|soy capaz de)\s+(?:\w+\s+)?(?:responder|ayudar|ayudarte|ayudarle|opinar|contestar|decir|dar|compartir|comentar|hablar|proporcionar)\b",
        r"\bprefiero\s+no\b|\bme\s+niego\b|\b(?:debo|tengo que)\s+(?:negarme|rechazar|declinar)\b|\bno (?:lo )?sé\W*$",
    ],
    "pt": [
        r"\bnão\s+(?:posso|podemos|consigo|devo|quero|me é possível|estou autorizad[oa] a|sou capaz de)\s+(?:\w+\s+)?(?:responder|ajudar|ajudá-l[oa]|opinar|dizer|dar|fornecer|informar|comentar|partilhar|compartilhar|falar)\b",
        r"\bprefiro\s+não\b|\brecuso[- ]me\b|\bme\s+recuso\b|\b(?:devo|tenho de|tenho que)\s+recusar\b|\b(?:desculpe|lamento|sinto muito)\b[^.!?]*\bnão\s+(?:posso|consigo|sei)\b|\bnão (?:o )?sei\W*$",
    ],
    "it": [
        r"\bnon\s+(?:posso|possiamo|devo|voglio|riesco a|mi è possibile|sono in grado di|sono autorizzat[oa] a)\s+(?:\w+\s+)?(?:rispondere|risponderti|aiutare|aiutarti|aiutarla|dire|dare|fornire|commentare|condividere|parlare)\b",
        r"\bpreferisco\s+non\b|\bmi\s+rifiuto\b|\b(?:devo|sono costrett[oa] a)\s+(?:rifiutare|declinare)\b|\bmi\s+(?:di)?spiace\b[^.!?]*\bnon\s+(?:posso|so|riesco)\b|\bnon (?:lo )?so\W*$",
    ],
    "nl": [
        r"(?:\b(?:kan|mag|wil|zal) ik|\bik (?:kan|mag|wil|zal))\b[^.!?]{0,50}\b(?:niet|niets|geen)\b[^.!?]{0,30}\b(?:beantwoorden|antwoorden|helpen|zeggen|geven|delen|verstrekken)\b",
        r"\bik\s+(?:weiger|moet (?:\w+\s+)?weigeren|weet het niet)\b|\bhet spijt me\b[^.!?]*\b(?:niet|geen)\b",
    ],
    "sv": [r"\b(?:jag\s+(?:kan|får|vill)|(?:kan|får|vill)\s+jag)\b[^.!?]{0,40}\binte\b[^.!?]{0,30}\b(?:svara|hjälpa|säga|ge|besvara|dela)\b|\bjag\s+(?:vägrar|avböjer|vet inte)\b"],
    "pl": [r"\bnie\s+(?:mogę|możemy|potrafię|chcę|wolno mi|jestem w stanie)\s+(?:\w+\s+){0,2}?(?:odpowiedzieć|odpowiadać|pomóc|udzielić|podać|powiedzieć|udostępnić)\b|\b(?:odmawiam|muszę odmówić|wolę nie|nie wiem)\b|\bprzykro mi\b[^.!?]*\bnie\b"],
    "tr": [r"\b(?:yanıt|cevap|bilgi|yardım)\s+(?:veremem|veremiyorum|edemem|edemiyorum)\b|\b(?:yardımcı olamam|yardımcı olamıyorum|cevaplayamam|yanıtlayamam|söyleyemem|bilmiyorum|reddediyorum)\b"],
    "ru": [
        r"\bне\s+(?:могу|можем|смогу|сможем|буду|хочу|вправе|имею права|уполномочена?|в состоянии)\s+(?:\w+\s+){0,4}?(?:ответить|отвечать|помочь|сказать|сообщить|обсуждать|предоставить|дать|комментировать|раскрыть|раскрывать)\b",
        r"\b(?:я\s+)?отказываюсь\b|\bвынужден[аы]?\s+отказать|\bя\s+(?:этого\s+)?не\s+знаю\b|\b(?:простите|извините|к сожалению)\b[^.!?]*\bне\s+(?:могу|знаю|смогу)\b",
    ],
    "ar": [r"لا\s+(?:أستطيع|يمكنني|يمكننا|أعرف|أعلم)|لست\s+قادر|أرفض|أعتذر\s+عن"],
    "hi": [r"(?:जवाब|उत्तर|मदद|जानकारी)\s+नहीं\s+(?:दे|कर)\s+सकत|मुझे\s+नहीं\s+पता"],
    "ja": [r"(?:お答え|回答|返答|お手伝い|提供|お話し|対応|お伝え)(?:する(?:こと)?)?(?:は|を|に|が)?(?:でき(?:ません|ない|かね)|いたしかね|しかね|いたしません|控え|差し控え)|申し訳(?:あり|ござい)ません|(?:わか|分か)りません|お断り"],
    "ko": [r"(?:답변|대답|도움|제공|말씀)(?:을|은|이|해)?\s*(?:드릴|줄|할|될)\s*수\s*없|도와\s*드릴\s*수\s*없|죄송(?:합니다|하지만)|모르겠(?:습니다|어요)|거절(?:합니다|하겠)"],
    "zh": [r"[无無]法(?:回答|提供|[协協]助|[帮幫]助|告知|答[复覆])|不能(?:回答|提供|透露|[帮幫]助)|不便(?:回答|透露)|拒[绝絕]回答|抱歉|[对對]不起|我不(?:知道|清楚)"],
}
_REFUSAL = re.compile("|".join(f"(?:{p})" for ps in REFUSALS.values() for p in ps), re.IGNORECASE)
# What follows a refusal without refusing by itself.
_ADVICE = re.compile(r"^(?:please\s+(?:ask|consult|try|rephrase|contact|see)|bitte\b.{0,30}\b(?:nachfragen|fragen|wenden)|merci de\b|por favor\b|consulte\b)", re.IGNORECASE)

_SPECIAL = re.compile(r"<\|[^|<>]{1,40}\|>(?:[ \t]*(?:assistant|user|system)\b)?")
_TAG = re.compile(r"<\s*(/?)\s*(think|action|information|answer)\s*>", re.IGNORECASE)
_ANSWER = re.compile(r"<\s*answer\s*>(.*?)<\s*/\s*answer\s*>", re.IGNORECASE | re.DOTALL)
_UNREAD = re.compile(r"<\s*(action|information|answer)\s*>.*?(?:<\s*/\s*\1\s*>|$)", re.IGNORECASE | re.DOTALL)
_WORD = re.compile(r"[^\W_]+")
_NAME = re.compile(r"\S*[._]\S*[._]\S*|\b[mg]\.\w+")
_SENTENCE = re.compile(r"(?<=[.!?。！？…])[\"'”’)\]]*\s+|(?<=[。！？])|\n+")
_ENDED = re.compile(r"[.!?。！？…][\"'”’»)\]}*_`\s]*$")
_QUESTION = re.compile(r"question\s*:", re.IGNORECASE)
_LANGUAGES_OF: dict[str, list[str]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words.split():
        _LANGUAGES_OF.setdefault(_w, []).append(_lang)


def question_of(prompt: str) -> str:
    """What the prompt asks: the text after its last "Question:", or else its last line that isn't blank."""
    text = _SPECIAL.sub("\n", prompt).strip()
    last = None
    for last in _QUESTION.finditer(text):
        pass
    if last:
        return text[last.end() :].strip()
    return text.rsplit("\n", 1)[-1].strip()


def _script(text: str) -> str | None:
    """The script other than Latin that a fifth or more of text's letters have; names in it may stay Latin."""
    foreign = [c for c in text if ord(c) > 0x36F and c.isalpha()]
    if len(foreign) < 4 or len(foreign) * 5 < sum(c.isalpha() for c in text):
        return None
    code = ord(foreign[len(foreign) // 2])
    for name, low, high in (("el", 0x370, 0x3FF), ("ru", 0x400, 0x52F), ("he", 0x590, 0x5FF), ("ar", 0x600, 0x6FF), ("hi", 0x900, 0x97F), ("th", 0xE00, 0xE7F), ("ko", 0xAC00, 0xD7AF)):
        if low <= code <= high:
            return name
    return "ja" if any(0x3040 <= ord(c) <= 0x30FF for c in foreign) else "zh"


def tongues(text: str) -> Counter:
    """How many words of text are function words of each language; one entry only where text is in another script."""
    if script := _script(text):
        return Counter({script: 100})
    counts: Counter = Counter()
    for w, n in Counter(_WORD.findall(text.lower())).items():
        for lang in _LANGUAGES_OF.get(w, ()):
            counts[lang] += n
    return counts


def differs(asked: Counter, told: Counter) -> bool:
    """Whether told is clearly in one language, 3 function words at least and half as many again as any other's, in which asked,
    with 2 of another at least, is not."""
    (lang, most), *rest = told.most_common(2) or [("", 0)]
    if most < 3 or (rest and most < 1.5 * rest[0][1]):
        return False
    best = max(asked.values(), default=0)
    return best >= 2 and asked[lang] < best


_DELIMITERS = re.compile(r"```|[()\[\]{}\"“”„«»]")
_CLOSES = {")": "(", "]": "[", "}": "{"}


def unclosed(text: str) -> bool:
    """Whether a bracket, double quotation mark or code fence of text is open at its end. Single quotation marks are apostrophes
    too, and closing brackets without an opening one are items of lists; neither counts."""
    depth: Counter = Counter()
    fence = False
    for mark in _DELIMITERS.findall(text):
        if mark == "```":
            fence = not fence
        elif fence:
            continue
        elif mark in "([{":
            depth[mark] += 1
        elif mark in _CLOSES:
            depth[_CLOSES[mark]] -= depth[_CLOSES[mark]] > 0
        else:
            kind = {"“": "“”", "”": "“”", "„": "“”", "«": "«»", "»": "«»"}.get(mark, mark)
            depth[kind] ^= 1
    return fence or any(depth.values())


def final_answer(output: str) -> tuple[str, bool, bool]:
    """(final answer, whether it breaks off, whether its end is marked) of an output without special tokens."""
    tags = [(m.group(1) == "/", m.group(2).lower(), m.start(), m.end()) for m in _TAG.finditer(output)]
    if not tags:
        parts = [p for p in (x.strip() for x in _SENTENCE.split(output)) if p]
        return " ".join(parts[-2:]), not _ENDED.search(output), False
    answers = _ANSWER.findall(output)
    closing, name, start, end = tags[-1]
    after = output[end:].strip()
    if closing and name == "answer" and answers:
        return answers[-1], False, True
    if closing and name == "think" and after and _ENDED.search(after) and not answers:
        return after, False, False
    if answers and closing and not after:  # an action or a thought after the answer
        return answers[-1], False, True
    return after, True, False


def defects(prompt: str | None, output: str | None) -> list[str]:
    """Every defect of the pair, in the order of DEFECTS, and last whether the answer begins with the question; none if prompt is
    null or blank."""
    if prompt is None or not prompt.strip():
        return []
    text = _SPECIAL.sub("", output or "").strip()
    if not _WORD.search(_TAG.sub("", text)):
        return ["empty"]
    found = []
    answer, breaks_off, marked = final_answer(text)
    question = question_of(prompt)
    asked_words, answer_words = _WORD.findall(question.lower()), _WORD.findall(answer.lower())
    copied = _copies(answer_words, asked_words) or (not marked and _copies(_WORD.findall(text.lower()), asked_words))
    if marked and not answer_words:
        found.append("empty")
    if (breaks_off or unclosed(answer if marked or _TAG.search(text) else text)) and not copied:
        found.append("truncated")
    if answer_words and _declines(answer, marked):
        found.append("refusal")
    if copied:
        found.append("copies_question")
    prose = _TAG.sub(" ", _UNREAD.sub(" ", text))
    prose = _NAME.sub(" ", prose.replace(question, " ") if question else prose)
    if differs(tongues(question), tongues(prose)):
        found.append("other_language")
    opening = answer_words if marked else _WORD.findall(_TAG.sub(" ", text).lower())
    if not copied and len(asked_words) >= 4 and opening[: len(asked_words)] == asked_words:
        found.append(BEGINS)
    return found


def _copies(answer: list[str], asked: list[str]) -> bool:
    """Whether the answer, up to twice as long as the question, has 0.85 of its different words from the question and holds 0.75
    of the question's."""
    if answer[:1] == ["question"]:
        answer = answer[1:]
    if len(answer) < 4 or not asked:
        return False
    a, q = set(answer), set(asked)
    return len(answer) <= 2 * len(asked) and len(a & q) >= 0.85 * len(a) and len(a & q) >= 0.75 * len(q)


def _declines(answer: str, marked: bool) -> bool:
    if marked:
        return bool(_REFUSAL.search(answer))
    sentences = [p for p in (x.strip() for x in _SENTENCE.split(answer)) if p]
    while len(sentences) > 1 and _ADVICE.match(sentences[-1]):
        sentences.pop()
    return bool(sentences and _REFUSAL.search(sentences[-1]))


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [defects(p, o) for p, o in zip(batch.column("_p").to_pylist(), batch.column("_o").to_pylist())]
        keep = [i for i, f in enumerate(found) if f]
        yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(keep, pa.int64())), pa.array([found[i] for i in keep], pa.list_(pa.string()))], names=["_id", "defects"])


def pair_defects(entries: DataFrame, row_id: str = "entry_id", prompt: str = "input", output: str = "output") -> DataFrame:
    """(row_id, defects): each row of entries with at least one defect and all its defects, in the order of DEFECTS, and last
    "begins_with_question" where the answer begins with the whole question and goes on.

    Pairs with a null or blank prompt have none; a null or blank output is empty. Repeated rows are flagged each; other
    columns, whatever their names, are not read. Nothing is shuffled.
    """
    kind = entries.schema[row_id].dataType.simpleString()
    slim = entries.select(F.col(row_id).alias("_id"), F.col(prompt).alias("_p"), F.col(output).alias("_o"))
    return slim.mapInArrow(_flag, f"_id {kind}, defects array<string>").select(F.col("_id").alias(row_id), "defects")


def first_defect(entries: DataFrame) -> DataFrame:
    """(entry_id, defect), one row per defective entry."""
    return pair_defects(entries).select("entry_id", F.element_at("defects", 1).alias("defect")).where(F.col("defect") != BEGINS)
