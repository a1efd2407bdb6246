"""Defects of question and answer pairs in message rows.

A pair is a turn that has, repeats aside, exactly one user message with visible content and exactly
one assistant message.  Rules, in order:

``empty``           nothing visible, only marks, or a filler that stands for no answer
``refusal``         a sentence declines, and no other sentence names anything
``copy``            copied prefixes of the question make up nearly all of the answer, or nearly all
                    neighbouring words of the answer are neighbours in the question (restyled copies)
``other_language``  both languages are clear from their function words or scripts, and differ;
                    names, titles and quotations are taken out first
``truncated``       an open quotation or bracket, or an end without a mark of the sentence whose
                    last word or frame does not end answers elsewhere (see ``p4_truncation``)

``defects`` gives every rule that holds, ``first_defects`` the first.  Pairs are built by one
aggregation over (session, turn); statistics of endings are counted over all answers and combined
per batch before they are shuffled.

Edge cases: null content is an empty answer; a null session or turn is a group like any other; a
pair with an undecided language has no other_language; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, role_of
from .p4_truncation import FRAME_SHARE, FRAME_WORDS, LEAST_SEEN, WORD_SHARE, prefix_hashes

ORDER = ("empty", "refusal", "copy", "other_language", "truncated")

#: Fillers that stand for no answer, as plain words (fixed values).
FILLERS = frozenset(
    ["unknown message", "empty", "br", "null", "none", "nan", "nil", "n a", "na", "no response", "no answer", "no content", "no reply", "undefined", "error", "tbd", "blank", "missing", "not available", "no message", "placeholder"]
)
#: Phrases that decline (fixed values).
_DECLINE_VERBS = "answer|help|assist|discuss|comment|talk|speak|continue|name|choose|pick|suggest|offer|recommend|fulfil|fulfill|do|provide|share|go into|respond"
_DECLINE_STARTS = (
    "can't|can not|cannot|won't|will not|am not able to|'m not able to|am unable to|'m unable to|am not allowed to|'m not allowed to|would rather not|'d rather not|"
    "must pass and not|have to pass and not|have to decline to|must decline to|need to decline to|decline to|isn't possible for me to|is not possible for me to|"
    "not something i do to|do not let me|don't let me|do not allow me to|have to leave it there and not|prefer not to|refuse to"
)
REFUSALS = re.compile(
    rf"(?:{_DECLINE_STARTS})\s+(?:{_DECLINE_VERBS})\b|request (?:is )?declined|no can do|no recommendation from me|\bout on this request|^(?:sorry,? )?can't do it\b|no song will follow"
    r"|tut mir leid, dabei kann ich nicht|kann ich (?:leider )?nicht (?:helfen|beantworten)|möchte ich (?:lieber )?nicht (?:antworten|beantworten)|darf (?:ich )?hier leider keine|(?:kann|darf) (?:ich )?(?:hier |leider )*keine? \w+ (?:empfehlen|nennen)"
    r"|regeln erlauben (?:es )?(?:mir )?nicht|nenne ich kein"
    r"|je ne peux pas (?:répondre|aider|recommander|conseiller)|je préfère ne pas|m'est impossible de|règles m'interdisent|ne donnerai (?:donc )?aucun"
    r"|no puedo (?:ayudarte|responder|recomendar)|prefiero no|no me es posible|normas no me permiten|no daré ninguna"
    r"|お答えできません|おすすめすることはできません|お手伝いできません|できかねます|お断り|ご紹介できません|控えさせて|規則|ルール上"
    r"|não (?:posso|consigo) (?:ajudar|responder|recomendar)|não me é possível|prefiro não|recuso"
    r"|non (?:posso|riesco a) (?:aiutar|risponder|consigliar|raccomandar)|preferisco non|mi rifiuto"
    r"|kan (?:ik )?(?:je |u )?(?:hier(?:bij|mee) )?(?:helaas )?niet (?:helpen|beantwoorden|mee helpen)|kan geen \w+ aanbevelen|liever niet beantwoorden"
    r"|не могу (?:помочь|ответить|рекомендовать|посоветовать)|вынужден[аы]? отказать|отказываюсь|предпочитаю не"
    r"|nie mogę (?:pomóc|odpowiedzieć|polecić)|muszę odmówić|kan (?:tyvärr |desværre |dessverre )?(?:jag |jeg )?(?:tyvärr |desværre |dessverre )?(?:inte|ikke) (?:hjälpa|svara|hjelpe|hjælpe|svare)"
    r"|yardımcı olamam|yanıt veremem|öneremem|无法(?:回答|帮助|提供|推荐)|不能(?:回答|帮助|推荐)|無法(?:回答|幫助|推薦)|抱歉，我不能|답변(?:할|드릴) 수 없|도와드릴 수 없|추천(?:할|해 드릴) 수 없"
    r"|لا (?:أستطيع|يمكنني) (?:المساعدة|مساعدتك|الإجابة|التوصية)|אינני יכול|איני יכול|मदद नहीं कर सकत|उत्तर नहीं दे सकत|ไม่สามารถ(?:ตอบ|ช่วย|แนะนำ)",
    re.IGNORECASE,
)
#: Function words by language (fixed values).
LANGUAGE_WORDS = {
    "en": "the a an and or but of to in on at for from with by is are was were be been it its this that these those you your i my me we our they he she not no yes so as if than then there here what which who how when where would could should can will do does did have has had just some any more most very too like want need try let something please up out about into over after before one another next keep love without maybe again slower older loud skip going enjoy made while because same sounds feels make give find looking",
    "de": "der die das den dem des ein eine einen einem einer und oder aber von zu im in an auf für aus mit bei ist sind war waren sein es dies diese dieser du dein dir ich mein mir mich wir uns sie er nicht kein keine ja nein so als wenn dann hier was welche wer wie wann wo würde könnte soll kann wird habe hat hatte nur etwas mehr sehr zu gern bitte über nach vor noch ohne vielleicht nochmal besser eins toll klar gut passt während denn weil dort zum zur am vom doch auch gib versuch vorschlag finde suche ich stück lied höre langsamer älter",
    "fr": "le la les un une des du de et ou mais à au aux en dans sur pour par avec sans est sont était être il elle ce cette ces tu ton ta tes toi je mon ma mes moi nous notre vous votre ils ne pas non oui si comme que qui quoi quel quelle où quand comment plus très trop bien peut veux voudrais fait fais ai as a avons y quelque chose encore peut-être plutôt autre suivante c'est j'ai j'adore d'un d'une l'ambiance parce pendant où car merci sinon essaie suggestion lent ancien morceau chanson cherche donne connais rien",
    "es": "el la los las un una unos unas de del y o pero a al en con sin por para es son era ser lo le se su sus tu tus te ti yo mi mis me nos nosotros vosotros ellos no sí si como que qué quién cuál dónde cuándo cómo más muy demasiado bien puede quiero quisiera hay algo otra otro esta este estos ese esa porque mientras donde nunca ya aquí tan mejor quizá siguiente gracias todo prueba elegí propuesta canción busco dame sigue suena tono también desde hasta nada lento antiguo así",
    "it": "il lo la i gli le un uno una di del della e o ma che chi non più con per da nel nella sono è sei mi ti si ci questo questa quello come dove quando perché anche molto poco ancora senza qualcosa vorrei",
    "pt": "o a os as um uma de do da dos das e ou mas que não mais com por para em no na são é eu tu você me te se isso esta este como onde quando porque também muito sem algo quero",
    "nl": "de het een en of maar van in op aan voor met bij is zijn was ik je jij mijn we wij ze niet geen ja nee zo als dan hier wat wie hoe waar kan zal heb heeft iets meer zonder",
}
_OF_WORD: dict[str, tuple] = {}
for _language, _words in LANGUAGE_WORDS.items():
    for _word in _words.split():
        _OF_WORD[_word] = (*_OF_WORD.get(_word, ()), _language)
_VOTES = {w: tuple((name, 1 / len(names)) for name in names) for w, names in _OF_WORD.items()}
#: Scripts that tell a language by themselves, as regular expressions (fixed values).
SCRIPTS = (("ja", re.compile("[぀-ヿ]")), ("ko", re.compile("[가-힯]")), ("zh", re.compile("[一-鿿]")), ("ru", re.compile("[Ѐ-ӿ]")), ("ar", re.compile("[؀-ۿ]")), ("hi", re.compile("[ऀ-ॿ]")), ("th", re.compile("[฀-๿]")), ("el", re.compile("[Ͱ-Ͽ]")), ("he", re.compile("[֐-׿]")))
#: Titles that end with a full stop, and so do not end a sentence (fixed values).
ABBREVIATIONS = frozenset("dr st mr mrs ms prof no feat ft vs jr sr vol".split())
#: Share of the answer's neighbouring words that a copy has from the question.
COPY_SHARE = 0.8
#: A word that is so many times more often the beginning of another is taken for a beginning.
PART_TIMES = 20

#: Pieces of which every refusal has one, to look at few answers closely (fixed values).
_REFUSAL_SIGNS = ("n't", "n’t", " not ", "cannot", "unable", "declin", "recommendation from", "no can do", "out on this", "leave it there", "refuse", "no song", "nicht", "kein", "ne peux", "préfère", "impossible", "interdis", "aucun", "no puedo", "prefiero", "posible", "permiten", "ninguna", "できません", "お断り", "かねます", "控え", "規則", "ルール",
    "não", "prefiro", "recuso", "non ", "preferisco", "rifiuto", "niet", "geen", "не могу", "отказ", "предпочитаю", "nie mog", "odmówić", "inte", "ikke", "amam", "emem", "无法", "不能", "無法", "수 없", "لا ", "אינני", "איני", "नहीं", "ไม่สามารถ")
_UNSPACED = re.compile("[぀-ヿ一-鿿฀-๿]")
_OTHER_SCRIPT = re.compile("[Ͱ-῿぀-鿿가-힯]")
_NAME_LINKS = frozenset("of in the or and until vs vs. before x feat. me no".split())
_AROUND = ".,;:!?…\"'“”«»()[]<>-–—¡¿。、！？"
_STOPS = frozenset(".!?。！？।؟")
_WORD = re.compile("[぀-ヿ一-鿿฀-๿]|\\w+(?:['’]\\w+)*")
_ENDING_WORD = re.compile("[぀-ヿ一-鿿฀-๿]|\\w+(?:['’]\\w+)*|[—–]")
_UNIT = re.compile(r"(?<=[.!?…])\s+(?![a-zà-ÿ—–&])|(?<=[。！？])|[\r\n]+")
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|「[^」]*」|『[^』]*』")
_NAME = re.compile(r"(?<=[^\s.!?…:»”\"])\s+(?:(?:Dr|St|DJ|The|Mr|Mrs)\.?\s+)?[A-ZÀ-ÖØ-Þ][\w'’]*(?:[\s,&]+(?:of|in|the|or|and|until|vs\.?|before|No\.?|x|feat\.?|[A-ZÀ-ÖØ-Þ0-9][\w'’.]*))*")
#: So many letters and digits, whatever lies between them, are no filler.
_LETTERS = re.compile(r"(?:[^\W_][\W_]*){24}")
_TAIL = re.compile(r"(?:[\s\U0001F000-\U0001FAFF☀-➿️‍]+|[:;]-?[)(DP]|\((?:really|lol|haha)\))+$")
_TERMINAL = re.compile(r"[.!?。！？।؟]['\"”’»)\]]*$")
_DOTS = re.compile(r"(?:…|\.{2,})['\"”’»)\]]*$")


def _plain(text: str) -> list[str]:
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf")
    return _WORD.findall(text.lower())


def _visible(text: str) -> bool:
    return any(unicodedata.category(c)[0] in "LNSP" or unicodedata.category(c) == "Mc" for c in text)


def is_empty_answer(text: str | None) -> bool:
    if text is None:
        return True
    if _LETTERS.search(text):  # most answers: a run of letters longer than any filler
        return False
    words = _plain(text)
    if not words:
        return not any(unicodedata.category(c) == "So" for c in text)
    return " ".join(words) in FILLERS


def is_refusal(text: str) -> bool:
    low = text.lower()
    if not any(sign in low for sign in _REFUSAL_SIGNS):
        return False
    text = text.replace("’", "'")
    if not REFUSALS.search(text):
        return False
    for sentence in _UNIT.split(text):
        s = sentence.strip()
        if s and not REFUSALS.search(s) and (_NAME.search(s) or _QUOTED.search(s)):
            return False
    return True


def _copied_prefix(q: list[str], a: list[str]) -> int:
    """Words of the answer that are covered by its copies of a prefix of the question, of half of it at least."""
    least, covered, at = max(2, (len(q) + 1) // 2), 0, 0
    while at <= len(a) - least:
        k = 0
        while k < len(q) and at + k < len(a) and a[at + k] == q[k]:
            k += 1
        covered, at = (covered + k, at + k) if k >= least else (covered, at + 1)
    return covered


def is_copy(question: str, answer: str) -> bool:
    q, a = _plain(question), _plain(answer)
    if len(a) < 2 or len(q) < 2:
        return bool(a) and a == q
    if len(a) < 0.5 * len(q):
        return False
    if _copied_prefix(q, a) >= COPY_SHARE * len(a):
        return True
    known = set(zip(q, q[1:], strict=False))
    hits = sum(p in known for p in zip(a, a[1:], strict=False))
    return hits >= COPY_SHARE * (len(a) - 1)


def language(text: str) -> str | None:
    if any(c in text for c in "\"“«「『"):
        text = _QUOTED.sub(" ", text)
    if not text.isascii() and _OTHER_SCRIPT.search(text):
        letters = sum(c.isalpha() for c in text) or 1
        for name, script in SCRIPTS:
            n = len(script.findall(text))
            if n and (n >= 0.2 * letters or n >= 8):
                return name
    votes: dict[str, float] = {}
    tokens = text.split()
    last, before = len(tokens) - 1, "."
    for i, token in enumerate(tokens):
        if before[-1] in ".!?…:":
            token = token.strip(_AROUND).lower()  # an opening word counts in spite of its capital; other capitals are names
        got = _VOTES.get(token)
        # Small words between two capitals belong to a name.
        if got and not (token in _NAME_LINKS and 0 < i < last and before[0].isupper() and tokens[i + 1][0].isupper()):
            for name, weight in got:
                votes[name] = votes.get(name, 0) + weight
        before = tokens[i]
    if not votes:
        return None
    ranked = sorted(votes.values(), reverse=True)
    if ranked[0] < 1 or (len(ranked) > 1 and ranked[0] < 1.5 * ranked[1]):
        return None
    return max(votes, key=votes.get)


def _units(text: str) -> list[list[str]]:
    out = [_ENDING_WORD.findall(u.lower()) for u in _UNIT.split(text)]
    return [u for u in out if u]


def ending(text: str) -> tuple[bool, list[str], bool]:
    """(the end is marked as one, words of the last unit, a quotation or bracket is open)."""
    text = text.rstrip()
    opened = text.count('"') % 2 == 1 or text.count("「") > text.count("」") or text.count("“") > text.count("”") or text.rfind("(") > text.rfind(")")
    if text[-1:] in _STOPS and not text.endswith("..") and not opened and text[-2:-1].islower() and text.rsplit(None, 1)[-1][:-1].lower() not in ABBREVIATIONS:
        return True, [], False
    text = _TAIL.sub("", text)
    units = _units(text)
    last = units[-1] if units else []
    marked = bool(_TERMINAL.search(text)) and not _DOTS.search(text) and not (text.endswith(".") and last and last[-1] in ABBREVIATIONS)
    return marked, last, opened


def pairs(messages: DataFrame) -> DataFrame:
    """``session_id, turn_number, question, answer`` of each pair."""
    rows = messages.select("session_id", "turn_number", role_of(F.col("role")).alias("speaker"), "content").where(F.col("speaker").isin("user", "assistant"))
    user = F.col("speaker") == "user"
    version = F.coalesce(F.xxhash64("content"), F.lit(0))
    version = F.when(F.col("content").isNull(), F.lit(1)).otherwise(version)
    grouped = rows.groupBy("session_id", "turn_number").agg(
        *(
            agg(F.when(side, version)).alias(f"{name}_{which}")
            for name, side in (("q", user), ("a", ~user))
            for agg, which in ((F.min, "lo"), (F.max, "hi"))
        ),
        F.max(F.when(user, F.col("content"))).alias("question"),
        F.max(F.when(~user, F.col("content"))).alias("answer"),
    )
    single = (F.col("q_lo") == F.col("q_hi")) & (F.col("a_lo") == F.col("a_hi"))
    return grouped.where(single & F.col("question").rlike(r"[\p{L}\p{N}\p{P}\p{S}]")).select("session_id", "turn_number", "question", "answer")


def _slots(words: list[str], frame: frozenset) -> list[str]:
    """Frequent words and kana as they are, numbers as #, and each run of other words (names, titles) as one slot."""
    out: list[str] = []
    for w in words:
        slot = w if w in frame or "぀" <= w <= "ヿ" else "#" if w[0].isdigit() else "*"
        if slot != "*" or not out or out[-1] != "*":
            out.append(slot)
    return out


def _count_ends(frames, shared):
    """Counts of words (``word``) and frames (``form``, a hash) as endings and as going on, of the answers of a batch."""
    for frame in frames:
        words: tuple[Counter, Counter] = (Counter(), Counter())
        forms: tuple[Counter, Counter] = (Counter(), Counter())
        units: Counter = Counter()
        for text in frame["answer"]:
            for u in _units(_TAIL.sub("", text)):
                words[1].update(u[:-1])
                words[0][u[-1]] += 1
                units[" ".join(_slots(u, shared.value))] += 1
        for unit, n in units.items():
            *begins, whole = prefix_hashes(unit.split(" "))
            forms[0][whole] += n
            for key in begins:
                forms[1][key] += n
        for name, (ends, goes) in (("word", words), ("form", forms)):
            keys = list(ends.keys() | goes.keys())
            if keys:
                yield pd.DataFrame({"word": keys if name == "word" else None, "form": pd.Series(keys if name == "form" else [None] * len(keys), dtype="Int64"), "ends": [ends[k] for k in keys], "goes": [goes[k] for k in keys]})


def _judge(frames, shared):
    for frame in frames:
        rows = []
        for session, turn, question, answer in frame[["session_id", "turn_number", "question", "answer"]].itertuples(index=False):
            found, marked, opened, word, form, telling = [], True, False, None, 0, False
            if is_empty_answer(answer):
                found.append("empty")
            else:
                if is_refusal(answer):
                    found.append("refusal")
                if is_copy(question, answer):
                    found.append("copy")
                q = language(question)
                a = language(answer) if q else None
                if q and a and q != a:
                    found.append("other_language")
                marked, last, opened = ending(answer)
                if (opened or not marked) and last:
                    slots = _slots(last, shared.value)
                    word, form, telling = last[-1], prefix_hashes(slots)[-1], any(w not in ("*", "#") for w in slots)
            rows.append((session, turn, found, marked, opened, word, form, telling))
        if rows:
            yield pd.DataFrame(rows, columns=["session_id", "turn_number", "found", "marked", "opened", "word", "form", "telling"])


def defects(messages: DataFrame) -> DataFrame:
    """``session_id, turn_number, defects``: every defect of each pair that has any, in rule order."""
    spark = messages.sparkSession
    kinds = dict(messages.dtypes)
    both = materialize(pairs(messages), "pairs")
    answers = both.where(F.col("answer").isNotNull()).select("answer")
    words = answers.select(F.explode(F.split(F.lower("answer"), r"(?U)[^\w'’]+")).alias("word")).where(F.col("word") != "")
    frequent = [r["word"] for r in words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(FRAME_WORDS).collect()]
    shared = spark.sparkContext.broadcast(frozenset([*frequent, "—", "–"]))
    counts = answers.mapInPandas(lambda it: _count_ends(it, shared), "word string, form bigint, ends bigint, goes bigint").groupBy("word", "form").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes"))
    counts = materialize(counts, "pairs-ends")
    judged = materialize(
        both.mapInPandas(lambda it: _judge(it, shared), f"session_id {kinds['session_id']}, turn_number {kinds['turn_number']}, found array<string>, marked boolean, opened boolean, word string, form bigint, telling boolean"),
        "pairs-judged",
    )
    of_words, of_forms = counts.where(F.col("word").isNotNull()), counts.where(F.col("form").isNotNull())
    known = of_words.select(F.col("word").alias("w"), (F.col("ends") + F.col("goes")).alias("n"))
    begins = (
        known.select(F.explode(F.sequence(F.lit(1), F.length("w"))).alias("k"), "w", "n")
        .groupBy(F.expr("substring(w, 1, k)").alias("word"))
        .agg(F.sum(F.when(F.col("k") == F.length("w"), F.col("n")).otherwise(0)).alias("known"), F.sum(F.when(F.col("k") < F.length("w"), F.col("n")).otherwise(0)).alias("longer"))
    )
    unsure = judged.where((F.col("opened") | ~F.col("marked")) & F.col("word").isNotNull()).select("session_id", "turn_number", "opened", "word", "form", "telling")
    looked = (
        unsure.join(of_words.select("word", F.col("ends").alias("word_ends"), F.col("goes").alias("word_goes")), "word", "left")
        .join(begins, "word", "left")
        .join(of_forms.select("form", F.col("ends").alias("form_ends"), F.col("goes").alias("form_goes")), "form", "left")
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    often_whole = (n("form_ends") >= 5) & (n("form_ends") >= n("form_goes")) & F.col("telling")
    part_of_word = (n("known") * PART_TIMES < n("longer")) & (n("longer") > 0)
    rarely_ends = (n("word_goes") >= LEAST_SEEN) & (n("word_ends") < WORD_SHARE * (n("word_ends") + n("word_goes")))
    goes_on = F.col("telling") & (n("form_goes") >= LEAST_SEEN) & (n("form_ends") < FRAME_SHARE * (n("form_ends") + n("form_goes")))
    cut = looked.withColumn("cut", F.col("opened") | part_of_word | (~often_whole & (rarely_ends | goes_on)))
    short = cut.select("session_id", "turn_number", "cut", "word", "form", "word_ends", "word_goes", "known", "longer", "form_ends", "form_goes")
    same = [F.col("j.session_id").eqNullSafe(F.col("c.session_id")), F.col("j.turn_number").eqNullSafe(F.col("c.turn_number"))]
    joined = judged.alias("j").join(short.where("cut").alias("c"), same, "left").select("j.session_id", "j.turn_number", F.when(F.col("c.cut"), F.array_append("j.found", "truncated")).otherwise(F.col("j.found")).alias("defects"))
    return joined.where(F.size("defects") > 0)


def first_defects(messages: DataFrame) -> DataFrame:
    """``session_id, turn_number, defect``: the first defect of each defective pair."""
    return defects(messages).select("session_id", "turn_number", F.col("defects")[0].alias("defect"))
