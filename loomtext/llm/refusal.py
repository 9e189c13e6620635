"""Refusals by composition: an automaton over phrases of a few classes, and one over the order of the classes.

A model that declines says that *it* (the first person, or the assistant by name) *cannot, may not or will not* do *the task*
(translate, answer, go on with this text ...), in any wording.  The phrases of each class are found together by one
multi-pattern automaton; a second automaton walks over the classes of a sentence and accepts the orders that make a
refusal.  Signs that are no refusal alone (an apology, being sent to someone else, an inability without a task) are one
only in company.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

import ahocorasick
import regex

#: Phrases of each class in the three languages.  Arabic script: written as stems, endings may follow.
SPEAKER = "i|i'm|i'd|i've|i'll|me|this assistant|the assistant|this model|the model|this system|an assistant|your assistant"
UNABLE_WE = "we cannot|we can't|we can not|we are unable|we're unable|we are not able|we're not able|we will not|we won't|we must decline|we have to decline|we regret that we cannot|this service cannot|this service can't|our service cannot"
#: What holds the speaker back, said of something else.
HELD_BACK = "stop me from|stops me from|keep me from|keeps me from|prevent me from|prevents me from|prohibit me from|prohibits me from|don't allow me|do not allow me|doesn't allow me|does not allow me|not let me|forbid me|forbids me|inappropriate for me|impossible for me|not appropriate for me|not possible for me|not right for me|not acceptable for me|by this assistant|by the assistant|by this model|by me"
MODEL = "language model|ai model|as an ai|as an assistant|as a model|artificial intelligence|machine translation system|مدل زبانی|هوش مصنوعی|دستیار هوشمند|دستیار مجازی|نموذجا لغويا|نموذج لغوي|نموذج ذكاء|ذكاء اصطناعي|ذكاء اصطناعيا|مساعدا آليا|مساعدا رقميا|مساعدا افتراضيا"
UNABLE = (
    "cannot|can't|can not|could not|couldn't|unable|not able|won't|will not|would not|wouldn't|rather not|prefer not|decline|declining|refuse|refusing|not allowed|not permitted|not authorised|not authorized|not comfortable|"
    "not in a position|not going to|not willing|not equipped|not qualified|incapable|not capable|have to pass|must pass|no way to|not possible for me|don't feel comfortable|do not feel comfortable|must not|may not|forbidden|prohibited|no longer able|have to stop|must stop|need to stop|not have permission|don't have permission|no permission|don't think i should|do not think i should|should not|shouldn't|no longer|not feel comfortable|don't feel able|off limits|off-limits|not have the ability|don't have the ability|lack the ability|not designed to|not meant to|not intended to|not programmed to"
)
#: Of the first person by their form.
UNABLE_SELF = (
    "نمی توانم|نمیتوانم|نمی تونم|نخواهم توانست|قادر نیستم|قادر نمی باشم|ناتوانم|اجازه ندارم|مجاز نیستم|معذورم|معذور هستم|خودداری می کنم|نمی خواهم|ترجیح می دهم|امتناع می کنم|صرف نظر می کنم|عذر می خواهم از|برنمی آیم|بر نمی آیم|توانایی ندارم|ناگزیرم رد|رد می کنم|نمی پذیرم|را رد کنم|مقدور نیست|برایم ممکن نیست|برای من ممکن نیست|نپذیرم|"
    "لا يمكنني|لا أستطيع|لا استطيع|لن أتمكن|لا أتمكن|لن أستطيع|لن يمكنني|لست قادرا|لست قادرة|غير قادر|لا أقدر|يتعذر علي|تعذر علي|ليس بإمكاني|ليس بوسعي|ليس في وسعي|لا يسعني|أعتذر عن|أرفض|لا يسمح لي|غير مسموح لي|لا يحق لي|لا أرغب|لن أواصل|لن أكمل|لن أقوم|لا أقوم|أفضل عدم|أفضل ألا|أمتنع عن|مضطر لرفض|مضطر إلى رفض|أعجز عن|لست مخولا|لست مؤهلا|عاجز عن|لن أترجم|لن أقدم"
)
#: Parts of what surrounds the task: ability before it, the negated verb of the first person behind it, or the other way round.
ABLE, NOT_SELF = "قادر|اجازه|توان|توانایی|امکان|مجاز|صلاحیت|حاضر", "نیستم|ندارم|نمی باشم|نمی شوم"
NOT_THERE = "وجود ندارد|فراهم نیست|میسر نیست|نیست|نمی باشد|ممکن نیست|مقدور نیست|نمی شود|داده نمی شود|ارائه نمی شود|نمی توان"
TASK = (
    "help|assist|provide|do|continue|continuing|process|comply|complete|fulfil|fulfill|answer|respond|reply|handle|take on|take this|produce|offer|carry out|edit|work on|working on|deliver|go on|go ahead|proceed|support|engage|attempt|undertake|finish|perform|accept this|accept that|give you|discuss|"
    "کمک|پاسخ|انجام|ادامه|پردازش|ارائه|ویرایش|تکمیل|"
    "تقديم|مساعدة|مساعدتك|تنفيذ|معالجة|إكمال|إتمام|متابعة|مواصلة|الرد|الإجابة|تلبية|صياغة|تحرير|القيام|الاستجابة|إنجاز"
)
TEXT = (
    "translate|translating|translated|translation|translations|render|rendering|reword|rephrase|paraphrase|this text|that text|this request|that request|your request|such requests|this passage|this segment|this unit|this sentence|this content|such content|this material|this task|that task|this document|this piece|this job|this one|"
    "ترجمه|برگردان|این متن|این درخواست|این بخش|این قطعه|این کار|این جمله|این محتوا|این سند|درخواست شما|متن شما|چنین متنی|چنین درخواستی|"
    "ترجمة|أترجم|نقل هذا|هذا النص|هذا الطلب|هذا المقطع|هذه الجملة|هذه المهمة|هذا المحتوى|هذه الوحدة|طلبك|طلبكم|مثل هذا|هذه الفقرة"
)
OUTSIDE = "falls outside|fall outside|is outside|lies outside|outside|goes beyond|is beyond|beyond|exceeds|against|conflicts with|conflict with|contradicts|contradict|breaches|breach|not something|isn't something|violates|violate|not within|not part of|isn't part of|not in"
DO_NOT = "don't|do not|doesn't|does not|لا أقدم|لا أقوم|لا أترجم|لا أنتج|انجام نمی دهم|ترجمه نمی کنم|پاسخ نمی دهم|تولید نمی کنم"
MINE = "what i|i can|i do|i may|i am|i'm|my|me"
OUTSIDE_SELF = (
    "خارج از توان من|خارج از حوزه من|خارج از حیطه من|خارج از محدوده من|خارج از اختیار من|خارج از وظایف من|خارج از توانایی|فراتر از توان|فراتر از حد من|فراتر از اختیار|در توان من نیست|در حیطه کار من نیست|در حوزه کار من نیست|از توان من خارج|از عهده من|از حدود اختیارات من|رهنمودهای من|دستورالعمل های من|کار من نیست|"
    "خارج قدرتي|خارج قدراتي|خارج نطاق|خارج حدودي|خارج حدود|خارج صلاحياتي|خارج إمكانياتي|خارج اختصاصي|يتجاوز قدرات|يتجاوز قدرتي|يتجاوز صلاحياتي|يتجاوز حدود|يتجاوز إمكان|فوق قدرتي|فوق طاقتي|ليس من صلاحياتي|ليس من اختصاصي|ليس ضمن|إرشاداتي|لا يدخل في|سياساتي"
)
NOTHING = "no translation|no rendering|no answer|no response|no version|هیچ ترجمه|ترجمه ای|پاسخی|لا ترجمة|لا توجد ترجمة|لا تتوفر ترجمة|لا يوجد رد"
GIVEN = "be given|be provided|be offered|be produced|is possible|is available|will follow|will be|can be|is provided"
CANNOT_BE = "cannot be|can't be|can not be|could not be|won't be|will not be|لا يمكن|لن يتم|لا تمكن|يتعذر|تتعذر|تعذر"
SORRY = "i'm sorry|i am sorry|sorry|apologies|i apologise|i apologize|my apologies|unfortunately|regrettably|i'm afraid|i am afraid|i regret|متأسفم|پوزش|با عرض معذرت|شرمنده|معذرت می خواهم|عذر می خواهم|متأسفانه|با تأسف|للأسف|عذرا|آسف|أعتذر|معذرة|يؤسفني|مع الأسف"
ELSEWHERE = "human translator|professional translator|another translator|qualified translator|certified translator|another service|other service|different service|someone else|another tool|a human|human expert|مترجم انسانی|مترجم حرفه ای|مترجم دیگری|مترجم دیگر|سرویس دیگری|ابزار دیگری|شخص دیگری|جای دیگری|مترجما بشريا|مترجم بشري|مترجم محترف|مترجما محترفا|مترجم آخر|مترجما آخر|خدمة أخرى|شخص آخر|جهة أخرى|أداة أخرى"
MORE = "thank you for the text|thanks for the text|thank you for your|let me know if|is there another text|anything else i can|something else i can|without more context|looks sensitive|سپاس از متن|متن دیگری دارید|اگر کار دیگری|متن کامل فرستاده|شكرا على النص|أخبرني إن|هل لديك نص|هل هناك شيء آخر"

CLASSES = {
    "speaker": SPEAKER, "unable_we": UNABLE_WE, "held_back": HELD_BACK, "model": MODEL, "unable": UNABLE, "unable_self": UNABLE_SELF, "able": ABLE, "not_self": NOT_SELF, "not_there": NOT_THERE, "task": TASK, "text": TEXT,
    "do_not": DO_NOT, "outside": OUTSIDE, "mine": MINE, "outside_self": OUTSIDE_SELF, "nothing": NOTHING, "given": GIVEN, "cannot_be": CANNOT_BE, "sorry": SORRY, "elsewhere": ELSEWHERE, "more": MORE,
}

#: Orders of classes within a sentence that make a refusal (2), and those that are a sign of one (1).
ORDERS = {
    ("speaker", "unable", "task"): 2, ("speaker", "unable", "text"): 2, ("unable_we", "text"): 2, ("held_back", "text"): 2, ("held_back", "task"): 2, ("cannot_be", "held_back"): 2, ("text", "held_back"): 1, ("model", "text", "unable"): 2, ("text", "unable", "mine"): 2, ("unable_self", "task"): 2, ("unable_self", "text"): 2, ("task", "unable_self"): 2, ("text", "unable_self"): 2,
    ("able", "task", "not_self"): 2, ("able", "text", "not_self"): 2, ("text", "able", "not_self"): 2, ("task", "able", "not_self"): 2, ("able", "task", "not_there"): 2, ("able", "text", "not_there"): 2, ("text", "able", "not_there"): 2,
    ("outside", "mine"): 1, ("text", "outside", "mine"): 2, ("text", "outside_self"): 2, ("outside_self", "text"): 2, ("outside_self",): 1, ("nothing", "given"): 2, ("nothing", "not_there"): 2, ("text", "cannot_be", "text"): 2, ("text", "cannot_be", "task"): 2, ("cannot_be", "text", "text"): 2, ("cannot_be", "task", "text"): 2, ("nothing",): 1,
    ("model", "unable"): 2, ("model", "do_not"): 2, ("outside", "mine", "text"): 2, ("outside", "mine", "task"): 2, ("model", "unable_self"): 2, ("model", "not_self"): 2, ("model",): 1, ("speaker", "unable"): 1, ("unable_self",): 1, ("sorry",): 1, ("elsewhere",): 1, ("more",): 1,
}
#: Most words between two phrases of an order.
REACH = 7

_BREAKS = ".!?؟;؛\n:»«”“\"()[]"
_TOKENS = regex.compile(rf"[\p{{L}}\p{{M}}\p{{N}}']+|[{regex.escape(_BREAKS, special_only=False)}]")
_ARABIC = regex.compile(r"\p{Script=Arabic}")
#: What may be written together with the word that follows.
_PREFIXES = ("", "و", "ف", "ب", "ل", "ال", "بال", "لل", "وال", "ك")


class RefusalAutomaton:
    def __init__(self, fold: Callable[[str], str]) -> None:
        """``fold`` brings phrases to the form that texts come in."""
        self.phrases = ahocorasick.Automaton()
        found: dict[str, list[tuple[str, int]]] = {" | ": [("break", 3)]}
        for name, phrases in CLASSES.items():
            for p in phrases.split("|"):
                p = self._spaced(fold(p))
                for pre in _PREFIXES if _ARABIC.search(p) else ("",):
                    key = f" {pre}{p.strip()}" if _ARABIC.search(p) else p
                    found.setdefault(key, []).append((name, len(key)))
        for key, names in found.items():
            self.phrases.add_word(key, names)
        self.phrases.make_automaton()
        self.steps: dict[str, list[tuple[tuple[str, ...], int]]] = {}
        for order in ORDERS:
            for i, name in enumerate(order):
                self.steps.setdefault(name, []).append((order, i))

    @staticmethod
    def _spaced(folded: str) -> str:
        """The words, and a bar where a sentence may end, between single spaces."""
        words = _TOKENS.findall(folded.replace("’", "'").replace("\u200c", " ").casefold())
        return " " + " ".join("|" if w in _BREAKS else w for w in words) + " "

    def signs(self, folded: str) -> dict[tuple[str, ...], int]:
        """The orders that the sentences of a text hold, with their weights."""
        s = self._spaced(folded)
        hits = sorted((end - n + 1, end, name) for end, names in self.phrases.iter(s) for name, n in names)
        out: dict[tuple[str, ...], int] = {}
        if all(name == "break" for _, _, name in hits):
            return out
        spaces = [i for i, c in enumerate(s) if c == " "]
        reached: dict[tuple[tuple[str, ...], int], int] = {}  # (order, steps done) -> word behind the latest phrase
        for a, z, name in hits:
            if name == "break":
                reached.clear()
                continue
            first, behind = bisect_right(spaces, a), bisect_right(spaces, z)
            for order, i in self.steps[name]:
                last = reached.get((order, i)) if i else first
                if last is not None and 0 <= first - last <= REACH:
                    reached[order, i + 1] = max(reached.get((order, i + 1), 0), behind if s[z] == " " else behind + 1)
                    if i + 1 == len(order):
                        out[order] = ORDERS[order]
        return out

    def declines(self, folded: str) -> bool:
        """One order that is enough, or two signs of different kinds."""
        found = self.signs(folded)
        return max(found.values(), default=0) >= 2 or sum({order[-1]: w for order, w in found.items()}.values()) >= 2
