"""Problem 9: personal information inside free text, found and replaced with typed placeholders.

The model is a skip-chain conditional random field over *mentions*.  Permissive patterns propose mentions (anything of
the shape of an address, number, e-mail or name); a mention may be labelled with a kind its pattern admits, or with none.
Potentials: features of a mention and of its context, chain edges between neighbouring mentions, and skip edges between
mentions of a document that repeat a person, a family name, a number, an address or an e-mail, however far apart.  Loopy
belief propagation makes the labels of a document agree.  Features, chain and skip potentials (a table of label pairs for
each kind of repetition) are fitted together, by the pseudo-likelihood of a bounded sample of documents.  Its labels come
from unmistakable contexts (a title, a name list, words like "passport" or "phone" before a number); each is also learned
from without what gave it away, so that context and repetition must carry it.  The rest of the sample is labelled by the
model of the other half of the documents.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import durable, returned, sent, sent_type, ship, spread

KINDS = ("none", "email", "phone", "identity_number", "address", "name")
NONE, EMAIL, PHONE, IDENTITY, ADDRESS, NAME = range(len(KINDS))

#: Bounds: documents of the training sample (in the order of a hash of their text); a list of common words of up to so many
#: is sent along, of a longer one each text gets its own words.
SAMPLE_DOCUMENTS = 3_000
#: Longest text (characters) that may be in the sample.
SAMPLE_CHARS = 20_000
COMMON_WORDS = 50_000
BUCKETS = 1 << 17
#: Most digits of a phone number (E.164).
PHONE_DIGITS = 15
#: Mean of the prior of a skip potential: how much two mentions that repeat something agree before anything is learned.
AGREEMENT = 1.5
#: Rounds of message passing, and how far apart (characters) two neighbours may be that a chain edge joins.
ROUNDS, CHAIN_CHARS = 8, 60
#: What a skip edge repeats: the first letter of a mention's key.
REPEATS = ("e", "n", "a", "f", "p")

#: Words before the name of a person (titles, roles), by script.
TITLES = {
    "latin": "mr mrs ms miss dr prof sir madam mx".split(),
    "arabic": (
        "آقای خانم مهندس دکتر استاد همکارمان همکار نماینده‌مان ما، سرکار جناب حاج سید دوشیزه بانو وکیل "
        "السيد السيدة الآنسة الدكتور الدكتورة الأستاذ الأستاذة المهندس المهندسة زميلنا زميلتنا ممثلنا ممثلتنا الشيخ المحامي المحامية"
    ).split(),
}
#: Kinds of streets, districts and parts of an address.
STREETS = "avenue ave street st lane ln close court ct row road rd way drive dr place pl square sq terrace gardens crescent boulevard blvd parade mews hill walk".split()
#: Words that begin no name even where they are capitalised.
FUNCTION_WORDS = frozenset(
    "a an and are as at be been before after against between but by call dear even for from he her here his how i if in into is it its later my nor not of on once or our over please see she so than that the their then there these they this those through to today tomorrow under until was we were what when where which while who whom whose why with without yesterday yet you your".split()
)
#: Words that tell what a number is.
PHONE_WORDS = "call tel telephone phone mobile cell whatsapp fax number reached dial ring تلفن تماس همراه شماره موبایل واتساپ هاتف الهاتف جوال الجوال للتواصل الاتصال رقمي الرقم اتصل".split()
IDENTITY_WORDS = "passport identity national social security id card ssn ملی شناسنامه کدملی گذرنامه پاسپورت الوطني الهوية هوية جواز".split()
OTHER_NUMBER_WORDS = "invoice part isbn issn version iso flight ticket order article book reference فاکتور سفارش کتاب مقاله پرواز الفاتورة الطلب الكتاب المقال الرحلة".split()

_FREE_WORD = regex.compile(r"(?<![\w@.+%_＠-])\p{L}[\p{L}\p{M}]*(?:['’‌-]\p{L}[\p{L}\p{M}]*)*(?![\w@_+%＠-]|\.\p{L})")
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*(?:['’‌-]\p{L}[\p{L}\p{M}]*)*|\p{N}+|[^\s\p{L}\p{N}]")
_D = r"[0-9۰-۹٠-٩]"
_EMAIL = regex.compile(
    r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*"
    r"(?:\s?[@＠﹫]\s?|\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|\s+(?:at|AT)\s+(?=[\w-]+\s*(?:[\[({<]\s*dot\s*[\])}>]|\s(?:dot|DOT)\s)))"
    r"[\p{L}\p{N}][\p{L}\p{N}-]*(?:(?:\.|．|\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+(?:dot|DOT)\s+)[\p{L}\p{N}-]+)+",
    regex.I,
)
_EMAIL_SIGN = regex.compile(r"[@＠﹫]|[\[({<]\s*at\s*[\])}>]|\s(?:dot|DOT)\s", regex.I)
_NUMBER = regex.compile(rf"(?<![\p{{L}}\p{{N}}_#/:.,-])(?:[+＋]\s?|\()?{_D}+(?:\s?\)\s?|(?:[    .()/–-]{{0,2}}[(]?|\n(?={_D}{{3}})){_D}+)*(?![\p{{L}}\p{{N}}_/:]|[.,]\p{{N}})")
_CODE = regex.compile(rf"(?<![\p{{L}}\p{{N}}])[A-Z]{{1,3}}\s?{_D}{{2,}}(?:\s?{_D}+){{0,4}}(?:\s?[A-Z])?(?![\p{{L}}\p{{N}}])")
_STREET = "|".join(sorted({w.capitalize() for w in STREETS}, key=len, reverse=True))
_CAP = r"\p{Lu}[\p{L}'’-]*"
_POST = r"(?:\d{5}|[A-Z]{1,2}\d{1,2}[A-Z]?\s\d[A-Z]{2})"
_ADDRESS_EN = regex.compile(
    rf"(?:(?:Flat|Apt|Apartment|Unit|Suite|Room)\.?\s+\d+[A-Z]?,?\s+)?(?<![\p{{L}}\p{{N}}.,/-])\d{{1,5}}[A-Za-z]?\s+(?:{_CAP}\s+){{1,3}}?(?:{_STREET})\b\.?"
    rf"(?:,?\s+(?:Flat|Apt|Apartment|Unit|Suite)\.?\s+\d+[A-Z]?)?(?:(?:,\s*|\n)(?!Flat|Apt){_CAP}(?:[ \n]{_CAP})?(?=[\s,.;)]|\Z))?(?:,?\s+{_POST})?"
)
_WORD_FA = r"[\p{L}\p{M}‌]+"
_ADDRESS_FA = regex.compile(
    rf"(?:(?<![\p{{L}}\p{{M}}\u200c])(?P<city>{_WORD_FA})،\s+)?(?P<first>(?<!\p{{L}})(?:خیابان|بلوار|کوچه|میدان|محله|کوی|بزرگراه)\s+{_WORD_FA}(?:\s+{_WORD_FA})?(?:،\s+(?:خیابان|بلوار|کوچه|میدان|محله|کوی|بن‌بست)\s+{_WORD_FA}(?:\s+{_WORD_FA})?)*،\s+(?:پلاک|شماره)\s+{_D}+(?:،\s+(?:واحد|طبقه)\s+{_D}+)*)"
)
_ADDRESS_AR = regex.compile(
    rf"(?:(?<![\p{{L}}\p{{M}}\u200c])(?P<city>(?:{_WORD_FA}\s+)?{_WORD_FA})،\s+)?(?P<first>(?:{_D}+\s+(?=شارع|جادة))?(?<!\p{{L}})(?:شارع|حي|طريق|جادة|ساحة|ميدان|زقاق)\s+{_WORD_FA}(?:\s+ال{_WORD_FA})?(?:،\s+(?:شارع|مبنى|عمارة|رقم|شقة|بناية|طابق|الدور)\s+{_WORD_FA})?(?:،\s+(?:مبنى|عمارة|رقم|شقة|بناية|طابق|الدور)\s+{_D}+)*(?:،\s+(?!رقم|هوية|بطاقة|جواز){_WORD_FA}\s+ال{_WORD_FA})?)"
)
_ASCII = str.maketrans("۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789")
_ARABIC = regex.compile(r"\p{Script=Arabic}")
_GAP = regex.compile(r"(?P<stop>[”»\")]*+[.!?؟]++[”»\")]*+\s.*)|.*(?:\n\s*\n.*|:\n.*|[“«])", regex.S)
_LINE_GAP = regex.compile(r"\n\s*\n")


@dataclass
class Mention:
    start: int
    end: int
    kinds: tuple[int, ...]  # labels it may have besides none
    features: list[str]
    keys: tuple[str, ...] = ()  # mentions that share one are joined by a skip edge
    sure: int | None = None  # label of an unmistakable context


@lru_cache(maxsize=1 << 17)
def norm_word(w: str) -> str:
    w = w.replace("’", "'")
    return (w[:-2] if w.endswith(("'s", "'S")) else w).casefold()


@dataclass
class Lexicon:
    given: frozenset[str]
    common: frozenset[str] = field(default_factory=frozenset)
    #: Words that follow at least two different given names in the corpus.
    family: frozenset[str] = field(default_factory=frozenset)
    #: All common words and family names as a table (w), marked as :func:`corpus_words` does, where they are too many for
    #: ``common`` and ``family``, which are empty then; see :func:`with_words`.
    table: DataFrame | None = None


_TITLE_SET = frozenset(w.rstrip("،") for words in TITLES.values() for w in words if not w.endswith("،"))


@lru_cache(maxsize=1 << 16)
def _is_arabic(c: str) -> bool:
    return _ARABIC.match(c) is not None


def _begins_sentence(text: str, at: int) -> bool:
    """A word here follows the end of a sentence, which the dot of an initial or a title is not."""
    z = at
    while z and not text[z - 1].isalnum():
        z -= 1
    if not z:
        return True
    m = _GAP.fullmatch(text, z, at)
    if m is None:
        return False
    if m.group("stop") is None or not text[z - 1].isalpha():
        return True
    a = z
    while a and text[a - 1].isalpha():
        a -= 1
    return z - a > 2 and text[a:z].casefold() not in _TITLE_SET


def free_words(text: str, given: frozenset[str]) -> Iterator[tuple[str, bool, str]]:
    """Words of a text; whether each stands free: in lower case or at the start of a sentence, or in Arabic script not
    just after a title or given name; and the given name right before it ("" where there is none), listed or titled."""
    last, before = 9, ""
    for m in _FREE_WORD.finditer(text):
        raw = m.group()
        w = norm_word(raw)
        last += 1
        head = before if last == 2 and w != before else ""
        if "\u0600" <= w[0] <= "\u08ff":
            yield w, last > 2, head
        else:
            yield w, raw[0].islower() or (text[m.end() : m.end() + 1] != "," and _begins_sentence(text, m.start())), head if raw[0].isupper() else ""
        before = w
        if w in _TITLE_SET or w == "ما":
            last = 0
        elif w in given and not raw[0].islower():
            last = min(last, 1)


class Proposer:
    """Mentions of a text, with their features."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lex = lexicon

    def __call__(self, text: str) -> list[Mention]:
        out = list(self._emails(text)) if _EMAIL_SIGN.search(text) else []
        numbers = list(self._numbers(text))
        names = self._names(text, Spans([*out, *numbers]))
        name_ends = {x.end for x in names}
        for more in (self._addresses(text, name_ends), numbers, names):
            taken, last = Spans(out), 0
            for x in sorted(more, key=lambda x: x.start):
                if x.start >= last and not taken.hit(x.start, x.end):
                    out.append(x)
                    last = x.end
        out.sort(key=lambda x: x.start)
        return out

    def _emails(self, text: str) -> Iterator[Mention]:
        """Sure are those with a plain sign and a plain domain; the others stand or fall with their context and parts."""
        for m in _EMAIL.finditer(text):
            raw = m.group()
            if raw[-2:].isalpha():
                plain = "@" in raw and not regex.search(r"[\s\[({<]", raw)
                own = ["email", "sign:" + ("@" if "@" in raw else "other"), "dots:" + str(min(3, raw.count("."))), "ends:" + raw[-3:].casefold(), f"spaced:{' ' in raw}", f"digits:{regex.search(_D, raw) is not None}"]
                yield self._mention(text, m.start(), m.end(), (EMAIL,), own, ("e" + regex.sub(r"\W", "", raw.casefold()),), EMAIL if plain else None)

    def _context(self, text: str, a: int, z: int) -> list[str]:
        left = [norm_word(w) for w in WORD.findall(text[max(0, a - 60) : a])][-5:]
        right = [norm_word(w) for w in WORD.findall(text[z : z + 40])][:3]
        words = [w for w in left if w[0].isalpha()]
        f = [f"l{i}:{w}" for i, w in enumerate(reversed(left[-3:]))] + [f"r{i}:{w}" for i, w in enumerate(right[:2])] + [f"lw:{w}" for w in words[-4:]]
        if len(left) > 1:
            f.append(f"ll:{left[-2]} {left[-1]}")
        return f

    def _mention(self, text: str, a: int, z: int, kinds: tuple[int, ...], own: list[str], keys: tuple[str, ...], sure: int | None) -> Mention:
        kind = own[0]
        return Mention(a, z, kinds, [kind, *(f"{kind}|{f}" for f in own[1:]), *(f"{kind}|{f}" for f in self._context(text, a, z))], keys, sure)

    def _addresses(self, text: str, name_ends: set[int]) -> Iterator[Mention]:
        for m in _ADDRESS_EN.finditer(text):
            raw = m.group()
            parts = [*(["flat"] * (not raw[0].isdigit())), *(["city"] * ("," in raw[8:] or "\n" in raw)), *(["post"] * (regex.search(rf"{_POST}\Z", raw) is not None))]
            own = ["address", "latin", *parts, f"parts:{len(parts)}", "street:" + next((w for w in regex.findall(r"\p{L}+", raw.casefold()) if w in _STREET_SET), "")]
            yield self._mention(text, m.start(), m.end(), (ADDRESS,), own, ("a" + norm_word(raw),), ADDRESS if parts else None)
        if "خیابان" in text or "بلوار" in text or "کوچه" in text or "میدان" in text:
            for m in _ADDRESS_FA.finditer(text):
                city = m.group("city") is not None and m.end("city") not in name_ends and not _STARTS_CLAUSE.match(m.group("city"))
                yield self._mention(text, m.start() if city else m.start("first"), m.end(), (ADDRESS,), ["address", "persian", f"city:{city}", f"parts:{m.group('first').count('،')}"], ("a" + m.group("first"),), ADDRESS if city or m.group("first").count("،") > 1 else None)
        if "شارع" in text or "حي " in text or "طريق" in text:
            for m in _ADDRESS_AR.finditer(text):
                first = m.group("first")
                a = m.start("first")
                if m.group("city") is not None and m.end("city") not in name_ends:
                    words = [(w.start() + m.start("city"), w.group()) for w in regex.finditer(_WORD_FA, m.group("city"))]
                    if len(words) == 2 and words[1][1].startswith("ال") and not words[0][1].startswith("ال") and words[0][1] not in ("إلى", "في", "من", "عن", "على"):
                        a = words[0][0]
                    elif words[-1][1] not in self.lex.common:
                        a = words[-1][0]
                numbered = regex.search(_D, first) is not None
                yield self._mention(text, a, m.end(), (ADDRESS,), ["address", "arabic", f"numbered:{numbered}", f"city:{a < m.start('first')}"], ("a" + first,), ADDRESS if numbered else NONE)

    def _numbers(self, text: str) -> Iterator[Mention]:
        for pattern, letters in ((_CODE, True), (_NUMBER, False)):
            for m in pattern.finditer(text):
                a, z = m.span()
                raw = m.group()
                while raw and raw[-1] in " \n(   .-–/":
                    raw, z = raw[:-1], z - 1
                if raw.startswith("(") and ")" not in raw:
                    raw, a = raw[1:], a + 1
                plain = raw.translate(_ASCII)
                digits = regex.sub(r"\D", "", plain)
                if not (6 if letters else 7) <= len(digits) <= 16 or "/" in raw:
                    continue
                shape = regex.sub(r"[^\S ]", " ", regex.sub("[A-Z]", "A", regex.sub(r"\d", "9", plain)))
                left = {norm_word(w) for w in WORD.findall(text[max(0, a - 48) : a])[-5:]}
                near = {norm_word(w) for w in WORD.findall(text[max(0, a - 30) : a])[-3:]}
                sure = None
                if near & _OTHERS:
                    sure = NONE
                elif near & _IDS:
                    sure = IDENTITY
                elif not letters and (left & _PHONES or plain.startswith("+")):
                    sure = PHONE
                own = ["code" if letters else "number", "shape:" + shape, "groups:" + regex.sub("9+", lambda g: str(len(g.group())), shape), f"n:{len(digits)}", "first:" + plain[0] if plain[0] in "+(" else "first:" + digits[:2], *(["phone word"] * bool(left & _PHONES)), *(["id word"] * bool(near & _IDS)), *(["other word"] * bool(near & _OTHERS))]
                yield self._mention(text, a, z, (IDENTITY,) if letters or len(digits) > PHONE_DIGITS else (PHONE, IDENTITY), own, ("n" + digits, "s" + shape), sure)

    def _names(self, text: str, taken: Spans) -> list[Mention]:
        given, common, known = self.lex.given, self.lex.common, self.lex.family
        tokens = [(m.group(), *m.span()) for m in WORD.finditer(text)]
        if taken:
            tokens = [t for t in tokens if not taken.hit(t[1], t[2])]
        n, out = len(tokens), []
        lower = [norm_word(t) for t, _, _ in tokens]
        before, after = ["", *lower], [*lower[1:], ""]
        #: persons that a title or the list names somewhere in the text: proposed wherever they stand
        arabic = [_is_arabic(t[0][0]) for t in tokens]
        led = [i for i, w in enumerate(lower) if arabic[i] and i + 1 < n and arabic[i + 1] and (w in given or before[i] in _TITLE_SET)]
        persons = {(lower[i], after[i]) for i in led if lower[i] not in _TITLE_SET and len(after[i]) >= 4 and after[i] not in common}
        may = [i for i, t in enumerate(tokens) if t[0][0].isupper() or lower[i] in given or before[i] in _TITLE_SET or before[i] == "،" or (arabic[i] and i + 1 < n and arabic[i + 1] and (after[i] in known or (lower[i], after[i]) in persons))]  # no name begins elsewhere

        def near(j: int) -> bool:
            """Token j follows the one before it closely: on this line or the next."""
            return j < n and tokens[j][1] - tokens[j - 1][2] <= 3 and not _LINE_GAP.search(text, tokens[j - 1][2], tokens[j][1])

        def cap(j: int) -> str:
            """'T' for a capitalised word, 'U' for one in capitals, '' else."""
            w = tokens[j][0]
            w = w[:-2] if w.endswith(("'s", "’s")) else w
            if len(w) < 2 or not w[0].isupper() or _ARABIC.match(w):
                return ""
            return "U" if w.isupper() else "T"

        def is_given(j: int) -> bool:
            return j < n and cap(j) != "" and (lower[j] in given or (len(lower[j]) >= 3 and "'" not in lower[j] and lower[j] not in FUNCTION_WORDS and lower[j] not in _TITLE_SET))

        def is_family(j: int) -> bool:
            return j < n and cap(j) != "" and len(lower[j]) >= 4 and lower[j] not in common and lower[j] not in given and lower[j] not in _STREET_SET

        def initial(j: int) -> bool:
            return j + 1 < n and len(tokens[j][0]) == 1 and tokens[j][0].isupper() and tokens[j + 1][0] == "." and tokens[j + 1][1] == tokens[j][2]

        done = 0
        for i in may:
            if i < done:
                continue
            first = tokens[i][0][0]
            if first.isupper():
                j = i + 1
                kind = ""
                if initial(i):
                    j = i + 2
                    if initial(j) and near(j):
                        j += 2
                    if near(j) and is_family(j):
                        kind, fam, giv = "initial", j, None
                elif is_given(i):
                    if initial(j) and near(j):
                        j += 2
                    turned = near(j) and is_family(j) and near(j + 1) and tokens[j + 1][0] == "," and near(j + 2) and is_given(j + 2) and not is_family(j + 3)
                    if near(j) and is_family(j) and cap(j) == cap(i) and not (turned and lower[i] in common and lower[i] not in given):
                        kind, fam, giv = "plain", j, i
                    elif is_family(i) and i + 2 < n and tokens[i + 1][0] == "," and near(i + 1) and near(i + 2) and tokens[i + 2][1] > tokens[i + 1][2]:
                        if initial(i + 2):
                            kind, fam, giv, j = "turned", i, None, i + 3
                        elif is_given(i + 2) and cap(i + 2) == cap(i):
                            kind, fam, giv, j = "turned", i, i + 2, i + 2
                if kind:
                    out.append(self._name(text, tokens, lower, i, j, kind, fam, giv, given))
                    done = j + 1
            elif arabic[i]:
                if i + 1 >= n or not arabic[i + 1] or not near(i + 1) or lower[i] in _TITLE_SET or lower[i + 1] in common or lower[i + 1] in given or len(lower[i + 1]) < 4:
                    continue
                title = i > 0 and near(i) and (lower[i - 1] in _TITLE_SET or (lower[i - 1] == "،" and i > 1 and lower[i - 2] == "ما"))
                form = "titled" if title else "listed" if lower[i] in given else "repeated" if (lower[i], lower[i + 1]) in persons else "unlisted" if lower[i + 1] in known and lower[i] not in common and len(lower[i]) > 2 else ""
                if form:
                    out.append(self._name(text, tokens, lower, i, i + 1, form, i + 1, i, given))
                    done = i + 2
        return out

    def _name(self, text: str, tokens: list, lower: list[str], i: int, j: int, kind: str, fam: int, giv: int | None, given: frozenset[str]) -> Mention:
        f, g = lower[fam], lower[giv] if giv is not None else None
        end = tokens[j][2]
        if tokens[j][0].endswith(("'s", "’s")):
            end -= 2
        k = i - 1
        if k >= 0 and tokens[k][0] == ".":
            k -= 1
        titled = k >= 0 and (lower[k] in _TITLE_SET or kind == "titled")
        own = ["name", "form:" + kind, *(["titled"] * titled), *(["listed"] * (g in given)), *(["common given"] * (g in self.lex.common)), *(["known family"] * (f in self.lex.family)), "f3:" + f[-3:], "f4:" + f[-4:], "p3:" + f[:3], "p4:" + f[:4], f"caps:{tokens[fam][0].isupper()}", f"hyphen:{'-' in f}"]
        # a listed name that is a word too needs a family name that others have: "last spring" has none
        sure = NAME if titled or (g in given and (f in self.lex.family or (g not in self.lex.common and not _ARABIC.match(f)))) else None
        keys = ("f" + f, "p" + f + "/" + (g or tokens[i][0].casefold()))
        return self._mention(text, tokens[i][1], end, (NAME,), own, keys, sure)


_BEFORE_COMMA = regex.compile(rf"(?<![\p{{L}}\p{{M}}\u200c]){_WORD_FA}(?=،)")


def asked_words(text: str) -> list[str]:
    """All words that :class:`Proposer` may look up in its lists: those that a name or a city may be made of."""
    names = {norm_word(w) for w in WORD.findall(text) if w[0].isupper() or _ARABIC.match(w)}
    return sorted(names.union(_BEFORE_COMMA.findall(text)))


_STREET_SET = frozenset(STREETS)
_PHONES, _IDS, _OTHERS = (frozenset(map(norm_word, x)) for x in (PHONE_WORDS, IDENTITY_WORDS, OTHER_NUMBER_WORDS))
_STARTS_CLAUSE = regex.compile(r"(?:ساکن|نشانی|برای|همان|به|در)\Z")


class Spans:
    """Places taken by mentions that do not overlap; looked up by bisection."""

    def __init__(self, mentions: Sequence[Mention]) -> None:
        spans = sorted((x.start, x.end) for x in mentions)
        self.starts, self.ends = [a for a, _ in spans], list(accumulate((z for _, z in spans), max))

    def __len__(self) -> int:
        return len(self.starts)

    def hit(self, a: int, z: int) -> bool:
        """[a, z) overlaps one of them."""
        i = bisect_left(self.starts, z)
        return i > 0 and self.ends[i - 1] > a


class Proposers:
    """A proposer for all texts, or one for each where its common words are looked up."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lex, self.whole = lexicon, Proposer(lexicon)

    def __call__(self, text: str, words: Sequence[str] | None) -> list[Mention]:
        return (self.whole if words is None else Proposer(Lexicon(self.lex.given, *marked(words))))(text)


def marked(words: Iterable[str]) -> tuple[frozenset[str], frozenset[str]]:
    """Common words (marked c) and family names (marked f)."""
    words = list(words)
    return frozenset(w[1:] for w in words if w[0] == "c"), frozenset(w[1:] for w in words if w[0] == "f")


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def chain_edges(mentions: Sequence[Mention]) -> list[tuple[int, int]]:
    """Neighbours close to each other."""
    return [(i, i + 1) for i in range(len(mentions) - 1) if mentions[i + 1].start - mentions[i].end <= CHAIN_CHARS]


def skip_edges(mentions: Sequence[Mention]) -> list[tuple[int, int, int]]:
    """(earlier, later, what is repeated): each mention with the last one before it that has its key, so there are no more
    edges than keys however often one is repeated.  Two mentions are joined once, by the closest repetition."""
    last: dict[str, int] = {}
    edges: dict[tuple[int, int], int] = {}
    for i, m in enumerate(mentions):
        for k in m.keys:
            if k[0] in REPEATS:
                if k in last:
                    edges[last[k], i] = max(edges.get((last[k], i), 0), REPEATS.index(k[0]))
                last[k] = i
    return [(a, b, r) for (a, b), r in edges.items()]


@dataclass
class SkipChainModel:
    weights: np.ndarray  # buckets x kinds
    chain: np.ndarray  # kinds x kinds, of neighbours
    skip: np.ndarray  # repeats x kinds x kinds, symmetric

    def local(self, mentions: Sequence[Mention]) -> np.ndarray:
        """Log-potentials of each mention's labels; labels it does not admit are ruled out."""
        out = np.full((len(mentions), len(KINDS)), -1e9)
        for i, m in enumerate(mentions):
            s = self.weights[[bucket(f) for f in m.features]].sum(0)
            for k in (NONE, *m.kinds):
                out[i, k] = s[k]
        return out

    def label(self, mentions: Sequence[Mention], skips: bool = True) -> list[int]:
        """Labels by loopy belief propagation over chain and skip edges."""
        n = len(mentions)
        if not n:
            return []
        local = self.local(mentions)
        edges = [(i, j, self.chain) for i, j in chain_edges(mentions)]
        if skips:
            edges += [(i, j, self.skip[r]) for i, j, r in skip_edges(mentions)]
        if not edges:
            return local.argmax(1).tolist()
        messages = np.zeros((len(edges), 2, len(KINDS)))
        belief = local.copy()
        for _ in range(ROUNDS):
            change = 0.0
            for e, (i, j, w) in enumerate(edges):
                for way, (a, b, pot) in enumerate(((i, j, w), (j, i, w.T))):
                    x = (belief[a] - messages[e, 1 - way])[:, None] + pot
                    top = x.max(0)
                    new = top + np.log(np.exp(x - top).sum(0))
                    new -= new.max()
                    change = max(change, float(np.abs(new - messages[e, way]).max()))
                    belief[b] += new - messages[e, way]
                    messages[e, way] = new
            if change < 1e-3:
                break
        return belief.argmax(1).tolist()


#: Features that the unmistakable contexts rest on; each labelled mention is also learned from without them.
_GIVEAWAY = frozenset(("listed", "titled", "form:titled", "form:listed", "phone word", "id word", "other word", "sign:@", "flat", "city", "post", "parts:1", "parts:2", "parts:3", "city:True", "numbered:True"))
NAME_CHANCE = 0.35


def _gives_away(m: Mention, feature: str) -> bool:
    kind, _, f = feature.partition("|")
    return f in _GIVEAWAY or (kind in ("code", "number") and f.split(":")[0] in ("l0", "l1", "l2", "lw", "ll"))


@dataclass
class Example:
    """A mention to learn from: its features, what it admits, its label and weight, and its neighbours' labels."""

    features: np.ndarray
    admitted: np.ndarray
    label: int
    weight: float
    left: tuple[int, ...] = ()
    right: tuple[int, ...] = ()
    repeats: tuple[tuple[int, int], ...] = ()  # (what is repeated, label there)


def pseudo_likelihood(examples: Sequence[Example], epochs: int, rate: float, l2: float) -> SkipChainModel:
    """All potentials at once: each example's label given its features and the labels of its neighbours on chain and skip
    edges, by AdaGrad."""
    k, r = len(KINDS), len(REPEATS)
    agreement = np.tile(np.eye(k) * AGREEMENT, (r, 1, 1))
    params = [np.zeros((BUCKETS, k)), np.zeros((k, k)), agreement.copy()]
    squares = [np.full(p.shape, 1e-8) for p in params]
    weights, chain, skip = params

    def step(which: int, at, g: np.ndarray) -> None:
        squares[which][at] += g**2
        params[which][at] -= rate * g / np.sqrt(squares[which][at])

    random = np.random.default_rng(7)
    for _ in range(epochs):
        for e in random.permutation(len(examples)):
            x = examples[e]
            z = weights[x.features].sum(0) + x.admitted
            for y in x.left:
                z = z + chain[y]
            for y in x.right:
                z = z + chain[:, y]
            for what, y in x.repeats:
                z = z + skip[what, y]
            p = np.exp(z - z.max())
            p /= p.sum()
            p[x.label] -= 1
            p *= x.weight
            step(0, x.features, p + l2 * weights[x.features])
            for y in x.left:
                step(1, y, p + l2 * chain[y])
            for y in x.right:
                step(1, (slice(None), y), p + l2 * chain[:, y])
            for what, y in x.repeats:
                step(2, (what, y), p + l2 * (skip[what, y] - agreement[what, y]))
    return SkipChainModel(weights, chain, (skip + skip.transpose(0, 2, 1)) / 2)


def train(documents: Sequence[Sequence[Mention]], epochs: int = 4, rate: float = 0.15, l2: float = 1e-3) -> SkipChainModel:
    """The potentials of all features, neighbours and repetitions.

    A labelled mention is learned from twice, with all its features and without those that gave its label away, so the
    rest (context, neighbours, repetitions) must learn to tell.  Unlabelled mentions get the label that a model of the
    *other half* of the documents gives them; in that model, unlabelled names count half as none, other unlabelled
    mentions not at all.  As only part of the names can be labelled, a name needs less than an even chance
    (``NAME_CHANCE``).  A family name that a labelled mention has labels the others that have it."""
    flat = [m for ms in documents for m in ms]
    half = [d % 2 for d, ms in enumerate(documents) for _ in ms]
    full = [np.array([bucket(f) for f in m.features]) for m in flat]
    hard = [np.array([bucket(f) for f in m.features if not _gives_away(m, f)]) for m in flat]
    admitted = np.full((len(flat), len(KINDS)), -1e9)
    for i, m in enumerate(flat):
        admitted[i, [NONE, *m.kinds]] = 0
    left: list[list[int]] = [[] for _ in flat]
    right: list[list[int]] = [[] for _ in flat]
    repeats: list[list[tuple[int, int]]] = [[] for _ in flat]
    at = 0
    for ms in documents:
        for i, j in chain_edges(ms):
            right[at + i].append(at + j)
            left[at + j].append(at + i)
        for i, j, r in skip_edges(ms):
            repeats[at + i].append((r, at + j))
            repeats[at + j].append((r, at + i))
        at += len(ms)
    families = {m.keys[0] for m in flat if m.sure == NAME}
    labels = [NAME if m.sure is None and NAME in m.kinds and m.keys[0] in families else m.sure for m in flat]
    known = [i for i, x in enumerate(labels) if x is not None]

    def example(i: int, features: np.ndarray, label: int, weight: float, said: Sequence[int | None]) -> Example:
        sides = [tuple(said[j] for j in side[i] if said[j] is not None) for side in (left, right)]
        return Example(features, admitted[i], label, weight, *sides, tuple((r, said[j]) for r, j in repeats[i] if said[j] is not None))

    target = list(labels)
    for h in (0, 1):
        own = [example(i, v[i], labels[i], 1.0, labels) for v in (full, hard) for i in known if half[i] == h]
        own += [example(i, full[i], NONE, 0.5, labels) for i, x in enumerate(labels) if x is None and NAME in flat[i].kinds and half[i] == h]
        m = pseudo_likelihood(own, epochs, rate, l2)
        for i, x in enumerate(labels):
            if x is None and half[i] != h:
                z = m.weights[full[i]].sum(0) + admitted[i]
                for r, j in repeats[i]:
                    if labels[j] is not None:
                        z = z + m.skip[r, labels[j]]
                p = np.exp(z - z.max())
                p /= p.sum()
                best = max(flat[i].kinds, key=lambda k: p[k])
                target[i] = best if p[best] >= (NAME_CHANCE if best == NAME else 0.5) else NONE
    all_examples = [example(i, v[i], target[i], 1.0, target) for v in (full, hard) for i in known]
    all_examples += [example(i, full[i], target[i], 0.7, target) for i, x in enumerate(labels) if x is None]
    model = pseudo_likelihood(all_examples, epochs, rate, l2)
    model.weights = model.weights.astype(np.float32)
    return model


def corpus_words(documents: DataFrame, text: str, given: frozenset[str]) -> DataFrame:
    """(w): "c" and each word that stands free at least three times in ten; "f" and each word that follows at least two
    different given names and does not stand free so often; counted over all documents."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, str], list[int]] = {}

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(*k, *c) for k, c in seen.items()], columns=["w", "head", "n", "free"])

        for b in batches:
            for t in b["t"]:
                for w, free, head in free_words(t, given):
                    c = seen.setdefault((w, head), [0, 0])
                    c[0] += 1
                    c[1] += free
            if len(seen) > 200_000:
                yield rows()
                seen.clear()
        yield rows()

    counts = spread(documents.select(F.col(text).alias("t")).where("t is not null")).mapInPandas(run, "w string, head string, n long, free long")
    by_head = counts.groupBy("w", "head").agg(F.sum("n").alias("n"), F.sum("free").alias("free"))
    by_word = by_head.groupBy("w").agg(F.sum("n").alias("n"), F.sum("free").alias("free"), F.count_if(F.col("head") != "").alias("heads"))
    free = F.expr("free >= 0.3 * n and free > 0")
    return by_word.select(F.concat(F.when(free, "c").when(F.col("heads") >= 2, "f"), "w").alias("w")).where("w is not null")


def learn_lexicon(documents: DataFrame, text: str, given: frozenset[str]) -> Lexicon:
    """The lexicon with the common words and family names of all documents."""
    words = durable(corpus_words(documents, text, given))
    few = words.limit(COMMON_WORDS + 1).collect()
    return Lexicon(given, table=words) if len(few) > COMMON_WORDS else Lexicon(given, *marked(r["w"] for r in few))


def with_words(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``rows`` (..., t) and ``c``, the common words and family names that each text may ask for; null where the lexicon
    holds them all.

    Found by an equi-join with the table of words, once for each different text."""
    if lexicon.table is None:
        return spread(rows).withColumn("c", F.lit(None).cast("array<string>"))
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = [(d, w) for d, t in zip(b["d"], b["t"]) for w in asked_words(t)]
            yield pd.DataFrame(pairs, columns=["d", "asked"])

    keyed = rows.withColumn("d", F.sha2("t", 256))
    asked = spread(keyed.select("d", "t").where("t is not null")).mapInPandas(run, "d string, asked string").distinct()
    known = lexicon.table.select(F.expr("substring(w, 2)").alias("asked"), "w")
    found = asked.join(known, "asked").groupBy("d").agg(F.collect_list("w").alias("c"))
    return keyed.join(found, "d", "left").drop("d").withColumn("c", F.coalesce("c", F.array().cast("array<string>")))


def given_name_list(names: DataFrame, column: str) -> frozenset[str]:
    """The list of given names; a fixed table, read in full."""
    return frozenset(norm_word(r[0]) for r in names.select(column).where(F.col(column).isNotNull()).distinct().collect())


def fit(documents: DataFrame, text: str, given: frozenset[str], sample: int = SAMPLE_DOCUMENTS) -> tuple[Lexicon, SkipChainModel]:
    """The lexicon (from all documents) and the model (from at most ``sample`` documents)."""
    ship(documents.sparkSession)
    lexicon = learn_lexicon(documents, text, given)
    rows = documents.select(F.col(text).alias("t")).where("t is not null and t <> ''").where(F.length("t") <= SAMPLE_CHARS).withColumn("h", F.xxhash64("t")).orderBy("h").limit(sample)
    rows = rows.withColumn("c", F.lit(None).cast("array<string>")) if lexicon.table is None else with_words(durable(rows), lexicon)
    propose = Proposers(lexicon)
    return lexicon, train([m for r in sorted(rows.select("h", "t", "c").collect(), key=lambda r: (r["h"], r["t"])) if (m := propose(r["t"], r["c"]))])


def find_personal(documents: DataFrame, key: str, text: str, lexicon: Lexicon, model: SkipChainModel) -> DataFrame:
    """(key, kind, start_pos, end_pos): one row for each piece of personal information.

    Null and empty texts: no rows.  Repeated rows of a key: once.  Very long texts: read whole.  An empty table: no rows.
    Extra columns are not read.
    """
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((Lexicon(lexicon.given, lexicon.common, lexicon.family), model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex, crf = shared.value
        propose = Proposers(lex)
        for b in batches:
            rows = []
            for k, t, c in zip(b["k"], b["t"], b["c"]):
                found = propose(t, c) if t else []
                rows += [(k, KINDS[y], m.start, m.end) for m, y in zip(found, crf.label(found)) if y != NONE]
            yield pd.DataFrame(rows, columns=["k", "kind", "start_pos", "end_pos"])

    rows = with_words(documents.select(sent(documents, key, "k"), F.col(text).alias("t")).where("t is not null"), lexicon)
    found = rows.mapInPandas(run, f"k {sent_type(documents, key)}, kind string, start_pos int, end_pos int")
    return found.distinct().select(returned(documents, key, "k"), "kind", "start_pos", "end_pos")


def redact(documents: DataFrame, key: str, text: str, lexicon: Lexicon, model: SkipChainModel) -> DataFrame:
    """(key, text): every piece replaced with its kind in square brackets; null stays null; a row for each row."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((Lexicon(lexicon.given, lexicon.common, lexicon.family), model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex, crf = shared.value
        propose = Proposers(lex)
        for b in batches:
            texts = []
            for t, c in zip(b["t"], b["c"]):
                found = propose(t, c) if t else []
                for m, y in sorted(zip(found, crf.label(found)), key=lambda x: -x[0].start):
                    if y != NONE:
                        t = f"{t[: m.start]}[{KINDS[y].upper()}]{t[m.end :]}"
                texts.append(t)
            yield pd.DataFrame({"k": b["k"], "text": texts})

    rows = with_words(documents.select(sent(documents, key, "k"), F.col(text).alias("t")), lexicon)
    out = rows.mapInPandas(run, f"k {sent_type(documents, key)}, text string")
    return out.select(returned(documents, key, "k"), "text")
