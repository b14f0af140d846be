"""Problem 10: personal information inside free text, found and replaced.

Detection works on whole lines with one pattern per kind and a check on every candidate: e-mail
addresses (also written out with words for the signs), phone numbers (international, national and
bracketed forms), identity numbers (by shape, or after their label), street addresses (street and
house number) and names of people (given name or initial with family name, in either order). A name
is known by a table of given names, by the endings of family names, by a title or a label in front
of capitalised words, and in other scripts by titles, honorifics and family names of that script.

Replacement gives every entity a surrogate of its own type from a keyed function of the entity alone,
so an entity has one surrogate in all texts (coreference), also when a name is written the other way
round. Numbers go through a keyed permutation of all numbers of their format, so different numbers
never share a surrogate. Names, addresses and e-mail addresses carry 60 or more bits of a keyed hash,
spelled as syllables or digits; given names keep gender and script. The key is a required argument.
``placeholders`` instead gives typed placeholders such as ``[EMAIL_1]``.

NULL and empty texts have no entities and stay as they are. Line numbers count ``\\n``. Texts are
read whole; overlapping candidates resolve to the earlier, longer one of the stronger kind.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Common given names of several countries by gender (parameter of the detector).
FEMALE = frozenset(
    "aisha alice amelia amina ana anna aisha barbara beatriz camille carla carmen caroline catherine charlotte chiara clara claire "
    "claudia daniela diana elena elif elisa eliza emily emma eva farida fatima francesca gabriela giulia grace hana hanna hannah helen "
    "helena ines ingrid irene isabel jane jana jessica joanna julia julie karen katarina kate laura lea leila lena linda lisa lucia lucy "
    "maria marie marta mary mei mia monika nadia naomi nina noor núria nuria olga olivia paula petra priya rachel rosa ruth sara sarah "
    "silvia sofia sophie susan svetlana tessa ursula valentina vera victoria wanda yara yuki zoe zoë zoé".split()
)
MALE = frozenset(
    "adam ahmed alan alexander ali anders andré andre andrew anton antonio arjun arthur ben benjamin bruno carlos charles chen christian "
    "daniel david diego dmitri edward emil erik fabian felix fernando francis frank gabriel george giovanni gustav hans harald henrik henry "
    "hugo ibrahim igor ivan ivo jacob jack james jan javier jean jens jin joão joao johan john jonas jorge josé jose joseph juan jürgen "
    "jurgen karl kenji kevin klaus lars leo louis luca lucas luis marc marco marek mario mark martin mateo matthew max michael miguel "
    "mohamed nikolai oliver omar oskar otto pablo patrick paul pavel pedro peter philip pierre rafael raj richard robert samir samuel sergei "
    "simon stefan stephen thomas tim tom tomas ulrich victor viktor vincent walter wei william yusuf zhang".split()
)
GIVEN = FEMALE | MALE
# Country calling codes of two and three digits, by pattern.
CALLING = re.compile(r"(?:2(?:[07]|[1-689]\d)|3(?:[0-469]|[578]\d)|4(?:[013-9]|2\d)|5(?:[1-8]|[09]\d)|6(?:[0-6]|[789]\d)|8(?:[1246]|[058]\d|7\d)|9(?:[0-58]|[679]\d))$")

_U, _L = "A-ZÀ-ÖØ-ÞĀ-ſ", "a-zß-öø-ÿĀ-ſ'’"
_GIVEN = rf"[{_U}][{_L}]+(?:-[{_U}][{_L}]+)?"
_FAMILY = rf"(?:(?:von|van|de|der|da|di|del|la|Mc|Mac|O['’])[ ]?)*[{_U}][{_L}]{{2,}}(?:-[{_U}][{_L}]+)?"
_LOCAL_CHAR = re.compile(r"[\w.+%-]")
_LOCAL = re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+%-]*\Z")
_DOMAIN = re.compile(r"@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w@:/-])")
_WORDED_AT = re.compile(r"[(\[{<]at[)\]}>]|\bdot\b", re.I)
WORDED = re.compile(
    r"(?<![\w.+-])[A-Za-z0-9][\w.+%-]*\s?(?:\(at\)|\[at\]|\{at\}|<at>|\bat\b)\s?(?:[A-Za-z0-9][A-Za-z0-9-]*(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\}|<dot>|\bdot\b)\s?))+[A-Za-z]{2,}(?![\w-])",
    re.I,
)
PHONE = re.compile(r"(?<![\w.+/-])(?<!\d )(?:\+\d[\d ().-]{7,18}\d|00[1-9]\d[\d ().-]{6,16}\d|\(0?\d{2,5}\)[ -]?\d[\d -]{4,10}\d|0\d{1,4}(?:[ -]\d{2,4}){2,4}|0\d{1,4}[ /-]\d{5,8}|(?:1[-. ])?\d{3}[-. ]\d{3}[-. ]\d{4})(?![\w-])(?!\.\d)")
_IDENTITY_DIGITS = re.compile(r"(?<![\w.-])(?:\d{3}-\d{2}-\d{4}|\d{8}-?[A-HJ-NP-TV-Z]|\d{2} \d{3} \d{3} \d{3}|\d{3} \d{2} \d{4})(?![\w-])")
_IDENTITY_LETTERS = re.compile(
    r"\b(?<![.-])(?:[XYZ]-?\d{7}-?[A-HJ-NP-TV-Z]|[A-CEGHJ-PQR-TW-Z][A-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D])(?![\w-])"
)
_SPACED = re.compile(r"\d{3} \d{2} \d{4}|\d{2} \d{3} \d{3} \d{3}")
_LABEL_NEAR = re.compile(r"(?i)security|ssn|steuer|tax|\bid\b|number")
# A number, letters in front of it, and the label that must stand before both.
_NUMBER = re.compile(r"\d[\d -]{3,18}(?: ?[A-Z]\b)?")
_PREFIX = re.compile(r"(?<![A-Za-z])[A-Z]{1,2} ?\Z")
_LABEL_BEFORE = re.compile(
    r"(?:\b(?:SSN|DNI|NIE|NIF|NINO|TIN|CPF|PESEL|BSN|NSS|passport|passeport|reisepass|pasaporte|ausweis)\b|social security|s[eé]curit[eé] sociale|"
    r"sozialversicherung|seguridad social|\bNI (?:number|no)|national (?:id|insurance|identity)|(?:steuer|\btax)(?:[ -]?(?:id|nr|no|number|nummer|payer id))|"
    r"identity (?:card|number)|\bid card|personal(?:ausweis| id| number))"
    r"(?:[ -]?(?:card|number|nummer|num\.?|no\.?|nr\.?|id|n[°º]\.?))*\s*[:#=]?\s*\Z",
    re.I,
)
_NOT_ID = re.compile(r"\b(?:build|run|lot|order(?: no\.?)?|ticket|commit|job|invoice|batch|serial|seed|issue|version|range|part|sku|track)[ :#]*(?:no\.?|number|id)?[ :#]*$", re.I)
_FRENCH = "rue|avenue|boulevard|bd|allée|chemin|impasse|place|quai|route"
_ENGLISH = "Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Court|Ct|Boulevard|Blvd|Way|Place|Pl|Close|Square|Sq|Terrace|Crescent|Parkway|Pkwy|Highway|Hwy|Row|Hill|Gardens|Mews"
ADDRESS = re.compile(
    rf"\b[{_U}][{_L}-]+(?:stra(?:ß|ss)e|str\.|weg|allee|gasse|platz|ring|ufer|damm|chaussee) ?\d{{1,4}} ?[a-z]?\b"
    rf"|\b(?:[{_U}][{_L}]+er )?(?:Stra(?:ß|ss)e|Str\.|Weg|Allee|Platz) (?:[{_U}][{_L}]+ )*\d{{1,4}} ?[a-z]?\b"
    rf"|\b\d{{1,5}}[A-Za-z]?(?:[ ,]+(?:bis|ter))?,? (?:{_FRENCH})(?: (?:de la|de l['’]|des|de|du|d['’])| )?[ ]?[{_U}][{_L}-]+(?: [{_U}][{_L}-]+)*"
    rf"|\b(?:Calle|Avenida|Avda\.?|Plaza|Paseo|C/|Via|Viale|Piazza|Rua|Travessa)[ ]?(?:de la |de los |de las |del |de |da |do )?[{_U}][{_L}-]+(?: [{_U}][{_L}-]+)*,? (?:n[º°.] ?)?\d{{1,4}}\b"
    rf"|\b\d{{1,5}}[A-Za-z]? (?:[NSEW]\. )?(?:[{_U}][{_L}-]+ ){{1,3}}(?:{_ENGLISH})\b\.?"
)
NAME = re.compile(
    rf"(?<![\w@.`/-])(?P<g>{_GIVEN})(?: [{_U}]\.| {_GIVEN}(?= {_FAMILY}))? (?P<f>{_FAMILY})(?![\w(`@-])"
    rf"|(?<![\w@.`/-])(?P<i>[{_U}]\.)(?: ?[{_U}]\.)? (?P<fi>{_FAMILY})(?![\w(`@-])"
    rf"|(?<![\w@.`/-])(?P<fr>{_FAMILY}), (?P<gr>{_GIVEN}|[{_U}]\.)(?: [{_U}]\.)?(?![\w(`@-])"
)
_GIVEN_ANY = re.compile("|".join(sorted({g[:1].upper() + g[1:] for g in GIVEN}, key=len, reverse=True)))
_INITIAL = re.compile(rf"[{_U}]\. (?:[{_U}]|von|van|de|da|di|la)|, [{_U}]\.")
_DIGITS = re.compile(r"\D")
# Signs of an address, each a true superset of its alternatives of ADDRESS whatever follows: plain substrings, a digit
# right after a street's ending, and a house number before a street.
_STREET_SIGNS = ("straße", "strasse", "str.", "Straße", "Strasse", "Str.", "Weg ", "Allee ", "Platz ", "Calle", "Avenida", "Avda", "Plaza", "Paseo", "C/", "Via", "Piazza", "Rua", "Travessa")
_STREET_ENDS = ("weg", "allee", "gasse", "platz", "ring", "ufer", "damm", "chaussee")
_STREET_NUMBER = re.compile(r"\d(?:" + "|".join(rf"(?<={e}{gap}\d)" for e in _STREET_ENDS for gap in ("", " ")) + ")")
_NUMBER_STREET = re.compile(rf"\d[A-Za-z]?(?: (?:[NSEW]\. )?(?:[{_U}][{_L}-]+ ){{1,3}}(?:{_ENGLISH})\b|(?:[ ,]+(?:bis|ter))?,? (?:{_FRENCH}))")


def _may_hold_address(text: str) -> bool:
    return _has(text, _STREET_SIGNS) or bool(_STREET_NUMBER.search(text)) or bool(_NUMBER_STREET.search(text))


_LONG_NUMBER = re.compile(r"\d[\d ().+/A-Z-]{4,}")


def _phone_ok(s: str) -> bool:
    d = _DIGITS.sub("", s)
    if s.startswith("+"):
        head = re.match(r"\+(\d+)", s).group(1)
        if d.startswith(("1", "7")):
            if len(head) not in (1, 4, 11) and not (len(head) == 1):
                return False
            rest = re.findall(r"\d+", s)[1:]
            return len(d) == 11 and (not rest or [len(x) for x in rest] == [3, 3, 4] or len(rest) != 3)
        for n in (2, 3):
            if CALLING.match(d[:n]) and (len(head) == n or len(head) > 4):
                return 8 <= len(d) - n <= 11 or 9 <= len(d) <= 13
        return False
    if s.startswith("("):
        inside = _DIGITS.sub("", s[: s.index(")")])
        return (len(inside) == 3 and len(d) == 10 and not inside.startswith(("0", "1"))) or (inside.startswith("0") and 8 <= len(d) <= 12)
    if s.startswith("00"):
        return 10 <= len(d) <= 15
    if s.startswith("0"):
        return 9 <= len(d) <= 12
    d = d[1:] if len(d) == 11 and d[0] == "1" else d
    return len(d) == 10 and d[0] not in "01" and d[3] not in "01"


def _email_spans(text: str):
    at, last = text.find("@"), 0
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            lo = max(last, at - 64)
            while lo > last and _LOCAL_CHAR.match(text[lo]):
                lo = max(last, at - 2 * (at - lo))
            if left := _LOCAL.search(text[lo:at]):
                yield lo + left.start(), m.end()
        last = at
        at = text.find("@", at + 1)
    if _WORDED_AT.search(text):
        for m in WORDED.finditer(text):
            if _WORDED_AT.search(m.group()):
                yield m.start(), m.end()


def _identity_spans(text: str):
    for m in _NUMBER.finditer(text):
        lo = m.start()
        if left := _PREFIX.search(text[max(0, lo - 4) : lo]):
            lo = max(0, lo - 4) + left.start()
        if sum(map(str.isdigit, m.group())) >= 5 and _LABEL_BEFORE.search(text[max(0, lo - 64) : lo]):
            yield lo, lo + len(text[lo : m.end()].rstrip(" -"))
    for pattern in (_IDENTITY_DIGITS, _IDENTITY_LETTERS):
        for m in pattern.finditer(text):
            if not _NOT_ID.search(text[max(0, m.start() - 24) : m.start()]):
                if _SPACED.fullmatch(m.group()) and not _LABEL_NEAR.search(text[max(0, m.start() - 30) : m.start()]):
                    continue
                yield m.start(), m.end()


def _known(g: str) -> bool:
    return all(p.lower() in GIVEN for p in g.split("-"))


def _name_spans(text: str):
    at = 0
    while m := NAME.search(text, at):
        ok = False
        if m.group("g"):
            ok = _known(m.group("g"))
        elif m.group("i"):
            ok = _family_like(m.group("fi"), text, m)
        elif m.group("gr"):
            ok = _known(m.group("gr")) if not m.group("gr").endswith(".") else _family_like(m.group("fr"), text, m)
            if ok and m.group("fr").lower() in GIVEN:
                ok = False
        if ok:
            yield m.start(), m.end()
            at = m.end()
        else:
            at = m.end("g") if m.group("g") else m.start() + 1
            while at < len(text) and text[at - 1].isalpha() and text[at].isalpha():
                at += 1


# Endings that family names of several countries share.
_FAMILY_END = re.compile(
    r"(?:field|worth|quist|qvist|ander|stad|by|elli|ini|ez|es|sson|son|sen|ik|ova|eva|ov|ev|owicz|wicz|mark|holt|ide|berg|borg|burg|mann|man|kin|ski|ska|sky|"
    r"ham|ton|ford|ley|well|wood|stein|feld|bach|meier|meyer|mayer|müller|ström|gren|lund|dahl|idis|poulos|escu|yan|ian|oğlu|enko|uk|shi|moto|mura|elli|etti|otti|ucci)$"
)
_SPOKEN = re.compile(r"(?:\b(?:by|to|and|cc|from|am|with|par|von|de|desde|avisó|owner:|user\"?:|author|thanks|mr|ms|mrs|dr)|@[\w-]+,|[|\"(])\s*\"?$", re.I)


def _family_like(f: str, text: str, m) -> bool:
    last = f.rsplit(" ", 1)[-1]
    before = text[max(0, m.start() - 24) : m.start()]
    return bool(_FAMILY_END.search(last.lower())) and (bool(_SPOKEN.search(before)) or not before.strip() or bool(re.search(r"(?:[:/|,\"-]|\bto)\s*$", before)) or len(last) > 4)


# Titles and labels in front of a person's name; a title takes one more word of any form.
_TITLED = re.compile(
    rf"\b(?:Mr|Mrs|Ms|Mx|Miss|Dr|Prof|Professor|Sir|Herr|Frau|Mme|Madame|Monsieur|Señora?|Sra?|Dña|Signora?|Sig|Pan|Pani|Shri|Smt)\.? ({_GIVEN}(?: (?:[{_U}]\.|{_GIVEN}))*? {_FAMILY})(?![\w(`@-])"
)
_LABELLED = re.compile(
    rf"\b(?i:full name|patient|employee|applicant|tenant|customer|signed(?: by)?|sincerely|kind regards|best regards|yours truly|co-authored-by|signed-off-by|reviewed-by|reported-by)(?:[:,]\s+|\s*\n\s*)({_GIVEN}(?: (?:[{_U}]\.|{_GIVEN})){{0,2}} {_FAMILY})(?![\w(`@-])"
)
# A plain substring of each alternative of the two patterns above.
_TITLE_SIGNS = ("Mr", "Ms", "Mx", "Miss", "Dr", "Prof", "Sir", "Herr", "Frau", "Mme", "Madame", "Monsieur", "Señ", "Sr", "Dña", "Sig", "Pan", "Shri", "Smt")
_LABEL_SIGNS = ("full name", "patient", "employee", "applicant", "tenant", "customer", "signed", "sincerely", "regards", "yours truly", "-by:")
# Other scripts: family endings, family names and honorifics (fixed values).
_CYR = r"[А-ЯЁІЇЄ][а-яёіїє'’]+"
_SCRIPTS = (
    re.compile(rf"(?<!\w){_CYR}(?: {_CYR}(?:вич|вна|ич))? {_CYR}(?:ов|ева|ова|ев|ёв|ин|ина|ский|ская|цкий|цкая|енко|чук|юк|ян|ых|ко)(?!\w)|(?<!\w){_CYR}(?:ов|ева|ова|ев|ёв|ин|ина|ский|ская|енко) {_CYR}(?: {_CYR}(?:вич|вна))?(?!\w)|(?<!\w)(?:[А-Я]\. ?){{1,2}}{_CYR}(?!\w)"),
    re.compile(r"(?<!\w)[Α-ΩΆΈΉΊΌΎΏ][α-ωάέήίόύώϊϋΐΰς]+ [Α-ΩΆΈΉΊΌΎΏ][α-ωάέήίόύώϊϋΐΰ]+(?:πουλος|πούλου|ίδης|ίδου|άδης|άκης|άκη|όγλου|ης|ος|ου|ας)(?!\w)"),
    re.compile(r"(?:(?<=姓名[::])|(?<=姓名: )|(?<=联系人[::])|(?<=作者[::])|(?<=氏名[::]))[一-鿿]{2,4}(?![一-鿿])|[王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文][一-鿿]{1,2}(?=先生|女士|小姐|老师|博士|教授)"),
    re.compile(r"[一-鿿]{1,3}[  ]?[一-鿿ぁ-ゖァ-ヺ]{1,4}(?=さん|様|氏|先生|くん|ちゃん)|[ァ-ヺー]{2,}[・  ][ァ-ヺー]{2,}(?=さん|様|氏)"),
    re.compile(r"(?<![가-힣])[김이박최정강조윤장임한오서신권황안송류전홍고문양손배백허유남심노하곽성차주우구민진지엄채원천방공현함변염여추도소석선설마길][가-힣]{2}(?= ?(?:씨|님|선생님|교수|박사)(?![가-힣]))"),
    re.compile(r"(?:(?<=السيد )|(?<=السيدة )|(?<=الدكتور )|(?<=الدكتورة )|(?<=الأستاذ )|(?<=الاسم: ))[ء-ي]{2,}(?: (?:بن|ال)? ?[ء-ي]{2,}){1,2}"),
    re.compile(r"(?:(?<=श्री )|(?<=श्रीमती )|(?<=डॉ\. )|(?<=नाम: ))[ऀ-ॿ]{2,} [ऀ-ॿ]{2,}"),
)
_OTHER_SCRIPT = re.compile(r"[Α-ΩА-Яء-يऀ-ॿぁ-ヺ一-鿿가-힣]")


def _has(text: str, signs: tuple[str, ...]) -> bool:
    for t in signs:  # a plain loop, as a generator costs more than the searches
        if t in text:
            return True
    return False


def _more_names(text: str):
    """Names that a title, a label or their script gives away."""
    if _has(text, _TITLE_SIGNS):
        for m in _TITLED.finditer(text):
            yield m.span(1)
    if _has(text.lower(), _LABEL_SIGNS):
        for m in _LABELLED.finditer(text):
            yield m.span(1)
    if not text.isascii() and _OTHER_SCRIPT.search(text):
        for p in _SCRIPTS:
            for m in p.finditer(text):
                yield m.span()


_RANK = {"email": 0, "identity": 1, "phone": 2, "address": 3, "name": 4}


def entities(text: str | None) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of each entity, in order, without overlaps."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    found += [(a, b, "email") for a, b in _email_spans(text)]
    if _LONG_NUMBER.search(text):
        found += [(a, b, "identity") for a, b in _identity_spans(text)]
        found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if "\n" not in m.group() and _phone_ok(m.group())]
    if _may_hold_address(text):
        found += [(m.start(), m.end(), "address") for m in ADDRESS.finditer(text)]
    if _GIVEN_ANY.search(text) or _INITIAL.search(text):
        found += [(a, b, "name") for a, b in _name_spans(text)]
    found += [(a, b, "name") for a, b in _more_names(text)]
    found.sort(key=lambda e: (_RANK[e[2]], e[0], -e[1]))
    kept: list[tuple[int, int, str]] = []
    starts: list[int] = []
    for e in found:
        i = bisect_right(starts, e[0])
        if (i and kept[i - 1][1] > e[0]) or (i < len(kept) and starts[i] < e[1]):
            continue
        starts.insert(i, e[0])
        kept.insert(i, e)
    return kept


def _key(kind: str, s: str) -> str:
    """One key for all spellings of an entity: a name's parts sorted, digits without signs."""
    low = s.lower()
    if kind == "name":
        return " ".join(sorted(w for w in re.split(r"[ ,]+", low) if not w.endswith(".")) or [low])
    if kind in ("phone", "identity"):
        return re.sub(r"[^0-9a-z]", "", low)
    if kind == "email":
        return re.sub(r"\s?[(\[{<]?\bdot\b[)\]}>]?\s?", ".", re.sub(r"\s?[(\[{<]at[)\]}>]\s?|\s+at\s+", "@", low))
    return low


_CONSONANTS, _VOWELS, _CODAS = "bdfghjklmnprstvw", "aeiou", "lmnrst"
# Given names of other scripts from which surrogates are drawn, and letters for their family names.
_SCRIPT_POOLS = {
    "cyrillic": ("Алексей Анна Борис Вера Галина Дмитрий Елена Иван Ирина Кирилл Лев Мария Никита Ольга Павел Юлия".split(), [c + v for c in "бвгдзклмнпрст" for v in "аеиоу"], "ов"),
    "greek": ("Άννα Γιώργος Ελένη Κώστας Μαρία Νίκος Πέτρος Σοφία".split(), [c + v for c in "βγδζθκλμνπρστφ" for v in "αεηιο"], "ίδης"),
    "han": ([""], [chr(0x4E00 + 37 * i) for i in range(256)], ""),
    "kana": ([""], [chr(0x30AB + i) for i in range(0, 62)], ""),
    "hangul": ([""], [chr(0xAC00 + 28 * i) for i in range(256)], ""),
    "arabic": (["أحمد", "سارة", "كريم", "ليلى"], [chr(c) for c in (*range(0x628, 0x63B), *range(0x641, 0x649))], ""),
    "devanagari": (["अजय", "मीना", "रवि", "सीता"], [chr(c) for c in range(0x915, 0x939)], ""),
}
_SCRIPT_OF = (("cyrillic", "А", "я"), ("greek", "Α", "ώ"), ("arabic", "ء", "ي"), ("devanagari", "ऀ", "ॿ"), ("kana", "ぁ", "ヺ"), ("hangul", "가", "힣"), ("han", "一", "鿿"))


def _script(s: str) -> str:
    for name, lo, hi in _SCRIPT_OF:
        if any(lo <= c <= hi for c in s):
            return name
    return "latin"


class Surrogates:
    """Keyed, type-consistent replacements: a function of the entity alone, the same in every text."""

    def __init__(self, secret: bytes):
        if not secret:
            raise ValueError("surrogates need a secret key")
        self.secret = hashlib.sha256(secret).digest()
        self.female, self.male = sorted(g for g in FEMALE if g.isascii()), sorted(g for g in MALE if g.isascii())

    def _number(self, *what: str) -> int:
        return int.from_bytes(hmac.new(self.secret, "\0".join(what).encode(), hashlib.sha256).digest()[:20], "big")

    def permute(self, x: int, size: int, tweak: str) -> int:
        """A keyed permutation of ``range(size)``: Feistel rounds on the next even number of bits, walked back into range."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            a, b = x >> half, x & mask
            for r in range(6):
                mix = hashlib.blake2b(f"{r}|{tweak}|{size}|{b}".encode(), key=self.secret, digest_size=16).digest()
                a, b = b, a ^ (int.from_bytes(mix, "big") & mask)
            x = a << half | b
            if x < size:
                return x

    def _syllables(self, n: int, many: int) -> tuple[str, int]:
        out = []
        for _ in range(many):
            n, c = divmod(n, len(_CONSONANTS))
            n, v = divmod(n, len(_VOWELS))
            n, e = divmod(n, len(_CODAS))
            out.append(_CONSONANTS[c] + _VOWELS[v] + _CODAS[e])
        return "".join(out), n

    def _name(self, s: str, key: str) -> str:
        n, script = self._number("name", key), _script(s)
        if script != "latin":
            pool, letters, end = _SCRIPT_POOLS[script]
            n, g = divmod(n, len(pool))
            family = []
            while len(family) < 12 and len(letters) ** len(family) < 1 << 58:
                n, c = divmod(n, len(letters))
                family.append(letters[c])
            return f"{pool[g]} {''.join(family).capitalize()}{end}".strip()
        words = re.split(r"[ ,]+", s)
        given = next((w for w in words if _known(w)), "")
        pool = self.female if given.lower() in FEMALE else self.male if given else sorted({*self.female, *self.male})
        n, g = divmod(n, len(pool))
        first, n = self._syllables(n, 3)
        second, n = self._syllables(n, 4)
        family = f"{first.capitalize()}-{second.capitalize()}"
        if not given and any(re.fullmatch(rf"[{_U}]\.", w) for w in words):
            lead = chr(65 + n % 26) + "."
        else:
            lead = pool[g].capitalize()
        return f"{family}, {lead}" if "," in s else f"{lead} {family}"

    def _digits(self, kind: str, s: str, keep: int) -> str:
        """Letters and digits after the first ``keep`` permuted within their classes, signs left as they are."""
        places = [i for i, c in enumerate(s) if c.isascii() and c.isalnum()][keep:]
        radix = [10 if s[i].isdigit() else 26 for i in places]
        x, size = 0, 1
        for i, r in zip(places, radix, strict=True):
            x = x * r + (int(s[i]) if r == 10 else ord(s[i].lower()) - 97)
            size *= r
        if size < 2:
            return s
        fixed = "".join(c for c in s[: places[0]] if c.isalnum()).lower()
        x = self.permute(x, size, f"{kind}|{fixed}|{''.join('d' if r == 10 else 'a' for r in radix)}")
        out = list(s)
        for i, r in zip(reversed(places), reversed(radix), strict=True):
            x, d = divmod(x, r)
            out[i] = str(d) if r == 10 else chr((65 if s[i].isupper() else 97) + d)
        return "".join(out)

    def _address(self, s: str, key: str) -> str:
        n, done = self._number("address", key), False

        def street(m: re.Match) -> str:
            nonlocal done
            if done or m.group().lower() in _STREET_WORDS:
                return m.group() if m.group().lower() in _STREET_WORDS else ""
            done = True
            return self._syllables(n, 7)[0].capitalize()

        out = re.sub(rf"[{_U}][{_L}-]{{2,}}?(?=stra(?:ß|ss)e|str\.|weg|allee|gasse|platz|ring|ufer|damm|chaussee|[ ,.]|$)", street, s)
        return re.sub(r"\d+", lambda m: str(1 + (n >> 70) % (10 ** min(4, len(m.group())) - 1)), re.sub(r"  +", " ", out))

    def make(self, kind: str, s: str) -> str:
        key = _key(kind, s)
        if kind == "name":
            return self._name(s, key)
        if kind == "email":
            user = f"u{self._number('email', key) & ((1 << 64) - 1):016x}"
            return f"{user}@mail.example" if "@" in s else f"{user} (at) mail.example"
        if kind == "phone":
            return self._digits(kind, s, len(_DIGITS.sub("", re.match(r"\+\d{1,2}|00\d{1,2}|\(?0|", s).group())))
        if kind == "address":
            return self._address(s, key)
        return self._digits(kind, s, 0)

    def replace(self, text: str | None) -> tuple[str | None, int]:
        """The text with every entity replaced, and their number."""
        found = entities(text)
        if not found:
            return text, 0
        out, last = [], 0
        for a, b, kind in found:
            out += [text[last:a], self.make(kind, text[a:b])]
            last = b
        return "".join(out) + text[last:], len(found)


_STREET_WORDS = frozenset(
    "street road lane avenue drive court boulevard place close square terrace crescent parkway highway hill gardens mews calle avenida plaza paseo viale piazza travessa straße strasse allee platz".split()
)


def placeholders(text: str | None) -> str | None:
    """The text with typed placeholders, numbered per kind; one entity has one number in a text."""
    found = entities(text)
    if not found:
        return text
    ids: dict[tuple[str, str], int] = {}
    count: dict[str, int] = {}
    out, last = [], 0
    for a, b, kind in found:
        k = (kind, _key(kind, text[a:b]))
        if k not in ids:
            ids[k] = count[kind] = count.get(kind, 0) + 1
        out += [text[last:a], f"[{kind.upper()}_{ids[k]}]"]
        last = b
    return "".join(out) + text[last:]


_FOUND = "array<struct<kind: string, start: int, stop: int, line_no: int>>"


def find_personal(documents: DataFrame) -> DataFrame:
    """``doc_id, kind, start, stop, line_no`` of every entity."""

    @F.pandas_udf(_FOUND)
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([[(k, a, b, 1 + t.count("\n", 0, a)) for a, b, k in entities(t)] for t in texts], dtype=object)

    return documents.select("doc_id", F.explode(scan("text")).alias("e")).select("doc_id", "e.*")


def personal_lines(documents: DataFrame) -> DataFrame:
    """``doc_id, kind, line_no``: each line with at least one entity of the kind."""
    return find_personal(documents).select("doc_id", "kind", "line_no").distinct()


def replace_personal(documents: DataFrame, secret: str) -> DataFrame:
    """``doc_id, replaced_text, placeholder_text, n_entities`` of every document; ``secret`` keys the surrogates."""

    @F.pandas_udf("replaced_text string, placeholder_text string, n_entities int")
    def swap(texts: pd.Series) -> pd.DataFrame:
        s = Surrogates(secret.encode())
        rows = []
        for t in texts:
            new, n = s.replace(t)
            rows.append((new, placeholders(t) if n else t, n))
        return pd.DataFrame(rows, columns=["replaced_text", "placeholder_text", "n_entities"])

    return documents.select("doc_id", swap("text").alias("r")).select("doc_id", "r.*")


def surrogate_report(documents: DataFrame, secret: str) -> DataFrame:
    """``kind, entities, surrogates``: how many different entities the corpus has, and how many different surrogates they get."""

    @F.pandas_udf("array<struct<kind: string, entity: long, surrogate: long>>")
    def scan(texts: pd.Series) -> pd.Series:
        s = Surrogates(secret.encode())
        h = lambda x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big", signed=True)
        rows = []
        for t in texts:
            found = {(k, _key(k, t[a:b])): t[a:b] for a, b, k in entities(t)}
            rows.append([(k, h(key), h(_key(k, s.make(k, one)))) for (k, key), one in found.items()])
        return pd.Series(rows, dtype=object)

    each = documents.select(F.explode(scan("text")).alias("e")).select("e.*").distinct()
    return each.groupBy("kind").agg(F.count_distinct("entity").alias("entities"), F.count_distinct("surrogate").alias("surrogates"))
