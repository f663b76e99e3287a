"""Personal information in free text: proposed by patterns, confirmed by validators, weighed by context.

Each kind has patterns that propose spans with a base score. Validators decide
where a number has a check: bank cards (Luhn) and international account numbers
(mod 97) are found only where it holds; a national number that passes needs no
label, one that fails needs a label before it, as invented, masked and mistyped
numbers are personal too where the text calls them so. Context words before and
after a span raise or lower the score, and spans that reach THRESHOLD are kept. Of
overlapping spans the one with the higher score wins, then the longer, then the
earlier.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

THRESHOLD = 2.0
KINDS = ("email", "phone", "id_number", "address", "name")
#: Kinds that are replaced too, but that no query lists.
MONEY_KINDS = ("card", "account")

# Character classes and words of the patterns.
UP = "A-ZÀ-ÖØ-ÞĄĆĘŁŃŚŹŻČĎĚŇŘŠŤŮŽ"
AT = r"(?:\s?@\s?|\s?[(\[{<]\s?(?:at|AT|At)\s?[)\]}>]\s?|\s?(?:&#0*64;|&#[xX]40;|&commat;|%40|\\u0040)\s?)"
DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|DOT|Dot|punt|punkt|point|punto)\s?[)\]}]\s?|\s(?:DOT|dot)\s|&#0*46;|&period;|%2[eE])"
LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
LOCAL = r"[A-Za-z0-9À-ž_](?:[A-Za-z0-9À-ž_.+%'-]*[A-Za-z0-9À-ž_+-])?"
STREETS_AFTER = (
    "Street|St|Road|Rd|Lane|Ln|Close|Drive|Dr|Avenue|Ave|Row|Square|Sq|Terrace|Court|Ct|Place|Crescent|Gardens|Grove|Hill|Mews|Boulevard|Blvd|Parade|Walk|Way"
)
STREETS_JOINED = "straat|laan|weg|plein|gracht|kade|steeg|singel|dijk|hof|straße|strasse|gasse|allee|platz|damm|ufer|ring|str\\."
STREETS_FR = "rue|avenue|impasse|allée|boulevard|place|chemin|quai|cours|passage|route|square|ruelle"
STREETS_ES = "Calle|Avenida|Plaza|Paseo|Camino|Ronda|Travesía|Avda\\.|C/|Rua|Travessa|Praça"
STREETS_PL = "ulica|ul\\.|aleja|al\\.|plac|pl\\.|osiedle|os\\."
PARTICLES = "van der|van den|van de|van|von der|von|zu|de la|de los|de las|de|del|der|den|du|di|da|dos|ten|ter|la|le"
PHONE_WORDS = (
    r"tel|tél|phone|telefoon|telefon|teléfono|téléphone|fax|mobile|mobiel|handy|hotline|call|bel|bereikbaar op|reach|rufen sie|erreichbar|appelez|joignable|llame|"
    r"localizable|dzwoni|pod numerem"
)
ID_WORDS = (
    r"SSN|National ID|passport|passeport|paspoort|reisepass|pasaporte|paszport|ausweis|personalausweis|insurance no|NI number|tax (?:id|no|number)|steuer-?id|steuernummer|"
    r"sozialversicherung\w*|BSN|burgerservicenummer|sécurité sociale|n° de sécurité|numéro de sécu\w*|DNI|NIE|NIF|PESEL|NIP|REGON|dowód|dowodu|id[- ]?number|persoonsnummer|social security|"
    r"identity (?:card|number)|identiteit\w*|identité|identidad|driving licen[cs]e|führerschein|rijbewijs"
)
#: A number that is only called one; what it numbers may stand before it.
NUMBER_WORDS = r"number|nummer|num[ée]ro|número|numer"
NOT_A_NUMBER = r"version|build|order|ratio|chapter|page|line|sku|price|tile|ticket|invoice|port|line|http/1\.[01]|retry-after|age"
#: Words before a name, with the score that they add.
NAME_BEFORE = {
    r"(?:Dear|Hello|Hi|Beste|Geachte (?:heer|mevrouw)|Chère|Cher|Estimad[oa]|Querid[oa]|Sehr geehrte[r]? (?:Frau|Herr)|Liebe[r]?|Szanown[ya] (?:Pani[e]?|Panie)|Droga|Drogi)": 2.5,
    r"(?:Mrs?\.?|Ms\.?|Dr\.|Prof\.|Mevrouw|Meneer|Mevr\.|Dhr\.|De heer|Herrn?|Frau|M\.|Mme|Mlle|Madame|Monsieur|Don|Doña|Señora?|Sra?\.|Pani|Pan|Pana)": 2.2,
    # to ask someone
    r"(?:Ask|Contact|Call|Vraag(?: het)?(?: aan)?|Bel met|Fragen Sie|Rufen Sie|Demandez à|Contactez|Pregunte a|Llame a|Zapytaj|Zapytajcie)": 2.2,
    # whose something is
    r"(?:(?:[Aa]ssigned to|[Oo]wner|[Pp]hoto|[Ff]oto|[Zz]ugewiesen an|[Aa]ssigné à|[Aa]signado a|[Tt]oegewezen aan|[Pp]rzypisano|[Zz]djęcie|[Bb]ild|[Aa]utor|[Aa]uthor|[Aa]uteur|[Cc]ontact|[Kk]ontakt|[Cc]ontacto|[Zz]głoszenie) ?:)": 2.2,
    r"(?:(?:[Oo]pened|[Ww]ritten|[Rr]eported|[Ss]igned|[Ss]ent) by)": 2.2,
    r"(?:(?:ticket|Ticket|case|message|report|bericht|melding|Meldung|Nachricht|billet|message|aviso|mensaje|zgłoszenie|wiadomość) (?:from|by|is van|van|stammt von|von|vient de|es de|od))": 2.2,
    r"(?:[\"']?(?:name|label|full_name|sender|author|contact|user|owner)[\"']?\s?[:=]\s?[\"'])": 2.0,
    r"(?:<td>|<b>|<strong>)": 1.0,
}
NAME_AFTER = {
    # what people do
    r" (?:(?:wrote|said|asked|approved|signed|replied|reviewed|confirmed|answered|will call)\b|(?:schreef|zei|vroeg|keurde|tekende|antwoordde)\b|(?:verfasste|schrieb|sagte|unterschrieb|antwortete)\b|"
    r"hat (?:es|das|den|die|ihn|sie) (?:genehmigt|freigegeben|geschrieben|gesagt|unterschrieben)|a (?:écrit|validé|signé|répondu|approuvé|dit)\b|(?:lo |la )?(?:escribió|aprobó|firmó|respondió|dijo)\b|"
    r"(?:napisał|zatwierdził|podpisał|odpowiedział|powiedział)a?\b)": 2.2,
    r"(?:</td>|[\"'] ?[,}]|[\"'] email=)": 1.2,
}
#: Words that begin a sentence or a heading, in capitals, and no name.
NEVER_NAMES = "The|This|That|Regards|Some|Title|Visit|Address|Adres|Adresse|Anschrift|Tel|Fax|Our|Every|No|If|It|We|What|With"

#: What stands for @, and the domain behind it; the local part is read backwards from there.
_SIGN = re.compile(r"@|[(\[{<]\s?(?:at|AT|At)\s?[)\]}>]|&#0*64;|&#[xX]40;|&commat;|%40|\\u0040|(?<=\s)(?:AT|at)(?=\s)")
_DOMAIN = re.compile(rf"\s?({LABEL}(?:{DOT}{LABEL})*{DOT}[A-Za-z][A-Za-z-]*[A-Za-z])(?![\w@])")
_SPELLED_DOMAIN = re.compile(rf"\s({LABEL}(?:\s(?:DOT|dot)\s{LABEL})+)(?![\w@])")
_LOCAL = re.compile(rf"(?<![\w.+%-]){LOCAL}\Z")
_LOCAL_CHARS = re.compile(r"[A-Za-z0-9À-ž_.+%'-]*\Z")
_STREET_WORD = rf"[{UP}][\w'’-]*"
_ADDITION = r"(?:[ \xa0]m\.[ \xa0]?\d{1,4}|[a-zA-Z](?!\w)|[ \xa0][a-dA-D](?!\w)(?!\.[ \xa0]?\d)|[ \xa0]?bis\b|[ \xa0]?ter\b|-\d{1,3}[a-z]?\b|/\d{1,4}[a-z]?\b)?"
_ADDRESSES = [
    (re.compile(rf"(?<![\w./:-])\d{{1,5}}[A-Za-z]?(?:[-/]\d{{1,4}})?[ \xa0](?!The\b)(?:[{UP}][\w'’-]*[ \xa0]){{1,4}}(?:{STREETS_AFTER})\b"), 2.5),
    (re.compile(rf"(?<![\w./:-])(?:[{UP}][\w'’-]*[ \xa0])?[{UP}][\w'’-]*(?:{STREETS_JOINED})[ \xa0]\d{{1,5}}{_ADDITION}(?!\d)"), 2.5),
    (re.compile(rf"(?<![\w./:-])(?:[{UP}][\w'’-]*(?:er|e|ische|en)[ \xa0])(?:Straße|Strasse|Str\.|Weg|Allee|Platz|Gasse|Ufer|Damm)[ \xa0]\d{{1,5}}{_ADDITION}(?!\d)"), 2.5),
    (re.compile(rf"(?<![\w./:-])(?:An der|Am|Auf dem|Auf der|Im|Zum|Zur|Unter den)[ \xa0](?:[{UP}][\w'’-]*[ \xa0]){{1,3}}\d{{1,5}}{_ADDITION}(?!\d)"), 2.1),
    (re.compile(rf"(?<![\w./:-])\d{{1,5}}(?:[ \xa0]?(?:bis|ter|quater)|[ \xa0]?[A-Za-z](?=[\s,]))?,?[ \xa0](?:{STREETS_FR})[ \xa0](?:(?:de la|de l['’]|des|du|de|d['’]|la|le|les)[ \xa0]?)?[{UP}][\w'’-]*(?:[ \xa0][{UP}][\w'’-]*)*"), 2.5),
    (re.compile(rf"(?<![\w./:-])(?:{STREETS_ES})[ \xa0](?:(?:de la|de los|de las|del|de|da|do|dos|das)[ \xa0])?[{UP}][\w'’-]*(?:[ \xa0](?:(?:de la|de los|del|de)[ \xa0])?[{UP}][\w'’-]*)*,?[ \xa0](?:n\.?[º°][ \xa0]?|nº[ \xa0]?)?\d{{1,5}}{_ADDITION}(?!\d)"), 2.5),
    (re.compile(rf"(?<![\w./:-])(?:{STREETS_PL})[ \xa0][{UP}][\w'’-]*(?:[ \xa0][{UP}][\w'’-]*)*[ \xa0]\d{{1,5}}[a-zA-Z]?{_ADDITION}(?!\d)"), 2.5),
]
_EXTENSION = r"(?:\s?(?:ext\.?|extension|x|toestel|tst\.?|Durchwahl|poste|wew\.?)\s?\d{1,6})?"
_PHONE = re.compile(rf"(?<![\w.,:/@#=-])(?:\+\d{{1,3}}|\(\+\d{{1,3}}\)|00\d{{2}}(?=[\s/(.-])|(?=[(0-9]))(?:[ ./-]?(?:\(\d{{1,4}}\)|\d{{1,9}})){{1,8}}{_EXTENSION}(?![\w@]|[./,:-]\d)")
#: Upper-case letters and digits with single signs between, in which all shapes lie.
_CODED = re.compile(r"[A-Z0-9](?:[A-Z0-9]|[ .-](?=[A-Z0-9])){6,}")
_ID_SHAPES = [
    (re.compile(r"(?<![\w-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w-])"), 2.0),
    (re.compile(r"(?<![\w-])[XYZ]-?\d{7}-?[A-Z](?![\w-])"), 1.4),
    (re.compile(r"(?<![\w-])\d{8}-?[A-Z](?![\w-])"), 1.4),
    (re.compile(r"(?<![\w-])[A-Z]{1,3} ?\d{6,9}(?![\w-])"), 0.9),
    (re.compile(r"(?<![\w-])[A-Z]\d{2}[A-Z]\d{5}(?![\w-])"), 1.2),
    (re.compile(r"(?<![\w-])[CFGHJKLMNPRTVWXYZ][0-9CFGHJKLMNPRTVWXYZ]{7,9}(?![\w-])(?<=\d)"), 0.9),
    (re.compile(r"(?<![\w-])[1-478] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}(?![\w-])"), 1.2),
    (re.compile(r"(?<![\w-])\d{3}[- ]\d{2}[- ]\d{4}(?![\w-])"), 1.0),
    (re.compile(r"(?<![\w.-])\d{2,4}(?:[ .]\d{2,3}){2,4}(?![\w-])"), 0.2),
    (re.compile(r"(?<![\w.-])\d{8,15}(?![\w-])"), 0.2),
]
#: Account numbers and bank cards: only those that pass their check.
_ACCOUNT = re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w-])")
_CARD = re.compile(r"(?<![\w.-])(?:(?:4\d|5[1-5]|2[2-7]|6\d)\d{2}(?:[ -]?\d{4}){3}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\w-])")
_INITIAL = rf"(?:[{UP}]\.(?:\s?-?[{UP}]\.)*)"
_NAME_WORD = rf"(?:[{UP}][{UP}a-zà-öø-ÿąćęłńóśźżčďěňřšťůž'’]+(?:-[{UP}][{UP}a-zà-öø-ÿąćęłńóśźżčďěňřšťůž'’]*)*)"
_SURNAME = rf"(?:(?:(?:{PARTICLES}|{PARTICLES.upper()})\s|[dD]['’])?{_NAME_WORD})"
_GAP = r"[  ]"
_NAME = re.compile(
    rf"(?<![\w@.+-])(?:{_SURNAME},{_GAP}(?:{_NAME_WORD}|{_INITIAL})(?:{_GAP}{_INITIAL})?|"
    rf"(?:{_NAME_WORD}|{_INITIAL})(?:{_GAP}{_INITIAL})?(?:{_GAP}{_NAME_WORD}(?={_GAP}{_SURNAME}))?{_GAP}{_SURNAME}(?:{_GAP}{_SURNAME})?)(?![\w@])"
)
_BEFORE = [(re.compile(rf"(?:(?<![\w])|(?<=\s)){p}\s?$"), s) for p, s in NAME_BEFORE.items()]
_AFTER = [(re.compile(p), s) for p, s in NAME_AFTER.items()]
_LINE_START = re.compile(r"(?:^|\n|<br>|\| ?|--\r?\n|[.!?;:—]\s)\s*$")
_NEXT_LINE = re.compile(r" ?(?:\r?\n|<br>|\| ?)")
_LINE_END = re.compile(r"\s*(?:\r?\n|<br>|\||$)")
_PHONE_BEFORE = re.compile(rf"(?:{PHONE_WORDS})[^\n]{{0,14}}$", re.I)
_ID_BEFORE = re.compile(rf"(?:{ID_WORDS})(?: (?:no|nr|n°|number|nummer|num[ée]ro|número|numer)\.?)?(?: (?:is|was|ist|lautet|est|es|jest|to))?[^\w\n]{{0,6}}$", re.I)
_NUMBER_BEFORE = re.compile(rf"(?<!\w)(\w*)[^\w\n]{{0,3}}(?:{NUMBER_WORDS})[^\w\n]{{0,4}}$", re.I)
_NOT_BEFORE = re.compile(rf"\b(?:{NOT_A_NUMBER})[^\w\n]{{0,3}}$", re.I)
_NEVER = re.compile(rf"(?:{NEVER_NAMES})\b")
_DIGIT = re.compile(r"\d")
_DIGITS = re.compile(r"\D")
_SPACE = re.compile(r"\s")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(digits: str) -> bool:
    """The French key: the last two digits are 97 less the rest modulo 97."""
    return len(digits) == 15 and 97 - int(digits[:13]) % 97 == int(digits[13:])


def _weighted(digits: str, weights: tuple[int, ...], modulus: int) -> bool:
    return len(digits) == len(weights) and sum(int(a) * b for a, b in zip(digits, weights)) % modulus == 0


def spanish(text: str) -> bool:
    """The control letter of a Spanish number: a fixed letter for the number modulo 23."""
    bare = re.sub(r"[^0-9A-Z]", "", text)
    if not re.fullmatch(r"[XYZ]?\d{7,8}[A-Z]", bare):
        return False
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(bare[:-1].translate(str.maketrans("XYZ", "012"))) % 23] == bare[-1]


def iban(text: str) -> bool:
    """An international account number: the rest modulo 97 is 1 with its first four signs behind, letters as numbers from 10."""
    bare = re.sub(r"[^0-9A-Z]", "", text)
    return 15 <= len(bare) <= 34 and bare[:2].isalpha() and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def german(digits: str) -> bool:
    """The check digit of a German tax id, by the iterated modulus 11 and 10; one of its digits repeats."""
    if len(digits) != 11 or digits[0] == "0" or len(set(digits[:10])) > 9:
        return False
    product = 10
    for c in digits[:10]:
        total = (int(c) + product) % 10 or 10
        product = total * 2 % 11
    return (11 - product) % 10 == int(digits[10])


def polish(digits: str) -> bool:
    """A Polish number: a weighted sum, and a birth date whose month tells the century."""
    return _weighted(digits, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1), 10) and 1 <= int(digits[2:4]) % 20 <= 12 and 1 <= int(digits[4:6]) <= 31


def dutch(digits: str) -> bool:
    return digits[:1] != "0" and _weighted(digits, (9, 8, 7, 6, 5, 4, 3, 2, -1), 11)


#: Validators of national numbers: what has their form, the check, and what a pass adds; a check that chance passes more often adds less.
NATIONAL = [
    (re.compile(r"[XYZ]?-?\d{7,8}-?[A-Z]"), lambda t, d: spanish(t), 1.8),
    (re.compile(r"[1-478](?: ?\d){14}"), lambda t, d: mod97(d), 2.2),
    (re.compile(r"\d{11}"), lambda t, d: polish(d), 2.0),
    (re.compile(r"\d{2}(?:[ .]\d{3}){3}|\d{11}"), lambda t, d: german(d), 1.9),
    (re.compile(r"\d{4}[ .]\d{2}[ .]\d{3}|\d{9}"), lambda t, d: dutch(d), 1.2),
]


def national_score(text: str) -> float:
    """What the checks of the national schemes that a number has the form of add: most of those it passes, a loss where it passes none, 0 where no scheme has a check."""
    digits = _DIGITS.sub("", text)
    formed = [(check, gain) for form, check, gain in NATIONAL if form.fullmatch(text)]
    passed = [gain for check, gain in formed if check(text, digits)]
    return max(passed) if passed else -1.0 if formed else 0.0


def _phone_score(text: str, start: int, end: int) -> float:
    found = text[start:end]
    digits = _DIGITS.sub("", re.split(r"(?i)ext|x|toestel|tst|durchwahl|poste|wew", found)[0])
    if not 8 <= len(digits) <= 15:
        return 0.0
    if _NOT_BEFORE.search(text[max(0, start - 16) : start]) or re.fullmatch(r"\d{4}-\d{2}-\d{2}.*", found):
        return 0.0
    score = 1.0
    if found.startswith(("+", "(+", "00")):
        score += 1.2 if not found.startswith("00") or re.match(r"00[1-9]\d", found) else 0.0
    groups = re.findall(r"\d+", found)
    if re.search(r"\(\d{2,4}\)", found):
        score += 1.0
    if re.match(r"0\d{1,4}[ ./-]\d{2,4}", found) or re.fullmatch(r"0\d{8,10}", found):
        score += 1.0
    if re.fullmatch(r"\d{3}([ .-])\d{3}\1\d{4}.*", found):
        score += 1.2
    if re.fullmatch(r"\d{3} \d{2} \d{2} \d{2}|\d{2} \d{3}[- ]\d{2}[- ]\d{2}|\d{3} \d{3} \d{3}|0\d(?:[ .]\d{2}){4}", found):
        score += 1.2
    if _PHONE_BEFORE.search(text[max(0, start - 34) : start]):
        score += 1.2
    if len(groups) == 1 and not found.startswith(("+", "0")):
        score -= 1.0
    if _labelled(text, start):
        score -= 2.0
    return score


def _labelled(text: str, start: int) -> float:
    """What the words before a number add."""
    before = text[max(0, start - 40) : start]
    if _ID_BEFORE.search(before):
        return 2.4
    called = _NUMBER_BEFORE.search(before)
    return 2.1 if called and not re.fullmatch(NOT_A_NUMBER, called[1], re.I) else 0.0


def _id_score(text: str, start: int, end: int, base: float) -> float:
    found = text[start:end]
    if not any(c.isdigit() for c in found):
        return 0.0
    label, check = _labelled(text, start), national_score(found)
    score = base + label + (max(check, 0.0) if label else check)
    if _NOT_BEFORE.search(text[max(0, start - 16) : start]) or text[max(0, start - 4) : start].endswith(("/", "=", "sku")):
        score -= 2.0
    return score


def _coded(text: str) -> list[tuple[float, int, int, str]]:
    """Identity numbers, cards and accounts among the runs of letters and digits; a run is read with the character on either side."""
    spans = []
    for run in _CODED.finditer(text):
        if sum(map(str.isdigit, run[0])) < 5:
            continue
        at = max(0, run.start() - 1)
        part = text[at : run.end() + 1]
        for pattern, base in _ID_SHAPES:
            for m in pattern.finditer(part):
                if (score := _id_score(text, at + m.start(), at + m.end(), base)) >= THRESHOLD:
                    spans.append((score, at + m.start(), at + m.end(), "id_number"))
        for pattern, check, kind in ((_ACCOUNT, iban, "account"), (_CARD, lambda t: luhn(_DIGITS.sub("", t)), "card")):
            for m in pattern.finditer(part):
                if check(m[0]) and not _labelled(text, at + m.start()):
                    spans.append((5.0, at + m.start(), at + m.end(), kind))
    return spans


def _emails(text: str) -> list[tuple[float, int, int, str]]:
    spans, done = [], 0
    for sign in _SIGN.finditer(text):
        word = sign[0] in ("at", "AT")
        domain = (_SPELLED_DOMAIN if word else _DOMAIN).match(text, sign.end())
        if not domain:
            continue
        end = sign.start() - (sign.start() > 0 and text[sign.start() - 1].isspace())
        start = end
        while start > done:  # a longer piece where the local part fills it
            cut = max(done, start - 64)
            chars = _LOCAL_CHARS.search(text, cut, end)
            start = chars.start()
            if start > cut:
                break
        while start < end and (text[start] in ".+%'-" or start and (text[start - 1] in ".+%-_" or text[start - 1].isalnum())):
            start += 1
        local = _LOCAL.search(text[max(0, start - 1) : end], min(start, 1))
        if local and local.end() > local.start():
            spans.append((6.0, max(0, start - 1) + local.start(), domain.end(1), "email"))
            done = domain.end(1)
    return spans


def _name_score(text: str, start: int, end: int, given: frozenset[str], anchors: list[tuple[int, int, str]]) -> float:
    found = text[start:end]
    if _NEVER.match(found):
        return 0.0
    words = re.split(r"[\s,]+", found)
    if any(len(w) > 3 and len(set(w.lower())) == 1 for w in words):  # a letter that is held down
        return 0.0
    known = any(w.lower() in given for w in words[:1] + words[-1:] + words[1:2])
    score = 1.3 if known else 0.0
    before, after = text[max(0, start - 30) : start], text[end : end + 26]
    score += max([s for p, s in _BEFORE if p.search(before)], default=0.0)
    score += max([s for p, s in _AFTER if p.match(after)], default=0.0)
    if any(re.fullmatch(_INITIAL, w) for w in words):
        score += 0.6
    opens, closes = _LINE_START.search(before) or start == 0, _LINE_END.match(after)
    if opens and closes:
        if any(0 <= start - b <= 9 and kind == "address" and _NEXT_LINE.fullmatch(text, b, start) for _, b, kind in anchors):
            return 0.0  # the line below a street is a town
        near = any(0 <= a - end <= 9 for a, _, _ in anchors) or any(0 <= start - b <= 9 for _, b, _ in anchors)
        score += 2.0 if near else 0.7
        if re.search(r"(?:Regards|regards|groet(?:en)?|Grüße[n]?|Cordialement|Saludos|Pozdrawiam|--),?\s*$", before):
            score += 1.0
    elif opens or closes:
        score += 0.3
    return score


def find_items(text: str, given: frozenset[str]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the items of a text, in order, without overlaps."""
    spans = _emails(text)
    at = 0
    for line in text.splitlines(keepends=True):
        if _DIGIT.search(line):  # no street goes over a line's end
            for pattern, score in _ADDRESSES:
                spans += [(score + 1, at + m.start(), at + m.end(), "address") for m in pattern.finditer(line)]
        at += len(line)
    if _DIGIT.search(text):
        for m in _PHONE.finditer(text):
            if (score := _phone_score(text, m.start(), m.end())) >= THRESHOLD:
                spans.append((score, m.start(), m.end(), "phone"))
        spans += _coded(text)
    anchors = sorted((s, e, kind) for _, s, e, kind in spans)
    at = 0
    while m := _NAME.search(text, at):
        start, end = m.span()
        best = (0.0, start, end)
        for s, e in _variants(text, start, end):
            score = _name_score(text, s, e, given, anchors)
            if score > best[0]:
                best = (score, s, e)
        if best[0] >= THRESHOLD:
            spans.append((best[0], best[1], best[2], "name"))
            at = best[2]
        else:
            space = _SPACE.search(text, start + 1)
            at = space.end() if space else end
    return _apart(spans)


def _variants(text: str, start: int, end: int) -> Iterable[tuple[int, int]]:
    """A proposed name and its shorter forms without leading words, such as a title or a verb."""
    yield start, end
    found = text[start:end]
    for m in re.finditer(r"[  ]", found):
        rest = found[m.end() :]
        if _NAME.fullmatch(rest) or _NAME.match(text, start + m.end()) and _NAME.match(text, start + m.end()).end() >= end:
            yield start + m.end(), max(end, _NAME.match(text, start + m.end()).end())


def _apart(spans: list[tuple[float, int, int, str]]) -> list[tuple[int, int, str]]:
    kept: list[tuple[int, int, str]] = []
    for _, start, end, kind in sorted(spans, key=lambda x: (-x[0], x[1] - x[2], x[1])):
        if all(end <= s or start >= e for s, e, _ in kept):
            kept.append((start, end, kind))
    return sorted(kept)


def redact(text: str, given: frozenset[str]) -> str:
    """The text with each item replaced by a placeholder of its kind, such as [EMAIL]."""
    parts, at = [], 0
    for start, end, kind in find_items(text, given):
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*parts, text[at:]])


#: Given names that the table may hold; a longer table is refused, as it goes to every task.
MOST_GIVEN_NAMES = 100_000


def given_name_set(given_names: DataFrame) -> frozenset[str]:
    rows = given_names.select("given_name").where("given_name is not null").distinct().limit(MOST_GIVEN_NAMES + 1).collect()
    if len(rows) > MOST_GIVEN_NAMES:
        raise ValueError(f"given_names holds more than {MOST_GIVEN_NAMES} names")
    return frozenset(r["given_name"].lower() for r in rows)


def items(documents: DataFrame, given_names: DataFrame) -> DataFrame:
    """(doc_id, kind, value): one row for each distinct item of KINDS in a document, as it stands in the text.

    Null and empty texts have no item. A doc_id that repeats gives its rows each time.
    """
    given = given_name_set(given_names)

    def run(batches):
        for batch in batches:
            ids, kinds, values = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t:
                    for kind, value in sorted({(k, t[s:e]) for s, e, k in find_items(t, given) if k in KINDS}):
                        ids.append(i)
                        kinds.append(kind)
                        values.append(value)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["doc_id", "kind", "value"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, kind string, value string")


def redacted(documents: DataFrame, given_names: DataFrame) -> DataFrame:
    """(doc_id, text): each document with typed placeholders for its items; null stays null, empty stays empty."""
    given = given_name_set(given_names)

    def run(batches):
        for batch in batches:
            texts = [redact(t, given) if t else t for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, text string")
