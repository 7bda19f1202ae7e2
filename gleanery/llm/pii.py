"""Personal information in free text, found on a normalised text and mapped back to the source characters.

Small transducers rewrite disguises and remember where each character came from: decomposed letters are composed,
look-alike letters of other scripts next to Latin ones become Latin, zero-width characters vanish, odd spaces and
dashes become plain, spelled digits become digits, and at/dot disguises of addresses become ``@`` and ``.``. The
identifiers are detected on the result; the spans are then mapped back to source offsets.

Names need lexica. Given names start from a table of known ones; one aggregation over the runs of capitalised words
of the whole corpus learns family names (words after given names) and further given names (words before family
names). The learned sets are broadcast only below a checked size.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.session import cut

#: Names up to which the lexica are broadcast to the workers (about 100 bytes each).
BROADCAST_NAMES = 1_000_000

# ---------------------------------------------------------------- transducers

#: Look-alikes of Latin letters (fixed values: Cyrillic and Greek small and capital letters of the same shape).
_LOOK_ALIKE = str.maketrans("аеорсухіјѕԁһӏАВЕКМНОРСТХІЈЅоαονρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlABEKMHOPCTXIJSoaovptuxABEZHIKMNOPTYX")
_PLAIN = {0xA0: " ", 0x2007: " ", 0x2009: " ", 0x202F: " ", 0x3000: " ", 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0x2212: "-", 0xFF20: "@", 0xFE6B: "@", 0xFF0E: ".", 0x3002: ".", 0xFF0B: "+"}
_PLAIN |= {0xFF10 + i: str(i) for i in range(10)} | {0xFF21 + i: chr(65 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_FOREIGN_NEXT = re.compile(r"[A-Za-z@.][Ѐ-ӿͰ-Ͽԁ]+|[Ѐ-ӿͰ-Ͽԁ]+(?=[A-Za-z@])")
_MARKS = re.compile(r"[^\W\d_][̀-ͯ]+")
_PLAIN_HINT = re.compile("[" + "".join(re.escape(chr(c)) for c in _PLAIN) + "]")
_LETTERS_HINT = re.compile("[Ѐ-ӿͰ-Ͽԁ]")
_MARKS_HINT = re.compile("[̀-ͯ]")
_ZERO = re.compile(r"[​-‍⁠﻿­]")
_OPEN, _CLOSE = r"\s?[\[({<]\s?", r"\s?[\])}>]\s?"
#: What disguised addresses say for @ and for the dot (fixed lists).
_AT_BRACKETED, _AT_BARE, _DOT_WORD = "(?:at|arroba|ät|@)", "(?:at|arroba)", "(?:dot|punkt|punto|point)"
_DOTS = rf"{_OPEN}{_DOT_WORD}{_CLOSE}|\s{_DOT_WORD}\s"
_DISGUISED = re.compile(
    rf"(?P<local>[\w.+%-]+)(?:(?P<at>{_OPEN}{_AT_BRACKETED}{_CLOSE})(?P<a>[\w-]+(?:(?:{_DOTS}|\.)[\w-]+)+)"
    rf"|(?P<at2>\s{_AT_BARE}\s)(?P<b>[\w-]+(?:(?:{_DOTS})[\w-]+)+))",
    re.I,
)
#: Where a disguise can stand at all, by the same words: only such texts are searched for whole ones.
_AT_WORDS, _DOT_WORDS = frozenset("at arroba ät".split()), frozenset("dot punkt punto point".split())
#: On the case-folded text.
_BRACKETED, _BARE = re.compile(rf"[\[({{<]\s?{_AT_BRACKETED}\s?[\])}}>]"), re.compile(rf"\s{_AT_BARE}\s[\w-]+(?:{_DOTS})")
_LETTERS = re.compile(r"[^\W\d_]+")
_DOT = re.compile(_DOTS, re.I)
_DIGIT_WORDS = {w: str(i % 10) for i, ws in enumerate(("zero oh null cero zéro", "one eins uno un", "two zwei dos deux", "three drei tres trois", "four vier cuatro quatre", "five fünf cinco cinq", "six sechs seis", "seven sieben siete sept", "eight acht ocho huit", "nine neun nueve neuf")) for w in ws.split()}
_NUMBERS = frozenset(_DIGIT_WORDS)
_NUMBER_WORD = "(?:" + "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True)) + ")"
_SPELLED = re.compile(rf"\b{_NUMBER_WORD}(?:[\s-]+{_NUMBER_WORD}){{5,}}\b", re.I)


class Mapped:
    """A normalised text and the way back to the offsets of its source."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.sources = text, [0], [0]
        self.words: set[str] = set()
        self.spelled: list[tuple[int, int]] = []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
        """Applies edits ``(start, end, replacement)``, sorted and apart, to the present text; where they now stand."""
        if not edits:
            return []
        parts, starts, sources, at, done = [], [], [], 0, 0
        made = []

        def keep(upto: int) -> None:
            nonlocal done
            if upto > at:
                # the old segments within [at, upto) move by one shift
                k = bisect_right(self.starts, at) - 1
                while k < len(self.starts) and self.starts[k] < upto:
                    lo = max(at, self.starts[k])
                    starts.append(done + lo - at)
                    sources.append(self.sources[k] + lo - self.starts[k])
                    k += 1
                parts.append(self.text[at:upto])
                done += upto - at

        for start, end, new in edits:
            keep(start)
            made.append((done, done + len(new)))
            if new:
                starts.append(done)
                sources.append(self.source(start))
                for i in range(1, len(new)):
                    starts.append(done + i)
                    sources.append(self.source(min(start + i, end - 1)))
                parts.append(new)
                done += len(new)
            at = end
        keep(len(self.text))
        starts.append(done)
        sources.append(self.source(len(self.text)))
        self.text, self.starts, self.sources = "".join(parts), starts, sources
        return made

    def source_end(self, end: int) -> int:
        """Where the source of the characters before ``end`` ends."""
        last = self.source(end - 1)
        return max(last + 1, self.source(end)) if end - 1 in self.starts else last + 1

    def source(self, offset: int) -> int:
        k = bisect_right(self.starts, offset) - 1
        return self.sources[k] + offset - self.starts[k]


def normalise(text: str) -> Mapped:
    """The text without disguises, with its way back. Cheap searches decide which transducers have work."""
    m = Mapped(text)
    if not text.isascii():
        t = text.translate(_PLAIN) if _PLAIN_HINT.search(text) else text
        if _LETTERS_HINT.search(t):
            t = _FOREIGN_NEXT.sub(lambda x: x[0].translate(_LOOK_ALIKE), t)
        m.text = t  # one to one so far
        if _ZERO.search(t):
            m.rewrite([(x.start(), x.end(), "") for x in _ZERO.finditer(m.text)])
        if _MARKS_HINT.search(m.text):
            m.rewrite([(x.start(), x.end(), c) for x in _MARKS.finditer(m.text) if len(c := unicodedata.normalize("NFC", x[0])) < len(x[0])])
    lower = m.text.casefold()
    tokens = _LETTERS.findall(lower)
    m.words = set(tokens)
    at = not m.words.isdisjoint(_AT_WORDS)
    if (at and not m.words.isdisjoint(_DOT_WORDS) and _BARE.search(lower)) or ((at or "@" in lower) and _BRACKETED.search(lower)):
        edits = []
        for x in _DISGUISED.finditer(m.text):
            at, host = ("at", "a") if x["at"] else ("at2", "b")
            edits.append((*x.span(at), "@"))
            edits += [(x.start(host) + y.start(), x.start(host) + y.end(), ".") for y in _DOT.finditer(x[host])]
        m.rewrite(edits)
    if (numbers := m.words & _NUMBERS) and sum(map(tokens.count, numbers)) >= 6:
        m.spelled = m.rewrite([(x.start(), x.end(), "".join(_DIGIT_WORDS[w.casefold()] for w in re.split(r"[\s-]+", x[0]))) for x in _SPELLED.finditer(m.text)])
    return m


# ---------------------------------------------------------------- identifiers

_HOST = re.compile(r"(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}")
_LOCAL = frozenset(".+%-_")

_LABEL = (
    r"(?:SSN|[Ss]ocial [Ss]ecurity (?:[Nn]umber|no\.?)|NI (?:number|no\.?)|NINO|[Nn]ational [Ii]nsurance (?:[Nn]umber|no\.?)|[Pp]assport(?: (?:no\.?|[Nn]umber|nr\.?))?|[Tt]ax (?:ID|[Nn]umber|no\.?)"
    r"|(?:Reisepass|Personalausweis|Pass|Ausweis)(?:[ -]?(?:[Nn]r\.?|[Nn]ummer))?|Steuer-?(?:ID|Id|[Nn]ummer|Nr\.?)|Sozialversicherungsnummer|[Pp]asaporte(?: (?:n\.?º|n°|no\.?|núm\.?))?|DNI|NIE|NIF|[Nn]úmero de la [Ss]eguridad [Ss]ocial"
    r"|[Pp]asseport(?: (?:n°|nº|no\.?|numéro))?|[Cc]arte (?:nationale )?d[’']identité(?: (?:n°|nº|no\.?))?|NIR|(?:n°|[Nn]uméro) de [Ss]écurité [Ss]ociale)"
)
_ID_LABELLED = re.compile(rf"(?<!\w){_LABEL}\s?(?:[:#=]|is\b)?\s*(?P<v>(?=[A-Z]{{0,3}}[ -]?\d)[A-Z0-9](?:[A-Z0-9]|[ .-]{{1,2}}(?=[A-Z0-9](?![a-z])))*)")
_ID_BARE = re.compile(
    r"(?<![\w.+#/-])(?:\d{3}-\d{2}-\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{8}-?[A-Z]|\d{2}\.\d{3}\.\d{3}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|[1-37-8] \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}|[1-37-8]\d{14}|\d{2}[A-Z]{2}\d{5}|[A-Z]{3}\d{6}|[CFGHJKLMNPRTVWXYZ](?=[A-Z\d]*\d[A-Z\d]*\d[A-Z\d]*\d[A-Z\d]*\d)[0-9CFGHJKLMNPRTVWXYZ]{8})(?![\w/]|-\d|\.\d)"
)

_SEP = r"[ ./-]{1,3}"
_PHONE = re.compile(
    r"(?<![\w+@/#=.-])(?<!\d[ ,])(?:"
    # with a country code
    r"(?:\+|00)(?:1|33|34|44|49|[2-9]\d{1,2})[ ./-]{0,2}(?:\(0\)[ -]?|\(\d{2,4}\)[ -]?)?\d{1,5}(?:[ ./-]{0,3}\d{2,8}){1,5}"
    # with an area code in brackets
    rf"|\(0?\d{{2,4}}\)[ ./-]{{0,3}}\d{{3,8}}(?:{_SEP}\d{{2,5}}){{0,3}}"
    # of North America
    r"|(?:1[-.])?[2-9]\d{2}[-.][2-9]\d{2}[-.]\d{4}|555-\d{4}"
    # with a trunk zero
    rf"|0[1-9]\d{{0,4}}{_SEP}\d{{2,8}}(?:{_SEP}\d{{2,5}}){{0,4}}|0[1-9]\d{{8,10}}"
    # of Spain
    r"|[4-9]\d{2} \d{3} \d{3}|[4-9]\d{2}-\d{2}-\d{2}-\d{2}|[4-9]\d{2} \d{2} \d{2} \d{2}"
    r")(?![\w/]|[.-]\d| \d{3}\b)"
)
_PHONE_CUED = re.compile(r"(?:(?<!\w)(?:[Tt]el|TEL|[Tt]él|[Tt]elefon|[Tt]eléfono|[Tt]éléphone|[Pp]hone|[Mm]obile?|[Mm]óvil|[Hh]andy|[Ff]ax)(?:\.|:|=|\s)*|☎\s*)(?P<v>[+(]?\d[\d ()./-]{5,}\d)(?!\w)")
_NOT_PHONE = re.compile(r"(?:ISBN|doi|DOI|build|Batch|Seeds?:?|run_id=?|cursor|commit|ORD-|Ticket|Case|Route|v|#)[ \d.,:/-]*$")

#: Chains of at least five digits with little between them: only there can an unlabelled number or phone stand.
_CHAIN = re.compile(r"\d(?:[ ./()A-Z-]{0,3}\d){4,}")
_PHONE_HINTS = ("tel", "tél", "phone", "mobil", "móvil", "handy", "fax")
_LABEL_HINTS = ("ssn", "social", "ni n", "nino", "insurance", "pass", "pasaporte", "tax", "ausweis", "steuer", "sozial", "dni", "nie", "nif", "seguridad", "identité", "nir", "sécurité")


def _windows(t: str) -> list[tuple[int, int]]:
    """Stretches around the chains of digits, apart and in order."""
    out, last = [], 0
    for x in _CHAIN.finditer(t):
        a, b = max(last, x.start() - 8), min(len(t), x.end() + 8)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
        last = b
    return out


_CAP = r"[A-ZÀ-Þ][\w’'-]*"
_NUMBER_FIRST_FORM = (
    r"\d{1,5}(?:"
    # English: number with letter, compass point, names, kind of street
    rf"[a-z]? (?:[NSEW]\.? )?{_CAP}(?: {_CAP}){{0,2}} (?:Street|St|Road|Rd|Way|Lane|Ln|Court|Ct|Blvd|Boulevard|Avenue|Ave|Drive|Dr|Terrace|Ter|Square|Sq|Close|Place|Pl|Crescent|Gardens|Grove|Mews|Row|Walk|Parkway|Pkwy|Highway|Hwy)\b"
    # French: kind of street, then its name
    rf"|(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|av\.|bd|boulevard|chemin|impasse|place|allée|quai|cours|square|route|passage)(?: (?:des|du|de|d[’']|la|le|les|l[’']))* ?{_CAP}"
    r")(?!\w)"
)
_WORD_FIRST_FORM = (
    r"(?<![\w./-])(?:"
    # Spanish: kind of street before name and number
    rf"(?:C/|Calle|c/|Avda\.|Avenida|Av\.|Plaza|Pza\.|Paseo|P\.º|Camino|Ronda|Travesía|Carretera)(?: (?:de|del|la|las|los|el))* ?{_CAP}(?: {_CAP}){{0,2}},? (?:n\.?º ?|n° ?)?\d{{1,4}}"
    # German: compound street names and hyphened ones before the number, phrases with a preposition
    r"|[A-ZÄÖÜ][\w-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|[-](?:Platz|Straße|Weg|Allee|Ring|Str\.)) \d{1,4}[a-z]?"
    rf"|(?:Am|An der|An den|Auf dem|Auf der|Im|In der|In den|Zum|Zur|Unter den|Hinter der) {_CAP} \d{{1,4}}[a-z]?)(?!\w)"
)


def _spaced(form: str) -> re.Pattern:
    """Spaces in a form stand for any short white space, a line break included."""
    return re.compile(form.replace(" ?", r"\s{0,3}").replace(" ", r"\s{1,3}"))


_NUMBER_FIRST, _WORD_FIRST = _spaced(_NUMBER_FIRST_FORM), _spaced(_WORD_FIRST_FORM)
_BEFORE_NUMBER = re.compile(r"(?:(?P<flat>(?:Flat|Apt\.?|Apartment|Unit|Suite)\s{1,3}\d+\w?,?\s{1,3})|[\w./-]|\d[.,])\Z")
_WORD_FIRST_HINTS = ("c/", "calle", "avda", "avenida", "av.", "plaza", "pza", "paseo", "p.º", "camino", "ronda", "traves", "carretera", "stra", "str.", "weg", "gasse", "allee", "platz", "ring", "damm", "ufer", "am ", "an d", "auf d", "im ", "in d", "zum", "zur", "unter d", "hinter d")


def _addresses(t: str, lower: str) -> Iterator[tuple[int, int]]:
    for x in _NUMBER_FIRST.finditer(t):
        before = _BEFORE_NUMBER.search(t, max(0, x.start() - 24), x.start())
        if not before:
            yield x.span()
        elif before["flat"]:
            yield before.start(), x.end()
    if any(w in lower for w in _WORD_FIRST_HINTS):
        for x in _WORD_FIRST.finditer(t):
            yield x.span()


# ---------------------------------------------------------------- names

_WORD = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)?")
_TITLES = frozenset("mr mrs ms miss dr prof sir herr frau sr sra srta don doña m mme mlle monsieur madame dra".split())
_PARTICLES = frozenset("von van de der den del di du la le da dos".split())


#: Characters around a family name within which a whole name stands as a rule; where one reaches further, all is read.
_AROUND = 160


def names_in(text: str, lower: str, words: set[str], given: frozenset[str], family: frozenset[str]) -> list[tuple[int, int]]:
    """``find_names`` that reads only the surroundings of family names; the same spans.

    ``lower`` is the case-folded text and ``words`` its words. A name that comes near the edge of what was read makes
    the whole text be read.
    """
    known = words & family
    if not known:
        return []
    if len(lower) != len(text):
        return find_names(text, given, family)
    at = []
    for w in known:
        i = lower.find(w)
        while i >= 0:
            at.append((max(0, i - _AROUND), min(len(text), i + len(w) + _AROUND)))
            i = lower.find(w, i + len(w))
    stretches: list[tuple[int, int]] = []
    for a, b in sorted(at):
        if stretches and a <= stretches[-1][1]:
            stretches[-1] = (stretches[-1][0], max(b, stretches[-1][1]))
        else:
            stretches.append((a, b))
    # a stretch begins and ends between words
    stretches = [(text.rfind(" ", 0, a) + 1 if a else 0, b if (e := text.find(" ", b)) < 0 else e) for a, b in stretches]
    spans = find_names(text, given, family, stretches)
    edge = 2 * _AROUND // 3
    for a, b in stretches:
        for s, e in spans:
            if (a and a <= s < a + _AROUND - edge) or (b < len(text) and b - _AROUND + edge < e <= b):
                return find_names(text, given, family)
    return spans


def find_names(text: str, given: frozenset[str], family: frozenset[str], stretches: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Spans of persons' names: each holds a family name with what belongs to it on either side.

    Family with given names or initials before it (hyphens, particles and a second family name included), family
    and given name around a comma, or family after a title, which is not part of the span.
    """
    words = [(m.start(), m.end(), m[0].casefold()) for a, b in stretches or [(0, len(text))] for m in _WORD.finditer(text, a, b)]
    spans, last, k = [], -1, 0
    while k < len(words):
        s, e, w = words[k]
        if w not in family:
            k += 1
            continue
        first, named, titled = k, False, False
        j = k - 1
        while j > last:
            ps, pe, pw = words[j]
            between = text[pe : words[j + 1][0]]
            blank = not between.strip() and len(between) <= 3
            if (pw in given and (blank or between == "-")) or (len(pw) == 1 and text[ps].isalpha() and between[:1] == "." and not between[1:].strip() and len(between) <= 4 and (words[j + 1][2] in given or words[j + 1][2] in family or named or words[j + 1][2] in _PARTICLES)):
                first, named = j, True
            elif pw in _PARTICLES and blank and j - 1 > last and (words[j - 1][2] in given or len(words[j - 1][2]) == 1):
                pass
            elif pw in _TITLES and between.strip() in ("", ".") and len(between) <= 4:
                titled = True
                break
            else:
                break
            j -= 1
        end = k
        while end + 1 < len(words) and words[end + 1][2] in family and not (gap := text[words[end][1] : words[end + 1][0]]).strip() and len(gap) <= 3:
            end += 1
        if not named and not titled:  # Family, Given
            n = end + 1
            if n < len(words) and words[n][2] in given and text[words[end][1] : words[n][0]].strip() == "," and words[n][0] - words[end][1] <= 4:
                named, end = True, n
                while end + 1 < len(words) and words[end + 1][2] in given and text[words[end][1] : words[end + 1][0]] in ("-", " "):
                    end += 1
        if named or titled:
            spans.append((words[first][0], words[end][1]))
            last = end
        k = end + 1
    return spans


def find_pii(text: str | None, given: frozenset[str] = frozenset(), family: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """``(start, end, type)`` of every occurrence, in source offsets and order; [] for null and blank texts.

    Types are email, phone, id_number, address and name; where spans overlap the earlier type of email, id_number,
    phone, address, name holds.
    """
    if not text or text.isspace():
        return []
    m = normalise(text)
    t = m.text
    found: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []  # apart and in order

    def free(start: int, end: int) -> bool:
        k = bisect_right(taken, (start, start))
        return (k == 0 or taken[k - 1][1] <= start) and (k == len(taken) or taken[k][0] >= end)

    def add(start: int, end: int, kind: str) -> None:
        insort(taken, (start, end))
        found.append((m.source(start), m.source_end(end), kind))

    i = t.find("@")
    while i >= 0:
        s = i
        while s > 0 and (t[s - 1].isalnum() or t[s - 1] in _LOCAL):
            s -= 1
        while s < i and t[s] in ".+-%":
            s += 1
        host = _HOST.match(t, i + 1)
        if s < i and host:
            add(s, host.end(), "email")
        i = t.find("@", host.end() if host else i + 1)
    lower = t.casefold()
    if any(w in lower for w in _LABEL_HINTS):
        for x in _ID_LABELLED.finditer(t):
            v = x["v"]
            if sum(c.isdigit() for c in v) >= 5 and free(*x.span("v")):
                while v and len(v.split()[-1]) == 1 and v[-1].isalpha() and not re.search(r"\d\d [A-D]$", v):
                    v = v[:-1].rstrip(" .-")
                add(x.start("v"), x.start("v") + len(v), "id_number")
    windows = _windows(t)
    for a, b in windows:
        for x in _ID_BARE.finditer(t, a, b):
            if free(*x.span()):
                add(*x.span(), "id_number")
    if "☎" in t or any(w in lower for w in _PHONE_HINTS):
        for x in _PHONE_CUED.finditer(t):
            if 6 < sum(c.isdigit() for c in x["v"]) <= 16 and free(*x.span("v")):
                add(*x.span("v"), "phone")
    for a, b in m.spelled:  # nobody spells out a figure of seven digits and more
        if 7 <= b - a <= 15 and free(a, b):
            add(a, b, "phone")
    for a, b in windows:
        for x in _PHONE.finditer(t, a, b):
            if 6 < sum(c.isdigit() for c in x[0]) <= 16 and free(*x.span()) and not _NOT_PHONE.search(t, max(0, x.start() - 24), x.start()):
                add(*x.span(), "phone")
    for s, e in _addresses(t, lower):
        if free(s, e):
            add(s, e, "address")
    for s, e in names_in(t, lower, m.words, given, family):
        if free(s, e):
            add(s, e, "name")
    return sorted(found)


def replace_pii(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each span replaced by its placeholder, e.g. ``[EMAIL]``."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for start, end, kind in spans:
        if start < at:
            continue
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


# ---------------------------------------------------------------- corpus

#: Capitalised words, those of the kinds of O'Brien and McDonald included, and runs of them.
_CAPITALISED = r"(?:\p{Lu}['’]|Mc|Mac)?\p{Lu}\p{Ll}+"
_RUN = rf"{_CAPITALISED}(?:[- ]{_CAPITALISED})+"
#: A family name stands behind so many different given names, or behind given names in this share of its places.
FAMILY_GIVEN, FAMILY_SHARE = 2, 0.5


def learn_names(texts: DataFrame, known: DataFrame, text: str = "text", known_name: str = "name_part") -> DataFrame:
    """``kind (given or family), name``: the case-folded lexica learned from all texts.

    Counts all runs of capitalised words of the corpus (one regex pass in the JVM, folded map-side). A word after a
    known given name, behind two different ones or in most of its places behind capitalised words, is a family name; a word that mostly stands before family names, and before two different ones
    at least, is a given name; then once more from the given names found.
    """
    titles = list(_TITLES)
    runs = texts.where(F.col(text).isNotNull()).select(F.explode(F.regexp_extract_all(F.col(text), F.lit(_RUN), F.lit(0))).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    words, seps = F.split("run", "[- ]"), F.regexp_extract_all("run", F.lit("[- ]"), F.lit(0))
    left, right = F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1)
    pairs = runs.select("n", F.explode(F.arrays_zip(left.alias("a"), seps.alias("sep"), right.alias("b"))).alias("p"))
    pairs = pairs.select(F.lower("p.a").alias("a"), F.col("p.sep").alias("sep"), F.lower("p.b").alias("b"), "n").groupBy("a", "sep", "b").agg(F.sum("n").alias("n"))
    pairs = cut(pairs.where(~F.col("a").isin(titles) & ~F.col("b").isin(titles)))
    spaced, hyphened = pairs.where("sep = ' '"), pairs.where("sep = '-'")
    given = known.select(F.lower(F.col(known_name)).alias("name")).where("name <> ''").distinct()
    for _ in range(2):
        twins = hyphened.join(given.withColumnRenamed("name", "a"), "a", "left_semi").select(F.col("b").alias("name"))
        twins = twins.union(hyphened.join(given.withColumnRenamed("name", "b"), "b", "left_semi").select(F.col("a").alias("name"))).distinct()
        after = spaced.join(given.select(F.col("name").alias("a"), F.lit(1).alias("g")), "a", "left").groupBy(F.col("b").alias("name"))
        after = after.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("g") == 1, F.col("n"))).alias("behind"), F.count("g").alias("names"))
        after = after.where((F.col("names") >= FAMILY_GIVEN) | (F.col("behind") >= FAMILY_SHARE * F.col("n")))
        family = after.select("name").join(given, "name", "left_anti").join(twins, "name", "left_anti")
        marked = spaced.join(family.select(F.col("name").alias("b"), F.lit(1).alias("f")), "b", "left")
        more = marked.groupBy(F.col("a").alias("name")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("f") == 1, F.col("n"))).alias("before"), F.count("f").alias("families"))
        more = more.where((F.col("families") >= 2) & (F.col("before") >= 0.5 * F.col("n"))).select("name").join(family, "name", "left_anti")
        given = cut(given.union(twins).union(more).distinct())
        family = cut(family)
    return cut(family.select(F.lit("family").alias("kind"), "name").union(given.select(F.lit("given"), "name")))


class _Lexica:
    """The learned names for the workers: broadcast while they are few, else each text's own, joined to its row."""

    def __init__(self, texts: DataFrame, known: DataFrame, text: str) -> None:
        names = learn_names(texts, known, text)
        self.text, self.texts, self.shared, self.extra = text, texts, None, ()
        if names.count() <= BROADCAST_NAMES:
            rows = names.toPandas()
            self.shared = texts.sparkSession.sparkContext.broadcast(tuple(frozenset(rows.loc[rows["kind"] == k, "name"]) for k in ("given", "family")))
            return
        keyed = texts.withColumn("__text_id", F.xxhash64(F.col(text)))
        words = keyed.select("__text_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{M}]+"), F.lit(0)))).alias("name")).distinct()
        own = words.join(names, "name").groupBy("__text_id").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("name"))).alias(f"__{k}") for k in ("given", "family")])
        self.texts, self.extra = keyed.join(own, "__text_id", "left").drop("__text_id"), ("__given", "__family")

    def reader(self):
        """For a worker: the names that hold for each row of a batch."""
        shared = self.shared

        def of(batch: pa.RecordBatch) -> Iterator[tuple[frozenset[str], frozenset[str]]]:
            if shared is not None:
                sets = shared.value
                return iter([sets] * batch.num_rows)
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__given", "__family")]
            return iter([(frozenset(g or ()), frozenset(f or ())) for g, f in zip(*columns, strict=True)])

        return of


def _detected(names, key: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, kinds, starts, ends = [], [], [], []
            for i, (t, (given, family)) in enumerate(zip(b.column(b.schema.get_field_index(text)).to_pylist(), names(b), strict=True)):
                for s, e, k in find_pii(t, given, family):
                    at.append(i)
                    kinds.append(k)
                    starts.append(s)
                    ends.append(e)
            keys = b.column(b.schema.get_field_index(key)).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[key, "pii_type", "start_char", "end_char"])

    return run


def detect(texts: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per occurrence: key, pii_type, start_char, end_char. One aggregation for the lexica, then a map."""
    lexica = _Lexica(texts.select(key, text), known, text)
    kind = texts.schema[key].dataType.simpleString()
    return lexica.texts.select(key, text, *lexica.extra).mapInArrow(_detected(lexica.reader(), key, text), f"`{key}` {kind}, pii_type string, start_char int, end_char int")


def _masked(names, text: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            clean = [replace_pii(t, find_pii(t, given, family)) for t, (given, family) in zip(b.column(at).to_pylist(), names(b), strict=True)]
            yield b.set_column(at, b.schema.field(at), pa.array(clean, b.schema.field(at).type)).select(columns)

    return run


def mask(texts: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """The table with every occurrence in ``text`` replaced by a placeholder of its type; null stays null."""
    lexica = _Lexica(texts, known, text)
    return lexica.texts.select(*texts.columns, *lexica.extra).mapInArrow(_masked(lexica.reader(), text, texts.columns), texts.schema)
