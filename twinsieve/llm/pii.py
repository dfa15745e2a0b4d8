"""Personal information inside free text, by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs and their spelled-out forms, cues of
numbers, first signs of numbers, street words, cues of persons, and the known names. At every anchor a small
deterministic parser expands to both sides as far as its form goes, validates what it reads and gives a span with its
kind. Number cues that name something else (an order, a form, a spare part) veto. Overlaps go to the kind listed
first: email, idno, phone, address, name. Names that are the subject before "of <organisation>" are found from the
anchor " of "; only those before Han text have no word to begin from, and a regular expression finds these places.

A text is worked through in time linear in its length: parsers read from their anchor outwards, addresses are looked
for once in each stretch of words around street words, and spans that are taken are kept sorted. Check digits of
identity numbers are not tested, as numbers with wrong ones are personal too; a number of one digit repeated is none.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.runtime import spread

KINDS = ("email", "idno", "phone", "address", "name")

# --- words of the languages covered -------------------------------------------------------------
AT_SIGNS = ("@", "＠", "(at)", "[at]", "{at}", " at ", "&#64;")
ID_CUES = (
    "identity number", "identity card", "identity no", "id number", "insurance no", "insurance number", "security no",
    "security number", "ssn", "passport", "(id ", "taxid", "tax id", "tax number", "tax no", "national id",
    "ausweis", "steuernummer", "steuer-id", "sozialversicherungsnummer", "reisepass", "versicherungsnummer",
    "sécurité sociale", "carte", "numéro fiscal", "passeport", "carte d'identité",
    "dni", "nie", "nif", "documento", "pasaporte", "seguridad social", "número fiscal",
    "身份证号", "身份证", "护照号", "护照", "税号", "社保号",
)
PHONE_CUES = (
    "phone", "tel", "tél", "telefon", "telephone", "teléfono", "téléphone", "call", "call me on", "mobil", "mobile",
    "cell", "fax", "ring", "whatsapp", "au", "en el", "电话", "手机", "contact", "handy", "móvil", "portable",
)
#: Words right before a number that name a thing, not a person's line.
THING = re.compile(
    r"(?:part|order|parcel|form|docket|drawing|isbn|ticket|invoice|version|port|address|volume|case|run|no\.|sku|item"
    r"|step|note|serial|model|lot|ref|reference|sum|total|rev\.|revision|page|exit|bus|node|dossier|vorgang|lauf|expediente|paket|colis|paquete|订单|编号|版本)"
    r"[\s:#№=.]*$",
    re.I,
)
STREET_EN = r"(?:Street|Lane|Avenue|Close|Terrace|Row|Road|Rd|Blvd\.?|Boulevard|Drive|Way|Court|Square|Place|Crescent|Hill)"
STREET_BEFORE = (
    r"(?:rue|avenue|av\.|impasse|quai|bd\.?|boulevard|chemin|place|allée|cours|route|passage|square"
    r"|calle|c/|avda\.?|avenida|camino|plaza|paseo|carrera|ronda)"
)
STREET_TAIL = r"(?:straße|strasse|str\.|gasse|allee|platz|weg|ufer|damm|ring|steig)"
STREET_ANCHORS = (
    "street", "lane", "avenue", "close", "terrace", " row", "road", " rd", "blvd", "boulevard", "drive", " way", "court",
    "square", "place", "crescent", "rue", "av.", "impasse", "quai", "bd", "chemin", "allée", "cours", "route", "passage",
    "calle", "c/", "avda", "avenida", "camino", "plaza", "paseo", "straße", "strasse", "str.", "gasse", "allee", "platz",
    "weg", "ufer", "damm", "steig", "am ", "路", "街", "巷", "道",
)
PERSON_CUES = (
    "claimant,", "signed,", "according to ", "judge ", "witness ", "belongs to ", "contact: ", "reach ", "from: ", "owner=", '"user": "',
    '"user":"', '"name": "', "dr. ", "mr. ", "mrs. ", "ms. ", "prof. ", "to: ",
    "herr ", "frau ", "zeuge ", "zeugin ", "rückfragen an ", "mme ", "m. ", "mlle ", "témoin ", "contacter ",
    "señor ", "señora ", "don ", "doña ", "testigo ", "contacte con ", "请联系 ", "联系人:", "sr. ", "sra. ",
)
#: Words that make what stands before or around them an organisation, a place or a thing.
NOT_PERSON = frozenset(
    """institute archive trust guild agency works board cooperative union press lines laboratories laboratory ltd partners
    foundation museum hall bridge society street lane avenue close terrace row road rd blvd lake river mount north south
    east west old new gmbh ag verein genossenschaft amt stiftung werke verlag fondation sarl coopérative ateliers agence
    fundación talleres consejo cooperativa straße gasse allee platz weg square court place park station airport valley
    island bay port council ministry department university college school hospital bank group company corporation inc
    college church castle house tower gate market garden gardens centre center club league team committee office
    marsh ferry registry release archive's sidecar the a an and or of in on at by for with from to is was were der die
    das den dem des ein eine und oder le la les un une et ou el los las una y o en du this that these those it its we
    our my your their his her he she they i you no not but if then so as according instead therefore however moreover
    although previously eventually apparently afterwards meanwhile otherwise nevertheless notably reportedly
    counsel residents operators observers management deliveries costs revenue risk item note step warning action run
    phase signed contact reach judge witness claimant passport herr frau zeuge mme don doña señora señor testigo témoin
    january february march april may june july september october november december monday tuesday
    wednesday thursday friday saturday sunday selon según nach laut""".split()
)

#: Words that are family names too; without a known given name or a cue they are taken as words.
ORDINARY = frozenset(
    """august barrel bond bridge brook castle church cook field ferry flood ford forest frost garden gate glacier grant
    green hall harbour hart heron hill hunter lake lane marsh may meadow mill moss park pond reed ridge river rose salmon
    shepherd stone summer valley ward west winter wood young""".split()
)

# --- parsers -------------------------------------------------------------------------------------
_B = r"[ \u00a0]"
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?"
_DOT = rf"(?:\.|{_B}?[\[({{]dot[\])}}]{_B}?|{_B}dot{_B})"
LOCAL = re.compile(r"(?r)(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_](?:[\p{L}\p{N}._%+'-]*[\p{L}\p{N}_])?")  # backwards
AT_HERE = re.compile(rf"{_B}?(?:[@＠]|[\[({{]at[\])}}]|&\#64;){_B}?|{_B}at{_B}", re.I)
DOMAIN = re.compile(rf"{_LABEL}(?:{_DOT}{_LABEL})+", re.I)
TOP = re.compile(r"[\p{L}]{2,24}$")
FILE_ENDS = frozenset("png jpg jpeg gif webp svg bmp ico pdf txt html css js".split())

_SIGN = r"[ .\-–/\u00a0]"
ID_VALUE = re.compile(
    rf"(?:\b[\p{{Lu}}]{{1,2}}{_SIGN}?)?\d(?:{_SIGN}?\d){{6,20}}(?:{_SIGN}?\p{{Lu}}(?![\p{{L}}\p{{N}}]))?(?![\p{{N}}])"
)
ID_BETWEEN = re.compile(
    r"[\p{L}]*[\s:=.#º°-]*(?:(?:is|no|nr|number|n|num|ist|est|es|lautet|legte|den|n\.º|für|for)\b[\s:=.#º°]*){0,3}", re.I
)
PHONE = re.compile(
    rf"(?<![\p{{L}}\p{{N}}.,#_/@+-])(?:(?P<plus>\(?\+\d{{1,3}}\)?|00\d{{2}}(?=[ (])){_SIGN}?)?(?P<body>(?:\(\d{{1,4}}\){_SIGN}?)?\d(?:{_SIGN}?\(?\d\)?)*)"
)
PHONE_BEFORE = re.compile(rf"(?<![\p{{L}}])(?:{'|'.join(re.escape(c) for c in PHONE_CUES)})[ :=.(\u00a0]*$", re.I)
PHONE_AFTER = re.compile(r",? ?(?:x\d+|ext\.? ?\d+)?,? (?:/ )?(?:correo|courriel|e-?mail|mail)\b", re.I)
NATIONAL = re.compile(
    r"(?:1[ .-])?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])\d{3}[ .-]\d{4}$"  # 3-3-4
    r"|\(0\d{1,4}\)[ /-]?\d[\d -]{5,11}$|0\d{1,4}[ /-]\d[\d -]{5,11}$"  # area code in front
    r"|0\d(?:[ .-]\d\d){4}$"  # pairs
)

_W = r"\p{Lu}[\p{L}\p{M}]*(?:['’-]\p{L}[\p{L}\p{M}]*)*"
HOUSE = rf"\d{{1,4}}{_B}?(?:[a-zA-Z](?![\p{{L}}]))?(?:[-–/]\d{{1,4}}[a-zA-Z]?)?(?:{_B}(?:bis|ter|quater)\b)?"
HOUSE_AFTER = rf"(?:,?{_B}(?:n\.º|nº|n°|no\.|nr\.){_B}?|,?{_B})\d{{1,4}}(?:{_B}?[a-zA-Z](?![\p{{L}}]))?(?:[-–/]\d{{1,4}}[a-zA-Z]?)?(?![\p{{N}}])"
ADDRESSES = tuple(
    re.compile(p)
    for p in (
        rf"(?<![\p{{L}}\p{{N}}.,#/-]){HOUSE}{_B}(?:(?:Old|New|OLD|NEW|[NSEW]\.|North|South|East|West){_B})?(?:{_W}{_B}){{1,3}}(?i:{STREET_EN})(?![\p{{L}}\p{{N}}])",
        rf"(?<![\p{{L}}\p{{N}}.,#/-]){HOUSE},?{_B}(?i:{STREET_BEFORE}){_B}(?:(?:de|du|des|d'|la|le|les|l'){_B}?)*(?:{_W})(?:{_B}{_W})?",
        rf"(?i:\b{STREET_BEFORE}){_B}?(?:(?:de|del|la|las|los|el){_B})*(?:{_W})(?:{_B}{_W})?{HOUSE_AFTER}",
        rf"(?:{_W}(?:er)?{_B})?(?:{_W}{STREET_TAIL}|(?i:Straße|Strasse|Gasse|Allee|Platz|Weg|Ufer|Damm|Steig)){_B}{HOUSE}(?![\p{{N}}])",
        rf"\b(?:Am|An{_B}der|An{_B}den|Auf{_B}dem|Im|Unter{_B}den|Zum|Zur){_B}{_W}{_B}{HOUSE}(?![\p{{N}}])",
        r"\p{Han}{2,8}(?:大道|路|街|巷|道)\d{1,4}(?:[-–]\d{1,4})?号?",
    )
)
_PART = rf"(?:(?i:von|van|de|del|della|di|da|du|des|der|den|la|le|los|las|zu|zum|bin|ibn|al|ter|ten){_B})"
_INIT = r"\p{Lu}\."
GIVEN_FAMILY = re.compile(rf"(?:{_W}|{_INIT})(?:{_B}{_INIT})*{_B}{_PART}{{0,2}}{_W}")
FAMILY_GIVEN = re.compile(rf"{_PART}{{0,2}}{_W},{_B}(?:{_W}|{_INIT})(?:{_B}{_INIT})*")
AFTER_GIVEN = re.compile(rf"(?:{_B}{_INIT})*{_B}{_PART}{{0,2}}(?P<f>{_W})")
LOWER_AFTER = re.compile(rf"(?:{_B}\p{{L}}\.)*{_B}{_PART}{{0,2}}(?P<f>\p{{L}}+(?:['’-]\p{{L}}+)*)")
BEFORE_FAMILY = re.compile(rf"(?r)(?P<g>{_W}|{_INIT})(?:{_B}{_INIT})*{_B}{_PART}{{0,2}}")
FAMILY_BEFORE = re.compile(rf"(?r)(?:(?<![\p{{L}}]){_PART}{{0,2}})(?P<f>{_W}),{_B}")
HYPHENED, HYPHEN_BEFORE = re.compile(r"['’-]\p{L}+"), re.compile(r"(?r)\p{L}+['’-]")
GIVEN_AFTER = re.compile(rf",{_B}(?P<g>{_W})(?:{_B}{_INIT})*")
ORGANISATION = (
    r"(?:Institute|Archive|Trust|Guild|Agency|Works|Board|Cooperative|Union|Press|Lines|Laboratories|Laboratory|Partners"
    r"|Foundation|Museum|Society|Council|Ministry|Department|University|College|School|Hospital|Bank|Group|Company"
    r"|Corporation|Association|Ltd|Inc|GmbH|AG|Verein|Genossenschaft|Amt|Stiftung|Werke|Verlag|Fondation|SARL|Ateliers"
    r"|Coopérative|Fundación|Talleres|Consejo|Cooperativa)"
)
#: What follows a name that begins a sentence: the organisation of the person, or a verb in Chinese.
OF_ORGANISATION = re.compile(rf"{_B}of{_B}(?:{_W}{_B}(?:&{_B})?){{1,3}}{ORGANISATION}\b")
BEFORE_HAN = re.compile(rf"(?<=\p{{Latin}}){_B}?(?=\p{{Han}})")
SUBJECT = re.compile(
    rf"(?r)(?<=^|[\n。]|[.!?。]{_B})(?:{_PART}{{0,2}}{_W},{_B}(?:{_W}|{_INIT})(?:{_B}{_INIT})*|(?:{_W}|{_INIT})(?:{_B}{_INIT})*{_B}{_PART}{{0,2}}{_W})"
)
NEXT_WORD = re.compile(rf"{_B}(?:&{_B})?([\p{{L}}]+)")
INITIAL_AFTER = re.compile(rf"(?:{_B}{_INIT})+")
DIGIT = re.compile(r"\d")
#: Words around a street word that an address can reach; the longest pattern has nine.
REACH = 12
#: Signs that a telephone number can begin with.
NUMBER_STARTS = ("+", "(", *(c for c in map(chr, range(sys.maxunicode + 1)) if c.isdecimal()))


class Apart:
    """Spans that don't overlap, in order."""

    def __init__(self):
        self.spans: list[tuple[int, int]] = []

    def add(self, a: int, b: int) -> bool:
        """Whether the span is free; it is taken then."""
        at = bisect_left(self.spans, (a, a))
        if at and self.spans[at - 1][1] > a or at < len(self.spans) and self.spans[at][0] < b:
            return False
        insort(self.spans, (a, b))
        return True


class Finder:
    """Finds spans in one text after another; ``names`` are ``(name, kind)`` pairs of the known names."""

    def __init__(self, names: Iterable[tuple[str, str]]):
        self.known: dict[str, str] = {}
        for name, kind in names:
            if name and kind:
                self.known[name.lower()] = kind
        self.anchors = ahocorasick.Automaton()
        tags: dict[str, set] = {}
        for kind, words in (
            ("at", AT_SIGNS), ("id", ID_CUES), ("number", NUMBER_STARTS), ("street", STREET_ANCHORS), ("person", PERSON_CUES),
            ("of", (" of ", "\u00a0of ", " of\u00a0", "\u00a0of\u00a0")), ("known", self.known),
        ):
            for word in words:
                tags.setdefault(word.lower(), set()).add(kind)
        for word, kinds in tags.items():
            # most hits are digits, which need no more than their place
            self.anchors.add_word(word, None if kinds == {"number"} else (len(word), tuple(sorted(kinds))))
        self.anchors.make_automaton()

    def find(self, text: str | None) -> list[tuple[str, int, int]]:
        """``(kind, start, end)`` in code points, in order, never overlapping."""
        if not text:
            return []
        low = text.lower()
        if len(low) != len(text):  # a few letters grow in lower case; positions must stay
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        hits: dict[str, list[tuple[int, int]]] = {k: [] for k in ("at", "id", "street", "person", "of", "known")}
        numbers = []
        for end, value in self.anchors.iter(low):
            if value is None:
                numbers.append(end)
                continue
            size, kinds = value
            for kind in kinds:
                hits[kind].append((end + 1 - size, end + 1))
        spans: list[tuple[str, int, int]] = []
        taken = Apart()

        def take(kind: str, found: Iterable[tuple[int, int]]) -> None:
            for a, b in sorted(set(found), key=lambda s: (s[0], -s[1])):
                if taken.add(a, b):
                    spans.append((kind, a, b))

        if hits["at"]:
            take("email", self._emails(text, hits["at"]))
        if hits["id"]:
            take("idno", self._ids(text, low, hits["id"]))
        if numbers:
            take("phone", self._phones(text, low, numbers))
        if hits["street"]:
            take("address", self._addresses(text, hits["street"]))
        take("name", self._names(text, low, hits["person"], hits["of"], hits["known"]))
        return sorted(spans, key=lambda s: s[1])

    def _emails(self, text: str, hits: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        for a, b in hits:
            for start in (a - 1, a):
                if start < 0 or not (at := AT_HERE.match(text, start)) or at.end() < b:
                    continue
                if text[a:b] in "@＠" and (text[a - 1 : a].isspace() != text[b : b + 1].isspace()):
                    continue  # a blank on one side only: a handle, not an address
                local = LOCAL.match(text, 0, at.start())
                domain = DOMAIN.match(text, at.end())
                if not local or not domain:
                    continue
                spelled = text[a:b].strip().lower() == "at"
                whole = domain[0]
                if spelled and not re.search(rf"{_B}dot{_B}|[\[({{]dot", whole, re.I):
                    continue
                top = re.split(_DOT, whole, flags=re.I)[-1]
                if TOP.match(top) and top.lower() not in FILE_ENDS:
                    yield local.start(), domain.end()
                    break

    def _ids(self, text: str, low: str, hits: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        for a, b in hits:
            if a and low[a].isalpha() and low[a].isascii() and low[a - 1].isalpha() and low[a - 1].isascii():
                continue
            between = ID_BETWEEN.match(text, b)
            for start in (b, between.end() if between else b):
                while start < len(text) and text[start] in " :=.#\u00a0":
                    start += 1
                if value := ID_VALUE.match(text, start):
                    if len({c for c in value[0] if c.isdecimal()}) > 1:
                        yield value.start(), value.end()
                    break

    def _phones(self, text: str, low: str, starts: list[int]) -> Iterator[tuple[int, int]]:
        done, last = 0, -2
        for start in starts:
            follows, last = start == last + 1 and text[start] not in "(+", start
            # only the first digit of several can begin a number
            if follows and text[start - 1] not in "(+" or start < done or not (m := PHONE.match(text, start)):
                continue
            a, b = m.span()
            done = b
            body, digits = m["body"], sum(c.isdigit() for c in m[0])
            if not 9 <= digits <= 15 or (b < len(text) and (text[b].isalnum() or text[b] in "_@#=")):
                continue
            if m[0].count("(") != m[0].count(")"):
                continue
            before = low[max(0, a - 16) : a]
            if THING.search(before):
                continue
            if m["plus"]:
                yield a, b
            elif NATIONAL.match(body):
                yield a, b
            elif PHONE_BEFORE.search(before) or PHONE_AFTER.match(text, b):
                yield a, b

    @staticmethod
    def _around(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Stretches of ``REACH`` words to both sides of the hits, within lines, those that meet made one."""
        out: list[tuple[int, int]] = []
        for a, b in hits:
            inside = out and a <= out[-1][1]
            if inside:
                left = out[-1][0]
            else:
                left, line = a, text.rfind("\n", 0, a) + 1
                for _ in range(REACH):
                    left = text.rfind(" ", line, left)
                    if left < 0:
                        left = line
                        break
            right, end = b, text.find("\n", b)
            end = len(text) if end < 0 else end
            for _ in range(REACH):
                right = text.find(" ", right + 1, end)
                if right < 0:
                    right = end
                    break
            if inside or out and left <= out[-1][1]:
                out[-1] = out[-1][0], max(out[-1][1], right)
            else:
                out.append((left, right))
        return out

    def _addresses(self, text: str, hits: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        hits = sorted(hits)
        begins = [a for a, _ in hits]
        for left, right in self._around(text, hits):
            if not DIGIT.search(text, left, right):
                continue
            for pattern in ADDRESSES:
                for m in pattern.finditer(text, left, right):
                    at = bisect_right(begins, m.end())  # anchors that begin up to the end, the last few of which matter
                    if not any(b > m.start() for _, b in hits[max(0, at - 4) : at]) or "\n" in m[0]:
                        continue
                    if not THING.search(text, max(0, m.start() - 16), m.start()):
                        yield m.start(), m.end()

    def _person(self, text: str, m) -> bool:
        words = re.findall(r"[\p{L}]+", m[0])
        if any(w.lower() in NOT_PERSON and len(w) > 1 and w.lower() not in self.known for w in (words[0], words[-1])):
            return False
        after = NEXT_WORD.match(text, m.end())
        return not (after and after[1][0].isupper() and after[1].lower() in NOT_PERSON)

    def _names(self, text: str, low: str, cues: list, ofs: list, known: list) -> Iterator[tuple[int, int]]:
        found: list[tuple[int, int]] = []
        for a, b in cues:
            if low[a].isalpha() and a and low[a - 1].isalpha():
                continue
            while b < len(text) and text[b] in " \u00a0":
                b += 1
            m = FAMILY_GIVEN.match(text, b)
            if not (m and self._family_first(text, m)):
                m = GIVEN_FAMILY.match(text, b)
            if m and self._person(text, m):
                found.append(m.span())
        ends = [a for a, _ in ofs if OF_ORGANISATION.match(text, a)]
        ends += [m.start() for m in BEFORE_HAN.finditer(text)]
        for end in ends:
            if (m := SUBJECT.match(text, 0, end)) and self._person(text, m):
                found.append(m.span())
        # spans that reach the next known name; names come in the order of their ends
        found.sort()
        reach, coming = [], 0
        cued = len(found)
        for a, b in known:
            if (a and (text[a - 1].isalnum() or text[a - 1] in "_@＠.+-=" and not text[a - 1] == "=")) or (
                b < len(text) and (text[b].isalnum() or text[b] in "_@＠+")
            ):
                if not (a and text[a - 1] == "-" and self.known[low[a:b]] == "family"):
                    continue
            while coming < cued and found[coming][0] <= a:
                reach.append(found[coming])
                coming += 1
            reach = [span for span in reach if span[1] >= b]
            if any(x <= a for x, _ in reach):
                continue
            span = self._given(text, low, a, b) if self.known[low[a:b]] == "given" else self._family(text, low, a, b)
            if span:
                found.append(span)
                reach.append(span)
        yield from self._longest(found)

    @staticmethod
    def _longest(found: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        kept = Apart()
        for a, b in sorted(set(found), key=lambda s: s[0] - s[1]):
            kept.add(a, b)
        yield from kept.spans

    def _family_first(self, text: str, m) -> bool:
        family, given = m[0].split(",", 1)
        words = re.findall(r"[\p{L}]+", given)
        first, last = words[0].lower(), re.findall(r"[\p{L}]+", family)[-1].lower()
        if self.known.get(first) == "family" and self.known.get(last) != "family":
            return False
        return self.known.get(first) == "given" or self.known.get(last) == "family" or words[0].lower() not in NOT_PERSON

    def _given(self, text: str, low: str, a: int, b: int) -> tuple[int, int] | None:
        if text[a].isupper():
            after = AFTER_GIVEN.match(text, b)
            if after and after["f"].lower() not in NOT_PERSON or after and after["f"].lower() in self.known:
                word = NEXT_WORD.match(text, after.end())
                if not (word and word[1][0].isupper() and word[1].lower() in NOT_PERSON):
                    return a, after.end()
                return None
            before = FAMILY_BEFORE.match(text, 0, a)
            if before and self.known.get(re.split("['’-]", before["f"])[-1].lower()) == "family":
                initials = INITIAL_AFTER.match(text, b)
                return before.start(), initials.end() if initials else b
        else:
            after = LOWER_AFTER.match(low, b)
            if after and self.known.get(re.split("['’-]", after["f"])[-1]) == "family":
                return a, after.end()
        return None

    def _family(self, text: str, low: str, a: int, b: int) -> tuple[int, int] | None:
        if not text[a].isupper():
            return None
        # the whole of a hyphenated family name
        while b < len(text) and (m := HYPHENED.match(text, b)):
            b = m.end()
        while a and (m := HYPHEN_BEFORE.match(text, 0, a)):
            a = m.start()
        word = NEXT_WORD.match(text, b)
        if word and word[1][0].isupper() and word[1].lower() in NOT_PERSON:
            return None
        before = BEFORE_FAMILY.match(text, 0, a)
        if before:
            given = before["g"].rstrip(".").lower()
            initial = before["g"].endswith(".")
            if initial and not before.start() or initial and not text[before.start() - 1].isalpha():
                return before.start(), b
            if self.known.get(given) == "given":
                return before.start(), b
            if not initial and given not in NOT_PERSON and given not in self.known and low[a:b] not in ORDINARY:
                return before.start(), b
        after = GIVEN_AFTER.match(text, b)
        if after and self.known.get(after["g"].lower()) == "given":
            word = NEXT_WORD.match(text, after.end())
            if not (word and word[1][0].isupper()):
                return a, after.end()
        return None


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span replaced by its kind in brackets; the rest stays as it is."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


_finders: dict[int, Finder] = {}


def _finder(shared) -> Finder:
    names = shared.value
    if (number := hash(names)) not in _finders:
        _finders[number] = Finder(names)
    return _finders[number]


#: Known names beyond which they are not broadcast; the list is a fixed resource of about a thousand.
MOST_NAMES = 200_000


def _share(known_names: DataFrame):
    rows = known_names.where("name is not null and name_kind is not null").select("name", F.lower("name_kind").alias("k"))
    names = tuple(sorted((r["name"], r["k"]) for r in rows.distinct().limit(MOST_NAMES + 1).collect()))
    if len(names) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} known names; they are held in every worker")
    return known_names.sparkSession.sparkContext.broadcast(names)


def find_personal(docs: DataFrame, known_names: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, kind, start_pos, end_pos``: one row per occurrence, positions in code points from 0.

    Null and empty texts give no row; a repeated row gives its occurrences again; texts of any length
    are searched whole. Extra columns are ignored. Names of unknown kind are ignored.
    """
    shared = _share(known_names)
    kind_type = pa.string()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(shared)
        for batch in batches:
            where, kinds, starts, ends = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for kind, a, b in finder.find(t):
                    where.append(i), kinds.append(kind), starts.append(a), ends.append(b)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(where, pa.int64())),
                    pa.array(kinds, kind_type),
                    pa.array(starts, pa.int64()),
                    pa.array(ends, pa.int64()),
                ],
                names=[key, "kind", "start_pos", "end_pos"],
            )

    rows = spread(docs.select(F.col(key), F.col(text)))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(find, f"{key} {kind}, kind string, start_pos bigint, end_pos bigint")


def redact_personal(docs: DataFrame, known_names: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text``: every text with typed placeholders; null stays null, the rest of a text as it was."""
    shared = _share(known_names)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(shared)
        for batch in batches:
            texts = [redact(t, finder.find(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    rows = spread(docs.select(F.col(key), F.col(text)))
    return rows.mapInArrow(clean, f"{key} {docs.schema[key].dataType.simpleString()}, text string")
