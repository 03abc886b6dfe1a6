"""Personal information in free text: finding it, and putting placeholders or surrogates in its place.

Detection is a set of patterns with the words around them, one Arrow-batched
pass over whole texts.  Surrogates are keyed, keep type, gender, script and
format, stay the same wherever the entity occurs, and are checked against each
other: two entities never get one surrogate.  That check is a group-by over
the distinct entities, repeated for those that clash; nothing is collected.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelore.llm import pii_words as words
from framelore.tables import stage, unstage

TYPES = ["email", "phone", "id_number", "address", "person_name"]
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person_name": "[PERSON_NAME]"}


def _any(items) -> str:
    return "(?:" + "|".join(regex.escape(x) for x in sorted(items, key=lambda x: (-len(x), x))) + ")"


_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9+_-])?"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_AT = r"(?:\s?@\s?|\s?[(\[{<]\s?(?:at|AT|At)\s?[)\]}>]\s?)"
_DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|DOT|Dot|punkt|point|punto)\s?[)\]}]\s?)"
EMAIL = regex.compile(
    rf"(?<![A-Za-z0-9._%+@-]){_LOCAL}(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}(?P<tld>[A-Za-z]{{2,}})|\s(?:at|AT)\s{_LABEL}(?:\s(?:dot|DOT)\s{_LABEL})*\s(?:dot|DOT)\s(?P<tld2>[A-Za-z]{{2,}}))(?![A-Za-z0-9@-])"
)

# Groups of digits as phones are written; the bare forms count only after a word that announces a phone.
_D = r"[ .\-\u00a0/]"
PHONE_MARKED = regex.compile(
    rf"(?:(?<![\w+.-])(?=\+)|(?<![\w+(.-]))(?:\+\d{{1,3}}{_D}?(?:\(0\){_D}?)?(?:\(\d{{1,5}}\){_D}?|\d{{1,5}}{_D}?)(?:\d{{2,8}}{_D}?){{0,4}}\d{{2,8}}|\(\d{{2,5}}\){_D}?\d{{2,8}}(?:{_D}\d{{2,8}}){{0,4}}|00\d{{2}}{_D}\d{{1,5}}(?:{_D}\d{{2,8}}){{1,4}})(?![\w])"
)
PHONE_BARE = regex.compile(rf"(?<![\w+(.,:-])\d{{2,6}}(?:{_D}\d{{2,8}}){{1,5}}(?![\w])|(?<![\w+(.,:-])\d{{9,12}}(?!\w)")
PHONE_BEFORE = regex.compile(
    rf"(?:{_any(words.PHONE_CUES)}\W{{0,3}}|[;|]\s?|{_any(words.PHONE_CUES)}\W{{0,3}}[+()\d .\-]{{7,25}}\s?(?:/|,|or|and|oder|und|ou|et|o|y)\s?)$", regex.I
)
NOT_PHONE_BEFORE = regex.compile(rf"{_any(words.THING_NUMBERS)}\W{{0,3}}$", regex.I)

_ID = (
    r"(?:[A-Z]{2}\s\d{2}\s\d{2}\s\d{2}\s[A-Z]|[A-Z]{2}-\d{4}-\d{4}|[A-Z]{1,3}\d{6,9}[A-Z]?|\d{3}[- ]\d{2}[- ]\d{4}|\d{2}(?:\s\d{3}){3}|\d{3}\.\d{3}\.\d{3}(?:/[A-Z0-9])?"
    r"|[A-Z]\d{2}[A-Z]\d{2}[A-Z]\d{2}|\d{7,9}[A-Z]|(?=[A-Z0-9./-]*\d[A-Z0-9./-]*\d[A-Z0-9./-]*\d)[A-Z0-9][A-Z0-9./-]{4,18}[A-Z0-9]|\d{2,4}(?:\s\d{2,4}){1,4}(?:\s?[A-Z])?)"
)
ID_NUMBER = regex.compile(rf"(?<![\w])(?i:{_any(words.ID_CUES)})(?i:\s?(?:no\.?|nr\.?|number|n[oº°]\.?|:|#|is|lautet|号|号码))*[\s:：]*(?P<id>{_ID})(?![\w])")

_CAP = r"[A-ZÀ-ÖØ-Þ][\p{L}'’-]+"
_TOWN = rf"{_CAP}(?:\s{_CAP})?"
_TOWN_DE = rf"\d{{4,5}}\s{_TOWN}"
ADDRESSES = [
    # house number, name, kind of street; flat before or behind; town with or without postcode
    regex.compile(
        rf"(?<![\w.-])\d{{1,5}}[A-Za-z]?\s(?:{_CAP}\s){{1,3}}(?i:{_any(words.STREETS_EN)})(?:(?<=(?i:st|ave|rd|blvd|ln|dr|sq|ct|pl|ter))\.)?(?![\w])"
        rf"(?:,\s(?i:flat|apt|apartment|unit|suite)\.?\s\d+[A-Za-z]?)?(?:,\s{_TOWN}(?:,?\s\d{{4,5}}(?!\w))?|,\s\d{{5}}\s{_TOWN})?"
    ),
    regex.compile(
        rf"(?<![\w.-])(?:\p{{Lu}}[\p{{L}}-]*(?i:{_any(words.STREETS_DE)})|(?:Am|An der|An den|Im|In der|Zum|Zur|Auf dem|Auf der|Unter den|AM|IM|ZUM|ZUR|AN DER)\s{_CAP})\s\d{{1,4}}\s?[a-zA-Z]?(?![\w])"
        rf"(?:,\s{_TOWN_DE}|,\s{_TOWN})?"
    ),
    regex.compile(
        rf"(?<![\w.-])\d{{1,4}}(?:\s(?i:bis|ter|quater))?,?\s(?i:{_any(words.STREETS_FR)})(?:\s(?i:de\sla|de\sl['’]|du|des|de|d['’]))?\s?{_CAP}(?:\s{_CAP})?(?![\w])(?:,\s(?:{_TOWN_DE}|{_TOWN}))?"
    ),
    regex.compile(
        rf"(?<![\w.-])(?i:{_any(words.STREETS_ES)})(?:\s(?i:de\sla|de\slos|de\slas|del|de))?\s{_CAP}(?:\s{_CAP})?,?\s(?:n\.?º\s)?\d{{1,4}}[A-Za-z]?(?![\w])(?:,\s\d{{1,2}}\.?[ºª](?:\s\p{{Lu}}(?!\w))?)?(?:,\s(?:{_TOWN_DE}|{_TOWN}))?"
    ),
    regex.compile(r"[\p{Han}]{2,8}(?:市|省|区|县)[\p{Han}]{1,12}(?:路|街|道|巷)\s?\d{1,5}\s?号(?:\s?\d{1,4}\s?室)?|[\p{Han}]{2,6}(?:路|街|大道|巷)\s?\d{1,5}\s?号(?:\s?\d{1,4}\s?室)?"),
]
_FAMILY = r"\p{L}[\p{L}'’]+(?:-\p{L}[\p{L}'’]+)?"
_PARTICLE = rf"(?:{_any(words.PARTICLES)}\s)?"
_GIVEN = rf"(?i:{_any(words.GIVEN_F | words.GIVEN_M)})"
_GIVEN_ALL = words.GIVEN_F | words.GIVEN_M
_INITIAL = r"(?:\p{Lu}|(?<=\s)\p{Ll})\."
_GIVEN_BEFORE = regex.compile(rf"(?<![\p{{L}}\d@._+-])(?:{_GIVEN}|\p{{Lu}}\.)\s$")
_GIVEN_REACH = max(map(len, words.GIVEN_F | words.GIVEN_M)) + 2
_SUFFIX = _any(words.FAMILY_ENDS)
NAME_FORWARD = regex.compile(rf"(?<![\p{{L}}\d@._+-])(?P<given>{_GIVEN}(?:-{_GIVEN})?|{_INITIAL})(?P<middle>(?:\s\p{{Lu}}\.){{0,2}})\s(?P<part>(?i:{_PARTICLE}))(?P<family>{_FAMILY})(?![\p{{L}}\d@_])")
NAME_TURNED = regex.compile(rf"(?<![\p{{L}}\d@._+-])(?P<part>(?i:{_PARTICLE}))(?P<family>{_FAMILY}),\s(?P<given>{_GIVEN}(?:-{_GIVEN})?|\p{{Lu}}\.)(?P<middle>(?:\s\p{{Lu}}\.){{0,2}})(?![\p{{L}}\d@_])")
_SHAPED = r"\p{Lu}[\p{L}'’]+(?:-\p{Lu}[\p{L}'’]+)?"
_WHOLE = rf"{_SHAPED}(?:\s\p{{Lu}}\.)?\s(?i:{_PARTICLE}){_SHAPED}"
NAME_WHOLE = regex.compile(rf"(?<![\p{{L}}\d@._+-]){_WHOLE}(?![\p{{L}}\d@_])")
_CUE_BEFORE = re.compile(rf"(?<![^\W_])(?:{'|'.join(re.escape(c) for c in sorted(words.NAME_CUES, key=lambda c: (-len(c), c)))})\s$")
_CUE_REACH = max(map(len, words.NAME_CUES)) + 2
_DOES_AFTER = re.compile(rf",?\s(?:{'|'.join(re.escape(v) for v in words.NAME_VERBS)})(?!\w)")
_HAN = re.compile("[\u4e00-\u9fff]")
_HAN_NAME = rf"(?:{_any(words.HAN_FAMILY_TWO)}|[{words.HAN_FAMILY}])"
# Two or three signs; the name ends where the words after it begin, at a mark, or at the end.
NAME_HAN = regex.compile(
    rf"{_any(words.HAN_BEFORE)}(?:是|为)?[\s:：]*(?P<before>{_HAN_NAME}\p{{Han}}{{1,2}}?)(?={_any(words.HAN_AFTER)}(?!明)|[的和与或、，。；！？,.;:\s]|$)|(?P<after>{_HAN_NAME}\p{{Han}}{{1,2}}?)(?={_any(words.HAN_AFTER)}(?!明))"
)
FAMILY_LIKE = regex.compile(rf"\p{{L}}{{2,}}{_SUFFIX}(?:-\p{{L}}{{2,}}{_SUFFIX})?", regex.I)
COMMON = frozenset(words.NOT_NAMES)
# Words of places, things and forms that stand in capitals without being names.
_THINGS = frozenset(
    w for group in (words.STREETS_EN, words.STREETS_DE, words.STREETS_FR, words.STREETS_ES, words.THING_NUMBERS, words.ID_CUES, words.PHONE_CUES, words.ADDRESS_WORDS) for w in group
)


def _family_ok(given: str, family: str) -> bool:
    low = family.lower()
    if low in COMMON:
        return False
    if FAMILY_LIKE.fullmatch(family):
        return True
    # An unknown ending: a full given name in the same case, followed by a word that starts like a name.
    return not given.endswith(".") and family[0].isupper() and len(family) > 2 and (given[0].isupper()) and (given.isupper() == family.isupper())


FLAT_BEFORE = regex.compile(r"(?<![\w.-])(?i:flat|apt|apartment|unit|suite)\.?\s\d{1,6}[A-Za-z]?,\s$")
# What a pattern cannot match without, to pass over texts and stretches that have none of it.
AT_WRITTEN, AT_WORD, DOT_WORD = re.compile(r"[(\[{<]\s?at\s?[)\]}>]"), re.compile(r"\sat\s"), re.compile(r"\sdot\s")
_AT_SIGN, _DIGIT = re.compile("@"), re.compile(r"\d")
_WORD = re.compile(r"[(\[{<]\s?at\s?[)\]}>]"), re.compile(r"\sat\s"), re.compile(r"\sdot\s")
_AT_SIGN, _DIGIT = re.compile("@"), re.compile(r"\d")
_SHORTEST_CUES = sorted(c for c in {x.lower() for x in words.ID_CUES} if not any(o != c and o in c for o in {x.lower() for x in words.ID_CUES}))
_WORD = re.compile(r"[^\W\d_]+")
# The kinds of streets that an address pattern cannot do without; none where it has other beginnings too.
_STREET_KINDS = [words.STREETS_EN, [], words.STREETS_FR, words.STREETS_ES, []]


_MARK = re.compile(r"\s?(?:@|[(\[{<]\s?(?:at|AT|At)\s?[)\]}>])\s?")
_LEFT = re.compile(r"[A-Za-z0-9._%+@-]")
_RIGHT = regex.compile(rf"(?:[A-Za-z0-9.-]|{_DOT})*.?", regex.S)


_CUES: list = []


def _id_numbers(text: str, low: str):
    """Matches of ``ID_NUMBER``, tried only where one of its cues stands."""
    if len(low) != len(text):  # a letter whose lower case has another length: positions differ
        return list(ID_NUMBER.finditer(text))
    if not _CUES:
        import ahocorasick

        cues = ahocorasick.Automaton()
        for cue in {c.lower() for c in words.ID_CUES}:
            cues.add_word(cue, len(cue))
        cues.make_automaton()
        _CUES.append(cues)
    out, done = [], 0
    for start in sorted({end + 1 - n for end, n in _CUES[0].iter(low)}):
        m = ID_NUMBER.match(text, start) if start >= done else None
        if m:
            out.append(m)
            done = m.end()
    return out


def _mail_windows(text: str, low: str) -> list[tuple[int, int]]:
    """Stretches around the marks of mail addresses, merged where they meet; the whole text where marks are plain words.

    A stretch grows on either side until a character that no address can hold
    there, so a match inside it is the match in the whole text.
    """
    if AT_WORD.search(low) and DOT_WORD.search(low):
        return [(0, len(text))]
    out: list[tuple[int, int]] = []
    for m in _MARK.finditer(text):
        a = m.start()
        while a > 0 and _LEFT.match(text, a - 1):
            a -= 1
        a = max(0, a - 1)
        if out and m.start() < out[-1][1]:  # the mark lies in the last stretch: it only grows to the right
            a = out.pop()[0]
        out.append((a, _RIGHT.match(text, m.end()).end()))
    return out


_TOKEN = re.compile(r"\S+")
# Words that a name can take before and behind a given name: particle and family; two initials, particle, family.
TOKENS_BEFORE, TOKENS_BEHIND = 4, 6


def _name_windows(text: str) -> list[tuple[int, int]]:
    """Stretches around given names and initials, merged where they meet: as many words on either side as a name can have, however long."""
    out: list[tuple[int, int]] = []
    tokens: list[tuple[int, int]] | None = None
    at = 0
    for m in _WORD.finditer(text):
        word = m[0]
        if len(word) == 1:
            if not text.startswith(".", m.end()):
                continue
        elif word.lower() not in _GIVEN_ALL:
            continue
        if tokens is None:
            tokens = [t.span() for t in _TOKEN.finditer(text)]
        while tokens[at][1] <= m.start():
            at += 1
        a, b = tokens[max(0, at - TOKENS_BEFORE)][0], tokens[min(len(tokens) - 1, at + TOKENS_BEHIND)][1]
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _person_like(name: str, lower_words: set[str]) -> bool:
    """Neither end of a capitalised pair is a common word, here or anywhere in this text in lower case."""
    first, *_, last = name.split()
    return all(w not in COMMON and w not in _THINGS and w not in lower_words for w in (first.lower(), last.lower()))


def _named_by_context(text: str) -> list[tuple[int, int]]:
    """Whole names told by the words around them, whatever the names are."""
    spans = [m.span() for m in NAME_WHOLE.finditer(text, overlapped=True)]
    spans = [(a, b) for a, b in spans if _CUE_BEFORE.search(text, max(0, a - _CUE_REACH), a) or _DOES_AFTER.match(text, b)]
    if not spans:
        return []
    lower_words = {w for w in _WORD.findall(text) if w.islower()}
    return [(a, b) for a, b in spans if _person_like(text[a:b], lower_words)]


_INITIALS_BEFORE = regex.compile(r"(?<![\p{L}\d@._+-])\p{Lu}\.\s(?:\p{Lu}\.\s)?$")
_INSIDE = regex.compile(r"[\p{L}\d@_]")
_INSIDE_LEFT = regex.compile(r"[\p{L}\d@._+-]")


def _places(text: str, word: str):
    at = text.find(word)
    while at >= 0:
        if not _INSIDE.match(text, at + len(word)):
            yield at
        at = text.find(word, at + 1)


def _mentioned_again(text: str, names: list[str]) -> list[tuple[int, int]]:
    """Further mentions of names found in this text: the same name, or initials with its family name."""
    out = []
    for name in names:
        out += [(at, at + len(name)) for at in _places(text, name) if not (at and _INSIDE_LEFT.match(text, at - 1))]
        parts = name.replace(",", " ").split()
        family = parts[0] if "," in name else parts[-1]
        if family[0].isupper():
            for at in _places(text, family):
                m = _INITIALS_BEFORE.search(text, max(0, at - 8), at)
                if m:
                    out.append((m.start(), at + len(family)))
    return out


def find_entities(text: str | None) -> list[tuple[str, int, int]]:
    """(type, start, end) in code points, end exclusive, without overlaps, in order."""
    if not text:
        return []
    taken: list[tuple[int, int]] = []
    out: list[tuple[str, int, int]] = []

    def add(kind: str, a: int, b: int) -> bool:
        if any(a < y and x < b for x, y in taken):
            return False
        taken.append((a, b))
        out.append((kind, a, b))
        return True

    low = text.lower()
    if "@" in text or AT_WRITTEN.search(low) or AT_WORD.search(low) and DOT_WORD.search(low):
        for a, b in _mail_windows(text, low):
            for m in EMAIL.finditer(text, a, b):
                if (m["tld"] or m["tld2"]).lower() not in words.FILE_ENDS:
                    add("email", *m.span())
    digits = _DIGIT.search(text)
    if digits:
        for pattern, kinds in zip(ADDRESSES, _STREET_KINDS):
            if kinds and not any(k in low for k in kinds):
                continue
            for m in pattern.finditer(text):
                flat = FLAT_BEFORE.search(text, max(0, m.start() - 40), m.start()) if pattern is ADDRESSES[0] else None
                add("address", flat.start() if flat else m.start(), m.end())
        for m in _id_numbers(text, low):
            add("id_number", *m.span("id"))
        for pattern, marked in ((PHONE_MARKED, True), (PHONE_BARE, False)):
            for m in pattern.finditer(text):
                count = sum(c.isdigit() for c in m[0])
                if not 7 <= count <= 15:
                    continue
                before = text[max(0, m.start() - 60) : m.start()]
                if NOT_PHONE_BEFORE.search(before):
                    continue
                if marked or PHONE_BEFORE.search(before):
                    add("phone", *m.span())
    windows = _name_windows(text)
    for pattern in (NAME_TURNED, NAME_FORWARD):
        for a, b in windows:
            for m in pattern.finditer(text, a, b, overlapped=True):
                if pattern is NAME_TURNED and _GIVEN_BEFORE.search(text, max(0, m.start() - _GIVEN_REACH), m.start()):
                    continue  # the family name of another name: "Lena Berg, Ivo Stad"
                if _family_ok(m["given"], m["family"]):
                    add("person_name", *m.span())
    for a, b in _named_by_context(text):
        add("person_name", a, b)
    if _HAN.search(text):
        for m in NAME_HAN.finditer(text):
            add("person_name", *(m.span("before") if m["before"] else m.span("after")))
    names = sorted({text[a:b] for kind, a, b in out if kind == "person_name" and " " in text[a:b]})
    for a, b in _mentioned_again(text, names) if names else []:
        add("person_name", a, b)
    return sorted(out, key=lambda x: x[1])


FOUND_SCHEMA = "doc_id bigint, pii_type string, start_char int, end_char int"


def found_entities(docs: DataFrame) -> DataFrame:
    """(doc_id, pii_type, start_char, end_char) of every occurrence; no row twice.

    Whole texts, code points from 0.  Null and empty texts have none; extra
    columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *e) for k, t in zip(batch["doc_id"], batch["text"]) for e in find_entities(t)]
            if rows:
                out = pd.DataFrame(rows, columns=["doc_id", "pii_type", "start_char", "end_char"])
                yield out.astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, FOUND_SCHEMA).distinct()


def redact(text: str | None, entities: list[tuple[str, int, int]] | None = None) -> str | None:
    """The text with a typed placeholder for each entity."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b in entities if entities is not None else find_entities(text):
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join([*out, text[at:]])


def redacted_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text, entities): every row's text with placeholders, and how many were put in.  One pass, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [find_entities(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": [redact(t, e) for t, e in zip(batch["text"], found)], "entities": [len(e) for e in found]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, text string, entities int")


# --- surrogates ---------------------------------------------------------------

_SCRIPTS = (("han", regex.compile(r"\p{Han}")), ("cyrillic", regex.compile(r"\p{Cyrillic}")), ("greek", regex.compile(r"\p{Greek}")))
_SPELLED_AT = regex.compile(r"\s?@\s?|\s*[(\[{<]\s*at\s*[)\]}>]\s*|\s+at\s+", regex.I)
_SPELLED_DOT = regex.compile(r"\s*[(\[{]\s*(?:dot|punkt|point|punto)\s*[)\]}]\s*|\s+dot\s+|\.", regex.I)
_PARTS = frozenset(p for x in words.PARTICLES for p in x.split())


def script_of(text: str) -> str:
    return next((name for name, sign in _SCRIPTS if sign.search(text)), "latin")


def _name_parts(mention: str) -> tuple[str, str]:
    """(given, family) of a mention, lower case, without middle initials; the family name keeps its particles."""
    plain = unicodedata.normalize("NFKC", mention).casefold()
    if script_of(plain) == "han" and " " not in plain:
        n = 2 if plain[:2] in words.HAN_FAMILY_TWO else 1
        return plain[n:], plain[:n]
    if "," in plain:
        family, given = (x.split() for x in plain.split(",", 1))
        return (given or [""])[0], " ".join(family)
    given, *rest = plain.split()
    return given, " ".join(w for i, w in enumerate(rest) if not (w.endswith(".") and len(w) == 2) or i == len(rest) - 1)


def entity_key(kind: str, mention: str) -> str:
    """What makes two mentions the same entity: spelling, order and case do not."""
    plain = unicodedata.normalize("NFKC", mention).casefold()
    if kind == "email":
        return regex.sub(r"\s", "", _SPELLED_DOT.sub(".", _SPELLED_AT.sub("@", plain)))
    if kind == "phone":
        digits = regex.sub(r"\D", "", plain.replace("(0)", ""))
        return digits if "+" in plain else digits.lstrip("0") or digits
    if kind == "person_name":
        given, family = _name_parts(mention)
        return f"{given} {family}".strip()
    return regex.sub(r"[\W_]+", "", plain)


def _gender(given: str, before: str, after: str) -> str:
    """f, m or nothing, from the list, a title beside the name, or the ending that most such names have."""
    if given in words.GIVEN_F or given in words.GIVEN_M:
        return "f" if given in words.GIVEN_F else "m"
    last = before.casefold().split()[-1:]
    for gender, titles in words.TITLES.items():
        if last and last[0].lstrip("([\"") in titles:
            return gender
    if after.startswith(("先生",)):
        return "m"
    if after.startswith(("女士", "小姐")):
        return "f"
    return "f" if len(given) > 3 and given.endswith(("ia", "ina", "ella", "ette", "ия", "на", "ία")) else ""


def mentions_of(text: str | None) -> list[tuple[str, int, int, str, str, str]]:
    """(type, start, end, mention, entity, gender); an initial with a family name is the one full name of this text that it fits."""
    out = []
    full: dict[tuple[str, str], set[str]] = {}
    for kind, a, b in find_entities(text):
        mention, gender = text[a:b], ""
        if kind == "person_name":
            given, family = _name_parts(mention)
            gender = _gender(given, text[max(0, a - 24) : a], text[b : b + 2])
            if given and not given.endswith("."):
                full.setdefault((given[0], family), set()).add(given)
        out.append((kind, a, b, mention, entity_key(kind, mention), gender))
    for i, (kind, a, b, mention, key, gender) in enumerate(out):
        if kind == "person_name":
            given, family = _name_parts(mention)
            fits = full.get((given[:1], family), set()) if given.endswith(".") else set()
            if len(fits) == 1:
                known = next(iter(fits))
                out[i] = (kind, a, b, mention, f"{known} {family}", gender or _gender(known, "", ""))
    return out


def _stream(secret: str, kind: str, key: str, attempt: int):
    """Endless keyed numbers for one entity."""
    block, n = b"", 0
    while True:
        if not block:
            block = hashlib.blake2b(f"{kind}\x00{key}\x00{attempt}\x00{n}".encode(), key=hashlib.blake2b(secret.encode()).digest(), digest_size=64).digest()
            n += 1
        yield block[0] | block[1] << 8
        block = block[2:]


def _made_word(draw, syllables: int, script: str = "latin") -> str:
    onsets, rimes = words.SYLLABLES[script]
    return "".join(onsets[next(draw) % len(onsets)] + rimes[next(draw) % len(rimes)] for _ in range(syllables))


def _given_names(gender: str, script: str) -> list[str]:
    if script == "latin":
        return {"f": sorted(words.GIVEN_F), "m": sorted(words.GIVEN_M)}.get(gender, words.GIVEN_N)
    return words.GIVEN_BY_SCRIPT[script][gender]


def base_surrogate(secret: str, kind: str, key: str, gender: str, attempt: int) -> str:
    """The surrogate of an entity before it takes a mention's format.

    Digits become digits and letters letters; names become a given name of the
    same gender (one that says none where it is not known) and a made family
    name, in the same script, longer with each attempt.  Parts of a name are
    parted by "|".
    """
    draw, script = _stream(secret, kind, key, attempt), script_of(key)
    if kind == "person_name" and script == "han":
        signs = words.HAN_GIVEN[gender]
        return f"{''.join(signs[next(draw) % len(signs)] for _ in range(2 + attempt // 8))}||{words.HAN_FAMILY[next(draw) % len(words.HAN_FAMILY)]}"
    if kind == "person_name":
        pool = _given_names(gender, script)
        family = "-".join(_made_word(draw, 3 + attempt, script) for _ in key.rsplit(" ", 1)[-1].split("-"))
        return f"{pool[next(draw) % len(pool)]}|{_made_word(draw, 1, script)[:1]}|{family}"
    if kind == "email":
        return f"{_made_word(draw, 3 + attempt)}{next(draw) % 1000}@example.org"
    if kind == "address" and script == "han":
        return "".join(words.HAN_PLACES[next(draw) % len(words.HAN_PLACES)] for _ in range(24))
    if kind == "address":
        return f"{_made_word(draw, 3 + attempt, script)} {_made_word(draw, 2, script)}"
    out = [str(next(draw) % 10) if c.isdigit() else chr(97 + next(draw) % 26) if c.isascii() and c.isalpha() else c for c in key]
    # A format with few digits may be used up: then the number grows.
    return "".join([*out, *(str(next(draw) % 10) for _ in range(attempt // 8))])


def _like(pattern: str, word: str) -> str:
    return word.upper() if pattern.isupper() and len(pattern) > 1 else word.title() if pattern[:1].isupper() else word


def _render_name(mention: str, base: str) -> str:
    given, middle, family = base.split("|")
    if not middle:  # Han: as many signs as the mention has, more only where the surrogate grew
        return family + given[: max(len(mention) - 1, 1) + max(0, len(given) - 2)]
    pieces = regex.split(r"(,?\s+)", mention)
    turned = "," in mention
    names = [i for i in range(0, len(pieces), 2) if pieces[i].casefold() not in _PARTS]
    at_given = next((i for i in range(0, len(pieces), 2) if i and "," in pieces[i - 1]), names[-1]) if turned else names[0]
    at_family = max((i for i in names if not turned or i < at_given), default=names[-1])
    for i in names:
        word = pieces[i]
        initial = word.endswith(".") and len(word) == 2
        if i == at_given:
            pieces[i] = _like(word, given[:1]).upper() + "." if initial and word[0].isupper() else given[:1] + "." if initial else "-".join(_like(w, g) for w, g in zip(word.split("-"), [given, middle + "o"]))
        elif i == at_family:
            pieces[i] = "-".join(_like(w, f) for w, f in zip(word.split("-"), family.split("-"))) if word.count("-") == family.count("-") else _like(word, family)
        elif initial:
            pieces[i] = middle.upper() + "."
    return "".join(pieces)


def _render_address(mention: str, base: str) -> str:
    """Names of street and town are replaced; the form of the address, its kinds of street and the lengths of its numbers stay."""
    seed = iter(hashlib.blake2b(base.encode(), digest_size=64).digest())
    if script_of(mention) == "han":
        signs = iter(base)
        text = regex.sub(r"(\p{Han}+?)(?=市|省|区|县|路|街|大道|道|巷)(市|省|区|县|路|街|大道|道|巷)", lambda m: "".join(next(signs, "云") for _ in m[1]) + m[2], mention)
    else:
        names = iter(base.split(" ", 1))
        done: dict[str, str] = {}

        def word(m):
            w = m[0]
            low = w.casefold()
            for kinds in (words.STREETS_EN, words.STREETS_FR, words.STREETS_ES, words.ADDRESS_WORDS):
                if low.rstrip(".") in {k.casefold().rstrip(".") for k in kinds}:
                    return w
            end = next((k for k in words.STREETS_DE if low.endswith(k) and len(low) > len(k)), "")
            if low not in done:
                done[low] = next(names, base.rsplit(" ", 1)[-1])
            return _like(w, done[low] + end)

        text = regex.sub(r"\p{L}[\p{L}'’.-]+", word, mention)
    return regex.sub(r"\d", lambda m: str(1 + next(seed, 7) % 9), text)


def render(kind: str, mention: str, base: str) -> str:
    """The surrogate in the format of a mention: order, case, initials, particles, separators and grouping."""
    if kind == "person_name":
        return _render_name(mention, base)
    if kind == "email":
        local, domain = base.split("@")
        at = _SPELLED_AT.search(mention)
        dot = _SPELLED_DOT.search(mention, at.end() if at else 0)
        text = f"{local}{at[0] if at else '@'}{domain.replace('.', dot[0] if dot else '.')}"
        return text.upper() if mention.isupper() else text
    if kind == "address":
        return _render_address(mention, base)
    fresh = iter(c for c in base if c.isalnum())
    head, body = ("", mention)
    if kind == "phone" and mention.startswith("+"):
        m = regex.match(r"\+\d{1,3}(?=\D)(?:\s?\(0\))?", mention)
        head = m[0] if m else "+"
        body = mention[len(head) :]
        skip = sum(c.isdigit() for c in head.replace("(0)", ""))
        for _ in range(skip):
            next(fresh, None)
    out = []
    for c in body:
        if not c.isalnum():
            out.append(c)
            continue
        new = next(fresh, "7" if c.isdigit() else "q")
        if c.isdigit():
            out.append(new if new.isdigit() else str(ord(new) % 10))
        else:
            letter = new if new.isalpha() else chr(97 + int(new))
            out.append(letter.upper() if c.isupper() else letter)
    grown = len(base) - len(entity_key(kind, mention))
    return head + "".join([*out, *list(fresh)[:grown]] if grown > 0 else out)


FORM_SCHEMA = "pii_type string, entity string, attempt int, mention string, surrogate string, key string"


def _drawn(secret: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["surrogate"] = [render(k, m, base_surrogate(secret, k, e, g, int(a))) for k, e, g, m, a in zip(b["pii_type"], b["entity"], b["gender"], b["mention"], b["attempt"])]
            b["key"] = [entity_key(k, x) for k, x in zip(b["pii_type"], b["surrogate"])]
            yield b[["pii_type", "entity", "attempt", "mention", "surrogate", "key"]]

    return run


def distinct_surrogates(mentions: DataFrame, secret: str) -> DataFrame:
    """``mentions`` (pii_type, entity, mention, gender) to (pii_type, entity, mention, surrogate), one row per mention of an entity.

    What is checked is what will stand in the texts: no two entities share a
    surrogate in any of their forms (spelling and case apart), and none is an
    entity of the texts itself.  Of the entities that clash the smallest keeps
    its surrogate, the others draw again; each round touches only those, and
    the space of surrogates grows with the attempts, so the rounds end.
    """
    forms = stage(mentions.groupBy("pii_type", "entity", "mention").agg(F.max("gender").alias("gender")), "pii-forms")
    genders = forms.groupBy("pii_type", "entity").agg(F.max("gender").alias("gender"))
    forms = stage(forms.drop("gender").join(genders, ["pii_type", "entity"]), "pii-genders")
    real = stage(forms.select("pii_type", F.col("entity").alias("key")).distinct(), "pii-entities")
    pending = forms.withColumn("attempt", F.lit(0))
    kept: DataFrame | None = None
    taken = real
    while True:
        drawn = stage(pending.mapInPandas(_drawn(secret), FORM_SCHEMA), "pii-drawn")
        owners = drawn.groupBy("pii_type", "key").agg(F.min("entity").alias("owner"))
        lost = drawn.join(owners, ["pii_type", "key"]).where("entity <> owner").select("pii_type", "entity").union(drawn.join(taken, ["pii_type", "key"], "left_semi").select("pii_type", "entity")).distinct()
        lost = stage(lost, "pii-lost")
        good = drawn.join(lost, ["pii_type", "entity"], "left_anti")
        bigger = stage(good if kept is None else kept.unionByName(good), "pii-kept")
        if kept is not None:
            unstage(kept)
        kept = bigger
        again = lost.limit(1).count()
        if again:
            attempts = drawn.select("pii_type", "entity", (F.col("attempt") + 1).alias("attempt")).distinct().join(lost, ["pii_type", "entity"], "left_semi")
            pending = stage(forms.join(attempts, ["pii_type", "entity"]), "pii-pending")
            taken = real.unionByName(kept.select("pii_type", "key").distinct())
        unstage(drawn)
        if not again:
            return kept.select("pii_type", "entity", "mention", "surrogate")


def surrogate_documents(docs: DataFrame, secret: str) -> DataFrame:
    """(doc_id, text): every row's text with surrogates in place of its entities.

    One entity has one surrogate in all texts, drawn with ``secret``, which
    has no default: whoever knows it can test guesses.  Initials with a family
    name count as the full name that the same text gives.  Rows without
    entities keep their text; repeated doc_ids stay separate rows.
    """
    if not secret:
        raise ValueError("surrogates need a secret key")
    rows = stage(docs.select("doc_id", "text").withColumn("row_id", F.monotonically_increasing_id()), "pii-rows")

    def mentions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(r, *m) for r, t in zip(b["row_id"], b["text"]) for m in mentions_of(t)]
            yield pd.DataFrame(out, columns=["row_id", "pii_type", "a", "b", "mention", "entity", "gender"])

    found = stage(rows.select("row_id", "text").mapInPandas(mentions, "row_id bigint, pii_type string, a int, b int, mention string, entity string, gender string"), "pii-mentions")
    surrogates = distinct_surrogates(found, secret)
    per_row = found.join(surrogates, ["pii_type", "entity", "mention"]).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("a", "b", "surrogate"))).alias("parts"))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for t, parts in zip(b["text"], b["parts"]):
                if t is None or parts is None:
                    texts.append(t)
                    continue
                out, at = [], 0
                for p in parts:
                    out += [t[at : p["a"]], p["surrogate"]]
                    at = p["b"]
                texts.append("".join([*out, t[at:]]))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text": texts})

    return rows.join(per_row, "row_id", "left").select("doc_id", "text", "parts").mapInPandas(put, "doc_id bigint, text string")
