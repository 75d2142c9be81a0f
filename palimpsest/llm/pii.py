"""Personal information in free text, found by weak supervision.

1. Generators propose spans of five kinds in each whole text.  For names they
   are any run of capitalised words, initials and particles, and where case says
   nothing (text all in lower case or all in capitals) a listed given name with
   the next word, or two words after a title or label.
2. Three labelers vote on every span: its shape (regular expressions), gazetteers
   (public lists of given names and surnames, street words, document and dialling
   prefixes, mail domains) and the context (the neighbouring words).  None of them
   decides alone: a name on no list is found by its shape and its neighbours.
3. Expectation-maximisation over the counts of vote patterns estimates each
   labeler's reliability, with no labels.  A pattern is a handful of small
   numbers, so the table of counts is bounded (below ``MAX_PATTERNS``) however
   large the corpus; it counts every span of every text.
4. A span classifier, a logistic regression over hashed features (letter shape,
   beginnings and endings of the words, length, neighbouring words, votes), is
   trained on the posteriors of at most ``MAX_TRAINING`` spans, chosen by hash over
   all texts.  Half of its training rows hide the gazetteer's vote, so that
   endings and neighbours have to carry names that no list holds.
5. Every span is scored.  Accepted ones are kept; overlaps go to the likelier,
   then the longer.

Neighbouring words are those within ``BEFORE`` and ``AFTER`` characters of a span.
Null and empty texts have no spans.  A record's repeated item counts once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import durable

KINDS = ["email", "phone", "id_number", "street_address", "person_name"]
BEFORE, AFTER = 48, 32
MAX_TRAINING = 40_000
# Shares of votes against, abstentions and votes for that are expected of a labeler, over spans that are not real and real ones; weight of this expectation.
FAIR = [(0.25, 0.70, 0.05), (0.01, 0.30, 0.69)]
TRUST = 0.5
REAL_SHARE = 0.5
# A labeler votes against at most this share of the real spans.
WRONG_AGAINST = 0.005
WEIGHTS = 1 << 16

# Gazetteers.  Given names and surnames are common ones of public registers of several countries.
GIVEN = (
    "Alice Amira Ana Andrea Andrew Anika Anna Anthony Anton Ashley Ayumi Barbara Ben Betty Björn Brian Bruno Carlos Carol Charles Chiara Chloé Christopher Claire Clara Daniel David Deborah Diego Donald Donna Dorothy "
    "Edward Elena Elizabeth Emil Emily Emma Eva Fatima Felix George Giulia Grace Greta Hanna Hans Helen Henrik Hiroshi Hugo Ingrid Irene Isabel James Jan Jennifer Jessica Jin John Jonas José Joseph Joshua Juan Julia "
    "Karen Karl Kenneth Kevin Kimberly Kwame Laura Leila Lena Leon Linda Lisa Lucas Łucja Luis Margaret Marek Maria Mario Mark Marta Mary Mateo Matthew Mei Melissa Michael Michelle Mina Mohammed Nadia Nancy Nils Noah Nora "
    "Olga Omar Oscar Patricia Paul Paula Pavel Peter Pierre Priya Rahul Richard Robert Ronald Rosa Rose Samuel Sandra Sanna Sara Sarah Sofia Sophie Stefan Stephanie Steven Susan Tariq Thomas Timothy Tobias Viktor Wanda Wei Will William Yuki Zara Zoé"
).split()
SURNAMES = (
    "Adams Ali Allen Anderson Andersson Baker Bauer Becker Bernard Bianchi Brown Campbell Carter Chen Clark Costa Davis Díaz Dubois Durand Esposito Evans Fernández Ferrari Fischer García Gómez González Green Hall Hansen Harris "
    "Hernández Hill Hoffmann Horvat Ivanov Jackson Jansen Jensen Johansson Johnson Jones Khan Kim King Klein Koch Kowalski Kumar Lee Lewis Li Liu López Martin Martínez Meyer Miller Mitchell Moore Moreau Müller Nakamura Nelson "
    "Nguyen Novák Nowak Oliveira Park Patel Pérez Petit Petrov Phillips Popov Ramírez Richter Rivera Roberts Robinson Rodríguez Romano Rossi Russo Sánchez Santos Sato Schmidt Schneider Schulz Scott Sharma Silva Singh Smith "
    "Suzuki Tanaka Taylor Thompson Torres Tran Turner Wagner Walker Wang Watanabe Weber White Williams Wilson Wolf Wright Yamamoto Yang Yılmaz Young Zhang"
).split()
PARTICLES = "von van de der den del della di da la le du dos bin ibn".split()
TITLES = "Mr Mrs Ms Mx Dr Prof Herr Frau Señor Señora Sr Sra M Mme Mlle Sir Dame".split()
# Words that are part of no name, of which a run of capitals may begin or end with one.
NOT_NAMES = (
    "a about after again all also am an and any are as at auf aus avec be because before bei bitte but by call called can cc como con contact could cuando dans das de del dem den der des die did do does don't donde dr du each ein eine el elle en er es est et every "
    "för för for from für gestern had has hasta hay he her here heute hier his how i ich if il im in is ist it its je la las later le les lo los mais many may met mi mit mon more most must my new nicht no nobody not now nous of on once only or order otra our para pero please por "
    "pour project projekt que qui remember said send set she si sie sin so some sobre son spoke such su the their then there these they this those though to today tomorrow un und una une until user very von was we what when where which while who why wie will wir with yes yesterday you your zu zum zur "
    "team group department office company inc ltd gmbh llc form list table file "
    "monday tuesday wednesday thursday friday saturday sunday montag dienstag mittwoch donnerstag freitag samstag sonntag"
).split()
STREET_AFTER = "Street St Road Rd Avenue Ave Lane Ln Close Court Ct Terrace Ter Drive Dr Boulevard Blvd Way Place Pl Square Sq Crescent Row Walk".split()
STREET_BEFORE_NUMBER = "Calle Avenida Avda Plaza Paseo Camino Carrera Ronda Via Piazza".split()
STREET_AFTER_NUMBER = "rue avenue boulevard place impasse chemin allée quai cours square passage route".split()
GERMAN_ENDS = "straße strasse str weg gasse allee platz stieg steig ring damm ufer graben hof".split()
GERMAN_STARTS = ["Am", "An der", "Auf der", "Im", "In der", "Zum", "Zur", "Unter den"]
DOCUMENTS = (
    r"passport|travel\s+document|ssn|social\s+security|soc\.?\s*sec\.?|tax\s+id|tin|national\s+id(?:entity)?|identity\s+card|id\s+card|personal\s+id|national\s+insurance|nhs|"
    r"licen[cs]e|insured\s+person|insurance|steuer-?id|steuernummer|personalausweis|reisepass|dni|nie|nif|pasaporte|passeport|carte\s+d'identité|num[ée]ro\s+de\s+sécurité\s+sociale"
)

PHONE_BEFORE = r"(?:tel|tél|phone|call|text|appeler|au|llama\s+al|al|number\s+is|not|contact|mobile|cell|fon|ruf|fax|ring|dial|reach|or|oder|ou|o)\W*$"
NOT_PERSONAL = r"\b(?:isbn|lot\s+number|order|job|hash|ticket|reference|batch|row|version|port|mask|build|invoice|sku|serial|sprint|commit)\W*(?:\w+\W+)?$"
NAME_BEFORE = r"(?:\b(?:mr|mrs|ms|mx|dr|prof|herr|frau|sir|dame|señora?|mme|mlle|met|with|by|for|and|y|et|und|called|named|name is|dear|hi|hello|contact|from|attn|cc|user|author|owner|patient|client|employee|bitte|call|an|avec|appeler|monsieur|madame|por|para|lists?|kontakt|gift\s+for|signed|says|said|ask|asked|tell|told)[.:]?\s+|\b(?:name|contact|owner|author|patient|client|employee|list|standup|attendees|participants|from|to|cc|signed|regards|cheers|thanks)\s*[:=,]\s*|[>;]\s+|\(\s*)$"
NAME_AFTER = r"^(?:['’]s\b|\W{0,3}<|\s*\(|,?\s+(?:is|was|has|will|wants|wrote|writes|said|says|asked|asks|told|confirmed|called|calls|moved|lives|works|joined|left|sent|signed|agreed|wohnt|sagt|hat|ist|vit|habite|a\s+dit|vive|dijo)\b|,\s*(?:tel|tél|phone|ssn|licen[cs]e|passport|tax|born|dob|email|e-mail|\d|[\w.+%'-]+\s?(?:@|[\[(]\s?at\b| at ))|\s*[;,]?\s*(?:tel|tél|phone|cell|mobile)\b)"
# Words just before and after the captions of things.
CAPTION_BEFORE = r"\b(?:reads|labell?ed|titled|button|menu|heading|column|checkbox)\b(?:\W+\w+){0,3}\W*$"
CAPTION_AFTER = r"^(?:\W?\s*(?:board|bank)\b|(?:\W+\w+){0,4}?\W+(?:labels?|buttons?|captions?|headings?|menus?)\b)"

_S = r"[ \t\u00a0\u2003]"
_GAP = rf"(?:{_S}{{1,3}}|{_S}*\n{_S}*)"
_alt = lambda words: "|".join(sorted(map(regex.escape, words), key=len, reverse=True))

EMAIL = regex.compile(
    r"(?<![\w.+-])[\w.+%'-]+(?:\s?@\s?|\s?[\[(]\s?at\s?[\])]\s?)[\w-]+(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)[\w-]+)+|(?<![\w.+-])[\w.+%'-]+ at [\w-]+(?: dot [\w-]+)+", regex.I
)
_EXT = r"(?:,?\s?(?:ext\.?|extension|x|durchwahl|dw\.?|poste|#)\s?\d{1,5}\b)?"
PHONE = regex.compile(
    r"(?<![\w.+/-])(?<!\d[ ])(?:"
    r"(?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+1\d{10}"
    r"|(?:(?:\+|00)\d{1,3}[ .-]?(?:\(0\)[ .-]?)?|0|\(0)\d{2,4}\)?[ ./-]?\d{3,5}(?:[ ./-]?\d{1,4}){0,3}"
    r"|\+\d{1,3}(?:[ .()/-]{0,2}\d{2,5}){2,5}|\d{7,12})" + _EXT + r"(?![\w/])(?!-\d)(?!\.\d)",
    regex.I,
)
PHONE_SHAPE = regex.compile(
    r"(?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+1\d{10}|(?:\+44[ -]?|0044[ -]?|0)(?:\(0\)[ -]?)?7\d{3}[ -]?\d{3}[ -]?\d{3}"
    r"|(?:\+61[ -]?|0061[ -]?|0)(?:\(0\)[ -]?)?4\d{2}[ -]?\d{3}[ -]?\d{3}|(?:\+49[ -]?(?:\(0\)[ -]?)?|0049[ -]?|\(?0)[1-9]\d{1,3}\)?[ /-]?\d{5}[ -]?\d{3}|\+\d{1,3}[ \d()./-]{7,16}"
)
ID_NUMBER = regex.compile(
    r"(?<![\w.+/-])(?:\p{Lu}{3}\d{7}-?\p{Lu}\d{2}|\p{L} ?\d{7,9}|\d{3}[- ]?\d{2}[- ]?\d{4}|\d{2} ?\d{3} ?\d{3} ?\d{3}|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{6}-\d{5}|\p{Lu}{2}\d{6}\p{Lu}?|\d{8}\p{Lu})(?![\w/])(?!-\w)(?!\.\d)", regex.I
)
ID_BEFORE = regex.compile(rf"\b(?:{DOCUMENTS})\b\.?(?:\s+(?:no|nr|num|number|n\.?º)\b\.?)?\s*(?:is)?\s*[:#=]?\s*$", regex.I)
_NO = r"\d{1,4}(?:\s?[a-z]\b)?"
_NUMBER_FIRST = (
    rf"\d{{1,4}}[a-z]?{_GAP}(?:(?:[NSEW]\.?|North|South|East|West){_GAP})?(?:[\p{{L}}'’-]+{_GAP}){{1,2}}?(?:{_alt(STREET_AFTER)})\b\.?"
    rf"|\d{{1,4}}[a-z]?(?:{_S}(?:bis|ter))?,?{_GAP}(?:{_alt(STREET_AFTER_NUMBER)}){_GAP}(?:(?:de|du|des|la|le|les|l['’]|d['’]){_GAP}?){{0,2}}(?:(?:vieux|vieille|grand|grande|petit|petite|belle|saint|sainte|haut|haute){_GAP})?[\p{{L}}'’-]+(?-i:{_S}\p{{Lu}}[\p{{L}}'’-]+)?"
)
_WORDS_FIRST = (
    rf"(?:{_alt(STREET_BEFORE_NUMBER)}){_GAP}(?:(?:de|del|la|las|los|el){_GAP}){{0,2}}[\p{{L}}'’-]+,?{_GAP}(?:n\.?º{_S}?)?\d{{1,4}}[a-z]?\b"
    rf"|\p{{L}}+(?:{_alt(GERMAN_ENDS)})(?<![aeiou]ring|\b\p{{L}}{{1,2}}ring)\.?{_GAP}\d{{1,4}}[a-z]?\b|(?:{_alt(GERMAN_STARTS)}){_GAP}\p{{L}}+{_GAP}\d{{1,4}}[a-z]?\b"
)
ADDRESS = regex.compile(rf"(?<![\w.])(?:{_NUMBER_FIRST}|{_WORDS_FIRST})", regex.I)
# Most texts with a number hold none of the words that an address can begin with; then only numbers can.
ADDRESS_BY_NUMBER = regex.compile(rf"(?<![\w.])(?:{_NUMBER_FIRST})", regex.I)
WORDS_FIRST_HINT = regex.compile(rf"(?:{_alt(GERMAN_ENDS)})\.?{_GAP}\d|\b(?:{_alt(STREET_BEFORE_NUMBER)})\s|\b(?:{_alt(GERMAN_STARTS)})\s+\p{{L}}+\s+\d", regex.I)
_WORD = r"\p{Lu}[\p{L}\p{M}'’]+(?:-\p{Lu}[\p{L}\p{M}'’]+)*"
_INITIAL = r"\p{Lu}\."
# Capitalised words with initials and particles among them; a comma only after the first word (surname, given name).
RUN = regex.compile(rf"(?<![\w@.+-])(?:{_WORD}|{_INITIAL})(?:(?:(?<=\p{{L}}),)?{_GAP}(?:{_WORD}|{_INITIAL}|(?:{_alt(PARTICLES)})(?={_GAP}\p{{L}})))*(?:(?<=\p{{L}}),)?{_GAP}(?:{_WORD}|{_INITIAL})(?![\w@])")
_RUN_PART = regex.compile(rf"({_WORD}|{_INITIAL}|(?:{_alt(PARTICLES)})\b)(,?)")
_SHOUTED = regex.compile(r"(?<![\p{L}'’-])\p{Lu}[\p{Lu}'’-]+(?![\p{L}'’-])")
_CAPITAL = regex.compile(r"(?<!\w)\p{Lu}\p{L}")
_INITIALED = regex.compile(r"\b\p{Lu}\.")
_LOWER_WORD = re.compile(r"[^\W\d_]+")
_NEXT = regex.compile(rf"(?:{_GAP}\p{{L}}\.)*{_GAP}(?:(?:{_alt(PARTICLES)}){_GAP})*\p{{L}}[\p{{L}}\p{{M}}'’]+(?:-\p{{L}}[\p{{L}}\p{{M}}'’]+)*(?![\w@])", regex.I)
_PRECEDING = regex.compile(rf"(?<![\w@.+-])(?:(?:{_alt(PARTICLES)}){_GAP})*(\p{{L}}[\p{{L}}\p{{M}}'’]+(?:-\p{{L}}[\p{{L}}\p{{M}}'’]+)*),{_GAP}$", regex.I)
_ADDRESS_PART, _ADDRESS_REST = regex.compile(r"[@.+_-]$"), regex.compile(r"[@_+-]|\.\w")
_TRAILING = regex.compile(rf"(?:{_GAP}\p{{L}}\.)*(?![\w@])")
_LABELLED = regex.compile(rf"(?<!\w)(?:(?:mr|mrs|ms|mx|dr|prof|herr|frau|mme)\.?|(?:name|patient|client|employee)\s*[:=]|name is|is called)\s+(\p{{L}}[\p{{L}}\p{{M}}'’-]+{_GAP}(?:\p{{L}}\.{_GAP})*\p{{L}}[\p{{L}}\p{{M}}'’-]+)(?![\w@])", regex.I)
_LABELS = ("name", "mr", "ms", "mx", "mme", "dr", "prof", "herr", "frau", "is called", "patient", "client", "employee")
_GIVEN, _SURNAMES, _PARTICLES = ({w.lower() for w in words} for words in (GIVEN, SURNAMES, PARTICLES))
_STREET_WORDS = {w.lower() for w in STREET_AFTER + STREET_BEFORE_NUMBER + STREET_AFTER_NUMBER}
_NO_NAME = {*NOT_NAMES, *(t.lower() for t in TITLES), *_STREET_WORDS} - {"may", "will", "mark"}
_STREET_RE = regex.compile(rf"\b(?:{_alt(STREET_AFTER + STREET_BEFORE_NUMBER + STREET_AFTER_NUMBER + GERMAN_STARTS)})\b|(?:{_alt(GERMAN_ENDS)})\b", regex.I)
_NOT = regex.compile(NOT_PERSONAL, regex.I)
_PHONE_BEFORE, _NAME_BEFORE, _NAME_AFTER, _CAPTION_BEFORE, _CAPTION_AFTER = (regex.compile(p, regex.I) for p in (PHONE_BEFORE, NAME_BEFORE, NAME_AFTER, CAPTION_BEFORE, CAPTION_AFTER))
_ADDRESS_AROUND = regex.compile(r"(?:at|to|au|en|jetzt|address\W*|an|ship|near|lives?|wohnt.*|es|in|,|=|:)\W*$", regex.I)
_DIGIT = re.compile(r"\d")
# No telephone or identity number has fewer digits.
_SIX_DIGITS = re.compile(r"\d(?:[ .()/-]{0,3}\d){5}")
_AT = regex.compile(r"@|\bat\b", regex.I)
_PIECES = regex.compile(r"\p{L}+\.?|\d+")
_MAIL_END = regex.compile(r"(?:[.\])]|dot)\s?[a-z]{2,}$", regex.I)
_EXTENSION = regex.compile(r",?\s?(?:ext\.?|extension|x|durchwahl|dw\.?|poste|#)\s?\d+$", regex.I)
_US = regex.compile(r"1?[ (]*\d{3}\D+\d{3}\D+\d{4}")
_ID_SHAPE = regex.compile(r"\p{Lu}{3}\d{7}-?\p{Lu}\d{2}|\d{3}-\d{2}-\d{4}|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{6}-\d{5}")
_LAST_WORDS = regex.compile(r"[\p{L}\d@<(=:]+")


def _votes(kind: str, item: str, before: str, after: str) -> tuple[int, int, int, int]:
    """Shape, gazetteer and context votes: 0 (against), 1 (abstains), 2 (for); and a feature (0 to 3)."""
    if kind == "person_name":
        words = [w.lower() for w in _LOWER_WORD.findall(item)]
        long = [w for w in words if len(w) > 1 and w not in _PARTICLES]
        listed = any(w in _GIVEN for w in long) or any(w in _SURNAMES for w in long)
        caseless = item == item.lower() or item == item.upper()
        context = 0 if _CAPTION_BEFORE.search(before) or _CAPTION_AFTER.search(after) else 2 if _NAME_BEFORE.search(before) or _NAME_AFTER.search(after) else 1
        # A given name behind a word that is on no list: the name begins there.
        late = "," not in item and long and long[0] not in _GIVEN and long[0] not in _SURNAMES and any(w in _GIVEN for w in long[1:])
        return 0 if late or len(long) > 3 else 2 if _INITIALED.search(item) else 1, 2 if listed else 1, context, 3 if caseless else 2 if "," in item else int("." in item)
    bad = 0 if _NOT.search(before) else 1
    if kind == "email":
        tail = item.rsplit(".", 1)[-1].rsplit(" ", 1)[-1].lower()
        return 2 if _MAIL_END.search(item) else 0, 2 if tail in ("com", "org", "net", "example", "test", "invalid", "de", "fr", "es", "uk", "edu", "io") else 1, 0 if after.startswith((":", "/")) else 2, min(3, item.count("."))
    if kind == "phone":
        digits = sum(c.isdigit() for c in item)
        shape = 2 if PHONE_SHAPE.fullmatch(_EXTENSION.sub("", item)) else 0
        gaz = 2 if item.startswith(("+", "00", "0", "(0", "(")) else 1 if _US.match(item) else 0
        context = 0 if not bad or ID_BEFORE.search(before) else 2 if _PHONE_BEFORE.search(before) else 1
        return shape, gaz, context, 0 if digits < 9 else 1 if digits < 14 else 2
    if kind == "id_number":
        label = bool(ID_BEFORE.search(before))
        return 2 if _ID_SHAPE.fullmatch(item) else 1, 2 if label else 0, 0 if not bad else 2 if label else 1, 0
    return 2 if _DIGIT.search(item) else 0, 2 if _STREET_RE.search(item) else 0, 2 if _ADDRESS_AROUND.search(before) else 1, min(3, item.count(" "))


def _names(text: str, low: str, words: list[str]) -> set[tuple[int, int]]:
    """Where a name may stand."""
    out: set[tuple[int, int]] = set()
    # Where nearly every word has a capital, capitals say nothing.
    n = len(words)
    told = n < 12 or len(_CAPITAL.findall(text)) < 0.6 * n
    for run in RUN.finditer(text) if told else ():
        part: list[tuple[int, int, str, bool]] = []
        parts = [part]
        for m in _RUN_PART.finditer(text, run.start(), run.end()):
            word = m[1].lower()
            if word.rstrip(".") in _NO_NAME and word not in _PARTICLES and not (len(word) == 2 and word[1] == "."):
                part = []
                parts.append(part)
            else:
                part.append((m.start(), m.end(1), word, bool(m[2])))
        for part in parts:
            # Runs of words that are all capitals or very long say nothing by their case.
            if len(part) > 8:
                continue
            for i in range(len(part)):
                long = 0
                # An initial behind a word belongs to it.
                if i and part[i][2].endswith(".") and not part[i - 1][2].endswith("."):
                    continue
                for j in range(i, min(i + 6, len(part))):
                    start, end, word, _ = part[j]
                    name_word = not word.endswith(".") and word not in _PARTICLES
                    long += name_word
                    if part[i][2] in _PARTICLES and j == i:
                        continue
                    turned = any(c for *_, c in part[i:j])
                    if j > i and part[j - 1][3] and word in _PARTICLES:
                        break
                    if turned and any(c for *_, c in part[i + 1 : j]) and part[i][2] not in _PARTICLES:
                        break
                    # Words all in capitals say nothing: names of them are looked for below.
                    if j > i and not _SHOUTED.search(text, part[i][0], end) and 1 <= long <= 4 and (name_word or turned) and (long > 1 or word.endswith(".") or part[i][2].endswith(".")):
                        out.add((part[i][0], end))
    if len(low) == len(text) and not _GIVEN.isdisjoint(words):
        for m in _LOWER_WORD.finditer(low):
            if m[0] in _GIVEN and not _ADDRESS_PART.search(text, max(0, m.start() - 1), m.start()) and not _ADDRESS_REST.match(text, m.end()):
                capital = text[m.start()].isupper()
                n = _NEXT.match(text, m.end())
                if n and _LOWER_WORD.findall(n[0].lower())[-1] not in _NO_NAME and (not capital or _LOWER_WORD.findall(n[0])[-1][0].isupper()):
                    out.add((m.start(), n.end()))
                before = _PRECEDING.search(text, max(0, m.start() - 60), m.start())
                if before and before[1].lower() not in _NO_NAME and before[1][0].isupper() == capital:
                    out.add((before.start(), _TRAILING.match(text, m.end()).end() if _TRAILING.match(text, m.end()) else m.end()))
    for m in _LABELLED.finditer(text) if any(x in low for x in _LABELS) else ():
        if not any(w in _NO_NAME for w in _LOWER_WORD.findall(m[1].lower())):
            out.add(m.span(1))
    return out


def _hash(kind: str, name: str) -> int:
    return zlib.crc32(f"{kind}|{name}".encode()) % WEIGHTS


def _shape(item: str) -> str:
    """Letters, capitals and digits as a, A and 9, runs of them once."""
    out, last = [], ""
    for c in item[:60]:
        k = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else " " if c.isspace() else c
        if k != last:
            out.append(k)
        last = k
    return "".join(out)


def _features(kind: str, item: str, before: str, after: str, votes: tuple[int, int, int, int]) -> list[int]:
    """Hashed features; the first is the gazetteer's vote, which training may hide."""
    words = _PIECES.findall(item)
    names = [f"gaz{votes[1]}", "", f"shape{votes[0]}", f"context{votes[2]}", f"form{votes[3]}", "s" + _shape(item), f"n{min(6, len(words))}", f"l{min(12, len(item) // 4)}"]
    for at, w in (("f", words[0]), ("l", words[-1])) if words else ():
        low = w.lower()
        names += [f"{at}p{low[:3]}", f"{at}s{low[-3:]}", f"{at}e{low[-4:]}", f"{at}n{min(10, len(low))}"]
    left, right = _LAST_WORDS.findall(before.lower()), _LAST_WORDS.findall(after.lower())
    names += [f"b{left[-1] if left else ''}", f"bb{' '.join(left[-2:])}", f"a{right[0] if right else ''}", f"bc{before.strip()[-1:]}", f"ac{after.strip()[:1]}"]
    return [_hash(kind, n) for n in names]


def propose(text: str | None) -> list[tuple[str, int, int, str, list[int]]]:
    """Spans of a text: (kind, start, end, vote pattern, features)."""
    if not text:
        return []
    low = text.lower()
    words = _LOWER_WORD.findall(low)
    found = [("person_name", start, end) for start, end in sorted(_names(text, low, words))]
    # The searches below only run where they can succeed.
    searches = [("email", EMAIL)] if _AT.search(text) else []
    if _DIGIT.search(text):
        if _SIX_DIGITS.search(text):
            searches += [("phone", PHONE), ("id_number", ID_NUMBER)]
        if WORDS_FIRST_HINT.search(text):
            searches.append(("street_address", ADDRESS))
        elif not _STREET_WORDS.isdisjoint(words):
            searches.append(("street_address", ADDRESS_BY_NUMBER))
    for kind, pattern in searches:
        for m in pattern.finditer(text):
            start, end = m.span()
            if kind == "email":
                end -= len(m[0]) - len(m[0].rstrip(".'-"))
            elif kind == "phone" and m[0].startswith("(") and ")" not in m[0]:
                start += 1
            found.append((kind, start, end))
    out = []
    for kind, start, end in found:
        item, before, after = text[start:end], text[max(0, start - BEFORE) : start], text[end : end + AFTER]
        votes = _votes(kind, item, before, after)
        out.append((kind, start, end, kind + ":" + "".join(map(str, votes)), _features(kind, item, before, after, votes)))
    return out


MAX_PATTERNS = len(KINDS) * 3**3 * 4


def fit_labelers(patterns: dict[str, int], rounds: int = 60) -> tuple[dict[str, float], dict[str, dict]]:
    """Posterior that a span is real, per vote pattern, and each kind's estimated reliabilities.

    Two classes, labelers independent given the class.
    """
    posterior, reliability = {}, {}
    for kind in KINDS:
        own = {p: n for p, n in patterns.items() if p.startswith(kind + ":")}
        if not own:
            continue
        votes = np.array([[int(c) for c in p.split(":")[1][:3]] for p in own])
        n = np.array(list(own.values()), float)
        # One vote beyond a first and none against starts as likely.
        q = 1 / (1 + np.exp(-(1.5 * ((votes == 2).sum(1) - 1) - 2.0 * (votes == 0).sum(1))))
        for _ in range(rounds):
            prior = (1 - TRUST) * (n @ q) / n.sum() + TRUST * REAL_SHARE
            table, seen = np.empty((2, 3, 3)), np.empty((2, 3, 3))
            for c, w in ((1, n * q), (0, n * (1 - q))):
                for lab in range(3):
                    counts = np.array([w[votes[:, lab] == v].sum() for v in range(3)])
                    # Halfway between the counts and what any fair labeler does, so that the classes cannot change sides.
                    seen[c, lab] = counts / max(counts.sum(), 1e-9)
                    table[c, lab] = (1 - TRUST) * seen[c, lab] + TRUST * np.array(FAIR[c])
                    if c and table[c, lab, 0] > WRONG_AGAINST:
                        table[c, lab] *= (1 - WRONG_AGAINST) / (1 - table[c, lab, 0])
                        table[c, lab, 0] = WRONG_AGAINST
            logs = [np.log(prior if c else 1 - prior) + sum(np.log(table[c, lab, votes[:, lab]]) for lab in range(3)) for c in (0, 1)]
            q = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -40, 40)))
        posterior |= dict(zip(own, q))
        reliability[kind] = {"prior": float(prior), "for": seen[1, :, 2].tolist(), "against": seen[0, :, 0].tolist()}
    return posterior, reliability


def train_classifier(features: list[list[int]], targets: np.ndarray, epochs: int = 6, rate: float = 0.3, seed: int = 7) -> np.ndarray:
    """Logistic regression on soft targets by adaptive gradient steps; one weight per hashed feature.

    Half of the rows, drawn anew each epoch, go without their first feature.
    """
    weights, squares = np.zeros(WEIGHTS), np.full(WEIGHTS, 1e-2)
    if not features:
        return weights
    rng = np.random.default_rng(seed)
    width = max(map(len, features))
    # Shorter rows are filled with a place whose weight stays 0.
    x = np.full((len(features), width), WEIGHTS)
    for i, f in enumerate(features):
        x[i, : len(f)] = f
    weights, squares = np.append(weights, 0.0), np.append(squares, 1.0)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            rows = x[order[at : at + 128]].copy()
            rows[rng.random(len(rows)) < 0.5, 0] = WEIGHTS
            p = 1 / (1 + np.exp(-np.clip(weights[rows].sum(1), -30, 30)))
            error = np.repeat((p - targets[order[at : at + 128]])[:, None], width, 1)
            grad = np.bincount(rows.ravel(), error.ravel(), WEIGHTS + 1)
            grad[WEIGHTS] = 0
            hit = np.flatnonzero(grad)
            grad = grad[hit] + 1e-3 * weights[hit]
            squares[hit] += grad**2
            weights[hit] -= rate * grad / np.sqrt(squares[hit])
    return weights[:WEIGHTS]


SPAN = "kind:string,start:int,end:int,item:string,pattern:string,features:array<int>"
FOUND = "record_table string, record_id string, spans array<struct<kind:string,start:int,end:int,item:string,p:double>>"


def _propose_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        spans = [[{"kind": k, "start": s, "end": e, "item": t[s:e], "pattern": p, "features": f} for k, s, e, p, f in propose(t)] for t in pdf.content]
        out = pd.DataFrame({"record_table": pdf.record_table, "record_id": pdf.record_id, "spans": spans})
        yield out[out.spans.map(len) > 0]


def _score_batches(weights):
    """Keep each record's accepted spans; where they overlap the likelier, then the longer, then the first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = weights.value
        for pdf in batches:
            chosen = []
            for spans in pdf.spans:
                scored = [(float(1 / (1 + np.exp(-np.clip(w[s["features"]].sum(), -30, 30)))), s) for s in spans]
                taken: list = []
                for p, s in sorted((x for x in scored if x[0] >= 0.5), key=lambda x: (-round(x[0], 2), x[1]["start"] - x[1]["end"], x[1]["start"], x[1]["kind"])):
                    if all(s["end"] <= t["start"] or t["end"] <= s["start"] for t in taken):
                        taken.append({"kind": s["kind"], "start": s["start"], "end": s["end"], "item": s["item"], "p": p})
                chosen.append(sorted(taken, key=lambda s: s["start"]))
            yield pd.DataFrame({"record_table": pdf.record_table, "record_id": pdf.record_id, "spans": chosen})

    return run


def find_personal(records: DataFrame, max_training: int = MAX_TRAINING) -> tuple[DataFrame, dict[str, dict]]:
    """Spans per record (record_table, record_id, spans) and the labelers' estimated reliabilities.

    ``records`` has record_table, record_id, content, one row per record.
    """
    spark = records.sparkSession
    spans = durable(records.where("content is not null").select("record_table", "record_id", "content").mapInPandas(_propose_batches, f"record_table string, record_id string, spans array<struct<{SPAN}>>"))
    counted = spans.select(F.explode("spans.pattern").alias("pattern")).groupBy("pattern").count().limit(MAX_PATTERNS).collect()
    patterns = {r["pattern"]: r["count"] for r in counted}
    posterior, reliability = fit_labelers(patterns)
    # As large a share of the records, by hash, as gives about so many spans; the limit makes the bound sure.
    share = min(1.0, max_training / max(1, sum(patterns.values())))
    some = spans.where(F.pmod(F.xxhash64("record_table", "record_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    taught = some.select(F.explode("spans").alias("s")).select("s.pattern", "s.features").orderBy(F.xxhash64("features"), "pattern").limit(max_training).toPandas()
    weights = train_classifier([list(f) for f in taught.features], np.array([posterior[p] for p in taught.pattern]))
    # A fixed number of weights.
    shared = spark.sparkContext.broadcast(weights)
    return spans.mapInPandas(_score_batches(shared), FOUND), reliability


def masked(records: DataFrame, spans: DataFrame) -> DataFrame:
    """The records with each item replaced by a placeholder of its kind, e.g. [EMAIL]; other text unchanged."""
    joined = records.join(spans, ["record_table", "record_id"], "left")
    # Spans are in order and apart: copy the text up to each, then its placeholder.
    step = lambda acc, s: F.struct(
        F.concat(acc["text"], F.substring(F.col("content"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("text"), s["end"].alias("at")
    )
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    done = lambda acc: F.concat(acc["text"], F.substring(F.col("content"), acc["at"] + 1, F.length(F.col("content"))))
    text = F.when(F.col("spans").isNull(), F.col("content")).otherwise(F.aggregate("spans", start, step, done))
    return joined.select("record_table", "record_id", text.alias("content"), F.coalesce(F.size("spans"), F.lit(0)).alias("n_items"))
