"""Personal data in free text: weak labelers vote on candidate spans, expectation-maximisation weighs the labelers, and
a final classifier decides every span.

1. One pass over all texts proposes spans (broad patterns for addresses, numbers, e-mail, and runs of capitalised words).
2. Names: from the runs of all texts it is counted how often a word follows a known given name, precedes a likely family
   name and so on; words become likely given or family names by these counts, and spans are cut from the runs by class.
3. Labelers (formats, word lists, learned names, cue words on either side, counter-cues) vote for, against, or abstain.
   The votes are counted by pattern; EM over the counts estimates how reliable each labeler is, without any labels.
4. A logistic classifier is trained on a bounded sample of spans with the posteriors as soft labels, and applied to all.

Only pattern counts, the sample and the weights reach the driver; word counts stay distributed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import stage

KINDS = ["EMAIL", "ID_NUMBER", "PHONE", "ADDRESS", "NAME"]  # first ones win where spans overlap
VOTES = 6

# ---------------------------------------------------------------- patterns (fixed values)
_DOT = r"(?:\.|\s?[\[(]dot[\])]\s?|\sdot\s|\spunkt\s|\spoint\s|\spunto\s)"
_AT = r"(?:\s?@\s?|\s?[\[({<]\s?(?:at|arroba|ät)\s?[\])}>]\s?|\s(?:at|arroba|AT|chez)\s)"
EMAIL = re.compile(rf"(?<![\w.@/%+-])[A-Za-z0-9][\w.%+'-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w@])", re.I)
EMAIL_HINT = re.compile(r"@|[\[({<]\s?(?:at|arroba|ät)\s?[\])}>]|\s(?:at|arroba|chez)\s[\w-]+\s?(?:\.|[\[(]?\s?(?:dot|punkt|point|punto))", re.I)
_GROUPS = r"\d(?:[\s./\-–‑]?\d)+"  # at most one separator between two digits
NUMBER = re.compile(
    "|".join(
        [
            r"(?<![\w/@#=.-])\d{7,8}[ -]?[A-Z](?!\w)",
            rf"(?<![\w.,/@:#=-])(?:\+|00)\s?\d{{1,3}}[\s./-]?\(\d{{0,4}}\)[\s./-]?{_GROUPS}(?![\w@])",
            rf"(?<![\w.,/@:#=-])\(\+?\d{{1,5}}\)[\s./-]?{_GROUPS}(?![\w@])",
            rf"(?<![\w.,/@:#=-])\+?\s?{_GROUPS}(?![\w@])",
            rf"(?<![\w/@#=.-])(?!(?:NI|ID|NR|NO|IP)\b)[A-Z]{{1,2}}[ /-]?{_GROUPS}(?:[ -]?[A-Z])?(?!\w)",
        ]
    )
)
DIGITS = re.compile(r"\d[\d\s()./–‑-]{4,}\d")
STREET = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Way|Crescent|Cres|Close|Cl|Drive|Dr|Row|Square|Sq|Place|Pl|Terrace|Gardens|Gdns|Court|Ct|Hill|Walk|Boulevard|Blvd|Mews|Park|Green|Parade|Highway|STREET|ST|ROAD|RD|LANE|AVENUE|AVE|WAY|CRESCENT|CLOSE|DRIVE|ROW|SQUARE|PLACE|TERRACE|GARDENS|COURT)"
_CAP = r"[A-ZÀ-ÖØ-Þ][\w.'’-]*"
def holds(*parts: str):
    """Whether a text has one of ``parts``: a substring search, far cheaper than a pattern."""
    return lambda text: any(p in text for p in parts)


def before_number(*parts: str):
    """Whether one of ``parts`` stands before white space and a digit."""

    def test(text: str) -> bool:
        for p in parts:
            at = text.find(p)
            while at >= 0:
                at += len(p)
                if text[at : at + 1].isspace() and text[at + 1 : at + 2].isdigit():
                    return True
                at = text.find(p, at)
        return False

    return test


def both(first, then):
    return lambda text: first(text) and then(text)


_SUFFIX = before_number("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ring", "damm", "ufer", "hof", "stieg", "markt", "STRASSE", "STRAßE", "WEG", "GASSE", "PLATZ", "ALLEE")
_PLACE = both(holds("Am", "An de", "Im", "In der", "Auf de", "Zum", "Zur", "AM", "IM"), re.compile(r"(?:A[mM]|An de[rm]|I[mM]|In der|Auf de[rm]|Zu[mr])\s[A-ZÄÖÜ]\w+\s\d").search)
#: Each form of address with a cheap sign that a text may hold one: whatever the form matches has the sign.
ADDRESSES = [
    (sign, re.compile(form))
    for sign, form in [
        (
            re.compile(r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Way|Cres|Close|Cl|Drive|Dr|Row|Sq|Place|Pl|Terrace|Gard|Gdns|Court|Ct|Hill|Walk|B[ol]|Mews|Park|Green|Parade|Highway|ST|RO|RD|LANE|AVE|WAY|CRES|CLOSE|DRIVE|SQ|PLACE|TERRACE|GARDENS|COURT)").search,
            rf"(?<![\w.,/-])(?:(?i:flat|apt|unit|suite|apartment|room)\.?\s\w{{1,4}},?\s)?\d{{1,4}}[A-Za-z]?,?\s(?:{_CAP}\s){{1,3}}{STREET}\b\.?(?:,?\s(?i:apt|flat|unit|suite)\.?\s\w{{1,4}})?",
        ),
        (
            re.compile(r"[HhPp](?i:ouse|lot)\s(?:no\.?\s)?\d").search,
            r"(?<![\w.,/-])(?i:house|plot)\s(?:no\.?\s)?\d{1,4}[A-Za-z]?,\s(?i:street|st\.?|lane|road|block)\s\w{1,4}(?:,\s(?i:sector|phase|block)\s[\w-]{1,6})?",
        ),
        (
            re.compile(r"\d[A-Za-z]?(?:\s(?:bis|ter))?,?\s(?i:rue|avenue|av\.|bd\.?|boulevard|impasse|place|allée|chemin|quai|cours|route|square|passage)\s").search,
            r"(?<![\w.,/-])\d{1,4}[A-Za-z]?(?:\s(?:bis|ter))?,?\s(?i:rue|avenue|av\.|bd\.?|boulevard|impasse|place|allée|chemin|quai|cours|route|square|passage)\s[^\s,;|]+(?:\s[^\s,;|.]+){0,3}",
        ),
        (
            lambda text: _SUFFIX(text) or _PLACE(text),
            r"(?<!\w)(?:[A-ZÄÖÜ][a-zäöüß]+(?:-[A-ZÄÖÜ]?[a-zäöüß]+)*(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer|hof|stieg|markt)|[A-ZÄÖÜ]+(?:STRASSE|STRAßE|WEG|GASSE|PLATZ|ALLEE)|(?:Am|An der|An dem|Im|In der|Auf der|Auf dem|Zum|Zur|AM|IM)\s[A-ZÄÖÜ][\wäöüß]+)\s\d{1,4}\s?[a-z]?(?![\w])",
        ),
        (
            re.compile(r"[AaCcPpRrTt](?<!\w\w)(?i:alle|/|vda|venida|laza|aseo|amino|onda|ravesía|arrer)").search,
            r"(?<!\w)(?i:calle|c/|avda\.?|avenida|plaza|paseo|camino|ronda|travesía|carrer)\s?(?:(?i:de|la|del|los|las|el)\s)*[^\W\d][\w.'’-]*(?:\s(?:(?i:de|la|del|los|las|el)\s)*[A-ZÁÉÍÓÚÑ][\w.'’-]*){0,3},?\s(?:(?i:n\.?º|núm\.?|no\.?)\s?)?\d{1,4}(?![\w])",
        ),
    ]
]
TOWN = re.compile(r"^[\s,]*(?:\d{1,2}\.?º\s?\w?,\s*)?(?:(?i:apt|flat|unit)\.?\s\w{1,4},\s*)?(?:\d{4,5}\s)?[A-ZÀ-ÖØ-Þ]\w+")
POSTCODE = re.compile(r"\b\d{5}\s[A-ZÀ-Þ]\w+|\b[A-Z]{1,2}\d{1,2}[A-Z]?\s\d[A-Z]{2}\b|\b[A-Z]{2}\s\d{5}\b")
#: A street's name before a common noun names something else; common nouns are told from function words (fixed values).
AFTER_STREET = re.compile(r"^\s(?!(?:and|are|as|at|but|by|for|from|has|have|if|in|into|is|near|next|of|off|on|onto|opposite|or|since|than|that|the|then|to|until|was|were|when|where|while|who|will|with|and|und|ist|oder|mit|bei|et|ou|est|avec|près|y|o|es|con|cerca)\b)[a-z]{3,}")
RUN = re.compile(r"(?<![\w@.+'’/-])[A-ZÀ-ÖØ-Þ](?:[\w'’]*(?:-[A-ZÀ-ÖØ-Þ][\w'’]*)*|\.)\.?(?:,?\s(?:(?:van der|van den|van|von|de la|de|del|der|da|di|el|al|bin|ter|ten|la|le)\s){0,1}[A-ZÀ-ÖØ-Þ](?:[\w'’]*(?:-[A-ZÀ-ÖØ-Þ][\w'’]*)*)\.?)+(?![\w@+])")
PARTICLE = re.compile(r"^(?:(?:van der|van den|van|von|de la|de|del|der|da|di|el|al|bin|ter|ten|la|le)\s)+", re.I)
WORD_IN_RUN = re.compile(r"(?:(?:van der|van den|van|von|de la|de|del|der|da|di|el|al|bin|ter|ten|la|le|VAN DER|VAN DEN|VAN|VON|DE LA|DEL|DER)\s)?[A-ZÀ-ÖØ-Þ][\w'’]*(?:-[A-ZÀ-ÖØ-Þ][\w'’]*)*|,(?:\s*\n)?")

PHONE_FORMAT = re.compile(
    r"^(?:(?:\+|00)\s?\d{1,3}[\s./-]?(?:\(0?\d*\)[\s./-]?)?\d[\d\s./–-]{6,14}|\(0?\d{2,5}\)[\s./-]?\d[\d\s./–-]{5,10}|0\d{1,4}[\s./–-]?\d[\d\s./–-]{5,10}|1[-–.\s]\d{3}[-–.\s]\d{3}[-–.\s]\d{4}|\d{3}[-–.\s]\d{3}[-.\s–]\d{4})$"
)
ID_FORMAT = re.compile(
    r"^(?:\d{5}[- ]\d{7}[- ]\d|\d{13}|\d{3}[- ]\d{2}[- ]\d{4}|\d{8}[- ]?[A-Z]|[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]|[A-Z]{2}\d{6}[A-D]|[0-3]\s\d{2}\s\d{2}\s\d{2}\s\d{3}\s\d{3}(?:\s\d{2})?|[0-3]\d{12}(?:\d{2})?|\d{2}\s\d{3}\s\d{3}\s\d{3}|\d{11}|[A-Z]{2}\s?\d{3}\s?\d{4}|[A-Z]\d{8}|[A-Z]{2}\d{7}|[A-Z]{2}/\d{4}/\d{5})$"
)
#: Groups of digits that no phone number has.
ID_GROUPS = re.compile(r"^(?:\d{5}-\d{7}-\d|\d{3}-\d{2}-\d{4})$")
_E = r"[\s:.#°º]*$"
PHONE_CUE = re.compile(r"(?:tel|tél|telefon|teléfono|téléphone|phone|mobil|móvil|mobile|mob|cell|fax|call|ring|dial|hotline(?: is)?|reach (?:me|us) (?:on|at)|rückruf unter|appeler le|appelez le|rappeler au|au numéro|joindre au|llame al|llamar al|number is|numéro|nummer)" + _E, re.I)
ID_CUE = re.compile(r"(?:passport(?: no)?|passeport(?: n)?|reisepass|pasaporte|identity card(?: no)?|cnic(?: no)?|ssn|social security(?: number)?|sécurité sociale|seguridad social|national insurance(?: number)?|ni no|nin|dni|nie|nif|steuer-?\s?id|steuernummer|personalausweis|ausweis(?:nummer)?|id(?: number| no| on file)?|licen[cs]e no|driving licen[cs]e|card no|nir|n°|numéro|tax id)" + _E, re.I)
AGAINST_CUE = re.compile(r"(?:order|part|ticket|invoice|batch|version|port|serial|sku|item|case|contract|ref(?:erence)?|stock|rechnung|bestellung|facture|commande|factura|pedido|lote|lot|model|form|build|release|iso|din|article|isbn|account|dated|on|at|cost)" + _E, re.I)
ADDRESS_CUE = re.compile(r"(?:address|adresse|anschrift|dirección|domicilio|lives at|living at|lives in|deliver to|livrer au|entregar en|liefern an|lieferung an|moved to|wohnt|wohnt in|habite|habite au|vive en|based at|sent to|send to|ship to|résidence|umgezogen nach|zog nach|zog in|a déménagé au|se mudó a|home address|in|at|en|au|an)[\s:(]*$", re.I)
NAME_CUE = re.compile(r"(?:mr|mrs|ms|miss|dr|prof|sir|herr|frau|herrn|m|mme|mlle|sr|sra|srta|don|doña|señor|señora|monsieur|madame|by|with|to|owner|signed|reviewed|attendees|contact|contact person|contacto|kontakt|ansprechpartner|responsable|signé|gezeichnet|firmado|firmada por|regards|thanks|gruß|grüßen|merci|gracias|saludos|cordialement|sincerely|cheers|dear|hello|hi|hallo|bonjour|hola|from|para|à|an|bei|von|par|por|submitted by|taken by|run by|--|spoke with|and|und|et|y)[\s:.,\n(-]*$", re.I)
NAME_AFTER = re.compile(r"^[\s,/|)]*(?:\(|\+?\d|[\w.+-]+\s?(?:@|[\[(]at))", re.I)
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "sir", "herr", "frau", "herrn", "mme", "mlle", "sr", "sra", "srta", "señor", "señora", "monsieur", "madame", "don", "doña"}


def _vote(*values: int) -> list[int]:
    return [*values, *[0] * (VOTES - len(values))]


def numbers(text: str) -> Iterator[re.Match]:
    """Matches of ``NUMBER``, tried only where enough digits stand together, from the signs before them on."""
    done = 0
    for hit in DIGITS.finditer(text):
        at = max(done, hit.start() - 6)
        while at < hit.end() - 4:
            m = NUMBER.match(text, at)
            if m:
                yield m
                at = done = m.end()
            else:
                at += 1


def number_spans(text: str) -> Iterator[tuple[str, int, int, list[int]]]:
    """(kind, start, end, votes) of phone and identity numbers among the digit groups of a text."""
    for m in numbers(text):
        start, end = m.span()
        raw = m.group()
        while raw and raw[-1] in " .(/-–\n\t":
            raw, end = raw[:-1], end - 1
        lead = len(raw) - len(raw.lstrip())
        raw, start = raw[lead:], start + lead
        if "\n" in raw:  # numbers of two lines are two numbers
            for k in re.finditer(r"[^\n]+", raw):
                yield from _number(text, start + k.start(), start + k.end())
            continue
        yield from _number(text, start, end)


def _number(text: str, start: int, end: int) -> Iterator[tuple[str, int, int, list[int]]]:
    raw = text[start:end].rstrip(" .")
    if raw.startswith("(") and ")" not in raw:
        raw, start = raw[1:], start + 1
    raw = raw.strip(" /")
    start = text.index(raw, start) if raw else start
    end = start + len(raw)
    digits = sum(c.isdigit() for c in raw)
    if not 6 <= digits <= 15 or raw.count("(") != raw.count(")"):
        return
    flat = raw.replace("\xa0", " ")
    left = text[max(0, start - 32) : start].replace("\xa0", " ")
    right = text[end : end + 14]
    grouped = bool(ID_GROUPS.match(flat))
    phone, ident = bool(PHONE_FORMAT.match(flat)) and not grouped, bool(ID_FORMAT.match(flat))
    letters = any(c.isalpha() for c in raw)
    phone_cue, id_cue = bool(PHONE_CUE.search(left)), bool(ID_CUE.search(left))
    against = -1 if AGAINST_CUE.search(left) and not phone_cue and not id_cue else 0
    date = -1 if re.match(r"^(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{1,3}(?:\.\d{1,3}){3}|\d+\.\d+|\d{1,3}(?:[, ]\d{3})+)$", flat) and not (phone or ident) else 0
    signature = bool(re.search(r"[\w'’-]+\s?[|/,\n]\s?\(?$", left) and (re.match(r"^\s?[|/,\n]|^\)", right) or not right.strip()))
    # every number is proposed for both kinds; the labelers tell them apart
    if not letters and digits >= 7:
        yield "PHONE", start, end, _vote(1 if phone else -1, 1 if phone_cue else (-1 if id_cue else 0), 1 if signature or text[start - 1 : start] == "(" else 0, against, 1 if 9 <= digits <= 13 else -1, -1 if grouped else date)
    yield "ID_NUMBER", start, end, _vote(1 if ident else -1, 1 if id_cue else 0, -1 if phone_cue else 0, against, -1 if phone and (raw[0] in "+(0") and not id_cue else 0, date)


def spans(text: str) -> Iterator[tuple[str, int, int, list[int]]]:
    """Candidate spans of a text with the votes of the labelers; names come from ``runs``."""
    if EMAIL_HINT.search(text):
        for m in EMAIL.finditer(text):
            s = m.group()
            link = -1 if re.search(r"(?:https?://|www\.)\S*$", text[max(0, m.start() - 40) : m.start()]) or "://" in s else 0
            plain = bool(re.match(r"^[\w.%+'-]+@[\w-]+(?:\.[\w-]+)+$", s))
            spoken = bool(re.search(r"\s(?:at|arroba|chez)\s", s, re.I)) and not re.search(r"[@\[(]", s)
            dots = bool(re.search(r"dot|punkt|point|punto", s, re.I)) or plain or "@" in s or bool(re.search(r"[\[(]", s))
            yield "EMAIL", m.start(), m.end(), _vote(1 if plain else 0, (1 if dots else -1) if not plain else 0, -1 if spoken and not dots else 0, link, 1 if re.search(r"[a-z]{2,}$", s, re.I) else -1)
    for m in (m for sign, form in ADDRESSES if sign(text) for m in form.finditer(text)):
        after = text[m.end() : m.end() + 48]
        left = text[max(0, m.start() - 28) : m.start()]
        s = m.group()
        bare = re.match(r"^\d+\s(?:[A-ZÀ-Þ][\w.'’-]*\s){1,3}" + STREET, s)
        place = -1 if AFTER_STREET.search(after) else 0
        yield "ADDRESS", m.start(), m.end(), _vote(1, 1 if TOWN.search(after) or re.search(r"Sector", s) else 0, 1 if POSTCODE.search(after) else 0, 1 if ADDRESS_CUE.search(left) or re.search(r"[(|/,\n]\s?$", left) else 0, place, -1 if bare and place else 0)
    yield from number_spans(text)


def runs(text: str) -> Iterator[tuple[int, list[str], list[int]]]:
    """(start, words, offsets) of runs of two or more capitalised words or initials; commas are words too."""
    for m in RUN.finditer(text):
        words, at = [], []
        for w in WORD_IN_RUN.finditer(m.group()):
            words.append(w.group() if w.group()[0] != "," else "," if len(w.group()) == 1 else ";")  # ";": a comma at a line's end
            at.append(m.start() + w.start())
        if sum(w not in ",;" for w in words) > 1:
            yield m.start(), words, at


def name_key(word: str) -> str:
    """A word of a run without particles, and not in capitals only."""
    word = PARTICLE.sub("", word)
    return word.title() if word.isupper() and len(word) > 1 else word


def _classes(words: list[str], given: set[str], known: dict[str, int]) -> str:
    """One letter a word: G listed given name, g learned given name, S learned family name, I initial, T title,
    a comma, O other."""
    out = []
    for w in words:
        key = name_key(w)
        kind = known.get(key, 0)
        if w in ",;":
            out.append(w)
        elif key.lower().rstrip(".") in TITLES:
            out.append("T")
        elif key in given:
            out.append("G")
        elif len(w) == 1:
            out.append("I")
        elif kind == 0 and "-" in key:
            parts = [known.get(name_key(p), 0) for p in w.split("-")]
            out.append("S" if 2 in parts else "O")
        else:
            out.append("OgS"[kind])
    return "".join(out)


NAME_SHAPE = re.compile(r"S,[Gg]I?|[Gg](?:[Gg]|I){0,2}S|II?S|[Gg]S")


def candidates(texts: DataFrame) -> DataFrame:
    """All candidate spans and runs of ``texts(tab, item, text)``: one row each."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(2).to_pylist()):
                if not text:
                    continue
                for kind, start, end, votes in spans(text):
                    rows.append((i, kind, start, end, votes, text[start:end], None, None, "", None))
                for start, words, at in runs(text):
                    end = at[-1] + len(words[-1])
                    rows.append((i, "RUN", start, end, None, text[max(0, start - 24) : start], words, at, text[end : end + 24], [name_key(w) for w in words]))
            index = pa.array([r[0] for r in rows], pa.int64())
            columns = [
                pa.array([r[k] for r in rows], t)
                for k, t in ((1, pa.string()), (2, pa.int32()), (3, pa.int32()), (4, pa.list_(pa.int32())), (5, pa.string()), (6, pa.list_(pa.string())), (7, pa.list_(pa.int32())), (8, pa.string()), (9, pa.list_(pa.string())))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), *columns], ["tab", "item", "kind", "start", "end", "votes", "left", "words", "at", "right", "keys"])

    schema = "tab string, item long, kind string, start int, end int, votes array<int>, left string, words array<string>, at array<int>, right string, keys array<string>"
    return texts.select("tab", "item", "text").mapInArrow(find, schema)


def name_words(found: DataFrame, given: list[str]) -> DataFrame:
    """(``word``, ``class``): 1 likely given names, 2 likely family names, learned from all runs.

    A family name follows a listed given name (or stands before ", given name") in a good share of its places; a given
    name stands before a family name, or after one and a comma, in most of its places.
    """
    listed = F.array(*[F.lit(g) for g in given]) if given else F.array().cast("array<string>")
    run = found.filter("kind = 'RUN'").select(F.col("keys").alias("w"))
    near = lambda k: F.get("w", F.col("pos") + k)
    initial = lambda c: F.length(F.coalesce(c, F.lit(""))) == 1
    listed_word = lambda c: F.coalesce(F.array_contains(listed, c), F.lit(False))
    rows = run.select("w", F.posexplode("w").alias("pos", "word")).filter("word not in (',', ';')")
    after = listed_word(near(-1)) | (initial(near(-1)) & ~near(-1).isin(",", ";") & listed_word(near(-2)))
    before_comma = (near(1) == ",") & listed_word(near(2))
    rows = rows.select("word", F.when(~near(1).isin(",", ";") & ~initial(near(1)), near(1)).when(initial(near(1)) & ~near(1).isin(",", ";"), near(2)).alias("next"), F.when(near(-1) == ",", near(-2)).alias("ahead"), (after | before_comma).alias("after"), listed_word(F.col("word")).alias("listed"))
    rows = rows.filter(F.length("word") > 1)
    counts = rows.groupBy("word", "listed").agg(F.count("*").alias("n"), F.count(F.when(F.col("after"), 1)).alias("family"))
    family = counts.filter("not listed and family >= 1 and family >= 0.12 * n").select("word", "family", "n")
    family = stage(family, "family-names")
    places = rows.filter("next is not null").select("word", F.col("next").alias("by")).unionByName(rows.filter("ahead is not null").select("word", F.col("ahead").alias("by")))
    lead = places.join(family.select(F.col("word").alias("by")), "by", "left_semi").groupBy("word").agg(F.count("*").alias("leads"))
    both = counts.filter("not listed").join(lead, "word", "left").join(family.select("word", F.lit(True).alias("may")), "word", "left").fillna(0, ["leads"])
    kind = F.when((F.col("leads") >= 2) & (F.col("leads") >= 0.5 * F.col("n")), 1).when(F.col("may") & (F.col("leads") < 0.5 * F.col("n")), 2)
    return both.select("word", kind.cast("int").alias("class")).filter("class is not null")


def name_spans(found: DataFrame, classes: DataFrame, given: list[str]) -> DataFrame:
    """Name spans cut from the runs. Word classes are joined to the runs' words, never broadcast whole."""
    run = found.filter("kind = 'RUN'").select("tab", "item", "start", "words", "at", "left", "right", "keys")
    parts = F.array_distinct(F.flatten(F.transform("keys", lambda w: F.array_union(F.array(w), F.split(w, "-")))))
    hits = run.select("tab", "item", "start", F.explode(parts).alias("word")).join(classes, "word")
    hits = hits.groupBy("tab", "item", "start").agg(F.map_from_entries(F.collect_set(F.struct("word", "class"))).alias("known"))
    run = run.join(hits, ["tab", "item", "start"])
    listed = set(given)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            data = batch.to_pydict()
            for i in range(batch.num_rows):
                words, at, known = data["words"][i], data["at"][i], dict(data["known"][i] or [])
                shape = _classes(words, listed, known)
                for m in NAME_SHAPE.finditer(shape):
                    a, b = m.span()
                    begin, end = at[a], at[b - 1] + len(words[b - 1])
                    before = words[a - 1] if a else data["left"][i]
                    after = (" " + " ".join(words[b:]) if b < len(words) else "") + data["right"][i]
                    part = m.group()
                    votes = _vote(
                        1 if "G" in part else 0, 1 if "g" in part else 0, 1 if "S" in part else -1,
                        1 if NAME_CUE.search(before) or before.lower().rstrip(".") in TITLES else 0,
                        1 if NAME_AFTER.search(after) else 0,
                        -1 if re.match(rf"^\s(?:{STREET}|Console|Gate|Hall|House|Suite|Ltd|Inc|GmbH)\b", after) else 0,
                    )
                    rows.append((i, "NAME", begin, end, votes, " ".join(words[a:b])))
            index = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(index), batch.column(1).take(index), *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.string()), (2, pa.int32()), (3, pa.int32()), (4, pa.list_(pa.int32())), (5, pa.string())))],
                ["tab", "item", "kind", "start", "end", "votes", "surface"],
            )

    wide = run.select("tab", "item", "words", "at", "left", "right", "known")
    return wide.mapInArrow(cut, "tab string, item long, kind string, start int, end int, votes array<int>, surface string")


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Posterior of being a true span for each vote pattern: EM for one prior and, for each labeler and class, the
    distribution over (against, abstain, for). Smoothed towards labelers that are right four times in five."""
    votes = patterns + 1
    n, k = votes.shape
    post = np.where(patterns.sum(1) > 0, 0.9, 0.1)
    prior_for = np.array([[0.1, 0.5, 0.4], [0.4, 0.5, 0.1]])  # true, false
    strength = max(2.0, 0.02 * counts.sum())
    for _ in range(rounds):
        share = np.clip((counts * post).sum() / counts.sum(), 0.02, 0.98)
        logs = np.zeros((n, 2))
        for c, weight in enumerate((counts * post, counts * (1 - post))):
            logs[:, c] = np.log(share if c == 0 else 1 - share)
            for j in range(k):
                table = np.bincount(votes[:, j], weights=weight, minlength=3) + strength * prior_for[c]
                logs[:, c] += np.log(table / table.sum())[votes[:, j]]
        new = 1 / (1 + np.exp(np.clip(logs[:, 1] - logs[:, 0], -50, 50)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post


def features(votes: np.ndarray, surface: list[str]) -> np.ndarray:
    """Votes for and against, and the shape of the span's text."""
    shape = np.array([[len(s) / 20, sum(c.isdigit() for c in s) / 10, sum(c.isupper() for c in s) / 5, s.count(" ") / 4, float(s[:1] == "+"), float("@" in s)] for s in surface], dtype=float).reshape(-1, 6)
    return np.hstack([votes > 0, votes < 0, shape, np.ones((len(votes), 1))]).astype(float)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression on soft labels, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def find(texts: DataFrame, given: list[str], sample: int = 50_000) -> DataFrame:
    """(``tab``, ``item``, ``kind``, ``start``, ``end``): the personal data in ``texts(tab, item, text)``, without overlaps.

    ``given`` are some given names (a short list). Null and empty texts, and rows without a full
    key, have no spans. (tab, item) must be unique. The
    classifier is trained on at most ``sample`` spans, drawn at random; all else is counted over all texts.
    """
    found = stage(candidates(texts.filter("tab is not null and item is not null")), "pii-candidates")
    names = name_spans(found, stage(name_words(found, given), "name-words"), given)
    spans_all = found.filter("kind <> 'RUN'").select("tab", "item", "kind", "start", "end", "votes", F.col("left").alias("surface")).unionByName(names)
    spans_all = stage(spans_all, "pii-spans")
    counts = spans_all.groupBy("kind", "votes").count().toPandas()  # at most 3**VOTES patterns a kind
    weights: dict[str, np.ndarray] = {}
    total = int(counts["count"].sum()) if len(counts) else 0
    some = spans_all.sample(min(1.0, 0.9 * sample / max(total, 1)), seed=9).select("kind", "votes", "surface").toPandas() if total else counts
    for kind, own in counts.groupby("kind") if total else []:
        patterns = np.array(own["votes"].tolist())
        post = dict(zip(map(tuple, patterns), estimate(patterns, own["count"].to_numpy(dtype=float))))
        rows = some[some["kind"] == kind]
        if not len(rows):
            rows = own.assign(surface="")
        votes = np.array(rows["votes"].tolist())
        y = np.array([post[tuple(v)] for v in votes])
        weights[kind] = logistic(features(votes, rows["surface"].tolist()), y, np.ones(len(y)))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.to_pydict()
            votes = np.array(data["votes"], dtype=int).reshape(batch.num_rows, VOTES)
            x = features(votes, data["surface"])
            w = np.array([weights[k] for k in data["kind"]]).reshape(batch.num_rows, x.shape[1])
            score = 1 / (1 + np.exp(-np.clip((x * w).sum(1), -30, 30)))
            keep = pa.array(np.flatnonzero(score >= 0.5))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(keep) for k in range(5)), pa.array(score).take(keep)], ["tab", "item", "kind", "start", "end", "score"])

    decided = spans_all.mapInArrow(decide, "tab string, item long, kind string, start int, end int, score double")
    return without_overlaps(decided)


def without_overlaps(decided: DataFrame) -> DataFrame:
    """A span is dropped if one of an earlier kind of ``KINDS``, or a longer one of its own, overlaps it."""

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        rank = pdf["kind"].map(KINDS.index)
        pdf = pdf.assign(rank=rank, size=pdf["start"] - pdf["end"]).sort_values(["tab", "item", "rank", "size", "start"])
        out, key, taken = [], None, []
        for row in pdf.itertuples(index=False):
            if (row.tab, row.item) != key:
                key, taken = (row.tab, row.item), []
            if all(row.end <= s or row.start >= e for s, e in taken):
                taken.append((row.start, row.end))
                out.append(row)
        return pd.DataFrame(out, columns=pdf.columns)[["tab", "item", "kind", "start", "end"]]

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf])
            last = (pdf["tab"] == pdf["tab"].iloc[-1]) & (pdf["item"] == pdf["item"].iloc[-1]) if len(pdf) else None
            if last is None:
                continue
            held = pdf[last]
            yield settle(pdf[~last])
        if held is not None:
            yield settle(held)

    rows = decided.repartition("tab", "item").sortWithinPartitions("tab", "item")
    return rows.select("tab", "item", "kind", "start", "end").mapInPandas(part, "tab string, item long, kind string, start int, end int")


def redacted(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``texts(tab, item, text)`` with every span replaced by its kind in brackets; texts without spans as they are."""
    marks = found.groupBy("tab", "item").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("spans"))
    rows = texts.join(marks, ["tab", "item"], "left")

    def paste(spans_col: str, text: str) -> Column:
        first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
        step = lambda a, s: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))
        return F.aggregate(spans_col, first, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))

    return rows.select("tab", "item", F.when(F.col("spans").isNull(), F.col("text")).otherwise(paste("spans", "text")).alias("text"))
