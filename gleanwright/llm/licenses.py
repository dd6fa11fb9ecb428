"""Licence statements by sentence rules, in DataFrame functions only.

A text is cut into sentences and each sentence is normalised: ASCII lower case, every run of other signs a space. A normalised
sentence that holds a known phrase is an identifier, with its version where the phrase has one. The identifiers of a text, in
order, are then rewritten by ordered licence rules: each rule is a sequence of identifiers, longer rules before those that they
contain, and what no rule uses is UNKNOWN. Long and short forms of a licence end in the same name.

Sentences end at . ! or ? before white space, at ; or : before white space, and at blank lines; other line breaks are white
space, so a sentence may be wrapped over lines. Only sentences that hold one of KEYS are looked at further; every form of every
known phrase holds one. Versions and "or later" are taken from the statement or from the sentence after it ("either version 2 of the
License, or any later version"). A tag `SPDX-License-Identifier:` or `License:` before a short name is a sentence of its own; its
expression (AND, OR, WITH, brackets) is kept as one name. Defined cases: a null or empty text has no sentences and no licences; a very long text is scanned whole;
repeated rows are scanned one by one; an empty table stays empty; other columns pass unchanged, and new ones whose names are taken
get an underscore in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ENDS = r"(?:[.!?;:][\x20\t\r\n]+)|(?:\n[\x20\t\r]*\n)"
#: What most statements hold; KEYS below has the rest.
TRIGGERS = r"licen[sc]e|warrant|redistribut|permission|spdx|public domain|all rights reserved|gnu org|copyright notice|liab|misrepresent|endorse|claim that you wrote|free software"
UNDER = r"(?:licensed|released|distributed|available) under (?:the )?"
LATER = r"(?:or later|or newer|any later)"
#: The three GNU licences: name, the words of the long name, and the short name.
GNU = (("AGPL", "gnu affero general public license", "agpl"), ("LGPL", "gnu (?:lesser|library) general public license", "lgpl"), ("GPL", "gnu general public license", "gpl"))
#: Identifier and phrase (a regular expression over a normalised sentence), in the order in which they are tried. A group is a version.
SENTENCES: list[tuple[str, str]] = [
    ("SPDX", r"spdx license identifier ([a-z0-9.+() -]+)"),
    ("PermGrantMIT", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("PermNoticeMIT", r"the above copyright notice and this permission notice shall be included"),
    ("PermGrantISC", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("AsIsISC", r"the software is provided as is and the author disclaims all warranties"),
    ("BSDPre", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("BSDSource", r"redistributions of source code must retain the above copyright notice"),
    ("BSDBinary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BSDEndorse", r"(?:may be used to endorse or promote products|nor the names? of (?:its|the) contributors)"),
    ("AsIsBSD", r"this software is provided by the (?:copyright holders|author|regents)[a-z0-9 ]* as is"),
    ("ZlibGrant", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("ZlibOrigin", r"the origin of this software must not be misrepresented|you must not claim that you wrote the original software"),
    ("ZlibAltered", r"must not be misrepresented as being the original software"),
    ("AsIsMIT", r"the software is provided as is without warranty of any kind"),
    ("ApacheLimit", r"you may not use this file except in compliance with the license"),
    ("ApacheCopy", r"you may obtain a copy of the license at"),
    ("ApacheAsIs", r"software distributed under the license is distributed on an as is basis"),
    ("ApacheSee", r"see the license for the specific language governing permissions"),
    ("Apache", r"apache (?:software )?license,? (?:version |v)?([0-9.]*[0-9])"),
    ("Apache", r"apache ([0-9.]*[0-9]) license"),
    *((f"{n}FreeLater", rf"(?:under the terms of|licensed under|released under) the {long}[a-z0-9 ]*?(?:version|v) ?([0-9.]*[0-9])[a-z0-9 ]*?{LATER}") for n, long, _ in GNU),
    *((f"{n}Free", rf"(?:under the terms of|licensed under|released under) the {long}(?:[a-z0-9 ]*?(?:version|v) ?([0-9.]*[0-9]))?") for n, long, _ in GNU),
    *((f"{n}ShortLater", rf"{UNDER}(?:gnu )?{short} ?(?:version |v)?([0-9.]*[0-9])(?:[+]| {LATER})") for n, _, short in GNU),
    *((f"{n}Short", rf"{UNDER}(?:gnu )?{short} ?(?:version |v)?([0-9.]*[0-9])") for n, _, short in GNU),
    ("GNULater", rf"either version ([0-9.]*[0-9]) of the license[a-z0-9 ]*?{LATER}"),
    ("GNUVersion", r"(?:only|either)? ?version ([0-9.]*[0-9]) of the license"),
    ("GPLHope", r"distributed in the hope that it will be useful but without any warranty"),
    ("GPLSee", r"see the gnu (?:lesser |library |affero )?general public license for more details"),
    ("GPLCopy", r"you should have received a copy of the gnu (?:lesser |library |affero )?general public license"),
    ("MPL", r"mozilla public license,? (?:version |v ?)?([0-9.]*[0-9])"),
    ("EPL", r"eclipse public license,? (?:version |v ?)?([0-9.]*[0-9])"),
    ("CC0", r"cc0(?: ([0-9.]*[0-9]))?"),
    ("CCBYNCSA", r"(?:cc by nc sa|attribution noncommercial sharealike)(?: ([0-9.]*[0-9]))?"),
    ("CCBYNCND", r"(?:cc by nc nd|attribution noncommercial noderiv[a-z]*)(?: ([0-9.]*[0-9]))?"),
    ("CCBYNC", r"(?:cc by nc|attribution noncommercial)(?: ([0-9.]*[0-9]))?"),
    ("CCBYSA", r"(?:cc by sa|attribution sharealike)(?: ([0-9.]*[0-9]))?"),
    ("CCBYND", r"(?:cc by nd|attribution noderiv[a-z]*)(?: ([0-9.]*[0-9]))?"),
    ("CCBY", r"(?:cc by|creative commons attribution)(?: ([0-9.]*[0-9]))?"),
    ("Boost", r"boost software license,? (?:version )?([0-9.]*[0-9])"),
    ("Unlicense", r"free and unencumbered software released into the public domain"),
    ("PublicDomain", r"(?:placed in|released into|dedicated to) the public domain"),
    ("MIT", r"\bmit (?:style )?licen[sc]e"),
    ("BSD3", r"(?:3 clause bsd|bsd 3 clause|new bsd|modified bsd|revised bsd) licen[sc]e"),
    ("BSD2", r"(?:2 clause bsd|bsd 2 clause|simplified bsd|freebsd) licen[sc]e"),
    ("BSD", r"\bbsd (?:style )?licen[sc]e"),
    ("ISC", r"\bisc licen[sc]e"),
    ("MITShort", rf"{UNDER}mit\b"),
    ("ISCShort", rf"{UNDER}isc\b"),
    ("ApacheShort", rf"{UNDER}apache ?(?:version |v)?([0-9.]*[0-9])"),
    ("AllRights", r"all rights reserved"),
    ("Licensed", r"(?:licensed|released|distributed|available) under (?:the )?[a-z0-9 .+-]*licen[sc]e"),
]
#: Name and the identifiers that make it, in order of preference; [v] takes the version of the identifier with !, else of the first that must be there, ? marks what may be missing.
RULES: list[tuple[str, str]] = [
    ("MIT", "PermGrantMIT PermNoticeMIT AsIsMIT?"),
    ("ISC", "PermGrantISC AsIsISC?"),
    ("BSD-3-Clause", "BSDPre? BSDSource BSDBinary BSDEndorse AsIsBSD?"),
    ("BSD-2-Clause", "BSDPre? BSDSource BSDBinary AsIsBSD?"),
    ("Zlib", "ZlibGrant ZlibOrigin? ZlibOrigin? ZlibAltered?"),
    ("Apache-[v]", "Apache ApacheLimit? ApacheCopy? ApacheAsIs? ApacheSee?"),
    *((f"{n}-[v]-or-later", f"{n}Free GNULater! GPLHope? GPLSee? GPLCopy?") for n, _, _ in GNU),
    *((f"{n}-[v]-or-later", f"{n}FreeLater GNULater? GPLHope? GPLSee? GPLCopy?") for n, _, _ in GNU),
    *((f"{n}-[v]", f"{n}Free GNUVersion! GPLHope? GPLSee? GPLCopy?") for n, _, _ in GNU),
    *((f"{n}-[v]", f"{n}Free GPLHope? GPLSee? GPLCopy?") for n, _, _ in GNU),
    *((f"{n}-[v]-or-later", f"{n}ShortLater") for n, _, _ in GNU), *((f"{n}-[v]", f"{n}Short") for n, _, _ in GNU), ("Apache-[v]", "ApacheShort"),
    ("MPL-[v]", "MPL"), ("EPL-[v]", "EPL"), ("CC0-[v]", "CC0"), ("BSL-[v]", "Boost"),
    ("CC-BY-NC-SA-[v]", "CCBYNCSA"), ("CC-BY-NC-ND-[v]", "CCBYNCND"), ("CC-BY-NC-[v]", "CCBYNC"), ("CC-BY-SA-[v]", "CCBYSA"), ("CC-BY-ND-[v]", "CCBYND"), ("CC-BY-[v]", "CCBY"),
    ("Unlicense", "Unlicense"), ("PublicDomain", "PublicDomain"), ("[v]", "SPDX"),
    ("MIT", "MIT"), ("MIT", "MITShort"), ("ISC", "ISCShort"), ("BSD-3-Clause", "BSD3"), ("BSD-2-Clause", "BSD2"), ("BSD", "BSD"), ("ISC", "ISC"),
    ("AllRightsReserved", "AllRights"),
]
#: A machine-readable tag is a sentence of its own, and keeps its hyphens. An expression: names, brackets, and the words between names.
NAME = r"\(?[a-z0-9.+-]*[a-z0-9+]\)?"
TAG = rf"spdx-license-identifier=({NAME}(?: (?:and|or|with) {NAME})*)"
#: Tags in a text, before they are made sentences: the SPDX one before any name, `License:` before a name that is known.
ANY_NAME = NAME.replace("a-z", "A-Za-z")
TAGGED = rf"(?i:spdx-license-identifier):[ \t]*({ANY_NAME}(?: (?:AND|OR|WITH) {ANY_NAME})*)"
LABELLED = r"(?i)\blicen[sc]e:[ \t]*((?:mit|isc|0bsd|unlicense|bsl-1\.0|zlib|(?:apache|agpl|lgpl|gpl|mpl|epl|bsd|cc0|cc-by)(?:-[a-z0-9.+-]*[a-z0-9+]|v?[0-9.]*[0-9][+]?)))"
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Words of a normalised sentence; each form of each phrase above holds one. cc0 and cc by count only as words of their own.
KEYS = rf"{TRIGGERS}|(?:^|[^a-z0-9])(?:cc0|cc by)(?:[^a-z0-9]|$)|under (?:the |gnu )*[al]?gpl|under (?:the )?(?:mit|isc|apache)|creative commons|attribution (?:noncommercial|sharealike|noderiv)|names? of (?:its|the) contributors|software is provided by"
#: The same over a whole text in lower case, where any other signs may stand between two words.
RAW_KEYS = KEYS.replace(" ", "[^a-z0-9+]+")


def normalised(sentence: Column) -> Column:
    """ASCII lower case; runs of other signs than letters, digits and inner dots and pluses become one space."""
    low = F.translate(sentence, *LOWER)
    tag = F.regexp_extract(low, TAG, 1)
    return F.when(tag != "", F.concat(F.lit("spdx license identifier "), tag)).otherwise(_words(low))


def _words(low: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9.+]+", " "), r"\.+( |$)", " "))


def identifier(sentence: Column) -> Column:
    """The identifier of a normalised sentence, with =version where it has one; null if it is not known."""
    spdx = F.regexp_extract(sentence, SENTENCES[0][1], 1)
    out = F.when(sentence.rlike(SENTENCES[0][1]), F.concat(F.lit("SPDX="), spdx))
    for name, phrase in SENTENCES[1:]:
        versioned = "([0-9" in phrase
        found = F.concat(F.lit(f"{name}="), F.regexp_extract(sentence, phrase, 1)) if versioned else F.lit(name)
        out = out.when(sentence.rlike(phrase), F.regexp_replace(found, "=$", ""))
    return out


def rule_pattern(sequence: str) -> str:
    """A regular expression over identifiers that are written |Name=version||Name|."""
    out, parts = "", sequence.split()
    at = next((k for k, x in enumerate(parts) if x.endswith("!")), next(k for k, x in enumerate(parts) if not x.endswith("?")))
    for k, part in enumerate(parts):
        name, maybe = part.rstrip("?!"), part.endswith("?")
        one = rf"\|{name}(?:=([a-z0-9.+() -]*))?\|" if k == at else rf"\|{name}(?:=[a-z0-9.+() -]*)?\|"
        out += f"(?:{one})?" if maybe else one
    return out


def licences(ids: Column) -> Column:
    """Licence names for identifiers written |a||b|, by the ordered rules, each name or unused identifier as <name> or |identifier|."""
    out = ids
    for name, sequence in RULES:
        out = F.regexp_replace(out, rule_pattern(sequence), f"<{name.replace('[v]', '$1')}>")
    return F.regexp_replace(F.regexp_replace(out, r"\|[^|<>]*\|", "<UNKNOWN>"), r"-?>", ">")


def scan(docs: DataFrame, column: str = "text", names: tuple[str, str] = ("sentence_ids", "licenses")) -> DataFrame:
    """docs with the identifiers of the known sentences of `column`, in order, and the licences that they make: arrays of strings."""
    ids, found, raw = (fresh(n, docs.columns) for n in (*names, "_sentences"))
    # one cheap test of the whole text; most texts end here
    hit = F.translate(F.col(column), *LOWER).rlike(RAW_KEYS)
    tagged = F.regexp_replace(F.regexp_replace(F.col(column), LABELLED, "spdx-license-identifier: $1"), TAGGED, "\n\nspdx-license-identifier=$1\n\n")
    cut = F.filter(F.transform(F.split(tagged, ENDS), normalised), lambda s: s.rlike(KEYS))
    out = docs.withColumn(raw, F.when(hit, cut).otherwise(F.array().cast("array<string>")))
    known = F.filter(F.transform(F.coalesce(F.col(raw), F.array().cast("array<string>")), identifier), lambda x: x.isNotNull())
    out = out.withColumn(ids, F.when(F.size(raw) > 0, known).otherwise(F.array().cast("array<string>"))).drop(raw)
    named = licences(F.array_join(F.transform(ids, lambda x: F.concat(F.lit("|"), x, F.lit("|"))), ""))
    return out.withColumn(found, F.when(F.size(ids) > 0, F.regexp_extract_all(named, F.lit("<([^>]*)>"), F.lit(1))).otherwise(F.array().cast("array<string>")))
