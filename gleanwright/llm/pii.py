"""Personal data in whole texts: fixed patterns, and a conditional random field over word shapes for what patterns cannot tell.

The patterns find e-mail addresses, IPv4 addresses, payment card numbers (by check digit) and international phone numbers, each kind
leftmost and without overlap; a match that fails its test is dropped and not tried again. Beside them a linear-chain field
(module `crf`), trained from a small labelled table, finds names of persons, phone numbers of other forms, spelled-out addresses and
identifying numbers; a span of it that overlaps a pattern's span is left out, so those of the patterns are never changed.

Every pattern is searched in time that grows with the text: addresses from their @ to the left, numbers from where a run of digits
starts. Defined cases: a null or empty text has no spans; a very long text is scanned whole; repeated rows are scanned one by one;
an empty table stays empty; other columns pass unchanged, and a new one whose name is taken gets an underscore in front.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytebpe, crf
from .bpe_codec import added
from .common import fresh, ready, texts

#: The base patterns' signs and limits, and kinds in the order in which they are listed.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE = ("email", "ip", "card", "phone")
LEARNED = ("person", "tel", "address", "number")
KINDS = (*BASE, *LEARNED)
CAUTION = 1.0
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def emails(text: str) -> list[tuple[int, int]]:
    got, end = [], 0
    at = text.find("@")
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in LOCAL:
            lo -= 1
        if lo < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            got.append((lo, end))
        at = text.find("@", max(at + 1, end))
    return got


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns, kind by kind."""
    got = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    got += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            got.append(("card", *m.span()))
    if "+" in text:
        got += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return got


GIVEN = """Anna Peter Maria Thomas Julia Michael Laura Daniel Sarah Andreas Emma James Olivia William Sophie Pierre Camille Antoine Claire Julien
Carlos Lucía José Elena Miguel Carmen Jürgen Katrin Stefan Heike Robert Linda David Susan Marc Isabelle Pablo Sofía Yuki Priya""".split()
FAMILY = """Smith Johnson Müller Schmidt Weber Fischer Martin Bernard Dubois Moreau García López Sánchez Pérez Brown Taylor Wilson Becker Hoffmann
Lefèvre Rousseau Romero Navarro Clark Lewis Walker Schulz Koch Richter Girard Bonnet Torres Ramírez Kowalski Nguyen Rossi""".split()
SYLLABLES = "ba ber da del en er fa gan ha her in ka la len ma mi no on pe ra re sa ste ta ter the ti ton un va ver wo za ent ion ung lich que eau ción mente".split()
COMMON = "the of and to in is it at on for with this that from by are was or an as dot der die das und ist von mit auf ein le la les et de des un une est que pour el los y en por con es".split()

#: Sentences with personal data, by language: {P} a person, {T} a telephone number, {A} an address spelled out, {N} an identifying number.
TELLING = """My name is {P}.|My name is {P} and I live here.|I am called {P}.|Please contact {P} for details.|Contact {P} at {T}.|Mr. {P} signed the letter.|Mrs. {P} called yesterday.
Ms. {P} is away.|Dr. {P} will see you now.|Dear Mr. {P},|Dear Mrs. {P},|Signed by {P}.|Sincerely, {P}|Phone: {T}|Phone number: {T}.|Tel. {T}|Tel: {T}|Call me at {T}.|Call us on {T} today.
You can reach me at {T} in the evening.|Fax: {T}|Mobile: {T}|Her phone number is {T}.|Write to {A} for details.|Email: {A}|E-mail: {A}.|Mail me at {A} please.|Send it to {A}.|SSN: {N}|Social security number {N}.
Passport number {N}|Account number: {N}.|My account number is {N}.|IBAN: {N}|IBAN {N} is mine.|Name: {P}|Name: {P}, phone: {T}|Patient: {P}|Customer name: {P}|{S} {T} {S}|{S} {N} {S}|Regards, {P}
Mein Name ist {P}.|Ich heiße {P}.|Herr {P} hat angerufen.|Frau {P} kommt morgen.|Sehr geehrter Herr {P},|Sehr geehrte Frau {P},|Telefon: {T}|Telefonnummer: {T}.|Tel.: {T}|Rufen Sie mich unter {T} an.|Handy: {T}
Schreiben Sie an {A}.|Kontonummer: {N}|Meine Kontonummer ist {N}.|Ausweisnummer {N}|Ansprechpartner: {P}|Gezeichnet {P}
Je m'appelle {P}.|Mon nom est {P}.|Monsieur {P} est absent.|Madame {P} a signé.|Chère Madame {P},|Téléphone : {T}|Tél. {T}|Appelez le {T}.|Écrivez à {A}.|Numéro de compte : {N}|Numéro de passeport {N}|Nom : {P}
Me llamo {P}.|Mi nombre es {P}.|El señor {P} llamó ayer.|La señora {P} firmó.|Estimado señor {P},|Teléfono: {T}|Tel. {T}|Llame al {T}.|Escriba a {A}.|Número de cuenta: {N}|Número de pasaporte {N}|Nombre: {P}"""
#: Sentences without any, though with the same words, capitals or numbers.
PLAIN = """The phone rang twice.|Her name was on the list.|My name is not important.|The name of the rose.|Call me tomorrow.|The account number is missing.|Dear customer,|Dear Sir or Madam,|Please contact us.
In 1998 the price rose by 45 percent.|The meeting is on 12/05/2021 at 10:30.|Version 2.3.1 was released in March.|See chapter 12, page 345.|It cost $1,200.50 in total.|The ISBN is 978-3-16-148410-0.|Call the doctor.
Chapter 3: The Call|Licensed under the Apache License, Version 2.0.|Copyright (c) 2021 The Authors.|Permission is hereby granted, free of charge.|About 10 000 people came.|The Mr. Men books.|Name and number are required.
Room 101 is on floor 5.|The train leaves at 12:45 from platform 9.|Add 250 g of flour and 3 eggs.|Population: 1234567|Total: 473696257|Order 2353820953013749 was sent.|The Email was sent.|Tel Aviv is a city.|Phone models differ.
Click here to read more|Home | About | Contact|All rights reserved.|password = hunter22|The Social Contract was written in 1762.|Send it back.|Send it to the office.|Write to the editor.|Signed and sealed.|Mail me the form.
Der Name des Dorfes.|Das Telefon klingelte.|Frau und Herr warten.|Im Jahr 1990 waren es 25 Prozent.|Sehr geehrte Damen und Herren,|Rufen Sie morgen an.|Die Kontonummer fehlt.|Mein Name steht nicht dort.
Le téléphone sonne.|Le nom de la rose.|Madame est servie.|En 1789 tout changea.|Le numéro manque.|Monsieur, asseyez-vous.|Appelez demain.
El teléfono suena.|El nombre de la rosa.|La señora duerme.|En 1492 todo cambió.|El número falta.|Llame mañana."""


def _words(rng: random.Random, n: int) -> str:
    """A sentence of invented words."""
    out = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]
    for k in range(1, n):
        if rng.random() < 0.25:
            out[k] = rng.choice(COMMON)
        elif rng.random() < 0.06:
            out[k] = out[k].title()
        elif rng.random() < 0.08:
            out[k] = rng.choice([str(rng.randrange(10 ** rng.randint(1, 16))), f"{rng.randint(1, 31)}.{rng.randint(1, 12)}.{rng.randint(1900, 2030)}", f"{rng.randint(1, 31):02}/{rng.randint(1, 12):02}/{rng.randint(1900, 2030)}", f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 31)}", f"{rng.randint(1, 23)}:{rng.randint(10, 59)}", "***", "$$$", f"{rng.randint(1, 99)}%", f"{rng.randint(1, 9)}.{rng.randint(0, 99)}"])
        elif rng.random() < 0.08:
            out[k] += ","
    return out[0].title() + " " + " ".join(out[1:]) + rng.choice([".", ".", ".", "", "!", "?"])


def labelled_table(n: int = 3200, seed: int = 3) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """n labelled texts (text, spans of kind, start, end) by a seeded rule: telling sentences and plain ones, some with invented words around."""
    rng, telling, plain = random.Random(seed), re.split(r"[|\n](?! )", TELLING), re.split(r"[|\n](?! )", PLAIN)
    digits = lambda k: "".join(rng.choices("0123456789", k=k))

    def name() -> str:
        made = lambda: "".join(rng.choices(SYLLABLES, k=rng.randint(2, 4))).title()
        given = rng.choice(GIVEN) if rng.random() < 0.6 else made()
        family = rng.choice(FAMILY) if rng.random() < 0.6 else made()
        return rng.choice([f"{given} {family}", f"{given} {family}", f"{given} {rng.choice('ABCDEFGHJKLMPRST')}. {family}", family if rng.random() < 0.5 else given, f"{given}-{rng.choice(GIVEN)} {family}"])

    def tel() -> str:
        form = rng.choice(["(ddd) ddd-dddd", "ddd-ddd-dddd", "ddd ddd dddd", "0ddd ddddddd", "0ddd/dddddd", "0d dd dd dd dd", "0dd-ddddddd", "00dd ddd ddddddd", "ddd ddd ddd", "ddd.ddd.dddd"])
        return "".join(digits(1) if c == "d" else c for c in form)

    def address() -> str:
        who, where, end = rng.choice(GIVEN).lower() + rng.choice(["", ".", "_"]) + rng.choice(FAMILY).lower(), rng.choice(["mail", "example", "post", "web"]) + rng.choice(["", digits(1)]), rng.choice(["com", "org", "net", "de", "fr", "es"])
        return rng.choice([f"{who} [at] {where} [dot] {end}", f"{who} at {where} dot {end}", f"{who}(at){where}.{end}", f"{who} (at) {where} (dot) {end}", f"{who} @ {where}.{end}"])

    def number() -> str:
        return rng.choice([f"{digits(3)}-{digits(2)}-{digits(4)}", f"DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}", f"FR{digits(2)}{digits(20)}", rng.choice("CFGHX") + digits(8), digits(rng.randint(7, 12))])

    bare = {"T": lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", "N": lambda: rng.choice([f"{digits(3)}-{digits(2)}-{digits(4)}", f"DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}"])}
    made = {"P": name, "T": tel, "A": address, "N": number}
    out = []
    for _ in range(n):
        kind, text, spans = rng.random(), "", []
        if kind < 0.45:
            form = rng.choice(telling).strip()
            told = bare if "{S}" in form else made
            for piece in re.split(r"(\{[PTANS]\})", form):
                if re.fullmatch(r"\{[PTAN]\}", piece):
                    value = told[piece[1]]()
                    spans.append((LEARNED["PTAN".index(piece[1])], len(text), len(text) + len(value)))
                    text += value
                else:
                    text += _words(rng, rng.randint(2, 8)) if piece == "{S}" else piece
            if rng.random() < 0.4:
                text += " " + _words(rng, rng.randint(3, 12))
            if rng.random() < 0.4:
                before = _words(rng, rng.randint(3, 12)) + " "
                text, spans = before + text, [(k, s + len(before), e + len(before)) for k, s, e in spans]
        elif kind < 0.65:
            text = rng.choice(plain).strip()
        else:
            text = " ".join(_words(rng, rng.choice([1, 1, 2, 3, rng.randint(3, 25)])) for _ in range(rng.randint(1, 3)))
            odd = rng.random()
            if odd < 0.1:  # words again and again
                some = [rng.choice([rng.choice(text.split()), text.split()[0], rng.choice(COMMON), rng.choice(COMMON).title()]) for _ in range(rng.randint(1, 4))]
                text = rng.choice([" ", " ", ", "]).join(" ".join([w] * rng.randint(1, 40)) for w in some) + rng.choice(["", ".", f" {rng.choice(COMMON)}."])
            elif odd < 0.18:  # secrets, hashes and links are no personal data
                code = "".join(rng.choices(rng.choice(["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]), k=rng.randint(8, 64)))
                word = rng.choice(COMMON)
                text += rng.choice([f' token = "{code}" ', f" password: {code} ", f" {code} ", f" https://www.{word}.org/{code}?id={digits(5)} ", f" {word}.{word}{digits(2)}@mail.org ", f" +{digits(2)} {digits(4)} {digits(6)} "]) + _words(rng, rng.randint(1, 6))
            elif odd < 0.4:  # short ones before longer ones
                some = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))).title() for _ in range(rng.randint(0, 3))]
                text = " ".join(f"{x}." for x in [rng.choice([rng.choice(COMMON), rng.choice(SYLLABLES)]).title(), *some]) + f" {text.replace(' ', ', ', 1) if rng.random() < 0.5 else text}"
            elif odd < 0.45:
                text = text.upper()
        out.append((text, spans))
    return out


@lru_cache(1)
def default_field() -> crf.Field:
    return crf.train(labelled_table(), LEARNED)


def _learned(buf: np.ndarray, first: np.ndarray, field: crf.Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the field in bytes: where they start and end, and their kind's place in LEARNED."""
    t = crf.tokens(buf, first)
    y = field.decode(t, CAUTION)
    head = np.flatnonzero(y & 1)  # B- labels are odd, the I- label of a kind comes next
    inside = np.concatenate([(y > 0) & (y & 1 == 0), [False]])
    stop = np.flatnonzero(~inside)
    last = stop[np.searchsorted(stop, head + 1)] - 1 if len(head) else head
    return t.start[head], t.end[last], (y[head] - 1) // 2


def find(column: pa.Array, field: crf.Field) -> list[list[tuple[str, int, int]]]:
    """The spans of each text, by start, then kind as listed; code points, end exclusive."""
    raw, offsets = bytebpe.column_bytes(column)
    buf = np.frombuffer(raw, np.uint8)
    s, e, kind = _learned(buf, offsets[:-1], field)
    lead = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)]) if len(s) else None
    row = np.searchsorted(offsets, s, "right") - 1
    out = []
    at = 0
    for i, text in enumerate(column.to_pylist()):
        got = base_spans(text) if text else []
        n_base = len(got)
        while at < len(s) and row[at] == i:
            begin, end = int(lead[s[at]] - lead[offsets[i]]), int(lead[e[at]] - lead[offsets[i]])
            if not any(x < end and begin < y for _, x, y in got[:n_base]):
                got.append((LEARNED[kind[at]], begin, end))
            at += 1
        out.append(sorted(got, key=lambda x: (x[1], KINDS.index(x[0]), x[2])) if len(got) > 1 else got)
    return out


def scan(docs: DataFrame, column: str = "text", name: str = "spans", field: crf.Field | None = None) -> DataFrame:
    """docs with the spans of `column`: an array of (kind, start, end), in the order of find(). Without a field it is trained from labelled_table()."""
    ready(docs.sparkSession)
    name, field = fresh(name, docs.columns), field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in texts(batches, column, 1 << 22):
            got = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in spans] for spans in find(b.column(column), field)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, kind)], names=[*b.schema.names, name])

    return docs.mapInArrow(run, added(docs, [name], [SPANS]))


def joined(spans: str, base_only: bool = False) -> Column:
    """kind:start:end of the spans, joined by commas."""
    col = F.filter(spans, lambda x: x["kind"].isin(*BASE)) if base_only else F.col(spans)
    return F.array_join(F.transform(col, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
