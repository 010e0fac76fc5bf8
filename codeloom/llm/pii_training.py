"""Labelled texts for the personal-data model: invented people and look-alikes in four languages.

Two seeded generators, so that the labels are exact and the same everywhere: :class:`Composer` puts texts together from
marks, cues, items and look-alikes and teaches the trees; :class:`Maker` fills whole sentences, which the trees never
see and by which they are calibrated. No run of 12 characters of a sentence or part stands in the documents of the test
data, which a test checks. The number of texts is a parameter of :func:`codeloom.llm.pii.train`.
"""

from __future__ import annotations

import random

from codeloom.llm.pii_candidates import GIVEN

_A, _B = "bal ber cal dor dre el fen gar gran hal har kes lam lind lor mar mor nev ost pell quil rad rud sol tal tor var ven wes zan".split(), "acre barr berg brook combe dale den ette feld field ford gate ham hofer holt ier lace land ley mann mere mond mont ner oux quist rez riva rock sac sen son stadt sted ton val veda vela wick win wood zano".split()
_GIVEN = sorted(GIVEN)
_ACCENTS = {"e": "é", "a": "á", "o": "ö", "u": "ü", "i": "í"}
_WORDS = "queue index parser graph cache module branch release import export merge handler index table worker schema".split()
_PROPER = "Meridian Harbor Orion Atlas Summit Beacon Granite Juniper Falcon Cobalt Willow Delta Aurora Copper Sierra Vector Nimbus Quartz".split()
_NOUNS = "Ledger Intake Gateway Portal Engine Guide Console Planner Router Vault Tracker Hub Suite Studio Atlas Monitor".split()
_AREAS = "billing search sync notify stock routing archive".split()

POSITIVE = [
    "Ask {person} about this.", "Co-authored-by: {person} <{email}>", "Acked-by: {person}", "{person} -> {area} -> done", "On call: {person} ({phone})", "My number is {phone}, {person}", "- {person}, {email}", "# TODO({person}): remove later",
    "// FIXME({person}) drop this", '"owner": "{person}",', "| owner | {person} | {phone} |", "{person};{email};{phone};{address}", "{id},{person},{area}", "VALUES ('{person}', '{phone}', '{id}'), ('{person}', '{phone}', '{id}');",
    "row = ('{phone}', '{id}', '{area}')", "name='{person}' id='{id}'", "{person},{id}", "ADMIN_MAIL={email}", "cc {email}, {email}", "tel:{phone}", "ship_to: {address}", "Send it to {address}", "Please contact {person} at {email}.",
    "Author: {person}", "Written by {person} in spring.", "{person} wrote:", "We met {person} ({email}) last week.", "Meeting with {person} and {person}.", "Anschrift: {address}", "Der Ausweis {id} gehört {person}.", "Laut {person} ist alles fertig.",
    "Dossier de {person}, NIR {id}.", "Dossier de {person}, clos hier.", "D'après {person}, rien ne manque.", "contacto: {person}; tel. {phone}; dirección: {address}", "Según {person} todo está listo.", "Please ring {phone} or write to {email}.",
    "{title} {surname} lives at {address} now.", "Number {id} belongs to {person}.", "Zuständig: {person}, {phone}.", "{de_title} {surname} zog nach {address} um.", "Kennziffer {id} von {person}.", "Joindre {person} au {phone}.",
    "{fr_title} {surname} loge au {address}.", "Carnet {id} de {person}.", "Llamar a {person} al {phone}.", "{es_title} {surname} reside en {address}.", "Pasaporte {id} de {person}.", "tax no. {id}", "{person} <{email}>",
    "send to: {address}",
]
NEGATIVE = [
    "The {proper} {noun} was renamed.", "The High Street sample has {n2} rows.", "clone git@host.example.net:team/{area}.git first", "Order {n9} ships with invoice {n8}.", "Serial {n3}-{n2}-{n4} was replaced.", "sha {n10} and hash {n9}",
    "Invoice {n8} row {n10} port {n4}", "Job {n10} took {n3} ms.", "id {n9}, batch {n3} {n3} {n3}", "step {n2}/{n3}/{n4} done", "Partition 00/{n3}/{n4} is empty.", "Issue {n3} {n3} {n4} is a duplicate.", "Am Ende {n2} Zeilen.",
    "Im Modul {n2} fehlt ein Test.", "In der Tabelle {n3} fehlen Werte.", "Zum Release {n2} passt das.", "La Classe Mère est longue.", "La place {n2} du classement change.", "{n2}, route vers {area}", "Plaza {n2} del listado.",
    "The {n2} Open Road samples pass.", "Use the Blue Lane setting.", "Runbook {area}", "ADR {n2}: split {area} from {area}", "Decision {n2}", "# {proper}{noun}", "{proper}{noun}.{word}Item -> {proper}{noun}.mergeItem", "[INFO] {proper}{noun}.{word} took {n2} ms",
    "Re: {area}/{word}.cs", "When {proper}{noun} is down", "{proper} {noun}, {proper} {noun}", "Depends on {proper} {noun} and on {proper}.", "Spring Boot, Visual Studio and Git Hub are tools.", "Open Source License and Apache Software are named.",
    "New York and San Marino are time zones.", "const ports = [{n4}, {n4}, {n4}];", "{n3} {n3} {n3}", "{n9}", "total {n8} of {n10}", "The {proper} Street layout is slow.", "Order {n9} was paid, invoice {n8} not.", "Hash {n10} and port {n4}.",
    "{proper} {noun} is our tool.", "Use svn@host.test:{area}/x for it.", "Pin {word}@{n1}.{n2} in the lock file.", "@{proper}{noun} marks a class.", "Die {proper} {noun} läuft.", "El {proper} {noun} falla.", "Le {proper} {noun} rame.",
    "Step {n3} of {n4} took {n2} s.", "Id {n3}-{n2}-{n4}-{n2} is a build.",
]


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def digits(self, n: int, first: str = "123456789") -> str:
        return self.r.choice(first) + "".join(self.r.choice("0123456789") for _ in range(n - 1))

    def surname(self) -> str:
        r = self.r
        s = (r.choice(_A) + (r.choice("aeiou") if r.random() < 0.2 else "") + r.choice(_B)).capitalize()
        if r.random() < 0.3:
            k = r.choice([i for i, c in enumerate(s) if c in _ACCENTS] or [0])
            s = s[:k] + _ACCENTS.get(s[k], s[k]) + s[k + 1 :]
        if r.random() < 0.12:
            s += "-" + r.choice(_A).capitalize() + r.choice(_B)
        return s

    def given(self) -> str:
        g = self.r.choice(_GIVEN) if self.r.random() < 0.8 else self.r.choice(_A) + self.r.choice("aeiou") + self.r.choice("lnrs") + self.r.choice("aeio")
        return g.capitalize()

    def person(self) -> str:
        r, g, s = self.r, self.given(), self.surname()
        x = r.random()
        if x < 0.04:
            return f"{g} {r.choice(['de', 'del', 'von', 'van', 'de la'])} {s}"
        if x < 0.5:
            return f"{g} {s}"
        if x < 0.6:
            return f"{g} {s.upper()}"
        if x < 0.7:
            return f"{s.upper()}, {g}" if r.random() < 0.7 else f"{s}, {g}"
        if x < 0.84:
            return f"{g[0]}. {s}"
        if x < 0.92:
            return f"{g} {r.choice('ABCDEFGHKLMPRST')}. {s}"
        return f"{g} {s}".lower()

    def email(self) -> str:
        r = self.r
        a, b = self.given().lower(), self.surname().lower().encode("ascii", "ignore").decode() or "x"
        user = r.choice([f"{a}.{b}", f"{a}-{b}", f"{b}_{a}", f"{a[0]}{b}", f"{a}{r.randint(1, 99)}", b])
        if r.random() < 0.2:
            user += "+" + r.choice(_AREAS)
        host, tld = r.choice(["example", "mail", "dev.example", "intranet", "post"]), r.choice(["com", "org", "net", "test", "example", "invalid"])
        x = r.random()
        if x < 0.72:
            e = f"{user}@{host}.{tld}"
        elif x < 0.82:
            e = f"{user} @ {host}.{tld}"
        elif x < 0.91:
            return f"{user} (at) {host.replace('.', ' (dot) ')} (dot) {tld}"
        else:
            return f"{user}[at]{host}.{tld}"
        return e.upper() if r.random() < 0.08 else e

    def phone(self) -> str:
        r, d = self.r, self.digits
        return r.choice([
            f"({d(3)}) 555-01{d(2)}", f"{d(3)}-555-01{d(2)}", f"{d(3)}.555.01{d(2)}", f"+1 {d(3)} 555 01{d(2)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"020 7946 0{d(3)}", f"+44 20 7946 0{d(3)}", f"01632 960{d(3)}", f"+44 1632 960{d(3)}",
            f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"0{d(1)}-{d(2)}-{d(2)}-{d(2)}-{d(2)}", f"0{d(9)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+33 (0){d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0033 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}",
            f"030 23125 {d(3)}", f"030/23125-{d(3)}", f"(030) 23125{d(3)}", f"+49 30 23125 {d(3)}", f"+49 (0)30 23125-{d(3)}", f"0049 30 23125{d(3)}", f"0171 {d(7)}", f"+49 171 {d(7)}",
            f"900 000 {d(3)}", f"900-000-{d(3)}", f"900000{d(3)}", f"+34 900 000 {d(3)}", f"+34 900 00 00 {d(2)}", f"0034 900 000{d(3)}", f"+34 6{d(8)}", f"6{d(2)} {d(2)} {d(2)} {d(2)}",
        ])

    def id(self) -> str:
        r, d = self.r, self.digits
        z = r.choice("TRWAGMYFPDXBNJZSQVHLCKE")
        return r.choice([
            f"9{d(2)}-{d(2)}-{d(4)}", f"9{d(2)} {d(2)} {d(4)}", f"9{d(8)}", f"9{d(8)}", f"{d(3)}-{d(2)}-{d(4)}", f"QQ{d(6)}{r.choice('ABCD')}", f"QQ {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"AB {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}",
            f"{r.choice('12')} {d(2)} 0{d(1)} 99 999 {d(3)} {d(2)}", f"{r.choice('12')}{d(2)}0{d(1)}99999{d(3)} {d(2)}", f"{r.choice('12')}{d(2)}1{r.choice('012')}{d(2)}{d(3)}{d(3)}{d(2)}", f"{r.choice('12')} {d(2)} 1{r.choice('012')} {d(2)} {d(3)} {d(3)} {d(2)}",
            f"00/{d(3)}/{d(5)}", f"{d(2)}/{d(3)}/{d(5)}", f"00{d(1)} {d(3)} {d(3)} {d(2)}", f"00{d(9)}", f"L{d(8)}", f"C{d(2)}H{d(5)}", f"00{d(6)}-{z}", f"00{d(6)}{z}", f"00{d(6)} {z}", f"00.{d(3)}.{d(3)}-{z}", f"X-{d(7)}-{z}", f"Y{d(7)}{z}", f"{d(8)}{z}",
        ])

    def place(self) -> str:
        p = self.surname().split("-")[0]
        return self.r.choice([p, p, f"Little {p}", f"Bad {p}", f"Saint-{p}", f"San {p}", f"{p}-le-Pont"])

    def address(self) -> str:
        r, d = self.r, self.digits
        p, n, z, s = self.place(), str(r.randint(1, 299)) + (r.choice("abc") if r.random() < 0.15 else ""), "00" + d(3), r.choice(_PROPER) + r.choice(["", "", " Hollow", " Field"])
        es, fr = r.choice(["de los Olmos", "Sierra Parda", "del Molino Viejo", f"de {p}"]), r.choice(["de la Grande Ourse", "des Tilleuls", "du Vieux Lavoir", "aux Herbes", f"de {p}"])
        de = r.choice([s.split()[0] + "straße", s.split()[0] + "weg", s.split()[0] + "allee", s.split()[0] + "str.", "Am Alten " + s.split()[0], "An der Linde", "Am Markt"])
        return r.choice([
            f"{n} {s} {r.choice(['Street', 'Lane', 'Close', 'Avenue'])}, {p}", f"{n} {s} Rd, Apt {d(2)}C, {p}, {z}", f"Flat {d(2)}, {n} {s} Close, {p}", f"{n} {s} Ave {p} {z}".upper() if n.isdigit() else f"{n} {s} Lane, {p}", f"{n} {s} Road",
            f"{n}, chemin {fr} - {z} {p}", f"{n} bis, avenue {fr}, {z} {p}", f"{n} bd {fr} {z} {p.upper()}", f"{n} rue {fr}, {z} {p}", f"{n}, rue {fr}",
            f"{de} {n}, {z} {p}", f"{de} {n} in {z} {p}", f"{de} {n}, D-{z} {p}", f"{de} {n}",
            f"C/ {es} {n}, {d(1)}.º C, {z} {p}", f"Calle {es}, {n}, {z} {p}", f"Avda. {es} {n} - {z} {p}", f"Plaza {es} {n}, {p}", f"Paseo {es} {n}",
        ])

    def sentence(self, template: str) -> tuple[str, list[tuple[str, int]]]:
        """The text and the (kind, start) of its items."""
        r, out, spans, rest = self.r, "", [], template.replace("{{", "\0").replace("}}", "\1")
        while "{" in rest:
            a, _, rest = rest.partition("{")
            name, _, rest = rest.partition("}")
            out += a
            if name in ("person", "email", "phone", "address", "id"):
                spans.append(("id_number" if name == "id" else name, len(out)))
                out += getattr(self, name)()
            elif name == "surname":
                spans.append(("person", len(out)))
                out += self.surname()
            elif name.endswith("title"):
                out += r.choice({"title": ["Mr", "Ms", "Mrs", "Dr", "Mr."], "de_title": ["Herr", "Frau"], "fr_title": ["Mme", "M.", "Mlle"], "es_title": ["El señor", "La señora", "Don", "Sra."]}[name])
            elif name[0] == "n" and name[1:].isdigit():
                out += self.digits(int(name[1:]))
            else:
                out += r.choice({"area": _AREAS, "word": _WORDS, "proper": _PROPER, "noun": _NOUNS}[name])
        return (out + rest).replace("\0", "{").replace("\1", "}"), spans

    def text(self) -> tuple[str, list[tuple[str, int]]]:
        """Up to three sentences on one or more lines."""
        text, spans = "", []
        for _ in range(self.r.randint(1, 3)):
            s, at = self.sentence(self.r.choice(POSITIVE if self.r.random() < 0.6 else NEGATIVE))
            if text:
                text += self.r.choice([" ", "\n", "\n- "])
            spans += [(k, p + len(text)) for k, p in at]
            text += s
        return text, spans


#: Words that lead to an item of a kind, those that may follow it, keys of records, openers of sentences, and the words
#: of plain prose; all in four languages and all short, so that no sentence is anybody's.
LEADS = {
    "person": "ask|thanks to|by|from|with|owner|contact|author|seen by|for|met|cc|reach|bitte|von|laut|mit|an|gemeldet von|par|avec|voir avec|dossier de|selon|signalé par|por|con|titular|según|avisado por|see|name|applicant|reviewer|über|pour|para".split("|"),
    "phone": "tel|tel.|phone|call|call back|on|number|mobile|desk|Telefon|Tel.:|unter|erreichbar|téléphone|tél.|au|joignable|rappeler le|teléfono|al|móvil|fax".split("|"),
    "email": "mail|email|e-mail|write to|to|from|cc|at|an|Mail an|par|écrire à|à|escribir a|a|reviewer|user|contact".split("|"),
    "id_number": "SSN|tax id|NI number|passport|id|number|Steuer-ID|Steuer-Nr|Ausweis|Nummer|NIR|numéro|no.|DNI|NIE|documento|número|identity".split("|"),
    "address": "lives at|at|to|ship to|moved to|send to|wohnt|wohnt in|Anschrift:|nach|Adresse:|habite|habite au|à|adresse :|vive en|en|dirección:|a|badge to|address".split("|"),
}
TAILS = "wrote|asked|says|has it|is in|moved|will do|agreed|and|or|today|meint|fragt|hat es|und|wohnt|heute|wartet|demande|a dit|et|attend|dit|pide|dijo|y|espera|vive|before|soon|last week|for now|twice|again".split("|")
KEYS = {"person": "owner|contact|name|author|user|by|reviewer|applicant|titular|nom".split("|"), "phone": "tel|phone|mobile|fax|telefon|tél".split("|"), "email": "mail|email|e_mail|from|user|ADMIN|contact".split("|"), "id_number": "id|ssn|nir|dni|tax_id|number|card_no".split("|"), "address": "address|ship_to|adresse|addr|home|anschrift".split("|")}
OPENERS = "The|A|An|This|When|Since|Before|After|Note|For|Two|Most|Dead|Open|Nobody|As|Der|Die|Das|Ein|Laut|Stand|Zur|Bei|Für|Vor|Aufrufe|Le|La|Les|Selon|Depuis|Pour|Dans|Avant|El|Los|Una|Según|Desde|Por|Antes|Nadie|See|In|Search|Calls|Callers".split("|")
PROSE = "the a of is are was in on and we it so then row file set run node edge team code list page old new der die das ist und im auf wir es alt neu le la les est et sur une un el los es y en un una del se que".split()
TRAILERS = "Signed-off|Reviewed|Acked|Reported|Tested|Co-authored|Suggested".split("|")
NOT_ITEMS = "ticket order build version release trace row port commit offset line invoice serial batch step job hash sha checksum range lines nodes bind retry issue page ADR".split()
NAMED_AFTER = "guide handbook rule team module class page layout sample setting service".split()
STREETS = "Street Road Lane Avenue straße weg platz".split()


class Composer(Maker):
    """Texts put together from marks, cues and items, which teach format and context rather than sentences."""

    def prose(self, n: int) -> str:
        r = self.r
        return " ".join(r.choice(PROSE) if r.random() < 0.6 else r.choice(_A) + r.choice(_B) if r.random() < 0.5 else r.choice(_WORDS + _AREAS) for _ in range(n))

    def opener(self) -> str:
        return self.r.choice(OPENERS)

    def other(self) -> str:
        """Something that is no personal data but may look like it."""
        r, d = self.r, self.digits
        hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
        proper, noun = r.choice(_PROPER), r.choice(_NOUNS)
        return r.choice([
            lambda: d(r.randint(2, 11)), lambda: d(r.choice([9, 10, 10])), lambda: r.choice(["900", "9", "6", "7"]) + d(r.choice([6, 7, 8])), lambda: f"{d(3)}-{d(3)}", lambda: f"{d(r.randint(2, 4))}-{d(r.randint(2, 4))}", lambda: f"{d(3)} {d(3)} {d(r.choice([2, 3, 4]))}", lambda: f"20{d(2)}-0{d(1)}-{d(2)}", lambda: f"20{d(2)}-{d(2)}-{d(2)} {d(2)}:{d(2)}:{d(2)}", lambda: f"{d(2)}/{d(3)}/{d(4)}",
            lambda: f"{d(3)}.{d(1)}.{d(1)}.{d(1)}:{d(4)}", lambda: f"{d(2)}.{d(2)}.{d(3)}.{d(1)}", lambda: f"v{d(1)}.{d(2)}.{d(1)}", lambda: f"0x{hexa(8)}", lambda: f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", lambda: hexa(r.choice([7, 10, 40])), lambda: f"{hexa(6)}{d(3)}", lambda: f"555-{d(3)}",
            lambda: f"{d(3)}-{d(2)}-{d(4)}-{d(2)}", lambda: f"{r.choice(['git', 'svn', 'hg'])}@{r.choice(['code', 'host', 'src'])}.{r.choice(['example.org', 'test'])}:{r.choice(_AREAS)}/{r.choice(_WORDS)}.git", lambda: f"@{proper}{noun}", lambda: f"`{r.choice(_WORDS)}@v{d(2)}`", lambda: f"@{r.choice(_AREAS)}/{r.choice(_WORDS)}", lambda: f"{r.choice(_WORDS)}@{d(1)}.{d(2)}.{d(1)}",
            lambda: f"{proper} {noun}", lambda: f"{proper} {noun}", lambda: f"{proper} {noun} {r.choice(NAMED_AFTER)}", lambda: f"`{proper}{noun}`", lambda: f"{proper}{noun}.{r.choice(_WORDS)}", lambda: f"{proper} {r.choice(STREETS[:4])} {r.choice(NAMED_AFTER)}", lambda: f"Main {r.choice(STREETS[:4])} {r.choice(NAMED_AFTER)}", lambda: f"{d(2)} {self.opener()} {r.choice(['Main', 'High', proper])} {r.choice(STREETS[:4])} {r.choice(NAMED_AFTER)}", lambda: f"{self.opener()} {noun}", lambda: f"{d(2)}, {r.choice(['route', 'place', 'cours'])} {self.prose(1)}",
            lambda: f"{r.choice(['Im', 'Zum', 'Am', 'In der', 'Zur'])} {r.choice(['Modul', 'Release', 'Tabelle', 'Version', 'Schritt'])} {d(r.choice([1, 2, 3]))}", lambda: f"{r.choice(['Plaza', 'Vía', 'Ronda', 'Camino'])} {d(2)}", lambda: f"{r.choice(_AREAS)}/{r.choice(_WORDS)}.{r.choice(['py', 'cs', 'js'])}:{d(2)}", lambda: f"{proper}::{noun}", lambda: f"{r.choice(_WORDS)} {r.choice(_WORDS)}", lambda: f"{noun} {r.choice(['CALLS', 'IMPORTS', 'USES'])}",
        ])()

    def person(self) -> str:
        x = self.r.random()
        return f"{self.given()[0]}. {self.surname()}" if x < 0.12 else f"{self.surname().upper()}, {self.given()}" if x < 0.18 else super().person()

    def item(self, kind: str) -> str:
        return self.id() if kind == "id_number" else getattr(self, kind)()

    def clause(self) -> list[tuple[str | None, str]]:
        """Parts of a clause: text with its kind, null for plain text."""
        r, kind = self.r, self.r.choice(["person", "person", "person", "phone", "email", "id_number", "address"])
        real = r.random() < 0.55
        value = (kind, self.item(kind)) if real else (None, self.other())
        lead = r.choice(LEADS[kind]) if real else r.choice([r.choice(NOT_ITEMS), r.choice(NOT_ITEMS).capitalize(), r.choice(NOT_ITEMS).capitalize(), self.prose(1), r.choice(LEADS[kind])] if r.random() < 0.75 else [self.opener()])
        x = r.random()
        before = self.prose(r.randint(0, 5))
        if real and kind == "person" and x < 0.12:
            lang = r.choice(["title", "de_title", "fr_title", "es_title"])
            title = r.choice({"title": ["Mr", "Ms", "Mrs", "Dr", "Mr."], "de_title": ["Herr", "Frau"], "fr_title": ["Mme", "M.", "Mlle"], "es_title": ["El señor", "La señora", "Don", "Sra."]}[lang])
            return [(None, (before + " " if before and r.random() < 0.4 else "") + title + " "), ("person", self.surname()), (None, " " + r.choice(TAILS) + " " + self.prose(r.randint(1, 4)) + r.choice([".", "", ","]))]
        if x < 0.4:
            sep = r.choice([" ", " ", " ", ": ", " : "])
            text = " ".join(w for w in (before, lead) if w)
            text = text[:1].upper() + text[1:] if r.random() < 0.5 else text
            return [(None, text + sep), value, (None, r.choice([".", ",", "", " ", ";", "?", ":", " " + r.choice(TAILS) + " " + self.prose(2) + ".", ", " + self.prose(2) + "."]))]
        if x < 0.5:
            return [value, (None, " " + r.choice(TAILS) + " " + self.prose(r.randint(0, 4)) + r.choice([".", "", ":"]))]
        if x < 0.58:
            return [(None, self.opener() + " "), (None, self.other()), (None, " " + self.prose(3) + r.choice(["", "."]))]
        if x < 0.66 and real:
            other = r.choice(["phone", "email", "address", "id_number"])
            a, b = r.choice([(" (", ")"), (" <", ">"), (", ", "."), (" - ", ""), (" | ", " |"), ("; ", ""), (": ", "."), (", " + r.choice(LEADS[other]) + " ", ".")])
            return [(None, (before + " " + r.choice(LEADS["person"]) + " ").lstrip()), ("person", self.person()), (None, a), (other, self.item(other)), (None, b)]
        if x < 0.72 and real:
            return [(None, r.choice(TRAILERS) + "-by: "), ("person", self.person()), *([(None, " <"), ("email", self.email()), (None, ">")] if r.random() < 0.6 else [])]
        if x < 0.76:
            return [(None, r.choice(["# ", "// ", "/* "]) + r.choice(["TODO", "FIXME", "XXX"]) + "("), ("person", self.person()) if real else (None, r.choice(_AREAS)), (None, ") " + self.prose(3))]
        if x < 0.8:
            return [value, (None, f" -> {r.choice(_AREAS)} -> {self.prose(1)}")]
        return self.record()

    def record(self) -> list[tuple[str | None, str]]:
        """One to three values in some notation; each is an item or something else."""
        r = self.r
        fields = [(k, self.item(k)) if r.random() < 0.6 else (None, self.other()) for k in r.choices(["person", "phone", "email", "id_number", "address"], k=r.randint(1, 3))]
        keys = [r.choice(KEYS[k]) if k else r.choice(NOT_ITEMS + ["key", "value", "n"]) for k, _ in fields]
        before, between, after = r.choice([('{"', '", "', '"}'), ("", "; ", ""), ("", ", ", ""), ("", " ", ""), ("", "\n", ""), ("<", ">\n<", ">"), ("| ", " | ", " |"), ("VALUES ('", "', '", "');"), ("('", "', '", "')"), ("", ";", ""), ("", ",", "")])
        keyed = before not in ("VALUES ('", "('") and between not in (";", ",", " | ")
        eq = '": "' if before == '{"' else r.choice(["=", ": ", ":", "='"]) if keyed else ""
        out: list[tuple[str | None, str]] = [(None, before)]
        for i, (key, value) in enumerate(zip(keys, fields)):
            out += [(None, (between if i else "") + (key + eq if keyed else "")), value, *([(None, "'")] if eq == "='" else [])]
        return [*out, (None, after)]

    def text(self) -> tuple[str, list[tuple[str, int]]]:
        text, spans = "", []
        for _ in range(self.r.randint(1, 3)):
            if text:
                text += self.r.choice([" ", "\n", "\n- ", ". "])
            for kind, part in self.clause():
                if kind:
                    spans.append((kind, len(text)))
                text += part
        return text, spans
