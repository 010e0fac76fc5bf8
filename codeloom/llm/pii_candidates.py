"""High-recall generators of personal-data spans, and the features by which a model tells them from look-alikes."""

from __future__ import annotations

import re
from functools import lru_cache

KINDS = ("email", "phone", "id_number", "address", "person")

#: Common given names of the four languages.
GIVEN = frozenset(
    "aaron abigail adam adele adrian agnes aidan alan albert alejandro alex alexander alexandre alfred alice alicia alma alvaro amanda amelia amelie amparo ana anais andrea andreas andrew angela anita anja anke anna anne anneke antoine antonio apolline arthur astrid aurelie avery axel barbara bastien beatriz ben benjamin bernd birgit brian bruno camille carla carlos carmen caroline catherine charles charlotte christian christine claire clara claudia clement clive colin corentin cristina daniel david dexter diana diego dieter dominik dora edith eduardo edward elena elias eliot elise elizabeth elke ella elodie emil emily emma enrique eric erik esther eva fabian felipe felix fernando florian francisco frank franz frederic friederike gabriel gael george gonzalo greta guillaume gustav hannah hans harry hattie heike helen helena henning henry hugo ian ignacio imogen ines ingrid irene isabel jack james jan jane javier jean jens joan john jonas jorge jorn jose juan judith julia julian julie karin karl kaspar kathe katrin kevin klaus lars laura lea lena leo leon lisa louis lucas lucia luis lukas maelis manon manuel marc margaux maria marie mark marlene marta martin matteo max michael miguel monika morgan moritz nadia nerea nicolas nina nolan nora olga oliver oscar otto pablo paige patricia paul paula pedro peter philipp pierre rafael ralf ramon rebecca robert rocio rosa rowan ruth samuel sandra sarah sebastian sergio silvia simon sofia solene sophie stefan susanne svenja teo teresa tessa theo thomas till tim tobias tom ulrike valentin vera victor walter werner william ximena yanis yves".split()
)
#: Words that lead to an item of a kind, and words that lead to look-alikes.
CUES = {
    "email": "mail email e-mail contact cc to from bounced user reviewer write escribir écrire rückfragen an by",
    "phone": "tel tél phone call back desk number téléphone teléfono telefon rappeler joignable erreichbar mobile fax on-call",
    "id_number": "ssn nir dni nie nino steuernummer steuer-id ausweis documento passport applicant_id sécurité sociale number numéro identity insurance tax",
    "address": "ship_to to at lives moved wohnt habite vive anschrift adresse address dirección sent badge deliver en",
    "person": "by signed-off-by reviewed-by co-developed-by contact owner applicant reported thanks ask for von par por avec con a titular dossier gemeldet signalé avisado bitte voir preguntar todo author to mr mrs ms mme herr frau señor señora person name the",
}
CUES = {k: frozenset(v.split()) for k, v in CUES.items()}
AGAINST = frozenset("ticket order checksum commit port range lines offset build version release bind trace id row replaces package remote rule annotations code nodes retry branch see issue line week step sha hash serial invoice amount".split())
TITLES = r"Mr|Mrs|Ms|Miss|Dr|Prof|Mme|Mlle|M|Monsieur|Madame|Herr|Herrn|Frau|Señor|Señora|señor|señora|Sr|Sra|Don|Doña|don|doña|monsieur|madame"
STREET_EN = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Close|Drive|Dr|Court|Ct|Square|Sq|Terrace|Boulevard|Blvd|Way|Crescent|Place|Hill|Row|Mews|Gardens|Grove|Park|Parkway"
STREET_FR = "rue|avenue|av\\.?|boulevard|bd|chemin|place|impasse|allée|allee|quai|cours|route|sentier|square|passage|ruelle|esplanade|voie|montée"
STREET_ES = "Calle|C/|C\\.|Avenida|Avda\\.?|Av\\.|Plaza|Pza\\.?|Paseo|Pº|Camino|Carretera|Ctra\\.?|Ronda|Travesía|Glorieta|Callejón|Vía|Rambla"
STREET_DE = "straße|strasse|str\\.|weg|allee|platz|gasse|ring|damm|ufer|pfad|steig|chaussee|markt|hof|graben|berg"

_U, _L = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_TOK = rf"(?:Mc|Mac|O'|D')?[{_U}](?:[{_L}]+|[{_U}]+)(?:[-'’](?:[{_U}](?:[{_L}]+|[{_U}]*)|[{_L}]+))*"
_PART = r"(?:(?:de la|de los|del|de|von der|von|van der|van|du|le|la|der|da|di) )?"
_E = r"(?<![\w/`=.+-])" + r"[\w.+'-]*\w"
#: Capitalised words that begin a new sentence or a name rather than go on with a town.
_NOT_TOWN = "The|An?|In|For|As|Two|When|Since|Before|According|Nobody|Note|Dead|Complexity|Calls?|Callers|Search|Most|Mr|Mrs|Ms|Mme|Herr|Frau|Der|Die|Das|Ein|Eine|Laut|Stand|Zur|Vor|Bei|Aufrufe|Depuis|Selon|Pour|Dans|Avant|Personne|Desde|Seg[uú]n|Por|En|Antes|Con|Nadie|El|Un|Una|Signed|Reviewed|Reported|Ticket|Build|Trace|Range|Version|Remote|Bind|Thanks|Ask|Mail|Deliver|My|Checksum|See|Annotations"
_CITY = rf"(?!(?:{_NOT_TOWN})\b)[{_U}][{_U}{_L}'’]+(?:(?: |-)(?:(?:le|la|les|de|del|sur|sous|am|an der|im|upon|on)[ -])*(?!(?:{_NOT_TOWN})\b)[{_U}][{_U}{_L}'’]+(?![\w:]|\.\w|-\w+:)){{0,2}}"

EMAIL = [
    re.compile(r"(?<![\w.+-])[A-Za-z0-9_%][\w.%+'-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])"),
    re.compile(r"(?<![\w.+-])[A-Za-z0-9_%][\w.%+'-]* ?(?:@|\((?:at|AT)\)|\[(?:at|AT)\]|<at>|\{at\}) ?[A-Za-z0-9-]+(?: ?(?:\.|\((?:dot|DOT|punkt|point|punto)\)|\[(?:dot|DOT)\]) ?[A-Za-z0-9-]+)*(?:\.| ?\((?:dot|DOT|punkt|point|punto)\) ?| ?\[(?:dot|DOT)\] ?)[A-Za-z]{2,}(?![\w-])"),
]
PHONE = [
    re.compile(r"(?<![\w.+/-])\+\d{1,3}[ .\-/]?(?:\(0\)[ .\-]?)?(?:\(\d{1,5}\)[ .\-]?)?\d(?:[ .\-/]?\d){5,12}(?!\w)"),
    re.compile(r"(?<![\w.+/-])00[1-9]\d{0,2}[ .\-](?:\(0\)[ .\-]?)?\d(?:[ .\-/]?\d){5,11}(?!\w)"),
    re.compile(r"(?<![\w.+/-])\(0?\d{2,5}\)[ .\-]?\d(?:[ .\-]?\d){4,9}(?!\w)"),
    re.compile(r"(?<![\w.+/#-])(?<!\d:)(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])"),
    re.compile(r"(?<![\w.+/#-])(?<!\d:)0[1-9](?:[ .\-]?\d){6,10}(?![\w-])"),
    re.compile(r"(?<![\w.+/#-])(?<!\d:)0\d{2,4}[/ -]\d{3,8}(?:[ -]\d{1,5})?(?![\w-])"),
    re.compile(r"(?<![\w.+/#-])(?<!\d:)[6789]\d{2}[ .\-]?\d{2,3}[ .\-]?\d{2,3}(?:[ .\-]?\d{2})?(?![\w-])"),
]
ID = [
    re.compile(r"(?<![\w.+/#-])(?<!\d:)\d{3}[- ]?\d{2}[- ]?\d{4}(?![\w-])"),
    re.compile(r"(?<![\w.+/#-])(?<!\d:)[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)"),
    re.compile(r"(?<![\w.+/#-])(?<!\d:)[1278] ?\d{2} ?(?:0[1-9]|1[0-2]|[2-9]\d) ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3}(?: ?\d{2})?(?!\w)"),
    re.compile(r"(?<![\w.+/#-])(?<!\d:)\d{2,3}/\d{3}/\d{4,5}(?!\w)"),
    re.compile(r"(?<![\w.+/#-])(?<!\d:)\d{2,3} ?\d{3} ?\d{3} ?\d{2,3}(?![\w-])"),
    re.compile(r"(?<![\w.+/#-])(?<!\d:)[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{8}\d?(?!\w)"),
    re.compile(r"(?<![\w.+/#-])(?<!\d:)(?:\d{8}|\d{1,2}\.\d{3}\.\d{3}|[XYZ]-?\d{7})[- ]?[A-HJ-NP-TV-Z](?!\w)"),
]
ADDRESS = [
    re.compile(rf"(?<![\w-])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite) ?\d+[A-Za-z]?, ?)?\d{{1,5}}[A-Za-z]? (?:[{_U}][\w'’]+ ){{1,3}}(?:{STREET_EN}|{STREET_EN.upper()})\b\.?(?:, ?(?:Flat|Apt\.?|Apartment|Unit|Suite) ?\d+ ?[A-Za-z]?)?(?:,? {_CITY})?(?:,? (?:[A-Z]{{2}} )?\d{{5}}(?:-\d{{4}})?|,? [A-Z]{{1,2}}\d{{1,2}}[A-Z]? ?\d[A-Z]{{2}})?"),
    re.compile(rf"(?<![\w-])\d{{1,4}}(?: ?(?:bis|ter|quater)| ?[a-dA-D](?![\w]))?,? (?:{STREET_FR})(?: (?:de la|de l['’]|des|du|de|d['’]|aux|au|à la|la|le|les))*[ ]?(?:[{_U}][\w'’-]+)(?: [{_U}][\w'’-]+){{0,3}}(?:(?:,| -| –)? ?(?:F-)?\d{{5}} {_CITY}|, {_CITY})?"),
    re.compile(rf"(?<![\w-])(?:[{_U}][\w-]*(?:{STREET_DE})|(?:[{_U}][{_L}-]+ )?(?:Straße|Strasse|Weg|Allee|Platz|Gasse|Ring)|(?:Am|An der|An den|Auf der|Auf dem|Im|In der|Zum|Zur|Unter den|Unter der|Hinter der|Hinter dem) (?:[{_U}][{_L}-]+ ?){{1,3}}?) ?\d{{1,4}} ?[a-z]?(?!\w)(?:(?:,| in| -|;)? ?(?:D-)?\d{{5}} {_CITY}|, {_CITY})?"),
    re.compile(rf"(?<![\w-])(?:{STREET_ES}) ?(?:(?:de los|de las|de la|del|de|la|el|los|las) )?(?:[{_U}][\w'’-]+)(?: (?:de |del |la )?[{_U}][\w'’-]+){{0,3}},? ?(?:n\.?º ?|núm\.? ?)?\d{{1,4}}(?: ?(?:bis|[a-dA-D](?!\w)))?(?:, ?\d{{1,2}}\.?[ºª°] ?[A-Za-z]?(?:zq|cha|der)?\b\.?)?(?:(?:,| -)? ?\d{{5}} {_CITY}|, {_CITY})?"),
]
PERSON = [
    re.compile(rf"(?<![\w’-])(?<!\w')(?=({_TOK}(?: [{_U}]\.)? {_PART}{_TOK})(?![\w]))"),
    re.compile(rf"(?<![\w’-])(?<!\w')(?=({_TOK}, {_TOK})(?!\w))"),
    re.compile(rf"(?<![\w’.-])(?<!\w')(?=([{_U}]\. ?{_PART}{_TOK})(?!\w))"),
    re.compile(rf"(?<![\w’-])(?<!\w')(?:{TITLES})\.? (?=((?:[{_U}]\. )?{_PART}{_TOK})(?!\w))"),
    re.compile(rf"(?<![\w’@.-])(?<!\w')(?=([{_L}]{{2,}} {_PART}[{_L}]{{3,}}(?:[-'’][{_L}]+)*)(?![\w@]))"),
]
_NUMBERS = re.compile(r"\d[\d .()/-]{6,}")
_WORD = re.compile(r"[^\W\d_][\w-]*")
_DIGIT_RUN = re.compile(r"[(+]?[A-Z]{0,2}[ -]?\d[\dA-Z ./()-]{5,}")
#: Each finds whatever EMAIL and ID[5] match, and more.
_AT_SIGN = re.compile(r"@|\((?:at|AT)\)|\[(?:at|AT)\]|<at>|\{at\}")
_LETTER_ID = re.compile(r"[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{8}")
#: Words behind which a name in lower case is proposed whatever its first word.
_NAME_CUES = "(?:signed-off|reviewed|co-developed|reported|written|found|sent)[- ]by|(?:signalé|écrit|envoyé) par|(?:avisado|escrito|enviado) por|(?:gemeldet|geschrieben) von|contact|owner|applicant|thanks|ask|titular|dossier|preguntar|author|mr|mrs|ms|mme|herr|frau|señora?|person|name"
_CUED = re.compile(rf"(?<!\w)(?i:{_NAME_CUES})[.:,]? (?=([{_L}]{{2,}} {_PART}[{_L}]{{3,}}(?:[-'’][{_L}]+)*)(?![\w@]))")
_LOWER = re.compile(rf"(?<![\w@.-])[{_L}]{{2,}}(?= [{_L}])")
_DIGIT_BEFORE = re.compile(r"[+\d)][ ./-]?$")
_PARTICLE = re.compile(r" (?:de|del|von|van|du|le|la|der|da|di) ")
_MAIL_NEAR = re.compile(r"^[\"'>)\]]*[ ,;:<(|\-\"]{0,4}(?:mail\W{1,5})?[\w.+%'-]+ ?(?:@|\(at\)|\[at\])")
_FOLD = str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿœæ", "aaaaaaceeeeiiiinooooouuuuyyoa")
#: Words that look like the first word of a name but open a sentence.
_OPENERS = frozenset("the a an see as in note since according for when before two complexity calls dead nobody search callers this that these those and but der die das ein eine laut stand für vor bei zur zum bitte la le les el los las un une uno una selon pour dans avant depuis según desde por en con este esta cette ce on no thanks ask reported mail my deliver please escribir preguntar voir signed reviewed ticket range build version trace bind remote main checksum annotations insert owner order".split())
_TAIL_NOUNS = frozenset("guide handbook rule team module service class repository engine portal handler api docs manual project product library framework street flow area page screen".split())


def fold(word: str) -> str:
    return word.lower().translate(_FOLD)


N_FEATURES = 39


@lru_cache(maxsize=1 << 16)
def _is_given(word: str) -> bool:
    return fold(word) in GIVEN


def _left_words(text: str, at: int) -> list[str]:
    return _WORD.findall(text[max(0, at - 36) : at])[-4:]


def features(text: str, kind: str, pattern: int, start: int, end: int) -> list[float]:
    s = text[start:end]
    left, right = text[max(0, start - 2) : start], text[end : end + 2]
    words = _left_words(text, start)
    low = [w.lower() for w in words]
    near = set(low[-3:])
    cue = sum(w in CUES[kind] for w in near)
    against = sum(w in AGAINST for w in near)
    digits = sum(c.isdigit() for c in s)
    f = [float(KINDS.index(kind)), float(pattern), float(digits), float(len(s)), float(sum(c in " .-/" for c in s)), float(cue), float(against)]
    last = low[-1] if low else ""
    f += [float(last in CUES[kind]), float(last in AGAINST)]
    lc, rc = left[-1:], right[:1]
    f += [float("\n" == lc or start == 0), float(lc in "\"'(<|;,[{="), float(lc == " " and left[:1] in ":,;-|="), float(rc in "\"')>|;]}"), float(rc in ",.:"), float(rc == "\n" or end >= len(text)), float(lc == "`" or rc == "`"), float(rc in "/_=@\\" or lc in "/_@\\#")]
    f.append(float(right == ":/" or (rc == ":" and right[1:2].isalnum())))
    after, back = text[end : end + 4], text[max(0, start - 30) : start]
    f += [float(after.startswith(" ->")), float(after.startswith((" (", " <"))), float(after.startswith((", ", ";", " ;", " |"))), float(bool(_NUMBERS.search(back))), float("@" in back), float(bool(cue) and last in CUES[kind])]
    if kind == "person":
        toks = [w for w in _WORD.findall(s) if len(w) > 1]
        a, b = (toks[0], toks[-1]) if toks else ("", "")
        nxt = text[end : end + 24].lstrip()
        nw = _WORD.match(nxt)
        f += [
            float(fold(a) in GIVEN), float(fold(b) in GIVEN), float(a.lower() in _OPENERS), float(bool(nw) and nw.group().lower() in _TAIL_NOUNS),
            float(b.isupper() and len(b) > 2), float(a.isupper() and len(a) > 2), float(s.islower()), float(bool(_MAIL_NEAR.match(text[end : end + 60]))),
            float(bool(re.search(rf"(?:^|[^\w])(?:{TITLES})\.? $", text[max(0, start - 10) : start]))), float(len(toks)), float("," in s) + 2 * float(bool(_PARTICLE.search(s))), float(fold(b) in _TAIL_NOUNS or b.lower() in _OPENERS),
            float("street" == b.lower() or a.lower() in ("main", "high")), float(len(b)), float(s[:2] == "M."),
        ]
    elif kind in ("phone", "id_number"):
        group = re.split(r"\D+", s.strip("+()"))
        f += [float(s[0] == "+"), float(s.startswith("00")), float(s.startswith("0")), float(len(group)), float(len(group[0])), float(len(group[-1])), float("/" in s), float("(" in s), float("." in s), float(any(c.isalpha() for c in s)), float(bool(re.search(r"555[ .-]?01\d\d$", s))), float(s[0] == "9") + float(s.startswith("900")), float(len(set(re.findall(r"[ ./-]", s)))), float(bool(_DIGIT_BEFORE.search(back)))]
    elif kind == "address":
        f += [float(bool(re.search(r"\b\d{5}\b", s))), float(bool(re.search(r"(?i)flat|apt", s))), float(s[0].isdigit()), float(s.isupper()), float("," in s), float(bool(re.search(rf", {_CITY}$", s))), float(s.count(" ")), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    else:
        f += [float(bool(re.search(r"[(\[]", s))), float(" " in s), float(s.lower().startswith(("git@", "svn@", "hg@", "ssh@"))), float(s.count(".")), float(s.count("@")), float("+" in s), float(s.isupper()), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    return f + [0.0] * (N_FEATURES - len(f))


def candidates(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, pattern, start, end) of all proposed spans; they may overlap."""
    out = []
    if _AT_SIGN.search(text):
        for k, rx in enumerate(EMAIL):
            out += [("email", k, m.start(), m.end()) for m in rx.finditer(text)]
    for run in _DIGIT_RUN.finditer(text):
        lo, hi = run.start(), min(len(text), run.end() + 3)
        for kind, rxs in (("phone", PHONE), ("id_number", ID)):
            for k, rx in enumerate(rxs):
                if rx is not ID[5]:
                    out += [(kind, k, m.start(), m.end()) for m in rx.finditer(text, lo, hi)]
    # numbers that begin with letters, of which a run of digits need not hold the start
    if _LETTER_ID.search(text):
        out += [("id_number", 5, m.start(), m.end()) for m in ID[5].finditer(text)]
    for k, rx in enumerate(ADDRESS):
        out += [("address", k, m.start(), m.end()) for m in rx.finditer(text)]
    for k, rx in enumerate(PERSON):
        # names in lower case are proposed if they begin with a common given name, which few texts hold, or behind a cue
        for m in rx.finditer(text) if k < 4 or any(map(_is_given, set(_LOWER.findall(text)))) else ():
            a, b = m.span(1)
            if k == 4 and not _is_given(_WORD.match(text, a).group()):
                continue
            if k == 0 and (text[a:b].isupper() or _WORD.match(text, a).group().lower() in _OPENERS):
                continue
            out.append(("person", k, a, b))
    given = {(a, b) for kind, k, a, b in out if kind == "person" and k == 4}
    for m in _CUED.finditer(text):
        if m.span(1) not in given and not any(w in _OPENERS for w in m.group(1).split()):
            out.append(("person", 4, *m.span(1)))
    return out
