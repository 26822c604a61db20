"""Template residue and error pages, found by a linear classifier that learns from weak labels.

Texts fall into segments: lines, sentences and what signs such as brackets open. Labelling functions
(response statuses, titles and phrases) call segments of a bounded sample *open* (slots, filler),
*notice* or *frame* (menus, footers, traces); the rest is plain. A regularized softmax regression on
hashed word n-grams, shapes of signs, length and title features learns these labels. It scores every
segment of every document, and the scores alone decide: a document comes out if its best segment is
open, or if its words outside the frame read as a notice on the whole. Both thresholds are chosen on
documents of hosts that the classifier has not seen, and tested on those of further hosts.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.leakage import _OTHER, _spell, fold, in_slices

#: Buckets of the hashed features; documents and segments that the classifier is fitted on, at most.
BUCKETS = 1 << 18
SAMPLE_DOCS, SAMPLE_SEGMENTS = 10_000, 200_000
#: Of ten parts of the hosts: those whose documents choose the thresholds, and those that only test them. Of the plain
#: segments of the other hosts one in so many is taken, but all that begin with a sign or stand in texts of SHORT words.
CHOOSE, TEST, KEEP_PLAIN, SHORT = (0, 1), (2,), 12, 40
#: Longest segment in words: what is longer falls into windows, so that a slot is not outweighed by its sentence.
WINDOW = 10
#: Classes of segments.
PLAIN, OPEN, NOTICE, FRAME = range(4)
#: Scores count up to so much in the mean over a document.
CLIP = 6.0
#: Threshold of a kind of which the choosing hosts hold fewer than LEAST documents.
DEFAULT, LEAST = 1.0, 5
#: Words of a heading that a notice may have beside it, for the labels.
HEADING_WORDS = 12

# ---- labelling functions; fixed values: how unfilled slots, filler and notices read ----

_NAME = r"[A-Za-zÀ-ÿ][\w.]*"
#: Quotes and sources stand in brackets too: beyond the length of a name, no sentence ends in a slot between such marks.
_NO_END = r"(?![.;!?]\s)"
_OPEN_WORDS = (
    r"hier eintragen|folgt|einsetzen|noch offen|einfügen|bitte [^\]>)]{1,30} ergänzen|à venir|à compléter|insérer [^\]>)]{1,30}|indiquer [^\]>)]{1,30} ici"
    r"|da completare|inserire [^\]>)]{1,30}|indicare qui [^\]>)]{1,30}|tbd|to be completed|insert [^\]>)]{1,30}|enter [^\]>)]{1,30} here"
)
#: A slot ends at its closing mark, however long; an opening mark starts it anew, so that a text is read in linear time.
SLOTS = [
    r"\{\{(?:(?!\}\}|\{\{)[\s\S])*\}\}", r"\{%(?:(?!%\}|\{%)[\s\S])*%\}", r"<%(?:(?!%>|<%)[\s\S])*%>", r"\$\{[^{}]*\}", r"%\(\w+\)[sd]", r"(?<![\w%])%[sd](?!\w)", r"\{\d+\}", r"\{[A-Za-z]\w*[A-Za-z]\w*\}",
    rf"\[\[(?:[^\[\]]{{1,60}}|(?:{_NO_END}[^\[\]])+)\]\]", rf"<<(?:[^<>]{{1,60}}|(?:{_NO_END}[^<>])+)>>", r"@@\w+@@", r"#[A-Z][A-Z_]+#", r"\$[A-Z][A-Z_]+\$", r"\[[●•]\]", r"\bXX\.XX\.(?:20)?XX(?:XX)?\b", r"\b(?:TT|JJ|DD|GG)\.MM\.[JAY]{4}\b",
    rf"[\[<](?:[^\]<>]{{0,40}} )?(?:{_OPEN_WORDS})[\]>]", rf"_{{4,}} ?\((?:[^)]{{0,40}} )?(?:{_OPEN_WORDS})\)",
    r"(?<![\w-])undefined(?![\w-])", r"(?<![\w-])NaN(?![\w-])", r"\[object Object\]", r"\w: ?(?:null|None|nil)(?![\w-])",
]

FILLER = [
    "text folgt", "der platzhaltertext zeigt", "dies ist ein fülltext ohne inhalt", "dies ist ein beispieltext ohne inhalt", "dies ist ein blindtext ohne inhalt", "dies ist ein mustertext ohne inhalt", "dies ist ein platzhaltertext ohne inhalt",
    "probetext für die gestaltung", "mustertext für die gestaltung", "blindtext für die gestaltung", "probetext für die vorlage", "mustertext für die vorlage", "noch ein satz fülltext", "noch ein stück fülltext",
    "hier steht später der", "hier kommt noch der", "texte à venir", "faux texte pour la", "ceci est un texte provisoire sans contenu", "ceci est un texte de remplissage sans contenu", "ceci est un texte fictif sans contenu", "ceci est un texte factice sans contenu",
    "encore une phrase vide pour", "encore une phrase factice pour", "encore une phrase de remplissage pour", "le libellé exact figurera ici", "le libellé définitif figurera ici", "testo seguirà", "testo finto per", "qui comparirà più tardi il testo",
    "questo è un testo segnaposto privo di contenuto", "questo è un testo di prova privo di contenuto", "questo è un testo fittizio privo di contenuto", "questo è un testo di riempimento privo di contenuto", "ancora una frase vuota per", "ancora una frase di riempimento per", "ancora una frase finta per",
    "text to follow", "this is dummy text without any content", "this is sample text without any content", "this is placeholder text without any content", "this is filler text without any content", "another filler sentence to make", "another dummy sentence to make", "sample copy for the",
    "the proper wording will appear here", "the final wording will appear here", "the exact wording will appear here",
]
_LATIN = "lorem ips dolor amet consect adipis ultric pellent tempor donec semper velit sagit vita eget nullam facil auctor fringil conval posur mollit gravid quib interd lacini turp viverr mass rutr labor magna aliqua".split()

NOTICES = [
    "seite nicht gefunden", "die angeforderte seite existiert nicht oder wurde verschoben", "der dienst ist vorübergehend nicht verfügbar", "das dokument liegt in der gewählten sprache nicht vor", "zugriff verweigert", "ihre sitzung ist abgelaufen", "interner serverfehler",
    "zeitüberschreitung beim laden des erlasses", "zu viele anfragen von ihrer adresse", "zu viele anfragen", "die verbindung zur datenbank ist fehlgeschlagen", "wartungsarbeiten: die sammlung ist derzeit nicht erreichbar", "beim laden ist etwas schiefgegangen",
    "page introuvable", "la page demandée n'existe pas ou a été déplacée", "le service est momentanément indisponible", "le document n'est pas disponible dans la langue choisie", "accès refusé", "votre session a expiré", "erreur interne du serveur",
    "délai d'attente dépassé lors du chargement de l'acte", "trop de requêtes depuis votre adresse", "trop de requêtes", "la connexion à la base de données a échoué", "travaux de maintenance", "maintenance en cours", "un problème est survenu pendant le chargement",
    "pagina non trovata", "la pagina richiesta non esiste o è stata spostata", "il servizio è temporaneamente non disponibile", "il documento non è disponibile nella lingua scelta", "accesso negato", "la sessione è scaduta", "errore interno del server",
    "troppe richieste", "connessione alla banca dati non riuscita", "lavori di manutenzione", "manutenzione in corso", "si è verificato un problema durante il caricamento", "tempo scaduto durante il caricamento dell'atto",
    "page not found", "the page you requested does not exist or has moved", "the service is temporarily unavailable", "this document is not available in the selected language", "access denied", "your session has expired", "internal server error", "timed out while loading the act",
    "too many requests from your address", "too many requests", "the database connection failed", "maintenance in progress", "something went wrong while loading",
]
ADVICE = [
    "bitte versuchen sie es später erneut", "melden sie sich neu an", "prüfen sie die eingegebene adresse", "kehren sie zur startseite zurück", "wenden sie sich an den betreiber und nennen sie die vorgangsnummer", "schalten sie es ein und laden sie die seite neu", "geben sie es frei und laden sie die seite neu",
    "der inhalt kann nicht dargestellt werden", "es lässt sich nichts anzeigen", "veuillez réessayer plus tard", "reconnectez-vous", "vérifiez l'adresse saisie", "retournez à la page d'accueil", "contactez l'exploitant en indiquant le numéro", "activez-le puis rechargez la page", "activez-le puis actualisez la page",
    "le contenu ne peut être affiché", "rien ne peut être affiché", "riprovare più tardi", "verificare l'indirizzo inserito", "tornare alla pagina iniziale", "contattare il gestore indicando il numero", "accedere di nuovo", "attivarlo e ricaricare la pagina", "nessun contenuto disponibile", "impossibile mostrare il contenuto",
    "please try again later", "check the address you entered", "return to the home page", "contact the operator quoting", "sign in again", "turn it on and reload the page", "turn it on and try again", "nothing can be displayed", "the content cannot be shown",
]
MENU = "startseite kontakt suche hilfe impressum anmelden|systematische sammlung|accueil contact recherche aide connexion|mentions légales|recueil systématique|contatto ricerca aiuto accedi accesso|pagina iniziale|note legali|raccolta sistematica|home contact search help|sign in|legal notice|classified compilation|de fr it en rm".replace("|", "\n")

# scripts that are required, in folded words (ae, oe, ue read a, o, u)
_SCRIPT = (
    r"(?:bitte )?(?:aktivieren|erlauben|schalten) sie javascript(?: \w+){0,7}? (?:anzuzeigen|zu sehen)|\w+ [\w-]+ (?:benotigt|erfordert) (?:javascript|aktive skripte)|ohne (?:javascript|aktives scripting) ist(?: \w+){1,3}? nicht nutzbar|(?:javascript|scripting) ist \w+"
    r"|ihr browser fuhrt keine skripte aus|\w+ \w+ necessite (?:l execution de scripts|javascript)|(?:merci de bien vouloir activer|veuillez activer) javascript(?: \w+){0,5}? pour afficher(?: \w+){1,3}|javascript est \w+|votre navigateur n execute pas les scripts"
    r"|\w+ \w+ richiede (?:javascript|script attivi)|attivare javascript(?: \w+){1,3}? per visualizzare(?: \w+){1,2}|javascript e \w+|il browser non esegu gli script|(?:please )?(?:enable|allow|turn on) javascript(?: \w+){1,4}? to view(?: \w+){1,2}"
    r"|\w+ \w+ requires (?:javascript|scripts) to run|(?:javascript|scripting) is (?:turned )?\w+|your browser dos not execute scripts"
)
#: A response status, for the labels: beside it a text of so many characters holds no provisions.
STATUS_CHARS = 200
_STATUS = re.compile(r"(?<!\S)(?:http status|bad gateway|error \d{3}|err connection \w+|upstream timed out|request id|template rendering failed|code \d{3} trace|[45]0\d)(?!\S)")
_CODES = r"http status|bad gateway|error(?= \d)|err connection \w+|err \w+ \w+|upstream timed out|code \d+ trace|java lang \w+ at act render|exception template rendering failed line|request id|ref(?= [0-9a-f]{4})|template rendering failed"


def _plain(phrase: str) -> str:
    return " ".join(w.decode() for w in fold(phrase))


def _any(phrases) -> str:
    return "|".join(sorted((re.escape(_plain(p)) for p in phrases), key=len, reverse=True))


_SLOT = re.compile("|".join(SLOTS))
#: Longer slots of brackets: what stands in them ends with a word, has one that asks for something, or stands between two.
_BRACKETS = re.compile(r"[\[<]([^\[\]<>]+)[\]>]|_{4,} ?\(([^()]+)\)")
_ASKS = re.compile(r"(?:^|\s)(?:(?:hier eintragen|folgt|einsetzen|noch offen|einfügen|à venir|à compléter|da completare|tbd|to be completed)$|(?:insérer|inserire|indicare qui|insert) .)")
_ASKS_AROUND = [(re.compile(rf"(?:^|\s){head} "), f" {tail}") for head, tail in (("bitte", "ergänzen"), ("indiquer", "ici"), ("enter", "here"))]
_SENTENCE = re.compile(r"[.;!?]\s")
#: A slot holds one of these.
_SLOT_SIGNS = ("{", "[", "<", "@@", "#", "$", "%", "____", "undefined", "NaN", "null", "None", "nil", "XX.", ".MM.")
_FILLER = [f" {_plain(p)} " for p in FILLER]
_LATIN_WORD = re.compile(rf"(?:{'|'.join(_LATIN)})\w*$")
_NOTICE = re.compile(rf"(?<!\S)(?:{_any(NOTICES)}|{_SCRIPT}|{_CODES})(?!\S)")
_BESIDE = re.compile(rf"(?<!\S)(?:{_any([*ADVICE, *[w for line in MENU.splitlines() for w in ([line] if ' ' in line and line.split()[0] not in ('startseite', 'accueil', 'contatto', 'home', 'de') else line.split())]])}|v\d+|\d[0-9a-f]*(?:-\d+)?|[0-9a-f]*\d[0-9a-f]*-\d+)(?!\S)")
#: Lines of a program's trace; marks between the entries of a menu.
_TRACE = re.compile(r"\s*(?:at [\w.$<>/]+ ?\(.*\)|File \".*\", line \d+.*|Traceback \(most recent call last\).*|Caused by: .*|\.\.\. \d+ (?:more|common frames).*)\s*$")
_ITEMS = re.compile(r"\s[|·•›»/–]\s")


def has_slot(text: str) -> bool:
    """A template slot that was never filled, or filled with a program's empty value."""
    if not any(sign in text for sign in _SLOT_SIGNS):
        return False
    return bool(_SLOT.search(text)) or any(_asks(m[1] or m[2]) for m in _BRACKETS.finditer(text))


def _asks(inner: str) -> bool:
    if _SENTENCE.search(inner):
        return False
    return bool(_ASKS.search(inner)) or any(inner.endswith(tail) and (m := head.search(inner)) and m.end() < len(inner) - len(tail) for head, tail in _ASKS_AROUND)


def _filler_words(plain: str) -> bool:
    padded = f" {plain} "
    return any(p in padded for p in _FILLER)


def _repeats(words: list[str]) -> bool:
    return len(words) >= 8 and len(set(words)) <= 3


def _hollow(words: list[str]) -> bool:
    """Made-up Latin, or a few words over and over."""
    if _repeats(words):
        return True
    return len(words) >= 5 and 2 * sum(bool(_LATIN_WORD.match(w)) for w in words) >= len(words)


def has_filler(text: str, plain: str) -> bool:
    """A paragraph of filler wording: a known sentence, made-up Latin, or a few words over and over, these also below a heading."""
    return _filler_words(plain) or any(_hollow(_plain(p).split()) for p in re.split(r"\n\s*\n", text)) or any(_repeats(_plain(p).split()) for p in text.split("\n") if len(p) >= 16)


def _without_frame(text: str) -> str:
    """The text without lines of a program's trace and lines that are menus."""
    if len(text) < 100:
        return text
    lines = re.split(r"[\n\r]", text)
    kept = [x for x in lines if not _TRACE.match(x) and not (len(items := _ITEMS.split(x)) >= 4 and all(len(i.split()) <= 3 for i in items))]
    return text if len(kept) == len(lines) else "\n".join(kept)


def is_notice(plain: str) -> bool:
    """Apart from menu words, a heading, header and footer only error, access, session, maintenance or script notices."""
    rest, n = _NOTICE.subn(" ", plain)
    if not n:
        return False
    left = _BESIDE.sub(" ", rest).split()
    return len(left) <= HEADING_WORDS and "art" not in left


def readings(text: str) -> tuple[bool, bool]:
    """(open, notice): whether the labelling functions read a slot or filler, or nothing but notices. Blank text is neither."""
    if not text.strip():
        return False, False
    if has_slot(text):
        return True, False
    plain = _plain(text)
    if has_filler(text, plain):
        return True, False
    if is_notice(plain):
        return False, True
    rest = _without_frame(text)
    return False, (rest is not text and is_notice(_plain(rest))) or (len(plain) < STATUS_CHARS and bool(_STATUS.search(plain)))


# ---- segments and hashed features ----

_KEEP = b"{}[]<>$%@#_=*"
_TABLE = bytes(48 if 48 <= c < 58 else c if (c < 128 and chr(c).isalnum()) or c in _KEEP or c in b"\x01~" else 32 for c in range(256))
_SIGNS = re.compile(rb"([{}\[\]<>$%@#_=*]+)")
_ENDS = re.compile(rb"[\r\n]|[.!?;](?=\s)")
_INNER = re.compile(rb"(?<=[a-z])\.(?=[a-z0-9])")


class Vocabulary(dict):
    """Number of each token, with hash codes of it and of its first five letters, its sign and its length."""

    def __init__(self):
        super().__init__()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.hash, self.stem, self.sign, self.length = (array("q", [0]) for _ in range(4))
        self[b"\x01"] = 0

    def __missing__(self, token: bytes) -> int:
        sign = token[:1] in _SIGN_BYTES
        self.hash.append(xxhash.xxh32_intdigest(token))
        self.stem.append(xxhash.xxh32_intdigest(token[:5], 7))
        self.sign.append(1 + xxhash.xxh32_intdigest(token[:4], 3) % 65_521 if sign else 0)
        self.length.append(0 if sign else len(token))
        self[token] = n = len(self.hash) - 1
        return n

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x, np.int64) for x in (self.hash, self.stem, self.sign, self.length))


_SIGN_BYTES = {bytes([c]) for c in _KEEP}


def _tokens(text: str) -> list[bytes]:
    """Words, signs and segment marks of a text; digits are alike, accents don't count.

    A segment ends with a line or sentence and before a run of signs such as brackets. Parts that
    dots join, as in dd.mm.yyyy, stay one word.
    """
    text = text.lower().replace("•", "*").replace("●", "*")
    if not text.isascii():
        text = _OTHER.sub(_spell, unicodedata.normalize("NFKD", text))
    flat = _INNER.sub(b"~", _ENDS.sub(b" \x01 ", text.encode("ascii", "ignore").replace(b"~", b" "))).translate(_TABLE)
    if _SIGNS.search(flat):
        flat = _SIGNS.sub(b" \x01 \\1 ", flat)
    return flat.split()


def _featurize(texts, numbers: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment of each feature, its bucket, document and words of each segment) of a batch of texts; features go by segment."""
    if len(numbers.hash) > 1_000_000:
        numbers.reset()
    parts = [np.array(list(map(numbers.__getitem__, _tokens(t))) if t else [], np.int64) for t in texts]
    code = np.concatenate([np.empty(0, np.int64), *[np.append(x, 0) for x in parts]])  # a mark ends each text
    doc = np.repeat(np.arange(len(parts)), [len(x) + 1 for x in parts])
    mark = code == 0
    after_mark = np.append(True, mark[:-1])[~mark] if len(code) else mark
    code, doc = code[~mark], doc[~mark]
    if not len(code):
        none = np.empty(0, np.int64)
        return none, none, none, none
    spot = np.arange(len(code))
    begin = after_mark | ((spot - np.maximum.accumulate(np.where(after_mark, spot, 0))) % WINDOW == 0)
    seg, at = np.cumsum(begin) - 1, np.flatnonzero(begin)
    length, seg_doc = np.diff(np.append(at, len(code))), doc[at]
    hashes, stems, signs, lengths = numbers.arrays()
    h, stem = hashes[code], stems[code]
    pair = np.flatnonzero(~after_mark[1:])
    both = np.where(h[pair] == h[pair + 1], 611_953, h[pair] * 0x9E3779B1 + h[pair + 1])
    same_next = np.append(seg_doc[1:] == seg_doc[:-1], False)
    title = np.append(True, ~same_next[:-1])
    open_sign = signs[code[at]]
    close_sign = np.where(same_next, signs[code[np.append(at[1:], 0)]], 0)  # the next segment begins with the sign that closes
    held = np.minimum(length - (open_sign > 0), 6)
    shape = ((open_sign * 65_537 + close_sign) * 8 + held) * 4 + np.digitize(np.maximum.reduceat(lengths[code], at), [2, 4])
    signed = np.flatnonzero(open_sign)
    doc_words = np.bincount(seg_doc, weights=length)[seg_doc]
    heads = stem[at]
    before, behind = np.where(title, 5, np.append(0, heads[:-1])), np.where(same_next, np.append(heads[1:], 0), 5)
    one = np.arange(len(at))
    which = np.concatenate([seg, seg, seg[pair], one, one, one, one, one, signed])
    feats = np.concatenate([
        h, stem + 1_000_003, both, 7919 * np.minimum(length, 31) + 101, 104729 * (np.log2(doc_words).astype(np.int64) + 1) + 37, np.where(title, 15485863, 32452843),
        before * 0xC2B2AE35 + 17, behind * 0x27D4EB2F + 29, shape[signed] * 0x85EBCA6B + 11,
    ]) % BUCKETS
    order = np.argsort(which, kind="stable")
    return which[order], feats[order], seg_doc, length


_WEAK = re.compile(r"\{\{|\$\{|\{%|<%|\[\[|<<|@@|\$ [a-z]|# [a-z_]|\[ ?\*|% s\b|% \w+ s\b|__ |\{ 0|\{ \w{3,} ?$|\bundefined\b|\bnan\b|object object|\b(?:xx~xx~(?:00)?xx(?:xx)?|tt~mm~jjjj|jj~mm~aaaa|dd~mm~yyyy|gg~mm~aaaa)\b|\w null\b")
_WEAK_OPEN = re.compile(rf"^[\[<] .*(?:{_plain('hier eintragen')}|folgt|einsetzen|noch offen|einfugen|erganzen|a venir|a completer|inserer|indiquer|da completare|inserire|indicare qui|tbd|to be completed|insert|enter)")


def weak_labels(text: str) -> tuple[list[int], list[bool], bool, bool]:
    """The class of each segment of :func:`_tokens`, whether it is rare, and the readings of the whole text.

    Segments that begin with a sign and those of short texts are rare: the fit takes all of them.

    A sign speaks for a slot only in a text in which a slot is read. In a text that is read as a
    notice, or that is short and names a response status, all segments but the frame are taken for one.
    """
    segments, line = [], []
    for token in [*_tokens(text), b"\x01"]:
        if token == b"\x01":
            if line:
                segments.append(line)
            line = []
        else:
            line.append(token.decode())
    is_open, notice = readings(text)
    out, rare = [], []
    short = sum(map(len, segments)) <= SHORT
    for words in (x[i : i + WINDOW] for x in segments for i in range(0, len(x), WINDOW)):
        raw = " ".join(words)
        plain = _plain(raw)
        rare.append(short or raw[0].encode() in _SIGN_BYTES)
        if is_open and (_hollow(words) or _filler_words(plain) or _WEAK.search(raw) or _WEAK_OPEN.search(raw)):
            out.append(OPEN)
        elif notice:
            out.append(NOTICE if _BESIDE.sub(" ", plain).split() else FRAME)
        else:
            out.append(NOTICE if _NOTICE.search(plain) else PLAIN)
    return out, rare, is_open, notice


#: Slots as templates of letters and forms have them.
EXAMPLES = [
    "{{ name }}", "{name}", "${name}", "[Name]", "[Datum]", "[Ort]", "[Adresse]", "[Vorname Name]", "<Name>", "<Datum>", "[Nom]", "[Date]", "[Lieu]", "[Prénom Nom]", "<Nom>", "<Date>", "[Nome]", "[Data]", "[Luogo]", "[Nome Cognome]", "<Nome>", "<Data>",
    "[Your Name]", "[Company Name]", "[Address]", "[Insert Date]", "<Your Name>", "<Address>", "TT.MM.JJJJ", "DD.MM.YYYY", "JJ.MM.AAAA", "GG.MM.AAAA", "XX.XX.20XX", "XX.XX.XXXX",
]


def seed_texts() -> list[tuple[str, int]]:
    """The labelling phrases and examples of slots with their class, so that tables that hold none know each class."""
    return [(p, OPEN) for p in [*FILLER, *EXAMPLES]] + [(p, NOTICE) for p in [*NOTICES, *ADVICE]] + [(p, FRAME) for p in MENU.splitlines()]


def _rows(texts: list, keep, word_numbers: Vocabulary, labels: list[list[int]] | None = None) -> list[tuple]:
    """(text, segment, class, words, features) of the segments for which ``keep(text, segment, class)`` holds."""
    seg, feats, doc, length = _featurize(texts, word_numbers)
    bounds = np.searchsorted(seg, np.arange(len(doc) + 1))
    starts = np.searchsorted(doc, np.arange(len(texts)))
    out = []
    for n, d in enumerate(doc.tolist()):
        s = n - int(starts[d])
        kind = labels[d][s]
        if keep(d, s, kind):
            out.append((d, s, kind, int(length[n]), feats[bounds[n] : bounds[n + 1]].astype(np.int32)))
    return out


ROWS = "key long, s int, host int, kind int, words int, opened boolean, noticed boolean, feats array<int>"


def _labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Labelled segments: all of the hosts that choose or test, and of the others the labelled and some of the plain."""
    numbers = Vocabulary()
    for pdf in in_slices(batches, 500):
        keys, hosts = pdf["key"].to_numpy(np.int64), pdf["host"].to_numpy(np.int64)
        told = [weak_labels(t) for t in pdf["text"]]
        whole = np.isin(hosts, [*CHOOSE, *TEST])
        rows = _rows(pdf["text"].to_list(), lambda d, s, kind: whole[d] or kind != PLAIN or told[d][1][s] or (keys[d] + s) % KEEP_PLAIN == 0, numbers, [x[0] for x in told])
        yield pd.DataFrame([(keys[d], s, hosts[d], kind, n, told[d][2], told[d][3], f) for d, s, kind, n, f in rows], columns=["key", "s", "host", "kind", "words", "opened", "noticed", "feats"])


def labelled_segments(docs: DataFrame) -> pd.DataFrame:
    """Weakly labelled segments of about SAMPLE_DOCS documents picked by a hash of their id, SAMPLE_SEGMENTS at most."""
    share = min(1.0, SAMPLE_DOCS / max(docs.count(), 1))
    key = F.xxhash64("doc_id")
    picked = F.pmod(key, F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))
    host = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(10)).cast("int")
    sample = docs.where(F.col("text").isNotNull() & picked).select(key.alias("key"), host.alias("host"), "text")
    return sample.mapInPandas(_labelled, ROWS).orderBy("key", "s", "feats").limit(SAMPLE_SEGMENTS).toPandas()


@dataclass
class Model:
    """Weights of the hashed features per class, the scores from which a document comes out, and figures of unseen hosts."""

    weights: np.ndarray
    bias: np.ndarray
    open_from: float
    notice_from: float
    figures: dict

    def segment_scores(self, seg: np.ndarray, feats: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(seg, weights=w[feats], minlength=n) + b for w, b in zip(self.weights, self.bias, strict=True)])

    def of_documents(self, texts: list, numbers: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """How open the best segment of each text is, and how much its words outside the frame read as a notice; without words -inf."""
        seg, feats, doc, length = _featurize(texts, numbers)
        return document_scores(self.segment_scores(seg, feats, len(doc)), doc, length, len(texts))

    def finds(self, texts: list, numbers: Vocabulary) -> np.ndarray:
        is_open, notice = self.of_documents(texts, numbers)
        return (is_open >= self.open_from) | (notice >= self.notice_from)


def document_scores(z: np.ndarray, doc: np.ndarray, length: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    is_open = np.full(n, -np.inf)
    np.maximum.at(is_open, doc, z[OPEN] - np.logaddexp(np.logaddexp(z[PLAIN], z[NOTICE]), z[FRAME]))
    body = np.where(z.argmax(axis=0) == FRAME, 0, length).astype(float) if len(doc) else np.empty(0)
    total = np.bincount(doc, weights=body, minlength=n)
    if len(doc):
        body = np.where(total[doc] > 0, body, length)  # of nothing but frame the frame is read
    total = np.bincount(doc, weights=body, minlength=n)
    notice = np.bincount(doc, weights=body * np.clip(z[NOTICE] - np.logaddexp(z[PLAIN], z[OPEN]), -CLIP, CLIP), minlength=n)
    return is_open, np.where(total > 0, notice / np.maximum(total, 1), -np.inf)


def _regress(feats: list, kinds: np.ndarray, l2: float, rounds: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression with L2 by AdaGrad on all rows, classes weighed alike."""
    flat, of = np.concatenate(feats), np.repeat(np.arange(len(feats)), list(map(len, feats)))
    used, flat = np.unique(flat, return_inverse=True)
    n, k = len(kinds), FRAME + 1
    counts = np.bincount(kinds, minlength=k)
    share = 1 / np.maximum(counts, 1)[kinds] / (counts > 0).sum()
    target = np.zeros((k, n))
    target[kinds, np.arange(n)] = 1
    w, b = np.zeros((k, len(used))), np.zeros(k)
    seen_w, seen_b = np.full(w.shape, 1e-8), np.full(k, 1e-8)
    for _ in range(rounds):
        z = np.stack([np.bincount(of, weights=w[c][flat], minlength=n) + b[c] for c in range(k)])
        p = np.exp(z - z.max(axis=0))
        g = (p / p.sum(axis=0) - target) * share
        for c in range(k):
            grad = np.bincount(flat, weights=g[c][of], minlength=len(used)) + l2 * w[c]
            seen_w[c] += grad**2
            w[c] -= rate * grad / np.sqrt(seen_w[c])
        total = g.sum(axis=1)
        seen_b += total**2
        b -= rate * total / np.sqrt(seen_b)
    weights = np.zeros((k, BUCKETS), np.float32)
    weights[:, used] = w
    return weights, b


def choose(scores: np.ndarray, labels: np.ndarray) -> float:
    """The threshold with the best F1, in the middle between the two scores that it separates; the lower of equal ones."""
    if labels.sum() < LEAST:
        return DEFAULT
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    f1 = 2 * np.cumsum(y) / (np.arange(1, len(s) + 1) + y.sum())
    f1[:-1][s[1:] == s[:-1]] = -1
    at = len(s) - 1 - int(np.argmax(f1[::-1]))
    return float(max((s[at] + s[at + 1]) / 2, s[at] - 2 * CLIP)) if at + 1 < len(s) else float(s[at] - 1)


def fit(rows: pd.DataFrame, l2: float = 1e-4, rounds: int = 120, rate: float = 0.5) -> Model:
    """The classifier of labelled segments (see :func:`labelled_segments`) and of the phrases themselves.

    Hosts of CHOOSE and TEST are left out of the fit. Thresholds are those that serve the readings
    of whole documents of the hosts of CHOOSE best; figures are of documents of the hosts of TEST.
    """
    hosts, kinds = rows["host"].to_numpy(np.int64), rows["kind"].to_numpy(np.int64)
    seen = ~np.isin(hosts, [*CHOOSE, *TEST])
    seeds = [(f, kind) for (text, kind) in seed_texts() for *_, f in _rows([text], lambda d, s, _: s == 0, Vocabulary(), [[kind] * 99])]
    feats = [f for f, ok in zip(rows["feats"], seen, strict=True) if ok] + [f for f, _ in seeds]
    told = np.concatenate([kinds[seen], [k for _, k in seeds]]).astype(np.int64)
    weights, bias = _regress(feats, told, l2, rounds // 3, rate)
    model = Model(weights, bias, DEFAULT, DEFAULT, {})
    # plain is also what no labelling function knows: what the first fit takes for a notice is left out of the second
    flat, of = np.concatenate(feats), np.repeat(np.arange(len(feats)), list(map(len, feats)))
    sure = (told != PLAIN) | (model.segment_scores(of, flat, len(feats)).argmax(axis=0) != NOTICE)
    model.weights, model.bias = _regress([f for f, ok in zip(feats, sure, strict=True) if ok], told[sure], l2, rounds, rate)

    def scored(part) -> tuple[np.ndarray, ...]:
        mine = rows[np.isin(hosts, part)]
        if not len(mine):
            return tuple(np.empty(0) for _ in range(6))
        number, first = np.unique(mine["key"], return_inverse=True)[1], np.unique(mine["key"], return_index=True)[1]
        flat, of = np.concatenate(mine["feats"].to_list()), np.repeat(np.arange(len(mine)), mine["feats"].map(len))
        z = model.segment_scores(of, flat, len(mine))
        a, b = document_scores(z, number, mine["words"].to_numpy(np.int64), len(first))
        return a, b, mine["opened"].to_numpy(bool)[first], mine["noticed"].to_numpy(bool)[first], z.argmax(axis=0), mine["kind"].to_numpy()

    is_open, notice, opened, noticed, *_ = scored(CHOOSE)
    model.open_from, model.notice_from = choose(is_open, opened), choose(notice, noticed)
    is_open, notice, opened, noticed, said, told = scored(TEST)
    hit, true = (is_open >= model.open_from) | (notice >= model.notice_from), (opened + noticed).astype(bool)
    share = lambda a, b: float(a.sum() / b.sum()) if b.sum() else 1.0
    model.figures = {
        "fitted_segments": int(seen.sum()), "test_documents": len(hit), "test_labelled_documents": int(true.sum()), "open_from": model.open_from, "notice_from": model.notice_from,
        "precision": share(hit & true, hit), "recall": share(hit & true, true), "segment_accuracy": share(said == told, np.ones(len(told), bool)),
    }
    return model


def train(docs: DataFrame) -> Model:
    return fit(labelled_segments(docs))


def _find(batches: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    numbers = Vocabulary()
    for pdf in in_slices(batches):
        yield pdf.loc[model.finds(pdf["text"].to_list(), numbers), ["doc_id"]]


def residue(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id) of documents with unfilled slots, filler paragraphs, or nothing but notices, by the classifier's scores.

    ``docs`` has (doc_id, text, source); other columns are ignored. Null and blank texts and empty
    tables give no rows; copies count each; whole texts are read, however long. The model is fitted
    on a bounded sample of the documents (SAMPLE_DOCS, SAMPLE_SEGMENTS) unless one is given; tables
    of a few rows are better served by a model of a larger one.
    """
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # four times BUCKETS weights: 4 MB
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.where("text is not null").select("doc_id", "text")
    return texts.mapInPandas(lambda it: _find(it, shared.value), f"doc_id {kind}")
