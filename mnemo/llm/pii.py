"""Personal data in whole texts, disguised or not, with spans in the original text's code points.

Plain identifiers are found by fixed patterns. Disguised ones are found by a cascade of transducers,
each of which rewrites a text and keeps, for every character it writes, the stretch of the original
that it came from: homoglyphs and compatibility forms to ASCII, spelled digits to digits, at/dot
disguises to their signs. The same patterns run on the rewritten text and spans are mapped back.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import sliced

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")

# Letters of other scripts that look like Latin ones, and signs that look like those of addresses.
HOMOGLYPHS = dict(zip("АВЕКМНОРСТУХЅІЈаеорсухѕіјԁԛԝһ", "ABEKMHOPCTYXSIJaeopcyxsijdqwh", strict=True))
HOMOGLYPHS |= dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονρι", "ABEZHIKMNOPTYXaovpi", strict=True))
HOMOGLYPHS |= dict(zip("աոսօցհյԼՕՏᎪᎬᎻᎫᏆᏦᏞᎷᏢᏚᎢᏙᏃ", "wnuoghjLOSAEHJIKLMPSTVZ", strict=True))
HOMOGLYPHS |= dict(zip("‐‑‒–—−․。", "------..", strict=True))
INVISIBLE = frozenset("\u00ad\u034f\u180e\u200b\u200c\u200d\u2060\u2061\u2062\u2063\u2064\ufe0e\ufe0f\ufeff")
LATIN_NAME = re.compile(r"(?:LATIN LETTER SMALL CAPITAL|LATIN SMALL LETTER (?:SCRIPT|DOTLESS|INSULAR|TURNED)|LATIN SMALL LETTER|REGIONAL INDICATOR SYMBOL LETTER|(?:NEGATIVE )?(?:SQUARED|CIRCLED) LATIN CAPITAL LETTER) ([A-Z])(?: WITH (?:STROKE|HOOK|TAIL|MIDDLE TILDE|PALATAL HOOK|CROSSED-TAIL|BAR))?")


@cache
def foldings() -> dict[str, str]:
    """What every character that is not ASCII reads as, by rule: its compatibility form where that is one
    plain character, the Latin letter in its name, or the look-alike above."""
    out = {}
    for code in (*range(0x80, 0x3400), *range(0xA640, 0xA800), *range(0xAB30, 0xABC0), *range(0xFB00, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)):
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c)
        if plain.isascii() and (plain.isalnum() or plain in tuple("@.+-_%")):
            out[c] = plain
        elif m := LATIN_NAME.fullmatch(unicodedata.name(c, "")):
            out[c] = m[1] if "CAPITAL LETTER" in unicodedata.name(c) else m[1].lower()
    return out | HOMOGLYPHS


@cache
def odd() -> re.Pattern:
    """Characters that folding changes or leaves out."""
    codes = sorted(map(ord, {*foldings(), *INVISIBLE}))
    runs: list[list[int]] = []
    for c in codes:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return re.compile("[" + "".join(re.escape(chr(x)) + "-" + re.escape(chr(y)) for x, y in runs) + "]")


SPELLED = {w: str(n % 10) for n, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
SPELLED |= {w: str(n) for n, w in enumerate("null eins zwei drei vier fünf sechs sieben acht neun".split())}
SPELLED |= {w: str(n) for n, w in enumerate("zéro un deux trois quatre cinq six sept huit neuf".split())}
SPELLED |= {w: str(n) for n, w in enumerate("cero uno dos tres cuatro cinco seis siete ocho nueve".split())}
_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_UNIT = rf"(?:{_WORD}|[0-9])"
_POINT = r"(?:dot|punto|punkt|point)"
_GAP = rf"(?:[ ,.()\[\]{{}}-]{{1,4}}|\n| {_POINT} )"
SPELLED_RUN = re.compile(rf"(?<![^\W_])(?:plus[ -]+)?[(\[{{]?{_UNIT}(?:{_GAP}{_UNIT}(?![^\W_])){{6,}}", re.IGNORECASE)
SPELLED_ONE = re.compile(rf"plus|{_POINT}|{_WORD}|[0-9]|\.|[ ,\n()\[\]{{}}-]+", re.IGNORECASE)
SPELLED_HINT = re.compile(rf"\b(?:{_WORD}){_GAP}(?:{_WORD}|[0-9])\b", re.IGNORECASE)
POINTS = frozenset("dot punto punkt point".split())

# Letters that stand for digits inside a number: cards and phones, and addresses of four parts.
LOOKS = dict(zip("OoIl|SB", "0011158", strict=True))
LETTERED = re.compile(r"(?<![A-Za-z0-9])(?:\+ ?)?[0-9OoIl|SB](?:[ .()-]{0,2}[0-9OoIl|SB]){8,24}(?![A-Za-z0-9])|(?<![A-Za-z0-9.])[0-9OoIl|]{1,3}(?:\.[0-9OoIl|]{1,3}){3}(?![A-Za-z0-9])")
SPOKEN_IP = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?: ?(?: {_POINT} |\.) ?[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)
SPOKEN_POINT = re.compile(rf" ?(?: {_POINT} |\.) ?", re.IGNORECASE)
JOINED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9.+-]+(?:_dot_[A-Za-z0-9.+-]+)*(?:_at_|-at-)[A-Za-z0-9]+(?:(?:_dot_|-dot-|\.)[A-Za-z0-9]+)+(?![A-Za-z0-9])", re.IGNORECASE)
JOINED_HINT = re.compile(r"[_-]at[_-]", re.IGNORECASE)
JOINED_SIGN = re.compile(r"[_-](at|dot)[_-]", re.IGNORECASE)

# Words of prose that are also countries' domains; spoken, they end no address.
PROSE = frozenset("is it in to be by so no my me us am at as an or on of".split())


def top_level(label: str) -> bool:
    return label.lower() in TLD or (len(label) == 2 and label.isascii() and label.isalpha())


_AT, _DOT = r"(?:at|arroba|arobase|klammeraffe|@)", r"(?:dot|punto|punkt|point|\.)"
BRACKETED = re.compile(rf"[ \t]*[\[({{<]\s{{0,2}}(?:(?P<at>{_AT})|(?P<dot>{_DOT}))\s{{0,2}}[\])}}>][ \t]*", re.IGNORECASE)
# Top-level domains.
TLD = frozenset(
    "com net org edu gov mil int arpa info biz name pro aero asia cat coop jobs mobi museum post tel travel xxx academy agency app art bank bar beer berlin bio bike blog build business cafe camera camp capital care cash center "
    "chat church city click clinic cloud club coach codes coffee community company computer consulting cool country credit dance data date deals dental design dev digital direct doctor domains education email energy engineer "
    "engineering estate events exchange expert express family farm fashion film finance fit fitness flights foundation fun fund gallery game games garden gift global gmbh gold golf group guide guru hamburg health help holdings "
    "host hosting hotel house institute international jetzt koeln land law legal life link live loan lol london ltd management market marketing media money moscow network news ninja one online page paris partners parts photo "
    "photography photos pictures pizza place plus press productions properties quebec radio rent repair report rest restaurant reviews rocks run sale school science security services shop show site ski social software solutions "
    "space store stream studio style supply support surf swiss systems tax team tech technology tips tirol today tools top tours town toys trade training university vegas video vip vision vote watch website wedding wien wiki "
    "win wine work works world wtf xyz yoga zone "
    "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bv bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr "
    "ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq "
    "mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn "
    "to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw".split()
)
SIGN = re.compile(r" at | @ |@", re.IGNORECASE)
HOST = re.compile(r"[A-Za-z0-9-]+(?:(?: dot | \. |\.)[A-Za-z0-9-]+)+", re.IGNORECASE)
HOST_STEP = re.compile(r"( dot | \. |\.)([A-Za-z0-9-]+)", re.IGNORECASE)
SPOKEN_PART = re.compile(r" at | @ | dot | \. ", re.IGNORECASE)
ADDRESSED = re.compile(r"[0-9_.+]| dot ", re.IGNORECASE)
MARGIN = 330


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def plain_spans(text: str) -> list[tuple[int, int, str]]:
    """Base identifiers, leftmost and non-overlapping per kind; failing matches are dropped, not retried."""
    out = []
    at = text.find("@")
    free = 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = NOT_DIGITS.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGITS.sub("", m.group())) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


Tape = list[tuple[str, int, int, bool]]  # (character, start, end in the original, rewritten)


def fold_lookalikes(tape: Tape) -> Tape:
    out: Tape = []
    known = foldings()
    for c, a, b, changed in tape:
        if c < "\x80":
            out.append((c, a, b, changed))
        elif c not in INVISIBLE:
            out += [(x, a, b, True) for x in known[c]] if c in known else [(c, a, b, changed)]
    return out


def _rewrite(tape: Tape, pattern: re.Pattern, write) -> Tape:
    """Replace every match by the characters ``write(match)`` gives with their places in the match."""
    text = "".join(c for c, *_ in tape)
    out: Tape = []
    at = 0
    for m in pattern.finditer(text):
        out += tape[at : m.start()]
        for char, a, b, changed in write(m):
            out.append((char, tape[a][1], tape[b - 1][2], changed or any(x[3] for x in tape[a:b])))
        at = m.end()
    return out + tape[at:]


def spell_digits(tape: Tape) -> Tape:
    def write(m: re.Match) -> Iterator[tuple[str, int, int, bool]]:
        for one in SPELLED_ONE.finditer(m.group()):
            word, a, b = one.group().lower(), m.start() + one.start(), m.start() + one.end()
            if word == "plus":
                yield "+", a, b, True
            elif word in SPELLED:
                yield SPELLED[word], a, b, True
            elif word in POINTS:
                yield ".", a, b, True
            elif word.isdigit() or word == ".":
                yield word, a, b, False

    return _rewrite(tape, SPELLED_RUN, write)


def lettered_digits(tape: Tape) -> Tape:
    def write(m: re.Match) -> Iterator[tuple[str, int, int, bool]]:
        whole = m.group()
        change = any(c in LOOKS for c in whole) and any(c.isdigit() for c in whole)
        for k, c in enumerate(whole, m.start()):
            yield LOOKS.get(c, c) if change else c, k, k + 1, change and c in LOOKS

    return _rewrite(tape, LETTERED, write)


def _signs(pattern: re.Pattern, sign) -> Callable[[re.Match], Iterator[tuple[str, int, int, bool]]]:
    """Write a match with the signs that ``pattern`` finds in it replaced by what ``sign`` makes of them."""
    def write(m: re.Match) -> Iterator[tuple[str, int, int, bool]]:
        at = m.start()
        for part in pattern.finditer(m.string, m.start(), m.end()):
            yield from ((m.string[k], k, k + 1, False) for k in range(at, part.start()))
            yield sign(part), part.start(), part.end(), part.group() != "."
            at = part.end()
        yield from ((m.string[k], k, k + 1, False) for k in range(at, m.end()))

    return write


def sign_disguises(tape: Tape) -> Tape:
    tape = _rewrite(tape, SPOKEN_IP, _signs(SPOKEN_POINT, lambda part: "."))
    tape = _rewrite(tape, JOINED, _signs(JOINED_SIGN, lambda part: "@" if part[1].lower() == "at" else "."))
    tape = _rewrite(tape, BRACKETED, lambda m: [("@" if m["at"] else ".", m.start(), m.end(), True)])

    text = "".join(c for c, *_ in tape)
    out: Tape = []
    at = 0
    for start, end in spoken_addresses(text):
        for part in SPOKEN_PART.finditer(text, start, end):
            out += tape[at : part.start()]
            sign = "@" if part.group().strip().lower() in ("at", "@") else "."
            out.append((sign, tape[part.start()][1], tape[part.end() - 1][2], True))
            at = part.end()
    return out + tape[at:]


def spoken_addresses(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that read as an address once the signs in them that are spoken or spaced are written.

    A host ends at its last known top-level domain. After an @, where it has none, any two letters or
    more will do.
    """
    free = 0
    for sign in SIGN.finditer(text):
        host = HOST.match(text, sign.end())
        if not host:
            continue
        start = sign.start()
        while True:
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start - free > 5 and text[start - 5 : start].lower() == " dot " and text[start - 6] in LOCAL:
                start -= 5
            else:
                break
        if start >= sign.start() or text[start] == " " or (start and text[start - 1].isalnum()):
            continue
        known = other = 0
        for step in HOST_STEP.finditer(text, host.start(), host.end()):
            label, spoken = step[2], step[1] != "."
            if step.end() < len(text) and text[step.end()].isalnum():
                continue
            if top_level(label) and not (spoken and label.lower() in PROSE) and (label.islower() or label.isupper() or spoken):
                known = step.end()
            elif label.isascii() and label.isalpha() and len(label) > 1 and (label.islower() or step[1] != " . "):
                other = step.end()
        # any label will do after an @, or where what lies before reads as an address by itself
        end = known or (other if "@" in sign.group() or ADDRESSED.search(text, start, sign.start()) else 0)
        if end and SPOKEN_PART.search(text, start, end):
            yield start, end
            free = end


SPACE = re.compile(r"\s")
PLAIN = re.compile(r"[A-Za-z0-9@]")
NUMERIC = re.compile(r"[0-9@]")


def folded_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Stretches between white space in which folding can bring out an identifier.

    A letter that looks like a Latin one does so only beside ASCII letters, digits or an @: a word wholly in another
    script is left alone. A folded digit or @ does so anywhere, another sign only next to digits.
    """
    known, free = foldings(), 0
    while m := odd().search(text, free):
        a = m.start()
        while a > free and not text[a - 1].isspace():
            a -= 1
        end = SPACE.search(text, m.end())
        b = free = end.start() if end else len(text)
        token = text[a:b]
        if PLAIN.search(token):
            yield a, b
            continue
        signs = {known.get(c, "") for c in odd().findall(token)}
        if any(NUMERIC.search(x) for x in signs) or (not all(x.isalpha() for x in signs) and NUMERIC.search(text[max(0, a - 2) : a] + text[b : b + 2])):
            yield a, b


def _triggers(text: str) -> list[tuple[int, int]]:
    found = []
    if not text.isascii():
        found += folded_tokens(text)
    if any(c in text for c in "[({<"):
        found += [m.span() for m in BRACKETED.finditer(text)]
    found += spoken_addresses(text)
    if SPELLED_HINT.search(text):
        found += [m.span() for m in SPELLED_RUN.finditer(text)]
    if JOINED_HINT.search(text):
        found += [m.span() for m in JOINED.finditer(text)]
    if DIGIT.search(text):
        found += [m.span() for m in SPOKEN_IP.finditer(text) if " " in m.group()]
        found += [m.span() for m in LETTERED.finditer(text) if any(c in LOOKS for c in m.group()) and DIGIT.search(m.group())]
    return found


def disguised_spans(text: str) -> list[tuple[int, int, str]]:
    """Identifiers that show only after rewriting, as spans of the original text."""
    triggers = sorted(_triggers(text))
    if not triggers:
        return []
    windows: list[list[int]] = []
    for a, b in triggers:
        a, b = max(0, a - MARGIN), min(len(text), b + MARGIN)
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if windows and a <= windows[-1][1]:
            windows[-1][1] = max(b, windows[-1][1])
        else:
            windows.append([a, b])
    out = []
    for a, b in windows:
        tape: Tape = [(c, a + k, a + k + 1, False) for k, c in enumerate(text[a:b])]
        tape = sign_disguises(spell_digits(lettered_digits(fold_lookalikes(tape))))
        for s, e, kind in plain_spans("".join(c for c, *_ in tape)):
            if kind == "email" and not tape[e - 1][0].isalpha():
                continue
            if any(changed for *_, changed in tape[s:e]):
                start, end = tape[s][1], tape[e - 1][2]
                while text[start].isspace():
                    start += 1
                while text[end - 1].isspace():
                    end -= 1
                out.append((start, end, kind))
    return out


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def detect(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    base = plain_spans(text)
    known = set(base)
    extra = [s for s in disguised_spans(text) if s not in known and not any(k == s[2] and a <= s[0] and s[1] <= b for a, b, k in base)]
    return base, extra


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of plain identifiers by kind, a digest of their spans, and all spans.

    Null text is empty: no spans. Texts are read whole; repeated rows are answered each; an empty
    table gives an empty result. Spans are code points, end exclusive, ordered by start, then kind.
    A span of the transducers is added where rewriting played a part in it and no plain span of its
    kind covers it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            digests, spans = [], []
            for value in batch.column(1):
                base, extra = detect(value.as_py() or "")
                for k in KINDS:
                    counts[k].append(sum(s[2] == k for s in base))
                digests.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                spans.append(_listed([*base, *extra]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
