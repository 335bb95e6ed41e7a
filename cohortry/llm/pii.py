"""Personal data by a semi-Markov conditional random field over candidate regions.

Regions are runs of characters that numbers, dates and addresses are written in, of any length, and what base spans leave of
them; account numbers with letter groups are regions where their checksum holds, and so are house numbers with a street. A region is cut into atoms (digit
groups, letter groups, separators); a segment is a run of at most ``MAX_ATOMS`` atoms with a type or outside. Features
look at a whole segment (its digits, layout, checksum, neighbours, words before it). The best segmentation, boundaries
and types together, comes from a dynamic program over atom positions; weights come from maximum-likelihood training
on lines made from rules below, on the driver, once a process. Patterns of the base are found apart and always stay; the
field only adds segments that touch none of them.
"""

from __future__ import annotations

import functools
import math
import random
import re

from pyspark.sql import DataFrame

from .common import map_texts

#: Base kinds in their order, fixed values of the contract; the field's own types follow.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "iban", "dob", "passport", "address")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: From the first digit of a run on, runs taken whole: what fails there fails from each later digit as well, and time grows with the text's length.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

MAX_ATOMS = 13
#: An account number behind a country code has up to 34 characters in groups of four.
IBAN_ATOMS = 42


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns by kind, then start; per kind leftmost and without overlap."""
    out = []
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        # an address starts where the run of its characters before the @ starts, but not inside the one before
        head = text[end:at]
        start = end + len(head.rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            end = at = m.end()
        else:
            at = at + 1
            end = max(end, at)
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(int(x) <= 255 for x in m.group().split(".") if len(x) < 9) and all(len(x.lstrip("0")) < 4 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


# ---- the field

_REGION = re.compile(r"(?<![A-Za-z0-9])[+(]?(?:[A-Z]{1,2})?[0-9](?:[ ().+/-]{0,2}[0-9]){5,}(?![A-Za-z0-9])")
#: A house number and a street, in the orders and words of four languages.
_STREET = re.compile(
    r"(?<![\w-])(?:[0-9]{1,5}[A-Za-z]?(?:\x20[A-Z][a-z]{1,20}){1,3}\x20(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Square|Terrace)"
    r"|[A-ZÄÖÜ][a-zäöüß]{2,20}(?:straße|strasse|weg|platz|gasse|allee|ufer)\x20[0-9]{1,4}[a-z]?"
    r"|[0-9]{1,4}(?:\x20(?:bis|ter))?,?\x20(?:rue|avenue|boulevard|chemin|place|impasse)(?:\x20[A-Za-zÀ-ÿ'-]{1,20}){1,4}?(?=[,.;\n]|$|\x20[0-9])"
    r"|(?:[Cc]alle|[Aa]venida|[Pp]laza|[Pp]aseo)(?:\x20[A-Za-zÀ-ÿ]{1,20}){1,4},?\x20[0-9]{1,4})(?![\w-])"
)
_LETTERED = re.compile(r"[A-Z]{1,2}[0-9]{6,8}")
_DATE = re.compile(r"[12][0-9]{3}[-/.][01]?[0-9][-/.][0-3]?[0-9]|[0-3]?[0-9][-/.][0-3]?[0-9][-/.][12][0-9]{3}")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_COUNTRY = re.compile(r"[A-Z]{2}")
_CONTEXT = 32
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")
_CUES = {
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "card": ("card", "visa", "credit", "karte", "tarjeta", "carte"),
    "ssn": ("ssn", "social security", "social"),
    "iban": ("iban", "account", "konto"),
    "dob": ("born", "dob", "birth", "geboren", "geb.", "né le", "née le", "naissance", "nacid", "nacimiento"),
    "passport": ("passport", "pasaporte", "reisepass", "passeport", "passnummer"),
    "address": ("address", "lives at", "live at", "wohnt", "adresse", "direcci", "ship to", "habite", "vive en"),
}


def _shape(s: str) -> str:
    """Digit groups by their lengths, letters as a, separators as they are, a space as _."""
    return "".join(str(min(9, len(a))) if a[0].isdigit() else "a" if a.isalpha() else "_" if a == " " else a for a in _ATOM.findall(s))


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(segment: str, kind: str, before: str, whole: bool) -> list[str]:
    """Names of the features of a whole segment under a type; ``whole`` if it fills its region."""
    d = _digits(segment)
    shape = _shape(segment)
    out = [f"{kind}:bias", f"{kind}:digits{min(20, len(d))}", f"{kind}:first{segment[0] if not segment[0].isalnum() else 'a' if segment[0].isalpha() else '9'}"]
    out.append(f"{kind}:whole{int(whole)}")
    if 13 <= len(d) <= 19 and not segment[0].isalpha():
        out.append(f"{kind}:luhn{int(luhn(d))}")
    if re.fullmatch(r"\(?[2-9][0-9]{2}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}", segment):
        out.append(f"{kind}:national")
    if shape == "3-2-4":
        out.append(f"{kind}:3-2-4")
    if segment[:2].isalpha():
        out.append(f"{kind}:iban{int(_iban_ok(segment))}")
    if _DATE.fullmatch(segment):
        out.append(f"{kind}:date")
    if _LETTERED.fullmatch(segment):
        out.append(f"{kind}:lettered")
    if re.fullmatch(r"0[0-9](?:[ .-][0-9]{2}){4}|00[0-9 ]{9,16}|0[0-9]{2,4}[ /-][0-9]{5,8}", segment):
        out.append(f"{kind}:trunk")
    if _STREET.fullmatch(segment):
        out.append(f"{kind}:street")
    for k, cues in _CUES.items():
        if any(c in before for c in cues):
            out.append(f"{kind}:cue_{k}")
    return out


def _segments(region: str) -> tuple[list[int], list[int]]:
    """Starts and ends of a region's atoms."""
    spans = [m.span() for m in _ATOM.finditer(region)]
    return [a for a, _ in spans], [b for _, b in spans]


def _sensible(segment: str) -> bool:
    """True for segments that can be an entity at all: enough digits, a letter or two before digits, or a street."""
    if _LETTERED.fullmatch(segment) or _STREET.fullmatch(segment):
        return True
    if not (segment[0].isalnum() or segment[0] in "+(") or sum("0" <= c <= "9" for c in segment) < 7:
        return False
    return segment[-1].isdigit() or _iban_ok(segment)


_TYPES = ("card", "phone", "ssn", "iban", "dob", "passport", "address")


def _scored(region: str, before: str, w: dict[str, float], starts: list[int], ends: list[int]):
    """(first atom, last atom, type, score, features) of the segments that may hold an entity; outside scores 0 an atom."""
    for i, at in enumerate(starts):
        near = (before + region[max(0, at - _CONTEXT) : at].lower())[-_CONTEXT:]
        code = _COUNTRY.fullmatch(region, at, ends[i])
        for j in range(i, min(len(starts), i + (IBAN_ATOMS if code else MAX_ATOMS))):
            s = region[at : ends[j]]
            if _sensible(s) and (j < i + MAX_ATOMS or _iban_ok(s)):
                for kind in _TYPES:
                    f = features(s, kind, near, len(s) == len(region))
                    yield i, j, kind, sum(w.get(x, 0.0) for x in f), f


def _scores(region: str, before: str, w: dict[str, float]):
    """Starts and ends of a region's atoms, and its scored segments."""
    starts, ends = _segments(region)
    return starts, ends, list(_scored(region, before, w, starts, ends))


def decode(region: str, before: str, w: dict[str, float]) -> list[tuple[int, int, str]]:
    """The best segmentation's entities: (start, end, type) within ``region``. Ties go to fewer, earlier entities."""
    starts, ends = _segments(region)
    # a segment that scores no more than outside is on no best path, and a long region has many
    segments = [x[:4] for x in _scored(region, before, w, starts, ends) if x[3] > 0]
    n = len(starts)
    best, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
    by_end: dict[int, list] = {}
    for x in segments:
        by_end.setdefault(x[1] + 1, []).append(x)
    for t in range(1, n + 1):
        best[t], back[t] = best[t - 1], None
        for x in by_end.get(t, ()):
            if best[x[0]] + x[3] > best[t] + 1e-12:
                best[t], back[t] = best[x[0]] + x[3], x
    out, t = [], n
    while t:
        if (x := back[t]) is None:
            t -= 1
        else:
            out.append((starts[x[0]], ends[x[1]], x[2]))
            t = x[0]
    return out[::-1]


def _gradient(region: str, before: str, gold: set, w: dict[str, float]) -> dict[str, float]:
    """Of the log-likelihood: features of the gold segments less their expectation (forward and backward sums)."""
    starts, ends, segments = _scores(region, before, w)
    n = len(starts)
    alpha, beta = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b)
    by_end: dict[int, list] = {}
    by_start: dict[int, list] = {}
    for x in segments:
        by_end.setdefault(x[1] + 1, []).append(x)
        by_start.setdefault(x[0], []).append(x)
    for t in range(1, n + 1):
        alpha[t] = alpha[t - 1]
        for x in by_end.get(t, ()):
            alpha[t] = add(alpha[t], alpha[x[0]] + x[3])
    for t in range(n - 1, -1, -1):
        beta[t] = beta[t + 1]
        for x in by_start.get(t, ()):
            beta[t] = add(beta[t], beta[x[1] + 1] + x[3])
    out: dict[str, float] = {}
    for i, j, kind, score, f in segments:
        p = math.exp(alpha[i] + score + beta[j + 1] - alpha[n])
        g = ((starts[i], ends[j], kind) in gold) - p
        if abs(g) > 1e-6:
            for x in f:
                out[x] = out.get(x, 0.0) + g
    return out


def training_lines(n: int, seed: int) -> list[tuple[str, str, set]]:
    """(text before, region, entities) made by rule: entities in common layouts, and numbers that are none."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        k = r.choice((13, 14, 15, 16, 16, 16))
        d = r.choice("3456") + num(k - 2)
        d += next(c for c in "0123456789" if luhn(d + c))
        if k == 15:
            return r.choice((d, f"{d[:4]} {d[4:10]} {d[10:]}"))
        return r.choice((d, " ".join(d[i : i + 4] for i in range(0, k, 4)), "-".join(d[i : i + 4] for i in range(0, k, 4))))

    def phone() -> str:
        a, b, c = r.choice("23456789") + num(2), num(3), num(4)
        pairs = " ".join(num(2) for _ in range(4))
        return r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"0{num(1)} {pairs}", f"0{num(2)}/{num(7)}", f"0049 {num(2)} {num(7)}"))

    def dob() -> str:
        y, m, d = r.randint(1930, 2012), r.randint(1, 12), r.randint(1, 28)
        return r.choice((f"{y}-{m:02d}-{d:02d}", f"{d:02d}.{m:02d}.{y}", f"{m:02d}/{d:02d}/{y}", f"{d:02d}/{m:02d}/{y}"))

    def passport() -> str:
        return r.choice((r.choice("CFGHKLX") + num(8), "".join(r.choice("ABCDLMPX") for _ in range(2)) + num(7), num(9)))

    def address() -> str:
        name = r.choice(("Oak", "Baker", "King George", "Mill", "Park", "Lincoln", "Old Church", "River"))
        own = r.choice(("Linden", "Berg", "Schiller", "Garten", "Bahnhof", "Kirch"))
        return r.choice(
            (
                f"{r.randint(1, 9999)} {name} {r.choice(('Street', 'St', 'Avenue', 'Road', 'Lane', 'Drive', 'Court'))}", f"{own}{r.choice(('straße', 'weg', 'platz', 'allee'))} {r.randint(1, 200)}",
                f"{r.randint(1, 200)} rue de la {r.choice(('Paix', 'République', 'Gare'))}", f"Calle {r.choice(('Mayor', 'del Sol', 'Real'))}, {r.randint(1, 200)}",
            )
        )

    def iban() -> str:
        bank = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(4))
        code, body = r.choice((("DE", num(18)), ("GB", bank + num(14)), ("NL", bank + num(10)), ("FR", num(14) + bank[0] + num(8))))
        check = 98 - int("".join(str(int(c, 36)) for c in body + code + "00")) % 97
        whole = f"{code}{check:02d}{body}"
        return r.choice((whole, " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))))

    def none() -> str:
        return r.choice(
            (
                num(r.randint(7, 20)), f"{r.randint(1900, 2099)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{num(3)} {num(3)} {num(3)}", f"{num(2)}.{num(2)}.{num(4)}",
                f"{num(5)}-{num(4)}", f"{num(4)}/{num(4)}", f"{num(3)}-{num(3)}-{num(3)}", f"{num(8)}-{num(6)}", f"{num(2)} {num(2)} {num(2)} {num(2)}", f"{num(1)}-{num(3)}-{num(5)}-{num(1)}",
            )
        )

    out = []
    for _ in range(n):
        kind = r.choice(("card", "phone", "ssn", "iban", "dob", "passport", "address", *["none"] * 7))
        makers = {"card": card, "phone": phone, "ssn": lambda: f"{num(3)}-{num(2)}-{num(4)}", "iban": iban, "dob": dob, "passport": passport, "address": address, "none": none}
        text = makers[kind]()
        # some kinds are told by their cue alone, as their layout is that of other numbers
        alone = kind in ("ssn", "dob", "passport")
        cue = r.choice(_CUES[kind]) + r.choice((" ", ": ", " no. ")) if alone or kind != "none" and r.random() < 0.4 else r.choice(("ref ", "order ", "", "", "no. ", "page ", "on "))
        if kind == "none" and r.random() < 0.45:
            text = r.choice((lambda: f"{num(3)}-{num(2)}-{num(4)}", dob, passport, dob))()
        out.append((cue, text, set() if kind == "none" else {(0, len(text), kind)}))
    return out


@functools.cache
def trained(lines: int = 1500, rounds: int = 6, seed: int = 11) -> dict[str, float]:
    """Weights after stochastic gradient ascent on ``lines`` made lines, with a small pull to zero. Deterministic."""
    w: dict[str, float] = {f"{k}:bias": -1.0 for k in _TYPES}
    data = training_lines(lines, seed)
    for at in range(rounds):
        rate = 0.5 / (1 + at)
        for before, region, gold in data:
            for k, g in _gradient(region, before, gold, w).items():
                w[k] = w.get(k, 0.0) * (1 - 1e-4) + rate * g
    return w


def _gaps(start: int, end: int, spans) -> list[tuple[int, int]]:
    """What ``spans`` (with start and end first) leave of a range."""
    out = []
    for a, b in (*sorted(x[:2] for x in spans), (end, end)):
        if start < a:
            out.append((start, a))
        start = max(start, b)
    return out


def _accounts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Ranges of account numbers whose checksum holds, the longest at each place, whole words only."""
    out = []
    while m := _IBAN.search(text, start, end):
        s = m.start()
        ends = (x for x in range(m.end(), s + 14, -1) if text[x - 1] != " " and not text[x : x + 1].isalnum() and _iban_ok(text[s:x]))
        if (e := next(ends, None)) is not None:
            out.append((s, e))
        start = s + 2 if e is None else e
    return out


def field_spans(text: str, base: list[tuple[int, int, str]], w: dict[str, float]) -> list[tuple[int, int, str]]:
    """Entities that the field adds, none of them touching a base span: these are cut out, and the rests decoded."""
    found = []
    for a, b in _gaps(0, len(text), base):
        own = _accounts(text, a, b)
        own += [m.span() for x, y in _gaps(a, b, own) for m in _STREET.finditer(text, x, y)]
        found += own
        found += [m.span() for x, y in _gaps(a, b, own) for m in _REGION.finditer(text, x, y)]
    out = []
    for s, e in sorted(found):
        before = text[max(0, s - _CONTEXT) : s].lower()
        out += [(s + a, s + b, k) for a, b, k in decode(text[s:e], before, w)]
    return out


def pii_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep``, ``base`` and ``added``: arrays of spans in code points, end exclusive, by kind then start.

    Null and empty texts have no spans. Null ids stay; repeated rows are scanned each; an empty table gives an empty
    one. Of segmentations of equal scores the one with fewer and earlier entities is taken. Very long texts are scanned whole; a
    region may be of any length, but its segments are bounded, so that time grows with a text's length. An output
    replaces a column of its name among ``keep``.
    """
    w = trained()

    def each(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {"base": [], "added": []}
        for text in texts:
            base = base_spans(text)
            added = sorted(field_spans(text, base, w), key=lambda x: (KINDS.index(x[2]), x[0]))
            for name, spans in (("base", base), ("added", added)):
                out[name].append([{"start": s, "stop": e, "kind": k} for s, e, k in spans])
        return out

    span = "array<struct<start:long,stop:long,kind:string>>"
    return map_texts(docs, text_col, list(dict.fromkeys((id_col, *keep))), f"base {span}, added {span}", each)
