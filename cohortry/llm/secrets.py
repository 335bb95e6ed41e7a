"""Secret scans: sliding-window Shannon entropy per character class over candidate strings, with an allow-list.

Candidates are runs of characters that keys are written in. Over each a window slides; the counts of characters change
by one in and one out, and with them the window's entropy. A candidate is a secret where a window's entropy passes
the threshold of the candidate's class, unless the allow-list knows its form (UUIDs, digests named as such, paths, words, file
names, dates). Spans that patterns find (assignments, access keys, long hex runs) form the base and always stay.
"""

from __future__ import annotations

import bisect
import math
import re

from pyspark.sql import DataFrame

from .common import map_texts

#: Base kinds in their order, fixed values of the contract: expression, group that carries the length, its least length.
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")

#: class name, its characters, window, bits a character that a secret's window passes
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]+"), 16, 3.0),
    ("alnum", re.compile(r"[A-Za-z0-9]+"), 20, 3.7),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 20, 3.9),
)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGITS, _UPPERS, _LOWERS = re.compile(r"[0-9]"), re.compile(r"[A-Z]"), re.compile(r"[a-z]")
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"[0-9]+"),
    re.compile(r"[A-Za-z_-]+"),
    re.compile(r"[A-Za-z]+([-_][A-Za-z0-9]{1,12})+"),
    re.compile(r"(.)\1*"),
)
_SIGNS = "=_+/-"
#: Paths by their outer form; their segments are looked at one by one.
_PATH = re.compile(r"/?([A-Za-z0-9_-]{1,36}/)+[A-Za-z0-9_-]*")
_PLAIN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8}")
_RUN = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: What may stand before a digest that is no secret.
_NAMED = re.compile(r"(?:sha-?(?:1|224|256|384|512)|md5|commit|checksum|digest|integrity|etag)[\"']?[\x20:=-]{0,3}[\"']?$", re.I | re.A)


def max_entropy(s: str, window: int) -> float:
    """The highest Shannon entropy, in bits a character, of a window of ``s`` (of all of it, if it is shorter)."""
    size = min(window, len(s))
    if not size:
        return 0.0
    plogp = [0.0, *(k * math.log2(k) for k in range(1, size + 1))]
    count: dict[str, int] = {}
    total = 0.0  # the sum of k log k over the counts: entropy is log n - total / n
    best = math.inf
    for i, c in enumerate(s):
        k = count.get(c, 0)
        total += plogp[k + 1] - plogp[k] if i < size else 0.0
        if i >= size:
            gone = s[i - size]
            j = count[gone]
            total += plogp[j - 1] - plogp[j]
            count[gone] = j - 1
            k = count.get(c, 0)
            total += plogp[k + 1] - plogp[k]
        count[c] = k + 1
        if i >= size - 1 and total < best:
            best = total
    return math.log2(size) - best / size


def wordlike(segment: str) -> bool:
    """True if words and numbers make up ``segment``: parts between - and _ change seldom between cases and digits."""
    parts = [p for p in re.split("[-_]", segment) if p]
    if len(segment) > 24:
        return all(_PLAIN.fullmatch(p) and len(p) <= 24 for p in parts)
    return all(len(p) <= 3 or len(_RUN.findall(p)) <= 1 + len(p) / 4 for p in parts)


def is_path(s: str) -> bool:
    """True if every segment is word-like or a UUID, but for parts of few bits, together shorter than a candidate."""
    if not _PATH.fullmatch(s):
        return False
    segments = [x for x in s.split("/") if not wordlike(x) and not ALLOW[0].fullmatch(x)]
    odd = [p for x in segments for p in ([x] if len(x) > 24 else re.split("[-_]", x)) if not wordlike(p)]
    return sum(map(len, odd)) < 20 and all(max_entropy(x, 16) <= 3.0 for x in odd)


def ruled(s: str) -> bool:
    """True for a rule of signs with a short title in it."""
    return s[0] in _SIGNS and s[-1] in _SIGNS and len(s.strip(_SIGNS)) <= 8


def allowed(s: str, before: str) -> bool:
    """True for forms that look random but name no secret; ``before`` is what stands in front of ``s``."""
    return ruled(s) or any(p.fullmatch(s) for p in ALLOW) or is_path(s) or bool(_NAMED.search(before))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, per kind leftmost and without overlap, by start and kind's order."""
    low = text.lower()  # only to pass over texts without a key's name
    named = any(k in low for k in ("passw", "secret", "token", "apikey", "api_key"))
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12] if named else []
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _suspect(s: str) -> str | None:
    """The class of ``s`` if it mixes digits and letters and a window passes its class's threshold."""
    if not _DIGITS.search(s) or not (_LOWERS.search(s) or _UPPERS.search(s)):
        return None
    name, _, window, bits = next(c for c in CLASSES if c[1].fullmatch(s))
    return name if max_entropy(s, window) >= bits else None


def entropy_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates that windows of high entropy betray, without what the base covers, and that the allow-list does not know.

    What a base span leaves of a candidate is judged as a candidate of its own. A shorter rest counts as well, if the
    whole is one secret around a key or hex run, unless the rest is word-like.
    """
    out = []
    # spans of one kind are apart and in order, so that those that a candidate touches are neighbours
    kinds = [[x for x in base if x[2] == k] for k in KINDS]
    bounds = [([x[0] for x in own], [x[1] for x in own]) for own in kinds]
    for m in _CANDIDATE.finditer(text):
        s, e = m.span()
        before = text[max(0, s - 24) : s]
        cuts = [x for own, (starts, ends) in zip(kinds, bounds) if own for x in own[bisect.bisect_right(ends, s) : bisect.bisect_left(starts, e)]]
        if not cuts:
            if (name := _suspect(m.group())) and not allowed(m.group(), before):
                out.append((s, e, f"entropy_{name}"))
            continue
        one = all(k != "assign" for *_, k in cuts) and _suspect(m.group()) and not allowed(m.group(), before)
        at = s
        for a, b, _ in (*sorted(cuts), (e, e, "")):
            part = text[at : max(at, a)]
            if len(part) >= 20 and (name := _suspect(part)) and not allowed(part, text[max(0, at - 24) : at]):
                out.append((at, a, f"entropy_{name}"))
            elif one and (core := part.strip(_SIGNS)) and not wordlike(core) and not any(p.fullmatch(core) for p in ALLOW):
                start = at + part.index(core)
                out.append((start, start + len(core), f"entropy_{next(c[0] for c in CLASSES if c[1].fullmatch(core))}"))
            at = max(at, b)
    return out


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep``, ``base`` and ``added``: arrays of spans in code points, end exclusive, in order.

    Null and empty texts have no spans. Null ids stay; repeated rows are scanned each; an empty table gives an empty
    one. Spans that start at one place are in the order of the kinds. Very long texts are scanned whole, in slices of bounded
    size and time that grows with their length. An output replaces a column of its name among ``keep``.
    """

    def each(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {"base": [], "added": []}
        for text in texts:
            base = base_spans(text)
            for name, spans in (("base", base), ("added", entropy_spans(text, base))):
                out[name].append([{"start": s, "stop": e, "kind": k} for s, e, k in spans])
        return out

    span = "array<struct<start:long,stop:long,kind:string>>"
    return map_texts(docs, text_col, list(dict.fromkeys((id_col, *keep))), f"base {span}, added {span}", each)
