"""License scans: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment.

Texts become their lower-cased words joined by single spaces, and the rules, written by hand in ``license_rules``, are
regular expressions over that form. A rule runs only where all of its keywords stand, which each of its matches holds: the
prefilter saves time and changes no result. A detection lies in the words it covers: one contained in another goes; of
others that overlap, the one of lower priority. Both are sweeps over sorted places. Phrases of the base are found apart and
always stay.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts
from .license_rules import FRAGMENTS, TABLES

#: ASCII characters other than digits and letters part words; A-Z become a-z; all others stay.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

#: Base phrases and their labels, fixed values of the contract.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))



@dataclass(frozen=True)
class Signature:
    label: str
    priority: int
    keywords: tuple[bytes, ...]
    confidence: float
    pattern: re.Pattern


def _expanded(expression: str) -> str:
    for name, own in FRAGMENTS.items():
        expression = expression.replace(name, own)
    return expression


def signatures(tables: tuple[str, ...] = TABLES) -> list[Signature]:
    """The rules of ``tables`` (lines as ``license_rules`` has them), the highest priority first."""
    rules = []
    for line in (x for t in tables for x in t.strip().splitlines()):
        label, priority, keywords, confidence, expression = line.split("; ", 4)
        own = tuple(k.replace("_", " ").encode() for k in keywords.split("+"))
        # a match is of whole words: a name's version must not end inside a number
        rules.append(Signature(label, int(priority), own, float(confidence), re.compile(f"(?<= )(?:{_expanded(expression)})(?= )".encode())))
    return sorted(rules, key=lambda r: (-r.priority, r.label))


#: Words of keywords that any prose holds: no roots, if a keyword has another word.
_COMMON = frozenset("the and for not you may this any what use see under free with all can are has its from must used work person other terms beer open java".split())


def roots_of(rules: list[Signature]) -> dict[bytes, list[int]]:
    """Parts of keywords, each with the rules that need it, every rule at one of them: where it is missing they need no look.

    The part that the most rules need comes first, and so on until all are covered.
    """
    needs = {}
    for i, r in enumerate(rules):
        parts = {w for k in r.keywords for w in k.split() if len(w) > 2 and w.decode() not in _COMMON}
        needs[i] = parts or set(r.keywords)
    out: dict[bytes, list[int]] = {}
    while needs:
        count = Counter(x for own in needs.values() for x in own)
        best = max(count, key=lambda x: (count[x], len(x), x))
        out[best] = [i for i, own in needs.items() if best in own]
        needs = {i: own for i, own in needs.items() if best not in own}
    return out


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_WORDS).split()


def uncontained(found: list[tuple]) -> list[tuple]:
    """Of detections (start, end, priority, label, confidence) those that no other contains; of equal places the first by priority.

    In order of starts, the longer first, one is contained if an end before it reaches as far.
    """
    out, reach = [], -1
    for x in sorted(set(found), key=lambda x: (x[0], -x[1], -x[2], x[3], -x[4])):
        if x[1] > reach:
            out.append(x)
            reach = x[1]
    return out


def by_priority(found: list[tuple]) -> list[tuple]:
    """Of detections that may overlap those that stay when the highest priority, then the longest, then the first is taken."""
    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for x in sorted(found, key=lambda x: (-x[2], x[0] - x[1], x[0], x[3])):
        at = bisect.bisect_left(starts, x[1])
        # those taken are apart, so that only the last one that starts before this one's end can reach into it
        if not at or ends[at - 1] <= x[0]:
            place = bisect.bisect_left(starts, x[0])
            starts.insert(place, x[0])
            ends.insert(place, x[1])
            kept.append(x)
    return kept


def scan(raw: bytes, rules: list[Signature], base=BASE, gated: bool = True, roots: dict[bytes, list[int]] | None = None) -> dict:
    """Words, base places, and the detections that remain: (first word, word after the last, label, confidence).

    Without ``gated`` every rule runs over every text, with the same result; so it is with and without ``roots``.
    """
    words = words_of(raw)
    out = {"n_words": len(words), "base": [], "found": []}
    line = b" " + b" ".join(words) + b" "
    places: list[tuple[int, str]] = []
    for phrase, label in base:
        sought, at = f" {phrase} ".encode(), -1
        while (at := line.find(sought, at + 1)) >= 0:
            places.append((at, label))
    holds: dict[bytes, bool] = {}
    taken: list[tuple[int, int, int, str, float]] = []
    if roots is not None:
        rules = [rules[i] for i in sorted(i for x, own in roots.items() if x in line for i in own)]
    for r in rules:
        if gated:
            for k in r.keywords:
                if k not in holds:
                    holds[k] = k in line
                if not holds[k]:
                    break
            else:
                taken += [(m.start(), m.end(), r.priority, r.label, r.confidence) for m in r.pattern.finditer(line)]
        else:
            taken += [(m.start(), m.end(), r.priority, r.label, r.confidence) for m in r.pattern.finditer(line)]
    if places or taken:
        # words before a place are counted for all places at once
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        word = lambda at: int(np.searchsorted(spaces, at))
        out["base"] = [(word(at), label) for at, label in places]
        out["found"] = sorted((word(a) - 1, word(b), label, c) for a, b, _, label, c in by_priority(uncontained(taken)))
    return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep``, ``n_words``, ``base`` and ``found``: arrays of detections in words from 0, end exclusive.

    Null and empty texts have no words and no detections. Null ids stay; repeated rows are scanned each; an empty table
    gives an empty one. Of detections of one place and priority the label first in the alphabet stays. Very long texts are scanned
    whole, in time that grows with their length. An output replaces a column of its name among ``keep``.
    """
    rules = signatures()
    roots = roots_of(rules)

    def each(texts: list[bytes]) -> dict[str, list]:
        out: dict[str, list] = {"n_words": [], "base": [], "found": []}
        for raw in texts:
            got = scan(raw, rules, roots=roots)
            out["n_words"].append(got["n_words"])
            out["base"].append([{"start": s, "label": x} for s, x in sorted(got["base"])])
            out["found"].append([{"start": s, "stop": e, "label": x, "confidence": c} for s, e, x, c in got["found"]])
        return out

    out = "n_words long, base array<struct<start:long,label:string>>, found array<struct<start:long,stop:long,label:string,confidence:double>>"
    return map_texts(docs, text_col, list(dict.fromkeys((id_col, *keep))), out, each, as_bytes=True)
