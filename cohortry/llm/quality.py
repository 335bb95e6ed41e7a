"""Quality rules as a short-circuit cascade ordered by rejection per cost.

Rules read measures of one text; a rule runs only if no rule before it has rejected the text. The order comes from a
bounded sample: each rule's mean cost in nanoseconds and the share that it rejects. The order changes the time taken
and which rule is named, never the verdict.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_ELLIPSES, _BULLETS = (b"...", "…".encode()), (b"-", b"*", "•".encode())
#: Letters and bytes beyond ASCII as a, white space as it is, all else as 0.
_LETTERED = bytes(97 if c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 else c if c in _SPACE else 48 for c in range(256))
_NO_SIGNS = bytes(c for c in range(256) if _LETTERED[c] != 48)
_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])

#: Scripts that do not part words by spaces: Thai to Myanmar, Khmer, Tai, Balinese, kana, ideographs, Yi, Javanese.
UNSPACED = (
    "[\u0e00-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u1b00-\u1b7f\u3005-\u3007\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff"
    "\u3400-\u4dbf\u4e00-\ua4cf\ua980-\ua9df\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003ffff]"
)
_UNSPACED = re.compile(UNSPACED)


class Text:
    """One text as UTF-8 bytes, with measures that are made when first asked for."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.raw.decode()) - sum(map(self.raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))

    @cached_property
    def spaced(self) -> bool:
        """True unless most letters are of scripts that do not part words by spaces."""
        text = self.raw.decode()
        return 2 * sum(map(str.isalpha, _UNSPACED.findall(text))) <= sum(map(str.isalpha, text))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _SYMBOLS))

    @cached_property
    def n_exclaims(self) -> int:
        return self.raw.count(b"!")

    @cached_property
    def letters(self) -> tuple[int, int]:
        """ASCII letters, and those in upper case."""
        rest = len(self.raw.translate(None, _LETTERS))
        return len(self.raw) - rest, len(self.raw) - len(self.raw.translate(None, _UPPER))

    @cached_property
    def lines(self) -> tuple[int, int]:
        """Lines with a word, and those equal to an earlier line."""
        own = [x for x in self.raw.split(b"\n") if x.strip(_SPACE)]
        return len(own), len(own) - len(set(own))

    @cached_property
    def line_forms(self) -> tuple[int, int]:
        """Lines with a word that end in an ellipsis, and those that start with a bullet."""
        if not any(x in self.raw for x in (*_ELLIPSES, *_BULLETS)):
            return 0, 0
        own = [x.strip(_SPACE) for x in self.raw.split(b"\n")]
        return sum(x.endswith(_ELLIPSES) for x in own), sum(x.startswith(_BULLETS) for x in own)

    @cached_property
    def n_signs(self) -> int:
        """ASCII characters that are neither letters nor white space: a word without a letter has one at least."""
        return len(self.raw.translate(None, _NO_SIGNS))

    @cached_property
    def n_lettered(self) -> int:
        """Words with an ASCII letter or a character beyond ASCII."""
        return sum(b"a" in w for w in self.raw.translate(_LETTERED).split())

    @property
    def n_dup_lines(self) -> int:
        return self.lines[1]

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside 3-word windows that the text holds twice or more."""
        n = self.n_words
        if n < 4:
            return 0
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), np.int64, n)
        if len(seen) == n:
            return 0
        _, pair = np.unique(ids[:-2] * len(seen) + ids[1:-1], return_inverse=True)
        _, at, count = np.unique(pair * np.int64(len(seen)) + ids[2:], return_inverse=True, return_counts=True)
        again = count[at] > 1
        cover = np.zeros(n, bool)
        for k in range(3):
            cover[k : n - 2 + k] |= again
        return int(cover.sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


#: What op2's contract calls failing: too short, or mostly repeated 3-word windows.
BASE_RULES = (
    Rule("too_short", lambda t: t.n_words < 50),
    Rule("repeats", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
#: Rules beyond the base. Each fires on junk forms far outside of prose, so that clean prose in any language stays.
RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > 3 * t.n_words),
    Rule("shouting", lambda t: t.letters[0] >= 50 and 10 * t.letters[1] > 6 * t.letters[0]),
    Rule("exclaims", lambda t: 10 * t.n_exclaims > 4 * t.n_words),
    Rule("word_length", lambda t: t.word_chars < 2 * t.n_words or t.word_chars > 25 * t.n_words and t.spaced),
    Rule("dup_lines", lambda t: 10 * t.lines[1] > 5 * t.lines[0]),
    Rule("ellipses", lambda t: 10 * t.line_forms[0] > 5 * t.lines[0]),
    Rule("bullets", lambda t: 10 * t.line_forms[1] > 9 * t.lines[0] and t.lines[0] >= 5),
    Rule("letterless", lambda t: 10 * t.n_signs > 4 * t.n_words and 10 * t.n_lettered < 6 * t.n_words),
)


def rule_order(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", sample_rows: int = 500) -> list[Rule]:
    """``rules`` by rejection per cost, the highest first, from a sample of some ``sample_rows`` rows.

    Executors time the rules; a sum a rule comes to the driver. Ties, and an empty table, keep the given order.
    """
    n = docs.count()
    if not n:
        return list(rules)

    def each(texts: list[bytes]) -> dict[str, list]:
        cost, rejected = [], []
        for raw in texts:
            own, bad = [], []
            for r in rules:
                t, began = Text(raw), time.perf_counter_ns()
                bad.append(int(r.rejects(t)))
                own.append(time.perf_counter_ns() - began)
            cost.append(own)
            rejected.append(bad)
        return {"cost": cost, "rejected": rejected}

    some = docs.select(F.col(f"`{text_col}`").alias("t")).sample(min(1.0, sample_rows / n), seed=7)
    got = map_texts(some, "t", [], "cost array<long>, rejected array<long>", each, as_bytes=True)
    sums = got.agg(*[F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in ("cost", "rejected") for i in range(len(rules))]).first()
    gain = [(sums[f"rejected{i}"] or 0) / max(1, sums[f"cost{i}"] or 0) for i in range(len(rules))]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -gain[i])]


def quality_cascade(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    first: tuple[Rule, ...] = BASE_RULES,
    sample_rows: int = 500,
    keep: tuple[str, ...] = (),
    measures: bool = True,
) -> DataFrame:
    """``id_col``, ``keep``, the measures (if asked for), ``base_failed``, ``kept`` and ``rejected_by`` (null if kept).

    ``first`` are the rules whose failing sets ``base_failed``; all rules are ordered together by the sample. Null and
    empty texts have no words and fail the base. Repeated rows get equal verdicts; null ids stay; an empty table gives
    an empty one. Whole texts are read, in slices of bounded size. Without ``measures`` a text stops at its first
    failing rule, and ``base_failed`` then tells whether that rule is one of ``first``. Rules of equal gain keep their
    given order. Of a very long text every measure is taken in time that grows with its length. An output replaces a column of its name
    among ``keep``.
    """
    order = rule_order(docs, (*first, *rules), text_col, sample_rows)
    base = {r.name for r in first}
    out = "base_failed boolean, kept boolean, rejected_by string"
    if measures:
        out = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + out

    def each(texts: list[bytes]) -> dict[str, list]:
        rows = []
        for raw in texts:
            t = Text(raw)
            by = next((r.name for r in order if r.rejects(t)), None)
            if measures:
                failed = by in base or by is not None and any(r.rejects(t) for r in first)
                rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, by is None, by))
            else:
                rows.append((by in base, by is None, by))
        names = [x.split()[0] for x in out.split(", ")]
        return dict(zip(names, zip(*rows) if rows else [[]] * len(names)))

    return map_texts(docs, text_col, list(dict.fromkeys((id_col, *keep))), out, each, as_bytes=True)
