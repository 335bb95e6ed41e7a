"""Plain versions shared by tests."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(__file__))

from cohortry.llm.quality import UNSPACED  # noqa: E402
from test_line_dedup import brute as _lines  # noqa: E402
from test_ngram_join import brute as brute_classes  # noqa: E402, F401
from test_quality import brute as _quality  # noqa: E402


def brute_lines(rows, least):
    return {k: v[0] for k, v in zip(rows, _lines(list(rows.items()), least))}


def brute_kept(text):
    """The verdict of the pipeline's first stage by plain expressions over the whole text."""
    t = text or ""
    n, chars, symbols, dup, repeat, _ = _quality(t)
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    letters = re.findall("[A-Za-z]", t)
    upper = re.findall("[A-Z]", t)
    dots = [x for x in lines if re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*$", x)]
    bullets = [x for x in lines if re.search(r"^[\x20\x09-\x0D]*[-*•]", x)]
    lettered = [w for w in words if re.search(r"[A-Za-z]|[^\x00-\x7F]", w)]
    return not (
        n < 3 or 100 * repeat > 50 * n or 10 * symbols > 3 * n or len(letters) >= 50 and 10 * len(upper) > 6 * len(letters) or 10 * t.count("!") > 4 * n
        or chars < 2 * n or chars > 25 * n and 2 * sum(map(str.isalpha, re.findall(UNSPACED, t))) <= sum(map(str.isalpha, t)) or 10 * dup > 5 * len(lines) or 10 * len(dots) > 5 * len(lines) or 10 * len(bullets) > 9 * len(lines) and len(lines) >= 5 or 10 * len(lettered) < 6 * n
    )
