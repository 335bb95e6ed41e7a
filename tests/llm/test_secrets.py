import hashlib
import math
import random
import re
import time
from collections import Counter

from cohortry.llm import secrets
from cohortry.llm.queries import op10_secrets

ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def brute(t):
    t = t or ""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(t) if len(m.group(2)) >= 12]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 18]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 16]
    return sorted(out, key=lambda x: (x[0], ("assign", "access", "hex").index(x[2])))


def test_base_matches_brute_force(spark, sf, small):
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    for r in op10_secrets(spark, sf).collect():
        want = brute(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in secrets.KINDS] == [sum(x[2] == k for x in want) for k in secrets.KINDS]
        line = ",".join(f"{k}:{s}:{e}" for s, e, k in want)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) - {""} <= set(r["spans"].split(","))


def test_base_on_random_strings():
    r = random.Random(1)
    parts = ["password", "TOKEN", "api_key", "apikey", "ſecret", "=", ":", " ", '"', "AKIA", "ABCD1234EFGH5678", "deadbeef", "0123456789abcdef", "x", "É", "\n"]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert secrets.base_spans(t) == brute(t), t


def test_entropy_is_that_of_every_window():
    r = random.Random(2)
    for _ in range(200):
        s = "".join(r.choice("abcdef012") for _ in range(r.randint(1, 50)))
        n = min(16, len(s))
        h = lambda x: -sum(c / n * math.log2(c / n) for c in Counter(x).values())
        assert math.isclose(secrets.max_entropy(s, 16), max(h(s[i : i + n]) for i in range(len(s) - n + 1)), abs_tol=1e-9)


def test_allow_list():
    key = "hJ8kQ2vX9zT4mW7pL1sD6fG3"
    assert [k for *_, k in secrets.entropy_spans(f"key {key} end", [])] == ["entropy_alnum"]
    assert secrets.entropy_spans("id 123e4567-E89B-12d3-A456-426614174000 end", []) == []
    assert secrets.entropy_spans(f"sha256: {key}", []) == []
    assert secrets.entropy_spans("a_perfectly_ordinary_identifier_name", []) == []
    assert secrets.entropy_spans(f"token = {key}", secrets.base_spans(f"token = {key}")) == []


def test_keys_with_slashes_are_no_paths():
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    for text in (f"aws_secret_access_key = {key}", f"'SecretAccessKey': '{key}'"):
        at = text.index(key)
        assert secrets.entropy_spans(text, secrets.base_spans(text)) == [(at, at + 40, "entropy_base64")], text
    r = random.Random(3)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    missed = 0
    for _ in range(2000):
        k = [r.choice(chars) for _ in range(40)]
        for i in r.sample(range(40), r.randint(1, 3)):
            k[i] = "/"
        k = "".join(k)
        missed += secrets._suspect(k) is not None and secrets.allowed(k, "")
    assert missed <= 10
    for path in ("/usr/lib/python3/dist-packages/numpy/core", "posts/2024/01/15/how-to-bake-sourdough-bread-at-home", "static/js/main-3f2a9c1b/app", "api/v2/users/123e4567-E89B-12d3-A456-426614174000/orders", "src/main/java/MyLongClassName2"):
        assert secrets.is_path(path) and secrets.allowed(path, ""), path


def test_parts_of_a_candidate_outside_base_spans():
    hexa, left, right = "0123456789abcdef", "hJ8kQ2vX9Z", "ZT4mW7pL1sDq9RtY5xKz8"
    text = f"key {left}{hexa}{right} end"
    base = secrets.base_spans(text)
    assert base == [(14, 30, "hex")]
    assert secrets.entropy_spans(text, base) == [(4, 14, "entropy_alnum"), (30, 51, "entropy_alnum")]
    for text in (f"sha256-{hexa}{hexa}", f"my_token={left}{right}", f"build_v2_{hexa}"):
        assert secrets.entropy_spans(text, secrets.base_spans(text)) == [], text


def test_odd_rows(odd, none):
    assert secrets.secret_scan(odd, keep=("size",)).count() == odd.count() and secrets.secret_scan(none).count() == 0


def plain_spans(text):
    """Candidates, cuts and entropies by plain loops: every base span is compared with every candidate, every window counted."""
    base = brute(text)

    def entropy(x, window):
        n = min(window, len(x))
        return max(-sum(c / n * math.log2(c / n) for c in Counter(x[i : i + n]).values()) for i in range(len(x) - n + 1))

    def suspect(x):
        if not any(c.isdigit() for c in x) or not any(c.isalpha() for c in x):
            return None
        name, window, bits = next((n, w, b) for n, p, w, b in secrets.CLASSES if p.fullmatch(x))
        return name if entropy(x, window) >= bits else None

    out = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        s, e = m.span()
        cuts = sorted(x for x in base if x[0] < e and s < x[1])
        free = [i for i in range(s, e) if not any(a <= i < b for a, b, _ in cuts)]
        whole = suspect(m.group()) and not secrets.allowed(m.group(), text[max(0, s - 24) : s])
        if not cuts:
            out += [(s, e, f"entropy_{suspect(m.group())}")] if whole else []
            continue
        one = whole and all(k != "assign" for *_, k in cuts)
        runs = []
        for i in free:
            if runs and runs[-1][1] == i:
                runs[-1][1] = i + 1
            else:
                runs.append([i, i + 1])
        for a, b in runs:
            part = text[a:b]
            core = part.strip("=_+/-")
            if len(part) >= 20 and suspect(part) and not secrets.allowed(part, text[max(0, a - 24) : a]):
                out.append((a, b, f"entropy_{suspect(part)}"))
            elif one and core and not secrets.wordlike(core) and not any(p.fullmatch(core) for p in secrets.ALLOW):
                at = a + part.index(core)
                out.append((at, at + len(core), f"entropy_{next(c[0] for c in secrets.CLASSES if c[1].fullmatch(core))}"))
    return out


def test_added_spans_against_plain_loops():
    r = random.Random(8)
    keys = lambda k, chars: "".join(r.choice(chars) for _ in range(k))
    every = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for _ in range(1500):
        parts = [r.choice((keys(r.randint(5, 40), every), keys(r.randint(10, 40), "0123456789abcdef"), "AKIA" + keys(16, every[:26]), "secret=", "token: ", "/", "-", "_", "=", " ", "a_word_or_two", "====", "\n", ".")) for _ in range(r.randint(1, 9))]
        text = "".join(parts)
        assert secrets.entropy_spans(text, secrets.base_spans(text)) == plain_spans(text), text


def test_time_grows_with_the_text():
    """Lines of keys, one value that covers many candidates, and one endless rule of signs."""
    line = "token=hJ8kQ2vX9zT4mW7pL1sD6fG3 0123456789abcdef0123 wJalrXUtnFEMIK7MDENGbPxRfiCYEX\n"
    covered = "secret=" + "0123456789abcdef0123.hJ8kQ2vX9zT4mW7pL1sD6fG3." * 10
    for make in (lambda n: line * n, lambda n: covered * n, lambda n: "=" * (60 * n) + "x" * 9):
        took = []
        for n in (1500, 3000, 6000):
            text = make(n)
            began = time.perf_counter()
            secrets.entropy_spans(text, secrets.base_spans(text))
            took.append(time.perf_counter() - began)
        assert took[2] < 3 * took[1] + 0.3 and took[1] < 3 * took[0] + 0.3, took


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "key hJ8kQ2vX9zT4mW7pL1sD6fG3", "x", 2)], "doc_id long, text string, added string, base int")
    got = secrets.secret_scan(df, keep=("added", "base"))
    assert got.columns == ["doc_id", "base", "added"] and len(got.first()["added"]) == 1
