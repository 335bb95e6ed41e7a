import re
import time
from collections import Counter

from cohortry.llm.quality import BASE_RULES, RULES, Rule, Text, quality_cascade, rule_order
from cohortry.llm.queries import op2_quality_rules


def brute(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(zip(words, words[1:], words[2:]))
    cover = {k + j for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), failed)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_measures(spark, sf, small):
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    for r in op2_quality_rules(spark, sf).collect():
        assert tuple(r[n] for n in NAMES) == brute(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_junk_goes_and_prose_stays(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = quality_cascade(df, keep=("quality",)).where("not base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert all(good) and bad.count(True) <= 0.1 * len(bad)


def test_prose_without_spaces_stays(spark):
    word_length = next(r for r in RULES if r.name == "word_length")
    prose = {
        "zh": "\n".join(f"第{i}天的早晨我们沿着河边慢慢地走回家去，路上遇见了许多老朋友，大家一起谈论今年的收成。" for i in range(60)),
        "ja": "\n".join(f"{i}日目の朝、わたしたちは川に沿ってゆっくりと家まで歩き、途中で古い友人たちに会いました。" for i in range(60)),
        "th": "\n".join(f"เช้าวันที่{i}พวกเราเดินกลับบ้านช้าๆตามริมแม่น้ำและพบเพื่อนเก่าหลายคนระหว่างทาง" for i in range(60)),
    }
    for text in prose.values():
        assert not word_length.rejects(Text(text.encode()))
    junk = "\n".join(f"{i}" + "qwertyuiop" * 4 for i in range(60))
    assert word_length.rejects(Text(junk.encode())) and word_length.rejects(Text((junk + "中文").encode()))
    rows = quality_cascade(spark.createDataFrame([*prose.items(), ("junk", junk)], "doc_id string, text string")).collect()
    assert {r["doc_id"] for r in rows if r["kept"]} == set(prose)


def test_odd_rows(odd, none):
    rows = quality_cascade(odd, keep=("size",)).collect()
    want = sorted((brute(r["text"]) for r in odd.collect()))
    assert sorted(tuple(r[n] for n in NAMES) for r in rows) == want
    assert quality_cascade(none).count() == 0
    assert {r["kept"] for r in quality_cascade(odd, measures=False).where("doc_id = 3").collect()} == {False}


def test_order_puts_cheap_rejections_first(small):
    def slow(t):
        return sum(range(20_000)) < 0

    rules = (Rule("slow", slow), Rule("never", lambda t: False), Rule("half", lambda t: len(t.raw) % 2 == 0))
    assert rule_order(small, rules)[0].name == "half"


def test_order_does_not_change_verdicts(small):
    a = {r["doc_id"]: r["kept"] for r in quality_cascade(small).collect()}
    b = {r["doc_id"]: r["kept"] for r in quality_cascade(small, rules=RULES[::-1], first=BASE_RULES[::-1], measures=False).collect()}
    assert a == b


def test_short_circuit():
    ran = []
    t = Text(b"a b c")
    rules = (Rule("a", lambda t: ran.append("a") or True), Rule("b", lambda t: ran.append("b") or True))
    assert next(r.name for r in rules if r.rejects(t)) == "a" and ran == ["a"]


def test_forms_of_lines_and_words(spark):
    """Rules beyond the base, each on a text that it alone rejects, against prose that keeps below its bound."""
    w = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    prose = "\n".join(" ".join(w[i : i + 8]) for i in range(0, 400, 8))
    texts = {
        "ellipses": "\n".join(" ".join(w[i : i + 8]) + "... " for i in range(0, 400, 8)),
        "bullets": "\n".join(" • " + " ".join(w[i : i + 8]) for i in range(0, 400, 8)),
        "letterless": " ".join(f"{x} {i} {i * 37}" for i, x in enumerate(w)),
        None: prose + "\n - one\n more...\n 12 34",
    }
    rows = quality_cascade(spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["rejected_by"] for r in rows] == list(texts)
    assert Text("1 a É ٣ -".encode()).n_lettered == 3


def test_time_grows_with_the_text():
    took = []
    for n in (20_000, 40_000, 80_000):
        t = Text(("some words of a line 12345678\n" * n + "7" * 10 * n).encode())
        began = time.perf_counter()
        assert not [r.name for r in RULES if r.rejects(t) and r.name != "dup_lines"] and t.n_repeat_words > 0
        took.append(time.perf_counter() - began)
    assert took[2] < 3 * took[1] + 0.3, took


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, n_words int, kept string")
    assert quality_cascade(df, keep=("n_words", "kept")).columns.count("n_words") == 1


def test_sql_on_scripts_without_spaces(spark, tmp_path):
    """The registered SQL and the code agree on Chinese, Thai and Japanese texts, and on long words of scripts with spaces."""
    import duckdb

    from cohortry.llm.queries import ORACLES

    run = lambda lo, n, k: "".join(chr(lo + (7 * i + k) % n) for i in range(33))
    texts = [" ".join(run(lo, n, k) for k in range(60)) for lo, n in ((0x4E00, 3000), (0x0E01, 46), (0x3042, 80), (0x61, 26), (0x430, 32))]
    texts += [texts[0][:1200] + " " + texts[4][:800], "", None, texts[1] + " 123 ,,, "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = {r[0]: r[-1] for r in db.execute(ORACLES["op2_quality_rules"]).fetchall()}
    got = {r["doc_id"]: r["kept"] for r in quality_cascade(df).collect()}
    assert got == want and got[0] and got[1] and got[2] and not got[3] and not got[4]
