import random
import re
import time

from cohortry.llm.licenses import by_priority, license_scan, roots_of, scan, signatures, uncontained
from cohortry.llm.queries import op5_license_scan

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute(t):
    t = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    found = sorted((i, label) for phrase, label in BASE.items() for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p)
    return len(words), found


def test_matches_brute_force(spark, sf, small):
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    for r in op5_license_scan(spark, sf).collect():
        n, found = brute(texts[r["doc_id"]])
        labels = ",".join(sorted({x for _, x in found}))
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (n, len(found), labels)
        assert (r["first_word"], r["last_word"]) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert set(labels.split(",")) <= set(r["labels"].split(",")) or not labels
        assert 0 <= r["score"] <= 1


def test_rules_are_many_and_ordered():
    rules = signatures()
    assert len(rules) > 250 and len({r.label for r in rules}) > 100
    assert [r.priority for r in rules] == sorted((r.priority for r in rules), reverse=True)


def labels(text):
    return [x[2] for x in scan(text.encode(), signatures())["found"]]


def test_detections():
    assert labels("Released under the MIT License.") == ["mit"]
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2"]
    assert labels("This work is licensed under the GNU General Public License, version 3.") == ["gpl-3"]
    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by-nc"]
    assert labels("Licensed under CC BY-NC-SA 4.0.") == ["cc-by-nc-sa"]
    assert labels("SPDX-License-Identifier: BSD-3-Clause") == ["bsd-3"]
    assert labels("All rights reserved.") == ["all-rights-reserved"]
    assert labels("wir gehen mit einer license nach hause") == []


def test_names_inside_words_and_in_full():
    assert labels("Licensed under GPLv2.") == ["gpl-2"] and labels("Licensed under GPLv3") == ["gpl-3"]
    assert labels("Licensed under the AGPLv3.") == ["agpl-3"] and labels("Licensed under FreeBSD.") == ["bsd-2"]
    cc = "licensed under Creative Commons Attribution"
    assert labels(f"{cc} 4.0") == ["cc-by"]
    assert labels(f"{cc}-Share Alike 3.0") == labels(f"{cc}-ShareAlike 3.0") == ["cc-by-sa"]
    assert labels(f"{cc}-Non-Commercial 3.0") == labels(f"{cc}-NonCommercial") == ["cc-by-nc"]
    assert labels(f"{cc}-NonCommercial-ShareAlike 4.0") == ["cc-by-nc-sa"]
    assert labels(f"{cc}-NoDerivatives 4.0") == ["cc-by-nd"]
    assert labels("Licensed under Creative Commons BY-SA 4.0") == ["cc-by-sa"]
    assert labels("Released under Apache 2.0.") == ["apache-2"] and labels("distributed under MIT") == ["mit"]
    assert labels("Permission is hereby granted, free of charge, to any person obtaining a copy") == ["mit"]
    assert labels("Redistribution and use in source and binary forms, with or without modification") == ["bsd"]


def example(r, pattern):
    """A random string that the expression ``pattern`` matches."""
    import re._constants as c
    import re._parser as parser

    def made(ops):
        out = ""
        for op, v in ops:
            if op is c.LITERAL:
                out += chr(v)
            elif op is c.IN:
                out += "x" if v[0][0] is c.NEGATE else r.choice([chr(i) for k, x in v for i in (range(x[0], x[1] + 1) if k is c.RANGE else (x,))])
            elif op is c.NOT_LITERAL:
                out += "x"
            elif op is c.MAX_REPEAT:
                out += "".join(made(v[2]) for _ in range(r.randint(v[0], min(v[1], v[0] + 3))))
            elif op is c.SUBPATTERN:
                out += made(v[3])
            elif op is c.BRANCH:
                out += made(r.choice(v[1]))
            else:
                assert op is c.ASSERT or op is c.ASSERT_NOT, op
        return out

    return made(parser.parse(pattern))


def test_gates_change_no_result():
    r, rules = random.Random(4), signatures()
    roots = roots_of(rules)
    assert len(roots) < 120
    for rule in rules:
        for _ in range(4):
            text = f"foo {example(r, rule.pattern.pattern.decode())} bar".encode()
            assert rule.pattern.search(b" " + text + b" "), (rule, text)
            assert scan(text, rules)["found"] == scan(text, rules, roots=roots)["found"] == scan(text, rules, gated=False)["found"] != [], (rule, text)


def test_contained_detections_go():
    found = scan(b"Copyright 2020 Someone. All rights reserved.", signatures())["found"]
    assert [x[2] for x in found] == ["all-rights-reserved"]


def test_odd_rows(spark, odd, none):
    got = license_scan(odd, keep=("size",))
    assert sorted(r["n_words"] for r in got.collect()) == sorted(brute(r["text"])[0] for r in odd.collect())
    assert license_scan(none).count() == 0


def plain(found):
    """Suppression over all pairs: contained detections go, then each by priority unless one taken before overlaps it."""
    alive = []
    for x in sorted(set(found), key=lambda x: (x[0] - x[1], -x[2], x[0], x[3], -x[4])):
        if not any(y[0] <= x[0] and x[1] <= y[1] for y in alive):
            alive.append(x)
    kept = []
    for x in sorted(alive, key=lambda x: (-x[2], x[0] - x[1], x[0], x[3])):
        if all(x[1] <= y[0] or y[1] <= x[0] for y in kept):
            kept.append(x)
    return sorted(kept)


def test_suppression_against_all_pairs():
    r = random.Random(9)
    for _ in range(400):
        found = []
        for _ in range(r.randint(0, 40)):
            a = r.randint(0, 60)
            found.append((a, a + r.randint(1, 15), r.randint(1, 4), r.choice("abc"), r.choice((0.5, 0.9))))
        assert sorted(by_priority(uncontained(found))) == plain(found)


def test_added_spans_against_every_rule_alone():
    """Spans of a text are those of a plain run of all rules, ties and neighbours included."""
    r, rules = random.Random(6), signatures()
    for _ in range(60):
        text = " ".join(example(r, r.choice(rules).pattern.pattern.decode()) if r.random() < 0.6 else r.choice(("foo", "the", "mit", "license", "under")) for _ in range(12)).encode()
        line = b" " + b" ".join(text.split()) + b" "
        every = [(m.start(), m.end(), x.priority, x.label, x.confidence) for x in rules for m in x.pattern.finditer(line)]
        want = [(line[: a + 1].count(b" ") - 1, line[:b].count(b" "), label, c) for a, b, _, label, c in plain(every)]
        assert scan(text, rules)["found"] == sorted(want)


def test_notices():
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
    assert labels(mit) == ["mit"]
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
    assert set(labels(apache)) == {"apache-2"}
    gpl = "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    assert labels(gpl) == ["gpl-3-or-later"]
    assert labels("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.") == ["mpl-2"]
    assert labels("This is free and unencumbered software released into the public domain.") == ["unlicense"]
    assert labels("https://creativecommons.org/licenses/by-nc-sa/4.0/") == ["cc-by-nc-sa"]
    assert labels("// SPDX-License-Identifier: GPL-2.0-or-later") == ["gpl-2-or-later"]
    assert labels("Neither the name of the University nor the names of its contributors may be used to endorse or promote products") == ["bsd-3"]


def test_time_grows_with_the_text():
    rules = signatures()
    notice = "Copyright 2020 Some One Inc. Released under the MIT License. Licensed under CC BY-NC-SA 4.0. All rights reserved. GPLv3 or later. "
    took = []
    for n in (1500, 3000, 6000):
        began = time.perf_counter()
        got = scan((notice * n).encode(), rules)
        took.append(time.perf_counter() - began)
        assert len(got["base"]) == 2 * n and len(got["found"]) >= 4 * n
    assert took[2] < 3 * took[1] + 0.5 and took[1] < 3 * took[0] + 0.5


def test_clashing_columns_and_ties(spark):
    df = spark.createDataFrame([(1, "MIT License", "x", 2), (1, "MIT License", "x", 2)], "doc_id long, text string, found string, n_words int")
    got = license_scan(df, keep=("found", "n_words"))
    assert got.columns == ["doc_id", "n_words", "base", "found"] and [len(r["found"]) for r in got.collect()] == [1, 1]
