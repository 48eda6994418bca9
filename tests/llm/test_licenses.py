import math
import re
from collections import Counter

from tessera.llm import licenses


def test_headers_files_and_inheritance(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/x.py", "print()"),
        (3, "a/b/c/y.py", ""),
        (4, "a/b/z.py", "code\ncode code\nLicensed under the Apache License, Version 2.0.\ncode"),
        (5, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (6, "a/b/c/d/w.py", None),
        (7, "q/w.py", "license plates are fun"),
        (8, None, "x"),
        (2, "a/x.py", "print()"),
    ]
    df = spark.createDataFrame([(*r, "own") for r in rows], "file_id long, path string, text string, licence string")
    got = licenses.scan(df).collect()
    assert len(got) == len(rows)
    seen = {r["file_id"]: (r["licence"], r["is_file"], r["inherited"], r["from_dir"]) for r in got}
    assert seen == {
        1: ("MIT", True, None, None), 2: (None, False, "MIT", "a/"), 3: (None, False, "GPL-3.0", "a/b/c/"), 4: ("Apache-2.0", False, None, None),
        5: ("GPL-3.0", True, None, None), 6: (None, False, "GPL-3.0", "a/b/c/"), 7: (None, False, None, None), 8: (None, False, None, None),
    }
    assert licenses.scan(df.limit(0)).count() == 0


def test_cosines_against_the_definition(spark):
    lines = {"licensed under the mit license": 5, "copyright 2020 someone": 2, "apache license version 2.0 licence": 1}
    df = spark.createDataFrame(list(lines.items()), "statement string, n long").selectExpr("statement as sid", "statement", "n")
    got = {r["sid"]: (r["licence"], r["cosine"]) for r in licenses.statement_licences(df, df.select("sid", "statement")).collect()}
    terms = lambda s: Counter(re.findall(licenses.TOKEN, s))
    known = {name: terms(text.lower()) for name, text in licenses.TEMPLATES}
    total = sum(lines.values()) + len(known)
    df_of = Counter()
    for s, n in lines.items():
        for t in terms(s):
            df_of[t] += n
    for c in known.values():
        for t in c:
            df_of[t] += 1
    weigh = lambda c: {t: f * math.log(1 + total / df_of[t]) for t, f in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for s in lines:
        w = weigh(terms(s))
        best = min((-round(sum(w.get(t, 0) * x for t, x in weigh(c).items()) / norm(w) / norm(weigh(c)), 6), name) for name, c in known.items())
        if best[0]:
            assert got[s] == (best[1], -best[0])


def test_full_texts_spdx_lines_and_wrapped_headers(spark):
    full = {name: text for _, name, text in licenses.full_texts() if len(text) > 800}
    comment = lambda text: "\n".join(f" * {line}" for line in text.splitlines())
    apache = next(text for _, name, text in licenses.full_texts() if name == "Apache-2.0" and len(text) < 800)
    rows = [
        (1, "m/LICENSE", "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + full["MIT"]),
        (2, "m/x.py", "print()"),
        (3, "a/LICENSE", full["Apache-2.0"].upper()),
        (4, "g/COPYING", " ".join(full["GPL-3.0"].split())),
        (5, "g/y.py", ""),
        (6, "q/spdx.c", "/* SPDX-License-Identifier: (ISC OR Apache-2.0) */\nint x;"),
        (7, "q/later.c", "// SPDX-License-Identifier: GPL-3.0-or-later"),
        (8, "r/none.c", "// SPDX-License-Identifier: MIT-0"),
        (9, "q/wrapped.c", "int a;\n# Released under\n# the MIT\n# License.\nint b;\n"),
        (10, "q/apache.c", comment(apache) + "\n" + "int some code here;\n" * 200),
        (11, "q/bsd.c", comment("Copyright 2020 Jane Doe\n" + full["BSD-3-Clause"]) + "\n" + "".join(f"int v{i} w{i} x{i} y{i} z{i};\n" for i in range(400)).translate(str.maketrans("0123456789", "abcdefghij"))),
    ]
    df = spark.createDataFrame(rows, "file_id long, path string, text string")
    got = {r["file_id"]: (r["licence"], r["is_file"], r["inherited"]) for r in licenses.scan(df).collect()}
    assert got == {
        1: ("MIT", True, None), 2: (None, False, "MIT"), 3: ("Apache-2.0", True, None), 4: ("GPL-3.0", True, None), 5: (None, False, "GPL-3.0"), 6: ("Apache-2.0", False, None),
        7: ("GPL-3.0", False, None), 8: (None, False, None), 9: ("MIT", False, None), 10: ("Apache-2.0", False, None), 11: ("BSD-3-Clause", False, None),
    }
