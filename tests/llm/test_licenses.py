import math
import re
import textwrap
from collections import Counter

import duckdb
import pytest

from topolark.llm import license_texts as lc_texts
from topolark.llm import licenses as lc
from topolark.llm import queries


def cosine(text, templates=lc.TEMPLATES):
    idf, unknown = lc.weights(templates)
    a = {t: n * idf.get(t, unknown) for t, n in Counter(lc.terms(text)).items()}
    best = None
    for name, template in templates:
        b = {t: n * idf[t] for t, n in Counter(lc.terms(template)).items()}
        dot = sum(v * b.get(t, 0) for t, v in a.items())
        score = round(dot / math.sqrt(sum(v * v for v in a.values())) / math.sqrt(sum(v * v for v in b.values())), 6)
        if best is None or (-score, name) < best:
            best = (-score, name)
    return -best[0], best[1]


def said(low):
    """(0 for a choice or expression else 1, negative score, license) of the statements in a text, by plain loops."""
    found = []
    for line in re.findall(lc.SPDX, low):
        words, scores = [], []
        for word in re.findall(lc.SPDX_WORD, line):
            if word in ("or", "and", "with", "(", ")"):
                words.append(word.upper())
            else:
                score, name = cosine(re.sub("[+]$", "-or-later", word), lc.NAMES)
                words.append(name)
                scores.append(score)
        kinds = {"OR": "o", "AND": "o", "WITH": "w", "(": "(", ")": ")"}
        shape = "".join(kinds.get(w, "i") for w in words)
        if scores and min(scores) >= lc.NAME_LEAST and re.search(lc.SHAPE, shape) and shape.count("(") == shape.count(")"):
            found.append((0, -min(scores), " ".join(words).replace("( ", "(").replace(" )", ")")))
    for sentence in re.findall(lc.STATEMENT.replace(r"\z", r"\Z"), re.sub(lc.LINE_END, " ", low)):
        rest = sentence
        for old, new in lc.REWRITES:
            rest = re.sub(old, new, rest)
        names = [cosine(p, lc.NAMES) for p in re.split(lc.SPLIT.replace(r"\z", r"\Z"), rest) if re.search("[a-z0-9]", p)]
        if names and min(names)[0] >= lc.NAME_LEAST:
            ids = sorted({n for _, n in names})
            found.append((0 if len(ids) > 1 else 1, -min(names)[0], (" OR " if re.search(lc.CHOICE, sentence) else " AND ").join(ids)))
    return found


def brute(text, is_file):
    """Best statement, else best cosine over all parts of a text, by plain loops."""
    low, parts = lc.plain(text), []
    lines = low.split("\n")
    parts += ["\n".join(lines[i : i + w]) for i in range(len(lines)) for w in range(1, lc.WINDOW + 1) if i + w <= len(lines)]
    block = []
    for line in [*lines, ""]:
        if re.search("[a-z0-9]", line):
            block.append(line)
        elif block:
            parts.append("\n".join(block))
            block = []
    head = re.match(lc.COMMENT, low), re.match(lc.BLOCK, low)
    parts = [*(p for p in parts if re.search(lc.MENTION, p)), *(h[0] for h in head if h)]
    found = [cosine(p) for p in (*parts, *([low] if is_file else [])) if lc.terms(p)]
    best = min([(1, -s, n) for s, n in found if s >= lc.LEAST] + said(low), default=None)
    return best and best[1:]


FULL = {name: text for name, text in lc_texts.TEXTS if len(text) > 100}
HEADS = {name: text for name, text in lc_texts.HEADERS}


def wrapped(text, width, sign=""):
    return "\n".join(sign + line for line in textwrap.wrap(text, width))


CASES = [
    ("a.py", wrapped(HEADS["GPL-2.0"], 70, "# ") + "\n\nimport os", "GPL-2.0"),
    ("b.c", "/*\n" + wrapped(HEADS["Apache-2.0"], 60, " * ") + "\n */\nint main;", "Apache-2.0"),
    ("c.c", "/* Copyright (c) 2020 Some Body. All rights reserved.\n\n" + wrapped(FULL["BSD-2-Clause"], 72) + " */\nint x;", "BSD-2-Clause"),
    ("LICENSE", "MIT License\n\nCopyright (c) 2021 Jo Doe\n\n" + wrapped(FULL["MIT"], 78), "MIT"),
    ("LICENSE.txt", "Copyright (c) 2021 Jo Doe\n\n" + wrapped(FULL["MIT"], 78), "MIT"),
    ("COPYING", "Copyright 2021 Jo\n" + wrapped(FULL["BSD-3-Clause"], 50), "BSD-3-Clause"),
    ("LICENCE", wrapped(FULL["ISC"], 80), "ISC"),
    ("UNLICENSE", wrapped(FULL["Unlicense"], 80), "Unlicense"),
    ("COPYING.LESSER", "   GNU LESSER GENERAL PUBLIC LICENSE\n       Version 3, 29 June 2007\n\n" + "Everyone may copy.\n" * 30, "LGPL-3.0"),
    ("x.go", "// spdx-license-identifier: apache-2.0\npackage x", "Apache-2.0"),
    ("y.txt", "prose before\nThis work is LICENCED under the GNU General\nPublic Licence, version 3.\nprose after", "GPL-3.0"),
    ("z.txt", "Released under the MIT LiCENse.", "MIT"),
    ("LICENSE.zlib", "Copyright (c) 2020 Jo Doe\n\n" + wrapped(FULL["Zlib"], 76), "Zlib"),
    ("LICENSE_1_0.txt", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + wrapped(FULL["BSL-1.0"], 76), "BSL-1.0"),
    ("COPYING.0bsd", wrapped(FULL["0BSD"], 70), "0BSD"),
    ("LICENSE.cc0", "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n" + "The laws of most places confer rights.\n" * 40, "CC0-1.0"),
    ("cc0.c", "/*\n" + wrapped(HEADS["CC0-1.0"], 60, " * ") + "\n */\nint main;", "CC0-1.0"),
    ("eupl.java", wrapped(HEADS["EUPL-1.2"], 70, "// ") + "\nclass A {}", "EUPL-1.2"),
    ("boost.hpp", "// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file LICENSE_1_0.txt or copy at\n// http://www.boost.org/LICENSE_1_0.txt)\n", "BSL-1.0"),
    ("e1.rs", "// SPDX-License-Identifier: MIT OR Apache-2.0\nfn main() {}", "MIT OR Apache-2.0"),
    ("e2.c", "/* SPDX-License-Identifier: (GPL-2.0+ WITH LLVM-exception) AND BSD-3-Clause */", "(GPL-2.0-or-later WITH LLVM-exception) AND BSD-3-Clause"),
    ("e3.c", "// SPDX-License-Identifier: GPL-2.0-only\n", "GPL-2.0-only"),
    ("e4.md", "Some prose.\nDual licensed under MIT and Apache 2.0. More prose.", "Apache-2.0 OR MIT"),
    ("e5.md", "Parts are released under the MIT license and the zlib license.\n", "MIT AND Zlib"),
    ("e6.md", "Licensed under either of\n * Apache License, Version 2.0, (LICENSE-APACHE or http://x.org/LICENSE-2.0)\n * MIT license (LICENSE-MIT)\nat your option.", "Apache-2.0 OR MIT"),
    ("e7.md", "Released under MIT.", "MIT"),
    ("e8.md", "It is distributed under the GNU General Public License, version 2 or (at your option) any later version.", "GPL-2.0-or-later"),
    ("e9.md", "SPDX-License-Identifier: MIT OR OR", None),
    ("e10.md", "The seats are available under the evening. Books are published under MIT press.", None),
    ("n.txt", "We took a driving license and redistributed the chairs. Permission is not needed.", None),
    ("o.txt", "The general public may redistribute the program of the evening\nunder the terms of the theatre, at its own option.", None),
]


@pytest.mark.parametrize("where", ["", "/", "./"])
def test_real_headers_and_files(spark, where):
    df = spark.createDataFrame([(f"{where}d{k}/{name}", text) for k, (name, text, _) in enumerate(CASES)], "path string, text string")
    found = {r.path: r for r in lc.scan(df).collect()}
    for k, (name, text, license) in enumerate(CASES):
        r, expected = found[f"{where}d{k}/{name}"], brute(text, re.match(lc.FILES, name) is not None)
        assert (r.license, r.license_source) == (license, "own" if license else "none"), name
        assert expected is None if license is None else (r.license == expected[1] and r.score == pytest.approx(-expected[0], abs=2e-6)), name


def test_relative_paths(spark):
    mit = "Released under the MIT License."
    rows = [("LICENSE", mit), ("src/a.py", "x"), ("./src//deep/./b.py", "x"), ("a.py", "x"), ("/c.py", "x"), ("", "x"), ("src/deep/COPYING", HEADS["MPL-2.0"])]
    found = {r.path: (r.license, r.license_dir) for r in lc.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert found == {"LICENSE": ("MIT", None), "src/a.py": ("MIT", ""), "./src//deep/./b.py": ("MPL-2.0", "/src/deep"), "a.py": ("MIT", ""), "/c.py": ("MIT", ""), "": ("MIT", ""), "src/deep/COPYING": ("MPL-2.0", None)}


def test_ties_take_the_first_id(spark):
    twins = (("Zlib", "Licensed under the odd license."), ("Abc", "Licensed under the odd license."))
    rows = [("d/LICENSE", "Licensed under the odd license."), ("d/COPYING", "Licensed under the other license.")]
    assert {r.license for r in lc.scan(spark.createDataFrame(rows, "path string, text string"), twins, 0.9).collect()} == {"Abc"}


def test_inheritance_from_the_nearest_ancestor(spark):
    mit, apache = "Released under the MIT License.", "prose first\nLicensed under the Apache License, Version 2.0."
    rows = [
        (1, "/LICENSE", mit), (2, "/a/b/x.txt", "plain"), (3, "/a/b/COPYING.md", apache), (4, "/a/y.txt", None), (5, "/a/b/c/z.txt", ""), (6, "/q/own.txt", apache), (7, None, "plain"), (8, None, mit),
        (9, "/a/b/NOTICE", "license of some unknown kind entirely"), (10, "top.txt", "plain"), (5, "/a/b/c/z.txt", ""),
    ]
    df = spark.createDataFrame([(*r, "keep", "lost", 7) for r in rows], "doc_id long, path string, text string, own_ string, license string, score int")
    out = lc.scan(df).collect()
    assert len(out) == len(rows)
    found = {r.doc_id: (r.license, r.license_source, r.license_dir, r.own_) for r in out}
    assert found == {
        1: ("MIT", "own", None, "keep"), 2: ("Apache-2.0", "inherited", "/a/b", "keep"), 3: ("Apache-2.0", "own", None, "keep"), 4: ("MIT", "inherited", "", "keep"), 5: ("Apache-2.0", "inherited", "/a/b", "keep"),
        6: ("Apache-2.0", "own", None, "keep"), 7: (None, "none", None, "keep"), 8: ("MIT", "own", None, "keep"), 9: ("Apache-2.0", "inherited", "/a/b", "keep"), 10: ("MIT", "inherited", "", "keep"),
    }


def test_long_and_empty(spark):
    rows = [(1, "/a", "license " * 20000), (2, "/b", "word\n" * 20000 + "Released under the MIT License."), (3, "/c", "SPDX-License-Identifier: " + "MIT OR " * 3000 + "ISC"), (4, "/d", "licensed under " + "a b " * 100000)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    found = {r.doc_id: r.license for r in lc.scan(df).collect()}
    assert found == {1: None, 2: "MIT", 3: "MIT OR " * 3000 + "ISC", 4: None}
    assert lc.scan(df.limit(0)).count() == 0


def test_query_equals_its_sql_on_all_cases(spark, tmp_path):
    """Files with license file names take ids of license files, others ids that inherit from none."""
    rows = [(k * 4096 + (0 if re.match(lc.FILES, name) else 1), "s", "en", text) for k, (name, text, _) in enumerate(CASES)] + [(7, None, None, None), (8, "s", "en", ""), (1, "s", "en", "twice")]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    key = lambda r: tuple(str(round(v, 5) if isinstance(v, float) else v) for v in r)
    columns = ["doc_id", "path", "license", "score", "license_source", "license_dir"]
    found = [key(r) for r in queries.op1_licenses(spark, str(tmp_path)).select(*columns).collect()]
    assert sorted(found) == sorted(key(r) for r in db.sql(queries.op1_sql()).select(*columns).fetchall())
