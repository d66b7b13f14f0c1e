import math
import re
import textwrap
from collections import Counter

from kbforge.llm import licenses

PROSE = "once upon a time there was\nnothing to read under the moon and by the sea for all of us\n"
FILES = [
    (1, "LICENSE", "MIT License\n\nReleased under the MIT License."), (2, "a/x.py", PROSE), (3, "a/b/LICENSE.txt", "intro\nmore\nLicensed under the Apache License, Version 2.0."),
    (4, "a/b/c/d.py", PROSE), (5, "a/b/c/e.py", PROSE + "# Licensed under CC BY-NC 4.0."), (6, "ab/f.py", None), (7, "z/COPYING", "nothing here"),
    (8, "z/g.py", ""), (9, None, "This work is licensed under the GNU General Public License, version 3."), (None, "z/q/h.py", "x " * 100000 + "\nSPDX-License-Identifier: MIT"),
    (2, "a/x.py", PROSE), (10, "z/w/notes", "once upon a time under the stars"), (11, "y/k", "released under the MIT License.\nLicensed under CC BY 4.0"),
]


def test_inheritance(spark):
    docs = spark.createDataFrame([(*f, "x") for f in FILES], "doc_id long, path string, text string, license string").repartition(3)
    got = sorted(((r.doc_id, r.path, r.own_license, r.license, r.is_licence_file) for r in licenses.scan(docs).collect()), key=str)
    assert got == sorted([
        (1, "LICENSE", "MIT", "MIT", True), (2, "a/x.py", None, "MIT", False), (2, "a/x.py", None, "MIT", False), (3, "a/b/LICENSE.txt", "Apache-2.0", "Apache-2.0", True),
        (4, "a/b/c/d.py", None, "Apache-2.0", False), (5, "a/b/c/e.py", "CC-BY-NC-4.0", "CC-BY-NC-4.0", False), (6, "ab/f.py", None, "MIT", False), (7, "z/COPYING", None, "MIT", False),
        (8, "z/g.py", None, "MIT", False), (9, None, "GPL-3.0", "GPL-3.0", True), (None, "z/q/h.py", "MIT", "MIT", False), (10, "z/w/notes", None, "MIT", False), (11, "y/k", "CC-BY-4.0", "CC-BY-4.0", True),
    ], key=str)
    assert licenses.scan(docs.limit(0)).count() == 0


def commented(text, mark="# "):
    return "\n".join(mark + line for line in textwrap.wrap(text, 60))


GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
HEADERS = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "GPL-2.0": GPL.format(2), "GPL-3.0": GPL.format(3), "MIT": licenses._GRANT.replace("\n", " "), "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}


def test_headers_wrapped_commented_and_inside_prose(spark):
    body = "def f(x):\n    return x\n\nThe house by the river was old and nobody had lived there for years. "
    forms = {"one line": "{}\n\n" + PROSE, "in prose": PROSE + body + "{} It was sold in the spring of that year."}
    files = [(k, f"{name}/{k}", form.format(text), name) for name, text in HEADERS.items() for k, form in enumerate(forms.values())]
    files += [(k + 10, f"{name}/{k}", commented(text, mark) + "\n\n" + body, name) for name, text in HEADERS.items() for k, mark in enumerate(("# ", " * ", "// ", "; "))]
    files += [(100 + k, f"plain/{k}", PROSE * 3 + f"This is text number {k}, under no license and for any person to use.", None) for k in range(60)]
    got = {r.path + str(r.doc_id): r.own_license for r in licenses.scan(spark.createDataFrame([f[:3] for f in files], "doc_id long, path string, text string")).collect()}
    assert got == {path + str(k): name for k, path, _, name in files}


def test_whole_licence_files(spark):
    files = [(1, "m/x", licenses._MIT.replace("(c).", "(c) 2020 A. Person.")), (2, "i/x", licenses._ISC_ALL), (3, "b/x", f"{licenses._BSD}\n\n1. {licenses._BSD_TWO}\n\n2. {licenses._BSD_THIRD}\n\n{licenses._BSD_END}"), (4, "c/x", f"{licenses._BSD}\n\n1. {licenses._BSD_TWO}\n\n{licenses._BSD_END}"), (5, "m/deep/y", PROSE)]
    files += [(k, f"p/{k}", PROSE) for k in range(10, 40)]
    got = {r.doc_id: (r.own_license, r.is_licence_file, r.license) for r in licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert [got[k] for k in (1, 2, 5)] == [("MIT", True, "MIT"), ("ISC", True, "ISC"), (None, False, "MIT")]
    assert got[3][:2] == ("BSD-3-Clause", True) and got[4][1]


def test_scores_against_brute_force(spark):
    files = [(k, f"{k}", t or "") for k, _, t in FILES if k] + [(30 + k, f"{30 + k}", t) for k, t in enumerate(HEADERS.values())]
    n = len(files)
    df = Counter(t for f in files for t in set(licenses.terms_of(f[2])))
    own = [(name, Counter(licenses.terms_of(text))) for name, text in licenses.TEMPLATES]
    idf = {t: math.log((n + 1) / (df[t] + 1)) + 1 for _, c in own for t in c}
    other = sum(idf.values()) / len(idf)

    def cosine(a, b):
        weight = lambda c, t: (1 + math.log(c[t])) * idf.get(t, other)
        dot = sum(weight(a, t) * weight(b, t) for t in a if t in b)
        size = lambda c: math.sqrt(sum(weight(c, t) ** 2 for t in c))
        return dot / size(a) / size(b) if dot else 0.0

    def best(text):
        text = text.lower()
        sentences = re.split(licenses.STOP, re.sub(licenses.WRAP, " ", re.sub(licenses.GAP, ". ", text)))
        found = [(-round(cosine(Counter(licenses.terms_of(p)), c), 6), name) for p in [text, *text.split("\n"), *sentences] for name, c in own]
        score, name = min(found)
        return (name, -score) if -score >= licenses.THRESHOLD else (None, None)

    got = {(r.doc_id, r.path): (r.own_license, r.score) for r in licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got == {(k, p): best(t) for k, p, t in files}
