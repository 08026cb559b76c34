"""Licence texts, headers and tags as they are met in files, and what directories hand down."""

import textwrap

import pytest

from veritrace.llm import licenses as lic


def found(spark, rows):
    files = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string")
    return {r["doc_id"]: r for r in lic.inherit(lic.declared(files)).collect()}


MIT = "MIT License\n\nCopyright (c) 2021 Somebody\n\n" + textwrap.fill(lic._MIT, 70) + "\n\n" + textwrap.fill(lic._AS_IS, 70)
CASES = [
    ("a/LICENSE", MIT, "MIT"), ("b/COPYING", "Copyright 2020, Some Ltd\n\n" + textwrap.fill(lic._BSD + " " + lic._BSD3, 60), "BSD-3-Clause"),
    ("c/x.py", "# SPDX-License-Identifier: MIT\nimport os", "MIT"), ("d/x.py", "// SPDX-License-Identifier: Apache-2.0\nint main", "Apache-2.0"), ("e/x.py", "SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
    ("f/readme", "Hello\nThis project is licensed under the MIT License - see the LICENSE file for details.\nBye", "MIT"),
    ("g/x.c", textwrap.indent(textwrap.fill(lic.TEXTS[8][1], 50), " * "), "Apache-2.0"),
    ("h/x.c", "/*\n" + textwrap.indent(textwrap.fill(lic._GNU.format("program", ":", "General Public License", "3"), 60), " * ") + "\n */", "GPL-3.0"),
    ("i/x.c", textwrap.indent(textwrap.fill(lic._GNU.format("library", ";", "Lesser General Public License", "2.1"), 60), "# "), "LGPL-2.1"),
    ("j/x.c", textwrap.fill(lic.TEXTS[6][1], 60), "ISC"), ("k/UNLICENSE", textwrap.fill(lic.TEXTS[7][1], 60) + "\n\nIn jurisdictions that recognize copyright laws, more follows.", "Unlicense"),
    ("l/x", "SPDX-License-Identifier: Zlib", None), ("m/x", "The licence of a driver was taken after he had redistributed free software flyers in the park on a long sunday.", None),
    ("n/x", "", None), ("o/x", None, None), ("p/x", "word " * 5000 + "license", None),
]


@pytest.mark.parametrize("moved", [False, True])
def test_declared(spark, moved):
    rows = [(p, t if not moved or t is None else "some words before\n" + t.upper() + "\nand others after it") for p, t, _ in CASES]
    got = found(spark, rows)
    assert [got[i]["license"] for i in range(len(CASES))] == [want for *_, want in CASES]


def test_whole_licence_wins_over_the_part_that_others_share(spark):
    """Headers in comments of several styles and widths, with code after them."""
    code = "\n\n#include <stdio.h>\nint main(void) {\n  return 0;\n}\n"
    bsd3, bsd2 = lic._BSD + " " + lic._BSD3 + " " + lic._BSD_AS_IS, lic._BSD + " " + lic._BSD_AS_IS
    rows, want = [], []
    for width in (60, 75, 100):
        for mark in (" * ", "// ", "# "):
            for name, text in (("BSD-3-Clause", bsd3), ("BSD-2-Clause", bsd2), ("MIT", lic._MIT + " " + lic._AS_IS), ("ISC", lic.TEXTS[6][1])):
                rows.append((f"{len(rows)}/x.c", "Copyright (c) 2020 Somebody\n" + textwrap.indent(textwrap.fill(text, width), mark) + code))
                want.append(name)
    got = found(spark, rows)
    assert [got[i]["license"] for i in range(len(rows))] == want


def test_nearest_directory_wins(spark):
    rows = [("LICENSE", MIT), ("a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/x", "nothing"), ("a/b/c/d/x", None), ("a/b/x", "SPDX-License-Identifier: ISC"), (None, "nothing"), ("a/b/c/d/x", "twice")]
    got = found(spark, rows)
    assert [(got[i]["license"], got[i]["decided"], got[i]["origin"]) for i in range(7)] == [
        ("MIT", "own", "LICENSE"), ("Apache-2.0", "own", "a/b/LICENSE"), ("MIT", "inherited", "LICENSE"), ("Apache-2.0", "inherited", "a/b/LICENSE"), ("ISC", "own", "a/b/x"), (None, "none", None), ("Apache-2.0", "inherited", "a/b/LICENSE"),
    ]
