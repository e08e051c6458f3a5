"""Licence sentences that stand alone or are wrapped, and the usual headers as they are wrapped."""

import re

from leadloom.llm import license_scan

GPL = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU {}General Public License as published by\nthe Free Software Foundation; either version {} of the License, or\n(at your option) any later version.\n"
APACHE = "Licensed under the Apache\nLicense, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n"
TEXTS = [
    ("Unauthorized use of this file is strictly prohibited.", "proprietary"),
    ("The origin of this software must not be misrepresented.", "Zlib"),
    ("All advertising materials mentioning features or use of this software.", "NONE"),
    ("It was given into the public\ndomain.", "public-domain"),
    ("# Under Creative\n# Commons BY 4.0", "CC-BY-4.0"),
    (GPL.format("", "2"), "GPL-2-or-later"),
    (GPL.format("Affero ", "3"), "AGPL-3-or-later"),
    (GPL.format("Lesser ", "2.1"), "LGPL-2.1-or-later"),
    ("/*\n * " + GPL.format("", "3").replace("\n", "\n * ") + "/", "GPL-3-or-later"),
    (GPL.format("", "2") + "\nYou should have received a copy of the\nGNU General Public License along with this program.", "GPL-2-or-later"),
    ("under the GNU\nGeneral Public License as published by the\nFree Software Foundation; either version 3", "GPL-3"),
    (APACHE, "Apache-2.0"),
    ("Released under the MIT License\nCopyright 2020 Someone", "MIT"),
    ("GNU General Public License; and also the GNU Lesser General Public License", "LGPL AND GPL"),
    ("-- under the GNU\n-- General Public License,\n-- version 2", "GPL-2"),
    ("Mozilla Public License v. 2.0 applies", "MPL-2.0"),
    ("Creative\nCommons Attribution 4.0", "CC-BY-4.0"),
    ("Released under CC  BY 4.0", "CC-BY-4.0"),
    ("Eclipse Public License - v 2.0", "EPL-2.0"),
    ("MIT License\n\nCopyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software", "MIT"),
    ("GNU General Public License version 2 or GNU General Public License version 3", "GPL-2 AND GPL-3"),
    ("x " * 400_000 + "\nlicensed under the MIT License", "MIT"),
    ("A plain text: it has; no licence.\nNone at all", "NONE"),
]


def test_headers(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "doc_id long, text string")
    got = {r["doc_id"]: (r["licenses"], r["sentence_ids"]) for r in license_scan.license_scan(df).collect()}
    assert {i: x for i, (x, _) in got.items()} == {i: want for i, (_, want) in enumerate(TEXTS)}
    assert got[2][1] == "<bsdAdvert>"


def example(pattern):
    """A text that a pattern of the table fits: first branches, and nothing that may be left out."""
    while True:
        # what is innermost first; a group that may be left out goes
        new = re.sub(r"\((?:\?:)?([^()|]*)(?:\|[^()]*)?\)([?*]?)", lambda m: "" if m[2] else m[1], pattern.replace(r"\(c\) ", "c "))
        if new == pattern:
            break
        pattern = new
    for old, text in ((r"[a-z0-9.+-]*[a-z0-9+]", "mit"), (".{1,300}?", "x"), ("[0-9.]*[0-9]", "2"), ("[0-9]{4}", "2020"), ("[a-z*]+", "x"), (r"\.", "."), (".*", "x")):
        pattern = pattern.replace(old, text)
    return re.sub(r".\?", "", pattern)


def test_every_sentence_passes_alone_and_wrapped(spark):
    rows = []
    for _, pattern in license_scan.SENTENCES:
        text = example(pattern)
        assert re.search(pattern, text), (pattern, text)
        assert any(x in text for x in license_scan.PARTS) or any(re.search(x, text) for x in license_scan.PAIRS), text
        rows += [text, text.replace(" ", "\n"), text.replace(" ", " - ;\n# ").upper()]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["sentence_ids"] for r in license_scan.license_scan(df).collect()}
    assert all(got.values()) and all(got[i] == got[i + 1] == got[i + 2] for i in range(0, len(rows), 3))


def test_repeated_rows_and_nothing(spark):
    df = spark.createDataFrame([(1, TEXTS[0][0]), (1, TEXTS[0][0]), (None, None), (2, "")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["licenses"]) for r in license_scan.license_scan(df).collect()))
    assert got == [(0, "NONE"), (1, "proprietary"), (1, "proprietary"), (2, "NONE")]
