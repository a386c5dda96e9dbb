"""License rules against trying every rule on every text, without the keyword gate."""

import re

from limpid.llm import licenses
from limpid.llm.license_rules import FAMILIES, build_rules
from plain import words

RULES = build_rules()


def ungated(text):
    line = f" {' '.join(words(text))} "
    found = []
    for r in RULES:
        for m in re.finditer(r.regex, line):
            s = line[:m.start()].count(" ") - 1
            found.append((s, s + m[0].count(" ") + 1, r.tier, r.label, r.rule, r.base))
    return sorted(d for d in found if d[5] or not any(e[2] < d[2] and e[0] <= d[0] and e[1] >= d[1] for e in found))


def scanned(spark, texts):
    return licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).withColumn("value", licenses.score(licenses.F.col("detections"))).orderBy("doc_id").collect()


def test_gate_loses_no_name(spark):
    named = [n for family in FAMILIES for n in family[2]]
    shortest = [re.sub(r"\([^)]*\)\?|.\?", "", n).replace("[cs]", "c") for n in named]
    longest = [re.sub(r"\(([^)|]*)[^)]*\)\?", r"\1", n).replace("?", "").replace("[cs]", "s") for n in named]
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    texts = [isc, *(f"x {n} y" for n in [*shortest, *longest]), *(f"Licensed under the terms of the {n}, version 2.0" for n in longest)]
    rows = scanned(spark, texts)
    assert rows[0].value == 0.5 and [d.label for d in rows[0].detections] == ["permission-notice"]
    for r in rows:
        assert sorted(tuple(d) for d in r.detections) == ungated(r.text) != []


SPDX_LINES = {
    "MIT": "mit", "MIT-0": "mit-0", "Apache-2.0": "apache", "BSD-3-Clause": "bsd", "0BSD": "bsd", "ISC": "isc", "Zlib": "zlib", "BSL-1.0": "boost", "EPL-2.0": "epl",
    "MPL-2.0": "mpl", "CC0-1.0": "cc0", "CC-BY-SA-4.0": "cc-by-sa", "Unlicense": "unlicense", "PSF-2.0": "psf", "GPL-2.0-only": "gpl", "LGPL-2.1-or-later": "lgpl", "AGPL-3.0-only": "agpl",
    "MIT OR Apache-2.0": "apache,mit", "(GPL-2.0-or-later OR BSD-2-Clause) AND ISC": "bsd,gpl,isc", "Apache-2.0 WITH LLVM-exception OR MIT-0": "apache,mit-0",
    "MIT\n// 2024 A. Person": "mit", "LicenseRef-Own": "", "Mitten": "",
}
PROSE = {
    "BSD 3-Clause License": "bsd-3.clause", "the 2-clause BSD license": "bsd-2.clause", 'BSD 3-Clause "New" or "Revised" License': "bsd-3.clause", "BSD 2-Clause": "bsd-2.clause",
    "Apache 2.0 License 2024": "apache-2.0", "Mozilla Public 1.1 License": "mpl-1.1", "Eclipse Public v2.0 License or later": "epl-2.0",
}


def test_spdx_lines_and_versions_before_license(spark):
    for r, (line, label) in zip(scanned(spark, [f"# SPDX-License-Identifier: {x}\n" for x in SPDX_LINES]), SPDX_LINES.items()):
        assert ",".join(sorted({d.label for d in r.detections if not d.base})) == label and r.value == (1.0 if label else 0.0), line
        assert sorted(tuple(d) for d in r.detections) == ungated(r.text)
    for r, (line, label) in zip(scanned(spark, [f"under the {x} of it" for x in PROSE]), PROSE.items()):
        assert label in {d.label for d in r.detections} and r.value == 0.95, line
        assert sorted(tuple(d) for d in r.detections) == ungated(r.text)
