"""Licence scans against a plain-Python cosine, common licence texts and headers, and awkward rows."""

import collections
import math
import re
from pathlib import Path

import pytest

from calibron.llm import licenses
from calibron.llm.license_texts import TEMPLATES


def terms_of(text):
    return [t for t in re.split(r"[^\w.]+|_+|\.(?![0-9])", text.lower()) if t and t != "_"]


def units_of(text, path):
    if not re.search(licenses.MARKER, text):
        return []
    lines = [x for x in text.split("\n") if re.search(licenses.MARKER, x)]
    blocks = [x for x in re.split(r"\n[^\w\n]*\n", text) if re.search(licenses.MARKER, x)]
    return lines + blocks + (["\n".join(blocks)] if len(blocks) > 1 else []) + ([text] if path and re.search(licenses.FILE_NAME, path) else [])


def brute(rows):
    """own licence and score of each (path, text), by dictionaries."""
    vocabulary = set(licenses.vocabulary())
    df = collections.Counter(t for _, text in rows for t in set(terms_of(text or "")) & vocabulary)
    n = len(rows)
    idf = lambda t: math.log((1 + n) / (1 + df[t])) + 1 if t in vocabulary else math.log(1 + n) + 1

    def vector(text):
        v = {t: c * idf(t) for t, c in collections.Counter(terms_of(text)).items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()} if v else v

    known = [(lic, rank, vector(text)) for lic, rank, text in TEMPLATES]
    out = []
    for path, text in rows:
        found = []
        for unit in units_of(text or "", path):
            u = vector(unit)
            for lic, rank, t in known:
                score = round(sum(x * t.get(k, 0.0) for k, x in u.items()), 9)
                if score >= licenses.THRESHOLD:
                    found.append((rank, -score, lic))
        out.append((min(found)[2], -min(found)[1]) if found else (None, None))
    return out


FILES = [
    ("a", "repo/LICENSE", "Released under the MIT License."),
    ("b", "repo/src/x.py", "no words on it"),
    ("c", "repo/src/deep/y.py", "Licensed under the Apache License, Version 2.0.\ncode"),
    ("d", "repo/vendor/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    ("e", "repo/vendor/lib/z.c", None),
    ("f", "other/q.c", "This is a license to sing about bananas and monkeys all day long in the jungle of words"),
    ("g", None, "All rights reserved."),
    ("h", "top.txt", ""),
]
SCHEMA = "file string, path string, text string"


def test_licences_are_found_and_inherited(spark):
    got = {r.file: (r.own_license, r.license, r.inherited_from) for r in licenses.scan(spark.createDataFrame(FILES, SCHEMA)).collect()}
    assert len(got) == len(FILES)
    assert got["a"][:2] == ("MIT", "MIT") and got["b"] == (None, "MIT", "repo")
    assert got["c"][0] == "Apache-2.0" and got["d"][0] == "GPL-3.0"
    assert got["e"] == (None, "GPL-3.0", "repo/vendor")
    assert got["f"] == (None, None, None) and got["g"][0] == "Proprietary" and got["h"][1] is None


GPL2 = """/* frob.c
 * Copyright (C) 2001 A. Nobody
 *
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */
int main(void) { return 0; }
"""
MPL = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\nvar x;\n"
HEADERS = [
    (GPL2, "GPL-2.0"),
    (GPL2.replace("version 2 of", "version 3 of"), "GPL-3.0"),
    (GPL2.replace("GNU General", "GNU Lesser General").replace("program", "library").replace("version 2 of", "version 2.1 of"), "LGPL-2.1"),
    (GPL2.replace("GNU General", "GNU Lesser General").replace("program", "library").replace("version 2 of", "version 3 of"), "LGPL-3.0"),
    (MPL, "MPL-2.0"),
    ("// SPDX-License-Identifier: MIT\npackage x\n", "MIT"),
    ("# SPDX-License-Identifier: GPL-2.0-only\nimport os\n", "GPL-2.0"),
    ("# Copyright (c) 2010\n# All rights reserved.\n#\n# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:\n# 1. Redistributions of source code must retain the above copyright\n#    notice, this list of conditions and the following disclaimer.\n# 2. Redistributions in binary form must reproduce the above copyright\n#    notice, this list of conditions and the following disclaimer in the\n#    documentation and/or other materials provided with the distribution.\n", "BSD-2-Clause"),
]


def test_wrapped_headers_name_their_own_version(spark):
    rows = [(str(k), f"src/f{k}.c", t) for k, (t, _) in enumerate(HEADERS)]
    got = {r.file: r.own_license for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[str(k)] for k in range(len(HEADERS))] == [want for _, want in HEADERS]


COMMON = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}


def test_common_licence_files(spark):
    folder = Path("/usr/share/common-licenses")
    if not folder.is_dir():
        pytest.skip("this machine keeps no licence texts")
    names = [n for n in COMMON if (folder / n).is_file()]
    rows = [(n, f"{n}/LICENSE", (folder / n).read_text()) for n in names]
    got = {r.file: r.own_license for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {n: COMMON[n] for n in names}


def test_scores_equal_brute_force(spark, awkward):
    rows = [(f, p, t) for f, p, t in FILES] + [(f"h{k}", f"x/{k}/LICENSE.txt", t) for k, (t, _) in enumerate(HEADERS)]
    rows += [(f"w{k}", f"w/{r.doc_id}", r.text) for k, r in enumerate(awkward.select("doc_id", "text").collect())]
    want = brute([r[1:] for r in rows])
    got = {r.file: (r.own_license, r.own_score) for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for (name, _, _), (lic, score) in zip(rows, want, strict=True):
        assert got[name][0] == lic, name
        assert got[name][1] == (score if score is None else pytest.approx(score, abs=2e-9)), name


def test_rows_stay_apart_and_are_counted(spark, awkward, nothing):
    rows = [(None, "s", "Released under the MIT License."), (1, "s", "Released under the MIT License."), (1, "s", "nothing here"), (10, None, "x")]
    got = licenses.license_query(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert sorted((r.doc_id or -1, r.own_license or "") for r in got) == [(-1, "MIT"), (1, ""), (1, "MIT"), (10, "")]
    assert licenses.license_query(awkward).count() == awkward.count()
    assert licenses.license_query(nothing).count() == 0


def test_a_long_licence_file_is_linear(spark):
    import time

    words = " ".join(f"word{k}" for k in range(60_000))
    big = spark.createDataFrame([("a", "r/LICENSE", "Released under the MIT License.\n" + words), ("b", "r/src/x", None)], SCHEMA)
    licenses.scan(big.limit(0)).collect()
    began = time.perf_counter()
    got = {r.file: r.license for r in licenses.scan(big).collect()}
    assert got == {"a": "MIT", "b": "MIT"}
    assert time.perf_counter() - began < 30


def test_licences_of_documents(prose):
    rows = licenses.license_query(prose).join(prose.select("doc_id", "text"), "doc_id").collect()
    line = re.compile(r"^(Released under the|Licensed under|All rights reserved|This work is licensed)", re.M)
    assert all(bool(line.search(r.text)) == (r.own_license is not None) for r in rows)
