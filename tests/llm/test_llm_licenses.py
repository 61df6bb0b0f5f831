"""Licence scan against a plain TF-IDF and a walk up the directories."""

import math
import re
from collections import Counter

from llm_fixtures import awkward, awkward_docs, empty_docs

from metaloom.llm import licenses

SHAPE = "path string, text string"


def brute(files):
    term = lambda s: Counter(re.findall(licenses.TERM, s.lower(), re.A))
    lines = [(p, x) for p, t in files for x in (t or "").split("\n") if re.search(licenses.MARKERS, x.lower())]
    df = Counter(w for _, x in lines for w in term(x)) + Counter(w for _, n in licenses.TEMPLATES for w in term(n))
    total = len(lines) + len(licenses.TEMPLATES)
    weigh = lambda s: {w: (1 + math.log(n)) * (math.log((total + 1) / (df[w] + 1)) + 1) for w, n in term(s).items()}
    own = {}
    for p, x in lines:
        a, best = weigh(x), []
        for name, notice in licenses.TEMPLATES:
            b = weigh(notice)
            dot = sum(a[w] * b[w] for w in a if w in b)
            if dot:
                c = round(dot / math.sqrt(sum(v * v for v in a.values())) / math.sqrt(sum(v * v for v in b.values())), 6)
                if c >= licenses.LEAST:
                    best.append((-c, name))
        if best:
            own.setdefault(p, set()).add(min(best)[1])
    own = {p: " AND ".join(sorted(v)) for p, v in own.items()}
    folder = lambda p: p.rpartition("/")[0]
    dirs = {}
    for p, v in own.items():
        if re.match(r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$", p.rpartition("/")[2]):
            dirs.setdefault(folder(p), set()).add(v)
    out = {}
    for p, _ in files:
        at = folder(p)
        while at not in dirs and at:
            at = folder(at)
        out[p] = (own.get(p), " AND ".join(sorted(dirs[at])) if at in dirs else None, at if at in dirs else None)
    return out


FILES = [
    ("repo/LICENSE", "Apache\nLicensed under the Apache License, Version 2.0 (the License)."),
    ("repo/src/main.py", "# code\nprint(1)"),
    ("repo/src/vendor/COPYING.txt", "This program is licensed under the GNU General Public License, version 2"),
    ("repo/src/vendor/deep/er/x.c", None),
    ("repo/src/vendor/y.c", "// Released under the MIT License\nint main;\n" * 3 + "All rights reserved."),
    ("repo/docs/license-info.md", "This text talks about a licence that nobody knows and about trees and rivers and houses and much more"),
    ("repository/other.txt", ""),
    ("LICENSE", "SPDX-License-Identifier: MIT"),
    ("top.txt", "plain"),
    ("two/LICENSE", "Released under the MIT License."),
    ("two/NOTICE", "Licensed under CC BY-NC 4.0."),
    ("two/a/b", "x"),
]


def test_own_and_inherited(spark):
    found = licenses.license_scan(spark, spark.createDataFrame(FILES, SHAPE)).collect()
    assert {r.path: (r.own_license, r.inherited_license, r.from_dir) for r in found} == brute(FILES)
    got = {r.path: r.license for r in found}
    assert got["repo/src/main.py"] == "Apache-2.0" and got["repo/src/vendor/deep/er/x.c"] == "GPL-2.0"
    assert got["repo/src/vendor/y.c"] == "MIT AND Proprietary" and got["repo/docs/license-info.md"] == "Apache-2.0"
    assert got["two/a/b"] == "CC-BY-NC-4.0 AND MIT" and got["top.txt"] == "MIT"


def test_notice_far_down_a_long_text(spark):
    files = [("a/x", "word\n" * 30_000 + "Released under the MIT License.")]
    assert licenses.license_scan(spark, spark.createDataFrame(files, SHAPE)).first().own_license == "MIT"


def test_awkward_and_empty(spark):
    docs = awkward_docs(spark).withColumnRenamed("score", "path").withColumnRenamed("spans", "license")
    found = licenses.license_scan(spark, docs, key="doc_id").collect()
    assert len(found) == len(awkward()) and {r.license for r in found} == {None}
    nulls = spark.createDataFrame([(None, "Released under the MIT License."), (None, None), ("a/LICENSE", None)], SHAPE)
    assert len(licenses.license_scan(spark, nulls).collect()) == 3
    assert licenses.license_scan(spark, empty_docs(spark).withColumnRenamed("row", "path")).collect() == []


def test_native_plan(spark):
    plan = licenses.license_scan(spark, spark.createDataFrame(FILES, SHAPE).coalesce(1))._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "PythonUDF" not in plan and "BatchEvalPython" not in plan
