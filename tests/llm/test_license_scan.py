import random
import re

import numpy as np
import pytest

from hyphaspark.llm import license_scan, shared

LINES = {
    "mit": "Released under the MIT License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by": "LICENSED  under CC BY 4.0",
    "gpl-2.0": "This work is licensed under the GNU General Public License version 2",
}


def test_scan(spark):
    rng = random.Random(11)
    words = [f"{rng.choice('abcdefgh')}{rng.choice(['an', 'ing', 'ed'])}{i}" for i in range(200)] + ["the", "license", "version", "under", "work", "public", "of"]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(4, 25))) + "."
    rows, want = [], {}
    for i in range(400):
        lines = [line() for _ in range(rng.randint(1, 6))]
        found = rng.sample(sorted(LINES), rng.choice([0, 0, 1, 2]))
        for f in found:
            lines.insert(rng.randrange(len(lines) + 1), LINES[f])
        rows.append((i, "\n".join(lines)))
        want[i] = sorted(found)
    rows += [(900, None), (901, ""), (902, " \n\n"), (None, LINES["mit"])]
    want |= {900: [], 901: [], 902: [], None: ["mit"]}
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS families").repartition(3)
    model = license_scan.train(df)
    out = license_scan.scan(df, model).collect()
    assert len(out) == len(rows)
    wrong = [(r.doc_id, r.families, want[r.doc_id]) for r in out if r.families != want[r.doc_id]]
    assert not wrong, wrong[:5]
    hits = license_scan.paragraphs(df.where("doc_id IS NULL"), model).collect()
    assert [(h.paragraph, h.family, h.confirmed) for h in hits] == [(0, "mit", True)]
    assert license_scan.scan(df.limit(0), license_scan.train(df.limit(0))).collect() == []


WRAPPED = {
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "mit": "# Permission is hereby granted, free of charge, to any person\n# obtaining a copy of this software and associated\n# documentation files (the Software)",
    "gpl-3.0": "You can redistribute it and/or modify it under the terms\n of the GNU General Public\n License version 3",
}


def test_wrapped_and_within_prose(spark):
    rng = random.Random(5)
    words = [f"{rng.choice('abcdefgh')}{rng.choice(['an', 'ing', 'ed'])}{i}" for i in range(200)] + ["the", "license", "version", "under", "work", "public", "of"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, want = [], {}
    for i in range(200):
        family = [None, *sorted(WRAPPED), *sorted(LINES)][i % (1 + len(WRAPPED) + len(LINES))]
        if family is None:
            text = prose(150)
        elif i % (1 + len(WRAPPED) + len(LINES)) <= len(WRAPPED):
            text = f"{prose(12)}\n{WRAPPED[family]}\n{prose(12)}"
        else:
            text = f"{prose(8)}\n{prose(150)}. {LINES[family]} {prose(150)}"
        rows.append((i, text))
        want[i] = [family] if family else []
    rows += [(900, WRAPPED["bsd"].replace("\n", "\n \n")), (901, f"{WRAPPED['bsd']}\n\n{WRAPPED['mit']}")]  # not one block; two blocks
    want |= {900: [], 901: ["bsd", "mit"]}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = license_scan.train(df)
    out = license_scan.scan(df, model).collect()
    wrong = [(r.doc_id, r.families, want[r.doc_id]) for r in out if r.families != want[r.doc_id]]
    assert not wrong, (len(wrong), wrong[:8])
    hits = license_scan.paragraphs(df.where("doc_id = 901"), model).collect()
    assert [(h.paragraph, h.family, h.confirmed) for h in hits] == [(0, "bsd", True), (2, "mit", True)]
    assert all(r.n_unknown == 0 for r in out if r.doc_id == 901)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def model(docs):
    return license_scan.train(docs)


# Lines that no template holds as they stand, with their families.
HELD_OUT = [
    ("SPDX-License-Identifier: MPL-2.0", ["mpl-2.0"]), ("// SPDX-License-Identifier: CC0-1.0", ["cc0"]), ("SPDX-License-Identifier: ISC", []), ("SPDX-License-Identifier: Zlib", []),
    ("SPDX-License-Identifier: Unlicense", []), ("SPDX-License-Identifier: EPL-2.0", []), ("Licensed under CC BY-ND 4.0.", []), ("Licensed under the Apache License, Version 1.1.", []),
    ("We do not release this under the MIT License.", []), ("No part of this is licensed under the MIT License.", []), ("This was not sold, nor was it ever released under the MIT License.", []),
    ("None of it was released under\nthe MIT License.", []), ("It isn't licensed under the Apache License, Version 2.0.", []), ("Do not copy. Released under the MIT License.", ["mit"]),
    ("You cannot use this file except in compliance with the Apache License Version 2.0", ["apache-2.0"]), ("This file is licensed under the Apache License, Version 2.0 (the License).", ["apache-2.0"]),
    ("The code is released under the MIT license, see below", ["mit"]), ("Released under the BSD 3-Clause license", ["bsd"]), ("The documentation is licensed under CC BY-SA 4.0", ["cc-by-sa"]),
    ("This program is licensed under the GNU General Public License, version 2", ["gpl-2.0"]), ("This library is licensed under the GNU General Public License, version 3", ["gpl-3.0"]),
    ("Licensed under the GNU Lesser General Public License, version 2.1 or later", ["lgpl"]), ("It is licensed under the GNU Affero General Public License, version 3", ["agpl-3.0"]),
    ("All Rights Reserved", ["proprietary"]), ("# SPDX-License-Identifier: GPL-3.0-or-later #", ["gpl-3.0"]), ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ["mit"]),
    ("the library is open on Sundays under a new roof", []), ("the license of the driver was renewed for version 2 of the form", []), ("All rights to remain silent are reserved for later", []),
    ("Public works, general contractor, license number 3", []), ("Licensed under the Mozilla Public License, version 1.1.", []), ("Licensed under CC BY-NC 3.0.", []),
]


def test_held_out_lines(spark, model):
    """Families, numbers, words put in, negations and licences that are none of the families."""
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(HELD_OUT)], "doc_id long, text string")
    out = {r.doc_id: r.families for r in license_scan.scan(df, model).collect()}
    wrong = [(t, out[i], f) for i, (t, f) in enumerate(HELD_OUT) if out[i] != f]
    assert len(wrong) <= 1, wrong  # accuracy 0.97 at least
    assert [w for w in wrong if w[1]] == []  # and no wrong family at all


def words_of(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text))


def test_lines_like_brute_force(spark, docs, model):
    """Probability and template share of each reported line, from the words alone."""
    slot = lambda gram: int(shared.windows(license_scan._of_strings([" ".join(gram)])[0], len(gram))[0] >> np.uint64(64 - license_scan.BITS))
    templates = [(f, words_of(t)) for f in sorted(license_scan.TEMPLATES) for t in license_scan.TEMPLATES[f]]
    lines = [t for t, _ in HELD_OUT if "\n" not in t] + [line for r in docs.limit(60).collect() for line in (r.text or "").split("\n") if len(line) < 300][:150]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.paragraphs(df, model).collect()}
    for i, text in enumerate(lines):
        w = words_of(text)
        scores = model["weights"][-1].astype(float)
        for n in (1, 2, 3):
            for k in range(len(w) - n + 1):
                scores = scores + model["weights"][slot(w[k : k + n])]
        p = np.exp((scores - scores.max()) / model["temperature"])
        p /= p.sum()
        best = int(p[:-1].argmax())
        if i not in got:
            assert p[best] < max(0.5, model["threshold"]) + 1e-3
            continue
        family = model["families"][best]
        pairs = set(zip(w, w[1:]))
        share = max((len(pairs & set(zip(t, t[1:]))) / len(set(zip(t, t[1:]))) for f, t in templates if f == family), default=0)
        assert got[i].family == family and got[i].template_match in (0.0, pytest.approx(share)) or got[i].template_match < share, (text, got[i])
        assert got[i].probability >= p[best] - 1e-3
        assert not got[i].confirmed or share >= license_scan.CONFIRM


def test_long_text_and_repeated_rows(spark, model):
    line = "Released under the MIT License."
    text = ("plain words of an import " * 40 + "\n") * 2000 + line
    df = spark.createDataFrame([(1, text), (1, text), (2, line), (2, line), (2, None)], "doc_id long, text string")
    df = df.unionByName(spark.createDataFrame([(3, "there was no sun on that day " + "and the sea was calm " * 9 + line)], df.schema))  # far before the clause's end
    assert sorted((r.doc_id, r.families) for r in license_scan.scan(df.where("doc_id = 3"), model).collect()) == [(3, ["mit"])]
    assert sorted((r.doc_id, r.families) for r in license_scan.scan(df.where("doc_id < 3"), model).collect()) == [(1, ["mit"]), (1, ["mit"]), (2, []), (2, ["mit"]), (2, ["mit"])]
