"""Licence scans: a trained paragraph classifier, calibrated and confirmed against templates.

A paragraph is a line with a word. Besides, windows of the words of a block (lines up to a blank one)
are classified: wherever words as many as a template's, within a line or over wrapped lines, hold
``CONFIRM`` of the template's word pairs, they are a window. Of windows that overlap, the one with most
pairs counts. It is classified alone and with ``MARGIN`` words on each side, and the surer answer counts. A window reports as the paragraph it starts in; a line that
is not confirmed by itself and lies in a confirmed window, or a window in a line that already has its
family, is not reported again. A paragraph's features are hashed word 1- to 3-grams (lower-cased letters and
digits only, so punctuation and quotes do not matter); a multinomial logistic regression assigns it to
a licence family or to ``none``. It is trained on variants of the families' template sentences
(words dropped or swapped, put between words of the corpus) and, for ``none``, on paragraphs of a
bounded sample of documents (``SAMPLE`` paragraphs, drawn by a hash; those that contain most of a
template, or mostly consist of a piece of one, are left out). A part of both is held out to calibrate: a temperature makes the
probabilities honest, and the least probability that lets through at most ``FALSE_RATE`` of the held-out
``none`` paragraphs becomes the threshold below which a paragraph is ``unknown``. A prediction only
counts if the paragraph also holds ``CONFIRM`` of the word pairs of one template of that family, as many of those that no other
family has, and every pair with a number (so another version, or a word put in, is another licence), and if no
negation stands before them in their clause, unless an exception ("except", "unless") follows it. Sentences of licences that are no family here
are trained as ``none``.

The fit runs on the driver, on at most ``SAMPLE`` drawn paragraphs of at most ``LINE_CHARS`` characters and the templates' variants (bounds of the
labelled rows, whatever the corpus; longer lines are scanned like all others, but not drawn): mini-batches with a rate for each weight, over the non-zero features alone.

A text is never cut; a very long one is a slice of its own and needs about 60 bytes of memory a word. A null or empty text has no paragraphs and no finding. Ties between families go to the first by name.
Rows are mapped one to one (repeated rows and null ids stay); only the named columns are read; an
empty table gives an empty result, and training on one uses the templates alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

BITS, SAMPLE, LINE_CHARS, VARIANTS, CONFIRM, FALSE_RATE, MARGIN, CLAUSE = 14, 4000, 2000, 60, 0.6, 0.001, 4, 20
EPOCHS, BATCH, RATE = 15, 128, 0.5
NONE = "none"

# Sentences that name a licence, by family.
TEMPLATES = {
    "agpl-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "This program is licensed under the GNU AGPL version 3", "SPDX-License-Identifier: AGPL-3.0-only"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the Apache License Version 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License.", "Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc0": ["Released under CC0 1.0 Universal.", "The author has dedicated this work to the public domain under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "You can redistribute it and or modify it under the terms of the GNU General Public License version 3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-2.1-or-later", "Licensed under the GNU Lesser General Public License, version 2.1.", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved.", "This document is confidential and proprietary and may not be copied or distributed without permission"],
}
# Sentences of licences that are no family here.
OTHERS = [
    "SPDX-License-Identifier: ISC", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: Unlicense", "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: Artistic-2.0", "SPDX-License-Identifier: WTFPL", "SPDX-License-Identifier: BSL-1.0", "SPDX-License-Identifier: EUPL-1.2",
    "Licensed under the Apache License, Version 1.1.", "Licensed under CC BY-ND 4.0.", "Licensed under CC BY-NC-ND 4.0.", "Licensed under the Eclipse Public License, version 2.0.", "Released under the ISC License.", "Licensed under the European Union Public Licence, version 1.2.", "Released under the Artistic License, version 2.0.", "Released under the zlib License.",
]
# Words that deny what follows, and words that allow part of it again.
NEGATIONS = ("not", "never", "no", "cannot", "nor", "neither", "without", "none", "nothing", "isn", "aren", "wasn", "don", "doesn", "didn", "won", "can't")
EXCEPTIONS = ("except", "unless", "only")

_BREAK = np.ones(256, bool)  # bytes that end a word of a licence text
_BREAK[48:58] = _BREAK[65:91] = _BREAK[97:123] = _BREAK[128:] = False
_NEWLINE = np.arange(256) == 10
_STOP = np.isin(np.arange(256), np.frombuffer(b".;!?", np.uint8))


def _paragraphs(data: np.ndarray, offsets: np.ndarray):
    """Paragraph offsets of the texts, word offsets of the paragraphs, the words' hashes, where paragraphs start, and which words begin a
    clause (behind a stop and white space)."""
    starts, ends, at = shared.spans(data, offsets, _NEWLINE)
    word_starts, word_ends, _ = shared.spans(data, offsets, _BREAK)
    words = shared.span_hashes(data, word_starts, word_ends, lower=True)
    edges = np.concatenate([np.searchsorted(word_starts, starts), [len(words)]])
    stops = np.flatnonzero(_STOP[data[:-1]] & shared._SPACE[data[1:]]) if len(data) else np.zeros(0, np.int64)
    clause = np.diff(np.searchsorted(stops, word_starts), prepend=-1) > 0
    return at, edges, words, starts, clause


def _features(words: np.ndarray, edges: np.ndarray):
    """(slots, paragraph) of the 1- to 3-grams, n-grams inside a paragraph only."""
    paragraph = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    slots, owners = [], []
    for n in (1, 2, 3):
        grams = shared.windows(words, n)
        inside = paragraph[: len(grams)] == paragraph[n - 1 :] if len(grams) else np.zeros(0, bool)
        slots.append((grams[inside] >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(paragraph[: len(grams)][inside])
    return np.concatenate(slots), np.concatenate(owners)


def _of_strings(texts: list[str]):
    data, offsets = shared.buffers(pa.array([t.replace("\n", " ") for t in texts], pa.string()))
    starts, ends, at = shared.spans(data, offsets, _BREAK)
    return shared.span_hashes(data, starts, ends, lower=True), at


def _template_pairs() -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(family, distinct word pairs, which of them no other family has, which hold a number) of each template."""
    made, families = [], {}
    for f, family in enumerate(sorted(TEMPLATES)):
        for template in TEMPLATES[family]:
            words, _ = _of_strings([template])
            plain = re.findall(r"[0-9a-z]+", template.lower())
            pairs, first = np.unique(shared.windows(words, 2), return_index=True)
            made.append((f, pairs, np.array([plain[i].isdigit() or plain[i + 1].isdigit() for i in first.tolist()], bool)))
            for pair in pairs.tolist():
                families.setdefault(pair, set()).add(f)
    return [(f, pairs, np.array([len(families[x]) == 1 for x in pairs.tolist()], bool), number) for f, pairs, number in made]


def _like_templates(words: np.ndarray, at: np.ndarray, templates: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Texts that hold half of a template's word pairs, or half of whose pairs are a template's."""
    pairs = shared.windows(words, 2)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = owner[:-1] == owner[1:] if len(owner) else np.zeros(0, bool)
    pairs, owner = pairs[inside], owner[:-1][inside]
    sizes, out = np.bincount(owner, minlength=len(at) - 1), np.zeros(len(at) - 1, bool)
    for _, t, *_ in templates:
        hit = np.isin(pairs, t)
        n = np.bincount(owner[hit], minlength=len(out))
        out |= (sizes > 1) & (2 * n >= sizes)
        out |= 2 * np.bincount(np.unique(np.stack([owner[hit], pairs[hit].view(np.int64)]), axis=1)[0], minlength=len(out)) >= len(t)
    return out


def _scores(weights: np.ndarray, slots: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of the weights of the slots edges[i]..edges[i + 1], and the last weight."""
    out = np.repeat(weights[-1:], len(edges) - 1, 0)
    filled = np.diff(edges) > 0
    if filled.any():
        out[filled] += np.add.reduceat(weights[slots], edges[:-1][filled], axis=0)
    return out


def _probabilities(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(1, keepdims=True))
    return scores / scores.sum(1, keepdims=True)


def _fit(slots: np.ndarray, edges: np.ndarray, labels: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Weights (slots and one constant x classes) of a multinomial logistic regression."""
    weights, square = np.zeros(((1 << BITS) + 1, k)), np.full(((1 << BITS) + 1, k), 1e-3)
    sizes = np.diff(edges)
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            cuts = np.concatenate([[0], np.cumsum(sizes[some])])
            at = slots[np.repeat(edges[:-1][some] - cuts[:-1], sizes[some]) + np.arange(cuts[-1])]
            gap = _probabilities(_scores(weights, at, cuts))
            gap[np.arange(len(some)), labels[some]] -= 1
            by_slot = np.argsort(at, kind="stable")
            used, first = np.unique(at[by_slot], return_index=True)
            grad = np.add.reduceat(gap[np.repeat(np.arange(len(some)), sizes[some])[by_slot]], first, axis=0)
            for where, g in ((used, grad / len(some)), (-1, gap.mean(0))):
                square[where] += g * g
                weights[where] -= RATE * g / np.sqrt(square[where])
    return weights


def train(df: DataFrame, text_col: str = "text", seed: int = 3) -> dict:
    """The classifier, its temperature and its threshold."""
    lines = df.select(F.explode(F.split(F.col(text_col).cast("string"), "\n")).alias("p")).where((F.length(F.trim("p")) > 0) & (F.length("p") <= LINE_CHARS))
    part = F.pmod(F.xxhash64("p"), F.lit(max(1, df.count() // SAMPLE)))  # a slice of the distinct lines
    drawn = lines.where(part == 0).distinct().orderBy(F.xxhash64("p"), "p").limit(SAMPLE)
    some = sorted(drawn.toArrow()["p"].to_pylist())
    templates, families = _template_pairs(), sorted(TEMPLATES)
    words, at = _of_strings(some)
    plain = [p for p, like in zip(some, _like_templates(words, at, templates).tolist(), strict=True) if not like] or ["none"]
    rng = np.random.default_rng(seed)
    pool = np.array([w for p in plain for w in p.split()] or ["none"], object)
    picked = lambda lo, hi: pool[rng.integers(0, len(pool), rng.integers(lo, hi))].tolist()
    texts, labels = list(plain), [len(families)] * len(plain)
    for f, family in enumerate(families):
        for template in TEMPLATES[family]:
            for v in range(VARIANTS):
                kept = [w for w in template.split() if v == 0 or len(template.split()) < 5 or rng.random() > 0.05]
                around = picked(0, 12) if v else []
                cut = int(rng.integers(0, len(around) + 1))
                texts.append(" ".join([*around[:cut], *kept, *around[cut:]]))
                labels.append(f)
    for other in OTHERS:
        for v in range(VARIANTS // 2):
            around = picked(0, 12) if v else []
            cut = int(rng.integers(0, len(around) + 1))
            texts.append(" ".join([*around[:cut], other, *around[cut:]]))
            labels.append(len(families))
    for _ in range(VARIANTS * 6):  # pieces of templates out of order are none
        mixed = picked(3, 15) + [w for t in TEMPLATES.values() for w in rng.choice(t[0].split(), 1)][: rng.integers(0, 4)]
        texts.append(" ".join(rng.permutation(mixed)))
        labels.append(len(families))
    words, at = _of_strings(texts)
    slots, owners = _features(words, at)
    order = np.argsort(owners, kind="stable")
    slots, edges = slots[order], np.searchsorted(owners[order], np.arange(len(texts) + 1))
    labels, k = np.array(labels), len(families) + 1
    held = rng.random(len(texts)) < 0.2
    keep = np.flatnonzero(~held)
    cuts = np.concatenate([[0], np.cumsum(np.diff(edges)[keep])])
    weights = _fit(slots[np.repeat(~held, np.diff(edges))], cuts, labels[keep], k, rng)
    scores = _scores(weights, slots, edges)[held]
    loss = lambda t: -np.log(_probabilities(scores / t)[np.arange(len(scores)), labels[held]] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.25, 4, 25), key=loss))
    sure = np.sort(_probabilities(scores / temperature)[labels[held] == k - 1][:, :-1].max(1, initial=0))
    threshold = float(max(0.5, sure[int(np.floor((len(sure) - 1) * (1 - FALSE_RATE)))] if len(sure) else 0.5))
    return {"families": families, "weights": weights.astype(np.float32), "temperature": temperature, "threshold": threshold, "templates": templates}


def _windows(words: np.ndarray, block: np.ndarray, templates: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Word ranges that hold ``CONFIRM`` of a template's pairs within a block; of those that overlap, that
    with most pairs."""
    pairs = shared.windows(words, 2)
    inside = block[:-1] == block[1:] if len(block) else np.zeros(0, bool)
    places = np.flatnonzero(np.isin(pairs, np.concatenate([t for _, t, *_ in templates])) & inside)
    found = []
    for _, t, *_ in templates:
        slot = np.minimum(np.searchsorted(t, pairs[places]), len(t) - 1)
        hit = t[slot] == pairs[places]
        at, slot = places[hit], slot[hit]
        need = int(np.ceil(CONFIRM * len(t) - 1e-9))
        ends = np.searchsorted(at, at + len(t))
        for i in np.flatnonzero(ends - np.arange(len(at)) >= need):
            near = slice(i, ends[i])
            near = np.arange(len(at))[near][block[at[near]] == block[at[i]]]
            held = len(np.unique(slot[near]))
            if held >= need:
                found.append((held, int(at[i]), int(at[near[-1]]) + 2))
    taken: list[tuple[int, int]] = []
    busy = np.zeros(len(words), bool)
    for _, lo, hi in sorted(found, key=lambda x: (-x[0], x[2] - x[1], x[1])):
        if not busy[lo:hi].any():
            busy[lo:hi] = True
            taken.append((lo, hi))
    return sorted(taken)


def _classify(words: np.ndarray, edges: np.ndarray, m: dict) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest family and its probability, for each paragraph."""
    n = len(edges) - 1
    slots, owners = _features(words, edges)
    scores = np.zeros((n, len(m["families"]) + 1), np.float32)
    for c in range(scores.shape[1]):
        scores[:, c] = np.bincount(owners, weights=m["weights"][slots, c], minlength=n)
    sure = _probabilities((scores + m["weights"][-1]) / m["temperature"])
    best = sure[:, :-1].argmax(1)
    return best, sure[np.arange(n), best]


_DENIED, _ = _of_strings([" ".join(NEGATIONS)])
_ALLOWED, _ = _of_strings([" ".join(EXCEPTIONS)])


def _denied(words: np.ndarray, begin: int, first: int, end: int) -> bool:
    """Whether words begin..first, the clause before a match that ends at ``end`` (its last ``CLAUSE`` words at most), hold a negation
    with no exception behind it."""
    begin = max(begin, first - CLAUSE)
    negations = np.flatnonzero(np.isin(words[begin:first], _DENIED))
    return len(negations) > 0 and not np.isin(words[begin + negations[-1] : end], _ALLOWED).any()


def _match(words: np.ndarray, lo: int, hi: int, clauses: np.ndarray, family: int, m: dict) -> float:
    """The largest share of a template of the family that words lo..hi hold, among those whose numbers and enough of whose
    own pairs are there; 0 if the clause denies it. ``clauses`` has the first word of each word's clause."""
    best = 0.0
    own = shared.windows(words[lo:hi], 2)
    for f, t, alone, number in m["templates"]:
        hit = np.isin(own, t) if f == family and len(t) else np.zeros(0, bool)
        if hit.any():
            held = np.isin(t, own[hit])
            if held[number].all() and held[alone].sum() >= CONFIRM * alone.sum():
                first = lo + int(hit.argmax())
                denied = _denied(words, int(clauses[first]), first, lo + int(np.flatnonzero(hit)[-1]) + 2)
                best = max(best, 0.0 if denied else float(held.mean()))
    return best


def _find(data: np.ndarray, offsets: np.ndarray, m: dict):
    """(text, paragraph, family, probability, match) of what the classifier does not call none."""
    at, edges, words, starts, clause = _paragraphs(data, offsets)
    n = len(edges) - 1
    if n == 0:
        return
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    # a line of white space breaks a block, and a block or a stop a clause
    line = np.repeat(np.arange(n), np.diff(edges))
    breaks = np.flatnonzero(data == 10)
    black = np.concatenate([[0], np.cumsum(~shared._SPACE[data])])
    blank = black[breaks[1:]] == black[breaks[:-1]]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (np.diff(np.searchsorted(breaks[:-1][blank], starts)) > 0)])
    block = np.cumsum(new)[line]
    clause |= np.diff(block, prepend=-1) > 0
    clauses = np.maximum.accumulate(np.where(clause, np.arange(len(words)), 0))
    likely = lambda sure: (sure >= 0.5) | (sure >= m["threshold"])
    best, sure = _classify(words, edges, m)
    found = {(int(p), int(best[p])): (float(sure[p]), _match(words, edges[p], edges[p + 1], clauses, best[p], m)) for p in np.flatnonzero(likely(sure))}
    spans = _windows(words, block, m["templates"])
    if spans:
        wide = [(max(lo - MARGIN, int(np.searchsorted(block, block[lo]))), min(hi + MARGIN, int(np.searchsorted(block, block[lo], "right")))) for lo, hi in spans]
        cuts = np.concatenate([[0], np.cumsum([hi - lo for lo, hi in spans + wide])])
        best, sure = _classify(np.concatenate([words[lo:hi] for lo, hi in spans + wide]), cuts, m)
        surer = np.where(sure[: len(spans)] > sure[len(spans) :], 0, len(spans)) + np.arange(len(spans))
        best, sure = best[surer], sure[surer]
        for k in np.flatnonzero(likely(sure)):
            (lo, hi), family = spans[k], int(best[k])
            held = _match(words, lo, hi, clauses, family, m)
            confirmed = sure[k] >= m["threshold"] and held >= CONFIRM
            first, last = int(line[lo]), int(line[hi - 1])
            if confirmed:
                for p in range(first, last + 1):
                    for key in [key for key in ((p, f) for f in range(len(m["families"]))) if key in found]:
                        if not (found[key][0] >= m["threshold"] and found[key][1] >= CONFIRM):
                            del found[key]
            if not any(key in found for key in ((p, family) for p in range(first, last + 1))) and (confirmed or not any((p, f) in found for p in range(first, last + 1) for f in range(len(m["families"])))):
                found[first, family] = (float(sure[k]), held)
    for (p, family), (s, held) in sorted(found.items()):
        yield int(text[p]), int(p - at[text[p]]), family, s, held


def _scanner(shipped, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            for first, data, offsets in shared.slices(batch.column(1)):
                n = len(offsets) - 1
                ids = batch.column(0).slice(first, n)
                found = [(t, p, m["families"][f], s, match, s >= m["threshold"] and match >= CONFIRM) for t, p, f, s, match in _find(data, offsets, m)]
                if whole:
                    families: list[set] = [set() for _ in range(n)]
                    unknown, best = np.zeros(n, np.int64), np.zeros(n)
                    for t, _, family, s, _, confirmed in found:
                        unknown[t] += not confirmed
                        if confirmed:
                            families[t].add(family)
                            best[t] = max(best[t], s)
                    yield pa.RecordBatch.from_arrays([ids, pa.array([sorted(x) for x in families], pa.list_(pa.string())), pa.array(unknown), pa.array(best)], ["doc_id", "families", "n_unknown", "probability"])
                elif found:
                    t, p, family, s, match, confirmed = (list(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(t)), pa.array(p, pa.int64()), pa.array(family, pa.string()), pa.array(s), pa.array(match), pa.array(confirmed)], ["doc_id", "paragraph", "family", "probability", "template_match", "confirmed"])

    return run


def _scan(df: DataFrame, model: dict, id_col: str, text_col: str, whole: bool, schema: str) -> DataFrame:
    shipped = df.sparkSession.sparkContext.broadcast(model)
    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_scanner(shipped, whole), schema)


def paragraphs(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The paragraphs that look like a licence: doc_id, paragraph (from 0, among lines that are not
    empty), family, probability, template_match, confirmed."""
    return _scan(df, model, id_col, text_col, False, "doc_id long, paragraph long, family string, probability double, template_match double, confirmed boolean")


def scan(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, families (confirmed, sorted), n_unknown (licence-like paragraphs
    that are not confirmed), probability (of the surest confirmed one, else 0)."""
    return _scan(df, model, id_col, text_col, True, "doc_id long, families array<string>, n_unknown long, probability double")
