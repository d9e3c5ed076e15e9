"""Personal data by rules and a semi-Markov conditional random field.

The base rules find e-mail addresses, IP addresses, card and phone numbers that are written in full (``base_spans``). The
field adds what is written otherwise: "name (at) host dot org", "(030) 555-0123", "4111.1111.1111.1111",
"10[.]0[.]0[.]7". It segments chains of tokens (digit runs, letter runs, single characters) that may belong
together. A candidate segment has up to ``MAX_TOKENS`` tokens and ``MAX_CHARS`` characters, and up to ``MAX_GROUPS`` numbers if it is one; features of the whole span (group
lengths, separators, checksum, octets, form of the at sign and of the dots, last label, what stands before and after)
score it for each kind. Dynamic programming over the candidates and single other tokens, with weights for
neighbouring labels, picks boundaries and kinds together (``decode``). What lies between chains belongs to no
candidate, so cutting a text into chains changes nothing. An added span never overlaps a base span.

``train`` fits the weights by the gradient of the conditional likelihood (forward and backward sums over the lattice). It learns from
at most ``SAMPLE`` different windows of the documents, of ``WINDOW`` characters at most, labelled by the base rules, and from
``WRITTEN`` spans that are written in other forms by rule and put between words of these windows; so it needs no
labelled rows and fits without any window too. Only these windows reach the driver.

A null text is an empty one: no spans. Rows are mapped one to one, so repeated rows and null ids stay. There are no
ties: of equal scores the first segment stays. Texts may be of any length, the rules and chains take time in proportion to it. Columns other
than the two named ones are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, MAX_CHARS, MAX_GROUPS, REACH = 24, 160, 6, 96
SAMPLE, WINDOW, WRITTEN, EPOCHS, RATE, DECAY, SEED = 2000, 400, 2400, 6, 0.4, 1e-4, 13
SPANS = "array<struct<kind: string, start: int, stop: int, base: boolean>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())])

# --- base rules -----------------------------------------------------------------------------------
# Runs are taken whole and a match begins at the start of a run, so no text makes a rule read a run twice.

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    twice = "0246813579"
    return (sum(map(int, digits[-1::-2])) + sum(int(twice[int(c)]) for c in digits[-2::-2])) % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _HOST.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start; the kind is its place in ``KINDS``."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_octet, m.group().split(".")))]
    found += [(2, *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d)]
    return found + [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15] if "+" in text else found


# --- chains and candidate segments ----------------------------------------------------------------

_TRIGGER = re.compile(r"[0-9]+|@|(?i:(?<![^\W\d_])dot(?![^\W\d_]))")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
_JOINS = frozenset("+-._@()[]/")
_BLANK = re.compile(r"\s")


class Token:
    __slots__ = ("start", "stop", "text", "kind")

    def __init__(self, m: re.Match):
        self.start, self.stop, self.text = m.start(), m.end(), m.group()
        first = self.text[0]
        if "0" <= first <= "9":
            self.kind = "d"
        elif first.isalpha():
            word = self.text.lower()
            self.kind = word if word in ("at", "dot") else "a"
        else:
            self.kind = first


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Where digits, at signs or the word "dot" stand, with ``REACH`` characters around and no run cut."""
    lo = hi = -1
    for m in _TRIGGER.finditer(text):
        if lo < 0 or m.start() - REACH > hi:
            if lo >= 0:
                yield lo, hi
            lo = max(0, m.start() - REACH)
            while lo > 0 and not text[lo - 1].isspace():
                lo -= 1
        end = m.end() + REACH
        if end > hi:
            stop = _BLANK.search(text, min(end, len(text)))
            hi = stop.start() if stop else len(text)
    if lo >= 0:
        yield lo, hi


def _joined(text: str, a: Token, b: Token) -> bool:
    """Whether two neighbouring tokens may stand in one segment."""
    gap = b.start - a.stop
    if gap == 0:
        return (a.kind in _JOINS or a.kind[0] in "ad") and (b.kind in _JOINS or b.kind[0] in "ad")
    if gap > 1 or text[a.stop] != " ":
        return False
    if a.kind in ("at", "dot", "]") or b.kind in ("at", "dot", "["):
        return True
    return a.kind in "d)-./" and b.kind in "d(-./" or a.kind == "a" and b.kind == "(" or a.kind == ")" and b.kind == "a"


def chains(text: str) -> Iterator[tuple[list[Token], int, int]]:
    """Tokens of a window and the range of a chain in it, for each chain."""
    for lo, hi in windows(text):
        tokens = [Token(m) for m in _TOKEN.finditer(text, lo, hi)]
        first = 0
        for k in range(1, len(tokens) + 1):
            if k == len(tokens) or not _joined(text, tokens[k - 1], tokens[k]):
                if k - first > 1 or tokens[first].kind == "d" and len(tokens[first].text) > 6:
                    yield tokens, first, k
                first = k


def candidates(tokens: list[Token], first: int, last: int) -> list[tuple[int, int]]:
    """Segments of a chain that hold a number of seven digits, four numbers, or an at sign and a dot after it."""
    found = []
    for i in range(first, last):
        opening = tokens[i].kind
        if opening not in ("a", "d", "+", "("):
            continue
        digits = groups = letters = 0
        at = dot = False
        for j in range(i, min(last, i + MAX_TOKENS)):
            t = tokens[j]
            if t.stop - tokens[i].start > MAX_CHARS:
                break
            if t.kind == "d":
                digits, groups = digits + len(t.text), groups + 1
            elif t.kind == "a":
                letters += 1
            elif t.kind in ("at", "@"):
                if at:
                    break
                at = True
            elif t.kind in ("dot", "."):
                dot = dot or at
                letters += t.kind == "dot" and groups == 0
            if t.kind in ("a", "d") and (at and dot if letters or at else (digits >= 7 or groups == 4) and digits <= 19):
                found.append((i, j + 1))
            if not (letters or at) and (digits > 19 or groups > MAX_GROUPS):
                break
    return found


def _neighbour(tokens: list[Token], k: int, spot: int, before: bool) -> str:
    """What stands beside a segment: its kind, and whether a blank is between."""
    if not 0 <= k < len(tokens):
        return "^"
    t = tokens[k]
    gap = spot - t.stop if before else t.start - spot
    return t.kind[0] + ("" if gap == 0 else "_")


def span_features(tokens: list[Token], i: int, j: int) -> list[str]:
    """Names of the features of the whole span."""
    part = tokens[i:j]
    left, right = _neighbour(tokens, i - 1, part[0].start, True), _neighbour(tokens, j, part[-1].stop, False)
    beyond = _neighbour(tokens, j + 1, tokens[j].stop, False) if right in (".", "-", "/", "(", "[") else ""
    word = next((t.text.lower() for t in reversed(tokens[max(0, i - 3) : i]) if t.kind in ("a", "at", "dot")), "")
    joints, numbers = [], []
    between = ""
    for k, t in enumerate(part):
        if k and t.start > part[k - 1].stop:
            between += "_"
        if t.kind == "d":
            joints.append(between)
            numbers.append(t.text)
            between = ""
        elif t.kind != "a":
            between += t.kind
    digits = "".join(numbers)
    if not any(t.kind in ("a", "at", "@") for t in part):
        sizes, n = "-".join(str(len(x)) for x in numbers), len(digits)
        inner = "|".join(sorted(set(joints[1:])))
        octets = len(numbers) == 4 and all(map(_octet, numbers)) and len(set(joints[1:])) == 1
        sound = n >= 13 and luhn(digits)
        out = ["number", f"n={n}", f"sizes={sizes}", f"form={joints[0]}:{sizes}:{inner}", f"inner={joints[0]}:{inner}", f"groups={len(numbers)}", f"octets={octets}:{inner}", f"luhn={sound}:{n}", f"luhn={sound}:{inner}"]
        mode = "1"
    else:
        ats = [k for k, t in enumerate(part) if t.kind in ("at", "@")]
        k = ats[-1] if ats else 0
        bracket = k > 0 and part[k - 1].kind in ("(", "[")
        how = part[k].kind + ("()" if bracket else "") + str(len(ats))
        dots = sorted({t.kind + ("[]" if part[x - 1].kind in ("[", "(") else "") for x, t in enumerate(part) if x > k and t.kind in ("dot", ".")})
        tail, head = part[-1], part[: k - bracket]
        loose = any(b.start > a.stop and "a" in (a.kind, b.kind) and not {"at", "dot"} & {a.kind, b.kind} and not {"(", "[", ")", "]"} & {a.kind, b.kind} for a, b in zip(part, part[1:], strict=False))
        ends = f"{tail.kind}{min(len(tail.text), 7)}"
        out = ["name", f"at={how}", f"dots={'|'.join(dots)}", f"way={how}:{'|'.join(dots)}", f"last={ends}", f"tail={tail.text.lower()}", f"loose={loose}", f"head={len(head) > 0}:{sum(t.kind == 'a' for t in head) > 0}:{any(t.kind == 'dot' for t in head)}"]
        mode = "2"
    return [*out, f"left{mode}={left}", f"right{mode}={right}{beyond}", f"word={word}"]


# --- the field ------------------------------------------------------------------------------------


@dataclass
class Model:
    """Weights of features by kind, and of a label after another (label 0: no personal data)."""

    index: dict[str, int]
    weights: np.ndarray
    follows: np.ndarray

    def scores(self, named: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(named), len(KINDS)))
        for row, names in enumerate(named):
            known = [self.index[x] for x in names if x in self.index]
            if known:
                out[row] = self.weights[known].sum(0)
        return out


_NEVER = -1e30


def decode(n: int, spots: list[tuple[int, int]], scores: np.ndarray, follows: np.ndarray) -> list[tuple[int, int]]:
    """(segment, kind) of the best path through a chain of ``n`` tokens; ``spots`` are segments as (start, end) by start."""
    labels = len(KINDS) + 1
    best = np.full((n + 1, labels), _NEVER)
    best[0, 0] = 0.0
    back: dict[tuple[int, int], tuple[int, int, int]] = {}
    at = 0
    for k in range(n):
        into = best[k][:, None] + follows
        came = into.argmax(0)
        into = into.max(0)
        if into[0] > best[k + 1, 0]:
            best[k + 1, 0] = into[0]
            back[k + 1, 0] = (k, int(came[0]), -1)
        while at < len(spots) and spots[at][0] == k:
            end, total = spots[at][1], into[1:] + scores[at]
            for y in np.flatnonzero(total > best[end, 1:]).tolist():
                best[end, y + 1] = total[y]
                back[end, y + 1] = (k, int(came[y + 1]), at)
            at += 1
    k, y, path = n, int(best[n].argmax()), []
    while k > 0:
        before, label, segment = back[k, y]
        if segment >= 0:
            path.append((segment, y - 1))
        k, y = before, label
    return path[::-1]


def added_spans(text: str, model: Model) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the field finds in a text."""
    found = []
    for tokens, first, last in chains(text):
        spots = candidates(tokens, first, last)
        if spots:
            scores = model.scores([span_features(tokens, i, j) for i, j in spots])
            for segment, kind in decode(last - first, [(i - first, j - first) for i, j in spots], scores, model.follows):
                i, j = spots[segment]
                found.append((kind, tokens[i].start, tokens[j - 1].stop))
    return found


def all_spans(text: str, model: Model) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) by kind and start: the base spans, and what the field adds beside them."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    made = [(k, a, b, True) for k, a, b in base]
    at, reach = 0, -1
    for kind, a, b in sorted(added_spans(text, model), key=lambda x: x[1]):
        while at < len(taken) and taken[at][0] < b:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= a:
            made.append((kind, a, b, False))
    return sorted(made)


# --- training -------------------------------------------------------------------------------------


def _sum_exp(x: np.ndarray, axis: int = 0) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def expectations(n: int, spots: list[tuple[int, int]], scores: np.ndarray, follows: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log of the sum over all paths, the probability of each segment and kind, and the expected numbers of label pairs."""
    labels = len(KINDS) + 1
    alpha, beta = np.full((n + 1, labels), _NEVER), np.full((n + 1, labels), _NEVER)
    alpha[0, 0], beta[n] = 0.0, 0.0
    at = 0
    into = np.full((n, labels), _NEVER)
    for k in range(n):
        into[k] = _sum_exp(alpha[k][:, None] + follows)
        alpha[k + 1, 0] = np.logaddexp(alpha[k + 1, 0], into[k, 0])
        while at < len(spots) and spots[at][0] == k:
            end = spots[at][1]
            alpha[end, 1:] = np.logaddexp(alpha[end, 1:], into[k, 1:] + scores[at])
            at += 1
    total = float(_sum_exp(alpha[n]))
    chances, pairs, at = np.zeros((len(spots), labels - 1)), np.zeros((labels, labels)), len(spots) - 1
    for k in range(n - 1, -1, -1):
        onward = np.full(labels, _NEVER)  # by the label that follows
        onward[0] = beta[k + 1, 0]
        while at >= 0 and spots[at][0] == k:
            ahead = scores[at] + beta[spots[at][1], 1:]
            chances[at] = np.exp(into[k, 1:] + ahead - total)
            onward[1:] = np.logaddexp(onward[1:], ahead)
            at -= 1
        edge = follows + onward
        beta[k] = _sum_exp(edge, 1)
        pairs += np.exp(alpha[k][:, None] + edge - total)
    return total, chances, pairs


def fit(texts: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """A model from texts and their spans (kind, start, end), by gradient steps of adapted size."""
    lattices, counts = [], Counter()
    for text, gold in texts:
        spans = {(a, b): k for k, a, b in gold}
        for tokens, first, last in chains(text):
            spots = candidates(tokens, first, last)
            if not spots:
                continue
            named = [span_features(tokens, i, j) for i, j in spots]
            truth = [spans.get((tokens[i].start, tokens[j - 1].stop), -1) for i, j in spots]
            inside = sum(tokens[first].start <= a and b <= tokens[last - 1].stop for a, b in spans)
            own = [spot for spot, y in zip(spots, truth, strict=True) if y >= 0]
            if len(own) < inside or any(b[0] < a[1] for a, b in zip(own, own[1:], strict=False)):
                continue  # a span that no segment matches, or two that overlap
            for names in named:
                counts.update(names)
            lattices.append((last - first, [(i - first, j - first) for i, j in spots], named, truth))
    index = {name: k for k, name in enumerate(sorted(x for x, c in counts.items() if c > 1))}
    model = Model(index, np.zeros((len(index), len(KINDS))), np.zeros((len(KINDS) + 1, len(KINDS) + 1)))
    seen_w, seen_f = np.full_like(model.weights, 1e-3), np.full_like(model.follows, 1e-3)
    lattices = [(n, spots, [[index[x] for x in names if x in index] for names in named], truth) for n, spots, named, truth in lattices]
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(lattices)
        for n, spots, known, truth in lattices:
            scores = np.array([model.weights[x].sum(0) for x in known])
            _, chances, pairs = expectations(n, spots, scores, model.follows)
            step = -chances
            k = label = 0
            for spot, y in zip(spots, truth, strict=True):
                if y >= 0 and spot[0] >= k:
                    for a, b in [*zip([label, *[0] * (spot[0] - k - 1)], [0] * (spot[0] - k), strict=False), (0 if spot[0] > k else label, y + 1)]:
                        pairs[a, b] -= 1
                    k, label = spot[1], y + 1
            for a, b in zip([label, *[0] * (n - k - 1)], [0] * (n - k), strict=False):
                pairs[a, b] -= 1
            for row, y in enumerate(truth):
                if y >= 0:
                    step[row, y] += 1
            for x, slope in zip(known, step, strict=True):
                if np.abs(slope).max() > 1e-4:
                    slope = slope - DECAY * model.weights[x]
                    seen_w[x] += slope * slope
                    model.weights[x] += RATE * slope / np.sqrt(seen_w[x])
            seen_f += pairs * pairs
            model.follows -= RATE * pairs / np.sqrt(seen_f)
    return model


def _numbers(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card(rng: random.Random, n: int, sound: bool) -> str:
    start = _numbers(rng, n - 1)
    return next(start + c for c in rng.sample("0123456789", 10) if luhn(start + c) == sound)


def _cut(digits: str, sizes: list[int], by: str) -> str:
    at, out = 0, []
    for s in sizes:
        out.append(digits[at : at + s])
        at += s
    return by.join(out)


#: Last labels of the hosts in written examples.
ENDINGS = "com org net info edu gov int biz io co eu uk us ca au de fr es it nl be ch at pl se dk pt br mx".split()


def written(rng: random.Random, name: str) -> tuple[int, str]:
    """A span in some form and its kind; -1: a text that looks like one and is none."""
    label = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    maybe = lambda x: x if rng.random() < 0.5 else ""
    kind = rng.choice([0, 0, 1, 2, 3, 3, -1, -1, -1])
    number = lambda: _numbers(rng, rng.randint(1, 3))
    if kind == 0:
        at = rng.choice(["@", "(at)", "[at]", " (at) ", " [at] ", " at ", " AT ", " At "])
        dots = [" dot ", " DOT ", "(dot)", "[dot]", " [dot] ", " (dot) "] + [".", "."] * (at.strip().lower() != "at")
        dot = rng.choice(dots)
        local = name + maybe(rng.choice([".", "_", "-"]) + label()) + maybe(number())
        return 0, local + at + dot.join([label() + maybe(number()), *([label()] if rng.random() < 0.4 else []), rng.choice(ENDINGS)])
    if kind == 1:
        return 1, rng.choice([".", "[.]", "(.)", " . ", " dot ", "[dot]", "(dot)"]).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        by = rng.choice([".", "/", " - ", " ", "-", ""])
        if rng.random() < 0.3:
            return 2, _cut(_card(rng, 15, True), [4, 6, 5], by)
        n = rng.choice([16, 16, 16, 16, 17, 18, 19])
        return 2, _cut(_card(rng, n, True), [4, 4, 4, n - 12], by)
    if kind == 3:
        a, b, c = _numbers(rng, 3), _numbers(rng, 3), _numbers(rng, 4)
        return 3, rng.choice([f"({a}) {b}-{c}", f"({a}){b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"+1.{a}.{b}.{c}", f"00{a[:2]} {b} {c}{a}", f"00{a[:2]}-{b}-{c}{a}", f"(0{a}) {b}{c}", f"0{a}/{b}{c}", f"0{a}-{b}{c}", f"0{a} {b} {c}"])
    n = rng.randint(5, 21)
    a, b, c = rng.randint(0, 99), rng.randint(0, 99), rng.randint(1900, 2099)
    return -1, rng.choice([
        _card(rng, 16, False), _cut(_card(rng, 16, False), [4, 4, 4, 4], rng.choice(" -./")), _cut(_card(rng, 15, False), [4, 6, 5], rng.choice(" -./")), _numbers(rng, n) if not 15 <= n <= 19 else _card(rng, n, False),
        f"{c}-{a % 12 + 1:02}-{b % 28 + 1:02}", f"{b % 28 + 1:02}.{a % 12 + 1:02}.{c}", f"{b % 28 + 1}/{a % 12 + 1}/{c}", f"{a % 24:02}:{b % 60:02}:{c % 60:02}", f"{a % 9}.{b}.{c % 30}", f"{a}.{b}", f"{a}-{b}", f"{c}-{c + a}", f"{a}.{rng.randint(256, 999)}.{b}.{rng.randint(256, 999)}", f"{a + 1}.{_numbers(rng, 3)}.{_numbers(rng, 3)},00",
        f"{_numbers(rng, 3)}-{_numbers(rng, 4)}", f"978-3-{_numbers(rng, 2)}-{_numbers(rng, 6)}-{a % 10}", f"{a} {b} {c} {a + b}", f"{a}, {b}, {c}, {a}", f"{name}@{label()}", f"{name} at {label()}.com", *[f"{name} at {rng.choice(['the', 'a', label()])} dot {label()[: rng.randint(2, 6)]}"] * 3, f"www.{label()}.com", f"{label()}.{label()}", f"@{name}", f"{name} (at {label()} {a}.{b})", "".join(rng.choice("0123456789abcdef") for _ in range(40)), f"{_numbers(rng, 4)}-{_numbers(rng, 4)}", f"{label()}-{_numbers(rng, 8)}", f"{_numbers(rng, 4)}/{_numbers(rng, 6)}", f"{a}/{b}", f"dot {a} at {b}.{c}",
    ])


def examples(windows_: list[str], n: int = WRITTEN, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows with the base rules' spans, and ``n`` texts of window words around a written span."""
    rng = random.Random(seed)
    words = sorted({w for x in windows_ for w in re.findall(r"\S+", x) if not re.search(r"[0-9@]", w)}) or ["a", "of", "und", "la", "the.", "(see", "no:"]
    out = [(x, base_spans(x)) for x in windows_]
    for _ in range(n):
        name = re.sub(r"[^a-z]", "", rng.choice(words).lower()) or "name"
        kind, span = written(rng, name)
        before = "".join(rng.choice(words) + " " for _ in range(rng.randint(0, 4))) + ("(" if rng.random() < 0.05 and span[0] != "(" else "")
        after = rng.choice(["", ".", ",", "!!", "%%%", ")", ";", " ", "\n"]) + "".join(" " + rng.choice(words) for _ in range(rng.randint(0, 3)))
        out.append((before + span + after, [(kind, len(before), len(before) + len(span))] if kind >= 0 else []))
    return out


def _windowing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = shared.strings(batch.column(0))
        out = []
        for text in column.filter(_may(column)).to_pylist():
            for lo, hi in windows(text):
                for at in range(lo, hi, WINDOW):
                    part = text[at : min(hi, at + WINDOW)]
                    out.append(part)
                    if len(out) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["window"])
                        out = []
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["window"])


def train(df: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` different windows of the texts, drawn by their hashes."""
    made = shared.stage(df.select(F.col(text_col).cast("string")).mapInArrow(_windowing, "window string").distinct(), "windows")
    part = max(1, made.count() // (2 * sample))  # of more windows than that only a slice is ordered
    some = made.where(F.pmod(F.xxhash64("window"), F.lit(part)) == 0).orderBy(F.xxhash64("window"), "window").limit(sample)
    found = [r["window"] for r in some.collect()]
    shared.discard(made)
    return fit(examples(found))


# --- tables ---------------------------------------------------------------------------------------


def _may(column: pa.Array) -> pa.Array:
    """Texts that hold a digit, an at sign or the word dot; no others can have a span."""
    return pc.match_substring_regex(column, "[0-9@]|[dD][oO][tT]")


def _finding(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = shared.strings(batch.column(1))
            for lo in range(0, len(column), 256):
                part = column.slice(lo, 256)
                rows: list[list[dict]] = [[] for _ in range(len(part))]
                for k in np.flatnonzero(_may(part).to_numpy(zero_copy_only=False)).tolist():
                    rows[k] = [{"kind": KINDS[kind], "start": a, "stop": b, "base": base} for kind, a, b, base in all_spans(part[k].as_py(), model)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 256), pa.array(rows, pa.list_(_SPAN))], ["doc_id", "spans"])

    return run


def find(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (kind, start, stop in code points, base: found by the base rules) by kind and start."""
    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_finding(model), f"doc_id long, spans {SPANS}")


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the numbers of base spans by kind, base_sha256, and all spans as a string."""
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.expr(f"size(filter(spans, s -> s.base AND s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redact(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with each span of its texts replaced by its kind in brackets; spans that overlap become one, of the first kind."""

    def clean(text: str) -> str:
        out, done = [], 0
        for kind, a, b, _ in sorted(all_spans(text, model), key=lambda s: (s[1], -s[2])):
            if a >= done:
                out += [text[done:a], f"[{KINDS[kind]}]"]
            done = max(done, b)
        return "".join([*out, text[done:]])

    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([x if x is None else clean(x) for x in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([made if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    return df.mapInArrow(run, df.schema)
