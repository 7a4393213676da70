"""Personal data: e-mail addresses, IP addresses, card and phone numbers in whole texts.

Plain rules give the base spans. What they miss is found by candidates: generators propose every span that may be
personal, overlapping ones too (windows over the groups of a chain of digits, addresses with written-out marks or
letters beyond ASCII, dotted and hexadecimal chains); gradient-boosted trees of each kind score a candidate by its
format and its context (characters beside it, digits left and right in the same chain, and how far the words around it
speak for the kind, which is learned as well); scores are calibrated and a kind's threshold is the lowest that keeps
its precision on examples held out. Of the candidates above it the best stay, as far as they overlap neither a base
span nor a better one.

Models are fitted on the driver on ``EXAMPLES`` drawn texts (see ``pii_labelled``), so they depend on no table; every
text is searched whole, by expressions that never go back over what they have read.

Defined results: null texts count as empty; offsets are code points, ends exclusive; rows without an id and repeated
rows are treated like others; an empty table gives an empty result; other columns are not read, whatever they are called.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecraft.llm import pii_labelled
from sievecraft.llm.batches import short_batches
from sievecraft.llm.quality import Trees, fit_trees

KINDS = ("email", "ip", "card", "phone")
EXAMPLES, PRECISION = 4_000, 0.985
Span = tuple[str, int, int]

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_CHAIN = re.compile(r"[0-9](?:[\x20\xa0().\-/_–]{0,3}[0-9]){6,}+")
_RUN = re.compile(r"[0-9]++")
_MARK = re.compile(r"[@＠]|[aA][tTr](?:roba)?(?=[\s)\]}])")
_AROUND = re.compile(r"\s?[\(\[{]\s?(?:at|AT|arroba)\s?[\)\]}]\s?|\s(?:at|AT)\s|\s?[@＠]\s?")
_DOT = r"(?:\s?[\(\[{]\s?(?:dot|DOT|\.|punkt|point|punto)\s?[\)\]}]\s?|\s(?:dot|DOT)\s|\s\.\s|\.)"
_HOST = re.compile(rf"[^\W_](?:[\w-]{{0,62}})(?:{_DOT}[^\W_][\w-]{{0,62}}){{0,8}}")
_BEFORE_AT = re.compile(r"[\w.%+-]{1,64}$")
_MARKED = re.compile(r"[0-9](?<![0-9.][0-9])[0-9]{0,2}+(?:\s?[\(\[](?:\.|dot)[\)\]]\s?[0-9]{1,3}){3}(?![0-9])")
_DOTTED = re.compile(r"[0-9](?<![0-9.][0-9])[0-9]{0,2}+(?:\.[0-9]{1,3}){4,}+(?![0-9])")
_COLONS = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
_WORD = re.compile(r"[^\W\d_]{2,}")
NEAR = 48
#: A number is written in this many groups of digits at most.
MOST_GROUPS = 8


def luhn(digits: str) -> bool:
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The spans of the plain rules, by kind and start."""
    out: list[Span] = []
    end = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            at = start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = m.end()
                out.append(("email", start, end))
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_only_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


@dataclass(frozen=True, slots=True)
class Candidate:
    kind: str
    start: int
    end: int
    left: int = 0  # digits or parts of the same chain before the span
    right: int = 0
    groups: tuple[int, ...] = ()


def _numbers(text: str) -> Iterator[Candidate]:
    for chain in _CHAIN.finditer(text):
        runs = [(m.start(), m.end()) for m in _RUN.finditer(text, *chain.span())]
        sizes = [b - a for a, b in runs]
        whole, before = sum(sizes), 0
        for i, (a, _) in enumerate(runs):
            n = 0
            open_ = a - (text[a - 1 : a] == "(")
            plus = 1 if text[open_ - 1 : open_] == "+" else 2 if text[max(0, open_ - 2) : open_] == "+ " else 0
            for j in range(i, min(i + MOST_GROUPS, len(runs))):
                n += sizes[j]
                if n > 19:
                    break
                end, around = runs[j][1], (before, whole - before - n, tuple(sizes[i : j + 1]))
                if 13 <= n and luhn(_only_digits(text[a:end])):
                    yield Candidate("card", a, end, *around)
                if 7 <= n <= 15:  # a bracket in front belongs to the number if it closes within
                    start = open_ if ")" in text[a:end] else a
                    yield Candidate("phone", start - plus if start == open_ else start, end, *around)
            before += sizes[i]


def _ats(text: str) -> Iterator[re.Match]:
    """The marks that stand for an @, with the brackets and spaces around them."""
    for m in _MARK.finditer(text):
        for before in (3, 2, 1, 0):  # a space, a bracket, a space
            found = _AROUND.match(text, m.start() - before) if m.start() >= before else None
            if found and found.start() <= m.start() < found.end() and found.end() >= m.end():
                yield found
                break


def _emails(text: str) -> Iterator[Candidate]:
    for at in _ats(text):
        local = _BEFORE_AT.search(text, max(0, at.start() - 64), at.start())
        host = _HOST.match(text, at.end())
        if not local or not host:
            continue
        start = local.start() + len(local[0]) - len(local[0].lstrip(".%+-"))
        labels = [m for m in re.finditer(_DOT, host[0])]
        for k in range(max(0, len(labels) - 3), len(labels) + 1):
            end = host.end() if k == len(labels) else at.end() + labels[k].start()
            if k and start < at.start():
                yield Candidate("email", start, end, 0, len(labels) - k, (k + 1,))


def _addresses(text: str) -> Iterator[Candidate]:
    if "[." in text or "(." in text or "dot" in text:
        for m in _MARKED.finditer(text):
            yield Candidate("ip", *m.span(), 0, 0, (4,))
    for m in _DOTTED.finditer(text):
        runs = [x.span() for x in _RUN.finditer(text, *m.span())]
        for k in range(len(runs) - 3):
            yield Candidate("ip", runs[k][0], runs[k + 3][1], k, len(runs) - 4 - k, (4,))
    if "::" in text or text.count(":") > 6:
        for m in _COLONS.finditer(text):
            if any(c != ":" for c in m[0]):
                yield Candidate("ip", *m.span(), 0, 0, (m[0].count(":") + 1,))


def candidates(text: str, base: list[Span]) -> list[Candidate]:
    """Proposed spans that touch no base span, and addresses that hold a base address whole and go beyond it."""
    held = sorted((a, b, k) for k, a, b in base)
    starts, ends = [a for a, _, _ in held], list(accumulate((b for _, b, _ in held), max))
    out = []
    for source in (_numbers, _emails, _addresses):
        for c in source(text):
            at = bisect.bisect_left(starts, c.end)
            if not at or ends[at - 1] <= c.start:
                out.append(c)
            elif c.kind == "email" and held[at - 1][2] == "email" and c.start < held[at - 1][0] and held[at - 1][1] == c.end and (at < 2 or ends[at - 2] <= c.start):
                out.append(c)
    return out


def _beside(text: str, at: int) -> int:
    if not 0 <= at < len(text):
        return 0
    c = text[at]
    return 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in "$€£%#=/\\@_" else 5 if c in ".,;:!?" else 6


def around(text: str, c: Candidate) -> tuple[list[str], list[str]]:
    left = _WORD.findall(text[max(0, c.start - NEAR) : c.start].lower())
    return left[-6:][::-1], _WORD.findall(text[c.end : c.end + NEAR].lower())[:3]


def features(text: str, c: Candidate, cues: dict[str, float]) -> list[float]:
    """Format and context of a candidate."""
    s = text[c.start : c.end]
    d = _only_digits(s)
    marks = Counter(x for x in s if not x.isalnum())
    left, right = around(text, c)
    speak = [cues.get(w, 0.0) for w in left]
    out = [
        len(s), len(d), sum(x.isalpha() for x in s), s.count(" "), len(marks), max(marks.values(), default=0), _beside(text, c.start - 1), _beside(text, c.end), c.left, c.right, len(c.groups),
        max(c.groups, default=0), min(c.groups, default=0), c.groups[0] if c.groups else 0, c.groups[-1] if c.groups else 0, len(set(c.groups)), len(set(d)),
        speak[0] if speak else 0.0, max(speak[:3], default=0.0), min(speak[:3], default=0.0), max(speak, default=0.0), max((cues.get(w, 0.0) for w in right), default=0.0),
    ]
    if c.kind in ("card", "phone"):
        out += [s[0] == "+", s[0] == "(" or "(" in s, s.count("(") == s.count(")"), d.startswith("00"), d[0] == "0", int(d[:1]), int(d[:2]), luhn(d) if c.kind == "card" else 0, "/" in s, "." in s, "-" in s, any(text[k] in "+" for k in range(max(0, c.start - 3), c.start))]
    elif c.kind == "ip":
        parts = [p for p in re.split(r"[^0-9A-Fa-f]+", s.replace("dot", ".")) if p]
        numbers = [int(p) for p in parts if p.isdigit()]
        out += ["::" in s, s.count(":"), sum(x in "abcdefABCDEF" for x in s), max(numbers, default=0), sum(p[0] == "0" and len(p) > 1 for p in parts), "[" in s or "(" in s, len(parts), max(map(len, parts), default=0), 0, 0, 0, 0]
    else:
        mark = next(_ats(s), None)
        last = re.split(_DOT, s)[-1]
        out += [mark[0].strip() in "@＠" if mark else 0, mark[0] != mark[0].strip() if mark else 0, bool(mark and mark[0].strip()[0] in "([{"), bool(re.search(r"[\(\[{]", s)), len(last), last.isalpha(), s.isascii(), mark.start() if mark else 0, last.lower() == last, " " in last, len(re.findall(_DOT, s)), any(x in s for x in (" dot ", " DOT "))]
    return [float(x) for x in out]


@dataclass
class Detector:
    """By kind: what context words say, trees, the line that calibrates their log odds, and the threshold."""

    cues: dict[str, dict[str, float]]
    trees: dict[str, Trees]
    line: dict[str, tuple[float, float]]
    threshold: dict[str, float]

    def probabilities(self, kind: str, x: np.ndarray) -> np.ndarray:
        p = np.clip(self.trees[kind].score(x), 1e-9, 1 - 1e-9)
        a, b = self.line[kind]
        return 1 / (1 + np.exp(-(a * np.log(p / (1 - p)) + b)))

    def added(self, texts: list[str], bases: list[list[Span]]) -> list[list[Span]]:
        """The spans that are added to the base spans of each text."""
        found: list[list[tuple[float, Candidate]]] = [[] for _ in texts]
        by_kind: dict[str, list[tuple[int, Candidate, list[float]]]] = {k: [] for k in KINDS}

        def settle(kind: str) -> None:
            rows = by_kind[kind]
            if rows:
                p = self.probabilities(kind, np.array([x for _, _, x in rows]))
                for k in np.flatnonzero(p >= self.threshold[kind]):
                    found[rows[k][0]].append((float(p[k]), rows[k][1]))
                rows.clear()

        for i, (text, base) in enumerate(zip(texts, bases)):
            for c in candidates(text, base):
                by_kind[c.kind].append((i, c, features(text, c, self.cues[c.kind])))
                if len(by_kind[c.kind]) >= 20_000:
                    settle(c.kind)
        for kind in KINDS:
            settle(kind)
        return [apart(x) for x in found]


def apart(scored: list[tuple[float, Candidate]]) -> list[Span]:
    """The best candidates that do not overlap; of equal ones the longer, then the first."""
    starts: list[int] = []
    taken: list[Span] = []
    for _, c in sorted(scored, key=lambda x: (-x[0], x[1].start - x[1].end, x[1].start, x[1].kind)):
        at = bisect.bisect_left(starts, c.start)
        if (at and taken[at - 1][2] > c.start) or (at < len(taken) and taken[at][1] < c.end):
            continue
        starts.insert(at, c.start)
        taken.insert(at, (c.kind, c.start, c.end))
    return taken


def _calibrate(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps on the logistic loss, with a little weight on the identity."""
    w = np.array([1.0, 0.0])
    x = np.stack([odds, np.ones(len(odds))], axis=1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 0.1 * (w - np.array([1.0, 0.0]))
        w = w - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(2), grad)
    return float(w[0]), float(w[1])


def fit_detector(examples: int = EXAMPLES, seed: int = 11, precision: float = PRECISION) -> Detector:
    """A third of the examples teaches the words, a third the trees, a third calibrates and sets the thresholds."""
    drawn = []
    for text, spans in pii_labelled.examples(examples, seed):
        truth = set(spans)
        drawn.append((text, [(c, (c.kind, c.start, c.end) in truth) for c in candidates(text, base_spans(text))]))
    third = len(drawn) // 3
    cues: dict[str, dict[str, float]] = {}
    for kind in KINDS:
        seen = {True: Counter(), False: Counter()}
        total = Counter()
        for text, cs in drawn[:third]:
            for c, y in cs:
                if c.kind == kind:
                    left, right = around(text, c)
                    seen[y].update(set(left[:3] + right[:1]))
                    total[y] += 1
        often = [w for w in seen[True] | seen[False] if seen[True][w] + seen[False][w] >= 8]
        cues[kind] = {w: math.log((seen[True][w] + 0.5) / (total[True] + 1)) - math.log((seen[False][w] + 0.5) / (total[False] + 1)) for w in often}
    out = Detector(cues, {}, {}, {})
    rows = lambda part, kind: [(features(t, c, cues[kind]), y) for t, cs in part for c, y in cs if c.kind == kind]
    for kind in KINDS:
        learn, test = rows(drawn[third : 2 * third], kind), rows(drawn[2 * third :], kind)
        out.trees[kind] = fit_trees(np.array([x for x, _ in learn]), np.array([y for _, y in learn], float), trees=40, depth=4)
        x, y = np.array([x for x, _ in test]), np.array([y for _, y in test], float)
        p = np.clip(out.trees[kind].score(x), 1e-9, 1 - 1e-9)
        out.line[kind] = _calibrate(np.log(p / (1 - p)), y)
        p = out.probabilities(kind, x)
        order = np.argsort(-p, kind="stable")
        exact = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        enough = np.flatnonzero(exact >= precision)
        out.threshold[kind] = max(0.5, float(p[order][enough[-1]])) if len(enough) else 1.1
    return out


@lru_cache(maxsize=1)
def detector() -> Detector:
    """The detector with the settings above; fitted once in a process."""
    return fit_detector()


def joined(spans: list[Span]) -> str:
    order = {k: n for n, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Detector | None = None) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone (of the base spans), base_sha256, spans (all of them)."""
    shared = docs.sparkSession.sparkContext.broadcast(model or detector())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            bases = [base_spans(t) for t in texts]
            counts = [Counter(k for k, _, _ in x) for x in bases]
            spans = [joined(x + y) for x, y in zip(bases, shared.value.added(texts, bases))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array([c[k] for c in counts], pa.int64()) for k in KINDS], pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in bases], pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    rows = short_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: str) -> str:
    """``text`` with each of the joined ``spans`` replaced by its kind in brackets; of overlapping ones the earlier counts."""
    out, at = [], 0
    for kind, start, end in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
