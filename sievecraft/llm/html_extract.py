"""Main-text extraction by the maximum-scoring subsequence of words and tags.

A page becomes a sequence of text pieces and tags. A word scores by what surrounds it: the elements it stands in, the
words of their class names, ids and roles, and whether its block is short or long, text or mostly links. A tag scores negative by
its name. All weights are learned from labelled pages: the words' by logistic regression, the tags' as log odds. There
are no lists of names that decide by themselves; a name that was never seen weighs nothing.

Two linear passes decide by these scores. From the innermost outwards, a block element whose content scores zero or
less (an advert or a form inside an article, a list of comments) is cut out and counts as nothing for what is around
it; tags of elements that do nothing but wrap another one are free, so depth costs nothing. Of what is left, one scan finds the contiguous region with the highest sum; its blocks are the main text.

Names are cut into words at hyphens, underscores, digits and capitals; the last word of a name (what the thing is) and
the words before it (which one) are different features. Of the names around an ``article`` or ``main`` element those
outside of it are different features from those inside.

Scripts, styles, comments in the markup and the head are skipped while scanning; character references are decoded, a
block's white space becomes one space, and blocks are joined in page order by one space. Scanning is linear in the
page: an unclosed quote is read as a plain character; unclosed tags, comments and raw elements run to the page's end.

Defined results: null and empty pages, and pages without words or without any region above zero, have empty text;
repeated rows get equal rows; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecraft.llm.batches import short_batches
from sievecraft.llm.html_labelled import labelled_pages

#: A quote opens a value after an equals sign only, and one that is never closed is a plain character. Possessive: no way back.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>="']++|=\s*+(?>"[^"]*"|'[^']*'|)|["'])*+)>""")
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_LABEL = re.compile(r"(?:^|\s)x(?:\s|$)")
#: Their content is no text.
RAW = frozenset("script style noscript template textarea svg iframe select datalist head".split())
_END_OF = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
#: Elements of another markup, which a slash at the end of their tag closes.
FOREIGN = frozenset(("svg", "math"))
_BODY = re.compile("<body", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var img wbr object canvas audio video picture math mi mn mo mrow ms mspace msqrt mroot mfrac msub msup msubsup mtext munder mover munderover semantics".split())
#: An open element of these is closed by the next of the same kind.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_BLOCK_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SHUT = {name: frozenset(SELF_CLOSING.get(name, set()) | ({"p"} if name in _BLOCK_CLOSES_P else set())) for name in {*SELF_CLOSING, *_BLOCK_CLOSES_P}}
_CAPITAL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+")
_ALIKE = {"h2": "h1", "h3": "h1", "h4": "h1", "h5": "h1", "h6": "h1", "dd": "li", "dt": "li", "th": "td", "ol": "ul", "i": "b", "em": "b", "strong": "b"}


@dataclass(slots=True)
class Piece:
    """A run of text in one context, or a tag (``text`` is None); ``element`` is the innermost open block element."""

    text: str | None
    around: frozenset
    block: int
    element: int
    tag: str = ""
    label: bool = False
    idle: bool = False  # a tag within an element that wraps one other and nothing else


@lru_cache(1 << 16)
def _inside(around: frozenset, name: str, named: str) -> frozenset:
    """Features of what stands in an element of these names within ``around``."""
    own = {f"<{_ALIKE.get(name, name)}"}
    for token in named.split():
        words = [x.lower() for x in _WORD.findall(_CAPITAL.sub("-", token))]
        own |= {f"which {w}" for w in words[:-1]} | {f"is {w}" for w in words[-1:]}
    if name in ("article", "main"):
        around = frozenset(x if x.startswith("out ") else f"out {x}" for x in around)
    return around | own


def wrappers(found: list[Piece], parents: list[int]) -> list[bool]:
    """By element: whether it holds one block element and no words beside it, so that its tags say nothing."""
    words, kids = [0] * len(parents), [0] * len(parents)
    for p in found:
        words[p.element] += p.text is not None and not p.text.isspace()
    for k in range(1, len(parents)):
        kids[parents[k]] += 1
    return [not w and n == 1 for w, n in zip(words, kids)]


def pieces(page: str) -> tuple[list[Piece], list[int]]:
    """Text and tags of a page in order, and for each block element (0: the page) the one it stands in."""
    out: list[Piece] = []
    open_: list[tuple[str, frozenset, bool, int]] = [("", frozenset(), False, 0)]
    blocks, names, parents = [0], Counter(), [0]  # places of open block elements; open names; by element its parent
    at, block, n = 0, 0, len(page)

    def text(raw: str) -> None:
        if raw:
            _, around, label, element = open_[-1]
            out.append(Piece(html.unescape(raw), around, block, element, "", label))

    def shut(place: int) -> None:
        for x in open_[place:]:
            names[x[0]] -= 1
        del open_[place:]
        while blocks[-1] >= place:
            blocks.pop()

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        text(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        nxt = page[lt + 1 : lt + 2]
        if nxt and nxt in "!?":
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        letter = page[lt + 2 : lt + 3] if nxt == "/" else nxt
        if not (letter.isascii() and letter.isalpha()):
            if not nxt or nxt == "/":
                end = page.find(">", lt) if nxt else -1
                at = end + 1 if end >= 0 else n
            else:
                text("<")
                at = lt + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            break  # a tag cut off by the page's end
        closing, name, attrs, at = m[1] == "/", m[2].lower(), m[3], m.end()
        if not closing and name in RAW and not (name in FOREIGN and attrs.endswith("/")):
            end = _END_OF[name].search(page, at)
            if name == "head" and not end:
                end = _BODY.search(page, at)
                at = end.start() if end else n
                continue
            close = page.find(">", end.end()) if end else -1
            at = n if close < 0 else close + 1
            continue
        if name == "br":
            text(" ")
        elif name not in INLINE:
            block += 1
        if closing:
            if names[name] > 0:
                place = len(open_) - 1
                while open_[place][0] != name:
                    place -= 1
                shut(place)
        elif name in _SHUT and open_[blocks[-1]][0] in _SHUT[name]:
            shut(blocks[-1])
        around, element = open_[-1][1], open_[-1][3]
        out.append(Piece(None, around, block, element, name))
        if not closing and name not in VOID and not attrs.endswith("/"):
            named = ""
            if "=" in attrs and name not in ("html", "body"):
                named = " ".join(x.strip("\"'") for x in _NAMED.findall(attrs))
            label = bool(attrs and _LABEL.search(attrs)) or open_[-1][2]
            if name not in INLINE:
                parents.append(element)
                element = len(parents) - 1
                blocks.append(len(open_))
            names[name] += 1
            open_.append((name, _inside(around, name, named) if name not in ("html", "body") else around, label, element))
    idle = wrappers(out, parents)
    for p in out:
        p.idle = p.text is None and idle[p.element]
    return out, parents


def block_features(found: list[Piece]) -> dict[int, str]:
    """Of each block with words: how long it is, and whether most of its words are links."""
    words, linked = Counter(), Counter()
    for p in found:
        if p.text is not None and (n := len(p.text.split())):
            words[p.block] += n
            linked[p.block] += n if "<a" in p.around else 0
    return {b: ("short" if n < 4 else "long" if n > 11 else "middling") + (" links" if 2 * linked[b] > n else "") for b, n in words.items()}


@cache
def learned_weights() -> tuple[dict[str, float], dict[str, float]]:
    """(weight of each feature for a word, weight of each tag), from the labelled pages."""
    seen: dict[tuple[frozenset, bool], float] = defaultdict(float)
    tags: dict[str, list[float]] = defaultdict(lambda: [1.0, 1.0])
    for page in labelled_pages():
        found, _ = pieces(page)
        of_block = block_features(found)
        spots = [k for k, p in enumerate(found) if p.label]
        for k, p in enumerate(found):
            if p.text is None:
                tags[p.tag][bool(spots) and spots[0] <= k <= spots[-1]] += 1
            elif p.text.strip():
                seen[p.around | {of_block[p.block]}, p.label] += 1
    features = sorted({f for around, _ in seen for f in around})
    slot = {f: k for k, f in enumerate(features)}
    x, y, c = np.zeros((len(seen), len(features) + 1)), np.zeros(len(seen)), np.zeros(len(seen))
    x[:, -1] = 1
    for j, ((around, label), count) in enumerate(seen.items()):
        x[j, [slot[f] for f in around]] = 1
        y[j], c[j] = label, count**0.5
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton steps with a ridge
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (c * q * (1 - q) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (c * (y - q)) - 0.1 * w)
    odds = {t: float(np.log(inside / outside)) for t, (outside, inside) in tags.items()}
    top = max(odds.values())
    return dict(zip([*features, "any"], w.tolist())), {t: 0.01 * (v - top) - 0.01 for t, v in odds.items()}


def scored(found: list[Piece], weights: tuple[dict[str, float], dict[str, float]]) -> list[float]:
    """Score of each piece: its words' weight times their number, or its tag's weight."""
    word_w, tag_w = weights
    rare = min(tag_w.values(), default=-0.1)
    of_block, known, out = block_features(found), {}, []
    for p in found:
        if p.text is None:
            out.append(0.0 if p.idle else tag_w.get(p.tag, rare))
            continue
        n = len(p.text.split())
        if not n:
            out.append(0.0)
            continue
        base = known.get(p.around)
        if base is None:
            base = known[p.around] = word_w.get("any", 0.0) + sum(word_w.get(f, 0.0) for f in p.around)
        out.append(n * (base + word_w.get(of_block[p.block], 0.0)))
    return out


def cut_out(found: list[Piece], parents: list[int], scores: list[float]) -> list[bool]:
    """By element: whether it, or one it stands in, scores zero or less without the elements cut out of it."""
    total = [0.0] * len(parents)
    for p, v in zip(found, scores):
        total[p.element] += v
    for k in range(len(parents) - 1, 0, -1):
        if total[k] > 0:
            total[parents[k]] += total[k]
    gone = [False] * len(parents)
    for k in range(1, len(parents)):
        gone[k] = total[k] <= 0 or gone[parents[k]]
    return gone


def best_region(weights: list[float]) -> tuple[int, int]:
    """Start and end (exclusive) of the contiguous run with the highest sum; (0, 0) if none is positive."""
    best, run, start, where = 0.0, 0.0, 0, (0, 0)
    for k, v in enumerate(weights):
        if run <= 0:
            run, start = 0.0, k
        run += v
        if run > best:
            best, where = run, (start, k + 1)
    return where


def main_text(page: str | None, weights: tuple[dict[str, float], dict[str, float]] | None = None) -> str:
    """The main text of one page."""
    found, parents = pieces(page or "")
    scores = scored(found, weights or learned_weights())
    gone = cut_out(found, parents, scores)
    a, b = best_region([0.0 if gone[p.element] else v for p, v in zip(found, scores)])
    blocks: dict[int, list[str]] = {}
    for p in found[a:b]:
        if p.text is not None and not gone[p.element]:
            blocks.setdefault(p.block, []).append(p.text)
    return " ".join(x for x in (" ".join("".join(v).split()) for v in blocks.values()) if x)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars."""
    weights = learned_weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py(), weights) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    picked = short_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")
