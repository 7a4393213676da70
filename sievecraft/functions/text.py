"""Text functions as column expressions: tokens, n-grams, phrases, titles, document numbers, hashes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}_]+"
#: Words that carry no content, in phrases, in lexical coverage, in passages and in titles.
PHRASE_STOP_WORDS = ("là", "có", "và", "của", "được", "như", "thế", "nào", "gì", "cho", "trong", "khi", "về", "theo", "thì", "phải", "một", "những", "các")
TITLE_STOP_WORDS = (
    "bị", "các", "có", "của", "cho", "được", "để", "đến", "đối", "gì", "hay", "khi", "không", "là", "làm", "một", "nào", "những", "như", "phải", "ra", "sẽ", "theo", "thì", "thế", "trong", "trên", "từ", "và", "về", "với", "việc",
)
LEGAL_STOP_WORDS = (*TITLE_STOP_WORDS, "bao", "nhiêu")
PASSAGE_STOP_WORDS = (*LEGAL_STOP_WORDS, "người", "quy", "định")
#: Classes of legal documents, and by which rule each is told from the first 400 characters in capitals.
DOC_CLASSES = ("LUAT", "NGHIDINH", "THONGTU", "QUYETDINH", "CONGVAN", "KHAC")
CLASS_RULES = (("LUAT", r"LUẬT\s+SỐ|LUẬT\s*[:\n]|^[\s\S]{0,92}QUỐC HỘI"), ("NGHIDINH", "NGHỊ ĐỊNH"), ("THONGTU", "THÔNG TƯ"), ("QUYETDINH", "QUYẾT ĐỊNH"), ("CONGVAN", "V/V|CÔNG VĂN"))
#: Words of a question that hint at a class.
HINTS = {"luat": "luật", "nghidinh": "nghị định", "thongtu": "thông tư", "quyetdinh": "quyết định", "congvan": "công văn|hướng dẫn"}
#: Where a title starts and ends, a document's number after its mark, a number in a question, a reference.
TITLE_START, TITLE_END = r"(?iu)(LUẬT|NGHỊ ĐỊNH|THÔNG TƯ|QUYẾT ĐỊNH|BỘ LUẬT|PHÁP LỆNH)\s*\n", "Căn cứ|CĂN CỨ"
MARKED_NUMBER = r"(?iu)Số:?\s*(\d+[/.](?:\d{4}[/.])?[A-ZĐƯƠ\-]+)"
LOOSE_NUMBER = r"(?iu)(\d+[/.](?:\d{4}[/.])?[A-ZĐƯƠ\-]{2,})"
LEGAL_REFERENCE = r"(?iu)(?:điều|khoản|điểm|mục|chương)\s+[\p{L}\p{N}_.-]+|\b\d{1,4}/\d{2,4}/[\p{L}\p{N}_-]+\b"
PREAMBLE_END = r"(?iu)Điều\s+1\b"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def space_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"), F.lit(0))


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once; inside a lambda an expression would be evaluated for every element."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def _runs(w: Column, n: int) -> Column:
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.slice(w, i, n))).otherwise(F.array().cast("array<array<string>>"))


def windows(arr: Column, n: int) -> Column:
    """All runs of n elements, space-joined."""
    return bound(arr, lambda w: F.transform(_runs(w, n), lambda g: F.array_join(g, " ")))


def phrases(arr: Column, n: int, stop: tuple[str, ...] = PHRASE_STOP_WORDS) -> Column:
    """Distinct n-grams with at least max(1, n - 1) words that are no stop words."""
    words = F.array(*map(F.lit, stop))
    kept = bound(arr, lambda a: F.filter(_runs(a, n), lambda g: F.size(F.filter(g, lambda w: ~F.array_contains(words, w))) >= max(1, n - 1)))
    return F.array_distinct(F.transform(kept, lambda g: F.array_join(g, " ")))


def ngram_features(arr: Column, most: int = 3) -> Column:
    """Distinct features ``n:w1 w2`` for n = 1..most."""

    def named(n: int) -> Column:
        return F.transform(windows(arr, n), lambda g: F.concat(F.lit(f"{n}:"), g))

    return F.array_distinct(F.concat(*[named(n) for n in range(1, most + 1)]))


def char_ngrams(arr: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams within words padded by a space on either side; words too short for one give none."""

    def of_length(p: Column, n: int) -> Column:
        return F.when(F.length(p) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - n + 1, F.lit(1))), lambda i: F.substring(p, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    padded = F.transform(arr, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda p: F.concat(*[of_length(p, n) for n in range(low, high + 1)])))


def title_from_link(link: Column) -> Column:
    """Last path segment without .aspx and a trailing number, hyphens as spaces."""
    path = F.regexp_replace(F.regexp_replace(link, r"[?#].*$", ""), r"/+$", "")
    last = F.element_at(F.split(path, "/"), -1)
    return F.trim(F.replace(F.regexp_replace(F.regexp_replace(last, r"(?i)\.aspx$", ""), r"-\d+$", ""), F.lit("-"), F.lit(" ")))


def title_words(text: Column, stop: tuple[str, ...] = TITLE_STOP_WORDS) -> Column:
    """Distinct words of letters, two or more of them, that are no stop words."""
    words = F.array(*map(F.lit, stop))
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)), lambda w: (F.length(w) >= 2) & ~F.array_contains(words, w)))


def legal_title(text: Column, most: int = 300, head: int = 800) -> Column:
    """The title of a legal document: from after the line that names its class to the first ground it cites."""
    h = F.substring(F.coalesce(text, F.lit("")), 1, head)
    after = F.when(h.rlike(TITLE_START), F.regexp_extract(h, f"{TITLE_START}([\\s\\S]*)$", 2)).otherwise(F.lit(""))
    cut = F.when(after.rlike(TITLE_END), F.regexp_extract(after, f"^([\\s\\S]*?)(?:{TITLE_END})", 1)).otherwise(F.substring(after, 1, most))
    return F.substring(F.trim(F.regexp_replace(cut, r"(?U)\s+", " ")), 1, most)


def doc_class(text: Column) -> Column:
    return classify(text, CLASS_RULES, 400, "KHAC")


def question_hints(question: Column) -> list[Column]:
    """A flag for each class that words of the question hint at."""
    q = F.lower(F.coalesce(question, F.lit("")))
    return [q.rlike(words).cast("double").alias(f"hint_{name}") for name, words in HINTS.items()]


def named_numbers(question: Column) -> Column:
    """Document numbers that a question names, in capitals."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(LOOSE_NUMBER), F.lit(1)), F.upper))


def legal_references(question: Column) -> Column:
    """Articles, clauses, points and numbered documents that a question names, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(question, F.lit(""))), F.lit(LEGAL_REFERENCE), F.lit(0)))


def preamble(text: Column, search: int = 3000, otherwise: int = 2000) -> Column:
    """What stands before the first article, if that starts early, else the head of the text."""
    h = F.substring(F.coalesce(text, F.lit("")), 1, search)
    return F.when(h.rlike(PREAMBLE_END), F.regexp_extract(h, f"^([\\s\\S]*?){PREAMBLE_END}", 1)).otherwise(F.substring(F.coalesce(text, F.lit("")), 1, otherwise))


def cited_documents(text: Column) -> Column:
    """Numbers marked as such in the preamble, without the document's own."""
    own = own_number(text, 300, MARKED_NUMBER)
    found = F.array_distinct(F.transform(F.regexp_extract_all(preamble(text), F.lit(MARKED_NUMBER), F.lit(1)), F.upper))
    return F.filter(found, lambda x: own.isNull() | (x != own))


def classify(text: Column, rules: tuple[tuple[str, str], ...], head: int = 400, other: str = "other") -> Column:
    """First rule (class, pattern) that the upper-cased head of a text matches; the order of rules matters."""
    h = F.upper(F.substring(F.coalesce(text, F.lit("")), 1, head))
    out = F.lit(other)
    for name, pattern in reversed(rules):
        out = F.when(h.rlike(pattern), F.lit(name)).otherwise(out)
    return out


#: Fixed value: number of a legal document, such as 12/2020/ND-CP.
DOC_NUMBER = r"(?iu)(\d{1,4}/(?:\d{4}/)?[\p{L}\d-]+)"


def own_number(text: Column, head: int = 300, pattern: str = DOC_NUMBER) -> Column:
    return F.nullif(F.upper(F.regexp_extract(F.substring(F.coalesce(text, F.lit("")), 1, head), pattern, 1)), F.lit(""))


def cited_numbers(text: Column, head: int = 2000, pattern: str = DOC_NUMBER) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.substring(F.coalesce(text, F.lit("")), 1, head), F.lit(pattern), F.lit(1)), F.upper))


def sha_bucket(qid: Column, modulus: int = 10) -> Column:
    """The 256-bit SHA-256 of an id as an integer, modulo 10: 16 = 6 (mod 10) for every power from the first on."""
    h = F.sha2(qid.cast("string"), 256)
    digit = lambda c: F.conv(c, 16, 10).cast("int")
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(63)), lambda i: digit(F.substring(h, i, F.lit(1)))), F.lit(0), lambda a, x: a + x)
    return F.pmod(6 * total + digit(F.substring(h, 64, 1)), F.lit(modulus))


def rank_bucket(rank: Column) -> Column:
    return F.when(rank.isNull(), "missing").when(rank <= 5, "1-5").when(rank <= 10, "6-10").when(rank <= 20, "11-20").when(rank <= 50, "21-50").otherwise("51+")


@F.pandas_udf(T.StringType())
def folded(s: pd.Series) -> pd.Series:
    """NFKC, lower case, accents stripped, everything but words as one space. No built-in decomposes characters."""

    def one(x: str | None) -> str:
        x = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", x or "").lower())
        x = "".join(c for c in x if unicodedata.category(c) != "Mn")
        return " ".join("".join(c if c.isalnum() or c == "_" else " " for c in x).split())

    return s.map(one)
