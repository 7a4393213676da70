"""Labelled examples of personal data, drawn from formats and phrases: texts with the spans that are personal in them.

Items stand in one of three surroundings: after a phrase that names them, after a phrase that names something else, and
among invented words that say nothing. Numbers that look alike but are none (dates, versions, order numbers, tables,
book numbers, prices, card numbers with a wrong check digit) stand there too. Items are also set side by side, where
the plain rules take several of them for one.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

#: Phrases in front of personal data, by kind; fixed values.
NAMED = {
    "email": ["email", "e-mail:", "write to", "contact me at", "mail us:", "schreiben Sie an", "E-Mail-Adresse", "courriel :", "écrivez à", "correo:", "escribe a", "reply to", "send it to", "reach me at"],
    "ip": ["IP", "ip address", "from host", "server at", "logged in from", "IP-Adresse", "adresse IP", "dirección IP", "client", "connection from", "ping"],
    "card": ["card", "credit card number", "visa", "mastercard", "pay with", "Kreditkarte", "Kartennummer", "carte bancaire", "numéro de carte", "tarjeta", "número de tarjeta", "charged to", "cc:"],
    "phone": ["phone", "tel.", "Tel:", "call", "mobile", "fax", "Telefon", "Handy", "rufen Sie an", "téléphone", "portable", "appelez", "teléfono", "móvil", "llame al", "whatsapp", "text me at", "cell:"],
}
#: Phrases in front of numbers that are not personal; fixed values.
OTHER = [
    "order", "order no.", "invoice", "Rechnung", "facture", "pedido", "ref", "id", "ticket", "serial number", "tracking", "part number", "item", "isbn", "ISBN", "version", "release", "build", "firmware",
    "section", "chapter", "Artikel", "on", "since", "dated", "am", "le", "total", "price", "EUR", "score", "page", "lines", "coordinates", "checksum", "commit", "account balance", "population", "Seite", "volumen",
]
SYLLABLES = "an be co der el fu gra hi in jo ka le mo nu or pa qui re sta tu un ver wo xa yl zu ön é ße ción".split()
NAMES = "anna ben carla dev erik fatou george hana ines jan kim lea marc nora omar pia quinn rosa sven tara".split()
HOSTS = "example sample mailbox post firma ecole correo inbox webmail posteo netz campus".split()
ENDS = "com org net de fr es eu io co.uk ac.at".split()


def words(r: random.Random, most: int = 6) -> str:
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, most)))


def digits(r: random.Random, n: int, first: str = "0123456789") -> str:
    return r.choice(first) + (f"{r.randrange(10 ** (n - 1)):0{n - 1}d}" if n > 1 else "")


def check_digit(number: str) -> str:
    """The digit that makes ``number`` pass the Luhn check."""
    total = sum(d if k % 2 else d * 2 - 9 * (d > 4) for k, d in enumerate(int(c) for c in reversed(number)))
    return str(-total % 10)


def grouped(number: str, sizes: list[int], mark: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(number[at : at + n])
        at += n
    return mark.join(out)


def email(r: random.Random) -> tuple[str, bool]:
    """An address, and whether it says of itself what it is."""
    local = r.choice(["{a}", "{a}.{b}", "{a}_{n}", "{b}{n}", "{a}-{b}"]).format(a=r.choice(NAMES), b=r.choice(NAMES), n=r.randint(1, 99))
    host = r.choice(HOSTS) + r.choice(["", "", str(r.randint(1, 99))])
    at = r.choice(["(at)", "[at]", "{at}", " (at) ", " [at] ", "@", " @ ", " at ", " AT "])
    dot = r.choice(["(dot)", "[dot]", " [dot] ", " (dot) ", "."]) if at.strip() not in ("at", "AT") else " dot " if at.islower() else " DOT "
    if at == "@":
        local, host, dot = r.choice([(local + "é", host, "."), ("ñ" + local, host, "."), (local, "mü" + host, "."), (local, host, "[.]"), (local, host, " . "), (local, host, "[dot]")])
    return local + at + host + dot + r.choice(ENDS).replace(".", dot), True


def ip(r: random.Random) -> tuple[str, bool]:
    kind = r.randint(0, 3)
    if kind == 0:
        return r.choice(["[.]", "(.)", "[dot]", " [.] "]).join(str(r.randint(0, 255)) for _ in range(4)), True
    if kind == 1:
        return ":".join(f"{r.randint(0, 65535):x}" for _ in range(8)), True
    head = [f"{r.randint(256, 65535):x}" for _ in range(r.randint(1, 4))]
    return ":".join(head) + "::" + ":".join(f"{r.randint(0, 65535):x}" for _ in range(r.randint(1, 2))), True


def card(r: random.Random) -> tuple[str, bool]:
    first = r.choice(["4", "4", "51", "52", "53", "54", "55", "2221", "2500", "6011", "34", "37", "35"])
    size = 15 if first in ("34", "37") else 16
    number = first + digits(r, size - 1 - len(first))
    number += check_digit(number)
    mark = r.choice([".", "/", "_", "  ", " ", " - ", "–", "", ""])
    return grouped(number, [4, 6, 5] if size == 15 else [4, 4, 4, 4], mark), True


def phone(r: random.Random) -> tuple[str, bool]:
    d = lambda n: digits(r, n)
    area = digits(r, 3, "23456789")
    kind = r.randint(0, 10)
    if kind <= 2:
        return r.choice([f"({area}) {d(3)}-{d(4)}", f"{area}-{d(3)}-{d(4)}", f"{area}.{d(3)}.{d(4)}", f"1-{area}-{d(3)}-{d(4)}", f"1 ({area}) {d(3)}-{d(4)}", f"({area}) {d(3)} {d(4)}", f"({area}){d(3)}-{d(4)}"]), True
    if kind <= 4:
        return r.choice([f"+{r.randint(1, 99)} ({area}) {d(3)}-{d(4)}", f"+{r.choice([1, 33, 34, 44, 49])} {d(3)} {d(3)} {d(4)}", f"+{r.choice([33, 34, 49])}/{d(3)}/{d(7)}", f"+ {r.choice([1, 33, 44])} {d(3)} {d(7)}"]), True
    if kind == 5:
        return r.choice([f"00{r.choice([1, 33, 34, 44, 49])} {d(3)} {d(7)}", f"0049 (0) {d(3)} {d(7)}", f"0033 {r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}"]), True
    return r.choice([f"0{d(3)} {d(7)}", f"0{d(2)}/{d(7)}", f"0{r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{r.randint(1, 9)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"{r.choice('69')}{d(2)} {d(3)} {d(3)}", f"{area} {d(3)} {d(4)}", f"{d(3)}-{d(4)}", f"{area}{d(7)}", f"0{d(9)}"]), False


def other(r: random.Random) -> str:
    """A number or word that looks like personal data and is none."""
    d = lambda n: digits(r, n)
    year = r.randint(1950, 2030)
    wrong = digits(r, 15, "23456")
    wrong += str((int(check_digit(wrong)) + r.randint(1, 9)) % 10)  # a wrong check digit
    return r.choice([
        lambda: f"{year}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{year}",
        lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/{year}",
        lambda: f"{year}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} {r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}",
        lambda: f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}", lambda: f"{year}-{year + r.randint(1, 9)}", lambda: f"{year}/{year + 1}",
        lambda: f"{r.randint(1, 30)}.{r.randint(0, 30)}.{r.randint(0, 30)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}",
        lambda: f"{300 + r.randint(0, 600)}.{r.randint(0, 99)}.{r.randint(0, 99)}.{r.randint(0, 99)}.{r.randint(0, 99)}", lambda: f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: f"978{d(10)}",
        lambda: f"{d(5)}-{d(4)}", lambda: f"{d(1)} {d(3)} {d(3)}", lambda: f"{d(2)} {d(3)} {d(3)} {d(3)}", lambda: f"{d(3)}.{d(3)}.{d(3)}", lambda: f"{d(3)}.{d(3)}.{d(3)},{d(2)}",
        lambda: wrong, lambda: grouped(wrong, [4, 4, 4, 4], r.choice([" ", "-", ".", "/"])), lambda: d(8), lambda: d(10), lambda: d(12), lambda: d(20), lambda: d(24),
        lambda: f"{d(2)}.{d(5)}, {d(2)}.{d(5)}", lambda: f"{d(2)}-{d(3)}", lambda: f"{d(4)}-{d(4)}", lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(6)}-{d(6)}", lambda: f"{d(4)} {d(4)}",
        lambda: " ".join(d(r.choice([1, 2, 3])) for _ in range(r.randint(5, 14))), lambda: " ".join(d(4) for _ in range(r.randint(5, 9))),
        lambda: "\t".join(d(r.randint(2, 5)) for _ in range(r.randint(4, 8))), lambda: ", ".join(d(r.randint(2, 4)) for _ in range(r.randint(4, 8))),
        lambda: " ".join(str(year + k) for k in range(r.randint(3, 6))), lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)),
        lambda: f"{d(8)}-" + "-".join("".join(r.choice("0123456789abcdef") for _ in range(4)) for _ in range(3)), lambda: f"0x{d(8)}", lambda: f"x{d(9)}", lambda: f"{d(3)}x{d(4)}",
        lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"3.{d(14)}", lambda: f"{d(2)}:{d(2)}", lambda: f"{d(1)}:{d(1)}:{d(1)}", lambda: "@" + r.choice(NAMES), lambda: f"{r.choice(NAMES)} @ home",
        lambda: f"{r.choice(NAMES)} at home", lambda: f"{r.choice(NAMES)} at the {r.choice(HOSTS)} dot", lambda: f"@{r.choice(NAMES)}.{r.choice(NAMES)}",
        lambda: f"{r.randint(2, 90)} @ {r.randint(1, 9)}.{r.randint(10, 99)}", lambda: f"std::{r.choice(NAMES)}::{r.choice(NAMES)}", lambda: f"{r.choice(NAMES)}:{r.choice(NAMES)}",
    ])()


DRAW = {"email": email, "ip": ip, "card": card, "phone": phone}


def examples(n: int, seed: int) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """``n`` texts, each with its personal spans (kind, start, end)."""
    r = random.Random(seed)
    for _ in range(n):
        text, spans = words(r), []
        for _ in range(r.randint(1, 3)):
            text += r.choice([" ", " ", "\n", ". ", ", "])
            if r.random() < 0.5:
                text += (r.choice(OTHER) if r.random() < 0.5 else words(r)) + r.choice([" ", ": ", " = "]) + other(r)
            else:
                kind = r.choice(list(DRAW))
                item, plain = DRAW[kind](r)
                beside = r.random()
                if plain and kind in ("phone", "card") and beside < 0.3:  # side by side with another number
                    near, tail = r.choice([(digits(r, r.randint(1, 6)) + " ", ""), ("", " " + digits(r, r.randint(1, 6))), ("", " " + card(r)[0].replace("/", "")), ("", " " + digits(r, r.randint(6, 9)))])
                    if kind == "card":
                        item = "".join(c for c in item if c.isdigit())
                    elif not near:
                        item = f"+{r.randint(1, 99)} ({digits(r, 3)}) {digits(r, 3)}-{digits(r, 4)}"
                    text += words(r, 3) + " " + near
                    spans.append((kind, len(text), len(text) + len(item)))
                    text += item
                    if len(tail) > 14:
                        spans.append(("card", len(text) + 1, len(text) + len(tail)))
                    text += tail
                else:
                    text += (words(r, 3) if plain and r.random() < 0.5 else r.choice(NAMED[kind])) + r.choice([" ", " ", ": "])
                    spans.append((kind, len(text), len(text) + len(item)))
                    text += item
            text += r.choice([" ", ".", ",", ")", "\n", ""]) + " " + words(r, 4)
        yield text, spans
