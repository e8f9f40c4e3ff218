"""Base patterns of personal data: leftmost, non-overlapping matches of each
kind, of which those that fail their check are dropped without a retry.
Matching takes time in proportion to the text, whatever it holds."""

from __future__ import annotations

import re

# Kinds in order and the patterns they match.
KINDS = ("email", "ip", "card", "phone")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NOT_DIGIT = re.compile(r"[^0-9]+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """A match begins where the run of local characters before an @ begins
    (or the last match ends), if a domain follows the @."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text[start - 1]):
            start -= 1
        domain = DOMAIN.match(text, at) if start < at else None
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", free)
    return found


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All base spans (kind, start, end), code points, end exclusive, by kind
    and start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", a, b) for a, b in ips(text)]
    out += [("card", a, b) for a, b in cards(text)]
    if "+" in text:
        out += [("phone", a, b) for a, b in phones(text)]
    return out
