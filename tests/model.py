"""Plain-Python statement of the semantics, to compare the expressions with.

One string at a time, with Python's own regular expressions in ASCII mode.
"""

import re

SPACE = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
CARD = re.compile(rf"\b[0-9]{{4}}(?:[{SPACE}-]?[0-9]{{4}}){{3}}\b", re.ASCII)
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{4,30}\b", re.ASCII)
SSN = re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", re.ASCII)
EMAIL = re.compile(r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", re.ASCII)
PHONE = re.compile(
    rf"\+[0-9]{{1,3}}[{SPACE}.-]?[0-9][{SPACE}.-]?[0-9]{{3,4}}[{SPACE}.-]?[0-9]{{3,4}}\b",
    re.ASCII,
)


def digits(text):
    return [int(c) for c in text if c in "0123456789"]


def luhn(text):
    places = digits(text)[::-1]
    doubled = [2 * d for d in places[1::2]]
    return (sum(places[::2]) + sum(d // 10 + d % 10 for d in doubled)) % 10 == 0


def mask_card(m):
    if not luhn(m):
        return m
    sep = "-" if "-" in m else " " if " " in m else ""
    return sep.join(["****"] * 3 + [m[-4:]])


def mask_iban(m):
    return m if len(m) < 15 else f"{m[:4]}****{m[-4:]}"


def mask_email(m):
    return f"{m[0]}***@{m.partition('@')[2]}"


def mask_phone(m):
    d = "".join(map(str, digits(m)))
    return f"+{d[:2]}***{d[-2:]}"


STEPS = (
    ("credit_card", CARD, mask_card),
    ("iban", IBAN, mask_iban),
    ("ssn", SSN, lambda m: "***-**-****"),
    ("email", EMAIL, mask_email),
    ("phone", PHONE, mask_phone),
)


def redact(text):
    """(masked text, count, kinds, findings)"""
    found = []
    for kind, pattern, mask in STEPS:

        def replace(match, kind=kind, mask=mask):
            masked = mask(match.group())
            if masked != match.group():
                found.append((kind, masked))
            return masked

        text = pattern.sub(replace, text)
    kinds = list(dict.fromkeys(k for k, _ in found))
    return text, len(found), kinds, found


def size(text):
    return len(text.encode())


def cut(line, limit):
    pieces = []
    while size(line) > limit:
        width = max(n for n in range(len(line)) if size(line[:n]) <= limit)
        pieces.append(line[:width])
        line = line[width:]
    return [*pieces, line]


def splice(text, spans):
    """Spans (type, begin, end) replaced from the last to the first."""
    for kind, begin, end in sorted(spans, key=lambda s: -s[1]):
        text = f"{text[:begin]}[REDACTED:{kind}]{text[end:]}"
    return text
