"""Detection patterns, masks and name lists.

Everything in this module is a fixed value: it has to equal the published
behaviour exactly for results to agree, so it is stated here as plain text.

Word boundaries are ASCII (a letter with an accent is *not* a word character),
while Java's ``\\b`` is Unicode-aware.  Patterns therefore use explicit
look-arounds, ``LEFT`` and ``RIGHT``, next to match characters that are always word
characters.
"""

# Names of the kinds of data found by the pattern stage, in the order applied.
PATTERN_TYPES = ("credit_card", "iban", "ssn", "email", "phone")

# White space as the reference semantics define it (includes Unicode spaces).
SPACES = (
    r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
)

LEFT = r"(?<![A-Za-z0-9_])"
RIGHT = r"(?![A-Za-z0-9_])"
_CARD_SEP = f"[{SPACES}-]?"
_PHONE_SEP = f"[{SPACES}.-]?"

# Full patterns.
CREDIT_CARD = (
    f"{LEFT}[0-9]{{4}}{_CARD_SEP}[0-9]{{4}}{_CARD_SEP}"
    f"[0-9]{{4}}{_CARD_SEP}[0-9]{{4}}{RIGHT}"
)
IBAN = f"{LEFT}([A-Z]{{2}}[0-9]{{2}})[A-Z0-9]{{7,26}}([A-Z0-9]{{4}}){RIGHT}"
SSN = f"{LEFT}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{RIGHT}"
# An address starts at the first word boundary of a run of local-part characters,
# or where the match before it ended.  No other place in a run can start one, so a
# long run without an @ is read once, not once per boundary.
_LOCAL = "[a-zA-Z0-9._%+-]"
EMAIL = (
    f"(?:(?<!{_LOCAL})([.%+-]*+)([A-Za-z0-9_])|"
    rf"\G(?<=[A-Za-z0-9_])([.%+-])){_LOCAL}*+"
    rf"@([a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}){RIGHT}"
)
PHONE = (
    rf"\+([0-9])(?:([0-9])[0-9]?{_PHONE_SEP}[0-9]|{_PHONE_SEP}([0-9]))"
    f"{_PHONE_SEP}[0-9]{{3,4}}{_PHONE_SEP}[0-9]{{1,2}}([0-9]{{2}}){RIGHT}"
)

# Replacements for the patterns above.
IBAN_MASK = "$1****$2"
SSN_MASK = "***-**-****"
EMAIL_MASK = "$1$2$3***@$4"
PHONE_MASK = "+$1$2$3***$4"

# Necessary conditions that are cheap to test before the full pattern runs.
TWO_DIGITS = "[0-9]{2}"
CREDIT_CARD_HINT = f"[0-9]{{4}}{_CARD_SEP}[0-9]{{4}}"
IBAN_HINT = "[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"
SSN_HINT = "[0-9]{3}-[0-9]{2}-[0-9]{4}"
DIGITS_HINT = f"{CREDIT_CARD_HINT}|{IBAN_HINT}|{SSN_HINT}"
EMAIL_HINT = "@"
PHONE_HINT = "+"

# Entity kinds replaced by the entity stage.
ENTITY_TYPES = (
    "NAME",
    "ADDRESS",
    "DATE_TIME",
    "AGE",
    "USERNAME",
    "PASSWORD",
    "IP_ADDRESS",
    "BANK_ACCOUNT_NUMBER",
    "PASSPORT_NUMBER",
    "DRIVER_ID",
    "AWS_ACCESS_KEY",
    "MAC_ADDRESS",
)

# Size limits.
CHUNK_BYTES = 4500
HALO_BYTES = 250  # of its surroundings that a detector sees on each side of a chunk
MAX_INPUT_CHARS = 500
TRUNCATION_MARK = "...[truncated]"
