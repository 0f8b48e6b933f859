"""Lexical rules for text cells, as SQL expressions over built-in functions.

A *token* is a text cell without outer whitespace. ``token_family`` names the format family of a
token (``INTEGER_PLUS``, ``DATE_ISO``, ...), ``LEADING_ZERO`` for codes such as ``007``, or ``''``
when no typed parser accepts it. The parsers are mutually exclusive, so the one family name carries
the verdict of all of them.

The builders take and return SQL text: a profile of a wide table is then parsed and analysed once,
instead of once per function call.
"""

from __future__ import annotations

# The typed parsers, in the order in which a type is chosen.
TYPED = ("BOOLEAN", "INTEGER", "FLOAT", "DATE", "DATETIME")

# The lexical shapes.
BOOLEAN_WORD = r"(?iu)\A(?:true|false|yes|no)\z"
STRICT_BOOLEAN_WORD = r"(?iu)\A(?:true|false)\z"
LEADING_ZERO_CODE = r"\A0[0-9]+\z"
INTEGER_TEXT = r"\A[+-]?(?:0|[1-9][0-9]*)\z"
FLOAT_TEXT = r"\A[+-]?(?:0|[1-9][0-9]*)\.[0-9]+\z"
# Calendar days of the years 0001 to 9999, and clock times with an optional zone of less
# than 24 hours (its minutes may run to 99 while the sum stays below that).
_LEAP = r"(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:0[48]|[2468][048]|[13579][26])00)"
_DAY = (
    r"(?:(?!0000)[0-9]{4}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])"
    r"|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8]))"
    rf"|{_LEAP}-02-29)"
)
_CLOCK = r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?"
_ZONE = r"[+-](?:(?:[01][0-9]|2[0-2]):[0-9]{2}|23:[0-5][0-9])"
DATE_TEXT = rf"\A{_DAY}\z"
DATETIME_TEXT = rf"\A{_DAY}T{_CLOCK}(?:Z|{_ZONE})?\z"

# The characters removed around a token (every Unicode whitespace character).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# A cheap test every typed token passes; prose fails it within a few characters, so long texts
# are neither trimmed nor parsed.
_SPACE = "[\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]*+"
TOKEN_GATE = (
    rf"\A{_SPACE}(?:[+\-]?[0-9][0-9T:.+\-Z]*+|(?iu:true|false|yes|no)){_SPACE}\z"
)

LEADING_ZERO = "LEADING_ZERO"
NO_FAMILY = ""


def _regex(pattern: str) -> str:
    return f"r'{pattern}'"


_TRIMMED = "'" + "".join(f"\\u{ord(character):04x}" for character in WHITESPACE) + "'"


def may_be_token(text: str) -> str:
    """Whether the text has the outline of a typed token or a leading-zero code."""
    return f"{text} rlike {_regex(TOKEN_GATE)}"


def token_of(text: str) -> str:
    """The text without outer whitespace, or null when it cannot be a typed token."""
    return f"case when {may_be_token(text)} then btrim({text}, {_TRIMMED}) end"


def date_number(token: str) -> str:
    """Days since 1970-01-01 of an ISO date token."""
    return f"cast(unix_date(try_cast(substring({token}, 1, 10) as date)) as bigint)"


def datetime_number(token: str) -> str:
    """Microseconds since 1970-01-01 UTC of an ISO datetime token; digits beyond six are cut."""
    part = lambda start: f"try_cast(substring({token}, {start}, 2) as bigint)"
    zone = (
        f"case substring({token}, -6, 1) when '+' then 1 when '-' then -1 else 0 end"
        f" * (coalesce({part(-5)}, 0) * 60 + coalesce({part(-2)}, 0)) * 60"
    )
    seconds = f"{date_number(token)} * 86400 + {part(12)} * 3600 + {part(15)} * 60 + {part(18)} - {zone}"
    fraction = f"rpad(regexp_extract({token}, r'\\.([0-9]{{1,6}})', 1), 6, '0')"
    return f"(({seconds}) * 1000000 + cast({fraction} as bigint))"


def token_family(token: str) -> str:
    """Format family of a token; null and unparseable tokens give ``''``."""

    def signed(kind: str) -> str:
        return (
            f"case substring({token}, 1, 1) when '+' then '{kind}_PLUS' when '-' then '{kind}_MINUS'"
            f" else '{kind}_UNSIGNED' end"
        )

    casing = (
        f"case when {token} = lower({token}) then 'BOOLEAN_LOWER' when {token} = upper({token}) then 'BOOLEAN_UPPER'"
        f" when {token} = initcap({token}) then 'BOOLEAN_TITLE' else 'BOOLEAN_OTHER' end"
    )
    zone = (
        f"case when endswith({token}, 'Z') then 'DATETIME_Z' when substring({token}, -6, 1) in ('+', '-')"
        " then 'DATETIME_OFFSET' else 'DATETIME_NO_TIMEZONE' end"
    )
    return (
        f"case when {token} is null then '{NO_FAMILY}'"
        f" when {token} rlike {_regex(LEADING_ZERO_CODE)} then '{LEADING_ZERO}'"
        f" when {token} rlike {_regex(INTEGER_TEXT)} then {signed('INTEGER')}"
        f" when {token} rlike {_regex(FLOAT_TEXT)} then {signed('FLOAT')}"
        f" when {token} rlike {_regex(DATE_TEXT)} then 'DATE_ISO'"
        f" when {token} rlike {_regex(DATETIME_TEXT)} then {zone}"
        f" when {token} rlike {_regex(BOOLEAN_WORD)} then {casing}"
        f" else '{NO_FAMILY}' end"
    )


def is_strict(text: str, token: str, family: str) -> str:
    """Whether the untrimmed text itself has the family's type under the stricter profiling rules,
    which trim nothing and know only true and false as Boolean words."""
    return (
        f"({text} = {token} and {family} <> '{NO_FAMILY}'"
        f" and (not startswith({family}, 'BOOLEAN_') or {token} rlike {_regex(STRICT_BOOLEAN_WORD)}))"
    )
