"""Text: tokens, estimates, excerpts and counts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of letters, digits and a few signs, or runs of ideographs, of two characters or more; longer runs also give their pieces of two to four, from so many characters.
TOKEN = r"[A-Za-z0-9_./+-]{2,}|[一-鿿]{2,}"
PIECES, PIECES_FROM, PIECES_OF = (2, 3, 4), 4, 24
PLACEHOLDER = r"\[[A-Z][a-z]+_[A-Z0-9]+\]"


def tokens(text: Column, most: int | None = None) -> Column:
    """Lower-cased tokens in order, each run of ideographs followed by its pieces; all of them, or the first ``most``."""

    def pieces(token: Column) -> Column:
        run = F.substring(token, 1, PIECES_OF)
        cut = lambda size: F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - (size - 1), F.lit(1))), lambda i: F.substr(run, i, F.lit(size)))
        return F.when(token.rlike("^[一-鿿]{4,}"), F.concat(F.array(token), *map(cut, PIECES))).otherwise(F.array(token))

    found = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 0), lambda t: pieces(F.lower(t))))
    return found if most is None else F.slice(found, 1, most)


#: The same tokens in DuckDB's SQL, of an expression.
def sql_tokens(text: str, most: int | None = None) -> str:
    cut = " || ".join(f"list_transform(range(1, greatest(length(substr(t, 1, {PIECES_OF})) - {size - 1}, 1) + 1), lambda i: substr(substr(t, 1, {PIECES_OF}), i, {size}))" for size in PIECES)
    found = f"flatten(list_transform(list_transform(regexp_extract_all({text}, '{TOKEN}'), lambda t: lower(t)), lambda t: CASE WHEN regexp_matches(t, '^[一-鿿]{{4,}}') THEN [t] || {cut} ELSE [t] END))"
    return found if most is None else f"list_slice({found}, 1, {most})"


def python_tokens(text: str) -> list[str]:
    """The same tokens of one text, for work inside tasks."""
    out = []
    for token in _TOKEN.findall(text):
        token = token.lower()
        out.append(token)
        if token[0] >= "一" and len(token) >= PIECES_FROM:
            run = token[:PIECES_OF]
            out += [run[i : i + size] for size in PIECES for i in range(len(run) - size + 1)]
    return out


_TOKEN = re.compile(TOKEN)


def estimated_tokens(text: Column) -> Column:
    """0 for nothing, else a token for each four characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def chunk_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def excerpt(text: Column, limit: int) -> Column:
    """White space collapsed; longer texts end in three dots within the limit."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("...")))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def occurrences(text: Column, term: str) -> Column:
    """Of a plain string, not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def slices(text: Column, size: int) -> Column:
    """The text in pieces of so many characters."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, (i - 1) * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def joined_parts(*parts: Column) -> Column:
    """Non-empty parts, a line each."""
    return F.concat_ws("\n", *(F.nullif(p, F.lit("")) for p in parts))


def fixed(number: Column, digits: int) -> Column:
    """A number with so many digits (one at least) after the point, as C, Python and SQL print it: the double itself is rounded, ties to even, where ``format_string`` rounds its shortest decimal up."""
    x, scale = F.abs(number), 2 * 10**digits
    wide = x * float(2**27 + 1)
    high = wide - (wide - x)  # the upper half of the bits, so that both products below are exact
    twice = x * float(scale)
    error = (high * float(scale) - twice) + (x - high) * float(scale)
    up = F.floor((twice + 1) / 2)
    n = F.when(twice % 2 != 1, up).when(error < 0, up - 1).when(error > 0, up).otherwise(up - up % 2)
    power = 10**digits
    exact = F.concat(F.when(number < 0, "-").otherwise(""), F.format_string(f"%d.%0{digits}d", F.floor(n / power), n % power))
    return F.when(twice < float(2**52), exact).otherwise(F.format_string(f"%.{digits}f", number))


def starts_path(parent: Column, child: Column) -> Column:
    """Whether an array is a strict prefix of another."""
    return (F.size(child) > F.size(parent)) & (F.slice(child, 1, F.size(parent)) == parent)


def word_occurrences(text: Column, term: str) -> Column:
    """How often a term occurs, whatever the case: a term of ASCII letters and digits only as a whole word."""
    low = term.strip().lower()
    if not low:
        return F.lit(0).cast("long")
    if re.fullmatch(r"[a-z0-9_./+-]+", low):
        return F.regexp_count(F.lower(text), F.lit(rf"(?<![a-z0-9]){re.escape(low)}(?![a-z0-9])")).cast("long")
    return occurrences(F.lower(text), low)


def fallback_vector(text: Column, dimension: int = 64) -> Column:
    """A vector of -1..1 from the bytes of the text's digest, repeated: a stand-in where no embedding model is at hand."""
    byte = lambda digest, i: F.conv(F.substr(digest, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("double")
    places = F.sequence(F.lit(0), F.lit(dimension - 1))
    # the digest is an element of an array, so that it is worked out once a text and not once a place
    return F.transform(F.array(F.sha2(text, 256)), lambda digest: F.transform(places, lambda i: byte(digest, i) / 255.0 * 2 - 1))[0]


def sql_fallback_vector(text: str, dimension: int = 64) -> str:
    digit = lambda at: f"(instr('0123456789abcdef', substr(sha256({text}), {at}, 1)) - 1)"
    return f"list_transform(range(0, {dimension}), lambda i: ({digit('2 * (i % 32) + 1')} * 16 + {digit('2 * (i % 32) + 2')})::DOUBLE / 255.0 * 2 - 1)"
