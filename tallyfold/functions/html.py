"""HTML as columns: character references, text of markup, and the references' table.

Character references follow the HTML standard: names with a semicolon from the whole table, the older names without one by
their longest prefix ("&copy2020" is a sign and a year, "&notit;" a negation and "it;"), decimal and hexadecimal numbers;
each ampersand is read once, so "&amp;lt;" becomes "&lt;" and no more. Numbers 0x80 to 0x9F mean Windows-1252, surrogates,
zero and numbers beyond Unicode the replacement character. What is no reference stays as it is.

Markup is cut from left to right by one pattern: comments, scripts and styles with their content, declarations and tags. A
quoted attribute value may hold ">" and any other sign. "<" before anything but a letter, "/", "!" or "?" is text. A tag, a
comment, a script or a style that does not end runs to the end of the page. Null is an empty text.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Attributes up to the end of a tag; every loop is possessive, so long pages need no stack.
_REST = r"""(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+(?:>|\z)"""
MARKUP = rf"(?is)<!--(?:>|->|.*?(?:--!?>|\z))|<(script|style)(?=[\s/>]){_REST}.*?(?:</\1(?=[\s/>]){_REST}|\z)|<[!?][^>]*+(?:>|\z)|</?[a-z]{_REST}|</[^a-z>][^>]*+(?:>|\z)|</>"
#: Older names that need no semicolon have 2 to 6 letters.
SHORT = range(6, 1, -1)
REPLACEMENT = "�"
#: What Windows-1252 has for the numbers 0x80 to 0x9F; the five without a sign stay.
WINDOWS = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)]


def _table(with_semicolon: bool) -> Column:
    """Of the standard library's table: first letter, then name, to characters; folded into one literal by the optimizer."""
    nested: dict[str, dict[str, str]] = {}
    for name, chars in html.entities.html5.items():
        if name.endswith(";") == with_semicolon:
            nested.setdefault(name[0], {})[name] = chars
    return F.from_json(F.lit(json.dumps(nested)), "map<string,map<string,string>>")


def char_of(code: Column) -> Column:
    """The character of a number (long)."""
    bad = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    windows = F.element_at(F.array(*[F.lit(c) for c in WINDOWS]), (code - 0x7F).cast("int"))
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(bad, F.lit(REPLACEMENT)).when(code.between(0x80, 0x9F), windows).otherwise(plain)


def _number(digits: Column, base: int) -> Column:
    """Digits of a number as a long; more than eight significant ones are beyond Unicode in either base."""
    bare = F.ltrim(digits, F.lit("0"))
    return F.when(F.length(bare) > 8, F.lit(0x110000).cast("long")).when(bare == "", F.lit(0).cast("long")).otherwise(F.conv(bare, base, 10).cast("long"))


def once(otherwise: Column, value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used; otherwise: what null gives."""
    return F.coalesce(F.get(F.transform(F.array(value), use), F.lit(0)), otherwise)


def unescaped(text: Column) -> Column:
    """Character references decoded once. Pieces between ampersands are decoded apart: a reference never spans two."""
    full, short = _table(True), _table(False)

    def decoded(piece: Column) -> Column:
        mark = F.regexp_extract(piece, r"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)", 0)
        return once(F.concat(F.lit("&"), piece), mark, lambda m: F.concat(F.when(m == "", F.lit("&")).when(m.startswith("#"), number(m)).otherwise(named(m)), F.substring(piece, F.length(m) + 1, F.length(piece))))

    def number(mark: Column) -> Column:
        digits = F.rtrim(F.substring(mark, 2, 1 << 30), F.lit(";"))
        code = F.when(F.lower(F.substring(digits, 1, 1)) == "x", _number(F.substring(digits, 2, 1 << 30), 16)).otherwise(_number(digits, 10))
        return once(F.lit(REPLACEMENT), code, char_of)

    def named(mark: Column) -> Column:
        """The name's characters, or those of its longest older prefix and the rest, or the name itself."""
        letter = F.substring(mark, 1, 1)
        prefix = once(F.lit(None).cast("string"), F.element_at(short, letter), lambda t: F.coalesce(*[F.when(F.length(mark) >= k, F.concat(F.element_at(t, F.substring(mark, 1, k)), F.substring(mark, k + 1, 1 << 30))) for k in SHORT]))
        return F.coalesce(F.element_at(F.element_at(full, letter), mark), prefix, F.concat(F.lit("&"), mark))

    pieces = F.split(text, "&", -1)
    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), decoded)
    return F.when(F.contains(text, F.lit("&")), F.concat(F.element_at(pieces, 1), F.array_join(rest, ""))).otherwise(text)


def html_to_text(raw: Column) -> Column:
    """Text without markup: a blank in place of each piece, references decoded, lines trimmed, runs of blanks one, at most one
    empty line."""
    out = unescaped(F.regexp_replace(F.coalesce(raw, F.lit("")), MARKUP, " "))
    out = F.regexp_replace(F.replace(out, F.lit("\xa0"), F.lit(" ")), r"[ \t]+", " ")
    # line ends and blanks as text editors know them
    out = F.regexp_replace(out, "\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", "\n")
    out = F.array_join(F.transform(F.split(out, "\n", -1), trimmed), "\n")
    return trimmed(F.regexp_replace(out, "\n{3,}", "\n\n"))


def trimmed(text: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]++|[\s\x1c-\x1f]++\z", "")
