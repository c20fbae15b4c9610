"""HTML to text as expressions; link targets by RFC 3986."""

from __future__ import annotations

import json
from html.entities import html5
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import let, single_line

#: A tag's inside up to its end; only a value in quotes can hold a closing bracket. Possessive throughout: one pass, no stack.
_INSIDE = r"""(?=[\s/>])(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
#: What is no text: comments; elements whose content is hidden, to their end tag or that of the page; all other tags and declarations.
MARKUP = "(?is)" + "|".join(
    (
        r"<!--.*?--\s*>",
        rf"<(script|style|noscript){_INSIDE}(?<!/)>.*?(?:</\1\s*>|\z)",
        r"""<[a-z][^\s/>]*+(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""",
        r"<[/!?][^>]*+>",
    )
)
#: Names of characters, the commonest first; those that may stand without a semicolon, the longest first.
_COMMON = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;", "copy;", "middot;")
NAMES = {n: html5[n] for n in (*_COMMON, *sorted(html5))}
BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
LOST = "�"


def _windows(code: int) -> str:
    """What pages mean by a control character of the upper half: Windows' character of that byte, where it has one."""
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


def _table(entries: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def _character(code: Column) -> Column:
    """The character of a number, by HTML's rules for those that are none; null numbers are too large."""
    upper = _table({str(c): _windows(c) for c in range(0x80, 0xA0)})
    low = code % 0x10000
    nothing = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (low >= 0xFFFE)
    return (
        F.when(code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), LOST)
        .when(code.between(0x80, 0x9F), F.element_at(upper, code.cast("string")))
        .when(nothing, "")
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    )


def unescape(text: Column) -> Column:
    """Character references, by number or by name, as what they mean; those that mean nothing stay."""
    names = _table(NAMES)

    def reference(part: Column) -> Column:
        """What follows an ampersand, up to the next."""
        digits, hexes = F.regexp_extract(part, "^#([0-9]+)", 1), F.regexp_extract(part, "^#[xX]([0-9a-fA-F]+)", 1)
        numbered = F.regexp_extract(part, "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0)
        # A number of more digits than any character has is too large, whatever it is.
        short = F.regexp_replace(F.when(digits != "", digits).otherwise(hexes), "^0+(?=.)", "")
        code = F.when(F.length(short) > 8, None).when(digits != "", short.cast("long")).otherwise(F.conv(short, 16, 10).cast("long"))
        name = F.regexp_extract(part, r"^[^\t\n\f <&#;]{1,32};?", 0)
        bare = F.regexp_extract(part, f"^(?:{'|'.join(BARE)})", 0)
        after = lambda x: F.substr(part, F.length(x) + 1)
        return (
            F.when(numbered != "", F.concat(_character(code), after(numbered)))
            .when((name != "") & F.map_contains_key(names, name), F.concat(F.element_at(names, name), after(name)))
            .when(bare != "", F.concat(F.element_at(names, bare), after(bare)))
            .otherwise(F.concat(F.lit("&"), part))
        )

    def joined(parts: Column) -> Column:
        rest = F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), reference)
        return F.concat(parts[0], F.array_join(rest, ""))

    return let(F.split(text, "&"), lambda parts: F.when(F.size(parts) > 1, joined(parts)).otherwise(parts[0]))


def html_to_text(html: Column | str) -> Column:
    """Visible text, white space collapsed; null stays null.

    Tags, comments and declarations part words. Scripts, styles and what is for browsers without scripts are hidden, up to their first
    end tag. A bracket that opens no tag, as at the end of a page that was cut off, is text.
    """
    html = F.col(html) if isinstance(html, str) else html
    text = F.regexp_replace(F.regexp_replace(html, MARKUP, " "), "<", " < ")
    return single_line(unescape(text))


@F.arrow_udf(StringType())
def url_join(base: pa.Array, href: pa.Array) -> pa.Array:
    """A link's target by RFC 3986."""
    return pa.array([None if h is None else urljoin(b or "", h) for b, h in zip(base.to_pylist(), href.to_pylist(), strict=True)], pa.string())
