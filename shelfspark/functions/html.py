"""Visible text, title and links of rendered HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.strings import strip

#: HTML entity names for U+00A0..U+00FF in code point order.
LATIN1_ENTITIES = """
nbsp iexcl cent pound curren yen brvbar sect uml copy ordf laquo not shy reg macr
deg plusmn sup2 sup3 acute micro para middot cedil sup1 ordm raquo frac14 frac12 frac34 iquest
Agrave Aacute Acirc Atilde Auml Aring AElig Ccedil Egrave Eacute Ecirc Euml Igrave Iacute Icirc Iuml
ETH Ntilde Ograve Oacute Ocirc Otilde Ouml times Oslash Ugrave Uacute Ucirc Uuml Yacute THORN szlig
agrave aacute acirc atilde auml aring aelig ccedil egrave eacute ecirc euml igrave iacute icirc iuml
eth ntilde ograve oacute ocirc otilde ouml divide oslash ugrave uacute ucirc uuml yacute thorn yuml
""".split()

#: Further entity names in common use.
OTHER_ENTITIES = {
    "amp": "&",
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "ndash": "–",
    "mdash": "—",
    "lsquo": "‘",
    "rsquo": "’",
    "ldquo": "“",
    "rdquo": "”",
    "bull": "•",
    "hellip": "…",
    "trade": "™",
    "euro": "€",
}

ENTITIES = {name: chr(0xA0 + i) for i, name in enumerate(LATIN1_ENTITIES)} | OTHER_ENTITIES

#: Names that are also read without their semicolon.
OPEN_ENTITIES = sorted([*LATIN1_ENTITIES, "amp", "lt", "gt", "quot"], key=lambda n: (-len(n), n))

#: Numbers in the C1 range stand for the characters that Windows-1252 has there.
C1_CHARS = {i: bytes([i]).decode("cp1252") for i in range(0x80, 0xA0) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}

_NUMBER = r"#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?"
_NAMED = r"[A-Za-z]+[0-9]*+;"
_OPEN = "(?:" + "|".join(OPEN_ENTITIES) + ")"
#: References in text, and in an attribute's value, where `&copy=` is the start of a parameter.
_ENTITY = rf"&({_NUMBER}|{_NAMED}|{_OPEN})"
_ATTR_ENTITY = rf"&({_NUMBER}|{_NAMED}|{_OPEN}(?![=A-Za-z0-9]))"

# One pattern reads a page into markup tokens, in page order: comments, elements whose
# content isn't markup (as a whole), tags, declarations. Quotes count in an attribute's
# value only, and may hold `>`.
_ATTR = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+"""
_ATTRS = rf"(?:[\s/]++|{_ATTR})*+"
# Without the `<` that all of them begin with.
_COMMENT = r"!--.*?-->"
_TAG = rf"/?+[A-Za-z][^\s/>]*+{_ATTRS}>|[!?/][^>]*+>"


def _whole(names: str, group: int = 1) -> str:
    """Elements that end at their own end tag only, whatever stands inside."""
    return rf"({names})(?=[\s/>]){_ATTRS}>.*?(?:</\{group}(?=[\s/>])[^>]*+>|\z)"


#: Elements that aren't shown, and further ones whose content is text.
_UNSEEN = "script|style|template"
_TEXT_ONLY = "textarea|title|noscript|iframe|noembed|noframes|xmp"
_MARKUP = rf"(?is)<(?:{_COMMENT}|{_whole(_UNSEEN)}|{_TAG})"
#: The second group holds the attributes of an anchor, and is empty in all other tokens.
_ANCHOR = rf"(?is)<(?:{_COMMENT}|{_whole(_UNSEEN + '|' + _TEXT_ONLY)}|a(?=[\s/])({_ATTRS})>|{_TAG})"
#: The first href among an anchor's attributes, with its quotes.
_HREF = rf"""(?is)^(?:[\s/]++|(?!href[\s/>=]){_ATTR})*+href\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
#: Titles in there are not the document's.
_NOT_HEAD = rf"(?is)<(?:{_COMMENT}|{_whole(_UNSEEN + '|svg|body')})"
_TITLE = rf"(?is)<title(?=[\s/>]){_ATTRS}>(.*?)</title(?=[\s/>])[^>]*+>"


def _decode_one(reference: Column, names: Column, c1: Column) -> Column:
    name = F.rtrim(reference, F.lit(";"))
    code = F.when(
        name.rlike("^#[xX]"), F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10)
    ).when(name.startswith("#"), F.substring(name, F.lit(2), F.length(name)))
    number = code.try_cast("int")
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(
        number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF), F.coalesce(F.try_element_at(c1, number), char)
    ).otherwise(F.coalesce(F.try_element_at(names, name), F.concat(F.lit("&"), reference)))


def decode_entities(c: Column, pattern: str = _ENTITY) -> Column:
    """Replace character references in one pass, so nothing is decoded twice."""
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    c1 = F.create_map(*[F.lit(x) for pair in C1_CHARS.items() for x in pair])
    found = F.regexp_extract_all(c, F.lit(pattern), 1)
    decoded = F.concat(F.transform(found, lambda n: _decode_one(n, names, c1)), F.array(F.lit("")))
    merged = F.array_join(F.zip_with(F.split(c, pattern, -1), decoded, lambda text, ch: F.concat(text, ch)), "")
    return F.when(c.contains("&") & c.rlike(pattern), merged).otherwise(c)


def html_to_text(c: Column) -> Column:
    """Visible strings, each stripped, empty ones dropped, joined by line breaks.

    Strings end where a tag or comment stands; script, style and template bodies
    are not visible.
    """
    strings = F.transform(F.split(c, _MARKUP, -1), lambda s: strip(decode_entities(s)))
    return F.array_join(F.filter(strings, lambda s: s != ""), "\n")


def html_title(c: Column) -> Column:
    """The head's title with its whitespace collapsed, as a browser reports it; '' if there is none."""
    raw = F.regexp_extract(F.regexp_replace(c, _NOT_HEAD, ""), _TITLE, 1)
    return F.trim(F.regexp_replace(decode_entities(raw), r"[\t\n\f\r ]+", " "))


def links(c: Column, inside: str = "/p/") -> Column:
    """Hrefs of anchors that start with `/` and contain ``inside``, in page order.

    Values may be quoted, unquoted, or follow other attributes that hold `>`; what
    stands in a script, a comment or another element of plain text is no anchor.
    """
    anchors = F.filter(F.regexp_extract_all(c, F.lit(_ANCHOR), 2), lambda a: a != "")
    quoted = F.transform(anchors, lambda a: F.regexp_extract(a, _HREF, 1))
    bare = F.transform(quoted, lambda v: F.regexp_replace(v, r"""(?s)^(["'])(.*)\1$""", "$2"))
    hrefs = F.transform(bare, lambda h: decode_entities(h, _ATTR_ENTITY))
    return F.filter(hrefs, lambda h: h.startswith("/") & h.contains(inside))
