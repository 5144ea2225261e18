"""HTML as text columns: tags, attributes, element text.

Patterns use possessive quantifiers so that hostile markup cannot make the
matcher backtrack or recurse deeply.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import let

# Fixed patterns of the markup rules.
INVISIBLE = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<script(?:[\s/][^>]*)?>.*?(?:</script\s*>|\z)"
    r"|<style(?:[\s/][^>]*)?>.*?(?:</style\s*>|\z)"
)
TAG_BODY = r"""(?:[\s/](?:[^"'>]++|"[^"]*+"|'[^']*+')*+)?>"""
ATTRIBUTE = r"""[^\s"'>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
BLOCK_TAG = (
    r"(?i)(</?(?:p|div|ul|ol|li|dl|dt|dd|table|tr|td|th|form|h[1-6]|hr|pre|blockquote|address"
    r"|article|section|nav|header|footer|aside|main|body|html)(?:[\s/>]))"
)
PHP_SPACE = r"^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+\z"
BLOCK_MARK = "\u0001"


def visible_markup(html: Column) -> Column:
    """Markup without comments, scripts and style sheets."""
    return F.regexp_replace(html, INVISIBLE, "")


def strip_space(col: Column) -> Column:
    return F.regexp_replace(col, PHP_SPACE, "")


def decode_entities(col: Column) -> Column:
    """Named (HTML 4) and numeric character references as characters; ``&amp;`` last."""
    # One literal text that Spark folds into a constant map.
    listed = "\u0001".join(f"{n}\u0002{chr(cp)}" for n, cp in sorted(name2codepoint.items()))
    names = F.str_to_map(F.lit(listed), F.lit("\u0001"), F.lit("\u0002"))

    def character(ref: Column) -> Column:
        digits = F.regexp_extract(ref, r"^#(\d{1,7})$", 1)
        hexa = F.regexp_extract(ref, r"^#[xX]([0-9a-fA-F]{1,6})$", 1)
        code = F.coalesce(F.hex(digits.try_cast("int")), F.nullif(hexa, F.lit("")))

        def numeric(hexcode: Column) -> Column:
            # Code points outside Unicode stay as written.
            known = F.conv(hexcode, 16, 10).cast("bigint").between(1, 0x10FFFF)
            return F.when(known, F.decode(F.unhex(F.lpad(hexcode, 8, "0")), "UTF-32"))

        return F.when(ref.startswith("#"), let(code, numeric)).otherwise(F.element_at(names, ref))

    def step(text: Column, ref: Column) -> Column:
        whole = F.concat(F.lit("&"), ref, F.lit(";"))
        return F.replace(text, whole, F.coalesce(character(ref), whole))

    def decoded(text: Column) -> Column:
        refs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&(#?\w+);"), F.lit(1)))
        folded = F.aggregate(F.filter(refs, lambda r: r != "amp"), text, step)
        return F.when(text.contains("&"), F.replace(folded, F.lit("&amp;"), F.lit("&"))).otherwise(text)

    return let(col, decoded)


def start_tags(markup: Column, names: str) -> Column:
    """Array of whole start tags whose name matches the alternation ``names``."""
    return F.regexp_extract_all(markup, F.lit(rf"(?is)<(?:{names}){TAG_BODY}"), F.lit(0))


def tag_is(tag: Column, name: str) -> Column:
    return tag.rlike(rf"(?is)^<{name}[\s/>]")


def attribute(tag: Column, name: str) -> Column:
    """Decoded attribute value of a start tag; blank when absent."""
    pairs = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0))
    wanted = F.filter(pairs, lambda p: p.rlike(rf"(?i)^{name}\s*="))
    first = F.coalesce(F.get(wanted, F.lit(0)), F.lit(""))
    return decode_entities(F.regexp_replace(first, r"""^[^=]*=\s*["']?|["']\z""", ""))


def first_title(markup: Column) -> Column:
    """Trimmed text of the first title element; blank when there is none."""
    inner = F.regexp_extract(markup, r"(?is)<title(?:[\s/][^>]*)?>(.*?)</title\s*>", 1)
    return strip_space(decode_entities(inner))


def paragraphs(markup: Column) -> Column:
    """Array of trimmed paragraph texts; an open paragraph ends at the next block tag."""
    marked = F.regexp_replace(markup, BLOCK_TAG, BLOCK_MARK + "$1")
    pieces = F.filter(F.split(marked, BLOCK_MARK), lambda x: x.rlike(r"(?i)^<p[\s/>]"))
    return F.transform(pieces, lambda x: strip_space(decode_entities(F.regexp_replace(x, r"<[^>]*>", ""))))
