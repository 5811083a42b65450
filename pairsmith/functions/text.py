"""Text columns: markup removal, tokens, templates."""

import html.entities
import json

from pyspark.sql import Column, functions as F, types as T

from pairsmith.functions.keyed import let

# The white space that a plain Python split removes.
WHITE_SPACE = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WORD = r"\p{L}[\p{L}\p{N}_-]*|\p{N}+|[^\s\p{L}\p{N}]"
SENTINEL_OR_WORD = r"<extra_id_[0-9]+>|" + WORD

INVISIBLE_MARKUP = r"(?is)<!--.*?-->|<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>"
TAG = r"</?[A-Za-z!?][^>]*>"


def _entity_names() -> Column:
    """Every named character reference of HTML that ends in a semicolon, from Python's own table, as one literal map."""
    names = {name: text for name, text in html.entities.html5.items() if name.endswith(";")}
    return F.from_json(F.lit(json.dumps(names)), T.MapType(T.StringType(), T.StringType()))


def unescaped(text: Column) -> Column:
    """Named and numeric character references as characters, each decoded once; unknown names stay."""

    def decoded(piece):
        body = F.regexp_extract(piece, r"^&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        number = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 6), 16, 10)).otherwise(F.substring(body, 2, 7)).cast("long")
        usable = ((number > 0) & (number < 0xD800)) | ((number > 0xDFFF) & (number <= 0x10FFFF))
        by_number = F.when(usable, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("\ufffd")
        found = F.when(body.startswith("#"), by_number).otherwise(F.try_element_at(_entity_names(), F.concat(body, F.lit(";"))))
        return F.when(body == "", piece).otherwise(F.coalesce(F.concat(found, F.substr(piece, F.length(body) + 3)), piece))

    pieces = F.split(text, "(?=&)")
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, decoded), "")).otherwise(text)


def html_to_text(markup: Column) -> Column:
    """Text nodes joined without a separator; comments, scripts and styles are left out."""
    stripped = F.regexp_replace(F.regexp_replace(markup, INVISIBLE_MARKUP, ""), TAG, "")
    return let(stripped, unescaped)  # which uses its input several times


def ws_tokens(text: Column) -> Column:
    return F.filter(F.split(text, WHITE_SPACE + "+"), lambda t: t != "")


def word_tokens(text: Column) -> Column:
    """Words, numbers and single marks, in order."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def masked_tokens(text: Column) -> Column:
    """``word_tokens`` that keeps sentinels whole."""
    return F.regexp_extract_all(text, F.lit(SENTINEL_OR_WORD), F.lit(0))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def first_present(prefer: str = "code_tokens") -> Column:
    """The code tokens under either of the two field names; ``prefer`` wins."""
    other = {"code_tokens": "function_tokens", "function_tokens": "code_tokens"}[prefer]
    return F.coalesce(F.col(prefer), F.col(other))


def joined_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def title_and_text(title: Column, body: Column) -> Column:
    """The product template; a missing title or body is empty."""
    return F.concat(F.lit("title : "), F.coalesce(title, F.lit("")), F.lit(" text : "), F.coalesce(body, F.lit("")))


def php_source(code: Column, language: Column) -> Column:
    return F.when(language == "php", F.concat(F.lit("<?php "), code, F.lit(" ?>"))).otherwise(code)
