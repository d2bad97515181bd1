"""Character references of HTML as characters."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body of value, which is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _character(number: Column) -> Column:
    """The character of a numeric reference; 128 to 159 as windows-1252 has them, U+FFFD for what is no character."""
    western = "".join(bytes([i]).decode("cp1252", "replace") for i in range(128, 160))
    able = number.between(0, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    wide = F.decode(F.unhex(F.lpad(F.hex(F.when(able, number).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    return F.when(number.between(128, 159), F.substring(F.lit(western), number.cast("int") - 127, F.lit(1))).otherwise(wide)


def unescaped(text: Column) -> Column:
    """References to characters as characters, with or without a semicolon; an unknown name stays, without its semicolon."""
    names = F.from_json(F.lit(json.dumps({n.rstrip(";"): c for n, c in html5.items()})), "map<string,string>")

    def piece(p: Column) -> Column:
        name = F.regexp_extract(p, "^&([A-Za-z][A-Za-z0-9.-]*+)", 1)
        digits = F.regexp_extract(p, "^&#([0-9]++)", 1)
        hexed = F.regexp_extract(p, "^&#[xX]([0-9a-fA-F]++)", 1)
        far = F.lit(0x110000)
        decimal = F.coalesce(digits.try_cast("bigint"), far)
        sixteen = F.coalesce(F.when(F.length(hexed) <= 12, F.conv(hexed, 16, 10).try_cast("bigint")), far)
        named = F.when(name != "", F.coalesce(F.try_element_at(names, name), F.concat(F.lit("&"), name)))
        return F.when(~F.startswith(p, F.lit("&")), p).otherwise(F.coalesce(named, F.when(digits != "", _character(decimal)), F.when(hexed != "", _character(sixteen)), p))

    pieces = F.regexp_extract_all(text, F.lit(r"&(?:#[0-9]++|#[xX][0-9a-fA-F]++|[A-Za-z][A-Za-z0-9.-]*+);?+|&|[^&]++"), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, piece), "")).otherwise(text)


def decoded(text: Column) -> Column:
    """References to characters as the standard library's html.unescape reads them: the longest known beginning of a name
    counts, an unknown name stays as it is, and numbers of control characters and of no characters go."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    western = "".join(bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(128, 160))
    far = F.lit(0x110000)

    def numbered(n: Column) -> Column:
        control = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127)
        nothing = control | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        out = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        wide = F.decode(F.unhex(F.lpad(F.hex(F.when(out, 0xFFFD).otherwise(n)), 8, "0")), "UTF-32")
        return F.when(n.between(128, 159), F.substring(F.lit(western), n.cast("int") - 127, F.lit(1))).when(~out & nothing, "").otherwise(wide)

    def named(p: Column) -> Column:
        sizes = F.when(F.length(p) > 3, F.sequence(F.length(p) - 1, F.lit(3), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        known = F.get(F.filter(sizes, lambda n: F.try_element_at(names, F.substring(p, F.lit(2), n - 1)).isNotNull()), 0)
        part = known.isNotNull()
        cut = F.concat(F.try_element_at(names, F.substring(p, F.lit(2), known - 1)), F.substring(p, known + 1, F.length(p)))
        return F.coalesce(F.try_element_at(names, F.substring(p, F.lit(2), F.length(p))), F.when(part, cut), p)

    def piece(p: Column) -> Column:
        digits, hexed = F.regexp_extract(p, "^&#([0-9]++)", 1), F.regexp_extract(p, "^&#[xX]0*+([0-9a-fA-F]*+)", 1)
        ten = let(F.coalesce(digits.try_cast("bigint"), far), numbered)
        sixteen = let(F.coalesce(F.when(F.length(hexed) <= 12, F.conv(F.concat(F.lit("0"), hexed), 16, 10).try_cast("bigint")), far), numbered)
        return F.when(~F.startswith(p, F.lit("&")) | (p == "&"), p).when(digits != "", ten).when(F.rlike(p, F.lit("^&#[xX]")), sixteen).otherwise(named(p))

    pieces = F.regexp_extract_all(text, F.lit(r"&(?:#[0-9]++;?+|#[xX][0-9a-fA-F]++;?+|[^\t\n\f <&#;]{1,32}+;?+)|&|[^&]++"), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, piece), "")).otherwise(text)
