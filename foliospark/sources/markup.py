"""Web pages, Markdown tables, layout boxes, uploaded files and addresses."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.entities import let
from foliospark.functions.strings import stripped

# Elements that go with all that is in them.
DROPPED = ["script", "style", "nav", "footer", "header", "aside", "form"]
# Text that hints at a signature, in the order in which it is looked for.
SIGNATURE_HINTS = ["signature", "signed by", "authorized signatory", "authorised signatory", "sign here", "/s/", "digitally signed"]
# Leading bytes by extension, as hexadecimal; none for plain text.
MAGIC = {".pdf": ["25504446"], ".docx": ["504B0304"], ".xlsx": ["504B0304"], ".png": ["89504E470D0A1A0A"], ".jpg": ["FFD8FF"], ".jpeg": ["FFD8FF"], ".webp": ["52494646"], ".tiff": ["49492A00", "4D4D002A"], ".txt": [], ".csv": [], ".md": [], ".rtf": ["7B5C727466"]}
LARGEST = 50 * 1024 * 1024
# Networks that an outgoing call must not reach, IPv4 as (first, prefix length).
BLOCKED = [("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("127.0.0.0", 8), ("169.254.0.0", 16), ("0.0.0.0", 8), ("100.64.0.0", 10), ("198.18.0.0", 15), ("240.0.0.0", 4)]

# IPv6 networks of the same kind, as (first, prefix length).
BLOCKED_V6 = [("::1", 128), ("fc00::", 7), ("fe80::", 10)]
# Hosts that an outgoing call must not name.
BLOCKED_HOSTS = ["localhost", "localhost.localdomain", "metadata", "metadata.google.internal", "169.254.169.254", "100.100.100.200"]


def page_text(html: Column) -> Column:
    """Visible lines of a page: unwanted elements out, the body's text, lines stripped, blank ones dropped."""
    text = reduce(lambda t, e: F.regexp_replace(t, f"(?is)<{e}\\b[^>]*>.*?</{e}>", " "), DROPPED, html)
    text = F.regexp_replace(F.regexp_replace(text, r"(?is)<head\b[^>]*>.*?</head>", " "), r"(?is)<!--.*?-->", " ")
    lines = F.split(F.regexp_replace(text, r"<[^>]+>", "\n"), r"\n")
    return F.array_join(F.filter(F.transform(lines, stripped), lambda x: x != ""), "\n")


def title(html: Column, url: Column) -> Column:
    t = stripped(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(t == "", url).otherwise(t)


def page_name(name: Column) -> Column:
    return F.concat(F.replace(F.substring(name, 1, 60), F.lit("/"), F.lit("-")), F.lit(".url"))


def signature_hint(text: Column) -> Column:
    """The first hint that a page holds, or null."""
    return F.get(F.filter(F.array(*map(F.lit, SIGNATURE_HINTS)), lambda h: F.contains(F.lower(text), h)), 0)


def box(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """x, y, width, height as fractions of the page; null without a page size."""
    part = lambda v, size: F.round(v / F.nullif(size, F.lit(0.0)), 4)
    return F.when((width > 0) & (height > 0), F.struct(part(left, width).alias("x"), part(top, height).alias("y"), part(right - left, width).alias("width"), part(bottom - top, height).alias("height")))


def upload_error(ext: Column, head: Column, size: Column) -> Column:
    """Why a file is refused, or null. head: its first 16 bytes as hexadecimal."""
    able = F.lit(False)
    for e, marks in MAGIC.items():
        fits = reduce(lambda a, m: a | F.startswith(head, F.lit(m)), marks, F.lit(not marks or e == ".rtf"))
        if e == ".webp":
            fits = fits & (F.substring(head, 17, 8) == "57454250")
        able = F.when(ext == e, fits).otherwise(able)
    return F.when(~ext.isin(list(MAGIC)), "extension").when(size <= 0, "empty").when(size > LARGEST, "too large").when(~able, "content")


def address(ip: Column) -> Column:
    """A dotted IPv4 address as a number; null if it isn't one."""
    value = lambda parts: reduce(lambda a, i: a * 256 + F.get(parts, F.lit(i)).try_cast("long"), range(1, 4), F.get(parts, F.lit(0)).try_cast("long"))
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), let(F.split(ip, r"\."), value))


def network(first: str, length: int) -> tuple[int, int]:
    """First and last address, as numbers."""
    low = int.from_bytes(bytes(map(int, first.split("."))), "big")
    return low, low + (1 << (32 - length)) - 1


def blocked(ip: Column) -> Column:
    return let(address(ip), lambda a: reduce(lambda x, n: x | a.between(*network(*n)), BLOCKED, F.lit(False)))


def address6(ip: Column) -> Column:
    """An IPv6 address, in any spelling and without its zone, as 32 hexadecimal digits; null if it isn't one."""
    def text(plain: Column) -> Column:
        head = F.regexp_extract(plain, r"^(.*:)[^:]*$", 1)
        dotted = lambda last: F.concat(head, F.lower(F.hex(F.shiftright(last, 16))), F.lit(":"), F.lower(F.hex(last.bitwiseAND(F.lit(65535)))))
        return F.coalesce(let(address(F.regexp_extract(plain, r"([^:]*)$", 1)), dotted), plain)

    def groups(sides: Column, n: int) -> Column:
        return F.when(F.coalesce(F.get(sides, F.lit(n)), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.get(sides, F.lit(n)), ":"))

    def filled(x: Column) -> Column:
        gap = 8 - F.size(x["head"]) - F.size(x["tail"])
        fits = ((x["n"] == 2) & (gap > 0)) | ((x["n"] == 1) & (gap == 0))
        return F.when(fits, F.concat(x["head"], F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), x["tail"]))

    def digits(every: Column) -> Column:
        return F.when(F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    # names as literals: beside a generator, aliases that are inside a lambda are lost
    sides = lambda s: F.named_struct(F.lit("n"), F.size(s), F.lit("head"), groups(s, 0), F.lit("tail"), groups(s, 1))
    plain = F.regexp_replace(F.lower(ip), "%.*$", "")
    return let(let(let(F.split(let(plain, text), "::"), sides), filled), digits)


def blocked6(ip: Column) -> Column:
    def within(a: Column, first: str, length: int) -> Column:
        low = int(ipaddress.IPv6Address(first))
        return a.between(f"{low:032x}", f"{low + (1 << (128 - length)) - 1:032x}")

    return F.coalesce(let(address6(ip), lambda a: reduce(lambda x, n: x | within(a, *n), BLOCKED_V6, F.lit(False))), F.lit(False))


def refusal(url: Column) -> Column:
    """Why an outgoing call may not go to a URL, by what it says itself; null where it may. Names aren't looked up."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    named = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))

    def why(x: Column) -> Column:
        scheme, host = x["scheme"], x["host"]
        private = F.when(host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), blocked(host)).otherwise(blocked6(host))
        return F.when(F.coalesce(~scheme.isin("http", "https"), F.lit(True)), "scheme").when(host == "", "host").when(host.isin(BLOCKED_HOSTS), "host name").when(private, "address")

    return let(F.struct(scheme.alias("scheme"), F.regexp_replace(named, r"[\[\]]", "").alias("host")), why)


#: A line with a bar, a line with dashes under it, and the lines with bars that follow.
PIPE_TABLE = r"(?m)^[^|\n]*+\|[^\n]*+\n(?=[^\n]*---)[^\n]*+(?:\n[^|\n]*+\|[^\n]*+)*+"


def pipe_tables(text: Column) -> Column:
    """Array of the pipe tables of a Markdown text: headers, rows (cells stripped, blank ones dropped), raw_text. Tables without
    a header cell or without rows, and blank rows, don't count. Null for a null text."""

    def table(raw: Column) -> Column:
        lines = F.transform(F.split(raw, "\n"), lambda x: F.filter(F.transform(F.split(x, r"\|"), stripped), lambda c: c != ""))
        rows = F.filter(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), lambda r: F.size(r) > 0)
        return F.struct(lines[0].alias("headers"), rows.alias("rows"), raw.alias("raw_text"))

    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(PIPE_TABLE), F.lit(0)), table), lambda t: (F.size(t["headers"]) > 0) & (F.size(t["rows"]) > 0))


def table_rows(text: Column) -> Column:
    """Pipe-table lines of a Markdown text as arrays of cells, without the dashes under the header."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("|")) & ~F.replace(F.translate(F.trim(x), "|:- ", ""), F.lit(" "), F.lit("")).eqNullSafe(""))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))


def cells(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, col, value of each cell of a Markdown table; row 0 is the header."""
    rows = df.select(id_col, F.posexplode(table_rows(F.col(text_col))).alias("row", "c"))
    return rows.select(id_col, "row", F.posexplode("c").alias("col", "value"))
