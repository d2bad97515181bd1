"""Main content of web pages: tags are folded over a stack of open elements, inside DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.entities import let as _let
from foliospark.functions.entities import unescaped
from foliospark.functions.strings import SPACE
from foliospark.functions.strings import stripped as trimmed
from foliospark.sources.markup import DROPPED

# Elements without an end tag.
VOID = ["area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr"]
# Where the text of a page is looked for, first hit first; else it is the whole page.
MAIN = ["article", "main", "body"]
#: Code points of a page of text.
PAGE = 3000

_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
#: A comment, a script or style with all that is in it, a declaration, a tag, or text up to one of these.
TOKEN = rf"(?is)<!--.*?(?:-->|\z)|<(script|style)\b{_ATTRIBUTES}>(?<!/>).*?(?:</\1\s*+>|\z)|<[!?][^>]*+(?:>|\z)|</?[a-z]{_ATTRIBUTES}(?:>|\z)|</[^>]*+(?:>|\z)|(?:[^<]++|<(?![a-z/!?]))++"
#: Line ends of any script, as a pattern.
LINE = r"\r\n|[\n-\r\x1c-\x1e\x85  ]"


def _read(token: Column) -> Column:
    """name of a tag (empty for all else), whether it opens or closes an element, and text."""
    name = F.lower(F.regexp_extract(token, r"^</?([A-Za-z][^\s/>]*+)", 1))
    tag = F.startswith(token, F.lit("<")) & (name != "") & ~F.rlike(token, F.lit(r"(?i)^<(?:script|style)\b"))
    ends = F.startswith(token, F.lit("</"))
    alone = name.isin(VOID) | F.endswith(token, F.lit("/>"))
    text = F.when(~F.rlike(token, F.lit("^<[A-Za-z/!?]")), token)
    return F.struct(F.when(tag, name).otherwise("").alias("name"), (tag & ~ends & ~alone).alias("opens"), (tag & ends).alias("closes"), text.alias("text"))


def _step(s: Column, x: Column) -> Column:
    """One tag or text. The stack is a text of names, each with a slash behind it: the last open element of a name, and all
    opened after it, go by substring_index; bytes are counted, which takes no scan. A mark is the stack's length where its element began; what the stack has fallen
    back to has ended. Marks: 0 never begun, -1 ended; for dropped elements 0 is outside."""
    size = F.octet_length(s["stack"])
    inside = F.when(s["dropped"] >= size, 0).otherwise(s["dropped"])
    after = F.call_function("substring_index", s["stack"], F.concat(F.lit("/"), x["name"], F.lit("/")), F.lit(-1))
    popped = _let(after, lambda a: F.when(a == s["stack"], s["stack"]).otherwise(F.substring(s["stack"].cast("binary"), F.lit(1), size - F.octet_length(a) - F.octet_length(x["name"]) - 1).cast("string")))
    now = {m: F.when(s[m] >= size, -1).otherwise(s[m]) for m in [*MAIN, "title"]}
    seen = F.struct(x["text"].alias("text"), *((v > 0).alias(m) for m, v in now.items()))
    return F.struct(
        F.when(x["opens"], F.concat(s["stack"], x["name"], F.lit("/"))).when(x["closes"], popped).otherwise(s["stack"]).alias("stack"),
        F.when((inside == 0) & x["opens"] & x["name"].isin([*DROPPED, "template"]), size).otherwise(inside).alias("dropped"),
        *(F.when((v == 0) & (inside == 0) & x["opens"] & (x["name"] == m), size).otherwise(v).alias(m) for m, v in now.items()),
        F.when(x["text"].isNotNull() & (inside == 0), F.array_append(s["out"], seen)).otherwise(s["out"]).alias("out"),
    )


def folded(html: Column) -> Column:
    """All texts outside dropped elements, each with the main elements around it, and which of these the page has.

    Tokens go in blocks of about the root of their number, so that lists grow by blocks: time is in proportion to
    the number of tokens times its root, and to the depth of open elements.
    """
    marks = [F.lit(0).alias(m) for m in [*MAIN, "title"]]
    none = F.array().cast(f"array<struct<text:string,{','.join(m + ':boolean' for m in [*MAIN, 'title'])}>>")
    begin = F.struct(F.lit("/").alias("stack"), F.lit(0).alias("dropped"), *marks, none.alias("out"))
    kept = ["stack", "dropped", *MAIN, "title"]

    def block(s: Column, b: Column) -> Column:
        inner = F.aggregate(F.transform(b, _read), F.struct(*(s[k].alias(k) for k in kept), none.alias("out")), _step)
        return _let(inner, lambda i: F.struct(*(i[k].alias(k) for k in kept), F.array_append(s["out"], i["out"]).alias("out")))

    def run(tokens: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(tokens) + 1)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(tokens) / size).cast("int")), lambda i: F.slice(tokens, i * size + 1, size))
        outer = F.struct(*(begin[k].alias(k) for k in kept), F.array().cast(f"array<array<struct<text:string,{','.join(m + ':boolean' for m in [*MAIN, 'title'])}>>>").alias("out"))
        return F.aggregate(blocks, outer, block)

    return _let(_let(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0)), run), lambda s: F.struct(F.flatten(s["out"]).alias("texts"), *((s[m] != 0).alias(m) for m in MAIN)))


def contents(df: DataFrame, html: str = "html", url: str = "url", out: str = "content") -> DataFrame:
    """df with a struct of title and text.

    Elements in DROPPED go with all that is nested in them, as do templates, comments and declarations. An end tag closes the
    last open element of its name with all that was opened after it, and nothing if there is none; elements that are never
    closed last to the end. The text is that of the first article, else of the first main element, else of the body, else of
    all: stripped lines without blank ones. title: the only text of the first title element, else the URL. A null page has
    neither; an empty page has its URL and an empty text.
    """
    page = _let(folded(F.col(html)), lambda p: F.struct(p.alias("p"), *(p[m].alias(m) for m in MAIN)))

    def text(s: Column) -> Column:
        p = s["p"]
        wanted = F.filter(p["texts"], lambda t: F.when(p["article"], t["article"]).when(p["main"], t["main"]).when(p["body"], t["body"]).otherwise(True))
        lines = F.flatten(F.transform(wanted, lambda t: F.split(unescaped(t["text"]), LINE)))
        return F.array_join(F.filter(F.transform(lines, trimmed), lambda x: x != ""), "\n")

    def title(s: Column) -> Column:
        texts = F.filter(s["p"]["texts"], lambda t: t["title"])
        return F.when(F.size(texts) == 1, trimmed(unescaped(F.get(texts, 0)["text"]))).otherwise(F.col(url))

    found = _let(page, lambda s: F.struct(title(s).alias("title"), text(s).alias("text")))
    return df.withColumn(out, F.when(F.col(html).isNotNull(), found))


def paged(text: Column, size: int = PAGE) -> Column:
    """Array of pages: page_num from 1, text, words. Every size code points make a page, stripped; blank ones don't count."""
    parts = F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), trimmed), lambda p: p != "")
    return F.transform(parts, lambda p, i: F.struct((i + 1).alias("page_num"), p.alias("text"), F.size(F.split(p, f"[{SPACE}]++")).alias("words")))
