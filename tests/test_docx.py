"""Word documents: made and read again, forms that only other programs make, broken files, odd columns."""

import io
import os
import zipfile

import numpy as np
import pytest
from compare import database, same

from foliospark.plans import QUERIES, SQL
from foliospark.sources import docx

NS = f'xmlns:w="{docx.SPACE_OF_WORDS}"'


def file(body: str, rels: str | None = None, part: str = docx.MAIN_PART) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if rels:
            z.writestr("_rels/.rels", rels)
        z.writestr(part, f"<w:document {NS}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def run(text: str) -> str:
    return f"<w:r><w:t>{text}</w:t></w:r>"


def cell(text: str, properties: str = "") -> str:
    return f"<w:tc><w:tcPr>{properties}</w:tcPr><w:p>{run(text)}</w:p></w:tc>"


def texts(spark, content: bytes):
    return docx.parsed(spark.createDataFrame([(1, bytearray(content))], "id long, content binary")).first()


def test_pieces_of_a_paragraph(spark):
    inner = f"<w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t><w:br w:type='page'/><w:noBreakHyphen/><w:cr/></w:r><w:hyperlink>{run('link')}</w:hyperlink>"
    hidden = f"<w:del>{run('gone')}</w:del><w:r><w:drawing><w:txbxContent><w:p>{run('box')}</w:p></w:txbxContent></w:drawing></w:r>"
    got = texts(spark, file(f"<w:p>{inner}{hidden}</w:p><w:p/><w:p>{run(' &#160; ')}</w:p><w:sdt><w:p>{run('deeper')}</w:p></w:sdt><w:p>{run(' x ')}</w:p>"))
    assert (got.paragraphs, got.tables, got.error) == (["a\tb\nc-\nlink", "x"], [], None)


def test_merged_cells(spark):
    wide, start, on = '<w:gridSpan w:val="2"/>', '<w:vMerge w:val="restart"/>', "<w:vMerge/>"
    rows = [cell("h1", wide) + cell("h3"), cell("a", start) + cell("") + cell("c"), cell("", on) + cell("b") + cell("")]
    skipped = f"<w:tr><w:trPr><w:gridBefore w:val='1'/></w:trPr>{cell('', on)}</w:tr>"
    got = texts(spark, file("<w:tbl>" + "".join(f"<w:tr>{r}</w:tr>" for r in rows) + skipped + "</w:tbl>"))
    assert [(r.row, r.cells) for r in got.tables[0]] == [(0, ["h1", "h1", "h3"]), (1, ["a", "c"]), (2, ["a", "b"]), (3, ["b"])]
    assert got.paragraphs == []


def test_main_part_by_its_link(spark):
    rels = f'<Relationships xmlns="{docx.SPACE_OF_LINKS}"><Relationship Id="a" Type="other" Target="no.xml"/><Relationship Id="b" Type="{docx.MAIN_LINK}" Target="/word/main2.xml"/></Relationships>'
    assert texts(spark, file(f"<w:p>{run('here')}</w:p>", rels, "word/main2.xml")).paragraphs == ["here"]


def test_broken_files_are_rows(spark, tmp_path):
    good = docx._packed(["one", None, " ", "tab\there\nand <&> \x01"], [[["a", None], [None, "b"]]])
    blank = docx._packed([" "], [[[None]]])
    os.makedirs(tmp_path / "deep")
    files = {"good.docx": good, "deep/Upper.DOCX": good, "blank.docx": blank, "empty.docx": b"", "cut.docx": good[:200], "text.docx": b"not a zip", "wrong.docx": file("<w:p>").replace(b"</w:p>", b"</w:q>"), "part.docx": file(f"<w:p>{run('x')}</w:p>", part="other.xml"), "large.docx": os.urandom(5000), "left.doc": good}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {os.path.basename(r.path): r for r in docx.read(spark, str(tmp_path), 4000).collect()}
    assert sorted(got) == sorted(os.path.basename(n) for n in files if n not in ("left.doc", "empty.docx"))
    for name in ("good.docx", "Upper.DOCX"):
        assert (got[name].paragraphs, [[r.cells for r in t] for t in got[name].tables], got[name].error) == (["one", "tab\there\nand <&>"], [[["a"], ["b"]]], None)
    assert got["blank.docx"].error == "no extractable text" and got["large.docx"].error == docx.TOO_LARGE
    assert all(got[n].error and got[n].paragraphs is None for n in files if n not in ("good.docx", "deep/Upper.DOCX", "left.doc", "empty.docx"))


def test_large_parts_and_spans_are_errors(monkeypatch):
    wide = file(f"<w:tbl><w:tr>{cell('x', '<w:gridSpan w:val=' + chr(34) + '1000000000' + chr(34) + '/>')}</w:tr></w:tbl>")
    assert "spans" in docx._one(wide)["error"]
    monkeypatch.setattr(docx, "PART_BYTES", 10)
    assert docx._one(file(f"<w:p>{run('x')}</w:p>"))["error"] == docx.TOO_LARGE
    assert docx._one(None)["error"] == docx.TOO_LARGE


def test_columns_that_clash(spark):
    content = bytearray(docx._packed(["p"], [[["h"], ["v"]]]))
    rows = spark.createDataFrame([(1, "e", "t", 7, "a.b", content), (2, "e", "t", 7, "a.b", None)], "id long, error string, text string, page_num int, `x.y` string, content binary")
    done = docx.parsed(rows)
    assert done.columns == ["id", "text", "page_num", "x.y", "paragraphs", "tables", "error"]
    assert [tuple(r) for r in docx.pages(done).collect()] == [(1, "a.b", 1, "p\n\nh\n\nv", 3, "chunk")]
    assert [(r.id, r.table_num, r.headers, r.rows, r.raw_text) for r in docx.tables(done).collect()] == [(1, 1, ["h"], [["v"]], "h\nv")]
    none = docx.parsed(rows.limit(0))
    assert docx.pages(none).count() == 0 and docx.tables(none).count() == 0


def test_pages_of_3000_code_points(spark):
    long = "ä" * 2999 + "\U0001f600" + "b" * 10
    content = bytearray(docx._packed([long, "c"], []))
    done = docx.pages(docx.parsed(spark.createDataFrame([(1, content)], "id long, content binary"))).collect()
    assert [(r.page_num, r.text, r.words) for r in done] == [(1, long[:3000], 1), (2, "b" * 10 + "\n\nc", 2)]


@pytest.mark.parametrize("name", ["word_pages", "word_tables"])
def test_odd_documents(spark, tmp_path, name):
    """Null, empty and blank texts, repeated rows, blank and null columns."""
    rows = [(1, None, None, None, None), (2, "", "", "s", 0), (3, " \n\n x ", "en", " ", 9), (3, " \n\n x ", "en", " ", 9), (None, "a" * 3000, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.asDict() for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert {r["doc_id"] for r in got} == {None, 1, 2, 3} and len([r for r in got if r["doc_id"] == 3]) == 2


def test_same_as_sql_on_documents(spark, sf_dir):
    con = database(sf_dir)
    assert same(QUERIES["word_pages"](spark, sf_dir), con, SQL["word_pages"]) > 0
    assert same(QUERIES["word_tables"](spark, sf_dir), con, SQL["word_tables"]) > 0


def test_small_files_leave_together():
    small, large = 1000, 5 * docx.TOGETHER
    sizes = np.array([small] * 2000 + [large, large] + [0] * 5 + [small])
    runs = list(docx._runs(sizes))
    assert [i for start, end in runs for i in range(start, end)] == list(range(len(sizes)))
    assert all(start < end and sizes[start + 1 : end].sum() < docx.TOGETHER for start, end in runs)
    assert len(runs) < 20
    assert list(docx._runs(np.array([], np.int64))) == []
