import io
import zipfile

import pytest
from pyspark.sql import functions as F

from foliant.operators import tagged
from foliant.sources import files


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_csv_delimiters_encodings_and_trimming():
    assert files.csv_rows("이름;값\n가; 1 ;\n;;\n".encode("cp949")) == [["이름", "값"], ["가", "1"]]
    assert files.csv_rows(b"\xef\xbb\xbfa,b\n1\n") == [["a", "b"], ["1", ""]]
    assert files.csv_rows(b"") == [] and files.csv_rows(b"x\ty\n") == [["x", "y"]]


def test_xlsx():
    sheet = '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>b</t></is></c></row><row r="2"><c r="A2"><v>100</v></c><c r="B2" t="b"><v>1</v></c></row></sheetData></worksheet>'
    content = zipped(**{"xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S1" r:id="x1"/><sheet name="S2" r:id="x2"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="x1" Target="worksheets/s1.xml"/><Relationship Id="x2" Target="/xl/worksheets/s2.xml"/></Relationships>', "xl/sharedStrings.xml": "<sst><si><t>a</t></si></sst>", "xl/worksheets/s1.xml": sheet, "xl/worksheets/s2.xml": "<worksheet><sheetData/></worksheet>"})
    assert files.xlsx_sheets(content) == [("S1", [["a", "b"], ["100", "TRUE"]])]
    assert files.sheets_text(files.xlsx_sheets(content)) == "S1\na b\n100 TRUE"


def test_hwpx_sections_in_order_and_tables():
    section = lambda t: f'<sec xmlns:h="h"><h:p><h:run><h:t>{t}</h:t></h:run></h:p></sec>'
    content = zipped(**{"Contents/section10.xml": section("ten"), "Contents/section2.xml": section("two"), "Contents/section0.xml": '<sec><p><tbl><tr><tc><cellSpan colSpan="2" rowSpan="1"/><t>a</t></tc></tr></tbl></p></sec>'})
    assert files.hwpx_text(content).endswith("two\nten")
    assert files.hwpx_tables(content) == ['<table><tr><td colspan="2">a</td></tr></table>']
    assert files.hwpx_text(zipped(**{"Preview/PrvText.txt": "seen"})) == "seen"


def test_docx_pptx_and_entities():
    assert files.docx_text(zipped(**{"word/document.xml": "<d><p><r><t>one</t></r></p><p/><p><t>two</t></p></d>"})) == "one\ntwo"
    slides = {f"ppt/slides/slide{n}.xml": f"<s><p><t>s{n}</t></p></s>" for n in (10, 2)}
    assert files.pptx_text(zipped(**slides)) == "s2\n\ns10"
    with pytest.raises(ValueError):
        files.docx_text(zipped(**{"word/document.xml": '<!DOCTYPE x [<!ENTITY e "v">]><d>&e;</d>'}))


def test_scan_skips_hidden_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_bytes(b"a,b\n")
    (tmp_path / "sub" / "b.csv").write_bytes(b"%PDF")
    (tmp_path / ".hidden.csv").write_bytes(b"x")
    got = {r.path.rpartition("/")[2]: r.kind for r in files.scan(spark, str(tmp_path), "*.csv").select("path", files.kind_of(F.col("content")).alias("kind")).collect()}
    assert got == {"a.csv": None, "b.csv": "pdf"}


def test_blocks_of_tagged_text():
    text = f"{tagged.SOURCE}a.pdf\n{tagged.PAGES}1\n{tagged.RULE}\n\n## Page 1\n\nhello\n\n- one\n- two\n\n[[TABLE]]\n<table></table>\n[[/TABLE]]\n\n[[TABLE_MARKDOWN]]\n| a |\n[[/TABLE_MARKDOWN]]\n[[IMAGE]]\nseen\n[[/IMAGE]]"
    assert tagged.blocks(text) == [("header", "## Page 1"), ("paragraph", "hello"), ("list", "- one\n- two"), ("table", "<table></table>"), ("image", "seen")]
    assert tagged.blocks("원본 파일 경로: x\n-----\nhi") == [("paragraph", "hi")] and tagged.blocks("") == []
