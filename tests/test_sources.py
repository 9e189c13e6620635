import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from loomtext.sources import docx, text

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def python_units(t):
    return [(2 * (i // 2), p) for i, p in enumerate(re.split(r"(\r?\n(?:[ \t]*\r?\n)+)", t)) if i % 2 == 0 and p]


def test_text_scan_and_rebuild(spark):
    random.seed(2)
    texts = ["a\n\nb", "\n\na\n \n\nb", "  \n\n", "x", "a\r\n\r\nb\n\n"] + ["".join(random.choice("ab \n\r\t") for _ in range(25)) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000, None), (1001, "")], "doc_id long, text string")
    got = {}
    for r in text.scan_units(df).orderBy("doc_id", "ord").collect():
        got.setdefault(r["doc_id"], []).append((r["ord"], r["segments"][0]))
        assert r["unit_id"] == f"text-{r['ord']}"
    assert got == {i: u for i, t in enumerate(texts) if (u := python_units(t))}
    back = {r["doc_id"]: r["text"] for r in text.rebuild(text.scan_parts(df), text.scan_units(df)).collect()}
    assert back == {i: t for i, t in enumerate(texts) if t}
    upper = text.scan_units(df).withColumn("segments", F.transform("segments", F.upper))
    assert text.rebuild(text.scan_parts(df), upper).where("doc_id = 0").first()["text"] == "A\n\nB"
    assert text.rebuild(text.scan_parts(df), upper.where("false")).where("doc_id = 0").first()["text"] == "\n\n"


def package(document, extra=None, drop=()):
    parts = {"[Content_Types].xml": "<Types/>", "_rels/.rels": "<Relationships/>", "word/document.xml": document, **(extra or {})}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in parts.items():
            if k not in drop:
                z.writestr(k, v)
    return out.getvalue()


BODY = f"""<w:document {W}><w:body>
<w:p><w:r><w:t>Plain </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:hyperlink><w:r><w:t> link</w:t></w:r></w:hyperlink></w:p>
<w:p><w:r><w:t> </w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:pPr><w:jc w:val="left"/></w:pPr><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
<w:p><w:r><w:t>outer</w:t><w:pict><w:txbxContent><w:p><w:r><w:t>inner</w:t></w:r></w:p></w:txbxContent></w:pict></w:r></w:p>
</w:body></w:document>"""


def test_docx(spark, tmp_path):
    note = f"<w:footnotes {W}><w:footnote><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>"
    (tmp_path / "a.docx").write_bytes(package(BODY, {"word/footnotes.xml": note, "word/styles.xml": "<x/>"}))
    (tmp_path / "b.docx").write_bytes(package(BODY, drop=("_rels/.rels",)))
    (tmp_path / "c.docx").write_bytes(b"no zip")
    (tmp_path / "d.docx").write_bytes(package("<!DOCTYPE x [<!ENTITY e 'e'>]>" + BODY))
    (tmp_path / "e.docx").write_bytes(package(BODY, {"word/media/x.bin": b"\0" * (3 << 20)}))
    rows = docx.scan_docx(spark, str(tmp_path)).orderBy("path", "ord").collect()
    good = [r for r in rows if r["error"] is None]
    assert [(r["unit_id"], r["segments"], r["protected"]) for r in good] == [("docx-0", ["Plain ", "bold", " link"], [1, 2]), ("docx-1", ["cell"], []), ("docx-2", ["outer"], []), ("docx-3", ["inner"], []), ("docx-4", ["note"], [])]
    assert [r["path"][-6] for r in rows if r["error"]] == ["b", "c", "d", "e"]

    path = str(tmp_path / "a.docx")
    url = good[0]["path"]
    new = spark.createDataFrame([(url, "docx-0", ["متن ", "پررنگ", " پیوند"]), (url, "docx-1", ["خانه"])], "path string, unit_id string, segments array<string>")
    built = docx.build_docx(spark, path, new, "fa", "Vazir").first()
    assert built["error"] is None
    again = [u[1] for u in docx.units_of(bytes(built["content"]))]
    assert again == [["متن ", "پررنگ", " پیوند"], ["خانه"], ["outer"], ["inner"], ["note"]]
    xml = zipfile.ZipFile(io.BytesIO(bytes(built["content"]))).read("word/document.xml").decode()
    assert "bidiVisual" in xml and "fa-IR" in xml and 'val="right"' in xml and "preserve" in xml and "Vazir" in xml


def test_wrong_number_of_segments_keeps_the_text():
    data = package(BODY)
    out = docx.write_back(data, {"docx-0": ["one"]}, "en")
    assert next(iter(docx.units_of(out)))[1] == ["Plain ", "bold", " link"]


def test_pdf_needs_its_library(spark, tmp_path):
    pdf = pytest.importorskip("loomtext.sources.pdf")
    try:
        import fitz  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            pdf.scan_pdf(spark, str(tmp_path))
