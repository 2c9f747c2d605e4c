"""Packages from rows: a sink for conversations or any other turns of text, and the input of the package queries."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The namespaces and content types of the format.
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_A = "http://schemas.openxmlformats.org/drawingml/2006/main"
_WP = "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"
_KIND = "application/vnd.openxmlformats-officedocument.wordprocessingml"
#: Bytes of packages that leave a worker at a time.
BATCH_BYTES = 4 << 20


def _turn(number: int, style: str, text: str) -> str:
    """A paragraph; every third stands in a table, and some have a field, a note, a drawing or a deletion."""
    run = f"<w:r><w:t>{escape(text)}</w:t></w:r>"
    extra = ""
    if number % 4 == 1:
        begin, sep, end = (f'<w:r><w:fldChar w:fldCharType="{k}"/></w:r>' for k in ("begin", "separate", "end"))
        extra += f"{begin}<w:r><w:instrText> PAGEREF t{number - 1} </w:instrText></w:r>{sep}<w:r><w:t>{number}</w:t></w:r>{end}"
    if number % 4 == 2:
        extra += '<w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:r><w:rPr><w:vanish/></w:rPr><w:t>hidden</w:t></w:r><w:ins><w:r><w:t>new</w:t></w:r></w:ins>'
    if number % 4 == 3:
        extra += f'<w:r><w:footnoteReference w:id="{number}"/></w:r><w:r><w:drawing><wp:anchor><wp:positionH relativeFrom="page"><wp:posOffset>{number * 635}</wp:posOffset></wp:positionH><wp:extent cx="{number * 12700}" cy="9525"/><wp:wrapSquare/><a:graphic><a:blip r:embed="rIdPic"/></a:graphic></wp:anchor></w:drawing></w:r>'
    p = f'<w:p><w:pPr><w:pStyle w:val={quoteattr(style)}/></w:pPr><w:bookmarkStart w:id="{number}" w:name="t{number}"/>{run}{extra}<w:bookmarkEnd w:id="{number}"/></w:p>'
    if number % 3 == 2:
        gone = "<w:tr><w:trPr><w:del/></w:trPr><w:tc><w:p><w:r><w:t>row gone</w:t></w:r></w:p></w:tc></w:tr>"
        return f'<w:tbl><w:tblGrid><w:gridCol w:w="{2000 + number}"/></w:tblGrid>{gone}<w:sdt><w:sdtContent><w:tr><w:tc>{p}</w:tc></w:tr></w:sdtContent></w:sdt></w:tbl>'
    return f"<w:sdt><w:sdtContent>{p}</w:sdtContent></w:sdt>" if number % 5 == 4 else p


def write_package(key: int, turns: list[tuple[int, str, str]]) -> bytes:
    """One package with all parts that the reader knows; what they say depends on the key."""
    head = f'xmlns:w="{_W}" xmlns:r="{_R}" xmlns:wp="{_WP}" xmlns:a="{_A}"'
    notes = "".join(f'<w:footnote w:id="{n}"><w:p><w:r><w:t>note {n}</w:t></w:r></w:p></w:footnote>' for n, _, _ in turns if n % 4 == 3)
    levels = "".join(f'<w:lvl w:ilvl="{k}"><w:start w:val="{k + 1}"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%{k + 1}."/></w:lvl>' for k in range(3))
    parts = {
        "document.xml": (f"{_KIND}.document.main+xml", f'<w:document {head}><w:body>{"".join(_turn(*t) for t in turns)}<w:sectPr><w:headerReference w:type="default" r:id="rIdHead"/><w:pgSz w:w="{12000 + key}"/></w:sectPr></w:body></w:document>'),
        "header1.xml": (f"{_KIND}.header+xml", f"<w:hdr {head}><w:p><w:r><w:t>Conversation {key}</w:t></w:r></w:p></w:hdr>"),
        "styles.xml": (f"{_KIND}.styles+xml", f'<w:styles {head}><w:style w:styleId="Normal"><w:rPr><w:sz w:val="{20 + key % 5}"/></w:rPr></w:style><w:style w:styleId="user"><w:basedOn w:val="Normal"/><w:rPr><w:b/></w:rPr></w:style><w:style w:styleId="Normal"><w:rPr><w:sz w:val="99"/></w:rPr></w:style><w:style w:type="numbering" w:styleId="Listed"><w:pPr><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr></w:style></w:styles>'),
        "settings.xml": (f"{_KIND}.settings+xml", f'<w:settings {head}><w:defaultTabStop w:val="{700 + key % 10}"/>{"<w:evenAndOddHeaders/>" if key % 2 else ""}<w:compat><w:compatSetting w:name="compatibilityMode" w:val="{14 + key % 2}"/></w:compat></w:settings>'),
        "theme/theme1.xml": ("application/vnd.openxmlformats-officedocument.theme+xml", f'<a:theme xmlns:a="{_A}"><a:themeElements><a:clrScheme><a:dk1><a:sysClr val="windowText" lastClr="000000"/></a:dk1><a:accent1><a:srgbClr val="{key % 256:02x}aa00"/></a:accent1></a:clrScheme><a:fontScheme><a:majorFont><a:latin typeface="Head {key % 7}"/><a:font script="Jpan" typeface="Mincho"/></a:majorFont><a:minorFont><a:latin typeface="Body {key % 3}"/></a:minorFont></a:fontScheme></a:themeElements></a:theme>'),
        "numbering.xml": (f"{_KIND}.numbering+xml", f'<w:numbering {head}><w:numPicBullet w:numPicBulletId="0"><w:pict r:id="rIdPic"/></w:numPicBullet><w:abstractNum w:abstractNumId="0"><w:nsid w:val="AB"/>{levels}</w:abstractNum><w:abstractNum w:abstractNumId="1"><w:nsid w:val="ab"/><w:lvl w:ilvl="0"><w:start w:val="50"/></w:lvl></w:abstractNum><w:abstractNum w:abstractNumId="2"><w:numStyleLink w:val="Listed"/></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/><w:lvlOverride w:ilvl="1"><w:startOverride w:val="{5 + key % 4}"/></w:lvlOverride></w:num><w:num w:numId="3"><w:abstractNumId w:val="2"/></w:num></w:numbering>'),
        "fontTable.xml": (f"{_KIND}.fontTable+xml", f'<w:fonts {head}><w:font w:name="Head {key % 7}"><w:family w:val="roman"/><w:pitch w:val="variable"/></w:font><w:font w:name="Mono"><w:family w:val="modern"/><w:pitch w:val="fixed"/></w:font></w:fonts>'),
        "footnotes.xml": (f"{_KIND}.footnotes+xml", f'<w:footnotes {head}><w:footnote w:type="separator" w:id="-1"><w:p/></w:footnote>{notes}</w:footnotes>'),
    }
    names = {"styles.xml": "styles", "settings.xml": "settings", "theme/theme1.xml": "theme", "numbering.xml": "numbering", "fontTable.xml": "fontTable", "footnotes.xml": "footnotes"}
    linked = [("rIdHead", "header", "header1.xml"), ("rIdPic", "image", "media/a.png"), *((f"rId{k}", kind, name) for k, (name, kind) in enumerate(names.items()))]
    rels = lambda rows: f'<Relationships xmlns="{_RELS}">' + "".join(f'<Relationship Id="{i}" Type="{_R}/{k}" Target="{t}"/>' for i, k, t in rows) + "</Relationships>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        overrides = "".join(f'<Override PartName="/word/{n}" ContentType="{k}"/>' for n, (k, _) in parts.items())
        files = {"[Content_Types].xml": f'<Types xmlns="{_TYPES}"><Default Extension="png" ContentType="image/png"/>{overrides}</Types>', "_rels/.rels": rels([("rId1", "officeDocument", "word/document.xml")]), "word/_rels/document.xml.rels": rels(linked), "docProps/app.xml": f"<Properties><Pages> {key % 3} </Pages></Properties>", "word/media/a.png": f"picture {key % 10}"}
        for name, text in (files | {f"word/{n}": x for n, (_, x) in parts.items()}).items():
            package.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def packages(turns: DataFrame, key: str, order: str, style: str, text: str) -> DataFrame:
    """path and content: one package for each key, its turns as paragraphs in order. Characters that XML can't hold are left out."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x00-\\x08\\x0B-\\x1F\\uFFFE\\uFFFF]", "")
    kept = turns.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), F.coalesce(style, F.lit("")).alias("s"), clean.alias("t")))).alias("turns"))

    def told(some: list[tuple[str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in some]), pa.array([c for _, c in some], pa.binary())], names=["path", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[tuple[str, bytes]] = []
        size = 0
        for batch in batches:
            for k, own in zip(batch.column(0), batch.column(1), strict=True):
                some.append((f"{k.as_py()}.docx", write_package(k.as_py(), [(x["n"], x["s"], x["t"]) for x in own.as_py()])))
                size += len(some[-1][1])
                if size >= BATCH_BYTES:
                    yield told(some)
                    some, size = [], 0
        if some:
            yield told(some)

    return kept.mapInArrow(run, "path string, content binary")
