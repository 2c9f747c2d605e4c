"""Word-processing packages (ZIP of XML parts) as tables of ordered blocks and runs."""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
import zlib
from collections.abc import Collection, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The namespaces of the format.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_RELS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
_WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_V = "{urn:schemas-microsoft-com:vml}"
_TYPES = "{http://schemas.openxmlformats.org/package/2006/content-types}"
_MAIN = "/officeDocument"
#: Bytes of an unpacked part at most.
MOST_PART_BYTES = 256 << 20
#: Rows and characters of values that leave a worker at a time.
BATCH_ROWS, BATCH_CHARS = 5000, 4 << 20

ROWS = "path string, kind string, part string, ord long, parent string, level int, name string, value string, digest string"


def _row(path: str, kind: str, part: str, ord_: int, parent: str, level: int, name: str, value: str | None, digest: str | None = None) -> dict:
    return dict(zip(("path", "kind", "part", "ord", "parent", "level", "name", "value", "digest"), (path, kind, part, ord_, parent, level, name, value, digest), strict=True))


def _properties(element: ElementTree.Element | None) -> str:
    """Only what is declared, one key per element and attribute; an element without attributes is 'true'."""
    out: dict[str, str] = {}
    for child in element if element is not None else ():
        name = child.tag.rpartition("}")[2]
        if child.attrib:
            out.update({f"{name}.{k.rpartition('}')[2]}": v for k, v in child.attrib.items()})
        elif not len(child):
            out[name] = "true"
    return json.dumps(out, sort_keys=True)


def _run_text(run: ElementTree.Element) -> str:
    # Elements that stand for one character.
    marks = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "‑", "softHyphen": "­"}
    out = []
    for child in run:
        name = child.tag.rpartition("}")[2]
        out.append((child.text or "") if name == "t" else marks.get(name, ""))
    return "".join(out)


def _children(element: ElementTree.Element, wanted: str) -> Iterator[ElementTree.Element]:
    """Children of a kind, through content controls and insertions."""
    for child in element:
        name = child.tag.rpartition("}")[2]
        if name == wanted:
            yield child
        elif name in ("sdt", "sdtContent", "ins", "customXml"):
            yield from _children(child, wanted)


class _Fields:
    """Open complex fields of a story: begin, instruction, separate, cached result, end; they nest and may span paragraphs."""

    def __init__(self) -> None:
        self.open: list[dict] = []
        self.found = 0

    def run(self, run: ElementTree.Element) -> Iterator[dict]:
        """Feed one run; fields that end in it."""
        for node in run:
            name = node.tag.rpartition("}")[2]
            if name == "fldChar":
                kind = node.get(f"{_W}fldCharType")
                if kind == "begin":
                    self.found += 1
                    self.open.append({"n": self.found, "instr": "", "result": "", "separated": False, "depth": len(self.open)})
                elif kind == "separate" and self.open:
                    self.open[-1]["separated"] = True
                elif kind == "end" and self.open:
                    yield self.open.pop()
            elif name == "instrText" and self.open and not self.open[-1]["separated"]:
                self.open[-1]["instr"] += node.text or ""

    def take(self, text: str) -> bool:
        """Whether a run's text is shown; it is also added to the results it is part of."""
        for f in self.open:
            if f["separated"]:
                f["result"] += text
        return all(f["separated"] for f in self.open)


def _paragraph(path: str, part: str, child: ElementTree.Element, own: str, level: int, number: int, fields: _Fields) -> Iterator[dict]:
    style = child.find(f"{_W}pPr/{_W}pStyle")
    digest = hashlib.sha256(ElementTree.tostring(child)).hexdigest()
    yield _row(path, "paragraph", part, number, own, level, style.get(f"{_W}val", "") if style is not None else "", _properties(child.find(f"{_W}pPr")), digest)
    if child.find(f"{_W}pPr/{_W}sectPr") is not None:
        yield _row(path, "section_end", part, number, own, level, "", _properties(child.find(f"{_W}pPr/{_W}sectPr")))
    runs = 0
    stack = list(reversed(list(child)))
    while stack:
        node = stack.pop()
        kind = node.tag.rpartition("}")[2]
        if kind == "r":
            runs += 1
            hidden = node.find(f"{_W}rPr/{_W}vanish")
            text = _run_text(node)
            shown = fields.take(text)
            for f in fields.run(node):
                yield _row(path, "field", part, f["n"], own, f["depth"], f["instr"].strip(), f["result"])
            if shown and text and (hidden is None or hidden.get(f"{_W}val") in ("0", "false", "off")):
                yield _row(path, "run", part, runs, own, level, _properties(node.find(f"{_W}rPr")), text)
            for note in (*node.iter(f"{_W}footnoteReference"), *node.iter(f"{_W}endnoteReference")):
                yield _row(path, "note_reference", part, runs, own, level, note.tag.rpartition("}")[2][:-9], note.get(f"{_W}id"))
            yield from _graphics(path, part, node, own, runs)
        elif kind in ("bookmarkStart", "bookmarkEnd"):
            yield _row(path, kind, part, runs, own, level, node.get(f"{_W}id", ""), node.get(f"{_W}name"))
        elif kind == "fldSimple":
            fields.found += 1
            text = "".join(_run_text(r) for r in node.iter(f"{_W}r"))
            yield _row(path, "field", part, fields.found, own, len(fields.open), (node.get(f"{_W}instr") or "").strip(), text)
        if kind in ("ins", "hyperlink", "smartTag", "sdt", "sdtContent", "fldSimple", "moveTo"):
            stack += list(reversed(list(node)))


def _graphics(path: str, part: str, run: ElementTree.Element, own: str, number: int) -> Iterator[dict]:
    """Frames of drawings (the first alternative holds) and of legacy shapes: extents and offsets in English metric units or as stated."""
    seen = []
    for alternative in run.findall(f"{_MC}AlternateContent"):
        choice = alternative.find(f"{_MC}Choice")
        seen.append(choice if choice is not None else alternative.find(f"{_MC}Fallback"))
    for holder in (run, *(s for s in seen if s is not None)):
        for drawing in holder.findall(f"{_W}drawing"):
            for frame in drawing:
                extent, blip = frame.find(f"{_WP}extent"), next(frame.iter(f"{_A}blip"), None)
                out = {"cx": extent.get("cx") if extent is not None else None, "cy": extent.get("cy") if extent is not None else None, "picture": blip.get(f"{_R}embed") if blip is not None else None}
                for axis in ("positionH", "positionV"):
                    at = frame.find(f"{_WP}{axis}")
                    if at is not None:
                        out[axis] = at.get("relativeFrom")
                        out |= {f"{axis}.{x.tag.rpartition('}')[2]}": x.text for x in at}
                wrap = next((x.tag.rpartition("}")[2] for x in frame if x.tag.rpartition("}")[2].startswith("wrap")), None)
                yield _row(path, "drawing", part, number, own, 0, frame.tag.rpartition("}")[2], json.dumps(out | {"wrap": wrap}, sort_keys=True))
        for picture in holder.findall(f"{_W}pict"):
            for shape in picture.iter(f"{_V}shape"):
                css = dict(x.split(":", 1) for x in (shape.get("style") or "").split(";") if ":" in x)
                yield _row(path, "shape", part, number, own, 0, shape.get("id", ""), json.dumps({k.strip(): v.strip() for k, v in css.items()}, sort_keys=True))


def _blocks(path: str, part: str, parent: ElementTree.Element, at: str, level: int, count: list[int], fields: _Fields) -> Iterator[dict]:
    """Paragraphs and tables in document order, through content controls; insertions are kept, deleted runs, rows and cells dropped."""
    seen: dict[str, int] = {}
    for child in parent:
        name = child.tag.rpartition("}")[2]
        seen[name] = seen.get(name, 0) + 1
        own = f"{at}/{name}[{seen[name]}]"
        if name == "p":
            count[0] += 1
            yield from _paragraph(path, part, child, own, level, count[0], fields)
        elif name == "tbl":
            count[0] += 1
            yield _row(path, "table", part, count[0], own, level, "", _properties(child.find(f"{_W}tblPr")))
            for g, column in enumerate(child.findall(f"{_W}tblGrid/{_W}gridCol"), 1):
                yield _row(path, "grid_column", part, g, own, level, "", column.get(f"{_W}w"))
            rows = (row for row in _children(child, "tr") if row.find(f"{_W}trPr/{_W}del") is None)
            for r, row in enumerate(rows, 1):
                cells = (cell for cell in _children(row, "tc") if cell.find(f"{_W}tcPr/{_W}cellDel") is None)
                for c, cell in enumerate(cells, 1):
                    here = f"{own}/tr[{r}]/tc[{c}]"
                    yield _row(path, "cell", part, c, here, level + 1, str(r), _properties(cell.find(f"{_W}tcPr")))
                    yield from _blocks(path, part, cell, here, level + 1, count, fields)
        elif name in ("sdt", "sdtContent", "ins", "customXml"):
            yield from _blocks(path, part, child, own, level, count, fields)


def _val(element: ElementTree.Element | None, path: str, attribute: str = "val") -> str | None:
    found = element.find(path) if element is not None else None
    return found.get(f"{_W}{attribute}") if found is not None else None


def _level(element: ElementTree.Element) -> dict[str, str | None]:
    """A list level's start, format, text, restart and legal numbering as stated."""
    out = {name: _val(element, f"{_W}{tag}") for name, tag in (("start", "start"), ("format", "numFmt"), ("text", "lvlText"), ("restart", "lvlRestart"), ("picture", "lvlPicBulletId"))}
    return out | {"legal": "true" if element.find(f"{_W}isLgl") is not None else None}


def _numbering(path: str, part: str, root: ElementTree.Element) -> Iterator[dict]:
    """Definitions, their levels, instances and overrides as stated; ``lists`` resolves them."""
    for k, element in enumerate(root.findall(f"{_W}abstractNum")):
        id_ = element.get(f"{_W}abstractNumId", "")
        yield _row(path, "list_definition", part, k, _val(element, f"{_W}numStyleLink") or "", 0, id_, _val(element, f"{_W}nsid"))
        for level in element.findall(f"{_W}lvl"):
            yield _row(path, "list_level", part, k, id_, int(level.get(f"{_W}ilvl", "0")), "", json.dumps(_level(level), sort_keys=True))
    for k, element in enumerate(root.findall(f"{_W}num")):
        id_ = element.get(f"{_W}numId", "")
        yield _row(path, "list_instance", part, k, _val(element, f"{_W}abstractNumId") or "", 0, id_, None)
        for override in element.findall(f"{_W}lvlOverride"):
            level = override.find(f"{_W}lvl")
            stated = _level(level) if level is not None else {}
            yield _row(path, "list_override", part, k, id_, int(override.get(f"{_W}ilvl", "0")), "level" if level is not None else "start", json.dumps(stated | {"override": _val(override, f"{_W}startOverride")}, sort_keys=True))
    for element in root.findall(f"{_W}numPicBullet"):
        data = next((x for x in element.iter() if x.get(f"{_R}id") or x.get(f"{_R}embed")), None)
        yield _row(path, "bullet", part, 0, "", 0, element.get(f"{_W}numPicBulletId", ""), (data.get(f"{_R}id") or data.get(f"{_R}embed")) if data is not None else None)


def _theme(path: str, part: str, root: ElementTree.Element) -> Iterator[dict]:
    """Fonts by scheme and script, and colours by slot (a system colour by its last value)."""
    for scheme in ("majorFont", "minorFont"):
        fonts = root.find(f"{_A}themeElements/{_A}fontScheme/{_A}{scheme}")
        for font in fonts if fonts is not None else ():
            script = font.get("script") or font.tag.rpartition("}")[2]
            yield _row(path, "theme_font", part, 0, scheme, 0, script, font.get("typeface") or "")
    for slot in root.find(f"{_A}themeElements/{_A}clrScheme") or ():
        for colour in slot:
            value = colour.get("val") if colour.tag == f"{_A}srgbClr" else colour.get("lastClr")
            if value:
                yield _row(path, "theme_color", part, 0, "", 0, slot.tag.rpartition("}")[2], value.upper())


def _settings(path: str, part: str, root: ElementTree.Element) -> Iterator[dict]:
    """The settings that can change what is laid out, as stated; an element without a value is 'true'."""
    for name in ("defaultTabStop", "evenAndOddHeaders", "autoHyphenation", "consecutiveHyphenLimit", "hyphenationZone", "doNotHyphenateCaps"):
        element = root.find(f"{_W}{name}")
        if element is not None:
            yield _row(path, "setting", part, 0, "", 0, name, element.get(f"{_W}val", "true"))
    for name in ("themeFontLang", "clrSchemeMapping"):
        for key, value in (root.find(f"{_W}{name}").attrib if root.find(f"{_W}{name}") is not None else {}).items():
            yield _row(path, "setting", part, 0, name, 0, key.rpartition("}")[2], value)
    for option in root.find(f"{_W}compat") if root.find(f"{_W}compat") is not None else ():
        name = option.tag.rpartition("}")[2]
        yield _row(path, "setting", part, 0, "compat", 0, option.get(f"{_W}name", name) if name == "compatSetting" else name, option.get(f"{_W}val", "true"))


def _relationships(package: zipfile.ZipFile, part: str) -> list[tuple[str, str, str, str]]:
    folder, _, name = part.rpartition("/")
    where = f"{folder}/_rels/{name}.rels".lstrip("/")
    if where not in package.namelist():
        return []
    return [(r.get("Id", ""), r.get("Type", ""), r.get("Target", ""), r.get("TargetMode", "Internal")) for r in ElementTree.fromstring(_read(package, where)).iter(f"{_RELS}Relationship")]


def _read(package: zipfile.ZipFile, name: str) -> bytes:
    size = package.getinfo(name).file_size
    if size > MOST_PART_BYTES:
        raise ValueError(f"{name} has {size} bytes")
    return package.read(name)


def read_package(path: str, content: bytes) -> Iterator[dict]:
    """Tagged rows of one package; a broken one gives one row of kind 'error' after what could be read, and the rest of the table goes on.

    A part of more than MOST_PART_BYTES unpacked is an error too. An empty or null content is a broken package.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as package:
            names = sorted(package.namelist())
            types: dict[str, str] = {}
            if "[Content_Types].xml" in names:
                stated = ElementTree.fromstring(_read(package, "[Content_Types].xml"))
                kinds = {d.get("Extension", "").lower(): d.get("ContentType", "") for d in stated.iter(f"{_TYPES}Default")}
                own = {o.get("PartName", "").lstrip("/"): o.get("ContentType", "") for o in stated.iter(f"{_TYPES}Override")}
                types = {n: own.get(n) or kinds.get(n.rpartition(".")[2].lower(), "") for n in names}
            for name in names:
                yield _row(path, "part", name, 0, "", 0, name, types.get(name), hashlib.sha256(_read(package, name)).hexdigest())
            roots = _relationships(package, "")
            main = next((t.lstrip("/") for _, kind, t, _ in roots if kind.endswith(_MAIN)), "word/document.xml")
            folder = main.rpartition("/")[0]
            near = lambda target: target.lstrip("/") if target.startswith("/") else f"{folder}/{target}".lstrip("/")
            linked = _relationships(package, main)
            for id_, kind, target, mode in [*roots, *linked]:
                yield _row(path, "relationship", main, 0, mode, 0, id_, target, kind)
                if kind.endswith("/image") and near(target) in names:
                    yield _row(path, "picture", near(target), 0, main, 0, id_, types.get(near(target)), hashlib.sha256(_read(package, near(target))).hexdigest())
            body = ElementTree.fromstring(_read(package, main)).find(f"{_W}body")
            count = [0]
            if body is not None:
                yield from _blocks(path, main, body, "/body", 0, count, _Fields())
                last = body.find(f"{_W}sectPr")
                if last is not None:
                    yield _row(path, "section_end", main, count[0], "/body", 0, "", _properties(last))
                    for reference in last:
                        if reference.get(f"{_R}id"):
                            yield _row(path, "story_reference", main, count[0], reference.tag.rpartition("}")[2][:-9], 0, reference.get(f"{_W}type", "default"), reference.get(f"{_R}id"))
            for id_, kind, target, _ in linked:
                if kind.endswith(("/header", "/footer")) and near(target) in names:
                    yield from _blocks(path, near(target), ElementTree.fromstring(_read(package, near(target))), f"/{id_}", 0, [0], _Fields())
            # Parts by their relationship, else where they usually lie.
            usual = {"styles": "styles.xml", "settings": "settings.xml", "theme": "theme/theme1.xml", "numbering": "numbering.xml", "fontTable": "fontTable.xml", "footnotes": "footnotes.xml", "endnotes": "endnotes.xml"}
            parts = {kind: near(target) for kind, target in usual.items() if near(target) in names}
            parts |= {kind.rpartition("/")[2]: near(target) for _, kind, target, _ in reversed(linked) if near(target) in names}
            of = lambda kind: ElementTree.fromstring(_read(package, parts[kind])) if kind in parts else None
            for kind, read in (("settings", _settings), ("theme", _theme), ("numbering", _numbering)):
                if kind in parts:
                    yield from read(path, parts[kind], of(kind))
            for font in of("fontTable") if "fontTable" in parts else ():
                yield _row(path, "font", parts["fontTable"], 0, _val(font, f"{_W}pitch") or "", 0, font.get(f"{_W}name", ""), _val(font, f"{_W}family"))
            seen: set[str] = set()
            for k, style in enumerate(of("styles").findall(f"{_W}style") if "styles" in parts else ()):
                id_ = style.get(f"{_W}styleId", "")
                if id_ not in seen:  # the first of equal ids holds
                    seen.add(id_)
                    yield _row(path, "style", parts["styles"], k, _val(style, f"{_W}basedOn") or "", 0, id_, json.dumps(json.loads(_properties(style.find(f"{_W}pPr/{_W}numPr"))) | json.loads(_properties(style.find(f"{_W}rPr"))), sort_keys=True), style.get(f"{_W}type", "paragraph"))
            for story in ("footnotes", "endnotes"):
                for k, note in enumerate(of(story) if story in parts else ()):
                    yield _row(path, story[:-1], parts[story], k, note.get(f"{_W}type", "normal"), 0, note.get(f"{_W}id", ""), "".join(_run_text(r) for r in note.iter(f"{_W}r")))
            if "docProps/app.xml" in names:
                pages = re.search(rb"<Pages>\s*([0-9]{1,9})\s*</Pages>", _read(package, "docProps/app.xml"))
                if pages and int(pages[1]):
                    yield _row(path, "pages", "docProps/app.xml", 0, "", 0, "", str(int(pages[1])))
    except (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, KeyError, RuntimeError, ValueError, OSError, EOFError, NotImplementedError) as error:
        yield _row(path, "error", "", 0, "", 0, type(error).__name__, str(error))


def scan_contents(files: DataFrame, kinds: Collection[str] | None = None) -> DataFrame:
    """Packages (path, content) as rows of ROWS: one pass over each, split by ``kind`` afterwards.

    ``kinds``: only rows of these leave the worker. A package at a time is unpacked, and rows of many go in a batch of at most
    BATCH_ROWS rows and about BATCH_CHARS characters, so a worker's memory doesn't grow with the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("path", pa.string()), ("kind", pa.string()), ("part", pa.string()), ("ord", pa.int64()), ("parent", pa.string()), ("level", pa.int32()), ("name", pa.string()), ("value", pa.string()), ("digest", pa.string())])
        some: list[dict] = []
        size = 0
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                for row in read_package(path.as_py(), content.as_py()):
                    if kinds is None or row["kind"] in kinds:
                        some.append(row)
                        size += len(row["value"] or "")
                        if len(some) >= BATCH_ROWS or size >= BATCH_CHARS:
                            yield pa.RecordBatch.from_pylist(some, schema=kind)
                            some, size = [], 0
        if some:
            yield pa.RecordBatch.from_pylist(some, schema=kind)

    return files.select("path", "content").mapInArrow(run, ROWS)


def scan_packages(spark: SparkSession, folder: str) -> DataFrame:
    """All packages below a folder, see ``scan_contents``."""
    return scan_contents(spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(folder))


def lists(rows: DataFrame) -> DataFrame:
    """path, list, instance, level and the level's start, format, text, restart, legal and override.

    Definitions of one nsid are the first of them. A style link takes the levels of the definition under the numbering style's
    instance. An override replaces a level or its start; ``list`` is the definition whose counts the instance shares.
    """
    own = rows.where("kind = 'list_definition'").select("path", "ord", F.col("name").alias("definition"), F.upper(F.nullif("value", F.lit(""))).alias("nsid"), F.nullif("parent", F.lit("")).alias("link"))
    first = own.groupBy("path", F.coalesce("nsid", F.concat(F.lit("/"), "definition")).alias("same")).agg(F.min(F.struct("ord", "definition", "link")).alias("first"))
    canonical = own.withColumn("same", F.coalesce("nsid", F.concat(F.lit("/"), "definition"))).join(first, ["path", "same"]).select("path", "definition", F.col("first.definition").alias("list"), F.col("first.link").alias("link"))
    instances = rows.where("kind = 'list_instance'").select("path", F.col("name").alias("instance"), F.col("parent").alias("definition")).join(canonical, ["path", "definition"]).drop("definition")
    # A linked numbering style names an instance, whose definition has the levels.
    styles = rows.where("kind = 'style'").select("path", F.col("name").alias("link"), F.get_json_object("value", "$['numId.val']").alias("target"))
    targets = instances.select("path", F.col("instance").alias("target"), F.col("list").alias("linked"))
    instances = instances.join(styles.join(targets, ["path", "target"]).drop("target"), ["path", "link"], "left").withColumn("source", F.coalesce("linked", "list"))
    told = lambda c: F.get_json_object("value", f"$.{c}").alias(c)
    columns = ("start", "format", "text", "restart", "legal")
    levels = rows.where("kind = 'list_level'").select("path", F.col("parent").alias("source"), "level", *map(told, columns))
    changes = rows.where("kind = 'list_override'").select("path", F.col("parent").alias("instance"), "level", (F.col("name") == "level").alias("whole"), told("override"), *(told(c).alias(f"new_{c}") for c in columns))
    base = instances.join(levels, ["path", "source"])
    out = base.join(changes, ["path", "instance", "level"], "left")
    pick = lambda c: F.when(F.coalesce("whole", F.lit(False)), F.col(f"new_{c}")).otherwise(F.coalesce("override", c) if c == "start" else F.col(c)).alias(c)
    return out.select("path", "list", "instance", "level", *map(pick, columns), "override")


def paragraphs(rows: DataFrame) -> DataFrame:
    """path, ord, parent, style and text of every paragraph, runs in order."""
    runs = rows.where("kind = 'run'").groupBy("path", "parent").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), "").alias("text"))
    own = rows.where("kind = 'paragraph'").select("path", "ord", "parent", F.col("name").alias("style"), "digest")
    return own.join(runs, ["path", "parent"], "left").withColumn("text", F.coalesce("text", F.lit("")))
