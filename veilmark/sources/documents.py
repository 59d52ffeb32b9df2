"""Word-processor files as texts and back: paragraphs by the standard library's zip and XML readers, in a function over binary files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions import expressions as X
from veilmark.operators import pipeline
from veilmark.operators.pipeline import Settings

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARTS = ("word/document.xml", "word/header", "word/footer")


def _segments(p: ET.Element) -> list[tuple[str, str, ET.Element]]:
    """(kind, text, element) of a paragraph's own text, tabs and breaks, without deleted runs and nested paragraphs."""
    out = []

    def walk(e: ET.Element) -> None:
        for c in e:
            if c.tag == W + "t":
                out.append(("wt", c.text or "", c))
            elif c.tag == W + "tab" and e.tag == W + "r":
                out.append(("tab", "\t", c))
            elif c.tag == W + "cr":
                out.append(("cr", "\r", c))
            elif c.tag == W + "br":
                if c.get(W + "type", "textWrapping") == "textWrapping":
                    out.append(("br", "\n", c))
            elif c.tag not in (W + "del", W + "p", W + "pPr", W + "rPr"):
                walk(c)

    walk(p)
    return out


def _open(data: bytes) -> tuple[zipfile.ZipFile, list[str]]:
    z = zipfile.ZipFile(io.BytesIO(data))
    names = sorted(n for n in z.namelist() if n.startswith(PARTS) and n.endswith(".xml"))
    return z, sorted(names, key=lambda n: (n != PARTS[0], n))


def paragraphs(data: bytes) -> list[list[tuple[str, str]]]:
    """Segments of all paragraphs: the body in order with tables and text boxes, then headers and footers."""
    z, names = _open(data)
    return [[(k, t) for k, t, _ in _segments(p)] for n in names for p in ET.fromstring(z.read(n)).iter(W + "p")]


def docx_text(data: bytes) -> str:
    return "\n".join("".join(t for _, t in p) for p in paragraphs(data))


def _rewritten(data: bytes, change: Callable[[list[ET.Element]], None]) -> bytes:
    """The file with its paragraphs, in the order of paragraphs(), changed by a function."""
    z, names = _open(data)
    roots = {n: ET.fromstring(z.read(n)) for n in names}
    change([p for n in names for p in roots[n].iter(W + "p")])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for item in z.infolist():
            body = ET.tostring(roots[item.filename], encoding="UTF-8", xml_declaration=True) if item.filename in roots else z.read(item.filename)
            new.writestr(item, body)
    return out.getvalue()


def replace_in_docx(data: bytes, pairs: list[tuple[str, str]]) -> bytes:
    """Every literal of `pairs` (old, new), the longest old first, replaced within paragraphs, also across runs: the first run takes the new text.

    A literal with line feeds that stands in no paragraph is looked for over neighbouring ones.
    """
    pairs = sorted((p for p in pairs if p[0]), key=lambda p: (-len(p[0]), p[0]))

    def change(ps: list[ET.Element]) -> None:
        for old, new in pairs:
            inside = [_occurrences(p, old) for p in ps]
            if "\n" in old and not any(inside):
                _replace_over(ps, old.split("\n"), new)
            for p, starts in zip(ps, inside):
                for start in reversed(starts):
                    _put(p, start, start + len(old), new)

    return _rewritten(data, change)


def replace_places(data: bytes, places: dict[int, list[tuple[int, int, str]]]) -> bytes:
    """The characters from start to end of the numbered paragraphs replaced; places don't overlap."""

    def change(ps: list[ET.Element]) -> None:
        for para, spans in places.items():
            for start, end, new in sorted(spans, reverse=True):
                _put(ps[para], start, end, new)

    return _rewritten(data, change)


def _whole(p: ET.Element) -> str:
    return "".join(t for _, t, _ in _segments(p))


def _occurrences(p: ET.Element, old: str) -> list[int]:
    whole, starts = _whole(p), []
    at = whole.find(old)
    while at >= 0:
        starts.append(at)
        at = whole.find(old, at + len(old))
    return starts


def _put(p: ET.Element, start: int, end: int, new: str) -> None:
    """The first text element of the place takes the new text, others lose theirs; tabs and breaks inside go. At a place without a text element, one is made."""
    parents = {c: e for e in p.iter() for c in e}
    base, put = 0, False
    for kind, text, e in _segments(p):
        lo = base
        base += len(text)
        a, b = max(start, lo), min(end, base)
        if a >= b:
            continue
        if kind == "wt":
            e.text = text[: a - lo] + ("" if put else new) + text[b - lo :]
            e.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
            put = True
        elif put or not new:
            parents[e].remove(e)
        else:
            e.tag, e.text, put = W + "t", new, True
            e.attrib.clear()


def _replace_over(ps: list[ET.Element], parts: list[str], new: str) -> None:
    """Parts over neighbouring paragraphs: the first ends one, the middle ones are whole, the last begins one. The place of the first takes the new text."""
    k = 0
    while k + len(parts) <= len(ps):
        texts = [_whole(p) for p in ps[k : k + len(parts)]]
        if texts[0].endswith(parts[0]) and texts[1:-1] == parts[1:-1] and texts[-1].startswith(parts[-1]) and (parts[0] or parts[-1]):
            _put(ps[k], len(texts[0]) - len(parts[0]), len(texts[0]), new)
            for p, part in zip(ps[k + 1 : k + len(parts)], parts[1:]):
                _put(p, 0, len(part), "")
            k += len(parts) - 1
        else:
            k += 1


def docx_files(spark: SparkSession, path: str) -> DataFrame:
    """path, doc_id, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path)
    return files.select("path", F.xxhash64("path").alias("doc_id"), "content")


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """path, doc_id, para, text of docx_files(); a file that can't be read has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, doc, data in zip(b["path"], b["doc_id"], b["content"]):
                try:
                    rows += [(path, doc, k, "".join(t for _, t in p)) for k, p in enumerate(paragraphs(bytes(data)))]
                except (zipfile.BadZipFile, ET.ParseError, KeyError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "doc_id", "para", "text"])

    return files.select("path", "doc_id", "content").mapInPandas(run, "path string, doc_id bigint, para int, text string")


def anonymise_docx(files: DataFrame, how: Settings = Settings()) -> DataFrame:
    """path, doc_id, content (the new file) and mapping of docx_files().

    Entities are found by paragraph; numbers run over the whole document, by paragraph and inside one from right to left.
    """
    found = pipeline.detect(docx_paragraphs(files), how).select("doc_id", "para", F.explode(F.filter("spans", lambda s: F.coalesce(s.verified, F.lit(False)))).alias("s"))
    order = "array_sort(collect_list(struct(para, -s.start as back, s)))"
    of_doc = found.groupBy("doc_id").agg(F.expr(order).alias("places"))
    # The place in this order is what numbering goes by.
    in_order = "transform(places, (p, i) -> named_struct('start', i, 'end', i + 1, 'type', p.s.type, 'text', p.s.text, 'score', p.s.score, 'verified', true, 'reason', p.s.reason, 'pattern', p.s.pattern))"
    numbered = of_doc.withColumn("numbered", F.expr(X.held(X.family_numbers(in_order, how.prefix))))
    numbered = numbered.select("doc_id", F.expr(X.mapping_of("numbered")).alias("mapping"), F.expr("zip_with(places, numbered, (p, n) -> named_struct('para', p.para, 'start', p.s.start, 'end', p.s.end, 'new', n.placeholder))").alias("put"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            new = []
            for data, put in zip(b["content"], b["put"]):
                places: dict[int, list[tuple[int, int, str]]] = {}
                for x in put if put is not None else ():
                    places.setdefault(x["para"], []).append((x["start"], x["end"], x["new"]))
                new.append(replace_places(bytes(data), places) if places else bytes(data))
            yield pd.DataFrame({"path": b["path"], "doc_id": b["doc_id"], "content": new, "mapping": b["mapping"]})

    rows = files.join(numbered, "doc_id", "left").select("path", "doc_id", "content", "put", F.coalesce("mapping", F.expr("cast(map() as map<string, string>)")).alias("mapping"))
    return rows.mapInPandas(run, "path string, doc_id bigint, content binary, mapping map<string, string>")


def replaced_docx(files: DataFrame, mapping_col: str = "mapping", restore: bool = False) -> DataFrame:
    """path, doc_id, content with the values of a stored mapping replaced by their placeholders, or with `restore` the other way round."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = [list((m or {}).items()) if isinstance(m, dict) or m is None else list(m) for m in b["mapping"]]
            new = [replace_in_docx(bytes(d), m if restore else [(v, k) for k, v in m]) for d, m in zip(b["content"], pairs)]
            yield pd.DataFrame({"path": b["path"], "doc_id": b["doc_id"], "content": new})

    return files.select("path", "doc_id", "content", F.col(mapping_col).alias("mapping")).mapInPandas(run, "path string, doc_id bigint, content binary")


def docx_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, doc_id, text: a row a file; a file that can't be read has a null text."""
    files = docx_files(spark, path)
    texts = docx_paragraphs(files).groupBy("doc_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(para, text))), p -> p.text), '\n')").alias("text"))
    return files.select("path", "doc_id").join(texts, "doc_id", "left").select("path", "doc_id", "text")


def docx_segments(spark: SparkSession, path: str) -> DataFrame:
    """path, para, seg, kind, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i, j, k, t) for p, data in zip(b["path"], b["content"]) for i, segs in enumerate(paragraphs(bytes(data))) for j, (k, t) in enumerate(segs)]
            yield pd.DataFrame(rows, columns=["path", "para", "seg", "kind", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, para int, seg int, kind string, text string")


def to_html(data: bytes) -> str:
    """Paragraphs as HTML: headings 1 to 4, bold, italic and underlined runs, escaped."""
    import html

    z, names = _open(data)
    out = []
    for p in ET.fromstring(z.read(names[0])).iter(W + "p"):
        style = p.find(f"{W}pPr/{W}pStyle")
        name = (style.get(W + "val", "") if style is not None else "").lower()
        level = next((n for n in "1234" if name == f"heading{n}"), None)
        runs = []
        for r in p.iter(W + "r"):
            text = html.escape("".join(t for _, t, _ in _segments(r))).replace("\n", "<br>")
            for mark, tag in (("u", "u"), ("i", "i"), ("b", "b")):
                on = r.find(f"{W}rPr/{W}{mark}")
                if text and on is not None and on.get(W + "val", "1") not in ("0", "false", "none"):
                    text = f"<{tag}>{text}</{tag}>"
            runs.append(text)
        tag = f"h{level}" if level else "p"
        out.append(f"<{tag}>{''.join(runs)}</{tag}>")
    return "\n".join(out)


def line_styles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line_no, style, content: a line that begins with # is a heading of that level (4 at most), an upper-case line under 100 characters is heading 2."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "l"))
    t = F.trim("l")
    marks = F.length(F.regexp_extract(t, "^(#*)", 1))
    style = F.when(t == "", "blank").when(marks > 0, F.concat(F.lit("heading"), F.least(marks, F.lit(4)))).when((F.length(t) < 100) & (F.upper(t) == t) & t.rlike("\\p{L}"), "heading2").otherwise("body")
    return lines.select(id_col, "line_no", style.alias("style"), F.md5(F.when(marks > 0, F.trim(F.regexp_replace(t, "^#+", ""))).otherwise(t)).alias("digest"))
