"""Markup that needs a parser: HTML tables, nested JSON blocks, model answers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CELLS = "array<struct<row int, col int, rowspan int, colspan int, header boolean, text string>>"


#: To what the HTML standard clamps the spans of a cell.
MOST_ROWS, MOST_COLUMNS = 65534, 1000


class _Table(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells: list[dict] = []
        self.row, self.open = -1, None
        #: the first row in which a column is free again
        self.free: dict[int, int] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self.row += 1
        elif tag in ("td", "th"):
            self.handle_endtag("td")
            a = dict(attrs)
            span = lambda k: max(1, int(v)) if (v := (a.get(k) or "1").strip()).isdigit() else 1
            r, c = max(0, self.row), 0
            while self.free.get(c, 0) > r:
                c += 1
            self.open = {"row": r, "col": c, "rowspan": min(span("rowspan"), MOST_ROWS), "colspan": min(span("colspan"), MOST_COLUMNS), "header": tag == "th", "text": ""}
            for j in range(c, c + self.open["colspan"]):
                self.free[j] = max(self.free.get(j, 0), r + self.open["rowspan"])
        elif tag == "br" and self.open:
            self.open["text"] += " "

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table") and self.open:
            self.open["text"] = " ".join(self.open["text"].split())
            self.cells.append(self.open)
            self.open = None

    def handle_data(self, data: str) -> None:
        if self.open:
            self.open["text"] += data


def table_cells(html: str | None) -> list[dict]:
    if not html or "<" not in html:
        return []
    p = _Table()
    p.feed(html)
    p.handle_endtag("table")
    return p.cells


def batched(f, kind: str, c: Column | str) -> Column:
    """f over a column in Arrow batches; made when used, since a type needs a session to be parsed."""
    return F.pandas_udf(lambda s: s.map(f), kind)(F.col(c) if isinstance(c, str) else c)


def html_table(html: Column | str) -> Column:
    """Cells of HTML tables with their grid position; null and tagless texts give []."""
    return batched(table_cells, CELLS, html)


#: Keys of a layout block's parts, in the order they are tried (fixed values).
PARTS = ("caption", "footnote", "html", "body", "math", "image")
SPAN_KEYS = ("content", "text", "value", "latex")
NESTED_KEYS = ("caption", "content", "blocks", "paragraphs")
PART_KEYS = {
    ("table", "caption"): ("caption", "table_caption", "table_caption_text"),
    ("image", "caption"): ("caption", "image_caption", "img_caption", "figure_caption"),
    ("table", "footnote"): ("footnote", "table_footnote", "table_note"),
    ("image", "footnote"): ("footnote", "image_footnote", "img_footnote", "figure_footnote"),
}
BODY_KEYS, MATH_KEYS, IMAGE_KEYS = ("table_body", "body", "text"), ("latex", "text", "math"), ("img_path", "image_path", "path")


def plain(value: object) -> str:
    """A string with single blanks; empty for anything else."""
    return " ".join(value.split()) if isinstance(value, str) else ""


def block_text(value: object) -> str:
    """Text of a nested layout block: its own text, else that of its lines and their spans, else of its nested parts."""
    if isinstance(value, list):
        return " ".join(filter(None, map(block_text, value)))
    if not isinstance(value, dict):
        return plain(value)
    if own := plain(value.get("text")):
        return own
    lines = [x for x in value.get("lines") or () if isinstance(x, dict)] if isinstance(value.get("lines"), list) else []
    found = []
    for line in lines:
        spans = [x for x in line.get("spans") or () if isinstance(x, dict)] if isinstance(line.get("spans"), list) else []
        found += [plain(line.get("text")), *(plain(next((x[k] for k in SPAN_KEYS if x.get(k)), "")) for x in spans)]
    return " ".join(filter(None, found)) or " ".join(filter(None, (block_text(value[k]) for k in NESTED_KEYS if k in value)))


def first_part(sources: list[dict], keys: tuple[str, ...], read: Callable[[object], str]) -> str:
    return next((t for source in sources for k in keys if (t := read(source.get(k)))), "")


def block_parts(block: str | None, supplement: str | None, kind: str | None) -> dict[str, str | None]:
    """caption, footnote, html, body, math and image of a layout block, each from the block before its supplement.

    kind is table or image. A table's body is given as text, else the text of its markup, else the block's own.
    """

    def parsed(x: str | None) -> dict:
        try:
            got = json.loads(x) if x else {}
        except ValueError:
            got = {}
        return got if isinstance(got, dict) else {}

    own, other = parsed(block), parsed(supplement)
    both, kind = [own, other], "table" if kind == "table" else "image"
    as_is = lambda v: v if isinstance(v, str) and v.strip() else ""
    html = as_is(own.get("html")) or first_part([other], ("html", "table_html"), as_is)
    return {
        "caption": first_part(both, PART_KEYS[kind, "caption"], block_text),
        "footnote": first_part(both, PART_KEYS[kind, "footnote"], block_text),
        "html": html,
        "body": first_part(both, BODY_KEYS, plain) or markup_text(html) or block_text(own),
        "math": first_part([own], MATH_KEYS, plain) or block_text(own),
        "image": first_part([other], IMAGE_KEYS, as_is) or None,
    }


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def markup_text(html: str) -> str:
    p = _Text()
    p.feed(html)
    p.close()
    return " ".join(" ".join(p.parts).split())


def layout_parts(block: Column | str, supplement: Column | str, kind: Column | str) -> Column:
    """block_parts() of JSON columns; null and malformed JSON count as empty blocks."""

    def run(b: pd.Series, s: pd.Series, k: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([block_parts(*x) for x in zip(b, s, k)], columns=PARTS)

    cols = [F.col(c) if isinstance(c, str) else c for c in (block, supplement, kind)]
    return F.pandas_udf(run, ", ".join(f"{p} string" for p in PARTS))(*cols)


def json_text(payload: str | None) -> str:
    try:
        return block_text(json.loads(payload)) if payload else ""
    except ValueError:
        return ""


def nested_text(payload: Column | str) -> Column:
    """block_text() of JSON strings; null and malformed JSON give an empty text."""
    return batched(json_text, "string", payload)


def answer_object(text: str | None) -> str | None:
    """The first balanced JSON object of a model's answer, think tags and code fences aside; null without one."""
    t = re.sub(r"(?s)<think>.*?</think>", "", text or "")
    t = re.sub(r"```(?:json)?", "", t)
    for m in re.finditer(r"\{", t):
        try:
            obj, _ = json.JSONDecoder().raw_decode(t[m.start() :])
            return json.dumps(obj, ensure_ascii=False, sort_keys=True)
        except ValueError:
            continue
    return None


def json_answer(text: Column | str) -> Column:
    return batched(answer_object, "string", text)
