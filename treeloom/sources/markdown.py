"""Markdown as a typed tree: blocks with positions, inline nodes, tables, task lists, footnotes, front matter."""

from __future__ import annotations

import html
import re

from treeloom.sources.text_formats import split_frontmatter

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*(.*?)[ \t]*$")
_BREAK = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)|$)")
_HTML = re.compile(r" {0,3}<(?:!--|\?|![A-Z]|!\[CDATA\[|/?(?:address|article|aside|base|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|optgroup|option|p|param|pre|script|search|section|style|summary|table|tbody|td|textarea|tfoot|th|thead|title|tr|track|ul)(?:[\s/>]|$))", re.I)
_HTML_LINE = re.compile(r" {0,3}(?:<[A-Za-z][\w-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?>|</[A-Za-z][\w-]*\s*>)[ \t]*$")
_DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_FOOTNOTE = re.compile(r" {0,3}\[\^([^\]\s]+)\]:[ \t]*(.*)$")
_REFERENCE = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(?:<([^<>]*)>|(\S+))(?:[ \t]+(?:\"([^\"]*)\"|'([^']*)'|\(([^)]*)\)))?[ \t]*$")


def _label(s: str) -> str:
    return " ".join(s.split()).casefold()


def _node(kind: str, first: int, last: int, lines: list[tuple[int, str]], **fields: object) -> dict:
    end = next((len(t) for n, t in lines if n == last), 1)
    return {"type": kind, **fields, "position": {"start": {"line": first, "column": 1}, "end": {"line": last, "column": max(end, 1)}}}


class _Blocks:
    def __init__(self) -> None:
        self.references: dict[str, tuple[str, str]] = {}
        self.footnotes: set[str] = set()
        self.waiting: list[tuple[dict, str]] = []

    def parse(self, lines: list[tuple[int, str]]) -> list[dict]:
        out: list[dict] = []
        at = 0
        while at < len(lines):
            n, line = lines[at]
            if not line.strip():
                at += 1
                continue
            for rule in (self.indented, self.atx, self.fenced, self.rule, self.quote, self.items, self.html, self.footnote, self.table):
                found = rule(lines, at)
                if found:
                    out += found[0]
                    at = found[1]
                    break
            else:
                found, at = self.paragraph(lines, at)
                out += found
        return out

    def indented(self, lines: list, at: int):
        if not re.match(r" {4}|\t", lines[at][1].expandtabs(4)) or not lines[at][1].strip():
            return None
        end, last = at, at
        while end < len(lines) and (not lines[end][1].strip() or lines[end][1].expandtabs(4).startswith("    ")):
            if lines[end][1].strip():
                last = end
            end += 1
        text = "".join(t.expandtabs(4)[4:] + "\n" for _, t in lines[at : last + 1])
        return [_node("code_block", lines[at][0], lines[last][0], lines, fenced=False, lang=None, info="", value=text)], last + 1

    def atx(self, lines: list, at: int):
        m = _ATX.match(lines[at][1])
        if not m:
            return None
        node = _node("heading", lines[at][0], lines[at][0], lines, level=len(m[1]), children=[])
        self.waiting.append((node, (m[2] or "").strip() if not (m[2] or "").strip("#") == "" or not m[2] else ""))
        return [node], at + 1

    def fenced(self, lines: list, at: int):
        m = _FENCE.match(lines[at][1])
        if not m or m[2][0] == "`" and "`" in m[3]:
            return None
        end = at + 1
        close = re.compile(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
        body = []
        while end < len(lines) and not close.match(lines[end][1]):
            body.append(re.sub(rf"^ {{0,{len(m[1])}}}", "", lines[end][1]))
            end += 1
        last = min(end, len(lines) - 1)
        info = html.unescape(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", m[3]))
        node = _node("code_block", lines[at][0], lines[last][0], lines, fenced=True, lang=info.split()[0] if info else None, info=info, value="".join(b + "\n" for b in body))
        return [node], end + 1

    def rule(self, lines: list, at: int):
        return ([_node("thematic_break", lines[at][0], lines[at][0], lines)], at + 1) if _BREAK.match(lines[at][1]) else None

    def starts(self, line: str, in_list: bool = False) -> bool:
        """Whether a line begins a block that ends a paragraph."""
        m = _ITEM.match(line)
        item = m and line[m.end() :].strip() and (m[2] in "-+*" or m[2][:-1] == "1")
        return bool(_ATX.match(line) or _FENCE.match(line) or _BREAK.match(line) or _QUOTE.match(line) or _HTML.match(line) or item)

    def quote(self, lines: list, at: int):
        if not _QUOTE.match(lines[at][1]):
            return None
        end, inner = at, []
        while end < len(lines):
            n, line = lines[end]
            if m := _QUOTE.match(line):
                inner.append((n, line[m.end() :]))
            elif not line.strip() or self.starts(line) or not inner[-1][1].strip():
                break
            else:
                inner.append((n, line))
            end += 1
        return [_node("block_quote", lines[at][0], lines[end - 1][0], lines, children=self.parse(inner))], end

    def items(self, lines: list, at: int):
        m = _ITEM.match(lines[at][1])
        if not m:
            return None
        ordered = m[2][-1] in ".)"
        mark = m[2][-1]
        children, end, loose = [], at, False
        while end < len(lines):
            m = _ITEM.match(lines[end][1])
            if not m or (m[2][-1] != mark) or _BREAK.match(lines[end][1]):
                break
            first = end
            width = len(m[0].expandtabs(4)) if m[3] and len(m[3].expandtabs(4)) <= 4 else len(m[1]) + len(m[2]) + 1
            inner = [(lines[end][0], lines[end][1][m.end() :] if m[3] is None or len(m[3]) <= 4 else lines[end][1][len(m[1]) + len(m[2]) + 1 :])]
            end += 1
            blank = not inner[0][1].strip()
            while end < len(lines):
                n, line = lines[end]
                if not line.strip():
                    inner.append((n, ""))
                    blank = True
                elif len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip()) >= width:
                    inner.append((n, line.expandtabs(4)[width:]))
                    loose |= blank and bool(inner[:-1]) and any(t.strip() for _, t in inner[:-1])
                    blank = False
                elif not blank and not self.starts(line) and not _ITEM.match(line):
                    inner.append((n, line.lstrip()))
                else:
                    break
                end += 1
            trailing = 0
            while inner and not inner[-1][1].strip() and len(inner) > 1:
                inner.pop()
                trailing += 1
            item = _node("list_item", lines[first][0], inner[-1][0], lines, children=[])
            task = re.match(r"\[([ xX])\][ \t]+", inner[0][1])
            if task:
                item["checked"] = task[1] != " "
                inner[0] = (inner[0][0], inner[0][1][task.end() :])
            item["children"] = self.parse(inner)
            children.append(item)
            following = _ITEM.match(lines[end][1]) if end < len(lines) else None
            if following and following[2][-1] == mark and not _BREAK.match(lines[end][1]):
                loose |= trailing > 0
            else:
                end -= trailing
                break
        node = _node("list", lines[at][0], children[-1]["position"]["end"]["line"], lines, ordered=ordered, start=int(re.match(r"\d+", lines[at][1].lstrip())[0]) if ordered else None, tight=not loose, children=children)
        return [node], end

    def html(self, lines: list, at: int):
        line = lines[at][1]
        if not _HTML.match(line) and not _HTML_LINE.match(line):
            return None
        closing = next((e for s, e in (("<!--", "-->"), ("<?", "?>"), ("<![CDATA[", "]]>"), ("<!", ">")) if line.lstrip().startswith(s)), None)
        raw = re.match(r"\s*<(script|pre|style|textarea)\b", line, re.I)
        closing = f"</{raw[1].lower()}>" if raw else closing
        end = at
        while end < len(lines):
            if closing:
                end += 1
                if closing in lines[end - 1][1].lower():
                    break
            elif not lines[end][1].strip():
                break
            else:
                end += 1
        return [_node("html_block", lines[at][0], lines[end - 1][0], lines, value="".join(t + "\n" for _, t in lines[at:end]))], end

    def footnote(self, lines: list, at: int):
        m = _FOOTNOTE.match(lines[at][1])
        if not m:
            return None
        self.footnotes.add(m[1])
        inner, end = [(lines[at][0], m[2])], at + 1
        while end < len(lines) and (lines[end][1].startswith("    ") or lines[end][1].strip() and not _FOOTNOTE.match(lines[end][1]) and inner[-1][1].strip() and not self.starts(lines[end][1])):
            inner.append((lines[end][0], lines[end][1].removeprefix("    ")))
            end += 1
        return [_node("footnote_definition", lines[at][0], lines[end - 1][0], lines, name=m[1], children=self.parse(inner))], end

    @staticmethod
    def cells(line: str) -> list[str]:
        line = line.strip().removeprefix("|")
        cells = re.split(r"(?<!\\)\|", line)
        if len(cells) > 1 and not cells[-1].strip():
            cells.pop()
        return [c.strip().replace("\\|", "|") for c in cells]

    def table(self, lines: list, at: int):
        if at + 1 >= len(lines) or "|" not in lines[at][1] or not _DELIMITER.match(lines[at + 1][1]) or "-" not in lines[at + 1][1]:
            return None
        head, marks = self.cells(lines[at][1]), self.cells(lines[at + 1][1])
        if len(head) != len(marks):
            return None
        end, rows = at + 2, [(at, head)]
        while end < len(lines) and lines[end][1].strip() and not self.starts(lines[end][1]):
            rows.append((end, self.cells(lines[end][1])))
            end += 1
        children = []
        for k, row in rows:
            cells = []
            for text in row[: len(head)] + [""] * (len(head) - len(row)):
                cell = _node("table_cell", lines[k][0], lines[k][0], lines, children=[])
                self.waiting.append((cell, text))
                cells.append(cell)
            children.append(_node("table_row", lines[k][0], lines[k][0], lines, header=k == at, n_source_cells=len(row), children=cells))
        align = ["center" if m[0] == ":" and m[-1] == ":" else "left" if m[0] == ":" else "right" if m[-1] == ":" else "none" for m in marks]
        return [_node("table", lines[at][0], lines[end - 1][0], lines, alignments=align, children=children)], end

    def paragraph(self, lines: list, at: int):
        end = at
        while end < len(lines) and lines[end][1].strip():
            m = _SETEXT.match(lines[end][1]) if end > at else None
            if m:
                node = _node("heading", lines[at][0], lines[end][0], lines, level=1 if m[1][0] == "=" else 2, setext=True, children=[])
                self.waiting.append((node, "\n".join(t.strip() for _, t in lines[at:end])))
                return [node], end + 1
            if end > at and (self.starts(lines[end][1]) or self.table(lines, end)):
                break
            if end == at and (m := _REFERENCE.match(lines[end][1])):
                self.references.setdefault(_label(m[1]), (m[2] if m[2] is not None else m[3], m[4] or m[5] or m[6] or ""))
                return [], end + 1
            end += 1
        node = _node("paragraph", lines[at][0], lines[end - 1][0], lines, children=[])
        texts = [t.lstrip() for _, t in lines[at:end]]
        texts[-1] = texts[-1].rstrip()
        self.waiting.append((node, "\n".join(texts)))
        return [node], end


_INLINE = re.compile(
    r"(?P<escape>\\[!-/:-@\[-`{-~])|(?P<hard>(?: {2,}|\\)\n[ ]*)|(?P<soft> ?\n[ ]*)|(?P<ticks>`+)|(?P<auto><[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*>|<[\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9.-]+>)"
    r"|(?P<html><!--.*?-->|</?[A-Za-z][\w-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?>)|(?P<note>\[\^[^\]\s]+\])|(?P<image>!\[)|(?P<open>\[)|(?P<close>\])|(?P<run>\*+|_+|~{1,2})|(?P<entity>&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]+);)"
    r"|(?P<url>(?<![\w/])(?:https?://|www\.)[^\s<]+)",
    re.S,
)
_TARGET = re.compile(r"\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|\(((?:[^()\\]|\\.)*)\)))?\s*\)")


def inlines(text: str, references: dict, footnotes: set) -> list[dict]:
    out: list[dict] = []  # nodes, with {"run"} and {"bracket"} marks until they are resolved

    def put(s: str) -> None:
        if s:
            if out and out[-1].get("type") == "text":
                out[-1]["value"] += s
            else:
                out.append({"type": "text", "value": s})

    at = 0
    while at < len(text):
        m = _INLINE.search(text, at)
        if not m:
            put(text[at:])
            break
        put(text[at : m.start()])
        kind, found, at = m.lastgroup, m[0], m.end()
        if kind == "escape":
            put(found[1])
        elif kind == "hard":
            out.append({"type": "line_break"})
        elif kind == "soft":
            out.append({"type": "soft_break"})
        elif kind == "ticks":
            end = re.compile(rf"(?<!`){found}(?!`)").search(text, at)
            if end:
                code = text[at : end.start()].replace("\n", " ")
                out.append({"type": "code", "value": code[1:-1] if code.strip() and code[0] == code[-1] == " " else code})
                at = end.end()
            else:
                put(found)
        elif kind == "auto":
            out.append({"type": "link", "url": ("mailto:" if "@" in found and ":" not in found else "") + found[1:-1], "title": "", "children": [{"type": "text", "value": found[1:-1]}]})
        elif kind == "html":
            out.append({"type": "html_inline", "value": found})
        elif kind == "note":
            out.append({"type": "footnote_reference", "name": found[2:-1]}) if found[2:-1] in footnotes else put(found)
        elif kind in ("image", "open"):
            out.append({"bracket": found, "at": at})
        elif kind == "close":
            start = next((i for i in range(len(out) - 1, -1, -1) if "bracket" in out[i]), None)
            target = None
            if start is not None:
                label = text[out[start]["at"] : m.start()]
                t = _TARGET.match(text, at)
                if t:
                    target, at = (t[1] if t[1] is not None else t[2], t[3] or t[4] or t[5] or ""), t.end()
                elif (t := re.compile(r"\[([^\[\]]*)\]").match(text, at)) and _label(t[1] or label) in references:
                    target, at = references[_label(t[1] or label)], t.end()
                elif _label(label) in references:
                    target = references[_label(label)]
            if target is None:
                if start is not None:
                    mark = out[start]["bracket"]
                    out[start] = {"type": "text", "value": mark}
                put("]")
                continue
            inner = _emphasis(out[start + 1 :])
            mark = out[start]["bracket"]
            del out[start:]
            clean = lambda s: html.unescape(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", s))
            out.append({"type": "image" if mark == "![" else "link", "url": clean(target[0]), "title": clean(target[1]), "children": inner})
            if mark == "[":
                for x in out[:-1]:
                    if x.get("bracket") == "[":
                        x.clear()
                        x.update({"type": "text", "value": "["})
        elif kind == "run":
            before, after = text[m.start() - 1 : m.start()] or " ", text[at : at + 1] or " "
            left = not after.isspace() and (after.isalnum() or not before.isalnum())
            right = not before.isspace() and (before.isalnum() or not after.isalnum())
            if found[0] == "_":
                left, right = left and (not right or not before.isalnum()), right and (not left or not after.isalnum())
            out.append({"run": found[0], "n": len(found), "left": left, "right": right})
        elif kind == "entity":
            put(html.unescape(found))
        else:
            url = re.sub(r"[?!.,:*_~'\"]+$", "", found)
            while url.endswith(")") and url.count(")") > url.count("("):
                url = url[:-1]
            at = m.start() + len(url)
            out.append({"type": "link", "url": ("http://" if url.startswith("www.") else "") + url, "title": "", "autolink": True, "children": [{"type": "text", "value": url}]})
    return _emphasis([{"type": "text", "value": x["bracket"]} if "bracket" in x else x for x in out])


def _emphasis(nodes: list[dict]) -> list[dict]:
    out = [dict(x) for x in nodes]
    i = 0
    while i < len(out):
        close = out[i]
        if "run" not in close or not close["right"] or not close["n"]:
            i += 1
            continue
        j = next((j for j in range(i - 1, -1, -1) if out[j].get("run") == close["run"] and out[j]["left"] and out[j]["n"] and (close["run"] != "~" or out[j]["n"] == close["n"]) and not ((out[j]["right"] or close["left"]) and close["run"] != "~" and (out[j]["n"] + close["n"]) % 3 == 0 and (out[j]["n"] % 3 or close["n"] % 3))), None)
        if j is None:
            i += 1
            continue
        size = out[j]["n"] if close["run"] == "~" else 2 if min(out[j]["n"], close["n"]) >= 2 else 1
        kind = "strikethrough" if close["run"] == "~" else "strong" if size == 2 else "emphasis"
        inner = [x for x in out[j + 1 : i]]
        node = {"type": kind, "children": _plain(inner)}
        out[j]["n"] -= size
        close["n"] -= size
        out[j + 1 : i] = [node]
        i = j + 2
    return _plain(out)


def _plain(nodes: list[dict]) -> list[dict]:
    out: list[dict] = []
    for x in nodes:
        if "run" in x:
            if not x["n"]:
                continue
            x = {"type": "text", "value": x["run"] * x["n"]}
        if x["type"] == "text" and out and out[-1]["type"] == "text":
            out[-1] = {"type": "text", "value": out[-1]["value"] + x["value"]}
        else:
            out.append(x)
    return out


def read_markdown(text: str) -> dict:
    kind, header, body, skipped = split_frontmatter(text)
    lines = [(n + skipped, line.rstrip("\r")) for n, line in enumerate(body.removeprefix("\ufeff").split("\n"), 1)]
    if lines and not lines[-1][1]:
        lines.pop()
    blocks = _Blocks()
    children = blocks.parse(lines)
    for node, raw in blocks.waiting:
        node["children"] = inlines(raw, blocks.references, blocks.footnotes)
    return {"type": "document", "frontmatter": {"kind": kind, "value": header} if kind else None, "children": children}
