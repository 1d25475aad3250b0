"""The document grammar: parsing, validation, text and rendering of block trees.

A fragment or document is XML in one namespace. The content model is a table of what each element
may hold; the checks that a content model can't state (blank paragraphs, colourless spans, table
grids) follow it. Stages run in order (syntax, security, root, schema, semantic) and a failing
stage suppresses the later ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple
from xml.parsers import expat

NAMESPACE = "urn:docflow:document:1"
VERSION = "0.1"

# Fixed values of the grammar.
COLORS = ("red", "orange", "yellow", "green", "blue", "purple", "gray")
FOREGROUND = ("#D83931", "#B96500", "#8A6A00", "#16803C", "#245BDB", "#7F3FBF", "#646A73")
BACKGROUND = ("#FDE2E2", "#FFE8CC", "#FFF3B0", "#DCF4E4", "#E1EBFF", "#EFE2FA", "#ECEEF0")
CHAIN = ("a", "b", "em", "del", "u", "code", "span")
INLINE = frozenset((*CHAIN, "br", "latex"))
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = frozenset(("p", *HEADINGS, "ul", "ol", "blockquote", "table", "pre", "hr"))
NO_BODY = frozenset(("title", *HEADINGS, "hr"))


class Rule(NamedTuple):
    """What an element may hold: children, text, how many children at least and at most."""

    children: frozenset[str]
    text: bool = False
    least: int = 0
    most: int | None = None


NOTHING = frozenset()
RULES = {
    **{tag: Rule(frozenset(CHAIN[i + 1 :]), True) for i, tag in enumerate(CHAIN)},
    **{tag: Rule(INLINE, True) for tag in ("title", "p", *HEADINGS, "th", "td")},
    "br": Rule(NOTHING, most=0),
    "hr": Rule(NOTHING, most=0),
    "latex": Rule(NOTHING, True),
    "pre": Rule(frozenset({"code"}), least=1, most=1),
    "li": Rule(INLINE | {"ul", "ol"}, True),
    "ul": Rule(frozenset({"li"}), least=1),
    "ol": Rule(frozenset({"li"}), least=1),
    "blockquote": Rule(frozenset({"p", "ul", "ol", "blockquote"}), least=1),
    "table": Rule(frozenset({"thead", "tbody"}), least=1, most=2),
    "thead": Rule(frozenset({"tr"}), least=1),
    "tbody": Rule(frozenset({"tr"}), least=1),
    "document": Rule(BLOCKS | {"title"}),
    "update": Rule(BLOCKS | {"title"}, least=1),
}
ATTRIBUTES = {"a": {"href"}, "pre": {"lang"}, "span": {"text-color", "background-color"}, "th": {"rowspan", "colspan"}, "td": {"rowspan", "colspan"}, "document": {"schema-version"}, "update": {"schema-version"}}


class Issue(NamedTuple):
    stage: str
    code: str
    message: str
    line: int | None = None
    column: int | None = None
    xpath: str | None = None
    block_index: int | None = None


@dataclass
class Node:
    """An element; text runs lie between children: before child i stands ``runs[i]``."""

    tag: str
    attrs: dict[str, str]
    line: int = 0
    column: int = 0
    children: list[Node] = field(default_factory=list)
    runs: list[str] = field(default_factory=lambda: [""])
    parent: Node | None = field(default=None, repr=False)

    def walk(self) -> Iterator[Node]:
        yield self
        for child in self.children:
            yield from child.walk()

    def all_text(self) -> str:
        return self.runs[0] + "".join(c.all_text() + r for c, r in zip(self.children, self.runs[1:], strict=True))

    def path(self) -> str:
        if self.parent is None:
            return f"/{self.tag}"
        same = [c for c in self.parent.children if c.tag == self.tag]
        place = f"[{next(i for i, c in enumerate(same, 1) if c is self)}]" if len(same) > 1 else ""
        return f"{self.parent.path()}/{self.tag}{place}"

    def top_index(self) -> int | None:
        """The place of the top-level block that holds this node."""
        node = self
        while node.parent is not None and node.parent.parent is not None:
            node = node.parent
        return None if node.parent is None else next(i for i, c in enumerate(node.parent.children) if c is node)


class Refused(Exception):
    def __init__(self, issue: Issue):
        super().__init__(issue.message)
        self.issue = issue


def parse(xml: str, namespace: str = NAMESPACE) -> Node:
    """The tree of a text, or :class:`Refused`. Nothing is expanded, fetched or repaired.

    Elements of another namespace keep it in their tag (``{uri}name``), which no rule allows.
    """
    parser = expat.ParserCreate(namespace_separator="}")
    top: list[Node] = []
    stack: list[Node] = []

    def refuse(code: str):
        def handler(*_):
            raise Refused(Issue("security", code, f"{code.lower()} isn't allowed", parser.CurrentLineNumber, parser.CurrentColumnNumber))

        return handler

    def local(name: str) -> str:
        uri, cut, tag = name.rpartition("}")
        return tag if cut and uri == namespace else "{" + name if cut else "{}" + name

    def start(name, attrs):
        node = Node(local(name), {k if "}" not in k else "{" + k: v for k, v in attrs.items()}, parser.CurrentLineNumber, parser.CurrentColumnNumber + 1)
        if stack:
            node.parent = stack[-1]
            stack[-1].children.append(node)
            stack[-1].runs.append("")
        else:
            top.append(node)
        stack.append(node)

    def data(text):
        if stack:
            stack[-1].runs[-1] += text

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, lambda _: stack.pop(), data
    parser.StartDoctypeDeclHandler = refuse("DOCTYPE")
    parser.CommentHandler = refuse("COMMENT")
    parser.ProcessingInstructionHandler = refuse("PROCESSING_INSTRUCTION")
    parser.EntityDeclHandler = refuse("ENTITY")
    try:
        parser.Parse(xml.encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError as e:
        raise Refused(Issue("syntax", "XML_SYNTAX", expat.errors.messages.get(e.code, "not well-formed"), e.lineno, e.offset + 1)) from None
    return top[0]


def schema_issue(node: Node, root: Node) -> str | None:
    """What is wrong with a node by the content model, None if nothing is."""
    inside_pre = node.tag == "code" and node.parent is not None and node.parent.tag == "pre"
    rule = Rule(NOTHING, True) if inside_pre else rule_of(node)
    if rule is None:
        return f"element {node.tag} isn't known"
    known = ATTRIBUTES.get(node.tag, set())
    for name, value in node.attrs.items():
        if name not in known:
            return f"attribute {name} isn't allowed on {node.tag}"
        if name.endswith("-color") and value not in COLORS:
            return f"{value} isn't a color"
        if name in ("rowspan", "colspan") and not (re.fullmatch(r"\s*\+?[0-9]+\s*", value) and int(value) > 0):
            return f"{name} must be a positive number"
    if node.tag == "a" and "href" not in node.attrs:
        return "a needs href"
    if not rule.text and any(r.strip() for r in node.runs):
        return f"{node.tag} holds no text of its own"
    if rule.most == 0 and any(node.runs):
        return f"{node.tag} is empty"
    for child in node.children:
        if child.tag not in rule.children:
            return f"{child.tag} isn't allowed in {node.tag}"
    if not rule.least <= len(node.children) <= (rule.most if rule.most is not None else len(node.children)):
        return f"{node.tag} holds too few or too many elements"
    if node.tag == "table" and [c.tag for c in node.children] not in (["tbody"], ["thead", "tbody"]):
        return "table holds an optional thead and one tbody"
    if node.tag == "document" and any(c.tag == "title" for c in node.children[1:]):
        return "a title stands first and only once"
    return None


def rule_of(node: Node) -> Rule | None:
    if node.tag == "tr" and node.parent is not None:
        return Rule(frozenset({"th"} if node.parent.tag == "thead" else {"td"}))
    return RULES.get(node.tag)


def table_issue(table: Node) -> tuple[Node, str] | None:
    """The cell or row at which a table stops being a full grid.

    Each column of a section holds until which row it is taken; a row is swept from the left.
    """
    width = None
    for section in table.children:
        held: list[tuple[int, int, int]] = []  # start, end, row after the last
        for y, row in enumerate(section.children):
            held = sorted(x for x in held if x[2] > y)
            spans = list(held)
            at = 0
            for cell in row.children:
                for a, b, _ in sorted(spans):
                    if a <= at < b:
                        at = b
                end, below = at + int(cell.attrs.get("colspan", "1")), y + int(cell.attrs.get("rowspan", "1"))
                if below > len(section.children) or any(at < b and a < end for a, b, _ in spans):
                    return cell, "TABLE_SPAN_INVALID"
                spans.append((at, end, below))
                at = end
            held = spans
            edge = 0
            for a, b, _ in sorted(spans):
                if a != edge:
                    return row, "TABLE_GRID_INVALID"
                edge = b
            if not edge or width not in (None, edge):
                return row, "TABLE_GRID_INVALID"
            width = edge
    return None


def semantic_issues(root: Node) -> Iterator[tuple[Node, str, str]]:
    for node in root.walk():
        if any("\u200d" in x for x in (*node.runs, *node.attrs.values())):
            yield node, "PLACEHOLDER_CHARACTER", "U+200D must go"
        if node.tag == "p" and not node.all_text().strip():
            yield node, "EMPTY_PARAGRAPH", "a paragraph needs text"
        if node.tag == "span" and not node.attrs:
            yield node, "SPAN_COLOR_REQUIRED", "a span needs a color"
        if node.tag == "table" and (found := table_issue(node)):
            yield *found, "the table isn't a full grid"


def check(root: Node, kind: str, strict: bool = False) -> list[Issue]:
    """The issues of a parsed tree whose root should be ``kind`` (document or update)."""

    def at(node: Node, stage: str, code: str, message: str) -> Issue:
        return Issue(stage, code, message, node.line, node.column, node.path(), node.top_index() if kind == "update" else None)

    if root.tag != kind:
        return [at(root, "root", "ROOT", f"the root must be {kind}")]
    if root.attrs.get("schema-version") != VERSION:
        return [at(root, "schema", "SCHEMA", f"schema-version must be {VERSION}")]
    issues = [at(n, "schema", "SCHEMA", m) for n in root.walk() if (m := schema_issue(n, root))]
    if issues:
        return issues
    issues = [at(n, "semantic", c, m) for n, c, m in semantic_issues(root)]
    if strict:
        issues += [at(n, "semantic", c, m) for n, c, m in strict_issues(root)]
    return issues


def strict_issues(root: Node) -> Iterator[tuple[Node, str, str]]:
    """What a reader refuses beyond the grammar: blank links, great spans, depth and size."""
    depth = {id(root): 0}
    for k, node in enumerate(root.walk()):
        if node.parent is not None:
            depth[id(node)] = depth[id(node.parent)] + 1
        if depth[id(node)] >= 96 or k >= 200_000:
            yield node, "TOO_LARGE", "too deep or too many elements"
            return
        if node.tag == "a" and not node.attrs["href"].strip():
            yield node, "LINK_TARGET_EMPTY", "a link needs a target"
        if any(int(node.attrs.get(x, "1")) > 10_000 for x in ("rowspan", "colspan")):
            yield node, "TABLE_SPAN_INVALID", "a span of 10 000 at most"
    if root.tag == "document" and not root.children:
        yield root, "EMPTY_DOCUMENT", "a document needs a block"


def validate(xml: str | None, kind: str = "update", strict: bool = False, namespace: str = NAMESPACE) -> list[Issue]:
    """The issues of a text, none if it is valid."""
    if strict and xml is not None and len(xml.encode("utf-8", "surrogatepass")) > 16 << 20:
        return [Issue("security", "TOO_LARGE", "16 MiB at most")]
    try:
        return check(parse(xml or "", namespace), kind, strict)
    except Refused as e:
        return [e.issue]


def envelope(blocks: str, kind: str = "update", namespace: str = NAMESPACE) -> str:
    return f'<{kind} xmlns="{namespace}" schema-version="{VERSION}">{blocks}</{kind}>'


def escape(text: str) -> str:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = text.replace(sign, name)
    return text


def paragraph(text: str) -> str:
    """A paragraph of plain text, lines parted by br."""
    return "<p>" + "<br/>".join(escape(x) for x in text.split("\n")) + "</p>"


def block_of(xml: str | None) -> Node | None:
    """The only block of a valid fragment, else None."""
    try:
        root = parse(envelope(xml or ""))
    except Refused:
        return None
    return root.children[0] if len(root.children) == 1 and not check(root, "update") else None


BREAK_AFTER = {"p": "\n", "li": "\n", "tr": "\n", "thead": "\n", "tbody": "\n", "td": "\t", "th": "\t"}


def plain_text(node: Node) -> str:
    """Readable text with breaks where the structure has them; code keeps its ends."""
    parts = [node.runs[0]]
    for child, run in zip(node.children, node.runs[1:], strict=True):
        parts += ("\n" if child.tag == "br" else plain_text(child), BREAK_AFTER.get(child.tag, ""), run)
    text = "".join(parts)
    return text if node.tag in ("code", "pre") else text.rstrip("\n\t")


def structural(text: str) -> str:
    return re.sub(r"[ \t]*[\r\n]+[ \t]*", "", text).replace("\t", "")


def profile(roots: list[Node]) -> list[tuple]:
    """Structures whose change alters meaning although the text stays."""
    flat = lambda n: structural(plain_text(n))
    out: list[tuple] = []
    for node in (n for r in roots for n in r.walk()):
        match node.tag:
            case "pre" | "latex":
                out.append((node.tag, plain_text(node)))
            case "code" if node.parent is None or node.parent.tag != "pre":
                out.append(("inline_code", plain_text(node)))
            case "a":
                out.append(("a", node.attrs.get("href"), flat(node)))
            case "ul" | "ol":
                out.append((node.tag, tuple((flat(li), tuple((c.tag, flat(c)) for c in li.children if c.tag in ("ul", "ol"))) for li in node.children)))
            case "table":
                cell = lambda c: (c.tag, c.attrs.get("rowspan", "1"), c.attrs.get("colspan", "1"), flat(c))
                out.append(("table", tuple((s.tag, tuple(tuple(map(cell, r.children)) for r in s.children)) for s in node.children)))
    return out


def node_rows(xml: str | None, kind: str = "update") -> list[tuple]:
    """``node_ord, parent_ord, depth, block_ord, tag, attrs, text`` of each element; none if invalid."""
    try:
        root = parse(xml or "")
    except Refused:
        return []
    if check(root, kind):
        return []
    out: list[tuple] = []

    def visit(node: Node, parent: int | None, depth: int, block: int | None) -> None:
        me = len(out)
        out.append((me, parent, depth, block, node.tag, node.attrs, node.runs[0]))
        for i, child in enumerate(node.children):
            visit(child, me, depth + 1, i if depth == 0 else block)

    visit(root, None, 0, None)
    return out


def serialize(node: Node) -> str:
    attrs = "".join(f' {k}="{escape(v)}"' for k, v in node.attrs.items())
    inner = escape(node.runs[0]) + "".join(serialize(c) + escape(r) for c, r in zip(node.children, node.runs[1:], strict=True))
    return f"<{node.tag}{attrs}>{inner}</{node.tag}>" if inner else f"<{node.tag}{attrs}/>"


def safe_link(url: str) -> bool:
    return re.fullmatch(r"(?i)https?://[^/?#@\s]+(?:[/?#]\S*)?", url) is not None


RENAMED = {"title": "h1", "b": "strong", "del": "s"}


def html(node: Node, preview: bool = False) -> str:
    """A block as HTML; links that aren't safe leave their text."""
    inner = escape(node.runs[0]) + "".join(html(c, preview) + escape(r) for c, r in zip(node.children, node.runs[1:], strict=True))
    if node.tag == "latex":
        formula = escape(node.all_text())
        return f'<span class="math" data-latex="{formula}"></span>' if preview else f"<span>{formula}</span>"
    if node.tag == "a" and not safe_link(node.attrs["href"]):
        return inner
    tag = RENAMED.get(node.tag, node.tag)
    if tag in ("hr", "br"):
        return f"<{tag}>"
    attrs = "".join(f' {k}="{escape(v)}"' for k, v in node.attrs.items() if k in ("href", "rowspan", "colspan"))
    if re.fullmatch(r"[A-Za-z0-9_+.-]{1,40}", lang := node.attrs.get("lang", "")):
        attrs += f' class="language-{lang}"'
    palettes = {"text-color": ("color", FOREGROUND), "background-color": ("background-color", BACKGROUND)}
    styles = [f"{palettes[k][0]}:{palettes[k][1][COLORS.index(v)]}" for k, v in node.attrs.items() if k in palettes]
    attrs += f' style="{";".join(styles)}"' if styles else ""
    made = f"<{tag}{attrs}>{inner}</{tag}>"
    return f'<div class="wide">{made}</div>' if preview and tag in ("table", "pre") else made


def line_text(node: Node) -> str:
    return "\n" if node.tag == "br" else node.runs[0] + "".join(line_text(c) + r for c, r in zip(node.children, node.runs[1:], strict=True))


def plain(node: Node, depth: int = 0) -> str:
    """A block as plain text: bullets and numbers, tables by tabs, a line for a rule."""
    match node.tag:
        case "ul" | "ol":
            items = []
            for i, li in enumerate(node.children, 1):
                mark = f"{i}. " if node.tag == "ol" else "• "
                text, after = li.runs[0], False
                for child, run in zip(li.children, li.runs[1:], strict=True):
                    if child.tag in ("ul", "ol"):
                        text += "\n" + plain(child, depth + 1)
                        after = True
                        pieces = [run]
                    else:
                        pieces = [line_text(child), run]
                    for piece in pieces:
                        if after and piece.strip():
                            text += "\n" + "  " * (depth + 1)
                            after = False
                        text += piece
                items.append("  " * depth + mark + text.strip())
            return "\n".join(items)
        case "blockquote":
            return "\n\n".join(plain(c, depth) for c in node.children)
        case "table":
            return "\n".join("\t".join(line_text(c).strip() for c in row.children) for part in node.children for row in part.children)
        case "hr":
            return "────────"
        case "pre":
            return line_text(node.children[0])
        case _:
            return line_text(node).strip()


def document_issues(blocks: list[str]) -> list[Issue]:
    """The issues of blocks put together as a document, each with the place of its block."""
    try:
        root = parse(envelope("".join(blocks), "document"))
    except Refused as e:
        return [e.issue]
    places = {c.path(): i for i, c in enumerate(root.children)}
    found = check(root, "document")
    by_path = lambda p: next((i for q, i in places.items() if p == q or (p or "").startswith(q + "/")), None)
    return [x._replace(block_index=by_path(x.xpath)) for x in found]
