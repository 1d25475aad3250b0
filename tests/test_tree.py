"""The document grammar: valid and invalid fragments, text, rendering, document checks."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docflow.functions import tree


def issues(xml, kind="update", **options):
    return [(i.stage, i.code, i.block_index) for i in tree.validate(tree.envelope(xml, kind), kind, **options)]


#: For each element what it needs inside of it, and where it may stand (the place of the element marked by @).
INSIDE = {
    **dict.fromkeys(("br", "hr"), ""), "ul": "<li>k</li>", "ol": "<li>k</li>", "blockquote": "<p>k</p>", "pre": "<code>k</code>", "table": "<tbody><tr><td>k</td></tr></tbody>",
    "thead": "<tr><th>k</th></tr>", "tbody": "<tr><td>k</td></tr>", "tr": "<td>k</td>",
}
AROUND = {
    **dict.fromkeys((*tree.BLOCKS, "title"), "@"), **dict.fromkeys(tree.INLINE, "<p>k@</p>"), "li": "<ul>@</ul>", "thead": "<table>@<tbody><tr><td>k</td></tr></tbody></table>",
    "tbody": "<table>@</table>", "tr": "<table><tbody>@</tbody></table>", "td": "<table><tbody><tr>@</tr></tbody></table>", "th": "<table><thead><tr>@</tr></thead><tbody><tr><td>k</td></tr></tbody></table>",
}
NEEDED = {"a": ' href="k"', "span": ' text-color="blue"'}


def element(tag, inside=None, attrs=None):
    inside = INSIDE.get(tag, "k") if inside is None else inside
    return f"<{tag}{NEEDED.get(tag, '') if attrs is None else attrs}>{inside}</{tag}>"


def placed(tag, *args):
    return AROUND[tag].replace("@", element(tag, *args))


@pytest.mark.parametrize("tag", sorted(AROUND))
def test_every_element_in_its_place(tag):
    assert issues(placed(tag)) == []


@pytest.mark.parametrize("outer", sorted(AROUND))
def test_elements_hold_what_their_rule_names(outer):
    """Each known element tried as the only child of each other one."""
    rule = tree.RULES.get(outer) or tree.Rule(frozenset({"td"}))
    for inner in sorted({*AROUND, "q"}):
        found = {s for s, *_ in issues(placed(outer, element(inner, "<th>k</th>" if (outer, inner) == ("thead", "tr") else None)))}
        allowed = inner in rule.children and not (outer == "table" and inner == "thead")
        assert ("schema" in found) != allowed, (outer, inner)


@pytest.mark.parametrize("tag", sorted(AROUND))
def test_attributes_and_own_text(tag):
    assert issues(placed(tag, None, NEEDED.get(tag, "") + ' id="k"'))[0][0] == "schema"
    if tag not in ("tr", "thead", "tbody") and not tree.RULES[tag].text:
        assert issues(placed(tag, INSIDE[tag] + "loose"))[0][0] == "schema"


@pytest.mark.parametrize(("tag", "attrs"), [("a", ""), ("span", ' text-color="mauve"'), ("span", ' background-color=""'), ("td", ' colspan="-1"'), ("th", ' rowspan="two"'), ("td", ' rowspan="0"')])
def test_attribute_values(tag, attrs):
    assert {x for x, *_ in issues(placed(tag, None, attrs))} == {"schema"}


GRIDS = st.lists(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 3)), max_size=3), min_size=1, max_size=4)


@given(GRIDS)
@settings(max_examples=200, deadline=None)
def test_grids_by_filling_them_in(rows):
    taken, fault = {}, None
    for y, row in enumerate(rows):
        x = 0
        for high, wide in row:
            while (x, y) in taken:
                x += 1
            cells = [(x + i, y + j) for i in range(wide) for j in range(high)]
            if y + high > len(rows) or any(c in taken for c in cells):
                fault = fault or "TABLE_SPAN_INVALID"
            taken.update(dict.fromkeys(cells))
        widths = {max((i for i, j in taken if j == k), default=-1) + 1 for k in range(y + 1)}
        if len(widths) > 1 or not max(widths) or any((i, y) not in taken for i in range(max(widths))):
            fault = fault or "TABLE_GRID_INVALID"
        if fault:
            break
    cells = "".join("<tr>" + "".join(f'<td rowspan="{h}" colspan="{w}">k</td>' for h, w in row) + "</tr>" for row in rows)
    assert issues(element("hr") + element("table", f"<tbody>{cells}</tbody>")) == ([("semantic", fault, 1)] if fault else [])


@given(st.text("ab \t\n\u00a0\u200d", max_size=6), st.booleans(), st.integers(0, 2))
@settings(max_examples=100, deadline=None)
def test_paragraphs_need_text_and_spans_a_color(text, colored, before):
    span = element("span", text, NEEDED["span"] if colored else "")
    codes = [("PLACEHOLDER_CHARACTER", "\u200d" in text), ("EMPTY_PARAGRAPH", not text.strip()), ("SPAN_COLOR_REQUIRED", not colored)]
    assert sorted(issues(element("hr") * before + element("p", span))) == sorted(("semantic", c, before) for c, holds in codes if holds)


@pytest.mark.parametrize("xml", ["<!DOCTYPE p><p>x</p>", "<!DOCTYPE p [<!ENTITY e 'boom'>]><p>&e;</p>", "<!-- c --><p>x</p>", "<?pi x?><p>x</p>"])
def test_security_comes_before_all_else(xml):
    assert tree.validate(xml)[0].stage == "security"


def test_roots():
    assert tree.validate("<p", "update")[0].stage == "syntax"
    assert tree.validate(tree.envelope("", "document"), "update")[0].stage == "root"
    assert issues("")[0][0] == "schema"
    assert issues("", "document") == []
    assert issues("", "document", strict=True)[0][1] == "EMPTY_DOCUMENT"
    assert issues("<p>x</p><title>t</title>", "document")[0][0] == "schema"
    assert tree.validate("<update schema-version='0.1'><p>x</p></update>")[0].stage == "root"
    assert issues("<p><a href=' '>x</a></p>") == [] and issues("<p><a href=' '>x</a></p>", strict=True)[0][1] == "LINK_TARGET_EMPTY"


def test_texts_and_rendering():
    table = tree.block_of("<table><tbody><tr><td>A</td><td>B</td></tr><tr><td>C</td><td>D</td></tr></tbody></table>")
    assert tree.plain_text(table) == "A\tB\nC\tD" == tree.plain(table)
    items = tree.block_of("<ol><li>a<ul><li>b</li></ul>c</li><li>d</li></ol>")
    assert tree.plain(items) == "1. a\n  • b\n  c\n2. d"
    styled = tree.block_of("<p><b>x</b><span text-color='red'>y</span><a href='javascript:1'>z</a><del>w</del></p>")
    assert tree.html(styled) == '<p><strong>x</strong><span style="color:#D83931">y</span>z<s>w</s></p>'
    assert tree.plain_text(tree.block_of("<pre><code> x\n</code></pre>")) == " x\n"
    assert tree.block_of(tree.serialize(styled)) is not None


def test_document_issue_finds_its_block():
    found = tree.document_issues(["<p>a</p>", "<title>late</title>"])
    assert found and found[0].stage == "schema"
    assert tree.document_issues(["<p>a</p>", "<p> </p>"])[0].block_index == 1


def test_nodes():
    rows = tree.node_rows(tree.envelope("<p>a<b>c</b></p>"))
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in rows] == [(0, None, 0, None, "update"), (1, 0, 1, 0, "p"), (2, 1, 2, 0, "b")]
