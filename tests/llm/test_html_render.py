"""Rendered text of small pages, and that no visible word is lost."""

import html
import re

import pytest

from shopframe.llm import html_render as H

CASES = {
    "": "",
    "a  b\n c": "a b c",
    "<p>one<p>two<br>three": "one\n\ntwo\nthree",
    "<div>a</div>b<div>c</div>": "a\nb\nc",
    "x<b>y</b> <i> z</i>": "xy z",
    "<h1>T</h1>text": "T\n\ntext",
    "<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>": "- a\n- b\n  3. x\n  4. y\n- c",
    "<ol><li>a<li value=7>b<li>c</ol>": "1. a\n7. b\n8. c",
    "<table><tr><th>Name<th>Qty<tr><td>Apple pie<td>3</table>": "Name       Qty\nApple pie  3",
    "<table><tr><td colspan=2>wide cell<td>x<tr><td>a<td>b<td>c</table>": "wide cell  x\na  b  c",
    "<table><td>a<p>b</td><td>c</table>d": "a  c\n\nb\n\nd",
    "<pre>\n  a\n   b</pre>c": "  a\n   b\n\nc",
    "<div style='Display : none'>x</div>y<p hidden>z</p><input type=hidden value=q><input value=v>": "y v",
    "<head><title>t</title></head><script>if(a<b)</script><style>p{}</style>k<!-- c --><template>n</template>": "k",
    "<details><summary>s</summary>closed</details><details open>o</details>": "s\no",
    "<dialog>no</dialog><dialog open>yes</dialog>": "yes",
    "&lt;p&gt; &amp; a < b &eacute;": "<p> & a < b é",
    "<a title='x>y' href=\"q\">link</a>": "link",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\nd\nu\ne",
    "</p>a</div>b</li>": "a b".replace(" ", ""),
    "<select><option>a<option>b</select>": "a\nb",
    "<script>never closed": "",
    "<!-- never closed <p>x": "",
    "a<b": "a",
    "<": "<",
    "<textarea> k\n  l</textarea>": " k\n  l",
    "<p>a<table><tr><td>b</table>c": "a\n\nb\n\nc",
    "<svg><defs>no</defs><title>no</title><text>label</text></svg>yes": "labelyes",
    "<math><mi>x</mi><annotation>no</annotation></math>": "x",
    "<table><tr><td rowspan=2>A<td>B<tr><td>C</table>": "A  B\n   C",
    "<table><tr><td>A<td rowspan=2>B<td>C<tr><td>D<td>E</table>": "A  B  C\nD     E",
    "<div>" * 450 + "<script>var secret=1</script><span hidden>HID<span>HID</span>HID</span>seen<b>x</b>": "seenx",
}


@pytest.mark.parametrize("page", CASES)
def test_cases(page):
    assert H.visible_text(page) == CASES[page]


def test_words_of_the_table_pages(spark, sf_dir):
    """On pages without anything hidden, the text is what is left when all tags are cut out."""
    checked = 0
    for (page,) in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect():
        bare = re.sub(r"(?is)<!--.*?-->|<(script|style|title|noscript|template)\b.*?</\1\s*>", "", page)
        if re.search(r"(?i)hidden|display:\s*none|<details|<dialog|<input|<iframe", bare):
            continue
        words = "".join(html.unescape(re.sub(r"(?s)<[^>]+>", " ", bare)).split())
        text = re.sub(r"(?m)^\s*(?:- |\d+\. )+", "", H.visible_text(page))
        assert "".join(text.split()) == words
        checked += 1
    assert checked


def test_deep_and_broken_pages_end():
    for page in ("<ul>" * 5000 + "x", "<div>" * 5000 + "y", "<table><tr><td>" * 2000 + "z", "<b>" * 5000 + "w",
                 "<p><button>" + "<span><div>" * 5000 + "v"):
        assert H.visible_text(page).strip("- ")[-1] in "xyzwv"
    assert H.visible_text("<a \"" * 20_000 + "k") is not None
    assert H.visible_text("<!" * 20_000) == ""


def test_columns(spark):
    rows = [(1, "<p>a"), (1, "<p>a"), (2, None), (None, ""), (3, "<p>" + "long text " * 200_000)]
    pages = spark.createDataFrame([(i, h, "x") for i, h in rows], "page_id long, html string, tag string")
    out = H.with_visible_text(pages).collect()
    assert [r.visible_text[:20] if r.visible_text is not None else None for r in out] == [
        "a", "a", None, "", "long text long text "]
    assert len(out[4].visible_text) == 10 * 200_000 - 1 and H.with_visible_text(pages.limit(0)).collect() == []
