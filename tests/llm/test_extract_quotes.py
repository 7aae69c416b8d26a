import pytest

from bandwright.llm import extract


def text(html):
    nodes = extract.parse(html)
    return extract.blocks(*extract.unwrapped(nodes, None, None, extract.Matcher()))


@pytest.mark.parametrize("tag", ["<script src=a'b.js>", "<script src=\"a.js>", "<style media=a'>", "<script data-x='>", "<script 'x>", "<script a=b\"c d='e'>", "<style a = 'x>y' b>"])
@pytest.mark.parametrize("code", ["var q = 1;", "var q = 'x', r = \"y\";"])
def test_code_behind_broken_quotes_is_no_text(tag, code):
    name = tag[1:7] if tag.startswith("<script") else "style"
    for page in (f"<article><p>one two</p>{tag}{code}</{name}><p>three four</p></article>", f"<article><p>one two</p><p>three four</p></article>{tag}{code}</{name}>"):
        found = text(page)
        assert "one two" in found and not any("var" in x for x in found)


def test_quotes_in_text_and_values():
    assert text("<p title='a > b' class=\"x\">it's \"so\"</p><p a=>b</p><p =>c</p>") == ["it's \"so\"", "b", "c"]
    assert text("<p data-x=don't>one</p><p title=\"it's\">two</p>") == ["one", "two"]
