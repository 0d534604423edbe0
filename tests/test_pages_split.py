"""Pages that are split at their angles have the nodes that the library's parser gives."""

import random
from html.parser import HTMLParser

import pytest

from contestry.sources import pages

PIECES = ["<p>", "</p>", "<tr>", "<td class='a b'>", "</td>", "<TH Class=\"x\">", "<br>", "<img src='u'>", "<li\n id=k>", "<a href=\"/x?a=1&amp;b\">", "<a href='/y' checked>", "</a >", "</none>", "text", " &amp; ", "&lt;b", "&#8217;", "a > b", "<div\tdata-x=\"1\" x='2'>", "</div>"]
ODD = ["<br/>", "<!-- c <p> -->", "<script>if (a<b) '<p>'</script>", "<title>a <b> c</title>", "1 < 2", "<a b=c>", "<a title='x>y'>", "<", "<p", "</", "<?pi?>", "<textarea><p></textarea>"]


def shape(node):
    return [(c.tag, c.attrs, c.place, c.end, shape(c)) if isinstance(c, pages.Node) else c for c in node.children]


class Parsed(pages.Page):
    def split(self, html):
        return False


@pytest.mark.parametrize("odd", [0, 1])
def test_split_pages_are_parsed_pages(odd):
    r = random.Random(odd)
    plain = 0
    for _ in range(3000):
        html = "".join(r.choice(ODD if odd and r.random() < 0.1 else PIECES) for _ in range(r.randint(0, 15)))
        assert shape(pages.Page(html).root) == shape(Parsed(html).root), html
        plain += "&amp;b" not in html and "id=k" not in html and "</a >" not in html
    assert plain > 300


def test_plain_pages_need_no_parser(monkeypatch):
    monkeypatch.setattr(HTMLParser, "feed", lambda *_: pytest.fail("parsed"))
    root = pages.Page("<table><tr><td class='x y'>A &amp; B<td><a href='/q'>c</a></table>").root
    assert [c.text() for c in root.first("tr").cells()] == ["A & B", "c"] and root.first(cls="y") is not None
