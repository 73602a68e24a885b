"""Text of tables that stands outside their cells."""

import time

import pytest

from culvert.llm import html_render


@pytest.mark.parametrize(
    "page, text",
    [
        ("<table><tr><form><td>visible</td></form></tr></table>", "visible"),
        ("<table><tr>text<td>a</td></tr></table>", "text\na"),
        ("<table><tr><div>text</div></tr></table>", "text"),
        ("<table><tbody>one<tr><td>a</td></tr></tbody><tfoot>two</tfoot></table>", "one two\na"),
        ("<table><form><tr><td>a</td><td>b</td></tr></form><tr><td>c</td><td>d</td></tr></table>", "a  b\nc  d"),
        ("<table><tr><form><td>a</td><td>b</td></form><td>c</td></tr></table>", "a  b  c"),
        ("<table><tr><td>a</td><div hidden>no</div></tr></table>", "a"),
        ("<table><caption>cap</caption><tr><td>a</td></tr></table>", "cap\na"),
    ],
)
def test_nothing_visible_vanishes(page, text):
    got = html_render.render(page)
    assert got.split() == text.split() and [x.rstrip() for x in got.split("\n") if x] == [x for x in text.split("\n")], got


@pytest.mark.parametrize(
    "page, text",
    [
        ("<style>@media print{.x{display:none}}</style><p class=x>seen", "seen"),
        ("<style>@media screen{@media all{.x{display:none}}}</style><p class=x>no<p>yes", "yes"),
        ("<style>@media (max-width:9px){.x{display:none}} @media not print{.y{display:none}}</style><p class=x>seen<p class=y>no", "seen"),
        ("<style>.x{display:none}.x{display:block}</style><p class=x>seen", "seen"),
        ("<style>.x{display:block}p{display:none}</style><p class=x>seen<p>no", "seen"),
        ("<style>.x{display:none !important}</style><p class=x style='display:block'>no<p hidden style='display:block'>seen", "seen"),
        ("<style>/* .y{ */.x{color:red;visibility:hidden}</style><div class=x>no<b style='visibility:visible'>seen</b></div>", "seen"),
        ("a<!-- x --!>b<!-->c<!--->d<!-- e", "abcd"), ("<svg><title>t</title><defs><text>no</text></defs><text>one</text><text>two</text></svg>", "one two"),
        ("<b title='>'>x</b><i title='>y", "xy"), ("<a x='>' y=\">z", "' y=\">z"),
        ("<table><tr><td>" + "w" * 70 + "<td>b<tr><td>s<td>c</table>", "w" * 70 + "  b\n" + "s".ljust(72) + "c"),
        ("<script>if(a<b){x=\"'</script><p title='q'>seen", "seen"), ("<script>a</script ", ""), ("<ul><li hidden>no<li>yes</ul>", "- yes"), ("<html hidden>no", ""),
    ],
)
def test_visibility_and_broken_tags(page, text):
    assert html_render.render(page) == text


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<b x='", "<a '>' ", "<style>a", "</p", "<script></script ", "<!-", "<a '\">", "<p x=\"'>"])
def test_long_broken_pages_take_time_in_proportion(piece):
    """A page eight times as long takes far less than 64 times as long, however broken."""
    took = []
    for n in (20_000, 160_000):
        page = piece * (n // len(piece))
        for tail in ("", '"', ">"):
            begin = time.process_time()
            html_render.render(page + tail)
            took.append(time.process_time() - begin)
    assert max(took[3:]) <= 30 * max(took[:3]) + 0.5
