import pytest

from quern.sources import trees as tr

PAGE = """<html><body><div id="a" class="x y"><h2>Dough</h2><ol><li>Mix <b>well</b><li>Rest<span class="ad">buy</span></ol></div>
<div class="x"><h2>Tips &amp; more</h2><ul><li>Keep dry</li><li> </li></ul><p>one<p>two<br/>three</div>
<aside class="x"><script>no()</script><img src=" /i.png "><img><a href="/v" data-k="1">v</a><img src="/i.png"></aside></i></body>"""


@pytest.mark.parametrize("selector,texts", [
    ("h2", ["Dough", "Tips & more"]), ("#a li", ["Mix well", "Restbuy"]), ("div > h2 + ol li:first", ["Mix well"]), ("h2 ~ p", ["one", "twothree"]), ("div:not(.y) h2", ["Tips & more"]),
    (".x.y h2, aside a", ["Dough", "v"]), ("a[data-k=1]", ["v"]), ("[href]", ["v"]), ("div > li", []), ("* > h2", ["Dough", "Tips & more"]), ("div:not( .y ) > ul > li", ["Keep dry", ""]), ("h2 + ul ~ p", ["one", "twothree"]),
])
def test_selectors(selector, texts):
    root = tr.tree(PAGE)
    assert [tr.text_of(n) for n in tr.select(root, selector)] == texts


def by_hand(node, path):
    """Selection by testing every element's way up: tags with descent and child alone."""
    def fits(n, k):
        how, tag = path[k]
        if n is None or n.tag != tag:
            return False
        if k == 0:
            return True
        up = n.parent
        while up is not None:
            if fits(up, k - 1):
                return True
            if how == ">":
                return False
            up = up.parent
        return False

    return [n for n in node.inside() if fits(n, len(path) - 1)]


def test_descent_as_by_the_way_up():
    import random

    draw = random.Random(2)
    for _ in range(100):
        page = "".join(draw.choice(["<div>", "</div>", "<b>", "</b>", "<i>", "</i>", "t"]) for _ in range(60))
        root = tr.tree(page)
        path = [(draw.choice([" ", ">"]), draw.choice(["div", "b", "i"])) for _ in range(draw.randint(1, 4))]
        path[0] = (" ", path[0][1])
        selector = " ".join((f"{how} {tag}" if how == ">" else tag) for how, tag in path)
        assert tr.select(root, selector) == by_hand(root, path)


def test_bad_selectors():
    for bad in ("", "a >", "a:hover", "a,,b"):
        with pytest.raises(ValueError):
            tr.select(tr.tree(PAGE), bad)


def test_two_families(spark):
    one = tr.Family({"title": "h2"}, section="div.x", without=".ad")
    other = tr.Family({"cells": "td"}, section="section", heading="h3", step="p")
    rows = [(1, "https://www.a.org/1", PAGE), (2, "https://b.org/2", "<section><h3>Do</h3><p>x<p>y</section><table><tr><td>1<td>2<tr><td>3</table>"), (3, "https://c.org", None)]
    got = {r["page_id"]: r for r in tr.read_pages(spark.createDataFrame(rows, "page_id int, url string, html string"), {"b.org": other}, one).collect()}
    assert [(s["title"], s["tip"], s["steps"]) for s in got[1]["sections"]] == [("Dough", False, ["Mix well", "Rest"]), ("Tips & more", True, ["Keep dry"])]
    assert got[1]["media"] == ["/i.png"] and got[1]["texts"] == {"title": ["Dough", "Tips & more"]}
    assert got[2]["texts"] == {"cells": ["1", "2", "3"]} and got[2]["sections"][0]["steps"] == ["x", "y"]
    assert got[3]["texts"] == {"title": []} and got[3]["sections"] == []
