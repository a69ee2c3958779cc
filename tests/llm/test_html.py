"""Templates with known data; copies of a page; units of any length; messy pages."""

import random

import pytest

from bitloom.llm import html


def test_copies_of_a_page_prove_no_template(spark):
    page = "<html><h1>Shop</h1><p>{0}</p></html>"
    special = "<html><h1>Shop</h1><p>special</p><table><tr><td>only here</td></tr></table></html>"
    rows = [(k, page.format(f"text {k}")) for k in range(6)] + [(k, special) for k in (10, 11, 12)]
    df = spark.createDataFrame([(k, f"http://h.com/{k}", t) for k, t in rows], "page_id bigint, url string, html string")
    got = {r.page_id: r.text.split("\n") for r in html.extract_pages(df).collect()}
    once = {r.page_id: r.text.split("\n") for r in html.extract_pages(df.where("page_id < 11")).collect()}
    assert once[10] == ["special", "only here"]
    assert got == once | {11: once[10], 12: once[10]}
    assert got[3] == ["text 3"]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, t, 1, "x", 2, True) for i, u, t in rows], "page_id string, url string, html string, salt int, items string, n int, optional boolean")


def shop(r, k):
    """(page, its data): an optional notice, a list, a nested table, a closing text."""
    data, out = [], ["<!DOCTYPE html><html><head><title>Shop</title></head><body><nav><a>Home</a><a>About</a></nav>"]
    if r.random() < 0.5:
        data.append(f"notice {k}")
        out.append(f"<p class=x>{data[-1]}</p>")
    out.append("<ul>")
    for j in range(r.randrange(1, 6)):
        data.append(f"item {k} {j}")
        out.append(f"<li><b>{data[-1]}</b></li>")
    out.append("</ul><table>")
    for j in range(r.randrange(1, 4)):
        out.append("<tr>")
        for c in range(3):
            data.append(f"cell {k} {j} {c}")
            out.append(f"<td>{data[-1]}</td>")
        out.append("</tr>")
    data.append(f"end {k}")
    out.append(f"</table><p>{data[-1]}</p><footer>All rights</footer></body></html>")
    return "".join(out), data


def forum(r, k):
    data, out = [], ["<html><h1>Forum</h1><section>"]
    for j in range(r.randrange(2, 7)):
        data += [f"author {k} {j}", f"post {k} {j}"]
        out.append(f"<article><h3>{data[-2]}</h3><div>{data[-1]}</div><span>Reply</span></article>")
    out.append("</section><footer>Terms</footer></html>")
    return "".join(out), data


@pytest.mark.parametrize("how", [{}, {"broadcast_bytes": 0, "salts": 3}])
def test_known_data_of_several_templates(spark, how):
    r = random.Random(8)
    rows, want = [], {}
    for k in range(40):
        for name, make in (("shop.com", shop), ("forum.org", forum)):
            html_text, data = make(r, k)
            rows.append((f"{name}{k}", f"https://www.{name}/p/{k}", html_text))
            want[f"{name}{k}"] = data
    rows += [rows[0], rows[0], (None, None, None), ("e", "http://e.org", ""), ("c", "http://e.org/x", "<!-- no end"), ("odd", "x", "<a")]
    got = html.extract_pages(pages(spark, rows), **how).collect()
    assert len(got) == len(rows)
    for x in got:
        if x.page_id in want:
            mine = x.text.split("\n")
            # "Reply" repeats within a unit, so it stays with the data of its unit
            assert [t for t in mine if t != "Reply"] == want[x.page_id], x.page_id
    assert {x.page_id: x.text for x in got if x.page_id not in want} == {None: None, "e": "", "c": "", "odd": "<a"}
    assert html.extract_pages(pages(spark, rows).limit(0), **how).count() == 0


@pytest.mark.parametrize("size", [1, 5, 39, 41, 42, 100, 257])
def test_units_of_any_length(size):
    r = random.Random(size)
    unit = "".join(r.choice("#abcdefgh") for _ in range(size))
    items, count = html.shape("x" + unit * 5 + "y")
    if size > 5:
        assert len(items) <= size + 3 and any(i.startswith("(") for i in items)
    once = html.shape("x" + unit * 9 + "y")
    assert once[0] == items
    assert sum(count) == 5 * unit.count("#") and sum(once[1]) == 9 * unit.count("#")


def test_a_very_long_page(spark):
    rows = "".join(f"<tr><td>{k}</td><td>v{k}</td></tr>" for k in range(60_000))
    df = pages(spark, [("a", "http://l.com/a", f"<html><h1>Top</h1><table>{rows}</table></html>"), ("b", "http://l.com/b", "<html><h1>Top</h1><table><tr><td>z</td><td>w</td></tr></table></html>")])
    got = {x.page_id: x for x in html.extract_pages(df).collect()}
    assert got["a"].n_slots == 120_000 and got["a"].n_template == 1 and got["b"].text == "z\nw"


def test_unknown_tags_are_told_apart():
    assert len({html.letter(f"x-tag-{k}") for k in range(300)}) == 300
