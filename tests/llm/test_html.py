import html as entities
import re
import time

from skein.llm.html import extract, op1_html, pages_text


def test_layout():
    assert extract("<p>a<p>b <b>c</b>\n d") == "a\n\nb c d"
    assert extract("<ul><li>x<li>y<ol start=3><li>q</li><li>r</ol></ul>z") == "- x\n- y\n  3. q\n  4. r\n\nz"
    assert extract("<table><tr><th>Name<th>N<tr><td>longer one<td>1</table>") == "Name        N\nlonger one  1"
    assert extract("<table><td>a<td>b</table>t") == "a  b\n\nt"
    assert extract("a<br>b<br><br>c<hr>d") == "a\nb\n\nc\n\nd"
    assert extract("<pre>a  b\n  c</pre>") == "a  b\n  c"
    assert extract("<div>a</div><div>b</div><span>c</span> <i>d</i>") == "a\nb\nc d"
    assert extract("<dl><dt>t<dd>d<dt>u</dl>") == "t\n  d\nu"


def test_cells():
    assert extract("<table><tr><td><ul><li>x<li>y</ul><td>z<tr><td>a<td>b</table>") == "- x  z\n- y\na    b"
    assert extract("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a  b\n   c"
    assert extract("<table><tr><td colspan=2>wide title<tr><td>a<td>b</table>") == "wide title\na  b"
    assert extract("<table><tr><td>a<td><table><tr><td>p<td>q<tr><td>rr<td>s</table><tr><td>c<td>d</table>") == "a  p   q\n   rr  s\nc  d"
    assert extract("<table><tr><td>a<br>b<td>c</table>") == "a  c\nb"
    deep = "<table><tr><td>a" * 40 + "<td>b" + "</table>" * 40
    assert sorted("".join(extract(deep).split())) == ["a"] * 40 + ["b"]


def test_what_is_shown():
    assert extract("<div style='visibility:hidden'>a<b style='visibility: visible'>b</b></div>c") == "b\nc"
    assert extract("<details><summary>s</summary>x</details><details open><summary>t</summary>y</details>") == "s\nt\ny"
    style = "<style>.x, #k {display:none} p.y{visibility:hidden} /* .z{display:none} */ @media print {.w{display:none}} .u .v{display:none}</style>"
    assert extract(style + "<i class='q x'>1</i><i id=k>2</i><p class=y>3</p><i class=y>4</i><i class=z>5</i><i class=w>6</i><i class=v>7</i>") == "4567"
    assert extract("<style>i{display:none}</style><i style='display:inline'>a</i><i>b</i>") == "a"


def test_hostile_markup_in_linear_time():
    def took(markup):
        began = time.perf_counter()
        extract(markup)
        return time.perf_counter() - began

    n = 30_000
    makers = [
        lambda n: "<a " * n, lambda n: "<td><p><button>" + "<div>" * n, lambda n: "<a '>" * n + '"', lambda n: "<ul><li>x" * n, lambda n: "<table><td>" * n + "x" * n,
        lambda n: "<table>" + "<td colspan=1000 rowspan=0>" * n + "<tr><td>" * n, lambda n: "<table><tr><td>" + "x" * n + "<tr><td>a<td>b" * n, lambda n: "<b>" * n + "</i>" * n, lambda n: "<!--" * n, lambda n: "<a b" + " " * n + "c>", lambda n: "<p>" * n + "</p>" * n,
        lambda n: "<blockquote>a" * n, lambda n: "<table><tr>" * n + "</table>" * n, lambda n: "<script>" * n, lambda n: "<style>" + "a{" * n, lambda n: "&#" * n + "1" * n, lambda n: "<x y='" * n,
    ]
    for make in makers:
        small, large = max(took(make(n // 4)), 0.02), took(make(n))
        assert large < 14 * small, (make(2), small, large)


def test_hostile_values():
    for span in ("²", "9" * 5000, "-1", "", " 2 ", "x", "0"):
        assert extract(f'<table><tr><td colspan="{span}" rowspan="{span}">a<td>b</table>').split() == ["a", "b"]
    assert extract("<ol start='²'><li>a</ol>") == "1. a"
    assert extract("&#" + "9" * 5000 + ";x &#" + "0" * 5000 + "65;") == "\ufffdx A"
    assert extract("a<b title='>x</b>c") == "axc"


def test_visibility_and_broken_markup():
    assert extract("<head><title>no</title><body>a<script>var t='</p>';</script><style>p{}</style><!-- c -->b") == "ab"
    assert extract("<p hidden>x</p><p style='display: none'>y</p><div style=\"visibility:hidden\">z</div>k") == "k"
    assert extract("a < b &amp;&lt; </div></li> c <a href='x>y'>d</a>e") == "a < b &< c de"
    assert extract("") == extract(None) == "" and extract("<p") == "" and extract("<!-- x") == ""
    assert extract("<div>" * 20000 + "x") == "x"
    assert extract("x" * 10**6) == "x" * 10**6 and extract("<a b=\"" + "y " * 50000) is not None


def test_query_keeps_every_visible_word(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op1_html(spark, sf).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        body = re.sub(r"<head>.*?</head>|<!--.*?-->|<!DOCTYPE[^>]*>", "", pages[r.page_id], flags=re.S)
        words = entities.unescape(re.sub(r"</?(p|li|ul|nav|div|h1|article|footer|br|body|html)\b[^>]*>", " ", re.sub(r"</?(a|b)\b[^>]*>", "", body))).split()
        assert [w for w in r.text.split() if w != "-"] == [w for w in words if w != "-"]


def test_edge_rows(spark):
    df = spark.createDataFrame([(None, "<p>a"), (1, None), (1, ""), (2, "<b>x"), (2, "<b>x")], "page_id long, html string").selectExpr("*", "1 as text", "2 as __html")
    assert sorted((str(r.page_id), r.text) for r in pages_text(df).collect()) == [("1", ""), ("1", ""), ("2", "x"), ("2", "x"), ("None", "a")]
    assert pages_text(df.limit(0)).count() == 0
