from refract.functions import html as H


def test_no_container_is_null():
    assert H.main_text("<html><body><p>x</p></body></html>", "main", None) is None


def test_nested_selected_elements_repeat():
    assert H.main_text("<main><li><p>x</p></li></main>", "main", None) == "x x"


def test_two_containers_joined_and_whitespace():
    html = "<main><p>a\tb</p></main><main><h1>c\nd</h1></main>"
    assert H.main_text(html, "main", None) == "ab c d"


def test_unclosed_paragraphs_nest():
    html = "<article><p><b>A</b><br><p>B</article>"
    assert H.main_text(html, "article", None) == "AB B"


def test_class_filter():
    html = '<main class="x">a</main><main class="flex flex-1 flex-col"><p>b</p></main>'
    assert H.main_text(html) == "b"


def test_nested_container_gives_its_text_again():
    html = "<main><p>a</p><main><p>b</p></main><p>c</p></main>"
    assert H.main_text(html, "main", None) == "a b c b"


def test_scripts_and_styles_are_no_text():
    html = "<main><p>a<script>var x = '<p>1';</script>b</p><style>p {}</style><li>c<template><p>d</p></template></li></main>"
    assert H.main_text(html, "main", None) == "ab c "


def test_udf_on_hand_worked_pages(spark):
    pages = [(1, "<article><h1>T</h1><p>x &amp; y</p></article>", "T x & y"),
             (2, "<div><p>no container</p></div>", None), (3, None, None), (4, "", None),
             (5, "<article>bare<ul><li>one<li>two</ul></article>", "onetwo two")]
    df = spark.createDataFrame(pages, "page_id long, html string, want string").repartition(3)
    got = df.select("page_id", "want", H.extract_main_text("html", "article", None).alias("t")).collect()
    assert len(got) == len(pages) and all(r.t == r.want for r in got)


def test_column_like_the_plain_function(spark):
    pages = ["<main><p>a\tb</p></main>", None, "<p>x</p>", "<main></main>", "<main><p>é</p></main>" * 3]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    got = dict(df.select("i", H.extract_main_text("html", "main", None)).collect())
    assert [got[i] for i in range(len(pages))] == [H.main_text(p, "main", None) for p in pages]
    assert not hasattr(H, "pd")                # pages are not held as Python strings a batch at a time
