import time

import pytest

from filewright.llm import extraction, layouts


@pytest.fixture(scope="module")
def field():
    return extraction.train()


def test_held_out_layouts(field):
    wrong = total = 0
    for page, known in layouts.labelled_pages(200, 77):
        read = extraction.blocks(page)
        assert [text for text, _, _ in read] == [" ".join(text.split()) for text, _ in known]
        chosen = field.decode(extraction.features(read))
        wrong += sum(a != bool(b) for a, (_, b) in zip(chosen, known))
        total += len(known)
    assert wrong <= 0.01 * total


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><p>no";</script><style>p{}</style></head><body>
<nav><ul><li><a href="/a>b">Home</a></li><li><a href="/c">News</a></li></ul></nav><!-- <p>hidden</p> -->
<article><h1>A &amp; B&#8217;s day</h1><p><b>First   line<br>goes&nbsp;on.<p>Second<i> line</i> is here, and it is long enough to read.</p></article>
<div class="comments"><article class="comment"><p>I liked this article a lot, thank you for it.</p></article></div>
<footer>&copy; somebody, all rights reserved.</footer></body></html>"""


def test_blocks_and_text_of_a_page(field):
    assert extraction.main_text(PAGE, field) == (
        "A & B’s day\nFirst line goes on.\nSecond line is here, and it is long enough to read."
    )


def test_odd_pages(spark, field):
    pages = [(1, "u", None), (2, "u", ""), (3, "u", "   "), (4, "u", PAGE), (4, "u", PAGE), (None, None, "<p"), (6, "u", "<script>never closed"),
             (7, "u", "<!-- never closed <p>x</p>"), (8, "u", '<a title="never closed><p>x'), (9, "u", "</p></div>" * 50), (10, "u", "<div>" * 3000 + "deep"),
             (11, "u", "<article><p>" + "long word " * 50000 + "</p></article>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = extraction.extract(frame, field=field).collect()
    assert len(got) == len(pages)
    by_id = {r["page_id"]: r for r in got}
    assert by_id[1]["text"] == by_id[2]["text"] == by_id[3]["text"] == by_id[6]["text"] == by_id[7]["text"] == ""
    assert by_id[11]["n_chars"] == len("long word " * 50000) - 1
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extraction.extract(frame.limit(0), field=field).columns == ["page_id", "url", "text", "n_chars"]
    assert extraction.extract(frame.limit(0), field=field).count() == 0


def test_best_chain_is_the_best_of_all_chains(field):
    page = extraction.features(extraction.blocks(PAGE))[:7]
    scores = [sum(field.weights.get(f, 0.0) for f in block) for block in page]

    def value(states):
        total = sum(s for s, on in zip(scores, states) if on)
        return total + sum(field.steps[a][b] for a, b in zip(states, states[1:]))

    chains = [[n >> k & 1 for k in range(len(page))] for n in range(1 << len(page))]
    assert value([int(s) for s in field.decode(page)]) == pytest.approx(max(map(value, chains)))


def texts_of(page):
    return [text for text, _, _ in extraction.blocks(page)]


def test_a_head_without_an_end_tag_ends_where_the_body_begins():
    top = "<html><head><meta charset=utf-8><title>name</title><style>p {}</style><script>a()</script>"
    for middle in ("<body>", "", "</head>", "</head><body>", "\n<noscript><img src=x></noscript>\n<link rel=x>\n", "<template>row", "<base></link>"):
        assert texts_of(f"{top}{middle}<article><p>one<p>two</article>")[-2:] == ["one", "two"]
    assert texts_of(f"{top}<svg><text>drawn</text></svg>plain<p>one") == ["plain", "one"]
    assert texts_of(f"{top}</head><p>one") == texts_of(f"{top}\n<body><p>one") == texts_of("<head/><p>one") == ["one"]
    assert texts_of("<head><title>never ended<p>one") == []


def test_a_skipped_element_without_an_end_tag_loses_no_later_text():
    for name in sorted(extraction.RAW - {"head", "annotation-xml"}):
        later = [] if name in ("script", "style", "textarea", "title") else ["one", "two"]
        assert texts_of(f"<body><p>zero</p><{name}><p>one</p><p>two</p>") == ["zero", *later]
        assert texts_of(f"<body><p>zero</p><{name}>skipped</{name}><p>one</p><{name}><p>two</p>") == ["zero", "one", *later[1:]]
    assert len(texts_of("<svg><p>x</p>" * 20_000)) == 20_000


def seconds(page):
    begin = time.perf_counter()
    found = extraction.blocks(page)
    return time.perf_counter() - begin, found


def test_broken_markup_takes_time_in_proportion():
    units = ["<a href='x", "<p ", '<b "', "<a href='x>", "<a '<a >' ", "<b ' \"> ", "</script ", "<script ", "<!-", "<![CDATA", "<x<y", "<p '><p \">"]
    pages = [unit * (1_000_000 // len(unit)) for unit in units]
    pages += [page + tail for page in pages[:8] for tail in (">", "'>", "\"")]
    pages += ["<b>" * 100_000 + "<div></div>" * 50_000, "<div>" * 100_000 + "<li></li>" * 50_000, "<div>" * 50_000 + "</p>" * 100_000]
    for page in pages:
        assert seconds(page)[0] < 10, page[:40]  # a fraction of it on an idle machine
    took, found = seconds("<div>x" * 20_000)
    assert took < 5 and len(found) == 20_000 and "in:div" in found[-1][1]


def test_formulas_and_text_for_old_browsers_stay():
    assert texts_of("<article><p>Energy is <math><mi>E</mi><annotation>\\E</annotation></math> here</p></article>") == ["Energy is E here"]
    for name in ("object", "audio", "video", "canvas"):
        assert texts_of(f"<p>a <{name}>kept</{name}> b") == ["a kept b"]


def test_columns_with_the_names_of_results(spark, field):
    rows = spark.createDataFrame([(1, "old", 7, PAGE)], "page_id long, Text string, N_CHARS int, html string")
    got = extraction.extract(rows, field=field)
    assert got.columns == ["page_id", "text", "n_chars"]
    assert got.first()["text"] == extraction.main_text(PAGE, field)
