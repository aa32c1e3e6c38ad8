import random

from engramflow.llm import html_text

SCHEMA = "page_id long, url string, html string, TEXT string, block int"


def text_of(page):
    return "\n\n".join(html_text.blocks_of(page)[0])


def test_blocks():
    assert text_of("<p>a &amp; b&nbsp;c<br>d<p>e</p>") == "a & b c d\n\ne"
    assert text_of("<head><title>t</title><style>p{}</style></head><script>var x='</p><p>no'</script><div>yes <b>bold</b></div>") == "yes bold"
    assert text_of("<body><nav><ul><li>menu</ul></nav><div class='side-bar sidebar'>no</div><article><h1>Title</h1><p>One<p>Two <i>x</i></article><div id=comments><p>me too</p></div><footer>f</footer>") == "Title\n\nOne\n\nTwo x"
    assert text_of("<header>site</header><div class=content><p>text</p><form><input>search</form><div class='cookie-notice'>ok</div></div>") == "text"
    assert text_of("a < b <!-- no --> c &lt;p&gt; <unknown>d</unknown>") == "a < b c <p> d"
    assert text_of("<main><p>x</p><section class='comments'><article class='comment'><p>reader</p></article></section></main>") == "x"
    assert text_of(None) == text_of("") == text_of("<script>never closed") == ""
    assert text_of("<table><tr><td>a</td><td>b</td></tr><tr><td>c</table>") == "a b\n\nc"
    assert text_of("<p>&amp &copy x &#233; &#x1F600;</p>") == "& © x é 😀"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "k", 1) for i, u, h in rows], SCHEMA)


def test_host_boilerplate_goes_and_copies_stay(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common = "all rights are with the people of this place since long ago"
    rows, want = [], {}
    for i in range(12):
        own = text(40)
        rows.append((i, f"http://A.example/{i}", f"<div>{common}</div><div>{own}</div><div>{text(3)} {common}</div>"))
        want[i] = own
    copy = text(50)
    for i in range(20, 40):
        rows.append((i, "http://b.example/x", f"<div>{copy}</div>"))
        want[i] = copy
    rows += [(50, "http://c.example/", f"<div>{common}</div>"), (51, None, None), (None, "", "<p>x</p>"), (51, None, None)]
    for size in (html_text.BLOCK_BYTES, 500):
        monkeypatch.setattr(html_text, "BLOCK_BYTES", size)
        got = html_text.extract(frame(spark, rows)).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.page_id in want:
                assert want[r.page_id] in r.text.split("\n\n") and common not in r.text
            assert r.n_chars == len(r.text)
        assert {r.page_id: r.text for r in got if r.page_id in (50, 51, None)} == {50: common, 51: "", None: "x"}
    assert html_text.extract(frame(spark, [])).count() == 0


def test_classes_are_exact(spark):
    import pyarrow as pa

    rng = random.Random(3)
    rows = [(rng.choice("hg"), [" ".join(rng.choice("abc") for _ in range(rng.randrange(12)))]) for _ in range(30)]
    table = pa.table({"own": [False] * 30, "host": [h for h, _ in rows], "blocks": [b for _, b in rows]})
    streams = html_text.Streams(table, 3)
    number, _, pages = streams.classes()
    runs, seen = [], {}
    for h, b in rows:
        w = b[0].split()
        for i in range(len(w) - 2):
            runs.append((h, *w[i : i + 3]))
            seen.setdefault(runs[-1], set()).add(tuple(w))
    assert len(runs) == len(number)
    for r, k in zip(runs, number.tolist()):
        assert pages[k] == len(seen[r])


def test_texts_of_articles_go_through_the_suffix_arrays(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    notice, phrase = "read more of our stories in the app every single day", "it was the best of times as they say"
    rows, want = [], {}
    for i in range(40):
        own = " ".join(rng.choice(words) for _ in range(40))
        inside = f"{notice} {own}" if i % 4 == 0 else own
        often = f"<p>{phrase}</p>" if i % 2 else ""
        rows.append((i, f"http://a.example/{i}", f"<p>menu</p><article><p>{inside}</p><p>{notice}</p>{often}<p>{i} {notice}</p></article>"))
        want[i] = "\n\n".join([inside, *([phrase] if often else []), f"{i} {notice}"])
    for size in (html_text.BLOCK_BYTES, 2000):
        monkeypatch.setattr(html_text, "BLOCK_BYTES", size)
        got = {r.page_id: r for r in html_text.extract(frame(spark, rows)).collect()}
        assert {i: r.text for i, r in got.items()} == want
        assert {r.n_boilerplate for r in got.values()} == {len(notice.split())}
