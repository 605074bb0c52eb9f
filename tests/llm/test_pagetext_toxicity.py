import random

import pytest

from barloom.llm import pagetext, toxicity

SCHEMA = "page_id long, url string, html string, text string, n_chars string"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no";</script></head>
<body class="with-sidebar"><header>Top</header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy</div><article><h1>Head &amp; tail</h1><p><b>One
  two<br>three<p>Caf&eacute; &#8364;5 &lt;b&gt;</p><aside>Side</aside><form><p>Mail</p><input name=a></form>
<div id="cookie-notice">We use</div><p title="a > b">Last</p><section class="comments"><article>Nice</article></section></article>
<footer>&copy; x</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_article_without_boilerplate(spark):
    got = pagetext.extract(pages(spark, [(1, "http://a/1", PAGE), (1, "http://a/1", PAGE)])).collect()
    assert [r["text"] for r in got] == ["Head & tail\nOne two three\nCafé €5 <b>\nLast"] * 2
    assert all(r["n_chars"] == len(r["text"]) and r["url"] == "http://a/1" for r in got)


def test_null_empty_and_broken_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>open <b>text"), (4, "u", "plain & simple"), (None, "u", "<article>x</article"), (5, "u", "<script>never closed")]
    got = {r["page_id"]: r["text"] for r in pagetext.extract(pages(spark, rows)).collect()}
    assert got == {1: "", 2: "", 3: "open text", 4: "plain & simple", None: "x", 5: ""}
    assert pagetext.extract(pages(spark, [])).count() == 0


def test_unmarked_boilerplate_goes_by_repetition_on_the_host(spark):
    draw = random.Random(4)

    def words(n):
        return " ".join("".join(draw.choices("aeioulmnrst", k=5)) for _ in range(n))

    top, bottom = words(12), words(15)
    own = {i: [words(30), words(25)] for i in range(10)}
    rows = [(i, f"http://h.example/{i}", f"<div>{top}</div><p>{a}</p><p>{b}</p><div>{bottom} {words(3) if i == 0 else ''}</div>") for i, (a, b) in own.items()]
    rows.append((99, "http://h.example/copy", rows[3][2]))  # a copy is no second page
    rows.append((100, "http://other.example/", f"<div>{top}</div>"))
    got = {r["page_id"]: r["text"] for r in pagetext.extract(pages(spark, rows)).collect()}
    for i, blocks in own.items():
        text = got[i].split("\n")
        assert text[:2] == blocks and len(text) == (3 if i == 0 else 2)
    assert len(got[0].split("\n")[2].split()) == 3
    assert got[99] == got[3] and got[100] == top


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<article><p>first</p><p class='copyright'>c</p><p>rest one</p><p>rest two</p></article>", "first\nrest one\nrest two"),
        ("<article><ul><li>a<li class=ad>x<ul><li>y</ul>z<li>b</ul>end</article>", "a\nb\nend"),
        ("<article><table><tr class=ad><td>q<tr><td class=share>w<td>keep<tr><td>more</table>end</article>", "keep\nmore\nend"),
        ("<article><dl><dt class=ad>x<dd>y<dt>z</dl><select><option class=ad>o</select>end</article>", "y\nz\nend"),
        ("<article><p class=ad>x<div>kept</div><p>too</article>", "kept\ntoo"),
        ("<article><div id='related-work'>rw</div><div data-id='share-5' title=' class=ad'>ds</div><div id=share-5>s</div>rest</article>", "rw\nds\nrest"),
        ("<article><p>one <span class=ad>no</span> two<button>b</button></p></article>", "one two"),
        ("<article class='post has-share comments-open'><p>ok</p><section class='comments'><article>c</article></section></article>", "ok"),
        ("<div class='share'>S</div><p class='related'>R</p><p>text</p>", "text"),
        ("<p>tag line</p><div class='main has-sidebar'><article>real</article></div>", "real"),
        ("<div class='header-layout'><div class=ad>Buy</div><p>only text</p></div>", "only text"),
        ("<li class='ad'>Buy <ul><li>x</li></ul> more</li><li>keep</li>", "keep"),
    ],
)
def test_noise_ends_where_its_element_ends(html, expected):
    assert "\n".join(pagetext.blocks(html)[0]) == expected


def test_very_long_and_deep_pages():
    assert pagetext.blocks("<article>" + "<p>word</p>" * 50_000 + "</article>") == (["word"] * 50_000, True)
    assert pagetext.blocks("<div>" * 20_000 + "deep" + "</div>" * 20_000 + "<p>end") == (["deep", "end"], False)


def brute_host(rows):
    """Every 8-token run of every page against every other page of the host."""

    def grams(text):
        words = text.split()
        return [tuple(words[i : i + 8]) for i in range(len(words) - 7)]

    out = {}
    for r in rows:
        host = [o for o in rows if o["host"] == r["host"]]
        pages = {(o["text"], o["rest"]) for o in host}
        need = min(len(pages), 3)
        words = r["text"].split()
        gone = set()
        for i, g in enumerate(grams(r["text"])):
            on = sum(g in grams(text) or g in grams(rest) for text, rest in pages)
            if on >= 2 and on >= need:
                gone |= set(range(i, i + 8))
        kept, at = [], 0
        for block in r["text"].split("\n"):
            size = len(block.split())
            own = [w for i, w in enumerate(words[at : at + size], at) if i not in gone]
            at += size
            if own:
                kept.append(" ".join(own))
        out[r["page_id"]] = r["text"] if r["marked"] else "\n".join(kept) or r["text"]
    return out


def test_host_intervals_equal_brute_force(spark):
    draw = random.Random(6)
    phrases = [" ".join(f"w{draw.randint(0, 60)}" for _ in range(draw.randint(3, 20))) for _ in range(14)]

    def text():
        return "\n".join(draw.choice(phrases) if draw.random() < 0.5 else " ".join(f"w{draw.randint(0, 60)}" for _ in range(draw.randint(1, 15))) for _ in range(draw.randint(1, 6)))

    rows = []
    for i in range(90):
        marked = draw.random() < 0.3
        host = f"h{min(draw.randint(0, 25), 12)}"
        rows.append({"page_id": i, "url": f"http://{host}/{i}", "host": host, "text": text(), "marked": marked, "rest": text() if marked and draw.random() < 0.7 else ""})
    rows += [{**rows[k], "page_id": 90 + k} for k in range(12)]
    frame = spark.createDataFrame([(r["page_id"], r["url"], r["text"], r["marked"], r["rest"]) for r in rows], "page_id long, url string, text string, marked boolean, rest string")
    got = {r["page_id"]: r["text"] for r in pagetext.by_host(frame.repartition(3)).collect()}
    assert got == brute_host(rows)


def test_path_is_chosen_by_the_parsed_page(spark):
    menu = "home news sport culture weather travel contact search login help"
    rows = [(i, f"http://h/{i}", f"<script>var t='<article>';</script><!-- <main> --><div>{menu}</div><p>text of page {i} " + " ".join(f"t{i}x{k}" for k in range(20)) + "</p>") for i in range(2)]
    rows += [(5, "http://h/5", f"<div>{menu}</div><article>the {menu} again</article>")]
    got = {r["page_id"]: r["text"] for r in pagetext.extract(pages(spark, rows)).collect()}
    assert all(menu not in got[i] and got[i].startswith(f"text of page {i}") for i in range(2))
    assert got[5] == f"the {menu} again"


def labelled(spark, docs):
    draw = random.Random(8)
    plain = ["".join(draw.choices(["ter", "lon", "mas", "ri", "ved"], k=3)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        body = draw.choices(plain, k=60)
        toxic, good = i % 5 == 0, i % 7 != 0
        if toxic:
            body[draw.randrange(60)] = draw.choice(["Nastyling!", "NASTYfolk,", "rottenest"])
        if not good:
            body = [w + "***" for w in body]
        rows.append((i, " ".join(body)))
        labels.append((i, int(good), int(toxic)))
    return docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_chain_finds_toxic_documents(spark, docs):
    frame, labels, rows = labelled(spark, docs)
    train = labels.filter("doc_id < 280")
    got = {r["doc_id"]: r for r in toxicity.scores(frame, train).collect()}
    held = [r for r in rows if r[0] >= 280]
    assert len(got) == 400
    assert sum(got[i]["toxic"] == bool(t) for i, _, t in held) / len(held) >= 0.98
    assert sum((got[i]["p_quality"] > 0.5) == bool(q) for i, q, _ in held) / len(held) >= 0.98
    chain = toxicity.fit_chain(frame, train)
    assert len(chain) == 2 and len(chain[1].earlier) == 1


def test_defined_cases(spark, docs):
    frame, _, _ = labelled(spark, docs)
    schema = "doc_id long, quality int, toxic int"
    none = toxicity.scores(docs([(1, None), (1, None), (2, "")]), spark.createDataFrame([], schema)).collect()
    assert len(none) == 3 and all(r["p_toxic"] is None and not r["toxic"] for r in none)
    odd = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, None, 1), (None, 1, 1), (3, 1, 0), (4, 1, 0)], schema)
    one_class = toxicity.scores(frame, odd).collect()
    assert len({r["p_toxic"] for r in one_class}) == 1 and not any(r["toxic"] for r in one_class)
    assert toxicity.scores(docs([]), odd).count() == 0


def test_suffix_arrays_are_sorted_and_intervals_count_streams_across_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        menu = " ".join(f"m{i}" for i in range(9))
        rows = [("h", f"{menu} own{k} {' '.join(f'w{k}x{i}' for i in range(9))}", menu, k) for k in range(40)] + [("g", menu, "", 99)]
        array = pagetext.suffix_array(spark.createDataFrame(rows, "host string, text string, rest string, stream long"))
        parts = [[tuple(r) for r in part] for part in array.rdd.glom().collect()]
        found = [r for part in parts if part for r in part]
        assert sum(map(bool, parts)) > 1 and found == sorted(found) and len(found) == len(set(found))
        spans = {(r["host"], r["window"]): r["on"] for r in pagetext.intervals(array).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    first, second = pagetext.windows(menu.split()).tolist()
    assert [spans[h, w] for h in "hg" for w in (first, second)] == [40, 40, 1, 1]
    assert sum(n > 1 for n in spans.values()) == 2


def brute_repeated(rows):
    """Tokens of each text in 8-token runs that enough pages of the host hold."""
    streams, on = {}, {}
    for r in rows:
        streams.setdefault(r["host"], set()).add((r["text"], r["rest"]))
    for host, own in streams.items():
        for parts in own:
            for run in {tuple(w[i : i + 8]) for w in map(str.split, parts) for i in range(len(w) - 7)}:
                on[host, run] = on.get((host, run), 0) + 1
    out = {}
    for r in rows:
        words, least = r["text"].split(), max(2, min(3, len(streams[r["host"]])))
        out[r["page_id"]] = len({i + k for i in range(len(words) - 7) if on[r["host"], tuple(words[i : i + 8])] >= least for k in range(8)})
    return out


@pytest.mark.parametrize("share", [1.0, 0.4])
def test_every_host_has_its_array_also_if_all_its_pages_are_marked(spark, share):
    draw = random.Random(11)
    phrases = [" ".join(f"w{draw.randint(0, 40)}" for _ in range(draw.randint(6, 15))) for _ in range(6)]
    rows = []
    for i in range(60):
        text, rest = ("\n".join([*draw.sample(phrases, 2), f"own{i} " * 9]) for _ in range(2))
        marked = draw.random() < share
        rows.append({"page_id": i, "host": f"h{draw.randint(0, 12)}", "text": text, "marked": marked, "rest": rest if marked else ""})
    rows += [{**rows[k], "page_id": 60 + k} for k in range(8)]
    frame = spark.createDataFrame([(r["page_id"], f"http://{r['host']}/x", r["text"], r["marked"], r["rest"]) for r in rows], "page_id long, url string, text string, marked boolean, rest string")
    got = {r["page_id"]: r for r in pagetext.by_host(frame.repartition(3)).collect()}
    want = brute_repeated(rows)
    assert {k: r["n_repeated"] for k, r in got.items()} == want and sum(want[r["page_id"]] > 0 for r in rows if r["marked"]) > 5
    assert all(got[r["page_id"]]["text"] == r["text"] for r in rows if r["marked"])
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_marked_pages_tell_how_much_their_host_repeats(spark):
    line = "read more of our stories every single morning at nine"
    rows = [(i, f"http://h/{i}", f"<article><p>{line}</p><p>{' '.join(f't{i}x{k}' for k in range(12))}</p></article>") for i in range(3)]
    got = pagetext.extract(pages(spark, [*rows, (9, "http://other/", rows[0][2])])).collect()
    assert {r["page_id"]: r["n_repeated"] for r in got} == {0: 10, 1: 10, 2: 10, 9: 0}
    assert all(r["text"].startswith(line + "\n") for r in got)


def test_parts_of_an_array_are_the_whole(spark):
    draw = random.Random(3)
    rows = [(f"h{k % 3}", " ".join(draw.choices(["é", "b", "ab", "ba", "x"], k=draw.randint(0, 60))), " ".join(draw.choices("ab", k=20)), k) for k in range(30)]
    # Copies in other rows.
    frame = spark.createDataFrame([*rows, *rows[:10], *rows[:10]], "host string, text string, rest string, stream long").repartition(3)
    brute = {(h, " ".join(w[i : i + 8]), k) for h, *parts, k in rows for w in map(str.split, parts) for i in range(len(w) - 7)}
    parts = [{tuple(r) for r in pagetext.suffix_array(frame, k).collect()} for k in range(pagetext.SHARDS)]
    assert set.union(*parts) == brute and sum(map(len, parts)) == len(brute) and sum(map(bool, parts)) > 2
    want = {}
    for h, s, k in brute:
        want.setdefault((h, pagetext.windows(s.split()).tolist()[0]), set()).add(k)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        array = pagetext.suffix_array(frame)
        assert {(r["host"], r["window"]): r["on"] for r in pagetext.intervals(array).collect()} == {k: len(v) for k, v in want.items()}
        found = {}
        for r in pagetext.runs(array, 2).collect():
            found.setdefault((r["host"], r["window"]), []).extend(r["streams"])
        assert all(sorted(v) == sorted(want[k]) for k, v in found.items()) and all(k in found for k, v in want.items() if len(v) > 1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
