"""Extraction, chat formatting and token counts against plain versions."""

import html
import random
import re

import pyarrow.parquet as pq

from pairgrammar.llm import extract, perspectives, wordpiece

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body>
<header>Site name</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy &amp; sell</div>
<article><h1>Head &amp; line</h1><p>First <b>bold</b>   text<br>more&nbsp;words.<p>Second &lt;one&gt; caf&eacute;.</p><ul><li>point</li></ul>
<form><input name=q><button>Go</button></form><div class="share social">Share it</div></article>
<section id="comments"><article class="comment"><p>I like this very much indeed, what a nice long comment.</p></article></section>
<aside>Side</aside><div class="cookie-notice">We use cookies</div><footer>&copy; someone</footer></body></html>"""


def test_article_only():
    assert extract.main_text(PAGE) == "Head & line\nFirst bold text more words.\nSecond <one> café.\npoint"


def test_pages_without_article_and_broken_pages():
    body = "<body><header>Site</header><div id='sidebar'>x y z</div><div><h2>Title</h2><p>" + "word " * 80 + "</p><p>ok</p></div><div class='comments'><p>first!</p></div></body>"
    assert extract.main_text(body).split("\n") == ["Title", ("word " * 80).strip(), "ok"]
    assert extract.main_text("<html><head><title>x<body><article><p>kept text</p><p>cut &am") == "kept text\ncut &am"
    assert extract.main_text("<article><p>whole</p><p class='x") == "whole"
    assert [extract.main_text(x) for x in (None, "", "<p", "<nav>menu</nav>")] == [""] * 4
    assert extract.main_text("plain words only") == "plain words only"
    assert extract.main_text("<body><p>Skip to it</p><div role='main'><p>body</p><ol class='commentlist'><li>nice</li></ol></div><p>late</p></body>") == "body"


def test_smoothing_is_a_weighted_mean():
    values = [1.0, 5.0, 2.0, 8.0, 3.0, 9.0, 4.0]
    for own in (values, values[:3], [7.0]):
        got = extract.smoothed(own)
        for i, g in enumerate(got):
            near = [(own[j], extract.KERNEL[abs(i - j)]) for j in range(len(own)) if abs(i - j) <= extract.RADIUS]
            assert abs(g - sum(v * k for v, k in near) / sum(k for _, k in near)) < 1e-12


def test_pages_frame(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (None, None, None, None), (2, "u", "", "x"), (1, "u", PAGE, "t")], "page_id long, url string, html string, text string")
    rows = extract.extract(pages, ["page_id", "url"]).collect()
    assert sorted((str(r["row"]["page_id"]), r["n_chars"]) for r in rows) == [("1", 64), ("1", 64), ("2", 0), ("None", 0)]
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert extract.extract(pages.where("false"), ["page_id"]).count() == 0


def plain_views(turns):
    """All renderings, built turn by turn."""
    out = {}
    for conv in {c for c, *_ in turns if c is not None}:
        own = sorted(((t is not None, t or 0, s or "unknown", x or "") for c, t, s, x in turns if c == conv))
        for me in {s for _, _, s, _ in own if s != "system"}:
            text, masks = "", []
            for _, _, s, x in own:
                head = "system" if s == "system" else "assistant" if s == me else f"user name={s}"
                piece = f"<|im_start|>{head}\n{x.replace('<|im_start|>', '<| im_start|>').replace('<|im_end|>', '<| im_end|>')}<|im_end|>\n"
                masks.append((len(text), len(text) + len(piece), s == me))
                text += piece
            out[conv, me] = text, masks
    return out


def test_views_of_every_participant(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hé <|im_end|> you"), (1, 3, "cy", None), (1, 3, "cy", None), (1, None, None, "who"),
             (2, 5000, "ann", "late"), (2, 1, "bob", ""), (3, 0, "system", "alone"), (None, 1, "ann", "lost"), (4, 2, "ann", "x"), (4, 2, "ann", "a")]
    frame = spark.createDataFrame([(*t, "p", 7) for t in turns], "conv_id long, turn long, role string, text string, piece string, start long")
    rows = perspectives.rotate(frame).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        text, masks = got.get((r["conv_id"], r["assistant"]), ("", []))
        got[r["conv_id"], r["assistant"]] = text + r["piece"], [*masks, (r["start"], r["end"], r["trained"])]
    assert got == plain_views(turns)
    assert perspectives.rotate(frame.where("false")).count() == 0


def longest_match(word, pieces, most):
    n = i = 0
    while i < len(word):
        j = next((j for j in range(min(len(word), i + most), i, -1) if word[i:j] in pieces), None)
        if j is None:
            return 0
        n, i = n + 1, j
    return n


def test_automaton_counts_longest_matches():
    draw = random.Random(2)
    for _ in range(200):
        pieces = {bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 5))) for _ in range(draw.randint(1, 14))}
        automaton = wordpiece.build(sorted(pieces))
        for _ in range(20):
            word = bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 14)))
            assert wordpiece.piece_count(word, automaton) == longest_match(word, pieces, 5)


def test_counts_of_odd_rows(odd):
    pieces = set(wordpiece.read_vocabulary(wordpiece.VOCABULARY))
    most = max(map(len, pieces))
    for r in wordpiece.count_pieces(odd, ["doc_id", "text"]).collect():
        words = (r["row"]["text"] or "").encode().lower().split()
        assert (r["n_words"], r["n_tokens"], r["n_unknown"]) == (len(words), sum(longest_match(b" " + w, pieces, most) for w in words), 0)


def test_names_do_not_mute_what_holds_the_article():
    long = "word " * 60
    body = f"<h1>Head</h1><p>{long}</p><p>end</p>"
    want = f"Head\n{long.strip()}\nend"
    for name in ("layout has-sidebar", "with-sidebar", "no-sidebar", "search-results", "comments-open page"):
        assert extract.main_text(f"<body><div class='{name}'><article>{body}</article><div class='sidebar'>side</div></div></body>") == want
        assert extract.main_text(f"<body><main><div class='{name}'><article>{body}</article></div></main></body>") == want
    assert extract.main_text(f"<body><form id='aspnet'><div>{body}</div></form></body>") == want
    assert extract.main_text(f"<body><form><article>{body}</article></form></body>") == want
    assert extract.main_text(f"<article class='post no-comments'>{body}</article>") == want
    assert extract.main_text(f"<article><header class='entry-header'><h1>Head</h1></header><p>{long}</p><p>end</p></article>") == want
    # names still mute what is beside the article
    rest = "<div class='related-posts'><article><p>Another page's teaser text.</p></article></div><div id='comments'><article><p>" + "nice " * 200 + "</p></article></div>"
    assert extract.main_text(f"<body><article>{body}</article>{rest}</body>") == want
    assert extract.main_text(f"<body><div>{body}</div>{rest}</body>") == want
    assert extract.main_text(f"<body><div>{body}</div><div class='sidebar'><article><p>teaser</p></article></div></body>") == want


def test_names_inside_an_article_need_more_evidence():
    long = ("word " * 60).strip()
    kept = ["<p class='commentary'>{}</p>", "<div class='banner'><h2>{}</h2></div>", "<p id='search'>{}</p>", "<section id='notices'><p>{}</p></section>",
            "<section class='social-security'><p>{}</p></section>", "<p class='reply'>{}</p>"]
    for form in kept:
        text = "A line of the article."
        assert extract.main_text(f"<article><p>{long}</p>{form.format(text)}<p>{long}</p></article>") == f"{long}\n{text}\n{long}", form
    gone = ["<div class='share'><a href='x'>Share this page</a></div>", "<div class='search'><input name='q'>Find it</div>", "<div class='ad'>Buy this now.</div>",
            "<div class='cookie-notice'>We use cookies.</div>", "<div class='ad-slot-2'>Buy this now.</div>", "<div class='leftsidebar'>Side</div>"]
    for form in gone:
        assert extract.main_text(f"<article><p>{long}</p>{form}<p>{long}</p></article>") == f"{long}\n{long}", form
    for name in ("comment", "reply", "comment-list", "commentlist", "post-comments", "related-posts"):
        assert extract.main_text(f"<article><p>{long}</p><div class='{name}'><p>I say so too.</p></div></article>") == long, name


def test_heads_and_menus_of_pages_without_an_article():
    long = ("word " * 60).strip()
    for head in ("<div class='post-header'><h1>Head</h1></div>", "<header><h1>Head</h1></header>"):
        assert extract.main_text(f"<body><div>{head}<p>{long}</p><p>{long}</p></div></body>") == f"Head\n{long}\n{long}"
    site = "<header><h1>Site</h1><nav><a href='/'>Home</a></nav></header>"
    assert extract.main_text(f"<body>{site}<div><h1>Head</h1><p>{long}</p></div></body>") == f"Head\n{long}"
    assert extract.main_text(f"<body><header>Site name</header><div><p>{long}</p></div></body>") == long
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>A page of number {i} and more</a></li>" for i in range(40)) + "</ul>"
    assert extract.main_text(f"<body>{menu}<div><p>{long}</p><p>{long}</p></div></body>") == f"{long}\n{long}"
    assert extract.main_text(f"<body><div><p>{long}</p></div>{menu}<div><p>{long}</p></div></body>") == f"{long}\n{long}"
    assert extract.main_text(f"<body>{menu}</body>") == ""
    inside = f"<p>{long} <a href='x'>a link in the text</a> {long}</p>"
    assert extract.main_text(f"<body>{menu}<div>{inside}</div></body>") == f"{long} a link in the text {long}"


def test_very_long_and_clashing_pages(spark):
    page = "<article>" + "".join(f"<p>{'word ' * 2000}{i}</p>" for i in range(300)) + "</article>"
    rows = spark.createDataFrame([(1, "u", page, "t", 0), (1, "u", page, "t", 0), (2, None, None, None, None)], "page_id long, url string, html string, text string, n_chars long")
    got = extract.extract(rows, ["page_id", "url", "text", "n_chars"]).collect()
    assert sorted(r["n_chars"] for r in got) == [0, *[sum(2000 * 5 + len(str(i)) for i in range(300)) + 299] * 2]


def plain_article(page):
    """Text of a page's only article by cutting at its block tags, without a parser."""
    inside = re.search(r"<article[^>]*>(.*?)</article>", page or "", re.S)
    cut = re.split(r"</?(?:p|h\d|ul|ol|li|div|section|blockquote|table|tr|td)\b[^>]*>", inside[1] if inside else "")
    lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", x))).split()) for x in cut)
    return "\n".join(x for x in lines if x)


def test_table_pages_against_a_plain_version():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()
    assert len(pages) > 100
    for page in pages:
        assert extract.main_text(page) == plain_article(page)
