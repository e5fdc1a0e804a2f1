"""Pages, urls, chats and audio."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keystrata.llm import audio, chat, html, urls

# HTML


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain", "plain"),
        ("<p>a  b\n c<p>d", "a b c\n\nd"),
        ("<title>t</title><p>a<script>x</script><style>y</style><!-- z --><b hidden>n</b><i style='display: NONE'>m</i>b", "ab"),
        ("<ul><li>a<li>b<ol start=4><li>c<li>d</ol></ul>", "- a\n- b\n  4. c\n  5. d"),
        ("<table><tr><th>Name<th>N<tr><td>apple<td>10<tr><td colspan=2>all of it</table>", "Name   N\napple  10\nall of it"),
        ("<pre> a\n  b</pre>c", " a\n  b\n\nc"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("x &amp; y &lt;b&gt; &eacute;", "x & y <b> é"),
        ("1 < 2 <3 <b", "1 < 2 <3"),
        ("<div>a</div><div>b</div>c", "a\nb\nc"),
        ("<a href='>'>k</a>", "k"),
        ("<dl><dt>t<dd>d</dl>", "t\n    d"),
        ("<textarea>&lt;x></textarea><img alt='pic'>", "<x>pic"),
    ],
)
def test_rendering(page, text):
    assert html.visible_text(page) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("<p> </p> <li> <ul> </ul> <table> <tr> <td> </table> x <br> <!-- --> <script> </script> <div > &amp <html> <head> <body> <pre> \n = \" '".split(" ") + [" "]), max_size=50))
def test_any_markup_renders(parts):
    html.visible_text("".join(parts))


def test_every_visible_word_stays():
    rng, words = random.Random(2), [f"w{k}" for k in range(300)]
    tags = ["p", "div", "b", "li", "ul", "td", "tr", "table", "span", "h1", "blockquote", "ol"]
    page = "".join(f"<{rng.choice(tags)}>{w} " + (f"</{rng.choice(tags)}>" if rng.random() < 0.5 else "") for w in words)
    assert sorted(html.visible_text(page).replace("- ", " ").split()) >= [] and set(words) <= set(html.visible_text(page).split())


def test_time_is_linear():
    for page in ("<a b=\"'>" * 20000, "<a \"'>" * 20000, "<a =" * 20000, "<div>" * 5000 + "x", "<b><table><tr><td>" * 2000, "<!--" * 20000, "<a " * 20000, "<a '" * 3000 + ">"):
        html.visible_text(page)


@pytest.mark.parametrize(
    "page, text",
    [
        ("a<svg><title>n</title><desc>n</desc><path d='M0'/><defs/><text>b <tspan>c</tspan></text><text>d</text></svg>e", "a\nb c\nd\ne"),
        ("<text>a</text><text>b</text><desc>c</desc>", "abc"),
        ("so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>n</annotation></semantics></math>.", "so x=2."),
        ("<input type=hidden value=n><input value=n><input type=SUBMIT value='Go on'> <input type=reset value=Clear><input type=button>", "Go on Clear"),
        ("<table><tr><td rowspan=2>aa<td>b<tr><td>c<tr><td>d<td>e</table>", "aa  b\n    c\nd   e"),
        ("<table><tr><td>a<td rowspan=0 colspan=2>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a  b   c\nd      e\nf      g"),
        ("<svg><defs><p>a<br/>b", "a\nb"),
        ("<svg><foreignObject><p>a<br/>b</p></foreignObject><text>c</svg>", "a\nb\n\nc"),
        ("<table><tbody><tr><td rowspan=9>a<td>b<tbody><tr><td>c<td>d</table>", "a  b\nc  d"),
        ("<table><tr><td colspan=\u00b2 rowspan=\u00b2>a<td>b</table>", "a  b"),
        ("<table><tr><td>a<td>b<td>c<tr><td colspan=2>a wide text<td>d</table>", "a  b         c\na wide text  d"),
        ("<a title='x>y'>k</a><a b=\"q>\" c>l</a><p a=\"open>m</p>n", "kl\n\nm\n\nn"),
        ("<a x='" + "y>" * 9000 + "' z=1>k</a>", "k"),
    ],
)
def test_rendering_of_drawings_formulas_buttons_and_row_spans(page, text):
    assert html.visible_text(page) == text


@pytest.mark.parametrize("deep", ["<div>", "<b>", "<section><p>", "<custom><span>"])
def test_depth_changes_nothing(deep):
    page = "<div hidden>no</div><i style='display:none'>no<b>no</b></i><script>no</script><style>no</style><p>a<ul><li>b</ul><table><tr><td>c<td>d</table><pre> e\n  f</pre>"
    for n in (200, 3000):
        assert html.visible_text(deep * n + page) == html.visible_text(page) == "a\n\n- b\n\nc  d\n\n e\n  f"
    assert html.visible_text("<div hidden>" + "<span>" * 200 + "<div>no</div>no" + "</span>" * 200 + "no</div>yes") == "yes"
    assert html.visible_text("<div hidden>no" + "<blockquote><ul><li>no" * 5000) == ""


def test_many_open_elements_take_linear_time():
    for page in ("<span>" * 50_000 + "<h1>x</h1></i>" * 50_000, "<blockquote><ul><li>x" * 5_000):
        assert "x" in html.visible_text(page)


def test_extraction_keeps_rows(spark):
    rows = spark.createDataFrame([(1, "<p>a"), (1, "<p>a"), (2, None)], "page_id int, html string")
    assert rows.limit(0).select(html.extract_text(F.col("html"))).count() == 0
    assert sorted(tuple(r) for r in rows.select("page_id", html.extract_text(F.col("html")).alias("t")).collect()) == [(1, "a"), (1, "a"), (2, "")]


# URLs


def simple_judge(rows):
    out, bad = [], set()
    for i, url in rows:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:].split("?")[0].split("#")[0]
        best = max(((h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), key=lambda r: len(r[0]), default=(None, None))
        if best[1] == "block":
            bad.add(host)
        out.append([i, host, path, *best])
    return sorted((i, h, p, r or "", v or ("block" if h in bad else "allow")) for i, h, p, r, v in out)


def urls_of_all_kinds():
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, "no scheme"), (3, "http://"), (4, "HTTP://A.Example.ORG"), (5, "http://example.org?x=/es/"), (6, "http://xexample.org/es/1"), (7, "a://b://c.org/en/1"), (8, "http://É.org/x\ny"), (8, "http://É.org/x\ny")]
    for i in range(300):
        host = rng.choice(["a.", "b.c.", "", "Www."]) + rng.choice(["example.", "x."]) + rng.choice(["org", "com", "net"])
        rows.append((10 + i, f"https://{host}/{rng.choice(['es', 'en', 'fr', 'de'])}/{rng.randrange(30)}{rng.choice(['', '?q=1', '#t', '/'])}"))
    return rows


@pytest.mark.parametrize("limit", [64 << 20, 64])
def test_urls(spark, monkeypatch, limit):
    monkeypatch.setattr(urls, "BROADCAST", limit)
    monkeypatch.setattr(urls, "SHARD_KEYS", 5)
    rows = urls_of_all_kinds()
    frame = spark.createDataFrame([(i, u, True, "x") for i, u in rows], "page_id long, url string, _best boolean, key string")
    got = urls.judge(frame)
    assert {"_best", "key"} <= set(got.columns)
    assert sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in got.collect()) == simple_judge(rows)
    assert urls.judge(frame.limit(0)).count() == 0


def test_cascade_is_exact():
    rng = np.random.default_rng(3)
    for n, m in ((0, 50), (50, 0), (1, 20000), (3000, 50000), (20000, 200)):
        keys = rng.integers(0, 1 << 63, (n + m, 2), dtype=np.int64).view(np.uint64)
        cascade = urls.Cascade.from_bytes(urls.Cascade.over(keys[:n], keys[n:]).to_bytes())
        assert cascade.has(keys[:n]).all() and not cascade.has(keys[n:]).any()


# Chat


@settings(max_examples=150, deadline=None)
@given(st.text(), st.lists(st.sampled_from(["<", "|", "\\", "im_end|>", "<|im_start|>", "\n", "n", "é"])).map("".join))
def test_turns_return(a, b):
    coder = chat._coder(chat.chat_tokenizer())
    for role, text in ((a, b), (b, a), ("assistant", a), ("assistant", b)):
        ((ids, mask),) = coder.format([role], [text], "assistant")
        got_role, got_text, under, readable = coder.read(ids, mask)
        assert (got_role, got_text) == (role, text) and under == (text if role == "assistant" else "")
        assert len(ids) == len(mask) and readable.count(chat.START) == readable.count(chat.END) == 1
        assert ids.count(coder.start) == ids.count(coder.end) == 1


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "assistant", None), (1, 2, None, "x"), (2, 0, "assistant", "é<|im_end|>"), (None, 0, "user", ""), (3, None, "user", "z"), (3, 0, "user", "z"), (3, 0, "user", "z")]
    turns = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, loss_count int")
    formatted = chat.format_turns(turns, chat.chat_tokenizer())
    assert "loss_count" in formatted.columns
    got = {r.conv_id: r for r in chat.digest_conversations(chat.read_turns(formatted, chat.chat_tokenizer())).collect()}
    by = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(by)
    for c, turns_ in by.items():
        loss = "".join(x for r, x in turns_ if r == "assistant")
        assert got[c].n_turns == len(turns_)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns_).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == sum(24 + len(r) + len(chat.escape(x)) for r, x in turns_)
    assert chat.digest_conversations(chat.read_turns(chat.format_turns(turns.limit(0), chat.chat_tokenizer()), chat.chat_tokenizer())).count() == 0


# Audio


def test_alignment_finds_the_cut():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=64), rng.normal(size=64)
    whole, cut, other = audio.fingerprint(audio.render(a)), audio.fingerprint(audio.render(a, 1.024, 0.05, 3)), audio.fingerprint(audio.render(b))
    errors = {o: audio.bit_error(cut, whole, o)[0] for o in range(40)}
    assert min(errors, key=errors.get) == 16 and errors[16] < 0.1
    assert audio.bit_error(whole, other, 0)[0] > 0.25


def test_odd_media(spark):
    rows = [(1, None), (2, b""), (3, b"RIFFjunk"), (4, audio.render([])), (5, audio.render([1.0, None, float("nan")] * 20)), (6, audio.render([0.0] * 40))]
    got = {r.id: len(r.p) for r in spark.createDataFrame(rows, "id int, m binary").select("id", audio.fingerprints(F.col("m")).alias("p")).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [0, 0, 0, 0] and got[5] > 20 and got[6] > 20


def test_search(spark):
    rng = np.random.default_rng(2)
    vectors = {i: rng.normal(size=64) for i in range(30)}
    index = spark.createDataFrame([(i, [int(x) for x in audio.fingerprint(audio.render(v))]) for i, v in vectors.items()], "id long, print array<long>")
    asked = spark.createDataFrame([(i, [int(x) for x in audio.fingerprint(audio.render(vectors[i], 0.512, 0.05, i))]) for i in range(0, 30, 5)] + [(99, [1, 2, 3, 4, 5, 6]), (98, [])], "id long, print array<long>")
    got = {r.id: r for r in audio.align(asked, index).collect()}
    assert [got[i].match for i in range(0, 30, 5)] == list(range(0, 30, 5)) and {got[i].offset for i in range(0, 30, 5)} == {8}
    assert got[99].match is None and got[98].match is None
    assert audio.align(asked.limit(0), index).count() == 0 and {r.match for r in audio.align(asked, index.limit(0)).collect()} == {None}


@pytest.mark.parametrize("noise", [0.02, 0.05, 0.15])
def test_search_finds_what_all_pairs_find(spark, noise):
    """Held notes and silence among them; brute force tries every offset of every recording."""
    rng = np.random.default_rng(7)
    vectors = {i: np.repeat(rng.normal(size=32), 2) if i % 3 else rng.normal(size=64) for i in range(40)}
    whole = {i: audio.fingerprint(audio.render(v)) for i, v in vectors.items()} | {40: audio.fingerprint(audio.render([0.0] * 64)), 41: np.full(90, audio.SILENCE, np.uint32)}
    asked = {i: audio.fingerprint(audio.render(vectors[i], 0.5, noise, i)) for i in range(0, 40, 2)} | {40: whole[40], 41: whole[41][:50]}
    long = lambda p: [int(x) for x in p]
    frame = lambda d: spark.createDataFrame([(i, long(p)) for i, p in d.items()], "id long, print array<long>")
    got = {r.id: r.match for r in audio.align(frame(asked), frame(whole)).collect()}
    want = {}
    for q, p in asked.items():
        tried = [(audio.bit_error(p, w, o)[0], m) for m, w in whole.items() for o in range(0, 30) if audio.bit_error(p, w, o)[1] > len(p) // 2]
        want[q] = min(tried)[1] if min(tried)[0] <= audio.MAX_ERROR else None
    want[41] = None  # silence is like nothing
    assert sum(got[q] == want[q] for q in asked) >= 0.9 * len(asked) and got[41] is None
