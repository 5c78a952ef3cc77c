import base64
import hashlib
import io
import math
import random
import time
import zipfile

import pytest

from tessera.llm import html_text
from tessera.llm.html_text import densities, extract_text, main_text, parse
from tessera.llm.storage import open_fs
from tessera.llm.warc import StoredZip, read_archive, warc_record, warc_roundtrip, write_archive

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><script>var a='</p><p>x';</script></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><aside>side</aside>"
    "<div class='cookie-notice'>We use cookies</div><article><h1>Head &amp; line</h1><p>First <b>bold</b>\n paragraph &lt;x&gt; goes here<br>on.<p>Second paragraph <a href=a>with link</a>."
    "<div class=ad>Buy</div><form><input>Mail</form></p></article><section id=comments><p>Nice article, thanks a lot for it all!</p></section><footer>&copy; me</footer>"
)


def test_main_text():
    assert main_text(PAGE) == "Head & line\nFirst bold paragraph <x> goes here on.\nSecond paragraph with link."
    assert main_text(None) == main_text("") == main_text("<p><br></p>") == ""
    assert main_text("just &eacute; text") == "just é text"


def test_article_without_semantic_elements():
    para = "A sentence of the story that is long enough to look like text. " * 3
    page = f"<body><div><a href=1>One</a><a href=2>Two</a><a href=3>Three</a></div><div><div><h1>Title</h1></div><div><p>{para}</p><p>{para}</p><ul><li>x<li>y</ul></div></div><div class=footer>end</div></body>"
    text = main_text(page)
    assert text == "\n".join(["Title", para.strip(), para.strip(), "x", "y"])


def test_layout_words_on_columns():
    page = "<body><div class='page has-sidebar'><article><h1>T</h1><p>Text of it.</p></article><div class='sidebar'>more links</div></div><ol class=commentlist><li><article class='comment'><p>Hello!</p></article></ol></body>"
    assert main_text(page) == "T\nText of it."


def test_density_prefers_text_over_links():
    tree = parse("<body><div><a>link one</a><a>link two</a></div><div><p>plain words here and there</p></div></body>")
    density, _ = densities(tree)
    first, second = [i for i, t in enumerate(tree.tag) if t == "div"]
    assert density[second] > density[first]


def random_tree(seed):
    """Random nested elements as html."""
    r = random.Random(seed)

    def node(depth):
        tag = r.choice(["div", "p", "a", "b", "span", "section", "ul"]) if depth else "body"
        inner = "".join(node(depth + 1) if r.random() < 0.6 and depth < 6 else " word" * r.randrange(0, 9) for _ in range(r.randrange(1, 5)))
        return f"<{tag}>{inner}</{tag}>"

    return node(0)


def test_densities_against_brute_force():
    """Each element's density from its own subtree, gathered anew for every element."""
    for seed in range(60):
        tree = parse(random_tree(seed))
        density, total = densities(tree)
        n = len(tree.tag)
        up = lambda i: [i, *up(tree.parent[i])] if i >= 0 else []
        under = [{j for j in range(n) if i in up(j)} for i in range(n)]
        size = lambda ids, linked: sum(len("".join(t.split())) for j, t in tree.runs if t and j in ids and (not linked or "a" in {tree.tag[k] for k in up(j)}))
        whole, links = max(1, size(under[0], False)), size(under[0], True)
        for i in range(n):
            c, l = size(under[i], False), size(under[i], True)
            t, lt = max(1, len(under[i]) - 1), max(1, sum(tree.tag[j] == "a" for j in under[i] - {i}))
            want = 0.0
            if c > 1:
                base = math.log(c / max(1, c - l) * l + links / whole * c + math.e)
                want = c / t * max(0.0, math.log(c / max(1, l) * t / lt + 1e-9)) / max(math.log(base), 1.0)
            assert density[i] == pytest.approx(want)
        for i in range(n):
            if i == 0 or tree.tag[i] in html_text.BLOCKS:
                nearest = [j for j in range(n) if j and tree.tag[j] in html_text.BLOCKS and next(k for k in up(j)[1:] if k == 0 or tree.tag[k] in html_text.BLOCKS) == i]
                assert total[i] == pytest.approx(sum(density[j] for j in nearest))


def test_density_chooses(monkeypatch):
    """Without densities nothing is chosen: the body's text stays, class words and all."""
    assert "We use cookies" not in main_text(PAGE)
    monkeypatch.setattr(html_text, "densities", lambda tree: ([0.0] * len(tree.tag), [0.0] * len(tree.tag)))
    assert "We use cookies" in main_text(PAGE) and "Second paragraph" in main_text(PAGE)


@pytest.mark.parametrize("page", ["<div>" * 40_000 + "</p>" * 40_000, "<b>" * 40_000 + "<li>x" * 40_000, "<x><table>" + "<b>" * 40_000 + "</x>" * 40_000, "<a " * 40_000, "<ul>" + "<b>" * 40_000 + "<li>" * 40_000])
def test_deep_pages_take_linear_time(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 10


def test_extract_text(spark):
    rows = [(1, "u", PAGE, "x"), (1, None, None, "y"), (None, "u", "", "z"), (4, "u", "<p>" + "long " * 50_000, "w")]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in got] == [(a, b, len(main_text(c))) for a, b, c, _ in rows]
    assert [r.text for r in got] == [main_text(c) for _, _, c, _ in rows]


def test_zip_reader_agrees_with_zipfile(tmp_path):
    path = f"{tmp_path}/a/x.wacz"
    records = [(i, warc_record(i, f"http://h/{i}", f"päge {i}".encode() * i, hashlib.sha1(f"päge {i}".encode() * i).digest())) for i in range(50)]
    assert write_archive(f"file://{path}", records) == 50
    fs, p = open_fs(f"file://{path}")
    z = zipfile.ZipFile(path)
    with fs.open_input_file(p) as f:
        own = StoredZip(f)
        assert {n: z.read(n) for n in z.namelist()} == {n: own.read(n) for n in own.members}
    assert [payload for _, _, payload in read_archive(f"file://{path}")] == [f"päge {i}".encode() * i for i in range(50)]


def test_zip64_and_comment():
    class Far(io.BytesIO):
        """A ZIP64 file that claims sizes only in its extra fields."""

        def size(self):
            return len(self.getvalue())

        def read_at(self, n, at):
            return self.getvalue()[at : at + n]

    buffer = Far()
    with zipfile.ZipFile(buffer, "w") as z:
        with z.open(zipfile.ZipInfo("a"), "w", force_zip64=True) as m:
            m.write(b"hello")
        z.comment = b"note"
    assert StoredZip(buffer).read("a", 1, 3) == b"ell"
    old, zipfile.ZIP_FILECOUNT_LIMIT = zipfile.ZIP_FILECOUNT_LIMIT, 1
    try:
        buffer = Far()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr("a", "one")
            z.writestr("b", "two")
    finally:
        zipfile.ZIP_FILECOUNT_LIMIT = old
    assert b"PK\x06\x06" in buffer.getvalue()
    assert StoredZip(buffer).read("b") == b"two"
    packed = Far()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "x" * 100)
    with pytest.raises(ValueError):
        StoredZip(packed)


def plain_warc(rows):
    ids = {}
    for key, _, text in rows:
        ids.setdefault(text or "", []).append(key)
    out = []
    for key, _, text in rows:
        known = [k for k in ids[text or ""] if k is not None]
        first = min(known) if known else None
        revisit = first is not None and key != first
        data = (text or "").encode()
        out.append((key, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_warc_roundtrip(spark):
    rows = [(3, "u", "same"), (1, None, "same"), (2, "v\r\nX: y", "other ü"), (5, "u", None), (4, "u", ""), (4, "u", ""), (None, "u", "same"), (None, None, "lone"), (None, None, "lone"), (9, "u", "long " * 300_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    assert sorted(map(tuple, warc_roundtrip(df).collect()), key=str) == plain_warc(rows)
    assert warc_roundtrip(df.limit(0)).count() == 0
    assert {r.record_type for r in warc_roundtrip(df, revisit_from=1 << 30).collect()} == {"response"}


