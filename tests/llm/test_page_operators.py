"""Licences, pages and conversations."""

import hashlib
import html
import json
import math
import re
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

from boutworks.llm import chat_format, html_text, license_scan, queries, warc
from boutworks.runtime import work_path

SF = "/root/testdata/sf0.001"


def bag(rows):
    return Counter(map(tuple, rows))


# ---- 1

FILES = [
    (1, "a/LICENSE", license_scan.TEMPLATES[1][1]), (2, "a/src/x.py", "print(1)\n"), (3, "a/src/deep/y.py", None), (4, "a/src/deep/LICENSE.txt", "Released under the MIT License."),
    (5, "a/src/deep/z.py", ""), (6, "b/q.py", "Copyright someone\ncode\n# Licensed under CC BY-NC 4.0.\n" + "word " * 5000), (7, "b/r.py", "nothing"), (8, None, None), (None, "b/r.py", "nothing"),
    (9, "c/COPYING", "no licence that anyone knows"), (10, "c/d.py", "x"), (11, "a2/e.py", "x"), (2, "a/src/x.py", "print(1)\n"), (12, "top.py", "All rights reserved. " * 3000),
]


def wrapped(text, mark, width=72):
    return "\n".join(f"{mark} {line}".rstrip() for line in textwrap.wrap(text, width))


def brute_licenses(files):
    known, unknown = license_scan.template_weights()
    count = lambda t: Counter(re.findall("[a-z0-9]+", t.lower()))
    weigh = lambda c: {t: n * known[t][0] if t in known else n * unknown for t, n in c.items()}
    norm = lambda w: math.sqrt(sum(x * x for x in w.values()))
    templates = [(name, weigh(count(t))) for name, t in license_scan.TEMPLATES]
    own, holders = {}, defaultdict(list)
    for k, (_, path, text) in enumerate(files):
        path, text = path or "", text or ""
        cue = lambda parts: [x for x in parts if re.search(license_scan.CUE, x)]
        lines, blocks = cue(text.split("\n")), cue(re.split(license_scan.GAP, text))
        named = bool(re.search(license_scan.FILE_NAME, path.split("/")[-1]))
        tries = lines + ([" ".join(lines)] if len(lines) > 1 else []) + blocks + [text] if lines or named else []
        scored = []
        for t in tries:
            d = weigh(count(t))
            most = sum(count(t).values()) >= license_scan.NOTICE_SHARE * sum(count(text).values())
            scored += [(-round(sum(x * w.get(v, 0) for v, x in d.items()) / norm(d) / norm(w), 6), name, most) for name, w in templates if d]
        scored = [x for x in scored if -x[0] >= license_scan.THRESHOLD]
        if scored:
            own[k] = (min(scored)[1], -min(scored)[0])
            if named or any(m for *_, m in scored):
                holders["/".join(path.split("/")[:-1])].append(min(scored))
    out = []
    for k, (i, path, _) in enumerate(files):
        parts = (path or "").split("/")[:-1]
        near = next((d for d in ("/".join(parts[:n]) for n in range(len(parts), -1, -1)) if d in holders), None)
        if k in own:
            out.append((i, path or "", *own[k], "own", None))
        elif near is not None:
            out.append((i, path or "", min(holders[near])[1], -min(holders[near])[0], "inherited", near))
        else:
            out.append((i, path or "", None, 0.0, "none", None))
    return out


def test_licenses(spark):
    schema = "doc_id long, path string, text string, license string, KEY string"
    files = spark.createDataFrame([(*f, "clash", "clash") for f in FILES], schema)
    got = license_scan.scan(files).collect()
    assert bag((*r[:3], round(r[3], 5), *r[4:]) for r in got) == bag((*r[:3], round(r[3], 5), *r[4:]) for r in brute_licenses(FILES))
    by = {r.path: r for r in got}
    assert by["a/src/x.py"].license == "Apache-2.0" and by["a/src/deep/z.py"].license == "MIT" and by["b/q.py"].license == "CC-BY-NC-4.0"
    assert by["c/d.py"].license is None and by["a2/e.py"].origin == "none"
    assert license_scan.scan(files.limit(0)).count() == 0


def test_wrapped_notices_and_whole_licences(spark):
    """Notices wrapped in comments before code, and whole licence files of any name and width."""
    code = "\n\nint main() { return 0; }\n" + "x = x + 1;\n" * 400
    long = {"MIT": 25, "BSD-2-Clause": 26, "BSD-3-Clause": 27, "ISC": 28, "Zlib": 29, "Unlicense": 30}
    files = [(k, f"{name}/text", wrapped(license_scan.TEMPLATES[k][1], "", 60).replace(". ", ".\n\n")) for name, k in long.items()]
    files += [(100 + k, f"{name}/deep/below.c", code) for name, k in long.items()]
    files += [(200 + k, f"head{k}/a.c", f"{mark} Copyright 2020 Someone\n{mark}\n{wrapped(t, mark, 50)}{code}") for mark in ("#", " *") for k, (_, t) in enumerate(license_scan.TEMPLATES) if len(t) > 150 and k < 25]
    files += [(300, "gpl/any", "Preamble\n\n" + "long words of a licence text\n" * 900 + "\n" + wrapped(license_scan.TEMPLATES[17][1], "", 70) + "\n\nmore of it")]
    got = {r.path: r for r in license_scan.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    for name in long:
        assert (got[f"{name}/text"].license, got[f"{name}/text"].origin) == (name, "own")
        assert (got[f"{name}/deep/below.c"].license, got[f"{name}/deep/below.c"].origin) == (name, "inherited")
    for k, (name, t) in enumerate(license_scan.TEMPLATES[:25]):
        if len(t) > 150:
            assert got[f"head{k}/a.c"].license == name, (k, name)
    assert got["gpl/any"].license == "GPL-3.0"
    assert bag((*r[:3], round(r[3], 5), *r[4:]) for r in license_scan.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()) == bag((*r[:3], round(r[3], 5), *r[4:]) for r in brute_licenses(files))


def test_licenses_run_without_python(spark):
    plan = queries.op1_license_scan(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.split("== Physical Plan ==")[1])


# ---- 4

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie notice">We use</div>
<main><article><h1>{title}</h1><p>first <b>bold</b>ly<br>next&nbsp;&amp; last</p><aside>side</aside><div class="ad-box ad">buy</div>
<p>second<p>third</article><section id="comments"><p>hi</p></section></main><form><p>Sign up</p></form><footer>&copy; us</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, TEXT string, host int")


def test_page_text(spark):
    want = "T{0}\nfirst boldly next & last\nsecond\nthird"
    rows = [(i, f"http://h.example/{i}", PAGE.format(title=f"T{i}")) for i in range(12)]
    odd = [(20, None, None), (21, "http://x/", ""), (22, "nonsense", "just &lt;text&gt; here"), (23, "http://y/", "<article><p>open <b>only"), (24, "http://z", "<p>a<script>x</script>b<!-- c"), (1, "http://h.example/1", PAGE.format(title="T1")), (None, "http://h.example/", "<main>m</main>"), (25, "http://w", "<article>" + "<p>w &amp; x" * 20_000)]
    got = html_text.extract(pages(spark, rows + odd))
    text = defaultdict(list)
    for r in got.collect():
        text[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    for i in range(12):
        assert set(text[i]) == {want.format(i)}
    assert len(text[1]) == 2 and text[20] == text[21] == [""] and text[22] == ["just <text> here"] and text[23] == ["open only"] and text[24] == ["ab"]
    assert text[None] == ["m"] and text[25][0].count("\n") == 19_999
    assert html_text.extract(pages(spark, rows).limit(0)).count() == 0


def test_template_of_a_host_without_an_article(spark):
    body = "<html><body><div class='top'>Our site</div><div class='mid'>{0}</div><div class='end'>All ours</div></body></html>"
    rows = [(i, "http://plain.example/", body.format(f"story {i}")) for i in range(6)]
    got = html_text.extract(pages(spark, rows))
    assert {r.page_id: r.text for r in got.collect()} == {i: f"story {i}" for i in range(6)}
    assert got.where("n_classes > 0").count() == 6


def test_copies_keep_their_text(spark):
    rows = [(i, "http://copy.example/", PAGE.format(title="same")) for i in range(30)]
    assert {r.text for r in html_text.extract(pages(spark, rows)).collect()} == {"same\nfirst boldly next & last\nsecond\nthird"}


def test_pages_of_the_table(spark):
    def brute(page):
        article = page[page.index("<article>") + 9 : page.index("</article>")]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", article))
        return "\n".join(b for b in blocks if b)

    want = {r.page_id: brute(r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert {r.page_id: r.text for r in queries.op4_html_text(spark, SF).collect()} == want


def hosted(spark, rows):
    host = html_text.F.coalesce(html_text.F.lower(html_text.F.regexp_extract("url", html_text.HOST, 1)), html_text.F.lit(""))
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", host)


def test_the_template_decides(spark):
    """Without its template a page is one slot, so every text of the table changes."""
    table = spark.read.parquet(f"{SF}/pages.parquet")
    rows = table.collect()
    got = {r.page_id: r for r in queries.op4_html_text(spark, SF).collect()}
    with_template = [r for r in rows if got[r.page_id].n_classes]
    assert len(with_template) > len(rows) / 3
    for r in with_template:
        assert html_text.main_text(r.html, html_text.Template()) != got[r.page_id].text
    made = html_text.templates(hosted(spark, [(r.page_id, r.url, r.html) for r in rows])).collect()
    assert {r.host for r in made} == {re.match(html_text.HOST, r.url)[1] for r in with_template}
    for r in made:
        assert r.template["main"], r.host
    by_host = {r.host: r.template for r in made}
    for r in with_template:
        tags, _, names = html_text.walk(r.html)
        main = by_host[re.match(html_text.HOST, r.url)[1]]["main"][0]
        assert names[main] == "article"


def test_classes_equal_brute_force(spark):
    """Occurrence vectors compared as a whole, page by page, in one process."""
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    rows += [(900 + i, "http://two.example/", f"<body><div class=a><h2>t{i}</h2></div>" + "<ul><li><i>x</i></li></ul>" * (i % 3) + f"<div class=b>text {i} and more</div><p>Same</p></body>") for i in range(9)]
    rows += [(950 + i, "http://two.example/", "<body><div class=a><h2>t1</h2></div></body>") for i in range(5)]
    table = hosted(spark, rows)
    got = html_text.classes(html_text.occurrences(html_text.distinct_bodies(table)))
    found = {(r.host, frozenset(r.tags), frozenset(r.texts), r.plain) for r in got.collect()}
    pages_of = defaultdict(set)
    for _, url, page in rows:
        pages_of[re.match(html_text.HOST, url)[1]].add(page)
    want = set()
    for host, bodies in pages_of.items():
        vectors, text = defaultdict(list), Counter()
        walked = [html_text.walk(b) for b in sorted(bodies)]
        for k, (tags, runs, _) in enumerate(walked):
            for key, n in Counter([(t, False) for t, _ in tags] + [(r.token, True) for r in runs if r.plain]).items():
                vectors[key].append((k, n))
        for (_, is_text), v in vectors.items():
            if is_text:
                n = sum(x for _, x in v)
                text[True] += n if len(v) > 1 and 2 * len(v) >= len(bodies) else 0
                text[False] += n
        grouped = defaultdict(set)
        for key, v in vectors.items():
            if len(v) >= max(2, 0.05 * len(bodies)):
                grouped[tuple(v)].add(key)
        for v, keys in grouped.items():
            tags = frozenset(t for t, is_text in keys if not is_text)
            if len(tags) >= 3:
                plain = len(v) >= html_text.TEXT_PAGES and not 2 * text[True] > text[False]
                want.add((host, tags, frozenset(t for t, is_text in keys if is_text), plain))
    assert found == want and any(t and plain for _, _, t, plain in want)


def test_order_and_place_of_classes():
    of = {1: 7, 2: 7, 3: 7, 4: 8, 5: 8, 6: 9}
    assert html_text.arrangement([1, 2, 4, 5, 4, 5, 3], of) == {7: ((1, 2, 3), 0, -1), 8: ((4, 5), 7, 1)}
    assert html_text.arrangement([1, 4, 2, 5, 3], of)[8] == ((), 0, -1)  # crosses
    assert html_text.arrangement([1, 4, 5, 2, 4, 5, 3], of)[8] == ((), 0, -1)  # in two places
    assert html_text.arrangement([1, 2, 3, 2, 1, 3], of)[7] == ((), 0, -1)  # in two orders
    assert html_text.arrangement([1, 2, 6, 3, 99], of)[9] == ((6,), 7, 1)


def test_layouts_and_notices_of_a_host(spark):
    """Names that nothing lists: the template finds the article, its constant notice, and both layouts."""
    news = "<html><body><div class='q1'>Site</div><div class='q2'>Today {0} offers</div><div class='q3'><h1>Title {0}</h1><div class='q4'>Join our club</div><p>Story {0} is a long one</p><p>with a second part {0}</p></div><div class='q5'>Imprint</div></body></html>"
    shop = "<html><body><div class='q1'>Site</div><section class='z1'><h2>Thing {0}</h2><ul><li>part {0} of it is fine</li></ul></section><div class='z9'>stock {0}</div><div class='q5'>Imprint</div></body></html>"
    rows = [(i, "http://mixed.example/", (shop if i % 3 == 0 else news).format(f"n{i}")) for i in range(30)]
    got = {r.page_id: r.text for r in html_text.extract(pages(spark, rows)).collect()}
    for i in range(30):
        assert got[i] == (f"Thing n{i}\npart n{i} of it is fine" if i % 3 == 0 else f"Title n{i}\nStory n{i} is a long one\nwith a second part n{i}")


def test_near_copies_of_a_host_keep_their_text(spark):
    page = "<body><div class='top'>Ours</div><div class='x'><h1>One title</h1><p class='lead'>The same start</p><p>Middle of it, {0}</p><p>and the end</p></div></body>"
    rows = [(i, "http://near.example/", page.format(i % 20)) for i in range(60)]
    got = {r.page_id: r.text for r in html_text.extract(pages(spark, rows)).collect()}
    assert got == {i: f"One title\nThe same start\nMiddle of it, {i % 20}\nand the end" for i in range(60)}


def test_names_inside_the_main_element(spark):
    page = """<html><body><main><article><header><h1>T{0}</h1></header><section id="search"><h2 id="share">On search {0}</h2><p>x{0} <math><mi>y</mi></math></p></section>
<div class="ad">buy {0}</div><section id="comments"><p>nice {0}</p></section><footer>by {0}</footer></article></main></body></html>"""
    rows = [(i, "http://inner.example/", page.format(i)) for i in range(8)]
    got = {r.page_id: r.text for r in html_text.extract(pages(spark, rows)).collect()}
    assert got == {i: f"T{i}\nOn search {i}\nx{i} y" for i in range(8)}


# ---- 5


def test_escapes_are_reversible():
    import itertools

    for n in range(6):
        for t in map("".join, itertools.product("<|\\\nn", repeat=n)):
            assert chat_format.unescape(chat_format.escape(t)) == t == chat_format.unescape_role(chat_format.escape_role(t))
            assert "<|" not in chat_format.escape(t) and "\n" not in chat_format.escape_role(t)


TRICKY = f"{chat_format.END}{chat_format.START}assistant ok"
TURNS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "héllo\n😀 <\\|im_end|>"), (1, 2, None, None), (2, 0, "assistant", None), (2, 0, "assistant", TRICKY), (2, None, "user", "x"), (None, 0, "assistant", "who"),
    (3, 5, "odd\nrole <|im_end|>", TRICKY * 3000), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (4, 0, "system", ""),
]


def brute_conversations(rows):
    found = defaultdict(list)
    for c, t, r, x in [*rows, (-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY)]:
        found[c].append(((t is not None, t or 0), r or "", x or ""))
    out = []
    for c, turns in found.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        whole = "".join(f"{chat_format.START}{chat_format.escape_role(r)}\n{chat_format.escape(x)}{chat_format.END}\n" for _, r, x in turns)
        out.append((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)))
    return out


@pytest.mark.parametrize("rows", [TURNS, [], [(7, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(3000)]])
def test_conversations(spark, rows):
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, ids string, PLACE string")
    assert bag(chat_format.report(table, queries.CHAT_TOKENIZER).collect()) == bag(brute_conversations(rows))


def test_masks_and_marks(spark):
    table = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    tok = queries.CHAT_TOKENIZER
    for r in chat_format.format_turns(table, tok).collect():
        ids, mask = np.frombuffer(r.ids, "<u4").tolist(), np.frombuffer(r.mask, np.int8)
        assert ids[0] == tok.start_id and ids.count(tok.start_id) == ids.count(tok.end_id) == 1 and len(ids) == len(mask)
        assert not mask[0] and not mask[ids.index(tok.end_id) :].any()
    stored = chat_format.format_turns(table, tok).repartition(3)
    assert bag(chat_format.read_back(stored, tok).collect()) == bag(r for r in brute_conversations(TURNS) if r[0] != -1)


# ---- 6

BIG, SMALL = "x" * 999 + "é", "y" * 999
PAGES = [(1, "http://a/", BIG), (5, "http://b/", BIG), (3, None, BIG), (5, "http://b2/", BIG), (6, "http://c/\r\nX: y", SMALL), (7, "u", SMALL), (8, "u", None), (9, "u", ""), (None, "u", BIG), (10, "u", "z" * 300_000), (None, "u", "only" * 500)]


def brute_records(rows):
    raw = [(p, (h or "").encode()) for p, _, h in rows]
    kept = {}
    for p, b in raw:
        if len(b) >= 1000 and p is not None:
            kept[b] = max(p, kept.get(b, p))
    out = []
    for p, b in raw:
        again = b in kept and p != kept[b]
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", kept[b] if again else None))
    return out


def test_archives(spark):
    table = spark.createDataFrame([(*r, "clash") for r in PAGES], "page_id long, url string, html string, payload_digest string")
    assert bag(warc.report(table).collect()) == bag(brute_records(PAGES))
    assert warc.report(table.limit(0)).count() == 0


def test_archives_read_as_plain_records(spark):
    rows = [(i, f"http://h/{i}", f"<p>page {i}</p>" * 200) for i in range(300)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_archives(warc.mark_revisits(table), work_path(spark, "warc-test"))
    listed = manifest.collect()
    assert sum(r.records for r in listed) == 300
    for r in listed:
        raw = open(r.path.removeprefix("file://"), "rb").read()
        size = int.from_bytes(raw[4:8], "little")
        assert raw[:4] == b"\x5d\x2a\x4d\x18" and len(raw) == r.bytes
        shared = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
        first = zstandard.ZstdDecompressor(dict_data=shared).decompressobj().decompress(raw[8 + size :])
        assert first.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and first.endswith(b"\r\n\r\n")
    back = warc.read_archives(manifest).collect()
    assert {r.page_id: r.payload.decode() for r in back} == {i: t for i, _, t in rows}
    assert {r.url for r in back} == {u for _, u, _ in rows}


def test_archives_are_read_by_many_tasks(spark):
    rows = [(i, "u", f"page {i} " * 300) for i in range(40)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    manifest = warc.write_archives(warc.mark_revisits(table), work_path(spark, "warc-many"))
    archives = manifest.count()
    back = warc.read_archives(manifest).withColumn("task", html_text.F.spark_partition_id())
    assert archives > 3 and back.select("task").distinct().count() > archives / 3
    assert back.count() == 40


def test_damage_is_noticed(tmp_path):
    record = warc.record(1, "u", b"payload", "0" * 40, "response", None)
    path = tmp_path / "x.warc.zst"
    path.write_bytes(warc._MAGIC + (0).to_bytes(4, "little") + zstandard.compress(record))
    (headers, block), = warc.records_of(str(path))
    with pytest.raises(ValueError, match="digest"):
        warc._parsed(headers, block, True)
    assert json.dumps(headers)
