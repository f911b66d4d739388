import hashlib
import json
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from gleanworks.llm import langid, licenses, media, mixing, packing, sharding, toxicity, wrappers

SF = "/root/testdata/sf0.001"


def ids(rows):
    return sorted((r.doc_id for r in rows), key=str)


def every_id(odd_docs):
    return sorted((r.doc_id for r in odd_docs.collect()), key=str)


# ------------------------------------------------------------------ op1


def test_languages(spark, odd_docs, no_docs):
    words = {"en": "the of and to in is that it was for on are with as".split(), "fr": "le de un et être que pour dans ce il qui ne sur se".split(), "de": "der und die das nicht ein für mit auf dem den ich ist".split()}
    rng = np.random.default_rng(3)
    rows = [(100 + i, " ".join(rng.choice(words[lang], 40)), lang) for i, lang in enumerate(sorted(words) * 60)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(known.where("doc_id % 5 <> 1"), langid.Settings(epochs=4))
    got = {r.doc_id: r for r in langid.identify_languages(known, model).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang in rows if i % 5 == 1]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    odd = langid.identify_languages(odd_docs, model).collect()
    assert ids(odd) == every_id(odd_docs)
    assert {r.doc_id for r in odd if r.lang_pred == langid.UNKNOWN} == {3, 4, 5, 6} and all(0 <= r.score <= 1 for r in odd)
    assert all(r.rejected for r in odd if r.lang_pred == langid.UNKNOWN)
    kept = langid.keep_identified(odd_docs, model)
    assert kept.columns == odd_docs.columns and not {3, 4, 5, 6} & {r.doc_id for r in kept.collect()}
    assert langid.identify_languages(no_docs, model).count() == 0
    nothing = langid.fit_languages(no_docs)
    assert {r.lang_pred for r in langid.identify_languages(odd_docs, nothing).collect()} == {langid.UNKNOWN}


def _words_of(alphabet, rng, n):
    return ["".join(rng.choice(list(alphabet), int(rng.integers(2, 8)))) for _ in range(n)]


def test_language_training_holds_on_texts_of_any_length(spark):
    """From 1 to 20,000 words: finite scores, a temperature inside its grid, right and differing answers."""
    rng = np.random.default_rng(5)
    known = {"aa": _words_of("aeioutnrs", rng, 400), "bb": _words_of("yxkwzöäijp", rng, 400), "cc": _words_of("àéçlmdbvg", rng, 400)}
    lengths = [1, 2, 5, 20, 100, 1000, 5000, 20_000]
    rows = [(k, " ".join(rng.choice(known[lang], lengths[k // 3 % 8])), lang) for k, lang in enumerate(sorted(known) * 72)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8).cache()
    model = langid.fit_languages(docs.where("doc_id % 4 <> 1"), langid.Settings(epochs=3))
    assert np.isfinite(model.scores).all() and np.abs(model.scores).max() < 1000
    assert 0.05 < model.temperature < 200 and 0 < model.level <= 0.5
    got = {r.doc_id: r for r in langid.identify_languages(docs, model).collect()}
    held = [k for k, _, _ in rows if k % 4 == 1]
    assert np.mean([got[k].lang_pred == rows[k][2] for k in held]) >= 0.98
    assert np.mean([not got[k].rejected for k in held]) >= 0.98
    assert len({round(got[k].score, 6) for k in held}) > len(held) // 2
    # letters of no learned language are rejected far more often
    strange = spark.createDataFrame([(k, " ".join(_words_of("qhfjžłß", rng, 80))) for k in range(40)], "doc_id long, text string")
    assert sum(r.rejected for r in langid.identify_languages(strange, model).collect()) >= 30


def test_language_training_raises_on_what_is_not_finite(monkeypatch):
    rows = [(lang, np.arange(k, k + 5), np.ones(5, np.int64)) for k, lang in enumerate(["aa", "bb"] * 20)]
    assert langid.train(rows, langid.Settings()).languages == ["aa", "bb"]
    with pytest.raises(ArithmeticError), np.errstate(all="ignore"):
        langid.train(rows, langid.Settings(rate=float("inf")))


def test_numbers_are_no_letters(spark):
    assert [langid.has_letter(t) for t in ("²", "½ ½", "Ⅷ ①", "12 _", "", None, "é", "日", "a", "ª")] == [False] * 6 + [True] * 4
    learned = spark.createDataFrame([(i, "the of and to in is that it was", "en") for i in range(40)] + [(i, "der und die das nicht ein mit auf", "de") for i in range(40, 80)], "doc_id long, text string, lang string")
    model = langid.fit_languages(learned)
    docs = spark.createDataFrame([(1, "²"), (2, "½ ½"), (3, "Ⅷ"), (4, "①"), (5, "the of and")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.identify_languages(docs, model).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "und", 5: "en"}
    assert [r.doc_id for r in langid.keep_identified(docs, model).collect()] == [5]


def test_language_of_whole_texts_equals_brute_force(spark, odd_docs):
    """Every subword of the whole text, one at a time."""
    rng = np.random.default_rng(2)
    model = langid.Model(["aa", "bb"], rng.normal(size=(1 << 10, 2)).astype(np.float32), np.array([0.1, -0.1]), 0.7, 0.4, 10)

    def brute(text):
        sums, n = np.zeros(2), 0
        for word in text.encode().translate(langid._FOLD).split():
            word = b" " + word + b" "
            for size in langid.ORDERS:
                for at in range(len(word) - size + 1):
                    run = word[at : at + size]
                    if run[0] == run[-1] == 32:
                        continue
                    h = run[0]
                    for c in run[1:]:
                        h = (h * 0x01000193 ^ c) & 0xFFFFFFFF
                    h = (h + size) * 0x9E3779B1 & 0xFFFFFFFF
                    h = (h ^ h >> 15) * 0x85EBCA77 & 0xFFFFFFFF
                    sums, n = sums + model.scores[h >> 22], n + 1
        x = (sums / n + model.bias) / model.temperature
        return np.exp(x) / np.exp(x).sum()

    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    for r in langid.identify_languages(odd_docs, model).collect():
        text = texts[r.doc_id]
        if not text or not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            p = brute(text)
            assert r.lang_pred == model.languages[p.argmax()] and abs(r.score - p.max()) < 1e-4 and r.rejected == (p.max() < 0.4)


def test_subwords_do_not_depend_on_blocks(monkeypatch):
    text = ("some words of a text " * 50).encode()
    whole = langid.bucket_counts(text, 12)
    monkeypatch.setattr(langid, "BLOCK_BYTES", 64)
    parts = langid.bucket_counts(text, 12)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


# ------------------------------------------------------------------ op2


def test_shards(spark, odd_docs, no_docs):
    rows = sharding.assign_shards(odd_docs).collect()
    assert ids(rows) == every_id(odd_docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8 and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    assert sharding.assign_shards(no_docs).count() == 0


def test_shards_are_fair_and_move_only_where_weights_change(spark):
    docs = spark.range(8000).selectExpr("id as doc_id", "'t' as text")
    rows = sharding.assign_shards(docs).collect()
    sizes = Counter(r.shard for r in rows)
    assert all(850 < n < 1150 for n in sizes.values())
    assert 750 < sum(r.grown_shard == 8 for r in rows) < 1030
    heavier = tuple(sharding.Leaf(x.shard, x.region, x.rack, 2.0 if x.shard == 5 else 1.0) for x in sharding.EIGHT)
    moved = [(r.shard, r.grown_shard) for r in sharding.assign_shards(docs, grown=heavier).collect() if r.shard != r.grown_shard]
    region = {x.shard: x.region for x in sharding.EIGHT}
    assert moved and all(region[a] == region[b] or region[b] == "region1" for a, b in moved)
    with pytest.raises(ValueError):
        sharding.shard_of(docs["doc_id"], (sharding.Leaf(0, "a", "b", 0.0),))


# ------------------------------------------------------------------ op4


def test_media_round_trip(spark, odd_docs, no_docs):
    rows = media.read_media(media.store_media(odd_docs)).collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    assert ids(rows) == every_id(odd_docs)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        payload = bytes(r.payload)
        assert payload == data + b" " * (len(payload) - len(data)) and len(payload) % 192 == 0 and 0 < len(payload) < len(data) + 193
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert sum(c.frames for c in r.clips) == len(payload) // 192 and r.clips[0].start_s == 0
    assert media.read_media(media.store_media(no_docs)).count() == 0
    assert media.clip_rows(media.read_media(media.store_media(odd_docs))).count() >= len(rows)


def test_media_that_cannot_be_read_is_a_row_with_an_error(spark):
    good = media.write_avi(bytes(192))
    baseline = good.replace(b"\xff\xc3", b"\xff\xc0")
    rows = [(1, 3, good), (2, 3, baseline), (3, 3, good[:60]), (4, 3, b"RIFF"), (5, None, None), (6, 3, b"")]
    got = {r.doc_id: r for r in media.read_media(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert bytes(got[1].payload) == bytes(192) and got[1].error is None
    assert all(got[i].payload is None and got[i].error and got[i].media_sha256 for i in (2, 3, 4, 6))
    assert got[5].error is None and got[5].media_bytes is None


def test_media_headers_that_lie_are_rows_with_errors(spark):
    good = media.write_avi(bytes(range(192)) * 3)
    at = good.index(b"strh") + 8
    size = good.index(b"\xff\xc3") + 5
    other = good[: good.index(b"\xff\xc3")]
    bad = {
        1: good[: at + 20] + bytes(4) + good[at + 24 :],  # scale 0
        2: good[: at + 24] + bytes(4) + good[at + 28 :],  # rate 0
        3: good.replace(b"strhvids", b"strhauds").replace(b"vids", b"auds"),
        4: good[:size] + b"\xff\xff\xff\xff" + good[size + 4 :],  # a frame of 65,535 x 65,535
        5: other,
        6: good.replace(b"idx1", b"idx2"),
        7: good[: at + 20] + bytes(8) + good[at + 28 :],
    }
    rows = [(0, 3, good), *((k, 3, m) for k, m in bad.items())]
    got = {r.doc_id: r for r in media.read_media(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert bytes(got[0].payload) == bytes(range(192)) * 3
    assert all(got[k].payload is None and got[k].error for k in bad)


def test_media_query_equals_brute_force(spark, odd_docs, tmp_path):
    """The stored file, read frame by frame and sample by sample from its index."""
    docs = odd_docs.where("doc_id is null or doc_id not in (7, 8)")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stored = {(r.doc_id, r.n_bytes): bytes(r.media) for r in media.store_media(docs).collect()}
    texts = {(r.doc_id, len((r.text or "").encode())): (r.text or "").encode() for r in docs.collect()}
    for r in media.op4_media(spark, str(tmp_path)).collect():
        file, data = stored[r.doc_id, r.n_bytes], texts[r.doc_id, r.n_bytes]
        movi, index = file.index(b"movi"), file.rindex(b"idx1")
        entries = [file[k : k + 16] for k in range(index + 8, index + 8 + int.from_bytes(file[index + 4 : index + 8], "little"), 16)]
        payload = b""
        for e in entries:
            at = movi + int.from_bytes(e[8:12], "little")
            frame = file[at + 8 : at + 8 + int.from_bytes(e[12:16], "little")]
            payload += media._decode_one(*media._split(frame)).tobytes()
        want = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        assert payload == want and r.payload_bytes == len(want) and r.payload_sha256 == hashlib.sha256(want).hexdigest()
        assert r.tail_crc32 == zlib.crc32(want[-16:]) and r.media_bytes == len(file) and r.media_sha256 == hashlib.sha256(file).hexdigest()
        assert r.feature.startswith(f"frames={len(want) // 192};")


def test_media_decodes_sample_by_sample_alike_and_finds_shots():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (3, media.HEIGHT, media.WIDTH), dtype=np.uint8)
    frames = media.encode_frames(x)
    assert (media.decode_frames(frames) == x).all()
    for frame, samples in zip(frames, x, strict=True):
        assert (media._decode_one(*media._split(frame)) == samples).all()
    dark, bright = bytes(192 * 20), bytes([200]) * (192 * 20)
    payload, clips = media.read_back(media.write_avi(dark + bright))
    assert payload == dark + bright and [c[3] for c in clips] == [20, 20] and clips[1][1] == 0.8
    with pytest.raises(ValueError):
        media.write_avi(b"x")
    with pytest.raises(ValueError):
        media.read_avi(b"RIFFxxxxWAVE")


# ------------------------------------------------------------------ op5


PAGE = (
    '<html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><a href="/">Menu {0}</a></nav><div class="cookie-notice">We use cookies</div>'
    '<div class="ad">Buy {0}</div><article><h1>Title {0}</h1><p><b>One &amp; {0}<br><p>Two</p>{1}</article><section id="comments"><p>Nice!</p></section><form>x</form><footer>&copy; me</footer></body></html>'
)


def test_main_text():
    assert wrappers.main_text(PAGE.format("a", "<ul><li>x<li>y</ul>")) == "Title a One & a Two x y"
    assert wrappers.main_text("") == "" and wrappers.main_text("a &lt;b&gt; <i>c</i>d") == "a <b> cd"
    assert wrappers.main_text("<p>x<script>never closed <p>y</p>") == "x"
    assert wrappers.main_text("<article><header><h1>T</h1></header>x<aside>no</aside></article>y") == "T x"


def test_wrappers_learn_constants_groups_and_options():
    pages = [f"<div>Site</div><div><p>{a}</p>{'<p>more</p>' * n}</div><div>Contact</div>" for n, a in enumerate("abc")]
    streams = [wrappers.stream_of(*wrappers.read_page(p)) for p in pages]
    wrapper = wrappers.infer_wrapper(streams)
    assert all(wrappers.roles_of(wrappers.with_roles(wrapper), s) is not None for s in streams)
    assert "(" in wrappers.regex_of(wrapper) and "|" not in wrappers.regex_of(wrapper)
    steps = wrappers.compiled(json.loads(json.dumps(wrappers.with_roles(wrapper))))
    varies = [[bool(role & wrappers.VARIES) for role in wrappers.follow(steps, s)] for s in streams]
    assert varies == [[False, True, False], [False, True, True, False], [False, True, True, True, False]]


def random_page(rng, depth=3):
    """Nested elements with texts from a few words, some of them repeated or left out at will."""
    parts = []
    for _ in range(int(rng.integers(1, 5))):
        kind = int(rng.integers(5))
        name = str(rng.choice(["div", "p", "ul", "li", "span", "h2"]))
        if kind < 2 or not depth:
            parts.append(str(rng.choice(["one", "two", "three", "four five"])))
        elif kind < 4:
            parts.append(f"<{name}>{random_page(rng, depth - 1)}</{name}>" * int(rng.integers(1, 4)))
        else:
            parts.append("<br>")
    return "".join(parts)


@pytest.mark.parametrize("seed", range(20))
def test_a_wrapper_matches_every_stream_it_was_made_from(seed):
    rng = np.random.default_rng(seed)
    for _ in range(40):
        streams = [wrappers.stream_of(*wrappers.read_page(random_page(rng))) for _ in range(6)]
        for n in range(1, 7):
            wrapper = wrappers.infer_wrapper(streams[:n])
            assert "|" not in wrappers.regex_of(wrapper)
            for k in range(n):
                roles = wrappers.roles_of(wrappers.with_roles(wrapper), streams[k])
                assert roles is not None and len(roles) == sum(t[0] == "text" for t in streams[k])


def test_matching_takes_choices_back():
    item = lambda t: ("tag", t)
    wrapper = wrappers.with_roles([("maybe", (item("a"), item("b"))), ("plus", (item("a"), wrappers.SLOT)), ("maybe", (item("a"),)), item("c")])
    stream = lambda s: [item(x) if x != "t" else ("text", 1) for x in s]
    assert all(wrappers.roles_of(wrapper, stream(s)) is not None for s in ("ac", "abac", "aac", "atac", "ataatac"))
    assert all(wrappers.roles_of(wrapper, stream(s)) is None for s in ("c", "abc", "bac", "act", "atta"))
    hard = wrappers.with_roles([("plus", (("maybe", (item("a"),)), ("maybe", (item("a"),)))) for _ in range(6)] + [item("b")])
    assert wrappers.roles_of(hard, stream("a" * 400)) is None and wrappers.roles_of(hard, stream("a" * 400 + "b")) is not None


def test_pages(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", PAGE.format(i, "")) for i in range(12)] + [(20, None, None), (None, "http://h0.example/x", PAGE.format("n", "")), (21, "no url", "")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")
    got = wrappers.extract_pages(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[3].text == "Title 3 One & 3 Two" and by[3].n_chars == len(by[3].text)
    assert by[20].text == "" and by[21].text == "" and by[None].text == "Title n One & n Two"
    joined = wrappers.extract_pages(pages, wrappers.Settings(broadcast_bytes=0))
    assert sorted(map(str, joined.collect())) == sorted(map(str, got))
    assert wrappers.extract_pages(pages.where("false")).count() == 0


#: Everyday markup around an article; names of furniture tell states, or stand on frames of whole pages.
FRAMES = {
    "with-sidebar": '<div id="content" class="site-content with-sidebar">{}</div>',
    "share-enabled": '<div class="post share-enabled">{}</div>',
    "comments-open": '<div class="entry comments-open">{}</div>',
    "layout": '<div class="layout-sidebar-right"><article>{}</article></div>',
    "form": '<form id="aspnetForm"><article>{}</article></form>',
    "plain-form": '<form id="aspnetForm"><div id="x">{}</div></form>',
    "sidebar-frame": '<div class="sidebar"><article>{}</article></div><section id="comments"><article class="comment-body"><p>A reader has a lot to say here, more than the article has, and goes on and on and on.</p></article></section>',
    "readers": '<div class="page site"><article class="post comments-open">{}</article><div class="comments-area"><p>Readers.</p></div></div>',
    "neutral-readers": '<div class="a1">{}</div><div class="comments"><p>' + "A reader's words. " * 30 + "</p></div>",
    "neutral-menu": '<div class="x"><a href="1">Home</a> <a href="2">About us</a> <a href="3">Contact</a></div><div class="a1">{}</div>',
    "search": '<form action="/"><label>Search the site</label><input></form><div class="a1">{}</div>',
    "header-frame": '<div class="site-header"><div>{}</div></div>',
    "role": '<div role="main" class="sidebar-layout">{}</div>',
    "teasers": '<article>{}</article><article class="related"><h2>Other</h2><p>A teaser.</p></article>',
    "own-furniture": '<main>{}<div class="share">Tell your friends</div><div class="ad">Buy</div></main>',
    "card": '<div class="t">{}</div><div class="card-body">Small print</div>',
}


def test_names_of_furniture_take_no_article_away(spark):
    rows, wanted = [], {}
    for h, (name, frame) in enumerate(FRAMES.items()):
        for n in range(8):
            rows.append((100 * h + n, f"http://{name}.example/{n}", f"<html><body><div>Site</div>{frame.format(f'<h1>Title {n}</h1><p>Some text about matter {n * 7}, told at length.</p><p>And more of {n}.</p>')}<footer>me</footer></body></html>"))
            wanted[100 * h + n] = f"Title {n} Some text about matter {n * 7}, told at length. And more of {n}."
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract_pages(pages).collect()}
    assert {k: t for k, t in got.items() if t != wanted[k] and k // 100 != list(FRAMES).index("card")} == {}
    small_print = [got[100 * list(FRAMES).index("card") + n] for n in range(8)]
    assert small_print == [wanted[100 * list(FRAMES).index("card") + n] for n in range(8)]


def test_what_varies_over_a_host_outweighs_what_does_not(spark):
    """The same page, as one of a host and alone: only the host's wrapper tells that the long part is the same everywhere."""
    terms = "<div><p>" + "These terms are the same on every page. " * 20 + "</p></div>"
    page = lambda n: f'<body>{terms}<div class="main-menu"><p>Story {n}.</p><p>It goes on to {n}.</p></div></body>'
    rows = [(n, "http://many.example/", page(n)) for n in range(5)] + [(9, "http://one.example/", page(9))]
    got = {r.page_id: r.text for r in wrappers.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3. It goes on to 3."
    assert got[9].startswith("These terms") and "Story" not in got[9]


def test_a_generated_site_with_neutral_names(spark):
    """Every page against what it was generated from; the names of its elements tell nothing."""
    rng = np.random.default_rng(11)
    words = "lake house door stone river field road hill market ship grain wheel".split()
    say = lambda n: " ".join(rng.choice(words, n)).capitalize() + "."
    rows, wanted = [], {}
    for h in range(4):
        top = "".join(f'<span><a href="/{w}">{w}</a></span>' for w in words[h : h + 4])
        bottom = f"<p>{say(9)}</p>"
        for n in range(12):
            title, parts = f"{say(3)} {h} {n}", [say(int(rng.integers(5, 40))) + f" {k}" for k in range(int(rng.integers(1, 7)))]
            body = "".join(f"<p>{x}</p>" if k % 3 else f"<ul><li>{x}</li></ul>" for k, x in enumerate(parts))
            rows.append((100 * h + n, f"http://n{h}.example/{n}", f'<body><div class="q{h}"><div>{top}</div></div><div class="r"><h2>{title}</h2>{body}</div><div class="z">{bottom}</div></body>'))
            wanted[100 * h + n] = " ".join([title, *parts])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in wrappers.extract_pages(pages).collect()} == wanted


def test_pages_of_furniture_have_no_text():
    assert wrappers.main_text('<nav>Menu</nav><div class="comments"><p>hello there</p></div><form>Name <input></form>') == ""
    assert wrappers.main_text('<div class="sidebar"><p>One</p></div><div class="footer">Two</div>') == "One"  # named parts only: the largest


PLAIN = "<html><body><div><p>Site name</p></div><div><p>{}</p></div><div><p>Contact us</p></div></body></html>"


def test_copies_and_unmatched_pages_keep_their_texts_and_lose_constants(spark):
    copies = [(i, f"http://copies.example/{i}", PLAIN.format("One text")) for i in range(30)]
    mostly = [(100 + i, f"http://mostly.example/{i}", PLAIN.format("One text" if i < 40 else f"Text {i}")) for i in range(45)]
    odd = [(200 + i, f"http://odd.example/{i}", PLAIN.format(f"A {i}</p>" + "<ul><li>x</li></ul><table><tr><td>y</td></tr></table>" * (i % 9) + "<p>Site name" * (i % 2))) for i in range(40)]
    pages = spark.createDataFrame(copies + mostly + odd, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract_pages(pages).collect()}
    assert {got[i] for i in range(30)} == {"Site name One text Contact us"}  # a host of one page: nothing tells what is constant
    assert all(got[100 + i] == ("One text" if i < 40 else f"Text {i}") for i in range(45))
    # matched by the wrapper or not, a constant goes in its place and stays elsewhere
    assert all(got[200 + i] == " ".join([f"A {i}", *["x y"] * (i % 9), *["Site name"] * (i % 2)]) for i in range(40))


def test_wrappers_nest_groups_and_look_far_ahead():
    page = lambda counts: wrappers.stream_of(*wrappers.read_page("<ul>" + "".join("<li>" + "".join(f"<p>{i}{k}</p>" for k in range(n)) + "</li>" for i, n in enumerate(counts)) + "</ul>"))
    wrapper = wrappers.with_roles(wrappers.infer_wrapper([page([1]), page([1, 2, 3]), page([2])]))
    assert all(wrappers.roles_of(wrapper, page(c)) is not None for c in ([1], [1, 2, 3], [5, 1, 4, 2, 7], [9]))
    far = [wrappers.stream_of(*wrappers.read_page(f"<h1>t</h1>{'<hr><br>' * n}<p>{x}</p>")) for n, x in ((0, "a"), (300, "b"), (0, "c"))]
    wrapper = wrappers.with_roles(wrappers.infer_wrapper(far[:2]))
    assert wrappers.roles_of(wrapper, far[2]) is not None


def test_rounds_match_every_page(spark):
    kinds = ["<ul><li>x</li></ul>", "<table><tr><td>y</td></tr></table>", "<h2>z</h2>", "<pre>c</pre>", "<blockquote>q</blockquote>"]
    rows = [(i, "http://h.example/", "<body>" + "".join(k for b, k in enumerate(kinds) if i >> b & 1) + f"<p>text {i}</p></body>") for i in range(32)]
    streams = wrappers.read_streams(spark.createDataFrame(rows, "page_id long, url string, html string"))
    wrapper = json.loads(wrappers.learn_wrappers(streams, wrappers.Settings(pages=2)).first().roles)
    assert all(wrappers.roles_of(wrapper, wrappers.stream_of(*wrappers.read_page(r[2]))) is not None for r in rows)


def test_pages_left_after_the_rounds_are_matched_too(spark):
    """More kinds of pages than the rounds align: only a wrapper tells that the long part, which one page lacks, never changes, so that the story is no menu."""
    said = " ".join(["These terms are the same on every page."] * 20)
    terms = f"<section>{said}</section>"
    kinds = ["<ul><li>x</li></ul>", "<table><tr><td>y</td></tr></table>", "<h2>z</h2>", "<pre>c</pre>", "<blockquote>q</blockquote>"]
    rows = [(i, "http://h.example/", f'<body>{terms if i else ""}<div class="main-menu"><p>Story {i}, told at length.</p>{"".join(k for b, k in enumerate(kinds) if i >> b & 1)}</div></body>') for i in range(32)]
    rows += [(100 + i, "http://few.example/", PAGE.format(i, "")) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    settings = wrappers.Settings(pages=2, rounds=2, part_pages=4)
    streams = wrappers.read_streams(pages)
    learned = {(r.host, r.part): r for r in wrappers.learn_wrappers(streams, settings).collect()}
    parts = learned["h.example", 0].parts
    assert parts > 1 and set(learned) == {("few.example", 0), *(("h.example", k) for k in range(parts + 1))}
    for r in streams.where("host = 'h.example'").collect():
        part = json.loads(learned["h.example", 1 + r.stream % parts].roles)
        assert wrappers.roles_of(part, wrappers._items(r.tags, r.texts)) is not None
    got = {r.page_id: r.text for r in wrappers.extract_pages(pages, settings).collect()}
    assert got == {i: " ".join([*[said] * (i > 0), f"Story {i}, told at length.", *[x for b, x in enumerate("xyzcq") if i >> b & 1]]) for i in range(32)} | {100 + i: f"Title {i} One & {i} Two" for i in range(5)}
    joined = wrappers.extract_pages(pages, wrappers.Settings(pages=2, rounds=2, part_pages=4, broadcast_bytes=0)).collect()
    assert {r.page_id: r.text for r in joined} == got and len(joined) == len(rows)


def test_optional_parts_that_open_elements_hide_no_text():
    """The second part is left out here, so the element that it opens holds nothing of this page."""
    streams = [wrappers.stream_of(*wrappers.read_page(f"<body>{x}<p>{k}</p></div></body>")) for k, x in enumerate(("<div>", '<div class="menu">'))]
    steps = wrappers.compiled(wrappers.with_roles(wrappers.infer_wrapper(streams)))
    page = "<body><div><p>0</p></div></body>"
    assert wrappers.follow(steps, wrappers.stream_of(*wrappers.read_page(page))) is not None
    assert wrappers.main_text(page, steps) == "0"


def test_a_wrapper_takes_texts_that_a_comment_parts():
    streams = [wrappers.stream_of(*wrappers.read_page(f"<div><p>{x}</p></div>")) for x in ("", "a<!-- -->b", "a<!-- -->b<!-- -->c")]
    wrapper = wrappers.with_roles(wrappers.infer_wrapper(streams))
    assert all(wrappers.roles_of(wrapper, s) is not None for s in streams)


# ------------------------------------------------------------------ op6


def brute_sequences(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(left) if room >= n]
        if fits:
            left[min(fits, key=lambda k: left[k])] -= n
        else:
            left.append(capacity - n)
    return len(left)


def test_packing_is_best_fit_decreasing(spark):
    rng = np.random.default_rng(5)
    for capacity in (7, 64, 4096):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, capacity + 1, 30), rng.integers(1, 20, 30), strict=True)}
        runs = packing.best_fit(counts, capacity)
        sequences = defaultdict(list)
        for n, _, pieces, first, offset in runs:
            for k in range(pieces):
                sequences[first + k].append((offset, n))
        for own in sequences.values():
            own.sort()
            assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= capacity
        assert len(sequences) == brute_sequences([n for n, c in counts.items() for _ in range(c)], capacity)
    assert packing.best_fit({}, 10) == []


def test_packing(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    rows = packing.pack(packing.pieces_of(odd_docs)).collect()
    texts = odd_docs.collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for d in {t.doc_id for t in texts}:
        wanted = []
        for t in (t for t in texts if t.doc_id == d):
            own = np.array([*tokenizer.encode(t.text or "", add_special_tokens=False).ids, 1], "<u4")
            wanted += [(k, s, len(own[s : s + 4096]), zlib.crc32(own[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(own), 4096))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[d]) == sorted(wanted)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096
    assert packing.pack(packing.pieces_of(no_docs)).count() == 0


def test_word_tokenizer_equals_the_whole_text(monkeypatch):
    tokenizer = packing.WordTokenizer(packing.vocabulary_path())
    texts = ["á ́b", "it's <|endoftext|> we'LL ΣΑΣ\tx y", "\r\n\x0b1234 é́ 'S don't. «a».» x-y-z--", "İI ẞß K", "<|StartOfText|> A<|", ""]
    monkeypatch.setattr(packing, "BLOCK", 8)
    for text, got in zip(texts, tokenizer.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.tokenizer.encode(text, add_special_tokens=False).ids


# ------------------------------------------------------------------ op7


def test_toxicity(spark, odd_docs, no_docs):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(200)]
    rows, marks = [], []
    for i in range(600):
        toxic = int(i % 6 == 0)
        own = list(rng.choice(words, 60))
        if toxic:
            own[10:10] = ["vile", "rotten"]
            own[40:40] = ["vile"]
        rows.append((i, " ".join(own)))
        marks.append((i, toxic))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [(got[i].predicted, t) for i, t in marks if i % 5 == 0]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert len(model.at) < 200
    odd = toxicity.score_toxicity(odd_docs, model).collect()
    assert ids(odd) == every_id(odd_docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in odd)
    assert toxicity.keep_clean(docs, model).count() == sum(r.predicted == 0 for r in got.values())
    assert toxicity.score_toxicity(no_docs, model).count() == 0
    blank = toxicity.fit_toxicity(no_docs, labels)
    assert {r.score for r in toxicity.score_toxicity(odd_docs, blank).collect()} == {0.5}


# ------------------------------------------------------------------ op8


def test_raking_meets_its_targets(spark, odd_docs, no_docs):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(1, 400)), "ab"[int(rng.random() < 0.2)], ["en", "fr", "de"][int(rng.integers(3))]) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    settings = mixing.Settings(tolerance=1e-6)
    mixed = [r.asDict() for r in mixing.mix(docs, settings).collect()]
    total = sum(r["__tokens"] for r in mixed)
    assert all(r["__tokens"] == len(t.split()) for r, (_, t, *_) in zip(sorted(mixed, key=lambda r: r["doc_id"]), rows, strict=True))
    for name, power in settings.temperature.items():
        now, was = Counter(), Counter()
        for r in mixed:
            now[r[f"__{name}"]] += r["__tokens"] * r["__weight"]
            was[r[f"__{name}"]] += r["__tokens"]
        raised = {k: (v / total) ** power for k, v in was.items()}
        assert all(abs(now[k] / total - v / sum(raised.values())) < 1e-4 for k, v in raised.items())
    expected = sum(r["__tokens"] * r["__probability"] for r in mixed)
    assert abs(expected / total - settings.fraction) < 1e-3
    kept = sum(r["__tokens"] for r in mixed if r["__kept"])
    assert abs(kept / total - settings.fraction) < 0.05
    odd = mixing.mix(odd_docs).collect()
    assert ids(odd) == every_id(odd_docs) and all(r["__kept"] for r in odd if r["__tokens"] == 0)
    assert mixing.mix(no_docs).count() == 0


def brute_rake(cells, targets, sweeps=200):
    """Shares by the given targets, dimension after dimension; ``cells`` maps (source, lang, topic) to tokens."""
    weight = {k: float(v) for k, v in cells.items()}
    total = sum(weight.values())
    for _ in range(sweeps):
        for d, own in enumerate(targets):
            now = Counter()
            for k, w in weight.items():
                now[k[d]] += w
            weight = {k: w * own[k[d]] * total / now[k[d]] if now[k[d]] else 0.0 for k, w in weight.items()}
    return weight


def test_named_targets_are_met(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "w " * int(rng.integers(1, 300)), "abc"[int(rng.choice(3, p=[0.8, 0.15, 0.05]))], ["en", "fr", "de"][int(rng.choice(3, p=[0.7, 0.2, 0.1]))]) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"source": {"a": 0.3, "b": 0.4, "c": 0.3}, "lang": {"fr": 0.5}}
    settings = mixing.Settings(targets=targets, temperature={"source": 1.0, "lang": 1.0, "topic": 1.0}, tolerance=1e-7, sweeps=60)
    mixed = [r.asDict() for r in mixing.mix(docs, settings, topic=mixing.F.lit("t")).collect()]
    cells, kept = Counter(), Counter()
    for r in mixed:
        cell = r["__source"], r["__lang"], r["__topic"]
        cells[cell] += r["__tokens"]
        kept[cell] += r["__tokens"] * r["__probability"]
    by_lang = Counter()
    for (_, lang, _), n in cells.items():
        by_lang[lang] += n
    others = by_lang["en"] + by_lang["de"]
    wanted = brute_rake(cells, [targets["source"], {"fr": 0.5, "en": 0.5 * by_lang["en"] / others, "de": 0.5 * by_lang["de"] / others}, {"t": 1.0}])
    assert all(abs(kept[c] / sum(kept.values()) - wanted[c] / sum(wanted.values())) < 1e-4 for c in cells)
    for d, name in enumerate(("source", "lang")):
        for value, share in targets[name].items():
            assert abs(sum(v for c, v in kept.items() if c[d] == value) / sum(kept.values()) - share) < 1e-3
    drawn = Counter()
    for r in mixed:
        drawn[r["__source"]] += r["__tokens"] * r["__copies"]
    assert all(abs(drawn[v] / sum(drawn.values()) - share) < 0.03 for v, share in targets["source"].items())
    raked = mixing.rake(mixing.describe(docs, settings, topic=mixing.F.lit("t")).where("tokens > 0").groupBy(*mixing.DIMENSIONS).agg(mixing.F.sum("tokens").alias("tokens")), settings)
    assert all(abs(r.target - r.share) < 1e-4 for r in mixing.marginals(raked).collect())


def test_a_target_of_nothing_and_targets_that_cannot_be_met(spark):
    rows = [(i, "w " * 20, "ab"[i % 2], "en" if i % 2 else "fr") for i in range(40)] + [(99, "w " * 20, "c", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    both = spark.createDataFrame([(i, t, s, "en" if i % 4 < 2 else "fr") for i, t, s, _ in rows], docs.schema)
    plain = {"source": 1.0, "lang": 1.0, "topic": 1.0}
    without = mixing.mix(both, mixing.Settings(targets={"source": {"c": 0.0}}, temperature=plain)).collect()
    assert [r["__copies"] for r in without if r.source == "c"] == [0] and sum(r["__copies"] for r in without) > 0
    for targets, why in (
        ({"source": {"x": 0.5}}, "no document has"),
        ({"source": {"a": 0.7, "b": 0.7}}, "add up"),
        ({"source": {"a": 0.5, "b": 0.2, "c": 0.2}}, "add up"),
        ({"source": {"a": 0.9, "b": 0.1, "c": 0.0}, "lang": {"en": 0.9, "fr": 0.1}}, "furthest off"),  # all of a is fr
    ):
        with pytest.raises(ValueError, match=why):
            mixing.mix(docs, mixing.Settings(targets=targets, temperature=plain))


def test_copies_meet_the_targets_of_rare_cells(spark):
    rows = [(i, "w " * (20 if i % 7 == 0 else 100), "b" if i % 40 == 0 else "a", "fr" if i % 10 == 3 else "en") for i in range(20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    settings = mixing.Settings(temperature={"source": 0.3, "lang": 0.7, "topic": 0.8})
    mixed = [r.asDict() for r in mixing.mix(docs, settings).collect()]
    total = sum(r["__tokens"] for r in mixed)
    got = sum(r["__tokens"] * r["__copies"] for r in mixed)
    assert abs(got / total - settings.fraction) < 0.01 and max(r["__copies"] for r in mixed) > 1
    for name, power in settings.temperature.items():
        now, was = Counter(), Counter()
        for r in mixed:
            now[r[f"__{name}"]] += r["__tokens"] * r["__copies"]
            was[r[f"__{name}"]] += r["__tokens"]
        raised = {k: (v / total) ** power for k, v in was.items()}
        assert all(abs(now[k] / got - v / sum(raised.values())) < 0.01 for k, v in raised.items())
    copies = Counter({r["doc_id"]: r["__copies"] for r in mixed if r["__kept"]})
    assert Counter(r.doc_id for r in mixing.copied(docs, settings).collect()) == copies


def numpy_rake(cells, temperature, sweeps=200):
    """Weights of {(source, lang, topic): tokens}, raked the plain way."""
    weight = {k: float(v) for k, v in cells.items()}
    total = sum(cells.values())
    for _ in range(sweeps):
        for d, power in enumerate(temperature[n] for n in mixing.DIMENSIONS):
            was, now = Counter(), Counter()
            for k in cells:
                was[k[d]] += cells[k]
                now[k[d]] += weight[k]
            raised = {v: (n / total) ** power for v, n in was.items()}
            scale = total / sum(raised.values())
            for k in cells:
                weight[k] *= raised[k[d]] * scale / now[k[d]]
    return weight


def test_mixing_equals_a_numpy_raker(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "w " * int(rng.integers(0, 1500)), "abc"[min(2, int(rng.exponential()))], ["en", "fr", None][int(rng.integers(3))]) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    settings = mixing.Settings(tolerance=1e-9, sweeps=60)
    draws = {r.row.doc_id: r.draw for r in mixing.describe(docs).collect()}
    got = [r.asDict() for r in mixing.mix(docs, settings).collect()]
    assert all(r["__topic"] == ("empty" if n == 0 else "note" if n < 50 else "long" if n >= 1000 else "prose") for r in got for n in [len(r["text"].split())])
    cells = Counter()
    for r in got:
        if r["__tokens"]:
            cells[r["source"], r["lang"] or "(none)", r["__topic"]] += r["__tokens"]
    weight = numpy_rake(cells, settings.temperature)
    kept, total = Counter(), sum(cells.values())
    for r in got:
        key = (r["source"], r["lang"] or "(none)", r["__topic"])
        w = weight[key] / cells[key] if r["__tokens"] else 1.0
        p = w * settings.fraction if r["__tokens"] else 1.0
        assert abs(r["__weight"] - w) < 1e-6 and abs(r["__probability"] - p) < 1e-6
        assert r["__copies"] == int(r["__probability"]) + (draws[r["doc_id"]] < r["__probability"] % 1) and r["__kept"] == (r["__copies"] > 0)
        for name in mixing.DIMENSIONS:
            kept[name, r[f"__{name}"]] += r["__tokens"] * r["__probability"]
    for d, name in enumerate(mixing.DIMENSIONS):
        was = Counter()
        for k, n in cells.items():
            was[k[d]] += n
        raised = {v: (n / total) ** settings.temperature[name] for v, n in was.items()}
        assert all(abs(kept[name, v] / (settings.fraction * total) - x / sum(raised.values())) < 1e-3 for v, x in raised.items())


def test_mixing_keeps_columns_whatever_their_names(spark):
    docs = spark.createDataFrame([(i, "w x y", "s", "en", i, "t") for i in range(20)], "doc_id long, text string, source string, lang string, __tokens long, topic string")
    assert {tuple(r) for r in mixing.copied(docs).collect()} <= {tuple(r) for r in docs.collect()}
    with pytest.raises(ValueError, match="__tokens"):
        mixing.mix(docs)
    assert {r.topic for r in mixing.describe(docs, topic=docs["topic"]).collect()} == {"t"}
    pieces = spark.createDataFrame([(1, 5, 2)], "doc_id long, length int, __rank int")
    with pytest.raises(ValueError, match="__rank"):
        packing.pack(pieces)


def test_raking_says_when_it_does_not_converge(spark):
    rows = [("s" if i % 3 else "t", "en" if i % 5 else "fr", "prose" if i % 7 else "note", 10 + i) for i in range(105)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long").groupBy("source", "lang", "topic").sum("tokens").withColumnRenamed("sum(tokens)", "tokens")
    with pytest.warns(UserWarning, match="off its target"):
        mixing.rake(cells, mixing.Settings(sweeps=1, tolerance=1e-12))


# ------------------------------------------------------------------ op9


def brute_places(text, phrase):
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    n = len(phrase.split())
    return [k for k in range(len(words) - n + 1) if words[k : k + n] == phrase.split()]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_license_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    found = 0
    for r in licenses.op9_licenses(spark, SF).collect():
        places = sorted((k, label) for p, label in phrases.items() for k in brute_places(texts[r.doc_id], p))
        base = sorted({label for _, label in places})
        assert r.n_base == len(places) and r.base_labels == ",".join(base) and set(base) <= set(r.labels.split(",")) | {""}
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        found += len(places)
    assert found


def test_every_notice_is_found_in_place_and_none_without_its_key_phrase(spark):
    rng = np.random.default_rng(3)
    filler = [f"fill{k}" for k in range(50)]
    rows = []
    for k, (label, body, keys) in enumerate(licenses.TEMPLATES):
        before = " ".join(rng.choice(filler, 30))
        rows += [(3 * k, f"{before} {body}, and on", label, True), (3 * k + 1, f"{before} {body.upper()}", label, True)]
        broken = body
        for key in keys:
            broken = broken.replace(key, " ".join(w + "q" for w in key.split()))
        rows.append((3 * k + 2, f"{before} {broken}", label, not keys))
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    for i, _, label, there in rows:
        assert any(n.label == label and n.first_word == 30 for n in got[i].notices) == there, (label, i)


def test_no_notice_is_missed_whatever_the_corpus_makes_of_its_words():
    rng = np.random.default_rng(12)
    for label, body, keys in licenses.TEMPLATES:
        words, fixed = body.split(), {w for key in keys for w in key.split()}
        free = [i for i, w in enumerate(words) if w not in fixed]
        lost = rng.permutation(free)[: len(words) - int(np.ceil(licenses.LEAST_SHARE * len(words)))]
        text = "x y " + " ".join("gone" if i in set(lost.tolist()) else w for i, w in enumerate(words))
        rare = {w.encode(): 1 for i, w in enumerate(words) if i in set(lost.tolist())}  # the rarest words are the lost ones
        counts = {w.encode(): 50 for w in words} | rare
        for index in (licenses.PositionalIndex(), licenses.PositionalIndex(counts=counts, documents=100)):
            assert label in {n[0] for n in licenses.scan_text(text.encode(), index)[2]}, (label, body)


def test_the_licence_index_counts_words_over_all_documents(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(1, "The MIT license, the mit"), (2, "mit"), (3, None), (4, "software")], "doc_id long, text string")
    index = licenses.index_of(docs, (("a", "mit software fee license", ("fee",)),))
    assert [p for w in (b"fee", b"software", b"license") for p in index.postings[w]] == [(0, 2), (0, 1), (0, 3)] and b"mit" not in index.postings
    assert licenses.index_of(no_docs).needed == licenses.PositionalIndex().needed
    assert licenses.index_of(odd_docs).words


# ------------------------------------------------------------------ op2 and op7, by brute force


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_shard_query_equals_brute_force(spark):
    """The tree descended by hand: at each level the child with the least -ln(u) / weight, by xxhash64 of id and name."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in sharding.op2_sharding(spark, SF).collect()}
    names = sorted({f"{level}:{getattr(x, level)}" for x in sharding.NINE for level in ("region", "rack", "shard")})
    hashes = docs.select("doc_id", *[F.xxhash64(F.col("doc_id").cast("string"), F.lit(n)).alias(n) for n in names])
    for h in hashes.collect():
        for leaves, got in ((sharding.EIGHT, rows[h.doc_id].shard), (sharding.NINE, rows[h.doc_id].grown_shard)):
            at = list(leaves)
            for level in ("region", "rack", "shard"):
                groups = defaultdict(list)
                for x in at:
                    groups[str(getattr(x, level))].append(x)
                draw = lambda n: -np.log((((h[f"{level}:{n}"] & (1 << 64) - 1) >> 11) + 0.5) * 2.0**-53) / sum(x.weight for x in groups[n])  # noqa: B023, E731
                at = groups[min(groups, key=lambda n: (draw(n), n))]
            assert [x.shard for x in at] == [got]


def brute_toxicity(text, model):
    """The logistic sum over a text's distinct features, word by word in plain integers."""
    m = (1 << 64) - 1
    h = [xxh3_64_intdigest(w) for w in (text or "").encode().translate(toxicity._FOLD).split()]
    found = list(h)
    for step in toxicity.STEPS:
        found += [((a * 0x9E3779B97F4A7C15 + step) & m) ^ (b * 0xC2B2AE3D27D4EB4F & m) for a, b in zip(h, h[step:])]
    weight = dict(zip(model.at.tolist(), model.weight.tolist(), strict=True))
    total = model.constant + sum(weight.get(k, 0.0) for k in {((x ^ x >> 29) * 0xBF58476D1CE4E5B9 & m) >> (64 - model.bits) for x in found})
    return 1 / (1 + np.exp(-max(-35.0, min(35.0, total))))


def test_toxicity_scores_equal_brute_force(spark, odd_docs):
    """The logistic sum over the features of the whole text, one text at a time."""
    docs = spark.createDataFrame([(i, f"word{i % 7} vile thing {i % 5}" if i % 3 else f"word{i % 7} fine day {i % 5}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    both = odd_docs.select("doc_id", "text").unionByName(docs.where("doc_id > 100"))
    whole = {(r.doc_id, r.text): None for r in both.collect()}
    scores = defaultdict(list)
    for r in toxicity.score_toxicity(both, model).collect():
        scores[r.doc_id].append(r.score)
    for i, text in whole:
        one = brute_toxicity(text, model)
        assert any(abs(s - one) < 1e-9 for s in scores[i])
    ties = toxicity.score_toxicity(spark.createDataFrame([(1, "a tie"), (2, "a tie"), (3, "A  TIE")], "doc_id long, text string"), model).collect()
    assert len({r.score for r in ties}) == 1


def test_licenses(spark, odd_docs, no_docs):
    texts = {
        1: "Foo. This work is licensed under the GNU General Public License, version 3.\nALL RIGHTS RESERVED",
        2: "x Licensed under the  Apache-License,\nVersion 2.0 y",
        3: "Licensed under CC BY-NC 4.0. Released under the MIT License.",
        4: "General public licenses; all rights; license the mit",
        5: "Permission is hereby granted, free of charge, to any kind person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels) == (2, 8, 13, "gpl,reserved", "gpl,gpl-3.0,reserved")
    assert (got[2].labels, got[2].n_base, got[2].first_word) == ("apache-2.0", 0, None)
    assert got[3].labels == "cc-by,cc-by-nc-4.0,mit" and got[4].labels == "" and got[5].labels == "mit" and 0.7 <= got[5].score < 1
    assert [(n.label, n.first_word, n.last_word) for n in got[3].notices] == [("cc-by-nc-4.0", 0, 6), ("mit", 7, 11)]
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for r in licenses.scan_licenses(odd_docs).collect():
        own = next(t for t in odd_docs.collect() if t.doc_id == r.doc_id).text or ""
        assert r.n_words == len(word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in own)))
    assert licenses.scan_licenses(no_docs).count() == 0
