"""Operators that take each text or page by itself."""

import random
import struct

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer, decoders, models, normalizers

from seriate.llm import bpe, html_text, media, token_counts

from . import brute, data

ODD = ["", " ", "  ", "a  b", " a", " \n x", "x ", "aaa aaaa", "don't we'll", "12 3½ ²", "x_y ___", "日本語", "😀😀 naïve", "a<|endoftext|>b <|endoftext|>", "\t\tfoo\n\n bar  \n", "a　 b", "a\x1c b\x1c c", "a \x85b", "﻿x", "a​ b", "\0 x"]


def fuzzed(n=300):
    rng = random.Random(2)
    return ODD + ["".join(rng.choice(" \n\t'aAbcé日½_.,!😀 　\x1f") for _ in range(rng.randrange(60))) for _ in range(n)]


def test_bpe_equals_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = bpe.PairIndexBpe(path), Tokenizer.from_file(path)
    texts = fuzzed()
    for got, want, text in zip(own.encode_batch(texts), library.encode_batch(texts, add_special_tokens=False), texts):
        ids = np.frombuffer(got, "<u4").tolist()
        assert ids == want.ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert own.decode([200]) == library.decode([200], skip_special_tokens=False)


def test_bpe_ranks_equal_the_library():
    from seriate.llm.packing import _Ranks

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = _Ranks(path, public_tokenizers.path("byte_bpe_50k.tiktoken")), Tokenizer.from_file(path)
    texts = fuzzed()
    for got, want in zip(own.encode_batch(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(got, "<u4").tolist() == want.ids


def test_bpe_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 10)
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = bpe.PairIndexBpe(path), Tokenizer.from_file(path)
    for text in fuzzed(50):
        assert np.frombuffer(own.encode_batch([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_keeps_words_across_batches(monkeypatch):
    """Words of one batch are not encoded anew in the next, unless there are far more than the cache's entries."""
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 100)
    own, asked = bpe.PairIndexBpe(public_tokenizers.path("byte_bpe_50k.json")), []
    encode_words = own.encode_words
    monkeypatch.setattr(own, "encode_words", lambda words: asked.extend(words) or encode_words(words))
    text = "head " + " ".join("".join(chr(97 + int(x)) for x in str(k)) for k in range(300))
    first = own.encode_batch([text])
    asked.clear()
    assert own.encode_batch([text]) == first and asked == [b"head"]
    for k in range(20):
        own.encode_batch([" ".join(f"w{k}x{i}" for i in range(100))])
    assert len(own.spaced) + len(own.pieces) < 1000


def test_round_trip_query(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    values, library = data.texts(2, 10), Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in bpe.round_trip(data.frame(spark, values, True), path).collect()}
    for k, t in enumerate(values):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[7 * k + 3][1:] == (len(ids), brute.sha(",".join(map(str, ids)).encode()), brute.sha((t or "").encode()))
    assert bpe.round_trip(data.frame(spark, values).limit(0), path).count() == 0
    assert {r["doc_id"]: r["ids"] for r in bpe.encode(data.frame(spark, values), path).collect()}[3] == library.encode(values[0]).ids


def test_token_counts_equal_the_unigram_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = token_counts.vocabulary(path)
    # The library's model of the same pieces; byte pieces, which match no text here, stand behind them.
    vocab = [("<unk>", 0.0), *pieces, *((f"<0x{b:02X}>", min(s for _, s in pieces)) for b in range(256))]
    library = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    library.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    library.decoder = decoders.ByteFallback()
    values = [t for t in [*data.texts(6, 20), *fuzzed(100)] if t is None or "\0" not in t]
    got = {r["doc_id"]: r for r in token_counts.token_counts(data.frame(spark, values, True), path).collect()}
    for k, t in enumerate(values):
        want = len(library.encode(t, add_special_tokens=False).ids) if t else 0
        assert got[7 * k + 3]["n_tokens"] == want, t


def test_media_round_trip(spark):
    values = [*data.texts(8, 8), "y" * 576, "z" * (576 * 16), "z" * (576 * 40 + 1)]
    stored = media.store(data.frame(spark, values, True))
    got = {r["doc_id"]: r for r in media.digests(stored).collect()}
    shown = {r["doc_id"]: r for r in media.describe(stored).collect()}
    for k, t in enumerate(values):
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        r, s = got[7 * k + 3], shown[7 * k + 3]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), brute.sha(payload), brute.crc(payload[-32:]))
        assert s["codec"] == "raw " and s["duration"] == len(payload) and s["n_samples"] == len(payload) // 576
        assert [x["length"] for x in s["keyframes"]] == [576] * (-(-s["n_samples"] // media.KEY_EVERY))


def test_media_reads_other_layouts():
    payload = bytes(range(256)) * 9
    whole = media.store_bytes(payload)
    moov = whole.index(b"moov") - 4
    # A file whose boxes end with one of size 0, "to the end of the file".
    open_ended = whole[:moov] + struct.pack(">I", 0) + whole[moov + 4 :]
    (track,) = media.tracks(memoryview(open_ended))
    assert media.samples(memoryview(open_ended), track) == payload


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a href=/x>Menu</a></nav>
<div class="cookie-notice">We use cookies</div>{open}<h1>Head &amp; line</h1><p>One <b>bold</b>  text<br>more<p>Second&nbsp;one
<!-- gone --><form><p>mail</form><div class="ad">Buy</div><ul><li>a<li>b</ul>{close}<section id="comments"><p>first!</p></section><footer>(c)</footer>"""


def test_html_blocks():
    article = "Head & line\nOne bold text more\nSecond one\na\nb"
    page = PAGE.format(open="<article>", close="</article>")
    assert html_text.main_text(html_text.blocks(page), set()) == article
    assert html_text.main_text(html_text.blocks(PAGE.format(open="", close="")), set()) == article
    assert html_text.main_text(html_text.blocks(""), set()) == ""


def test_html_template_is_induced_by_host(spark):
    body = "<html><body><div class=top>Always the same banner line</div><div class=story><p>{}</p><p>{}</p></div><div class=end>Same end</div></body></html>"
    rows = [(k, f"https://h{k % 2}.example.org/{k}", body.format(f"text {k}", f"more {k}"), "extra") for k in range(40)]
    rows += [(100, None, None, ""), (101, "odd", "<p>alone", ""), (102, "https://h0.example.org/z", "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in html_text.extract(df).collect()}
    assert all(got[k]["text"] == f"text {k}\nmore {k}" for k in range(40))
    assert (got[100]["text"], got[101]["text"], got[102]["n_chars"]) == ("", "alone", 0) and got[7]["url"] == rows[7][1]
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_articles_are_judged_by_the_template(spark):
    page = "<body><div class=top>Same banner</div><div class=lead><h1>Head {0}</h1></div><article><p>text {0}</p><p>Read us daily</p><p>more {0}</p></article><div class=tail>last {0}</div></body>"
    copies = "<nav>menu {0}</nav><article><p>One article</p><p>under many menus</p></article>"
    rows = [(k, "https://h.example.org/x", page.format(k)) for k in range(20)] + [(50 + k, "https://c.example.org/x", copies.format(k)) for k in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert [got[k] for k in range(20)] == [f"Head {k}\ntext {k}\nmore {k}\nlast {k}" for k in range(20)]
    assert all(got[50 + k] == "One article\nunder many menus" for k in range(9))


def test_html_every_layout_has_a_template(spark):
    kinds = ["<div class={1}><div>Keep in touch</div><section>{1} {0}</section><span>{1} rules</span></div>".replace("{1}", c) for c in ("news", "shop", "wiki")]
    long_ = "".join(f"<div class=g{g}>" + "".join(f"<div class=c{c}>Fixed {g} {c}</div>" for c in range(45)) + "</div>" for g in range(47)) + "<div class=story>story {0}</div>"
    rows = [(k, "https://h.example.org/x", kinds[k % 3].format(k)) for k in range(45)] + [(90, "https://h.example.org/e", "")]
    rows += [(100 + k, None, long_.format(k)) for k in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert [got[k] for k in range(45)] == [f"{('news', 'shop', 'wiki')[k % 3]} {k}" for k in range(45)] and got[90] == ""
    assert [got[100 + k] for k in range(6)] == [f"story {k}" for k in range(6)]


def test_html_of_deep_and_broken_markup(spark):
    deep = "<div>" * 3000 + "<p>deep text {k}</p>" + "</div>" * 3000
    rows = [(k, "http://deep.test/a", deep.format(k=k)) for k in range(5)] + [(9, "http://broken.test/b", "<a " * 300_000 + "<p>end</p>"), (10, "http://broken.test/b", None)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"deep text {k}" for k in range(5)) and got[9] == "end" and got[10] == ""


def test_tree_match_counts_aligned_nodes():
    one, two = (html_text.folded(html_text.blocks(h)) for h in ("<div><h1>a</h1><p>x</p><p>y</p></div>", "<div><p>x</p><p>y</p><table><td>q</table></div>"))
    score, matched = html_text.tree_match(one, two)
    assert score == 3 and [x.sign for x, _ in matched] == ["", "div", "p"]
