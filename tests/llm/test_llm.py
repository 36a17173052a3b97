"""The ten operators and the pipeline against brute force, on a small table with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm")

from tidemark.llm import decontaminate, fingerprint, html, language, lm, neardup, pieces, pii, suffix, toxicity  # noqa: E402

EN = "the house and the garden of that old man with this long story from their town was told again "
DE = "der mann und die frau mit dem alten haus von einer langen geschichte ist nicht mehr hier "
WORDS = [f"w{(i * 7919) % 9973}x{i % 17}" for i in range(4000)]


def text(i, n):
    return " ".join(WORDS[(i * 131 + k * 7) % 4000] for k in range(n))


def rows():
    long = text(900, 3000)
    near = text(5, 80)
    out = [(i, EN * (4 + i % 3) + text(i, 12), "en", "s") for i in range(0, 30)]
    out += [(i, DE * (4 + i % 3) + text(i, 12), "de", "s") for i in range(30, 60)]
    out += [(60, None, "en", "s"), (61, "", None, "s"), (62, " \n\t ", "en", None), (63, long, "en", "s"), (64, long + " end", "en", "s")]
    out += [(65, near, "en", "s"), (66, near, "en", "s"), (67, near.replace("x5", "x5q", 1), "en", "s"), (68, "Mail a.b+c@ex-a.org or +1 (663) 555-6869, 10.0.0.255 999.1.1.1, 4111 1111 1111 1111, 4111111111111112.", "en", "s")]
    out += [(69, "日本語 🙂 text ▁ with  two  spaces\r\n", "en", "s"), (70, "a" * 5000, "en", "s"), (71, "1 " * 3000, "en", "s"), (72, "12345 !!! ...", "en", "s"), (73, "x", "en", "s")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string").withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))
    return df.withColumns({"rid": F.lit(1), "_text": F.lit("x"), "score": F.lit(0.5), "bucket": F.lit(3), "block": F.lit(1)}).repartition(3).checkpoint()


@pytest.fixture(scope="module")
def repeated(spark):
    some = [r for r in rows() if r[0] in (3, 65)]
    return spark.createDataFrame(some + some + [(None, "a null id", "en", "s")], "doc_id long, text string, lang string, source string")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def empty(docs):
    return docs.where("false")


def paragraphs(t):
    out = set()
    for line in re.split("[\x0a-\x0d]", t):
        part = []
        for m in re.finditer(r"[^\x20\x09-\x0D]+", line):
            part.append(m)
            if (len(part) >= 5 and m[0][-1] in ".!?05gkpwGKPW") or len(part) == 32:
                out.add(line[part[0].start() : part[-1].end()])
                part = []
        if part:
            out.add(line[part[0].start() : part[-1].end()])
    return out


def alike(a, b):
    x, y = paragraphs(a), paragraphs(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def check_fingerprints(found, order):
    """order: (doc_id, text) in descending order; found by doc_id and text."""
    for i, (doc, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = found[doc]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), doc
        assert abs(r["near_edited"] - alike(t, edited)) < 1e-9 and abs(r["near_next"] - alike(t, nxt)) < 1e-9, doc


def test_fingerprint(docs, repeated):
    got = by_id(fingerprint.op1(docs))
    check_fingerprints(got, sorted(((r[0], r[1]) for r in rows()), key=lambda r: -r[0]))
    assert got[65]["fingerprint"] == got[66]["fingerprint"] != got[67]["fingerprint"]
    assert fingerprint.op1(repeated).count() == 5 and fingerprint.op1(empty(docs)).count() == 0


def test_fingerprint_of_many_blocks(spark, monkeypatch):
    """Blocks finer than the quantiles, ids of all sizes, and tables too small at first."""
    monkeypatch.setattr(fingerprint, "SPLITS", 3)
    monkeypatch.setattr(fingerprint, "BLOCK", 1)
    items = [(i * i * i - 5000, text(i, 3 + i % 40) + (".\n" if i % 3 else "")) for i in range(120)] + [(-(1 << 62), text(1, 90)), ((1 << 62), text(2, 90))]
    got = by_id(fingerprint.op1(spark.createDataFrame(items, "doc_id long, text string").repartition(3), room=0.01))
    check_fingerprints(got, sorted(items, reverse=True))


def test_next_of_a_hot_id(spark, monkeypatch):
    """Many rows of one id stand in descending order of their texts' hashes, over several blocks."""
    monkeypatch.setattr(fingerprint, "BLOCK", 8)
    items = [(7 if i % 3 else i, f"text {i}") for i in range(150)]
    df = spark.createDataFrame(items, "doc_id long, text string")
    got = fingerprint.with_next(df).collect()
    assert len({r["block"] for r in got if r["doc_id"] == 7}) > 3
    rank = {r["text"]: r["r"] for r in df.select("text", F.pmod(F.xxhash64("text"), F.lit(1 << 62)).alias("r")).collect()}
    order = sorted(items, key=lambda x: (x[0], rank[x[1]]), reverse=True)
    assert {r["text"]: r["next_text"] for r in got} == {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}


def test_an_added_word_changes_few_paragraphs(spark):
    base_ = text(11, 400)
    pair = spark.createDataFrame([(2, base_), (1, "extra " + base_)], "doc_id long, text string")
    assert by_id(fingerprint.op1(pair))[2]["near_next"] == alike(base_, "extra " + base_) > 0.8


def test_peeling_retries_larger(spark):
    pairs = spark.createDataFrame([(1, list(range(1, 400)), list(range(100, 500))), (2, [], []), (3, [7], [7])], "id int, left array<long>, right array<long>")
    bad = fingerprint.decode(pairs, ["id"], room=0.01).where("id = 1").first()
    assert not bad["decoded"]
    got = {r["id"]: r for r in fingerprint.decode(pairs, ["id"], seed=2).collect()}
    assert (got[1]["only_left"], got[1]["only_right"], got[1]["decoded"]) == (99, 100, True)
    assert set(got) == {1}  # equal versions leave no live cell


def test_language_model(docs, repeated):
    got = by_id(lm.op2(docs))
    counts, held = Counter(), {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows()}
    for i, t, *_ in rows():
        if not held[i]:
            counts.update(words(t) + [None])
    n = sum(counts.values())
    base = math.log10(n + 0.1 * (len(counts) + 1))
    for i, t, *_ in rows():
        own, r = words(t) + [None], got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[i], len(own), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in own)
        assert abs(r["base_score"] - sum(math.log10(counts[w] + 0.1) - base for w in own)) < 1e-6
        assert r["score"] < 0
    assert lm.op2(repeated).count() == 5 and lm.op2(empty(docs)).count() == 0


def test_model_is_normalised():
    import numpy as np

    m = lm.LogBilinear(np.array([0.5, 0.3, 0.2]))
    one, two, norm = m.tables()
    p = np.exp(one[:, None, :] + two[None, :, :] - norm[:, :, None])
    assert np.allclose(p.sum(-1), 1, atol=1e-5)


def test_pieces(docs, repeated):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [t or "" for _, t, *_ in rows()]
    plain = pieces.Encoder(dropout=0.0).encode(texts, [0] * len(texts))
    for t, ids in zip(texts, plain, strict=True):
        if "▁" not in t:
            assert ids.tolist() == sp.encode(t, num_threads=1)
    got = pieces.encode(docs.select("doc_id", "text"), ["doc_id"], dropout=0.3, with_ids=True)
    back = by_id(pieces.decode(got))
    assert all(back[i]["text"] == (t or "") and back[i]["lossless"] for i, t, *_ in rows())
    a = pieces.Encoder(dropout=0.3, seed=1).encode(texts, [1] * len(texts))
    b = pieces.Encoder(dropout=0.3, seed=1).encode(texts, [1] * len(texts))
    c = pieces.Encoder(dropout=0.3, seed=2).encode(texts, [1] * len(texts))
    assert all(x.tolist() == y.tolist() for x, y in zip(a, b, strict=True)) and any(x.tolist() != y.tolist() for x, y in zip(a, c, strict=True))
    assert pieces.op3(repeated).count() == 5 and pieces.op3(empty(docs)).count() == 0


def test_language(docs, repeated):
    got = by_id(language.op4(docs))
    for i, t, lang, _ in rows():
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        if i < 60:
            assert got[i]["lang_pred"] == lang and 0 < got[i]["score"] <= 1
    assert {got[i]["lang_pred"] for i in (60, 61, 62, 72)} == {"und"}
    assert language.op4(repeated).count() == 5 and language.op4(empty(docs)).count() == 0


def test_language_of_four():
    import numpy as np

    names = ["aa", "bb", "cc", "dd", "ee"]
    alphabets = ["abcd", "efgh", "ijkl", "mnop", "qrst"]
    rng = np.random.default_rng(5)
    texts = [" ".join("".join(rng.choice(list(a), 6)) for _ in range(400)) for a in alphabets]
    logs = []
    for t in texts:
        packed = language.Packed([t.encode()])
        c = np.bincount(language._ngrams(packed)[0], minlength=language.BUCKETS) + 0.2
        logs.append(np.log(c / c.sum()))
    model = language.LanguageModel(names, np.array(logs, np.float32))
    for m in range(1, 6):
        shares, used = model.proportions([" ".join(texts[:m]).encode()])
        assert used[0] == m and np.allclose(shares[0, :m], 1 / m, atol=0.02), (m, shares)


def test_html(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/a'>menu</a></li></ul></nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>First <b>bold\n text.<br><p>Second one is longer than it was.</p><div class='comments'>me too</div><script>var t='</p>';</script></article><footer>&copy; foot</footer></body></html>"
    pages = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "v", "<p>no article here at all</p><form>send</form>"), (1, "u", page), (5, "w", "<<<>>> & < broken")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html.op5(pages).collect()
    assert len(got) == 6
    one = [r for r in got if r["page_id"] == 1]
    assert len(one) == 2 and one[0]["text"] == "A & B\n\nFirst bold text.\n\nSecond one is longer than it was."
    assert one[0]["n_chars"] == len(one[0]["text"])
    assert {r["text"] for r in got if r["page_id"] in (2, 3)} == {""}
    assert html.op5(pages.where("false")).count() == 0


def test_html_boxes_and_wrappers():
    weights = {"word p": 2.0, "word skip": -4.0, "p": -0.1, "/p": -0.1, "article": -0.1, "aside": -1.0, "/aside": -1.0}
    first, second = "one two three four five six seven", "eight nine ten eleven twelve and more"
    box = "<aside><p>" + "buy this now " * 20 + "</p></aside>"
    want = first + "\n\n" + second
    body = f"<article><p>{first}</p>{box}<p>{second}</p></article>"
    for wrapper in ("", "has-sidebar", "no-comments wide", "with-header", "page header-fixed"):
        assert html.extract(f"<body><div class='{wrapper}'>{body}</div></body>", weights)[0] == want, wrapper
    both = f"<body><div class='related'><article><p>teaser text</p></article></div>{body}</body>"
    assert html.extract(both, weights)[0] == want
    marks = {"main-sidebar": True, "sidebar_right": True, "ad": True, "has-sidebar": False, "is-sponsored": True, "shadow": False}
    assert {k: html._skipped("div", f' class="{k}"') for k in marks} == marks


def test_html_score_decides():
    """Without article or main: unlisted boxes go by the scan, doubtful class words by their own score; both stay with scores that never cost."""
    weights = {"word p": 1.0, "word div": -1.0, "word li": -1.0, "word link": -3.0, **{t: -0.2 for t in ("p", "/p", "div", "/div", "li", "/li", "ul", "/ul", "a", "/a", "h1", "/h1")}}
    flat = {k: 1.0 if k.startswith("word") else 0.0 for k in weights}
    rail = "<div class='rail'><ul>" + "<li><a href='/x'>some place</a></li>" * 6 + "</ul></div>"
    body = "<p>One two three four five six.</p><p>Seven eight nine ten eleven.</p>"
    want = "One two three four five six.\n\nSeven eight nine ten eleven."
    assert html.extract(f"<body>{rail}<div>{body}</div>{rail}</body>", weights)[0] == want
    assert "some place" in html.extract(f"<body>{rail}<div>{body}</div>{rail}</body>", flat)[0]
    inner = "<div class='related-posts'><ul>" + "<li><a href='/x'>another post</a></li>" * 3 + "</ul></div>"
    work = "<div class='related-work'><p>Others have found the same before.</p></div>"
    long = "<p>" + "word " * 60 + "</p>"
    page = f"<body><article>{long}{inner}{work}{long}</article></body>"
    got = html.extract(page, weights)[0].split("\n\n")
    assert got == [("word " * 60).strip(), "Others have found the same before.", ("word " * 60).strip()]
    assert "another post" in html.extract(page, flat)[0]


def test_html_without_any_marks(spark):
    """Weights from marked pages find the article where neither its element nor a box's name is left; the scan does it, not the lists."""
    marked = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    weights = html.fit_weights(marked)
    flat = {k: 1.0 if k.startswith("word") else 0.0 for k in weights}
    pages = [r["html"] for r in marked.select("html").collect() if r["html"] and "<article" in r["html"]]
    bare = [re.sub(r"<(/?)(nav|footer|aside|header)\b", r"<\1div", re.sub(r"</?article[^>]*>", "", p)).replace('class="ad"', 'class="x1"') for p in pages]
    want = [html.extract(p, weights)[0] for p in pages]
    assert pages and [html.extract(p, weights)[0] for p in bare] == want
    assert all(html.extract(p, flat)[0] != w for p, w in zip(bare, want, strict=True))


def test_html_loses_nothing_else():
    weights = {"word p": 1.0, "word h1": 1.0, **{e + t: -0.2 for t in ("p", "h1", "div", "article") for e in ("", "/")}}
    head = "<article><p>" + "before it stand words " * 5 + "</p>"
    tail = "<p>" + "after it stand words " * 5 + "</p></article>"
    first, last = ("before it stand words " * 5).strip(), ("after it stand words " * 5).strip()
    for odd in ("<svg width='3' />", "<svg><text>axis</text></svg>", "<p><button>press</p>", "<select><option>one</select>", "<canvas></canvas>", "<iframe src='x'>frame</iframe>"):
        assert html.extract(head + odd + tail, weights)[0] == first + "\n\n" + last, odd
    for name in ("math", "object", "video"):
        assert html.extract(f"{head}<p>Here <{name}>is x</{name}> kept.</p>{tail}", weights)[0] == f"{first}\n\nHere is x kept.\n\n{last}", name
    assert html.extract(f"<article><div class='article-header'><h1>The heading of it</h1></div><p>{first}</p></article>", weights)[0] == "The heading of it\n\n" + first
    assert "wow" in html.extract("<article><p>" + "<blink>wow</blink> " * 3 + "and many more plain words " * 20 + "</p></article>", weights)[0]
    bare = {"word p": 1.0, "word div": -4.0, "p": -0.2, "/p": -0.2}
    assert html.extract("<body><div>all of the text is in here and nowhere else</div></body>", bare)[0] == "all of the text is in here and nowhere else"
    assert html.extract("<body><article><div>all of the text is in here and nowhere else</div></article></body>", bare)[0] == "all of the text is in here and nowhere else"
    odd = html.pieces("<x-one>a</x-one><x-two>b</x-two>")
    assert {p[0] for p in odd} == {"other", "/other", "word body"}
    many = "<button>" * 20000 + "text"
    assert html.extract(many, weights)[0] == ""


def brute_suffix(items):
    seen, out = set(), {}
    for i, t in items:
        b = (t or "").encode()
        covered, end = bytearray(len(b)), 0
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                covered[max(end, s) : s + 100] = b"\1" * (s + 100 - max(end, s))
                end = s + 100
            else:
                seen.add(w)
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        spans = sum(1 for k in range(len(covered)) if covered[k] and (k == 0 or not covered[k - 1]))
        out[i] = (len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix(docs, repeated):
    got = by_id(suffix.op6(docs))
    for i, want in brute_suffix(sorted((r[0], r[1]) for r in rows())).items():
        assert tuple(got[i])[1:] == want, i
    again = suffix.op6(repeated).collect()
    assert len(again) == 5 and sum(r["n_removed"] == r["n_bytes"] for r in again) == 2
    assert suffix.op6(empty(docs)).count() == 0


def test_suffix_hot_anchors(docs, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_BATCH", 1)  # goes to the tasks with the function that uses it
    got = by_id(suffix.op6(docs))
    for i, want in brute_suffix(sorted((r[0], r[1]) for r in rows())).items():
        assert tuple(got[i])[1:] == want, i


def periodic_rows():
    base = text(77, 120)
    near = [(200 + i, base.replace(WORDS[(77 * 131 + 7 * (i % 110)) % 4000], f"changed{i}", 1)) for i in range(1000)]
    out = [(i, ("foo bar " * (100 + 3 * i) + f"end{i}")[i % 5 :]) for i in range(40)]
    out += [(100, "ab" * 2000), (101, "b" + "ab" * 900), (102, "x" * 250 + "y" + "x" * 250), (103, "one line of a page that many hold\n" * 60), (None, "foo bar " * 50)]
    return out + near


def test_suffix_periodic_and_near_copies(spark):
    """Periods of all sorts and a thousand near copies, many windows of one anchor."""
    items = periodic_rows()
    got = suffix.op6(spark.createDataFrame(items, "doc_id long, text string").repartition(5)).collect()
    want = brute_suffix(sorted(items, key=lambda r: (r[0] is None, r[0] or 0)))
    assert len(got) == len(items)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


def test_suffix_equal_windows_despite_collisions(monkeypatch):
    """With hashes that are all equal the byte comparison alone finds the classes."""
    import numpy as np

    monkeypatch.setattr(suffix.SuffixSort, "common", lambda self, x, y, known=8: np.full(len(x), suffix.LENGTH))
    rng = np.random.default_rng(3)
    rows_ = [bytes([65] * 8 + rng.integers(65, 67, 92).tolist()) for _ in range(6)]
    picked = [0, 1, 2, 0, 3, 1, 4, 5, 0]
    buf = np.frombuffer(b"".join(rows_[i] for i in picked), np.uint8)
    later = suffix.repeats(buf, np.arange(len(picked)) * 100, np.zeros(len(picked), np.int64))
    assert later.tolist() == [picked.index(i) != k for k, i in enumerate(picked)]


def test_suffix_sort_is_a_sort():
    import numpy as np

    rng = np.random.default_rng(3)
    buf = rng.integers(97, 99, 4000, dtype=np.uint8)
    at = np.arange(0, 3000, 3)
    group = np.sort(rng.integers(0, 5, len(at)))
    order = suffix.SuffixSort(buf)
    order.common.__func__.__defaults__
    plain = sorted(range(len(at)), key=lambda e: (group[e], buf[at[e] : at[e] + 100].tobytes(), e))
    order.common = lambda x, y, known=0, f=suffix.SuffixSort.common: f(order, x, y, 0)
    assert order.order(at, group).tolist() == plain


def test_toxicity(spark, docs):
    bad = [(1000 + i, EN + ("what a scumbag fool you are. " if i % 2 else "a fine day. ") + text(i, 20), None, None) for i in range(240)]
    more = spark.createDataFrame(bad + [(60, None, None, None)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(1000 + i, i % 2, 1) for i in range(240)] + [(5, None, 1), (None, 1, 1), (60, 0, 0)], "doc_id long, toxic int, quality int")
    got = by_id(toxicity.op7(more, labels))
    assert all(got[1000 + i]["held_out"] == (zlib.crc32(str(1000 + i).encode()) % 3 == 1) for i in range(240))
    held = [i for i in range(240) if got[1000 + i]["held_out"]]
    assert sum(got[1000 + i]["predicted"] == i % 2 for i in held) > 0.95 * len(held)
    spot = got[1001]
    assert (EN + "what a scumbag")[spot["worst_offset"] :].startswith(("the house", "what")) and 0 <= got[60]["score"] <= 1
    assert toxicity.op7(docs, labels.where("false")).agg(F.max("score")).first()[0] == 0
    assert toxicity.op7(more.where("false"), labels).count() == 0


def test_string_tiling(spark, docs):
    item = "one two three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny item"), (5, text(3, 12))], "item_id long, text string")
    turned = "seven, eight nine TEN eleven twelve -- filler words here -- one two three four five six!"
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(200, "x " + item + " y"), (201, turned), (202, "one two three four five six and nothing"), (203, "one two three four"), (204, "a tiny item"), (None, item), (200, "x " + item + " y")], "doc_id long, text string"))
    got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.op8(more, bench).collect())
    assert got == Counter({(200, 1): 2, (201, 1): 1, (202, 1): 1, (204, 4): 1, (None, 1): 1, (3, 5): 1, (63, 5): 1, (64, 5): 1})
    assert decontaminate.without_leaks(more, bench).count() == more.count() - 9
    assert decontaminate.op8(empty(docs), bench).count() == 0 and decontaminate.op8(docs, bench.where("false")).count() == 0


def brute_components(items):
    sets = {}
    for i, t in items:
        w = words(t)
        sets[i] = frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset()
    ids = sorted(sets)
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("dense", [64, 1])
def test_near_duplicates(docs, repeated, monkeypatch, dense):
    monkeypatch.setattr(neardup, "DENSE", dense)
    got = by_id(neardup.op9(docs))
    for i, (n, c) in brute_components([(r[0], r[1]) for r in rows()]).items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, c, i == c), i
    again = neardup.op9(repeated).collect()
    assert len(again) == 5 and [r["component_id"] for r in again if r["doc_id"] is None] == [None]
    assert neardup.op9(empty(docs)).count() == 0


@pytest.mark.parametrize("percent", [40, 80])
def test_long_sets_meet_by_segments(percent):
    import numpy as np

    rng, told = np.random.default_rng(percent), {True: 0, False: 0}
    for trial in range(60):
        a = rng.integers(0, 1 << 64, int(rng.integers(3000, 9000)), dtype=np.uint64)
        common = a[: int(len(a) * (rng.uniform(0.3, 1) if trial % 3 else 0.1))]
        b = np.concatenate((common, rng.integers(0, 1 << 64, int(rng.integers(0, 2000)), dtype=np.uint64)))
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        full, n = np.concatenate((a, b)), np.array([len(a), len(b)])
        shingle, segment, of, name = neardup.segments(full, np.repeat([0, 1], n), n, percent)
        size, maps, found = np.bincount(segment), neardup._bitmaps(shingle, segment, len(of)).view(np.uint64), False
        for x in np.flatnonzero(of == 0):
            for y in np.flatnonzero((of == 1) & (name == name[x])):
                most = (size[x] + size[y] - int(np.bitwise_count(maps[x] ^ maps[y]).sum())) // 2
                found |= bool(100 * most >= percent * (size[x] + size[y] - most))
        alike = 100 * both >= percent * (len(a) + len(b) - both)
        assert found or not alike
        told[found] += not alike
    # sets that have little in common were compared on full sets, whatever their bitmap of 1,024 bits
    assert percent < 80 or told[False] > 5 * told[True]


@pytest.mark.parametrize("block", [1024, 16])
def test_near_duplicates_of_a_hot_template(spark, monkeypatch, block):
    """Documents just under 0.8 alike, and pairs among them that reach it."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    items = []
    for i in range(400):
        own = [f"o{i // 2}y{k}" for k in range(28)]
        if i % 2:
            own[:20] = [f"z{i}y{k}" for k in range(20)]
        items.append((i, " ".join(WORDS[:170] + own)))
    df = spark.createDataFrame(items, "doc_id long, text string")
    want = brute_components(items)
    assert len({c for _, c in want.values()}) == 200
    got = by_id(neardup.op9(df))
    assert {i: got[i]["component_id"] for i, _ in items} == {i: c for i, (_, c) in want.items()}


@pytest.mark.parametrize("percent", [40, 60, 80, 95])
def test_similar_sets_share_a_link(percent):
    """Every pair of sets alike enough has a link in common, whatever the order of rarity."""
    import numpy as np

    rng = np.random.default_rng(percent)
    counts, alike = rng.integers(0, 4, neardup.COUNTED).astype(np.uint8), 0
    for _ in range(3000):
        pool = rng.integers(1, 1 << 63, 60, dtype=np.uint64)
        common, more = rng.integers(1, 40), rng.integers(0, 12)
        a = np.unique(np.concatenate((pool[:common], pool[40 : 40 + rng.integers(0, more + 1)])))
        b = np.unique(np.concatenate((pool[:common], pool[52 : 52 + rng.integers(0, 8)])))
        both = len(np.intersect1d(a, b))
        if 100 * both < percent * (len(a) + len(b) - both) or (len(a) == len(b) == both):
            continue
        alike += 1
        keys, owner = neardup.links(np.concatenate((a, b)), np.repeat([0, 1], [len(a), len(b)]), np.array([len(a), len(b)]), percent, counts)
        assert np.isin(keys[owner == 0], keys[owner == 1]).any()
    assert alike > 50


def test_near_duplicates_of_a_larger_table(spark):
    """All links of 1,500 documents against brute force over their full sets."""
    import random

    rng, items = random.Random(8), []
    for i in range(1500):
        if i % 3 == 0 or not items:
            words_ = [rng.choice(WORDS[:600]) for _ in range(rng.randint(3, 120))]
        else:
            words_ = items[rng.randrange(len(items))][1].split()
            for _ in range(rng.randint(0, 1 + len(words_) // 12)):
                words_[rng.randrange(len(words_))] = rng.choice(WORDS[:600])
        items.append((i, " ".join(words_)))
    want = brute_components(items)
    got = by_id(neardup.op9(spark.createDataFrame(items, "doc_id long, text string").repartition(6)))
    assert {i: got[i]["component_id"] for i, _ in items} == {i: c for i, (_, c) in want.items()}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (300, 300)], "lo long, hi long")
    got = {r["vertex"]: r["component"] for r in neardup.components(edges).collect()}
    assert all(got[i] == 0 for i in range(101)) and got[201] == 200 and 300 not in got


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def base(t):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    ok = {"email": lambda v, d: True, "ip": lambda v, d: all(int(x) <= 255 for x in v.split(".")), "card": lambda v, d: 13 <= len(d) <= 19 and luhn(d), "phone": lambda v, d: 9 <= len(d) <= 15}
    return [f"{k}:{m.start()}:{m.end()}" for k, p in patterns.items() for m in re.finditer(p, t or "") if ok[k](m[0], re.sub("[^0-9]", "", m[0]))]


def test_pii(docs, repeated, spark):
    got = by_id(pii.op10(docs))
    for i, t, *_ in rows():
        spans = base(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), i
        assert got[i]["n_email"] == sum(s.startswith("email") for s in spans)
    assert (got[68]["n_email"], got[68]["n_ip"], got[68]["n_card"], got[68]["n_phone"]) == (1, 1, 1, 1)
    tricky = ["a@b.c+x@y.zz", "x" * 3000 + "@a.b", "+1 23 +44 20 7946 0958", "00010.1.1.1 1.2.3.4.5.6.7.8", "🙂 mail: é.a@b.co", "1-2-3-4", None]
    df = spark.createDataFrame(list(enumerate(tricky)), "doc_id long, text string")
    for i, r in by_id(pii.op10(df)).items():
        assert r["spans"] == ",".join(base(tricky[i])), i  # too few texts for evidence of terms
    assert pii.op10(repeated).count() == 5 and pii.op10(empty(docs)).count() == 0


def test_revealing_terms(spark):
    talk = [f"note {i} {a} agent zorblax {b} joe.x@corp.example called {c} today" for i, (a, b, c) in enumerate([("my", "wrote", "me"), ("our", "alias", "us"), ("their", "named", "them"), ("some", "under", "him")])]
    df = spark.createDataFrame(list(enumerate(talk + [f"plain text number {i} my our me us" for i in range(400)])), "doc_id long, text string")
    got = by_id(pii.op10(df))
    assert all("term:" in got[i]["spans"] and got[i]["n_term"] >= 1 for i in range(4)) and all(got[i]["spans"] == "" for i in range(4, 404))
    spans = pii.with_spans(df)
    clean = {r["i"]: r["t"] for r in spans.select("doc.doc_id", pii.sanitise(F.col("doc.text"), F.concat("base", "terms")).alias("t")).toDF("i", "t").collect()}
    assert "joe.x" not in clean[0] and "zorblax" not in clean[0] and "[EMAIL]" in clean[0] and clean[10] == "plain text number 6 my our me us"


def test_one_text_and_near_copies_prove_nothing(spark):
    import random

    rng = random.Random(2)
    words = [f"{a}{b}word" for a in "abcdefghij" for b in "klmnopqrst"]
    plain = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(300)]
    alone = " ".join(rng.choice(words) for _ in range(40)) + " hapaxone hapaxtwo bob.y@corp.example"
    first = " ".join(rng.choice(words) for _ in range(60)) + " nearcopy ann.z@corp.example"
    copies = [first + f" version{'abcdef'[k]}" for k in range(6)]
    planted = [f"{' '.join(rng.choice(words) for _ in range(40))} glimmerstone {' '.join(rng.choice(words) for _ in range(5))} eve.q@corp.example" for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(plain + [alone] * 3 + copies + planted)), "doc_id long, text string")
    got = {r["s"]["value"] for r in pii.with_spans(df).select(F.explode("terms").alias("s")).collect()}
    assert got == {"glimmerstone"}


def brute_terms(texts, evidence, apart):
    """Revealing terms, and whether each is generalised, with threshold 1. apart(texts): whether they are no near copies of one."""
    texts = sorted(set(texts))
    n, terms, entities = len(texts), {}, {}
    for i, t in enumerate(texts):
        for w in set(re.findall(r"[^\x20\x09-\x0D]+", t.lower())):
            if re.search(r"[^\W\d_]{3}", w):
                terms.setdefault(w, set()).add(i)
        for m in re.finditer(r"[a-z.]+@[a-z.]+", t):
            entities.setdefault(m[0], set()).add(i)
    stems = {}
    for w, at in terms.items():
        stems.setdefault(w[:4], set()).update(at)
    bits = evidence + math.log2(len(entities)) + math.log2(len(terms) + len(stems))
    out = {}
    for at in entities.values():
        content = math.log2(n / len(at))
        for w, own in terms.items():
            if own <= at and len(at) < n and len(own) * content >= bits and len(own) > 1 and apart([texts[i] for i in own]):
                out[w] = out.get(w, True) and len(w) > 4 and math.log2(n / len(stems[w[:4]])) < content - 1e-9
    return out


def test_revealing_terms_against_brute_force(spark):
    import random

    rng = random.Random(5)
    people = [f"{x}@corp{k}.example" for k, x in enumerate(("ada", "bob", "cyd", "dan"))]
    texts = []
    for i in range(300):
        who = rng.choice(people) if i % 6 == 0 else ""
        secret = {"": "", people[0]: "xylophonist lives", people[1]: "beekeeper"}.get(who, rng.choice(("beekeepers", "")))
        texts.append(" ".join([*(rng.choice(WORDS[:200]).replace("w", "word") for _ in range(rng.randint(0, 30))), who, secret, f"single{i}" if i % 4 else ""]))
    sig = {r["text"]: r["sig"] for r in pii.distinct_texts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    lanes = lambda x: [x >> 16 * k & 0xFFFF for k in range(4)]
    want = brute_terms(texts, 4.0, lambda some: sum(len(set(lane)) > 1 for lane in zip(*(lanes(sig[t]) for t in some), strict=True)) >= pii.APART)
    assert {"xylophonist", "lives"} <= set(want) and len(set(want.values())) == 2 and not any(w.startswith("single") for w in want)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:40])], "doc_id long, text string")
    got = pii.with_spans(df, evidence=4.0).select("doc.text", F.explode("terms").alias("s")).collect()
    assert {(r["s"]["value"].lower(), r["s"]["kind"] == "general") for r in got} == {(w, g) for w, g in want.items() if "@" not in w}
    assert all(r["text"][r["s"]["start"] : r["s"]["stop"]] == r["s"]["value"] for r in got)
    assert not pii.with_spans(df, evidence=1e9).where("size(terms) > 0").count()


CLASHING = ("score", "mixture", "lang_pred", "n_langs", "_text", "terms", "_id", "_hash", "_spans", "spans", "variant", "n_pieces", "ids", "doc", "key", "base", "clean", "block", "rid", "component_id", "kept", "a b.c")


def test_pipeline(spark, docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    leak = "alpha bravo charlie delta echo foxtrot golf hotel india juliet"
    extra = spark.createDataFrame([(300, EN + leak, "en", "s", 1), (301, EN + text(7, 40), "en", "s", 1), (301, DE * 5 + text(9, 30), "de", "s", 1), (301, DE * 5 + text(9, 30), "de", "t", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    table = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(extra).withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in CLASHING})
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak, "x", 0.5)], "item_id long, text string, doc string, score double").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows_ = pipeline.run(spark, str(tmp_path)).collect()
    got = {r["doc_id"]: r for r in rows_}
    assert not {60, 61, 62, 72, 66, 300} & set(got) and {0, 30, 65, 68} <= set(got)
    assert "a.b+c@ex-a.org" not in got[68]["text"] and "[EMAIL]" in got[68]["text"] and got[68]["n_chars"] == len(got[68]["text"])
    assert all(r["lossless"] for r in rows_)
    assert sorted(r["lang"] + r["source"] for r in rows_ if r["doc_id"] == 301) == ["des", "ens"]  # two texts of one id stay, repeated rows don't
    assert all(r[c] == f"{c}{r['doc_id']}" for r in rows_ for c in CLASHING if c not in ("variant", "n_pieces", "ids"))
    for _, stage in pipeline.STAGES:
        assert stage(spark, table.where("false"), str(tmp_path)).count() == 0


def test_components_leave_the_driver_little(spark):
    """No broadcasts, which the driver would build in threads of its own in every round."""
    n = 40
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(100, 100 + k) for k in range(1, n)], "lo long, hi long").repartition(4)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    got = {r["vertex"]: r["component"] for r in neardup.components(edges).collect()}
    assert got == {k: 0 for k in range(n + 1)} | {100 + k: 100 for k in range(n)}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = [store.executionsList().apply(k).physicalPlanDescription() for k in range(before, store.executionsList().size())]
    assert ran and not any("BroadcastExchange" in plan for plan in ran)


def test_stars_keep_components(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(neardup, "CONTRACTED", 5)
    rng = random.Random(3)
    for name in (str, int):
        pairs = [(name(rng.randrange(60)), name(rng.randrange(60))) for _ in range(45)]
        batches = [pa.RecordBatch.from_pydict({"lo": [p[0] for p in pairs[i : i + 3]], "hi": [p[1] for p in pairs[i : i + 3]]}) for i in range(0, len(pairs), 3)]
        out = [(r["lo"], r["hi"]) for b in neardup._spanning(iter(batches)) for r in b.to_pylist()]
        assert all(lo < hi for lo, hi in out) and len(out) <= len(pairs)

        def groups(edges):
            at = {}
            for lo, hi in edges:
                one = at.get(lo, {lo}) | at.get(hi, {hi})
                at |= dict.fromkeys(one, one)
            return {frozenset(x) for x in at.values() if len(x) > 1}

        assert groups(out) == groups(pairs)
        whole = neardup._stars(pa.Table.from_batches(batches)).to_pylist()
        assert {frozenset([r["lo"], *(x["hi"] for x in whole if x["lo"] == r["lo"])]) for r in whole} == groups(pairs)
        assert all(r["lo"] == min(g) for r in whole for g in groups(pairs) if r["hi"] in g)


def test_near_duplicates_leave_the_driver_little(spark, docs, tmp_path):
    """No plan of many joins: the driver keeps all metrics of a plan anew as often as one of its stages ends, and its description."""
    import corpus_pipeline as pipeline

    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    assert pipeline.unique(spark, docs, str(tmp_path)).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = [store.executionsList().apply(k) for k in range(before, store.executionsList().size())]
    assert ran and max(x.metrics().size() for x in ran) < 2500
    assert max(len(x.physicalPlanDescription()) for x in ran) <= 16 << 10
