"""Fingerprints, chats, pages, languages, quality, repeats, mixing and packing."""

import hashlib
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from llm_helpers import brute_repeats, read_back

from kinloom.llm import chat, fingerprints, html, language, mixing, packing, quality, repeats, tokens


# fingerprints

def test_edited_texts_and_equality(odd_docs, random_docs, no_docs):
    rows = {r.doc_id: r.text for r in random_docs.collect()}
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(random_docs).collect()}
    ids = sorted(rows, reverse=True)
    for i, nxt in zip(ids, [*ids[1:], ids[0]]):
        h = len(rows[i]) // 2
        edited = rows[i][:len(rows[i]) - h] + rows[nxt][:h]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].n_chars == len(rows[i]) and 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert (got[i].fingerprint == got[nxt].fingerprint) == (sorted(rows[i].split("\n")) == sorted(rows[nxt].split("\n")))
    long = [i for i in ids if len(rows[i].split()) > 40]
    assert np.mean([got[i].near_edited for i in long]) > 0.3 + np.mean([got[i].near_next for i in long if got[i].near_next < 1])
    assert fingerprints.edited_fingerprints(odd_docs).count() == odd_docs.count()
    assert fingerprints.edited_fingerprints(no_docs).count() == 0


def test_ranges_of_ids_leave_neighbours_alone(spark, monkeypatch):
    docs = spark.createDataFrame([(i * i, f"text {i}") for i in range(400)], "doc_id bigint, text string")
    monkeypatch.setattr(fingerprints.id_splits, "__defaults__", (8, 4096))
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.edited_fingerprints(docs).collect()}
    for i in range(400):
        t, n = f"text {i}", f"text {(i - 1) % 400}"
        h = len(t) // 2
        assert got[i * i] == hashlib.sha256((t[:len(t) - h] + n[:h]).encode()).hexdigest()


def test_paragraphs_come_and_go(spark):
    df = spark.createDataFrame([("a b c\nd e\na b c", "d e", "a b c\na b c")], "whole string, part string, rest string")
    for c in ("whole", "part", "rest"):
        df = fingerprints.with_fingerprint(df, c, c[0])
    less = df.withColumns(fingerprints.changed("w", "p", "x", -1)).withColumns(fingerprints.changed("r", "p", "y"))
    r = less.first()
    assert (r.xexact, r.xsketch, r.xn) == (r.rexact, r.rsketch, r.rn)
    assert (r.yexact, r.ysketch, r.yn) == (r.wexact, r.wsketch, r.wn)
    both = df.select("pexact", "psketch", "pn").union(df.select("rexact", "rsketch", "rn")).selectExpr("1 AS k", "*")
    m = fingerprints.merged(both, "k", "p").first()
    assert (m.pexact, m.psketch, m.pn) == (r.wexact, r.wsketch, r.wn)


# chats

TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", r"<\s> <\\s> [\INST] <|image|>"), (1, 3, "assistant", ""),
    (2, 1, "assistant", "<s>" * 3), (2, 0, None, None), (None, 0, "a\nb%0A</s>", "<<SYS>> < [ \\"), (3, 0, "user", "x\n[INST] y [/INST]\n"), (3, 0, "user", "x\n[INST] y [/INST]\n")]


def test_chats_are_read_back(spark):
    df = spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_chats(df.select("conv_id", "turn", "role", chat.text_part(df["text"]).alias("parts")))
    got = {r.conv_id: r for r in chat.digest(out).collect()}
    raw = {r.conv_id: r for r in out.collect()}
    for c in {t[0] for t in TURNS}:
        own = sorted((t[1], t[2] or "", t[3] or "") for t in TURNS if t[0] == c)
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == len(raw[c].formatted) == sum(len(s.text) for s in raw[c].segments)
        masked = [s.text for s in raw[c].segments if s.loss]
        assert [raw[c].formatted[s.start:s.start + s.length] for s in raw[c].loss_spans] == masked
    assert chat.format_chats(df.select("conv_id", "turn", "role", chat.text_part(df["text"]).alias("parts")).limit(0)).count() == 0


def test_parts_become_placeholders(spark):
    parts = [("text", "see <|image|>", None, None), ("image", None, "a.png", 2), ("text", " and ", None, None), ("audio", None, "b.wav", None), ("video", None, "c", 1), (None, "end", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    r = chat.format_chats(df).first()
    assert r.formatted == "<s>user\n[INST] see <\\|image|><|image|> and <|audio|><|file|>end [/INST]</s><s>assistant\n</s>"
    assert [(a.part, a.type, a.ref, a.tokens) for a in r.attachments] == [(1, "image", "a.png", 512), (3, "audio", "b.wav", 25), (4, "file", "c", 128)]
    assert r.attachment_tokens == 665


# pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="sidebar"><p>Popular things of the week</p></div>%s<form><input><p>Your mail</p></form>
<div class="comments"><p>First comment, quite long so that it would count as text of the page</p></div><footer>&copy; us</footer><script>var x="</p>";</script></body></html>"""


def test_article():
    body = "<article><h1>A&amp;B</h1><p>One <b>bold</b>\n  text&nbsp;here.<p>x<br>y</p><div class='ad'>Buy</div><ul><li>i1<li><a href='#'>i2</a></ul></article>"
    assert html.main_text(PAGE % body) == "A&B\nOne bold text here.\nx y\ni1\ni2"


def test_page_without_an_article_element():
    body = "<div><h2>Head</h2><p>%s</p><p>short</p><p>%s</p></div>" % ("many words of prose " * 10, "more of it " * 12)
    assert html.main_text(PAGE % body).split("\n") == ["Head", ("many words of prose " * 10).strip(), "short", ("more of it " * 12).strip()]


def test_asides_split_no_page_without_an_article_element():
    line = lambda n: ("some words of prose here " * 40)[:n].strip()
    advert, menu = "<div class='ad'>Buy</div>", "<ul>" + "<li><a href=x>An entry of a menu, quite long so that it counts</a> |</li>" * 4 + "</ul>"
    for lengths in ((600, 500, 0, 250), (600, 0, 70), (70, 0, 600), (600, 0, 40, 0, 600), (300, 0, 90, 0, 30)):
        body = "".join(f"<p>{line(n)}</p>" if n else advert for n in lengths)
        assert html.main_text(PAGE % f"<div>{body}</div>").split("\n") == [line(n) for n in lengths if n]
    linked = "See <a href=x>a title that is much longer than the words around it</a> too."
    body = f"<p>{line(300)}</p><p>{linked}</p><p><a href=y>A title alone</a></p>{menu}<p>{line(200)}</p>{menu}"
    assert html.main_text(PAGE % f"<div>{body}</div>").split("\n") == [
        line(300), "See a title that is much longer than the words around it too.", line(200)]
    body = f"<p>{line(300)}</p><p><a href=y>A title alone</a></p><p>{line(200)}</p>"
    assert "A title alone" in html.main_text(PAGE % f"<div>{body}</div>")


def test_classes_that_speak_of_elsewhere():
    assert html.main_text("<html><head><title>T</title><body class='x'><div class='content has-sidebar'><p>Some text.</p></div><div class='side sidebar'>x</div>") == "Some text."
    assert html.main_text("<article><p>a</p><svg><text>z</svg><iframe src=x><p>b</p></article>") == "a\nb"


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>cut &am", "cut &am"), ("<article><p>cut <b cla", "cut"), ("<nav>a</nav>", ""), ("<!-- x", ""), ("<script>var a", ""),
    ("<article><p>1 < 2 &lt; 3</p></article>", "1 < 2 < 3")])
def test_odd_pages(page, text):
    assert html.main_text(page) == text


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE % "<main><p>Yes.</p></main>", 3), (2, None, None, 4), (2, None, None, 4)], "page_id bigint, url string, html string, text int")
    assert sorted(tuple(r) for r in html.extract(df).collect()) == [(1, "u", "Yes.", 4), (2, None, "", 0), (2, None, "", 0)]
    assert html.extract(df).count() == 3 and html.extract(df.limit(0)).count() == 0


# languages

def test_forward_sums_all_segmentations():
    path = language.default_path()
    pieces, byte_ids, n = language.vocabulary(path)
    p = np.random.default_rng(1).random((n, 2)) / n

    def total(s, k):
        if not s:
            return 1.0
        out = sum(p[pieces[s[:j]], k] * total(s[j:], k) for j in range(1, min(len(s), language.PIECE_LETTERS) + 1) if s[:j] in pieces)
        if s[0] not in pieces:
            out += max(np.prod([p[byte_ids[b], k] for b in s[0].encode()]), 1e-9) * total(s[1:], k)
        return out

    words = ["cat", "straße", "ab", "ᚠx"]
    got = language.word_scores(words, p, path)
    for w, row in zip(words, got):
        assert row == pytest.approx([np.log(total(language._START + w, k)) for k in (0, 1)])
    counts = language.expected_counts(["cat"], np.array([2.0]), p[:, :1], path)
    assert sum(counts[pieces[x]] * len(x) for x in pieces if counts[pieces[x]] > 0) == pytest.approx(2 * 4)


def test_languages_are_told_apart(spark, odd_docs, no_docs):
    en, de = "the house and with this that of other words were given", "der hund und mit dieser das von anderen worten wurde gegeben"
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice((en if i % 2 else de).split(), 12)), "en" if i % 2 else "de") for i in range(120)]
    df = spark.createDataFrame([*rows, (500, None, "en"), (501, "12 ?!", "en"), (502, "der hund", None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in language.identify(df).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows) and got[502].lang_pred == "de"
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert [(got[i].lang_pred, got[i].score) for i in (500, 501)] == [("und", 0.0)] * 2
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(no_docs).count() == 0 and language.identify(odd_docs).count() == odd_docs.count()
    assert {r.lang_pred for r in language.identify(df.withColumn("lang", df["lang"].substr(9, 1))).collect()} <= {"", "und"}
    kept = language.accepted(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 5, 6, 7, 8, 9, 12]


# quality

def test_two_views_teach_each_other(spark, odd_docs, no_docs):
    rng = np.random.default_rng(4)
    good, bad = [f"good{i}" for i in range(50)], [f"junk{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choice(bad if i % 4 == 0 else good, 30)) + (" | " * 20 if i % 4 == 0 else "."), "en", f"s{i % 3}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 600, 2)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert sum(got[i].keep == (i % 4 != 0) for i in range(600)) >= 594
    assert quality.score(odd_docs, model).count() == odd_docs.count() and quality.score(no_docs, model).count() == 0
    one = quality.train(docs, labels.where("quality = 1"))
    assert {r.score for r in quality.score(docs, one).collect()} == {1.0}
    assert quality.train(no_docs, labels.limit(0)).prior == 1.0


def test_all_unlabelled_documents_are_exchanged(spark):
    """Each document has a word of its own, of which a view gets a weight only if it is handed the document."""
    rng = np.random.default_rng(6)
    words = {True: [f"good{i}" for i in range(30)], False: [f"junk{i}" for i in range(30)]}
    rows = [(i, " ".join(rng.choice(words[i % 4 != 0], 6)) + f" own{i}" + ("." if i % 4 else " | " * 9), "en", "s") for i in range(24_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    assert np.count_nonzero(model.content.weights) > 1600  # 5 % of 16,000 documents in each of three rounds, and 450 at most of the others
    got = quality.score(docs, model).where((F.col("doc_id") % 4 != 0) == F.col("keep")).count()
    assert got >= 23_900


# repeats

@pytest.mark.parametrize("length", [50, 20])
def test_removed_bytes(spark, random_docs, monkeypatch, length):
    for name, size in (("CHUNK_BYTES", 3000), ("ANCHOR_BUCKET_BYTES", 5000), ("PART_BUCKET_BYTES", 5000)):
        monkeypatch.setattr(repeats, name, size)
    want = brute_repeats([(r.doc_id, r.text) for r in random_docs.collect()], length)
    assert {r.doc_id: tuple(r)[1:] for r in repeats.removals(random_docs, length).collect()} == want
    kept = {r.doc_id: r.text for r in repeats.trimmed(random_docs, length).collect()}
    assert all(hashlib.sha256(t.encode()).hexdigest() == want[i][3] for i, t in kept.items())
    assert set(want) - set(kept) == {i for i, w in want.items() if w[0] == w[1] > 0}


def test_odd_repeats(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = brute_repeats([x for x in rows if x[0] is not None], 50)
    got = {r.doc_id: tuple(r)[1:] for r in repeats.removals(odd_docs).collect()}
    assert {i: got[i] for i in want} == want and got[None][1] == 0
    assert repeats.removals(no_docs).count() == 0
    assert repeats.trimmed(odd_docs).columns == odd_docs.columns


def test_periodic_bytes_and_zero_bytes(spark):
    texts = ["ab" * 300, "xab" + "ab" * 100, "a" * 200, "b" + "a" * 120, "\0" * 80 + "q", "z" + "\0" * 70, "é" * 60, "aé" + "é" * 40, "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: tuple(r)[1:] for r in repeats.removals(df).collect()} == brute_repeats(list(enumerate(texts)), 50)


def test_classes_of_strings():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    order, number = repeats.string_classes(data, 6)
    raw = data.tobytes()
    by = {}
    for place, c in zip(order, number):
        if place + 6 <= len(raw):
            by.setdefault(c, set()).add(raw[place:place + 6])
    assert all(len(s) == 1 for s in by.values()) and len(by) == len({raw[i:i + 6] for i in range(395)})


# mixing

def test_mix(spark, odd_docs, random_docs, no_docs):
    for docs in (random_docs, odd_docs):
        taken, plan = mixing.mix(docs, block=16)
        rows = taken.collect()
        assert len(rows) == docs.count()
        sources = {r.src: (r.source_size, r.target) for r in rows}
        total = sum(s for s, _ in sources.values())
        assert sum(t for _, t in sources.values()) == pytest.approx(total)
        for k, (size, target) in sources.items():
            assert target <= 3 * size + 1e-9
            assert abs(sum(r.taken for r in rows if r.src == k) - target) <= 0.5
        assert all(0 <= r.taken <= 3 * r.size for r in rows)
        assert sum(r.words for r in plan.collect()) == sum(r.taken for r in rows)
        assert sorted(map(str, mixing.mix(docs, block=16)[0].collect())) == sorted(map(str, rows))
    assert mixing.mix(no_docs)[0].count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def test_every_source_appears_evenly(random_docs):
    _, plan = mixing.mix(random_docs, block=4)
    slots = [r.src for r in plan.orderBy("slot").collect()]
    for s in set(slots):
        at = [i for i, x in enumerate(slots) if x == s]
        share = len(at) / len(slots)
        assert all(abs(k - share * i) <= 6 for k, i in enumerate(at))


def test_mixed_documents_hold_the_words_taken(odd_docs, random_docs):
    for docs in (odd_docs, random_docs):
        out = mixing.mixed_documents(docs)
        assert out.columns == docs.columns
        words = sum(len([w for w in r.text.replace("\n", " ").replace("\t", " ").split(" ") if w]) for r in out.collect())
        assert words == sum(r.taken for r in mixing.mix(docs)[0].collect())


# packing

def test_ids_are_those_of_the_tokenizers_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    for text in ("", "hello world", " two  spaces\n\nand\tlines ", "éàü ñ 汉字 \U0001f600", "<|endoftext|> x", "a" * 3000, "don't 12345 !!??", " x y"):
        assert tokens.ids(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_packed_ids_are_the_default_ids_of_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y\n <|endoftext|>", "<|endoftext|", "<|ENDOFTEXT|> z", "plain words, 12 of them"]
    want = {i: np.array([*t.encode(x, add_special_tokens=False).ids, packing.END_ID], "<u4") for i, x in enumerate(texts)}
    assert want[0].tolist() == [64, 220, 50256, 275, packing.END_ID]
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.start, r.length, r.ids_crc32) for r in rows} == {i: (0, len(x), zlib.crc32(x.tobytes())) for i, x in want.items()}


def check_packing(docs, most):
    rows = packing.pack_documents(docs, most).collect()
    texts = sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert read_back(rows) == sorted((d, len(tokens.ids(t)) + 1) for d, t in texts)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= most
    return len(bins), sum(r.length for r in rows)


def test_packing(odd_docs, random_docs, no_docs):
    for docs in (odd_docs, random_docs):
        for most in (64, 1024):
            bins, total = check_packing(docs, most)
            assert bins <= max(2, 1.15 * -(-total // most))
    assert packing.pack_documents(no_docs).count() == 0


def test_pieces_have_the_right_tokens(spark):
    text = "some words again " * 200
    rows = packing.pack_documents(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), 100).orderBy("piece").collect()
    ids = np.append(tokens.ids(text), np.uint32(2)).astype("<u4")
    assert [r.length for r in rows][1:] == [100] * (len(rows) - 1)
    assert all(r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in rows)


def test_two_documents_replace_the_smallest():
    bins = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)  # 6 + 3 leaves 1; 2 + 2 in place of 3 fit exactly
    assert ([6, 2, 2], 1) in bins
    for seed in range(5):
        rng = np.random.default_rng(seed)
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, 65, 30), rng.integers(1, 50, 30))}
        bins = packing.best_two_fit(counts, 64)
        got = {}
        for own, times in bins:
            assert sum(own) <= 64
            for n in own:
                got[n] = got.get(n, 0) + times
        assert got == counts


def test_placement_is_json_sized():
    where = packing.placement([([5, 3, 3], 2), ([3], 1)])
    assert json.loads(json.dumps({k: v.tolist() for k, v in where.items()})) == {
        "length": [3, 3, 5], "rank": [0, 4, 0], "each": [2, 1, 1], "sequence": [0, 2, 0], "offset": [5, 0, 0]}


def test_rows_without_an_id_are_documents_of_their_own(spark):
    """They come after the others, by a hash of their texts, and each keeps its own spans."""
    shared, other = "a passage of more than fifty bytes that two of the rows hold, ", "the second passage, which only rows without an id do hold here; "
    texts = [(1, shared + "x"), (None, "one " + shared), (None, "two " + other + "y"), (None, "three " + other), (None, "three " + other), (None, None), (None, "")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    keyed = [tuple(r) for r in docs.selectExpr("doc_id", f"coalesce(doc_id, shiftrightunsigned(xxhash64(coalesce(text, '')), 2) + {repeats.NO_ID})", "coalesce(text, '')").collect()]
    want = brute_repeats(sorted({r[1:] for r in keyed}), 50)
    order = lambda x: (x[0] or 0, x[1:])
    assert sorted(map(tuple, repeats.removals(docs).collect()), key=order) == sorted(((i, *want[k]) for i, k, _ in keyed), key=order)
    assert {r.text for r in repeats.trimmed(docs).collect() if r.doc_id == 1} == {shared + "x"}
