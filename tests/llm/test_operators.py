"""Operators over small tables: brute force, ties, nulls, empty tables, repeated rows, clashing names."""

import base64
import hashlib
import random
import re
import textwrap
from html.parser import HTMLParser

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wordloom.llm import blocks, bpe, caps, chat, licenses, minhash, packing, pages, pii, quality, queries, warc

from .test_pure import plain_shingles, plain_spans

DIR = "/root/testdata/sf0.001"


def components(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return [find(x) for x in range(n)]


def noisy(n=120):
    r = random.Random(1)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(n // 4):
        base = [r.choice(vocabulary) for _ in range(r.randrange(1, 160))]
        for _ in range(4):
            copy = list(base)
            for _ in range(r.randrange(0, 6)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(" ".join(copy))
    return [*texts, None, "", "  \n", "One two", "one  TWO", texts[0], texts[5].upper()]


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, words, percent):
    texts = noisy()
    rows = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, id string, n int")
    found = {r["doc_id"]: r for r in minhash.near_duplicates(rows, minhash.NearDuplicates(words, percent, block=7)).collect()}
    sets = [plain_shingles(t, words) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    assert len(found) == len(texts)
    for k, c in enumerate(components(len(texts), links)):
        assert (found[k]["n_shingles"], found[k]["component_id"], found[k]["kept"]) == (len(sets[k]), c, c == k)


def test_near_duplicates_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f")], "doc_id long, text string")
    found = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in minhash.near_duplicates(rows).collect())
    assert found == [(0, 0, True), (4, 4, True), (4, 4, True), (9, 4, False)]


def test_near_duplicates_at_the_threshold(spark):
    """20 one-word shingles in union: 17 shared are 85 percent, 16 are not; and texts of 200,000 words."""
    shared = [f"s{k}" for k in range(17)]
    rows = [(1, " ".join([*shared, "a", "b"])), (2, " ".join([*shared, "c"])), (3, " ".join([*shared[:16], "d", "e", "f", "g"]))]
    words = [f"x{k}" for k in range(200_000)]
    rows += [(4, " ".join(words)), (5, " ".join(words[5_000:])), (6, " ".join(words[:120_000]))]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, digest int, key int")
    for slack in (4.5, None):
        how = minhash.NearDuplicates(1, 85, slack=slack)
        found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, how).collect()}
        assert found == {1: (19, 1), 2: (18, 1), 3: (20, 3), 4: (200_000, 4), 5: (195_000, 4), 6: (120_000, 6)}


def test_near_duplicates_find_every_pair_at_the_threshold(spark):
    """400 unrelated pairs of 5-word sets at a similarity of 0.80 to 0.82."""
    r = random.Random(8)
    rows, n = [], 120
    for pair in range(400):
        base = [f"{pair}.{k}" for k in range(n + 4)]
        cut = r.randrange(10, 13)  # sets of n shingles, the last cut of them others: (n - cut) / (n + cut)
        rows += [(2 * pair, " ".join(base)), (2 * pair + 1, " ".join([*base[: n + 4 - cut], *(f"y{pair}.{k}" for k in range(cut))]))]
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {k: k - k % 2 for k in range(800)}


def test_near_duplicates_of_one_large_group(spark):
    """Copies, near copies and near copies that are no links, of one text, and many without words."""
    base = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(base)) for k in range(600)] + [(600 + k, " ".join([*base[:96], f"z{k}"])) for k in range(300)]
    rows += [(900 + k, " ".join([*base[:80], *(f"q{k}.{j}" for j in range(20))])) for k in range(200)] + [(1100 + k, " ") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, minhash.NearDuplicates(block=64)).collect()}
    assert found == {k: 0 if k < 900 else k for k in range(1150)}


def test_chat_reads_back(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "a[/INST]\\"), (1, 2, "user", None), (1, 3, "assistant", "</s>"), (2, 0, None, "x"), (None, 5, "assistant", "q"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b")]
    turns += [(4, 0, "a|>\nb", "hello"), (4, 1, "<|end|>\n", "<|turn user|>\n"), (4, 2, "assistant", "x" * 3_000_000), (5, 0, "\n", "")]
    turns += [(6, k, "assistant" if k % 2 else "user", f"t{k} ") for k in range(5000)]
    rendered = chat.formatted(spark.createDataFrame([(*t, 0, 0) for t in turns], "conv_id long, turn long, role string, text string, segment int, example int")).persist()
    examples = chat.examples(rendered)
    found = {r["conv_id"]: r for r in chat.read_back(rendered, examples).collect()}
    counts = {1: (4, 13, 2), 2: (1, 0, 0), None: (1, 1, 1), 3: (2, 2, 2), 4: (3, 3_000_000, 1), 5: (1, 0, 0), 6: (5000, sum(len(f"t{k} ") for k in range(1, 5000, 2)), 2500)}
    assert {k: (r["n_turns"], r["loss_chars"], r["n_examples"]) for k, r in found.items()} == counts
    for conv in counts:
        mine = [(role or "", text or "") for c, _, role, text in turns if c == conv]
        assert found[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        assert found[conv]["loss_sha256"] == hashlib.sha256("".join(t for r, t in mine if r == "assistant").encode()).hexdigest()
    few = rendered.where("conv_id < 4 or conv_id is null")
    whole = {(r["conv_id"], r["example"]): r for r in chat.expanded(few, chat.examples(few)).collect()}
    assert len(whole) == 5
    last = whole[1, 1]
    assert chat.unescape(last["text"][last["loss_start"] : last["loss_end"]]) == "</s>" and last["text"].startswith("<|turn user|>\nhi<|end|>\n")
    shifted = examples.withColumn("context_end", F.col("context_end") + 1)
    with pytest.raises(Exception, match="does not fit its rendering"):
        chat.read_back(rendered, shifted).collect()
    none = chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert chat.read_back(none, chat.examples(none)).count() == 0


def test_pii_and_masks(spark):
    rows = spark.createDataFrame([(1, "a@b.cd é 1.2.3.4", "q"), (None, None, "q"), (1, "", None)], "doc_id long, text string, spans string")
    found = pii.personal_data(rows).orderBy("n_email").collect()
    assert [r["spans"] for r in found] == ["", "", "email:0:6,ip:9:16"] and found[2]["n_ip"] == 1
    assert sorted(str(r["text"]) for r in pii.masked(rows).collect()) == ["", "None", "[EMAIL] é [IP]"]
    assert pii.personal_data(rows.limit(0)).count() == 0 and pii.masked(rows.limit(0)).count() == 0


def test_licenses(spark):
    line = licenses.TEMPLATES["mit-line"]
    texts = [(1, f"word {line} word"), (1, line), (2, "nothing here to see at all"), (None, None), (3, "x " * 500 + licenses.TEMPLATES["mit-grant"].replace("sublicense,", "rent,")), (4, "")]
    found = {(r["doc_id"], r["license"]) for r in licenses.license_scan(spark.createDataFrame([(*t, "z") for t in texts], "doc_id long, text string, license string"), spark).collect()}
    assert found == {(1, "mit-line"), (3, "mit-grant")}
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, text string"), spark).count() == 0


def wrapped(text, leader, width=70):
    return "\n".join(leader + line for line in textwrap.wrap(text, width))


def test_licenses_in_comments_and_families(spark):
    T, M = licenses.TEMPLATES, licenses.MORE
    texts = [
        wrapped(T["apache-2.0-notice"], "# "), wrapped(T["mit-grant"], "// "), "/*\n" + wrapped(T["gpl-3.0-notice"], " * ") + "\n */",
        "Released under the MIT License, see LICENSE", "(Licensed under CC BY-NC 4.0)", wrapped(M["gpl-2.0-notice"], "-- "), M["lgpl-2.1-notice"],
        T["agpl-3.0"], f"{T['agpl-3.0']} And: {T['gpl-3.0-notice']}", wrapped(M["mit-disclaimer"], ";; "), M["gpl-2.0-line"], T["gpl-3.0-line"], "#" * 100_000 + "a",
    ]
    expected = [
        {"apache-2.0-notice"}, {"mit-grant"}, {"gpl-3.0-notice"}, {"mit-line"}, {"cc-by-nc-4.0-line"}, {"gpl-2.0-notice"}, {"lgpl-2.1-notice"},
        {"agpl-3.0"}, {"agpl-3.0", "gpl-3.0-notice"}, {"mit-disclaimer"}, {"gpl-2.0-line"}, {"gpl-3.0-line"}, set(),
    ]
    more = licenses.TEMPLATES | licenses.MORE
    rows = list(enumerate([*texts, *more.values()]))
    found = [set() for _ in rows]
    for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), spark).collect():
        found[r["doc_id"]].add(r["license"])
    assert found[: len(texts)] == expected
    assert found[len(texts) :] == [{name} for name in more]


@pytest.mark.parametrize("dim", [3, 64])
def test_caps_equal_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    base = rng.standard_normal((60, dim))
    near = base + rng.standard_normal((60, dim)) * 0.38 * np.linalg.norm(base, axis=1, keepdims=True) / dim**0.5
    v = [*base.tolist(), *near.tolist(), base[0].tolist(), base[0].tolist(), (3 * base[1]).tolist()]
    labels = [k % 2 for k in range(60)] * 2 + [0, 0, 1]
    odd = [(None, 1), ([0.0] * dim, 1), ([float("nan")] * dim, 1), ([None] * dim, 1), (v[0], None), ([], 1), ([1.0], 1)]
    rows = [(k, x, l) for k, (x, l) in enumerate([*zip(v, labels), *odd])]
    found = {r["vec_id"]: r for r in caps.cap_duplicates(spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, id int"), caps.Caps(block=9)).collect()}
    unit = np.array(v) / np.linalg.norm(v, axis=1, keepdims=True)
    cos = unit @ unit.T
    links = [(a, b) for a in range(len(v)) for b in range(len(v)) if a != b and labels[a] == labels[b] and cos[a, b] >= 0.93]
    assert len(found) == len(rows)
    for k, c in enumerate(components(len(v), links)):
        assert (found[k]["component_id"], found[k]["n_links"]) == (c, sum(a == k for a, _ in links)), k
    assert all(found[k]["n_links"] == 0 and found[k]["kept"] for k in range(len(v), len(rows)))


def test_caps_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert caps.cap_duplicates(spark.createDataFrame([], schema)).count() == 0
    none = [(1, None, 1), (2, [1.0, 0.0], None)]
    assert sorted(tuple(r) for r in caps.cap_duplicates(spark.createDataFrame(none, schema)).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    rows = [(7, [1.0, 0.0], 1), (7, [1.0, 0.0], 1), (9, [2.0, 0.01], 1), (None, [1.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1e300, 0.0], 2), (5, [3e38] * 300, 2)]
    more = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, filter string, mark string")
    found = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in caps.cap_duplicates(more).collect())
    assert found == [("3", 1, "3", True), ("4", 1, "3", False), ("5", 0, "5", True), ("7", 2, "7", True), ("7", 2, "7", True), ("9", 2, "7", False), ("None", 0, "None", True)]


def test_caps_of_one_large_group(spark):
    """Chains and clumps over several blocks of a filter: links are counted once each."""
    turn = np.arange(700) * 0.002
    chain = np.stack([np.cos(turn), np.sin(turn)], axis=1)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(chain)]
    found = {r["vec_id"]: r for r in caps.cap_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), caps.Caps(block=64)).collect()}
    near = chain @ chain.T >= 0.93
    assert {k: (r["n_links"], r["component_id"]) for k, r in found.items()} == {k: (int(near[k].sum()) - 1, 0) for k in range(700)}


def test_warc_round_trip(spark, tmp_path):
    made = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u\r\nv%0A", None), (4, "http://d", ""), (5, "e", "é\r\n\r\nWARC/1.1\r\n"), (None, "f", "<p>x</p>"), (2, "again", "<p>x</p>")]
    table = spark.createDataFrame([(*m, 7) for m in made], "page_id long, url string, html string, payload int")
    index = warc.write_archives(table, str(tmp_path / "w"))
    records = warc.read_records(index).collect()
    assert sorted(str(r["url"]) for r in records) == sorted(str(m[1]) for m in made)
    kinds = {(r["page_id"], r["url"]): (r["record_type"], r["refers_to"]) for r in records}
    assert kinds[1, "http://a"] == ("revisit", 2) and kinds[2, None] == kinds[2, "again"] == ("response", None)
    assert kinds[3, "u\r\nv%0A"] == ("revisit", 4) and kinds[4, "http://d"] == ("response", None) and kinds[None, "f"] == ("revisit", 2)
    assert next(bytes(r["payload"]) for r in records if r["page_id"] == 5) == "é\r\n\r\nWARC/1.1\r\n".encode()
    sizes = {r["page_id"]: r["payload_bytes"] for r in warc.resolved(warc.read_records(index)).collect()}
    assert sizes == {1: 8, 2: 8, 3: 0, 4: 0, 5: 16, None: 8}
    many = spark.createDataFrame([(k, f"u{k}", "same" if k % 3 else "é" * (5 << 20)) for k in range(300) if k % 3 or k < 9], "page_id long, url string, html string")
    found = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.resolved(warc.read_records(warc.write_archives(many))).collect()}
    assert found == {k: (4, "revisit", 299) if k % 3 else (10 << 20, "revisit", 6) for k in found} | {299: (4, "response", None), 6: (10 << 20, "response", None)} and len(found) == 203
    one = warc.read_records(index.where("page_id = 5")).collect()
    assert len(one) == 1 and one[0]["page_id"] == 5
    assert warc.read_records(warc.write_archives(table.limit(0))).count() == 0


def test_quality_edges(spark):
    clean = " ".join(f"w{k}" for k in range(40))
    long = " ".join(f"w{k}" for k in range(300_000))
    rows = [(1, clean, "a"), (2, None, None), (None, "", "a"), (3, "x " * 50, "b"), (3, "a b c d e a b c d e", "b"), (4, "l m\nl m\n\n" + clean, "c"), (4, "l m\nl m\n\n" + clean, "c"), (5, long, "c")]
    names = "row int, m int, host int, _host int, _h int, _words int, _m int, share int, kept int, words int, `a.b` int"
    docs = spark.createDataFrame([(*r, *range(11)) for r in rows], "doc_id long, text string, source string, " + names)
    judged = quality.judged(docs)
    found = judged.select("row.doc_id", "m.*", "kept").collect()
    by = sorted((r["n_words"], r["n_repeat_words"], r["n_dup_lines"], r["kept"]) for r in found)
    assert by == [(0, 0, 0, False), (0, 0, 0, False), (10, 10, 0, False), (40, 0, 0, True), (44, 0, 1, True), (44, 0, 1, True), (50, 50, 0, False), (300_000, 0, 0, True)]
    assert judged.select("row.*").columns == docs.columns and sorted(map(str, judged.select("row.*").collect())) == sorted(map(str, docs.collect()))
    empty = quality.judged(spark.createDataFrame([], "doc_id long, text string, source string"))
    assert empty.count() == 0 and corpus_pipeline.good_quality(spark, docs.limit(0), DIR).columns == docs.columns


@pytest.mark.parametrize("limit", [quality.BROADCAST_BYTES, 0])
def test_quality_of_bad_hosts(spark, monkeypatch, limit):
    """Soft failures are rejected on the one host that fails far more often than its prior says, not elsewhere."""
    monkeypatch.setattr(quality, "BROADCAST_BYTES", limit)
    clean = " ".join(f"w{k}" for k in range(40))
    soft = clean + " " + "#" * 60
    rows = [(f"h{k}", clean) for k in range(12) for _ in range(9)] + [(f"h{k}", soft) for k in range(12)] + [(f"h{k}", "too few") for k in range(12)]
    rows += [("bad", "too few")] * 30 + [("bad", clean), ("bad", soft), ("tie", "too few"), ("tie", soft)]
    docs = spark.createDataFrame([(k, t, h) for k, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    found = quality.judged(docs).select("row.*", "failed", "bad_host", "kept").collect()
    assert {r["source"] for r in found if r["bad_host"]} == {"bad"}
    assert {(r["source"] == "bad", r["text"] == soft, r["kept"]) for r in found if not r["failed"]} == {(True, True, False), (True, False, True), (False, True, True), (False, False, True)}
    same = spark.createDataFrame([(k, soft, f"h{k % 3}") for k in range(9)], "doc_id long, text string, source string")
    assert not quality.judged(same).where("bad_host").count()


def check_packed(rows, texts):
    from tokenizers import Tokenizer

    import zlib

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for doc, text in texts.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        mine = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"])
        assert sum(r["length"] for r in mine) == len(ids) and {r["doc_tokens"] for r in mine} == {len(ids)}
        at = 0
        for r in mine:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return by


def test_packing_brute_force(spark):
    table = spark.read.parquet(f"{DIR}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    rows = queries.op8_packing(spark, DIR).collect()
    sequences = check_packed(rows, texts)
    assert len(sequences) <= 1.02 * sum(r["length"] for r in rows) / packing.CAPACITY + 2  # little padding
    repeated = spark.createDataFrame([(7, "a few words", 0)] * 40 + [(None, "others", 0)] * 3, "doc_id long, text string, sequence_id int")
    twice = packing.packed(repeated, P.path("word_bpe_49k.json")).collect()
    assert len(twice) == 43 and len({(r["sequence_id"], r["offset"]) for r in twice}) == 43
    odd = {1: None, 2: "", 3: "word " * 9000, 4: "a"}
    rows = spark.createDataFrame([(k, v, 0) for k, v in odd.items()], "doc_id long, text string, offset int")
    check_packed(packing.packed(rows, P.path("word_bpe_49k.json")).collect(), odd)
    assert packing.packed(rows.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_bpe_edges(spark):
    rows = spark.createDataFrame([(1, None, 1), (1, "é x", 1), (None, "", 1)], "doc_id long, text string, ids int")
    found = bpe.encoded(rows, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True).collect()
    assert sorted(r["n_tokens"] for r in found) == [0, 0, 2] and bpe.encoded(rows.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_pages_edges(spark):
    rows = spark.createDataFrame([(1, "u", None, "t"), (None, None, "<article><p>Some words of text here.</p></article>", "t")], "page_id long, url string, html string, text string")
    assert sorted((r["text"], r["n_chars"]) for r in pages.extracted(rows).collect()) == [("", 0), ("Some words of text here.", 24)]
    assert pages.extracted(rows.limit(0)).count() == 0


class Article(HTMLParser):
    """Text blocks of a page's article element, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.raw, self.done, self.parts, self.now = 0, 0, False, [], []

    def flush(self):
        text = " ".join("".join(self.now).split())
        self.now = []
        if text:
            self.parts.append(text)

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article" and not self.done
        self.raw += tag in blocks.RAW
        if tag == "br":
            self.now.append(" ")
        elif tag not in blocks.INLINE:
            self.flush()

    def handle_endtag(self, tag):
        self.raw = max(0, self.raw - (tag in blocks.RAW))
        if tag not in blocks.INLINE:
            self.flush()
        if tag == "article" and self.depth:
            self.depth -= 1
            self.done = not self.depth

    def handle_data(self, data):
        if self.depth and not self.raw:
            self.now.append(data)


def article(page):
    parser = Article()
    parser.feed(page)
    parser.close()
    parser.flush()
    return "\n\n".join(parser.parts)


def test_pages_equal_their_articles(spark):
    """The query over every page of two tables against a plain parser that looks for the article element."""
    for folder in (DIR, DIR.replace("0.001", "0.01")):
        html = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
        found = {r["page_id"]: (r["text"], r["n_chars"]) for r in queries.op10_html_extraction(spark, folder).collect()}
        assert found == {k: (t, len(t)) for k, t in ((k, article(h)) for k, h in html.items())}


def test_pages_without_an_article_element(spark):
    words = [" ".join(f"{x}ord{k % 7}" for k in range(60)) + "." for x in "wfc"]
    body = "".join(f"<p>{w}</p>" for w in words)
    chrome = '<nav><a href="/a">Home</a> <a href="/b">About</a></nav>', "<footer>&copy; 2024 All rights reserved.</footer>"
    rows = [(1, f"<body>{body}</body>"), (1, f"<body>{body}</body>"), (2, f"<body>{chrome[0]}{body}{chrome[1]}</body>"), (3, f"<div class=content>{'<p>a b c d e f g.</p>' * 3000}</div>")]
    found = pages.extracted(spark.createDataFrame([(*r, "u", 1, 2) for r in rows], "page_id long, html string, url string, n_chars int, block int")).collect()
    text = "\n\n".join(words)
    assert sorted((r["page_id"], r["text"]) for r in found if r["page_id"] < 3) == [(1, text), (1, text), (2, text)]
    assert next(r["n_chars"] for r in found if r["page_id"] == 3) == 3000 * 16 - 2


def test_bpe_query_by_brute_force(spark):
    """Counts, digests and decoded bytes of every document, and of one long text, by the library alone."""
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    whole = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    odd = {1: None, 2: "word  \n" * 40_000, 3: "x" * 50_000, 4: "\t " * 9_000 + "é"}
    rows = spark.createDataFrame([(k, t, 0, "z") for k, t in odd.items()], "doc_id long, text string, n_tokens int, ids string")
    for given, df in ((texts, queries.op9_byte_bpe(spark, DIR)), (odd, bpe.encoded(rows, P.path("byte_bpe_50k.tiktoken"), P.PATTERN))):
        found = {r["doc_id"]: r for r in df.collect()}
        assert found.keys() == given.keys()
        for k, t in given.items():
            ids = whole.encode_ordinary(t or "")
            expected = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()
            assert (found[k]["n_tokens"], found[k]["ids_sha256"], found[k]["decoded_sha256"]) == expected, k


def plain_added(text):
    """IBANs and social security numbers, by trying every start and length."""
    out, at = [], 0
    while at < len(text):
        size = None
        if re.match(r"[A-Z]{2}[0-9]{2}", text[at : at + 4]) and not (at and text[at - 1].isalnum()):
            for end in range(at + 15, min(len(text), at + 44) + 1):
                bare = text[at:end].replace(" ", "")
                if re.fullmatch(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", text[at:end]) and len(bare) == pii._IBAN_CHARS.get(bare[:2]) and not text[end : end + 1].isalnum():
                    if int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1:
                        size = end - at
        if size:
            out.append(("iban", at, at + size))
        at += size or 1
    return out


def test_pii_query_by_brute_force(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    added = {10**6: "IBAN BE68 5390 0754 7034 BIC GEBABEBB", 10**6 + 1: "my ssn 123-45-6789" + " word" * 20 + " assn 219-09-9999", 10**6 + 2: "a@b.cd " * 30_000 + "1.2.3.4"}
    rows = spark.createDataFrame([(k, t, 0) for k, t in (texts | added).items()], "doc_id long, text string, spans int")
    found = {r["doc_id"]: r for r in pii.personal_data(rows).collect()}
    for k, t in (texts | added).items():
        base = [(pii.BASE[rank], s, e) for s, rank, e in plain_spans(t)]
        assert found[k]["base_sha256"] == hashlib.sha256(",".join(f"{kind}:{s}:{e}" for kind, s, e in base).encode()).hexdigest()
        assert [found[k][f"n_{kind}"] for kind in pii.BASE] == [sum(b[0] == kind for b in base) for kind in pii.BASE]
        spans = [tuple(s.split(":")) for s in found[k]["spans"].split(",") if s]
        assert [(kind, int(s), int(e)) for kind, s, e in spans if kind == "iban"] == plain_added(t), k
        assert [s for s in spans if s[0] in pii.BASE] == [(kind, str(s), str(e)) for kind, s, e in base] and len(found[k]["scores"].split(",")) == max(1, len(spans))
    assert found[10**6 + 1]["spans"] == "ssn:7:18" and found[10**6 + 2]["n_email"] == 30_000 and found[10**6 + 2]["n_ip"] == 1


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    expected = con.execute(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(columns).collect()))) == sorted(map(str, expected))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = corpus_pipeline.good_quality(spark, docs, DIR)
    assert kept.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    one = corpus_pipeline.no_near_duplicates(spark, kept, DIR)
    ids = sorted(texts)
    sets = [plain_shingles(texts[k], 5) for k in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = sorted(ids[k] for k, c in enumerate(components(len(ids), links)) if k == c)
    assert sorted(r["doc_id"] for r in one.collect()) == expected and one.columns == docs.columns
    masked = {r["doc_id"]: r for r in corpus_pipeline.no_personal_data(spark, one, DIR).collect()}
    for k in expected:
        assert masked[k]["text"] == pii.mask(texts[k], pii.find_spans(texts[k])) and masked[k]["n_chars"] == len(masked[k]["text"])
    check_packed(corpus_pipeline.run(spark, DIR).collect(), {k: r["text"] for k, r in masked.items()})


def test_pipeline_null_and_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(None, a), (None, a), (7, a), (1, b), (3, b), (3, c), (None, c + " end"), (None, d), (None, d), (5, "x y"), (5, "x y"), (6, None), (6, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_chars long")
    one = corpus_pipeline.no_near_duplicates(spark, docs, DIR)
    found = sorted((str(r["doc_id"]), str(r["text"])) for r in one.collect())
    assert found == sorted([("7", a), ("1", b), ("3", c), ("None", d), ("5", "x y"), ("6", "None")]) and one.columns == docs.columns
    assert corpus_pipeline.no_near_duplicates(spark, docs.limit(0), DIR).count() == 0


CLASHING = "row struct<m:int>, m int, key long, id string, host string, bad_host boolean, kept boolean, place int, again boolean, digest binary, words array<string>, offset int"


def odd_documents(spark):
    """Nulls in every column, repeated rows and ids, empty and long texts, and columns named as the operators' own."""
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    long = " ".join(f"l{k}" for k in range(60_000))
    rows = [(1, a, "en", "s", 9), (1, a, "en", "s", 9), (2, a + " end", None, None, None), (None, b, None, None, None), (None, b, "en", "s", 1), (3, None, "de", "t", 5), (4, "", "de", "t", 0)]
    rows += [(5, long, "en", "u", 1), (6, long + " tail", "en", "u", 1), (7, a + " mail me@x.org now", "en", "s", 3), (2, b + " else", "en", "s", 4)]
    return spark.createDataFrame([(*r, (4,), *[None] * 11) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"), (a, b, long)


def test_pipeline_stages_on_odd_rows(spark):
    docs, (a, b, long) = odd_documents(spark)
    kept = corpus_pipeline.good_quality(spark, docs, DIR)
    assert kept.schema == docs.schema and kept.count() == 9 and not kept.where("text is null or text = ''").count()
    assert {r["row"]["m"] for r in kept.collect()} == {4}
    one = corpus_pipeline.no_near_duplicates(spark, docs, DIR)
    found = sorted((str(r["doc_id"]), (r["text"] or "")[:3], r["n_chars"]) for r in one.collect())
    assert one.columns == docs.columns
    assert [f[:2] for f in found] == [("3", ""), ("4", ""), ("5", "l0 "), ("7", "a0 "), ("None", "b0 ")]  # null and repeated ids come after others, by place
    masked = corpus_pipeline.no_personal_data(spark, docs, DIR)
    rows = masked.collect()
    assert masked.schema == docs.schema and len(rows) == docs.count()
    assert {(r["text"], r["n_chars"]) for r in rows if r["doc_id"] in (3, 7)} == {(None, 5), (a + " mail [EMAIL] now", len(a) + 17)}
    pieces = corpus_pipeline.packed(spark, docs, DIR).collect()
    totals = {}
    for r in pieces:
        totals[r["doc_id"]] = totals.get(r["doc_id"], 0) + r["length"]
    assert set(totals) == {None, 1, 2, 3, 4, 5, 6, 7} and totals[3] == totals[4] == 1 and totals[5] > 60_000
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DIR).count() == 0


def test_pipeline_by_brute_force(spark, tmp_path):
    """All stages in a row over a table with every kind of row: what stays is what plain rules keep."""
    words = [" ".join(f"{x}{k}" for k in range(50)) for x in "cdefgh"]
    rows = [(10 * k + j, w + f" v{j}", "en", f"s{k}", 0) for k, w in enumerate(words) for j in range(3)]
    rows += [(900, "too few", "en", "s0", 0), (901, "a b c " * 40, "en", "s1", 0), (902, None, "en", "s2", 0), (903, words[0][:-4] + " call +49 30 1234567 now x y z", "en", "s2", 0)]
    (tmp_path / "t").mkdir()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/t/documents.parquet")
    good = {k: t for k, t, *_ in rows if t and len(t.split()) >= 10 and k != 901}
    ids, sets = sorted(good), {k: plain_shingles(t, 5) for k, t in good.items()}
    links = [(i, j) for i in range(len(ids)) for j in range(i) if 100 * len(sets[ids[i]] & sets[ids[j]]) >= 80 * len(sets[ids[i]] | sets[ids[j]])]
    stay = {ids[k]: good[ids[k]] for k, c in enumerate(components(len(ids), links)) if k == c}
    assert 900 not in stay and 901 not in stay and 902 not in stay and len(stay) < len(good)
    check_packed(corpus_pipeline.run(spark, f"{tmp_path}/t").collect(), {k: pii.mask(t, pii.find_spans(t)) for k, t in stay.items()})
