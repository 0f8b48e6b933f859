"""Byte-pair encoding, packing, quality grades and WARC derivatives."""

import base64
import gzip
import hashlib
import html
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gaugework.llm.bpe import decode_ids, encode_documents
from gaugework.llm.ordinal_quality import Featurizer, fit, graded, quality_scores, score, tails
from gaugework.llm.packing import CAPACITIES, default_cost, pack, pack_documents
from gaugework.llm.warc import derivatives, parse_html, responses, write_warc

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
HARD = [
    (-1, "a <|endoftext|>  b<|endoftext|><|endoftext|>\n\n c"), (-2, None), (-3, ""), (-4, "  \t x   y 's it's 12١ 𐐷 \U0001e4d0\U0001e4d1 z͸ \U0002ebf0q"),
    (-5, "<|endoftext|>"), (-5, "<|endoftext|>"), (None, "null id  "), (-6, "\u0085 x  y﻿"), (-7, "word " * 30_000),
]


@pytest.mark.parametrize("head_words", [0, 500])
def test_encoding_is_that_of_the_library(spark, documents, head_words):
    frame = documents.select("doc_id", "text").union(spark.createDataFrame(HARD, "doc_id long, text string")).withColumn("words", F.lit("clash"))
    tokenizer, wanted = Tokenizer.from_file(VOCABULARY), Counter()
    for row in frame.collect():
        ids = tokenizer.encode(row["text"] or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        wanted[row["doc_id"], tuple(ids), decoded, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    found = encode_documents(frame, VOCABULARY, head_words)
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"], r["ids_sha256"], r["decoded_sha256"]) for r in found.collect()) == wanted


def test_decoding_alone_and_no_rows(spark):
    frame = spark.createDataFrame([(1, [50256, 15496]), (2, None)], "doc_id long, ids array<int>")
    assert sorted(tuple(r) for r in decode_ids(frame, VOCABULARY).collect()) == [(1, "<|endoftext|>Hello"), (2, "")]
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).collect() == []


def test_packing_fits_and_is_never_worse_than_one_size():
    rng = np.random.default_rng(5)
    for lengths in (rng.integers(1, 8193, 400), rng.integers(1, 300, 400), np.array([8192]), np.array([], np.int64), np.full(50, 513)):
        bins, offsets, capacity = pack(lengths)
        cost = 0.0
        for number in np.unique(bins):
            own = np.nonzero(bins == number)[0]
            ends = sorted((offsets[i], offsets[i] + lengths[i]) for i in own)
            assert all(a[1] == b[0] for a, b in zip(ends, ends[1:])) and ends[0][0] == 0
            assert capacity[own[0]] == min(c for c in CAPACITIES if c >= ends[-1][1])
            cost += default_cost(int(capacity[own[0]]))
        one_size, _, size = pack(lengths, (8192,))
        assert cost <= sum(default_cost(8192) for _ in np.unique(one_size))
        assert cost >= default_cost(1) * lengths.sum()


def test_packing_finds_the_joint_optimum_of_a_small_case():
    # Two bins of 4 cost less than one of 10 and hold all.
    _, _, capacity = pack(np.array([2, 2, 2, 2]), (4, 10), lambda c: {4: 4.0, 10: 9.0}[c])
    assert set(capacity) == {4}
    _, _, capacity = pack(np.array([6, 4]), (4, 6, 10), lambda c: {4: 4.0, 6: 7.0, 10: 9.0}[c])
    assert set(capacity) == {10}


def test_packed_documents(spark, documents):
    rows = [(-1, None), (-2, " \n "), (-3, "w " * 20_000), (-3, "w " * 20_000), (None, "one two")]
    frame = documents.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("piece", F.lit("clash"))
    found = pack_documents(frame, group_rows=50).collect()
    want = Counter()
    for row in frame.collect():
        want[row["doc_id"]] += len((row["text"] or "").split())
    got = Counter()
    for row in found:
        got[row["doc_id"]] += row["length"]
    assert got == want
    used = Counter()
    for row in found:
        if row["length"]:
            used[row["bin_id"], row["capacity"]] += row["length"]
        else:
            assert row["bin_id"] is None
    assert all(total <= capacity for (_, capacity), total in used.items()) and len({b for b, _ in used}) == len(used)
    with pytest.raises(ValueError):
        pack_documents(frame, capacities=())
    assert pack_documents(frame.limit(0)).collect() == []


def test_features_of_odd_texts():
    make = Featurizer()
    for text in (None, "", " \n"):
        assert [len(a) for a in make(text)] == [0, 0]
    indices, values = make("A!! a!! b  b " + "x" * 100_000)
    assert len(set(indices.tolist())) == len(indices) == len(values)


def test_grades_are_learned(spark):
    """Held-out accuracy on texts of three kinds, and scores against a plain computation."""
    rng = np.random.default_rng(6)
    words = [f"word{n}" for n in range(200)]
    rows = []
    for n in range(450):
        tokens = rng.choice(words, 30).tolist()
        kind = n % 3
        if kind == 0:
            tokens = [t.upper() + "!!" for t in tokens]
        elif kind == 1:
            tokens[int(rng.integers(30))] = "rotten"
        rows.append((n, " ".join(tokens), kind))
    frame = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = fit(frame.where("doc_id < 300"), 3)
    assert (np.diff(model.thresholds) > 0).all()
    scored = score(frame.withColumn("selected", F.lit("clash")), model).collect()
    held = [r for r in scored if r["doc_id"] >= 300]
    assert sum(r["selected"] == (r["grade"] == 2) for r in held) >= 0.97 * len(held)
    make, weights = Featurizer(), model.dense()
    for r in held[:20]:
        indices, values = make(r["text"])
        above = tails(np.array([float(weights[indices] @ values)]), model.thresholds)[0]
        assert abs(r["expected_grade"] - above.sum()) < 1e-6 and abs(r["top_probability"] - above[-1]) < 1e-6


def test_labels_with_gaps(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 1), (3, 1, None), (4, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted(tuple(r) for r in graded(labels).collect()) == [(1, 0), (2, 1), (3, 2)]
    docs = spark.createDataFrame([(9, None), (9, "text"), (None, "")], "doc_id long, text string")
    assert [r["selected"] for r in quality_scores(docs, labels).collect()] == [True] * 3
    assert quality_scores(docs.limit(0), labels).collect() == []


class _Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")

    def handle_data(self, data):
        self.out += [] if self.hidden else data.split()


def _digest(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_derivatives_of_the_whole_table(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r["record_id"]: r for r in responses(pages).collect()}
    found = derivatives(responses(pages))
    records = found.collect()
    assert Counter(r["record_type"] for r in records) == {"metadata": len(source), "conversion": len(source)}
    assert len({r["record_id"] for r in records} | set(source)) == 3 * len(source)
    for r in records:
        origin = source[r["refers_to"]]
        block = r["block"].encode()
        assert (r["content_length"], r["block_digest"]) == (len(block), _digest(block))
        assert f"WARC-Refers-To: {r['refers_to']}\r\n" in r["header"] and f"Content-Length: {len(block)}\r\n" in r["header"]
        body = origin["block"].partition(b"\r\n\r\n")[2]
        if r["record_type"] == "conversion":
            plain = _Plain()
            plain.feed(body.decode())
            assert "".join(r["block"].split()) == "".join(plain.out)
        else:
            assert r["payload_digest"] == origin["payload_digest"] == _digest(body)
            assert "source-header-content-type: text/html; charset=utf-8\r\n" in r["block"]
    write_warc(found, str(tmp_path / "out"))
    written = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "out").glob("part-*"))
    at = count = 0
    while at < len(written):
        head, _, _ = written[at:].partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        at += len(head) + 4 + int(head.rpartition(b"Content-Length: ")[2])
        assert written[at : at + 4] == b"\r\n\r\n"
        at, count = at + 4, count + 1
    assert count == len(records)


def test_hard_pages(spark):
    assert parse_html("a<b>c</b>&amp;<!-- x --> 1 < 2 <script>if (a<b) {}</script><p>end")[0] == "ac& 1 < 2\nend"
    assert parse_html("<title>T &lt;</title><a href='/x?a&amp;b'>l</a><script>never closed <p>")[1:] == ("T <", ["/x?a&b"])
    assert parse_html("<" * 5000)[0] == "<" * 5000 and parse_html("<!--" + "x" * 9) == ("", "", [])
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, "v\r\nWARC-Type: x", "<p>é" + html.escape("<") * 40_000)]
    found = derivatives(responses(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert len(found) == 8 and all("\r\nWARC-Type: x" not in r["header"] for r in found)
    raw = spark.createDataFrame([(1, "<urn:uuid:1>", None, None, None, None), (2, "<urn:uuid:2>", "u", "d", bytearray(b"\xff<p>no head"), None)],
                                "page_id long, record_id string, target_uri string, date string, block binary, payload_digest string")
    assert [r["block"] for r in derivatives(raw).orderBy("page_id", "record_type").collect() if r["record_type"] == "conversion"] == ["", "�\nno head"]
    assert derivatives(raw.limit(0)).collect() == []
