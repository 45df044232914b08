"""One text of megabytes, with a copied passage, through the operators that read whole texts."""

import hashlib
import random

import public_tokenizers as P
import pytest

from terrane.llm import byte_bpe, exact_dedup, jaccard_join, packing, secret_scan, substring_dedup, suffix_dedup, transport_stream


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(3, 9)))
    shared, body = " ".join(word() for _ in range(300)), [" ".join(word() for _ in range(200_000)) for _ in range(4)]
    text = f" {shared} ".join(body) + ' secret = "abc123def456"'
    return text, shared, spark.createDataFrame([(1, text, "s"), (2, shared, "t"), (3, "short", "t")], "doc_id long, text string, source string")


def test_digests(docs):
    text, _, table = docs
    assert len(text) > 5_000_000
    got = {r.doc_id: r for r in byte_bpe.digests(table, P.path("byte_bpe_multi_50k.tiktoken")).collect()}
    assert got[1].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    data = text.encode()
    got = {r.doc_id: r for r in transport_stream.media_features(table).collect()}
    assert got[1].payload_sha256 == hashlib.sha256(data.ljust(-(-len(data) // 192) * 192, b" ")).hexdigest() and got[1].cc_errors == 0
    assert {r.doc_id: r.n_assign for r in secret_scan.scan(table).collect()} == {1: 1, 2: 0, 3: 0}
    assert {r.doc_id: r.kept for r in exact_dedup.mark(table).collect()} == {1: True, 2: True, 3: True}
    pieces = packing.pack(table, P.path("byte_bpe_50k.json")).where("doc_id = 1").orderBy("start").collect()
    assert pieces[-1].start + pieces[-1].length == pieces[0].doc_tokens == sum(p.length for p in pieces)


def test_repeats(docs):
    text, shared, table = docs
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(table, 35).collect()}
    assert got[1].kept_text == " ".join(w for part in text.split(f" {shared} ") for w in part.split()) and got[2].n_removed == 300
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(table, 200).collect()}
    # the blank on either side of the passage is repeated where it stands in the long text
    assert got[2].kept_text == "" and abs(got[1].n_removed - 3 * len(f" {shared} ".encode())) <= 12 and got[1].n_spans == 3
    got = {r.doc_id: r for r in jaccard_join.similar_components(table, 3, 90).collect()}
    assert got[1].component_id == 1 and got[1].n_shingles > 700_000
