"""Alignment of two tokenizers against both libraries run on whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest

from terrane.llm import tables, token_alignment
from terrane.llm.token_counts import byte_letters

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def plain(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_letters()
    a.encode_special_tokens = True
    bytes_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    seen, links = [], Counter()
    for _, text in rows:
        groups, want = [], b" " + (text or "").encode()
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if b"".join(map(bytes_a, ids_a)) == want == b"".join(map(bytes_b, ids_b)):
            left, size, at, own = list(ids_b), 0, 0, ([], [])
            for i in ids_a:
                own[0].append(i)
                at += len(bytes_a(i))
                while left and size + len(bytes_b(left[0])) <= at:
                    size += len(bytes_b(left[0]))
                    own[1].append(left.pop(0))
                if size == at:
                    groups.append(own)
                    own = ([], [])
            assert own == ([], [])
        seen.append(groups)
        links.update((g[0][-1], g[1][-1]) for g in groups)
    most = defaultdict(int)
    for (_, y), n in links.items():
        most[y] = max(most[y], n)
    out = []
    for (doc_id, _), groups in zip(rows, seen):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        own = [links[x[-1], y[-1]] for x, y in groups]
        best = sum(n == most[y[-1]] for n, (_, y) in zip(own, groups))
        out.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(groups), best, sum(own), hashlib.sha256(text.encode()).hexdigest() if text else "", text))
    return sorted(out, key=repr)


def odd_texts():
    rng = random.Random(7)
    parts = ["a", "the", "and", "é", "日本", "語", "1", "2024", " ", "  ", "\n", "\t", "\r", "\r\n", ");\r", ".\r", "'s", "'", "!", "...", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "<unk>", "　", "\xa0", " ", "\x85", "\x1c", "\x0b", "\x0c", "ß", "hello", " world", "\x00", "�", "🙂", "é", "͸", "​", "**/", "ing"]
    texts = [None, "", " ", "  ", "\n", "x", " x", "x ", "x  ", "\r\n", "a▁b", "▁", "tail   \n", "don't 's ''ll", "no▁tokens the the the"]
    return texts + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(400)]


@pytest.mark.parametrize(("chunk", "hot"), [(token_alignment.CHUNK, 1000), (50, 1000), (300, 3)])
def test_align(spark, monkeypatch, chunk, hot):
    monkeypatch.setattr(tables, "HOT_PARTS", hot)
    rows = list(enumerate(odd_texts()))
    rows += [rows[20], rows[21], rows[21], (None, "the same the"), (None, "the other the"), (None, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, segment string, chunk int").repartition(3)
    got = token_alignment.align(docs, A, B, chunk=chunk)
    assert got.columns == "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256 groups".split()
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_empty(spark):
    assert token_alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    (row,) = token_alignment.align(spark.createDataFrame([(1, None)], "doc_id long, text string"), A, B, keep_groups=False).collect()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "")


def test_cuts_are_proven():
    both = token_alignment.pair(A, B)
    assert all(both.cut[ord(c)] for c in " \n\t\x85\xa0　") and not both.cut[ord("\r")] and not both.cut[ord("a")]
    with pytest.raises(ValueError):
        token_alignment.pair(P.path("word_bpe_49k.json"), B)


def test_query_over_its_whole_table(spark):
    from terrane.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = queries.op11_token_alignment(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=repr) == sorted((r[:-1] for r in plain([(r.doc_id, r.text) for r in docs])), key=repr)


def test_long_text(spark):
    text = "\n".join(["one long line of words " * 40, "日本語" * 30_000, "x" * 100_000]) * 4
    (row,) = token_alignment.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), A, B).collect()
    assert [tuple(row)] == plain([(1, text)])
