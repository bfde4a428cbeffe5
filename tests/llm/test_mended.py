"""Repeated and missing keys in near-duplicate classes, and special tokens in other cases of letters."""

import hashlib
import os
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from sextant.llm import bpe, near_dup, token_files
from sextant.llm.queries import QUERIES, _vocabulary

A = "the quick brown fox jumps over the lazy dog near the old river bank today"
B = "completely other words stand in this second text and none of them is shared with it"


def test_a_key_with_two_texts_is_two_members(spark):
    rows = [(1, A, "w"), (1, B, "x"), (2, B, "y"), (3, A, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, print string")
    assert sorted((r.id, r.class_id) for r in near_dup.classes(df).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1)]
    assert sorted(map(tuple, near_dup.keep_one(df).collect())) == [(1, B, "x"), (1, A, "w")]


def test_missing_keys_and_repeated_rows(spark):
    rows = [(None, A, "b"), (None, A, "a"), (None, B, "c"), (7, B + "!", "d"), (7, B + "!", "e"), (8, None, "f"), (8, None, "g"), (9, "", "h")]
    rows += [(None, "", "i"), (5, "*** --- ***", "j"), (6, "*** --- ***", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, note string")
    kept = sorted(r.note for r in near_dup.keep_one(df).collect())
    assert kept == ["a", "d", "f", "g", "h", "i", "j"]
    named = sorted(((r.id, r.class_id) for r in near_dup.classes(df).collect()), key=repr)
    assert named == sorted(
        [(None, None)] * 2 + [(None, 7), (7, 7), (7, 7), (8, 8), (8, 8), (9, 9), (None, None), (5, 5), (6, 5)], key=repr
    )


def test_near_copies_under_one_key(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    other = [rng.choice(words) for _ in range(120)]
    rows = [(1, " ".join(base)), (1, " ".join(other)), (2, " ".join([*base[:60], "new", *base[61:]])), (3, " ".join([*other, "end"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_dup.keep_one(df).collect())) == sorted(rows[:2])


@pytest.mark.parametrize("text", ["<|ENDOFTEXT|>", "a <|EndOfText|> b", "x<|endoftext|>y <|startoftext|>", "<|endoftext|><|ENDOFTEXT|>", " <|", ""])
def test_special_tokens(text):
    path = _vocabulary("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        own = bpe.WordBpe(f.read())
    library = Tokenizer.from_file(path)
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode([text]) == [ids]
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_codec_query_equals_the_library(spark, sf):
    path = _vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation(), library.no_padding()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op2_bpe_codec"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_flat_encoder_equals_the_library(monkeypatch):
    path = _vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation(), library.no_padding()
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    rng = random.Random(8)
    parts = ["a", "Word", " ", "  ", "\n", "\t", ".", ",", "é", "日本", "\xa0", "\x1c", "\x00", "'s", "42", "<|endoftext|>", "👩", "x" * 17, "\r\n", " the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + ["word " * 3000, "y" * 100_000]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for seen, slots in ((1_000_000, 1 << 21), (300, 1 << 4)):
        monkeypatch.setattr(token_files, "SEEN", seen)
        monkeypatch.setattr(token_files, "SLOTS", slots)
        monkeypatch.setattr(token_files, "_SLOT", np.uint64(slots - 1))
        encoder = token_files.FlatEncoder(definition)
        for _ in range(2):
            got = [x for k in range(0, len(texts), 600) for x in encoder.encode(texts[k : k + 600])]
            assert [np.frombuffer(x, encoder.kind).tolist() for x in got] == expected


def test_a_word_is_asked_once_whatever_stands_beside_it():
    path = _vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation(), library.no_padding()
    with open(path, encoding="utf-8") as f:
        encoder = token_files.FlatEncoder(f.read())
    words = [f"{x}{y}" for x in map(chr, range(0xC0, 0x100)) for y in "a\u00e9z\u00dfQ" if x not in "\u00d7\u00f7"]
    beside = [" {}", " {},", " {}.\n", "\n\n {}", "\t {}"], ["{}", "{}\n", "\n{}", "\n \t{}.", "\r\n\n{},"]
    texts = [form.format(w) for w in words for side in beside for form in side]
    texts += ["\u00d7. \u00f7, ", "a\u00d7. a\u00f7, x.y, 1. ., .", " <|endoftext|>  <|endoftext|>\n\n<|endoftext|>a. "]
    for t, x in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(x, encoder.kind).tolist() == library.encode(t, add_special_tokens=False).ids, t
    # Each word with and without a blank, and a few signs: forms that only differ in what is beside are no new pieces.
    assert encoder.entries < 2 * len(words) + 30


def test_the_next_task_of_a_worker_goes_on_with_its_encoder(spark, monkeypatch, tmp_path):
    log, made = str(tmp_path / "made"), token_files.FlatEncoder.__init__

    def noted(self, definition):
        made(self, definition)
        with open(log, "a") as f:
            print(os.getpid(), file=f)

    monkeypatch.setattr(token_files.FlatEncoder, "__init__", noted)
    docs = spark.range(400).selectExpr("id as doc_id", "concat('word', id, ' and another.') as text").repartition(40)
    assert token_files.round_trip(docs, _vocabulary("byte_bpe_50k.json")).count() == 400
    with open(log) as f:
        processes = f.read().split()
    assert len(processes) == len(set(processes)) < 40


def test_ids_are_packed_as_one_after_the_other_would_be():
    rng = np.random.default_rng(5)
    for top, block in ((1, 4096), (3, 100), (50_000, 239), (1 << 62, 7), (40, 4096)):
        ids = rng.integers(0, top, 9000, dtype=np.uint64)
        ids[rng.random(9000) < 0.7] = 0
        chosen, at = [], 0
        while at < len(ids):
            stop = min(len(ids), at - at % block + block)
            runs = [(int(n), 1 << int(w)) for n, w in zip(token_files.COUNTS[:15], token_files.WIDTHS)]
            chosen.append(next((s for s, (n, end) in enumerate(runs) if at + n <= stop and (ids[at : at + n] < end).all()), 15))
            at += int(token_files.COUNTS[chosen[-1]])
        for x in [ids, ids.astype(np.uint16)] if top < 1 << 16 else [ids]:
            words, _ = token_files.encode_blocks(x, block)
            heads = words >> np.uint64(60)
            if top < 1 << 60:
                assert heads.tolist() == chosen
            assert (token_files.decode_blocks(words) == ids).all()


def test_documents_are_read_from_their_blocks():
    rng = np.random.default_rng(3)
    lengths = np.array([1, 5000, 0, 12, 9000, 1, 4096, 300])
    ids = rng.integers(0, 50_000, int(lengths.sum())).astype(np.uint64)
    image = token_files.file_image([*range(7), None], lengths, ids)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    for first in range(9):
        for stop in range(first, 9):
            found = token_files.read_documents(image, first, stop)
            assert [x.tolist() for x in found] == [ids[bounds[k] : bounds[k + 1]].tolist() for k in range(first, stop)]
