"""Token counts, streaming BPE and packing against the library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stubble.llm import bpe, bpe_stream, packing, token_counts
from tests.llm import fixtures
from tests.llm.fixtures import documents, empty, rows

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def library(path):
    return Tokenizer.from_file(path)


def ids_of(lib, text):
    return lib.encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library(spark):
    lib = library(WORDS)
    clash = documents(spark).withColumn("n_tokens", F.lit("clash"))
    got = token_counts.with_token_counts(clash, WORDS).collect()
    assert len(got) == len(rows()) and "text" not in got[0].asDict()
    texts = {r[0]: r[1] for r in rows()}
    for r in got:
        assert r["n_tokens"] == len(ids_of(lib, texts[r["doc_id"]]))
        assert r["n_words"] == "clash"


def test_streamed_ids_and_text_equal_the_library(spark):
    lib = library(WORDS)
    texts = {r[0]: r[1] for r in rows()}
    clash = documents(spark).select("doc_id", "text", F.lit("clash").alias("ids_sha256"))
    for r in bpe_stream.with_digests(clash, WORDS).collect():
        ids = ids_of(lib, texts[r["doc_id"]])
        data = np.array(ids, dtype="<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(data).hexdigest())
        text = lib.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_windows_of_the_lookahead_change_nothing(path):
    rng = random.Random(1)
    model = bpe.load(path)
    pieces = ["".join(rng.choice("abeinotrsth") for _ in range(rng.randint(1, 4000))).encode() for _ in range(20)]
    pieces += [b"a" * 3000, b"th" * 1500, b"aaaab" * 700, b"ing" * 900, b"x"]
    whole, counts = bpe.merge(model, *model.symbols(pieces))
    ahead = bpe_stream.sufficient_lookahead(path)
    flat, sizes = bpe_stream.encode_pieces(model, pieces, ahead, 0)
    assert flat.tolist() == whole.tolist() and sizes.tolist() == counts.tolist()


def test_decoding_is_incremental():
    lib, model = library(BYTES), bpe.load(BYTES)
    for r in rows():
        ids = ids_of(lib, r[1])
        assert bpe_stream.decode(model, ids) == lib.decode(ids, skip_special_tokens=False)
    machine = bpe_stream.Decoder(model)
    parts = [machine.feed(i) for i in ids_of(lib, "日本語 😀")]
    assert "" in parts and "".join(parts) == "日本語 😀"  # bytes of a character wait


def test_word_ids_equal_the_library():
    lib, coder = library(BYTES), packing.WordIds(BYTES)
    texts = [r[1] or "" for r in rows()]
    for text, ids in zip(texts, coder.encode(texts)):
        assert ids.tolist() == ids_of(lib, text)


def test_a_word_of_many_texts_is_looked_up_once():
    lib, coder = library(BYTES), packing.WordIds(BYTES)
    coder.known = fixtures.CountedLooks()
    texts = ["again and again and\nagain", "", "\n", " two  blanks", "zero\0 again", "<|endoftext|> again"] * 50
    assert [i.tolist() for i in coder.encode(texts)] == [ids_of(lib, t) for t in texts]
    assert coder.known.looks < len(texts)


def test_word_ids_forget_what_is_beyond_the_bound(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 200, raising=False)
    lib, coder = library(BYTES), packing.WordIds(BYTES)
    for k in range(8):
        texts = [f"the same words and w{k}x{i} z{i * k}q\n and  blanks" for i in range(60)]
        assert [x.tolist() for x in coder.encode(texts)] == [ids_of(lib, t) for t in texts]
        assert len(coder.known) <= 200


def test_word_ids_load_the_library_for_special_strings_only():
    lib, coder = library(BYTES), packing.WordIds(BYTES)
    coder.encode(["plain words", "", "two  blanks\n"])
    assert "library" not in vars(coder)
    text = f"a {coder.special[0]} b"
    assert coder.encode([text])[0].tolist() == ids_of(lib, text)
    assert "library" in vars(coder)


def test_arrow_memory_is_given_back_behind_each_batch(monkeypatch):
    class Pool:
        given = 0

        def release_unused(self):
            self.given += 1

    pool = Pool()
    monkeypatch.setattr(bpe.pa, "default_memory_pool", lambda: pool)
    assert [(b, pool.given) for b in bpe.frugal(iter("abc"))] == [("a", 0), ("b", 1), ("c", 2)]
    assert pool.given == 3


def test_signature_names_the_least_of_the_commonest_ids():
    assert packing._signature(np.array([9, 4, 7, 4, 9, 50256], dtype=np.uint32))[0] == 4
    assert packing._signature(np.array([3, 3], dtype=np.uint32))[0] == 3
    assert packing._signature(np.array([8], dtype=np.uint32)) == (8, 0)


def test_packing_keeps_every_token_once(spark):
    lib = library(BYTES)
    data = [r for r in rows()]
    pieces = packing.pack(documents(spark), BYTES).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    copies = {r[0]: sum(x[0] == r[0] for x in data) for r in data}
    for r in data:
        ids = np.array([*ids_of(lib, r[1]), 0], dtype="<u4")
        mine = sorted(by_doc[r[0]], key=lambda p: p["start"])
        assert sum(p["length"] for p in mine) == len(ids) * copies[r[0]]
        for p in mine:
            assert p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
        covered = np.zeros(len(ids), dtype=int)
        for p in mine:
            covered[p["start"] : p["start"] + p["length"]] += 1
        assert (covered == copies[r[0]]).all()
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at == 1024 or at & (at - 1) == 0  # nothing to pad


def test_neighbours_fill_the_window():
    tails = [np.array([5] * 6), np.array([9] * 3), np.array([5] * 4), np.array([7] * 3)]
    idf = np.ones(16, dtype=np.float32)
    shard = packing.Shard(tails, idf, 4.0, 10)
    first = next(iter(shard.pack()))
    assert [(d, n) for d, _, n in first] == [(0, 6), (2, 4)]  # the like text, not the next one


def test_tokens_of_an_empty_table(spark):
    docs = empty(spark)
    assert token_counts.with_token_counts(docs, WORDS).count() == 0
    assert bpe_stream.with_digests(docs.select("doc_id", "text"), WORDS).count() == 0
    assert packing.pack(docs, BYTES).count() == 0


def test_ids_of_general_use(spark):
    got = bpe_stream.with_ids(documents(spark).select("doc_id", "text").where(F.col("doc_id") == 5), WORDS).first()
    assert np.frombuffer(got["ids"], "<u4").tolist() == ids_of(library(WORDS), "Two words")
