"""Token files: round trips, random access, and the awkward documents."""

import tracemalloc
import zlib
from glob import glob

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stubble.llm import direct_codes
from stubble.llm.queries import op13_direct_codes
from tests.llm import fixtures

PATH = public_tokenizers.path("word_bpe_49k.json")
SF_DIR = "/root/testdata/sf0.001"


def library_ids(texts):
    coded = Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [c.ids for c in coded]


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 4096, 4097, 20000])
def test_every_place_is_read_on_its_own(size):
    rng = np.random.default_rng(size)
    ids = (rng.integers(0, 2**32, size, dtype=np.uint64) >> rng.integers(0, 33, size, dtype=np.uint64)).astype("<u4")
    cut = sorted(rng.integers(0, size + 1, 3).tolist())
    docs = [(i, part.tobytes()) for i, part in enumerate(np.split(ids, cut))]
    file = direct_codes.TokenFile(direct_codes.file_bytes(3, 4, docs) + direct_codes.END)
    assert (file.part, file.number, file.docs, file.size) == (3, 4, 4, size)
    places = rng.permutation(size)
    assert (file.ids(places) == ids[places]).all()
    for _ in range(20):
        a, b = sorted(rng.integers(0, size + 1, 2).tolist())
        assert (file.span(a, b) == ids[a:b]).all()
    assert [d[2].tolist() for d in file.documents()] == [p.tolist() for p in np.split(ids, cut)]


def test_ids_up_to_the_edges_of_the_chunks():
    ids = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], dtype="<u4")
    file = direct_codes.TokenFile(direct_codes.file_bytes(0, 0, [(None, ids.tobytes())]) + direct_codes.END)
    assert file.ids(np.arange(8)).tolist() == ids.tolist()
    assert next(file.documents())[0] is None


def peak_of(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_file_is_made_and_read_in_little_memory():
    ids = np.random.default_rng(5).integers(0, 49000, 1 << 21).astype("<u4")
    docs = [(i, part.tobytes()) for i, part in enumerate(np.array_split(ids, 2000))]
    content = direct_codes.file_bytes(0, 0, docs) + direct_codes.END
    assert peak_of(lambda: direct_codes.file_bytes(0, 0, docs)) < 3.5 * ids.nbytes
    assert peak_of(lambda: [None for _ in direct_codes.TokenFile(content).documents()]) < 2.5 * ids.nbytes


def test_documents_across_the_spans_that_are_read_at_once(monkeypatch):
    monkeypatch.setattr(direct_codes, "READ_IDS", 100, raising=False)
    rng = np.random.default_rng(6)
    docs = [(i, rng.integers(0, 70000, n).astype("<u4").tobytes()) for i, n in enumerate([0, 100, 0, 1, 99, 1, 350, 0, 60, 60, 0, 0])]
    found = list(direct_codes.TokenFile(direct_codes.file_bytes(0, 0, docs) + direct_codes.END).documents())
    assert [(i, x.astype("<u4").tobytes()) for i, _, x in found] == docs
    assert [a for _, a, _ in found] == np.cumsum([0, *[len(b) // 4 for _, b in docs]])[:-1].tolist()


def test_broken_files_are_refused():
    good = direct_codes.file_bytes(0, 0, [(1, np.array([5, 700], "<u4").tobytes())]) + direct_codes.END
    for bad in (good[:-1], good[:-9] + b"\n", b"x" + good[1:], good + bytes(8) + b"\n"):
        with pytest.raises(ValueError):
            direct_codes.TokenFile(bad)


def test_odd_documents_come_back_from_the_files(spark, tmp_path):
    rows = fixtures.rows() + [(None, "no id", "en", "s", 5, "x"), (None, None, None, None, None, None), (-4, "minus", "en", "s", 5, "x")]
    folder = f"{tmp_path}/files"
    direct_codes.write_token_files(fixtures.documents(spark, rows), PATH, folder, end=2, file_ids=3000)
    assert len(glob(f"{folder}/part*")) > 3
    found = direct_codes.read_documents(spark, folder).collect()
    coded = [i + [2] for i in library_ids([r[1] for r in rows])]
    want = [(r[0], len(i), zlib.crc32(np.array(i, dtype="<u4"))) for r, i in zip(rows, coded)]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found], key=key) == sorted(want, key=key)
    found.sort(key=lambda r: r["start"])
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r["start"] for r in found] == np.cumsum([0, *[r["n_tokens"] for r in found]])[:-1].tolist()
    # Random access to the corpus; places outside it give no row.
    docs = {r["doc_id"]: r for r in found}
    start, long = docs[13]["start"], coded[13]
    asked = [start, start + 4000, start + len(long) - 1, start, -1, sum(map(len, coded))]
    places = spark.createDataFrame([(p,) for p in asked], "place long")
    got = {r["place"]: r["token_id"] for r in direct_codes.read_ids(spark, folder, places).collect()}
    assert got == {start: long[0], start + 4000: long[4000], start + len(long) - 1: 2}


def test_a_chunk_of_many_texts_is_looked_up_once(monkeypatch):
    known = fixtures.CountedLooks()
    monkeypatch.setitem(direct_codes._KNOWN, PATH, known)
    texts = ["again and again", "", " \t\v", "\x1cagain\x85and ", "a<|endoftext|>again <|startoftext|>", "\0 again\n"] * 50
    coded = direct_codes.token_bytes(PATH, [t.encode() for t in texts])
    assert [np.frombuffer(c, "<u4").tolist() for c in coded] == library_ids(texts)
    assert known.looks < len(texts)


def test_chunks_beyond_the_bound_are_forgotten(monkeypatch):
    monkeypatch.setattr(direct_codes, "REMEMBERED", 200, raising=False)
    monkeypatch.setattr(direct_codes, "LEARNT", 7, raising=False)
    monkeypatch.setitem(direct_codes._KNOWN, PATH, {})
    for k in range(8):
        texts = [f"the same words and w{k}x{i} z{i * k}q\n  blanks \u00dc{i}" for i in range(60)]
        coded = direct_codes.token_bytes(PATH, [t.encode() for t in texts])
        assert [np.frombuffer(c, "<u4").tolist() for c in coded] == library_ids(texts)
        assert len(direct_codes._KNOWN[PATH]) <= 200


def test_arrow_batches_are_small(spark, tmp_path, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []

    def watch(owner, call):
        plain = getattr(owner, call)
        monkeypatch.setattr(owner, call, lambda *args: (seen.append((call, spark.conf.get(name))), plain(*args))[1])

    docs, own = fixtures.documents(spark), spark.conf.get(name)
    watch(type(docs.write), "text")
    watch(direct_codes, "staged")
    direct_codes.write_token_files(docs, PATH, f"{tmp_path}/files", end=2)
    direct_codes.read_documents(spark, f"{tmp_path}/files")
    assert seen[:2] == [("text", "2500"), ("staged", "1")]
    assert spark.conf.get(name) == own


def test_files_go_from_the_scan_to_python_and_empty_ones_are_passed_over(spark, tmp_path, capsys):
    folder = f"{tmp_path}/files"
    direct_codes.write_token_files(fixtures.documents(spark, [(1, "some words", "en", "s", 5, "x")]), PATH, folder, end=2)
    (tmp_path / "files/part-empty.txt").write_bytes(b"")
    assert [r["doc_id"] for r in direct_codes.read_documents(spark, folder).collect()] == [1]
    places = spark.createDataFrame([(0,)], "place long")
    assert direct_codes.read_ids(spark, folder, places).count() == 1
    capsys.readouterr()
    direct_codes._contents(spark, folder).explain()
    plan = capsys.readouterr().out
    assert "FileScan binaryFile" in plan and "Filter (" not in plan and "Project [" not in plan


def test_empty_table(spark, tmp_path):
    direct_codes.write_token_files(fixtures.empty(spark), PATH, f"{tmp_path}/none", end=2)
    assert direct_codes.read_documents(spark, f"{tmp_path}/none").collect() == []


def test_query_equals_the_library(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    coded = [i + [2] for i in library_ids(docs["text"])]
    starts = np.cumsum([0, *map(len, coded)])[:-1].tolist()
    want = [(d, s, len(i), zlib.crc32(np.array(i, dtype="<u4"))) for d, s, i in zip(docs["doc_id"].tolist(), starts, coded)]
    assert sorted(map(tuple, op13_direct_codes(spark, SF_DIR).collect())) == want
