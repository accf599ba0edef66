"""Sentencepiece codec against the library; shard placement against its definition."""

import hashlib
import random
import struct
import time
from collections import Counter

import pytest
import sentencepiece

from sievework.llm import queries, sentencepiece_codec, sharding
from sievework.llm.sentencepiece_codec import AgendaEncoder, encode, encode_texts

MODEL = queries.vocabulary("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  a  b  ", "▁x ▁", "😀 héé\n\n\tq\x00z \x00 a", "<s> </s> <0x41> [INST]", "Ⅷ ﬁ  ", "a　b",
    "x" * 3000, "ab " * 2000, "日本語のテキスト と", "ends ", "a" * 23 + " " + "é" * 24 + " " + "zq" * 30
]


def test_codec_on_the_table_and_edges(spark, tmp_path):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = [
        (r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    ] + [(10_000 + i, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op9_sentencepiece(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    full = encode(spark.read.parquet(f"{tmp_path}/documents.parquet"), MODEL)
    assert full.columns == ["doc_id", "text", "ids", "decoded"]
    assert {r["doc_id"]: r["ids"] for r in full.collect()}[10_003] == lib.encode("  a  b  ", add_bos=True, add_eos=True)
    assert encode(full.limit(0).select("doc_id", "text"), MODEL).count() == 0


WORDS = [
    "", "a", "hello", "wörld", "x#y", "naïveté", "aaaaaaaaaaaaaaaaaaaaaaa", "日本", "one\ntwo\n\nthree", "\n",
    "banana", "mississippi", "a" * 40, "ab\0"
]


def test_heap_and_rows_agree():
    enc = AgendaEncoder(MODEL)
    enc.learn(set(WORDS))
    for w in WORDS:
        assert list(struct.unpack(f"<{len(enc.young[w]) // 4}I", enc.young[w])) == enc.merge("▁" + w)
        assert not w or enc.merge("▁" + w) == enc.lib.encode(w)


def fields(data: bytes):
    """Number, kind, value and raw bytes of the fields of a protocol buffer message."""
    at = 0

    def number():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            out, shift, at = out | (b & 127) << shift, shift + 7, at + 1
            if b < 128:
                return out

    while at < len(data):
        start, tag = at, number()
        if tag & 7 == 0:
            value = number()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or number()
            value, at = data[at : at + n], at + n
        yield tag >> 3, tag & 7, value, data[start:at]


def test_equal_scores_merge_from_left_to_right(tmp_path):
    """A copy of the vocabulary in which scores are cut to eight values, so that most pieces have many equals."""
    out = b""
    for field, _, value, raw in fields(open(MODEL, "rb").read()):
        if field == 1:
            parts = {f: (v, r) for f, _, v, r in fields(value)}
            score = struct.unpack("<f", parts[2][0])[0]
            value = parts[1][1] + b"\x15" + struct.pack("<f", float(int(score / 4000))) + (parts[3][1] if 3 in parts else b"")
            raw = b"\x0a" + (bytes([len(value)]) if len(value) < 128 else bytes([len(value) & 127 | 128, len(value) >> 7])) + value
        out += raw
    (tmp_path / "ties.model").write_bytes(out)
    enc = AgendaEncoder(str(tmp_path / "ties.model"))
    assert len(set(enc.rank.values())) < 20
    texts = [t or "" for t in TEXTS] + WORDS + ["the banana of mississippi is in the internationalisation department"]
    for text, packed in zip(texts, enc.encode_packed(texts), strict=True):
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == enc.lib.encode(text, add_bos=True, add_eos=True), text[:50]


def test_very_long_text_of_distinct_words_and_small_tables(monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäé0.\n") for _ in range(rng.randint(1, 30)))
    texts = [" ".join(word() for _ in range(60_000)), " ".join(word() for _ in range(300)), "  ".join(word() for _ in range(300))]
    monkeypatch.setattr(sentencepiece_codec, "WORDS", 1_000)
    assert len(encode_texts(texts * 2, MODEL)) == 6


def test_words_of_a_slice_agree_with_the_heap():
    enc, rng = AgendaEncoder(MODEL), random.Random(9)
    words = {"".join(rng.choice("aeinrstdhlAÉé0.,%\n\0日ж😀") for _ in range(rng.randint(1, 40))) for _ in range(500)}
    texts = ["", "one", " ".join(sorted(words)), "ends ", "two  marks", " ".join(WORDS), "\n".join(sorted(words))]
    for given in (texts, texts[:1], texts[1:2], ["", "  "], []):
        for text, packed in zip(given, enc.encode_packed(given), strict=True):
            body = [i for u in enc.units.findall(enc.lib.normalize(text)) for i in enc.merge(u)]
            assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == [enc.lib.bos_id(), *body, enc.lib.eos_id()], text[:50]


def test_agenda_takes_less_time_than_the_check(spark):
    """Most of the budget is the library's, which encodes each whole text too: the agenda has to stay below it. Both are
    CPU times of one thread on the same texts, the best of three; tables of words are empty at first."""
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(1_000).collect()]
    enc, ours, theirs = AgendaEncoder(MODEL), [], []
    for _ in range(3):
        enc.young, enc.old = {}, {}
        began = time.process_time()
        for i in range(0, len(texts), 250):
            enc.encode_packed(texts[i : i + 250])
        ours.append(time.process_time() - began)
        began = time.process_time()
        for i in range(0, len(texts), 250):
            enc.lib.encode_as_numpy(texts[i : i + 250], add_bos=True, add_eos=True, num_threads=1)
        theirs.append(time.process_time() - began)
    assert min(ours) < 0.9 * min(theirs), (ours, theirs)


def test_lookup_table():
    shards = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(shards, 1009)
    sizes = Counter(table)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.lookup_table(shards[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 0.25 * 1009
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 11)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 10)


def test_place_edges(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (5, None)], "doc_id long, shard string")
    got = sharding.place(df, "doc_id", ["a", "b"], 11)
    assert got.columns == ["doc_id", "slot", "shard"] and got.count() == 4
    assert got.where("doc_id = 1").select("slot").distinct().count() == 1
    sharding.write_shards(df.drop("shard"), f"{tmp_path}/out", "doc_id", ["a", "b"], 11, 2)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4
    odd = spark.createDataFrame([("k" * 100_000, "s", 1, 2), (None, "s", 1, 2)], "doc_id string, slot string, salt int, place int")
    sharding.write_shards(odd, f"{tmp_path}/odd", "doc_id", ["a", "b"], 11, 2, "part")
    back = spark.read.parquet(f"{tmp_path}/odd")
    assert sorted(back.columns) == ["doc_id", "part", "place", "salt", "slot"] and [(r["slot"], r["salt"]) for r in back.collect()] == [("s", 1)] * 2
    assert sharding.place(df.limit(0), "doc_id", ["a"], 11).count() == 0
