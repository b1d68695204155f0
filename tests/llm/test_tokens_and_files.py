import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardiolake.llm import packing, token_file
from cardiolake.llm.queries import QUERIES, vocabulary
from cardiolake.llm.tokens import Encoder

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
STRANGE = [
    None, "", " ", "\n", "a\n", "\na", "a  b", "a \n b", "x\n y", "a\n\nb  c\n  d", "a\0b c", "tab\tx y\r\nz",
    "don't  it's DON'T IT'S a's, b'll.", "Σας ΣΑΣ Σ.", "W̊ x W̊ é É.", "<|endoftext|> a <|endoftext|>", "１２３ ½ ª º ²",
    "a  b a  b a  \nb", "İstanbul ß ẞ ÿ Ÿ µ", "日本語 テスト。 🙂 a🙂, b", "\x1c a \x1c b", "x_y_ z__ a-b- c@",
    "a, b. c; d! e? f.. g,, ,a .b", "a.\nbe### c,$$$ d.!!\ne", " lead trail ",
]


def whole(tokenizer, text):
    return array("I", tokenizer.encode(text or "", add_special_tokens=False).ids).tobytes()


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_whole_texts(path, texts001):
    tool, plain = Encoder(path, max_words=2000), Encoder(path).tokenizer
    rows = [*STRANGE, *list(texts001.values())[:120]]
    for _ in range(2):  # with an empty table and with a filled one
        assert tool.encode(rows) == [whole(plain, t) for t in rows]
    assert len(tool.known) <= 2000


@pytest.mark.parametrize("count,most", [(0, 8), (1, 8), (7, 8), (8, 8), (29, 8), (1024, 1024), (3073, 1024)])
def test_piece_lengths(count, most):
    found = packing.piece_lengths(count, most)
    assert sum(found) == count and all(n & (n - 1) == 0 and n <= most for n in found)
    assert sorted(found, reverse=True) == found and len([n for n in found if n < most]) == len({n for n in found if n < most})


def packed_rows(docs):
    return packing.pack(docs, BYTE, end_id=0, most=64).collect()


def test_pack_covers_every_id_once(odd):
    plain = Encoder(BYTE).tokenizer
    rows = packed_rows(odd)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    by_length = {}
    for r in rows:
        assert r["offset"] == 0 and len(r["ids"]) == 4 * r["length"] and r["length"] & (r["length"] - 1) == 0
        by_length.setdefault(r["length"], []).append(r["sequence_id"])
    ranges = sorted((min(v), max(v)) for v in by_length.values())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))  # a length is one range of ids
    expected = sorted((r["doc_id"] or -1, whole(plain, r["text"]) + bytes(4)) for r in odd.collect())
    found, current = [], None
    for r in rows:
        if r["start"] == 0:
            current = [r["doc_id"] or -1, b""]
            found.append(current)
        assert len(current[1]) == 4 * r["start"]
        current[1] += bytes(r["ids"])
    assert sorted(map(tuple, found)) == expected


def test_pack_of_nothing_and_clashing_columns(odd):
    assert packed_rows(odd.limit(0)) == []
    more = odd.withColumns({c: F.lit("x") for c in ("ids", "start", "length", "offset")})
    assert len(packed_rows(more)) == len(packed_rows(odd))
    with pytest.raises(ValueError):
        packing.pack(odd, BYTE, most=48)


def test_packing_query_digests(spark, texts001):
    plain = Encoder(BYTE).tokenizer
    rows = QUERIES["op3_power_of_two_packing"](spark, "/root/testdata/sf0.001").collect()
    assert sum(r["length"] for r in rows) == sum({r["doc_id"]: r["doc_tokens"] for r in rows}.values())
    for r in rows:
        ids = whole(plain, texts001[r["doc_id"]]) + bytes(4)
        assert r["doc_tokens"] == len(ids) // 4
        assert r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])])


def test_token_files_round_trip(spark, texts001):
    plain = Encoder(WORD).tokenizer
    rows = sorted(QUERIES["op6_token_files"](spark, "/root/testdata/sf0.001").collect())
    at = 0
    assert [r["doc_id"] for r in rows] == sorted(texts001)
    for r in rows:
        ids = whole(plain, texts001[r["doc_id"]]) + (1).to_bytes(4, "little")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4


def test_token_files_odd_rows_and_random_access(spark, odd, tmp_path):
    plain = Encoder(WORD).tokenizer
    more = odd.withColumns({c: F.lit("x") for c in ("bucket", "key", "start", "ids")})
    folder = token_file.qualified(spark, str(tmp_path))
    manifest = token_file.write(more, folder, WORD, length=16, shards=3)
    rows = sorted(token_file.read(spark, manifest, folder).collect(), key=lambda r: r["start"])
    source = sorted(odd.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""))
    assert [r["doc_id"] for r in rows] == [r["doc_id"] for r in source]
    stream = b""
    for r, s in zip(rows, source):
        assert 4 * r["start"] == len(stream)
        assert bytes(r["ids"]) == whole(plain, s["text"]) + (1).to_bytes(4, "little")
        stream += bytes(r["ids"])
    ids = np.frombuffer(stream, "<u4")
    for shard in manifest.collect():
        reader = token_file.ShardReader(folder, shard["name"])
        own = ids[shard["base"] : shard["base"] + shard["tokens"]]
        for k in {0, shard["tokens"] // 32, (shard["tokens"] - 1) // 16}:
            row, mask = reader.row(k)
            assert len(row) == 16 and row[mask].tolist() == own[16 * k : 16 * k + 16].tolist()
        view, _ = reader.batch(0)
        assert not view.flags.owndata and not view.flags.writeable  # a view of the mapped file
    nothing = token_file.write(odd.limit(0), folder, WORD)
    assert nothing.count() == 0 and token_file.read(spark, nothing, folder).count() == 0
