from __future__ import annotations

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from alphaspark.llm.telephony import ADPCM, ALAW, BLOCK, INDEX_CHANGE, MULAW, STEPS, Recorder, _describe, _encode, adpcm_decode, alaw_table, decode_all, describe_media, encode_texts, features, mulaw_table, pack_wave, payload_of, read_wave, record_texts, resample

from .helpers import docs_of, rows_of


def padded(text, to=192):
    b = (text or "").encode()
    return b + b" " * (max(to, -(-len(b) // to) * to) - len(b))


def test_tables_at_known_codes():
    mu, a = mulaw_table(), alaw_table()
    assert (mu[0xFF], mu[0x7F], mu[0x80], mu[0x00]) == (0, 0, 32124, -32124)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def test_adpcm_against_one_code_at_a_time():
    r = np.random.default_rng(1)
    blocks = r.integers(0, 256, (7, 40)).astype(np.uint8)
    blocks[:, 2] %= 89

    def slow(block):
        value, index = int(np.frombuffer(block[:2].tobytes(), "<i2")[0]), int(block[2])
        out = [value]
        for byte in block[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + int(INDEX_CHANGE[code])))
                out.append(value)
        return out

    assert adpcm_decode(blocks).tolist() == [slow(b) for b in blocks]


@pytest.mark.parametrize("tag", [MULAW, ALAW, ADPCM])
def test_round_trip(tag):
    payload = random.Random(tag).randbytes(BLOCK * 5)
    got, rate, block, data = read_wave(pack_wave(payload, tag))
    assert (got, rate, payload_of(got, block, data)) == (tag, 8000, payload)
    assert len(decode_all([(tag, block, data)])[0]) == (5 * (2 * BLOCK + 1) if tag == ADPCM else 5 * BLOCK)
    with pytest.raises(ValueError):
        read_wave(pack_wave(payload, tag)[:-BLOCK])


def test_resample():
    pcm = np.array([0, 100, -100, 32767, -32768], np.int16)
    assert resample(pcm, 8000, 16000).tolist() == [0, 50, 100, 0, -100, 16334, 32767, 0, -32768, -32768]
    assert resample(pcm, 8000, 8000).tolist() == pcm.tolist() and len(resample(pcm[:0], 8000, 16000)) == 0
    assert features(pcm[:0], 8000).startswith("0ms:0:0:0:")


def test_documents_against_the_bytes(spark):
    texts = ["", None, "a", "é" * 96, "x" * 192, "x" * 193, "many words " * 20_000, "a"]
    media = encode_texts(docs_of(spark, texts).withColumnRenamed("lang", "media"))
    got = {r["doc_id"]: r for r in describe_media(media).collect()}
    files = {r["doc_id"]: r["media"] for r in media.collect()}
    for i, t in enumerate(texts):
        p = padded(t)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(files[i]), hashlib.sha256(bytes(files[i])).hexdigest())
        tag, rate, block, data = read_wave(bytes(files[i]))
        pcm = resample(decode_all([(tag, block, data)])[0], rate, 16000)
        assert bytes(r["pcm"]) == pcm.astype("<i2").tobytes() and r["feature"] == f"{tag}:{features(pcm, 16000)}"
    assert got[2]["feature"] == got[7]["feature"] and got[2]["media_sha256"] == got[7]["media_sha256"]


def test_odd_rows(spark):
    df = docs_of(spark, ["t", "t", None], ids=[1, 1, None])
    assert rows_of(describe_media(encode_texts(df)), "doc_id", "n_bytes") == sorted([(1, 1), (1, 1), (None, 0)], key=repr)
    assert encode_texts(docs_of(spark, [])).count() == 0
    nothing = spark.createDataFrame([(1, 0, 7, None)], "doc_id long, n_bytes long, format_tag int, media binary")
    assert describe_media(nothing).first()["payload_sha256"] is None
    with pytest.raises(ValueError):
        encode_texts(df, padded=100)


@pytest.mark.parametrize(("rate", "to"), [(8000, 16000), (8000, 8000), (8000, 11025), (16000, 8000)])
def test_a_recorder_equals_the_whole(rate, to):
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 5000):
        pcm = r.integers(-32768, 32768, n).astype(np.int16)
        for step in (1, 3, 1000, 10_000):
            if n // step > 1000:
                continue
            taker = Recorder(rate, to, "zstd")
            for at in range(0, n, step):
                taker.add(pcm[at : at + step])
            feature, kept = taker.end()
            want = resample(pcm, rate, to)
            assert feature == features(want, to)
            assert zstandard.ZstdDecompressor().decompressobj().decompress(bytes(kept)) == want.astype("<i2").tobytes()


def test_a_long_text_needs_little_beside_its_file():
    """20 MB of ADPCM: 160 MB of samples at 16 kHz, never held at once."""
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([b"some words of a text, " * 1_000_000], pa.binary())], ["doc_id", "text"])
    tracemalloc.start()
    media = list(_encode(BLOCK, (ADPCM,))([batch]))
    out = list(_describe(16000, "zstd")(media))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6 and out[0].column("payload_bytes")[0].as_py() >= 22_000_000


def test_pcm_as_a_frame(spark):
    media = encode_texts(docs_of(spark, ["some text " * 50, "", None, "x" * 5000]))
    raw = {r["doc_id"]: r for r in describe_media(media).collect()}
    for r in describe_media(media, keep_pcm="zstd").collect():
        assert zstandard.ZstdDecompressor().decompressobj().decompress(bytes(r["pcm"])) == bytes(raw[r["doc_id"]]["pcm"]) and r["feature"] == raw[r["doc_id"]]["feature"]
    docs = docs_of(spark, ["some text " * 50, "", None, "x" * 5000])
    assert rows_of(record_texts(docs)) == rows_of(describe_media(media, keep_pcm="zstd")) and rows_of(record_texts(docs, keep_pcm=True)) == rows_of(describe_media(media))
    assert describe_media(media, keep_pcm=False).where("pcm IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        describe_media(media, keep_pcm="mp3")
