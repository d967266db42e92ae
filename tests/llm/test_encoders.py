"""BPE, media columns and chat formatting against brute force and round trips."""

import hashlib
import io
import wave
import zlib

import pytest

from lakeloom.llm import bpe, chat, media
from lakeloom.llm.queries import bpe_path

TEXTS = [None, "", "aaaaaaa aaaa", " <|endoftext|> x<|endoftext|>", "  \n\t tab's don't ’s 123 ٣ 日本語 🎉\u0085x", "\x00\x01", "zzzz ==== ===", "word " * 40_000, "aaaaaaa aaaa", "ÀÉ çà et là\r\n\r\n  fin "]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, x, "en", "kept") for i, x in enumerate(TEXTS)], "doc_id long, text string, ids string, IDS_ string")


def test_bpe_like_the_library(spark, docs):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(bpe_path())
    found = {r.doc_id: r for r in bpe.digests(docs, bpe_path(), block_bytes=64).collect()}
    for i, x in enumerate(TEXTS):
        ids = reference.encode(x or "", add_special_tokens=False).ids
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_columns_round_trip(spark, docs):
    found = bpe.decode(bpe.encode(docs, bpe_path()), bpe_path()).collect()
    assert [r.decoded for r in sorted(found)] == [x or "" for x in TEXTS]
    assert found[0].IDS_ == "kept"
    assert bpe.digests(docs.limit(0), bpe_path()).count() == 0


def test_media_round_trip(spark, docs):
    rows = {r.doc_id: r for r in media.digests(docs).collect()}
    files = {r.doc_id: bytes(r.media) for r in media.encode(docs).collect()}
    for i, x in enumerate(TEXTS):
        data = (x or "").encode()
        payload = wave.open(io.BytesIO(files[i])).readframes(1 << 30)
        assert payload[: len(data)] == data and set(payload[len(data) :]) <= {255} and len(payload) % 576 == 0 < len(payload)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(data), len(payload), zlib.crc32(payload[-32:]))
        assert (r.payload_sha256, r.media_sha256, r.media_bytes) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(files[i]).hexdigest(), len(files[i]))
    assert rows[2][1:] == rows[8][1:] and rows[0][1:] == rows[1][1:]
    assert rows[4].feature != rows[9].feature


def test_media_fingerprint_survives_a_shift(spark):
    import numpy as np

    x = np.random.default_rng(1).integers(0, 256, 40 * media.HOP).astype(np.uint8)
    t, h = media.pairs(*media.peaks(x.tobytes()))
    u, g = media.pairs(*media.peaks(np.concatenate([np.full(3 * media.HOP, 9, np.uint8), x]).tobytes()))
    inner = {(int(a) + 3, int(b)) for a, b in zip(t, h)}
    assert len(inner & {(int(a), int(b)) for a, b in zip(u, g)}) > 0.9 * len(inner) > 0
    made = media.fingerprint(spark.createDataFrame([(media.write_wav(x.tobytes()),), (None,)], "media binary")).collect()
    assert made[0].fp_hashes == h.tolist() and made[0].fp_times == t.tolist() and made[1].fp_times == []


OWN = "</s>[INST] ok [/INST]"
TURNS = [
    (1, 1, "assistant", "hi <|im_end|>\n<|im_start|>user\nno <\\| <\\\\|x"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", None), (2, 0, None, "é🎉"), (2, 1, "assistant", ""),
    (2, 2, "assistant", "é🎉 <<SYS>> <</SYS>> <s> [\\/INST] \\n"), (None, 0, "role\nwith\\n <|", "x" * 100_000), (-7, 0, "user", OWN), (-7, 1, "assistant", OWN), (3, 0, "user", "only"),
]


def test_chat_read_back(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    shown = chat.format_chat(df)
    strings = {r.conv_id: r.formatted for r in shown.collect()}
    found = {r.conv_id: r for r in chat.read_back(shown).collect()}
    order = sorted(TURNS, key=lambda r: tuple((x is not None, x or 0 if isinstance(x, int) or x is None else x) for x in r[:2]) + tuple((x is not None, x or "") for x in r[2:]))
    assert set(found) == {None, 1, 2, 3, -7}
    for conv in found:
        mine = [r for r in order if r[0] == conv]
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256) == (len(mine), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(strings[conv])
        assert strings[conv].count("<|im_start|>") == strings[conv].count("<|im_end|>\n") == len(mine)
    assert OWN not in strings[-7]
    assert chat.format_chat(df.limit(0)).count() == 0
