import zlib

import numpy as np
import public_tokenizers
import pytest
from linkgrove.llm import packing, tokenfiles
from linkgrove.llm.common import new_path
from linkgrove.llm.tokens import Encoder
from tokenizers import Tokenizer

FILES = {"byte_bpe_50k.json": True, "word_bpe_49k.json": False}


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("name", FILES)
def test_pieces_equal_whole_texts(name, small_rows, odd_rows):
    enc, lib = Encoder(public_tokenizers.path(name), FILES[name]), library(name)
    extra = ["a\nb", "a\n\nb", "a \nb", " a", "a ", "a\n", "'s x's 's", "é áb x ́y", "a b c", "", "\n", "a  b", "x\x1cy z", "ﬁ Å İ ß", "a, b. c., d, ., e_, f, g2. h", "w.\nx,\ny", "Σίσυφος ΟΔΟΣ, x", "don't, it's. ok", "a \x00b", "x, <|endoftext|>, y"]
    for text in [t for _, t in small_rows] + [r[1] for r in odd_rows] + extra:
        assert enc.encode(text).tolist() == lib.encode(text or "", add_special_tokens=False).ids


def test_cache_stays_bounded(monkeypatch, small_rows):
    from linkgrove.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_PIECES", 300)
    monkeypatch.setattr(tokens, "KEEP_PIECES", 100)
    enc, lib = Encoder(public_tokenizers.path("byte_bpe_50k.json"), True), library("byte_bpe_50k.json")
    for _, text in small_rows[:60]:
        assert enc.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids
        assert len(enc.index) <= 300


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_pieces(rows, docs):
    """Every id in one piece, offsets without gaps, lengths powers of two."""
    lib = library("byte_bpe_50k.json")
    whole = sorted(([d, lib.encode(t or "", add_special_tokens=False).ids + [0]] for d, t in docs), key=str)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc in {d for d, _ in docs}:
        texts = [ids for d, ids in whole if d == doc]
        assert sum(map(len, texts)) == sum(r.length for r in by_doc[doc])
        if len(texts) == 1:
            at = 0
            for r in sorted(by_doc[doc], key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(texts[0]))
                assert r.ids_crc32 == crc(texts[0][at : at + r.length])
                at += r.length
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0
        assert len({(r.tier, r.step_group) for r in pieces}) == 1 and pieces[0].tier == at


def path(name="byte_bpe_50k.json"):
    return public_tokenizers.path(name)


def test_packing(small, small_rows, odd, odd_rows, none):
    check_pieces(packing.pack_documents(small, path()).collect(), small_rows)
    check_pieces(packing.pack_documents(odd, path()).collect(), [r[:2] for r in odd_rows])
    assert packing.pack_documents(none, path()).collect() == []


def test_pack_shapes():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 60, 700):
        lengths = np.maximum(1, rng.lognormal(5, 1.5, n).astype(int)).tolist()
        seqs = packing.pack(lengths)
        assert sum(s.used for s in seqs) == sum(lengths)
        assert all(s.used == s.tier for s in seqs)
        if n == 700:
            short = [s for s in seqs if s.tier < 128]
            assert len(short) <= 7
            assert sum(len(s.pieces) for s in seqs) <= n + 2 * len(seqs)


def test_step_groups_balance():
    lengths = np.random.default_rng(2).integers(20, 3000, 3000).tolist()
    seqs = packing.pack(lengths)
    groups = packing.step_groups(seqs)
    for tier in packing.TIERS[:1]:
        cost, count = {}, {}
        for s, g in zip(seqs, groups, strict=True):
            if s.tier == tier:
                cost[g] = cost.get(g, 0) + s.cost
                count[g] = count.get(g, 0) + 1
        assert max(count.values()) - min(count.values()) <= 1
        assert max(cost.values()) < 1.1 * min(cost.values())


def brute_table(docs):
    lib = library("word_bpe_49k.json")
    at, out = 0, []
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def test_token_files(spark, small, small_rows, odd, odd_rows, none):
    for frame, rows in ((small, small_rows), (odd, [r[:2] for r in odd_rows]), (none, [])):
        manifest = tokenfiles.write_token_files(frame, path("word_bpe_49k.json"), new_path(spark, "files"))
        got = sorted(map(tuple, tokenfiles.read_token_files(manifest).collect()), key=lambda r: r[1])
        assert got == brute_table(rows)


def test_random_access_and_damage(tmp_path):
    docs = [(k, np.arange(k * 1000, dtype=np.uint32) % 50000) for k in range(60)]
    where = f"file://{tmp_path}/part"
    assert tokenfiles.write_part(where, docs, False) == (60, sum(len(x) for _, x in docs))
    reader = tokenfiles.PartReader(where, False)
    doc_id, _, ids = reader.document(33)
    assert doc_id == 33 and (ids == docs[33][1]).all()
    assert reader.ids.frames_read <= 2 < len(reader.ids.sums)
    import zstandard

    raw = (tmp_path / "part.ids").read_bytes()
    plain = b"".join(x[1].astype("<u2").tobytes() for x in docs)
    assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(raw) == plain
    damaged = bytearray(raw)
    damaged[len(raw) // 2] ^= 1
    (tmp_path / "part.ids").write_bytes(damaged)
    reader = tokenfiles.PartReader(where, False)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        for k in range(60):
            reader.document(k)
    with pytest.raises(ValueError):
        (tmp_path / "short").write_bytes(raw[:-5])
        import pyarrow as pa

        tokenfiles.FrameReader(pa.OSFile(str(tmp_path / "short")))


def test_idle_encoders_go(monkeypatch):
    """Spark keeps workers for later stages, which then have no use for the vocabulary and its cache."""
    import time

    from linkgrove.llm import tokens

    monkeypatch.setattr(tokens, "IDLE", 0.2, raising=False)
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = tokens.encoder(path, False).encode("some words").tolist()
    until = time.monotonic() + 20
    while tokens._ENCODERS and time.monotonic() < until:
        time.sleep(0.1)
    assert not tokens._ENCODERS and tokens.encoder(path, False).encode("some words").tolist() == ids
