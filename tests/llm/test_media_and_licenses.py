"""FLAC and license rules."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from siteledger.llm import flac, licenses

from .helpers import EDGE, edge_docs


def scalar_decode(data):
    """One sample at a time, by the format's own description; returns the payload bytes."""
    info = flac.read_header(data)
    bits = "".join(f"{b:08b}" for b in data[info["first"] :])
    at, out = 0, []

    def take(n, signed=False):
        nonlocal at
        v = int(bits[at : at + n] or "0", 2)
        at += n
        return v - (1 << n) if signed and n and v >> (n - 1) else v

    while len(out) < info["samples"]:
        assert take(16) == 0xFFF8
        take(16)
        first = take(8)
        while first & 0x80 and first & 0x40:
            take(8)
            first = (first << 1) & 0xFF
        take(8)
        take(1)
        kind = take(6)
        take(1)
        x = []
        if kind == 0:
            x = [take(8, True)] * 576
        elif kind == 1:
            x = [take(8, True) for _ in range(576)]
        else:
            order = kind & 7 if kind < 32 else (kind & 31) + 1
            x = [take(8, True) for _ in range(order)]
            taps, shift = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))[order] if kind < 32 else (), 0
            if kind >= 32:
                precision, shift = take(4) + 1, take(5)
                taps = [take(precision, True) for _ in range(order)]
            assert take(2) == 0
            depth = take(4)
            for part in range(1 << depth):
                k = take(4)
                for _ in range((576 >> depth) - (order if part == 0 else 0)):
                    q = 0
                    while take(1) == 0:
                        q += 1
                    u = q << k | take(k)
                    r = -(u + 1) // 2 if u & 1 else u // 2
                    x.append(r + (sum(c * x[-1 - j] for j, c in enumerate(taps)) >> shift))
        out += x
        at = -(-at // 8) * 8 + 16
    return bytes((v + 128) & 0xFF for v in out)


def payloads():
    rng = np.random.default_rng(1)
    wave = bytes((128 + 60 * np.sin(np.arange(576 * 3) / 7) + rng.integers(-3, 4, 576 * 3)).astype(np.uint8))
    texts = [None, "", "x", "é" * 700, "a" * 576, "The quick brown fox. " * 90]
    return [flac.padded(t)[0] for t in texts] + [wave, bytes(rng.integers(0, 256, 576 * 2, dtype=np.uint8))]


@pytest.mark.parametrize("predictors", [None, ([9, -5], 2), ([7, 2, -1], 3)])
def test_streams_round_trip_and_agree_with_a_plain_decoder(predictors):
    made = payloads()
    streams = flac.encode(made, predictors)
    assert [(x.view(np.uint8) ^ 0x80).tobytes() for x in flac.decode(streams)] == made
    assert [scalar_decode(s) for s in streams] == made


def test_a_stream_without_a_full_seek_table(monkeypatch):
    monkeypatch.setattr(flac, "SEEK_EVERY", 7)
    made = [bytes(range(256)) * 9 * 2]
    assert [(x.view(np.uint8) ^ 0x80).tobytes() for x in flac.decode(flac.encode(made))] == made


def test_damage_is_noticed():
    whole = flac.encode(payloads()[6:7])[0]
    first = flac.read_header(whole)["first"]
    for at in (first + 5, first + 60, len(whole) - 1, 30):
        broken = bytearray(whole)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(broken)])


def test_frame_numbers():
    for n in (0, 127, 128, 2047, 2048, 65535, 65536, 1 << 21, 1 << 26, (1 << 31) - 1):
        coded = flac._coded_number(n)
        assert flac._read_number(coded, 0) == (n, len(coded))


def test_texts_as_media(spark):
    media = flac.encode_texts(edge_docs(spark))
    got = flac.digests(media, ["doc_id", "n_bytes"]).collect()
    assert len(got) == len(EDGE)
    for r, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id, r.n_bytes)), sorted(EDGE, key=lambda e: (e[0] is None, e[0], len(e[1] or "")))):
        payload, n = flac.padded(t)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256) == (i, n, len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
    assert flac.digests(flac.encode_texts(edge_docs(spark, [])), ["doc_id"]).count() == 0


def test_pcm_blocks_are_seekable(spark):
    text = "0123456789" * 200
    media = flac.encode_texts(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))
    blocks = sorted(flac.pcm_blocks(media, ["doc_id"]).collect(), key=lambda r: r.first_sample)
    assert [r.first_sample for r in blocks] == [0, 576, 1152, 1728]
    assert bytes(b ^ 0x80 for r in blocks for b in bytes(r.pcm))[:2000].decode() == text


# Licenses ----------------------------------------------------------------------


def resolve_plainly(finds):
    finds = sorted(set(finds), key=lambda f: (f[0], -f[1], f[2], f[3]))
    out = []
    for n, f in enumerate(finds):
        inside = lambda g, f=f: g[0] <= f[0] and f[1] <= g[1]
        if not any(inside(g) and g[2] <= f[2] and (m < n) for m, g in enumerate(finds) if m != n):
            out.append(f)
    return out


def test_containment_matches_all_pairs():
    rng = random.Random(2)
    for _ in range(200):
        finds = [(a := rng.randrange(20), a + rng.randrange(1, 8), rng.randrange(4), rng.choice("xyz"), 0.5) for _ in range(rng.randrange(12))]
        assert licenses.resolve(finds) == resolve_plainly(finds)


def base_plainly(text):
    words = [w for w in "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)).split(" ") if w]
    found = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found += [(n, label) for n in range(len(words)) if words[n : n + len(p)] == p]
    return len(words), sorted(found)


def test_base_places_match_word_lists():
    rng = random.Random(4)
    parts = ["CC", "by", "general", "Public", "license", "all", "RIGHTS", "reserved", "é", "cc-by", "x y", "GNU", "mit"]
    for _ in range(300):
        text = "".join(rng.choice(parts) + rng.choice([" ", "\n", "-", ". ", "_"]) for _ in range(rng.randrange(20)))
        got = licenses.scan(text)
        assert (got["n_words"], got["base"]) == base_plainly(text)


def test_rules():
    labels = lambda t: [f[3] for f in licenses.scan(t)["finds"]]
    assert len(licenses.rules()) > 300
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert labels("under the GNU General Public License, version 3.") == ["gpl-3"]
    assert labels("CC-BY-SA-4.0, then SPDX-License-Identifier: MIT") == ["cc-by-sa-4.0", "mit"]
    assert labels("a text of no license") == []


def test_scan_of_edge_rows(spark):
    got = licenses.license_scan(edge_docs(spark, [*EDGE, (9, "All rights reserved. " * 30000)])).collect()
    assert len(got) == len(EDGE) + 1
    by_id = {r.doc_id: r for r in got}
    assert (by_id[1].n_words, by_id[1].labels, by_id[1].score, by_id[1].first_word) == (0, "", 0.0, None)
    assert (by_id[9].n_base, by_id[9].first_word, by_id[9].last_word, by_id[9].base_labels) == (30000, 0, 89997, "reserved")
    assert licenses.license_scan(edge_docs(spark, [])).count() == 0
