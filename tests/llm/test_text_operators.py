import hashlib
import itertools
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quarry.llm import language_id, quality
from quarry.llm import sentencepiece_lattice as sp
from quarry.llm.media import media_column, media_digest, padded
from quarry.llm.mixing import deal, mix_sources, quantised, schedule
from quarry.llm.progressive_jpeg import decode, encode_bytes, rgb, stored_bytes


def test_media_keeps_payloads(documents):
    rows = sorted(((r.doc_id, r.text) for r in documents.collect()), key=str)
    got = sorted(media_digest(documents).collect(), key=lambda r: str((r.doc_id, None)))
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.payload_sha256), r)
    for doc_id, text in rows:
        raw = (text or "").encode()
        payload = padded(raw)
        r = by[doc_id, hashlib.sha256(payload).hexdigest()]
        media = encode_bytes(payload)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert len(got) == len(rows) and media_digest(documents.limit(0)).collect() == []
    one = media_column(documents.where("doc_id = 3")).first()
    assert len(one.rgb) == one.height * one.width * 3 and stored_bytes(decode(one.media), one.n_bytes) == rows[[r[0] for r in rows].index(3)][1].encode()


def test_scans_read_symbol_by_symbol_agree():
    r = np.random.default_rng(0)
    for n in (64, 640, 5000):
        media = encode_bytes(r.bytes(n))
        fast, slow = decode(media), decode(media, slow=True)
        assert all((a["coef"] == b["coef"]).all() for a, b in zip(fast.parts, slow.parts, strict=True)) and rgb(fast).shape == (slow.height, slow.width, 3)


def test_encoding_equals_best_paths_and_decodes(documents, spark):
    vocabulary = sp.Vocabulary.load()
    got = sp.decode(sp.encode(documents)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(r.doc_id), r.text or "") for r in documents.collect())
    for r in got:
        assert list(r.ids) == [i for w in sp.words_of(r.text) for i in sp.best_path(w, vocabulary)]
    assert sp.encode(documents.limit(0)).collect() == []


def test_schedule_stays_within_a_block():
    for weights in ({"a": 5, "b": 3, "c": 1, "d": 1}, {"a": 1}, {f"s{i}": i + 1 for i in range(40)}):
        slots = quantised(weights, 200)
        assert sum(slots.values()) == 200 and min(slots.values()) > 0
        done, order = dict.fromkeys(slots, 0), {t: k for k, ts in schedule(slots).items() for t in ts}
        for t in range(200):
            done[order[t]] += 1
            assert all(abs(done[k] - slots[k] * (t + 1) / 200) < 1 for k in slots)


def test_mixture_stays_within_a_block_of_exact_weights(spark):
    weights = [0.26931, 0.0001, 0.33059, 0.4]
    total, done = sum(map(Fraction, weights)), [0] * 4
    for t, (slot, i, j) in enumerate(itertools.islice(deal([(w, 10**9) for w in weights]), 60_000)):
        assert (slot, j) == (t, done[i])
        done[i] += 1
        assert all(abs(n - Fraction(w) / total * (t + 1)) < 1 for n, w in zip(done, weights, strict=True))
    assert [x[1] for x in deal([(0.0, 2), (1.0, 3)])] == [1, 1, 1, 0, 0]
    # through Spark: many periods of the old schedule, one document a block
    docs = spark.range(8000).selectExpr("id as doc_id", "case when id < 2155 then 'a' when id < 2156 then 'b' when id < 4800 then 'c' else 'd' end as source")
    order = [r.mix_lane for r in sorted(mix_sources(docs, dict(zip("abcd", weights, strict=True)), block_docs=1).collect(), key=lambda r: r.mix_slot)][:7900]
    seen = dict.fromkeys("abcd", 0)
    for t, k in enumerate(order):
        seen[k] += 1
        assert all(abs(seen[k] - w * (t + 1)) < 1.001 for k, w in zip("acd", (weights[0], *weights[2:]), strict=True))


def test_every_one_of_many_sources_has_its_own_deadlines(spark):
    sizes = {f"s{i}": 1 + i % 7 for i in range(1200)} | {"*": 9, "big": 700}
    docs = spark.createDataFrame([(i, k) for i, k in enumerate(k for k, n in sizes.items() for _ in range(n))], "doc_id long, source string")
    total = sum(Fraction(n**0.7) for n in sizes.values())
    got = mix_sources(docs, block_docs=1).collect()
    assert {r.mix_lane for r in got} == set(sizes) and len({r.mix_slot for r in got}) == len(got) == docs.count()
    for r in got:
        w = Fraction(sizes[r.mix_lane] ** 0.7) / total
        assert r.mix_block // w <= r.mix_slot < -(-(r.mix_block + 1) // w)
    assert {r.mix_lane for r in mix_sources(docs, {"big": 2.0}, block_docs=1).collect()} == {"big", "*"}


def test_mixing_places_every_row(documents):
    got = mix_sources(documents, block_docs=4, period=50).collect()
    assert len(got) == documents.count() and set(got[0].asDict()) == {*documents.columns, "mix_lane", "mix_position", "mix_block", "mix_slot"}
    lanes = {}
    for r in got:
        lanes.setdefault(r.mix_lane, []).append(r)
    assert set(lanes) == {"hot", "cold", ""}
    for own in lanes.values():
        assert sorted(r.mix_position for r in own) == list(range(len(own)))
        assert all(a.mix_slot < b.mix_slot for a in own for b in own if a.mix_block < b.mix_block)
    assert len({(r.mix_lane, r.mix_slot) for r in got}) == len({r.mix_slot for r in got})
    assert {r.mix_lane for r in mix_sources(documents, {"hot": 2.0}).collect()} == {"hot", "*"}
    assert mix_sources(documents.limit(0)).collect() == []


def test_language_id(documents, spark, tables):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language_id.identify_languages(docs).collect()}
    held = [(r.lang, got[r.doc_id]) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(a == b.lang_pred for a, b in held) >= 0.95 * len(held) and all(b.held_out and 0 <= b.score <= 1 for _, b in held)
    odd = language_id.identify_languages(documents).collect()
    assert len(odd) == documents.count()
    empty = {r.doc_id for r in documents.collect() if not any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == empty and all(r.score == 0 for r in odd if r.lang_pred == "und")
    assert language_id.identify_languages(documents.limit(0)).collect() == []


def test_quality(documents, spark, tables):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.classify_quality(docs, labels).collect()}
    held = [(r.quality, got[r.doc_id]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(bool(a) == b.keep for a, b in held) >= 0.93 * len(held)
    odd = quality.score(documents, quality.fit(docs, labels)).collect()
    assert len(odd) == documents.count() and all(not r.keep and r.quality_score == 0 for r in odd if not (r.text or "").strip())
    assert all(r.keep for r in quality.classify_quality(documents.where("doc_id < 10"), labels.limit(0)).collect())
    with pytest.raises(AttributeError):
        _ = odd[0].nothing


def test_long_units_go_in_windows(spark, monkeypatch):
    import random

    r, vocabulary = random.Random(4), sp.Vocabulary.load()
    texts = ["=" * n for n in (511, 512, 513, 700, 5000)] + ["".join(r.choice("abethn=-") for _ in range(n)) for n in (600, 3000)] + ["a\0b\0\0 c\0 \x01\x00" + "\0" * 600, "\0", "\n", "日" * 900, "x" * 1500 + " y" + "=" * 1200]
    monkeypatch.setattr(sp, "WINDOW", 64)
    docs = spark.createDataFrame(list(enumerate(texts)) + [(99, texts[4]), (4, texts[4])], "doc_id long, text string")
    for r in sp.decode(sp.encode(docs)).collect():
        text = texts[4 if r.doc_id == 99 else r.doc_id]
        assert r.text == text
        assert list(r.ids) == [i for w in sp.words_of(text) for i in sp.best_path(w, vocabulary)]


def test_words_in_lists_are_the_words(monkeypatch):
    monkeypatch.setattr(sp, "LIST_CHARS", 5)
    for text in (None, "", "ab cd  ef\n\n gh   ", "x" * 40, "a b\nc d e f g\n\n\n  h", " ", "\n"):
        words = sp.Words()
        assert [words.names[i] for i in words.numbers(text)] == sp.words_of(text) and len(set(words.names)) == len(words.names)


def test_no_piece_stands_across_units():
    vocabulary = sp.Vocabulary.load()
    words = [" wordings", "übermäßig", " the", "a", "日本語", " ==", "zzqx", " internationalisation", "ab"]
    units, sizes = vocabulary.joints.cut(words)
    at = 0
    for w, n in zip(words, sizes.tolist(), strict=True):
        own = units[at : at + n]
        at += n
        assert "".join(own) == w
        ends = {sum(map(len, own[:i])) for i in range(1, n)}
        assert not any(i < e < i + len(p) for p, _, _ in vocabulary.useful for i in range(len(w)) if w.startswith(p, i) for e in ends)
        assert own == vocabulary.joints.cut([w])[0]
    assert at == len(units)


def test_decoding_reads_odd_ids(spark):
    rows = spark.createDataFrame([(None,), ([],), ([10**6, None, -5],)], "ids array<int>")
    assert [r.text for r in sp.decode(rows).collect()] == [None, "", ""]
