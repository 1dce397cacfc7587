import unicodedata
import zlib

import numpy as np
import public_tokenizers
from helpers import documents, rng, sentence
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import packing


def expected_pieces(ids, texts, capacity):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for i, text in zip(ids, texts):
        tokens = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(tokens), capacity):
            part = np.array(tokens[k : k + capacity], dtype="<u4")
            out.append((i, k // capacity, k, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=repr)


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_are_those_of_whole_texts(spark):
    r = rng()
    texts = [
        "Hello, World. It's 12.5 o'clock!!, \"so\" say we... A.B. c,d e.\n\nLast.", None, "", "   ",
        "<|endoftext|> is special, <|ENDOFTEXT|> too.", "É, Ünïcode. ꙮ — “quotes”. x y z.",
        "é. ñ, İstanbul. ΣΑΣ. ﬁn. don't. we'll.", sentence(r, 9000), "same. text,",
        "same. text,", "a" * 5000, "1,2 3.4. 5,", "tab\tand\x0bvt. \x1c x.\x1f y",
    ]
    ids = [*range(10), 9, None, 12]
    out = packing.pack(documents(spark, texts, ids), capacity=64).collect()
    got = sorted(
        ((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out), key=repr)
    assert got == expected_pieces(ids, texts, 64)
    check_places(out, 64)


def test_capitals_with_combining_marks(spark):
    texts = [
        "J\u030c", "T\u0308 H\u0331 W\u030a", "A J\u0591\u030cA. Next, J\u030ca, E\u0301.", "AJ\u030c plain",
        "j\u030c J\u030c, J\u030c. \u030cJ J \u030c", "Plain AND Loud.",
    ]
    out = packing.pack(documents(spark, texts), capacity=64).collect()
    got = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out)
    assert got == expected_pieces(range(len(texts)), texts, 64)


def test_marks_that_compose_with_capitals():
    composed = (unicodedata.normalize("NFD", chr(c)) for c in range(128, 0x30000))
    after = {d[1] for d in composed if len(d) > 1 and d[0].isascii()}
    assert after and all(packing._MARK.match(c.encode()) for c in after)


def test_words_are_encoded_once_whatever_stands_around_them():
    tokens = packing.tokenizer_at(None)
    tokens._forget()
    list(tokens([b"(word) word### $word! Word, ``word'' word's", "été. Été... «été».".encode()]))
    assert sum(b"word" in chunk for chunk in tokens.known) == 1
    assert b"'s" in tokens.known and "été".encode() in tokens.known


def test_each_character_around_and_inside_words():
    plain, tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), (
        packing.tokenizer_at(None))
    chars = [chr(c) for c in [*range(1, 0x600), *range(0x1E00, 0x2200), *range(0x3000, 0x3100)]]
    texts = [f"a{c}.x {c}'s.{c},b 'S{c}#{c} A{c}" for c in chars]
    wanted = plain.encode_batch_fast(texts, add_special_tokens=False)
    for text, w, got in zip(texts, wanted, tokens([t.encode() for t in texts])):
        assert np.frombuffer(got, "<u4").tolist() == w.ids, text


def test_groups_of_texts_keep_their_order(monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BYTES", 10)
    monkeypatch.setattr(packing, "CACHED_CHUNKS", 3)
    plain, tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), (
        packing.tokenizer_at(None))
    texts = ["one two", None, "three <|endoftext|>", "", "four. five six seven", " ", "one", "two."]
    wanted = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    made = tokens([None if t is None else t.encode() for t in texts])
    assert [np.frombuffer(got, "<u4").tolist() for got in made] == wanted


def test_kept_ids_make_the_sequences(spark):
    texts = ["one two three.", "four five", "", "six"]
    packed = packing.pack(documents(spark, texts), capacity=8, keep_ids=True)
    for s in packing.sequences(packed).collect():
        assert len(s["ids_hex"]) == 8 * s["length"]
        assert [p["offset"] for p in s["parts"]] == sorted(p["offset"] for p in s["parts"])


def test_empty_table(spark):
    assert packing.pack(documents(spark, [])).collect() == []


def first_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        k = next((k for k, g in enumerate(gaps) if g >= n), None)
        if k is None:
            gaps.append(capacity - n)
        else:
            gaps[k] -= n
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=120))
def test_placements_are_gapless_and_few(lengths):
    counts = {}
    for n in lengths:
        counts[n] = counts.get(n, 0) + 1
    runs, sequences = packing.pack_lengths(counts, 60)
    bins = {}
    for length, a, b, base, each, offset in runs.tolist():
        counts[length] -= b - a
        for rank in range(b - a):
            bins.setdefault(base + rank // each, []).append((offset + rank % each * length, length))
    assert not any(counts.values()) and len(bins) == sequences
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 60
        assert sum(3 * n > 60 for _, n in parts) <= 2
    fewest = first_fit_decreasing(lengths, 60)
    assert sequences <= fewest + max(1, fewest // 10)
