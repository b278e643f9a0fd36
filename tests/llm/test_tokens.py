"""Token counts, BPE codec and packing against the libraries that own the files."""

import hashlib
import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomtext.llm import bpe, packing, word_bpe
from loomtext.llm.bpe import LONG_WORD, PairTable
from loomtext.llm.token_count import PieceCounter, count_tokens

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
LETTERS = list(" ▁\nabthe.,é\t中😀\x00\r<s>0123'") + ["  ", "ΑΣ", "İ", "\x1c", "\x85", "\xa0", "​", "　", "<|endoftext|>", "<|", "'re", "Ⅷ", "²", "é", "ﬁ"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    odd = ["".join(r.choice(LETTERS) for _ in range(r.randrange(40))) for _ in range(3000)]
    return [*odd, "", " ", "   ", "a" * 3000, " " * 500 + "x", "\n\n", "a\n", "\na", "x\n y", "<s></s><unk><0x0A>", "ab" * (LONG_WORD + 1), "don't 's", "".join(r.choice("etaoin") for _ in range(20_000)), "lorem" * 400]


def test_counts_equal_the_library(texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counter = PieceCounter(PIECES)
    assert counter.count_batch(texts) == [len(x) for x in library.encode(texts, num_threads=1)]
    assert counter.whole and all(len(library.encode(p.lstrip("▁"))) == 1 for p in list(counter.whole)[300:400] if p[0] == "▁" and p.strip("▁"))


def test_count_rows(spark):
    rows = spark.createDataFrame([(1, "the cat", 9), (None, None, 1), (1, "the cat", 9), (3, "", 0)], "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens > 0, r.over_limit) for r in count_tokens(rows, PIECES).collect())
    assert got == [(0, 0, False, False), (1, 7, True, False), (1, 7, True, False), (3, 0, False, False)]
    assert count_tokens(rows.limit(0), PIECES).count() == 0
    assert count_tokens(rows.where("text = 'the cat'"), PIECES, limit=1).first().over_limit


def test_codec_equals_the_library(texts):
    library = Tokenizer.from_file(WORDS)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    own = word_bpe.WordCodec(WORDS, word_bpe.packed)
    assert [array("I", b"".join(c)).tolist() for c in own.encode_chunks(texts)] == want
    assert [own.decode(ids) for ids in want] == [library.decode(ids, skip_special_tokens=False) for ids in want]


def test_codec_rows(spark):
    rows = spark.createDataFrame([(1, "The cat's <|endoftext|> 42"), (2, None), (None, "")], "doc_id long, text string")
    library = Tokenizer.from_file(WORDS)
    for r in word_bpe.encode_decode(rows, WORDS, keep_ids=True).collect():
        ids = library.encode({1: "The cat's <|endoftext|> 42"}.get(r.doc_id, ""), add_special_tokens=False).ids
        assert (r.n_tokens, r.ids) == (len(ids), ids) and r.decoded == library.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def merged_one_by_one(rules, word):
    """The definition: the lowest rank first, of equal ranks the leftmost."""
    word = list(word)
    while found := [(rules[p][0], i) for i, p in enumerate(zip(word, word[1:])) if p in rules]:
        i = min(found)[1]
        word[i : i + 2] = [rules[tuple(word[i : i + 2])][1]]
    return word


@pytest.mark.parametrize("longest", [200, 8, 0])
def test_rounds_equal_single_merges(monkeypatch, longest):
    """Short words by their own lowest pairs, long ones rank by rank; also where ranks tie or overtake those of their parts."""
    monkeypatch.setattr(bpe, "LONG_WORD", longest)
    monkeypatch.setattr(bpe, "_AT_ONCE", 5)
    for seed in range(40):
        r = random.Random(seed)
        if seed % 2:
            pairs = [(a, b, rank, 100 + rank) for rank, (a, b) in enumerate({(r.randrange(5), r.randrange(5)) for _ in range(14)})]
            pairs += [(100 + r.randrange(len(pairs)), r.randrange(5), 1000 + k, 500 + k) for k in range(30)]
        else:
            parts = [*range(5), 10, 11, 12, 13]
            pairs = [(r.choice(parts), r.choice(parts), q, 10 + q // 2) for q in (r.randrange(8) for _ in range(30))]
        table = {(a, b): (a, b, c, d) for a, b, c, d in pairs}
        words = [[r.randrange(5) for _ in range(r.randrange(40))] for _ in range(40)]
        flat, lens = PairTable(list(table.values())).merge([s for w in words for s in w], [len(w) for w in words])
        at = 0
        for word, n in zip(words, lens.tolist()):
            assert flat[at : at + n].tolist() == merged_one_by_one({k: v[2:] for k, v in table.items()}, word)
            at += n


def test_best_fit_is_bounded_and_complete():
    r = random.Random(5)
    packer, items = packing.BestFit(100, 4), [r.randrange(1, 101) for _ in range(500)]
    closed = []
    for k, n in enumerate(items):
        closed += packer.add(n, k)
        assert packer.open == sum(map(len, packer.by_free.values())) <= 4
    placed = closed + packer.rest()
    assert sorted(k for b in placed for k, _ in b) == list(range(500))
    for b in placed:
        at = 0
        for k, offset in b:
            assert offset == at
            at += items[k]
        assert at <= 100


def test_packing_rows(spark):
    texts = ["word " * n for n in (1, 3, 9, 30, 31, 90, 7, 0)] + [None]
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(2, texts[2], "x"), (None, "a b", "x")], "doc_id long, text string, length string")
    got = packing.pack_documents(rows, WORDS, size=32, places=2).collect()
    library, bins = Tokenizer.from_file(WORDS), defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        if r.doc_id is not None:
            ids = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1][r.start : r.start + r.length]
            assert len(ids) == r.length and r.ids_crc32 == zlib.crc32(array("I", ids).tobytes()) and r.start == 32 * r.piece
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 32
    assert sum(r.length for r in got) == sum(len((t or "").split()) + 1 for t in [*texts, texts[2], "a b"])
    assert packing.pack_documents(rows.limit(0), WORDS).count() == 0


def test_every_part_of_a_batch_is_packed(spark):
    """One Arrow batch that is encoded in many runs: no row is lost, none takes another's id."""
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("aeinrst") for _ in range(r.randrange(1, 9))) for _ in range(r.choice([5, 50, 20_000]))) for _ in range(60)]
    assert sum(map(len, texts)) > 4 * 500_000
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got, library = defaultdict(dict), Tokenizer.from_file(WORDS)
    for x in packing.pack_documents(rows, WORDS, size=1024).collect():
        got[x.doc_id][x.start] = (x.piece, x.length, x.ids_crc32)
    assert sorted(got) == list(range(len(texts)))
    for k, text in enumerate(texts):
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        cut = {at: ids[at : at + 1024] for at in range(0, len(ids), 1024)}
        assert got[k] == {at: (at // 1024, len(c), zlib.crc32(array("I", c).tobytes())) for at, c in cut.items()}


def test_sequences_hold_the_ids(spark):
    rows = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    pieces = packing.cut_pieces(rows, WORDS, 4096, 1, keep_ids=True)
    ids = packing.sequences(packing.pack_documents(rows, WORDS), pieces).first().ids
    library = Tokenizer.from_file(WORDS)
    one, two = ([*library.encode(t, add_special_tokens=False).ids, 1] for t in ("one two", "three"))
    assert ids in (one + two, two + one)
