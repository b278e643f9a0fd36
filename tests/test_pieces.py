"""Unknown pieces of tokenizer files: offsets, characters lost, and nothing claimed where nothing is measured."""

import json

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from loomtext.functions import text as X
from loomtext.functions.pieces import lost_report, merged, piece_counts


@pytest.fixture
def words_file(tmp_path):
    """A word list with an unknown piece; nothing is trained."""
    own = Tokenizer(models.WordLevel({"[UNK]": 0, "the": 1, "cat": 2, "fen": 3}, unk_token="[UNK]"))
    own.pre_tokenizer = pre_tokenizers.Whitespace()
    own.enable_truncation(3)
    own.enable_padding(length=9, pad_token="[UNK]")
    own.save(str(tmp_path / "words.json"))
    return str(tmp_path / "words.json")


def test_merged():
    assert merged([(3, 5), (0, 1), (5, 7), (4, 4), (6, 9), (20, 21)]) == [(0, 1), (3, 9), (20, 21)] and merged([]) == []


def test_spans_and_characters_lost(spark, words_file):
    texts = ["the cat", "the ފެން😀 cat dog", "", None, "dog-cat the the the", "x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r.k: r.p for r in rows.select("k", piece_counts(words_file)(F.col("t")).alias("p")).collect()}
    assert (got[0].tokens, got[0].unknown, got[0].lost, got[0].spans) == (2, 0, 0, []) and got[3] is None and got[2].tokens == 0
    swallowed = ["".join(texts[k][s.start : s.end] for s in got[k].spans) for k in (1, 4, 5)]
    assert swallowed == ["ފެން😀dog", "dog-", "x"] and [got[k].lost for k in (1, 4, 5)] == [8, 4, 1]
    assert got[4].tokens == 6  # truncation and padding in the file don't count


def test_report(spark, words_file):
    rows = spark.createDataFrame([("latin", "the cat"), ("latin", "the dog"), ("thaana", "ފެން"), ("thaana", None), ("none", "")], "script string, t string")
    got = {r.script: r for r in lost_report(rows, "script", "t", piece_counts(words_file)).collect()}
    assert (got["latin"].sentences, got["latin"].tokens, got["latin"].unknown_sentences, got["latin"].unknown_share) == (2, 4, 50.0, 25.0)
    assert got["latin"].lost_percent == round(100 * (3 / 7) / 2, 3) and got["thaana"].lost_percent == 100.0 == got["thaana"].unknown_share
    assert got["none"].unknown_share is None and got["none"].lost_percent == 0.0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_real_files(spark, name):
    """By script, from the files themselves: unmeasured without an unknown piece, else what the library says."""
    file = public_tokenizers.path(name)
    texts = [("latin", "Mi ulhey aharen!"), ("thaana", "ދިވެހި ބަސް"), ("both", "ފެން fen"), ("latin", "")]
    got = {r.script: r for r in lost_report(spark.createDataFrame(texts, "script string, t string"), "script", "t", piece_counts(file)).collect()}
    library = Tokenizer.from_file(file)
    for script in got:
        assert got[script].tokens == sum(len(library.encode(t, add_special_tokens=False).ids) for s, t in texts if s == script)
    unknown = json.loads(library.to_str())["model"].get("unk_token")
    assert all((g.lost_percent is None) == (unknown is None) for g in got.values())


def test_tokenizer_as_counter(spark, words_file):
    X.TOKEN_COUNTERS["words_file"] = lambda t: piece_counts(words_file)(t)["tokens"]
    try:
        rows = spark.createDataFrame([("the cat",), ("the cat fen dog",)], "t string")
        assert [r[0] for r in rows.select(X.over_max_tokens([F.col("t")], 3, "words_file")).collect()] == [None, "over_max_tokens"]
    finally:
        del X.TOKEN_COUNTERS["words_file"]
