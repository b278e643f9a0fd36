"""run() against a plain-Python pipeline on a small corpus with planted junk, toxic documents, copies and personal data."""

import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest
from test_disclosing import by_brute_force
from tokenizers import Tokenizer

import corpus_pipeline

VOCABULARY_SIZE = 1200


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


@pytest.fixture(scope="module")
def planted():
    """(rows, labels, junk ids, toxic ids)."""
    r = random.Random(17)
    vocabulary = ["".join(r.choice("abdeilmnorstu") for _ in range(r.randrange(3, 9))) for _ in range(VOCABULARY_SIZE)]

    def prose(n):
        return "\n".join(" ".join(r.choice(vocabulary) for _ in range(11)).capitalize() + "." for _ in range(n))

    texts = {k: prose(r.randrange(8, 30)) for k in range(150)}
    junk, toxic = set(range(0, 20)), set(range(20, 56))
    for k in junk:
        texts[k] = [" ".join(w + "***" for w in texts[k].split()), " ".join(w.upper() + "!!" for w in texts[k].split()), texts[k].replace(" ", " | "), "\n".join([prose(1)] * 12)][k % 4]
    for k in toxic:
        words = texts[k].split(" ")
        for _ in range(10):
            words.insert(r.randrange(len(words)), r.choice(["vilscum", "rottenfilth", "worthlesspig"]))
        texts[k] = " ".join(words)
    for k in range(60, 72):  # copies, exact, of other case, edited a little, edited much
        words = texts[k - 2].split(" ") if k % 4 else []
        base = texts[56].split(" ")
        texts[k] = texts[57] if k % 4 == 0 else texts[58].upper().lower() if k % 4 == 1 else " ".join([*base[:30], "edited", *base[31:]]) if k % 4 == 2 else " ".join(w if i % 3 else "changed" for i, w in enumerate(words))
    for k in range(80, 95):
        lines = texts[k].split("\n")
        at = r.randrange(len(lines))
        lines[at] = f"{lines[at]} zelmira{k % 4} once{k} {[f'ann{k}@corp.example', '10.2.3.4', '+1 (743) 555-3824', '4111 1111 1111 1111'][k % 4]} and on"
        texts[k] = "\n".join(lines)
    texts[96] = " ".join(r.choice(vocabulary) for _ in range(6000)).replace(" i", "\ni")  # longer than a sequence
    texts[97], texts[98] = None, ""
    labels = [(k, 0 if k in junk else 1, int(k in toxic)) for k in texts if texts[k]] + [(None, 1, 1), (5000, 0, 0)]
    return [(k, t, "xx", f"src{k % 3}", len(t or "")) for k, t in texts.items()], labels, junk, toxic


def plain_pipeline(rows, junk, toxic):
    """doc_id, piece, start, length, crc32 of what is left."""
    texts = {k: t for k, t, *_ in rows if k not in junk | toxic and t}
    ids, root = sorted(texts), {}
    root = {k: k for k in ids}
    sets = {k: shingles(texts[k]) for k in ids}
    for i in ids:
        for j in ids:
            if j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    kept = sorted(set(root.values()))
    assert len(kept) < len(ids)
    spans = by_brute_force([texts[k] for k in kept])
    library, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), set()
    for n, k in enumerate(kept):
        text, clean, at = texts[k], "", 0
        for kind, a, b in spans[n]:
            if a >= at:
                clean += text[at:a] + ("" if kind == "removed" else f"[{kind.upper()}]")
            at = max(at, b)
        tokens = [*library.encode(clean + text[at:], add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(tokens), 4096)):
            own = tokens[start : start + 4096]
            out.add((k, piece, start, len(own), zlib.crc32(array("I", own).tobytes())))
    return out, any(kind in ("term", "removed") for s in spans.values() for kind, _, _ in s)


def test_run_equals_the_plain_pipeline(spark, planted, tmp_path):
    rows, labels, junk, toxic = planted
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want, terms = plain_pipeline(rows, junk, toxic)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert terms and {r.doc_id for r in got} == {w[0] for w in want}
    assert len(got) == len(want) and {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096


def test_stages_on_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int, __own_id string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, str(tmp_path))
        assert made.columns == docs.columns and made.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, planted, tmp_path):
    """Nulls in any column, repeated rows and ids, clashing names: no row is lost that a stage doesn't judge, none comes twice."""
    rows, labels, _, _ = planted
    good = [r for r in rows if 100 <= r[0] < 130]
    odd = [(*r, "x", 1) for r in good] + [(None, good[0][1] + " more of it", None, None, None, None, None), (good[1][0], good[2][1] + " other", "xx", None, 3, None, 2), (*good[3], "x", 1)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars int, __own_hash string, score int")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, str(tmp_path))
        assert made.columns == docs.columns
        sizes.append(made.count())
    assert sizes == [33, 33, 30, 33]  # near copies: a repeated row and two that only end in other words go
