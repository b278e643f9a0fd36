"""Preference pairs against SQL, the pipeline against its stages in plain Python, the entry module."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from loomtext.llm import preferences, registry
from loomtext.llm.preferences import answers_swapped, format_preferences


def test_preferences(spark):
    schema = "pair_id long, turn long, role string, text string"
    chosen = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "so?"), (2, 0, "user", "a"), (None, 0, None, None)], schema)
    rejected = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 1, "assistant", "no"), (2, 0, "user", "a")], schema)
    got = {r.pair_id: r for r in format_preferences(chosen, rejected).collect()}
    assert len(got) == 3 and all(r.segment == 0 for r in got.values())
    assert got[1].prompt == "<|user|>\nhi<|end|>\n" and got[1].rejected == "<|assistant|>\nno<|end|>\n"
    assert got[1].chosen == "<|assistant|>\nyes<|end|>\n<|user|>\nso?<|end|>\n"

    def learned(text, loss):
        return [text[int(a) : int(b)] for a, b in (x.split(":") for x in loss.split(",") if x)]

    assert learned(got[1].chosen, got[1].chosen_loss) == ["yes<|end|>"] and learned(got[1].rejected, got[1].rejected_loss) == ["no<|end|>"]
    assert (got[2].prompt, got[2].chosen, got[2].rejected) == ("<|user|>\na<|end|>\n", "", "") and got[None].chosen == "<||>\n<|end|>\n"
    assert format_preferences(chosen.limit(0), rejected.limit(0)).count() == 0


def test_long_conversations_go_on_in_rows(spark):
    schema = "pair_id long, turn long, role string, text string"
    turns = [(1, k, ("user", "assistant")[k % 2], f"t{k}") for k in range(25)] + [(2, 0, "assistant", "x")]
    chosen, rejected = spark.createDataFrame(turns, schema), spark.createDataFrame([t for t in turns if t[1] < 11 or t[1] % 3], schema)
    got = {(r.pair_id, r.segment): r for r in format_preferences(chosen, rejected, turns=4).collect()}
    for part, want in (("prompt", turns[:12]), ("chosen", turns[12:25]), ("rejected", [t for t in turns[12:25] if t[1] % 3])):
        texts = [getattr(got[1, k], part) for k in range(4)]
        assert [t.count("<|end|>") for t in texts] == [len(want[4 * k : 4 * k + 4]) for k in range(4)]
        assert "".join(texts) == "".join(f"<|{r}|>\n{t}<|end|>\n" for _, _, r, t in want)
    assert len(got) == 5 and got[2, 0].prompt


@pytest.mark.parametrize("rows", [[], [(1, 0, "user", "x")], [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (5, 0, "assistant", "a"), (None, 0, "assistant", "b"), (7, None, "user", None), (7, 2, "assistant", "z")]])
def test_swapped_answers_equal_sql(spark, rows):
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    mine = sorted(map(tuple, format_preferences(*answers_swapped(conversations)).collect()), key=repr)
    con = duckdb.connect()
    con.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    if rows:
        con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert mine == sorted(con.sql(preferences.SQL).fetchall(), key=repr)


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    texts, ids = {r.doc_id: r.text for r in docs.collect()}, set()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns
        rows = after.collect()
        before, ids = ids or set(texts), {r.doc_id for r in rows}
        assert len(rows) == len(ids) and ids <= before and ids
        if name != "privacy":
            assert all(r.text == texts[r.doc_id] for r in rows)
        else:
            assert all(r.n_chars == len(r.text) for r in rows) and not any("@mail" in r.text for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == ids


def test_registered():
    names = entry.queries()
    assert set(registry.queries()) <= set(names) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
