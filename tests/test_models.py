"""A small deterministic model, loaded on workers: through traces, with refusals and errors as rows."""

import os
import sys
import uuid
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomtext.functions.model import model_translator
from loomtext.plans.trace import trace_documents, trace_sentences

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests


class Reversing:
    """Words behind the task's prefix in reverse order; some inputs fail, alone or with their batch."""

    def count(self, text):
        if "uncountable" in text:
            raise KeyError("no such piece")
        return len(text.split())

    def translate(self, texts):
        if any("fails" in t for t in texts):
            raise RuntimeError("cannot translate")
        return [" ".join(t.rpartition(": ")[2].split()[::-1]) + " " for t in texts]


def loader(folder):
    def load():
        with open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w"):
            return Reversing()

    return load


def asked(spark, translator, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(3, "i")
    return {r.i: (r.x.status, r.x.text, r.x.error) for r in rows.select("i", translator(F.col("t")).alias("x")).collect()}


def test_answers_refusals_and_errors(spark, tmp_path):
    texts = ["task: one two", "task: ", None, "x " * 128, "x " * 129, "it fails here", "uncountable", "a b"]
    got = asked(spark, model_translator(loader(tmp_path)), texts)
    assert got[0] == ("ready", "two one", None) and got[1] == ("ready", "", None) and got[2] == ("not_loaded", None, None) and got[7] == ("ready", "b a", None)
    assert got[3][0] == "ready" and len(got[3][1].split()) == 128
    assert got[4][:2] == ("error", None) and got[4][2].startswith("129 tokens, over the limit of 128")
    assert got[5] == ("error", None, "cannot translate") and got[6] == ("error", None, "'no such piece'")
    assert asked(spark, model_translator(loader(tmp_path), limit=2), ["a b", "a b c"])[1][0] == "error"


def test_loaded_once_in_a_worker(spark, tmp_path):
    translator = model_translator(loader(tmp_path))
    for _ in range(3):
        assert len(asked(spark, translator, [f"a b{k}" for k in range(300)])) == 300
    loads = Counter(name.split("-")[0] for name in os.listdir(tmp_path))
    assert loads and set(loads.values()) == {1}


def test_a_loader_that_fails_is_tried_again(spark, tmp_path):
    flag = tmp_path / "there"

    def load():
        if not flag.exists():
            raise OSError("no weights")
        return Reversing()

    translator = model_translator(load)
    assert asked(spark, translator, ["a b", None]) == {0: ("error", None, "no weights"), 1: ("not_loaded", None, None)}
    flag.touch()
    assert asked(spark, translator, ["a b"]) == {0: ("ready", "b a", None)}


@pytest.mark.parametrize(("direction", "text"), [("en-dv", "Go on. It fails. Dr. Who came."), ("dv-en", "ފެން ބޯން. ބަސް.")])
def test_through_traces(spark, tmp_path, direction, text):
    docs = spark.createDataFrame([(1, text), (2, text.replace("It fails. ", "")), (3, None)], "doc_id long, text string")
    translator = model_translator(loader(tmp_path))
    rows = trace_sentences(docs, "doc_id", direction, translator).orderBy("doc_id", "place").collect()
    assert all(not any("ހ" <= c <= "޿" for c in r.model_input) for r in rows)
    assert Counter(r.status for r in rows) == Counter({"ready": len(rows) - (direction == "en-dv"), **({"error": 1} if direction == "en-dv" else {})})
    got = {r.doc_id: r for r in trace_documents(docs, "doc_id", direction, translator).collect()}
    assert got[2].available and not got[3].available and got[1].available == (direction == "dv-en")
    if direction == "dv-en":
        assert got[1].output == "boan. fen bas."
