"""Helpers: running totals, running values in arrays, components, tokens."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailscope.llm import scratch, tokens
from mailscope.llm.components import components
from mailscope.llm.prefix import hashed_shifts, total_before
from mailscope.llm.scan import running


@pytest.mark.parametrize("shifts", [(2, 5, 9), (10, 20, 32, 48), hashed_shifts(10_000, 12)])
def test_total_before(spark, shifts):
    pick = random.Random(1)
    rows = [(g, pick.randint(-3000, 3000), pick.randint(0, 9)) for g in (1, 2) for _ in range(300)] + [(3, 7, 1), (3, 7, 1)]
    df = spark.createDataFrame(rows, "g long, k long, v long")
    got = sorted(tuple(r) for r in total_before(df, "v", "k", "before", ["g"], ["v"], shifts).collect())
    want, sums = [], {}
    for g, k, v in sorted(rows):
        want.append((g, k, v, sums.get(g, 0)))
        sums[g] = sums.get(g, 0) + v
    assert got == sorted(want)


def test_running(spark):
    values = [[], [5], list(range(2500)), [3, -1, 4]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v array<int>")
    got = dict(df.select("i", running(F.col("v"), lambda a, b: a + b)).collect())
    assert all(got[i] == np.cumsum(v).tolist() for i, v in enumerate(values))
    top = dict(df.select("i", running(F.col("v"), lambda a, b: F.greatest(a, b))).collect())
    assert top[3] == [3, 3, 4]


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, i) for i in range(1001, 1200)]
    pick = random.Random(2)
    mixed = [(pick.randint(2000, 2200), pick.randint(2000, 2200)) for _ in range(90)]
    edges = chain + star + mixed + [(5, 5), (0, 1)]
    pick.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {n: n for e in edges for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    assert got == {n: find(n) for n in parent if find(n) != n}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_whole_texts(monkeypatch, name):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.tokenizer_path(name))
    pick = random.Random(3)
    texts = ["a <|endoftext|> b", "<|EndOfText|>", "<|startoftext|><|endoftext|>\n\tx  ", "<|endoftext|", " <|endoftext|>"]
    texts += ["", " ", "a\nb", "It's.\nThe end", "<|endoftext|> x", "A  B", "x y z", "word " * 400, "l'été, où! ça?"]
    texts += ["".join(pick.choice("abZé' \n\t!1.,́") for _ in range(pick.randint(0, 16))) for _ in range(1500)]
    monkeypatch.setattr(tokens, "TOGETHER", 500)
    got = list(tokens.Encoder(name, remembered=50).batch([*texts, None], 1))
    assert [g.tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids + [1] for t in [*texts, ""]]


@pytest.mark.parametrize(("master", "fine"), [("local", True), ("local[8]", True), ("local[2,3]", True), ("local-cluster[2,1,1024]", False), ("yarn", False)])
def test_no_local_folder_on_a_cluster(master, fine):
    class Session:
        class conf:
            values: dict = {}
            get = classmethod(lambda cls, key, default=None: cls.values.get(key, default))
            set = classmethod(lambda cls, key, value: cls.values.update({key: value}))

        class sparkContext:
            getConf = staticmethod(dict)

    Session.conf.values, Session.sparkContext.master = {}, master
    if fine:
        assert scratch.scratch_dir(Session) == scratch.scratch_dir(Session)
    else:
        with pytest.raises(RuntimeError):
            scratch.scratch_dir(Session)
        Session.conf.values = {"spark.checkpoint.dir": "hdfs://shared/"}
        assert scratch.scratch_dir(Session) == "hdfs://shared"
