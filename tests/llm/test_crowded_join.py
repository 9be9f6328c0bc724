"""Sets that are common passages but for a few words: against brute force, and growth in proportion."""

import random

import pytest

from quillmill.llm import ngram_join

from .test_operators import brute_groups

SCHEMA = "doc_id long, text string"


def crowded(rnd, n, n_passages, words, own, edits):
    """Documents of some passages, each with a few words of its own before and after, and a few words changed."""
    passages = [[f"p{k}.{i}" for i in range(words)] for k in range(n_passages)]
    rows = []
    for d in range(n):
        w = [x for p in rnd.sample(passages, min(len(passages), rnd.choice([1, 1, 2]))) for x in p]
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10)}"
        rows.append((d, " ".join([f"a{rnd.random()}" for _ in range(rnd.randint(0, own))] + w + [f"z{rnd.random()}" for _ in range(rnd.randint(0, own))])))
    return rows


@pytest.mark.parametrize("seed, passages, words, own, edits, block", [(1, 1, 60, 8, 0, 1024), (2, 4, 50, 7, 1, 5), (3, 3, 30, 5, 2, 4)])
def test_crowded_sets(spark, monkeypatch, seed, passages, words, own, edits, block):
    monkeypatch.setattr(ngram_join, "COMMON", 6)
    monkeypatch.setattr(ngram_join, "FEW_PAIRS", 1_000_000 if seed == 3 else 0)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = crowded(random.Random(seed), 150, passages, words, own, edits)
    got = ngram_join.similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_groups(rows)


def test_pairs_of_classes_need_a_first():
    """Of random classes of tokens: pairs with a first, and links inside classes, join what all pairs join."""
    rnd, bands = random.Random(5), ngram_join.Bands()
    for _ in range(200):
        common = [frozenset(rnd.sample(range(30), rnd.randint(18, 30))) for _ in range(rnd.randint(1, 4))]
        sets = [(rnd.choice(common), rnd.randint(0, 8)) for _ in range(rnd.randint(2, 25))]
        similar = lambda x, y: 100 * len(x[0] & y[0]) >= 80 * (len(x[0] | y[0]) + x[1] + y[1])

        def groups(pairs, sets=sets):
            of = list(range(len(sets)))
            for i, j in pairs:
                if similar(sets[i], sets[j]):
                    of = [of[i] if c == of[j] else c for c in of]
            return {frozenset(k for k, c in enumerate(of) if c == d) for d in of}

        every = [(i, j) for i in range(len(sets)) for j in range(i)]
        first = {c: min((k for k, s in enumerate(sets) if s[0] == c), key=lambda k: (sets[k][1], k)) for c in {s[0] for s in sets}}
        few = []
        for k, (c, rare) in enumerate(sets):
            inside = len(c) * (bands.den - bands.num) >= (rare + sets[first[c]][1]) * bands.num
            if inside:
                assert first[c] == k or similar(sets[k], sets[first[c]])
                few.append((k, first[c]))
            if not inside or first[c] == k:
                few += [(k, f) for f in first.values()]
        assert groups(few) == groups(every)


def counted(spark, monkeypatch, rows):
    """Rows of the tables that the last part writes, and of its cells."""
    counts, write, cells = {}, ngram_join.Scratch.write, ngram_join.cells

    def writing(self, df, name):
        out = write(self, df, name)
        counts[name] = out.count()
        return out

    def cutting(now):
        out = cells(now)
        counts["cells"] = max(counts.get("cells", 0), out.count())
        return out

    monkeypatch.setattr(ngram_join.Scratch, "write", writing)
    monkeypatch.setattr(ngram_join, "cells", cutting)
    n = len(ngram_join.similar_groups(spark.createDataFrame(rows, SCHEMA)).select("component_id").distinct().collect())
    monkeypatch.undo()
    return n, {k: counts.get(k, 0) for k in ("common", "classes-of", "inside-class-near", "rest", "cells", "sure-pairs", "all-pairs", "blocks-more", "tokens-more", "blocks-first-near", "tokens-first-near", "sure-near", "all-near")}


@pytest.mark.parametrize("own, linked", [(5, False), (1, True)])
def test_a_common_passage_grows_in_proportion(spark, monkeypatch, own, linked):
    """A passage of 60 words that all documents share, with some words of their own on either side: four times as many documents
    make at most five times as many rows at every step, whether they are similar or not."""
    rnd, passage, sizes = random.Random(6), " ".join(f"p{k}" for k in range(60)), []
    for n in (300, 1200):
        rows = [(d, " ".join([f"a{rnd.random()}" for _ in range(own)] + [passage] + [f"z{rnd.random()}" for _ in range(own)])) for d in range(n)]
        groups, counts = counted(spark, monkeypatch, rows)
        assert groups == (1 if linked else n)
        sizes.append(counts)
    assert all(sizes[1][k] <= 5 * sizes[0][k] + 50 for k in sizes[0]), sizes


def test_few_rows_are_not_shuffled(spark, monkeypatch):
    """Labels that are few go to the links: a round of components has one shuffle, not six; with none few the results are equal."""
    from quillmill.llm import common, graph

    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(k, 90) for k in range(91, 99)], "a long, b long")
    plans = []

    class Seen(common.Scratch):
        def write(self, df, name):
            plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
            return super().write(df, name)

    few = {tuple(r) for r in graph.components(links, Seen(spark, "few"), "c").collect()}
    rounds = [plan for name, plan in plans if name in ("c-1", "c-2")]
    assert len(rounds) == 2 and all(plan.count("Exchange hashpartitioning") == 1 for plan in rounds)
    rows = crowded(random.Random(7), 60, 2, 40, 5, 1)
    monkeypatch.setattr(common, "FEW_ROWS", 0)
    monkeypatch.setattr(ngram_join, "FEW_ROWS", 0)
    monkeypatch.setattr(ngram_join, "COMMON", 6)
    assert {tuple(r) for r in graph.components(links, common.Scratch(spark, "many"), "c").collect()} == few
    got = ngram_join.similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_groups(rows)
