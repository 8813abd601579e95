"""Packing, leaks and look-alikes against brute force, and their edges."""

import random
import unicodedata
from collections import Counter, defaultdict

import pytest
from conftest import SF
from duck import connect, normal
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.llm import registry
from quadrille.llm.forms import LOOKALIKES, lookalike_pairs, plain_form, skeleton, words
from quadrille.llm.leaks import leaks
from quadrille.llm.packing import fill, pack, pack_texts, plan, token_counts


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), connect(SF).sql(registry.oracle_sql()[name]).df()
    assert normal(got) == normal(want)


# -- packing


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=30))
def test_plan_fills_without_overflow(histogram):
    filled, ranks = Counter(), defaultdict(list)
    for length, a, b, first, per in plan(histogram, 50):
        ranks[length] += range(a, b)
        for r in range(a, b):
            filled[first + (r - a) // per] += length
    assert all(v <= 50 for v in filled.values())
    assert {k: len(v) for k, v in ranks.items()} == histogram and all(sorted(v) == list(range(len(v))) for v in ranks.values())
    assert sorted(filled) == list(range(len(filled)))
    assert sum(2 * v <= 50 for v in filled.values()) <= 1  # else two of them would have gone into one


def test_plan_as_good_as_item_by_item():
    rng = random.Random(0)
    items = sorted((rng.randint(1, 100) for _ in range(3000)), reverse=True)
    space: list[int] = []
    for x in items:
        fit = [s for s in range(len(space)) if space[s] >= x]
        if fit:
            space[min(fit, key=lambda s: space[s])] -= x
        else:
            space.append(100 - x)
    used = max(first + (b - a - 1) // per for _, a, b, first, per in plan(Counter(items), 100)) + 1
    assert used <= len(space) * 1.01 + 1


def test_plan_refuses_what_does_not_fit():
    with pytest.raises(ValueError):
        plan({11: 1}, 10)


def test_pack(spark):
    sizes = [(1, 0), (2, None), (3, -4), (4, 25), (5, 10), (6, 3), (6, 3), (7, 7), (None, 2), (8, 1_000_003)]
    df = spark.createDataFrame([(*s, 1, 2) for s in sizes], "doc_id long, n_tokens long, piece int, container_id int")
    out = [tuple(r) for r in pack(df, 10).collect()]
    got = defaultdict(list)
    for doc, piece, at, n, _ in out:
        got[doc].append((piece, at, n))
    assert sorted(got[4]) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)] and got[5] == [(0, 0, 10)] and got[6] == [(0, 0, 3)] * 2
    assert got[1] == got[2] == got[3] == [(0, 0, 0)] and len(got[8]) == 100_001
    load = Counter()
    for *_, n, c in out:
        load[c] += n
    assert max(load.values()) == 10 and sum(load.values()) == 25 + 10 + 6 + 7 + 2 + 1_000_003
    assert sum(r.n_tokens * r.n_containers for r in fill(pack(df, 10)).collect()) == sum(load.values())
    assert pack(df.limit(0), 10).count() == 0
    again = sorted(map(tuple, pack(df, 10).collect()), key=repr)
    assert again == sorted(out, key=repr)


def test_pack_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = {r.doc_id: r.n_tokens for r in token_counts(docs).collect()}
    out = pack_texts(docs, 256).collect()
    per, load = Counter(), Counter()
    for r in out:
        per[r.doc_id] += r.n_tokens
        load[r.container_id] += r.n_tokens
    assert per == Counter(sizes) and max(load.values()) <= 256
    assert all(n > 1 or sizes[d] <= 256 for d, n in Counter(r.doc_id for r in out).items() if sizes[d] <= 256 and n == 1)
    assert sum(load.values()) / (256 * len(load)) > 0.98
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "<|endoftext|> " * 3), (4, "word " * 200_000)], "doc_id long, text string")
    n = {r.doc_id: r.n_tokens for r in token_counts(odd).collect()}
    assert n[1] == n[2] == 0 and n[3] > 3 and n[4] >= 200_000


# -- look-alikes


def test_skeleton():
    assert skeleton("ｆｕｌｌ　ｗｉｄｔｈ") == "full width"
    assert skeleton("сосоа") == "cocoa" and skeleton("e​́") == skeleton("é") == skeleton("е́")
    assert skeleton("a b c") == "a b c" and skeleton("﻿x⁠y") == "xy"
    for a, b in (("a", "A"), ("e", "é"), ("2", "²"), ("a b", "ab"), ("0", "O"), (".", ","), ("α", "a"), ("a\n", "a ")):
        assert skeleton(a) != skeleton(b)
    assert plain_form("éа") == "éa" and plain_form("") == ""


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"])))
def test_skeleton_is_stable(text):
    s = skeleton(text)
    assert skeleton(s) == s
    assert skeleton(unicodedata.normalize("NFC", text)) == skeleton(unicodedata.normalize("NFD", text))
    assert plain_form(plain_form(text)) == plain_form(text)


def test_prototypes_are_final():
    assert not any(v in LOOKALIKES for v in LOOKALIKES.values())


def test_lookalike_pairs(spark, rows):
    docs = [(1, "abc", 0), (2, "аbc", 0), (3, "аbс", 0), (4, "abc", 0), (4, "abc", 0), (5, "Abc", 0), (6, None, 0), (7, None, 0), (8, "", 0), (9, "​", 0), (None, "аbс", 0), (10, "x" * 300_000, 0), (11, "х" + "x" * 299_999, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, skel int").withColumnsRenamed({"skel": "class_id"})
    texts = {(d, t) for d, t, _ in docs if d is not None and t is not None}
    want = sorted({(a, b) for a, s in texts for b, t in texts if a < b and s != t and skeleton(s) == skeleton(t)})
    assert rows(lookalike_pairs(df)) == sorted(want, key=repr)
    assert lookalike_pairs(df.limit(0)).count() == 0


# -- leaks


def naive(docs, items, n=13):
    spans = lambda t: {tuple(w[k : k + n]) for w in [words(t)] for k in range(len(w) - n + 1)}
    own = [(i, spans(t)) for i, t in items if i is not None and t is not None]
    return sorted({(d, i) for d, t in docs if d is not None and t is not None for i, s in own if s & spans(t)}, key=repr)


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_leaks(spark, rows, limit):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(12)] + ["the"] * 6
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, text(rng.randint(5, 40))) for k in range(12)] + [(50, None), (None, "a b"), (51, ""), (52, "one two three four five six seven eight nine ten eleven twelve thirteen")]
    items += [(53, items[-1][1]), (52, items[-1][1])]
    docs = []
    for k in range(120):
        parts = [text(rng.randint(0, 30))]
        if k % 3 == 0:
            w = (rng.choice(items[:12])[1]).split()
            a = rng.randint(0, max(0, len(w) - 13))
            parts += [" ".join(w[a : a + rng.randint(10, 16)]), text(5)]
        docs.append((k, " -- ".join(parts)))
    hidden = items[15][1].upper().replace("O", "О").replace(" ", " ")
    docs += [(200, hidden), (201, "x " + hidden + " y"), (202, " ".join(hidden.split()[:12])), (203, None), (None, hidden), (204, ""), (200, hidden), (205, "filler " * 50_000 + hidden)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, start int").withColumnRenamed("start", "item_id")
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = rows(leaks(d, i, set_limit=limit))
    assert got == naive(docs, items)
    assert {(200, 52), (201, 53), (205, 52)} <= set(got) and not any(x[0] in (202, 203, 204) for x in got)
    assert leaks(d.limit(0), i).count() == 0 and leaks(d, i.limit(0)).count() == 0
