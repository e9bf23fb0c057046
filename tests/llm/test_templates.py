"""Decontamination: the template method against its own brute force, re-parameterised items, exact copies of any kind, repeats."""

from __future__ import annotations

import random
import re

import pytest
from test_operators import ITEM, docs_of, messy

from sparkloom.llm import decontaminate as D

TOM = "Tom bought 12 red apples at the market. Tom sold 5 apples to a friend on the way. Tom then lost 3 apples. How many apples does Tom still have?"
NAMES = ["Maria", "Jim", "Aisha", "Li Wei", "Ana Sofia", "Olga"]


def found(spark, texts, items):
    rows = D.op4_decontamination(docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)]), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    return {(r["doc_id"], r["item_id"], r["exact"]) for r in rows}


def test_given_cases(spark):
    maria = TOM.replace("Tom", "Maria").replace("12", "31").replace("5", "8").replace("3 apples.", "4 apples.")
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(41)]
    long_item = " ".join([*words[:20], "7", *words[20:]])
    changed = " ".join([*words[:20], "9", *words[20:]])
    conflict = long_item.replace(words[3], "7").replace(words[30], "7")
    number = "1 4 1 5 9 2 6 5 3 5 8 9 7 9 3 2 3 8"
    texts = [
        maria, changed, conflict.replace(" 7 ", " 8 ", 1), "Question: Which planet in our system has the most moons?", "so: what is 7 times 8? yes", f"digits {number} end", ITEM.upper(), "Ann of New York sold 5 apples",
        TOM.replace("Tom", "Ana Sofia").replace("12", "twenty"),
    ]
    items = [TOM, long_item, conflict, "Which planet in our system has the most moons?", "What is 7 times 8?", number, ITEM]
    got = found(spark, texts, items)
    assert (0, 0, False) in got and (0, 0, True) not in got
    assert (1, 1, True) in got and (1, 1, False) in got
    assert (2, 2, True) in got and (2, 2, False) not in got
    assert {(3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (8, 0, False)} <= got and not [x for x in got if x[0] == 7]


def test_recall_of_reparameterised_items(spark):
    r = random.Random(7)
    vocabulary = "the a of with buys sells then gives apples pears to friend each day many how much left after in box shop walks road counts red".split()
    items, texts = [], []
    for k in range(60):
        words = [r.choice(vocabulary) for _ in range(26)]
        for at, form in zip(sorted(r.sample(range(26), 6)), ("{n}", "{a}", "{b}", "{n}", "{c}", "{a}")):
            words[at] = form
        fill = lambda n, x, y: " ".join(words).format(n=n, a=x[0], b=y, c=x[1]) + "."  # noqa: E731, B023
        items.append(fill("Boris", (r.randrange(2, 50), 50 + k), r.randrange(100, 200)))
        texts.append("Some text before it. " + fill(r.choice(NAMES), (r.randrange(200, 250), 300 + k), r.randrange(300, 400)) + " And after")
    got = {(d, i) for d, i, exact in found(spark, texts, items) if not exact}
    assert sum((k, k) in got for k in range(60)) >= 54


def typed(text):
    out = []
    for t in re.findall(r"[^\W\d_]+|\d+(?:[.,:/]\d+)*", text):
        low = t.lower()
        k = D.NUM if t[0].isdigit() or low in D.NUMBERS else D.NAME if low != t and len(t) > 1 else D.UNIT if low in D.UNITS else low
        if k == D.NAME and out and out[-1][0] == D.NAME:
            out[-1] = (k, out[-1][1] + " " + low)
        else:
            out.append((D.NUM if low in D.NUMBERS else k, low))
    return out


def brute(doc, item, n=13):
    """Whether some run of template windows of doc and item is consistent and differs in a slot."""
    x, y = typed(item), typed(doc)
    if len(x) < 6:
        return False
    n = min(n, len(x))
    marks = (D.NUM, D.NAME, D.UNIT)
    ok = lambda i, j: [k for k, _ in x[i : i + n]] == [k for k, _ in y[j : j + n]] and 2 * sum(k not in marks for k, _ in x[i : i + n]) >= n
    hits = {(i, j) for i in range(len(x) - n + 1) for j in range(len(y) - n + 1) if ok(i, j)}
    for i, j in hits:
        if (i - 1, j - 1) in hits:
            continue
        m = 0
        while (i + m + 1, j + m + 1) in hits:
            m += 1
        pairs = {(a[1], b[1]) for a, b in zip(x[i : i + m + n], y[j : j + m + n]) if a[0] in marks}
        if len({p[0] for p in pairs}) == len(pairs) == len({p[1] for p in pairs}) and any(a != b for a, b in pairs):
            return True
    return False


@pytest.mark.parametrize("seed", [1, 2])
def test_templates_against_brute_force(spark, seed):
    r = random.Random(seed)
    pick = lambda: r.choice(["the", "a", "of", "box", "has", "red", "Tom", "Ann", "7", "12", "cm", "two", "Big Ben", "runs"])
    items = [" ".join(pick() for _ in range(r.choice([6, 8, 15, 20]))) for _ in range(8)]
    texts = []
    for _ in range(60):
        t = r.choice(items).split()
        old, new = r.choice([("7", "19"), ("Tom", "Zed"), ("12", "7"), ("Ann", "Tom")])
        t = [new if w == old else w for w in t]
        for _ in range(r.randrange(3)):
            t[r.randrange(len(t))] = pick()
        texts.append(" ".join([pick() for _ in range(r.randrange(6))] + t + [pick() for _ in range(r.randrange(6))]))
    got = {(d, i) for d, i, exact in found(spark, texts, items) if not exact}
    assert got == {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if brute(t, x)} and got


def test_repeats_and_nulls(spark):
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (None, TOM), (None, None), (2, None)], "item_id long, text string")
    rows = [(1, ITEM, "a"), (1, ITEM, "a"), (2, TOM, "a"), (None, TOM, "a"), (1, "other text", "a"), (3, " ".join(["lorem ipsum"] * 40_000) + " " + ITEM, "a")]
    got = sorted(map(str, D.op4_decontamination(docs_of(spark, rows).withColumnRenamed("lang", "item_id"), bench).collect()))
    once = sorted(map(str, D.op4_decontamination(docs_of(spark, [rows[0], *rows[2:]]), bench.distinct()).collect()))
    assert got == once and len(got) == 3 and sum("item_id=None" in x for x in got) == 1
    assert D.op4_decontamination(messy(spark), bench).count() == 0
