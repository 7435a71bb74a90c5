"""The bootstrapping against a plain version, and against planted identifiers among decoys."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from driftloom.llm import pii
from driftloom.llm.common import Steps

DOCS = "doc_id long, text string"


def planted(seed, n=240):
    """Documents, and the spans that are to be found beside those of the base expressions."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abdegilmnorstu") for _ in range(rng.randint(2, 9)))
    filler = lambda k: " ".join(rng.choice(["the", "of", "and", "at", word()]) for _ in range(k))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    rows, hidden = [], []
    for k in range(n):
        kind, value, context = k % 8, None, None
        if kind == 0:
            context = ("hotline number ", f"+1 (555) {digits(3)}-{digits(4)}", " (office)")
        elif kind == 1 and k % 16 == 1:
            value = f"{digits(3)}-{digits(4)}"
            context = ("hotline number ", value, " (office)")
        elif kind == 2:
            context = ("mailbox <", f"{word()}{digits(2)}@{word()}.example", "> inbox")
        elif kind == 3 and k % 16 == 3:
            value = f"{word()}{digits(2)}@intranet{digits(1)}"
            context = ("mailbox <", value, "> inbox")
        elif kind == 4:
            value = f"{word()}{digits(12)}{word()}"
            context = (rng.choice(['token = "', "api_key: '", 'password="']), value, rng.choice(['"', "'"]))
        elif kind == 5:
            context = (rng.choice(["room ", "page ", "the ", "in ", "version "]), rng.choice([f"{digits(3)}-{digits(4)}", digits(4), f"1.{digits(2)}.3"]), " ")
        elif kind == 6:
            context = (rng.choice(["the ", "of ", "and "]), "4" + digits(15), " ")
        else:
            context = (rng.choice(['width = "', "size <", "ratio: "]), f"{digits(6)}px", rng.choice(['"', ">", ""]))
        before = filler(rng.randint(2, 12)) + " "
        text = before + "".join(context or ()) + " " + filler(rng.randint(1, 9))
        if value:
            start = len(before) + len(context[0])
            hidden.append((k, start, start + len(value)))
        rows.append((k, text))
    return rows, hidden


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_identifiers_are_found_and_decoys_are_not(spark, seed):
    rows, hidden = planted(seed)
    found = [(r.doc_id, s.start, s.end) for r in pii.find(spark.createDataFrame(rows, DOCS)).collect() for s in r.found]
    right = len(set(found) & set(hidden))
    assert right >= 0.9 * len(hidden), "recall"
    assert right >= 0.9 * len(found), "precision"
    kinds = {s.kind for r in pii.find(spark.createDataFrame(rows, DOCS)).collect() for s in r.found}
    assert kinds == {"found_phone", "found_email", "found_secret"}


def test_numbers_after_common_words_stay(spark):
    """Many Luhn failures and some cards after the same stop words: these tell nothing."""
    rng = random.Random(3)
    rows = [(k, f"a b the {rng.randint(10**15, 10**16 - 1)} of the and") for k in range(200)] + [(k, "the of the and the") for k in range(200, 600)]
    assert not any(r.found for r in pii.find(spark.createDataFrame(rows, DOCS)).collect())


def plain(occurrences, totals):
    """Patterns of high worth and what they tell, with dictionaries."""
    beside, edges = Counter(), {}
    for o in occurrences:
        for p in o.patterns:
            beside[p.family, p.word] += p.word is not None
    for o in occurrences:
        for p in o.patterns:
            if p.word is None or beside[p.family, p.word] >= pii.MIN_RATE * totals[p.word]:
                seed, rejected = edges.get((p.family, p.pattern, o.instance), (None, False))
                edges[p.family, p.pattern, o.instance] = (min(filter(None, (seed, o.seed)), default=None), rejected or o.rejected)
    of_pattern, of_instance = defaultdict(dict), defaultdict(dict)
    for (_, pattern, instance), state in edges.items():
        of_pattern[pattern][instance] = of_instance[instance][pattern] = state
    worth, known = {}, 0
    while True:
        valued = {}
        for pattern, members in of_pattern.items():
            if len(members) < pii.MIN_INSTANCES:
                continue
            for kind in {s for s, _ in members.values() if s} | {k for i in members for p, k in worth if p in of_instance[i]}:
                mass, n = 0.0, 0.0
                for i, (seed, rejected) in members.items():
                    score = 0.0
                    if seed or rejected:
                        n += 1
                        score = float(seed == kind)
                    else:
                        others = [worth[q, kind] for q, (s, r) in of_instance[i].items() if q != pattern and (q, kind) in worth and not s and not r]
                        score = 1 - math.prod(1 - min(w, pii.MOST) for w in others)
                        n += score + pii.UNKNOWN * (1 - score)
                    mass += score
                if mass:
                    p, z = mass / n, pii.QUANTILE
                    low = (p + z * z / (2 * n) - z * math.sqrt(max(p * (1 - p), 0) / n + z * z / (4 * n * n))) / (1 + z * z / n)
                    if low >= pii.MIN_WORTH:
                        valued[pattern, kind] = low
        worth = valued
        if len(worth) <= known:
            break
        known = len(worth)
    told = set()
    for i, patterns in of_instance.items():
        for kind in {k for _, k in worth}:
            own = [(q, worth[q, kind]) for q, (s, _) in patterns.items() if s is None and (q, kind) in worth]
            score = 1 - math.prod(1 - min(w, pii.MOST) for _, w in own)
            if len({q.split("\x01")[0] for q, _ in own}) >= pii.MIN_FAMILIES and score >= pii.MIN_SCORE and len(i) >= pii.MIN_LENGTH:
                told.add((i, kind))
    return worth, told


@pytest.mark.parametrize("seed", [1, 4])
def test_iteration_equals_plain_one(spark, seed):
    rows, _ = planted(seed, 160)
    docs = spark.createDataFrame(rows, DOCS)
    occurrences = pii._occurrences(pii.scan(docs))
    totals = Counter(w for _, t in rows for w in re.split(r"[^a-z_]+", t.lower()) if w)
    assert {r.word: r.total for r in pii.word_totals(docs).collect()} == totals
    edges = pii._edges(occurrences, pii.word_totals(docs)).persist()
    worth, told = pii.bootstrap(edges, Steps(spark, "test"))
    want_worth, want_told = plain(occurrences.collect(), totals)
    assert {(r.pattern, r.kind): pytest.approx(r.worth) for r in worth.collect()} == want_worth
    assert {(r.instance, r.kind) for r in told.collect()} == want_told
    assert want_told
    edges.unpersist()


def test_secrets_are_redacted(spark):
    rows = [(1, 'so token = "e51a5499e3950aeb" and'), (2, "api-key: 'short1'"), (3, 'tokens = "nodigitshere"'), (4, None)]
    out = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, DOCS)).collect()}
    assert out == {1: 'so token = "[SECRET]" and', 2: rows[1][1], 3: rows[2][1], 4: None}
