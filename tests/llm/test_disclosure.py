"""Spans, disclosure and the sanitised text against plain Python, and a line of very many addresses."""

import math
import random
import re
import time
from collections import Counter

import pytest

from millrace.llm import privacy

TERM = re.compile(r"[^\W\d_]{3,}")
WORDS = ["amber", "birch", "cedar", "dune", "Élan", "𝒳yz𝒳", "ox", "ferry", "grove", "mail@a.example", "10.0.0.7", "10.0.300.7",
         "+49 30 (1234) 567", "4111 1111 1111 1111", "4111 1111 1111 1112", "x.y@b-c.example.org", "+1"]


def _luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = {k: [] for k in privacy.KINDS}
    for kind, pattern, valid in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(re.sub("[ -]", "", v)) <= 19 and _luhn(re.sub("[ -]", "", v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(re.sub("[^0-9]", "", v)) <= 15),
    ):
        out[kind] = [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, text) if valid(m.group())]
    return out


def sanitised(text, spans):
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], privacy.LABELS[kind]]
        at = max(at, end)
    return "".join(out) + text[at:]


def brute_force(texts, smoothing=1.0, generalise=0.8, remove=0.95):
    lines = [line for t in texts for line in t.split("\n")]
    found = [{(k, v) for k, spans in base_spans(x).items() for _, _, v in spans} for x in lines]
    entity, both, term = Counter(), Counter(), Counter()
    for x, es in zip(lines, found):
        term.update(set(TERM.findall(x)))
        entity.update(es)
        without = set(TERM.findall(re.sub(privacy.PATTERNS["email"].replace(r"\G|", ""), " ", x)))
        both.update((e, t) for e in es for t in without)
    level = {}
    for (e, t), n in both.items():
        share = entity[e] / len(lines)
        d = 1 - math.log((n + smoothing * share) / (term[t] + smoothing)) / math.log(share) if share < 1 else 0.0
        if d >= generalise - 1e-12:
            level[e, t] = d >= remove - 1e-12
    result = []
    for text in texts:
        base, terms, at = base_spans(text), [], 0
        spans = [(s, e, k) for k in privacy.KINDS for s, e, _ in base[k]]
        for x in text.split("\n"):
            es = [(k, v) for k, found_here in base_spans(x).items() for _, _, v in found_here]
            for m in TERM.finditer(x):
                hits = [level[e, m.group()] for e in es if (e, m.group()) in level]
                s, e = at + m.start(), at + m.end()
                if hits and not any(b[0] < e and s < b[1] for b in spans):
                    terms.append((s, e, "gone" if any(hits) else "term"))
            at += len(x) + 1
        result.append((sorted(spans + terms), sanitised(text, spans + terms)))
    return result


@pytest.mark.parametrize("seed", range(3))
def test_spans_terms_and_texts_match_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = WORDS + ["".join(rng.choice("bcdfgh") for _ in range(rng.randrange(2, 6))) for _ in range(150)]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", " ", " ", ", ", "\n", "", " " * 300]) for _ in range(rng.randrange(60))) for _ in range(120)]
    want = brute_force(texts)
    assert any(k == "term" for spans, _ in want for _, _, k in spans)
    rows = privacy.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        spans = [] if r.entities is None else sorted((s.start, s.end, s.kind) for k in (*privacy.KINDS, "terms") for s in r.entities[k])
        assert (spans, r.sanitised) == want[r.doc_id], texts[r.doc_id]


def test_one_line_of_many_addresses_takes_seconds(spark):
    n = 100_000
    text = " ".join(f"u{i}@h.example" for i in range(n)) + " call 10.1.2.3"
    docs = spark.createDataFrame([(1, text), (2, "nothing here\n" * 50)], "doc_id long, text string")
    start = time.time()
    got = {r.doc_id: r for r in privacy.sanitise(docs).collect()}
    assert time.time() - start < 60
    assert len(got[1].entities.email) == n and all(text[s.start:s.end] == s.value for s in got[1].entities.email[::997])
    assert got[1].sanitised.startswith("[EMAIL] " * n) and got[1].sanitised.endswith("[IP]")
    assert got[2].sanitised == "nothing here\n" * 50


def test_a_term_is_hidden_in_every_line_of_a_document_with_its_entity(spark):
    """Also in the lines that do not hold the entity; documents without the entity keep the word."""
    plain = [(i, "\n".join(f"amber birch cedar {w} dune" for w in ("ferry", "grove", "haven") * 12)) for i in range(2, 400)]
    text = "Zanzarella came in\nask ann@mail.example.org for Zanzarella, amber\n\nbirch Zanzarella 10.0.0.7\nxZanzarella"
    rows = [(0, text), (1, "amber Zanzarella birch"), (None, text), *plain]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    places = lambda r: [] if r.entities is None else [(s.start, s.end) for s in r.entities.terms if s.value == "Zanzarella"]
    every = [m.span() for m in re.finditer(r"(?<!\w)Zanzarella", text)]
    got = {r.doc_id: r for r in privacy.sanitise(df, scope="document").collect()}
    assert len(every) == 3 and places(got[0]) == every and places(got[None]) == every
    assert "Zanzarella" not in got[0].sanitised.replace("xZanzarella", "") and got[1].sanitised == rows[1][1]
    assert all(got[i].sanitised == t for i, t in plain)
    by_line = {r.doc_id: r for r in privacy.sanitise(df).collect()}
    assert places(by_line[0]) == every[1:]
