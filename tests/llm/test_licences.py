"""Licence scans against a plain search for the longest runs, on changed texts, and on odd rows."""

import random
from functools import reduce

import numpy as np
import pyarrow as pa

from hvspark.llm import licences as L
from hvspark.llm.tokens import tokenize, utf8, words


def plain_statistics(tokens, sequences):
    out = []
    for i in range(len(tokens)):
        here = {}
        for k, s in enumerate(sequences):
            best = 0
            for j in range(len(s)):
                n = 0
                while n <= min(i, j) and tokens[i - n] == s[j - n]:
                    n += 1
                best = max(best, n)
            if best >= L.MIN_MATCH:
                here[k] = best
        out.append(here)
    return out


def test_statistics_equal_a_plain_search():
    rng = random.Random(2)
    sequences = [[rng.randrange(5) for _ in range(rng.randrange(3, 25))] for _ in range(6)]
    a = L.Automaton(sequences)
    for _ in range(30):
        tokens = [rng.randrange(6) for _ in range(60)]
        got = a.statistics(tokens)
        assert [{k: n for k, (n, _) in h.items()} for h in got] == plain_statistics(tokens, sequences)
        for i, here in enumerate(got):
            for k, (n, state) in here.items():
                for end in a.ends[state][k]:
                    assert sequences[k][end - n : end] == tokens[i + 1 - n : i + 1]


def spans(text, templates=L.TEMPLATES):
    library = L.Library(templates)
    data, at = utf8(pa.array([text], pa.large_string()))
    return [(library.names[k][0], first, end, covered) for _, k, first, end, covered in library.spans(tokenize(data, at))]


def test_each_template_is_found_in_prose():
    for name, _, parts in L.TEMPLATES:
        text = " ".join(parts)
        n = len(words(text))
        assert (name, 3, 3 + n, n) in spans(f"One two three.\n{text}\nfour five, the software of nobody."), name


def test_what_lies_outside_of_trigrams_is_never_part():
    rng = random.Random(1)
    vocabulary = sorted({w for _, _, p in L.TEMPLATES for w in words(" ".join(p))})
    library = L.Library()
    for _ in range(20):
        text = " ".join(rng.choice(vocabulary) for _ in range(300))
        data, at = utf8(pa.array([text], pa.large_string()))
        t = tokenize(data, at)
        inside = reduce(lambda s, r: s | set(range(*r)), library.runs(t), set())
        for i, here in enumerate(library.automaton.statistics(t.hash.tolist())):
            for n, _ in here.values():
                assert set(range(i + 1 - n, i + 1)) <= inside


def test_changed_words_within_a_template_are_bridged():
    text = "Permission is hereby granted, free of charge, to every person obtaining a copy of this great software and associated documentation files, to deal in the Software without restriction"
    assert [(n, c) for n, _, _, c in spans(text)] == [("mit-grant", 27)] or [n for n, *_ in spans(text)] == ["mit-grant"]
    assert spans("Permission is hereby granted and nothing else.") == []


def plain_chains(matches, size):
    """The definition: of all chains the best, then the best of what lies outside of it, and so on."""
    out = []
    while matches:
        best = []
        for end, length, places in matches:
            for place in places:
                top = (length, end - length)
                for covered, first, before, at in best:
                    gain = min(length, end - before, place - at)
                    if gain > 0 and end - gain - before <= L.MAX_GAP:
                        top = max(top, (covered + gain, first), key=lambda x: (x[0], -x[1]))
                best.append((*top, end, place))
        covered, first, end, _ = max(best, key=lambda x: (x[0], -x[1], -x[2]))
        if covered < L.MIN_COVERAGE * size:
            break
        out.append((first, end, covered))
        matches = [m for m in matches if m[0] <= first or m[0] - m[1] >= end]
    return sorted(out)


def plain_spans(text, templates):
    """Spans from statistics by a plain search, chains by definition, and all pairs of spans compared."""
    said = words(text)
    sequences = [words(" ".join(p)) for _, _, p in templates]
    stats = plain_statistics(said, sequences)
    out = []
    for k, (name, _, _) in enumerate(templates):
        s = sequences[k]
        matches = []
        for i, here in enumerate(stats):
            n = here.get(k, 0)
            if n and (i + 1 == len(stats) or stats[i + 1].get(k, 0) != n + 1):
                matches.append((i + 1, n, [e for e in range(n, len(s) + 1) if s[e - n : e] == said[i + 1 - n : i + 1]]))
        out += [(name, *x) for x in plain_chains(matches, len(s))]
    return sorted(x for x in out if not any(y[3] > x[3] and y[1] <= x[1] and x[2] <= y[2] for y in out))


def test_spans_equal_the_plain_version():
    rng = random.Random(7)
    for n in range(60):
        vocabulary = [f"w{i}" for i in range(rng.choice([4, 8, 40]))]
        templates = [(f"t{k}", "x", (" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 15))),)) for k in range(5)]
        parts = []
        for _ in range(rng.randrange(1, 9)):
            own = words(rng.choice(templates)[2][0])
            parts += [w if rng.random() > 0.08 else "other" for w in own] + ["so"] * rng.choice([0, 0, 1, 4, 12])
        text = " ".join(parts)
        assert sorted(spans(text, templates)) == plain_spans(text, templates), n


def test_the_time_for_many_licences_in_a_text_is_in_proportion():
    import time

    grant = " ".join(" ".join(p) for n, _, p in L.TEMPLATES if n in ("mit-grant", "mit-warranty")) + "\n"
    took = []
    for size in (1 << 17, 1 << 20):
        start = time.process_time()
        found = spans(grant * (size // len(grant)))
        took.append(time.process_time() - start)
        assert len(found) == 2 * (size // len(grant))
    assert took[1] < 20 * took[0]


def test_whole_texts_are_templates(tmp_path):
    (tmp_path / "A-1").write_text("one two three four five six seven")
    (tmp_path / "A").write_text("one two three four five six seven")
    (tmp_path / "B").write_bytes(b"ten nine \xff eight seven six five")
    assert [x[:2] for x in L.whole_texts(str(tmp_path))] == [("a-1-text", "A-1"), ("b-text", "B")]
    assert L.whole_texts(str(tmp_path / "nowhere")) == ()
    given = L.TEMPLATES + L.whole_texts()
    for name, _, (text,) in L.whole_texts():
        found = spans(f"Our notes.\n{text}\nAnd our own words after it.", given)
        assert name in {n for n, *_ in found} and all(n in (name, *(x for x, _, _ in L.TEMPLATES)) for n, *_ in found if n != name), (name, found)


def test_two_of_a_kind_and_nested():
    assert [x[:3] for x in spans("Released under the MIT License, released under the MIT License.")] == [("mit-notice", 0, 5), ("mit-notice", 5, 10)]


def test_odd_rows(odd, none, spark):
    assert L.scan(odd).count() == 0 and L.scan(none).count() == 0
    text = "é ü. Released under the MIT License. " + "x " * 50_000 + "All rights reserved"
    docs = spark.createDataFrame([(1, text, "t"), (1, text, "t"), (None, "all RIGHTS reserved", "t")], "doc_id long, text string, template string")
    rows = L.scan(docs).collect()
    assert len(rows) == 5
    for r in rows:
        data = (text if r.doc_id else "all RIGHTS reserved").encode()
        assert data[r.first_byte : r.end_byte].decode() in ("Released under the MIT License", "All rights reserved", "all RIGHTS reserved")
    assert np.allclose([r.coverage for r in rows], 1)
    assert L.scan(docs, (("tiny", "none", ("All rights",)),)).count() == 0
