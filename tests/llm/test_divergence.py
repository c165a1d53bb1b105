"""Source divergence against a dense computation on whole numbers."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from clientele.llm import divergence


def split(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", low)


def plain(rows, least=3, most=200):
    counts, langs, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        counts[lang, source].update(split(text))
        langs[lang].update(split(text))
        held[lang].update(set(split(text)))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]

        def shares(counter):
            total = sum(counter[t] for t in kept)
            return {t: 1 + 10**9 * (counter[t] + 1) // (total + len(kept)) for t in kept}

        of = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(langs[lang])
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pairs = [(sum(f(of[s][t], of[o][t]) for t in kept), o) for o in sources if o != s]
            single = [(f(of[s][t], whole[t]), t) for t in kept if counts[lang, s][t] and of[s][t] > whole[t]]
            for part, found, limit in (("pair", pairs, None), ("term", single, most)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found[:limit], 1)]
    return out


def check(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "t", 5, 6) for r in rows], "lang string, source string, text string, term string, n int, docs int")
    got = [tuple(r) for r in divergence.audit(docs.repartition(4), **more).collect()]
    assert sorted(got) == sorted(plain(rows, *more.values()))


def test_terms_split_as_the_pattern_does():
    for text in ("", "A b", "x1y-Z_w", "ÉCOLE école b c\u0085d", "中国 🙂!", "a\x00b\x7fc[d]{e}@f`g"):
        assert [t.decode() for t in divergence.terms(text)] == split(text)


def test_random_sources(spark):
    rnd = random.Random(3)
    common = ["the", "of", "é", "中"] + [f"w{chr(97 + n % 26)}{chr(97 + n // 26)}" for n in range(80)]
    rows = []
    for at in range(300):
        source = rnd.choice([None, "", "hot", "hot", "hot", "s1", "s2", "s3", "lonely"])
        words = rnd.choices(common, k=rnd.choice([0, 1, 20, 60])) + ["x" * (at % 3)]
        rows.append((rnd.choice(["en", "de", None]), source, rnd.choice([" ", ", "]).join(words)))
    rows += [("fr", "a", "one two"), ("fr", "b", "one"), ("es", "only", None), ("pt", "a", ""), ("pt", "b", None)] + rows[:20]
    check(spark, rows)
    check(spark, rows, least_documents=1, most=3)


def test_small_flushes(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 2)
    check(spark, [("en", f"s{at % 4}", f"a b c{chr(97 + at)} d d") for at in range(20)])


def test_empty_and_long(spark):
    check(spark, [])
    check(spark, [("en", "a", "word " * 50_000 + "z" * 100_000)] * 3 + [("en", "b", "word other")])
