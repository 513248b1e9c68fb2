"""The source audit against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest

from codeseam.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n int, p int, value string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "x", 1, 2, "y") for i, (t, lang, s) in enumerate(rows)], SCHEMA)


def plain(rows, least, ranks):
    terms = [(TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")), lang or "", s or "") for t, lang, s in rows]
    out = set()
    for lang in {x[1] for x in terms}:
        mine = [x for x in terms if x[1] == lang]
        holds = Counter(w for ws, _, _ in mine for w in set(ws))
        kept = sorted(w for w, n in holds.items() if n >= least)
        count = defaultdict(Counter)
        for ws, _, s in mine:
            count[s].update(w for w in ws if holds[w] >= least)
        whole = sum(count.values(), Counter())

        def share(c, v=len(kept)):
            total = sum(c.values())
            return {w: 1 + 10**9 * (c[w] + 5) // (total + 5 * v) for w in kept}

        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        for s in count:
            far = [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode(), o) for o in count if o != s]
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(far))}
            over = [(q[w] - p[s][w], w.encode(), w) for w in kept if count[s][w] and p[s][w] > q[w]]
            out |= {(lang, s, "term", w, -v, k + 1) for k, (v, _, w) in enumerate(sorted(over)[:ranks])}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = []
    for _ in range(300):
        s = rng.choice(["hot"] * 5 + ["a", "b", "é", None, ""])
        words = [f"{rng.choice('ABcdé')}{rng.choice(['x', 'yY', s or 'q'])}{'z' * int(rng.expovariate(0.7))}" for _ in range(rng.randrange(0, 40))]
        out.append((" 3".join(words), rng.choice(["en", "en", "de", None]), s))
    out += [(None, "en", "a"), ("", None, None), ("12 !!", "fr", "alone"), ("un deux", "fr", "two"), ("word " * 60_000, "en", "b"), out[3], out[3]]
    return out


@pytest.mark.parametrize(("sent", "held"), [(100_000, 300_000), (0, 50)])
def test_audit_matches_plain_counting(spark, rows, monkeypatch, sent, held):
    monkeypatch.setattr(divergence, "SENT_ROWS", sent)
    monkeypatch.setattr(divergence, "HELD", held)
    got = divergence.audit(spark, docs(spark, rows).repartition(5), least_docs=8, term_ranks=6).collect()
    want = plain(rows, 8, 6)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert sum(r["part"] == "term" for r in got) > 10 and any(r["lang"] == "fr" and r["value"] == 0 for r in got)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark, docs(spark, [])).count() == 0
    one = divergence.audit(spark, docs(spark, [("a b c", "en", "x")]), least_docs=1)
    assert one.count() == 0  # a source equal to its language stands out nowhere
    assert one.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_counts_beyond_64_bits_stay_exact(spark):
    huge = 9_000_000_000_000_000
    got = spark.createDataFrame([(huge, huge + 1, 3)], "n bigint, total bigint, terms bigint").select(divergence.share("n", "total", "terms").alias("p")).first()["p"]
    assert got == 1 + 10**9 * (huge + 5) // (huge + 1 + 15)
