"""Systematic mixing against plain exact arithmetic."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from codeseam.llm import mixture

SCHEMA = "doc_id bigint, text string, source string, lang string, size bigint, target string, expected int, _rpart int, one int, place int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", 7, "x", 1, 2, 3, 4) for i, t, s in rows], SCHEMA)


def plain_targets(sizes):
    """source -> target, by pouring again until nothing is above its bound."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    full, out = Fraction(3 * sum(sizes.values()), 2), {}
    open_ = set(names)
    while open_:
        left, weights = full - sum(out.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / weights > 2 * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / weights for s in open_}
            break
        out |= {s: Fraction(2 * sizes[s]) for s in over}
        open_ -= over
    return out


def check(rows, got):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    total = defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        total[s] += n
    target = plain_targets(total)
    for s, t in target.items():
        assert all(abs(r["target"] - float(t)) <= 1e-9 * max(1, float(t)) for r in got if r["source_size"] == total[s] and r["source"] == s)
    want = Counter()
    for s, n in total.items():
        h = int(hashlib.md5(("mix-1:" + ("null" if s is None else "=" + s)).encode()).hexdigest()[:5], 16)
        at = (2 * h + 1) * (10**12 >> 9) // (1 << 12)
        step = int(float(min(2, target[s] / n)) * 1e12 + 0.5) if n else 0
        for k, i in sorted((k, i) for (i, _, of), k in zip(rows, size) if of == s):
            want[(s, i, k, k * ((at + step) // 10**12 - at // 10**12))] += 1
            at += step
    assert Counter((r["source"], r["doc_id"], r["size"], r["taken"]) for r in got) == want
    for s, n in total.items():
        mine = [r for r in got if r["source"] == s]
        assert all(r["taken"] <= 2 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - float(target[s])) <= 2 * max(r["size"] for r in mine) + 1e-6


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    names = ["src0"] * 8 + ["a", "b", "zz", "é", "", None]
    out = [(i, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.choice([0, 3, 3, rng.randrange(1, 400)]))), rng.choice(names)) for i in range(1, 400)]
    return out + [(900, None, "a"), (901, "", "b"), (902, " \t\n\x0b ", "zz"), (903, "long " * 50_000, "src0"), (904, None, "only nulls"), (905, "x y", "tiny"), (7, "three more words", "src0"), (7, "three more words", "src0")]


@pytest.mark.parametrize("sent", [100_000, 0])
def test_mixture_matches_exact_arithmetic(spark, rows, monkeypatch, sent):
    monkeypatch.setattr(mixture, "SENT_ROWS", sent)
    # one document for each id and source: the source is read back by it
    seen, unique = set(), []
    for i, t, s in rows:
        if i not in seen:
            seen.add(i)
            unique.append((i, t, s))
    source = {i: s for i, _, s in unique}
    got = [r.asDict() | {"source": source[r["doc_id"]]} for r in mixture.mix_counts(spark, docs(spark, unique)).collect()]
    check(unique, got)


def test_mixture_is_the_same_in_every_layout(spark, rows):
    one = mixture.mix_counts(spark, docs(spark, rows).coalesce(1)).collect()
    many = mixture.mix_counts(spark, docs(spark, rows[::-1]).repartition(9)).collect()
    assert Counter(map(tuple, one)) == Counter(map(tuple, many)) and len(one) == len(rows)
    assert one[0].asDict().keys() == {"doc_id", "size", "source_size", "target", "taken"}
    assert mixture.mix_counts(spark, docs(spark, [])).count() == 0
    empty = mixture.mix_counts(spark, docs(spark, [(1, None, None), (None, "", "a")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in empty] == [(0, 0.0, 0)] * 2


def test_mixed_gives_the_documents(spark, rows):
    some = docs(spark, [r for r in rows[:399]])
    counts = mixture.mix_counts(spark, some)
    made = mixture.mixed(some, counts)
    assert made.columns == some.columns
    want = {r["doc_id"]: r["taken"] // r["size"] for r in counts.collect() if r["taken"]}
    assert Counter(r["doc_id"] for r in made.select("doc_id").collect()) == Counter(want)
