"""Licence scans against a scan of every block, and of every place."""

import random
import re

import pytest

from pepspark.llm import licenses
from pepspark.llm.licenses import Templates

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, row long, block long, tokens array<int>, n_words string, `a.b` string"


def expect(rows, templates=licenses.LICENSES):
    out = []
    for doc, text in rows:
        words = WORD.findall((text or "").translate(LOWER))
        starts, base, labels, score = [], set(), set(), 0.0
        for phrase, label in templates.phrases.items():
            p = phrase.split()
            here = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            starts += here
            if here:
                base.add(label)
                score = 1.0
        for notice, label in templates.notices.items():
            wanted = set(notice.split())
            for at in range(0, len(words), templates.block):
                share = len(wanted & set(words[at : at + templates.reach()])) / len(wanted)
                if share * 100 >= templates.percent - 1e-9:
                    labels.add(label)
                    score = max(score, share)
        first, last = (min(starts), max(starts)) if starts else (None, None)
        out.append((doc, len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), score))
    return sorted(out, key=str)


def scanned(spark, rows, *args):
    df = spark.createDataFrame([(i, t, 1, 2, [3], "n", "x") for i, t in rows], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in licenses.scan(df, *args).collect()), key=str)


def made(seed, n):
    rng = random.Random(seed)
    phrases, notices = list(licenses.PHRASES), list(licenses.NOTICES)
    common = ["the", "is", "of", "license", "LICENSE", "by", "cc", "mit", "gnu", "General", "public", "Apache", "under", "ä", "été", "x1", "\x7f", "--"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.choice([0, 1, 3, 30])):
            kind = rng.randrange(6)
            if kind == 0:
                parts.append(rng.choice(["Apache\nLicense", "CC-BY", "cc by", *phrases]))
            elif kind == 1:
                words = rng.choice(notices).split()
                parts += [w for w in words if rng.random() < 0.9] if rng.random() < 0.7 else rng.sample(words, len(words))
            else:
                parts += rng.choices(common, k=rng.choice([1, 10, 60]))
        rows.append((rng.choice([i, i, None]), rng.choice([" ", ". ", "\n"]).join(parts)))
    return rows


def test_scan_equals_brute_force(spark):
    rows = made(1, 150) + [(1000, None), (1001, ""), (1002, " \n-"), (1003, "MIT License"), (1003, "MIT License"), (1004, "mit license " * 3000)]
    rows += [(1005, "w " * 62 + "the gnu general public license of"), (1006, "ß" * 300_000 + " cc by"), (1007, "gnu general public x license"), (1008, "cc by cc by-mit")]
    assert scanned(spark, rows) == expect(rows)
    assert scanned(spark, []) == []


def test_other_templates(spark):
    """Repeated words in a phrase, overlapping places, blocks shorter than the templates, every share."""
    rows = [(i, " ".join(random.Random(i).choices("abcde", k=random.Random(i).choice([0, 1, 2, 5, 40])))) for i in range(80)]
    for percent, block in ((100, 1), (60, 3), (34, 7)):
        own = Templates({"a b a": "aba", "c c": "cc", "d": "d"}, {"a b c d e": "all", "e a": "ea"}, percent, block)
        assert scanned(spark, rows, own) == expect(rows, own)


def test_words_from_pieces():
    raw = b"ab  cd-ef " + "éa".encode() * 50 + b" z" * 40
    for most in (1, 2, 3, 7, 1000):
        assert [w for part in licenses.word_lists(raw, most) for w in part] == licenses.WORD.findall(raw)


def test_bad_templates():
    for bad in (dict(phrases={"": "x"}, notices={}), dict(phrases={"a": "x"}, notices={}, percent=0), dict(phrases={" ".join(f"w{i}" for i in range(20_001)): "x"}, notices={})):
        with pytest.raises(ValueError):
            Templates(**bad)
