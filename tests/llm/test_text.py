"""Packing, toxicity, language, chat format and SentencePiece."""

import bisect
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pepspark.llm import chat, language, packing, sentencepiece, toxicity
from pepspark.llm.common import bounded_sample
from pepspark.llm.queries import CONFLICT, vocabulary

SCHEMA = "doc_id long, text string"


def test_bounded_sample(spark):
    rows = spark.createDataFrame([("a", i) for i in range(500)] + [("b", i) for i in range(5)] + [(None, 1)], "k string, id long")
    got = [tuple(r) for r in bounded_sample(rows, "k", "id", 50).groupBy("k").count().collect()]
    assert sorted(got) == [("a", 50), ("b", 5)]


# --- packing -------------------------------------------------------------

TEXTS = ["", "Hello, World!", "don't stop", "ÀÉÎ ñandú œuf ŒUF", "İstanbul ΣΑΣ ς", "a\x1cb\x85c d e", "é ́x", "汉字 مرحبا", "<|endoftext|> x<|startoftext|>y", "1234 5,678.90", "x" * 3000, "🙂🙂 ok", "it's  \n\t we'll"]


def test_word_memo_is_the_tokenizer():
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    whole, words = Tokenizer.from_file(path), packing.WordTokenizer(path, most=3)
    random.seed(4)
    alphabet = "abcXYZéÉßñ'.,!?;- \n\t09_<|>́汉\x1c "
    for text in [*TEXTS, *("".join(random.choices(alphabet, k=random.randint(0, 60))) for _ in range(400))]:
        assert np.frombuffer(words.encode(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_plan_is_whole_and_tight():
    random.seed(1)
    for capacity in (10, 64):
        histogram = {n: random.randint(1, 300) for n in random.sample(range(1, capacity + 1), capacity // 2)}
        used, ranks = {}, {n: [] for n in histogram}
        for length, first, count, sequence, each, offset in packing.plan(histogram, capacity):
            for k in range(count):
                start = offset + k % each * length
                used.setdefault(sequence + k // each, []).append((start, start + length))
                ranks[length].append(first + k)
        assert all(sorted(ranks[n]) == list(range(c)) for n, c in histogram.items())
        for spans in used.values():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] <= capacity
            assert all(a[1] == b[0] for a, b in itertools.pairwise(spans))
        room = []  # best fit, longest first, one piece at a time
        for length in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
            at = bisect.bisect_left(room, length)
            bisect.insort(room, (room.pop(at) if at < len(room) else capacity) - length)
        assert len(used) == len(room)


def test_pack(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (None, "null id"), (1, "Hello, World!"), (60, "word " * 100)] + [(100 + i, "same length") for i in range(200)]
    got = packing.pack(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", piece int, rank int").repartition(6), path, capacity=32).collect()
    used, by_doc = {}, {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 32 and all(a[1] == b[0] for a, b in itertools.pairwise(spans))
    for doc, text in dict(rows).items():
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        mine = sorted(by_doc[doc], key=lambda r: (r.start, r.sequence_id))
        copies = sum(1 for r in rows if r[0] == doc)
        assert len(mine) == copies * -(-len(ids) // 32)
        for r in mine:
            assert r.start == 32 * r.piece and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert packing.pack(spark.createDataFrame([], SCHEMA), path).count() == 0


# --- toxicity ------------------------------------------------------------


def maximal(scores):
    """By definition: the best segment, then the same left and right of it."""
    best = None
    for a in range(len(scores)):
        for b in range(a, len(scores)):
            total = sum(scores[a : b + 1])
            if total > 0 and (best is None or total > best[0] + 1e-12):
                best = (total, a, b)
    if best is None:
        return []
    total, a, b = best
    shift = lambda parts: [(x + b + 1, y + b + 1) for x, y in parts]
    return maximal(scores[:a]) + [(a, b)] + shift(maximal(scores[b + 1 :]))


def test_segments():
    random.seed(7)
    for _ in range(1500):
        rest = -random.choice([1.0, 2.0, 3.0])
        scores = [random.choice([rest, rest, random.randint(1, 6) + random.random()]) for _ in range(random.randint(0, 12))]
        hits = [(i, x) for i, x in enumerate(scores) if x > 0]
        assert [(a, b) for a, b, _ in toxicity.segments(hits, rest)] == maximal(scores)


def test_toxicity(spark):
    random.seed(3)
    clean = [f"plain{i}" for i in range(400)]
    toxic = ["vilex", "grubbo", "snarfle"]
    rows, labels = [], []
    for i in range(400):
        words = random.choices(clean, k=random.randint(5, 120))
        bad = i % 4 == 0
        for _ in range(3 * bad):
            words[random.randrange(len(words))] = random.choice(toxic) + random.choice(["", "ly", "ness", "$$$"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "plain1 " * 20_000), (1003, "plain1 " * 500 + "vilex grubbo " + "plain2 " * 500), (None, "snarfle vilexing"), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame([x for x in labels if x[0] % 3] + [(None, 1), (5000, None)], "doc_id long, label int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    right = [(got[i].score >= 0.3) == bool(y) for i, y in labels if i % 3 == 0]
    assert np.mean(right) > 0.97 and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].score >= 0.3 for i in (1000, 1001, 1002, 1003, None)] == [False, False, False, True, True]
    span = got[1003].segments[0]
    assert (span.first_token, span.last_token) == (500, 501) and span.expected < 1
    extra = docs.withColumns({"surprise": F.lit(1), "label": F.lit("x")})
    kept = toxicity.clean_rows(extra, model)
    assert kept.columns == extra.columns and kept.count() == sum(got[i].score < 0.3 for i, _ in rows)
    nothing = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, label int"))
    assert {r.score < 1e-6 for r in toxicity.score(docs, nothing).collect()} == {True}
    assert toxicity.score(spark.createDataFrame([], SCHEMA), model).count() == 0


# --- language ------------------------------------------------------------


@pytest.mark.parametrize("count", [2, 4, 7, 8, 20])
def test_codewords_are_apart(count):
    code = language.codewords(count).astype(int)
    least = min((code[a] != code[b]).sum() for a, b in itertools.combinations(range(count), 2))
    assert len(code) == count and least >= code.shape[1] // 2


def test_language(spark):
    random.seed(5)
    stems = {"aa": ["ka", "ki", "mo"], "bb": ["str", "eck", "ung"], "cc": ["ção", "lhe", "ñor"]}
    word = lambda k: "".join(random.choices(stems[k], k=random.randint(1, 4)))
    rows = [(i, " ".join(word(k) for _ in range(random.randint(8, 60))), k, 9) for i in range(300) for k in [random.choice(sorted(stems))]]
    more = [(900, None, "aa", 1), (901, "", None, 1), (902, "12 ;; 34", "bb", 1), (903, "kaki " * 30_000, None, 1), (None, "strung eckung", None, 1)]
    docs = spark.createDataFrame(rows + more, SCHEMA + ", lang string, row int")
    model = language.fit(docs.filter("doc_id % 3 > 0"), most=60)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert np.mean([got[i].lang_pred == k for i, _, k, _ in rows if i % 3 == 0]) > 0.97
    assert [got[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "aa", "bb"]
    assert got[900].score == 0 and got[900].ambiguous and all(0 <= r.score <= 1 for r in got.values())
    none = language.fit(docs.filter("false"))
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}
    assert language.predict(docs.filter("false"), model).count() == 0


# --- chat ----------------------------------------------------------------


def test_chat_round_trip(spark):
    random.seed(6)
    bits = ["\\", "</turn>", "\n", "### ", "Assistant", ": ", "user", "é", "🙂", "x", "</turn", ">", "\\/", "#"]
    roles = ["user", "assistant", "system", "Assistant", "User", "tool: x", "a\\b", "", None, "x:", "</turn>\n", "\\Assistant"]
    rows = []
    for conv in range(120):
        for turn in range(random.randint(1, 5)):
            role = random.choice(roles if conv % 2 else roles[:3])
            rows.append((conv, turn, role, "".join(random.choices(bits, k=random.randint(0, 9))) if random.random() > 0.05 else None))
    rows += [(-7, 0, "user", CONFLICT), (-7, 1, "assistant", CONFLICT), (500, 1, "user", "b"), (500, 1, "user", "a"), (500, 1, "user", "a"), (500, None, "user", "n"), (None, 0, "assistant", "q")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, pieces int").repartition(3)
    formatted = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    digest = {r.conv_id: r for r in chat.digests(formatted).collect()}
    whole = {r.conv_id: r for r in formatted.collect()}
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by_conv)
    for conv, turns in by_conv.items():
        turns.sort()
        assert [(t.role, t.text) for t in got[conv].turns] == [t[2:] for t in turns]
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        assert got[conv].loss_text == loss
        lines = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        assert tuple(digest[conv])[1:] == (len(turns), hashlib.sha256(lines.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole[conv].formatted))
    assert whole[-7].n_escaped == 2 and whole[500].n_escaped == 0
    assert chat.digests(chat.format_conversations(df.filter("false"))).count() == 0


# --- SentencePiece ---------------------------------------------------------


def test_sentencepiece_is_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    path = vocabulary("piece_bpe_32k.model")
    model, pieces = SentencePieceProcessor(model_file=path), sentencepiece.piece_table(spark, path)
    random.seed(8)
    alphabet = "ab c  dé▁xyzthe①\n\tÑñ漢字🙂.,<>/ing"
    rows = [(i, "".join(random.choices(alphabet, k=random.randint(0, 60)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "x" * 5000 + "hello" * 50), (903, "   "), (904, "\x00a"), (905, "a" * 17 + " " * 40 + "b"), (906, "<0x41><s> </s>"), (907, "the " * 20_000)]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "row long, text string, word string, at int")
    ids = sentencepiece.encode(df, pieces, "row")
    got = {r.row: list(r.ids) for r in ids.collect()}
    assert all(got[i] == model.encode(t or "") for i, t in rows)
    back = {r.row: r.text for r in sentencepiece.decode(spark.createDataFrame(list(got.items()), "row long, ids array<int>"), pieces, "row").collect()}
    assert all(back[i] == model.decode(got[i]) for i, _ in rows)
    assert sentencepiece.encode(df.filter("false"), pieces, "row").count() == 0


def test_viterbi(spark):
    random.seed(9)
    scores = {p: math.log(random.random()) for p in ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "ca", "cab", "bca", "▁ab"]}
    table = [(k, p, s, None) for k, (p, s) in enumerate(scores.items())] + [(100 + k, None, None, k) for k in range(256)]
    pieces = spark.createDataFrame(table, "id int, piece string, score double, byte int")

    def best(word):
        ways = []
        for r in range(len(word)):
            for inner in itertools.combinations(range(1, len(word)), r):
                parts = [word[a:b] for a, b in itertools.pairwise([0, *inner, len(word)])]
                if all(p in scores or len(p) == 1 for p in parts):
                    ways.append((sum(scores.get(p, -1e6) for p in parts), parts))
        return max(ways)[1]

    words = sorted({"".join(random.choices("abcz", k=random.randint(1, 8))) for _ in range(50)} | {"▁abc", "▁aab"})
    got = sentencepiece.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), pieces, "viterbi").collect()
    ids = {p: k for k, p, _, _ in table if p}
    for r in got:
        assert list(r.ids) == [ids.get(p, 100 + ord(p[0])) for p in best(r.word)]
