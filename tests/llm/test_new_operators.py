"""Decontamination, tokenizer alignment and the prefix trie against brute force."""

import hashlib
import random
import re
import string
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lapsewise.llm import alignment, decontaminate, langid, prefix_trie
from lapsewise.llm.common import has_letter

NOTHING = hashlib.sha256(b"").hexdigest()


# -- decontamination ---------------------------------------------------------------------------------

def words_of(text):
    lowered = "".join(c.lower() if c in string.ascii_uppercase else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_find(docs, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i:i + n])].add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((doc_id, len(w), len(hit), len(found),
                    hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def found_rows(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in decontaminate.find(d, b, **more).collect()), key=str)


def test_decontamination_of_random_texts(spark):
    rng = random.Random(5)
    pool = ["a", "B", "c", "dé", "x1"]                      # few words: many chance hits, repeats and overlaps
    say = lambda n: rng.choice([" ", "\n", "-", ". "]).join(rng.choice(pool) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 3, 4, 5, 9]))) for i in range(9)]
    docs = [(i, say(rng.randrange(0, 60))) for i in range(60)]
    assert found_rows(spark, docs, items) == brute_find(docs, items)
    assert found_rows(spark, docs, items, window=4) == brute_find(docs, items, 4)


def test_decontamination_of_long_passages_in_blocks(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, item(rng.randrange(8, 40))) for i in range(40)]
    items += [(100, items[0][1]), (3, items[1][1].upper()), (None, items[2][1]), (200, ""), (201, None), (202, "…")]
    docs = [(i, item(rng.randrange(200))) for i in range(30)]
    for i in range(30):
        w = items[rng.randrange(43)][1].split()
        at = rng.randrange(max(1, len(w) - 12))
        docs.append((100 + i, item(20) + " " + ", ".join(w[at:at + rng.randrange(8, 14)]) + " " + item(20)))
    expected = brute_find(docs, items)
    assert any(r[5] for r in expected) and not all(r[5] for r in expected)
    assert found_rows(spark, docs, items) == expected
    assert found_rows(spark, docs, items, rows=50) == expected      # several blocks of the benchmark


def test_decontamination_of_odd_rows(spark):
    text = "one two three four five six seven eight nine ten eleven"
    docs = [(None, text), (1, None), (1, ""), (1, text), (1, text), (1, text + " x"), (2, "..."), (None, None),
            (3, ("q " * 30000) + text)]
    items = [(7, text), (7, "q q"), (8, text)]
    assert found_rows(spark, docs, items) == brute_find(docs, items)
    assert found_rows(spark, docs, []) == brute_find(docs, [])
    assert found_rows(spark, [], items) == []


def test_decontamination_ignores_other_columns(spark):
    d = spark.createDataFrame([(1, "a b c", 5, "h")], "doc_id long, text string, n_words int, h string")
    b = spark.createDataFrame([(1, "a b", "x", 2)], "item_id long, text string, win string, class int")
    assert [tuple(r)[:4] for r in decontaminate.find(d, b).collect()] == [(1, 3, 2, 1)]


# -- alignment ---------------------------------------------------------------------------------------

PATH_A, PATH_B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    sign = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}

    def spelled_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    def both(text):
        if not text:
            return [], []
        x = [(i, bytes(sign[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, spelled_b(i)) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (x, y) if b"".join(t for _, t in x) == whole == b"".join(t for _, t in y) else ([], [])
    return both


def brute_align(docs, both):
    held, made = defaultdict(set), []
    for k, (_, text) in enumerate(docs):
        a, b = both(text)
        groups, i, j, at, bt = [], 0, 0, 0, 0
        while i < len(a):
            ga, gb = [], []
            while True:
                if at <= bt and i < len(a):
                    at += len(a[i][1])
                    ga.append(a[i][0])
                    i += 1
                else:
                    bt += len(b[j][1])
                    gb.append(b[j][0])
                    j += 1
                if at == bt:
                    break
            groups.append((ga, gb))
        for ga, gb in groups:
            for x in ga:
                for y in gb:
                    held[x, y].add(k)
        made.append((len(a), len(b), groups))
    best = defaultdict(int)
    for (x, _), ks in held.items():
        best[x] = max(best[x], len(ks))
    out = []
    for (doc_id, _), (n_a, n_b, groups) in zip(docs, made, strict=True):
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        line = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(len(held[p]) == best[p[0]] for p in links),
                    sum(len(held[p]) for p in links), hashlib.sha256(line.encode()).hexdigest() if n_a else ""))
    return sorted(out, key=str)


ODD = [None, "", " ", "a  b", "x▁y", "\n\t tab", "<|endoftext|> and <s></s><0x0A>", "日本語のテキスト、漢字。", "😀😃 é́ ﬁ",
       "a\x00b", "don't won't I'll", "1234567890" * 20, "aaaa" * 50, "­​ zero", "ابجد هوز", " x", "x ", "\r\n\r\n"]


def aligned_rows(spark, docs, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted((tuple(r) for r in alignment.align(d, PATH_A, PATH_B, **more).collect()), key=str)


def test_alignment_against_brute_force(spark, tokenizers):
    rng = random.Random(2)
    parts = [t for t in ODD if t] + ["the", " thing", "straße", "ción", " über", "中", "ß", "\n", "  ", "x" * 30]
    docs = list(enumerate(ODD)) + [(100 + i, "".join(rng.choice(parts) for _ in range(rng.randrange(12))))
                                   for i in range(60)]
    docs += [(None, "the thing"), (5, "the thing"), (5, "the thing")]
    expected = brute_align(docs, tokenizers)
    assert sum(r[1] > 0 for r in expected) > 40 and sum(r[1] == 0 for r in expected) > 2
    assert aligned_rows(spark, docs) == expected
    assert aligned_rows(spark, docs, head=20) == expected       # most counts come by the join
    assert aligned_rows(spark, docs, head=1) == expected
    assert aligned_rows(spark, []) == []


def test_alignment_of_wide_groups_and_long_texts(spark, tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "WIDE", 1)
    aligner = alignment.Aligner(*(open(p, "rb").read() for p in (PATH_A, PATH_B)))
    texts = [t.encode() for t in ODD if t] + [("word and so on. " * 40000).encode()]
    made = aligner.align(texts)
    monkeypatch.undo()
    for one, other in zip(made, alignment.Aligner(*(open(p, "rb").read() for p in (PATH_A, PATH_B))).align(texts),
                          strict=True):
        assert one[:5] == other[:5] and (one[5] == other[5]).all() and (one[6] == other[6]).all()


def test_shared_cuts_of_random_ends():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, m = rng.integers(1, 60, 2)
        size = int(rng.integers(max(n, m), 200))
        a = np.unique(np.append(rng.choice(size, n, False) + 1, size + 1))
        b = np.unique(np.append(rng.choice(size, m, False) + 1, size + 1))
        cuts = alignment.shared_cuts(a, b, np.array([0]), np.array([len(a) - 1]))
        assert a[cuts].tolist() == np.intersect1d(a, b)[:-1].tolist()


# -- prefix trie -------------------------------------------------------------------------------------

def brute_nodes(turns):
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(x)] for c, x in own.items()}
    convs = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        home = c - (c % 100 if c >= 0 else -(-c % 100))
        convs[c] = own.get(home, [])[:h] + t[h:]
    members = defaultdict(list)
    for c, s in convs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    saved = {p: (len(m) - 1) * len(p[-1][1]) if p else 0 for p, m in members.items()}
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    total, leaves = defaultdict(int), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            total[p[:d]] += saved[p]
            leaves[p[:d]] += children[p] == 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], total[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)).encode()).hexdigest())
                  for p, m in members.items())


def node_rows(spark, turns, **more):
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    return sorted(tuple(r) for r in prefix_trie.nodes(prefix_trie.rebuilt(d), **more).collect())


def conversations(seed, n, say):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]) if t % 3 == 2 else "user", say(rng, t))
            for c in range(n) for t in range(rng.randrange(1, 9))]


@pytest.mark.parametrize("limit", [2, 20, 1000])
def test_trie_of_random_conversations(spark, limit):
    turns = conversations(3, 230, lambda rng, t: "x" * rng.randrange(1, 3))
    # a third is one conversation, longer than any other
    turns += [(c, t, "user", "x" * t) for c in range(1000, 1100) for t in range(12)]
    assert node_rows(spark, turns, limit=limit) == brute_nodes(turns)


def test_trie_of_odd_rows(spark):
    turns = [(1, None, "u", "first"), (1, 0, None, None), (1, 0, "a", "x"), (1, 0, "a", "x"), (1, 5, "", "é😀"),
             (0, 3, "u", "z"), (0, 2, "u", "y"), (None, 1, "u", "gone"), (-5, 1, "u", "y"), (250, 0, "u", "alone"),
             (7, 1, "u", "y" * 70000), (8, 1, "u", ""), (9, 1, None, "")]
    for limit in (1, 100):
        assert node_rows(spark, turns, limit=limit) == brute_nodes(turns)
    assert node_rows(spark, []) == []
    assert node_rows(spark, [(None, 1, "u", "x")]) == []


def test_long_id_lists_are_digested_in_runs(spark, monkeypatch):
    ids = list(range(0, 60000, 3))
    ends = spark.createDataFrame([("k", i) for i in reversed(ids)] + [("j", 4)], "key string, conv_id long")
    got = {r["key"]: r["ends_sha256"] for r in prefix_trie.id_digests(ends).collect()}
    assert got == {"k": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                   "j": hashlib.sha256(b"4").hexdigest()}


def test_trie_ignores_other_columns(spark):
    d = spark.createDataFrame([(1, 0, "u", "t", "a", 3)],
                              "conv_id long, turn long, role string, text string, home string, ids int")
    assert prefix_trie.nodes(prefix_trie.rebuilt(d.withColumn("t", F.lit(1)))).count() in (1, 2)



# -- language: letters and the sample ----------------------------------------------------------------

def test_numerals_are_no_letters():
    for t in ("½", "²", "①", "Ⅷ", "٣", "12 + 3", "_", "", "…"):
        assert not has_letter(t.encode()), t
    for t in ("ª", "中", "½ x", "Ⅷ²é", "ا"):
        assert has_letter(t.encode()), t


def test_copies_do_not_crowd_out_a_language(spark, monkeypatch):
    """A text of a great many copies counts once; more languages than rows of the sample are all learnt."""
    say = {"en": "the house and the garden are old", "de": "das haus und der garten sind alt",
           "fr": "la maison et le jardin sont vieux"}
    rows = [(i, "the copy of the copy", "en") for i in range(3000)]
    rows += [(5000 + 10 * i + j, f"{t} {i}", lang) for i in range(40) for j, (lang, t) in enumerate(say.items())]
    rows += [(9000 + i, f"{w} {w} {w}", f"x{i}") for i, w in enumerate(("zzyq", "qqrv", "vvkj"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 5)
    learnt = langid.fit(docs, F.col("doc_id") >= 0).langs
    assert {lang for own in learnt.values() for lang in own} == {*say, "x0", "x1", "x2"}
    monkeypatch.undo()
    model = langid.fit(docs, F.col("doc_id") >= 0)
    new = spark.createDataFrame([(lang, t) for lang, t in say.items()], "own string, text string")
    assert all(r["own"] == r["lang_pred"] for r in langid.identify(new, model, ["own"]).collect())
