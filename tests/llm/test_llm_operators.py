"""The training-data operators against public libraries, brute force and edge cases."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lapsewise.llm import (byte_bpe, fingerprints, jaccard_join, langid, packing, ppm, quality, queries,
                           token_store, toxicity, url_filter)
from lapsewise.llm.common import Words, fold
from lapsewise.llm.vocab import Vocabulary, read_vocabulary
from lapsewise.session import scratch_path

SMOKE = "/root/testdata/sf0.001"
MULTI, JSON50 = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, table string"
ODD = [
    (1, "the cat sat on the mat and the dog sat on the log by the sea", "en", "a", 1, 0.5, "x"),
    (2, None, None, None, None, None, None),
    (3, "", "en", "a", 0, 0.1, "x"),
    (4, " \n\t  ", "en", "b", 5, 0.1, "x"),
    (5, "word " * 30_000, "en", "b", 150_000, 0.1, "x"),
    (6, "x" * 120_000, "de", "b", 120_000, 0.1, "x"),
    (7, "the cat sat on the mat and the dog sat on the log by the sea", "en", "c", 1, 0.5, "y"),
    (7, "the cat sat on the mat and the dog sat on the log by the sea", "en", "c", 1, 0.5, "y"),
    (8, "Grüße  aus\n\nKöln, 中文 😀 ١٢ it's\u3000x\x1c", "de", "c", 9, None, None),
    (9, "!!! 123 ???", None, "c", 11, None, None),
    (None, "a text without a key. it has two sentences.", "en", None, 3, 0.0, "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def smoke(spark):
    return spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text").collect()


def random_texts(n, seed=1):
    rng = random.Random(seed)
    signs = "ab \n\téßüñ'sre\u3000\x1c\u200b中文😀١٢#$%ngthe  "
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(n)]


# -- words ----------------------------------------------------------------------------------------

def test_words_are_runs_without_ascii_space():
    texts = [t.encode() for t in random_texts(400)] + [b"", b" ", b"a" * 3_000_000 + b" b"]
    w = Words(texts, lower=True)
    got = [bytes(w.buf[a:b]) for a, b in zip(w.start, w.end)]
    assert got == [x for t in texts for x in t.lower().split()]
    assert len(set(w.hash.tolist())) == len(set(got))
    assert [b - a for a, b in zip(w.first, w.first[1:])] == [len(t.split()) for t in texts]


# -- op1 ------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def codec():
    blob = byte_bpe.read_ranks(MULTI)
    ranks = byte_bpe.parse_ranks(blob)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return byte_bpe.TextEncoder(ranks, P.PATTERN), byte_bpe.Decoder(ranks), own


def test_transducer_gives_the_librarys_ids(codec, smoke):
    encoder, _, own = codec
    texts = [r["text"] for r in smoke] + random_texts(3000) + ["ththnderedhe" * 2000, "", " " * 5000]
    assert [x.tolist() for x in encoder(texts)] == [own.encode_ordinary(t) for t in texts]


def test_transducer_starts_anew_when_its_table_is_full(codec, smoke):
    encoder, _, own = codec
    small = byte_bpe.TextEncoder(encoder.machine.ranks, P.PATTERN)
    small.machine.limit = 50
    for r in smoke[:30]:
        assert small([r["text"]])[0].tolist() == own.encode_ordinary(r["text"])


def test_decoder_takes_ids_in_pieces_and_replaces_bad_bytes(codec):
    encoder, decoder, own = codec
    for t in random_texts(300, 5):
        ids = encoder([t])[0]
        got = "".join(decoder.feed(ids[i:i + 1]) for i in range(len(ids))) + decoder.close()
        assert got == t
    rng = random.Random(3)
    for _ in range(300):
        ids = np.array([rng.randrange(256) for _ in range(rng.randint(0, 8))])
        raw = decoder.to_bytes(ids.tolist())
        got = "".join(decoder.feed(ids[i:i + 2]) for i in range(0, len(ids), 2)) + decoder.close()
        assert got == raw.decode("utf-8", "replace")


@pytest.mark.parametrize("template", ["{}'s", "a{}1 {}{} ", "1{}b\n{}  {}", "'{}ll {}'"])
def test_every_code_point_is_split_as_the_library_does(codec, template):
    encoder, _, own = codec
    some = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x34000), *range(0xE0000, 0xE0200))]
    for at in range(0, len(some), 4096):
        texts = [template.replace("{}", c) for c in some[at:at + 4096]]
        assert [ids.tolist() for ids in encoder(texts)] == own.encode_ordinary_batch(texts)


def test_long_matches_emit_tokens_as_soon_as_they_are_certain(codec):
    encoder, _, own = codec
    machine, rng = encoder.machine, random.Random(8)
    longest = int(machine.lengths.max())
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(20_000)), "a" * 9_000, "antidis" * 3_000,
             "".join(rng.choice("\u4e2d\u6587\u5b57\u00e9a") for _ in range(5_000)), "=" * 7_001, ""]
    for word in words:
        raw, said, held = word.encode(), [], 0

        def fed():
            nonlocal held
            for i in range(len(raw)):
                held = max(held, i - done)
                yield raw[i:i + 1]

        done = 0
        for some in machine.stream(fed()):
            said += some
            done += sum(machine.length[v] for v in some)
        assert said == own.encode_ordinary(word)
        assert held <= 3 * longest


def test_round_trip_of_odd_rows(codec, odd, none):
    own = codec[2]
    rows = byte_bpe.round_trip(odd, MULTI, P.PATTERN, ["doc_id", "table"]).collect()
    assert len(rows) == len(ODD)
    want = sorted((str(r[0]), hashlib.sha256((r[1] or "").encode()).hexdigest(),
                   hashlib.sha256(",".join(map(str, own.encode_ordinary(r[1] or ""))).encode()).hexdigest())
                  for r in ODD)
    assert sorted((str(r["doc_id"]), r["decoded_sha256"], r["ids_sha256"]) for r in rows) == want
    assert byte_bpe.round_trip(none, MULTI, P.PATTERN, ["doc_id"]).count() == 0


# -- op2 ------------------------------------------------------------------------------------------

def test_vocabulary_gives_the_librarys_ids(smoke):
    own, library = Vocabulary(read_vocabulary(JSON50)), Tokenizer.from_file(JSON50)
    for t in [r["text"] for r in smoke[:60]] + random_texts(800, 9):
        assert own.encode(t.encode()).tolist() == library.encode(t, add_special_tokens=False).ids


END = "<|endoftext|>"
MARKED = [END, f"a{END}b", f"a {END} b", f"{END}{END}\n{END}", f"it{END}'s  {END}  x{END}", f"<{END}>", END[:-1],
          END.upper(), f"中文{END}é", f"Ends. {END}", f"\t{END}\u3000{END[1:]}{END[:5]}"]


def test_vocabulary_knows_added_tokens_inside_texts(spark, tmp_path):
    own, library = Vocabulary(read_vocabulary(JSON50)), Tokenizer.from_file(JSON50)
    rng = random.Random(6)
    texts = MARKED + ["".join(rng.choice([END, *random_texts(3, i)]) for _ in range(6)) for i in range(200)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for t, ids in zip(texts, want, strict=True):
        assert own.encode(t.encode()).tolist() == ids
    assert want[1] == [64, 50256, 65]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = str(tmp_path / "tokens")
    token_store.write_tokens(docs, JSON50, out)
    assert {r["doc_id"]: r["ids"][:-1] for r in token_store.read_tokens(spark, out).collect()} == dict(enumerate(want))
    packed: dict = {}
    for r in sorted(packing.pack(docs, JSON50, with_ids=True).collect(), key=lambda r: (r["doc_id"], r["start"])):
        packed.setdefault(r["doc_id"], []).extend(r["ids"])
    assert {k: v[:-1] for k, v in packed.items()} == dict(enumerate(want))


def plan_cost(ends, fee, length):
    """Cost of given sequence ends under the program's prices."""
    return sum(packing.padding(b - a, length) + packing.EACH + fee.get(b, packing.ANYWHERE)
               for a, b in zip([0, *ends], ends))


def test_cuts_are_no_worse_than_any_plan_over_the_same_cuts():
    rng = np.random.default_rng(4)
    for _ in range(80):
        total = int(rng.integers(1, 160))
        position = np.unique(np.append(rng.integers(1, total + 1, rng.integers(4, 40)), total))
        penalty = rng.choice([0, packing.SENTENCE], len(position))
        got = packing.cuts(position, penalty, 32)
        assert got[-1] == total and all(0 < b - a <= 32 for a, b in zip([0, *got], got))
        fee = dict(zip(position.tolist(), penalty.tolist()))
        gaps = zip([0, *position.tolist()], position.tolist())
        fee.update({p: packing.ANYWHERE for a, b in gaps for p in range(a + 32, b, 32)})
        fee[total] = 0
        nodes = [0, *sorted(fee)]
        best = {0: 0}
        for i in nodes[1:]:                     # every window between two cuts, or two with a full first one
            ways = []
            for j in nodes[: nodes.index(i)]:
                if i - j <= 32:
                    ways.append(best[j] + packing.padding(i - j, 32) * (i - j >= 8 or i - j == 32)
                                + (32 - (i - j)) * (i - j < 8) + packing.EACH)
                elif i - j <= 64:
                    ways.append(best[j] + 64 - (i - j) + packing.ANYWHERE + 2 * packing.EACH)
            best[i] = min(ways) + fee[i]
        assert plan_cost(got, fee, 32) <= best[total]


def check_pieces(rows, texts):
    library = Tokenizer.from_file(JSON50)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for key, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(by_doc[key], key=lambda r: r["start"]):
            own = np.array(ids[at:at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(own), len(ids))
            at += r["length"]
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padded = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        padded += packing.padding(at, 1024)
        total += at
    return padded / total


def test_packing_keeps_every_id_once_with_little_padding(spark):
    rows = queries.op2_packing(spark, SMOKE).collect()
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").collect()
    assert check_pieces(rows, {r["doc_id"]: r["text"] for r in docs}) < 0.02


def test_packing_of_odd_rows(odd, none):
    rows = packing.pack(odd, JSON50).collect()
    once = [r for r in rows if r["doc_id"] != 7]
    assert sum(r["length"] for r in rows if r["doc_id"] == 7) == 2 * [
        r["doc_tokens"] for r in rows if r["doc_id"] == 7][0]
    check = {r[0]: r[1] or "" for r in ODD if r[0] != 7}
    assert {r["doc_id"] for r in once} == set(check)
    assert packing.pack(none, JSON50).count() == 0


# -- op3 ------------------------------------------------------------------------------------------

def test_network_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in toxicity.new_net(rng).items()}
    x = rng.normal(size=(7, 2 * toxicity.DIM, 3))
    valid = np.ones((7, 3), bool)
    valid[5:, 1] = False
    kept = {}
    weight = rng.normal(size=3)
    toxicity.forward(net, x, valid, kept)
    grads, d_x = toxicity.backward(net, kept, weight)
    for key in net:
        flat = net[key].reshape(-1)
        for i in rng.integers(0, flat.size, 3):
            old = flat[i]
            flat[i] = old + 1e-3
            up = toxicity.forward(net, x, valid) @ weight
            flat[i] = old - 1e-3
            down = toxicity.forward(net, x, valid) @ weight
            flat[i] = old
            assert grads[key].reshape(-1)[i] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-3)


def test_windows_cover_all_words():
    first = np.array([0, 0, 10, 10 + 64, 10 + 64 + 200])
    rows, of = toxicity.windows(first, 10_000)
    assert set(of) == {1, 2, 3}
    assert set(rows[rows < 10_000]) == set(range(first[-1]))
    for k in range(rows.shape[1]):
        own = rows[:, k][rows[:, k] < 10_000]
        assert own.min() >= first[of[k]] and own.max() < first[of[k] + 1]


def test_toxicity_learns_and_scores_odd_rows(spark, odd, none):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        own = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                own[rng.randrange(len(own))] = rng.choice(["vileword", "zorgstem" + rng.choice("abcde")])
        rows.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known, fold(F.col("doc_id"), 5) != 0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.93
    odd_scores = toxicity.score(odd, model, ["doc_id", "table"], name="t").collect()
    assert len(odd_scores) == len(ODD) and all(0 <= r["t"] <= 1 for r in odd_scores)
    assert toxicity.score(none, model, ["doc_id"]).count() == 0
    blank = toxicity.fit(none, known, F.lit(True))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs.limit(5), blank, ["doc_id"]).collect())


# -- op4 ------------------------------------------------------------------------------------------

def brute_groups(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            ids[find(i)] = min(ids.get(find(i), key), key)
    return sorted((str(k), len(s), str(ids.get(find(i)) if s else k)) for i, ((k, _), s) in enumerate(
        zip(rows, sets)))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def test_groups_match_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(500)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows, key = [], 1000
    for size in (1, 1, 2, 5, 40, 90):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 60, 150]))]
        for _ in range(size):
            rows.append((key, " ".join(edited(rng, base, rng.choice([0, 0, 1, 2, 3, 5])))))
            key -= 1
    for _ in range(60):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(10, 60))]
        rows.append((key, " ".join(own + passage)))
        key -= 1
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one two"), (5004, "ONE  two"), (5005, "two one"),
             (5003, "one two"), (None, "one two"), (None, "only here is this text found")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard_join.join_groups(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_groups(rows)


def copies(seed, n):
    """Edited copies of two texts that share a part, and of each other's copies."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(70)]
    other = base[:50] + [rng.choice(vocabulary) for _ in range(25)]
    return [(i, " ".join(edited(rng, base if i % 3 else other, rng.choice([0, 1, 1, 2, 3, 4])))) for i in range(n)]


@pytest.mark.parametrize("bits", [0, 2, 4])
def test_groups_of_lists_in_blocks(spark, monkeypatch, bits):
    monkeypatch.setattr(jaccard_join, "LIST_BITS", bits)
    rows = copies(bits, 150) + [(9000, None), (9001, "one two"), (None, "one two")]
    got = jaccard_join.join_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_groups(rows)


def test_no_task_holds_a_whole_long_list(spark, monkeypatch):
    held, bits = spark.sparkContext.accumulator(0), 4
    make = jaccard_join.by_list

    def watched(rows, of, schema, then, *keys):
        def seen(columns, starts):
            held.add(int((np.diff(starts) > 8 << bits).sum()))
            return of(columns, starts)
        return make(rows, seen, schema, then, *keys)

    monkeypatch.setattr(jaccard_join, "LIST_BITS", bits, raising=False)
    monkeypatch.setattr(jaccard_join, "by_list", watched)
    docs = spark.createDataFrame(copies(1, 600), "doc_id long, text string").repartition(5)
    assert jaccard_join.join_groups(docs).count() == 600
    assert held.value == 0


@pytest.mark.parametrize("cell", [300, 2000])
def test_groups_of_cells_in_blocks(spark, monkeypatch, cell):
    monkeypatch.setattr(jaccard_join, "CELL", cell)
    rows = copies(3, 120)
    got = jaccard_join.join_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_groups(rows)


def test_rows_written_for_a_group_grow_with_its_members(spark, monkeypatch):
    """Copies of 200 words with 6 changed in each: few link, and all share lists."""
    make, made = jaccard_join.written, {}

    def counted(df, name):
        out = make(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join, "written", counted)
    rng = random.Random(5)
    base = [f"v{rng.randrange(300)}" for _ in range(200)]
    rows = [(i, " ".join(edited(rng, base, 6))) for i in range(800)]
    seen = []
    for n in (200, 400, 800):
        made.clear()
        jaccard_join.join_groups(spark.createDataFrame(rows[:n], "doc_id long, text string")).count()
        seen.append((made["asking"], made["links"]))
        assert made["asking"] <= 20 * n and made["links"] < n
    assert seen[2][0] <= 6 * max(seen[0][0], 200) and seen[2][1] <= 6 * max(seen[0][1], 20)


def test_postings_without_a_partner_are_skipped():
    rng = np.random.default_rng(3)
    for _ in range(200):
        length = int(rng.integers(2, 9))
        n = np.sort(rng.integers(5, 15, length))
        reach = rng.integers(3, 18, length)
        want = [any(n[j] <= reach[i] and n[i] <= reach[j] for j in range(length) if j != i) for i in range(length)]
        assert jaccard_join.partnered(n, reach, np.zeros(length, np.int64)).tolist() == want
    for n in range(1, 60):
        for at in range(n):
            m = int(jaccard_join.reachable(n, np.array([at]))[0])
            assert m < 1 or jaccard_join.needed(np.array([n]), np.array([m]))[0] <= n - at
            assert jaccard_join.needed(np.array([n]), np.array([max(m, 0) + 1]))[0] > n - at


def test_answers_derived_from_the_pivot():
    rng = np.random.default_rng(7)
    pool = np.unique(rng.integers(0, 1 << 63, 90, dtype=np.uint64))
    head = pool[:60]
    sets = [np.sort(rng.choice(pool, int(rng.integers(30, 80)), replace=False)) for _ in range(40)]
    rows = [({"role": jaccard_join.ASKED if i < 25 else jaccard_join.ASKING, "s": i, "class": i}, s)
            for i, s in enumerate(sets)]
    for percent in (40, 55, 70):
        links = list(jaccard_join.meet(percent)(-1, head, iter(rows)))
        want = [(x, y) for x in range(25, 40) for y in range(25)
                if 100 * len(np.intersect1d(sets[x], sets[y])) >= percent * len(np.union1d(sets[x], sets[y]))]
        assert set(links) <= set(want) and len(links) < 40

        def groups(pairs):
            root = list(range(40))
            for x, y in pairs:
                root = [root[x] if r == root[y] else r for r in root]
            return sorted(tuple(i for i in range(40) if root[i] == r) for r in set(root))

        assert groups(links) == groups(want)


def test_groups_of_odd_rows_and_none(odd, none):
    rows = jaccard_join.join_groups(odd).collect()
    assert len(rows) == len(ODD)
    assert {r["doc_id"]: r["component_id"] for r in rows}[7] == 1
    assert jaccard_join.join_groups(none).count() == 0


def test_lists_do_not_depend_on_batches(spark):
    rows = spark.createDataFrame([(i // 7, i, 10, 0) for i in range(5000)],
                                 "shingle long, s long, n long, central long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = jaccard_join.by_list(rows, jaccard_join.shared_lists,
                                   "shingle long, s long, n long, central long", ["n", "s"]).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == 5000 - 1 * (5000 % 7 == 1)


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "x long, y long")
    got = jaccard_join.components(edges).collect()
    assert len(got) == n + 1 and {r["root"] for r in got} == {0}


# -- op5 ------------------------------------------------------------------------------------------

def test_languages_of_held_out_rows(spark):
    rows = queries.op5_language_id(spark, SMOKE).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 200 and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.9


def test_languages_of_odd_rows(spark, odd, none):
    model = langid.fit(odd, F.lit(True))
    got = langid.identify(odd, model, ["doc_id", "score"], ("l", "sure")).collect()
    said = {r["doc_id"]: r["l"] for r in got}
    assert len(got) == len(ODD) and said[2] == said[3] == said[4] == said[9] == "und"
    assert said[8] == "de"
    empty = langid.fit(none, F.lit(True))
    assert {r["l"] for r in langid.identify(odd, empty, ["doc_id"], ("l", "s")).collect()} == {"und"}
    assert langid.identify(none, model, ["doc_id"]).count() == 0


# -- op6 ------------------------------------------------------------------------------------------

def brute_ppm(counts, start, text):
    """Prediction by partial matching from dictionaries of counts by context."""
    s, total = start + text + b"\0", 0.0
    for i in range(len(start), len(s)):
        out = set()
        for k in range(ppm.ORDER, -1, -1):
            seen = {b: n for b, n in counts.get(s[i - k:i], {}).items() if b not in out}
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if s[i] in seen:
                total += np.log10(seen[s[i]] / whole)
                break
            total += np.log10(len(seen) / whole)
            out |= seen.keys()
        else:
            total -= np.log10(256 - len(out))
    return total


def test_scores_match_dictionaries(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    extra = spark.createDataFrame([(1000, None), (1001, ""), (1002, "Zzz ÿ\u4e2d"), (1002, "Zzz ÿ\u4e2d"),
                                   (None, "the")], "doc_id long, text string")
    docs = docs.union(extra)
    held = fold(F.col("doc_id"), 7) == 2
    got = ppm.score(docs, ~held).collect()
    rows = docs.collect()
    train = [(r["text"] or "").encode().lower() for r in rows
             if zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 7 != 2]
    gap, counts, words = b"\0" * ppm.ORDER, {}, {}
    for t in train:
        s = gap + t + b"\0"
        for i in range(ppm.ORDER, len(s)):
            for k in range(ppm.ORDER + 1):
                own = counts.setdefault(s[i - k:i], {})
                own[s[i]] = own.get(s[i], 0) + 1
        for w in t.split():
            words[w] = words.get(w, 0) + 1
    n, v = sum(words.values()) + len(train), len(words) + 1
    want = []
    for r in rows:
        t = (r["text"] or "").encode().lower()
        c = [words.get(w, 0) for w in t.split()] + [len(train)]
        want.append((str(r["doc_id"]), len(c), sum(x > 0 for x in c), n,
                     sum(np.log10((x + 1) / (n + v + 1)) for x in c), t))
    assert len(got) == len(want)
    key = lambda r: (str(r[0]), r[1], round(r[4], 3))
    for g, w in zip(sorted((tuple(r) for r in got), key=key), sorted(want, key=key), strict=True):
        assert (str(g[0]), *g[1:4]) == w[:4]
        assert g[4] == pytest.approx(w[4], abs=1e-6)
        assert g[5] == pytest.approx(brute_ppm(counts, gap, w[5]), rel=1e-4, abs=1e-4)


def test_rare_words_meet_their_counts_in_the_join(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text")
    held = fold(F.col("doc_id"), 7) == 2
    plain = {r["doc_id"]: r for r in ppm.score(docs, ~held).collect()}
    monkeypatch.setattr(ppm, "MAX_HEAD", 5)
    for r in ppm.score(docs, ~held).collect():
        assert r["n_known"] == plain[r["doc_id"]]["n_known"]
        assert r["base_score"] == pytest.approx(plain[r["doc_id"]]["base_score"], abs=1e-6)


@pytest.mark.parametrize("contexts", [0, 1, 300, 5000])
def test_contexts_beyond_the_automaton_cost_the_same(spark, monkeypatch, contexts):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    docs = docs.union(spark.createDataFrame([(1000, None), (1002, "Zzz ÿ\u4e2d"), (1002, "Zzz ÿ\u4e2d"),
                                             (None, "the")], "doc_id long, text string"))
    held = fold(F.col("doc_id"), 7) == 2
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], r["base_score"])
    monkeypatch.setattr(ppm, "MAX_CONTEXTS", 1 << 30)
    whole = sorted(ppm.score(docs, ~held).collect(), key=key)
    monkeypatch.setattr(ppm, "MAX_CONTEXTS", contexts)
    for a, b in zip(sorted(ppm.score(docs, ~held).collect(), key=key), whole, strict=True):
        assert a["score"] == pytest.approx(b["score"], rel=1e-5, abs=1e-5)


def test_no_context_of_a_larger_corpus_is_left_out(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    gap, counts = b"\0" * ppm.ORDER, {}
    for r in rows:
        s = gap + (r["text"] or "").encode().lower() + b"\0"
        for i in range(ppm.ORDER, len(s)):
            for k in range(ppm.ORDER + 1):
                own = counts.setdefault(s[i - k:i], {})
                own[s[i]] = own.get(s[i], 0) + 1
    assert len(counts) > ppm.MAX_CONTEXTS
    got = {r["doc_id"]: r["score"] for r in ppm.score(docs, F.lit(True)).collect()}
    for r in rows[::4]:
        want = brute_ppm(counts, gap, (r["text"] or "").encode().lower())
        assert got[r["doc_id"]] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_scores_without_training_rows(odd, none):
    rows = ppm.score(odd, F.lit(False)).collect()
    assert len(rows) == len(ODD) and {r["train_tokens"] for r in rows} == {0}
    assert ppm.score(none, F.lit(True)).count() == 0


# -- op7 ------------------------------------------------------------------------------------------

def test_token_files_read_back(spark, odd, none):
    own = Vocabulary(read_vocabulary(JSON50))
    out = scratch_path(spark, "test-token-files")
    token_store.write_tokens(odd, JSON50, out)
    at, want = 0, []
    for r in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*own.encode((r[1] or "").encode()).tolist(), 2]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted((tuple(r) for r in token_store.digests(spark, out).collect()), key=lambda r: r[1])
    assert got == want
    meta = sorted((r["start"], r["n_tokens"]) for r in token_store.read_metadata(spark, out).collect())
    assert meta == [w[1:3] for w in want]
    one = token_store.read_tokens(spark, out).where("doc_id = 1").collect()[0]["ids"]
    assert one == [*own.encode(ODD[0][1].encode()).tolist(), 2]
    empty = scratch_path(spark, "test-token-files-none")
    token_store.write_tokens(none, JSON50, empty)
    assert token_store.digests(spark, empty).count() == 0


def test_token_files_have_the_stated_encodings(spark):
    import glob

    import pyarrow.parquet as pq
    out = scratch_path(spark, "test-token-encodings")
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    token_store.write_tokens(docs, JSON50, out)
    path = next(p for p in glob.glob(out.removeprefix("file://") + "/*.parquet"))
    group = pq.ParquetFile(path).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    ids = next(c for name, c in columns.items() if name.startswith("ids"))
    assert "RLE_DICTIONARY" in ids.encodings and ids.has_offset_index


# -- op8 ------------------------------------------------------------------------------------------

def test_sketch_differences_are_exact(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        both = [rng.getrandbits(63) for _ in range(rng.randint(0, 12))]
        a = [rng.getrandbits(63) for _ in range(rng.choice([0, 1, 3, 8, 40]))]
        b = [rng.getrandbits(63) for _ in range(rng.choice([0, 1, 3, 8, 40]))]
        rows.append((i, both + a, both + b, len(a), len(b)))
    df = spark.createDataFrame(rows, "i int, a array<long>, b array<long>, plus int, minus int")
    got = df.select("plus", "minus", fingerprints.differences(F.col("a"), {"b": F.col("b")})["b"].alias("d")).collect()
    assert all((r["d"]["plus"], r["d"]["minus"]) == (r["plus"], r["minus"]) for r in got)
    small = fingerprints.CELLS[0]
    fits = df.where("plus + minus between 1 and 3").select("plus", "minus", fingerprints.peel(
        fingerprints.subtract(fingerprints.sketch(F.col("a"), small), fingerprints.sketch(F.col("b"), small)),
        small).alias("d")).collect()
    assert fits and sum(r["d"]["ok"] for r in fits) >= 0.8 * len(fits)
    assert all((r["d"]["plus"], r["d"]["minus"]) == (r["plus"], r["minus"]) for r in fits if r["d"]["ok"])


def brute_edited(rows):
    import re
    rows = [(k, t or "") for k, t in rows]
    order = sorted(dict.fromkeys(rows), key=lambda r: -r[0])
    pieces = lambda t: {p for p in re.split(fingerprints.PARAGRAPH, t) if p.strip(" ")}
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    out = []
    for k, t in rows:
        after = order[(order.index((k, t)) + 1) % len(order)][1]
        cut = len(t) // 3
        new = t[: len(t) - cut] + after[:cut]
        out.append((k, len(t), hashlib.sha256(new.encode()).hexdigest(),
                    round(near(pieces(t), pieces(new)), 9), round(near(pieces(t), pieces(after)), 9)))
    return sorted(out)


def test_fingerprints_match_brute_force(spark, none):
    rows = [(r[0], r[1]) for r in ODD if r[0] is not None]
    rows += [(r["doc_id"] + 100, r["text"]) for r in spark.read.parquet(
        f"{SMOKE}/documents.parquet").where("doc_id < 40").collect()]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, head string").repartition(3)
    got = fingerprints.compare_edited(docs).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9),
                   round(r["near_next"], 9)) for r in got) == brute_edited(rows)
    texts = dict(rows)
    prints = {}
    for r in got:
        assert prints.setdefault(texts[r["doc_id"]] or "", r["fingerprint"]) == r["fingerprint"]
    assert fingerprints.compare_edited(none).count() == 0


def test_fingerprint_of_a_null_key_and_a_single_row(spark, odd):
    assert fingerprints.compare_edited(odd).count() == len(ODD)
    one = fingerprints.compare_edited(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).collect()
    assert one[0]["near_next"] == 1.0 and one[0]["n_chars"] == 5


# -- op9 ------------------------------------------------------------------------------------------

def test_url_judgements(spark):
    pages = spark.createDataFrame(
        [(1, "http://A.Example.ORG/en/12?x#y", "h"), (2, None, "h"), (3, "no scheme", "h"), (4, "x://", "h"),
         (5, "http://example.org", "h"), (6, "http://notexample.org/es/", "h"), (7, "ftp://b.com/de/1#z", "h"),
         (8, "http://com/fr/", "h"), (9, "http://c.net/a://b", "h"), (9, "http://c.net/a://b", "h"),
         (10, "http://é.org/" + "p" * 100_000, "h"), (None, "http://example.org/es/", "h")],
        "page_id long, url string, host string")
    listed = spark.createDataFrame([("org", "/", "allow", 1), ("example.org", "/es/", "block", 1),
                                    ("example.org", "/en/1", "block", 1), ("com", "/fr/", "allow", 1),
                                    ("com", "/de/", "block", 1), ("c.net", "/a", "block", 0),
                                    ("c.net", "/a", "block", 0), (None, "/", "block", 1)],
                                   "host string, prefix string, verdict string, rank int")
    out = url_filter.judge(pages, listed)
    assert out.columns == ["page_id", "url", "host", "path", "entry", "rank", "verdict"]
    got = out.where("host is not null").collect()
    said = {r["page_id"]: (r["host"], r["path"][:9], r["entry"], r["verdict"]) for r in got}
    assert len(got) == 12
    assert said[1] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert said[2] == said[3] == said[4] == ("", "", None, "allow")
    assert said[5] == ("example.org", "", None, "allow")
    assert said[6] == ("notexample.org", "/es/", "org/", "allow")
    assert said[7] == ("b.com", "/de/1", "com/de/", "block")
    assert said[8] == ("com", "/fr/", "com/fr/", "allow")
    assert said[9] == ("c.net", "/a://b", "c.net/a", "block")
    assert said[10][2:] == ("org/", "allow") and said[None][3] == "block"
    nothing = url_filter.judge(pages.select("page_id", "url"), listed.limit(0)).collect()
    assert {r["verdict"] for r in nothing} == {"allow"} and len(nothing) == 12
    assert url_filter.judge(pages.select("page_id", "url").limit(0), listed).count() == 0


def test_listed_addresses_fit_only_themselves(spark):
    pages = spark.createDataFrame(
        [(1, "http://A.org/x?q"), (2, "https://a.org/x#y"), (3, "http://b.a.org/x"), (4, "http://a.org/xy"),
         (5, "http://a.org"), (6, "http://c.org"), (7, "http://?a.org/x"), (8, None), (9, "http://d.org/z")],
        "page_id long, url string")
    listed = spark.createDataFrame([("d.org", "/z", "allow", 0), ("", "/x", "block", 5)],
                                   "host string, prefix string, verdict string, rank int")
    addresses = spark.createDataFrame(
        [("a.org", "/x", "block", 0), ("a.org", "/x", "block", 0), ("c.org", "", "block", 0), ("d.org", "/z", "block", 0),
         (None, "/x", "block", 9), ("a.org", None, "block", 9), ("?a.org", "/x", "block", 9), ("", "", "block", 9)],
        "host string, path string, verdict string, rank int")
    for blocks in (0, 1 << 20):                     # the filter joined by block, and broadcast
        got = {r["page_id"]: (r["verdict"], r["entry"])
               for r in url_filter.judge(pages, listed, addresses, broadcast_blocks=blocks).collect()}
        assert got == {1: ("block", "a.org/x"), 2: ("block", "a.org/x"), 3: ("allow", None), 4: ("allow", None),
                       5: ("allow", None), 6: ("block", "c.org"), 7: ("allow", None), 8: ("allow", None),
                       9: ("block", "d.org/z")}


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h"), F.col("id")).alias("key"))
    words = {r["block"]: r["word"] for r in url_filter.blocked_bloom(keys, "key", 750).collect()}
    df = spark.range(9000).select("id", F.concat(F.lit("h"), F.col("id")).alias("key"))
    hit = df.select("id", url_filter.block_of(F.col("key"), F.lit(750)).alias("b"),
                    url_filter.mask_of(F.col("key")).alias("m")).collect()
    passed = [r["id"] for r in hit if words.get(r["b"], 0) & r["m"] == r["m"]]
    assert set(range(3000)) <= set(passed) and len(passed) < 3000 + 0.1 * 6000


# -- op10 -----------------------------------------------------------------------------------------

def test_quality_of_odd_rows(odd, none):
    rows = quality.apply_rules(odd).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ODD)
    assert (by[2]["n_words"], by[2]["base_failed"], by[2]["kept"]) == (0, True, False)
    assert by[5]["n_words"] == by[5]["n_repeat_words"] == 30_000 and by[5]["base_failed"]
    assert by[6]["word_chars"] == 120_000
    assert by[8]["word_chars"] == sum(len(w) for w in ODD[8][1].encode().split() for w in [w.decode()])
    assert quality.apply_rules(none).count() == 0


def test_cascade_verdict_does_not_depend_on_the_order(smoke):
    texts = [r["text"].encode() for r in smoke] + [b"", b"a b a b a b", b"# " * 90, "\u00e9 ".encode() * 60]
    names = [r.name for r in quality.RULES]
    each = {r.name: r.rejects(quality.Texts(texts)) for r in quality.RULES}
    rng = random.Random(1)
    for made in ((), quality.COUNTS) * 3:
        rng.shuffle(names)
        view = quality.Texts(texts)
        for name in made:
            getattr(view, name)
        said, tried = quality.cascade(view, names)
        first = [next((i for i, n in enumerate(names) if each[n][k]), None) for k in range(len(texts))]
        assert said.tolist() == ["" if i is None else names[i] for i in first]
        assert tried.tolist() == [len(names) if i is None else i + 1 for i in first]
        assert tried.sum() < len(names) * len(texts)
    assert sorted(quality.measured_order(texts)) == sorted(names)
    assert quality.measured_order([]) == [r.name for r in quality.RULES]


def test_cascade_counts_only_what_a_rule_asks_for(smoke):
    texts = [r["text"].encode() for r in smoke] + [b"few words"] * 30
    asked = []

    def slow(t):
        asked.append(len(t.texts))
        return t.n_dup_lines > 1

    rules = (quality.RULES[0], quality.Rule("slow", slow))
    view = quality.Texts(texts)
    quality.cascade(view, ["few_words", "slow"], rules)
    assert "n_repeat_words" not in view._kept and "line_counts" not in view._kept
    assert asked == [sum(len(t.split()) >= 50 for t in texts)]


def test_quality_without_counts_gives_the_same_verdicts(odd):
    whole = {(r["doc_id"], r["kept"]) for r in quality.apply_rules(odd).collect()}
    bare = quality.apply_rules(odd, counts=False)
    assert bare.columns == ["doc_id", "kept", "rejected_by", "rules_tried"]
    assert {(r["doc_id"], r["kept"]) for r in bare.collect()} == whole


# -- pipeline -------------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, SMOKE)
    assert clean.columns == docs.columns and 100 < clean.count() <= 200
    named = corpus_pipeline.drop_unknown_language(spark, docs, SMOKE)
    assert named.columns == docs.columns and named.count() >= 198
    single = corpus_pipeline.drop_near_copies(spark, docs, SMOKE)
    roots = {c for _, _, c in brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()])}
    assert sorted(str(r["doc_id"]) for r in single.collect()) == sorted(roots)
    packed = corpus_pipeline.pack_sequences(spark, docs, SMOKE).collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in packed)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_copies", "packing"]


def test_pipeline_of_odd_rows(spark, odd, tmp_path):
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, None)], "doc_id long, quality int, toxic int").write \
        .parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "sequence_id", "ids"} <= set(out.columns)
    rows = out.collect()
    # document 1 is clean English; its copies (7) are of its group; null, empty, blank and letterless texts go
    assert 1 in {r["doc_id"] for r in rows} and not {2, 3, 4, 7, 9} & {r["doc_id"] for r in rows}


def test_pipeline_of_empty_tables(spark, none, tmp_path):
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "sequence_id", "ids"} <= set(out.columns) and out.count() == 0
