"""The training-data operators against SQL and brute force, and on awkward tables."""

import base64
import hashlib
import io
import math
import re
import time
import zipfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm import bpe, chat, line_dedup, media, minhash_dedup, packing, quality_rules, registry, substring_dedup, url_filters, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, kept boolean, c1 string, n_words string, row int, label_id int"
LONG = " ".join(f"w{i}" for i in range(60))
LINE = "a line that many documents share, word for word"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def awkward(spark):
    """Nulls, empty and blank texts, repeated rows and ids, copies, and columns with clashing names."""
    texts = [
        (1, LONG), (2, LONG), (2, LONG), (3, None), (4, ""), (5, " \t\n"), (None, "null id " + LONG), (None, None), (6, LONG + " tail"),
        (7, "one"), (8, "one two"), (9, "One\x0bTWO"), (10, "é" * 70_000), (11, "x " * 20_000), (12, "new words " + LONG), (12, "same id, other text"),
        *[(20 + i, f"own {i}\n  {LINE.upper() if i % 2 else LINE} \nend") for i in range(6)],
    ]
    return spark.createDataFrame([(i, t, "en", True, "c", "n", 1, 2) for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return awkward(spark).cache()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, same, name):
    same(registry.queries()[name](spark, sf_dir), duck.sql(registry.oracle_sql()[name]))


def texts_of(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


# 1 near duplicates


def components_of(docs, size, percent):
    sets = {}
    for i, t in docs:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(t or "")]
        k = min(size, len(w))
        sets.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    flat = [(i, s) for i, ss in sets.items() for s in ss if s and i is not None]
    for x, (i, a) in enumerate(flat):
        for j, b in flat[:x]:
            if 100 * len(a & b) >= percent * len(a | b):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return {i: top(i) for i in sets}


def test_near_duplicates_on_awkward_rows(spark, odd):
    rows = minhash_dedup.near_duplicates(odd).collect()
    want = components_of([(r.doc_id, r.text) for r in odd.collect()], 3, 85)
    assert len(rows) == odd.count()
    assert all(r.component_id == want[r.doc_id] and r.kept == (r.component_id == r.doc_id) for r in rows if r.doc_id is not None)
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    kept = minhash_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and {1, 3, None} <= {r.doc_id for r in kept.collect()}


def test_rows_that_repeat_an_id_join_their_components(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(80)) for k in "ab")
    docs = [(3, a), (5, a), (5, b), (5, None), (7, b + " tail"), (9, "c " + LONG)]
    rows = minhash_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in rows) == Counter([(3, 3, True), *[(5, 3, False)] * 3, (7, 3, False), (9, 9, True)])


def test_chains_of_near_copies_keep_every_link(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(150):  # pairwise similarities on both sides of the threshold
        w = list(base)
        for k in rng.choice(120, rng.integers(0, 7), replace=False):
            w[k] = f"x{i}_{k}"
        docs.append((i, " ".join(w)))
    rows = minhash_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in rows} == components_of(docs, 3, 85)


def test_members_of_many_buckets_and_blocks(spark, monkeypatch):
    """Second step over several blocks, with chains of copies that only the buckets' other members link."""
    monkeypatch.setattr(minhash_dedup, "BLOCK_BYTES", 9_000)
    rng = np.random.default_rng(9)
    docs = []
    for family in range(4):
        w = [f"f{family}_{i}" for i in range(200)]
        for i in range(40):  # a walk: neighbours are alike, the ends are not
            for k in rng.choice(200, 4, replace=False):
                w[k] = f"f{family}_{i}_{k}"
            docs.append((1000 * family + int(rng.integers(0, 900)) * 1, " ".join(w)))
    rows = minhash_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in rows} == components_of(docs, 3, 85)


def test_registers_merge_and_estimate():
    seeds = minhash_dedup.register_seeds()
    a, b = np.arange(1, 3000, dtype="u8"), np.arange(1500, 4000, dtype="u8")
    a, b = minhash_dedup.mix(a), minhash_dedup.mix(b)
    ra, rb = minhash_dedup.registers(a, seeds), minhash_dedup.registers(b, seeds)
    assert (np.maximum(ra, rb) == minhash_dedup.registers(np.union1d(a, b), seeds)).all()
    one = lambda *x: [np.array([v], "f8") for v in x]
    assert not minhash_dedup.plausible(*one((ra > rb).sum(), (ra < rb).sum(), len(a), len(b)), 0.85)[0]
    assert minhash_dedup.plausible(*one(0, 0, 10, 10), 0.85)[0]


# 2 media


def test_media_round_trip(spark, odd):
    rows = media.read_media(media.write_media(odd)).collect()
    assert len(rows) == odd.count()
    want = Counter()
    for r in odd.collect():
        raw = (r.text or "").encode()
        pay = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want[r.doc_id, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:])] += 1
    assert want == Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows)
    assert len({(r.media_sha256, r.feature, r.media_bytes) for r in rows}) == len({r.text or "" for r in odd.collect()})


def test_stored_form_against_brute_force(spark, sf_dir):
    """Chunk lists, owners and features of the whole table, worked out one text at a time."""
    texts, gear = texts_of(spark, sf_dir), media.gear_table()
    common = "".join(map(chr, np.random.default_rng(2).integers(97, 122, 60_000)))
    more = {-1 - i: f"head {i} " * (9 * i) + common for i in range(4)}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(list(more.items()), "doc_id long, text string"))
    texts |= more
    lists = {i: media.chunk_list(*media.payload_of(t), gear) for i, t in texts.items()}
    owner = {}
    for i, (stored, chunks) in lists.items():
        for d, _ in chunks:
            owner[d] = min(owner.get(d, media._media_id(stored)), media._media_id(stored))
    shared = 0
    for r in media.read_media(media.write_media(docs)).collect():
        stored, chunks = lists[r.doc_id]
        own = {d: p for d, p in chunks if owner[d] == media._media_id(stored)}
        shared += len(own) < len(dict(chunks))
        form = stored + b"".join(own.values())
        assert (r.media_bytes, r.media_sha256) == (len(form), hashlib.sha256(form).hexdigest())
        x = np.frombuffer(media.payload_of(texts[r.doc_id])[0], "u1").astype("f8")
        p = np.array(list(Counter(x.tolist()).values())) / len(x)
        above = x >= 128
        assert r.feature == f"mean={x.mean():.4f};std={x.std():.4f};crossings={sum(a != b for a, b in zip(above, above[1:]))};entropy={-(p * np.log2(p)).sum():.4f}"
    assert shared >= 3


def test_shared_passages_share_chunks(spark):
    rng = np.random.default_rng(1)
    common = "".join(map(chr, rng.integers(97, 122, 60_000)))
    docs = spark.createDataFrame([(i, f"head {i} " * (i + 1) + common) for i in range(4)], "doc_id long, text string")
    store = media.write_media(docs)
    held = store.media.select(F.sum(F.aggregate("samples", F.lit(0), lambda a, x: a + F.octet_length(x)))).first()[0]
    assert held < 2 * 60_000
    assert {r.payload_sha256 for r in media.read_media(store).collect()} == {hashlib.sha256(media.payload_of(r.text)[0]).hexdigest() for r in docs.collect()}


def test_gear_hash_is_rolling():
    gear = media.gear_table()
    x = np.random.default_rng(0).integers(0, 256, 500).astype("u1")
    assert media.gear_hashes(x, gear)[400] == media.gear_hashes(x[369:401], gear)[-1]
    brute = sum(int(gear[x[400 - k]]) << k for k in range(32)) & 0xFFFFFFFF
    assert int(media.gear_hashes(x, gear)[400]) == brute


# 3 byte pair encoding


def test_bpe_equals_the_library(spark, odd):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    more = ["a<|endoftext|>B", "İstanbul ΣΑΣ  x²½ don't I'LL é ﬁ 日本語 \x1c\x07 <|Startoftext|>", "🎉🎉 👨‍👩‍👧 e\u0301"]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    rows = bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    want = Counter()
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))] += 1
    assert want == Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows)
    assert all(len(r.ids) == r.n_tokens for r in rows)


def test_characters_are_the_librarys(spark):
    """Every assigned code point, in words and alone, and strings of rare ones."""
    rng = np.random.default_rng(8)
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{chr(c)} a{chr(c)}B1{chr(c)}' " for c in points[k : k + 2000]) for k in range(0, len(points), 2000) if k < 0x32000 or k > 0xE0000]
    rare = [*range(0x300, 0x370), 0x1E6D7, 0x19023, 0x130, 0x3A3, 0x1C4, 0x345, 0x1100, 0x1161, 0xFB1D, 0x2126, 0xAD, 0x200D, 0x3C, 0x7C, 0x27, 0x73, 0x41, 0xA0, 0x85, 0x1C]
    texts += ["".join(map(chr, rng.choice(rare, 12))) for _ in range(3000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    for path, ids in (("word_bpe_49k.json", None), ("byte_bpe_50k.json", packing.encoder)):
        path = public_tokenizers.path(path)
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        if ids:
            encode = ids(path)
            wrong = [t for t, w in zip(texts, want) if np.frombuffer(encode(t), "<u4").tolist() != w]
        else:
            got = {r.doc_id: r.ids_sha256 for r in bpe.encode_documents(docs, path, with_ids=False).collect()}
            wrong = [texts[i] for i, w in enumerate(want) if got[i] != sha(" ".join(map(str, w)))]
        assert not wrong, [hex(ord(c)) for c in wrong[0]][:40]


def test_long_words_merge_fast_and_alike():
    model = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(6)
    for n in (1, 2, 60, 64, 65, 66, 500, 3000):
        for letters in ("ab", "aaaaab", "theringandswofm"):
            word = "".join(rng.choice(list(letters), n))
            exact = [p for p in model.merged(model.symbols(word.encode(), True)) if p in model.known]
            assert model.merge(word.encode()) == model._merge_long(word.encode()) == exact == tok.encode(word, add_special_tokens=False).ids
    # what the faster merger proposes is used only where it is right
    words = {"".join(rng.choice(list("aeithnsr"), n)) for n in rng.integers(1, 14, 20_000)}
    exact = {w: tok.encode(w, add_special_tokens=False).ids for w in words}
    assert {w: model.merge(w.encode()) for w in words} == exact
    plain, model.propose = model.propose, lambda w: [model.vocab[c] for c in w[:-1].decode()[:-1]] + [model.last[w[-2]]]
    assert {w: model.merge(w.encode()) for w in list(words)[:500]} == {w: exact[w] for w in list(words)[:500]}
    model.propose = plain
    word = "".join(rng.choice(list("etaoinshr"), 1_000_000))
    began = time.perf_counter()
    ids = model.merge(word.encode())
    assert time.perf_counter() - began < 60
    assert "".join(model.tokens[i] for i in ids) == word + "</w>"


def test_lexicon_is_minimal_and_exact():
    words = {w.encode(): [k, len(w)] for k, w in enumerate(["run", "running", "gunning", "gun", "é", "ére", "gunner", "runner"])}
    lex = bpe.Lexicon.mapped(bpe.Lexicon.compiled(words))
    assert all(lex.get(w) == ids for w, ids in words.items())
    assert all(lex.get(w.encode()) is None for w in ("", "ru", "runn", "gunnings", "x"))
    assert len(lex.first) - 1 < sum(map(len, words))  # states are shared
    assert bpe.Lexicon.mapped(bpe.Lexicon.compiled({})).get(b"a") is None


# 4 packing


def test_lookups_are_kept_from_task_to_task_within_bounds(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 8)
    path = public_tokenizers.path("word_bpe_49k.json")
    model = bpe.WordBpe(path)
    words = [b"the", b"cat", b"naiv", b"zzxqv"]

    class Sent:
        value = bpe.Lexicon.compiled({w: model.merge(w) for w in words[:2]})

    first = bpe.encoder(path, "one", Sent)
    assert bpe.encoder(path, "one", Sent) is first and bpe.model_of(path) is first.model
    library = Tokenizer.from_file(path)
    texts = [*(w.decode() for w in words), "The", "cat's", "\u0130x", "\u200b", "d" * 200, *(f"w{i}" for i in range(30)), "the"]
    for _ in range(2):
        for t in texts:
            ids = library.encode(t, add_special_tokens=False).ids
            assert first.tokens[t.encode()] == (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)), t
            for memo in (first.words, first.tokens):
                assert len(memo) <= 4 and len(memo.older) <= 4 and all(len(w) <= bpe.MEMO_BYTES for w in (*memo, *memo.older))
    other = bpe.encoder(path, "two", Sent)
    assert other is not first and list(bpe._ENCODERS.values()) == [other]


def test_packing_places_every_token_once(spark, odd):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(odd, public_tokenizers.path("byte_bpe_50k.json")).collect()
    want = Counter()
    for r in odd.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        cut = len(ids) % 1024 or 1024
        for k, at in enumerate([0, *range(cut, len(ids), 1024)]):
            piece = ids[at : (cut if k == 0 else at + 1024)]
            want[r.doc_id, k, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    fills = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fills.get(r.sequence_id, 0)
        fills[r.sequence_id] = r.offset + r.length
    assert max(fills.values()) <= 1024


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5.5, 1, 3000).astype(int), 1, 1024)
    histogram = Counter(lengths.tolist())
    classes = packing.plan(histogram)
    held = Counter()
    for bin_, n in classes:
        assert sum(bin_) <= 1024
        for x in bin_:
            held[x] += n
    assert held == histogram
    assert sum(n for _, n in classes) <= -(-int(lengths.sum()) // 1024) * 1.01 + 1


def test_local_search_empties_bins():
    bins = packing.Bins(10)
    for b in [(6, 3), (6, 3), (4, 4), (4, 4), (1,), (1,)]:
        bins.put(b, 1)
    squares = sum(sum(b) ** 2 * n for b, n in bins.number.items())
    assert packing.local_search(bins) > 0 and bins.bins == sum(bins.number.values()) <= 5
    assert sum(sum(b) ** 2 * n for b, n in bins.number.items()) > squares
    assert bins.waste == sum((10 - sum(b)) * n for b, n in bins.number.items())


def best_fit_decreasing(lengths, capacity):
    """Free space of the bins."""
    free = Counter()
    for x in sorted(lengths, reverse=True):
        room = min((f for f in free if f >= x and free[f]), default=capacity)
        free[room] -= free[room] > 0
        free[room - x] += 1
    return sum(free.values())


def test_the_search_decides_on_real_histograms(spark, sf_dir):
    """From one bin a piece, steps alone come to within one bin of what the tokens need, and never behind best fit decreasing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lengths = [r.length for r in packing.pieces_of(docs, public_tokenizers.path("byte_bpe_50k.json")).select("length").collect()]
    plan = packing.plan(Counter(lengths))
    used = sum(n for _, n in plan)
    assert used <= -(-sum(lengths) // 1024) + 1 < len(lengths)
    assert used <= best_fit_decreasing(lengths, 1024)


def test_plans_of_large_corpora(monkeypatch):
    rng = np.random.default_rng(2)
    histogram = Counter({int(x): int(n) for x, n in zip(range(1, 1025), rng.integers(0, 10**9, 1024))})
    monkeypatch.setattr(packing, "PLAN_PIECES", 20_000)
    held, used = Counter(), 0
    for bin_, n in packing.plan(histogram):
        assert sum(bin_) <= 1024 and n > 0
        used += n
        for x in bin_:
            held[x] += n
    assert held == +histogram and used <= 1.01 * sum(x * n for x, n in histogram.items()) / 1024


# 5 lines


def test_line_dedup_on_awkward_rows(spark, odd):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    has = {r.doc_id: LINE in (r.text or "").lower() for r in out.collect() if r.doc_id and r.doc_id >= 20}
    assert has == {20 + i: i == 5 for i in range(6)}
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[20] == "own 0\nend" and kept[1] == LONG and kept[3] is None


def test_runs_are_compacted_and_anti_joined(spark):
    runs = line_dedup.LineRuns(spark, 2, fanout=3)
    batch = lambda rows: spark.createDataFrame(rows, "doc long, h1 long, h2 long")
    held = lambda df: {(r.h1, r.h2, r.n_docs, r.last_doc) for r in df.collect()}
    for k in range(5):
        runs.add(batch([(k, 1, 1), (k, 1, 1), (k, 2, k // 2), (k, 3, k)]))
        # the newest run holds a known key's totals so far, and new keys with their own
        if k != 2:  # compacted
            assert held(runs.runs()[0]) == {(1, 1, k + 1, k), (2, k // 2, k % 2 + 1, k), (3, k, 1, k)}
    assert [len(x) for x in runs.levels] == [2, 1]
    assert held(runs.frequent(2)) == {(1, 1, 5, 4), (2, 0, 2, 1), (2, 1, 2, 3)}
    counts = batch([(9, 1, 1), (9, 2, 8)]).withColumns({"n_docs": F.lit(1).cast("long"), "last_doc": F.col("doc")}).drop("doc")
    assert [r.h2 for r in runs.unseen(counts, runs.runs()).collect()] == [8]
    assert held(runs.known(counts, runs.runs()[0])) == {(1, 1, 6, 9)}
    runs.drop()


def test_the_query_anti_joins_every_batch(spark, odd, monkeypatch):
    seen = []
    plain = line_dedup.LineRuns.unseen
    monkeypatch.setattr(line_dedup.LineRuns, "unseen", staticmethod(lambda c, r: seen.append(len(r)) or plain(c, r)))
    line_dedup.dedup_lines(odd)
    assert seen == [1, 1, 1, 1]  # batches after the first: against one, one and two runs
    monkeypatch.setattr(line_dedup.LineRuns, "unseen", staticmethod(lambda c, r: plain(c, r).limit(0)))
    assert {r.doc_id for r in line_dedup.dedup_lines(odd).filter(F.col("text").contains("line that")).collect()} != {25}


# 6 substrings


def removed(docs):
    seen = Counter()
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    for _, w in words:
        seen.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone |= set(range(k, k + 35))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return Counter(out)


def result(df, docs):
    out = substring_dedup.with_text_key(docs).join(substring_dedup.parsed(df), ["c1", "c2"])
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def test_substrings_on_awkward_rows(spark, odd):
    docs = odd.select("doc_id", "text")
    assert result(odd, docs) == removed([(r.doc_id, r.text) for r in docs.collect()])
    out = substring_dedup.drop_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()


def test_substrings_against_brute_force(spark):
    rng = np.random.default_rng(7)
    pool = [[f"p{k}_{i}" for i in range(70)] for k in range(4)]
    docs = []
    for d in range(40):
        w = []
        for _ in range(4):
            p = pool[rng.integers(4)]
            a = rng.integers(0, 40)
            w += p[a : a + rng.integers(20, 70)] + [f"d{d}_{x}" for x in range(rng.integers(0, 5))]
        docs.append((d, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(df, df) == removed(docs)


def test_greedy_factors_cover_just_the_repeated_windows():
    rng = np.random.default_rng(11)
    for trial in range(60):
        word = lambda n: [b"%d" % x for x in rng.integers(0, 2 if trial % 3 else 40, n)]
        text = word(120)
        blocks = [(-1, word(20) + text[a : a + rng.integers(3, 40)] + word(9)) for a in rng.integers(0, 110, 6)] + [(40, text[40:90])]
        found = substring_dedup.greedy_factors(text, blocks, substring_dedup.WordHasher(), 5)
        gone = {at + k for at, n, _, _ in found for k in range(n)}
        assert all(text[at : at + n] == blocks[b][1][t : t + n] and n >= 5 for at, n, b, t in found)
        want = set()
        for s in range(116):
            if any(blocks[b][1][t : t + 5] == text[s : s + 5] and blocks[b][0] + t != s for b in range(7) for t in range(len(blocks[b][1]) - 4)):
                want |= set(range(s, s + 5))
        assert gone == want and [f[0] for f in found] == sorted(f[0] for f in found)


def test_words_are_hashed_by_their_bytes_alone(monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE", 64)
    rng, hasher = np.random.default_rng(3), substring_dedup.WordHasher()
    words = [bytes(rng.integers(33, 256, n).tolist()) for n in [1, 1, 2, 63, 64, 65, 66, 200, *rng.integers(1, 12, 300)]] + [b"ab", b"ba", b"\0", b"\0\0"]
    alone = {w: hasher([w]).tolist() for w in words}
    assert all(len(h) == 1 for h in alone.values()) and len({h[0] for h in alone.values()}) == len(alone)
    for _ in range(5):
        rng.shuffle(words)
        assert hasher(words).tolist() == [alone[w][0] for w in words]
        assert hasher.of(b" ".join(words)).tolist() == hasher(words).tolist()
    assert hasher([]).tolist() == []


@pytest.mark.parametrize("values", [3, 1 << 60])
def test_entries_are_the_least_of_a_stretch(values):
    rng = np.random.default_rng(7)
    for n in (5, 6, 9, 40):
        runs = rng.integers(0, values, n).astype("u8")
        want = {i for j in range(n - 4) for i in range(j, j + 5) if runs[i] == runs[j : j + 5].min()}
        assert substring_dedup.index_places(runs, 5).tolist() == sorted(want)


def test_factors_name_their_source(spark):
    shared = [f"s{i}" for i in range(300)]
    docs = [(d, " ".join([f"d{d}_{i}" for i in range(50 + d)] + shared[10 * d :] + [f"e{d}_{i}" for i in range(9)])) for d in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(df, df) == removed(docs)
    texts = {r.c1: (r.text.split(), r.c2) for r in substring_dedup.with_text_key(df).collect()}
    rows = [r for r in substring_dedup.parsed(df).collect() if r.n_removed]
    assert len(rows) == 6
    for r in rows:
        for at, n, source, place in r.factors:
            assert (source, place) != (r.c1, at) and n >= 35
            assert texts[r.c1][0][at : at + n] == texts[source][0][place : place + n]


# 7 urls


def test_urls(spark, odd):
    urls = ["HTTP://A.Example.ORG/es/x?q#f", "http://example.org/en/1", "http://notexample.org/en/1", "http://x.com", "ftp://b.com/de/", None, "no scheme", "http://", "http://net/a/b/c/d/e/f/7?x", "http://h\n.com/fr/"]
    pages = spark.createDataFrame([(i, u, "h", "s") for i, u in enumerate(urls)] + [(None, None, None, None)] * 2, "page_id long, url string, html string, tail string")
    labels = spark.createDataFrame([(7, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filtered_urls(pages, labels).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[1][2:] == ("example.org/en/1", "block")
    assert got[2][2:] == ("org/", "allow") and got[3][:3] == ("x.com", "", None) and got[4][2:] == ("com/de/", "block")
    assert got[5][:3] == got[6][:3] == got[None][:3] == ("", "", None) and got[7][:2] == ("", "")
    assert url_filters.filtered_urls(pages.limit(0), labels).count() == 0


def tree_of(rows, marks, fits):
    """page_id -> (template, decided_by, bad share, verdict), by recursion over dictionaries. rows: page_id, host, path."""
    prior, z, few = url_filters.PRIOR, url_filters.Z, url_filters.MIN_BRANCH
    label = {}
    for page, _, path in rows:
        m = re.search(r"/(\d{1,18})(?:\.\w+)?/?$", path)
        label[page] = marks.get(int(m[1])) if m else None
        label[page] = None if label[page] is None else (fits[int(m[1])], label[page])
    tally = lambda ps: (sum(1 for p in ps if label[p] and label[p][0]), sum(label[p][1] for p in ps if label[p] and label[p][0]))
    n, bad = tally(label)
    share = bad / n if n else 0.0

    def differs(a, b):
        if not a[0] or not b[0]:
            return 0
        p = (a[1] + b[1] + prior * share) / (a[0] + b[0] + prior)
        gap = (a[1] + prior * p) / (a[0] + prior) - (b[1] + prior * p) / (b[0] + prior)
        error = z * (p * (1 - p) * (1 / (a[0] + prior) + 1 / (b[0] + prior))) ** 0.5
        return 1 if gap > error else -1 if gap < -error else 0

    less = lambda a, b: (a[0] - b[0], a[1] - b[1])
    out = {}

    def grow(members, depth, template, own, purity):
        """members: page -> segments."""
        on = {p: s for p, s in members.items() if len(s) > depth}
        out.update({p: (template, own, purity) for p in members if p not in on})
        by = {}
        for p, s in on.items():
            seg = s[depth]
            by.setdefault(re.sub(r"^[^.]*", "*", seg) if re.search("[0-9]", seg) or len(seg) > 40 else seg, []).append(p)
        whole, sums = tally(on), {k: tally(ps) for k, ps in by.items()}
        side = {k: 0 if len(ps) < few else differs(sums[k], less(whole, sums[k])) for k, ps in by.items()}
        merged = {}
        for k, ps in by.items():
            peers = [j for j in by if side[j] == side[k]]
            pool = tally([p for j in peers for p in by[j]])
            own_name = len(peers) == 1 and len(ps) >= few or side[k] and differs(sums[k], less(pool, sums[k]))
            merged.setdefault(k if own_name else {0: "*", 1: "(+)", -1: "(-)"}[side[k]], []).extend(ps)
        for name, ps in merged.items():
            t, s = f"{template}{name}/", tally(ps)
            mine = differs(s, less(whole, s)) != 0
            now = (t, (s[1] + prior * purity) / (s[0] + prior)) if mine else (own, purity)
            if len(on) < few:
                out.update({p: (t, *now) for p in ps})
            else:
                grow({p: on[p] for p in ps}, depth + 1, t, *now)

    hosts = {}
    for page, host, path in rows:
        hosts.setdefault(host, {})[page] = [x for x in path.split("/") if x]
    for members in hosts.values():
        s = tally(members)
        grow(members, 0, "/", "/", (s[1] + prior * share) / (s[0] + prior))
    threshold = 2.0
    for t in reversed([share + f * (1 - share) for f in url_filters.STEPS]):
        held = [label[p][1] for p, o in out.items() if o[2] >= t and label[p] and not label[p][0]]
        threshold = t if held and (sum(held) + prior * share) / (len(held) + prior) >= t else threshold
    return {p: (t, d, round(s, 9), "block" if s >= threshold else "allow") for p, (t, d, s) in out.items()}


@pytest.mark.parametrize("planted", [False, True])
def test_template_tree_against_brute_force(spark, sf_dir, planted):
    if planted:
        rng = np.random.default_rng(4)
        kinds = ["spam/a", "spam/b", "junk/a", "news/x/2020", "news/x/old", "ads", "blog", "blog/in", "wiki/q1"] + [f"{a}{b}" for a in "pqrstuv" for b in "xyz"]
        odds = {"spam": 0.97, "junk": 0.9, "ads": 0.7, "news": 0.02, "wiki": 0.4}
        picks = [(i, f"http://h{i % 3}.net/{kinds[int(k)]}/{i}") for i, k in enumerate(rng.integers(0, len(kinds), 4000))]
        labels = [(i, int(rng.random() > odds.get(u.split("/")[3], 0.15)), 0) for i, u in picks if i % 4]
        pages = spark.createDataFrame([(i, u) for i, u in picks], "page_id long, url string")
        labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    else:
        pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    got = {r.page_id: r for r in url_filters.templates(pages, labels).collect()}
    marks = {r.doc_id: int(r.quality == 0 or r.toxic == 1) for r in labels.collect()}
    fits = {r.doc_id: r.f == 0 for r in labels.select(F.col("doc_id").cast("long").alias("doc_id")).select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("f")).collect()}
    want = tree_of([(r.page_id, r.host, r.path) for r in got.values()], marks, fits)
    assert {p: (r.template, r.decided_by, round(r.bad_share, 9), r.method_verdict) for p, r in got.items()} == want
    if planted:
        deciding = {(r.decided_by, r.method_verdict) for r in got.values()}
        assert len({d for d, v in deciding if v == "block"}) >= 2 and len({d for d, v in deciding if v == "allow"}) >= 2
        assert any("(+)" in r.template for r in got.values()) and any("/*/" in r.template for r in got.values())


def test_bad_templates_are_blocked(spark):
    rows = [(i, f"http://h.net/{'spam' if i % 2 else 'ok'}/page/{i}", "", "") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, tail string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(0, 200)], "doc_id long, quality int, toxic int")
    got = url_filters.filtered_urls(pages, labels).groupBy(F.col("path").contains("spam"), "verdict").count().collect()
    assert {(r[0], r.verdict, r["count"]) for r in got} == {(True, "block", 100), (False, "allow", 100)}


def test_templates_reach_the_last_segment(spark):
    kinds = ["en/2020/01/02/a/b/c/d/spam", "en/2020/01/02/a/b/c/d/news"]
    rows = [(i, f"http://h.net/{kinds[i % 2]}/{i}", "", "") for i in range(200)] + [(200 + i, "http://h.net/" + "x/" * 300 + f"{200 + i}", "", "") for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, tail string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = url_filters.filtered_urls(pages, labels).collect()
    assert Counter((r.verdict, r.page_id % 2) for r in got if r.page_id < 200) == {("block", 0): 100, ("allow", 1): 100}
    # alike branches go on together; where fewer than MIN_BRANCH go on, one last wildcard ends them
    assert {(r.template, r.verdict) for r in got if r.page_id >= 200} == {("/" + "*/" * 10, "allow")} and len(got) == 202


@pytest.mark.parametrize("slugs", [900, 1100])
def test_a_tail_of_rare_siblings_leaves_hot_branches_alone(spark, slugs):
    word = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    rows = [(i, f"http://h.net/spam/{i}", "", "") for i in range(1000)] + [(1000 + i, f"http://h.net/{word(i)}/{1000 + i}", "", "") for i in range(slugs)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, tail string")
    labels = spark.createDataFrame([(i, int(i >= 1000), 0) for i in range(1000 + slugs)], "doc_id long, quality int, toxic int")
    got = Counter((r.verdict, r.page_id < 1000) for r in url_filters.filtered_urls(pages, labels).collect())
    assert got == {("block", True): 1000, ("allow", False): slugs}


# 8 archives


def test_archives(spark):
    rows = [(1, "http://a", "x"), (2, None, "x"), (3, "u\r\nv", None), (4, "", ""), (None, "http://n", "x"), (5, "http://l", "é" * 99_999), (2, None, "x")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, sha string")
    packages = warc.write_packages(pages, package_bytes=1000)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_packages(packages).collect())
    d = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert got == Counter({
        (1, 1, d("x"), "response", None): 1, (2, 1, d("x"), "revisit", 1): 2, (None, 1, d("x"), "response", None): 1, (3, 0, d(""), "response", None): 1,
        (4, 0, d(""), "revisit", 3): 1, (5, 199_998, d("é" * 99_999), "response", None): 1,
    })
    held = packages.collect()
    assert len(held) == len({r.archive for r in held}) > 1
    data = bytes(held[0].zip)
    assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None
    assert warc.read_packages(warc.write_packages(pages.limit(0))).count() == 0


def test_archives_of_the_pages_table_against_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = pages.select("page_id", "url", "html").collect()
    pages = pages.select("page_id", "url", "html").union(spark.createDataFrame([(r.page_id + 10**6, r.url, r.html) for r in rows[::7]], "page_id long, url string, html string"))
    html = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    least = {}
    for i, h in sorted(html.items()):
        least.setdefault(h, i)
    for min_bytes in (0, 3000):
        got = {r.page_id: tuple(r)[1:] for r in warc.read_packages(warc.write_packages(pages, min_bytes, 100_000)).collect()}
        assert got == {
            i: (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), *(("revisit", least[h]) if least[h] != i and len(h) >= min_bytes else ("response", None)))
            for i, h in html.items()
        }


def test_one_hot_payload_fills_many_packages(spark):
    pages = spark.createDataFrame([(None, None, "same " * 100)] * 400, "page_id long, url string, html string")
    packages = warc.write_packages(pages, package_bytes=2_000).collect()
    assert len(packages) > 10 and max(len(r.zip) for r in packages) < 40_000


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_reader(zip64):
    members = [("a", b"0123456789"), ("d/é", b"")]
    data = warc.write_zip(members, zip64)
    assert zipfile.ZipFile(io.BytesIO(data)).read("a") == members[0][1]
    r = warc.ZipReader(warc.Source(data))
    assert r.read_range("a", 3, 4) == b"3456" and r.members["d/é"][2] == 0
    with pytest.raises(ValueError):
        r.read_range("a", 8, 4)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("s", "stored")
        z.writestr(zipfile.ZipInfo("c"), "c" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 in a comment"
    r = warc.ZipReader(warc.FileSource(out))
    assert r.read_range("s", 0, 6) == b"stored"
    with pytest.raises(ValueError):
        r.range_of("c")


# 9 quality


def base_of(t):
    w = WORD.findall(t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(zip(w, w[1:], w[2:]))
    cov = {i + j for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cov), len(w) < 50 or 100 * len(cov) > 50 * len(w)


def test_quality_columns(spark, sf_dir, odd):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for docs in (odd, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        rows = quality_rules.scored(docs.select("doc_id", "text"), labels, []).collect()
        assert Counter((r.doc_id, *(r[n] for n in names)) for r in rows) == Counter((r.doc_id, *base_of(r.text)) for r in docs.collect())
        assert not any(r.kept and r.base_failed for r in rows)
    kept = quality_rules.reject_documents(odd, labels)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {1, 2, 6, 12, None}


@pytest.mark.parametrize("spare", [0, 50])
def test_repeated_windows_whose_hash_bits_clash(spark, monkeypatch, spare):
    monkeypatch.setattr(quality_rules, "SPARE_BITS", spare)  # at 50 few hash bits are left
    rng = np.random.default_rng(spare)
    texts = [" ".join(f"{x}" for x in rng.integers(0, top, n)) for top, n in ((3, 60), (12, 400), (40, 900), (10**6, 700), (2, 3), (2, 4), (1, 200))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.base_features(docs).collect()}
    assert got == {i: base_of(t)[4] for i, t in enumerate(texts)}


def test_grams_are_compiled_and_those_of_the_lambdas(spark, odd):
    docs = odd.select("text").withColumn("w", quality_rules.words(F.col("text"))).withColumn("rid", F.monotonically_increasing_id())
    want = {r.rid: sorted(r.b) for r in docs.select("rid", quality_rules._buckets(F.col("w")).alias("b")).collect()}
    rows = quality_rules.gram_rows(docs.drop("text"), quality_rules.LEAST_BUCKETS)
    got = {}
    for r in rows.collect():
        got.setdefault(r.rid, []).extend(b for b in (r.one, r.two) if b is not None)
    assert {k: sorted(v) for k, v in got.items()} == want
    assert "lambda" not in rows._jdf.queryExecution().executedPlan().toString()


def test_words_are_split_at_just_the_six_white_space_bytes(spark):
    texts = [None, "", " \t\n\x0b\x0c\r", "a", " a\u00a0b  c\r\nd\x0b\x0ce\tf ", "\x1c\x85\u2028x \x00 y"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", quality_rules.words(F.col("text")).alias("w")).collect()
    assert [r.w for r in rows] == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_scores_against_brute_force(spark, sf_dir):
    """The hash of n-grams and ids is Spark's; counts, weights, scores, threshold and verdicts are worked out here."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    w = docs.select("doc_id", "text", quality_rules.words(F.col("text")).alias("w"))
    rows = w.select("doc_id", "text", quality_rules._buckets(F.col("w")).alias("b")).collect()
    marks = {}
    for r in labels.collect():
        marks.setdefault(r.doc_id, []).append((r.quality, r.toxic or 0))
    fits = {r.doc_id: r.f == 0 for r in labels.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(2)).alias("f")).collect()}
    kind = {i: 1 if all(m == (1, 0) for m in ms) else 0 if all(m[0] == 0 for m in ms) else None for i, ms in marks.items()}
    raw, target = Counter(), Counter()
    for r in rows:
        raw.update(r.b)
        if kind.get(r.doc_id) == 1 and fits[r.doc_id]:
            target.update(r.b)
    n, m = sum(raw.values()), sum(target.values())
    weight = {b: math.log((target[b] + 5) / (k * m / n + 5)) for b, k in raw.items()}
    score = {r.doc_id: sum(weight[b] for b in r.b) / max(len(r.b), 1) for r in rows}
    failed = {r.doc_id: base_of(r.text)[5] for r in rows}
    held = [(math.floor(score[i] * 1024), k) for i, k in kind.items() if k is not None and not fits[i] and i in score and not failed[i]]
    shares = lambda t: (sum(s < t and k == 0 for s, k in held) / sum(k == 0 for _, k in held), sum(s < t and k for s, k in held) / sum(k for _, k in held))
    steps = sorted({s for s, _ in held})
    top = max(round(shares(s + 1)[0] - shares(s + 1)[1], 9) for s in steps)
    k = next(k for k, s in enumerate(steps) if round(shares(s + 1)[0] - shares(s + 1)[1], 9) == top)
    threshold = (steps[k] + 1 + (steps[k + 1] if k + 1 < len(steps) else steps[k] + 1)) / 2 / 1024
    for r in quality_rules.op9_quality_rules(spark, sf_dir).collect():
        assert abs(r.score - score[r.doc_id]) < 1e-5
        if abs(r.score - threshold) > 1e-5:
            assert r.kept == (not failed[r.doc_id] and r.score >= threshold)


def test_quality_separates_labelled_documents(spark):
    """Held out by a third part: labels that make neither the target nor the threshold."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    unseen = F.pmod(F.xxhash64(F.lit("third"), "doc_id"), F.lit(3)) == 0
    quality = {r.doc_id: r.quality for r in labels.filter(unseen).filter("toxic = 0").collect()}
    rows = [r for r in quality_rules.scored(docs, labels.filter(~unseen), []).collect() if r.doc_id in quality and not r.base_failed]
    good, poor = ([r.kept for r in rows if quality[r.doc_id] == q] for q in (1, 0))
    assert len(good) > 50 and len(poor) >= 5
    assert sum(good) >= 0.95 * len(good) and sum(poor) <= 0.25 * len(poor)


def test_quality_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality_rules.scored(odd.select("doc_id", "text"), none, []).collect()
    assert all(r.kept == (not r.base_failed) for r in rows)


# 10 chat


def test_chat_round_trips():
    for t in ["<|im_end|>", "<\\|x", "<\\\\||", "a<b|c", "\\n\n", "", "<|<|"]:
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.parse_turn(chat.format_turn(t, t)) == (t, t)


def test_chat_trees(spark, monkeypatch):
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", "hello" if k < 2 else f"t{c % 3}") for c in range(12) for k in range(4)]
    rows += [(50, 0, None, None), (51, None, "assistant", "<|im_end|>"), (51, 1, "assistant", "b"), (None, 0, "user", "x"), (52, 0, "assistant", "a"), (52, 0, "assistant", "a")]
    df = spark.createDataFrame([(*r, "p") for r in rows], "conv_id long, turn long, role string, text string, part string")
    for group in (256, 2):
        monkeypatch.setattr(chat, "GROUP", group)
        got = {r.conv_id: r for r in chat.read_trees(chat.build_trees(chat.conversations_of(df))).collect()}
        assert len(got) == 16 and got[0].n_turns == 4 and got[0].loss_chars == 7
        assert got[51].loss_sha256 == sha("<|im_end|>b") and got[52].loss_sha256 == sha("aa") and got[50].turns_sha256 == sha("\n\n")
    monkeypatch.setattr(chat, "GROUP", 256)
    tree = next(t for t in chat.build_trees(chat.conversations_of(df)).collect() if 0 in t.conv_ids)
    assert len(tree.parent) == 2 + 3 * 2 and tree.text.count("hello") == 2  # shared turns stand once


def test_intervals_and_position_ids_are_those_of_the_ancestors(spark):
    rng = np.random.default_rng(3)
    rows = [(c, k, ["user", "assistant", "tool"][k % 3], f"turn {x} <|im_end|>\n{'y' * int(x)}") for c in range(120) for k, x in enumerate(rng.integers(0, 2, rng.integers(1, 9)))]
    trees = chat.build_trees(chat.conversations_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert len(trees) == 2 and max(len(a) for t in trees for a in t.attends) > 4
    for t in trees:
        for k, p in enumerate(t.parent):
            may, at = set(), p
            while at >= 0:
                may |= set(range(t.start[at], t.start[at] + t.length[at]))
                at = t.parent[at]
            spans = list(zip(t.attends[k][::2], t.attends[k][1::2]))
            assert {x for a, b in spans for x in range(a, b)} == may and len(may) == t.position[k]
            assert all(a < b for a, b in spans) and all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))  # in order, apart
            role, text = chat.parse_turn(t.text[t.start[k] : t.start[k] + t.length[k]])
            masked = t.text[t.loss_start[k] : t.loss_end[k]] if t.loss_start[k] >= 0 else None
            assert (masked is not None) == (role == "assistant") and (masked is None or chat.unescape(masked) == text)


def test_hot_first_turns_keep_sharing_later_ones(spark, monkeypatch):
    monkeypatch.setattr(chat, "GROUP", 4)
    said = {c: ["system", f"a{c // 4}", f"b{c // 2}", f"c{c}"] for c in range(63)}  # one hot turn, then groups of 4
    said |= {100 + c: ["system", "hot", "hot too", f"d{c // 3}", f"e{c}"] for c in range(12)}  # a chain of hot turns
    said |= {200 + c: ["system", "hot"] for c in range(9)} | {300 + c: ["system"] for c in range(3)}  # equal, and ended at a hot turn
    said |= {None: ["system", "a15", "null id"], 400: ["another"], 401: ["another", "x"]}
    rows = [(c, k, "user", t) for c, ts in said.items() for k, t in enumerate(ts)]
    conversations = chat.conversations_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    trees = chat.build_trees(conversations).collect()
    met = Counter(chat.parse_turn(t.text[a : a + n])[1] for t in trees for a, n in zip(t.start, t.length))
    hot = {"system", "hot", "hot too"}
    assert {t: n for t, n in met.items() if t not in hot} == {t: 1 for ts in said.values() for t in ts if t not in hot}
    assert met["system"] <= 17 + 3 + 3 + 1 and met["hot"] <= 3 + 3 + 1 and met["hot too"] <= 3
    assert Counter(c for t in trees for c in t.conv_ids) == Counter(list(said))
    got = {r.conv_id: r.turns_sha256 for r in chat.read_trees(chat.build_trees(conversations)).collect()}
    assert got == {c: sha("".join(f"user\n{t}\n" for t in ts)) for c, ts in said.items()}


# tables without rows, and the pipeline


def test_empty_tables(spark, odd):
    none, labels = odd.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (minhash_dedup.drop_near_duplicates, line_dedup.dedup_lines, substring_dedup.drop_repeats, lambda d: quality_rules.reject_documents(d, labels)):
        assert f(none).columns == odd.columns and f(none).count() == 0
    assert media.read_media(media.write_media(none)).count() == 0
    assert packing.pack(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert bpe.encode_documents(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_trees(chat.build_trees(chat.conversations_of(turns))).count() == 0


def pipeline_by_hand(docs, kept_by_quality):
    """(doc_id, text) after the first four stages, one text at a time. Verdicts of quality are given."""
    docs = [(i, t) for i, t in docs if (i, t) in kept_by_quality]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    order = lambda i: (i is not None, i or 0)
    holders = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    last = {k: max(v, key=order) for k, v in holders.items() if len(v) >= 5}
    lines = [(i, [x for x in t.split("\n") if last.get(key(x), i) == i]) for i, t in docs]
    docs = [(i, "\n".join(x)) for i, x in lines]
    comp = components_of(docs, 5, 80)
    docs = [(i, t) for i, t in docs if i is None or comp[i] == i]
    seen, words = Counter(), [(i, t, WORD.findall(t)) for i, t in docs]
    for _, _, w in words:
        seen.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    out = []
    for i, t, w in words:
        gone = {k + j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(35)}
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t))
    return out


@pytest.mark.parametrize("kind", ["awkward", "empty", "planted"])
def test_the_whole_pipeline(spark, tmp_path, odd, kind):
    corpus = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(12)
    if kind == "planted":
        word = lambda n: [f"{'abcdefgh'[x % 8]}{x}" for x in rng.integers(0, 5000, n)]
        passage, line, rows = word(60), " ".join(word(9)) + " a line that many share", []
        for i in range(60):
            w = word(150)
            text = " ".join(w[:70] + (passage if i % 6 == 0 else []) + w[70:]) + (f"\n{line}" if i % 3 == 0 else "")
            rows.append((i, text))
            if i % 10 == 0:
                rows += [(100 + i, text), (200 + i, text.replace(w[5], "other", 1))]  # a copy and a near copy
        docs = spark.createDataFrame([(i, t, "en", True, "c", "n", 1, 2) for i, t in rows], DOCS)
    else:
        docs = odd if kind == "awkward" else odd.limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names = docs.columns
    kept = [(r.doc_id, r.text) for r in corpus.STAGES[0][1](spark, docs, str(tmp_path)).collect()]
    want = pipeline_by_hand([(r.doc_id, r.text) for r in docs.collect()], set(kept))
    after = docs
    for _, stage in corpus.STAGES[:-1]:
        after = corpus.written(stage(spark, after, str(tmp_path)), "t")
        assert after.columns == names
    assert Counter((r.doc_id, r.text) for r in after.collect()) == Counter(want)
    tok, pieces = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for i, t in want:
        n = len(tok.encode(t or "", add_special_tokens=False).ids) + 1
        pieces.update([(i, n % 1024 or 1024)] + [(i, 1024)] * ((n - 1) // 1024))
    rows = corpus.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.length) for r in rows) == pieces
    if kind == "planted":
        assert 0 < len(want) < docs.count() and any(" ".join(passage) not in t for i, t in want if i % 6 == 0)


def test_pipeline_stages(spark, sf_dir):
    corpus = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = corpus.written(stage(spark, docs, sf_dir), "t")
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns
        if name == "minhash near-dedup":
            want = components_of(before, 5, 80)
            assert set(after) == {i for i, c in want.items() if i == c}
        if name == "substring dedup":
            assert Counter((i, sha(" ".join(WORD.findall(t or "")))) for i, t in after.items()) == Counter((i, s) for i, _, _, s in removed(before))
        if name == "line dedup":
            assert len(after) == len(before)
    pieces = corpus.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(after)
