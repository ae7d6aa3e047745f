"""The training-data operators against brute force, libraries, and awkward tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigloom.llm import quality_classifier as qc
from sigloom.llm import quality_rules as qr
from sigloom.llm import pieces
from sigloom.llm.byte_bpe import BacktrackingBpe, read_ranks, round_trip
from sigloom.llm.components import components, roots
from sigloom.llm import embedding_dedup as ed
from sigloom.llm.embedding_dedup import CoverTree, embedding_dedup, near_nodes, unit
from sigloom.llm.language_id import Profiles, gram_counts, language_id, profile
from sigloom.llm.library_bpe import LibraryEncoder
from sigloom.llm.license_scan import license_scan
from sigloom.llm.minhash_dedup import keep_first, minhash_dedup, shingles, signature
from sigloom.llm.packing import pack
from sigloom.llm.queries import BYTE_BPE, MULTI_RANKS, QUERIES
from sigloom.llm.storage import Workspace
from sigloom.llm.textstats import base_counts
from sigloom.llm.token_counts import Counter as TokenCounter, token_counts
from sigloom.llm.token_records import Ranges, encode, frame, parsed, ranges, read, read_record, records, token_records, write

PLAIN = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names clash with those that operators use inside.
EXTRA = ", component_id long, score double, key string, rep long, x string"


def awkward(spark):
    """Nulls everywhere, empty, blank, tiny and very long texts, copies, repeated rows, clashing columns."""
    rng = random.Random(4)
    words = ["the", "a", "wonder", "stone", "river", "häuser", "niño", "été", "x1", "***", "…", "日本"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = line(30_000)
    texts = [None, "", " ", "\n\n", "a", "one two", "Å", "<|endoftext|> a", line(50), long, long, long + " more", "x" * 50_000, "a  b\n\n c\t\td", "it's 'll don't", *(line(40) for _ in range(8))]
    rows = [(k, t, [None, "en", "de"][k % 3], [None, "s"][k % 2], None) for k, t in enumerate(texts)]
    rows += [(None, "no id here", "en", "s", 1), (None, None, None, None, None), rows[8], rows[8]]
    return spark.createDataFrame([(*r, 1, 0.5, "k", 2, "x") for r in rows], PLAIN + EXTRA)


def empty(spark):
    return spark.createDataFrame([], PLAIN + EXTRA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def odd_texts():
    rng = random.Random(1)
    parts = ["a", "b", "e", "th", "in", "er", "'", "s", "re", "v", " ", "  ", "\n", "\t", "1", "23", ".", "é", "日", "!", "😀", "the", "\xa0", "\x1c", "A", "\r"]
    fixed = ["", " ", "\n", "  a  b", "a \nb", "foo\r.\r\n x", "''s 's'", "x\r. \r. y, . , a .", "a" * 700, "<|endoftext|> a<|endoftext|>"]
    return fixed + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(1500)]


# Tokenizers


def test_library_encoder_equals_the_library():
    from tokenizers import Tokenizer

    own, lib = LibraryEncoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    for text, got in zip(odd_texts(), own.encode_many(odd_texts()), strict=True):
        assert got.tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_pieces_equal_the_pre_tokenizer_in_any_chunks(monkeypatch):
    from tokenizers import pre_tokenizers

    library = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    texts = [*odd_texts(), "", "\u0558\ua7ce letters of no version", "'re", "'r", "x'l", "''ll", " 's", "\n's", "\t\t'v 'd", " " * 700 + "x", "a" * 900 + "'", "\n" * 600]
    for chunk in (1, 3, 7, 256):
        monkeypatch.setattr(pieces, "CHUNK", chunk)
        found = pieces.cut(pa.array(texts))
        distinct = [x.decode() for x in found.distinct.to_pylist()]
        for k, t in enumerate(texts):
            got = [distinct[i] for i in found.which[found.bounds[k] : found.bounds[k + 1]]]
            assert got == [t[a:b] for _, (a, b) in library(t)], (chunk, t)


def test_every_code_point_has_the_library_class():
    from tokenizers import pre_tokenizers

    library = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    kinds, rng = pieces.classes(), random.Random(3)
    for c in [*range(0x3000), *rng.sample(range(0xE000, 0x110000), 20_000)]:
        kind = next((k for k, sign in ((pieces.L, "a"), (pieces.N, "1"), (pieces.O, "!")) if len(library(sign + chr(c))) == 1), pieces.S)
        own = {pieces.B: pieces.S, pieces.Q: pieces.O}.get(kinds[c], pieces.L if kinds[c] <= pieces.LL else kinds[c])
        assert own == kind, hex(c)


def test_state_maps_compose_associatively():
    maps = np.random.default_rng(1).integers(0, pieces.STATES, (37, pieces.STATES))
    got, now = pieces.scan(maps), np.arange(pieces.STATES)
    for row, own in zip(got, maps, strict=True):
        now = own[now]
        assert (row == now).all()
    a, b, c = maps[:3]
    assert (c[b[a]] == c[b][a]).all()


def test_transducer_counts_equal_the_library(monkeypatch):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTE_BPE)
    want = [len(lib.encode(t, add_special_tokens=False).ids) for t in odd_texts()]
    assert TokenCounter(BYTE_BPE).count_many(pa.array(odd_texts())).tolist() == want
    monkeypatch.setattr(pieces, "SLICE", 50)
    assert TokenCounter(BYTE_BPE).count_many(pa.array(odd_texts())).tolist() == want


def test_counts_hold_when_tables_start_anew_within_a_piece(monkeypatch):
    from tokenizers import Tokenizer

    lib, rng = Tokenizer.from_file(BYTE_BPE), random.Random(2)
    long = ["".join(rng.choice("abcdefghij日本語漢字") for _ in range(3000)), "".join(rng.choice("abcdefgh") for _ in range(40_000)), " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(5, 40))) for _ in range(60))]
    texts = [*odd_texts()[:300], *long]
    want = [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    for limit, size in ((40, 11), (40, 64), (1000, 1 << 14)):
        counter = TokenCounter(BYTE_BPE)
        counter.transducer.LIMIT, counter.transducer.SLICE = limit, size
        assert counter.count_many(pa.array(texts)).tolist() == want


def test_stores_forget_and_stay_right():
    learned = []

    def learn(new):
        learned.append(len(new))
        return np.frombuffer(b"".join(new), np.uint8), np.fromiter(map(len, new), np.int64, len(new))

    rng, store = random.Random(1), pieces.PieceStore(learn, np.uint8, limit=20)
    for _ in range(300):
        own = list({("%d" % rng.randint(0, 60)).encode() * rng.choice([1, 1, 40]) for _ in range(rng.randint(0, 30))})
        codes, first, lengths = store.look(pa.array(own, pa.binary()))
        assert [codes[a : a + n].tobytes() for a, n in zip(first, lengths, strict=True)] == own
    assert len(store._known) <= 20 and sum(learned) > 100


def test_backtracking_equals_tiktoken_and_decodes():
    import tiktoken

    ranks = read_ranks(MULTI_RANKS)
    own = BacktrackingBpe(ranks, public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text, got in zip(odd_texts(), own.encode_many(odd_texts()), strict=True):
        assert got.tolist() == lib.encode_ordinary(text), text
        assert own.decode(got.tolist()) == text.encode()


def test_token_tables_on_awkward_rows(spark):
    docs = awkward(spark)
    counts = token_counts(docs, BYTE_BPE).toPandas()
    trip = round_trip(docs, MULTI_RANKS, public_tokenizers.PATTERN).toPandas()
    assert len(counts) == len(trip) == docs.count()
    import tiktoken
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTE_BPE)
    multi = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(MULTI_RANKS), special_tokens={})
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    told = [(k, len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)) for k, t in texts]
    assert Counter((None if k != k else int(k), b, n) for k, b, n in zip(counts.doc_id, counts.n_bytes, counts.n_tokens, strict=True)) == Counter(told)
    digest = lambda t: hashlib.sha256(np.array(multi.encode_ordinary(t), "<u4").tobytes()).hexdigest()
    assert Counter(trip.ids_sha256) == Counter(digest(t) for _, t in texts)
    assert (counts.over_limit == (counts.n_tokens > 512)).all()
    want = Counter(hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect())
    assert Counter(trip.decoded_sha256) == want
    assert token_counts(empty(spark), BYTE_BPE).count() == round_trip(empty(spark), MULTI_RANKS, public_tokenizers.PATTERN).count() == 0


def test_records_round_trip(spark, tmp_path):
    docs, enc = awkward(spark), LibraryEncoder(BYTE_BPE)
    docs = docs.unionByName(docs.limit(1).selectExpr("-1L AS doc_id", "'minus one' AS text", *docs.columns[2:]))
    rows = token_records(spark, docs, BYTE_BPE).orderBy("start").collect()
    place = lambda k: (k is not None, k or 0)
    assert len(rows) == docs.count() and [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=place)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    want = Counter((r.doc_id, zlib.crc32(np.append(enc.encode(r.text), 0).astype("<u4"))) for r in docs.collect())
    assert Counter((r.doc_id, r.ids_crc32) for r in rows) == want and sum(r.doc_id is None for r in rows) == 2 and sum(r.doc_id == -1 for r in rows) == 1
    assert token_records(spark, empty(spark), BYTE_BPE).count() == 0
    # A single record by its row of the index; a damaged one is found out.
    folder = f"file://{tmp_path}/shards"
    into = ranges(docs, 4)
    assert into.nulls == 1
    index = Workspace(spark, "t").cut(write(encode(docs, BYTE_BPE, into), folder, into.count, 2), "index")
    one = index.where("doc_id = 8").first()
    doc_id, ids = parsed(read_record(folder, one.shard, one.place, one["size"]))
    assert doc_id == 8 and ids.tolist() == [*enc.encode(docs.where("doc_id = 8").first().text), 0]
    data = bytearray(frame(b"payload!" * 3))
    data[20] ^= 1
    with pytest.raises(ValueError):
        import io

        list(records(io.BytesIO(bytes(data))))
    back = read(index, folder, 3)
    assert back.count() == docs.count() and back.rdd.getNumPartitions() == 3


def test_shards_split_a_hot_id_in_order():
    rng = np.random.default_rng(4)
    into = Ranges(2, [5, 7, 7, 7, 9])
    ids = [None] * 40 + [-(2**63)] + [3] * 9 + [5] * 9 + [6] * 9 + [7] * 90 + [8] * 9 + [9] * 9 + [2**63 - 1] * 9
    places = into.places(pa.array(ids, pa.int64()), rng.integers(-(2**63), 2**63 - 1, len(ids)))
    assert set(places[:40]) == {0, 1} and set(places[np.array([k == 7 for k in ids])]) == {3, 4, 5} and places.max() == into.count - 1
    order = sorted(zip(places, [(k is not None, k or 0) for k in ids], strict=True))
    assert [k for _, k in order] == sorted(k for _, k in order)


def test_packing_covers_every_token_once(spark):
    docs, enc = awkward(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), LibraryEncoder(BYTE_BPE)
    got = pack(docs, BYTE_BPE).toPandas()
    for r in docs.collect():
        ids = np.append(enc.encode(r.text), 1).astype("<u4")
        own = got[got.doc_id == r.doc_id].sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
        assert all(zlib.crc32(ids[s : s + n]) == c for s, n, c in zip(own.start, own.length, own.ids_crc32, strict=True))
    short = 0
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        total = seq.length.sum()
        assert seq.offset.tolist() == [0, *seq.length.cumsum()[:-1]] and total <= seq.tier.iloc[0] <= 2048
        short += total < seq.tier.iloc[0]
    assert short <= docs.rdd.getNumPartitions()
    full = got.groupby(["step_group", "tier"]).length.sum()
    assert (full <= 16 * 2048).all()
    assert pack(awkward(spark), BYTE_BPE, keep_caches=False).count() == pack(awkward(spark), BYTE_BPE).count() > 0 and pack(empty(spark), BYTE_BPE).count() == 0


# Quality


def slow_counts(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_base_counts_equal_a_plain_count(spark):
    rng = random.Random(2)
    texts = [r.text for r in awkward(spark).collect() if r.text is None or len(r.text) < 5000] + odd_texts()[:200]
    texts += ["\n".join(" ".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(12)) for _ in range(60)]
    for t in texts:
        assert base_counts(t) == slow_counts(t), t


def test_rules_on_awkward_rows(spark):
    docs = awkward(spark)
    got = qr.quality_rules(spark, docs, docs.where("length(text) > 100").select("text"))
    assert got.count() == docs.count() and got.where("base_failed AND kept").count() == 0
    assert qr.quality_rules(spark, docs, empty(spark)).where("score <> 0").count() == 0
    assert qr.quality_rules(spark, empty(spark), empty(spark)).count() == 0
    kept = qr.keep_by_rules(spark, docs, docs.select("text"))
    assert kept.columns == docs.columns and kept.count() == qr.quality_rules(spark, docs, docs.select("text")).where("kept").count()


def test_rules_reject_what_trusted_texts_lack(spark):
    rng = random.Random(3)
    good = [" ".join("".join(rng.choice("aeiou" + "nrstl") for _ in range(5)) for _ in range(60)) for _ in range(60)]
    junk = [" ".join("".join(rng.choice("#$%&*") for _ in range(5)) for _ in range(60)) for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate(good + junk)), "doc_id long, text string")
    got = {r.doc_id: r.kept for r in qr.quality_rules(spark, docs, docs.where("doc_id < 30")).collect()}
    assert all(got[k] for k in range(60)) and not any(got[k] for k in range(60, 66))


def test_trusted_counts_take_every_good_label(spark, tmp_path):
    ids = spark.range(20_500).orderBy(F.xxhash64("id"), "id").toPandas()["id"].tolist()
    rng = random.Random(8)
    rare = " ".join("".join(rng.choice("qxzjkw") for _ in range(7)) for _ in range(40))
    spark.createDataFrame([(k, rare if k == ids[-1] else "aaa") for k in ids], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(20_500).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    # All texts are trusted, so every ratio is 0.
    assert QUERIES["op1_quality_rules"](spark, str(tmp_path)).where("NOT base_failed").select("doc_id", "kept").collect() == [(ids[-1], True)]


def test_counts_by_id_equal_a_join_in_any_blocks(spark):
    docs = awkward(spark)
    good = spark.createDataFrame([(k,) for k in [3, 3, 8, 9, 11, 14, 15, 16, 99, None]], "doc_id long")
    want = qr.counts(docs.join(good.distinct(), "doc_id", "left_semi"))
    for most in (1, 3, 100):
        blocks = list(qr.id_blocks(good, most))
        assert sorted(np.concatenate(blocks).tolist()) == [3, 8, 9, 11, 14, 15, 16, 99] and (most < 100 or len(blocks) == 1)
        assert (qr.counts_by_id(spark, docs, good, most=most) == want).all()
    assert not qr.counts_by_id(spark, docs, good.limit(0)).any() and not qr.counts_by_id(spark, empty(spark), good).any()


def test_classifier_separates_held_out_rows(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, marks = [], []
    for k in range(300):
        good = k % 3 > 0
        words = [rng.choice(vocab) for _ in range(rng.randint(40, 120))] if good else [rng.choice(vocab[:3]) for _ in range(60)]
        rows.append((k, " ".join(words)))
        marks.append((k, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = qc.quality_classifier(spark, docs, labels(spark, marks)).join(labels(spark, marks), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 20 and (held.predicted == held.quality).mean() > 0.95
    assert (got.held_out == got.doc_id.map(lambda k: zlib.crc32(str(k).encode()) % 5 == 0)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert qc.keep_good(spark, docs, labels(spark, marks)).count() == got.predicted.sum()


def test_classifier_on_awkward_rows(spark):
    docs = awkward(spark)
    for marks in ((), [(8, 1, 0)], [(8, 1, None), (9, 0, 0), (None, 1, 0), (12, None, 0), (8, 1, 0), (10, 1, 0)]):
        got = qc.quality_classifier(spark, docs, labels(spark, marks))
        assert got.count() == docs.count() and got.where("score IS NULL OR isnan(score)").count() == 0
    assert qc.quality_classifier(spark, empty(spark), labels(spark)).count() == 0


def test_language_profiles(spark):
    rng = random.Random(6)
    letters = {"aa": "abcde", "bb": "edfgh", "cc": "ñéüßo"}
    rows = [(k, " ".join("".join(rng.choice(letters[g]) for _ in range(6)) for _ in range(40)), g) for k, g in enumerate(list(letters) * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).all() and got.held_out.sum() > 5
    odd = language_id(spark, awkward(spark)).toPandas()
    assert len(odd) == awkward(spark).count() and odd.score.between(0, 1).all() and (odd.lang_pred == "und").sum() >= 4
    assert language_id(spark, empty(spark)).count() == 0


def test_out_of_place_distance():
    slow = Counter()
    for w in "the then".split():
        p = f"\x01{w}\x01"
        slow.update(list(w))
        for n in (2, 3):
            slow.update(p[i : i + n] for i in range(len(p) - n + 1))
    grams, count = gram_counts("The, then!")
    assert sorted(count.tolist()) == sorted(slow.values())
    own = profile(grams, count, 10)
    p = Profiles({"x": own.tolist()[::-1], "y": [1, 2]}, 10)
    assert p.distances(own) == [sum(abs(9 - 2 * i) for i in range(10)), 100]


# Near duplicates


def brute(sets: dict[int, set], percent: int) -> dict[int, int]:
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    out = {k: k for k in ids}
    if pairs:
        nodes, least = roots(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
        out |= dict(zip(nodes.tolist(), least.tolist(), strict=True))
    return out


def test_signatures_estimate_overlap():
    hits = []
    for seed in range(60):
        r = np.unique(np.random.default_rng(seed).integers(0, 2**63, 500).astype(np.uint64))
        hits.append((signature(r[:450], 160) == signature(r[50:], 160)).mean())
    assert abs(np.mean(hits) - 0.8) < 0.02


def test_groups_equal_brute_force(spark):
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = []
    for base in range(6):
        words = [rng.choice(vocab) for _ in range(120)]
        for copy in range(25):  # from exact copies to ones that are hardly alike
            own = list(words)
            for _ in range(copy // 3):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", "a", "A", "a b", "two words", "Two  Words"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent in ((3, 85), (5, 80)):
        sets = {k: set(shingles(t, width).tolist()) for k, t in rows}
        got = {r.doc_id: r for r in minhash_dedup(spark, docs, width, percent).collect()}
        want = brute(sets, percent)
        assert {k: r.component_id for k, r in got.items()} == want
        assert all(r.n_shingles == len(sets[k]) and r.kept == (want[k] == k) for k, r in got.items())


def test_crowded_buckets_in_tiles_equal_brute_force(spark, monkeypatch):
    """Texts made from a template, so that buckets hold many components; tiles, blocks, parts of hot keys and rare shingles made small."""
    from sigloom.llm import hot_keys
    from sigloom.llm import minhash_dedup as md

    monkeypatch.setattr(hot_keys, "LEAST", 3)
    monkeypatch.setattr(md, "TILE", 4), monkeypatch.setattr(md, "BLOCK", 5), monkeypatch.setattr(md, "RARE", 2)
    rng = random.Random(11)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for _ in range(30):  # each form differs from the template by one to three words, each of its copies by none or one of another few
        form = list(words)
        for at in rng.sample(range(60), rng.randrange(1, 4)):
            form[at] = f"x{rng.randrange(3)}"
        for _ in range(5):
            own = list(form)
            if rng.random() < 0.7:
                own[rng.randrange(60)] = f"y{rng.randrange(3)}"
            rows.append((len(rows), " ".join(own)))
    sets = {k: set(shingles(t, 3).tolist()) for k, t in rows}
    got = {r.doc_id: r.component_id for r in md.minhash_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == brute(sets, 85) and 1 < len(set(got.values())) < len(rows)


def test_repeated_rows_and_clashing_ids_lose_no_link(spark):
    """One bucket, whose centre (the smallest id) links with nothing; a and b link."""
    text = lambda seed, *parts: " ".join(f"{seed}w{k}" for p in parts for k in p)
    for seed in range(100):
        hub, a, b = (text(seed, range(80), *x) for x in ([range(200, 260)], [range(300, 360)], [range(300, 352), range(400, 408)]))
        if len({int(signature(shingles(t, 5), 1)[0]) for t in (hub, a, b)}) == 1:
            break
    own, alone = [(1, hub), (50, a), (51, b)], text("x", range(60))
    sets = {k: set(shingles(t, 5).tolist()) for k, t in own}
    want = brute(sets, 80)
    assert want == {1: 1, 50: 50, 51: 50}
    dedup = lambda rows: minhash_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, bands=1, rows=1).collect()
    for more in ([], [(50, a)], [(50, a), (51, b), (51, b)]):
        got = dedup(own + more)
        assert len(got) == len(own + more) and all(r.component_id == want[r.doc_id] and r.kept == (want[r.doc_id] == r.doc_id) for r in got)
    got = dedup([*own, (51, alone)])
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id == 51) == [(56, 51, True), (len(sets[51]), 50, False)]
    got = dedup([*own, (50, alone), (51, alone)])
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(1, len(sets[1]), 1), (50, len(sets[50]), 50), (51, len(sets[51]), 50), (50, 56, 50), (51, 56, 50)}


def test_only_near_duplicates_of_a_clashing_id_go(spark):
    text = lambda name: " ".join(f"{name}{k}" for k in range(60))
    rows = [(1, text("a")), (2, text("a") + " more"), (2, text("b")), (3, text("c")), (3, text("d")), (3, text("d")), (4, text("e")), (4, text("e") + " more"), (5, None), (5, None)]
    got = keep_first(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, (r.text or "-")[0]) for r in got) == [(1, "a"), (2, "b"), (3, "c"), (3, "d"), (4, "e"), (5, "-")]


def test_dedup_on_awkward_rows(spark):
    docs = awkward(spark)
    got = minhash_dedup(spark, docs)
    assert got.count() == docs.count() and minhash_dedup(spark, empty(spark)).count() == 0
    assert {r.component_id for r in got.where("doc_id IN (9, 10, 11)").collect()} == {9}
    kept = keep_first(spark, docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 8").count() == 1 and kept.where("doc_id IS NULL").count() == 2
    assert kept.where("doc_id IN (9, 10, 11)").count() == 1


def test_hot_keys_join_like_plain_ones(spark, monkeypatch):
    from sigloom.llm import hot_keys

    monkeypatch.setattr(hot_keys, "LEAST", 10)
    many = spark.range(500).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 40 END AS key")
    few = many.groupBy("key").count().withColumnRenamed("count", "n")
    hot = hot_keys.hot_keys(few, "key", 500)
    rows = hot_keys.dealt(many, hot, "key", "id")
    got = rows.join(hot_keys.copied(few, hot, "key"), ["key", "part"]).select("id", "key", "n")
    assert sorted(got.collect()) == sorted(many.join(few, "key").select("id", "key", "n").collect())
    assert rows.where("key = 0").agg(F.countDistinct("part")).first()[0] > 10


def test_components(spark, monkeypatch):
    from sigloom.llm import hot_keys

    monkeypatch.setattr(hot_keys, "LEAST", 2)
    chain = [(k, k + 1) for k in range(200)] + [(1000, 1001), (1001, 1000), (5, 5), (None, 3), (300, 301)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long"), Workspace(spark, "c")).collect())
    assert got == {**{k: 0 for k in range(201)}, 1000: 1000, 1001: 1000, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "c")).count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base + rng.normal(scale=0.12, size=base.shape), np.repeat(base[:1], 30, axis=0), base[1:2] * 3 + rng.normal(scale=0.3, size=(40, 16))]).astype(np.float32)
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0]]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(len(x) + k, v, None) for k, v in enumerate(odd)] + [(None, x[0].tolist(), 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep int")
    got = {r.vec_id: r for r in embedding_dedup(spark, table).collect()}
    assert len(got) == len(rows)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    a, b = np.nonzero(np.triu(near))
    nodes, least = roots(a, b)
    want = {k: k for k in range(len(x))} | dict(zip(nodes.tolist(), least.tolist(), strict=True))
    assert all(got[k].n_links == near[k].sum() and got[k].component_id == want[k] and got[k].kept == (want[k] == k) for k in range(len(x)))
    n = len(x)
    assert all(got[n + k].n_links == 0 and got[n + k].kept for k in range(6)) and got[n + 7].component_id == n + 6 and got[n + 6].n_links == 1
    assert embedding_dedup(spark, table.limit(0)).count() == 0


# Licences


def test_licences_are_inherited_from_the_nearest_directory(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/x.py", "code"), ("a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        ("a/b/c/y.py", "code"), ("a/b/z.py", "# Licensed under the Apache License, Version 2.0.\ncode"), ("q/w.py", "license to kill"), ("top.py", None), (None, "Released under the MIT License."), ("e.py", ""),
        ("a/x.py", "code"),
    ]
    got = {r.path: r for r in license_scan(spark, spark.createDataFrame([(*r, 1, "k") for r in rows], "path string, text string, dot long, license string")).collect()}
    assert (got["a/x.py"].effective_license, got["a/x.py"].inherited_from) == ("MIT", "a")
    assert (got["a/b/c/y.py"].effective_license, got["a/b/c/y.py"].inherited_from) == ("GPL-3.0", "a/b")
    assert (got["a/b/z.py"].license, got["a/b/z.py"].inherited_from) == ("Apache-2.0", None)
    assert got["q/w.py"].effective_license is None and got["top.py"].effective_license is None
    assert license_scan(spark, spark.createDataFrame([], "path string, text string")).count() == 0


def test_real_headers_and_licence_files_state_their_licence(spark):
    mit = """Copyright (c) 2020 A. Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
    bsd2 = """Copyright (c) 2020, A. Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer."""
    bsd3 = bsd2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
    isc = """Copyright (c) 2020, A. Body

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
    gpl = """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version."""
    want = {
        "a/LICENSE": (mit, "MIT"), "b/LICENSE": (bsd2, "BSD-2-Clause"), "c/LICENSE.txt": (bsd3, "BSD-3-Clause"), "d/COPYING": (isc, "ISC"), "e.c": (gpl, "GPL-3.0"), "f.c": (gpl.replace("General", "Lesser General"), "LGPL-3.0"),
        "g.py": ("# SPDX-License-Identifier: MIT\ncode", "MIT"), "h.py": ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), "i.py": ("/* SPDX-License-Identifier: GPL-3.0-or-later */", "GPL-3.0"), "j.py": ("# SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
        "k.py": ("# SPDX-License-Identifier: Proprietary-1", None), "l.py": ("Copyright 2020 A. Body. All rights reserved.", None),
    }
    whole = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    for name, license in whole.items():
        if (path := Path("/usr/share/common-licenses") / name).exists():
            want[f"{name}/LICENSE"] = (path.read_text(), license)
    got = {r.path: r.license for r in license_scan(spark, spark.createDataFrame([(k, t) for k, (t, _) in want.items()], "path string, text string")).collect()}
    assert got == {k: license for k, (_, license) in want.items()}


def test_altered_licence_texts_state_their_licence_by_cosine(spark):
    """Bodies with words altered, header blocks with lines broken elsewhere, tags within expressions; prose states none."""
    from sigloom.llm.license_scan import PARTS

    neither = PARTS["neither"].replace("the copyright holder", "Acme Corporation")
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    block = "/*\n * Copyright 2020 A. Body\n *\n * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n *\n */\ncode\n\nx = 'licence'"
    want = {
        "a/LICENSE": ("\n\n".join(["My Project", "Copyright 2020 Acme", bsd, PARTS["source"], PARTS["binary"], neither, PARTS["bsd"]]), "BSD-3-Clause"),
        "b/LICENSE": ("\n\n".join(["My Project", "Copyright 2020 Acme", bsd, PARTS["source"], PARTS["binary"], PARTS["bsd"].replace("copyright holder", "regents")]), "BSD-2-Clause"),
        "c.h": ("\n".join(f"# {x}" for x in ["(c) Acme", "", PARTS["grant"].replace("the software", "this work"), "", PARTS["notice"], "", PARTS["mit"]]), "MIT"),
        "d.c": (block, "Apache-2.0"),
        "e.c": (block.replace("\n", "\r\n"), "Apache-2.0"),
        "f.c": ("// SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-2-Clause and other words that dilute the line a great deal", "GPL-2.0"),
        "g.md": ("A long talk about copyright and the public domain.\nNobody was licensed to do anything.\n" + "the software is of the people and for the people " * 50 + "\nno licence", None),
    }
    files = spark.createDataFrame([(k, t) for k, (t, _) in want.items()] * 2, "path string, text string")
    got = {r.path: r.license for r in license_scan(spark, files).collect()}
    assert got == {k: license for k, (_, license) in want.items()}


def test_license_query_on_awkward_documents(spark, tmp_path):
    """Null ids, slashes in a source, negative ids, ties, very long texts; against DuckDB on the same rows."""
    import duckdb

    tie = "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."
    rows = [(1, "Released under the MIT License.", "en", "a/b"), (12, "plain", "en", "a/b"), (None, "Licensed under the Apache License, Version 2.0.", None, "s"), (-5, "plain", "e/n", None), (5, tie, "e/n", None), (None, None, None, None)]
    rows += [(7, "word " * 100_000 + "\nReleased under the MIT License.", "en", "s"), (8, "", "en", "s"), (12, "plain", "en", "a/b")]
    rows += [(9, "// SPDX-License-Identifier: (MIT OR ISC)", "en", "s"), (90, "Copyright 2020 A. Body\n\n * This program is free software: you can redistribute it\n * and/or modify it under the terms of the GNU General Public License\n * as published by the Free Software Foundation, either version 3\n *\n\nend, no licence", "en", "s")]
    spark.createDataFrame([(*r, 0) for r in rows], PLAIN).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op8_license_scan"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    from sigloom.llm.queries import ORACLE

    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE['op8_license_scan']})").fetchall()
    assert Counter(tuple(r) for r in got.collect()) == Counter(want) and len(want) == len(rows)


def plain_discriminant(x, y, pool=qc.POOL, ridge=qc.RIDGE):
    """The posterior by the textbook formula, with inverses and determinants."""
    share, mean, cov, n = {}, {}, {}, len(y)
    for c in (0, 1):
        own = x[y == c]
        share[c], mean[c], cov[c] = len(own) / n, own.mean(axis=0), np.cov(own.T, bias=True)
    pooled = sum(share[c] * cov[c] for c in (0, 1))
    spread = np.diag(np.maximum(np.diag(pooled), 1e-6))

    def score(rows):
        log = []
        for c in (0, 1):
            lean = min(1.0, pool + x.shape[1] / (x.shape[1] + share[c] * n))
            s = (1 - ridge) * ((1 - lean) * cov[c] + lean * pooled) + ridge * spread
            d = rows - mean[c]
            log.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) + np.linalg.slogdet(s)[1]) + np.log(share[c]))
        return 1 / (1 + np.exp(log[0] - log[1]))

    return score


def test_classifier_equals_the_plain_formula(spark):
    docs, marks = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    quality = {r.doc_id: r.quality for r in marks.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    taught = [k for k in texts if quality.get(k) in (0, 1) and zlib.crc32(str(k).encode()) % 5]
    x = np.array([qc.statistics(texts[k]) for k in taught])
    score = plain_discriminant(x, np.array([quality[k] for k in taught]))
    for r in qc.quality_classifier(spark, docs, marks).collect():
        assert abs(r.score - score(np.array([qc.statistics(texts[r.doc_id])]))[0]) < 1e-6


def test_language_query_equals_a_plain_one(spark):
    """Profiles by counting, ranks by sorting, distances by a loop, ties by name, over a whole table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    counts = {}
    for r in rows:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            counts.setdefault(r.lang, Counter()).update(dict(zip(*(a.tolist() for a in gram_counts(r.text)), strict=True)))
    top = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:300]]
    ranks = {lang: {g: k for k, g in enumerate(top(c))} for lang, c in counts.items()}
    for r, got in zip(sorted(rows, key=lambda r: r.doc_id), language_id(spark, docs).orderBy("doc_id").collect(), strict=True):
        own = top(dict(zip(*(a.tolist() for a in gram_counts(r.text)), strict=True)))
        far = {lang: sum(abs(place[g] - k) if g in place else 300 for k, g in enumerate(own)) for lang, place in ranks.items()}
        best = min(sorted(far), key=far.get) if own else "und"
        assert got.lang_pred == best and abs(got.score - (1 - far[best] / (300 * len(own)) if own else 0)) < 1e-12


def clustered_vectors(seed, n, d=8, clusters=9, noise=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d))
    return unit(np.concatenate([centres[rng.integers(0, clusters, n // 2)] + rng.normal(scale=noise, size=(n // 2, d)), rng.normal(size=(n - n // 2, d))]))


def test_cover_trees_are_nested_cover_and_separate():
    for seed, finest in ((1, 0.1), (2, 0.02), (3, 0.5)):
        x = clustered_vectors(seed, 600)
        order, counts = CoverTree.levels(x, finest)
        assert counts[0] == 1 and counts == sorted(counts)  # prefixes of one order: nested
        for i, m in enumerate(counts):
            radius, far = max(2.0 ** (1 - i), finest), np.linalg.norm(x[:, None] - x[order[:m]][None], axis=2)
            assert far.min(axis=1).max() <= radius + 1e-12  # covering
            between = far[order[:m]]
            assert m == 1 or between[~np.eye(m, dtype=bool)].min() > radius  # separation
        tree = CoverTree.of(x, finest, leaf=8)
        assert sorted(tree.order.tolist()) == list(range(600)) and np.allclose(tree.x, x[tree.order])
        for k, node in enumerate(tree.nodes):
            start, end = tree.run[k]
            own = np.linalg.norm(tree.x[start:end] - tree.x[node["centre"]], axis=1)
            assert abs(own.max() - node["radius"]) < 1e-12 and node["radius"] <= 2 * 2.0 ** (1 - node["level"]) + 1e-9 and start <= node["centre"] < end
            kids = tree.kids[k]
            if kids:
                assert tree.run[kids[0]][0] == start and tree.run[kids[-1]][1] == end and all(tree.run[a][1] == tree.run[b][0] for a, b in zip(kids, kids[1:], strict=False))
                assert node["centre"] in {tree.nodes[c]["centre"] for c in kids}  # a centre is its own child


def test_dual_traversal_meets_every_near_pair():
    a, b = (CoverTree.of(clustered_vectors(s, 500), 0.05, leaf=6) for s in (5, 5))
    c = CoverTree.of(clustered_vectors(5, 300)[::-1].copy(), 0.05, leaf=6)
    for p, q in ((a, a), (a, c)):
        near, seen = p.x @ q.x.T >= 0.9, np.zeros((len(p.x), len(q.x)), int)
        pairs = list(near_nodes(p, q, np.sqrt(0.2)))
        for i, j in pairs:
            (s, e), (u, v) = p.run[i], q.run[j]
            seen[s:e, u:v] += 1
            if p is q and i != j:
                seen[u:v, s:e] += 1
        assert (seen[near] == 1).all() and seen.max() == 1 and seen.mean() < 0.9
    assert (a.nodes == b.nodes).all()


def test_embeddings_in_many_cells_and_blocks_equal_brute_force(spark, monkeypatch):
    for name, value in (("BLOCK", 40), ("CELLS", 5), ("LEAF", 6), ("SAMPLE", 100)):
        monkeypatch.setattr(ed, name, value)
    x = clustered_vectors(7, 700)
    # Columns that clash with names inside, and one vector many times over.
    rows = [(k, v.tolist(), 1, 2.0, 3, "c") for k, v in enumerate(np.concatenate([x, np.repeat(x[:1], 120, axis=0)]))]
    got = {r.vec_id: r for r in embedding_dedup(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, x double, cell int, d string")).collect()}
    every = unit(np.array([r[1] for r in rows]))
    near = every @ every.T >= 0.9
    np.fill_diagonal(near, False)
    nodes, least = roots(*np.nonzero(np.triu(near)))
    want = {k: k for k in range(len(rows))} | dict(zip(nodes.tolist(), least.tolist(), strict=True))
    assert all(got[k].n_links == near[k].sum() and got[k].component_id == want[k] for k in range(len(rows)))
