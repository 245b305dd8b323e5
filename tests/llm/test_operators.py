"""Each corpus operator against brute force or an exact round trip, and on awkward rows."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logloom.llm import bpe, common, embed_dedup, katz, langid, lengths, merkle, packing, pii, queries, simhash, suffix
from logloom.ship import ship

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, id string, row string, h string, id_ string"
AWKWARD = [(None, None), (None, "a b"), (1, ""), (2, None), (3, " \n\t "), (4, "x" * 3000), (5, "the same text of some words"), (5, "the same text of some words"), (6, "the same text of some words"), (7, "12345 !?"), (8, "日本 é 😀 z"), (9, "w " * 2000)]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").sort_index()


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use inside."""
    ship(spark)
    return spark.createDataFrame([(i, t, "q", "q", "q", "q") for i, t in AWKWARD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    ship(spark)
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", lower(text or ""))


def least_reachable(mask, ids):
    label = np.array(ids)
    while True:
        new = np.where(mask, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (new == label).all():
            return label
        label = new


# 1


def test_embeddings(spark):
    ship(spark)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 16))
    rows = []
    for i in range(500):
        v = (centres[i % 12] + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.2, 0.4])).astype(np.float32)
        rows.append((i, v.tolist(), int(i % 3) if i % 50 else None))
    bad = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [1.0, None] + [0.0] * 14, 1), (904, [float("nan")] * 16, 1), (905, [float("inf")] + [0.0] * 15, 1), (None, rows[0][1], 1), (906, [1.0, 2.0], 1), (907, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")
    for block in (1024, 20):
        got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df, block=block).collect()}
        assert len(got) == len(rows) + len(bad)
        x = np.array([r[1] for r in rows], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        label = np.array([-1 - r[0] if r[2] is None else r[2] for r in rows])
        mask = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
        np.fill_diagonal(mask, True)
        n, least = mask.sum(axis=1) - 1, least_reachable(mask, [r[0] for r in rows])
        found = np.array([got[r[0]]["n_links"] for r in rows])
        assert (found <= n).all() and found.sum() >= 0.995 * n.sum() > 0
        assert np.mean([got[r[0]]["component_id"] == c for r, c in zip(rows, least)]) >= 0.99
        assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(900, 906))
        assert (got[907]["component_id"], got[906]["kept"], got[907]["kept"], got[None]["kept"]) == (906, True, False, False)
    assert embed_dedup.near_duplicates(df.limit(0)).collect() == []


# 2


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for rank, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_personal_data(spark):
    ship(spark)
    rng = random.Random(4)
    bits = ["a@b.c", "a@b.c_d@e.f-g.h", "x@y", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "0255.1.1.1", "4111 1111-1111 1111", "4111111111111111", "4111111111111112", "+1 (555) 123-4567", "+12", "+1 2 3 4 5 6 7 8 9 0", "é😀", "\n", " ", "..", "-", "5", "%_+"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in pii.extract(df, confident=2.0).collect():
        assert [(s["start"], s["rank"] - 1, s["kind"], s["end"]) for s in r["spans"]] == base_spans(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_patterns_discover_identifiers(spark):
    ship(spark)
    texts = [f"please call me at +1 (555) 010-{i:04d} today" for i in range(30)] + ["please call me at 555-0199 today", "room 555-0199 is far", "version 2.0 of it"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.extract(df).collect()}
    assert [(s["kind"], s["start"], s["end"], s["base"]) for s in got[30]] == [("phone", 18, 26, False)]
    assert got[31] == [] and got[32] == [] and all(len(got[i]) == 1 and got[i][0]["base"] for i in range(30))
    masked = {r["doc_id"]: r["text"] for r in pii.without_personal_data(df).collect()}
    assert masked[30] == "please call me at <PHONE> today" and masked[3] == masked[30] and masked[32] == texts[32]


def test_personal_data_of_awkward_rows(spark, awkward, empty):
    assert sorted(len(r["spans"]) for r in pii.extract(awkward).collect()) == [0] * len(AWKWARD)
    masked = pii.without_personal_data(awkward)
    assert masked.columns == awkward.columns and sorted(str(r["text"]) for r in masked.collect()) == sorted(str(t) for _, t in AWKWARD)
    assert pii.extract(empty).collect() == [] and pii.without_personal_data(empty).collect() == []
    odd = spark.createDataFrame([(1, "9" * 20_000), (2, "a" * 20_000 + "@"), (3, "+1 " * 5_000), (None, "q@r.st"), (4, "q@r.st")], "doc_id long, text string")
    assert {r["doc_id"]: len(r["spans"]) for r in pii.extract(odd).collect()} == {1: 0, 2: 0, 3: 0, None: 1, 4: 1}


# 3


def removed(texts, least, keep):
    counts, seen, out = collections.Counter(), set(), []
    for t in texts:
        counts.update(t[i : i + least] for i in range(len(t) - least + 1))
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - least + 1):
            s = t[i : i + least]
            if s in seen if keep == "first" else counts[s] > 1:
                mark[i : i + least] = b"\1" * least
            seen.add(s)
        out.append((bytes(b for b, m in zip(t, mark) if not m), [m.span() for m in re.finditer(b"\1+", bytes(mark))]))
    return out


@pytest.mark.parametrize("settings", [{}, {"hot_entries": 2}])
def test_repeated_strings(spark, settings):
    ship(spark)
    rng = random.Random(6)
    text = lambda n, a="abcdefgh é": "".join(rng.choice(a) for _ in range(n))
    base = [text(rng.randint(20, 150)) for _ in range(6)]
    rows = ["".join(rng.choice([rng.choice(base), text(rng.randint(1, 60)), "x" * rng.randint(1, 60), "ab " * rng.randint(1, 30)]) for _ in range(rng.randint(0, 7))) for _ in range(80)]
    rows += [None, "", rows[0], rows[0]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    for keep in ("none", "first"):
        expected = removed([(t or "").encode() for t in rows], 40, keep)
        for r in suffix.remove_repeats(df, 40, keep, **settings).collect():
            assert (bytes(r["kept"]), [(s["start"], s["stop"]) for s in r["spans"]]) == expected[r["doc_id"]]


def test_repeats_of_awkward_rows(awkward, empty):
    got = suffix.remove_repeats(awkward, 400, "none").collect()
    assert len(got) == len(AWKWARD) and sum(r["n_bytes"] for r in got) == sum(len((t or "").encode()) for _, t in AWKWARD)
    assert {r["doc_id"] for r in got if r["spans"]} == {4, 9}
    kept = suffix.without_repeats(awkward, 400, size_col=None)
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD)
    assert suffix.remove_repeats(empty, 400).collect() == [] and suffix.without_repeats(empty, 400).collect() == []


def test_long_text_in_tiles(spark, monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdef ") for _ in range(9000))
    text = (text + text[2000:2600] + "zz").encode()
    monkeypatch.setattr(suffix, "TILE", 1000)
    data, at = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    starts = collections.Counter()
    for part, ends, rows, shifts in suffix.tiles(data, at, 400):
        key, seg, start, length, rel = suffix.runs(part, ends, 400)
        for s, n, r in zip(start + shifts[0], length, rel):
            starts.update(range(s, s + n))
            assert 0 <= r <= 400 - suffix.GRAM
    assert starts == collections.Counter(range(len(text) - 399))


# 4


def test_fingerprints(spark, docs):
    got = queries.op4_merkle_fingerprints(spark, SF).toPandas().set_index("doc_id")
    ids = list(docs.index)
    for k, i in enumerate(ids):
        t, following = docs.text[i], docs.text[ids[(k + 1) % len(ids)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert got.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest() and got.n_chars[i] == len(t)
    assert got.fingerprint.nunique() == docs.text.nunique()
    assert got.near_edited.between(0, 1).all() and got.near_edited.median() > 0.4 > 0.1 > got.near_next.median()


def test_edits_are_located(spark):
    ship(spark)
    a, b = "one two\nthree four\n\nfive six\nseven", "one two\nthree 4\n\nfive six\nseven"
    df = merkle.with_tree(merkle.with_tree(spark.createDataFrame([(a, b)], "a string, b string"), "a", "a_"), "b", "b_")
    r = df.select(merkle.differing(F.col("a_tree"), F.col("b_tree")).alias("d"), merkle.likeness(F.col("a_root"), F.col("a_leaves"), F.col("b_root"), F.col("b_leaves")).alias("l")).first()
    assert [tuple(x) for x in r["d"]] == [(0, 1)] and 0 < r["l"] < 1


def test_next_document(spark, awkward):
    rows = merkle.edit_report(awkward).collect()
    assert len(rows) == len(AWKWARD)
    spread = spark.createDataFrame([(i * 5000 - 20_000, f"t{i}") for i in range(9)], "doc_id long, text string")
    got = {r["id"]: r["next_text"] for r in merkle.with_next_text(spread).collect()}
    assert got == {i * 5000 - 20_000: f"t{(i + 1) % 9}" for i in range(9)}


# 5


def test_language(spark, docs):
    got = queries.op5_language_id(spark, SF).toPandas().set_index("doc_id")
    held = got[got.held_out]
    assert set(held.index) == {i for i in docs.index if zlib.crc32(str(i).encode()) % 4 == 2}
    assert (held.lang_pred == docs.lang[held.index]).mean() > 0.97 and got.score.between(0, 1).all()


def test_codewords():
    assert langid.codewords(1).shape == (1, 1)
    for k in (2, 3, 4, 6, 9, 20):
        code = langid.codewords(k)
        assert len({tuple(r) for r in code.tolist()}) == k and (np.abs(code.sum(axis=0)) < k).all()


def test_language_of_awkward_rows(spark, awkward, empty):
    labelled = spark.createDataFrame([("the cat", "en"), ("le chat", "fr"), (None, "en"), ("x", None)], "text string, lang string")
    model = langid.fit(labelled)
    got = langid.predict(awkward, model).collect()
    assert len(got) == len(AWKWARD)
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in AWKWARD[k][1] or "")) for k, r in enumerate(got))
    assert langid.identified(awkward, model).columns == awkward.columns and langid.predict(empty, model).collect() == []
    none = langid.fit(labelled.where("false"))
    assert {r["lang_pred"] for r in langid.predict(awkward, none).collect()} == {"und"}
    single = langid.fit(labelled.where("lang = 'fr'"))
    assert {r["lang_pred"] for r in langid.predict(awkward, single).collect()} == {"und", "fr"}


# 6 and 8


def test_packing(spark, docs, awkward, empty):
    tokenizer = Tokenizer.from_file(queries.JSON_50K)
    tokenizer.encode_special_tokens = True
    for df, texts in ((common.documents(spark, SF), docs.text.to_dict()), (awkward.where("doc_id is not null"), dict(x for x in AWKWARD if x[0] is not None))):
        got = packing.pack(df.dropDuplicates(["doc_id"]), queries.JSON_50K, queries.RANKS_50K).toPandas()
        assert got.sequence_id.is_unique and (got.offset == 0).all()
        for i, pieces in got.groupby("doc_id"):
            pieces = pieces.sort_values("start")
            ids = np.array(tokenizer.encode(texts[i] or "", add_special_tokens=False).ids + [1], "<u4")
            assert b"".join(map(bytes, pieces.ids)) == ids.tobytes() and pieces.length.tolist() == packing.binary_lengths(len(ids), 2048)
            assert pieces.start.tolist() == np.cumsum([0, *pieces.length])[:-1].tolist() and set(pieces.doc_tokens) == {len(ids)}
        assert set(got.doc_id) == set(texts)
    assert packing.pack(awkward, queries.JSON_50K).count() > 0 and packing.pack(empty, queries.JSON_50K).collect() == []
    assert packing.binary_lengths(4099, 2048) == [2048, 2048, 2, 1]


def test_length_table(spark, docs, awkward, empty):
    counts = [len(tiktoken_of(queries.RANKS_50K).encode_ordinary(t)) for t in docs.text]
    got = queries.op8_token_counts(spark, SF).toPandas().set_index("limit")
    assert sorted(got.index) == sorted(set(counts))
    for limit, r in got.iterrows():
        longer = [c for c in counts if c > limit]
        assert (r.n_docs, r.docs_over, r.tokens_over, r.total_tokens) == (counts.count(limit), len(longer), sum(longer), sum(counts))
        assert r.kept_tokens == sum(min(c, limit) for c in counts) and r["quantile"] == pytest.approx(1 - len(longer) / len(counts))
    assert lengths.histogram(lengths.token_lengths(awkward, queries.JSON_50K)).count() > 1
    assert lengths.histogram(lengths.token_lengths(empty, queries.JSON_50K)).collect() == []


# 7


def test_backoff_scores(spark, docs, monkeypatch):
    for share, size in ((None, katz.PAIR_SLICE), (0.002, katz.PAIR_SLICE), (None, 500)):
        # slices by counted bytes, more of them than the partitions ask for
        monkeypatch.setattr(katz, "PAIR_SLICE", size)
        monkeypatch.setattr(katz, "WORD_SLICE", 4 * size)
        held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
        got = katz.score(common.documents(spark, SF), held_out, hot_share=share).toPandas().set_index("doc_id")
        text = {i: words(t) + [None] for i, t in docs.text.items()}
        train = [x for i, x in text.items() if zlib.crc32(str(i).encode()) % 7 != 2]
        one, two, context = collections.Counter(), collections.Counter(), collections.Counter()
        for x in train:
            one.update(x)
            two.update(zip([0, *x[:-1]], x))
            context.update([0, *x[:-1]])
        n, v = sum(one.values()), len(one)
        coc = lambda c: [list(c.values()).count(k) for k in range(1, katz.K + 2)]
        d1, d2 = katz.discounts(coc(one)), katz.discounts(coc(two))
        less = lambda c, d: d[c] * c if c <= katz.K else c - katz.SMALL
        unknown = 1 - sum(less(c, d1) for c in one.values()) / n
        share_of = lambda w: less(one[w], d1) / n if one[w] else unknown
        used, seen = collections.Counter(), collections.Counter()
        for (h, w), c in two.items():
            used[h] += less(c, d2) / context[h]
            seen[h] += share_of(w)
        alpha = {h: (1 - used[h]) / (1 - seen[h]) for h in context}
        h = max(context, key=context.get)  # probabilities after a context add up to one
        total = sum(less(two[h, w], d2) / context[h] if two[h, w] else alpha[h] * share_of(w) for w in one) + alpha[h] * unknown
        assert total == pytest.approx(1)
        for i, x in text.items():
            base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in x)
            p = [less(two[h, w], d2) / context[h] if two[h, w] else alpha.get(h, 1.0) * share_of(w) for h, w in zip([0, *x[:-1]], x)]
            r = got.loc[i]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(one[w] > 0 for w in x), n)
            assert r.base_score == pytest.approx(base) and r.score == pytest.approx(sum(map(math.log10, p)))


def test_scores_of_awkward_rows(awkward, empty):
    got = katz.score(awkward, F.col("doc_id") == 5).collect()
    assert len(got) == len(AWKWARD) and sum(r["held_out"] for r in got) == 2
    assert all(math.isfinite(r["score"]) and r["n_tokens"] >= 1 for r in got)
    assert katz.score(empty, F.lit(False)).collect() == []


def test_word_hashes():
    data = np.frombuffer(b"a bb a " + b"x" * 200 + b" " + b"x" * 201 + b" bb", np.uint8)
    flat, starts, ends = simhash.words_joined(data)
    h = katz.word_hashes(flat, starts, ends)
    assert h[0] == h[2] and h[1] == h[5] and len(set(h.tolist())) == 4


# 9


def test_simhash(spark, docs):
    got = queries.op9_simhash_near_dedup(spark, SF).toPandas().set_index("doc_id")
    prints = {}
    for i, t in docs.text.items():
        w = words(t)
        shingles = [b" ".join(w[k : k + 4]) for k in range(max(len(w) - 3, 1))] if w else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert got.fingerprint.to_dict() == {i: f"{p:016x}" for i, p in prints.items()}
    p = np.array(list(prints.values()), np.uint64)
    least = least_reachable(np.bitwise_count(p[:, None] ^ p[None, :]) <= 4, list(prints))
    assert got.component_id[list(prints)].tolist() == least.tolist()


def test_chains_lose_no_link(spark):
    ship(spark)
    rng = random.Random(9)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(350):
        p = rng.choice(prints)
        for _ in range(rng.randint(1, 4)):
            p ^= 1 << rng.randrange(64)
        prints.append(p)
    prints = sorted(set(prints))
    x = np.array(prints, np.uint64)
    expected = least_reachable(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4, range(len(x)))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    for block in (20_000, 6):
        found = {r["node"]: r["component"] for r in common.connected_components(simhash.links(df, 4, block)).collect()}
        by = collections.defaultdict(set)
        for k, v in enumerate(x.view(np.int64).tolist()):
            by[found.get(v, v)].add(int(expected[k]))
        assert all(len(s) == 1 for s in by.values()) and len(by) == len(set(expected.tolist()))


def test_copies(awkward, empty):
    got = {(r["doc_id"], k): r for k, r in enumerate(simhash.near_duplicates(awkward).collect())}
    assert len(got) == len(AWKWARD) and {r["component_id"] for r in got.values() if r["doc_id"] in (5, 6)} == {5}
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns and [r["doc_id"] for r in kept.collect()].count(5) == 1
    assert simhash.near_duplicates(empty).collect() == []


def test_components(spark):
    ship(spark)
    rng = random.Random(10)
    for n, m in ((60, 40), (300, 280), (50, 200)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, 5000 + k) for k in range(1, 50)]
        parent = {}
        find = lambda a: a if parent.setdefault(a, a) == a else find(parent[a])
        for a, b in edges:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
        assert got == {a: find(a) for a in parent if any(a != b and a in e for e in edges for b in e)}


# 10


def tiktoken_of(path):
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding(spark, docs, awkward, empty):
    reference = tiktoken_of(queries.RANKS_MULTI)
    got = queries.op10_byte_bpe(spark, SF).toPandas().set_index("doc_id")
    for i, t in docs.text.items():
        ids = reference.encode_ordinary(t)
        assert (got.n_tokens[i], got.ids_sha256[i], got.decoded_sha256[i]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    coded = bpe.encode_column(awkward, queries.RANKS_MULTI)
    assert [r["ids"] for r in coded.collect()] == [reference.encode_ordinary(t or "") for _, t in AWKWARD]
    assert [r["text"] for r in bpe.decode_column(coded, queries.RANKS_MULTI).collect()] == [t or "" for _, t in AWKWARD]
    assert bpe.encode_column(empty, queries.RANKS_MULTI).collect() == []


def test_merges_and_offsets():
    model, reference = bpe.bpe(queries.RANKS_MULTI), tiktoken_of(queries.RANKS_MULTI)
    rng = random.Random(11)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "on", "er", "é", "😀", "  ", "\n", "0", "!!", "anan", "ss", "日本", "x" * rng.randint(1, 120)]) for _ in range(rng.randint(0, 12)))
        ids = model.encode(text)
        assert ids == reference.encode_ordinary(text) and model.decode(ids) == text
        spans = model.offsets(ids)
        assert not ids or (spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] >= b[0] for a, b in zip(spans, spans[1:])))
    assert model.decode(model.encode("😀")[:1]).count("�") >= 1 or len(model.encode("😀")) == 1
