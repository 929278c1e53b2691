"""The training-data operators against brute force, round trips and edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from forgeline.llm import ann_forest, byte_bpe, chat, components, hamming_search, mixing, pii, quality, queries, simhash, token_prefix, url_filter
from forgeline.llm.common import numbered, shared_dir, table

RANKS, PATTERN, MODEL = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "A a", "Über ẞ ß", "</s>[INST] ok [/INST]", "<|turn|>%3C%", "x" * 70_000, "word " * 30_000, "\x00é😀中", "same text twice", "same text twice"]


def docs(spark, texts, **extra):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


# --- 1: Hamming search -------------------------------------------------------------------------------
def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def random_rows(n, seed, copies=0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(64).astype("float32").tolist()) for i in range(n)]
    return rows + [(n + i, rows[7][1]) for i in range(copies)]


ODD_VECTORS = [(900, None), (901, []), (902, [0.0] * 64), (903, [float("nan")] * 64), (904, [None] + [1.0] * 63), (None, [1.0] * 64), (905, [float("inf")] * 64)]


def test_hamming_search_is_exact(spark):
    rows = random_rows(300, 1, copies=60)
    out = hamming_search.top_k(vectors(spark, rows + rows[:20] + ODD_VECTORS).withColumn("CODE", F.lit(1)), k=10, every=20).collect()
    code = {i: [x > 0 for x in v] for i, v in rows}
    for q in (i for i in code if i % 20 == 0):
        best = sorted((sum(a != b for a, b in zip(code[q], c, strict=True)), i) for i, c in code.items() if i != q)[:10]
        assert sorted((r.rank, r.distance, r.vec_id) for r in out if r.query_id == q) == [(n + 1, d, i) for n, (d, i) in enumerate(best)]


def test_hamming_search_stops_only_when_covered():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    index = hamming_search.MultiIndex(codes)
    for q in codes[:5].tolist():
        at, d = index.search(q, np.ones(len(codes), dtype=int), 10)
        every = np.bitwise_count(codes ^ np.uint64(q))
        kth = np.sort(every)[9]
        assert set(at.tolist()) == set(np.flatnonzero(every <= kth).tolist()) and len(d) == len(at)


@pytest.mark.parametrize("search", [hamming_search.top_k, ann_forest.top_k])
def test_searches_without_rows_and_with_few(spark, search):
    assert search(vectors(spark, [])).count() == 0
    assert search(vectors(spark, ODD_VECTORS)).count() == 0
    out = search(vectors(spark, random_rows(3, 2))).collect()
    assert sorted((r.query_id, r.rank) for r in out) == [(0, 1), (0, 2)]


# --- 3: forest ---------------------------------------------------------------------------------------
def test_forest_recall_and_scores(spark, sf):
    df = table(spark, sf.replace("0.001", "0.1"), "embeddings")
    out = ann_forest.top_k(df, k=5, every=50).collect()
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    norm = np.linalg.norm(x, axis=1)
    hits = []
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i] / norm / norm[i]
        mine = [r for r in out if r.query_id == ids[i]]
        assert len(mine) == 5 and all(abs(r.score - s[np.flatnonzero(ids == r.vec_id)[0]]) < 1e-12 for r in mine)
        s[i] = -2
        hits.append(len({r.vec_id for r in mine} & set(ids[np.argsort(-s)[:5]].tolist())) / 5)
    assert np.mean(hits) >= 0.9


def test_forest_ties_go_by_id(spark):
    rows = random_rows(120, 4, copies=30)
    out = ann_forest.top_k(vectors(spark, rows + ODD_VECTORS), k=5, every=7).collect()
    assert [r.vec_id for r in sorted((r for r in out if r.query_id == 7), key=lambda r: r.rank)] == [120, 121, 122, 123, 124]


# --- 2: chat -----------------------------------------------------------------------------------------
def test_chat_round_trip(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate((random.Random(i).choice(["user", "assistant", "system", None, "odd\nrole<|end|>"]), t) for i, t in enumerate(ODD))]
    rows += [(2, 0, "user", "only a question"), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (None, 0, "user", "x"), (None, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("FORMATTED", F.lit(1)).withColumn("turns", F.lit(2))
    made = chat.examples(df)
    got = {r.conv_id: r for r in chat.digest(made).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[conv].loss_chars == len(loss) and got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for r in made.filter("conv_id = 1 AND loss_start IS NOT NULL").collect():
        assert r.formatted[r.loss_end :] == chat.END and r.formatted.count(chat.END) == r.formatted.count(chat.TURN)
    assert chat.digest(chat.examples(df.filter("false"))).count() == 0


# --- 4: mixing ---------------------------------------------------------------------------------------
def test_targets_are_filled_like_water(spark):
    rng = random.Random(5)
    for _ in range(3):
        sizes = {f"s{i}": rng.choice([0, 1, 10, 100, 5000]) for i in range(7)} | {None: 50}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        order = sorted((s for s in sizes if s is not None)) + [None]
        weight = {s: 1 + i % 3 for i, s in enumerate(order)}
        fixed, total = {}, sum(sizes.values())
        while True:
            free = [s for s in order if s not in fixed]
            level = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in free))
            above = [s for s in free if level * weight[s] > 3 * sizes[s]]
            if not above:
                break
            fixed |= {s: 3.0 * sizes[s] for s in above}
        expected = fixed | {s: level * weight[s] for s in free}
        assert all(abs(got[s] - expected[s]) < 1e-6 * max(1, total) for s in order)


def test_knapsack_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 40, rng.integers(1, 6)))
        counts, budget = rng.integers(1, 5, len(lengths)), int(rng.integers(0, 120))
        reach = {0}
        for w, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            reach = {r + k * w for r in reach for k in range(c + 1) if r + k * w <= budget}
        taken = mixing.knapsack(lengths, counts, budget)
        assert (taken <= counts).all() and int((taken * lengths).sum()) == max(reach)


def test_mix_meets_targets_and_repeats_itself(spark, sf):
    df = table(spark, sf.replace("0.001", "0.01"), "documents").withColumn("TARGET", F.lit("x")).withColumn("size", F.lit(1))
    df = df.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 50 == 1, None).otherwise(F.col("source"))).unionAll(df.filter("doc_id < 9"))
    out = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == df.count()
    taken, target = {}, {}
    for r in out:
        key = (r.source_size, r.target)
        taken[key] = taken.get(key, 0) + r.taken
        target[key] = r.target
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    assert all(abs(taken[k] - target[k]) <= max(2, 0.001 * target[k]) for k in taken)
    assert mixing.mix(df.filter("false")).count() == 0


def test_mix_sizes_of_odd_texts(spark):
    out = {r.doc_id: r for r in mixing.mix(docs(spark, ODD, source=None)).collect()}
    assert [out[i].size for i in range(len(ODD))] == [len(WORDS.findall(t or "")) for t in ODD]


# --- 5: SimHash --------------------------------------------------------------------------------------
def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    label = list(range(len(fps)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(fps))]


def test_simhash_components(spark, sf):
    texts = [r.text for r in table(spark, sf, "documents").orderBy("doc_id").limit(120).collect()] + ODD
    df = docs(spark, texts, FINGERPRINT="x", fp=1, component_id=2)
    out = {r.doc_id: r for r in simhash.components(df).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert [int(out[i].fingerprint, 16) for i in range(len(texts))] == fps
    assert [out[i].component_id for i in range(len(texts))] == plain_components(fps)
    assert simhash.components(df.filter("false")).count() == 0
    nameless = simhash.components(docs(spark, ["a b c", "a b c"]).withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert [r.component_id for r in nameless] == [None, None]


def test_any_three_bits_leave_two_segments_whole():
    masks = [m % (1 << 64) for m in simhash.pair_masks()]
    assert len(masks) == 10 and all(m.bit_count() in (25, 26) for m in masks)
    ends = [(a, b - 1) for a, b in zip(simhash.SEGMENTS, simhash.SEGMENTS[1:])]
    edges = [x for pair in ends for x in pair]
    for flipped in itertools.combinations(edges, 3):
        assert any(not m & sum(1 << b for b in flipped) for m in masks)


@pytest.mark.parametrize(("block", "most_sent"), [(3, 0), (3, 1 << 17), (16, 1 << 17), (1 << 15, 1 << 17)])
def test_simhash_links_keep_every_component(spark, block, most_sent):
    rng = random.Random(block)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = {0} | {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(15)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), 3, block, most_sent)
    got = {r.node: r.label for r in components.connected(edges).collect()}
    expected = plain_components(fps)
    mine = {}
    for s, e in zip(signed, expected, strict=True):
        mine.setdefault(e, set()).add(got.get(s, s))
    assert all(len(x) == 1 for x in mine.values()) and len({next(iter(x)) for x in mine.values()}) == len(mine)


def test_connected_on_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (None, 1)], "a long, b long")
    got = {r.node: r.label for r in components.connected(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[100] == 100
    assert components.connected(edges.filter("false")).count() == 0


# --- 6: personal data --------------------------------------------------------------------------------
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((2 * int(c) - 9 if 2 * int(c) > 9 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or "", re.ASCII):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda d=d: 16 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 8 <= len(d) <= 15}[kind]()
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans(spark):
    rng = random.Random(3)
    parts = ["a", "b@c.d", "@", ".", "1", "23", "255", "256", "4111111111111111", "4111 1111 1111 1111", "+", " ", "-", "(", ")", "\n", "é", "😀", "x_y", "%", "+1 (988) 555-2485", "1.2.3.4", "..", "0000", "٣"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(600)] + ODD + ["a@" + "a." * 20_000 + "b", "1." * 20_000, "x" * 50_000 + "@", "+1" + "(" * 50_000]
    out = {r.doc_id: r.b for r in pii.find(docs(spark, texts, SPANS=1, base_spans="x")).select("doc_id", pii.said(F.col("base_spans")).alias("b")).collect()}
    assert [out[i] for i in range(len(texts))] == [plain_spans(t) for t in texts]
    assert pii.find(docs(spark, ["x"]).filter("false")).count() == 0


def test_context_finds_unseen_identifiers(spark):
    texts = [f"note {i} please call tel: +1 (2{i:02d}) 555-1{i:03d} now" for i in range(20)]
    texts += ["please call tel: 0912 345 678 now", "our part number 12345678 is fine", "please call tel: tomorrow"]
    df = docs(spark, texts)
    found = {r.doc_id: r for r in pii.find(df).select("doc_id", pii.said(F.col("spans")).alias("all"), pii.said(F.col("base_spans")).alias("base")).collect()}
    assert found[20].base == "" and found[20].all == "phone:17:29" and found[21].all == "" and found[22].all == ""
    masked = {r.doc_id: r.text for r in pii.mask(df.withColumn("other", F.lit(1))).collect()}
    assert masked[20] == "please call tel: [PHONE] now" and masked[0] == "note 0 please call tel: [PHONE] now" and masked[21] == texts[21]


def test_mask_keeps_nulls_and_joins_overlaps(spark):
    out = {r.doc_id: r.text for r in pii.mask(docs(spark, [None, "", "mail a.1.2.3.4@b.co, 1.2.3.4 end", "+1 4111 1111 1111 111"])).collect()}
    assert out[0] is None and out[1] == "" and out[2] == "mail [EMAIL], [IP] end" and len(out) == 4


# --- 7: quality --------------------------------------------------------------------------------------
def test_quality_on_held_out_labels(spark, sf):
    where = sf.replace("0.001", "0.1")
    labels = table(spark, where, "labels")
    out = quality.classify(table(spark, where, "documents"), labels)
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out.limit(200).collect())
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.97
    ones, zeros = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([[(a > b) + (a == b) / 2 for b in zeros] for a in ones]) >= 0.97


def test_quality_learns_nothing_from_held_out_labels(spark, sf):
    df, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.classify(df, x).collect()} for x in (labels, flipped))
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_quality_edge_cases(spark):
    df = docs(spark, ODD, score="x", STATISTICS=1).unionAll(docs(spark, ["no id"], score="x", STATISTICS=1).withColumn("doc_id", F.lit(None).cast("long")))
    none = spark.createDataFrame([(1, None), (None, 1), (99, 1)], "doc_id long, quality int")
    out = quality.classify(df, none).collect()
    assert len(out) == len(ODD) + 1 and {r.score for r in out} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(12)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.classify(df, one).collect())
    assert quality.classify(df.filter("false"), one).count() == 0


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(2)
    m, w = rng.random(50), rng.integers(1, 9, 50).astype(float)
    out = quality.isotonic(m, w)
    assert (np.diff(out) >= -1e-12).all() and abs((out * w).sum() - (m * w).sum()) < 1e-9


# --- 8: token counts ---------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("  abeThinon.\n\t<>/s▁é\x00😀中1234-_")), max_size=40), st.data())
def test_prefix_counts_match_the_library(text, data):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    n, steps = token_prefix.counter(MODEL).table(text)
    k = data.draw(st.integers(0, len(text)))
    assert n == len(sp.encode(text)) and token_prefix.count_at(steps, k) == len(sp.encode(text[:k]))


def test_prefix_counts_of_tables(spark, sf, library):
    df = table(spark, sf, "documents").select("doc_id", "text").unionAll(docs(spark, ODD)).withColumn("N_TOKENS", F.lit("x"))
    rows = token_prefix.prefix_counts(df, MODEL, keep_text=True).collect()
    assert all(r.n_tokens == len(library.encode(r.text or "")) and r.n_bytes == len((r.text or "").encode()) for r in rows)
    r = max(rows, key=lambda r: r.n_tokens if r.text and len(r.text) < 20_000 else 0)
    cut = token_prefix.longest_within(bytes(r.token_steps), 50)
    assert len(library.encode(r.text[:cut])) <= 50 and all(len(library.encode(r.text[:c])) > 50 for c in range(cut + 1, min(len(r.text), cut + 30)))


# --- 9: URL filter -----------------------------------------------------------------------------------
URLS = ["http://a.org/x", "https://EXAMPLE.org/es/1?q", "http://m.example.org/en/12", "http://example.org", "http://b.com/fr/", "http://b.com/de/2#x", "http://b.com/en", "nothing", None, "", "x://y", "http://sub.bad-ads.net/a", "http://org/", "http://notexample.org/es/", "a://b://c/d"]


def test_url_filter(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("HOST", F.lit(1)).withColumn("rule", F.lit(2))
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    listed, words = spark.createDataFrame([("bad-ads.net",), ("",), (None,)], "host string"), spark.createDataFrame([("b",), ("",)], "word string")
    small = {r.page_id: r for r in url_filter.judge(df, rules, listed, words).collect()}
    large = {r.page_id: r for r in url_filter.judge(df, rules, listed, words, most_list_bytes=0).collect()}
    assert [(small[i].rule, small[i].verdict, small[i].host, small[i].path) for i in small] == [(large[i].rule, large[i].verdict, large[i].host, large[i].path) for i in small]
    assert [(small[i].rule, small[i].verdict) for i in range(len(URLS))] == [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), (None, "allow"), ("com/fr/", "allow"), ("com/de/", "block"), (None, "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"), ("org/", "allow"), ("org/", "allow"), (None, "allow")]
    assert url_filter.judge(df.filter("false"), rules, listed).count() == 0
    assert url_filter.judge(df, rules.filter("false"), listed.filter("false")).filter("verdict != 'allow'").count() == 0


def test_digest_collisions_decide_nothing():
    entries = url_filter.DigestArray.of(["a", "b"], [False, True])
    entries.keys = np.array([xxhash.xxh64_intdigest("c", url_filter.SEED)] * 2, dtype=np.uint64).tobytes()
    entries.token = "collision"
    assert entries.find(["c"]).tolist() == [-1]


def test_long_list_on_both_ways(spark):
    rng = random.Random(9)
    hosts = [f"h{i}.d{i % 7}.net" for i in range(3000)]
    urls = [f"http://{rng.choice(['', 'x.', 'y.z.'])}{h if i % 2 else h.replace('h', 'k')}/{'p' * (i % 50) * 200}" for i, h in enumerate(hosts)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    df = df.unionAll(df.limit(50))
    rules = spark.createDataFrame([(h, "/p", "allow") for h in hosts[::10]] + [(h, "/p", "block") for h in hosts[::20]], "host string, path string, verdict string")
    listed = spark.createDataFrame([(h,) for h in hosts[::3]], "host string")
    both = [url_filter.judge(df, rules, listed, most_list_bytes=n).select("page_id", "rule", "verdict") for n in (1 << 26, 0)]
    assert sorted(both[0].collect(), key=str) == sorted(both[1].collect(), key=str) and both[0].count() == 3050
    for r in both[0].collect():
        i = r.page_id
        fits = i % 2 and i % 10 == 0 and i % 50 > 0
        assert (r.rule is not None) == bool(fits)
        assert r.verdict == (("block" if i % 20 == 0 else "allow") if fits else ("block" if i % 2 and i % 3 == 0 else "allow"))


# --- 10: byte-level BPE ------------------------------------------------------------------------------
def test_byte_bpe_round_trip(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text").unionAll(docs(spark, ODD)).withColumn("TOKEN_IDS", F.lit("x"))
    enc = byte_bpe.encoding(RANKS, PATTERN)
    rows = byte_bpe.decode(byte_bpe.encode(df, RANKS, PATTERN, keep_text=True), RANKS, PATTERN).collect()
    assert len(rows) == df.count()
    assert all(r.token_ids == enc.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() for r in rows)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 1'.\n\t  é😀")), max_size=200), st.integers(1, 20))
def test_cuts_change_no_id(text, most):
    enc = byte_bpe.encoding(RANKS, PATTERN)
    parts = byte_bpe.pieces(text, most)
    assert "".join(parts) == text and [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


# --- shared ------------------------------------------------------------------------------------------
def test_scratch_folder_is_the_sessions(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert numbered(docs(spark, ["a", "a"]), "rows").select("__row").distinct().count() == 2
