"""Every operator against its plain reading: on odd rows with clashing columns, on an empty table, on whole tables."""

import hashlib
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from hallwatch.llm import batches, best_fit_packing, bpe, chat_examples, components, context_tree, language_id, license_scan, ngram_join, quality_rules, rotation_codes, substring_dedup, suffix_tree_lm
from odd_rows import SCHEMA, documents, frame, odd, prose  # noqa: F401

SMALL = "/root/testdata/sf0.001"


def order(rows):
    return sorted(rows, key=lambda r: [(x is not None, x) if not isinstance(x, bool) else (True, int(x)) for x in r])


def same(df, columns, want):
    assert order(tuple(r) for r in df.select(*columns).collect()) == order(want)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 1: n-gram Jaccard join
@pytest.mark.parametrize("block", [1024, 1])
def test_jaccard_join(spark, odd, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)  # 1: every grove is cut into blocks
    got = {}
    for r in ngram_join.near_duplicates(frame(spark, odd)).collect():
        got.setdefault((r.doc_id, r.n_shingles), set()).add(r.component_id)
    want = {}
    for i, n, c in brute.jaccard(odd):
        want.setdefault((i, n), set()).add(c)
    assert got == want


def test_jaccard_join_of_documents_and_of_nothing(spark, documents, empty):
    same(ngram_join.op1_ngram_jaccard_join(spark, SMALL), ["doc_id", "n_shingles", "component_id"], brute.jaccard(documents))
    assert ngram_join.near_duplicates(empty).count() == 0


def test_chained_near_copies_in_blocks(spark, monkeypatch):
    """Each copy changes a little more, so links form a chain and no pivot reaches all."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 4)
    rnd = random.Random(3)
    text = prose(rnd, 200).split(" ")
    rows = []
    for k in range(60):
        text[(k * 17) % 200] = f"w{k}"
        text[(k * 31) % 200] = f"v{k}"
        rows.append((k, " ".join(text)))
    same(ngram_join.near_duplicates(frame(spark, rows)), ["doc_id", "n_shingles", "component_id"], brute.jaccard(rows))


def test_tree_joins_like_all_pairs():
    rnd = np.random.default_rng(5)
    sets = [np.unique(rnd.integers(0, 400, 60)) for _ in range(40)]
    sets += [np.unique(np.r_[s[6:], rnd.integers(400, 800, 5)]) for s in sets]
    sizes = np.array(list(map(len, sets)))
    root = ngram_join.join_tree(sizes, sets)
    groups = brute.Groups(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            o = len(np.intersect1d(sets[i], sets[j]))
            if 100 * o >= 75 * (sizes[i] + sizes[j] - o):
                groups.join(i, j)
    assert all((root[i] == root[j]) == (groups.find(i) == groups.find(j)) for i in range(len(sets)) for j in range(i))


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 200 + k) for k in range(30)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[k] for k in range(51)}) == 1 and len({got[200 + k] for k in range(30)} | {got[100]}) == 1 and len(set(got.values())) == 2
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 2: quality rules
def test_quality_counts(spark, odd, empty):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = quality_rules.judge(frame(spark, odd))
    same(judged, names, [(i, *brute.quality_counts(t)) for i, t in odd])
    assert judged.where("kept and base_failed").count() == 0
    assert quality_rules.judge(empty).count() == 0


def test_quality_verdict(spark):
    got = quality_rules.op2_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed")
    good, junk = got.where("quality = 1"), got.where("quality = 0")
    assert good.where("not kept").count() == 0
    assert junk.where("kept").count() <= 0.1 * junk.count()


def test_verdict_as_a_column(spark, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    known, refs, _ = quality_rules.fit(docs)
    kept = {r.doc_id for r in docs.where(quality_rules.passes(known, refs, F.col("text"))).collect()}
    assert kept == {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}


def test_distance():
    p, q = np.array([[1.0, 0.0], [0.5, 0.5]]), np.array([0.0, 1.0])
    assert quality_rules.distance(p, q)[0] == 1.0 and 0 < quality_rules.distance(p, q)[1] < 1 and quality_rules.distance(p, p[1])[1] == 0


# ---- 3: language identification
def test_language(spark, odd, empty):
    got = language_id.op3_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count() and got.where("score < 0 or score > 1").count() == 0
    rows = frame(spark, odd)
    found = language_id.identify(rows, language_id.learn(rows)).join(rows.select("doc_id", "text").distinct(), "doc_id").collect()
    assert {r.lang_pred for r in found} <= {"en", "fr", "und"}
    lettered = {i: any(c.isalpha() for c in t or "") for i, t in odd if i is not None and i != 3}
    for r in found:
        if r.doc_id in lettered:
            assert (r.lang_pred == "und") == (not lettered[r.doc_id])
    assert language_id.identify(empty, language_id.learn(empty)).count() == 0
    assert {r.lang_pred for r in language_id.identify(rows, language_id.learn(empty)).collect()} == {"und"}


def test_filter_has_no_false_negatives(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_id.learn(docs)
    assert model.languages == ["de", "en", "es", "fr"] and (model.false_rate < 0.05).all()


# ---- 4: packing
@pytest.mark.parametrize("rows", ["odd", "documents"])
def test_packing(spark, request, rows):
    rows = request.getfixturevalue(rows)
    got = best_fit_packing.pack(frame(spark, rows)).collect()
    lengths = {}
    for r in got:
        lengths.setdefault(r.doc_id, []).append((r.first, r.length))
    wanted = {}
    for i, t in rows:
        wanted[i] = wanted.get(i, 0) + len(brute.words(t))
    assert {i: sum(n for _, n in x) for i, x in lengths.items()} == wanted
    bins = {}
    for r in got:
        assert (r.bin is None) == (r.length == 0)
        if r.length:
            bins.setdefault((r.grp, r.bin), []).append(r)
    for held in bins.values():
        held.sort(key=lambda r: r.offset)
        assert all(a.offset + a.length == b.offset for a, b in zip(held, held[1:])) and held[0].offset == 0
        used = sum(r.length for r in held)
        assert all(r.used == used and r.capacity == min(c for c in best_fit_packing.LENGTHS if c >= used) for r in held)


def test_packing_group(spark, empty):
    rnd = random.Random(2)
    sizes = sorted((rnd.randint(1, 4096) for _ in range(2000)), reverse=True)
    bins, offsets, capacity = best_fit_packing.pack_group(sizes)
    assert sum(sizes) / sum(capacity) > 0.97
    assert best_fit_packing.pack_group([600, 400, 100], (512, 1024)) == ([0, 0, 1], [0, 600, 0], [1024, 512])
    assert best_fit_packing.pack(empty).count() == 0


# ---- 5: BPE
def encoded(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    done = t.encode_batch([x or "" for x in texts], add_special_tokens=False)
    return [(len(e.ids), hashlib.sha256(struct.pack(f"<{len(e.ids)}I", *e.ids)).hexdigest(), brute.sha(t.decode(e.ids, skip_special_tokens=False))) for e in done]


def test_bpe(spark, odd, documents, empty):
    rows = frame(spark, odd)
    coded = bpe.encode_texts(rows, bpe.default_vocabulary())
    columns = ["doc_id", F.expr("octet_length(ids) div 4"), F.sha2("ids", 256), F.sha2(F.col("decoded").cast("binary"), 256)]
    same(coded, columns, [(i, *e) for (i, _), e in zip(odd, encoded([t for _, t in odd]))])
    same(bpe.op5_bpe_encoding(spark, SMALL), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [(i, *e) for (i, _), e in zip(documents, encoded([t for _, t in documents]))])
    assert bpe.encode_texts(empty, bpe.default_vocabulary()).count() == 0


def test_bpe_of_odd_characters():
    rnd = random.Random(4)
    letters = "abcdeinrst ABC''-.,!?012éÉüßñΣσςİıſ①½中文日́̈ 　\n\t\x1c\x85\U0001F600"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50))) for _ in range(2000)] + ["a<|endoftext|>b <|startoftext|><|endoftext|>", "we'll don't 'tis", "ab" * 3000]
    codec = bpe.codec(bpe.default_vocabulary())
    mine = [codec.encode(t) for t in texts]
    assert [(len(i) // 4, hashlib.sha256(i).hexdigest(), brute.sha(d)) for i, d in mine] == encoded(texts)


# ---- 6: license scans
def test_license_scan(spark, odd, documents, empty):
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.round("score", 9)]
    for docs, rows in ((frame(spark, odd), odd), (spark.read.parquet(f"{SMALL}/documents.parquet"), documents)):
        same(license_scan.scan(docs), columns, [(i, *brute.license_scan(t, license_scan.TEMPLATES, license_scan.PHRASES, license_scan.THRESHOLD, license_scan.REQUIRED)) for i, t in rows])
    assert license_scan.scan(empty).count() == 0 and license_scan.scan(frame(spark, odd), {}, {}).where("labels <> ''").count() == 0


# ---- 7: substring dedup
def test_substring_dedup(spark, odd, documents, empty):
    columns = ["doc_id", "n_words", "n_removed", F.sha2("kept", 256)]
    same(substring_dedup.remove_repeats(frame(spark, odd)), columns, brute.cut_repeats(odd))
    same(substring_dedup.op7_substring_dedup(spark, SMALL), ["doc_id", "n_words", "n_removed", "kept_sha256"], brute.cut_repeats(documents))
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_intervals_are_maximal_and_columns_come_back(spark, odd):
    got = substring_dedup.remove_repeats(frame(spark, odd), carry=["text", "batch", "lang"], untouched=True).collect()
    for r in got:
        assert sum(x["last"] - x["first"] for x in r.removed) == r.n_removed and all(a["last"] < b["first"] for a, b in zip(r.removed, r.removed[1:]))
        if r.n_removed == 0:
            assert r.kept == r.carried.text
    assert sorted(r.carried.batch for r in got) == list(range(len(odd)))


# ---- 8: LM scoring
def test_lm_base(spark, odd, documents, empty):
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6)]
    rows = frame(spark, odd).withColumn("held_out", suffix_tree_lm.held_out())
    for df, want in ((suffix_tree_lm.score_texts(rows), odd), (suffix_tree_lm.op8_lm_scoring(spark, SMALL), documents)):
        got, want = order(tuple(r) for r in df.select(*columns).collect()), order(brute.unigrams(want))
        assert [g[:5] for g in got] == [w[:5] for w in want] and np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
        assert df.where("score is null or score > 0 or isnan(score)").count() == 0
    assert suffix_tree_lm.score_texts(empty.withColumn("held_out", F.lit(False))).count() == 0


def test_blending_keeps_a_distribution():
    """Counts blended with any distribution over the same tokens add up to one."""
    times, p = np.array([5.0, 0, 3, 0, 1]), np.array([0.1, 0.4, 0.2, 0.25, 0.05])
    assert np.exp(context_tree.blend(np.log(p), times, np.full(5, 3.0), np.full(5, 9.0))).sum() == pytest.approx(1)
    assert np.array_equal(context_tree.blend(np.log(p), times, np.zeros(5), np.full(5, 9.0)), np.log(p))


# ---- 9: chat formatting
def test_chat(spark):
    rows = [(1, 0, "system", "be <|end|>\n &lt; nice"), (1, 1, "user", None), (1, 2, "assistant", "ok & <|assistant|>\n"), (1, 3, "user", "é?"), (1, 4, "assistant", ""), (1, 4, "assistant", ""),
            (2, 0, "user", "only"), (None, None, None, None), (None, 0, "assistant", "alone"), (3, 1, "assistant", "b"), (3, 0, "assistant", "a"), (3, 2, "us|>\ner", "c")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, position string")
    examples = chat_examples.prefix_targets(df)
    got = {(r.conv_id, r.position): r for r in examples.withColumn("turns", chat_examples.read_turns(F.col("text"))).withColumn("loss", chat_examples.read_loss(examples)).collect()}
    assert sorted((k for k in got), key=str) == sorted([(1, 3), (1, 5), (1, 6), (2, 1), (None, 1), (3, 1), (3, 2), (3, 3)], key=str)
    assert examples.where("conv_id is null").count() == 2
    assert [(t.role, t.text) for t in got[1, 6].turns] == [("system", "be <|end|>\n &lt; nice"), ("user", ""), ("assistant", "ok & <|assistant|>\n"), ("user", "é?"), ("assistant", ""), ("assistant", "")]
    assert got[1, 3].loss == "ok & <|assistant|>\n" and got[1, 5].loss == "" and got[3, 2].loss == "b" and got[3, 3].loss == "" and got[3, 3].turns[2].role == "us|>\ner"
    assert chat_examples.prefix_targets(df.limit(0)).count() == 0


def test_chat_of_conversations(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    df = chat_examples.op9_chat_formatting(spark, SMALL)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({chat_examples.OP9_SQL})").fetchall()
    assert order(tuple(r) for r in df.collect()) == order(want)


# ---- 10: embedding near-dedup
def plain_links(rows, cosine):
    ids, unit = [i for i, _ in rows], []
    for _, v in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    links, groups = [0] * len(rows), brute.Groups(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                links[a] += 1
                links[b] += 1
                groups.join(a, b)
    out = []
    for (i, _), n, c in zip(rows, links, groups.least(ids)):
        c = c if n else i
        out.append((i, n, c, i is not None and i == c))
    return out


@pytest.mark.parametrize("block,kind", [(2000, "float"), (20, "double")])
def test_vectors(spark, monkeypatch, block, kind):
    monkeypatch.setattr(rotation_codes, "BLOCK", block)
    monkeypatch.setattr(rotation_codes, "NEAR_BLOCK", block)
    rng = np.random.default_rng(1)
    center = rng.standard_normal(24)
    vectors = [center + 0.05 * rng.standard_normal(24) for _ in range(60)] + list(rng.standard_normal((80, 24)))
    vectors = [v.astype(np.float32).tolist() for v in vectors]
    vectors += [vectors[0], [2 * x for x in vectors[1]], [-x for x in vectors[2]], None, [], [0.0] * 24, [float("nan")] * 24, [None] * 24, [float("inf")] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0], [3.0]]
    rows = [(k, v) for k, v in enumerate(vectors)] + [(0, vectors[0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, id string, t int")
    same(rotation_codes.near_vectors(df), ["vec_id", "n_links", "component_id", "kept"], plain_links(rows, 0.9))
    assert rotation_codes.near_vectors(df.limit(0)).count() == 0


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((400, 64))
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    pairs = np.r_[a, 0.905 * a + np.sqrt(1 - 0.905**2) * b]
    got = rotation_codes.near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(pairs)], "vec_id long, embedding array<double>"))
    assert got.where("n_links > 0").count() >= 0.97 * 800


def test_estimates_are_unbiased():
    """From stored codes, factors and coarse coordinates alone."""
    rng = np.random.default_rng(3)
    u = rotation_codes.unit(rng.standard_normal((300, 64)))
    _, stored = rotation_codes.encode(u, 8, 16)
    held = rotation_codes.Codes(stored, 64, 8, 16)
    assert stored.shape[1] == 12 + 32 + 16  # bytes: constants, coarse coordinates, two turns of signs
    error = (held.signs / (8 * held.factor[:, None]) @ held.coarse.T - u @ u.T)[~np.eye(300, dtype=bool)]
    assert abs(error.mean()) < 0.01 and error.std() < 0.12


@pytest.mark.parametrize("cosine", [0.9, 0.95])
def test_screening_drops_far_pairs_and_no_near_one(cosine):
    rng = np.random.default_rng(4)
    a = rotation_codes.unit(rng.standard_normal((2000, 64)))
    b = rng.standard_normal((2000, 64))
    b = rotation_codes.unit(b - (a * b).sum(1)[:, None] * a)
    c = np.r_[np.full(1000, cosine + 1e-6), np.full(1000, 0.4)][:, None]
    keys, stored = rotation_codes.encode(np.r_[a, c * a + np.sqrt(1 - c**2) * b], 6, 8)
    kept = []
    for k in range(2000):  # each pair alone, as two sides of a group
        held = rotation_codes.Codes(stored[[k, k + 2000]], 64, 6, 8)
        assert (held.keys == keys[[k, k + 2000]]).all()
        kept.append(held.screen(cosine, np.array([0, 1]), 0).all())
    assert sum(kept[:1000]) >= 998 and sum(kept[1000:]) <= 20


def test_exactly_at_the_threshold_among_many(spark):
    """Pairs at 0.9 in 100,000 vectors: at least 97 of 100 are found, and none below."""
    rng = np.random.default_rng(5)
    u = rotation_codes.unit(rng.standard_normal((100_000, 64)))
    b = rng.standard_normal((2000, 64))
    b = rotation_codes.unit(b - (u[:2000] * b).sum(1)[:, None] * u[:2000])
    for at, cos in ((slice(0, 1000), 0.9 + 1e-7), (slice(1000, 2000), 0.899)):
        u[2000:4000][at] = cos * u[:2000][at] + np.sqrt(1 - cos**2) * b[at]
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(u)), "embedding": pa.array(list(u), pa.list_(pa.float64()))}))
    linked = {r.vec_id for r in rotation_codes.near_vectors(df).where("n_links > 0").collect()}
    assert linked <= {*range(1000), *range(2000, 3000)} and len(linked) >= 0.97 * 2000


# ---- batches
def test_keys_survive_packing():
    keys = np.random.default_rng(6).integers(0, 2**63, 1000).astype(np.uint64)
    assert (batches.unpack(batches.pack(keys)) == keys & np.uint64((1 << 56) - 1)).all()
    rows, bounds = batches.split(keys, 7)
    assert sorted(rows) == list(range(1000)) and bounds[-1] == 1000
