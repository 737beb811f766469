"""The corpus operators against brute force, and their edge cases."""

import hashlib
import itertools
import math
import random
import uuid
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pagewright.llm import archives, language, licenses, media, neardup, packing, pieces, quality, topk, toxicity, warc
from pagewright.session import shared_dir

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, node string, row string"


def table(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, None, None, None, None, "k", "n", "r")[:9] if len(r) == 2 else r for r in rows], SCHEMA)


EDGE = [(1, None), (2, ""), (3, "x"), (None, "the MIT License of cc by cc by"), (4, "Üben ▁ a  b\n\nc" + " lorem ipsum dolor" * 3000), (4, "Üben ▁ a  b\n\nc" + " lorem ipsum dolor" * 3000), (5, "!!! 123 ???"), (6, "y" * 9000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    return table(spark, EDGE)


def test_oracles(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    for name in ("op1_license_scan", "op2_exact_top_k", "op9_warc"):
        got, want = __spark_entry__.queries()[name](spark, DATA).toPandas(), con.sql(__spark_entry__.oracle_sql()[name]).df()
        cols = sorted(want.columns)
        flat = lambda d: sorted(tuple(str(v) if isinstance(v, str) else "-" if pd.isna(v) else str(float(v)) for v in r) for r in d[cols].astype(object).itertuples(index=False))
        assert sorted(got.columns) == cols and flat(got) == flat(want), name


def test_licenses_edge(spark, edge):
    got = {(r.doc_id, r.n_words): r for r in licenses.license_scan(edge).collect()}
    assert licenses.license_scan(edge).count() == len(EDGE) and licenses.license_scan(edge.limit(0)).count() == 0
    r = got[None, 8]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (3, 1, 6, "cc-by,mit")
    assert got[1, 0].score == 0 and got[1, 0].first_word is None
    near = licenses.license_scan(table(spark, [(1, "permission is hereby granted free of any charge to any person obtaining a copy of this software")])).first()
    assert near.labels == "mit-text" and near.n_base == 0


@pytest.mark.parametrize("most", [0, 20_000])
def test_whole_license(spark, monkeypatch, most):
    """A template of any length, its positions broadcast or joined by a shuffle: half of it in place, twice, with words put in."""
    monkeypatch.setattr(licenses, "MOST_GRAMS", most)
    ws = [f"term{i % 97} of{i % 89}" for i in range(400)]
    text = " ".join(ws).split()
    copy = " ".join([*text[:300], "or", "so", *text[300:500]])
    rows = [(1, copy + " . " + " ".join(text)), (2, " ".join(text[:300])), (3, "none of it"), (None, None)]
    got = {r.doc_id: r for r in licenses.license_scan(table(spark, rows), notices=[("whole", " ".join(text))]).collect()}
    assert (got[1].labels, got[1].score, got[2].labels, got[3].labels, got[None].n_words) == ("whole", 1.0, "", "", 0)


def top_brute(rows, wanted, k):
    """Each wanted row's best other rows, as sorted tuples."""
    out = []
    for n, (q, v) in enumerate(rows):
        if wanted(q):
            best = sorted((-int(np.dot(v, w)), i) for m, (i, w) in enumerate(rows) if m != n)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("part", [2048, 16])
def test_top_k(spark, monkeypatch, part):
    monkeypatch.setattr(topk, "PART", part)
    monkeypatch.setattr(topk, "CANDIDATES", 120)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-9, 9, 20).tolist()) for i in range(300)]
    # Rows that repeat, more often than k; a query that does; an id with two vectors, one of them the best for many.
    rows += [(7, [9] * 20)] * 4 + [rows[50]] * 2 + [(100, [8] * 20), (12, [9] * 20)] + [(11, rows[50][1])] * 7
    odd = [(900, None), (901, [1.0, None]), (902, [float("nan")]), (None, [1.0]), (903, [])]
    df = spark.createDataFrame([(i, [float(x) for x in v], "q") for i, v in rows] + [(*r, "q") for r in odd], "vec_id long, embedding array<double>, query_id string")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("id") % 50 == 0, scale=1).collect())
    assert got == top_brute(rows, lambda i: i % 50 == 0, 5)
    assert topk.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0
    big = spark.createDataFrame([(i, [1e17 * (i + 1), 1.0]) for i in range(0, 100, 25)], "vec_id long, embedding array<double>")
    assert topk.top_k(big, F.col("id") == 0, scale=1).count() == 3


@pytest.mark.parametrize("chunk", [40, 1000])
def test_pieces(spark, docs, edge, chunk):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for df in (docs.limit(25), edge):
        texts = [(r.doc_id, r.text or "") for r in df.collect()]
        short, long_ones = (x.collect() for x in pieces.encode_documents(df, chunk=chunk))
        got = [(r.doc_id, r.decoded, r.ids) for r in short]
        for _, rs in itertools.groupby(sorted(long_ones, key=lambda r: (r.row, r.chunk_no)), key=lambda r: r.row):
            rs = list(rs)
            got.append((rs[0].doc_id, "".join(r.decoded for r in rs), [i for r in rs for i in r.ids]))
        want = [(d, t.replace("▁", " "), model.encode(t)) for d, t in texts]
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_crc_joined():
    a, b = b"some bytes", b"and others, more of them"
    assert pieces.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_combining_states(monkeypatch):
    """States at cuts found in a tree are those of a walk over all matrices."""
    rng = np.random.default_rng(3)
    sizes = [1, *rng.integers(1, 5, 11).tolist(), 1]
    ms = [np.where(rng.random((a, b)) < 0.6, rng.integers(-5, 1, (a, b)).astype(float), pieces.NEVER) for a, b in itertools.pairwise(sizes)]
    cuts = pieces.inner_states(ms, 0, 0)
    value = sum(m[i, j] for m, i, j in zip(ms, [0, *cuts], [*cuts, 0], strict=True))
    assert value == pieces.product(ms)[0, 0] == pieces.times(pieces.product(ms[:5]), pieces.product(ms[5:]))[0, 0]


def test_counterfactual_penalty():
    # A group's name stands in toxic texts by chance only: swapping it mustn't change the score.
    rng = np.random.default_rng(0)
    y = (np.arange(200) % 2).astype("f4")
    x = np.stack([y, (y > 0) * (rng.random(200) < 0.9), (y == 0) * (rng.random(200) < 0.9)], 1).astype("f4")
    change = np.outer([0, -1, 1], [0, -1, 1]).astype("f4")
    plain, fair = toxicity.fit(x, y, change, 0.0)[0], toxicity.fit(x, y, change, 10.0)[0]
    assert abs(fair[1] - fair[2]) < 0.2 * abs(plain[1] - plain[2]) and fair[0] > 1


def test_counterfactual_pairs():
    one, two, put_in = toxicity.counterfactual("the women said so".split(), 5)
    assert (one, two, put_in) == (["the", "women", "said", "so"], ["the", "men", "said", "so"], False)
    for seed in range(3000):
        one, two, put_in = toxicity.counterfactual(["plain"], seed)
        group = next(g for g in toxicity.IDENTITY_GROUPS if one[-1] in g)
        assert put_in and one[:-1] == two[:-1] == ["plain"] and two[-1] in group and one[-1] != two[-1]


def test_penalty_evens_out_groups(spark):
    """On `documents`, the penalty changes the model and narrows what a group's terms make of held-out sentences."""
    path = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    loose, even = (toxicity.learn_toxicity(docs, labels, penalty=p) for p in (0.0, 10.0))
    assert loose["weights"] != even["weights"]
    texts = [r.text for r in docs.where("doc_id % 40 = 3 AND length(text) BETWEEN 50 AND 2000").limit(20).collect()]

    def gap(model):
        spread = lambda t, group: (lambda z: max(z) - min(z))([math.log(s / (1 - s)) for s in toxicity.scores([f"{t} {term}" for term in group], model)])
        return float(np.mean([spread(t, g) for t in texts for g in toxicity.IDENTITY_GROUPS]))

    assert gap(even) < 0.5 * gap(loose)


def test_toxicity_scores_brute(spark, docs):
    model = toxicity.learn_toxicity(docs, spark.read.parquet(f"{DATA}/labels.parquet"))

    def direct(text):
        ws = toxicity.WORD.findall((text or "").lower())
        z = model["intercept"]
        for f, weight in model["weights"].items():
            n = sum(w == f for w in ws) + sum(len(w) > h and w[:h] + "|" == f for w in ws for h in toxicity.HEADS)
            z += weight * math.log1p(n)
        return 1 / (1 + math.exp(-(z - model["cut"] + math.log(0.7 / 0.3))))

    some = docs.where("doc_id < 25 AND length(text) < 5000").unionByName(docs.sparkSession.createDataFrame([(-1, None, "en", "s", 0), (-2, "", "en", "s", 0)], docs.schema))
    for r in toxicity.score_toxicity(some, model).collect():
        assert r.score == pytest.approx(direct(r.text)) and r.predicted == int(r.score >= 0.7)


def test_quality_scores_brute(spark, docs):
    model = quality.learn_quality(docs, spark.read.parquet(f"{DATA}/labels.parquet"))

    def direct(text):
        ws = (text or "").split()
        x = list(quality.measures(text)) + [0.0] * quality.WORDS
        for w in ws:
            x[len(quality.MEASURES) + zlib.crc32(w.strip(".,;:!?()\"'").lower().encode()) % quality.WORDS] += 1 / len(ws)
        x[len(quality.MEASURES) :] = [math.sqrt(v) for v in x[len(quality.MEASURES) :]]
        z = sum(a * b for a, b in zip(x, model["w"], strict=True)) + model["b"]
        return 1 / (1 + math.exp(-max(-60, min(60, z - model["cut"] + math.log(0.3 / 0.7)))))

    some = docs.where("doc_id < 60").unionByName(spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", "en", "s", 0)], docs.schema))
    for r in quality.score_quality(some, model).collect():
        assert r.score == pytest.approx(direct(r.text), rel=1e-3, abs=1e-6) and r.predicted == int(r.score >= 0.3)


def test_quality_threshold():
    s, y = np.array([0.1, 0.2, 0.3, 0.9, 0.95]), np.array([0, 0, 0, 1, 1])
    assert quality.parting_quantile(s, y) == 0.6
    rng = np.random.default_rng(2)
    u = rng.normal(size=(400, 4))
    y = (u[:, 0] > 0.2).astype(int)
    w = quality.fit(u, y)
    assert w[0] > 5 * np.abs(w[1:]).max()


def test_quality_learns_from_all_labels(spark):
    """Bad ones that come after 20,000 others in the order of the ids' hashes are learnt from, and so is every other label."""
    ids = spark.range(26_000).withColumnRenamed("id", "doc_id").where("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) <> 0").orderBy(F.xxhash64("doc_id"), "doc_id").toPandas().doc_id.tolist()
    assert len(ids) > 20_400
    rows = [(d, "lorem ipsum | dolor ||| !!!" if k >= 20_000 else f"a fair text of plain words, number {d}", int(k < 20_000), 0) for k, d in enumerate(ids)]
    table = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text", "quality", "toxic"]))
    model = quality.learn_quality(table, table.select("doc_id", "quality", "toxic"))
    assert model["quantile"] == pytest.approx((len(ids) - 20_000) / len(ids), abs=1e-3)
    got = quality.scores(["lorem ipsum | dolor ||| !!!", "a fair text of plain words, number 7"], model)
    assert got[0] < 0.3 <= got[1]


def test_quality_all_pairs(spark, docs):
    """The model is where the mean loss of all pairs of a good and a bad document, written out, has no slope; the cut is the
    quantile of all labelled rows' scores."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.learn_quality(docs, labels)
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality").toPandas()
    rows = rows[[zlib.crc32(str(d).encode()) % 5 != 0 for d in rows.doc_id]]
    x, y = np.stack([quality.features(t) for t in rows.text]).astype("f8"), rows.quality.to_numpy()
    scale = x.std(0) + 1e-6
    scale[len(quality.MEASURES) :] = math.sqrt((scale[len(quality.MEASURES) :] ** 2).mean())
    d = ((x[y > 0][:, None] - x[y == 0][None]) / scale).reshape(-1, x.shape[1])
    w = model["w"] * scale
    slope = quality.RIDGE * w - (d / (1 + np.exp(d @ w))[:, None]).mean(0)
    assert np.abs(slope).max() < 1e-3 * np.abs(d.mean(0) / 2).max()
    s = np.sort(x @ model["w"] + model["b"])
    k = round(model["quantile"] * len(s))
    assert s[k - 1] - 0.01 <= model["cut"] <= s[k] + 0.01


@pytest.mark.parametrize("name, target, at_least", [("op4_toxicity", "toxic", 0.93), ("op5_quality", "quality", 0.97)])
def test_held_out(spark, name, target, at_least):
    path = "/root/testdata/sf0.1"
    got = __spark_entry__.queries()[name](spark, path).where("held_out").join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").toPandas()
    assert (got.predicted == got[target]).mean() > at_least and got.score.between(0, 1).all()


def test_classifiers_edge(spark, edge, docs):
    none, some = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.read.parquet(f"{DATA}/labels.parquet")
    for learn, score in ((toxicity.learn_toxicity, toxicity.score_toxicity), (quality.learn_quality, quality.score_quality)):
        model = learn(edge, none)
        assert model is None and {r.score for r in score(edge, model).collect()} == {0.5}
        # A fitted model on null, empty, very long, repeated and clashing rows, and on none.
        model = learn(docs, some)
        got = score(edge, model).collect()
        by_text: dict = {}
        for r in got:
            by_text.setdefault(r.text or "", set()).add(r.score)
        assert len(got) == len(EDGE) and all(len(v) == 1 for v in by_text.values()) and all(0 <= r.score <= 1 for r in got)
        assert score(edge.limit(0), model).count() == 0 and learn(edge.limit(0), some) is None
        # Labels that repeat and say both, or nothing.
        odd = some.unionByName(some).unionByName(spark.createDataFrame([(0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"))
        assert learn(docs, odd)["cut"] == model["cut"]


def test_languages(spark, docs, edge):
    model = language.learn_languages(docs, F.col("doc_id") % 4 != 2)
    got = language.predict_languages(docs, model).join(docs, "doc_id").where("doc_id % 4 = 2").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95
    pred = {r.doc_id: r for r in language.predict_languages(edge, model).collect()}
    assert pred[1].lang_pred == pred[2].lang_pred == pred[5].lang_pred == "und" and pred[3].lang_pred != "und"
    assert language.predict_languages(edge.limit(0), model).count() == 0
    nothing = language.learn_languages(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.predict_languages(edge, nothing).collect()} == {"und"}


def ppm(texts, order, raw):
    """Bits of raw by the definition: the longest context first, escapes by method C, without what is ruled out."""
    seen: dict = {}
    for t in texts:
        for k in range(order + 1):
            for i in range(k, len(t)):
                seen.setdefault(t[i - k : i], Counter())[t[i]] += 1

    def p(context, b):
        below = lambda x: 1 / 256 if context == b"" else p(context[1:], x)
        if context not in seen:
            return below(b)
        here = seen[context]
        total, kinds = sum(here.values()), len(here)
        return here[b] / (total + kinds) if b in here else kinds / (total + kinds) * below(b) / (1 - sum(map(below, here)))

    return [p(raw[max(0, i - order) : i], b) for i, b in enumerate(raw)], p


@pytest.mark.parametrize("order, full", [(1, 1 << 24), (3, 1 << 24), (3, 1)])
def test_code_lengths_brute(monkeypatch, order, full):
    monkeypatch.setattr(language, "FULL", full)
    draw = random.Random(1)
    make = lambda letters, n: bytes(draw.choice(letters) for _ in range(n))
    langs = [[make(b"abcd ", 60) for _ in range(3)], [make(b"bcde ", 50) for _ in range(4)]]

    def counted(texts, size):
        seen: Counter = Counter()
        for t in texts:
            for k, n in zip(*language.strings(t, size), strict=True):
                seen[int(k)] += int(n)
        return np.array(list(seen), "i8"), np.array(list(seen.values()), "i8")

    trees = language.Trees({"names": ["a", "b"], "order": order, "seen": [[counted(ts, size) for ts in langs] for size in range(1, order + 2)]})
    texts = [make(b"abcdexyz ", 40), make(b"abcd ", 30), b"z", make(b"e ", 9)]
    want = [[-np.log2(ppm(ts, order, t)[0]).sum() for ts in langs] for t in texts]
    assert np.allclose(trees.lengths(texts), want, atol=1e-3) and np.allclose(trees.lengths(texts[:1]), want[:1], atol=1e-3)
    # Those of a proper code: the probabilities of all bytes after a context add up to 1.
    assert sum(ppm(langs[0], order, b"")[1](b"ab"[:order], b) for b in range(256)) == pytest.approx(1)


def media_brute(d, t):
    raw = (t or "").encode()
    payload = raw + b" " * (-len(raw) % 192 if raw else 192)
    lines = b"".join(b"\0" + payload[i : i + 192] for i in range(0, len(payload), 192))
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    head = (64).to_bytes(4, "big") + (len(payload) // 192).to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
    image = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, media.LEVEL)) + chunk(b"IEND", b"")
    n, counts = len(payload), Counter(payload)
    mean = sum(payload) / n
    std = math.sqrt(sum((v - mean) ** 2 * c for v, c in counts.items()) / n)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    rgb = [sum(payload[k::3]) / (n // 3) for k in range(3)]
    return (d, len(raw), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), (mean, std, entropy, *rgb))


@pytest.mark.parametrize("size", [1 << 23, 1500])
def test_media(spark, docs, edge, size):
    """All columns against a direct computation, in one byte range and in many."""
    for df in (docs.where("doc_id < 40"), edge, edge.limit(0)):
        path = f"{shared_dir(spark)}/m-{uuid.uuid4().hex}"
        media.write_images(df.select(F.col("doc_id").cast("string").alias("key"), "text"), path)
        images = spark.read.format("image_archive").option("range_bytes", size).load(path)
        want = sorted((media_brute(r.doc_id, r.text) for r in df.collect()), key=str)
        got = sorted(((*r[:-1], tuple(float(x) for x in r.feature.replace("rgb=", "").replace(";", ",").replace("mean=", "").replace("std=", "").replace("entropy=", "").split(","))) for r in media.digests(images).collect()), key=str)
        assert [g[:-1] for g in got] == [w[:-1] for w in want]
        for g, w in zip(got, want, strict=True):
            assert g[-1] == pytest.approx(w[-1], abs=1e-3)


def test_media_archives(spark, edge):
    """Archives are whole tar files; a member that fails to read is tried again by itself, and one that stays bad fails."""
    import tarfile

    path = f"{shared_dir(spark)}/m-{uuid.uuid4().hex}"
    media.write_images(edge.select(F.col("doc_id").cast("string").alias("key"), "text"), path)
    parts = archives.ranges(path, 700)
    assert len(parts) > 3 and sum(len(archives.members(path, p)) for p in parts) == len(EDGE)
    fs, base = archives.opened(path)
    for name in {p.name for p in parts}:
        assert all(m.name.endswith(".png") for m in tarfile.open(f"{base}/{name}").getmembers())
        assert open(f"{base}/{name}", "rb").read().endswith(bytes(1024))
    part = parts[0]
    (offset, end), *_ = archives.members(path, part)

    class Flaky:
        opened = failures = 0

        def open_input_file(self, place):
            self.opened += 1
            file, outer = fs.open_input_file(place), self

            class File:
                seek, close = file.seek, file.close

                def read(self, n):
                    if outer.failures:
                        outer.failures -= 1
                        raise OSError("lost")
                    return file.read(n)

            return File()

    source = Flaky()
    member = archives.Member(source, f"{base}/{part.name}")
    whole = member.read(offset, end)
    source.failures = 2
    assert member.read(offset, end) == whole and source.opened == 3
    source.failures = archives.TRIES
    with pytest.raises(OSError):
        member.read(offset, end)


def test_packing(spark, docs, edge):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.default_tokenizer())
    for df in (docs, edge):
        got = packing.pack_documents(df, capacity=512, ids=True).toPandas()
        assert [zlib.crc32(bytes(i)) for i in got.ids] == got.ids_crc32.tolist() and [len(i) // 4 for i in got.ids] == got.length.tolist()
        want = []
        for r in df.collect():
            ids = model.encode(r.text or "", add_special_tokens=False).ids + [1]
            want += [(str(r.doc_id), p, at, len(ids[at : at + 512]), zlib.crc32(np.array(ids[at : at + 512], "<u4").tobytes())) for p, at in enumerate(range(0, len(ids), 512))]
        assert sorted(want) == sorted((str(None if pd.isna(r.doc_id) else int(r.doc_id)), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
        for _, s in got.sort_values("offset").groupby("sequence_id"):
            assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 512 and (3 * s.length > 512).sum() <= 2
    assert packing.pack_documents(edge.limit(0)).count() == 0
    few = packing.packed(packing.tokenised(edge, capacity=64), capacity=64, bucket=2)
    assert few.groupBy("sequence_id", "offset").count().where("count > 1").count() == 0 and few.count() == few.where("offset + length <= 64").count()


def test_plan():
    random.seed(2)
    for _ in range(30):
        cap = random.randint(10, 60)
        hist = {random.randint(1, cap): random.randint(1, 30) for _ in range(15)}
        seqs: dict = {}
        done: dict = {}
        for n, first, many, each, seq, offset in packing.plan(hist, cap):
            assert first == done.get(n, 0)
            done[n] = first + many * each
            for s in range(seq, seq + many):
                seqs.setdefault(s, []).extend((offset + k * n, n) for k in range(each))
        assert done == hist
        for items in seqs.values():
            items.sort()
            assert [a for a, _ in items] == list(itertools.accumulate([0, *[n for _, n in items[:-1]]])) and sum(n for _, n in items) <= cap


def test_warc(spark):
    rows = [(5, "http://a/b c", "same" * 50), (3, None, "same" * 50), (9, "u", None), (2, "u", "short"), (1, "u", "short"), (None, "u", "same" * 50), (7, "u", "z" * 5000)]
    path = f"{shared_dir(spark)}/w-{uuid.uuid4().hex}"
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    chunks = warc.read_warc(spark, path, chunk=1024).collect()
    last = {r.page_id: r for r in chunks if r.is_last}
    assert len(last) == 7 and (last[5].record_type, last[5].refers_to, last[5].bytes_so_far) == ("revisit", 3, 200)
    assert all(last[i].record_type == "response" for i in (3, 9, 2, 1, None, 7))
    seven = sorted((r for r in chunks if r.page_id == 7), key=lambda r: r.chunk_no)
    assert len(seven) == 5 and b"".join(r.chunk for r in seven) == b"z" * 5000
    for r in seven:
        assert r.digest_so_far == hashlib.sha256(b"z" * r.bytes_so_far).hexdigest()


def test_warc_edge(spark):
    """Rows that repeat, no address, null ids, clashing columns, a very long payload: (record, chunk number) stays a key."""
    rows = [(1, "same" * 50, "k")] * 3 + [(2, "same" * 50, "k"), (None, "x" * 200, "k"), (None, "x" * 200, None), (3, None, "k"), (4, "y" * 3_000_000, "k")]
    pages = spark.createDataFrame(rows, "page_id long, html string, digest string")
    for df, many in ((pages, 8), (pages.limit(0), 0)):
        path = f"{shared_dir(spark)}/w-{uuid.uuid4().hex}"
        warc.write_warc(df, path)
        chunks = warc.read_warc(spark, path, chunk=1 << 16)
        assert chunks.where("is_last").count() == many and chunks.select("record_id", "chunk_no").distinct().count() == chunks.count()
    last = warc.read_warc(spark, path.replace(path, path), payload=False).where("is_last")
    assert last.count() == 0


def test_near_copies(spark, docs):
    random.seed(1)
    base = [f"w{i}" for i in range(300)]
    rows = [(100 + k, " ".join(w if j % 97 != k else "changed" for j, w in enumerate(base))) for k in range(40)]
    rows += [(1, " ".join(base)), (2, " ".join(base)), (3, None), (4, ""), (5, "two words"), (6, "two words"), (None, " ".join(base)), (7, " ".join(f"v{i}" for i in range(300)))]
    got = {r.doc_id: r for r in neardup.classes(table(spark, rows)).collect()}
    assert {got[i].class_id for i in (1, 2, *range(100, 140))} == {1}
    assert (got[3].class_id, got[4].class_id, got[5].class_id, got[6].class_id, got[7].class_id, got[None].class_id) == (3, 4, 5, 5, 7, None)
    kept = sorted(r.doc_id for r in neardup.one_of_each(table(spark, rows)).where("doc_id IS NOT NULL").collect())
    assert kept == [1, 3, 4, 5, 7]
    assert neardup.banding(0.8, 0.9995, 128) == (20, 5)
    assert neardup.classes(table(spark, rows).limit(0)).count() == 0


def brute_classes(rows, similar=0.8):
    texts = {i: set(neardup.gram_set(t).tolist()) for i, t in rows}
    head = {d: d for d in texts}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        if (both := len(texts[a] & texts[b])) and both / len(texts[a] | texts[b]) >= similar:
            x, y = sorted((find(a), find(b)))
            head[y] = x
    return {d: find(d) for d in texts}


def test_near_copies_less_alike(spark):
    """A pair that shares 0.44 of its n-grams is one class where 0.4 is asked for, also by sizes that differ."""
    base = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:180])), (3, " ".join(f"v{i}" for i in range(300)))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.classes(table(spark, rows), similar=0.4).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0)} and brute_classes(rows, 0.4) == {1: 1, 2: 1, 3: 3}


def test_one_of_each_rows(spark):
    """Ids that repeat: other texts stay, equal rows and near copies go, whatever the columns are called."""
    base, other = " ".join(f"w{i}" for i in range(200)), " ".join(f"v{i}" for i in range(200))
    rows = [(1, base), (1, base), (1, other), (2, base + " more"), (2, "a text of its own with words enough"), (3, other + " more"), (4, None), (4, None), (5, ""), (None, base), (None, base)]
    df = table(spark, rows).withColumnRenamed("key", "_kept").withColumnRenamed("node", "label").withColumnRenamed("row", "_kept__n")
    got = neardup.one_of_each(df)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), (r.text or "")[:6]) for r in got.collect()) == sorted([("1", base[:6]), ("1", other[:6]), ("2", "a text"), ("4", ""), ("4", ""), ("5", ""), ("None", base[:6]), ("None", base[:6])])


def test_near_copies_brute(spark, docs):
    assert {r.doc_id: r.class_id for r in neardup.classes(docs).collect()} == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_large_bucket_brute(spark, monkeypatch):
    """Variants about as far from each other as links allow: what the hubs miss, blocks smaller than the bucket find."""
    monkeypatch.setattr(neardup, "BLOCK", 15_000)
    draw, base = random.Random(5), [f"w{k}" for k in range(300)]
    rows = []
    for i in range(400):
        ws = list(base)
        for k in range(draw.randrange(2, 9)):
            ws[draw.randrange(300)] = f"v{i}x{k}"
        rows.append((i, " ".join(ws)))
    want, got = brute_classes(rows), {r.doc_id: r.class_id for r in neardup.classes(table(spark, rows)).collect()}
    assert got == want and 1 < len(set(want.values())) < 400


def brute_links(rows):
    """Number of other texts that each row's text is linked to; equal sets are one text."""
    texts = {i: frozenset(neardup.gram_set(t).tolist()) for i, t in rows}
    near = {a: sum(a != b and len(a & b) / len(a | b) >= 0.8 for b in set(texts.values())) if a else 0 for a in set(texts.values())}
    return {i: near[t] for i, t in texts.items()}


@pytest.mark.parametrize("block", [1 << 18, 2000])
def test_links_brute(spark, monkeypatch, block):
    """Links within a class, in groups below and above the size of a small bucket and of a block."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    draw, rows = random.Random(8), [(0, None), (1, ""), (2, "two words"), (3, "two words")]
    for group, size in enumerate((2, 3, 8, 9, 40)):
        base = [f"g{group}w{k}" for k in range(300)]
        for i in range(size):
            ws = list(base)
            for k in range(draw.randrange(1, 7)):
                ws[draw.randrange(300)] = f"v{i}x{k}"
            rows.append((len(rows), " ".join(ws)))
    rows += [(len(rows), rows[-1][1])]
    want = brute_links(rows)
    assert {r.doc_id: r.n_links for r in neardup.classes(table(spark, rows)).collect()} == want and len(set(want.values())) > 8


def test_common_counts():
    sets = [np.array([1, 5, 9], "u8"), np.array([2, 5], "u8"), np.array([7], "u8")]
    values, owners = np.concatenate(sets), np.repeat([0, 1, 2], [3, 2, 1])
    order = np.argsort(values, kind="stable")
    assert neardup.common_counts(np.array([5, 9, 11], "u8"), values[order], owners[order], 3).tolist() == [2, 1, 0]
    assert neardup.common_counts(np.array([4], "u8"), values[order], owners[order], 3).tolist() == [0, 0, 0]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    tox, qual = toxicity.learn_toxicity(docs, labels), None
    keep = {r.doc_id for r in docs.collect() if toxicity.scores([r.text], tox)[0] < 0.7}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        if name == "quality":
            qual = quality.learn_quality(docs, labels)
            keep = {r.doc_id for r in docs.collect() if quality.scores([r.text], qual)[0] >= 0.3}
        if name == "ngram_jaccard_join":
            keep = set(brute_classes([(r.doc_id, r.text) for r in docs.collect()]).values())
        assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == keep
        docs = out
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()} and all(len(r.ids) == 4 * r.length for r in got)


def test_stages_edge(spark, edge, tmp_path):
    """Each stage on null, empty, very long and repeated rows with clashing columns, and on none; with labels and without."""
    import corpus_pipeline

    edge = edge.withColumnRenamed("row", "predicted").withColumnRenamed("node", "label")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for folder in (DATA, str(tmp_path)) if name in ("toxicity", "quality") else (DATA,):
            out, empty = stage(spark, edge, folder), stage(spark, edge.limit(0), folder)
            assert empty.count() == 0
            if name == "best_fit_packing":
                assert {r.doc_id for r in out.collect()} == {d for d, _ in EDGE}
            else:
                assert out.columns == edge.columns and out.count() == len(EDGE) - (name == "ngram_jaccard_join")


def test_pipeline_hands_out_few_texts(spark, docs, edge, monkeypatch):
    """No stage gives a worker a batch of 10,000 whole texts, and scores are those of whole batches."""
    import corpus_pipeline

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    every = docs.unionByName(edge.select(docs.columns))
    for stage, learn, column in ((corpus_pipeline.drop_toxic, toxicity.learn_toxicity, toxicity.score_column), (corpus_pipeline.drop_poor, quality.learn_quality, quality.score_column)):
        plan = stage(spark, every, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
        for model in (learn(docs, labels), None):
            assert every.where(~column(model, arrow=False).eqNullSafe(column(model))).count() == 0
    name, seen, plain = "spark.sql.execution.arrow.maxRecordsPerBatch", [], packing.stored
    monkeypatch.setattr(packing, "stored", lambda *a: (seen.append(int(spark.conf.get(name))), plain(*a))[1])
    before = spark.conf.get(name)
    corpus_pipeline.pack(spark, edge, DATA)
    assert seen and max(seen) <= 1000 and spark.conf.get(name) == before


def test_worker_remembers_one_operator():
    path = packing.default_tokenizer()
    quality.features("a few words")
    assert quality._buckets
    neardup.gram_set("a few words of another operator")
    assert neardup._hashes and not quality._buckets
    few = packing.loaded(path, 10)
    assert packing.loaded(path, 10) is few and not neardup._hashes
    assert packing.loaded(path, 20).memory == 20 and len(packing._loaded) == 1
    quality.features("a few words")
    assert quality._buckets and not packing._loaded
