import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reqwatch.llm import fim, gam, lexical

SCHEMA = "doc_id long, text string, lang string, label string, score string, x string, n string, rank string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    texts = {
        0: prose(1, 300), 1: prose(2, 300), 2: prose(1, 300), 3: None, 4: "", 5: " \t\n ", 6: "one", 7: "One two. ", 8: "x" * 5000, 9: prose(3, 30_000), 10: "é" * 150 + " ünïcode 你好  Äb9" + prose(1, 20),
        11: "a<P>b c", 12: "ends in space \n", 13: "|".join("=()*" * 40), 14: "\n".join(["same line here"] * 40), 15: "A1b2-c3", 16: "ZZ zz Zz zZ", 17: "﻿ mark\x00null\x7f", 18: "< S> <S < P> <M",
    }
    out = [(k, t, "en" if k % 3 else None, "clash", None, "c", "c", "c") for k, t in texts.items()]
    return [*out, out[0], (7, "other text of a repeated id", None, None, None, None, None, None), (None, prose(1, 300), None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# op 11
def terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute_search(rows, items, top):
    own = [(i, Counter(terms(t))) for i, t, *_ in rows]
    n, total = sum(1 for _, c in own if c), sum(sum(c.values()) for _, c in own)
    df, out = Counter(w for _, c in own for w in c), []
    for item, text in items:
        scores = []
        for i, c in own:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if w in c)
            if s > 0:
                scores.append((-s, (i is None, i or 0), i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores)[:top])]
    return Counter(out)


ITEMS = [(1, prose(1, 40)), (2, prose(2, 5)), (3, None), (4, ""), (5, "zz a1b2 ONE 你好"), (None, prose(3, 20)), (1, "a b c d e"), (6, "nowhere-to-be-found!"), (7, prose(4, 3000))]


@pytest.mark.parametrize(("top", "block", "postings"), [(50, 1 << 18, 1 << 20), (3, 30, 1 << 20), (2, 1, 40)])
def test_search_equals_brute_force_over_shards_and_blocks(spark, docs, rows, top, block, postings):
    items = spark.createDataFrame([(i, t, 1, "c") for i, t in ITEMS], "item_id long, text string, doc_id long, score string")
    got = lexical.search(docs, items, top, block_terms=block, shard_postings=postings)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert Counter(map(tuple, got.collect())) == brute_search(rows, ITEMS, top)


def test_search_of_empty_tables(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(none, items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0


def test_search_skips_documents_and_ties_go_by_id():
    r = np.random.default_rng(7)
    rare, docs = 5, 4000
    per = r.integers(1, 8, docs)
    held = [np.unique(np.append(r.integers(50, 60, k), r.integers(0, 50, 1) if d % 40 == 0 else r.integers(50, 60, 1))) for d, k in enumerate(per)]
    sizes, ids = np.array([len(h) for h in held]), r.permutation(docs).astype(np.int64)
    flat = np.concatenate(held)
    weights = np.where(np.arange(60) < 50, 9000, 200)
    shard = lexical.Shard.build(ids, np.full(docs, 100), sizes, flat, np.ones(len(flat), np.int64), weights, docs, 100 * docs)
    queries = [np.array([k, *range(50, 60)]) for k in range(rare)]
    heaps = lexical.Heaps(rare, 10)
    scored = lexical.wand(shard, queries, heaps)
    impact = (10**9) // (1000 + 20 * 100)
    for q, terms_ in enumerate(queries):
        want = sorted(((int(weights[[t for t in h if t in set(terms_.tolist())]].sum()) * impact, -int(i)) for h, i in zip(held, ids, strict=True)), reverse=True)[:10]
        assert sorted(zip(heaps.scores[q].tolist(), (-heaps.ids[q]).tolist(), strict=True), reverse=True) == want
    assert scored < rare * docs / 2


# op 12
def test_shares_of_texts():
    texts = ["The cat sat.\nA dog ran, far away.", "", "no no no no", "AB## CD$$ ef%% |", "é É"]
    data = [t.encode() for t in texts]
    x = gam.features(np.frombuffer(b"".join(data), np.uint8), np.append(0, np.cumsum(list(map(len, data)))))
    col = {name: x[:, k] for k, name in enumerate(gam.FEATURES)}
    assert x.shape == (5, len(gam.FEATURES)) and not x[1].any()
    assert np.allclose(col["words"], np.log1p([8, 0, 4, 4, 2])) and np.allclose(col["repeats"], [0, 0, 0.75, 0, 0]) and np.allclose(col["longest_repeat"], [0, 0, 0.75, 0, 0])
    assert np.allclose(col["symbols_per_word"], [0, 0, 0, 1.5, 0]) and np.allclose(col["bars_per_word"], [0, 0, 0, 0.25, 0]) and np.allclose(col["shouted_words"], [0, 0, 0, 0.5, 0])
    assert np.allclose(col["distinct_words"], [1, 0, 0.25, 1, 1]) and np.allclose(col["words_per_line"], np.log1p([4, 0, 4, 4, 2])) and np.allclose(col["symbol_words"], [0, 0, 0, 1, 0])
    assert np.isclose(col["capital_words"][0], 0.25)
    # a text's shares do not hang on its neighbours
    for k, d in enumerate(data):
        assert np.allclose(gam.features(np.frombuffer(d, np.uint8), np.array([0, len(d)]))[0], x[k])


def test_repeated_lines_are_told_apart_by_their_words():
    share = lambda t: gam.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0][gam.FEATURES.index("repeated_lines")]
    assert np.isclose(share("a b\nc d\na b\n\nb a"), 0.25) and share("a b\nb a") == 0 and share("a\nb c\na b\nc") == 0


def test_pairwise_tables_learn_what_no_single_feature_says():
    r = np.random.default_rng(1)
    x = r.random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.train(x, y)
    assert {model.pairs[0][0], model.pairs[0][1]} == {0, 1}
    fresh = r.random((2000, 5))
    right = (model.score(fresh) >= 0.5) == ((fresh[:, 0] > 0.5) ^ (fresh[:, 1] > 0.5))
    assert right.mean() > 0.93
    # the score is the sum of table entries, taken one by one
    z = model.start + sum(t[np.searchsorted(c, fresh[0, j], "right")] for j, (c, t) in enumerate(zip(model.cuts, model.tables, strict=True)))
    z += sum(t[np.searchsorted(a, fresh[0, i], "right"), np.searchsorted(b, fresh[0, j], "right")] for i, j, a, b, t in model.pairs)
    assert np.isclose(1 / (1 + math.exp(-z)), model.score(fresh[:1])[0])


def test_quality_scores_of_odd_tables(spark, docs, rows, none):
    labels = spark.createDataFrame([(k, k % 2, 0, "t") for k in range(19)] + [(7, None, 0, "t"), (None, 1, 0, "t"), (8, 5, 1, "t"), (7, 0, 1, "t")], "doc_id long, quality int, toxic int, text string")
    out = gam.quality_scores(docs, gam.fit(docs, labels)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    for some in (labels.limit(0), labels.where("quality = 1")):
        flat = gam.quality_scores(docs, gam.fit(docs, some)).select("score").distinct().collect()
        assert len(flat) == 1
    assert gam.quality_scores(none, gam.fit(none, labels)).count() == 0


def test_held_out_labels_are_never_learned(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(gam.remainder(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [{r.doc_id: r.score for r in gam.quality_scores(docs, gam.fit(docs, x)).collect()} for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = gam.op12_quality_model(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert (good.predicted == 1).mean() > 0.97 and (bad.predicted == 0).mean() > 0.7
    assert (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None]).mean() > 0.97


# op 13
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fim(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or h3 % 100 >= 50 or any(x in text for x in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_equals_brute_force(spark, docs, rows, none):
    out = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = Counter((r[0], *brute_fim(r[0], r[1]), r[1] or "") for r in rows)
    assert Counter(map(tuple, out)) == want
    assert fim.fill_in_middle(none).count() == 0


@pytest.mark.parametrize(("every", "block"), [(1, 1), (3, 7), (64, 1 << 16)])
def test_checkpoints_find_every_cut(rows, every, block):
    for text in [r[1] for r in rows if r[1] is not None and len(r[1]) < 3000] + ["  a", "a  ", " \n\x0b", "ü ß\t€ 😀x"]:
        raw, units = np.frombuffer(text.encode(), np.uint8), UNIT.findall(text)
        index = fim.Checkpoints.count(raw, every, block)
        assert index.n == len(units) and len(index.units) <= 1 + len(units) // every
        for u in range(0, len(units) + 1, max(1, len(units) // 20)):
            head = "".join(units[:u])
            assert index.cut(u, block) == (len(head.encode()), len(head))


def test_all_forms_come_and_rebuild_the_text(spark, docs):
    texts = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("a <b> c < S>"), F.repeat(F.lit(" wörd\n"), (F.col("id") % 9).cast("int"))).alias("text"))
    out = fim.fill_in_middle(texts, rate=90, spm_rate=50).withColumn("back", fim.restored(F.col("output"), F.col("form"))).join(texts, "doc_id")
    assert {r.form for r in out.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert out.where("back <> text").count() == 0
