import collections
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from reqwatch.llm import mixing, quality
from reqwatch.llm.common import table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counts, columns = [docs.count()], docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            docs = docs.cache()
            counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[2] < counts[1] and counts[3] == counts[2]
    ids = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert len(ids) == counts[-1]


def test_empty(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


CLASH = ["quality", "row_key", "redacted", "row", "judged", "counts", "order", "bucket", "tie", "domain", "rep", "epochs", "component_id", "KEPT", "n_tokens"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    r = random.Random(3)
    prose = lambda n: " ".join(r.choice(["the", "of", "and"]) if k % 4 == 0 else "".join(r.choices("abcdefgh", k=r.randint(2, 8))) for k in range(n))
    a, b = prose(120), prose(90)
    texts = [a, a, b, b + " more", None, "", " \n\t", "one two", prose(40_000), "x" * 70_000, "#$" * 200, "same line\n" * 80, a + " password=hunter2hunter2 tail", *(prose(r.randint(20, 200)) for _ in range(25))]
    rows = [(None if k % 6 == 5 else k // 2, t, r.choice(["en", "de", None]), r.choice(["src1", "src2", "host", None]), None if k % 4 else len(t or ""), *(None if k % 3 else f"{c}{k}" for c in CLASH)) for k, t in enumerate(texts)]
    rows += [rows[0], rows[2], rows[5], rows[20], rows[20], rows[23]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache(), rows


def counted(rows):
    return collections.Counter(map(repr, (tuple(r) for r in rows)))


def test_quality_stage(spark, odd):
    docs, rows = odd
    from test_operators import brute_quality, words

    def keeps(t):
        n, chars, symbols, lines, _, failed = brute_quality(t)
        w, own = words(t), [x for x in (t or "").split("\n") if words(x)]
        value = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_lines": len(own), "n_stop_words": sum(x.lower() in quality.STOP_WORDS for x in w), "n_capitals": sum("A" <= c <= "Z" for c in t or "")}
        return not failed and all(not value[x.denominator] or x.low <= value[x.numerator] / value[x.denominator] <= x.high for x in quality.RULES)

    got = quality.quality_filter(spark, docs, "")
    assert got.columns == docs.columns and counted(got.collect()) == counted(r for r in rows if keeps(r[1]))


def test_near_dedup_stage(spark, odd):
    docs, rows = odd
    from test_operators import brute_components, shingles

    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    kept = [tuple(r) for r in got.collect()]
    assert got.columns == docs.columns and not counted(kept) - counted(rows)
    sets = [(k, shingles(r[1])) for k, r in enumerate(rows)]
    group = brute_components(sets, lambda x, y: bool(x and y) and 100 * len(x & y) >= 75 * len(x | y))
    best = {}
    for k, r in enumerate(rows):
        best[group[k]] = min(best.get(group[k], (True, 1 << 62)), (r[0] is None, r[0] or 0))
    assert sorted((r[0] is None, r[0] or 0) for r in kept) == sorted(best.values())
    texts = collections.Counter(min(group[k] for k, x in enumerate(rows) if x[1] == r[1]) for r in kept if shingles(r[1]))
    assert set(texts.values()) == {1}


def test_secret_stage(spark, odd):
    from reqwatch.llm import secrets

    docs, rows = odd
    got = secrets.redaction_stage(spark, docs, "")
    out = got.collect()
    assert got.columns == docs.columns and len(out) == len(rows)
    assert counted((r[0], *r[2:4], *r[5:]) for r in out) == counted((r[0], *r[2:4], *r[5:]) for r in rows)
    assert not any("hunter2" in (r.text or "") for r in out) and sum(r.text is None for r in out) == sum(r[1] is None for r in rows)
    same = counted(r for r in rows if r[1] is None or "hunter2" not in r[1] and not any(len(w) > 15 for w in r[1].split()))
    assert not same - counted(out)


@pytest.mark.parametrize("share", [0.3, 0.8, 1.0])
def test_mixing_stage(spark, odd, monkeypatch, share):
    """Against a walk through each leaf in the seeded order."""
    monkeypatch.setattr(mixing, "PIPELINE_SHARE", share)
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 2)
    docs, rows = odd
    got = mixing.mixing_stage(spark, docs, "")
    assert got.columns == docs.columns
    order = F.xxhash64(F.lit(mixing.SEED), F.lit(0).cast("long"), F.col("doc_id"), F.xxhash64("text"))
    leaf = [mixing.domain_of(F.col("source")).alias("d"), "lang", "source"]
    seen = docs.select(*leaf, mixing.words_of(F.col("text")).alias("n"), order.alias("o"), F.xxhash64("text").alias("t"), F.struct(*docs.columns).alias("row")).where("n > 0").collect()
    leaves = collections.defaultdict(list)
    for x in seen:
        leaves[x.d, x.lang, x.source].append(x)
    totals = [(k, sum(x.n for x in v)) for k, v in leaves.items()]
    budget = mixing.leaf_budgets(totals, mixing.WEIGHTS, int(sum(t for _, t in totals) * share), 1)
    want, groups = collections.Counter(), []
    for k, v in leaves.items():
        at = 0
        for x in sorted(v, key=lambda x: (x.o, x.row.doc_id is not None, x.row.doc_id or 0, x.t)):
            if at < budget[k]:
                want[x.row.doc_id, x.row.text] += 1  # of equal rows, as many
            at += x.n
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert not counted(got.collect()) - counted(rows)
    taken = mixing.mix(docs, budget_share=share, max_epochs=1)
    assert collections.Counter(r.doc_id for r in taken.collect()) == collections.Counter(i for i, _ in want.elements())


def test_mixing_many_equal_rows(spark, monkeypatch):
    """Of equal rows in which a leaf's budget ends, only as many stay as fit."""
    monkeypatch.setattr(mixing, "PIPELINE_SHARE", 0.4)
    docs = spark.range(50).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two three four").alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.col("id").alias("n_chars")).repartition(4)
    got = mixing.mixing_stage(spark, docs, "").collect()
    assert len(got) == 20 == len({r.n_chars for r in got})
    assert sum(r["take"] for r in mixing.mix(docs, budget=81, max_epochs=1).collect()) == 81
    assert sum(r["take"] for r in mixing.mix(docs, budget=281, max_epochs=2).collect()) == 281


def test_packing_stage(spark, odd):
    from tokenizers import Tokenizer

    from reqwatch.llm import packing

    docs, rows = odd
    t = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.packing_stage(spark, docs, "").collect()
    want = collections.Counter()
    for i, text, *_ in rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids) + 1
        want.update((i, k, lo, min(4096, n - lo)) for k, lo in enumerate(range(0, n, 4096)))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length) for r in got) == want


def test_near_dedup_rows_with_repeated_and_null_ids(spark):
    base = {c: " ".join(f"{c}{k}" for k in range(60)) for c in "abcd"}
    near = lambda c: base[c] + " tail"
    rows = [(1, base["a"]), (1, base["a"]), (1, near("a")), (7, near("a")), (None, base["a"]), (3, base["b"]), (3, base["c"]), (None, base["d"]), (None, near("d")), (4, None), (None, None), (4, "")]
    rows = [(i, t, "en", "src1", k) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    group = lambda t: (t or "")[:1] or None
    assert {g: sum(group(t) == g for _, t in kept) for g in "abcd"} == dict.fromkeys("abcd", 1)
    assert [i for i, t in kept if group(t) == "a"] == [1] and sum(not t for _, t in kept) == 3
    # brute force: groups of near copies, the least (id, nulls last) of each
    grams = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    want = {}
    for i, t in [(r[0], r[1]) for r in rows if r[1]]:
        mine = next((g for g in want if len(grams(g) & grams(t)) >= 0.75 * len(grams(g) | grams(t))), t)
        want.setdefault(mine, []).append((i is None, i or 0))
    assert sorted((i is None, i or 0) for i, t in kept if t) == sorted(min(g) for g in want.values())
