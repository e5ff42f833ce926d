"""The pipeline's stages on a small corpus, each against brute force over its own input."""

import random
import re

import corpus_pipeline
import pytest

LETTERS = ["ba", "do", "ki", "lu", "me", "ra", "to"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices(LETTERS, k=3))
    texts = [" ".join(word() for _ in range(rng.choice([20, 60, 120]))) for _ in range(120)]
    item = " ".join(word() for _ in range(25))
    texts += [texts[3], texts[4] + " extra", "12 34", None, "", "begin " + item + " end"]
    rows = [(i, t, "xx", f"s{i % 4}", None, "clash") for i, t in enumerate(texts)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_have_effect(spark, corpus, tmp_path):
    docs, seen = spark.read.parquet(f"{corpus}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, corpus).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    ids = {k: sorted(r["doc_id"] for r in v) for k, v in seen.items()}
    assert ids["language_id"] == [*range(122), 125]
    assert ids["near_dedup"] == [*range(120), 125]
    assert ids["decontaminate"] == list(range(120))
    sizes = {r["doc_id"]: len(r["text"].split()) for r in seen["decontaminate"]}
    assert abs(sum(sizes[i] for i in ids["mix"]) / (1.5 * sum(sizes.values())) - 1) < 0.1 and max(ids["mix"].count(i) for i in sizes) <= 2
    assert ids["shard"] == ids["mix"] and set(corpus_pipeline.COLUMNS) == set(spark.read.parquet(f"{tmp_path}/mix").columns)
    assert corpus_pipeline.run(spark, corpus).count() == len(ids["shard"])


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "xx", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_dedup_equals_brute_force_with_repeated_and_null_ids(spark):
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choices(LETTERS, k=3)) for _ in range(60))
    alpha, beta, gamma, delta = (text() for _ in range(4))
    rows = [(1, alpha), (1, beta), (2, gamma), (3, gamma + " end"), (3, delta), (None, alpha), (None, text()), (5, delta), (4, delta), (1, alpha)]
    rows += [(rng.randrange(10), text()) for _ in range(40)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    least = {}
    for i, r in enumerate(root):
        least.setdefault(r, []).append((rows[i][0] is None, rows[i][0] or 0, rows[i]))
    got = stage("near_dedup")(spark, rows_of(spark, rows), "").collect()
    assert len(got) == len(least)
    for group in least.values():  # of equal smallest ids any one row stays
        assert sum((r["doc_id"], r["text"]) in {row for n, i, row in group if (n, i) == min(group, key=lambda g: g[:2])[:2]} for r in got) >= 1
    assert {t for _, t in rows} - {r["text"] for r in got} == {gamma + " end"}


def test_decontaminate_equals_brute_force(spark, corpus):
    item = [r["text"] for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()][0].split()
    rng = random.Random(3)
    rows = []
    for i in range(60):
        words = ["".join(rng.choices(LETTERS, k=3)) for _ in range(30)]
        at = rng.randrange(16)
        rows.append((i // 2, " ".join(words[:10] + item[at : at + rng.choice([0, 8, 9, 10, 11])] + words[10:])))
    rows.append((None, " ".join(item)))
    spans = {tuple(item[k : k + 10]) for k in range(len(item) - 9)}
    clean = [(i, t) for i, t in rows if not any(tuple(w[k : k + 10]) in spans for w in [re.findall(r"\w+", t)] for k in range(len(w) - 9))]
    got = [(r["doc_id"], r["text"]) for r in stage("decontaminate")(spark, rows_of(spark, rows), corpus).collect()]
    assert sorted(got) == sorted(clean) and 20 < len(got) < 60


def test_mix_follows_the_schedule(spark, tmp_path):
    """Rows come out in the schedule's order: every stretch of the output holds the sources by their targets."""
    texts = [f"w{i} " * 64 for i in range(400)]
    docs = spark.createDataFrame([(i % 300, texts[i], "xx", "abc"[(i >= 100) + (i >= 300)], None) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    stage("mix")(spark, docs, "").write.parquet(f"{tmp_path}/mix")
    import glob

    rows = [r["source"] for f in sorted(glob.glob(f"{tmp_path}/mix/part-*.parquet")) for r in spark.read.parquet(f).collect()]
    # 600 documents' words by 5, 2, 1, of which a may have 200, and what it leaves goes to b (267) and c (133)
    assert abs(rows.count("a") - 200) <= 1 and abs(rows.count("b") - 267) <= 1 and abs(rows.count("c") - 133) <= 1
    for k in range(0, 540, 60):
        assert abs(rows[k : k + 60].count("a") - 20) <= 8 and abs(rows[k : k + 60].count("c") - 13) <= 8


def test_stages_take_empty_documents(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus).count() == 0


def test_stages_can_be_composed_before_any_is_run(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    chained = stage("decontaminate")(spark, stage("near_dedup")(spark, docs, corpus), corpus)
    other = stage("mix")(spark, docs, corpus)
    assert chained.count() > 0 and other.count() > 0 and chained.count() == chained.select("doc_id").count()
